"""Smaller copies of images: separable Lanczos resampling as two matrix products, written as PNG.

Which images need one is told by their bytes alone, so the others are never decoded or sent to Python.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes (width, height) of images for an analysis and of those that are too large, and the bytes from which they are.
ANALYSIS_SIZE, SAFE_SIZE, MOST_BYTES = (768, 1664), (1290, 2796), 18 * 1024 * 1024
LOBES = 3


def weights(n_in: int, n_out: int) -> np.ndarray:
    """The share of each of n_in cells in each of n_out; rows sum to one."""
    scale = n_in / n_out
    reach = max(scale, 1.0)
    x = (np.arange(n_in) + 0.5 - ((np.arange(n_out) + 0.5) * scale)[:, None]) / reach
    found = np.where(np.abs(x) < LOBES, np.sinc(x) * np.sinc(x / LOBES), 0.0)
    return found / found.sum(axis=1, keepdims=True)


def fitted(width: int, height: int, most: tuple[int, int]) -> tuple[int, int]:
    """The size of the largest copy of the same shape that fits; no image grows."""
    share = min(most[0] / width, most[1] / height, 1.0)
    return max(1, round(width * share)), max(1, round(height * share))


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Rows x columns x channels of bytes at another size."""
    if image.shape[:2] == (height, width):
        return image
    rows, columns = weights(image.shape[0], height), weights(image.shape[1], width)
    found = np.stack([rows @ image[:, :, c].astype(float) @ columns.T for c in range(image.shape[2])], axis=2)
    return np.clip(np.rint(found), 0, 255).astype(np.uint8)


def png(image: np.ndarray) -> bytes:
    """An image of one (gray), three (B, G, R) or four (and A) channels as a PNG file."""
    height, width, channels = image.shape
    ordered = image if channels == 1 else image[:, :, [2, 1, 0, *range(3, channels)]]
    lines = np.concatenate((np.zeros((height, 1), dtype=np.uint8), ordered.reshape(height, -1)), axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def thumbnails(frames: DataFrame, most: tuple[int, int] = ANALYSIS_SIZE, name: str = "thumbnail") -> DataFrame:
    """frames (height, width, channels and data, as Spark's image source gives them) with a PNG that fits; null without data."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema.fields) + f", `{name}` binary"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data, *sizes in zip(*(batch.column(c).to_pylist() for c in ("data", "height", "width", "channels")), strict=True):
                if data is None:
                    found.append(None)
                    continue
                image = np.frombuffer(data, dtype=np.uint8).reshape(sizes)
                found.append(png(resized(image, *fitted(sizes[1], sizes[0], most))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, name])

    return frames.mapInArrow(made, schema)


def safe_images(frames: DataFrame, most_bytes: int = MOST_BYTES, most: tuple[int, int] = SAFE_SIZE) -> DataFrame:
    """frames (with content, the bytes of the file, and its pixels) with `image`: content, or a smaller copy where it has more than most_bytes."""
    large = F.coalesce(F.octet_length("content") > most_bytes, F.lit(False))
    return frames.where(~large).withColumn("image", F.col("content")).unionByName(thumbnails(frames.where(large), most, "image"))
