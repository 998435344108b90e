"""Pixel features of frames, as Arrow UDFs over raw image bytes (as Spark's image source gives them)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGIONS = "top_mean double, bottom_mean double, keys_row_std double, keys_mean double, tab_std double, tab_rows int, content_std double"
FEATURES = f"full_hash long, content_hash long, left_hash long, right_hash long, edge_hash long, mean double, std double, {REGIONS}, splits array<struct<left:bigint,right:bigint>>, thumb array<double>"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<struct<left:bigint,right:bigint>>": pa.list_(pa.struct([("left", pa.int64()), ("right", pa.int64())]))}


def gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Luminance of rows of B, G, R (and A) bytes, or of gray bytes."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).astype(float)
    return pixels[:, :, 0] if channels < 3 else pixels[:, :, :3] @ np.array([0.114, 0.587, 0.299])


def shrink(image: np.ndarray, size: int) -> np.ndarray:
    """Means over size x size cells."""
    rows = np.linspace(0, image.shape[0], size + 1)
    cols = np.linspace(0, image.shape[1], size + 1)
    sums = np.pad(image.cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    def at(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        lo_r, lo_c = np.minimum(r.astype(int), image.shape[0] - 1), np.minimum(c.astype(int), image.shape[1] - 1)
        fr, fc = (r - lo_r)[:, None], (c - lo_c)[None, :]
        a, b = sums[np.ix_(lo_r, lo_c)], sums[np.ix_(lo_r, lo_c + 1)]
        d, e = sums[np.ix_(lo_r + 1, lo_c)], sums[np.ix_(lo_r + 1, lo_c + 1)]
        return a * (1 - fr) * (1 - fc) + b * (1 - fr) * fc + d * fr * (1 - fc) + e * fr * fc

    cells = at(rows[1:], cols[1:]) - at(rows[:-1], cols[1:]) - at(rows[1:], cols[:-1]) + at(rows[:-1], cols[:-1])
    return cells / ((rows[1] - rows[0]) * (cols[1] - cols[0]))


_COSINES = np.cos(np.pi * np.arange(8)[:, None] * (2 * np.arange(32)[None, :] + 1) / 64)


def perceptual_hash(image: np.ndarray) -> int:
    """64 bits: which of the 8 x 8 lowest cosine coefficients of the 32 x 32 image are above their median."""
    low = _COSINES @ shrink(image, 32) @ _COSINES.T
    bits = (low > np.median(low)).ravel()
    return int(np.packbits(bits).view(">i8")[0])


def features_of(image: np.ndarray) -> dict:
    """Hashes of the whole, of what is below the status bar, of the halves and of the left strip; mean, spread and a 64 x 64 copy."""
    height, width = image.shape
    bar = min(max(60, int(height * 0.08)), height - 1)
    strip = min(max(20, int(width * 0.06)), width)
    parts = {"full_hash": image, "content_hash": image[bar:], "left_hash": image[:, : max(1, width // 2)], "right_hash": image[:, width // 2 :], "edge_hash": image[:, :strip]}
    cuts = [max(1, x) for x in (width // 3, width // 2, 2 * width // 3)]
    splits = [{"left": perceptual_hash(image[:, :x]), "right": perceptual_hash(image[:, x:])} for x in cuts if x < width]
    return {k: perceptual_hash(v) for k, v in parts.items()} | {"mean": float(image.mean()), "std": float(image.std()), "splits": splits, "thumb": shrink(image, 64).ravel().tolist()} | regions(image)


def regions(image: np.ndarray) -> dict:
    """Brightness and spread of the bands that the pixel classifier looks at."""
    height = image.shape[0]
    band = lambda lo, hi=1.0: image[int(height * lo) : int(height * hi)]
    keys, tabs, content = band(0.55), band(0.88), band(0.10, 0.30)
    mean, std = (lambda x, f=f: float(f(x)) if x.size else None for f in (np.mean, np.std))
    rows = [np.std(r) for r in keys[::4]]
    return {"top_mean": mean(band(0, 0.30)), "bottom_mean": mean(band(0.40)), "keys_row_std": mean(np.array(rows)), "keys_mean": mean(keys), "tab_std": std(tabs), "tab_rows": len(tabs), "content_std": std(content)}


def local_class(frames: DataFrame) -> DataFrame:
    """Adds label, screen_type, conf, components and state from the pixels alone, by the first rule that holds."""
    dark, flat = F.col("mean") < 20, F.col("std") < 35
    sheet = (F.col("bottom_mean") > 210) & (F.col("top_mean") < 90)
    known = dark | flat | F.coalesce(sheet, F.lit(False))
    tabs = F.coalesce((F.col("tab_rows") > 10) & (F.col("tab_std") > 18), F.lit(False))
    busy = F.coalesce(F.col("content_std") > 40, F.lit(False))
    label = F.when(dark, "unsorted").when(flat, "loading").when(sheet, "bottom_sheet/sheet").when(tabs, "home").when(busy, "onboarding").otherwise("home")
    conf = F.when(dark, 0.1).when(flat, 0.55).when(sheet, 0.5).when(tabs, 0.4).when(busy, 0.3).otherwise(0.25)
    parts = F.array_compact(F.array(F.when(tabs, "bottom_tab_bar"), F.when(F.col("mean") < 100, "dark_bg")))
    components = F.when(dark | flat, F.array().cast("array<string>")).when(sheet, F.array(F.lit("sheet_handle"), F.lit("sheet_overlay"))).otherwise(parts)
    keyboard = ~known & (F.col("keys_row_std") < 22) & (F.col("keys_mean") > 175)
    return frames.withColumns({"label": label, "screen_type": F.split(label, "/")[0], "conf": conf, "components": components, "state": F.when(keyboard, "keyboard_open").otherwise("")})


def features(frames: DataFrame) -> DataFrame:
    """Adds FEATURES to frames with height, width, channels and data; each image is decoded once."""
    kept = [f for f in frames.schema.fields if f.name != "data"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " + FEATURES
    kinds = {name: _KINDS[kind] for name, kind in (f.split(" ", 1) for f in FEATURES.split(", "))}
    names = list(kinds)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(c).to_pylist() for c in ("height", "width", "channels")]
            rows = [features_of(gray(d.as_py(), h, w, c)) for d, h, w, c in zip(batch.column("data"), *sizes, strict=True)]
            columns = [pa.array([r[n] for r in rows], kinds[n]) for n in names]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *columns], [*[f.name for f in kept], *names])

    return frames.mapInArrow(found, schema)


def fade_error(this: Column, before: Column, after: Column) -> Column:
    """The least mean error (0 to 1) of a frame against three blends of the frames around it."""
    def error(share: float) -> Column:
        blend = F.zip_with(before, after, lambda p, n: p * share + n * (1 - share))
        return F.aggregate(F.zip_with(this, blend, lambda t, b: F.abs(t - b)), F.lit(0.0), lambda a, x: a + x) / F.size(this) / 255

    return F.least(*[error(share) for share in (0.3, 0.5, 0.7)])
