"""Properties of smaller copies, on made images."""

import struct
import zlib

import numpy as np

from tidemark.functions import resize


def decoded(file):
    """Pixels of a PNG without filters, channels as in the file."""
    assert file[:8] == b"\x89PNG\r\n\x1a\n"
    at, parts = 8, {}
    while at < len(file):
        size, kind = struct.unpack(">I4s", file[at : at + 8])
        body = file[at + 8 : at + 8 + size]
        assert struct.unpack(">I", file[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + body)
        parts[kind], at = body, at + 12 + size
    width, height, depth, color = struct.unpack(">IIBB", parts[b"IHDR"][:10])
    channels = {0: 1, 2: 3, 6: 4}[color]
    lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), dtype=np.uint8).reshape(height, 1 + width * channels)
    assert depth == 8 and not lines[:, 0].any()
    return lines[:, 1:].reshape(height, width, channels)


def test_weights_and_sizes():
    for n_in, n_out in ((10, 10), (100, 7), (7, 100), (1, 5), (5, 1)):
        assert np.allclose(resize.weights(n_in, n_out).sum(axis=1), 1)
    assert np.allclose(resize.weights(9, 9), np.eye(9))
    assert resize.fitted(100, 50, (768, 1664)) == (100, 50)
    assert resize.fitted(1536, 1664, (768, 1664)) == (768, 832) and resize.fitted(10_000, 1, (768, 1664)) == (768, 1)


def test_copies_keep_what_is_even():
    rng = np.random.default_rng(1)
    flat = np.full((60, 40, 3), 77, dtype=np.uint8)
    assert (resize.resized(flat, 13, 29) == 77).all()
    ramp = np.tile(np.linspace(0, 255, 400).astype(np.uint8)[None, :, None], (50, 1, 1))
    small = resize.resized(ramp, 100, 25)[:, :, 0].astype(int)
    assert (np.diff(small, axis=1) >= 0).all() and np.abs(small - small[0]).max() <= 1 and abs(small.mean() - ramp.mean()) < 1
    noise = rng.integers(0, 256, (64, 64, 1), dtype=np.uint8)
    assert resize.resized(noise, 8, 8).std() < noise.std() / 3
    assert (resize.resized(noise, 64, 64) == noise).all()


def test_png_round_trip():
    rng = np.random.default_rng(2)
    for channels in (1, 3, 4):
        image = rng.integers(0, 256, (11, 7, channels), dtype=np.uint8)
        back = decoded(resize.png(image))
        assert (back == (image if channels == 1 else image[:, :, [2, 1, 0, *range(3, channels)]])).all()


def test_only_large_images_are_decoded(spark):
    image = np.zeros((40, 20, 3), dtype=np.uint8)
    # The small one has no pixels at all: it would fail if they were looked at.
    rows = [(1, bytearray(b"small file"), 40, 20, 3, bytearray(b"none")), (2, bytearray(b"x" * 100), 40, 20, 3, bytearray(image.tobytes())), (3, None, 40, 20, 3, None)]
    frames = spark.createDataFrame(rows, "idx long, content binary, height int, width int, channels int, data binary")
    found = {r.idx: r.image for r in resize.safe_images(frames, 50, (10, 30)).collect()}
    assert found[1] == b"small file" and found[3] is None and decoded(bytes(found[2])).shape == (20, 10, 3)
    shown = {r.idx: r.thumbnail for r in resize.thumbnails(frames.where("idx > 1")).collect()}
    assert decoded(bytes(shown[2])).shape == (40, 20, 3) and shown[3] is None
