import struct
import zlib

import numpy as np
import pytest

from tessera.sources import images


def tiff(pages, order="<", compression=1):
    """An uncompressed grey TIFF file with one strip a row."""
    out = {"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}HI", 42, 8)
    for i, a in enumerate(pages):
        h, w = a.shape
        row = w * a.itemsize
        size = 2 + 12 * 6 + 4
        lists = len(out) + size
        pixels = lists + 8 * h
        offsets, counts = [pixels + row * k for k in range(h)], [row] * h
        where = (lambda values, at: values[0] if h == 1 else at)  # a single value stands in the entry itself
        entries = [(256, 3, 1, w), (257, 4, 1, h), (258, 3, 1, 8 * a.itemsize), (259, 3, 1, compression), (273, 4, h, where(offsets, lists)), (279, 4, h, where(counts, lists + 4 * h))]
        out += struct.pack(f"{order}H", len(entries))
        for tag, kind, n, v in entries:
            out += struct.pack(f"{order}HHI", tag, kind, n) + (struct.pack(f"{order}HH", v, 0) if kind == 3 else struct.pack(f"{order}I", v))
        out += struct.pack(f"{order}I", pixels + row * h if i + 1 < len(pages) else 0)
        out += struct.pack(f"{order}{2 * h}I", *offsets, *counts) + a.astype(a.dtype.newbyteorder(order)).tobytes()
    return out


def png(a):
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    h, w = a.shape[:2]
    rows = b"".join(b"\0" + a[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_pages(order):
    rng = np.random.default_rng(0)
    for pages in ([rng.integers(0, 65536, (3, 5), dtype=np.uint16)] * 2, [rng.integers(0, 256, (1, 4), dtype=np.uint8)]):
        assert all(map(np.array_equal, images.tiff_pages(tiff(pages, order)), pages))
    for bad in (tiff([np.zeros((2, 2), np.uint8)], order, 5), b"II\x2b\0\0\0\0\0", b"nothing"):
        with pytest.raises(ValueError, match="TIFF"):
            list(images.tiff_pages(bad))


def test_tiff_stack(spark, tmp_path):
    rng = np.random.default_rng(1)
    a = [rng.integers(0, 65536, (3, 4), dtype=np.uint16) for _ in range(2)]
    b, c = rng.integers(0, 256, (3, 4), dtype=np.uint8), rng.integers(0, 65536, (3, 4), dtype=np.uint16)
    for name, pages in (("00.tif", [c]), ("01.tiff", a), ("02.tiff", [b])):
        (tmp_path / name).write_bytes(tiff(pages))
    (tmp_path / "notes.txt").write_text("not a slice")
    got = np.full((4, 3, 4), -1)
    for r in images.tiff_stack(spark, str(tmp_path)).collect():
        got[r.z, r.y, r.x] = r.v
    assert np.array_equal(got, np.stack([a[0] >> 8, a[1] >> 8, b, c >> 8]) & 0xF0)
    (tmp_path / "03.tiff").write_bytes(b"broken")
    with pytest.raises(Exception, match="not a TIFF file"):
        images.tiff_stack(spark, str(tmp_path)).collect()


def test_png_channels(spark, tmp_path):
    rng = np.random.default_rng(2)
    grey, colour = rng.integers(0, 256, (3, 4), dtype=np.uint8), rng.integers(0, 256, (2, 5, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(png(grey))
    (tmp_path / "b.png").write_bytes(png(colour))
    got = {(r.name, r.part, r.y, r.x): r.v for r in images.image_files(spark, str(tmp_path)).collect()}
    want = {("a.png", 0, y, x): v for (y, x), v in np.ndenumerate(grey)} | {("b.png", c, y, x): v for (y, x, c), v in np.ndenumerate(colour)}
    assert got == want
