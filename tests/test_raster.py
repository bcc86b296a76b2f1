"""S6, S7, A6, A7, F26, F27, F29 against plain loops."""

import random
import struct
import zlib

import numpy as np
import pytest

from rinkframe.operators import raster


def picture(h, w, n, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w, n)).astype(np.uint8)


def rgb(x):
    return x[:, :, :3] if x.shape[2] > 2 else np.repeat(x[:, :, :1], 3, 2)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4, None, "all"])
def test_round_trip_of_every_filter_and_number_of_components(n, kind):
    for h, w in ((1, 1), (7, 5), (5, 9)):
        x = picture(h, w, n)
        kinds = None if kind is None else np.arange(h) % 5 if kind == "all" else np.full(h, kind)
        assert (raster.decoded(raster.png(x, kinds)) == rgb(x)).all()


def plain_unfilter(rows, kinds, step):
    out = []
    for r, kind in zip(rows.tolist(), kinds.tolist(), strict=True):
        up, own = out[-1] if out else [0] * len(r), []
        for i, v in enumerate(r):
            a, b, c = own[i - step] if i >= step else 0, up[i], up[i - step] if i >= step else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            own.append((v + [0, a, b, (a + b) // 2, near][kind]) % 256)
        out.append(own)
    return out


def test_filters_equal_a_plain_loop():
    pick = np.random.default_rng(5)
    for h, n, step in ((6, 12, 3), (4, 7, 1), (9, 8, 4), (3, 5, 2)):
        rows, kinds = pick.integers(0, 256, (h, n)).astype(np.uint8), pick.integers(0, 5, h)
        assert raster.unfiltered(rows, kinds, step).tolist() == plain_unfilter(rows, kinds, step)


def file(head, rows, palette=b""):
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return raster.SIGNATURE + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(rows)[:5]) + chunk(b"IDAT", zlib.compress(rows)[5:]) + chunk(b"IEND", b"")


def test_palettes_bits_and_bad_files():
    two = file(struct.pack(">IIBBBBB", 3, 1, 2, 3, 0, 0, 0), bytes([0, 0b00011000]), bytes([1, 2, 3, 4, 5, 6, 7, 8, 9]))
    assert raster.decoded(two).tolist() == [[[1, 2, 3], [4, 5, 6], [7, 8, 9]]]
    assert raster.decoded(file(struct.pack(">IIBBBBB", 4, 1, 1, 0, 0, 0, 0), bytes([0, 0b10100000])))[0, :, 0].tolist() == [255, 0, 255, 0]
    assert raster.decoded(file(struct.pack(">IIBBBBB", 2, 1, 16, 0, 0, 0, 0), bytes([0, 7, 99, 8, 1])))[0, :, 0].tolist() == [7, 8]
    good = raster.png(picture(4, 4, 3))
    bad = [None, b"", b"GIF", good[:-20], good[:40] + b"\0" + good[41:], file(struct.pack(">IIBBBBB", 3, 1, 8, 0, 0, 0, 1), bytes(4)), file(struct.pack(">IIBBBBB", 3, 9, 8, 0, 0, 0, 0), bytes(4)), file(struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0), bytes([9, 1])), file(struct.pack(">IIBBBBB", 1, 1, 8, 3, 0, 0, 0), bytes([0, 1]))]
    assert all(raster.decoded(x) is None for x in bad)


def test_inversion_turning_and_masks():
    x = np.full((60, 40, 3), 9, np.uint8)
    x[0, 0], x[0, 1] = 0, 255
    assert (raster.inverted(x) == x).all()  # as many black as white pixels
    x[0, 2] = 0
    assert raster.inverted(x)[0, 0].tolist() == [255] * 3 and raster.inverted(x)[1, 1].tolist() == [246] * 3
    assert (raster.upright(x) == x).all()
    x[20, 1:-1] = 0
    assert (raster.upright(x) == x[::-1, ::-1]).all()
    m = raster.masked(x)
    want = x.copy()
    for r in range(60):
        for c in range(40):
            if (r < 20 or r >= 41) and 1 <= c < 38:
                want[r, c] = 255
    assert (m == want).all()


def test_resizing_equals_a_plain_loop():
    for (h, w), (to_h, to_w) in (((7, 9), (13, 5)), ((20, 10), (6, 30)), ((1, 1), (3, 2)), ((8, 8), (8, 8))):
        x = picture(h, w, 3, h)
        got = raster.resized(x, to_w, to_h)
        for r in range(to_h):
            for c in range(to_w):
                py, px = (min(max((i + 0.5) * n / to - 0.5, 0), n - 1) for i, n, to in ((r, h, to_h), (c, w, to_w)))
                y, z = int(py), int(px)
                fy, fx = int((py - y) * 2048 + 0.5), int((px - z) * 2048 + 0.5)
                y1, z1 = min(y + 1, h - 1), min(z + 1, w - 1)
                v = [(int(x[y, z, k]) * (2048 - fy) + int(x[y1, z, k]) * fy) * (2048 - fx) + (int(x[y, z1, k]) * (2048 - fy) + int(x[y1, z1, k]) * fy) * fx for k in range(3)]
                assert got[r, c].tolist() == [(k + 2048 * 1024) // (2048 * 2048) for k in v]
    assert (raster.resized(picture(8, 8, 3), 8, 8) == picture(8, 8, 3)).all()


def test_crops_of_pages_by_recovered_boxes(spark):
    page = picture(120, 90, 3)
    pages = spark.createDataFrame([("d", 1, raster.png(page)), ("d", 2, b"no picture"), ("e", 1, raster.png(page))], "doc_id string, page_no int, content binary")
    boxes = [("d", 1, 5.0, 1.0, 10, 20, 40, 80), ("d", 1, 1.0, 9.0, -5, 100, 30, 500), ("d", 1, 2.0, 9.0, 95, 0, 99, 10), ("d", 2, 1.0, 1.0, 0, 0, 9, 9), ("f", 1, 1.0, 1.0, 0, 0, 9, 9)]
    got = raster.crops(pages, spark.createDataFrame(boxes, "doc_id string, page_no int, x0 double, y0 double, px0 int, py0 int, px1 int, py1 int")).collect()
    of = {(r.doc_id, r.page_no, r.x0): r for r in got}
    assert len(got) == 4 and (of["d", 1, 5.0].width, of["d", 1, 5.0].height) == (300, 600)
    assert bytes(of["d", 1, 5.0].pixels) == raster.resized(page[20:80, 10:40]).tobytes() and bytes(of["d", 1, 1.0].pixels) == raster.resized(page[100:, :30]).tobytes()
    assert of["d", 1, 2.0].pixels is None and of["d", 2, 1.0].pixels is None


def test_decoding_frames(spark):
    pick = random.Random(3)
    rows = [(f"i{k}", raster.png(picture(pick.randrange(1, 60), pick.randrange(4, 50), 3, k)), k) for k in range(40)] + [("bad", b"x", 1), ("none", None, None)]
    got = {r.name: r for r in raster.decode(spark.createDataFrame(rows, "name string, content binary, k int"), prepare=(raster.inverted, raster.upright, raster.masked)).collect()}
    for name, data, _ in rows[:40]:
        x = raster.masked(raster.upright(raster.inverted(raster.decoded(data))))
        assert bytes(got[name].pixels) == x.tobytes() and (got[name].height, got[name].width) == x.shape[:2]
    assert got["bad"].pixels is None and got["none"].width is None
    with pytest.raises(ValueError):
        raster.decode(spark.createDataFrame([(b"x", 1)], "content binary, width int"))
    assert raster.decode(spark.createDataFrame([], "content binary")).collect() == []
