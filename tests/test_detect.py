"""Components, planted discs, and weights that each worker loads once."""

import json
import math
import os
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from rinkframe.operators import detect, raster


def flood(mask):
    """Components by a plain flood fill."""
    seen, out = np.zeros_like(mask, bool), []
    for r, c in np.argwhere(mask):
        if not seen[r, c]:
            todo, found = [(r, c)], []
            seen[r, c] = True
            while todo:
                y, x = todo.pop()
                found.append((y, x))
                for v in range(max(0, y - 1), min(mask.shape[0], y + 2)):
                    for u in range(max(0, x - 1), min(mask.shape[1], x + 2)):
                        if mask[v, u] and not seen[v, u]:
                            seen[v, u] = True
                            todo.append((v, u))
            ys, xs = zip(*found, strict=True)
            out.append((len(found), min(xs), min(ys), max(xs) + 1, max(ys) + 1))
    return out


def test_components_equal_a_flood_fill():
    pick = np.random.default_rng(2)
    for density in (0.1, 0.35, 0.5, 0.8, 1.0, 0.0):
        for _ in range(15):
            mask = pick.random((pick.integers(1, 20), pick.integers(1, 20))) < density
            assert sorted(detect.components(mask)) == sorted(flood(mask))


def sheet(*stones):
    x = np.full((600, 300, 3), 240, np.uint8)
    ys, xs = np.mgrid[:600, :300]
    for cx, cy, radius, colour in stones:
        x[(xs - cx) ** 2 + (ys - cy) ** 2 <= radius * radius] = colour
    return x


RED, YELLOW = (200, 20, 30), (240, 210, 20)


def test_planted_discs_are_found_and_placed(spark):
    rows = [("a.png", raster.png(sheet((149, 159, 9, RED), (60, 300, 9, YELLOW), (200, 40, 9, YELLOW)))), ("b.png", raster.png(sheet())), ("c.png", b"?"), ("d.png", None), ("e.png", raster.png(sheet((100, 100, 80, RED), (200, 300, 2, RED))))]
    images = spark.createDataFrame(rows, "image_name string, content binary")
    got = sorted((r.cls, r.x1, r.y1, r.x2, r.y2) for r in detect.detect(images).collect())
    assert got == [(0, 140.0, 150.0, 159.0, 169.0), (1, 51.0, 291.0, 70.0, 310.0), (1, 191.0, 31.0, 210.0, 50.0)]
    (centre,) = detect.stones(images).where("cls = 0").collect()
    assert abs(centre.x) < 0.01 and abs(centre.y - 38.405) < 0.01 and centre.inhouse == 1 and centre.distance_from_center < 0.01
    with pytest.raises(ValueError):
        detect.detect(images.withColumnRenamed("image_name", "cls"), keep=("cls",))
    assert detect.detect(images.limit(0)).collect() == []


def test_what_looks_like_no_disc_is_left_out():
    blobs = detect.Blobs(None)
    bar, ring = sheet(), sheet((150, 150, 15, RED), (150, 150, 12, (240, 240, 240)))
    bar[50:60, 20:50] = RED
    assert blobs(bar) == [] and blobs(ring) == [] and blobs(sheet((50, 50, 9, RED), (67, 50, 9, RED))) == []
    (found,) = blobs(sheet((5, 9, 9, RED)))  # cut by the edge, still found
    assert found[0] == 0 and 0 < found[1] <= 1 - abs(found[1] - 1) and math.isclose(found[2], 0)


class Counting:
    """A detector that leaves a mark for each time that a worker makes it."""

    def __init__(self, weights):
        self.of = json.load(open(weights))
        with open(f"{self.of['folder']}/{os.getpid()}", "a") as f:
            f.write("x")

    def __call__(self, picture):
        return [(1, 1.0, self.of["step"], 0.0, float(picture.shape[1]), 1.0)] * (picture.shape[0] % 3)


def test_weights_are_shipped_and_loaded_once_in_a_worker(spark, tmp_path):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
    os.makedirs(f"{tmp_path}/loads")
    with open(f"{tmp_path}/weights.json", "w") as f:
        json.dump({"step": 0.25, "folder": f"{tmp_path}/loads"}, f)
    rows = [(f"{k}", raster.png(np.zeros((k % 5 + 1, 4, 3), np.uint8))) for k in range(40)]
    images = spark.createDataFrame(rows, "image_name string, content binary").repartition(12)
    for _ in range(2):
        got = detect.detect(images, make=Counting, weights=f"{tmp_path}/weights.json").collect()
        assert len(got) == sum((k % 5 + 1) % 3 for k in range(40)) and {r.x1 for r in got} == {0.25}
    marks = [open(f"{tmp_path}/loads/{x}").read() for x in os.listdir(f"{tmp_path}/loads")]
    assert marks and set(marks) == {"x"}
