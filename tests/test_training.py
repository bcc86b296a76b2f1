"""Files of the detector's data set, page tensors, line ends."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rinkframe import schemas
from rinkframe.operators import raster, scores, tensor
from rinkframe.sources import training
from rinkframe.sources.pages import page_lines


def picture(k):
    return np.random.default_rng(k).integers(0, 256, (60, 40, 3)).astype(np.uint8)


def files(root):
    return sorted(os.path.relpath(f"{d}/{n}", root) for d, _, names in os.walk(root) for n in names)


def test_the_budget_decides_pages_and_files_are_masked(spark, tmp_path):
    pages = spark.createDataFrame([("b", p, "Shot by Shot" if p != 2 else "Game Results") for p in range(1, 6)] + [("c", 1, "Shot by Shot"), ("d", 1, None)], schemas.LAYERS["page_text"])
    rows = [("b", p, 10 - i, 40, 60, 0.0, 0.0, 1.0, 1.0, raster.png(picture(10 * p + i))) for p in range(1, 6) for i in range(2)] + [("c", 1, 1, 40, 60, 0.0, 0.0, 1.0, 1.0, b"broken")]
    images = spark.createDataFrame(rows, schemas.LAYERS["page_images"])
    taken = training.harvest(pages, images, budget=3)
    assert sorted((r.doc_id, r.image_name, r.xref) for r in taken.collect()) == [("b", "page1_1.png", 9), ("b", "page1_2.png", 10), ("b", "page3_1.png", 9), ("b", "page3_2.png", 10), ("c", "page1_1.png", 1)]
    made = training.prepared(taken)
    label = F.when(F.col("image_name") == "page1_2.png", F.lit(None)).when(F.col("page_no") == 1, F.lit("")).otherwise(F.lit("0 0.5 0.5 0.1 0.1\n"))
    counts = training.write_files(made.withColumn("label", label), f"{tmp_path}/set")
    assert counts == {"images": 3, "labels": 3}
    found = files(f"{tmp_path}/set")
    names = {n.rsplit("/", 1)[-1].rsplit(".", 1)[0] for n in found if not n.endswith("yaml")}
    assert names == {"page1_1", "page3_1", "page3_2"} and len(found) == 7 and "b/dataset.yaml" in found
    for n in found:
        if n.endswith(".png"):
            p, i = map(int, n.rsplit("page", 1)[1][:-4].split("_"))
            want = raster.masked(raster.inverted(picture(10 * p + 2 - i)))
            assert (raster.decoded(open(f"{tmp_path}/set/{n}", "rb").read()) == want).all()
            text = open(f"{tmp_path}/set/{n}".replace("/images/", "/labels/").replace(".png", ".txt")).read()
            assert text == ("" if p == 1 else "0 0.5 0.5 0.1 0.1\n")
    again = training.write_files(made.withColumn("label", label), f"{tmp_path}/set")
    assert again == counts and files(f"{tmp_path}/set") == found
    assert f"path: {tmp_path}/set/b" in open(f"{tmp_path}/set/b/dataset.yaml").read() and "images/train" in open(f"{tmp_path}/set/b/dataset.yaml").read()


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    rows = spark.createDataFrame([("b", f"page{k}_1.png", b"x", "") for k in range(20)], "doc_id string, image_name string, content binary, label string").repartition(5)
    bad = rows.withColumn("label", F.when(F.col("image_name") == "page9_1.png", F.raise_error(F.lit("no label")).cast("string")).otherwise(F.col("label")))
    with pytest.raises(Exception):
        training.write_files(bad, f"{tmp_path}/set")
    assert files(f"{tmp_path}/set") == []
    assert training.write_files(rows.where("doc_id is null"), f"{tmp_path}/set") == {"images": 0, "labels": 0} and files(f"{tmp_path}/set") == []
    assert training.write_files(rows, f"{tmp_path}/set") == {"images": 20, "labels": 20} and len(files(f"{tmp_path}/set")) == 41


STONES = "doc_id string, page_no int, shot_no int, stone_no int, cls int, x double, y double, dist double, in_house int, in_sheet int"


def test_tensors_keep_order_through_a_shuffle_and_come_back(spark):
    pick = random.Random(1)
    rows = [("d", p, s, k, k % 2, pick.random(), pick.random(), 0.0, 1, 1) for p in range(4) for s in range(1, 9) for k in range(1, pick.choice([1, 2, 30]))]
    shots = [("d", p, s) for p in range(5) for s in range(1, p + 6)] + [("e", 1, 2)]
    mixed = rows + [("d", 0, None, 1, 0, 0.0, 0.0, 0.0, 1, 1)]
    pick.shuffle(mixed)
    got = tensor.tensors(spark.createDataFrame(shots, "doc_id string, page_no int, shot_no int"), spark.createDataFrame(mixed, STONES).repartition(7), ["doc_id", "page_no"])
    of = {(r.doc_id, r.page_no): r for r in got.collect()}
    assert set(of) == {("d", p) for p in range(5)} | {("e", 1)}
    for p in range(5):
        t = of["d", p].tensor
        assert len(t) == of["d", p].n_shots == max([p + 5, *(r[2] for r in rows if r[1] == p)])
        assert [[tuple(v) for v in s] for s in t] == [[r[4:] for r in rows if r[1] == p and r[2] == s] for s in range(1, len(t) + 1)]
    assert of["e", 1].tensor == [[], []]
    back = sorted(((*r[:3], *r[4:]) for r in tensor.stones_of(got, ["doc_id", "page_no"]).where("stone_no is not null").collect()), key=str)
    assert back == sorted(((*r[:3], *r[4:]) for r in rows), key=str)
    empty = tensor.tensors(spark.createDataFrame([("z", 1, None)], "doc_id string, page_no int, shot_no int"), spark.createDataFrame([], STONES), ["doc_id", "page_no"]).collect()
    assert [(r.n_shots, r.tensor) for r in empty] == [(0, [])]


def test_lines_end_where_text_says(spark):
    texts = ["a\rb\r\nc\x0bd\x0ce\x1cf\x85g h ", "", "\n", "a\n\nb", None, "x\r\n", "\n\r"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], schemas.LAYERS["page_text"])
    got = {}
    for r in page_lines(df).orderBy("page_no", "line_no").collect():
        got.setdefault(r.page_no, []).append(r.line)
    assert got == {i: t.splitlines() for i, t in enumerate(texts) if t}
    pages = spark.createDataFrame([("d", 1, "Power Play: End 3\rpower play: end 5 x")], schemas.LAYERS["page_text"])
    assert sorted(r.end_no for r in scores.power_plays(pages).collect()) == [3, 5]
