"""Bundles read by ranges, pruned by where, cut and empty files; and the writer's commit and abort."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from rinkframe import schemas
from rinkframe.sources import bundles


def book(path, entries):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data if isinstance(data, (str, bytes)) else json.dumps(data))


def text_rows(spark, books=3, pages=20):
    rows = [(f"b{b}", p, f"page {p} of {b} " + "é x" * 200 + str(p * 7919)) for b in range(books) for p in range(1, pages + 1)]
    return spark.createDataFrame(rows, schemas.LAYERS["page_text"]), rows


def test_a_file_is_read_in_ranges_and_equals_what_was_written(spark, tmp_path):
    df, rows = text_rows(spark)
    bundles.write_books(df, f"{tmp_path}/in")
    assert sorted(os.listdir(f"{tmp_path}/in")) == ["b0.zip", "b1.zip", "b2.zip"]
    for size in ("500", "1000000"):
        got = bundles.read_books(spark, f"{tmp_path}/in", bytes=size)
        assert sorted(map(tuple, got.collect())) == rows and (got.rdd.getNumPartitions() > 6) == (size == "500")
    one = bundles.read_books(spark, f"file:{tmp_path}/in/b1.zip", bytes="900")
    assert sorted(map(tuple, one.collect())) == [r for r in rows if r[0] == "b1"] and one.rdd.getNumPartitions() > 1


def test_where_prunes_files_and_pages_and_frames_stay_apart(spark, tmp_path):
    df, rows = text_rows(spark)
    bundles.write_books(df, f"{tmp_path}/in")
    with open(f"{tmp_path}/in/b0.zip", "r+b") as f:
        f.truncate(100)  # no pruned read opens it
    some = bundles.read_books(spark, f"{tmp_path}/in", where=(F.col("doc_id") == "b2") & F.col("page_no").between(3, 5), bytes="500")
    plan = some._sc._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    assert "EqualTo(doc_id,b2)" in plan and "GreaterThanOrEqual(page_no,3)" in plan
    want = [r for r in rows if r[0] == "b2" and 3 <= r[1] <= 5]
    both = some.where("page_no = 3").unionByName(some.where("page_no = 4"))
    assert [r.page_no for r in both.collect()] == [3, 4] and sorted(map(tuple, some.collect())) == want
    late = bundles.read_books(spark, f"{tmp_path}/in", where=F.col("doc_id").isin("b1", "b2") & (F.col("page_no") > 18) & F.col("text").contains("é"))
    assert sorted(map(tuple, late.collect())) == [r for r in rows if r[0] != "b0" and r[1] > 18]
    assert bundles.read_books(spark, f"{tmp_path}/in", where=F.col("doc_id").startswith("b1")).count() == 20
    assert bundles.read_books(spark, f"{tmp_path}/in", where=F.col("doc_id") == "zz").count() == 0


def test_cells_and_images(spark, tmp_path):
    cells = [{"table_no": 0, "row_no": 0, "col_no": 1, "cell": "*", "other": 1}, {"table_no": 0, "cell": None}]
    images = [{"xref": 7, "width": 300, "height": 600, "x0": 1.5, "y0": 2.0, "x1": 3.0, "y1": 4.0}, {"xref": 8}]
    book(f"{tmp_path}/A.ZIP", {"0001.txt": "a", "0001.cells.json": cells, "0003.images.json": images, "0003.7.png": b"\x89PNG", "notes.md": "x"})
    read = lambda layer, **o: sorted(map(tuple, bundles.read_books(spark, str(tmp_path), layer, **o).collect()), key=str)
    assert read("page_cells") == [("A", 1, 0, 0, 1, "*"), ("A", 1, 0, None, None, None)]
    assert read("page_images") == [("A", 3, 7, 300, 600, 1.5, 2.0, 3.0, 4.0, b"\x89PNG"), ("A", 3, 8, None, None, None, None, None, None, None)]
    assert [r[-1] for r in read("page_images", pixels="false")] == [None, None] and read("page_problems") == []
    layers = {"page_cells": read("page_cells"), "page_images": read("page_images")}
    for layer, rows in layers.items():
        bundles.write_books(spark.createDataFrame(rows, schemas.LAYERS[layer]), f"{tmp_path}/{layer}", layer)
        assert sorted(map(tuple, bundles.read_books(spark, f"{tmp_path}/{layer}", layer).collect()), key=str) == rows


def test_cut_damaged_and_empty_files(spark, tmp_path):
    book(f"{tmp_path}/good.zip", {"0001.txt": "fine", "0002.txt": b"\xff\xfe", "0003.cells.json": "{}", "0004.txt": "x" * 50})
    book(f"{tmp_path}/none.zip", {})
    data = open(f"{tmp_path}/good.zip", "rb").read()
    open(f"{tmp_path}/cut.zip", "wb").write(data[: len(data) // 2])
    open(f"{tmp_path}/zero.zip", "wb").close()
    open(f"{tmp_path}/bad.zip", "wb").write(data.replace(b"x" * 50, b"y" * 50))  # the checksum no longer fits
    skip = lambda layer: sorted(map(tuple, bundles.read_books(spark, str(tmp_path), layer, damaged="skip", bytes="60").collect()), key=str)
    assert skip("page_text") == [("bad", 1, "fine"), ("good", 1, "fine"), ("good", 4, "x" * 50)]
    assert {(d, p) for d, p, _ in skip("page_problems")} == {("cut", None), ("zero", None), ("good", 2), ("good", 3), ("bad", 2), ("bad", 3), ("bad", 4)}
    with pytest.raises(Exception, match="damaged|zip"):
        bundles.read_books(spark, str(tmp_path)).collect()
    os.makedirs(f"{tmp_path}/empty")
    assert bundles.read_books(spark, f"{tmp_path}/empty").count() == 0


def test_a_failed_or_scattered_write_leaves_no_bundle(spark, tmp_path):
    df, _ = text_rows(spark)
    os.makedirs(f"{tmp_path}/out")
    bad = df.withColumn("text", F.when(F.col("doc_id") == "b2", F.raise_error(F.lit("no page")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception):
        bundles.write_books(bad, f"{tmp_path}/out")
    assert os.listdir(f"{tmp_path}/out") == []
    bundles.register(spark)
    with pytest.raises(Exception, match="two tasks"):
        df.repartition(4).write.format(bundles.NAME).option("path", f"{tmp_path}/out").mode("append").save()
    assert os.listdir(f"{tmp_path}/out") == []
    bundles.write_books(df, f"{tmp_path}/out")
    bundles.write_books(df.where("doc_id = 'b1' and page_no < 3").unionByName(df.limit(1).selectExpr("'n' as doc_id", "1 as page_no", "cast(null as string) as text")), f"{tmp_path}/out", mode="overwrite")
    assert sorted(os.listdir(f"{tmp_path}/out")) == ["b1.zip", "n.zip"] and bundles.read_books(spark, f"{tmp_path}/out").count() == 2


def test_small_ranges_of_a_large_folder_share_tasks():
    files = [(f"/b/{k:05d}.zip", 30_000) for k in range(20_000)]
    parts = bundles.ranges(files, 16_384)
    assert len(parts) <= 2 * bundles.TASKS and sum(len(p.pieces) for p in parts) < 1.1 * len(files)
    for path, total in files[::777]:  # every byte of a file lies in one piece
        own = sorted((a, b) for p in parts for name, a, b in p.pieces if name == path)
        assert own[0][0] == 0 and own[-1][1] == total + 1 and all(x[1] == y[0] for x, y in zip(own, own[1:]))
    assert len(bundles.ranges(files[:2], 16_384)) == 4
    assert max(b - a for p in bundles.ranges([("/b/x.zip", 1 << 42)], 16_384) for _, a, b in p.pieces) <= bundles.RANGE_BYTES + 1
