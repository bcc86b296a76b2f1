import pytest

from rinkframe.operators.labels import checked, description, file_problems, label_texts, write_dataset
from rinkframe.sources.pages import page_layer, page_text, pngs

BOX = "image_name string, cls int, conf double, x double, y double, w double, h double"


def test_labels_of_sure_images(spark):
    images = spark.createDataFrame([("a.png",), ("b.png",), ("c.x.png",), ("c.x.png",), ("d.png",)], "image_name string")
    boxes = [("a.png", 1, 0.75, 0.5, 0.25, 0.125, 1e-6), ("a.png", 0, 0.9, 0.5, 0.25, 0.125, 0.5), ("b.png", 0, 0.9, 0.1, 0.1, 0.1, 0.1), ("b.png", 0, 0.7499, 0.1, 0.1, 0.1, 0.1), ("d.png", 0, None, 0.1, 0.1, 0.1, 0.1), ("e.png", 0, 0.9, 0.1, 0.1, 0.1, 0.1)]
    got = {r.image_name: (r.label_name, r.n_boxes, r.label) for r in label_texts(images, spark.createDataFrame(boxes, BOX)).collect()}
    assert got == {"a.png": ("a.txt", 2, "0 0.500000 0.250000 0.1250000 0.5000000\n1 0.500000 0.250000 0.1250000 0.0000010\n"), "c.x.png": ("c.x.txt", 0, "")}
    assert label_texts(images.limit(0), spark.createDataFrame([], BOX)).count() == 0


def test_dataset_is_split_by_name_and_described(spark, tmp_path):
    images = spark.createDataFrame([(f"p{i}.png", bytes([i % 256])) for i in range(300)], "image_name string, pixels binary")
    labels = label_texts(images.where("image_name <> 'p7.png'"), spark.createDataFrame([], BOX))
    for _ in range(2):  # written again, it is the same
        write_dataset(images, labels, str(tmp_path))
        got = spark.read.parquet(f"{tmp_path}/images").groupBy("split").count().collect()
        found = {r["split"]: r["count"] for r in got}
        assert sum(found.values()) == 299 and 200 < found["train"] < 275
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/description").collect())
    assert text == description(str(tmp_path)) and text.endswith("names:\n  0: red\n  1: yellow")


def test_files_are_checked(spark):
    files = spark.createDataFrame([("a", "E"), ("b", ""), ("c", None), ("d", "E"), (None, "E")], "path string, event_name string")
    there = spark.createDataFrame([("a",), ("a",), ("b",)], "path string")
    assert {(r.path, r.reason) for r in file_problems(files, there).collect()} == {("b", "event name"), ("c", "event name"), ("d", "not found"), (None, "not found")}
    assert checked(files.where("path = 'a'"), there).count() == 1
    with pytest.raises(ValueError, match="d: not found"):
        checked(files, there)
    with pytest.raises(ValueError, match="no files"):
        checked(files.limit(0), there)


def test_sources_take_names_by_suffix(spark, tmp_path):
    for name, content in (("a.TXT", b"one\ftwo"), ("b.txt", b""), ("c.md", b"no"), ("x.png", b"\x89P"), ("y.PNG", b"")):
        (tmp_path / name).write_bytes(content)
    assert sorted((r.doc_id, r.page_no, r.text) for r in page_text(spark, str(tmp_path)).collect()) == [("a.TXT", 1, "one"), ("a.TXT", 2, "two")]
    assert sorted((r.image_name, bytes(r.content)) for r in pngs(spark, str(tmp_path)).collect()) == [("x.png", b"\x89P")]
    (tmp_path / "cells.json").write_text('{"doc_id": "a", "page_no": 1, "table_no": 2, "row_no": 1, "col_no": 3, "cell": "*", "more": 1}\n')
    assert [tuple(r) for r in page_layer(spark, f"{tmp_path}/cells.json", "page_cells").collect()] == [("a", 1, 2, 1, 3, "*")]
