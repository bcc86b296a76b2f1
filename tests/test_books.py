import random

from pyspark.sql import functions as F

from rinkframe.operators.books import dense_ids, parse_records, shots
from rinkframe.operators.pixels import suppress
from rinkframe.sources.pages import page_lines, page_text, publish


def scan(tokens):
    out, i = [], 0
    while i < len(tokens) - 2:
        if tokens[i + 1 : i + 4] == ["s", "t", "p"]:
            out.append((i, 4))
            i += 4
        elif tokens[i + 1 : i + 3] == ["s", "p"]:
            out.append((i, 3))
            i += 3
        else:
            i += 1
    return out


def test_records_equal_a_scan(spark):
    pick = random.Random(11)
    docs = [[pick.choice("sstppx") for _ in range(pick.randrange(60))] for _ in range(80)]
    df = spark.createDataFrame([(d, i, t) for d, doc in enumerate(docs) for i, t in enumerate(doc)], "d int, i int, t string")
    got = sorted((r.d, r.i, r.length) for r in parse_records(df, ["d"], ["i"], F.col("t") == "s", F.col("t") == "t", F.col("t") == "p").collect())
    assert got == [(d, i, n) for d, doc in enumerate(docs) for i, n in scan(doc)]


def test_shots_from_page_files(spark, tmp_path):
    (tmp_path / "A.TXT").write_text("Draw\n75%\n↻\nCAN: A ONE\nTake-out\n-\nSUI: B TWO\n\fnoise\nGuard\n100%\n↺\nNOR: C THREE", encoding="utf-8")
    (tmp_path / "b.bin").write_text("Draw\n75%\n↻\nCAN: A ONE")
    lines = page_lines(page_text(spark, str(tmp_path)))
    got = [tuple(r)[3:8] for r in shots(lines, ["doc_id", "page_no"], "line_no", "line").orderBy("page_no", "line_no").collect()]
    assert got == [("Draw", 75, "cw", "CAN", "A ONE"), ("Take-out", None, None, "SUI", "B TWO"), ("Guard", 100, "ccw", "NOR", "C THREE")]


def test_publishing_again_replaces_one_event(spark, tmp_path):
    folder = str(tmp_path / "shots")
    publish(spark.createDataFrame([("a", 1), ("b", 2)], "event string, n int"), folder, "event")
    publish(spark.createDataFrame([("b", 3)], "event string, n int"), folder, "event")
    assert sorted((r.event, r.n) for r in spark.read.parquet(folder).collect()) == [("a", 1), ("b", 3)]


def test_dense_ids_have_no_gaps(spark):
    keys = random.Random(2).sample(range(1000), 200)
    got = dense_ids(spark.createDataFrame([(k,) for k in keys], "k long"), "k", 64, F.lit(10)).collect()
    assert {r.k: r.id for r in got} == {k: 11 + i for i, k in enumerate(sorted(keys))}


def test_suppression_keeps_the_surest_of_overlapping_boxes(spark):
    rows = [("i", 0.9, 0.0, 0.0, 10.0, 10.0), ("i", 0.8, 1.0, 1.0, 11.0, 11.0), ("i", 0.7, 20.0, 0.0, 30.0, 10.0), ("i", 0.4, 50.0, 50.0, 60.0, 60.0), ("j", 0.6, 1.0, 1.0, 11.0, 11.0)]
    df = spark.createDataFrame(rows, "image string, conf double, x1 double, y1 double, x2 double, y2 double")
    assert sorted((r.image, r.conf) for r in suppress(df, "image").collect()) == [("i", 0.7), ("i", 0.9), ("j", 0.6)]
