"""Plans: how many shuffles the per-page operators take."""

import re

from rinkframe import schemas
from rinkframe.operators import scores, slots
from rinkframe.operators.sequences import possession


def shuffles(df):
    return len(re.findall(r"\bExchange ", df._jdf.queryExecution().executedPlan().toString()))


def empty(spark, tmp_path, layer):
    spark.createDataFrame([], schemas.LAYERS[layer]).write.mode("overwrite").parquet(f"{tmp_path}/{layer}")
    return spark.read.parquet(f"{tmp_path}/{layer}")


def test_ends_take_one_shuffle_by_page(spark, tmp_path):
    cells = empty(spark, tmp_path, "page_cells")
    mixed = spark.createDataFrame([("d", True)], "doc_id string, is_mixed boolean").hint("broadcast")
    long = scores.long_scores(scores.pick_table(cells))
    assert shuffles(scores.ends(long, None, mixed)) == 1 and shuffles(scores.score_lines(long)) == 1


def test_missing_slots_take_one_shuffle_by_page(spark, tmp_path):
    assert shuffles(slots.missing_slots(empty(spark, tmp_path, "page_images"))) == 1


def test_possession_with_its_mode_as_a_column(spark):
    rows = [(g, i, a, b, 0, g > 1) for g in (1, 2) for i, (a, b) in enumerate([("0", "0"), ("0", "0"), ("1", "0"), ("0", "0"), ("0", "2")], 1)]
    df = spark.createDataFrame(rows, "g int, i int, a string, b string, start int, mixed boolean")
    both = {(r.g, r.i): r.hammer for r in possession(df, ["g"], ["i"], "a", "b", "start", df["mixed"]).collect()}
    for mode in (False, True):
        assert all(both[r.g, r.i] == r.hammer for r in possession(df.where(df["mixed"] == mode), ["g"], ["i"], "a", "b", "start", mode).collect())
    assert [both[1, i] for i in range(1, 6)] == [0, 0, 0, 1, 1] and [both[2, i] for i in range(1, 6)] == [0, 1, 0, 1, 0]
