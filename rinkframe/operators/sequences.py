"""Sequential folds over ordered rows as windows: pages, possession, budgets, ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from rinkframe.session import table


def page_sequence(pages: DataFrame, doc: str, order: list[str], is_game, is_detail) -> DataFrame:
    """game_seq counts header pages, end_no the detail pages since the last header; pages before any header go."""
    upto = W.partitionBy(doc).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    seq = pages.withColumn("game_seq", F.sum(is_game.cast("int")).over(upto)).where("game_seq > 0")
    within = W.partitionBy(doc, "game_seq").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return seq.withColumn("end_no", F.sum(is_detail.cast("int")).over(within))


def possession(rounds: DataFrame, by: list[str], order: list[str], a: str, b: str, start: str, alternate: bool | Column = False) -> DataFrame:
    """The side that has the last stone. The scorer's opponent gets it next; a blank (equal digits) keeps it, or passes it on if `alternate` (for all, or by a column that is constant in a group).

    F15: after a round whose scores aren't both digits nobody is known to have it, so the rounds after the first such go; so do groups without a start.
    """
    before = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    digits = lambda c: F.coalesce(F.col(c).cast("string").rlike(r"^[0-9]+\z"), F.lit(False))
    unread = F.sum((~(digits(a) & digits(b))).cast("int")).over(before)
    rounds = rounds.withColumn("__unread", F.coalesce(unread, F.lit(0))).where((F.col("__unread") == 0) & F.col(start).isNotNull()).drop("__unread")
    x, y = F.col(a).try_cast("long"), F.col(b).try_cast("long")
    won = F.when(x > y, 1).when(x < y, 0)
    base = F.coalesce(F.last(won, ignorenulls=True).over(before), F.col(start))
    if alternate is False:
        return rounds.withColumn("hammer", base.cast("int"))
    island = rounds.withColumn("__island", F.coalesce(F.sum(won.isNotNull().cast("int")).over(before), F.lit(0))).withColumn("__base", base)
    blank = W.partitionBy(*by, "__island").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    # the decisive round itself closes the island before it
    n = F.coalesce(F.sum(won.isNull().cast("int")).over(blank), F.lit(0))
    passed = (F.col("__base") + n) % 2
    return island.withColumn("hammer", (passed if alternate is True else F.when(alternate, passed).otherwise(F.col("__base"))).cast("int")).drop("__island", "__base")


def whole_pages_until(pages: DataFrame, order: list[str], n: str, budget: int, by: list[str] | None = None, width: int = 100_000) -> DataFrame:
    """Whole pages until their running sum reaches the budget, in each group of `by` (a document). A null n counts as 0.

    Without groups, order is one integer key: ranges of `width` keys are summed up first, and only ranges that begin below the budget are ordered, each by itself.
    """
    if by:
        before = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return pages.withColumn("__sum", F.coalesce(F.sum(n).over(before), F.lit(0))).where(F.col("__sum") < budget).drop("__sum")
    key = order[0]
    ranged = pages.withColumn("__range", F.floor(F.col(key) / width))
    sums = ranged.groupBy("__range").agg(F.coalesce(F.sum(n), F.lit(0)).alias("__n"))
    # a row for each range is all that meets in one place
    start = sums.withColumn("__start", F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).where(F.col("__start") < budget).drop("__n")
    before = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    near = ranged.join(start, "__range").withColumn("__sum", F.col("__start") + F.coalesce(F.sum(n).over(before), F.lit(0)))
    return near.where(F.col("__sum") < budget).drop("__range", "__start", "__sum")


def _events(spark, d):
    return table(spark, d, "events")


def q_page_sequence(spark, d):
    e = page_sequence(_events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "view")
    return e.where("event_type = 'view'").select("event_id", F.col("game_seq").cast("long").alias("game_seq"), F.col("end_no").cast("long").alias("end_no"))


def _rounds(spark, d):
    e = page_sequence(_events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.lit(True))
    # an error row is an end without digits
    digits = lambda x: F.when(F.col("event_type") == "error", None).otherwise(x)
    return e.select("event_id", "ts", "user_id", "game_seq", digits(F.col("event_id") % 3).alias("a"), digits(F.floor(F.col("event_id") / 3) % 3).alias("b"), F.lit(0).alias("start"))


def q_possession_keep(spark, d):
    return possession(_rounds(spark, d), ["user_id", "game_seq"], ["ts", "event_id"], "a", "b", "start").select("event_id", F.col("hammer").cast("long").alias("hammer"))


def q_possession_alternate(spark, d):
    return possession(_rounds(spark, d), ["user_id", "game_seq"], ["ts", "event_id"], "a", "b", "start", True).select("event_id", F.col("hammer").cast("long").alias("hammer"))


def q_image_budget(spark, d):
    return whole_pages_until(table(spark, d, "documents"), ["doc_id"], "n_chars", 100_000, width=50).select("doc_id", "n_chars")


def q_throw_order(spark, d):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, d, "lineitem").withColumn("n", F.row_number().over(w))
    return rows.where("not (l_orderkey % 2 = 1 and n = 1)").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("n") - F.col("l_orderkey") % 2).cast("long").alias("shot_no"))


def q_thrower_colour(spark, d):
    side = (F.col("l_orderkey") % 2 + F.col("l_linenumber") % 2) % 2
    return table(spark, d, "lineitem").groupBy("l_orderkey", F.when(side == 0, "red").otherwise("yellow").alias("color")).agg(F.count("*").alias("n"))


_SEQ = "SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events"
# a game ends with its first error row
_ROUNDS = f"""SELECT event_id, ts, user_id, g, event_id % 3 AS a, (event_id // 3) % 3 AS b FROM ({_SEQ}) WHERE g > 0
QUALIFY coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0"""
_WON = "CASE WHEN a > b THEN 1 WHEN a < b THEN 0 END"
_BEFORE = "(PARTITION BY user_id, g ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
QUERIES = {
    "page_sequence": q_page_sequence,
    "possession_keep": q_possession_keep,
    "possession_alternate": q_possession_alternate,
    "image_budget": q_image_budget,
    "throw_order": q_throw_order,
    "thrower_colour": q_thrower_colour,
}
ORACLE_SQL = {
    "page_sequence": f"SELECT event_id, CAST(g AS BIGINT) AS game_seq, CAST(n AS BIGINT) AS end_no FROM (SELECT *, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM ({_SEQ}) WHERE g > 0) WHERE event_type = 'view'",
    "possession_keep": f"SELECT event_id, CAST(coalesce(last_value({_WON} IGNORE NULLS) OVER {_BEFORE}, 0) AS BIGINT) AS hammer FROM ({_ROUNDS})",
    "possession_alternate": f"""WITH r AS ({_ROUNDS}), k AS (SELECT *, coalesce(last_value({_WON} IGNORE NULLS) OVER {_BEFORE}, 0) AS base, coalesce(sum(CASE WHEN a <> b THEN 1 ELSE 0 END) OVER {_BEFORE}, 0) AS i FROM r)
SELECT event_id, CAST((base + coalesce(sum(CASE WHEN a = b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g, i ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 2 AS BIGINT) AS hammer FROM k""",
    "image_budget": "SELECT doc_id, n_chars FROM (SELECT *, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM documents) WHERE s < 100000",
    "throw_order": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(n - l_orderkey % 2 AS BIGINT) AS shot_no FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE NOT (l_orderkey % 2 = 1 AND n = 1)",
    "thrower_colour": "SELECT l_orderkey, CASE WHEN (l_orderkey % 2 + l_linenumber % 2) % 2 = 0 THEN 'red' ELSE 'yellow' END AS color, count(*) AS n FROM lineitem GROUP BY 1, 2",
}
