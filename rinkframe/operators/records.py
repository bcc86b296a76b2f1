"""Cells and records: long score tables, paired conversion, placeholder rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinkframe.session import table


def pair(a, b):
    """Both sides as integers, or neither."""
    number = lambda x: F.when(x.rlike("^[0-9]+$"), x.try_cast("int"))
    x, y = number(a), number(b)
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def q_pair_null(spark, d):
    a = F.element_at(F.split("p_brand", "#"), 2)
    b = F.when(F.col("p_size") % 5 == 0, "X").otherwise(F.col("p_size").cast("string"))
    x, y = pair(a, b)
    return table(spark, d, "part").select("p_partkey", x.alias("a"), y.alias("b"))


def q_score_unpivot(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return rows.unpivot(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "col", "val")


def q_stones_outer(spark, d):
    """One row for each stone, one placeholder for a shot without any; no padding."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.explode_outer(F.filter("embedding", lambda x: x > 0.25)).alias("v"))


def q_pixel_boxes(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * 16).cast("int").alias("px"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
ORACLE_SQL = {
    "pair_null": """WITH t AS (SELECT p_partkey, split_part(p_brand, '#', 2) AS a, CASE WHEN p_size % 5 = 0 THEN 'X' ELSE CAST(p_size AS VARCHAR) END AS b FROM part),
n AS (SELECT p_partkey, CASE WHEN regexp_matches(a, '^[0-9]+$') THEN TRY_CAST(a AS INT) END AS x, CASE WHEN regexp_matches(b, '^[0-9]+$') THEN TRY_CAST(b AS INT) END AS y FROM t)
SELECT p_partkey, CASE WHEN y IS NOT NULL THEN x END AS a, CASE WHEN x IS NOT NULL THEN y END AS b FROM n""",
    "score_unpivot": " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '{c}' AS col, {c} AS val FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    "stones_outer": "SELECT vec_id, unnest(CASE WHEN len(f) = 0 THEN [NULL] ELSE f END) AS v FROM (SELECT vec_id, list_filter(embedding, lambda x: x > 0.25) AS f FROM embeddings)",
    "pixel_boxes": "SELECT p_partkey, CAST(trunc(p_retailprice * 16) AS INT) AS px FROM part",
}
