"""Set-shaped operators: outer zips, gaps, universal filters, anti joins, splits, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from rinkframe.operators.slots import missing_slots
from rinkframe.session import table


def ordinal_zip(left: DataFrame, right: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Rows of both sides by their position, the shorter side padded with nulls."""
    n = F.row_number().over(W.partitionBy(by).orderBy(*order)).cast("long")
    return left.withColumn("n", n).join(right.withColumn("n", n), [by, "n"], "full_outer")


def q_ordinal_outer_zip(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    side = lambda kind, name: e.where(F.col("event_type") == kind).select("user_id", "ts", F.col("event_id").alias(name))
    z = ordinal_zip(side("view", "view_id").withColumn("event_id", F.col("view_id")), side("click", "click_id").withColumn("event_id", F.col("click_id")), "user_id", ["ts", "event_id"])
    return z.select("user_id", "n", "view_id", "click_id")


def q_all_boxes_confident(spark, d):
    bad = table(spark, d, "lineitem").where(F.round("l_discount", 2) > 0.08).select("l_orderkey")
    return table(spark, d, "orders").join(bad, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


def q_unique_append(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


def q_train_val_split(spark, d):
    """A stable hash bucket of the name takes the place of a random draw."""
    bucket = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long")
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return docs.select("doc_id", F.when(bucket < int(0.8 * 2**32), "train").otherwise("val").alias("split"))


def q_table_stats(spark, d):
    names = ["region", "nation", "customer", "orders", "lineitem"]
    parts = [table(spark, d, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_hierarchy_rollup(spark, d):
    t = lambda n: table(spark, d, n)
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    orders = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("lines").alias("lines"))
    rows = t("customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_regionkey").agg(F.count("*").alias("customers"), F.sum("orders").cast("long").alias("orders"), F.sum("lines").cast("long").alias("lines"))


def q_size_filter(spark, d):
    """Bounds are inclusive."""
    return table(spark, d, "part").where("p_size between 10 and 20 and p_retailprice between 920 and 960").select("p_partkey")


def q_grid_gaps(spark, d):
    """The places of one page's grid (sizes times brands) that nothing is at."""
    p = table(spark, d, "part").select("p_size", F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("brand")).distinct()
    x, y = F.col("brand").cast("double"), F.col("p_size").cast("double")
    points = p.select(F.lit("p").alias("doc_id"), F.lit(1).alias("page_no"), F.lit(1).alias("xref"), x.alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1"))
    gone = missing_slots(points, layout=(0,) * 64)
    return gone.select(F.col("y0").cast(table(spark, d, "part").schema["p_size"].dataType).alias("p_size"), F.concat(F.lit("Brand#"), F.col("x0").cast("int").cast("string")).alias("p_brand"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
ORACLE_SQL = {
    "ordinal_outer_zip": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events)
SELECT coalesce(v.user_id, c.user_id) AS user_id, coalesce(v.n, c.n) AS n, v.event_id AS view_id, c.event_id AS click_id
FROM (SELECT * FROM e WHERE event_type = 'view') v FULL JOIN (SELECT * FROM e WHERE event_type = 'click') c ON v.user_id = c.user_id AND v.n = c.n""",
    "all_boxes_confident": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND round(l_discount, 2) > 0.08)",
    "unique_append": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "train_val_split": "SELECT doc_id, CASE WHEN ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT < 3435973836 THEN 'train' ELSE 'val' END AS split FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "table_stats": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("region", "nation", "customer", "orders", "lineitem")),
    "hierarchy_rollup": """WITH l AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1), o AS (SELECT o_custkey, count(*) AS orders, sum(lines) AS lines FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1)
SELECT n_regionkey, count(*) AS customers, CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(lines) AS BIGINT) AS lines FROM customer LEFT JOIN o ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    "size_filter": "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 920 AND 960",
    "grid_gaps": "SELECT * FROM (SELECT DISTINCT p_size FROM part), (SELECT DISTINCT p_brand FROM part) EXCEPT SELECT p_size, p_brand FROM part",
}
