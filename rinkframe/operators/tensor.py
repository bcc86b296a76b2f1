"""The stones of a page as one nested value, in order, and back.

A page's tensor is an array with an array for each shot, 1 to the number of its shots, of structs (cls, x, y, dist, in_house, in_sheet). Nothing is padded and
nothing is cut off, and the order is that of shot and stone numbers, not that in which rows arrive: all rows of a page meet in one aggregate, are
sorted by their numbers and then dealt to their shots, so one shuffle by page is all there is. A page's stones are bounded by the page.

Defined results: shots without stones, and those between the given ones that have no row, are empty arrays; stones of shots beyond the page's number of shots make it longer; rows without a shot number are left
out, those without a stone number come last in their shot, stones of equal numbers by their values; a page without shots has an empty tensor if it is
among the shots; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkframe.session import table

VALUES = ["cls", "x", "y", "dist", "in_house", "in_sheet"]


def tensors(shots: DataFrame, stones: DataFrame, page: list[str]) -> DataFrame:
    """page columns, n_shots, tensor. shots: page, shot_no; stones: page, shot_no, stone_no and VALUES."""
    stone = F.struct(F.col("stone_no").isNull().alias("last"), "stone_no", *VALUES)
    rows = stones.where("shot_no is not null").select(*page, "shot_no", stone.alias("stone"))
    every = rows.unionByName(shots.select(*page, "shot_no"), allowMissingColumns=True)
    whole = every.groupBy(*page).agg(F.coalesce(F.max("shot_no"), F.lit(0)).cast("int").alias("n_shots"), F.array_sort(F.collect_list(F.when(F.col("stone").isNotNull(), F.struct("shot_no", "stone")))).alias("__s"))

    def of(shot: Column) -> Column:
        return F.transform(F.filter("__s", lambda s: s["shot_no"] == shot), lambda s: F.struct(*(s["stone"][c].alias(c) for c in VALUES)))

    none = F.slice(F.array(of(F.lit(0))), 1, 0)
    return whole.withColumn("tensor", F.when(F.col("n_shots") > 0, F.transform(F.sequence(F.lit(1), F.greatest("n_shots", F.lit(1))), of)).otherwise(none)).drop("__s")


def stones_of(tensor: DataFrame, page: list[str]) -> DataFrame:
    """The inverse: page columns, shot_no, stone_no (from 1) and VALUES; a shot without stones has one row of nulls."""
    shots = tensor.select(*page, F.posexplode("tensor").alias("at", "shot")).select(*page, (F.col("at") + 1).alias("shot_no"), F.posexplode_outer("shot").alias("place", "stone"))
    return shots.select(*page, "shot_no", (F.col("place") + 1).alias("stone_no"), *(F.col(f"stone.{c}").alias(c) for c in VALUES))


def _stand_in(spark, d):
    """Vectors of eights are pages, a vector is a shot, its numbers above 0.1 are stones, dealt to many tasks."""
    e = table(spark, d, "embeddings").where("embedding is not null").select(F.floor(F.col("vec_id") / 8).alias("page"), (F.col("vec_id") % 8 + 1).cast("int").alias("shot_no"), "embedding")
    each = e.select("page", "shot_no", F.posexplode("embedding").alias("stone_no", "v")).where("v > 0.1")
    x = F.floor(F.col("v").cast("double") * 1000).cast("double")
    stones = each.select("page", "shot_no", "stone_no", (F.col("stone_no") % 2).alias("cls"), x.alias("x"), (x + 1).alias("y"), (x + 2).alias("dist"), (F.col("stone_no") % 3).alias("in_house"), F.lit(1).alias("in_sheet"))
    return e.select("page", "shot_no").where("shot_no % 3 = 0"), stones.repartition(16, "stone_no")


def q_page_tensors(spark, d):
    """each page's tensor as text: shots by |, stones by blanks."""
    shots, stones = _stand_in(spark, d)
    text = F.array_join(F.transform("tensor", lambda s: F.array_join(F.transform(s, lambda v: F.concat_ws(":", v["cls"], v["x"].cast("int"), v["in_house"])), " ")), "|")
    return tensors(shots, stones, ["page"]).select("page", "n_shots", text.alias("tensor"))


def q_tensor_stones(spark, d):
    """The stones of each page's tensor again, with a row of nulls for shots without."""
    shots, stones = _stand_in(spark, d)
    return stones_of(tensors(shots, stones, ["page"]), ["page"]).select("page", "shot_no", "stone_no", "cls", "x", "y")


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
_STONES = """e AS (SELECT CAST(vec_id // 8 AS BIGINT) AS page, CAST(vec_id % 8 + 1 AS INT) AS shot_no, embedding AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT page, shot_no, k, floor(CAST(v[k + 1] AS DOUBLE) * 1000) AS x FROM e, generate_series(0, 63) g(k) WHERE v[k + 1] > CAST(0.1 AS DOUBLE)),
n AS (SELECT page, max(shot_no) AS n FROM (SELECT page, shot_no FROM s UNION ALL SELECT page, shot_no FROM e WHERE shot_no % 3 = 0) GROUP BY 1)"""
ORACLE_SQL = {
    "page_tensors": f"""WITH {_STONES}, h AS (SELECT page, shot_no, string_agg(concat(k % 2, ':', CAST(x AS INT), ':', k % 3), ' ' ORDER BY k) AS t FROM s GROUP BY 1, 2)
SELECT n.page, n AS n_shots, string_agg(coalesce(t, ''), '|' ORDER BY i) AS tensor FROM (SELECT page, n, CAST(unnest(range(1, n + 1)) AS INT) AS i FROM n) n LEFT JOIN h ON h.page = n.page AND h.shot_no = i GROUP BY 1, 2""",
    "tensor_stones": f"""WITH {_STONES} SELECT n.page, i AS shot_no, CAST(CASE WHEN k IS NOT NULL THEN row_number() OVER (PARTITION BY n.page, i ORDER BY k) END AS INT) AS stone_no, CAST(k % 2 AS INT) AS cls, x, x + 1 AS y
FROM (SELECT page, CAST(unnest(range(1, n + 1)) AS INT) AS i FROM n) n LEFT JOIN s ON s.page = n.page AND s.shot_no = i""",
}
