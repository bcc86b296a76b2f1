"""From pixel centres to sheet coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinkframe.session import table

# Sheet width and image width, tee and back line (metres and pixels), house and stone radius.
WIDTH_M, WIDTH_PX = 4.75, 299
TEE_M, TEE_PX, BACK_M, BACK_PX = 38.405, 159.5, 40.234, 40
HOUSE_M, STONE_M = 1.829, 0.145
SLOPE = (TEE_M - BACK_M) / (TEE_PX - BACK_PX)
OFFSET = TEE_M - SLOPE * TEE_PX


def sheet_coordinates(cx, cy):
    """x, y in metres, distance from the tee, and whether the stone touches the house."""
    x, y = cx * (WIDTH_M / WIDTH_PX) - WIDTH_M / 2, cy * SLOPE + OFFSET
    dist = F.sqrt(x * x + (y - TEE_M) * (y - TEE_M))
    return x, y, dist, (dist <= HOUSE_M + STONE_M).cast("int")


def q_sheet_coordinates(spark, d):
    e = table(spark, d, "embeddings")
    cx, cy = ((F.get("embedding", i).cast("double") + 1) / 2 * n for i, n in ((0, 299), (1, 600)))
    x, y, dist, house = sheet_coordinates(cx, cy)
    return e.select("vec_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(dist, 6).alias("dist"), house.alias("in_house"))


QUERIES = {"sheet_coordinates": q_sheet_coordinates}
ORACLE_SQL = {
    "sheet_coordinates": f"""WITH p AS (SELECT vec_id, (CAST(embedding[1] AS DOUBLE) + 1) / 2 * 299 * CAST({WIDTH_M / WIDTH_PX!r} AS DOUBLE) - {WIDTH_M / 2} AS x, (CAST(embedding[2] AS DOUBLE) + 1) / 2 * 600 * CAST({SLOPE!r} AS DOUBLE) + CAST({OFFSET!r} AS DOUBLE) AS y FROM embeddings),
q AS (SELECT *, sqrt(x * x + (y - {TEE_M}) * (y - {TEE_M})) AS dist FROM p)
SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y, round(dist, 6) AS dist, CAST(dist <= CAST({HOUSE_M + STONE_M!r} AS DOUBLE) AS INT) AS in_house FROM q"""
}
