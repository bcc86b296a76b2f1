"""Sheet images of a page: size filter, missing slots of the grid, recovered boxes, throw order.

Input is page_images (doc_id, page_no, xref, width, height, x0, y0, x1, y1). A page's images are few, so joins within a page stay
small; pages are spread by (doc_id, page_no). Rows without a place are no images; images at the same place count once as a slot and
are ordered by xref; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from rinkframe.session import table

PAGE = ["doc_id", "page_no"]
SCALE = 16


def sheet_images(images: DataFrame) -> DataFrame:
    """Images of the sheet's size, bounds included."""
    return images.where("width between 298 and 302 and height between 598 and 602 and x0 is not null and y0 is not null")


def missing_slots(images: DataFrame, layout: tuple[int, ...] = (0, 0, 4), row_decimals: int = 4) -> DataFrame:
    """doc_id, page_no, x0, y0, x1, y1 of the grid places of a page that have no image.

    layout: how many places each row has from the left (0: all). A missing box has the size of the first image in its row, as far as y0 rounded to row_decimals says so, else of the page's first.
    A page's images meet once, as an array, and all the rest is done on it; among images of one xref the smallest place is the first.
    """
    size = F.struct((F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    image = F.struct(F.col("xref").isNull().alias("last"), "xref", F.round("x0", 4).alias("x"), F.round("y0", 4).alias("y"), F.round("y0", row_decimals).alias("row"), size.alias("size"))
    pages = images.where("x0 is not null and y0 is not null").groupBy(*PAGE).agg(F.array_sort(F.collect_list(image)).alias("images"))
    distinct = lambda c: F.array_sort(F.array_distinct(F.transform("images", lambda i: i[c])))
    place = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    pages = pages.select(*PAGE, "images", distinct("x").alias("xs"), F.slice(distinct("y"), 1, len(layout)).alias("ys"))
    room = lambda i: F.element_at(F.array(*map(F.lit, layout)), i + 1)
    row = lambda y, i: F.transform(F.when(room(i) == 0, F.col("xs")).otherwise(F.slice("xs", F.lit(1), room(i))), lambda x: place(x, y))
    gone = F.array_except(F.flatten(F.transform("ys", row)), F.transform("images", lambda i: place(i["x"], i["y"])))
    each = pages.select(*PAGE, "images", F.explode(gone).alias("g"))
    own = F.get(F.filter("images", lambda i: i["row"] == F.col("g.y")), F.lit(0))["size"]
    sized = each.select(*PAGE, "g.x", "g.y", F.coalesce(own, F.get("images", F.lit(0))["size"]).alias("s"))
    return sized.select(*PAGE, F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("s.w")).alias("x1"), (F.col("y") + F.col("s.h")).alias("y1"))


def recovered(missing: DataFrame, images: DataFrame, records: DataFrame) -> DataFrame:
    """Of each page's missing boxes the first (by y0, x0) that its records ask for beyond its images. records: a row for each record. F13: with the box in pixels of a page drawn at SCALE. A page without an image has no grid, and none is recovered."""
    one = lambda df, a, b: df.groupBy(*PAGE).agg(F.count("*").alias("n")).select(*PAGE, (F.col("n") * a).alias("more"), F.lit(b).alias("shown"))
    short = one(records, 1, 0).unionByName(one(images, -1, 1)).groupBy(*PAGE).agg(F.sum("more").alias("k"), F.max("shown").alias("shown")).where("k > 0 and shown = 1").select(*PAGE, "k")
    place = F.row_number().over(W.partitionBy(*PAGE).orderBy("y0", "x0"))
    kept = missing.join(short, PAGE).withColumn("n", place).where("n <= k")
    return kept.select(*PAGE, "x0", "y0", "x1", "y1", *((F.col(c) * SCALE).cast("int").alias(f"p{c}") for c in ("x0", "y0", "x1", "y1")))


def throw_order(images: DataFrame, found: DataFrame, skip_first: DataFrame | None = None) -> DataFrame:
    """Images and recovered boxes in throw order: doc_id, page_no, image_no, shot_no (from 1; null for the first image of pages in skip_first), xref (null if recovered), x0, y0."""
    columns = [*PAGE, "xref", "x0", "y0"]
    every = images.select(*columns).unionByName(found.select(*PAGE, F.lit(None).cast("int").alias("xref"), "x0", "y0"))
    numbered = every.withColumn("image_no", F.row_number().over(W.partitionBy(*PAGE).orderBy("y0", "x0", F.col("xref").asc_nulls_last())))
    if skip_first is None:
        return numbered.withColumn("shot_no", F.col("image_no"))
    late = skip_first.select(*PAGE, F.lit(1).alias("__skip")).distinct()
    return numbered.join(late, PAGE, "left").withColumn("shot_no", F.nullif(F.col("image_no") - F.coalesce("__skip", F.lit(0)), F.lit(0))).drop("__skip")


def _images(spark, d):
    """Pages of a grid made from lineitem: orders are pages, lines take places of 6 + 6 + 4 by arithmetic on the keys."""
    l = table(spark, d, "lineitem").select(F.lit("b").alias("doc_id"), F.col("l_orderkey").cast("int").alias("page_no"), F.col("l_linenumber").alias("xref"), ((F.col("l_partkey") + F.col("l_linenumber")) % 16).cast("int").alias("slot"), (F.col("l_suppkey") % 7 + 297).cast("int").alias("width"))  # noqa: E741
    l = l.groupBy("doc_id", "page_no", "slot").agg(F.min("xref").alias("xref"), F.min("width").alias("width"))  # noqa: E741
    x0, y0 = (F.col("slot") % 6 * 10 + 10).cast("double"), (F.floor(F.col("slot") / 6) * 100 + 100).cast("double")
    return l.select(*PAGE, F.col("xref") * 100 + F.col("slot"), "width", F.lit(600).alias("height"), x0.alias("x0"), y0.alias("y0"), (x0 + 5 + F.col("slot") % 2).alias("x1"), (y0 + 50).alias("y1")).withColumnRenamed("((xref * 100) + slot)", "xref")


def q_sheet_image_sizes(spark, d):
    return sheet_images(_images(spark, d)).select("page_no", "xref", "width")


def q_missing_slots(spark, d):
    return missing_slots(_images(spark, d))


def q_recovered_boxes(spark, d):
    images = _images(spark, d)
    records = table(spark, d, "orders").select(F.lit("b").alias("doc_id"), F.col("o_orderkey").cast("int").alias("page_no"), F.explode(F.sequence(F.lit(1), (F.col("o_orderkey") % 5 + 6).cast("int"))).alias("n"))
    return recovered(missing_slots(images), images, records)


def q_image_throw_order(spark, d):
    images = _images(spark, d)
    return throw_order(sheet_images(images), missing_slots(images), images.where("page_no % 3 = 0"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
_IMAGES = """g AS (SELECT CAST(l_orderkey AS INT) AS page_no, CAST((l_partkey + l_linenumber) % 16 AS INT) AS slot, min(l_linenumber) AS xr, CAST(min(l_suppkey % 7 + 297) AS INT) AS width FROM lineitem GROUP BY 1, 2),
im AS (SELECT 'b' AS doc_id, page_no, xr * 100 + slot AS xref, width, CAST(slot % 6 * 10 + 10 AS DOUBLE) AS x0, CAST(slot // 6 * 100 + 100 AS DOUBLE) AS y0, CAST(slot % 6 * 10 + 15 + slot % 2 AS DOUBLE) AS x1, CAST(slot // 6 * 100 + 150 AS DOUBLE) AS y1 FROM g)"""
_MISSING = """xs AS (SELECT page_no, x0, row_number() OVER (PARTITION BY page_no ORDER BY x0) AS rx FROM (SELECT DISTINCT page_no, x0 FROM im)), ys AS (SELECT page_no, y0, row_number() OVER (PARTITION BY page_no ORDER BY y0) AS ry FROM (SELECT DISTINCT page_no, y0 FROM im)),
gone AS (SELECT xs.page_no, xs.x0, ys.y0 FROM xs JOIN ys USING (page_no) WHERE ry <= 2 OR (ry = 3 AND rx <= 4) EXCEPT SELECT page_no, x0, y0 FROM im),
missing AS (SELECT 'b' AS doc_id, g.page_no, g.x0, g.y0, g.x0 + (SELECT arg_min(x1 - x0, xref) FROM im WHERE im.page_no = g.page_no AND im.y0 = g.y0) AS x1, g.y0 + 50 AS y1 FROM gone g)"""
ORACLE_SQL = {
    "sheet_image_sizes": f"WITH {_IMAGES} SELECT page_no, xref, width FROM im WHERE width BETWEEN 298 AND 302",
    "missing_slots": f"WITH {_IMAGES}, {_MISSING} SELECT * FROM missing",
    "recovered_boxes": f"WITH {_IMAGES}, {_MISSING} SELECT doc_id, page_no, x0, y0, x1, y1, CAST(trunc(x0 * 16) AS INT) AS px0, CAST(trunc(y0 * 16) AS INT) AS py0, CAST(trunc(x1 * 16) AS INT) AS px1, CAST(trunc(y1 * 16) AS INT) AS py1 FROM (SELECT *, row_number() OVER (PARTITION BY page_no ORDER BY y0, x0) AS n FROM missing) JOIN (SELECT page_no, count(*) AS images FROM im GROUP BY 1) USING (page_no) JOIN orders ON o_orderkey = page_no WHERE n <= o_orderkey % 5 + 6 - images",
    "image_throw_order": f"WITH {_IMAGES}, {_MISSING}, u AS (SELECT doc_id, page_no, xref, x0, y0 FROM im WHERE width BETWEEN 298 AND 302 UNION ALL SELECT doc_id, page_no, NULL, x0, y0 FROM missing), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_no ORDER BY y0, x0, xref NULLS LAST) AS INT) AS image_no FROM u) SELECT *, CASE WHEN page_no % 3 <> 0 THEN image_no WHEN image_no > 1 THEN image_no - 1 END AS shot_no FROM n",
}
