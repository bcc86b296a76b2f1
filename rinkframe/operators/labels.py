"""Label texts from detections, the data set that a detector learns from, and the check of the files to read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkframe.functions.naming import with_suffix
from rinkframe.session import table

# Classes by number, and the least confidence of a label's boxes.
COLOURS = ("red", "yellow")
SURE = 0.75


def label_texts(images: DataFrame, boxes: DataFrame, image: str = "image_name", least: float = SURE) -> DataFrame:
    """Image, label_name, n_boxes, label of images whose boxes all have a confidence of `least` or more.

    boxes: image, cls, conf, x, y, w, h (centre and size as shares of the image). A label has a line for each box, in the order of
    its columns, with 6 decimals for the centre and 7 for the size. An image without boxes has an empty label; a box without
    a confidence is not sure; boxes of other images are ignored. A group is one image's boxes, which a detector bounds.
    """
    line = F.concat_ws(" ", F.col("cls").cast("int"), *(F.col(c).cast("decimal(12,6)") for c in "xy"), *(F.col(c).cast("decimal(12,7)") for c in "wh"))
    each = F.sort_array(F.collect_list(F.struct("cls", "x", "y", "w", "h", F.concat(line, F.lit("\n")).alias("line"))))
    lines = boxes.groupBy(image).agg(F.min(F.coalesce("conf", F.lit(0.0))).alias("__least"), F.count("*").alias("__n"), F.array_join(each["line"], "").alias("__label"))
    found = images.select(image).distinct().join(lines, image, "left").where(F.coalesce("__least", F.lit(least)) >= least)
    return found.select(image, with_suffix(F.col(image), ".txt").alias("label_name"), F.coalesce("__n", F.lit(0)).alias("n_boxes"), F.coalesce("__label", F.lit("")).alias("label"))


def write_dataset(images: DataFrame, labels: DataFrame, folder: str, train: float = 0.8, image: str = "image_name") -> None:
    """Labelled images with their labels, in a folder for each split, and the data set's description beside them.

    The split is by a stable hash of the name, so that a repeated task or a later run puts an image where it was.
    """
    bucket = F.conv(F.substring(F.md5(F.col(image)), 1, 8), 16, 10).cast("long")
    split = F.when(bucket < int(train * 2**32), "train").otherwise("val")
    images.join(labels, image).withColumn("split", split).write.mode("overwrite").partitionBy("split").parquet(f"{folder}/images")
    images.sparkSession.createDataFrame([(description(folder),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/description")


def description(folder: str) -> str:
    """The YAML text that names the folders and the classes."""
    names = "".join(f"\n  {i}: {c}" for i, c in enumerate(COLOURS))
    return f"path: {folder}\ntrain: images/split=train\nval: images/split=val\nnames:{names}"


def file_problems(files: DataFrame, there: DataFrame) -> DataFrame:
    """Path and reason of files that can't be read: without an event name first, else not among the paths of `there`. A null path isn't there."""
    known = there.select("path").distinct().withColumn("__there", F.lit(True))
    reason = F.when(F.coalesce("event_name", F.lit("")) == "", "event name").when(F.col("__there").isNull(), "not found")
    return files.join(known, "path", "left").select("path", reason.alias("reason")).where("reason is not null")


def checked(files: DataFrame, there: DataFrame) -> DataFrame:
    """Files, if there are any and all can be read; else an error that names up to five."""
    if files.isEmpty():
        raise ValueError("no files")
    if bad := file_problems(files, there).orderBy("path").take(5):
        raise ValueError("; ".join(f"{r.path}: {r.reason}" for r in bad))
    return files


def q_pseudo_labels(spark, d):
    """Orders are images, their lines boxes: places are 64ths and sizes 128ths, which both engines print alike."""
    k = lambda c, n: (F.col(c) % n).cast("double") / n
    boxes = table(spark, d, "lineitem").select(
        F.concat(F.lit("page"), F.col("l_orderkey").cast("string"), F.lit(".png")).alias("image_name"), (F.col("l_linenumber") % 2).alias("cls"), F.when(F.col("l_suppkey") % 16 == 0, 0.7).otherwise(0.75).alias("conf"),
        k("l_partkey", 64).alias("x"), k("l_suppkey", 64).alias("y"), k("l_partkey", 128).alias("w"), k("l_linenumber", 128).alias("h"),
    )
    return label_texts(table(spark, d, "orders").select(F.concat(F.lit("page"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("image_name")), boxes)


def q_file_problems(spark, d):
    """Orders are files to read, customers of small nation keys those that are there."""
    files = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.when(F.col("o_orderkey") % 10 == 0, "").when(F.col("o_orderkey") % 10 == 1, None).otherwise("E").alias("event_name"))
    return file_problems(files, table(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").cast("string").alias("path")))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
ORACLE_SQL = {
    "pseudo_labels": """WITH b AS (SELECT l_orderkey AS k, l_linenumber % 2 AS cls, CASE WHEN l_suppkey % 16 = 0 THEN 0.7 ELSE 0.75 END AS conf, (l_partkey % 64) / 64.0 AS x, (l_suppkey % 64) / 64.0 AS y, (l_partkey % 128) / 128.0 AS w, (l_linenumber % 128) / 128.0 AS h FROM lineitem),
g AS (SELECT k, min(conf) AS least, count(*) AS n, string_agg(CAST(cls AS VARCHAR) || ' ' || CAST(CAST(x AS DECIMAL(12,6)) AS VARCHAR) || ' ' || CAST(CAST(y AS DECIMAL(12,6)) AS VARCHAR) || ' ' || CAST(CAST(w AS DECIMAL(12,7)) AS VARCHAR) || ' ' || CAST(CAST(h AS DECIMAL(12,7)) AS VARCHAR) || chr(10), '' ORDER BY cls, x, y, w, h) AS label FROM b GROUP BY k)
SELECT DISTINCT 'page' || o_orderkey || '.png' AS image_name, 'page' || o_orderkey || '.txt' AS label_name, coalesce(n, 0) AS n_boxes, coalesce(label, '') AS label FROM orders LEFT JOIN g ON k = o_orderkey WHERE coalesce(least, 0.75) >= 0.75""",
    "file_problems": """SELECT CAST(o_custkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 10 < 2 THEN 'event name' ELSE 'not found' END AS reason
FROM orders WHERE o_orderkey % 10 < 2 OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)""",
}
