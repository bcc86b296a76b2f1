"""Page layers as DataFrames: page text from form-feed separated files, and staged, per-event publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkframe.schemas import LAYERS


def page_text(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """doc_id (file name), page_no from 1, text. Only names with the suffix, in either case, are opened; a page ends at a form feed; an empty file has no page, as Spark passes over it."""
    either = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{either}").load(path)
    pages = F.posexplode(F.split(F.col("content").cast("string"), "\f"))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), pages.alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("page_no"), "text")


def page_layer(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """A layer (page_cells, page_images, detections, ...) that an extractor left as JSON lines; bytes are in base64, missing fields null, others ignored."""
    return spark.read.schema(LAYERS[layer]).json(path)


def pngs(spark: SparkSession, path: str) -> DataFrame:
    """image_name and content of the files of a folder whose names end in .png."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("image_name"), "content")


def page_lines(pages: DataFrame) -> DataFrame:
    """the lines of each page, numbered from 1. A line ends at any of the line, paragraph, page and record separators of Unicode text, a return with its line feed being one; an empty text, and what is behind the last end, is no line."""
    end = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
    lines = F.split(F.regexp_replace("text", rf"({end})\z", ""), end)
    return pages.where("text <> ''").select("doc_id", "page_no", F.posexplode(lines).alias("at", "line")).select("doc_id", "page_no", (F.col("at") + 1).alias("line_no"), "line")


def publish(rows: DataFrame, folder: str, event: str) -> None:
    """K2, K8: whole events at once; publishing an event again replaces it, and a failed write leaves what was there."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(event).parquet(folder)
