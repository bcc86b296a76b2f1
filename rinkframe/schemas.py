"""The five tables of a result book, the page layers they are made from, and empty tables of both kinds.

    python -m rinkframe.schemas FOLDER [--mixed]     # K1b: makes the five tables in a new folder
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


KINDS = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def _struct(text: str) -> T.StructType:
    """Schema of "name type[ NOT NULL], ..."; Spark's own parser would need a session here."""
    words = [x.split() for x in text.split(", ")]
    return T.StructType([T.StructField(w[0], KINDS[w[1]], len(w) == 2) for w in words])


# K1: the tables. ends has is_power_play in mixed doubles alone; where both are kept together it is null for four players.
TABLES = {
    "events": _struct("id bigint, name string NOT NULL, year int, category string"),
    "games": _struct("id bigint, event_id bigint NOT NULL, page int, team_red string, team_yellow string, final_score_red int, final_score_yellow int"),
    "ends": _struct("id bigint, game_id bigint NOT NULL, page int, number int, color_hammer string, score_red int, score_yellow int, is_power_play int"),
    "shots": _struct("id bigint, end_id bigint NOT NULL, number int, color string, team string, player_name string, type string, turn string, percent_score int"),
    "stones": _struct("id bigint, shot_id bigint NOT NULL, color string, x double, y double, distance_from_center double, inhouse int, insheet int"),
}
LAYERS = {
    "files": _struct("path string, event_name string, is_mixed boolean"),
    "page_text": _struct("doc_id string, page_no int, text string"),
    "page_cells": _struct("doc_id string, page_no int, table_no int, row_no int, col_no int, cell string"),
    "page_images": _struct("doc_id string, page_no int, xref int, width int, height int, x0 double, y0 double, x1 double, y1 double, pixels binary"),
    "detections": _struct("doc_id string, page_no int, image_no int, cls int, conf double, x1 double, y1 double, x2 double, y2 double"),
    "labels_boxes": _struct("image_name string, cls int, conf double, x double, y double, w double, h double"),
}


def layout(table: str, mixed: bool = False) -> list[str]:
    """The columns of a table, in order; is_power_play only if mixed."""
    return [f for f in TABLES[table].fieldNames() if mixed or f != "is_power_play"]


def fitted(df: DataFrame, table: str, mixed: bool = True) -> DataFrame:
    """df with the columns and types of a table."""
    of = {f.name: f.dataType for f in TABLES[table]}
    return df.select(*(df[c].cast(of[c]).alias(c) for c in layout(table, mixed)))


def create_tables(spark: SparkSession, folder: str, mixed: bool = False) -> None:
    """Empty Parquet tables in a folder; an error if one is there already."""
    for name, schema in TABLES.items():
        kept = T.StructType([f for f in schema if f.name in layout(name, mixed)])
        spark.createDataFrame([], kept).write.mode("errorifexists").parquet(f"{folder}/{name}")


if __name__ == "__main__":
    create_tables(SparkSession.builder.getOrCreate(), sys.argv[1], "--mixed" in sys.argv)
