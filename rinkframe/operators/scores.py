"""Score tables: choice, long form, who starts, played ends, final scores, and the ends with their last-stone side.

Input is page_cells (doc_id, page_no, table_no, row_no, col_no, cell). A score table has two rows (sides 0 and 1); its first column
says who starts, its last is the total, those between are ends. Null cells are blank; ties don't arise, as places are unique;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from rinkframe.functions.naming import POWER_PLAY, first_teams
from rinkframe.operators.records import pair
from rinkframe.operators.sequences import possession
from rinkframe.session import table
from rinkframe.sources.pages import page_lines

PAGE = ["doc_id", "page_no"]
COLORS = ("red", "yellow")


def color(side: Column) -> Column:
    """J3."""
    return F.when(side == 0, COLORS[0]).when(side == 1, COLORS[1])


def pick_table(cells: DataFrame) -> DataFrame:
    """Of each page the cells of its first table with a cell that is exactly `*`, else those of its last. One shuffle by page, which what follows shares."""
    page = W.partitionBy(*PAGE)
    chosen = F.coalesce(F.min(F.when(F.col("cell") == "*", F.col("table_no"))).over(page), F.max("table_no").over(page))
    return cells.withColumn("__chosen", chosen).where("table_no = __chosen").drop("__chosen")


def long_scores(cells: DataFrame) -> DataFrame:
    """doc_id, page_no, side, place (0 is who starts), last (place of the total), cell. Tables without exactly two rows are left out."""
    rows = W.partitionBy(*PAGE).orderBy("row_no")
    columns = W.partitionBy(*PAGE).orderBy("col_no")
    whole = W.partitionBy(*PAGE)
    placed = cells.withColumn("side", (F.dense_rank().over(rows) - 1).cast("int")).withColumn("place", (F.dense_rank().over(columns) - 1).cast("int"))
    placed = placed.withColumn("last", F.max("place").over(whole)).withColumn("__sides", F.max("side").over(whole))
    return placed.where("__sides = 1").select(*PAGE, "side", "place", "last", F.trim(F.coalesce("cell", F.lit(""))).alias("cell"))


def score_lines(long: DataFrame) -> DataFrame:
    """One row for each game page: start (P6: the first side whose first cell has a `*`), played (P7, A4: end columns with any cell filled), final_red, final_yellow (F16: both or neither)."""
    end = (F.col("place") > 0) & (F.col("place") < F.col("last"))
    total = lambda side: F.max(F.when((F.col("place") == F.col("last")) & (F.col("side") == side), F.col("cell")))
    lines = long.groupBy(*PAGE).agg(
        F.min(F.when((F.col("place") == 0) & F.col("cell").contains("*"), F.col("side"))).alias("start"),
        F.count_distinct(F.when(end & (F.col("cell") != ""), F.col("place"))).cast("int").alias("played"),
        total(0).alias("__red"),
        total(1).alias("__yellow"),
    )
    red, yellow = pair(F.col("__red"), F.col("__yellow"))
    return lines.select(*PAGE, "start", "played", red.alias("final_red"), yellow.alias("final_yellow"))


def ends(long: DataFrame, lines: DataFrame | None, mixed: DataFrame) -> DataFrame:
    """doc_id, page_no, end_no, hammer (side), score_red, score_yellow (both or neither). mixed: (doc_id, is_mixed), where a blank end passes the last stone on. lines: score_lines(long) if it is at hand; without it, start and played ends come from long itself, in the shuffle by page that it has.

    P8: a game has max(1, played) ends, and stops after the first whose cells aren't both digits; none without a start.
    """
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("cell")))
    inner = (F.col("place") > 0) & (F.col("place") < F.col("last"))
    if lines is None:
        page = W.partitionBy(*PAGE)
        start = F.min(F.when((F.col("place") == 0) & F.col("cell").contains("*"), F.col("side"))).over(page)
        played = F.size(F.collect_set(F.when(inner & (F.col("cell") != ""), F.col("place"))).over(page))
        long = long.withColumn("start", start).withColumn("played", played)
        wide = long.where(inner).groupBy(*PAGE, F.col("place").alias("end_no")).agg(side(0).alias("a"), side(1).alias("b"), F.first("start").alias("start"), F.first("played").alias("played"))
    else:
        wide = long.where(inner).groupBy(*PAGE, F.col("place").alias("end_no")).agg(side(0).alias("a"), side(1).alias("b")).join(lines.select(*PAGE, "start", "played"), PAGE)
    rounds = wide.where(F.col("end_no") <= F.greatest(F.col("played"), F.lit(1))).join(mixed, "doc_id")
    red, yellow = pair(F.col("a"), F.col("b"))
    held = possession(rounds, PAGE, ["end_no"], "a", "b", "start", alternate=F.coalesce("is_mixed", F.lit(False)))
    return held.select(*PAGE, "end_no", "hammer", red.alias("score_red"), yellow.alias("score_yellow"))


def teams(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, team_red, team_yellow of each page's text."""
    red, yellow = first_teams(F.col("text"))
    return pages.select(*PAGE, red.alias("team_red"), yellow.alias("team_yellow"))


def power_plays(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, end_no, as often as the page's lines name it."""
    lines = page_lines(pages)
    return lines.select(*PAGE, F.explode(F.regexp_extract_all("line", F.lit(POWER_PLAY), F.lit(1))).alias("n")).select(*PAGE, F.col("n").try_cast("int").alias("end_no"))


def stand_in_cells(spark, d):
    """Score tables made from events: a page for each signup row, 7 columns; marks, blanks and letters by arithmetic on event_id."""
    e = table(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").cast("string").alias("doc_id"), F.col("event_id").cast("int").alias("page_no"))
    e = e.select("*", F.explode(F.sequence(F.lit(0), F.col("page_no") % 3)).alias("table_no")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("row_no"))
    e = e.select("*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("col_no"))
    k = F.col("page_no") * 7 + F.col("col_no") * 5 + F.col("row_no") * 3 + F.col("table_no")
    mark = (F.col("page_no") + F.col("row_no") + F.col("table_no")) % 4 == 0
    played = F.col("page_no") % 6 + 1
    cell = F.when(F.col("col_no") == 0, F.when(mark, "*").otherwise("")).when((F.col("col_no") < 6) & (F.col("col_no") > played), " ").when(F.col("col_no") == 6, (k % 11).cast("string")).when(k % 17 == 0, "X").otherwise((k % 3).cast("string"))
    return e.withColumn("cell", cell)


def _mixed(spark, d):
    docs = table(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").cast("string").alias("doc_id")).distinct()
    return docs.select("doc_id", (F.col("doc_id").cast("int") % 2 == 0).alias("is_mixed"))


def q_score_table_cells(spark, d):
    return pick_table(stand_in_cells(spark, d)).select("doc_id", "page_no", "table_no", "row_no", "col_no", "cell")


def q_score_lines(spark, d):
    return score_lines(long_scores(pick_table(stand_in_cells(spark, d))))


def q_score_ends(spark, d):
    long = long_scores(pick_table(stand_in_cells(spark, d)))
    return ends(long, None, _mixed(spark, d))


def q_power_play_lines(spark, d):
    text = lambda k: F.concat(F.lit("Power Play: End "), (k % 8 + 1).cast("string"), F.lit("\nnone here\npower play:  end "), (k % 3).cast("string"), F.lit(" POWER PLAY: END 9"))
    pages = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.col("p_size").alias("page_no"), text(F.col("p_partkey")).alias("text"))
    return power_plays(pages)


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
_CELLS = """e AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, CAST(event_id AS INT) AS page_no FROM events WHERE event_type = 'signup'),
c AS (SELECT *, page_no * 7 + col_no * 5 + row_no * 3 + table_no AS k FROM (SELECT doc_id, page_no, CAST(t AS INT) AS table_no, CAST(r AS INT) AS row_no, CAST(c AS INT) AS col_no FROM e, generate_series(0, 2) x(t), generate_series(0, 1) y(r), generate_series(0, 6) z(c) WHERE t <= page_no % 3)),
cells AS (SELECT doc_id, page_no, table_no, row_no, col_no, CASE WHEN col_no = 0 THEN CASE WHEN (page_no + row_no + table_no) % 4 = 0 THEN '*' ELSE '' END WHEN col_no < 6 AND col_no > page_no % 6 + 1 THEN ' ' WHEN col_no = 6 THEN CAST(k % 11 AS VARCHAR) WHEN k % 17 = 0 THEN 'X' ELSE CAST(k % 3 AS VARCHAR) END AS cell FROM c),
pick AS (SELECT doc_id, page_no, coalesce(min(CASE WHEN m THEN table_no END), max(table_no)) AS table_no FROM (SELECT doc_id, page_no, table_no, bool_or(cell = '*') AS m FROM cells GROUP BY ALL) GROUP BY doc_id, page_no),
s AS (SELECT cells.* FROM cells JOIN pick USING (doc_id, page_no, table_no))"""
_LINES = """l AS (SELECT doc_id, page_no, min(CASE WHEN col_no = 0 AND contains(cell, '*') THEN row_no END) AS start, CAST(count(DISTINCT CASE WHEN col_no BETWEEN 1 AND 5 AND trim(cell) <> '' THEN col_no END) AS INT) AS played,
CAST(max(CASE WHEN col_no = 6 AND row_no = 0 THEN cell END) AS INT) AS final_red, CAST(max(CASE WHEN col_no = 6 AND row_no = 1 THEN cell END) AS INT) AS final_yellow FROM s GROUP BY 1, 2)"""
# the fold itself: the side of each end from that of the one before, until cells aren't both digits
_ENDS = """w AS (SELECT doc_id, page_no, col_no AS n, max(CASE WHEN row_no = 0 THEN TRY_CAST(trim(cell) AS INT) END) AS a, max(CASE WHEN row_no = 1 THEN TRY_CAST(trim(cell) AS INT) END) AS b FROM s WHERE col_no BETWEEN 1 AND 5 GROUP BY 1, 2, 3),
f AS (SELECT w.*, start AS hammer, greatest(played, 1) AS upto FROM w JOIN l USING (doc_id, page_no) WHERE n = 1 AND start IS NOT NULL
UNION ALL SELECT w.*, CASE WHEN f.a > f.b THEN 1 WHEN f.a < f.b THEN 0 WHEN CAST(f.doc_id AS INT) % 2 = 0 THEN 1 - hammer ELSE hammer END, upto FROM f JOIN w ON w.doc_id = f.doc_id AND w.page_no = f.page_no AND w.n = f.n + 1 WHERE f.a IS NOT NULL AND f.b IS NOT NULL AND w.n <= upto)"""
ORACLE_SQL = {
    "score_table_cells": f"WITH {_CELLS} SELECT doc_id, page_no, table_no, row_no, col_no, cell FROM s",
    "score_lines": f"WITH {_CELLS}, {_LINES} SELECT * FROM l",
    "score_ends": f"WITH RECURSIVE {_CELLS}, {_LINES}, {_ENDS} SELECT doc_id, page_no, n AS end_no, CAST(hammer AS INT) AS hammer, CASE WHEN b IS NOT NULL THEN a END AS score_red, CASE WHEN a IS NOT NULL THEN b END AS score_yellow FROM f",
    "power_play_lines": "SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_size AS page_no, CAST(unnest([p_partkey % 8 + 1, p_partkey % 3, 9]) AS INT) AS end_no FROM part",
}
