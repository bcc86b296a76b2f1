"""From the page layers of result books to the five tables.

Keys inside are natural ones (doc_id, game_seq, end_no, shot_no), so that no step needs ids of another; dense ids come last (with_ids).
What several tables need (numbered pages, ends, records, shots) is staged once in the shared folder. Nothing is lost without a word: what the tables can't take is returned as `quarantine`. Documents are spread by doc_id; a document's
pages are bounded by its book.

Defined results: null page text is a page of no kind; layers may lack any page; repeated pages of one number are an order of their own and
should be removed before; empty layers give empty tables; extra columns of layers are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from rinkframe.functions.geometry import sheet_coordinates
from rinkframe.functions.naming import category, event_name, year
from rinkframe.operators.books import dense_ranks, shots as shot_records
from rinkframe.operators.scores import PAGE, color, ends as ends_of, long_scores, pick_table, power_plays, score_lines, teams
from rinkframe.operators.sequences import page_sequence
from rinkframe.operators.slots import missing_slots, recovered, sheet_images, throw_order
from rinkframe.schemas import TABLES, fitted, layout
from rinkframe.session import staged, table
from rinkframe.sources.pages import page_lines

GAME, DETAIL, PREPOSITIONED, CONFIDENCE = "Game Results", "Shot by Shot", "prepositioned stones", 0.5


def page_kinds(pages: DataFrame, game: str = GAME, detail: str = DETAIL) -> DataFrame:
    """Pages with their kind, game before detail; pages of no kind are left out."""
    kind = F.when(F.col("text").contains(game), "game").when(F.col("text").contains(detail), "detail")
    return pages.withColumn("kind", kind).where("kind is not null")


def numbered_pages(kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with game_seq and end_no, detail pages before any game): W1, W2, W10."""
    seq = page_sequence(kinds, "doc_id", ["page_no"], F.col("kind") == "game", F.col("kind") == "detail")
    first = kinds.where("kind = 'game'").groupBy("doc_id").agg(F.min("page_no").alias("first"))
    early = kinds.join(first, "doc_id", "left").where("first is null or page_no < first").select(*PAGE)
    return seq, early


def events(files: DataFrame) -> DataFrame:
    """doc_id (file name), is_mixed, name, year, category of each file; the event's name is made from the file's if it is null. F1-F3."""
    doc = F.element_at(F.split("path", "/"), -1)
    named = files.select(doc.alias("doc_id"), F.coalesce("is_mixed", F.lit(False)).alias("is_mixed"), F.coalesce("event_name", event_name(doc)).alias("name"))
    return named.select("doc_id", "is_mixed", "name", year(F.col("name")).alias("year"), category(F.col("name"), F.col("is_mixed")).alias("category"))


def build(files: DataFrame, page_text: DataFrame, page_cells: DataFrame, page_images: DataFrame, detections: DataFrame) -> dict[str, DataFrame]:
    """events, games, ends, shots and stones under natural keys, and quarantine (doc_id, page_no, reason)."""
    of_event = events(files)
    mixed = of_event.select("doc_id", "is_mixed")
    pages = page_text.join(mixed.select("doc_id"), "doc_id", "left_semi")
    kinds = staged(page_kinds(pages), "kinds")
    seq, early = numbered_pages(kinds)
    seq = staged(seq, "pages")
    game_pages = seq.where("kind = 'game'").select(*PAGE, "text", "game_seq")
    long = staged(long_scores(pick_table(page_cells.join(game_pages.select(*PAGE), PAGE, "left_semi"))), "scores")
    lines = staged(score_lines(long), "lines")
    games = game_pages.join(teams(game_pages), PAGE).join(lines, PAGE, "left").select("doc_id", "game_seq", F.col("page_no").alias("page"), "team_red", "team_yellow", F.col("final_red").alias("final_score_red"), F.col("final_yellow").alias("final_score_yellow"))
    # Power plays flag the ends of mixed doubles
    flagged = power_plays(game_pages).distinct().withColumn("__flag", F.lit(1))
    found = ends_of(long, lines, mixed).join(game_pages.select(*PAGE, "game_seq"), PAGE).join(flagged, [*PAGE, "end_no"], "left").join(mixed, "doc_id")
    detail = seq.where("kind = 'detail'").select(*PAGE, "text", "game_seq", F.col("end_no").cast("int").alias("end_no"))
    key = ["doc_id", "game_seq", "end_no"]
    # An end gets the page that shows it
    ends = found.drop("page_no").join(detail.select(*key, F.col("page_no").alias("page")), key, "left")
    ends = staged(ends.select(*key, "page", F.col("end_no").alias("number"), "hammer", color(F.col("hammer")).alias("color_hammer"), "score_red", "score_yellow", F.when(F.col("is_mixed"), F.coalesce("__flag", F.lit(0))).alias("is_power_play")), "ends")
    shown = detail.join(ends.select(*key, "hammer"), key)
    lost = lambda df, why: df.select(*PAGE, F.lit(why).alias("reason"))
    quarantine = lost(early, "detail page before any game").unionByName(lost(detail.join(ends, key, "left_anti"), "detail page of an end that its game doesn't have"))
    quarantine = quarantine.unionByName(lost(game_pages.join(lines, PAGE, "left_anti"), "game page without a score table of two rows"))
    lines_of = page_lines(shown.select(*PAGE, "text"))
    records = staged(shot_records(lines_of, PAGE, "line_no", "line").withColumn("shot_no", F.row_number().over(W.partitionBy(*PAGE).orderBy("line_no"))), "records")
    quarantine = quarantine.unionByName(lost(records.where("parts > 2"), "player line of more than two parts"))
    images = sheet_images(page_images.join(shown.select(*PAGE), PAGE, "left_semi"))
    skip = lines_of.where(F.lower("line") == PREPOSITIONED).join(mixed.where("is_mixed"), "doc_id", "left_semi").select(*PAGE).distinct()
    thrown = throw_order(images, recovered(missing_slots(images), images, records), skip).where("shot_no is not null")
    # Images and records of a page by their place, the shorter side padded
    met = thrown.select(*PAGE, "shot_no", "image_no").join(records.drop("line_no"), [*PAGE, "shot_no"], "full_outer").join(shown.select(*PAGE, "game_seq", "end_no", "hammer"), PAGE)
    # Odd shots are those of the side without the last stone
    shots = staged(met.withColumn("color", color((F.col("hammer") + F.col("shot_no") % 2) % 2)).select(*key, "page_no", "image_no", F.col("shot_no").alias("number"), "color", "team", F.col("player").alias("player_name"), "type", "turn", F.col("score").alias("percent_score")), "shots")
    x, y, dist, house = sheet_coordinates((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2)
    stones = detections.where(F.col("conf") >= CONFIDENCE).select(*PAGE, "image_no", color(F.col("cls")).alias("color"), x.alias("x"), y.alias("y"), dist.alias("distance_from_center"), house.alias("inhouse"), F.lit(1).alias("insheet"))
    # A shot without stones has one row of nulls
    stones = shots.select(*key, "page_no", "image_no", "number").join(stones, [*PAGE, "image_no"], "left").drop("page_no", "image_no")
    return {"events": of_event, "games": games, "ends": ends.drop("hammer"), "shots": shots.drop("page_no", "image_no"), "stones": stones, "quarantine": quarantine}


def new_events(found: DataFrame, known: DataFrame) -> DataFrame:
    """Events whose name no known event has; of files of one name the first by doc_id. By a merge join, as the window has dealt by name already and known names may be too many for the driver."""
    first = found.withColumn("__n", F.row_number().over(W.partitionBy("name").orderBy("doc_id"))).where("__n = 1").drop("__n")
    return first.join(known.select("name").hint("merge"), "name", "left_anti")


#: How many of game_seq, end_no and number are a table's key behind doc_id, and where it keeps its parent's id.
DEPTH = {"games": 1, "ends": 2, "shots": 3, "stones": 3}
PARENT = {"games": "event_id", "ends": "game_id", "shots": "end_id", "stones": "shot_id"}
#: Events that one task sums up.
BLOCK = 10_000


def with_ids(book: dict[str, DataFrame], known: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """The five tables with dense ids (W9, J9, K3, K4, K6, P14). known: the largest id that each table already has. Rows without a parent are left out and take no id; of parents of one key the last one gets the children.

    Each table is shuffled by document, while its rows are narrow, and keeps that order of partitions in the union. There parents are sorted before what is theirs and rows get numbers within the document; a second shuffle, by event, adds how many rows all events before have.
    """
    at = lambda name: (known or {}).get(name, 0)
    events = staged(dense_ranks(book["events"], ["doc_id"], at("events")), "ids-events")
    keys, kind = ["game_seq", "end_no", "shot_no"], F.col("__t")
    # by a merge join, whatever the events' size: what a broadcast join gives would be shuffled behind the union, with the columns of all tables
    of_event, every = events.select("doc_id", F.col("id").alias("event_id")).hint("merge"), None
    rest = {name: [c for c in layout(name, True) if c not in ("id", PARENT[name]) and (name, c) != ("shots", "number")] for name in DEPTH}  # a shot's number is its key
    for t, (name, depth) in enumerate(DEPTH.items(), 1):
        df, own = book[name], [F.col(c).alias(k) for c, k in zip(["game_seq", "end_no", "number"][:depth], keys, strict=False)]
        df = df.join(of_event, "doc_id").select("doc_id", "event_id", F.lit(t).alias("__t"), *own, F.struct(*(F.col(c).cast(TABLES[name][c].dataType).alias(c) for c in rest[name])).alias(name))
        every = df if every is None else every.unionByName(df, allowMissingColumns=True)
    so_far = W.partitionBy("doc_id").orderBy(*keys, "__t", *(f"stones.{c}" for c in ("color", "x", "y", "distance_from_center"))).rowsBetween(W.unboundedPreceding, 0)
    met = every.withColumns({f"__{t}": F.last(F.when(kind == t, F.struct(*keys[:t])), ignorenulls=True).over(so_far) for t in (1, 2, 3)})
    # a row stays if the last game, end and shot have its key; a null is nobody's key
    same = [F.lit(True)] + [F.coalesce(functools.reduce(Column.__and__, (F.col(f"__{t}")[k] == F.col(k) for k in keys[:t])), F.lit(False)) for t in (1, 2, 3)]
    whole = ((kind <= 1) | same[1]) & ((kind <= 2) | same[2]) & ((kind <= 3) | same[3])
    met = met.where(whole).withColumns({f"__n{t}": F.count_if(kind == t).over(so_far) for t in (1, 2, 3, 4)})
    nth = lambda up: F.element_at(F.array(F.lit(0).cast("long"), *(f"__n{t}" for t in (1, 2, 3, 4))), kind + 1 - up).cast("int")
    met = staged(met.select("event_id", "__t", nth(0).alias("__own"), nth(1).alias("__up"), "shot_no", *DEPTH), "numbered")
    starts = _starts(met, [at(name) for name in DEPTH])
    out = {"events": events}
    for t, name in enumerate(DEPTH, 1):
        df = met.where(kind == t).select("event_id", "__own", "__up", F.col("shot_no").alias("number") if name == "shots" else F.lit(t).alias("__t"), f"{name}.*")
        df = df.join(starts.select("event_id", f"__s{t}", F.col(f"__s{t - 1}" if t > 1 else "event_id").alias("__before")).hint("merge"), "event_id")
        out[name] = df.withColumn("id", F.col(f"__s{t}") + F.col("__own")).withColumn(PARENT[name], F.col("event_id") if t == 1 else F.col("__before") + F.col("__up"))
    return {name: fitted(df, name) for name, df in out.items()}


def _starts(met: DataFrame, known: list[int]) -> DataFrame:
    """event_id, and for each of the tables below events (__s1 to __s4) the largest id that is taken before the event's first. Blocks of events are summed up, then the events of each block."""
    kinds = range(1, len(known) + 1)
    counts = met.groupBy("event_id").agg(*(F.count_if(F.col("__t") == t).alias(f"__c{t}") for t in kinds)).withColumn("__block", F.floor(F.col("event_id") / BLOCK))
    counts = staged(counts, "counts")
    before = lambda c, w: F.sum(c).over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col(c)
    blocks = counts.groupBy("__block").agg(*(F.sum(f"__c{t}").alias(f"__b{t}") for t in kinds))
    blocks = blocks.select("__block", *((before(f"__b{t}", W.orderBy("__block")) + F.lit(known[t - 1])).alias(f"__b{t}") for t in kinds))
    inside = counts.select("event_id", "__block", *(before(f"__c{t}", W.partitionBy("__block").orderBy("event_id")).alias(f"__c{t}") for t in kinds))
    return staged(inside.join(F.broadcast(blocks), "__block").select("event_id", *((F.col(f"__c{t}") + F.col(f"__b{t}")).alias(f"__s{t}") for t in kinds)), "starts")


def q_page_kinds(spark, d):
    pages = table(spark, d, "documents").select("doc_id", "text")
    return page_kinds(pages, " in ", " de ").select("doc_id", "kind")


def _ends_and_pages(spark, d):
    """Ends 1 to 4 of each user's games, and the pages that show them, from events."""
    e = table(spark, d, "events")
    kinds = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("page_no"), F.when(F.col("event_type") == "signup", "game").when(F.col("event_type") == "view", "detail").alias("kind")).where("kind is not null")
    seq, early = numbered_pages(kinds)
    ends = seq.where("kind = 'game'").select("doc_id", "game_seq", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("number"))
    return ends, seq.where("kind = 'detail'"), early


def q_end_pages(spark, d):
    """The page of each end, null if none shows it."""
    ends, detail, _ = _ends_and_pages(spark, d)
    pages = detail.select("doc_id", "game_seq", F.col("end_no").cast("int").alias("number"), F.col("page_no").alias("page"))
    return ends.join(pages, ["doc_id", "game_seq", "number"], "left").select("doc_id", F.col("game_seq").cast("long").alias("game_seq"), "number", "page")


def q_page_quarantine(spark, d):
    """Detail pages before any game, and those of ends that their game doesn't have."""
    ends, detail, early = _ends_and_pages(spark, d)
    extra = detail.join(ends, (detail["doc_id"] == ends["doc_id"]) & (detail["game_seq"] == ends["game_seq"]) & (detail["end_no"] == ends["number"]), "left_anti")
    return early.select("doc_id", "page_no", F.lit("early").alias("reason")).unionByName(extra.select("doc_id", "page_no", F.lit("extra").alias("reason")))


def q_shots_per_page(spark, d):
    """A10: of each order the larger of two counts, of lines and of its customer's orders."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("a"))
    orders = table(spark, d, "orders").withColumn("b", F.count("*").over(W.partitionBy("o_custkey")))
    return orders.join(lines, "o_orderkey", "left").select("o_orderkey", F.greatest("a", "b").alias("n"))


def q_new_events(spark, d):
    """customers' segments and names made events, without those that suppliers' names have."""
    found = table(spark, d, "customer").select(F.format_string("Supplier#%09d", F.col("c_custkey") % 1000).alias("name"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("doc_id"))
    known = table(spark, d, "supplier").select(F.format_string("Supplier#%09d", F.col("s_suppkey")).alias("name"))
    return new_events(found, known).select("name", "doc_id")


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
_SEQ = """s AS (SELECT user_id AS doc_id, event_id AS page_no, event_type, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM events WHERE event_type IN ('signup', 'view')),
p AS (SELECT *, CASE WHEN event_type = 'view' THEN row_number() OVER (PARTITION BY doc_id, g ORDER BY page_no) - CASE WHEN g > 0 THEN 1 ELSE 0 END END AS n FROM s)"""
ORACLE_SQL = {
    "page_kinds": "SELECT doc_id, CASE WHEN contains(text, ' in ') THEN 'game' ELSE 'detail' END AS kind FROM documents WHERE contains(text, ' in ') OR contains(text, ' de ')",
    "end_pages": f"WITH {_SEQ} SELECT e.doc_id, CAST(e.g AS BIGINT) AS game_seq, CAST(k AS INT) AS number, p.page_no AS page FROM (SELECT doc_id, g, k FROM p, generate_series(1, 4) x(k) WHERE event_type = 'signup') e LEFT JOIN p ON p.doc_id = e.doc_id AND p.g = e.g AND p.n = e.k AND p.event_type = 'view'",
    "page_quarantine": f"WITH {_SEQ} SELECT doc_id, page_no, CASE WHEN g = 0 THEN 'early' ELSE 'extra' END AS reason FROM p WHERE event_type = 'view' AND (g = 0 OR n > 4)",
    "shots_per_page": "SELECT o_orderkey, greatest((SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey HAVING count(*) > 0), count(*) OVER (PARTITION BY o_custkey)) AS n FROM orders",
    "new_events": "SELECT 'Supplier#' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 9, '0') AS name, min(lpad(CAST(c_custkey AS VARCHAR), 9, '0')) AS doc_id FROM customer WHERE c_custkey % 1000 NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1",
}
