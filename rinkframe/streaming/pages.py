"""Page sequence, end counter and last-stone side over an unbounded stream of pages, with state for each document.

The batch form numbers pages by windows (operators.sequences), which a stream can't have. Here a document's state is what it takes to go on: the number of its game, the ends
shown so far, the sides of the game's last stones and the page that comes next. Pages may come in any order and in any batches: a
page goes out as soon as all before it (from 1) have come; until then its kind waits in the state, which a book's pages bound. A document
that has been still for `idle` is closed: pages that wait behind a gap go out in their order, as if the missing ones had no kind, and the state is dropped.

Defined results: game_seq 0 is a page before any game; a page that came already, and any page of a closed document's past that comes later as its own new start, are
treated as what they are to the state: repeated page numbers are left out, and a document that comes back after it was closed begins anew; pages without a
document or number are left out; pages of no kind have no row but let those behind them go.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rinkframe.session import shared_folder, ship, table

OUT = "doc_id string, page_no int, kind string, game_seq bigint, end_no int, hammer int"
STATE = "next_page int, game_seq bigint, end_no int, hammers string, waiting string"


def hammers(start: Column, rounds: Column, mixed: Column) -> Column:
    """The side with the last stone in each end of a game: array<int>, from its start and rounds, an array of structs (a, b) with null for what isn't a number.

    P8, W3, W4: the scorer's opponent has it next, after a blank end who had it (in mixed doubles the other); the list stops behind the first end that isn't scored by both. Without a start it is empty.
    """
    begin = F.struct(F.array().cast("array<int>").alias("sides"), start.cast("int").alias("side"))

    def step(s: Column, r: Column) -> Column:
        after = F.when(r["a"] > r["b"], 1).when(r["a"] < r["b"], 0).when(r["a"].isNotNull() & r["b"].isNotNull(), F.when(mixed, 1 - s["side"]).otherwise(s["side"]))
        return F.struct(F.when(s["side"].isNull(), s["sides"]).otherwise(F.concat(s["sides"], F.array(s["side"]))).alias("sides"), F.when(s["side"].isNotNull(), after.cast("int")).alias("side"))

    return F.aggregate(rounds, begin, step, lambda s: s["sides"])


def _go(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, idle: int | None) -> Iterator[pd.DataFrame]:
    nxt, game, end, sides, waiting = state.get if state.exists else (1, 0, 0, "[]", "{}")
    sides, held, out = json.loads(sides), {int(k): v for k, v in json.loads(waiting).items()}, []
    for rows in batches:
        for page, kind, own in zip(rows["page_no"], rows["kind"], rows["hammers"], strict=True):
            if page >= nxt and page not in held:
                held[int(page)] = [None if kind is None or kind != kind else kind, None if own is None else [int(x) for x in own]]

    def take(page: int) -> None:
        nonlocal game, end, sides
        kind, own = held.pop(page)
        if kind == "game":
            game, end, sides = game + 1, 0, own or []
            out.append((key[0], page, kind, game, None, None))
        elif kind == "detail":
            end += 1
            out.append((key[0], page, kind, game, end, sides[end - 1] if game and end <= len(sides) else None))

    while nxt in held:
        take(nxt)
        nxt += 1
    if state.hasTimedOut:
        for page in sorted(held):
            take(page)
        state.remove()
    else:
        state.update((nxt, game, end, json.dumps(sides), json.dumps(held)))
        if idle is not None:
            state.setTimeoutDuration(idle)
    if out:
        doc, page_no, kinds, games, ends, of = map(list, zip(*out, strict=True))
        yield pd.DataFrame({"doc_id": doc, "page_no": page_no, "kind": kinds, "game_seq": games, "end_no": pd.array(ends, "Int32"), "hammer": pd.array(of, "Int32")})


def page_states(pages: DataFrame, idle: int | None = None) -> DataFrame:
    """pages: a stream of doc_id, page_no (from 1), kind (game, detail or null), hammers (of a game page). Columns as in OUT. idle: milliseconds after which a still document is closed."""
    ship(pages.sparkSession)
    rows = pages.where("doc_id is not null and page_no is not null").select("doc_id", "page_no", "kind", "hammers")
    timer = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("doc_id").applyInPandasWithState(lambda key, batches, state: _go(key, batches, state, idle), OUT, STATE, "append", timer)


def drain(pages: DataFrame, folder: str, idle: int | None = None) -> None:
    """The states of all pages that are there, as Parquet in folder/out. A later call with the same folder goes on with the same documents; still ones are closed when others' pages come."""
    conf, name = pages.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")  # else a stream with timers never ends, as it waits for them
    try:
        query = page_states(pages, idle).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
    query.awaitTermination()


def _stand_in(spark: SparkSession, d: str) -> DataFrame:
    """Events as pages: signups are game pages, views detail pages; rounds by arithmetic on event_id."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("doc_id"), "event_id", "event_type")
    one = e.groupBy("doc_id").agg(F.posexplode(F.array_sort(F.collect_list(F.struct("event_id", "event_type")))).alias("at", "x"))
    k = F.col("x.event_id")
    number = lambda i, by: F.when((k + i) % 11 != 0, (k * by + i * (by + 1)) % 3).cast("int")
    rounds = F.transform(F.sequence(F.lit(0), (k % 7 + 1).cast("int")), lambda i: F.struct(number(i, 5).alias("a"), number(i, 7).alias("b")))
    kind = F.when(F.col("x.event_type") == "signup", "game").when(F.col("x.event_type") == "view", "detail")
    start = F.when(k % 5 < 4, k % 2).cast("int")
    return one.select("doc_id", (F.col("at") + 1).alias("page_no"), kind.alias("kind"), F.when(kind == "game", hammers(start, rounds, F.col("doc_id").cast("int") % 2 == 0)).alias("hammers"))


def q_page_state_stream(spark: SparkSession, d: str) -> DataFrame:
    """Pages that come in four batches, dealt by a hash, so that most come before one they stand behind."""
    pages, folder = _stand_in(spark, d), shared_folder(spark, "pages")
    files = spark.sparkContext.defaultParallelism  # of a batch: all cores write and read it, and pages are made once for all batches
    pages.repartition(4 * files, "doc_id", "page_no").write.parquet(f"{folder}/in")
    drain(spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in"), folder)
    return spark.read.parquet(f"{folder}/out")


QUERIES = {"page_state_stream": q_page_state_stream}
ORACLE_SQL = {
    "page_state_stream": """WITH RECURSIVE p AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS page_no, event_id AS k, event_type AS t FROM events),
s AS (SELECT *, CAST(sum(CASE WHEN t = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS g FROM p WHERE t IN ('signup', 'view')),
n AS (SELECT *, CASE WHEN t = 'view' THEN CAST(sum(CASE WHEN t = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, g ORDER BY page_no ROWS UNBOUNDED PRECEDING) AS INT) END AS e FROM s),
r AS (SELECT doc_id, g, i + 1 AS e, CASE WHEN k % 5 < 4 THEN k % 2 END AS start, CASE WHEN (k + i) % 11 <> 0 THEN (k * 5 + i * 6) % 3 END AS a, CASE WHEN (k + i) % 11 <> 0 THEN (k * 7 + i * 8) % 3 END AS b FROM n, generate_series(0, 7) x(i) WHERE t = 'signup' AND i <= k % 7 + 1),
f AS (SELECT doc_id, g, e, start AS h, a, b FROM r WHERE e = 1 AND start IS NOT NULL
 UNION ALL SELECT r.doc_id, r.g, r.e, CASE WHEN f.a > f.b THEN 1 WHEN f.a < f.b THEN 0 WHEN CAST(f.doc_id AS INT) % 2 = 0 THEN 1 - f.h ELSE f.h END, r.a, r.b FROM f JOIN r ON r.doc_id = f.doc_id AND r.g = f.g AND r.e = f.e + 1 WHERE f.a IS NOT NULL AND f.b IS NOT NULL)
SELECT n.doc_id, page_no, CASE WHEN t = 'signup' THEN 'game' ELSE 'detail' END AS kind, n.g AS game_seq, n.e AS end_no, CAST(h AS INT) AS hammer FROM n LEFT JOIN f ON f.doc_id = n.doc_id AND f.g = n.g AND f.e = n.e""",
}
