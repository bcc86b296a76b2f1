"""What builds a result book: shot records from lines, score tables, gaps, ids, flags, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from rinkframe.operators.scores import pick_table, power_plays
from rinkframe.session import table

# What the lines of a shot look like.
SCORE, TURN, PLAYER = r"^\d+%$|^-$", "^[↺↻]$", r"^[A-Z]{3}: .+$"


def parse_records(lines: DataFrame, by: list[str], order: list[str], is_score, is_turn, is_player) -> DataFrame:
    """The lines that begin a record, with its length (4 with a turn, else 3); records don't overlap.

    Candidates overlap by one line at most; in a chain of such candidates a scan from the top takes every other one.
    """
    w = W.partitionBy(*by).orderBy(*order)
    marked = lines.withColumn("__n", F.row_number().over(w)).withColumn("__s", is_score).withColumn("__t", is_turn).withColumn("__p", is_player)
    ahead = lambda c, k: F.coalesce(F.lead(c, k).over(w), F.lit(False))
    size = F.when(ahead("__s", 1) & ahead("__t", 2) & ahead("__p", 3), 4).when(ahead("__s", 1) & ahead("__p", 2), 3)
    found = marked.withColumn("length", size).where("length is not null")
    w = W.partitionBy(*by).orderBy("__n")
    before = F.lag(F.col("__n") + F.col("length")).over(w)
    chained = found.withColumn("__new", (before.isNull() | (F.col("__n") >= before)).cast("int"))
    chained = chained.withColumn("__chain", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    place = F.row_number().over(W.partitionBy(*by, "__chain").orderBy("__n"))
    return chained.withColumn("__k", place).where("__k % 2 = 1").drop("__n", "__s", "__t", "__p", "__new", "__chain", "__k")


def shots(lines: DataFrame, by: list[str], line_no: str, text: str) -> DataFrame:
    """F7-F9 on parse_records: type, score (null for a dash), turn (cw, ccw or null), team, player (all behind the first ": "), parts (2, or more if the player's line has more)."""
    w = W.partitionBy(*by).orderBy(line_no)
    near = lines.select("*", *(F.lead(text, k).over(w).alias(f"__{k}") for k in (1, 2, 3)))
    got = parse_records(near, by, [line_no], F.col(text).rlike(SCORE), F.col(text).rlike(TURN), F.col(text).rlike(PLAYER))
    line = F.when(F.col("length") == 4, F.col("__3")).otherwise(F.col("__2"))
    person = F.split(line, ": ", 2)
    turn = F.when(F.col("length") == 4, F.when(F.col("__2") == "↻", "cw").otherwise("ccw"))
    return got.select(*by, line_no, F.col(text).alias("type"), F.rtrim(F.col("__1"), F.lit("%")).try_cast("int").alias("score"), turn.alias("turn"), person[0].alias("team"), person[1].alias("player"), F.size(F.split(line, ": ", -1)).alias("parts"))


def dense_ids(df: DataFrame, key: str, width: int, offset, name: str = "id") -> DataFrame:
    """Ids in the order of a unique integer key. Ranges of `width` keys are counted and summed up, then numbered each by itself."""
    ranged = df.withColumn("__range", F.floor(F.col(key) / width))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    start = counts.withColumn("__start", F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).drop("__n")
    place = F.row_number().over(W.partitionBy("__range").orderBy(key))
    return ranged.join(start, "__range").withColumn(name, (offset + F.col("__start") + place).cast("long")).drop("__range", "__start")


def dense_ranks(df: DataFrame, key: list[str], offset: int = 0, name: str = "id") -> DataFrame:
    """Ids from offset + 1 in the order of key; rows of one document (key[0]) are numbered by themselves, behind the counts of all before. Equal keys get ids in no fixed order."""
    doc = key[0]
    counts = df.groupBy(doc).agg(F.count("*").alias("__n"))
    # a row for each document is all that meets in one place
    start = counts.withColumn("__start", F.sum("__n").over(W.orderBy(doc).rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).drop("__n")
    place = F.row_number().over(W.partitionBy(doc).orderBy(*key))
    return df.join(start.hint("merge"), doc).withColumn(name, (F.lit(offset) + F.col("__start") + place).cast("long")).drop("__start")


def q_record_parse(spark, d):
    kind = F.col("event_type")
    got = parse_records(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], kind == "click", kind == "purchase", kind == "error")
    return got.select("event_id", F.col("length").cast("int").alias("length"))


def q_shot_records(spark, d):
    """Each user's events as lines of text (scores, turns, players and others by arithmetic on event_id), parsed to shot records."""
    k, kind = F.col("event_id"), F.col("event_type")
    score = F.when(k % 5 == 0, "-").otherwise(F.concat((k % 101).cast("string"), F.lit("%")))
    player = F.concat(F.element_at(F.array(F.lit("CAN"), F.lit("SUI"), F.lit("NOR")), (k % 3 + 1).cast("int")), F.lit(": P "), k.cast("string"), F.when(k % 7 == 0, ": X").otherwise(""))
    line = F.when(kind == "click", score).when(kind == "purchase", F.when(k % 2 == 0, "↺").otherwise("↻")).when(kind == "error", player).otherwise(F.concat(kind, F.lit(" "), (k % 4).cast("string")))
    lines = table(spark, d, "events").select("user_id", "ts", "event_id", line.alias("line")).withColumn("line_no", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return shots(lines, ["user_id"], "line_no", "line")


def q_gap_topk(spark, d):
    """O2: the first k of each group, where k comes from the group's own count."""
    w = W.partitionBy("p_type")
    rows = table(spark, d, "part").withColumn("k", F.count("*").over(w) % 7 + 1).withColumn("n", F.row_number().over(w.orderBy("p_size", "p_partkey")))
    return rows.where("n <= k").select("p_type", "p_partkey", F.col("n").cast("long").alias("n"))


def q_score_table_pick(spark, d):
    """P5: the first table that has a marker cell, else the last; orders are pages and their lines cells."""
    cells = table(spark, d, "lineitem").select(F.lit("b").alias("doc_id"), F.col("l_orderkey").alias("page_no"), F.col("l_linenumber").alias("table_no"), F.when(F.col("l_returnflag") == "R", "*").alias("cell"))
    return pick_table(cells).groupBy(F.col("page_no").alias("l_orderkey")).agg(F.max("table_no").cast("long").alias("table_no"))


def q_page_backfill(spark, d):
    """Each end gets the page that shows it, if any."""
    pages = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").cast("long").alias("page"))
    return table(spark, d, "orders").join(pages, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "page")


def q_surrogate_keys(spark, d):
    known = table(spark, d, "nation").agg(F.coalesce(F.max("n_nationkey"), F.lit(0))).first()[0]
    return dense_ids(table(spark, d, "customer").select("c_custkey"), "c_custkey", 100_000, F.lit(known))


def q_flag_ends(spark, d):
    """The ends that a page's text names as power plays, as a flag of each end; nations are pages."""
    text = F.concat(F.lit("Power Play: End "), (F.col("n_nationkey") % 8 + 1).cast("string"), F.lit("   power play:  end "), (F.col("n_regionkey") + 1).cast("string"))
    nations = table(spark, d, "nation")
    named = power_plays(nations.select(F.lit("b").alias("doc_id"), F.col("n_nationkey").alias("page_no"), text.alias("text"))).distinct().select(F.col("page_no").alias("n_nationkey"), "end_no", F.lit(1).alias("power_play"))
    ends = nations.select("n_nationkey", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("end_no"))
    return ends.join(named, ["n_nationkey", "end_no"], "left").withColumn("power_play", F.coalesce("power_play", F.lit(0)))


def q_run_outcomes(spark, d):
    """Successes, whether all or some failed, and the percentage done."""
    runs = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"))
    state = F.when(F.col("errors") == F.col("total"), "failed").when(F.col("errors") > 0, "partial").otherwise("done")
    done = F.col("total") - F.col("errors")
    return runs.select("user_id", done.alias("successes"), "errors", state.alias("state"), F.floor(done * 100 / F.col("total")).cast("long").alias("percent"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
ORACLE_SQL = {
    # the scan itself: from each line, either the record that begins there is taken or the next line is tried
    "record_parse": """WITH RECURSIVE l AS (SELECT event_id, user_id, event_type AS t, row_number() OVER w AS n, lead(event_type, 1) OVER w AS a, lead(event_type, 2) OVER w AS b, lead(event_type, 3) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT event_id, user_id, n, CASE WHEN a = 'click' AND b = 'purchase' AND c = 'error' THEN 4 WHEN a = 'click' AND b = 'error' THEN 3 ELSE 0 END AS size FROM l),
scan AS (SELECT user_id, n, event_id, size FROM k WHERE n = 1 UNION ALL SELECT k.user_id, k.n, k.event_id, k.size FROM scan s JOIN k ON k.user_id = s.user_id AND k.n = s.n + greatest(s.size, 1))
SELECT event_id, CAST(size AS INT) AS length FROM scan WHERE size > 0""",
    "shot_records": """WITH RECURSIVE t AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN CASE WHEN event_id % 5 = 0 THEN '-' ELSE (event_id % 101) || '%' END WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN '↺' ELSE '↻' END
 WHEN 'error' THEN ['CAN', 'SUI', 'NOR'][event_id % 3 + 1] || ': P ' || event_id || CASE WHEN event_id % 7 = 0 THEN ': X' ELSE '' END ELSE event_type || ' ' || (event_id % 4) END AS t, event_type AS k FROM events),
l AS (SELECT user_id, t, row_number() OVER w AS n, lead(k, 1) OVER w AS a, lead(k, 2) OVER w AS b, lead(k, 3) OVER w AS c, lead(t, 1) OVER w AS ta, lead(t, 2) OVER w AS tb, lead(t, 3) OVER w AS tc FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, CASE WHEN a = 'click' AND b = 'purchase' AND c = 'error' THEN 4 WHEN a = 'click' AND b = 'error' THEN 3 ELSE 0 END AS size FROM l),
scan AS (SELECT user_id, n, size FROM k WHERE n = 1 UNION ALL SELECT k.user_id, k.n, k.size FROM scan s JOIN k ON k.user_id = s.user_id AND k.n = s.n + greatest(s.size, 1)),
r AS (SELECT k.*, CASE WHEN k.size = 4 THEN tc ELSE tb END AS p FROM scan JOIN k USING (user_id, n) WHERE scan.size > 0)
SELECT user_id, CAST(n AS INT) AS line_no, t AS type, TRY_CAST(rtrim(ta, '%') AS INT) AS score, CASE WHEN size = 4 THEN CASE WHEN tb = '↻' THEN 'cw' ELSE 'ccw' END END AS turn, split_part(p, ': ', 1) AS team, substr(p, 6) AS player, CAST(len(string_split(p, ': ')) AS INT) AS parts FROM r""",
    "gap_topk": "SELECT p_type, p_partkey, n FROM (SELECT *, count(*) OVER (PARTITION BY p_type) % 7 + 1 AS k, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS n FROM part) WHERE n <= k",
    "score_table_pick": "SELECT l_orderkey, CAST(coalesce(min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END), max(l_linenumber)) AS BIGINT) AS table_no FROM lineitem GROUP BY 1",
    "page_backfill": "SELECT o_orderkey, (SELECT CAST(min(l_linenumber) AS BIGINT) FROM lineitem WHERE l_orderkey = o_orderkey) AS page FROM orders",
    "surrogate_keys": "SELECT c_custkey, CAST((SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS id FROM customer",
    "flag_ends": "SELECT n_nationkey, CAST(e AS INT) AS end_no, CASE WHEN e = n_nationkey % 8 + 1 OR e = n_regionkey + 1 THEN 1 ELSE 0 END AS power_play FROM nation, generate_series(1, 8) g(e)",
    "run_outcomes": """SELECT user_id, count(*) - count(*) FILTER (event_type = 'error') AS successes, count(*) FILTER (event_type = 'error') AS errors, CASE WHEN bool_and(event_type = 'error') THEN 'failed' WHEN bool_or(event_type = 'error') THEN 'partial' ELSE 'done' END AS state,
CAST(floor((count(*) - count(*) FILTER (event_type = 'error')) * 100 / count(*)) AS BIGINT) AS percent FROM events GROUP BY 1""",
}
