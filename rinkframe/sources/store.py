"""A store of the five tables, in which a run's events appear all at once or not at all.

    root/<table>/commit=<name>/part-...     what a run has written
    root/_rejected/commit=<name>/part-...   the events that it didn't take, and why
    root/_commits/00000007.json             the seventh commit: its name, rows and largest id of each table; its events are in its folder

A run writes its rows under a name of its own and then its manifest, whose number is one more than the last: that one rename is the commit. Readers list
manifests and read the folders that these name; what a run left that was killed, cancelled or failed isn't seen by anybody and is removed by discard(). Of
two runs that meet, the second finds its number taken, drops what it wrote and numbers its rows anew behind the first.

Names of events are unique (K2): an event whose name is known isn't taken, and neither are its games, ends, shots and stones; they are listed as rejected. So a
repeated run adds nothing. Events, names and lists of them may be millions: they stay in files, and joins of them are merge joins, as Spark takes a side for small by the size
of its packed files and would build it in the driver. Dense ids (W9) go on behind the largest committed ones.

Defined results: an event without a name is rejected; of events with one name in a run the first by doc_id is taken; children without an accepted event are left out;
a run without accepted events commits nothing; reading a store without commits gives empty tables; an empty root that isn't a store is an error.
"""

from __future__ import annotations

import functools
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinkframe.plans import book as books
from rinkframe.schemas import TABLES, layout
from rinkframe.session import hadoop, scratch, shared_folder, staged, table

#: Runs that may meet before one gives up.
ATTEMPTS = 20
#: Where the lists of rejected events are.
REJECTED = "_rejected"


class Conflict(Exception):
    """Another run has made the commit of this number."""


@dataclass
class Outcome:
    """commit: its name, or None if there was nothing to add; rows: of each table; lost: rejected events (doc_id, name, reason), kept in the store, until discard() if there is no commit."""

    commit: str | None
    rows: dict[str, int]
    lost: DataFrame | None = None

    @functools.cached_property
    def rejected(self) -> list[tuple[str | None, str | None, str]]:
        """All of lost in the driver, by doc_id and name; for many events, use lost."""
        return [tuple(r) for r in self.lost.orderBy("doc_id", "name").collect()] if self.lost is not None else []


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # files

    def _list(self, path: str) -> list[str]:
        fs, at = hadoop(self.spark, path)
        return [str(x.getPath().getName()) for x in fs.listStatus(at)] if fs.exists(at) else []

    def _delete(self, path: str) -> None:
        fs, at = hadoop(self.spark, path)
        fs.delete(at, True)

    def _write_new(self, path: str, text: str) -> None:
        """A whole file under a name that nobody has yet: written aside, then renamed; Conflict if the name is taken."""
        fs, aside = hadoop(self.spark, f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(aside, jvm.org.apache.hadoop.fs.Path(path), options)
        except Exception as e:
            fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(path) from e
            raise

    # manifests

    def create(self, mixed: bool = False) -> Store:
        """K1: a new store; an error if there is one. mixed: whether ends have power plays."""
        fs, at = hadoop(self.spark, f"{self.root}/_commits")
        fs.mkdirs(at)
        try:
            self._write_new(f"{self.root}/_commits/{0:08d}.json", json.dumps({"mixed": mixed}))
        except Conflict:
            raise FileExistsError(self.root) from None
        return self

    def commits(self) -> list[dict]:
        """All manifests in their order, the store's own first."""
        names = sorted(n for n in self._list(f"{self.root}/_commits") if n.endswith(".json"))
        if not names:
            raise FileNotFoundError(f"{self.root} is no store")
        found = []
        for n in names:
            fs, at = hadoop(self.spark, f"{self.root}/_commits/{n}")
            stream = fs.open(at)
            try:
                found.append(json.loads(bytes(stream.readAllBytes()).decode()))
            finally:
                stream.close()
        return found

    # tables

    def schema(self, name: str, mixed: bool) -> T.StructType:
        return T.StructType([f for f in TABLES[name] if f.name in layout(name, mixed)])

    def read(self, name: str, commits: list[dict] | None = None) -> DataFrame:
        """The committed rows of a table."""
        first, *rest = self.commits() if commits is None else commits
        schema = self.schema(name, first["mixed"])
        paths = [f"{self.root}/{name}/commit={c['commit']}" for c in rest if c["rows"][name]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def counts(self) -> dict[str, int]:
        """A1: committed rows of each table, as the manifests have them."""
        return {name: sum(c["rows"][name] for c in self.commits()[1:]) for name in TABLES}

    def publish(self, book: dict[str, DataFrame], run: str | None = None) -> Outcome:
        """Adds the events of a book (tables under natural keys, see plans.book.build) that are new, with all that belongs to them, as one commit. run: a name under which this is done once; if it is committed already, nothing is added."""
        for _ in range(ATTEMPTS):
            with scratch(self.spark):
                try:
                    return self._publish(book, run)
                except Conflict:
                    continue
        raise Conflict(f"{ATTEMPTS} runs were faster")

    def _publish(self, book: dict[str, DataFrame], run: str | None) -> Outcome:
        commits, name = self.commits(), uuid.uuid4().hex
        if run is not None and any(c.get("run") == run for c in commits):
            return Outcome(None, dict.fromkeys(TABLES, 0))
        found = staged(book["events"], "events")
        taken = staged(books.new_events(found.where("name is not null"), self.read("events", commits)), "new-events")
        own = book | {"events": taken}  # what belongs to others has no parent here
        largest = {t: max((c["largest"][t] for c in commits[1:]), default=0) for t in TABLES}
        rows, last = {}, {}
        try:
            lost = self._reject(found, taken, name)
            if taken.isEmpty():
                return Outcome(None, dict.fromkeys(TABLES, 0), lost)
            for t, df in books.with_ids(own, largest).items():
                path = f"{self.root}/{t}/commit={name}"
                df.select(*layout(t, commits[0]["mixed"])).write.parquet(path)
                got = self.spark.read.schema(df.schema).parquet(path).agg(F.count("*"), F.max("id")).first()
                rows[t], last[t] = got[0], max(got[1] or 0, largest[t])
            self._write_new(f"{self.root}/_commits/{len(commits):08d}.json", json.dumps({"commit": name, "run": run, "rows": rows, "largest": last}))
        except Exception:
            for t in (*TABLES, REJECTED):  # K9: a failed run leaves nothing; of a killed one discard() takes what it left
                self._delete(f"{self.root}/{t}/commit={name}")
            raise
        return Outcome(name, rows, lost)

    def _reject(self, found: DataFrame, taken: DataFrame, name: str) -> DataFrame:
        """The events that weren't taken, written beside the tables."""
        reason = F.when(F.col("name").isNull(), "no name").otherwise("name is taken")
        lost = found.join(taken.select("doc_id", "name").hint("merge"), ["doc_id", "name"], "left_anti").select("doc_id", "name", reason.alias("reason"))
        path = f"{self.root}/{REJECTED}/commit={name}"
        lost.write.parquet(path)
        return self.spark.read.schema(lost.schema).parquet(path)

    def discard(self) -> list[str]:
        """Removes what was never committed, and returns the commits' names; lists of runs that only rejected go without a name. Not to be run beside a run that writes."""
        known = {c["commit"] for c in self.commits()[1:]}
        gone = []
        for t in (*TABLES, REJECTED):
            for folder in self._list(f"{self.root}/{t}"):
                if folder.startswith("commit=") and folder[7:] not in known:
                    self._delete(f"{self.root}/{t}/{folder}")
                    if t != REJECTED:
                        gone.append(folder[7:])
        for n in self._list(f"{self.root}/_commits"):
            if n.endswith(".tmp"):
                self._delete(f"{self.root}/_commits/{n}")
        return sorted(set(gone))


def _stand_in(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Customers are events, their orders games, order lines ends, and the lines' parts and suppliers shots and stones."""
    doc = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    customers = table(spark, d, "customer").select("c_custkey", doc.alias("doc_id"), F.col("c_name").alias("name"))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("game_seq"))
    games = customers.join(orders.hint("merge"), "c_custkey").select("doc_id", "game_seq")
    lines = games.join(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "game_seq").hint("merge"), "game_seq")
    null = lambda kind: F.lit(None).cast(kind)
    key = ["doc_id", "game_seq", F.col("l_linenumber").cast("int").alias("end_no")]
    shots = lines.select(*key, F.col("l_partkey").cast("int").alias("number")).distinct()
    # the lines are joined once; the first shot of an end stands for it
    first = F.row_number().over(W.partitionBy("doc_id", "game_seq", "end_no").orderBy("number")) == 1
    shots = staged(shots.withColumn("first", first), "lines")
    ends, shots = shots.where("first").drop("first", "number"), shots.drop("first")
    return {
        "events": customers.select("doc_id", "name", null("int").alias("year"), F.when(F.col("c_custkey") % 3 == 0, "Men").alias("category")),
        "games": games.withColumns({"page": (F.col("game_seq") % 100).cast("int")} | {f"{k}_{c}": null(t) for k, t in (("team", "string"), ("final_score", "int")) for c in ("red", "yellow")}),
        "ends": ends.withColumns({"page": null("int"), "number": F.col("end_no"), "color_hammer": null("string"), "score_red": null("int"), "score_yellow": null("int"), "is_power_play": F.lit(0)}),
        "shots": shots.withColumns({c: null("string") for c in ("color", "team", "player_name", "type", "turn")} | {"percent_score": (F.col("number") % 101).cast("int")}),
        "stones": shots.withColumns({"color": F.lit("red"), "x": F.col("number").cast("double"), "y": null("double"), "distance_from_center": null("double"), "inhouse": F.lit(1), "insheet": F.lit(1)}),
    }


def q_published_tables(spark: SparkSession, d: str) -> DataFrame:
    """Customers of even keys are published, then all: those known are rejected with all that is theirs, ids go on."""
    store = Store(spark, shared_folder(spark, "store")).create(mixed=True)
    with scratch(spark):
        every = _stand_in(spark, d)
        even = {t: df.where("cast(doc_id as bigint) % 2 = 0") for t, df in every.items()}
        for book in (even, every, even):
            store.publish(book)
    parent = {"events": "year", "games": "event_id", "ends": "game_id", "shots": "end_id", "stones": "shot_id"}
    each = [store.read(t).select(F.lit(t).alias("name"), "id", F.col(p).cast("long").alias("parent"), F.col({"events": "name", "games": "page", "ends": "number", "shots": "number", "stones": "x"}[t]).cast("string").alias("value")) for t, p in parent.items()]
    return functools.reduce(DataFrame.unionByName, each).withColumn("value", F.regexp_replace("value", r"\.0$", ""))


QUERIES = {"published_tables": q_published_tables}
ORACLE_SQL = {
    "published_tables": """WITH e AS (SELECT c_custkey AS d, c_name AS v, c_custkey % 2 AS k FROM customer), ei AS (SELECT *, row_number() OVER (ORDER BY k, d) AS id FROM e),
g AS (SELECT d, k, ei.id AS p, o_orderkey AS g FROM ei JOIN orders ON o_custkey = d), gi AS (SELECT *, row_number() OVER (ORDER BY k, d, g) AS id FROM g),
n AS (SELECT DISTINCT d, k, gi.id AS p, g, l_linenumber AS n FROM gi JOIN lineitem ON l_orderkey = g), ni AS (SELECT *, row_number() OVER (ORDER BY k, d, g, n) AS id FROM n),
s AS (SELECT DISTINCT d, k, ni.id AS p, g, n, l_partkey AS s FROM ni JOIN lineitem ON l_orderkey = g AND l_linenumber = n), si AS (SELECT *, row_number() OVER (ORDER BY k, d, g, n, s) AS id FROM s)
SELECT 'events' AS name, id, CAST(NULL AS BIGINT) AS parent, v AS value FROM ei UNION ALL SELECT 'games', id, p, CAST(g % 100 AS VARCHAR) FROM gi UNION ALL SELECT 'ends', id, p, CAST(n AS VARCHAR) FROM ni
UNION ALL SELECT 'shots', id, p, CAST(s AS VARCHAR) FROM si UNION ALL SELECT 'stones', id, id, CAST(s AS VARCHAR) FROM si""",
}
