"""A queue of files as a stream; each micro-batch is written once under its number.

Repeated keys come once, whatever batch they come in: they are held in the stream's own state, which is spread by key, so no batch reads
what earlier ones wrote. Null keys are equal to each other. Of rows with one key any may stay.

Every row gets its place in the queue (`index`, from 1) and the length of the queue when its batch came (`total`), which grows while the queue is
drained. A batch needs only the total of the one before it, which that one left in the output; within a batch, rows are numbered in buckets of their keys'
hash, each bucket by itself behind the counts of those before, so no task gets all rows. A batch that is repeated after a failure writes the same
rows again under the same number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from rinkframe.session import shared_folder

BUCKETS = 1024
TOTALS = "batch bigint, n bigint, total bigint"


def numbered(batch: DataFrame, keys: list[str], before: int) -> DataFrame:
    """batch with index and total, behind `before` rows of earlier batches."""
    placed = batch.withColumn("__b", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    counts = placed.groupBy("__b").agg(F.count("*").alias("__n"))
    # at most BUCKETS rows meet here
    start = counts.withColumn("__start", F.sum("__n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).withColumn("total", F.sum("__n").over(W.partitionBy()) + F.lit(before)).drop("__n")
    place = F.row_number().over(W.partitionBy("__b").orderBy(*(F.asc_nulls_first(k) for k in keys)))
    return placed.withColumn("index", place).join(F.broadcast(start), "__b").withColumn("index", (F.col("index") + F.col("__start") + before).cast("long")).drop("__b", "__start")


def start(stream: DataFrame, folder: str, keys: list[str], available_now: bool = True, tell: Callable[[int, int, int], None] | None = None) -> StreamingQuery:
    """Starts to drain a stream into folder/out; with available_now it ends when all files there are have been taken. tell: called with (batch, rows, length of the queue) when a batch is done."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(TOTALS).parquet(f"{folder}/totals/batch={number - 1}").first() if number else None
        known = before["total"] if before else 0
        out = f"{folder}/out/batch={number}"
        numbered(batch, keys, known).write.mode("overwrite").parquet(out)
        n = spark.read.parquet(out).count()
        spark.createDataFrame([(number, n, known + n)], TOTALS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/totals/batch={number}")
        if tell:
            tell(number, n, known + n)

    query = stream.dropDuplicates(keys).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state")
    return (query.trigger(availableNow=True) if available_now else query).start()


def drain(stream: DataFrame, folder: str, keys: list[str], tell: Callable[[int, int, int], None] | None = None) -> None:
    """Take all files there are. A later call with the same folder goes on where this one ended."""
    start(stream, folder, keys, tell=tell).awaitTermination()


def totals(spark: SparkSession, folder: str) -> list[tuple[int, int, int]]:
    """(batch, rows, length of the queue) of every batch so far."""
    return [tuple(r) for r in spark.read.schema(TOTALS).parquet(f"{folder}/totals/*").orderBy("batch").collect()]


class Progress(StreamingQueryListener):
    """(batch, rows) of each batch that ends, for whoever shows it. For sinks of Spark's own: beside foreachBatch a listener in Python has hung, so the queue tells by itself."""

    def __init__(self, tell):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.tell(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def q_file_queue_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    folder = shared_folder(spark, "queue")
    drain(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d), folder, ["event_id"])
    return spark.read.parquet(f"{folder}/out").select(*schema.names)


def q_queue_totals(spark: SparkSession, d: str) -> DataFrame:
    """Events come in three files, one for each batch, and the last two repeat keys of the first; the length of the queue as each batch saw it."""
    folder = shared_folder(spark, "queue")
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type")
    for k in range(3):
        events.where(F.col("event_id") % 3 <= k).coalesce(1).write.parquet(f"{folder}/in/{k}")
    spark_stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    drain(spark_stream, folder, ["event_id"])
    out = spark.read.parquet(f"{folder}/out")
    return out.groupBy("total").agg(F.count("*").alias("n"), F.min("index").alias("first"), F.max("index").alias("last"), F.count_distinct("index").alias("places"))


QUERIES = {"file_queue_stream": q_file_queue_stream, "queue_totals": q_queue_totals}
ORACLE_SQL = {
    "file_queue_stream": "SELECT * FROM events",
    "queue_totals": """WITH n AS (SELECT event_id % 3 AS k, count(*) AS n FROM (SELECT DISTINCT event_id FROM events) GROUP BY 1), t AS (SELECT k, n, sum(n) OVER (ORDER BY k) AS t FROM n)
SELECT CAST(t AS BIGINT) AS total, n, CAST(t - n + 1 AS BIGINT) AS first, CAST(t AS BIGINT) AS last, n AS places FROM t""",
}
