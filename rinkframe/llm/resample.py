"""Target-distribution importance resampling on hashed word n-grams, with an integer word dictionary.

Texts are cut into chunks of up to CHUNK_BYTES (a longer text is a chunk of its own), which a Python step reduces to their distinct words, their distinct
n-grams as tuples of places in that list, and each document's counts of them; chunks are written to the shared
folder, so later steps read the same chunks whoever else is lost. Then all is DataFrame work: distinct words of all chunks get whole-numbered ids (the
dictionary, written, so that ids stay), n-grams become tuples of ids, each distinct tuple's bytes are put
together from the dictionary and hashed once into a bucket, and the buckets are joined back to the chunks that asked. So a frequent word
costs a row for each chunk, not one for each occurrence or document.

Bucket totals of both corpora (two numbers for each bucket, whose number is a parameter) give the gains, which are broadcast. A
document's weight is the sum of gains over its features; with Gumbel noise from a hash of its id the highest scores are drawn. Ranks
are made by ranges: approximate quantiles cut the scores into ranges, ranges are counted, and those that hold drawn rows are
numbered each by itself behind the counts of those above.

Defined results: null texts have no words; documents without words have weight 0; only those of `least` words or more can be drawn; ties go to the
smaller id (null last), repeated rows have ranks of their own; the noise of a null id is that of an empty one; an empty table gives no rows;
an empty target makes every t 0; columns besides id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from rinkframe.session import staged

from .common import Words, arrow_map, lookup_of, release, ship, steps, table

CHUNK_BYTES = 8 << 20
#: Ranges of scores to number by themselves.
RANGES = 256
WORD = lookup_of(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: Fixed values of the query.
GRAM, BUCKETS, LEAST, PERCENT, SEED = 1, 10_000, 20, 10, 2024


def spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The places of all spans behind each other."""
    size = end - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def binaries(words: Words, which: np.ndarray) -> pa.Array:
    """The bytes of some words."""
    start, end = words.start[which], words.end[which]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(offsets), pa.py_buffer(words.low[spans(start, end)])])


def tuples_of(ids: np.ndarray, words: Words, most: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For 1 to `most` words: the distinct tuples of word ids (a row each), and of each occurrence its document and its tuple."""
    grams, docs, found = [], [], []
    code, n, rows = ids, int(ids.max(initial=-1)) + 1, np.arange(int(ids.max(initial=-1)) + 1)[:, None]
    for k in range(1, most + 1):
        if k > 1:
            pair = code[: max(len(ids) - k + 1, 0)] * n + ids[k - 1 :]
            value, code = np.unique(pair, return_inverse=True)
            rows = np.concatenate([rows[value // max(n, 1)], (value % max(n, 1))[:, None]], 1)
        whole = words.doc[: len(code)] == words.doc[k - 1 : k - 1 + len(code)]
        used, at = np.unique(code[whole], return_inverse=True)
        grams.append(rows[used])
        docs.append(words.doc[: len(code)][whole])
        found.append(at)
    return grams, docs, found


def _chunk(batch: pa.RecordBatch, most: int) -> list:
    """words, grams, times (of each gram), ids, n_words, n_features, counts (packed: places, grams, times) of a chunk."""
    words = Words(batch.column("text"), WORD)
    _, first, ids = np.unique(words.ids(), return_index=True, return_inverse=True)
    grams, docs, found = tuples_of(ids, words, most)
    base = np.cumsum([0, *map(len, grams)])
    doc, gram = np.concatenate(docs), np.concatenate([f + b for f, b in zip(found, base, strict=False)])
    key, times = np.unique(doc * max(int(base[-1]), 1) + gram, return_counts=True)
    doc, gram = key // max(int(base[-1]), 1), key % max(int(base[-1]), 1)
    at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
    n_words = np.diff(words.first)
    n = sum(np.maximum(n_words - k, 0) for k in range(most))
    packed = np.concatenate([at, gram, times]).astype(np.uint32).tobytes()
    size = np.concatenate([np.full(len(g), g.shape[1]) for g in grams])
    flat = pa.array(np.concatenate([g.ravel() for g in grams]).astype(np.int32))
    every = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), flat)
    every = every if most > 1 else every[:0]  # grams of one word are the words
    total = np.bincount(gram, weights=times, minlength=int(base[-1])).astype(np.int64)
    return [binaries(words, first), every, pa.array(total), batch.column("id"), pa.array(n_words), pa.array(n), len(packed).to_bytes(8, "little") + pa.compress(packed, "zstd", asbytes=True)]


CHUNK = "chunk bigint, target boolean, words array<binary>, grams array<array<int>>, times array<bigint>, n_words array<bigint>, n_features array<bigint>, counts binary"


def chunks(texts: DataFrame, target: bool, most: int, size: int = CHUNK_BYTES) -> DataFrame:
    """texts (id, text) as chunks; a chunk's number is its task's and its place in it, as only one run of a task is kept."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, held_size, number = TaskContext.get().partitionId(), [], 0, 0

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            words, grams, times, ids, n_words, n, counts = _chunk(whole, most)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            columns = {"chunk": pa.array([part << 33 | number << 1 | target], pa.int64()), "target": pa.array([target]), "words": one(words), "grams": one(grams), "times": one(times), "n_words": one(n_words), "n_features": one(n), "counts": pa.array([counts], pa.binary()), "ids": one(ids)}
            return pa.RecordBatch.from_pydict(columns)

        for batch in steps(batches, "text", size):
            if held and held_size + batch.nbytes > size:
                yield out()
                held, held_size, number = [], 0, number + 1
            held.append(batch)
            held_size += batch.nbytes
        if held:
            yield out()

    schema = StructType([*texts.sparkSession.createDataFrame([], CHUNK).schema, StructField("ids", ArrayType(texts.schema["id"].dataType))])
    return arrow_map(texts, run, schema)


def buckets(made: DataFrame, most: int, n: int) -> DataFrame:
    """chunk, target, at (a gram's place in its chunk), times, bucket of all chunks' grams."""
    zipped = F.arrays_zip("words", "times") if most == 1 else F.transform("words", lambda w: F.struct(w.alias("words"), F.lit(None).cast("long").alias("times")))
    asked = made.select("chunk", "target", F.posexplode(zipped).alias("at", "x")).select("chunk", "target", "at", "x.times", F.col("x.words").alias("word"), F.monotonically_increasing_id().alias("own"))
    # a word's id is the first place that asks for it; chunks are written, so the places stay
    asked = asked.withColumn("id", F.min("own").over(W.partitionBy("word")))
    known = staged(asked.select("chunk", "target", "at", "times", "id", F.when(F.col("own") == F.col("id"), F.col("word")).alias("word")), "words")
    dictionary = known.where("word is not null").select("id", "word")
    tuple_of = [f"g{k}" for k in range(most)]
    if most == 1:  # grams are the words in their order, and the distinct ones are the dictionary
        grams, distinct = known.select("chunk", "target", "at", "times", F.col("id").alias("g0")), dictionary.select(F.col("id").alias("g0"), F.col("word").alias("__w0"))
    else:
        ids = known.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("at", "id")))["id"].alias("ids"))
        each = made.select("chunk", "target", "grams", "times").join(ids, "chunk").select("chunk", "target", "ids", F.posexplode(F.arrays_zip("grams", "times")).alias("at", "x"))
        place = lambda k: F.get("x.grams", F.lit(k))
        grams = each.select("chunk", "target", "at", "x.times", *(F.coalesce(F.get("ids", place(k)), F.lit(-1)).alias(g) for k, g in enumerate(tuple_of)))
        distinct = grams.select(*tuple_of).distinct()
        for k, g in enumerate(tuple_of):
            distinct = distinct.join(dictionary.select(F.col("id").alias(g), F.col("word").alias(f"__w{k}")), g, "left")
    text = F.col("__w0")
    for k in range(1, most):
        text = F.concat(text, F.coalesce(F.concat(F.lit(b" "), F.col(f"__w{k}")), F.lit(b"")))
    return grams.join(distinct.select(*tuple_of, (F.crc32(text) % n).cast("int").alias("bucket")), tuple_of).drop(*tuple_of)


def gains(totals: dict[tuple[bool, int], int], n: int) -> np.ndarray:
    """Of each bucket floor(1000 ln of its share in the target over its share in the corpus), both smoothed by one."""
    t, s = ([totals.get((target, b), 0) for b in range(n)] for target in (True, False))
    all_t, all_s = float(sum(t)), float(sum(s))
    return np.array([math.floor(1000 * math.log((a + 1.0) * (all_s + n) / ((b + 1.0) * (all_t + n)))) for a, b in zip(t, s, strict=True)], np.int64)


def weights(documents: DataFrame, target: DataFrame, most: int = GRAM, n: int = BUCKETS, size: int = CHUNK_BYTES) -> DataFrame:
    """id, n_words, n_features, weight of every row of documents (id, text); target: (id, text)."""
    spark = documents.sparkSession
    ship(spark)
    own = staged(chunks(documents, False, most, size), "chunks")
    wanted = staged(chunks(target, True, most, size), "target-chunks")
    answers = staged(buckets(own.drop("ids").unionByName(wanted.drop("ids")), most, n), "buckets")
    totals = {(r.target, r.bucket): r.times for r in answers.groupBy("target", "bucket").agg(F.sum("times").alias("times")).collect()}
    shared = spark.sparkContext.broadcast(gains(totals, n))
    schema = StructType([documents.schema["id"], *(StructField(c, LongType()) for c in ("n_words", "n_features", "weight"))])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("at") if right.num_rows else right
        of = shared.value[right.column("bucket").to_numpy()]
        out = []
        for row in left.to_batches():
            for i in range(row.num_rows):
                ids, n_words, features = (row.column(c)[i].values for c in ("ids", "n_words", "n_features"))
                data = row.column("counts")[i].as_py()
                packed = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd"), np.uint32).astype(np.int64)
                at, rest = packed[: len(ids) + 1], packed[len(ids) + 1 :]
                summed = np.concatenate([[0], np.cumsum(of[rest[: len(rest) // 2]] * rest[len(rest) // 2 :])])
                out.append(pa.RecordBatch.from_arrays([ids, n_words, features, pa.array(np.diff(summed[at]))], schema.fieldNames()))
        release()
        return pa.Table.from_batches(out)

    left = own.select("chunk", "ids", "n_words", "n_features", "counts").groupBy("chunk")
    return left.cogroup(answers.where("not target").select("chunk", "at", "bucket").groupBy("chunk")).applyInArrow(meet, schema)


def drawn(scored: DataFrame, percent: int = PERCENT, least: int = LEAST, ranges: int = RANGES) -> DataFrame:
    """scored (id, n_words, score, ...) and rank: 1, 2, ... of the floor(percent N / 100) highest scores among the N rows of `least` words or more, else null."""
    able = F.col("n_words") >= least
    n = scored.where(able).count()
    most = percent * n // 100
    none = F.lit(None).cast("long")
    if not most:
        return scored.withColumn("rank", none)
    found = scored.where(able).agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)], 40 * ranges)).first()[0]
    cuts = scored.sparkSession.sparkContext.broadcast(np.unique(np.array(found, np.int64)))

    @F.pandas_udf("int")
    def place(score):
        import pandas as pd

        return pd.Series(len(cuts.value) - np.searchsorted(cuts.value, score.to_numpy(), "right")).astype("int32")

    ranged = scored.withColumn("__range", F.when(able, place("score")))
    counts = {r[0]: r[1] for r in ranged.where(able).groupBy("__range").count().collect()}
    before, offsets = 0, []
    for k in range(max(counts) + 1):
        offsets.append(before)
        before += counts.get(k, 0)
    last = max(k for k, x in enumerate(offsets) if x < most)
    place_in = F.row_number().over(W.partitionBy("__range").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    top = ranged.where(F.col("__range") <= last).withColumn("rank", place_in + F.get(F.array(*map(F.lit, offsets[: last + 1])), F.col("__range")))
    top = top.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")).cast("long"))
    rest = ranged.where(F.col("__range").isNull() | (F.col("__range") > last)).withColumn("rank", none)
    return top.unionByName(rest).drop("__range")


def resample(documents: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", most: int = GRAM, n: int = BUCKETS, percent: int = PERCENT, least: int = LEAST, seed: int = SEED, size: int = CHUNK_BYTES) -> DataFrame:
    """id column, n_words, n_features, weight, score, rank of every row of documents."""
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    wanted = target.select(F.lit(0).alias("id"), F.col(target_col).alias("text"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    scored = staged(weights(rows, wanted, most, n, size).withColumn("score", F.col("weight") + noise), "scored")
    return drawn(scored, percent, least).withColumnRenamed("id", id_col)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12_SQL = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, CASE WHEN text IS NULL THEN [] ELSE {_WORDS} END AS w FROM documents),
dw AS (SELECT k, word, count(*) AS c FROM (SELECT k, unnest(w) AS word FROM d) GROUP BY ALL), bw AS (SELECT word, count(*) AS c FROM (SELECT unnest({_WORDS}) AS word FROM benchmark) GROUP BY ALL),
tab AS (SELECT {_crc_table()} AS tab),
h AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
b AS (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, v: xor(c >> 8, tab[(xor(c, v) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, tab),
s AS (SELECT bucket, sum(c) AS s FROM dw JOIN b USING (word) GROUP BY 1), t AS (SELECT bucket, sum(c) AS t FROM bw JOIN b USING (word) GROUP BY 1), n AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS all_s, coalesce((SELECT sum(t) FROM t), 0) AS all_t),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(all_s + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(all_t + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
w AS (SELECT k, CAST(sum(c * gain) AS BIGINT) AS weight FROM dw JOIN b USING (word) JOIN g USING (bucket) GROUP BY k),
r AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS x FROM d LEFT JOIN w USING (k)),
z AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((CAST(x AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM z WHERE n_features >= 20) // 100 THEN place END AS rank FROM o"""
