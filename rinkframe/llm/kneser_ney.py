"""Text quality by an interpolated modified Kneser-Ney model of bytes.

The model learns from the texts of trusted rows, lower-cased in A-Z. An n-gram of up to ORDER bytes
is packed into one long (its order in the top byte), so that its prefix and suffix are shifts of
it and all of the model is DataFrame work: counts are summed in the Python step for each batch and
then by key; lower orders count distinct left extensions; the three discounts of each order come from its
counts of counts; probabilities are joined from the lowest order up. The model is never collected
or broadcast: it is a table (key, p, gamma), spread by key.

Texts are scored in chunks of up to CHUNK_BYTES: a chunk asks for its distinct n-grams once, the
requests are joined with the model by key, and the answers meet their chunk again, where numpy backs off
place by place. So a frequent n-gram costs a row for each chunk, not one for each occurrence. Chunks are made anew for both
uses, not written: a chunk's name is a digest of what it holds, and a chunk that gets no answers is an error.

A document's perplexity (per byte) is held against a quantile of its language's trusted documents that the
counts have not seen: one trusted id in HELD, by a hash, is left out of them. Documents above are not kept.

Defined results: null and empty texts have no perplexity (null) and aren't kept; languages without
held-out trusted rows (and null ones) use the quantile of all held-out trusted rows; with no such row at all, thresholds are null and all
documents with a text are kept; with no trusted row to count, perplexities are null too; rows of one id share one figure, over all their texts; texts without an id have null
perplexity and are kept; repeated rows repeat; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, checkpointed, flat, ship, steps, table

ORDER = 5
CHUNK_BYTES = 12 << 20
#: How hard zstandard packs a chunk's texts, which are most of what is shuffled.
LEVEL = 9
#: Bytes of text that one numpy step handles, also of a long document.
STEP = 1 << 20
#: Documents with a perplexity above their language's QUANTILE of trusted ones are not kept; one trusted id in HELD sets the quantile and isn't counted.
QUANTILE, HELD = 0.99, 5
#: What every chunk asks for besides its n-grams.
ASKED = 1
#: Trusted ids that are broadcast (8 bytes each).
FEW = 1_000_000
#: Bytes: A-Z in lower case, NUL (which marks what is before a text) as 1.
LOW = np.array([1, *(b + 32 if 65 <= b <= 90 else b for b in range(1, 256))], np.uint8)


def packed(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For every byte, the order-gram that ends with it, as a long; zeros are before each text."""
    low = LOW[data].astype(np.int64)
    place = np.arange(len(low)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = low.copy()
    for k in range(1, order):
        shifted = np.zeros_like(low)
        shifted[k:] = low[:-k] if k < len(low) else 0
        out |= np.where(place >= k, shifted, 0) << (8 * k)
    return out | (order << 56)


def places(data: np.ndarray, offsets: np.ndarray, order: int = ORDER, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, order-gram) of each byte, in steps; a text may be cut, its order-grams aren't."""
    for a in range(0, len(data), step):
        b, before = min(len(data), a + step), max(0, a - order + 1)
        first, last = np.searchsorted(offsets, before, "right") - 1, np.searchsorted(offsets, b, "left")
        edges = np.clip(offsets[first : last + 1], before, b) - before
        text = first + np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        yield text[a - before :], packed(data[before:b], edges, order)[a - before :]


def suffix(key, n: int):
    """Key of the n - 1 last bytes; columns and arrays alike."""
    if isinstance(key, Column):
        return key.bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)).bitwiseOR(F.lit((n - 1) << 56))
    return (key & ((1 << 8 * (n - 1)) - 1)) | ((n - 1) << 56)


def prefix(key, n: int):
    """Key of the n - 1 first bytes."""
    if isinstance(key, Column):
        return F.shiftright(key.bitwiseAND(F.lit((1 << 8 * n) - 1)), 8).bitwiseOR(F.lit((n - 1) << 56))
    return ((key & ((1 << 8 * n) - 1)) >> 8) | ((n - 1) << 56)


def counts(documents: DataFrame, text_col: str, order: int = ORDER) -> DataFrame:
    """(key, a): how often the texts have each n-gram of the highest order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            for _, grams in places(*flat(batch.column("text")), order):
                key, a = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(a.astype(np.int64))], ["key", "a"])

    found = arrow_map(documents.select(F.col(text_col).alias("text")).where("text <> ''"), run, "key long, a long")
    return found.groupBy("key").agg(F.sum("a").alias("a"))


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    if not n1 or not n2 or not n3:  # too little text for the estimate
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), i - 0.01) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))  # type: ignore[return-value]


def fit(trusted: DataFrame, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """The model (key, p, gamma): p of n-grams, gamma (the mass that backs off) of contexts; either can be null."""
    levels = {order: checkpointed(counts(trusted, text_col, order))}
    for n in range(order, 1, -1):
        # the counts of lower orders are those of distinct left extensions
        levels[n - 1] = checkpointed(levels[n].select(suffix(F.col("key"), n).alias("key")).groupBy("key").agg(F.count("*").alias("a")))
    every = functools.reduce(DataFrame.union, levels.values())
    of = {r.n: r[1:] for r in every.groupBy(F.shiftright("key", 56).alias("n")).agg(*(F.count_if(F.col("a") == i) for i in (1, 2, 3, 4))).collect()}  # a row for each order
    model, below = None, None
    for n in range(1, order + 1):
        d1, d2, d3 = _discounts(*of.get(n, (0, 0, 0, 0)))
        off = F.when(F.col("a") == 1, d1).when(F.col("a") == 2, d2).otherwise(d3)
        level = levels[n].withColumn("context", prefix(F.col("key"), n)).withColumn("off", off)
        contexts = level.groupBy("context").agg(F.sum("a").alias("total"), F.sum("off").alias("mass")).select("context", "total", (F.col("mass") / F.col("total")).alias("gamma"))
        level = level.join(contexts, "context")
        own = (F.col("a") - F.col("off")) / F.col("total")
        if below is None:
            probable = level.select("key", (own + F.col("gamma") / 256).alias("p"))
        else:
            lower = below.select(F.col("key").alias("short"), F.col("p").alias("p_short"))
            probable = level.withColumn("short", suffix(F.col("key"), n)).join(lower, "short").select("key", (own + F.col("gamma") * F.col("p_short")).alias("p"))
        below = checkpointed(probable)
        part = below.select("key", "p", F.lit(None).cast("double").alias("gamma")).union(contexts.select(F.col("context").alias("key"), F.lit(None).cast("double").alias("p"), "gamma"))
        model = part if model is None else model.union(part)
    return checkpointed(model.groupBy("key").agg(F.max("p").alias("p"), F.max("gamma").alias("gamma")))


def log_probabilities(keys: np.ndarray, known: np.ndarray, p: np.ndarray, gamma: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Natural logarithm of each n-gram's last byte after the others. known: sorted keys; p and gamma are NaN where missing."""

    def find(k: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.full(len(k), np.nan)
        at = np.minimum(np.searchsorted(known, k), len(known) - 1)
        return np.where(known[at] == k, values[at], np.nan)

    out, back = np.zeros(len(keys)), np.zeros(len(keys))
    todo = np.arange(len(keys))
    k = keys
    for n in range(order, 0, -1):
        found = find(k, p)
        hit = ~np.isnan(found)
        out[todo[hit]] = back[todo[hit]] + np.log(found[hit])
        todo, k = todo[~hit], k[~hit]
        if not len(todo):
            return out
        back[todo] += np.log(np.nan_to_num(find(prefix(k, n), gamma), nan=1.0))
        if n > 1:
            k = suffix(k, n)
    out[todo] = back[todo] - np.log(256)
    return out


def _wanted(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The distinct keys that a chunk can need: its n-grams of all orders and their contexts."""
    level = np.zeros(0, np.int64)
    for _, grams in places(data, offsets, order):
        level = pd.unique(np.concatenate([level, pd.unique(grams)]))
    out = [level]
    for n in range(order, 0, -1):
        out.append(pd.unique(prefix(level, n)))
        if n > 1:
            out.append(level := pd.unique(suffix(level, n)))
    return pd.unique(np.concatenate(out))


def _cut(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Name and rows (id, text) of chunks of up to `most` bytes or one longer document."""
    ids, texts, size = [], [], 0

    def flush() -> tuple[int, pa.RecordBatch]:
        digest = hashlib.blake2b(repr([(i, len(t)) for i, t in zip(ids, texts, strict=True)]).encode(), digest_size=8)
        for t in texts:
            digest.update(t)
        return int.from_bytes(digest.digest()) >> 1, pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.large_binary())], ["id", "text"])

    for batch in batches:
        for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(i)
            texts.append(t.encode())
            size += len(texts[-1])
            if size >= most:
                yield flush()
                ids, texts, size = [], [], 0
    if ids:
        yield flush()


def _chunks(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, pack): the chunks, packed for the shuffle."""
    for name, docs in _cut(batches, most):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as out:
            out.write_batch(docs)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "pack"])


def _unpack(pack: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(pack)))


def _scored(left: pa.Table, right: pa.Table, order: int) -> pa.Table:
    known = right.column("key").to_numpy()
    if left.num_rows and not (known == ASKED).any():
        raise RuntimeError("a chunk without answers: the documents changed between two readings")
    rank = np.argsort(known, kind="stable")
    p, gamma = (right.column(c).to_numpy(zero_copy_only=False).astype(float)[rank] for c in ("p", "gamma"))
    known = known[rank]
    ids, n_bytes, log_p = [], [], []
    for pack in left.column("pack").to_pylist():
        docs = _unpack(pack)
        data, offsets = flat(docs.column("text"))
        total = np.zeros(len(docs))
        for text, grams in places(data, offsets, order):
            # one look-up for each distinct n-gram
            at, keys = pd.factorize(grams)
            total += np.bincount(text, log_probabilities(keys, known, p, gamma, order)[at], len(docs))
        log_p.append(total)
        n_bytes.append(np.diff(offsets))
        ids.append(docs.column("id"))
    return pa.table({"id": pa.chunked_array(ids), "n_bytes": np.concatenate(n_bytes).astype(np.int64), "log_p": np.concatenate(log_p)})


def perplexities(documents: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, n_bytes, log_p) of rows with a text; one row for each row."""
    source = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text <> ''")
    chunks = arrow_map(source, lambda it: _chunks(it, chunk_bytes), "chunk long, pack binary")

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, docs in _cut(batches, chunk_bytes):
            wanted = np.append(_wanted(*flat(docs.column("text")), order), ASKED)
            for a in range(0, len(wanted), 1 << 16):
                keys = pa.array(wanted[a : a + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), name, np.int64)), keys], ["chunk", "key"])

    asked = model.sparkSession.range(1).select(F.lit(ASKED).cast("long").alias("key"), F.lit(None).cast("double").alias("p"), F.lit(None).cast("double").alias("gamma"))
    model = model.select("key", "p", "gamma").union(asked)
    answers = arrow_map(source, ask, "chunk long, key long").join(model, "key").select("chunk", "key", "p", "gamma")
    ship(documents.sparkSession)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scorer(order), "id long, n_bytes long, log_p double")


def _scorer(order: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _scored(left, right, order)

    return run


def quality(documents: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> DataFrame:
    """id_col, lang, n_bytes, perplexity, threshold and kept of every row. trusted_ids: (id_col)."""
    ids = trusted_ids.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    held = F.pmod(F.xxhash64("id"), F.lit(HELD)) == 0
    ids = checkpointed(ids)
    learned = ids.where(~held)
    # few ids go to the texts; many are met by a shuffle
    model = fit(rows.join(F.broadcast(learned) if ids.count() <= FEW else learned, "id", "left_semi"), "text", order)
    if model.isEmpty():
        scored = rows.select("id", F.lit(None).cast("long").alias("n_bytes"), F.lit(None).cast("double").alias("log_p")).limit(0)
    else:
        scored = checkpointed(perplexities(rows, model, "id", "text", order))
    # rows of one id share their figures
    by_id = scored.groupBy("id").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("log_p").alias("log_p"))
    out = rows.select("id", "lang", (F.coalesce(F.length("text"), F.lit(0)) > 0).alias("some")).join(by_id, "id", "left")
    out = out.withColumn("perplexity", F.when(F.col("some"), F.exp(-F.col("log_p") / F.col("n_bytes")))).join(ids.withColumn("trusted", F.lit(True)), "id", "left")
    out = checkpointed(out.select("id", "lang", "some", F.when(F.col("some"), F.col("n_bytes")).alias("n_bytes"), "perplexity", F.coalesce("trusted", F.lit(False)).alias("trusted")))
    good = out.where("trusted and perplexity is not null").where(held)
    of_lang = good.where("lang is not null").groupBy("lang").agg(F.percentile_approx("perplexity", QUANTILE, 10_000).alias("own"))
    of_all = good.agg(F.percentile_approx("perplexity", QUANTILE, 10_000).alias("any"))
    # a row for each language (Spark checks its size), and one row
    out = out.join(of_lang, "lang", "left").join(F.broadcast(of_all), how="left").withColumn("threshold", F.coalesce("own", "any"))
    kept = F.col("some") & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select(F.col("id").alias(id_col), "lang", F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"), "perplexity", "threshold", kept.alias("kept"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), trusted)
