"""Benchmark decontamination by winnowing.

Both sides keep the minimum k-gram hash of every sliding window of w word k-grams. A span of
w + k - 1 shared words therefore always leaves one fingerprint in common, wherever it lies. The
fingerprints are joined, and each hit is extended to the windows around it that the items have too, over the words themselves,
so that the result is exact: hashes only propose. Equal windows of the items are one entry with its items, so
repeated words make no more pairs than a document has windows.

The test side is the small one. Its fingerprints are broadcast in blocks of at most BLOCK_BYTES of
item text (items are dealt to blocks by a hash, after their bytes have been summed); each block is
one narrow pass over the training side, chained to the one before. So nothing of the training
side is shuffled or collected, no key is hot, and a lost task is simply run again.

Defined results: null or wordless texts have no words and are clean; null or wordless items match
nothing; a null item_id is written as the empty string; repeated rows each give a row, with the
same values; empty tables give no rows or clean ones. Extra columns of either table are ignored; columns to keep
mustn't have names of results (an error).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Words, arrow_map, lookup_of, steps, table

#: Word bytes after lower-casing: digits, letters, and all of UTF-8 beyond ASCII.
LOOKUP = lookup_of(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Words of a window that has to be found, and words in a k-gram.
SPAN, K = 10, 5
#: Bytes of item text in one broadcast block (a proven bound; more text means more blocks).
BLOCK_BYTES = 4 << 20
FILTER_BITS = 22


def winnow(words: Words, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are minimal in some window of span words (ties are all kept)."""
    w = span - k + 1
    grams, ok = words.grams(k)
    _, whole = words.grams(span)
    n = len(grams)
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    least = grams[: n - w + 1].copy()
    for j in range(1, w):
        np.minimum(least, grams[j : n - w + 1 + j], out=least)
    least = np.where(whole[: len(least)], least, U64(0))
    most = np.zeros(n, U64)
    for j in range(w):
        part = most[j : j + len(least)]
        np.maximum(part, least, out=part)
    at = np.flatnonzero((grams == most) & ok)
    return at, grams[at]


class Windows:
    """The windows of n words of a block of items: distinct ones, with their items."""

    def __init__(self, w: Words, ids: np.ndarray, at: np.ndarray, n: int):
        self.n = n
        _, first, group = np.unique(ids[at[:, None] + np.arange(n)], axis=0, return_index=True, return_inverse=True)
        grams = w.grams(n)[0][at]
        order = np.argsort(grams[first], kind="stable")
        self.grams, self.place = grams[first][order], at[first][order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        pairs = np.unique(np.stack([rank[group.ravel()], w.doc[at]], 1), axis=0)
        self.edge, self.items = np.searchsorted(pairs[:, 0], np.arange(len(order) + 1)), pairs[:, 1]


class Fingerprints:
    """One block of test items: fingerprints, and the windows to extend hits to."""

    def __init__(self, ids: list[str], texts: list[str | None], span: int = SPAN, k: int = K):
        self.ids, self.span, self.k = ids, span, k
        w = Words(pa.array(texts, pa.string()), LOOKUP)
        self.word_ids = w.ids()
        self.number = {w.word(i): x for i, x in zip(range(len(w.start)), self.word_ids.tolist(), strict=True)}
        n = np.diff(w.first)
        self.tables = []
        for size in sorted({int(x) for x in n if 0 < x < span} | {0}):
            if size:  # an item of fewer words is one window: all grams of that many words are compared
                at = w.first[:-1][n == size]
                grams, windows = w.grams(size)[0][at], Windows(w, self.word_ids, at, size)
            else:
                grams = winnow(w, k, span)[1]
                windows = Windows(w, self.word_ids, np.flatnonzero(w.grams(span)[1]), span)
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[(grams & U64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
            self.tables.append((size, np.unique(grams), windows, bits))

    def hits(self, w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(words, first words in w, rank, items) of windows that the items have: items[i] are those of first words[rank[i]]."""
        for size, grams, windows, bits in self.tables:
            if not len(grams):
                continue
            if size:
                found, ok = w.grams(size)
                at = np.flatnonzero(ok)
                found = found[at]
            else:
                at, found = winnow(w, self.k, self.span)
            near = bits[(found & U64((1 << FILTER_BITS) - 1)).astype(np.int64)]
            at, found = at[near], found[near]
            # the join of fingerprints
            at = at[grams[np.minimum(np.searchsorted(grams, found), len(grams) - 1)] == found]
            if not len(at):
                continue
            # each hit reaches the windows that hold it
            n = windows.n
            starts = np.unique((at[:, None] - np.arange(1 if size else n - self.k + 1)).ravel())
            starts = starts[starts >= 0]
            whole, ok = w.grams(n)
            starts = starts[ok[starts]]
            lo, hi = (np.searchsorted(windows.grams, whole[starts], side) for side in ("left", "right"))
            many = hi - lo
            mine = np.repeat(starts, many)
            theirs = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
            words = np.unique(mine[:, None] + np.arange(n))
            known = np.array([self.number.get(w.word(i), -1) for i in words.tolist()], np.int64)
            own = known[np.searchsorted(words, mine[:, None] + np.arange(n))]
            same = (own == self.word_ids[windows.place[theirs][:, None] + np.arange(n)]).all(1)
            mine, theirs = mine[same], theirs[same]
            items = windows.edge[theirs + 1] - windows.edge[theirs]
            yield n, mine, np.repeat(np.arange(len(mine)), items), windows.items[np.repeat(windows.edge[theirs] - np.cumsum(items) + items, items) + np.arange(items.sum())]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Fingerprints]:
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = part.toArrow()
        yield Fingerprints([x or "" for x in rows.column(0).to_pylist()], rows.column(1).to_pylist())


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, columns `keep`, text, n_words, n_hit (words in the union of runs), runs (first word, end), items (ids with a window in it, sorted)."""
    if clash := {"n_words", "n_hit", "runs", "items"} & {id_col, text_col, *keep}:
        raise ValueError(f"columns to keep have names of results: {sorted(clash)}")
    spark: SparkSession = documents.sparkSession
    extra = [c for c in keep if c not in (id_col, text_col)]
    df = documents.select(
        id_col, *extra, text_col, F.lit(0).cast("long").alias("__words"), F.lit(0).cast("long").alias("__hit"), F.expr("cast(array() as array<bigint>)").alias("__runs"), F.expr("cast(array() as array<string>)").alias("__items")
    )
    for block in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches, text_col):
                w = Words(batch.column(text_col), LOOKUP)
                runs, items = batch.column("__runs").to_pylist(), batch.column("__items").to_pylist()
                for n, starts, rank, found in shared.value.hits(w):
                    for at, doc in zip(starts.tolist(), w.doc[starts].tolist(), strict=True):
                        a = at - int(w.first[doc])
                        if runs[doc] and runs[doc][-2] <= a <= runs[doc][-1]:
                            runs[doc][-1] = max(runs[doc][-1], a + n)
                        else:
                            runs[doc] += [a, a + n]
                    for doc, item in np.unique(np.stack([w.doc[starts][rank], found], 1), axis=0).tolist():
                        items[doc].append(shared.value.ids[item])
                now = {"__words": pa.array(np.diff(w.first)), "__hit": pa.array([covered(x) for x in runs], pa.int64()), "__runs": pa.array(runs, pa.list_(pa.int64())), "__items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([now.get(c, batch.column(i)) for i, c in enumerate(batch.schema.names)], batch.schema.names)

        df = arrow_map(df, run, df.schema)
    return df.select(id_col, *extra, text_col, F.col("__words").alias("n_words"), F.col("__hit").alias("n_hit"), F.col("__runs").alias("runs"), F.array_sort(F.array_distinct("__items")).alias("items"))


def covered(runs: list[int]) -> int:
    """Words inside the union of runs [a, b, a, b, ...]."""
    total, upto = 0, 0
    for a, b in sorted(zip(runs[::2], runs[1::2], strict=True)):
        total += max(0, b - max(a, upto))
        upto = max(upto, b)
    return total


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of decontaminate()."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = f"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE {_WORDS} END AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS g
        FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g
        FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, pos.n, i, item FROM pos JOIN win ON pos.n = win.n AND pos.g = win.g),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS x FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
