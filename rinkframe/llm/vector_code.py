"""Vector codes by product quantisation on whole numbers: weighted Lloyd over distinct parts.

Components become floor(1024 x), vectors are cut into PARTS consecutive parts, and a part is kept as its bytes (two for a component if all fit, else four), so that
equal parts are equal bytes. Parts are reduced by position to distinct rows with their counts, summed before they are
shuffled: a vector that is a third of all rows is one row of each task. Lloyd's rounds read the distinct rows alone: each task returns a sum for each entry that it used, and the new codebook (PARTS x ENTRIES
rows, fixed by parameters) is all that the driver sees and broadcasts. Distances are exact: products of doubles as long as all sums stay under 2**53, whole numbers beyond.

Codes and errors are joined back to the vectors by part. Parts that over one in HOT of all vectors have (at most HOT for each position, by counting) are broadcast, the
others are joined by a shuffle; sums over labels are joined back in the same way.

Defined results: vectors that are null or have a null or non-finite component are left out, and so are those whose length isn't that of the vector with the smallest id; a length that
PARTS doesn't divide is filled up with zeros; components beyond +-2**28 / 1024 stay at that bound; equal ids are ordered by their vectors, null ids come last; with fewer than ENTRIES
vectors there are as many entries; repeated rows repeat; an empty table gives no rows; columns besides id, vector and label are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkframe.session import staged

from .common import arrow_map, table

#: Fixed values of the query.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: A part or label that more than one in HOT rows have is broadcast.
HOT = 1000
BOUND = 1 << 28
#: Rows that meet the codebook in one numpy step.
STEP = 4096


def whole(vectors: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """Rows of floor(SCALE x), cut into parts: (rows, parts, width)."""
    x = np.clip(np.floor(vectors.astype(np.float64) * SCALE), -BOUND, BOUND).astype(np.int64)
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % parts)))
    return x.reshape(len(x), parts, x.shape[1] // parts)


def packed(x: np.ndarray) -> list[bytes]:
    """The bytes of each part: (rows, width)."""
    small = np.ascontiguousarray(x, "<i2").tobytes()
    size, fits = 2 * x.shape[1], (np.abs(x) < 1 << 15).all(1)
    return [small[i * size : (i + 1) * size] if ok else x[i].astype("<i4").tobytes() for i, ok in enumerate(fits.tolist())]


def unpacked(parts: list[bytes], width: int) -> np.ndarray:
    if all(len(p) == 2 * width for p in parts):
        return np.frombuffer(b"".join(parts), "<i2").reshape(len(parts), width).astype(np.int64)
    return np.array([np.frombuffer(p, "<i2" if len(p) == 2 * width else "<i4") for p in parts], np.int64).reshape(len(parts), width)


def nearest(x: np.ndarray, book: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row; ties go to the lower entry."""
    code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * most * most * max(x.shape[1], 1) < 1 << 53:
        y, c = x.astype(np.float64), book.astype(np.float64)
        near, norm = c.T * -2, (c * c).sum(1)
        for a in range(0, len(x), step):
            d = y[a : a + step] @ near + norm
            code[a : a + step] = d.argmin(1)
    else:
        for i, row in enumerate(x):
            code[i] = ((book - row) ** 2).sum(1).argmin()
    for a in range(0, len(x), step):
        error[a : a + step] = ((x[a : a + step] - book[code[a : a + step]]) ** 2).sum(1)
    return code, error


def cut(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, size: int, parts: int) -> DataFrame:
    """key (unique), id, label, parts of the vectors of `size` components."""
    rows = vectors.where(F.size(vector_col) == size).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            n = batch.num_rows
            x = whole(batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(n, size), parts)
            each = np.array([packed(x[:, p]) for p in range(parts)], object).T.ravel().tolist()
            found = pa.ListArray.from_arrays(pa.array(range(0, n * parts + 1, parts), pa.int32()), pa.array(each, pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(number + np.arange(n)), batch.column("id"), batch.column("label"), found], ["key", "id", "label", "parts"])
            number += n

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return arrow_map(rows, run, f"key bigint, id {kinds['id']}, label {kinds['label']}, parts array<binary>")


def learn(distinct: DataFrame, book: np.ndarray, rounds: int) -> np.ndarray:
    """Lloyd's rounds over distinct parts (p, part, n); book: (parts, entries, width)."""
    parts, entries, width = book.shape
    for _ in range(rounds):
        shared = distinct.sparkSession.sparkContext.broadcast(book)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
            for batch in batches:
                place, n = batch.column("p").to_numpy(), batch.column("n").to_numpy()
                for p in range(parts):
                    at = np.flatnonzero(place == p)
                    x = unpacked(batch.column("part").take(pa.array(at)).to_pylist(), width)
                    code, _ = nearest(x, shared.value[p])
                    np.add.at(total[p], code, x * n[at, None])
                    np.add.at(count[p], code, n[at])
            p, e = np.nonzero(count)
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * width, pa.int32()), pa.array(total[p, e].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), sums], ["p", "entry", "n", "sums"])

        got = arrow_map(distinct, run, "p int, entry int, n bigint, sums array<bigint>").groupBy("p", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width))).alias("sums"))
        book = book.copy()
        for r in got.collect():  # a row for each entry
            book[r.p, r.entry] = np.array(r.sums, np.int64) // r.n
    return book


def coded(distinct: DataFrame, book: np.ndarray) -> DataFrame:
    """distinct (p, part, n) with code and error."""
    shared = distinct.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, code, error = batch.column("p").to_numpy(), np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for p in range(len(book)):
                at = np.flatnonzero(place == p)
                code[at], error[at] = nearest(unpacked(batch.column("part").take(pa.array(at)).to_pylist(), shared.value.shape[2]), shared.value[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], [*batch.schema.names, "code", "error"])

    return arrow_map(distinct.select("p", "part", "n"), run, "p int, part binary, n bigint, code int, error bigint")


def met(rows: DataFrame, of: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows joined with `of`, which has one row for each key (null keys too) and the number n of rows that have it. Keys of over a HOTth of the rows, at most HOT for each of what `total` counts, are broadcast."""
    named = of.select(*(F.col(c).alias(f"__{c}") for c in on), *(c for c in of.columns if c not in on))
    same: Column = F.lit(True)
    for c in on:
        same = same & rows[c].eqNullSafe(named[f"__{c}"])
    often = named.where(F.col("n") * HOT > total)
    hot = rows.join(F.broadcast(often), same)
    cold = rows.join(F.broadcast(often.select(*(f"__{c}" for c in on))), same, "left_anti").join(named.where(F.col("n") * HOT <= total), same)
    return hot.unionByName(cold).drop("n", *(f"__{c}" for c in on))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code (hex), error, label_error) of each kept vector, the codebooks: (parts, entries, width))."""
    good = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.coalesce(good, F.lit(False)))
    order = [F.asc_nulls_last(id_col), F.col(vector_col)]
    size = len((kept.orderBy(*order).select(vector_col).first() or [[]])[0])
    first = np.array([r[0] for r in kept.where(F.size(vector_col) == size).orderBy(*order).limit(entries).select(vector_col).collect()], np.float64)
    first = first.reshape(len(first), size)
    rows = staged(cut(kept, id_col, vector_col, label_col, size, parts), "vectors")
    each = rows.select("key", "id", "label", F.posexplode("parts").alias("p", "part"))
    distinct = staged(each.groupBy("p", "part").agg(F.count("*").alias("n")), "distinct-parts")
    book = learn(distinct, whole(first, parts).transpose(1, 0, 2), rounds) if len(first) else np.zeros((parts, 0, 0), np.int64)
    known, total = staged(coded(distinct, book), "coded-parts"), rows.count()
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")
    place = F.array_sort(F.collect_list(F.struct("p", digits(F.col("code")).alias("code"))))["code"]
    found = met(each, known, ["p", "part"], total).groupBy("key").agg(F.first("id").alias("id"), F.first("label").alias("label"), F.array_join(place, "").alias("code"), F.sum("error").alias("error"))
    found = staged(found.drop("key"), "codes")
    labels = staged(found.groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")), "label-errors")
    return met(found, labels, ["label"], total).select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error"), book


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def op13_vector_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, book = compress(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))


def op13_sql(width: int = 16) -> str:
    """The same in DuckDB's SQL, for vectors of PARTS x width components: five times the nearest of all entries, four times the means."""
    assign = lambda book: f"SELECT p, part, n, d.w.e AS e, CAST(d.w.d AS BIGINT) AS error FROM (SELECT p, part, n, min({{'d': list_inner_product(f, f) - 2 * list_inner_product(f, c) + list_inner_product(c, c), 'e': e}}) AS w FROM parts JOIN {book} USING (p) GROUP BY ALL) d"
    steps = [f"c0 AS MATERIALIZED (SELECT p, k - 1 AS e, part AS c FROM cut WHERE k <= {ENTRIES})"]
    for r in range(ROUNDS):
        steps.append(f"a{r} AS MATERIALIZED ({assign(f'c{r}')})")
        steps.append(f"m{r} AS (SELECT p, e, i, sum(n * part[i])::BIGINT AS s, sum(n)::BIGINT AS n FROM a{r}, generate_series(1, {width}) g(i) GROUP BY ALL)")
        steps.append(f"n{r} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS m FROM m{r} GROUP BY ALL)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, c) AS c FROM c{r} LEFT JOIN n{r} USING (p, e))")
    return f"""WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS k, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT k, p, v[p * {width} + 1 : p * {width} + {width}] AS part FROM k, generate_series(0, {PARTS - 1}) g(p)),
parts AS MATERIALIZED (SELECT p, part, part AS f, count(*) AS n FROM cut GROUP BY ALL),
{", ".join(steps)}, z AS MATERIALIZED ({assign(f'c{ROUNDS}')}),
h AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, i, c[i] AS x FROM c{ROUNDS}, generate_series(1, {width}) g(i))),
o AS (SELECT k, string_agg(lower(lpad(hex(e), 2, '0')), '' ORDER BY p) AS code, sum(error)::BIGINT AS error FROM cut JOIN z USING (p, part) GROUP BY k)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM o JOIN k USING (k), h"""
