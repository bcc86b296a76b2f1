"""Byte-level BPE encoding and decoding with a fixed public vocabulary.

Encoding is done once for each distinct word of a task's documents. A Python step splits the
texts by the vocabulary's pattern and writes chunks: documents as numbers of words, and the distinct
words that the task has not met before as arrays with one long for each byte. Spark's higher-order functions then
fold the ranked merges over these arrays. A long holds the rank of its part's pair with the next part, the
part's place and its key, in this order of bits; so a step of aggregate() takes the array's minimum (the lowest rank, the
leftmost of equals), joins that pair and ranks its two new neighbours. A key is an id and 1, and a place is the part's index, so that
a step searches for nothing and makes its next array in one pass. The ranks are a map laid out as one array, so
that a look-up is two element reads: the entry of (left, right) is at table[left] + right. It comes with
each chunk, as plain numbers; as a literal of the plan each task would read its objects anew. Last, a Python step
puts the documents' ids together from those of their words, and decodes each document by concatenating the binary
pieces of its ids.

All steps are narrow: nothing is shuffled or collected, and only the first step's code goes to all executors, with the
table's 3 MB; a lost task only repeats its own chunks, and a chunk is bounded by CHUNK_BYTES of text or CHUNK_WORDS new words (or one longer document). Both Python steps
run in the same task, one behind the other, so that word numbers of earlier chunks stay known; a task that is
run again builds them anew. A word that is in the vocabulary as a whole is its own token, as in the tiktoken library. The
fold is quadratic in a word's bytes, so words of over LONG_BYTES (runs without spaces, mostly hostile) are merged with
a heap in the Python step instead; the ids are the same.

Defined results: null and empty texts give no tokens; ids, order and repeated rows are kept as
they are; empty tables give no rows; extra columns are ignored unless named in `keep`, where any name
that the table has will do, but for `ids` and `decoded` (an error).
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, flat, steps, table, tokenizer_file

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are split. \\s of the reference library is Unicode's White_Space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
CHUNK_BYTES, CHUNK_WORDS = 2 << 20, 1 << 15
LONG_BYTES = 400
#: A part: rank of its pair with the next part (the key they make; UNRANKED or more if they don't merge), place, key. Keys are from 1 to LOW, that of an end is 0.
RANK_AT, PLACE_AT, LOW = 26, 16, (1 << 16) - 1
UNRANKED, LAST_PLACE = 1 << 16, (1 << RANK_AT - PLACE_AT) - 1
#: The first byte of a character beyond U+FFFF in UTF-8, or more.
FOUR_BYTES = 0xF0
#: A task forgets its words after so many.
MAX_WORDS = 1 << 20


@functools.cache
def splitter(wide: bool) -> Callable[[str], list[str]]:
    """What splits a text by PATTERN. Texts without characters beyond U+FFFF (wide: with some) are split in half the time by Python's own
    expressions, where regex says which characters are in a class."""
    import regex

    if wide:
        return regex.compile(PATTERN).findall
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 1 << 16))))
    narrow = PATTERN.replace(r"\P{White_Space}", r"[^\p{White_Space}]")
    for name in ("White_Space", "L", "N"):
        runs = "".join(f"\\u{ord(x[0]):04x}-\\u{ord(x[-1]):04x}" for x in regex.findall(rf"\p{{{name}}}+", every))
        narrow = re.sub(rf"(\[[^\]]*)?\\p{{{name}}}", lambda m, runs=runs: m[1] + runs if m[1] else f"[{runs}]", narrow)
    return re.compile(narrow).findall


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.cache
def merge_table(path: str) -> list[int]:
    """Keys a, b merge to key r if table[table[a] + b] == a << 16 | r. The bases of all keys come first, then the entries; free places are 0.

    No base points before the entries, but for that of the end, 0: it reads bases, which are no entries of key 0 either."""
    of = ranks(path)
    rows: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for word, r in of.items():
        for i in range(1, len(word)):
            a, b = of.get(word[:i]), of.get(word[i:])
            if a is not None and b is not None:
                rows[a + 1].append((b + 1, r + 1))
    last = max(of.values()) + 1
    if last > LOW:
        raise ValueError("ids beyond 16 bits")
    entries, base, taken = {}, {}, 0  # taken: a bit for each place
    for a, row in sorted(rows.items(), key=lambda x: -len(x[1])):
        # first fit: the first base from which all the row's places are free
        full = 0
        for b, _ in row:
            full |= taken >> b
        k = (~full & (full + 1)).bit_length() - 1
        base[a] = k
        for b, r in row:
            entries[k + b] = a << 16 | r
            taken |= 1 << (k + b)
    # every look-up finds an element: the last base and the last key are both within
    size = max(base.values(), default=0) + last + 1
    return [0] + [LOW + 1 + base.get(a, 0) for a in range(1, LOW + 1)] + [entries.get(i, 0) for i in range(size)]


def _let(value: Column, then) -> Column:
    """then(value), where value is computed once. The result isn't copied, as that of transform() would be."""
    return F.aggregate(F.array(F.lit(0)), value, lambda kept, _: kept, then)


def fold_merges(parts: Column, table: Column) -> Column:
    """Parts (with an end, of key 0, on both sides) after all ranked merges."""

    def rank(left: Column, right: Column) -> Column:
        # the entry of another left part, or a free place, has high bits
        return F.shiftleft(F.get(table, F.get(table, left) + right).bitwiseXOR(F.shiftleft(left, 16)), RANK_AT)

    def key(x: Column) -> Column:
        return x.bitwiseAND(F.lit(LOW))

    def step(e: Column, _: Column) -> Column:
        def merged(m: Column) -> Column:
            made = F.shiftright(m, RANK_AT)

            def at_place(at: Column, before: Column) -> Column:
                left = F.get(e, before)
                beside = rank(key(left), made).bitwiseOR(left.bitwiseAND(F.lit((1 << RANK_AT) - 1)))
                own = rank(made, key(F.get(e, at + 2))).bitwiseOR(m.bitwiseAND(F.lit(LAST_PLACE << PLACE_AT))).bitwiseOR(made)
                # slice() and concat() cost several times as much as one pass, and array_position() throws for what it finds, as no code is generated here
                nearer = lambda x, i: F.when(i < before, x).otherwise(F.when(i == at, own).otherwise(beside))
                later = F.transform(e, lambda x, i: F.when(i > at, x - (1 << PLACE_AT)).otherwise(nearer(x, i)))
                # the joined part's right half; parts of one array differ
                return F.array_remove(later, F.get(e, at + 1) - (1 << PLACE_AT))

            place = F.shiftright(m, PLACE_AT).bitwiseAND(F.lit(LAST_PLACE)).cast("int")
            return F.when(m >= UNRANKED << RANK_AT, e).otherwise(_let(place, lambda at: _let(at - 1, lambda before: at_place(at, before))))

        return _let(F.array_min(e), merged)

    return F.when(F.size(parts) < 4, parts).otherwise(F.aggregate(F.sequence(F.lit(4), F.size(parts)), parts, step))


def heap_merges(word: bytes, of: dict[bytes, int]) -> list[int]:
    """The same merges for one long word, in n log n."""
    n = len(word)
    end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        if end[i] < n and (r := of.get(word[i : end[end[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[i], end[end[i]]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        if alive[i] and end[i] == middle and end[middle] == stop:
            alive[middle] = False
            end[i] = stop
            if stop < n:
                prev[stop] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
    out, i = [], 0
    while i < n:
        out.append(of[word[i : end[i]]])
        i = end[i]
    return out


def _ragged(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of all runs behind each other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def _chunks(batches: Iterable[pa.RecordBatch], path: str, chunk_bytes: int, merges: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (docs: the other columns, codes, counts, first, words, long, merges) of one chunk each."""
    of = ranks(path)
    byte_key = np.array([of[bytes([b])] + 1 for b in range(256)], np.int64)
    pair_rank = np.full((258, 258), UNRANKED, np.int64)  # of single bytes, whose keys are from 1 to 256; 0 is the end, 257 any longer part
    for a, b in itertools.product(range(256), repeat=2):
        if (r := of.get(bytes([a, b]))) is not None:
            pair_rank[byte_key[a], byte_key[b]] = r + 1

    def flush(docs: list[pa.RecordBatch], codes: list[np.ndarray], seen: dict[str, int], first: int) -> pa.RecordBatch:
        words = [w.encode() for w in itertools.islice(seen, first, None)]
        long = [heap_merges(w, of) if len(w) > LONG_BYTES and w not in of else None for w in words]
        whole = np.array([of.get(w, -1) for w in words], np.int64)
        size = np.array([len(w) for w in words], np.int64)
        kept = np.where(whole >= 0, 1, np.where([x is None for x in long], size, 0)) if words else size
        data = byte_key[np.frombuffer(b"".join(words), np.uint8)]
        edges = np.concatenate([[0], np.cumsum(kept + 2)])
        keys = np.zeros(int(edges[-1]), np.int64)
        keys[_gather(edges[:-1] + 1, kept)] = data[_gather(np.cumsum(size) - size, kept)]
        keys[edges[:-1][whole >= 0] + 1] = whole[whole >= 0] + 1
        # a whole word has ends beside it, which merge with nothing
        rank = np.append(pair_rank[np.minimum(keys[:-1], 257), np.minimum(keys[1:], 257)], UNRANKED) if len(keys) else keys
        place = np.arange(len(keys)) - np.repeat(edges[:-1], kept + 2)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs[0].schema) as out:
            for d in docs:
                out.write_batch(d)
        nested = lambda lists: _ragged(lists, np.array([0, len(lists)]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                pa.array([np.array([len(c) for c in codes], np.int32).tobytes()], pa.binary()),
                pa.array([np.concatenate(codes).tobytes()], pa.binary()),
                pa.array([first], pa.int32()),
                nested(_ragged(pa.array(rank << RANK_AT | place << PLACE_AT | keys), edges)),
                nested(pa.array([x or [] for x in long], pa.list_(pa.int32()))) if any(long) else pa.array([[]], pa.list_(pa.list_(pa.int32()))),
                _ragged(pa.array(merges), np.array([0, len(merges)])),
            ],
            ["docs", "counts", "codes", "first", "words", "long", "merges"],
        )

    docs, codes, size = [], [], 0
    seen: dict[str, int] = defaultdict(itertools.count().__next__)
    first = 0
    for batch in batches:
        for part in steps([batch], "__text", chunk_bytes // 8):
            find = splitter(bool((flat(part.column("__text"))[0] >= FOUR_BYTES).any()))
            for text in part.column("__text").to_pylist():
                words = find(text) if text else []
                codes.append(np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
                size += len(text or "")
            docs.append(part.drop_columns(["__text"]))
            if size >= chunk_bytes or len(seen) - first >= CHUNK_WORDS:
                yield flush(docs, codes, seen, first)
                docs, codes, size = [], [], 0
                if len(seen) > MAX_WORDS:
                    seen = defaultdict(itertools.count().__next__)
                first = len(seen)
    if docs:
        yield flush(docs, codes, seen, first)


def _documents(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The documents of the chunks, with ids and decoded bytes."""
    pieces = {r: word for word, r in ranks(path).items()}
    ids, at, size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for k in range(batch.num_rows):
            lists = batch.column("words")[k].values
            edges = lists.offsets.to_numpy().astype(np.int64) if len(lists) else np.zeros(1, np.int64)
            new = lists.values.to_numpy(zero_copy_only=False)[edges[0] : edges[-1]] if len(lists) else np.zeros(0, np.int32)
            new = new - 1  # keys to ids
            new_at, new_size = edges[:-1] - edges[0] + 1, np.diff(edges) - 2  # without the ends
            long = batch.column("long")[k].as_py()
            if long:
                extra = np.array([y for x in long for y in x], np.int32)
                many = np.array([len(x) for x in long], np.int64)
                new_at, new_size = np.where(many > 0, len(new) + np.cumsum(many) - many, new_at), np.where(many > 0, many, new_size)
                new = np.concatenate([new, extra])
            first = batch.column("first")[k].as_py()
            if first == 0:
                ids, at, size = new, new_at, new_size
            elif first == len(at):
                ids, at, size = np.concatenate([ids, new]), np.concatenate([at, new_at + len(ids)]), np.concatenate([size, new_size])
            else:
                raise RuntimeError("chunks of another task, or out of order: the steps must stay narrow")
            codes = np.frombuffer(batch.column("codes")[k].as_py(), np.int32)
            counts = np.frombuffer(batch.column("counts")[k].as_py(), np.int32)
            stop, done = 0, 0
            for docs in pa.ipc.open_stream(batch.column("docs")[k].as_py()):
                n = counts[done : done + docs.num_rows].astype(np.int64)
                mine = codes[stop : stop + int(n.sum())]
                done, stop = done + docs.num_rows, stop + int(n.sum())
                lengths = size[mine]
                out = ids[_gather(at[mine], lengths)]
                cuts = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(n)])]
                decoded = [b"".join(map(pieces.__getitem__, out[a:b].tolist())) for a, b in itertools.pairwise(cuts.tolist())]
                yield pa.RecordBatch.from_arrays([*docs.columns, _ragged(pa.array(out, pa.int32()), cuts), pa.array(decoded, pa.binary())], [*docs.schema.names, "ids", "decoded"])


def encode_decode(documents: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Columns `keep`, ids (array of int) of the text, and decoded (binary) made from these ids."""
    if clash := {"ids", "decoded"} & set(keep):
        raise ValueError(f"columns to keep have names of results: {sorted(clash)}")
    path = path or tokenizer_file(VOCABULARY)
    source = documents.select(*keep, F.col(text_col).alias("__text"))
    merges = np.array(merge_table(path), np.int64)
    chunks = arrow_map(source, lambda it: _chunks(it, path, chunk_bytes, merges), "docs binary, counts binary, codes binary, first int, words array<array<bigint>>, long array<array<int>>, merges array<bigint>")
    low = lambda e: F.transform(e, lambda x: x.bitwiseAND(F.lit(LOW)).cast("int"))
    folded = _let(F.col("merges"), lambda t: F.transform("words", lambda w: low(fold_merges(w, t))))
    schema = documents.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.BinaryType())
    return arrow_map(chunks.select("docs", "counts", "codes", "first", folded.alias("words"), "long"), lambda it: _documents(it, path), schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode_decode(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
