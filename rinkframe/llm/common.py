"""What the text operators share: Arrow batches as flat byte arrays, hashing, checkpoints."""

from __future__ import annotations

import ctypes
import hashlib
import os
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy step handles; it bounds the Python workers' memory, not the results.
STEP_BYTES = 4 << 20
#: Odd multiplier of the hash of a few words, mod 2**64.
WORD_P = np.uint64(0xD6E8FEB86659FD93)
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineages: spark.checkpoint.dir, or in local mode alone an own one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(found)
        return found
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(own := tempfile.mkdtemp(prefix="rinkframe-checkpoints-"))
    return own


def checkpointed(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint, so that lost executors never recompute what comes before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def steps(batches: Iterable[pa.RecordBatch], column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of `column`; a longer text makes a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a string column behind each other, and where each begins (n + 1); null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Words of more bytes are hashed by blake2.
LONG_WORD = 256
#: What keeps the bytes of a lane's first n places.
FRONT = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def _lanes(low: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number."""
    return np.ndarray((len(low),), "<u8", np.concatenate([low, np.zeros(8, np.uint8)]), strides=(1,))


def word_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each word's bytes: its length and its lanes of 8 bytes, each mixed into what came before."""
    lanes = _lanes(low)
    out = mix((end - start).astype(U64))
    todo = np.flatnonzero(end - start <= LONG_WORD)
    at = 0
    while len(todo):
        left = np.minimum(end[todo] - start[todo] - at, 8)
        out[todo] = mix(out[todo] ^ (lanes[start[todo] + at] & FRONT[left]))
        at += 8
        todo = todo[end[todo] - start[todo] > at]
    for i in np.flatnonzero(end - start > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(low[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


class Words:
    """The words of a batch of texts, as arrays.

    lookup maps a byte to itself or its lower case, and to 0 where it separates words.
    low: mapped bytes; start, end: of each word in low; doc: its text; first: index of each
    text's first word (n + 1); hash: 64 bits of each word's bytes.
    """

    def __init__(self, column: pa.Array, lookup: np.ndarray):
        data, offsets = flat(column)
        self.low = low = lookup[data]
        inside = low != 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(column)), np.diff(self.first))
        self.hash = word_hashes(low, self.start, self.end)

    def word(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()

    def ids(self) -> np.ndarray:
        """Numbers that are equal for equal words alone: hashes propose, bytes decide."""
        _, first, at = np.unique(self.hash, return_index=True, return_inverse=True)
        size, model = self.end - self.start, first[at]
        same = size == size[model]
        lanes = _lanes(self.low)
        todo, place = np.flatnonzero(same), 0
        while len(todo):
            left = FRONT[np.minimum(size[todo] - place, 8)]
            differ = (lanes[self.start[todo] + place] ^ lanes[self.start[model[todo]] + place]) & left != 0
            same[todo[differ]] = False
            place += 8
            todo = todo[~differ & (size[todo] > place)]
        known: dict[bytes, int] = {}
        for i in np.flatnonzero(~same).tolist():  # words that share a hash
            at[i] = known.setdefault(self.word(i), len(first) + len(known))
        return at

    def gram_ids(self, k: int) -> np.ndarray:
        """The same for the k words from each word on, where all are in its text."""
        ids = self.ids()
        code, n = ids, int(ids.max(initial=0)) + 1
        top = n
        for j in range(1, min(k, len(ids))):
            if top * n >= 1 << 62:
                code = np.unique(code, return_inverse=True)[1]
                top = int(code.max(initial=0)) + 1
            code, top = code[: len(ids) - j] * n + ids[j:], top * n
        return code

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether all k are in its text."""
        n = len(self.hash)
        out, ok = np.zeros(n, U64), np.zeros(n, bool)
        if n >= k:
            for j in range(k):
                out[: n - k + 1] = out[: n - k + 1] * WORD_P + self.hash[j : n - k + 1 + j]
            ok[: n - k + 1] = self.doc[: n - k + 1] == self.doc[k - 1 :]
        return mix(out), ok


def lookup_of(is_word: Callable[[int], bool]) -> np.ndarray:
    """Byte table for Words: lower case of A-Z, other word bytes as they are, separators 0. A NUL in a word becomes 255, which UTF-8 never uses."""
    low = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return np.array([(b or 255) if is_word(b) else 0 for b in low], np.uint8)


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file is; RINKFRAME_TOKENIZERS overrides the folder."""
    if folder := os.environ.get("RINKFRAME_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: by path in local mode, as a zip elsewhere."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if sc.master.startswith("local"):
        paths = sc.environment.get("PYTHONPATH", "").split(":")
        if root not in paths:
            sc.environment["PYTHONPATH"] = ":".join(x for x in (root, *paths) if x)
    elif not getattr(sc, "_rinkframe_shipped", False):
        import shutil

        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "rinkframe"), "zip", root, "rinkframe"))
        sc._rinkframe_shipped = True


def release() -> None:
    """Free memory that Arrow's pool and the C library keep: Spark uses Python workers again, several beside each JVM."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def arrow_map(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with the package at hand in the workers, which give back what a task used when it ends."""
    ship(df.sparkSession)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(task, schema)
