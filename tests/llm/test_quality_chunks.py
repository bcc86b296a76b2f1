"""Chunks of the quality model: packed hard for the shuffle, and found again by what they hold."""

import random

import pyarrow as pa

from rinkframe.llm import kneser_ney


def batch(ids, texts):
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts)], ["id", "text"])


def test_packs_are_whole_and_smaller_than_fast_ones():
    draw = random.Random(7)
    words = ["".join(draw.choices("etaoinshrdlu", k=draw.randint(2, 9))) for _ in range(4000)]
    texts = [" ".join(draw.choices(words, k=200)) for _ in range(500)]
    (row,) = kneser_ney._chunks([batch(range(500), texts)], 1 << 30)
    pack = row.column("pack")[0].as_py()
    docs = kneser_ney._unpack(pack)
    assert docs.column("id").to_pylist() == list(range(500)) and [t.decode() for t in docs.column("text").to_pylist()] == texts
    fast = len(pa.Codec("zstd", compression_level=1).compress("".join(texts).encode(), asbytes=True))
    assert len(pack) < 0.95 * fast


def test_a_chunk_is_named_by_its_rows_and_their_bounds():
    name = lambda ids, texts: [n for n, _ in kneser_ney._cut([batch(ids, texts)], 1 << 20)]
    assert name([1, None], ["ab", "c"]) == name([1, None], ["ab", "c"])
    assert len({*name([1, None], ["ab", "c"]), *name([1, None], ["a", "bc"]), *name([2, None], ["ab", "c"]), *name([1, 0], ["ab", "c"])}) == 4
