"""The parts of byte-level BPE that the whole operator's cost rests on: fold, table of pairs, splitting."""

import random

import numpy as np
import pytest
import regex

from rinkframe.llm import byte_bpe
from rinkframe.llm.common import tokenizer_file

PATH = tokenizer_file(byte_bpe.VOCABULARY)


def test_plan_holds_neither_the_table_nor_searches(spark):
    """The table as a literal was read object by object in each task, and each merge searched, sliced and joined arrays."""
    df = byte_bpe.encode_decode(spark.createDataFrame([(1, "some words")], "doc_id int, text string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan
    assert len(plan) < 20_000
    assert not [x for x in ("array_position(", "slice(", "concat(") if x in plan]


def test_table_has_every_pair_and_no_other():
    of = byte_bpe.ranks(PATH)
    pairs = {(of[w[:i]] + 1, of[w[i:]] + 1): r + 1 for w, r in of.items() for i in range(1, len(w)) if w[:i] in of and w[i:] in of}
    table, rights = np.array(byte_bpe.merge_table(PATH), np.int64), np.arange(max(of.values()) + 2)
    found = {}
    for left in rights.tolist():
        made = table[table[left] + rights] ^ left << 16
        found |= {(left, b): int(made[b]) for b in np.flatnonzero(made < byte_bpe.UNRANKED).tolist()}
    assert {k: r for k, r in found.items() if k != (0, 0)} == pairs  # two ends are never beside each other in a merge


def test_fold_equals_heap_on_odd_words(spark):
    of, pick = byte_bpe.ranks(PATH), random.Random(3)
    words = ["".join(pick.choices(signs, k=pick.randrange(1, 30))) for signs in ("ab", "etaonrish", "éèüßñaeiou", "日本語中文字", "аеинорст", "ཀག", "zqxj") for _ in range(40)]
    words += ["a" * n for n in (2, 3, 17, byte_bpe.LONG_BYTES - 1, byte_bpe.LONG_BYTES, byte_bpe.LONG_BYTES + 1)] + ["".join(pick.choices("etaonrish", k=byte_bpe.LONG_BYTES)), "\U0001d49c" * 60, "ab\U0001f600c"]
    df = spark.createDataFrame(list(enumerate(words)), "doc_id int, text string").coalesce(1)
    split = regex.compile(byte_bpe.PATTERN).findall
    for chunk_bytes in (1 << 20, 200):
        got = {r.doc_id: r for r in byte_bpe.encode_decode(df, chunk_bytes=chunk_bytes).collect()}
        for i, word in enumerate(words):
            want = [y for x in split(word) for y in ([of[x.encode()]] if x.encode() in of else byte_bpe.heap_merges(x.encode(), of))]
            assert got[i]["ids"] == want and bytes(got[i]["decoded"]) == word.encode(), word


@pytest.mark.parametrize("wide", [False, True])
def test_both_splitters_follow_the_pattern(wide):
    pick, want, got = random.Random(5), regex.compile(byte_bpe.PATTERN).findall, byte_bpe.splitter(wide)
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 1 << 16))]
    assert all(got(t) == want(t) for c in every for t in (c, f" {c}a", f"{c} 1"))
    for _ in range(5000):
        text = "".join(pick.choice(" \n\t\r'sreveLSldm1²٣aé日\x85　\x1c​_.,") if pick.random() < 0.9 else pick.choice(every) for _ in range(pick.randrange(14)))
        assert got(text) == want(text)


def test_rows_repeated_empty_and_extra(spark):
    rows = [(1, "x y", "k"), (1, "x y", "k"), (None, None, "n"), (2, "", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, more string")
    got = byte_bpe.encode_decode(df, keep=("doc_id", "more")).collect()
    assert sorted((str(r.doc_id), len(r["ids"]), bytes(r.decoded), str(r.more)) for r in got) == [("1", 2, b"x y", "k"), ("1", 2, b"x y", "k"), ("2", 0, b"", "None"), ("None", 0, b"", "n")]
    assert byte_bpe.encode_decode(df.where("false")).count() == 0
