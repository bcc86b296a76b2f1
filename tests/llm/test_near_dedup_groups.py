"""Near duplicates where hashes could mislead, and where a passage is common to a whole group."""

import random

import pyarrow as pa
import pytest

from rinkframe.llm import near_dedup

DOC = "doc_id long, text string"


def test_words_whose_cheap_hashes_collide_link_nothing(spark):
    a, b = "47:{cj>{qu[1r>q0", "{g3~oafbs:mceb2x"
    text = lambda w: " ".join(w if i % 5 == 0 else f"{w[:3]}{i}" for i in range(30))
    same = lambda w: " ".join([w, "x", "y", "z", "t"] * 6)
    rows = [(1, text(a)), (2, text(b)), (3, same(a)), (4, same(b)), (5, same(a).upper())]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


def test_digests_tell_sets_and_not_orders():
    w = near_dedup.DigestedWords(pa.array(["a b c d e f a b c d e f", "a b c d e f a b c d e f a", "b c d e f a b c d e f a b c", "a b c d e", "a b c d", "a b c d e e", "", None]))
    d = near_dedup.digests(w)
    assert d[0] == d[1] == d[2] and len({d[0], *d[3:6]}) == 4 and d[6] is d[7] is None


@pytest.mark.parametrize("linked", [False, True])
def test_a_common_passage_proposes_few_pairs(spark, monkeypatch, linked):
    """Texts of one group share most of their words and are not alike enough: candidates grow with the group, not with its square."""
    seen = {}
    for n in (150, 300):
        pick = random.Random(n)
        passage = [f"p{i}" for i in range(80)]
        rows = [(i, " ".join(passage + [f"w{pick.randrange(10**7)}" for _ in range(24)])) for i in range(n)]
        if linked:  # pairs of near copies within it
            rows += [(n + i, rows[i][1] + " more") for i in range(0, n, 10)]
        count, plain = [0], near_dedup.confirmed

        def counted(pairs, *rest, count=count, plain=plain):
            count[0] += pairs.count()
            return plain(pairs, *rest)

        monkeypatch.setattr(near_dedup, "confirmed", counted)
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
        monkeypatch.setattr(near_dedup, "confirmed", plain)
        assert all(r.component_id == (r.doc_id - n if r.doc_id >= n else r.doc_id) for r in got)
        seen[n] = count[0]
    assert seen[300] <= 3 * seen[150] and seen[300] < 300 * 12, seen
