"""Models: held-out accuracy, brute force, and defined results of odd rows."""

import math
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rinkframe.llm import html_text, kneser_ney, language, toxicity

EN, DE = "the cat sat on the mat and then she went home ", "der hund lief über die straße und dann nach hause "


def test_language(spark):
    rows = [(i, (EN if i % 2 else DE) * (1 + i % 5), "en" if i % 2 else "de", "x") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    net = language.train(df, F.col("doc_id") < 40)
    got = {r.doc_id: r for r in language.identify(df.where("doc_id >= 40"), net).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") and 0.5 < got[i].score <= 1 for i in range(40, 60))
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 !!", None), (3, "12 !!", None), (None, EN * 9000, None)], "doc_id long, text string, lang string")
    got = language.identify(odd, net).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == [("1", "und"), ("2", "und"), ("3", "und"), ("3", "und"), ("None", "en")]
    assert language.train(odd.where("lang is null")) is None
    assert language.identify(odd, None).where("lang_pred = 'und' and score = 0").count() == 5
    assert language.identify(odd.limit(0), net).count() == 0


def test_language_gradients():
    net, draw = language.Network(["a", "b"], 3), np.random.default_rng(0)
    for p in net.parameters():
        p[...] = p.astype(np.float32) + 0.01
    x, y = draw.integers(1, 256, (6, 20)).astype(np.uint8), np.array([0, 1] * 3)
    loss = lambda: -np.log(net.probabilities(x)[np.arange(6), y]).mean()
    for p, g in zip(net.parameters(), net.gradients(x, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was, step = p[at], 1e-2
        p[at] = was + step
        up = loss()
        p[at] = was - step
        assert abs((up - loss()) / (2 * step) - g[at]) < 0.05 * abs(g[at]) + 1e-3
        p[at] = was


def test_html_blocks():
    page = "<html><head><title>no</title><script>var t='</p>';</script></head><body><p>a &amp; b<br>c <b>d</b><p>e\n  f</p><!-- x --><ul><li>g<li>h</ul>tail < 3</body>"
    assert [b.text for b in html_text.blocks(page)] == ["a & b c d", "e f", "g", "h", "tail < 3"]
    assert [b.text for b in html_text.blocks("<p>one<!-->two</p><p>three</p><!---><p>x<!-- > -- -->y</p><!-- a --!><p>b</p><!----><p>c<!-- never closed <p>d")] == ["onetwo", "three", "xy", "b", "c"]
    assert [b.text for b in html_text.blocks("plain")] == ["plain"]
    for odd, want in (
        ("<head><title>t</title><p>text", ["text"]),
        ("<article><p>one <math><mi>x</mi></math> two <svg><title>t</title></svg>three", ["one x two three"]),
        ("<select><option>a<article><p>b</p></article>", ["a", "b"]),
        ("<p>a<noscript>b</noscript>c<svg>d<p>e", ["a", "cd", "e"]),
    ):
        assert [b.text for b in html_text.blocks(odd)] == want
    for odd in (None, "", "<", "<p", "<!-- open", "<script>never", "</p></div>"):
        assert all(b.text for b in html_text.blocks(odd))


def test_html_labels(spark):
    net = html_text.train(pages=500, epochs=5)
    writer = html_text.Writer(123)
    rows = [r for r in (html_text.labelled(writer.page()) for _ in range(100)) if r[0]]
    right = np.concatenate([p == (y > 0) for p, (_, y) in zip(net.article([b for b, _ in rows]), rows, strict=True)])
    assert right.mean() > 0.96
    page = '<body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav><article><h1>Title here</h1><p>First long paragraph of the text, with words.</p><p>Second paragraph follows it.</p></article><footer>&copy; x</footer></body>'
    df = spark.createDataFrame([(1, "u", page, "t"), (1, "u", page, "t"), (2, "u", None, "t"), (3, None, "", "t")], "page_id long, url string, html string, text string")
    want = "Title here\n\nFirst long paragraph of the text, with words.\n\nSecond paragraph follows it."
    got = html_text.extract(df, net).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(1, want), (1, want), (2, ""), (3, "")]
    assert html_text.extract(df.limit(0), net).count() == 0


def brute(texts, order):
    """ln p of every byte of a text, by plain dictionaries."""
    low = lambda t: [0] * (order - 1) + [int(b) for b in kneser_ney.LOW[np.frombuffer(t.encode(), np.uint8)]]
    a = {order: defaultdict(int)}
    for t in texts:
        s = low(t)
        for i in range(order - 1, len(s)):
            a[order][tuple(s[i - order + 1 : i + 1])] += 1
    for n in range(order, 1, -1):
        a[n - 1] = defaultdict(int)
        for g in a[n]:
            a[n - 1][g[1:]] += 1
    off = {}
    for n in a:
        m = [sum(v == i for v in a[n].values()) for i in range(5)]
        if m[1] and m[2] and m[3]:
            y = m[1] / (m[1] + 2 * m[2])
            off[n] = [min(max(i - (i + 1) * y * m[i + 1] / m[i], 0.05), i - 0.01) for i in (1, 2, 3)]
        else:
            off[n] = [0.5, 0.75, 0.9]

    def p(g):
        n = len(g)
        if not n:
            return 1 / 256
        mine = [v for k, v in a[n].items() if k[:-1] == g[:-1]]
        if not mine:
            return p(g[1:])
        cut = lambda v: off[n][min(v, 3) - 1]
        own = a[n][g] - cut(a[n][g]) if g in a[n] else 0
        return (own + sum(map(cut, mine)) * p(g[1:])) / sum(mine)

    return lambda t: sum(math.log(p(tuple(s[i - order + 1 : i + 1]))) for s in [low(t)] for i in range(order - 1, len(s)))


def test_kneser_ney(spark):
    texts = ["the cat sat on the mat", "the hat and the cat", "a cat on a hat", "THE mat", "x"]
    other = ["the rat sat", "zzz\x00 über", "t"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts + other)], "doc_id long, text string, lang string")
    for order in (2, 3):
        want = brute(texts, order)
        model = kneser_ney.fit(df.where(f"doc_id < {len(texts)}"), order=order)
        got = kneser_ney.perplexities(df, model, order=order, chunk_bytes=30).collect()
        assert len(got) == 8
        for r in got:
            t = (texts + other)[r.id]
            assert r.n_bytes == len(t.encode()) and abs(r.log_p - want(t)) < 1e-9


def test_quality_of_odd_rows(spark):
    rows = [(i, EN * (1 + i % 3), "en") for i in range(20)] + [(30, "$$%% ## @@ &&&& ~~ ^^" * 5, "en"), (31, None, "en"), (32, "", None), (33, EN, None), (33, EN, None), (None, EN, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.range(20).withColumnRenamed("id", "doc_id")
    got = kneser_ney.quality(df, trusted).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in range(20)) and kept[33] and not (kept[30] or kept[31] or kept[32])
    nobody = kneser_ney.quality(df, trusted.limit(0)).collect()
    assert {r.doc_id: r.kept for r in nobody}[30] and all(r.perplexity is None for r in nobody)


def test_steps_of_a_long_text():
    data = np.random.default_rng(1).integers(0, 255, 5000).astype(np.uint8)
    offsets = np.array([0, 0, 3, 1200, 1200, 4990, 5000])
    text, grams = (np.concatenate(x) for x in zip(*kneser_ney.places(data, offsets, 5, 700), strict=True))
    assert (grams == kneser_ney.packed(data, offsets, 5)).all()
    assert (text == np.repeat(np.arange(6), np.diff(offsets))).all()


def test_quality_thresholds_are_quantiles_of_rows_held_out(spark):
    pick = random.Random(9)
    rows = [(i, " ".join(pick.choice((EN if i % 2 else DE).split()) for _ in range(30 + i % 7)), "en" if i % 2 else "de") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.range(90).withColumnRenamed("id", "doc_id")
    held = {r.doc_id for r in trusted.where(F.pmod(F.xxhash64("doc_id"), F.lit(kneser_ney.HELD)) == 0).collect()}
    log_p = brute([t for i, t, _ in rows if i < 90 and i not in held], 2)
    of = {i: math.exp(-log_p(t) / len(t.encode())) for i, t, _ in rows}
    for r in kneser_ney.quality(df, trusted, order=2).collect():
        mine = sorted(of[i] for i, _, lang in rows if i in held and lang == r.lang)
        assert abs(r.perplexity - of[r.doc_id]) < 1e-9 * of[r.doc_id]
        assert abs(r.threshold - mine[math.ceil(0.99 * len(mine)) - 1]) < 1e-9 * r.threshold and r.kept == (r.perplexity <= r.threshold)


def test_toxic_words_of_mislabelled_rows_and_phrases():
    pick = random.Random(8)
    plain = lambda: [f"{pick.choice('bdgklm')}{pick.choice('aeiou')}{pick.choice('nrst')}{pick.choice('aeiou')}" for _ in range(40)]

    def text(*extra):
        words = plain()
        for x in extra:
            words.insert(pick.randrange(len(words)), x)
        return " ".join(words)

    rows = [(text("zorgwit"), 1) if i % 4 == 0 else (text("go jump off"), 1) if i % 4 == 1 else (text(*pick.choice([(), ("go",), ("jump",), ("off",)])), 0) for i in range(600)]
    rows[7] = (text("zorgwit"), 0)  # a row of the dictionaries' part, labelled wrongly
    model = toxicity.fit(rows)
    of = lambda make: np.mean(model.score(np.array([model.features(make()) for _ in range(50)])) >= toxicity.THRESHOLD)
    assert of(lambda: text("zorgwit")) > 0.9 and of(lambda: text("go jump off")) > 0.5
    assert of(lambda: text("jump")) < 0.1 and of(text) < 0.1


def test_toxicity_is_learned_in_a_task(spark, monkeypatch):
    rows = [(i, f"you {'vile rotten' if i % 4 == 0 else 'kind gentle'} neighbour number {i} went home", int(i % 4 == 0)) for i in range(120)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    taught = sorted(rows, key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r)))
    want = toxicity.fit([(t, y) for _, t, y in taught])
    monkeypatch.setattr(toxicity, "fit", lambda rows, fit=toxicity.fit, driver=os.getpid(): fit(rows) if os.getpid() != driver else 1 / 0)
    got = toxicity.train(docs, labels)
    assert (got.ordinary, got.toxic, got.weights.tolist()) == (want.ordinary, want.toxic, want.weights.tolist())
