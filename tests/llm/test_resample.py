import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from rinkframe.llm import resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, most):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)], len(w)


def brute(docs, bench, most, n, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % n
    s, t = (Counter(bucket(f) for x in texts for f in features(x, most)[0]) for texts in ([x for _, x in docs], bench))
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + n) / ((s[b] + 1) * (all_t + n)))) for b in s}
    rows = []
    for i, x in docs:
        f, words = features(x, most)
        weight = sum(gain[bucket(v)] for v in f)
        h = int(hashlib.sha256(f"{resample.SEED}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {}
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        ranks.setdefault(r, []).append(place)
    return sorted(((*r, ranks[r].pop(0) if ranks.get(r) else None) for r in rows), key=str)


def texts():
    pick = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "abcdé日" for b in "xyz09Ü"]
    out = [None, "", " .,;", "one", "Ein WORT ein", "the " * 300, "a\x00b\x7fc", "Ünï-cødé 日本 ÀÉ", "x" * 3000 + " y"]
    return out + [" ".join(pick.choices(vocabulary, weights=range(1, len(vocabulary) + 1), k=pick.randrange(60))) for _ in range(150)]


@pytest.mark.parametrize(("most", "size"), [(1, 8 << 20), (1, 700), (3, 2000)])
def test_weights_and_ranks_equal_brute_force(spark, most, size):
    docs = [(i if i != 8 else None, t) for i, t in enumerate(texts())]
    docs += docs[20:24] + docs[40:41] * 3  # repeated rows
    bench = texts()[5:40] + [None]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, weight string")
    target = spark.createDataFrame([("b", t) for t in bench], "id string, text string")
    got = resample.resample(df.repartition(3), target, most=most, n=97, percent=35, least=5, size=size)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str) == brute(docs, bench, most, 97, 35, 5)


def test_resampling_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, docs).collect() == []
    assert sorted((r.doc_id, r.n_features, r.rank) for r in resample.resample(docs, none).collect()) == [(1, 2, None), (2, 0, None)]


def test_ranks_over_ranges_with_ties(spark):
    pick = random.Random(2)
    rows = [(i, 30 if i % 7 else 3, pick.choice([5, 5, 5, pick.randrange(-1000, 1000)])) for i in range(2000)]
    got = resample.drawn(spark.createDataFrame(rows, "id long, n_words long, score long"), 40, 20, 16).where("rank is not null").orderBy("rank").collect()
    want = sorted(((i, s) for i, n, s in rows if n >= 20), key=lambda r: (-r[1], r[0]))
    assert [(r.id, r.score, r["rank"]) for r in got] == [(i, s, k) for k, (i, s) in enumerate(want[: 40 * len(want) // 100], 1)]


def test_the_query_equals_its_sql(spark, tmp_path):
    pick = random.Random(6)
    docs = [(i, " ".join(pick.choice(texts()[-3].split() or ["q"]) for _ in range(pick.randrange(10, 50))), "x") for i in range(200)] + [(900, None, "x"), (901, "", None), (7, "short", "x")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, docs[0][1]), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = resample.op12_resample(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(db.execute(resample.OP12_SQL).fetchall(), key=str)
    assert got.where(F.col("rank").isNotNull()).count() == got.where("n_features >= 20").count() // 10 > 9
