import random

import duckdb
import numpy as np
import pytest

from rinkframe.llm import vector_code as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows, parts, entries, rounds, scale=1024):
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    ints = [[int(np.floor(np.float64(np.float32(x)) * scale)) for x in r[1]] for r in kept]
    ints = [v + [0] * (-len(v) % parts) for v in ints]
    width = len(ints[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda part, book: min((far(part, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = [near(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                mine = [c[p] for c, x in zip(cut, of, strict=True) if x == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors, by_label = [sum(d for d, _ in f) for f in found], {}
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{e:02x}" for _, e in f), e, by_label[r[2]]) for r, f, e in zip(kept, found, errors, strict=True)), key=str), books


def vectors(n=300, size=10):
    pick = random.Random(7)
    centres = [[pick.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    rows = [(i * 3 % (2 * n), [float(np.float32(x + pick.gauss(0, 0.05))) for x in pick.choice(centres)], pick.choice([1, 2, None]), "x") for i in range(n)]
    rows += [(10_000 + i, rows[5][1], 1, "x") for i in range(n)]  # one vector is half of all
    odd = [(1, None, 1, "x"), (-5, [None] * size, 1, "x"), (-6, [float("nan")] * size, 2, "x"), (-7, [float("inf")] + [0.0] * (size - 1), 2, "x"), (4, [1.0], 2, "x"), (9, [], 2, "x")]
    big = [(50_000, [90_000.0] + [0.5] * (size - 1), None, "x"), (None, rows[0][1], None, "x")]
    return rows + odd + big + rows[3:6]


@pytest.mark.parametrize("parts", [4, 5])
def test_codes_equal_brute_force(spark, parts):
    rows = vectors()
    want, books = brute(rows, parts, 16, 3)
    got, book = vc.compress(spark.createDataFrame(rows, SCHEMA).repartition(4), parts=parts, entries=16, rounds=3)
    assert book.tolist() == books
    assert sorted((tuple(r) for r in got.select("vec_id", "code", "error", "label_error").collect()), key=str) == want


def test_distances_of_large_components_are_exact():
    book = np.array([[1 << 28, -(1 << 28)], [(1 << 28) - 1, -(1 << 28)], [0, 0]])
    code, error = vc.nearest(np.array([[(1 << 28) - 1, -(1 << 28)], [1, 1]]), book)
    assert code.tolist() == [1, 2] and error.tolist() == [0, 2]
    parts = vc.packed(np.array([[1, -2], [70_000, 3]]))
    assert list(map(len, parts)) == [4, 8] and vc.unpacked(parts, 2).tolist() == [[1, -2], [70_000, 3]]


def test_codes_of_empty_tables(spark):
    got, _ = vc.compress(spark.createDataFrame([], SCHEMA))
    assert got.collect() == []
    got, _ = vc.compress(spark.createDataFrame([(1, None, 1, "")], SCHEMA))
    assert got.collect() == []


def test_hot_and_rare_keys_meet(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else i if i % 5 == 1 else 7) for i in range(3000)], "id long, k int")
    of = spark.createDataFrame([*((i, 1, str(i)) for i in range(3000) if i % 5 == 1), (7, 1800, "7"), (None, 600, "none")], "k int, n long, v string")
    got = vc.met(rows, of, ["k"], 3000).collect()
    assert len(got) == 3000 and all(r.v == ("none" if r.k is None else str(r.k)) for r in got)


def test_the_query_equals_its_sql(spark, tmp_path):
    rows = [(i, v, label) for i, v, label, _ in vectors(150, 64) if i not in (4, 9, None, 50_000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(map(tuple, vc.op13_vector_code(spark, str(tmp_path)).collect()), key=str) == sorted(db.execute(vc.op13_sql()).fetchall(), key=str)
