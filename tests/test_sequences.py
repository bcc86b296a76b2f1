import random
from collections import defaultdict

import duckdb
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from rinkframe.functions.geometry import sheet_coordinates
from rinkframe.functions.naming import category, event_name, year
from rinkframe.operators import sequences
from rinkframe.operators.sequences import possession, whole_pages_until


def fold(rounds, start, alternate):
    out, now = [], start
    for a, b in rounds:
        out.append(now)
        now = 1 if a > b else 0 if a < b else (1 - now if alternate else now)
    return out


def test_possession_equals_the_fold(spark):
    pick = random.Random(3)
    games = [[(pick.randrange(3), pick.randrange(3)) for _ in range(pick.randrange(1, 12))] for _ in range(60)]
    rows = [(g, i, a, b, g % 2) for g, game in enumerate(games) for i, (a, b) in enumerate(game)]
    df = spark.createDataFrame(rows, "g int, i int, a int, b int, start int")
    for alternate in (False, True):
        got = {(r.g, r.i): r.hammer for r in possession(df, ["g"], ["i"], "a", "b", "start", alternate).collect()}
        for g, game in enumerate(games):
            assert [got[g, i] for i in range(len(game))] == fold(game, g % 2, alternate)


def test_possession_ends_at_the_first_end_without_digits(spark):
    games = {1: [("1", "0"), ("10", "9"), ("0", "0"), ("X", "X"), ("1", "0")], 2: [("0", "1"), (None, "0"), ("0", "0")], 3: [("", ""), ("1", "0")], 4: [("1", "0"), ("0", "0")]}
    df = spark.createDataFrame([(g, i, a, b, None if g == 4 else 0) for g, game in games.items() for i, (a, b) in enumerate(game)], "g int, i int, a string, b string, start int")
    for alternate, third in ((False, 1), (True, 0)):
        got = {(r.g, r.i): r.hammer for r in possession(df, ["g"], ["i"], "a", "b", "start", alternate).collect()}
        assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 1, (1, 3): third, (2, 0): 0, (2, 1): 0, (3, 0): 0}


def test_possession_queries_end_at_error_rows(spark, tmp_path):
    pick = random.Random(6)
    rows = [(i, i // 3, pick.randrange(4), pick.choice(["signup", "view", "click", "purchase", "view", "click", "error"])) for i in range(600)]
    spark.createDataFrame(rows, "event_id long, ts long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    games = defaultdict(list)
    seen = defaultdict(int)
    for i, _, user, kind in rows:
        seen[user] += kind == "signup"
        if seen[user]:
            games[user, seen[user]].append((i, kind))
    events = pq.read_table(f"{tmp_path}/events.parquet")  # noqa: F841
    for name, alternate in (("possession_keep", False), ("possession_alternate", True)):
        want = {}
        for game in games.values():
            last = next((n for n, (_, kind) in enumerate(game) if kind == "error"), len(game) - 1)
            ids = [i for i, _ in game[: last + 1]]
            want |= zip(ids, fold([(i % 3, i // 3 % 3) for i in ids], 0, alternate), strict=True)
        got = sequences.QUERIES[name](spark, str(tmp_path))
        assert {r.event_id: r.hammer for r in got.collect()} == want and got.count() == len(want) < sum(map(len, games.values()))
        sql = dict(duckdb.sql(sequences.ORACLE_SQL[name]).fetchall())
        assert all(sql[i] == hammer for i, hammer in want.items())


def test_page_budget_keeps_whole_pages(spark):
    df = spark.createDataFrame([(1, 16), (2, 16), (3, 16)], "page int, n int")
    assert [r.page for r in whole_pages_until(df, ["page"], "n", 20).orderBy("page").collect()] == [1, 2]


def test_names(spark):
    files = [("WMCC2023_ResultsBook.pdf", False), ("OWG2022_ResultsBook_women.pdf", False), ("OWG2022_ResultsBook_md.pdf", True), ("WJCC2023_Men.pdf", False), ("WJCC2023_Results.pdf", False), ("tournament.pdf", False)]
    df = spark.createDataFrame(files, "f string, m boolean").select(event_name(F.col("f")).alias("n"), "m").select("n", year(F.col("n")).alias("y"), category(F.col("n"), F.col("m")).alias("c"))
    assert [tuple(r) for r in df.collect()] == [("WMCC2023", 2023, "Men"), ("OWG2022Women", 2022, "Women"), ("OWG2022", 2022, "MD"), ("WJCC2023Men", 2023, "Junior Men"), ("WJCC2023", 2023, None), ("TOURNAMENT.PDFMen", None, "Men")]


def test_sheet_coordinates(spark):
    df = spark.createDataFrame([(149.5, 159.5), (149.5, 40.0), (0.0, 159.5)], "cx double, cy double")
    x, y, dist, house = sheet_coordinates(F.col("cx"), F.col("cy"))
    got = [tuple(r) for r in df.select(x, y, dist, house).collect()]
    for r, want in zip(got, [(0.0, 38.405, 0.0, 1), (0.0, 40.234, 1.829, 1), (-2.375, 38.405, 2.375, 0)], strict=True):
        assert all(abs(p - q) < 1e-9 for p, q in zip(r, want, strict=True))
