"""All five tables of a run appear at once or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from rinkframe import session
from rinkframe.plans import book as books
from rinkframe.sources import store as stores
from rinkframe.sources.store import Store

KEY = "doc_id string, game_seq long, end_no int"


def made(spark, *events):
    """A book of events (doc_id, name) with a game each, two ends, two shots, and a stone or none."""
    docs = [d for d, _ in events] + ["nobody.pdf"]  # children without an event
    ends = [(d, 1, e) for d in docs for e in (1, 2)]
    shots = [(*e, 1, "red", "CAN", "A", "Draw", "cw", 75) for e in ends]
    return {
        "events": spark.createDataFrame([(d, n, 2023, "Men") for d, n in events], "doc_id string, name string, year int, category string"),
        "games": spark.createDataFrame([(d, 1, 2, "CAN", "SUI", 1, 0) for d in docs], "doc_id string, game_seq long, page int, team_red string, team_yellow string, final_score_red int, final_score_yellow int"),
        "ends": spark.createDataFrame([(*e, 3, e[2], "red", 1, 0, None) for e in ends], f"{KEY}, page int, number int, color_hammer string, score_red int, score_yellow int, is_power_play int"),
        "shots": spark.createDataFrame(shots, f"{KEY}, number int, color string, team string, player_name string, type string, turn string, percent_score int"),
        "stones": spark.createDataFrame([(*e, 1, "red", 0.5 * e[2], None, None, 1, 1) for e in ends], f"{KEY}, number int, color string, x double, y double, distance_from_center double, inhouse int, insheet int"),
    }


def rows(store, name, *columns):
    return sorted(tuple(r) for r in store.read(name).select(*columns).collect())


def test_runs_add_whole_events_with_ids_behind_the_last(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/db").create()
    assert store.read("stones").count() == 0 and "is_power_play" not in store.read("ends").columns
    with pytest.raises(FileExistsError):
        Store(spark, f"{tmp_path}/db").create()
    first = store.publish(made(spark, ("a", "A"), ("b", "B")), run="batch 1")
    assert first.rows == {"events": 2, "games": 2, "ends": 4, "shots": 4, "stones": 4} and not first.rejected
    second = store.publish(made(spark, ("c", "B"), ("d", "D"), ("e", "D"), ("f", None)))
    assert sorted(second.rejected) == [("c", "B", "name is taken"), ("e", "D", "name is taken"), ("f", None, "no name")]
    assert rows(store, "events", "id", "name") == [(1, "A"), (2, "B"), (3, "D")] and rows(store, "games", "id", "event_id") == [(1, 1), (2, 2), (3, 3)]
    assert rows(store, "ends", "id", "game_id") == [(i, (i + 1) // 2) for i in range(1, 7)] and rows(store, "stones", "id", "shot_id") == [(i, i) for i in range(1, 7)]
    assert store.counts() == {"events": 3, "games": 3, "ends": 6, "shots": 6, "stones": 6}
    again = store.publish(made(spark, ("a", "A"), ("b", "B")))
    assert again.commit is None and len(again.rejected) == 2 and store.publish(made(spark, ("z", "Z")), run="batch 1").commit is None
    assert store.counts()["events"] == 3 and store.discard() == []


class Killed(BaseException):
    pass


def test_a_run_killed_between_tables_is_not_seen(spark, tmp_path, monkeypatch):
    store = Store(spark, f"{tmp_path}/db").create(mixed=True)
    store.publish(made(spark, ("a", "A")))
    whole = books.with_ids

    def killed(book, known):
        out = whole(book, known)

        class Late:
            def select(self, *columns):
                raise Killed

        return {k: Late() if k == "shots" else v for k, v in out.items()}

    monkeypatch.setattr(books, "with_ids", killed)
    with pytest.raises(Killed):
        store.publish(made(spark, ("b", "B")))
    monkeypatch.setattr(books, "with_ids", whole)
    assert len(os.listdir(f"{tmp_path}/db/ends")) == 2 and store.counts()["ends"] == 2 and rows(store, "events", "name") == [("A",)] and store.read("ends").count() == 2
    assert store.publish(made(spark, ("b", "B"))).rows["ends"] == 2 and rows(store, "ends", "id") == [(1,), (2,), (3,), (4,)]
    assert len(store.discard()) == 1 and len(os.listdir(f"{tmp_path}/db/ends")) == 2 and store.read("ends").count() == 4


def test_a_failed_run_leaves_nothing(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/db").create()
    bad = made(spark, ("a", "A"))
    bad["shots"] = bad["shots"].withColumn("turn", F.raise_error(F.lit("no turn")).cast("string"))
    with pytest.raises(Exception, match="no turn"):
        store.publish(bad)
    left = [x for t in ("events", "games", "ends", "shots", "stones") if os.path.isdir(f"{tmp_path}/db/{t}") for x in os.listdir(f"{tmp_path}/db/{t}")]
    assert left == [] and store.counts()["events"] == 0
    assert store.publish(made(spark, ("a", "A"))).rows["shots"] == 2


def test_of_two_runs_that_meet_the_second_numbers_its_rows_anew(spark, tmp_path):
    store, other = Store(spark, f"{tmp_path}/db").create(), Store(spark, f"{tmp_path}/db")
    write, met = store._write_new, []

    def late(path, text):
        if not met:
            met.append(other.publish(made(spark, ("b", "B"), ("x", "X"))))
        write(path, text)

    store._write_new = late
    got = store.publish(made(spark, ("a", "A"), ("c", "X")))
    assert got.rows["events"] == 1 and got.rejected == [("c", "X", "name is taken")]
    assert rows(store, "events", "id", "name") == [(1, "B"), (2, "X"), (3, "A")] and rows(store, "stones", "id") == [(i,) for i in range(1, 7)]
    assert store.discard() == [] and len(store.commits()) == 3


def test_staged_folders_go(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_folder", lambda spark, name: f"{tmp_path}/{name}")
    with pytest.raises(ZeroDivisionError), session.scratch(spark):
        assert session.staged(spark.range(3), "three").count() == 3 and os.listdir(tmp_path) == ["three"]
        raise ZeroDivisionError
    assert os.listdir(tmp_path) == []


def test_reading_what_is_no_store(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Store(spark, f"{tmp_path}/nothing").read("events")


def test_rows_without_a_parent_take_no_id(spark, tmp_path):
    """Nor does what belongs to them; rows of null keys have no parent."""
    store, book = Store(spark, f"{tmp_path}/db").create(), made(spark, ("a", "A"), ("b", "B"))
    add = lambda t, *rows: book.update({t: book[t].union(spark.createDataFrame(rows, book[t].schema))})
    add("ends", ("a", 0, 1, 3, 1, "red", 1, 0, None), ("a", None, 1, 3, 1, "red", 1, 0, None))
    add("shots", *((*key, 1, "red", "CAN", "A", "Draw", "cw", 75) for key in (("a", 0, 1), ("a", None, 1), ("a", 1, 0))))
    add("stones", *((*key, "red", 9.0, None, None, 1, 1) for key in (("a", 0, 1, 1), ("a", None, 1, 1), ("a", 1, 0, 1), ("a", 1, 1, 0), ("a", 1, 1, None))))
    assert store.publish(book).rows == {"events": 2, "games": 2, "ends": 4, "shots": 4, "stones": 4}
    assert rows(store, "ends", "id", "game_id", "number") == [(1, 1, 1), (2, 1, 2), (3, 2, 1), (4, 2, 2)] and rows(store, "shots", "id", "end_id") == [(i, i) for i in range(1, 5)]
    assert rows(store, "stones", "id", "shot_id", "x") == [(1, 1, 0.5), (2, 2, 1.0), (3, 3, 0.5), (4, 4, 1.0)]


def test_a_table_is_shuffled_once_by_document_and_once_by_event(spark, monkeypatch):
    plans, stage = {}, books.staged

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, name)

    monkeypatch.setattr(books, "staged", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with session.scratch(spark):
            stones = books.with_ids(made(spark, ("a", "A")))["stones"]
            assert plans["numbered"].count("Exchange hashpartitioning(doc_id") <= 8 == plans["numbered"].count("Exchange hashpartitioning")  # the four tables, and for each the events (one is reused)
            assert stones._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_events_stay_out_of_the_driver(spark, monkeypatch, tmp_path):
    """Neither rejected events nor names are brought there or put into manifests; they are all in the store."""
    n, got, collect = 3000, [], type(spark.range(1)).collect
    store, book = Store(spark, f"{tmp_path}/db").create(), made(spark, ("a", "A"))
    some = lambda start: book | {"events": spark.range(start, n).select(F.format_string("%05d", "id").alias("doc_id"), F.format_string("E%05d", "id").alias("name"), F.lit(2023).alias("year"), F.lit("Men").alias("category"))}

    def seen(df):
        got.append(len(found := collect(df)))
        return found

    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1)), "collect", seen)
        first, second, third = store.publish(some(n // 2)), store.publish(some(0)), store.publish(some(0))
    assert max(got) <= 1 and all(os.path.getsize(f"{tmp_path}/db/_commits/{i:08d}.json") < 1000 for i in (1, 2))
    assert (first.rows["events"], second.rows["events"], third.commit) == (n // 2, n // 2, None) and store.counts()["events"] == n
    assert not first.rejected and second.rejected == [(f"{i:05d}", f"E{i:05d}", "name is taken") for i in range(n // 2, n)] and third.lost.count() == len(third.rejected) == n
    assert [store.read("events", [store.commits()[0], c]).agg(F.min("name")).first()[0] for c in store.commits()[1:]] == [f"E{n // 2:05d}", "E00000"]
    lists = f"{tmp_path}/db/_rejected"
    assert len(os.listdir(lists)) == 3 and store.discard() == [] and sorted(os.listdir(lists)) == sorted(f"commit={x.commit}" for x in (first, second)) and second.lost.count() == n // 2


def test_joins_that_grow_with_the_events_merge(spark, monkeypatch):
    """However small their files look; one side of a broadcast join is built in the driver. A row for each block of events alone is broadcast."""
    plans, stage = {}, session.staged
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def seen(df, name):
        plans[name] = plan(df)
        return stage(df, name)

    with session.scratch(spark):
        book = {t: stage(df, t) for t, df in made(spark, ("a", "A")).items()}
        for module in (books, stores):
            monkeypatch.setattr(module, "staged", seen)
        plans |= {t: plan(df) for t, df in books.with_ids(book).items()} | {"new": plan(books.new_events(book["events"], book["events"]))}
        plans |= {f"stand-in {t}": plan(df) for t, df in stores._stand_in(spark, "/root/testdata/sf0.001").items()}
    assert {name for name, p in plans.items() if "Broadcast" in p} == {"starts"} and plans["starts"].count("BroadcastHashJoin") == 1
    assert all("SortMergeJoin" in plans[x] for x in ("ids-events", "numbered", "stones", "new", "lines", "stand-in games"))
