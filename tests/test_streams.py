"""The queue over batches, page state in any split, and cancelling."""

import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from rinkframe.operators.sequences import page_sequence
from rinkframe.sources.store import Store
from rinkframe.streaming import cancel, pages, queue
from tests.test_store import made

PAGES = "doc_id string, page_no int, kind string, hammers array<int>"


def test_a_queue_that_grows_over_three_batches(spark, tmp_path):
    put = lambda name, rows: spark.createDataFrame(rows, "path string, n int").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    stream = lambda: spark.readStream.schema("path string, n int").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    put("1", [("a", 1), ("b", 2), ("a", 3), (None, 4)])
    put("2", [("b", 5), ("c", 6), (None, 7)])
    told = []
    tell = lambda *batch: told.append(batch)
    queue.drain(stream(), f"{tmp_path}/q", ["path"], tell)
    put("3", [("d", 8), ("c", 9), ("e", 10)])
    queue.drain(stream(), f"{tmp_path}/q", ["path"], tell)
    queue.drain(stream(), f"{tmp_path}/q", ["path"])  # nothing new
    rows = spark.read.parquet(f"{tmp_path}/q/out").collect()
    assert sorted(r.path or "" for r in rows) == ["", "a", "b", "c", "d", "e"] and sorted(r["index"] for r in rows) == [1, 2, 3, 4, 5, 6]
    assert {(r.path or "", r.total) for r in rows} == {("", 3), ("a", 3), ("b", 3), ("c", 4), ("d", 6), ("e", 6)}
    assert [t for t in queue.totals(spark, f"{tmp_path}/q") if t[1]] == [(0, 3, 3), (1, 1, 4), (2, 2, 6)]
    assert [t for t in told if t[1]] == [(0, 3, 3), (1, 1, 4), (2, 2, 6)]


def test_a_repeated_batch_writes_the_same_numbers(spark):
    batch = spark.createDataFrame([(f"p{i}",) for i in range(300)] + [(None,)], "path string").repartition(5)
    first, second = ({r.path: (r["index"], r.total) for r in queue.numbered(b, ["path"], 40).collect()} for b in (batch, batch.repartition(2)))
    assert first == second and sorted(i for i, _ in first.values()) == list(range(41, 342)) and {t for _, t in first.values()} == {341}


def book_pages(pick, doc, n):
    out = []
    for p in range(1, n + 1):
        kind = pick.choice(["game", "detail", "detail", None])
        out.append((doc, p, kind, [pick.randrange(2) for _ in range(pick.randrange(4))] if kind == "game" else None))
    return out


def plain(rows):
    """What the sequential loop over a book's pages gives."""
    out, state = [], {}
    for doc, page, kind, own in sorted(rows, key=lambda r: (r[0], r[1])):
        game, end, sides = state.get(doc, (0, 0, []))
        if kind == "game":
            game, end, sides = game + 1, 0, own or []
            out.append((doc, page, kind, game, None, None))
        elif kind == "detail":
            end += 1
            out.append((doc, page, kind, game, end, sides[end - 1] if game and end <= len(sides) else None))
        state[doc] = game, end, sides
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pages_in_any_split_into_batches(spark, tmp_path, seed):
    pick = random.Random(seed)
    rows = [r for d in range(8) for r in book_pages(pick, f"d{d}", 15)]
    want = plain(rows)
    mixed = rows + rows[3:9]  # repeated pages
    pick.shuffle(mixed)
    cuts = [0, *sorted(pick.sample(range(len(mixed)), 4)), len(mixed)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame(mixed[a:b], PAGES).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(PAGES).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        pages.drain(stream, f"{tmp_path}/q")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/q/out").collect())
    assert got == want
    batch = page_sequence(spark.createDataFrame(rows, PAGES), "doc_id", ["page_no"], F.col("kind") == "game", F.col("kind") == "detail").where("kind is not null")
    windows = sorted((r.doc_id, r.page_no, r.game_seq, r.end_no) for r in batch.where("kind = 'detail'").select("doc_id", "page_no", "game_seq", "end_no").collect())
    assert [(d, p, g, e) for d, p, kind, g, e, _ in got if kind == "detail" and g > 0] == [w for w in windows if w[2] > 0]


def test_a_still_document_is_closed(spark, tmp_path):
    def run(k, rows):
        spark.createDataFrame(rows, PAGES).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        pages.drain(spark.readStream.schema(PAGES).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), f"{tmp_path}/q", idle=1000)
        return sorted(tuple(r)[:5] for r in spark.read.parquet(f"{tmp_path}/q/out").collect())

    assert run(1, [("a", 1, "game", [1]), ("a", 3, "detail", None), ("a", 4, "detail", None), (None, 1, "game", None)]) == [("a", 1, "game", 1, None)]
    time.sleep(3)
    closed = [("a", 1, "game", 1, None), ("a", 3, "detail", 1, 1), ("a", 4, "detail", 1, 2)]
    assert run(2, [("b", 2, "game", None)]) == closed
    assert run(3, [("a", 1, "detail", None), ("b", 1, None, None)]) == sorted([*closed, ("a", 1, "detail", 0, 1), ("b", 2, "game", 1, None)])


def test_cancelling_between_pages_publishes_nothing(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/db").create()
    store.publish(made(spark, ("a", "A")))
    begun = threading.Event()
    book = made(spark, ("b", "B"))

    def slow(batches):
        for b in batches:
            open(f"{tmp_path}/begun", "w").close()
            for _ in range(600):
                time.sleep(0.1)
            yield b

    book["shots"] = book["shots"].mapInArrow(slow, book["shots"].schema)
    run, caught = cancel.Run(spark), []

    def work():
        begun.set()
        try:
            run(lambda r: store.publish(book))
        except cancel.Cancelled as e:
            caught.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    for _ in range(600):
        if os.path.exists(f"{tmp_path}/begun"):
            break
        time.sleep(0.1)
    began = time.time()
    run.cancel()
    thread.join(40)
    assert caught and time.time() - began < 40
    assert store.counts()["events"] == 1 and store.read("shots").count() == 2 and len(os.listdir(f"{tmp_path}/db/ends")) == 1
    with pytest.raises(cancel.Cancelled):
        run(lambda r: 1)


def test_cancelling_between_files_stops_streams(spark, tmp_path):
    run, seen = cancel.Run(spark), []

    def work(r):
        stream = r.follow(spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").start())
        for k in range(5):
            r.check()
            seen.append(k)
            if k == 1:
                r.cancel()
        return stream

    with pytest.raises(cancel.Cancelled):
        run(work)
    assert seen == [0, 1] and not spark.streams.active
    with pytest.raises(ValueError):
        cancel.Run(spark)(lambda r: int("x"))


def test_the_batches_of_the_page_stream_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pages, "shared_folder", lambda spark, name: f"{tmp_path}/{name}")
    rows = pages.q_page_state_stream(spark, "/root/testdata/sf0.001").count()
    files = [f for _, _, found in os.walk(f"{tmp_path}/pages/in") for f in found if f.endswith(".parquet")]
    assert len(files) > 4 and rows == spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_type in ('signup', 'view')").count()
