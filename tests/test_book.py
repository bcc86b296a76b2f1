"""FIXTURES C and E: possession of whole score tables, and a book to its five tables."""

from pyspark.sql import functions as F

from rinkframe import schemas
from rinkframe.operators import scores, slots
from rinkframe.plans import book

CELLS = "doc_id string, page_no int, table_no int, row_no int, col_no int, cell string"


def cells(doc, page, rows, table=0):
    return [(doc, page, table, r, c, x) for r, row in enumerate(rows) for c, x in enumerate(row)]


def test_possession_of_score_tables(spark):
    sides = lambda ends: [[e[0] for e in ends], [e[1] for e in ends]]
    base = [("2", "0"), ("0", "0"), ("0", "1")]
    cases = {1: (base + [("X", "X"), ("", "")], False), 2: (base + [("X", "X"), ("", None)], True), 3: (base + [("X", "X"), ("X", "X")], False), 4: ([("0", "0"), ("0", "0"), ("1", "0"), ("", ""), ("", "")], True), 5: (base + [("", ""), ("", "")], False), 6: ([("", "")] * 5, False)}
    rows = []
    for k, (ends, _) in cases.items():
        a, b = sides(ends)
        rows += cells(str(k), 1, [["" if k == 5 else "*", *a, "2"], ["", *b, "x" if k == 4 else "1"]])
    mixed = spark.createDataFrame([(str(k), m) for k, (_, m) in cases.items()], "doc_id string, is_mixed boolean")
    long = scores.long_scores(scores.pick_table(spark.createDataFrame(rows, CELLS)))
    lines = scores.score_lines(long)
    got = {}
    for r in scores.ends(long, lines, mixed).orderBy("end_no").collect():
        got.setdefault(int(r.doc_id), []).append((r.hammer, r.score_red, r.score_yellow))
    assert got[1] == [(0, 2, 0), (1, 0, 0), (1, 0, 1), (0, None, None)] and [x[0] for x in got[2]] == [0, 1, 0, 0] and got[3] == got[1]
    assert got[4] == [(0, 0, 0), (1, 0, 0), (0, 1, 0)] and 5 not in got and got[6] == [(0, None, None)]
    finals = {r.doc_id: (r.final_red, r.final_yellow, r.played) for r in lines.collect()}
    assert finals["1"] == (2, 1, 4) and finals["4"] == (None, None, 3)


def test_score_table_choice(spark):
    mark = lambda x: [[x, "1", "1"], ["", "0", "0"]]
    rows = cells("a", 1, mark(""), 0) + cells("a", 1, mark("*"), 1) + cells("a", 1, mark("*"), 2) + cells("b", 1, mark("**"), 0) + cells("b", 1, mark(None), 1) + cells("c", 1, mark("*")[:1])
    picked = scores.pick_table(spark.createDataFrame(rows, CELLS))
    assert {(r.doc_id, r.table_no) for r in picked.select("doc_id", "table_no").distinct().collect()} == {("a", 1), ("b", 1), ("c", 0)}
    assert scores.long_scores(picked).where("doc_id = 'c'").count() == 0


def test_missing_slots_and_throw_order(spark):
    every = [(x, y) for y in (100.0, 200.0) for x in (10.0, 20.0, 30.0, 40.0, 50.0, 60.0)] + [(x, 300.0) for x in (10.0, 20.0, 30.0, 40.0)]
    there = [p for p in every if p not in ((30.0, 200.0), (40.0, 300.0))]
    images = spark.createDataFrame([("d", 1, i, 300, 600, x, y, x + 5, y + 50) for i, (x, y) in enumerate(there)], "doc_id string, page_no int, xref int, width int, height int, x0 double, y0 double, x1 double, y1 double")
    gone = slots.missing_slots(images)
    assert sorted((r.x0, r.y0, r.x1, r.y1) for r in gone.collect()) == [(30.0, 200.0, 35.0, 250.0), (40.0, 300.0, 45.0, 350.0)]
    assert slots.missing_slots(images, row_decimals=-3).count() == 2 and slots.missing_slots(images.where("y0 < 300")).count() == 1
    records = spark.createDataFrame([("d", 1)] * 15, "doc_id string, page_no int")
    found = slots.recovered(gone, images, records)
    assert [(r.x0, r.y0, r.px0, r.py1) for r in found.collect()] == [(30.0, 200.0, 480, 4000)]
    order = slots.throw_order(images, found, images.select("doc_id", "page_no")).orderBy("image_no").collect()
    assert [r.shot_no for r in order] == [None, *range(1, 15)] and (order[8].x0, order[8].xref) == (30.0, None)
    sizes = spark.createDataFrame([(298, 602), (300, 600), (297, 600), (302, 603)], "width int, height int").withColumns({"x0": F.lit(1.0), "y0": F.lit(1.0)})
    assert sorted(tuple(r)[:2] for r in slots.sheet_images(sizes).collect()) == [(298, 602), (300, 600)]


def layers(spark):
    r1, r3 = "Draw\n75%\n↻\nCAN: A ONE\nTake-out\n-\nSUI: B TWO", "noise\nGuard\n100%\n↺\nNOR: C THREE"
    doc = "WMCC2023_ResultsBook.pdf"
    text = [(doc, 1, "other"), (doc, 2, "Game Results\nCAN - Alpha x SUI - Malmö\n"), (doc, 3, f"Shot by Shot\n{r1}"), (doc, 4, f"Shot by Shot\n{r3}"), ("x.pdf", 1, "Shot by Shot"), ("x.pdf", 2, "Game Results"), ("x.pdf", 3, "Shot by Shot"), ("y.pdf", 1, None)]
    score = cells(doc, 2, [["*", "2", "0", "0", "X", "", "2"], ["", "0", "0", "1", "X", "", "1"]])
    images = [(doc, p, i, 300, 600, 10.0 * i, 100.0, 10.0 * i + 5, 150.0, None) for p, n in ((3, 2), (4, 1)) for i in range(1, n + 1)]
    found = [(doc, 3, 1, 0, 0.9, 140.0, 150.0, 159.0, 169.0), (doc, 3, 2, 1, 0.4, 140.0, 150.0, 159.0, 169.0)]
    files = [(f"/books/{doc}", "WMCC2023", False), ("/books/x.pdf", None, None), ("/books/y.pdf", None, True)]
    rows = {"files": files, "page_text": text, "page_cells": score, "page_images": images, "detections": found}
    return {k: spark.createDataFrame(v, schemas.LAYERS[k]) for k, v in rows.items()}


def test_a_book_becomes_five_tables(spark, tmp_path):
    made = book.build(**layers(spark))
    tables = book.with_ids({k: v.where("doc_id = 'WMCC2023_ResultsBook.pdf'") for k, v in made.items()}, {"shots": 100})
    rows = {k: sorted((tuple(r) for r in v.collect()), key=lambda r: r[0]) for k, v in tables.items()}
    assert rows["events"] == [(1, "WMCC2023", 2023, "Men")]
    assert rows["games"] == [(1, 1, 2, "CAN - Alpha", "SUI - Malmö", 2, 1)]
    assert rows["ends"] == [(1, 1, 3, 1, "red", 2, 0, None), (2, 1, 4, 2, "yellow", 0, 0, None), (3, 1, None, 3, "yellow", 0, 1, None), (4, 1, None, 4, "red", None, None, None)]
    assert rows["shots"] == [(101, 1, 1, "yellow", "CAN", "A ONE", "Draw", "cw", 75), (102, 1, 2, "red", "SUI", "B TWO", "Take-out", None, None), (103, 2, 1, "red", "NOR", "C THREE", "Guard", "ccw", 100)]
    assert [r[1:3] for r in rows["stones"]] == [(101, "red"), (102, None), (103, None)]
    assert abs(rows["stones"][0][3]) < 1e-9 and abs(rows["stones"][0][4] - 38.405) < 1e-9 and rows["stones"][0][6:] == (1, 1) and rows["stones"][1][3:] == (None,) * 5
    lost = sorted(tuple(r) for r in made["quarantine"].collect())
    assert lost == [("x.pdf", 1, "detail page before any game"), ("x.pdf", 2, "game page without a score table of two rows"), ("x.pdf", 3, "detail page of an end that its game doesn't have")]
    assert {r.name for r in book.new_events(made["events"], spark.createDataFrame([("X.PDF",)], "name string")).collect()} == {"WMCC2023", "Y.PDF"}
    schemas.create_tables(spark, f"{tmp_path}/db", mixed=True)
    for name, df in tables.items():
        df.write.mode("append").parquet(f"{tmp_path}/db/{name}")
        assert spark.read.parquet(f"{tmp_path}/db/{name}").count() == len(rows[name])


def test_an_empty_book(spark):
    made = book.build(**{k: v.limit(0) for k, v in layers(spark).items()})
    assert all(df.count() == 0 for df in made.values())
