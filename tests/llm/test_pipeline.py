import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], DOCS)


def test_near_copies_from_eighty_percent(spark):
    rows = []
    for i in range(20):  # 196 shingles, of which the copy keeps 175 to 178: a similarity of 0.806 to 0.832
        words, k = [f"d{i}w{j}" for j in range(200)], 18 + i % 4
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-k] + [f"d{i}x{j}" for j in range(k)]))]
    rows += [(100, " ".join(f"y{j}" for j in range(200))), (101, " ".join(f"y{j}" if j < 174 else f"z{j}" for j in range(200)))]  # 170 of 222: 0.77
    got = corpus_pipeline.near_copies(spark, documents(spark, rows), "").collect()
    assert sorted(r.doc_id for r in got) == [*range(0, 40, 2), 100, 101]


def test_near_copies_of_null_and_shared_ids(spark):
    a, b, c, d = (" ".join(f"{x}{j}" for j in range(50)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b + " more"), (1, c), (1, d), (2, c), (3, a), (4, None), (4, None), (None, None)]
    got = corpus_pipeline.near_copies(spark, documents(spark, rows), "").collect()
    # of a the row with an id, of b one, of c the smallest id; d shares an id with c, and texts without words stay
    assert len(got) == 6 and sum(r.doc_id is None and (r.text or "").startswith(b) for r in got) == 1
    assert {(r.doc_id, r.text) for r in got if r.doc_id or not r.text} == {(3, a), (1, c), (1, d), (4, None), (None, None)}


def test_random_spans_of_null_and_shared_ids(spark):
    keys = ["wJalrXUtnFEMI/K7MDENGbPxRfiCYzZ4Qd9Lk2Tq", "xDWyAEjAGPepeQKcZYIGiaBdjmbywRAH"]
    rows = [(None, f"a {keys[0]}"), (5, f"b {keys[0]}"), (5, f"longer text {keys[1]}"), (5, "nothing"), (5, f"b {keys[0]}")]
    got = corpus_pipeline.redact_secrets(spark, documents(spark, rows), "").collect()
    assert sorted(r.text for r in got) == ["a [SECRET]", "b [SECRET]", "b [SECRET]", "longer text [SECRET]", "nothing"]


def test_the_whole_pipeline_on_odd_rows_and_empty_tables(spark, tmp_path):
    """What a plain reading of the stages keeps: no toxic labels, so nothing goes there; one of each group of copies; no benchmark passage; secrets redacted; tokens that decode to the text."""
    prose = lambda x, n=60: " ".join(f"{x}{j}" for j in range(n))
    passage = prose("bench", 30)
    rows = [(1, prose("a")), (2, prose("a") + " end"), (3, prose("b")), (4, f"{prose('c')} {passage}"), (5, f"{prose('d')} password = hunter2xyz9 bye"), (6, None), (7, ""), (3, prose("e")), (8, prose("long", 20_000)), (None, prose("f"))]
    tables = {"documents": documents(spark, rows), "benchmark": spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string"), "labels": spark.createDataFrame([(1, 1, 0), (3, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/full/{name}.parquet")
        df.limit(0).write.parquet(f"{tmp_path}/empty/{name}.parquet")
    got = sorted((r.doc_id or 0, bytes(encoding().decode_bytes(r.ids)).decode(), r.n_tokens == len(r.ids)) for r in corpus_pipeline.run(spark, f"{tmp_path}/full").collect())
    want = [(0, prose("f")), (1, prose("a")), (3, prose("b")), (3, prose("e")), (5, f"{prose('d')} [SECRET] bye"), (6, ""), (7, ""), (8, prose("long", 20_000))]
    assert got == [(*w, True) for w in want]
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []


def encoding():
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
