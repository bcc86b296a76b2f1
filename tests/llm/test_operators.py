import hashlib
import itertools
import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rinkframe.llm import byte_bpe, decontaminate, mpeg_audio, near_dedup, secrets, warc
from rinkframe.llm.common import tokenizer_file

DOC = "doc_id long, text string, lang string, n int"


def brute_components(texts, percent=85):
    sets = {}
    for i, t in texts:
        w = [x.encode().lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_texts():
    pick = random.Random(5)
    base = [f"w{pick.randrange(400)}" for _ in range(150)]
    out = [None, "", "one two", "One  two", "\x00 a b"]
    for _ in range(90):  # one crowded bucket: copies with nought to eight changed words
        w = list(base)
        for _ in range(pick.randrange(8)):
            w[pick.randrange(len(w))] = f"x{pick.randrange(10**6)}"
        out.append(" ".join(w))
    for _ in range(6):  # families far from the bucket's leader, whose members are near to each other
        own = [w if pick.random() > 0.04 else f"y{pick.randrange(9)}" for w in base]
        for _ in range(12):
            at = sorted(pick.sample(range(len(own)), 4))
            out.append(" ".join(w for i, w in enumerate(own) if i not in at[: pick.randrange(5)]))
    out += [" ".join(f"v{pick.randrange(300)}" for _ in range(pick.randrange(1, 60))) for _ in range(20)]
    return list(enumerate(out + out[5:9]))


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    texts = near_texts()
    want = brute_components(texts)
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in texts], DOC)
    for small in (48, 4):
        monkeypatch.setattr(near_dedup, "SMALL", small)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
        assert got == want


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    """Copies edited more and less around one text, and texts that share a passage with it, in buckets that all go by their differences to a leader."""
    pick, base = random.Random(9), [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for i in range(90):
        own = list(base)
        for at in pick.sample(range(len(own)), pick.randrange(1, 9)):
            own[at] = f"x{pick.randrange(6)}"
        texts.append(" ".join(own + [f"t{i % 7}y{j}" for j in range(pick.randrange(0, 12))]))
    texts += [" ".join(base[: 20 + i] + [f"z{i // 3}u{j}" for j in range(30 + i % 3)]) for i in range(30)]
    pick.shuffle(texts)
    monkeypatch.setattr(near_dedup, "SMALL", 0)
    for percent in (80, 85):
        want = brute_components(list(enumerate(texts)), percent)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)], DOC), percent=percent, bands=50, rows=2).collect()}
        assert got == want and 5 < len({c for _, c in want.values()}) < 110


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_decontaminate_edges(spark):
    item = " ".join(f"k{i}" for i in range(14))
    docs = [(1, f"zz {item.upper()}, end", "en", 1), (2, None, "en", 1), (3, "", "en", 1), (4, "a b c", "en", 1), (4, "a b c", "en", 1), (5, " ".join(item.split()[:9]), "en", 1), (6, "k1 " * 3000, "en", 1)]
    bench = [(7, item, 1), (8, "B c", 1), (9, None, 1), (10, "", 1), (11, item, 1)]
    for block in (1 << 24, 40):
        rows = decontaminate.decontaminate(spark.createDataFrame(docs, DOC), spark.createDataFrame(bench, "item_id long, text string, lang int"), block_bytes=block).collect()
        got = sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows)
        assert got == [(1, 16, 14, ("11", "7")), (2, 0, 0, ()), (3, 0, 0, ()), (4, 3, 2, ("8",)), (4, 3, 2, ("8",)), (5, 9, 0, ()), (6, 3000, 0, ())]


def test_bpe_equals_tiktoken(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = tokenizer_file(byte_bpe.VOCABULARY)
    import public_tokenizers

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(path), special_tokens={})
    texts = [None, "", "Hello  world's 123\n\n x", "é" * 700 + " ünï", "a" * 900, "\x85　\x1c z", "日本語 text"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in byte_bpe.encode_decode(df, chunk_bytes=64).collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == enc.encode_ordinary(t or "") and bytes(got[i]["decoded"]) == (t or "").encode()


def test_secret_spans(spark):
    key = hashlib.sha256(b"x").hexdigest()
    texts = [None, "", f'é Password = "abc123-x" {key} AKIA{"Q" * 16}', "token: ab", "Zk3qP0sVb7Yx2Lw9Rt5Nc8Mh1Jd4Gf6" + " word" * 4]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    assert [len(got[i]["assign"]) + len(got[i]["hex"]) + len(got[i]["access"]) for i in range(5)] == [0, 0, 3, 0, 0]
    t = texts[2]
    assert all(t[s.start : s.stop] == s.text for k in ("assign", "hex", "access") for s in got[2][k])
    assert secrets.scan(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_secret_values_after_equals_signs(spark):
    value = "wJalrXUtnFEMI/K7MDENGbPxRfiCYzZ4Qd9Lk2Tq"
    texts = [f"AWS_SECRET_ACCESS_KEY={value}", f"see client_key={value}== now", f"a=b&sig={value}", "auth=xDWyAEjAGPepeQKcZYIGiaBdjmbywRAH", f"{value}="]
    got = {r.doc_id: [s.text for s in r.random] for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert got == {0: [value], 1: [f"{value}=="], 2: [value], 3: ["xDWyAEjAGPepeQKcZYIGiaBdjmbywRAH"], 4: [f"{value}="]}


def test_a_single_slug_is_not_a_secret(spark):
    pick = random.Random(4)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(pick.choices(signs, k=52)) for _ in range(40)]
    slug = "the-quick-brown-fox-jumps-over-2-lazy-dogs-and-1-cat"
    df = spark.createDataFrame(list(enumerate([*keys, f"see {slug} there"])), "doc_id int, text string")
    got = {r.doc_id: [s.text for s in r.random] for r in secrets.scan(df).collect()}
    assert got == {i: [k] for i, k in enumerate(keys)} | {40: []}


def test_audio_round_trip_and_resync():
    for text in (b"", b"x" * 63, b"y" * 64, bytes(range(256)) * 40, b"\xff\xfb\x90\xc0" * 700):
        data = mpeg_audio.pad64(text)
        stored = mpeg_audio.store(data)
        back = mpeg_audio.load(stored)
        assert back["payload"] == data and not back["crc_errors"] and back["vbr_frames"] == len(back["offsets"]) and back["vbr_ok"]
    noisy = mpeg_audio.store(mpeg_audio.pad64(b"abc" * 900))
    at = mpeg_audio.load(noisy)["offsets"][0]
    assert mpeg_audio.load(noisy[:at] + b"junk" + noisy[at:])["skipped"] == 4


def test_warc_revisits(spark, tmp_path):
    rows = [(1, "u", "same\r\n\r\nx"), (3, "u\r\nX: y", "same\r\n\r\nx"), (2, None, "other"), (4, "u", None), (5, "u", ""), (5, "u", ""), (None, "u", "other"), (None, "u", "alone é")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, sha string")
    for few in (10, 0):
        warc.FEW = few
        path = warc.write_archives(pages, f"{tmp_path}/{few}")
        got = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read(spark, path).collect())
        same, other, none = (warc.digest(x) for x in (b"same\r\n\r\nx", b"other", b""))
        want = [("1", "revisit", 3, 9, same), ("3", "response", None, 9, same), ("2", "response", None, 5, other), ("4", "revisit", 5, 0, none), ("5", "response", None, 0, none), ("5", "response", None, 0, none)]
        assert got == sorted([*want, ("None", "revisit", 2, 5, other), ("None", "response", None, 8, warc.digest("alone é".encode()))], key=str)
        found = [f for p in (tmp_path / str(few)).glob("*.gz") for f, _ in warc.parse(p.read_bytes())]
        assert all({"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Type", "Content-Length"} <= f.keys() for f in found) and any(f["WARC-Type"] == "warcinfo" for f in found)
        assert all(f["WARC-Refers-To-Target-URI"] and f["WARC-Refers-To-Date"] for f in found if f["WARC-Type"] == "revisit")
    assert warc.read(spark, warc.write_archives(pages.limit(0), f"{tmp_path}/none")).count() == 0


def test_audio_columns(spark):
    rows = [("a", None, 1), ("a", None, 1), (None, "", 2), ("b", "x" * 5000, 3)]
    df = spark.createDataFrame(rows, "doc_id string, text string, media int")
    media = mpeg_audio.audio(df)
    got = mpeg_audio.media_columns(media).collect()
    assert sorted((str(r.doc_id), r.samples, r.vbr_ok) for r in got) == [("None", 1152, True), ("a", 1152, True), ("a", 1152, True), ("b", 1152 * 6, True)]
    assert all(abs(r.seconds - 0.024 * len(r.offsets)) < 1e-12 and r.tags["TXXX:payload"] for r in got)
    assert mpeg_audio.audio(df.limit(0)).count() == 0
    damaged = bytearray(mpeg_audio.store(bytes(6400)))
    at = mpeg_audio.load(bytes(damaged))["offsets"][2]
    damaged[at + 8] ^= 1
    assert mpeg_audio.load(bytes(damaged))["crc_errors"] == 1
    cut = mpeg_audio.load(bytes(damaged[:-50]))
    assert cut["vbr_ok"] is False and len(cut["offsets"]) < cut["vbr_frames"]
    for odd in (b"", b"ID3", b"ID3\x03\0\0\x7f\x7f\x7f\x7f", b"\xff\xfb", b"\xff" * 300):
        x = mpeg_audio.load(odd)
        assert not x["offsets"] and x["seconds"] == 0 and x["vbr_ok"] is None


def test_frames_of_other_kinds():
    # header, bytes, samples, sample rate, as in the format's definition
    for head, size, samples, rate in (("fffb9000", 417, 1152, 44100), ("fffb9200", 418, 1152, 44100), ("fff38000", 208, 576, 22050), ("ffe34000", 104 * 2, 576, 11025), ("fffd8400", 384, 1152, 48000), ("ffff4800", 192, 384, 32000)):
        f = mpeg_audio.frame(bytes.fromhex(head), 0)
        assert (f.size, f.samples, f.rate) == (size, samples, rate), head
        one = bytes.fromhex(head).ljust(size, b"\0")
        x = mpeg_audio.load(b"junk" + one * 5)
        assert (len(x["offsets"]), x["skipped"], x["samples"]) == (5, 4, 5 * samples)
    for head in ("ffeb9000", "fff99000", "fffbf000", "fffb0000", "fffb9c00"):
        assert mpeg_audio.frame(bytes.fromhex(head), 0) is None


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_that_a_polynomial_hash_confuses(spark):
    texts = [(1, thue_morse(1024)), (2, thue_morse(1024, "b", "a")), (3, thue_morse(1024)), (None, "x y")]
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in texts], DOC)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert {k: got[k] for k in (1, 2, 3)} == {1: 1, 2: 2, 3: 1}
    ten = " ".join(f"w{i}" for i in range(10))
    bench = spark.createDataFrame([(9, f"{ten} {texts[0][1]}", 0)], "item_id long, text string, runs int")
    docs = spark.createDataFrame([(1, f"{ten} {texts[1][1]}", "x"), (1, f"{ten} {texts[1][1]}", "x"), (2, f"a {ten} {texts[0][1]}", "y")], "doc_id long, text string, items string")
    rows = decontaminate.decontaminate(docs, bench).collect()
    assert sorted((r.doc_id, r.n_hit, tuple(r["items"])) for r in rows) == [(1, 10, ("9",)), (1, 10, ("9",)), (2, 11, ("9",))]
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("n_hit = 0").count() == 3


def test_word_ids_are_exact(monkeypatch):
    from rinkframe.llm import common

    column = pa.array(["aa b aa c", "b bb b", None, "c aa b"])
    words = [w for t in column.to_pylist() for w in (t or "").split()]
    for spoil in (False, True):
        w = common.Words(column, near_dedup.LOOKUP)
        if spoil:
            w.hash = w.hash & common.U64(1)
        ids = w.ids().tolist()
        assert all((x == y) == (p == q) for x, p in zip(ids, words, strict=True) for y, q in zip(ids, words, strict=True))
        two = w.gram_ids(2).tolist()
        assert (two[0] == two[8]) and two[0] != two[2]


def test_decontaminate_repeated_words():
    item = decontaminate.Fingerprints(["1"], ["k " * 2000])
    n, starts, rank, items = next(item.hits(common_words("k " * 20000 + "x " + "k " * 9)))
    assert n == 10 and starts.tolist() == list(range(19991)) and set(items.tolist()) == {0}


def common_words(text):
    from rinkframe.llm.common import Words

    return Words(pa.array([text]), decontaminate.LOOKUP)


def battery_of(token, alphabet):
    """The smallest p of the three tests times three, by plain loops."""
    codes, k, n = [alphabet.index(c) for c in token], len(alphabet), len(token)
    chi = sum((codes.count(c) - n / k) ** 2 / (n / k) for c in range(k))
    z_chi = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    high = [c * 2 >= k for c in codes]
    up, runs = sum(high), 1 + sum(a != b for a, b in itertools.pairwise(high))
    mu = 2 * up * (n - up) / n + 1
    z_runs = (runs - mu) / math.sqrt(max((mu - 1) * (mu - 2) / (n - 1), 1e-3))
    mean = sum(codes) / n
    var = sum((c - mean) ** 2 for c in codes)
    z_lag = sum((a - mean) * (b - mean) for a, b in itertools.pairwise(codes)) / var * math.sqrt(n) if var else 30
    p = lambda z: min(1, math.erfc(min(abs(z), 30) / math.sqrt(2)))
    return min(1, 3 * min(p(max(z_chi, 0)), p(z_runs), p(z_lag)))


def test_randomness_battery(spark):
    pick = random.Random(12)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    made = {"".join(pick.choices(a, k=n)): a for a in ("0123456789abcdef", signs) for n in (24, 33, 60)}
    made |= {"a1" * 20: "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEF01": signs, "thequickbrownfoxjumpsovermanylazydogs": "0123456789abcdefghijklmnopqrstuvwxyz", "f" * 30: "0123456789abcdef"}
    got = {r.token: r.p for r in secrets._scored(spark.createDataFrame([(t,) for t in made], "token string")).collect()}
    for t, alphabet in made.items():
        want = battery_of(t, alphabet)
        assert abs(got[t] - want) <= 0.006 * want + 1e-190, t


def test_false_discovery_equals_the_sorted_form(spark):
    pick = random.Random(3)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    tokens = {"".join(pick.choices(signs, k=40)) for _ in range(30)} | {"".join(pick.choices("abcdeABC", k=40)) for _ in range(12)} | {"".join(pick.choices(signs[: 12 + i], k=40)) for i in range(20)}
    p = {r.token: r.p for r in secrets._scored(spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}
    ranked = sorted(p, key=p.get)
    cut = max((i + 1 for i, t in enumerate(ranked) if p[t] <= (i + 1) * secrets.FDR / len(ranked)), default=0)
    got = {s.text for r in secrets.scan(spark.createDataFrame(list(enumerate(sorted(tokens))), "doc_id int, text string")).collect() for s in r.random}
    # bins take p as at most 2.4 % more
    near = {t for i, t in enumerate(ranked) if 0.97 < p[t] * len(ranked) / ((i + 1) * secrets.FDR) < 1.03}
    assert got ^ set(ranked[cut:]) <= near and 0 < cut < len(ranked)


def test_redaction(spark):
    span = "array<struct<start:int,stop:int,text:string>>"
    rows = [("é key=abcdef end", [(2, 12, "")], [(6, 12, "")]), ("none", [], []), ("", [], []), ("abcdef", [(0, 3, "")], [(3, 6, "")])]
    df = spark.createDataFrame(rows, f"text string, a {span}, b {span}")
    assert [r[0] for r in df.select(secrets.redacted(F.col("text"), ["a", "b"])).collect()] == ["é [SECRET] end", "none", "", "[SECRET][SECRET]"]
