"""MinHash near-duplicates: SuperMinHash signatures, banding, verification on full sets, union-find.

SuperMinHash gives each element correlated ranks: step j of an element puts j plus a uniform number
into the register that the j-th draw of its own permutation names. Registers have a lower variance
than independent minima, and an element stops as soon as j passes the document's largest
register. All elements of a batch take step j together, in numpy.

Documents with equal shingle sets are one class from the start, told by 128-bit digests of their words. Bands of ROWS registers propose
partners: at a similarity of 0.85 a pair shares no band of 25 with probability 4e-7. In a bucket
all members are compared with its leader; once the components of those links are known, buckets
whose members still lie in several components are compared across components. Links inside
a component can't change it, so no pair is emitted for them; links between different components
are all tried. Every proposal is confirmed on the full shingle sets, by the words themselves.

In a bucket of more than SMALL members, trying all pairs across components would grow with its
square. There, members are compared by what differs from their leader: two sets are as far apart
as their differences from it, so a link needs a known number of shared differences, at least one
where an end isn't linked with the leader. Differences are indexed in one order, the rarest first, and a pair is met
only where enough places are left on both sides from the shared one on. This is exact, so
nothing is capped; the index is itself contracted by its own leaders first.

Nothing is collected: classes, buckets, links and labels are DataFrames, minima are aggregated
before they are shuffled, hot keys are only joined (which adaptive execution can split), and
lineage is cut by reliable checkpoints.

Defined results: null or wordless texts have an empty set, stay alone and are kept; repeated rows
are each other's copies; a row without a document id takes part as a copy only: its component is
that of its text, and it is never kept. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Words, arrow_map, checkpointed, lookup_of, mix, steps, table
from .components import connected_components

#: Word bytes: all but the space and \x09-\x0D.
LOOKUP = lookup_of(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
SHINGLE = 5
BANDS, ROWS = 25, 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Bytes of texts that are compared with others in one numpy step.
PAIR_BYTES = 1 << 20
#: Parts of a hot leader's members.
SALTS = 8
#: Places of a share of a leader's members are frequent.
SHARE = 1 / 16
#: In buckets of up to so many members, pairs across components are tried as they are.
SMALL = 48


class DigestedWords(Words):
    """Words whose hash is the first half of a 128-bit digest (blake2) of their bytes: nobody can choose words that share one."""

    def __init__(self, column: pa.Array):
        super().__init__(column, LOOKUP)
        _, first, self.at = np.unique(self.ids(), return_index=True, return_inverse=True)
        found = b"".join(hashlib.blake2b(self.word(i), digest_size=16).digest() for i in first.tolist())
        self.digest = np.frombuffer(found, "<u8").reshape(-1, 2)
        self.hash = self.digest[self.at, 0]


def shingle_sets(column: pa.Array | DigestedWords, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = column if isinstance(column, DigestedWords) else DigestedWords(column)
    grams, _ = w.grams(k)
    out = []
    first = w.first.tolist()
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(mix(w.hash[a:b] * (np.arange(b - a, dtype=U64) * U64(2) + U64(b - a) * U64(1 << 32) + U64(1))).sum(keepdims=True, dtype=U64))
        else:
            out.append(np.zeros(0, U64))
    return out


def digests(w: DigestedWords, k: int = SHINGLE) -> list[bytes | None]:
    """A digest of each text's set, None if it is empty: over its distinct shingles in the order of their hashes, each as two hashes of 64 bits, from either half of its words' digests."""
    hashes, out, first = w.grams(k)[0], [], w.first.tolist()
    w.hash = w.digest[w.at, 1]
    others = w.grams(k)[0]
    w.hash = w.digest[w.at, 0]
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= k:
            own, start = np.unique(hashes[a : b - k + 1], return_index=True)
            data = own.tobytes() + others[a + start].tobytes()
        else:
            data = w.digest[w.at[a:b]].tobytes()
        out.append(hashlib.blake2b(data, digest_size=16, salt=min(b - a, k).to_bytes(2, "little")).digest() if b > a else None)
    return out


def pair_sets(left: pa.Array, right: pa.Array, k: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each pair of texts the shingles as numbers that are equal for equal words alone (sorted, distinct), and their hashes: x, y, hashes of x, hashes of y."""
    w = DigestedWords(pa.concat_arrays([left, right]))
    codes, hashes = w.gram_ids(k), w.grams(k)[0]
    short: dict[bytes, int] = {}

    def one(i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= k:
            found, at = np.unique(codes[a : b - k + 1], return_index=True)
            return found, hashes[a : b - k + 1][at]
        if b == a:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        words = b"\0".join(w.word(j) for j in range(a, b))
        return np.array([-1 - short.setdefault(words, len(short))]), np.array([int.from_bytes(hashlib.blake2b(words, digest_size=8).digest(), "little")], U64)

    for i in range(len(left)):
        (x, hx), (y, hy) = one(i), one(len(left) + i)
        yield x, y, hx, hy


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Registers (documents x m); rows of empty sets are all infinite."""
    n = np.array([len(x) for x in sets], np.int64)
    registers = np.full(len(sets) * m, np.inf)
    h = np.concatenate(sets) if len(sets) else np.zeros(0, U64)
    doc = np.repeat(np.arange(len(sets)), n)
    drawn: list[np.ndarray] = []  # the place each earlier step drew, and what lay at the step's own place
    moved: list[np.ndarray] = []
    for j in range(m):
        if not len(h):
            break
        u = mix(h + U64(j * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
        rank = (u >> U64(24)).astype(np.float64) * 2.0**-40 + j
        place = (j + (((u & U64(0xFFFFFF)) * U64(m - j)) >> U64(24)).astype(np.int64)).astype(np.int16)
        here, there = np.full(len(h), j, np.int16), place.copy()
        for k, w in zip(drawn, moved, strict=True):
            here = np.where(k == j, w, here)
            there = np.where(k == place, w, there)
        there = np.where(place == j, here, there)
        np.minimum.at(registers, doc * m + there, rank)
        drawn.append(place)
        moved.append(here)
        # a register can only fall below j + 1 now or never
        going = (registers.reshape(-1, m).max(1) >= j + 1)[doc]
        if not going.all():
            h, doc = h[going], doc[going]
            drawn, moved = [x[going] for x in drawn], [x[going] for x in moved]
    return registers.reshape(-1, m)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; keys of different bands don't meet."""
    bits = registers.view(np.uint64).reshape(len(registers), bands, rows)
    keys = np.zeros((len(registers), bands), U64)
    for r in range(rows):
        keys = mix(keys ^ bits[:, :, r])
    return mix(keys + np.arange(bands, dtype=U64)).view(np.int64)


def signatures(documents: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """id, n (set size), cls (digest of the set, null if empty), keys (bands)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            words = DigestedWords(batch.column("text"))
            sets = shingle_sets(words, shingle)
            keys = band_keys(superminhash(sets, bands * rows), bands, rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array(digests(words, shingle), pa.binary()),
                    pa.array([k if len(x) else None for k, x in zip(keys, sets, strict=True)], pa.list_(pa.int64())),
                ],
                ["id", "n", "cls", "keys"],
            )

    return arrow_map(documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, n long, cls binary, keys array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are alike enough. texts: (id, text), ids distinct."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "ta", PAIR_BYTES):
            keep = []
            for x, y, _, _ in pair_sets(batch.column("ta"), batch.column("tb"), shingle):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    ta, tb = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return arrow_map(pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb"), run, "a long, b long")


def _alike(x, y, percent: int):
    """Sets whose sizes differ more can't be linked."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _met(member: DataFrame, differs: str = "id") -> DataFrame:
    """member (id, n, key, ...) where a key has more than one value of `differs`, with the key's leader, its smallest id."""
    crowd = member.groupBy("key").agg(F.min(F.struct("id", "n")).alias("leader"), F.min(differs).alias("lo"), F.max(differs).alias("hi"))
    return member.join(crowd.where("lo <> hi").select("key", "leader"), "key").select("key", "id", "n", "leader")


def _stars(met: DataFrame, percent: int) -> DataFrame:
    return met.where(F.col("id") != F.col("leader.id")).where(_alike(F.col("n"), F.col("leader.n"), percent)).select(F.col("leader.id").alias("a"), F.col("id").alias("b")).distinct()


def _open(met: DataFrame, roots: DataFrame, *keep: str) -> DataFrame:
    """The rows of buckets that still hold several components, with their component and the bucket's size."""
    placed = met.drop("root").join(roots, F.col("id") == F.col("node"), "left").select("key", "id", "n", *keep, F.coalesce("root", "id").alias("root"), F.col("leader.id").alias("leader"))
    keys = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("key", "size")
    return placed.join(keys, "key")


def _pairs(x: DataFrame, y: DataFrame, on: str, condition) -> DataFrame:
    met = x.alias("x").join(y.alias("y"), (F.col(f"x.{on}") == F.col(f"y.{on}")) & condition)
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _across(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of different components; those with the leader have been tried."""
    others = rest.where("id <> leader")
    return _pairs(others, others, "key", (F.col("x.root") < F.col("y.root")) & _alike(F.col("x.n"), F.col("y.n"), percent))


def _against_leader(rest: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Members of large buckets: leader, id, n, root, slack, linked (with the leader), diff.

    Buckets that share members have one leader, so each member has one row. diff: keys of the shingles that only one of the member and its leader has, in one order for all
    members of a leader. slack: (100 + percent) * |diff| - (100 - percent) * n;
    two members can only be linked if 2 * (100 + percent) times what their diffs share is no less than the sum of their slacks.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "ta", PAIR_BYTES):
            slack, linked, diff = [], [], []
            leaders = batch.column("leader").to_numpy().astype(U64)
            for leader, (x, y, hx, hy) in zip(leaders, pair_sets(batch.column("ta"), batch.column("tb"), shingle), strict=True):
                # the hashes of shingles that only one has: they propose, words decide
                own = np.concatenate([np.sort(hy[~np.isin(y, x, assume_unique=True)]), np.sort(hx[~np.isin(x, y, assume_unique=True)])])
                slack.append((100 + percent) * len(own) - (100 - percent) * len(y))
                linked.append(slack[-1] <= (100 - percent) * len(x))
                diff.append(mix(own ^ mix(np.array([leader], U64))).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("leader", "id", "n", "root")), pa.array(slack, pa.int64()), pa.array(linked), pa.array(diff, pa.list_(pa.int64()))], ["leader", "id", "n", "root", "slack", "linked", "diff"])

    groups = connected_components(rest.select(F.col("leader").alias("a"), F.col("id").alias("b"))).select("node", F.col("root").alias("leader"))
    members = rest.select("id", "n", "root").distinct()
    rows = members.join(groups, members["id"] == groups["node"], "left").select(F.coalesce("leader", "id").alias("leader"), "id", "n", "root")
    ta, tb = texts.select(F.col("id").alias("leader"), F.col("text").alias("ta")), texts.select("id", F.col("text").alias("tb"))
    return arrow_map(_spread(rows, ta).join(tb, "id").select("leader", "id", "n", "root", "ta", "tb"), run, "leader long, id long, n long, root long, slack long, linked boolean, diff array<long>")


def _spread(rows: DataFrame, of_leader: DataFrame) -> DataFrame:
    """rows (leader, id, ...) with what of_leader has for their leader. A leader of large buckets can be hot: its rows go to SALTS places, its own row to each."""
    salted = of_leader.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["leader", "__salt"]).drop("__salt")


def _rare_first(large: DataFrame) -> DataFrame:
    """large with each diff in an order, the same for all of a leader's members, that has at its end what many of them have (the most frequent last): a passage that very many share comes behind the
    places that a link must share, and proposes nothing.

    Which places are frequent is counted batch by batch: those of a SHARE of the leader's members there. So only frequent ones become rows, and of a leader's members no more than 2 / SHARE times the places of one
    come together. Any order is right; this one keeps proposals few.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaders, at = np.unique(batch.column("leader").to_numpy(), return_inverse=True)
            for i, leader in enumerate(leaders.tolist()):
                mine = np.flatnonzero(at == i)
                keys, n = np.unique(batch.column("diff").take(pa.array(mine)).flatten().to_numpy(), return_counts=True)
                often = n >= max(2, len(mine) * SHARE)
                size = int(often.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, leader)), pa.array(keys[often]), pa.array(n[often])], ["leader", "key", "often"])

    members = large.where("id <> leader")
    counted = arrow_map(members.select("leader", "diff"), run, "leader long, key long, often long").groupBy("leader", "key").agg(F.sum("often").alias("often"))
    sizes = members.groupBy("leader").agg(F.count("*").alias("size"))
    kept = counted.join(sizes, "leader").where(F.col("often") * 2 >= F.col("size") * SHARE)
    frequent = kept.groupBy("leader").agg(F.array_sort(F.collect_list(F.struct("often", "key")))["key"].alias("frequent"))
    held = _spread(large, frequent)
    others = large.join(frequent.select("leader"), "leader", "left_anti")
    return held.withColumn("diff", F.concat(F.array_except("diff", "frequent"), F.array_intersect("frequent", "diff"))).drop("frequent").unionByName(others)


def _enough(left, slacks, percent: int):
    """Whether so many shared places of two diffs can make a link."""
    return left * (2 * (100 + percent)) >= slacks


def _by_difference(large: DataFrame, percent: int) -> DataFrame:
    """key, id, n, root, slack, left: the places of each diff from which on a link is possible (left: places from here on).

    The leader's component has been tried against the leader, so one of a new link's ends lies outside it;
    the smallest slack of the other end bounds what must be shared, and places too late for that go.
    So does its size: what is shared is no more than the other's whole diff, whose slack is then
    (100 + percent) * shared - (100 - percent) * size at least. This keeps a member unlike the leader to a small part of its diff.
    """
    main = F.max_by("root", F.col("id") == F.col("leader"))
    of_leader = large.groupBy("leader").agg(main.alias("main"))
    rows = _spread(large.where("id <> leader"), of_leader).withColumn("root", F.when(F.col("linked"), F.col("main")).otherwise(F.col("root")))
    outside = F.col("root") != F.col("main")
    least = rows.groupBy("leader").agg(
        F.min("slack").alias("any"), F.min(F.when(outside, F.col("slack"))).alias("outer"), F.max("n").alias("any_n"), F.max(F.when(outside, F.col("n"))).alias("outer_n")
    )
    other = F.when(outside, F.col("any")).otherwise(F.col("outer"))
    most = F.least(F.when(outside, F.col("any_n")).otherwise(F.col("outer_n")), F.floor(F.col("n") * 100 / percent))
    must = F.greatest(F.ceil((F.col("slack") + other) / (2 * (100 + percent))), F.ceil((F.col("slack") - (100 - percent) * most) / (100 + percent)))
    # without a member outside, least() has nulls and no place is needed
    able = _spread(rows, least).where("outer is not null").withColumn("size", F.size("diff")).withColumn("first", F.col("size") - F.greatest(must, F.lit(1)) + 1).where("first > 0")
    placed = able.select("id", "n", "root", "slack", "size", F.posexplode(F.slice("diff", F.lit(1), F.col("first").cast("int"))).alias("at", "key"))
    return placed.select("key", "id", "n", "root", "slack", (F.col("size") - F.col("at")).cast("long").alias("left"))


def _difference_stars(places: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The places whose key has several components, and the pairs of each key's smallest id with the others that could be links."""
    crowd = places.groupBy("key").agg(F.min(F.struct("id", "n", "slack", "left")).alias("leader"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    met = checkpointed(places.join(crowd.where("lo <> hi").select("key", "leader"), "key"))
    possible = _enough(F.least("left", "leader.left"), F.col("slack") + F.col("leader.slack"), percent) & _alike(F.col("n"), F.col("leader.n"), percent)
    return met, met.where(possible & (F.col("id") != F.col("leader.id"))).select(F.col("leader.id").alias("a"), F.col("id").alias("b")).distinct()


def _difference_pairs(met: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of different components whose diffs can share enough, as seen from the first place they share."""
    others = _open(met, roots, "slack", "left").where("id <> leader")
    condition = (F.col("x.root") < F.col("y.root")) & _enough(F.least("x.left", "y.left"), F.col("x.slack") + F.col("y.slack"), percent) & _alike(F.col("x.n"), F.col("y.n"), percent)
    return _pairs(others, others, "key", condition)


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id (smallest id that links reach), kept."""
    signed = checkpointed(signatures(documents, id_col, text_col, shingle, bands, rows))
    classes = signed.where("cls is not null and id is not null").groupBy("cls").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    member = checkpointed(classes.select("id", "n", F.explode("keys").alias("key")))
    met = checkpointed(_met(member))
    # the texts that share a bucket with another, one for each class
    wanted = met.select("id").distinct()
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null").join(wanted, "id")
    texts = checkpointed(texts.dropDuplicates(["id"]))
    verify = lambda pairs: checkpointed(confirmed(pairs, texts, shingle, percent))
    roots = connected_components(verify(_stars(met, percent)))
    rest = checkpointed(_open(met, roots))
    more = verify(_across(rest.where(F.col("size") <= SMALL), percent))
    if not rest.where(F.col("size") > SMALL).isEmpty():
        large = checkpointed(_against_leader(rest.where(F.col("size") > SMALL), texts, shingle, percent))
        second, stars = _difference_stars(_by_difference(_rare_first(large), percent), percent)
        roots = connected_components(_edges(roots).union(verify(stars)).union(large.where("linked and id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"))))
        more = more.union(verify(_difference_pairs(second, roots, percent)))
    if not more.isEmpty():
        roots = connected_components(_edges(roots).union(more))
    of_class = classes.select("cls", F.col("id").alias("rep"))
    labelled = of_class.join(roots, of_class["rep"] == roots["node"], "left").select("cls", F.coalesce("root", "rep").alias("root"))
    out = signed.join(labelled, "cls", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE list_slice(w, i, i + 4) END AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT x, b FROM reach JOIN sym ON a = y)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) m USING (doc_id)
"""
