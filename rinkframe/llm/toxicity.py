"""Toxicity by compression distance with zstandard dictionaries.

Two dictionaries are trained on a bounded sample of labelled rows: one on windows of ordinary text, one on toxic
passages. A toxic passage is an n-gram of words that toxic texts have far more often than clean ones, with a letter or two around it;
how often is counted in different neighbourhoods, so that a family of copies counts once, and a mislabelled row
rules no n-gram out. Each window of a document is compressed with the ordinary dictionary alone and with both (the
toxic one nearest); the bytes saved are its distance. As the ordinary part
and its offsets are the same in both (zeros stand in for the toxic one), ordinary windows save nothing or next to it. Windows
are short, so that zstandard keeps letters as they are and a single toxic word shows. A logistic calibration of the largest saving, the mean saving and the share of
windows that save, fitted on labelled rows that trained no dictionary, gives the score.

Only training reads labels: at most SAMPLE rows of each class, in the order of a hash of doc_id, with their whole texts.
Scores look at whole texts and at nothing else of a row.

Defined results: null and empty texts get the score of a text without savings; repeated rows
repeat; rows of labels without an id or a label teach nothing; without labelled rows of both classes every score is next to 0; empty tables give no
rows; extra columns are kept by score(), which adds `__score`.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, steps, table

#: Labelled rows of each class to learn from.
SAMPLE = 1000
#: Toxic passages are n-grams of up to GRAM words with PAD characters on both sides: RATIO times as frequent in toxic texts, with a log-likelihood ratio of CHANCE (p of 1e-6).
GRAM, PAD, RATIO, CHANCE = 3, 1, 4, 24.0
WINDOW, BEFORE, ORDINARY_BYTES, TOXIC_BYTES, LEVEL, THRESHOLD = 48, 16, 16_000, 2_000, 12, 0.7


class Model:
    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, np.array([-9.0, 0.0, 0.0, 0.0])

    def compressors(self):
        if not hasattr(self, "_both"):
            of = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            self._both = of(self.ordinary + bytes(len(self.toxic))).compress, of(self.ordinary + self.toxic).compress
        return self._both

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_both"}

    def features(self, text: str | None) -> tuple[float, float, float]:
        plain, mixed = self.compressors()
        data = (text or "").lower().encode()
        saved = [len(plain(w)) - len(mixed(w)) for a in range(0, len(data), WINDOW) if (w := data[max(0, a - BEFORE) : a + WINDOW])]
        if not saved:
            return 0.0, 0.0, 0.0
        return float(max(saved)), sum(max(0, x) for x in saved) / len(saved), sum(x >= 2 for x in saved) / len(saved)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def fragments(text: str | None, most: int = GRAM) -> set[str]:
    """The word n-grams of a text, up to `most` words."""
    words = re.findall(r"\w+", (text or "").lower())
    return {" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)}


def contrast(toxic: list[str | None], clean: list[str | None]) -> list[tuple[float, str]]:
    """(log-likelihood ratio, fragment), ascending: fragments in a share of the toxic texts that is RATIO times their share of the clean ones, beyond chance."""
    docs, near, na, nb, out = {}, {}, len(toxic), len(clean), []
    texts = [["", *re.findall(r"\w+", (t or "").lower()), ""] for t in toxic]
    for n in range(1, GRAM + 1):
        around, found = defaultdict(set), defaultdict(set)
        for d, words in enumerate(texts):
            for i in range(1, len(words) - n):
                # an n-gram is in no more texts than its parts, so few need counting
                if n == 1 or (" ".join(words[i : i + n - 1]) in docs and " ".join(words[i + 1 : i + n]) in docs):
                    w = " ".join(words[i : i + n])
                    around[w].add((words[i - 1], words[i + n]))
                    found[w].add(d)
        docs |= {w: len(x) for w, x in found.items() if len(x) >= 3}
        near |= {w: len(around[w]) for w in found if w in docs}
    # words that stand in few neighbourhoods alone are parts of a longer phrase, or of a family of copies
    a = {w: k for w in docs if (k := min(docs[w], near[w])) >= 3}
    b = Counter(w for t in clean for w in fragments(t) if w in a)

    def fits(k: int, n: int, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if k < n else 0.0)

    for w, k in a.items():
        if nb and (k + 0.5) * (nb + 1) >= RATIO * (b[w] + 0.5) * (na + 1):
            g = 2 * (fits(k, na, k / na) + fits(b[w], nb, b[w] / nb) - fits(k, na, (k + b[w]) / (na + nb)) - fits(b[w], nb, (k + b[w]) / (na + nb)))
            if g >= CHANCE:
                out.append((g, w))
    return sorted(out)


def passages(texts: list[str | None], chosen: set[str]) -> list[bytes]:
    """The distinct occurrences of chosen fragments, with PAD characters on both sides."""
    if not chosen:
        return []
    found, any_of = set(), re.compile("|".join(re.escape(w) for w in sorted(chosen, key=lambda w: (-len(w), w))))
    for t in texts:
        words = f" {' '.join(re.findall(r'\w+', (t or '').lower()))} "
        found |= {words[max(0, m.start() - PAD) : m.end() + PAD].encode() for m in any_of.finditer(words)}
    return sorted(found)


def dictionary(samples: list[bytes], size: int) -> bytes:
    """What zstandard's trainer makes of the samples; too few samples to train on are the dictionary themselves."""
    total = sum(map(len, samples))
    if not total:
        return b""
    try:
        return zstandard.train_dictionary(size, samples * (1 + 50 * size // total), level=3).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[:size]


def fit(rows: list[tuple[str | None, int]]) -> Model:
    """rows: (text, toxic). A third of them calibrate, the rest train the dictionaries."""
    learn, check = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    bad = [t for t, y in learn if y]
    chosen = {w for _, w in contrast(bad, [t for t, y in learn if not y])}
    toxic = dictionary(passages(bad, chosen), TOXIC_BYTES)
    # clean or mislabelled rows that hold a fragment would hide it from the comparison
    clean = [(t or "").lower().encode() for t, y in learn if not y and chosen.isdisjoint(fragments(t))]
    ordinary = dictionary([w for t in clean for a in range(0, len(t), 160) if (w := t[a : a + 160])], ORDINARY_BYTES)
    model = Model(ordinary, b" " + toxic + b" ")
    y = np.array([v for _, v in check], float)
    if not toxic or not y.any() or y.all():
        return model
    x = np.array([model.features(t) for t, _ in check])
    z = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(4)
    balance = np.where(y > 0, 0.4, 1.0)  # the sample has as many toxic rows as others, a corpus far fewer
    for _ in range(60):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (balance * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(4)
        w = w + np.linalg.solve(h, z.T @ (balance * (y - p)) - 1e-2 * w)
    model.weights = w
    return model


def train(documents: DataFrame, labels: DataFrame, where=None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most SAMPLE labelled rows of each class for which `where` holds."""
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and id is not null")
    if where is not None:
        marks = marks.where(where(F.col("id")))
    both = [marks.where(F.col("toxic") == v).orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for v in (0, 1)]
    chosen = rows.join(F.broadcast(both[0].union(both[1])), "id").select("id", "text", "toxic")

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)), key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([(t, y) for _, t, y in got]))], pa.binary())], ["model"])

    # the sample meets in a task: its texts and n-grams would stay in the driver's memory for all that comes after
    found = arrow_map(chosen.repartition(1), learn, "model binary").first()
    return pickle.loads(found.model) if found else fit([])


def score(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of documents, and score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_col, 1 << 20):
            x = np.array([shared.value.features(t) for t in batch.column(text_col).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(x))], [*batch.schema.names, "__score"])

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in documents.schema)}, __score double"
    return arrow_map(documents, run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = lambda i: F.crc32(i.cast("string").cast("binary")) % 3
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(documents, table(spark, sf_dir, "labels"), lambda i: fold(i) != 1)
    scored = score(documents, model).select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), F.col("__score").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
