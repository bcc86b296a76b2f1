"""Language identification by a byte convolutional network.

Bytes are embedded, filters of three widths slide over them, each filter's largest response in a
fixed-length window is kept (max pooling), and a softmax layer gives the window's language. A
document's probabilities are the means over all its windows, weighted by their bytes. Training is
numpy (Adam) on a bounded sample of labelled rows; inference is numpy on batches of windows.

Training takes at most SAMPLE rows of each language, by a hash of doc_id, with their whole texts, and the LANGS languages with
the most rows; its steps are as many as EPOCHS passes over TRAIN_WINDOWS of the sample's windows, drawn from all of them; nothing else is bounded. Scores look at whole texts and at nothing else of a row.

Defined results: null texts and texts without a letter are `und` with score 0, and so is every
text when no labelled row is left to learn from; repeated rows repeat; empty tables give no rows;
rows without a language are scored but not learned from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, flat, steps, table

#: Labelled rows of each language to learn from, and languages.
SAMPLE, LANGS = 500, 200
WINDOW, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4), 16, 8
EPOCHS, BATCH, TRAIN_WINDOWS = 4, 256, 24_000
#: Windows that one matrix product handles.
STEP = 512
UNKNOWN = "und"


def windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x (size + widest - 1) bytes, padded with 0; text of each; bytes of each) tiling every text."""
    n = np.diff(offsets)
    many = -(-n // size)
    text = np.repeat(np.arange(len(n)), many)
    within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    start = offsets[:-1][text] + within * size
    long = np.minimum(size, offsets[1:][text] - start)
    at = start[:, None] + np.arange(size + max(WIDTHS) - 1)
    inside = at < offsets[1:][text][:, None]
    out = np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0) if len(data) else np.zeros(at.shape, np.uint8)
    return out.astype(np.uint8), text, long


class Network:
    def __init__(self, langs: list[str], seed: int = 0):
        draw = np.random.default_rng(seed)
        self.langs = langs
        self.embed = draw.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = [draw.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = draw.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.out_bias]

    def _responses(self, x: np.ndarray) -> np.ndarray:
        """windows x places x filters; narrow filters are padded to the widest."""
        widest = max(WIDTHS)
        places = x.shape[1] - widest + 1
        bank = np.concatenate([np.pad(f, ((0, widest * EMBED - len(f)), (0, 0))) for f in self.filters], 1)
        e = self.embed[x]
        columns = np.concatenate([e[:, i : i + places] for i in range(widest)], 2)
        return (columns.reshape(-1, widest * EMBED) @ bank).reshape(len(x), places, -1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(x), STEP):
            pooled = np.maximum(self._responses(x[i : i + STEP]).max(1) + self.bias, 0)
            z = pooled @ self.out + self.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            out.append(z / z.sum(1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)), np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        r = self._responses(x)
        best = r.argmax(1)
        top = np.take_along_axis(r, best[:, None], 1)[:, 0] + self.bias
        pooled = np.maximum(top, 0)
        z = pooled @ self.out + self.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(x)), y] -= 1
        p /= len(x)
        back = (p @ self.out.T) * (top > 0)
        d_embed, d_filters = np.zeros_like(self.embed), []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            b, at = back[:, part], best[:, part]
            seen = x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(w)]
            d_filters.append(np.einsum("nf,nfk->kf", b, self.embed[seen].reshape(len(x), FILTERS, w * EMBED)))
            np.add.at(d_embed, seen, (b[:, :, None] * f.T[None]).reshape(len(x), FILTERS, w, EMBED))
        return [d_embed, *d_filters, back.sum(0), pooled.T @ p, p.sum(0)]


def fit(rows: list[tuple[str, str]], seed: int = 0) -> Network | None:
    """rows: (text, lang)."""
    rows = [(t, lang) for t, lang in rows if t and lang is not None and any(map(str.isalpha, t))]
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    net, draw = Network(langs, seed), np.random.default_rng(seed)
    data, offsets = flat(pa.array([t for t, _ in rows], pa.large_string()))
    x, text, long = windows(data, offsets)
    number = {lang: i for i, lang in enumerate(langs)}
    y = np.array([number[lang] for _, lang in rows])[text]
    # every language weighs the same, and texts of few bytes are learned as well
    share = 1 / np.bincount(y, minlength=len(langs))[y]
    momentum = [np.zeros_like(p) for p in net.parameters()]
    square = [np.zeros_like(p) for p in net.parameters()]
    total = EPOCHS * max(1, min(TRAIN_WINDOWS, len(x)) // BATCH)
    for t in range(1, max(total, 120) + 1):
        pick = draw.choice(len(x), BATCH, p=share / share.sum())
        part = x[pick].copy()
        short = draw.random(BATCH) < 0.25
        cut = draw.integers(12, WINDOW, BATCH)
        part[(np.arange(part.shape[1])[None] >= cut[:, None]) & short[:, None]] = 0
        rate = 0.01 * (1 - t / (max(total, 120) + 1))
        for p, m, s, g in zip(net.parameters(), momentum, square, net.gradients(part, y[pick]), strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return net


def train(documents: DataFrame, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network from at most SAMPLE rows of each language for which `where` holds."""
    rows = documents if where is None else documents.where(where)
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    rows = rows.withColumn("draw", F.pmod(F.xxhash64("id"), F.lit(1 << 30)))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()
    if not counts:
        return None
    # a share of each language that gives SAMPLE rows or a few more, all of a small one
    limit = F.lit(0)
    for r in counts:
        share = min(1.0, SAMPLE * 1.2 / r["count"])
        limit = F.when(F.col("lang") == r["lang"], F.lit(int(share * (1 << 30)))).otherwise(limit)
    got = rows.where(F.col("draw") < limit).select("draw", "lang", "text").orderBy("draw", "lang", "text").limit(2 * SAMPLE * len(counts)).collect()
    kept: dict[str, list[str]] = {}
    for r in got:
        if len(mine := kept.setdefault(r["lang"], [])) < SAMPLE:
            mine.append(r["text"])
    return fit([(t, lang) for lang, texts in sorted(kept.items()) for t in texts])


def predict(texts: pa.Array, net: Network | None) -> tuple[list[str], list[float]]:
    if net is None:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    data, offsets = flat(texts)
    x, text, long = windows(data, offsets)
    p = net.probabilities(x) * long[:, None]
    total = np.zeros((len(texts), len(net.langs)))
    np.add.at(total, text, p)
    lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
    best = total.argmax(1)
    score = total[np.arange(len(texts)), best] / np.maximum(np.diff(offsets), 1)
    return [net.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], np.where(lettered, np.clip(score, 0, 1), 0.0).tolist()


def identify(documents: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred and score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "__text", 1 << 20):
            langs, score = predict(batch.column("__text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], [batch.schema.names[0], "lang_pred", "score"])

    source = documents.select(F.col(id_col), F.col(text_col).alias("__text"))
    return arrow_map(source, run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, lang_pred string, score double")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train(documents, ~held())
    return identify(documents, net).select("doc_id", F.coalesce(held(), F.lit(False)).alias("held_out"), "lang_pred", "score")
