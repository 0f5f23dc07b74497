"""Language identification by sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are hashed counts of 1- to 3-grams of the lowered text's code points, damped by a logarithm, weighted by inverse
document frequencies over all learning rows, and scaled to length one. Weights are learned by follow-the-regularised-
leader with elastic-net penalties, which keeps most of them at exactly zero, on a sample of at most ``SAMPLE`` rows that
is spread evenly over the languages. A part of the learning rows that weights never see sets the temperature of the
softmax, so scores are calibrated. Learning rows are those with a text and a lang whose crc32 of doc_id modulo 4 is not 2.

Defined results: a null text and a text without letters are ``und`` with score 0, and so is every text if nothing could be
learned; rows with a null doc_id are held out of learning and marked false; repeated rows count as often as they stand
in the table; ties go to the smaller language name; texts of any length are read whole, one at a time; an empty table gives no rows;
other columns, whatever their names, are ignored (``identify``) or kept (``keep_documents``). The learning sample has about
``SAMPLE`` rows, twice that at most, evenly spread; a language is learned if the sample has a row of it, so all are as long as there
are no more than ``SAMPLE`` languages (beyond, the most frequent ones).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, drop, materialize

DIMENSIONS = 1 << 13
SAMPLE = 6000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 1e-4

LETTER = re.compile(r"[^\W\d_]")
_MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
_SHIFT = np.uint32(32 - (DIMENSIONS.bit_length() - 1))


def counts(text: str) -> np.ndarray:
    """Hashed counts of the n-grams of one text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    a, b, d = _MULTIPLIERS
    one = c * a
    two = (one[:-1] ^ (c[1:] + np.uint32(1))) * b
    three = (two[:-1] ^ (c[2:] + np.uint32(2))) * d
    return np.bincount(np.concatenate((one >> _SHIFT, two >> _SHIFT, three >> _SHIFT)), minlength=DIMENSIONS)


def vector(count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, TF-IDF values of length one)."""
    at = np.flatnonzero(count)
    x = (1 + np.log(count[at])) * idf[at]
    norm = np.sqrt(x @ x)
    return at, x / norm if norm else x


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by per-coordinate FTRL-proximal; rows are (places, values, class)."""
    z = np.zeros((DIMENSIONS, n_classes))
    n = np.zeros((DIMENSIONS, n_classes))

    def weights(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) > L1, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2), 0.0)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            w = weights(z[at], n[at])
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            nn = n[at]
            z[at] += g - (np.sqrt(nn + g * g) - np.sqrt(nn)) / ALPHA * w
            n[at] = nn + g * g
    return weights(z, n)


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that makes held-back rows most likely, between 1/50 and 50."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(-np.log(50), np.log(50), 201))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-300)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fold(column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4))


class Model:
    """Languages in order of their names, idf, weights and temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, heat: float):
        self.languages, self.idf, self.weights, self.heat = languages, idf, weights.astype(np.float32), heat

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for t in texts:
            if t is None or not self.languages or not LETTER.search(t):
                names.append("und")
                scores.append(0.0)
                continue
            at, x = vector(counts(t), self.idf)
            p = softmax((x.astype(np.float32) @ self.weights[at]).astype(np.float64) / self.heat)
            k = int(np.argmax(p))
            names.append(self.languages[k])
            scores.append(float(p[k]))
        return names, scores


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from docs(doc_id, text, lang). Document frequencies cover all learning rows; weights a bounded sample."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter((fold() != 2) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.ones(DIMENSIONS), np.zeros((DIMENSIONS, 0)), 1.0)
    each = max(1, sample // len(languages))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, each / sizes[k]))])
    drawn = F.coalesce(F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.element_at(share, F.col("lang")), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, lang, f, use in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = counts(text)
                df += c > 0
                n += 1
                if use:
                    at = np.flatnonzero(c)
                    for o, v in zip(out, (lang, f, at.astype(np.uint16).tobytes(), c[at].astype(np.uint32).tobytes()), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["lang", "f", "at", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([n], pa.int64()), pa.nulls(1, pa.binary()), pa.array([df.tobytes()], pa.binary())], ["lang", "f", "at", "n"])

    got = materialize(rows.select("text", "lang", fold().cast("long").alias("f"), drawn.alias("use")).mapInArrow(run, "lang string, f long, at binary, n binary"), "features")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for k, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                df, n = df + np.frombuffer(d, np.int64), n + k
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([df.tobytes()], pa.binary())], ["f", "n"])

    parts = got.filter("lang is null").select("f", "n").repartition(8).mapInArrow(add, "f long, n binary").collect()
    total, df = sum(r.f for r in parts), sum(np.frombuffer(bytes(r.n), np.int64) for r in parts)
    idf = np.log((1 + total) / (1 + df)) + 1
    place = {k: i for i, k in enumerate(languages)}
    learn, hold = [], []
    drawn_rows = got.filter("lang is not null").orderBy(F.xxhash64("at", "n"), "lang").limit(2 * sample)  # repeated rows can't swell it
    for r in sorted(drawn_rows.collect(), key=lambda r: (r.lang, bytes(r["at"]), bytes(r.n))):
        at, n = np.frombuffer(bytes(r["at"]), np.uint16).astype(np.int64), np.frombuffer(bytes(r.n), np.uint32)
        x = (1 + np.log(n)) * idf[at]
        (hold if r.f == 3 else learn).append((at, x / max(np.sqrt(x @ x), 1e-12), place[r.lang]))
    drop(got)
    weights = train(learn or hold, len(languages))
    logits = np.array([x @ weights[at] for at, x, _ in hold]) if hold else np.zeros((0, len(languages)))
    return Model(languages, idf, weights, temperature(logits, np.array([y for *_, y in hold], np.int64)))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs(doc_id, text, lang)."""
    bounded_batches(docs.sparkSession)
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return flat.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_documents(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """Rows whose language is known with at least ``least_score``, with all their columns."""
    bounded_batches(docs.sparkSession)
    model = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.predict(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array([n != "und" and s >= least_score for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
