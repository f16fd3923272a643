"""Toxicity: cumulative-link ordinal regression on sparse text features.

Severity has the grades 0 (not toxic), 1 (toxic) and 2 (toxic and of low quality). One weight vector w is shared by the
ordered thresholds: P(severity >= k) = sigmoid(w.x - t_k), t_1 < t_2. Features are a text's distinct words and their
prefixes of 3, 4 and 5 letters, hashed to ``FEATURES`` places; a G-test leaves those that tell toxicity. The output is the
expected severity, the sum of both probabilities, the grade, how many of the two reach ``threshold``, and ``toxic``, a grade above 0.

The model is fitted on at most ``sample`` labelled documents, the first by hash of doc_id (the bound is a parameter; the
fit is one task; several texts of one doc_id count as the least of them). Scoring covers every document, map-side, with the weights broadcast (FEATURES numbers at most).

Defined cases: a null or empty text has no features and gets the grade of the thresholds alone; labels of null count as
no label; a document with several label rows is taken once with its greatest toxicity; without any labels nothing is
toxic; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.shared import spread, staged, table

#: Places of hashed features, labelled documents of the fit, and words whose features a worker keeps.
FEATURES, SAMPLE, CACHE = 1 << 18, 12_000, 150_000
#: Full-batch steps, their rate, L2 penalty, G-test score and documents that a feature needs.
STEPS, RATE, PENALTY, SCREEN, LEAST = 600, 0.1, 1e-4, 25.0, 3
#: Probability of being toxic from which a document is.
THRESHOLD = 0.2
WORD = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    parts = {word, *(f"^{word[:n]}" for n in (3, 4, 5) if len(word) >= n)}
    return [xxhash.xxh32_intdigest(p.encode()) % FEATURES for p in parts]


def distinct_words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def screened(flat: np.ndarray, toxic: np.ndarray, n: int, n_toxic: int) -> np.ndarray:
    """Which features occur together with toxicity more or less often than chance, by the G-test."""
    with_, all_ = np.bincount(flat, weights=toxic, minlength=FEATURES), np.bincount(flat, minlength=FEATURES).astype(float)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    g = part(with_, all_ * n_toxic / n) + part(all_ - with_, all_ * (n - n_toxic) / n)
    g += part(n_toxic - with_, (n - all_) * n_toxic / n) + part(n - n_toxic - all_ + with_, (n - all_) * (n - n_toxic) / n)
    return (2 * g > SCREEN) & (all_ >= LEAST)


def fit(rows: list[np.ndarray], grade: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, weights and both thresholds, by full-batch Adam on the screened features."""
    n = len(rows)
    flat, of = np.concatenate([np.empty(0, np.int64), *rows]), np.repeat(np.arange(n), [len(r) for r in rows])
    use = screened(flat, (grade > 0)[of], n, int((grade > 0).sum()))
    places, keep = np.flatnonzero(use), use[flat]
    at, of = np.searchsorted(places, flat[keep]), of[keep]
    x = np.concatenate([np.zeros(len(places)), [1.0, 4.0]])  # weights, then the thresholds
    mean, square = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        score = np.bincount(of, weights=x[at], minlength=n)
        p1, p2 = _sigmoid(score - x[-2]), _sigmoid(score - x[-1])
        middle = np.maximum(p1 - p2, 1e-9)
        # slopes of the negative log-likelihood by (score - t_1) and (score - t_2)
        s1 = np.where(grade == 0, p1, np.where(grade == 1, -p1 * (1 - p1) / middle, 0.0)) / n
        s2 = np.where(grade == 1, p2 * (1 - p2) / middle, np.where(grade == 2, p2 - 1, 0.0)) / n
        slope = np.bincount(at, weights=(s1 + s2)[of], minlength=len(places)) + PENALTY * x[:-2]
        slope = np.concatenate([slope, [-s1.sum(), -s2.sum()]])
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        x -= RATE * (1 - step / STEPS) ** 0.5 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-7)
        x[-1] = max(x[-1], x[-2] + 0.05)
    return places, x[:-2], x[-2:]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """place, weight; the thresholds are at places -1 and -2."""
    known = labels.filter("toxic IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.struct("toxic", -F.coalesce("quality", F.lit(1)))).alias("l"))
    grade = F.when(F.col("l.toxic") == 0, 0).when(F.col("l.col2") == 0, 2).otherwise(1)
    chosen = spread(known.select("_id", grade.alias("grade")), ["_id"], sample)
    read = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = read.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("grade").alias("grade")).select("text", "grade")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({f for w in distinct_words(t) for f in word_features(w)}) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array(found, pa.list_(pa.int32())), batch.column("grade")], names=["features", "grade"])

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        places, weights, t = fit([np.asarray(f, np.int64) for f in pdf["features"]], pdf["grade"].to_numpy())
        return pd.DataFrame({"place": [-1, -2, *places], "weight": [*t, *weights]})

    sparse = rows.mapInArrow(features, "features array<int>, grade int")
    return staged(sparse.groupBy().applyInPandas(fitted, "place int, weight double"), "toxicity-weights")


class Scorer:
    """Severity of texts in a task, with a bounded cache of words' features."""

    def __init__(self, weights: dict[int, float]) -> None:
        self.weights, self.t = weights, (weights.get(-1, 40.0), weights.get(-2, 80.0))
        self.known: dict[str, tuple[int, ...]] = {}

    def features(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = found = tuple(f for f in word_features(word) if f in self.weights)
        return found

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """P(severity >= 1) and P(severity >= 2)."""
        total = [sum(self.weights[f] for f in sorted({f for w in distinct_words(t) for f in self.features(w)})) for t in texts]
        s = np.asarray(total, np.float64)
        return _sigmoid(s - self.t[0]), _sigmoid(s - self.t[1])


def _shared(docs: DataFrame, model: DataFrame):
    return docs.sparkSession.sparkContext.broadcast({r.place: r.weight for r in model.collect()})  # at most FEATURES + 2 rows


def score(docs: DataFrame, model: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, severity, grade, toxic of every document."""
    shared = _shared(docs, model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            p1, p2 = scorer(batch.column("text").to_pylist())
            grade = (p1 >= threshold).astype(np.int32) + (p2 >= threshold)
            columns = [batch.column("doc_id"), pa.array(p1 + p2), pa.array(grade), pa.array(p1 >= threshold)]
            yield pa.record_batch(columns, names=["doc_id", "severity", "grade", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, severity double, grade int, toxic boolean")


def without_toxic(docs: DataFrame, model: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that are not toxic."""
    shared = _shared(docs, model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            p1, _ = scorer(batch.column("text").to_pylist())
            yield batch.filter(pa.array(p1 < threshold))

    return docs.mapInArrow(scan, docs.schema)


def op8_toxicity(spark, sf_dir):
    """Expected severity of all ``documents``, fitted on labelled ones."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE_SQL: dict[str, str] = {}
