"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class has a mean and a covariance shrunk towards its own diagonal; a score is the
logistic of the difference of Mahalanobis log-densities, from Cholesky factors that
are computed once. Only per-class counts, sums and cross products reach the driver.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut

NAMES = [
    "log_words", "log_lines", "word_len", "word_len_sd", "short_words", "long_words", "distinct_words", "distinct_trigrams",
    "line_repeats", "upper", "digit", "space", "stop_marks", "commas", "other_marks", "quotes", "non_ascii", "top_word",
    "mark_tailed", "upper_words", "title_words", "lines_per_word", "byte_entropy", "top_byte", "bars", "sentence_len",
]
D = len(NAMES)
STOP, COMMA, QUOTE = np.frombuffer(b".?", np.uint8), np.frombuffer(b",;:", np.uint8), np.frombuffer(b"\"'", np.uint8)
OTHER = np.frombuffer(b"!#$%&()*+-/<=>@[\\]^_`{|}~", np.uint8)
#: Labelled rows used for the fit at most; a documented bound on training rows only.
FIT_ROWS = 2_000_000


def statistics(text: bytes) -> np.ndarray:
    """Transformed statistics of one UTF-8 text: shares on a square-root scale, counts on a log scale."""
    words = text.split()
    n, size = len(words), max(len(text), 1)
    if not n:
        return np.zeros(D)
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / size
    lens = np.fromiter(map(len, words), np.float64, n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen = len(set(words))
    grams = len(set(zip(words, words[1:], words[2:]))) if n > 2 else 1
    tops = np.unique(np.fromiter(map(hash, words), np.int64, n), return_counts=True)[1].max()
    last = np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)
    first = np.frombuffer(b"".join(w[:1] for w in words), np.uint8)
    second = np.frombuffer(b"".join(w[1:2] or b" " for w in words), np.uint8)
    cap, cap2 = (first >= 65) & (first <= 90), (second >= 65) & (second <= 90)
    p = c[c > 0]
    ends = max(1, text.count(b". ") + text.count(b".\n") + 1)
    share = [
        (lens <= 3).mean(), (lens >= 12).mean(), seen / n, grams / max(n - 2, 1), 1 - len(set(lines)) / max(len(lines), 1), c[65:91].sum(), c[48:58].sum(), c[32] + c[9:14].sum(),
        c[STOP].sum(), c[COMMA].sum(), c[OTHER].sum(), c[QUOTE].sum(), c[128:].sum(), tops / n, np.isin(last, OTHER).mean(), (cap & cap2).mean(), (cap & ~cap2).mean(), len(lines) / n,
    ]
    s = np.sqrt(share)
    return np.array([np.log1p(n), np.log1p(len(lines)), np.log(lens.mean()), np.log1p(lens.std()), *s[:14], *s[14:], -(p * np.log(p)).sum(), np.sqrt(c[33:].max()), np.sqrt(c[124]), np.log(n / ends)])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in cut(batches):
        x = np.array([statistics(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()], np.float32).reshape(-1, D)
        stats = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), D).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), stats], names=["doc_id", "stats"])


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of each text (array<float>); null counts as empty, all zeros."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_describe, "doc_id long, stats array<float>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, s, ss = np.zeros(2), np.zeros((2, D)), np.zeros((2, D, D))
    for batch in batches:
        x = np.array(batch.column("stats").values.to_numpy(zero_copy_only=False), np.float64).reshape(-1, D)
        y = batch.column("y").to_numpy()
        for k in (0, 1):
            own = x[y == k]
            n[k] += len(own)
            s[k] += own.sum(axis=0)
            ss[k] += own.T @ own
    flat = np.concatenate([n[:, None], s, ss.reshape(2, -1)], axis=1)
    yield pa.RecordBatch.from_pydict({"k": np.repeat([0, 1], flat.shape[1]), "at": np.tile(np.arange(flat.shape[1]), 2), "v": flat.ravel()})


class Discriminant:
    """Two-class quadratic discriminant; shrink is the weight of the diagonal in each covariance.

    Both regularisers were chosen by fitting on one half of the training rows and scoring the other.
    """

    def __init__(self, n: np.ndarray, s: np.ndarray, ss: np.ndarray, shrink: float = 0.05, floor: float = 5e-3):
        self.parts = []
        for k in (0, 1):
            mean = s[k] / n[k] if n[k] else np.zeros(D)
            cov = ss[k] / n[k] - np.outer(mean, mean) if n[k] else np.eye(D)
            cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + floor * np.eye(D)
            low = np.linalg.cholesky(cov)
            prior = np.log((n[k] + 1) / (n.sum() + 2))
            self.parts.append((mean, np.linalg.inv(low).T, prior - np.log(np.diag(low)).sum()))
        self.temper = 1.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        low, high = (const - 0.5 * (((x - mean) @ half) ** 2).sum(axis=1) for mean, half, const in self.parts)
        return high - low

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(-self.margin(x) / self.temper, -60, 60)))


#: Statistics are correlated beyond the model, so a log-density difference counts for less than its face value: it is
#: divided by that one of these under which the training rows have the least log loss. No score crosses 0.5 by it.
TEMPERS = (1.0, 2.0, 4.0, 8.0, 16.0)


def _losses(model: Discriminant, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(TEMPERS))
    for batch in batches:
        x = np.array(batch.column("stats").values.to_numpy(zero_copy_only=False), np.float64).reshape(-1, D)
        away = np.where(batch.column("y").to_numpy() == 1, -1.0, 1.0) * model.margin(x)
        total += [np.logaddexp(0, away / t).sum() for t in TEMPERS]
    yield pa.RecordBatch.from_pydict({"at": np.arange(len(TEMPERS)), "v": total})


def fit(stats: DataFrame, labels: DataFrame, shrink: float = 0.05, fit_rows: int = FIT_ROWS) -> Discriminant:
    """Fit on labels (doc_id, y in 0/1; at most ``fit_rows`` rows) joined to described documents.

    Null labels and ids are left out. With no labels of a class, its density is a standard one.
    """
    labels = labels.where("y in (0, 1) and doc_id is not null").dropDuplicates(["doc_id"])
    if labels.count() > fit_rows:
        labels = labels.orderBy(F.xxhash64("doc_id")).limit(fit_rows)
    known = stats.join(labels, "doc_id").select("stats", F.col("y").cast("int"))
    got = known.mapInArrow(_moments, "k long, at long, v double")
    flat = np.zeros((2, 1 + D + D * D))
    for r in got.groupBy("k", "at").agg(F.sum("v").alias("v")).collect():  # a fixed number of rows
        flat[r["k"], r["at"]] = r["v"]
    n, s, ss = flat[:, 0], flat[:, 1 : 1 + D], flat[:, 1 + D :].reshape(2, D, D)
    model = Discriminant(n, s, ss, shrink)
    losses = {r["at"]: r["v"] for r in known.mapInArrow(functools.partial(_losses, model), "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}  # one row a choice
    model.temper = TEMPERS[min(losses, key=lambda k: (losses[k], k))] if losses else 1.0
    return model


def _scored(model: Discriminant, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array(batch.column("stats").values.to_numpy(zero_copy_only=False), np.float64).reshape(-1, D)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, shrink: float = 0.05, threshold: float = 0.5) -> DataFrame:
    """Quality of every document, learned from ``labels`` (doc_id, quality) outside the held-out third.

    Returns one row per input row: doc_id, held_out, score (0 to 1; higher: quality 1
    likelier), predicted (1 if score >= threshold). Scores come from the text alone: null and empty
    texts share one score. A null doc_id is scored, never learned from and not held out. Repeated
    ids give a row each. Without labels all scores still lie in 0 to 1.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.put(describe(docs), "stats")
    learn = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("y")).where(~held_out(F.col("doc_id")))
    model = fit(stats, learn, shrink)
    out = stats.mapInArrow(functools.partial(_scored, model), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
