"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each text gives a vector of transformed statistics (shares of character classes, repetition, word and
line shapes).  Each class has a mean and a covariance, shrunk towards its own diagonal and the pooled
covariance; the score is the logistic of the difference of the classes' log densities, from
Mahalanobis lengths through Cholesky factors made once per model.

Moments of ALL training rows are exact sums of integers (features on a fixed grid), added up by Spark,
so that a fit doesn't depend on the order of rows.

Defined cases: a null or empty text has the statistics of an empty text and gets a score; repeated rows
are scored alike, each once; labels that are null, or that disagree for one doc_id, are used as they
stand (null: skipped); with no training rows of one class the score is 0.5 for every text; an empty
table gives an empty result; other columns of the input never take part, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe.llm import textcols as tc
from seriesframe.llm.tables import small_batches

#: Features are rounded to 1/GRID and clipped to +-LIMIT: sums of products fit 64 bits for 3e10 rows.
GRID, LIMIT = 1024, 16.0

NAMES = (
    "log_words", "upper", "digit", "symbol", "stop_marks", "shout", "bar", "other_bytes", "word_length", "word_spread",
    "distinct_words", "distinct_lines", "line_words", "marked_words", "capital_words", "top_word", "echo",
)

_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _SHOUT, _BAR, _SYMBOL, _HIGH = range(9)


def _classes() -> np.ndarray:
    kinds = np.full(256, _SYMBOL, np.uint8)
    kinds[ord("A") : ord("Z") + 1] = _UPPER
    kinds[ord("a") : ord("z") + 1] = _LOWER
    kinds[ord("0") : ord("9") + 1] = _DIGIT
    kinds[:33] = _SPACE
    kinds[[ord(c) for c in ".,;:'-?\""]] = _STOP
    kinds[ord("!")] = _SHOUT
    kinds[ord("|")] = _BAR
    kinds[128:] = _HIGH
    return kinds


def _distinct(rows: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: how many distinct values of h, and the count of the most frequent one."""
    order = np.lexsort((h, rows))
    r, v = rows[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(r)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, r[at], runs)
    return np.bincount(r[at], minlength=n), most


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics for each text, on the grid."""
    n = len(offsets) - 1
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(row_of * 9 + _classes()[data], minlength=9 * n).reshape(n, 9).astype(float)
    starts, ends, first = tc.words(data, offsets)
    n_words = np.diff(first)
    word_row = np.repeat(np.arange(n), n_words)
    length = ends - starts
    wide = data[starts] >= 128 if len(starts) else np.zeros(0, bool)
    capital = ((data[starts] >= 65) & (data[starts] <= 90)) | wide if len(starts) else np.zeros(0, bool)
    marked = _classes()[data[ends - 1]] == _SYMBOL if len(starts) else np.zeros(0, bool)
    h = tc.span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    distinct, most = _distinct(word_row, h, n)
    echo = np.zeros(len(h), bool)
    echo[1:] = (h[1:] == h[:-1]) & (word_row[1:] == word_row[:-1])
    # lines, as runs of bytes between line feeds
    cut = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], cut + 1]))
    line_start = line_start[line_start < len(data)] if len(data) else line_start[:0]
    line_end = np.append(line_start[1:], len(data)) if len(line_start) else line_start
    line_row = row_of[line_start] if len(line_start) else line_start
    n_lines = np.bincount(line_row, minlength=n)
    distinct_lines, _ = _distinct(line_row, tc.span_hashes(data, line_start, line_end) if len(line_start) else np.zeros(0, np.uint64), n)

    total = np.maximum(kinds.sum(1) - kinds[:, _SPACE], 0)
    share = lambda part, whole, prior=0.02, weight=20.0: np.log((part + prior * weight) / (np.maximum(whole - part, 0) + (1 - prior) * weight))
    sums = lambda v: np.bincount(word_row, weights=v, minlength=n)
    w = np.maximum(n_words, 1)
    mean = sums(length) / w
    spread = np.sqrt(np.maximum(sums(length.astype(float) ** 2) / w - mean**2, 0))
    heavy = np.maximum(n_words, 1)
    x = np.stack([
        np.log1p(n_words) / 2,
        share(kinds[:, _UPPER], total, 0.04),
        share(kinds[:, _DIGIT], total),
        share(kinds[:, _SYMBOL], total),
        share(kinds[:, _STOP], total, 0.04),
        share(kinds[:, _SHOUT], total),
        share(kinds[:, _BAR], total),
        share(kinds[:, _HIGH], total, 0.05) / 2,
        np.log((mean * w + 5 * 10) / (w + 10)),
        np.log1p(spread),
        (distinct + 20) / (heavy + 20) * 4 - 3 + np.log1p(n_words) / 4,
        np.log((n_lines - distinct_lines + 0.5) / (distinct_lines + 5)),
        np.log((n_words + 10) / (n_lines + 1)),
        share(sums(marked.astype(float)), n_words),
        share(sums(capital.astype(float)), n_words, 0.1),
        np.log((most + 2) / (n_words + 20)),
        share(sums(echo.astype(float)), n_words),
    ], axis=1)
    return np.clip(np.round(x * GRID), -LIMIT * GRID, LIMIT * GRID).astype(np.int64)


@dataclass
class Model:
    means: np.ndarray  # (2, d)
    factors: np.ndarray  # (2, d, d): inverse Cholesky factors of the shrunk covariances
    offsets: np.ndarray  # (2,): log prior - log determinant / 2
    usable: bool = True

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        if not self.usable:
            return np.zeros(len(x))
        out = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.factors[c].T
            out.append(self.offsets[c] - 0.5 * (z * z).sum(1))
        return out[1] - out[0]

    def score(self, x: np.ndarray, temperature: float) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x) / temperature, -40, 40)))


def from_moments(count: np.ndarray, first: np.ndarray, second: np.ndarray, shrink_pool: float, shrink_diag: float, floor: float) -> Model:
    """count (2,), first (2, d), second (2, d, d): sums over the training rows of each class."""
    d = first.shape[1]
    if (count < 2).any():
        return Model(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), usable=False)
    means = first / count[:, None]
    own = second / count[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (own * count[:, None, None]).sum(0) / count.sum()
    factors, offsets = [], []
    for c in (0, 1):
        cov = (1 - shrink_pool) * own[c] + shrink_pool * pooled
        cov = (1 - shrink_diag) * cov + shrink_diag * np.diag(np.diag(cov)) + floor * np.eye(d)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        offsets.append(np.log(count[c] / count.sum()) - np.log(np.diag(low)).sum())
    return Model(means, np.array(factors), np.array(offsets))


def _moments(batches):
    d = len(NAMES)
    count, first, second = np.zeros(2, np.int64), np.zeros((2, d), np.int64), np.zeros((2, d, d), np.int64)
    for batch in batches:
        text, y = tc.column(batch, "_t"), batch.column("_y").to_numpy(zero_copy_only=False)
        for a, b in tc.pieces(text):
            x, label = features(*tc.raw(text.slice(a, b - a))), y[a:b]
            for c in (0, 1):
                own = x[label == c]
                count[c] += len(own)
                first[c] += own.sum(0)
                second[c] += own.T @ own
    flat = np.concatenate([np.concatenate([[count[c]], first[c], second[c].ravel()]) for c in (0, 1)])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["k", "v"])


def fit(texts: DataFrame, *, text: str = "text", label: str = "label", shrink_pool: float = 0.1, shrink_diag: float = 0.1, floor: float = 0.01) -> Model:
    """Fit on every row of texts whose label is 0 or 1.  Only sums come to the driver: one fixed-size vector."""
    rows = texts.where(F.col(label).isin(0, 1)).select(F.col(text).alias("_t"), F.col(label).cast("int").alias("_y"))
    small_batches(texts.sparkSession)
    sums = rows.mapInArrow(tc.frugal(_moments), "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()
    d = len(NAMES)
    flat = np.zeros(2 * (1 + d + d * d))
    for k, v in sums:
        flat[k] = v
    flat = flat.reshape(2, -1)
    return from_moments(flat[:, 0], flat[:, 1 : 1 + d] / GRID, flat[:, 1 + d :].reshape(2, d, d) / GRID**2, shrink_pool, shrink_diag, floor)


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None, threshold: float = 0.7, temperature: float = 1.0, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """The columns `keep` of docs (default: all but clashing ones), with score (0 to 1, 6 decimals) and predicted (score >= threshold)."""
    keep = [c for c in docs.columns if c not in (score_col, predicted_col)] if keep is None else keep
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kB, whatever the data

    def run(batches):
        for batch in batches:
            column, out = tc.column(batch, text), []
            for a, b in tc.pieces(column):
                out.append(shared.value.score(features(*tc.raw(column.slice(a, b - a))) / GRID, temperature))
            s = np.round(np.concatenate(out) if out else np.zeros(0), 6)
            arrays = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*keep, score_col, predicted_col])

    from pyspark.sql import types as T

    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField(score_col, T.DoubleType()), T.StructField(predicted_col, T.IntegerType())])
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(tc.frugal(run), schema)
