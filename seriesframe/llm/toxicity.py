"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Texts are lower-cased; all runs of 4 and 5 code points are hashed into 2**20 bins, and a text has or
hasn't a bin.  From the training texts, each bin's ratio is

    r = log((with toxic + a) / (toxic + 2 a)) - log((with clean + a) / (clean + 2 a)).

The bins whose chi-squared statistic is significant (all of them, however many) are features: their indicators times r.  A logistic
regression with an L2 penalty is trained on them by L-BFGS; each step sums losses and gradients on the executors, over the training rows'
bins as a written table, and only sums come to the driver.  Scoring looks each n-gram up in one table and sums the weights of the
distinct bins that a text has, so whole texts of any length are scored in one pass.

Defined cases: a null or empty text has no n-grams and gets the score of the intercept; texts shorter
than an n-gram likewise; very long texts are taken whole, slice by slice; repeated rows and equal texts are scored alike, so ties stay ties;
with no training rows of one class the score is 0.5 and predicted follows the threshold; an empty table gives an empty result; columns named
like the result's own are replaced, others don't take part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesframe.llm import textcols as tc
from seriesframe.llm.tables import Workspace, small_batches

BITS = 20
SIZES = (4, 5)
SLICE = 1 << 20  # code points of a very long text that are taken at once
_BLOCK = 4096  # bins of one row of counts


def grams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bin) of every n-gram of every text, in no special order; repeats included."""
    lower = pc.utf8_lower(text)
    data, _ = tc.raw(lower)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lengths = pc.utf8_length(lower).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    rows, bins = [], []
    for n in SIZES:
        m = len(points) - n + 1
        if m <= 0:
            continue
        with np.errstate(over="ignore"):
            h = np.full(m, n, np.uint32)
            for k in range(n):
                h = (h ^ points[k : k + m]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
        whole = row[:m] == row[n - 1 :]
        rows.append(row[:m][whole])
        bins.append((h >> np.uint32(32 - BITS))[whole])
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.uint32)
    return np.concatenate(rows), np.concatenate(bins)


def distinct(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bin) of the distinct bins of every text, by row and bin; one very long text is sliced, so that memory stays bounded."""
    if len(text) != 1 or tc.raw(text)[1][-1] <= 4 * SLICE:
        row, bin_ = grams(text)
        key = np.sort(row.astype(np.int64) << BITS | bin_)  # np.unique hashes, and takes some fifty times as long
        key = key[np.diff(key, prepend=-1) != 0]
        return key >> BITS, key & (1 << BITS) - 1
    whole, seen = text[0].as_py(), np.zeros(1 << BITS, bool)
    for a in range(0, len(whole), SLICE):  # slices overlap by what an n-gram may reach over
        seen[grams(pa.array([whole[a : a + SLICE + max(SIZES) - 1]], pa.large_string()))[1]] = True
    bins = np.flatnonzero(seen)
    return np.zeros(len(bins), np.int64), bins


@dataclass
class Model:
    weights: np.ndarray  # float32 for each bin, 0 where unused
    intercept: float = 0.0

    def score(self, text: pa.Array) -> np.ndarray:
        row, bin_ = distinct(text)
        sums = np.bincount(row, weights=self.weights[bin_], minlength=len(text))
        return np.round(1 / (1 + np.exp(-np.clip(sums + self.intercept, -40, 40))), 6)


def _counts(batches):
    counts, n = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
    for batch in batches:
        text, y = tc.column(batch, "text"), batch.column("label").to_numpy(zero_copy_only=False)
        for a, b in tc.pieces(text):
            row, bin_ = distinct(text.slice(a, b - a))
            label = y[a:b][row]
            for c in (0, 1):
                counts[c] += np.bincount(bin_[label == c], minlength=1 << BITS).astype(np.int32)
                n[c] += (y[a:b] == c).sum()
    used = np.flatnonzero(counts.any(0).reshape(-1, _BLOCK).any(1))
    rows = [counts[:, k * _BLOCK : (k + 1) * _BLOCK].astype(np.int64).tobytes() for k in used]
    yield pa.RecordBatch.from_arrays([pa.array([-1, *used.tolist()], pa.int32()), pa.array([n.tobytes(), *rows], pa.binary())], ["k", "v"])


def _add_up(batches):
    """Counts of equal blocks; there are 2**BITS / _BLOCK blocks at most."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, v in zip(batch.column("k").to_pylist(), batch.column("v").to_pylist(), strict=True):
            v = np.frombuffer(v, np.int64)
            sums[k] = sums[k] + v if k in sums else v
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["k", "v"])


def ratios(counts: np.ndarray, n: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Log-count ratio of each bin; counts[c] texts of class c have it, of n[c]."""
    return np.log((counts[1] + smoothing) / (n[1] + 2 * smoothing)) - np.log((counts[0] + smoothing) / (n[0] + 2 * smoothing))


def chi_squared(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each bin's table: with and without it, by class."""
    both = counts.sum(0)
    rest = n.sum() - both
    apart = counts[1] * (n[0] - counts[0]) - counts[0] * (n[1] - counts[1])
    return np.where((both > 0) & (rest > 0), apart**2 * n.sum() / np.maximum(n[0] * n[1] * both * rest, 1e-9), 0)


def sums(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, scaled: np.ndarray, b: float, weight: np.ndarray) -> np.ndarray:
    """Weighted log loss, its derivative by the intercept, and by the sum over each column, of some rows."""
    z = np.bincount(rows, weights=scaled[cols], minlength=len(y)) + b
    g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
    loss = (weight * (np.logaddexp(0, z) - y * z)).sum()
    return np.concatenate([[loss, g.sum()], np.bincount(cols, weights=g[rows], minlength=len(scaled))])


def minimise(function, start: np.ndarray, *, steps: int = 40, memory: int = 8, tolerance: float = 1e-4) -> np.ndarray:
    """L-BFGS: function gives the value and the gradient; ends when the gradient has shrunk to tolerance of the first one."""
    x = start
    value, grad = function(x)
    first = np.linalg.norm(grad)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.linalg.norm(grad) <= tolerance * first:
            break
        d, kept = grad.copy(), []
        for s, y in reversed(moves):
            a = s @ d / (s @ y)
            kept.append(a)
            d -= a * y
        d *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(first, 1e-12)
        for (s, y), a in zip(moves, reversed(kept), strict=True):
            d += (a - y @ d / (s @ y)) * s
        slope, size = grad @ d, 1.0
        while True:
            new = x - size * d
            new_value, new_grad = function(new)
            if new_value <= value - 1e-4 * size * slope or size < 1e-6:
                break
            size /= 3
        s, y = new - x, new_grad - grad
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            moves = [*moves, (s, y)][-memory:]
        x, value, grad = new, new_value, new_grad
    return x


def fit(training: DataFrame, *, significance: float = 10.83, least: int = 3, smoothing: float = 1.0, penalty: float = 1e-4, steps: int = 40) -> Model:
    """Fit on (doc_id, text, label) rows.

    Features are all bins that `least` training texts have and whose chi-squared is over `significance` (10.83: the 0.001 level).  The
    caller may bound the training rows (see training.labelled); the driver gets counts by bin (2**20 pairs) and sums by feature.
    """
    work = Workspace(training.sparkSession, "toxicity")
    texts = work.save(training.select("doc_id", "text", "label").sortWithinPartitions("label", "doc_id"), "training")
    found = texts.mapInArrow(_counts, "k int, v binary").repartition(16, "k").mapInArrow(_add_up, "k int, v binary").collect()
    counts, n = np.zeros((2, 1 << BITS)), np.zeros(2)
    for k, v in found:
        if k < 0:
            n = np.frombuffer(v, np.int64).astype(float)
        else:
            counts[:, k * _BLOCK : (k + 1) * _BLOCK] = np.frombuffer(v, np.int64).reshape(2, -1)
    weights = np.zeros(1 << BITS, np.float32)
    if (n == 0).any():
        work.clear()
        return Model(weights)
    chosen = np.flatnonzero((counts.sum(0) >= least) & (chi_squared(counts, n) > significance))
    ratio = ratios(counts, n, smoothing)[chosen]
    column_of = np.full(1 << BITS, -1, np.int32)
    column_of[chosen] = np.arange(len(chosen))
    context = training.sparkSession.sparkContext
    columns = context.broadcast(column_of)  # 4 MB, whatever the data

    def active(batches):
        for batch in batches:
            text, out = tc.column(batch, "text"), []
            for a, b in tc.pieces(text):
                row, bin_ = distinct(text.slice(a, b - a))
                col = columns.value[bin_]
                at = np.searchsorted(row[col >= 0], np.arange(b - a + 1))
                col = col[col >= 0]
                out += [col[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out, pa.binary())], ["label", "cols"])

    rows = work.save(texts.mapInArrow(active, "label int, cols binary"), "bins")

    def evaluate(x: np.ndarray) -> tuple[float, np.ndarray]:
        shared = context.broadcast((x[1:] * ratio, x[0]))

        def part(batches):
            scaled, b = shared.value
            total = np.zeros(len(scaled) + 2)
            for batch in batches:
                y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
                lists = batch.column("cols").to_pylist()
                cols = np.frombuffer(b"".join(lists), np.int32)
                total += sums(np.repeat(np.arange(len(y)), [len(c) // 4 for c in lists]), cols, y, scaled, b, np.where(y == 1, 0.5 / n[1], 0.5 / n[0]))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

        parts = rows.mapInArrow(part, "v binary").withColumn("k", F.spark_partition_id()).collect()
        total = np.sum([np.frombuffer(r.v) for r in sorted(parts, key=lambda r: r.k)], axis=0)
        shared.destroy()
        return total[0] + penalty / 2 * (x[1:] @ x[1:]), np.concatenate([[total[1]], total[2:] * ratio + penalty * x[1:]])

    x = minimise(evaluate, np.zeros(len(chosen) + 1), steps=steps)
    work.clear()
    weights[chosen] = x[1:] * ratio
    return Model(weights, float(x[0]))


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """The columns `keep` of docs (default: all but clashing ones), with score and predicted (score >= threshold)."""
    keep = [c for c in docs.columns if c not in (score_col, predicted_col)] if keep is None else keep
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            column = tc.column(batch, text)
            out = [shared.value.score(column.slice(a, b - a)) for a, b in tc.pieces(column, 1 << 20)]
            s = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*keep, score_col, predicted_col])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(score_col, T.DoubleType()), T.StructField(predicted_col, T.IntegerType())])
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
