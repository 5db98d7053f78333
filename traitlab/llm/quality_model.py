"""Quality classifier: a support vector machine on naive-Bayes features.

A text is the set of its n-grams (indicators): byte n-grams of length 1 to 4
and the runs of equal words of length 2 to 4 (an n-gram of words of which
only the equality is kept), each hashed to a bucket.  Every indicator is
scaled by its bucket's log-count ratio between the classes, counted over all
labelled rows; the scaled vector has unit length.  A linear hinge-loss model
is fitted on it by dual coordinate descent, on a bounded sample of labelled
rows, and its margins become probabilities by a logistic fit on the margins
of a second, disjoint sample.

Counting and scoring run on whole texts in Spark tasks.  What reaches the
driver is bounded by parameters: one row per bucket, and the n-gram sets of
``2 * SAMPLE`` rows per class, each of at most ``BUCKETS / 8`` bytes however
long its text.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .labelled import fold, logistic_line, sigmoid, training_rows, unpack

BUCKETS = 1 << 17
LENGTHS = (1, 2, 3, 4)
SAMPLE = 2000      # labelled rows per class for the fit, as many again for the logistic
EPOCHS = 12
COST = 1.0
PRIOR = 1.0
_RUN_BUCKETS = np.array([zlib.crc32(b"run%d" % k) % BUCKETS for k in range(5)])


class Grams:
    """N-gram sets; holds one flag per bucket between calls."""

    def __init__(self):
        self.seen = np.zeros(BUCKETS, bool)

    def of(self, raw: bytes) -> np.ndarray:
        """Sorted buckets of the n-grams of a text's bytes."""
        seen = self.seen
        for at in range(0, len(raw), 1 << 20):  # long texts in overlapping parts
            b = np.frombuffer(raw[at:at + (1 << 20) + LENGTHS[-1]], np.uint8).astype(np.uint32)
            for n in LENGTHS:
                if len(b) >= n:
                    code = b[:len(b) - n + 1].copy()
                    for k in range(1, n):
                        code |= b[k:len(b) - n + 1 + k] << np.uint32(8 * k)
                    code = (code ^ np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)
                    seen[(code ^ (code >> np.uint32(15))) & np.uint32(BUCKETS - 1)] = True
        words = raw.split()
        run = longest = 1
        for a, b in zip(words, words[1:]):
            run = run + 1 if a == b else 1
            if run > longest:
                longest = run
        seen[_RUN_BUCKETS[2:min(longest, 4) + 1]] = True
        out = np.flatnonzero(seen)
        seen[out] = False
        return out


def packed(grams: np.ndarray) -> bytes:
    """A set as the steps between its sorted buckets, a byte of 255 for every
    255 and one for the rest, or as a flag per bucket where that is shorter:
    at most ``BUCKETS / 8`` bytes."""
    step = np.diff(grams, prepend=0)
    ends = np.cumsum(step // 255 + 1)
    if not len(ends) or ends[-1] < BUCKETS // 8:
        out = np.full(ends[-1] if len(ends) else 0, 255, np.uint8)
        out[ends - 1] = step % 255
        return out.tobytes()
    flags = np.zeros(BUCKETS, bool)
    flags[grams] = True
    return np.packbits(flags).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    """Sorted buckets of a ``packed`` set."""
    if len(raw) < BUCKETS // 8:
        step = np.frombuffer(raw, np.uint8)
        return np.cumsum(step, dtype=np.int64)[step < 255]
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8)))


class Scaled:
    """Rows ``(indices, values)`` of packed sets, scaled by ``ratio`` to unit
    length; a row is unpacked when it is asked for, so the sets stay packed."""

    def __init__(self, sets: list, ratio: np.ndarray):
        self.sets, self.ratio = sets, ratio

    def __len__(self):
        return len(self.sets)

    def __getitem__(self, i: int):
        grams = unpacked(self.sets[i])
        r = self.ratio[grams]
        return grams, (r / (float(np.sqrt(r @ r)) or 1.0)).astype(np.float32)


def dual_descent(rows, y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS, seed: int = 1):
    """Weights and bias of min |w|^2/2 + sum cost * hinge, by coordinate
    descent on the dual (box [0, cost]); rows, a list or the like, are (indices, values)."""
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            idx, v = rows[i]
            g = y[i] * (w[idx] @ v + bias) - 1.0
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[idx] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, bias


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray   # ratio times the fitted weight
    bias: float
    line: tuple[float, float] = (1.0, 0.0)

    def margin(self, grams: np.ndarray) -> float:
        r = self.ratio[grams]
        n = float(np.sqrt(r @ r))
        return (float(self.weight[grams].sum()) / n if n else 0.0) + self.bias

    def score(self, grams: np.ndarray) -> float:
        return sigmoid(self.line[0] * self.margin(grams) + self.line[1])


def fit(rows: DataFrame, sampled: DataFrame) -> Model:
    """A model from texts with label 0 or 1: ratios from all ``rows``, weights
    from ``sampled`` (see ``training_rows``).  With one class only, or
    no rows, scores are the share of 1."""
    small_batches(rows.sparkSession)

    def count(batches):  # one row per bucket, class and task
        n, g, size = np.zeros((2, BUCKETS), np.int64), Grams(), np.zeros(2, np.int64)
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n[y, g.of(unpack(t))] += 1
                size[y] += 1
        for y in (0, 1):
            at = np.flatnonzero(n[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.full(len(at) + 1, y, np.int32)),
                                              pa.array(np.append(n[y][at], size[y]))], names=["bucket", "y", "n"])

    counts = (rows.select("z", "y").mapInArrow(count, "bucket long, y int, n long")
              .groupBy("bucket", "y").agg(F.sum("n").alias("n")).toArrow())
    n, size = np.zeros((2, BUCKETS)), np.zeros(2)
    bucket, y, c = (counts.column(i).to_numpy() for i in range(3))
    n[y[bucket >= 0], bucket[bucket >= 0]] = c[bucket >= 0]
    size[y[bucket < 0]] = c[bucket < 0]
    base = (size[1] + 1) / (size.sum() + 2)
    if not size.all():
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, (0.0, float(np.log(base / (1 - base)))))
    p, q = n[1] + PRIOR, n[0] + PRIOR
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[(n[0] + n[1]) == 0] = 0.0

    def grams(batches):
        g = Grams()
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), pa.array([packed(g.of(t)) for t in b.column(0).to_pylist()], pa.binary())],
                names=["y", "h", "grams"])

    got = sampled.mapInArrow(grams, "y int, h long, grams binary").toArrow().sort_by([("h", "ascending"), ("y", "ascending")])
    y = got.column("y").to_numpy()
    sets = got.column("grams").to_pylist()
    del got
    taken = {c: np.flatnonzero(y == c) for c in (0, 1)}
    first = np.sort(np.concatenate([v[:max(1, (len(v) + 1) // 2)] for v in taken.values()]))
    second = np.setdiff1d(np.arange(len(y)), first)
    sign = np.where(y[first] == 1, 1.0, -1.0)
    cost = COST * len(first) / (2 * np.where(sign > 0, (sign > 0).sum(), (sign < 0).sum()))
    w, bias = dual_descent(Scaled([sets[i] for i in first], ratio), sign, cost)
    model = Model(ratio, ratio * w, bias)
    use = second if len(set(y[second])) == 2 else first
    m = np.array([model.margin(unpacked(sets[i])) for i in use])
    share = size / np.array([(y[use] == c).sum() for c in (0, 1)])  # rows that a sampled row stands for
    weight = share[y[use]] * len(use) / share[y[use]].sum()
    model.line = logistic_line(m, y[use], weight)
    return model


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of every row's whole text."""
    small_batches(docs.sparkSession)
    packed = (model.ratio.astype(np.float32), model.weight.astype(np.float32), model.bias, model.line)
    shared = docs.sparkSession.sparkContext.broadcast(packed)  # two floats per bucket: 1 MB

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ratio, weight, bias, line = shared.value
        m, g = Model(ratio.astype(float), weight.astype(float), bias, line), Grams()
        for s in parts:
            yield s.map(lambda t: m.score(g.of((t or "").encode("utf-8", "surrogatepass")))).astype(float)

    return docs.withColumn(name, run(F.col(text_col)))


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            label_col: str = "quality", parts: int = 4, held: int = 2) -> Model:
    """The model of the labelled rows outside the held-out fold."""
    return fit(*training_rows(docs, labels, id_col, text_col, label_col, parts, held, 2 * SAMPLE))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", parts: int = 4, held: int = 2, cut: float = 0.7) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Learns only from labelled rows outside the held-out fold.  Null and empty
    texts are scored from the bias alone; null or other labels and labels
    without a document teach nothing; a document with several labels counts
    with each.  A null id is not held out.  An empty table gives no rows.
    """
    model = learned(docs, labels, id_col, text_col, label_col, parts, held)
    s = with_score(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model)
    return s.select("doc_id", F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              cut: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score below ``cut``."""
    scored = with_score(docs, learned(docs, labels, id_col, text_col), text_col, "__score")
    return scored.where(F.col("__score") >= cut).drop("__score")
