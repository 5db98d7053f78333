"""Labelled rows for the classifiers: all of them for counts, a bounded sample
for the fit, and the folds that are held out."""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold(id_col: str, parts: int):
    """crc32 of the id as text, modulo ``parts`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


@F.pandas_udf(T.BinaryType())
def packed(s: pd.Series) -> pd.Series:
    """Texts as compressed UTF-8, for the way through a shuffle (null: empty)."""
    z = zstandard.ZstdCompressor(level=1)
    return s.map(lambda t: z.compress((t or "").encode("utf-8", "surrogatepass")))


def unpack(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                  parts: int, held: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """``(rows, sampled)``: ``(z, y, h)``, packed text, label 0 or 1, a hash of
    the id, and ``(raw, y, h)``, the same with the text's bytes as they are.

    ``rows`` has every labelled document outside the held-out fold (a shuffle
    join at every size: the labels grow with the corpus);
    ``sampled`` the first ``sample`` labels of each class by the hash - few
    enough (2 * ``sample`` rows) to be broadcast to the documents.  Null and
    other labels, null ids and labels without a document are left out.
    """
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
             .where("y IN (0, 1)").where(fold("id", parts) != held)
             .withColumn("h", F.xxhash64(F.lit(11), F.col("id"))))
    d = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    rows = (d.where(fold("doc", parts) != held).select("doc", packed("text").alias("z"))
            .join(known.hint("merge"), F.col("doc") == F.col("id")).select("z", "y", "h"))
    few = [known.where(F.col("y") == c).orderBy("h", "id").limit(sample) for c in (0, 1)]
    sampled = (d.join(F.broadcast(few[0].union(few[1])), F.col("doc") == F.col("id"))
               .select(F.coalesce("text", F.lit("")).cast("binary").alias("raw"), "y", "h"))
    return rows, sampled


def logistic_line(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of P(1) = sigmoid(a m + b), with targets drawn in from 0 and 1
    by one row's weight: Newton steps, halved until the loss falls."""
    n1, n0 = weight[y == 1].sum(), weight[y == 0].sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack((m, np.ones(len(m))))

    def loss(v):
        z = v @ x
        return float((weight * (np.logaddexp(0, z) - t * z)).sum()) + 5e-4 * float(v @ v)

    v = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(v @ x, -30, 30)))
        g = x @ (weight * (p - t)) + 1e-3 * v
        h = (x * (weight * p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        d, now, size = np.linalg.solve(h, g), loss(v), 1.0
        while size > 1e-9 and loss(v - size * d) > now:
            size /= 2
        v = v - size * d
        if size * abs(d).max() < 1e-7:
            break
    return float(v[0]), float(v[1])


def sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))
