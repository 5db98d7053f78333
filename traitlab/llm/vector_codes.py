"""Product codes of vectors, trained and assigned in whole numbers.

Each component x becomes floor(scale * x) and a vector is cut into equal
consecutive parts, each coded by the nearest entry of its part's codebook.
Nearest entries are found on integer Walsh-Hadamard transforms of the
zero-padded parts and entries: the transform is orthogonal up to its length
m, so the squared differences of two transforms add up to m times the squared
distance.  They are added coefficient by coefficient in sequency order; the
entry in front at a check is measured in full, and entries whose sum so far
exceeds the least full sum found are dropped.  An entry is dropped only when
it is farther than another for sure, and all numbers are integers, so the
result is exactly that of comparing every entry (ties to the lower index).

A round reads the vectors again, assigns them in tasks, and adds counts and
componentwise sums per (part, entry, position), first in each task, then in
Spark; only these (entries x dimension numbers) reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import matrix, written

ROWS = 2048            # vectors whose pairs with entries a task holds at once
FEW_GROUPS = 100_000   # groups whose sums are broadcast; more are joined by shuffle
SPREAD = 64            # tasks that share one group's rows there


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); Python's integers where 64 bits might not do."""
    if np.abs(x).max(initial=0) * scale < 2.0 ** 52:
        return np.floor(x * scale).astype(np.int64)
    big = [[math.floor(v * scale) if abs(v) < 2.0 ** 52 else int(v) * scale for v in r] for r in x.tolist()]
    return np.array(big, dtype=object).reshape(x.shape)


def sequency_order(m: int) -> np.ndarray:
    """Rows of the Hadamard matrix of size m (a power of two) by their number
    of sign changes."""
    signs = walsh_natural(np.eye(m, dtype=np.int64))
    return np.argsort((np.diff(signs, axis=1) != 0).sum(axis=1), kind="stable")


def walsh_natural(x: np.ndarray) -> np.ndarray:
    m, step = x.shape[1], 1
    x = x.copy()
    while step < m:
        y = x.reshape(len(x), m // (2 * step), 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), m)
        step *= 2
    return x


def walsh(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, zero-padded to a power of two,
    coefficients in sequency order."""
    m = 1 << max(0, x.shape[1] - 1).bit_length()
    padded = np.zeros((len(x), m), x.dtype)
    padded[:, :x.shape[1]] = x
    return walsh_natural(padded)[:, sequency_order(m)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry (the lowest of equal ones) and the
    squared distance to it."""
    n, k, d = len(x), len(entries), x.shape[1]
    if not n or not d:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    m = 1 << (d - 1).bit_length()
    most = max(int(np.abs(x).max()), int(np.abs(entries).max()))
    if m * d * 4 * most * most >= 1 << 63:
        x, entries = x.astype(object), entries.astype(object)
    else:
        x, entries = x.astype(np.int64), entries.astype(np.int64)
    best, dist = np.zeros(n, np.int64), np.zeros(n, x.dtype)
    he = walsh(entries)
    for at in range(0, n, ROWS):
        hx = walsh(x[at:at + ROWS])
        row, ent = np.repeat(np.arange(len(hx)), k), np.tile(np.arange(k), len(hx))
        acc = np.zeros(len(row), x.dtype)
        least = None
        for c in range(m):
            acc = acc + (hx[row, c] - he[ent, c]) ** 2
            if c + 1 < m and (c + 1) & c:
                continue  # checks after 1, 2, 4, ... coefficients and the last
            # pairs are in (row, entry) order, every row has one left
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            front = np.flatnonzero(acc == np.minimum.reduceat(acc, starts)[row])
            front = front[np.unique(row[front], return_index=True)[1]]
            if c + 1 == m:
                best[at:at + ROWS], dist[at:at + ROWS] = ent[front], acc[front] // m
                break
            full = ((hx - he[ent[front]]) ** 2).sum(axis=1)
            least = full if least is None else np.minimum(least, full)
            live = acc <= least[row]
            row, ent, acc = row[live], ent[live], acc[live]
    return best, dist


def _parts(x: np.ndarray, parts: int) -> list:
    return np.split(x, parts, axis=1)


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is not null and holds finite numbers only."""
    return vectors.where(F.col(vec_col).isNotNull() & ~F.exists(
        vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def train(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
          id_col: str = "vec_id", vec_col: str = "embedding") -> list:
    """Codebooks, an integer array (entries, part length) per part.

    They start as the parts of the vectors of the ``entries`` smallest ids
    (of equal ids the smaller vector, null ids last; fewer vectors, fewer
    entries).  A round assigns all parts and replaces each entry by its
    parts' componentwise floor(sum / count); entries without parts stay.
    """
    v = usable(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")), "v")
    length = v.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-length // parts)
    first = v.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()["v"].combine_chunks()
    books = _parts(integers(matrix(first, width * parts), scale), parts)
    if not len(first) or not width:
        return books
    for _ in range(rounds):
        now = books

        def add(batches):
            sums = [np.zeros(b.shape, object if b.dtype == object else np.int64) for b in now]
            counts = np.zeros((parts, len(now[0])), np.int64)
            for b in batches:
                x = integers(matrix(b.column(0), width * parts), scale)
                for p, (xp, book) in enumerate(zip(_parts(x, parts), now)):
                    code, _ = nearest(xp, book)
                    counts[p] += np.bincount(code, minlength=len(book))
                    if xp.dtype == object:
                        sums[p] = sums[p].astype(object)
                    np.add.at(sums[p], code, xp)
            where = [(p, e) for p in range(parts) for e in range(len(now[0])) if counts[p, e]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in where], pa.int32()), pa.array([e for _, e in where], pa.int32()),
                 pa.array([int(counts[w]) for w in where], pa.int64()),
                 pa.array([sums[p][e].tolist() for p, e in where], pa.list_(pa.int64()))],
                names=["part", "entry", "n", "s"])

        found = (v.select("v").mapInArrow(add, "part int, entry int, n long, s array<long>")
                 .select("part", "entry", "n", F.posexplode("s").alias("at", "s"))
                 .groupBy("part", "entry", "at")
                 .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
        books = [b.copy() for b in now]
        for r in found:
            books[r.part][r.entry, r.at] = int(r.s) // r.n
    return books


def encode(vectors: DataFrame, books: list, scale: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding",
           carry: tuple = ()) -> DataFrame:
    """``id, carry..., code, error``: a row per usable vector; ``code`` is the
    binary of one byte per part, ``error`` the squared distances' sum."""
    parts, width = len(books), books[0].shape[1]
    v = usable(vectors.select(F.col(id_col), *carry, F.col(vec_col).alias("_v")), "_v")

    def run(batches):
        for b in batches:
            x = integers(matrix(b.column("_v"), width * parts), scale)
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), object)
            for p, (xp, book) in enumerate(zip(_parts(x, parts), books)):
                codes[:, p], dist = nearest(xp, book)
                error += dist
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(b.num_columns - 1)],
                 pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([int(e) for e in error], pa.int64())],
                names=[*b.schema.names[:-1], "code", "error"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in v.schema.fields[:-1])
    return v.mapInArrow(run, f"{head}, code binary, error long")


def with_group_sum(rows: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over rows of an equal ``group``
    (nulls together).  The sums are added on the map side; up to
    ``FEW_GROUPS`` of them, counted, are broadcast, more meet the rows by
    shuffle, each group's rows dealt to ``SPREAD`` tasks."""
    key = F.struct(F.col(group)).alias("_g")
    sums = rows.groupBy(key).agg(F.sum(value).alias(out))
    if sums.count() <= FEW_GROUPS:
        return rows.withColumn("_g", key).join(F.broadcast(sums), "_g").drop("_g")
    dealt = rows.withColumns({"_g": key, "_s": (F.monotonically_increasing_id() % SPREAD).cast("int")})
    return dealt.join(sums.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))), ["_g", "_s"]).drop("_g", "_s")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
             id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list]:
    """Codes ``(vec_id, label, code, error, label_error)`` of all usable
    vectors, and the codebooks.

    Rows whose vector is null or holds a null or non-finite component are
    left out; an empty vector is coded like one of zeros, as are the missing
    components of a vector shorter than the table's longest, whose length is
    padded with zeros to a multiple of ``parts``.  Repeated rows and equal
    or null ids are rows like any other.  ``label_error`` is the error summed
    over rows of an equal label, nulls together.  An empty table gives no
    rows.  Errors beyond a signed 64-bit integer end the job.  Only the three
    named columns are read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    books = train(vectors, parts, entries, rounds, scale, id_col, vec_col)
    if not len(books[0]):  # no usable vector
        none = vectors.where("false").select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"))
        return none.withColumns({"code": F.lit(b""), "error": F.lit(0).cast("long"), "label_error": F.lit(0).cast("long")}), books
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("embedding"))
    codes = written(encode(named, books, scale, carry=("label",)), "codes")
    return with_group_sum(codes, "label", "error", "label_error"), books
