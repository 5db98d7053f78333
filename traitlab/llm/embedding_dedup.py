"""Embedding near-dedup by spherical-cap filters.

Every vector (unit length, randomly rotated) is cut into two halves and each
half is scored against ``B`` random codewords.  A filter direction is one
codeword of each half - a structured product code of B * B directions - and
a vector passes a filter when the two scores together exceed the cap height.
List decoding finds all filters a vector passes without scoring all B * B:
with the second half's scores sorted, each first codeword takes a prefix.
Vectors of one label that pass a common filter are candidates; candidates
whose 256-bit sign sketches differ far more than the threshold angle allows
are dropped before the vectors are fetched; the rest is verified by cosine
in double precision.  Equal vectors are one class first, so copies are
neither filtered nor joined twice.

B follows the largest label so that a filter holds a few vectors of a label
at any size, and a vector passes ``HITS`` filters on average.  The filters of
one table share codewords, so a vector's number of hits varies widely and a
pair just at the threshold shares none with a chance of some per cent, which
grows with the label.  So there are several tables, each with a rotation and
codewords of its own, and the candidates are the pairs of any of them.
Random rotations make the tables' misses of a pair independent, whatever the
data; tables are added until the product of their miss rates, each measured
on ``PROBES`` pairs exactly at the threshold and raised by three standard
errors, is at most ``MISSED``.  Where ``MOST_TABLES`` do not reach that (very
short vectors or a low threshold, when a fixed share of all pairs are links),
all pairs of a label are candidates.  Tests measure recall against brute
force.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, small_batches, written

HITS = 64          # filters passed by a vector, on average
IN_FILTER = 3.0    # vectors of the largest label in a filter, on average
SKETCH = 256       # sign bits
MISSED = 1e-6      # chance that a pair just at the threshold is no candidate
PROBES = 2000      # pairs on which a table's miss rate is measured
MOST_TABLES = 12
SEED = 20231


def plan_filters(dim: int, largest: int, seed: int = SEED, table: int = 0) -> dict:
    """Rotation, codewords and cap height of one table for a label of
    ``largest`` vectors of length ``dim``."""
    rng = np.random.default_rng([seed, dim, table] if table else [seed, dim])
    d = max(2, dim + dim % 2)
    rot = np.linalg.qr(rng.standard_normal((d, d)))[0][:dim]
    share = min(0.25, IN_FILTER / max(1, largest))
    b = max(8, math.ceil(math.sqrt(HITS / share)))
    codes = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.standard_normal((2, b, d // 2))]
    probe = rng.standard_normal((128, d))
    probe /= np.linalg.norm(probe, axis=1, keepdims=True)
    left, right = probe[:, :d // 2] @ codes[0].T, probe[:, d // 2:] @ codes[1].T
    lo, hi = -2.0, 2.0  # bisection for the height that HITS filters exceed on average
    right.sort(axis=1)
    for _ in range(24):
        mid = (lo + hi) / 2
        n = sum(b * b - int(np.searchsorted(r, mid - l).sum()) for l, r in zip(left, right))
        lo, hi = (mid, hi) if n > HITS * len(probe) else (lo, mid)
    return {"rot": rot, "codes": codes, "height": (lo + hi) / 2, "b": b}


def miss_rate(plan: dict, cosine: float, seed: int, pairs: int = PROBES) -> float:
    """Share of random pairs exactly at ``cosine`` that have no filter of the
    table in common, raised by three standard errors (and never 0)."""
    rng = np.random.default_rng([seed, pairs])
    dim, cosine = len(plan["rot"]), max(-1.0, min(1.0, cosine))
    missed = 0
    for at in range(0, pairs, 256):
        x, u = rng.standard_normal((2, min(256, pairs - at), dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        u -= (u * x).sum(axis=1, keepdims=True) * x
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        keys = [r * plan["b"] ** 2 + f for r, f in (decode(x, plan), decode(cosine * x + math.sqrt(1 - cosine ** 2) * u, plan))]
        missed += len(x) - len(np.unique(np.intersect1d(*keys) // plan["b"] ** 2))
    return min(1.0, (missed + 3 * math.sqrt(missed + 1)) / pairs)


def plan_tables(dim: int, largest: int, cosine: float, seed: int = SEED) -> list[dict]:
    """Tables that together miss a pair at ``cosine`` with a chance of at most
    ``MISSED``; none if that takes too many."""
    if dim < 2:  # unit numbers are equal or opposite
        return [plan_filters(dim, largest, seed)]
    plans, missed = [], 1.0
    for table in range(MOST_TABLES):
        plans.append(plan_filters(dim, largest, seed, table))
        missed *= miss_rate(plans[-1], cosine, seed + table)
        if missed <= MISSED:
            return plans
        if table == 0 and missed ** MOST_TABLES > MISSED:
            break
    return []


def candidates(x: np.ndarray, plans: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) over all tables, each with filter numbers of its own;
    without tables every vector passes the one filter 0."""
    if not plans:
        return np.arange(len(x)), np.zeros(len(x), int)
    found = [decode(x, p) for p in plans]
    start = np.cumsum([0] + [p["b"] ** 2 for p in plans])
    return np.concatenate([r for r, _ in found]), np.concatenate([f + at for (_, f), at in zip(found, start)])


def decode(x: np.ndarray, plan: dict) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every filter that each unit vector passes."""
    y = x @ plan["rot"]
    half = y.shape[1] // 2
    left, right = y[:, :half] @ plan["codes"][0].T, y[:, half:] @ plan["codes"][1].T
    order = np.argsort(-right, axis=1)
    rows, filters = [], []
    for i in range(len(x)):
        down = right[i, order[i]]
        n = np.searchsorted(-down, left[i] - plan["height"], side="right")
        first = np.flatnonzero(n)
        n = n[first]
        if len(n):
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            filters.append(np.repeat(first, n) * plan["b"] + order[i][at])
            rows.append(np.full(n.sum(), i))
    if not rows:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(rows), np.concatenate(filters)


def sign_directions(dim: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim, SKETCH]).standard_normal((dim, SKETCH))


def sketches(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    return np.packbits(x @ signs > 0, axis=1).view(np.int64)


def _far(cosine: float) -> int:
    """Sketch bits beyond which a pair at ``cosine`` lies with chance < 1e-8."""
    p = math.acos(cosine) / math.pi
    return math.ceil(SKETCH * p + 6 * math.sqrt(SKETCH * p * (1 - p))) + 1


_FILTER_ROW = T.StructType([T.StructField("label", T.LongType()), T.StructField("filter", T.LongType()),
                            T.StructField("id", T.LongType())]
                           + [T.StructField(f"s{i}", T.LongType()) for i in range(SKETCH // 64)])


def _filter_rows(plans: list[dict], signs: np.ndarray):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                rows, filters = candidates(x, plans)
                sk = sketches(x, signs)[rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column("label").take(pa.array(rows)), pa.array(filters.astype(np.int64)),
                     part.column("id").take(pa.array(rows))] + [pa.array(c) for c in sk.T],
                    names=[f.name for f in _FILTER_ROW])
    return run


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label", cosine: float = 0.93) -> tuple[DataFrame, DataFrame]:
    """``(classes, links)``: ``classes`` has one row per usable vector
    (id, class: smallest id among equal vectors of its label, size), ``links``
    one row (a, b), a < b, per pair of classes with cosine >= ``cosine``.

    Unusable vectors - null, empty, zero, with null or non-finite parts, or
    with a null label or id - are in neither.  Only vectors of one length are
    compared.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    v = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                        F.col(vec_col).cast("array<double>").alias("vec"))
         .where("id IS NOT NULL AND label IS NOT NULL AND size(vec) > 0")
         .where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                & F.exists("vec", lambda x: x != 0)))
    # scaled by the largest part first: lengths neither overflow nor vanish
    v = v.select("id", "label", F.transform("vec", lambda x: x / F.array_max(F.transform("vec", F.abs))).alias("vec"))
    keyed = v.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(7), F.col("vec"), F.lit(9)))
    keyed = written(keyed.dropDuplicates(["id", "label", "h1", "h2"]), "vectors")
    reps = written(keyed.groupBy("label", "h1", "h2")
                   .agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("size"), F.first("vec").alias("vec")), "classes")
    sizes = reps.groupBy(F.size("vec").alias("dim"), "label").count().groupBy("dim").agg(F.max("count").alias("n")).collect()
    links = None
    for dim, largest in sorted((r["dim"], r["n"]) for r in sizes):  # vector lengths: one row each
        plans = plan_tables(dim, largest, cosine)
        same = reps.where(F.size("vec") == dim)
        hits = written(same.select("label", F.col("class").alias("id"), "vec")
                       .mapInArrow(_filter_rows(plans, sign_directions(dim)), _FILTER_ROW), "filters")
        other = hits.select("label", "filter", *[F.col(c).alias(f"o_{c}") for c in hits.columns[2:]])
        bits = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"o_s{i}"))) for i in range(SKETCH // 64)), F.lit(0))
        pairs = (hits.join(other, ["label", "filter"]).where((F.col("id") < F.col("o_id")) & (bits <= _far(cosine)))
                 .select("label", F.col("id").alias("a"), F.col("o_id").alias("b")).distinct())
        one = same.select("label", F.col("class").alias("a"), F.col("vec").alias("va"))
        two = same.select("label", F.col("class").alias("b"), F.col("vec").alias("vb"))
        found = (pairs.join(one, ["label", "a"]).join(two, ["label", "b"])
                 .where(_dot("va", "vb") >= cosine * F.sqrt(_dot("va", "va") * _dot("vb", "vb"))).select("a", "b"))
        links = found if links is None else links.union(found)
    if links is None:
        links = spark.createDataFrame([], "a long, b long")
    member = keyed.join(reps.drop("vec"), ["label", "h1", "h2"]).select("id", "class", "size")
    return member, written(links, "links")


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label", cosine: float = 0.93) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Unusable vectors (see ``embedding_links``) have no links and are their
    own component (null for a null id) and kept.  Ids are expected to be
    unique; rows that repeat an id share its result.  An empty table gives an
    empty result.
    """
    member, links = embedding_links(vectors, id_col, vec_col, label_col, cosine)
    member = written(member, "members")
    size = member.groupBy("class").agg(F.first("size").alias("size"))
    ends = links.union(links.select("b", "a"))
    across = (ends.join(size.withColumnRenamed("class", "b"), "b")
              .groupBy("a").agg(F.sum("size").alias("across")).withColumnRenamed("a", "class"))
    comp = components(links, "a", "b").withColumnsRenamed({"id": "class"})
    per = (size.join(across, "class", "left").join(comp, "class", "left")
           .select("class", (F.col("size") - 1 + F.coalesce("across", F.lit(0))).alias("n_links"),
                   F.coalesce("component", "class").alias("component_id")))
    per = member.select("id", "class").join(per, "class").drop("class")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    out = rows.join(per, F.col("vec_id") == F.col("id"), "left")
    return (out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                       F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))
