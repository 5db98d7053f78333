"""Hard negatives for anchors, found through a multiway hyperplane tree.

The tree is fitted on a bounded sample (``SAMPLE`` rows of the smallest id
hashes): a node picks up to ``FANOUT`` split points far from one another and
deals its points to the nearest, a division by hyperplanes.  Every row is
then sent down the tree, and each node records, over all rows, the least and
largest distance from each of its split points, and from the origin, to each
child's subtree.

A search asks for rows whose inner product with the anchor lies in a window.
With the subtree's range of norms this is a ring of distances around the
anchor, and a row in the ring is at a bounded distance from every split
point.  A child whose recorded range does not meet that interval, for any of
the split points, is eliminated; the leaves that remain are compared exactly.
So the tree only saves work: no row of the answer is lost.  A search first
looks in the anchor's own leaf, whose best rows narrow its windows, and then
in all leaves left.

A leaf is dealt to blocks of about ``BLOCK`` rows by id hash, and the anchors
that visit it to packs of about as many, so a task holds a block and a pack
however large a leaf (a vector copied many times) is; a block's answer is the
first few rows per window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import matrix, written

SAMPLE = 4096      # rows on which the tree is fitted
FANOUT = 8         # split points of a node
LEAF = 1024        # rows below which a node is not split
BLOCK = 8192       # rows of a block and anchors of a pack, on average at most
TILE = 256         # anchors whose scores with a block a task holds at once
SEED = 7


class Tree:
    """``points[node]``: split points (k, dim); ``child[node][j]``: the node
    that split point j leads to, or -1 - leaf; ``near``, ``far`` [node]:
    distances (k + 1, k) of each split point, last the origin, to each
    child's rows."""

    def __init__(self, sample: np.ndarray, rows: int):
        self.points, self.child, self.leaves = [], [], 0
        rng = np.random.default_rng(SEED)
        each = rows / max(1, len(sample))  # rows that one of the sample stands for

        def grow(x):
            far = self._split_points(x, rng) if len(x) * each > LEAF and len(x) >= 2 * FANOUT else x[:0]
            if len(far) < 2:
                self.leaves += 1
                return -self.leaves
            node = len(self.points)
            self.points.append(far)
            self.child.append(None)
            side = distances(x, far).argmin(axis=1)
            self.child[node] = np.array([grow(x[side == j]) for j in range(len(far))])
            return node

        grow(sample)
        self.near = [np.full((len(p) + 1, len(p)), np.inf) for p in self.points]
        self.far = [np.full((len(p) + 1, len(p)), -np.inf) for p in self.points]

    @staticmethod
    def _split_points(x, rng):
        """Far from one another, out of a few random rows each."""
        some = np.unique(x[rng.permutation(len(x))[:3 * FANOUT]], axis=0)
        pick, gap = [0], distances(some, some[:1])[:, 0]
        while len(pick) < min(FANOUT, len(some)):
            pick.append(int(gap.argmax()))
            gap = np.minimum(gap, distances(some, some[pick[-1]:pick[-1] + 1])[:, 0])
        return some[pick]

    def walk(self, x: np.ndarray):
        """Sends rows down: yields (node, rows, distances to the split points,
        side taken) on the way; returns the leaf of each row."""
        leaf = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if self.points else []
        while todo:
            node, at = todo.pop()
            d = distances(x[at], self.points[node])
            side = d.argmin(axis=1)
            yield node, at, d, side
            for j, c in enumerate(self.child[node]):
                some = at[side == j]
                if c < 0:
                    leaf[some] = -1 - c
                elif len(some):
                    todo.append((int(c), some))
        return leaf

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        walk = self.walk(x)
        while True:
            try:
                next(walk)
            except StopIteration as end:
                return end.value

    def visit(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, leaf) for every leaf that may hold a row whose inner
        product with the anchor lies in one of its windows; ``low`` and
        ``high`` are (anchors, windows), an empty window has low > high."""
        if not self.points:
            return np.arange(len(q)), np.zeros(len(q), np.int64)
        who, where, todo = [], [], [(0, np.arange(len(q)))]
        square = (q * q).sum(axis=1)
        while todo:
            node, at = todo.pop()
            near, far = self.near[node], self.far[node]
            d = np.c_[distances(q[at], self.points[node]), np.sqrt(square[at])]
            slack = 1e-6 * (1 + d.max(axis=1))
            for j, c in enumerate(self.child[node]):
                if near[-1, j] > far[-1, j]:
                    continue  # no rows
                keep = np.zeros(len(at), bool)
                for w in range(low.shape[1]):
                    lo, hi = low[at, w], high[at, w]
                    a = np.sqrt(np.maximum(square[at] + near[-1, j] ** 2 - 2 * hi, 0)) - slack
                    b = np.sqrt(np.maximum(square[at] + far[-1, j] ** 2 - 2 * lo, 0)) + slack
                    # a row at distance r of [a, b] is at |d - r| to d + r from the split point
                    least = np.maximum(0, np.maximum(a[:, None] - d, d - b[:, None]))
                    meets = (least <= far[:, j] + slack[:, None]) & (d + b[:, None] >= near[:, j] - slack[:, None])
                    keep |= (lo <= hi) & (square[at] + far[-1, j] ** 2 - 2 * lo >= -slack) & meets.all(axis=1)
                some = at[keep]
                if not len(some):
                    continue
                if c < 0:
                    who.append(some)
                    where.append(np.full(len(some), -1 - c))
                else:
                    todo.append((int(c), some))
        return (np.concatenate(who), np.concatenate(where)) if who else (np.zeros(0, int), np.zeros(0, int))


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(p)))
    for j, y in enumerate(p):
        out[:, j] = np.sqrt(((x - y) ** 2).sum(axis=1))
    return out


def floors(column, scale: float, dim: int) -> np.ndarray:
    """floor(scale * x) of an Arrow list column."""
    return np.floor(matrix(column, dim) * scale)


def first_rows(score: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``take`` largest numbers above -inf of each row,
    equal ones by column."""
    k = min(take, score.shape[1])
    if not k or not len(score):
        return np.zeros(0, int), np.zeros(0, int)
    edge = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    r, c = np.nonzero((score >= edge[:, None]) & (score > -np.inf))
    order = np.lexsort((c, -score[r, c], r))
    r, c = r[order], c[order]
    nth = np.arange(len(r)) - np.searchsorted(r, r)
    return r[nth < take], c[nth < take]


class Index:
    """All rows in their leaves, and the tree with its ranges."""

    def __init__(self, rows: DataFrame, scale: float):
        """``rows``: (id, label, v), ids not null and each one row."""
        self.spark, self.scale = rows.sparkSession, scale
        rows = written(rows, "vectors")
        r = rows.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
        self.dim, count = r[0] or 0, r[1]
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
        self.tree = tree = Tree(floors(sample, scale, self.dim), count)
        dim = self.dim

        def ranges(batches):
            near, far = [x.copy() for x in tree.near], [x.copy() for x in tree.far]
            count = np.zeros(max(1, tree.leaves), np.int64)
            for b in batches:
                x = floors(b.column(0), scale, dim)
                walk = tree.walk(x)
                while True:
                    try:
                        node, at, d, side = next(walk)
                    except StopIteration as end:
                        count += np.bincount(end.value, minlength=len(count))
                        break
                    d = np.c_[d, np.sqrt((x[at] ** 2).sum(axis=1))]
                    for j in np.unique(side):
                        some = d[side == j]
                        near[node][:, j] = np.minimum(near[node][:, j], some.min(axis=0))
                        far[node][:, j] = np.maximum(far[node][:, j], some.max(axis=0))
            out = [(n, int(i), int(j), float(near[n][i, j]), float(far[n][i, j]))
                   for n in range(len(near)) for i, j in zip(*np.nonzero(near[n] <= far[n]))]
            out += [(-1, i, 0, 0.0, float(c)) for i, c in enumerate(count) if c]
            yield pa.RecordBatch.from_pylist([dict(zip(("node", "i", "j", "near", "far"), x)) for x in out], schema=pa.schema(
                [("node", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("near", pa.float64()), ("far", pa.float64())]))

        found = (rows.select("v").mapInArrow(ranges, "node int, i int, j int, near double, far double")
                 .groupBy("node", "i", "j").agg(F.min("near").alias("near"), F.max("far").alias("far"),
                                                F.sum("far").alias("n")).collect())
        counts = np.zeros(max(1, tree.leaves), np.int64)
        for x in found:
            if x.node < 0:
                counts[x.i] = int(x.n)
            else:
                tree.near[x.node][x.i, x.j], tree.far[x.node][x.i, x.j] = x.near, x.far
        #: Blocks of each leaf.
        self.blocks = -(-counts // BLOCK)

        def place(batches):
            for b in batches:
                leaf = tree.leaf_of(floors(b.column("v"), scale, dim))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32))], names=[*b.schema.names, "leaf"])

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
        placed = rows.mapInArrow(place, schema + ", leaf int")
        self.rows = written(self._numbers(placed).withColumn("blk", F.pmod(F.xxhash64("id"), "blocks").cast("int")).drop("blocks"), "leaves")

    def _numbers(self, rows: DataFrame, asked: dict | None = None) -> DataFrame:
        """``rows`` with their leaf's ``blocks`` and, given how many anchors
        visit each leaf, ``packs``; a row per leaf, at most as many as rows in
        the sample, is broadcast."""
        if asked is None:
            few = self.spark.createDataFrame([(i, int(n)) for i, n in enumerate(self.blocks)], "leaf int, blocks int")
        else:
            few = self.spark.createDataFrame([(i, int(self.blocks[i]), -(-n // BLOCK)) for i, n in asked.items() if self.blocks[i]],
                                             "leaf int, blocks int, packs int")
        return rows.join(F.broadcast(few), "leaf")

    def _compare(self, anchors: DataFrame, same: bool, take: int) -> DataFrame:
        """``anchors`` (leaf, id, label, v, low, high: a window each), every
        row to be compared with a leaf: (anchor, w, id, score) of the first
        ``take`` rows per window of each block and pack."""
        asked = {r.leaf: r.n for r in anchors.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
        left = self._numbers(self.rows, asked).select(
            "leaf", "blk", F.explode(F.sequence(F.lit(0), F.col("packs") - 1)).alias("pack"), "id", "label", "v")
        right = self._numbers(anchors, asked).select(
            "leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"),
            F.pmod(F.xxhash64("id"), "packs").cast("int").alias("pack"), "id", "label", "v", "low", "high")
        scale, dim = self.scale, self.dim

        def run(rows, asks):
            out = [[], [], [], []]
            if rows.num_rows and asks.num_rows:
                rows = rows.sort_by("id")
                ids, lab = rows["id"].to_numpy(), rows["label"].to_numpy()
                x = floors(rows["v"].combine_chunks(), scale, dim)
                q = floors(asks["v"].combine_chunks(), scale, dim)
                qid, qlab = asks["id"].to_numpy(), asks["label"].to_numpy()
                low, high = np.array(asks["low"].to_pylist()), np.array(asks["high"].to_pylist())
                for at in range(0, len(q), TILE):
                    t = slice(at, at + TILE)
                    score = q[t] @ x.T
                    equal = qlab[t, None] == lab[None]
                    score[(qid[t, None] == ids[None]) | (~equal if same else equal)] = -np.inf
                    for w in range(low.shape[1]):
                        inside = np.where((score >= low[t, w, None]) & (score <= high[t, w, None]), score, -np.inf)
                        r, c = first_rows(inside, take)
                        for o, z in zip(out, (qid[t][r], np.full(len(r), w), ids[c], score[r, c])):
                            o.append(z)
            got = [np.concatenate(o) if o else np.zeros(0) for o in out]
            return pa.Table.from_arrays([pa.array(got[0].astype(np.int64)), pa.array(got[1].astype(np.int32)),
                                         pa.array(got[2].astype(np.int64)), pa.array(got[3].astype(np.int64))],
                                        names=["anchor", "w", "id", "score"])

        key = ["leaf", "blk", "pack"]
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
            lambda k, a, b: run(a, b), "anchor long, w int, id long, score long")
        nth = F.row_number().over(Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", nth).where(F.col("rank") <= take)

    def search(self, anchors: DataFrame, same: bool, take: int) -> DataFrame:
        """(anchor, w, id, score, rank): for each of ``anchors`` (id, label,
        v, low, high) and each window w, the first ``take`` rows of its label
        (``same``) or of other labels with ``low[w] <= score <= high[w]``."""
        tree, scale, dim = self.tree, self.scale, self.dim
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema.fields)

        def home(batches):
            for b in batches:
                leaf = tree.leaf_of(floors(b.column("v"), scale, dim))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32))], names=[*b.schema.names, "leaf"])

        def others(batches):
            for b in batches:
                low, high = (np.array(b.column(c).to_pylist()) for c in ("low", "high"))
                if not len(low):
                    continue
                who, leaf = tree.visit(floors(b.column("v"), scale, dim), low, high)
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(who)) for c in b.columns], pa.array(leaf.astype(np.int32))],
                                                 names=[*b.schema.names, "leaf"])

        first = self._compare(written(anchors.mapInArrow(home, schema + ", leaf int"), "home"), same, take)
        # a window whose first ``take`` rows at home are known need not go below their last
        known = (first.where(F.col("rank") == take).groupBy("anchor")
                 .agg(F.map_from_entries(F.collect_list(F.struct("w", F.col("score").cast("double").alias("s")))).alias("_m")))
        narrow = (anchors.join(known, anchors.id == known.anchor, "left").drop("anchor")
                  .withColumn("low", F.transform("low", lambda x, w: F.greatest(x, F.coalesce(F.get(F.array("_m"), F.lit(0))[w], x))))
                  .drop("_m"))
        return self._compare(written(narrow.mapInArrow(others, schema + ", leaf int"), "visits"), same, take)


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding",
                   label_col: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``: for each row whose id is divisible by ``every`` and
    each of its first ``positives`` rows of the same label, the first
    ``negatives`` rows of other labels with ``low * positive_score <= 100 *
    negative_score <= high * positive_score``.

    A score is the inner product of the vectors' floor(scale * x), exact
    while it is below 2^53; larger ones come first, ties by smaller id.  Rows
    with a null id, label or vector, or a null or non-finite component, take
    no part; missing components of shorter vectors count as 0.  Of rows that
    share an id the least (label, vector) takes part.  Anchors without a
    positive, and positives without such a negative, give no row; an empty
    table gives none.  Only the three named columns are read.
    """
    v = F.col("v")
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                           F.col(vec_col).alias("v"))
            .where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
            .where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("_r")).select("id", "_r.label", "_r.v")
    index = Index(rows, scale)
    ask = index.rows.where(F.col("id") % every == 0).select("id", "label", "v")
    inf = float("inf")
    pos = index.search(ask.withColumns({"low": F.array(F.lit(-inf)), "high": F.array(F.lit(inf))}), True, positives)
    pos = written(pos.select("anchor", "id", "score", "rank"), "positives")
    # windows of whole scores, by the positive's rank
    s = F.col("score")
    ends = (pos.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct(
        "rank", (-F.floor(-s * low / 100)).cast("double").alias("lo"), F.floor(s * high / 100).cast("double").alias("hi")))).alias("_e")))
    windows = [F.coalesce(F.get("_e", F.lit(i))[c], F.lit(none)).alias(c) for c, none in (("lo", inf), ("hi", -inf)) for i in range(positives)]
    ask = (ask.join(ends, ask.id == ends.anchor).select(
        "id", "label", "v", F.array(*windows[:positives]).alias("low"), F.array(*windows[positives:]).alias("high")))
    neg = index.search(ask, False, negatives)
    p = pos.select("anchor", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return neg.join(p, ["anchor", "w"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
