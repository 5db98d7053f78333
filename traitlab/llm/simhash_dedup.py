"""SimHash near-dedup: fingerprints, and a binary trie joined with itself.

A fingerprint bit is set if it is set in more than half of the hashes of the
text's word shingles.  The distinct fingerprints form a binary trie (bits
from the highest down, a node is a range of the sorted fingerprints).  The
self-join starts at the pair (root, root) and goes down pairs of nodes
together: a pair's children differ by the bits seen so far plus one where
their branches differ, and a pair whose difference exceeds the budget is
pruned with everything below it.

The trie is split at ``top`` bits, chosen from the number of distinct
fingerprints, and a node that holds more than ``SUBTREE`` of them (near copies
share their first bits) is split again, four bits at a time, by counts per
prefix, until each leaf fits.  A fingerprint travels to its own leaf and to
each pair of its leaf with another whose prefix differs from it by at most
the budget (the pruning rule applied to the first levels), so each pair of
leaves is joined in exactly one task, of at most twice ``SUBTREE``
fingerprints below ``top``.  A task returns a spanning forest
of the links it finds, at most one link per fingerprint and task, never all
pairs; node pairs whose fingerprints are already one tree are not followed,
which keeps dense groups of near copies cheap.  Copies share a fingerprint
and are one leaf.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, forest, small_batches, written

BITS = 64
SEED = 42
SUBTREE = 1 << 18      # most fingerprints in a leaf of the split trie
PAIRS_AT_ONCE = 1 << 16
MIN_TOP = 4
DEEPER = 4             # bits by which a node that is too large is split


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a text (0 if it has no words)."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII rules on bytes
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[:len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    n, ones = len(starts), np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[at:at + (1 << 16)].tolist(),
                                                               ends[at:at + (1 << 16)].tolist())], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


_FP = T.StructType([T.StructField("id", T.LongType()), T.StructField("fp", T.LongType())])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """``(id, fp)``: the fingerprint as a signed 64-bit number."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _FP)


def near_prefixes(top: int, budget: int) -> list[int]:
    """Bit patterns over ``top`` bits with at most ``budget`` set."""
    return [sum(1 << i for i in c) for k in range(min(budget, top) + 1) for c in combinations(range(top), k)]


def trie_links(fp: np.ndarray, left: np.ndarray, right: np.ndarray | None, depth: int, budget: int):
    """Spanning links (i, j) of all pairs within ``budget`` bits, one index
    from ``left`` and one from ``right`` (both sorted ranges of ``fp``; None:
    within ``left``), which agree on the node pair reached at ``depth``.

    ``tree`` labels what is linked already; a node pair all of whose leaves
    carry one label is not followed.
    """
    n = len(fp)
    tree = np.arange(n)
    ends = (*left, *(left if right is None else right))
    seen = 0 if right is None else int(fp[left[0]] ^ fp[right[0]]) >> (BITS - depth)
    stack = [(depth, *(np.array([x], np.int32) for x in ends), np.array([seen.bit_count()], np.int32))]
    out_i, out_j = [], []
    changes = None
    while stack:
        depth, a0, a1, b0, b1, diff = stack.pop()
        if len(a0) > PAIRS_AT_ONCE:  # bounded memory: halves, one after the other
            h = len(a0) // 2
            stack += [(depth, a0[h:], a1[h:], b0[h:], b1[h:], diff[h:]), (depth, a0[:h], a1[:h], b0[:h], b1[:h], diff[:h])]
            continue
        if changes is not None:  # one label over both ranges: nothing new below
            one = ((changes[a1 - 1] == changes[a0]) & (changes[b1 - 1] == changes[b0]) & (tree[a0] == tree[b0]))
            a0, a1, b0, b1, diff = (x[~one] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            near = np.bitwise_count(fp[i] ^ fp[j]) <= budget
            near &= i != j
            i, j = i[near], j[near]
            new = tree[i] != tree[j]
            i, j = i[new], j[new]
            if len(i):
                out_i.append(i)
                out_j.append(j)
                tree, kept = _merge(tree, i, j)
                out_i[-1], out_j[-1] = i[kept], j[kept]
                changes = np.concatenate(([0], np.cumsum(tree[1:] != tree[:-1])))
            a0, a1, b0, b1, diff = (x[~single] for x in (a0, a1, b0, b1, diff))
        if not len(a0) or depth == BITS:
            continue
        bit = np.uint64(BITS - 1 - depth)
        am, bm = _split(fp, a0, a1, bit), _split(fp, b0, b1, bit)
        same = a0 == b0  # a node with itself: its mixed children once
        parts = []
        for x0, x1, y0, y1, more, use in ((a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None),
                                          (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~same)):
            ok = (x1 > x0) & (y1 > y0) & (diff + more <= budget)
            if use is not None:
                ok &= use
            ok &= ~((x1 - x0 == 1) & (y1 - y0 == 1) & (x0 == y0))
            parts.append((x0[ok], x1[ok], y0[ok], y1[ok], diff[ok] + more))
        stack.append((depth + 1, *(np.concatenate(c) for c in zip(*parts))))
    if not out_i:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(out_i), np.concatenate(out_j)


def _merge(tree: np.ndarray, i: np.ndarray, j: np.ndarray):
    """Labels after linking i[k] - j[k], and which links were needed."""
    names, at = np.unique(np.concatenate((tree[i], tree[j])), return_inverse=True)
    x, y = at[:len(i)], at[len(i):]
    kept = forest(len(names), x.tolist(), y.tolist())
    root = np.arange(len(names))
    while True:  # smallest label reachable through the kept links
        low = np.minimum(root[x[kept]], root[y[kept]])
        new = root.copy()
        np.minimum.at(new, x[kept], low)
        np.minimum.at(new, y[kept], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    to = np.arange(len(tree))
    to[names] = names[root]
    return to[tree], kept


def _split(fp, lo, hi, bit):
    """First position in each sorted range whose ``bit`` is set: by bisection
    on all ranges at once (within a node, higher bits are equal)."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        one = (fp[np.minimum(mid, len(fp) - 1)] >> bit) & np.uint64(1) == 1
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


_LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _prefix(fp, depth: int):
    return F.shiftrightunsigned(fp, BITS - depth)


def large_nodes(distinct: DataFrame, top: int, subtree: int):
    """Base nodes (prefixes of ``top`` bits) with more than ``subtree``
    fingerprints, and the leaves they are split into: ``(start, depth)``, the
    smallest fingerprint a leaf may hold and the bits that it shares.

    Only counts per prefix reach the driver: of each level at most
    ``2 ** DEEPER`` children per large node, of which there are at most one
    per ``subtree`` fingerprints.
    """
    spark, fp = distinct.sparkSession, F.col("fp")
    base = sorted(r.p for r in distinct.groupBy(_prefix(fp, top).alias("p")).count().where(F.col("count") > subtree).collect())
    leaves, large, depth = [], base, top
    while large:
        under, deeper = spark.createDataFrame([(x,) for x in large], "node long"), min(BITS, depth + DEEPER)
        rows = distinct.withColumn("node", _prefix(fp, depth)).join(F.broadcast(under), "node", "left_semi")
        child = rows.groupBy(_prefix(fp, deeper).alias("p")).count().collect()
        # at 64 bits a prefix is one fingerprint, its long is signed
        leaves += [((r.p % (1 << BITS)) << (BITS - deeper), deeper) for r in child if r["count"] <= subtree or deeper == BITS]
        large, depth = sorted(r.p for r in child if r["count"] > subtree and deeper < BITS), deeper
    return base, sorted(leaves)


def hamming_links(distinct: DataFrame, budget: int, subtree: int | None = None) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints (column ``fp``) within
    ``budget`` bits that connect everything such links connect."""
    subtree = subtree or SUBTREE
    n = distinct.count()
    top = max(MIN_TOP, (max(1, n) // subtree).bit_length())
    near = near_prefixes(top, budget)
    base, deep = large_nodes(distinct, top, subtree)
    base = np.array(base, np.uint64)
    starts, depths = np.array([x for x, _ in deep], np.uint64), np.array([d for _, d in deep], np.int64)
    shift, starts_depths = np.uint64(BITS - top), list(zip(starts, depths.tolist()))

    def pair(fp, own, own_depth, other, other_depth):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(own, other).view(np.int64)), pa.array(np.maximum(own, other).view(np.int64)),
             pa.array(np.minimum(own_depth, other_depth).astype(np.int32)), pa.array(fp.view(np.int64))], names=["p", "q", "depth", "fp"])

    def deal(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            own, depth = (fp >> shift) << shift, np.full(len(fp), top)
            split = np.isin(fp >> shift, base)
            if split.any():  # the leaf below the base node: the last that starts at or before the fingerprint
                at = np.searchsorted(starts, fp[split], "right") - 1
                own[split], depth[split] = starts[at], depths[at]
            for mask in near:  # the pair with a base node that is a leaf, itself included
                other = (fp >> shift) ^ np.uint64(mask)
                whole = ~np.isin(other, base)
                if whole.any():
                    yield pair(fp[whole], own[whole], depth[whole], other[whole] << shift, top)
            for start, d in starts_depths:  # the pair with a leaf below a base node
                close = np.bitwise_count((fp ^ start) >> np.uint64(BITS - d)) <= budget
                if close.any():
                    yield pair(fp[close], own[close], depth[close], start, d)

    def join(key, frame):
        p, q = (np.array([k.as_py()], np.int64).view(np.uint64)[0] for k in key[:2])
        depth = key[2].as_py()
        fp = np.sort(frame.column("fp").to_numpy().view(np.uint64))
        cut = int(np.searchsorted(fp, q))
        if p == q:
            i, j = trie_links(fp, (0, len(fp)), None, depth, budget)
        elif 0 < cut < len(fp):
            i, j = trie_links(fp, (0, cut), (cut, len(fp)), depth, budget)
        else:
            i = j = np.zeros(0, int)
        return pa.table({"a": fp[i].view(np.int64), "b": fp[j].view(np.int64)}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    dealt = distinct.select("fp").mapInArrow(deal, "p long, q long, depth int, fp long")
    pairs = (len(near) + 1) * ((1 << top) + len(deep)) // 2
    return dealt.repartition(min(pairs, 2048), "p", "q").groupBy("p", "q", "depth").applyInArrow(join, _LINK)


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                  budget: int = 3) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (16 hex digits),
    ``component_id`` (smallest doc_id reachable over links of at most
    ``budget`` bits, itself included).

    Null, empty and blank texts have fingerprint zero and are linked like any
    other.  A null id takes part with its fingerprint; its component is the
    smallest non-null id of it, or null.  Repeated rows give repeated
    results, an empty table an empty one.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    leaf = written(fps.groupBy("fp").agg(F.min("id").alias("low")), "leaves")
    links = written(hamming_links(leaf, budget), "links")
    comp = components(links, "a", "b").withColumnsRenamed({"id": "fp"})
    tree = leaf.join(comp, "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("tree"))
    tree = written(tree, "trees")
    low = tree.groupBy("tree").agg(F.min("low").alias("component_id"))
    per = tree.select("fp", "tree").join(low, "tree").select("fp", "component_id")
    return (fps.join(per, "fp", "left")
            .select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
               budget: int = 3) -> DataFrame:
    """``docs`` without the documents that are not their group's smallest id."""
    groups = simhash_dedup(docs, id_col, text_col, shingle, budget)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == F.col("__gone"), "left_anti")
