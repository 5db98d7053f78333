"""Conflict-constrained best-fit packing of documents into bins of tokens.

A document longer than a bin is cut into full bins and a rest.  Pieces are
dealt to shards at random (by a hash), so a source with a third of all rows
has a third of every shard and shards are even; a shard holds a bounded
number of pieces and is packed by one task.  In a shard, pieces come longest
first.  The open bins are kept in order of what is left in them, each with a
bitmap of the sources and one of the duplicate clusters in it.  A piece looks
up the first bin whose rest is at least its length and goes on to the next
larger rest until the bitmaps show no conflict: the tightest compatible bin.
If there is none it opens a bin.  No two documents of one source, or of one
duplicate cluster, share a bin.

A shard's own bins are all that its pieces see, so the bins that it leaves
loose (``LOOSE`` full at most) are dealt anew, those of many shards together,
and packed a second time in the same way, a loose bin now being an item with
all its sources and clusters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, written

CAPACITY = 2048
SHARD = 4096  # pieces in a shard, about
LOOSE = 0.75  # share of a bin up to which it is packed a second time


class Bits:
    """A bitmap per bin over the numbered values that occur more than once."""

    def __init__(self, values: list, bins: int):
        count: dict = {}
        for own in values:
            for v in own:
                count[v] = count.get(v, 0) + 1
        self.number = {v: i for i, v in enumerate(v for v, n in count.items() if n > 1)}
        self.map = np.zeros((len(self.number) // 64 + 1, bins), np.uint64)

    def masks(self, own) -> list:
        """(word, mask) of the values that can conflict, a word once."""
        words: dict = {}
        for v in own:
            if (i := self.number.get(v)) is not None:
                words[i >> 6] = words.get(i >> 6, 0) | 1 << (i & 63)
        return [(w, np.uint64(m)) for w, m in words.items()]


def _sets(values) -> list:
    return [v if isinstance(v, (set, frozenset)) else () if v is None else (v,) for v in values]


def best_fit(lengths, sources, clusters, capacity: int) -> list:
    """Bin number of each item, in the given order; an item's sources and
    clusters are a value, a set of values or None."""
    n = len(lengths)
    sources, clusters = _sets(sources), _sets(clusters)
    src, dup = Bits(sources, n), Bits(clusters, n)
    rest, order, used = np.empty(n, np.int64), np.empty(n, np.int64), 0  # open bins by rest
    out, bins = [], 0
    for size, s, c in zip(lengths, sources, clusters):
        masks = [(src.map, w, m) for w, m in src.masks(s)] + [(dup.map, w, m) for w, m in dup.masks(c)]
        found, at, block = -1, int(np.searchsorted(rest[:used], size)), 16
        while at < used:
            ids = order[at:min(used, at + block)]
            taken = np.zeros(len(ids), bool)
            for bitmap, w, m in masks:
                taken |= (bitmap[w, ids] & m) != 0
            free = np.flatnonzero(~taken)
            if len(free):
                found = at + int(free[0])
                break
            at, block = at + block, block * 4
        if found < 0:
            b, left = bins, capacity - size
            bins += 1
            hole = used
            used += 1
        else:
            b, left, hole = int(order[found]), int(rest[found]) - size, found
        for bitmap, w, m in masks:
            bitmap[w, b] |= m
        to = int(np.searchsorted(rest[:hole], left))  # the bin moves down to its new place
        rest[to + 1:hole + 1] = rest[to:hole].copy()
        order[to + 1:hole + 1] = order[to:hole].copy()
        rest[to], order[to] = left, b
        out.append(b)
    return out


_PACKED_ARROW = pa.schema([("bin", pa.string()), ("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("n", pa.int32()),
                           ("src", pa.string()), ("dup", pa.int64()), ("load", pa.int32())])


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != ""))


def text_cluster(text: Column) -> Column:
    """Duplicate cluster of a text: case and white space do not count."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(text, SPACE, " "))))


def pack(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, source: Column | None = None,
         cluster: Column | None = None, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """One row per piece: ``bin_id, slot`` (place in the bin), ``doc_id,
    piece, start`` (first token of the piece in its document), ``n_tokens``.

    Defaults: a token is a word of ``text`` (a run of anything but ASCII white
    space), ``source``, and the cluster of texts equal but for case and white
    space.  For a model's tokens or near copies pass columns: ``length`` a
    token count (``bpe.encode``), ``cluster`` a component id
    (``simhash_dedup``).  Documents without tokens (null, empty) take no place
    and give no row.  A null source or cluster conflicts with nothing; null
    ids are carried.  Repeated rows are documents of one cluster, each in a
    bin of its own: equal rows are counted on the map side and numbered from
    the count.  An empty table gives no rows.  Only id, length, source and
    cluster are shuffled.
    """
    length = word_count(F.col("text")) if length is None else length
    source = F.col("source") if source is None else source
    cluster = text_cluster(F.col("text")) if cluster is None else cluster
    d = docs.select(F.col(id_col).cast("long").alias("id"), length.cast("long").alias("len"),
                    source.cast("string").alias("src"), cluster.cast("long").alias("dup")).where("len > 0")
    d = written(d.groupBy("id", "len", "src", "dup").agg(F.count(F.lit(1)).alias("copies")), "lengths")
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    p = d.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("len") - 1) / capacity).cast("int"))))
    p = p.withColumn("start", F.col("piece").cast("long") * capacity)
    p = p.withColumn("n", F.least(F.col("len") - F.col("start"), F.lit(capacity)).cast("int"))
    # a full piece is a bin of its own: no search; its name tells equal ids and equal rows apart
    row = F.concat_ws(".", F.coalesce(F.col("id").cast("string"), F.lit("null")), "piece", "copy",
                      F.lower(F.hex(F.xxhash64("len", "src", "dup"))))
    full = p.where(F.col("n") == capacity).select(
        F.concat(F.lit("f"), row).alias("bin_id"), F.lit(0).alias("slot"), F.col("id").alias("doc_id"), "piece", "start",
        F.col("n").alias("n_tokens"))
    short = p.where(F.col("n") < capacity)
    shards = max(1, -(-(d.agg(F.sum("copies")).first()[0] or 0) // shard))  # one short piece per document at most
    short = short.select("id", "src", "dup", "piece", "start", "n", "copy",
                         F.pmod(F.xxhash64("id", "piece", "dup", "len", "copy"), F.lit(shards)).alias("shard"))

    def first(key, t):
        t = t.sort_by([("n", "descending"), ("id", "ascending"), ("piece", "ascending"), ("copy", "ascending"),
                       ("src", "ascending"), ("dup", "ascending")])
        n = t.column("n").to_pylist()
        bins = best_fit(n, t.column("src").to_pylist(), t.column("dup").to_pylist(), capacity)
        load = np.bincount(bins, weights=n, minlength=1)
        return pa.table([pa.array([f"{key[0].as_py()}.{b}" for b in bins]), *[t.column(c) for c in ("id", "piece", "start", "n", "src", "dup")],
                         pa.array(load[bins].astype(np.int32))], schema=_PACKED_ARROW)

    def second(key, t):
        """Loose bins as items: rows of one bin stay together."""
        t = t.sort_by([("load", "descending"), ("bin", "ascending"), ("n", "descending"), ("id", "ascending"), ("piece", "ascending")])
        names, src, dup, load = t.column("bin").to_pylist(), t.column("src").to_pylist(), t.column("dup").to_pylist(), t.column("load").to_pylist()
        items: dict = {}
        for b, s, c, x in zip(names, src, dup, load):
            item = items.setdefault(b, (x, set(), set()))
            item[1].update(() if s is None else (s,))
            item[2].update(() if c is None else (c,))
        found = best_fit([i[0] for i in items.values()], [i[1] for i in items.values()], [i[2] for i in items.values()], capacity)
        head: dict = {}
        into = {name: head.setdefault(b, name) for name, b in zip(items, found)}
        return t.set_column(0, "bin", pa.array([into[b] for b in names], pa.string()))

    columns = "bin string, id long, piece int, start long, n int, src string, dup long, load int"
    packed = written(short.groupBy("shard").applyInArrow(first, columns), "packed")
    loose = F.col("load") <= F.lit(int(LOOSE * capacity))
    bins = packed.where(loose).select(F.count_distinct("bin")).first()[0]
    again = (packed.where(loose).withColumn("_shard", F.pmod(F.xxhash64("bin"), F.lit(max(1, -(-bins // shard)))))
             .groupBy("_shard").applyInArrow(lambda k, t: second(k, t.drop_columns(["_shard"])), columns))
    rows = packed.where(~loose).unionByName(again)
    slot = F.row_number().over(Window.partitionBy("bin").orderBy(F.desc("n"), "id", "piece", "start", "src", "dup")) - 1
    return rows.select(F.col("bin").alias("bin_id"), slot.alias("slot"), F.col("id").alias("doc_id"), "piece", "start",
                       F.col("n").alias("n_tokens")).union(full)
