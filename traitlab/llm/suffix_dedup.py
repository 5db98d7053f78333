"""Repeated byte strings by prefix-free parsing.

Goal: every byte covered by a ``length``-byte string that also starts
somewhere else in the corpus (matches never cross documents).

*Parsing.*  A rolling hash of 8 bytes is taken at every position.  A string
of ``length`` bytes (a window) has one trigger, the leftmost smallest hash in
it, so equal windows have equal triggers wherever they stand; the text
between triggers falls into phrases with the windows that own them.  All
windows of one trigger whose distance to it lies in one step of ``COARSE``
are a phrase occurrence: a run of consecutive window starts, with the bytes
they cover as its text.

*Dictionary and parse.*  An occurrence has a core, the bytes that all windows
of its step share.  A window that repeats has a core that repeats, so an
occurrence whose core is unique in the corpus is dropped unseen; that is
almost all text but repeated passages.  Occurrences with equal texts are one
dictionary phrase: copies of each other, all their windows repeat.

*Order.*  What is left are phrases that occur once but share a core with
other phrases.  Their suffixes are brought into order against the suffixes of
one copy of every phrase with that core: the same step again on runs of
``FINE`` windows, then on single windows, where strings of ``length`` bytes
with a common prefix that long are neighbours and are counted.  Only equality
over ``length`` bytes matters here, so hash order (128 bits) stands for byte
order.

Every stage is a count per key (with map-side combine) and a join on the key,
in which the rows of a frequent key are dealt to several tasks
(``common.join_hot``), so no group is ever gathered, however many copies a
passage has.  Texts move compressed, twice: to the phrases left over, and to
the removed spans.

A row is named by its id and a hash of its text, so rows that share an id, or
have none, are texts of their own; equal rows are copies of each other.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_hot, small_batches, written

GRAM = 8
COARSE, FINE = 100, 10
CHUNK = 1 << 17  # bytes of text hashed at once: bounds what a Python worker holds
POSITION_BITS = 21  # a buffer holds fewer than 2 * CHUNK + length bytes
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray, by=_M1) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * by
    return (x ^ (x >> np.uint64(32))) * _M2


class Hasher:
    """Hashes of any substring of ``data`` in constant time, by prefix sums."""

    def __init__(self, data: np.ndarray, powers: tuple):
        raw = np.ndarray((len(data) - GRAM + 1,), "<u8", buffer=data, strides=(1,))
        self.gram = _mix(raw.astype(np.uint64))
        self.powers = powers

    def prefix(self, second: bool = False):
        g = _mix(self.gram) if second else self.gram
        out = np.zeros(len(g) + 1, np.uint64)
        np.cumsum(g * self.powers[0][:len(g)], out=out[1:])
        return out

    def of(self, prefix, start, end):
        """Hashes of data[start:end] (at least 8 bytes each)."""
        return _mix((prefix[end - GRAM + 1] - prefix[start]) * self.powers[1][start])


def powers(n: int) -> tuple:
    def run(base):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        return np.multiply.accumulate(x)
    return run(_BASE), run(_INVERSE)


def triggers(gram: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` bytes its trigger: the leftmost smallest
    hash in it (hash in the high bits, position in the low ones)."""
    bits = np.uint64(POSITION_BITS)
    low = ((gram >> bits) << bits) | np.arange(len(gram), dtype=np.uint64)
    span, size = length - GRAM + 1, 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[:len(low) - (span - size)], low[span - size:])
    return (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def runs(trigger: np.ndarray, starts: np.ndarray, step: int):
    """Runs of consecutive window starts with one trigger and one step of the
    distance to it: (first start, last start, trigger, step number)."""
    at = (trigger - starts) // step
    new = np.flatnonzero((np.diff(trigger) != 0) | (np.diff(at) != 0) | (np.diff(starts) != 1)) + 1
    first = np.concatenate(([0], new))
    last = np.concatenate((new, [len(starts)])) - 1
    return starts[first], starts[last], trigger[first], at[first]


def keys(h: Hasher, first, last, trigger, at, step: int, length: int):
    """Hash of the core and of the whole text of each run."""
    p = h.prefix()
    near, far = at * step, np.minimum(at * step + step - 1, length - GRAM)
    core = h.of(p, trigger - near, trigger - far + length)
    core = _mix(core + at.astype(np.uint64))
    if step == 1:  # core and text are the window: a second, independent hash
        return core, h.of(h.prefix(second=True), first, last + length)
    text = h.of(p, first, last + length)
    return core, _mix(text + ((trigger - first) * 1000 + last - first).astype(np.uint64))


def pieces(texts: list, length: int):
    """Texts laid end to end in buffers of about ``CHUNK`` bytes, as lists of
    (row, offset of the piece in its text, bytes); a long text is cut into
    pieces that overlap by ``length - 1`` bytes, so each window is in one."""
    out, size = [], 0
    for row, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), CHUNK):
            part = t[at:at + CHUNK + length - 1]
            if len(part) < length:
                continue
            out.append((row, at, part))
            size += len(part)
            if size >= CHUNK:
                yield out
                out, size = [], 0
    if out:
        yield out


_DOC = T.StructType([T.StructField("id", T.LongType()), T.StructField("h", T.LongType())])
_DOC_ARROW = pa.struct([("id", pa.int64()), ("h", pa.int64())])
_ROW = T.StructType([T.StructField("core", T.LongType()), T.StructField("body", T.LongType()),
                     T.StructField("doc", _DOC), T.StructField("at", T.LongType()),
                     T.StructField("far", T.IntegerType()), T.StructField("near", T.IntegerType()),
                     T.StructField("wanted", T.BooleanType())])


def _occurrences(length: int):
    """docs (doc, text) -> phrase occurrences: trigger position ``at``, the
    distances ``far`` .. ``near`` of its window starts before it."""
    def run(batches):
        pow_ = powers(2 * CHUNK + 2 * length)
        for b in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            for part in pieces(texts, length):
                data = np.frombuffer(b"".join(x[2] for x in part), np.uint8)
                ends = np.cumsum([len(x[2]) for x in part])
                begins = ends - [len(x[2]) for x in part]
                h = Hasher(data, pow_)
                trig = triggers(h.gram, length)
                ok = np.ones(len(trig), bool)
                for e in ends[:-1].tolist():
                    ok[e - length + 1:e] = False
                starts = np.flatnonzero(ok)
                first, last, trig, at = runs(trig[starts], starts, COARSE)
                core, body = keys(h, first, last, trig, at, COARSE, length)
                k = np.searchsorted(ends, first, side="right")
                shift = np.array([x[1] for x in part]) - begins
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core.view(np.int64)), pa.array(body.view(np.int64)),
                     b.column(0).take(pa.array(np.array([x[0] for x in part])[k])),
                     pa.array((trig + shift[k]).astype(np.int64)), pa.array((trig - first).astype(np.int32)),
                     pa.array((trig - last).astype(np.int32)), pa.array(np.ones(len(k), bool))],
                    names=_ROW.names)
    return run


def _again(step: int, length: int):
    """Phrases (doc, at, far, near, wanted, text of the run) -> their windows
    in runs of ``step``."""
    def run(batches):
        pow_ = powers(1 << 17)
        for b in batches:
            texts = b.column("text").to_pylist()
            far = b.column("far").to_numpy().astype(np.int64)
            begins, size, group = [], 0, 0
            lens = np.array([len(t) for t in texts], np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(lens) // (1 << 16))) + 1
            for lo, hi in zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [len(texts)])).tolist()):
                if lo == hi:
                    continue
                n = lens[lo:hi]
                begins = np.cumsum(n) - n
                h = Hasher(np.frombuffer(b"".join(texts[lo:hi]), np.uint8), pow_)
                count = n - length + 1
                row = np.repeat(np.arange(hi - lo), count)
                starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begins[row]
                trig = (begins + far[lo:hi])[row]
                # one run never spans two phrases: their triggers differ
                first, last, t, at = runs(trig, starts, step)
                core, body = keys(h, first, last, t, at, step, length)
                k = np.searchsorted(begins, first, side="right") - 1 + lo
                take = pa.array(k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core.view(np.int64)), pa.array(body.view(np.int64)), b.column("doc").take(take),
                     b.column("at").take(take), pa.array((t - first).astype(np.int32)),
                     pa.array((t - last).astype(np.int32)), b.column("wanted").take(take)], names=_ROW.names)
    return run


def _settle(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``(repeated, open)`` of occurrences: those whose whole text occurs
    again, and - for the cores that some wanted single phrase shares with
    another phrase - one occurrence of every phrase."""
    shared = written(rows.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), name + "-cores")
    live = written(join_hot(rows, shared, ["core"], "n").drop("n"), name)
    phrase = live.groupBy("core", "body").agg(F.count(F.lit(1)).alias("n"),
                                              F.min(F.struct("doc", "at", "far", "near", "wanted")).alias("one"))
    copied = written(phrase.where("n > 1").select("core", "body", "n"), name + "-copied")
    repeated = join_hot(live.where("wanted"), copied, ["core", "body"], "n").select("doc", "at", "far", "near")
    single = F.sum((F.col("n") == 1).cast("int") * F.col("one.wanted").cast("int"))
    mixed = (phrase.groupBy("core").agg(F.count(F.lit(1)).alias("d"), single.alias("s"))
             .where("d > 1 AND s > 0").select("core"))
    open_ = (phrase.join(mixed.hint("shuffle_hash"), "core")
             .select("one.doc", "one.at", "one.far", "one.near",
                     ((F.col("n") == 1) & F.col("one.wanted")).alias("wanted")))
    return repeated, open_


def _packed(docs: DataFrame, text_col: str) -> DataFrame:
    """The text as compressed UTF-8 bytes, for the way through a shuffle."""
    @F.pandas_udf(T.BinaryType())
    def pack(s: pd.Series) -> pd.Series:
        z = zstandard.ZstdCompressor(level=1)
        return s.map(lambda t: None if t is None else z.compress(t.encode("utf-8", "surrogatepass")))
    return docs.withColumn("__z", pack(F.col(text_col))).drop(text_col)


def _open_texts(docs: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """The bytes of each open phrase, read from its document."""
    per = (open_.groupBy("doc").agg(F.collect_list(F.struct("at", "far", "near", "wanted")).alias("asked")))
    both = per.join(_packed(docs, "text"), "doc").select("doc", "__z", "asked")
    out = T.StructType(_ROW.fields[2:] + [T.StructField("text", T.BinaryType())])

    def cut(batches):
        unz = zstandard.ZstdDecompressor()
        for b in batches:
            for doc, z, asked in zip(*(b.column(i).to_pylist() for i in range(3))):
                t = unz.decompress(z)
                yield pa.RecordBatch.from_pylist(
                    [{"doc": doc, "at": a["at"], "far": a["far"], "near": a["near"], "wanted": a["wanted"],
                      "text": t[a["at"] - a["far"]:a["at"] - a["near"] + length]}
                     for a in asked if a["at"] >= a["far"] and a["at"] - a["near"] + length <= len(t)],
                    schema=pa.schema([("doc", _DOC_ARROW), ("at", pa.int64()), ("far", pa.int32()),
                                      ("near", pa.int32()), ("wanted", pa.bool_()), ("text", pa.binary())]))

    return both.mapInArrow(cut, out)


def _named(id_col: str, text_col: str):
    """A row's name; NULL ids are equal to each other."""
    return F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("h"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """``(doc, s, e)``: byte spans [s, e) that together cover exactly the
    bytes in repeated ``length``-byte strings; spans may overlap."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    small_batches(docs.sparkSession)
    d = docs.select(_named(id_col, text_col).alias("doc"), F.col(text_col).alias("text")).where(f"octet_length(text) >= {length}")
    spans = lambda x: x.select("doc", (F.col("at") - F.col("far")).alias("s"),
                               (F.col("at") - F.col("near") + length).alias("e"))
    whole, open_ = _settle(d.mapInArrow(_occurrences(length), _ROW), "occurrences")
    texts = written(_open_texts(d, open_, length), "open")
    part, open_ = _settle(texts.mapInArrow(_again(FINE, length), _ROW), "parts")
    # the text of an open part, from the phrase that holds it
    held = texts.select("doc", "at", F.col("far").alias("f"), F.col("near").alias("e"), "text")
    inner = (open_.join(held, ["doc", "at"]).where("far <= f AND near >= e")
             .select("doc", "at", "far", "near", "wanted",
                     F.expr(f"substring(text, f - far + 1, far - near + {length})").alias("text")))
    single = inner.mapInArrow(_again(1, length), _ROW)
    counts = single.groupBy("core", "body").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core", "body")
    last = (single.where("wanted").join(counts.hint("shuffle_hash"), ["core", "body"]).select("doc", "at", "far", "near"))
    return spans(whole).union(spans(part)).union(spans(last))


def _with_spans(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """``docs`` with ``__z``, the packed text, in place of the text, and the
    starts ``__s`` and ends ``__e`` of its repeated spans (null: none)."""
    found = repeated_spans(docs, id_col, text_col, length)
    # a set: equal rows have equal spans, which go together before the shuffle
    per = (found.groupBy("doc").agg(F.collect_set(F.struct("s", "e")).alias("__spans"))
           .select(F.col("doc").alias("__doc"), F.col("__spans.s").alias("__s"), F.col("__spans.e").alias("__e")))
    return _packed(docs.withColumn("__doc", _named(id_col, text_col)), text_col).join(per, "__doc", "left").drop("__doc")


def _kept(packed, starts, ends):
    """Per packed text: its bytes outside the spans, and how many bytes it
    has, bytes and maximal spans are gone."""
    unz = zstandard.ZstdDecompressor()
    for blob, s, e in zip(packed, starts, ends):
        t = b"" if blob is None else unz.decompress(blob)
        kept, at, gone, n = [], 0, 0, 0
        for lo, hi in merged(s, e):
            kept.append(t[at:lo])
            gone += min(hi, len(t)) - lo
            n, at = n + 1, hi
        kept.append(t[at:])
        yield b"".join(kept), len(t), gone, n


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """``docs`` with the column ``text_col`` replaced by ``kept_bytes`` (its
    UTF-8 bytes without the repeated ones) and ``n_bytes``, ``n_removed``,
    ``n_spans`` (long) added.

    A null text counts as empty: nothing is removed and its kept bytes are
    empty.  Equal rows are copies of each other; rows that share an id, or
    whose id is null, are compared like any others.  Every other column,
    whatever its name, is carried; an empty table gives none.
    """
    result = T.StructType([T.StructField("kept_bytes", T.BinaryType()), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())])

    @F.pandas_udf(result)
    def remove(z: pd.Series, s: pd.Series, e: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(_kept(z, s, e)), columns=result.names)

    both = _with_spans(docs, id_col, text_col, length)
    return both.withColumn("__r", remove("__z", "__s", "__e")).drop("__z", "__s", "__e").select(
        *[c for c in docs.columns if c != text_col], "__r.*")


def merged(starts, ends) -> list:
    """Sorted maximal runs of overlapping or touching spans (null: none)."""
    if starts is None or not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    first, top = np.asarray(starts)[order], np.maximum.accumulate(np.asarray(ends)[order])
    new = np.concatenate(([True], first[1:] > top[:-1]))
    last = np.concatenate((new[1:], [True]))
    return list(zip(first[new].tolist(), top[last].tolist()))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """``docs``, columns as they are, with the repeated bytes cut out of the
    text; what a cut leaves of a split character goes too.  Cutting and
    decoding are one function, so a task needs one Python worker."""
    @F.pandas_udf(T.StringType())
    def text(z: pd.Series, s: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([kept.decode("utf-8", "ignore") for kept, *_ in _kept(z, s, e)], dtype=object)

    both = _with_spans(docs, id_col, text_col, length)
    return both.withColumn(text_col, text("__z", "__s", "__e")).select(*docs.columns)
