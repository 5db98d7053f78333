"""Byte-level BPE encoding and decoding with a given rank file.

A text is cut into chunks that overlap.  Each chunk is pre-tokenised on its
own; where two neighbours both have a piece boundary at the same place in
their overlap they agree from there on (the pattern never looks behind a
boundary), so the first chunk's pieces are kept up to that place and the
second's from it.  If no boundary coincides - one piece spans the overlap -
the second chunk starts over at the first one's last sure boundary.  The
pieces are then encoded by merging the pair of lowest rank, leftmost first;
pieces repeat, so a worker remembers them up to a bound.  Decoding
concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

CHUNK, OVERLAP = 1 << 15, 1 << 8
REMEMBERED = 300_000
#: Unicode White_Space, which the pattern's \s stands for (fixed values).
WHITE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=8)
def splitter(pattern: str):
    """The pattern with White_Space spelled out."""
    inside = regex.sub(r"\[\^\\s", lambda m: "[^" + WHITE, pattern)
    return regex.compile(inside.replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))


def _ends(split, text: str, start: int, end: int) -> list:
    """Piece boundaries of text[start:end] taken alone, as positions."""
    return [start + m.end() for m in split.finditer(text[start:end])]


def boundaries(text: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list:
    """End positions of the pieces of ``text``."""
    split, n = splitter(pattern), len(text)
    out, sure, start = [], 0, 0  # out: boundaries that no later chunk changes, the last is ``sure``
    while sure < n:
        end = min(n, start + chunk)
        ends = _ends(split, text, start, end)
        if end < n and ends[-1] == end:
            ends.pop()  # this piece may go on beyond the chunk
        if start < sure:  # overlapping: go on from the first boundary both have
            mine = set(ends)
            i = len(out)
            meet = None
            while i and out[i - 1] > start:
                i -= 1
                meet = i if out[i] in mine else meet
            if meet is not None:
                ends = ends[ends.index(out[meet]) + 1:]
                del out[meet + 1:]
            if meet is None or not ends or ends[-1] <= sure:
                start = sure  # one piece spans the overlap: start over where it begins
                out += [e for e in ends if e <= sure] if meet is not None else []
                continue
        elif not ends:
            chunk *= 2  # one piece fills the chunk
            continue
        out += ends
        sure = out[-1]
        start = max(sure - overlap, 0)
    return out


class Ranks:
    """A rank file: mergeable byte strings and their ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(self.ids.values()) + 1)
        for k, v in self.ids.items():
            self.bytes[v] = k
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list:
        """Ids of one piece."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) <= 64:
            return self._merge_short(piece)
        n, ids = len(piece), self.ids
        after = list(range(1, n + 1))  # end of the part that starts here
        before = list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ids.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        pair = {i: r for r, i in heap}
        while heap:
            r, i = heapq.heappop(heap)
            if pair.get(i) != r:
                continue
            j = after[i]
            pair.pop(j, None)
            k = after[i] = after[j]
            after[j] = 0
            if k < n:
                before[k] = i
            for a in (before[i], i):  # the pairs that this merge changed
                if a >= 0:
                    b = after[a]
                    r = ids.get(piece[a:after[b]]) if b < n else None
                    if r is None:
                        pair.pop(a, None)
                    else:
                        pair[a] = r
                        heapq.heappush(heap, (r, a))
        out, i = [], 0
        while i < n:
            out.append(ids[piece[i:after[i]]])
            i = after[i]
        return out

    def _merge_short(self, piece: bytes) -> list:
        ids, none = self.ids, 1 << 32
        parts = [piece[i:i + 1] for i in range(len(piece))]
        pair = [ids.get(x + y, none) for x, y in zip(parts, parts[1:])]
        while pair and (low := min(pair)) < none:
            i = pair.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i:
                pair[i - 1] = ids.get(parts[i - 1] + parts[i], none)
            if i < len(pair):
                pair[i] = ids.get(parts[i] + parts[i + 1], none)
        return [ids[x] for x in parts]

    def encode(self, text: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if len(text) <= chunk:
            pieces = splitter(pattern).findall(text)
        else:
            ends = boundaries(text, pattern, chunk, overlap)
            pieces = [text[i:j] for i, j in zip([0, *ends], ends)]
        known = self.known
        if len(known) >= REMEMBERED:
            known.clear()
        new = set(pieces).difference(known)
        for piece in new:
            known[piece] = np.array(self.merge(piece.encode("utf-8")), "<u4").tobytes()
        ids = b"".join(map(known.__getitem__, pieces))
        for piece in new:
            if len(piece) > 64:
                del known[piece]
        return ids

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids``: one row per row; ``ids`` is binary,
    little-endian unsigned 32-bit.  A null text counts as empty (no ids);
    null ids and repeated rows are carried.  ``path`` is the rank file's
    place on every node."""
    small_batches(docs.sparkSession)

    def run(batches):
        r = ranks(path)
        for b in batches:
            ids = [r.encode(t or "", pattern) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the bytes of the ids."""
    @F.pandas_udf(T.BinaryType())
    def run(s):
        r = ranks(path)
        return s.map(lambda x: None if x is None else r.decode(x))
    return encoded.withColumn("decoded", run(F.col(ids_col)))
