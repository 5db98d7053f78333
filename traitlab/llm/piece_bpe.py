"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A normalised text starts as its characters.  An agenda holds the adjacent
pairs of symbols whose joined text is a piece, best score first, of equal
scores the leftmost; the front pair is joined, and the pairs that the new
symbol makes with its neighbours enter the agenda; pairs whose symbols have
changed since are passed over.  What is left are pieces, or characters that
no piece spells, which become the byte pieces of their UTF-8.

No merge crosses a place whose two characters stand side by side in no piece.
So a text is cut before a space mark that follows another character (checked
on the vocabulary: no piece has a mark after another character), and around
characters that occur in no piece of several characters, and each fragment
has an agenda of its own.  Fragments repeat: a worker remembers them up to a
bound.  The new ones of a batch go together: a row of a matrix is a
fragment's agenda, the costs of its adjacent pairs by place, and each step
joins every row's front pair; long fragments have a heap each.  Every new
fragment is also encoded by the sentencepiece library, all in one call, and
the job ends with an error if a single one differs.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"  # stands for a space
NONE = 1 << 40   # cost of a pair that is no piece
REMEMBERED = 500_000
SHORT = 32       # characters of a fragment whose agenda is a matrix row
STEP = 1 << 14   # rows of that matrix
LONG = 64        # characters of a fragment that is not remembered
BATCH = 1 << 22  # characters of texts that are encoded together


class Pieces:
    """A model file: its pieces with ids and scores."""

    def __init__(self, path: str):
        import sentencepiece
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.ids, self.costs, self.bytes = {}, {}, {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = np.array([i], "<u4").tobytes()
            elif sp.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            elif not sp.is_control(i) and not sp.is_unknown(i):
                self.ids[piece] = np.array([i], "<u4").tobytes()
                self.costs[piece] = -sp.get_score(i)
        if len(self.bytes) < 256:
            raise ValueError("only models with byte fallback are supported")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("only models that mark spaces in front of words are supported")
        joins = {c for p in self.ids if len(p) > 1 for c in p} - {MARK}
        inside = "".join(map(re.escape, sorted(joins)))
        word = f"[{inside}]" if joins else "(?!)"
        self.fragments = re.compile(f"{MARK}+{word}*|{word}+|[^{inside}{MARK}]").findall
        self._pairs(joins | {MARK})
        #: A character that no piece joins to another: the library encodes what follows it on its own.
        self.lone = next(c for c in "\n\t\x01\x02" if c not in joins)
        self.lead = len(sp.encode(self.lone))
        self.ends = [np.array([i], "<u4").tobytes() if i >= 0 else b"" for i in (sp.bos_id(), sp.eos_id())]
        self.known: dict[str, bytes] = {}

    def _pairs(self, chars: set) -> None:
        """Symbols as numbers, and the pairs of symbols that join to a piece,
        sorted, each with the joined symbol and its place in score order."""
        names = sorted(chars | set(self.ids))
        self.number = {x: i for i, x in enumerate(names)}
        self.size = len(names)
        self.spelt = [self._spell(x) for x in names]
        pairs = sorted((self.number[p[:i]] * self.size + self.number[p[i:]], self.number[p], c) for p, c in self.costs.items()
                       for i in range(1, len(p)) if p[:i] in self.number and p[i:] in self.number)
        self.pair = np.array([k for k, _, _ in pairs] + [1 << 62], np.int64)
        self.joined = np.array([j for _, j, _ in pairs] + [0], np.int64)
        place = {c: i for i, c in enumerate(sorted(set(self.costs.values())))}
        self.order = np.array([place[c] for _, _, c in pairs] + [NONE], np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost place and joined symbol of pairs; a missing symbol is -1."""
        key = left * self.size + right
        at = np.searchsorted(self.pair, key)
        hit = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.order[at], NONE), self.joined[at]

    def merge(self, texts: list) -> list:
        """Ids of each fragment, by its agenda: the pair of least cost (best
        score) is joined first, of equal ones the leftmost."""
        out = [None] * len(texts)
        short: dict[int, list] = {}
        for i, t in enumerate(texts):
            if len(t) == 1:
                out[i] = self._spell(t)
            elif len(t) > SHORT:
                out[i] = self._merge_long(t)
            else:
                short.setdefault(len(t), []).append(i)
        for n, rows in short.items():
            for at in range(0, len(rows), STEP):
                some = rows[at:at + STEP]
                sym = np.array([self.number[c] for i in some for c in texts[i]], np.int64).reshape(len(some), n)
                for i, symbols in zip(some, self._merge_rows(sym)):
                    out[i] = b"".join(map(self.spelt.__getitem__, symbols))
        return out

    def _merge_rows(self, sym: np.ndarray) -> list:
        """The symbols left in each row."""
        n, width = sym.shape
        done, rows = [None] * n, np.arange(n)
        cost, _ = self._look(sym[:, :-1], sym[:, 1:])
        while len(rows):
            front = cost.argmin(axis=1) if cost.shape[1] else np.zeros(len(rows), int)
            live = cost[np.arange(len(rows)), front] < NONE if cost.shape[1] else np.zeros(len(rows), bool)
            for i, s in zip(rows[~live].tolist(), sym[~live].tolist()):
                done[i] = [x for x in s if x >= 0]
            rows, sym, cost, a = rows[live], sym[live], cost[live], front[live]
            if not len(rows):
                break
            here, each = np.arange(sym.shape[1] - 1), np.arange(len(rows))
            _, new = self._look(sym[each, a], sym[each, a + 1])
            sym = np.take_along_axis(sym, here + (here > a[:, None]), axis=1)  # the right symbol goes
            sym[each, a] = new
            cost = np.take_along_axis(cost, here[:-1] + (here[:-1] >= a[:, None]), axis=1)
            for side in (a - 1, a):  # the pairs of the new symbol
                ok = (side >= 0) & (side < cost.shape[1])
                cost[each[ok], side[ok]], _ = self._look(sym[each[ok], side[ok]], sym[each[ok], side[ok] + 1])
        return done

    def _merge_long(self, text: str) -> bytes:
        """The same for one fragment, the agenda a heap of (cost, left symbol,
        right symbol, length of the joined text)."""
        cost, n = self.costs.get, len(text)
        sym = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(s, i, i + 1, 2) for i in range(n - 1) if (s := cost(text[i:i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, a, b, size = heapq.heappop(agenda)
            if not sym[a] or not sym[b] or len(sym[a]) + len(sym[b]) != size:
                continue
            sym[a] += sym[b]
            sym[b] = ""
            c = after[a] = after[b]
            if c < n:
                before[c] = a
                if (s := cost(sym[a] + sym[c])) is not None:
                    heapq.heappush(agenda, (s, a, c, len(sym[a]) + len(sym[c])))
            z = before[a]
            if z >= 0 and (s := cost(sym[z] + sym[a])) is not None:
                heapq.heappush(agenda, (s, z, a, len(sym[z]) + len(sym[a])))
        return b"".join(self._spell(s) for s in sym if s)

    def _spell(self, symbol: str) -> bytes:
        got = self.ids.get(symbol)
        return got if got is not None else b"".join(self.bytes[x] for x in symbol.encode("utf-8"))

    def encode(self, texts: list, check: bool = True) -> list:
        """Ids of each text, begin and end included, as little-endian unsigned
        32-bit integers; with ``check`` new fragments are compared with the
        library."""
        known = self.known
        if len(known) >= REMEMBERED:
            known.clear()
        cut = [self.fragments(self.library.normalize(t)) if t else [] for t in texts]
        new = list({f for c in cut for f in c}.difference(known))
        known.update(zip(new, self.merge(new)))
        if check and new:
            same = self.library.encode([self.lone + f for f in new], num_threads=1)
            for f, ids in zip(new, same):
                if np.array(ids[self.lead:], "<u4").tobytes() != known[f]:
                    raise RuntimeError(f"differs from the library: {f[:80]!r}")
        begin, end = self.ends
        out = [b"".join((begin, *map(known.__getitem__, c), end)) for c in cut]
        for f in new:
            if len(f) > LONG:
                del known[f]
        return out

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: one row per row, ``ids`` (begin and
    end included) binary, little-endian unsigned 32-bit, ``decoded`` the
    model's text of them.

    A null text counts as empty (begin and end only); null ids and repeated
    rows are carried; an empty table gives no rows; only the two named
    columns are read.  Texts are taken whole, ``BATCH`` characters or one
    text at a time.  ``path`` is the model file's place on every node.
    """
    def run(batches):
        model = pieces(path)
        for b in batches:
            at, texts = 0, b.column(1).to_pylist()
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= BATCH):
                    size += len(texts[end] or "")
                    end += 1
                ids = model.encode(texts[at:end], check)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, end - at), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array(ids, pa.binary()), pa.array(map(model.decode, ids), pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"])
                at = end

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, decoded string")
