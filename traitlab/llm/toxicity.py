"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A text is its lower-cased words.  A word enters the network as a word
embedding (hashed) beside the mean of its character-gram embeddings (3 and 4
characters with word ends, hashed), so a form never seen is read by its
letters.  Overlapping windows of ``WINDOW`` words, one from every ``STRIDE``-th
word, so that any ``WINDOW - STRIDE + 1`` words lie whole in one, are run
through the network; attention pools a window's states and a linear layer
gives its logit; a document's logit is its largest window's.  The network is
trained in numpy (Adam, back-propagation through time).

Documents are labelled, windows are not.  Character-gram counts over all
labelled rows give log odds per gram, where the embeddings start; the windows
of a toxic training document with the highest odds are its examples, and of a
clean one those with the highest odds (the hardest) and others dealt by a
hash.  What reaches the driver is bounded by parameters: one row per gram
bucket, ``WINDOWS`` windows of each of ``2 * SAMPLE`` documents.  A part of the
sample that did not train turns the document logits into probabilities.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .labelled import fold, logistic_line, training_rows, unpack

WINDOW, STRIDE = 32, 8
SAMPLE = 3000        # labelled documents per class: three quarters train, the rest give the probabilities
WINDOWS = 4          # windows of a training document
BUCKETS = 1 << 17    # hashed character grams
WORD_BUCKETS = 1 << 14
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 6, 10, 8, 8
EPOCHS, BATCH, RATE = 3, 128, 0.005
WORDS_KEPT = 250_000
LEAST, DOUBT, CLEAR = 3, 1.6, 1.0  # see sure_odds; odds that make a window an example
STEPS = 300          # of the training, at least
AT_ONCE = 1024       # windows run together


def char_grams(words: list) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character grams of words (non-empty), laid end to end,
    and their number per word: every 3 and 4 characters of ``^word$``."""
    text = "".join([f"^{w}$" for w in words])
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(size) - size
    hashes, owner = [], []
    code = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA6B) ^ c[2:] * np.uint32(0xC2B2AE35)
    for n in (3, 4):
        number = np.maximum(size - n + 1, 0)
        own = np.repeat(np.arange(len(words)), number)
        at = np.arange(len(own)) - np.repeat(np.cumsum(number) - number, number) + start[own]
        h = code[at] if n == 3 else (code[at] ^ c[at + 3] * np.uint32(0x27D4EB2F)) + np.uint32(4)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        hashes.append((h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1))
        owner.append(own)
    order = np.argsort(np.concatenate(owner), kind="stable")
    return np.concatenate(hashes)[order].astype(np.int64), 2 * size - 5


def word_bucket(word: str) -> int:
    return zlib.crc32(word.strip(".,;:!?\"'()").encode("utf-8", "surrogatepass"), 7) % WORD_BUCKETS


def windows_of(n: int) -> np.ndarray:
    """First words of the windows of a text of ``n`` words: every stride, the
    last window reaching the end."""
    return np.arange(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters, forward and backward passes; time comes first in arrays."""

    def __init__(self, seed: int = 3):
        g, d, h = np.random.default_rng(seed), WORD_DIM + CHAR_DIM, HIDDEN
        r = lambda *s, scale: (g.standard_normal(s) * scale).astype(np.float32)
        self.p = {"word": r(WORD_BUCKETS, WORD_DIM, scale=0.02), "char": r(BUCKETS, CHAR_DIM, scale=0.05),
                  "in": r(d, 6 * h, scale=d ** -0.5), "bias": np.zeros(6 * h, np.float32),
                  "rec": r(2, h, 3 * h, scale=h ** -0.5), "att": r(2 * h, ATTENTION, scale=(2 * h) ** -0.5),
                  "pick": r(ATTENTION, scale=0.5), "out": r(2 * h, scale=0.3), "shift": np.zeros(1, np.float32)}

    def embed(self, word, grams, counts) -> np.ndarray:
        """Inputs of words: their bucket, their grams laid end to end."""
        starts = np.cumsum(counts) - counts
        chars = np.add.reduceat(self.p["char"][grams], starts, axis=0) / counts[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][word], chars], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.p["in"] + self.p["bias"]

    def forward(self, gates: np.ndarray, real: np.ndarray, keep: bool = False):
        """Logits of windows from projected words (time, window, 6 * hidden)
        and the mask of real words."""
        t_n, n, h = len(gates), gates.shape[1], HIDDEN
        state, rec = np.zeros((2, n, h), np.float32), self.p["rec"]
        out = np.empty((t_n, n, 2 * h), np.float32)
        steps = []
        for t in range(t_n):
            b = t_n - 1 - t
            g = np.stack((gates[t, :, :3 * h], gates[b, :, 3 * h:]))
            m = np.stack((real[t], real[b]))[:, :, None]
            q = state @ rec
            zr = _sigmoid(g[:, :, :2 * h] + q[:, :, :2 * h])
            z, r = zr[:, :, :h], zr[:, :, h:]
            c = np.tanh(g[:, :, 2 * h:] + r * q[:, :, 2 * h:])
            new = state + m * (1 - z) * (c - state)
            if keep:
                steps.append((state, z, r, c, q[:, :, 2 * h:], m))
            state = new
            out[t, :, :h], out[b, :, h:] = state[0], state[1]
        s = np.tanh(out @ self.p["att"])
        e = np.where(real > 0, s @ self.p["pick"], -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[:, :, None] * out).sum(axis=0)
        logit = pooled @ self.p["out"] + self.p["shift"][0]
        return (logit, (out, s, a, pooled, steps)) if keep else logit

    def backward(self, d: np.ndarray, real: np.ndarray, kept) -> tuple[dict, np.ndarray]:
        """Gradients for d = dloss/dlogit: of the parameters, of the gates."""
        out, s, a, pooled, steps = kept
        p, h, t_n = self.p, HIDDEN, len(out)
        g = {"out": pooled.T @ d, "shift": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * p["out"]
        da = (out * dpool).sum(axis=2)
        de = a * (da - (a * da).sum(axis=0))
        dout = a[:, :, None] * dpool
        g["pick"] = np.einsum("tnk,tn->k", s, de)
        ds = de[:, :, None] * p["pick"] * (1 - s * s)
        g["att"] = np.einsum("tnh,tnk->hk", out, ds)
        dout += ds @ p["att"].T
        dgates = np.zeros((t_n, out.shape[1], 6 * h), np.float32)
        dstate, g["rec"] = np.zeros((2, out.shape[1], h), np.float32), np.zeros_like(p["rec"])
        for t in range(t_n - 1, -1, -1):
            b = t_n - 1 - t
            state, z, r, c, qc, m = steps[t]
            dstate = dstate + np.stack((dout[t, :, :h], dout[b, :, h:]))
            dc = dstate * m * (1 - z) * (1 - c * c)
            dz = dstate * m * (state - c) * z * (1 - z)
            dr = dc * qc * r * (1 - r)
            dq = np.concatenate((dz, dr, dc * r), axis=2)
            dg = np.concatenate((dz, dr, dc), axis=2)
            dgates[t, :, :3 * h], dgates[b, :, 3 * h:] = dg[0], dg[1]
            g["rec"] += np.einsum("dnh,dnk->dhk", state, dq)
            dstate = dstate * (1 - m * (1 - z)) + dq @ p["rec"].transpose(0, 2, 1)
        return g, dgates

    def train(self, texts: list, y: np.ndarray, seed: int = 5) -> None:
        """Adam on the logistic loss of windows (lists of words)."""
        vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        if not vocabulary:
            return
        bucket = np.array([word_bucket(w) for w in vocabulary])
        grams, per_word = char_grams(list(vocabulary))
        begin = np.cumsum(per_word) - per_word
        ids = np.full((len(texts), WINDOW), -1)
        for i, t in enumerate(texts):
            ids[i, :len(t)] = [vocabulary[w] for w in t]
        rng = np.random.default_rng(seed)
        mean, square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(max(EPOCHS, min(10 * EPOCHS, -(-STEPS * BATCH // len(texts))))):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                pick = order[at:at + BATCH]
                real = (ids[pick].T >= 0).astype(np.float32)
                used, inverse = np.unique(np.maximum(ids[pick].T, 0), return_inverse=True)
                inverse = inverse.reshape(WINDOW, len(pick))
                counts = per_word[used]
                flat = grams[np.repeat(begin[used] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
                x = self.embed(bucket[used], flat, counts)
                logit, kept = self.forward(self.project(x)[inverse], real, keep=True)
                d = ((_sigmoid(logit) - y[pick]) / len(pick)).astype(np.float32)
                g, dgates = self.backward(d, real, kept)
                dproj = np.zeros((len(used), dgates.shape[2]), np.float32)
                np.add.at(dproj, inverse.ravel(), dgates.reshape(-1, dgates.shape[2]))
                g["in"], g["bias"] = x.T @ dproj, dproj.sum(axis=0)
                dx = dproj @ self.p["in"].T
                rows = {k: slice(None) for k in g}  # of the embeddings, only the rows that the batch touched
                for k, at_, v in (("word", bucket[used], dx[:, :WORD_DIM]),
                                  ("char", flat, np.repeat(dx[:, WORD_DIM:] / counts[:, None], counts, axis=0))):
                    rows[k], place = np.unique(at_, return_inverse=True)
                    g[k] = np.zeros((len(rows[k]), v.shape[1]), np.float32)
                    np.add.at(g[k], place, v)
                step += 1
                for k, v in g.items():
                    at_ = rows[k]
                    mean[k][at_] += 0.1 * (v - mean[k][at_])
                    square[k][at_] += 0.001 * (v * v - square[k][at_])
                    up = (mean[k][at_] / (1 - 0.9 ** step)) / (np.sqrt(square[k][at_] / (1 - 0.999 ** step)) + 1e-8)
                    self.p[k][at_] -= (RATE * up).astype(np.float32)


class Scorer:
    """Document logits with a network; remembers projected words up to a bound."""

    def __init__(self, network: Network):
        self.net, self.index = network, {}
        self.table = np.zeros((1024, 6 * HIDDEN), np.float32)

    def _known(self, texts: list) -> None:
        new = [w for w in {w for t in texts for w in t} if w not in self.index]
        if len(self.index) + len(new) > WORDS_KEPT:
            self.index.clear()
            new = list({w for t in texts for w in t})
        if not new:
            return
        at, need = len(self.index) + 1, len(self.index) + 1 + len(new)
        if need > len(self.table):
            grown = np.zeros((max(need, 2 * len(self.table)), 6 * HIDDEN), np.float32)
            grown[:at] = self.table[:at]
            self.table = grown
        for lo in range(0, len(new), 4096):
            part = new[lo:lo + 4096]
            x = self.net.embed(np.array([word_bucket(w) for w in part]), *char_grams(part))
            self.table[at + lo:at + lo + len(part)] = self.net.project(x)
        self.index.update(zip(new, range(at, need)))

    def logits(self, texts: list) -> np.ndarray:
        """The largest window logit of each text (a list of words)."""
        out = np.empty(len(texts))
        lo = 0
        while lo < len(texts):  # some texts at a time: bounded memory
            hi, words = lo, 0
            while hi < len(texts) and (hi == lo or words + len(texts[hi]) <= 60_000):
                words += len(texts[hi])
                hi += 1
            out[lo:hi] = self._some(texts[lo:hi])
            lo = hi
        return out

    def _some(self, texts: list) -> np.ndarray:
        self._known(texts)
        get, ids, start, count, size = self.index.__getitem__, [], [], [], 0
        for t in texts:
            first = windows_of(len(t))
            own = np.zeros(first[-1] + WINDOW, np.int64)  # 0: no word
            own[:len(t)] = np.fromiter(map(get, t), np.int64, len(t))
            ids.append(own)
            start.append(first + size)
            size += len(own)
            count.append(len(first))
        ids, start, steps = np.concatenate(ids), np.concatenate(start), np.arange(WINDOW)[:, None]
        logit = np.concatenate([self._windows(ids[start[i:i + AT_ONCE] + steps]) for i in range(0, len(start), AT_ONCE)])
        return np.maximum.reduceat(logit, np.cumsum(count) - count)

    def _windows(self, ids: np.ndarray) -> np.ndarray:
        return self.net.forward(self.table[ids], (ids > 0).astype(np.float32))


def words_of(text: str | bytes | None) -> list:
    if isinstance(text, bytes):
        text = text.decode("utf-8", "surrogatepass")
    return (text or "").lower().split()


def gram_odds(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of each character gram, and the class sizes, from all
    labelled rows (one row per bucket, class and task)."""
    def count(batches):
        n, size = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        seen = np.zeros(BUCKETS, bool)
        for b in batches:
            for z, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if words := list(set(words_of(unpack(z)))):
                    seen[char_grams(words)[0]] = True
                at = np.flatnonzero(seen)
                n[y, at] += 1
                seen[at] = False
                size[y] += 1
        for y in (0, 1):
            at = np.flatnonzero(n[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.full(len(at) + 1, y, np.int32)),
                                              pa.array(np.append(n[y][at], size[y]))], names=["bucket", "y", "n"])

    got = (rows.select("z", "y").mapInArrow(count, "bucket long, y int, n long")
           .groupBy("bucket", "y").agg(F.sum("n").alias("n")).toArrow())
    bucket, y, c = (got.column(i).to_numpy() for i in range(3))
    n, size = np.zeros((2, BUCKETS)), np.zeros(2)
    n[y[bucket >= 0], bucket[bucket >= 0]] = c[bucket >= 0]
    size[y[bucket < 0]] = c[bucket < 0]
    return sure_odds(n, size), size


def sure_odds(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Log odds of each gram (clean row of ``n`` first), drawn towards 0 by
    ``DOUBT`` standard errors; 0 for grams of fewer than ``LEAST`` toxic
    rows, which would only name the documents counted."""
    odds = np.log((n[1] + 0.5) / (size[1] + 1)) - np.log((n[0] + 0.5) / (size[0] + 1))
    error = np.sqrt(1 / (n[1] + 0.5) + 1 / (n[0] + 0.5))
    odds = np.sign(odds) * np.maximum(np.abs(odds) - DOUBT * error, 0)
    odds[(odds > 0) & (n[1] < LEAST)] = 0
    return odds.astype(np.float32)


def _examples(odds: np.ndarray):
    """Labelled texts -> their training windows, words joined by a space."""
    def run(batches):
        for b in batches:
            ys, hs, out = [], [], []
            for raw, y, h in zip(*(b.column(i).to_pylist() for i in range(3))):
                words = words_of(raw)
                best = np.zeros(1)
                if words:
                    flat, counts = char_grams(words)
                    best = np.maximum.reduceat(odds[flat], np.cumsum(counts) - counts)
                first = windows_of(len(words))
                top = np.array([best[i:i + WINDOW].max() for i in first])
                order = np.argsort(-top, kind="stable")
                if y == 1:
                    pick = [i for i in order[:2] if top[i] >= CLEAR]
                else:
                    rng = np.random.default_rng(abs(h))
                    pick = np.unique(np.concatenate((order[:2], rng.choice(len(first), min(len(first), WINDOWS - 2), False))))
                for i in first[pick]:
                    ys.append(y)
                    hs.append(h)
                    out.append(" ".join(words[i:i + WINDOW]))
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(hs, pa.int64()), pa.array(out, pa.string())],
                                             names=["y", "h", "window"])
    return run


def fit(rows: DataFrame, sampled: DataFrame) -> tuple[Network, tuple[float, float]]:
    """The network and the line from logits to log odds.  With one class
    only, or no rows, the line gives the share of 1."""
    spark = rows.sparkSession
    odds, size = gram_odds(rows)
    net = Network()
    net.p["char"][:, 0] = odds  # what all labelled rows say, to start from
    base = float(np.log((size[1] + 1) / (size[0] + 1)))
    if not size.all():
        return net, (0.0, base)
    learn = F.pmod("h", F.lit(4)) > 0
    got = (sampled.where(learn).mapInArrow(_examples(odds), "y int, h long, window string").toArrow()
           .sort_by([("h", "ascending"), ("y", "ascending"), ("window", "ascending")]))
    y = got.column("y").to_numpy()
    if len(set(y)) < 2:
        return net, (0.0, base)
    net.train([w.split() for w in got.column("window").to_pylist()], y.astype(np.float32))
    s = _logits(sampled.where(~learn).select("y", "raw"), net, spark).toArrow()
    m, y = s.column("logit").to_numpy(), s.column("y").to_numpy()
    if len(set(y)) < 2:
        return net, (1.0, 0.0)
    share = size / np.array([(y == c).sum() for c in (0, 1)])  # rows that a sampled row stands for
    return net, logistic_line(m, y, share[y] * len(y) / share[y].sum())


def _logits(rows: DataFrame, net: Network, spark) -> DataFrame:
    """``(first column, logit)`` for rows (anything, text or its bytes)."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast({k: v.astype(np.float32) for k, v in net.p.items()})  # 2 MB
    key, kind = rows.columns[0], rows.schema[0].dataType.simpleString()

    def run(batches):
        network = Network()
        network.p = shared.value
        scorer = Scorer(network)
        for b in batches:
            texts = [words_of(t) for t in b.column(1).to_pylist()]
            logits = scorer.logits(texts) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(logits, pa.float64())], names=[key, "logit"])

    return rows.mapInArrow(run, f"`{key}` {kind}, logit double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", parts: int = 3, held: int = 1, cut: float = 0.7) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Learns only from labelled rows outside the held-out fold.  A null, empty
    or blank text is one window without words.  Null or other labels and
    labels without a document teach nothing; a document with several labels
    counts with each.  A null id is not held out.  An empty table gives no
    rows.
    """
    net, (a, b) = fit(*training_rows(docs, labels, id_col, text_col, label_col, parts, held, SAMPLE))
    s = _logits(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), net,
                docs.sparkSession)
    score = 1 / (1 + F.exp(-(F.col("logit") * a + b)))
    return (s.withColumn("score", score)
            .select("doc_id", F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= cut).cast("int").alias("predicted")))
