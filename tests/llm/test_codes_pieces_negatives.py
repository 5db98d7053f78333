"""Vector codes, SentencePiece encoding and hard negatives against plain versions."""

import random

import numpy as np
import pytest

from traitlab.llm import hard_negatives as HN
from traitlab.llm import vector_codes as VC
from traitlab.llm.hard_negatives import Tree, hard_negatives
from traitlab.llm.piece_bpe import MARK, Pieces, encode
from traitlab.llm.vector_codes import compress, nearest, walsh, with_group_sum

NAN, INF = float("nan"), float("inf")
ODD = [(9001, None, 1), (9002, [NAN] + [1.0] * 15, 1), (9003, [None] + [1.0] * 15, 2), (9004, [INF] * 16, 0)]


def vectors(n=300, dim=16, seed=3, copies=60):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) / 4
    x[-copies:] = x[0]  # one vector many times
    return [(i, [float(np.float32(v)) for v in x[i]], int(i % 4)) for i in range(n)]


# ------------------------------------------------------------------ vector codes

@pytest.mark.parametrize("dim,big", [(1, 9), (3, 2000), (8, 2000), (8, 1 << 40), (13, 5)])
def test_nearest_entry_is_that_of_comparing_all(dim, big):
    rng = np.random.default_rng(dim)
    x, e = rng.integers(-big, big, (500, dim)), rng.integers(-big, big, (16, dim))
    e[7] = e[2]
    x[:20] = e[np.arange(20) % 16]
    plain = ((x[:, None].astype(object) - e[None].astype(object)) ** 2).sum(axis=2)
    code, dist = nearest(x, e)
    want = [int(np.argmin(r)) for r in plain]
    assert code.tolist() == want
    assert [int(d) for d in dist] == [int(r[w]) for r, w in zip(plain, want)]


def test_transform_keeps_scaled_distances_and_sequency_order():
    x = np.random.default_rng(0).integers(-99, 99, (40, 6))
    h = walsh(x)
    assert ((h[3] - h[9]) ** 2).sum() == 8 * ((x[3] - x[9]) ** 2).sum()
    signs = walsh(np.eye(8, dtype=np.int64)).T
    assert (np.diff(signs, axis=1) != 0).sum(axis=1).tolist() == list(range(8))


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = sorted((r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])),
                  key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    dim = -(-max(len(r[1]) for r in kept) // parts) * parts
    x = np.zeros((len(kept), dim), dtype=object)
    for i, r in enumerate(kept):
        for j, v in enumerate(r[1]):
            x[i, j] = int(np.floor(4096 * np.float64(v)))
    w, out, books = dim // parts, [], []
    for p in range(parts):
        xp = x[:, p * w:(p + 1) * w]
        book = xp[:entries].copy()

        def assign():
            d = ((xp[:, None] - book[None]) ** 2).sum(axis=2)
            return np.array([int(np.argmin(r)) for r in d]), d.min(axis=1)

        for _ in range(rounds):
            code, _ = assign()
            for e in range(len(book)):
                if (code == e).any():
                    book[e] = [int(s) // int((code == e).sum()) for s in xp[code == e].sum(axis=0)]
        out.append(assign())
        books.append(book)
    codes = ["".join(f"{out[p][0][i]:02x}" for p in range(parts)) for i in range(len(kept))]
    error = [int(sum(out[p][1][i] for p in range(parts))) for i in range(len(kept))]
    return kept, codes, error, books


def check_codes(spark, rows):
    kept, codes, error, books = plain_codes(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, error string, code int")
    got, gbooks = compress(df)
    by = {}
    for k, e in zip(kept, error):
        by[k[2]] = by.get(k[2], 0) + e
    want = sorted(zip([k[0] for k in kept], codes, error, [by[k[2]] for k in kept]), key=str)
    assert sorted(((r.vec_id, bytes(r.code).hex(), r.error, r.label_error) for r in got.collect()), key=str) == want
    assert [b.tolist() for b in gbooks] == [b.tolist() for b in books]


def test_codes_against_plain_rounds(spark):
    rows = vectors() + ODD + [(9005, vectors()[3][1], None), (9006, vectors()[4][1], None), (12, vectors()[12][1], 0)]
    check_codes(spark, rows)


def test_codes_of_few_short_and_empty_vectors(spark):
    check_codes(spark, vectors(5, copies=2))
    check_codes(spark, [(1, [0.5, -1.0, 2.0], 1), (2, [], None), (3, [0.25] * 9, 1), (None, [1.0], 2)])


def test_codes_of_no_vectors(spark):
    for rows in ([], ODD):
        got, books = compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
        assert got.collect() == [] and len(books[0]) == 0
        assert got.columns == ["vec_id", "label", "code", "error", "label_error"]


def test_group_sums_by_broadcast_and_by_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2, i) for i in range(50)], "id long, g int, v long")
    a = sorted(map(tuple, with_group_sum(df, "g", "v", "s").collect()))
    monkeypatch.setattr(VC, "FEW_GROUPS", 0)
    assert sorted(map(tuple, with_group_sum(df, "g", "v", "s").select("id", "g", "v", "s").collect()), key=lambda r: r[0]) == \
        sorted([(r[-4], r[-3], r[-2], r[-1]) for r in a], key=lambda r: r[0])


# ------------------------------------------------------------------ SentencePiece

@pytest.fixture(scope="module")
def model():
    P = pytest.importorskip("public_tokenizers")
    return Pieces(P.path("piece_bpe_32k.model"))


def library(model, text):
    return np.array(model.library.encode(text, add_bos=True, add_eos=True), "<u4").tobytes()


def test_pieces_equal_the_library_on_random_texts(model):
    rng = random.Random(11)
    chars = f"  {MARK}ab étheing日本\n\t0123456789　\u0000.,<s></s><0x41>😀́ﬁ\r\xa0ABC"
    names = [model.library.id_to_piece(i).replace(MARK, " ") for i in range(3, 32000)]
    texts = ["", " ", MARK, "  ", "a", "\n", "<s>", "<0x0A>"]
    for i in range(6000):
        some = [rng.choice(chars) for _ in range(rng.randint(0, 60))] if i % 2 else rng.choices(names, k=rng.randint(0, 20))
        texts.append("".join(some))
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x2fff), rng.randint(0x10000, 0x1ffff), rng.randint(0x4e00, 0x9fff)]))
                      for _ in range(40)) for _ in range(500)]
    assert model.encode(texts) == [library(model, t) for t in texts]


def test_pieces_of_long_texts(model):
    for t in ("wordsandnospace" * 20000, " " * 50000, "日本語" * 30000, "ab cd\n" * 30000):
        got, = model.encode([t])
        assert got == library(model, t)
        assert model.decode(got) == t


def test_short_and_long_agendas_agree(model):
    rng = random.Random(2)
    words = ["".join(rng.choice("thearnsio" + MARK) for _ in range(rng.randint(2, 30))) for _ in range(2000)]
    assert model.merge(words) == [model._merge_long(w) for w in words]


def test_pieces_of_a_table(spark, model):
    import public_tokenizers as P
    rows = [(1, "Hello  world"), (None, None), (2, ""), (2, ""), (3, "naïve\n\nテスト " * 500)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, ids string, n_tokens int")
    got = encode(df, P.path("piece_bpe_32k.model")).collect()
    want = [library(model, t or "") for _, t in rows]
    assert sorted((str(r.doc_id), bytes(r.ids), r.n_tokens, r.decoded) for r in got) == sorted(
        (str(i), w, len(w) // 4, t or "") for (i, t), w in zip(rows, want))
    assert encode(df.where("false"), P.path("piece_bpe_32k.model")).collect() == []


def test_a_difference_from_the_library_ends_the_encoding(model, monkeypatch):
    monkeypatch.setattr(model, "merge", lambda texts: [b"\1\0\0\0"] * len(texts))
    monkeypatch.setattr(model, "known", {})
    with pytest.raises(RuntimeError):
        model.encode(["some words"])


# ------------------------------------------------------------------ hard negatives

def plain_negatives(rows, positives=5, negatives=3):
    ok = {}
    for i, v, lab in rows:
        if None not in (i, v, lab) and all(z is not None and np.isfinite(z) for z in v):
            ok[i] = min(ok.get(i, (lab, v)), (lab, v))
    x = {i: np.floor(256 * np.array(v, float)) for i, (_, v) in ok.items()}
    out = []
    for a in sorted(ok):
        if a % 50:
            continue
        ranked = sorted(((-int(x[a] @ x[b]), b) for b in ok if b != a))
        for s, p in [r for r in ranked if ok[r[1]][0] == ok[a][0]][:positives]:
            s, found = -s, [(-n, b) for n, b in ranked if ok[b][0] != ok[a][0]]
            hit = [(n, b) for n, b in found if 50 * s <= 100 * n <= 95 * s][:negatives]
            out += [(a, p, k + 1, b, s, n) for k, (n, b) in enumerate(hit)]
    return sorted(out)


def clusters(n=900, dim=16, seed=5):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((12, dim))
    x = centre[rng.integers(0, 12, n)] + rng.standard_normal((n, dim)) * rng.uniform(0.05, 0.6, (n, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[n // 3:2 * n // 3:2] = x[1]  # one vector many times
    return [(i, [float(np.float32(v)) for v in x[i]], int(rng.integers(0, 5))) for i in range(n)]


def negatives_of(spark, rows):
    df = spark.createDataFrame([(*r, "z", 5) for r in rows], "vec_id long, embedding array<float>, label int, score string, leaf int")
    return sorted(map(tuple, hard_negatives(df).collect()))


def test_negatives_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(HN, "LEAF", 40)
    monkeypatch.setattr(HN, "BLOCK", 60)  # leaves of several blocks, anchors in several packs
    monkeypatch.setattr(HN, "FANOUT", 4)
    rows = clusters() + ODD + [(9050, rows_[1], None) for rows_ in clusters(12)[:1]] + [(None, clusters(12)[2][1], 1)]
    rows += [(100, clusters(12)[5][1], 4), (100, clusters(12)[5][1], 4)]  # ids that repeat
    want = plain_negatives(rows)
    assert want and negatives_of(spark, rows) == want


def test_negatives_of_one_leaf_and_of_none(spark):
    rows = clusters(70)
    assert negatives_of(spark, rows) == plain_negatives(rows)
    assert negatives_of(spark, []) == []
    assert negatives_of(spark, [(0, [1.0], 1), (50, [], 1), (3, [0.5, 0.5], 2)]) == plain_negatives(
        [(0, [1.0, 0.0], 1), (50, [0.0, 0.0], 1), (3, [0.5, 0.5], 2)])


def test_tree_eliminates_and_loses_nothing():
    x = np.array([r[1] for r in clusters(4000, dim=8, seed=9)])
    tree = Tree(x[:800], 40_000)
    assert tree.leaves > 20
    walk = tree.walk(x)
    leaf = None
    while leaf is None:
        try:
            node, at, d, side = next(walk)
        except StopIteration as end:
            leaf = end.value
            break
        d = np.c_[d, np.sqrt((x[at] ** 2).sum(axis=1))]
        for j in np.unique(side):
            tree.near[node][:, j] = np.minimum(tree.near[node][:, j], d[side == j].min(axis=0))
            tree.far[node][:, j] = np.maximum(tree.far[node][:, j], d[side == j].max(axis=0))
    q = x[::40]
    score = q @ x.T
    low = np.full((len(q), 1), 0.95)
    who, where = tree.visit(q, low, np.full((len(q), 1), np.inf))
    seen = set(zip(who.tolist(), where.tolist()))
    assert all((a, leaf[b]) in seen for a, b in zip(*np.nonzero(score >= 0.95)))
    assert len(seen) < 0.7 * len(q) * tree.leaves
