"""Near-copy operators against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from traitlab.llm.common import components
from traitlab.llm.embedding_dedup import candidates, embedding_dedup, plan_tables
from traitlab.llm.simhash_dedup import fingerprint, hamming_links, keep_first, large_nodes, simhash_dedup, trie_links
from traitlab.llm.suffix_dedup import drop_repeats, suffix_dedup


def groups(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(300, 400)] + [(500, 501), (501, 502), (502, 500)]
    edges += [(rng.randint(1000, 1300), rng.randint(1000, 1300)) for _ in range(150)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    ids = {x for a, b in edges if a != b for x in (a, b)}
    assert got == groups(ids, edges)


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def vectors(seed=1, dim=32):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((160, dim))
    near = x[rng.integers(0, 160, 200)] + rng.standard_normal((200, dim)) * rng.uniform(0.05, 0.5, (200, 1))
    return np.concatenate((x, near, x[:20], 3 * x[5:9])).astype(np.float32)


def test_embedding_links_against_brute_force(spark):
    x = vectors()
    lab = np.arange(len(x)) % 3
    rows = [(int(i), [float(v) for v in x[i]], int(lab[i])) for i in range(len(x))]
    odd = [(9000, None, 1), (9001, [0.0] * 32, 1), (9002, [float("nan")] + [1.0] * 31, 1), (9003, [None] + [1.0] * 31, 1),
           (9004, [1.0, 2.0], 1), (9005, [float("inf")] * 32, 2), (9006, rows[0][1], None), (9007, [], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embedding_dedup(df).collect()}
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    link = (y @ y.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    comp = groups(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(link))])
    found = sum(got[i].n_links for i in range(len(x)))
    assert found <= link.sum() and found >= 0.99 * link.sum()
    if found == link.sum():
        assert all(got[i].component_id == comp[i] and got[i].kept == (comp[i] == i) for i in range(len(x)))
    for i, *_ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_embedding_recall_on_a_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = vectors(3, 64)
    rows = spark.createDataFrame([(10 ** 6 + i, [float(v) for v in x[i]], i % 2) for i in range(len(x))], df.schema)
    got = embedding_dedup(df.union(rows)).agg(F.sum("n_links"), F.count("*")).first()
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = sum(int((y[k::2] @ y[k::2].T >= 0.93).sum()) - len(y[k::2]) for k in (0, 1))
    assert got[1] == df.count() + len(x) and want > 100
    assert 0.99 * want <= got[0] <= want  # the table itself has no pair at 0.93


def pairs_at(cosine, n, dim=64, seed=11):
    """``n`` pairs of unit vectors, the i-th at ``cosine[i]``."""
    rng = np.random.default_rng(seed)
    x, u = rng.standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u -= (u * x).sum(axis=1, keepdims=True) * x
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = np.asarray(cosine)[:, None]
    return x, c * x + np.sqrt(1 - c * c) * u


@pytest.mark.parametrize("largest", [3_000, 100_000])
def test_embedding_tables_share_a_filter_with_every_pair_at_the_threshold(largest):
    plans = plan_tables(64, largest, 0.93)
    x, y = pairs_at(np.full(3000, 0.93), 3000)
    a, b = ({(int(r), int(f)) for r, f in zip(*candidates(z, plans))} for z in (x, y))
    assert {r for r, _ in a & b} == set(range(3000))


def test_embedding_pairs_just_above_the_threshold(spark):
    x, y = pairs_at(np.linspace(0.9301, 0.95, 3000), 3000)
    rows = [(2 * i + k, [float(v) for v in z], 1) for i in range(3000) for k, z in enumerate((x[i], y[i]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(df).collect()}
    assert got == {i: (1, i - i % 2) for i in range(6000)}


@pytest.mark.parametrize("dim", [1, 2, 3, 5])
def test_embedding_short_vectors(spark, dim):
    x = np.random.default_rng(dim).standard_normal((60, dim))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], 1) for i in range(60)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup(df).collect()}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == dict(enumerate(((y @ y.T >= 0.93).sum(axis=1) - 1).tolist()))


def test_embedding_empty_table(spark):
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int, a int")).collect() == []


def plain_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for t in (None, "", " \n", "One", "one two", "A b\tC", "a b c d", "Ä b \x0b c\xa0d e", "x " * 5000, "İ é É z"):
        assert fingerprint(t) == plain_fingerprint(t), t


@pytest.mark.parametrize("budget", [0, 1, 3])
def test_trie_links_connect_what_brute_force_connects(budget):
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 2 ** 63, 30, dtype=np.uint64)
    x = [base]
    for _ in range(15):
        y = base.copy()
        for _ in range(3):
            y ^= np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)
        x.append(y)
    fp = np.unique(np.concatenate(x))
    i, j = trie_links(fp, (0, len(fp)), None, 0, budget)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= budget
    assert groups(range(len(fp)), zip(i.tolist(), j.tolist())) == groups(range(len(fp)), zip(*(v.tolist() for v in np.nonzero(near))))
    assert len(i) < len(fp)


def test_simhash_dedup_against_brute_force(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(300)]
    rows = []
    for i in range(0, 300, 3):
        w = [rng.choice(words) for _ in range(rng.randint(0, 300))]
        rows.append((i, " ".join(w)))
        if w:
            w[rng.randrange(len(w))] = "changed"
        rows += [(i + 1, " ".join(w)), (i + 2, rows[-1][1] if i % 2 else None)]
    rows += [(900, ""), (901, " "), (902, "Word " * 30_000), (902, "Word " * 30_000), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash_dedup(df).collect()
    assert len(got) == len(rows)
    fps = {i: plain_fingerprint(t) for i, t in rows if i is not None}
    ids = sorted(fps)
    want = groups(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])
    kept = {r.doc_id for r in keep_first(df).collect()}
    assert kept == {i for i in ids if want[i] == i} | {None}


def test_simhash_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, fp int, tree int")
    assert simhash_dedup(df).collect() == [] and keep_first(df).columns == df.columns


def plain_repeats(rows, n):
    c, out = Counter(), {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        c.update(b[k:k + n] for k in range(len(b) - n + 1))
    for i, b in texts:
        m = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if c[b[k:k + n]] > 1:
                m[k:k + n] = True
        keep = bytes(x for x, f in zip(b, m) if not f)
        out[i] = (len(b), int(m.sum()), int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum()), hashlib.sha256(keep).hexdigest())
    return out


@pytest.mark.parametrize("n", [200, 48])
def test_repeated_bytes_against_brute_force(spark, n):
    rng = random.Random(n)
    text = lambda k: " ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(k))
    passages = [text(70) for _ in range(4)]
    rows = []
    for i in range(90):
        t = text(rng.randint(0, 90))
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, 90)
            t = t[:len(t) // 2] + rng.choice(passages)[a:a + rng.randint(n - 20, n + 80)] + t[len(t) // 2:]
        rows.append((i, t))
    rows += [(200, "ab " * 300), (201, "ab " * 80), (202, None), (203, ""), (204, rows[3][1]), (206, "x" * 1000),
             (207, "x" * n), (208, "y" * n), (209, "z" * (n + 1)), (210, "short")]
    df = spark.createDataFrame([(*r, r[0]) for r in rows], "doc_id long, text string, at long")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.k)
           for r in suffix_dedup(df, length=n).withColumn("k", F.sha2("kept_bytes", 256)).collect()}
    assert got == plain_repeats(rows, n)
    cut = drop_repeats(df, length=n)
    assert cut.columns == df.columns and cut.count() == len(rows)


def test_repeated_bytes_across_pieces_of_a_long_text(spark, monkeypatch):
    from traitlab.llm import suffix_dedup as M
    rng = random.Random(9)
    long_ = "".join(rng.choice("abcdefgh ") for _ in range(M.CHUNK + 3000))
    at = M.CHUNK - 150
    rows = [(1, long_), (2, "-" + long_[at:at + 320] + "+"), (None, long_[:500])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (820, 2), 2: (320, 1), None: (500, 1)}  # a text without an id is compared like any other


def test_repeated_bytes_of_shared_and_missing_ids(spark, monkeypatch):
    from traitlab.llm import common
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    a, b, c = word(500), word(500), word(300)
    rows = [(1, a + word(50)), (1, word(40) + b), (None, word(30) + a), (None, c), (None, c), (None, None), (2, word(400)), (3, b[100:400])]
    rows += [(4, a[:350])] * 40  # one row many times
    want = sorted(map(str, (v for v in plain_repeats(list(enumerate(t for _, t in rows)), 200).values())))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, h string")
    for share in (2000, 1):  # with share 1 every group is dealt to parts
        monkeypatch.setattr(common, "HOT_SHARE", share)
        got = [(r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept_bytes).hexdigest()) for r in suffix_dedup(df).collect()]
        assert sorted(map(str, got)) == want


def test_rows_of_hot_keys_are_dealt_to_parts(spark):
    from traitlab.llm.common import join_hot, written
    rows = spark.range(30000).selectExpr("CASE WHEN id < 20000 THEN 0 ELSE id % 5000 END AS k", "id")
    groups = written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 2"), "groups")
    got = join_hot(rows, groups, ["k"], "n")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in rows.join(groups, "k").collect())


def test_repeated_bytes_equal_rows_and_empty_table(spark):
    t = "".join(random.Random(1).choice("abcdefgh") for _ in range(400))
    df = spark.createDataFrame([(1, t), (1, t)], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup(df).collect()] == [400, 400]
    assert suffix_dedup(df.limit(0)).collect() == []


@pytest.mark.parametrize("subtree", [8, 1 << 18])
def test_hamming_links_of_crowded_subtrees(spark, subtree):
    """A third of the fingerprints share their first 40 bits: nodes above the
    limit are split, and the links connect what brute force connects."""
    rng = np.random.default_rng(subtree)
    fps = set(rng.integers(0, 1 << 63, 60, np.uint64).tolist())
    for centre in (0xF123456789ABCDEF, 0x0F0F0F0F0F0F0F0F):
        for _ in range(60):
            fps.add(centre ^ sum(1 << int(b) for b in rng.choice(24, rng.integers(0, 5), replace=False)))
    fps |= {x ^ (1 << 62) for x in list(fps)[:20]} | {0, (1 << 64) - 1, (1 << 64) - 2, 1 << 63}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = [(r.a, r.b) for r in hamming_links(df, 3, subtree).collect()]
    plain = [(x, y) for i, x in enumerate(fps) for y in fps[:i] if (x ^ y).bit_count() <= 3]
    wide = [(a % (1 << 64), b % (1 << 64)) for a, b in links]
    assert all((a ^ b).bit_count() <= 3 for a, b in wide)
    assert groups(fps, wide) == groups(fps, plain)
    top = max(4, (len(fps) // subtree).bit_length())
    base, leaves = large_nodes(df, top, subtree)
    assert bool(base) == (subtree < 60)
    for start, depth in leaves:
        assert sum(x >> (64 - depth) == start >> (64 - depth) for x in fps) <= subtree or depth == 64
