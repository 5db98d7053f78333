"""Classifiers (held-out accuracy), BPE (exact round trip), extraction, packing
and the pipeline."""

import hashlib
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
import public_tokenizers
import pytest
import tiktoken

from traitlab.llm import bpe, packing, toxicity
from traitlab.llm.html_text import content, extract
from traitlab.llm.labelled import logistic_line
from traitlab.llm.packing import best_fit, pack
from traitlab.llm.quality_model import BUCKETS, Grams, Scaled, dual_descent, packed, quality_scores, unpacked

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF1 = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def reference():
    r = bpe.ranks(PATH)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=r.ids, special_tokens={})


def test_bpe_equals_the_library_however_chunked(reference):
    rng, r = random.Random(3), bpe.ranks(PATH)
    parts = [" ", "  ", "\n", "\t", "'s", "'ll", "'", "a", "bc", "Z", "é", "ß", "中", "1", "23", "½", "!", "--", "\x85", "\xa0",
             " ", "\x1c", "​", "🙂", "é", "Ⅷ", "\r\n", "the ", " of", "﻿", "　", "<|endoftext|>"]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        want = reference.encode_ordinary(t)
        for chunk, overlap in ((1 << 15, 256), (16, 6), (7, 3)):
            ids = r.encode(t, public_tokenizers.PATTERN, chunk, overlap)
            assert np.frombuffer(ids, "<u4").tolist() == want
        assert r.decode(ids) == t.encode()
    for t in ("a" * 5000, "the " * 5000, " " * 3000 + "x", "\n" * 1000):
        assert np.frombuffer(r.encode(t, public_tokenizers.PATTERN, 1000, 50), "<u4").tolist() == reference.encode_ordinary(t)


def test_bpe_query_on_whole_documents(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(10 ** 6, None), (10 ** 6, ""), (None, "null id"), (10 ** 6 + 1, "x" * 100_000)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(extra)
    enc = bpe.encode(rows, PATH, public_tokenizers.PATTERN)
    got = sorted((str(r.doc_id), r.n_tokens, hashlib.sha256(r.ids).hexdigest(), bytes(r.decoded)) for r in bpe.decode(enc, PATH).collect())
    want = []
    for d, t in rows.collect():
        ids = reference.encode_ordinary(t or "")
        want.append((str(d), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), (t or "").encode()))
    assert got == sorted(want)
    assert bpe.encode(rows.limit(0), PATH, public_tokenizers.PATTERN).collect() == []


def scored(spark, run, label):
    docs, labels = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in run(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [(got[r.doc_id].score, r[label]) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out and r[label] is not None]
    s, y = np.array([a for a, _ in held]), np.array([b for _, b in held])
    rank = np.argsort(np.argsort(s)) + 1
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p)), ((s >= 0.7) == y).mean()


def test_quality_on_held_out_rows(spark):
    auc, right = scored(spark, quality_scores, "quality")
    assert auc > 0.99 and right > 0.97


def test_toxicity_on_held_out_rows(spark):
    auc, right = scored(spark, toxicity.toxicity_scores, "toxic")
    assert auc > 0.9 and right > 0.94


EDGES = [(1, None), (2, ""), (3, " \n"), (4, "w" * 200_000), (5, "a b " * 30_000), (None, "null id"), (5, "again"), (6, "\x00퟿")]


def test_packed_sets_are_bounded_and_come_back():
    rng = np.random.default_rng(3)
    ratio = rng.normal(size=BUCKETS)
    for n in (0, 1, 4095, 4096, 4097, 60_000, BUCKETS):
        grams = np.sort(rng.choice(BUCKETS, n, replace=False))
        raw = packed(grams)
        assert len(raw) <= BUCKETS // 8 and unpacked(raw).tolist() == grams.tolist()
        at, v = Scaled([raw], ratio)[0]
        assert at.tolist() == grams.tolist() and (not n or abs(float(v @ v) - 1) < 1e-3)


def test_packed_sets_take_a_byte_or_two_a_bucket():
    rng = np.random.default_rng(5)
    for n in (600, 1500, 6000, 15000):
        grams = np.sort(rng.choice(BUCKETS, n, replace=False))
        raw = packed(grams)
        assert len(raw) <= n + BUCKETS // 255 < 2 * n and unpacked(raw).tolist() == grams.tolist()
    for edge in ([0], [254], [255], [0, 255, 510, 511], [0, BUCKETS - 1], list(range(BUCKETS // 8 - 1))):
        assert unpacked(packed(np.array(edge))).tolist() == edge


@pytest.mark.parametrize("run", [quality_scores, toxicity.toxicity_scores])
def test_scores_of_edge_rows_and_poor_labels(spark, run):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in EDGES], "doc_id long, text string, score string, y int")
    for labels in ([], [(2, 1, 1)], [(2, 1, 0), (3, 0, 1), (4, None, None), (99, 1, 1), (5, 2, 7), (5, 0, 0), (6, 1, 1)]):
        got = run(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        assert len(got) == len(EDGES) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
        assert all(r.held_out is False for r in got if r.doc_id is None)
    assert run(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for i in range(200):
        c = i % 2
        idx = np.unique(np.concatenate((rng.integers(0, 50, 5) + 100 * c, rng.integers(1000, 1100, 5))))
        rows.append((idx, np.ones(len(idx)) / np.sqrt(len(idx))))
        y.append(1.0 if c else -1.0)
    w, b = dual_descent(rows, np.array(y), np.full(200, 1.0))
    assert w.shape == (BUCKETS,) and all(y[i] * (w[r[0]] @ r[1] + b) > 0 for i, r in enumerate(rows))
    g = Grams()
    assert len(g.of(b"")) == 0 and set(g.of(b"ab ab")) > set(g.of(b"ab"))


def test_logistic_line_on_separable_margins():
    m = np.concatenate((np.full(50, -1.0), np.full(10, 1.0)))
    y = np.concatenate((np.zeros(50, int), np.ones(10, int)))
    a, b = logistic_line(m, y, np.ones(60))
    p = 1 / (1 + np.exp(-(a * m + b)))
    assert np.isfinite([a, b]).all() and p[:50].max() < 0.1 and p[50:].min() > 0.8


def test_network_gradients():
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items() if k not in ("word", "char")}
    rng = np.random.default_rng(0)
    g, real, y = rng.standard_normal((6, 4, 6 * toxicity.HIDDEN)), np.ones((6, 4)), np.array([1, 0, 1, 0.0])
    real[4:, 1] = real[2:, 3] = 0

    def loss():
        z = net.forward(g, real)
        return float((np.logaddexp(0, z) - y * z).sum())

    z, kept = net.forward(g, real, keep=True)
    grads, dg = net.backward(1 / (1 + np.exp(-z)) - y, real, kept)
    for array, grad, at in [(net.p[k].reshape(-1), grads[k].reshape(-1), 0) for k in ("out", "shift", "pick", "att", "rec")] + [
            (g.reshape(-1), dg.reshape(-1), 77)]:
        old, e = array[at], 1e-3
        array[at] = old + e
        up = loss()
        array[at] = old - e
        down = loss()
        array[at] = old
        assert abs((up - down) / (2 * e) - grad[at]) < 1e-4


def test_windows_cover_every_word():
    for n in list(range(0, 200)) + [5000]:
        first = toxicity.windows_of(n)
        assert first[0] == 0 and first[-1] + toxicity.WINDOW >= n and (np.diff(first) == toxicity.STRIDE).all()


def test_a_passage_lies_whole_in_a_window_at_every_offset():
    most = toxicity.WINDOW - toxicity.STRIDE + 1
    for n in (most, 60, 200):
        first = toxicity.windows_of(n)
        for at in range(n - most + 1):
            assert ((first <= at) & (at + most <= first + toxicity.WINDOW)).any()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy now.</div>
<article><h1>A title</h1><p><b>First para, with
 text &amp; more.<br><p>Second para, it is <i>he</i>re.</p><aside>Side, note.</aside><div class="comments"><p>Nice, thanks.</p></div>
</article><footer>&copy; site, 2020.</footer>"""


def test_html_main_text():
    want = "A title\nFirst para, with text & more.\nSecond para, it is here."
    assert content(PAGE) == want
    for wrap in ('<div id="content">%s</div>', '<main>%s</main>', '<div><div class="post-body">%s</div></div>'):
        page = PAGE.replace("<article>", wrap.partition("%s")[0]).replace("</article>", wrap.partition("%s")[2])
        assert content(page) == want, wrap
    assert content(None) == content("") == content("<p> </p><script>x") == ""
    assert content("only text, no tags.") == "only text, no tags." and content("<p>a<p>b &lt;c") == "a\nb <c"


def prose(n, word):
    return " ".join(f"The {word} number {i}, as told before, is a long one." for i in range(n))


def shell(inner):
    links = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(6))
    return (f"<html><body><nav><ul>{links}</ul></nav><div class='ad'>{prose(9, 'ad')}</div>{inner}"
            f"<div class='x9'><ul>{links}</ul></div><footer>{prose(3, 'foot')}</footer></body></html>")


def test_html_articles_of_different_paths():
    page = shell(f"<article class='lead'><h1>One</h1><p>{prose(80, 'lead')}</p><p>Short.</p></article>"
                 f"<article class='brief'><h2>Two</h2><p>{prose(16, 'brief')}</p><p>Brief.</p></article>")
    assert content(page) == "\n".join(["One", prose(80, "lead"), "Short.", "Two", prose(16, "brief"), "Brief."])


def test_html_lead_outside_the_body_div():
    for tag in ("article", "main", "div class='story'"):
        page = shell(f"<h1>Title</h1><div class='lead'><p>{prose(5, 'lead')}</p></div><{tag}><p>{prose(60, 'body')}</p>"
                     f"<h2>Part</h2><p>{prose(30, 'more')}</p><p>End.</p></{tag.split()[0]}>")
        assert content(page) == "\n".join(["Title", prose(5, "lead"), prose(60, "body"), "Part", prose(30, "more"), "End."])


def test_html_sections_without_article():
    parts = [f"<div class='s{i}'><h2>Part {i}</h2><p>{prose(4 + i, 'part')}</p><p>Note.</p></div>" for i in range(4)]
    want = [x for i in range(4) for x in (f"Part {i}", prose(4 + i, "part"), "Note.")]
    assert content(shell("".join(parts))) == "\n".join(want)
    assert content(shell("<section><h1>Top</h1>" + "".join(parts) + "</section>")) == "\n".join(["Top", *want])


def test_html_extract_rows(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (3, "u", "<p>x, y.</p>"), (None, "v", "<b>z"), (4, "w", "<p>" + "<b>q " * 3000)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = extract(df).collect()
    assert sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in got) == sorted(
        (str(i), str(u), content(h), len(content(h))) for i, u, h in rows)
    assert extract(df.limit(0)).collect() == []


def test_best_fit_takes_the_tightest_compatible_bin():
    for seed in range(6):
        rng = random.Random(seed)
        n = 400
        lengths = sorted((rng.randint(1, 100) for _ in range(n)), reverse=True)
        sources = [rng.choice([None, "hot", "hot", *"abcdefgh"]) for _ in range(n)]
        clusters = [rng.choice([None, *range(90)]) for _ in range(n)]
        got = best_fit(lengths, sources, clusters, 100)
        left, content_ = defaultdict(lambda: 100), defaultdict(list)
        for k, (b, size) in enumerate(zip(got, lengths)):  # each choice is a tightest one, given those before
            ok = [left[i] for i in content_ if left[i] >= size and all(
                (sources[j] is None or sources[j] != sources[k]) and (clusters[j] is None or clusters[j] != clusters[k]) for j in content_[i])]
            assert (left[b] == min(ok)) if ok else (b not in content_)
            left[b] -= size
            content_[b].append(k)
        assert len(content_) == max(got) + 1


def test_pack_places_every_token_once(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 90), f"s{rng.randint(0, 5)}" if i % 7 else None) for i in range(200)]
    rows += [(500, None, "s1"), (501, "", "s1"), (502, "w " * 1000, "s1"), (503, rows[3][1], "s9"), (503, rows[3][1], "s8")]
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, source string, n int, bin_id string")
    got = pack(df, capacity=100, shard=64).collect()
    bins, tokens = defaultdict(list), defaultdict(int)
    for r in got:
        bins[r.bin_id].append(r)
        tokens[r.doc_id] += r.n_tokens
    want = defaultdict(int)
    for i, t, _ in rows:
        want[i] += len((t or "").split())
    assert tokens == {i: n for i, n in want.items() if n}
    source = {i: s for i, _, s in rows if i != 503}
    for b in bins.values():
        assert sum(r.n_tokens for r in b) <= 100 and sorted(r.slot for r in b) == list(range(len(b)))
        named = [source[r.doc_id] for r in b if source.get(r.doc_id)]
        assert len(named) == len(set(named))
    assert pack(df.limit(0)).collect() == []


def check_bins(got, rows, capacity):
    """No bin too full, slots in order, every token of every row placed, no
    source or cluster twice in a bin."""
    bins, tokens = defaultdict(list), defaultdict(int)
    for r in got:
        bins[r.bin_id].append(r)
        tokens[r.doc_id] += r.n_tokens
    want = defaultdict(int)
    for i, t, _ in rows:
        want[i] += len((t or "").split())
    assert tokens == {i: n for i, n in want.items() if n}
    assert None not in bins
    for b in bins.values():
        assert sum(r.n_tokens for r in b) <= capacity and sorted(r.slot for r in b) == list(range(len(b)))
    return bins


def test_pack_repeated_rows_null_ids_and_shared_ids(spark):
    rows = [(1, "a " * 2050, "s"), (1, "a " * 2050, "s"), (None, "b " * 3000, "s"), (None, "b " * 3000, None), (2, "c " * 4096, "t"),
            (2, "d " * 4096, "t")] + [(7, "e f g", "u")] * 300 + [(i, "h " * i, "hot") for i in range(10, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("bin", F.lit("x"))
    bins = check_bins(pack(df, capacity=2048, shard=64).collect(), rows, 2048)
    assert all(len([r for r in b if r.doc_id == 7]) <= 1 for b in bins.values())  # copies are one cluster
    assert all(len([r for r in b if r.doc_id and r.doc_id >= 10]) <= 1 for b in bins.values())  # one source


def test_loose_bins_of_all_shards_are_packed_again(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, f"w{i} " * rng.randint(20, 70), f"s{rng.randint(0, 400)}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bins = check_bins(pack(df, capacity=100, shard=8).collect(), rows, 100)
    monkeypatch.setattr(packing, "LOOSE", 0)
    once = check_bins(pack(df, capacity=100, shard=8).collect(), rows, 100)
    source = {i: s for i, _, s in rows}
    assert all(len({source[r.doc_id] for r in b}) == len(b) for b in bins.values())
    assert len(bins) < 0.95 * len(once)


def test_best_fit_of_items_with_several_values():
    got = best_fit([60, 50, 40, 30, 10], [{"a", "b"}, {"c"}, {"b"}, {"d"}, None], [None, {1, 2}, {2}, None, {1}], 100)
    assert got == [0, 1, 2, 0, 0]


def test_pack_by_model_tokens(spark):
    import public_tokenizers

    from traitlab.llm.bpe import encode
    rows = [(i, "naïve words and 漢字 " * i, "s") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    ids = encode(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    got = pack(df.join(ids.select("doc_id", F.col("n_tokens").alias("n")), "doc_id"), length=F.col("n"), source=F.lit(None), capacity=128)
    want = {r.doc_id: r.n_tokens for r in ids.collect() if r.n_tokens}
    assert {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()} == want
    assert got.groupBy("bin_id").agg(F.sum("n_tokens").alias("n")).where("n > 128").count() == 0


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.01"
    docs = C.table(spark, sf, "documents")
    columns, names = docs.columns, [n for n, _ in C.STAGES]
    assert names == ["quality classifier", "line dedup", "SimHash near-dedup", "suffix-array dedup", "best-fit packing"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in C.STAGES[:-1]:
        docs = C.written(stage(spark, docs, sf), "stage")
        assert docs.columns == columns
        now = {r.doc_id: r.text for r in docs.collect()}
        assert set(now) <= set(texts)
        if name in ("quality classifier", "SimHash near-dedup"):
            assert len(now) < len(texts) and all(texts[i] == t for i, t in now.items())
        else:
            assert set(now) == set(texts) and sum(map(len, now.values())) < sum(map(len, texts.values()))
            from test_copies import plain_repeats
            from test_line_and_rules import plain_with_words
            if name == "line dedup":
                assert now == plain_with_words(list(texts.items()), 2, 20)
            else:
                want = plain_repeats(list(texts.items()), 200)
                assert all(len(now[i].encode()) <= want[i][0] - want[i][1] for i in now)
        texts = now
    got = C.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in got} == {i for i, t in texts.items() if t.split()}
    assert sorted(map(tuple, C.run(spark, sf).collect())) == sorted(map(tuple, got))


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.01"
    long_ = "line of a very long text, number one.\n" * 3000
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "one two three\nfour five", "en", "a"), (3, "one two three\nfour five", "en", "a"),
            (None, "some other words here", "en", "b"), (None, None, None, None), (4, long_, "en", "a")]
    df = spark.createDataFrame([(*r, len(r[1] or ""), 1, "x") for r in rows],
                               "doc_id long, text string, lang string, source string, n_chars int, seq int, core string")
    for name, stage in C.STAGES:
        out = stage(spark, df, sf)
        if name != "best-fit packing":
            assert out.columns == df.columns, name
        got = out.collect()
        if name in ("line dedup", "suffix-array dedup"):
            assert len(got) == len(rows), name
            assert sum(r.text is None for r in got) == (2 if name == "line dedup" else 0), name  # cut texts are never null
        empty = stage(spark, df.where("false"), sf)
        assert empty.collect() == [], name
