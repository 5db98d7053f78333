"""Line dedup and quality rules: against plain Python and the oracle SQL."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from traitlab.llm import queries as Q
from traitlab.llm.line_dedup import line_dedup
from traitlab.llm.quality_rules import quality_rules

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def later_copies(rows, k):
    """{doc: text without the later copies of repeated k-line runs}."""
    seqs = {i: [(n, x.strip(" \t\r\x0b\x0c")) for n, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c")]
            for i, t in rows if i is not None and t is not None}
    first, gone = {}, set()
    for i in sorted(seqs):
        s = seqs[i]
        for a in range(len(s) - k + 1):
            run = tuple(x for _, x in s[a:a + k])
            if first.setdefault(run, (i, a)) != (i, a):
                gone |= {(i, s[a + j][0]) for j in range(k)}
    return {i: (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)) for i, t in rows}


ROWS = [(1, "a\nb\nc\n\nd"), (2, "x\na\n b \nc\ny"), (3, "b\nc\nd\ne"), (4, "q\nq\nq\nq"), (5, None), (6, ""), (7, "\n\n \n"),
        (8, "a\nb"), (9, "long " * 20000 + "\nz"), (10, "é\nü\né\nü\né"), (None, "a\nb\nc"), (11, "c\n\n\nd\ntail")]


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_line_dedup_against_plain_python(spark, k):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines_removed) for r in line_dedup(df, min_lines=k).collect()}
    want = later_copies(ROWS, k)
    assert {i: t for i, (t, _) in got.items()} == want
    for i, t in ROWS:
        assert got[i][1] == (0 if t is None else t.count("\n") + 1 - (0 if want[i] == "" and got[i][1] else want[i].count("\n") + 1))


def test_line_dedup_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, seq int, line string, h1 int, n long, doc string")
    out = line_dedup(df)
    assert out.collect() == [] and out.columns[:7] == df.columns
    df = spark.createDataFrame([(1, "a\nb", 7, "l", 1, 2, "d"), (2, "a\nb", 8, None, 1, 2, "e")], df.schema)
    got = {r.doc_id: r for r in line_dedup(df).collect()}
    assert got[1].text == "a\nb" and got[2].text == "" and got[2].seq == 8 and got[2].doc == "e"


def plain_with_words(rows, k, words):
    """``later_copies`` for runs of ``k`` lines, or of fewer with ``words`` words."""
    seqs = {i: [(n, x.strip(" \t\r\x0b\x0c")) for n, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c")]
            for i, t in rows if i is not None and t is not None}
    gone = set()
    for d in range(1, k + 1):
        first = {}
        for i in sorted(seqs):
            for a in range(len(seqs[i]) - d + 1):
                run = tuple(x for _, x in seqs[i][a:a + d])
                if first.setdefault(run, (i, a)) != (i, a) and (d == k or sum(len(x.split()) for x in run) >= words):
                    gone |= {(i, seqs[i][a + j][0]) for j in range(d)}
    return {i: (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)) for i, t in rows}


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_line_dedup_of_long_lines_against_plain_python(spark, k):
    line = " ".join(f"w{i}" for i in range(24))
    rows = ROWS + [(20, line), (21, line), (22, f"x1\n  {line}\t\ny1"), (23, "one two three\nfour five six"),
                   (24, "p\none two three\nfour five six\nq"), (25, "one two three\nr"), (26, "two words"), (27, "two words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for words in (5, 20):
        got = {r.doc_id: r.text for r in line_dedup(df, min_lines=k, min_words=words).collect()}
        assert got == plain_with_words(rows, k, words)
        assert got[20] == line and got[21] == "" and got[22] == "x1\ny1"


def test_pipeline_stage_cuts_copies_of_one_long_line(spark):
    import corpus_pipeline
    line = " ".join(f"w{i}" for i in range(20))
    rows = [(1, line, "en", "s", len(line)), (2, line, "en", "s", len(line)), (3, "short line", "en", "s", 10), (4, "short line", "en", "s", 10)]
    out = corpus_pipeline.line_dedup_stage(spark, spark.createDataFrame(rows, DOCS), SF)
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect()) == [
        (1, line, len(line)), (2, "", 0), (3, "short line", 10), (4, "short line", 10)]


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_rules_base_counts(spark):
    texts = [None, "", " \t\n", "one two", "a b c d e " * 4, "x\ny\nx\n \nx", "Ünï çode 🙂 words | and # marks & <b>",
             "a b c d e f a b c d e g a b c d", "w" * 50_000, "\x0b\x0cq\x1cq\x85 \xa0z", ("same " * 9 + "\n") * 30]
    rows = [(i, t, None if i % 3 else "en", "s" if i % 2 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, b = got[i], base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b, (i, t)
        assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0])
        assert not (r.base_failed and r.kept)


def test_quality_rules_thresholds_follow_the_group(spark):
    # symbols are usual in one source and rare in the other
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(i, f"{text} n{i}", "en", "plain") for i in range(40)] + [(100 + i, f"{text} # | & n{i}", "en", "marked") for i in range(40)]
    rows += [(900, f"{text} # | &", "en", "plain"), (901, f"{text} # | &", "en", "marked")]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[900].kept and got[900].failed == "symbols" and got[901].kept
    assert all(got[i].kept for i in range(40))


def test_quality_rules_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("name", ["op1_embedding_dedup", "op2_line_dedup", "op10_quality_rules"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = Q.QUERIES[name](spark, SF)
    rel = con.sql(Q.ORACLES[name])
    assert sdf.columns == rel.columns
    assert sorted(map(tuple, sdf.collect()), key=str) == sorted(rel.fetchall(), key=str)


def test_native_plans_have_no_python(spark):
    for name in ("op2_line_dedup", "op10_quality_rules"):
        plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
    assert F is not None
