"""The registered queries of this package: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

from .common import table

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(id, c) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e JOIN m ON m.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


@query("op1_embedding_dedup", OP1_SQL)
def op1_embedding_dedup(spark, sf_dir):
    from .embedding_dedup import embedding_dedup
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


#: A line's id is its trimmed text; w is the run of two lines from it.
OP2_SQL = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
s AS (
  SELECT doc_id, pos, trim(line, E' \t\r\x0b\x0c') AS k,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq
  FROM raw WHERE trim(line, E' \t\r\x0b\x0c') <> ''),
w AS (
  SELECT doc_id, seq, k, lead(k) OVER (PARTITION BY doc_id ORDER BY seq) AS k2 FROM s),
f AS (
  SELECT doc_id, seq, row_number() OVER (PARTITION BY k, k2 ORDER BY doc_id, seq) AS nth FROM w WHERE k2 IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest([seq, seq + 1]) AS seq FROM f WHERE nth > 1),
gone AS (SELECT s.doc_id, s.pos FROM s JOIN g ON g.doc_id = s.doc_id AND g.seq = s.seq),
kept AS (
  SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.pos) AS text
  FROM raw r ANTI JOIN gone ON gone.doc_id = r.doc_id AND gone.pos = r.pos GROUP BY r.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, d.lang, d.source, d.n_chars,
       coalesce(n.n, 0) AS n_lines_removed
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query("op2_line_dedup", OP2_SQL)
def op2_line_dedup(spark, sf_dir):
    from .line_dedup import line_dedup
    return line_dedup(table(spark, sf_dir, "documents"))


#: Base counts, then quartile fences per (lang, source) over the documents that pass the base rule.
OP10_SQL = r"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_slice(w, i, i + 4)) AS n FROM p),
v AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS i FROM g WHERE n > 1),
r AS (SELECT doc_id, count(*) AS n FROM v GROUP BY doc_id),
c AS (
  SELECT w.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS n_upper
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
q AS (
  SELECT doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         n_symbols / greatest(n_words, 1)::DOUBLE AS a, n_dup_lines / greatest(n_lines, 1)::DOUBLE AS b,
         n_repeat_words / greatest(n_words, 1)::DOUBLE AS d, word_chars / greatest(n_words, 1)::DOUBLE AS e,
         n_upper / greatest(word_chars, 1)::DOUBLE AS f FROM c),
k AS (
  SELECT lang, source,
         quantile_disc(a, [0.25, 0.5, 0.75]) AS a, quantile_disc(b, [0.25, 0.5, 0.75]) AS b,
         quantile_disc(d, [0.25, 0.5, 0.75]) AS d, quantile_disc(e, [0.25, 0.5, 0.75]) AS e,
         quantile_disc(f, [0.25, 0.5, 0.75]) AS f
  FROM q WHERE NOT base_failed GROUP BY lang, source),
x AS (
  SELECT q.*, list_filter([
      CASE WHEN q.a > k.a[2] + 6.0 * greatest(k.a[3] - k.a[2], 0.02) THEN 'symbols' END,
      CASE WHEN q.b > k.b[2] + 6.0 * greatest(k.b[3] - k.b[2], 0.05) THEN 'dup_lines' END,
      CASE WHEN q.d > k.d[2] + 6.0 * greatest(k.d[3] - k.d[2], 0.02) THEN 'repeat' END,
      CASE WHEN q.e < k.e[2] - 6.0 * greatest(k.e[2] - k.e[1], 0.5)
             OR q.e > k.e[2] + 6.0 * greatest(k.e[3] - k.e[2], 0.5) THEN 'word_chars' END,
      CASE WHEN q.f > k.f[2] + 6.0 * greatest(k.f[3] - k.f[2], 0.05) THEN 'upper' END],
      lambda z: z IS NOT NULL) AS bad
  FROM q LEFT JOIN k ON k.lang IS NOT DISTINCT FROM q.lang AND k.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND len(bad) = 0 AS kept, coalesce(array_to_string(bad, ','), '') AS failed
FROM x
"""


@query("op10_quality_rules", OP10_SQL)
def op10_quality_rules(spark, sf_dir):
    from .quality_rules import quality_rules
    return quality_rules(table(spark, sf_dir, "documents"))


@query("op5_simhash_dedup")
def op5_simhash_dedup(spark, sf_dir):
    from .simhash_dedup import simhash_dedup
    return simhash_dedup(table(spark, sf_dir, "documents"), shingle=3, budget=3)


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark, sf_dir):
    from pyspark.sql import functions as F

    from .suffix_dedup import suffix_dedup
    cut = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query("op6_byte_bpe")
def op6_byte_bpe(spark, sf_dir):
    import public_tokenizers
    from pyspark.sql import functions as F

    from .bpe import decode, encode
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return decode(ids, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                                    F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op8_html_extraction")
def op8_html_extraction(spark, sf_dir):
    from .html_text import extract
    return extract(table(spark, sf_dir, "pages"))


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark, sf_dir):
    from .packing import pack
    return pack(table(spark, sf_dir, "documents"))


@query("op7_quality_model")
def op7_quality_model(spark, sf_dir):
    from .quality_model import quality_scores
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    from .toxicity import toxicity_scores
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op11_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain rounds: every part against every entry of its codebook."""
    near = """a{r} AS MATERIALIZED (
  SELECT vec_id, part, p, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT s.vec_id, s.part, s.p, b.entry,
           list_sum(list_transform(range(1, len(s.p) + 1), lambda i: (s.p[i] - b.e[i]) * (s.p[i] - b.e[i])))::BIGINT AS d
    FROM s JOIN b{r} b ON b.part = s.part) GROUP BY vec_id, part, p)"""
    step = """m{r} AS (
  SELECT part, entry, list(z ORDER BY nth) AS e FROM (
    SELECT part, entry, nth, CAST(floor(sum(x) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS z
    FROM (SELECT part, entry, unnest(p) AS x, unnest(range(len(p))) AS nth FROM a{r}) GROUP BY part, entry, nth)
  GROUP BY part, entry),
b{n} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.entry = b.entry)"""
    ctes = [f"""v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT vec_id, k.part, list_slice(v, k.part * (len(v) // {parts}) + 1, (k.part + 1) * (len(v) // {parts})) AS p
  FROM v CROSS JOIN (SELECT unnest(range({parts})) AS part) k),
b0 AS MATERIALIZED (
  SELECT s.part, f.entry, s.p AS e FROM s JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries}) f
  ON f.vec_id = s.vec_id)"""]
    for r in range(rounds):
        ctes += [near.format(r=r), step.format(r=r, n=r + 1)]
    ctes.append(near.format(r=rounds))
    return "WITH " + ",\n".join(ctes) + f""",
c AS (
  SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id),
w AS (SELECT v.label, c.* FROM c JOIN v ON v.vec_id = c.vec_id),
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS h FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM w CROSS JOIN h
"""


@query("op11_vector_codes", _op11_sql())
def op11_vector_codes(spark, sf_dir):
    import hashlib

    from pyspark.sql import functions as F

    from .vector_codes import compress
    codes, books = compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    text = ",".join(str(x) for book in books for entry in book.tolist() for x in entry)
    return codes.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
                        F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


@query("op12_piece_bpe")
def op12_piece_bpe(spark, sf_dir):
    import public_tokenizers
    from pyspark.sql import functions as F

    from .piece_bpe import encode
    ids = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


OP13_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id, score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) <= 3
"""


@query("op13_hard_negatives", OP13_SQL)
def op13_hard_negatives(spark, sf_dir):
    from pyspark.sql import functions as F

    from .hard_negatives import hard_negatives
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), positives=5, negatives=3, low=50, high=95, every=50, scale=256.0)


def registered() -> dict:
    """The queries by name, and ``pipeline`` from corpus_pipeline.py."""
    import corpus_pipeline
    if corpus_pipeline.ORACLE_SQL is not None:
        ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**QUERIES, "pipeline": corpus_pipeline.run}
