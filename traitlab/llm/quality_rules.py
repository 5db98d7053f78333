"""Quality rules with adaptive thresholds (native).

Base counts come from each whole text with array functions, inside the row:
nothing is exploded or shuffled but one short row of ratios per document.
Thresholds are not fixed: for every (lang, source) group and every ratio,
Spark's mergeable quantile summary (``percentile_approx``) gives the
quartiles, partial summaries being merged across tasks, so a source with a
third of all rows costs one summary.  A document fails if a ratio lies
beyond its group's fence, the quartile plus ``FENCE`` times the distance from
the median to it (at least ``SPREAD`` of that ratio, so that a group in which
a ratio is constant does not reject its smallest deviation).  The thresholds,
one row per group, are joined back to the ratios null-safely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, written

#: Characters counted as symbols (fixed value of the contract).
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
FENCE = 6.0
ACCURACY = 10_000
#: ratio -> (tail: +1 high, -1 low, 0 both; least spread)
RATIOS = {"r_symbols": (1, 0.02), "r_dup_lines": (1, 0.05), "r_repeat": (1, 0.02),
          "r_word_chars": (0, 0.5), "r_upper": (1, 0.05)}


def words(text: Column) -> Column:
    """Runs of non-white-space; a split leaves at most an empty first and last part."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _starts_of_repeats(h: Column) -> Column:
    """Sorted positions in ``h`` whose value occurs more than once."""
    def marked(tagged):
        def mark(s, k):  # a position outside the array gives null, which equals nothing
            same = (F.get(tagged, k - 1)["x"] == s["x"], F.get(tagged, k + 1)["x"] == s["x"])
            return F.when(F.coalesce(same[0], F.lit(False)) | F.coalesce(same[1], F.lit(False)), s["i"])
        return F.transform(tagged, mark)

    tagged = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.sort_array(F.array_compact(let(tagged, marked)))


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple = ()) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words`` (long) per row, the columns named in ``carry`` and
    ``n_lines``, ``n_upper`` for the ratios.  A null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"__{c}") for c in carry], text.alias("__t"))
    d = d.withColumn("__w", words(F.col("__t")))
    d = d.withColumn("__h", F.when(F.size("__w") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size("__w") - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("__w"), i + j) for j in range(WINDOW)]))).otherwise(F.expr("array()").cast("array<bigint>")))
    d = d.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), _starts_of_repeats(F.col("__h")))
                     .otherwise(F.expr("array()").cast("array<int>")))
    # each repeated window covers up to the next one's start, the last one all of itself
    covered = F.aggregate(F.col("__s"), F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
                          lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"), i.alias("at")),
                          lambda a: a["n"])
    lines = F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("__l", lines)
    return d.select(
        "doc_id", *[F.col(f"__{c}") for c in carry],
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("__n_lines"),
        F.regexp_count("__t", F.lit("[A-Z]")).cast("long").alias("__n_upper"))


def thresholds(rated: DataFrame, keys: list[str]) -> DataFrame:
    """Fences ``lo_<ratio>`` / ``hi_<ratio>`` per group from merged sketches."""
    q = rated.groupBy(*keys).agg(*[
        F.percentile_approx(r, [0.25, 0.5, 0.75], ACCURACY).alias(f"q_{r}") for r in RATIOS])
    out = [F.col(k) for k in keys]
    for r, (tail, spread) in RATIOS.items():
        a, m, b = (F.get(f"q_{r}", F.lit(i)) for i in range(3))
        out.append((m - FENCE * F.greatest(m - a, F.lit(spread)) if tail <= 0 else F.lit(None).cast("double")).alias(f"lo_{r}"))
        out.append((m + FENCE * F.greatest(b - m, F.lit(spread)) if tail >= 0 else F.lit(None).cast("double")).alias(f"hi_{r}"))
    return q.select(*out)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: ``doc_id``, the base counts, ``base_failed``,
    ``kept`` and ``failed`` (names of the ratios beyond their fence).

    ``base_failed`` is n_words < 10 or 100 * n_repeat_words > 20 * n_words.
    Sketches are of the documents that pass the base rule; a null lang or
    source is a group of its own.  Repeated rows give repeated results; an
    empty table an empty one; a null text fails the base rule.
    """
    c = base_counts(docs, id_col, text_col, (lang_col, source_col))
    lang, source = f"__{lang_col}", f"__{source_col}"
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    c = (c.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
         .withColumn("r_symbols", F.col("n_symbols") / n)
         .withColumn("r_dup_lines", F.col("n_dup_lines") / F.greatest(F.col("__n_lines"), F.lit(1)))
         .withColumn("r_repeat", F.col("n_repeat_words") / n)
         .withColumn("r_word_chars", F.col("word_chars") / n)
         .withColumn("r_upper", F.col("__n_upper") / F.greatest(F.col("word_chars"), F.lit(1))))
    c = written(c, "counts")  # read twice: by the sketches and by the filter
    t = thresholds(c.where(~F.col("base_failed")), [lang, source])
    t = t.withColumnsRenamed({lang: "t_lang", source: "t_source"})
    out = c.join(t, F.col(lang).eqNullSafe(F.col("t_lang")) & F.col(source).eqNullSafe(F.col("t_source")), "left")
    bad = [F.when(F.coalesce((F.col(r) < F.col(f"lo_{r}")) | (F.col(r) > F.col(f"hi_{r}")), F.lit(False)), F.lit(r[2:]))
           for r in RATIOS]
    return (out.withColumn("failed", F.array_compact(F.array(*bad)))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"),
                    F.array_join("failed", ",").alias("failed")))
