"""Line dedup: repeated runs of lines, later copies deleted (native).

Every document is the sequence of its non-blank lines (split at ``\\n``,
trimmed); a line's id is a pair of 64-bit hashes of its trimmed text.  The
suffixes of all sequences are sorted by distributed prefix doubling: the
name of a position at depth 1 is its line's smallest position in the corpus;
the name at depth 2d is the smallest position whose pair (name at depth d
here, name at depth d, d lines on) is the same.  Positions with one name at
depth d are an interval of the suffix array whose longest common prefix is
at least d lines.  A position whose name occurs once leaves the work: no
longer run through it can repeat.  Rounds stop at depth ``min_lines``
(depths between powers of two overlap two names).

A maximal repeated run of at least ``min_lines`` lines is the union of the
``min_lines``-line runs in it, so a line is deleted exactly if some repeated
run of ``min_lines`` lines covers it and starts after that run's first start
in (doc_id, line) order.  Blank lines stay where they are.

With ``min_words``, repeated runs of fewer lines count too if their lines
have at least that many words (runs of anything but ASCII white space)
together, so one long line or a document of one line is a run as well.  Then
every depth below ``min_lines`` is visited, one line deeper at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, join_hot, let, written

TRIM = " \t\r\x0b\x0c"


def line_positions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, seq, line, h1, h2, words)``: one row per non-blank line;
    ``seq`` counts non-blank lines of the document, ``line`` all of them."""
    trimmed = F.transform(F.split(F.col(text_col), "\n", -1), lambda x: F.btrim(x, F.lit(TRIM)))
    marks = F.filter(
        F.transform(trimmed, lambda x, i: F.struct(i.alias("line"), F.length(x).alias("len"),
                                                   F.xxhash64(x).alias("h1"),
                                                   F.xxhash64(F.lit(1), x, F.lit(2)).alias("h2"),
                                                   F.size(F.split(x, SPACE)).cast("long").alias("words"))),
        lambda s: s["len"] > 0)
    rows = docs.select(F.col(id_col).alias("doc"), F.posexplode(marks).alias("seq", "m"))
    return rows.where("doc IS NOT NULL").select("doc", "seq", "m.line", "m.h1", "m.h2", "m.words")


def _named(pos: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Positions whose key occurs more than once, with the group's smallest
    position as name (``n_doc``, ``n_seq``); the rows of a frequent key (a
    line that many documents share) are dealt to several tasks."""
    groups = (pos.groupBy(*keys)
              .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "seq")).alias("first"))
              .where("n > 1").select(*keys, "n", F.col("first.doc").alias("n_doc"), F.col("first.seq").alias("n_seq")))
    return join_hot(pos, written(groups, "names"), keys, "n").select("doc", "seq", *keep, "n_doc", "n_seq")


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_lines: int = 2, min_words: int | None = None) -> DataFrame:
    """``(doc, seq)`` of every line that a later copy of a repeated run of at
    least ``min_lines`` lines, or of at least ``min_words`` words, covers."""
    if min_lines < 1:
        raise ValueError("min_lines must be at least 1")

    def covered(runs: DataFrame, depth: int) -> DataFrame:
        later = runs.where("doc <> n_doc OR seq <> n_seq")
        return later.select("doc", F.explode(F.sequence(F.col("seq"), F.col("seq") + (depth - 1))).alias("seq"))

    positions = line_positions(docs, id_col, text_col)
    if min_words is None:
        keep = ["line"]
        positions = positions.drop("words")
    else:  # words of the line, and of the run from it
        keep = ["words", "run_words"]
        positions = positions.withColumn("run_words", F.col("words")).drop("line")
    named = _named(positions, ["h1", "h2"], keep)
    depth, gone = 1, []
    while depth < min_lines:
        if min_words is None:
            step = min(depth, min_lines - depth)
        else:
            gone.append(covered(named.where(F.col("run_words") >= min_words), depth))
            step = 1
        ahead = named.select("doc", (F.col("seq") - step).alias("seq"), F.col("n_doc").alias("a_doc"),
                             F.col("n_seq").alias("a_seq"), *[F.col(c).alias(f"a_{c}") for c in keep[1:]])
        pairs = named.join(ahead, ["doc", "seq"]).withColumnsRenamed({"n_doc": "b_doc", "n_seq": "b_seq"})
        if min_words is not None:
            pairs = pairs.withColumn("run_words", F.col("words") + F.col("a_run_words"))
        named = _named(pairs, ["b_doc", "b_seq", "a_doc", "a_seq"], keep)
        depth += step
    out = covered(named, min_lines)
    for g in gone:
        out = out.union(g)
    return out.distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2,
               min_words: int | None = None) -> DataFrame:
    """``docs`` with the later copies of repeated line runs cut out of the
    text, plus ``n_lines_removed`` (long).

    All rows and columns stay (a document all of whose lines go keeps an
    empty text).  A null or empty text is unchanged with 0 lines removed; a
    null id is never compared.  Rows that share an id are one document each
    only if ids are unique, as ``doc_id`` is; an empty table gives none.
    """
    gone = (later_copies(docs, id_col, text_col, min_lines, min_words)
            .groupBy("doc").agg(F.sort_array(F.collect_list("seq")).alias("__gone")))
    out = docs.join(gone.withColumnRenamed("doc", "__doc"), F.col(id_col) == F.col("__doc"), "left").drop("__doc")
    return (out.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(_without(text_col)))
            .withColumn("n_lines_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long")).drop("__gone"))


def _without(text_col: str):
    """The text's lines but those whose count among non-blank lines is in
    ``__gone`` (sorted): the kept slices between the deleted lines, joined."""
    def holes(lines):  # line numbers of the deleted lines
        at = F.filter(F.transform(lines, lambda x, i: F.when(F.length(F.btrim(x, F.lit(TRIM))) > 0, i)),
                      lambda i: i.isNotNull())
        return F.struct(lines.alias("lines"),
                        let(at, lambda a: F.transform(F.col("__gone"), lambda g: F.get(a, g))).alias("holes"))

    def cut(s):
        starts = F.concat(F.array(F.lit(0)), F.transform(s["holes"], lambda h: h + 1))
        ends = F.concat(s["holes"], F.array(F.size(s["lines"])))
        spans = F.filter(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda z: z["e"] > z["s"])
        parts = F.transform(spans, lambda z: F.slice(s["lines"], z["s"] + 1, z["e"] - z["s"]))
        return F.array_join(F.flatten(parts), "\n")

    return let(let(F.split(F.col(text_col), "\n", -1), holes), cut)
