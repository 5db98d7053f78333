"""Exact ranks and quantiles that stay parallel inside one large group.

A window ``PARTITION BY g ORDER BY v`` sends a whole group to one task; a
draws table has few parameters and very many draws, so one group may hold a
third of all rows.  There is one path for every size:

``group_quantiles`` brackets and refines.  A mergeable sketch per group gives,
for each probability, two values that are sure to lie around the wanted
order statistic (the sketch's rank error is bounded).  The second pass
aggregates: rows outside all brackets become one count per gap between them,
rows inside are counted per value, both with map-side combine.  A running sum
over what is left (a few ten-thousandths of the rows) finds the exact
positions.  No row is sorted, stored or shuffled for its rank.  Where that
could still be more than ``MOST_CELLS`` rows of a group, the brackets are
narrowed first, in rounds that only count.

``rank_within`` ranks every row it is given, for statistics that need ranks
(draw numbers; ``tails`` cuts out the two ends of each group that a shortest
interval needs).  The sketch's cut points split each larger group into buckets of about ``BUCKET_ROWS`` rows; a window per (group, bucket) ranks rows
locally, and bucket sizes are prefix-summed into offsets.  The sketch only
balances: exactness comes from the counts.  A value so frequent that several
cut points coincide on it is split further by the first tiebreak column.

What is known per group (counts, sketches) is written before the rows meet
it, so that its size is known: few groups are broadcast, and no task gets all
rows of one by its key.

Groups are compared as structs of their keys, in which NULL equals NULL: rows
with NULL keys are a group like any other, NULL order values come first.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

# Rows of a bucket that one task ranks, about, and the most buckets a sketch
# splits a group into (where the plan may hold more than BUCKET_ROWS * CUTS
# rows, buckets above twice that size are split again).
BUCKET_ROWS = 1_000_000
CUTS = 512
# Sketch accuracy: a rank is off by at most n / ACCURACY; brackets reach
# MARGIN such steps to either side.
ACCURACY = 10_000
MARGIN = 3
# Rows of a group between the brackets' ends that one task sorts at most, and
# the ranges a bracket is cut into while it holds more.
MOST_CELLS = 1_000_000
SPLITS = 1024


def _order_key(df: DataFrame, col: str) -> Column:
    """Numeric key, monotone in ``col`` (strings: first 7 UTF-8 bytes; equal
    keys only share a bucket, the window orders by the column itself)."""
    dt = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dt, T.StringType):
        hexed = F.rpad(F.substring(F.hex(F.encode(c, "UTF-8")), 1, 14), 14, "0")
        return F.conv(hexed, 16, 10).cast("long")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(c.cast("timestamp")) if not isinstance(dt, T.DateType) \
            else F.unix_date(c).cast("long")
    if isinstance(dt, T.BooleanType):
        return c.cast("int")
    return c


def _group(keys: Sequence[str]) -> Column:
    """A group's keys as one never-null value."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))


def rank_within(df: DataFrame, keys: Sequence[str], order: str,
                tiebreak: Iterable[str] = (), rank_col: str = "rn",
                count_col: str = "n", bucket_rows: int | None = None) -> DataFrame:
    """Add ``rank_col`` (row_number within ``keys`` ordered by ``order``,
    then ``tiebreak``) and ``count_col`` (group size), both long.

    Every row is kept, whatever is NULL in it; an empty table stays empty.
    """
    bucket_rows = BUCKET_ROWS if bucket_rows is None else bucket_rows
    tiebreak = list(tiebreak)
    order_by = [F.col(order).asc_nulls_first(), *[F.col(t).asc_nulls_first() for t in tiebreak]]
    tie = _order_key(df, tiebreak[0]) if tiebreak else F.lit(None).cast("long")
    keyed = df.withColumns({"_g": _group(keys), "_ok": _order_key(df, order), "_tk": tie})
    probs = ", ".join(f"{i / CUTS!r}D" for i in range(1, CUTS))  # one expression text: hundreds of literals are slow to send

    def cut_points(key: str) -> Column:
        return F.expr(f"percentile_approx({key}, array({probs}), {ACCURACY})")

    none = F.array().cast("array<double>")
    # each group uses as many of the cut points as its size asks for; groups
    # of one bucket need no sketch
    parts = F.least(F.lit(CUTS), F.ceil(F.col("_gn") / F.lit(float(bucket_rows)))).cast("int")

    def used(cuts: str) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.col("_parts") - 1),
                           lambda i: F.get(F.col(cuts), F.floor(i * CUTS / F.col("_parts")).cast("int") - 1).cast("double"))
        return F.coalesce(some, none)

    def small(table: DataFrame) -> DataFrame:  # without keys it is one row
        return table if keys else F.broadcast(table)

    counts = cut_lineage(keyed.groupBy("_g").agg(F.count(F.lit(1)).alias("_gn")), "group-counts")
    sketch = (keyed.join(small(counts.where(F.col("_gn") > bucket_rows)), "_g").groupBy("_g")
              .agg(F.first("_gn").alias("_gn"), cut_points("_ok").alias("_c1"), cut_points("_tk").alias("_c2"))
              .withColumn("_parts", parts)
              .select("_g", used("_c1").alias("_cuts"), used("_c2").alias("_ties")))
    sketch = cut_lineage(sketch, "group-cuts")
    b = keyed.join(small(counts), "_g").join(small(sketch), "_g", "left")
    b = b.withColumns({"_cuts": F.coalesce("_cuts", none), "_ties": F.coalesce("_ties", none)})
    first = F.size(F.filter("_cuts", lambda c: c < F.col("_ok")))
    b = b.withColumn("_b1", first)
    often = ((F.get("_cuts", F.col("_b1")) == F.col("_ok")) & (F.get("_cuts", F.col("_b1") + 1) == F.col("_ok")))
    text = isinstance(df.schema[order].dataType, T.StringType)
    if text:  # equal keys are not equal texts: no split by the tiebreak here
        often = F.lit(False)
    second = 1 + F.size(F.filter("_ties", lambda c: c < F.col("_tk")))
    b = (b.withColumn("_b", F.col("_b1") * (2 * CUTS) + F.when(F.coalesce(often, F.lit(False)), second).otherwise(0))
         .withColumnRenamed("_gn", count_col).drop("_cuts", "_ties", "_ok", "_tk", "_b1"))
    if _plan_rows(keyed.select("_g", "_ok")) > (1 if text else CUTS) * bucket_rows:
        b = _split_more(b, order, tiebreak[0] if tiebreak else None, bucket_rows)
    local = b.withColumn("_lr", F.row_number().over(Window.partitionBy("_g", "_b").orderBy(*order_by)))
    sizes = b.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_bn"))
    # per group a bounded number of (bucket, size) pairs, prefix-summed in place
    offsets = (sizes.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("_b", "_bn"))).alias("_s"))
               .selectExpr("_g", "inline(transform(_s, (x, i) -> named_struct('_b', x._b, '_off', "
                                 "aggregate(slice(_s, 1, i), 0L, (acc, y) -> acc + y._bn))))"))
    out = local.join(offsets, ["_g", "_b"])
    return out.withColumn(rank_col, (F.col("_lr") + F.col("_off")).cast("long")).drop("_lr", "_off", "_b", "_g")


# How far beyond the wanted share of ranks a tail may reach, the first of them
# that is at least three ranks of the group (the whole group where none is).
REACH = (MARGIN / ACCURACY, 0.005, 0.02, 0.1)


def tails(df: DataFrame, keys: Sequence[str], value: str, share: float, carry: Sequence[str] = ()) -> DataFrame:
    """The rows at the two ends of each group: (_of, _side, value, carry...,
    _n) with side 0 the lowest and 1 the highest values, each with at least
    ``ceil(share * n)`` rows (and few more), ``_n`` the group's rows.  A row
    may be on both sides.  NULL values are left out.

    The ends are cut by a mergeable sketch whose rank error is bounded; ranks
    on side 0 count from the lowest row, on side 1 from the highest.
    """
    v = F.col(value)
    d = df.where(v.isNotNull()).select(_group(keys).alias("_g"), value, *carry)
    ends = [min(1.0, share + r) for r in REACH] + [max(0.0, 1 - share - r) for r in REACH]
    sketch = d.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(v, ends, ACCURACY).alias("_e"))
    at = F.size(F.filter(F.array(*[F.lit(r) for r in REACH]), lambda r: r * F.col("_n") < 3))
    inside = at < len(REACH)
    sketch = sketch.select("_g", "_n", F.when(inside, F.get("_e", at)).alias("_lo"),
                           F.when(inside, F.get("_e", at + len(REACH))).alias("_hi"))
    sketch = cut_lineage(sketch, "ends-sketch")
    d = d.join(sketch if keys else F.broadcast(sketch), "_g")
    low, high = F.col("_lo").isNull() | (v <= F.col("_lo")), F.col("_hi").isNull() | (v >= F.col("_hi"))
    sides = F.filter(F.array(F.when(low, 0), F.when(high, 1)), lambda s: s.isNotNull())
    return d.where(low | high).withColumn("_side", F.explode(sides)).withColumnRenamed("_g", "_of").drop("_lo", "_hi")


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: Sequence[float], names: Sequence[str] | None = None,
                    with_count: bool = False) -> DataFrame:
    """Exact linear-interpolation quantiles per group (``quantile_cont``).

    NULL values are left out; a group without any other gives no row.  NULL
    keys are a group.  See the module's docstring for how.
    """
    keys = list(keys)
    names = list(names) if names else [f"q{p}" for p in probs]
    d = df.where(F.col(value).isNotNull()).select(_group(keys).alias("_g"), F.col(value).cast("double").alias("_v"))
    step = MARGIN / ACCURACY
    ends = [max(0.0, p - step) for p in probs] + [min(1.0, p + step) for p in probs]
    sketch = d.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                                 F.percentile_approx("_v", ends, ACCURACY).alias("_e"))
    # in a small group a step is less than the rank or two by which position
    # conventions differ: there the bracket is the whole group
    small = F.col("_n") * step < 3
    brackets = F.array(*[
        F.struct((F.when(small, F.col("_min")).otherwise(F.get("_e", F.lit(i))) if ends[i] > 0 else F.col("_min")).alias("lo"),
                 (F.when(small, F.col("_max")).otherwise(F.get("_e", F.lit(i + len(probs))))
                  if ends[i + len(probs)] < 1 else F.col("_max")).alias("hi"))
        for i in range(len(probs))])
    sketch = cut_lineage(sketch.select("_g", "_n", "_min", "_max", brackets.alias("_br")), "brackets")
    if _plan_rows(d) * 2 * step * len(probs) > MOST_CELLS:
        sketch = _narrowed(d, sketch, probs)
    sketch = sketch.drop("_min", "_max")
    v = F.col("_v")
    inside = F.exists("_br", lambda b: (b["lo"] <= v) & (v <= b["hi"]))
    gap = F.size(F.filter("_br", lambda b: b["hi"] < v))  # brackets below a row that is in none
    cells = (d.join(sketch if keys else F.broadcast(sketch), "_g")
             .select("_g", "_n", "_v", F.when(inside, v).alias("_in"), F.when(~inside, gap).alias("_gap"))
             .groupBy("_g", "_in", "_gap").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_m"), F.first("_n").alias("_n")))
    run = Window.partitionBy("_g").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_upto", F.sum("_c").over(run))
    n = F.col("_n")

    def at(position: Column) -> Column:  # the value at a 1-based position
        here = (F.col("_upto") - F.col("_c") < position) & (position <= F.col("_upto"))
        return F.max(F.when(here, F.col("_in")))

    aggs = [F.max(n).alias("_n")]
    for i, p in enumerate(probs):
        pos = (n - 1).cast("double") * F.lit(float(p))
        aggs += [at(F.floor(pos) + 1).alias(f"_lo{i}"), at(F.ceil(pos) + 1).alias(f"_hi{i}")]
    g = cells.groupBy("_g").agg(*aggs)
    cols = [F.col(f"_g.{k}").alias(k) for k in keys]
    for i, p in enumerate(probs):
        pos = (n - 1).cast("double") * F.lit(float(p))
        found = F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (pos - F.floor(pos))
        sure = F.col(f"_lo{i}").isNotNull() & F.col(f"_hi{i}").isNotNull()
        cols.append(F.when(sure, found).otherwise(F.raise_error(F.lit("quantile outside its bracket")).cast("double"))
                    .alias(names[i]))
    if with_count:
        cols.append(n.alias("n"))
    return g.select(*cols)


def _byte_key(col: str, low: str, high: str, text: bool) -> Column:
    """A number, monotone in ``col`` between ``low`` and ``high`` and not the
    same for both: of a text, the seven bytes after the part that the two
    have in common."""
    if not text:
        return F.col(col).cast("double")
    a, b, c = (F.hex(F.encode(F.col(x), "UTF-8")) for x in (low, high, col))
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.length(a), F.length(b)) + 1),
                           lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i)))
    same = F.least(same, F.length(a), F.length(b))
    same = (same - same % 2).cast("int")  # whole bytes
    return F.conv(F.rpad(F.substr(c, same + 1, F.lit(14)), 14, "0"), 16, 10).cast("double")


def _split_more(b: DataFrame, order: str, tie: str | None, bucket_rows: int) -> DataFrame:
    """``b`` with buckets of at most ``2 * bucket_rows`` rows: ``_b`` becomes
    a path, longer where a bucket was split again.

    A round sketches only the buckets that are too large, by the order column
    (of texts, the bytes after what the bucket has in common) or, where that
    is one value, by the tiebreak; rows equal to a cut point are a bucket of
    their own and NULLs come first, so each round makes progress.  Rows equal
    in both stay together.  Rows and buckets are written each round.
    """
    kinds = {c: isinstance(b.schema[c].dataType, T.StringType) for c in (order, tie) if c}
    probs = ", ".join(f"{i / CUTS!r}D" for i in range(1, CUTS))
    b = cut_lineage(b.withColumn("_b", F.array("_b")), "buckets")
    while True:
        ends = []
        for i, c in enumerate(kinds):
            plain = F.col(c) if kinds[c] else _order_key(b, c)
            ends += [F.min(plain).alias(f"_lo{i}"), F.max(plain).alias(f"_hi{i}"), F.count(c).alias(f"_nn{i}")]
        st = b.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_bn"), *ends).where(F.col("_bn") > 2 * bucket_rows)
        by = F.lit(None).cast("int")
        for i in reversed(range(len(kinds))):
            mixed = ~F.col(f"_lo{i}").eqNullSafe(F.col(f"_hi{i}")) | ((F.col(f"_nn{i}") > 0) & (F.col(f"_nn{i}") < F.col("_bn")))
            by = F.when(mixed, i).otherwise(by)
        st = cut_lineage(st.withColumn("_by", by).where("_by IS NOT NULL"), "large")
        if st.limit(1).count() == 0:
            return b
        key = F.lit(None).cast("double")
        for i, c in enumerate(kinds):
            k = _byte_key(c, f"_lo{i}", f"_hi{i}", True) if kinds[c] else _order_key(b, c).cast("double")
            key = F.when(F.col("_by") == i, k).otherwise(key)
        keyed = b.join(st, ["_g", "_b"], "left").withColumn("_key", key)
        sketch = (keyed.where("_by IS NOT NULL").groupBy("_g", "_b")
                  .agg(F.expr(f"array_distinct(percentile_approx(_key, array({probs}), {ACCURACY}))").alias("_cuts")))
        at = 2 * F.size(F.filter("_cuts", lambda x: x < F.col("_key"))) + F.exists("_cuts", lambda x: x == F.col("_key")).cast("int")
        new = F.when(F.col("_by").isNull(), 0).when(F.col("_key").isNull(), -1).otherwise(F.coalesce(at, F.lit(0)))
        b = cut_lineage(keyed.join(sketch, ["_g", "_b"], "left").withColumn("_b", F.concat("_b", F.array(new))).select(*b.columns), "buckets")


def _plan_rows(d: DataFrame) -> float:
    """At most about how many rows a (group, double) table has, by Spark's
    own size estimate of its plan."""
    return float(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 8


def _narrowed(d: DataFrame, sketch: DataFrame, probs: Sequence[float]) -> DataFrame:
    """``sketch`` (a written table) with brackets that hold ``MOST_CELLS`` rows at most, or one
    value each.

    The counts are known now, so a table of small groups is left as it is.  A
    round cuts each bracket into ``SPLITS`` equal ranges of values, counts
    the rows in each and below (one partial aggregate over all rows), and
    keeps the ranges with the wanted positions, from their least to their
    largest value.  A position that is not in its bracket makes the whole
    group the bracket, and the rounds go on from there.
    """
    most = sketch.agg(F.max("_n")).first()[0] or 0
    held = most if most * MARGIN / ACCURACY < 3 else most * 2 * MARGIN / ACCURACY
    while held > MOST_CELLS:
        lo, hi, v = F.col("_b.lo"), F.col("_b.hi"), F.col("_v")
        width = F.nullif(hi - lo, F.lit(0.0))
        cut = F.when(v < lo, -1).otherwise(F.coalesce(F.least(F.floor((v - lo) / width * SPLITS), F.lit(SPLITS - 1)), F.lit(0))).cast("int")
        rows = (d.join(sketch.select("_g", "_br"), "_g").select("_g", "_v", F.posexplode("_br").alias("_i", "_b")).where(v <= hi)
                .select("_g", "_i", "_v", cut.alias("_cut")).groupBy("_g", "_i", "_cut")
                .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
        run = Window.partitionBy("_g", "_i").orderBy("_cut").rowsBetween(Window.unboundedPreceding, 0)
        every = sketch.select("_g", "_n", "_min", "_max", F.posexplode("_br").alias("_i", "_b"))
        rows = every.drop("_b").join(rows.withColumn("_upto", F.sum("_c").over(run)), ["_g", "_i"], "left")
        share = F.get(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i"))
        pos = (F.col("_n") - 1).cast("double") * share
        first, last = F.floor(pos) + 1, F.ceil(pos) + 1
        wanted = (F.col("_cut") >= 0) & (F.col("_upto") >= first) & (F.col("_upto") - F.col("_c") < last)
        below = F.coalesce(F.max(F.when(F.col("_cut") < 0, F.col("_upto"))), F.lit(0))
        kept = rows.groupBy("_g", "_n", "_min", "_max", "_i").agg(
            F.min(F.when(wanted, F.col("_lo"))).alias("_lo"), F.max(F.when(wanted, F.col("_hi"))).alias("_hi"),
            F.sum(F.when(wanted, F.col("_c"))).alias("_c"),
            ((below >= F.max(first)) | (F.coalesce(F.max("_upto"), F.lit(0)) < F.max(last))).alias("_off"))
        kept = kept.select("_g", "_n", "_min", "_max", "_i", F.when(F.col("_off"), F.col("_n")).otherwise(F.col("_c")).alias("_c"),
                           F.struct(F.when(F.col("_off"), F.col("_min")).otherwise(F.col("_lo")).alias("lo"),
                                    F.when(F.col("_off"), F.col("_max")).otherwise(F.col("_hi")).alias("hi")).alias("_b"))
        kept = cut_lineage(kept, "brackets")
        held = kept.where("_b.lo < _b.hi").agg(F.max("_c")).first()[0] or 0
        sketch = kept.groupBy("_g", "_n", "_min", "_max").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("_i", "_b"))), lambda x: x["_b"]).alias("_br"))
        sketch = cut_lineage(sketch, "brackets")
    return sketch


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-group tables on ``keys``; NULL keys meet NULL keys."""
    keys = list(keys)
    if not keys:
        return attach_scalars(left, right)
    r = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return left.join(r, on, how).drop(*[f"_k_{k}" for k in keys])


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table to every row.

    The one-row side is broadcast (its size is one row by construction),
    joined on a constant key, so nothing is shuffled and no pair of data
    rows is formed.
    """
    left = df.withColumn("_one", F.lit(1))
    right = one_row.withColumn("_one", F.lit(1))
    return left.join(F.broadcast(right), "_one").drop("_one")
