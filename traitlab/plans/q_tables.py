"""Registered queries: summaries, reshaping, labels and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.numeric import safe_ln, safe_ln_sql
from ..operators import draws as D
from ..operators import factors as FA
from ..operators import report as RP
from ..operators import reshape as R
from ..operators import summary as S
from ..operators import traits as TR
from . import sqlgen as G
from . import views as V
from .registry import query

W = V.with_views

# ------------------------------------------------------------ null-skipping cells

_NS_COLS = ("sd", "sp", "gs")


def _ns_sql() -> str:
    aggs, sel = [], []
    for c in _NS_COLS:
        aggs += [f"avg({c}) AS mean_{c}", f"stddev_samp({c}) / sqrt(count({c})) AS se_{c}",
                 f"count({c}) AS n_{c}"]
        sel += [f"mean_{c}", f"se_{c}", f"n_{c}",
                f"{TX.mean_se_cell_sql(f'mean_{c}', f'se_{c}', f'n_{c}')} AS cell_{c}"]
    return (W("C", "G") + ", j AS (SELECT coalesce(c.k, g.k) AS k, c.sd, c.sp, g.spp, g.treatment, g.gs "
            f"FROM c FULL OUTER JOIN g ON c.k = g.k), a AS (SELECT spp, treatment, {', '.join(aggs)} "
            f"FROM j GROUP BY spp, treatment) SELECT spp, treatment, {', '.join(sel)} FROM a")


@query("null_skipping_summary",
       "spp treatment " + " ".join(f"mean_{c}:d se_{c}:d n_{c} cell_{c}" for c in _NS_COLS),
       _ns_sql())
def null_skipping_summary(spark: SparkSession, d: str) -> DataFrame:
    """D4 + D5 + I12/I13 (U4): per (spp, treatment) over the full join, every
    numeric column's null-skipping mean, se, n and a "mean $\\pm$ se (n)" cell."""
    j = TR.join_plants(V.pair_collapse_p(spark, d), V.leaf(spark, d), ["k"], "full")
    j = j.withColumn("k", F.col("k").cast("string"))  # I9: the key is text, not a measure
    g = S.summarise_numeric(j, ["spp", "treatment"], lambda c: [
        F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"sd_{c}"), F.count(c).alias(f"n_{c}")])
    g = g.withColumns({f"se_{c}": S.se(F.col(f"sd_{c}"), F.col(f"n_{c}")) for c in _NS_COLS})
    return RP.mean_se_cells(g, {f"cell_{c}": (f"mean_{c}", f"se_{c}", f"n_{c}") for c in _NS_COLS}, 3)


# ------------------------------------------------------------ global statistics

@query("global_stats_centre", "id spp trait value:d value_c:c min:d max:d n median:d",
       W("T") + ", st AS (SELECT trait, min(value) AS min, max(value) AS max, count(value) AS n, "
       "avg(value) AS mean, median(value) AS median FROM t GROUP BY trait) "
       "SELECT t.id, t.spp, t.trait, t.value, t.value - st.mean AS value_c, st.min, st.max, st.n, st.median "
       "FROM t JOIN st ON t.trait = st.trait")
def global_stats_centre(spark: SparkSession, d: str) -> DataFrame:
    """D7 + D8 + D9 + B15: per-trait min / max / n / exact median attached to
    every row, and the value centred on the trait mean."""
    t = V.long_traits(spark, d)
    return S.centre(t, "value", ["trait"], out="value_c", stats=S.global_stats(t, "value", ["trait"]))


# ------------------------------------------------------------ codes and distinct

@query("group_first_distinct", "spp code n_t n_g first_trait",
       W("T", "G") + ", d AS (SELECT spp, CAST(dense_rank() OVER (ORDER BY spp) AS INTEGER) AS code "
       "FROM (SELECT spp FROM t UNION SELECT spp FROM g) u WHERE spp IS NOT NULL), "
       "tt AS (SELECT spp, count(*) AS n, min(trait) AS first_trait FROM t GROUP BY spp), "
       "gg AS (SELECT spp, count(*) AS n FROM g GROUP BY spp) "
       "SELECT d.spp, d.code, coalesce(tt.n, 0) AS n_t, coalesce(gg.n, 0) AS n_g, tt.first_trait "
       "FROM d LEFT JOIN tt ON d.spp = tt.spp LEFT JOIN gg ON d.spp = gg.spp")
def group_first_distinct(spark: SparkSession, d: str) -> DataFrame:
    """D21 + D22 + E2 (Q4): one shared code dictionary over the distinct
    categories of two tables, with per-category counts and first value."""
    t, g = V.long_traits(spark, d), V.leaf(spark, d)
    dic = FA.dictionary(t.select("spp"), g.select("spp"), name="spp", code="code")
    tc = t.groupBy("spp").agg(F.count(F.lit(1)).alias("n_t"))
    gc = g.groupBy("spp").agg(F.count(F.lit(1)).alias("n_g"))
    first = S.first_in_group(t, ["spp"], "trait", "first_trait")
    return dic.join(tc, "spp", "left").join(gc, "spp", "left").join(first, "spp", "left").fillna(0, ["n_t", "n_g"])


# ------------------------------------------------------------ log, pivot, rename

def _log_wide_sql() -> str:
    cols = []
    for m in ("sd", "sp"):
        for s in ("F", "O"):
            cols.append(f"max(CASE WHEN surface = '{s}' THEN {safe_ln_sql(m)} END) AS log_{m}_{s}")
    return W("P") + f"SELECT CAST(k AS STRING) AS k, {', '.join(cols)} FROM p GROUP BY k"


@query("log_transform_wide", "k log_sd_F:d log_sd_O:d log_sp_F:d log_sp_O:d", _log_wide_sql())
def log_transform_wide(spark: SparkSession, d: str) -> DataFrame:
    """I9 + B9 + I1 + H1 + B11: key to text, ln of every numeric column,
    surfaces spread to columns, columns renamed by regex."""
    p = V.surface_rows(spark, d).withColumn("k", F.col("k").cast("string"))
    p = R.mutate_numeric(p, safe_ln)
    wide = (p.groupBy("k").pivot("surface", ["F", "O"])
            .agg(F.max("sd").alias("sd"), F.max("sp").alias("sp")))
    return R.rename_regex(wide, r"^([FO])_(s[dp])$", r"log_\2_\1")


# ------------------------------------------------------------ unpivot / unite / separate

@query("unpivot_traits", "id spp trait value:d key spp2 trait2",
       "WITH u AS (UNPIVOT (SELECT p_partkey AS id, p_brand AS spp, CAST(p_size AS DOUBLE) AS size, "
       "p_retailprice AS price FROM part) ON size, price INTO NAME trait VALUE value) "
       "SELECT id, spp, trait, value, spp || '_' || trait AS key, "
       "split_part(spp || '_' || trait, '_', 1) AS spp2, split_part(spp || '_' || trait, '_', 2) AS trait2 FROM u")
def unpivot_traits(spark: SparkSession, d: str) -> DataFrame:
    """H2 + H3 + H4: wide part table to long traits, keys united and split."""
    p = V.table(spark, d, "part")
    wide = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("spp"),
                    F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    long = R.gather(wide, ["id", "spp"], "trait", "value")
    long = R.unite(long, "key", ["spp", "trait"], remove=False)
    return R.separate(long, "key", ["spp2", "trait2"], remove=False)


# ------------------------------------------------------------ re-pivot of summaries

_TRAIT_COLS = ("gsmax_ww", "gsmax_wd", "kcatc", "sco")
_RE_SPP = "([0-9]+)[^0-9]*$"
_RE_TRAIT = "^([a-z]+)"
_RE_TREAT = "^[a-z]+_(w[wd])_spp"


def _repivot_sql() -> str:
    union = " UNION ALL ".join(f"SELECT iter, spp, '{c}' AS tc, {c} AS value FROM ds" for c in _TRAIT_COLS)
    piv = []
    for t in ("gsmax", "kcatc", "sco"):
        piv += [f"max(mu) FILTER (WHERE trait = '{t}') AS mu_{t}",
                f"max(mu - se) FILTER (WHERE trait = '{t}') AS lower_{t}",
                f"max(mu + se) FILTER (WHERE trait = '{t}') AS upper_{t}"]
    return (W("DS") + f", l AS ({union}), "
            "s AS (SELECT tc || '_spp[' || CAST(spp AS STRING) || ']' AS par, avg(value) AS mu, "
            "stddev_samp(value) AS se FROM l GROUP BY tc || '_spp[' || CAST(spp AS STRING) || ']'), "
            f"pr AS (SELECT regexp_extract(par, '{_RE_SPP}', 1) AS spp1, regexp_extract(par, '{_RE_TRAIT}', 1) AS trait, "
            f"nullif(regexp_extract(par, '{_RE_TREAT}', 1), '') AS treatment, mu, se FROM s), "
            "x AS (SELECT spp1, trait, treatment, mu, se FROM pr WHERE treatment IS NOT NULL "
            "UNION ALL SELECT spp1, trait, 'ww' AS treatment, mu, se FROM pr WHERE treatment IS NULL "
            "UNION ALL SELECT spp1, trait, 'wd' AS treatment, mu, se FROM pr WHERE treatment IS NULL) "
            f"SELECT spp1, treatment, {', '.join(piv)} FROM x GROUP BY spp1, treatment")


@query("repivot_mu_bounds",
       "spp1 treatment " + " ".join(f"mu_{t}:d lower_{t}:d upper_{t}:d" for t in ("gsmax", "kcatc", "sco")),
       _repivot_sql())
def repivot_mu_bounds(spark: SparkSession, d: str) -> DataFrame:
    """H5 + H6 + I5 + G2: draws named ``trait_spp[i]`` are summarised, the
    names parsed into (species, trait, treatment), treatment-free traits
    copied to both treatments, and one pivot gives mu / lower / upper per
    trait for each (species, treatment)."""
    ds = V.stored_species(spark, d)
    long = R.gather(ds.select("iter", "spp", *_TRAIT_COLS), ["iter", "spp"], "tc", "value")
    long = long.withColumn("par", F.concat(F.col("tc"), F.lit("_spp["), F.col("spp").cast("string"), F.lit("]")))
    summ = long.groupBy("par").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("se"))
    parsed = summ.select(F.regexp_extract("par", _RE_SPP, 1).alias("spp1"),
                         F.regexp_extract("par", _RE_TRAIT, 1).alias("trait"),
                         F.nullif(F.regexp_extract("par", _RE_TREAT, 1), F.lit("")).alias("treatment"),
                         "mu", "se")
    both = R.copy_to_levels(parsed, "treatment", ["ww", "wd"], F.col("treatment").isNull())
    wide = (both.groupBy("spp1", "treatment").pivot("trait", ["gsmax", "kcatc", "sco"])
            .agg(F.max("mu").alias("mu"), F.max(F.col("mu") - F.col("se")).alias("lower"),
                 F.max(F.col("mu") + F.col("se")).alias("upper")))
    return R.rename_regex(wide, r"^([a-z]+)_(mu|lower|upper)$", r"\2_\1")


# ------------------------------------------------------------ selection by pattern

@query("select_by_pattern", "iter spp gsmax_ww:d gsmax_wd:d kcatc:d label spp_text label_match in_set",
       W("DS") + "SELECT iter, spp, gsmax_ww + kcatc AS gsmax_ww, gsmax_wd + kcatc AS gsmax_wd, kcatc, "
       "'spp_' || CAST(spp AS STRING) AS label, regexp_replace('spp_' || CAST(spp AS STRING), '^spp_', '') AS spp_text, "
       "regexp_matches('spp_' || CAST(spp AS STRING), '^spp_[1-3]$') AS label_match, spp IN (2, 4, 6) AS in_set FROM ds")
def select_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    """B3 + B10 + I6 + B6 + B7: columns chosen and shifted by name pattern,
    a prefix removed by regex, regex and membership predicates."""
    ds = V.stored_species(spark, d)
    sel = R.select_matching(ds, r"^gsmax_", keep=["iter", "spp", "kcatc"])
    sel = R.mutate_matching(sel, r"^gsmax_w[wd]$", lambda c: c + F.col("kcatc"))
    lab = F.concat(F.lit("spp_"), F.col("spp").cast("string"))
    return sel.select("iter", "spp", "gsmax_ww", "gsmax_wd", "kcatc", lab.alias("label"),
                      F.regexp_replace(lab, "^spp_", "").alias("spp_text"),
                      lab.rlike("^spp_[1-3]$").alias("label_match"),
                      F.col("spp").isin(2, 4, 6).alias("in_set"))


# ------------------------------------------------------------ label map and text

# Parameter labels and the rows shown on the natural scale.
LABELS = {"click": "Click intercept", "view": "View intercept",
          "purchase": "Effect of purchase", "signup": "Effect of signup"}
BACK_TRANSFORMED = ("Click intercept", "View intercept")


def _label_case(col: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items())
    return f"CASE {col} {arms} END"


def _label_text_cols(est: str, lo: str, hi: str, p: str) -> list[str]:
    return [f"{TX.signif_text_sql(est, 3)} AS estimate_txt",
            f"{TX.interval_text_sql(TX.signif_text_sql(lo, 3), TX.signif_text_sql(hi, 3))} AS interval_txt",
            f"{TX.p_cell_sql(p, 3, None)} AS p_txt",
            f"{TX.p_label_sql(p + '_raw')} AS p_label",
            TX.template_sql(["=parameter", ": ", "=" + TX.signif_text_sql(est, 3), " (95% interval ",
                             "=" + TX.interval_text_sql(TX.signif_text_sql(lo, 3), TX.signif_text_sql(hi, 3)),
                             "), P", "=" + TX.p_label_sql(p + "_raw")]) + " AS sentence"]


def _label_sql() -> str:
    back = ", ".join(f"'{b}'" for b in BACK_TRANSFORMED)
    bt = lambda c: f"CASE WHEN parameter IN ({back}) THEN exp({c}) ELSE {c} END AS {c}"
    return (W("DR") + f", lv AS (SELECT par, {safe_ln_sql('value + 30')} AS value FROM dr), "
            "s AS (SELECT par AS term, avg(value) AS estimate, quantile_cont(value, 0.025) AS conf_low, "
            f"quantile_cont(value, 0.975) AS conf_high, {G.tail_p_expr('value')} AS p FROM lv GROUP BY par), "
            f"l AS (SELECT {_label_case('term')} AS parameter, estimate, conf_low, conf_high, p FROM s), "
            f"b AS (SELECT parameter, {bt('estimate')}, {bt('conf_low')}, {bt('conf_high')}, "
            "CASE WHEN p < 0.001 THEN 0 ELSE p END AS p, p AS p_raw FROM l WHERE parameter IS NOT NULL) "
            f"SELECT parameter, estimate, conf_low, conf_high, p_raw AS p, "
            f"{', '.join(_label_text_cols('estimate', 'conf_low', 'conf_high', 'p'))} FROM b")


@query("label_map", "parameter estimate:d conf_low:d conf_high:d p:d estimate_txt interval_txt p_txt p_label sentence",
       _label_sql())
def label_map(spark: SparkSession, d: str) -> DataFrame:
    """B12 + B13 + I17 + I7 + I10 + I11 (+ I4, I15, Q7): summary of log-scale
    draws, labels mapped (unmatched dropped), intercepts back-transformed,
    numbers turned into table text."""
    dr = V.draws_events(spark, d).withColumn("value", safe_ln(F.col("value") + 30))
    s = D.summarise_draws(dr, ["par"], estimate="mean", interval="quantile")
    s = RP.label_map(s, "term", LABELS)
    s = RP.back_transform(s, ["estimate", "conf_low", "conf_high"], F.col("parameter").isin(list(BACK_TRANSFORMED)))
    s = RP.clamp_p(s, "p", 0.001, keep="p_raw")
    s = RP.number_text(s, {"estimate_txt": "estimate", "_lo": "conf_low", "_hi": "conf_high", "_p": "p"}, 3)
    s = s.withColumns({"interval_txt": RP.interval_text("_lo", "_hi"), "p_txt": RP.p_cell("p", "_p"),
                       "p_label": F.expr(TX.p_label_sql("p_raw"))})
    s = s.withColumn("sentence", F.concat(F.col("parameter"), F.lit(": "), F.col("estimate_txt"),
                                          F.lit(" (95% interval "), F.col("interval_txt"), F.lit("), P"),
                                          F.col("p_label")))
    return s.withColumn("p", F.col("p_raw"))


# ------------------------------------------------------------ union with missing columns

def _union_sql() -> str:
    return (W("DR", "PM") + ", " + G.rhat_cte("dr") + ", "
            "a AS (SELECT dr.par AS term, avg(value) AS estimate, stddev_samp(value) AS std_error, "
            "quantile_cont(value, 0.025) AS conf_low, quantile_cont(value, 0.975) AS conf_high, "
            "min(rh.rhat) AS rhat, 'mean' AS method, 'quantile' AS interval, 1 AS sort_key "
            "FROM dr JOIN rh ON dr.par = rh.par GROUP BY dr.par), "
            "pl AS (SELECT iter, 'b_' || response || '_gsmax_' || treatment AS par, b1 AS value FROM pm), "
            + G.hpd_cte("pl", ["par"], "value", "iter") + ", "
            "b AS (SELECT pl.par AS term, median(value) AS estimate, stddev_samp(value) AS std_error, "
            "min(hpd.lower) AS conf_low, min(hpd.upper) AS conf_high, 'median' AS method, 'hpd' AS interval, "
            "2 AS sort_key FROM pl JOIN hpd ON pl.par = hpd.par GROUP BY pl.par) "
            "SELECT 0 AS sort_key, 'term' AS term, 'method' AS method "
            "UNION ALL BY NAME SELECT * FROM a UNION ALL BY NAME SELECT * FROM b")


@query("union_missing_columns",
       "sort_key term estimate:d std_error:d conf_low:d conf_high:d rhat:d method interval", _union_sql())
def union_missing_columns(spark: SparkSession, d: str) -> DataFrame:
    """G1 + D17 + D18 + F4: an estimate table of mean-based rows (with R-hat)
    and median/HPD rows of per-draw slopes (no chains, so no R-hat), bound
    by name, under a header row with sort key 0."""
    a = D.summarise_draws(V.draws_events(spark, d), ["par"], estimate="mean", interval="quantile",
                          rhat=True, p=False)
    pm = V.regression_draws(spark, d)
    pl = pm.select("iter", F.concat(F.lit("b_"), "response", F.lit("_gsmax_"), "treatment").alias("par"),
                   F.col("b1").alias("value"))
    b = D.summarise_draws(pl, ["par"], estimate="median", interval="hpd", p=False)
    body = R.bind_rows(a.withColumn("sort_key", F.lit(1)), b.withColumn("sort_key", F.lit(2)))
    return RP.add_header_row(body, {"term": "term", "method": "method"})
