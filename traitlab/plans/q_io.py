"""Registered queries: sources and sinks, and the species report table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..functions.numeric import round_half_even
from ..operators import draws as D
from ..operators import factors as FA
from ..operators import perdraw as PD
from ..operators import report as RP
from ..operators import reshape as R
from ..session import cut_lineage, scratch_path
from ..sources import dealt, io
from . import sqlgen as G
from . import views as V
from .registry import query

W = V.with_views

PART_CSV_SCHEMA = T.StructType([
    T.StructField("p_partkey", T.LongType()),
    T.StructField("p_name", T.StringType()),
    T.StructField("p_brand", T.StringType()),
    T.StructField("p_type", T.StringType()),
    T.StructField("p_size", T.IntegerType()),
    T.StructField("p_retailprice", T.DoubleType()),
])


@query("scan_traits", "id spp type size:d price:d",
       "SELECT p_partkey AS id, p_brand AS spp, p_type AS type, CAST(p_size AS DOUBLE) AS size, "
       "p_retailprice AS price FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL "
       "AND p_type = 'ECONOMY'")
def scan_traits(spark: SparkSession, d: str) -> DataFrame:
    """A1 + A2 + B1 + B2 + B4 + B5: the part table written as CSV (NULL as
    ``NA``) to the shared folder, scanned back with an explicit schema,
    renamed, pruned, complete cases kept and one category selected."""
    path = scratch_path(spark, "part-csv")
    io.write_csv(V.table(spark, d, "part").select(*PART_CSV_SCHEMA.fieldNames()), path)
    t = io.read_csv(spark, path, PART_CSV_SCHEMA)
    t = t.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("spp"), F.col("p_type").alias("type"),
                 F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("size"),
                 F.col("p_retailprice").alias("price"))
    t = t.drop("name")
    return FA.complete_cases(t, ["size", "price"]).where(F.col("type") == "ECONOMY")


@query("excel_twin", "spp trait value:d",
       "SELECT p_brand AS spp, 'size' AS trait, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL "
       "SELECT p_brand, 'price', p_retailprice FROM part")
def excel_twin(spark: SparkSession, d: str) -> DataFrame:
    """A2: a long trait table (spp, trait, value) kept as a workbook, read
    through its CSV twin in the shared folder."""
    path = scratch_path(spark, "twin-csv")
    io.write_csv(V.long_traits(spark, d).select("spp", "trait", "value"), path)
    return io.read_excel_twin(spark, path)


@query("refit_when_stale", "version spp n mean_price:d",
       "SELECT 1 AS version, p_brand AS spp, count(*) AS n, avg(p_retailprice) AS mean_price FROM part GROUP BY p_brand UNION ALL "
       "SELECT 2, p_brand, count(*), avg(p_retailprice + 1) FROM part GROUP BY p_brand UNION ALL "
       "SELECT 3, p_brand, count(*), avg(p_retailprice + 1) FROM part WHERE p_size > 10 GROUP BY p_brand")
def refit_when_stale(spark: SparkSession, d: str) -> DataFrame:
    """A5 with staleness: one stored result, asked for with the table, with
    the table's prices changed (as many rows), and with another setting; each
    time the stored copy follows what it was asked for."""
    part = V.table(spark, d, "part").select("p_brand", "p_size", "p_retailprice")
    path, out = scratch_path(spark, "fit"), None
    for version, shift, least in ((1, 0, None), (2, 1, None), (3, 1, 10)):
        src = part.withColumn("p_retailprice", F.col("p_retailprice") + shift)

        def build(src=src, least=least):
            kept = src if least is None else src.where(F.col("p_size") > least)
            return kept.groupBy(F.col("p_brand").alias("spp")).agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("mean_price"))

        stored = io.materialize(spark, path, build, inputs={"part": src}, params={"least": least})
        stored = cut_lineage(stored.select(F.lit(version).alias("version"), "spp", "n", "mean_price"), "fit-copy")
        out = stored if out is None else out.unionByName(stored)
    return out


def _perdraw_long(spark: SparkSession, d: str) -> DataFrame:
    pm = V.regression_draws(spark, d)
    return pm.select(F.lit("perdraw").alias("model"), F.lit(1).alias("chain"), F.col("iter").cast("long").alias("iter"),
                     F.concat(F.lit("b1["), "response", F.lit(","), "treatment", F.lit("]")).alias("par"),
                     F.col("b1").alias("value"))


@query("draws_store_roundtrip", "model chain iter par value:d",
       W("PM") + "SELECT 'perdraw' AS model, CAST(1 AS INTEGER) AS chain, CAST(iter AS BIGINT) AS iter, "
       "'b1[' || response || ',' || treatment || ']' AS par, b1 AS value FROM pm")
def draws_store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A4 + A5 + A3 + A6: two models' draws written once to a store
    partitioned by model, read back with the other model pruned, and a
    vector parameter selected by its base name."""
    root = scratch_path(spark, "draws-store")
    io.materialize(spark, root, lambda: V.draws_events(spark, d).unionByName(_perdraw_long(spark, d)),
                   writer=io.write_draws)
    return io.select_pars(io.read_draws(spark, root, models=["perdraw"]), ["b1"])


# ------------------------------------------------------------ species report

# The unit line of the gsmax column in the report header.
GSMAX_UNIT = "mol $\\textrm{H}_2$O $\\textrm{m}^{-2}$ $\\textrm{s}^{-1}$"
REPORT_SCHEMA = T.StructType([
    T.StructField("sort_key", T.LongType()),
    T.StructField("species", T.StringType()),
    T.StructField("treatment", T.StringType()),
    T.StructField("spp1", T.StringType()),
    T.StructField("gsmax", T.StringType()),
    T.StructField("se", T.StringType()),
    T.StructField("hpd_interval", T.StringType()),
    T.StructField("estimate_2dp", T.DoubleType()),
    T.StructField("kcatc_cell", T.StringType()),
])


def _cell(x: str) -> str:
    return TX.add_zeroes_sql(TX.signif_text_sql(x, 3), 3)


_REPORT_TEXT = {
    "gsmax": _cell("estimate"),
    "se": _cell("se"),
    "hpd_interval": TX.interval_text_sql(_cell("lower"), _cell("upper")),
    "kcatc_cell": f"({TX.signif_text_sql('kc_mu', 3)} || {TX._lit(TX.PM)} || {TX.signif_text_sql('kc_se', 3)})",
}


def _report_sql() -> str:
    txt = ", ".join(f"{v} AS {k}" for k, v in _REPORT_TEXT.items() if k != "kcatc_cell")
    return (W("DS") + ", l AS (SELECT iter, CAST(spp AS STRING) AS spp1, 'ww' AS tr, gsmax_ww AS value FROM ds "
            "UNION ALL SELECT iter, CAST(spp AS STRING) AS spp1, 'wd' AS tr, gsmax_wd AS value FROM ds), "
            + G.hpd_cte("l", ["spp1", "tr"], "value", "iter") + ", "
            "s AS (SELECT spp1, tr, avg(value) AS estimate, stddev_samp(value) AS se FROM l GROUP BY spp1, tr), "
            "dic AS (SELECT DISTINCT CAST(l_linenumber AS STRING) AS spp1, 'line-' || CAST(l_linenumber AS STRING) AS species, "
            "CASE WHEN l_linestatus = 'O' THEN 'ww' ELSE 'wd' END AS tr FROM lineitem), "
            "kc AS (SELECT CAST(spp AS STRING) AS spp1, avg(kcatc) AS kc_mu, stddev_samp(kcatc) AS kc_se FROM ds GROUP BY spp), "
            "j AS (SELECT s.spp1, s.tr, s.estimate, s.se, hpd.lower, hpd.upper, dic.species, kc.kc_mu, kc.kc_se FROM s "
            "JOIN hpd ON s.spp1 = hpd.spp1 AND s.tr = hpd.tr LEFT JOIN dic ON s.spp1 = dic.spp1 AND s.tr = dic.tr "
            "LEFT JOIN kc ON s.spp1 = kc.spp1) "
            "SELECT CAST(row_number() OVER (ORDER BY CAST(spp1 AS INTEGER), upper(tr)) AS BIGINT) AS sort_key, species, "
            f"upper(tr) AS treatment, spp1, {txt}, round_even(estimate, 2) AS estimate_2dp, "
            f"{_REPORT_TEXT['kcatc_cell']} AS kcatc_cell FROM j "
            f"UNION ALL SELECT 0, '', '', '', {TX._lit(GSMAX_UNIT)}, '', '', NULL, ''")


@query("species_report", "sort_key species treatment spp1 gsmax se hpd_interval estimate_2dp:d kcatc_cell",
       _report_sql())
def species_report(spark: SparkSession, d: str) -> DataFrame:
    """K19 + C6 + C9 + I3/I4/I8/I14/I15 (U3) + F2 + F4 + A7: per species and
    treatment, mean, SE and HPD of the gsmax draws as padded 3-digit text,
    names from a de-duplicated dictionary, a keyed bind of the kcatc
    summary, sorted by numeric species code under a unit header row; the
    table is written as CSV and read back."""
    ds = V.stored_species(spark, d)
    long = (R.gather(ds.select("iter", "spp", F.col("gsmax_ww").alias("ww"), F.col("gsmax_wd").alias("wd")),
                     ["iter", "spp"], "tr", "value")
            .withColumn("spp1", F.col("spp").cast("string")).drop("spp"))
    s = D.summarise_draws(long, ["spp1", "tr"], estimate="mean", interval="hpd", p=False, term=None)
    s = s.withColumnRenamed("std_error", "se").withColumnRenamed("conf_low", "lower") \
        .withColumnRenamed("conf_high", "upper")
    li = V.table(spark, d, "lineitem")
    dic = li.select(F.col("l_linenumber").cast("string").alias("spp1"),
                    F.concat(F.lit("line-"), F.col("l_linenumber").cast("string")).alias("species"),
                    F.when(F.col("l_linestatus") == "O", "ww").otherwise("wd").alias("tr")).distinct()
    kc = ds.groupBy(F.col("spp").cast("string").alias("spp1")).agg(F.avg("kcatc").alias("kc_mu"),
                                                                   F.stddev_samp("kcatc").alias("kc_se"))
    j = s.join(dic, ["spp1", "tr"], "left").join(kc, "spp1", "left")
    j = j.withColumn("_num", F.col("spp1").cast("int")).withColumn("treatment", F.upper("tr"))
    j = FA.order_levels(j, "_num", "sort_key", tiebreak=["treatment"])
    j = RP.number_text(j, {"gsmax": "estimate", "se": "se", "_lo": "lower", "_hi": "upper"}, 3, pad=True)
    j = RP.number_text(j, {"_kc_mu": "kc_mu", "_kc_se": "kc_se"}, 3)
    j = j.withColumns({"hpd_interval": RP.interval_text("_lo", "_hi"),
                       "kcatc_cell": F.concat(F.col("_kc_mu"), F.lit(TX.PM), F.col("_kc_se"))})
    body = j.select("sort_key", "species", "treatment", "spp1", "gsmax", "se", "hpd_interval",
                    round_half_even("estimate", 2).alias("estimate_2dp"), "kcatc_cell")
    table = RP.add_header_row(body, {"species": "", "treatment": "", "spp1": "", "gsmax": GSMAX_UNIT,
                                     "se": "", "hpd_interval": "", "kcatc_cell": ""})
    path = scratch_path(spark, "species-report")
    io.write_table(table, path, order_by=["sort_key"])
    return io.read_table(spark, path, REPORT_SCHEMA)


# ------------------------------------------------------- draws dealt by draw

def _tax_draws(spark: SparkSession, d: str) -> DataFrame:
    li, st = V.table(spark, d, "lineitem"), F.col("l_linestatus")
    return (li.groupBy(F.col("l_suppkey").alias("iter"), F.col("l_linenumber").alias("spp"))
            .agg(D.ratio(F.avg(F.when(st == "O", F.col("l_tax"))), F.avg(F.when(st == "F", F.col("l_tax")))).alias("value")))


def _as_model(df: DataFrame, model: str) -> DataFrame:
    return df.select(F.lit(model).alias("model"), (F.col("iter") % 4).cast("int").alias("chain"), F.col("iter").cast("long").alias("iter"),
                     F.concat(F.lit("diff["), F.col("spp").cast("string"), F.lit("]")).alias("par"), "value")


_DEALT_SQL = (
    W("DS") + ", a AS (SELECT iter, spp, gsmax_wd / nullif(gsmax_ww, 0) AS v FROM ds WHERE spp <> 7), "
    "b AS (SELECT l_suppkey AS iter, l_linenumber AS spp, avg(l_tax) FILTER (WHERE l_linestatus = 'O') / "
    "nullif(avg(l_tax) FILTER (WHERE l_linestatus = 'F'), 0) AS v FROM lineitem GROUP BY l_suppkey, l_linenumber), "
    "j AS (SELECT coalesce(a.iter, b.iter) AS iter, a.v AS a, b.v AS b FROM a FULL OUTER JOIN b ON a.iter = b.iter AND a.spp = b.spp), "
    "r AS (SELECT iter, CASE WHEN stddev_samp(a) FILTER (WHERE b IS NOT NULL) * stddev_samp(b) FILTER (WHERE a IS NOT NULL) > 0 "
    "THEN covar_samp(a, b) / (stddev_samp(a) FILTER (WHERE b IS NOT NULL) * stddev_samp(b) FILTER (WHERE a IS NOT NULL)) END AS r "
    "FROM j GROUP BY iter), "
    "ma AS (SELECT iter, avg(v) AS m, count(*) AS n FROM a GROUP BY iter), mb AS (SELECT iter, avg(v) AS m, count(*) AS n FROM b GROUP BY iter) "
    "SELECT CAST(r.iter % 4 AS INTEGER) AS chain, CAST(r.iter AS BIGINT) AS iter, r.r AS r, ma.m AS anatomy, mb.m AS flow, "
    "ma.n AS n_anatomy, mb.n AS n_flow FROM r LEFT JOIN ma ON r.iter = ma.iter LEFT JOIN mb ON r.iter = mb.iter")


@query("dealt_draws", "chain iter r:d anatomy:d flow:d n_anatomy n_flow", _DEALT_SQL)
def dealt_draws(spark: SparkSession, d: str) -> DataFrame:
    """C3 + C5 + D16 on a store dealt by draw: the ratios of two models are
    written once (the second added to the store of the first), then joined by
    parameter, correlated within each draw, and the correlations joined with
    each model's mean per draw; nothing is shuffled after the write."""
    root = scratch_path(spark, "dealt-draws")
    ds = V.draws_species(spark, d).where("spp <> 7")
    anatomy = cut_lineage(_as_model(ds.withColumn("value", D.ratio(F.col("gsmax_wd"), F.col("gsmax_ww"))), "anatomy"), "dealt-model")
    dealt.write_dealt(anatomy, root)
    dealt.add_dealt(cut_lineage(_as_model(_tax_draws(spark, d), "flow"), "dealt-model"), root)
    both = dealt.side_by_side(dealt.read_dealt(spark, root), {"a": F.col("model") == "anatomy", "b": F.col("model") == "flow"})
    draw = list(dealt.DRAW)
    out = PD.per_draw_correlation(both, draw, [("ab", "a", "b")]).select(*draw, F.col("r_ab").alias("r"))
    for model in ("anatomy", "flow"):
        per = (dealt.read_dealt(spark, root, models=[model]).groupBy(*draw)
               .agg(F.avg("value").alias(model), F.count(F.lit(1)).alias(f"n_{model}")))
        out = out.join(per, draw, "left")
    return out
