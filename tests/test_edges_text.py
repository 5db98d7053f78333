"""Edge fixtures (FIXTURES.md §4) and number-to-text rules."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitlab.functions import text as TX
from traitlab.functions import units
from traitlab.functions.numeric import safe_ln, signif, signif_columns
from traitlab.operators import reshape as R
from traitlab.operators import summary as S
from traitlab.operators import traits as TR
from traitlab.sources import io

SURF = io.SURFACE_SCHEMA


def surf(spark, rows):
    return spark.createDataFrame(rows, SURF)


def test_pair_collapse_missing_and_duplicate_side(spark):
    df = surf(spark, [
        ("A", "WW", "1", "aB", 10.0, None, 20.0), ("A", "WW", "1", "aD", 5.0, None, 30.0),
        ("A", "WW", "2", "aB", 10.0, None, 20.0),                       # one surface only
        ("A", "WW", "3", "aB", 1.0, None, 2.0), ("A", "WW", "3", "aB", 1.0, None, 2.0),
        ("A", "WW", "3", "aD", 1.0, None, 2.0),                          # duplicated surface
    ])
    out = {r.rep: r for r in TR.pair_collapse(df, ["spp", "treatment", "rep"], strict=True).collect()}
    assert (out["1"].sd, out["1"].sp, out["1"]._pair_ok) == (15.0, 25.0, True)
    assert out["2"].sd is None and out["2"]._pair_ok is False
    assert out["3"]._pair_ok is False
    with pytest.raises(TR.PairError):
        TR.assert_pairs(TR.pair_collapse(df, ["spp", "treatment", "rep"], strict=True))


def test_all_null_group_and_group_of_one(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0)], "g string, x double")
    rows = {r.g: r for r in S.group_summary(df, ["g"], ["x"]).collect()}
    assert rows["a"].x is None and rows["a"].n_x == 0 and rows["a"].se_x is None
    assert rows["b"].x == 1.0 and rows["b"].n_x == 1 and rows["b"].sd_x is None


def test_log_of_non_positive_is_null(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (1.0,)], "x double")
    vals = [r[0] for r in df.select(safe_ln("x")).collect()]
    assert vals[:2] == [None, None] and vals[2] == 0.0


def test_unit_mismatch_raises_at_plan_time(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "sd double, sp double")
    with pytest.raises(units.UnitError):
        TR.add_gsmax(df, sd_unit="um", sp_unit="um")
    ok = units.convert(units.with_unit(df, "sp", "um"), "sp", "mm")
    assert ok.first().sp == pytest.approx(2e-3)
    with pytest.raises(units.UnitError):
        units.convert(units.with_unit(df, "sp", "um"), "sp", "mol/m^2/s")


def _sql(spark, expr, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(F.expr(expr).alias("y")).collect()]


def test_add_zeroes_text_padding(spark):
    got = _sql(spark, TX.add_zeroes_sql("x", 3), ["100", "0.05", "10.5", "2", "1.5", "1234", "-0.5"])
    assert got == ["100", "0.0500", "10.5", "2.00", "1.50", "1234", "-0.500"]


def test_number_text(spark):
    got = _sql(spark, TX.num_text_sql("x"), [1e-4, 100.0, 123456789.0, 0.0, -2.5], "double")
    assert got == ["0.0001", "100", "123456789", "0", "-2.5"]
    assert _sql(spark, TX.fg_sql("x", 3), [1234.4, 0.012345, 2.5, 117.34], "double") == \
        ["1234", "0.0123", "2.5", "117"]
    assert _sql(spark, TX.signif_text_sql("x", 3), [0.00012345, 98765.0], "double") == ["0.000123", "98800"]


def test_p_labels(spark):
    assert _sql(spark, TX.p_label_sql("x"), [0.0004, 0.0423, None], "double") == [" < 0.001", " = 0.042", None]
    assert _sql(spark, TX.p_cell_sql("x", 3, None), [0.0, 0.0423], "double") == ["< 0.001", "0.0423"]
    assert _sql(spark, TX.p_cell_sql("x", 3, 0.001), [0.0004], "double") == ["< 0.001"]


def test_mean_se_cell(spark):
    df = spark.createDataFrame([(596.75, 106.606265, 4)], "m double, s double, n long")
    assert df.select(F.expr(TX.mean_se_cell_sql("m", "s", "n"))).first()[0] == "597 $\\pm$ 107 (4)"
    staged = TX.text_cells(df, {"a": "m", "b": "s"}, 3, fg=True).first()
    assert (staged.a, staged.b) == ("597", "107")


def test_signif_forms_agree(spark):
    vals = [123456.789, 0.000123456, -98.7654, 0.0, None, 1.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    a = [r[0] for r in df.select(signif(F.col("x"), 3)).collect()]
    b = [r[0] for r in signif_columns(df, ["x"], 3).collect()]
    assert a == b
    assert a[:4] == [123000.0, 0.000123, -98.8, 0.0]


def test_spread_strict_and_gather_identity(spark):
    long = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], "id int, k string, v double")
    wide = R.spread(long, ["id"], "k", "v", ["a", "b"])
    back = R.gather(wide, ["id"], "k", "v").dropna(subset=["v"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, long.collect()))
    dup = long.unionByName(long.limit(1))
    with pytest.raises(R.SpreadError):
        R.assert_no_duplicates(R.spread(dup, ["id"], "k", "v", ["a", "b"], strict=True))


def test_split_index_and_copy_levels(spark):
    df = spark.createDataFrame([("b[3]",), ("Omega[1,2]",), ("sigma",)], "par string")
    out = R.split_index(df, "par", "name", ["i", "j"]).collect()
    assert [(r.name, r.i, r.j) for r in out] == [("b", "3", None), ("Omega", "1", "2"), ("sigma", None, None)]
    t = spark.createDataFrame([("gsmax", "ww"), ("kcatc", None)], "trait string, treatment string")
    c = R.copy_to_levels(t, "treatment", ["ww", "wd"], F.col("treatment").isNull())
    assert sorted(map(tuple, c.collect())) == [("gsmax", "ww"), ("kcatc", "wd"), ("kcatc", "ww")]


def test_csv_bom_crlf_no_final_newline(spark, tmp_path):
    p = tmp_path / "k.csv"
    p.write_bytes("﻿spp,trait,value\r\nANT,kcatc,2.5\r\nANT,sco,NA".encode("utf-8"))
    df = io.read_excel_twin(spark, str(p))
    rows = df.collect()
    assert df.columns == ["spp", "trait", "value"]
    assert [(r.spp, r.trait, r.value) for r in rows] == [("ANT", "kcatc", 2.5), ("ANT", "sco", None)]


def test_text_padding_of_numbers_read_as_text(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a\n100\n0.05\n10.5\n")
    df = io.read_csv(spark, str(p), T.StructType([T.StructField("a", T.StringType())]))
    got = [r[0] for r in df.select(F.expr(TX.add_zeroes_sql("a", 3))).collect()]
    assert got == ["100", "0.0500", "10.5"]


def test_number_text_of_very_small_and_large_numbers(spark):
    import duckdb
    cases = {1.23e-12: "0.00000000000123", 4.5e-11: "0.000000000045", 1e30: "1" + "0" * 30, -2.5e-7: "-0.00000025", 0.0: "0",
             1e-12: "0.000000000001", 9.99e-5: "0.0000999", 123000.0: "123000", -1.5e20: "-15" + "0" * 19, 0.0012: "0.0012"}
    df = spark.createDataFrame([(float(v),) for v in cases], "x double").withColumn("k", F.col("x"))
    got = {r.k: r.t for r in TX.text_cells(df, {"t": "x"}, 3).collect()}
    assert got == cases
    for v, t in cases.items():
        sql = f"WITH a AS (SELECT CAST({v!r} AS DOUBLE) AS x), b AS (SELECT {TX.signif_sql('x', 3)} AS y FROM a)"
        assert duckdb.execute(f"{sql} SELECT {TX.num_text_any_sql('y')} FROM b").fetchone()[0] == t, v


def test_drop_units_strips_the_unit_only(spark):
    from traitlab.functions import units as U
    df = U.with_unit(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), "a", "um")
    out = U.drop_units(df)
    assert U.unit_of(df, "a") == "um" and U.unit_of(out, "a") is None and out.first() == df.first()


def test_round_half_even(spark):
    from traitlab.functions.numeric import round_half_even
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (0.125,), (None,)], "x double")
    got = [tuple(r) for r in df.select(round_half_even("x").alias("a"), round_half_even("x", 2).alias("b")).collect()]
    assert [a for a, _ in got] == [0.0, 2.0, 2.0, 0.0, 0.0, None] and got[4][1] == 0.12
