"""Trait tables from CSV files written here, against plain Python on the same
rows.  The files carry the traps of real ones: byte-order mark, CRLF line
ends, no final newline, NA, columns in another order, one surface missing."""

import math
import statistics as st

import pytest
from pyspark.sql import functions as F

from traitlab.functions import biophysics, units
from traitlab.operators import summary as S
from traitlab.operators import traits as TR
from traitlab.sources import io

KEYS = ["spp", "treatment", "rep"]
SPECIES, TREATMENTS = ["ALB", "BET", "GAM"], ["WW", "WD"]


def surface_rows():
    rows = []
    for i, s in enumerate(SPECIES):
        for j, t in enumerate(TREATMENTS):
            for rep in range(1, 5 if (s, t) != ("GAM", "WD") else 4):
                for k, side in enumerate(("aB", "aD")):
                    sd = round(30 + 11.37 * i + 5.21 * j + 1.93 * rep + 7.7 * k, 4)
                    sp = round(18 + 1.71 * i + 0.83 * j + 0.59 * rep - 0.41 * k, 4)
                    if (s, t, rep, side) == ("BET", "WW", 2, "aD"):
                        sd = None
                    rows.append((s, t, str(rep), side, sd, round(0.1 + 0.01 * rep, 3), sp))
    return rows


def leaf_rows():
    rows = [(s, t, str(rep), float(400 + 37 * i + 11 * rep), None if (i + rep) % 4 == 0 else round(0.05 + 0.013 * rep + 0.02 * i, 4))
            for i, s in enumerate(SPECIES) for t in TREATMENTS for rep in range(1, 5)]
    return [r for r in rows if r[:3] != ("ALB", "WW", "1")]


def trait_rows():
    return [(s, t, round(b + 0.31 * i + 0.07 * k, 3)) for i, s in enumerate(SPECIES)
            for t, b in (("kcatc", 2.1), ("sco", 101.5)) for k in range(3 + i)]


def cell(v):
    return "NA" if v is None else str(v)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("csv")
    head = "spp,treatment,rep,surface,sd,si,sp"
    (d / "surface.csv").write_text("\n".join([head, *(",".join(map(cell, r)) for r in surface_rows())]) + "\n")
    # columns in another order, and one that nobody asked for
    (d / "leaf.csv").write_text("\n".join(["gs,note,rep,treatment,spp,LA1", *(
        ",".join(map(cell, (r[4], "x", r[2], r[1], r[0], r[3]))) for r in leaf_rows())]) + "\n")
    body = "\r\n".join(["spp,trait,value", *(",".join(map(cell, r)) for r in trait_rows())])
    (d / "traits.csv").write_bytes(b"\xef\xbb\xbf" + body.encode())
    (d / "short.csv").write_text("spp,treatment\nALB,WW\n")
    (d / "bad.csv").write_text("spp,trait,value\nALB,sco,abc\n")
    return d


@pytest.fixture(scope="module")
def surfaces(spark, folder):
    return io.read_csv(spark, str(folder / "surface.csv"), io.SURFACE_SCHEMA)


@pytest.fixture(scope="module")
def leaves(spark, folder):
    return io.read_csv(spark, str(folder / "leaf.csv"), io.LEAF_SCHEMA)


@pytest.fixture(scope="module")
def plants(surfaces):
    return TR.plants(surfaces)


def plain_plants():
    by = {}
    for s, t, r, side, sd, _, sp in surface_rows():
        by.setdefault((s, t, r), {})[side] = (sd, sp)
    out = {}
    for k, v in by.items():
        (a, p), (b, q) = v["aB"], v["aD"]
        sd = None if a is None or b is None else a + b
        sp = (p + q) / 2
        g = None if sd is None else biophysics.B_CONST * biophysics.M_CONST * sd * math.sqrt(0.5 * (2 * sp) ** 2)
        out[k] = (sd, sp, g)
    return out


def test_scan_counts_nulls_and_order(surfaces, leaves, spark, folder):
    assert [tuple(r) for r in surfaces.collect()] == surface_rows()
    assert [tuple(r) for r in leaves.collect()] == leaf_rows()
    t = io.read_excel_twin(spark, str(folder / "traits.csv"))
    assert t.columns == ["spp", "trait", "value"] and [tuple(r) for r in t.collect()] == trait_rows()


def test_scan_refuses_missing_columns_and_bad_numbers(spark, folder):
    with pytest.raises(ValueError, match="no column rep"):
        io.read_csv(spark, str(folder / "short.csv"), io.LEAF_SCHEMA)
    with pytest.raises(Exception, match="abc|MALFORMED|FAILFAST"):
        io.read_csv(spark, str(folder / "bad.csv"), io.LONG_TRAIT_SCHEMA).collect()
    loose = io.read_csv(spark, str(folder / "bad.csv"), io.LONG_TRAIT_SCHEMA, strict=False).first()
    assert tuple(loose) == ("ALB", "sco", None)


def test_constants():
    assert biophysics.B_CONST == pytest.approx(0.001111607142857143, rel=1e-15)
    assert biophysics.M_CONST == pytest.approx(0.4320531824955447, rel=1e-15)


def test_pair_collapse_and_gsmax(plants):
    got = {(r.spp, r.treatment, r.rep): (r.sd, r.sp, r.gsmax) for r in plants.collect()}
    want = plain_plants()
    assert set(got) == set(want)
    for k, v in want.items():
        assert [x is None for x in got[k]] == [x is None for x in v]
        assert [x for x in got[k] if x is not None] == pytest.approx([x for x in v if x is not None], rel=1e-12), k
    assert units.unit_of(plants, "gsmax") == "mol/m^2/s"


def test_gsmax_distribution(plants):
    g = [v[2] for v in plain_plants().values() if v[2] is not None]
    s = S.global_stats(plants.dropna(subset=["sd", "sp"]), "gsmax").first()
    assert s.n == len(g)
    assert (s.min, s.max, s["mean"], s.median) == pytest.approx((min(g), max(g), st.mean(g), st.median(g)), rel=1e-12)


def test_group_summary_complete_plants(plants):
    by = {}
    for (s, t, _), v in plain_plants().items():
        if v[0] is not None:
            by.setdefault((s, t), []).append(v)
    g = S.group_summary(plants.dropna(subset=["sd", "sp"]), ["spp", "treatment"], ["sd", "sp", "gsmax"], null_skipping=False)
    rows = {(r.spp, r.treatment): r for r in g.collect()}
    assert set(rows) == set(by)
    for k, vs in by.items():
        r = rows[k]
        assert r.n == len(vs)
        for i, c in enumerate(("sd", "sp", "gsmax")):
            x = [v[i] for v in vs]
            assert r[c] == pytest.approx(st.mean(x), rel=1e-12)
            assert r[f"sd_{c}"] == pytest.approx(st.stdev(x), rel=1e-9)
            assert r[f"se_{c}"] == pytest.approx(st.stdev(x) / math.sqrt(len(x)), rel=1e-9)
            assert r[f"lower_{c}"] == pytest.approx(r[c] - r[f"se_{c}"])


def test_full_join_counts(plants, leaves):
    p, q = set(plain_plants()), {r[:3] for r in leaf_rows()}
    j = TR.join_plants(plants, leaves, KEYS, "full", indicator="side")
    counts = {r.side: r.c for r in j.groupBy("side").agg(F.count("*").alias("c")).collect()}
    assert counts == {"both": len(p & q), "left_only": len(p - q), "right_only": len(q - p)}
    only = j.where(F.col("side") == "left_only").first()
    assert (only.spp, only.treatment, only.rep) == ("ALB", "WW", "1")


def test_complete_cases(plants, leaves):
    gs = {r[:3]: r[4] for r in leaf_rows()}
    both = [v[2] for k, v in plain_plants().items() if v[2] is not None and gs.get(k) is not None]
    c = TR.join_plants(plants, leaves, KEYS, "full").dropna(subset=["gs", "gsmax"])
    r = c.agg(F.min("gsmax"), F.max("gsmax"), F.count("*")).first()
    assert tuple(r) == pytest.approx((min(both), max(both), len(both)), rel=1e-12)


def test_null_skipping_cells(plants, leaves):
    j = TR.join_plants(leaves, plants, KEYS, "full")
    rows = {(r.spp, r.treatment): r for r in S.group_summary(j, ["spp", "treatment"], ["LA1", "gs", "sd"], null_skipping=True).collect()}
    for s in SPECIES:
        for t in TREATMENTS:
            gs = [r[4] for r in leaf_rows() if r[:2] == (s, t) and r[4] is not None]
            r = rows[(s, t)]
            assert r.n_gs == len(gs) and r.gs == pytest.approx(st.mean(gs), rel=1e-12)
            assert r.se_gs == pytest.approx(st.stdev(gs) / math.sqrt(len(gs)), rel=1e-9)
    assert rows[("BET", "WW")].n_sd == 3


def test_long_traits(spark, folder):
    t = io.read_excel_twin(spark, str(folder / "traits.csv"))
    rows = {(r.spp, r.trait): r for r in S.group_summary(t, ["spp", "trait"], ["value"], null_skipping=True, bounds=False).collect()}
    for k, r in rows.items():
        x = [v for s, tr, v in trait_rows() if (s, tr) == k]
        assert r.n_value == len(x) and r.value == pytest.approx(st.mean(x), rel=1e-12)
    assert len(rows) == 6
