"""Driver contract: entry, queries, oracle texts; oracle spot checks."""

import math

import pytest

from helpers import SF001, SF01, need

import __spark_entry__ as E


def test_entry_runs_on_smallest_scale(spark):
    need(f"{SF001}/lineitem.parquet")
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:3] == ["spp", "treatment", "sd"]
    assert E.entry(spark).schema == df.schema


def test_every_own_query_has_an_oracle():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(E.REGISTRY) <= set(o)
    assert len(q) >= 47


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", ["pair_collapse", "trait_summary", "split_rhat", "interval_hdr_pieces",
                                  "partial_pooling_effects", "bayes_r2"])
def test_oracle_spot_checks(spark, name):
    duckdb = pytest.importorskip("duckdb")
    need(f"{SF01}/lineitem.parquet")
    con = duckdb.connect()
    from traitlab.plans.views import TABLES
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF01)
    rel = con.sql(E.oracle_sql()[name])
    assert sdf.columns == rel.columns
    a = sorted([tuple(_norm(x) for x in r) for r in sdf.collect()], key=str)
    b = sorted([tuple(_norm(x) for x in r) for r in rel.fetchall()], key=str)
    assert a == b


@pytest.mark.parametrize("name", ["interval_hpd", "treatment_ratio", "null_group_statistics"])
def test_oracle_with_hot_group_path(spark, monkeypatch, name):
    """The bucketed ranking (used when one group is too big for a task)
    gives exactly the oracle's answer on real queries."""
    from traitlab.operators import ranking
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 30)
    test_oracle_spot_checks(spark, name)
