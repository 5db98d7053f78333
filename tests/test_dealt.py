"""Draws dealt by draw: joins without an exchange, stores known again."""

import pytest
from pyspark.sql import functions as F

from traitlab.operators import perdraw as PD
from traitlab.session import path_exists, scratch_path
from traitlab.sources import dealt, io


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(model, n, pars, shift=0.0):
    return [(model, i % 3, i, f"b[{p}]", float((i * 7 + p * p * 3) % 11) + shift) for i in range(n) for p in range(pars)]


@pytest.fixture
def store(spark):
    root = scratch_path(spark, "test-dealt")
    a, b = rows("a", 300, 4), rows("b", 260, 5, 1.5)
    dealt.write_dealt(spark.createDataFrame(a, io.DRAWS_SCHEMA), root, buckets=6)
    dealt.add_dealt(spark.createDataFrame(b, io.DRAWS_SCHEMA), root)
    return root, a, b


def test_rows_come_back_and_models_prune(spark, store):
    root, a, b = store
    assert sorted(map(tuple, dealt.read_dealt(spark, root).collect())) == sorted(a + b)
    one = dealt.read_dealt(spark, root, models=["b"])
    assert sorted(map(tuple, one.collect())) == sorted(b)
    assert "PartitionFilters: [isnotnull(model" in plan_of(one) or "PartitionFilters: [" in plan_of(one) and "(model" in plan_of(one)


def test_joins_and_groupings_by_draw_need_no_exchange(spark, store):
    root, a, b = store
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the small tables of a test would be broadcast
    try:
        both = dealt.side_by_side(dealt.read_dealt(spark, root), {"x": F.col("model") == "a", "y": F.col("model") == "b"})
        r = PD.per_draw_correlation(both, ["chain", "iter"], [("xy", "x", "y")])
        mean = dealt.read_dealt(spark, root, models=["b"]).groupBy("chain", "iter").agg(F.avg("value").alias("m"))
        for how in ("left", "full", "inner"):
            j = r.join(mean, ["chain", "iter"], how)
            p = plan_of(j)
            assert "Exchange" not in p and "Bucketed: true" in p, how
            assert j.count() == {"left": 300, "full": 300, "inner": 260}[how]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    x, y = {(r[1], r[2], r[3]): r[4] for r in a}, {(r[1], r[2], r[3]): r[4] for r in b}
    assert {tuple(v) for v in both.collect()} == {(*k, x.get(k), y.get(k)) for k in x.keys() | y.keys()}


def test_a_session_that_does_not_know_the_store_reads_it(spark, store):
    root, a, b = store
    other = spark.newSession()
    name = dealt._manifest(spark, root)["table"]
    spark.sql(f"DROP TABLE {name}")
    df = dealt.read_dealt(other, root)
    assert sorted(map(tuple, df.collect())) == sorted(a + b)
    p = plan_of(df.groupBy("chain", "iter").agg(F.sum("value")))
    assert "Exchange" not in p and "Bucketed: true" in p


def test_one_file_per_model_and_bucket(spark, store):
    root, _, _ = store
    files = [f for f in dealt.read_dealt(spark, root).inputFiles()]
    assert len(files) <= 2 * 6 and {f.split("/")[-2] for f in files} == {"model=a", "model=b"}


def test_overwrite_doubled_models_and_interrupted_stores(spark, store):
    root, a, b = store
    with pytest.raises(ValueError, match="draws of b"):
        dealt.add_dealt(spark.createDataFrame(b, io.DRAWS_SCHEMA), root)
    assert dealt.read_dealt(spark, root).count() == len(a) + len(b)  # nothing was added
    c = rows("c", 10, 2)
    dealt.write_dealt(spark.createDataFrame(c, io.DRAWS_SCHEMA), root)  # the number of buckets follows the rows
    assert sorted(map(tuple, dealt.read_dealt(spark, root).collect())) == sorted(c)
    from traitlab.session import remove_file
    remove_file(spark, f"{root}/{dealt.MANIFEST}")
    with pytest.raises(ValueError, match="no finished store"):
        dealt.read_dealt(spark, root)
    assert path_exists(spark, root)


def test_nulls_and_an_empty_store(spark):
    root = scratch_path(spark, "test-dealt")
    odd = [("a", None, 1, "x", 1.0), ("a", 1, None, "x", 2.0), ("a", 1, 1, None, None), (None, 1, 1, "x", 3.0), ("a", 1, 1, "x", 4.0)]
    dealt.write_dealt(spark.createDataFrame(odd, io.DRAWS_SCHEMA), root, buckets=3)
    assert sorted(map(repr, (tuple(r) for r in dealt.read_dealt(spark, root).collect()))) == sorted(map(repr, odd))
    empty = scratch_path(spark, "test-dealt")
    dealt.write_dealt(spark.createDataFrame([], io.DRAWS_SCHEMA), empty)
    assert dealt.read_dealt(spark, empty).count() == 0
    dealt.add_dealt(spark.createDataFrame(odd[-1:], io.DRAWS_SCHEMA), empty)
    assert [tuple(r) for r in dealt.read_dealt(spark, empty).collect()] == odd[-1:]
