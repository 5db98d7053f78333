"""Sources/sinks round trips and plan-shape checks (scale rules)."""

import re

from pyspark.sql import functions as F

import __spark_entry__
from helpers import SF01, need
from traitlab.operators import draws as D
from traitlab.operators.ranking import group_quantiles, rank_within, tails
from traitlab.plans import views as V
from traitlab.session import scratch_path
from traitlab.sources import io


def _draws(spark):
    rows = [(m, c, i, p, float(i * (c + 1))) for m in ("m1", "m2") for c in range(2) for i in range(1, 6)
            for p in ("b[1]", "b[2]", "sigma")]
    return spark.createDataFrame(rows, io.DRAWS_SCHEMA)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_draws_store_roundtrip_prunes_models(spark):
    root = scratch_path(spark, "test-store")
    io.write_draws(_draws(spark), root)
    back = io.read_draws(spark, root, models=["m2"])
    assert back.count() == 30
    assert "PartitionFilters: [isnotnull(model" in plan_of(back) and "m2" in plan_of(back)
    sel = io.select_pars(back, ["b"])
    assert sorted({r.par for r in sel.collect()}) == ["b[1]", "b[2]"]
    assert "StringStartsWith(par,b[)" in plan_of(sel)


def test_a_model_that_looks_like_a_number_stays_text(spark):
    root = scratch_path(spark, "test-store")
    io.write_draws(_draws(spark).withColumn("model", F.lit("2024")), root)
    back = io.read_draws(spark, root)
    assert back.schema == io.DRAWS_SCHEMA and {r.model for r in back.select("model").distinct().collect()} == {"2024"}


def test_views_follow_rewritten_inputs(spark, tmp_path):
    for n in (100, 1000):
        (spark.range(n).select(F.col("id").alias("event_id"), F.lit("a").alias("event_type"), F.col("id").cast("double").alias("value"))
         .write.mode("overwrite").parquet(f"file://{tmp_path}/events.parquet"))
        assert V.draws_events(spark, f"file://{tmp_path}").count() == n


def test_materialize_reuses_stored_copy(spark):
    path = scratch_path(spark, "test-mat")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    assert io.materialize(spark, path, build).count() == 5
    assert io.materialize(spark, path, build).count() == 5
    assert len(calls) == 1
    io.materialize(spark, path, build, rerun=True)
    assert len(calls) == 2


def test_write_table_and_read_back(spark):
    df = spark.createDataFrame([(1, "a", "x - y"), (0, "", "unit $\\pm$")], "sort_key int, s string, t string")
    path = scratch_path(spark, "test-table")
    io.write_table(df, path, order_by=["sort_key"])
    back = io.read_table(spark, path, "sort_key int, s string, t string")
    assert sorted(map(tuple, back.collect())) == [(0, "", "unit $\\pm$"), (1, "a", "x - y")]


def test_rank_within_has_no_single_partition_window(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") * 7 % 101).alias("v"))
    for keys in (["g"], []):
        r = rank_within(df, keys, "v", ["id"])
        lines = plan_of(r).splitlines()
        windows = [i for i, ln in enumerate(lines) if "Window [" in ln]
        assert windows
        for i in windows:   # the exchange feeding each window is hash-partitioned
            below = next(ln for ln in lines[i + 1:] if "Exchange" in ln)
            assert "hashpartitioning" in below and "SinglePartition" not in below
        ref = {row.id: row.rn for row in r.collect()}
        assert len(ref) == 1000


def test_filters_and_columns_reach_the_scan(spark):
    need(f"{SF01}/lineitem.parquet")
    ds = V.draws_species(spark, SF01)
    p = plan_of(ds)
    assert "ReadSchema: struct<l_suppkey:bigint,l_linenumber:int,l_quantity:double," in p
    li = V.table(spark, SF01, "lineitem").where(F.col("l_linestatus") == "F").select("l_orderkey")
    p2 = plan_of(li)
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,F)]" in p2
    assert "ReadSchema: struct<l_orderkey:bigint,l_linestatus:string>" in p2


def test_bootstrap_and_grid_do_not_join(spark):
    from traitlab.operators import fit as FT
    from traitlab.operators import perdraw as PD
    df = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 1.5).alias("y"), F.col("id").cast("double").alias("x"))
    p = plan_of(FT.bootstrap_draws(df, "k", "y", "x", replicates=20))
    # replicates are generated in place; the only join attaches the one-row centres
    assert "CartesianProduct" not in p and "SortMergeJoin" not in p and "ShuffledHashJoin" not in p
    assert "BroadcastNestedLoopJoin" not in p or "BuildRight" in p
    g = PD.with_grid(spark.range(3).select(F.col("id").alias("iter")), spark.range(1).select(
        F.lit(0.0).alias("_glo"), F.lit(1.0).alias("_ghi")), n=10)
    pg = plan_of(g)
    # the one-row bounds are attached by broadcast; no Cartesian product, no shuffle of rows
    assert "CartesianProduct" not in pg
    assert "BroadcastNestedLoopJoin" not in pg or "BuildRight" in pg
    assert g.count() == 30


def test_hpd_self_join_is_keyed_on_rank(spark):
    rows = [("m", 0, i, "a", float(i % 17)) for i in range(1, 200)]
    df = spark.createDataFrame(rows, io.DRAWS_SCHEMA)
    p = plan_of(D.hpd_interval(df))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_cleanup_scratch_removes_only_session_files(spark):
    from traitlab.session import cleanup_scratch, path_exists, scratch_path, scratch_root, shared_root
    p = scratch_path(spark, "to-clean")
    spark.range(3).write.parquet(p)
    assert path_exists(spark, p) and p.startswith(scratch_root(spark))
    cleanup_scratch(spark)
    assert not path_exists(spark, p)
    assert path_exists(spark, shared_root(spark))


def test_no_query_plans_a_cartesian_product(spark):
    """Every registered query: no CartesianProduct, and any nested-loop
    join has a broadcast build side (the one-row attach)."""
    from helpers import SF001
    need(f"{SF001}/lineitem.parquet")
    import __spark_entry__ as E
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name, q in E.REGISTRY.items():
            p = plan_of(q.run(spark, SF001))
            assert "CartesianProduct" not in p, name
            for ln in p.splitlines():
                if "BroadcastNestedLoopJoin" in ln:
                    assert "BuildRight" in ln or "BuildLeft" in ln, name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_materialize_follows_inputs_and_parameters(spark):
    path, calls = scratch_path(spark, "test-stale"), []

    def run(values, **params):
        src = spark.createDataFrame([(v,) for v in values], "v int")

        def build():
            calls.append(values)
            return src.agg(F.sum("v").alias("s"))

        return io.materialize(spark, path, build, inputs={"src": src}, params=params).first().s

    assert run([1, 2, 3]) == 6 and run([1, 2, 3]) == 6 and run([3, 1, 2]) == 6  # order does not count
    assert len(calls) == 1
    assert run([1, 2, 4]) == 7 and len(calls) == 2  # as many rows, other values
    assert run([1, 1, 5]) == 7 and len(calls) == 3  # even with an equal sum
    assert run([1, 1, 5], draws=10) == 7 and len(calls) == 4
    assert run([1, 1, 5], draws=10) == 7 and len(calls) == 4
    # a copy without a manifest is stale; one without inputs is not looked at
    assert io.materialize(spark, path, lambda: spark.range(1)).first().s == 7
    io.materialize(spark, path, lambda: spark.createDataFrame([(9,)], "s int"), rerun=True)
    assert run([1, 1, 5], draws=10) == 7 and len(calls) == 5


def test_fingerprint_of_columns_of_any_type(spark):
    df = spark.sql("SELECT map('a', 1) AS m, array(1, NULL) AS a, CAST(NULL AS STRING) AS s, struct(1 AS x) AS st")
    a, b = io.fingerprint(df), io.fingerprint(df.withColumn("m", F.expr("map('a', 2)")))
    assert a["rows"] == 1 and a["sum"] != b["sum"] and a == io.fingerprint(df)


def test_rows_of_few_groups_are_not_shuffled_by_group(spark):
    df = spark.range(3_000_000).select((F.col("id") % 3).alias("par"), (F.col("id") % 50).cast("double").alias("value"), F.col("id").alias("iter"))
    for out in (group_quantiles(df, ["par"], "value", [0.5]), tails(df, ["par"], "value", 0.05, ["iter"]),
                rank_within(df, ["par"], "value", ["iter"])):
        assert not re.search(r"SortMergeJoin \[_g#\d+\],", plan_of(out))


def test_summaries_read_bootstrap_replicates_that_are_written(spark):
    for name, work in (("bootstrap_regression_summary", "sha2("), ("bootstrap_species", "md5(")):
        assert work not in plan_of(__spark_entry__.queries()[name](spark, "/root/testdata/sf0.001"))
