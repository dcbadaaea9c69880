"""Physical-plan properties the scale design relies on."""

from tessera.registry import load_all

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    df = load_all()[name].run(spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_outlier_bounds_reach_the_scan(spark):
    plan = _plan(spark, "m10_remove_outliers_iqr_gappy")
    pushed = [l for l in plan.splitlines() if "PushedFilters" in l][0]
    assert "GreaterThanOrEqual(l_quantity" in pushed and "LessThanOrEqual(l_extendedprice" in pushed


def test_range_filter_pushed_and_columns_pruned(spark):
    plan = _plan(spark, "f1_range_filter_lineitem")
    scan = [l for l in plan.splitlines() if "FileScan" in l][0]
    assert "GreaterThanOrEqual(l_quantity,10.0)" in scan
    assert "l_extendedprice" not in scan and "l_comment" not in scan


def test_performance_index_has_no_window_and_two_exchanges(spark):
    plan = _plan(spark, "p13_performance_index")
    assert "Window" not in plan
    assert plan.count("Exchange hashpartitioning") == 2


def test_auc_has_no_single_partition_window(spark):
    plan = _plan(spark, "v5_auc_lineitem")
    for line in plan.splitlines():
        if "Window [" in line:
            assert "bucket" in line  # partitioned by score range, never global


def test_profile_is_one_scan_per_family(spark):
    plan = _plan(spark, "q2_profile_gappy")
    # moments + quantiles in one aggregate; one frequency table per type family
    assert plan.count("FileScan") <= 3


def test_decay_points_are_dealt_by_id_after_one_grouping(spark, sf):
    """The groupings that collect a sample's points run on partitions of their own, not in the tasks of the view's aggregation."""
    from tessera.operators import halflife as H
    from tessera.sources import views as V

    d = V.decay_long(spark, sf)
    assert d.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    plan = H.points_from_long(d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "REPARTITION_BY_NUM" in plan
    assert plan.index("collect_list") < plan.index("REPARTITION_BY_NUM")
    rows = {r["id"]: [(p["t"], p["y"]) for p in r["pts"]] for r in H.points_from_long(d).collect()}
    want = {}
    for r in d.where("y is not null").collect():
        want.setdefault(r["id"], []).append((float(r["t"]), r["y"]))
    assert rows == {k: sorted(v) for k, v in want.items()}
