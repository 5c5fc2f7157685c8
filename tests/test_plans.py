"""Physical plans: no nested loops, no Python, filters and columns reach the scan."""

import glob
import time

import pytest
from pyspark.sql import functions as F

from curbledger.plans.registry import REGISTRY
from curbledger.session import CLEANUP, stored

SMALL = "/root/testdata/sf0.001"
LAZY = [
    "calc_bills", "calc_bills_unbilled", "schedule", "overdue", "plan_validity", "leave_units", "referral_counts", "service_extras",
    "census_long", "census_terminations", "settle_probes", "phone_candidates", "location_fill", "price_list", "constraint_audit",
]


def plan(spark, name):
    return REGISTRY[name].frame(spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_joins_have_keys(spark, name):
    text = plan(spark, name)
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert word not in text


def test_bill_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "calc_bills")
    assert "LessThanOrEqual(start_dtm,1998-06-30)" in text
    assert "srv_floor" not in text and "rotation" not in text


def test_census_dates_reach_both_scans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # else the lists of filters are cut
    pushed = [line for line in plan(spark, "census_terminations").splitlines() if "PushedFilters" in line]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert any("GreaterThanOrEqual(end_dtm,1997-12-31)" in line and "LessThan(end_dtm,1998-06-30)" in line for line in pushed)
    assert any("GreaterThanOrEqual(end_dtm,1997-12-31)" in line and "LessThan(start_dtm,1998-06-30)" in line for line in pushed)


def test_stored_leaves_no_shuffle_files(spark):
    """A pipeline stage must not carry the shuffle files of the stages before it."""
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    before, setting = files(), spark.conf.get(CLEANUP, None)
    rows = stored(spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).count())
    for _ in range(50):  # files go in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(CLEANUP, None) == setting
    assert rows.count() == 1000 and rows.count() == 1000
