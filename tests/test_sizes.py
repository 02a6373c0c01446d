"""What a task holds stays the same as the tables grow, and what is read more than once is worked out once."""

import pytest
from duebook.functions import spread
from duebook.plans import imports, models
from duebook.plans import registered as queries
from duebook.plans import views

from compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("view", [views.bills, views.sourced_payments, views.payments_by_invoice])
def test_tasks_grow_with_the_line_items(spark, monkeypatch, view):
    monkeypatch.setattr(spread, "ROWS", 200)
    lines = views.size(spark, SF, "lineitem")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large to be sent whole
    try:
        assert lines > 200 * 16 and view(spark, SF).rdd.getNumPartitions() == -(-lines // 200)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["backfilled_keys", "payment_mismatches", "row_counts", "eligible_payments", "identity_report", "customer_sets", "first_settlement", "target_summary", "targets"])
def test_same_results_over_more_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(spread, "ROWS", 500)
    got, want = compare(spark, duck(SF), queries.QUERIES[name], queries.SQL[name], SF)
    assert got == want and got[1]


@pytest.mark.parametrize("name", ["prediction_page", "classification_metrics", "calibration_bins", "invoices_by_risk", "training_history", "imputed_features"])
def test_what_is_read_again_is_a_table(spark, name):
    files = queries.QUERIES[name](spark, SF).inputFiles()
    assert files and not any(part in f for f in files for part in ("lineitem.parquet", "/erp-"))


def test_matrix_is_a_table(spark):
    files = models._matrix(spark, SF).inputFiles()
    assert files and all("/matrix-" in f for f in files)


def test_rows_of_an_import_are_shuffled_few_times(spark):
    """What names a customer is resolved once for equal rows, and invoices and payments are met by one shuffle each; it took 42 with a join for each step."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = imports._classified(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= 32
