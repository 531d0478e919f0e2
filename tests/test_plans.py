"""Plans: exchanges, scans and aggregations that the queries must (not) have."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from purchaseflow.plans.registry import QUERIES
from purchaseflow.plans.state_queries import labelled_docs


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("partitions", ["1", "64"])
@pytest.mark.parametrize("name", ["q01_price_lenient", "q02_price_strict", "q03_date_ladder", "q04_date_fallback",
                                  "q05_quantity", "q24_json_export"])
def test_row_local_queries_do_not_shuffle(spark, sf_small, name, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert "Exchange" not in plan_of(QUERIES[name](spark, sf_small))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", ["q14_state_split", "q15_pending", "q16_upsert", "q17_placeholders", "q18_skipped",
                                  "q22_state_counts", "q33_run_order"])
def test_latest_attempts_are_hash_aggregated(spark, sf_small, name):
    plan = plan_of(QUERIES[name](spark, sf_small))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("name", ["q19_progress", "q31_retry_plan"])
def test_running_counts_read_their_rows_once(spark, sf_small, name):
    # The windowed rows are checkpointed: what is left reads them, not the events.
    plan = plan_of(QUERIES[name](spark, sf_small))
    assert "events" not in plan and "Scan ExistingRDD" in plan


@pytest.mark.parametrize("name", ["q12_label_dispatch", "q13_cell_pivot"])
def test_labelled_documents_stay_in_their_rows(spark, sf_small, name):
    plan = plan_of(QUERIES[name](spark, sf_small))
    assert plan.count("Exchange") == plan_of(labelled_docs(spark, sf_small)).count("Exchange")
    assert plan.count("from_json") == 1


def test_offline_extraction_has_no_python(spark, sf_small):
    plan = plan_of(QUERIES["q30_extract_offline"](spark, sf_small))
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_entry_works_without_the_training_data_operators():
    assert set(entry.queries()) == {*QUERIES, *entry.LLM_QUERIES}


def test_item_passes_write_each_value_once(spark):
    """q30 (F5): the JSON text of an item's quantity and price is written in one place each, not in three."""
    from pyspark.sql import functions as F

    from purchaseflow.operators.receipts import valid_items
    df = spark.createDataFrame([('{"items": [{"description": "a", "quantity": 2.50, "price": "$3"}, 1]}',)], "r string")
    items = df.select(valid_items(F.try_parse_json("r")).alias("items"))
    assert plan_of(items).count("StructsToJsonEvaluator(") <= 2
    assert [tuple(i) for i in items.first().items] == [("a", 2.5, "2.5", 3.0)]
