"""Plans stay small: how many exchanges and scans the larger jobs have."""

from pyspark.sql import functions as F

from phrasemill.operators import bibliography as b
from phrasemill.plans import bibliography as bib
from phrasemill.plans import generation as gen


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merge_reads_the_cleaned_table_few_times(spark, small):
    cleaned = bib.cleaned(spark, small)
    text = plan(b.merge_sources(cleaned))
    assert text.count("FileScan") == 4 and text.count("Exchange") <= 12
    assert plan(b.clean_records(bib.raw(spark, small))).count("orders.parquet") == 1


def test_generation_is_a_chain_of_small_plans(spark, small):
    text = plan(gen.made(spark, small, gen.requests(spark, small).where("req_id % 2 = 0")))
    assert text.count("Exchange") < 40 and "BatchEvalPython" not in text


def test_pool_filters_reach_the_scan(spark, small):
    text = plan(bib.pools(spark, small).where("slot_type = 'of_object'").select("filler"))
    assert "PushedFilters: [IsNotNull(slot_type), EqualTo(slot_type,of_object)]" in text and "freq" not in text.split("ReadSchema")[1]


def test_trials_meet_no_single_task(spark, small):
    """Log scans cut an order into ranges: only the ranges' totals, a row each, meet in one task."""
    log = gen.fixtures.view(spark, small, "experiments").withColumn("composite", F.col("quality"))
    from phrasemill.operators import tuning

    for text in (plan(tuning.running_best(log)), plan(tuning.keep_or_discard(log, 0.1)), plan(tuning.pareto(log))):
        assert text.count("SinglePartition") == 1 and "HashAggregate(keys=[_range" in text.split("SinglePartition")[1].split("Exchange hashpartitioning")[0]
