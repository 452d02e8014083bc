"""Properties of the plans that matter on large tables."""

import re

import pytest
from pyspark.sql import functions as F

from triarm.operators import posterior, prefix, sampling, summary
from triarm.plans import all_queries, inputs
from triarm.sources import scratch
from triarm.sources.specs import REGISTRY


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(df):
    return re.findall(r"ReadSchema: struct<([^>]*)", plan(df))


def test_accuracies_are_combined_before_the_shuffle(spark, sf_dir):
    text = plan(inputs.accuracies(spark, sf_dir))
    assert "partial_count" in text
    assert text.count("Exchange hashpartitioning") == 2
    assert text.count("FileScan") == 1


def test_quotas_and_counts_read_no_text(spark, sf_dir):
    quotas = sampling.label_quotas(inputs.documents(spark, sf_dir), 40, [])
    assert all("text" not in columns for columns in read_columns(quotas))


def test_filters_of_a_spec_reach_the_scan(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents").withColumn("label", F.lit(0))
    kept = REGISTRY["aladar/craigslist_bargains"].process(docs)
    assert re.search(r"PushedFilters: \[IsNotNull\(text\)", plan(kept))


def test_several_random_rows_are_limited_before_the_shuffle(spark, sf_dir):
    sample = sampling.down_sample(inputs.accuracies(spark, sf_dir), ["num_train", "num_test", "subsample_idx"], 5)
    assert "WindowGroupLimit" in plan(sample)


@pytest.mark.parametrize("rows", [100, 10**6])
def test_positions_bring_the_rows_together_once(spark, sf_dir, rows):
    docs = inputs.documents(spark, sf_dir).select("label", "row_id", "text")
    placed = prefix.total_before(docs, "pos", ["label"], F.col("row_id"), [F.col("row_id")], rows=rows)
    # Only one branch carries the text, and it is shuffled at most once.
    assert sum("text" in columns for columns in read_columns(placed)) == 1


def test_draws_are_read_once(spark, tmp_path):
    rows = [("bias", 50, "a", "d", 0, m, i, 1.0) for m in ("test", "extra") for i in range(5)]
    names = "effect string, num_test int, lm_type string, dataset string, pair long, method string, draw int, pred double"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/draws")
    draws = spark.read.schema(names).parquet(f"{tmp_path}/draws")
    text = plan(posterior.marginal_differences(draws))
    assert text.count("FileScan") == 1 and "Join" not in text and "partial_avg" in text


def test_summary_of_a_table_is_one_scan(spark, sf_dir):
    text = plan(summary.summary_table(inputs.accuracies(spark, sf_dir)))
    assert text.count("FileScan") == 1 and "Join" not in text


def test_same_rows_under_other_partition_counts(spark, sf_dir):
    names = ("summary_table", "rank_gaps", "spearman_groups")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for partitions in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            queries = all_queries()
            results.append([sorted(map(tuple, queries[n].run(spark, sf_dir).collect()), key=repr) for n in names])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_broadcast_only_below_the_bound(spark):
    df = spark.range(10)
    big = spark.range(100)
    hinted = lambda bound: "Broadcast" in plan(big.hint("merge").join(scratch.broadcast_bounded(df, bound), "id"))
    assert scratch.broadcast_bounded(df, scratch.BROADCAST_ROWS + 1) is df
    assert hinted(10)


@pytest.mark.parametrize("name", ["proc_len_filter", "proc_label_map", "prompt_query", "zero_shot_scores", "softmax"])
def test_row_wise_steps_do_not_shuffle(spark, sf_dir, name):
    assert "Exchange" not in plan(all_queries()[name].run(spark, sf_dir))


@pytest.mark.parametrize("name", ["meta_replicates", "down_sample", "random_example"])
def test_random_picks_are_not_sorted(spark, sf_dir, name):
    from triarm.plans import all_queries

    plan = all_queries()[name].run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
