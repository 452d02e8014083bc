"""Batches of consecutive rows, and prompts packed per batch."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from triarm.functions import prompts
from triarm.operators.prefix import total_before

TEXT_ROWS = 20_000  # rows with their texts that one task sorts


def with_batches(df: DataFrame, size: int, group: Sequence[str], key: str = "row_id") -> DataFrame:
    """Number the rows of a group by their integer key; every ``size`` of them are a batch."""
    if size < 1:
        raise ValueError("a batch holds at least one row")
    placed = total_before(df, "pos", group, F.col(key), [F.col(key)], rows=TEXT_ROWS)
    return placed.withColumn("batch", F.floor(F.col("pos") / size))


def packed_prompts(
    df: DataFrame, size: int, group: Sequence[str], instruction: Column, text: str = "text", key: str = "row_id"
) -> DataFrame:
    """One instruction and the queries of a batch, with blank lines between.

    A batch has at most ``size`` cut texts, so the collected list is bounded.
    """
    queries = with_batches(df.select(*group, key, prompts.query(F.col(text)).alias("_query")), size, group, key)
    batch = queries.groupBy(*group, "batch").agg(
        F.sort_array(F.collect_list(F.struct("pos", "_query"))).alias("_queries")
    )
    body = F.array_join(F.transform("_queries", lambda q: q["_query"]), "\n\n")
    return batch.select(
        *group, "batch", F.size("_queries").alias("n_texts"), F.concat(instruction, body).alias("prompt")
    )
