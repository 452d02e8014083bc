"""Gaps between neighbours of a ranking."""

from pyspark.sql import DataFrame, functions as F

from triarm.functions.scoring import odds_ratio
from triarm.operators.prefix import positions_by_value


def rank_gaps(df: DataFrame, score: str, tie: str) -> DataFrame:
    """Accuracy difference and odds ratio of each entry over the next one.

    Every entry is sent to its own rank and, as the runner-up, to the rank above;
    the two meet in an aggregate, so no global sort is needed.
    """
    ranked = positions_by_value(df.select(score, tie), "_pos", [], score, tie, descending=True)
    nothing = F.lit(None).cast("double")
    own = F.struct((F.col("_pos") + 1).alias("rank"), F.col(score).alias("score"), nothing.alias("next_score"))
    above = F.struct(F.col("_pos").alias("rank"), nothing.alias("score"), F.col(score).alias("next_score"))
    met = ranked.select(F.inline(F.array(own, above))).groupBy("rank").agg(
        F.max("score").alias("score"), F.max("next_score").alias("next_score")
    )
    return met.where("score is not null and next_score is not null").select(
        "rank", "score", "next_score",
        (F.col("score") - F.col("next_score")).alias("gap"),
        odds_ratio(F.col("score"), F.col("next_score")).alias("odds_ratio"),
    )
