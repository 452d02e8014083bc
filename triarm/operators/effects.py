"""Effects of treatment over control on the log-odds scale."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from triarm.functions.draws import coefficients, draw_key, pick, row_words, seed_key
from triarm.functions.fixed_values import EFFECTS
from triarm.functions.scoring import logit

REPLICATES = 500  # fixed value: down-sampled experiments of the meta-analysis
META_SALT = "meta"
NEWTON_STEPS = 8


def _sums(effect: str) -> list[Column]:
    treatment, control = EFFECTS[effect]
    return [
        F.sum(treatment).cast("double").alias("_t"),
        F.sum(control).cast("double").alias("_c"),
        F.sum("num_test").cast("double").alias("_n"),
    ]


def _log_odds() -> Column:
    return logit(F.col("_t"), F.col("_n")) - logit(F.col("_c"), F.col("_n"))


def log_odds_effect(num_correct: DataFrame, effect: str, group: Sequence[str]) -> DataFrame:
    """Pooled log-odds difference and its standard error per group."""
    pooled = num_correct.groupBy(*group).agg(*_sums(effect))
    variance = F.lit(0.0)
    for arm in ("_t", "_c"):
        variance = variance + 1 / (F.col(arm) + 0.5) + 1 / (F.col("_n") - F.col(arm) + 0.5)
    return pooled.select(*group, F.lit(effect).alias("effect"), _log_odds().alias("log_odds"), F.sqrt(variance).alias("se"))


def meta_replicates(
    num_correct: DataFrame, names: Sequence[str], key: Sequence[str], replicates: int = REPLICATES, size: int = 1,
    config: Sequence[str] = (), seed: int = 0,
) -> DataFrame:
    """Effects ``names`` of experiments that keep ``size`` random subsamples per LM type and dataset, a row for each effect.

    Every replicate draws anew in every configuration, LM type and dataset. A row is hashed once, and its key in a
    replicate is two multiplications; equal keys are told apart by the row's hash. With one subsample each, the row
    with the smallest key survives the map side, for all effects at once.
    """
    cell = [*config, "replicate", "lm_type", "dataset"]
    own = F.concat_ws("|", *[F.col(c).cast("string") for c in (*config, "lm_type", "dataset", *key)])
    words = dict(zip(("_h1", "_h2"), row_words(own)))
    numbers = ", ".join(
        f"struct({i}, {', '.join(f'{x}L' for x in coefficients(META_SALT, seed + i))})" for i in range(replicates))
    numbered = num_correct.withColumns(words).select("*", F.expr(f"inline(array({numbers})) as (replicate, _a, _b, _c)"))
    drawn_key = seed_key([F.col("_h1"), F.col("_h2")], F.col("_a"), F.col("_b"), F.col("_c"))
    keyed = numbered.withColumn("_key", F.shiftleft(drawn_key, 32) + F.col("_h2"))
    arms = list(dict.fromkeys(arm for name in names for arm in EFFECTS[name]))
    if size == 1:
        drawn = keyed.groupBy(*cell).agg(*[F.min_by(c, "_key").alias(f"_{c}") for c in ("num_test", *arms)])
    else:
        order = Window.partitionBy(*cell).orderBy("_key")
        kept = keyed.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= size)
        drawn = kept.select(*cell, *[F.col(c).alias(f"_{c}") for c in ("num_test", *arms)])
    sums = drawn.groupBy(*config, "replicate").agg(
        F.count(F.lit(1)).alias("n_subsamples"), *[F.sum(f"_{c}").cast("double").alias(f"_{c}") for c in ("num_test", *arms)])
    rows = []
    for name in names:
        treatment, control = (F.col(f"_{arm}") for arm in EFFECTS[name])
        total = F.col("_num_test")
        rows.append(F.struct(F.lit(name).alias("effect"), (logit(treatment, total) - logit(control, total)).alias("log_odds"),
                             ((treatment - control) / total).alias("mean")))
    return sums.select(*config, "replicate", "n_subsamples", F.inline(F.array(*rows)))


def bootstrap_effect(
    num_correct: DataFrame, effect: str, replicates: int = 1000, config: Sequence[str] = (), seed: int = 0
) -> DataFrame:
    """Effects of experiments on datasets drawn with replacement.

    Subsamples are summed per dataset first. Every dataset is then one slot of each
    replicate and picks a dataset by hash; the pick is an equi-join on its number.
    """
    per_dataset = num_correct.groupBy(*config, "dataset").agg(*_sums(effect))
    every = Window.partitionBy(*config)
    numbered = per_dataset.withColumns({
        "_slot": (F.row_number().over(every.orderBy("dataset")) - 1).cast("bigint"),
        "_size": F.count(F.lit(1)).over(every),
    })
    slots = numbered.select(
        *config, "_slot", "_size", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")
    )
    hashed = draw_key("boot", str(seed), *[F.col(c) for c in config], F.col("replicate"), F.col("_slot"))
    picked = slots.select(*config, "replicate", pick(hashed, F.col("_size")).alias("_pick"))
    sums = numbered.select(*config, F.col("_slot").alias("_pick"), "_t", "_c", "_n")
    drawn = picked.join(sums, [*config, "_pick"])
    pooled = drawn.groupBy(*config, "replicate").agg(*[F.sum(c).alias(c) for c in ("_t", "_c", "_n")])
    return pooled.select(*config, "replicate", _log_odds().alias("log_odds"))


def glm_effect(num_correct: DataFrame, effect: str, steps: int = NEWTON_STEPS) -> DataFrame:
    """Binomial regression ``num_correct / num_test ~ method + lm_type``: ``term, estimate, se``, one row per coefficient.

    The likelihood only needs the sums per method and LM type. Each Newton step is an aggregate over these few rows: an
    LM type's own coefficient only meets the common one, so the equations fall apart into one number per LM type and
    one sum. LM types are levels against the first by name; the steps are a fixed number, as they double the digits each.
    """
    everything = Window.partitionBy()
    over_all = lambda c: F.sum(c).over(everything)
    start = F.log((F.col("_t") + F.col("_c") + 0.5) / (2 * F.col("_n") - F.col("_t") - F.col("_c") + 0.5))
    rows = num_correct.groupBy("lm_type").agg(*_sums(effect)).withColumns({"_level": start, "_method": F.lit(0.0)})

    def weighed(rows: DataFrame) -> DataFrame:
        chance = lambda x: 1 / (1 + F.exp(-x))
        control, treatment = chance(F.col("_level")), chance(F.col("_level") + F.col("_method"))
        rows = rows.withColumns({
            "_w": F.col("_n") * treatment * (1 - treatment), "_w0": F.col("_n") * control * (1 - control),
            "_r": F.col("_t") - F.col("_n") * treatment, "_r0": F.col("_c") - F.col("_n") * control})
        return rows.withColumns({"_both": F.col("_w") + F.col("_w0"), "_rest": F.col("_r") + F.col("_r0")}).withColumn(
            "_information", over_all(F.col("_w") - F.col("_w") * F.col("_w") / F.col("_both")))

    for _ in range(steps):
        rows = weighed(rows)
        rows = rows.withColumn(
            "_step", over_all(F.col("_r") - F.col("_w") * F.col("_rest") / F.col("_both")) / F.col("_information"))
        rows = rows.withColumn("_level", F.col("_level") + (F.col("_rest") - F.col("_w") * F.col("_step")) / F.col("_both"))
        rows = rows.withColumn("_method", F.col("_method") + F.col("_step"))
    first = F.min(F.struct("lm_type", "_level", "_w", "_both")).over(everything)
    rows = weighed(rows).withColumn("_first", first)
    tilt = F.col("_w") / F.col("_both") - F.when(
        F.col("lm_type") != F.col("_first.lm_type"), F.col("_first._w") / F.col("_first._both")).otherwise(0.0)
    alone = 1 / F.col("_both") + F.when(F.col("lm_type") != F.col("_first.lm_type"), 1 / F.col("_first._both")).otherwise(0.0)
    error = F.sqrt(alone + tilt * tilt / F.col("_information"))
    term = lambda name, estimate, se: F.struct(name.alias("term"), estimate.alias("estimate"), se.alias("se"))
    common = term(F.lit("method"), F.col("_method"), 1 / F.sqrt("_information"))
    intercept = term(F.lit("intercept"), F.col("_level"), error)
    level = term(F.concat(F.lit("lm_type["), "lm_type", F.lit("]")), F.col("_level") - F.col("_first._level"), error)
    terms = F.when(F.col("lm_type") == F.col("_first.lm_type"), F.array(common, intercept)).otherwise(F.array(level))
    return rows.select(F.inline(terms))
