"""The three arms as one job over all datasets and replicates.

An arm learns something from unlabelled text (``extra``: independent rows,
``test``: the test rows themselves, ``base``: nothing), is then fitted on the
same labelled train rows and predicts the same test rows. Here the unsupervised
step is inverse document frequency, and the classifier a naive Bayes on weighted
token counts: both are aggregates keyed by ``(dataset, subsample)``. Arms are
columns, so a token costs one row for all three.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from triarm.functions.fixed_values import ARMS
from triarm.functions.scoring import argmax, softmax, tokens
from triarm.operators import scoring
from triarm.sources.scratch import spread, stored

FITTED_ARMS = tuple(a for a in ARMS if a != "base")


def token_counts(data: DataFrame, splits: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Tokens of every drawn row: ``(*by, subsample_idx, role, row_id, label, token, tf)``.

    Each drawn text is cut into tokens once, however many replicates drew it. The
    ids are a small sample, so they filter the texts before anything is shuffled; the
    drawn texts are then shared out by row, which also serves the counts and the join.
    """
    ids = splits.select(*by, "row_id").distinct()
    drawn = data.select(*by, "row_id", "text").join(ids, [*by, "row_id"], "left_semi")
    words = spread(drawn, *by, "row_id").select(*by, "row_id", F.explode(tokens(F.col("text"))).alias("token"))
    counts = words.groupBy(*by, "row_id", "token").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    return splits.join(counts, [*by, "row_id"])


def split_sizes(splits: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Rows an arm learns from: ``n_extra`` and ``n_test`` per cell."""
    return splits.groupBy(*cell).agg(
        *[F.count_if(F.col("role") == a).cast("double").alias(f"n_{a}") for a in FITTED_ARMS]
    )


def unsupervised_fit(counts: DataFrame, splits: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Token weights per arm: ``w_extra`` and ``w_test`` are smoothed IDFs of their split."""
    # A row has a token once, so rows are documents.
    frequency = counts.where(F.col("role").isin(*FITTED_ARMS)).groupBy(*cell, "token").agg(
        *[F.count_if(F.col("role") == a).cast("double").alias(f"df_{a}") for a in FITTED_ARMS]
    )
    return frequency.join(split_sizes(splits, cell), list(cell))


def _idf(arm: str) -> Column:
    return F.log((1 + F.col(f"n_{arm}")) / (1 + F.col(f"df_{arm}"))) + 1


def weighted_tokens(data: DataFrame, splits: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Train and test tokens with one weighted count per arm: ``x_<arm>``.

    How many rows of a split have the token is a window over the token's rows in its
    cell, at most ``m + 2 n`` of them: one shuffle, and no join back.
    """
    cell = [*by, "subsample_idx"]
    counts = token_counts(data, splits, by)
    token = Window.partitionBy(*cell, "token")
    seen = {f"df_{a}": F.count_if(F.col("role") == a).over(token) for a in FITTED_ARMS}
    rows = counts.withColumns(seen).where("role in ('train', 'test')").join(split_sizes(splits, cell), cell)
    weights = {"base": F.lit(1.0), **{a: _idf(a) for a in FITTED_ARMS}}
    return rows.select(
        *cell, "role", "row_id", "label", "token", *[(F.col("tf") * w).alias(f"x_{a}") for a, w in weights.items()]
    )


def classifier_fit(weighted: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Weighted token count of each class and arm: ``(*cell, label, token, c_<arm>)``."""
    train = weighted.where("role = 'train'")
    return train.groupBy(*cell, "label", "token").agg(*[F.sum(f"x_{a}").alias(f"c_{a}") for a in ARMS])


def class_table(model: DataFrame, splits: DataFrame, cell: Sequence[str]) -> DataFrame:
    """A row for each cell: ``classes``, in order, with their log prior and, per arm, the log of their smoothed total count."""
    totals = model.groupBy(*cell, "label").agg(*[F.sum(f"c_{a}").alias(f"_t_{a}") for a in ARMS])
    vocabulary = model.groupBy(*cell).agg(F.count_distinct("token").alias("_v"))
    rows = splits.where("role = 'train'").groupBy(*cell, "label").agg(F.count(F.lit(1)).alias("_n"))
    joined = rows.join(totals, [*cell, "label"], "left").join(vocabulary, list(cell), "left")
    size = lambda a: F.coalesce(F.col(f"_t_{a}"), F.lit(0.0)) + F.coalesce(F.col("_v"), F.lit(1))
    one = F.struct(F.col("label").alias("class_idx"), "_n", *[F.log(size(a)).alias(f"log_total_{a}") for a in ARMS])
    # A handful of classes per cell.
    cells = joined.groupBy(*cell).agg(F.sort_array(F.collect_list(one)).alias("classes"), F.sum("_n").alias("_all"))
    prior = lambda c: c.withField("log_prior", F.log(c["_n"] / F.col("_all"))).dropFields("_n")
    return cells.select(*cell, F.transform("classes", prior).alias("classes"))


def predict(weighted: DataFrame, model: DataFrame, splits: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Class probabilities: ``(*cell, row_id, label, arm, probs)``.

    A class scores its log prior plus the mean log likelihood of the row's tokens.
    Tokens the class never had add nothing but the denominator. A token of the model is one row with all of
    its classes, so a test token meets it once; what a row then needs is a short array.
    """
    key = [*cell, "row_id"]
    known = model.groupBy(*cell, "token").agg(
        F.collect_list(F.struct(F.col("label").alias("class_idx"), *[f"c_{a}" for a in ARMS])).alias("_known"))
    tokens_ = weighted.where("role = 'test'").join(known, [*cell, "token"], "left")
    # Weights of all tokens count as class -1.
    mass = F.struct(F.lit(-1).alias("class_idx"), *[F.col(f"x_{a}").alias(f"v_{a}") for a in ARMS])
    hit = lambda k: F.struct(k["class_idx"].alias("class_idx"), *[(F.col(f"x_{a}") * F.log(k[f"c_{a}"] + 1)).alias(f"v_{a}") for a in ARMS])
    hits = F.coalesce(F.transform("_known", hit), F.array().cast(f"array<struct<class_idx:int,{','.join(f'v_{a}:double' for a in ARMS)}>>"))
    sums = tokens_.select(*key, F.inline(F.concat(F.array(mass), hits))).groupBy(*key, "class_idx").agg(
        *[F.sum(f"v_{a}").alias(f"v_{a}") for a in ARMS])
    found = sums.groupBy(*key).agg(F.collect_list(F.struct("class_idx", *[f"v_{a}" for a in ARMS])).alias("_found"))
    rows = splits.where("role = 'test'").select(*key, "label").join(found, key, "left").join(
        class_table(model, splits, cell), list(cell))
    of_class = lambda i: F.get(F.filter("_found", lambda x: x["class_idx"] == i), F.lit(0))

    def probabilities(a: str) -> Column:
        weight = of_class(F.lit(-1))[f"v_{a}"]

        def score(c: Column) -> Column:
            likelihood = F.coalesce(of_class(c["class_idx"])[f"v_{a}"], F.lit(0.0)) - weight * c[f"log_total_{a}"]
            return c["log_prior"] + F.coalesce(F.try_divide(likelihood, weight), F.lit(0.0))

        return softmax(F.transform("classes", score))

    per_arm = [F.struct(F.lit(a).alias("arm"), probabilities(a).alias("probs")) for a in ARMS]
    return rows.select(*key, "label", F.inline(F.array(*per_arm)))


def run_experiment(data: DataFrame, splits: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Predictions of all arms, datasets and replicates: probabilities and class."""
    cell = [*by, "subsample_idx"]
    weighted = stored(weighted_tokens(data, splits, by), "tokens")
    model = stored(classifier_fit(weighted, cell), "model")
    scored = predict(weighted, model, splits, cell)
    return scored.withColumn("pred", argmax(F.col("probs")))


def fitted_model(data: DataFrame, splits: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """The classifier of every cell and arm, as a table."""
    return classifier_fit(weighted_tokens(data, splits, by), [*by, "subsample_idx"])


def idf_table(data: DataFrame, splits: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """``(*cell, arm, token, df, idf)`` of the tokens each arm saw."""
    cell = [*by, "subsample_idx"]
    unlabelled = splits.where(F.col("role").isin(*FITTED_ARMS))
    fit = unsupervised_fit(token_counts(data, unlabelled, by), unlabelled, cell)
    per_arm = [
        F.struct(F.lit(a).alias("arm"), F.col(f"df_{a}").cast("bigint").alias("df"), _idf(a).alias("idf"))
        for a in FITTED_ARMS
    ]
    return fit.select(*cell, "token", F.inline(F.array(*per_arm))).where("df > 0")


def experiment_accuracies(data: DataFrame, splits: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Accuracy table of the experiment, one row per dataset and replicate."""
    cell = [*by, "subsample_idx"]
    scored = run_experiment(data, splits, by)
    wide = scoring.arms_to_columns(scored, [*cell, "row_id", "label"], "pred", prefix="pred_")
    return scoring.with_dataset_constants(scoring.accuracies(wide, cell), data.select(*by, "label"), by)


def keyword_scores(df: DataFrame, keywords: dict[int, Sequence[str]], text: str = "text") -> DataFrame:
    """Training-free class probabilities: softmax of the share of tokens that name a class.

    Row by row, so no shuffle; train rows are not looked at.
    """
    every = sorted({word for names in keywords.values() for word in names})
    # Look all keywords up in one go; the classes then only look at what was found.
    words = df.withColumn("_tokens", tokens(F.col(text)))
    found = words.select(
        *df.columns, F.greatest(F.size("_tokens"), F.lit(1)).alias("_size"),
        F.filter("_tokens", lambda t: t.isin(*every)).alias("_found"),
    )

    def share(names: Sequence[str]) -> Column:
        return F.size(F.filter("_found", lambda t: t.isin(*names))) / F.col("_size")

    shares = F.array(*[share(keywords[label]) for label in sorted(keywords)])
    scored = found.withColumn("probs", softmax(shares)).drop("_found", "_size")
    return scored.withColumn("pred", argmax(F.col("probs")))
