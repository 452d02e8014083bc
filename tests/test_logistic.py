"""The classifier of the arms whose coefficients stay distributed, next to Spark ML's."""

import re

import pytest
from pyspark.sql import functions as F

from triarm.operators import logistic, regression


def _texts(spark, n=120):
    """Labelled texts of common and rare words; every text has the word ``all``; keys repeat and some are NULL."""
    kinds = ["red green blue", "one two three", "north south east", "spring summer autumn"]
    rows = [(None if i % 40 == 0 else i // 2 * 2, f"All {kinds[i * i % 4]} w{i % 11} W{i % 7} {kinds[i % 4] if i % 3 else ''} only{i}", i * i % 4)
            for i in range(n)]
    return spark.createDataFrame(rows, "row_id LONG, text STRING, label INT")


def _plain(words, arm, max_iter):
    """Objective by step and predictions of Spark ML."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer

    learned = words.where("role = 0")
    counted = CountVectorizer(inputCol="words", outputCol="tf").fit(learned).transform(words)
    if arm == "base":
        rows = counted.withColumnRenamed("tf", "features")
    else:
        role = logistic.ROLES.index(arm)
        rows = IDF(inputCol="tf", outputCol="features").fit(counted.where(F.col("role") == role)).transform(counted)
    model = LogisticRegression(maxIter=max_iter, regParam=0.01).fit(rows.where("role = 0"))
    scored = model.transform(rows.where("role = 2")).select("label", F.col("prediction").alias("pred"))
    return list(model.summary.objectiveHistory), sorted(map(tuple, scored.collect()))


def _words(texts):
    return texts.select(
        F.col("label").cast("double"), F.pmod(F.hash("text"), F.lit(3)).alias("role"), F.split(F.lower("text"), " +").alias("words"),
        F.octet_length("text").alias("n_bytes")).localCheckpoint()


@pytest.mark.parametrize("classes", [4, 2])
def test_steps_and_predictions_are_those_of_spark_ml(spark, monkeypatch, classes):
    words = _words(_texts(spark)).where(F.col("label") < classes) if classes == 4 else _words(
        _texts(spark).withColumn("label", F.col("label") % 3 % 2))
    values, plain = [], logistic.minimize

    def kept(*args):
        out = plain(*args)
        values.append(out[2])
        return out

    monkeypatch.setattr(logistic, "minimize", kept)
    monkeypatch.setattr(logistic, "BLOCK_ROWS", 7)
    arms = logistic.arms_of(words, max_iter=4, penalty=0.01)
    history, _ = _plain(words, "base", 4)
    assert values[0] == pytest.approx(history, rel=1e-6)
    for arm, scored in arms.items():
        assert sorted(map(tuple, scored.select("label", "pred").collect())) == _plain(words, arm, 4)[1]


def test_a_word_of_all_rows_of_an_arm_has_no_weight_there(spark, monkeypatch):
    """``all`` varies in the training rows, so the arms that have it in all of their rows lose a feature."""
    words = _words(_texts(spark, 60)).withColumn("words", F.when(
        (F.col("role") == 0) & (F.col("label") > 1), F.array_remove("words", "all")).otherwise(F.col("words"))).localCheckpoint()
    values, plain = [], logistic.minimize

    def kept(*args):
        out = plain(*args)
        values.append(out[2])
        return out

    monkeypatch.setattr(logistic, "minimize", kept)
    arms = logistic.arms_of(words, max_iter=3, penalty=0.01)
    assert len(values) == 3
    for arm, found in zip(arms, values):
        assert found == pytest.approx(_plain(words, arm, 3)[0], rel=1e-6)


def test_the_vocabulary_does_not_go_to_the_driver(spark):
    """200,000 words in classes that need coefficients for each; Spark ML's lists of them were on the driver."""
    rows = spark.range(400, numPartitions=4).select(
        F.col("id").alias("row_id"), (F.col("id") % 4).cast("int").alias("label"),
        F.concat_ws(" ", F.concat(F.lit("label"), F.col("id") % 4),
                    F.transform(F.sequence(F.lit(0), F.lit(499)), lambda i: F.concat(F.lit("w"), F.col("id") * 500 + i))).alias("text"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen, collect = [], type(rows).collect

        def counted(self):
            out = collect(self)
            seen.append(sum(len(str(r)) for r in out))
            return out

        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(type(rows), "collect", counted)
            patch.setattr("pyspark.ml.feature.CountVectorizer.fit", lambda *_: pytest.fail("lists the vocabulary on the driver"))
            out = regression.logistic_arms(rows).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [r["arm"] for r in out] == ["base", "extra", "test"] and all(r["n_test"] > 100 for r in out)
    assert max(seen) < 10_000


@pytest.mark.parametrize("column, said", [("text", "a text is NULL"), ("label", "a label of a training row is NULL")])
def test_null_texts_and_labels_are_refused(spark, column, said):
    kind = dict(_texts(spark).dtypes)[column]
    with pytest.raises(Exception, match=re.escape(said)):
        regression.logistic_arms(_texts(spark).withColumn(column, F.lit(None).cast(kind)))
