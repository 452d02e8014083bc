"""Specs, processors, checks, names and prompts on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from triarm.functions import naming, prompts, scoring
from triarm.operators import packing, validate
from triarm.operators.validate import InvalidDataError
from triarm.sources import datasets
from triarm.sources.specs import REGISTRY, DatasetSpec, dataset_names, specs_frame


def frame(spark, rows, schema="row_id long, text string, label int"):
    return spark.createDataFrame(rows, schema)


GOOD = [(1, "a", 0), (2, "b", 1), (3, "c", 0)]


def test_registry(spark):
    assert len(REGISTRY) == 25
    sizes = sorted(len(s.class_names) for s in REGISTRY.values())
    assert (sizes[0], sizes[-1]) == (2, 18)
    table = specs_frame(spark, REGISTRY.values())
    assert table.count() == 25 and table.select("dataset").distinct().count() == 25


def test_specs_refuse_empty_names():
    with pytest.raises(ValueError):
        DatasetSpec("x", ("a", ""), "")
    with pytest.raises(ValueError):
        DatasetSpec("", ("a",), "")


def test_dataset_names():
    assert dataset_names(["z/b", "y/a"]) == ["y/a", "z/b"]
    assert len(dataset_names()) == 25
    with pytest.raises(ValueError):
        dataset_names(["x/a", "y/a"])


@pytest.mark.parametrize("name, schema, rows, expected", [
    ("app_reviews", "review string, star int", [("good", 5), ("bad", 1)], [("good", 4), ("bad", 0)]),
    ("blog_authorship_corpus", "text string, gender string",
     [("x", "female"), ("y" * 1000, "male"), (None, "male"), ("z", "other")], [("x", 0), ("z", None)]),
    ("climate_fever", "claim string, claim_label int", [("c", 3)], [("c", 3)]),
    ("aladar/craigslist_bargains", "text string, label int", [("a", 1), (None, 2), ("", 3)], [("a", 1), ("", 3)]),
    ("disaster_response_messages", "message string, genre string",
     [("m", "direct"), ("", "news"), (None, "news"), ("n" * 999, "social")], [("m", 0), ("n" * 999, 2)]),
    ("SetFit/enron_spam", "text string, label int", [("", 0), (None, 1), ("t", 1)], [("t", 1)]),
    ("financial_phrasebank", "sentence string, label int", [("s", 2)], [("s", 2)]),
    ("classla/FRENK-hate-en", "text string, topic string", [("t", "migrants"), ("u", "lgbt")], [("t", 1), ("u", 0)]),
    ("hyperpartisan_news_detection", "title string, hyperpartisan boolean",
     [("t", True), ("", False), (None, True), ("u", False)], [("t", 1), ("u", 0)]),
    ("limit", "sentence string, motion string", [("s", "yes"), ("t", "no")], [("s", 1), ("t", 0)]),
    ("AmazonScience/massive", "utt string, scenario int", [("u", 17)], [("u", 17)]),
    ("movie_rationales", "review string, label int", [("r", 1)], [("r", 1)]),
    ("ccdv/patent-classification", "text string, label int", [("p" * 1000, 1), ("p", 2)], [("p", 2)]),
    ("silicone", "Utterance string, Label int", [("u", 3)], [("u", 3)]),
    ("trec", "text string, coarse_label int", [("q", 5)], [("q", 5)]),
    ("tweets_hate_speech_detection", "tweet string, label int", [("t", 1)], [("t", 1)]),
    ("yahoo_answers_topics", "question_title string, question_content string, topic int",
     [("a", "b", 9), ("a", None, 1)], [("a\nb", 9), (None, 1)]),
    ("ag_news", "text string, label int", [("t", 3)], [("t", 3)]),
])
def test_processors(spark, name, schema, rows, expected):
    df = datasets.canonical(frame(spark, rows, schema), REGISTRY[name])
    assert [tuple(r) for r in df.select("text", "label").collect()] == expected
    assert dict(df.dtypes)["label"] == "int"


def test_valid_table_passes(spark):
    validate.require_valid(frame(spark, GOOD), ("x", "y"))
    assert {r["n_bad"] for r in validate.violations(frame(spark, GOOD), 2).collect()} == {0}


@pytest.mark.parametrize("rows, names, check, message", [
    (GOOD + [(4, None, 0)], 2, "null_text", "NULL"),
    (GOOD + [(4, "", 0)], 2, "empty_text", "empty"),
    (GOOD + [(3, "d", 0)], 2, "duplicate_key", "unique"),
    (GOOD + [(4, "d", None)], 2, "null_label", "not known"),
    (GOOD + [(4, "d", -1)], 3, "negative_label", "negative"),
    (GOOD + [(4, "d", 3)], 3, "missing_label", "consecutive"),
    (GOOD, 1, "class_count_off", "missing"),
    (GOOD, 3, "class_count_off", "too many"),
])
def test_broken_tables_are_refused(spark, rows, names, check, message):
    df = frame(spark, rows)
    found = {r["check"]: r["n_bad"] for r in validate.violations(df, names).collect()}
    assert found[check] >= 1
    with pytest.raises(InvalidDataError, match=message):
        validate.require_valid(df, ["c"] * names)


def test_missing_column_is_refused(spark):
    with pytest.raises(InvalidDataError, match="label"):
        validate.require_columns(frame(spark, GOOD).drop("label"))


def test_missing_labels(spark):
    df = frame(spark, [(1, "a", 0), (2, "b", 4), (3, "c", -2)])
    assert [tuple(r) for r in validate.missing_labels(df).collect()] == [(1, 3)]
    stray = df.unionByName(df.limit(1).withColumn("label", F.lit(2**31 - 1)))
    assert sorted(tuple(r) for r in validate.missing_labels(stray).collect())[-1][1] == 2**31 - 2
    assert validate.missing_labels(df.where("label < 0")).collect() == []


def test_probabilities_need_the_right_size(spark):
    df = spark.createDataFrame([([0.5, 0.5],)], "probs array<double>")
    assert validate.require_probabilities(df, 2).count() == 1
    with pytest.raises(Exception, match="expected 3 probabilities"):
        validate.require_probabilities(df, 3).collect()


def test_replicate_counts(spark):
    rows = [("a", "x")] * 3 + [("b", "x")] * 3
    df = spark.createDataFrame(rows, "lm_type string, dataset string")
    assert validate.require_equal_replicates(df) == 3
    uneven = df.unionByName(spark.createDataFrame([("a", "x")], df.schema))
    with pytest.raises(InvalidDataError):
        validate.require_equal_replicates(uneven)


def test_load_dataset_with_keys_from_the_files(spark, tmp_path):
    spec = DatasetSpec("owner/reviews", ("bad", "good"), "", subset="small", text="review", label="stars - 1")
    path = f"{tmp_path}/owner/reviews/subset=small/split=test"
    spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "review string, stars int").write.parquet(path)
    df = datasets.load_dataset(spark, spec, str(tmp_path))
    assert sorted(tuple(r) for r in df.select("text", "label").collect()) == [("a", 0), ("b", 1), ("c", 0)]
    assert df.select("row_id").distinct().count() == 3


def test_scan_raises_other_errors(spark, tmp_path):
    with pytest.raises(Exception):
        datasets.scan_split(spark, f"{tmp_path}/nowhere")


def test_recode(spark):
    df = spark.createDataFrame([("bert",), ("new",)], "lm string")
    names = {"bert": "BERT"}
    assert [r[0] for r in df.select(naming.recode(F.col("lm"), names)).collect()] == ["BERT", "new"]
    with pytest.raises(Exception, match="no name for value: new"):
        df.select(naming.recode_strict(F.col("lm"), names)).collect()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_prompts(spark):
    names = F.array(F.lit("no"), F.lit("yes"))
    text = one(spark, prompts.instruction(names, F.lit("Say it.")))
    assert text == (
        "Your task is to classify a given text as one of these categories:\nno\nyes\n\nSay it.\n\n"
    )
    assert one(spark, prompts.query(F.lit("x" * 1200))) == "### Text: " + "x" * 1000 + "\n"
    assert one(spark, prompts.answer(F.lit("yes \n"))) == " ### Answer: yes"
    assert one(spark, prompts.answer(F.lit(""))) == " ### Answer:"
    assert one(spark, prompts.class_name(names, F.lit(1))) == "yes"
    assert one(spark, prompts.class_name(names, F.lit(7))) is None


def test_chats(spark):
    chat = prompts.chat(F.lit("I"), F.lit("Q"), F.lit("A"))
    assert [tuple(m) for m in one(spark, chat)] == [("system", "I"), ("user", "Q"), ("assistant", "A")]
    merged = prompts.chat(F.lit("I"), F.lit("Q"), F.lit("A"), None)
    assert [tuple(m) for m in one(spark, merged)] == [("user", "IQ"), ("assistant", "A")]
    assert one(spark, prompts.render(chat)) == "IQA"


@pytest.mark.parametrize("text, suffix, expected", [
    ("ab</s>", "</s>", "ab"), ("ab</s></s>", "</s>", "ab</s>"), ("ab", "</s>", "ab"), ("ab", None, "ab"),
])
def test_strip_suffix(spark, text, suffix, expected):
    assert one(spark, prompts.strip_suffix(F.lit(text), suffix)) == expected


def test_prefix_is_cut_at_the_first_marker(spark):
    prompt = F.lit("Do it.\n\n### Text: about ### Text: marks\n ### Answer:")
    assert one(spark, prompts.shared_prefix(prompt)) == "Do it.\n\n"
    assert one(spark, prompts.after_prefix(prompt)) == "### Text: about ### Text: marks\n ### Answer:"


def test_packing(spark):
    df = spark.createDataFrame([("g", i, f"t{i}") for i in (9, 1, 5, 3, 7)], "g string, row_id long, text string")
    rows = packing.packed_prompts(df, 2, ["g"], F.lit("I ")).orderBy("batch").collect()
    assert [r["n_texts"] for r in rows] == [2, 2, 1]
    assert rows[0]["prompt"] == "I ### Text: t1\n\n\n### Text: t3\n"
    with pytest.raises(ValueError):
        packing.with_batches(df, 0, ["g"])


def test_scores(spark):
    probs = one(spark, scoring.softmax(F.array(F.lit(1000.0), F.lit(1000.0), F.lit(-1000.0))))
    assert probs == pytest.approx([0.5, 0.5, 0.0])
    assert one(spark, scoring.argmax(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4)))) == 1
    assert one(spark, scoring.odds_ratio(F.lit(0.8), F.lit(0.5))) == pytest.approx(4.0)
    assert one(spark, scoring.odds_ratio(F.lit(1.0), F.lit(0.5))) is None
    assert one(spark, scoring.tokens(F.lit("Élan, vital!  2x"))) == ["élan", "vital", "2x"]


def test_prompts_must_share_their_prefix(spark):
    from triarm.functions.fixed_values import QUERY_MARKER
    from triarm.operators.validate import InvalidDataError, require_shared_prefix

    frame = lambda *texts: spark.createDataFrame([(t,) for t in texts], "whole string")
    require_shared_prefix(frame(f"a {QUERY_MARKER} x", f"a {QUERY_MARKER} y"), "whole")
    for bad in ((f"a {QUERY_MARKER} x", f"b {QUERY_MARKER} x"), (f"a {QUERY_MARKER} x", "a x"), (f"a {QUERY_MARKER}", None)):
        with pytest.raises(InvalidDataError):
            require_shared_prefix(frame(*bad), "whole")


def test_number_of_outliers_is_checked(spark):
    from triarm.operators.summary import drop_outliers
    from triarm.operators.validate import InvalidDataError

    rows = spark.createDataFrame([(0.9, 0.9), (0.1, 0.9), (None, 0.9)], "extra double, test double")
    assert drop_outliers(rows, 0.5, expected=2).count() == 1
    with pytest.raises(InvalidDataError):
        drop_outliers(rows, 0.5, expected=1)
