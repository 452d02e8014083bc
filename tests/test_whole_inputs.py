"""Queries show all of their input, under each of their names."""

import duckdb
import pytest
from pyspark.sql import functions as F

from triarm.plans import all_queries, q_arms
from triarm.plans.q_sampling import splits


def test_predictions_of_both_datasets(spark, sf_dir):
    wide = all_queries()["pred_probs_wide_all"].run(spark, sf_dir).cache()
    drawn = splits(spark, sf_dir).where("role = 'test'").groupBy("dataset").count()
    assert {tuple(r) for r in wide.groupBy("dataset").count().collect()} == {tuple(r) for r in drawn.collect()}
    for dataset, n in q_arms.CLASSES.items():
        for arm in q_arms.ARMS:
            given = [F.count(f"pred_prob_{i}_{arm}") for i in range(4)]
            rows, *found = wide.where(F.col("dataset") == dataset).agg(F.count("*"), *given).first()
            assert rows and found == [rows] * n + [0] * (4 - n)
    same = all_queries()["pred_probs_wide"].run(spark, sf_dir)
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, same.collect()))


def test_accuracies_from_files_of_both_datasets(spark, sf_dir):
    found = {r[:2]: r[2:] for r in map(tuple, all_queries()["accuracy_from_preds_all"].run(spark, sf_dir).collect())}
    arms = all_queries()["experiment_arms"].run(spark, sf_dir).select("dataset", "subsample_idx", *q_arms.ARMS)
    assert found == {r[:2]: r[2:] for r in map(tuple, arms.collect())}
    assert {d for d, _ in found} == set(q_arms.CLASSES)


def test_every_turn_is_rendered_once(spark, sf_dir):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = {r[:2]: r[2] for r in map(tuple, all_queries()["chat_render_all"].run(spark, sf_dir).collect())}
    assert rows == {r[:2]: r[2] for r in map(tuple, all_queries()["chat_render"].run(spark, sf_dir).collect())}
    roles = {t[:2]: t[2] for t in turns}
    replies = sum(role == "user" and roles.get((conv, turn + 1)) == "assistant" for conv, turn, role, _ in turns)
    assert len(rows) + replies == len(turns)
    for conv, turn, role, text in turns:
        if role == "assistant":
            assert rows.get((conv, turn), rows.get((conv, turn - 1), "")).endswith(text)
        elif role == "user":
            assert text[:1000] in rows[conv, turn]
        else:
            assert rows[conv, turn] == text


@pytest.mark.parametrize("name,end", [("chat_render_all", "."), ("chat_strip_suffix_all", "")])
def test_turns_without_a_partner(spark, tmp_path, name, end):
    turns = [(1, 0, "system", "Rules."), (1, 1, "user", "a"), (1, 2, "assistant", "b."), (1, 3, "assistant", "c."), (1, 4, "user", "d"),
             (1, 5, "user", "e"), (1, 6, "tool", "f."), (1, 7, "assistant", "g."), (2, 0, None, "h."), (None, 0, "user", "i"),
             (None, 1, "assistant", "j."), (3, 0, "user", "k"), (3, 1, "assistant", None), (3, 2, "user", None)]
    spark.createDataFrame(turns, "conv_id LONG, turn LONG, role STRING, text STRING").write.parquet(f"{tmp_path}/conversations.parquet")
    query = all_queries()[name]
    found = sorted(map(tuple, query.run(spark, str(tmp_path)).collect()), key=repr)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert found == sorted(con.sql(query.sql).fetchall(), key=repr)
    texts = {r[:2]: r[2] for r in found}
    assert len(found) == len(texts) == 12
    assert texts[1, 0] == "Rules" + end and texts[1, 3] == "c" + end and texts[1, 6] == "f" + end and texts[1, 7] == "g" + end
    assert texts[1, 1].endswith("a\nb" + end) and texts[1, 4].endswith("d\n") and texts[1, 5].endswith("e\n")
    assert texts[2, 0] == "h" + end and texts[None, 1] == "j" + end and texts[None, 0].endswith("i\n")
    assert texts[3, 0] is None  # a NULL text gives NULL
