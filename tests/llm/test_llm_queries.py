"""Each query over the small tables against its SQL, a plain version, a round trip or held-out accuracy."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from llm_brute import base_scores, components, overlaps, quality_counts, repeats, url_parts, url_rule
from triarm.llm import llm_queries

QUERIES = llm_queries()
TABLES = "documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    done = {}

    def get(name):
        if name not in done:
            df = QUERIES[name].run(spark, sf_dir)
            done[name] = (df.columns, [tuple(r) for r in df.collect()])
        return done[name]
    return get


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def test_all_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_equals_sql(rows, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    columns, found = rows(name)
    wanted = con.sql(QUERIES[name].sql)
    assert sorted(columns) == sorted(wanted.columns)
    order = [wanted.columns.index(c) for c in columns]
    assert sorted(found, key=repr) == sorted((tuple(r[i] for i in order) for r in wanted.fetchall()), key=repr)


def test_overlaps_are_those_of_all_alignments(rows, documents, spark, sf_dir):
    columns, found = rows("op1_spaced_seeds")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    named = {(r[0], r[1]): r[4] for r in found}
    assert overlaps(documents, items) == named


def test_components_of_all_pairs(rows, documents):
    assert sorted(rows("op3_lsh_forest")[1]) == sorted(components(documents))


def test_language_model(rows, documents):
    columns, found = rows("op4_pitman_yor")
    assert columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    wanted = {r[0]: r for r in base_scores(documents)}
    for r in found:
        assert r[:5] == wanted[r[0]][:5] and math.isclose(r[5], wanted[r[0]][5], rel_tol=1e-9)
        assert r[6] < 0
    base, model = (sum(r[i] for r in found if r[1]) for i in (5, 6))
    assert model > base  # both are negative logarithms of held-out text


def test_quality_counts_and_verdicts(rows, documents, spark, sf_dir):
    columns, found = rows("op5_decision_list")
    texts = dict(documents)
    quality = dict(tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").collect())
    right = 0
    for r in found:
        row = dict(zip(columns, r))
        counts = quality_counts(texts[row["doc_id"]])
        assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts
        assert row["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert row["kept"] == (not row["base_failed"] and row["rule"] is None)
        if row["doc_id"] in quality and not row["base_failed"]:
            right += row["kept"] == (quality[row["doc_id"]] == 1)
    judged = sum(1 for r in found if r[0] in quality and not dict(zip(columns, r))["base_failed"])
    assert right >= 0.95 * judged


def test_toxicity_of_held_out_texts(rows, spark, sf_dir):
    columns, found = rows("op6_segments")
    toxic = dict(tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").collect())
    held = [(dict(zip(columns, r)), toxic[r[0]]) for r in found if r[0] in toxic and r[1]]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r, _ in held)
    assert sum(r["predicted"] == t for r, t in held) >= 0.95 * len(held)
    assert not any(r["predicted"] for r, t in held if not t)


def test_repeated_bytes(rows, documents):
    assert sorted(rows("op7_bucket_refinement")[1]) == sorted(repeats(documents))


def test_urls(rows, spark, sf_dir):
    from triarm.llm.queries import URL_RULES

    columns, found = rows("op8_url_ratio")
    urls = dict(tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect())
    for r in found:
        row = dict(zip(columns, r))
        assert (row["host"], row["path"]) == url_parts(urls[row["page_id"]])
        rule = url_rule(row["host"], row["path"], URL_RULES)
        assert row["rule"] == (rule.name if rule else None)
        assert row["verdict"] == rule.verdict if rule else row["verdict"] in ("allow", "block")


def test_ids_are_those_of_the_library(rows, documents, spark, sf_dir):
    sentencepiece = pytest.importorskip("sentencepiece")
    from triarm.llm.queries import VOCABULARY

    columns, found = rows("op9_piece_edges")
    model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    wanted = spark.createDataFrame([(d, model.encode(t)) for d, t in documents], "doc_id LONG, ids ARRAY<INT>").select(
        "doc_id", F.size("ids").cast("long"), F.xxhash64("ids"))
    assert sorted(r[:3] for r in found) == sorted(tuple(r) for r in wanted.collect())
    assert all(r[3] for r in found)


def test_native_queries_run_no_python(spark, sf_dir):
    for name in ("op5_decision_list", "op8_url_ratio", "op10_slot_table"):
        plan = QUERIES[name].run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow")), name
