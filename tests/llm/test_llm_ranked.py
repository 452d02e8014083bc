"""Ranked search against scoring every document."""

import random

import numpy as np
import pytest
from llm_brute import ranked
from pyspark.sql import functions as F

from triarm.llm import ranked_terms
from triarm.llm.ranked_terms import Postings, search_block


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "quick brown fox and one more WORD"), (2, None), (3, ""), (4, "two words"), (None, "no item id here é▁ü"), (5, "word1 word2 and3 nobody"),
            (5, "same line"), (6, "!!"), (7, "zzz unknown"), (8, "two, two; TWO.")]
    return spark.createDataFrame(rows, "item_id LONG, text STRING").withColumn("doc_id", F.lit("clash"))


@pytest.mark.parametrize("postings", [1, 5, 1 << 20])
def test_ranks_of_odd_rows(odd_documents, items, monkeypatch, postings):
    monkeypatch.setattr(ranked_terms, "POSTINGS", postings)
    docs = [tuple(r) for r in odd_documents.select("doc_id", "text").collect()]
    asked = [tuple(r) for r in items.select("item_id", "text").collect()]
    for k in (10, 3, 1):
        wanted = sorted(ranked(docs, asked, k), key=repr)
        assert rows_of(ranked_terms.search(odd_documents, items, k)) == wanted
    assert rows_of(ranked_terms.search(odd_documents, items, 10, block_bytes=20)) == sorted(ranked(docs, asked), key=repr)


def test_empty_tables(odd_documents, items):
    assert ranked_terms.search(odd_documents.where("doc_id = -1"), items).collect() == []
    assert ranked_terms.search(odd_documents, items.where("item_id = -1")).collect() == []
    assert ranked_terms.search(odd_documents.where("doc_id in (3, 4, 5)"), items).collect() == []


def test_many_documents_in_many_partitions(spark):
    rng = random.Random(2)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 4000}"
    docs = [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(3000)]
    docs += [(5000 + i, docs[7][1]) for i in range(400)]
    asked = [(i, " ".join(word() for _ in range(25))) for i in range(30)] + [(99, docs[7][1])]
    df = spark.createDataFrame(docs, "doc_id LONG, text STRING").repartition(5)
    found = ranked_terms.search(df, spark.createDataFrame(asked, "item_id LONG, text STRING"))
    assert rows_of(found) == sorted(ranked(docs, asked), key=repr)


def test_no_new_accumulators_once_the_rest_is_too_small():
    """A rare term gives k documents scores that the common ones cannot reach: only these are carried on, and exactly."""
    n, k = 1000, 3
    common = np.arange(n)
    rare = np.array([10, 500, 501, 502])
    doc = np.concatenate([common, rare])
    term = np.concatenate([np.zeros(n, int), np.ones(len(rare), int)])
    count = np.ones(len(doc), dtype=np.int64)
    postings = Postings.of(doc, term, count, np.full(n, 100), 2)
    terms, weights = np.array([1, 0]), np.array([9000, 10])
    live, scores = search_block(postings, n, terms, weights, np.zeros(0, np.int64), k)
    gain = 10**9 // (1000 + 800)
    assert live.tolist() == rare.tolist() and scores.tolist() == [9010 * gain] * 4
    live, _ = search_block(postings, n, terms, weights, np.full(k, 10**12), k)
    assert not len(live)
    live, scores = search_block(postings, n, terms, np.array([9, 10]), np.zeros(0, np.int64), k)
    assert len(live) == n and scores[rare].tolist() == [19 * gain] * 4  # the common term alone can reach the third best
