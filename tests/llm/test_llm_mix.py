"""Mixtures against seats given one by one and tokens taken one by one."""

import random
from collections import defaultdict

import pytest
from llm_brute import level_targets, mixed, seats_one_by_one
from pyspark.sql import functions as F

from triarm.llm import apportioned_mix
from triarm.llm.apportioned_mix import highest_quotients

COLUMNS = ["doc_id", "size", "source_size", "target", "taken"]


def test_seats_are_those_of_the_highest_quotients():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 12)
        shares = [rng.choice([0, 1, 5, 5, 7.5, rng.random() * 1000]) for _ in range(n)]
        caps = [rng.choice([0, 1, 3, 40, 10**9]) for _ in range(n)]
        seats = rng.choice([0, 1, 2, 17, 300])
        assert highest_quotients(shares, caps, seats) == seats_one_by_one(shares, caps, seats), (shares, caps, seats)


def test_many_small_parties_keep_their_seats():
    shares = [0.51] * 1000 + [490.0]
    assert highest_quotients(shares, [10**6] * 1001, 1000) == seats_one_by_one(shares, [10**6] * 1001, 1000)


@pytest.mark.parametrize("block, shard, section", [(4096, 1 << 20, 4096), (7, 300, 2), (1, 50, 3), (64, 10_000, 4096)])
def test_mix_equals_tokens_taken_one_by_one(odd_documents, monkeypatch, block, shard, section):
    monkeypatch.setattr(apportioned_mix, "SECTION", section)
    docs = odd_documents.where("doc_id IS NULL OR doc_id NOT IN (7, 14)").withColumn(
        "source", F.coalesce("source", F.when(F.col("doc_id") % 2 == 0, "é")))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    found = apportioned_mix.mix(docs, (5, 2, 1), 3, 9, block, shard)
    wanted = mixed(rows, (5, 2, 1), 3, 9, block, shard, section, apportioned_mix.LEAST_BLOCKS)
    shown = lambda rs: sorted((*r[:3], round(r[3], 6), r[4]) for r in ((r[0] is not None, r[0] or 0, *r[1:]) for r in rs) for r in [(r[0:2], *r[2:])])
    assert shown(map(tuple, found.select(COLUMNS).collect())) == shown(wanted)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    sizes = {"hot": 900, "b": 300, "c": 250, "d": 30, "tiny": 2, None: 40}
    rows = [(s, " ".join("w" for _ in range(rng.randint(0, 80)))) for s, n in sizes.items() for _ in range(n)]
    rows = [(i, text, s) for i, (s, text) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING"), rows


def test_sources_come_near_their_targets(corpus):
    docs, rows = corpus
    got = apportioned_mix.mix(docs, (5, 2, 1), 3, 1, 4096, 2000)
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == sorted(map(tuple, apportioned_mix.mix(
        docs.repartition(7), (5, 2, 1), 3, 1, 4096, 2000).select(COLUMNS).collect()))
    taken, target, total = defaultdict(int), {}, 0
    for r in got.collect():
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        total += r.size
    assert abs(sum(target.values()) - total) < 1e-6 * total
    for source, wanted in target.items():
        assert abs(taken[source] - wanted) <= 0.02 * wanted + 3, source
    names = ["b", "c", "d", "hot", "tiny", None]
    sizes = [sum(len(t.split()) for _, t, s in rows if s == n) for n in names]
    assert [round(target[n], 6) for n in names] == [round(t, 6) for t in level_targets(sizes, [5, 2, 1, 5, 2, 1], 3)]


def test_pieces_add_up_to_what_is_taken(corpus):
    docs, rows = corpus
    got = apportioned_mix.mix(docs, (5, 2, 1), 3, 1, 4096, 2000)
    pieces = apportioned_mix.pieces(got)
    sums = {r[0]: r[1] for r in pieces.groupBy("doc_id").agg(F.sum(F.col("n_words") * F.col("times"))).collect()}
    assert {r.doc_id: r.taken for r in got.collect() if r.taken} == sums
    texts = dict((d, t.split()) for d, t, _ in rows)
    for r in apportioned_mix.texts(docs, pieces).collect():
        assert r.text.split() == texts[r.doc_id][r.first_word:r.first_word + r.n_words] and r.n_words > 0


def test_no_tokens_at_all(odd_documents):
    assert apportioned_mix.mix(odd_documents.where("doc_id = -1"), (5, 2, 1)).collect() == []
    none = apportioned_mix.mix(odd_documents.where("doc_id in (3, 4, 5)"), (5, 2, 1))
    assert {(r.size, r.target, r.taken) for r in none.collect()} == {(0, 0.0, 0)}
