"""The language model's seating and score against plain versions."""

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from triarm.llm import pitman_yor
from triarm.llm.text import slices


def plain_scores(model, texts):
    """log10 probability of each text by walking the restaurants of every sample, token by token."""
    samples = len(model.samples)
    c = [[defaultdict(int) for _ in range(3)] for _ in range(samples)]  # customers of (context, token), (parent, token), token
    t = [[defaultdict(int) for _ in range(3)] for _ in range(samples)]
    for row in model.parts.collect():
        part = pitman_yor.Part.unpack(row["data"])
        words, contexts = part.words.tolist(), part.contexts.tolist()
        pairs, _ = part.parents
        for s, (t2, t1, t0) in enumerate(part.tables):
            for number, at, customers, tables in zip(part.number.tolist(), part.at.tolist(), part.customers.tolist(), t2.tolist()):
                c[s][2][contexts[at], words[number]] += customers
                t[s][2][contexts[at], words[number]] += tables
                c[s][1][contexts[at] % pitman_yor.PARENTS, words[number]] += tables
            for pair, tables in zip(pairs.tolist(), t1.tolist()):
                key = (pair % pitman_yor.PARENTS, words[pair // pitman_yor.PARENTS])
                t[s][1][key] += tables
                c[s][0][key[1]] += tables
            for number, tables in enumerate(t0.tolist()):
                t[s][0][words[number]] += tables
    sums = []
    for s in range(samples):
        both = []
        for table in (c[s], t[s]):
            n2, n1 = defaultdict(int), defaultdict(int)
            for (context, _), x in table[2].items():
                n2[context] += x
            for (parent, _), x in table[1].items():
                n1[parent] += x
            both.append((n2, n1, sum(table[0].values())))
        sums.append(both)
    base = 1 / (model.samples[0].kinds + 1)

    def chance(context, token):
        total = 0.0
        for s in range(samples):
            (n2, n1, n0), (m2, m1, m0) = sums[s]
            d0, d1, d2 = model.samples[s].discounts
            parent = context % pitman_yor.PARENTS
            belief = lambda x, y, d, n, m, above: (x - d * y + (1 + d * m) * above) / (1 + n)
            p = belief(c[s][0].get(token, 0), t[s][0].get(token, 0), d0, n0, m0, base)
            p = belief(c[s][1].get((parent, token), 0), t[s][1].get((parent, token), 0), d1, n1.get(parent, 0), m1.get(parent, 0), p)
            total += belief(c[s][2].get((context, token), 0), t[s][2].get((context, token), 0), d2, n2.get(context, 0), m2.get(context, 0), p)
        return total / samples

    out = []
    for text in texts:
        token, context, _ = pitman_yor.tokens(next(slices(pa.array([text or ""]))))
        out.append(sum(math.log10(chance(a, b)) for a, b in zip(context.tolist(), token.tolist())))
    return out


def test_scores_are_those_of_the_restaurants(spark, small_dir, monkeypatch):
    monkeypatch.setattr(pitman_yor, "PART_BYTES", 20_000)
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    model = pitman_yor.fit(docs.where(~pitman_yor.held_out()))
    assert model.count > 8
    texts = dict(tuple(r) for r in docs.collect())
    some = [d for d, text in texts.items() if len(text) < 20_000]
    wanted = dict(zip(some, plain_scores(model, [texts[d] for d in some])))
    found = {r["doc_id"]: r["score"] for r in pitman_yor.score(docs, model).collect()}
    assert len(some) > 150 and all(found[d] == pytest.approx(wanted[d], rel=1e-9) for d in some)


def tables_one_by_one(customers, pull, discount):
    """Probability of each number of tables when customers are seated one by one."""
    chance = np.zeros(customers + 2)
    chance[1] = 1.0
    for k in range(1, customers):
        t = np.minimum(np.arange(len(chance)), k)
        new = pull / (pull + k - discount * t)
        chance = chance * (1 - new) + np.concatenate([[0], (chance * new)[:-1]])
    return chance


@pytest.mark.parametrize("customers, pull, discount", [(8, 2.0, 0.5), (60, 1.0, 0.0), (60, 5.0, 0.6), (400, 3.0, 0.3), (400, 0.05, 0.8)])
def test_seating_in_groups_is_near_that_one_by_one(customers, pull, discount):
    """Means differ by five per cent at most, and distributions by a tenth of their mass."""
    rng = np.random.default_rng(3)
    n = 20_000
    found = pitman_yor.seat(np.full(n, customers), np.full(n, pull), discount, rng)
    exact = tables_one_by_one(customers, pull, discount)
    mean = (exact * np.arange(len(exact))).sum()
    assert abs(found.mean() - mean) <= 0.05 * mean
    share = np.bincount(found, minlength=len(exact)) / n
    assert np.abs(share - exact).sum() / 2 <= 0.1
    if customers <= 10:
        assert np.abs(share - exact).sum() / 2 <= 0.02


def test_only_the_last_parts_of_the_model_stay_stored(spark):
    """Each sweep reads the parts that the one before stored; five tables of them filled the disk."""
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.glob("parts-*"))
    docs = spark.createDataFrame([(i, f"word{i % 3} and word{i % 5}") for i in range(40)], "doc_id LONG, text STRING")
    model = pitman_yor.fit(docs)
    assert len(set(folder.glob("parts-*")) - before) == 1
    assert pitman_yor.score(docs, model).count() == 40


def test_counting_leaves_no_arrays_of_tokens_behind():
    held = [tuple(np.array(x, dtype=kind) for x, kind in zip(rows, (np.uint64, np.int64, np.int64))) for rows in (
        ([5, 3, 5], [0, 9, 0], [0, 0, 0]), ([5, 3], [9, 9], [1, 1]))]
    words, contexts, number, at, doc, counts = pitman_yor._count(held)
    assert held == []
    rows = sorted(zip(words[number].tolist(), contexts[at].tolist(), doc.tolist(), counts.tolist()))
    assert rows == [(3, 9, 0, 1), (3, 9, 1, 1), (5, 0, 0, 2), (5, 9, 1, 1)]


def test_documents_are_read_once_in_scoring(spark):
    """They were counted and sent to the parts twice, once for the totals of their contexts."""
    rows = spark.sparkContext.accumulator(0)
    texts = spark.createDataFrame([(i, f"word{i % 7} and word{i % 5}") for i in range(60)], "doc_id LONG, text STRING")
    model = pitman_yor.fit(texts.where("doc_id < 40"))

    def counted(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    found = pitman_yor.score(texts.mapInArrow(counted, texts.schema), model).collect()
    assert len(found) == 60 and rows.value == 60


def test_hashes_and_pairs_are_packed_by_place():
    rng = np.random.default_rng(5)
    letters = rng.integers(97, 123, (2, 20_000))
    contexts = np.unique(rng.integers(0, 1 << 47, 20_000) * pitman_yor.PARENTS + letters[0] * 256 + letters[1])
    packed = pitman_yor._pack(pitman_yor._thin(contexts))
    assert len(packed) < 5.7 * len(contexts)  # 6.3 when all places were compressed as one
    assert (pitman_yor._full(pitman_yor._unpack(packed)[0]) == contexts).all()
    for n in (0, 1, 5, 5000):
        number, at = np.unique(rng.integers(0, 40, (2, n)), axis=1)
        more = pitman_yor._unpack(pitman_yor._pack(pitman_yor._thin_pairs(number, at)))[0]
        assert [x.tolist() for x in pitman_yor._full_pairs(more)] == [number.tolist(), at.tolist()]
