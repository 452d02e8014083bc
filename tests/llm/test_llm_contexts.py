"""The language model's contexts are whole words."""

import math

import numpy as np
import pyarrow as pa

from triarm.llm import pitman_yor
from triarm.llm.text import slices


def test_words_of_one_ending_are_different_contexts(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "PART_BYTES", 50)
    texts = ["a new dog ran", "he knew cats ran", "so few birds ran"] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    model = pitman_yor.fit(docs)
    assert model.count > 8
    asked = [f"{c} {w}" for c in ("new", "knew", "few") for w in ("dog", "cats", "birds")]
    found = pitman_yor.score(spark.createDataFrame(list(enumerate(asked)), "doc_id LONG, text STRING"), model).collect()
    score = {asked[r["doc_id"]]: r["score"] for r in found}
    for context, follower in (("new", "dog"), ("knew", "cats"), ("few", "birds")):
        # The last token of both texts is the end after an inner word, so scores differ by the pairs.
        others = [score[f"{context} {w}"] for w in ("dog", "cats", "birds") if w != follower]
        assert score[f"{context} {follower}"] > max(others) + 0.5, score


def test_probabilities_after_a_word_add_up_to_one(spark):
    texts = ["the new dog saw the few birds", "he knew the new cats and the dog", "few knew"] * 20
    model = pitman_yor.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING"))
    parts = [pitman_yor.Part.unpack(r["data"]) for r in model.parts.collect()]
    values = {}
    for p in parts:
        for place, key in enumerate(p.contexts):
            own = p.at == place
            sums = [int(x[own].sum()) for x in (p.customers, *(t2 for t2, _, _ in p.tables))]
            values[int(key)] = np.add(sums, values.get(int(key), 0))
    contexts = np.array(sorted(values))
    guests = pitman_yor.Guests([pitman_yor._pack(pitman_yor._thin(contexts), list(np.array([values[c] for c in contexts.tolist()]).T))])
    token, context, _ = pitman_yor.tokens(next(slices(pa.array(texts))))
    assert set(contexts.tolist()) == set(context.tolist()) and len(contexts) == len({w for t in texts for w in t.split()}) + 1
    for key in contexts:
        total = 0.0
        for part in [*parts, None]:
            words = part.words if part else np.array([1], dtype=np.uint64)
            chance, _ = pitman_yor.log_probabilities(
                part, model.samples, words, np.arange(len(words)), np.full(len(words), key), guests)
            total += chance.sum()
        assert math.isclose(total, 1.0, rel_tol=1e-9)
