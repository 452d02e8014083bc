"""Overlaps by their rule alone: any stretch with enough equal words and a large enough share of them."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, strategies as st

from llm_brute import fullest, words
from triarm.llm import spaced_seeds


def overlaps_by_rule(rows, items, min_words=8):
    out = {}
    for doc, text in rows:
        own = words(text)
        for item, other_text in items:
            other = words(other_text)
            for shift in range(-len(other) + 1, len(own)):
                equal = [own[shift + i] == w for i, w in enumerate(other) if 0 <= shift + i < len(own)]
                if sum(equal) >= min(min_words, len(other)) and fullest(equal) >= min(min_words, len(other)):
                    out[doc, item] = max(fullest(equal), out.get((doc, item), 0))
    return out


@given(st.lists(st.booleans(), min_size=1, max_size=30), st.sampled_from([0.5, 0.7, 0.75, 0.8, 1.0]))
def test_fullest_stretch(equal, share):
    first, length, count = spaced_seeds.fullest_stretch(np.array(equal), share)
    assert count == fullest(equal, share) == sum(equal[first:first + length]) and count >= share * length
    shorter = [(i, j) for i in range(len(equal)) for j in range(i, min(i + length, len(equal) + 1))]
    assert not any(sum(equal[i:j]) == count and count >= share * (j - i) for i, j in shorter if count)


def test_every_stretch_of_the_rule_has_a_seed():
    """A longer stretch has one half that fits the rule too, so those of up to 16 equal words stand for all."""
    masks = [(int(m, 2), len(m)) for m in spaced_seeds.MASKS]
    for n in range(8, 22):
        for zeros in range(n // 4 + 1):
            if 8 <= n - zeros <= 16:
                for places in itertools.combinations(range(1, n - 1), zeros):
                    pattern = (1 << n) - 1 - sum(1 << i for i in places)
                    assert any(pattern >> k & m == m for m, size in masks for k in range(n - size + 1)), bin(pattern)


@pytest.mark.parametrize("size,replaced", [(12, 2), (12, 3), (15, 3), (16, 4), (20, 3), (20, 4), (20, 5)])
def test_replaced_words_lose_no_item(spark, size, replaced):
    rng = random.Random(100 * size + replaced)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    around = lambda: [word() for _ in range(rng.randint(0, 9))]
    items, rows = [], []
    for i in range(40):
        text = [word() for _ in range(size)]
        items.append((i, " ".join(text)))
        places = (2, 9) if (size, replaced, i) == (12, 2, 0) else rng.sample(range(size), replaced)
        for j in places:
            text[j] = word()
        rows.append((i, " ".join([*around(), *text, *around()])))
    # Half of its words are no overlap.
    rows += [(100 + i, " ".join(w if j % 2 else word() for j, w in enumerate(t.split()))) for i, t in items]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    bench = spark.createDataFrame(items, "item_id LONG, text STRING")
    found = {(r["doc_id"], r["item_id"]): r["n_equal"] for r in spaced_seeds.find_overlaps(docs, bench).collect()}
    assert found == overlaps_by_rule(rows, items)
    assert set(found) == {(i, i) for i, _ in items}
    assert {r["doc_id"] for r in spaced_seeds.decontaminate(docs, bench).collect()} == {100 + i for i, _ in items}
