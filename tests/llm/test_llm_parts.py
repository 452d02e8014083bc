"""Small parts against plain versions on generated inputs."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from llm_brute import shingles, words

from triarm.llm import bucket_refinement, lsh_forest, piece_edges, pitman_yor, segments, spaced_seeds
from triarm.llm.components import components
from triarm.llm.text import SubstringHashes, cut_words, slices

settings.register_profile("llm", deadline=None, max_examples=60)
settings.load_profile("llm")

TEXT = st.text(alphabet="ab AB\n\t\x00é▁", max_size=60)


@given(st.lists(st.none() | TEXT, max_size=8), st.integers(1, 40))
def test_words_of_slices(texts, size):
    found = []
    for part in slices(pa.array(texts, type=pa.string()), size):
        w = cut_words(part)
        for a, b in zip(w.first, w.first[1:]):
            found.append([bytes(part.data[s:e]) for s, e in zip(w.starts[a:b], w.ends[a:b])])
    assert [[x.lower() for x in f] for f in found] == [[x.lower() for x in words(t)] for t in texts]


@given(st.lists(st.none() | TEXT, max_size=8))
def test_shingle_counts(texts):
    found = []
    for part in slices(pa.array(texts, type=pa.string())):
        found += np.diff(lsh_forest.shingle_sets(part)[1]).tolist()
    assert found == [len(shingles(t)) for t in texts]


@given(st.binary(min_size=1, max_size=60), st.data())
def test_substring_hashes(data, draw):
    h = SubstringHashes(np.frombuffer(data, dtype=np.uint8))
    spots = st.integers(0, len(data))
    a, b, c, d = (draw.draw(spots) for _ in range(4))
    a, b, c, d = min(a, b), max(a, b), min(c, d), max(c, d)
    x, y = h.of(np.array([a, c]), np.array([b, d]))
    assert (x == y) == (data[a:b] == data[c:d])


def segments_by_definition(scores):
    """Maximal segments: the best segment, then those of what is left of it and right of it."""
    best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i, j = -best[2], -best[2] - best[1]
    return segments_by_definition(scores[:i]) + [(i, j - 1)] + [(a + j, b + j) for a, b in segments_by_definition(scores[j:])]


@given(st.lists(st.sampled_from([-1, -1, -1, 1, 2, 3.5]), max_size=25))
def test_maximal_segments(scores):
    places = [i for i, s in enumerate(scores) if s > 0]
    found = segments.maximal_segments(places, [scores[i] for i in places], -1.0)
    assert sorted(round(s, 6) for *_, s in found) == sorted(round(sum(scores[a:b + 1]), 6) for a, b in segments_by_definition(scores))


@given(st.binary(max_size=40), st.lists(st.binary(min_size=1, max_size=20), min_size=1, max_size=10))
def test_suffix_array_ranges(data, pieces):
    data = bytes(97 + x % 3 for x in data) + b"abc"
    pieces = [bytes(97 + x % 3 for x in p) for p in pieces]
    array = piece_edges.SuffixArray(np.frombuffer(data, dtype=np.uint8), 25)
    ends = [np.array([int.from_bytes(p[:8].ljust(8, fill), "big") for p in pieces], dtype=np.uint64) for fill in (b"\0", b"\xff")]
    low, high = array.ranges(pieces, *ends)
    for p, a, b in zip(pieces, low, high):
        assert sorted(array.order[a:b].tolist()) == [i for i in range(len(data)) if data.startswith(p, i)]


@settings(deadline=None, max_examples=25)
@given(st.lists(st.text(alphabet="abc ", max_size=300), min_size=1, max_size=4), st.integers(0, 5))
def test_equal_windows_have_equal_anchors(texts, seed):
    rng = np.random.default_rng(seed)
    common = "".join(rng.choice(list("abcdefgh "), 460))
    texts = [t + common + t[::-1] for t in texts] + ["ab" * 260]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t) for t in texts)])
    text, first, last, at = bucket_refinement.anchors(SubstringHashes(np.frombuffer(data, dtype=np.uint8)), offsets)
    distance = {}
    windows = [w for a, b, x in zip(first, last, at) for w in [(i, x - i) for i in range(a, b + 1)]]
    for i, d in windows:
        assert distance.setdefault(data[i:i + 400], d) == d
    assert len(windows) == sum(max(0, len(t) - 399) for t in texts)


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    links += [(5000, 5001 + i) for i in range(40)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = components(spark.createDataFrame(links, "a LONG, b LONG")).collect()
    assert sorted(map(tuple, found)) == sorted((x, find(x)) for x in root)


def test_seats():
    rng = np.random.default_rng(0)
    customers = np.array([0, 1, 2, 50, 100_000])
    assert (pitman_yor.seat(customers, np.zeros(5), 0.5, rng) == [0, 1, 1, 1, 1]).all()
    assert (pitman_yor.seat(customers, np.full(5, 1e18), 0.5, rng) == customers).all()
    # Mean number of tables of one dish: the process of one restaurant, d = 0, pull 1: 1 + sum 1 / (1 + k).
    mean = np.mean([pitman_yor.seat(np.array([40]), np.array([1.0]), 0.0, rng)[0] for _ in range(4000)])
    assert abs(mean - (1 + sum(1 / (1 + k) for k in range(1, 40)))) < 0.1


def test_evidence_is_that_of_the_plan(spark):
    """The column expression gives what the plain function gives."""
    model = segments.Model(segments.Scores(np.zeros(0, np.uint64), np.zeros(0), -0.1), -3.0, 1.0, 0.0)
    cut = cut_words(next(slices(pa.array(["vile evil x vile y y y y evil"])), None), letters_only=True)
    units = np.unique(cut.hashes[[0, 1]])
    model.scores = segments.Scores(units, np.array([4.0, 6.0]), -0.5)
    docs = spark.createDataFrame([(1, "vile evil x vile y y y y evil"), (2, "x y"), (3, "evil"), (4, "")], "doc_id INT, text STRING")
    found = segments.find_segments(docs, model.scores).collect()
    scored = {r["doc_id"]: r["score"] for r in segments.score(docs, model).collect()}
    for r in found:
        x = segments.evidence([p["score"] for p in r["passages"]], r["n_tokens"], model.log_k)
        assert abs(scored[r["doc_id"]] - 1 / (1 + np.exp(-np.log1p(x)))) < 1e-9
