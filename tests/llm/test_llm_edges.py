"""Odd rows, empty tables and planted cases for every operator and stage."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from llm_brute import base_scores, components, overlaps, quality_counts, repeats
from pyspark.sql import functions as F

import corpus_pipeline
from triarm.llm import (
    bucket_refinement, decision_list, lsh_forest, piece_edges, pitman_yor, segments, slot_table, spaced_seeds, token_rollup,
    url_ratio,
)
from triarm.llm.queries import URL_RULES, VOCABULARY


def plain(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def texts(odd_documents):
    return plain(odd_documents)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i in (1, 2))) for i in range(1, 16)] + [(None, 1, 1), (3, None, None), (99, 1, 0), (5, 0, 1)]
    return spark.createDataFrame(rows, "doc_id LONG, quality INT, toxic INT")


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, "quick brown fox jumps over the lazy dog near the"), (2, None), (3, ""), (4, "two words"), (None, "is no item id here"),
            (5, "some words that nobody else has ever used in this order"), (5, "five words of a kind"), (6, "one line of it one line of it")]
    return spark.createDataFrame(rows, "item_id LONG, text STRING").withColumn("doc_id", F.lit("clash"))


@pytest.fixture(scope="module")
def nothing(odd_documents):
    return odd_documents.where("doc_id = -1")


def test_overlaps_of_odd_rows(odd_documents, texts, benchmark, nothing):
    found = spaced_seeds.find_overlaps(odd_documents, benchmark)
    short = [t for t in texts if len(t[1] or "") < 5000]
    items = [(r["item_id"], r["text"]) for r in benchmark.where("text IS NOT NULL").collect()]
    mine = {}
    for r in found.collect():
        if r["doc_id"] not in (6, 7, 14):
            mine[r["doc_id"], r["item_id"]] = max(r["n_equal"], mine.get((r["doc_id"], r["item_id"]), 0))
    assert mine == overlaps(short, items)
    assert {k for k in mine} >= {(1, 1), (None, 1), (15, 6)}
    assert spaced_seeds.find_overlaps(nothing, benchmark).count() == 0
    assert spaced_seeds.find_overlaps(odd_documents, benchmark.where("item_id = -1")).count() == 0


def test_benchmark_in_blocks_finds_the_same(odd_documents, benchmark, monkeypatch):
    whole = sorted(map(tuple, spaced_seeds.find_overlaps(odd_documents, benchmark).collect()), key=repr)
    blocks = spaced_seeds.blocks
    monkeypatch.setattr(spaced_seeds, "blocks", lambda b: blocks(b, 60))
    assert sorted(map(tuple, spaced_seeds.find_overlaps(odd_documents, benchmark).collect()), key=repr) == whole


def test_overlaps_tolerate_substitutions(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(rng.randint(20, 50)))) for i in range(20)]
    rows = []
    for i, text in items:
        w = text.split()
        for j in rng.sample(range(len(w)), len(w) // 8):
            w[j] = word()
        rows.append((i, " ".join([*(word() for _ in range(30)), *w, *(word() for _ in range(30))]).upper()))
    clean = [(100 + i, " ".join(word() for _ in range(100))) for i in range(20)]
    docs = spark.createDataFrame(rows + clean, "doc_id LONG, text STRING")
    bench = spark.createDataFrame(items, "item_id LONG, text STRING")
    found = spaced_seeds.find_overlaps(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, i) for i, _ in items}
    assert {r["doc_id"] for r in spaced_seeds.decontaminate(docs, bench).collect()} == {i for i, _ in clean}


def test_rollup_commits_once(spark, tmp_path):
    rows = [("insert", "s", "en", "v", 5, None), ("insert", "s", "en", "v", 5, None), ("insert", None, None, "v", None, None),
            ("revise", "s", "en", "v", 9, 5), ("delete", "s", "en", "v", 5, None)]
    changes = spark.createDataFrame(rows, "kind STRING, source STRING, lang STRING, tokenizer STRING, n_tokens LONG, old_tokens LONG")
    rollup = token_rollup.TokenRollup(spark, f"{tmp_path}/r")
    assert rollup.totals().count() == 0
    assert rollup.commit("a", changes.withColumn("d_docs", F.lit("clash"))) and not rollup.commit("a", changes)
    assert rollup.commit("none", changes.where("false"))
    (tmp_path / "r" / "batch=half").mkdir()  # a try that failed
    assert sorted(map(tuple, rollup.totals().collect()), key=repr) == [("s", "en", "v", 1, 9, 4), (None, None, "v", 1, 0, 1)]
    assert rollup.commit("half", changes.where("kind = 'delete'"))
    assert {tuple(r) for r in rollup.totals().collect()} >= {("s", "en", "v", 0, 4, 5)}
    with pytest.raises(Exception, match="unknown kind"):
        rollup.commit("bad", changes.withColumn("kind", F.lit("x")))
    with pytest.raises(ValueError):
        rollup.commit("../x", changes)
    assert rollup.totals().count() == 2


def test_near_duplicates_of_odd_rows(odd_documents, texts, nothing):
    found = [tuple(r) for r in lsh_forest.near_duplicates(odd_documents).collect()]
    assert sorted(found, key=repr) == sorted(components(texts), key=repr)
    assert lsh_forest.near_duplicates(nothing).count() == 0


def test_near_duplicates_keep_every_link(spark):
    """Chains of edits, among copies and texts that share a passage with all others."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    passage = " ".join(word() for _ in range(40))
    rows, base = [], [word() for _ in range(120)]
    for i in range(150):
        rows.append((i, " ".join(base)))
        for j in rng.sample(range(len(base)), 2):
            base[j] = word()
    rows += [(1000 + i, " ".join(word() for _ in range(rng.randint(5, 80))) + " " + passage) for i in range(150)]
    rows += [(2000 + i, rows[7][1]) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    assert sorted(map(tuple, lsh_forest.near_duplicates(docs).collect())) == sorted(components(rows))


def test_near_duplicates_leave_one_of_each(odd_documents):
    kept = lsh_forest.drop_near_duplicates(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 3, 4, 5, 6, 7, 8, 11, 12, 15, None, None], key=repr)


def test_language_model_of_odd_rows(odd_documents, texts, nothing):
    model = pitman_yor.fit(odd_documents.where(~pitman_yor.held_out()))
    found = [tuple(r) for r in pitman_yor.score(odd_documents, model).collect()]
    wanted = sorted([(r[0], r[2], r[3], round(r[5], 6)) for r in base_scores(texts)], key=repr)
    assert sorted([(*r[:3], round(r[3], 6)) for r in found], key=repr) == wanted
    assert all(math.isfinite(r[4]) and r[4] < 0 for r in found)
    again = pitman_yor.score(odd_documents.repartition(5), pitman_yor.fit(odd_documents.where(~pitman_yor.held_out()).repartition(7)))
    close = lambda rows: sorted([(r[0], r[1], round(r[4], 6)) for r in rows], key=repr)
    assert close(found) == close(map(tuple, again.collect()))
    empty = pitman_yor.fit(nothing)
    assert pitman_yor.score(nothing, empty).count() == 0
    assert all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in pitman_yor.score(odd_documents, empty).collect())


def test_language_model_is_a_distribution(spark):
    """Probabilities of all known tokens and one unknown add up to one after every context, also unseen ones."""
    docs = spark.createDataFrame([(i, "ab cd e ab cd f gh " * 3 + "ab") for i in range(20)], "doc_id LONG, text STRING")
    model = pitman_yor.fit(docs)
    parts = [pitman_yor.Part.unpack(r["data"]) for r in model.parts.collect()]
    assert sum(len(p.words) for p in parts) == model.samples[0].kinds == 6
    for context in (pitman_yor.START, ord("a") * 256 + ord("b"), ord("e"), ord("x") * 256 + ord("b"), 60_000):
        total = 0.0
        for part in [*parts, None]:
            words = part.words if part else np.array([1], dtype=np.uint64)
            chance, _ = pitman_yor.log_probabilities(part, model.samples, words, np.arange(len(words)), np.full(len(words), context))
            total += chance.sum()
        assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_quality_of_odd_rows(odd_documents, texts, labels, nothing):
    rules = decision_list.fit(odd_documents, labels)
    found = decision_list.judge(odd_documents, rules).collect()
    assert sorted([(r["doc_id"], *(r[c] for c in decision_list.COUNTS)) for r in found], key=repr) == sorted(
        [(d, *quality_counts(t)) for d, t in texts], key=repr)
    assert all(r["kept"] is not None and r["base_failed"] is not None for r in found)
    assert decision_list.judge(nothing, rules).count() == 0
    assert decision_list.fit(nothing, labels) == [] == decision_list.fit(odd_documents, labels.where("false"))
    assert decision_list.learn([]) == [] == decision_list.learn([(1, *[0.5] * 8)] * 9)


def test_decision_list_finds_planted_rules():
    rng = random.Random(5)
    rows = []
    for _ in range(3000):
        x = [rng.random() for _ in decision_list.FEATURES]
        bad = x[2] > 0.7 and x[3] <= 0.5 or x[5] > 0.9
        rows.append((0 if bad else 1, *x))
    rules = decision_list.learn(rows)
    names = [{c.feature for c in r} for r in rules]
    assert {"upper_share"} in names and {"symbol_share", "dup_line_share"} in names


def test_toxicity_of_odd_rows(odd_documents, labels, nothing):
    model = segments.fit(odd_documents, labels)
    found = segments.score(odd_documents, model).collect()
    assert len(found) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in found)
    assert segments.score(nothing, model).count() == 0
    kept = segments.reject(odd_documents, model)
    assert kept.columns == odd_documents.columns
    for none in (segments.fit(nothing, labels), segments.fit(odd_documents, labels.where("false"))):
        assert len({r["score"] for r in segments.score(odd_documents, none).collect()}) == 1


def test_toxic_passages_are_found(spark):
    rng = random.Random(2)
    common, bad = [f"w{i}" for i in range(300)], [f"vile{i}" for i in range(5)]
    rows, marks = [], []
    for i in range(400):
        w = [rng.choice(common) for _ in range(80)]
        if toxic := i % 4 == 0:
            at = rng.randrange(60)
            w[at:at + 3] = [rng.choice(bad) for _ in range(3)]
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    model = segments.fit(docs, spark.createDataFrame(marks, "doc_id LONG, toxic INT"))
    for r in segments.score(docs, model).collect():
        assert r["predicted"] == (r["doc_id"] % 4 == 0)
        if r["predicted"]:
            words = rows[r["doc_id"]][1].split()
            assert any(sum(w.startswith("vile") for w in words[p["first"]:p["last"] + 1]) == 3 for p in r["passages"])
            assert all(p["last"] - p["first"] < 40 for p in r["passages"])


def test_repeats_of_odd_rows(odd_documents, texts, nothing):
    found = bucket_refinement.repeated_spans(odd_documents.withColumn("rest", F.lit("clash")))
    kept = [c for c in odd_documents.columns if c not in ("text", "starts")]
    assert found.columns == [*kept, "starts", "ends", "rest"]
    rows = found.select("doc_id", F.size("starts"), F.sha2("rest", 256)).collect()
    wanted = repeats(texts)
    assert sorted(map(tuple, rows), key=repr) == sorted([(r[0], r[3], r[4]) for r in wanted], key=repr)
    assert bucket_refinement.repeated_spans(nothing).count() == 0
    again = bucket_refinement.remove_repeats(odd_documents)
    assert again.columns == odd_documents.columns and again.count() == odd_documents.count()
    assert all(r["n_chars"] == len(r["text"]) for r in again.collect())


def test_repeats_of_planted_passages(spark):
    """Passages around the limit, in several surroundings, periodic text, and near copies with many partners."""
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    passages = [noise(n) for n in (398, 399, 400, 401, 450, 700, 1500)]
    rows = []
    for i, p in enumerate(passages * 3):
        rows.append((i, noise(rng.randint(0, 600)) + p + noise(rng.randint(0, 600))))
    base = noise(3000)
    for i in range(30):  # each pair shares other windows
        cut = sorted(rng.sample(range(3000), 3))
        rows.append((100 + i, base[:cut[0]] + "#" + base[cut[0]:cut[1]] + noise(3) + base[cut[1]:cut[2]]))
    rows += [(200, "ab" * 600), (201, "x" * 1000), (202, "abc" * 300 + noise(200)), (203, "é" * 500 + "ü" * 300)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    found = bucket_refinement.repeated_spans(docs).select("doc_id", F.size("starts"), F.sha2("rest", 256)).collect()
    assert sorted(map(tuple, found)) == sorted((r[0], r[3], r[4]) for r in repeats(rows))


def test_repeats_in_a_text_of_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(bucket_refinement, "PIECE", 700)
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    passage = noise(900)
    rows = [(1, noise(2500) + passage + noise(2000) + passage + noise(100)), (2, passage[:500]), (3, noise(5000))]
    windows = set()
    for rows_, data, offsets, begin in bucket_refinement._pieces(pa.array([t for _, t in rows[:1]])):
        _, first, last, _ = bucket_refinement.anchors(bucket_refinement.SubstringHashes(data), offsets)
        for a, b in zip(first + begin, last + begin):
            assert not windows & set(range(a, b + 1))
            windows |= set(range(a, b + 1))
    assert windows == set(np.arange(len(rows[0][1]) - 400 + 1).tolist())
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    found = bucket_refinement.repeated_spans(docs).select("doc_id", F.size("starts"), F.sha2("rest", 256)).collect()
    assert sorted(map(tuple, found)) == sorted((r[0], r[3], r[4]) for r in repeats(rows))


def test_urls_of_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "a://b://c/d", "http://x.net/es/1", "http://x.net",
            "http://net/fr/", "http://other.org/en/" + "long" * 5000, "http://x.net/es/1", "http://good.com/a b", "http://é.com/ü"]
    pages = spark.createDataFrame([(i, u, "s") for i, u in enumerate(urls)], "page_id LONG, url STRING, score STRING")
    found = {r["page_id"]: r for r in url_ratio.judge(pages, "url", URL_RULES).collect()}
    assert len(found) == len(urls) and all(r["verdict"] in ("allow", "block") for r in found.values())
    assert (found[4]["host"], found[4]["path"], found[4]["rule"], found[4]["verdict"]) == (
        "www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (found[0]["host"], found[0]["path"], found[5]["host"], found[5]["path"]) == ("", "", "b:", "//c/d")
    assert [found[i]["rule"] for i in (6, 7, 8, 10, 11)] == ["net/es/", None, "net/fr/", "net/es/", "com/"]
    assert url_ratio.judge(pages.where("false"), "url", URL_RULES).count() == 0
    only = url_ratio.judge(pages.where("page_id IN (9, 11)"), "url", URL_RULES).collect()
    assert {r["verdict"] for r in only} == {"allow"}  # nothing was rejected, so nothing is learned


def test_url_models_tell_kinds_apart(spark):
    rows = [(i, f"http://good{i}.com/story/{i}") for i in range(60)] + [(100 + i, f"http://spam{i}.net/es/casino{i}") for i in range(60)]
    rows += [(300, "http://good7.org/story/9"), (301, "http://spam8.org/es/casino3")]
    found = {r["page_id"]: r["verdict"] for r in url_ratio.judge(
        spark.createDataFrame(rows, "page_id LONG, url STRING"), "url", URL_RULES).collect()}
    assert (found[300], found[301]) == ("allow", "block")


def test_encoding_of_odd_rows(odd_documents, nothing):
    sentencepiece = pytest.importorskip("sentencepiece")
    vocabulary = piece_edges.Vocabulary.load(VOCABULARY)
    model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    odd = odd_documents.withColumn("ids", F.lit("clash"))
    rows = piece_edges.decode(piece_edges.encode(odd, vocabulary), vocabulary, text="back")
    assert rows.columns == [*odd_documents.columns, "ids", "back"]
    for r in rows.collect():
        assert r["ids"] == model.encode(r["text"] or "")
        assert r["back"] == (r["text"] or "").replace("▁", " ")
    assert piece_edges.encode(nothing, vocabulary).count() == 0


def test_decoding_of_odd_ids(spark):
    vocabulary = piece_edges.Vocabulary.load(VOCABULARY)
    byte = vocabulary.bytes_at[0xC3]
    rows = spark.createDataFrame([(1, None), (2, []), (3, [byte]), (4, [1, 2])], "k INT, ids ARRAY<INT>")
    found = {r["k"]: r["text"] for r in piece_edges.decode(rows, vocabulary).collect()}
    assert found == {1: "", 2: "", 3: "\ufffd", 4: ""}
    with pytest.raises(Exception, match="outside the vocabulary"):
        piece_edges.decode(rows.withColumn("ids", F.array(F.lit(-1))), vocabulary).collect()


def test_placement_of_odd_rows(odd_documents, nothing, tmp_path):
    table = slot_table.build_table(["a", "b", "c"], 101)
    placed = slot_table.place(odd_documents.withColumn("slot", F.lit("clash")), "doc_id", table)
    assert placed.columns == [*odd_documents.columns, "slot", "shard"] and placed.count() == odd_documents.count()
    by_id = placed.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).collect()
    assert all(r["n"] == 1 for r in by_id)
    assert slot_table.place(nothing, "doc_id", table).count() == 0
    slot_table.write_shards(placed, f"{tmp_path}/s", files_per_shard=2)
    assert odd_documents.sparkSession.read.parquet(f"{tmp_path}/s").count() == odd_documents.count()


def test_slots_are_shared_evenly_and_mostly_stay():
    names = [f"s{i}" for i in range(20)]
    table, less = slot_table.build_table(names, 5003), slot_table.build_table(names[:-1], 5003)
    counts = [table.owners.count(i) for i in range(20)]
    assert max(counts) - min(counts) <= 1
    moved = sum(a != b for a, b in zip(table.owners, less.owners) if a != 19)
    assert moved < 0.15 * 5003
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (["a"] * 1, 1_000_033)):
        with pytest.raises(ValueError):
            slot_table.build_table(*bad)


def test_stages_on_odd_rows(spark, odd_documents, labels, benchmark, tmp_path):
    docs = odd_documents.select("doc_id", "text", "lang", "source", "n_chars")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.where("false"), str(tmp_path))
        assert empty.count() == 0, name
        if name != "encoding":
            assert empty.columns == docs.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r["round_trip"] for r in out) and {r["doc_id"] for r in out} >= {3, 4, 5}
    assert {r["doc_id"]: r["n_ids"] for r in out}[15] < 20  # its lines repeat, and are gone before the benchmark is looked for
    assert 1 not in {r["doc_id"] for r in out}  # called toxic, or overlaps the benchmark


def test_pipeline_is_the_plain_composition(spark, small_dir):
    """Every stage against a plain version of itself on what the one before kept."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, small_dir).cache()
    scored = segments.score(docs.select("doc_id", "text"), segments.fit(docs, spark.read.parquet(f"{small_dir}/labels.parquet")))
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in scored.where("predicted = 0").collect()}
    single = stages["near_dedup"](spark, kept, small_dir).cache()
    assert sorted(plain(single)) == sorted(t for t, c in zip(plain(kept), components(plain(kept))) if c[3])
    cut = stages["suffix_dedup"](spark, single, small_dir).cache()
    sizes = {r[0]: r[1] - r[2] for r in repeats(plain(single))}
    assert all(0 <= sizes[d] - len(t.encode()) < 8 for d, t in plain(cut)) and cut.count() == single.count()
    clean = stages["decontamination"](spark, cut, small_dir).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").select("item_id", "text").collect()]
    gone = {d for d, _ in plain(cut)} - {d for d, _ in plain(clean)}
    short = [t for t in plain(cut) if len(t[1]) < 4000]
    assert {d for d, _ in overlaps(short, items)} == gone & {d for d, _ in short}
    out = stages["encoding"](spark, clean, small_dir).collect()
    assert {r["doc_id"] for r in out} == {d for d, _ in plain(clean)} and all(r["round_trip"] for r in out)


def test_pairs_of_a_large_region_are_shared_out_and_found_once(spark, monkeypatch):
    """All pairs of a region of many sets, in groups of two chunks; those of one component, unlike sizes or bits, or met before stay out."""
    monkeypatch.setattr(lsh_forest, "CHUNK", 8)
    rng = random.Random(5)
    sets, half = [], lsh_forest.SCREEN // 64
    for i in range(60):
        bits = [0] * (2 * half)
        for j in rng.sample(range(lsh_forest.SCREEN), rng.choice([0, 100, 300])):
            bits[j // 64] |= 1 << (j % 63)
        regions = [0] * lsh_forest.TREES
        regions[2], regions[5] = 7 if i % 3 else 0, 9
        sets.append((b"%02d" % i, b"c%d" % (i // 4), rng.choice([80, 100, 140]), bits, regions))
    met = [s for s in sets if s[4][2]]
    unsettled = [(5, s[0], s[1], 9, 60) for s in sets] + [(2, s[0], s[1], 7, len(met)) for s in met]
    found = lsh_forest.candidates(
        spark.createDataFrame(unsettled, "tree INT, node BINARY, component BINARY, region LONG, members LONG"),
        spark.createDataFrame([(s[0], s[3], s[2], s[4]) for s in sets],
                              "node BINARY, bits ARRAY<LONG>, n_shingles LONG, regions ARRAY<LONG>")).collect()
    differ = lambda x, y: sum(bin((x[i] ^ y[i]) | (x[i + half] ^ y[i + half])).count("1") for i in range(half))
    expected = sorted(
        (x[0], y[0]) for i, x in enumerate(sets) for y in sets[i + 1:]
        if x[1] != y[1] and 100 * min(x[2], y[2]) >= 75 * max(x[2], y[2]) and differ(x[3], y[3]) <= lsh_forest.MAX_DIFFERENT)
    assert sorted(tuple(sorted(map(bytes, r))) for r in found) == expected
    assert 100 < len(expected) < 1770


@pytest.mark.parametrize("find, columns", [(bucket_refinement._find_anchors, ["key", "text"]), (lsh_forest._sketch, ["doc_id", "text"])])
def test_workers_hold_few_arrays_of_a_batch(find, columns):
    """What a task holds at a time, besides the batch, is bounded by the slice and not by the batch."""
    rng = random.Random(8)
    texts = [" ".join(f"{rng.randrange(1 << 40):x}" for _ in range(400)) for _ in range(800)]
    first = [b"%016d" % i for i in range(len(texts))] if columns[0] == "key" else list(range(len(texts)))
    batch = pa.RecordBatch.from_arrays([pa.array(first), pa.array(texts)], names=columns)
    assert batch.nbytes > 3 << 20 
    list(find(iter([batch.slice(0, 2)])))  # fills the tables that stay
    tracemalloc.start()
    rows = sum(x.num_rows for x in find(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= len(texts) and peak < 40 << 20
