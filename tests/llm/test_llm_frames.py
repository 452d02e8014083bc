"""Fill-in-middle over compressed frames against cutting lists of units."""

import hashlib

import pytest
from llm_brute import middles
from pyspark.sql import functions as F

from triarm.llm import seekable_frames
from triarm.llm.seekable_frames import Frames

SEED, PERCENT, SPM = 42, 100, 50


@pytest.fixture(scope="module")
def texts(spark, odd_documents):
    marked = [(50, "holds <M> a marker"), (51, "< P> no marker <p>"), (52, "one"), (53, " one"), (54, "one "), (55, "\n"),
              (56, "é😀 " * 40_000), (57, "x" * 200_001), (58, "é" * 70_000 + " end"), (59, " " * 140_000 + "a")]
    more = spark.createDataFrame(marked, "doc_id LONG, text STRING")
    return odd_documents.unionByName(more, allowMissingColumns=True)


def test_outputs_of_odd_rows(texts):
    docs = [tuple(r) for r in texts.select("doc_id", "text").collect()]
    for percent, spm in ((PERCENT, SPM), (50, 80), (0, 0)):
        wanted = list(middles(docs, SEED, percent, spm))
        cuts = seekable_frames.choose_cuts(seekable_frames.to_frames(texts), SEED, percent, spm)
        made = seekable_frames.outputs(cuts)
        assert sorted(map(tuple, made.collect()), key=repr) == sorted(wanted, key=repr)
        assert sorted(map(tuple, seekable_frames.restore(made).collect()), key=repr) == sorted(((d, t or "") for d, t in docs), key=repr)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        whole = {d: t or "" for d, t in docs if d is not None}
        found = [tuple(r) for r in seekable_frames.digests(cuts).collect()]
        assert sorted(r[:6] for r in found if r[0] is not None) == sorted((*w[:5], sha(w[5])) for w in wanted if w[0] is not None)
        assert all(r[6] == sha(whole[r[0]]) for r in found if r[0] is not None)


def test_empty_table(texts):
    framed = seekable_frames.to_frames(texts.where("doc_id = -1"))
    assert seekable_frames.digests(seekable_frames.choose_cuts(framed, 1, 50, 50)).count() == 0


def test_no_draw_shares_its_seed(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b c d e f g h").alias("text"))
    framed = seekable_frames.to_frames(docs)
    cut = lambda seed: {tuple(r) for r in seekable_frames.choose_cuts(framed, seed, 50, 80).select("doc_id", "form", "first").collect()}
    assert cut(1) == cut(1) and cut(1) != cut(2)
    forms = [f for _, f, _ in cut(1)]
    assert 160 < forms.count("plain") < 240 and forms.count("spm") > 2 * forms.count("psm")


@pytest.mark.parametrize("frame_bytes", [5, 8, 64])
def test_frames_of_any_size(frame_bytes, monkeypatch):
    monkeypatch.setattr(seekable_frames, "FRAME_BYTES", frame_bytes)
    for text in ("", " ", "a", "ab cd", "é " * 9, "😀😀 😀" * 7, "  two  spaces  ", "abcdefgh ijklmnop qrstuvwx", "a\tb\nc\x0bd", "12345678 " * 3):
        data, units = text.encode(), list(middles([(1, text)], 1, 100, 0))[0][1]
        frames, n, n_chars = Frames.of(iter([data[i:i + 3] for i in range(0, len(data), 3)]), bytes)
        monkeypatch.setattr(Frames, "frame", lambda self, i: self.rows[i]["data"])
        assert (n, n_chars, frames.n_bytes) == (units, len(text), len(data))
        assert b"".join(frames.stream()) == data
        from llm_brute import UNITS
        parts = UNITS.findall(text)
        for k in range(n + 1):
            cut = frames.after_units(k, n, n_chars)
            assert (cut.bytes, cut.chars) == (len("".join(parts[:k]).encode()), len("".join(parts[:k])))


def test_a_cut_opens_one_frame(monkeypatch):
    opened = []
    data = b"word " * 100_000
    frames, n, n_chars = Frames.of(iter([data]), bytes)
    monkeypatch.setattr(Frames, "frame", lambda self, i: opened.append(i) or self.rows[i]["data"])
    assert frames.after_units(70_000, n, n_chars).bytes == 70_000 * 5 - 1
    assert len(opened) == 1 and len(frames.rows) == 8
    assert len(list(frames.stream(10, 20))) == 1 and len(opened) == 2
