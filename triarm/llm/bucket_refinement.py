"""Suffix-array dedup by bucket refinement: bytes inside strings that are found twice.

A repeated string of ``SPAN`` bytes is a bucket of ``SPAN``-byte windows with two members. Windows are not
sorted byte by byte. Each window has an anchor: the place, the first if there are several, of its least
``GRAM``-byte hash. Equal windows have equal anchors at equal distances, so the initial buckets are the grams
at the anchors, about one for 150 bytes of text. A bucket with one member holds no repeated window. A
bucket whose members agree in all of their windows is settled. Any other is refined, with windows in blocks by
their distance to the anchor: a block's members are ordered by the identifier of what all its windows share,
bytes at later and earlier offsets, and what falls alone is out. The identifiers of one round are the buckets
of the next, for blocks an eighth the size, down to single windows.

Identifiers are 64-bit hashes of the bytes, combined with that of the bucket they refine.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from triarm.llm.text import SubstringHashes, map_arrow, mix, signed, slices, text_key, unused
from triarm.sources.scratch import stored

SPAN = 400
GRAM = 100
BLOCKS = (64, 8, 1)
# Bytes of one text that are anchored together; longer texts are cut, with the windows dealt among the parts.
PIECE = 1 << 20
PLACE_BITS = np.uint64(24)


def anchors(hashes: SubstringHashes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, first window, last window, anchor)`` of each run of windows with one anchor, in order.

    Windows begin at the returned places and lie within one text.
    """
    n, reach = int(offsets[-1]), SPAN - GRAM + 1
    none = np.zeros(0, dtype=np.int64)
    if n < SPAN:
        return none, none, none, none
    place = np.arange(n - GRAM + 1)
    least = ((hashes.of(place, place + GRAM) >> PLACE_BITS) << PLACE_BITS) | place.astype(np.uint64)
    width = 1
    while width < reach:
        step = min(width, reach - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    # Window p reads the grams at p .. p + reach - 1; n - SPAN + 1 windows, those across two texts are left out.
    at = (least & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(at)]
    windows = np.flatnonzero(np.arange(len(at)) + SPAN <= offsets[1:][text])
    if not len(windows):
        return none, none, none, none
    at, text = at[windows], text[windows]
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (np.diff(windows) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(windows)) - 1
    return text[first], windows[first], windows[last], at[first]


def _pieces(texts: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray, int]]:
    """Rows, bytes, offsets and the place in the text where the bytes begin."""
    for part in slices(texts):
        n = len(part.data)
        if len(part.offsets) == 2 and n > 2 * PIECE:
            for begin in range(0, n - SPAN + 1, PIECE):
                data = part.data[begin:begin + PIECE + SPAN - 1]
                yield part.rows, data, np.array([0, len(data)]), begin
        else:
            yield part.rows, part.data, part.offsets, 0


ANCHOR = "key BINARY, bucket BIGINT, sig BIGINT, n BIGINT, first BIGINT, last BIGINT, anchor BIGINT"


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows; those equal to another of the same piece are said to repeat at once (no ``bucket``)."""
    names = [x.split()[0] for x in ANCHOR.split(", ")]
    for batch in batches:
        keys = batch.column("key")
        for rows, data, offsets, begin in _pieces(batch.column("text")):
            hashes = SubstringHashes(data)
            text, first, last, at = anchors(hashes, offsets)
            if not len(text):
                continue
            bucket = hashes.of(at, at + GRAM)
            shape = ((at - first) * SPAN + (at - last)).astype(np.uint64)
            sig = mix(hashes.of(first, last + SPAN) + mix(shape))
            order = np.lexsort((sig, bucket))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (bucket[order][1:] != bucket[order][:-1]) | (sig[order][1:] != sig[order][:-1])
            count = np.diff(np.append(np.flatnonzero(new), len(order)))
            head = order[new]
            start = begin - offsets[:-1][text]
            columns = lambda x: [pa.array(signed(bucket[x])), pa.array(signed(sig[x]))]
            places = lambda x: [pa.array((c + start)[x]) for c in (first, last, at)]
            key = lambda x: keys.take(pa.array(text[x] + rows.start))
            yield pa.RecordBatch.from_arrays([key(head), *columns(head), pa.array(count), *places(head)], names=names)
            rest = order[~new]
            if len(rest):
                nothing = pa.nulls(len(rest), pa.int64())
                yield pa.RecordBatch.from_arrays([key(rest), nothing, nothing, pa.array(np.ones(len(rest), np.int64)),
                                                  *places(rest)], names=names)


CONTEXT = "bucket BIGINT, sig BIGINT, open BOOLEAN, key BINARY, anchor BIGINT, low INT, high INT, context BINARY"


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of all windows of the runs in ``runs``, with the least and largest distance to the anchor."""
    names = [x.split()[0] for x in CONTEXT.split(", ")]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for key, text, runs in zip(*(batch.column(c) for c in ("key", "text", "runs"))):
            data = text.as_buffer()
            for r in runs.as_py():
                row = (r["bucket"], r["sig"], r["open"], key.as_py(), r["anchor"], r["anchor"] - r["last"], r["anchor"] - r["first"],
                       data.slice(r["first"], r["last"] - r["first"] + SPAN).to_pybytes())
                for column, value in zip(out, row):
                    column.append(value)
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types)], names=names)


def _identify(size: int):
    """Rows ``bucket, sig, parent, block, core, whole`` of the blocks of each context.

    ``parents`` are the blocks, eight times the size, that are left of a context with their identifiers; NULL
    at first. ``core`` names what all windows of the block share, ``whole`` all of them (0 if some of the
    block's windows are not the context's).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("context")):
                rows = range(part.rows.start, part.rows.stop)
                hashes = SubstringHashes(part.data)
                low, high = (batch.column(c).to_numpy()[part.rows].astype(np.int64) for c in ("low", "high"))
                owner, block, parent = [], [], []
                for i, r in enumerate(rows):
                    parents = batch.column("parents")[r].as_py()
                    for p in [{"block": None, "id": batch.column("bucket")[r].as_py()}] if parents is None else parents:
                        a, b = low[i] // size, high[i] // size
                        if p["block"] is not None:
                            a, b = max(a, 8 * p["block"]), min(b, 8 * p["block"] + 7)
                        owner += [i] * (b - a + 1)
                        block += range(a, b + 1)
                        parent += [p["id"]] * (b - a + 1)
                owner, block = np.array(owner, dtype=np.int64), np.array(block, dtype=np.int64)
                near, far = block * size, block * size + size - 1  # distances to the anchor
                home = part.offsets[:-1][owner] + high[owner]
                above = np.array(parent, dtype=np.int64).view(np.uint64)
                named = lambda x: mix(mix(x ^ above) + block.astype(np.uint64))
                core = named(hashes.of(home - near, home - far + SPAN))
                inside = (near >= low[owner]) & (far <= high[owner])
                whole = np.zeros(len(owner), dtype=np.uint64)
                whole[inside] = named(np.zeros(len(owner), np.uint64))[inside] ^ hashes.of(
                    (home - far)[inside], (home - near)[inside] + SPAN)
                source = pa.array(owner + part.rows.start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("bucket").take(source), batch.column("sig").take(source), pa.array(block),
                     pa.array(signed(core)), pa.array(signed(whole))], names=["bucket", "sig", "block", "core", "whole"])
    return run


def _refine(contexts: DataFrame) -> DataFrame:
    """``key, first, last``: windows of open contexts that are found in another context of their bucket."""
    found = None
    parents = "ARRAY<STRUCT<block: BIGINT, id: BIGINT>>"
    live = contexts.withColumn("parents", F.lit(None).cast(parents))
    for size in BLOCKS:
        rows = stored(live.transform(map_arrow,
            _identify(size), "bucket BIGINT, sig BIGINT, block BIGINT, core BIGINT, whole BIGINT"), "blocks")
        shared = rows.groupBy("core").agg(F.count("*").alias("members")).where("members > 1")
        rows = rows.join(shared, "core")
        equal = rows.where("whole <> 0").groupBy("core", "whole").agg(
            F.count("*").alias("equal"), F.min(F.struct("bucket", "sig")).alias("speaker")).where("equal > 1")
        rows = stored(rows.join(equal, ["core", "whole"], "left"), "refined")
        settled = F.col("equal").isNotNull()
        hits = rows.where(settled).join(contexts.where("open").select("bucket", "sig", "key", "anchor"), ["bucket", "sig"]).select(
            "key", (F.col("anchor") - size * F.col("block") - (size - 1)).alias("first"),
            (F.col("anchor") - size * F.col("block")).alias("last"))
        found = hits if found is None else found.unionByName(hits)
        # One of the settled members speaks for them to members that differ somewhere in the block.
        left = rows.where(~settled | ((F.col("speaker") == F.struct("bucket", "sig")) & (F.col("equal") < F.col("members"))))
        left = left.groupBy("bucket", "sig").agg(F.collect_list(F.struct("block", F.col("core").alias("id"))).alias("parents"))
        if size > 1:
            live = stored(contexts.join(left, ["bucket", "sig"]), "contexts")
    return found


def _apply(spans_name: str):
    """Merge the spans of each text and cut them out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, kept = [], [], []
            for text, spans in zip(batch.column("text"), batch.column(spans_name)):
                data = b"" if text.as_py() is None else text.as_buffer().to_pybytes()
                begin, end, rest = [], [], []
                for a, b in sorted((s["start"], s["end"]) for s in spans.as_py() or ()):
                    if end and a <= end[-1]:
                        end[-1] = max(end[-1], b)
                    else:
                        begin.append(a)
                        end.append(b)
                for a, b in zip([0, *end], [*begin, len(data)]):
                    rest.append(data[a:b])
                starts.append(begin)
                ends.append(end)
                kept.append(b"".join(rest))
            others = [c for c in batch.schema.names if c not in ("text", spans_name)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.array(starts, type=pa.list_(pa.int64())),
                 pa.array(ends, type=pa.list_(pa.int64())), pa.array(kept, type=pa.binary())],
                names=[*others, "starts", "ends", "rest"])
    return run


def _marked(old: DataFrame) -> tuple[DataFrame, str]:
    """``old`` with the repeated spans of its texts in one more column, and that column's name."""
    name, spans_name = unused(old, "text_key"), unused(old, "spans")
    docs = old.withColumn(name, text_key(F.col("text")))
    keyed = docs.select(F.col(name).alias("key"), "text")
    runs = stored(keyed.transform(map_arrow, _find_anchors, ANCHOR), "anchors")
    told = runs.where("bucket IS NOT NULL")
    buckets = told.groupBy("bucket").agg(F.sum("n").alias("members"), F.min("sig").alias("low"), F.max("sig").alias("high"))
    buckets = buckets.where("members > 1").select("bucket", (F.col("low") != F.col("high")).alias("mixed"))
    shared = stored(told.join(buckets, "bucket"), "shared")
    kinds = stored(shared.where("mixed").groupBy("bucket", "sig").agg(
        F.sum("n").alias("members"), F.min(F.struct("key", "first", "last", "anchor")).alias("one")), "kinds")

    run = F.struct("bucket", "sig", (F.col("members") == 1).alias("open"), "one.first", "one.last", "one.anchor")
    to_cut = kinds.select("one.key", run.alias("run")).groupBy("key").agg(F.collect_list("run").alias("runs"))
    contexts = stored(keyed.join(to_cut, "key").transform(map_arrow, _cut_contexts, CONTEXT).dropDuplicates(["bucket", "sig"]), "contexts")

    span = F.struct(F.col("first").alias("start"), (F.col("last") + SPAN).alias("end"))
    spans = [
        runs.where("bucket IS NULL"), shared.where("NOT mixed"), _refine(contexts),
        shared.where("mixed").join(kinds.where("members > 1").select("bucket", "sig"), ["bucket", "sig"]),
    ]
    spans = reduce(DataFrame.unionAll, [x.select("key", span.alias("span")) for x in spans])
    spans = spans.groupBy(F.col("key").alias(name)).agg(F.collect_set("span").alias(spans_name))
    return docs.join(spans, name, "left").drop(name), spans_name


def repeated_spans(documents: DataFrame) -> DataFrame:
    """``documents`` without ``text``, with ``starts``, ``ends`` (of removed runs, in bytes) and ``rest`` (binary).

    A byte goes if a string of ``SPAN`` bytes that covers it also begins anywhere else, in the same text or
    another. NULL is the empty text; shorter texts lose nothing. Copies of a row are texts of their own, so
    they lose what is ``SPAN`` bytes long. Columns with the names of the three new ones are replaced.
    """
    old = documents.drop("starts", "ends", "rest")
    marked, spans_name = _marked(old)
    fields = [f for f in old.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields),
                        "starts ARRAY<BIGINT>", "ends ARRAY<BIGINT>", "rest BINARY"])
    return marked.transform(map_arrow, _apply(spans_name), schema)


def remove_repeats(documents: DataFrame) -> DataFrame:
    """``documents``, all columns and rows, with repeated bytes cut from ``text`` and ``n_chars`` set anew if it is there.

    Where a cut goes through a character, the rest of the character goes too.
    """
    hidden = documents.toDF(*["text" if c == "text" else f"c{i}" for i, c in enumerate(documents.columns)])
    names = hidden.columns
    marked, spans_name = _marked(hidden)

    def as_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _apply(spans_name)(batches):
            texts = pa.array([x.as_py().decode(errors="ignore") for x in batch.column("rest")], type=pa.string())
            yield pa.RecordBatch.from_arrays([texts if c == "text" else batch.column(c) for c in names], names=names)

    out = marked.transform(map_arrow, as_text, hidden.schema).toDF(*documents.columns)
    if "n_chars" not in documents.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
