"""Near-duplicates by an LSH forest over MinHash signatures.

A document's set holds the hashes of its five-word shingles. Each of the trees orders all sets by four MinHash
values of its own. Sets that are alike stand side by side in most orders, so neighbours with a long common
prefix are candidates first, and are compared on their full sets. The components they give settle most
regions (sets with a common prefix) of all trees: what is left are regions with more than one component. Their
depth adapts: a sparse region is taken at the least depth, a dense one deeper, and there every pair from
different components is a candidate, screened by signature bits and then compared on full sets.

A pair at similarity s shares a region of depth d in one of t trees with probability 1 - (1 - s^d)^t: at the
threshold 0.75, the full depth 4 and 32 trees, all but 5 in a million.
"""

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from triarm.llm.components import components
from triarm.llm.text import Slice, cut_words, map_arrow, mix, signed, slices, text_key, unused
from triarm.sources.scratch import stored

SHINGLE = 5
MIN_SHARE = 75  # per cent of the union
TREES, DEPTH, LEAST_DEPTH = 32, 4, 3
HASHES = TREES * DEPTH
BITS = 16  # of each value in a tree's key
SORTED_TREES = 16
# Sets in a region up to which it is taken at the least depth.
SPARSE = 32
# Pairs of unsettled regions are screened by two bits of each of 1,536 further MinHash values. At the threshold
# a value differs with probability 1/4, and then shows in the bits with 3/4: 288 times in the mean, with a
# standard deviation of 15.3. Five deviations more are let through.
SCREEN = 1536
MAX_DIFFERENT = 364
# Sets of a region that are compared with each other, or with as many others of it, in one go; pairs held at a time.
CHUNK = 512
PAIRS = 1 << 14


@cache
def _multipliers() -> np.ndarray:
    return np.random.default_rng(75_128).integers(1, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _places() -> np.ndarray:
    return np.random.default_rng(5_005).integers(1, 1 << 62, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts of a slice, in order within a text, and where each text's begin.

    A text of fewer than five words has one shingle, all of its words; one without words has none.
    """
    words = cut_words(part)
    n = len(words.hashes)
    count = np.diff(words.first)
    hashes = np.zeros(n, dtype=np.uint64)
    for k, place in enumerate(_places()[:n]):
        here = words.hashes[k:] * place
        inside = words.doc[k:] == words.doc[:n - k]
        hashes[:n - k] += np.where(inside, here, 0)
    starts = np.zeros(n, dtype=bool)
    place = np.arange(n) - words.first[words.doc]
    starts[:] = (place <= count[words.doc] - SHINGLE) | (place == 0)
    short = np.minimum(count, SHINGLE)[words.doc].astype(np.uint64)
    hashes, doc = mix(hashes + short)[starts], words.doc[starts]
    order = np.argsort(hashes)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(count) < 1 << 16 else np.int64), kind="stable")]
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(count) + 1))


def _set_names(hashes: np.ndarray, first: np.ndarray) -> pa.Array:
    """16 bytes per set, the same in whatever order its hashes come; zeros for the empty set."""
    sizes = np.diff(first)
    name = np.zeros((len(sizes), 2), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        name[full, 0] = np.add.reduceat(mix(hashes), first[:-1][full])
        name[full, 1] = np.add.reduceat(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first[:-1][full])
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(name), [None, pa.py_buffer(name.tobytes())]).cast(pa.binary())


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(signed(x).ravel()))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch.column("text")):
            hashes, first = shingle_sets(part)
            sizes = np.diff(first)
            full = np.flatnonzero(sizes)
            heads = first[:-1][full]
            keys = np.zeros((len(sizes), TREES), dtype=np.uint64)
            for j, a in enumerate(_multipliers() if len(full) else ()):
                value = mix(np.minimum.reduceat(hashes * a, heads))
                tree, level = j % TREES, j // TREES
                shift = np.uint64(BITS * (DEPTH - 1 - level))
                keys[full, tree] |= (value & np.uint64((1 << BITS) - 1)) << shift
            ids = batch.column("doc_id").slice(part.rows.start, len(sizes))
            yield pa.RecordBatch.from_arrays(
                [ids, _set_names(hashes, first), pa.array(sizes.astype(np.int64)), _lists(keys)],
                names=["doc_id", "node", "n_shingles", "keys"])


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, bits``: two planes of one bit for each of the screening values."""
    factors = np.random.default_rng(1_024).integers(1, 1 << 31, SCREEN, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    for batch in batches:
        for part in slices(batch.column("text")):
            hashes, first = shingle_sets(part)
            heads = first[:-1]  # no set is empty here
            short = (hashes >> np.uint64(32)).astype(np.uint32)
            bits = np.zeros((len(heads), SCREEN // 32), dtype=np.uint64)
            for j, a in enumerate(factors):
                value = (np.minimum.reduceat(short * a, heads) * np.uint32(0x9E3779B1)).astype(np.uint64) >> np.uint64(30)
                bits[:, j // 64] |= (value & np.uint64(1)) << np.uint64(j % 64)
                bits[:, SCREEN // 64 + j // 64] |= (value >> np.uint64(1) & np.uint64(1)) << np.uint64(j % 64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").slice(part.rows.start, len(heads)), _lists(bits)], names=["node", "bits"])


def sketches(documents: DataFrame) -> DataFrame:
    """``doc_id, node, n_shingles, keys``; equal sets have equal ``node``, 16 bytes."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_arrow,
        _sketch, "doc_id BIGINT, node BINARY, n_shingles BIGINT, keys ARRAY<BIGINT>")


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch.column("text")):
            names = _set_names(*shingle_sets(part))
            yield pa.RecordBatch.from_arrays([names, batch.column("text").slice(part.rows.start, len(names))],
                                             names=["node", "text"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets that stand side by side in a tree's order and share the least depth at least."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.concat_batches([last, batch])
        last = batch.slice(batch.num_rows - 1)
        tree, key = batch.column("tree").to_numpy(), batch.column("key").to_numpy().view(np.uint64)
        near = (tree[1:] == tree[:-1]) & ((key[1:] ^ key[:-1]) >> np.uint64(BITS * (DEPTH - LEAST_DEPTH)) == 0)
        at = np.flatnonzero(near)
        node = batch.column("node")
        yield pa.RecordBatch.from_arrays([node.take(pa.array(at)), node.take(pa.array(at + 1))], names=["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are alike enough."""
    for batch in batches:
        for one in slices(batch.column("text_a")):
            rows = one.rows.stop - one.rows.start
            other, other_first = zip(*(shingle_sets(p) for p in slices(
                batch.column("text_b").slice(one.rows.start, rows), 1 << 62)))
            sets, first = shingle_sets(one)
            keep = []
            for i in range(rows):
                x, y = sets[first[i]:first[i + 1]], other[0][other_first[0][i]:other_first[0][i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= MIN_SHARE * (len(x) + len(y) - both) and both > 0)
            keep = np.flatnonzero(keep) + one.rows.start
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` whose texts, ``node, text``, have sets that are alike enough."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").transform(map_arrow, _compare, "a BINARY, b BINARY")


def _partners(group: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row behind each row that it forms a pair with; a group of two chunks pairs only one with the other."""
    n = len(group)
    head = np.ones(n, dtype=bool)
    head[1:] = group[1:] != group[:-1]
    starts = np.flatnonzero(head)
    which = np.cumsum(head) - 1
    end = np.append(starts[1:], n)[which]
    change = np.ones(n, dtype=bool)
    change[1:] = head[1:] | (own[1:] != own[:-1])
    # The row at which the chunk behind this row's begins, if the group has two.
    turns = np.append(np.flatnonzero(change), n)
    turn = np.minimum(turns[np.cumsum(change)], end)
    return turn, end


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sets of a region, from different components, that sizes and signature bits leave possible.

    A region's rows stand together, or those of two of its chunks. A pair is taken in the first region it shares.
    """
    half, trees = SCREEN // 64, np.arange(TREES)

    def wide(x: pa.Array) -> np.ndarray:
        return x.flatten().to_numpy().reshape(len(x), -1).view(np.uint64)

    def pairs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows < 2:
            return
        low, high, own, tree, size = (batch.column(c).to_numpy() for c in ("low", "high", "own", "tree", "n_shingles"))
        node, bits, regions = batch.column("node"), wide(batch.column("bits")), wide(batch.column("regions"))
        component = batch.column("component").dictionary_encode().indices.to_numpy()
        turn, end = _partners(_groups(batch), own)
        begin = np.where(low == high, np.arange(len(own)) + 1, turn)
        count = end - begin
        before = np.concatenate([[0], np.cumsum(count)])
        for first in range(0, int(before[-1]), PAIRS):
            number = np.arange(first, min(first + PAIRS, int(before[-1])))
            x = np.searchsorted(before, number, "right") - 1
            y = begin[x] + number - before[x]
            small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
            keep = (component[x] != component[y]) & (100 * small >= MIN_SHARE * large)
            x, y = x[keep], y[keep]
            differ = bits[x] ^ bits[y]
            keep = np.bitwise_count(differ[:, :half] | differ[:, half:]).sum(axis=1, dtype=np.int64) <= MAX_DIFFERENT
            x, y = x[keep], y[keep]
            shared = (regions[x] == regions[y]) & (regions[x] != 0) & (trees < tree[x][:, None])
            new = ~shared.any(axis=1)
            yield pa.RecordBatch.from_arrays([node.take(pa.array(x[new])), node.take(pa.array(y[new]))], names=["a", "b"])

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        group = _groups(batch)
        last = int(np.searchsorted(group, group[-1]))
        yield from pairs(batch.slice(0, last))
        rest = batch.slice(last)
    if rest is not None:
        yield from pairs(rest)


def _groups(batch: pa.RecordBatch) -> np.ndarray:
    """Numbers of the runs of rows that stand together, in order."""
    new = np.zeros(batch.num_rows, dtype=np.int64)
    for c in ("region", "tree", "low", "high"):
        x = batch.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def candidates(unsettled: DataFrame, screens: DataFrame) -> DataFrame:
    """``a, b``: pairs of sets from different components in a region of ``unsettled`` that the screen lets through.

    A region of many sets is cut into chunks, and every two of them, or one with itself, make a group of its own, so
    that a large region is shared out among tasks.
    """
    chunks = F.ceil(F.col("members") / CHUNK)
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    rows = unsettled.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int"))))
    rows = rows.join(screens, "node").select(
        "region", "tree", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own",
        "node", "component", "n_shingles", "bits", "regions")
    group = ["region", "tree", "low", "high"]
    return rows.repartition(*group).sortWithinPartitions(*group, "own", "node").transform(map_arrow, _alike, "a BINARY, b BINARY")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row per row of ``documents``.

    Links are pairs of documents whose sets have an intersection of at least 75 per cent of their union;
    ``component_id`` is the smallest id that links lead to, ``kept`` whether it is the document's own.
    NULL, empty and wordless texts have no shingles and no links. Equal sets are one node, so copies cost
    nothing after the first step. Rows with equal ids are rows of their own. A row without an id is named by
    the ids it is linked to; if there is none, ``component_id`` is NULL and it is kept.
    """
    rows = stored(sketches(documents), "sketches")
    full = rows.where("n_shingles > 0")
    nodes = stored(full.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n_shingles", "keys")]), "nodes")
    trees = nodes.select("node", F.posexplode("keys").alias("tree", "key"))
    trees = trees.withColumn("region", F.shiftrightunsigned("key", BITS * (DEPTH - LEAST_DEPTH)))
    crowded = trees.groupBy("tree", "region").agg(F.count("*").alias("sets")).where("sets > 1")
    active = stored(trees.join(crowded, ["tree", "region"]), "active")
    # One text per node, of the nodes that are in a region with others. Copies meet before they are sent.
    texts = documents.select("text").transform(map_arrow, _name, "node BINARY, text STRING").groupBy("node").agg(
        F.first("text").alias("text")).join(active.select("node").distinct(), "node", "left_semi")
    texts = stored(texts, "texts")

    order = active.where(F.col("tree") < SORTED_TREES).select("tree", "key", "node")
    neighbours = order.repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node").transform(map_arrow,
        _neighbours, "a BINARY, b BINARY").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = components(stored(confirm(neighbours, texts), "links"))

    placed = active.join(near, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # Dense regions are taken deeper.
    placed = placed.withColumn("region", F.when(F.col("sets") <= SPARSE, F.col("region")).otherwise(F.col("key")))
    same = ["tree", "region", "sets"]
    mixed = placed.groupBy(*same).agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"))
    mixed = mixed.where("low < high").select(*same, "members")
    unsettled = stored(placed.join(mixed, same).select(
        "tree", "node", "component", F.xxhash64(*same).alias("region"), "members"), "unsettled")
    # All regions of a node, in order of the trees, so that a pair is taken in the first region it shares.
    regions = unsettled.groupBy("node").agg(F.array(*[
        F.coalesce(F.max(F.when(F.col("tree") == t, F.col("region"))), F.lit(0)) for t in range(TREES)]).alias("regions"))
    screens = texts.join(unsettled.select("node").distinct(), "node", "left_semi").transform(map_arrow,
        _screen, "node BINARY, bits ARRAY<BIGINT>")
    screens = stored(screens.join(nodes.select("node", "n_shingles"), "node").join(regions, "node"), "screens")
    pairs = candidates(unsettled, screens)
    found = components(near.select(F.col("node").alias("a"), F.col("component").alias("b")).union(confirm(pairs, texts)))

    named = rows.select("doc_id", "node", "n_shingles").join(found, "node", "left").withColumn(
        "component", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")))
    least = stored(named.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least")), "least")
    named = named.join(least, "component", "left").withColumn("component_id", F.coalesce("least", "doc_id"))
    return named.select("doc_id", "n_shingles", "component_id",
                        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """``documents``, all columns, with one row of each component: that of the smallest id.

    Of rows with the same id and text one stays; rows without an id stay. The rows are shuffled once, by id.
    """
    key = unused(documents, "text_key")
    kept = near_duplicates(documents).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = documents.where("doc_id IS NOT NULL").withColumn(key, text_key(F.col("text")))
    one = named.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", key]).select(*[f"`{c}`" for c in documents.columns])
    return one.unionByName(documents.where("doc_id IS NULL"))
