"""Ranked search, a term at a time with limited accumulators.

A document is a vector of term counts, made once from its whole text. The documents stay where they are: each task turns the
vectors of a block of its documents into posting lists and answers every item over them. An item's terms come rarest first (by
their document frequency in the whole table). A term adds to the partial scores of the documents that hold it; once the bounds of the terms to come, added up,
are below the k-th best score known, no document without a partial score can reach it, so no new ones are begun. Those that
can still reach it are then updated exactly with the terms left. The best of each task, exact scores, are ranked together.

The k-th best score known to a task counts whole scores of its earlier blocks and partial ones of the present block; both are at most
final scores, so nothing is lost by either. Bounds are the largest additions of a term within the block.

Items are searched in blocks whose distinct terms take ``BLOCK_BYTES`` on average, one after the other, so the terms that go to each
task do not grow with the item table; a single item is never split. Only term counts of those terms are stored for a block.

Odd rows. A NULL or empty text, or one without a term, is no document of the index, and an item without terms or matches has no row. A
NULL id is an id, before all others where scores are equal. Rows of one ``item_id`` are one item. A repeated document is ranked as often as it is there.
Only ``doc_id``, ``item_id`` and ``text`` are read. Empty tables give an empty result.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from triarm.llm.text import LOWER, UPPER, lower_ascii, map_arrow
from triarm.sources.scratch import stored

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

BLOCK_BYTES = 8 << 20
# Postings of documents that are turned into lists and searched together.
POSTINGS = 1 << 20
# Parts of the ranking of one item, so that no item's rows of all tasks meet unsorted.
PARTS = 64

# Bytes of a text that end a term become spaces, and A-Z lower case; all bytes of other characters are kept.
_KEPT = {**{ord(c): ord(c) for c in "0123456789" + LOWER}, **dict(zip(map(ord, UPPER), map(ord, LOWER)))}
FOLDED = bytes(_KEPT.get(b, 32) if b < 128 else b for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


def vectors(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``doc_id, n, terms, counts`` of each document with a term: its length, and numbers and counts of those in ``vocabulary``."""
    docs = docs.where("text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n BIGINT, terms ARRAY<INT>, counts ARRAY<BIGINT>"
    numbers = {t.encode(): i for i, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, offsets, terms, counts = [], [0], [], []
            for cell in batch.column("text"):
                found = terms_of(cell.as_py())
                n.append(len(found))
                own = sorted((numbers[t], c) for t, c in Counter(found).items() if t in numbers)
                terms += [t for t, _ in own]
                counts += [c for _, c in own]
                offsets.append(len(terms))
            whole = pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n, pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(terms, pa.int32())),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(counts, pa.int64()))], names=["doc_id", "n", "terms", "counts"])
            yield whole.filter(pa.array(np.array(n, dtype=np.int64) > 0))

    return docs.transform(map_arrow, run, schema)


@dataclass
class Items:
    """Items of a block: terms by number, rarest first, and their weights."""

    terms: list[np.ndarray]
    weights: list[np.ndarray]


@dataclass
class Postings:
    """Documents of a block by term: ``docs[starts[t]:starts[t + 1]]`` hold term ``t``, in order, and get ``gains`` for a weight of 1."""

    starts: np.ndarray
    docs: np.ndarray
    gains: np.ndarray
    most: np.ndarray

    @classmethod
    def of(cls, doc: np.ndarray, term: np.ndarray, count: np.ndarray, m: np.ndarray, n_terms: int) -> "Postings":
        order = np.argsort(term, kind="stable")
        starts = np.searchsorted(term[order], np.arange(n_terms + 1))
        gains = ((1_000_000_000 * count) // (1000 * count + 8 * m[doc]))[order]
        most = np.zeros(n_terms, dtype=np.int64)
        held = np.flatnonzero(np.diff(starts))
        if len(held):
            most[held] = np.maximum.reduceat(gains, starts[held])
        return cls(starts, doc[order], gains, most)


def search_block(postings: Postings, n_docs: int, terms: np.ndarray, weights: np.ndarray, best: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the block that may be among the ``k`` best, and their exact scores. ``best`` are whole scores known before."""
    bounds = weights * postings.most[terms]
    left = np.cumsum(bounds[::-1])[::-1]  # of this term and those after it
    scores = np.zeros(n_docs, dtype=np.int64)
    reach = np.sort(best)[-k] if len(best) >= k else 0  # the k-th best score known
    begun = 0
    for i, t in enumerate(terms):
        if left[i] < reach or not left[i]:
            break
        at = slice(postings.starts[t], postings.starts[t + 1])
        scores[postings.docs[at]] += weights[i] * postings.gains[at]
        begun = i + 1
        if at.stop > at.start and begun < len(terms):
            known = np.concatenate([best, scores[scores > 0]])
            if len(known) >= k:
                reach = np.partition(known, -k)[-k]
    rest = left[begun] if begun < len(terms) else 0
    live = np.flatnonzero((scores > 0) & (scores + rest >= reach))
    found = scores[live]
    for i in range(begun, len(terms)):
        at = slice(postings.starts[terms[i]], postings.starts[terms[i] + 1])
        docs = postings.docs[at]
        if not len(docs) or not len(live):
            continue
        place = np.minimum(np.searchsorted(docs, live), len(docs) - 1)
        found += np.where(docs[place] == live, weights[i] * postings.gains[at][place], 0)
    return live, found


def _best(ids: pa.Array, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, equal ones by ascending id."""
    order = pc.sort_indices(
        pa.table([pa.array(-scores), ids], names=["score", "id"]), [("score", "ascending"), ("id", "ascending")], null_placement="at_start")
    return order.to_numpy()[:k]


def _search(index: DataFrame, items: Items, total_terms: int, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``item`` (its number)``, doc_id, score``: the ``k`` best of each task."""
    ids = index.schema["doc_id"].dataType.simpleString()
    # By the contract 100 - 90 + (90 * n * N) div L; the product may pass 64 bits in a large table.
    wide = F.lit(90 * n_docs).cast("decimal(28,0)") * F.col("n").cast("decimal(10,0)")
    m = (F.lit(10) + F.call_function("div", wide, F.lit(total_terms).cast("decimal(28,0)"))).cast("long")
    rows = index.where(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[pa.Array, np.ndarray] | None] = [None] * len(items.terms)

        def answer(part: pa.Table) -> None:
            part = part.combine_chunks()
            terms, counts = part["terms"].combine_chunks(), part["counts"].combine_chunks()
            sizes = np.diff(terms.offsets.to_numpy())
            doc = np.repeat(np.arange(len(sizes)), sizes)
            postings = Postings.of(doc, terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy(), part["m"].to_numpy(), n_terms)
            names = part["doc_id"].combine_chunks()
            for i, (own, weights) in enumerate(zip(items.terms, items.weights)):
                before = best[i]
                live, found = search_block(postings, len(sizes), own, weights, before[1] if before else np.zeros(0, np.int64), k)
                if not len(live):
                    continue
                new = names.take(pa.array(live))
                if before:
                    new, found = pa.concat_arrays([before[0], new]), np.concatenate([before[1], found])
                top = _best(new, found, k)
                best[i] = new.take(pa.array(top)), found[top]

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= POSTINGS:
                answer(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            answer(pa.Table.from_batches(held))
        for i, top in enumerate(best):
            if top:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top[1]), i)), top[0], pa.array(top[1])], names=["item", "doc_id", "score"])

    return rows.transform(map_arrow, run, f"item BIGINT, doc_id {ids}, score BIGINT")


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0)))


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of the highest score for each item, of those above 0."""
    spark = docs.sparkSession
    ids, item_ids = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (items, "item_id")))
    asked = stored(items.select("item_id", F.explode(_terms(F.col("text"))).alias("term")).distinct(), "item_terms")
    blocks = -(-(asked.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0) // block_bytes)
    found = [_search_items(docs, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i), k) for i in range(blocks)]
    ranked = spark.createDataFrame([], f"item_id {item_ids}, doc_id {ids}, score BIGINT")
    for part in found:
        ranked = ranked.unionByName(part)
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    for keys in (["item_id", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))], ["item_id"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _search_items(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each task for the items of a block, stored: ``item_id, doc_id, score``."""
    spark = docs.sparkSession
    by_item = [(r[0], r[1]) for r in asked.groupBy("item_id").agg(F.collect_list("term")).collect()]
    vocabulary = sorted({t for _, own in by_item for t in own})
    numbers = {t: i for i, t in enumerate(vocabulary)}
    index = stored(vectors(docs, vocabulary), "vectors")
    n_docs, total_terms = index.agg(F.count("*"), F.sum("n")).first()
    # ln in doubles; df is 0 for a term that no document holds, and then its weight is never used.
    w = F.floor(1000 * F.log(F.lit(2 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    frequency = {t: (df, weight) for t, df, weight in index.select(F.explode("terms").alias("term")).groupBy("term").agg(
        F.count("*").alias("df")).select("term", "df", w).collect()}
    chosen = Items([], [])
    for _, own in by_item:
        rarest = sorted((frequency[numbers[t]][0], numbers[t]) for t in own if numbers[t] in frequency)
        chosen.terms.append(np.array([t for _, t in rarest], dtype=np.int64))
        chosen.weights.append(np.array([frequency[t][1] for _, t in rarest], dtype=np.int64))
    item_type = asked.schema["item_id"].dataType.simpleString()
    names = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(by_item)], f"item BIGINT, item_id {item_type}")
    top = stored(_search(index, chosen, total_terms or 1, n_docs, len(vocabulary), k), "best")
    return top.join(names, "item").select("item_id", "doc_id", "score")
