"""Benchmark decontamination by spaced seeds.

A seed is a mask over consecutive words: the words at its ones are hashed, those at its zeros ignored, so a
replaced word spoils only the seeds that use it. Seeds of documents that also occur in the benchmark give
an alignment (document, item, shift); along it the words are compared one by one, and it is an overlap if any
stretch of it has enough equal words and a large enough share of them.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from triarm.llm.text import cut_words, map_arrow, mix, slices

# One of these fits into every stretch of eight or more equal words that are three quarters of it: without four equal
# words in a row its runs are of three at most, and two of them, of three and three or three and two words, are one
# replaced word apart. At lower bounds than the two below some overlaps have no seed.
MASKS = ("1111", "111011", "110111")
# An overlap has at least this many equal words (or a whole shorter item), and this share of equal words.
MIN_WORDS = 8
MIN_SHARE = 0.75
# Items of fewer words are no evidence: such word sequences occur in any text.
MIN_ITEM = 5
# Bytes of benchmark text a task holds at a time; larger benchmarks are searched block by block.
BLOCK_BYTES = 8 << 20


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the mask at every place where it fits into the word hashes."""
    n = len(words) - len(mask) + 1
    out = np.full(max(n, 0), hash_of_mask(mask), dtype=np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1" and n > 0:
            out = mix(out ^ words[i:i + n])
    return out


def hash_of_mask(mask: str) -> np.uint64:
    return np.uint64(int("1" + mask, 2))


@dataclass
class Block:
    """Seeds of some items, sorted by hash, and the items' words."""

    masks: tuple[str, ...]
    hashes: np.ndarray
    items: np.ndarray
    places: np.ndarray
    words: list[np.ndarray]
    ids: list

    @staticmethod
    def of(rows: list, masks: tuple[str, ...] = MASKS) -> "Block":
        ids = [r["item_id"] for r in rows]
        words: list[np.ndarray] = []
        for part in slices(pa.array([r["text"] for r in rows], type=pa.string())):
            found = cut_words(part)
            words += [found.hashes[a:b] for a, b in zip(found.first, found.first[1:])]
        shortest = max(map(len, masks))
        # Items that a mask does not fit into are found by all of their words.
        short = {len(w) for w in words if MIN_ITEM <= len(w) < shortest}
        found = []
        for i, w in enumerate(words):
            for mask in masks if len(w) >= shortest else ("1" * len(w),) if len(w) >= MIN_ITEM else ():
                h = seed_hashes(w, mask)
                found.append((h, np.full(len(h), i), np.arange(len(h))))
        masks = (*masks, *("1" * n for n in sorted(short)))
        if not found:
            return Block(masks, np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int), words, ids)
        hashes, items, places = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(hashes, kind="stable")
        return Block(masks, hashes[order], items[order], places[order], words, ids)


def fullest_stretch(equal: np.ndarray, min_share: float) -> tuple[int, int, int]:
    """``(first, length, equal words)`` of the stretch with the most equal words among those of a large enough share.

    The share is reached where the sum of (equal - share) is not negative, so for every end the first start
    whose running sum is not above that of the end holds the most. Of equals the shortest, then the first.
    """
    over, under = Fraction(str(min_share)).as_integer_ratio()
    counts = np.concatenate([[0], np.cumsum(equal)])
    sums = under * counts - over * np.arange(len(counts))
    starts = np.searchsorted(-np.minimum.accumulate(sums), -sums, "left")
    found = counts - counts[starts]
    if not found.max():
        return 0, 0, 0
    places = np.flatnonzero(equal)
    # Ends with the most equal words, and the stretch between its outermost equal words.
    last = np.flatnonzero(found == found.max())
    first = places[counts[starts[last]]]
    best = int(np.argmin(last - first))
    return int(first[best]), int(last[best] - first[best]), int(found.max())


def overlaps_in(part, block: Block, min_words: int, min_share: float) -> list[tuple]:
    """``(row of the slice, item, first word, words, equal words)``: for each pair its best overlap."""
    found = cut_words(part)
    hits = []
    for mask in block.masks:
        h = seed_hashes(found.hashes, mask)
        low = np.searchsorted(block.hashes, h, "left")
        there = low < len(block.hashes)
        there[there] = block.hashes[low[there]] == h[there]
        at = np.flatnonzero(there)
        at = at[found.doc[at] == found.doc[at + len(mask) - 1]]  # a seed lies in one text
        if not len(at):
            continue
        count = np.searchsorted(block.hashes, h[at], "right") - low[at]
        post = np.repeat(low[at] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        place = np.repeat(at, count)
        doc = found.doc[place]
        hits.append(np.stack([doc, block.items[post], place - found.first[doc] - block.places[post]]))
    best: dict[tuple[int, int], tuple] = {}
    for doc, item, shift in np.unique(np.concatenate(hits, axis=1), axis=1).T.tolist() if hits else ():
        own, other = found.hashes[found.first[doc]:found.first[doc + 1]], block.words[item]
        a, b = max(0, -shift), min(len(other), len(own) - shift)
        first, length, equal = fullest_stretch(own[a + shift:b + shift] == other[a:b], min_share)
        if equal >= max(min(min_words, len(other)), 1):
            row = (equal, -length, -(first + a + shift))
            best[doc, item] = max(best.get((doc, item), row), row)
    return [(doc, item, -start, -length, equal) for (doc, item), (equal, length, start) in sorted(best.items())]


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[Block]:
    """The benchmark in blocks of bounded size; items that are NULL, or NULL in text, have no words."""
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    total = items.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // block_bytes)
    if parts <= 1:
        return [Block.of(items.orderBy("item_id", "text").collect())] if total else []
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return [Block.of(items.where(part == i).orderBy("item_id", "text").collect()) for i in range(parts)]


OVERLAP = "first_word BIGINT, n_words BIGINT, n_equal BIGINT"


def find_overlaps(documents: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS,
                  min_share: float = MIN_SHARE) -> DataFrame:
    """``doc_id, item_id, first_word, n_words, n_equal``: the best overlap of each document with each item.

    Documents without an overlap have no row. Words are compared with A-Z in lower case. NULL and empty texts
    overlap nothing; NULL ids are carried; repeated rows give repeated rows. Nothing is shuffled: the
    benchmark goes to the tasks in blocks of bounded size, one pass over the documents for each.
    """
    docs = documents.select("doc_id", "text")
    id_type, item_type = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, item_id {item_type.simpleString()}, {OVERLAP}"
    found = docs.sparkSession.createDataFrame([], schema)
    for i, block in enumerate(blocks(benchmark)):
        item_arrow = pa.array(block.ids, type=to_arrow_type(item_type))

        def search(batches: Iterator[pa.RecordBatch], block=block, ids=item_arrow) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch.column("text")):
                    rows = overlaps_in(part, block, min_words, min_share)
                    if rows:
                        doc, item, *numbers = (np.array(x) for x in zip(*rows))
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").take(pa.array(doc + part.rows.start)), ids.take(pa.array(item)),
                             *map(pa.array, numbers)], names=["doc_id", "item_id", "first_word", "n_words", "n_equal"])

        one = docs.transform(map_arrow, search, schema)
        found = one if i == 0 else found.unionByName(one)
    return found


def decontaminate(documents: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS,
                  min_share: float = MIN_SHARE) -> DataFrame:
    """``documents``, all columns, without those that overlap an item of the benchmark."""
    kept = documents
    for block in blocks(benchmark):
        def clean(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for part in slices(batch.column("text")):
                    for doc, *_ in overlaps_in(part, block, min_words, min_share):
                        keep[doc + part.rows.start] = False
                yield batch if keep.all() else pc.filter(batch, pa.array(keep))

        kept = kept.transform(map_arrow, clean, documents.schema)
    return kept
