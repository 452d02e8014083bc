"""A mixture of sources by Sainte-Laguë apportionment of equal-token blocks.

Targets are shares of all tokens by weight; a target stops at ``max_repeats`` times its source, and what is over goes to
the others by weight. Then blocks of equal tokens are seats: each goes to the source with the highest quotient
``target / (2 seats + 1)``, and in the same way a source's seats go to its sections and theirs to shards, so every shard
has an integer quota before any document is chosen. In a shard, documents stand one after the other in an order drawn from
seed and id, and are cut into blocks. The quota takes all blocks as often as it can, and the rest are blocks at even distances
from a drawn start. Which tokens of a document are taken follows from its place by integer arithmetic, so blocks may be of any size
without a row for each.

Shards hold some ``shard_tokens`` tokens and sections ``SECTION`` shards, so a hot source has more shards, not larger ones. One task sees
the list of sources, the sections of one source, or the shards of one section: numbers, no documents.

Odd rows. A NULL text has no tokens, and documents without any are never taken. A NULL source is a source, the last one. A NULL id draws
as the empty id. Repeated ids stand side by side, and equal rows are told apart by nothing but their place. Only ``doc_id``, ``text`` and
``source`` are read. An empty table, or one without tokens, gives targets and quotas of 0.
"""

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from triarm.llm.text import words
from triarm.session import ship
from triarm.sources.scratch import stored

SECTION = 4096
# The smallest target is at least so many blocks, where blocks can be that small.
LEAST_BLOCKS = 400


def highest_quotients(shares: Sequence[float], caps: Sequence[int], seats: int) -> list[int]:
    """Seats of each party: one by one to the highest ``share / (2 seats + 1)``, the first of equals, none beyond its cap.

    A divisor found by halving gives all seats but the last few at once.
    """
    shares, caps = np.asarray(shares, dtype=float), np.asarray(caps, dtype=np.int64)
    caps = np.where(shares > 0, caps, 0)
    seats = int(min(seats, caps.sum()))
    if seats <= 0:
        return [0] * len(shares)

    def won(quotient: float) -> np.ndarray:
        return np.minimum(caps, np.floor((np.minimum(shares / quotient, 2.0**60) + 1) / 2).astype(np.int64))

    low, high = shares.max() / (2.0 * seats + 2), 2 * shares.max()  # won(low) may be too few where caps bind
    while won(low).sum() < seats:
        low /= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if won(middle).sum() >= seats else (low, middle)
    # One less, as a quotient next to the divisor may be rounded to either side.
    found = np.maximum(won(high) - 1, 0)
    quotient = lambda i: -shares[i] / (2 * int(found[i]) + 1)
    heap = [(quotient(i), i) for i in np.flatnonzero(found < caps).tolist()]
    heapq.heapify(heap)
    for _ in range(seats - int(found.sum())):
        _, i = heapq.heappop(heap)
        found[i] += 1
        if found[i] < caps[i]:
            heapq.heappush(heap, (quotient(i), i))
    return found.tolist()


def apportion(parties: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``parties`` (with ``share, cap, seats``) and the ``quota`` of each within its group."""
    schema = StructType([*parties.schema.fields, StructField("quota", LongType())])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(list(order), kind="stable")
        return part.assign(quota=highest_quotients(part["share"], part["cap"], part["seats"].iloc[0]))

    ship(parties.sparkSession)
    return parties.groupBy(*group).applyInPandas(run, schema)


def sizes(docs: DataFrame, seed: int) -> DataFrame:
    """``doc_id, source, size`` (words) and the key that places a document."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), key.alias("key"))


def targets(sized: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """``source, number`` (by code point, NULL last)``, source_size, target``: the source's share of all tokens.

    The common level ``target / weight`` of sources below their cap is the highest that any set of the soonest capped leaves.
    """
    by_name = Window.orderBy(F.col("source").cast("string").asc_nulls_last())
    soonest = Window.orderBy("_ratio", "number")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("number", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("long")
    ratio = sources.withColumns({"_weight": weight, "_cap": F.col("source_size") * max_repeats}).withColumn(
        "_ratio", F.col("_cap") / F.col("_weight"))
    capped = F.coalesce(F.sum("_cap").over(soonest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_weight").over(soonest.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - capped) / rest
    return ratio.withColumn("_level", level).withColumn("_level", F.max("_level").over(everything)).select(
        "source", "number", "source_size", F.least(F.col("_weight") * F.col("_level"), F.col("_cap").cast("double")).alias("target"))


def _div(a: Column, b: Column | int) -> Column:
    """Whole-number quotient."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def _draw(text: Column) -> Column:
    """A number below 2^60 drawn from a text."""
    return F.conv(F.substring(text, 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights: Sequence[int], max_repeats: int = 3, seed: int = 0, block_tokens: int = 4096,
        shard_tokens: int = 1 << 20) -> DataFrame:
    """A row for each document: ``doc_id, source, size, source_size, target, taken``, and its place.

    The place is ``shard, before`` (tokens before it in the shard)``, block_tokens, n_blocks, passes`` (times all blocks are taken)``,
    extra`` (blocks taken once more) and ``offset`` (where these start). Blocks have ``block_tokens`` tokens, fewer where the smallest target
    would be less than ``LEAST_BLOCKS`` of them.
    """
    sized = stored(sizes(docs, seed), "sizes")
    sources = stored(targets(sized, weights, max_repeats), "sources")
    total, least = sources.agg(F.sum("source_size"), F.min(F.when(F.col("target") > 0, F.col("target")))).first()
    block = max(1, min(block_tokens, int((least or 0) // LEAST_BLOCKS)))
    seats = (2 * (total or 0) + block) // (2 * block)

    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens))
    placed = sized.withColumn("_name", F.struct("source")).drop("source").join(
        sources.withColumn("_name", F.struct("source")), "_name").withColumn("shard", F.pmod(_draw(F.col("key")), shards))

    tokens = placed.groupBy("source", "number", "target", "shard").agg(F.sum("size").alias("tokens"))
    n_blocks = F.ceil(F.col("tokens") / block)
    by_shard = stored(tokens.withColumns({
        "section": _div(F.col("shard"), SECTION), "n_blocks": n_blocks, "cap": n_blocks * max_repeats}), "shards")
    by_section = by_shard.groupBy("number", "target", "section").agg(F.sum("tokens").alias("share"), F.sum("cap").alias("cap"))
    by_source = by_section.groupBy("number", "target").agg(F.sum("cap").alias("cap"))

    first = apportion(by_source.select("number", F.col("target").alias("share"), "cap", F.lit(seats).cast("long").alias("seats"),
                                       F.lit(0).alias("all")), ["all"], ["number"])
    seats_of = lambda df, *keys: df.select(*keys, F.col("quota").alias("seats"))
    second = apportion(by_section.drop("target").join(seats_of(first, "number"), "number"), ["number"], ["section"])
    whole = F.greatest(F.col("n_blocks"), F.lit(1))
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("source").cast("string"), F.lit("")), "shard")
    offset = F.pmod(_draw(F.md5(name.cast("binary"))), whole)
    parts = by_shard.select(
        "number", "section", "shard", F.col("tokens").alias("share"), "cap", "n_blocks", offset.alias("offset"))
    third = apportion(parts.join(seats_of(second, "number", "section"), ["number", "section"]), ["number", "section"], ["shard"])

    quotas = third.select(
        "number", "shard", "n_blocks", _div(F.col("quota"), whole).alias("passes"), (F.col("quota") % whole).alias("extra"), "offset")

    earlier = Window.partitionBy("number", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0))).join(quotas, ["number", "shard"])
    rows = rows.withColumn("block_tokens", F.lit(block).cast("long"))
    end = F.col("before") + F.col("size")
    taken = F.col("passes") * F.col("size") + _chosen_tokens(end) - _chosen_tokens(F.col("before"))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "shard", "before", "block_tokens",
                       "n_blocks", "passes", "extra", "offset")


def _chosen_blocks(block: Column) -> Column:
    """How many of the shard's blocks before number ``block`` are taken once more: ``extra`` of ``n_blocks``, at even distances."""
    return _div(block * F.col("extra") + F.col("offset"), F.greatest(F.col("n_blocks"), F.lit(1)))


def _chosen_tokens(tokens: Column) -> Column:
    block = _div(tokens, F.col("block_tokens"))
    rest = tokens - block * F.col("block_tokens")
    here = _chosen_blocks(block + 1) - _chosen_blocks(block)
    return _chosen_blocks(block) * F.col("block_tokens") + here * rest


def pieces(mixed: DataFrame) -> DataFrame:
    """``doc_id, first_word, n_words, times``: what to take of each document, from the rows of ``mix``.

    One row for the whole document if all blocks are taken, and one for each of its stretches that are in a block taken once more.
    """
    some = mixed.where("size > 0")
    whole = some.where("passes > 0").select("doc_id", F.lit(0).cast("long").alias("first_word"), F.col("size").alias("n_words"),
                                            F.col("passes").alias("times"))
    end = F.col("before") + F.col("size")
    first, last = _div(F.col("before"), F.col("block_tokens")), _div(end - 1, F.col("block_tokens"))
    blocks = some.where("extra > 0").withColumn("_block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("before"), F.col("_block") * F.col("block_tokens"))
    stop = F.least(end, (F.col("_block") + 1) * F.col("block_tokens"))
    once = blocks.where(_chosen_blocks(F.col("_block") + 1) > _chosen_blocks(F.col("_block"))).select(
        "doc_id", (start - F.col("before")).alias("first_word"), (stop - start).alias("n_words"), F.lit(1).cast("long").alias("times"))
    return whole.unionByName(once)


def texts(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """``pieces`` with their words, one space between; ids of documents must be unique."""
    rows = taken.join(docs.select("doc_id", "text"), "doc_id")
    some = F.slice(words(F.col("text")), (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int"))
    return rows.select("doc_id", "first_word", "n_words", "times", F.array_join(some, " ").alias("text"))
