"""Toxic passages as maximal-scoring segments of token log-odds.

Every token has a score: the logarithm of how much likelier it is in toxic than in other text. Tokens that
stand out are listed with log-odds, over the texts that have them, under a Dirichlet prior; all others share one slightly negative score, by
which both models are proper distributions. A linear scan finds all maximal segments (no segment inside or
across them scores more). Under ordinary text their scores follow an extreme-value law, so a segment of
score s in a text of n tokens has about ``K n exp(-s)`` rivals by chance; log-likelihood ratios make the decay
rate one. The best combination of a text's segments gives its p-value, and a logistic curve over ``-log p``,
fitted on rows the scores were not learned from, gives the probability of the label.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from triarm.llm.text import SubstringHashes, crc_fold, cut_words, map_arrow, signed, slices, text_key

FOLDS = 5
CALIBRATION_FOLD = 4
# Labelled rows the model is learned from, at most; those whose ids have the smallest hashes.
MAX_SAMPLE = 50_000
# Standard errors by which a token's log-odds must exceed zero.
MIN_Z = 3.0
# Least log-odds of a listed token, so that common words of nearly equal use stay out.
MIN_ODDS = 1.5
PRIOR = 0.5
PREFIX_BYTES = 5
# Share of chance passages among those reported.
SIGNIFICANCE = 0.01


def _units(part) -> tuple:
    """Words of a slice, their hashes, and hashes of the beginnings of words that are longer than those."""
    found = cut_words(part, letters_only=True)
    long = found.ends - found.starts > PREFIX_BYTES
    starts = found.starts[long]
    heads = SubstringHashes(part.data, fold_case=True).of(starts, starts + PREFIX_BYTES) ^ np.uint64(0x5851F42D4C957F2D)
    return found, long, heads


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for part in slices(batch.column("text")):
            found, long, heads = _units(part)
            for prefix, hashes, doc in ((False, found.hashes, found.doc), (True, heads, found.doc[long])):
                # A text counts once for each of its units, so that a word one author repeats is one sighting.
                order = np.lexsort((doc, hashes))
                hashes, doc = hashes[order], doc[order]
                new = np.ones(len(hashes), dtype=bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
                units, which = np.unique(hashes[new], return_inverse=True)
                marks = toxic[part.rows][doc[new]] > 0
                bad = np.bincount(which, weights=marks, minlength=len(units)).astype(np.int64)
                every = np.bincount(which, minlength=len(units)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(units)), pa.array(np.full(len(units), prefix)), pa.array(bad), pa.array(every - bad)],
                    names=["unit", "prefix", "bad", "good"])


@dataclass
class Scores:
    """Listed units, sorted by hash, their scores, and the score of all other tokens."""

    units: np.ndarray
    values: np.ndarray
    other: float


def learn_scores(texts: DataFrame) -> Scores:
    """Scores from ``text, toxic``. The texts are a bounded sample, which bounds the listed units, too."""
    counts = texts.transform(map_arrow, _count, "unit BIGINT, prefix BOOLEAN, bad BIGINT, good BIGINT").groupBy("unit", "prefix").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    totals = {r["prefix"]: r for r in counts.groupBy("prefix").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("kinds")).collect()}
    if not totals or not totals[False]["bad"] or not totals[False]["good"]:
        return Scores(np.zeros(0, np.uint64), np.zeros(0), -1e-3)
    # The prior of a unit: half an occurrence, and as much again dealt out by the units' shares of the text.
    odds, spread = {}, {}
    for prefix, t in totals.items():
        share = (F.col("bad") + F.col("good")) / float(t["bad"] + t["good"])
        alpha = PRIOR + PRIOR * t["kinds"] * share
        whole = 2 * PRIOR * t["kinds"]
        odds[prefix] = F.log((F.col("bad") + alpha) / (F.lit(t["bad"] + whole) - F.col("bad") - alpha)) - F.log(
            (F.col("good") + alpha) / (F.lit(t["good"] + whole) - F.col("good") - alpha))
        spread[prefix] = F.sqrt(1 / (F.col("bad") + alpha) + 1 / (F.col("good") + alpha))
    pick = lambda x: F.when(F.col("prefix"), x[True] if True in x else F.lit(0.0)).otherwise(x[False])
    rows = counts.select("unit", "prefix", "bad", "good", pick(odds).alias("odds"), (pick(odds) / pick(spread)).alias("z"))
    rows = rows.where((F.col("z") >= MIN_Z) & (F.col("odds") >= MIN_ODDS)).collect()
    units = np.array([r["unit"] for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(units)
    listed = [sum(r[c] for r in rows if not r["prefix"]) / totals[False][c] for c in ("bad", "good")]
    listed = [min(x, 0.5) for x in listed]
    return Scores(units[order], np.array([r["odds"] for r in rows], dtype=np.float64)[order],
                  min(-1e-3, math.log((1 - listed[0]) / (1 - listed[1]))))


def maximal_segments(places: list[int], values: list[float], other: float) -> list[tuple[int, int, float]]:
    """All maximal segments ``(first, last, score)`` of a text in linear time.

    ``places`` are the tokens of positive score, in order; each token between them has the score ``other`` < 0.
    """
    first, last, left, right, link = [], [], [], [], []
    total = 0.0
    for i, (place, value) in enumerate(zip(places, values)):
        begin, low = place, total + other * (place - i)
        high = low + value
        total += value
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= low:
                j = link[j]
            if j < 0 or right[j] >= high:
                break
            begin, low = first[j], left[j]
            for stack in (first, last, left, right, link):
                del stack[j:]
        for stack, x in ((first, begin), (last, place), (left, low), (right, high), (link, j)):
            stack.append(x)
    return [(a, b, h - l) for a, b, l, h in zip(first, last, left, right)]


def evidence(scores: list[float], n_tokens: int, log_k: float) -> float:
    """``-log p`` of the best r segments for the best r, never below 0: sums of r extreme values."""
    shift, total, best = log_k + math.log(max(n_tokens, 1)), 0.0, 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        total += s - shift
        if s <= shift and r > 1:
            break
        if total > 0:
            best = max(best, total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r))
    return best


PASSAGES = "passages ARRAY<STRUCT<first: INT, last: INT, score: DOUBLE>>"


def find_segments(df: DataFrame, scores: Scores, keep_text: bool = False) -> DataFrame:
    """``df`` (with ``text``) with ``n_tokens`` and ``passages``: its maximal segments, as token numbers."""
    others = [f for f in df.schema.fields if keep_text or f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "n_tokens BIGINT", PASSAGES])
    names = [f.name for f in others]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = np.append(scores.units, np.uint64(0xFFFFFFFFFFFFFFFF))
        values = np.append(scores.values, 0.0)
        for batch in batches:
            for part in slices(batch.column("text")):
                found, long, heads = _units(part)
                at = np.searchsorted(scores.units, found.hashes)
                value = np.where(listed[at] == found.hashes, values[at], 0.0)
                at = np.searchsorted(scores.units, heads)
                whole = value[long]
                value[long] = np.where(whole > 0, whole, np.where(listed[at] == heads, values[at], 0.0))
                hits = np.flatnonzero(value > 0)
                segments: list[list[dict]] = [[] for _ in range(len(part.offsets) - 1)]
                docs, starts = np.unique(found.doc[hits], return_index=True)
                for doc, a, b in zip(docs, starts, np.append(starts[1:], len(hits))):
                    own = hits[a:b]
                    segments[doc] = [
                        {"first": x, "last": y, "score": s} for x, y, s in maximal_segments(
                            (own - found.first[doc]).tolist(), value[own].tolist(), scores.other)]
                kept = [batch.column(n).slice(part.rows.start, part.rows.stop - part.rows.start) for n in names]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(np.diff(found.first)), pa.array(segments, type=pa.list_(pa.struct(
                        [("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())])))],
                    names=[*names, "n_tokens", "passages"])

    return df.transform(map_arrow, scan, schema)


@dataclass
class Model:
    """Scores, the logarithm of K, and the curve from evidence to the label's probability."""

    scores: Scores
    log_k: float
    slope: float
    base: float


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton steps, held down by a little shrinkage; the slope is never negative."""
    w, ridge = np.zeros(2), np.diag([1e-3, 1e-3])
    a = np.stack([np.log1p(x), np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -4, 4)
    return max(float(w[0]), 0.0), float(w[1])


def fit(documents: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> Model:
    """Learn from at most ``max_sample`` labelled documents outside the held-out fold 0.

    Of equal texts one counts, with the larger label. Scores for the calibration come from the other learning
    folds, so the curve sees texts as new as the held-out ones; the final scores come from all of them. NULL
    ids and NULL labels are left out. Without labels of both kinds every text gets the same score.
    """
    fold = crc_fold(F.col("doc_id"), FOLDS)
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold != 0)).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample)
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    single = sample.groupBy(text_key(F.col("text")).alias("key")).agg(
        F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id")).select("doc_id", "toxic")
    # No more rows than were chosen, so small enough to send along.
    rows = [(r["doc_id"], r["toxic"]) for r in single.collect()]
    if not rows:
        return Model(Scores(np.zeros(0, np.uint64), np.zeros(0), -1e-3), 0.0, 0.0, 0.0)
    spark = documents.sparkSession
    ids = F.broadcast(spark.createDataFrame(rows, f"doc_id {labels.schema['doc_id'].dataType.simpleString()}, toxic INT"))
    texts = documents.select("doc_id", "text").join(ids, "doc_id").withColumn("fold", fold)
    scores = learn_scores(texts.where(F.col("fold") != CALIBRATION_FOLD).select("text", "toxic"))
    found = find_segments(texts.where(F.col("fold") == CALIBRATION_FOLD).select("toxic", "text"), scores).select(
        "toxic", "n_tokens", F.col("passages.score").alias("s")).collect()
    # Chance segments of at least this score in ordinary text, per token, give K.
    floor = math.log(10.0)
    chance = sum(s >= floor for r in found if not r["toxic"] for s in r["s"])
    tokens = sum(r["n_tokens"] for r in found if not r["toxic"])
    log_k = math.log((1 + chance) / max(tokens, 1)) + floor
    x = np.array([evidence(r["s"], r["n_tokens"], log_k) for r in found])
    y = np.array([float(r["toxic"]) for r in found])
    slope, base = _curve(x, y) if len(found) else (0.0, 0.0)
    return Model(learn_scores(texts.select("text", "toxic")), log_k, slope, base)


def score(df: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """``df`` (without ``text`` unless it is to be kept) with ``n_tokens``, ``score``, ``predicted`` and ``passages``.

    ``passages`` are the significant segments with their p-values; NULL and empty texts have none and get the
    score of no evidence. Other columns of the names made here are replaced.
    """
    made = ("n_tokens", "passages", "score", "predicted")
    found = find_segments(df.drop(*made), model.scores, keep_text)
    shift = F.lit(model.log_k) + F.log(F.greatest("n_tokens", F.lit(1)))
    ordered = F.sort_array(F.col("passages.score"), asc=False)
    # Running sums of the best scores; r segments weigh in by the law of sums of r extreme values.
    state = F.struct(F.lit(0).alias("r"), F.lit(0.0).alias("t"), F.lit(0.0).alias("best"), F.lit(False).alias("over"),
                     F.lit(0.0).alias("f"))

    def step(a, s):
        r, t = a["r"] + 1, a["t"] + s - shift
        over = a["over"] | ((s <= shift) & (r > 1))
        # log r! + log (r-1)!
        f = a["f"] + F.log(r) + F.when(r > 1, F.log(r - 1)).otherwise(0.0)
        here = F.when(~over & (t > 0), t - (r - 1) * F.log(F.greatest(t, F.lit(1.0))) + f).otherwise(0.0)
        return F.struct(r.cast("int").alias("r"), t.alias("t"), F.greatest(a["best"], here).alias("best"), over.alias("over"),
                        f.alias("f"))

    proof = F.aggregate(ordered, state, step, lambda a: a["best"])
    rows = found.withColumn("score", 1 / (1 + F.exp(-(F.log1p(proof) * model.slope + model.base))))
    p = lambda s: 1 - F.exp(-F.exp(shift - s["score"]))
    marked = F.transform("passages", lambda s: s.withField("p", p(s)))
    return rows.withColumn("passages", F.filter(marked, lambda s: s["p"] < SIGNIFICANCE)).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def reject(documents: DataFrame, model: Model) -> DataFrame:
    """``documents``, all columns, without the rows whose text is called toxic."""
    hidden = {c: "text" if c == "text" else f"c{i}" for i, c in enumerate(documents.columns)}
    scored = score(documents.toDF(*hidden.values()), model, keep_text=True).where("predicted = 0")
    return scored.select(*hidden.values()).toDF(*hidden)
