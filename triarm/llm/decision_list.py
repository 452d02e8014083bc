"""Quality rules learned as a decision list.

Statistics of a text are plain column expressions. From a bounded sample of labelled rows, rules are learned
one after the other (sequential covering): a rule grows by the threshold condition that gains most on one
part of the sample, is pruned on the other part, and the rows it covers are set aside. A rule is a
conjunction such as ``upper_share > 0.61 AND n_words <= 240``; the list becomes one ordered conditional
expression, which Spark evaluates over all rows.
"""

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from triarm.llm.text import SPACE, let, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"
# Labelled rows the learner sees, at most; taken by the hash of their id.
MAX_SAMPLE = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "mean_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share",
            "distinct_share")


def _windows(h: Column) -> Column:
    """Hashes of all 3-word windows, from those of the words."""
    n = F.greatest(F.size(h) - 2, F.lit(0))
    two = F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda a, b: F.xxhash64(a, b))
    return F.zip_with(two, F.slice(h, 3, n), lambda a, b: F.xxhash64(a, b))


def _repeat_words(h: Column) -> Column:
    """Words in 3-word windows that are found twice or more, from the hashes of the words.

    Equal windows stand side by side among the sorted hashes. Most texts have none, and only the others are sorted with places.
    """
    def covered(x: Column) -> Column:
        placed = F.sort_array(F.transform(x, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
        twins = let(placed, lambda p: F.filter(
            p, lambda a, i: (a["h"] == F.get(p, i - 1)["h"]) | (a["h"] == F.get(p, i + 1)["h"])))
        return F.size(F.array_distinct(F.flatten(F.transform(twins, lambda a: F.array(a["i"], a["i"] + 1, a["i"] + 2)))))

    single = lambda x: let(F.sort_array(x), lambda s: ~F.exists(F.transform(s, lambda v, i: v == F.get(s, i - 1)), lambda same: same))
    return let(_windows(h), lambda x: F.when(F.coalesce(single(x), F.lit(True)), 0).otherwise(covered(x)))


def statistics(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the five counts as longs, and three more: ``upper``, ``marks``, ``n_distinct``.

    NULL and empty texts have zeros. Lines are cut at the line feed; a line without a word is no duplicate.
    A text is worked on in the task that reads it, in one pass per statistic, whatever its length.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    count = lambda chars: F.regexp_count(t, F.lit(chars))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x09-\\x0D\\x20]"))
    # A word is hashed once; all that follows works on its hash.
    of_words = let(F.transform(words(t), lambda w: F.xxhash64(w)), lambda h: F.struct(
        F.size(h).alias("n"), F.size(F.array_distinct(h)).alias("d"), _repeat_words(h).alias("r")))
    out = df.select(
        *[F.col(f"`{c}`") for c in keep], of_words.alias("_words_"),
        (F.length(t) - count("[\\x09-\\x0D\\x20]")).alias("word_chars"), count(SYMBOLS).alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
        let(lines, F.size).alias("n_lines"),
        count("[A-Z]").alias("upper"), count("[!?]").alias("marks"))
    out = out.withColumns({"n_words": F.col("_words_.n"), "n_distinct": F.col("_words_.d"), "n_repeat_words": F.col("_words_.r")})
    return out.select(*keep, *[F.col(c).cast("long") for c in (*COUNTS, "n_lines", "upper", "marks", "n_distinct")])


def features() -> dict[str, Column]:
    """The learner's columns, from those of ``statistics``; never NULL."""
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    return {
        "mean_chars": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("upper", "word_chars"), "mark_share": share("marks", "word_chars"),
        "distinct_share": share("n_distinct", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def mask(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.feature] > self.threshold if self.above else table[self.feature] <= self.threshold


Rule = tuple[Condition, ...]


def _covered(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    mask = np.ones(n, dtype=bool)
    for condition in rule:
        mask &= condition.mask(table)
    return mask


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, names: Sequence[str], max_conditions: int) -> Rule:
    """Add the condition of largest information gain until no good row is covered."""
    rule: list[Condition] = []
    live = np.ones(len(bad), dtype=bool)
    while len(rule) < max_conditions and (bad & live).any() and (~bad & live).any():
        p0, all0 = (bad & live).sum(), live.sum()
        best, best_gain = None, 1e-9
        for name in names:
            order = np.argsort(table[name][live], kind="stable")
            values, hits = table[name][live][order], bad[live][order]
            cuts = np.flatnonzero(np.diff(values)) + 1
            if not len(cuts):
                continue
            low, p_low = cuts, np.cumsum(hits)[cuts - 1]
            for above, size, p in ((False, low, p_low), (True, all0 - low, p0 - p_low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / size) - math.log2(p0 / all0)), 0.0)
                i = int(np.argmax(gain))
                if gain[i] > best_gain:
                    best = Condition(name, above, float((values[cuts[i] - 1] + values[cuts[i]]) / 2))
                    best_gain = gain[i]
        if best is None:
            break
        rule.append(best)
        live &= best.mask(table)
    return tuple(rule)


def _prune(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float]:
    """The beginning of the rule that does best on rows it has not grown on, and its smoothed precision there."""
    best, best_value = rule, -1.0
    for k in range(len(rule), 0, -1):
        mask = _covered(rule[:k], table, len(bad))
        p, n = (bad & mask).sum(), (~bad & mask).sum()
        value = (p - n) / (p + n) if p + n else -1.0
        if value > best_value:
            best, best_value = rule[:k], value
    mask = _covered(best, table, len(bad))
    p, n = int((bad & mask).sum()), int((~bad & mask).sum())
    return best, (p + 1) / (p + n + 2) if p else 0.0


def learn(rows: Sequence[tuple], names: Sequence[str] = FEATURES, max_rules: int = 16, max_conditions: int = 4,
          min_precision: float = 0.8) -> list[Rule]:
    """Ordered rules that reject. A row is ``(quality, *values)`` with quality 0 for text to reject.

    Rows with NULL quality are left out. Rows alternate between growing (two of three) and pruning. A rule
    whose precision on the pruning rows is below ``min_precision`` ends the list. No rows, or rows of one kind,
    give no rules.
    """
    rows = [r for r in rows if r[0] is not None]
    if not rows:
        return []
    values = np.array([[float(x) for x in r] for r in rows])
    turn = np.arange(len(rows)) % 3 == 2
    rules: list[Rule] = []
    while len(rules) < max_rules:
        grow, prune = values[~turn], values[turn]
        rule = _grow({n: grow[:, i + 1] for i, n in enumerate(names)}, grow[:, 0] == 0, names, max_conditions)
        if not rule:
            break
        rule, precision = _prune(rule, {n: prune[:, i + 1] for i, n in enumerate(names)}, prune[:, 0] == 0)
        if precision < min_precision:
            break
        rules.append(rule)
        out = _covered(rule, {n: values[:, i + 1] for i, n in enumerate(names)}, len(values))
        values, turn = values[~out], turn[~out]
    return rules


def rule_number(rules: Sequence[Rule]) -> Column:
    """Number, from 1, of the first rule that covers a row; NULL if none does."""
    chain = None
    for i, rule in enumerate(rules, 1):
        test = rule[0].column()
        for condition in rule[1:]:
            test &= condition.column()
        chain = (F if chain is None else chain).when(test, i)
    return F.lit(None).cast("int") if chain is None else chain.cast("int")


def fit(documents: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> list[Rule]:
    """Learn from at most ``max_sample`` labelled documents, those whose ids have the smallest hashes.

    ``labels`` has ``doc_id, quality``; ids that are NULL are left out, and ids that are labelled twice count
    with the smaller label. The sample's ids are few enough to broadcast.
    """
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = statistics(texts, keep=("doc_id", "quality")).withColumns(features())
    rows = rows.select("doc_id", "quality", *FEATURES).orderBy(F.xxhash64("doc_id"), *FEATURES).limit(max_sample)
    return learn([tuple(r)[1:] for r in rows.collect()])


def judge(documents: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``doc_id``, the five counts, ``base_failed, rule, kept``: one row per row of ``documents``.

    ``rule`` is the rule that rejects the text, NULL if none does; ``kept`` needs both verdicts to be good.
    """
    rows = statistics(documents).withColumns(features()).withColumn("base_failed", base_failed())
    rows = rows.withColumn("rule", rule_number(rules))
    return rows.select("doc_id", *COUNTS, "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))
