"""URL filter: fixed rules first, then two character models compared.

URLs that a rule accepts or rejects train one variable-order Markov model each. A character is predicted
from the three before it; where that context is rare, the prediction leans on shorter contexts (Witten-Bell:
the shorter context weighs as much as the number of different characters seen after the longer one).
Other URLs are judged by the mean difference of the two log-likelihoods per character, against the value
that separates the accepted from the rejected URLs best.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window

from triarm.llm.text import lower_ascii


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


ORDER = 4
ALPHABET = 256
BINS = 200  # to one unit of the score

_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
_START, _END = "\u0002", "\u0003"


def host_of(url: Column) -> Column:
    """What is between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _best(rules: Sequence[Rule], what: str) -> Column:
    chain = None
    for rule in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith(f".{rule.host}")) & F.col("path").startswith(rule.path)
        chain = (F if chain is None else chain).when(fits, getattr(rule, what))
    return F.lit(None).cast("string") if chain is None else chain


def apply_rules(df: DataFrame, url: str, rules: Sequence[Rule]) -> DataFrame:
    """``df`` with ``host, path, rule, rule_verdict``; the longest fitting rule wins. NULL urls have empty parts."""
    parts = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    return parts.withColumns({"rule": _best(rules, "name"), "rule_verdict": _best(rules, "verdict")})


def _grams(df: DataFrame, *keep: str) -> DataFrame:
    """One row per character of ``name``, its end included: the character after the three before it."""
    padded = F.concat(F.lit(_START * (ORDER - 1)), F.col("name"), F.lit(_END))
    places = F.sequence(F.lit(1), F.length("name") + 1)
    return df.select(*keep, F.explode(F.transform(places, lambda i: F.substring(padded, i, F.lit(ORDER)))).alias("gram"))


def gram_ratios(names: DataFrame) -> DataFrame:
    """``gram, ratio``: log of accepted over rejected probability of the last character of each gram.

    ``names`` has ``name, allowed, blocked``: how many accepted and rejected urls have that name. Tables here
    have a row per different gram.
    """
    counts = _grams(names, "allowed", "blocked").groupBy("gram").agg(
        F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    below = None
    for k in range(1, ORDER + 1):
        seen = counts.groupBy(F.substring("gram", ORDER + 1 - k, k).alias("gram")).agg(
            F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
        seen = seen.withColumns({"context": F.substring("gram", 1, k - 1), "shorter": F.substring("gram", 2, k - 1)})
        totals = seen.groupBy("context").agg(*[
            f for c in ("allowed", "blocked")
            for f in (F.sum(c).alias(f"n_{c}"), F.count_if(F.col(c) > 0).alias(f"t_{c}"))])
        joined = seen.join(totals, "context")
        if below is None:
            joined = joined.withColumns({f"b_{c}": F.lit(1.0 / ALPHABET) for c in ("allowed", "blocked")})
        else:
            joined = joined.join(below, "shorter")
        smoothed = [
            F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * F.col(f"b_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}")))
            .otherwise(F.col(f"b_{c}")).alias(f"b_{c}") for c in ("allowed", "blocked")]
        below = joined.select(F.col("gram").alias("shorter"), *smoothed)
    return below.select(F.col("shorter").alias("gram"), F.log(F.col("b_allowed") / F.col("b_blocked")).alias("ratio"))


def _threshold(scores: DataFrame) -> float | None:
    """The score that separates best, half way between the last bin above it and the first below it.

    Best is where the share of accepted urls above it exceeds the share of rejected ones by most.

    The score of a character lies within the logarithm of the smallest probability, so the number of bins is
    bounded. None where one kind is missing.
    """
    bins = scores.groupBy(F.floor(F.col("score") * BINS).alias("bin")).agg(
        F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    order = Window.orderBy(F.desc("bin"))
    everything = Window.partitionBy()
    bins = bins.where("allowed + blocked > 0")
    shares = bins.select("bin", F.lead("bin").over(order).alias("below"), *[
        F.try_divide(F.sum(c).over(order), F.sum(c).over(everything)).alias(c) for c in ("allowed", "blocked")])
    gain = F.round(F.col("allowed") - F.col("blocked"), 9)
    best = shares.where(gain.isNotNull()).orderBy(gain.desc(), F.desc("bin")).first()
    if best is None:
        return None
    return best["bin"] / BINS if best["below"] is None else (best["bin"] + best["below"] + 1) / 2 / BINS


def judge(df: DataFrame, url: str, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """``df`` with ``host, path, rule, score, verdict``; columns of ``df`` with these names are replaced.

    Equal names (host and path) are scored once, with their number of urls as weight. Where no URL was
    accepted, or none rejected, by a rule, nothing can be learned: others then get ``default``.
    An empty name is scored by its end alone.
    """
    made = ("host", "path", "rule", "score", "verdict", "rule_verdict", "name")
    parts = apply_rules(df.drop(*[c for c in made if c != url]), url, rules).withColumn("name", F.concat("host", "path"))
    names = parts.groupBy("name").agg(
        F.count_if(F.col("rule_verdict") == "allow").alias("allowed"),
        F.count_if(F.col("rule_verdict") == "block").alias("blocked"))
    ratios = gram_ratios(names)
    scores = _grams(names, "name", "allowed", "blocked").join(ratios, "gram").groupBy("name", "allowed", "blocked").agg(
        F.avg("ratio").alias("score"))
    threshold = _threshold(scores)
    method = F.lit(default) if threshold is None else F.when(F.col("score") >= threshold, "allow").otherwise("block")
    keep = [F.col(f"`{c}`") for c in df.columns if c not in made or c == url]
    return parts.join(scores.select("name", "score"), "name", "left").select(
        *keep, "host", "path", "rule", "score", F.coalesce("rule_verdict", method).alias("verdict"))
