"""Scores, probabilities and small numeric expressions."""

from pyspark.sql import Column, functions as F

# Runs of anything but (latin) letters and digits separate tokens.
TOKEN_BREAK = "[^a-zà-öø-ÿ0-9]+"
# Scores are compared at this many decimals, so float noise cannot break ties.
SCORE_DECIMALS = 9


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda t: t != "")


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    A column used several times inside array lambdas is otherwise evaluated for
    every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by its maximum."""

    def share(exps: Column) -> Column:
        total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
        return bind(total, lambda t: F.transform(exps, lambda x: x / t))

    def shifted(xs: Column) -> Column:
        return bind(F.array_max(xs), lambda top: bind(F.transform(xs, lambda x: F.exp(x - top)), share))

    return bind(logits, shifted)


def argmax(scores: Column, decimals: int = SCORE_DECIMALS) -> Column:
    """0-based position of the first maximum."""
    rounded = F.transform(scores, lambda x: F.round(x, decimals))
    return bind(rounded, lambda xs: F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def odds_ratio(x: Column, y: Column) -> Column:
    return F.try_divide(F.try_divide(x, 1 - x), F.try_divide(y, 1 - y))


def standard_error(x: Column) -> Column:
    return F.stddev_samp(x) / F.sqrt(F.count(x))


def logit(successes: Column, trials: Column) -> Column:
    """Log odds with the usual half-count correction, so 0 and all are finite."""
    return F.log((successes + F.lit(0.5)) / (trials - successes + F.lit(0.5)))
