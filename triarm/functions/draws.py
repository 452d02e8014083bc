"""Reproducible draws from content hashes.

A draw depends only on a seed and the row's key, never on partitioning, task
retries or row order, so a lost executor recomputes exactly the same sample.
"""

import hashlib

from pyspark.sql import Column, functions as F

HEX = "0123456789abcdef"
WORD = 8  # hex digits of one uniform number
WORD_RANGE = 16**WORD


def draw_key(*parts) -> Column:
    """MD5 over the parts joined by ``|``: the sort key of a random order."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def order_key(*parts) -> Column:
    """First 60 bits of ``draw_key`` as a bigint: the same order, and cheap to aggregate."""
    return F.conv(F.substring(draw_key(*parts), 1, 15), 16, 10).cast("bigint")


def digit(key: Column, position: int = 1) -> Column:
    """Hex digit ``position`` of a key as an int in 0..15."""
    return F.instr(F.lit(HEX), F.substring(key, position, 1)) - 1


def word(key: Column) -> Column:
    """First 32 bits of a key as a bigint."""
    return F.conv(F.substring(key, 1, WORD), 16, 10).cast("bigint")


def pick(key: Column, size: Column) -> Column:
    """Index in 0..size-1, uniform up to rounding."""
    return F.floor(word(key) * size / F.lit(float(WORD_RANGE))).cast("bigint")


# Keys of many seeds per row: (a * h1 + b * h2 + c) mod PRIME, where h1 and h2 are 28
# bits each of the row's MD5 and a, b, c belong to the seed. The row is hashed once,
# and each seed costs two multiplications.
PRIME = 2**31 - 1
DIGITS = 7


def row_words(row_key: Column) -> list[Column]:
    """Two 28-bit numbers of a row."""
    digest = F.md5(row_key.cast("string"))
    return [F.conv(F.substring(digest, 1 + i * DIGITS, DIGITS), 16, 10).cast("bigint") for i in range(2)]


def coefficients(salt: str, seed: int) -> tuple[int, int, int]:
    """The numbers a, b, c of a seed."""
    digest = hashlib.md5(f"{salt}|{seed}".encode()).hexdigest()
    a, b, c = (int(digest[i * DIGITS:(i + 1) * DIGITS], 16) for i in range(3))
    return a, b, c


def seed_key(words: list[Column], a: Column, b: Column, c: Column) -> Column:
    """Key of a row under a seed: even on 0..PRIME-1."""
    return (a * words[0] + b * words[1] + c) % F.lit(PRIME)


def key_below(share: Column) -> Column:
    """Cut so that about ``share`` of all keys lie below it; a share of 1 keeps all."""
    return F.least(F.ceil(share * F.lit(float(PRIME))), F.lit(PRIME)).cast("bigint")
