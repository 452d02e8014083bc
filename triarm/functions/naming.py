"""Display names and lookups."""

from pyspark.sql import Column, functions as F


def _lookup(col: Column, names: dict) -> Column:
    flat = [F.lit(x) for pair in names.items() for x in pair]
    return F.create_map(*flat)[col]


def recode(col: Column, names: dict) -> Column:
    """Replace known values, keep the others."""
    return F.coalesce(_lookup(col, names), col)


def recode_strict(col: Column, names: dict) -> Column:
    """Replace values; an unknown one fails the query."""
    unknown = F.raise_error(F.concat(F.lit("no name for value: "), F.coalesce(col.cast("string"), F.lit("NULL"))))
    return F.coalesce(_lookup(col, names), unknown.cast("string"))


def label_of(col: Column, codes: dict) -> Column:
    """Integer label of a string class; NULL for unknown ones."""
    return _lookup(col, codes)


def short_name(col: Column) -> Column:
    """Dataset name without its owner."""
    return F.substring_index(col, "/", -1)
