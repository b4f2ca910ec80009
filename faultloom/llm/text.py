"""Column expressions shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries that state nothing, after reduction to lower-case letters and digits.
PLACEHOLDERS = ["", "na", "none", "null", "unknown"]


def alnum(x: Column) -> Column:
    """Lower case, letters and digits only; null stays null."""
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "")


def stated(x: Column) -> Column:
    """``alnum(x)``, or null where ``x`` is null, blank or a placeholder."""
    reduced = alnum(x)
    return F.when(~reduced.isin(PLACEHOLDERS), reduced)


def distinct_stated(entries: Column) -> Column:
    """The distinct stated entries of an array; null and empty arrays give an empty array."""
    return F.array_distinct(F.array_compact(F.transform(F.coalesce(entries, F.array().cast("array<string>")), stated)))
