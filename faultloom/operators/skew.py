"""Aggregation by keys of which a few hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key with at least this share of all rows is heavy; at most 1 / share keys can be.
HEAVY_SHARE = 0.01
SALTS = 32


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float = HEAVY_SHARE) -> DataFrame:
    """Keys that hold at least ``share`` of all rows, at most ``1 / share`` rows.

    The counts come from map-side combined partial counts over all rows. The bound follows from
    counting: more than ``1 / share`` keys cannot each hold ``share`` of the rows, so the
    result is safe to broadcast at any scale. ``keys[:-1]`` name independent keyings (their
    shares are taken within each), ``keys[-1]`` is the key itself; null keys are never heavy.
    """
    groups, key = list(keys[:-1]), keys[-1]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(*groups).agg(F.sum("_n").alias("_all"))
    joined = counts.join(F.broadcast(totals), groups) if groups else counts.crossJoin(F.broadcast(totals))
    return joined.filter(F.col(key).isNotNull() & (F.col("_n") >= F.col("_all") * share)).select(*keys)


def salted(df: DataFrame, keys: Sequence[str], spread: Column, heavy: DataFrame, salts: int = SALTS) -> DataFrame:
    """Adds ``_salt``: 0 for light keys, a value of 0..salts-1 for rows of heavy keys.

    The salt is drawn by hashing ``spread``, not from a random generator: a task that is
    run again after an executor was lost must give every row the same salt, and equal values
    of ``spread`` must meet under one salt for distinct counts to add up.
    """
    marked = df.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), list(keys), "left")
    salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0))
    return marked.withColumn("_salt", salt.cast("int")).drop("_heavy")


def per_key_counts(
    df: DataFrame,
    key_fields: Sequence[str],
    distinct_of: dict[str, Sequence[str]] | None = None,
    share: float = HEAVY_SHARE,
    salts: int = SALTS,
) -> DataFrame:
    """Rows and distinct values per key for several key columns at once, by two-stage salted aggregation.

    ``distinct_of[key_field]`` names the columns whose distinct non-null values are counted for
    that key; every key field must have as many. Without it only rows are counted. Result: ``key_field, key_value, rows,
    distinct_0, distinct_1, ...``.

    Stage 1 aggregates per (key, counted column, salt): heavy keys, the null key among them, are spread over ``salts``
    groups by the counted value, or by the whole row where there is none to count, so no task ever gets more than its share of
    one key. Stage 2 merges the partial results by key. Every row counts; a null key forms one group with
    ``key_value`` null; an empty table gives no rows. Extra columns are ignored.
    """
    distinct_of = distinct_of or {k: [] for k in key_fields}
    width = {len(distinct_of[k]) for k in key_fields}
    if len(width) != 1:
        raise ValueError("every key field needs the same number of counted columns")
    none = F.lit(None).cast("string")
    plain = [f"`{f.name}`" for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    whole = F.xxhash64(*plain).cast("string")
    rows = df.withColumn("_row", whole)
    entries = [
        F.struct(F.lit(k).alias("key_field"), F.struct(F.col(k).cast("string").alias("v")).alias("key"), F.lit(i).alias("part"), c.alias("value"), F.coalesce(c, F.col("_row")).alias("spread"))
        for k in key_fields
        for i, c in enumerate([F.col(x).cast("string") for x in distinct_of[k]] or [none])
    ]
    long = rows.select(F.inline(F.array(*entries)))
    keyed = df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("key_field"), F.struct(F.col(k).cast("string").alias("v")).alias("key")) for k in key_fields])))
    spread = salted(long, ["key_field", "key"], F.col("spread"), heavy_keys(keyed, ["key_field", "key"], share), salts)
    if width == {0}:
        partial = spread.groupBy("key_field", "key", "_salt").agg(F.count(F.lit(1)).alias("n"))
        return partial.groupBy("key_field", "key").agg(F.sum("n").alias("rows")).select("key_field", F.col("key.v").alias("key_value"), "rows")
    values = spread.groupBy("key_field", "key", "part", "_salt", "value").agg(F.count(F.lit(1)).alias("n"))
    partial = values.groupBy("key_field", "key", "part", "_salt").agg(F.sum("n").alias("n"), F.count("value").alias("d"))
    merged = [F.sum(F.when(F.col("part") == 0, F.col("n"))).alias("rows")]
    merged += [F.sum(F.when(F.col("part") == i, F.col("d"))).alias(f"distinct_{i}") for i in range(width.pop())]
    return partial.groupBy("key_field", "key").agg(*merged).select("key_field", F.col("key.v").alias("key_value"), "rows", *[f"distinct_{i}" for i in range(len(merged) - 1)])


def keys_holding(counts: DataFrame, total_rows: int, percent: int) -> DataFrame:
    """Keys of :func:`per_key_counts` with at least ``percent`` % of ``total_rows`` rows; null keys are left out."""
    return counts.filter(F.col("key_value").isNotNull() & (F.col("rows") * 100 >= F.lit(percent) * F.lit(total_rows)))
