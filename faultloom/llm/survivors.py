"""Best representative of each duplicate group, chosen field by field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .copies import among, pieces_for
from .text import alnum, distinct_stated, stated

TRACES = ["alloc_trace", "free_trace", "origin_trace", "lockdep_registered_trace"]
TOKEN_LISTS = ["syscalls", "bpf_program_types", "bpf_helpers", "bpf_map_types", "bpf_map_ops", "tracepoints", "socket_ops", "semantic_tokens"]


def _frames(frames: Column) -> Column:
    """Number of distinct functions, files and lines that a trace states."""
    known = F.filter(frames, lambda f: f.isNotNull())
    lines = F.size(F.array_distinct(F.array_compact(F.transform(known, lambda f: f["line"]))))
    names = [F.size(distinct_stated(F.transform(known, lambda f: f["func"]))), F.size(distinct_stated(F.transform(known, lambda f: f["file"])))]
    return F.when(frames.isNull(), F.lit(0)).otherwise(names[0] + names[1] + lines)


def _flag(x: Column) -> Column:
    return F.coalesce(x, F.lit(False)).cast("int")


def crash_card_completeness() -> dict[str, Sequence[Column]]:
    """Per mergeable field of a crash card: how many different things it states, then how long its excerpt is."""
    excerpt = F.coalesce(F.length(stated(F.col("reproducer_semantics.syz_repro_excerpt"))), F.lit(0))
    lists = sum((F.size(distinct_stated(F.col(f"reproducer_semantics.{k}"))) for k in TOKEN_LISTS), F.lit(0))
    return {
        "repro": [
            _flag(F.col("repro.has_syz_repro")) + _flag(F.col("repro.has_c_repro")) + F.size(distinct_stated(F.col("repro.syscall_hints"))),
            F.lit(0),
        ],
        "reproducer_semantics": [lists, excerpt],
        "sanitizer_context": [sum((_frames(F.col(f"sanitizer_context.{k}")) for k in TRACES), F.lit(0)), F.lit(0)],
        "stack_semantic": [_frames(F.col("stack_semantic")), F.lit(0)],
    }


def ranked_survivors(
    df: DataFrame,
    group: Column,
    row_id: str,
    completeness: dict[str, Sequence[Column]],
    trust: Column | None = None,
    recency: Column | None = None,
) -> DataFrame:
    """For each group of two or more rows and each field, the row with the best value of that field.

    Rows rank by completeness (its columns in order, larger first), then trust and recency where
    given (larger first, nulls last), then the smallest ``row_id``. Fields that no row of a group
    states (all completeness values 0) give no row. Result: ``group_id`` (the smallest id of the
    group), ``n_rows``, ``field_name``, ``row_id``.

    Only slim rows (key, field, scores, id) are shuffled, never the records. The top record is
    taken with ``row_number() = 1``, which Spark also applies before the shuffle (a partial window
    group limit), so a group holding a third of all rows sends one row per task and field.
    Rows whose group key is null belong to no group. Empty tables give no rows.
    """
    scores = {n: list(cols) for n, cols in completeness.items()}
    width = max(len(c) for c in scores.values())
    entries = [
        F.struct(F.lit(n).alias("field_name"), *[(c[i] if i < len(c) else F.lit(0)).cast("long").alias(f"s{i}") for i in range(width)])
        for n, c in scores.items()
    ]
    slim = df.select(
        group.alias("g"),
        F.col(row_id).alias("row_id"),
        (trust if trust is not None else F.lit(None).cast("int")).alias("trust"),
        (recency if recency is not None else F.lit(None).cast("int")).alias("recency"),
        F.array(*entries).alias("fields"),
    ).filter(F.col("g").isNotNull())
    groups = (
        df.select(group.alias("g"), F.col(row_id).alias("row_id"))
        .filter(F.col("g").isNotNull())
        .groupBy("g")
        .agg(F.min("row_id").alias("group_id"), F.count(F.lit(1)).alias("n_rows"))
        .filter("n_rows > 1")
    )
    stating = slim.select("g", "row_id", "trust", "recency", F.inline("fields")).filter(" or ".join(f"s{i} > 0" for i in range(width)))
    order = [F.col(f"s{i}").desc() for i in range(width)] + [F.col("trust").desc_nulls_last(), F.col("recency").desc_nulls_last(), F.col("row_id").asc()]
    best = stating.withColumn("_r", F.row_number().over(Window.partitionBy("g", "field_name").orderBy(*order))).filter("_r = 1")
    return best.join(groups, "g").select("group_id", "n_rows", "field_name", "row_id")


def cluster_group() -> Column:
    """Signature bucket of a card: its cluster key in letters and digits, case aside."""
    reduced = alnum(F.col("cluster_key"))
    return F.when(reduced != "", reduced)


def surviving_records(df: DataFrame, best: DataFrame, row_id: str, fields: Sequence[str], label: str = "p1") -> DataFrame:
    """One record per group built field by field: ``group_id, n_rows`` and, per field, ``<field>_from`` (the row it was taken from) and ``<field>``.

    ``best`` is the result of :func:`ranked_survivors`. Every field is fetched on its own, from the rows chosen for it: a broadcast
    bitmap of bounded size leaves out the other rows in the scan, so of a wide record only fields that survive are
    shuffled. At most one value per field and group meets in a group's record. A field that no row states is null.
    """
    chosen = materialize(best, f"{label}-chosen")
    pieces = pieces_for(chosen.count())
    out = chosen.select("group_id", "n_rows").distinct()
    for f in fields:
        own = chosen.filter(F.col("field_name") == f).select("group_id", "row_id")
        rows = among(df.select(F.col(row_id).alias("row_id"), F.col(f)), F.col("row_id"), own.select(F.xxhash64("row_id").alias("k")), pieces)
        out = out.join(own.join(rows, "row_id").select("group_id", F.col("row_id").alias(f"{f}_from"), f), "group_id", "left")
    return out.select("group_id", "n_rows", *[c for f in fields for c in (f"{f}_from", f)])
