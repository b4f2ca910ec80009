"""Copies that differ only in formatting: dictionary encoding of canonical values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.bitmaps import among, pieces_for
from ..operators.skew import heavy_keys
from ..session import materialize
from .text import alnum


def canonical_json(text: Column) -> Column:
    """Compact JSON text with every string reduced to lower-case letters and digits.

    Escapes are dropped first (written by Spark, they only stand for punctuation and control
    characters), so quotes only delimit strings: odd pieces of a split at quotes are their contents.
    """
    pieces = F.split(F.regexp_replace(text, r"\\(u[0-9a-fA-F]{4}|.)", ""), '"', -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, alnum(p)).otherwise(p)), '"')


def raw_value(name: str, kind: T.DataType) -> Column:
    """A column's value as one text: JSON, with map entries in the order of their reduced keys."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.MapType):
        c = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(alnum(e["key"]).alias("k"), e["value"].alias("v"))))
    return F.to_json(F.struct(c.alias("v")))


def column_fields(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """``rid, field, raw`` for each given column of each row; a null value has the raw text of an empty object."""
    entries = [F.struct(F.lit(i).cast("string").alias("field"), raw_value(n, df.schema[n].dataType).alias("raw")) for i, n in enumerate(columns)]
    return df.select(F.col(row_id).alias("rid"), F.inline(F.array(*entries)))


def parsed_body(body: Column) -> Column:
    """A JSON text as a variant, byte order mark and outer blanks aside; null for broken texts.

    The parser does not look behind the first value, so the text is read as the one entry of an
    array: anything that follows makes it invalid or a second entry.
    """
    bare = F.regexp_replace(body, r"(?U)^[\s﻿\x00]+|[\s﻿\x00]+$", "")
    listed = F.try_parse_json(F.concat(F.lit("["), bare, F.lit("]")))
    alone = F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(alone & ~bare.rlike(r"^\s*$"), F.try_variant_get(listed, "$[0]", "variant"))


def member_fields(df: DataFrame, row_id: str, body: str) -> DataFrame:
    """``rid, field, raw`` for each member of each row's JSON object; broken bodies give no rows.

    Variants keep object members sorted by name at every level, so member order is gone here. A
    JSON value that is no object, or an empty object, is one unnamed field. Bodies are parsed once.
    """
    doc = df.select(F.col(row_id).alias("rid"), parsed_body(F.col(body)).alias("doc")).filter("doc is not null")
    doc = doc.withColumn("members", F.expr("CASE WHEN schema_of_variant(doc) LIKE 'OBJECT%' THEN doc END"))
    each = doc.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("members").outer()))
    return each.select("rid", F.coalesce("key", F.lit("")).alias("field"), F.when(F.col("key").isNull(), F.to_json("doc")).otherwise(F.to_json("value")).alias("raw"))


def value_dictionary(fields: DataFrame) -> DataFrame:
    """``h, g, value_id``: each distinct value of a field canonicalised once and given an integer.

    ``h, g`` are a 128-bit hash of field and raw value. The integer is a 64-bit hash of the canonical text, so that it is the same in
    every run and needs no numbering pass. Records are told apart by all their integers together: two differing records
    would be joined only if every differing value collided.
    """
    distinct = fields.groupBy("field", "raw").agg(F.lit(1).alias("_"))
    return distinct.select(*_value_hash(), F.xxhash64("field", canonical_json(F.col("raw"))).alias("value_id"))


def _value_hash() -> list[Column]:
    return [F.xxhash64("field", "raw").alias("h"), F.xxhash64(F.lit(1), "raw", "field").alias("g")]


def record_tuples(fields: DataFrame, label: str) -> DataFrame:
    """``rid, record``: each record as its sorted field-value integers; with a column ``tbl`` the ids are told apart by it.

    Rows meet the dictionary by the hashes of their values; raw texts are shuffled only once per task and distinct value. Values
    that fill a large part of all rows (a constant column, null members) are looked up in a broadcast table of at most
    ``1 / HEAVY_SHARE`` values, so no task gets all rows of one value.
    """
    dictionary = materialize(value_dictionary(fields), f"{label}-dictionary")
    own = [c for c in ("tbl", "rid") if c in fields.columns]
    coded = fields.select(*own, *_value_hash())
    heavy = F.broadcast(heavy_keys(coded.select("h"), ["h"]).join(dictionary, "h").select("h", "g", F.col("value_id").alias("heavy_id")))
    parted = coded.join(heavy, ["h", "g"], "left")
    light = parted.filter("heavy_id IS NULL").join(dictionary, ["h", "g"]).select(*own, "value_id")
    ids = light.unionByName(parted.filter("heavy_id IS NOT NULL").select(*own, F.col("heavy_id").alias("value_id")))
    return ids.groupBy(*own).agg(F.array_sort(F.collect_list("value_id")).alias("record"))


def possible_copies(df: DataFrame, key: Column) -> DataFrame:
    """Rows that may share ``key`` with another row; rows surely alone with theirs are left out (:func:`among`).

    Copies have equal keys, so none is lost.
    """
    twice = df.select(F.xxhash64(key).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k")
    return among(df, key, twice, pieces_for(df.count()))


def grouped_copies(tuples: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """The tuples as a table in the shared folder, and ``record, first_id, n_copies`` of their groups (per ``tbl`` where there is one)."""
    kept = materialize(tuples, label)
    return kept, kept.groupBy(*[c for c in ("tbl", "record") if c in kept.columns]).agg(F.min("rid").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))


def copies(tuples: DataFrame, label: str) -> DataFrame:
    """``first_id, copy_id``: each row that repeats another, with the smallest id of its group (and ``tbl`` where there is one).

    Groups are counted with map-side combining; members meet their group in a join on the compact
    tuples, whose large keys adaptive execution splits. No group is ever collected.
    """
    kept, groups = grouped_copies(tuples, label)
    own = [c for c in ("tbl",) if c in kept.columns]
    return kept.join(groups.filter("n_copies > 1"), [*own, "record"]).filter("rid > first_id").select(*own, "first_id", F.col("rid").alias("copy_id"))


CARD_COLUMNS_IGNORED = ("card_id", "source_file", "ingested_at")


def card_fields(cards: DataFrame) -> DataFrame:
    """Fields of crash cards over all columns but their id, file and time of ingestion; cards surely without a copy are left out."""
    names = [c for c in cards.columns if c not in CARD_COLUMNS_IGNORED]
    key = F.concat_ws("|", *[alnum(F.col(c)) for c in ("case_id", "crash_uid", "kernel_commit", "normalized_report_digest")])
    return column_fields(possible_copies(cards, key), "card_id", names)


def label_fields(labels: DataFrame) -> DataFrame:
    """Fields of label rows: bug, case and label."""
    return column_fields(labels, "row_id", ["bug_id", "case_id", "final_ground_truth_id"])


def line_fields(lines: DataFrame) -> DataFrame:
    """Fields of JSON lines: the members of their bodies."""
    return member_fields(lines, "line_id", "body")


def table_tuples(tables: Sequence[DataFrame], label: str = "p2") -> DataFrame:
    """``tbl, rid, record`` of several tables' fields (``tbl`` is the table's place in the list), by one dictionary and one pass over all of them."""
    tagged = [f.select(F.lit(n).alias("tbl"), "rid", F.concat(F.lit(f"{n}."), "field").alias("field"), "raw") for n, f in enumerate(tables)]
    return record_tuples(materialize(reduce(DataFrame.unionByName, tagged), f"{label}-fields"), label)


def card_tuples(cards: DataFrame) -> DataFrame:
    """Record tuples of crash cards."""
    return record_tuples(materialize(card_fields(cards), "p2-card-fields"), "p2-cards")


def label_tuples(labels: DataFrame) -> DataFrame:
    """Record tuples of label rows."""
    return record_tuples(materialize(label_fields(labels), "p2-label-fields"), "p2-labels")


def line_tuples(lines: DataFrame) -> DataFrame:
    """Record tuples of JSON lines."""
    return record_tuples(materialize(line_fields(lines), "p2-line-fields"), "p2-lines")


def record_counts(rows: DataFrame, row_id: str, found: DataFrame) -> DataFrame:
    """``first_id, n_copies`` of every distinct record: each row that repeats no earlier one, with the number of rows that say the same.

    ``found`` is the result of :func:`copies`; rows it does not name stand for themselves. With a column ``tbl`` in both, ids are told apart by it.
    """
    own = [c for c in ("tbl",) if c in found.columns]
    firsts = rows.select(*own, F.col(row_id).alias("first_id")).join(found.select(*own, F.col("copy_id").alias("first_id")), [*own, "first_id"], "left_anti")
    counted = found.groupBy(*own, "first_id").agg(F.count(F.lit(1)).alias("n"))
    return firsts.join(counted, [*own, "first_id"], "left").select(*own, "first_id", (F.coalesce("n", F.lit(0)) + 1).alias("n_copies"))
