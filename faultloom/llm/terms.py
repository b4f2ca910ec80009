"""Frequency of every distinct term, with marks for terms too rare or too common."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Heavy terms looked for per field, and items a sketch tracks to find them.
HEAVY_TERMS, TRACKED = 256, 4096
#: Distinct spellings whose canonical form a task remembers at once; beyond, it starts to remember anew.
REMEMBERED = 500_000

_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_OUTER, _INNER = re.compile(f"^[{_BLANK}]+|[{_BLANK}]+$"), re.compile(f"[{_BLANK}_]+")


def canonical_term(token: str) -> str:
    """Lower case, outer blanks dropped, blanks and underscores in a row as one underscore."""
    return _INNER.sub("_", _OUTER.sub("", token).lower())


def _batch_counts(lists: pa.Array, known: dict[str, str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Terms of one batch of token lists with their occurrences and records; every spelling is canonicalised once."""
    if isinstance(lists.type, pa.LargeListType):
        lists = lists.cast(pa.list_(lists.type.value_type))
    parent, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
    some = pc.is_valid(flat)
    parent, words = parent.filter(some).to_numpy(), flat.filter(some).dictionary_encode()
    spelled = words.dictionary.to_pylist()
    if len(known) > REMEMBERED:
        known.clear()
    terms = pa.array([known[w] if w in known else known.setdefault(w, canonical_term(w)) for w in spelled], pa.string()).dictionary_encode()
    at = terms.indices.to_numpy()[words.indices.to_numpy()] if len(spelled) else np.zeros(0, np.int64)
    names = terms.dictionary
    full = pc.not_equal(names, "").to_numpy(zero_copy_only=False)
    kept = full[at] if len(at) else np.zeros(0, bool)
    at, parent = at[kept].astype(np.int64), parent[kept].astype(np.int64)
    occurrences = np.bincount(at, minlength=len(names))
    pairs = np.unique(parent * max(1, len(names)) + at)
    records = np.bincount(pairs % max(1, len(names)), minlength=len(names))
    seen = np.flatnonzero(occurrences)
    return names.take(pa.array(seen)), occurrences[seen], records[seen]


def batch_counts(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """``field_name, term, occurrences, records`` of every batch of rows: tokens are parsed once, and counted where they are read."""
    names = list(fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for b in batches:
            for i, name in enumerate(names):
                terms, occurrences, records = _batch_counts(b.column(i), known)
                if len(terms):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(terms)), terms, pa.array(occurrences, pa.int64()), pa.array(records, pa.int64())], ["field_name", "term", "occurrences", "records"])

    tokens = df.select(*[c.cast("array<string>").alias(f"f{i}") for i, c in enumerate(fields.values())])
    return tokens.mapInArrow(count, "field_name string, term string, occurrences long, records long")


def heavy_terms(counts: DataFrame, k: int = HEAVY_TERMS, tracked: int = TRACKED) -> DataFrame:
    """At most ``k`` terms of each field that occur in most batches, found by a mergeable sketch over all of them.

    The sketch only decides which way a term is counted, never its counts. The result has at
    most ``k`` rows per field, whatever the data.
    """
    top = counts.groupBy("field_name").agg(F.expr(f"approx_top_k(term, {int(k)}, {int(tracked)})").alias("top"))
    return top.select("field_name", F.explode("top.item").alias("term"))


def term_frequencies(df: DataFrame, fields: dict[str, Column], heavy: int = HEAVY_TERMS, label: str = "p4") -> DataFrame:
    """``field_name, term, occurrences, records`` of every distinct term of every field, exactly.

    Heavy and light terms part ways: the heavy terms (a bounded list, see :func:`heavy_terms`) are broadcast and every task
    adds their counts up in arrays of exact counters, of which it sends one row per heavy term; only light terms are shuffled
    by their text. Both count tables are then united. A term counts once for a record however often the record has it.

    Null and blank tokens are no terms; null and empty lists add nothing; an empty table gives no
    rows. Other columns are not read.
    """
    counts = materialize(batch_counts(df, fields), f"{label}-batches")
    found = heavy_terms(counts, heavy).orderBy("field_name", "term").collect()  # at most HEAVY_TERMS a field
    slots = {(r["field_name"], r["term"]): i for i, r in enumerate(found)}
    shared = df.sparkSession.sparkContext.broadcast(slots)

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = shared.value
        counters = np.zeros((2, len(slot)), np.int64)
        for b in batches:
            at = np.fromiter((slot.get(x, -1) for x in zip(b.column("field_name").to_pylist(), b.column("term").to_pylist(), strict=True)), np.int64, b.num_rows)
            for counter, name in zip(counters, ("occurrences", "records"), strict=True):
                np.add.at(counter, at[at >= 0], b.column(name).to_numpy()[at >= 0])
            light = b.filter(pa.array(at < 0))
            if light.num_rows:
                yield light.append_column("slot", pa.nulls(light.num_rows, pa.int32()))
        some = np.flatnonzero(counters[0])
        if len(some):
            none = pa.nulls(len(some), pa.string())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(counters[0, some]), pa.array(counters[1, some]), pa.array(some, pa.int32())], ["field_name", "term", "occurrences", "records", "slot"])

    parts = counts.mapInArrow(parted, "field_name string, term string, occurrences long, records long, slot int")
    total = parts.groupBy("slot", "field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    names = df.sparkSession.createDataFrame([(i, f, t) for (f, t), i in slots.items()], "slot int, f string, t string")
    named = total.join(F.broadcast(names), "slot", "left")
    return named.select(F.coalesce("field_name", "f").alias("field_name"), F.coalesce("term", "t").alias("term"), "occurrences", "records")


def marked(freq: DataFrame, total_records: int, rare_records: int = 2, common_percent: int = 30) -> DataFrame:
    """Adds ``mark``: ``rare`` for terms in at most ``rare_records`` records, ``common`` for those in at least
    ``common_percent`` % of all records, else ``useful``. A term of a tiny table that is both counts as rare."""
    mark = (
        F.when(F.col("records") <= rare_records, "rare")
        .when(F.col("records") * 100 >= F.lit(total_records) * common_percent, "common")
        .otherwise("useful")
    )
    return freq.withColumn("mark", mark)


def token_fields(names: Sequence[str] = ("must_match_tokens", "should_match_tokens", "surface_tokens")) -> dict[str, Column]:
    return {n: F.col(f"dedup_representation.{n}") for n in names}
