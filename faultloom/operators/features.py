"""Cause cards as token fields: eleven ordered lists, of which six are kept for comparison."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.text import format_field, no_strings, ordered_unique

FIELDS = ["primary_root", "must", "object", "invariant", "patch", "propagation", "should", "surface", "weak", "evidence", "negative"]
FINAL_FIELDS = ["object", "invariant", "propagation", "patch", "must", "should"]
TYPED_FIELDS = ["object", "invariant", "propagation", "patch"]
#: Which leads of must tokens also count for which field, and which roles mark a root.
LEADS = {"object": ["object:", "field:", "struct:"], "invariant": ["invariant:", "condition:", "state:", "violation:"], "patch": ["patch_shape:", "fix_shape:"]}
ROOT_ROLES = ["candidate_root_signal", "candidate_root_cause", "proximal_signal"]
RULE = "typed object/invariant/propagation/patch tokens are removed from must/should when identical"


def _type_at(df: DataFrame, path: str) -> T.DataType | None:
    kind: T.DataType = df.schema
    for part in path.split("."):
        if isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
            return None
        kind = kind[part].dataType
    return kind


class _Card:
    """Members of a cause card table; what the table lacks counts as null or empty."""

    def __init__(self, df: DataFrame):
        self.df = df

    def strings(self, path: str) -> Column:
        return F.coalesce(F.col(path).cast("array<string>"), no_strings()) if isinstance(_type_at(self.df, path), T.ArrayType) else no_strings()

    def value(self, path: str, kind: str = "string") -> Column:
        return F.col(path).cast(kind) if _type_at(self.df, path) is not None else F.lit(None).cast(kind)

    def each(self, path: str, test, build) -> Column:
        """Texts built from each entry of a list that passes a test; ``build`` gives an array of texts."""
        kind = _type_at(self.df, path)
        if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
            return no_strings()  # also where an inferred schema knows only empty lists
        have = set(kind.elementType.fieldNames())
        get = lambda e: lambda k: e[k].cast("string") if k in have else F.lit(None).cast("string")
        kept = F.filter(F.col(path), lambda e: e.isNotNull() & F.coalesce(test(get(e)), F.lit(False)))
        return F.coalesce(F.flatten(F.transform(kept, lambda e: F.filter(build(get(e)), lambda x: x.isNotNull() & (x != "")))), no_strings())


# The cards' texts are folded before they come here, see _folded_card.
def canonical_token(x: Column) -> Column:
    return tx.canonical_token(x, False)


def ascii_clean(x: Column) -> Column:
    return tx.ascii_clean(x, False)


def compact_sentence(label: str, x: Column) -> Column:
    return tx.compact_sentence(label, x, False)


#: Sections whose texts become tokens, and members in them that are compared as they stand.
SECTIONS = ["dedup_representation", "root_cause_signals", "invariant_signals", "propagation_signals", "patch_semantics_hypotheses", "hypotheses", "evidence_ledger", "crash_surface", "reproducer_semantics", "negative_evidence"]
AS_THEY_STAND = {"dedup_weight", "evidence_level", "stability", "dedup_usable", "surface_is_root_candidate"}


@F.pandas_udf(T.StringType())
def _folded_json(cards: pd.Series) -> pd.Series:
    def walk(v: object) -> object:
        if isinstance(v, dict):
            return {k: x if k in AS_THEY_STAND else walk(x) for k, x in v.items()}
        return [walk(x) for x in v] if isinstance(v, list) else tx._fold(v) if isinstance(v, str) else v

    return cards.map(lambda c: json.dumps(walk(json.loads(c))), na_action="ignore")


def _folded_card(df: DataFrame) -> DataFrame:
    """The sections of cards that have non-ASCII characters with all their texts folded; other cards are not touched."""
    have = [c for c in SECTIONS if c in df.columns]
    if not have:
        return df
    whole = F.to_json(F.struct(*have))
    df = df.withColumn("_json", F.when(~whole.rlike(r"^\p{ASCII}*$"), whole)).withColumn("_json", _folded_json(F.col("_json")))
    schema = T.StructType([df.schema[c] for c in have])
    df = df.withColumn("_card", F.from_json("_json", schema))
    return df.withColumns({c: F.when(F.col("_json").isNotNull(), F.col(f"_card.{c}")).otherwise(F.col(c)) for c in have}).drop("_json", "_card")


def _weighty(g) -> Column:
    return g("dedup_weight").isin("high", "medium")


def _known(g) -> Column:
    return g("evidence_level").isin("direct", "indirect")


def signal_field(type_: Column, role: Column) -> Column:
    """The field a root signal counts for, by its type, else its role; both are ASCII or folded."""
    t, r = canonical_token(type_), canonical_token(role)
    return (
        F.when(t.isin("object", "field", "struct", "member"), "object")
        .when(t.isin("fix_shape", "patch_shape") | t.contains("patch"), "patch")
        .when(t.isin("state", "condition", "constraint", "invariant"), "invariant")
        .when(t.isin("lifetime", "propagation", "flow"), "propagation")
        .when(r.isin(ROOT_ROLES), "must")
        .otherwise("should")
    )


def token_fields(df: DataFrame) -> DataFrame:
    """Adds ``fields``, a struct of the eleven token lists of each card.

    Lists are filled section by section in a fixed order, since only the first of equal tokens is kept; tokens and
    sentences are canonicalised (folded to ASCII first). Weak, speculative and unstable evidence is filtered out on the way.
    """
    given = {n: df[n] for n in SECTIONS if n in df.columns}
    df = _folded_card(df.withColumns({f"_given_{n}": c for n, c in given.items()}))
    c = _Card(df)
    rep = lambda k: c.strings(f"dedup_representation.{k}")
    must = rep("must_match_tokens")
    led = lambda field: F.filter(F.transform(must, lambda t: canonical_token(t)), lambda t: t.rlike("^(?:" + "|".join(LEADS[field]) + ")"))
    signals = "root_cause_signals"
    token = lambda g: F.coalesce(F.when(g("normalized_token") != "", g("normalized_token")), g("name"))
    stable = lambda g: F.coalesce(g("stability") == "stable", F.lit(False))
    goes = lambda field: c.each(signals, lambda g: _weighty(g) & stable(g) & (signal_field(g("signal_type"), g("role")) == field), lambda g: F.array(token(g)))
    # Unstable signals count as should tokens, in turn with stable ones that go there.
    to_should = c.each(signals, lambda g: _weighty(g) & (~stable(g) | (signal_field(g("signal_type"), g("role")) == "should")), lambda g: F.array(token(g)))
    roots = c.each(signals, lambda g: _weighty(g) & stable(g) & g("role").isin(ROOT_ROLES), lambda g: F.array(token(g)))
    why = c.each(signals, lambda g: _weighty(g) & stable(g), lambda g: F.array(compact_sentence("root_signal", g("why_related"))))
    invariants = c.each("invariant_signals", lambda g: _weighty(g) & _known(g), lambda g: F.array(compact_sentence("expected", g("expected")), compact_sentence("violation", g("observed_or_suspected_violation"))))
    clean = ascii_clean
    flows = c.each("propagation_signals", lambda g: _weighty(g) & ((clean(g("from")) != "") | (clean(g("to")) != "")), lambda g: F.array(F.concat(F.lit("flow:"), clean(g("from")), F.lit("->"), clean(g("to")), F.lit(" via "), clean(g("mechanism")))))
    patches = c.each("patch_semantics_hypotheses", lambda g: _weighty(g) & (canonical_token(g("confidence")) != "low"), lambda g: F.array(compact_sentence("patch_shape", g("shape")), compact_sentence("patch_target", g("target")), compact_sentence("patch_summary", g("summary"))))
    guesses = c.each("hypotheses", lambda g: (g("dedup_usable") == "true") & canonical_token(g("confidence")).isin("high", "medium"), lambda g: F.array(compact_sentence("hypothesis", g("summary"))))
    ledger = c.each("evidence_ledger", lambda g: _weighty(g) & _known(g), lambda g: F.array(compact_sentence("evidence", g("content_summary")), F.when(g("dedup_weight") == "high", compact_sentence("location", g("location")))))
    s = lambda label, path: F.array(compact_sentence(label, c.value(f"crash_surface.{path}")))
    surface = [s("surface_sanitizer", "sanitizer"), s("surface_bug_type", "bug_type"), s("surface_operation", "crash_operation"), s("surface_function", "crash_point.function"), s("surface_file", "crash_point.file")]
    candidate = F.when(c.value("crash_surface.surface_is_root_candidate", "boolean"), s("surface_root_candidate", "crash_operation")).otherwise(no_strings())
    tag = lambda lead, k: F.transform(c.strings(f"reproducer_semantics.{k}"), lambda x: F.concat(F.lit(lead), x))
    weak = [tag("syscall:", "syscalls"), c.strings("reproducer_semantics.semantic_tokens"), tag("socket_op:", "socket_ops"), tag("bpf_helper:", "bpf_helpers"), tag("tracepoint:", "tracepoints")]
    against = c.each("negative_evidence", lambda g: canonical_token(g("conflict_strength")).isin("high", "medium"), lambda g: F.array(compact_sentence("do_not_merge_with", g("claim"))))
    parts = {
        "primary_root": [rep("primary_root_tokens"), roots],
        "must": [must, goes("must")],
        "object": [led("object"), goes("object")],
        "invariant": [led("invariant"), goes("invariant"), invariants],
        "patch": [led("patch"), goes("patch"), patches],
        "propagation": [rep("bridge_tokens"), goes("propagation"), flows],
        "should": [rep("should_match_tokens"), to_should, candidate],
        "surface": [rep("surface_tokens"), *surface],
        "weak": [rep("weak_context_tokens"), *weak],
        "evidence": [why, guesses, ledger],
        "negative": [rep("must_not_match_conditions"), against],
    }
    df = df.withColumn("fields", F.struct(*[ordered_unique(F.concat(*parts[f]), False).alias(f) for f in FIELDS]))
    return df.withColumns({n: F.col(f"_given_{n}") for n in given}).drop(*[f"_given_{n}" for n in given])


def final_fields(df: DataFrame) -> DataFrame:
    """Replaces ``fields`` by the six final lists and adds their texts, the whole text and counts.

    Tokens that a typed list has are taken out of must and should; must and should may share tokens.
    """
    f = F.col("fields")
    covered = F.array_distinct(F.concat(*[f[k] for k in TYPED_FIELDS]))
    lists = {k: f[k] if k in TYPED_FIELDS else F.array_except(f[k], covered) for k in FINAL_FIELDS}
    df = df.withColumn("fields", F.struct(*[lists[k].alias(k) for k in FINAL_FIELDS]))
    df = df.withColumn("field_texts", F.struct(*[format_field(k, F.col(f"fields.{k}"), False).alias(k) for k in FINAL_FIELDS]))
    texts = F.array(*[F.col(f"field_texts.{k}") for k in FINAL_FIELDS])
    counts = F.struct(*[F.size(F.col(f"fields.{k}")).alias(k) for k in FINAL_FIELDS])
    stats = F.struct(counts.alias("field_token_counts"), F.array(*[F.lit(k) for k in FINAL_FIELDS]).alias("final_fields"), F.lit(RULE).alias("deduplication_rule"))
    return df.withColumn("all_text", F.array_join(F.filter(texts, lambda t: t != ""), "\n\n")).withColumn("stats", stats)


def build_records(weights: DataFrame, cards: DataFrame, key: list[str]) -> DataFrame:
    """Weight rows joined to their cause cards, with ``record_id``, ``weight`` and ``unique_case_count`` as numbers.

    A missing weight counts as 1 (``"0"`` stays 0), missing cases as the weight. Fails, naming up to ten, if rows
    have no card.
    """
    missing = weights.join(cards, key, "left_anti").select(F.concat_ws("/", *key).alias("k")).limit(11).collect()
    if missing:
        raise ValueError(f"cause cards are missing for {'10 or more' if len(missing) > 10 else len(missing)} rows, first: {', '.join(r['k'] for r in missing[:10])}")
    number = lambda c: F.nullif(F.col(c), F.lit("")).try_cast("double")
    weight = F.coalesce(number("represented_crash_row_count"), F.lit(1.0))
    cases = F.coalesce(number("unique_case_count"), number("represented_crash_row_count"), F.lit(1.0))
    return weights.withColumns({"weight": weight, "unique_case_count": cases, "record_id": F.concat_ws("/", F.coalesce("directory_name", F.lit("")), F.coalesce("copied_file_name", F.lit("")))}).join(cards, key)


def feature_summary(rows: DataFrame) -> DataFrame:
    """One row: records, distinct labels, total weight and, per final field, the records in which it is not empty."""
    filled = [F.count_if(F.size(F.col(f"fields.{k}")) > 0).alias(f"nonempty_{k}") for k in FINAL_FIELDS]
    return rows.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("true_label").alias("labels"), F.sum("weight").alias("total_weight"), *filled)
