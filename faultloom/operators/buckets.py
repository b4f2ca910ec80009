"""Exact signature buckets, their representatives, labels and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Columns of the representative table, in order.
REPRESENTATIVE_COLUMNS = [
    "final_ground_truth_id", "directory_name", "copied_file_name", "cause_card_key", "cause_card_id", "cause_card_file_stem", "source_bug_id",
    "source_small_bucket", "source_crash_id", "small_bucket_cluster_id", "cluster_key", "cluster_representative_case_id", "unique_case_count",
    "member_ref_count", "represented_crash_row_count", "duplicate_row_count", "ndss_patch", "cause_card_file", "copied_target_file",
]


def with_cluster_key(cards: DataFrame) -> DataFrame:
    """Adds ``cluster_key``: bug and signature hash."""
    return cards.withColumn("cluster_key", F.concat_ws("::", "big_bucket", "layer2_signature_hash"))


def _size(cards: DataFrame, path: str) -> Column:
    """Entries of a nested list; null lists, null structs and columns that the table lacks count 0."""
    return F.greatest(F.size(F.col(path)), F.lit(0)) if _has(cards, path) else F.lit(0)


def _has(df: DataFrame, path: str) -> bool:
    kind = df.schema
    for part in path.split("."):
        if not hasattr(kind, "fieldNames") or part not in kind.fieldNames():
            return False
        kind = kind[part].dataType
    return True


def representative_score(cards: DataFrame) -> Column:
    """Seven numbers that rank cards as representatives: reproducers, trigger tokens, lock bridge, lock chain, sanitizer frames, stack."""
    flag = lambda p: F.coalesce(F.col(p), F.lit(False)).cast("int")
    n = lambda p: _size(cards, p)
    bridge = "lockdep_context.bpf_tracepoint_bridge"
    return F.struct(
        flag("repro.has_syz_repro").alias("syz"),
        flag("repro.has_c_repro").alias("c"),
        n("reproducer_semantics.semantic_tokens").alias("tokens"),
        (n(f"{bridge}.bpf_frames") + n(f"{bridge}.map_operations")).alias("bridge"),
        n("lockdep_context.existing_dependency_chain").alias("chain"),
        (n("sanitizer_context.alloc_trace") + n("sanitizer_context.free_trace") + n("sanitizer_context.origin_trace")).alias("sanitizer"),
        n("stack_semantic").alias("stack"),
    )


def exact_buckets(cards: DataFrame) -> DataFrame:
    """``cluster_key, size, first_case``: buckets of equal signature with the number of cards and the first case id.

    Only counts and minima cross the shuffle, pre-aggregated by task, so a bucket may hold any share of the rows.
    """
    return cards.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("size"), F.min("case_id").alias("first_case"))


def bucket_members(cards: DataFrame) -> DataFrame:
    """``cluster_key, case_id, position``: members in the order of their case ids, one row each rather than one list.

    Rows are sorted by ranges of key and case over all tasks; a member's position is its place in its range behind the
    members of the ranges before, so a bucket of any size is numbered by many tasks. The ranges are written first, as they come
    from samples that another run of a task might not draw again.
    """
    ranged = cards.select("cluster_key", "case_id").repartitionByRange("cluster_key", "case_id").withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "bucket-members")
    counts = ranged.groupBy("cluster_key", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("cluster_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(F.struct("cluster_key").alias("_key"), "_part", F.coalesce(earlier, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("cluster_key", "_part").orderBy("case_id"))
    placed = ranged.withColumn("_own", own).withColumn("_key", F.struct("cluster_key")).join(before, ["_key", "_part"])
    return placed.select("cluster_key", "case_id", (F.col("_before") + F.col("_own")).cast("int").alias("position"))


def bucket_summary(cards: DataFrame, row_id: str | None = None) -> DataFrame:
    """Buckets with size and the title, class, function and anchor of their first case; of several cards of that case the one with the smallest ``row_id``."""
    info = F.struct("case_id", "title", "bug", F.col("fault.primary_function").alias("primary_func"), F.col("anchor_trace").alias("anchor"))
    first = F.struct("case_id", row_id) if row_id else F.col("case_id")
    return cards.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("size"), F.min_by(info, first).alias("representative"))


def bucket_ordinals(buckets: DataFrame) -> DataFrame:
    """Adds ``bug_id``, ``idx`` (1, 2, ... per bug in key order), ``small_bucket`` (idx with three digits or more) and ``hash8``."""
    bug = F.substring_index("cluster_key", "::", 1)
    named = buckets.withColumn("bug_id", bug).withColumn("idx", F.row_number().over(Window.partitionBy(bug).orderBy("cluster_key")))
    hash8 = F.right(F.col("cluster_key"), F.lit(8))
    return named.withColumn("hash8", hash8).withColumn("small_bucket", F.format_string("%03d", "idx"))


def representatives(cards: DataFrame, row_id: str | None = None) -> DataFrame:
    """The best-scored card of each bucket; ties go to the smallest case id, then the smallest ``row_id``.

    ``row_number() = 1`` is applied in every task before the shuffle too, and only keys and scores are shuffled when the
    rest of the card is joined back by id.
    """
    order = [F.col("score").desc(), F.col("case_id").asc(), *([F.col(row_id).asc()] if row_id else [])]
    scored = cards.withColumn("score", representative_score(cards))
    return scored.withColumn("_r", F.row_number().over(Window.partitionBy("cluster_key").orderBy(*order))).filter("_r = 1").drop("_r")


def best_of_case(cards: DataFrame, row_id: str) -> DataFrame:
    """The best-scored card of each case, ranked as :func:`representatives`; ties go to the smallest ``row_id``."""
    scored = cards.withColumn("_score", representative_score(cards))
    first = Window.partitionBy("case_id").orderBy(F.col("_score").desc(), F.col(row_id).asc())
    return scored.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r", "_score")


def label_counts(labels: DataFrame) -> DataFrame:
    """``bug_id, case_id, rows``: label rows per case."""
    return labels.groupBy("bug_id", "case_id").agg(F.count(F.lit(1)).alias("rows"))


def represented_weight(cards: DataFrame, labels: DataFrame) -> DataFrame:
    """``cluster_key, unique_cases, members, represented_rows``: label rows that a bucket's members stand for.

    A case without label rows counts as one row. Labels are counted per case before the join.
    """
    counted = label_counts(labels)
    joined = cards.select("cluster_key", F.col("big_bucket").alias("bug_id"), "case_id").join(counted, ["bug_id", "case_id"], "left")
    return joined.groupBy("cluster_key").agg(F.countDistinct("case_id").alias("unique_cases"), F.count(F.lit(1)).alias("members"), F.sum(F.coalesce("rows", F.lit(1))).alias("represented_rows"))


def label_vote(cards: DataFrame, labels: DataFrame, row_order: str) -> DataFrame:
    """``cluster_key, label, votes``: the label with most rows among a bucket's members.

    Of equal ones the label seen first wins: by member case id, then by ``row_order`` of the label rows. Null and
    empty labels do not vote; a bucket without votes has no row.
    """
    per_case = labels.filter(F.coalesce("final_ground_truth_id", F.lit("")) != "").groupBy("bug_id", "case_id", F.col("final_ground_truth_id").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min(row_order).alias("at"))
    joined = cards.select("cluster_key", F.col("big_bucket").alias("bug_id"), "case_id").join(per_case, ["bug_id", "case_id"])
    votes = joined.groupBy("cluster_key", "label").agg(F.sum("n").alias("votes"), F.min(F.struct("case_id", "at")).alias("first"))
    best = F.row_number().over(Window.partitionBy("cluster_key").orderBy(F.desc("votes"), "first", "label"))
    return votes.withColumn("_r", best).filter("_r = 1").select("cluster_key", "label", "votes")


def representative_rows(cards: DataFrame, labels: DataFrame, row_order: str, row_id: str | None = None, cards_root: str = "outputs/stage1_crash_cards", causes_root: str = "outputs/stage2_cause_cards") -> DataFrame:
    """The representative table: one row per bucket with label, names, counts and weights, columns in their fixed order."""
    best = representatives(cards, row_id).select("cluster_key", F.col("case_id").alias("rep_case"))
    named = bucket_ordinals(exact_buckets(cards).select("cluster_key"))
    joined = best.join(named, "cluster_key").join(represented_weight(cards, labels), "cluster_key").join(label_vote(cards, labels, row_order), "cluster_key", "left")
    label = F.coalesce("label", F.lit(""))
    file = F.concat_ws("__", "small_bucket", F.concat("hash8", F.lit(".json")))
    columns = {
        "final_ground_truth_id": label,
        "directory_name": F.replace(label, F.lit(":"), F.lit("__")),
        "copied_file_name": F.concat_ws("__", "bug_id", file),
        "cause_card_key": F.concat_ws("/", "bug_id", "hash8"),
        "source_bug_id": F.col("bug_id"),
        "source_small_bucket": F.col("small_bucket"),
        "source_crash_id": F.col("rep_case"),
        "cluster_representative_case_id": F.col("rep_case"),
        "unique_case_count": F.col("unique_cases").cast("int"),
        "member_ref_count": F.col("members").cast("int"),
        "represented_crash_row_count": F.col("represented_rows").cast("int"),
        "duplicate_row_count": (F.col("represented_rows") - F.col("unique_cases")).cast("int"),
        "ndss_patch": F.when(label.startswith("ndss:"), F.regexp_replace(label, "^[^:]*:", "")).otherwise(""),
        "cause_card_file": F.concat_ws("/", F.lit(causes_root), "bug_id", F.concat("hash8", F.lit(".json"))),
        "copied_target_file": F.concat_ws("/", F.lit(cards_root), "bug_id", F.lit("crash_cards/small_bucket_rep"), file),
    }
    return joined.select(*[columns.get(c, F.col("cluster_key" if c == "cluster_key" else "hash8")).alias(c) for c in REPRESENTATIVE_COLUMNS])


def run_summary(cards: DataFrame, representative_table: DataFrame) -> DataFrame:
    """One row: bugs, distinct cases, represented rows, representatives and distinct non-empty labels."""
    left = cards.agg(F.countDistinct("big_bucket").alias("bugs"), F.countDistinct("big_bucket", "case_id").alias("unique_cases"))
    right = representative_table.agg(
        F.coalesce(F.sum("represented_crash_row_count"), F.lit(0)).alias("represented_rows"),
        F.count(F.lit(1)).alias("representatives"),
        F.countDistinct(F.nullif("final_ground_truth_id", F.lit(""))).alias("labels"),
    )
    return left.crossJoin(F.broadcast(right))
