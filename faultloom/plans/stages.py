"""The three stages from crash folders to a scored clustering, each reading and writing files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import buckets as bk
from ..operators import cause_cards as cc
from ..operators import embeddings as em
from ..operators import features as ft
from ..operators import linkage as lk
from ..operators.cards import make_cards
from ..operators.prefetch import source_packets
from ..operators.quality import input_quality
from ..session import materialize
from ..sources import artifacts as ar
from ..sources import models, sinks

TASK = "Use the prompt contract above and produce a Cause Representation Card JSON. Retrieve source with the tools instead of guessing, follow the input quality's confidence cap, and output only valid JSON."


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def crash_card_stage(spark: SparkSession, root: str, out: str, ground_truth: str | None = None, limit_bugs: int | None = None, limit_crashes: int | None = None, resume: bool = False) -> DataFrame:
    """Crash folders to cards, buckets and the representative table under ``out``; returns the run's totals.

    With ``resume`` bugs whose cards are already there are not parsed again; their cards are read back.
    """
    raw = ar.crash_directories(spark, root, limit_bugs, limit_crashes)
    cards_path = f"{out}/crash_cards"
    if resume and _exists(spark, f"{out}/cards_parquet"):
        raw = ar.pending(raw, spark.read.parquet(f"{out}/cards_parquet").select(F.col("big_bucket").alias("bug_id")), ["bug_id"])
    made = bk.with_cluster_key(make_cards(raw))
    made.withColumn("bug_folder", F.col("big_bucket")).write.mode("append" if resume else "overwrite").partitionBy("bug_folder").parquet(f"{out}/cards_parquet")
    cards = spark.read.parquet(f"{out}/cards_parquet").drop("bug_folder")
    sinks.write_cards(cards.withColumn("bug_folder", F.col("big_bucket")), cards_path, "bug_folder")
    sinks.write_table(bk.bucket_summary(cards), f"{out}/cluster_summary", ["cluster_key", "size", "representative"])
    table = materialize(bk.representative_rows(cards, ar.ground_truth(spark, ground_truth), "row_order"), "stage1")
    chosen = table.select("cluster_key", F.col("cluster_representative_case_id").alias("case_id"), "small_bucket_cluster_id", "source_small_bucket")
    sinks.write_cards(cards.join(chosen, ["cluster_key", "case_id"]).withColumn("bug_folder", F.col("big_bucket")), f"{out}/representatives", "bug_folder")
    for name in ("representative_weights", "representative_manifest"):
        sinks.write_table(table, f"{out}/{name}", bk.REPRESENTATIVE_COLUMNS)
    sinks.write_task_list(table, f"{out}/cards_to_process")
    summary = bk.run_summary(cards, table)
    sinks.write_summary(summary, f"{out}/summary")
    return summary


def prompts(cards: DataFrame, lines: DataFrame | None, contract: str) -> DataFrame:
    """``task_id, prompt`` of cards: the contract, the task, input quality, source packet and card."""
    quality = input_quality(cards)
    packets = source_packets(cards, lines) if lines is not None else cards.select("case_id", F.lit("").alias("packet"))
    joined = quality.join(packets, "case_id", "left")
    own = F.to_json(F.struct(*[F.col(c) for c in cards.columns]))
    text = F.concat(F.lit(f"{contract}\n\n{TASK}\n\nInput quality:\n"), F.to_json("input_quality"), F.lit("\n\nPrefetched source packet:\n"), F.coalesce(F.nullif("packet", F.lit("")), F.lit("<none>")), F.lit("\n\nCrash card:\n"), own)
    return joined.select(F.col("case_id").alias("task_id"), text.alias("prompt"))


def cause_card_stage(spark: SparkSession, cards: DataFrame, out: str, contract: str = "", client: Callable[[], models.Client] | None = None, tool: Callable[[], models.Tool] | None = None, lines: DataFrame | None = None, limit: int | None = None, force: bool = False, parallelism: int | None = None) -> DataFrame:
    """Representative cards to normalized cause cards under ``out``; returns the manifest with each task's status.

    Finished cards are left out unless ``force``; a limit counts them too. Without a client it is a dry run: only the manifest is
    made. The ``contract`` is the text of :func:`models.load_prompt`. Answers without JSON go to ``out/unreadable`` and can be asked for again.
    """
    tasks = cards.orderBy("cluster_key").limit(limit) if limit is not None else cards
    path = f"{out}/cause_cards"
    done = spark.read.json(path).select(F.col("source_crash_id").alias("case_id")) if _exists(spark, path) else spark.createDataFrame([], "case_id string")
    open_tasks = tasks if force else ar.pending(tasks, done, ["case_id"])
    if client is not None:
        asked = prompts(open_tasks, lines, contract)
        results = materialize(models.answers(asked, client, tool or (lambda: lambda name, args: "{}"), parallelism), "stage2")
        bad = results.filter("status <> 'ok'")
        sinks.write_summary(models.status_counts(results), f"{out}/status_counts")
        sinks.audit_rows(bad).write.mode("append").parquet(f"{out}/unreadable")
        good = results.filter("status = 'ok'").select(F.col("task_id").alias("case_id"), cc.extract_json(F.col("content")).alias("raw"), F.parse_json("tool_trace").alias("tool_trace"))
        named = open_tasks.join(good, "case_id").withColumns({"hash_part": F.right("cluster_key", F.lit(8)), "small_bucket_id": F.col("cluster_key")})
        cards_out = cc.normalize_cause_cards(named)
        flat = cards_out.withColumn("lockdep_context", F.to_json("lockdep_context"))
        flat.withColumn("bug_folder", F.col("source_bucket")).write.mode("append").partitionBy("bug_folder").json(path)
        done = done.unionByName(results.filter("status = 'ok'").select(F.col("task_id").alias("case_id")))
    listed = ar.manifest(tasks.select("cluster_key", "case_id"), done, ["case_id"])
    sinks.write_table(listed, f"{out}/manifest", ["cluster_key", "case_id", "exists"])
    return listed


def clustering_stage(spark: SparkSession, weights: DataFrame, causes: DataFrame, out: str, service: Callable[[], em.Embedder] | None = None, model: str = "hashed", dims: int = 64, cache: str | None = None, block: str | None = None, dry_run: bool = False) -> DataFrame | None:
    """Weighted cause cards to vectors, grid, selection and scores under ``out``; returns the selected row per block.

    ``weights`` and ``causes`` share ``source_crash_id``. Embeddings already in ``cache`` are not asked for again. The choice of threshold
    sees no labels; the one by F is written as a diagnostic. A dry run ends with features and their summary.
    """
    records = ft.build_records(weights, causes.drop(*[c for c in weights.columns if c in causes.columns and c != "source_crash_id"]), ["source_crash_id"])
    rows = materialize(ft.final_fields(ft.token_fields(records)).withColumn("true_label", F.col("final_ground_truth_id")), "stage3-features")
    kept = rows.select("record_id", "true_label", "weight", "unique_case_count", "cause_card_id", "cause_card_key", "source_crash_id", "copied_file_name", "fields", "field_texts", "all_text", "stats", *([block] if block else []))
    sinks.write_json_lines(kept, f"{out}/features")
    sinks.write_summary(ft.feature_summary(kept), f"{out}/feature_summary")
    if dry_run:
        return None
    cache_path = cache or f"{out}/embedding_cache"
    have = spark.read.schema(em.CACHE).parquet(cache_path) if _exists(spark, cache_path) else spark.createDataFrame([], em.CACHE)
    missing = em.cache_misses(em.field_texts_long(kept, "record_id", ft.FINAL_FIELDS), have, model)
    em.embed_missing(missing, service or (lambda: em.hashed_embedder(dims)), model).write.mode("append").parquet(cache_path)
    vectors = materialize(em.record_vectors(kept, spark.read.schema(em.CACHE).parquet(cache_path), ft.FINAL_FIELDS, model, dims), "stage3-vectors")
    em.check_vectors(kept, vectors)
    sinks.write_vectors(vectors, out, {"model": model, "dims": dims, "fields": ft.FINAL_FIELDS})
    placed = vectors.join(kept.select("record_id", block), "record_id") if block else vectors
    grid = materialize(lk.threshold_grid(placed, block), "stage3-grid")
    scored = materialize(lk.with_external_metrics(grid, kept.select("record_id", "true_label", "weight")), "stage3-scores")
    selected, diagnostic = lk.select_by_silhouette(scored), lk.select_by_f_measure(scored)
    assignments = lk.grid_assignments(grid).join(kept.select("record_id", "true_label", "weight", "cause_card_id", "source_crash_id", "copied_file_name"), "record_id")
    sinks.write_clustering(scored, selected, diagnostic, assignments, out)
    return selected
