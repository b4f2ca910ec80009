"""Queries of sinks, sources, model runs and packets: whole tables written, read back or led through a stub, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import buckets as bk
from ..operators import cause_cards as cc
from ..operators import embeddings as em
from ..operators import prefetch as pf
from ..session import scratch
from ..sources import artifacts as ar
from ..sources import models, sinks
from ..sources.tables import table
from . import catalog as base
from . import parsing as ps

QUERIES, SQL = {}, {}
query = base.registrar(QUERIES, SQL)


@query("SELECT card_id, case_id, cluster_key, big_bucket, fault.primary_function AS func, len(stack_semantic) AS frames FROM crash_cards")
def written_cards(spark: SparkSession, d: str) -> DataFrame:
    """Crash cards written as JSON by bug and read back."""
    path = scratch(spark, "cards")
    cards = table(spark, d, "crash_cards", "card_id", "case_id", "cluster_key", "big_bucket", "fault", "stack_semantic").withColumn("bug_folder", F.col("big_bucket"))
    sinks.write_cards(cards, path, "bug_folder")
    back = spark.read.schema(cards.drop("bug_folder").schema).json(f"{path}/*")
    return back.select("card_id", "case_id", "cluster_key", "big_bucket", F.col("fault.primary_function").alias("func"), F.when(F.col("stack_semantic").isNotNull(), F.size("stack_semantic")).cast("long").alias("frames"))


@query("""SELECT cluster_key, size::VARCHAR AS size, first_case, title FROM (SELECT cluster_key, count(*) OVER (PARTITION BY cluster_key) AS size, case_id AS first_case, coalesce(title, '') AS title,
  row_number() OVER (PARTITION BY cluster_key ORDER BY case_id, card_id) AS r FROM crash_cards) WHERE r = 1""")
def written_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The summary of every bucket written as CSV, its first case as JSON, and read back."""
    path = scratch(spark, "summaries")
    cards = table(spark, d, "crash_cards", "cluster_key", "case_id", "card_id", "title", "bug", "fault", "anchor_trace")
    sinks.write_table(bk.bucket_summary(cards, "card_id"), path, ["cluster_key", "size", "representative"])
    first = F.from_json("representative", "case_id string, title string")
    return ar.csv_table(spark, path).select("cluster_key", "size", first["case_id"].alias("first_case"), F.coalesce(first["title"], F.lit("")).alias("title"))


@query(f"""SELECT path FROM (SELECT trim(unnest(regexp_split_to_array(copied_target_file, '\\r\\n|\\r|\\n')), ' ') AS path FROM ({base._WEIGHTS_TABLE})) WHERE path <> '' AND NOT starts_with(path, '#')""")
def written_task_list(spark: SparkSession, d: str) -> DataFrame:
    """The list of representatives' cards, written and read back line by line (odd names may hold line ends)."""
    path = scratch(spark, "tasks")
    sinks.write_task_list(base.representative_weights(spark, d), path)
    return ar.task_list(spark, path)


@query("SELECT vec_id, len(vector) AS dims, round(list_sum(vector::DOUBLE[]), 4) AS total, 'm' AS model FROM vectors WHERE vector IS NOT NULL")
def written_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with their description, written and read back."""
    path = scratch(spark, "vectors")
    sinks.write_vectors(table(spark, d, "vectors", "vec_id", "vector").filter("vector IS NOT NULL"), path, {"model": "m", "dims": 96})
    meta = ar.json_lines(spark, f"{path}/vectorizer_meta").select(F.try_variant_get("doc", "$.model", "string").alias("model"))
    back = spark.read.parquet(f"{path}/vectors")
    return back.crossJoin(F.broadcast(meta)).select("vec_id", F.size("vector").cast("long").alias("dims"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"), "model")  # one row of meta


@query("""SELECT which, record_id, pred_cluster FROM (SELECT 'selected' AS which, record_id, (vec_id % 3)::VARCHAR AS pred_cluster, vec_id FROM vectors UNION ALL SELECT 'oracle_diagnostic', record_id, (vec_id % 5)::VARCHAR, vec_id FROM vectors)""")
def written_clustering(spark: SparkSession, d: str) -> DataFrame:
    """Assignments of the selected and of the diagnostic threshold, written with grid and summary and read back."""
    path = scratch(spark, "clustering")
    v = table(spark, d, "vectors", "vec_id", "record_id", "true_label", "weight", "cause_card_id")
    cut = lambda t, k: v.select(F.lit("").alias("block"), F.lit(t).alias("distance_threshold"), "record_id", "true_label", (F.col("vec_id") % k).cast("int").alias("pred"), "weight", "cause_card_id")
    grid = spark.createDataFrame([("", 0.2, 3), ("", 0.4, 5)], "block string, distance_threshold double, cluster_count_internal int")
    sinks.write_clustering(grid, grid.filter("distance_threshold < 0.3"), grid.filter("distance_threshold > 0.3"), cut(0.2, 3).unionByName(cut(0.4, 5)), path)
    read = lambda name: ar.csv_table(spark, f"{path}/assignments_{name}").select(F.lit(name).alias("which"), "record_id", "pred_cluster")
    return read("selected").unionByName(read("oracle_diagnostic"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'json_parse_failed' ELSE 'ok' END AS status, left(sha256(left(coalesce(text, ''), 4000)), 16) AS preview FROM documents")
def audited_answers(spark: SparkSession, d: str) -> DataFrame:
    """Results of a run as rows of the table for debugging."""
    results = base._documents(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, "json_parse_failed").otherwise("ok").alias("status"), F.col("text").alias("content"))
    return sinks.audit_rows(results).select("doc_id", "status", tx.sha16(F.col("last_content_preview")).alias("preview"))


def _stub():
    def reply(messages: list[dict], tools: bool) -> dict:
        prompt = messages[0]["content"] if messages else ""
        if "mutex" in prompt and tools and len(messages) < 3:
            return {"content": "", "tool_calls": [{"id": "1", "name": "code_searcher_grep", "args": {"pattern": "x"}}]}
        return {"content": "no answer" if "spin" in prompt else '{"cause_id": "c"}'}

    return reply


@query("SELECT status, count(*) AS count FROM (SELECT CASE WHEN contains(coalesce(text, ''), 'spin') THEN 'json_parse_failed' ELSE 'ok' END AS status FROM documents) GROUP BY status")
def model_run(spark: SparkSession, d: str) -> DataFrame:
    """Results per status of a run over every text with a stub in the model's place."""
    tasks = base._documents(spark, d).select(F.col("doc_id").cast("string").alias("task_id"), F.coalesce("text", F.lit("")).alias("prompt"))
    return models.status_counts(models.answers(tasks, _stub, lambda: lambda name, args: "found nothing"))


@query(f"""WITH k AS (SELECT DISTINCT {base._KEY} AS cache_key, length(text)::FLOAT AS a, (length(text) - length(replace(text, ' ', '')))::FLOAT AS b FROM documents WHERE {base._strip('text')} <> '')
SELECT cache_key, 2 AS dim, a AS length, b AS blanks FROM k""")
def embedded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Cache entries of all distinct texts, from a stub that counts characters and blanks."""
    service = lambda: lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]
    empty = spark.createDataFrame([], em.CACHE)
    made = em.embed_missing(em.cache_misses(table(spark, d, "documents", "text"), empty, "m"), service, "m")
    return made.select("cache_key", "dim", F.get("vector", F.lit(0)).alias("length"), F.get("vector", F.lit(1)).alias("blanks"))


_NUMBERED = "string_agg(printf('%s%5d: %s', CASE WHEN lineno = {at} THEN '{mark}' ELSE '{none}' END, lineno, line), chr(10) ORDER BY lineno)"


@query(f"""WITH {ps._WRAPPED}, {ps._BOUNDS}
SELECT path, 'probe_doc' AS symbol, left(sha256(path || ':6..' || e || chr(10) || {_NUMBERED.format(at=6, mark='>', none=' ')}), 16) AS body FROM lines JOIN bounds USING (path) WHERE lineno BETWEEN 1 AND e + 8 GROUP BY path, e
UNION ALL SELECT path, 'nobody', left(sha256(path || ':9' || chr(10) || {_NUMBERED.format(at=9, mark='=> ', none='   ')}), 16) FROM lines WHERE lineno BETWEEN 1 AND 89 GROUP BY path""")
def function_texts(spark: SparkSession, d: str) -> DataFrame:
    """What is shown of two frames of every file: a function, and the lines around a place whose function is not found."""
    lines = ps._wrapped(spark, d)
    frames = lines.select("path").distinct().select("path", F.inline(F.array(F.struct(F.lit("probe_doc").alias("symbol"), F.lit(8).alias("around")), F.struct(F.lit("nobody").alias("symbol"), F.lit(9).alias("around")))))
    return pf.function_texts(lines, frames).select("path", "symbol", tx.sha16(F.col("body")).alias("body"))


@query(f"""WITH {ps._WRAPPED}, {ps._BOUNDS} SELECT path AS case_id, 'Domain scope hint: ' || path || '/' AS hint,
  left(sha256({base._strip("'Primary Function: probe_doc' || chr(10) || path || ':6..' || e || chr(10) || " + _NUMBERED.format(at=6, mark='>', none=' '))}), 16) AS function FROM lines JOIN bounds USING (path) WHERE lineno BETWEEN 1 AND e + 8 GROUP BY path, e""")
def source_packets(spark: SparkSession, d: str) -> DataFrame:
    """The packet of a card for every file: the note on its domain and the section of its primary function."""
    lines = ps._wrapped(spark, d)
    frame = F.struct(F.lit("probe_doc").alias("func"), F.col("path").alias("file"), F.lit(8).alias("line"), F.lit(False).alias("inline"), F.lit("probe_doc").alias("raw"))
    cards = lines.select("path").distinct().select(F.col("path").alias("case_id"), F.struct(F.lit("probe_doc").alias("primary_function"), F.col("path").alias("primary_file")).alias("fault"), F.array(frame).alias("stack_semantic"), F.array(frame).alias("stack_raw"))
    packets = pf.source_packets(cards, lines, budget=1 << 30)
    own = F.regexp_replace(F.substring_index("packet", "\n## Primary Function: ", -1), r"(?U)\s+$", "")
    return packets.select("case_id", F.regexp_extract("packet", r"(?m)^(Domain scope hint: .*)$", 1).alias("hint"), tx.sha16(F.concat(F.lit("Primary Function: "), own)).alias("function"))


@query(f"""SELECT card_id, CASE WHEN card_id % 2 = 0 THEN 'own' ELSE coalesce(nullif(bug.sanitizer, ''), 'OTHER') END AS sanitizer, CASE WHEN card_id % 2 = 0 THEN 'own type' ELSE coalesce(nullif(bug.bug_type, ''), '') END AS bug_type,
  CASE WHEN card_id % 2 = 0 THEN 'own_fn' ELSE coalesce(nullif(fault.primary_function, ''), '') END AS function, coalesce(nullif(fault.primary_file, ''), '') AS file, CASE WHEN card_id % 2 = 0 THEN '12' ELSE '0' END AS line, card_id % 2 = 0 AS candidate,
  CASE WHEN card_id % 2 = 0 THEN 'given' ELSE right(cluster_key, 8) END AS cause_id, coalesce(big_bucket, '') AS source_bucket, coalesce(kernel_tree, '') AS kernel_tree,
  array_to_string(list_filter(['crash_report', 'stack', 'source_code', CASE WHEN len(sanitizer_context.alloc_trace) > 0 THEN 'alloc_trace' END, CASE WHEN len(sanitizer_context.free_trace) > 0 THEN 'free_trace' END, CASE WHEN len(sanitizer_context.origin_trace) > 0 THEN 'origin_trace' END,
    CASE WHEN reproducer_semantics IS NOT NULL THEN 'reproducer_semantics' END], lambda x: x IS NOT NULL), '|') AS evidence FROM crash_cards""")
def normalized_cards(spark: SparkSession, d: str) -> DataFrame:
    """Every crash card made into a cause card, from an answer that says little and from none: surface, identity and scope."""
    cards = table(spark, d, "crash_cards").withColumnRenamed("cluster_key", "small_bucket_id").withColumn("hash_part", F.right("small_bucket_id", F.lit(8)))
    said = '{"cause_id":"given","crash_surface":{"sanitizer":"own","bug_type":"own type","crash_point":{"function":"own_fn","line":12},"surface_is_root_candidate":true}}'
    made = cc.normalize_cause_cards(cards.withColumn("case_id", F.concat_ws("/", F.col("card_id").cast("string"), "case_id")).withColumn("raw", F.parse_json(F.when(F.col("card_id") % 2 == 0, F.lit(said)).otherwise(F.lit("{}")))))
    s = "crash_surface"
    return made.select(
        F.substring_index("source_crash_id", "/", 1).cast("long").alias("card_id"), f"{s}.sanitizer", f"{s}.bug_type", f"{s}.crash_point.function", f"{s}.crash_point.file", f"{s}.crash_point.line", F.col(f"{s}.surface_is_root_candidate").alias("candidate"),
        "cause_id", "source_bucket", "input_scope.kernel_tree", F.array_join("input_scope.available_evidence", "|").alias("evidence"))
