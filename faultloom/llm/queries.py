"""Queries of the training-data problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import materialize
from ..sources.tables import table
from . import clusters, copies, leaks, mixing, neighbours, survivors, terms, truncation


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The card with the best value of each mergeable field, per signature bucket of two or more cards."""
    cards = table(spark, sf_dir, "crash_cards", "card_id", "cluster_key", "repro", "reproducer_semantics", "stack_semantic", "sanitizer_context")
    best = survivors.ranked_survivors(cards, survivors.cluster_group(), "card_id", survivors.crash_card_completeness())
    return best.select("group_id", "field_name", F.col("row_id").alias("card_id"))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One surviving card per bucket, each field taken from the card with its best value (trust: a digest of the report; then the latest)."""
    fields = ["repro", "reproducer_semantics", "sanitizer_context", "stack_semantic"]
    cards = table(spark, sf_dir, "crash_cards", "card_id", "cluster_key", *fields, "normalized_report_digest", "ingested_at")
    trust = F.col("normalized_report_digest").isNotNull().cast("int")
    best = survivors.ranked_survivors(cards, survivors.cluster_group(), "card_id", survivors.crash_card_completeness(), trust, F.col("ingested_at"))
    records = survivors.surviving_records(cards, best, "card_id", fields)
    funcs = lambda trace: F.array_join(F.transform(trace, lambda f: F.coalesce(f["func"], F.lit("?"))), "|")
    return records.select(
        "group_id", F.col("n_rows").alias("n_cards"), *[f"{f}_from" for f in fields], "repro.has_syz_repro", "repro.has_c_repro", F.array_join("repro.syscall_hints", "|", "?").alias("syscall_hints"),
        F.array_join("reproducer_semantics.syscalls", "|", "?").alias("syscalls"), F.col("reproducer_semantics.syz_repro_excerpt").alias("excerpt"), funcs("stack_semantic").alias("stack"), funcs("sanitizer_context.alloc_trace").alias("alloc_trace"))


COPIED = {"crash_cards": "card_id", "case_labels": "row_id", "crash_lines": "line_id"}


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [
        copies.card_fields(table(spark, sf_dir, "crash_cards")),
        copies.label_fields(table(spark, sf_dir, "case_labels", "row_id", "bug_id", "case_id", "final_ground_truth_id")),
        copies.line_fields(table(spark, sf_dir, "crash_lines", "line_id", "body")),
    ]
    return copies.copies(copies.table_tuples(fields), "p2")


def _table_name() -> Column:
    return F.get(F.array(*[F.lit(t) for t in COPIED]), F.col("tbl")).alias("table_name")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of cards, labels and lines that repeat another row in different formatting."""
    return _copies(spark, sf_dir).select(_table_name(), "first_id", "copy_id")


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct record of cards, labels and lines with the number of its copies."""
    rows = reduce(DataFrame.unionByName, [table(spark, sf_dir, t, F.col(i).alias("id")).select(F.lit(n).alias("tbl"), "id") for n, (t, i) in enumerate(COPIED.items())])
    return copies.record_counts(rows, "id", materialize(_copies(spark, sf_dir), "p2-copies")).select(_table_name(), "first_id", "n_copies")


def p2_label_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct label record with its smallest row id and number of copies."""
    tuples = copies.label_tuples(table(spark, sf_dir, "case_labels", "row_id", "bug_id", "case_id", "final_ground_truth_id"))
    return copies.grouped_copies(tuples, "p2-label-groups")[1].select("first_id", "n_copies")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = table(spark, sf_dir, "cause_cards", "dedup_representation")
    return terms.marked(terms.term_frequencies(cards, terms.token_fields()), cards.count())


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of the token fields with its occurrences, its cards and its mark."""
    return _terms(spark, sf_dir).select("field_name", "term", "occurrences", F.col("records").alias("n_cards"), "mark")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the token fields that are too rare or too common."""
    return _terms(spark, sf_dir).filter("mark <> 'useful'").select("field_name", "term", "mark")


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar other vectors of every vector, named by their cause cards."""
    vectors = table(spark, sf_dir, "vectors", "vec_id", "vector", "cause_card_id")
    found = neighbours.most_similar(vectors, "vec_id", "vector", label="p5")
    names = vectors.select("vec_id", "cause_card_id")
    named = found.join(names, "vec_id").join(names.toDF("other_id", "other_cause_card_id"), "other_id")
    return named.select("vec_id", "cause_card_id", "other_id", "other_cause_card_id", "similarity", "rank")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of which one is among the five most similar to the other, at a cosine of at least 0.80."""
    vectors = table(spark, sf_dir, "vectors", "vec_id", "vector")
    found = neighbours.most_similar(vectors, "vec_id", "vector", k=5, least=0.80, label="p5")
    return found.select(F.least("vec_id", "other_id").alias("vec_a"), F.greatest("vec_id", "other_id").alias("vec_b")).distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of clusters of three or more vectors of which any two have a cosine of at least 0.70 and none has it with a vector outside."""
    cells = clusters.kmeans_cells(table(spark, sf_dir, "vectors", "vec_id", "vector"), "vec_id", "vector", label="p7")
    if cells is None:
        return spark.createDataFrame([], "first_id long, vec_id long")
    return clusters.tight_clusters(cells, label="p7").filter("vec_id <> cluster").select(F.col("cluster").alias("first_id"), "vec_id")


def _record_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "feature_rows", "record_id", "weight").groupBy("record_id").agg(F.max("weight").alias("weight"))


def p7_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster with its size, its weight and its three most typical records."""
    vectors = table(spark, sf_dir, "vectors", "vec_id", "record_id", "vector")
    cells = clusters.kmeans_cells(vectors, "vec_id", "vector", label="p7")
    if cells is None:
        return spark.createDataFrame([], "first_id long, size long, weight double, rank int, vec_id long, record_id string")
    names = vectors.select("vec_id", "record_id")
    found = clusters.described(clusters.clusters_of(cells), names.join(_record_weights(spark, sf_dir), "record_id").select("vec_id", "weight"))
    return found.join(names, "vec_id").select(F.col("cluster").alias("first_id"), "size", "weight", "rank", "vec_id", "record_id")


def p7_token_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of cause cards by their tokens, hashed with weights: what many records share counts more than one card's own words.

    A token's weight is the log of the ``feature_rows.weight`` of the records whose cards have it, over that of the average token.
    """
    cards = table(spark, sf_dir, "cause_cards", "cause_row", "cause_id", "dedup_representation")
    records = table(spark, sf_dir, "feature_rows", F.col("cause_card_id").alias("cause_id"), "record_id", "weight").dropDuplicates(["cause_id", "record_id"])
    per_card = records.groupBy("cause_id").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("w"))
    fields = [F.coalesce(F.col(f"dedup_representation.{n}"), F.array().cast("array<string>")) for n in ("must_match_tokens", "should_match_tokens", "surface_tokens")]
    tokens = cards.join(per_card, "cause_id", "left").select("cause_row", F.coalesce("w", F.lit(0.0)).alias("w"), F.explode(tx.ordered_unique(F.concat(*fields))).alias("token"))
    sums = tokens.groupBy("token").agg(F.sum("w").alias("tw"))
    mean = sums.agg(F.avg("tw").alias("mean"))
    shared = sums.crossJoin(F.broadcast(mean)).select("token", F.greatest(F.log((F.col("tw") + 1) / (F.col("mean") + 1)), F.lit(0.05)).alias("weight"))
    listed = tokens.join(shared, "token").groupBy("cause_row", "w").agg(F.array_sort(F.collect_list(F.struct("token", "weight"))).alias("t"))
    vectors = listed.select(F.col("cause_row").alias("vec_id"), clusters.hashed_features(F.col("t.token"), 96, F.col("t.weight")).alias("vector"))
    cells = clusters.kmeans_cells(vectors, "vec_id", "vector", label="p7-tokens")
    if cells is None:
        return spark.createDataFrame([], "first_id long, size long, weight double, rank int, cause_row long")
    found = clusters.described(clusters.clusters_of(cells), listed.select(F.col("cause_row").alias("vec_id"), F.col("w").alias("weight")))
    return found.select(F.col("cluster").alias("first_id"), "size", "weight", "rank", F.col("vec_id").alias("cause_row"))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of document words that repeat 16 or more consecutive words of an evaluation item."""
    return leaks.leaked_spans(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items that they leak."""
    return p8_spans(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture with the number of times each is used."""
    return mixing.mixture(table(spark, sf_dir, "documents", "doc_id", "source", "text"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every listed source."""
    return mixing.mixture(table(spark, sf_dir, "documents", "doc_id", "source", "text"), table(spark, sf_dir, "mix_targets"))[1]


def p9_feasible_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every listed source in the largest mixture that meets all targets."""
    return mixing.mixture(table(spark, sf_dir, "documents", "doc_id", "source", "text"), table(spark, sf_dir, "mix_targets"), "feasible")[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut off."""
    return truncation.truncation_scores(table(spark, sf_dir, "documents", "doc_id", "source", "text")).filter("cut").select("doc_id")


def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut texts of every source."""
    scores = truncation.truncation_scores(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("cut").cast("int")).alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("cut_share"))


QUERIES = {
    "p1_found": p1_found,
    "p1_records": p1_records,
    "p2_found": p2_found,
    "p2_records": p2_records,
    "p2_label_records": p2_label_records,
    "p4_found": p4_found,
    "p4_terms": p4_terms,
    "p5_found": p5_found,
    "p5_neighbours": p5_neighbours,
    "p7_clusters": p7_clusters,
    "p7_found": p7_found,
    "p7_token_clusters": p7_token_clusters,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_feasible_shares": p9_feasible_shares,
    "p10_found": p10_found,
    "p10_sources": p10_sources,
}

_FIELD_TERMS = "\nUNION ALL\n".join(
    f"SELECT cause_row, '{f}' AS field_name, unnest(dedup_representation.{f}) AS token FROM cause_cards"
    for f in ("must_match_tokens", "should_match_tokens", "surface_tokens")
)
_TERMS = rf"""
WITH raw AS ({_FIELD_TERMS}),
t AS (SELECT cause_row, field_name, regexp_replace(lower(regexp_replace(token, '^\s+|\s+$', '', 'g')), '[\s_]+', '_', 'g') AS term FROM raw),
counted AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT cause_row) AS n_cards FROM t WHERE term <> '' GROUP BY 1, 2),
marked AS (SELECT *, CASE WHEN n_cards <= 2 THEN 'rare' WHEN n_cards * 100 >= 30 * (SELECT count(*) FROM cause_cards) THEN 'common' ELSE 'useful' END AS mark FROM counted)
"""


def _p1_scores(more: str = "") -> str:
    norm = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
    known = "('', 'na', 'none', 'null', 'unknown')"

    def stated(entries: str) -> str:
        return f"coalesce(len(list_distinct(list_filter(list_transform({entries}, lambda x: {norm.format('x')}), lambda x: x IS NOT NULL AND x NOT IN {known}))), 0)"

    def frames(trace: str) -> str:
        lines = f"coalesce(len(list_distinct(list_filter(list_transform({trace}, lambda f: f.line), lambda x: x IS NOT NULL))), 0)"
        return " + ".join([stated(f"list_transform({trace}, lambda f: f.{k})") for k in ("func", "file")] + [lines])

    excerpt = norm.format("reproducer_semantics.syz_repro_excerpt")
    score = {
        "repro": (f"coalesce(repro.has_syz_repro, false)::INT + coalesce(repro.has_c_repro, false)::INT + {stated('repro.syscall_hints')}", "0"),
        "reproducer_semantics": (
            " + ".join(stated(f"reproducer_semantics.{k}") for k in survivors.TOKEN_LISTS),
            f"CASE WHEN {excerpt} NOT IN {known} THEN length({excerpt}) ELSE 0 END",
        ),
        "sanitizer_context": (" + ".join(frames(f"sanitizer_context.{k}") for k in survivors.TRACES), "0"),
        "stack_semantic": (frames("stack_semantic"), "0"),
    }
    union = " UNION ALL ".join(f"SELECT g, card_id, '{n}' AS field_name, {a} AS s0, coalesce({b}, 0) AS s1, normalized_report_digest IS NOT NULL AS trust, ingested_at FROM cards" for n, (a, b) in score.items())
    return f"""
WITH cards AS (SELECT *, {norm.format('cluster_key')} AS g FROM crash_cards),
groups AS (SELECT g, min(card_id) AS group_id, count(*) AS n_cards FROM cards WHERE g <> '' GROUP BY g HAVING count(*) > 1),
scored AS ({union}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g, field_name ORDER BY s0 DESC, s1 DESC, {more} card_id) AS r FROM scored WHERE s0 > 0 OR s1 > 0)"""


def _p1_records_sql() -> str:
    fields = ["repro", "reproducer_semantics", "sanitizer_context", "stack_semantic"]
    own = ", ".join(f"max(card_id) FILTER (field_name = '{f}') AS {f}_from" for f in fields)
    joins = " ".join(f"LEFT JOIN crash_cards c{i} ON c{i}.card_id = b.{f}_from" for i, f in enumerate(fields))
    funcs = lambda t: f"array_to_string(list_transform({t}, lambda f: coalesce(f.func, '?')), '|')"
    texts = lambda t: f"array_to_string(list_transform({t}, lambda x: coalesce(x, '?')), '|')"
    return _p1_scores("trust DESC, ingested_at DESC NULLS LAST,") + f""", b AS (SELECT group_id, n_cards, {own} FROM ranked JOIN groups USING (g) WHERE r = 1 GROUP BY group_id, n_cards)
SELECT group_id, n_cards, {', '.join(f'{f}_from' for f in fields)}, c0.repro.has_syz_repro AS has_syz_repro, c0.repro.has_c_repro AS has_c_repro, {texts('c0.repro.syscall_hints')} AS syscall_hints,
  {texts('c1.reproducer_semantics.syscalls')} AS syscalls, c1.reproducer_semantics.syz_repro_excerpt AS excerpt, {funcs('c3.stack_semantic')} AS stack, {funcs('c2.sanitizer_context.alloc_trace')} AS alloc_trace FROM b {joins}"""


# Records in one spelling: JSON text with every string reduced, map entries and object members in order.
_NORM = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def _reduced(json: str) -> str:
    return f"array_to_string(list_transform(string_split(regexp_replace({json}, '\\\\(u[0-9a-fA-F]{{4}}|.)', '', 'g'), '\"'), lambda p, i: CASE WHEN i % 2 = 0 THEN {_NORM.format('p')} ELSE p END), '\"')"


_CARD_FIELDS = ["schema_version", "case_id", "big_bucket", "cluster_key", "crash_uid", "title", "time", "kernel_tree", "kernel_commit", "manager", "bug", "fault", "repro", "reproducer_semantics", "stack_semantic",
                "anchor_trace", "sanitizer_context", "source_context", "machine_info_digest", "normalized_report_digest", "layer2_signature_hash"]
_MEMBER = f"CASE WHEN json_type(e) = 'OBJECT' THEN array_to_string(list_sort(list_transform(json_keys(e), lambda k: {_NORM.format('k')} || '=' || {_reduced(chr(40) + 'e -> k' + chr(41) + '::VARCHAR')})), ',') ELSE {_reduced('e::VARCHAR')} END"
_VALUE = f"CASE WHEN json_type(v -> m) = 'ARRAY' THEN '[' || array_to_string(list_transform(from_json(v -> m, '[\"JSON\"]'), lambda e: {_MEMBER}), ';') || ']' ELSE {_reduced(chr(40) + 'v -> m' + chr(41) + '::VARCHAR')} END"
_COPIES = f"""
WITH c AS (SELECT 'crash_cards' AS table_name, card_id AS id, {_reduced("to_json({" + ", ".join(f"'{f}': {f}" for f in _CARD_FIELDS) + "})::VARCHAR")} || coalesce(array_to_string(list_sort(list_transform(map_entries(config_features), lambda e: {_NORM.format('e.key')} || '=' || coalesce({_NORM.format('e.value')}, '<null>'))), ','), '<null>') AS record FROM crash_cards),
l AS (SELECT 'case_labels' AS table_name, row_id AS id, {_reduced("to_json([bug_id, case_id, final_ground_truth_id])::VARCHAR")} AS record FROM case_labels),
b AS (SELECT line_id, regexp_replace(body, '^[\\s\\x{{feff}}\\x00]+|[\\s\\x{{feff}}\\x00]+$', '', 'g') AS body FROM crash_lines),
j AS (SELECT line_id, CASE WHEN json_valid(body) THEN body::JSON END AS v FROM b),
n AS (SELECT 'crash_lines' AS table_name, line_id AS id, CASE WHEN v IS NULL THEN NULL WHEN json_type(v) = 'OBJECT' THEN array_to_string(list_sort(list_transform(json_keys(v), lambda m: m || '=' || {_VALUE})), '|') ELSE {_reduced('v::VARCHAR')} END AS record FROM j),
r AS (SELECT table_name, id, coalesce(record, 'broken ' || id) AS record FROM (FROM c UNION ALL FROM l UNION ALL FROM n)),
f AS (SELECT *, min(id) OVER (PARTITION BY table_name, record) AS first_id FROM r)
"""


_WORDS = r"""list_filter(list_transform(regexp_split_to_array(lower(text), '[\s\p{Z}\x0b\x1c-\x1f\x{85}]+'), lambda w: regexp_replace(w, '[^\p{L}\p{N}]+', '', 'g')), lambda w: w <> '')"""
_GRAMS = "SELECT {id}, array_to_string(w[i:i + 15], ' ') AS gram FROM (SELECT {id}, w, unnest(range(1, len(w) - 14)) AS i FROM (SELECT {id}, " + _WORDS + " AS w FROM {table} WHERE text IS NOT NULL))"
_UNIT_PAIRS = """
WITH v AS (SELECT vec_id, vector::DOUBLE[] AS x, sqrt(list_sum(list_transform(vector::DOUBLE[], lambda t: t * t))) AS n FROM vectors WHERE vector IS NOT NULL),
u AS (SELECT * FROM v WHERE n > 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.x, b.x) / (a.n * b.n), 6) AS sim FROM u a JOIN u b ON {on})
"""

SQL = {
    "p5_found": _UNIT_PAIRS.format(on="a.vec_id <> b.vec_id")
    + """SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM s) WHERE r <= 5 AND sim >= 0.80""",
    "p7_found": _UNIT_PAIRS.format(on="true")
    + """, g AS (SELECT a, list(b ORDER BY b) AS m FROM s WHERE sim >= 0.70 GROUP BY a), c AS (SELECT m FROM g GROUP BY m HAVING count(*) = len(m) AND len(m) >= 3)
SELECT first_id, vec_id FROM (SELECT m[1] AS first_id, unnest(m) AS vec_id FROM c) WHERE vec_id <> first_id""",
    "p8_found": "WITH d AS (" + _GRAMS.replace("{id}", "doc_id").replace("{table}", "documents") + "), e AS (" + _GRAMS.replace("{id}", "item_id").replace("{table}", "eval_items") + ") SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (gram)",
    "p1_found": _p1_scores() + " SELECT group_id, field_name, card_id FROM ranked JOIN groups USING (g) WHERE r = 1",
    "p1_records": _p1_records_sql(),
    "p2_found": _COPIES + "SELECT table_name, first_id, id AS copy_id FROM f WHERE id <> first_id",
    "p2_records": _COPIES + "SELECT table_name, first_id, count(*) AS n_copies FROM f GROUP BY table_name, first_id",
    "p5_neighbours": _UNIT_PAIRS.format(on="a.vec_id <> b.vec_id")
    + """SELECT a AS vec_id, x.cause_card_id, b AS other_id, y.cause_card_id AS other_cause_card_id, sim AS similarity, r::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM s) t JOIN vectors x ON x.vec_id = t.a JOIN vectors y ON y.vec_id = t.b WHERE r <= 5""",
    "p8_spans": "WITH d AS (" + _GRAMS.replace("{id}", "doc_id").replace("gram FROM (SELECT", "gram, i - 1 AS pos FROM (SELECT").replace("{table}", "documents") + "), e AS (" + _GRAMS.replace("{id}", "item_id").replace("{table}", "eval_items")
    + """), h AS (SELECT DISTINCT doc_id, item_id, pos FROM d JOIN e USING (gram)), n AS (SELECT *, coalesce(pos > lag(pos) OVER (PARTITION BY doc_id, item_id ORDER BY pos) + 16, true)::INT AS new FROM h),
p AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY pos) AS span FROM n) SELECT doc_id, item_id, min(pos) AS first_word, max(pos) + 16 AS end_word FROM p GROUP BY doc_id, item_id, span""",
    "p2_label_records": r"""
SELECT min(row_id) AS first_id, count(*) AS n_copies FROM case_labels
GROUP BY regexp_replace(lower(bug_id), '[^\p{L}\p{N}]+', '', 'g'), regexp_replace(lower(case_id), '[^\p{L}\p{N}]+', '', 'g'),
         regexp_replace(lower(final_ground_truth_id), '[^\p{L}\p{N}]+', '', 'g')""",
    "p4_terms": _TERMS + "SELECT field_name, term, occurrences, n_cards, mark FROM marked",
    "p4_found": _TERMS + "SELECT field_name, term, mark FROM marked WHERE mark <> 'useful'",
}
