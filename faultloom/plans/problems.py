"""Queries of the general data problems (3 and 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, skew
from ..sources.tables import table

LABEL_KEYS = {"bug_id": ["case_id", "final_ground_truth_id"], "final_ground_truth_id": ["case_id", "bug_id"]}


def _label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "case_labels", "bug_id", "case_id", "final_ground_truth_id")
    return skew.per_key_counts(labels, list(LABEL_KEYS), LABEL_KEYS)


def p3_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct cases and distinct labels (or bugs) of every bug and every label."""
    return _label_counts(spark, sf_dir).select(
        "key_field", "key_value", F.col("rows").alias("n_rows"), F.col("distinct_0").alias("n_cases"), F.col("distinct_1").alias("n_partners")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bugs and labels that hold at least 2 % of all rows of ``case_labels``."""
    labels = table(spark, sf_dir, "case_labels", "bug_id", "case_id", "final_ground_truth_id")
    return skew.keys_holding(skew.per_key_counts(labels, list(LABEL_KEYS)), labels.count(), 2).select("key_field", "key_value")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_cause_cards", "raw_id", "producer", "file_seq", "body")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a file's fields against its producer's file before."""
    return drift.drift_log(_bodies(spark, sf_dir))


def p6_lifespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of files in which a producer's path has one type."""
    return drift.lifespans(drift.file_catalogue(_bodies(spark, sf_dir)))


def p6_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readable cards in one consistent table."""
    return drift.consistent_table(_bodies(spark, sf_dir))


QUERIES = {"p3_found": p3_found, "p3_per_key": p3_per_key, "p6_found": p6_found, "p6_lifespans": p6_lifespans, "p6_table": p6_table}

#: Cards of every file as a tree of members: paths, types, lifespans.
_LIVES = r"""
WITH f AS (SELECT raw_id, producer, file_seq, body, regexp_extract(body, '(?s)```[A-Za-z]*\s*(\{.*\})\s*```', 1) AS fenced, regexp_extract(body, '(?s)\{.*\}') AS braced FROM raw_cause_cards),
d AS (SELECT raw_id, producer, file_seq, CASE WHEN json_valid(body) THEN body WHEN json_valid(fenced) THEN fenced WHEN json_valid(braced) THEN braced END AS doc FROM f),
c AS (SELECT raw_id, producer, file_seq, doc::JSON AS doc, doc ->> '$.cause_id' AS cause_id FROM d WHERE doc IS NOT NULL AND json_type(doc) = 'OBJECT' AND json_type(doc, '$.cause_id') = 'VARCHAR'),
t AS (SELECT c.raw_id, c.producer, c.file_seq, c.cause_id, x.id, x.fullkey, x.type AS kind, x.atom,
  regexp_replace(replace(regexp_replace(x.fullkey, '\[\d+\]', '', 'g'), '"', ''), '^\$\.?', '') AS path FROM c, json_tree(c.doc) x WHERE x.fullkey <> '$' AND x.type <> 'NULL'),
n AS (SELECT *, CASE WHEN kind = 'VARCHAR' THEN 'string' WHEN kind = 'BOOLEAN' THEN 'boolean' WHEN kind = 'OBJECT' THEN 'object' WHEN kind = 'ARRAY' THEN 'array' ELSE 'number' END AS simple, regexp_matches(fullkey, '\]$') AS entry FROM t),
inner_kinds AS (SELECT raw_id, regexp_replace(fullkey, '(\[\d+\])+$', '') AS fullkey, string_agg(DISTINCT simple, '|' ORDER BY simple) AS kinds FROM n WHERE entry AND simple <> 'array' GROUP BY 1, 2),
m AS (SELECT n.*, CASE WHEN simple = 'array' AND kinds IS NOT NULL THEN 'array<' || kinds || '>' ELSE simple END AS typed FROM n LEFT JOIN inner_kinds USING (raw_id, fullkey) WHERE NOT entry),
p AS (SELECT producer, file_seq, path, coalesce(string_agg(DISTINCT typed, '|' ORDER BY typed) FILTER (typed <> 'array'), 'array') AS type FROM m GROUP BY 1, 2, 3),
numbered AS (SELECT producer, file_seq, row_number() OVER (PARTITION BY producer ORDER BY file_seq) AS file_no FROM (SELECT DISTINCT producer, file_seq FROM p)),
k AS (SELECT p.*, file_no, nullif(type, 'array') AS known FROM p JOIN numbered USING (producer, file_seq)),
filled AS (SELECT *, last_value(known IGNORE NULLS) OVER (PARTITION BY producer, path ORDER BY file_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
  first_value(known IGNORE NULLS) OVER (PARTITION BY producer, path ORDER BY file_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM k),
catalogue AS (SELECT producer, file_no, file_seq, path, coalesce(known, CASE WHEN starts_with(b, 'array') THEN b END, CASE WHEN starts_with(a, 'array') THEN a END, type) AS type FROM filled),
lives AS (SELECT producer, path, type, min(file_no)::INT AS first_no, max(file_no)::INT AS last_no FROM (SELECT *, file_no - row_number() OVER (PARTITION BY producer, path, type ORDER BY file_no) AS island FROM catalogue) GROUP BY producer, path, type, island)
"""

_CHANGES = _LIVES + r""",
marks AS (SELECT producer, file_no, path, max(began) AS began, max(ended) AS ended FROM (SELECT producer, first_no AS file_no, path, type AS began, NULL AS ended FROM lives WHERE first_no > 1
  UNION ALL SELECT l.producer, last_no + 1, path, NULL, type FROM lives l JOIN (SELECT producer, max(file_no) AS files FROM catalogue GROUP BY producer) USING (producer) WHERE last_no < files) GROUP BY 1, 2, 3),
q AS (SELECT *, regexp_replace(path, '\.?[^.]*$', '') AS parent FROM marks),
pairs AS (SELECT o.producer, o.file_no, o.path AS old_path, w.path AS new_path FROM q o JOIN q w USING (producer, file_no, parent) WHERE o.began IS NULL AND w.ended IS NULL),
wanted AS (SELECT DISTINCT producer, file_no - 1 AS file_no, old_path AS path FROM pairs UNION SELECT DISTINCT producer, file_no, new_path FROM pairs),
v AS (SELECT m.raw_id, m.producer, w.file_no, m.cause_id, m.path, m.id, list(substr(x.fullkey, length(m.fullkey) + 1) || '=' || coalesce(x.atom::VARCHAR, x.kind) ORDER BY x.fullkey) AS value
  FROM m JOIN numbered u USING (producer, file_seq) JOIN wanted w ON w.producer = m.producer AND w.file_no = u.file_no AND w.path = m.path JOIN n x ON x.raw_id = m.raw_id AND (x.fullkey = m.fullkey OR starts_with(x.fullkey, m.fullkey || '.') OR starts_with(x.fullkey, m.fullkey || '[')) GROUP BY ALL),
whole AS (SELECT raw_id, producer, file_no, cause_id, path, string_agg(value::VARCHAR, ';' ORDER BY id) AS value FROM v GROUP BY ALL),
card AS (SELECT producer, file_no, cause_id, path, min(value) AS low, max(value) AS high FROM whole GROUP BY 1, 2, 3, 4),
equal AS (SELECT r.producer, r.file_no, r.old_path, r.new_path, count(*) AS n FROM pairs r JOIN card a ON a.producer = r.producer AND a.file_no = r.file_no - 1 AND a.path = r.old_path
  JOIN card b ON b.producer = r.producer AND b.file_no = r.file_no AND b.path = r.new_path AND b.cause_id = a.cause_id GROUP BY 1, 2, 3, 4 HAVING bool_and(a.low = b.low AND a.high = b.high)),
first_new AS (SELECT * FROM equal QUALIFY row_number() OVER (PARTITION BY producer, file_no, old_path ORDER BY n DESC, new_path) = 1),
moved AS (SELECT * FROM first_new QUALIFY row_number() OVER (PARTITION BY producer, file_no, new_path ORDER BY n DESC, old_path) = 1),
listed AS (SELECT k.producer, k.file_no, k.path, CASE WHEN o.new_path IS NOT NULL THEN 'renamed' WHEN began IS NOT NULL AND ended IS NOT NULL THEN 'retyped' WHEN began IS NOT NULL THEN 'added' ELSE 'removed' END AS drift_kind,
  coalesce(o.new_path, '') AS new_path, w.new_path IS NOT NULL AS is_new FROM marks k LEFT JOIN moved o ON o.producer = k.producer AND o.file_no = k.file_no AND o.old_path = k.path LEFT JOIN moved w ON w.producer = k.producer AND w.file_no = k.file_no AND w.new_path = k.path)
SELECT l.producer, u.file_seq, l.path AS field_path, drift_kind, l.new_path FROM listed l JOIN numbered u USING (producer, file_no)
WHERE NOT is_new AND NOT EXISTS (SELECT 1 FROM listed h WHERE h.producer = l.producer AND h.file_no = l.file_no AND starts_with(l.path, h.path || '.'))"""

SQL = {
    "p6_lifespans": _LIVES + "SELECT producer, path, type, first_no, last_no FROM lives",
    "p6_found": _CHANGES,
    "p3_per_key": """
SELECT 'bug_id' AS key_field, bug_id AS key_value, count(*) AS n_rows,
       count(DISTINCT case_id) AS n_cases, count(DISTINCT final_ground_truth_id) AS n_partners
FROM case_labels GROUP BY bug_id
UNION ALL
SELECT 'final_ground_truth_id', final_ground_truth_id, count(*), count(DISTINCT case_id), count(DISTINCT bug_id)
FROM case_labels GROUP BY final_ground_truth_id""",
    "p3_found": """
SELECT key_field, key_value FROM (
  SELECT 'bug_id' AS key_field, bug_id AS key_value, count(*) AS n FROM case_labels GROUP BY bug_id
  UNION ALL
  SELECT 'final_ground_truth_id', final_ground_truth_id, count(*) FROM case_labels GROUP BY final_ground_truth_id)
WHERE key_value IS NOT NULL AND n * 100 >= 2 * (SELECT count(*) FROM case_labels)""",
}
