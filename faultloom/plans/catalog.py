"""Queries that run the engine's operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frames as fr
from ..functions import reports as rp
from ..functions import text as tx
from ..operators import buckets as bk
from ..operators import cause_cards as cc
from ..operators import embeddings as em
from ..operators import features as ft
from ..operators import linkage as lk
from ..operators import metrics as mt
from ..operators import prefetch as pf
from ..operators import quality as ql
from ..operators import source_search as ss
from ..operators.cards import signature_hash
from ..sources import artifacts as ar
from ..sources.tables import table

QUERIES, SQL = {}, {}


def registrar(queries: dict, sqls: dict):
    """A decorator that registers a query under its function's name, with its SQL if it has one."""
    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return add

    return query


query = registrar(QUERIES, SQL)


def _cards(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "crash_cards", *columns)


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "case_labels", "row_id", "bug_id", "case_id", "final_ground_truth_id")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    files = _documents(spark, d).select(F.concat(F.lit("docs/d"), F.format_string("%09d", "doc_id"), F.lit(".c")).alias("path"), "text")
    return ss.source_lines(files)


# --- SQL building blocks -------------------------------------------------------------------------------------------
_EOL = "\\r\\n|[\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e]"
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}|{_BLANK}$', '', 'g')"


def _sql_lines(x: str) -> str:
    parts = f"regexp_split_to_array({x}, '{_EOL}')"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


def _sql_unique(x: str) -> str:
    return f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"


def _sql_canonical(x: str) -> str:
    out = rf"lower(trim(regexp_replace(replace({x}, '->', ' -> '), '[\s\x0b]+', ' ', 'g')))"
    out = f"replace(replace(replace({out}, ' -> ', '->'), '=>', '->'), '::', '.')"
    return rf"regexp_replace(regexp_replace({out}, '[\s_]+', '_', 'g'), '^[ _.,;]+|[ _.,;]+$', '', 'g')"


def _sql_tokens(x: str) -> str:
    inner = f"list_filter(list_transform({x}, lambda t: {_sql_canonical('t')}), lambda t: t IS NOT NULL AND t <> '')"
    return inner


def _sql_starts(x: str, leads: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({x}, '{p}')" for p in leads) + ")"


_LINE_TABLE = f"""lines AS (SELECT path, lineno, line FROM (
  SELECT printf('docs/d%09d.c', doc_id) AS path, unnest({_sql_lines('text')}) AS line, generate_subscripts({_sql_lines('text')}, 1) AS lineno FROM documents WHERE text <> ''))"""


# --- buckets, representatives, weights ------------------------------------------------------------------------------
@query("SELECT cluster_key, count(*) AS size, min(case_id) AS first_case FROM crash_cards GROUP BY cluster_key")
def exact_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Exact signature buckets."""
    return bk.exact_buckets(_cards(spark, d, "cluster_key", "case_id"))


@query("SELECT cluster_key, case_id, row_number() OVER (PARTITION BY cluster_key ORDER BY case_id) AS position FROM crash_cards")
def bucket_member(spark: SparkSession, d: str) -> DataFrame:
    """Members of each bucket in case order."""
    return bk.bucket_members(_cards(spark, d, "cluster_key", "case_id"))


@query("""SELECT cluster_key, size, case_id, title, primary_func FROM (
  SELECT cluster_key, count(*) OVER (PARTITION BY cluster_key) AS size, case_id, title, fault.primary_function AS primary_func,
         row_number() OVER (PARTITION BY cluster_key ORDER BY case_id, card_id) AS r FROM crash_cards) WHERE r = 1""")
def bucket_info(spark: SparkSession, d: str) -> DataFrame:
    """Buckets with what their first case says."""
    cards = _cards(spark, d, "cluster_key", "case_id", "card_id", "title", "bug", "fault", "anchor_trace")
    return bk.bucket_summary(cards, "card_id").select("cluster_key", "size", "representative.case_id", "representative.title", "representative.primary_func")


_ORDINALS = """SELECT cluster_key, split_part(cluster_key, '::', 1) AS bug_id,
  row_number() OVER (PARTITION BY split_part(cluster_key, '::', 1) ORDER BY cluster_key) AS idx, right(cluster_key, 8) AS hash8
  FROM (SELECT DISTINCT cluster_key FROM crash_cards)"""


@query(f"SELECT cluster_key, bug_id, idx, hash8, printf('%03d', idx) AS small_bucket FROM ({_ORDINALS})")
def bucket_ordinal(spark: SparkSession, d: str) -> DataFrame:
    """Buckets numbered within their bug."""
    return bk.bucket_ordinals(bk.exact_buckets(_cards(spark, d, "cluster_key", "case_id")).select("cluster_key")).select("cluster_key", "bug_id", "idx", "hash8", "small_bucket")


_REP = """SELECT cluster_key, case_id, card_id FROM (SELECT cluster_key, case_id, card_id, row_number() OVER (PARTITION BY cluster_key ORDER BY
  coalesce(repro.has_syz_repro, false) DESC, coalesce(repro.has_c_repro, false) DESC, coalesce(len(reproducer_semantics.semantic_tokens), 0) DESC,
  coalesce(len(sanitizer_context.alloc_trace), 0) + coalesce(len(sanitizer_context.free_trace), 0) + coalesce(len(sanitizer_context.origin_trace), 0) DESC,
  coalesce(len(stack_semantic), 0) DESC, case_id, card_id) AS r FROM crash_cards) WHERE r = 1"""


@query(_REP)
def representative_top1(spark: SparkSession, d: str) -> DataFrame:
    """The representative card of each bucket."""
    cards = _cards(spark, d, "cluster_key", "case_id", "card_id", "repro", "reproducer_semantics", "sanitizer_context", "stack_semantic")
    return bk.representatives(cards, "card_id").select("cluster_key", "case_id", "card_id")


_WEIGHT = """SELECT cluster_key, count(DISTINCT c.case_id) AS unique_cases, count(*) AS members, sum(coalesce(n, 1))::BIGINT AS represented_rows
  FROM crash_cards c LEFT JOIN (SELECT bug_id, case_id, count(*) AS n FROM case_labels GROUP BY 1, 2) l ON l.bug_id = c.big_bucket AND l.case_id = c.case_id GROUP BY cluster_key"""
_VOTE = """SELECT cluster_key, label, votes FROM (SELECT cluster_key, label, sum(n)::BIGINT AS votes, row_number() OVER (PARTITION BY cluster_key ORDER BY sum(n) DESC, min({'a': c.case_id, 'b': seen_at}), label) AS r
  FROM crash_cards c JOIN (SELECT bug_id, case_id, final_ground_truth_id AS label, count(*) AS n, min(row_id) AS seen_at FROM case_labels
    WHERE coalesce(final_ground_truth_id, '') <> '' GROUP BY 1, 2, 3) l ON l.bug_id = c.big_bucket AND l.case_id = c.case_id GROUP BY cluster_key, label) WHERE r = 1"""


@query(_WEIGHT)
def represented_weight(spark: SparkSession, d: str) -> DataFrame:
    """Label rows that each bucket stands for; unlabelled cases count once."""
    return bk.represented_weight(_cards(spark, d, "cluster_key", "big_bucket", "case_id"), _labels(spark, d))


@query(_VOTE)
def label_vote(spark: SparkSession, d: str) -> DataFrame:
    """The label most rows of a bucket's cases have."""
    return bk.label_vote(_cards(spark, d, "cluster_key", "big_bucket", "case_id"), _labels(spark, d), "row_id")


_WEIGHTS_TABLE = f"""WITH o AS ({_ORDINALS}), rep AS ({_REP}), w AS ({_WEIGHT}), v AS ({_VOTE}),
  j AS (SELECT *, coalesce(label, '') AS l, printf('%03d', idx) AS b FROM o JOIN rep USING (cluster_key) JOIN w USING (cluster_key) LEFT JOIN v USING (cluster_key))
SELECT l AS final_ground_truth_id, replace(l, ':', '__') AS directory_name, bug_id || '__' || b || '__' || hash8 || '.json' AS copied_file_name,
  bug_id || '/' || hash8 AS cause_card_key, hash8 AS cause_card_id, hash8 AS cause_card_file_stem, bug_id AS source_bug_id, b AS source_small_bucket,
  case_id AS source_crash_id, hash8 AS small_bucket_cluster_id, cluster_key, case_id AS cluster_representative_case_id, unique_cases::INT AS unique_case_count,
  members::INT AS member_ref_count, represented_rows::INT AS represented_crash_row_count, (represented_rows - unique_cases)::INT AS duplicate_row_count,
  CASE WHEN starts_with(l, 'ndss:') THEN l[6:] ELSE '' END AS ndss_patch, 'outputs/stage2_cause_cards/' || bug_id || '/' || hash8 || '.json' AS cause_card_file,
  'outputs/stage1_crash_cards/' || bug_id || '/crash_cards/small_bucket_rep/' || b || '__' || hash8 || '.json' AS copied_target_file FROM j"""


@query(_WEIGHTS_TABLE)
def representative_weights(spark: SparkSession, d: str) -> DataFrame:
    """The representative table with labels, names and weights (the flagship query)."""
    cards = _cards(spark, d, "cluster_key", "big_bucket", "case_id", "card_id", "repro", "reproducer_semantics", "sanitizer_context", "stack_semantic")
    return bk.representative_rows(cards, _labels(spark, d), "row_id", "card_id")


@query(f"""WITH t AS ({_WEIGHTS_TABLE}) SELECT (SELECT count(DISTINCT big_bucket) FROM crash_cards) AS bugs,
  (SELECT count(*) FROM (SELECT DISTINCT big_bucket, case_id FROM crash_cards)) AS unique_cases, sum(represented_crash_row_count)::BIGINT AS represented_rows,
  count(*) AS representatives, count(DISTINCT nullif(final_ground_truth_id, '')) AS labels FROM t""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Totals of a run."""
    return bk.run_summary(_cards(spark, d, "big_bucket", "case_id"), representative_weights(spark, d))


@query("SELECT bug_id, case_id, count(*) AS n_rows FROM case_labels GROUP BY bug_id, case_id")
def labels_per_case(spark: SparkSession, d: str) -> DataFrame:
    """Label rows per case."""
    return bk.label_counts(_labels(spark, d)).withColumnRenamed("rows", "n_rows")


# --- texts, lines, frames -------------------------------------------------------------------------------------------
@query("SELECT doc_id, left(sha256(text), 16) AS digest FROM documents WHERE text IS NOT NULL")
def text_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digest of every text."""
    return _documents(spark, d).filter("text IS NOT NULL").select("doc_id", tx.sha16(F.col("text")).alias("digest"))


@query(f"SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len({_sql_lines('text')}) END AS n_lines FROM documents")
def line_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines per text."""
    return _documents(spark, d).select("doc_id", F.size(tx.split_lines(F.col("text"))).cast("long").alias("n_lines"))


_NOISE = " OR ".join(f"starts_with(x, '{p}')" for p in rp.NOISE_LEADS)


@query(rf"""WITH l AS (SELECT doc_id, list_transform({_sql_lines("coalesce(text, '')")}, lambda x: regexp_replace(x, '\s+$', '')) AS ls FROM documents),
  c AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda x: contains(x, 'Code disassembly')), true) AS cut FROM l),
  k AS (SELECT doc_id, CASE WHEN cut > 0 THEN ls[:cut - 1] ELSE ls END AS ls FROM c),
  m AS (SELECT doc_id, list_transform(list_filter(ls, lambda x: NOT ({_NOISE} OR regexp_matches(x, '{rp.REGISTER_LINE}') OR regexp_matches(x, '^\s*(CPU|Hardware name|Workqueue):'))),
    lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '{rp.MASKS[0][0]}', '<HEX>', 'g'), '{rp.MASKS[1][0]}', '+<OFF>', 'g'),
      '{rp.MASKS[2][0]}', 'syz.N.N', 'g'), '{rp.MASKS[3][0]}', '/N', 'g'), '{rp.MASKS[4][0]}', '', 'g'), '\s+', ' ', 'g'))) AS ls FROM k)
SELECT doc_id, left(sha256(array_to_string(list_filter(ls, lambda x: x <> ''), chr(10))), 16) AS digest FROM m""")
def report_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digest of every text's normal form."""
    return _documents(spark, d).select("doc_id", tx.sha16(rp.normal_report(F.col("text"))).alias("digest"))


@query(rf"""WITH l AS (SELECT doc_id, {_sql_lines("coalesce(text, '')")} AS ls FROM documents),
  s AS (SELECT doc_id, ls, coalesce(list_position(list_transform(ls, lambda x: regexp_matches(x, '(?i)object was given back by:')), true), 0) AS a FROM l),
  r AS (SELECT doc_id, ls[a + 1:] AS rest, ls[a] AS head FROM s WHERE a > 0),
  e AS (SELECT doc_id, rest, head, coalesce(list_position(list_transform(rest, lambda x: regexp_matches(x, '(?i)^$|^---\[|</trace>|== end')), true), 0) AS b FROM r)
SELECT doc_id, CASE WHEN b > 0 THEN b ELSE len(rest) + 1 END AS n_lines, left(sha256(array_to_string([head] || CASE WHEN b > 0 THEN rest[:b - 1] ELSE rest END, chr(10))), 16) AS digest FROM e""")
def section_slice(spark: SparkSession, d: str) -> DataFrame:
    """A named section of every report."""
    found = _documents(spark, d).select("doc_id", fr.slice_between(tx.split_lines(F.col("text")), "object was given back by:", ["^$", r"^---\[", "</trace>", "== end"]).alias("ls"))
    return found.filter(F.size("ls") > 0).select("doc_id", F.size("ls").cast("long").alias("n_lines"), tx.sha16(F.array_join("ls", "\n")).alias("digest"))


_FRAMES = """SELECT card_id, unnest(stack_semantic) AS f, generate_subscripts(stack_semantic, 1) AS pos FROM crash_cards"""
_PATH_SQL = r"([A-Za-z0-9_./+-]+\.(?:c|h|S|rs))(?::(-?\d+))?"


@query(rf"""WITH t AS ({_FRAMES}), r AS (SELECT card_id, pos, trim(f.raw, E' \t\r\n') AS raw FROM t WHERE f.raw IS NOT NULL),
  p AS (SELECT *, regexp_extract(raw, '\b{_PATH_SQL}', 1) AS file, regexp_extract(raw, '\b{_PATH_SQL}', 2) AS ln,
    CASE WHEN regexp_matches(raw, '\b{_PATH_SQL}') THEN regexp_extract(raw, '(?s)^(.*?)\b{_PATH_SQL}', 1) ELSE raw END AS before FROM r),
  n AS (SELECT *, regexp_extract(trim(replace(before, '[inline]', '')), '(\S+)$', 1) AS tok FROM p),
  g AS (SELECT card_id, pos, file, ln, raw, regexp_replace(split_part(regexp_replace(tok, '\+0x[0-9a-fA-F]+/0x[0-9a-fA-F]+', '', 'g'), '+', 1), '^[():]+|[():]+$', '', 'g') AS func FROM n)
SELECT card_id, pos, func, nullif(file, '') AS file, TRY_CAST(nullif(ln, '') AS INT) AS line, contains(raw, '[inline]') AS inline FROM g WHERE regexp_matches(func, '^[A-Za-z_][A-Za-z0-9_.$]*$')""")
def parsed_frames(spark: SparkSession, d: str) -> DataFrame:
    """Every stack frame read again from its raw line."""
    cards = _cards(spark, d, "card_id", "stack_semantic").select("card_id", F.posexplode("stack_semantic").alias("p", "f")).filter("f.raw IS NOT NULL")
    one = cards.select("card_id", (F.col("p") + 1).cast("long").alias("pos"), F.get(fr.parsed(F.array("f.raw")), F.lit(0))["frame"].alias("x"))
    return one.filter("x IS NOT NULL").select("card_id", "pos", "x.func", "x.file", "x.line", "x.inline")


_GENERIC = f"({_sql_starts('f.func', fr.GENERIC_FUNC_PREFIXES)} OR coalesce({_sql_starts('f.file', fr.GENERIC_PATH_PREFIXES)}, false))"


def _sql_cause_generic(f: str) -> str:
    func, file = f"coalesce({_strip(f'{f}.func')}, '')", f"coalesce({_strip(f'{f}.file')}, '')"
    names = ", ".join(f"'{n}'" for n in fr.CAUSE_GENERIC_FUNCTIONS)
    files = ", ".join(f"'{n}'" for n in fr.CAUSE_GENERIC_FILES)
    return f"({func} IN ({names}) OR {_sql_starts(f'lower({func})', fr.CAUSE_GENERIC_LEADS)} OR {file} IN ({files}) OR {_sql_starts(f'lower({file})', fr.CAUSE_GENERIC_PATHS)})"


@query(f"""WITH t AS ({_FRAMES}) SELECT card_id, count(*) AS frames, count(*) FILTER (coalesce({_GENERIC}, false)) AS generic,
  count(*) FILTER ({_sql_cause_generic('f')}) AS generic_for_cause FROM t WHERE f IS NOT NULL GROUP BY card_id""")
def generic_frames(spark: SparkSession, d: str) -> DataFrame:
    """Generic frames of each card by both rules."""
    f = _cards(spark, d, "card_id", "stack_semantic").select("card_id", F.explode("stack_semantic").alias("f")).filter("f IS NOT NULL")
    return f.groupBy("card_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if(fr.is_generic(F.col("f"))).alias("generic"), F.count_if(fr.is_generic_for_cause(F.col("f"))).alias("generic_for_cause"))


def _sql_class(title: str, report: str) -> str:
    head = f"array_to_string(({_sql_lines(report)})[:6], chr(10))"
    token = lambda n: f"regexp_extract(x, '{n}:\\s*([A-Za-z0-9_-]+)', 1)"
    rules = [
        ("contains(low, 'divide error')", "OOPS", "'divide-error'"), ("contains(low, 'general protection fault')", "OOPS", "'general-protection-fault'"),
        ("contains(low, 'unable to handle kernel paging request') OR contains(low, 'unable to handle page fault')", "OOPS", "'page-fault'"),
        ("contains(low, 'kernel bug')", "BUG", "'kernel-bug'"), ("contains(low, 'kernel-oops') OR regexp_matches(low, '\\boops\\b')", "OOPS", "'oops'"),
        ("contains(low, 'kasan:')", "KASAN", f"replace({token('KASAN')}, 'slab-use-after-free', 'use-after-free')"), ("contains(low, 'kmsan:')", "KMSAN", token("KMSAN")),
        ("contains(low, 'kcserror:') OR contains(low, 'kcsan:')", "KCSAN", token("KCSAN")), ("contains(low, 'ubsan')", "UBSAN", token("UBSAN")),
        ("contains(low, 'inconsistent lock state') OR contains(low, 'possible deadlock') OR contains(low, 'possible circular locking')", "LOCKDEP",
         "CASE WHEN contains(low, 'inconsistent lock') THEN 'inconsistent-lock-state' WHEN contains(low, 'possible deadlock') THEN 'possible-deadlock' ELSE 'possible-circular-lock' END"),
        ("starts_with(low, 'warning') OR contains(low, 'warning in') OR contains(low, 'warning:')", "WARN", "'warning'"),
        ("contains(low, 'corrupted list') OR contains(lower(r), 'list_del corruption')", "BUG", "'list-corruption'"),
        ("contains(low, 'info: rcu detected stall')", "INFO", "'rcu-stall'"), ("contains(low, 'info: task hung')", "INFO", "'task-hung'"),
        ("starts_with(low, 'bug:')", "BUG", "'bug'"), ("contains(low, 'out-of-bounds') OR contains(low, 'oob')", "KASAN", "'out-of-bounds'"),
    ]
    sanitizer = "CASE " + " ".join(f"WHEN {c} THEN '{s}'" for c, s, _ in rules) + " ELSE '' END"
    kind = "CASE " + " ".join(f"WHEN {c} THEN {k}" for c, _, k in rules) + " ELSE 'unknown' END"
    return f"""WITH a AS (SELECT *, coalesce({title}, '') AS t, coalesce({report}, '') AS r, coalesce({title}, '') || ' ' || coalesce({head}, '') AS x FROM src),
      b AS (SELECT *, lower(x) AS low FROM a)
      SELECT id, {sanitizer} AS sanitizer, {kind} AS bug_type, nullif(regexp_extract(t, '\\bin\\s+([A-Za-z_][A-Za-z0-9_.$]*)', 1), '') AS title_func FROM b"""


@query("WITH src AS (SELECT card_id AS id, title AS ti, '' AS re FROM crash_cards), res AS (" + _sql_class("ti", "re") + ") SELECT id, sanitizer, bug_type, coalesce(title_func, '') AS title_func FROM res")
def title_class(spark: SparkSession, d: str) -> DataFrame:
    """Class of every crash by its title alone."""
    bug = rp.bug_class(F.col("title"), F.lit(""))
    return _cards(spark, d, "card_id", "title").select(F.col("card_id").alias("id"), bug.alias("b")).select("id", "b.sanitizer", "b.bug_type", "b.title_func")


@query("WITH src AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS ti, text AS re FROM documents), res AS (" + _sql_class("ti", "re") + ") SELECT id, sanitizer, bug_type FROM res")
def report_class(spark: SparkSession, d: str) -> DataFrame:
    """Class of every text, its first line taken as title."""
    bug = rp.bug_class(F.substring_index("text", "\n", 1), F.col("text"))
    return _documents(spark, d).select(F.col("doc_id").alias("id"), bug.alias("b")).select("id", "b.sanitizer", "b.bug_type")


_HINTS = " OR ".join(f"contains(x, '{p}')" for p in rp.HINT_PARTS)


@query(rf"""SELECT doc_id, array_to_string(list_transform((list_filter(({_sql_lines("coalesce(text, '')")})[:200], lambda x: NOT regexp_matches(x, 'executing program \d+:') AND ({_HINTS})))[:12],
  lambda x: left({_strip('x')}, 120)), '|') AS hints FROM documents""")
def syscall_hint(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every text that look like system calls."""
    return _documents(spark, d).select("doc_id", F.array_join(rp.syscall_hints(F.col("text")), "|").alias("hints"))


_CALLS = rf"""list_filter(list_transform(list_filter(list_transform({_sql_lines("coalesce(text, '')")}, lambda x: {_strip('x')}), lambda x: x <> '' AND NOT starts_with(x, '#')),
  lambda x: regexp_extract(x, '^(?:[A-Za-z0-9_]+\s*=\s*)?([A-Za-z_][A-Za-z0-9_$]*)\(', 1)), lambda x: x <> '')"""


def _sql_names(codes: str, names: dict[int, str]) -> str:
    table = "MAP {" + ", ".join(f"{k}: '{v}'" for k, v in names.items()) + "}"
    return f"list_transform({codes}, lambda n: coalesce(({table})[n], 'UNKNOWN_' || n))"


def _sql_codes(texts: str) -> str:
    number = "CASE WHEN starts_with(n, '0x') THEN TRY_CAST(n AS INT) WHEN regexp_matches(n, '^(0+|[1-9][0-9]*)$') THEN TRY_CAST(n AS INT) END"
    return f"list_filter(list_transform({texts}, lambda n: {number}), lambda n: n IS NOT NULL)"


_CODE = r"(0x[0-9a-fA-F]+|\d+)"
_MAP_CODES = r"list_transform(list_filter(ls, lambda x: contains(x, 'bpf$MAP_CREATE')), lambda x: regexp_extract(x, '@base=\{" + _CODE + "', 1))"
_LOADED = r"list_transform(list_filter(ls, lambda x: contains(x, 'bpf$PROG_LOAD')), lambda x: regexp_extract(x, 'bpf\$PROG_LOAD\([^)]*\)=\{" + _CODE + "', 1))"
# The documents' programs name no types, so calls with types are put before each.
_TYPED_CALLS = r"""bpf$MAP_CREATE(0x0, &(0x7f00)=@base={0x12, 0x4}, 0x48)
r1 = bpf$MAP_CREATE(0x0, &(0x7f00)=@base={017, 0x4}, 0x48)
bpf$MAP_CREATE(0x0, &(0x7f00)=@base={99, 0x4}, 0x48)
bpf$PROG_LOAD(0x5, &(0x7f00)={0x11, 0x8, &(0x7f01)=@ringbuf_x, &(0x7f02)='GPL\x00'}, 0x90)
bpf$BPF_RAW_TRACEPOINT_OPEN(0x11, &(0x7f00)={&(0x7f01)='sched_switch\x00'}, 0x10)
"""
_QUOTED_CALLS = "'" + _TYPED_CALLS.replace("'", "''") + "'"
_POINT = "'''([A-Za-z0-9_:.+-]+)\\\\x00'''"


@query(rf"""WITH t AS (SELECT doc_id, {_QUOTED_CALLS} || coalesce(text, '') AS text FROM documents), c AS (SELECT doc_id, text, {_sql_lines("text")} AS ls, {_CALLS} AS calls FROM t),
  m AS (SELECT *, {_sql_names(_sql_codes(_MAP_CODES), rp.MAP_TYPES)} AS maps, {_sql_names(_sql_codes(_LOADED), rp.PROGRAM_TYPES)} AS programs,
    list_filter(regexp_extract_all(text, {_POINT}, 1), lambda x: x <> 'GPL') AS points, list_filter([{', '.join(f"'{o}'" for o in rp.MAP_OPS)}], lambda o: contains(text, o)) AS ops,
    regexp_extract_all(text, '(?i)@([A-Za-z0-9_]*?(?:map|ringbuf|probe|trace|sock)[A-Za-z0-9_]*)', 1) AS helpers FROM c)
SELECT doc_id, array_to_string(({_sql_unique('calls')})[:40], '|') AS syscalls, array_to_string(ops, '|') AS map_ops,
  array_to_string(({_sql_unique("list_filter(calls, lambda q: " + _sql_starts('q', rp.SOCKET_LEADS) + ")")})[:32], '|') AS socket_ops,
  array_to_string(({_sql_unique('maps')})[:16], '|') AS map_types, array_to_string(({_sql_unique('programs')})[:16], '|') AS program_types, array_to_string(({_sql_unique('points')})[:32], '|') AS tracepoints,
  array_to_string(({_sql_unique('helpers')})[:32], '|') AS helpers,
  array_to_string(list_filter(['repro:sockmap_or_sockhash', CASE WHEN len(programs) > 0 THEN 'repro:bpf_program' END, CASE WHEN len(points) > 0 THEN 'repro:tracepoint_attach' END,
    CASE WHEN list_contains(ops, 'MAP_DELETE_ELEM') THEN 'repro:bpf_map_delete_elem' END, CASE WHEN list_contains(ops, 'BPF_RAW_TRACEPOINT_OPEN') THEN 'repro:bpf_raw_tracepoint_open' END], lambda x: x IS NOT NULL), '|') AS derived,
  left(sha256(CASE WHEN length(text) > 6000 THEN left(text, 6000) || chr(10) || '...[truncated]...' ELSE text END), 16) AS excerpt FROM m""")
def trigger_semantics(spark: SparkSession, d: str) -> DataFrame:
    """All trigger facts of every text read as a reproducer program, behind calls that name map and program types."""
    sem = rp.reproducer_semantics(F.concat(F.lit(_TYPED_CALLS), F.coalesce("text", F.lit(""))), F.lit(""))
    names = {"syscalls": "syscalls", "bpf_map_ops": "map_ops", "socket_ops": "socket_ops", "bpf_map_types": "map_types", "bpf_program_types": "program_types", "tracepoints": "tracepoints", "bpf_helpers": "helpers", "semantic_tokens": "derived"}
    return _documents(spark, d).select("doc_id", sem.alias("s")).select("doc_id", *[F.array_join(f"s.{a}", "|").alias(b) for a, b in names.items()], tx.sha16(F.col("s.syz_repro_excerpt")).alias("excerpt"))


_SWITCHES = {"CONFIG_SHADOW": "CONFIG_KASAN", "CONFIG_TRACE": "CONFIG_LOCKDEP", "CONFIG_GUARD": "CONFIG_UBSAN"}


@query("""WITH e AS (SELECT CASE k WHEN 'CONFIG_SHADOW' THEN 'CONFIG_KASAN' WHEN 'CONFIG_TRACE' THEN 'CONFIG_LOCKDEP' WHEN 'CONFIG_GUARD' THEN 'CONFIG_UBSAN' END AS k, v
  FROM (SELECT unnest(map_keys(config_features)) AS k, unnest(map_values(config_features)) AS v FROM crash_cards))
SELECT k AS config_key, v AS config_value, count(*) AS n FROM e WHERE k IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2""")
def config_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each value of the known switches occurs in the cards' configurations, written out as configuration files; unknown switches and comments are skipped."""
    names = F.create_map(*[F.lit(x) for pair in _SWITCHES.items() for x in pair])
    known = F.transform(F.map_entries("config_features"), lambda e: F.concat(F.coalesce(F.try_element_at(names, e["key"]), e["key"]), F.lit("="), e["value"]))
    twice = F.concat(F.lit("# CONFIG_KASAN is not set\nCONFIG_INET is odd\n"), F.array_join(F.transform(F.filter(known, lambda x: x.startswith("CONFIG_KASAN=")), lambda x: F.concat(x, F.lit("-before"))), "\n"))
    text = F.concat_ws("\n", twice, F.array_join(known, "\n"))
    return _cards(spark, d, "config_features").select(F.explode(rp.config_features(text)).alias("config_key", "config_value")).groupBy("config_key", "config_value").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH q AS (SELECT card_id, bug.sanitizer AS a, bug.bug_type AS b, bug.access AS c, fault.primary_function AS p, list_transform(stack_semantic, lambda f: f.func)[:10] AS s FROM crash_cards),
  j AS (SELECT card_id, list_transform([coalesce(a, ''), coalesce(b, ''), coalesce(c, ''), coalesce(p, '')], lambda x: '"' || replace(replace(replace(replace(x, '\', '\\'), '"', '\"'), chr(9), '\t'), chr(10), '\n') || '"') AS h,
    list_transform(coalesce(s, []), lambda x: '"' || replace(replace(replace(replace(coalesce(x, ''), '\', '\\'), '"', '\"'), chr(9), '\t'), chr(10), '\n') || '"') AS l FROM q)
SELECT card_id, left(sha256('[' || array_to_string(h, ', ') || ', [' || array_to_string(l, ', ') || ']]'), 16) AS signature FROM j""")
def card_signature(spark: SparkSession, d: str) -> DataFrame:
    """A signature hash of every card over class, fault and stack."""
    c = _cards(spark, d, "card_id", "bug", "fault", "stack_semantic")
    stack = F.coalesce(fr.funcs(F.col("stack_semantic"), 10), tx.no_strings())
    return c.select("card_id", signature_hash([F.col("bug.sanitizer"), F.col("bug.bug_type"), F.col("bug.access"), F.col("fault.primary_function")], [stack]).alias("signature"))


# --- source search over the documents' lines -----------------------------------------------------------------------
def _sql_grep(pattern: str, limit: int = ss.CHAR_LIMIT) -> str:
    return f"""WITH {_LINE_TABLE}, m AS (SELECT path, lineno, line, path || ':' || lineno || ':' || line AS text FROM lines WHERE regexp_matches(line, '{pattern}')),
      s AS (SELECT *, sum(length(text) + 1) OVER (ORDER BY path, lineno) AS so_far FROM m)
      SELECT path, lineno::INT AS lineno, text, so_far > {limit} AS cut FROM s WHERE so_far - length(text) - 1 <= {limit}"""


_GREP_COLUMNS = ["path", "lineno", "text", "cut"]


@query(_sql_grep(r"cannot (clone|walk)"))
def source_grep(spark: SparkSession, d: str) -> DataFrame:
    """Lines that match a pattern, within the character limit."""
    return ss.grep(_lines(spark, d), "cannot (clone|walk)").select(*_GREP_COLUMNS)


@query(_sql_grep(r"\bbatch_lock\b"))
def source_symbol(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a symbol as a word."""
    return ss.search_symbol(_lines(spark, d), "batch_lock").select(*_GREP_COLUMNS)


@query(_sql_grep(r"(^|[^A-Za-z0-9_])close\s*\("))
def source_callers(spark: SparkSession, d: str) -> DataFrame:
    """Lines that call a function."""
    return ss.find_callers(_lines(spark, d), "close").select(*_GREP_COLUMNS)


@query(_sql_grep(r"(->|\.)refcount\b"))
def source_field_usage(spark: SparkSession, d: str) -> DataFrame:
    """Lines that reach a field."""
    return ss.find_field_usage(_lines(spark, d), "refcount").select(*_GREP_COLUMNS)


@query(f"""WITH {_LINE_TABLE} SELECT path, array_to_string(list(printf('%s %5d: %s', CASE WHEN lineno = 3 THEN '=>' ELSE '  ' END, lineno, line) ORDER BY lineno), chr(10)) AS source
  FROM lines WHERE lineno BETWEEN 1 AND 8 GROUP BY path""")
def line_window(spark: SparkSession, d: str) -> DataFrame:
    """Numbered lines around the third line of every text."""
    lines = _lines(spark, d)
    spots = lines.select("path").distinct().withColumn("around", F.lit(3))
    return pf.line_windows(lines, spots, 2, 5).select("path", "source")


@query(rf"""WITH {_LINE_TABLE}, c AS (SELECT path, lineno, regexp_replace(line, '"(?:\\.|[^"\\])*"', '""', 'g') AS code FROM lines),
  s AS (SELECT path, lineno, sum(length(code) - length(replace(code, '{{', '')) - length(code) + length(replace(code, '}}', ''))) OVER (PARTITION BY path ORDER BY lineno) AS level FROM c)
SELECT path, max(level)::BIGINT AS deepest, arg_max(level, lineno)::BIGINT AS at_end FROM s GROUP BY path""")
def brace_depth(spark: SparkSession, d: str) -> DataFrame:
    """Deepest and last brace level of every text."""
    from pyspark.sql import Window

    code = ss._code(_lines(spark, d)).withColumn("level", F.sum("depth").over(Window.partitionBy("path").orderBy("lineno")))
    return code.groupBy("path").agg(F.max("level").alias("deepest"), F.max_by("level", "lineno").alias("at_end"))


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '\b[A-Z][A-Z0-9_]{2,}\b'), lambda x: x NOT IN ('NULL', 'WARN', 'BUG', 'KERN')) AS m FROM documents)
SELECT doc_id, array_to_string((list_filter(m, lambda x, i: list_position(m, x) = i))[:8], '|') AS macros FROM t""")
def macro_names(spark: SparkSession, d: str) -> DataFrame:
    """Upper-case names of every text."""
    return _documents(spark, d).select("doc_id", F.array_join(ql.macro_candidates(F.col("text")), "|").alias("macros"))


@query(rf"""WITH {_LINE_TABLE}, m AS (SELECT lineno, unnest(list_filter(regexp_extract_all(line, '\b[A-Z][A-Z0-9_]{{2,}}\b'), lambda x: x NOT IN ('NULL', 'WARN', 'BUG', 'KERN'))) AS macro FROM lines)
SELECT macro, abs(min(lineno) - 5)::INT AS distance FROM m GROUP BY macro ORDER BY 2, 1 LIMIT 8""")
def nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    """Upper-case names by their nearness to a line."""
    return ql.ranked_macros(_lines(spark, d), 5)


_WRAPPED = f"""wrapped AS (SELECT doc_id, 'static int probe_doc(void)' || chr(10) || '{{' || chr(10) || coalesce(text, '') || chr(10) || '}}' || chr(10) AS w FROM documents),
  lines AS (SELECT doc_id, unnest({_sql_lines('w')}) AS line, generate_subscripts({_sql_lines('w')}, 1) AS lineno FROM wrapped)"""


@query(rf"""WITH {_WRAPPED}, c AS (SELECT doc_id, lineno, regexp_replace(line, '"(?:\\.|[^"\\])*"', '""', 'g') AS code FROM lines WHERE lineno >= 2),
  s AS (SELECT doc_id, lineno, sum(length(code) - length(replace(code, '{{', '')) - length(code) + length(replace(code, '}}', ''))) OVER (PARTITION BY doc_id ORDER BY lineno) AS level FROM c)
SELECT doc_id, 1 AS start_line, coalesce(min(lineno) FILTER (level <= 0), 2)::INT AS end_line FROM s GROUP BY doc_id""")
def source_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of a function in every text, each text being its body."""
    body = F.concat(F.lit("static int probe_doc(void)\n{\n"), F.coalesce("text", F.lit("")), F.lit("\n}\n"))
    lines = ss.source_lines(_documents(spark, d).select(F.col("doc_id").cast("string").alias("path"), body.alias("text")))
    wanted = _documents(spark, d).select(F.col("doc_id").cast("string").alias("path"), F.lit("probe_doc").alias("symbol"), F.lit(None).cast("int").alias("around"))
    return ss.function_bounds(lines, wanted).select(F.col("path").cast("long").alias("doc_id"), "start_line", "end_line")


# --- evidence, cause cards ---------------------------------------------------------------------------------------
@query("""WITH p AS (SELECT card_id, list_filter(string_split(fault.primary_file, '/'), lambda x: x <> '') AS p FROM crash_cards WHERE fault.primary_file IS NOT NULL)
SELECT card_id, CASE WHEN len(p) = 0 THEN '' WHEN p[1] = 'drivers' AND len(p) >= 3 THEN array_to_string(p[:3], '/') || '/' ELSE array_to_string(p[:2], '/') || '/' END AS scope FROM p""")
def domain_scope(spark: SparkSession, d: str) -> DataFrame:
    """Source area of every card's fault."""
    return _cards(spark, d, "card_id", "fault").filter("fault.primary_file IS NOT NULL").select("card_id", ql.domain_scope(F.col("fault.primary_file")).alias("scope"))


def _sql_quality() -> str:
    st = lambda x: f"coalesce({_strip(x)}, '')"
    parts = lambda x: f"list_filter(string_split({x}, '/'), lambda p: p <> '')"
    scope = lambda x: f"(array_to_string(({parts(x)})[:CASE WHEN ({parts(x)})[1] = 'drivers' AND len({parts(x)}) >= 3 THEN 3 ELSE 2 END], '/') || '/')"
    files = ", ".join(f"'{n}'" for n in fr.CAUSE_GENERIC_FILES)
    sinks = ", ".join(f"'{n}'" for n in fr.LOW_VALUE_SINKS)
    trig = " OR ".join(f"coalesce(len(reproducer_semantics.{k}) > 0, false)" for k in ql.TRIGGER_LISTS)
    some = lambda k: f"coalesce(len(list_filter(sanitizer_context.{k}, lambda f: f IS NOT NULL)) > 0, false)"
    return f"""WITH a AS (SELECT *, coalesce(list_filter(stack_semantic, lambda f: f IS NOT NULL), []) AS st, {st('fault.primary_function')} AS func, {st('fault.primary_file')} AS file,
        (coalesce(len(repro.syscall_hints) > 0, false) OR coalesce(repro.has_syz_repro, false) OR coalesce(repro.has_c_repro, false) OR {trig} OR coalesce(reproducer_semantics.syz_repro_excerpt <> '', false)) AS rep,
        {some('alloc_trace')} AS al, {some('free_trace')} AS fe, {some('origin_trace')} AS ori, coalesce(len(anchor_trace), 0) AS anchor FROM crash_cards),
      b AS (SELECT *, list_filter(st, lambda f: NOT {_sql_cause_generic('f')} AND {st('f.file')} <> '') AS dom FROM a),
      c AS (SELECT *, CASE WHEN len(dom) > 0 THEN {scope(st('dom[1].file'))} WHEN file <> '' AND file NOT IN ({files}) AND NOT {_sql_starts('file', fr.CAUSE_GENERIC_PATHS)} THEN {scope('file')} ELSE '' END AS prefix FROM b),
      e AS (SELECT *, least(4, len(list_distinct(list_transform(list_filter(dom, lambda f: {st('f.func')} <> '' AND (prefix = '' OR starts_with({st('f.file')}, prefix))),
        lambda f: {st('f.file')} || '|' || {st('f.func')} || '|' || coalesce(f.line, -1)::VARCHAR)))) AS nd, len(st) AS ns, func <> '' AND file <> '' AS loc,
        CASE WHEN len(st) > 0 THEN {st('st[1].func')} ELSE func END AS topf, CASE WHEN len(st) > 0 THEN {{'func': st[1].func, 'file': st[1].file}} ELSE {{'func': func, 'file': file}} END AS topfr FROM c),
      g AS (SELECT *, (topf IN ({sinks}) OR {_sql_starts('lower(topf)', ['__warn', 'warn_', 'dump_stack'])} OR {_sql_cause_generic('topfr')}) AND nd = 0 AS sink,
        contains(lower(coalesce(bug.bug_type, '')), 'use-after-free') AND upper(coalesce(bug.sanitizer, '')) IN ('KASAN', 'KMSAN') AND NOT (al AND fe) AS uaf,
        upper(coalesce(bug.sanitizer, '')) = 'KMSAN' AND contains(lower(coalesce(bug.bug_type, '')), 'uninit') AND NOT ori AS uni,
        (ns = 0 AND NOT loc) OR (ns <= 1 AND NOT rep AND NOT al AND NOT fe AND NOT ori) OR (NOT loc AND nd = 0 AND NOT rep) AS minimal, NOT loc OR ns <= 2 OR anchor = 0 AS weak FROM e),
      h AS (SELECT *, CASE WHEN minimal THEN 'low' WHEN sink THEN CASE WHEN ns >= 3 OR rep THEN 'medium' ELSE 'low' END WHEN weak OR uaf OR uni THEN 'medium' ELSE 'none' END AS cap FROM g)
      SELECT card_id, CASE WHEN minimal THEN 'minimal' WHEN sink OR weak THEN 'limited' ELSE 'sufficient' END AS tier, cap AS confidence_cap, nd::INT AS domain_frames, rep AS has_repro,
        CASE WHEN minimal THEN 'minimal' WHEN sink OR weak THEN 'short' ELSE 'normal' END AS rounds,
        array_to_string(list_sort(list_filter([CASE WHEN ns = 0 THEN 'no_stack' END, CASE WHEN anchor = 0 THEN 'no_anchor_trace' END, CASE WHEN func = '' THEN 'missing_primary_function' END, CASE WHEN file = '' THEN 'missing_primary_file' END,
          CASE WHEN sink THEN 'generic_or_low_value_sink_only' END, CASE WHEN uaf THEN 'uaf_missing_alloc_or_free_trace' END, CASE WHEN uni THEN 'kmsan_missing_origin_trace' END], lambda x: x IS NOT NULL)), '|') AS reasons,
        split_part(CASE WHEN minimal THEN 'Crash evidence is minimal. ' WHEN cap = 'medium' THEN 'Crash evidence is limited or a sanitizer-specific trace is incomplete. ' ELSE 'Crash evidence is sufficient for normal source-guided representation. ' END, '.', 1) AS instruction FROM h"""


@query(_sql_quality())
def quality_tier(spark: SparkSession, d: str) -> DataFrame:
    """Input quality of every card."""
    cards = ql.input_quality(_cards(spark, d, "card_id", "bug", "fault", "repro", "reproducer_semantics", "stack_semantic", "anchor_trace", "sanitizer_context"))
    q = "input_quality"
    return cards.select("card_id", f"{q}.tier", f"{q}.confidence_cap", F.col(f"{q}.metrics.domain_frame_count").alias("domain_frames"), F.col(f"{q}.metrics.has_reproducer_semantics").alias("has_repro"),
        F.col(f"{q}.recommended_tool_rounds").alias("rounds"), F.array_join(f"{q}.missing_or_weak_evidence", "|").alias("reasons"), F.substring_index(f"{q}.model_instruction", ".", 1).alias("instruction"))


@query("""WITH b AS (SELECT doc_id, source, text, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM documents WHERE text IS NOT NULL)
SELECT doc_id, source FROM b WHERE coalesce(before, 0) <= 28000""")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source, in order, up to a budget of characters."""
    docs = table(spark, d, "documents", "doc_id", "source", "text").filter("text IS NOT NULL").withColumn("size", F.length("text"))
    return ql.running_budget(docs, "source", "doc_id", "size", ql.TEXT_BUDGET).select("doc_id", "source")


@query(f"""WITH f AS (SELECT card_id, list_filter(list_transform(stack_semantic, lambda f: f.raw), lambda x: x IS NOT NULL AND {_strip('x')} <> '') AS l FROM crash_cards WHERE stack_semantic IS NOT NULL)
SELECT card_id, CASE WHEN len(l) = 0 THEN '' ELSE array_to_string((list_reduce(list_transform(l, lambda x: {{'k': [x], 'u': length(x)}}), lambda a, b: CASE WHEN a.u + b.u <= 150 THEN {{'k': a.k || b.k, 'u': a.u + b.u}} ELSE a END)).k, '|') END AS kept FROM f""")
def budget_pack(spark: SparkSession, d: str) -> DataFrame:
    """Frames' raw lines of each card that fit a budget one after the other."""
    c = _cards(spark, d, "card_id", "stack_semantic").filter("stack_semantic IS NOT NULL")
    return c.select("card_id", F.array_join(ql.packed(F.transform("stack_semantic", lambda f: f["raw"]), 150), "|").alias("kept"))


_BODY = r"""CASE WHEN json_valid(body) THEN body WHEN json_valid(regexp_extract(body, '(?s)```(?:json)?\s*\n?(.*?)\n?```', 1)) THEN regexp_extract(body, '(?s)```(?:json)?\s*\n?(.*?)\n?```', 1)
  WHEN json_valid(regexp_extract(body, '(?s)\{.*\}')) THEN regexp_extract(body, '(?s)\{.*\}') END"""


@query(rf"WITH j AS (SELECT raw_id, {_BODY} AS doc FROM raw_cause_cards) SELECT raw_id, doc ->> '$.cause_id' AS cause_id, doc ->> '$.source_bucket' AS source_bucket FROM j WHERE doc IS NOT NULL AND json_type(doc) = 'OBJECT'")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    """The JSON in every model answer."""
    docs = table(spark, d, "raw_cause_cards", "raw_id", "body").select("raw_id", cc.extract_json(F.col("body")).alias("v"))
    return docs.filter(cc.is_object(F.col("v"))).select("raw_id", F.try_variant_get("v", "$.cause_id", "string").alias("cause_id"), F.try_variant_get("v", "$.source_bucket", "string").alias("source_bucket"))


@query(rf"""WITH j AS (SELECT raw_id, {_BODY} AS doc FROM raw_cause_cards), o AS (SELECT raw_id, doc::JSON AS v FROM j WHERE doc IS NOT NULL AND json_type(doc) = 'OBJECT'),
  x AS (SELECT raw_id, CASE WHEN json_type(v, '$.violated_invariant') = 'OBJECT' THEN v ->> '$.violated_invariant.expected' END AS e, CASE WHEN json_type(v, '$.violated_invariant') = 'OBJECT' THEN v ->> '$.violated_invariant.actual' END AS a,
    CASE WHEN json_type(v, '$.violated_invariant') = 'VARCHAR' THEN v ->> '$.violated_invariant' END AS p, CASE WHEN json_type(v, '$.violated_invariant') = 'OBJECT' THEN v ->> '$.violated_invariant.invariant' END AS i FROM o),
  s AS (SELECT *, coalesce(i, CASE WHEN e IS NOT NULL OR a IS NOT NULL THEN 'expected: ' || coalesce(e, 'None') || '; actual: ' || coalesce(a, 'None') END, p) AS said FROM x)
SELECT raw_id, 'I1' AS invariant_id, coalesce(e, said) AS expected, coalesce(a, said) AS violation, 'E1' AS basis, 'indirect' AS evidence_level, CASE WHEN e IS NOT NULL THEN 'high' ELSE 'medium' END AS weight FROM s WHERE said IS NOT NULL""")
def cause_invariants(spark: SparkSession, d: str) -> DataFrame:
    """The violated invariant of every model answer, whatever its layout, with its evidence from the ledger."""
    docs = _answers(spark, d)
    found = cc.invariant_signals(F.col("v"), _ledger())
    return docs.select("raw_id", F.explode(found).alias("i")).select("raw_id", "i.invariant_id", "i.expected", F.col("i.observed_or_suspected_violation").alias("violation"), F.array_join("i.source_basis", ",").alias("basis"), "i.evidence_level", F.col("i.dedup_weight").alias("weight"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Every model answer that holds a JSON object: ``raw_id, v``."""
    return table(spark, d, "raw_cause_cards", "raw_id", "body").select("raw_id", cc.extract_json(F.col("body")).alias("v")).filter(cc.is_object(F.col("v")))


def _ledger() -> Column:
    v = F.col("v")
    return cc.evidence_ledger(v, F.try_variant_get(v, "$.source_crash_id", "string"), F.lit("a title"), F.array(F.lit("anchor_a "), F.lit(""), F.lit("anchor_b")), cc.root_locations(v), cc.source_evidence(v))


@query()
def cause_cards_v3(spark: SparkSession, d: str) -> DataFrame:
    """Every model answer as a normalized cause card, with the most complete crash card of its case or, if it has none, without one."""
    raws = table(spark, d, "raw_cause_cards", "raw_id", "body").select("raw_id", cc.extract_json(F.col("body")).alias("raw")).filter(cc.is_object(F.col("raw")))
    raws = raws.withColumn("case_id", F.try_variant_get("raw", "$.source_crash_id", "string"))
    cards = bk.best_of_case(_cards(spark, d), "card_id").withColumnRenamed("cluster_key", "small_bucket_id")
    joined = raws.join(cards, "case_id", "left").withColumn("hash_part", F.right(F.col("small_bucket_id"), F.lit(8)))
    card = cc.normalize_cause_cards(joined)
    return card.select("cause_id", "source_crash_id", F.col("representation_confidence.level").alias("level"), F.col("input_quality.tier").alias("tier"), F.array_join("dedup_representation.must_match_tokens", "|").alias("must"), F.size("evidence_ledger").alias("evidence"))


@query("""WITH c AS (SELECT cause_row, lower(coalesce(representation_confidence.level, '')) AS lv, dedup_representation AS r,
   CASE WHEN representation_confidence.stable_token_count <= 3 THEN 'low' WHEN representation_confidence.stable_token_count <= 6 THEN 'medium' ELSE 'none' END AS cap FROM cause_cards),
  k AS (SELECT *, CASE WHEN lv = 'low' THEN 0 WHEN lv = 'high' THEN 2 ELSE 1 END AS rk, CASE cap WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 9 END AS ck FROM c),
  w AS (SELECT *, list_filter(list_transform(coalesce(r.weak_context_tokens, []) || coalesce(r.must_match_tokens, []) || coalesce(r.should_match_tokens, []) || coalesce(r.primary_root_tokens, []), lambda x: trim(x, E' \t\r\n')), lambda x: x <> '') AS al FROM k)
SELECT cause_row, CASE WHEN rk > ck THEN cap ELSE lv END AS level, CASE WHEN cap = 'low' THEN len(list_filter(al, lambda x, i: list_position(al, x) = i)) ELSE coalesce(len(r.weak_context_tokens), 0) END AS n_weak,
  CASE WHEN cap = 'low' THEN 0 ELSE coalesce(len(r.must_match_tokens), 0) END AS n_must FROM w""")
def cap_demote(spark: SparkSession, d: str) -> DataFrame:
    """Confidence caps applied to every cause card."""
    n = F.col("representation_confidence.stable_token_count")
    cap = F.when(n <= 3, "low").when(n <= 6, "medium").otherwise("none")
    quality = F.struct(cap.alias("confidence_cap"), F.lit("t").alias("tier"), tx.no_strings().alias("missing_or_weak_evidence"), F.lit("").alias("model_instruction"))
    doubts = F.array().cast("array<struct<aspect:string,reason:string,needed_evidence:string,dedup_impact:string>>")
    cards = table(spark, d, "cause_cards", "cause_row", "representation_confidence", "dedup_representation").withColumns({"input_quality": quality, "uncertainty": doubts})
    capped = cc.capped_by_quality(cards)
    weak = F.col("dedup_representation.weak_context_tokens")
    count = lambda x: F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0)).cast("long")
    return capped.select("cause_row", F.lower(F.coalesce("representation_confidence.level", F.lit(""))).alias("level"), count(weak).alias("n_weak"), count(F.col("dedup_representation.must_match_tokens")).alias("n_must"))


# --- tokens and fields --------------------------------------------------------------------------------------------
@query(f"""WITH t AS (SELECT DISTINCT unnest(dedup_representation.must_match_tokens || dedup_representation.should_match_tokens) AS token FROM cause_cards)
SELECT token, {_sql_canonical('token')} AS canonical FROM t WHERE token IS NOT NULL""")
def canonical_token(spark: SparkSession, d: str) -> DataFrame:
    """Canonical form of every token."""
    t = table(spark, d, "cause_cards", "dedup_representation").select(F.explode(F.concat("dedup_representation.must_match_tokens", "dedup_representation.should_match_tokens")).alias("token")).filter("token IS NOT NULL").distinct()
    return t.select("token", tx.canonical_token(F.col("token")).alias("canonical"))


@query(rf"""WITH t AS (SELECT DISTINCT unnest(dedup_representation.surface_tokens) AS token FROM cause_cards),
  c AS (SELECT token, regexp_replace(regexp_replace(lower({_strip('token')}), '\s+', '_', 'g'), '[^a-z0-9_:\-./>\[\]]+', '_', 'g') AS x FROM t WHERE token IS NOT NULL)
SELECT token, regexp_replace(regexp_replace(x, '_+', '_', 'g'), '^_|_$', '', 'g') AS clean FROM c""")
def clean_token(spark: SparkSession, d: str) -> DataFrame:
    """Clean form of every surface token."""
    t = table(spark, d, "cause_cards", "dedup_representation").select(F.explode("dedup_representation.surface_tokens").alias("token")).filter("token IS NOT NULL").distinct()
    return t.select("token", tx.clean_token(F.col("token")).alias("clean"))


@query(f"""WITH t AS (SELECT cause_row, {_sql_tokens('dedup_representation.must_match_tokens')} AS l FROM cause_cards)
SELECT cause_row, array_to_string(({_sql_unique('l')})[:5], '|') AS tokens FROM t WHERE l IS NOT NULL""")
def ordered_unique_topk(spark: SparkSession, d: str) -> DataFrame:
    """The first five distinct tokens of every card."""
    c = table(spark, d, "cause_cards", "cause_row", "dedup_representation").filter("dedup_representation.must_match_tokens IS NOT NULL")
    return c.select("cause_row", F.array_join(F.slice(tx.ordered_unique(F.col("dedup_representation.must_match_tokens")), 1, 5), "|").alias("tokens"))


def _sql_fields() -> str:
    rep = lambda k: f"coalesce({_sql_tokens(f'dedup_representation.{k}')}, [])"
    led = lambda leads: f"list_filter(m, lambda t: {_sql_starts('t', leads)})"
    clean = lambda x: rf"coalesce(trim(regexp_replace(replace({x}, '->', ' -> '), '\s+', ' ', 'g')), '')"
    flow = f"""list_transform(list_filter(coalesce(propagation_signals, []), lambda p: p.dedup_weight IN ('high', 'medium') AND ({clean('p."from"')} <> '' OR {clean('p."to"')} <> '')),
      lambda p: {_sql_canonical("('flow:' || " + clean('p."from"') + " || '->' || " + clean('p."to"') + " || ' via ' || " + clean('p.mechanism') + ")")})"""
    u = lambda x: _sql_unique(x)
    return f"""WITH a AS (SELECT cause_row, {rep('must_match_tokens')} AS m, {rep('should_match_tokens')} AS s, {rep('bridge_tokens')} || {flow} AS p FROM cause_cards),
      b AS (SELECT cause_row, {u('m')} AS m, {u('s')} AS s, {u('p')} AS p FROM a),
      c AS (SELECT *, {led(ft.LEADS['object'])} AS o, {led(ft.LEADS['invariant'])} AS i, {led(ft.LEADS['patch'])} AS h FROM b),
      e AS (SELECT *, o || i || p || h AS covered FROM c)
      SELECT cause_row, array_to_string(o, '|') AS object, array_to_string(i, '|') AS invariant, array_to_string(p, '|') AS propagation, array_to_string(h, '|') AS patch,
        array_to_string(list_filter(m, lambda t: NOT list_contains(covered, t)), '|') AS must, array_to_string(list_filter(s, lambda t: NOT list_contains(covered, t)), '|') AS should FROM e"""


def _feature_rows(spark: SparkSession, d: str) -> DataFrame:
    return ft.final_fields(ft.token_fields(table(spark, d, "cause_cards", "cause_row", "cause_id", "dedup_representation", "propagation_signals", "crash_surface")))


@query(_sql_fields())
def final_fields(spark: SparkSession, d: str) -> DataFrame:
    """The six token fields of every cause card."""
    return _feature_rows(spark, d).select("cause_row", *[F.array_join(f"fields.{k}", "|").alias(k) for k in ft.FINAL_FIELDS])


@query("WITH f AS (" + _sql_fields() + "), j AS (SELECT f.*, r.true_label, coalesce(r.weight, 1.0) AS weight FROM f JOIN cause_cards c USING (cause_row) JOIN feature_rows r ON r.cause_card_id = c.cause_id) SELECT count(*) AS records, count(DISTINCT true_label) AS labels, round(sum(weight), 3) AS total_weight, "
       + ", ".join(f"count(*) FILTER (nullif({k}, '') IS NOT NULL) AS nonempty_{k}" for k in ft.FINAL_FIELDS) + " FROM j")
def feature_summary(spark: SparkSession, d: str) -> DataFrame:
    """Labels, total weight and fields filled over the records' cards."""
    records = table(spark, d, "feature_rows", F.col("cause_card_id").alias("cause_id"), "true_label", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    return ft.feature_summary(_feature_rows(spark, d).join(records, "cause_id")).withColumn("total_weight", F.round("total_weight", 3))


_WORDS = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(t, ':', ' '), '->', '.'), '[\[\]{}<>\"''`]', ' ', 'g'), '[_/\\|,;]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH a AS (SELECT cause_row, coalesce({_sql_tokens('dedup_representation.should_match_tokens')}, []) AS l FROM cause_cards), b AS (SELECT cause_row, {_sql_unique('l')} AS l FROM a)
SELECT cause_row, CASE WHEN len(l) = 0 THEN '' ELSE '[should]' || chr(10) || array_to_string(list_transform(l, lambda t: 'token: ' || t || CASE WHEN {_WORDS} <> '' AND {_WORDS} <> t THEN ' ; words: ' || {_WORDS} ELSE '' END), chr(10)) END AS field_text FROM b""")
def field_text(spark: SparkSession, d: str) -> DataFrame:
    """The text of a field for embedding."""
    c = table(spark, d, "cause_cards", "cause_row", "dedup_representation")
    return c.select("cause_row", tx.format_field("should", tx.ordered_unique(F.col("dedup_representation.should_match_tokens"))).alias("field_text"))


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 300) || chr(10) || '[truncated]' ELSE text END AS capped FROM documents")
def capped_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut at a number of characters, with a note."""
    return _documents(spark, d).select("doc_id", tx.capped(F.col("text"), 300).alias("capped"))


# --- vectors, clustering, metrics ----------------------------------------------------------------------------------
_UNIT = "list_transform({v}::DOUBLE[], lambda x: CASE WHEN {n} > 0 THEN x / {n} ELSE x END)"


@query("""WITH n AS (SELECT vec_id, vector::DOUBLE[] AS v, sqrt(list_sum(list_transform(vector::DOUBLE[], lambda x: x * x))) AS n FROM vectors WHERE vector IS NOT NULL)
SELECT vec_id, round(n, 5) AS norm, array_to_string(list_transform(v, lambda x: round(1000 * CASE WHEN n > 0 THEN x / n ELSE x END)::BIGINT), '|') AS thousandths FROM n""")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Vectors at length 1."""
    v = table(spark, d, "vectors", "vec_id", "vector").filter("vector IS NOT NULL")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    whole = F.array_join(F.transform(em.unit(F.col("vector")), lambda x: F.round(1000 * x).cast("long").cast("string")), "|")
    return v.select("vec_id", F.round(norm, 5).alias("norm"), whole.alias("thousandths"))


@query("SELECT vec_id, len(vector[:16]) AS dims, round(list_sum(vector[:16]::DOUBLE[]), 4) AS total FROM vectors WHERE vector IS NOT NULL")
def truncate_dims(spark: SparkSession, d: str) -> DataFrame:
    """The first numbers of every vector."""
    v = table(spark, d, "vectors", "vec_id", "vector").filter("vector IS NOT NULL").select("vec_id", em.truncated(F.col("vector"), 16).alias("v"))
    return v.select("vec_id", F.size("v").cast("long").alias("dims"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query("""WITH n AS (SELECT label, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
  u AS (SELECT label, unnest(list_transform(v, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END)) AS x, generate_subscripts(v, 1) AS i FROM n),
  s AS (SELECT label, i, sum(x) AS x FROM u GROUP BY label, i), m AS (SELECT label, sqrt(sum(x * x)) AS n FROM s GROUP BY label)
SELECT label, i::INT AS dim, round(x / n, 4) AS value FROM s JOIN m USING (label)""")
def combine_fields(spark: SparkSession, d: str) -> DataFrame:
    """Unit vectors summed per group, at length 1."""
    c = em.combined(table(spark, d, "embeddings", "label", "embedding"), "label", "embedding", 64)
    return c.select("label", F.posexplode("vector").alias("p", "v")).select("label", (F.col("p") + 1).alias("dim"), F.round(F.col("v").cast("double"), 4).alias("value"))


_ITEMS = "SELECT vec_id AS item, coalesce(true_label, 'None') AS label, CASE WHEN vector IS NULL THEN 'noise:' || vec_id ELSE list_position(vector, list_max(vector))::VARCHAR END AS cluster, coalesce(weight, 1.0)::DOUBLE AS w FROM vectors"


def _items(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vectors", "vec_id", "vector", "true_label", "weight")
    return v.select(F.col("vec_id").alias("item"), F.col("true_label").alias("label"), F.coalesce(F.array_position("vector", F.array_max("vector")), F.lit(-1)).alias("pred"), "weight")


@query(f"""WITH i AS ({_ITEMS}), c AS (SELECT label, cluster, sum(w) AS w FROM i GROUP BY 1, 2), l AS (SELECT label, sum(w) AS lw FROM i GROUP BY 1), k AS (SELECT cluster, sum(w) AS cw FROM i GROUP BY 1),
  t AS (SELECT sum(w) AS t FROM i), p AS (SELECT sum(m) AS p FROM (SELECT max(w) AS m FROM c GROUP BY cluster)),
  f AS (SELECT label, lw, max(w / lw) AS r, max(2 * (w / cw) * (w / lw) / (w / cw + w / lw)) AS f FROM c JOIN l USING (label) JOIN k USING (cluster) WHERE w > 0 GROUP BY label, lw)
SELECT round(p / t, 5) AS purity, round((SELECT sum(lw * r) FROM f) / t, 5) AS inverse_purity, round((SELECT sum(lw * f) FROM f) / t, 5) AS f_measure, (SELECT count(*) FROM k) AS cluster_count, (SELECT count(*) FROM l) AS label_count FROM p, t""")
def weighted_purity_f(spark: SparkSession, d: str) -> DataFrame:
    """Weighted agreement of a clustering with the labels."""
    m = mt.weighted_purity_f(_items(spark, d))
    return m.select(*[F.round(c, 5).alias(c) for c in ("purity", "inverse_purity", "f_measure")], "cluster_count", "label_count")


@query(f"""WITH i AS ({_ITEMS}), g AS (SELECT sum(w) AS s, sum(w * w) AS q, 1 AS k FROM i GROUP BY label, cluster UNION ALL SELECT sum(w), sum(w * w), 2 FROM i GROUP BY cluster UNION ALL SELECT sum(w), sum(w * w), 3 FROM i GROUP BY label),
  h AS (SELECT k, sum((s * s - q) / 2) AS h FROM g GROUP BY k), x AS (SELECT max(h) FILTER (k = 1) AS tp, max(h) FILTER (k = 2) AS c, max(h) FILTER (k = 3) AS l FROM h)
SELECT round(tp / c, 5) AS pair_precision, round(tp / l, 5) AS pair_recall, round(tp, 1) AS pair_tp_weight FROM x""")
def pairwise_counts(spark: SparkSession, d: str) -> DataFrame:
    """Weighted pair counts of a clustering against the labels."""
    return mt.pairwise_counts(_items(spark, d)).select(F.round("pair_precision", 5).alias("pair_precision"), F.round("pair_recall", 5).alias("pair_recall"), F.round("pair_tp_weight", 1).alias("pair_tp_weight"))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    return lk.threshold_grid(e.withColumn("record_id", F.format_string("%09d", "vec_id")), None, "record_id", "embedding")


@query()
def agglomerative_grid(spark: SparkSession, d: str) -> DataFrame:
    """Average linkage cut at every threshold."""
    return _grid(spark, d).drop("labels", "block")


@query()
def select_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The threshold chosen by silhouette, with its agreement with the labels."""
    truth = table(spark, d, "embeddings", "vec_id", "label").select(F.format_string("%09d", "vec_id").alias("record_id"), F.col("label").cast("string").alias("true_label"), F.lit(1.0).alias("weight"))
    return lk.select_by_silhouette(lk.with_external_metrics(_grid(spark, d), truth)).drop("block")


_KEY = "sha256('m'::BLOB || '\\x00\\x00'::BLOB || encode(text))"


@query(f"""WITH k AS (SELECT {_KEY} AS cache_key, coalesce(source, '') = 'list_mail' AS cached FROM documents WHERE {_strip('text')} <> '')
SELECT cache_key FROM k GROUP BY cache_key HAVING NOT bool_or(cached)""")
def cache_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the distinct texts that a cache of one source's texts lacks."""
    docs = table(spark, d, "documents", "source", "text")
    cache = docs.filter("source = 'list_mail'").select(em.cache_key(F.col("text"), "m").alias("cache_key"))
    return em.cache_misses(docs, cache, "m").select("cache_key")


@query(f"""WITH k AS (SELECT {_KEY} AS cache_key, doc_id, epoch_us(created_at) AS ts FROM documents WHERE text IS NOT NULL AND created_at IS NOT NULL)
SELECT cache_key, dim FROM (SELECT cache_key, (doc_id % 7)::INT AS dim, row_number() OVER (PARTITION BY cache_key ORDER BY ts DESC, doc_id DESC) AS r FROM k) WHERE r = 1""")
def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The entry of every cached text that the last write left."""
    docs = table(spark, d, "documents", "doc_id", "text", "created_at").filter("text IS NOT NULL AND created_at IS NOT NULL")
    at = F.unix_micros("created_at") / 1e6
    rows = docs.select(em.cache_key(F.col("text"), "m").alias("cache_key"), F.lit("m").alias("model"), F.format_string("%012d", "doc_id").alias("text_sha256"), (F.col("doc_id") % 7).cast("int").alias("dim"), F.array(F.lit(1.0).cast("float")).alias("vector"), at.alias("created_at"))
    return em.latest_cache(rows).select("cache_key", "dim")


# --- resume, manifests, lookups ------------------------------------------------------------------------------------
@query("SELECT DISTINCT big_bucket, case_id FROM crash_cards c WHERE NOT EXISTS (SELECT 1 FROM case_labels l WHERE l.case_id = c.case_id)")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    """Cases without a result (here: without labels)."""
    return ar.pending(_cards(spark, d, "big_bucket", "case_id").distinct(), _labels(spark, d), ["case_id"]).select("big_bucket", "case_id")


@query("SELECT DISTINCT big_bucket, case_id, EXISTS (SELECT 1 FROM case_labels l WHERE l.case_id = c.case_id) AS \"exists\" FROM crash_cards c")
def manifest_exists(spark: SparkSession, d: str) -> DataFrame:
    """All cases with whether they have a result."""
    return ar.manifest(_cards(spark, d, "big_bucket", "case_id").distinct(), _labels(spark, d), ["case_id"]).select("big_bucket", "case_id", "exists")


@query("SELECT cause_id AS path FROM cause_cards WHERE cause_id IN (SELECT cause_card_id FROM feature_rows)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Listed cause cards that exist among the records' cards."""
    listed = table(spark, d, "cause_cards", F.concat(F.lit("lists/../"), "cause_id").alias("path"))
    there = table(spark, d, "feature_rows", F.concat(F.lit("/data/./cards/"), "cause_card_id").alias("path"))
    found, _ = ar.selected_cards(listed, there, "/data/cards")
    return found.select(F.replace("path", F.lit("/data/cards/"), F.lit("")).alias("path"))


@query("SELECT cause_id AS path FROM cause_cards WHERE cause_id NOT IN (SELECT cause_card_id FROM feature_rows WHERE cause_card_id IS NOT NULL)")
def missing_cards(spark: SparkSession, d: str) -> DataFrame:
    """Listed cause cards that no record has, which a run would warn of."""
    there = table(spark, d, "feature_rows", F.col("cause_card_id").alias("path"))
    return ar.selected_cards(table(spark, d, "cause_cards", F.col("cause_id").alias("path")), there)[1]


@query("""SELECT coalesce(f.true_label, '') || '/' || coalesce(f.copied_file_name, '') AS record_id, f.cause_card_id, coalesce(f.weight, 1.0) AS weight, coalesce(f.unique_case_count, f.weight, 1.0) AS cases
FROM feature_rows f JOIN cause_cards c ON c.cause_id = f.cause_card_id""")
def record_weights(spark: SparkSession, d: str) -> DataFrame:
    """Records with their cards and weights; a missing weight counts as 1, missing cases as the weight."""
    cards = table(spark, d, "cause_cards", F.col("cause_id").alias("cause_card_id"))
    rows = table(spark, d, "feature_rows", "cause_card_id", F.col("true_label").alias("directory_name"), "copied_file_name", F.col("weight").cast("string").alias("represented_crash_row_count"), F.col("unique_case_count").cast("string").alias("unique_case_count"))
    return ft.build_records(rows.join(cards, "cause_card_id", "left_semi"), cards, ["cause_card_id"]).select("record_id", "cause_card_id", "weight", F.col("unique_case_count").alias("cases"))
