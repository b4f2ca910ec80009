"""Queries of report parsing, source search and evidence over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frames as fr
from ..functions import reports as rp
from ..functions import text as tx
from ..operators import cards as cd
from ..operators import quality as ql
from ..operators import source_search as ss
from ..sources.tables import table
from . import catalog as base

QUERIES, SQL = {}, {}
query = base.registrar(QUERIES, SQL)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text")


# --- traces ---------------------------------------------------------------------------------------------------------
_LINES = f"""lines AS (SELECT doc_id AS id, unnest({base._sql_lines('text')}) AS line, generate_subscripts({base._sql_lines('text')}, 1) AS lineno FROM documents WHERE text <> '')"""


def _sql_bare(x: str) -> str:
    for lead in fr.LEADS:
        x = f"regexp_replace({x}, '{lead}', '')"
    return x


def _sql_canon(x: str) -> str:
    x = f"split_part(regexp_replace({x}, '\\+0x[0-9a-fA-F]+/0x[0-9a-fA-F]+', '', 'g'), '+', 1)"
    for suffix in ("cold", "isra", "constprop", "part", "llvm"):
        x = f"regexp_replace({x}, '\\.{suffix}(?:\\.\\d+)?$', '')"
    return x


def _sql_parsed(body: str) -> str:
    """CTEs that read ``body(id, lineno, line)`` as frames: ``parsed(id, lineno, raw, func, file, line_no, inline, blank, stops)``."""
    registers = "|".join(fr.REGISTERS)
    return rf"""q0 AS (SELECT id, lineno, {base._strip('line')} AS raw FROM {body}),
  q1 AS (SELECT *, CASE WHEN raw IN ('', '<TASK>', '</TASK>') OR regexp_matches(raw, '^(?:{registers}):') THEN NULL ELSE {_sql_bare('raw')} END AS s FROM q0),
  q2 AS (SELECT *, regexp_extract(s, '\b{base._PATH_SQL}', 1) AS file, regexp_extract(s, '\b{base._PATH_SQL}', 2) AS ln, CASE WHEN regexp_matches(s, '\b{base._PATH_SQL}') THEN regexp_extract(s, '(?s)^(.*?)\b{base._PATH_SQL}', 1) ELSE s END AS before FROM q1),
  q3 AS (SELECT *, regexp_extract({base._strip("replace(before, '[inline]', '')")}, '(\S+)$', 1) AS tok FROM q2),
  q4 AS (SELECT *, regexp_replace({_sql_canon('tok')}, '^[():]+|[():]+$', '', 'g') AS fn FROM q3),
  parsed AS (SELECT id, lineno, raw, CASE WHEN regexp_matches(fn, '^[A-Za-z_][A-Za-z0-9_.$]*$') THEN fn END AS func, nullif(file, '') AS file, TRY_CAST(nullif(ln, '') AS INT) AS line_no, contains(raw, '[inline]') AS inline,
    raw = '' AS blank, starts_with(raw, '</TASK>') OR {base._sql_starts('raw', [m.replace("'", "''") for m in fr.STOP_MARKERS])} AS stops FROM q4)"""


def _sql_trace(stops: str = "stops") -> str:
    """CTE ``trace``: the parsed frames before the line that ends a trace."""
    return f"""firsts AS (SELECT id, min(lineno) FILTER (func IS NOT NULL) AS f FROM parsed GROUP BY id),
  ends AS (SELECT id, least(coalesce(min(lineno) FILTER (blank AND lineno > f), 1000000000), coalesce(min(lineno) FILTER (NOT blank AND {stops}), 1000000000)) AS e FROM parsed JOIN firsts USING (id) GROUP BY id),
  trace AS (SELECT p.*, row_number() OVER (PARTITION BY id ORDER BY lineno) AS n FROM parsed p JOIN ends USING (id) WHERE func IS NOT NULL AND lineno < e)"""


_SHOWN = "func || '@' || coalesce(file, '') || ':' || coalesce(line_no::VARCHAR, '') || CASE WHEN inline THEN '!' ELSE '' END"
_TRACE_BODY = r"""starts AS (SELECT id, min(lineno) FILTER (regexp_matches(line, '^\s*Call [Tt]race:')) AS m, min(lineno) FILTER (regexp_matches(line, 'BUG:\s+(?:KASAN|KMSAN):')) AS b,
    min(lineno) FILTER (regexp_matches(line, '(?:WARNING|BUG):.*\s+in\s+')) AS w, min(lineno) FILTER (contains(lower(line), 'stack backtrace:')) AS k FROM lines GROUP BY id),
  body AS (SELECT id, lineno, CASE WHEN m IS NULL AND lineno = coalesce(b, w) THEN regexp_replace(line, '^.* in ', '') ELSE line END AS line FROM lines JOIN starts USING (id)
    WHERE lineno > coalesce(m, b, w, k) OR (m IS NULL AND lineno = coalesce(b, w)))"""


def _shown(frames: Column) -> Column:
    one = lambda f: F.concat(f["func"], F.lit("@"), F.coalesce(f["file"], F.lit("")), F.lit(":"), F.coalesce(f["line"].cast("string"), F.lit("")), F.when(f["inline"], "!").otherwise(""))
    return F.array_join(F.transform(frames, one), "|")


@query(f"WITH {_LINES}, {_TRACE_BODY}, {_sql_parsed('body')}, {_sql_trace()} SELECT id AS doc_id, string_agg({_SHOWN}, '|' ORDER BY lineno) AS frames FROM trace GROUP BY id")
def call_traces(spark: SparkSession, d: str) -> DataFrame:
    """The main trace of every report."""
    found = _documents(spark, d).select("doc_id", fr.call_trace(tx.split_lines(F.col("text"))).alias("f"))
    return found.filter(F.size("f") > 0).select("doc_id", _shown(F.col("f")).alias("frames"))


@query(rf"""WITH {_LINES}, marks AS (SELECT id, min(lineno) AS a FROM lines WHERE regexp_matches(line, 'object was given back by:') GROUP BY id), body AS (SELECT id, lineno, line FROM lines JOIN marks USING (id) WHERE lineno > a),
  {_sql_parsed('body')}, {_sql_trace("regexp_matches(raw, '(?:^== end)|(?:^---\\[)')")} SELECT id AS doc_id, string_agg({_SHOWN}, '|' ORDER BY lineno) AS frames FROM trace GROUP BY id""")
def section_traces(spark: SparkSession, d: str) -> DataFrame:
    """The trace of a named section of every report."""
    found = _documents(spark, d).select("doc_id", fr.section_trace(tx.split_lines(F.col("text")), "object was given back by:", ["^== end", r"^---\["]).alias("f"))
    return found.filter(F.size("f") > 0).select("doc_id", _shown(F.col("f")).alias("frames"))


_REGISTERED = "stops OR contains(raw, 'irq event stamp') OR contains(raw, 'stack backtrace')"


@query(f"""WITH {_LINES}, marks AS (SELECT id, min(lineno) AS a FROM lines WHERE contains(line, 'Trace:') GROUP BY id), body AS (SELECT id, lineno, line FROM lines JOIN marks USING (id) WHERE lineno > a),
  {_sql_parsed('body')}, {_sql_trace(_REGISTERED)} SELECT id AS doc_id, string_agg({_SHOWN}, '|' ORDER BY lineno) AS frames FROM trace GROUP BY id""")
def registered_traces(spark: SparkSession, d: str) -> DataFrame:
    """The trace behind the line at which a lock's state was registered; the reports' first trace line stands for it."""
    text = F.regexp_replace("text", r"(?m)^[^\n]*Trace:[^\n]*$", "state was registered at:")
    found = _documents(spark, d).filter(F.contains("text", F.lit("Trace:"))).select("doc_id", fr.registered_trace(tx.split_lines(text)).alias("f"))
    return found.filter(F.size("f") > 0).select("doc_id", _shown(F.col("f")).alias("frames"))


@query(f"WITH {_LINES}, {_sql_parsed('lines')}, f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lineno) AS n FROM parsed WHERE func IS NOT NULL) SELECT id AS doc_id, string_agg({_SHOWN}, '|' ORDER BY lineno) AS frames FROM f WHERE n <= 64 GROUP BY id")
def frame_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first frames among all lines of every text."""
    found = _documents(spark, d).select("doc_id", fr.frames_of(tx.split_lines(F.col("text")), 64).alias("f"))
    return found.filter(F.size("f") > 0).select("doc_id", _shown(F.col("f")).alias("frames"))


_GENERIC = f"({base._sql_starts('func', fr.GENERIC_FUNC_PREFIXES)} OR coalesce({base._sql_starts('file', fr.GENERIC_PATH_PREFIXES)}, false))"
_IN_TITLE = r"nullif(regexp_extract(ti, '\bin\s+([A-Za-z_][A-Za-z0-9_.$]*)', 1), '')"
_IN_HEAD = rf"nullif(regexp_extract(array_to_string(({base._sql_lines('re')})[:6], chr(10)), '(?:BUG|WARNING|KASAN|KMSAN|UBSAN|general protection fault).*?\bin\s+([A-Za-z_][A-Za-z0-9_.$]*)', 1), '')"
_CLASS = base._sql_class("ti", "re")


@query(f"""WITH {_LINES}, {_TRACE_BODY}, {_sql_parsed('body')}, {_sql_trace()},
  src AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS ti, text AS re FROM documents WHERE text <> ''), cls AS ({_CLASS}),
  sem AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lineno) AS k FROM trace WHERE NOT {_GENERIC}),
  s AS (SELECT id, count(*) AS n_sem, arg_min(func, k) AS f1, arg_min({{'x': file}}, k).x AS p1, string_agg(func, '|' ORDER BY k) FILTER (k <= 8) AS anchor, list(file ORDER BY k) FILTER (k <= 16 AND file IS NOT NULL) AS files FROM sem GROUP BY id),
  r AS (SELECT id, least(count(*), 30) AS n_raw, arg_min(func, n) AS f1, arg_min({{'x': file}}, n).x AS p1 FROM trace GROUP BY id)
SELECT src.id AS doc_id, cls.sanitizer, cls.bug_type, coalesce(s.f1, nullif({_sql_canon(f"coalesce({_IN_TITLE}, {_IN_HEAD})")}, ''), r.f1, '') AS primary_function, CASE WHEN s.id IS NOT NULL THEN s.p1 ELSE r.p1 END AS primary_file,
  coalesce(n_raw, 0)::BIGINT AS n_raw, least(coalesce(n_sem, 0), 24)::BIGINT AS n_semantic, coalesce(anchor, '') AS anchor, coalesce(array_to_string({base._sql_unique('files')}, '|'), '') AS files,
  coalesce(array_to_string({base._sql_unique("list_transform(list_filter(files, lambda x: contains(x, '/')), lambda x: split_part(x, '/', 1))")}, '|'), '') AS subsystems,
  left(sha256(re), 16) AS report_digest, true AS has_syz, false AS has_c
FROM src JOIN cls ON cls.id = src.id LEFT JOIN s ON s.id = src.id LEFT JOIN r ON r.id = src.id""")
def made_cards(spark: SparkSession, d: str) -> DataFrame:
    """Every text made into a crash card as report, log and reproducer: class, primary place, stacks, files and subsystems."""
    docs = _documents(spark, d).filter("text <> ''")
    meta = F.to_json(F.struct(F.substring_index("text", "\n", 1).alias("title"), F.lit("k").alias("kernel")))
    none = F.lit(None).cast("string")
    raw = docs.select(F.lit("bug").alias("bug_id"), F.col("doc_id").cast("string").alias("case_id"), meta.alias("meta"), F.col("text").alias("report"), none.alias("config"), none.alias("machine"), F.col("text").alias("crash_log"), F.col("text").alias("syz"), none.alias("c_repro"))
    joined = lambda c: F.array_join(c, "|")
    return cd.make_cards(raw).select(
        F.col("case_id").cast("long").alias("doc_id"), "bug.sanitizer", "bug.bug_type", "fault.primary_function", "fault.primary_file", F.size("stack_raw").cast("long").alias("n_raw"), F.size("stack_semantic").cast("long").alias("n_semantic"),
        joined("anchor_trace").alias("anchor"), joined("source_context.files").alias("files"), joined("source_context.subsystems").alias("subsystems"), F.col("raw_report_digest").alias("report_digest"), F.col("repro.has_syz_repro").alias("has_syz"), F.col("repro.has_c_repro").alias("has_c"))


# A lock report around each text: its first lines are the locks' sections.
_LOCK_PARTS = ["WARNING: possible circular locking dependency detected", "a is trying to acquire lock:", None, "but task is already holding lock:", None, "which lock already depends on the new lock.",
               "the existing dependency chain (in reverse order) is:", "-> #1 (first_lock){+.+.}-{3:3}:", None, "-> #0 (second_lock){....}-{2:2}:", None, "other info that might help us debug this:", None,
               "2 locks held by probe/7:", " #0: (big_lock){+.+.}-{3:3}, at: here+0x1/0x2", " #1: (small_lock){+.+.}-{3:3}", "stack backtrace:"]


def _lock_report() -> Column:
    first = F.coalesce(F.get(tx.split_lines(F.col("text")), F.lit(0)), F.lit(""))
    return F.concat_ws("\n", *[first if p is None else F.lit(p) for p in _LOCK_PARTS], F.lit("bpf_prog_run sock_map_unref '"), F.coalesce("text", F.lit("")))


def _sql_lock_report() -> str:
    first = f"coalesce(({base._sql_lines('text')})[1], '')"
    return " || chr(10) || ".join([first if p is None else f"'{p}'" for p in _LOCK_PARTS] + ["'bpf_prog_run sock_map_unref ''' ", "coalesce(text, '')"])


_FIRST = "(" + base._sql_lines("coalesce(text, '')") + ")[1]"


@query(rf"""WITH r AS (SELECT doc_id, coalesce({_FIRST}, '') AS f, {_sql_lock_report()} AS report FROM documents),
  t AS (SELECT *, '{_LOCK_PARTS[6]}' || chr(10) || '{_LOCK_PARTS[7]}' || chr(10) || f || chr(10) || '{_LOCK_PARTS[9]}' || chr(10) || f || chr(10) || '{_LOCK_PARTS[11]}' || chr(10) || f || chr(10) || '{_LOCK_PARTS[13]}' || chr(10) || '{_LOCK_PARTS[14]}' || chr(10) || '{_LOCK_PARTS[15]}' || chr(10) || report AS seen FROM r)
SELECT doc_id, left(sha256('{_LOCK_PARTS[1]}' || chr(10) || {base._strip('f')}), 16) AS acquire, left(sha256('{_LOCK_PARTS[3]}' || chr(10) || {base._strip('f')}), 16) AS holding, '-> #1 (first_lock){{+.+.}}-{{3:3}}:|-> #0 (second_lock){{....}}-{{2:2}}:' AS chain,
  '0=(big_lock){{+.+.}}-{{3:3}}@here+0x1/0x2|1=(small_lock){{+.+.}}-{{3:3}}@' AS held, 'first_lock|second_lock|big_lock|small_lock' AS lock_classes, true AS present,
  array_to_string(({base._sql_unique(f"regexp_extract_all(seen, '{rp.BPF_TRACE}')")})[:24], '|') AS bpf_frames, array_to_string(({base._sql_unique(f"regexp_extract_all(seen, '{rp.BPF_MAP_OP}')")})[:16], '|') AS map_operations FROM t""")
def lock_contexts(spark: SparkSession, d: str) -> DataFrame:
    """What a lock report around every text says: sections, dependency chain, held locks, lock classes and bridge."""
    docs = _documents(spark, d).select("doc_id", _lock_report().alias("report")).withColumn("lines", tx.split_lines(F.col("report"))).withColumn("sections", rp.lock_sections(F.col("lines")))
    c = docs.select("doc_id", rp.lockdep_context(F.col("report"), F.col("lines"), F.col("sections")).alias("c"))
    joined = lambda x: F.array_join(x, "|")
    return c.select(
        "doc_id", tx.sha16(F.col("c.current_acquisition.raw_excerpt")).alias("acquire"), tx.sha16(F.col("c.already_holding.raw_excerpt")).alias("holding"), joined(F.transform("c.existing_dependency_chain", lambda b: b["lock"])).alias("chain"),
        joined(F.transform("c.held_locks", lambda h: F.concat(h["index"], F.lit("="), h["lock"], F.lit("@"), h["site"]))).alias("held"), joined("c.lock_classes").alias("lock_classes"), "c.bpf_tracepoint_bridge.present",
        joined("c.bpf_tracepoint_bridge.bpf_frames").alias("bpf_frames"), joined("c.bpf_tracepoint_bridge.map_operations").alias("map_operations"))


# --- evidence of cards -----------------------------------------------------------------------------------------------
_QUALITY = base._sql_quality().split("      e AS (SELECT")[0].rstrip().rstrip(",")
_ST = lambda x: f"coalesce({base._strip(x)}, '')"
_NOT_GENERIC = f"NOT {base._sql_cause_generic('f')}"
_PLACE = f"{_ST('f.file')} || '|' || {_ST('f.func')} || '|' || coalesce(f.line, -999)::VARCHAR"


def _sql_distinct(frames: str, key: str) -> str:
    return f"list_filter({frames}, lambda f, i: list_position(list_transform({frames}, lambda f: {key}), {key}) = i)"


@query(f"""{_QUALITY}, x AS (SELECT *, list_filter(st, lambda f: {_NOT_GENERIC} AND {_ST('f.file')} <> '' AND coalesce(f.line, 0) <> 0)[1] AS p FROM c)
SELECT card_id, coalesce(CASE WHEN p IS NOT NULL THEN coalesce(p.func, '<null>') END, func) AS func, CASE WHEN p IS NOT NULL THEN p.file ELSE file END AS file, p.line AS line, prefix FROM x""")
def primary_frames(spark: SparkSession, d: str) -> DataFrame:
    """The frame of every card that is read first, and the card's domain."""
    cards = table(spark, d, "crash_cards", "card_id", "fault", "stack_semantic")
    p = cards.select("card_id", ql.primary_source_frame(cards).alias("p"), ql.domain_prefix(cards).alias("prefix"))
    return p.select("card_id", F.coalesce("p.func", F.lit("<null>")).alias("func"), "p.file", "p.line", "prefix")


@query(f"""{_QUALITY}, x AS (SELECT card_id, list_filter(dom, lambda f: {_ST('f.func')} <> '' AND (prefix = '' OR starts_with({_ST('f.file')}, prefix))) AS l FROM c)
SELECT card_id, array_to_string(list_transform(({_sql_distinct('l', _PLACE)})[:3], lambda f: f.func || '@' || f.file), '|') AS frames FROM x""")
def domain_frames(spark: SparkSession, d: str) -> DataFrame:
    """The first distinct frames of every card in its domain."""
    cards = table(spark, d, "crash_cards", "card_id", "fault", "stack_semantic")
    found = cards.select("card_id", ql.domain_frames(cards, ql.domain_prefix(cards), 3).alias("f"))
    return found.select("card_id", F.array_join(F.transform("f", lambda f: F.concat_ws("@", f["func"], f["file"])), "|").alias("frames"))


_TRACES = " || ".join(f"list_transform(list_filter(coalesce(sanitizer_context.{k}, []), lambda f: f IS NOT NULL), lambda f: {{'kind': '{k}', 'func': f.func, 'file': f.file, 'line': f.line}})" for k in ql.TRACES)


@query(f"""{_QUALITY}, y AS (SELECT card_id, prefix, {_TRACES} AS t FROM c),
  x AS (SELECT card_id, list_filter(t, lambda f: {_NOT_GENERIC} AND {_ST('f.file')} <> '' AND {_ST('f.func')} <> '' AND (prefix = '' OR starts_with({_ST('f.file')}, prefix))) AS l FROM y)
SELECT card_id, array_to_string(list_transform(({_sql_distinct('l', "f.kind || '|' || " + _PLACE)})[:2], lambda f: f.kind || '=' || f.func || '@' || f.file), '|') AS frames FROM x""")
def sanitizer_frames(spark: SparkSession, d: str) -> DataFrame:
    """The first distinct sanitizer frames of every card in its domain, with their trace."""
    cards = table(spark, d, "crash_cards", "card_id", "fault", "stack_semantic", "sanitizer_context")
    found = cards.select("card_id", ql.sanitizer_frames(cards, ql.domain_prefix(cards), 2).alias("f"))
    return found.select("card_id", F.array_join(F.transform("f", lambda f: F.concat(f["trace_kind"], F.lit("="), f["func"], F.lit("@"), f["file"])), "|").alias("frames"))


# --- source search: every text is the body of a function, behind a macro and a struct ---------------------------------
_HEAD = ["#define PROBE_MAX(x) 7", "struct probe_rec {", "int first;", "long second; /* two */", "};", "static int probe_doc(void)", "{", "helper_a(1); helper_b (2); if (x) helper_a(3);"]
_HEAD_SQL = " || chr(10) || ".join("'" + h.replace("'", "''") + "'" for h in _HEAD)
_WRAPPED = f"""wrapped AS (SELECT printf('docs/d%09d.c', doc_id) AS path, {_HEAD_SQL} || chr(10) || coalesce(text, '') || chr(10) || '}}' || chr(10) AS w FROM documents),
  lines AS (SELECT path, unnest({base._sql_lines('w')}) AS line, generate_subscripts({base._sql_lines('w')}, 1) AS lineno FROM wrapped)"""
_BOUNDS = r"""code AS (SELECT path, lineno, line, regexp_replace(line, '"(?:\\.|[^"\\])*"', '""', 'g') AS c FROM lines WHERE lineno >= 7),
  depth AS (SELECT path, lineno, sum(length(c) - length(replace(c, '{', '')) - length(c) + length(replace(c, '}', ''))) OVER (PARTITION BY path ORDER BY lineno) AS level FROM code),
  bounds AS (SELECT path, coalesce(min(lineno) FILTER (level <= 0), 7) AS e FROM depth GROUP BY path)"""


def _wrapped(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("\n".join(_HEAD) + "\n"), F.coalesce("text", F.lit("")), F.lit("\n}\n"))
    return ss.source_lines(_documents(spark, d).select(F.concat(F.lit("docs/d"), F.format_string("%09d", "doc_id"), F.lit(".c")).alias("path"), body.alias("text")))


@query(f"""WITH {_WRAPPED}, {_BOUNDS}, five AS (SELECT path, e FROM bounds ORDER BY path LIMIT 5)
SELECT path AS file, 6 AS start_line, e::INT AS end_line, min(lineno)::INT AS display_start, max(lineno)::INT AS display_end, string_agg(printf('%s%5d: %s', CASE WHEN lineno = 6 THEN '>' ELSE ' ' END, lineno, line), chr(10) ORDER BY lineno) AS source
FROM lines JOIN five USING (path) WHERE lineno BETWEEN 1 AND e + 5 GROUP BY path, e""")
def function_source(spark: SparkSession, d: str) -> DataFrame:
    """A function with the lines around it, in the first files that have it."""
    return ss.get_function(_wrapped(spark, d), "probe_doc")


@query(rf"""WITH {_WRAPPED}, {_BOUNDS}, five AS (SELECT path, e FROM bounds ORDER BY path LIMIT 5),
  s AS (SELECT path, e, string_agg(printf('%s%5d: %s', CASE WHEN lineno = 6 THEN '>' ELSE ' ' END, lineno, line), chr(10) ORDER BY lineno) AS source FROM lines JOIN five USING (path) WHERE lineno BETWEEN 6 AND e GROUP BY path, e),
  n AS (SELECT path, e, list_filter(regexp_extract_all(source, '\b([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1), lambda n: NOT list_contains([{', '.join(f"'{x}'" for x in ss.NOT_CALLS)}], n) AND NOT starts_with(n, '__maybe')) AS l FROM s)
SELECT path AS file, 'probe_doc' AS function, '6-' || e AS line_range, array_to_string({base._sql_unique('l')}, '|') AS callees, len(list_distinct(l))::INT AS callee_count FROM n""")
def function_callees(spark: SparkSession, d: str) -> DataFrame:
    """What a function calls, in the first files that have it."""
    return ss.find_callees(_wrapped(spark, d), "probe_doc").withColumn("callees", F.array_join("callees", "|"))


@query(f"""WITH {_WRAPPED} SELECT 'probe_rec' AS name, min(path) AS file, '2-5' AS lines, 1 AS field_count, 'int first' AS fields FROM lines""")
def struct_definition(spark: SparkSession, d: str) -> DataFrame:
    """The first definition of a struct."""
    return ss.get_struct_def(_wrapped(spark, d), "probe_rec").select("name", "file", "lines", "field_count", F.array_join("fields", "|").alias("fields"))


@query(f"""WITH {_WRAPPED}, m AS (SELECT path, lineno, line, path || ':' || lineno || ':' || line AS text FROM lines WHERE regexp_matches(line, '#define\\s+PROBE_MAX[\\s\\(]')), s AS (SELECT *, sum(length(text) + 1) OVER (ORDER BY path, lineno) - length(text) - 1 AS before FROM m)
SELECT path AS file, lineno::INT AS line, line AS text FROM s WHERE before <= 4000""")
def macro_definition(spark: SparkSession, d: str) -> DataFrame:
    """The definitions of a macro within the character limit."""
    return ss.macro_definitions(_wrapped(spark, d), "PROBE_MAX", 4000)


@query(f"""WITH {_WRAPPED}, {_BOUNDS} SELECT path AS file, 7 AS target_line, 'probe_doc' AS function, 6 AS func_start, e::INT AS func_end, NULL::VARCHAR AS note FROM bounds
UNION ALL SELECT path, 3, NULL, NULL, NULL, 'no containing function found' FROM bounds""")
def containing_functions(spark: SparkSession, d: str) -> DataFrame:
    """The function around two places of every file, one of them before any function."""
    lines = _wrapped(spark, d)
    places = lines.select(F.col("path").alias("file")).distinct().select("file", F.explode(F.array(F.lit(7), F.lit(3))).alias("line"))
    return ss.find_containing_function(lines, places)


@query(f"""WITH {_WRAPPED}, {_BOUNDS} SELECT path AS file, 7 AS around, 'macro' AS kind, 'PROBE_MAX' AS name, 1 AS start_line, 1 AS end_line, false AS contains_target FROM bounds
UNION ALL SELECT path, 7, 'function', 'probe_doc', 6, e::INT, true FROM bounds""")
def outlines(spark: SparkSession, d: str) -> DataFrame:
    """Macros and functions around a place of every file; only those before the texts are compared."""
    lines = _wrapped(spark, d)
    places = lines.select(F.col("path").alias("file")).distinct().withColumn("around", F.lit(7))
    found = ss.file_outlines(lines, places)
    return found.filter("start_line <= 7").select("file", "around", "kind", "name", "start_line", "end_line", "contains_target")


@query(f"""WITH {_WRAPPED}, f AS (SELECT min(path) AS path FROM lines) SELECT path, lineno::INT AS lineno, printf('%s %5d: %s', CASE WHEN lineno = 6 THEN '=>' ELSE '  ' END, lineno, line) AS text FROM lines JOIN f USING (path) WHERE lineno BETWEEN 1 AND 86""")
def numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    """Numbered lines around a place of the first file."""
    lines = _wrapped(spark, d)
    first = lines.agg(F.min("path")).collect()[0][0] or ""
    return ss.get_lines(lines, first, 6)


_GREP = base._sql_grep(r"\bowner_mutex\b")
_REQUESTS = [{"op": "search_symbol", "symbol": "owner_mutex"}, {"op": "fly"}, {"op": "field"}, {"op": "callers", "symbol": "helper_a"}]


@query(f"""WITH g AS ({_GREP}), h AS ({base._sql_grep(chr(92) + "bhelper_a" + chr(92) + "b")})
SELECT 0 AS request, 'search_symbol' AS op, NULL::VARCHAR AS error, count(*) AS n FROM g HAVING count(*) > 0
UNION ALL SELECT 1, 'fly', 'unknown op: fly', 1 UNION ALL SELECT 2, 'field', 'missing argument: field', 1 UNION ALL SELECT 3, 'callers', NULL, count(*) FROM h HAVING count(*) > 0""")
def request_batch(spark: SparkSession, d: str) -> DataFrame:
    """Several operations at once, bad ones among them: results and errors per request."""
    return ss.batch(base._lines(spark, d), _REQUESTS).groupBy("request", "op", "error").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH g AS ({_GREP}) SELECT coalesce(sha256(string_agg(text, chr(10) ORDER BY path, lineno)), sha256('')) AS answer FROM g""")
def tool_answer(spark: SparkSession, d: str) -> DataFrame:
    """What a model's search call gets back."""
    text = ss.execute_tool(base._lines(spark, d), "code_searcher_search_symbol", {"symbol": "owner_mutex"}, 1_000_000)
    return spark.createDataFrame([(text,)], "t string").select(F.sha2("t", 256).alias("answer"))
