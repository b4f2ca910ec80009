"""Searching a source tree held as a table of lines: ``path, lineno, line`` (line numbers from 1)."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import glob_regex, java_pattern, split_lines, strip
from ..session import materialize

CHAR_LIMIT = 20_000
CUT_NOTE = "...[truncated]..."
#: Words before a parenthesis that are no calls, and those that start no function.
NOT_CALLS = [
    "if", "for", "while", "switch", "return", "sizeof", "typeof", "defined", "offsetof", "container_of", "BUILD_BUG_ON", "likely", "unlikely",
    "__must_check", "__printf", "case", "default", "goto", "break", "continue", "void", "char", "int", "long", "short", "float", "double", "unsigned",
    "signed", "const", "volatile", "static", "inline", "extern", "struct", "union", "enum", "typedef",
]
NOT_FUNCTIONS = ["if", "for", "while", "switch", "return"]
DEFINITION = r"^[A-Za-z_][A-Za-z0-9_:*\s]+\s+([A-Za-z_][A-Za-z0-9_]*)\s*\([^;]*$"
STRINGS = r'"(?:\\.|[^"\\])*"'
SOURCES, HEADERS_FIRST = ["*.c", "*.h"], ["*.h", "*.c"]


def source_lines(files: DataFrame) -> DataFrame:
    """Lines of ``path, text`` files. Paths that are absolute or climb with ``..`` are refused (left out)."""
    safe = files.filter(~F.col("path").rlike(r"^/|(?:^|/)\.\.(?:/|$)"))
    return safe.select("path", F.posexplode(split_lines(F.col("text"))).alias("p", "line")).select("path", (F.col("p") + 1).alias("lineno"), "line")


def in_paths(lines: DataFrame, globs: list[str] | None) -> DataFrame:
    """Lines of files that match any glob, at any depth; without globs all of them."""
    return lines.filter(F.col("path").rlike("|".join(glob_regex(g) for g in globs))) if globs else lines


def _literal(symbol: str) -> str:
    return r"\Q" + symbol.replace(r"\E", r"\E\\E\Q") + r"\E"


def grep(lines: DataFrame, pattern: str, paths: list[str] | None = None, limit: int = CHAR_LIMIT) -> DataFrame:
    """``path, lineno, line, text, cut``: matching lines by path and number until their text exceeds ``limit`` characters.

    The line that exceeds the limit is the last and has ``cut``. The limit bounds the number of lines that can be
    shown, so only that many are ever ordered together.
    """
    found = in_paths(lines, paths or SOURCES).filter(F.col("line").rlike(java_pattern(pattern)))
    text = F.concat_ws(":", "path", F.col("lineno").cast("string"), "line")
    first = found.withColumn("text", text).orderBy("path", "lineno").limit(limit // 5 + 2)  # a line takes at least five characters
    so_far = F.sum(F.length("text") + 1).over(Window.orderBy("path", "lineno").rowsBetween(Window.unboundedPreceding, 0))
    before = so_far - F.length("text") - 1
    return first.withColumn("_b", before).withColumn("cut", so_far > limit).filter(F.col("_b") <= limit).drop("_b")


def search_symbol(lines: DataFrame, symbol: str, paths: list[str] | None = None, limit: int = CHAR_LIMIT) -> DataFrame:
    """Lines with the symbol as a whole word."""
    return grep(lines, rf"\b{_literal(symbol)}\b", paths, limit)


def find_callers(lines: DataFrame, symbol: str, paths: list[str] | None = None, limit: int = CHAR_LIMIT) -> DataFrame:
    """Lines where the symbol stands before a parenthesis."""
    return grep(lines, rf"(^|[^A-Za-z0-9_]){_literal(symbol)}[[:space:]]*\(", paths, limit)


def find_field_usage(lines: DataFrame, field: str, paths: list[str] | None = None, limit: int = CHAR_LIMIT) -> DataFrame:
    """Lines that reach the field by ``->`` or ``.``; the struct's name is not looked at."""
    return grep(lines, rf"(->|\.){_literal(field)}\b", paths, limit)


def macro_definitions(lines: DataFrame, name: str, limit: int = CHAR_LIMIT) -> DataFrame:
    """``file, line, text`` of the macro's definitions."""
    found = grep(lines, rf"#define[[:space:]]+{_literal(name)}[[:space:]\(]", HEADERS_FIRST, limit)
    return found.select(F.col("path").alias("file"), F.col("lineno").alias("line"), strip(F.col("line")).alias("text"))


def get_lines(lines: DataFrame, file: str, line: int, before: int = 60, after: int = 80) -> DataFrame:
    """Numbered lines around a place, the place marked ``=>``; bounds are clamped to the file."""
    near = lines.filter((F.col("path") == file) & F.col("lineno").between(line - before, line + after))
    mark = F.when(F.col("lineno") == line, "=>").otherwise("  ")
    return near.select("path", "lineno", F.format_string("%s %5d: %s", mark, F.col("lineno"), F.col("line")).alias("text"))


def _code(lines: DataFrame) -> DataFrame:
    """Adds ``skip`` (comment lines) and ``depth`` (opening minus closing braces outside strings)."""
    bare, w = strip(F.col("line")), Window.partitionBy("path").orderBy("lineno").rowsBetween(Window.unboundedPreceding, -1)
    event = F.when(bare.contains("*/"), False).when(bare.startswith("/*"), True)
    inside = F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(False))
    skip = inside | bare.contains("*/") | bare.startswith("/*") | bare.startswith("*") | bare.startswith("//")
    code = F.regexp_replace("line", STRINGS, '""')
    count = lambda ch: F.length(code) - F.length(F.replace(code, F.lit(ch), F.lit("")))
    return lines.withColumn("skip", skip).withColumn("opens", count("{")).withColumn("depth", count("{") - count("}"))


def _balanced(lines: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``end_line`` to ``path, start_line`` rows: where the braces opened at or after the start are closed again.

    If they never are, it is the line of the opening brace; a start without any brace after it is left out.
    """
    w = Window.partitionBy(*keys, "path", "start_line").orderBy("lineno")
    lines = lines.join(starts.select("path").distinct(), "path", "left_semi")
    rest = _code(lines).join(starts, "path").filter(F.col("lineno") >= F.col("start_line"))
    opened = rest.withColumn("open_line", F.min(F.when(F.col("line").contains("{"), F.col("lineno"))).over(Window.partitionBy(*keys, "path", "start_line")))
    body = opened.filter(F.col("lineno") >= F.col("open_line"))
    level = body.withColumn("level", F.sum("depth").over(w)).withColumn("seen", F.sum("opens").over(w))
    return level.groupBy(*keys, "path", "start_line").agg(F.coalesce(F.min(F.when((F.col("seen") > 0) & (F.col("level") <= 0), F.col("lineno"))), F.min("open_line")).alias("end_line"))


def function_bounds(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``symbol, around, path, start_line, end_line`` of the definition of each wanted ``path, symbol, around``.

    A definition is a line outside comments with the symbol before a parenthesis and no semicolon behind it; failing
    that in a file, one whose next ten lines reach an opening brace before any semicolon. Of several the one nearest to
    ``around`` counts (the first if that is null or on ties).
    """
    lines = lines.join(wanted.select("path").distinct(), "path", "left_semi")  # other files are not looked at
    w = Window.partitionBy("path").orderBy("lineno")
    code = _code(lines).withColumn("next10", F.array_join(F.collect_list("line").over(w.rowsBetween(0, 9)), "\n"))
    call = lambda tail: F.regexp_like("line", F.concat(F.lit(r"\b\Q"), F.col("symbol"), F.lit(r"\E\s*\(" + tail)))
    near = code.join(wanted, "path").filter(~F.col("skip") & call(""))
    strict = call("[^;]*$")
    loose = F.col("next10").contains("{") & ~F.substring_index("next10", "{", 1).contains(";")
    graded = near.withColumn("grade", F.when(strict, 1).when(loose, 2)).filter("grade IS NOT NULL")
    keys = ["path", "symbol", "around"]
    order = [F.col("grade"), F.coalesce(F.abs(F.col("lineno") - F.col("around")), F.lit(0)), F.col("lineno")]
    best = graded.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").select(*keys, F.col("lineno").alias("start_line"))
    ends = _balanced(lines, best, ["symbol", "around"])
    return ends.select("symbol", "around", "path", "start_line", "end_line")


def _wanted(lines: DataFrame, symbol: str, file: str | None, around: int | None, max_files: int = 5) -> DataFrame:
    if file:
        paths = lines.filter(F.col("path") == file).select("path").distinct()
    else:
        hits = in_paths(lines, SOURCES).filter(F.col("line").rlike(rf"\b{_literal(symbol)}\s*\("))
        paths = hits.select("path").distinct().orderBy("path").limit(max_files)
    return paths.withColumn("symbol", F.lit(symbol)).withColumn("around", F.lit(around).cast("int"))


def _numbered(lines: DataFrame, bounds: DataFrame, before: int, after: int) -> DataFrame:
    """Adds the display range and the numbered ``source`` of each bound."""
    shown = lines.join(bounds, "path").filter(F.col("lineno").between(F.col("start_line") - before, F.col("end_line") + after))
    mark = F.when(F.col("lineno") == F.col("start_line"), ">").otherwise(" ")
    row = F.struct("lineno", F.format_string("%s%5d: %s", mark, F.col("lineno"), F.col("line")).alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["t"]), "\n")
    return shown.groupBy(*bounds.columns).agg(F.min("lineno").alias("display_start"), F.max("lineno").alias("display_end"), text.alias("source"))


def get_function(lines: DataFrame, symbol: str, file: str | None = None, around: int | None = None, before: int = 5, after: int = 5, max_files: int = 5) -> DataFrame:
    """``file, start_line, end_line, display_start, display_end, source`` of a function, in at most ``max_files`` files by path."""
    bounds = function_bounds(lines, _wanted(lines, symbol, file, around, max_files))
    return _numbered(lines, bounds, before, after).select(F.col("path").alias("file"), "start_line", "end_line", "display_start", "display_end", "source")


def _calls(source: Column) -> Column:
    names = F.regexp_extract_all(source, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1)
    return F.array_distinct(F.filter(names, lambda n: ~n.isin(NOT_CALLS) & ~n.startswith("__maybe")))


def find_callees(lines: DataFrame, symbol: str, file: str | None = None) -> DataFrame:
    """``file, function, line_range, callees, callee_count``: what stands before parentheses in the function, keywords aside, each once in order."""
    body = get_function(lines, symbol, file, before=0, after=0)
    calls = _calls(F.col("source"))
    return body.select("file", F.lit(symbol).alias("function"), F.concat_ws("-", "start_line", "end_line").alias("line_range"), calls.alias("callees"), F.size(calls).alias("callee_count"))


def get_struct_def(lines: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """``name, file, lines, field_count, fields, source`` of the first definition of a struct by path and line."""
    first = in_paths(lines, paths or HEADERS_FIRST).filter(F.col("line").rlike(rf"struct\s+{_literal(name)}\s*\{{")).orderBy("path", "lineno").limit(1)
    start = first.select("path", F.col("lineno").alias("start_line"))
    bounds = _balanced(lines, start, []).withColumn("name", F.lit(name))
    inside = lines.join(bounds, "path").filter(F.col("lineno").between(F.col("start_line"), F.col("end_line")))
    bare = strip(F.col("line"))
    field = F.when(bare.endswith(";") & ~bare.rlike(r"^(?:struct|\{|\}|/\*|\*|//|#)") , strip(F.regexp_replace(bare, ";+$", "")))
    rows = F.array_sort(F.collect_list(F.struct("lineno", field.alias("f"), F.format_string("%5d: %s", F.col("lineno"), F.col("line")).alias("t"))))
    found = inside.groupBy("name", "path", "start_line", "end_line").agg(rows.alias("rows"))
    fields = F.array_compact(F.transform("rows", lambda r: r["f"]))
    return found.select("name", F.col("path").alias("file"), F.concat_ws("-", "start_line", "end_line").alias("lines"), F.size(fields).alias("field_count"), fields.alias("fields"), F.array_join(F.transform("rows", lambda r: r["t"]), "\n").alias("source"))


def find_containing_function(lines: DataFrame, places: DataFrame) -> DataFrame:
    """``file, target_line, function, func_start, func_end, note`` for each ``file, line``: the function around a place.

    The nearest definition line before the place names it; if its bounds do not hold the place, only name and start are
    given, with a note. Places without one have a note only.
    """
    bare = strip(F.col("line"))
    name = F.regexp_extract(bare, DEFINITION, 1)
    heads = lines.filter(~bare.rlike(r"^(?:/\*|\*|//|#)") & bare.rlike(DEFINITION)).withColumn("name", name).filter(~F.col("name").isin(NOT_FUNCTIONS)).select(F.col("path").alias("file"), F.col("lineno").alias("at"), "name")
    spot = places.select("file", F.col("line").alias("target_line"))
    last = spot.join(heads, "file", "left").filter(F.col("at").isNull() | (F.col("at") <= F.col("target_line"))).groupBy("file", "target_line").agg(F.max_by("name", "at").alias("function"), F.max("at").alias("at"))
    wanted = last.filter("function IS NOT NULL").select(F.col("file").alias("path"), F.col("function").alias("symbol"), F.col("at").cast("int").alias("around")).distinct()
    bounds = function_bounds(lines, wanted).select(F.col("path").alias("file"), F.col("symbol").alias("function"), F.col("around").alias("at"), "start_line", "end_line")
    joined = spot.join(last, ["file", "target_line"], "left").join(bounds, ["file", "function", "at"], "left")
    holds = F.coalesce(F.col("target_line").between(F.col("start_line"), F.col("end_line")), F.lit(False))
    note = F.when(F.col("function").isNull(), "no containing function found").when(~holds, "bounds not fully resolved")
    return joined.select("file", "target_line", "function", F.when(holds, F.col("start_line")).otherwise(F.col("at")).alias("func_start"), F.when(holds, F.col("end_line")).alias("func_end"), note.alias("note"))


def file_outlines(lines: DataFrame, places: DataFrame, radius: int = 220, max_macros: int = 60, max_functions: int = 40) -> DataFrame:
    """``file, around, kind, name, start_line, end_line, text, contains_target, place`` for each distinct ``file, around`` of ``places``.

    Macros and functions of the window around a line (of the whole file if that is null): the function around the line comes
    first, then macros and functions in order, each up to its limit; ``place`` numbers them. Lines of other files are not looked at.
    """
    spots = places.select(F.col("file"), F.col("around").cast("int").alias("around")).distinct()
    own = lines.join(spots.select(F.col("file").alias("path")).distinct(), "path", "left_semi")
    asked = spots.select(F.col("file").alias("path"), "around")
    keys = ["path", "around"]
    inside = F.col("around").isNull() | F.col("lineno").between(F.col("around") - radius, F.col("around") + radius)
    macro = r"^\s*#\s*define\s+([A-Za-z_][A-Za-z0-9_]*)\b"
    near = own.filter(F.col("line").rlike(macro)).join(asked, "path").filter(inside)
    nth = lambda *order: F.row_number().over(Window.partitionBy("path", F.coalesce("around", F.lit(-1))).orderBy(*order))
    macros = near.withColumn("n", nth("lineno")).filter(F.col("n") <= max_macros)
    macros = macros.select(*keys, F.lit(1).alias("rank"), F.lit("macro").alias("kind"), F.regexp_extract("line", macro, 1).alias("name"), F.col("lineno").alias("start_line"), F.col("lineno").alias("end_line"), strip(F.col("line")).alias("text"), F.lit(False).alias("contains_target"))
    w = Window.partitionBy("path").orderBy("lineno")
    text8 = own.withColumn("next8", F.array_join(F.collect_list("line").over(w.rowsBetween(0, 7)), "\n"))
    head = r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\([^;]*$"
    top = text8.filter(F.col("line").rlike(r"^[^\s#]") & ~F.col("line").rlike(r"^(?:/\*|\*|//)") & F.col("line").contains("(") & ~F.col("line").contains(";"))
    top = top.filter(F.col("next8").contains("{") & ~F.substring_index("next8", "{", 1).contains(";"))
    named = top.withColumn("symbol", F.regexp_extract("line", head, 1)).filter((F.col("symbol") != "") & ~F.col("symbol").isin(NOT_FUNCTIONS))
    bounds = function_bounds(own, named.select("path", "symbol", F.col("lineno").cast("int").alias("around"))).select("path", F.col("symbol").alias("name"), "start_line", "end_line").distinct()
    reach = F.max("end_line").over(Window.partitionBy("path").orderBy("start_line", "name").rowsBetween(Window.unboundedPreceding, -1))
    outer = bounds.withColumn("_reach", reach).filter(F.col("_reach").isNull() | (F.col("start_line") >= F.col("_reach"))).drop("_reach")
    shown = outer.join(asked, "path").filter(F.col("around").isNull() | ((F.col("end_line") >= F.col("around") - radius) & (F.col("start_line") <= F.col("around") + radius)))
    target = F.coalesce(F.col("around").between(F.col("start_line"), F.col("end_line")), F.lit(False))
    functions = shown.withColumn("contains_target", target).withColumn("n", nth(F.desc("contains_target"), "start_line")).filter(F.col("n") <= max_functions)
    functions = functions.select(*keys, F.when(F.col("contains_target"), 0).otherwise(2).alias("rank"), F.lit("function").alias("kind"), "name", "start_line", "end_line", F.lit("").alias("text"), "contains_target")
    both = macros.unionByName(functions).withColumn("place", nth("rank", "start_line"))
    return both.drop("rank").withColumnRenamed("path", "file")


def get_file_outline(lines: DataFrame, file: str, around: int | None = None, radius: int = 220, max_macros: int = 60, max_functions: int = 40) -> DataFrame:
    """:func:`file_outlines` of one place, in order."""
    spot = lines.sparkSession.createDataFrame([(file, around)], "file string, around int")
    found = file_outlines(lines, spot, radius, max_macros, max_functions)
    return found.orderBy("place").select("kind", "name", "start_line", "end_line", "text", "contains_target")


def transitive_callees(lines: DataFrame, symbol: str, depth: int) -> DataFrame:
    """``depth, function``: functions reached from a symbol in at most ``depth`` calls, each at its first depth, in whole rounds over the frontier.

    The frontier is a table; every round looks all its functions up at once, in all files that name them, and is written to the shared
    folder. Functions without a definition among the lines are reached but call nothing. Macros and declarations count as in :func:`find_callees`.
    """
    spark = lines.sparkSession
    named = F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1))).alias("symbol")
    mentions = materialize(in_paths(lines, SOURCES).select("path", named).distinct(), "callees-mentions")
    reached = spark.createDataFrame([(0, symbol)], "depth int, function string")
    frontier = reached
    for d in range(1, depth + 1):
        wanted = mentions.join(frontier.select(F.col("function").alias("symbol")), "symbol", "left_semi").withColumn("around", F.lit(None).cast("int"))
        bounds = function_bounds(lines, wanted)
        body = lines.join(bounds, "path").filter(F.col("lineno").between(F.col("start_line"), F.col("end_line")))
        called = body.select(F.explode(_calls(F.col("line"))).alias("function")).distinct()
        frontier = materialize(called.join(reached, "function", "left_anti").select(F.lit(d).alias("depth"), "function"), "callees-frontier")
        if frontier.limit(1).count() == 0:
            break
        reached = reached.unionByName(frontier)
    return reached.filter("depth > 0")


#: Operations of :func:`batch` and the arguments they take.
OPERATIONS = {
    "line": lambda t, a: get_lines(t, a["file"], a["line"], a.get("before", 60), a.get("after", 80)),
    "function": lambda t, a: get_function(t, a["symbol"], a.get("file"), a.get("around_line"), a.get("before", 5), a.get("after", 5)),
    "callers": lambda t, a: find_callers(t, a["symbol"], a.get("paths"), a.get("limit", CHAR_LIMIT)),
    "callees": lambda t, a: find_callees(t, a["symbol"], a.get("file")),
    "struct": lambda t, a: get_struct_def(t, a["name"], a.get("paths")),
    "field": lambda t, a: find_field_usage(t, a["field"], a.get("paths"), a.get("limit", CHAR_LIMIT)),
    "macro": lambda t, a: macro_definitions(t, a["name"], a.get("limit", CHAR_LIMIT)),
    "containing": lambda t, a: find_containing_function(t, t.sparkSession.createDataFrame([(a["file"], a["line"])], "file string, line int")),
    "file_outline": lambda t, a: get_file_outline(t, a["file"], a.get("around_line"), a.get("radius", 220), a.get("max_macros", 60), a.get("max_functions", 40)),
    "grep": lambda t, a: grep(t, a["pattern"], a.get("paths"), a.get("limit", CHAR_LIMIT)),
    "search_symbol": lambda t, a: search_symbol(t, a["symbol"], a.get("paths"), a.get("limit", CHAR_LIMIT)),
}


def batch(lines: DataFrame, requests: list[dict]) -> DataFrame:
    """``request, op, result, error``: several operations in one table, results as JSON rows; a bad request gives an error row."""
    spark: SparkSession = lines.sparkSession
    parts = []
    for n, request in enumerate(requests):
        op = request.get("op", "")
        try:
            one = OPERATIONS[op](lines, request)
            parts.append(one.select(F.lit(n).alias("request"), F.lit(op).alias("op"), F.to_json(F.struct("*")).alias("result"), F.lit(None).cast("string").alias("error")))
        except KeyError as e:
            why = f"unknown op: {op}" if op not in OPERATIONS else f"missing argument: {e.args[0]}"
            parts.append(spark.createDataFrame([(n, op, None, why)], "request int, op string, result string, error string"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "request int, op string, result string, error string")


#: A model's tools by name, the operation each runs and its defaults.
TOOLS = {
    "code_searcher_line": ("line", {"before": 80, "after": 120}),
    "code_searcher_function": ("function", {"before": 8, "after": 8}),
    **{f"code_searcher_{op}": (op, {}) for op in ("callers", "callees", "grep", "struct", "field", "macro", "file_outline", "containing", "search_symbol")},
}


def execute_tool(lines: DataFrame, name: str, args: dict, limit: int = 24_000) -> str:
    """What a model's tool call gets back: text of matching or numbered lines, JSON rows of other results, an error as JSON."""
    try:
        if name == "code_searcher_batch":
            return tool_text(batch(lines, args["requests"]).select(F.to_json(F.struct("*")).alias("text")), limit=limit)
        op, defaults = TOOLS[name]
        rows = OPERATIONS[op](lines, defaults | args)
        return tool_text(rows if "text" in rows.columns and op not in ("macro", "file_outline") else rows.select(F.to_json(F.struct("*")).alias("text")), limit=limit)
    except Exception as e:  # noqa: BLE001 - the model is told
        return json.dumps({"error": str(e), "tool": name})


def tool_text(rows: DataFrame, column: Column | str = "text", limit: int = 24_000) -> str:
    """The text of a bounded result, as a model's tool call gets it: rows in order, cut at ``limit`` characters."""
    text = "\n".join(r[0] or "" for r in rows.select(column).limit(limit).toLocalIterator())
    return text if len(text) <= limit else text[:limit] + f"\n{CUT_NOTE}"
