"""Searching a small source tree."""

import pytest

from faultloom.operators import source_search as ss

A = '''#include "x.h"
#define DEMO_MAX 10
/* target(1) in a comment
 * target(2) { too
 */
static int helper(int a);
static int target(int a, int b)
{
\tprintk("} %s {", a);
\tif (a) {
\t\treturn helper(b) + DEMO_MAX;
\t}
\treturn s->field;
}

static long
split_def(int a,
\t  int b)
{
\treturn target(a, b);
}
'''
B = "struct demo_s {\n\tint field;\n\tchar *name; \n\t/* x; */\n};\nint use(struct demo_s *s)\n{\n\ts.field = target(1, 2);\n}\n"


@pytest.fixture(scope="module")
def lines(spark):
    files = [("net/a.c", A), ("include/b.h", B), ("../evil.c", "target(\n"), ("/abs.c", "x"), ("doc.txt", "target("), ("empty.c", "")]
    return ss.source_lines(spark.createDataFrame(files, "path string, text string")).cache()


def test_lines_refuse_outside_paths(lines):
    assert {r["path"] for r in lines.select("path").distinct().collect()} == {"net/a.c", "include/b.h", "doc.txt"}


def test_grep_and_limits(lines):
    hits = ss.grep(lines, r"target[[:space:]]*\(").collect()
    assert [(r["path"], r["lineno"]) for r in hits] == [("include/b.h", 8), ("net/a.c", 3), ("net/a.c", 4), ("net/a.c", 7), ("net/a.c", 20)]
    cut = ss.grep(lines, "target", limit=40).collect()
    assert [r["cut"] for r in cut] == [False, True]
    assert ss.grep(lines, "target", ["*.txt"]).count() == 1
    assert ss.search_symbol(lines, "arget").count() == 0
    assert [r["lineno"] for r in ss.find_field_usage(lines, "field").orderBy("path").collect()] == [8, 13]
    assert ss.macro_definitions(lines, "DEMO_MAX").collect()[0]["text"] == "#define DEMO_MAX 10"
    assert ss.find_callers(lines, "helper").count() == 2


def test_function_bounds(lines):
    f = ss.get_function(lines, "target", before=0, after=1).collect()
    a = next(r for r in f if r["file"] == "net/a.c")
    assert (a["start_line"], a["end_line"], a["display_end"]) == (7, 14, 15)
    assert a["source"].startswith(">    7: static int target(int a, int b)\n     8: {")
    s = ss.get_function(lines, "split_def").collect()[0]
    assert (s["start_line"], s["end_line"]) == (17, 21)
    assert ss.get_function(lines, "nowhere").count() == 0


def test_callees_struct_containing(spark, lines):
    c = ss.find_callees(lines, "target", "net/a.c").collect()[0]
    assert (c["callees"], c["callee_count"]) == (["target", "printk", "helper"], 3)
    s = ss.get_struct_def(lines, "demo_s").collect()[0]
    assert (s["file"], s["lines"], s["fields"]) == ("include/b.h", "1-5", ["int field", "char *name"])
    places = spark.createDataFrame([("net/a.c", 11), ("net/a.c", 1)], "file string, line int")
    found = {r["target_line"]: r for r in ss.find_containing_function(lines, places).collect()}
    assert (found[11]["function"], found[11]["func_start"], found[11]["func_end"]) == ("target", 7, 14)
    assert found[1]["function"] is None and found[1]["note"]


def test_outline_batch_and_text(lines):
    rows = ss.get_file_outline(lines, "net/a.c", 11).collect()
    assert [(r["kind"], r["name"]) for r in rows] == [("function", "target"), ("macro", "DEMO_MAX"), ("function", "split_def")] and rows[0]["contains_target"]
    out = ss.batch(lines, [{"op": "macro", "name": "DEMO_MAX"}, {"op": "zzz"}, {"op": "line", "file": "net/a.c"}]).collect()
    assert {(r["request"], r["error"]) for r in out} == {(0, None), (1, "unknown op: zzz"), (2, "missing argument: line")}
    assert ss.tool_text(ss.get_lines(lines, "net/a.c", 7, 1, 1)) == "       6: static int helper(int a);\n=>     7: static int target(int a, int b)\n       8: {"
    assert ss.tool_text(ss.get_lines(lines, "net/a.c", 7, 1, 1), limit=5).endswith(ss.CUT_NOTE)
    assert {r["function"] for r in ss.transitive_callees(lines, "split_def", 2).collect()} >= {"target", "helper"}
