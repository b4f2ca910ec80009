"""Survivors, formatting copies, term counts and mixing against brute force, with their edge cases."""

import json
import re

import pytest
from pyspark.sql import functions as F

from faultloom.llm import copies, mixing, survivors, terms

CARD = """card_id long, cluster_key string, repro struct<has_syz_repro:boolean,has_c_repro:boolean,syscall_hints:array<string>>,
reproducer_semantics struct<syscalls:array<string>,bpf_program_types:array<string>,bpf_helpers:array<string>,bpf_map_types:array<string>,bpf_map_ops:array<string>,tracepoints:array<string>,socket_ops:array<string>,semantic_tokens:array<string>,syz_repro_excerpt:string>,
stack_semantic array<struct<func:string,file:string,line:int,inline:boolean,raw:string>>,
sanitizer_context struct<alloc_trace:array<struct<func:string,file:string,line:int,inline:boolean,raw:string>>,free_trace:array<struct<func:string,file:string,line:int,inline:boolean,raw:string>>,origin_trace:array<struct<func:string,file:string,line:int,inline:boolean,raw:string>>,lockdep_registered_trace:array<struct<func:string,file:string,line:int,inline:boolean,raw:string>>>, g string, row_id int"""


def frame(f, file=None, line=None):
    return (f, file, line, False, "raw")


def best(spark, rows):
    df = spark.createDataFrame(rows, CARD)
    got = survivors.ranked_survivors(df, survivors.cluster_group(), "card_id", survivors.crash_card_completeness())
    return {(r["group_id"], r["field_name"]): (r["row_id"], r["n_rows"]) for r in got.collect()}


def card(i, key, repro=None, sem=None, stack=None, ctx=None):
    return (i, key, repro, sem, stack, ctx, "clash", 0)


def test_survivors(spark):
    sem = lambda calls, text: (calls, None, None, None, None, None, None, None, text)
    rows = [
        card(3, "A::b", (True, None, ["x", "?", None, "X "]), sem(["a"], "close(r1)"), [frame("f", "a.c", None), None, frame("?")], None),
        card(1, "a b", (True, False, []), sem(["a", "A"], "close(r1)\nopen"), [frame("f", "a.c", 3)], ([], None, None, [frame("", "n/a", None)])),
        card(2, "AB", (True, False, ["x"]), None, [frame("F ", "A.C", 3), frame("f", "a.c", 3)], None),
        card(9, "alone", (True, True, []), None, None, None),
        card(10, None, (True, True, []), None, None, None),
        card(11, None, None, None, None, None),
    ]
    assert best(spark, rows) == {(1, "repro"): (2, 3), (1, "reproducer_semantics"): (1, 3), (1, "stack_semantic"): (1, 3)}
    assert best(spark, []) == {}


def test_surviving_records_take_each_field_from_its_best_row(spark):
    df = spark.createDataFrame([(1, "g", "aa", ["x"]), (2, "g", "b", ["x", "y"]), (3, "h", None, None), (4, "h", None, None)], "id long, k string, s string, l array<string>")
    best = survivors.ranked_survivors(df, F.col("k"), "id", {"s": [F.coalesce(F.length("s"), F.lit(0))], "l": [F.coalesce(F.size("l"), F.lit(0))]})
    rows = survivors.surviving_records(df, best, "id", ["s", "l"]).collect()
    assert [(r["group_id"], r["n_rows"], r["s_from"], r["s"], r["l_from"], r["l"]) for r in rows] == [(1, 2, 1, "aa", 2, ["x", "y"])]


def test_survivors_rank_by_trust_then_recency(spark):
    df = spark.createDataFrame([(1, "g", 1, 1, 5), (2, "g", 1, 2, 1), (3, "g", 1, 2, 9), (4, "g", 0, 9, 9)], "id long, k string, n int, trust int, at int")
    got = survivors.ranked_survivors(df, F.col("k"), "id", {"f": [F.col("n")]}, F.col("trust"), F.col("at")).collect()
    assert [r["row_id"] for r in got] == [3]


def brute_canon(o):
    if isinstance(o, str):
        return "s" + re.sub(r"[\W_]+", "", o.lower())
    if isinstance(o, dict):
        return ("d", tuple(sorted((k, brute_canon(v)) for k, v in o.items())))
    if isinstance(o, list):
        return ("l", tuple(map(brute_canon, o)))
    return (type(o).__name__, o)


def test_json_copies(spark):
    base = {"case_id": "r1__x", "attempt": 3, "stack": [{"func": "a_b", "line": 1}, {"func": "c", "line": None}]}
    texts = [
        json.dumps(base), " " + json.dumps(dict(reversed(base.items())), indent=2).replace("a_b", "A B;") + "\r\n", "﻿" + json.dumps(base).replace("r1__x", "R1 \\\"x\\/"),
        json.dumps(base | {"attempt": 4}), json.dumps(base | {"attempt": "3"}), json.dumps(base | {"stack": base["stack"][::-1]}), json.dumps(base | {"more": None}),
        json.dumps(base)[:-5], json.dumps(base) + "}", "", None, "{}", " { } ", '"a b"', '"A-B"', "[1]", '{"a": {}}', '{"a": []}',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "line_id long, body string")
    got = {(r["first_id"], r["copy_id"]) for r in copies.copies(copies.line_tuples(df), "t").collect()}
    assert got == {(0, 1), (0, 2), (11, 12), (13, 14)}
    assert copies.copies(copies.line_tuples(df.limit(0)), "t").count() == 0


def test_typed_copies(spark):
    kind = "row_id long, bug_id string, case_id string, final_ground_truth_id string, rid int, record string"
    rows = [(5, "A b", "r1_x", None, 1, ""), (2, "ab", "R1x ", None, 2, ""), (7, "ab", "r1x", "", 3, ""), (8, "ab", "r1x", "-", 4, ""), (9, None, None, None, 5, ""), (10, None, None, None, 6, "")]
    got = {(r["first_id"], r["copy_id"]) for r in copies.copies(copies.label_tuples(spark.createDataFrame(rows, kind)), "t").collect()}
    assert got == {(2, 5), (7, 8), (9, 10)}
    df = spark.createDataFrame(rows, kind)
    counts = copies.record_counts(df, "row_id", copies.copies(copies.label_tuples(df), "t"))
    assert sorted(tuple(r) for r in counts.collect()) == [(2, 2), (7, 2), (9, 2)]


def test_card_copies_with_maps_and_pruning(spark):
    kind = "card_id long, case_id string, crash_uid string, kernel_commit string, normalized_report_digest string, config map<string,string>, tokens array<string>, source_file string, ingested_at int"
    rows = [
        (1, "c1", "u", "k", None, {"A_B": "y", "Z": "n"}, ["x", "y"], "f", 1),
        (4, "C-1", "u", "k", None, {"Z": "N", "a b": "y"}, ["X", "y."], "g", 2),
        (5, "c1", "u", "k", None, {"A_B": "y", "Z": "n"}, ["y", "x"], "f", 1),
        (6, "c2", "u", "k", "d", None, None, "f", 1),
    ]
    got = {(r["first_id"], r["copy_id"]) for r in copies.copies(copies.card_tuples(spark.createDataFrame(rows, kind)), "t").collect()}
    assert got == {(1, 4)}


def test_one_group_of_copies_holding_most_rows(spark):
    rows = [(i, "b", "c", "l") if i % 3 else (i, f"b{i}", "c", "l") for i in range(300)]
    t = copies.label_tuples(spark.createDataFrame(rows, "row_id long, bug_id string, case_id string, final_ground_truth_id string"))
    assert copies.copies(t, "t").count() == 199


def test_copies_equal_brute_force(spark, data):
    import duckdb

    import __spark_entry__ as entry

    got = {tuple(r) for r in entry.queries()["p2_found"](spark, data).collect()}
    con, want = duckdb.connect(), set()
    cols = [c[0] for c in con.execute(f"DESCRIBE SELECT * FROM '{data}/crash_cards.parquet'").fetchall() if c[0] not in copies.CARD_COLUMNS_IGNORED]

    def add(table, rows):
        groups = {}
        for i, key in rows:
            groups.setdefault(key, []).append(i)
        want.update((table, min(g), i) for g in groups.values() for i in g if i != min(g))

    add("crash_cards", [(r[0], brute_canon(list(r[1:]))) for r in con.execute(f"SELECT card_id, {','.join(c for c in cols if c != 'card_id')} FROM '{data}/crash_cards.parquet'").fetchall()])
    add("case_labels", [(r[0], brute_canon(list(r[1:]))) for r in con.execute(f"SELECT row_id, bug_id, case_id, final_ground_truth_id FROM '{data}/case_labels.parquet'").fetchall()])
    lines = []
    for i, b in con.execute(f"SELECT line_id, body FROM '{data}/crash_lines.parquet'").fetchall():
        try:
            lines.append((i, brute_canon(json.loads(b.strip("﻿ \r\n\t\x00")))))
        except ValueError:
            pass
    add("crash_lines", lines)
    assert got == want


def test_terms(spark):
    rows = [(["A b", "a__b", " a_B\t", None, " ", "x"], 1), (["x", "y"], 2), (None, 3), ([], 4), (["x"] * 50, 5)]
    df = spark.createDataFrame(rows, "t array<string>, term int")
    for heavy in (1, 256):
        got = {r["term"]: (r["occurrences"], r["records"]) for r in terms.term_frequencies(df, {"f": F.col("t")}, heavy).collect()}
        assert got == {"a_b": (3, 1), "x": (52, 3), "y": (1, 1)}
    marks = {r["term"]: r["mark"] for r in terms.marked(terms.term_frequencies(df, {"f": F.col("t")}), df.count(), 1).collect()}
    assert marks == {"a_b": "rare", "x": "common", "y": "rare"}
    assert terms.term_frequencies(df.limit(0), {"f": F.col("t")}).count() == 0


def test_water_filling():
    shares = {"a": 0.5, "b": 0.3, "c": 0.2, "none": 0.0}
    assert mixing.water_filling(shares, dict.fromkeys(shares, 1e9), 100) == pytest.approx({"a": 50, "b": 30, "c": 20, "none": 0})
    got = mixing.water_filling(shares, {"a": 10, "b": 1e9, "c": 20, "none": 5}, 100)
    assert got == pytest.approx({"a": 10, "b": 70, "c": 20, "none": 0})
    assert mixing.water_filling(shares, {"a": 1, "b": 1, "c": 0, "none": 1}, 100) == pytest.approx({"a": 1, "b": 1, "c": 0, "none": 0})


def test_feasible_total():
    assert mixing.feasible_total({"a": 0.5, "b": 0.3, "gone": 0.2}, {"a": 50, "b": 60, "gone": 0}) == pytest.approx(80)
    assert mixing.feasible_total({}, {}) == 0 and mixing.feasible_total({"a": 1.0}, {"a": 0}) == 0


def test_feasible_mixture_meets_all_shares(spark):
    docs = spark.createDataFrame([(i, "a" if i % 4 else "b", "some words here " * (2 + i % 3)) for i in range(2000)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    shares = {r["source"]: r for r in mixing.mixture(docs, targets, "feasible")[1].collect()}
    assert all(abs(r["actual_share"] - 0.5) < 0.01 for r in shares.values()) and shares["b"]["epochs"] == pytest.approx(2, abs=0.05)


def test_mixture(spark):
    docs = spark.createDataFrame([(i, ("a", "b", "c", None, "unlisted")[i % 5], f"word {i} " * (3 + i % 7) if i % 11 else None) for i in range(500)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.7, 3), ("b", 0.2, None), ("c", 0.05, 1), ("gone", 0.05, 4)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mixture(docs, targets)
    rows, shares = mixed.collect(), {r["source"]: r for r in report.collect()}
    assert {r["source"] for r in rows} == {"a", "b", "c"} and max(r["copies"] for r in rows if r["source"] == "a") <= 3
    assert max(r["copies"] for r in rows if r["source"] != "a") <= 1 and len({r["doc_id"] for r in rows}) == len(rows)
    used = {s: sum(r["n_tokens"] * r["copies"] for r in rows if r["source"] == s) for s in "abc"}
    for s in "abc":
        assert shares[s]["used_tokens"] == used[s] and abs(used[s] - shares[s]["planned_tokens"]) < 40
    assert sum(r["actual_share"] for r in shares.values()) == pytest.approx(1) and shares["gone"]["used_tokens"] == 0
    assert sorted(mixed.collect()) == sorted(mixing.mixture(docs.repartition(7), targets)[0].collect())
    assert mixing.mixture(docs.limit(0), targets)[0].count() == 0 and mixing.mixture(docs, targets.limit(0))[1].count() == 0
