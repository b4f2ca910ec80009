"""Heavy keys and drifting schemas against brute force, and their edge cases."""

import json

import pytest

from faultloom.operators import drift, skew

LABELS = "bug_id string, case_id string, final_ground_truth_id string, extra int"


def counts(spark, rows, **kw):
    from faultloom.plans.problems import LABEL_KEYS

    got = skew.per_key_counts(spark.createDataFrame(rows, LABELS), list(LABEL_KEYS), LABEL_KEYS, **kw)
    return {(r["key_field"], r["key_value"]): (r["rows"], r["distinct_0"], r["distinct_1"]) for r in got.collect()}


def test_salting_changes_nothing(spark):
    rows = [("hot" if i % 3 else f"b{i}", f"c{i % 50}", None if i % 7 == 0 else f"l{i % 4}", i) for i in range(400)] + [(None, None, None, 1)]
    salted = counts(spark, rows, share=0.01, salts=16)
    assert salted == counts(spark, rows, share=2.0)
    hot = [r for r in rows if r[0] == "hot"]
    assert salted["bug_id", "hot"] == (len(hot), len({r[1] for r in hot}), len({r[2] for r in hot if r[2]}))
    assert salted["bug_id", None] == (1, 0, 0)


def test_rows_alone_and_a_heavy_null_key(spark):
    rows = [("hot" if i % 3 else None, f"c{i}", "same", i) for i in range(300)] + [("b", None, None, 1)]
    df = spark.createDataFrame(rows, LABELS)
    got = {(r["key_field"], r["key_value"]): r["rows"] for r in skew.per_key_counts(df, ["bug_id", "final_ground_truth_id"]).collect()}
    assert got == {("bug_id", "hot"): 200, ("bug_id", None): 100, ("bug_id", "b"): 1, ("final_ground_truth_id", "same"): 300, ("final_ground_truth_id", None): 1}
    assert counts(spark, rows)["bug_id", None] == (100, 100, 1)
    assert skew.per_key_counts(df.limit(0), ["bug_id"]).count() == 0


def test_heavy_keys_are_bounded_and_empty_tables_work(spark):
    df = spark.createDataFrame([("k", f"v{i % 5}") for i in range(100)], "g string, key string")
    assert skew.heavy_keys(df, ["g", "key"], 0.2).count() == 5
    assert counts(spark, []) == {}


BODIES = "raw_id long, producer string, file_seq int, body string"


def log(spark, files):
    """files: {(producer, seq): [card or text]}"""
    rows, n = [], 0
    for (p, s), bodies in files.items():
        for b in bodies:
            n += 1
            rows.append((n, p, s, b if isinstance(b, str | type(None)) else json.dumps(b)))
    df = spark.createDataFrame(rows, BODIES)
    return {(r["producer"], r["file_seq"], r["field_path"], r["drift_kind"], r["new_path"]) for r in drift.drift_log(df).collect()}, df


def test_kinds_of_drift(spark):
    a = {"cause_id": "1", "old": {"f": 1, "g": [2]}, "t": 1, "gone": 1, "list": [{"x": "v"}], "e": []}
    b = {"cause_id": "1", "new": {"f": 1, "g": [2]}, "t": "1", "came": True, "list": [{"y": "v"}], "e": ["s"]}
    got, _ = log(spark, {("p", 1): [a, {"cause_id": "2", "gone": 5}], ("p", 2): ["```json\n" + json.dumps(b) + "\n```", "broken {", None, "[1]"], ("q", 1): [a]})
    assert got == {
        ("p", 2, "old", "renamed", "new"), ("p", 2, "t", "retyped", ""), ("p", 2, "gone", "removed", ""), ("p", 2, "came", "added", ""), ("p", 2, "list.x", "renamed", "list.y"),
    }


def test_values_decide_renames_and_ties(spark):
    got, _ = log(spark, {("p", 1): [{"cause_id": "1", "a": 1}, {"cause_id": "2", "a": 2}], ("p", 3): [{"cause_id": "1", "b": 1, "c": 1}, {"cause_id": "2", "b": 3, "c": 2}]})
    assert got == {("p", 3, "a", "renamed", "c"), ("p", 3, "b", "added", "")}
    got, _ = log(spark, {("p", 1): [{"cause_id": "1", "a": 1}], ("p", 2): [{"cause_id": "9", "b": 1}]})
    assert got == {("p", 2, "a", "removed", ""), ("p", 2, "b", "added", "")}  # no card in both


def test_fields_that_return_and_empty_tables(spark):
    one, two = {"cause_id": "1", "a": 1}, {"cause_id": "1"}
    got, df = log(spark, {("p", 1): [one], ("p", 2): [two], ("p", 3): [one], ("p", 4): ["nothing"]})
    assert got == {("p", 2, "a", "removed", ""), ("p", 3, "a", "added", "")}
    assert drift.lifespans(drift.file_catalogue(df)).filter("path = 'a'").count() == 2
    assert drift.drift_log(df.limit(0)).count() == 0


def test_consistent_table(spark):
    _, df = log(spark, {("p", 1): [{"cause_id": "1", "a": 1, "s": "x"}], ("p", 2): [{"cause_id": "1", "b": 1, "s": [1]}, "junk"]})
    table = drift.consistent_table(df)
    rows = sorted(table.select("file_seq", *[c for c in table.columns if c in ("card_a", "card_b", "card_s")]).collect())
    assert [tuple(r) for r in rows] == [(1, 1.0, "x"), (2, 1.0, "[1]")]


@pytest.mark.parametrize(("text", "ok"), [("", False), ("{", False), ('{"a": 1}', False), ('{"cause_id": "x"}', True), ('see {"cause_id": "x"} end', True), ("[" * 5000, False)])
def test_readable_cards(text, ok):
    assert (drift.readable_card(text) is not None) == ok


def test_consistent_table_unifies_every_depth(spark):
    a = {"cause_id": "1", "root": {"func": "f", "line": 3}, "sig": [{"from": "x", "n": 1}, {"from": "y", "n": 2}], "inv": "p", "it's]": 1}
    b = {"cause_id": "1", "root": [{"function": "f", "line": "3"}], "sig": [{"src": "x", "n": 1}, {"src": "y", "n": 2}], "inv": {"expected": "p"}, "it's]": 2}
    c = {"cause_id": "2", "root": {"func": "f", "line": 3}, "sig": {"from": "x", "n": 1}}
    _, df = log(spark, {("p", 1): [{**a, "root": [{"func": "f", "line": 3}]}], ("p", 2): [b], ("q", 1): [a, c], ("q", 2): [a]})
    rows = [r.asDict() for r in drift.consistent_table(df).orderBy("raw_id").collect()]
    assert [json.loads(r["card_root"]) for r in rows] == [[{"func": "f", "line": "3"}]] * 5
    assert [json.loads(r["card_sig"]) for r in rows] == [[{"from": "x", "n": 1}, {"from": "y", "n": 2}]] * 3 + [[{"from": "x", "n": 1}]] + [[{"from": "x", "n": 1}, {"from": "y", "n": 2}]]
    assert [r["card_inv"] and json.loads(r["card_inv"]) for r in rows] == [{"expected": None, "value": "p"}, {"expected": "p", "value": None}, {"expected": None, "value": "p"}, None, {"expected": None, "value": "p"}]
    assert [r["card_it's]"] for r in rows] == [1.0, 2.0, 1.0, None, 1.0]


def test_aliases_of_one_producer_do_not_merge_fields_of_another(spark):
    import json

    card = lambda i, **members: json.dumps({"cause_id": f"c{i}", **members})
    rows = [
        (1, "A", 1, card(1, x="same", n={"p": 1})), (2, "A", 2, card(1, y="same", n={"q": 1})),
        (3, "B", 1, card(2, x="left", y="right", **{"o'k": "quote", "b]r": "bracket"}, n={"p": 5, "q": 6})), (4, "C", 1, card(3, y="only")),
    ]
    got = {r["raw_id"]: r.asDict() for r in drift.consistent_table(spark.createDataFrame(rows, "raw_id long, producer string, file_seq int, body string")).collect()}
    first, other = ("card_x", "card_y") if got[1]["card_x"] == "same" else ("card_y", "card_x")
    assert got[1][first] == got[2][first] == "same" and got[1][other] is got[2][other] is None and got[4][first] == "only"
    assert {got[3][first], got[3][other]} == {"left", "right"} and got[3]["card_o'k"] == "quote" and got[3]["card_b]r"] == "bracket"
    assert [sorted(v for v in json.loads(got[i]["card_n"]).values() if v is not None) for i in (1, 2, 3)] == [[1], [1], [5, 6]]
