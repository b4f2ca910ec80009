"""Cards from directories, buckets, quality, cause cards, features and resuming, end to end on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from faultloom.operators import buckets as bk
from faultloom.operators import cause_cards as cc
from faultloom.operators import features as ft
from faultloom.operators import quality as ql
from faultloom.operators.cards import make_cards
from faultloom.sources import artifacts as ar
from faultloom.sources import models, sinks
from tests.test_reports import KASAN, LOCKDEP


@pytest.fixture(scope="module")
def crash_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("bugs")
    for case, report, files in (("c1", KASAN, {}), ("c2", KASAN, {"repro.syz": "socket$x(0x1)\n"}), ("c3", LOCKDEP, {}), ("c4", "", {})):
        d = root / "bug1" / "crashes" / case
        d.mkdir(parents=True)
        (d / "crash_meta.json").write_text(json.dumps({"title": "KASAN: slab-use-after-free Read in sock_fetch" if report == KASAN else "", "kernel": "tree"}))
        (d / "report.txt").write_text(report)
        for name, text in files.items():
            (d / name).write_text(text)
    lost = root / "bug1" / "crashes" / "c5"
    lost.mkdir()
    (lost / "report.txt").write_bytes(b"\xff\xfe no meta")
    return str(root)


@pytest.fixture(scope="module")
def cards(spark, crash_root):
    return bk.with_cluster_key(make_cards(ar.crash_directories(spark, crash_root))).cache()


def test_cards(cards):
    rows = {r["case_id"]: r for r in cards.collect()}
    assert sorted(rows) == ["c1", "c2", "c3", "c4"]
    a = rows["c1"]
    assert a["bug"]["bug_type"] == "use-after-free" and a["fault"]["primary_function"] == "sock_fetch"
    assert [f["func"] for f in a["stack_semantic"]] == ["sock_fetch", "sock_release"]
    assert a["signature_fields"]["alloc_funcs_top3"] == ["sock_new"] and a["source_context"]["subsystems"] == ["net"]
    assert a["layer2_signature_hash"] == rows["c2"]["layer2_signature_hash"] != rows["c3"]["layer2_signature_hash"]
    assert rows["c3"]["lockdep_context"]["held_locks"] and rows["c1"]["lockdep_context"] is None
    assert rows["c4"]["title"] == "c4" and rows["c4"]["bug"]["bug_type"] == "unknown" and rows["c4"]["stack_raw"] == []


def test_signature_is_the_hash_of_its_json(cards):
    import hashlib

    r = cards.filter("case_id = 'c1'").collect()[0]
    s = r["layer2_signature_debug"]
    text = json.dumps([s["sanitizer"], s["bug_type"], s["access"], s["primary"], *[s[k] for k in ("stack", "alloc", "free", "origin", "registered")]], ensure_ascii=False)
    assert r["layer2_signature_hash"] == hashlib.sha256(text.encode()).hexdigest()[:16]


def test_limits_count_before_metadata(spark, crash_root):
    assert ar.crash_directories(spark, crash_root, 1, 2).count() == 2
    assert ar.crash_directories(spark, crash_root, 0).count() == 0


def test_representatives_and_weights(spark, cards):
    labels = spark.createDataFrame([("bug1", "c1", "ndss:x", 1), ("bug1", "c1", "b", 2), ("bug1", "c2", "b", 3), ("bug1", "c2", "ndss:x", 4)], "bug_id string, case_id string, final_ground_truth_id string, row_id long")
    rows = {r["source_crash_id"]: r for r in bk.representative_rows(cards, labels, "row_id").collect()}
    assert set(rows) == {"c2", "c3", "c4"}  # c2 has a reproducer
    r = rows["c2"]
    assert (r["final_ground_truth_id"], r["directory_name"], r["ndss_patch"]) == ("ndss:x", "ndss__x", "x")  # tie: seen first
    assert (r["unique_case_count"], r["represented_crash_row_count"], r["duplicate_row_count"]) == (2, 4, 2)
    assert rows["c3"]["represented_crash_row_count"] == 1 and rows["c3"]["final_ground_truth_id"] == ""
    assert bk.representative_rows(cards, labels, "row_id").columns == bk.REPRESENTATIVE_COLUMNS
    assert bk.run_summary(cards, bk.representative_rows(cards, labels, "row_id")).collect()[0]["labels"] == 1


def test_quality(cards):
    rows = {r["case_id"]: r["input_quality"] for r in ql.input_quality(cards).collect()}
    assert rows["c4"]["tier"] == "minimal" and rows["c4"]["confidence_cap"] == "low"
    assert rows["c4"]["missing_or_weak_evidence"] == sorted(["no_stack", "no_anchor_trace", "missing_primary_function", "missing_primary_file"])
    assert rows["c1"]["tier"] == "limited" and rows["c1"]["metrics"]["domain_frame_count"] == 2


def test_packing_keeps_later_shorter_sections(spark):
    df = spark.createDataFrame([(["aaaa", "bbbbbbbbbb", "", "cc", None],), ([],), (None,)], "x array<string>")
    assert [r[0] for r in df.select(ql.packed(F.col("x"), 6)).collect()] == [["aaaa", "cc"], [], None]
    assert spark.range(1).select(ql.packed(F.array(F.lit("too long")), 3)).collect()[0][0] == ["too long"]


def test_sanitizer_and_primary_frames(cards):
    df = cards.withColumn("p", ql.domain_prefix(cards)).filter("case_id = 'c1'")
    r = df.select(ql.sanitizer_frames(df, F.col("p"), 9).alias("s"), ql.primary_source_frame(df).alias("f"), "p").collect()[0]
    assert r["p"] == "net/demo/" and r["f"]["func"] == "sock_fetch"
    assert [(f["trace_kind"], f["func"]) for f in r["s"]] == [("free_trace", "sock_put"), ("alloc_trace", "sock_new")]


RAWS = {
    "c1": 'x ```json\n{"cause_id": "own", "root_cause_signals": [{"name": "sk->sk_ref", "dedup_weight": "high"}, 3], "dedup_representation": {"must_match_tokens": [" field:a ", "", null]}, "uncertainty": ["why"]}\n``` y',
    "c2": '{"root_cause": {"root_object": {"name": "timer", "type": "struct demo_sock"}, "root_cause_location": "net/a.c:f:12", "violated_invariant": "must hold"}, "confidence": "HIGH", "fix_semantics": "add refcount", "propagation_path": ["a", {"from": "x", "detail": "timer callback"}]}',
    "c3": "no json",
}


@pytest.fixture(scope="module")
def causes(spark, cards):
    raw = spark.createDataFrame(list(RAWS.items()), "case_id string, body string").select("case_id", cc.extract_json(F.col("body")).alias("raw"))
    joined = cards.join(raw, "case_id", "left").withColumns({"hash_part": F.lit("h8"), "small_bucket_id": F.col("cluster_key")})
    return cc.normalize_cause_cards(joined).cache()


def test_cause_cards(causes):
    rows = {r["source_crash_id"]: r for r in causes.collect()}
    a, b, c, d = (rows[k] for k in ("c1", "c2", "c3", "c4"))
    assert a["cause_id"] == "own" and [s["signal_id"] for s in a["root_cause_signals"]] == ["S1"]
    assert a["root_cause_signals"][0]["signal_type"] == "field" and a["dedup_representation"]["must_match_tokens"] == ["field:a"]
    assert a["uncertainty"][0]["aspect"] == "uncertainty_1"
    assert b["cause_id"] == "h8" and b["evidence_ledger"][1]["location"] == "net/a.c:f:12"
    assert b["root_cause_signals"][0]["name"] == "demo_sock.timer"
    assert b["patch_semantics_hypotheses"][0]["shape"] == "fix_lifetime"
    assert [p["mechanism"] for p in b["propagation_signals"]] == ["other", "callback"]
    assert b["invariant_signals"][0]["expected"] == "must hold"
    assert b["representation_confidence"]["level"] == "medium"  # capped by the input's quality
    assert c["crash_surface"]["sanitizer"] == "LOCKDEP" and c["lockdep_context"]["bpf_tracepoint_bridge"]["present"]
    assert d["representation_confidence"]["level"] == "low" and d["dedup_representation"]["must_match_tokens"] == []
    assert d["uncertainty"][-1]["aspect"] == "input_quality_cap"


def test_features(causes):
    rows = {r["source_crash_id"]: r for r in ft.final_fields(ft.token_fields(causes)).collect()}
    f = rows["c1"]["fields"]
    assert "field:a" in f["object"] and "field:a" not in f["must"] and "sk->sk_ref" in f["object"]
    assert rows["c1"]["field_texts"]["object"].startswith("[object]\ntoken: field:a ; words: field a")
    assert rows["c2"]["fields"]["propagation"]


def test_tool_usage(spark):
    t = spark.createDataFrame([('[{"round": 2, "args": {"symbol": "b", "file": "x.c"}}, {"round": 1, "args": {"requests": [{"name": "a"}, 3]}}]',)], "t string")
    u = t.select(cc.tool_usage(F.parse_json("t")).alias("u")).collect()[0]["u"]
    assert (u["rounds_used"], u["functions_examined"], u["files_examined"]) == (2, ["a", "b"], ["x.c"])


def test_conversations(spark):
    def client():
        def call(messages, tools):
            if tools and not any(m["role"] == "tool" for m in messages):
                return {"content": None, "tool_calls": [{"name": "grep", "args": {"pattern": messages[0]["content"]}}]}
            if messages[0]["content"] == "bad":
                return {"content": "no json"}
            return {"content": json.dumps({"saw": messages[-1]["content"]})}

        return call

    tasks = spark.createDataFrame([("1", "abc"), ("2", "bad")], "task_id string, prompt string")
    rows = {r["task_id"]: r for r in models.answers(tasks, client, lambda: lambda name, args: f"{name}:{args['pattern']}").collect()}
    assert rows["1"]["status"] == "ok" and json.loads(rows["1"]["content"]) == {"saw": "grep:abc"} and rows["1"]["rounds"] == 1
    assert rows["2"]["status"] == "json_parse_failed"


def test_forced_final_and_errors():
    asked = []

    def always(messages, tools):
        asked.append(tools)
        return {"tool_calls": [{"name": "t", "args": {}}]} if tools else {"content": "{}"}

    assert models.converse("p", always, lambda n, a: "x" * 30_000, wait=0)[0] == "ok" and asked == [True] * 12 + [False]

    def broken(messages, tools):
        raise OSError("down")

    assert models.converse("p", broken, lambda n, a: "", wait=0)[0] == "api_error"


def test_tasks_lookups_and_sinks(spark, cards, tmp_path):
    (tmp_path / "list.txt").write_text("# c\n\nout/bug1/crash_cards/small_bucket_rep/001__aaaa.json\nout/bug1/crash_cards/small_bucket_rep/002__bbbb.json\n")
    tasks = ar.card_tasks(ar.task_list(spark, str(tmp_path / "list.txt")), "causes")
    assert [(r["bug_id"], r["hash_part"], r["output"]) for r in tasks.orderBy("path").collect()] == [("bug1", "aaaa", "causes/bug1/aaaa.json"), ("bug1", "bbbb", "causes/bug1/bbbb.json")]
    done = spark.createDataFrame([("bug1", "aaaa")], "bug_id string, hash_part string")
    assert [r["hash_part"] for r in ar.pending(tasks, done, ["bug_id", "hash_part"]).collect()] == ["bbbb"]
    assert sorted((r["hash_part"], r["exists"]) for r in ar.manifest(tasks, done, ["bug_id", "hash_part"]).collect()) == [("aaaa", True), ("bbbb", False)]
    listing = spark.createDataFrame([("bug1/x_aaaa_v2.json",), ("deep/er/bbbb.json",), ("d/f.json",)], "path string")
    weights = spark.createDataFrame([("aaaa", "bug1", "", ""), ("bbbb", "bug1", "", ""), ("q", "bug1", "d", "f.json"), ("zz", "", "", "")], "cause_card_id string, source_bug_id string, directory_name string, copied_file_name string")
    assert {r["cause_card_id"]: r["card_path"] for r in ar.find_cause_cards(weights, listing).collect()} == {"aaaa": "bug1/x_aaaa_v2.json", "bbbb": "deep/er/bbbb.json", "q": "d/f.json", "zz": None}
    sinks.write_cards(cards, str(tmp_path / "cards"))
    assert spark.read.json(str(tmp_path / "cards")).count() == 4
    sinks.write_table(cards.select("case_id", "title", "anchor_trace"), str(tmp_path / "csv"))
    assert ar.csv_table(spark, str(tmp_path / "csv")).columns == ["anchor_trace", "case_id", "title"]
    odd = spark.createDataFrame([("ü", 1)], "b string, a int")
    sinks.write_json_lines(odd, str(tmp_path / "jsonl"))
    assert spark.read.text(str(tmp_path / "jsonl")).collect()[0][0] in ('{"a": 1, "b": "\\u00fc"}', '{"a":1,"b":"\\u00fc"}')
    assert ar.json_lines(spark, str(tmp_path / "jsonl")).count() == 1


def test_ground_truth_csv(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes("﻿bug_id,case_id,final_ground_truth_id\nb,c,\nb,\"d,e\",x\n".encode())
    rows = ar.ground_truth(spark, str(tmp_path / "g.csv")).orderBy("row_order").collect()
    assert [(r["case_id"], r["final_ground_truth_id"]) for r in rows] == [("c", ""), ("d,e", "x")]
    assert ar.ground_truth(spark, None).count() == 0


def test_build_records_names_missing(spark):
    weights = spark.createDataFrame([("a", "0", "", "d", "f"), ("b", "", "2", "d", "g")], "cause_card_id string, represented_crash_row_count string, unique_case_count string, directory_name string, copied_file_name string")
    cards = spark.createDataFrame([("a",), ("b",)], "cause_card_id string")
    rows = {r["cause_card_id"]: (r["weight"], r["unique_case_count"], r["record_id"]) for r in ft.build_records(weights, cards, ["cause_card_id"]).collect()}
    assert rows == {"a": (0.0, 0.0, "d/f"), "b": (1.0, 2.0, "d/g")}
    with pytest.raises(ValueError, match="1 rows, first: b"):
        ft.build_records(weights, cards.filter("cause_card_id = 'a'"), ["cause_card_id"])


def test_env_and_api_files(tmp_path, monkeypatch):
    monkeypatch.delenv("FL_TEST_KEY", raising=False)
    (tmp_path / "e").write_text("# x\n$env:FL_TEST_KEY='v'\nPATH=never\n")
    assert models.load_env_file(str(tmp_path / "e")) == {"FL_TEST_KEY": "v"}
    monkeypatch.delenv("FL_TEST_KEY")
    (tmp_path / "a").write_bytes("地址 https://host/v1 Bearer sk-abcdefgh12".encode("gbk"))
    assert models.load_api_file(str(tmp_path / "a")) == ("https://host/v1", "sk-abcdefgh12")


def test_all_stages_on_files(spark, crash_root, tmp_path):
    from faultloom.operators import source_search as ss
    from faultloom.plans import stages

    out = str(tmp_path)
    (tmp_path / "g.csv").write_text("bug_id,case_id,final_ground_truth_id\nbug1,c1,l1\nbug1,c3,l2\n")
    totals = stages.crash_card_stage(spark, crash_root, f"{out}/s1", str(tmp_path / "g.csv")).collect()[0]
    assert (totals["bugs"], totals["unique_cases"], totals["representatives"], totals["labels"]) == (1, 4, 3, 2)
    again = stages.crash_card_stage(spark, crash_root, f"{out}/s1", str(tmp_path / "g.csv"), resume=True).collect()[0]
    assert tuple(again) == tuple(totals)
    weights = ar.csv_table(spark, f"{out}/s1/representative_weights")
    assert weights.count() == 3
    reps = spark.read.schema(spark.read.parquet(f"{out}/s1/cards_parquet").schema).json(f"{out}/s1/representatives").drop("bug_folder")
    source = "#define BIG 1\nint sock_fetch(int a)\n{\n\treturn BIG;\n}\n" + "\n" * 115 + "/* BIG */\n"
    lines = ss.source_lines(spark.createDataFrame([("net/demo/sock.c", source)], "path string, text string"))
    asked = stages.prompts(reps.filter("case_id = 'c2'"), lines, "contract").collect()[0]["prompt"]
    for part in ("contract", "## Prefetch Notes", "## Crash File Outline", "## Crash Line Context", "## Nearby Macro Definitions", "#define BIG 1", "## Primary Function: sock_fetch", "net/demo/sock.c:2..5"):
        assert part in asked, part
    assert stages.cause_card_stage(spark, reps, f"{out}/s2").filter("exists").count() == 0  # dry run

    def client():
        return lambda messages, tools: {"content": "nothing" if '"case_id":"c4"' in messages[0]["content"] else '{"root_cause": {"object": "sk"}, "dedup_fingerprint": "a b"}'}

    listed = {r["case_id"]: r["exists"] for r in stages.cause_card_stage(spark, reps, f"{out}/s2", client=client, lines=lines).collect()}
    assert listed == {"c2": True, "c3": True, "c4": False} and spark.read.parquet(f"{out}/s2/unreadable").count() == 1
    assert stages.cause_card_stage(spark, reps, f"{out}/s2", client=client, limit=1).count() == 1
    causes = spark.read.json(f"{out}/s2/cause_cards")
    kept = weights.join(causes.select("source_crash_id"), "source_crash_id", "left_semi")
    assert stages.clustering_stage(spark, kept, causes, f"{out}/s3", dims=16, dry_run=True) is None
    chosen = stages.clustering_stage(spark, kept, causes, f"{out}/s3", dims=16).collect()
    assert len(chosen) == 1 and chosen[0]["item_count"] == 2
    assert spark.read.csv(f"{out}/s3/grid", header=True).count() == 41
    assert spark.read.csv(f"{out}/s3/assignments_selected", header=True).count() == 2
