"""Lookups, budgets, numbering and rounds over tables, with hot groups and their edge cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from faultloom.functions import frames as fr
from faultloom.functions import reports as rp
from faultloom.operators import buckets as bk
from faultloom.operators import linkage as lk
from faultloom.operators import prefetch as pf
from faultloom.operators import quality as ql
from faultloom.operators import source_search as ss
from faultloom.sources import artifacts as ar


@pytest.mark.parametrize(
    "items, size, digest, first, last",
    [
        (fr.GENERIC_FUNC_PREFIXES, 55, "0a03e3b9bf90", "show_stack", "kvfree_rcu_bulk"),
        (fr.GENERIC_PATH_PREFIXES, 16, "f3651416808c", "arch/x86/entry/", "kernel/time/timer.c"),
        (fr.STOP_MARKERS, 27, "469ddffb32e5", "Allocated by task", "softirqs last"),
        (fr.REGISTERS, 22, "5872a7d1a24a", "Code", "EFLAGS"),
        (fr.CAUSE_GENERIC_FUNCTIONS, 27, "e6623d8319fb", "__dump_stack", "__se_sys_write"),
        (fr.LOW_VALUE_SINKS, 18, "c6c71f86d71b", "__warn", "copy_from_user"),
        (rp.CONFIG_KEYS, 26, "65ce1919716a", "CONFIG_KASAN", "CONFIG_KASAN_HW_TAGS"),
        (ss.NOT_CALLS, 38, "ccfd82d19ac2", "if", "typedef"),
        (bk.REPRESENTATIVE_COLUMNS, 19, "894f7ff38cfc", "final_ground_truth_id", "copied_target_file"),
        (rp.MAP_OPS, 6, "e94cfcc8784c", "MAP_CREATE", "PROG_LOAD"),
        (rp.HINT_PARTS, 16, "eb82b0866dea", "syz_", "r0 = "),
        (rp.NOISE_LEADS, 10, "b3af8b427cc2", "Code:", "---[ end trace"),
    ],
)
def test_fixed_lists_stay_as_they_are(items, size, digest, first, last):
    """The SQL of the queries takes these lists from the engine, so a change in them must show here."""
    assert (len(items), items[0], items[-1]) == (size, first, last)
    assert hashlib.sha256("\n".join(items).encode()).hexdigest()[:12] == digest


def test_fixed_values_stay_as_they_are():
    assert [m for _, m in rp.MASKS][:4] == ["<HEX>", "+<OFF>", "syz.N.N", "/N"]
    assert ql.TRIGGER_LISTS == ["syscalls", "bpf_program_types", "bpf_helpers", "bpf_map_types", "bpf_map_ops", "tracepoints", "socket_ops", "semantic_tokens"]
    assert rp.MAP_TYPES[0x12] == "SOCKHASH" and rp.MAP_TYPES[0xF] == "SOCKMAP" and rp.PROGRAM_TYPES[0x11] == "RAW_TRACEPOINT" and len(rp.MAP_TYPES) == 28


def test_callees_in_rounds(spark):
    chain = "".join(f"static int f{i}(void)\n{{\n\treturn f{i + 1}() + shared(1);\n}}\n" for i in range(5))
    far = "".join(f"int shared(int x)\n{{\n\tleaf_{i}();\n}}\n" for i in range(1))
    many = [(f"dir/z{i:02d}.c", f"void f3(void)\n{{\n\tonly_{i}();\n}}\n") for i in range(9)]
    lines = ss.source_lines(spark.createDataFrame([("a.c", chain), ("b.c", far), *many], "path string, text string"))
    got = {r["function"]: r["depth"] for r in ss.transitive_callees(lines, "f0", 4).collect()}
    assert got["f1"] == 1 and got["shared"] == 1 and got["f2"] == 2 and got["leaf_0"] == 2 and got["f3"] == 3 and "f0" not in got
    assert {f"only_{i}" for i in range(9)} <= set(got) and got["only_8"] == 4 and got["f4"] == 4
    assert ss.transitive_callees(lines, "nobody", 3).count() == 0


def test_budget_by_ranges(spark):
    rows = [(i, "hot" if i % 3 else None, 1 + i % 5) for i in range(3000)] + [(9000, "alone", None), (9001, "alone", 500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size int")
    got = {}
    for r in ql.running_budget(df, "source", "doc_id", "size", 400).collect():
        got.setdefault(r["source"], set()).add(r["doc_id"])
    for source in ("hot", None, "alone"):
        want, used = set(), 0
        for i, _, n in sorted((r for r in rows if r[1] == source), key=lambda r: r[0]):
            if used > 400:
                break
            want.add(i)
            used += n or 0
        assert got[source] == want
    assert ql.running_budget(df.limit(0), "source", "doc_id", "size", 1).count() == 0


def test_members_of_a_hot_bucket_are_numbered(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", f"c{(i * 7919) % 5000:05d}") for i in range(2000)] + [(None, "x"), (None, None), ("hot", "c00000")]
    got = {}
    for r in bk.bucket_members(spark.createDataFrame(rows, "cluster_key string, case_id string")).collect():
        got.setdefault(r["cluster_key"], []).append((r["position"], r["case_id"]))
    for key, members in got.items():
        members.sort()
        assert [p for p, _ in members] == list(range(1, len(members) + 1))
        assert [c for _, c in members] == sorted((c for k, c in rows if k == key), key=lambda c: (c is not None, c or ""))


def test_card_lookup_tiers(spark):
    listing = spark.createDataFrame([(p,) for p in ("dir/copied.json", "bug/abcdefghij.json", "bug/x_abcdefghijk_y.json", "far/off/zz_q1.json", "far/a/9__short.json", "far/aa/xshorty.json", "bug/none.txt")], "path string")
    rows = [("r1", "dir", "copied.json", "abcdefghij", "bug"), ("r2", "no", "no.json", "abcdefghij", "bug"), ("r3", "no", "no.json", "abcdefghijk", "bug"), ("r4", "no", "no.json", "short", "bug"), ("r5", "no", "no.json", "q1", "other"), ("r6", "no", "no.json", "missing", "bug"), ("r7", "no", "no.json", "", "bug"), ("r3", "no", "no.json", "abcdefghijk", "bug")]
    weights = spark.createDataFrame(rows, "r string, directory_name string, copied_file_name string, cause_card_id string, source_bug_id string")
    got = sorted((r["r"], r["card_path"]) for r in ar.find_cause_cards(weights, listing).collect())
    want = {"r1": "dir/copied.json", "r2": "bug/abcdefghij.json", "r3": "bug/x_abcdefghijk_y.json", "r4": "far/a/9__short.json", "r5": "far/off/zz_q1.json", "r6": None, "r7": None}
    assert got == sorted((r[0], want[r[0]]) for r in rows)
    assert ar.find_cause_cards(weights.limit(0), listing).count() == 0


def test_card_lookup_of_ids_that_begin_alike_broadcasts_no_names(spark, tmp_path):
    """Pieces of names are far more than their table's estimated size tells; a driver must not gather them."""
    stem = lambda i: f"aaaaaaaaaaaaaaaa_{hashlib.sha256(str(i % 40).encode()).hexdigest()[:8]}_{i}"
    paths = [(f"bug{i % 3}/x_{stem(i)}_y.json", f"far/z{stem(i)}.json", f"other/{i}.txt", f"{stem(i)}_root.json")[i % 4] for i in range(3000)] + ["bug1/9_q\u00e9.json", "far/\u00e9\u00e9\u00e9.json"]
    spark.createDataFrame([(p,) for p in paths], "path string").write.parquet(str(tmp_path / "listing"))
    rows = [(stem(i), ("bug0", "bug1", "bug2", "", None)[i % 5], hashlib.sha256(str(i).encode()).hexdigest()) for i in range(0, 3000, 2)] + [("q\u00e9", "bug1", "w"), ("\u00e9", "bug2", "w"), ("aaaaaaaa", "bug1", "w"), ("a" * 70, "bug1", "w"), ("", "bug1", "w")]
    spark.createDataFrame(rows, "cause_card_id string, source_bug_id string, note string").write.parquet(str(tmp_path / "weights"))
    by = lambda i, names: min((p for p in names if i and i in p.rsplit("/", 1)[-1] and p.endswith(".json")), default=None)
    want = {(i, bug): (bug and by(i, [p for p in paths if p.startswith(f"{bug}/")])) or by(i, paths) for i, bug, _ in rows}
    spark.conf.set("spark.sql.maxBroadcastTableSize", str(4 << 20))
    try:
        got = ar.find_cause_cards(spark.read.parquet(str(tmp_path / "weights")), spark.read.parquet(str(tmp_path / "listing"))).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert len(got) == len(rows) and {(r["cause_card_id"], r["source_bug_id"]): r["card_path"] for r in got} == want


def test_selected_cards(spark):
    listed = spark.createDataFrame([("a/b.json",), ("/abs/c.json",), ("a/../a/./b.json",), ("gone.json",)], "path string")
    there = spark.createDataFrame([("/root/a/b.json",), ("/abs/c.json",), ("/root/z.json",)], "path string")
    found, missing = ar.selected_cards(listed, there, "/root")
    assert sorted(r[0] for r in found.collect()) == ["/abs/c.json", "/root/a/b.json", "/root/a/b.json"] and [r[0] for r in missing.collect()] == ["/root/gone.json"]


def test_too_large_blocks_are_refused_before_any_task(spark, monkeypatch):
    monkeypatch.setattr(lk, "BLOCK_LIMIT", 3)
    df = spark.createDataFrame([(str(i), [float(i), 1.0], "a") for i in range(4)], "record_id string, vector array<float>, l string")
    with pytest.raises(ValueError, match="4 vectors"):
        lk.threshold_grid(df)
    with pytest.raises(ValueError, match="4 vectors"):
        lk.internal_scores(df, "l")


def test_macros_by_distance(spark):
    text = ">   10: int f(A_ONE, NULL)\n    11: return B_TWO + A_ONE;\n    30: C_THREE(B_TWO)\nno number D_FOUR"
    get = lambda t, n: spark.createDataFrame([(t, n)], "t string, n int").select(ql.nearest_macros(F.col("t"), F.col("n"), 2)).collect()[0][0]
    assert get(text, 29) == ["C_THREE", "B_TWO"] and get(text, 10) == ["A_ONE", "B_TWO"] and get(None, 3) == [] and get(text, None) == ["A_ONE", "B_TWO"]


def test_packets_show_macros_of_the_function_first(spark):
    code = "#define FN_MAX 3\n#define WINDOW_ONLY 4\n" + "int other;\n" * 10 + "static int probe(void)\n{\n\treturn FN_MAX;\n}\n" + "int more;\n" * 10 + "int x = WINDOW_ONLY;\n"
    more = "#define FN_MAX 9\n"
    lines = ss.source_lines(spark.createDataFrame([("fs/a/a.c", code), ("fs/b.h", more)], "path string, text string"))
    frame = [("probe", "fs/a/a.c", 15, False, "probe")]
    kind = f"case_id string, fault struct<primary_function:string,primary_file:string>, stack_semantic array<{fr.FRAME}>, stack_raw array<{fr.FRAME}>"
    cards = spark.createDataFrame([("c1", ("probe", "fs/a/a.c"), frame, []), ("c2", ("none", "fs/a/a.c"), [("none", "fs/a/a.c", 27, False, "none")], [])], kind)
    got = {r["case_id"]: r["packet"] for r in pf.source_packets(cards, lines).collect()}
    section = lambda p: p.split("## Nearby Macro Definitions\n")[1].split("\n## ")[0]
    assert '"macro":"FN_MAX"' in section(got["c1"]) and "fs/b.h" in section(got["c1"]) and "WINDOW_ONLY" not in section(got["c1"])
    assert "FN_MAX" in section(got["c2"]) and "WINDOW_ONLY" in section(got["c2"])


def test_prompt_file_is_required(tmp_path):
    from faultloom.sources import models

    with pytest.raises(FileNotFoundError):
        models.load_prompt(str(tmp_path / "none.md"))
    (tmp_path / "blank.md").write_text(" \n")
    with pytest.raises(ValueError, match="blank"):
        models.load_prompt(str(tmp_path / "blank.md"))
    (tmp_path / "p.md").write_text("\nrules\n")
    assert models.load_prompt(str(tmp_path / "p.md")) == "rules"


def test_vector_files_and_json_files(spark, tmp_path):
    import json

    import numpy as np

    np.savez_compressed(tmp_path / "v.npz", vectors=np.arange(6, dtype=np.float32).reshape(2, 3), record_ids=np.array(["a", "b"]), weights=np.array([1.0, 2.0], np.float32))
    rows = sorted(ar.npz_vectors(spark, str(tmp_path / "v.npz")).collect(), key=lambda r: r["position"])
    assert [(r["position"], r["record_id"], list(r["vector"]), r["true_label"], r["weight"]) for r in rows] == [(0, "a", [0.0, 1.0, 2.0], None, 1.0), (1, "b", [3.0, 4.0, 5.0], None, 2.0)]
    (tmp_path / "cards" / "bug").mkdir(parents=True)
    (tmp_path / "cards" / "bug" / "x.json").write_text(json.dumps({"cause_id": "c"}, indent=2))
    (tmp_path / "cards" / "bug" / "bad.json").write_text("{")
    (tmp_path / "cards" / "bug" / "note.txt").write_text("{}")
    got = {r["path"]: r["id"] for r in ar.json_documents(spark, str(tmp_path / "cards")).select("path", F.try_variant_get("doc", "$.cause_id", "string").alias("id")).collect()}
    assert got == {"bug/x.json": "c", "bug/bad.json": None}
