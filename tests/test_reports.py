"""Frames, sections, classification and trigger facts on hand-written reports."""

import pytest
from pyspark.sql import functions as F

from faultloom.functions import frames as fr
from faultloom.functions import reports as rp
from faultloom.functions import text as tx

KASAN = """==================================================================
BUG: KASAN: slab-use-after-free in sock_fetch+0x1a/0x40 net/demo/sock.c:120
Read of size 8 at addr ffff888012345678 by task syz.1.2/400

CPU: 1 PID: 400 Comm: syz.1.2
Call Trace:
 <TASK>
 dump_stack_lvl+0x10/0x20 lib/dump_stack.c:50
 sock_fetch+0x1a/0x40 net/demo/sock.c:120 [inline]
 sock_release.isra.3+0x5/0x9 net/demo/sock.c:240
 cold_path.cold+0x5/0x9 net/demo/sock.c:250

 late_frame+0x1/0x2 net/demo/late.c:1
Allocated by task 400:
 kasan_save_stack+0x1/0x2 mm/kasan/common.c:40
 sock_new+0x3/0x9 net/demo/sock.c:60

Freed by task 401:
 sock_put+0x3/0x9 net/demo/sock.c:80
The buggy address belongs to the object
"""
LOCKDEP = """WARNING: possible circular locking dependency detected
syz/1 is trying to acquire lock:
ffff (&a->lock){+.+.}-{3:3}, at: take_a+0x1/0x2 fs/demo/a.c:10

but task is already holding lock:
ffff (&b->lock){+.+.}-{3:3}, at: take_b+0x1/0x2 fs/demo/b.c:20
which lock already depends on the new lock.

the existing dependency chain (in reverse order) is:

-> #1 (&b->lock){+.+.}-{3:3}:
       take_b+0x1/0x2 fs/demo/b.c:20
       bpf_map_delete_elem+0x2/0x3 kernel/bpf/map.c:5

-> #0 (&a->lock){+.+.}-{3:3}:
       take_a+0x1/0x2 fs/demo/a.c:10

other info that might help us debug this:
 Possible unsafe locking scenario:
2 locks held by syz/1:
 #0: ffff (&b->lock){+.+.}-{3:3}, at: take_b+0x1/0x2 fs/demo/b.c:20
 #1: ffff (rcu){....}-{1:3}
stack backtrace:
 end_frame+0x1/0x2 fs/demo/z.c:9
"""


def one(spark, expr, **cols):
    """Value of an expression over one row of texts."""
    schema = ", ".join(f"{k} string" for k in cols)
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr.alias("x")).collect()[0]["x"]


def names(frames):
    return [f["func"] for f in frames]


def test_call_trace_ends_at_blank_after_first_frame(spark):
    # A ".cold" name reads as a path "....c" with nothing before it, so such a line is no frame.
    assert names(one(spark, fr.call_trace(tx.split_lines(F.col("r"))), r=KASAN)) == ["dump_stack_lvl", "sock_fetch", "sock_release"]


def test_frames_have_file_line_and_inline(spark):
    f = one(spark, fr.call_trace(tx.split_lines(F.col("r"))), r=KASAN)[1]
    assert (f["file"], f["line"], f["inline"], f["raw"]) == ("net/demo/sock.c", 120, True, "sock_fetch+0x1a/0x40 net/demo/sock.c:120 [inline]")


@pytest.mark.parametrize(
    ("report", "want"),
    [
        ("BUG: KASAN: use-after-free in top+0x1/0x2 a/b.c:1\n next+0x1/0x2 a/b.c:2\n", ["top", "next"]),
        ("WARNING: CPU: 1 at x in wtop+0x1/0x2 a/b.c:1\n wnext+0x1/0x2 a/b.c:2\nRIP: x\n lost a/b.c:3", ["wtop", "wnext"]),
        ("stack backtrace:\n only+0x1/0x2 a/b.c:1\n", ["only"]),
        ("nothing here", []),
        ("", []),
        (None, []),
    ],
)
def test_call_trace_tiers(spark, report, want):
    assert names(one(spark, fr.call_trace(tx.split_lines(F.col("r"))), r=report)) == want


def test_sections(spark):
    from faultloom.operators.cards import ALLOCATED, FREED

    lines = tx.split_lines(F.col("r"))
    assert names(one(spark, fr.section_trace(lines, *ALLOCATED), r=KASAN)) == ["kasan_save_stack", "sock_new"]
    assert names(one(spark, fr.section_trace(lines, *FREED), r=KASAN)) == ["sock_put"]


@pytest.mark.parametrize(
    ("line", "func"),
    [("<TASK>", None), ("RAX: 0000", None), ("", None), ("  do_it.isra.0+0x1/0x2", "do_it"), ("f.part.3.isra.0+0x1/0x2", "f"), ("f.cold+0x1/0x2", None), ("123abc x/y.c:3", None), ("PC: 00ff: where+0x1/0x2 a/b.c", "where"), ("(odd): a/b.c:1", "odd")],
)
def test_single_lines(spark, line, func):
    found = one(spark, fr.frames_of(F.array("r")), r=line)
    assert names(found) == ([func] if func else [])


@pytest.mark.parametrize(
    ("title", "sanitizer", "kind"),
    [
        ("divide error in f", "OOPS", "divide-error"),
        ("KASAN: general protection fault in f", "OOPS", "general-protection-fault"),
        ("BUG: unable to handle page fault in f", "OOPS", "page-fault"),
        ("kernel BUG in f", "BUG", "kernel-bug"),
        ("Oops in f", "OOPS", "oops"),
        ("KASAN: slab-use-after-free Read in f", "KASAN", "use-after-free"),
        ("kasan: quiet", "KASAN", ""),
        ("KMSAN: uninit-value in f", "KMSAN", "uninit-value"),
        ("KCSAN: data-race in f", "KCSAN", "data-race"),
        ("UBSAN: shift-out-of-bounds in f", "UBSAN", "shift-out-of-bounds"),
        ("inconsistent lock state in f", "LOCKDEP", "inconsistent-lock-state"),
        ("possible deadlock in f", "LOCKDEP", "possible-deadlock"),
        ("possible circular locking in f", "LOCKDEP", "possible-circular-lock"),
        ("WARNING in f", "WARN", "warning"),
        ("corrupted list in f", "BUG", "list-corruption"),
        ("INFO: rcu detected stall in f", "INFO", "rcu-stall"),
        ("INFO: task hung in f", "INFO", "task-hung"),
        ("BUG: bad thing", "BUG", "bug"),
        ("stack-out-of-bounds", "KASAN", "out-of-bounds"),
        ("something else", "", "unknown"),
        (None, "", "unknown"),
    ],
)
def test_classes(spark, title, sanitizer, kind):
    b = one(spark, rp.bug_class(F.col("t"), F.lit("")), t=title)
    assert (b["sanitizer"], b["bug_type"]) == (sanitizer, kind)


def test_class_reads_access_and_function(spark):
    b = one(spark, rp.bug_class(F.col("t"), F.col("r")), t="KASAN: use-after-free Write in f.isra.0", r="")
    assert (b["access"], b["title_func"]) == ("write", "f")
    assert one(spark, rp.bug_class(F.col("t"), F.col("r")), t="x", r="BUG: KASAN: oops-free in g+0x1")["title_func"] == "g"


def test_normal_report_masks_and_latches(spark):
    r = "RAX: 1\nat 0xff /12 syz.3.4\n  CPU: 1\n\nCode disassembly:\nkept? no\n"
    assert one(spark, rp.normal_report(F.col("r")), r=r) == "at <HEX> /N syz.N.N"


def test_config_last_wins(spark):
    assert one(spark, rp.config_features(F.col("c")), c="CONFIG_KASAN=y\nCONFIG_KASAN=n=1\nCONFIG_OTHER=y\n# CONFIG_USB is not set") == {"CONFIG_KASAN": "n=1"}


def test_trigger_facts(spark):
    syz = "# c\nr0 = bpf$MAP_CREATE(0x0, &(0x7f)=@base={0x12, 0x4})\nbpf$PROG_LOAD(0x5, &(0x7f)={0x11, 0x1})\nbpf$PROG_LOAD(0x5, &(0x7f)={017, 0x1})\nsocket$inet(0x2)\nx('sys_enter\\x00')\n"
    s = one(spark, rp.reproducer_semantics(F.col("s"), F.lit(None).cast("string")), s=syz)
    assert s["syscalls"] == ["bpf$MAP_CREATE", "bpf$PROG_LOAD", "socket$inet", "x"]
    assert s["bpf_map_types"] == ["SOCKHASH"]
    assert s["bpf_program_types"] == ["RAW_TRACEPOINT"]
    assert s["tracepoints"] == ["sys_enter"]
    assert s["semantic_tokens"] == ["repro:sockmap_or_sockhash", "repro:bpf_program", "repro:tracepoint_attach"]


def test_lock_context(spark):
    df = spark.createDataFrame([(LOCKDEP,)], "r string").withColumn("l", tx.split_lines(F.col("r"))).withColumn("s", rp.lock_sections(F.col("l")))
    c = df.select(rp.lockdep_context(F.col("r"), F.col("l"), F.col("s")).alias("c")).collect()[0]["c"]
    assert [b["lock"] for b in c["existing_dependency_chain"]] == ["-> #1 (&b->lock){+.+.}-{3:3}:", "-> #0 (&a->lock){+.+.}-{3:3}:"]
    assert names(c["existing_dependency_chain"][0]["frames"]) == ["take_b", "bpf_map_delete_elem"]
    assert [(h["index"], h["site"]) for h in c["held_locks"]] == [("0", "take_b+0x1/0x2 fs/demo/b.c:20"), ("1", "")]
    assert c["bpf_tracepoint_bridge"]["map_operations"] == ["bpf_map_delete_elem"]
    assert "&a->lock" in c["lock_classes"]
    assert one(spark, rp.lockdep_context(F.col("r"), F.array("r"), rp.lock_sections(F.array("r"))), r="plain") is None


def test_lines_and_tokens(spark):
    assert one(spark, tx.split_lines(F.col("t")), t="a\r\nb\x0bc\n") == ["a", "b", "c"]
    assert one(spark, tx.canonical_token(F.col("t"), True), t="  Object:: A=>b ﬁeld; ") == "object._a->b_field"
    assert one(spark, tx.canonical_token(F.col("t"), True), t=None) == ""
    assert one(spark, tx.token_to_words(F.col("t")), t="field:a->b_c[0]") == "field a.b c 0"
    assert one(spark, tx.clean_token(F.col("t")), t=" A  b!c__d ") == "a_b_c_d"
    assert one(spark, tx.unique_keep_order(F.split("t", ","), 2), t=" b, ,a,b,c") == ["b", "a"]


def test_foreign_letters_fold_inside_lists_and_cards(spark):
    from faultloom.operators import features as ft

    lists = spark.createDataFrame([(1, ["ＡＢＣ_x", "ﬁeld", "plain", "ｐｌａｉｎ", "日本", None, ""]), (2, ["ﬁeld:a"]), (3, ["plain"]), (4, None)], "id int, t array<string>")
    got = {r["id"]: (r["u"], r["f"]) for r in lists.select("id", tx.ordered_unique(F.col("t")).alias("u"), tx.format_field("must", F.col("t")).alias("f")).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4)] == [["abc_x", "field", "plain"], ["field:a"], ["plain"], []]
    assert got[2][1] == "[must]\ntoken: field:a ; words: field a" and got[4][1] == ""
    assert one(spark, tx.compact_sentence("l", F.col("t")), t="日本") == ""
    rows = [(1, (["ﬁeld: Ａ", "object:ｂ"],), [("high", "direct", "ｘ -é> y", "")]), (2, (["plain"],), None), (3, None, None)]
    kind = "id long, dedup_representation struct<must_match_tokens:array<string>>, invariant_signals array<struct<dedup_weight:string,evidence_level:string,expected:string,observed_or_suspected_violation:string>>"
    got = {r["id"]: r for r in ft.token_fields(spark.createDataFrame(rows, kind)).collect()}
    assert got[1]["fields"]["must"] == ["field:_a", "object:b"] and got[1]["fields"]["object"] == ["field:_a", "object:b"]
    assert got[1]["fields"]["invariant"] == ["expected:_x->y"] and got[1]["dedup_representation"]["must_match_tokens"][0] == "ﬁeld: Ａ"
    assert got[2]["fields"]["must"] == ["plain"] and got[3]["fields"]["must"] == []
