"""What a report, a reproducer and a kernel configuration say: classification, normal form, lock context, trigger semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import frames as fr
from .text import canon_func, first_position, let, split_lines, strip, unique_keep_order

# Names and patterns that decide results.
MAP_TYPES = {0x0: "UNSPEC", 0x1: "HASH", 0x2: "ARRAY", 0x3: "PROG_ARRAY", 0x4: "PERF_EVENT_ARRAY", 0x5: "PERCPU_HASH", 0x6: "PERCPU_ARRAY", 0x7: "STACK_TRACE", 0x8: "CGROUP_ARRAY",
    0x9: "LRU_HASH", 0xA: "LRU_PERCPU_HASH", 0xB: "LPM_TRIE", 0xC: "ARRAY_OF_MAPS", 0xD: "HASH_OF_MAPS", 0xE: "DEVMAP", 0xF: "SOCKMAP", 0x10: "CPUMAP", 0x11: "XSKMAP", 0x12: "SOCKHASH",
    0x13: "CGROUP_STORAGE", 0x14: "REUSEPORT_SOCKARRAY", 0x15: "PERCPU_CGROUP_STORAGE", 0x16: "QUEUE", 0x17: "STACK", 0x18: "SK_STORAGE", 0x19: "DEVMAP_HASH", 0x1A: "STRUCT_OPS", 0x1B: "RINGBUF"}
PROGRAM_TYPES = {0x2: "KPROBE", 0x3: "SCHED_CLS", 0x4: "SCHED_ACT", 0x5: "TRACEPOINT", 0x11: "RAW_TRACEPOINT", 0x1A: "TRACING"}
BPF_TRACE = r"\b(?:bpf_prog_[A-Za-z0-9_]+|__bpf_trace_run|bpf_trace_run\d*|__bpf_prog_run|bpf_prog_run|bpf_dispatcher_[A-Za-z0-9_]+|trace_[A-Za-z0-9_]+|__traceiter_[A-Za-z0-9_]+|__[A-Za-z0-9_]*trace_[A-Za-z0-9_]+)\b"
BPF_MAP_OP = r"\b(?:bpf_map_(?:delete|update|lookup)_elem|sock_hash_delete_elem|sock_map_delete_elem|__sock_map_delete|sock_map_unref|sock_hash_update_elem|sock_map_update_elem)\b"
TRACEPOINT = r"'([A-Za-z0-9_:.+-]+)\\x00'"
HELPER = r"(?i)@([A-Za-z0-9_]*?(?:map|ringbuf|probe|trace|sock)[A-Za-z0-9_]*)"
MAP_OPS = ["MAP_CREATE", "MAP_UPDATE_ELEM", "MAP_DELETE_ELEM", "MAP_LOOKUP_ELEM", "BPF_RAW_TRACEPOINT_OPEN", "PROG_LOAD"]
SOCKET_LEADS = ["socket", "setsockopt", "bind", "listen", "connect", "send", "recv", "accept"]
HINT_PARTS = ["syz_", "bpf$", "mmap$", "open$", "openat$", "socket$", "sendmsg$", "recvmsg$", "ioctl$", "setsockopt$", "fcntl$", "pipe", "splice", "sendto$", "bind$", "r0 = "]
NOISE_LEADS = ["Code:", "RAX:", "RBX:", "RSP:", "RIP:", "FS:", "CS:", "CR2:", "Modules linked", "---[ end trace"]
REGISTER_LINE = r"^(?:RAX|RBX|RCX|RDX|RSI|RDI|RBP|RSP|RIP|EFLAGS|CR[0-4]|FS|GS|CS|DS|ES|R08|R09|R10|R11|R12|R13|R14|R15):"
MASKS = [(r"0x[0-9a-fA-F]+|\b[0-9a-fA-F]{12,}\b", "<HEX>"), (r"\+0x[0-9a-fA-F]+/0x[0-9a-fA-F]+", "+<OFF>"), (r"\bsyz\.\d+\.\d+\b", "syz.N.N"), (r"/\d+\b", "/N"),
    (r"\b(?:PID|CPU|UID|TID):\s*[^ ]+|\btask\s+[^/\s]+/\d+|\bComm:\s*\S+", ""), (r"(?U)\s+", " ")]
CONFIG_KEYS = [
    "CONFIG_KASAN", "CONFIG_KASAN_GENERIC", "CONFIG_KASAN_SW_TAGS", "CONFIG_KMSAN", "CONFIG_KMSAN_CHECK_MEMINIT", "CONFIG_DEBUG_LIST",
    "CONFIG_DEBUG_NET", "CONFIG_REF_TRACKER", "CONFIG_LOCKDEP", "CONFIG_PROVE_LOCKING", "CONFIG_DEBUG_LOCK_ALLOC", "CONFIG_UBSAN",
    "CONFIG_UBSAN_BOUNDS", "CONFIG_UBSAN_SHIFT", "CONFIG_NET_SCHED", "CONFIG_INET", "CONFIG_IPV6", "CONFIG_XFRM", "CONFIG_COMEDI", "CONFIG_OCFS2_FS",
    "CONFIG_USB", "CONFIG_ATM", "CONFIG_NET_NSH", "CONFIG_OPENVSWITCH", "CONFIG_FAULT_INJECTION", "CONFIG_KASAN_HW_TAGS",
]
CUT_NOTE = "\n...[truncated]..."


def bug_class(title: Column, report: Column) -> Column:
    """``struct<sanitizer, bug_type, access, title_func>`` of a crash: the first rule that its title and head meet.

    Rules look at the lower-cased title and first six report lines; the type after a sanitizer's name is read from
    the original spelling, so a mention in lower case gives the sanitizer without a type. Hardware faults come first
    because their reports also mention sanitizers. Null title and report count as empty.
    """
    title, report = F.coalesce(title, F.lit("")), F.coalesce(report, F.lit(""))
    head = F.array_join(F.slice(split_lines(report), 1, 6), "\n")
    text = F.concat(title, F.lit(" "), head)
    low = F.lower(text)
    has = lambda *words: _any(low, words)
    token = lambda name: F.regexp_extract(text, name + r":\s*([A-Za-z0-9_-]+)", 1)
    kasan = F.when(token("KASAN").isin("slab-use-after-free", "use-after-free"), "use-after-free").otherwise(token("KASAN"))
    first_kasan = F.regexp_extract(text, r"KASAN:\s*([A-Za-z0-9_-]+(?:\s+(?:Read|Write))?)", 1)
    access = F.when(first_kasan.rlike(r"\s(Read|Write)$"), F.lower(F.regexp_extract(first_kasan, r"(Read|Write)$", 1))).otherwise("")
    lock = F.when(has("inconsistent lock"), "inconsistent-lock-state").when(has("possible deadlock"), "possible-deadlock").otherwise("possible-circular-lock")
    rules = [
        (has("divide error"), "OOPS", F.lit("divide-error")),
        (has("general protection fault"), "OOPS", F.lit("general-protection-fault")),
        (has("unable to handle kernel paging request", "unable to handle page fault"), "OOPS", F.lit("page-fault")),
        (has("kernel bug"), "BUG", F.lit("kernel-bug")),
        (has("kernel-oops") | low.rlike(r"\boops\b"), "OOPS", F.lit("oops")),
        (has("kasan:"), "KASAN", kasan),
        (has("kmsan:"), "KMSAN", token("KMSAN")),
        (has("kcserror:", "kcsan:"), "KCSAN", token("KCSAN")),
        (has("ubsan"), "UBSAN", token("UBSAN")),
        (has("inconsistent lock state", "possible deadlock", "possible circular locking"), "LOCKDEP", lock),
        (low.startswith("warning") | has("warning in", "warning:"), "WARN", F.lit("warning")),
        (has("corrupted list") | F.lower(report).contains("list_del corruption"), "BUG", F.lit("list-corruption")),
        (has("info: rcu detected stall"), "INFO", F.lit("rcu-stall")),
        (has("info: task hung"), "INFO", F.lit("task-hung")),
        (low.startswith("bug:"), "BUG", F.lit("bug")),
        (has("out-of-bounds", "oob"), "KASAN", F.lit("out-of-bounds")),
    ]
    sanitizer, kind = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for condition, name, value in rules[1:]:
        sanitizer, kind = sanitizer.when(condition, name), kind.when(condition, value)
    before_kasan = F.lit(False)
    for condition, _, _ in rules[:5]:
        before_kasan = before_kasan | condition
    in_title = F.nullif(F.regexp_extract(title, r"\bin\s+([A-Za-z_][A-Za-z0-9_.$]*)", 1), F.lit(""))
    in_head = F.nullif(F.regexp_extract(head, r"(?:BUG|WARNING|KASAN|KMSAN|UBSAN|general protection fault).*?\bin\s+([A-Za-z_][A-Za-z0-9_.$]*)", 1), F.lit(""))
    return F.struct(
        sanitizer.otherwise("").alias("sanitizer"),
        kind.otherwise("unknown").alias("bug_type"),
        F.when(rules[5][0] & ~before_kasan, access).otherwise("").alias("access"),
        F.coalesce(canon_func(F.coalesce(in_title, in_head)), F.lit("")).alias("title_func"),
    )


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def normal_report(report: Column) -> Column:
    """A report without registers, module lists and what follows a code disassembly, numbers masked and blanks collapsed."""
    lines = F.transform(split_lines(report), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    cut = first_position(lines, lambda x: x.contains("Code disassembly"))
    kept = F.when(cut > 0, F.slice(lines, F.lit(1), F.greatest(cut - 1, F.lit(0)).cast("int"))).otherwise(lines)
    noise = lambda x: fr.starts_with_any(x, NOISE_LEADS) | x.rlike(REGISTER_LINE) | x.rlike(r"^\s*(CPU|Hardware name|Workqueue):")

    def masked(x: Column) -> Column:
        for pattern, mask in MASKS:
            x = F.regexp_replace(x, pattern, mask)
        return strip(x)

    return F.array_join(F.filter(F.transform(F.filter(kept, lambda x: ~noise(x)), masked), lambda x: x != ""), "\n")


def config_features(config: Column) -> Column:
    """The values of the known switches set in a kernel configuration; of a switch set twice the last."""
    pairs = F.transform(F.filter(split_lines(config), lambda x: x.startswith("CONFIG_") & x.contains("=")), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, r"^[^=]*=", "").alias("v")))
    known = F.array(*[F.lit(k) for k in CONFIG_KEYS])
    last = lambda ps: F.transform(known, lambda k: F.struct(k.alias("key"), F.get(F.filter(ps, lambda p: p["k"] == k), F.lit(0))["v"].alias("value")))
    return F.map_from_entries(F.filter(let(F.reverse(F.filter(pairs, lambda p: p["k"].isin(CONFIG_KEYS))), last), lambda e: e["value"].isNotNull()))


def syscall_hints(crash_log: Column) -> Column:
    """Up to twelve lines of a log's first 200 that look like system calls, at most 120 characters each."""
    lines = F.slice(split_lines(crash_log), 1, 200)
    wanted = F.filter(lines, lambda x: ~x.rlike(r"executing program \d+:") & x.rlike("|".join(r"\Q" + p + r"\E" for p in HINT_PARTS)))
    return F.transform(F.slice(wanted, 1, 12), lambda x: F.left(strip(x), F.lit(120)))


def _type_names(codes: Column, names: dict[int, str]) -> Column:
    """Numeric type codes (hex or decimal without leading zeros) by name; others as ``UNKNOWN_<n>``."""
    table = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    number = lambda c: F.when(c.rlike("^0x"), F.conv(F.substring(c, 3, 40), 16, 10)).when(c.rlike("^(0+|[1-9][0-9]*)$"), c).try_cast("long")
    values = F.filter(F.transform(codes, number), lambda v: v.isNotNull())
    return F.transform(values, lambda v: F.coalesce(F.try_element_at(table, v.cast("int")), F.concat(F.lit("UNKNOWN_"), v.cast("string"))))


def reproducer_semantics(syz: Column, c_repro: Column) -> Column:
    """Stable trigger-side facts of a reproducer program and its C form; null texts count as empty."""
    syz, c_repro = F.coalesce(syz, F.lit("")), F.coalesce(c_repro, F.lit(""))
    both = F.array_join(F.filter(F.array(syz, c_repro), lambda x: x != ""), "\n")
    lines = split_lines(syz)
    call = r"^(?:[A-Za-z0-9_]+\s*=\s*)?([A-Za-z_][A-Za-z0-9_$]*)\("
    calls = F.filter(F.transform(F.filter(F.transform(lines, strip), lambda s: (s != "") & ~s.startswith("#")), lambda s: F.regexp_extract(s, call, 1)), lambda s: s != "")
    code = r"(0x[0-9a-fA-F]+|\d+)"
    maps = F.transform(F.filter(lines, lambda x: x.contains("bpf$MAP_CREATE")), lambda x: F.regexp_extract(x, r"@base=\{" + code, 1))
    loads = F.filter(lines, lambda x: x.contains("bpf$PROG_LOAD"))
    direct, nested = r"bpf\$PROG_LOAD\([^)]*\)=\{" + code, r"bpf\$PROG_LOAD\([^,]+,\s*&\([^)]*\)=\{" + code
    programs = F.transform(loads, lambda x: F.coalesce(F.nullif(F.regexp_extract(x, direct, 1), F.lit("")), F.regexp_extract(x, nested, 1)))
    map_types, program_types = _type_names(maps, MAP_TYPES), _type_names(programs, PROGRAM_TYPES)
    points = unique_keep_order(F.filter(F.regexp_extract_all(both, F.lit(TRACEPOINT), 1), lambda t: t != "GPL"))
    ops = let(both, lambda t: F.filter(F.array(*[F.lit(o) for o in MAP_OPS]), lambda o: t.contains(o)))
    derived = [
        (F.arrays_overlap(map_types, F.array(F.lit("SOCKMAP"), F.lit("SOCKHASH"))), "repro:sockmap_or_sockhash"),
        (F.size(program_types) > 0, "repro:bpf_program"),
        (F.size(points) > 0, "repro:tracepoint_attach"),
        (F.array_contains(ops, "MAP_DELETE_ELEM"), "repro:bpf_map_delete_elem"),
        (F.array_contains(ops, "BPF_RAW_TRACEPOINT_OPEN"), "repro:bpf_raw_tracepoint_open"),
    ]
    return F.struct(
        unique_keep_order(calls, 40).alias("syscalls"),
        unique_keep_order(program_types, 16).alias("bpf_program_types"),
        unique_keep_order(F.regexp_extract_all(both, F.lit(HELPER), 1)).alias("bpf_helpers"),
        unique_keep_order(map_types, 16).alias("bpf_map_types"),
        ops.alias("bpf_map_ops"),
        points.alias("tracepoints"),
        unique_keep_order(F.filter(calls, lambda c: fr.starts_with_any(c, SOCKET_LEADS))).alias("socket_ops"),
        F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in derived])).alias("semantic_tokens"),
        F.concat(F.left(syz, F.lit(6000)), F.when(F.length(syz) > 6000, CUT_NOTE).otherwise("")).alias("syz_repro_excerpt"),
    )


#: Where the sections of a lock report start and end.
LOCK_SECTIONS = {
    "acquire": (r"is trying to acquire lock:", [r"but task is already holding lock:", r"which lock already depends", r"the existing dependency chain"]),
    "holding": (r"but task is already holding lock:", [r"which lock already depends", r"the existing dependency chain"]),
    "dependency": (r"the existing dependency chain", [r"other info that might help us debug this:", r"stack backtrace:"]),
    "other": (r"other info that might help us debug this:", [r"stack backtrace:", r"Call Trace:"]),
    "held": (r"\d+\s+locks held by", [r"stack backtrace:", r"Call Trace:"]),
}


def lock_sections(lines: Column) -> Column:
    """All sections of a lock report in one struct, for :func:`lockdep_context`."""
    return F.struct(*[fr.slice_between(lines, s, e).alias(n) for n, (s, e) in LOCK_SECTIONS.items()])


def lockdep_context(report: Column, lines: Column, sections: Column) -> Column:
    """What a lock report says beyond its stack; null where the report has no lock marker."""
    joined = lambda x: strip(F.array_join(x, "\n"))
    dep, other = sections["dependency"], sections["other"]
    heads = F.filter(F.transform(dep, lambda x, i: F.when(x.rlike(r"^\s*->\s*#\d+\s+"), i + 1)), lambda i: i.isNotNull())

    def block(h: Column, k: Column) -> Column:
        body = F.slice(dep, h + 1, F.coalesce(F.get(heads, k + 1) - h - 1, F.size(dep) - h))
        return F.struct(strip(F.get(dep, h - 1)).alias("lock"), fr.frames_of(body, 24).alias("frames"), joined(F.slice(body, 1, 28)).alias("raw_excerpt"))

    held = r"^\s*#(\d+):\s+(.+?)(?:,\s+at:\s+(.+))?$"
    locks = F.transform(F.filter(sections["held"], lambda x: x.rlike(held)), lambda x: F.struct(F.regexp_extract(x, held, 1).alias("index"), strip(F.regexp_extract(x, held, 2)).alias("lock"), strip(F.regexp_extract(x, held, 3)).alias("site")))
    text = F.array_join(F.concat(dep, other, lines), "\n")
    found = lambda pattern, group, limit=32: unique_keep_order(F.regexp_extract_all(text, F.lit(pattern), group), limit)
    bpf, ops = found(BPF_TRACE, 0, 24), found(BPF_MAP_OP, 0, 16)
    points = unique_keep_order(F.filter(F.regexp_extract_all(text, F.lit(TRACEPOINT), 1), lambda t: t != "GPL"))
    classes = F.array_join(F.concat(sections["acquire"], sections["holding"], dep, sections["held"]), "\n")
    excerpt = F.array_join(F.filter(F.array(*[joined(sections[n]) for n in ("acquire", "holding", "dependency", "other")]), lambda x: x != ""), "\n\n")
    context = F.struct(
        F.struct(joined(sections["acquire"]).alias("raw_excerpt"), fr.frames_of(sections["acquire"], 16).alias("frames")).alias("current_acquisition"),
        F.struct(joined(sections["holding"]).alias("raw_excerpt"), fr.frames_of(sections["holding"], 16).alias("frames")).alias("already_holding"),
        F.transform(heads, block).alias("existing_dependency_chain"),
        locks.alias("held_locks"),
        joined(other).alias("unsafe_scenario"),
        unique_keep_order(F.regexp_extract_all(classes, F.lit(r"\(([^)\n]+)\)\{[^}\n]+\}-\{[^}\n]+\}"), 1)).alias("lock_classes"),
        F.struct(((F.size(bpf) + F.size(ops) + F.size(points)) > 0).alias("present"), bpf.alias("bpf_frames"), ops.alias("map_operations"), points.alias("tracepoints")).alias("bpf_tracepoint_bridge"),
        F.concat(F.left(excerpt, F.lit(14000)), F.when(F.length(excerpt) > 14000, CUT_NOTE).otherwise("")).alias("raw_lockdep_excerpt"),
    )
    return F.when(F.lower(report).rlike("possible circular locking dependency|possible deadlock|inconsistent lock state|lockdep"), context)
