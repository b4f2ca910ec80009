"""Stack frames: parsing lines, telling generic frames, cutting traces out of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import canon_func, first_position, let, strip

FRAME = "struct<func:string,file:string,line:int,inline:boolean,raw:string>"

# Patterns and lists that decide results.
PATH = r"\b([A-Za-z0-9_./+-]+\.(?:c|h|S|rs))(?::(-?\d+))?"
REGISTERS = [
    "Code", "RAX", "RSP", "RIP", "FS", "CS", "CR2", "RBP", "RDX", "RCX", "RBX", "RSI", "RDI", "R08", "R09", "R10", "R11", "R12", "R13", "R14", "R15",
    "EFLAGS",
]
LEADS = [r"^(?:RIP|PC|LR):\s*(?:[0-9a-fA-F]+:)?", r"^BUG:\s+KASAN:.*?\s+in\s+", r"^BUG:\s+KMSAN:.*?\s+in\s+", r"^WARNING:.*?\s+in\s+", r"^BUG:\s+unable.*?\s+in\s+"]
GENERIC_FUNC_PREFIXES = [
    "show_stack", "dump_stack", "__dump_stack", "print_report", "print_address_description", "print_usage_bug", "kasan_report", "kmsan_report",
    "kmsan_internal", "__msan_warning", "__asan_report", "check_memory_region", "instrument_", "report_", "panic", "oops_", "die_", "exc_",
    "asm_exc_", "do_syscall", "__do_syscall", "entry_", "el0_", "el1_", "invoke_syscall", "ret_from_fork", "ret_from_fork_asm", "kthread",
    "worker_thread", "process_one_work", "process_scheduled_works", "__list_del_entry", "__list_add_valid", "__list_del_entry_valid_or_report",
    "__list_del_entry_valid", "lock_acquire", "lock_release", "lockdep", "mark_lock", "mark_usage", "valid_state", "print_irqtrace_events",
    "kasan_save_stack", "kasan_save_track", "kasan_save_free_info", "kasan_set_track", "__kasan_record_aux_stack", "poison_kmalloc_redzone",
    "poison_slab_object", "__kasan_kmalloc", "__kasan_slab_free", "kasan_kmalloc", "kasan_slab_free", "kmem_cache_free_bulk", "kvfree_rcu_bulk",
]
GENERIC_PATH_PREFIXES = [
    "arch/x86/entry/", "arch/x86/kernel/", "arch/arm64/kernel/entry", "arch/arm64/kernel/", "mm/kasan/", "mm/kmsan/", "lib/dump_stack.c",
    "lib/list_debug.c", "include/linux/list.h", "kernel/locking/lockdep.c", "kernel/softirq.c", "kernel/workqueue.c", "kernel/kthread.c",
    "kernel/rcu/tree.c", "mm/slub.c", "kernel/time/timer.c",
]
STOP_MARKERS = ["Allocated by task", "Freed by task", "The buggy address", "Memory state around", "Modules linked", "---[ end trace", "Code disassembly", "Kernel panic",
    "Uninit was", "Local variable", "CPU:", "RIP:", "RSP:", "FS:", "CS:", "CR2:", "RBP:", "Last potentially related", "Secondary ac", "other info that",
    "Possible unsafe", " *** DEADLOCK", "no locks held", "stack backtrace:", "irq event stamp:", "hardirqs last", "softirqs last"]
CAUSE_GENERIC_FUNCTIONS = [
    "__dump_stack", "dump_stack", "dump_stack_lvl", "print_report", "kasan_report", "kasan_save_stack", "kasan_save_track", "__kasan_slab_alloc",
    "__kasan_slab_free", "lock_acquire", "__lock_acquire", "__mutex_lock_common", "mutex_lock_nested", "validate_chain", "check_noncircular",
    "check_prevs_add", "check_prev_add", "wrap_directory_iterator", "iterate_dir", "generic_perform_write", "__generic_file_write_iter",
    "generic_file_write_iter", "new_sync_write", "vfs_write", "ksys_write", "__do_sys_write", "__se_sys_write",
]
CAUSE_GENERIC_LEADS = ["do_syscall", "entry_", "__se_sys_", "__do_sys_", "sys_", "ksys_"]
CAUSE_GENERIC_FILES = ["fs/readdir.c", "fs/read_write.c", "mm/filemap.c"]
CAUSE_GENERIC_PATHS = ["arch/", "kernel/", "lib/", "mm/", "scripts/", "tools/"]
LOW_VALUE_SINKS = [
    "__warn", "warn_slowpath_fmt", "warn_slowpath_null", "panic", "BUG", "BUG_ON", "__dump_stack", "dump_stack", "dump_stack_lvl", "strlen",
    "strnlen", "strcmp", "strncmp", "memcpy", "memmove", "memset", "copy_to_user", "copy_from_user",
]


def starts_with_any(x: Column, leads: list[str]) -> Column:
    """One anchored alternation instead of a test per prefix."""
    return x.rlike("^(?:" + "|".join(r"\Q" + p + r"\E" for p in leads) + ")")


def no_frames() -> Column:
    return F.array().cast(f"array<{FRAME}>")


def parsed(lines: Column) -> Column:
    """Per line its frame (null if it is none), whether it is blank, and whether it ends a trace.

    Steps are chained so that every pattern runs once per line.
    """
    rejected = lambda s: s.isin("", "<TASK>", "</TASK>") | starts_with_any(s, [f"{r}:" for r in REGISTERS])

    def bare(s: Column) -> Column:
        for lead in LEADS:
            s = F.regexp_replace(s, lead, "")
        return s

    one = F.transform(lines, lambda x: F.struct(strip(x).alias("raw")))
    two = F.transform(one, lambda a: F.struct(a["raw"].alias("raw"), F.when(~rejected(a["raw"]), bare(a["raw"])).alias("s")))
    three = F.transform(
        two,
        lambda a: F.struct(
            a["raw"].alias("raw"),
            F.nullif(F.regexp_extract(a["s"], PATH, 1), F.lit("")).alias("file"),
            F.regexp_extract(a["s"], PATH, 2).try_cast("int").alias("line"),
            F.when(a["s"].rlike(PATH), F.regexp_extract(a["s"], r"(?s)^(.*?)" + PATH, 1)).otherwise(a["s"]).alias("before"),
        ),
    )
    last = lambda s: F.element_at(F.split(strip(F.replace(s, F.lit("[inline]"), F.lit(""))), r"(?U)\s+"), -1)
    four = F.transform(three, lambda a: F.struct(a["raw"].alias("raw"), a["file"].alias("file"), a["line"].alias("line"), F.regexp_replace(canon_func(last(a["before"])), r"^[():]+|[():]+$", "").alias("func")))
    frame = lambda a: F.struct(a["func"].alias("func"), a["file"].alias("file"), a["line"].alias("line"), a["raw"].contains("[inline]").alias("inline"), a["raw"].alias("raw"))
    return F.transform(
        four,
        lambda a: F.struct(
            F.when(a["func"].rlike(r"^[A-Za-z_][A-Za-z0-9_.$]*$"), frame(a)).alias("frame"),
            (a["raw"] == "").alias("blank"),
            (a["raw"].startswith("</TASK>") | starts_with_any(a["raw"], STOP_MARKERS)).alias("stops"),
            a["raw"].alias("raw"),
        ),
    )


def frames_of(lines: Column, limit: int = 64) -> Column:
    """The first ``limit`` frames among lines."""
    found = F.filter(F.transform(parsed(lines), lambda p: p["frame"]), lambda f: f.isNotNull())
    return F.slice(F.coalesce(found, no_frames()), 1, limit)


def trace_from(lines: Column, stops=None) -> Column:
    """Frames from the first line on, to a line that ends the trace or a blank line after the first frame."""
    end = stops or (lambda x: x["stops"])

    def cut(p: Column, first: Column) -> Column:
        blank = F.array_position(F.transform(p, lambda x, i: x["blank"] & (first > 0) & (i + 1 > first)), True)
        stop = first_position(p, lambda x: ~x["blank"] & end(x))
        last = F.least(*[F.when(x > 0, x - 1).otherwise(F.size(p)) for x in (blank, stop)])
        return F.filter(F.transform(F.slice(p, F.lit(1), last.cast("int")), lambda x: x["frame"]), lambda f: f.isNotNull())

    return F.coalesce(let(parsed(lines), lambda p: let(first_position(p, lambda x: x["frame"].isNotNull()), lambda first: cut(p, first))), no_frames())


def after(lines: Column, place: Column) -> Column:
    """Lines behind a 1-based place."""
    return F.slice(lines, place.cast("int") + 1, F.greatest(F.size(lines) - place.cast("int"), F.lit(0)))


def call_trace(lines: Column) -> Column:
    """The main trace of a report.

    It starts behind "Call Trace:"; failing that at a sanitizer's BUG line, or at a "WARNING/BUG: ... in" line, in either
    case at what follows the last " in "; failing that behind "stack backtrace:".
    """
    marker = first_position(lines, lambda x: x.rlike(r"^\s*Call [Tt]race:"))
    bug = first_position(lines, lambda x: x.rlike(r"BUG:\s+(?:KASAN|KMSAN):"))
    warning = first_position(lines, lambda x: x.rlike(r"(?:WARNING|BUG):.*\s+in\s+"))
    back = first_position(lines, lambda x: F.lower(x).contains("stack backtrace:"))
    inside = lambda at: F.concat(F.array(F.substring_index(F.get(lines, (at - 1).cast("int")), " in ", -1)), after(lines, at))
    body = F.when(marker > 0, after(lines, marker)).when(bug > 0, inside(bug)).when(warning > 0, inside(warning)).when(back > 0, after(lines, back))
    return trace_from(F.coalesce(body, F.array().cast("array<string>")))


def section_trace(lines: Column, start: str, ends: list[str]) -> Column:
    """Frames behind the first line that matches ``start``, to a line that matches any of ``ends``."""
    at = first_position(lines, lambda x: x.rlike(start))
    return F.when(at > 0, trace_from(after(lines, at), lambda x: x["raw"].rlike("|".join(f"(?:{e})" for e in ends)))).otherwise(no_frames())


def registered_trace(lines: Column) -> Column:
    """Frames behind "state was registered at:"."""
    at = first_position(lines, lambda x: x.contains("state was registered at:"))
    ends = lambda x: starts_with_any(x["raw"], STOP_MARKERS) | x["raw"].contains("irq event stamp") | x["raw"].contains("stack backtrace")
    return F.when(at > 0, trace_from(after(lines, at), ends)).otherwise(no_frames())


def slice_between(lines: Column, start: str, ends: list[str]) -> Column:
    """Lines from the first that matches ``start`` to before the next that matches any of ``ends``, case aside."""
    at = first_position(lines, lambda x: x.rlike(f"(?i){start}"))
    rest = after(lines, at)
    end = first_position(rest, lambda x: x.rlike("(?i)" + "|".join(f"(?:{e})" for e in ends)))
    found = F.slice(lines, at.cast("int"), F.when(end > 0, end).otherwise(F.size(rest) + 1).cast("int"))
    return F.when(at > 0, found).otherwise(F.array().cast("array<string>"))


def is_generic(frame: Column) -> Column:
    """Report, instrumentation, entry and other helpers, as the signature sees them."""
    return starts_with_any(frame["func"], GENERIC_FUNC_PREFIXES) | F.coalesce(starts_with_any(frame["file"], GENERIC_PATH_PREFIXES), F.lit(False))


def is_generic_for_cause(frame: Column) -> Column:
    """Generic frames by the other, cause-level rules: exact functions, syscall leads, exact files and whole source areas."""
    func, file = F.coalesce(strip(frame["func"]), F.lit("")), F.coalesce(strip(frame["file"]), F.lit(""))
    return func.isin(CAUSE_GENERIC_FUNCTIONS) | starts_with_any(F.lower(func), CAUSE_GENERIC_LEADS) | file.isin(CAUSE_GENERIC_FILES) | starts_with_any(F.lower(file), CAUSE_GENERIC_PATHS)


def semantic(frames: Column) -> Column:
    return F.filter(frames, lambda f: ~is_generic(f))


def funcs(frames: Column, limit: int) -> Column:
    return F.transform(F.slice(frames, 1, limit), lambda f: f["func"])


def subsystems(frames: Column) -> Column:
    """First path component of each frame's file that has a folder, each once."""
    some = F.filter(F.transform(frames, lambda f: f["file"]), lambda x: x.contains("/"))
    return F.array_distinct(F.transform(some, lambda x: F.substring_index(x, "/", 1)))
