"""Evidence of a crash card: its domain, the frames worth reading, input quality, and a packet of sections within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frames as fr
from ..functions.text import let, no_strings, strip

TEXT_BUDGET = 28_000
#: Traces in the order in which their frames count, and the reproducer's lists.
TRACES = ["free_trace", "alloc_trace", "origin_trace"]
TRIGGER_LISTS = ["syscalls", "bpf_program_types", "bpf_helpers", "bpf_map_types", "bpf_map_ops", "tracepoints", "socket_ops", "semantic_tokens"]
NOT_MACROS = ["NULL", "WARN", "BUG", "KERN"]
INSTRUCTIONS = {
    "minimal": "Crash evidence is minimal. Do not invent candidate root-cause tokens. Use at most one broad source retrieval if it can validate a surface location; otherwise emit low-confidence uncertainty with only weak context tokens.",
    "medium": "Crash evidence is limited or a sanitizer-specific trace is incomplete. Prefer direct source-backed representation, but do not promote lifecycle/origin hypotheses to high confidence without matching trace evidence.",
    "normal": "Crash evidence is sufficient for normal source-guided representation. Use the standard evidence-first workflow.",
}


def _text(x: Column) -> Column:
    return F.coalesce(strip(x), F.lit(""))


def _frames(df: DataFrame, path: str) -> Column:
    """A trace without null frames; an empty one where the table or the card has none."""
    kind = df.schema
    for part in path.split("."):
        if not hasattr(kind, "fieldNames") or part not in kind.fieldNames():
            return fr.no_frames()
        kind = kind[part].dataType
    return F.coalesce(F.filter(F.col(path), lambda f: f.isNotNull()), fr.no_frames())


def domain_scope(path: Column) -> Column:
    """Source area of a file: three levels under ``drivers``, else two, else one; empty for an empty path."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    depth = F.when((F.get(parts, F.lit(0)) == "drivers") & (F.size(parts) >= 3), 3).otherwise(F.least(F.size(parts), F.lit(2)))
    return F.when(F.size(parts) > 0, F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(depth, F.lit(1))), "/"), F.lit("/"))).otherwise("")


def domain_prefix(df: DataFrame) -> Column:
    """Scope of the first frame with a file that is not generic, in the semantic stack, then the raw one; else of the fault's file."""
    named = lambda p: F.get(F.filter(_frames(df, p), lambda f: ~fr.is_generic_for_cause(f) & (_text(f["file"]) != "")), F.lit(0))["file"]
    own = _text(F.col("fault.primary_file"))
    usable = (own != "") & ~own.isin(fr.CAUSE_GENERIC_FILES) & ~fr.starts_with_any(own, fr.CAUSE_GENERIC_PATHS)
    scope = lambda x: F.when(x.isNotNull(), domain_scope(strip(x)))
    return F.coalesce(scope(named("stack_semantic")), scope(named("stack_raw")), F.when(usable, domain_scope(own)), F.lit(""))


def primary_source_frame(df: DataFrame) -> Column:
    """The frame to read first: not generic, with file and line; else the fault's own raw frame; else function and file alone."""
    full = lambda p: F.get(F.filter(_frames(df, p), lambda f: ~fr.is_generic_for_cause(f) & (_text(f["file"]) != "") & (F.coalesce(f["line"], F.lit(0)) != 0)), F.lit(0))
    func, file = _text(F.col("fault.primary_function")), _text(F.col("fault.primary_file"))
    own = F.get(F.filter(_frames(df, "stack_raw"), lambda f: (_text(f["func"]) == func) & (_text(f["file"]) == file)), F.lit(0))
    stub = F.struct(func.alias("func"), file.alias("file"), F.lit(None).cast("int").alias("line"), F.lit(False).alias("inline"), F.lit("").alias("raw"))
    return F.coalesce(full("stack_semantic"), full("stack_raw"), own, stub)


def _in_domain(frames: Column, prefix: Column) -> Column:
    return F.filter(frames, lambda f: (_text(f["file"]) != "") & (_text(f["func"]) != "") & ~fr.is_generic_for_cause(f) & ((prefix == "") | F.startswith(strip(f["file"]), prefix)))


def _distinct_places(frames: Column, *more: str) -> Column:
    """Keeps the first frame of each file, function and line (and of each value of ``more``)."""
    place = lambda f: F.struct(*[f[m] for m in more], strip(f["file"]), strip(f["func"]), f["line"])
    firsts = lambda fs: let(F.transform(fs, place), lambda ps: F.filter(fs, lambda f, i: F.array_position(ps, F.get(ps, i)) == i + 1))
    return let(frames, firsts)


def domain_frames(df: DataFrame, prefix: Column, most: int) -> Column:
    """The first ``most`` distinct frames of both stacks that lie in the domain."""
    both = F.concat(_frames(df, "stack_semantic"), _frames(df, "stack_raw"))
    return F.slice(_distinct_places(_in_domain(both, prefix)), 1, most)


def sanitizer_frames(df: DataFrame, prefix: Column, most: int) -> Column:
    """The first ``most`` distinct sanitizer frames in the domain, tagged with their trace."""
    kinds = [_tag(_frames(df, f"sanitizer_context.{k}"), k) for k in TRACES]
    return F.slice(_distinct_places(_in_domain(F.concat(*kinds), prefix), "trace_kind"), 1, most)


def _tag(frames: Column, kind: str) -> Column:
    return F.transform(frames, lambda f: F.struct(F.lit(kind).alias("trace_kind"), f["func"].alias("func"), f["file"].alias("file"), f["line"].alias("line"), f["inline"].alias("inline"), f["raw"].alias("raw")))


def _some(x: Column) -> Column:
    return F.coalesce(F.size(x) > 0, F.lit(False))


def has_reproducer(df: DataFrame) -> Column:
    """Whether a card has any reproducer, system call hint or trigger fact."""
    found = [_some(F.col("repro.syscall_hints")), F.coalesce(F.col("repro.has_syz_repro"), F.lit(False)), F.coalesce(F.col("repro.has_c_repro"), F.lit(False))]
    found += [_some(F.col(f"reproducer_semantics.{k}")) for k in TRIGGER_LISTS] + [F.coalesce(F.col("reproducer_semantics.syz_repro_excerpt") != "", F.lit(False))]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def input_quality(df: DataFrame) -> DataFrame:
    """Adds ``input_quality``: tier, confidence cap, advised rounds, sorted reasons, metrics and instruction of each card.

    Null structs, arrays and frames count as missing. Works row by row.
    """
    df = df.withColumn("_prefix", domain_prefix(df))
    df = df.withColumn("_domain", F.size(domain_frames(df, F.col("_prefix"), 4)))
    sem, raw = _frames(df, "stack_semantic"), _frames(df, "stack_raw")
    df = df.withColumn("_stack", F.when(F.size(sem) > 0, sem).otherwise(raw)).withColumn("_repro", has_reproducer(df))
    func, file = _text(F.col("fault.primary_function")), _text(F.col("fault.primary_file"))
    stack, domain, repro = F.size("_stack"), F.col("_domain"), F.col("_repro")
    anchor = F.greatest(F.coalesce(F.size("anchor_trace"), F.lit(0)), F.lit(0))
    located = (func != "") & (file != "")
    stub = F.struct(func.alias("func"), file.alias("file"), F.lit(None).cast("int").alias("line"), F.lit(False).alias("inline"), F.lit("").alias("raw"))
    top = F.coalesce(F.get(F.col("_stack"), F.lit(0)), stub)
    sink = _text(top["func"]).isin(fr.LOW_VALUE_SINKS) | fr.starts_with_any(F.lower(_text(top["func"])), ["__warn", "warn_", "dump_stack"]) | fr.is_generic_for_cause(top)
    only_sink = sink & (domain == 0)
    alloc, free, origin = (_some(_frames(df, f"sanitizer_context.{k}")) for k in ("alloc_trace", "free_trace", "origin_trace"))
    sanitizer, kind = F.upper(F.coalesce("bug.sanitizer", F.lit(""))), F.lower(F.coalesce("bug.bug_type", F.lit("")))
    uaf = kind.contains("use-after-free") & sanitizer.isin("KASAN", "KMSAN") & ~(alloc & free)
    uninit = (sanitizer == "KMSAN") & kind.contains("uninit") & ~origin
    minimal = ((stack == 0) & ~located) | ((stack <= 1) & ~repro & ~alloc & ~free & ~origin) | (~located & (domain == 0) & ~repro)
    weak = ~located | (stack <= 2) | (anchor == 0)
    tier = F.when(minimal, "minimal").when(only_sink | weak, "limited").otherwise("sufficient")
    cap = F.when(minimal, "low").when(only_sink, F.when((stack >= 3) | repro, "medium").otherwise("low")).when(weak, "medium").when(uaf | uninit, "medium").otherwise("none")
    reasons = [
        (stack == 0, "no_stack"),
        (anchor == 0, "no_anchor_trace"),
        (func == "", "missing_primary_function"),
        (file == "", "missing_primary_file"),
        (only_sink, "generic_or_low_value_sink_only"),
        (uaf, "uaf_missing_alloc_or_free_trace"),
        (uninit, "kmsan_missing_origin_trace"),
    ]
    quality = F.struct(
        tier.alias("tier"),
        cap.alias("confidence_cap"),
        F.when(minimal, "minimal").when(only_sink | weak, "short").otherwise("normal").alias("recommended_tool_rounds"),
        F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in reasons]))).alias("missing_or_weak_evidence"),
        F.struct(
            stack.alias("stack_len"), anchor.alias("anchor_len"), domain.alias("domain_frame_count"), located.alias("primary_location_present"), repro.alias("has_reproducer_semantics"),
            alloc.alias("has_alloc_trace"), free.alias("has_free_trace"), origin.alias("has_origin_trace"),
        ).alias("metrics"),
        F.when(minimal, INSTRUCTIONS["minimal"]).when(cap == "medium", INSTRUCTIONS["medium"]).otherwise(INSTRUCTIONS["normal"]).alias("model_instruction"),
    )
    return df.withColumn("input_quality", quality).drop("_prefix", "_domain", "_stack", "_repro")


def macro_candidates(text: Column, most: int = 8) -> Column:
    """Upper-case names of a text, known ones aside, each once in order."""
    names = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b[A-Z][A-Z0-9_]{2,}\b"), 0)
    return F.slice(F.array_distinct(F.filter(names, lambda n: ~n.isin(NOT_MACROS))), 1, most)


def ranked_macros(lines: DataFrame, target: int, most: int = 8) -> DataFrame:
    """``macro, distance``: upper-case names by the distance of their first line from ``target``, then by name."""
    names = F.array_distinct(F.filter(F.regexp_extract_all("line", F.lit(r"\b[A-Z][A-Z0-9_]{2,}\b"), 0), lambda n: ~n.isin(NOT_MACROS)))
    first = lines.select("lineno", F.explode(names).alias("macro")).groupBy("macro").agg(F.min("lineno").alias("at"))
    return first.select("macro", F.abs(F.col("at") - target).alias("distance")).orderBy("distance", "macro").limit(most)


def nearest_macros(source: Column, target: Column, most: int = 8) -> Column:
    """Upper-case names of a numbered source text (lines such as ``  12: code``), by the distance of their first line from ``target``, then by name.

    Without a target, or for a text without numbered lines, the names as they come or none.
    """
    numbered = r"^[ >=]*\s*(\d+):\s*(.*)$"
    lines = F.filter(F.split(F.coalesce(source, F.lit("")), "\n"), lambda x: x.rlike(numbered))
    at = lambda x: F.regexp_extract(x, numbered, 1).cast("int")
    names = lambda x: F.filter(F.regexp_extract_all(F.regexp_extract(x, numbered, 2), F.lit(r"\b[A-Z][A-Z0-9_]{2,}\b"), 0), lambda n: ~n.isin(NOT_MACROS))
    each = F.flatten(F.transform(lines, lambda x: F.transform(names(x), lambda n: F.struct(n.alias("n"), at(x).alias("at")))))
    firsts = let(each, lambda es: let(F.transform(es, lambda e: e["n"]), lambda ns: F.filter(es, lambda e, i: F.array_position(ns, e["n"]) == i + 1)))
    placed = F.array_sort(F.transform(firsts, lambda e: F.struct(F.abs(e["at"] - target).alias("d"), e["n"].alias("n"))))
    return F.slice(F.when(target.isNull(), macro_candidates(source, most)).otherwise(F.transform(placed, lambda e: e["n"])), 1, most)


def first_within(df: DataFrame, keys: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """Rows of each key, in order, until ``size`` adds up to more than a budget; the row that exceeds it is the last.

    A row takes at least one of the budget, so no more rows of a key than that are ever ordered together: the first ones are
    taken in every task before the shuffle.
    """
    few = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= budget).drop("_n")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return few.withColumn("_b", F.coalesce(F.sum(F.greatest(size, F.lit(1))).over(w), F.lit(0))).filter(F.col("_b") <= budget).drop("_b")


def packed(items: Column, budget: int = TEXT_BUDGET) -> Column:
    """Those texts of an ordered array that fit a budget of characters one after the other.

    Blank ones are skipped; one that would exceed the budget is left out (later, shorter ones may still fit); the first always stays.
    """
    start = F.struct(no_strings().alias("kept"), F.lit(0).alias("used"))

    def add(acc: Column, x: Column) -> Column:
        fits = (strip(x) != "") & ((acc["used"] + F.length(x) <= budget) | (F.size(acc["kept"]) == 0))
        return F.when(fits, F.struct(F.array_append(acc["kept"], x).alias("kept"), (acc["used"] + F.length(x)).alias("used"))).otherwise(acc)

    return F.aggregate(F.filter(items, lambda x: x.isNotNull()), start, add, lambda acc: acc["kept"])


#: Ranges into which the order of a budget or of a bucket's members is cut.
RANGES = 4096


def running_budget(df: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows of each group, by the number ``order``, up to the one that exceeds a budget of ``size``; a null size counts 0.

    The order is cut into ``RANGES`` equal ranges whose sums decide for most rows at once; only a group's range in which the
    budget ends is put in order row by row, so a group that holds a third of all rows is never sorted in one task.
    """
    low, high = df.agg(F.min(order), F.max(order)).collect()[0]
    if low is None:
        return df.limit(0)
    width = max(1, -(-(int(high) - int(low) + 1) // RANGES))
    sized = df.withColumn("_w", F.coalesce(F.col(size), F.lit(0))).withColumn("_range", F.floor((F.col(order) - F.lit(int(low))) / width).cast("int")).withColumn("_group", F.struct(F.col(group)))
    sums = sized.groupBy("_group", "_range").agg(F.sum("_w").alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("_before") <= budget)
    placed = sized.join(before, ["_group", "_range"])
    whole = placed.filter(F.col("_before") + F.col("_sum") <= budget)
    w = Window.partitionBy("_group", "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.filter(F.col("_before") + F.col("_sum") > budget).withColumn("_b", F.col("_before") + F.coalesce(F.sum("_w").over(w), F.lit(0))).filter(F.col("_b") <= budget).drop("_b")
    return whole.unionByName(edge).select(*df.columns)
