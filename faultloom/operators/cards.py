"""Crash cards: one nested record per crash directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frames as fr
from ..functions import reports as rp
from ..functions.text import no_strings, non_blank, sha16, split_lines

META = "title string, crash_uid string, time string, kernel string, commit string, manager string, syz_repro string, c_repro string, kernel_commit_shas array<string>, syzkaller_commit_shas array<string>"
#: Where sanitizer sections start and end.
ALLOCATED = (r"Allocated by task", [r"Freed by task", r"The buggy address", r"Memory state", r"Call [Tt]race:", r"Last potentially related"])
FREED = (r"Freed by task", [r"Allocated by task", r"The buggy address", r"Memory state", r"Call [Tt]race:", r"Last potentially related"])
ORIGIN = (r"Uninit.*(?:created|stored|was)|Local variable", [r"Bytes", r"CPU:", r"Call [Tt]race:", r"Memory access"])


def _quoted(x: Column) -> Column:
    text = F.to_json(F.array(F.coalesce(x, F.lit(""))))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _listed(xs: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(xs, _quoted), ", "), F.lit("]"))


def signature_hash(scalars: list[Column], lists: list[Column]) -> Column:
    """Hash of a signature's scalars and lists, over their JSON text with a blank after each comma."""
    return sha16(F.concat(F.lit("["), F.concat_ws(", ", *[_quoted(x) for x in scalars], *[_listed(x) for x in lists]), F.lit("]")))


def make_cards(raw: DataFrame) -> DataFrame:
    """Crash cards from ``bug_id, case_id, meta, report, config, machine, crash_log, syz, c_repro`` (texts; missing files null).

    Every row is parsed on its own; nothing is shuffled. Intermediate results are columns of their own, so each is
    computed once. A malformed ``meta`` fails the job; a missing one counts as ``{}``.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    df = raw.select(
        F.col("bug_id").alias("big_bucket"),
        "case_id",
        F.from_json(F.when(text("meta") == "", "{}").otherwise(text("meta")), META, {"mode": "FAILFAST"}).alias("m"),
        *[text(c).alias(c) for c in ("report", "config", "machine", "crash_log", "syz", "c_repro")],
    )
    df = df.withColumn("lines", split_lines(F.col("report"))).withColumn("title", non_blank(F.col("m.title"), F.col("case_id")))
    df = df.withColumn("bug", rp.bug_class(F.col("title"), F.col("report"))).withColumn("frames", fr.call_trace(F.col("lines")))
    for name, (start, ends) in {"alloc": ALLOCATED, "free": FREED, "origin": ORIGIN}.items():
        df = df.withColumn(name, fr.section_trace(F.col("lines"), start, ends))
    df = df.withColumn("registered", fr.registered_trace(F.col("lines"))).withColumn("semantic", fr.semantic(F.col("frames")))
    df = df.withColumn("sections", rp.lock_sections(F.col("lines"))).withColumn("lockdep_context", rp.lockdep_context(F.col("report"), F.col("lines"), F.col("sections")))
    df = df.withColumn("reproducer_semantics", rp.reproducer_semantics(F.col("syz"), F.col("c_repro")))
    sem, raw_first = F.get(F.col("semantic"), F.lit(0)), F.get(F.col("frames"), F.lit(0))
    df = df.withColumn("primary", F.coalesce(sem["func"], F.nullif(F.col("bug.title_func"), F.lit("")), raw_first["func"], F.lit("")))
    df = df.withColumn("primary_file", F.when(sem.isNotNull(), sem["file"]).otherwise(raw_first["file"]))
    tops = {n: fr.funcs(fr.semantic(F.col(n)), 3) for n in ("alloc", "free", "origin", "registered")}
    stack, anchor = fr.funcs(F.col("semantic"), 10), fr.funcs(F.col("semantic"), 8)
    paths = F.slice(F.array_compact(F.transform(F.slice("semantic", 1, 18), lambda f: f["file"])), 1, 10)
    bridge = lambda part: F.slice(F.coalesce(F.col(f"lockdep_context.bpf_tracepoint_bridge.{part}"), no_strings()), 1, 8)
    scalars = [F.col("bug.sanitizer"), F.col("bug.bug_type"), F.col("bug.access"), F.col("primary")]
    names = ["sanitizer", "bug_type", "access", "primary"]
    either = lambda flag, body: F.coalesce(F.col(f"m.{flag}") != "", F.lit(False)) | (F.col(body) != "")
    return df.select(
        F.lit("crash-card-v1.2").alias("schema_version"),
        "case_id",
        "big_bucket",
        F.coalesce("m.crash_uid", F.lit("")).alias("crash_uid"),
        "title",
        *[F.coalesce(f"m.{a}", F.lit("")).alias(b) for a, b in (("time", "time"), ("kernel", "kernel_tree"), ("commit", "kernel_commit"), ("manager", "manager"))],
        "bug",
        F.struct(F.col("primary").alias("primary_function"), "primary_file").alias("fault"),
        F.struct(either("syz_repro", "syz").alias("has_syz_repro"), either("c_repro", "c_repro").alias("has_c_repro"), rp.syscall_hints(F.col("crash_log")).alias("syscall_hints")).alias("repro"),
        "reproducer_semantics",
        F.slice("frames", 1, 30).alias("stack_raw"),
        F.slice("semantic", 1, 24).alias("stack_semantic"),
        anchor.alias("anchor_trace"),
        F.struct(
            F.slice("alloc", 1, 16).alias("alloc_trace"), F.slice("free", 1, 16).alias("free_trace"), F.slice("origin", 1, 10).alias("origin_trace"), F.slice("registered", 1, 16).alias("lockdep_registered_trace")
        ).alias("sanitizer_context"),
        "lockdep_context",
        F.struct(F.array_distinct(F.array_compact(F.transform(F.slice("semantic", 1, 16), lambda f: f["file"]))).alias("files"), fr.subsystems(F.slice("semantic", 1, 16)).alias("subsystems")).alias("source_context"),
        rp.config_features(F.col("config")).alias("config_features"),
        sha16(F.col("machine")).alias("machine_info_digest"),
        sha16(F.col("report")).alias("raw_report_digest"),
        sha16(rp.normal_report(F.col("report"))).alias("normalized_report_digest"),
        F.struct(
            stack.alias("stack_funcs_top10"),
            paths.alias("stack_paths_top10"),
            anchor.alias("anchor_trace"),
            *[tops[n].alias(f"{n}_funcs_top3") for n in tops],
            bridge("bpf_frames").alias("lockdep_bpf_frames"),
            bridge("map_operations").alias("lockdep_map_ops"),
            F.slice("reproducer_semantics.semantic_tokens", 1, 8).alias("repro_semantic_tokens"),
        ).alias("signature_fields"),
        signature_hash(scalars, [stack, *tops.values()]).alias("layer2_signature_hash"),
        F.struct(*[c.alias(n) for c, n in zip(scalars, names, strict=True)], stack.alias("stack"), *[tops[n].alias(n) for n in tops]).alias("layer2_signature_debug"),
        F.coalesce("m.kernel_commit_shas", no_strings()).alias("kernel_commit_shas"),
        F.coalesce("m.syzkaller_commit_shas", no_strings()).alias("syzkaller_commit_shas"),
    )
