"""Source packets for cards: what a model should see first, looked up for all cards at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from . import quality as ql
from . import source_search as ss

DOMAIN_FRAMES, SANITIZER_FRAMES = 3, 2
WIDE, LINE = (40, 80), (80, 120)
NOTES = "Deterministic source packet prepared by the script. Treat it as initial evidence, not ground truth.\nDomain scope hint: "


def line_windows(lines: DataFrame, spots: DataFrame, before: int, after: int) -> DataFrame:
    """Adds ``source``, the numbered lines around each ``path, around``."""
    near = lines.join(spots.select("path", "around").distinct(), "path").filter(F.col("lineno").between(F.col("around") - before, F.col("around") + after))
    mark = F.when(F.col("lineno") == F.col("around"), "=>").otherwise("  ")
    row = F.struct("lineno", F.format_string("%s %5d: %s", mark, F.col("lineno"), F.col("line")).alias("t"))
    return near.groupBy("path", "around").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["t"]), "\n").alias("source"))


def function_texts(lines: DataFrame, frames: DataFrame) -> DataFrame:
    """``path, symbol, around, body`` of frames: the function with eight lines around it, else the lines around the frame's line."""
    wanted = frames.select("path", "symbol", "around").distinct()
    bounds = ss.function_bounds(lines, wanted)
    whole = ss._numbered(lines, bounds, 8, 8)
    place = F.concat(F.col("path"), F.lit(":"), F.col("start_line"), F.lit(".."), F.col("end_line"), F.lit("\n"), F.col("source"))
    found = whole.select("path", "symbol", F.coalesce("around", F.lit(-1)).alias("_a"), place.alias("whole"))
    wide = line_windows(lines, wanted.filter("around IS NOT NULL"), *WIDE).select("path", F.col("around").alias("_a"), F.concat(F.col("path"), F.lit(":"), F.col("around"), F.lit("\n"), F.col("source")).alias("wide"))
    keyed = wanted.withColumn("_a", F.coalesce("around", F.lit(-1)))
    joined = keyed.join(found, ["path", "symbol", "_a"], "left").join(wide, ["path", "_a"], "left")
    return joined.select("path", "symbol", "around", F.coalesce("whole", "wide").alias("body")).filter("body IS NOT NULL")


def _section(rank: int | Column, title: Column, body: Column) -> Column:
    text = F.when(strip(body) != "", F.concat(F.lit("## "), title, F.lit("\n"), strip(body), F.lit("\n")))
    return F.struct((F.lit(rank) if isinstance(rank, int) else rank).alias("rank"), text.alias("text"))


#: Macros looked up per card, and characters of definitions shown per macro.
MACROS, MACRO_CHARS = 8, 4000


def _macro_sections(lines: DataFrame, key: str, functions: DataFrame, around: DataFrame) -> DataFrame:
    """``key, rank, text``: the definitions of macros near each card's crash line, as JSON.

    Macros of the primary function come by the distance of their first line from the crash line; only a card whose function names none
    takes those of the lines around the crash, as they come. Of each macro's definitions the first by place are shown, up
    to ``MACRO_CHARS`` characters; definitions are found once for all cards.
    """
    ranked = around.join(functions, key, "left").select(key, ql.nearest_macros(F.col("function"), F.col("around"), MACROS).alias("near"), ql.macro_candidates(F.col("source"), MACROS).alias("plain"))
    names = ranked.select(key, F.posexplode(F.when(F.size("near") > 0, F.col("near")).otherwise(F.col("plain"))).alias("place", "macro"))
    define = r"#define\s+([A-Za-z_][A-Za-z0-9_]*)[\s(]"
    defined = ss.in_paths(lines, ss.SOURCES).filter(F.col("line").rlike(define)).select(F.regexp_extract("line", define, 1).alias("macro"), "path", "lineno", strip(F.col("line")).alias("text"))
    defined = defined.join(names.select("macro").distinct(), "macro", "left_semi")
    shown = F.length(F.concat_ws(":", "path", "lineno", "text")) + 1
    defined = ql.first_within(defined, ["macro"], ["path", "lineno"], shown, MACRO_CHARS)
    matches = defined.groupBy("macro").agg(F.array_sort(F.collect_list(F.struct(F.col("path").alias("file"), F.col("lineno").alias("line"), "text"))).alias("matches"))
    found = names.join(matches, "macro").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "macro", "matches"))).alias("found"))
    body = F.to_json(F.transform("found", lambda m: F.struct(m["macro"].alias("macro"), m["matches"].alias("matches"))))
    return found.select(key, _section(5, F.lit("Nearby Macro Definitions"), body).alias("s")).select(key, "s.*")


def source_packets(cards: DataFrame, lines: DataFrame, key: str = "case_id", budget: int = ql.TEXT_BUDGET) -> DataFrame:
    """``key, packet`` of every card: notes, lock and trigger facts, outline, lines around the crash, macros near it, and the functions of
    the primary, domain and sanitizer frames, packed in that order within the budget.

    Frames of all cards are looked up together, each place once however many cards share it. Sections of one card
    are few and short (at most nine), so they meet in one row.
    """
    cards = cards.withColumn("_prefix", ql.domain_prefix(cards))
    cards = cards.withColumns({"_primary": ql.primary_source_frame(cards), "_domain": ql.domain_frames(cards, F.col("_prefix"), DOMAIN_FRAMES), "_san": ql.sanitizer_frames(cards, F.col("_prefix"), SANITIZER_FRAMES)})
    base = cards.select(key, "_prefix", "_primary", "_domain", "_san", *[c for c in ("lockdep_context", "reproducer_semantics") if c in cards.columns])
    json = lambda c: F.coalesce(F.to_json(c), F.lit("")) if c in base.columns else F.lit("")
    fixed = base.select(key, F.inline(F.array(
        _section(0, F.lit("Prefetch Notes"), F.concat(F.lit(NOTES), F.when(F.col("_prefix") != "", F.col("_prefix")).otherwise("<unknown>"))),
        _section(1, F.lit("Crash Card LOCKDEP Context"), json("lockdep_context")),
        _section(2, F.lit("Crash Card Reproducer Semantics"), json("reproducer_semantics")),
    )))
    frame = lambda f, rank, title: F.struct(rank.alias("rank"), title.alias("title"), strip(f["file"]).alias("path"), strip(f["func"]).alias("symbol"), f["line"].alias("around"))
    primary = F.array(frame(F.col("_primary"), F.lit(6), F.concat(F.lit("Primary Function: "), F.col("_primary.func"))))
    domain = F.transform("_domain", lambda f, i: frame(f, F.lit(7) + i, F.concat(F.lit("Related Domain Function: "), f["func"])))
    san = F.transform("_san", lambda f, i: frame(f, F.lit(20) + i, F.concat(f["trace_kind"], F.lit(": "), f["func"])))
    frames = base.select(key, F.inline(F.concat(primary, domain, san))).filter("symbol <> '' AND path <> ''")
    first = frames.groupBy(key, "path", "symbol").agg(F.min_by(F.struct("rank", "title", "around"), "rank").alias("f")).select(key, "path", "symbol", "f.*")
    texts = function_texts(lines, first)
    joined = first.join(texts, (first["path"] == texts["path"]) & (first["symbol"] == texts["symbol"]) & first["around"].eqNullSafe(texts["around"]))
    bodies = joined.select(key, _section(F.col("rank"), F.col("title"), F.col("body")).alias("s")).select(key, "s.*")
    spots = base.select(key, strip(F.col("_primary.file")).alias("path"), F.col("_primary.line").alias("around")).filter("path <> '' AND around IS NOT NULL")
    window = line_windows(lines, spots, *LINE)
    around = spots.join(window, ["path", "around"])
    context = around.select(key, _section(4, F.lit("Crash Line Context"), F.col("source")).alias("s")).select(key, "s.*")
    outline = ss.file_outlines(lines, spots.select(F.col("path").alias("file"), "around")).groupBy(F.col("file").alias("path"), "around").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("place", "kind", "name", "start_line", "end_line", "text"))), lambda r: r.dropFields("place"))).alias("o"))
    outlines = spots.join(outline, ["path", "around"]).select(key, _section(3, F.lit("Crash File Outline"), F.col("o")).alias("s")).select(key, "s.*")
    macros = _macro_sections(lines, key, joined.filter("rank = 6").select(key, F.col("body").alias("function")), around)
    sections = reduce(DataFrame.unionByName, [fixed, outlines, context, macros, bodies]).filter("text IS NOT NULL")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"])
    return sections.groupBy(key).agg(strip(F.array_join(ql.packed(ordered, budget), "\n")).alias("packet"))
