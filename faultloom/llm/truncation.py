"""Texts that were cut off: censored length fits per source combined with evidence from the ending."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Share of distinct texts (at least MIN_LAST of them) that must end in a line for it to be a usual last line.
USUAL_SHARE, MIN_LAST, MIN_INNER = 0.002, 3, 5
#: A shape that ends texts less often than once in so many of its lines is no ending.
INNER_PER_LAST = 60
#: Log odds that a mark of a cut and an unclosed code fence add; other endings get theirs from the texts, within BOUNDS.
EVIDENCE, BOUNDS = {"mark": 9.5, "open_markup": 9.5}, (-6.0, 8.0)
#: Places at which every text is cut to learn how cut texts end, and what is added to the counts of an ending.
CUTS, SMOOTH = 4, 0.5
#: Texts with the share of cut ones of all sources that a source's own share starts from, and its least value.
PRIOR_TEXTS, LEAST_SHARE = 20.0, 1e-4

_MARK = r"(…|\.\.\.|\[\.\.\.\]|\((?i:cut|truncated|snip|clipped)\)|\[(?i:cut|truncated|snip|clipped)\]?|\x{FFFD}|&[A-Za-z]{0,6}|<[/A-Za-z]{0,8})\s*$"
_STOP = r"[.?!。？！][\"'”’»)\]]*\s*$"
_HALF_STOP = r"(?:/[A-Za-z0-9_-]+|\[\s*\d+)\.\s*$"  # a path's or a time stamp's point


def shape_of(line: Column) -> Column:
    """The kind of a line: a hash of it with words, numbers and hex values masked."""
    s = F.regexp_replace(F.rtrim(line), r"\s+", " ")
    for pattern, mask in ((r"0x[0-9a-f]*", "#"), (r"\b(?=[a-z]*\d)[0-9a-f]{7,}\b", "#"), (r"[\w/.-]+\.[ch]\b", "@"), (r"[\p{L}_$][\p{L}\p{N}_$-]*", "w"), (r"\d+", "N")):
        s = F.regexp_replace(s, pattern, mask)
    return F.xxhash64(s)


def final_of(line: Column) -> Column:
    """What a line's last word says of its wholeness: the word's last part, or the length of a hex value; else empty."""
    bare = F.rtrim(line)
    hexed = F.regexp_extract(bare, r"0x([0-9a-f]*)$", 1)
    word = F.lower(F.regexp_extract(bare, r"(\p{L}+)$", 1))
    return F.when(bare.rlike(r"0x[0-9a-f]*$"), F.concat(F.lit("#"), F.length(hexed).cast("string"))).otherwise(word)


_BLANK = " \t\r\n\f\x0b"


def _bare(text: Column) -> Column:
    return F.rtrim(text, F.lit(_BLANK))


def _finished(line: Column) -> Column:
    return line.rlike(_STOP) & ~line.rlike(_HALF_STOP)


def _kind(text: Column, last: Column) -> Column:
    """How a text ends, by its last line and its open code fences."""
    fences = F.length(text) - F.length(F.replace(text, F.lit("```"), F.lit("``")))
    return (
        F.when(text.isNull() | (last == ""), "empty")
        .when(last.rlike(_MARK), "mark")
        .when(text.contains("```") & (fences % 2 == 1), "open_markup")
        .when(_finished(last), "complete")
        .otherwise("unknown")
    )


def _features(documents: DataFrame) -> DataFrame:
    lined = documents.select("doc_id", "source", "text", F.substring_index(_bare(F.col("text")), "\n", -1).alias("last"))
    kinds = lined.select("doc_id", "source", F.xxhash64("text").alias("h"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), _kind(F.col("text"), F.col("last")).alias("kind"), "last")
    return kinds.select("doc_id", "source", "h", "chars", "bytes", "kind", shape_of(F.col("last")).alias("shape"), final_of(F.col("last")).alias("final"))


def _inner_lines(documents: DataFrame) -> DataFrame:
    """``shape, final, inner``: how often lines that are not a text's last have a shape and last word. Finished sentences are left out: they tell for themselves."""
    lines = F.split(_bare(F.col("text")), "\n")
    line = documents.filter("text is not null").select(F.explode(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("line")).filter(~_finished(F.col("line")))
    return line.groupBy(shape_of(F.col("line")).alias("shape"), final_of(F.col("line")).alias("final")).agg(F.count(F.lit(1)).alias("inner"))


def usual_endings(distinct: DataFrame, documents: DataFrame, n: int) -> DataFrame:
    """``shape, final``: last lines that whole texts have.

    Either many texts end in that line, or lines of that shape and last word are common inside texts (where lines are
    whole) and texts end in that shape about as often as elsewhere.
    """
    last = distinct.filter("kind NOT IN ('mark', 'empty', 'complete')").groupBy("shape", "final").agg(F.count(F.lit(1)).alias("last"))
    inner = _inner_lines(documents)
    both = last.join(inner, ["shape", "final"], "full").na.fill(0, ["last", "inner"])
    shapes = both.groupBy("shape").agg(F.sum("last").alias("last_all"), F.sum("inner").alias("inner_all"))
    often = F.col("last") >= F.lit(max(MIN_LAST, USUAL_SHARE * n))
    whole = (F.col("inner_all") >= F.lit(max(MIN_INNER, USUAL_SHARE * n))) & (F.col("last_all") * INNER_PER_LAST >= F.col("inner_all")) & (F.col("inner") >= F.lit(max(1.0, n / 20_000)))
    return both.filter("last > 0").join(shapes, "shape").filter(often | whole).select("shape", "final")


def _cut_endings(documents: DataFrame, usual: DataFrame) -> DataFrame:
    """``kind, shape, final, n``: the endings of all distinct texts cut at ``CUTS`` places each, which follow from a hash; only those that end in a usual last word have a shape."""
    h, k = F.xxhash64("text"), F.explode(F.sequence(F.lit(1), F.lit(CUTS)))
    placed = documents.filter(F.length("text") > 1).select("text", h.alias("h"), k.alias("k"))
    placed = placed.select("h", "k", _bare(F.left("text", F.lit(1) + F.pmod(F.xxhash64("h", "k"), F.length("text") - 1).cast("int"))).alias("head"))
    placed = placed.select("h", "k", "head", F.substring_index("head", "\n", -1).alias("last"))
    placed = placed.select("h", "k", _kind(F.col("head"), F.col("last")).alias("kind"), "last")
    ends = placed.withColumn("final", F.when(F.col("kind") == "unknown", final_of(F.col("last"))))
    ends = ends.join(usual.select("final", F.lit(True).alias("_u")).distinct(), "final", "left")
    ends = ends.select("h", "k", "kind", F.when(F.col("_u"), shape_of(F.col("last"))).alias("shape"), F.when(F.col("_u"), F.col("final")).alias("final"))
    return ends.groupBy("h", "k").agg(F.first(F.struct("kind", "shape", "final")).alias("e")).groupBy("e.kind", "e.shape", "e.final").agg(F.count(F.lit(1)).alias("n"))


def _log_ratio(cut: float, all_cut: float, whole: float, all_whole: float) -> float:
    return float(np.clip(np.log((cut + SMOOTH) / (all_cut + SMOOTH) / ((whole + SMOOTH) / (all_whole + SMOOTH))), *BOUNDS))


def ending_evidence(usual: DataFrame, distinct: DataFrame, documents: DataFrame, label: str) -> tuple[DataFrame, dict[str, float]]:
    """``shape, final, evidence`` of the usual endings, and the evidence of the other kinds: the log of how much likelier a cut text ends so than a whole one.

    Cut texts are all texts cut at random places; whole ones are the texts that end in a usual line or a finished sentence. How
    often whole texts have an ending never seen on one is estimated by the share of them whose ending was seen once. No
    evidence goes beyond ``BOUNDS``, so a length that is surely a limit, or surely none, can outweigh it.
    """
    cuts = materialize(_cut_endings(documents, usual), f"{label}-cuts")
    marked = usual.withColumn("usual", F.lit(True))
    whole = distinct.join(marked, ["shape", "final"], "left").withColumn("usual", F.coalesce("usual", F.lit(False)) & (F.col("kind") == "unknown")).filter("usual OR kind = 'complete'")
    whole = materialize(whole.groupBy("usual", F.when(F.col("usual"), F.col("shape")).alias("shape"), F.when(F.col("usual"), F.col("final")).alias("final")).agg(F.count(F.lit(1)).alias("w")), f"{label}-whole")
    n = cuts.join(marked, ["shape", "final"], "left").agg(
        F.sum("n").alias("all"), F.sum(F.when(F.col("kind") == "complete", F.col("n"))).alias("complete"), F.sum(F.when((F.col("kind") == "unknown") & F.col("usual").isNull(), F.col("n"))).alias("unknown")
    ).collect()[0]
    w = whole.agg(F.sum("w").alias("all"), F.sum(F.when(~F.col("usual"), F.col("w"))).alias("complete"), F.count_if(F.col("usual") & (F.col("w") == 1)).alias("once")).collect()[0]
    all_n, all_w = float(n["all"] or 0), float(w["all"] or 0)
    others = {k: _log_ratio(float(n[k] or 0), all_n, float(seen or 0), all_w) for k, seen in (("complete", w["complete"]), ("unknown", w["once"]))}
    both = usual.join(cuts.filter("kind = 'unknown'").drop("kind"), ["shape", "final"], "left").join(whole.filter("usual").drop("usual"), ["shape", "final"], "left").na.fill(0, ["n", "w"])
    ratio = F.log((F.col("n") + SMOOTH) / (all_n + SMOOTH) / ((F.col("w") + SMOOTH) / (all_w + SMOOTH)))
    return both.select("shape", "final", F.greatest(F.lit(BOUNDS[0]), F.least(F.lit(BOUNDS[1]), ratio)).alias("evidence")), others


def whole_share(evidence: np.ndarray, counts: np.ndarray, prior: float = 0.0, texts: float = 0.0, rounds: int = 200) -> float:
    """Share of cut texts among those at no limit, by EM over the endings they have, starting from ``texts`` texts with the share ``prior``."""
    share, ratio = 0.05, np.exp(evidence)
    for _ in range(rounds):
        share = float(((share * ratio / (share * ratio + 1 - share)) * counts).sum() + prior * texts) / max(1.0, counts.sum() + texts)
        share = min(0.5, max(LEAST_SHARE, share))
    return share


def cut_share(posterior: float, evidence: np.ndarray, counts: np.ndarray, rounds: int = 200) -> float:
    """Share of cut texts among those at a limit, by EM from the length's posterior over the endings they have.

    Where texts are cut most end oddly. A length that is frequent for another reason (texts of one form, texts
    filled up) has usual and finished endings, and its share falls. Never above ``posterior``.
    """
    share, ratio = posterior, np.exp(evidence)
    for _ in range(rounds):
        share = min(posterior, float(np.average(share * ratio / (share * ratio + 1 - share), weights=counts)))
    return share


def fit_censored(lengths: np.ndarray, counts: np.ndarray, rounds: int = 60) -> dict[int, float]:
    """Posterior of being cut at each candidate limit of one source.

    Lengths are log-normal, some texts longer than a limit L being stored with length L. Candidates are lengths
    with at least 5 texts and 4 times the neighbourhood's density. Maximum likelihood by EM: texts at a limit are a
    mixture of whole texts of that length and censored ones, which count with the mean and variance of the tail beyond.
    """
    order = np.argsort(lengths)
    x, n = lengths[order].astype(float), counts[order].astype(float)
    if n.sum() < 20:
        return {}
    logs = np.log(np.maximum(x, 1))
    total, near = np.cumsum(np.concatenate([[0], n])), []
    for v, c in zip(x, n, strict=True):
        reach = max(10, 0.05 * v)
        lo, hi = np.searchsorted(x, [v - reach, v + reach + 1])
        near.append((total[hi] - total[lo] - c) / (2 * reach))
    limits = np.flatnonzero((n >= 5) & (n >= 4 * np.array(near) + 3))
    if not len(limits):
        return {}
    mean, var = np.average(logs, weights=n), max(1e-4, np.cov(logs, aweights=n, ddof=0) if len(x) > 1 else 1e-4)
    cut = np.zeros(len(x))
    from math import erfc, pi, sqrt

    for _ in range(rounds):
        sd = sqrt(var)
        whole = n.sum() * np.exp(-((logs - mean) ** 2) / (2 * var)) / (sd * sqrt(2 * pi)) / np.maximum(x, 1)
        cut[limits] = np.clip(1 - whole[limits] / n[limits], 0, 1)
        m1, m2 = logs.copy(), logs**2
        for i in limits:
            a = (logs[i] - mean) / sd
            tail = max(erfc(a / sqrt(2)) / 2, 1e-12)
            ratio = min(np.exp(-a * a / 2) / sqrt(2 * pi) / tail, a + 6)
            beyond, second = mean + sd * ratio, var * (1 + a * ratio) + mean**2 + 2 * mean * sd * ratio
            m1[i] = (1 - cut[i]) * logs[i] + cut[i] * beyond
            m2[i] = (1 - cut[i]) * logs[i] ** 2 + cut[i] * second
        new = np.average(m1, weights=n)
        var, done = max(1e-4, np.average(m2, weights=n) - new**2), abs(new - mean) < 1e-6
        mean = new
        if done:
            break
    return {int(x[i]): float(np.clip(cut[i], 0, 0.999)) for i in limits if cut[i] > 0.05}


def _bin(size: Column) -> Column:
    """Lengths of up to 65,536 as they are, larger ones in bins a thousandth of an octave wide."""
    return F.when(size <= 65_536, size).otherwise(F.pow(F.lit(2.0), F.round(F.log2(size) * 1000) / 1000).cast("int"))


def limit_posteriors(distinct: DataFrame) -> DataFrame:
    """``source, unit, size, posterior``: lengths at which a source's texts are cut, in characters or bytes.

    Works on one histogram of lengths (:func:`_bin`) per source, so a source's rows are never gathered. A null source is one source.
    """
    unit = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size"))))
    sizes = distinct.filter("kind <> 'empty'").select(F.coalesce("source", F.lit("")).alias("source"), unit.alias("u")).select("source", "u.*")
    hist = sizes.groupBy("source", "unit", _bin(F.col("size")).alias("size")).agg(F.count(F.lit(1)).alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        found = fit_censored(pdf["size"].to_numpy(), pdf["n"].to_numpy())
        return pd.DataFrame({"source": pdf["source"].iloc[0], "unit": pdf["unit"].iloc[0], "size": list(found), "posterior": list(found.values())}).astype({"size": "int32", "posterior": "float64"})

    return hist.groupBy("source", "unit").applyInPandas(fit, "source string, unit string, size int, posterior double")


def _at_limit(rows: DataFrame, limits: DataFrame, unit: str) -> DataFrame:
    """Adds ``<unit>_posterior`` to rows that have a limit's length; both sides know lengths by their bins."""
    own = limits.filter(F.col("unit") == unit).select(F.col("source").alias("_s"), F.col("size").alias("_b"), F.col("posterior").alias(f"{unit}_posterior"))
    return rows.withColumn("_b", _bin(F.col(unit))).join(own, ["_s", "_b"], "left").drop("_b")


def limit_shares(limits: DataFrame, judged: DataFrame) -> DataFrame:
    """The limits with the share of cut texts (:func:`cut_share`) as their posterior, from one histogram of endings per limit."""
    found = [
        _at_limit(judged, limits, u).filter(F.col(f"{u}_posterior").isNotNull()).select(F.col("_s").alias("source"), F.lit(u).alias("unit"), _bin(F.col(u)).alias("size"), F.col(f"{u}_posterior").alias("posterior"), F.round("evidence", 1).alias("evidence"))
        for u in ("chars", "bytes")
    ]
    hist = found[0].unionByName(found[1]).groupBy("source", "unit", "size", "posterior", "evidence").agg(F.count(F.lit(1)).alias("n"))

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf[["source", "unit", "size"]].iloc[:1]
        return first.assign(posterior=cut_share(pdf["posterior"].iloc[0], pdf["evidence"].to_numpy(), pdf["n"].to_numpy()))

    return hist.groupBy("source", "unit", "size").applyInPandas(share, "source string, unit string, size int, posterior double")


def source_shares(judged: DataFrame) -> DataFrame:
    """``_s, base``: the share of cut texts of each source away from its limits (:func:`whole_share`), from one histogram of endings per source.

    Evidence is rounded to a tenth, so a histogram has at most some 130 rows. Sources with few texts stay near the share of all.
    """
    hist = materialize(judged.groupBy("_s", F.round("evidence", 1).alias("evidence")).agg(F.count(F.lit(1)).alias("n")), "p10-bases")
    whole = hist.groupBy("evidence").agg(F.sum("n").alias("n")).toPandas()
    common = whole_share(whole["evidence"].to_numpy(), whole["n"].to_numpy()) if len(whole) else LEAST_SHARE

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["_s"]].iloc[:1].assign(base=whole_share(pdf["evidence"].to_numpy(), pdf["n"].to_numpy(), common, PRIOR_TEXTS))

    return hist.groupBy("_s").applyInPandas(share, "_s string, base double")


def truncation_scores(documents: DataFrame, label: str = "p10") -> DataFrame:
    """``doc_id, source, ending, posterior, evidence, cut``: every document's kind of ending, the censoring posterior of its length, and the verdict.

    The log odds of being cut are those of the length plus those of the ending. The length's are the share of cut texts at a limit of
    the source, or the source's share of cut texts away from limits; both come from fits over all texts. The ending's are
    likelihood ratios (:func:`ending_evidence`), bounded on both sides: an odd ending far from limits in a source that cuts nothing
    is not cut, and a finished sentence at a limit that cuts all else is. Only a mark of a cut or an open code fence speaks louder.
    Equal texts count once in all statistics, under the first source by name. Null and blank texts are not cut; an empty
    table gives no rows.
    """
    seen = materialize(_features(documents), f"{label}-features")
    columns = [c for c in seen.columns if c != "h"]
    distinct = seen.groupBy("h").agg(F.min_by(F.struct(*columns), F.struct(F.coalesce("source", F.lit("")), "doc_id")).alias("d")).select("h", "d.*")
    distinct = materialize(distinct, f"{label}-distinct")
    n = distinct.count()
    usual = materialize(usual_endings(distinct, documents, n), f"{label}-usual")
    ratios, others = ending_evidence(usual, distinct, documents, label)
    ratios = materialize(ratios, f"{label}-evidence")
    weight = F.create_map(*[F.lit(v) for pair in (EVIDENCE | others).items() for v in pair])

    def judged(rows: DataFrame) -> DataFrame:
        is_usual = (F.col("kind") == "unknown") & F.col("evidence").isNotNull()
        joined = rows.withColumn("_s", F.coalesce("source", F.lit(""))).join(ratios, ["shape", "final"], "left")
        return joined.withColumns({"ending": F.when(is_usual, "usual").otherwise(F.col("kind")), "evidence": F.when(is_usual, F.col("evidence")).otherwise(F.try_element_at(weight, F.col("kind")))})

    known = materialize(judged(distinct).filter("kind <> 'empty'"), f"{label}-judged")
    fitted = materialize(limit_posteriors(distinct), f"{label}-fitted")
    limits = materialize(limit_shares(fitted, known), f"{label}-limits")
    away = _at_limit(_at_limit(known, limits, "chars"), limits, "bytes").filter("chars_posterior IS NULL AND bytes_posterior IS NULL")
    bases = materialize(source_shares(away), f"{label}-shares")
    joined = _at_limit(_at_limit(judged(seen), limits, "chars"), limits, "bytes").join(bases, "_s", "left")
    at_none = F.coalesce("base", F.lit(LEAST_SHARE))
    posterior = F.greatest(F.coalesce("chars_posterior", F.lit(0.0)), F.coalesce("bytes_posterior", F.lit(0.0)), at_none)
    scored = joined.select("doc_id", "source", "ending", posterior.alias("posterior"), "evidence")
    odds = F.log(F.col("posterior") / (1 - F.col("posterior"))) + F.col("evidence")
    return scored.select("doc_id", "source", "ending", "posterior", "evidence", F.coalesce(odds > 0, F.lit(False)).alias("cut"))
