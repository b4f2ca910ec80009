"""Cause cards: model output of any layout, as variants, brought to one fixed schema with evidence-based limits.

Every section follows one pattern: if the output has the section's own list, its entries are completed field by
field from a list of names each may go by; else the section is made from older members. Names are tried in order and the
first that holds something wins (null, blank texts and empty lists hold nothing; 0 and false do).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_token, let, no_strings, strip
from .quality import input_quality

VERSION = "3.0-representation-normalized"
#: Keyword rules in order; the first that a text meets decides.
FIX_SHAPES = [
    ("add_bounds_check", ["bounds check", "range check", "validate index", "oob", "out-of-bounds"]),
    ("initialize_field", ["initialize", "clear", "zero", "uninitialized"]),
    ("fix_lifetime", ["reference", "refcount", "use-after-free", "hold ref"]),
    ("cancel_async", ["cancel", "timer", "workqueue", "callback", "defer"]),
    ("add_locking", ["lock", "unlock", "irq-disable", "deadlock"]),
    ("validate_input", ["validate input", "sanity check", "check flags"]),
]
SIGNAL_TYPES = [
    ("index", ["index", "slot", "stbl[", "array", "bound"]),
    ("length", ["len", "length", "size"]),
    ("lock", ["lock", "mutex", "spin", "irq"]),
    ("state", ["state", "flag", "mode", "context"]),
    ("lifetime", ["lifetime", "free", "refcount", "use-after-free"]),
    ("pointer", ["pointer", "ptr", "address"]),
]
MECHANISMS = [("callback", "callback"), ("workqueue", "workqueue"), ("timer", "timer"), ("rcu", "rcu"), ("softirq", "softirq"), ("syscall", "syscall"), ("metadata", "metadata_parse"), ("call", "direct_call")]
GENERIC_OBJECTS = ["lock", "timer", "object", "entry", "name"]
TYPED_SIGNALS = ["object", "field", "index", "length", "pointer", "lock", "state", "lifetime"]
TOKEN_ARRAYS = ["must_match_tokens", "should_match_tokens", "weak_context_tokens", "must_not_match_conditions", "primary_root_tokens", "bridge_tokens", "surface_tokens"]
TRIGGER_ARRAYS = ["syscalls", "bpf_program_types", "bpf_helpers", "bpf_map_types", "bpf_map_ops", "tracepoints", "socket_ops", "semantic_tokens"]
NEEDED_EVIDENCE = "more complete crash stack, source location, sanitizer lifecycle/origin trace, or reproducer semantics"


def extract_json(text: Column) -> Column:
    """The JSON in a model's answer as a variant: the whole text, else a fenced block, else the outermost braces; null if none parses."""
    def read(t: Column) -> Column:
        listed = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))  # in brackets, so that nothing may follow the value
        return let(listed, lambda x: F.when(F.try_variant_get(x, "$[1]", "variant").isNull(), F.try_variant_get(x, "$[0]", "variant")))

    return F.coalesce(read(text), read(F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1), F.lit(""))), read(F.regexp_substr(text, F.lit(r"(?s)\{.*\}"))))


def kind(v: Column, path: str = "$") -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def is_object(v: Column, path: str = "$") -> Column:
    return F.coalesce(kind(v, path).startswith("OBJECT"), F.lit(False))


def text(v: Column, *paths: str) -> Column:
    """First member among paths that holds something, as text; null if none does."""
    return F.coalesce(*[F.regexp_substr(F.try_variant_get(v, p, "string"), F.lit(r"(?s)^(?!\s*$|\[\]$|\{\}$).*$")) for p in paths])


def entries(v: Column, path: str) -> Column:
    """The entries of a list member as variants; a missing or other member is an empty list."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def text_list(v: Column, path: str) -> Column:
    """A member as a list of trimmed non-blank texts; a single value counts as a list of one."""
    listed = F.when(kind(v, path).startswith("ARRAY"), F.try_variant_get(v, path, "array<string>")).otherwise(F.array(F.try_variant_get(v, path, "string")))
    return F.coalesce(F.filter(F.transform(listed, strip), lambda x: x.isNotNull() & (x != "")), no_strings())


def each_object(items: Column, build: Callable[[Column, Column], Column]) -> Column:
    """``build(entry, number)`` of every entry that is an object; numbers count all entries from 1."""
    return F.filter(F.transform(items, lambda x, i: F.when(is_object(x), build(x, i + 1))), lambda x: x.isNotNull())


def rule(value: Column, rules: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """Name of the first rule of which the text holds any word."""
    def chosen(v: Column) -> Column:
        out = None
        for name, words in rules:
            hit = v.rlike("|".join(r"\Q" + w + r"\E" for w in words))
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out.otherwise(otherwise)

    return let(value, chosen)


def fix_shape(summary: Column) -> Column:
    return rule(F.lower(F.coalesce(summary, F.lit(""))), FIX_SHAPES, "other")


def signal_type(name: Column, summary: Column) -> Column:
    both = F.struct(F.coalesce(name, F.lit("")).alias("name"), F.coalesce(summary, F.lit("")).alias("summary"))
    return let(both, lambda x: F.when(x["name"].rlike(r"->|\."), "field").otherwise(rule(F.lower(F.concat_ws(" ", x["name"], x["summary"])), SIGNAL_TYPES, "object")))


def _or(x: Column, default) -> Column:
    return F.coalesce(x, F.lit(default) if isinstance(default, str) else default)


def root_locations(raw: Column) -> Column:
    """Candidate source locations: a ``file:function:line`` text, one object or a list of them."""
    under = "$.root_cause"
    found = lambda v, p: F.when(text(v, p).isNotNull(), F.try_variant_get(v, p, "variant"))
    nested = lambda at: F.coalesce(found(raw, f"{at}.root_cause_location"), found(raw, f"{at}.location"))
    here = F.try_variant_get(raw, under, "variant").isNotNull()
    where = F.coalesce(found(raw, "$.root_cause_location"), F.when(here, nested(under)).otherwise(nested("$.analysis.root_cause")))

    def place(x: Column, _n: Column) -> Column:
        return F.struct(
            _or(text(x, "$.file"), "").alias("file"), _or(text(x, "$.function"), "").alias("function"), _or(text(x, "$.line", "$.line_range", "$.lines"), "").alias("line"),
            _or(text(x, "$.role"), "root").alias("role"), _or(text(x, "$.description", "$.why_root", "$.code", "$.code_snippet"), "").alias("description"),
        )

    def single(said: Column) -> Column:
        parts = F.split(said, ":")
        part = lambda i, other: F.when(F.size(parts) >= 3, F.get(parts, F.lit(i))).otherwise(other)
        return F.struct(part(0, "").alias("file"), part(1, "").alias("function"), part(2, said).alias("line"), F.lit("root").alias("role"), F.lit("").alias("description"))

    def made(loc: Column) -> Column:
        listed = F.when(is_object(loc), F.array(loc)).otherwise(entries(loc, "$"))
        return F.when(kind(loc) == "STRING", F.array(let(F.try_variant_get(loc, "$", "string"), single))).when(loc.isNotNull(), each_object(listed, place))

    none = F.array().cast("array<struct<file:string,function:string,line:string,role:string,description:string>>")
    return F.coalesce(let(where, made), none)


def source_evidence(raw: Column) -> Column:
    """``ref, relevance`` pairs; without a list of them, an evidence object's members, else the analysis's list."""
    pair = lambda ref, rel: F.struct(_or(ref, "").alias("ref"), _or(rel, "").alias("relevance"))
    own = each_object(entries(raw, "$.source_evidence"), lambda x, n: pair(text(x, "$.code_snippet_ref", "$.location", "$.file"), text(x, "$.relevance", "$.detail", "$.description")))
    members = F.transform(F.map_entries(F.when(is_object(raw, "$.evidence"), F.try_variant_get(raw, "$.evidence", "map<string,string>"))), lambda e: pair(e["key"], e["value"]))
    old = each_object(entries(raw, "$.analysis.source_evidence"), lambda x, n: pair(text(x, "$.file", "$.location"), text(x, "$.evidence", "$.relevance")))
    return F.when(F.size(own) > 0, own).when(F.size(members) > 0, members).otherwise(old)


def fix_semantics(raw: Column) -> Column:
    """``summary, shape, location`` of the suggested fix."""
    paths = ["$.fix_semantics", "$.fix_guidance", "$.fix_suggestion", "$.analysis.root_cause.missing_validation"]
    found = F.coalesce(*[F.when(text(raw, p).isNotNull(), F.try_variant_get(raw, p, "variant")) for p in paths])

    def parts(fix: Column) -> Column:
        said = lambda *p: F.when(is_object(fix), _or(text(fix, *p), "")).otherwise("")
        summary = F.when(kind(fix) == "STRING", F.try_variant_get(fix, "$", "string")).otherwise(said("$.summary", "$.suggested_fix", "$.change"))
        return F.struct(summary.alias("summary"), said("$.expected_shape", "$.expected_patch_shape").alias("shape"), said("$.affected_code", "$.affected_code_location", "$.file").alias("location"))

    return let(found, parts)


def dedup_fingerprint(raw: Column) -> Column:
    """``semantic_id, tokens`` of the older fingerprint, a text or an object."""
    whole = F.try_variant_get(raw, "$.dedup_fingerprint", "string")
    words = F.filter(F.split(whole, r"[^A-Za-z0-9_]+"), lambda t: t != "")
    lists = [text_list(raw, f"$.dedup_fingerprint.{k}") for k in ("tokens", "root_object_tokens", "invariant_tokens", "function_tokens", "subsystem_tokens", "root_object", "invariant", "subsystem")]
    plain, nested = kind(raw, "$.dedup_fingerprint") == "STRING", is_object(raw, "$.dedup_fingerprint")
    semantic = F.when(plain, whole).when(nested, _or(text(raw, "$.dedup_fingerprint.semantic_id", "$.dedup_fingerprint.root_object", "$.cause_id"), "")).otherwise("")
    return F.struct(semantic.alias("semantic_id"), F.when(plain, words).when(nested, F.concat(*lists)).otherwise(no_strings()).alias("tokens"))


def own_or(own: Column, made: Column) -> Column:
    """A section's own list unless it is empty."""
    return let(own, lambda x: F.when(F.size(x) > 0, x).otherwise(made))


def _first_kept(items: Column, *keys: str) -> Column:
    """Entries at their first occurrence by ``keys``."""
    key = lambda e: F.struct(*[e[k] for k in keys])
    return let(items, lambda xs: let(F.transform(xs, key), lambda ks: F.filter(xs, lambda e, i: F.array_position(ks, F.get(ks, i)) == i + 1)))


def evidence_ledger(raw: Column, case_id: Column, title: Column, anchor: Column, locations: Column, evidence: Column) -> Column:
    """Numbered evidence: the output's own, else the crash card, then locations, then source evidence.

    Numbers are given before entries with the same source, place and summary are dropped.
    """
    def entry(i, source, location, summary, level, weight) -> Column:
        return F.struct(i.alias("evidence_id"), source.alias("source"), location.alias("location"), summary.alias("content_summary"), level.alias("evidence_level"), weight.alias("dedup_weight"))

    number = lambda n: F.concat(F.lit("E"), n.cast("string"))
    own = each_object(
        entries(raw, "$.evidence_ledger"),
        lambda x, n: entry(_or(text(x, "$.evidence_id"), number(n)), _or(text(x, "$.source"), "inference"), _or(text(x, "$.location", "$.ref"), ""),
                           _or(text(x, "$.content_summary", "$.summary", "$.content"), ""), _or(text(x, "$.evidence_level"), "indirect"), _or(text(x, "$.dedup_weight"), "medium")),
    )
    names = F.slice(F.filter(F.transform(F.coalesce(anchor, no_strings()), strip), lambda x: x != ""), 1, 3)
    first = entry(F.lit("E1"), F.lit("crash_card"), F.concat(F.lit("crash_card:"), _or(case_id, "")), F.concat(_or(title, ""), F.lit(" | anchor_trace="), F.array_join(names, ", ")), F.lit("direct"), F.lit("medium"))
    place = lambda x: F.array_join(F.filter(F.array(x["file"], x["function"], x["line"]), lambda p: p != ""), ":")
    located = F.transform(locations, lambda x, i: entry(number(i + 2), F.lit("source_code"), place(x), F.when(strip(x["description"]) != "", x["description"]).otherwise("candidate source location"), F.lit("direct"), F.lit("high")))
    seen = F.transform(evidence, lambda x, i: entry(number(i + 2 + F.size(locations)), F.lit("source_code"), x["ref"], x["relevance"], F.lit("indirect"), F.lit("medium")))
    made = _first_kept(F.concat(F.array(first), located, seen), "source", "location", "content_summary")
    return own_or(own, made)


def refined_name(name: Column, type_: Column, description: Column, evidence: Column, tokens: Column) -> Column:
    """A more telling name for a generic root object: a member access in the texts, a dotted token, or its struct."""
    source = lambda x: x.rlike(r"(?:^|\.)[ch]$")
    said = F.array_join(F.concat(F.array(_or(description, "")), F.flatten(F.transform(evidence, lambda e: F.array(e["ref"], e["relevance"])))), "\n")
    parts = F.struct(_or(name, "").alias("name"), F.regexp_extract(type_, r"^struct\s+(\S.*)$", 1).alias("struct"), said.alias("said"), F.get(F.filter(tokens, lambda t: t.contains(".") & ~source(t)), F.lit(0)).alias("token"))

    def chosen(p: Column) -> Column:
        arrow = F.nullif(F.regexp_extract(p["said"], r"([A-Za-z_][A-Za-z0-9_]*->[A-Za-z_][A-Za-z0-9_]*)", 1), F.lit(""))
        dotted = let(F.regexp_extract(p["said"], r"([A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]{2,})", 1), lambda x: F.when((x != "") & ~source(x), x))
        better = F.coalesce(arrow, dotted, p["token"], F.when(p["struct"] != "", F.concat_ws(".", p["struct"], p["name"])))
        return F.when(p["name"].isin(GENERIC_OBJECTS), F.coalesce(better, p["name"])).when(p["name"] == "", p["struct"]).otherwise(p["name"])

    return let(parts, chosen)


def root_cause_signals(raw: Column, primary: Column, fingerprint: Column, locations: Column, evidence: Column, ledger: Column) -> Column:
    """Signals of the root cause; without a list of them, from the root object, the operation, old tokens and the function."""
    def signal(i, t, name, token, role, why, support, stability, weight, against=None) -> Column:
        return F.struct(i.alias("signal_id"), t.alias("signal_type"), name.alias("name"), token.alias("normalized_token"), role.alias("role"), why.alias("why_related"), support.alias("supporting_evidence"),
                        (against if against is not None else no_strings()).alias("contradicting_evidence"), stability.alias("stability"), weight.alias("dedup_weight"))

    lit, number = F.lit, lambda n: F.concat(F.lit("S"), n.cast("string"))

    def completed(x: Column, n: Column) -> Column:
        name = _or(text(x, "$.name", "$.signal", "$.object"), "")
        return signal(_or(text(x, "$.signal_id"), number(n)), _or(text(x, "$.signal_type"), signal_type(name, lit(""))), name, _or(text(x, "$.normalized_token"), clean_token(name)), _or(text(x, "$.role"), "candidate_root_signal"),
                      _or(text(x, "$.why_related", "$.summary"), ""), text_list(x, "$.supporting_evidence"), _or(text(x, "$.stability"), "stable"), _or(text(x, "$.dedup_weight"), "medium"), text_list(x, "$.contradicting_evidence"))

    own = each_object(entries(raw, "$.root_cause_signals"), completed)
    own_object = is_object(raw, "$.root_object")
    pick = lambda k: F.when(own_object, text(raw, f"$.root_object.{k}")).otherwise(text(raw, f"$.root_cause.root_object.{k}"))
    named = F.coalesce(text(raw, "$.root_cause.object"), F.when(~is_object(raw, "$.root_cause.root_object"), text(raw, "$.root_cause.root_object")), pick("name"), pick("field"))
    described = _or(F.coalesce(pick("description"), text(raw, "$.root_cause.violated_invariant", "$.root_cause.missing_validation")), "")
    at = F.get(locations, lit(0))["description"]
    ids = F.transform(ledger, lambda e: e["evidence_id"])
    facts = F.struct(
        described.alias("why"), _or(F.coalesce(pick("type"), pick("field_type")), "").alias("type"), _or(named, "").alias("named"), ids.alias("ids"), fingerprint["tokens"].alias("tokens"),
        F.coalesce(F.when(strip(at) != "", at), text(raw, "$.crash_surface.crash_operation")).alias("done"), F.coalesce(F.when(strip(primary) != "", primary), text(raw, "$.analysis.crash_type")).alias("function"),
    )

    def made(f: Column) -> Column:
        some = lambda a, b, c, d: F.when(F.size(f["ids"]) >= a, F.slice(f["ids"], a, b)).otherwise(F.slice(f["ids"], c, d))
        high, medium = some(2, 2, 1, 1), some(3, 3, 1, 2)
        why = F.when(f["why"] != "", f["why"]).otherwise("primary source-level object tied to the crash representation")
        root = let(refined_name(f["named"], f["type"], f["why"], evidence, f["tokens"]), lambda n: F.when(n != "", signal(lit("S?"), signal_type(n, f["why"]), n, clean_token(n), lit("candidate_root_signal"), why, high, lit("stable"), lit("high"))))
        operation = F.when(f["done"].isNotNull(), signal(lit("S?"), lit("source_operation"), f["done"], F.left(clean_token(f["done"]), lit(96)), lit("proximal_signal"), lit("exact or near-exact source operation around the crash or candidate cause site"), high, lit("version_sensitive"), lit("high")))
        old = F.transform(F.transform(f["tokens"], lambda t: F.struct(t.alias("t"), clean_token(t).alias("c"))), lambda t: signal(lit("S?"), signal_type(t["c"], t["c"]), t["t"], t["c"], lit("context_signal"), lit("legacy dedup token preserved during normalization"), medium, lit("stable"), lit("medium")))
        before = _first_kept(F.filter(F.concat(F.array_compact(F.array(root, operation)), old), lambda s: s["normalized_token"] != ""), "normalized_token")
        last = F.when(f["function"].isNotNull(), signal(lit("S?"), lit("state"), f["function"], F.concat(lit("function:"), clean_token(f["function"])), lit("context_signal"), lit("subsystem-local function context from crash surface"), F.slice(f["ids"], 1, 1), lit("stable"), lit("low")))
        return F.transform(F.concat(before, F.array_compact(F.array(last))), lambda s, i: s.withField("signal_id", number(i + 1)))

    return own_or(own, let(facts, made))


def invariant_signals(raw: Column, ledger: Column) -> Column:
    """Violated invariants; without a list of them, one from the older statement."""
    def invariant(i, expected, seen, basis, level, weight) -> Column:
        return F.struct(i.alias("invariant_id"), expected.alias("expected"), seen.alias("observed_or_suspected_violation"), basis.alias("source_basis"), level.alias("evidence_level"), weight.alias("dedup_weight"))

    own = each_object(
        entries(raw, "$.invariant_signals"),
        lambda x, n: invariant(_or(text(x, "$.invariant_id"), F.concat(F.lit("I"), n.cast("string"))), _or(text(x, "$.expected"), ""), _or(text(x, "$.observed_or_suspected_violation", "$.actual", "$.summary"), ""),
                               text_list(x, "$.source_basis"), _or(text(x, "$.evidence_level"), "indirect"), _or(text(x, "$.dedup_weight"), "medium")),
    )
    plain = F.when(kind(raw, "$.violated_invariant") == "STRING", text(raw, "$.violated_invariant"))
    said = text(raw, "$.violated_invariant.invariant", "$.violated_invariant.violated_invariant", "$.root_cause.violated_invariant", "$.root_cause.missing_validation")
    facts = F.struct(text(raw, "$.violated_invariant.expected").alias("expected"), text(raw, "$.violated_invariant.actual").alias("actual"), said.alias("said"), plain.alias("plain"))
    basis = F.transform(F.slice(ledger, 1, 3), lambda e: e["evidence_id"])

    def one(f: Column) -> Column:
        both = F.when(f["expected"].isNotNull() | f["actual"].isNotNull(), F.concat(F.lit("expected: "), _or(f["expected"], "None"), F.lit("; actual: "), _or(f["actual"], "None")))
        return let(F.coalesce(f["said"], both, f["plain"]), lambda s: F.when(s.isNotNull(), invariant(F.lit("I1"), _or(f["expected"], s), _or(f["actual"], s), basis, F.lit("indirect"), F.when(f["expected"].isNotNull(), "high").otherwise("medium"))))

    made = F.array_compact(F.array(let(facts, one)))
    return own_or(own, made)


def propagation_signals(raw: Column, ledger: Column) -> Column:
    """Steps from cause to crash; without a list of them, from the older path of objects or texts."""
    def step(n, a, b, how, support, weight) -> Column:
        return F.struct(n.alias("step"), a.alias("from"), b.alias("to"), how.alias("mechanism"), support.alias("source_evidence"), weight.alias("dedup_weight"))

    own = each_object(
        entries(raw, "$.propagation_signals"),
        lambda x, n: step(_or(text(x, "$.step"), n.cast("string")), _or(text(x, "$.from"), ""), _or(text(x, "$.to"), ""), _or(text(x, "$.mechanism"), "other"), text_list(x, "$.source_evidence"), _or(text(x, "$.dedup_weight"), "medium")),
    )
    as_list = lambda p: F.when(kind(raw, p).startswith("ARRAY"), entries(raw, p)).otherwise(F.array(F.try_variant_get(raw, p, "variant")))
    path = F.when(text(raw, "$.propagation_path").isNotNull(), as_list("$.propagation_path")).when(text(raw, "$.analysis.propagation_path").isNotNull(), as_list("$.analysis.propagation_path"))
    support = lambda n: F.transform(F.slice(ledger, 1, n), lambda e: e["evidence_id"])

    def old(x: Column, i: Column) -> Column:
        said = F.lower(F.concat_ws(" ", text(x, "$.detail"), text(x, "$.action"), text(x, "$.location")))
        nested = step(_or(text(x, "$.step"), (i + 1).cast("string")), _or(text(x, "$.from", "$.location", "$.step"), ""), _or(text(x, "$.to", "$.detail", "$.action"), ""), rule(said, [(b, [a]) for a, b in MECHANISMS], "other"), support(2), F.lit("medium"))
        plain = step((i + 1).cast("string"), strip(F.try_variant_get(x, "$", "string")), F.lit(""), F.lit("other"), support(1), F.lit("low"))
        return F.when(is_object(x), nested).when((kind(x) == "STRING") & (strip(F.try_variant_get(x, "$", "string")) != ""), plain)

    made = F.filter(F.transform(F.coalesce(path, F.array().cast("array<variant>")), old), lambda s: s.isNotNull())
    return own_or(own, made)


def hypotheses(raw: Column, ledger: Column) -> Column:
    """Hypotheses; without a list of them, one from the older summary."""
    def hypothesis(i, summary, role, support, against, confidence, usable) -> Column:
        return F.struct(i.alias("hypothesis_id"), summary.alias("summary"), role.alias("role"), support.alias("supporting_evidence"), against.alias("contradicting_evidence"), confidence.alias("confidence"), usable.alias("dedup_usable"))

    own = each_object(
        entries(raw, "$.hypotheses"),
        lambda x, n: hypothesis(_or(text(x, "$.hypothesis_id"), F.concat(F.lit("H"), n.cast("string"))), _or(text(x, "$.summary"), ""), _or(text(x, "$.role"), "candidate_root_cause"), text_list(x, "$.supporting_evidence"),
                                text_list(x, "$.contradicting_evidence"), _or(text(x, "$.confidence"), "medium"), F.coalesce(F.try_variant_get(x, "$.dedup_usable", "boolean"), F.lit(True))),
    )
    summary = text(raw, "$.root_cause.root_cause_summary", "$.root_cause.violated_invariant", "$.root_cause.missing_validation", "$.violated_invariant.actual", "$.summary", "$.analysis_summary", "$.root_cause_hypothesis.summary", "$.analysis.summary")
    support = F.transform(F.slice(ledger, 1, 3), lambda e: e["evidence_id"])
    one = lambda s: hypothesis(F.lit("H1"), s, F.lit("candidate_root_cause"), support, no_strings(), F.lower(_or(text(raw, "$.confidence", "$.analysis.confidence"), "medium")), F.lit(True))
    return own_or(own, F.array_compact(F.array(let(summary, lambda s: F.when(s.isNotNull(), one(s))))))


def patch_hypotheses(raw: Column, ledger: Column) -> Column:
    """Guesses at the patch; without a list of them, one from the suggested fix."""
    def patch(shape, target, summary, support, confidence, weight) -> Column:
        return F.struct(shape.alias("shape"), target.alias("target"), summary.alias("summary"), support.alias("supporting_evidence"), confidence.alias("confidence"), weight.alias("dedup_weight"))

    own = each_object(
        entries(raw, "$.patch_semantics_hypotheses"),
        lambda x, n: patch(F.coalesce(text(x, "$.shape"), fix_shape(text(x, "$.summary"))), _or(text(x, "$.target"), ""), _or(text(x, "$.summary"), ""), text_list(x, "$.supporting_evidence"), _or(text(x, "$.confidence"), "medium"), _or(text(x, "$.dedup_weight"), "medium")),
    )
    support = F.transform(F.slice(ledger, 1, 3), lambda e: e["evidence_id"])

    def from_fix(fix: Column) -> Column:
        shape = F.when(fix["shape"] != "", fix["shape"]).otherwise(fix_shape(fix["summary"]))
        return F.when((fix["summary"] != "") | (fix["shape"] != "") | (fix["location"] != ""), patch(shape, fix["location"], fix["summary"], support, F.lit("medium"), F.lit("medium")))

    return own_or(own, F.array_compact(F.array(let(fix_semantics(raw), from_fix))))


def _objects_or_texts(raw: Column, path: str, nested, plain) -> Column:
    listed = F.when(kind(raw, path).startswith("ARRAY"), entries(raw, path)).otherwise(F.array_compact(F.array(F.try_variant_get(raw, path, "variant"))))
    said = lambda x: strip(F.try_variant_get(x, "$", "string"))
    made = F.transform(listed, lambda x, i: F.when(is_object(x), nested(x, i + 1)).when((kind(x) == "STRING") & (said(x) != ""), plain(said(x), i + 1)))
    return F.filter(made, lambda x: x.isNotNull())


def negative_evidence(raw: Column) -> Column:
    def claim(c, why, evidence, strength) -> Column:
        return F.struct(c.alias("claim"), why.alias("why_it_matters_for_dedup"), evidence.alias("evidence"), strength.alias("conflict_strength"))

    return _objects_or_texts(
        raw, "$.negative_evidence",
        lambda x, n: claim(_or(text(x, "$.claim", "$.summary"), ""), _or(text(x, "$.why_it_matters_for_dedup", "$.reason"), ""), text_list(x, "$.evidence"), _or(text(x, "$.conflict_strength"), "medium")),
        lambda s, n: claim(s, F.lit(""), no_strings(), F.lit("low")),
    )


def uncertainty(raw: Column) -> Column:
    def doubt(aspect, reason, needed, impact) -> Column:
        return F.struct(aspect.alias("aspect"), reason.alias("reason"), needed.alias("needed_evidence"), impact.alias("dedup_impact"))

    name = lambda n: F.concat(F.lit("uncertainty_"), n.cast("string"))
    return _objects_or_texts(
        raw, "$.uncertainty",
        lambda x, n: doubt(_or(text(x, "$.aspect"), name(n)), _or(text(x, "$.reason", "$.summary"), ""), _or(text(x, "$.needed_evidence"), ""), _or(text(x, "$.dedup_impact"), "medium")),
        lambda s, n: doubt(name(n), s, F.lit(""), F.lit("medium")),
    )


def trigger_semantics(raw: Column, card: Column) -> Column:
    """Trigger facts: the output's own object if it has one, else the crash card's."""
    own = is_object(raw, "$.reproducer_semantics")
    trimmed = lambda k: F.coalesce(F.filter(F.transform(card[k], strip), lambda x: x != ""), no_strings())
    return F.struct(*[F.when(own, text_list(raw, f"$.reproducer_semantics.{k}")).otherwise(trimmed(k)).alias(k) for k in TRIGGER_ARRAYS])


def lock_context(raw: Column, card: Column) -> Column:
    """Lock facts of the output over those of the crash card (a variant)."""
    def first(a: str, b: str, empty: str) -> Column:
        pick = lambda v, p: F.when(text(v, p).isNotNull(), F.to_json(F.try_variant_get(v, p, "variant")))
        return F.parse_json(F.coalesce(pick(raw, f"$.lockdep_context.{a}"), pick(card, f"$.{b}"), F.lit(empty)))

    def listed(k: str) -> Column:
        own, base = text_list(raw, f"$.lockdep_context.{k}"), text_list(card, f"$.{k}")
        return F.when(F.size(own) > 0, own).otherwise(base)

    irq = lambda k: F.when(is_object(raw, "$.lockdep_context.irq_context"), text(raw, f"$.lockdep_context.irq_context.{k}")).otherwise("unknown").alias(k)
    bridge = "bpf_tracepoint_bridge"
    present = F.coalesce(F.try_variant_get(raw, f"$.lockdep_context.{bridge}.present", "boolean"), F.try_variant_get(card, f"$.{bridge}.present", "boolean"), F.lit(False))
    return F.struct(
        first("current_chain", "current_acquisition", "{}").alias("current_chain"),
        first("existing_dependency_chain", "existing_dependency_chain", "[]").alias("existing_dependency_chain"),
        first("held_locks", "held_locks", "[]").alias("held_locks"),
        _or(F.coalesce(text(raw, "$.lockdep_context.unsafe_scenario"), text(card, "$.unsafe_scenario")), "").alias("unsafe_scenario"),
        listed("lock_classes").alias("lock_classes"),
        F.struct(irq("irqs_disabled"), irq("hardirq_context"), irq("softirq_context")).alias("irq_context"),
        F.struct(present.alias("present"), *[listed(f"{bridge}.{k}").alias(k) for k in ("tracepoints", "bpf_frames", "map_operations")], text_list(raw, f"$.lockdep_context.{bridge}.source_evidence").alias("source_evidence")).alias(bridge),
    )


def token_representation(raw: Column, file: Column, sanitizer: Column, title_func: Column, signals: Column, invariants: Column, patches: Column, negatives: Column, bridge: Column, trigger: Column) -> Column:
    """The seven token arrays: the output's own, only cleaned, else signals routed by weight and tagged by type."""
    parts = F.split(file, "/")
    subsystem = F.when(F.size(parts) >= 2, F.concat(F.lit("subsystem:"), clean_token(F.when(F.get(parts, F.lit(0)) == "fs", F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0))))))

    def tagged(s: Column) -> Column:
        t = clean_token(F.when(s["normalized_token"] != "", s["normalized_token"]).otherwise(s["name"]))
        lead = F.when(s["signal_type"] == "source_operation", "operation:").when(s["signal_type"].isin(TYPED_SIGNALS), F.concat(s["signal_type"], F.lit(":"))).otherwise("")
        return F.when(t != "", F.concat(lead, t))

    by = lambda test: F.array_compact(F.transform(F.filter(signals, test), tagged))
    rule_of = lambda test: F.array_compact(F.transform(F.filter(invariants, test), lambda i: F.when(clean_token(i["expected"]) != "", F.concat(F.lit("invariant:"), F.left(clean_token(i["expected"]), F.lit(96))))))
    one = lambda lead, x: F.array_compact(F.array(F.when(_or(x, "") != "", F.concat(F.lit(lead), clean_token(x)))))
    must = F.concat(F.array_compact(F.array(subsystem)), by(lambda s: s["dedup_weight"] == "high"), rule_of(lambda i: i["dedup_weight"] == "high"))
    shapes = F.array_compact(F.transform(patches, lambda p: F.when(clean_token(p["shape"]) != "", F.concat(F.lit("patch_shape:"), clean_token(p["shape"])))))
    should = F.concat(by(lambda s: s["dedup_weight"] == "medium"), rule_of(lambda i: i["dedup_weight"] != "high"), shapes)
    weak = F.concat(by(lambda s: ~s["dedup_weight"].isin("high", "medium")), one("sanitizer:", sanitizer), one("function:", title_func))
    never = F.array_compact(F.transform(F.filter(negatives, lambda n: n["conflict_strength"].isin("high", "medium")), lambda n: F.when(clean_token(n["claim"]) != "", F.concat(F.lit("conflict:"), F.left(clean_token(n["claim"]), F.lit(96))))))
    lead = lambda items, tag: F.transform(items, lambda x: F.concat(F.lit(tag), clean_token(x)))
    bridges = F.concat(
        lead(text_list(bridge, "$.bpf_frames"), "bpf_frame:"), lead(text_list(bridge, "$.map_operations"), "map_op:"), lead(text_list(bridge, "$.tracepoints"), "tracepoint:"),
        lead(F.coalesce(trigger["semantic_tokens"], no_strings()), ""), lead(F.coalesce(trigger["bpf_map_types"], no_strings()), "repro_map_type:"), lead(F.coalesce(trigger["tracepoints"], no_strings()), "repro_tracepoint:"),
    )
    made = dict(zip(TOKEN_ARRAYS, (must, should, weak, never, must, bridges, weak), strict=True))
    own = is_object(raw, "$.dedup_representation")
    return F.struct(*[F.when(own, text_list(raw, f"$.dedup_representation.{k}")).otherwise(F.array_distinct(F.filter(v, lambda x: x != ""))).alias(k) for k, v in made.items()])


def representation_confidence(raw: Column, ledger: Column, tokens: Column, doubts: Column) -> Column:
    """Level and reason: the output's own, else by the density of direct evidence and stable tokens."""
    count = lambda level: F.size(F.filter(ledger, lambda e: e["evidence_level"] == level))
    direct, total = count("direct"), F.size(ledger)
    stable = F.size(tokens["must_match_tokens"]) + F.size(tokens["should_match_tokens"])
    said = F.lower(_or(text(raw, "$.confidence"), "medium"))
    bare, unseen = (total == 0) | (stable == 0), direct == 0
    level = F.when(bare | unseen, "low").when(said.isin("high", "medium", "low"), said).otherwise("medium")
    capped = (level == "high") & F.exists(doubts, lambda d: d["dedup_impact"] == "high")
    reason = F.when(capped, "high-impact uncertainty remains").when(bare, "missing evidence ledger or dedup representation tokens").when(unseen, "no direct source-backed evidence after normalization").otherwise("normalized from available evidence density and dedup-ready tokens")
    own, at = is_object(raw, "$.representation_confidence"), "$.representation_confidence."
    number = lambda k, t: F.coalesce(F.try_variant_get(raw, at + k, t), F.lit(0).cast(t))
    return F.struct(
        F.when(own, _or(text(raw, at + "level"), "medium")).otherwise(F.when(capped, "medium").otherwise(level)).alias("level"),
        F.when(own, _or(text(raw, at + "reason"), "")).otherwise(reason).alias("reason"),
        F.when(own, number("direct_source_evidence_ratio", "double")).otherwise(F.when(total > 0, F.bround(direct / total, 3)).otherwise(0.0)).alias("direct_source_evidence_ratio"),
        F.when(own, number("stable_token_count", "int")).otherwise(stable).alias("stable_token_count"),
        F.when(own, number("speculative_token_count", "int")).otherwise(count("speculative")).alias("speculative_token_count"),
    )


def confidence_rank(level: Column) -> Column:
    """0 for low, 2 for high, 1 for anything else."""
    return F.when(F.lower(level) == "low", 0).when(F.lower(level) == "high", 2).otherwise(1)


def capped_by_quality(cards: DataFrame) -> DataFrame:
    """Applies the input quality's cap: lowers the level, moves all matching tokens to weak ones under a low cap, and notes it.

    Needs ``input_quality``, ``representation_confidence``, ``dedup_representation`` and ``uncertainty``.
    """
    cap = F.lower(F.coalesce("input_quality.confidence_cap", F.lit("none")))
    active, low = cap.isin("low", "medium"), cap == "low"
    rep, conf = F.col("dedup_representation"), F.col("representation_confidence")
    lowered = active & (confidence_rank(conf["level"]) > confidence_rank(cap))
    note = F.concat(F.lit("input_quality cap applied: "), cap, F.lit("; tier="), F.col("input_quality.tier"), F.lit("; weak_evidence="), F.array_join("input_quality.missing_or_weak_evidence", ", "))
    reason = F.when(lowered, F.when(_or(conf["reason"], "") != "", F.concat_ws("; ", conf["reason"], note)).otherwise(note)).otherwise(conf["reason"])
    part = lambda k: F.coalesce(F.filter(F.transform(rep[k], strip), lambda x: x.isNotNull() & (x != "")), no_strings())
    weak = F.array_distinct(F.concat(part("weak_context_tokens"), part("must_match_tokens"), part("should_match_tokens"), part("primary_root_tokens")))
    emptied = ("must_match_tokens", "should_match_tokens", "primary_root_tokens")
    moved = rep.withField("weak_context_tokens", F.when(low, weak).otherwise(rep["weak_context_tokens"]))
    for k in emptied:
        moved = moved.withField(k, F.when(low, no_strings()).otherwise(rep[k]))
    doubt = F.struct(F.lit("input_quality_cap").alias("aspect"), F.coalesce("input_quality.model_instruction", F.lit("")).alias("reason"), F.lit(NEEDED_EVIDENCE).alias("needed_evidence"), F.when(low, "high").otherwise("medium").alias("dedup_impact"))
    return cards.withColumns({
        "representation_confidence": conf.withField("level", F.when(lowered, cap).otherwise(conf["level"])).withField("reason", reason),
        "dedup_representation": moved,
        "uncertainty": F.when(active, F.array_append("uncertainty", doubt)).otherwise(F.col("uncertainty")),
    })


def tool_usage(trace: Column) -> Column:
    """Rounds, functions and files of a tool trace (a variant list of calls, batches included)."""
    calls = entries(trace, "$")
    inner = F.flatten(F.transform(calls, lambda c: F.concat(F.array(F.try_variant_get(c, "$.args", "variant")), entries(c, "$.args.requests"))))
    said = lambda key: F.array_compact(F.transform(inner, lambda a: F.when(kind(a, key) == "STRING", text(a, key))))
    rounds = F.array_max(F.concat(F.array(F.lit(0)), F.array_compact(F.transform(calls, lambda c: F.try_variant_get(c, "$.round", "int")))))
    return F.struct(rounds.alias("rounds_used"), F.array_sort(F.array_distinct(F.concat(said("$.symbol"), said("$.name")))).alias("functions_examined"), F.array_sort(F.array_distinct(said("$.file"))).alias("files_examined"))


def normalize_cause_cards(df: DataFrame) -> DataFrame:
    """Cause cards from crash card columns with ``raw`` (variant), ``hash_part``, ``small_bucket_id`` and optional ``tool_trace`` (variant).

    Works row by row without shuffles; sections are columns of their own, so each is computed once. A null ``raw`` gives a
    card made from the crash card alone.
    """
    names = set(df.columns)
    df = input_quality(df.withColumn("raw", F.coalesce("raw", F.parse_json(F.lit("{}")))))
    raw = F.col("raw")
    lock = F.parse_json(F.coalesce(F.to_json("lockdep_context"), F.lit("{}"))) if "lockdep_context" in names else F.parse_json(F.lit("{}"))
    steps: dict[str, Callable[[], Column]] = {
        "_lock": lambda: lock,
        "_locations": lambda: root_locations(raw),
        "_evidence": lambda: source_evidence(raw),
        "_fingerprint": lambda: dedup_fingerprint(raw),
        "evidence_ledger": lambda: evidence_ledger(raw, F.col("case_id"), F.col("title"), F.col("anchor_trace"), F.col("_locations"), F.col("_evidence")),
        "root_cause_signals": lambda: root_cause_signals(raw, F.col("fault.primary_function"), F.col("_fingerprint"), F.col("_locations"), F.col("_evidence"), F.col("evidence_ledger")),
        "invariant_signals": lambda: invariant_signals(raw, F.col("evidence_ledger")),
        "propagation_signals": lambda: propagation_signals(raw, F.col("evidence_ledger")),
        "hypotheses": lambda: hypotheses(raw, F.col("evidence_ledger")),
        "patch_semantics_hypotheses": lambda: patch_hypotheses(raw, F.col("evidence_ledger")),
        "negative_evidence": lambda: negative_evidence(raw),
        "uncertainty": lambda: uncertainty(raw),
        "_trigger": lambda: trigger_semantics(raw, F.col("reproducer_semantics")),
        "_locks": lambda: lock_context(raw, F.col("_lock")),
        "dedup_representation": lambda: token_representation(
            raw, F.col("fault.primary_file"), F.col("bug.sanitizer"), F.col("bug.title_func"), F.col("root_cause_signals"), F.col("invariant_signals"), F.col("patch_semantics_hypotheses"), F.col("negative_evidence"),
            F.try_variant_get(F.col("_lock"), "$.bpf_tracepoint_bridge", "variant"), F.col("reproducer_semantics")),
        "representation_confidence": lambda: representation_confidence(raw, F.col("evidence_ledger"), F.col("dedup_representation"), F.col("uncertainty")),
    }
    for name, make in steps.items():
        df = df.withColumn(name, make())
    partial = (F.col("bug.sanitizer") == "LOCKDEP") & ((F.size(entries(F.col("_locks.existing_dependency_chain"), "$")) == 0) | ~F.col("_locks.bpf_tracepoint_bridge.present"))
    conf = F.col("representation_confidence")
    drop = F.coalesce(partial & (conf["level"] == "high"), F.lit(False))
    df = df.withColumn("representation_confidence", F.when(drop, conf.withField("level", F.lit("medium")).withField("reason", F.lit("LOCKDEP representation capped because dependency chain or BPF/map bridge evidence is incomplete"))).otherwise(conf))
    point = lambda key, card, empty: F.coalesce(text(raw, f"$.crash_surface.crash_point.{key}", f"$.crash_surface.{key}", f"$.analysis.crash_sink.{key}"), *([F.nullif(F.col(card), F.lit(""))] if card else []), F.lit(empty)).alias(key)
    first_place = F.get(F.col("_locations"), F.lit(0))["description"]
    surface = F.struct(
        F.coalesce(text(raw, "$.crash_surface.sanitizer"), F.nullif(F.col("bug.sanitizer"), F.lit("")), F.lit("OTHER")).alias("sanitizer"),
        F.coalesce(text(raw, "$.crash_surface.bug_type", "$.crash_type", "$.analysis.crash_type"), F.nullif(F.col("bug.bug_type"), F.lit("")), F.lit("")).alias("bug_type"),
        F.struct(point("function", "fault.primary_function", ""), point("file", "fault.primary_file", ""), point("line", None, "0")).alias("crash_point"),
        F.coalesce(text(raw, "$.crash_surface.crash_operation"), F.when(strip(first_place) != "", first_place), F.lit("")).alias("crash_operation"),
        text_list(raw, "$.crash_surface.surface_helpers").alias("surface_helpers"),
        F.coalesce(F.try_variant_get(raw, "$.crash_surface.surface_is_root_candidate", "boolean"), F.lit(False)).alias("surface_is_root_candidate"),
        _or(text(raw, "$.crash_surface.why_surface_may_be_misleading", "$.crash_surface.why_not_root"), "").alias("why_surface_may_be_misleading"),
    )
    some = lambda k: F.when(F.size(F.col(f"sanitizer_context.{k}")) > 0, k)
    available = F.array_compact(F.array(*[F.lit(x) for x in ("crash_report", "stack", "source_code")], *[some(k) for k in ("alloc_trace", "free_trace", "origin_trace")],
        F.when(F.to_json("_lock") != "{}", "lockdep_context"), F.when(F.col("reproducer_semantics").isNotNull(), "reproducer_semantics")))
    own = lambda c: F.coalesce(c, F.lit("")) if c in names else F.lit("")
    card = df.select(
        F.lit(VERSION).alias("cause_card_version"),
        F.coalesce(text(raw, "$.cause_id"), F.nullif(F.col("_fingerprint.semantic_id"), F.lit("")), F.col("hash_part")).alias("cause_id"),
        own("big_bucket").alias("source_bucket"),
        F.col("small_bucket_id").alias("source_small_bucket"),
        own("case_id").alias("source_crash_id"),
        F.struct(F.lit("collect_root_cause_representations_not_final_rca").alias("task"), F.lit("all causal claims must be evidence-typed").alias("claim_policy"), F.lit("only stable high/medium evidence fields should drive dedup").alias("dedup_policy")).alias("analysis_contract"),
        F.struct(own("kernel_tree").alias("kernel_tree"), own("kernel_commit").alias("kernel_commit"), own("schema_version").alias("crash_card_schema"), available.alias("available_evidence")).alias("input_scope"),
        surface.alias("crash_surface"),
        *[F.col(c) for c in ("evidence_ledger", "root_cause_signals", "invariant_signals", "propagation_signals", "hypotheses", "patch_semantics_hypotheses")],
        F.col("_locks").alias("lockdep_context"),
        F.col("_trigger").alias("reproducer_semantics"),
        *[F.col(c) for c in ("dedup_representation", "negative_evidence", "uncertainty", "input_quality", "representation_confidence")],
        tool_usage(F.col("tool_trace") if "tool_trace" in names else F.parse_json(F.lit("[]"))).alias("tool_usage"),
    )
    return capped_by_quality(card)
