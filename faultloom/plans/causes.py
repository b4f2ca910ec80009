"""Queries of cause card normalization, features, lookups and selection over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import buckets as bk
from ..operators import cause_cards as cc
from ..operators import features as ft
from ..operators import linkage as lk
from ..session import scratch
from ..sources import artifacts as ar
from ..sources import sinks
from ..sources.tables import table
from . import catalog as base

QUERIES, SQL = {}, {}
query = base.registrar(QUERIES, SQL)

# The facts of every readable answer, from whichever members have them; answers in the layouts of each operator are built from these.
_O = rf"""j AS (SELECT raw_id, {base._BODY} AS doc FROM raw_cause_cards), o AS (SELECT raw_id, doc::JSON AS v FROM j WHERE doc IS NOT NULL AND json_type(doc) = 'OBJECT'),
  a AS (SELECT raw_id, v ->> '$.cause_id' AS cause, CASE WHEN json_type(v, '$.root_cause') = 'OBJECT' THEN v ->> '$.root_cause.file' END AS file, CASE WHEN json_type(v, '$.root_cause') = 'OBJECT' THEN coalesce(v ->> '$.root_cause.function', v ->> '$.root_cause.func') END AS func,
    CASE WHEN json_type(v, '$.root_cause') = 'OBJECT' THEN coalesce(v ->> '$.root_cause.line', v ->> '$.root_cause.line_range') END AS line, CASE WHEN json_type(v, '$.root_cause') = 'OBJECT' THEN coalesce(v ->> '$.root_cause.why', v ->> '$.root_cause.summary') WHEN json_type(v, '$.root_cause') = 'VARCHAR' THEN v ->> '$.root_cause' END AS why,
    CASE WHEN json_type(v, '$.fix_semantics') = 'VARCHAR' THEN v ->> '$.fix_semantics' WHEN json_type(v, '$.fix_semantics') = 'OBJECT' THEN v ->> '$.fix_semantics.text' END AS fix FROM o)"""


def _facts(spark: SparkSession, d: str) -> DataFrame:
    docs = base._answers(spark, d)
    get = lambda p: F.try_variant_get("v", p, "string")
    under = lambda member, *keys: F.when(cc.is_object(F.col("v"), f"$.{member}"), F.coalesce(*[get(f"$.{member}.{k}") for k in keys]))
    plain = lambda member: F.when(cc.kind(F.col("v"), f"$.{member}") == "STRING", get(f"$.{member}"))
    return docs.select(
        "raw_id", get("$.cause_id").alias("cause"), under("root_cause", "file").alias("file"), under("root_cause", "function", "func").alias("func"), under("root_cause", "line", "line_range").alias("line"),
        F.coalesce(under("root_cause", "why", "summary"), plain("root_cause")).alias("why"), F.coalesce(plain("fix_semantics"), under("fix_semantics", "text")).alias("fix"))


def _built(*members: Column) -> Column:
    """An answer with the given members as a variant; null members are absent."""
    return F.parse_json(F.to_json(F.struct(*members)))


def _list(*items: Column) -> Column:
    return F.array(*items)


def _obj(**members: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in members.items()])


_C = F.col
_OR = lambda c: f"coalesce({c}, '')"


def _sql_clean(x: str) -> str:
    x = rf"regexp_replace(regexp_replace(lower({base._strip(x)}), '\s+', '_', 'g'), '[^a-z0-9_:\-./>\[\]]+', '_', 'g')"
    return f"coalesce(regexp_replace(regexp_replace({x}, '_+', '_', 'g'), '^_|_$', '', 'g'), '')"


def _sql_rule(x: str, rules: list[tuple[str, list[str]]], otherwise: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({x}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in rules) + f" ELSE '{otherwise}' END"


def _sql_type(name: str, summary: str) -> str:
    both = f"lower({name} || ' ' || {summary})"
    return f"CASE WHEN contains({name}, '->') OR contains({name}, '.') THEN 'field' ELSE {_sql_rule(both, cc.SIGNAL_TYPES, 'object')} END"


@query(rf"""WITH {_O} SELECT raw_id, CASE WHEN raw_id % 2 = 0 THEN {_OR('file')} ELSE 'f.c' END AS file, CASE WHEN raw_id % 2 = 0 THEN {_OR('func')} ELSE 'fn' END AS function,
  CASE WHEN raw_id % 2 = 0 THEN {_OR('line')} ELSE '7' END AS line, CASE WHEN raw_id % 2 = 0 THEN 'sink' ELSE 'root' END AS role, CASE WHEN raw_id % 2 = 0 THEN {_OR('why')} ELSE '' END AS description FROM a""")
def cause_locations(spark: SparkSession, d: str) -> DataFrame:
    """Candidate places of every answer, given as a list of objects or as one text."""
    listed = _built(_list(_obj(file=_C("file"), function=_C("func"), line_range=_C("line"), role=F.lit("sink"), why_root=_C("why"))).alias("root_cause_location"))
    said = _built(_obj(location=F.lit("f.c:fn:7")).alias("root_cause"))
    found = _facts(spark, d).select("raw_id", F.inline(cc.root_locations(F.when(_C("raw_id") % 2 == 0, listed).otherwise(said))))
    return found.select("raw_id", "file", "function", "line", "role", "description")


@query(rf"""WITH {_O} SELECT raw_id, CASE WHEN raw_id % 2 = 0 THEN coalesce(file, func, '') ELSE 'a' END AS ref, CASE WHEN raw_id % 2 = 0 THEN {_OR('why')} ELSE coalesce(cause, '') END AS relevance FROM a
UNION ALL SELECT raw_id, 'b', fix FROM a WHERE raw_id % 2 = 1 AND fix IS NOT NULL""")
def cause_source_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Source evidence of every answer, given as a list or as an object of texts."""
    listed = _built(_list(_obj(location=_C("file"), file=_C("func"), detail=_C("why"))).alias("source_evidence"))
    named = _built(_obj(b=_C("fix"), a=_C("cause")).alias("evidence"))
    return _facts(spark, d).select("raw_id", F.inline(cc.source_evidence(F.when(_C("raw_id") % 2 == 0, listed).otherwise(named))))


_LEDGER_ROWS = f"""[{{'i': 'E1', 's': 'crash_card', 'l': 'crash_card:' || {_OR('cause')}, 'c': 'a title | anchor_trace=anchor_a, anchor_b', 'e': 'direct', 'w': 'medium'}},
    CASE WHEN coalesce(file, func, line, why) IS NOT NULL THEN {{'i': 'E2', 's': 'source_code', 'l': array_to_string(list_filter([{_OR('file')}, {_OR('func')}, {_OR('line')}], lambda x: x <> ''), ':'), 'c': coalesce(why, 'candidate source location'), 'e': 'direct', 'w': 'high'}} END,
    {{'i': CASE WHEN coalesce(file, func, line, why) IS NOT NULL THEN 'E3' ELSE 'E2' END, 's': 'source_code', 'l': {_OR('file')}, 'c': {_OR('fix')}, 'e': 'indirect', 'w': 'medium'}}]"""


@query(rf"""WITH {_O}, l AS (SELECT raw_id, {_LEDGER_ROWS} AS l FROM a), k AS (SELECT raw_id, list_filter(l, lambda x: x IS NOT NULL) AS l FROM l)
SELECT raw_id, array_to_string(list_transform(list_filter(l, lambda x, i: i < 3 OR x.l <> l[2].l OR x.c <> l[2].c), lambda x: x.i || '=' || x.s || '@' || x.l || ':' || x.c || '/' || x.e || '/' || x.w), '|') AS ledger FROM k""")
def cause_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The numbered evidence of every answer: its card, its place, its source evidence, repeated entries once."""
    seen = _obj(location=_C("file"), detail=_C("fix"))
    facts = _facts(spark, d).withColumn("v", _built(_obj(file=_C("file"), function=_C("func"), line=_C("line"), description=_C("why")).alias("root_cause_location"), _list(seen, seen).alias("source_evidence")))
    v = _C("v")
    ledger = cc.evidence_ledger(v, _C("cause"), F.lit("a title"), F.array(F.lit("anchor_a "), F.lit(""), F.lit("anchor_b")), cc.root_locations(v), cc.source_evidence(v))
    one = lambda e: F.concat(e["evidence_id"], F.lit("="), e["source"], F.lit("@"), e["location"], F.lit(":"), e["content_summary"], F.lit("/"), e["evidence_level"], F.lit("/"), e["dedup_weight"])
    return facts.select("raw_id", F.array_join(F.transform(ledger, one), "|").alias("ledger"))


_EMPTY = "array<struct<ref:string,relevance:string>>"
def _ids() -> Column:
    return F.array(*[F.struct(F.lit(e).alias("evidence_id")) for e in ("E1", "E2", "E3", "E4")])



def _signals(v: Column) -> Column:
    return cc.root_cause_signals(v, F.lit(None).cast("string"), cc.dedup_fingerprint(v), cc.root_locations(v), F.array().cast(_EMPTY), _ids())


def _signal_text(s: Column) -> Column:
    return F.concat_ws("/", s["signal_id"], s["signal_type"], s["name"], s["normalized_token"], s["role"], s["why_related"], F.array_join(s["supporting_evidence"], ","), s["stability"], s["dedup_weight"])


@query(rf"""WITH {_O} SELECT raw_id, 'S1/' || {_sql_type(_OR('func'), "''")} || '/' || {_OR('func')} || '/' || {_sql_clean(_OR('func'))} || '/candidate_root_signal/' || {_OR('why')} || '/E9,E2/stable/low' AS first,
  'S2/object/' || {_OR('cause')} || '/tok/context_signal///stable/medium' AS second FROM a""")
def cause_own_signals(spark: SparkSession, d: str) -> DataFrame:
    """Root signals that every answer lists itself, completed from the names they may go by."""
    own = _list(_obj(signal=_C("func"), summary=_C("why"), supporting_evidence=F.array(F.lit(" E9"), F.lit(""), F.lit("E2")), dedup_weight=F.lit("low"), signal_type=F.lit(None).cast("string"), normalized_token=F.lit(None).cast("string"), role=F.lit(None).cast("string")),
                _obj(signal=_C("cause"), summary=F.lit(""), supporting_evidence=F.array().cast("array<string>"), dedup_weight=F.lit(None).cast("string"), signal_type=F.lit("object"), normalized_token=F.lit("tok"), role=F.lit("context_signal")))
    s = _signals(_C("v"))
    return _facts(spark, d).withColumn("v", _built(own.alias("root_cause_signals"))).select("raw_id", s.alias("s")).select("raw_id", _signal_text(F.get("s", F.lit(0))).alias("first"), _signal_text(F.get("s", F.lit(1))).alias("second"))


_WHY = "CASE WHEN why IS NULL THEN 'primary source-level object tied to the crash representation' ELSE why END"


@query(rf"""WITH {_O}, s AS (SELECT raw_id, list_filter([CASE WHEN func IS NOT NULL THEN {_sql_type('func', _OR('why'))} || '/' || func || '/' || {_sql_clean('func')} || '/candidate_root_signal/' || {_WHY} || '/E2,E3/stable/high' END,
    CASE WHEN fix IS NOT NULL THEN 'source_operation/' || fix || '/' || left({_sql_clean('fix')}, 96) || '/proximal_signal/exact or near-exact source operation around the crash or candidate cause site/E2,E3/version_sensitive/high' END,
    {_sql_type("'old_tok'", "'old_tok'")} || '/old_tok/old_tok/context_signal/legacy dedup token preserved during normalization/E3,E4/stable/medium'], lambda x: x IS NOT NULL) AS l FROM a)
SELECT raw_id, array_to_string(list_transform(l, lambda x, i: 'S' || i || '/' || x), '|') AS signals FROM s""")
def cause_made_signals(spark: SparkSession, d: str) -> DataFrame:
    """Root signals made from the root object, the operation and old tokens where an answer lists none; equal tokens once."""
    v = _built(_obj(name=_C("func"), description=_C("why")).alias("root_object"), _obj(crash_operation=_C("fix")).alias("crash_surface"), F.lit("old_tok old_tok").alias("dedup_fingerprint"))
    return _facts(spark, d).withColumn("v", v).select("raw_id", F.array_join(F.transform(_signals(_C("v")), _signal_text), "|").alias("signals"))


_OWN_STEP = f"'1/' || {_OR('func')} || '/' || {_OR('file')} || '/other//medium'"
_SAID = "lower(concat_ws(' ', fix, why, file))"


@query(rf"""WITH {_O} SELECT raw_id, {_OWN_STEP} AS own, '1/' || coalesce(file, '') || '/' || coalesce(fix, why, '') || '/' || {_sql_rule(_SAID, [(b, [a]) for a, b in cc.MECHANISMS], 'other')} || '/E1,E2/medium' || CASE WHEN func IS NOT NULL THEN '|2/' || func || '//other/E1/low' ELSE '' END AS made FROM a""")
def cause_propagation(spark: SparkSession, d: str) -> DataFrame:
    """Steps from cause to crash that an answer lists itself, and those made from the older path of objects and texts."""
    own = _built(F.array(F.to_json(F.struct(_C("func").alias("from"), _C("file").alias("to")))).alias("x"))
    own = F.parse_json(F.concat(F.lit('{"propagation_signals":['), F.to_json(F.struct(_C("func").alias("from"), _C("file").alias("to"))), F.lit("]}")))
    path = F.concat_ws(",", F.to_json(F.struct(_C("file").alias("location"), _C("fix").alias("detail"), _C("why").alias("action"))), F.when(_C("func").isNotNull(), F.regexp_replace(F.to_json(F.array("func")), r"^\[|\]$", "")))
    old = F.parse_json(F.concat(F.lit('{"propagation_path":['), path, F.lit("]}")))
    one = lambda s: F.concat_ws("/", s["step"], s["from"], s["to"], s["mechanism"], F.array_join(s["source_evidence"], ","), s["dedup_weight"])
    shown = lambda v: F.array_join(F.transform(cc.propagation_signals(v, _ids()), one), "|")
    return _facts(spark, d).select("raw_id", shown(own).alias("own"), shown(old).alias("made"))


@query(rf"""WITH {_O} SELECT raw_id, 'H1/' || {_OR('why')} || '/candidate_root_cause/E5/medium/false' AS own, CASE WHEN coalesce(why, fix) IS NOT NULL THEN 'H1/' || coalesce(why, fix) || '/candidate_root_cause/E1,E2,E3/high/true' ELSE '' END AS made FROM a""")
def cause_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """Hypotheses that an answer lists itself, and the one made from its older summaries."""
    own = _built(_list(_obj(summary=_C("why"), supporting_evidence=F.array(F.lit("E5")), dedup_usable=F.lit(False))).alias("hypotheses"))
    old = _built(_obj(root_cause_summary=_C("why")).alias("root_cause"), _C("fix").alias("analysis_summary"), F.lit("HIGH").alias("confidence"))
    one = lambda h: F.concat_ws("/", h["hypothesis_id"], h["summary"], h["role"], F.array_join(h["supporting_evidence"], ","), h["confidence"], h["dedup_usable"].cast("string"))
    shown = lambda v: F.array_join(F.transform(cc.hypotheses(v, _ids()), one), "|")
    return _facts(spark, d).select("raw_id", shown(own).alias("own"), shown(old).alias("made"))


@query(rf"""WITH {_O} SELECT raw_id, {_sql_rule("lower(coalesce(fix, ''))", cc.FIX_SHAPES, 'other')} || '/' || {_OR('func')} || '/' || {_OR('fix')} || '//medium/medium' AS own,
  {_sql_rule("lower(coalesce(fix, ''))", cc.FIX_SHAPES, 'other')} || '/at/' || {_OR('fix')} || '/E1,E2,E3/medium/medium' AS made, CASE WHEN fix IS NOT NULL THEN {_sql_rule("lower(fix)", cc.FIX_SHAPES, 'other')} || '//' || fix || '/E1,E2,E3/medium/medium' ELSE '' END AS said FROM a""")
def cause_patches(spark: SparkSession, d: str) -> DataFrame:
    """Guesses at the patch: listed ones, one made from a fix given as an object, and one from a fix given as a text."""
    own = _built(_list(_obj(target=_C("func"), summary=_C("fix"))).alias("patch_semantics_hypotheses"))
    old, said = _built(_obj(suggested_fix=_C("fix"), file=F.lit("at")).alias("fix_guidance")), _built(_C("fix").alias("fix_suggestion"))
    one = lambda p: F.concat_ws("/", p["shape"], p["target"], p["summary"], F.array_join(p["supporting_evidence"], ","), p["confidence"], p["dedup_weight"])
    shown = lambda v: F.array_join(F.transform(cc.patch_hypotheses(v, _ids()), one), "|")
    return _facts(spark, d).select("raw_id", shown(own).alias("own"), shown(old).alias("made"), shown(said).alias("said"))


@query(rf"""WITH {_O} SELECT raw_id, {_OR('why')} || '/r/E1/medium' || CASE WHEN fix IS NOT NULL THEN '|' || fix || '///low' ELSE '' END AS negatives, 'uncertainty_1/' || {_OR('why')} || '//medium' || CASE WHEN fix IS NOT NULL THEN '|uncertainty_2/' || fix || '//medium' ELSE '' END AS doubts FROM a""")
def cause_doubts(spark: SparkSession, d: str) -> DataFrame:
    """Negative evidence and uncertainty of every answer, given as objects and as texts."""
    mixed = lambda key, first: F.parse_json(F.concat(F.lit('{"' + key + '":['), F.concat_ws(",", F.to_json(first), F.when(_C("fix").isNotNull(), F.regexp_replace(F.to_json(F.array("fix")), r"^\[|\]$", ""))), F.lit("]}")))
    negative = cc.negative_evidence(mixed("negative_evidence", F.struct(_C("why").alias("summary"), F.lit("r").alias("reason"), F.array(F.lit("E1")).alias("evidence"))))
    doubt = cc.uncertainty(mixed("uncertainty", F.struct(_C("why").alias("reason"))))
    return _facts(spark, d).select(
        "raw_id", F.array_join(F.transform(negative, lambda n: F.concat_ws("/", n["claim"], n["why_it_matters_for_dedup"], F.array_join(n["evidence"], ","), n["conflict_strength"])), "|").alias("negatives"),
        F.array_join(F.transform(doubt, lambda u: F.concat_ws("/", u["aspect"], u["reason"], u["needed_evidence"], u["dedup_impact"])), "|").alias("doubts"))


_TAG = lambda lead, x, most=None: f"CASE WHEN {_sql_clean(x)} <> '' THEN '{lead}' || " + (f"left({_sql_clean(x)}, {most})" if most else _sql_clean(x)) + " END"
_LISTED = lambda *xs: base._sql_unique(f"list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL AND x <> '')")
_SUBSYSTEM = "CASE WHEN contains(file, '/') THEN 'subsystem:' || " + _sql_clean("CASE WHEN split_part(file, '/', 1) = 'fs' THEN split_part(file, '/', 2) ELSE split_part(file, '/', 1) END") + " END"
_MUST = _LISTED(_SUBSYSTEM, _TAG("object:", "func"), _TAG("invariant:", "why", 96))
_WEAK = _LISTED(_TAG("", "cause"), "'sanitizer:kasan'", "CASE WHEN func <> '' THEN 'function:' || " + _sql_clean("func") + " END")


@query(rf"""WITH {_O} SELECT raw_id, array_to_string({_MUST}, '|') AS must, array_to_string({_LISTED(_TAG("operation:", "fix"), _TAG("invariant:", "fix", 96), "'patch_shape:add_locking'")}, '|') AS should, array_to_string({_WEAK}, '|') AS weak,
  array_to_string({_LISTED(_TAG("conflict:", "why", 96))}, '|') AS never, array_to_string({_MUST}, '|') AS roots, 'bpf_frame:bpf_prog|map_op:op_a|' || 'repro:x|repro_map_type:hash|repro_tracepoint:sched' AS bridges FROM a""")
def cause_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every answer routed by weight and tagged by type."""
    none = F.array().cast("array<string>")
    signal = lambda t, n, w: F.struct(F.lit(t).alias("signal_type"), F.coalesce(n, F.lit("")).alias("name"), F.lit("").alias("normalized_token"), F.lit(w).alias("dedup_weight"))
    signals = F.array(signal("object", _C("func"), "high"), signal("source_operation", _C("fix"), "medium"), signal("other", _C("cause"), "low"))
    rule = lambda x, w: F.struct(F.coalesce(x, F.lit("")).alias("expected"), F.lit(w).alias("dedup_weight"))
    invariants, patches = F.array(rule(_C("why"), "high"), rule(_C("fix"), "medium")), F.array(F.struct(F.lit("add locking").alias("shape")))
    against = F.array(F.struct(F.coalesce("why", F.lit("")).alias("claim"), F.lit("high").alias("conflict_strength")), F.struct(F.lit("soft").alias("claim"), F.lit("low").alias("conflict_strength")))
    bridge = F.parse_json(F.lit('{"bpf_frames":["bpf_prog"],"map_operations":["op a"],"tracepoints":[]}'))
    trigger = F.struct(F.array(F.lit("repro:x")).alias("semantic_tokens"), F.array(F.lit("HASH")).alias("bpf_map_types"), F.array(F.lit("sched")).alias("tracepoints"))
    t = cc.token_representation(F.parse_json(F.lit("{}")), _C("file"), F.lit("KASAN"), _C("func"), signals, invariants, patches, against, bridge, trigger)
    names = {"must_match_tokens": "must", "should_match_tokens": "should", "weak_context_tokens": "weak", "must_not_match_conditions": "never", "primary_root_tokens": "roots", "bridge_tokens": "bridges"}
    return _facts(spark, d).select("raw_id", t.alias("t")).select("raw_id", *[F.array_join(f"t.{a}", "|").alias(b) for a, b in names.items()])


@query(rf"""WITH {_O}, n AS (SELECT raw_id, (raw_id % 3)::INT AS direct, (raw_id % 4)::INT AS other, (raw_id % 5)::INT AS stable, ['high', 'medium', 'low', 'odd'][(raw_id % 4 + 1)::INT] AS said, raw_id % 7 = 0 AS impact FROM a),
  l AS (SELECT *, CASE WHEN direct + other = 0 OR stable = 0 OR direct = 0 THEN 'low' WHEN said <> 'odd' THEN said ELSE 'medium' END AS lv FROM n)
SELECT raw_id, CASE WHEN lv = 'high' AND impact THEN 'medium' ELSE lv END AS level, CASE WHEN lv = 'high' AND impact THEN 'high-impact uncertainty remains' WHEN direct + other = 0 OR stable = 0 THEN 'missing evidence ledger or dedup representation tokens'
  WHEN direct = 0 THEN 'no direct source-backed evidence after normalization' ELSE 'normalized from available evidence density and dedup-ready tokens' END AS reason,
  CASE WHEN direct + other > 0 THEN round_even(direct / (direct + other), 3) ELSE 0.0 END AS ratio, stable AS stable_tokens, other AS speculative FROM l""")
def cause_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The confidence of every answer by its evidence and tokens."""
    n = lambda k: (_C("raw_id") % k).cast("int")
    entry = lambda level: F.struct(F.lit(level).alias("evidence_level"))
    ledger = F.concat(F.array_repeat(entry("direct"), n(3)), F.array_repeat(entry("speculative"), n(4)))
    tokens = F.struct(F.array_repeat(F.lit("t"), n(5)).alias("must_match_tokens"), F.array().cast("array<string>").alias("should_match_tokens"))
    doubts = F.array(F.struct(F.when(_C("raw_id") % 7 == 0, "high").otherwise("low").alias("dedup_impact")))
    raw = _built(F.get(F.array(*[F.lit(x) for x in ("HIGH", "medium", "low", "odd")]), n(4)).alias("confidence"))
    c = cc.representation_confidence(raw, ledger, tokens, doubts)
    return _facts(spark, d).select("raw_id", c.alias("c")).select("raw_id", "c.level", "c.reason", F.col("c.direct_source_evidence_ratio").alias("ratio"), F.col("c.stable_token_count").alias("stable_tokens"), F.col("c.speculative_token_count").alias("speculative"))


@query(rf"""WITH {_O} SELECT raw_id, array_to_string(CASE json_type(v, '$.lock_classes') WHEN 'ARRAY' THEN list_filter(list_transform(from_json(v -> '$.lock_classes', '["VARCHAR"]'), lambda x: {base._strip('x')}), lambda x: x <> '') WHEN 'VARCHAR' THEN list_filter([{base._strip("v ->> '$.lock_classes'")}], lambda x: x <> '') ELSE [] END, '|') AS classes FROM o""")
def cause_text_lists(spark: SparkSession, d: str) -> DataFrame:
    """A member of every answer as a list of texts, be it a list, one text or absent."""
    return base._answers(spark, d).select("raw_id", F.array_join(cc.text_list(F.col("v"), "$.lock_classes"), "|").alias("classes"))


@query(rf"""WITH {_O} SELECT raw_id, 2 AS rounds, array_to_string(list_sort(list_distinct(list_filter([func, cause, 'zz'], lambda x: x IS NOT NULL))), '|') AS functions, array_to_string(list_sort(list_distinct(list_filter([file, 'b.c'], lambda x: x IS NOT NULL))), '|') AS files FROM a""")
def cause_tool_usage(spark: SparkSession, d: str) -> DataFrame:
    """Rounds, functions and files of a tool trace, batches included."""
    call = F.to_json(F.struct(F.lit(1).alias("round"), F.struct(_C("func").alias("symbol"), _C("file").alias("file")).alias("args")))
    many = F.to_json(F.struct(F.lit(2).alias("round"), F.struct(F.array(F.struct(_C("cause").alias("name"), F.lit("b.c").alias("file")), F.struct(F.lit("zz").alias("name"), _C("file").alias("file"))).alias("requests")).alias("args")))
    u = cc.tool_usage(F.parse_json(F.concat(F.lit("["), call, F.lit(","), many, F.lit("]"))))
    return _facts(spark, d).select("raw_id", u.alias("u")).select("raw_id", F.col("u.rounds_used").alias("rounds"), F.array_join("u.functions_examined", "|").alias("functions"), F.array_join("u.files_examined", "|").alias("files"))


@query(rf"""WITH {_O} SELECT raw_id, CASE WHEN raw_id % 2 = 0 THEN coalesce(func, '') ELSE 'card_call' END AS syscalls, coalesce(why, 'card says') AS unsafe, CASE WHEN func IS NOT NULL THEN func ELSE 'card_lock' END AS classes, raw_id % 2 = 0 AS present, 'unknown' AS irqs FROM a""")
def cause_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Trigger and lock facts of every answer over those of its crash card."""
    even = _C("raw_id") % 2 == 0
    raw = F.when(even, _built(_obj(syscalls=F.array_compact(F.array("func"))).alias("reproducer_semantics"), _obj(unsafe_scenario=_C("why"), lock_classes=F.array_compact(F.array("func")), bpf_tracepoint_bridge=_obj(present=F.lit(True))).alias("lockdep_context")))
    raw = raw.otherwise(_built(_obj(unsafe_scenario=_C("why"), lock_classes=F.array_compact(F.array("func"))).alias("lockdep_context")))
    card = F.struct(*[F.array(F.lit(" card_call "), F.lit("")).alias(k) for k in cc.TRIGGER_ARRAYS])
    locks = F.parse_json(F.lit('{"unsafe_scenario":"card says","lock_classes":["card_lock"]}'))
    facts = _facts(spark, d).withColumn("raw", raw)
    out = facts.select("raw_id", cc.trigger_semantics(_C("raw"), card).alias("t"), cc.lock_context(_C("raw"), locks).alias("l"))
    return out.select("raw_id", F.array_join("t.syscalls", "|").alias("syscalls"), F.col("l.unsafe_scenario").alias("unsafe"), F.array_join("l.lock_classes", "|").alias("classes"), F.col("l.bpf_tracepoint_bridge.present").alias("present"), F.col("l.irq_context.irqs_disabled").alias("irqs"))


# --- features ----------------------------------------------------------------------------------------------------------
_SENT = lambda label, x: base._sql_canonical(f"CASE WHEN trim(coalesce({x}, '')) <> '' THEN '{label}: ' || {x} ELSE '' END")
_REP = lambda k: f"coalesce({base._sql_tokens(f'dedup_representation.{k}')}, [])"
_KEPT = lambda x: f"list_filter({x}, lambda t: t <> '')"


def _sql_token_lists() -> str:
    surface = [_SENT("surface_sanitizer", "crash_surface.sanitizer"), _SENT("surface_bug_type", "crash_surface.bug_type"), _SENT("surface_function", "crash_surface.crash_point.function"), _SENT("surface_file", "crash_surface.crash_point.file")]
    lists = {"primary_root": _REP("primary_root_tokens"), "must": _REP("must_match_tokens"), "surface": _REP("surface_tokens") + " || " + _KEPT(f"[{', '.join(surface)}]"), "weak": _REP("weak_context_tokens"), "negative": _REP("must_not_match_conditions")}
    return "WITH l AS (SELECT cause_row, " + ", ".join(f"{v} AS {k}" for k, v in lists.items()) + " FROM cause_cards) SELECT cause_row, " + ", ".join(f"array_to_string({base._sql_unique(k)}, '|') AS {k}" for k in lists) + " FROM l"


@query(_sql_token_lists())
def token_lists(spark: SparkSession, d: str) -> DataFrame:
    """The token lists of every cause card that are not compared."""
    cards = table(spark, d, "cause_cards", "cause_row", "dedup_representation", "propagation_signals", "crash_surface")
    return ft.token_fields(cards).select("cause_row", *[F.array_join(f"fields.{k}", "|").alias(k) for k in ("primary_root", "must", "surface", "weak", "negative")])


_CAN = base._sql_canonical


_NO = "[]::VARCHAR[]"
_IF = lambda c, *texts: f"CASE WHEN {c} IS NOT NULL THEN [{', '.join(_CAN(t) for t in texts)}] ELSE {_NO} END"


@query(rf"""WITH {_O}, l AS (SELECT raw_id, {_IF('func', 'func')} AS l1, {_IF('why', "'expected: ' || why")} || {_IF('fix', "'violation: ' || fix")} AS l2, {_IF('fix', "'patch_summary: ' || fix")} AS l3, {_IF('file', 'file')} AS l4,
    {_IF('why', "'root_signal: ' || why", "'hypothesis: ' || why")} || {_IF('fix', "'evidence: ' || fix")} || {_IF('file', "'location: ' || file")} AS l5, {_IF('why', "'do_not_merge_with: ' || why")} AS l6 FROM a)
SELECT raw_id, array_to_string({base._sql_unique('l1')}, '|') AS object, array_to_string({base._sql_unique('l2')}, '|') AS invariant, array_to_string({base._sql_unique('l3')}, '|') AS patch, array_to_string({base._sql_unique('l4')}, '|') AS should,
  array_to_string({base._sql_unique('l5')}, '|') AS evidence, array_to_string({base._sql_unique('l6')}, '|') AS negative, 'syscall:open$x|sem|socket_op:bind' AS weak FROM l""")
def evidence_fields(spark: SparkSession, d: str) -> DataFrame:
    """Token lists filled from signals, invariants, patches, hypotheses, evidence and conflicts; weak and unstable ones are filtered or routed."""
    lit, none = F.lit, F.lit(None).cast("string")
    signal = lambda t, name, why, stability, weight: _obj(signal_type=lit(t), role=none, name=name, normalized_token=none, why_related=why, stability=lit(stability), dedup_weight=lit(weight))
    df = _facts(spark, d).select(
        "raw_id",
        F.array(signal("object", _C("func"), _C("why"), "stable", "high"), signal("object", _C("file"), _C("fix"), "version_sensitive", "medium"), signal("object", _C("cause"), _C("cause"), "stable", "low")).alias("root_cause_signals"),
        F.array(_obj(expected=_C("why"), observed_or_suspected_violation=_C("fix"), evidence_level=lit("direct"), dedup_weight=lit("high")), _obj(expected=_C("cause"), observed_or_suspected_violation=_C("cause"), evidence_level=lit("weak"), dedup_weight=lit("high"))).alias("invariant_signals"),
        F.array(_obj(shape=none, target=none, summary=_C("fix"), confidence=lit("Medium"), dedup_weight=lit("high")), _obj(shape=lit("x"), target=none, summary=none, confidence=lit(" LOW"), dedup_weight=lit("high"))).alias("patch_semantics_hypotheses"),
        F.array(_obj(summary=_C("why"), confidence=lit("high"), dedup_usable=lit(True)), _obj(summary=_C("cause"), confidence=lit("high"), dedup_usable=lit(False))).alias("hypotheses"),
        F.array(_obj(content_summary=_C("fix"), location=_C("file"), evidence_level=lit("indirect"), dedup_weight=lit("high")), _obj(content_summary=_C("cause"), location=none, evidence_level=lit("direct"), dedup_weight=lit("low"))).alias("evidence_ledger"),
        F.array(_obj(claim=_C("why"), conflict_strength=lit("high")), _obj(claim=_C("cause"), conflict_strength=lit("low"))).alias("negative_evidence"),
        _obj(syscalls=F.array(lit("open$x")), semantic_tokens=F.array(lit("sem")), socket_ops=F.array(lit("bind"))).alias("reproducer_semantics"),
    )
    return ft.token_fields(df).select("raw_id", *[F.array_join(f"fields.{k}", "|").alias(k) for k in ("object", "invariant", "patch", "should", "evidence", "negative", "weak")])


# --- lookups, round trips, selection ---------------------------------------------------------------------------------
@query("SELECT f.cause_card_id, f.copied_file_name, v.vec_id AS position FROM feature_rows f JOIN vectors v USING (record_id)")
def cached_order(spark: SparkSession, d: str) -> DataFrame:
    """Records with their places in the order of cached vectors."""
    order = table(spark, d, "vectors", "record_id", F.col("vec_id").alias("position"))
    return ar.in_cached_order(table(spark, d, "feature_rows", "record_id", "cause_card_id", "copied_file_name"), order).select("cause_card_id", "copied_file_name", "position")


_PATHS = """p AS (SELECT CASE WHEN cause_row % 4 = 0 THEN source_bucket || '/' || cause_id || '.json' WHEN cause_row % 4 = 1 THEN source_bucket || '/x_' || cause_id || '_y.json' WHEN cause_row % 4 = 2 THEN 'far/away/z' || cause_id || '.json' ELSE 'other/' || cause_row || '.json' END AS path FROM cause_cards)"""


@query(f"""WITH {_PATHS}, r AS (SELECT DISTINCT cause_card_id AS id, split_part(cause_card_key, '/', 1) AS bug FROM feature_rows WHERE cause_card_id <> ''),
  c AS (SELECT id, bug, path, CASE WHEN path = bug || '/' || id || '.json' THEN 1 WHEN starts_with(path, bug || '/') THEN 2 ELSE 3 END AS tier FROM r JOIN p ON contains(split_part(path, '/', -1), id))
SELECT r.id AS cause_card_id, m.path AS card_path FROM r LEFT JOIN (SELECT id, bug, arg_min(path, {{'t': tier, 'p': path}}) AS path FROM c GROUP BY id, bug) m USING (id, bug)""")
def card_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The cause card file of every record: exact places first, then names that hold its id."""
    n, part = F.col("cause_row") % 4, F.concat
    path = F.when(n == 0, part("source_bucket", F.lit("/"), "cause_id", F.lit(".json"))).when(n == 1, part("source_bucket", F.lit("/x_"), "cause_id", F.lit("_y.json"))).when(n == 2, part(F.lit("far/away/z"), "cause_id", F.lit(".json"))).otherwise(part(F.lit("other/"), F.col("cause_row").cast("string"), F.lit(".json")))
    listing = table(spark, d, "cause_cards", "cause_row", "source_bucket", "cause_id").select(path.alias("path"))
    rows = table(spark, d, "feature_rows", "cause_card_id", F.substring_index("cause_card_key", "/", 1).alias("source_bug_id")).filter("cause_card_id <> ''").distinct()
    return ar.find_cause_cards(rows, listing).select("cause_card_id", "card_path")


@query("""SELECT big_bucket || '/crash_cards/small_bucket_rep/001__' || right(cluster_key, 8) || '.json' AS path, big_bucket AS bug_id, right(cluster_key, 8) AS hash_part, 'out/' || big_bucket || '/' || right(cluster_key, 8) || '.json' AS output
FROM (SELECT DISTINCT big_bucket, cluster_key FROM crash_cards WHERE big_bucket = split_part(cluster_key, '::', 1))""")
def card_tasks(spark: SparkSession, d: str) -> DataFrame:
    """The cause card that each representative's file is to become."""
    cards = table(spark, d, "crash_cards", "big_bucket", "cluster_key").filter(F.col("big_bucket") == F.substring_index("cluster_key", "::", 1)).distinct()
    paths = cards.select(F.concat(F.col("big_bucket"), F.lit("/crash_cards/small_bucket_rep/001__"), F.right("cluster_key", F.lit(8)), F.lit(".json")).alias("path"))
    return ar.card_tasks(paths, "out").select("path", "bug_id", "hash_part", "output")


@query("SELECT coalesce(bug_id, '') AS bug_id, coalesce(case_id, '') AS case_id, count(*) AS n_rows, count(DISTINCT coalesce(final_ground_truth_id, '')) AS labels FROM case_labels GROUP BY 1, 2")
def csv_labels(spark: SparkSession, d: str) -> DataFrame:
    """Label rows per case, written as CSV and read back as a ground truth file."""
    path = scratch(spark, "labels")
    sinks.write_table(table(spark, d, "case_labels", "bug_id", "case_id", "final_ground_truth_id"), path, ["bug_id", "case_id", "final_ground_truth_id"])
    truth = ar.ground_truth(spark, path)
    labels = truth.groupBy("bug_id", "case_id").agg(F.countDistinct("final_ground_truth_id").alias("labels"))
    return bk.label_counts(truth).withColumnRenamed("rows", "n_rows").join(labels, ["bug_id", "case_id"]).select("bug_id", "case_id", "n_rows", "labels")


@query("SELECT doc_id, left(sha256(text), 16) AS digest, source FROM documents")
def json_lines_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as JSON Lines in ASCII and read back."""
    path = scratch(spark, "documents")
    sinks.write_json_lines(table(spark, d, "documents", "doc_id", "text", "source"), path)
    get = lambda k, t: F.try_variant_get("doc", f"$.{k}", t)
    return ar.json_lines(spark, path).select(get("doc_id", "long").alias("doc_id"), tx.sha16(get("text", "string")).alias("digest"), get("source", "string").alias("source"))


@query("SELECT round(0.2 + 0.025 * i, 3)::DOUBLE AS threshold FROM range(41) t(i)")
def grid_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """The thresholds of the grid."""
    return spark.createDataFrame([(t,) for t in lk.thresholds()], "threshold double")


_SILHOUETTE = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e),
  d AS (SELECT a.vec_id AS i, a.label AS own, b.label AS l, sqrt(greatest(0, 2 - 2 * list_inner_product(a.v, b.v))) AS d, a.vec_id = b.vec_id AS self FROM u a JOIN u b ON true),
  m AS (SELECT i, own, l, sum(CASE WHEN self THEN 0 ELSE d END) AS s, count(*) AS n FROM d GROUP BY 1, 2, 3), x AS (SELECT i, max(CASE WHEN l = own THEN s / greatest(n - 1, 1) END) AS a, max(CASE WHEN l = own THEN n END) AS n, min(CASE WHEN l <> own THEN s / n END) AS b FROM m GROUP BY i)
SELECT (SELECT count(DISTINCT label) FROM u)::INT AS clusters, round((SELECT max(c) FROM (SELECT count(*) AS c FROM u GROUP BY label)) / (SELECT count(*) FROM u), 6) AS largest, round(avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 5) AS silhouette FROM x"""


@query(_SILHOUETTE)
def silhouette_given_labels(spark: SparkSession, d: str) -> DataFrame:
    """Silhouette of the embeddings' labels."""
    s = lk.internal_scores(table(spark, d, "embeddings", "label", F.col("embedding").alias("vector")), "label")
    return s.select(F.col("cluster_count_internal").alias("clusters"), F.round("largest_cluster_fraction", 6).alias("largest"), F.round("silhouette", 5).alias("silhouette"))


_GRID = """g AS (SELECT coalesce(true_label, 'none') AS block, vec_id::DOUBLE AS distance_threshold, (vec_id % 5)::INT AS cluster_count_internal, (vec_id % 3) / 4 AS largest_cluster_fraction, CASE WHEN vec_id % 4 = 0 THEN -1.0 ELSE (vec_id % 4) / 8 END AS silhouette,
  (vec_id % 4) / 4 AS f_measure, (vec_id % 2) / 2 AS purity, (vec_id % 7)::BIGINT AS cluster_count, 3::BIGINT AS label_count FROM vectors)"""


def _pseudo_grid(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("vec_id")
    return table(spark, d, "vectors", "vec_id", "true_label").select(
        F.coalesce("true_label", F.lit("none")).alias("block"), n.cast("double").alias("distance_threshold"), (n % 5).cast("int").alias("cluster_count_internal"), ((n % 3) / 4).alias("largest_cluster_fraction"),
        F.when(n % 4 == 0, -1.0).otherwise((n % 4) / 8).alias("silhouette"), ((n % 4) / 4).alias("f_measure"), ((n % 2) / 2).alias("purity"), (n % 7).alias("cluster_count"), F.lit(3).cast("long").alias("label_count"))


@query(f"""WITH {_GRID} SELECT block, distance_threshold FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY (silhouette > -1) DESC, CASE WHEN silhouette > -1 THEN silhouette END DESC,
  CASE WHEN silhouette > -1 THEN cluster_count_internal END, CASE WHEN silhouette > -1 THEN largest_cluster_fraction END, distance_threshold) AS r FROM g) WHERE r = 1""")
def silhouette_choice(spark: SparkSession, d: str) -> DataFrame:
    """The threshold chosen for every block by silhouette, ties and blocks without a valid one included."""
    return lk.select_by_silhouette(_pseudo_grid(spark, d)).select("block", "distance_threshold")


@query(f"""WITH {_GRID} SELECT block, distance_threshold FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY f_measure DESC, purity DESC, abs(cluster_count - label_count), distance_threshold) AS r FROM g) WHERE r = 1""")
def f_measure_choice(spark: SparkSession, d: str) -> DataFrame:
    """The threshold with the best agreement with the labels of every block, a diagnostic."""
    return lk.select_by_f_measure(_pseudo_grid(spark, d)).select("block", "distance_threshold")


_CUT_ITEMS = "(SELECT vec_id AS item, coalesce(true_label, 'None') AS label, CASE WHEN t = 0.5 THEN list_position(vector, list_max(vector))::VARCHAR ELSE '0' END AS cluster, coalesce(weight, 1.0)::DOUBLE AS w, t FROM vectors, (VALUES (0.5), (1.0)) x(t) WHERE vector IS NOT NULL)"


@query(f"""WITH i AS {_CUT_ITEMS}, c AS (SELECT t, label, cluster, sum(w) AS w, sum(w * w) AS q FROM i GROUP BY 1, 2, 3), n AS (SELECT t, sum(w) AS tw FROM i GROUP BY t),
  p AS (SELECT t, sum(m) AS p FROM (SELECT t, max(w) AS m FROM c GROUP BY t, cluster) GROUP BY t),
  h AS (SELECT t, sum((w * w - q) / 2) AS tp FROM c GROUP BY t), k AS (SELECT t, sum((s * s - q) / 2) AS c FROM (SELECT t, sum(w) AS s, sum(q) AS q FROM c GROUP BY t, cluster) GROUP BY t)
SELECT t::DOUBLE AS distance_threshold, round(p / tw, 5) AS purity, round(CASE WHEN c > 0 THEN tp / c ELSE 0 END, 5) AS pair_precision FROM p JOIN n USING (t) JOIN h USING (t) JOIN k USING (t)""")
def external_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Agreement with the labels at every threshold of a grid."""
    v = table(spark, d, "vectors", "vec_id", "vector", "true_label", "weight").filter("vector IS NOT NULL")
    ids = v.select(F.col("vec_id").cast("string").alias("id"), F.array_position("vector", F.array_max("vector")).cast("int").alias("pred"))
    pairs = F.collect_list(F.struct("id", "pred")).alias("labels")
    both = ids.select("id", F.lit(0.5).alias("distance_threshold"), "pred").unionByName(ids.select("id", F.lit(1.0).alias("distance_threshold"), F.lit(0).alias("pred")))
    grid = both.groupBy("distance_threshold").agg(pairs).withColumn("block", F.lit(""))  # a grid row holds its block's labels
    truth = v.select(F.col("vec_id").cast("string").alias("record_id"), "true_label", "weight")
    return lk.with_external_metrics(grid, truth).select("distance_threshold", F.round("purity", 5).alias("purity"), F.round("pair_precision", 5).alias("pair_precision"))
