"""Schemas that drift between files: lifespans of fields, a log of changes, one consistent table."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

_FENCE = re.compile(r"```[A-Za-z]*\s*(\{.*\})\s*```", re.S)


def readable_card(body: str | None) -> dict | None:
    """The card in a text: the whole text, a fenced block or the outermost braces. None if there is none.

    A card is a JSON object with a ``cause_id`` string.
    """
    if not body:
        return None
    tries = [body]
    if (m := _FENCE.search(body)) is not None:
        tries.append(m.group(1))
    a, b = body.find("{"), body.rfind("}")
    if 0 <= a < b:
        tries.append(body[a : b + 1])
    for text in tries:
        try:
            found = json.loads(text)
        except (ValueError, RecursionError):
            continue
        return found if isinstance(found, dict) and isinstance(found.get("cause_id"), str) else None
    return None


def _kind(v: object) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int | float):
        return "number"
    if isinstance(v, str):
        return "string"
    if isinstance(v, dict):
        return "object"
    inner = {_kind(x) for x in _flat(v)}
    return f"array<{'|'.join(sorted(inner))}>" if inner else "array"


def _flat(v: list) -> Iterator[object]:
    """Non-null entries of a list, nested lists opened."""
    for x in v:
        if isinstance(x, list):
            yield from _flat(x)
        elif x is not None:
            yield x


def paths_of(card: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """Every non-null member as its path (names joined by dots, list levels unnamed) and value; once per list entry."""
    stack = [(prefix, card)]
    while stack:
        before, obj = stack.pop()
        for name, v in obj.items():
            if v is None:
                continue
            yield before + name, v
            if isinstance(v, dict):
                stack.append((before + name + ".", v))
            elif isinstance(v, list):
                stack += [(before + name + ".", x) for x in _flat(v) if isinstance(x, dict)]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct ``producer, file_seq, path, type`` of each batch."""
    for b in batches:
        seen = set()
        for producer, seq, body in zip(*(b.column(c).to_pylist() for c in ("producer", "file_seq", "body")), strict=True):
            card = readable_card(body)
            if card is not None:
                seen.update((producer, seq, path, _kind(v)) for path, v in paths_of(card))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*seen, strict=True), (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], ["producer", "file_seq", "path", "type"])


def file_catalogue(bodies: DataFrame) -> DataFrame:
    """``producer, file_no, file_seq, path, type``: what each file's metadata would say of its fields.

    ``bodies`` has ``producer, file_seq, body``. Every batch reduces its cards to their distinct paths and
    types, so what is shuffled grows with the files' fields, not with their rows. ``file_no`` numbers the files of a
    producer that have any readable card. A path with several types in one file has them joined by ``|``;
    an array of which only empty ones are seen has the type ``array`` and fits any array.
    """
    per_file = bodies.select("producer", "file_seq", "body").mapInArrow(_parse, "producer string, file_seq int, path string, type string")
    typed = per_file.groupBy("producer", "file_seq", "path").agg(F.collect_set("type").alias("types"))
    known = F.filter("types", lambda t: t != "array")
    kept = typed.select("producer", "file_seq", "path", F.array_join(F.array_sort(F.when(F.size(known) > 0, known).otherwise(F.col("types"))), "|").alias("type"))
    files = kept.select("producer", "file_seq").distinct()
    numbered = files.withColumn("file_no", F.row_number().over(Window.partitionBy("producer").orderBy("file_seq")))
    last = Window.partitionBy("producer", "path").orderBy("file_no")
    # An array seen only empty takes the type of the path's file before, if that is an array.
    joined = kept.join(numbered, ["producer", "file_seq"])
    filled = F.when(F.col("type") != "array", F.col("type"))
    before = F.last(filled, ignorenulls=True).over(last)
    after = F.first(filled, ignorenulls=True).over(last.rowsBetween(0, Window.unboundedFollowing))
    array_of = [F.when(c.startswith("array"), c) for c in (before, after)]
    return joined.withColumn("type", F.coalesce(filled, *array_of, F.col("type"))).select("producer", "file_no", "file_seq", "path", "type")


def lifespans(catalogue: DataFrame) -> DataFrame:
    """``producer, path, type, first_no, last_no``: unbroken stretches of files in which a producer's path has a type.

    Islands: a file whose number does not follow that of the file before with the same producer, path and type
    starts a new stretch.
    """
    w = Window.partitionBy("producer", "path", "type").orderBy("file_no")
    starts = catalogue.withColumn("starts", F.coalesce((F.col("file_no") - F.lag("file_no").over(w)) > 1, F.lit(True)).cast("int"))
    return starts.withColumn("island", F.sum("starts").over(w)).groupBy("producer", "path", "type", "island").agg(F.min("file_no").alias("first_no"), F.max("file_no").alias("last_no")).drop("island")


def _boundaries(catalogue: DataFrame) -> DataFrame:
    """``producer, file_no, path, began, ended``: types that start or end at a file, compared with the file before."""
    spans = lifespans(catalogue)
    ends = catalogue.groupBy("producer").agg(F.max("file_no").alias("files"))
    began = spans.filter("first_no > 1").select("producer", F.col("first_no").alias("file_no"), "path", F.col("type").alias("began"), F.lit(None).cast("string").alias("ended"))
    ended = spans.join(ends, "producer").filter("last_no < files").select("producer", (F.col("last_no") + 1).alias("file_no"), "path", F.lit(None).cast("string").alias("began"), F.col("type").alias("ended"))
    return began.unionByName(ended).groupBy("producer", "file_no", "path").agg(F.max("began").alias("began"), F.max("ended").alias("ended"))


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, r"\.?[^.]*$", "")


def _wanted_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``producer, file_no, cause_id, path, digest`` of the wanted paths of each card."""
    for b in batches:
        out = []
        for producer, no, wanted, body in zip(*(b.column(c).to_pylist() for c in ("producer", "file_no", "wanted", "body")), strict=True):
            card = readable_card(body)
            if card is None:
                continue
            values: dict[str, list] = {}
            asked = set(wanted)
            for path, v in paths_of(card):
                if path in asked:
                    values.setdefault(path, []).append(v)
            out += [(producer, no, card["cause_id"], p, xxhash.xxh64_intdigest(json.dumps(v, sort_keys=True)) - (1 << 63)) for p, v in values.items()]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)],
                ["producer", "file_no", "cause_id", "path", "digest"],
            )


def renames(bodies: DataFrame, catalogue: DataFrame, boundaries: DataFrame) -> DataFrame:
    """``producer, file_no, old_path, new_path``: a path that ended and one that began under the same parent with equal values.

    Only the files that have such candidates are read again, and only the candidates' values leave them. Values
    are equal if every card (by ``cause_id``) that has both in the two files has the same in both, and at least one
    does. Of several matches the one with the most cards counts, then the first by name; each path is used once.
    """
    parent = boundaries.withColumn("parent", _parent(F.col("path")))
    gone = parent.filter("began IS NULL").select("producer", "file_no", "parent", F.col("path").alias("old_path"))
    new = parent.filter("ended IS NULL").select("producer", "file_no", "parent", F.col("path").alias("new_path"))
    pairs = gone.join(new, ["producer", "file_no", "parent"])
    wanted = (
        pairs.select("producer", (F.col("file_no") - 1).alias("file_no"), F.col("old_path").alias("path"))
        .unionByName(pairs.select("producer", "file_no", F.col("new_path").alias("path")))
        .groupBy("producer", "file_no")
        .agg(F.collect_set("path").alias("wanted"))
    )
    files = catalogue.select("producer", "file_seq", "file_no").distinct().join(wanted, ["producer", "file_no"])
    values = (
        bodies.select("producer", "file_seq", "body")
        .join(files, ["producer", "file_seq"])
        .select("producer", "file_no", "wanted", "body")
        .mapInArrow(_wanted_values, "producer string, file_no int, cause_id string, path string, digest long")
        .groupBy("producer", "file_no", "cause_id", "path")
        .agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    )
    old = values.select("producer", (F.col("file_no") + 1).alias("file_no"), "cause_id", F.col("path").alias("old_path"), F.struct("low", "high").alias("a"))
    now = values.select("producer", "file_no", "cause_id", F.col("path").alias("new_path"), F.struct("low", "high").alias("b"))
    both = old.join(pairs, ["producer", "file_no", "old_path"]).join(now, ["producer", "file_no", "cause_id", "new_path"])
    equal = both.groupBy("producer", "file_no", "old_path", "new_path").agg(F.count(F.lit(1)).alias("n"), F.min((F.col("a") == F.col("b")).cast("int")).alias("same")).filter("same = 1")
    best_new = F.row_number().over(Window.partitionBy("producer", "file_no", "old_path").orderBy(F.desc("n"), "new_path"))
    best_old = F.row_number().over(Window.partitionBy("producer", "file_no", "new_path").orderBy(F.desc("n"), "old_path"))
    return equal.withColumn("r", best_new).filter("r = 1").withColumn("q", best_old).filter("q = 1").select("producer", "file_no", "old_path", "new_path")


def drift_log(bodies: DataFrame) -> DataFrame:
    """``producer, file_seq, field_path, drift_kind, new_path``: each file's changes against its producer's file before.

    Kinds are ``renamed`` (see :func:`renames`), ``retyped``, ``added`` and ``removed``; ``new_path`` is empty but for renames.
    Nothing below a path that is itself listed (under its old or new name) is listed. Unreadable bodies
    and repeated lines change nothing; a producer's first file and producers with one file have no changes; an empty
    table has none. Catalogue and boundaries grow with files and fields only.
    """
    catalogue = materialize(file_catalogue(bodies), "p6-catalogue")
    marks = materialize(_boundaries(catalogue), "p6-boundaries")
    moved = materialize(renames(bodies, catalogue, marks), "p6-renames")
    olds = moved.select("producer", "file_no", F.col("old_path").alias("path"), "new_path")
    news = moved.select("producer", "file_no", F.col("new_path").alias("path"), F.lit(True).alias("is_new"))
    kind = F.when(F.col("new_path").isNotNull(), "renamed").when(F.col("began").isNotNull() & F.col("ended").isNotNull(), "retyped").when(F.col("began").isNotNull(), "added").otherwise("removed")
    listed = (
        marks.join(olds, ["producer", "file_no", "path"], "left")
        .join(news, ["producer", "file_no", "path"], "left")
        .select("producer", "file_no", "path", kind.alias("drift_kind"), F.coalesce("new_path", F.lit("")).alias("new_path"), F.coalesce("is_new", F.lit(False)).alias("is_new"))
    )
    depth = F.size(F.split("path", r"\."))
    above = listed.select("producer", "file_no", "path", "drift_kind", "new_path", "is_new", F.explode(F.when(depth > 1, F.sequence(F.lit(1), depth - 1)).otherwise(F.array())).alias("n"))
    above = above.withColumn("up", F.array_join(F.slice(F.split("path", r"\."), F.lit(1), F.col("n")), "."))
    under = above.join(listed.select("producer", "file_no", F.col("path").alias("up")), ["producer", "file_no", "up"], "left_semi").select("producer", "file_no", "path").distinct()
    kept = listed.filter("not is_new").join(under, ["producer", "file_no", "path"], "left_anti")
    files = catalogue.select("producer", "file_no", "file_seq").distinct()
    return kept.join(files, ["producer", "file_no"]).select("producer", "file_seq", F.col("path").alias("field_path"), "drift_kind", "new_path")


_TYPES = re.compile(r"array<[^>]*>|[^|]+")


def alias_tree(used: dict[str, tuple[int, set[str]]], moves: list[tuple[str, str]]) -> tuple[dict[str, str], dict[str, dict]]:
    """Canonical path of every path, and of each canonical path its layout: ``names`` (most used first), ``members``, ``array``, ``kinds``, ``text``.

    ``used`` has the number of files and the types of every path, ``moves`` the renames at any depth. Goes from the top
    down: paths whose parents share a field share one themselves if they have one name or a rename links them.
    """
    def parent(p: str) -> str:
        while "." in p:
            p = p.rsplit(".", 1)[0]
            if p in used:
                return p
        return ""

    canon: dict[str, str] = {"": ""}
    layout: dict[str, dict] = {"": {"members": {}}}
    levels: dict[int, list[str]] = {}
    depth = {"": 0}
    for p in sorted(used, key=len):
        depth[p] = depth[parent(p)] + 1
        levels.setdefault(depth[p], []).append(p)
    for level in sorted(levels):
        name = {p: p[len(parent(p)) + 1 :] if parent(p) else p for p in levels[level]}
        key = {p: (canon[parent(p)], name[p]) for p in levels[level]}
        root = {k: k for k in key.values()}

        def find(k: tuple) -> tuple:
            while root[k] != k:
                k = root[k]
            return k

        for old, new in moves:
            if old in key and new in key and key[old][0] == key[new][0]:
                root[find(key[old])] = find(key[new])
        files: dict[tuple, int] = {}
        for p, k in key.items():
            files[k] = files.get(k, 0) + used[p][0]
        groups: dict[tuple, list[tuple]] = {}
        for k in files:
            groups.setdefault(find(k), []).append(k)
        for keys in groups.values():
            keys.sort(key=lambda k: (-files[k], k[1]))
            above, first = keys[0]
            path = f"{above}.{first}" if above else first
            paths = [p for p, k in key.items() if k in keys]
            canon |= dict.fromkeys(paths, path)
            types = {t for p in paths for joined in used[p][1] for t in _TYPES.findall(joined)}
            plain = {t for t in types if not t.startswith("array")}
            inner = {k for t in types if t.startswith("array<") for k in t[6:-1].split("|")}
            text = bool(inner) and "object" not in plain | inner and not plain <= inner
            layout[path] = {"names": [k[1] for k in keys], "extra": [], "members": {}, "array": not text and len(plain) < len(types), "kinds": {"string", *plain, *inner} if text else plain | inner, "text": text}
            layout[above]["members"][first] = path
    return canon, layout


def _leaf(v: object, kinds: set[str]) -> object:
    if isinstance(v, str) or len(kinds) == 1:
        return v
    return json.dumps(v)


def unified(v: object, path: str, layout: dict[str, dict]) -> object:
    """A value in its field's layout: single values of array fields wrapped, members renamed, absent ones null, leaves of mixed types as text.

    Where a field has objects, a plain value becomes an object's member ``value``; nested lists are opened. Where plain
    values and lists of other plain values meet, all are text.
    """
    node = layout[path]
    if node["text"]:
        return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    scalars = node["kinds"] - {"object"}

    def one(x: object) -> object:
        if "object" not in node["kinds"]:
            return _leaf(x, scalars)
        out = dict.fromkeys(sorted(field_names(path, layout)))
        if scalars:
            out.setdefault("value", None)
        if not isinstance(x, dict):
            below = node["members"].get("value")
            out["value"] = unified(x, below, layout) if below else _leaf(x, scalars)
            return out
        return out | members_of(x, path, layout)

    if node["array"]:
        return [one(x) for x in (_flat(v) if isinstance(v, list) else [v])]
    return one(v)


def field_names(path: str, layout: dict[str, dict]) -> dict[str, str]:
    """The fields an object may have, each with the path of its layout: its members, and aliases of them that some card has at once."""
    out = {}
    for name, below in layout[path]["members"].items():
        out[name] = below
        out.update(dict.fromkeys(layout[below]["extra"], below))
    return out


def members_of(card: dict, path: str, layout: dict[str, dict]) -> dict[str, object]:
    """The members an object has, by canonical name; of several aliases at once the first takes that name and the others keep theirs."""
    out = {}
    for name, below in layout[path]["members"].items():
        present = [a for a in layout[below]["names"] if card.get(a) is not None]
        for field, alias in zip([name, *present[1:]], present, strict=False):
            out[field] = unified(card[alias], below, layout)
    return out


def consistent_table(bodies: DataFrame) -> DataFrame:
    """Every readable card as one row ``raw_id, producer, file_seq`` and a column ``card_<field>`` per consistent field.

    Aliases and layouts hold at every depth (:func:`alias_tree`, :func:`unified`) and come from one row per distinct path and
    rename, metadata that does not grow with rows. A field that is a number or a boolean everywhere is a double or boolean
    column; any other is text, JSON in one layout for lists and objects. Absent and null members give null. Unreadable bodies
    give no row. Where a card has a field under two of its names, each keeps its own column. Names that differ in case only get a number, as columns do not differ by case.
    """
    catalogue = materialize(file_catalogue(bodies), "p6-catalogue")
    moved = materialize(renames(bodies, catalogue, materialize(_boundaries(catalogue), "p6-boundaries")), "p6-renames")
    used = {r["path"]: (r["n"], set(r["types"])) for r in catalogue.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.collect_set("type").alias("types")).collect()}
    moves = sorted((r["old_path"], r["new_path"]) for r in moved.select("old_path", "new_path").distinct().collect())
    canon, layout = alias_tree(used, moves)
    # Fields of which a file has several names at once get a field for each further name.
    named = bodies.sparkSession.createDataFrame([(p, c) for p, c in canon.items() if p], "path string, field string")
    both = catalogue.join(F.broadcast(named), "path").groupBy("producer", "file_no", "field").agg(F.countDistinct("path").alias("n")).filter("n > 1").select("field").distinct()
    for r in both.collect():
        layout[r["field"]]["extra"] = layout[r["field"]]["names"][1:]
    whole = field_names("", layout)
    fields, columns = sorted(whole), []
    for f in fields:
        name, n = f"card_{f}", 1
        while name.lower() in {c.lower() for c, _ in columns}:
            n += 1
            name = f"card_{f}_{n}"
        node = layout[whole[f]]
        columns.append((name, "string" if node["array"] else {frozenset({"number"}): "double", frozenset({"boolean"}): "boolean"}.get(frozenset(node["kinds"]), "string")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
        for b in batches:
            cards = [readable_card(x) for x in b.column("body").to_pylist()]
            kept = pa.array([c is not None for c in cards])
            flat = [members_of(c, "", layout) for c in cards if c is not None]
            ids = [b.column(c).filter(kept) for c in ("raw_id", "producer", "file_seq")]
            cells = []
            for f, (_, kind) in zip(fields, columns, strict=True):
                values = [x.get(f) for x in flat]
                if kind == "double":
                    values = [None if v is None else float(v) for v in values]
                elif kind == "string":
                    values = [v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in values]
                cells.append(pa.array(values, arrow[kind]))
            yield pa.RecordBatch.from_arrays([*ids, *cells], ["raw_id", "producer", "file_seq", *[c for c, _ in columns]])

    schema = T.StructType([T.StructField("raw_id", T.LongType()), T.StructField("producer", T.StringType()), T.StructField("file_seq", T.IntegerType())])
    for c, kind in columns:
        schema = schema.add(c, kind)
    return bodies.select("raw_id", "producer", "file_seq", "body").mapInArrow(rows, schema)
