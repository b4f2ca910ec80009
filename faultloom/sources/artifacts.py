"""Reading crash directories, label and weight tables, cause cards, task lists, vectors and source trees."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.bitmaps import among, pieces_for
from ..session import materialize

#: Files of a crash directory and the columns they become.
FILES = {"crash_meta.json": "meta", "report.txt": "report", "kernel.config": "config", "machine_info.txt": "machine", "crash_log.txt": "crash_log", "repro.syz": "syz", "repro.c": "c_repro"}


def file_text(content: Column) -> Column:
    """Bytes of a file as text, undecodable ones replaced."""
    return F.make_valid_utf8(content.cast("string"))


def text_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path`` (below the root) and ``text`` of every file under a folder whose name matches a glob."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = re.escape(re.sub(r"^[a-z]+:/*", "/", root).rstrip("/"))
    return files.select(F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), f"^{base}/", "").alias("path"), file_text(F.col("content")).alias("text"))


def source_tree(spark: SparkSession, root: str, glob: str = "*.{c,h,S,rs}") -> DataFrame:
    """``path, text`` of a source tree's files, for the line table of the source search."""
    return text_files(spark, root, glob)


def crash_directories(spark: SparkSession, root: str, limit_bugs: int | None = None, limit_crashes_per_bug: int | None = None) -> DataFrame:
    """``bug_id, case_id`` and the texts of each ``<bug>/crashes/<case>`` folder; missing files are null.

    Limits take the first bugs and cases by name; the one on cases counts folders before those without metadata are
    dropped. The seven files of a folder meet in one aggregation.
    """
    found = text_files(spark, root, "{" + ",".join(FILES) + "}")
    at = r"(?:^|/)([^/]+)/crashes/([^/]+)/([^/]+)$"
    parts = found.filter(F.col("path").rlike(at)).select(*[F.regexp_extract("path", at, i).alias(n) for i, n in ((1, "bug_id"), (2, "case_id"), (3, "file"))], "text")
    cases = parts.groupBy("bug_id", "case_id").agg(*[F.max(F.when(F.col("file") == f, F.col("text"))).alias(c) for f, c in FILES.items()])
    if limit_bugs is not None:
        cases = cases.join(cases.select("bug_id").distinct().orderBy("bug_id").limit(limit_bugs), "bug_id", "left_semi")
    if limit_crashes_per_bug is not None:
        place = F.row_number().over(Window.partitionBy("bug_id").orderBy("case_id"))
        cases = cases.withColumn("_r", place).filter(F.col("_r") <= limit_crashes_per_bug).drop("_r")
    return cases.filter("meta IS NOT NULL")


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with header, all columns as text, empty fields as empty texts; a byte order mark is dropped."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("﻿")) for c in df.columns])


def ground_truth(spark: SparkSession, path: str | None) -> DataFrame:
    """Label rows ``bug_id, case_id, final_ground_truth_id, row_order``; without a path an empty table."""
    if path is None:
        return spark.createDataFrame([], "bug_id string, case_id string, final_ground_truth_id string, row_order long")
    df = csv_table(spark, path)
    return df.select("bug_id", "case_id", F.col("final_ground_truth_id") if "final_ground_truth_id" in df.columns else F.lit("").alias("final_ground_truth_id")).withColumn("row_order", F.monotonically_increasing_id())


def json_lines(spark: SparkSession, path: str, column: str = "doc") -> DataFrame:
    """Lines of a JSON Lines file as variants; blank lines are skipped, unparsable ones give null."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.try_parse_json("value").alias(column))


def json_documents(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """``path, doc`` of JSON files, one variant per file; unparsable files give null."""
    return text_files(spark, root, glob).select("path", F.try_parse_json("text").alias("doc"))


def npz_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``position, record_id, vector, true_label, weight, cause_card_id`` from compressed array files; absent arrays give null.

    Each file is read by one task, as the format allows no other way.
    """
    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for content in pdf["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as data:
                    v = np.asarray(data["vectors"], np.float32)
                    col = lambda k: data[k].tolist() if k in data else [None] * len(v)  # noqa: B023, E731
                    yield pd.DataFrame({"position": np.arange(len(v)), "record_id": col("record_ids"), "vector": list(v), "true_label": col("true_labels"), "weight": col("weights"), "cause_card_id": col("cause_card_ids")})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "position long, record_id string, vector array<float>, true_label string, weight float, cause_card_id string")


def in_cached_order(rows: DataFrame, order: DataFrame) -> DataFrame:
    """Rows with the ``position`` of a cached order of record ids; rows the order lacks are left out."""
    return rows.join(order.select("record_id", "position"), "record_id")


def task_list(spark: SparkSession, path: str) -> DataFrame:
    """Paths of a list file; blank lines and comments are skipped."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("path")).filter((F.col("path") != "") & ~F.col("path").startswith("#"))


def selected_cards(paths: DataFrame, listing: DataFrame, root: str = "") -> tuple[DataFrame, DataFrame]:
    """The ``path`` of listed cards that exist, and of those that do not; a relative path counts from ``root``.

    Paths may climb with ``..``; they are compared in their shortest form.
    """
    def resolved(p: Column) -> Column:
        full = F.when(p.rlike(r"^(/|[a-z][a-z0-9]*:)"), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/" if root else ""), p))
        step = lambda acc, s: F.when((s == "..") & (F.size(acc) > 1), F.slice(acc, F.lit(1), F.size(acc) - 1)).when(s.isin(".", "") & (F.size(acc) > 0), acc).otherwise(F.array_append(acc, s))
        return F.array_join(F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), step), "/")

    asked = paths.select(resolved(F.col("path")).alias("path"))
    have = listing.select(resolved(F.col("path")).alias("path")).distinct()
    return asked.join(have, "path", "left_semi"), asked.join(have, "path", "left_anti")


def card_tasks(paths: DataFrame, out_root: str, limit: int | None = None) -> DataFrame:
    """``path, bug_id, hash_part, output`` of crash card files: bug and hash name the cause card to be written.

    A limit takes the first paths by name; it counts tasks whether their output exists or not.
    """
    p = paths.orderBy("path").limit(limit) if limit is not None else paths
    folder = F.split(F.col("path"), "/")
    stem = F.regexp_replace(F.element_at(folder, -1), r"\.json$", "")
    bug = F.coalesce(F.nullif(F.regexp_extract("path", r"([^/]+)/crash_cards/", 1), F.lit("")), F.try_element_at(folder, F.lit(-2)))
    named = p.select("path", bug.alias("bug_id"), F.element_at(F.split(stem, "__"), -1).alias("hash_part"))
    return named.withColumn("output", F.concat_ws("/", F.lit(out_root), "bug_id", F.concat("hash_part", F.lit(".json"))))


def pending(tasks: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Tasks without a result yet: what a resumed run still has to do."""
    return tasks.join(done.select(*key).distinct(), key, "left_anti")


def manifest(tasks: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """All tasks with ``exists``: whether their result is there."""
    return tasks.join(done.select(*key).distinct().withColumn("_d", F.lit(True)), key, "left").withColumn("exists", F.col("_d").isNotNull()).drop("_d")


#: Characters of an id that are looked for in file names before the whole id is.
GRAM = 8


def _named_after(ids: DataFrame, files: DataFrame) -> DataFrame:
    """``_id, _bug, path``: for every id and folder (``_bug``), the first of the folder's files whose name holds the id.

    An id's first characters (``GRAM``, or all of a shorter one) are looked for at every place of a name, the whole id only where
    they are found. Bitmaps of 16 bits a text tell what may be found, so few other pieces of names are shuffled; the
    caller compares whole ids. Names that hold an id become one row a folder, however many ids and names begin alike.
    """
    counts = ids.select("_id").distinct().groupBy(F.length("_id").alias("n")).count().collect()  # a row for each length of an id
    if not counts:
        return ids.select("_id", "_bug", F.lit(None).cast("string").alias("path")).limit(0)
    lengths = sorted(r["n"] for r in counts)
    ints = lambda values: F.array(*[F.lit(n) for n in values]).cast("array<int>")
    first = ids.select(F.left("_id", F.lit(GRAM)).alias("first")).distinct()
    starts = files.select("*", F.explode(ints(sorted({min(n, GRAM) for n in lengths}))).alias("_n")).filter(F.length("_stem") >= F.col("_n"))
    starts = starts.select("*", F.explode(F.sequence(F.lit(1), F.length("_stem") - F.col("_n") + 1)).alias("_at"))
    starts = among(starts, F.substring("_stem", F.col("_at"), F.col("_n")), first.select(F.xxhash64("first").alias("k")), pieces_for(4 * first.count()))
    sizes = F.when(F.col("_n") < GRAM, F.array("_n")).otherwise(ints(n for n in lengths if n >= GRAM))
    whole = starts.select("_bug", "path", "_stem", "_at", F.explode(sizes).alias("_n")).filter(F.length("_stem") >= F.col("_at") + F.col("_n") - 1)
    whole = whole.select("_bug", "path", F.substring("_stem", F.col("_at"), F.col("_n")).alias("_id"))
    found = among(whole, F.col("_id"), ids.select(F.xxhash64("_id").alias("k")), pieces_for(4 * sum(r["count"] for r in counts)))
    return found.groupBy("_id", "_bug").agg(F.min("path").alias("path"))


def find_cause_cards(weights: DataFrame, listing: DataFrame) -> DataFrame:
    """Adds ``card_path`` to weight rows: the first of the places in which a row's cause card may lie, null if none.

    Four exact places come first, then files of the bug's folder whose name holds the id, then files anywhere; within a
    tier the first by name. All are joins by equal keys (:func:`_named_after`); names are matched only for rows still without
    a card. Rows are told apart by a hash of what they are looked up by, so equal rows share a card. Joins are by sorting: sizes
    of pieces of names and of narrow columns are estimated far too low, and a table taken for small would be broadcast.
    """
    c = lambda k: F.coalesce(F.col(k), F.lit("")) if k in weights.columns else F.lit("")
    ident = F.coalesce(F.nullif(c("cause_card_id"), F.lit("")), F.nullif(c("small_bucket_cluster_id"), F.lit("")), c("cause_card_file_stem"))
    asked = [c(k) for k in ("directory_name", "copied_file_name", "source_bug_id", "small_bucket_cluster_id")]
    rows = weights.withColumn("_id", ident).withColumn("_row", F.unhex(F.sha2(F.to_json(F.array("_id", *asked)), 256))).withColumn("_bug", c("source_bug_id"))
    json = lambda x: F.concat(x, F.lit(".json"))
    places = F.array(F.concat_ws("/", c("directory_name"), c("copied_file_name")), F.concat_ws("/", "_bug", json(F.col("_id"))), F.concat_ws("/", "_bug", json(c("small_bucket_cluster_id"))), c("copied_file_name"))
    exact = rows.select("_row", F.posexplode(places).alias("tier", "path")).filter((F.col("path") != "") & ~F.col("path").endswith("/"))
    hit = exact.join(listing.select("path").distinct().hint("merge"), "path").groupBy("_row").agg(F.min_by("path", F.struct("tier", "path")).alias("card_path"))
    hit = materialize(hit, "cards-exact")
    rest = rows.filter("_id <> ''").select("_row", "_id", "_bug").join(hit.select("_row").hint("merge"), "_row", "left_anti").distinct()
    rest = materialize(rest, "cards-open")
    files = listing.select("path", F.regexp_replace("path", r"/?[^/]*$", "").alias("_bug"), F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("_stem"))
    held = materialize(_named_after(rest, files), "cards-named")
    near = held.filter("_bug <> ''").withColumnRenamed("path", "near")
    far = held.groupBy("_id").agg(F.min("path").alias("far"))
    found = rest.join(near.hint("merge"), ["_id", "_bug"], "left").join(far.hint("merge"), "_id", "left").select("_row", F.coalesce("near", "far").alias("card_path"))
    return rows.join(hit.unionByName(found).hint("merge"), "_row", "left").drop("_row", "_id", "_bug")
