"""Combining sources to target shares of all tokens, with capped repetition."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Vocabulary file of a public tokenizer; all executors must have it at this path.
TOKENIZER = os.path.join("/opt/tokenizers", "byte_bpe_50k.json")
#: Buckets of a source's seeded order; only the one in which the target falls is sorted by row.
BUCKETS = 4096


def token_counts(documents: DataFrame, path: str = TOKENIZER, batch: int = 512) -> DataFrame:
    """``doc_id, source, n_tokens`` of every document; null and empty texts have 0 tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        t.no_truncation()
        for b in batches:
            sizes: list[int] = []
            texts = b.column("text")
            for i in range(0, len(texts), batch):
                some = [x or "" for x in texts.slice(i, batch).to_pylist()]
                sizes += [len(e.ids) for e in t.encode_batch_fast(some, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(sizes, pa.int64())], ["doc_id", "source", "n_tokens"])

    return documents.select("doc_id", "source", "text").mapInArrow(count, "doc_id long, source string, n_tokens long")


def water_filling(shares: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Tokens per source: ``total`` split by share, no source above its cap, the excess given to the others by share.

    If all caps together are below ``total``, every source gets its cap. Sources with no share get nothing.
    """
    free = {s for s, w in shares.items() if w > 0}
    out = dict.fromkeys(shares, 0.0)
    left = min(total, sum(caps[s] for s in free))
    while free:
        weight = sum(shares[s] for s in free)
        full = {s for s in free if left * shares[s] / weight >= caps[s]}
        if not full:
            return out | {s: left * shares[s] / weight for s in free}
        for s in full:
            out[s] = caps[s]
        left -= sum(caps[s] for s in full)
        free -= full
    return out


def feasible_total(shares: dict[str, float], caps: dict[str, float]) -> float:
    """The largest total of which every source that has tokens can give its share within its cap; the shares of the others fall away."""
    weights = {s: w for s, w in shares.items() if w > 0 and caps[s] > 0}
    scale = sum(weights.values())
    return min((caps[s] * scale / w for s, w in weights.items()), default=0.0)


def mixing_plan(counts: DataFrame, targets: DataFrame, total: int | str | None = None) -> list[tuple]:
    """``source, target_share, max_repeats, available, planned`` per listed source; the list is as long as ``targets``.

    Rows of ``targets`` naming one source are added up (with the least cap); shares are scaled to a sum of 1; a null share is 0, a null
    cap 1, a negative one 0. Without ``total`` as many tokens are planned as the listed sources have; ``"feasible"`` plans as many as meet
    all shares (:func:`feasible_total`).
    """
    have = {r["source"]: r["n"] or 0 for r in counts.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    share: dict[str, float] = {}
    cap: dict[str, int] = {}
    for r in targets.filter("source is not null").collect():
        share[r["source"]] = share.get(r["source"], 0.0) + max(0.0, r["target_share"] or 0.0)
        times = 1 if r["max_repeats"] is None else max(0, r["max_repeats"])
        cap[r["source"]] = min(cap.get(r["source"], times), times)
    scale = sum(share.values()) or 1.0
    share = {s: w / scale for s, w in share.items()}
    caps = {s: float(cap[s] * have.get(s, 0)) for s in share}
    total = sum(have.get(s, 0) for s in share) if total is None else feasible_total(share, caps) if total == "feasible" else total
    planned = water_filling(share, caps, float(total))
    return [(s, share[s], cap[s], have.get(s, 0), planned[s]) for s in sorted(share)]


def mixture(documents: DataFrame, targets: DataFrame, total: int | str | None = None, seed: int = 7, path: str = TOKENIZER, label: str = "p9") -> tuple[DataFrame, DataFrame]:
    """The mixture ``doc_id, source, n_tokens, copies`` and its report
    ``source, target_share, max_repeats, available_tokens, planned_tokens, used_tokens, actual_share, epochs``.

    Each source is taken whole as many times as fit into its planned tokens, and once more in part: its documents in
    seeded hash order until the rest is reached, a document counting if at least half of it fits.
    The order is cut by sums over hash buckets; only the bucket in which the rest ends is ordered by row, so no source
    is ever sorted whole. Documents of unlisted or null sources are left out. The result is the same in every run.
    """
    spark = documents.sparkSession
    counts = materialize(token_counts(documents, path), f"{label}-tokens")
    plan = mixing_plan(counts, targets, total)
    rows = [(s, w, int(c), int(a), float(p), int(p // a) if a else 0, float(p - (p // a) * a) if a else 0.0) for s, w, c, a, p in plan]
    planned = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, available_tokens long, planned_tokens double, whole int, rest double")
    small = F.broadcast(planned.select("source", "whole", "rest"))
    ordered = counts.join(small, "source").withColumn("o", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.shiftrightunsigned("o", 52).cast("int"))
    sums = ordered.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n"))
    placed = ordered.join(F.broadcast(before.select("source", "bucket", "before", "n")), ["source", "bucket"])  # at most BUCKETS rows a listed source
    easy = placed.filter((F.col("before") + F.col("n") <= F.col("rest")) | (F.col("before") >= F.col("rest")))
    easy = easy.withColumn("more", (F.col("before") + F.col("n") <= F.col("rest")).cast("int"))
    edge = placed.filter((F.col("before") + F.col("n") > F.col("rest")) & (F.col("before") < F.col("rest")))
    so_far = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("more", (F.col("before") + so_far - F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
    mixed = easy.unionByName(edge).select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("more")).alias("copies")).filter("copies > 0")
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"))
    report = planned.join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    everything = report.agg(F.sum("used_tokens").alias("all"))
    shares = report.crossJoin(F.broadcast(everything)).select(
        "source",
        "target_share",
        "max_repeats",
        "available_tokens",
        F.round("planned_tokens").cast("long").alias("planned_tokens"),
        "used_tokens",
        F.when(F.col("all") > 0, F.col("used_tokens") / F.col("all")).otherwise(0.0).alias("actual_share"),
        F.when(F.col("available_tokens") > 0, F.col("used_tokens") / F.col("available_tokens")).otherwise(0.0).alias("epochs"),
    )
    return mixed, shares
