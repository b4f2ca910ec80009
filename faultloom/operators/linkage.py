"""Average-linkage clustering over a grid of distance thresholds, chosen by silhouette."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import pairwise_counts, weighted_purity_f

#: Most vectors of one block: a task holds their distance matrix.
BLOCK_LIMIT = 20_000
GRID = "distance_threshold double, cluster_count_internal int, largest_cluster_fraction double, silhouette double"


def thresholds() -> list[float]:
    """0.2 to 1.2 by 0.025."""
    return [round(0.2 + 0.025 * i, 3) for i in range(41)]


def distances(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1)
    x = x / np.where(norm == 0, 1, norm)[:, None]
    sq = (x * x).sum(1)
    d = np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    return d


def dendrogram(dist: np.ndarray) -> np.ndarray:
    """Merges ``(a, b, height)`` of average linkage, by chains of nearest neighbours, in the order of their heights.

    ``a`` and ``b`` are any members of the merged groups.
    """
    n = len(dist)
    d = dist.astype(np.float64).copy()
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    merges, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            b = int(d[a].argmin())
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        a, b = chain.pop(), chain.pop()
        keep, gone = min(a, b), max(a, b)
        merges.append((keep, gone, d[a, b]))
        row = (size[keep] * d[keep] + size[gone] * d[gone]) / (size[keep] + size[gone])
        d[keep], d[:, keep] = row, row
        d[gone], d[:, gone], d[keep, keep] = np.inf, np.inf, np.inf
        size[keep] += size[gone]
        alive[gone] = False
    out = np.array(merges, dtype=np.float64).reshape(-1, 3)
    return out[np.argsort(out[:, 2], kind="stable")]


def cut(merges: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Labels when only merges below the threshold are made: for each item the number of its group's first item."""
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b, h in merges:
        if h >= threshold:
            break
        x, y = root(int(a)), root(int(b))
        parent[max(x, y)] = min(x, y)
    return np.array([root(i) for i in range(n)])


def silhouette(dist: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette; items alone in their cluster count 0; -1 unless there are between 2 and n - 1 clusters."""
    names, code = np.unique(labels, return_inverse=True)
    k, n = len(names), len(labels)
    if not 1 < k < n:
        return -1.0
    order = np.argsort(code, kind="stable")
    sums = np.add.reduceat(dist[:, order], np.flatnonzero(np.diff(code[order], prepend=-1)), axis=1)
    count = np.bincount(code)
    own = count[code]
    a = sums[np.arange(n), code] / np.maximum(own - 1, 1)
    mean = sums / count
    mean[np.arange(n), code] = np.inf
    b = mean.min(1)
    return float(np.where(own > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0).mean())


def threshold_grid(df: DataFrame, block: str | None = None, id_column: str = "record_id", vector: str = "vector", at: list[float] | None = None) -> DataFrame:
    """Per block and threshold: ``distance_threshold, cluster_count_internal, largest_cluster_fraction, silhouette`` and ``labels``.

    ``labels`` holds ``id, pred`` pairs, ``pred`` being the smallest position of a cluster when ids are sorted. One
    dendrogram per block is cut at every threshold. Vectors are compared at unit length; ids are sorted first, so the result
    does not depend on partitioning. A block's distance matrix lives in one task: blocks of more than ``BLOCK_LIMIT`` vectors
    are refused and need a finer ``block`` column (such as the similarity cluster of each vector). Without ``block`` all
    rows form one.
    """
    at = at or thresholds()
    source = df.withColumn("_block", F.col(block).cast("string") if block else F.lit(""))

    large = source.groupBy("_block").count().filter(F.col("count") > BLOCK_LIMIT).limit(1).collect()  # before any task gets a block
    if large:
        raise ValueError(f"block {large[0]['_block']!r} has {large[0]['count']} vectors; at most {BLOCK_LIMIT} can be linked in one task")

    def grid(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_column)
        dist = distances(np.stack(pdf[vector].to_numpy()).astype(np.float64))
        merges, ids, out = dendrogram(dist), pdf[id_column].astype(str).tolist(), []
        for t in at:
            labels = cut(merges, len(ids), t)
            count = np.bincount(labels)
            pairs = [{"id": i, "pred": int(p)} for i, p in zip(ids, labels, strict=True)]
            out.append((pdf["_block"].iloc[0], t, int((count > 0).sum()), float(count.max() / len(ids)), silhouette(dist, labels), pairs))
        return pd.DataFrame(out, columns=["block", "distance_threshold", "cluster_count_internal", "largest_cluster_fraction", "silhouette", "labels"])

    return source.select("_block", id_column, vector).groupBy("_block").applyInPandas(grid, f"block string, {GRID}, labels array<struct<id:string,pred:int>>")


def grid_assignments(grid: DataFrame) -> DataFrame:
    """``block, distance_threshold, record_id, pred``: one row per item and threshold."""
    return grid.select("block", "distance_threshold", F.inline("labels")).withColumnRenamed("id", "record_id")


def with_external_metrics(grid: DataFrame, truth: DataFrame) -> DataFrame:
    """Grid rows with purity, F and pair measures against ``record_id, true_label, weight``; labels take no part in the clustering."""
    items = grid_assignments(grid).join(truth, "record_id").select("block", "distance_threshold", F.col("record_id").alias("item"), F.col("true_label").alias("label"), "pred", "weight")
    keys = ["block", "distance_threshold"]
    return grid.drop("labels").withColumn("algorithm", F.lit("agglomerative")).join(weighted_purity_f(items, keys), keys).join(pairwise_counts(items, keys), keys)


def _first(grid: DataFrame, order: list) -> DataFrame:
    return grid.withColumn("_r", F.row_number().over(Window.partitionBy("block").orderBy(*order, "distance_threshold"))).filter("_r = 1").drop("_r")


def select_by_silhouette(grid: DataFrame) -> DataFrame:
    """The grid row of each block with the best silhouette; ties by fewer clusters, then the smaller largest cluster, then the lower threshold.

    Only rows with more than one cluster and fewer clusters than items count; if there are none, the first threshold's row.
    """
    valid = (F.col("silhouette") > -1).cast("int")
    return _first(grid, [valid.desc(), F.when(valid == 1, F.col("silhouette")).desc(), F.when(valid == 1, F.col("cluster_count_internal")), F.when(valid == 1, F.col("largest_cluster_fraction"))])


def select_by_f_measure(grid: DataFrame) -> DataFrame:
    """The row with the best F (a diagnostic that sees the labels); ties by purity, then by nearness to the number of labels."""
    return _first(grid, [F.desc("f_measure"), F.desc("purity"), F.abs(F.col("cluster_count") - F.col("label_count"))])


def internal_scores(df: DataFrame, label: str, block: str | None = None, vector: str = "vector") -> DataFrame:
    """``block, cluster_count_internal, largest_cluster_fraction, silhouette`` of given labels, per block; null labels are one cluster.

    A block's distance matrix lives in one task, so blocks of more than ``BLOCK_LIMIT`` vectors are refused.
    """
    source = df.select((F.col(block).cast("string") if block else F.lit("")).alias("block"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label"), F.col(vector).alias("vector")).filter("vector IS NOT NULL")
    large = source.groupBy("block").count().filter(F.col("count") > BLOCK_LIMIT).limit(1).collect()
    if large:
        raise ValueError(f"block {large[0]['block']!r} has {large[0]['count']} vectors; at most {BLOCK_LIMIT} can be compared in one task")

    def scores(pdf: pd.DataFrame) -> pd.DataFrame:
        dist = distances(np.stack(pdf["vector"].to_numpy()).astype(np.float64))
        count = pdf["label"].value_counts()
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "cluster_count_internal": len(count), "largest_cluster_fraction": count.max() / len(pdf), "silhouette": silhouette(dist, pdf["label"].to_numpy())})

    return source.groupBy("block").applyInPandas(scores, "block string, cluster_count_internal int, largest_cluster_fraction double, silhouette double")
