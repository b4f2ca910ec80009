"""Weighted agreement of a clustering with labels, for any number of clusterings at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def noise_as_singletons(pred: Column, item: Column) -> Column:
    """Cluster names in which every ``-1`` item is a cluster of its own."""
    name = pred.cast("string")
    return F.when(name == "-1", F.concat(F.lit("noise:"), item.cast("string"))).otherwise(name)


def _cells(df: DataFrame, by: Sequence[str], split_noise: bool) -> DataFrame:
    cluster = noise_as_singletons(F.col("pred"), F.col("item")) if split_noise else F.col("pred").cast("string")
    w = F.coalesce("weight", F.lit(1.0)).cast("double")
    rows = df.select(*by, F.coalesce(F.col("label").cast("string"), F.lit("None")).alias("label"), cluster.alias("cluster"), w.alias("w"), (F.col("pred").cast("string") == "-1").alias("noise"))
    return rows.groupBy(*by, "label", "cluster").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("w2"), F.count(F.lit(1)).alias("n"), F.count_if("noise").alias("noisy"), F.sum(F.when(F.col("noise"), F.col("w")).otherwise(0.0)).alias("noise_w"))


def _joined(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b, list(keys)) if keys else a.crossJoin(b)  # without keys both have one row


def weighted_purity_f(df: DataFrame, by: Sequence[str] = (), split_noise: bool = True) -> DataFrame:
    """Purity, inverse purity and F of ``item, label, pred, weight`` rows, per group of ``by``.

    Works on the table of weights per label and cluster, two maxima over it and two totals joined to it; rows
    are aggregated once. Null weights count as 1, null labels as one label. Groups whose weights sum to 0 or
    less have null measures (a caller may refuse them with :func:`require_weight`).
    """
    by = list(by)
    cells = _cells(df, by, split_noise)
    labels = cells.groupBy(*by, "label").agg(F.sum("w").alias("label_w"))
    clusters = cells.groupBy(*by, "cluster").agg(F.sum("w").alias("cluster_w"), F.greatest(F.max("w"), F.lit(0.0)).alias("best_w"))
    full = cells.join(labels, [*by, "label"]).join(clusters, [*by, "cluster"]).filter("w > 0")
    precision, recall = F.col("w") / F.col("cluster_w"), F.col("w") / F.col("label_w")
    per_label = full.groupBy(*by, "label").agg(F.max("label_w").alias("label_w"), F.max(recall).alias("r"), F.max(2 * precision * recall / (precision + recall)).alias("f"))
    total = cells.groupBy(*by).agg(F.sum("w").alias("total_weight"), F.countDistinct("cluster").alias("cluster_count"), F.countDistinct("label").alias("label_count"), F.sum("n").alias("item_count"), F.sum("noisy").alias("raw_noise_count"), F.sum("noise_w").alias("noise_weight"))
    pure = clusters.groupBy(*by).agg(F.sum("best_w").alias("pure"))
    scores = per_label.groupBy(*by).agg(F.sum(F.col("label_w") * F.col("r")).alias("inverse"), F.sum(F.col("label_w") * F.col("f")).alias("f"))
    joined = _joined(_joined(total, pure, by), scores, by)
    share = lambda c: F.when(F.col("total_weight") > 0, F.coalesce(F.col(c), F.lit(0.0)) / F.col("total_weight"))
    return joined.select(*by, share("pure").alias("purity"), share("inverse").alias("inverse_purity"), share("f").alias("f_measure"), "cluster_count", "label_count", "item_count", "total_weight", "raw_noise_count", "noise_weight")


def require_weight(metrics: DataFrame) -> DataFrame:
    """Fails at run time if the weights of a group do not sum to more than 0."""
    return metrics.filter(F.when(F.col("total_weight") <= 0, F.raise_error(F.lit("sum of weights must be positive")).isNull()).otherwise(F.lit(True)))


def pairwise_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weighted pairs with equal labels and clusters, and precision, recall and F1 from them, per group of ``by``.

    No pairs are made: the pairs within a group of rows weigh ``((sum w)^2 - sum w^2) / 2``, so three groupings give all
    counts. Ratios without a denominator are 0.
    """
    by = list(by)
    cells = _cells(df, by, True)
    within = lambda d: (F.sum("w") * F.sum("w") - F.sum("w2")) / 2
    per = lambda keys, name: cells.groupBy(*by, *keys).agg(within(cells).alias("h")).groupBy(*by).agg(F.sum("h").alias(name))
    joined = _joined(_joined(per(["label", "cluster"], "tp"), per(["cluster"], "in_cluster"), by), per(["label"], "in_label"), by)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("in_cluster")), ratio(F.col("tp"), F.col("in_label"))
    return joined.select(*by, p.alias("pair_precision"), r.alias("pair_recall"), ratio(2 * p * r, p + r).alias("pair_f1"), F.col("tp").alias("pair_tp_weight"), (F.col("in_cluster") - F.col("tp")).alias("pair_fp_weight"), (F.col("in_label") - F.col("tp")).alias("pair_fn_weight"))
