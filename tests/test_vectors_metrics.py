"""Metrics, linkage, embeddings against brute force."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultloom.operators import embeddings as em
from faultloom.operators import linkage as lk
from faultloom.operators import metrics as mt


def items(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "item long, label string, pred int, weight double")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(-1, 3), st.integers(1, 5).map(float)), min_size=1, max_size=12))
def test_pairs_and_purity_equal_literal_forms(spark, rows):
    p = mt.pairwise_counts(items(spark, rows)).collect()[0]
    pred = [f"n{i}" if c == -1 else c for i, (_, c, _) in enumerate(rows)]
    tp = fp = fn = 0.0
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            w, same, together = rows[i][2] * rows[j][2], rows[i][0] == rows[j][0], pred[i] == pred[j]
            tp, fp, fn = tp + w * (same and together), fp + w * (together and not same), fn + w * (same and not together)
    assert (p["pair_tp_weight"], p["pair_fp_weight"], p["pair_fn_weight"]) == pytest.approx((tp, fp, fn))
    m = mt.weighted_purity_f(items(spark, rows)).collect()[0]
    total = sum(r[2] for r in rows)
    cell = {}
    for (label, _, w), c in zip(rows, pred, strict=True):
        cell[label, c] = cell.get((label, c), 0) + w
    pure = sum(max(w for (_, d), w in cell.items() if d == c) for c in set(pred)) / total
    assert m["purity"] == pytest.approx(pure) and m["cluster_count"] == len(set(pred))


def test_weights_must_be_positive(spark):
    zero = mt.weighted_purity_f(items(spark, [("a", 1, 0.0)]))
    assert zero.collect()[0]["purity"] is None
    with pytest.raises(Exception, match="positive"):
        mt.require_weight(zero).collect()


def brute_linkage(dist, threshold):
    groups = [[i] for i in range(len(dist))]
    while len(groups) > 1:
        h, a, b = min((dist[np.ix_(x, y)].mean(), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        if h >= threshold:
            break
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


def test_linkage_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(5):
        dist = lk.distances(rng.normal(size=(30, 6)))
        merges = lk.dendrogram(dist)
        for t in (0.6, 0.9, 1.2):
            labels = lk.cut(merges, 30, t)
            assert {frozenset(np.flatnonzero(labels == c)) for c in set(labels)} == brute_linkage(dist, t)


def test_silhouette_equals_definition():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(25, 4))
    dist, labels = lk.distances(x), rng.integers(0, 5, 25)
    total = 0.0
    for i in range(25):
        own = [j for j in range(25) if labels[j] == labels[i] and j != i]
        if own:
            a = dist[i, own].mean()
            b = min(dist[i, labels == c].mean() for c in set(labels) - {labels[i]})
            total += (b - a) / max(a, b)
    assert lk.silhouette(dist, labels) == pytest.approx(total / 25)
    assert lk.silhouette(dist, np.zeros(25, int)) == -1 and lk.silhouette(dist, np.arange(25)) == -1


def test_grid_selection_and_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(f"r{i:02d}", [float(v) for v in np.eye(3)[i % 3] + rng.normal(scale=0.05, size=3)], str(i % 3), 1.0) for i in range(24)]
    df = spark.createDataFrame(rows, "record_id string, vector array<double>, true_label string, weight double")
    grid = lk.with_external_metrics(lk.threshold_grid(df), df.select("record_id", "true_label", "weight"))
    chosen = lk.select_by_silhouette(grid).collect()[0]
    assert grid.count() == 41 and chosen["cluster_count_internal"] == 3 and chosen["f_measure"] == pytest.approx(1)
    assert lk.select_by_f_measure(grid).collect()[0]["f_measure"] == pytest.approx(1)
    alone = lk.threshold_grid(df.limit(1))
    assert lk.select_by_silhouette(alone).collect()[0]["distance_threshold"] == 0.2
    counts = [r["cluster_count_internal"] for r in grid.orderBy("distance_threshold").collect()]
    assert counts == sorted(counts, reverse=True)


def test_embedding_cache_round(spark):
    rows = spark.createDataFrame([("a", ("x y", "")), ("b", ("x y", "z")), ("c", ("", " "))], "record_id string, field_texts struct<must:string,should:string>")
    long = em.field_texts_long(rows, "record_id", ["must", "should"])
    empty = spark.createDataFrame([], em.CACHE)
    misses = em.cache_misses(long, empty, "m")
    assert misses.count() == 2  # equal texts are asked for once, blank ones never
    cache = em.embed_missing(misses, lambda: em.hashed_embedder(8), "m").cache()
    assert em.cache_misses(long, cache, "m").count() == 0 and em.cache_misses(long, cache, "other").count() == 2
    v = {r["record_id"]: r["vector"] for r in em.record_vectors(rows, cache, ["must", "should"], "m", 8).collect()}
    assert np.linalg.norm(v["a"]) == pytest.approx(1, abs=1e-6) and v["c"] == [0.0] * 8
    a, b = (np.array(em.hashed_embedder(8)([t])[0]) for t in ("x y", "z"))
    want = a / np.linalg.norm(a) + b / np.linalg.norm(b)
    assert np.allclose(v["b"], want / np.linalg.norm(want), atol=1e-6)
    twice = cache.unionByName(cache.withColumn("created_at", F.col("created_at") + 1).withColumn("dim", F.lit(9)))
    assert {r["dim"] for r in em.latest_cache(twice).collect()} == {9}
    em.check_vectors(rows, em.record_vectors(rows, cache, ["must"], "m", 8))
    with pytest.raises(ValueError, match="missing vectors: c"):
        em.check_vectors(rows, rows.filter("record_id <> 'c'"))


def test_failed_calls_are_repeated(spark):
    def service():
        state = {"n": 0}

        def call(texts):
            state["n"] += 1
            if state["n"] < 3:
                raise OSError("busy")
            return [[1.0]] * len(texts)

        return call

    misses = spark.createDataFrame([("k", "t")], "cache_key string, text string")
    assert em.embed_missing(misses, service, "m", wait=0).count() == 1


def test_unit_keeps_zero_and_null(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(em.unit(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0], None]
