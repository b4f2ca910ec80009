"""Similarity clusters: the cells of a distributed k-means with oversampled seeding, checked exactly, with typical members."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import vectors as V

#: Coarse cells in which a seed meets others, and nearest ones in which a centroid stands besides the homes of its seeds.
PROBES, STANDS = 12, 4
#: Vectors that one task seeds, assigns or compares at once; larger cells and clusters are split into such blocks.
BLOCK = 8192
#: Seeds drawn in one round of a block.
DRAWN = 256
#: Rounding allowed when a cosine of 32-bit floats is held against a bound.
SLACK = 1e-6
#: The same for an angle made of one; near 0 an angle turns much for a small change of its cosine.
TURN = 1e-3


def hashed_features(tokens: Column, dim: int = 96, weights: Column | None = None) -> Column:
    """A record's tokens as a vector of ``dim`` hashed, signed, weighted counts.

    Null and empty token arrays give the zero vector; a missing weight counts as 1. Token tables that come
    without vectors enter :func:`kmeans_cells` through this.
    """
    some = F.coalesce(tokens, F.array().cast("array<string>"))
    given = F.coalesce(weights, F.array().cast("array<double>")) if weights is not None else F.array().cast("array<double>")
    paired = F.filter(F.arrays_zip(some.alias("t"), given.alias("w")), lambda p: p["t"].isNotNull())
    sign = lambda t: F.when(F.pmod(F.hash(t), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    placed = F.transform(paired, lambda p: F.struct(F.pmod(F.xxhash64(p["t"]), F.lit(dim)).cast("int").alias("slot"), (sign(p["t"]) * F.coalesce(p["w"].cast("double"), F.lit(1.0))).alias("v")))
    zero = F.array_repeat(F.lit(0.0).cast("double"), dim)
    add = lambda acc, p: F.concat(F.slice(acc, F.lit(1), p["slot"]), F.array(F.get(acc, p["slot"]) + p["v"]), F.slice(acc, p["slot"] + 2, F.lit(dim)))
    return F.aggregate(placed, zero, add).cast("array<float>")


def group_by_seeds(ids: np.ndarray, x: np.ndarray, least: float) -> np.ndarray:
    """For every row the id of its seed: oversampled seeding until no row is farther from all seeds than ``least``.

    Each round draws many seeds at once among the rows that no seed reaches, in proportion to their squared distance from
    the nearest seed. A row belongs to its nearest seed; seeds that reach each other are then one, named by the smallest id.
    """
    owner = np.full(len(x), -1)
    sim = np.full(len(x), -1.0, np.float32)
    turn = 0
    while (left := np.flatnonzero(sim < least - SLACK)).size:
        new = V.drawn_by_distance(ids[left], left, np.maximum(2.0 - 2 * sim[left], 1e-6), DRAWN, turn)[2]
        near, cos = V.nearest_seed(x, x[new])
        closer = cos > sim
        owner[closer], sim[closer] = new[near[closer]], cos[closer]
        turn += 1
    chosen = np.unique(owner)
    root = join_near(ids[chosen], x[chosen], least)
    return root[np.searchsorted(chosen, owner)]


def join_near(ids: np.ndarray, x: np.ndarray, least: float) -> np.ndarray:
    """For every row the smallest id of the rows it is linked to by steps of cosine ``least`` or more.

    Labels spread both ways, block of rows by block of rows, until a whole sweep changes none; the pairs themselves
    are never kept.
    """
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    label = np.arange(len(ids))
    step = max(1, V.HELD // max(1, len(x)))
    while True:
        before = label.copy()
        for i in range(0, len(x), step):
            near = x[i : i + step] @ x.T >= least - SLACK
            near[np.arange(len(near)), np.arange(i, i + len(near))] = True
            low = np.where(near, label, len(ids)).min(1)
            np.minimum(label, np.where(near, low[:, None], len(ids)).min(0), out=label)
        label = np.minimum(label, label[label])
        if (label == before).all():
            out = np.empty_like(ids)
            out[order] = ids[label]
            return out


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """``key, blocks``: how many blocks the rows of each key make."""
    return rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))


def _block_of(column: str = "rep") -> Column:
    return F.pmod(F.xxhash64(column), F.col("blocks")).cast("int")


def connected(edges: DataFrame, label: str) -> DataFrame:
    """``node, root``: every node of ``edges(a, b)`` with the smallest node it is connected to.

    Alternates two steps: every node links its larger neighbours to the smallest one, then its smaller ones likewise.
    The number of rounds grows with the logarithm of a chain's length. Every round is written to the shared folder, so the plan
    stays short and survives lost executors.
    """
    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])

    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{label}-links")
    seen = mark(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), f"{label}-links")
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def seeds_of_blocks(placed: DataFrame, least: float, label: str) -> DataFrame:
    """``rep, vec, cells, cell, total, n``: the seeds of every block of a coarse cell with the sum and number of their rows."""
    home = placed.select("rep", "vec", "cells", F.col("cells")[0].alias("cell"))
    home = home.join(F.broadcast(_blocks(home.select("cell"), "cell")), "cell")  # at most MAX_CELLS rows

    def seeded(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        ids, x = t["rep"].to_numpy(), V.to_units(t["vec"])
        seed, group = np.unique(group_by_seeds(ids, x, least), return_inverse=True)
        total = np.zeros((len(seed), x.shape[1]), np.float64)
        np.add.at(total, group, x)
        own = t.take(pa.array(np.searchsorted(ids, seed))).select(["rep", "vec", "cells", "cell"])
        return own.append_column("total", V.to_bytes(total)).append_column("n", pa.array(np.bincount(group), pa.int64()))

    found = home.select("rep", "vec", "cells", "cell", _block_of().alias("block")).groupBy("cell", "block").applyInArrow(seeded, "rep long, vec binary, cells array<int>, cell int, total binary, n long")
    return materialize(found, f"{label}-seeds", **V.PLAIN)


def seed_links(seeds: DataFrame, least: float) -> DataFrame:
    """``a, b``: seeds that reach each other, linked through the smallest of each connected set of a meeting.

    Seeds meet in their nearest cells; a cell with more than ``BLOCK`` seeds holds a meeting of every two of its blocks.
    """
    sent = seeds.select("rep", "vec", F.explode(F.slice("cells", 1, PROBES)).alias("at"))
    sent = sent.join(F.broadcast(_blocks(sent.select("at"), "at")), "at").withColumn("block", _block_of())
    pair = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = pair.select("rep", "vec", "at", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def met(t: pa.Table) -> pa.Table:
        ids = t["rep"].to_numpy()
        root = join_near(ids, V.to_units(t["vec"]), least)
        some = root != ids
        return pa.table({"a": pa.array(ids[some], pa.int64()), "b": pa.array(root[some], pa.int64())})

    return pair.groupBy("at", "lo", "hi").applyInArrow(met, "a long, b long")


def merged_centroids(seeds: DataFrame, least: float, cells: np.ndarray, label: str) -> DataFrame:
    """``label, vec, at``: the centroids of the fine k-means and the coarse cells at which rows can find them.

    The oversampled seeds are reduced by joining those that reach each other; a centroid is the mean of its seeds' rows.
    It stands in its own nearest cells and in the home cells of its seeds, so every row meets the centroid of its seed.
    """
    roots = connected(seed_links(seeds, least), label)
    named = materialize(seeds.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(F.coalesce("root", "rep").alias("label"), "vec", "cell", "total", "n"), f"{label}-named", **V.PLAIN)

    def summed(t: pa.Table) -> pa.Table:
        total = V.to_matrix(t["total"], np.float64).sum(0, keepdims=True)
        return pa.table({"label": t["label"].slice(0, 1), "part": pa.array([0], pa.int32()), "total": V.to_bytes(total)})

    # Seeds of one label are first summed in parts, so that a long chain of seeds never meets in one task.
    parts = named.select("label", F.pmod(F.xxhash64("vec"), F.lit(64)).cast("int").alias("part"), "total").groupBy("label", "part").applyInArrow(summed, "label long, part int, total binary")
    means = parts.groupBy("label").applyInArrow(summed, "label long, part int, total binary")

    def unit(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("label"), V.to_bytes(V.unit_rows(V.to_matrix(b.column("total"), np.float64)))], ["rep", "vec"])

    centres = V.nearest_cells(means.mapInArrow(unit, "rep long, vec binary"), cells, STANDS)
    centres = materialize(centres.select(F.col("rep").alias("label"), "vec", "cells"), f"{label}-centres", **V.PLAIN)
    homes = centres.select("label", F.explode("cells").alias("at")).unionByName(named.select("label", F.col("cell").alias("at"))).distinct()
    return centres.join(homes, "label").select("label", "vec", "at", F.col("cells")[0].alias("home"))


def _met(rows: DataFrame, centres: DataFrame, look, schema: str) -> DataFrame:
    """``look(rows, centres)`` of every block of a coarse cell's rows with all centroids that stand there."""
    rows = rows.withColumn("at", F.col("cells")[0])
    blocks = F.broadcast(_blocks(rows.select("at"), "at"))  # at most MAX_CELLS rows
    left = rows.join(blocks, "at").withColumn("block", _block_of()).drop("blocks")
    right = centres.join(blocks, "at").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return left.groupBy("at", "block").cogroup(right.groupBy("at", "block")).applyInArrow(look, schema)


ASSIGNED = "rep long, vec binary, cells array<int>, code binary, label long, near double, home int"


def assigned(placed: DataFrame, centres: DataFrame) -> DataFrame:
    """``placed`` with ``label, near, home``: every row's nearest centroid, the cosine to it, and that centroid's own coarse cell."""
    def nearest(rows: pa.Table, there: pa.Table) -> pa.Table:
        rows = rows.select(["rep", "vec", "cells", "code"])
        if not rows.num_rows or not there.num_rows:
            none = rows.slice(0, 0)
            return none.append_column("label", pa.array([], pa.int64())).append_column("near", pa.array([], pa.float64())).append_column("home", pa.array([], pa.int32()))
        there = there.sort_by("label")
        at, cos = V.nearest_seed(V.to_units(rows["vec"]), V.to_units(there["vec"]))
        take = pa.array(at)
        return rows.append_column("label", there["label"].take(take)).append_column("near", pa.array(cos.astype(np.float64))).append_column("home", there["home"].take(take))

    return _met(placed.select("rep", "vec", "cells", "code"), centres, nearest, ASSIGNED)


class Cells:
    """A fine k-means: ``centres``, the ``rows`` distinct vectors with their coarse cells ``assigned`` to them, and the ``copies`` of vectors."""

    def __init__(self, centres: DataFrame, found: DataFrame, copies: DataFrame, coarse: np.ndarray, rows: int):
        self.centres, self.assigned, self.copies, self.coarse, self.rows = centres, found, copies, coarse, rows

    def with_copies(self, rows: DataFrame) -> DataFrame:
        """Rows by ``rep`` with a ``vec_id`` for each vector: the distinct one itself and its equals."""
        return rows.withColumn("vec_id", F.col("rep")).unionByName(self.copies.join(rows, "rep"))


def kmeans_cells(df: DataFrame, vec_id: str, vector: str, least: float = 0.70, label: str = "clusters", encoder=None, probes: int = PROBES) -> Cells | None:
    """Distributed k-means on unit vectors with as many cells as there are groups of vectors that reach ``least``; None without usable vectors.

    1. Coarse cells by k-means with parallel oversampled seeding over all rows; they only say which rows meet in a task. 2. In
    every block of a coarse cell seeds are drawn until each row reaches one; seeds meet in their nearest coarse cells and
    those that reach each other become one centroid, the mean of their rows. 3. Every row is assigned to its nearest centroid.

    ``encoder(sample, coarse)`` may give a function of residuals and rows that fills ``code``; ``cells`` has at least ``probes`` cells. Null, zero and non-finite vectors and
    vectors of another length than the most common take no part; equal vectors are one row.
    """
    vectors = V.vector_table(df, vec_id, vector, label)
    if vectors is None:
        return None
    reps, copies, n = V.split_copies(vectors, label)
    if not n:
        return None
    coarse = V.coarse_cells(reps, n)
    coder = encoder(V.fit_sample(reps), coarse) if encoder else None
    placed = materialize(V.nearest_cells(reps, coarse, max(probes, PROBES), coder), f"{label}-cells", **V.PLAIN)
    centres = merged_centroids(seeds_of_blocks(placed, least, label), least, coarse, label)
    found = materialize(assigned(placed, centres), f"{label}-assigned", **V.PLAIN)
    return Cells(centres, found, copies, coarse, n)


def clusters_of(cells: Cells) -> DataFrame:
    """``vec_id, rep, label, cluster, near``: members of the k-means cells, each cell named by its smallest member."""
    members = cells.with_copies(cells.assigned.select("rep", "label", "near"))
    first = cells.assigned.groupBy("label").agg(F.min("rep").alias("cluster"))
    return members.join(first, "label").select("vec_id", "rep", "label", "cluster", "near")


def loose_clusters(rows: DataFrame, least: float, buckets: int) -> DataFrame:
    """``label``: clusters of ``rep, vec, label, near`` of which some two members do not reach ``least``, compared exactly.

    Two members whose angles to the centroid add up to less than the bound need no comparison. A cluster of more than ``BLOCK``
    rows is compared block against block. Small clusters share ``buckets`` tasks.
    """
    limit = np.arccos(least)
    angle = F.acos(F.least(F.col("near"), F.lit(1.0)))
    wide = rows.groupBy("label").agg(F.max(angle).alias("widest"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    doubtful = rows.join(wide, "label").filter(angle + F.col("widest") > limit - TURN).select("rep", "vec", "label")
    blocks = _blocks(doubtful.select("label"), "label")
    sized = doubtful.join(blocks, "label").withColumn("block", _block_of())
    pair = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bucket = F.when(F.col("blocks") > 1, F.xxhash64("label", "lo", "hi")).otherwise(F.pmod(F.xxhash64("label"), F.lit(buckets)))
    pair = pair.select("vec", "label", "blocks", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).select("vec", "label", bucket.alias("bucket"))

    def compared(t: pa.Table) -> pa.Table:
        t = t.sort_by("label")
        names, x, out = t["label"].to_numpy(), V.to_units(t["vec"]), []
        cut = np.append(np.flatnonzero(np.diff(names, prepend=names[0] - 1)), len(names))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            step = max(1, V.HELD // (b - a))
            if any((x[i : min(b, i + step)] @ x[a:b].T).min() < least - SLACK for i in range(a, b, step)):
                out.append(names[a])
        return pa.table({"label": pa.array(out, pa.int64())})

    return pair.groupBy("bucket").applyInArrow(compared, "label long").distinct()


def crowded_clusters(cells: Cells, wanted: DataFrame, least: float, label: str) -> DataFrame:
    """``label``: clusters among ``wanted(label)`` of which a member reaches ``least`` with a vector of another cluster, compared exactly.

    Only members within reach of another cluster, by their angle to its centroid and its radius, are compared with that
    cluster's members within reach of theirs.
    """
    limit = float(np.arccos(least))
    radius = cells.assigned.groupBy("label").agg(F.acos(F.least(F.min("near"), F.lit(1.0))).alias("radius"))
    standing = cells.centres.join(radius, "label").select("label", "vec", "at", "radius")
    placed = cells.assigned.select("rep", "vec", "cells", F.col("label").alias("own"))

    def suspects(rows: pa.Table, there: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        if rows.num_rows and there.num_rows:
            x, c = V.to_units(rows["vec"]), V.to_units(there["vec"])
            floor = np.cos(np.minimum(np.pi, limit + there["radius"].to_numpy() + TURN)).astype(np.float32)
            own, names, ids = rows["own"].to_numpy(), there["label"].to_numpy(), rows["rep"].to_numpy()
            step = max(1, V.HELD // len(c))
            for i in range(0, len(x), step):
                a, b = np.nonzero(x[i : i + step] @ c.T >= floor)
                other = names[b] != own[a + i]
                out.append((ids[a[other] + i], own[a[other] + i], names[b[other]]))
        rep, own, other = (np.concatenate(p) for p in zip(*out, strict=True))
        return pa.table({"rep": pa.array(rep, pa.int64()), "own": pa.array(own, pa.int64()), "other": pa.array(other, pa.int64())})

    near = materialize(_met(placed, standing, suspects, "rep long, own long, other long"), f"{label}-suspects")
    sides = near.select("rep", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") < F.col("other")).alias("first"))
    counts = sides.groupBy("lo", "hi").agg(F.count_if("first").alias("a"), F.count_if(~F.col("first")).alias("b")).filter("a > 0 AND b > 0")
    asked = wanted.select("label").distinct()
    touched = counts.join(asked.withColumnRenamed("label", "lo"), "lo", "left_semi").unionByName(counts.join(asked.withColumnRenamed("label", "hi"), "hi", "left_semi")).distinct()
    size = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    sized = sides.join(touched.select("lo", "hi", size("a").alias("a"), size("b").alias("b")), ["lo", "hi"])
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("first"), F.col("a")).otherwise(F.col("b"))).cast("int")
    spread = sized.withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.when(F.col("first"), F.col("b")).otherwise(F.col("a")) - 1)))
    meeting = spread.select("rep", "lo", "hi", "first", F.when(F.col("first"), F.col("mine")).otherwise(F.col("theirs")).alias("i"), F.when(F.col("first"), F.col("theirs")).otherwise(F.col("mine")).alias("j"))
    full = meeting.join(cells.assigned.select("rep", "vec"), "rep")

    def touch(t: pa.Table) -> pa.Table:
        first = t["first"].to_numpy(zero_copy_only=False).astype(bool)
        x = V.to_units(t["vec"])
        a, b = x[first], x[~first]
        step = max(1, V.HELD // max(1, len(b)))
        hit = len(b) > 0 and any((a[i : i + step] @ b.T).max() >= least - SLACK for i in range(0, len(a), step))
        ends = [t["lo"][0].as_py(), t["hi"][0].as_py()] if hit else []
        return pa.table({"label": pa.array(ends, pa.int64())})

    return full.groupBy("lo", "hi", "i", "j").applyInArrow(touch, "label long").distinct()


def tight_clusters(cells: Cells, least: float = 0.70, smallest: int = 3, label: str = "tight") -> DataFrame:
    """``cluster, vec_id``: k-means cells with at least ``smallest`` members of which any two reach ``least`` and none reaches it with a vector outside."""
    members = materialize(clusters_of(cells), f"{label}-members")
    big = members.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= smallest).select("label")
    rows = cells.assigned.select("rep", "vec", "label", "near").join(big, "label", "left_semi")
    loose = loose_clusters(rows, least, max(1, cells.rows // (2 * BLOCK)))
    tight = materialize(big.join(loose, "label", "left_anti"), f"{label}-sound")
    alone = tight.join(crowded_clusters(cells, tight, least, label), "label", "left_anti")
    return members.join(alone, "label", "left_semi").select("cluster", "vec_id")


def described(members: DataFrame, weights: DataFrame, typical: int = 3) -> DataFrame:
    """``cluster, size, weight, vec_id, rank``: each cluster's size and total weight with its members nearest to the centroid.

    ``members`` is the result of :func:`clusters_of`, ``weights`` is ``vec_id, weight`` with one row per vector; missing weights
    count as 0. Ties go to the smaller id. No vector is read again: the assignment has each member's nearness.
    """
    totals = members.join(weights, "vec_id", "left").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.round("near", 6)), "vec_id"))
    return members.withColumn("rank", place).filter(F.col("rank") <= typical).join(totals, "cluster").select("cluster", "size", "weight", "vec_id", "rank")
