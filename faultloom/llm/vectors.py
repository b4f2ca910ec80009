"""Shared steps of the vector operators: unit vectors as bytes, copies, distributed k-means, nearest cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of the sample on which a codebook or the parts of an oversized cell may be fitted.
FIT_ROWS = 8_192
#: Most coarse cells; a codebook of so many 96-float centroids stays under 7 MB.
MAX_CELLS = 16_384
#: A cell with more vectors is split into several, as long as there are fewer than ``MAX_CELLS``.
SPLIT = 16_384
#: How tables of vectors are written: numbers without pattern gain nothing from dictionaries and compression.
PLAIN = {"parquet.enable.dictionary": "false", "compression": "uncompressed"}
#: Most ids that are broadcast (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Similarities that a task holds at once.
HELD = 4_000_000


def unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64)))
    return (x / np.where(norm == 0, 1, norm)[:, None]).astype(np.float32)


def to_bytes(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as byte strings: one copy of memory instead of a list of numbers each."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize if x.ndim == 2 else 0
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * width), pa.py_buffer(x.tobytes())])


def to_matrix(column: pa.ChunkedArray | pa.Array, kind: type = np.float32) -> np.ndarray:
    """The matrix of which :func:`to_bytes` made the column; an empty one has no columns."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), kind)
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(memoryview(column.buffers()[2])[ends[0] : ends[-1]], kind).reshape(len(column), -1).copy()


def dimension(df: DataFrame, vector: str) -> int:
    """The most common length among non-empty vectors (ties: the shorter), 0 if there is none."""
    sizes = df.groupBy(F.size(vector).alias("d")).count().filter("d > 0").orderBy(F.desc("count"), "d").limit(1).collect()
    return sizes[0]["d"] if sizes else 0


def to_units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The rows of a column of vectors at unit length."""
    return unit_rows(to_matrix(column))


def vector_table(df: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame | None:
    """``vec_id, vec``: every usable vector as bytes of 32-bit floats; None if there is none.

    Usable are vectors of the most common length with finite numbers that are not all zero.
    """
    dim = dimension(df, vector)
    if not dim:
        return None

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("vector")
            b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False))
            if not b.num_rows:
                continue
            flat = pc.list_flatten(b.column("vector")).to_numpy(zero_copy_only=False).astype(np.float32)
            x = flat.reshape(b.num_rows, dim)
            some = np.isfinite(x).all(1) & (x != 0).any(1)
            if some.any():
                yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(some)), to_bytes(x[some] + np.float32(0))], ["vec_id", "vec"])

    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<float>").alias("vector"))
    return materialize(rows.mapInArrow(usable, "vec_id long, vec binary"), f"{label}-vectors", **PLAIN)


def split_copies(vectors: DataFrame, label: str) -> tuple[DataFrame, DataFrame, int]:
    """``rep, vec`` of every distinct vector, named by the smallest id that holds it, ``vec_id, rep`` of the others, and how many are distinct.

    Equal vectors under many ids (a third of all rows may share one) are told by a 128-bit hash, so only ids and hashes
    are shuffled, and are searched and grouped once.
    """
    keyed = vectors.select("vec_id", F.xxhash64("vec").alias("h"), F.xxhash64(F.lit(1), "vec").alias("g"))
    groups = keyed.groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    copies = materialize(keyed.join(groups, ["h", "g"]).filter("vec_id <> rep").select("vec_id", "rep"), f"{label}-copies")
    ids, many = copies.select("vec_id"), copies.count()
    reps = vectors.join(F.broadcast(ids) if many <= BROADCAST_IDS else ids, "vec_id", "left_anti").withColumnRenamed("vec_id", "rep")
    return reps, copies, vectors.count() - many


def fit_sample(vectors: DataFrame, rows: int = FIT_ROWS) -> np.ndarray:
    """At most ``rows`` unit vectors, those with the smallest hash of their id (the same in every run)."""
    picked = vectors.select("vec", F.xxhash64("rep").alias("h")).orderBy("h").limit(rows).select("vec").toArrow()
    return to_units(picked["vec"])


def uniform(ids: np.ndarray, turn: int) -> np.ndarray:
    """A number between 0 and 1 for each id and turn, the same in every run: the mixed bits of both."""
    z = ids.astype(np.uint64) + np.uint64((turn * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54


def nearest_seed(x: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the number of the nearest seed and the cosine, few similarities being held at once."""
    step = max(1, HELD // max(1, len(seeds)))
    near, cos = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
    for i in range(0, len(x), step):
        s = x[i : i + step] @ seeds.T
        at = s.argmax(1)
        near.append(at)
        cos.append(s[np.arange(len(s)), at])
    return np.concatenate(near), np.concatenate(cos)


def drawn_by_distance(ids: np.ndarray, x: np.ndarray, far: np.ndarray, most: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``most`` rows drawn without replacement in proportion to ``far``: the smallest of keys that are exponential at that rate."""
    some = far > 1e-9
    key = -np.log(uniform(ids[some], turn)) / far[some]
    first = np.argsort(key, kind="stable")[:most]
    return key[first], ids[some][first], x[some][first]


def oversampled_seeds(vectors: DataFrame, k: int, rounds: int = 2) -> np.ndarray:
    """First centroids by parallel oversampled seeding (k-means||) over all rows of ``rep, vec``.

    Each round every task measures the distance of its rows to the seeds so far and draws rows in proportion to
    its square; the ``2 k / rounds`` best keys of all tasks are the round's seeds. The seeds, weighted by the rows nearest to
    each (counted in the tasks as well), are reduced to ``k`` by weighted drawing on the driver, which never holds more
    than ``2 k`` seeds.
    """
    sc = vectors.sparkSession.sparkContext
    seeds = fit_sample(vectors, 1)
    per = -(-2 * k // rounds)
    for turn in range(rounds if k > 1 else 0):
        shared = sc.broadcast(seeds)

        def draw(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            held = None
            for b in batches:
                if b.num_rows:
                    ids, x = b.column("rep").to_numpy(zero_copy_only=False), to_units(b.column("vec"))
                    new = drawn_by_distance(ids, x, 2 - 2 * nearest_seed(x, shared.value)[1], per, turn)
                    held = new if held is None else tuple(np.concatenate(p) for p in zip(held, new, strict=True))
                    if len(held[0]) > per:
                        best = np.argpartition(held[0], per)[:per]
                        held = tuple(p[best] for p in held)
            if held is not None and len(held[0]):
                yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1]), to_bytes(held[2])], ["key", "rep", "vec"])

        drawn = vectors.select("rep", "vec").mapInArrow(draw, "key double, rep long, vec binary").orderBy("key", "rep").limit(per).select("vec").toArrow()
        shared.unpersist()
        if not drawn.num_rows:
            break
        seeds = np.vstack([seeds, to_units(drawn["vec"])])
    return reduced_seeds(seeds, cell_sums(vectors, seeds)[1].astype(np.float64), k)


def reduced_seeds(seeds: np.ndarray, weight: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """``k`` of the weighted seeds, drawn one after the other in proportion to weight and squared distance."""
    rng = np.random.default_rng(seed)
    chosen = [int(weight.argmax())]
    far = np.clip(2 - 2 * (seeds @ seeds[chosen[0]]), 0, None)
    while len(chosen) < min(k, len(seeds)):
        p = far * weight
        if p.sum() <= 1e-9:
            break
        chosen.append(int(rng.choice(len(seeds), p=p / p.sum())))
        far = np.minimum(far, np.clip(2 - 2 * (seeds @ seeds[chosen[-1]]), 0, None))
    return seeds[chosen]


def cell_count(n: int) -> int:
    """Coarse cells for ``n`` vectors: about half the square root, within bounds."""
    return int(np.clip(np.sqrt(n) / 2, 1, MAX_CELLS))


def cell_sums(vectors: DataFrame, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the rows nearest to each cell: every task sums its rows, one row per cell and task is shuffled."""
    shared = vectors.sparkSession.sparkContext.broadcast(cells)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        total, seen = np.zeros(c.shape, np.float64), np.zeros(len(c), np.int64)
        for b in batches:
            if b.num_rows:
                x = to_units(b.column("vec"))
                near = nearest_seed(x, c)[0]
                order = np.argsort(near, kind="stable")
                cut = np.flatnonzero(np.diff(near[order], prepend=-1))
                total[near[order][cut]] += np.add.reduceat(x[order].astype(np.float64), cut, axis=0)
                seen += np.bincount(near, minlength=len(c))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), to_bytes(total[some]), pa.array(seen[some], pa.int64())], ["cell", "total", "n"])

    def merged(table: pa.Table) -> pa.Table:
        return pa.table({"cell": table["cell"].slice(0, 1), "total": to_bytes(to_matrix(table["total"], np.float64).sum(0, keepdims=True)), "n": pa.array([pc.sum(table["n"]).as_py()], pa.int64())})

    # A cell has one row per task, so what meets in one call is bounded by the number of tasks.
    parts = vectors.select("vec").mapInArrow(sums, "cell int, total binary, n long").groupBy("cell").applyInArrow(merged, "cell int, total binary, n long").toArrow()
    shared.unpersist()
    total, seen = np.zeros(cells.shape, np.float64), np.zeros(len(cells), np.int64)
    if parts.num_rows:
        at = parts["cell"].to_numpy()
        total[at], seen[at] = to_matrix(parts["total"], np.float64), parts["n"].to_numpy()
    return total, seen


def lloyd(vectors: DataFrame, cells: np.ndarray, iterations: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means steps over all rows, and the rows of each cell in the last one. A cell left without rows keeps its centroid."""
    seen = np.zeros(len(cells), np.int64)
    for _ in range(iterations):
        total, seen = cell_sums(vectors, cells)
        alive = np.abs(total).sum(1) > 0
        cells = cells.copy()
        cells[alive] = unit_rows(total[alive])
    return cells, seen


def coarse_cells(vectors: DataFrame, n: int) -> np.ndarray:
    """Centroids of the coarse cells of ``n`` distinct vectors: k-means with oversampled seeding, oversized cells split.

    A dense group may hold a third of all rows in one cell. Cells of more than ``SPLIT`` rows get further centroids, drawn
    from a bounded sample of their own rows, until all are small or there are ``MAX_CELLS``.
    """
    cells, seen = lloyd(vectors, oversampled_seeds(vectors, cell_count(n)))
    while (seen > SPLIT).any() and len(cells) < MAX_CELLS:
        large = np.flatnonzero(seen > SPLIT)
        near = nearest_cells(vectors, cells, 1).filter(F.col("cells")[0].isin(large.tolist()))
        sample = fit_sample(near)
        home = nearest_seed(sample, cells)[0]
        new = [reduced_seeds(part, np.ones(len(part)), int(-(-2 * seen[c] // SPLIT))) for c in large if len(part := sample[home == c]) > 1]
        room = MAX_CELLS - len(cells)
        if not new or not sum(map(len, new)):
            break
        before = len(cells)
        cells, seen = lloyd(vectors, np.vstack([cells, np.vstack(new)[:room]]), 1)
        if len(cells) == before:
            break
    return cells


def nearest_cells(vectors: DataFrame, cells: np.ndarray, probes: int, encode=None) -> DataFrame:
    """``rep, vec`` with ``cells``, the numbers of the ``probes`` nearest cells (the nearest first), and ``code``, what
    ``encode(residual, unit)`` makes of each row's residual from its nearest cell (null without ``encode``)."""
    shared = vectors.sparkSession.sparkContext.broadcast((cells, encode))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, code = shared.value
        most = min(probes, len(c))
        for b in batches:
            if not b.num_rows:
                continue
            x, found = to_units(b.column("vec")), []
            step = max(1, HELD // len(c))
            for i in range(0, len(x), step):
                s = x[i : i + step] @ c.T
                few = np.argpartition(-s, most - 1, axis=1)[:, :most] if most < len(c) else np.tile(np.arange(len(c)), (len(s), 1))
                found.append(np.take_along_axis(few, np.argsort(-np.take_along_axis(s, few, 1), axis=1, kind="stable"), 1))
            near = np.concatenate(found).astype(np.int32)
            codes = to_bytes(code(x - c[near[:, 0]], x)) if code else pa.nulls(len(x), pa.binary())
            lists = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), most).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("vec"), lists, codes], ["rep", "vec", "cells", "code"])

    return vectors.select("rep", "vec").mapInArrow(assign, "rep long, vec binary, cells array<int>, code binary")
