"""The k most similar vectors of every vector: coarse cells, anisotropic 4-bit codes, exact rerank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import clusters
from . import vectors as V

#: Vectors this similar to a centroid's seed share its fine cell; a row whose k-th best is below it asks farther.
GATHER = 0.70
#: Coarse cells in which a row of the far search asks, and in which every vector can be found there.
FAR_PROBES, SPILL = 32, 4
#: Queries, and members, that one task searches at once.
BLOCK = 8192
#: A fine cell with more rows than a far search would look at is not gathered but searched farther.
GATHERED = FAR_PROBES * V.SPLIT
#: A pair stays for reranking if its approximate score is within so many standard errors of the k-th best.
MARGIN = 4.0
CENTRES = 16
#: Vectors on which the codebook is fitted.
CODEBOOK_ROWS = 4096
#: Pairs whose approximate, and whose exact scores a task holds at once; they bound its memory, not its result.
SCANNED, RERANKED = 2_000_000, 40_000


def _parallel_weight(dim: int, threshold: float = 0.2) -> float:
    """Weight of the residual along the vector against the rest: (d - 1) t^2 / (1 - t^2) for scores of at least t."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


class AnisotropicCodes:
    """Product codes of 4 bits for two dimensions each, fitted so that errors along a vector weigh more.

    Errors parallel to a vector change its largest inner products, errors across it hardly do;
    the loss of a code is therefore ``|r|^2 + (w - 1) (r . x)^2`` for the residual r of the unit vector x.
    """

    def __init__(self, books: np.ndarray, weight: float):
        self.books, self.weight = books, weight  # (subspaces, 16, 2)

    @staticmethod
    def _parts(x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, x.shape[1] % 2))).reshape(len(x), -1, 2)

    @classmethod
    def fit(cls, residual: np.ndarray, unit: np.ndarray, seed: int = 7, steps: int = 6) -> AnisotropicCodes:
        r, u = cls._parts(residual), cls._parts(unit)
        rng = np.random.default_rng(seed)
        books = np.stack([r[rng.choice(len(r), CENTRES, replace=len(r) < CENTRES), s] for s in range(r.shape[1])]).astype(np.float32)
        own = cls(books, _parallel_weight(unit.shape[1]))
        for step in range(steps):
            codes = own._assign(r, u, sweeps=0 if step < 3 else 1)
            own._refit(r, u, codes, anisotropic=step >= 2)
        return own

    def _assign(self, r: np.ndarray, u: np.ndarray, sweeps: int = 1) -> np.ndarray:
        """Codes of each row: the nearest centre of every subspace, then, sweep by sweep, the one with the least loss given the others."""
        n, subs, _ = r.shape
        codes = np.empty((n, subs), np.uint8)
        along = np.zeros(n, np.float32)
        at = np.arange(n)
        near, par = [], []
        for s in range(subs):
            b = self.books[s].T.astype(np.float32)
            near.append((b * b).sum(0) - 2 * (r[:, s] @ b))  # squared distance, less the row's own square
            par.append((r[:, s] * u[:, s]).sum(1)[:, None] - u[:, s] @ b)
            codes[:, s] = near[s].argmin(1)
            along += par[s][at, codes[:, s]]
        for _ in range(sweeps):
            for s in range(subs):
                rest = along - par[s][at, codes[:, s]]
                best = (near[s] + (self.weight - 1) * (rest[:, None] + par[s]) ** 2).argmin(1)
                codes[:, s] = best
                along = rest + par[s][at, best]
        return codes

    def _refit(self, r: np.ndarray, u: np.ndarray, codes: np.ndarray, anisotropic: bool) -> None:
        extra = (self.weight - 1) if anisotropic else 0.0
        n, subs, _ = r.shape
        err = np.stack([r[:, s] - self.books[s][codes[:, s]] for s in range(subs)], 1)
        par = (err * u).sum(2)
        along = par.sum(1)
        for s in range(subs):
            rest = along - par[:, s]
            outer = extra * u[:, s, :, None] * u[:, s, None, :] + np.eye(2, dtype=np.float32)
            target = r[:, s] + extra * ((rest + (r[:, s] * u[:, s]).sum(1))[:, None] * u[:, s])
            a = np.stack([np.bincount(codes[:, s], outer[:, i, j], CENTRES) for i in (0, 1) for j in (0, 1)], 1).reshape(CENTRES, 2, 2)
            b = np.stack([np.bincount(codes[:, s], target[:, i], CENTRES) for i in (0, 1)], 1)
            used = np.bincount(codes[:, s], minlength=CENTRES) > 0
            self.books[s][used] = np.linalg.solve(a[used] + 1e-6 * np.eye(2), b[used][:, :, None])[:, :, 0]
            new = ((r[:, s] - self.books[s][codes[:, s]]) * u[:, s]).sum(1)
            along = rest + new
            par[:, s] = new

    def encode(self, residual: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Two codes to a byte: (rows, subspaces / 2)."""
        codes = np.concatenate([self._assign(self._parts(residual[i : i + 4096]), self._parts(unit[i : i + 4096])) for i in range(0, len(unit), 4096)])
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return codes[:, 0::2] * CENTRES + codes[:, 1::2]

    def scores(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate inner products of queries with the coded residuals, summed from tables of one byte's two codes."""
        q = self._parts(queries)
        single = np.einsum("qsd,scd->qsc", q, self.books)
        if single.shape[1] % 2:
            single = np.pad(single, ((0, 0), (0, 1), (0, 0)))
        tables = (single[:, 0::2, :, None] + single[:, 1::2, None, :]).reshape(len(q), -1, CENTRES * CENTRES)
        out = np.zeros((len(q), len(packed)), np.float32)
        for s in range(packed.shape[1]):
            out += np.take(tables[:, s], packed[:, s], axis=1)
        return out


def _cosine6(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    q, x = q.astype(np.float64), x.astype(np.float64)
    dot = lambda a, b: np.einsum("ij,ij->i", a, b)
    return np.round(dot(q, x) / (np.sqrt(dot(q, q)) * np.sqrt(dot(x, x))), 6)


def search_block(
    q_ids: np.ndarray, q_raw: np.ndarray, ids: np.ndarray, x_raw: np.ndarray, packed: np.ndarray, home: np.ndarray, cells: np.ndarray, coder: AnisotropicCodes, k: int, least: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, member number and cosine of each query's ``k`` best members.

    ``packed`` has the members' codes, made of their residuals from the centroids ``cells[home]``. All codes are scanned for every
    query; pairs within ``MARGIN`` standard errors of the k-th best approximate score (and of the least similarity) are
    scored exactly. Nothing is capped; a few queries at a time keep memory small however many pairs pass.
    """
    q, x = V.unit_rows(q_raw), V.unit_rows(x_raw)
    near, of = np.unique(home, return_inverse=True)
    centres = cells[near]
    some = np.linspace(0, len(q) - 1, min(64, len(q))).astype(int)
    err = coder.scores(q[some], packed) + (q[some] @ centres.T)[:, of] - q[some] @ x.T
    sigma = float(err.std()) + 1e-6
    rows, cols, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    step = max(1, min(len(q), 1024, SCANNED // max(1, len(x))))
    for i in range(0, len(q), step):
        part = q[i : i + step]
        approx = coder.scores(part, packed)
        approx += (part @ centres.T)[:, of]
        approx[q_ids[i : i + step, None] == ids[None, :]] = -9
        floor = np.maximum(np.maximum(_kth(approx, k), least) - MARGIN * sigma, -8.0)
        exact = _exact(part, x, approx >= floor[:, None])
        near_best = (exact >= least - 1e-5) & (exact >= np.maximum(_kth(exact, k) - 2e-6, -8.0)[:, None])
        a, b = np.nonzero(near_best)
        s = np.concatenate([np.zeros(0), *[_cosine6(q_raw[i + a[j : j + RERANKED]], x_raw[b[j : j + RERANKED]]) for j in range(0, len(a), RERANKED)]])
        best = _best(a, ids[b], s, k)
        rows.append(a[best] + i)
        cols.append(b[best])
        sims.append(s[best])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(sims)


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest score of each row, or less than any if rows are shorter."""
    return np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -8.0, np.float32)


def _exact(q: np.ndarray, x: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Exact scores of the wanted pairs, -9 elsewhere: pair by pair if they are few, else as one product."""
    if wanted.mean() > 0.05:
        return np.where(wanted, q @ x.T, np.float32(-9))
    out = np.full(wanted.shape, -9, np.float32)
    a, b = np.nonzero(wanted)
    for j in range(0, len(a), RERANKED):
        aa, bb = a[j : j + RERANKED], b[j : j + RERANKED]
        out[aa, bb] = np.einsum("ij,ij->i", q[aa], x[bb])
    return out


def _best(rows: np.ndarray, other: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each row: larger similarity first, then the smaller other id."""
    order = np.lexsort((other, -sims, rows))
    r = rows[order]
    first = np.flatnonzero(np.diff(r, prepend=-1))
    rank = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
    return order[rank < k]


FOUND = pa.schema([("rep", pa.int64()), ("other_rep", pa.int64()), ("similarity", pa.float64())])
_FOUND_SQL = "rep long, other_rep long, similarity double"


def _task(queries: pa.Table, there: pa.Table, shared, k: int, least: float) -> pa.Table:
    """What the queries find among the members at hand."""
    if not queries.num_rows or not there.num_rows:
        return FOUND.empty_table()
    cells, coder = shared.value
    q_ids, ids = queries["rep"].to_numpy(), there["rep"].to_numpy()
    rows, cols, sims = search_block(q_ids, V.to_matrix(queries["vec"]), ids, V.to_matrix(there["vec"]), V.to_matrix(there["code"], np.uint8), there["home"].to_numpy(), cells, coder, k, least)
    return pa.table([pa.array(q_ids[rows]), pa.array(ids[cols]), pa.array(sims)], schema=FOUND)


def _gathered_search(rows: DataFrame, shared, k: int, least: float) -> DataFrame:
    """``rep, other_rep, similarity``: the best of each of ``rep, vec, code, home, cell`` among the rows of its cell.

    A cell with more than ``BLOCK`` rows is searched by every two of its blocks, one for the other and back; a row's bests of
    all meetings are put together by the caller.
    """
    blocks = F.broadcast(rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))  # at most MAX_CELLS rows
    sized = rows.join(blocks, "cell").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = sized.select("rep", "vec", "code", "home", "cell", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))

    def search(t: pa.Table) -> pa.Table:
        mine = t["mine"].to_numpy()
        sides = [t.filter(pa.array(mine == b)) for b in np.unique(mine)]
        if len(sides) == 1:
            # A lone side of a meeting of two blocks is searched where it meets itself.
            return _task(t, t, shared, k, least) if t["lo"][0] == t["hi"][0] else FOUND.empty_table()
        return pa.concat_tables([_task(sides[0], sides[1], shared, k, least), _task(sides[1], sides[0], shared, k, least)])

    return met.groupBy("cell", "lo", "hi").applyInArrow(search, _FOUND_SQL)


def _far_search(asked: DataFrame, members: DataFrame, shared, k: int, least: float) -> DataFrame:
    """``rep, other_rep, similarity``: the best of each of ``asked(rep, vec, cell)`` among ``members(rep, vec, code, home, cell)`` of the cell.

    Blocks of askers and of members bound what a task holds.
    """
    count = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    blocks = materialize(count(asked, "parts").join(count(members, "blocks"), "cell"), "knn-blocks")  # at most MAX_CELLS rows
    at = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(F.broadcast(blocks), "cell").select("rep", "vec", "cell", at("parts").alias("part"), every("blocks").alias("block"))
    fresh = [F.col(c).alias(f"m_{c}") for c in ("rep", "vec", "code", "home", "cell")]  # both sides may come from one table
    right = members.join(F.broadcast(blocks), "cell").select(*fresh, every("parts").alias("m_part"), at("blocks").alias("m_block"))

    def look(queries: pa.Table, there: pa.Table) -> pa.Table:
        return _task(queries, there.rename_columns([c.removeprefix("m_") for c in there.column_names]), shared, k, least)

    return left.groupBy("cell", "part", "block").cogroup(right.groupBy("m_cell", "m_part", "m_block")).applyInArrow(look, _FOUND_SQL)


def most_similar(df: DataFrame, vec_id: str, vector: str, k: int = 5, least: float = -1.0, label: str = "knn") -> DataFrame:
    """``vec_id, other_id, similarity, rank``: the ``k`` most similar other vectors of every vector.

    Similarity is the cosine rounded to 6 decimals; of equal ones the smaller id comes first; those below
    ``least`` are left out. Null, all-zero and non-finite vectors and those of another
    length than the most common one take no part. An empty table gives no rows.

    Distinct vectors are searched, not rows: equal vectors join in afterwards, each with its k + 1 smallest ids. The index is a
    fine k-means (:func:`clusters.kmeans_cells`): every vector is encoded once, by its residual from its coarse centroid.
    Near search: the rows of one fine cell are all gathered in one coarse cell, its centroid's, and search it. Far search: rows whose
    k-th best is below ``GATHER``, where ``least`` asks for such, and rows of fine cells too large to be gathered
    (``GATHERED``), ask in their ``FAR_PROBES`` nearest coarse cells, where every vector stands ``SPILL`` times. Coarse cells with more
    than ``vectors.SPLIT`` rows are split, so a dense group of any size is searched piece by piece. The codebook is fitted on at most
    ``CODEBOOK_ROWS`` vectors; all vectors are indexed and searched for.
    """
    spark = df.sparkSession
    empty = spark.createDataFrame([], "vec_id long, other_id long, similarity double, rank int")
    coders = []

    def encoder(sample: np.ndarray, coarse: np.ndarray):
        sample = sample[:CODEBOOK_ROWS]
        coders.append(AnisotropicCodes.fit(sample - coarse[V.nearest_seed(sample, coarse)[0]], sample))
        return coders[0].encode

    fine = clusters.kmeans_cells(df, vec_id, vector, GATHER, label, encoder, probes=FAR_PROBES)
    if fine is None:
        return empty
    shared = spark.sparkContext.broadcast((fine.coarse, coders[0]))
    large = fine.assigned.groupBy("label").count().filter(F.col("count") > GATHERED).select("label", F.lit(True).alias("large"))  # at most rows / GATHERED of them
    home = F.col("cells")[0].alias("home")
    placed = fine.assigned.join(F.broadcast(large), "label", "left")
    gathered = F.when(F.col("large"), F.col("cells")[0]).otherwise(F.col("home")).alias("cell")
    near = placed.select("rep", "vec", "code", home, gathered, F.coalesce("large", F.lit(False)).alias("large"))
    found = materialize(_gathered_search(near.drop("large"), shared, k, least), f"{label}-near")
    wide = near.filter("large").select("rep")  # seldom any
    if least < GATHER:
        enough = found.filter(F.col("similarity") >= GATHER).groupBy("rep").count().filter(F.col("count") >= k)
        wide = wide.unionByName(near.select("rep").join(enough, "rep", "left_anti")).distinct()
    wide = materialize(wide, f"{label}-wide")
    if wide.limit(1).count():
        asked = fine.assigned.join(wide, "rep", "left_semi").select("rep", "vec", F.explode("cells").alias("cell"))
        members = fine.assigned.select("rep", "vec", "code", home, F.explode(F.slice("cells", 1, SPILL)).alias("cell"))
        found = materialize(found.unionByName(_far_search(asked, members, shared, k, least)), f"{label}-far")
    best = found.distinct().withColumn("_r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("similarity"), "other_rep"))).filter(F.col("_r") <= k)
    best = materialize(best.select("rep", "other_rep", "similarity", F.col("_r").alias("rank")), f"{label}-best")

    # Equal vectors: only rows that have copies, or found some that have, are ranked again, with the k smallest ids of each.
    crowd = fine.copies.select("rep").distinct()
    touched = materialize(best.join(crowd.withColumnRenamed("rep", "other_rep"), "other_rep", "left_semi").select("rep").unionByName(crowd).distinct(), f"{label}-touched")
    alone = best.join(touched, "rep", "left_anti").select(F.col("rep").alias("vec_id"), F.col("other_rep").alias("other_id"), "similarity", "rank")
    more = fine.copies.withColumn("_r", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).filter(F.col("_r") <= k).drop("_r")
    again = best.join(touched, "rep", "left_semi")
    direct = again.select("rep", F.col("other_rep").alias("other_id"), "similarity")
    others = again.join(more.withColumnRenamed("rep", "other_rep"), "other_rep").select("rep", F.col("vec_id").alias("other_id"), "similarity")
    same = more.select("rep", F.col("vec_id").alias("other_id"), F.lit(1.0).alias("similarity"))
    itself = crowd.select("rep", F.col("rep").alias("other_id"), F.lit(1.0).alias("similarity"))
    per_rep = direct.unionByName(others).unionByName(same).unionByName(itself)
    per_rep = per_rep.withColumn("_r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("similarity"), "other_id"))).filter(F.col("_r") <= k + 1).drop("_r")
    mine = fine.with_copies(per_rep).filter("vec_id <> other_id")
    ranked = mine.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "other_id"))).filter(F.col("rank") <= k)
    return alone.unionByName(ranked.select("vec_id", "other_id", "similarity", "rank")).filter(F.col("similarity") >= least)
