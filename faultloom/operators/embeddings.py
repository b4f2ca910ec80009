"""Vectors of records: cache, service calls, normalising, combining fields."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import capped, strip

TRUNCATED_DIMS, FIELD_CHARS, BATCH = 1024, 6000, 64
CACHE = "cache_key string, model string, text_sha256 string, dim int, vector array<float>, created_at double"
Embedder = Callable[[list[str]], list[list[float]]]


def cache_key(text: Column, model: str, dimensions: int | None = None) -> Column:
    """Key of a text's embedding: hash of model, dimensions and text, apart by zero characters."""
    zero = F.char(F.lit(0))
    return F.sha2(F.concat(F.lit(model), zero, F.lit("" if dimensions is None else str(dimensions)), zero, text), 256)


def unit(v: Column) -> Column:
    """A vector at length 1, computed in doubles; zero vectors stay as they are, null stays null."""
    wide = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm)).otherwise(wide)


def truncated(v: Column, dims: int = TRUNCATED_DIMS) -> Column:
    """The first ``dims`` numbers of a vector; to be taken before normalising."""
    return F.slice(v, 1, dims)


def latest_cache(cache: DataFrame) -> DataFrame:
    """The newest entry per key, of equally new ones the one with the smallest text hash: what an upsert would leave."""
    return cache.groupBy("cache_key").agg(F.max_by(F.struct("model", "text_sha256", "dim", "vector", "created_at"), F.struct("created_at", "text_sha256")).alias("e")).select("cache_key", "e.*")


def cache_misses(texts: DataFrame, cache: DataFrame, model: str, dimensions: int | None = None) -> DataFrame:
    """Distinct ``cache_key, text`` that the cache lacks; equal texts are asked for once. Blank texts are never asked for."""
    keyed = texts.filter(strip(F.col("text")) != "").select(cache_key(F.col("text"), model, dimensions).alias("cache_key"), "text")
    return keyed.dropDuplicates(["cache_key"]).join(cache.select("cache_key"), "cache_key", "left_anti")


def embed_missing(misses: DataFrame, service: Callable[[], Embedder], model: str, batch: int = BATCH, attempts: int = 5, wait: float = 2.0) -> DataFrame:
    """Cache rows of the missing texts, from a service made once per task and called with ``batch`` texts at a time.

    A failed call is tried again after 2, 4, 8, 16 s; the task fails with the last error. Rows are the same if a task
    is run again, provided the service is deterministic. Fails if the service returns another number of vectors.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        call = service()
        for pdf in parts:
            for i in range(0, len(pdf), batch):
                some = pdf.iloc[i : i + batch]
                for n in range(attempts):
                    try:
                        vectors = call(some["text"].tolist())
                        break
                    except Exception:  # noqa: BLE001 - whatever a remote service raises
                        if n == attempts - 1:
                            raise
                        time.sleep(wait * 2**n)
                if len(vectors) != len(some):
                    raise ValueError(f"asked for {len(some)} vectors, got {len(vectors)}")
                hashes = [hashlib.sha256(t.encode()).hexdigest() for t in some["text"]]
                yield pd.DataFrame({"cache_key": some["cache_key"].to_numpy(), "model": model, "text_sha256": hashes, "dim": [len(v) for v in vectors], "vector": [np.asarray(v, np.float32) for v in vectors], "created_at": time.time()})

    return misses.mapInPandas(run, CACHE)


def hashed_embedder(dims: int = 64) -> Embedder:
    """A deterministic stand-in for a service: signed counts of a text's hashed words."""
    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            for w in t.split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % dims] += 1 if h >> 63 else -1
        return out.tolist()

    return embed


def field_texts_long(rows: DataFrame, id_column: str, fields: list[str], most: int = FIELD_CHARS) -> DataFrame:
    """``record_id, field, text`` of every non-blank field text, capped."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), capped(F.col(f"field_texts.{f}"), most).alias("text")) for f in fields])
    return rows.select(F.col(id_column).alias("record_id"), F.inline(entries)).filter(strip(F.col("text")) != "")


def combined(vectors: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """``key, vector``: the unit sum of each key's unit vectors (of ``dims`` numbers), summed in doubles.

    One sum per dimension, with map-side partial sums; groups of any size are never gathered.
    """
    normal = vectors.select(key, unit(truncated(F.col(vector), dims)).alias("v"))
    sums = normal.groupBy(key).agg(*[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dims)])
    return sums.select(key, F.transform(unit(F.array(*[f"s{i}" for i in range(dims)])), lambda x: x.cast("float")).alias("vector"))


def record_vectors(rows: DataFrame, cache: DataFrame, fields: list[str], model: str, dims: int, dimensions: int | None = None) -> DataFrame:
    """``record_id, vector`` of every record: its fields' cached vectors combined; a record without text gets the zero vector."""
    long = field_texts_long(rows, "record_id", fields).withColumn("cache_key", cache_key(F.col("text"), model, dimensions))
    found = combined(long.join(latest_cache(cache), "cache_key"), "record_id", "vector", dims)
    return rows.select("record_id").join(found, "record_id", "left").withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0).cast("float"), dims)))


def check_vectors(rows: DataFrame, vectors: DataFrame) -> None:
    """Fails if the records of two tables are not the same, naming up to ten that are missing or extra."""
    for what, a, b in (("missing", rows, vectors), ("extra", vectors, rows)):
        some = [r[0] for r in a.select("record_id").join(b.select("record_id"), "record_id", "left_anti").limit(10).collect()]
        if some:
            raise ValueError(f"{what} vectors: {', '.join(map(str, some))}")
