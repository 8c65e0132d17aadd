"""Vectors in shards: packing rows into per-shard indexes and streaming query blocks past them.

A stated query set is searched against all rows. Rows are dealt to shards of bounded size by a hash
of id and vector, so that rows which share an id spread; each shard becomes one index row; queries
are packed into blocks of bounded size and every shard reads every block. In a partition the rows arrive as index, block, block, ..., next
index, so a task holds one index and one block at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import store

RESULT = "query_id bigint, vec_id bigint, score {0}"


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v array<double>, dim) of vectors that are not null and hold finite numbers only."""
    v = F.col(embedding).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    out = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & F.col("vec_id").isNotNull())
    return out.where(~bad).withColumn("dim", F.size("v"))


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy()
    v = table.column("v").combine_chunks()
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return ids, v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def dealt(df: DataFrame, counts: dict[int, int], size: int) -> tuple[DataFrame, dict[int, int]]:
    """Adds ``part``, a bucket of about ``size`` rows of equal dimension; also buckets per dimension."""
    parts = {dim: -(-n // size) for dim, n in counts.items()}
    number: Column = F.lit(1)
    for dim, n in parts.items():
        number = F.when(F.col("dim") == dim, F.lit(n)).otherwise(number)
    return df.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), number).cast("int")), parts


def packed(df: DataFrame, build: Callable[[np.ndarray, np.ndarray], object]) -> DataFrame:
    """One row (dim, part, blob) per bucket, blob being what build makes of its ids and vectors."""

    def make(table: pa.Table) -> pa.Table:
        ids, v = matrix(table)
        return pa.table({"dim": pa.array([v.shape[1]], pa.int32()), "part": pa.array([table.column("part")[0].as_py()], pa.int32()), "blob": pa.array([pickle.dumps(build(ids, v))], pa.binary())})

    return df.groupBy("dim", "part").applyInArrow(make, "dim int, part int, blob binary")


def search(shards: DataFrame, parts: dict[int, int], blocks: DataFrame, run: Callable, schema: str, seed_only: bool = False) -> DataFrame:
    """Stream blocks past shards. run(index, block) gives a dict of columns. With seed_only each
    block meets one shard (of its dimension) only."""
    number: Column = F.lit(1)
    for dim, n in parts.items():
        number = F.when(F.col("dim") == dim, F.lit(n)).otherwise(number)
    shard = F.array(F.pmod(F.col("part"), number)) if seed_only else F.sequence(F.lit(0), number - 1)
    asked = blocks.select("dim", F.explode(shard.cast("array<int>")).alias("part"), F.lit(1).alias("kind"), "blob")
    stream = shards.select("dim", "part", F.lit(0).alias("kind"), "blob").union(asked)
    stream = stream.repartition("dim", "part").sortWithinPartitions("dim", "part", "kind")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
                if kind == 0:
                    index = pickle.loads(blob.as_py())
                else:
                    yield pa.RecordBatch.from_pydict(run(index, pickle.loads(blob.as_py())))

    return stream.mapInArrow(work, schema)


def counts_of(df: DataFrame) -> dict[int, int]:
    """Rows per dimension."""
    return {r[0]: r[1] for r in df.groupBy("dim").count().collect()}


def prepare(vectors: DataFrame, vec_id: str, embedding: str, every: int, shard_size: int, block_size: int, build: Callable, build_block: Callable) -> tuple[DataFrame, dict[int, int], DataFrame]:
    """Written shard indexes, their number per dimension, and query blocks (ids divisible by ``every``)."""
    rows = usable(vectors, vec_id, embedding)
    asked = rows.where(F.col("vec_id") % every == 0)
    data, parts = dealt(rows, counts_of(rows), shard_size)
    shards = store(packed(data, build), "shards")
    queries, _ = dealt(asked, counts_of(asked), block_size)
    return shards, parts, store(packed(queries, build_block), "blocks")
