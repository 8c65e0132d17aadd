"""Exact top-k inner product over KD-trees, one per shard.

A tree splits at the median of its widest dimension down to small leaves and keeps the tight box
of every node. For a query the largest inner product inside a box is the sum over dimensions of
the larger of q * low and q * high; a node whose bound is below the query's k-th best score is
left out. Leaves are visited best bound first. The k-th score is carried on: each query first
searches one shard, and all shards then start with the k-th score found there.

Components are turned into floor(scale * x). Vectors that are null or hold null or non-finite
components take no part; neither do rows without an id. Vectors only meet vectors of their own
length. A query's own id is never a candidate. Ties go to the smaller id; repeated rows with one id
count as two candidates. Scores beyond a long are held at its limits. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import store
from keyloom.llm.shards import prepare, search

LEAF = 64
SHARD, BLOCK = 8192, 512
#: Below this, doubles hold every partial sum exactly.
_SAFE = 1 << 48
_LONG = (1 << 63) - 1


def _whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles where that is exact, else as Python integers."""
    f = np.floor(x * scale)
    return f if not f.size or np.abs(f).max() < 1 << 52 else np.vectorize(int, otypes=[object])(f)


class Tree:
    """Heap-ordered median tree: node i has children 2i + 1 and 2i + 2; all leaves lie on one level."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        ids, vectors = ids[by_id], vectors[by_id]
        self.levels = max(0, int(np.ceil(np.log2(max(1, len(ids)) / LEAF))))
        ranges, order = [(0, len(ids))], np.arange(len(ids))
        for node in range((1 << self.levels) - 1):
            a, b = ranges[node]
            mid = (a + b) // 2
            part = vectors[order[a:b]]
            if b - a > 1:
                axis = int(np.argmax((part.max(0) - part.min(0)).astype(float)))
                order[a:b] = order[a:b][np.argsort(part[:, axis], kind="stable")]
            ranges += [(a, mid), (mid, b)]
        self.ids, self.vectors, self.order, self.ranges = ids, vectors, order, ranges
        none = np.zeros(vectors.shape[1], vectors.dtype)
        self.low = np.array([vectors[order[a:b]].min(0) if b > a else none for a, b in ranges])
        self.high = np.array([vectors[order[a:b]].max(0) if b > a else none for a, b in ranges])

    def bounds(self, q: np.ndarray, nodes: slice) -> np.ndarray:
        return np.maximum(q, 0) @ self.high[nodes].T + np.minimum(q, 0) @ self.low[nodes].T

    def top(self, qids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score) of up to k best per query with score >= floor."""
        peak = (max((abs(int(x)) for x in (self.vectors.max(), self.vectors.min())), default=0) * max(abs(int(q.max())), abs(int(q.min()))) * q.shape[1]) if len(q) else 0
        wide = peak >= _SAFE or q.dtype == object or self.vectors.dtype == object
        span = 1 << max(14, len(self.ids).bit_length())
        wide = wide or peak >= 1 << 61 - span.bit_length()  # score * span stays above the marker for none
        if wide:
            self.vectors, self.low, self.high = (x if x.dtype == object else np.vectorize(int, otypes=[object])(x) for x in (self.vectors, self.low, self.high))
            q = q if q.dtype == object else np.vectorize(int, otypes=[object])(q)
        kind = object if wide else np.int64
        lowest = -(1 << 200) if wide else -(1 << 62)
        best = np.full((len(q), k), lowest, kind)  # score * span + (span - 1 - position): larger is better
        kth = floor.astype(kind)
        alive, at = np.ones((len(q), 1), bool), 0
        for level in range(self.levels + 1):  # bounds go down the tree as far as they can matter
            nodes = slice(at, at + (1 << level))
            bound = self.bounds(q, nodes)
            bound = bound if wide else bound.astype(np.int64)
            alive = (np.repeat(alive, 2, 1) if level else alive) & (bound >= kth[:, None])
            at = nodes.stop
        first = (1 << self.levels) - 1
        bound = np.where(alive, bound, lowest)
        ahead = np.argsort(-bound, axis=1, kind="stable")
        rows = np.arange(len(q))
        for turn in range(ahead.shape[1]):
            leaf = ahead[:, turn]
            go = rows[(bound[rows, leaf] >= kth) & alive[rows, leaf]]
            if not len(go):
                break
            for x in np.unique(leaf[go]):
                a, b = self.ranges[first + x]
                mine, members = go[leaf[go] == x], self.order[a:b]
                if not len(members):
                    continue
                score = q[mine] @ self.vectors[members].T
                score = score if wide else score.astype(np.int64)
                key = score * span + (span - 1 - members)
                key[(score < kth[mine, None]) | (self.ids[members][None, :] == qids[mine, None])] = lowest
                both = np.concatenate([best[mine], key], axis=1)
                best[mine] = np.sort(both, axis=1)[:, -k:] if wide else np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                least = best[mine].min(1)
                kth[mine] = np.maximum(kth[mine], np.where(least > lowest, least // span, kth[mine]))
        r, c = np.nonzero(best > lowest)
        found = best[r, c]
        score = found // span
        return r, self.ids[(span - 1 - (found - score * span)).astype(np.int64)], score


def _search(k: int, seed: bool):
    def run(tree: Tree, block: tuple) -> dict:
        qids, q, floor = block
        r, ids, score = tree.top(qids, q, k, floor)
        score = np.array([min(max(int(s), -_LONG - 1), _LONG) for s in score], np.int64) if score.dtype == object else score
        return {"query_id": pa.array(qids[r], pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.int64())}

    def seeded(tree: Tree, block: tuple) -> dict:
        import pickle

        qids, q, floor = block
        r, _, score = tree.top(qids, q, k, floor)
        for i in range(len(qids)):
            mine = score[r == i]
            if len(mine) >= k:
                floor[i] = max(floor[i], mine.min())
        return {"dim": pa.array([q.shape[1]], pa.int32()), "part": pa.array([0], pa.int32()), "blob": pa.array([pickle.dumps((qids, q, floor))], pa.binary())}

    return seeded if seed else run


def exact_top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding", shard_size: int = SHARD, block_size: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for the queries whose id is divisible by ``every``."""
    if shard_size > SHARD:
        raise ValueError(f"a shard holds at most {SHARD} rows on average")

    def build(ids: np.ndarray, v: np.ndarray) -> Tree:
        return Tree(ids, _whole(v, scale))

    def block(ids: np.ndarray, v: np.ndarray) -> tuple:
        return ids, _whole(v, scale), np.full(len(ids), -(1 << 61), np.int64).astype(object if _whole(v, scale).dtype == object else np.int64)

    shards, parts, blocks = prepare(vectors, vec_id, embedding, every, shard_size, block_size, build, block)
    blocks = store(search(shards, parts, blocks, _search(k, True), "dim int, part int, blob binary", seed_only=True), "seeded")
    found = search(shards, parts, blocks, _search(k, False), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""
