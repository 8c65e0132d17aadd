"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph per shard.

A shard's distinct vectors are the graph's nodes (copies are listed on their node, so that a
common vector cannot fill every neighbour list). Levels are drawn from a hash of the id with the
usual geometric law. Nodes are inserted in a hashed order, in batches that grow with the graph up to
``BATCH`` nodes: a node goes down greedily to its own level and from there on searches each level
with a beam, as a query does; its candidates are what the beam holds and the nodes of its batch
before it, so that building costs a search a node and never compares all pairs of a shard. The
neighbour heuristic keeps a candidate only if it is nearer to the node than to every neighbour kept
before, and fills the list with the nearest left out. Links go both ways; a list that overflows is
chosen anew in the same way. Neighbours are stored as flat arrays, -1 where a list is short. A search
goes down the levels greedily and ends with a beam on the bottom level; all queries of a block
advance together. Shard results are merged by score.

Vectors that are null, zero or hold null or non-finite components take no part; neither do rows
without an id. A query's own id is never a candidate. Ties go to the smaller id among those found.
An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import mix64
from keyloom.llm.shards import prepare, search

SHARD, BLOCK = 4096, 512
LINKS, BEAM, BUILD_BEAM, BATCH = 16, 128, 64, 256
#: A beam opens so many of its nodes at a time.
AHEAD = 8


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaling by the largest component first keeps tiny and huge ones exact enough."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return (unit(a) * unit(b)).sum(-1)


class Graph:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, links: int = LINKS):
        live = np.abs(vectors).max(1) > 0
        ids, vectors = ids[live], vectors[live]
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        _, first, node = np.unique(vectors.view([("", vectors.dtype)] * vectors.shape[1]).ravel() if len(ids) else np.empty(0), return_index=True, return_inverse=True)
        # nodes in insertion order, drawn from a hash of the first id; level l with probability links ** -l
        drawn = mix64(ids[first].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        turn = np.argsort(drawn, kind="stable")
        first, node = first[turn], np.argsort(turn)[node]
        self.vectors = vectors[first]
        self.unit = unit(self.vectors) if len(first) else self.vectors
        by_node = np.argsort(node, kind="stable")
        self.members, self.starts = ids[by_node], np.searchsorted(node[by_node], np.arange(len(first) + 1))
        u = (mix64(drawn[turn] ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(11)).astype(float) / float(1 << 53)
        level = np.floor(-np.log(np.maximum(u, 1e-9)) / np.log(links)).astype(int)
        self.entry = int(np.argmax(level)) if len(first) else -1
        self._build(level, links)

    def _build(self, level: np.ndarray, links: int) -> None:
        n, top = len(self.unit), int(level.max(initial=0))
        #: from the top level to the bottom one: flat neighbour array over all nodes, or -1
        self.layers = [np.full((n, links if at else 2 * links), -1, np.int32) for at in range(top, -1, -1)]
        a = 0
        while a < n:
            b = min(n, a + max(1, min(BATCH, a // 2)))
            self._insert(np.arange(a, b), level, links)
            a = b

    def _insert(self, new: np.ndarray, level: np.ndarray, links: int) -> None:
        """Links nodes to those inserted before, the first of them, and to each other."""
        old, u = int(new[0]), self.unit[new]
        start = int(np.argmax(level[:old])) if old else -1  # a node of the highest level so far
        here = np.full((len(new), 1), start)
        sims = np.full((len(new), 1), -2.0) if start < 0 else (u @ self.unit[start])[:, None]
        among = u @ u.T
        among[np.arange(len(new))[None, :] >= np.arange(len(new))[:, None]] = -2  # only those of the batch before
        for layer, at in zip(self.layers, range(len(self.layers) - 1, -1, -1), strict=True):
            if start >= 0 and at <= level[start]:
                passing, rows = np.flatnonzero(level[new] < at), np.flatnonzero(level[new] >= at)
                here[passing, 0], sims[passing, 0] = self._descend(layer, u[passing], here[passing, 0], sims[passing, 0])
                found, near = self._beam(layer, u[rows], here[rows], sims[rows], BUILD_BEAM)
                wide = max(here.shape[1], found.shape[1])
                here, sims = (np.pad(x, ((0, 0), (0, wide - x.shape[1])), constant_values=v) for x, v in ((here, -1), (sims, -2.0)))
                here[rows], sims[rows] = found, near
            rows = np.flatnonzero(level[new] >= at)
            if not len(rows):
                continue
            cand = np.concatenate([here[rows], np.broadcast_to(new[rows], (len(rows), len(rows)))], 1)
            near = np.concatenate([sims[rows], among[np.ix_(rows, rows)]], 1)
            chosen = self._choose(np.where(near > -2, cand, -1), near, links)
            layer[new[rows], : chosen.shape[1]] = chosen
            self._link_back(layer, new[rows], chosen)

    def _choose(self, cand: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` neighbours a row out of candidates (-1 for none) with similarities ``near``."""
        order = np.argsort(np.where(cand >= 0, -near, 3), axis=1, kind="stable")[:, : 4 * most]
        cand, near = np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1)
        real, wide = cand >= 0, cand.shape[1]
        kept = np.zeros(cand.shape, bool)
        for a in range(0, len(cand), 64):
            part = slice(a, a + 64)
            v = self.unit[cand[part]]
            among = v @ v.transpose(0, 2, 1)
            for j in range(wide):  # nearer to the node than to every neighbour kept so far
                kept[part, j] = real[part, j] & (np.where(kept[part], among[:, :, j], -2).max(1) < near[part, j]) & (kept[part].sum(1) < most)
        order = np.argsort(np.where(kept, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :most]
        return np.take_along_axis(cand, order, 1)

    def _link_back(self, layer: np.ndarray, src: np.ndarray, chosen: np.ndarray) -> None:
        most = layer.shape[1]
        ok = chosen >= 0
        src, dst = np.repeat(src, chosen.shape[1])[ok.ravel()], chosen[ok]
        if not len(dst):
            return
        order = np.lexsort((src, dst))
        src, dst = src[order], dst[order]
        to, first, many = np.unique(dst, return_index=True, return_counts=True)
        table = np.full((len(to), most + int(many.max())), -1)
        table[:, :most] = layer[to]
        table[np.repeat(np.arange(len(to)), many), most + np.arange(len(dst)) - np.repeat(first, many)] = src
        over = (table >= 0).sum(1) > most
        fits = np.take_along_axis(table, np.argsort(table < 0, axis=1, kind="stable")[:, :most], 1)
        layer[to[~over]] = fits[~over]
        for a in range(0, int(over.sum()), 64):
            at = np.flatnonzero(over)[a : a + 64]
            near = np.einsum("qkd,qd->qk", self.unit[table[at]], self.unit[to[at]])
            layer[to[at]] = self._choose(table[at], near, most)

    def _descend(self, layer: np.ndarray, q: np.ndarray, here: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy steps of each row of q on one level, until no neighbour is nearer."""
        here, sim = here.copy(), sim.copy()
        moving = np.arange(len(q))
        while len(moving):
            near = layer[here[moving]]
            s = np.where(near >= 0, np.einsum("qkd,qd->qk", self.unit[near], q[moving]), -2)
            top = s.argmax(1)
            better = s[np.arange(len(moving)), top] > sim[moving]
            moving, top, near, s = moving[better], top[better], near[better], s[better]
            here[moving], sim[moving] = near[np.arange(len(moving)), top], s[np.arange(len(moving)), top]
        return here, sim

    def _beam(self, layer: np.ndarray, q: np.ndarray, here: np.ndarray, sim: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) per row of q, best first, -1 where fewer, from different nodes ``here``."""
        m, wide = len(q), min(beam, here.shape[1])
        seen = np.zeros((m, len(self.unit)), bool)
        nodes, sims, done = np.full((m, beam), -1), np.full((m, beam), -2.0), np.ones((m, beam), bool)
        nodes[:, :wide], sims[:, :wide], done[:, :wide] = here[:, :wide], sim[:, :wide], here[:, :wide] < 0
        seen[np.arange(m)[:, None], np.where(here < 0, here[:, :1], here)] = True
        rows = np.arange(m)
        while True:
            waiting = np.where(done[rows], -3.0, sims[rows])
            rows, waiting = (x[waiting.max(1, initial=-3) > -3] for x in (rows, waiting))
            if not len(rows):
                break
            at = rows[:, None]
            pick = np.argpartition(-waiting, AHEAD - 1, axis=1)[:, :AHEAD] if beam > AHEAD else np.broadcast_to(np.arange(beam), (len(rows), beam))
            open_ = ~done[at, pick]
            done[at, pick] = True
            near = np.where(open_[:, :, None], layer[nodes[at, pick]], -1).reshape(len(rows), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1  # neighbours that the nodes opened have in common
            fresh = (near >= 0) & ~seen[at, near]
            wide = max(1, int(fresh.sum(1).max()))
            order = np.argsort(~fresh, axis=1, kind="stable")[:, :wide]
            near, fresh = np.take_along_axis(near, order, 1), np.take_along_axis(fresh, order, 1)
            seen[np.repeat(rows, fresh.sum(1)), near[fresh]] = True
            s = np.where(fresh, (self.unit[near] @ q[rows][:, :, None])[:, :, 0], -2.0)
            allsims = np.concatenate([sims[rows], s], 1)
            order = np.argpartition(-allsims, beam - 1, axis=1)[:, :beam]
            sims[rows] = np.take_along_axis(allsims, order, 1)
            nodes[rows] = np.take_along_axis(np.concatenate([nodes[rows], np.where(fresh, near, -1)], 1), order, 1)
            done[rows] = np.take_along_axis(np.concatenate([done[rows], ~fresh], 1), order, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)

    def find(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) per row of unit vectors q, best first, -1 where fewer."""
        here = np.full(len(q), self.entry)
        sim = q @ self.unit[self.entry]
        for layer in self.layers[:-1]:
            here, sim = self._descend(layer, q, here, sim)
        return self._beam(self.layers[-1], q, here[:, None], sim[:, None], beam)


def _run(k: int, beam: int):
    def run(g: Graph, block: tuple) -> dict:
        qids, q = block
        out: list[tuple] = []
        if len(g.unit) and len(qids):
            nodes, _ = g.find(unit(q), beam)
            for qid, v, found in zip(qids, q, nodes, strict=True):
                found = found[found >= 0][: k + 1]
                exact = cosine(g.vectors[found], np.broadcast_to(v, (len(found), len(v))))
                mine = [(-s, i) for x, s in zip(found, exact, strict=True) for i in g.members[g.starts[x] : min(g.starts[x + 1], g.starts[x] + k + 1)] if i != qid]
                out += [(qid, i, -s) for s, i in sorted(mine)[:k]]
        cols = list(zip(*out, strict=True)) if out else [(), (), ()]
        return {"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())}

    return run


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding", beam: int = BEAM, links: int = LINKS, shard_size: int = SHARD, block_size: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for the queries whose id is divisible by ``every``."""

    def build(ids: np.ndarray, v: np.ndarray) -> Graph:
        return Graph(ids, v, links)

    def block(ids: np.ndarray, v: np.ndarray) -> tuple:
        live = np.abs(v).max(1) > 0
        return ids[live], v[live]

    shards, parts, blocks = prepare(vectors, vec_id, embedding, every, shard_size, block_size, build, block)
    found = search(shards, parts, blocks, _run(k, beam), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
