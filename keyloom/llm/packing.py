"""Packing documents into sequences by cutting-stock column generation.

Documents become token ids and a closing id; ids are cut into full sequences and a remainder.
Remainders are grouped by length, rounded up to a grid, and the histogram of lengths (at most
``length / grid`` numbers, whatever the corpus) is the demand of a cutting-stock problem: a linear
program over patterns of lengths that fit into one sequence. Its columns are generated on the
driver: a knapsack over the dual prices finds the pattern that improves most, until none does.
Pattern counts are rounded down and what is left of the histogram, a few pieces per pattern, is
packed by first fit. Patterns give each length class a list of slots; the r-th piece of a class
takes its r-th slot. Ranks come from counters within the tokenizing tasks and counts per task, so
no class is gathered anywhere.

A null text is empty and gives the closing id alone. Repeated rows are packed each. Rows with a
null doc_id are packed with it null. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import store

LENGTH, GRID, END = 2048, 8, 1
#: The string that the vocabulary's own file treats as one token.
SPECIAL = "<|endoftext|>"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, class int, task int, place bigint"


class Encoder:
    """Ids of the byte-level BPE. The ranks file of the same vocabulary is about four times faster
    than the JSON file and gives the same ids; texts with the special token's string go to the
    JSON file, whose rules for it apply."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast, self.json_path, self.exact = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), json_path, None

    def __call__(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.json_path)
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


_encoders: dict = {}


def encoder(paths: tuple) -> Encoder:
    if paths not in _encoders:
        _encoders[paths] = Encoder(*paths)
    return _encoders[paths]


def default_tokenizer() -> tuple:
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def pieces(docs: DataFrame, tokenizer: tuple, length: int = LENGTH, grid: int = GRID, with_ids: bool = False) -> DataFrame:
    """A row per piece, cut at multiples of ``length``; class is the length on the grid, place the
    number of earlier pieces of that class in the same task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, encode, place = TaskContext.get().partitionId(), encoder(tokenizer), np.zeros(length // grid + 2, np.int64)
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                for a in range(0, len(ids), length):
                    part = ids[a : a + length]
                    cls = -(-len(part) // grid)
                    rows.append((doc_id, a, len(part), zlib.crc32(part.tobytes()), len(ids), cls, task, int(place[cls]), part.tobytes()))
                    place[cls] += 1
                    held += len(part) * 4 * with_ids + 100
                if held > 8 << 20:
                    yield _piece_batch(rows, with_ids)
                    rows, held = [], 0
        yield _piece_batch(rows, with_ids)

    schema = PIECES + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, schema)


def _piece_batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("class", pa.int32()), ("task", pa.int32()), ("place", pa.int64())] + [("ids", pa.binary())] * with_ids
    return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(names)})


def price(dual: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable pattern: unbounded knapsack by dynamic programming over the capacity."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fit = np.searchsorted(sizes, c, side="right")
        best[c], pick[c] = best[c - 1], -1
        if fit:
            v = best[c - sizes[:fit]] + dual[:fit]
            i = int(v.argmax())
            if v[i] > best[c] + 1e-12:
                best[c], pick[c] = v[i], i
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= sizes[pick[c]]
    return best[capacity], pattern


def first_fit(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """A starting basis: greedy patterns, largest sizes first, each used until it exhausts a size,
    which no later pattern holds; so the columns are independent."""
    m, left, basis = len(sizes), demand.astype(float).copy(), np.eye(len(sizes))
    while (left > 0).any():
        pattern, room = np.zeros(m), capacity
        for i in range(m - 1, -1, -1):
            if left[i] > 0:
                pattern[i] = room // sizes[i]
                room -= pattern[i] * sizes[i]
        ratio = np.where(pattern > 0, left / np.maximum(pattern, 1), np.inf)
        out = int(ratio.argmin())
        left = np.where(left - ratio[out] * pattern > 1e-9 * demand, left - ratio[out] * pattern, 0)
        basis[:, out], left[out] = pattern, 0
    return basis


def times(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Matrix by vector without the threads of a BLAS, which can stall in a process that has forked
    (as the driver has, to start its JVM)."""
    return (a * v).sum(1)


def invert(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row exchanges; a has at most a few hundred rows."""
    m = len(a)
    w = np.concatenate([a.astype(float), np.eye(m)], axis=1)
    for i in range(m):
        j = i + int(np.abs(w[i:, i]).argmax())
        w[[i, j]] = w[[j, i]]
        w[i] /= w[i, i]
        f = w[:, i].copy()
        f[i] = 0
        w -= f[:, None] * w[i]
    return w[:, m:]


def cut_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, tolerance: float = 1e-3, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns (pieces of each size) and how often to use each; together they cover the demand
    exactly. Revised simplex with generated columns, stopped within ``tolerance`` of the optimum."""
    m = len(sizes)
    if not m:
        return []
    basis = first_fit(sizes, demand, capacity)
    inverse = invert(basis)
    x = np.maximum(times(inverse, demand), 0)
    center = sizes / capacity  # no pattern is worth more than 1 at these prices
    bound = float(center @ demand)
    for i in range(rounds):
        dual = inverse.sum(0)
        if x.sum() <= bound * (1 + tolerance):
            break
        for near in (0.9, 0.6, 0.0):  # prices are kept near the best feasible ones, else they swing
            mixed = np.maximum(near * center + (1 - near) * dual, 0)
            value, pattern = price(mixed, sizes, capacity)
            if value > 0 and mixed @ demand / max(value, 1) > bound:
                center, bound = mixed / max(value, 1), float(mixed @ demand / max(value, 1))
            if dual @ pattern > 1 + 1e-9:
                break
        else:
            break
        step = times(inverse, pattern)
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        basis[:, out] = pattern
        inverse[out] /= step[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        if i % 200 == 199:  # start the inverse afresh before rounding errors add up
            inverse = invert(basis)
            x = np.maximum(times(inverse, demand), 0)
    left, plan = demand.astype(np.int64).copy(), []
    for j in np.argsort(-x):
        pattern = basis[:, j].astype(np.int64)
        most = min((left[i] // pattern[i] for i in np.nonzero(pattern)[0]), default=0)
        n = int(min(np.floor(x[j] + 1e-9), most))
        if n > 0:
            plan.append((pattern, n))
            left -= n * pattern
    while left.sum():  # first fit decreasing, as many equal patterns at once as the rest allows
        pattern, room = np.zeros(m, np.int64), capacity
        for i in range(m - 1, -1, -1):
            pattern[i] = min(left[i], room // sizes[i])
            room -= pattern[i] * sizes[i]
        n = int(min(left[i] // pattern[i] for i in np.nonzero(pattern)[0]))
        plan.append((pattern, n))
        left -= n * pattern
    return plan


class Slots:
    """Where the r-th piece of a class goes, from the plan."""

    def __init__(self, sizes: np.ndarray, plan: list[tuple[np.ndarray, int]]):
        self.by_class: dict[int, tuple] = {}
        base = np.concatenate([[0], np.cumsum([n for _, n in plan])]).astype(np.int64)
        self.sequences = int(base[-1])
        for i, size in enumerate(sizes):
            used = [(p[i], n, base[j], int(p[i + 1 :].sum())) for j, (p, n) in enumerate(plan) if p[i]]
            each, times, first, before = (np.array(v, np.int64) for v in zip(*used, strict=True))
            self.by_class[int(size)] = (np.concatenate([[0], np.cumsum(each * times)]), each, first, before)

    def of(self, cls: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, slot in it) for ranks of a class."""
        ends, each, first, before = self.by_class[cls]
        j = np.searchsorted(ends, rank, side="right") - 1
        within = rank - ends[j]
        return first[j] + within // each[j], before[j] + within % each[j]


def pack(docs: DataFrame, tokenizer: tuple | None = None, length: int = LENGTH, grid: int = GRID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (little-endian
    unsigned 32-bit) with ``with_ids``."""
    cut = store(pieces(docs, tokenizer or default_tokenizer(), length, grid, with_ids), "pieces")
    counts = cut.groupBy("task", "class").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = store(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "counts")
    demand = {r[0]: r[1] for r in counts.groupBy("class").agg(F.sum("n")).collect()}  # at most length / grid rows
    whole = -(-length // grid)
    sizes = np.array(sorted(c for c in demand if c < whole), np.int64)
    slots = Slots(sizes, cut_stock(sizes, np.array([demand[c] for c in sizes], float), length // grid))
    ranked = cut.join(counts.select("task", "class", "base"), ["task", "class"]).withColumn("rank", F.col("base") + F.col("place")).drop("task", "base", "place")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            seq, slot = slots.sequences + rank, np.zeros(len(rank), np.int64)
            for c in np.unique(cls[cls < whole]):
                seq[cls == c], slot[cls == c] = slots.of(int(c), rank[cls == c])
            kept = {n: batch.column(n) for n in names}
            yield pa.RecordBatch.from_pydict(kept | {"sequence_id": pa.array(seq), "slot": pa.array(slot)})

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids + ", sequence_id bigint, slot bigint"
    placed = ranked.mapInArrow(work, schema)
    so_far = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(so_far), F.lit(0))).drop("slot")
