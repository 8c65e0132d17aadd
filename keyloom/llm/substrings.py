"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of every ``span - seed + 1`` neighbouring runs of ``seed`` words the
one with the smallest hash. Equal windows of ``span`` words choose equal anchors, so every repeat of
at least ``span`` words shares one. An anchor is extended both ways, ``span - seed`` words at most,
to its block: the words of all windows that chose it. Documents are joined on anchors in two steps,
each with minima combined before the exchange, so that a passage in any number of documents
costs each of them a row per block and no group of documents meets in one task:

1. Equal blocks: all windows of the block occur in the first document that holds the block.
2. Anchors with different blocks: the first holders of each block look up their windows one by one.

Both name, for a run of windows, the first document that holds them and where. Runs that follow each
other on one diagonal are joined, as far as both texts go on alike. The words of the first holder
are then brought to the document and compared word by word; equal runs of at least ``span`` words are
maximal repeats, and their words are removed.

Exact copies are found first by a 128-bit digest of the whole word sequence: only the copy with the
smallest id takes part, all words of the others (if they fill a window) are repeats.

Nulls: a null text has no words; a null doc_id ranks after all others. Texts shorter than a window
lose nothing. Rows that share an id (or have none) do not take words from each other, each is cut by
its own text. An empty table gives an empty result. Columns of any name may be there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import dealt, fresh, gram_hashes, hash_words, look_up, mix64, rows_of, store, text_key, words

SPAN, SEED = 50, 16
#: Passages that one row asks of a text, and documents that one copy of a passage is sent to.
ASKED, SENT = 4096, 1024
LAST = (1 << 63) - 1
_EMPTY = hashlib.sha256(b"").hexdigest()


def chosen(h: np.ndarray, span: int = SPAN, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(seed hash at each position, anchor position of each window): the rightmost smallest hash."""
    g = gram_hashes(h, seed)
    w = span - seed + 1
    if len(g) < w:
        return g, np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g[::-1], w)
    return g, len(g) - 1 - (view.argmin(1) + np.arange(len(view)))[::-1]


def blocks(h: np.ndarray, span: int = SPAN, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Per anchor: its hash, the hash of its block, the first window that chose it, their number."""
    g, at = chosen(h, span, seed)
    if not len(at):
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int32),) * 2
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))  # anchors never move left
    size = np.diff(np.append(first, len(at)))
    whole = gram_hashes(h, span)
    ends = whole[first] * np.uint64(3) + mix64(whole[first + size - 1])  # these two windows overlap
    place = (size + (at[first] - first) * span).astype(np.uint64)
    return g[at[first]], mix64(ends + mix64(place)), first.astype(np.int32), size.astype(np.int32)


def covered(n: int, runs: np.ndarray) -> np.ndarray:
    """Words of a text of n words that lie in one of the runs [from, to)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0], 1)
    np.add.at(edge, runs[:, 1], -1)
    return np.cumsum(edge[:n]) > 0


def alike(mine: list[bytes], other: list[bytes], span: int = SPAN) -> list[tuple[int, int]]:
    """Maximal runs of at least span equal words in two equally long lists."""
    if mine == other:
        return [(0, len(mine))] if len(mine) >= span else []
    same = np.array([False, *map(bytes.__eq__, mine, other), False])
    edge = np.flatnonzero(np.diff(same.view(np.int8))).reshape(-1, 2)
    return [(int(a), int(b)) for a, b in edge if b - a >= span]


def _digest(joined: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(joined)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


_SCAN = pa.schema([("id", pa.int64()), ("null_id", pa.bool_()), ("tk", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("h", pa.list_(pa.int64())), ("block", pa.list_(pa.int64())), ("size", pa.list_(pa.int32())), ("starts", pa.list_(pa.list_(pa.int32())))])


def _scan(span: int, seed: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, tk in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ws = words(text.as_py())
                joined = b" ".join(ws)
                h, block, start, size = blocks(hash_words(ws) if len(ws) >= span else np.empty(0, np.uint64), span, seed)
                at, starts = _once(block, start)
                rows.append((LAST if doc_id is None else doc_id, doc_id is None, tk, *_digest(joined), len(ws), hashlib.sha256(joined).hexdigest(), h[at].view(np.int64), block[at].view(np.int64), size[at], starts))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCAN)], schema=_SCAN)

    return work


def _once(key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each key of a text occurs first, and all its starts: what a text repeats within is one row."""
    if not len(key):
        return np.empty(0, np.int64), []
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    return order[new], np.split(start[order], new[1:])


def _windows(span: int):
    """Window hashes of the blocks that are asked for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, hashes = [], []
            for text, asked in zip(batch.column("text"), batch.column("asked"), strict=True):
                whole = gram_hashes(hash_words(words(text.as_py())), span)
                at = np.concatenate([np.arange(x["start"], x["start"] + x["size"], dtype=np.int32) for x in asked.as_py()])
                first, places = _once(whole[at], at)
                starts.append(places)
                hashes.append(whole[at[first]].view(np.int64))
            yield pa.RecordBatch.from_pydict({"rep": batch.column("rep"), "tk": batch.column("tk"), "w": pa.array(hashes, pa.list_(pa.int64())), "starts": pa.array(starts, pa.list_(pa.list_(pa.int32())))})

    return work


_ASK = "rep bigint, tk bigint, f bigint, ftk bigint, at int, n int, starts array<int>"


def _runs(span: int):
    """Windows found in first holders, joined to runs: one row per different passage asked of a holder."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("rep", "tk", "f", "ftk", "at", "n", "starts")}
            for rep, tk, found in zip(batch.column("rep").to_pylist(), batch.column("tk").to_pylist(), batch.column("found"), strict=True):
                x = found.values
                starts = x.field("starts")
                start = starts.flatten().to_numpy().astype(np.int64)
                many = np.diff(starts.offsets.to_numpy())
                f, ftk, at, size = (np.repeat(x.field(c).to_numpy(zero_copy_only=False).astype(np.int64), many) for c in ("f", "ftk", "at", "size"))
                o = np.lexsort((start, start - at, ftk, f))
                f, ftk, at, start, size = (v[o] for v in (f, ftk, at, start, size))
                go_on = (f[1:] == f[:-1]) & (ftk[1:] == ftk[:-1]) & (start[1:] - at[1:] == start[:-1] - at[:-1]) & (start[1:] <= start[:-1] + size[:-1])
                new = np.flatnonzero(np.append(True, ~go_on))
                n = np.maximum.reduceat(start + size, new) - start[new] + span - 1
                same: dict[tuple, list[int]] = {}
                for key, s in zip(zip(f[new].tolist(), ftk[new].tolist(), at[new].tolist(), n.tolist(), strict=True), start[new].tolist(), strict=True):
                    same.setdefault(key, []).append(s)
                for key, s in same.items():
                    for k, v in zip(out, (rep, tk, *key, s), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.list_(pa.int32()) if k == "starts" else pa.int32() if k in ("at", "n") else pa.int64()) for k, v in out.items()})

    return work


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages asked of a text."""
    for batch in batches:
        for f, ftk, text, asked in zip(batch.column("rep").to_pylist(), batch.column("tk").to_pylist(), batch.column("text"), batch.column("asked").to_pylist(), strict=True):
            ws = words(text.as_py())
            at, n = [x["at"] for x in asked], [x["n"] for x in asked]
            for i in range(0, len(at), 256):
                some = [b" ".join(ws[a : a + k]) for a, k in zip(at[i : i + 256], n[i : i + 256], strict=True)]
                yield pa.RecordBatch.from_pydict({"f": pa.array([f] * len(some), pa.int64()), "ftk": pa.array([ftk] * len(some), pa.int64()), "at": pa.array(at[i : i + 256], pa.int32()), "n": pa.array(n[i : i + 256], pa.int32()), "passage": pa.array(some, pa.binary())})


def _cut(span: int, with_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column("text"), batch.column("found"), strict=True):
                ws, runs = words(text.as_py()), []
                for x in found:
                    other = x["passage"].as_py().split()
                    for s in x["starts"].as_py():
                        runs += [(s + a, s + b) for a, b in alike(ws[s : s + len(other)], other, span)]
                gone = covered(len(ws), np.array(runs, np.int64).reshape(-1, 2))
                kept = b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                rows.append((int(gone.sum()), hashlib.sha256(kept).hexdigest(), edge.reshape(-1, 2).tolist(), kept.decode("utf-8", "surrogatepass") if with_text else None))
            types = {"n_removed": pa.int64(), "kept_sha256": pa.string(), "spans": pa.list_(pa.list_(pa.int64())), "kept": pa.string()}
            yield pa.RecordBatch.from_pydict({"rep": batch.column("rep"), "tk": batch.column("tk")} | {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(types.items())})

    return work


def _first_holders(rows: DataFrame, key: list[str]) -> DataFrame:
    """Per key: the first document that holds it (id, text key, start, size) and the number c of rows. The
    columns of one key are taken from one row, as each compares ids alone, in the same order."""
    first = [F.min_by(c, "rep").alias(as_) for c, as_ in (("tk", "ftk"), ("at", "at"), ("size", "size"))]
    return rows.withColumn("at", F.col("starts")[0]).groupBy(*key).agg(F.min("rep").alias("f"), *first, F.count("*").alias("c"))


def find_repeats(docs: DataFrame, span: int = SPAN, seed: int = SEED, with_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one
    space), spans (maximal repeats as [from, to) word positions), text_key, and with ``with_text`` kept, the
    kept words where some were removed. Spans and kept are null where nothing was removed."""
    if not seed <= span:
        raise ValueError("a seed is no longer than a span")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", text_key().alias("tk"))
    scanned = store(texts.mapInArrow(_scan(span, seed), "id bigint, null_id boolean, tk bigint, d1 bigint, d2 bigint, n_words bigint, sha string, h array<bigint>, block array<bigint>, size array<int>, starts array<array<int>>"), "scanned")
    first = scanned.groupBy("d1", "d2").agg(F.min(F.struct("id", "tk")).alias("r"), F.count("*").alias("c"))
    first = store(first.select("d1", "d2", F.col("r.id").alias("rep"), F.col("r.tk").alias("rtk"), "c"), "first")
    own = first.select("d1", "d2", F.col("rep").alias("id"), F.col("rtk").alias("tk"))
    mine = scanned.where(F.size("h") > 0).join(own, ["d1", "d2", "id", "tk"], "leftsemi")
    occ = store(mine.select(F.col("id").alias("rep"), "tk", F.inline(F.arrays_zip("h", "block", "size", "starts"))), "anchors")
    shared = occ.groupBy("h").agg(F.count("*").alias("c"), F.min("rep").alias("_a"), F.max("rep").alias("_z")).where("_a < _z").select("h", "c")
    occ = store(look_up(occ, store(shared, "shared_anchors"), ["h"], "c"), "blocks")

    # 1. equal blocks
    holders = store(_first_holders(occ, ["h", "block"]), "holders")
    again = look_up(occ, holders.where("c > 1").drop("size"), ["h", "block"], "c").where("f < rep").select("rep", "tk", "starts", "size", "f", "ftk", "at")
    # 2. windows of anchors with different blocks
    mixed = store(holders.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "mixed")
    open_ = look_up(holders.drop("c"), mixed, ["h"], "c")
    asked = open_.groupBy(F.col("f").alias("rep"), F.col("ftk").alias("tk")).agg(F.collect_set(F.struct(F.col("at").alias("start"), "size")).alias("asked"))
    keyed = texts.select(F.coalesce("doc_id", F.lit(LAST)).alias("rep"), "tk", "text")
    asked = store(asked, "asked")
    windows = store(rows_of(keyed, asked, ["rep", "tk"]).mapInArrow(_windows(span), "rep bigint, tk bigint, w array<bigint>, starts array<array<int>>"), "windows")
    windows = windows.select("rep", "tk", F.inline(F.arrays_zip("w", "starts"))).withColumn("size", F.lit(1))
    shared = store(_first_holders(windows, ["w"]).where("c > 1"), "shared")
    more = look_up(windows, shared.drop("size"), ["w"], "c").where("f < rep").select("rep", "tk", "starts", "size", "f", "ftk", "at")

    found = again.union(more).groupBy("rep", "tk").agg(F.collect_list(F.struct("f", "ftk", "at", "size", "starts")).alias("found"))
    asks = store(found.mapInArrow(_runs(span), _ASK), "asks")
    # the passages, cut from the texts of first holders, then sent to all that asked
    passage = ["f", "ftk", "at", "n"]
    wanted, _ = dealt(asks.select(*passage).distinct(), ["f", "ftk"], ASKED, ["at", "n"])
    wanted = store(wanted.groupBy(F.col("f").alias("rep"), F.col("ftk").alias("tk"), "_part").agg(F.collect_list(F.struct("at", "n")).alias("asked")), "wanted")
    passages = rows_of(keyed, wanted, ["rep", "tk"]).mapInArrow(_passages, "f bigint, ftk bigint, at int, n int, passage binary")
    asks, large = dealt(asks, passage, SENT, ["rep", "tk"])
    sent = passages.join(large, passage, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    brought = asks.join(sent, [*passage, "_part"]).groupBy("rep", "tk").agg(F.collect_list(F.struct("starts", "passage")).alias("found"))
    brought = store(brought, "brought")
    cut = rows_of(keyed, brought, ["rep", "tk"]).mapInArrow(_cut(span, with_text), "rep bigint, tk bigint, n_removed bigint, kept_sha256 string, spans array<array<bigint>>, kept string")
    cut = cut.dropDuplicates(["rep", "tk"]).select(F.col("rep").alias("id"), "tk", "n_removed", "kept_sha256", "spans", "kept")

    rows = look_up(scanned.drop("h", "block", "size", "starts"), first, ["d1", "d2"], "c").join(cut, ["id", "tk"], "left")
    copy = (F.col("id") > F.col("rep")) & (F.col("n_words") >= span)
    out = rows.select(
        F.when(~F.col("null_id"), F.col("id")).alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.array(F.array(F.lit(0).cast("bigint"), F.col("n_words")))).otherwise(F.col("spans")).alias("spans"),
        F.col("tk").alias("text_key"), F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )
    return out if with_text else out.drop("kept")


def strip(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """docs with repeats cut out of text; texts without repeats stay as they are, n_chars follows
    the text. A row is found again by its id and text, so rows that share an id are cut each by itself."""
    i, t, k = fresh(docs.columns, "_id", "_text_key", "_kept")
    cut = find_repeats(docs, span, with_text=True).where("kept is not null").dropDuplicates(["doc_id", "text_key"])
    cut = cut.select(F.col("doc_id").alias(i), F.col("text_key").alias(t), F.col("kept").alias(k))
    out = docs.join(cut, docs["doc_id"].cast("bigint").eqNullSafe(cut[i]) & (text_key() == cut[t]), "left")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(k).isNotNull(), F.char_length(k).cast("bigint")).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.coalesce(k, "text")).select(docs.columns)
