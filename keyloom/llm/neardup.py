"""Near-duplicate groups by MinHash with tensored banding, candidates verified on full sets.

Table keys are pairs: ``m`` hashes from a left collection and ``m`` from a right one, each made of
three minhashes, give ``m * m`` tables of six minhashes from ``6 m`` instead of ``6 m * m`` minhash
computations. Of the 16 * 16 tables every third is used (left and right number add up to a multiple
of three): a pair at similarity 0.8 then shares no key with probability below 1e-4, at 0.85 below
4e-6, as with all tables of 14 * 14, for less than half the rows. A key pair can only be shared if
both of its halves are, so halves that occur once are dropped before pairs are formed, and most
documents never form any.

Texts with equal sets are one node (128-bit digest of the set; the smallest id stands for them).
Candidates are made without listing all pairs of a key: first every node meets the smallest node
among those it shares keys with, then the smallest node of each of its keys; nodes found linked
are joined into components. Only keys whose nodes are still in different components are looked at
again, pair by pair across components: small ones (at most ``SMALL`` nodes) at once, large ones in
blocks of about ``BLOCK`` nodes outside the key's largest component against ``BLOCK`` of all its
nodes. Large keys are read once: of each two components the ``FEW`` likeliest pairs are listed, the
likeliest confirmed first, then the others; only of components that had more than ``FEW`` likely
pairs with another and are still apart from it, the nodes are compared again, pair by pair. A candidate is left out if the sizes exclude a link, if
fewer than ``AGREE`` of its 96 minhashes agree (at similarity 0.8 that has probability below 1e-7)
or, in large keys, if the parities of the two sets in ``BITS`` classes differ in more classes than
a link leaves differing shingles (no link is lost by that). Every other candidate is confirmed on
the full shingle sets: 100 * intersection >= ``percent`` * union.

Nulls: a null text has no shingles and links with nothing; a row with a null doc_id links with
nothing and has null component and kept. Rows that share an id are told apart by their text: sharing
an id is no link, and each is kept or goes by its own text. Rows repeated with id and text count as
one document. An empty table gives an empty result. Columns of any name may be there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import FEW_KEYS, components, global_rank, gram_hashes, hash_words, look_up, mix64, rows_of, store, text_key, without, words

SIDE, DEPTH, EVERY = 16, 3, 3
SMALL, AGREE = 48, 54
BLOCK, BITS, FEW = 2048, 2048, 64
#: A pair brings two shingle sets; it counts as so many short rows.
SETS = 128
_LINES = np.arange(1, 2 * SIDE * DEPTH + 1, dtype=np.uint64)
_A, _B = ((mix64(_LINES + np.uint64(i << 32)) >> np.uint64(32)).astype(np.uint32) for i in (0, 1))
_A |= np.uint32(1)


def shingles(ws: list[bytes], k: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of k words; of the whole sequence if it is shorter."""
    if not ws:
        return np.empty(0, np.uint64)
    h = hash_words(ws)
    return np.unique(gram_hashes(h, min(k, len(ws)))) + np.uint64(k - min(k, len(ws)))


def minhashes(s: np.ndarray) -> np.ndarray:
    """Minima of a * x + b mod 2 ** 32 over the upper halves x of the shingle hashes."""
    x, low = (s >> np.uint64(32)).astype(np.uint32), np.full(len(_A), ~np.uint32(0))
    for at in range(0, len(x), 1 << 12):
        low = np.minimum(low, (_A[:, None] * x[at : at + (1 << 12)] + _B[:, None]).min(1))
    return low


def halves(low: np.ndarray) -> np.ndarray:
    """Left then right keys of ``DEPTH`` minhashes each; the lowest five bits hold the number."""
    key = np.arange(2 * SIDE, dtype=np.uint64)
    for column in low.reshape(2 * SIDE, DEPTH).T:
        key = mix64(key * np.uint64(3) + column)
    return (key & ~np.uint64(31)) | np.arange(2 * SIDE, dtype=np.uint64)


def parity(s: np.ndarray) -> bytes:
    """Of each of ``BITS`` classes of shingles, whether the set holds an odd number: two sets differ
    in at least as many shingles as their parities in bits."""
    odd = np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


_SCAN = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("halves", pa.list_(pa.int64())), ("sketch", pa.binary()), ("parity", pa.binary())])


def _scan(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, tk in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                s = shingles(words(text.as_py(), lower=True), k)
                d = xxhash.xxh3_128_digest(s.tobytes())
                low = minhashes(s) if len(s) else None
                rows.append((doc_id, tk, len(s), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), halves(low).view(np.int64) if len(s) else [], (mix64(low.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16).tobytes() if len(s) else b"", parity(s) if len(s) else b""))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCAN)], schema=_SCAN)

    return work


def _sets(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(words(t.as_py(), lower=True), k).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "s": pa.array(sets, pa.binary())})

    return work


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of which enough of the sketch agrees."""
    for batch in batches:
        side = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, len(_A)) for c in ("sa", "sb")]
        good = (side[0] == side[1]).sum(1) >= AGREE
        yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(pa.array(good)) for c in ("a", "b")})


def _within(percent: int):
    """Likely pairs (a > b) of different components among the nodes of each key; at most SMALL nodes each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column("g")
            v = g.values
            node, label, n = (v.field(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "n"))
            sketch = np.frombuffer(b"".join(v.field("sketch").to_pylist()), np.uint16).reshape(-1, len(_A))
            at, found = g.offsets.to_numpy(), [np.empty((2, 0), np.int64)]
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                own, of, size = node[lo:hi, None], label[lo:hi, None], n[lo:hi, None]
                a, b = np.nonzero((own > own.T) & (of != of.T) & (100 * np.minimum(size, size.T) >= percent * np.maximum(size, size.T)))
                good = (sketch[lo:hi][a] == sketch[lo:hi][b]).sum(1) >= AGREE
                found.append(np.stack([node[lo:hi][a[good]], node[lo:hi][b[good]]]))
            yield pa.RecordBatch.from_pydict(dict(zip("ab", np.concatenate(found, axis=1), strict=True)))

    return work


def _across(percent: int, top: int | None):
    """Likely pairs (a > b) with the labels of their components, between the nodes outside the
    largest component (role 2) and all nodes (role 1; 3 is both) of each block; ``top`` of each two components."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column("g")
            v = g.values
            role, node, label, n = (v.field(c).to_numpy(zero_copy_only=False) for c in ("role", "node", "label", "n"))
            sketch = np.frombuffer(b"".join(v.field("sketch").to_pylist()), np.uint16).reshape(-1, len(_A))
            bits = np.frombuffer(b"".join(v.field("parity").to_pylist()), np.uint64).reshape(-1, BITS // 64)
            at, found = g.offsets.to_numpy(), [np.empty((5, 0), np.int64)]
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                mine, others = lo + np.flatnonzero(role[lo:hi] & 2), lo + np.flatnonzero(role[lo:hi] & 1)
                block = [np.empty((5, 0), np.int64)]
                for i in mine:
                    j = others[label[others] != label[i]]
                    j = j[100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])]
                    apart = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
                    near = apart * (100 + percent) <= (100 - percent) * (n[i] + n[j])
                    j, apart = j[near], apart[near]
                    good = (sketch[i] == sketch[j]).sum(1) >= AGREE
                    j, apart = j[good], apart[good]
                    block.append(np.stack([np.maximum(node[i], node[j]), np.minimum(node[i], node[j]), np.maximum(label[i], label[j]), np.minimum(label[i], label[j]), apart * 10_000 // (n[i] + n[j])]))
                found.append(_likeliest(np.concatenate(block, axis=1), top))
            yield pa.RecordBatch.from_pydict(dict(zip(("a", "b", "la", "lb", "apart"), np.concatenate(found, axis=1), strict=True)))

    return work


def _likeliest(pairs: np.ndarray, top: int | None) -> np.ndarray:
    """Of the columns a, b, la, lb, apart the ``top`` least apart for each two labels."""
    if top is None or not pairs.shape[1]:
        return pairs
    pairs = pairs[:, np.lexsort((pairs[1], pairs[0], pairs[4], pairs[3], pairs[2]))]
    new = np.append(True, (pairs[2:4, 1:] != pairs[2:4, :-1]).any(0))
    at = np.arange(pairs.shape[1])
    return pairs[:, at - np.maximum.accumulate(np.where(new, at, 0)) < top]


def _confirmed(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")})

    return work


class _Links:
    """Confirms candidate pairs (a > b) of nodes; the shingle sets of nodes that share a key are made once."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, sharing: DataFrame, k: int, percent: int):
        self.nodes, self.percent = nodes, percent
        wanted = nodes.select("node", "id", "tk").join(sharing, "node", "leftsemi")
        sets = rows_of(texts, wanted, ["id", "tk"]).dropDuplicates(["id", "tk"]).mapInArrow(_sets(k), "node bigint, s binary")
        self.sets = store(sets, "sets")
        self.tried: DataFrame | None = None

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Candidates that sizes and sketches allow."""
        side = lambda c, x: self.nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(x))
        both = pairs.join(side("a", "sa"), "a").join(side("b", "sb"), "b")
        both = both.where(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb"))
        return both.select("a", "b", "sa", "sb").mapInArrow(_agreeing, "a bigint, b bigint")

    def within(self, rows: DataFrame) -> DataFrame:
        """Likely pairs across the components of each small key."""
        full = rows.join(self.nodes.select("node", "n", "sketch"), "node").groupBy("key").agg(F.collect_list(F.struct("node", "label", "n", "sketch")).alias("g"))
        return full.select("g").mapInArrow(_within(self.percent), "a bigint, b bigint").distinct()

    def across(self, rows: DataFrame, top: int | None) -> DataFrame:
        """Likely pairs (a, b, la, lb, r) across the components of each large key, at most ``top`` of each two
        components, r counting them from the likeliest. The nodes outside the key's largest component are dealt over p chunks, all
        nodes over q, and p * q blocks compared."""
        size = rows.groupBy("key", "label").agg(F.count("*").alias("_n")).groupBy("key").agg(F.max(F.struct("_n", "label")).alias("_m"), F.sum("_n").alias("_all")).where("_all > _m._n")
        chunks = lambda x: F.ceil(x / BLOCK).cast("int")
        size = size.select("key", F.col("_m.label").alias("_main"), chunks(F.col("_all") - F.col("_m._n")).alias("_p"), chunks(F.col("_all")).alias("_q"))
        rows = rows.join(size, "key").join(self.nodes.select("node", "n", "sketch", "parity"), "node")
        rest = F.col("label") != F.col("_main")
        mine = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
        row, column = mine(0, "_p"), mine(1, "_q")  # a node is met in its column by all, in its row it meets all
        met = F.transform(F.sequence(F.lit(0), F.col("_p") - 1), lambda x: F.struct(x.alias("p"), column.alias("q"), F.when(rest & (x == row), 3).otherwise(1).alias("role")))
        meets = F.transform(F.filter(F.sequence(F.lit(0), F.col("_q") - 1), lambda x: x != column), lambda x: F.struct(row.alias("p"), x.alias("q"), F.lit(2).alias("role")))
        dealt = rows.withColumn("_d", F.explode(F.when(rest, F.concat(met, meets)).otherwise(met)))
        full = dealt.groupBy("key", "_d.p", "_d.q").agg(F.collect_list(F.struct("_d.role", "node", "label", "n", "sketch", "parity")).alias("g"))
        found = full.select("g").mapInArrow(_across(self.percent, top), "a bigint, b bigint, la bigint, lb bigint, apart bigint").distinct()
        if top is None:
            return found.select("a", "b", "la", "lb", F.lit(1).alias("r"))
        found = found.withColumn("r", F.row_number().over(Window.partitionBy("la", "lb").orderBy("apart", "a", "b")))
        return found.where(F.col("r") <= top).select("a", "b", "la", "lb", "r")

    def confirm(self, pairs: DataFrame, rows: int | None = None) -> DataFrame:
        """Those of the pairs, at most ``rows``, that are links, without pairs looked at before."""
        pairs = pairs.select("a", "b")
        pairs = store(pairs.join(self.tried, ["a", "b"], "leftanti") if self.tried else pairs, "candidates", rows=rows)
        self.tried = self.tried.union(pairs) if self.tried else pairs
        self.made = pairs.count()
        set_of = lambda c: self.sets.select(F.col("node").alias(c), F.col("s").alias(f"s{c}"))
        both = pairs.join(set_of("a"), "a").join(set_of("b"), "b")
        return store(both.mapInArrow(_confirmed(self.percent), "a bigint, b bigint"), "links", rows=SETS * self.made)


def _first(live: DataFrame) -> DataFrame:
    """(d1, d2, id, tk, c, node): of each different set the first row that holds it, the number of rows and
    a number for it, in the order of ids. That is the id itself unless two sets share their smallest id."""
    first = live.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.min_by("tk", "doc_id").alias("tk"), F.count("*").alias("c"))
    first = store(first, "first")
    if first.groupBy("id").count().where("count > 1").isEmpty():
        return first.withColumn("node", F.col("id"))
    return store(global_rank(first, [F.col("id"), F.col("d1"), F.col("d2")], "rank"), "ranked").withColumn("node", F.col("rank"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest id reachable), kept (doc_id is the
    component_id), text_key, chief (of the first text of its group: one text of each group is)."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text", text_key().alias("tk"))
    scanned = store(texts.mapInArrow(_scan(shingle), "doc_id bigint, tk bigint, n bigint, d1 bigint, d2 bigint, halves array<bigint>, sketch binary, parity binary"), "sketches")
    first = _first(scanned.where("n > 0 and doc_id is not null").select("doc_id", "tk", "d1", "d2"))
    own = first.select("d1", "d2", F.col("id").alias("doc_id"), "tk", "node")
    nodes = scanned.join(own, ["d1", "d2", "doc_id", "tk"]).dropDuplicates(["d1", "d2", "doc_id", "tk"])
    nodes = store(nodes.select("node", F.col("doc_id").alias("id"), "tk", "n", "halves", "sketch", "parity"), "nodes")

    half = nodes.select("node", F.explode("halves").alias("h"))
    left = F.col("h").bitwiseAND(F.lit(SIDE)) == 0
    common = half.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    sides = half.join(common, "h", "leftsemi").groupBy("node").agg(F.collect_list(F.when(left, F.col("h"))).alias("l"), F.collect_list(F.when(~left, F.col("h"))).alias("r"))
    sides = store(sides.where((F.size("l") > 0) & (F.size("r") > 0)), "sides")
    keyed = sides.select("node", F.explode("l").alias("x"), "r").select("node", "x", F.explode("r").alias("y")).where((F.col("x").bitwiseAND(F.lit(SIDE - 1)) + F.col("y").bitwiseAND(F.lit(SIDE - 1))) % EVERY == 0).select("node", F.xxhash64("x", "y").alias("key"))
    bucket = keyed.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("c")).where("c > 1")
    buckets = store(keyed.join(bucket, "key"), "buckets")

    links = _Links(texts, nodes, buckets.select("node").distinct(), shingle, percent)

    def stars(df: DataFrame) -> DataFrame:
        return df.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))

    # every node with the smallest likely partner, then with the other smallest nodes of its keys
    likely = store(links.likely(stars(buckets).distinct()), "likely")
    n = likely.count()
    labels = components(links.confirm(likely.groupBy("a").agg(F.min("b").alias("b")), n), rows=links.made)
    labels = _more(links, _still(_ends(likely, labels)), labels, n)
    rows = buckets.select("key", "node", "c")
    labels = _more(links, links.within(_apart(rows.where(F.col("c") <= SMALL), labels)), labels)
    wide = store(_apart(rows.where(F.col("c") > SMALL), labels), "wide")
    if not wide.isEmpty():
        found = store(links.across(wide, FEW), "likely")
        n = found.count()
        labels = _more(links, found.where("r = 1"), labels, n)
        labels = _more(links, _still(_ends(found.where("r > 1"), labels)), labels, n)
        # components that had more likely pairs than were listed, and are still apart: every pair of theirs
        left = _ends(found.where(F.col("r") == FEW), labels).where("la <> lb")
        if not left.isEmpty():
            open_ = store(left.select(F.explode(F.array("la", "lb")).alias("label")).distinct(), "open", rows=2 * n)
            open_ = F.broadcast(open_) if open_.count() <= FEW_KEYS else open_
            rows = _label(wide.drop("label"), labels, "node", "label").join(open_, "label", "leftsemi")
            labels = _more(links, links.across(store(rows.select("key", "node", "label"), "open"), None), labels)

    found = first.join(labels, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    found = found.select("d1", "d2", "c", F.col("id").alias("_id"), F.col("tk").alias("_tk"), (F.col("node") == F.col("root")).alias("_chief"), "root")
    if "rank" in first.columns:  # the root's number stands for its id
        sizes = found.groupBy("root").agg(F.count("*").alias("_c"))
        found = look_up(found, store(sizes.join(first.select(F.col("node").alias("root"), F.col("id").alias("component")), "root"), "roots"), ["root"], "_c").drop("root")
    else:
        found = found.withColumnRenamed("root", "component")
    rows = scanned.select("doc_id", "tk", "n", "d1", "d2")
    lone = F.col("doc_id").isNull() | (F.col("n") == 0)
    alone = rows.where(lone).select("doc_id", "tk", "n", F.col("doc_id").alias("component"), F.lit(True).alias("chief"))
    chief = F.col("_chief") & (F.col("doc_id") == F.col("_id")) & (F.col("tk") == F.col("_tk"))
    others = look_up(rows.where(~lone), store(found, "found"), ["d1", "d2"], "c").select("doc_id", "tk", "n", "component", chief.alias("chief"))
    kept = F.col("component") == F.col("doc_id")
    return others.union(alone.select(*others.columns)).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"), F.col("tk").alias("text_key"), "chief")


def _still(ends: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    return ends.where("la <> lb").select("a", "b")


def _label(df: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    got = labels.select(F.col("node").alias(node), F.col("component").alias(name))
    return df.join(got, node, "left").withColumn(name, F.coalesce(name, node))


def _ends(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    return _label(_label(pairs.select("a", "b"), labels, "a", "la"), labels, "b", "lb")


def _more(links: _Links, pairs: DataFrame, labels: DataFrame, rows: int | None = None) -> DataFrame:
    """Components after those of the pairs (of different components, at most ``rows``) that are
    confirmed; only the components that these join are worked on."""
    new = links.confirm(pairs, rows)
    if new.isEmpty():
        return labels
    roots = components(_ends(new, labels).select(F.col("la").alias("a"), F.col("lb").alias("b")), rows=links.made)
    lone = roots.select("node", F.col("node").alias("component")).join(labels, "node", "leftanti")
    moved = roots.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    out = labels.union(lone).join(moved, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return store(out, "labels", rows=labels.count() + 2 * links.made)


def _apart(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, node, c, label) of keys whose nodes lie in different components."""
    labelled = _label(rows, labels, "node", "label")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("_a"), F.max("label").alias("_z")).where("_a <> _z").select("key")
    return labelled.join(mixed, "key", "leftsemi").select("key", "node", "c", "label")


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without the members of near-duplicate groups but the first text of the smallest id. Rows with
    a null id or without words stay."""
    return without(docs, near_duplicates(docs, shingle, percent).where("not chief").select("doc_id", "text_key"))
