"""Shared pieces: words and their hashes, tables in the shared folder, ranks, components."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.sources import shared
from keyloom.sources.shared import remove, scratch_path, shared_dir

__all__ = ["components", "dealt", "fresh", "global_rank", "hash_words", "look_up", "mix64", "remove", "rows_of", "scratch_path", "shared_dir", "store", "text_key", "without", "word_count", "words"]

#: A word is a run of anything but space and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_CACHED = 50_000
#: Short rows in a file of a table whose size is known.
A_FILE = 50_000
#: Size of the Arrow batches between the JVM and a Python worker: each side holds a few at a time.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def store(df: DataFrame, name: str, path: str | None = None, rows: int | None = None) -> DataFrame:
    """A table in the shared folder, read back; written with small Arrow batches, so that whole texts
    take little memory beside the JVM. The session's own settings hold again afterwards. Where it has
    at most ``rows`` short rows, it gets a file for every ``A_FILE`` of them, not for every partition."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in _BATCHES}
    df = df if rows is None else df.coalesce(-(-max(rows, 1) // A_FILE))
    try:
        for k, v in _BATCHES.items():
            conf.set(k, v)
        return shared.store(df, name, path)
    finally:
        for k, v in before.items():
            if v is None:
                conf.unset(k)
            else:
                conf.set(k, v)


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """UTF-8 words. bytes.split() cuts at exactly the six separators, bytes.lower() maps A-Z only."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def hash_words(ws: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; the cache of frequent words has a fixed size."""
    return np.fromiter(map(_hashes.__getitem__, ws), np.uint64, len(ws))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by a polynomial over scrambled word hashes: runs of 1, 2, 4, ...
    words are doubled, and those that add up to k joined."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power = lambda e: np.uint64(pow(0x9E3779B97F4A7C15, e, 1 << 64))
    out, have, runs, size = np.zeros(len(h) + 1, np.uint64), 0, h, 1
    while True:
        if k & size:
            out = runs[: len(h) - size - have + 1] * power(have) + out[size : len(h) - have + 1]
            have += size
        if have == k:
            return mix64(out)
        runs, size = runs[: len(runs) - size] * power(size) + runs[size:], 2 * size


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column of ``taken`` bears it in any case."""
    used, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def text_key(text: str = "text") -> Column:
    """A number that tells the texts of rows with one id, or with none, apart; of a null text that of ''."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows that gone (doc_id, text_key) names. The texts decide with the ids, so rows that
    share an id, or have none, stand or fall each by its own text."""
    i, t = fresh(docs.columns, "_id", "_text_key")
    gone = gone.select(F.col("doc_id").alias(i), F.col("text_key").alias(t)).distinct()
    same = docs["doc_id"].cast("bigint").eqNullSafe(gone[i]) & (text_key() == gone[t])
    return docs.join(gone, same, "leftanti")


#: Keys with over 1 / SHARE of all rows are looked up by broadcast: there are fewer than SHARE of them.
SHARE = 1024


def look_up(rows: DataFrame, one: DataFrame, key: list[str], count: str, how: str = "inner") -> DataFrame:
    """rows joined with one, which has at most one short row for a key and, in ``count``, the number of rows
    with that key; the column is dropped. Keys with over 1 / SHARE of all rows are joined by broadcast (fewer
    than SHARE rows whatever the input), all others by a shuffle in which no key is large."""
    total = one.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    often = F.col(count) * SHARE > total
    hot, cold = F.broadcast(one.where(often).drop(count)), one.where(~often).drop(count)
    found = rows.join(hot, key)
    return found.unionByName(rows.join(hot.select(*key), key, "leftanti").join(cold, key, how))


def dealt(rows: DataFrame, key: list[str], most: int, by: list[str], name: str = "_part") -> tuple[DataFrame, DataFrame]:
    """rows with the column ``name``, a number below parts(key), such that rows of one key and number are
    about ``most`` at most; and the keys (key, parts) that have more than one part."""
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_c"))
    sizes = store(sizes.where(F.col("_c") > most).withColumn("_parts", F.ceil(F.col("_c") / most).cast("int")), "large_keys")
    many = F.pmod(F.xxhash64(*by), F.coalesce("_parts", F.lit(1))).cast("int").alias(name)
    kept = rows.columns
    if sizes.isEmpty():
        return rows.select("*", F.lit(0).alias(name)), sizes.drop("_c")
    large = look_up(rows, sizes, key, "_c")
    small = rows.join(sizes, key, "leftanti").withColumn("_parts", F.lit(1))
    return large.unionByName(small).select(*kept, many), sizes.drop("_c")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the 0-based position in the given order. Range partitions are counted and the counts
    (one row per partition) are summed up; no task sees more than its range. Ties in the order
    must be true repeats."""
    placed = df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = store(placed, name)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    return placed.join(base, "_p").withColumn(name, F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


SIEVE_BITS = 1 << 20
#: So many keys, of some 16 bytes each, are few enough for a broadcast.
FEW_KEYS = 100_000


def rows_of(docs: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """docs joined with wanted by key, without shuffling the texts of most other rows: up to ``FEW_KEYS``
    wanted keys are broadcast to drop them; above, a bitmap of 128 KiB does, unless so many rows are wanted
    that it would let nearly all pass. The join alone decides."""
    n = wanted.count()
    if n <= FEW_KEYS:
        return docs.join(F.broadcast(wanted.select(*key)), key, "leftsemi").join(wanted, key)
    if n > 2 * SIEVE_BITS:
        return docs.join(wanted, key)
    bucket = F.pmod(F.xxhash64(*key), F.lit(SIEVE_BITS)).cast("int")
    longs = wanted.select(bucket.alias("b")).groupBy(F.expr("b >> 6").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, b & 63)")).alias("bits"))
    packed = np.zeros(SIEVE_BITS >> 6, np.int64)
    for at, bits in longs.collect():  # at most SIEVE_BITS / 64 rows
        packed[at] = bits
    packed = packed.view(np.uint8)
    sieve = fresh(docs.columns, "_sieve")[0]

    def sift(batches):
        import pyarrow as pa

        for batch in batches:
            b = batch.column(sieve).to_numpy()
            yield batch.filter(pa.array((packed[b >> 3] >> (b & 7) & 1).astype(bool))).drop_columns([sieve])

    return docs.withColumn(sieve, bucket).mapInArrow(sift, docs.schema).join(wanted, key)


def components(edges: DataFrame, name: str = "components", rows: int | None = None) -> DataFrame:
    """(node, component) for the nodes of an undirected edge table (a, b); the component is its
    smallest node. Alternating large-star and small-star rounds: each round hangs neighbours on the
    smallest one, with combined minima before the exchange, until the edges no longer change; their number never
    grows. rows: at most so many edges, if known."""
    spark = edges.sparkSession
    path = scratch_path(spark, name)
    now = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name, f"{path}/0", rows)
    seen, rows = None, now.count()
    for i in range(1, 200):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        step = store(small.distinct(), name, f"{path}/{i}", rows)
        stat = step.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        remove(spark, f"{path}/{i - 1}")
        now = step
        if tuple(stat) == seen:
            break
        seen = tuple(stat)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
