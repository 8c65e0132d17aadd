"""Table operations: lazy functions over DataFrames with the columns key, value and a sequence
(``offset`` within a file, ``file_ord`` between files). They run alike on record files and on any
other table put into that shape with ``table``.

``compat=True`` gives the row set of the established command-line tool where that differs in a
deterministic way from its documentation; the default follows the documentation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.functions import exprs
from keyloom.sources.paths import facts, index_path, local

SEQ = ("file_ord", "offset")


def table(df: DataFrame, key: str, value: str | Column, seq: str, file_ord: int = 0, path: str = "table") -> DataFrame:
    """A key-value view of a DataFrame; ``seq`` gives the append order."""
    value = F.col(value) if isinstance(value, str) else value
    return df.select(F.col(key).alias("key"), value.alias("value"), F.lit(path).alias("path"), F.col(seq).cast("bigint").alias("offset"), F.col(seq).cast("bigint").alias("seq"), F.lit(file_ord).alias("file_ord"))


def read(spark: SparkSession, paths: list[str], **options: str) -> DataFrame:
    return spark.read.format("cborkv").options(**options).load(list(paths))


def in_order(df: DataFrame) -> DataFrame:
    """Stored order: files in argument order, rows by offset."""
    return df.orderBy(*(c for c in ("file_ord", "offset", "ordinal") if c in df.columns))


def keys(df: DataFrame) -> DataFrame:
    return df.select("key", *SEQ)


def values(df: DataFrame) -> DataFrame:
    return df.select("value", *SEQ)


def dump(df: DataFrame, compat: bool = False) -> DataFrame:
    """Offset, key and value of every row. compat: of the first file only."""
    out = df.select("offset", "key", "value", "file_ord")
    return out.join(F.broadcast(df.agg(F.min("file_ord").alias("file_ord"))), "file_ord").select(out.columns) if compat else out


def index(df: DataFrame) -> DataFrame:
    return df.select("key", "offset", *(c for c in ("file_ord", "ordinal") if c in df.columns))


def offsets(df: DataFrame, key_type: str = "string", value_type: str = "string") -> DataFrame:
    """Replace ``offset`` by the byte offset each row gets when its file is written in sequence
    order. The running sum is made in two passes (sums per slice, then within slices), so no file
    is gathered in one task."""
    size = exprs.encoded_size(F.col("key"), key_type) + exprs.encoded_size(F.col("value"), value_type)
    df = df.withColumn("_size", size).withColumn("_slice", F.floor(F.col("seq") / F.lit(1 << 16)))
    per = df.groupBy("file_ord", "_slice").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("file_ord").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("file_ord", "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("file_ord", "_slice").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(base, ["file_ord", "_slice"]).withColumn("offset", F.col("_base") + F.coalesce(F.sum("_size").over(within), F.lit(0)))
    return out.drop("_size", "_slice", "_base")


def get(df: DataFrame, key: object, n: int | None = None) -> DataFrame:
    """Rows with the key, at most n from each file, in stored order. n = 0 gives none."""
    hit = df.where(F.col("key") == F.lit(key))
    if n is None:
        return hit
    pos = F.row_number().over(Window.partitionBy("path", "file_ord").orderBy("offset"))
    return hit.withColumn("_pos", pos).where(F.col("_pos") <= n).drop("_pos")


def get_compat(data: DataFrame, index: DataFrame, files: DataFrame, key: object, n: int | None = None) -> DataFrame:
    """As the established tool looks a key up: ``files`` lists (file_ord, indexed). In a file with an
    index it goes to the key's entry and takes rows while the key stays the same, at least one; in
    one without, all rows with the key, rendered as values only, and n = 0 looks at the first row
    alone. Files after the first index that lacks the key are not searched. Among several entries
    of a key the tool's search may meet any; here it is the first. Returns the rows with ``line``."""
    at = index.where(F.col("key") == F.lit(key)).groupBy("file_ord").agg(F.min("offset").cast("bigint").alias("_at"))
    listed = files.select("file_ord", "indexed").join(at, "file_ord", "left")
    lost = F.max(F.col("indexed") & F.col("_at").isNull()).over(Window.orderBy("file_ord"))  # a row per file
    searched = F.broadcast(listed.withColumn("_lost", lost).where(~F.col("_lost")).drop("_lost"))
    rows, same = data.join(searched, "file_ord"), F.col("key") == F.lit(key)
    run = rows.where("indexed and offset >= _at").groupBy("file_ord").agg(F.min("seq").alias("_from"), F.min(F.when(~same, F.col("seq"))).alias("_to"))
    if n is not None:
        run = run.withColumn("_to", F.least("_to", F.col("_from") + max(n, 1)))
    there = data.columns
    seek = rows.where("indexed").where(same).join(F.broadcast(run), "file_ord").where("seq >= _from and (_to is null or seq < _to)")
    scan = rows.where("not indexed")
    scan = scan.where("seq = 0").where(same) if n == 0 else get(scan, key, n)
    line = F.concat(F.col("key").cast("string"), F.lit(": "), F.col("value").cast("string"))
    return seek.select(*there, line.alias("line")).unionByName(scan.select(*there, F.col("value").cast("string").alias("line")))


def merge(*tables: DataFrame) -> DataFrame:
    """All rows of all tables by key; equal keys keep table order, then append order."""
    return reduce(lambda a, b: a.unionByName(b), tables).orderBy("key", *SEQ)


sort = merge


def sort_canonical(df: DataFrame, key_type: str = "string") -> DataFrame:
    """By encoded length, then encoded bytes, then offset."""
    return df.orderBy(*exprs.canonical_sort(F.col("key"), key_type), *SEQ)


def reachable(data: DataFrame, index: DataFrame) -> DataFrame:
    """Data rows that the index lists; rows it does not list are invisible to index-driven reads."""
    return data.join(index.select("path", F.col("offset").cast("bigint").alias("offset")).distinct(), ["path", "offset"], "leftsemi")


def search_first(index: DataFrame, key: object) -> DataFrame:
    """Position of the first entry with the key (null if none) and the insertion point, both in
    canonical order over string or binary keys."""
    k = F.lit(key)
    less = F.struct(F.octet_length("key"), "key") < F.struct(F.octet_length(k), k)
    first = F.count(F.when(less, 1))
    hits = F.count(F.when(F.col("key") == k, 1))
    return index.agg(F.when(hits > 0, first).cast("bigint").alias("first_match"), first.cast("bigint").alias("insertion_point"))


def sorted_flags(index: DataFrame, key_type: str = "string") -> DataFrame:
    """Per path: whether keys never descend (native), and whether entries ascend in canonical
    order with ties by offset. Neighbours are compared within slices of the ordinal and then
    between the ends of slices, so a large index is not gathered in one task."""
    order = F.struct(*exprs.canonical_sort(F.col("key"), key_type), "offset")
    sliced = index.select("path", "ordinal", "key", order.alias("_c"), F.floor(F.col("ordinal") / F.lit(1 << 16)).alias("_s"))
    w = Window.partitionBy("path", "_s").orderBy("ordinal")
    inner = sliced.withColumn("_dn", F.col("key") < F.lag("key").over(w)).withColumn("_dc", F.col("_c") < F.lag("_c").over(w))
    ends = inner.groupBy("path", "_s").agg(F.max("_dn").alias("_dn"), F.max("_dc").alias("_dc"), F.min_by(F.struct("key", "_c"), "ordinal").alias("_a"), F.max_by(F.struct("key", "_c"), "ordinal").alias("_z"))
    o = Window.partitionBy("path").orderBy("_s")
    prev = F.lag("_z").over(o)
    ends = ends.withColumn("_bn", F.col("_a.key") < prev["key"]).withColumn("_bc", F.col("_a._c") < prev["_c"])
    bad = lambda *c: F.coalesce(~F.max(F.greatest(*(F.coalesce(x, F.lit(False)) for x in c))), F.lit(True))
    return ends.groupBy("path").agg(bad("_dn", "_bn").alias("native_sorted"), bad("_dc", "_bc").alias("cbor_sorted"))


def profile(index: DataFrame, key_type: str = "string", compat: bool = False) -> DataFrame:
    """Per path: count, sorted label, min, max, unique. compat: unique repeats the native flag."""
    agg = index.groupBy("path").agg(F.count("*").alias("count"), F.min("key").alias("min"), F.max("key").alias("max"))
    # two-level distinct: one row per key first, so a hot key is combined before the exchange
    distinct = index.groupBy("path", "key").agg(F.lit(1).alias("_one")).groupBy("path").agg(F.count("*").alias("_n"))
    label = F.when(F.col("native_sorted") & F.col("cbor_sorted"), "native,cbor").when(F.col("native_sorted"), "native").when(F.col("cbor_sorted"), "cbor").otherwise("false")
    unique = F.col("native_sorted") if compat else F.col("count") == F.col("_n")
    return agg.join(distinct, "path").join(sorted_flags(index, key_type), "path").select("path", "count", label.alias("sorted"), "min", "max", unique.alias("unique"))


def info(spark: SparkSession, paths: list[str], key_type: str = "string", compat: bool = False) -> DataFrame:
    """One row per requested path, missing files included; an empty index has count 0."""
    seen = [facts(p) for p in paths]
    head = spark.createDataFrame(
        [(i, f.path, local(f.path), f.data_exists, f.data_size, f.index_path, f.index_exists, f.index_size) for i, f in enumerate(seen)],
        "pos int, path string, _local string, data_exists boolean, data_size bigint, index_path string, index_exists boolean, index_size bigint",
    )
    there = [f.path for f in seen if f.index_exists]
    empty = spark.createDataFrame([], f"path string, count bigint, sorted string, min {_sql(key_type)}, max {_sql(key_type)}, unique boolean")
    found = profile(read(spark, there, mode="index", keyType=key_type), key_type, compat) if there else empty
    out = head.join(found.withColumnRenamed("path", "_local"), "_local", "left")
    fill = lambda c, v: F.when(F.col("index_exists"), F.coalesce(F.col(c), F.lit(v))).alias(c)
    return out.select("path", "data_exists", "data_size", "index_path", "index_exists", "index_size", fill("count", 0), fill("sorted", "native,cbor"), "min", "max", fill("unique", True), "pos")


def _sql(kind: str) -> str:
    return {"string": "string", "binary": "binary", "uint64": "decimal(20,0)"}[kind]


def save(df: DataFrame, path: str, mode: str = "errorifexists", key_type: str = "string", value_type: str = "string", layout: str = "single", partitions: int = 8, **options: str) -> None:
    """Write key and value in the order (key, file_ord, offset) when layout is ``parts`` (range
    partitions, one file pair each), or in stored order into one file pair when ``single``."""
    import os

    if mode == "errorifexists":
        if os.path.exists(local(path)):
            raise FileExistsError(f"{path} exists; choose append or overwrite")
        mode = "append"
    order = [c for c in SEQ if c in df.columns]
    if layout == "parts":
        df = df.repartitionByRange(partitions, "key").sortWithinPartitions("key", *order)
    else:
        df = df.repartition(1).sortWithinPartitions(*order) if order else df.coalesce(1)
    df.select("key", "value").write.format("cborkv").options(keyType=key_type, valueType=value_type, layout=layout, **options).mode(mode).save(path)


def save_sorted(df: DataFrame, path: str, mode: str = "errorifexists", **kw) -> None:
    """Write in key order into one file pair (merge and sort with an output)."""
    pos = F.row_number().over(Window.orderBy("key", *SEQ)).cast("bigint")
    save(df.withColumn("offset", pos).withColumn("file_ord", F.lit(0)), path, mode, **kw)


def append(spark: SparkSession, paths: list[str], key: object, value: object, key_type: str = "string", value_type: str = "string") -> None:
    """Append one record to every path, creating files."""
    row = spark.createDataFrame([(key, value)], f"key {_sql(key_type)}, value {_sql(value_type)}")
    for p in paths:
        row.coalesce(1).write.format("cborkv").options(keyType=key_type, valueType=value_type).mode("append").save(p)


def rebuild_index(spark: SparkSession, path: str, key_type: str = "string", value_type: str = "string") -> None:
    """Write a new index over all whole records of a data file whose index is lost or lists only
    the rows appended after the loss. One task reads the file; the index is put in place at once."""
    import os
    import uuid

    target = local(path)
    new = index_path(f"{target}.{uuid.uuid4().hex}")
    rows = read(spark, [path], keyType=key_type, valueType=value_type, indexPath=f"{new}.none")
    rows.select("key", F.col("offset").cast("decimal(20,0)").alias("value")).write.format("cborkv").options(keyType=key_type, valueType="uint64", indexPath=f"{new}.own").mode("overwrite").save(new)
    os.replace(new, index_path(target))
    os.remove(f"{new}.own")


# Extensions: not operations of the established tool, only items of its wish list.


def key_range(df: DataFrame, low: object, high: object) -> DataFrame:
    return df.where(F.col("key").between(F.lit(low), F.lit(high)))


def head(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(*SEQ).limit(n)


def tail(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(*(F.col(c).desc() for c in SEQ)).limit(n)


def histogram(df: DataFrame) -> DataFrame:
    return df.groupBy("key").agg(F.count("*").alias("n"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("key").distinct(), "key", "leftsemi")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("key").distinct(), "key", "leftanti")


def union_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").union(b.select("key")).distinct()


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys on one side only."""
    one = lambda x, y, side: x.select("key").distinct().join(y.select("key").distinct(), "key", "leftanti").withColumn("side", F.lit(side))
    return one(a, b, "left").union(one(b, a, "right"))


def sample(df: DataFrame, one_in: int) -> DataFrame:
    """The same rows on every run."""
    return df.where(F.pmod(F.xxhash64("key", "value", *SEQ), F.lit(one_in)) == 0)


def validate(data: DataFrame, index: DataFrame) -> DataFrame:
    """Offsets that only the data or only the index has."""
    d, i = data.select("path", "offset").distinct(), index.select("path", F.col("offset").cast("bigint").alias("offset")).distinct()
    return d.join(i, ["path", "offset"], "leftanti").withColumn("fault", F.lit("not indexed")).union(i.join(d, ["path", "offset"], "leftanti").withColumn("fault", F.lit("no record")))
