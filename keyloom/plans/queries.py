"""Query catalogue over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import exprs
from keyloom.operators import ops, render
from keyloom.sources import register
from keyloom.sources.paths import index_path, local
from keyloom.sources.shared import scratch_path

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def kv(s, d):
    return ops.table(_t(s, d, "events"), "event_type", "props", "event_id")


def docs(s, d):
    return ops.table(_t(s, d, "documents"), "source", "text", "doc_id")


def pg(s, d):
    return ops.table(_t(s, d, "pages"), "url", "html", "page_id")


def parts(s, d):
    return ops.table(_t(s, d, "part"), "p_name", "p_brand", "p_partkey")


def order_keys(s, d):
    return ops.table(_t(s, d, "orders"), "o_orderkey", "o_orderpriority", "o_orderkey")


def merge_inputs(s, d):
    return (
        ops.table(_t(s, d, "customer"), "c_mktsegment", "c_name", "c_custkey", 0),
        ops.table(_t(s, d, "supplier"), "s_name", F.col("s_nationkey").cast("string"), "s_suppkey", 1),
        ops.table(_t(s, d, "part"), "p_brand", "p_name", "p_partkey", 2),
    )


def merged(s, d):
    return ops.merge(*merge_inputs(s, d))


# SQL pieces of the format, for DuckDB
def _extra(n: str) -> str:
    return f"(CASE WHEN {n} < 24 THEN 0 WHEN {n} < 256 THEN 1 WHEN {n} < 65536 THEN 2 WHEN {n} < 4294967296 THEN 4 ELSE 8 END)"


def _item(x: str) -> str:
    return f"(1 + {_extra(f'strlen({x})')} + strlen({x}))"


def _offsets(key: str, value: str, seq: str, table: str, item_key: str | None = None) -> str:
    size = f"{item_key or _item(key)} + {_item(value)}"
    return f"SELECT {key} AS key, {value} AS value, CAST(coalesce(sum({size}) OVER (ORDER BY {seq} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", {seq} AS seq FROM {table}"


_Q = "'\"' || replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '\"'"
_MERGE = (
    "SELECT c_mktsegment AS key, c_name AS value, 0 AS f, c_custkey AS o FROM customer UNION ALL "
    "SELECT s_name, CAST(s_nationkey AS VARCHAR), 1, s_suppkey FROM supplier UNION ALL SELECT p_brand, p_name, 2, p_partkey FROM part"
)


@query("SELECT event_type AS key, event_id AS seq FROM events")
def keys(s, d):
    return ops.keys(kv(s, d)).select("key", F.col("offset").alias("seq"))


@query("SELECT text AS value, doc_id AS seq FROM documents")
def values(s, d):
    return ops.values(docs(s, d)).select("value", F.col("offset").alias("seq"))


@query(f'SELECT "offset", key, value FROM ({_offsets("url", "html", "page_id", "pages")})')
def dump(s, d):
    return ops.dump(ops.offsets(pg(s, d))).select("offset", "key", "value")


@query(f"SELECT '(' || CAST(\"offset\" AS VARCHAR) || ') ' || {_Q.format('key')} || ': ' || {_Q.format('value')} AS line FROM ({_offsets('url', 'html', 'page_id', 'pages')})")
def dump_text(s, d):
    return render.dump_lines(ops.offsets(pg(s, d))).select("line")


@query(f'SELECT key, "offset" FROM ({_offsets("url", "html", "page_id", "pages")})')
def index(s, d):
    return ops.index(ops.offsets(pg(s, d))).select("key", "offset")


@query(f'SELECT key, "offset" FROM ({_offsets("o_orderkey", "o_orderpriority", "o_orderkey", "orders", "(1 + " + _extra("o_orderkey") + ")")})')
def index_u64(s, d):
    return ops.index(ops.offsets(order_keys(s, d), "uint64")).select("key", "offset")


@query(f"SELECT CAST(sum({_item('source')} + {_item('text')}) AS BIGINT) AS size FROM documents")
def data_size(s, d):
    return docs(s, d).agg(F.sum(exprs.encoded_size(F.col("key"), "string") + exprs.encoded_size(F.col("value"), "string")).alias("size"))


@query(f"SELECT CAST(sum({_item('key')} + 1 + {_extra(chr(34) + 'offset' + chr(34))}) AS BIGINT) AS size FROM ({_offsets('url', 'html', 'page_id', 'pages')})")
def index_size(s, d):
    return ops.offsets(pg(s, d)).agg(F.sum(exprs.encoded_size(F.col("key"), "string") + exprs.encoded_size(F.col("offset"), "uint64")).alias("size"))


@query("SELECT event_type AS key, props AS value, event_id AS seq FROM events WHERE event_type = 'click'")
def get_all(s, d):
    return ops.get(kv(s, d), "click").select("key", "value", "seq")


@query("SELECT event_type AS key, props AS value, event_id AS seq FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 3")
def get_n(s, d):
    return ops.get(kv(s, d), "click", 3).select("key", "value", "seq")


@query("SELECT p_name AS key, p_brand AS value, CAST(row_number() OVER (ORDER BY p_name, p_partkey) AS BIGINT) AS pos FROM part")
def sort_native(s, d):
    return ranked(parts(s, d), "key", "offset")


@query("SELECT p_name AS key, p_brand AS value, CAST(row_number() OVER (ORDER BY strlen(p_name), p_name, p_partkey) AS BIGINT) AS pos FROM part")
def sort_cbor(s, d):
    return ranked(parts(s, d), F.octet_length("key"), "key", "offset")


@query(f"SELECT key, value, CAST(row_number() OVER (ORDER BY key, f, o) AS BIGINT) AS pos FROM ({_MERGE})")
def merge(s, d):
    return ranked(merged(s, d), "key", "file_ord", "offset")


def ranked(df: DataFrame, *order) -> DataFrame:
    """key, value and the position in the given order. The position is made from a range-sorted
    table: rows before each partition, plus the place within it; no partition holds all rows."""
    parts_ = df.orderBy(*order).select("key", "value", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"))
    place = parts_.withColumn("_i", F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)))
    from keyloom.sources.shared import store

    place = store(place, "ranked")
    from pyspark.sql import Window

    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    base = place.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    return place.join(base, "_p").select("key", "value", (F.col("_b") + F.col("_i") + 1).alias("pos"))


@query(
    "SELECT 'events' AS path, count(*) AS count, CASE WHEN n AND c THEN 'native,cbor' WHEN n THEN 'native' WHEN c THEN 'cbor' ELSE 'false' END AS sorted, min(key) AS min, max(key) AS max, count(*) = count(DISTINCT key) AS \"unique\" FROM ("
    "SELECT key, bool_and(coalesce(key >= p, true)) OVER () AS n, bool_and(coalesce(l > pl OR l = pl AND (key > p OR key = p AND o > po), true)) OVER () AS c FROM ("
    "SELECT event_type AS key, strlen(event_type) AS l, event_id AS o, lag(event_type) OVER w AS p, lag(strlen(event_type)) OVER w AS pl, lag(event_id) OVER w AS po FROM events WINDOW w AS (ORDER BY event_id))) GROUP BY n, c"
)
def info(s, d):
    return ops.profile(kv(s, d).select("key", "offset", F.col("seq").alias("ordinal"), F.lit("events").alias("path")))


_CANON = "strlen(p_name) < 9 OR strlen(p_name) = 9 AND p_name < 'blue part'"


@query(f"SELECT CASE WHEN count(*) FILTER (p_name = 'blue part') > 0 THEN count(*) FILTER ({_CANON}) END AS first_match, count(*) FILTER ({_CANON}) AS insertion_point FROM part")
def search_first(s, d):
    return ops.search_first(parts(s, d), "blue part")


@query("SELECT count(*) FILTER (strlen(event_type) < 5 OR strlen(event_type) = 5 AND event_type < 'click') AS first_match, count(*) FILTER (strlen(event_type) < 5 OR strlen(event_type) = 5 AND event_type < 'click') AS insertion_point FROM events HAVING count(*) FILTER (event_type = 'click') > 0")
def search_duplicates(s, d):
    return ops.search_first(kv(s, d), "click")


@query("SELECT '{\"' || event_type || '\": \"' || props || '\"},' AS line FROM events")
def export_json(s, d):
    return render.lines(kv(s, d), "json_compat").select("line")


@query("SELECT event_type || ',' || props AS line FROM events")
def export_csv(s, d):
    return render.lines(kv(s, d), "csv_compat").select("line")


@query("SELECT '{' || CAST(to_json(source) AS VARCHAR) || ':' || CAST(to_json(text) AS VARCHAR) || '}' AS line FROM documents WHERE source IS NOT NULL")
def export_json_escaped(s, d):
    return render.lines(docs(s, d), "json").select("line")


_CSV = "CASE WHEN {0} IS NULL OR {0} = '' THEN '\"\"' WHEN regexp_matches({0}, '[,\"\\n\\r]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"


@query(f"SELECT {_CSV.format('source')} || ',' || {_CSV.format('text')} AS line FROM documents")
def export_csv_quoted(s, d):
    return render.lines(docs(s, d), "csv").select("line")


_HEX = "'[' || rtrim(regexp_replace(regexp_replace(lower(hex(encode({0}))), '(..)', '\\1, ', 'g'), '(^|, )0', '\\1', 'g'), ', ') || ']'"


@query(f"SELECT {_HEX.format('p_name')} || chr(9) || {_HEX.format('p_brand')} AS line FROM part")
def tsv_hex(s, d):
    return render.lines(parts(s, d).withColumns({c: F.encode(c, "UTF-8") for c in ("key", "value")}), "tsv_hex").select("line")


@query("SELECT source || ': ' || text AS line FROM documents")
def export_default(s, d):
    return render.lines(docs(s, d)).select("line")


@query("SELECT p_name || chr(9) || p_brand AS line FROM part")
def tsv(s, d):
    return render.lines(parts(s, d), "tsv").select("line")


@query("SELECT '(' || p_name || ', ' || p_brand || ')' AS line FROM part")
def pair(s, d):
    return render.lines(parts(s, d), "pair").select("line")


@query("SELECT page_id, CASE WHEN strlen(url) < 24 THEN printf('%02X', 96 + strlen(url)) WHEN strlen(url) < 256 THEN '78' || printf('%02X', strlen(url)) ELSE '79' || printf('%04X', strlen(url)) END || hex(encode(url)) AS key_hex FROM pages")
def encode_key_hex(s, d):
    return _t(s, d, "pages").select("page_id", F.hex(exprs.encode_item(F.col("url"), "string")).alias("key_hex"))


@query("SELECT event_id, event_id % 256 & 31 AS embedded, event_id % 256 & 224 AS major, CASE WHEN (event_id % 256 & 31) BETWEEN 24 AND 27 THEN event_id % 256 & 31 ELSE 0 END AS extended FROM events")
def embedded_value_and_major(s, d):
    b = F.col("event_id") % 256
    return _t(s, d, "events").select("event_id", exprs.embedded_of(b).alias("embedded"), exprs.major_of(b).alias("major"), exprs.extended_size(b).cast("bigint").alias("extended"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey < 24 THEN CAST(o_orderkey AS INTEGER) WHEN o_orderkey < 256 THEN 24 WHEN o_orderkey < 65536 THEN 25 WHEN o_orderkey < 4294967296 THEN 26 ELSE 27 END AS embedded FROM orders")
def embedded_for(s, d):
    return _t(s, d, "orders").select("o_orderkey", exprs.embedded_for(F.col("o_orderkey")).cast("int").alias("embedded"))


@query(f"SELECT o_orderkey, CAST({_extra('o_orderkey')} AS INTEGER) AS extra_bytes FROM orders")
def num_bytes(s, d):
    return _t(s, d, "orders").select("o_orderkey", exprs.num_bytes(F.col("o_orderkey")).alias("extra_bytes"))


@query("SELECT o_orderkey, o_orderkey AS decoded FROM orders")
def uint_round_trip(s, d):
    return _t(s, d, "orders").select("o_orderkey", exprs.decode_uint(exprs.encode_item(F.col("o_orderkey"), "uint64")).cast("bigint").alias("decoded"))


@query(
    f"SELECT key, CAST(coalesce(sum({_item('key')} + {_item('value')}) OVER (ORDER BY key, f, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM ({_MERGE})"
)
def merge_to_index(s, d):
    """Index of the file that a merge writes."""
    out = ranked(merged(s, d), "key", "file_ord", "offset")
    return ops.offsets(out.withColumnRenamed("pos", "seq").withColumn("file_ord", F.lit(0))).select("key", "offset")


def _written(s, df, key_type="string", value_type="string"):
    register(s)
    path = scratch_path(s, "table.sst")
    ops.save(df, path, key_type=key_type, value_type=value_type)
    return path


@query("SELECT url AS key, html AS value FROM pages")
def roundtrip_text(s, d):
    return ops.read(s, [_written(s, pg(s, d))]).select("key", "value")


@query("SELECT hex(encode(p_name)) AS key, hex(encode(p_brand)) AS value FROM part")
def roundtrip_bytes(s, d):
    df = parts(s, d).withColumn("key", F.encode("key", "UTF-8")).withColumn("value", F.encode("value", "UTF-8"))
    return ops.read(s, [_written(s, df, "binary", "binary")], keyType="binary", valueType="binary").select(F.hex("key").alias("key"), F.hex("value").alias("value"))


@query("SELECT o_orderkey AS key, o_orderpriority AS value FROM orders")
def roundtrip_u64(s, d):
    df = order_keys(s, d).withColumn("key", F.col("key").cast("decimal(20,0)"))
    return ops.read(s, [_written(s, df, "uint64")], keyType="uint64").select(F.col("key").cast("bigint").alias("key"), "value")


@query(f'SELECT key, "offset" FROM ({_offsets("url", "html", "page_id", "pages")})')
def written_index(s, d):
    return ops.read(s, [_written(s, pg(s, d))], mode="index").select("key", F.col("offset").cast("bigint").alias("offset"))


@query("SELECT event_type AS key, props AS value FROM events WHERE event_type = 'click'")
def indexed_get(s, d):
    """Point lookup through a written file's index."""
    return ops.get(ops.read(s, [_written(s, kv(s, d))]), "click").select("key", "value")


@query("SELECT event_type AS key, props AS value FROM events")
def sorted_parts(s, d):
    """Range-partitioned files, read back by their folder."""
    register(s)
    path = scratch_path(s, "parts")
    ops.save(kv(s, d), path, layout="parts")
    return ops.read(s, [path]).select("key", "value")


_APPENDED = "SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS value, 0 AS f, n_nationkey AS o FROM nation UNION ALL SELECT s_name, CAST(s_nationkey AS VARCHAR), 1, s_suppkey FROM supplier"
_IN_FILE = f"SELECT key, value, f, CAST(coalesce(sum({_item('key')} + {_item('value')}) OVER (ORDER BY f, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM ({_APPENDED})"


def _appended(s, d, lose_index=False):
    """A file of nations to which suppliers were appended, after its index was lost if so asked."""
    path = _written(s, ops.table(_t(s, d, "nation"), "n_name", F.col("n_regionkey").cast("string"), "n_nationkey"))
    if lose_index:
        os.remove(index_path(local(path)))
    ops.save(ops.table(_t(s, d, "supplier"), "s_name", F.col("s_nationkey").cast("string"), "s_suppkey"), path, mode="append")
    return path


@query(f'SELECT key, value, "offset" FROM ({_IN_FILE})')
def append(s, d):
    return ops.read(s, [_appended(s, d)]).select("key", "value", "offset")


@query(f'SELECT key, value, "offset" FROM ({_IN_FILE}) WHERE f = 1')
def index_semi_join(s, d):
    """The rows that an index made after the loss of an earlier one lists."""
    path = _appended(s, d, lose_index=True)
    return ops.reachable(ops.read(s, [path]), ops.read(s, [path], mode="index")).select("key", "value", "offset")


@query(f"SELECT \"offset\", 'not indexed' AS fault FROM ({_IN_FILE}) WHERE f = 0")
def validate(s, d):
    path = _appended(s, d, lose_index=True)
    return ops.validate(ops.read(s, [path]), ops.read(s, [path], mode="index")).select("offset", "fault")


@query(f'SELECT key, "offset" FROM ({_IN_FILE})')
def rebuilt_index(s, d):
    path = _appended(s, d, lose_index=True)
    ops.rebuild_index(s, path)
    return ops.read(s, [path], mode="index").select("key", F.col("offset").cast("bigint").alias("offset"))


@query(
    f"SELECT true AS data_exists, CAST(sum({_item('key')} + {_item('value')}) AS BIGINT) AS data_size, true AS index_exists, CAST(sum({_item('key')} + 1 + {_extra(chr(34) + 'offset' + chr(34))}) AS BIGINT) AS index_size, count(*) AS count, min(key) AS min, max(key) AS max, count(*) = count(DISTINCT key) AS \"unique\" FROM ({_IN_FILE}) "
    "UNION ALL SELECT false, NULL, false, NULL, NULL, NULL, NULL, NULL"
)
def info_files(s, d):
    """Facts and profile of a written file and of one that is not there."""
    return ops.info(s, [_appended(s, d), scratch_path(s, "none.sst")]).drop("path", "index_path", "sorted", "pos")


@query("SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS value FROM nation UNION ALL SELECT s_name, CAST(s_nationkey AS VARCHAR) FROM supplier")
def missing_skipped(s, d):
    """Several inputs, one of which is not there."""
    return ops.read(s, [scratch_path(s, "none.sst"), _appended(s, d)], missing="skip").select("key", "value")


@query(
    "WITH e AS (SELECT event_type AS key, props AS value, event_id AS o FROM events), a AS (SELECT min(o) AS o FROM e WHERE key = 'click'), z AS (SELECT coalesce(min(e.o), 9223372036854775807) AS o FROM e, a WHERE e.o > a.o AND key <> 'click') "
    "(SELECT key || ': ' || value AS line, 0 AS file_ord FROM e WHERE key = 'click' AND o >= (SELECT o FROM a) AND o < (SELECT o FROM z) ORDER BY o LIMIT 3) UNION ALL (SELECT value, 1 FROM e WHERE key = 'click' ORDER BY o LIMIT 3)"
)
def get_compat(s, d):
    """Four files: with an index, without one, with an index that lacks the key, and one after it."""
    shift = lambda df, i: df.withColumn("file_ord", F.lit(i))
    events, lacking = kv(s, d), shift(parts(s, d), 2)
    data = shift(events, 0).unionByName(shift(events, 1)).unionByName(lacking).unionByName(shift(events, 3))
    files = s.createDataFrame([(0, True), (1, False), (2, True), (3, False)], "file_ord int, indexed boolean")
    return ops.get_compat(data, ops.index(shift(events, 0)).unionByName(ops.index(lacking)), files, "click", 3).select("line", "file_ord")


# Extensions (not operations of the established tool)


@query("SELECT p_name AS key, p_brand AS value FROM part WHERE p_name BETWEEN 'b' AND 'h'")
def ext_range(s, d):
    return ops.key_range(parts(s, d), "b", "h").select("key", "value")


@query("SELECT event_type AS key, props AS value, event_id AS seq FROM events ORDER BY event_id LIMIT 10")
def ext_head(s, d):
    return ops.head(kv(s, d), 10).select("key", "value", "seq")


@query("SELECT event_type AS key, props AS value, event_id AS seq FROM events ORDER BY event_id DESC LIMIT 10")
def ext_tail(s, d):
    return ops.tail(kv(s, d), 10).select("key", "value", "seq")


@query("SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1")
def ext_histogram(s, d):
    return ops.histogram(kv(s, d))


@query("SELECT p_name AS key, p_partkey AS seq FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size < 3) AND p_name IS NOT NULL")
def ext_intersect(s, d):
    p = _t(s, d, "part")
    a, b = ops.table(p, "p_brand", "p_name", "p_partkey"), ops.table(p.where("p_size < 3"), "p_brand", "p_name", "p_partkey")
    return ops.intersect(a, b).select(F.col("value").alias("key"), "seq")


@query("SELECT p_name AS key, p_partkey AS seq FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size < 10)")
def ext_subtract(s, d):
    p = _t(s, d, "part")
    return ops.subtract(ops.table(p, "p_name", "p_brand", "p_partkey"), ops.table(p.where("p_size < 10"), "p_name", "p_brand", "p_partkey")).select("key", "seq")


@query("SELECT p_name AS key FROM part UNION SELECT event_type FROM events")
def ext_union(s, d):
    return ops.union_keys(parts(s, d), kv(s, d))


@query("(SELECT DISTINCT p_name AS key, 'left' AS side FROM part WHERE p_size < 30 AND p_name NOT IN (SELECT p_name FROM part WHERE p_size > 40)) UNION ALL (SELECT DISTINCT p_name, 'right' FROM part WHERE p_size > 40 AND p_name NOT IN (SELECT p_name FROM part WHERE p_size < 30))")
def ext_diff(s, d):
    p = _t(s, d, "part")
    return ops.diff(ops.table(p.where("p_size < 30"), "p_name", "p_brand", "p_partkey"), ops.table(p.where("p_size > 40"), "p_name", "p_brand", "p_partkey"))
