import io
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from keyloom import cli
from keyloom.functions import codec
from keyloom.operators import ops, render
from keyloom.sources import register
from keyloom.sources.paths import absolute, index_path, relative
from keyloom.streaming import appended, key_counts


def make(path, rows, kt="string", vt="string", index=True):
    off, data, idx = 0, b"", b""
    for k, v in rows:
        e = codec.encode_item(k, kt) + codec.encode_item(v, vt)
        idx += codec.encode_item(k, kt) + codec.encode_item(off, "uint64")
        data, off = data + e, off + len(e)
    open(path, "wb").write(data)
    if index:
        open(index_path(str(path)), "wb").write(idx)
    return str(path)


AF = [(c, str(i)) for i, c in enumerate("abcdef", 1)]


def run(spark, *argv):
    out = io.StringIO()
    code = cli.main(list(argv), spark, out)
    return code, out.getvalue()


def test_paths(tmp_path):
    assert [index_path(p) for p in ("x.sst", "x", "a.b.sst")] == ["x.index.sst", "x.index", "a.b.index.sst"]
    with pytest.raises(FileNotFoundError):
        absolute([str(tmp_path / "none")])
    assert relative(["/a/b", "/c"], "/a") == (["b"], ["/c"])


def test_scan_index_and_info(spark, tmp_path):
    p = make(tmp_path / "t.sst", [("hello", "world"), ("foo", "bar")])
    assert [(r.key, r.offset) for r in ops.read(spark, [p], mode="index").orderBy("ordinal").collect()] == [("hello", 0), ("foo", 12)]
    assert [(r.key, r.value, r.offset, r.seq) for r in ops.read(spark, [p]).orderBy("seq").collect()] == [("hello", "world", 0, 0), ("foo", "bar", 12, 1)]
    empty = make(tmp_path / "e.sst", [])
    rows = {r.path: r for r in ops.info(spark, [p, empty, "/none.sst"]).collect()}
    assert (rows[p]["count"], rows[p].sorted, rows[p].min, rows[p].max, rows[p].unique) == (2, "false", "foo", "hello", True)
    assert (rows[empty]["count"], rows[empty].sorted, rows[empty].min, rows[empty].unique) == (0, "native,cbor", None, True)
    assert not rows["/none.sst"].data_exists
    dup = make(tmp_path / "d.sst", [("a", "1"), ("a", "2"), ("b", "3")])
    assert ops.info(spark, [dup]).first().unique is False and ops.info(spark, [dup], compat=True).first().unique is True
    canon = make(tmp_path / "c.sst", [("1", ""), ("5", ""), ("00", "")])
    assert ops.info(spark, [canon]).first().sorted == "cbor"


def test_types_and_limits(spark, tmp_path):
    big = [(Decimal((1 << 64) - 1), b"x"), (Decimal(1), b"y")]
    p = make(tmp_path / "u", big, "uint64", "binary")
    assert sorted((r.key, bytes(r.value)) for r in ops.read(spark, [p], keyType="uint64", valueType="binary").collect()) == sorted(big)
    for n in (23, 24, 255, 256, 65535, 65536):
        q = make(tmp_path / f"n{n}", [("k", "é" * (n // 2))])
        assert ops.read(spark, [q]).first().value == "é" * (n // 2)


def test_canonical_order(spark):
    rows = [("2", 1), ("1", 2), ("5", 2), ("1", 1), ("2", 2), ("4", 2), ("3", 2), ("00", 1)]
    df = spark.createDataFrame([(k, "", o, 0) for k, o in rows], "key string, value string, offset bigint, file_ord int")
    assert [(r.key, r.offset) for r in ops.sort_canonical(df).collect()] == [("1", 1), ("1", 2), ("2", 1), ("2", 2), ("3", 2), ("4", 2), ("5", 2), ("00", 1)]


def test_search(spark):
    df = spark.createDataFrame([(bytes([x]),) for x in (1, 1, 2, 2, 3, 4, 4, 5)], "key binary")
    assert [ops.search_first(df, bytes([x])).first()[0] for x in (1, 2, 3, 4, 5)] == [0, 2, 4, 5, 7]
    assert tuple(ops.search_first(df, b"\x06").first()) == (None, 8)
    assert tuple(ops.search_first(df.limit(0), b"\x06").first()) == (None, 0)


@pytest.mark.parametrize("pushdown", [True, False])
def test_lookup(spark, tmp_path, pushdown):
    dup = [("baz", "qux")] + [("foo", f"bar{i}") for i in range(5)] + [("hello", "world"), ("foo", "late")]
    a, b = make(tmp_path / "a", dup), make(tmp_path / "b", [("foo", "second")], index=False)
    try:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
        register(spark, pushdown)
        df = ops.read(spark, [a, b])
        assert [r.value for r in ops.in_order(ops.get(df, "foo")).collect()] == [f"bar{i}" for i in range(5)] + ["late", "second"]
        assert [r.value for r in ops.in_order(ops.get(df, "foo", 2)).collect()] == ["bar0", "bar1", "second"]
        assert ops.get(df, "none").count() == 0 == ops.get(df, "foo", 0).count()
        assert df.where("key > 'foo' and value = 'world'").count() == 1 and df.where("key like 'fo%'").count() == 7
    finally:
        register(spark)


def test_incomplete_index_hides_nothing(spark, tmp_path):
    p = make(tmp_path / "t", AF)
    tail = b"".join(codec.encode_item(k, "string") + codec.encode_item(4 * i, "uint64") for i, (k, _) in enumerate(AF) if i > 2)
    open(index_path(p), "wb").write(tail)
    assert ops.get(ops.read(spark, [p]), "a").count() == 1
    assert {r.fault for r in ops.validate(ops.read(spark, [p]), ops.read(spark, [p], mode="index")).collect()} == {"not indexed"}
    assert ops.reachable(ops.read(spark, [p]), ops.read(spark, [p], mode="index")).count() == 3


def test_splits_and_truncation(spark, tmp_path):
    rows = [(f"k{i:04d}", "v" * (i % 50)) for i in range(2000)]
    p = make(tmp_path / "t", rows)
    df = ops.read(spark, [p], splitBytes="4000")
    assert df.rdd.getNumPartitions() > 5
    assert [(r.key, r.value) for r in df.orderBy("seq").collect()] == rows
    open(p, "ab").write(codec.encode_item("dangling", "string"))
    assert ops.read(spark, [p]).count() == 2000
    with pytest.raises(Exception, match="truncated"):
        ops.read(spark, [p], failOnTruncated="true").count()
    with pytest.raises(Exception, match="does not exist"):
        ops.read(spark, [str(tmp_path / "none")]).count()
    assert ops.read(spark, [str(tmp_path / "none")], missing="skip").count() == 0


def test_large_files_are_searched_in_splits(spark, tmp_path):
    rows = [(f"k{i % 7}", f"v{i}") for i in range(3000)]
    p = make(tmp_path / "t", rows)
    hit = ops.get(ops.read(spark, [p], splitBytes="2000"), "k3")
    assert hit.rdd.getNumPartitions() > 5
    assert [(r.value, r.seq) for r in hit.orderBy("seq").collect()] == [(f"v{i}", i) for i in range(3, 3000, 7)]


def test_rebuilt_index(spark, tmp_path):
    p = make(tmp_path / "t.sst", AF)
    want = open(index_path(p), "rb").read()
    os.remove(index_path(p))
    ops.append(spark, [p], "g", "7")
    assert len(open(index_path(p), "rb").read()) < len(want)
    open(p, "ab").write(codec.encode_item("dangling", "string"))
    ops.rebuild_index(spark, p)
    assert open(index_path(p), "rb").read() == want + codec.encode_item("g", "string") + codec.encode_item(24, "uint64")
    assert sorted(os.listdir(tmp_path)) == ["t.index.sst", "t.sst"]
    u = make(tmp_path / "u", [(Decimal(5), b"x"), (Decimal(1), b"y")], "uint64", "binary", index=False)
    ops.rebuild_index(spark, u, "uint64", "binary")
    assert [int(r.key) for r in ops.read(spark, [u], mode="index", keyType="uint64").orderBy("ordinal").collect()] == [5, 1]


def test_write_append_overwrite(spark, tmp_path):
    p = str(tmp_path / "w.sst")
    df = spark.createDataFrame([(k, v, i, 0) for i, (k, v) in enumerate(AF)], "key string, value string, offset bigint, file_ord int")
    ops.save(df, p)
    with pytest.raises(FileExistsError):
        ops.save(df, p)
    ops.save(df, p, mode="append")
    assert [r.offset for r in ops.read(spark, [p], mode="index").orderBy("ordinal").select(F.col("offset").cast("int")).collect()] == [4 * i for i in range(12)]
    ops.save(df, p, mode="overwrite")
    assert open(p, "rb").read() == b"".join(codec.encode_item(x, "string") for kv in AF for x in kv)
    with pytest.raises(Exception, match="NULL"):
        ops.save(spark.createDataFrame([(None, "v")], "key string, value string"), str(tmp_path / "null"))
    assert not [f for f in os.listdir(tmp_path) if f.startswith(".w")]


def test_commands(spark, tmp_path):
    ms = [make(tmp_path / f"m{i}.sst", AF[2 * i : 2 * i + 2]) for i in range(3)]
    assert run(spark, "merge", *ms[::-1]) == (0, "".join(f"({k}, {v})\n" for k, v in AF))
    out = str(tmp_path / "out.sst")
    assert run(spark, "sort", *ms, "-o", out)[0] == 0
    assert run(spark, "merge", ms[0], "-o", ms[0])[0] == 1 and run(spark, "merge", "/none")[0] == 1
    assert run(spark, "dump", out)[1].splitlines()[:2] == ['(0) "a": "1"', '(4) "b": "2"']
    assert run(spark, "keys", *ms)[1] == "a\nb\nc\nd\ne\nf\n" and run(spark, "values", ms[0])[1] == "1\n2\n"
    assert run(spark, "index", ms[0])[1] == '"a": 0\n"b": 4\n'
    assert run(spark, "get", *ms, "-k", "c")[1] == "c: 3\n"
    assert run(spark, "get", "/none", "-k", "c")[1] == "File does not exist: /none\n"
    assert run(spark, "export", ms[0], "-f", "json")[1] == '{"a":"1"}\n{"b":"2"}\n'
    assert run(spark, "export", ms[0], "-f", "json", "--compat")[1] == '{"a": "1"},\n{"b": "2"},\n'
    assert run(spark, "export", ms[0], "-f", "csv")[1] == "a,1\nb,2\n" and run(spark, "export", ms[0], "-f", "odd")[1] == "a: 1\nb: 2\n"
    assert run(spark, "dump", ms[0], ms[1], "--compat")[1].count("\n") == 2 and run(spark, "dump", ms[0], ms[1])[1].count("\n") == 4
    assert run(spark, "get", ms[0], ms[1], "-k", "c", "--compat")[1] == ""  # the first index lacks the key
    os.remove(index_path(ms[0]))
    assert run(spark, "get", ms[0], ms[1], "-k", "c", "--compat")[1] == "c: 3\n" and run(spark, "get", ms[0], "-k", "a", "--compat")[1] == "1\n"
    assert run(spark, "get", ms[0], "-k", "b", "-n", "0", "--compat")[1] == "" and run(spark, "get", ms[1], "-k", "c", "-n", "0", "--compat")[1] == "c: 3\n"
    assert run(spark, "index", ms[0], "--rebuild")[1] == '"a": 0\n"b": 4\n'
    new = str(tmp_path / "new.sst")
    run(spark, "append", new, "-k", "k", "-d", "v")
    run(spark, "append", new, "-k", "k", "-d", "w")
    assert run(spark, "get", new, "-k", "k", "-n", "1")[1] == "k: v\n"
    text = run(spark, "info", new, "/none.sst")[1]
    assert " count: 2" in text and " unique: false" in text and "(missing ✘)" in text
    assert cli.main([], spark) == 0


def test_quoted_renderings(spark):
    df = spark.createDataFrame([('a"b', "x,y\n", 0, 0)], "key string, value string, offset bigint, file_ord int")
    assert render.lines(df, "json").first().line == '{"a\\"b":"x,y\\n"}'
    assert render.lines(df, "csv").first().line.startswith('"a""b",')
    assert render.lines(df.withColumn("value", F.lit("  x ")), "csv").first().line == '"a""b",  x '
    assert render.lines(df, "tsv").first().line == 'a"b\tx,y\n'


def test_stream(spark, tmp_path):
    p = make(tmp_path / "s", AF[:3])
    q = key_counts(appended(spark, [p])).writeStream.outputMode("complete").format("memory").queryName("tailed").start()
    try:
        q.processAllAvailable()
        open(p, "ab").write(codec.encode_item("a", "string") + codec.encode_item("9", "string") + codec.encode_item("half", "string"))
        q.processAllAvailable()
        assert {r.key: r.n for r in spark.table("tailed").collect()} == {"a": 2, "b": 1, "c": 1}
    finally:
        q.stop()
