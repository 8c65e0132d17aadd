import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.functions import codec, exprs

HEADS = [(0x40, 40000, [89, 156, 64]), (0x40, 66000, [90, 0, 1, 1, 208]), (0x40, 1 << 32, [91, 0, 0, 0, 1, 0, 0, 0, 0]), (0x40, (1 << 64) - 1, [91] + [255] * 8)]
INTS = [(0, [0]), (1, [1]), (23, [23]), (24, [24, 24]), (25, [24, 25]), (255, [24, 255]), (256, [25, 1, 0]), (65535, [25, 255, 255]), (65536, [26, 0, 1, 0, 0]), ((1 << 32) - 1, [26] + [255] * 4), (1 << 32, [27, 0, 0, 0, 1, 0, 0, 0, 0]), ((1 << 64) - 1, [27] + [255] * 8)]


@pytest.mark.parametrize("major,n,want", HEADS + [(m << 5, 0, [m << 5]) for m in range(8)])
def test_heads(major, n, want):
    assert list(codec.encode_head(major, n)) == want


@pytest.mark.parametrize("n,want", INTS)
def test_integers(n, want):
    assert list(codec.encode_item(n, "uint64")) == want
    assert codec.decode_item(bytes(want), 0, "uint64") == (n, len(want))
    assert codec.embedded_for(n) == want[0] & 31 and codec.extra_bytes_for(n) == len(want) - 1


def test_text_and_bytes():
    assert list(codec.encode_item("", "string")) == [96]
    assert list(codec.encode_item("hello", "string")) == [101, 104, 101, 108, 108, 111]
    assert list(codec.encode_item(b"\1\2\3\4", "binary")) == [68, 1, 2, 3, 4]


def test_quirks():
    assert codec.decode_head(b"\x1e", 0) == (30, 1)  # selectors 28-31 stand for themselves
    assert codec.decode_item(codec.encode_item(b"ab", "binary"), 0, "string")[0] == "ab"  # the major type is not checked
    assert list(codec.records(codec.encode_item("k", "string"), "string", "string")) == []  # no value: dropped
    with pytest.raises(ValueError):
        list(codec.records(b"\x61k\x7f", "string", "string", strict=True) ) or list(codec.records(b"\x61k\x7a\xff\xff\xff\xff", "string", "string", strict=True))
    with pytest.raises(UnicodeDecodeError):
        codec.decode_item(b"\x61\xff", 0, "string")
    with pytest.raises(ValueError):
        codec.encode_item(None, "string")
    with pytest.raises(EOFError):
        codec.read_exact(b"12345", 3, 3)


@given(st.one_of(st.tuples(st.just("string"), st.text()), st.tuples(st.just("binary"), st.binary()), st.tuples(st.just("uint64"), st.integers(0, (1 << 64) - 1))))
def test_round_trip(case):
    kind, value = case
    enc = codec.encode_item(value, kind)
    assert codec.decode_item(enc, 0, kind) == (value, len(enc))


def test_expressions_agree(spark):
    lens = [0, 5, 23, 24, 255, 256, 65535, 65536]
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(lens)], "i int, s string")
    for r in df.select("i", exprs.encode_item(F.col("s"), "string").alias("e"), exprs.encoded_size(F.col("s"), "string").alias("n")).collect():
        want = codec.encode_item("x" * lens[r["i"]], "string")
        assert bytes(r["e"]) == want and r["n"] == len(want)
    from decimal import Decimal

    ints = spark.createDataFrame([(Decimal(n),) for n, _ in INTS], "n decimal(20,0)")
    enc = exprs.encode_item(F.col("n"), "uint64")
    for r in ints.select("n", enc.alias("e"), exprs.decode_uint(enc).alias("d")).collect():
        assert bytes(r["e"]) == codec.encode_item(int(r["n"]), "uint64") and r["d"] == r["n"]
    back = df.select("s", exprs.decode_payload(exprs.encode_item(F.col("s"), "string"), "string").alias("d"))
    assert all(r["s"] == r["d"] for r in back.collect())
    assert spark.sql("SELECT unhex('4441') AS b").select(exprs.hex_list(F.col("b")).alias("h")).first()["h"] == "[44, 41]"
    assert spark.createDataFrame([('a"\\\n\x01é',)], "s string").select(exprs.debug_quoted(F.col("s")).alias("q")).first()["q"] == '"a\\"\\\\\\n\\u{1}é"'


@pytest.mark.parametrize("key_type,value_type", [("string", "uint64"), ("uint64", "binary"), ("binary", "string")])
def test_records_equal_items_read_one_by_one(key_type, value_type):
    sample = {"string": ["", "a", "\u00e9\u3042" * 40, "x" * 70_000], "binary": [b"", b"\xff" * 24, bytes(300)], "uint64": [0, 23, 24, 255, 256, 65_536, (1 << 32), (1 << 64) - 1]}
    rows = [(k, v) for k in sample[key_type] for v in sample[value_type]]
    parts = [codec.encode_item(k, key_type) + codec.encode_item(v, value_type) for k, v in rows]
    buf = b"".join(parts)
    got = list(codec.records(buf, key_type, value_type, strict=True))
    assert [(k, v) for _, k, v in got] == rows
    at = 0
    for offset, key, value in got:
        assert offset == at and (codec.decode_item(buf, at, key_type)[0], type(key)) == (key, type(codec.decode_item(buf, at, key_type)[0]))
        at = codec.decode_item(buf, codec.decode_item(buf, at, key_type)[1], value_type)[1]
    assert at == len(buf)
    last = len(buf) - len(parts[-1])
    for cut in {last + 1, len(buf) - 1} - {len(buf)}:
        if last < cut:
            assert [o for o, _, _ in codec.records(buf[:cut], key_type, value_type)] == [o for o, _, _ in got[:-1]]
            with pytest.raises(ValueError):
                list(codec.records(buf[:cut], key_type, value_type, strict=True))
    if value_type == "uint64":
        assert list(codec.entries(buf, key_type)) == [(o, k, int(v)) for o, k, v in got]
