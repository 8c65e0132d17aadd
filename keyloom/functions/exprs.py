"""Column builders for the record format and its two key orders; all stay in JVM code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codec import MAJOR_BYTES, MAJOR_TEXT, MAJOR_UINT

_MAJOR = {"string": MAJOR_TEXT, "binary": MAJOR_BYTES, "uint64": MAJOR_UINT}
#: Exclusive upper limit of each head form, and its selector; None means the number itself.
_FORMS = ((24, None, 0), (1 << 8, 24, 1), (1 << 16, 25, 2), (1 << 32, 26, 4), (None, 27, 8))


def _by_width(n: Column, pick) -> Column:
    out = None
    for limit, info, width in _FORMS:
        value = pick(info, width)
        if limit is None:
            return out.otherwise(value)
        out = F.when(n < F.lit(limit), value) if out is None else out.when(n < F.lit(limit), value)
    raise AssertionError


def num_bytes(n: Column) -> Column:
    """Bytes that follow the head byte for the number n: 0, 1, 2, 4 or 8."""
    return _by_width(n, lambda info, width: F.lit(width))


def embedded_for(n: Column) -> Column:
    """Low five bits of the head byte for the number n."""
    return _by_width(n, lambda info, width: n.cast("int") if info is None else F.lit(info))


def embedded_of(byte: Column) -> Column:
    return byte.bitwiseAND(F.lit(31))


def major_of(byte: Column) -> Column:
    return byte.bitwiseAND(F.lit(224))


def extended_size(byte: Column) -> Column:
    low = embedded_of(byte)
    return F.when(low.between(24, 27), low).otherwise(F.lit(0))


def head_hex(major: int, n: Column) -> Column:
    """Upper-case hex of the head. n is a BIGINT or DECIMAL(20,0)."""
    digits = F.conv(n.cast("string"), 10, 16)

    def form(info, width):
        if info is None:
            return F.lpad(F.hex((n + F.lit(major)).cast("bigint")), 2, "0")
        return F.concat(F.lit(f"{major + info:02X}"), F.lpad(digits, 2 * width, "0"))

    return _by_width(n, form)


def encode_item(value: Column, kind: str) -> Column:
    """The item's bytes."""
    major = _MAJOR[kind]
    if kind == "uint64":
        return F.unhex(head_hex(major, value))
    raw = F.encode(value, "UTF-8") if kind == "string" else value
    return F.concat(F.unhex(head_hex(major, F.octet_length(value).cast("bigint"))), raw)


def encoded_size(value: Column, kind: str) -> Column:
    """Length of the item's bytes without building them."""
    if kind == "uint64":
        return (F.lit(1) + num_bytes(value)).cast("bigint")
    n = F.octet_length(value).cast("bigint")
    return F.lit(1) + num_bytes(n) + n


def decode_uint(item: Column) -> Column:
    """Number of a single encoded unsigned integer, exact over the full range."""
    low = F.conv(F.hex(F.substring(item, 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(31))
    wide = F.conv(F.hex(F.substring(item, F.lit(2), F.octet_length(item))), 16, 10)
    return F.when(low < 24, low.cast("decimal(20,0)")).otherwise(wide.cast("decimal(20,0)"))


def decode_payload(item: Column, kind: str) -> Column:
    """Payload of a single encoded text or bytes item."""
    low = F.conv(F.hex(F.substring(item, 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(31))
    width = F.when(low == 24, 1).when(low == 25, 2).when(low == 26, 4).when(low == 27, 8).otherwise(0)
    raw = F.substring(item, width + F.lit(2), F.octet_length(item))
    return F.decode(raw, "UTF-8") if kind == "string" else raw


def canonical_sort(key: Column, kind: str) -> list[Column]:
    """Sort columns of the canonical order: within one type the head grows with the payload, so
    encoded length then bytes is payload length then payload."""
    return [key] if kind == "uint64" else [F.octet_length(key), key]


def debug_quoted(text: Column) -> Column:
    """Text in double quotes with backslash escapes; other control characters as \\u{hex}."""
    plain = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "\\0")]
    rest = [(chr(c), f"\\u{{{c:x}}}") for c in (*range(1, 32), *range(127, 160)) if chr(c) not in "\n\r\t"]
    swap = lambda col, pairs: reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, col)
    out = swap(text, plain)
    return F.concat(F.lit('"'), F.when(out.rlike(r"[\x01-\x1f\x7f-\x9f]"), swap(out, rest)).otherwise(out), F.lit('"'))


def hex_list(data: Column) -> Column:
    """Bytes as ``[68, 65]``: lower-case hex without leading zeros."""
    pairs = F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))
    short = F.transform(pairs, lambda x: F.when(x == "00", F.lit("0")).otherwise(F.lower(F.ltrim(x, F.lit("0")))))
    return F.concat(F.lit("["), F.array_join(short, ", "), F.lit("]"))
