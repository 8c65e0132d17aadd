"""Byte codec for the record format: a small CBOR subset (text, bytes, unsigned 64-bit integers).

A data file is ``key value key value ...`` and an index file is ``key offset key offset ...``,
each item encoded in the shortest form, with no header, footer or separators.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

# Fixed values of the wire format: major types and the selectors that announce a wider length.
MAJOR_UINT, MAJOR_BYTES, MAJOR_TEXT = 0x00, 0x40, 0x60
INFO_MASK, MAJOR_MASK = 0x1F, 0xE0
WIDTHS = {24: 1, 25: 2, 26: 4, 27: 8}

TYPES = ("string", "binary", "uint64")


class Truncated(Exception):
    """The buffer ends inside an item."""


def encode_head(major: int, n: int) -> bytes:
    if not 0 <= n < 1 << 64:
        raise ValueError(f"{n} is not an unsigned 64-bit integer")
    if n < 24:
        return bytes([major | n])
    for info, width in WIDTHS.items():
        if n < 1 << (8 * width):
            return bytes([major | info]) + n.to_bytes(width, "big")
    raise AssertionError


def encode_item(value: object, kind: str) -> bytes:
    """Encode one key or value; ``None`` is refused because the format has no null."""
    if value is None:
        raise ValueError("the record format cannot hold NULL")
    if kind == "string":
        payload = str(value).encode("utf-8")
        return encode_head(MAJOR_TEXT, len(payload)) + payload
    if kind == "binary":
        payload = bytes(value)  # type: ignore[call-overload]
        return encode_head(MAJOR_BYTES, len(payload)) + payload
    if kind == "uint64":
        return encode_head(MAJOR_UINT, int(value))  # type: ignore[call-overload]
    raise ValueError(f"unknown item type {kind!r}; expected one of {TYPES}")


def decode_head(buf, pos: int) -> tuple[int, int]:
    """(number, next position). The major type is not checked and selectors 28-31 stand for
    themselves, as existing readers of this format do."""
    if pos >= len(buf):
        raise Truncated
    info = buf[pos] & INFO_MASK
    width = WIDTHS.get(info, 0)
    if not width:
        return info, pos + 1
    if pos + 1 + width > len(buf):
        raise Truncated
    return int.from_bytes(buf[pos + 1 : pos + 1 + width], "big"), pos + 1 + width


def decode_item(buf, pos: int, kind: str) -> tuple[object, int]:
    n, pos = decode_head(buf, pos)
    if kind == "uint64":
        return Decimal(n), pos
    end = pos + n
    if end > len(buf):  # also bounds a corrupt length before anything is allocated
        raise Truncated
    raw = bytes(buf[pos:end])
    return (raw.decode("utf-8") if kind == "string" else raw), end


def records(buf, key_type: str, value_type: str, start: int = 0, end: int | None = None, strict: bool = False) -> Iterator[tuple[int, object, object]]:
    """(offset, key, value) of the records that start in [start, end). A truncated last record
    ends the iteration silently unless ``strict``."""
    for pos, key, value in _records(buf, key_type, value_type, start, end, strict):
        yield pos, Decimal(key) if key_type == "uint64" else key, Decimal(value) if value_type == "uint64" else value


def entries(buf, key_type: str, start: int = 0, end: int | None = None, strict: bool = False) -> Iterator[tuple[int, object, int]]:
    """(position in the index, key, offset) of index entries that start in [start, end); as
    ``records``, but numbers are plain integers."""
    return _records(buf, key_type, "uint64", start, end, strict)  # type: ignore[return-value]


def _records(buf, key_type: str, value_type: str, start: int, end: int | None, strict: bool) -> Iterator[tuple[int, object, object]]:
    pos, size = start, len(buf)
    stop, widths, kinds = size if end is None else end, [WIDTHS.get(i, 0) for i in range(32)], (key_type, value_type)
    while pos < stop:
        at, items = pos, []
        for kind in kinds:  # decode_item, without calls
            if at >= size:
                break
            n = buf[at] & INFO_MASK
            at += 1
            if width := widths[n]:
                if at + width > size:
                    break
                n = int.from_bytes(buf[at : at + width], "big")
                at += width
            if kind == "uint64":
                items.append(n)
                continue
            if at + n > size:
                break
            raw = buf[at : at + n]
            items.append(str(raw, "utf-8") if kind == "string" else bytes(raw))
            at += n
        if len(items) < 2:
            if strict:
                raise ValueError(f"truncated record at offset {pos}")
            return
        yield pos, items[0], items[1]
        pos = at


def index_entries(buf, key_type: str, strict: bool = False) -> Iterator[tuple[object, int]]:
    for _, key, offset in entries(buf, key_type, strict=strict):
        yield key, offset


def canonical_key(value: object, kind: str) -> tuple[int, bytes]:
    """Sort key of the canonical order: encoded length first, then encoded bytes."""
    enc = encode_item(value, kind)
    return len(enc), enc


def major_of(byte: int) -> int:
    return byte & MAJOR_MASK


def embedded_of(byte: int) -> int:
    return byte & INFO_MASK


def embedded_for(n: int) -> int:
    return encode_head(0, n)[0]


def extra_bytes_for(n: int) -> int:
    return len(encode_head(0, n)) - 1


def extended_size(byte: int) -> int:
    info = byte & INFO_MASK
    return info if info in WIDTHS else 0


def read_exact(buf: bytes, pos: int, n: int) -> bytes:
    """Exactly n bytes or an end-of-file error; the caller's position only moves on success."""
    if pos + n > len(buf):
        raise EOFError(f"{n} bytes wanted at {pos}, {max(0, len(buf) - pos)} left")
    return buf[pos : pos + n]
