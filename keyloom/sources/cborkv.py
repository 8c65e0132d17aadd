"""Python Data Source ``cborkv``: data files, index files, a writer and a tailing stream reader.

Options: ``mode`` data|index, ``keyType``/``valueType`` string|binary|uint64, ``indexPath`` (one
input only), ``missing`` fail|skip, ``failOnTruncated``, ``splitBytes`` (target bytes of a split),
``layout`` single|parts (write), ``bufferSize`` (write).

The format has no sync marker, so a file is splittable only with its index: every so many index
offsets become split boundaries. Without a complete index a file is one partition. Key predicates
are resolved in the index by the tasks, each in its split's part of it.
"""

from __future__ import annotations

import glob
import json
import mmap
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

from keyloom.functions import codec
from keyloom.sources.paths import index_path, local

FORMAT = "cborkv"
PUSHDOWN_CONF = "spark.sql.python.filterPushdown.enabled"
BATCH_BYTES = 4 << 20
_SQL = {"string": "string", "binary": "binary", "uint64": "decimal(20,0)"}
_ARROW = {"string": pa.string(), "binary": pa.binary(), "uint64": pa.decimal128(20, 0)}


def _buffer(path: str):
    """The file's bytes, mapped; an empty file can't be mapped."""
    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.path.getsize(path) else b""


@dataclass
class _Split(InputPartition):
    path: str
    file_ord: int
    start: int
    end: int
    seq: int | None
    entries: tuple[int, int] | None = None  # byte range of its entries in the index; None: not known

    def __post_init__(self):
        super().__init__(self)


class _Options:
    def __init__(self, options: dict):
        get = {k.lower(): v for k, v in options.items()}.get
        paths = json.loads(get("paths")) if get("paths") else [get("path")] if get("path") else []
        self.paths = [f for p in map(local, paths) for f in self._expand(p)]
        self.mode, self.key, self.value = get("mode", "data"), get("keytype", "string"), get("valuetype", "string")
        self.index, self.missing = get("indexpath"), get("missing", "fail")
        self.strict = get("failontruncated", "false").lower() == "true"
        self.split_bytes = int(get("splitbytes", str(32 << 20)))
        self.layout, self.buffer = get("layout", "single"), int(get("buffersize", "8192"))
        if self.mode not in ("data", "index") or self.layout not in ("single", "parts") or self.missing not in ("fail", "skip"):
            raise ValueError("mode is data or index, layout is single or parts, missing is fail or skip")
        for kind in (self.key, self.value):
            if kind not in codec.TYPES:
                raise ValueError(f"unknown item type {kind!r}; expected one of {codec.TYPES}")

    @staticmethod
    def _expand(path: str) -> list[str]:
        """A folder written with layout=parts stands for its data files in key order."""
        return sorted(f for f in glob.glob(f"{path}/part-*.sst") if not f.endswith(".index.sst")) if os.path.isdir(path) else [path]

    def index_of(self, path: str) -> str:
        return local(self.index) if self.index else index_path(path)


def _test(f: Filter):
    if isinstance(f, EqualTo):
        return lambda k: k == f.value
    if isinstance(f, In):
        return lambda k: k in f.value
    if isinstance(f, GreaterThan):
        return lambda k: k > f.value
    if isinstance(f, GreaterThanOrEqual):
        return lambda k: k >= f.value
    if isinstance(f, LessThan):
        return lambda k: k < f.value
    if isinstance(f, LessThanOrEqual):
        return lambda k: k <= f.value
    if isinstance(f, StringStartsWith):
        return lambda k: k.startswith(f.value)
    return None


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.o, self.filters = _Options(options), []

    def _keeps(self):
        """The key predicates as one function."""
        # byte order of UTF-8 is code point order, which is how Python compares str
        tests = [_test(f) for f in self.filters]
        return tests[0] if len(tests) == 1 else lambda key: all(t(key) for t in tests)

    def partitions(self) -> list[_Split]:
        out = []
        for n, path in enumerate(self.o.paths):
            target = self.o.index_of(path) if self.o.mode == "index" else path
            if not os.path.isfile(target):
                if self.o.missing == "skip":
                    continue
                raise FileNotFoundError(f"File does not exist: {target}")
            size = os.path.getsize(target)
            out += [_Split(path, n, 0, size, 0)] if self.o.mode == "index" else self._splits(path, n, size)
        return out or [_Split("", 0, 0, 0, 0)]

    def _splits(self, path: str, n: int, size: int) -> list[_Split]:
        """Splits of about ``splitBytes`` where the index covers the file, else one. Only their bounds
        are held here; entries that pass the key predicates are found where a split is read."""
        index = self.o.index_of(path)
        whole = [_Split(path, n, 0, size, 0)]
        if size <= self.o.split_bytes or not os.path.isfile(index):
            return whole
        cuts, buf = [], _buffer(index)
        for i, pos, off in self._covering(path, buf) or ():
            if not cuts or off >= cuts[-1][0] + self.o.split_bytes:
                cuts.append((off, i, pos))
        cuts.append((size, None, len(buf)))
        return [_Split(path, n, a, b, i, (x, y)) for (a, i, x), (b, _, y) in zip(cuts, cuts[1:])] or whole

    def _covering(self, path: str, buf) -> Iterator[tuple[int, int, int]] | None:
        """(ordinal, position in the index, offset) of the entries of an index that lists ascending
        offsets from the first record to the end of the last, else None. An index made after an
        earlier one was lost starts late and must not hide the older rows."""
        last = -1
        try:
            for _, _, off in codec.entries(buf, self.o.key, strict=True):
                if off <= last or (last < 0 and off):
                    return None
                last = off
            if last < 0:
                return None
            data = _buffer(path)
            _, at = codec.decode_item(data, last, self.o.key)
            _, at = codec.decode_item(data, at, self.o.value)
        except (ValueError, codec.Truncated):
            return None
        return ((i, pos, off) for i, (pos, _, off) in enumerate(codec.entries(buf, self.o.key))) if at == len(data) else None

    def read(self, split: _Split) -> Iterator[pa.RecordBatch]:
        if not split.path:
            return
        o = self.o
        if o.mode == "index":
            rows = ((k, v, split.path, i, split.file_ord) for i, (_, k, v) in enumerate(codec.records(_buffer(o.index_of(split.path)), o.key, "uint64", strict=o.strict)))
            schema = index_schema(o.key)
        else:
            rows, schema = self._data(split), data_schema(o.key, o.value)
        keeps = self._keeps()
        yield from _batches((r for r in rows if keeps(r[0])) if self.filters else rows, schema)

    def _data(self, split: _Split):
        o, buf = self.o, _buffer(split.path)
        if self.filters and (hits := self._hits(split)) is not None:
            for at, seq in hits:
                for off, k, v in codec.records(buf, o.key, o.value, at, at + 1, o.strict):
                    yield k, v, split.path, off, seq, split.file_ord
            return
        for i, (off, k, v) in enumerate(codec.records(buf, o.key, o.value, split.start, split.end, o.strict)):
            yield k, v, split.path, off, split.seq + i, split.file_ord

    def _hits(self, split: _Split) -> Iterator[tuple[int, int]] | None:
        """(offset, seq) of the split's entries that pass the key predicates, one at a time; None
        where no index covers the file."""
        index = self.o.index_of(split.path)
        if not os.path.isfile(index):
            return None
        buf = _buffer(index)
        if split.entries is None and self._covering(split.path, buf) is None:
            return None
        start, end = split.entries or (0, len(buf))
        keeps = self._keeps()
        return ((off, split.seq + i) for i, (_, k, off) in enumerate(codec.entries(buf, self.o.key, start, end)) if keeps(k))


class PushingReader(Reader):
    """Key predicates are taken over completely: resolved in the index when it covers the file,
    and tested on every row in any case."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if getattr(f, "attribute", None) == ("key",) and _test(f) and getattr(f, "value", None) is not None:
                self.filters.append(f)
            else:
                yield f


def _batches(rows, schema: pa.Schema):
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 64 + sum(len(x) for x in r[:2] if isinstance(x, (str, bytes)))
        if size >= BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def data_schema(key: str, value: str) -> pa.Schema:
    return pa.schema([("key", _ARROW[key]), ("value", _ARROW[value]), ("path", pa.string()), ("offset", pa.int64()), ("seq", pa.int64()), ("file_ord", pa.int32())])


def index_schema(key: str) -> pa.Schema:
    return pa.schema([("key", _ARROW[key]), ("offset", _ARROW["uint64"]), ("path", pa.string()), ("ordinal", pa.int64()), ("file_ord", pa.int32())])


@dataclass
class _Written(WriterCommitMessage):
    task: int
    data: str
    index: str


class Writer(DataSourceArrowWriter):
    """Each task writes a data and an index file beside the target. On commit, ``parts`` renames
    them (no data passes the driver) and ``single`` appends them to the target, data first and
    index last, so that a crash leaves a data file longer than its index says."""

    def __init__(self, options: dict, overwrite: bool):
        self.o, self.overwrite = _Options({**options, "paths": ""} if options.get("layout") == "parts" else options), overwrite
        self.target = local(options["path"])
        self.run = uuid.uuid4().hex[:12]
        append = self.o.layout == "single" and not overwrite and os.path.isfile(self.target)
        self.base = os.path.getsize(self.target) if append else 0

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        folder = self.target if self.o.layout == "parts" else os.path.dirname(self.target) or "."
        os.makedirs(folder, exist_ok=True)
        stem = f"{folder}/.{os.path.basename(self.target)}-{self.run}-{task:05d}-{uuid.uuid4().hex[:8]}"
        offset = self.base
        with open(f"{stem}.data", "wb", buffering=self.o.buffer) as data, open(f"{stem}.idx", "wb", buffering=self.o.buffer) as index:
            for batch in iterator:
                for key, value in zip(batch.column("key").to_pylist(), batch.column("value").to_pylist(), strict=True):
                    k, v = codec.encode_item(key, self.o.key), codec.encode_item(value, self.o.value)
                    data.write(k + v)
                    index.write(k + codec.encode_item(offset, "uint64"))
                    offset += len(k) + len(v)
            for f in (data, index):
                f.flush()
                os.fsync(f.fileno())
        return _Written(task, f"{stem}.data", f"{stem}.idx")

    def commit(self, messages: list[_Written]) -> None:
        done = sorted((m for m in messages if m), key=lambda m: m.task)
        if self.o.layout == "parts":
            if self.overwrite:
                for f in glob.glob(f"{self.target}/part-*.sst"):
                    os.remove(f)
            base = len(glob.glob(f"{self.target}/part-*.index.sst"))
            for i, m in enumerate(m for m in done if os.path.getsize(m.data)):
                final = f"{self.target}/part-{base + i:05d}.sst"
                os.replace(m.data, final)
                os.replace(m.index, index_path(final))
            self.abort(done)
            return
        index = self.o.index_of(self.target)
        mode = "wb" if self.overwrite else "ab"
        bases = []
        with open(self.target, mode) as out:
            for m in done:
                bases.append(out.tell())
                with open(m.data, "rb") as f:
                    while block := f.read(BATCH_BYTES):
                        out.write(block)
            out.flush()
            os.fsync(out.fileno())
        with open(index, mode) as out:
            for base, m in zip(bases, done, strict=True):
                if base == self.base:  # the first task's, all of them as ``ops.save`` writes: offsets stand
                    with open(m.index, "rb") as f:
                        while block := f.read(BATCH_BYTES):
                            out.write(block)
                    continue
                for key, offset in codec.index_entries(_buffer(m.index), self.o.key):
                    out.write(codec.encode_item(key, self.o.key) + codec.encode_item(base - self.base + offset, "uint64"))
            out.flush()
            os.fsync(out.fileno())
        self.abort(done)

    def abort(self, messages: list[_Written]) -> None:
        for m in messages:
            for f in (m.data, m.index) if m else ():
                if os.path.exists(f):
                    os.remove(f)


class StreamReader(DataSourceStreamReader):
    """Follows append-only files: the offset is the number of bytes of each file already read.
    Only whole records are taken; a record still being written waits for the next batch."""

    def __init__(self, options: dict):
        self.o = _Options(options)
        self.ends = {p: 0 for p in self.o.paths}

    def initialOffset(self) -> dict:
        return {p: 0 for p in self.o.paths}

    def latestOffset(self) -> dict:
        for p in self.o.paths:
            if os.path.isfile(p) and os.path.getsize(p) > self.ends[p]:
                self.ends[p] = self._whole(_buffer(p), self.ends[p])
        return dict(self.ends)

    def _whole(self, buf, pos: int) -> int:
        """End of the last whole record; only heads are read."""
        while True:
            at = pos
            try:
                for kind in (self.o.key, self.o.value):
                    n, at = codec.decode_head(buf, at)
                    at += 0 if kind == "uint64" else n
            except codec.Truncated:
                return pos
            if at > len(buf):
                return pos
            pos = at

    def partitions(self, start: dict, end: dict) -> list[_Split]:
        return [_Split(p, i, start.get(p, 0), end[p], None) for i, p in enumerate(self.o.paths) if end.get(p, 0) > start.get(p, 0)]

    def read(self, split: _Split):
        buf = _buffer(split.path)[: split.end] if split.end else b""
        rows = ((k, v, split.path, off, None, split.file_ord) for off, k, v in codec.records(buf, self.o.key, self.o.value, split.start, split.end, True))
        yield from _batches(rows, data_schema(self.o.key, self.o.value))


class CborKV(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        o = _Options(dict(self.options))
        if o.mode == "index":
            return f"key {_SQL[o.key]}, offset decimal(20,0), path string, ordinal bigint, file_ord int"
        return f"key {_SQL[o.key]}, value {_SQL[o.value]}, path string, offset bigint, seq bigint, file_ord int"

    def reader(self, schema):
        return Reader(dict(self.options))

    def writer(self, schema, overwrite):
        return Writer(dict(self.options), overwrite)

    def streamReader(self, schema):
        return StreamReader(dict(self.options))


class PushingCborKV(CborKV):
    def reader(self, schema):
        return PushingReader(dict(self.options))


def register(spark: SparkSession, pushdown: bool = True) -> None:
    """Register the source. With pushdown, the session setting that Python sources need for it is
    switched on; without, the plain reader is used, which works under either setting."""
    if pushdown:
        spark.conf.set(PUSHDOWN_CONF, "true")
    spark.dataSource.register(PushingCborKV if pushdown else CborKV)
