"""Language-model scoring with a hierarchical Pitman-Yor model of word sequences.

Every context (the last ``order`` - 1 words) has a restaurant whose customers are the words that
followed it in training; each table opened there sends one customer to the parent, the restaurant of
the context without its farthest word, and so on up to the restaurant of all words, whose base is
uniform over the vocabulary and one unknown word. A text begins with ``order`` - 1 begin marks.

Seating is sampled by Gibbs over the whole hierarchy: in each sweep the number of tables of a dish is
drawn anew given the rest of its restaurant, and given that its tables are customers of the parent
(Stirling numbers of both; beyond ``EXACT`` customers their scaling limit for the dish, and the parent's
predictive probability for the parent), deepest contexts first. Counts of a restaurant and of its parent
follow after each of ``BATCHES`` random parts of the dishes. All restaurants with the same last word lie in one
bucket and are swept together; the restaurant of all words is seated between rounds of ``INNER`` sweeps: it gets
the tables of all buckets, and its customers and tables return as the buckets' parent. After ``ROUNDS`` rounds the
predictive probabilities are averaged over ``KEPT`` further sweeps.

Distribution: documents are read once into chunks of about ``CHUNK`` tokens (files in the shared
folder). Chunks exchange packed arrays with buckets, and send to those only that they have something
for. First, buckets of words add up how often each word occurs in the whole corpus and number the words;
from this come the exact counts, and the number of parts of each last word: one that occurs more than half a
bucket's size of times is split by follower, whatever its share of the corpus; the parts of a restaurant tell
each other their customers and tables between rounds. Buckets of contexts then add up the sequences of all
chunks, keep them with their tables in files of the shared folder, and at last answer each chunk. Nothing that
grows with the corpus passes the driver or is broadcast; no sequence is dropped.

A document is learned from unless crc32(doc_id as text) % 7 == 2 (a null id counts as ''). Words
are lower-cased (A-Z); an end token follows. A null text is empty: one token. Repeated rows are
scored each. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import hash_words, mix64, remove, scratch_path, store, words

CHUNK, BUCKET, EXACT, SWEEPS, BURN = 1 << 21, 1 << 21, 1024, 6, 2
ROUNDS, INNER, KEPT, BATCHES = 3, 2, 4, 4
DISCOUNT, STRENGTH, TOP_DISCOUNT, TOP_STRENGTH = 0.8, 1.0, 0.7, 10.0
#: Strings with a space can't be words.
BEGIN, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"begin of text", b"end of text"))


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _ints(x: np.ndarray, rising: bool = False) -> tuple:
    """Integers from 0 on in the fewest bytes each; rising ones by their steps."""
    x = np.diff(x, prepend=x.dtype.type(0)) if rising else x
    kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype(np.uint8)
    return rising, kind.char, _pack(x.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T)  # high bytes together


def _numbers(packed: tuple) -> np.ndarray:
    rising, kind, raw = packed
    x = np.ascontiguousarray(_unpack(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel().astype(np.int64)
    return np.cumsum(x) if rising else x


def _distinct(columns: list[np.ndarray], sizes: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of integer columns, each below its size, in order; and the row of each input row."""
    key, room, steps = columns[0].astype(np.uint64), sizes[0], []
    for x, size in zip(columns[1:], sizes[1:], strict=True):
        if room * size >= 1 << 64:
            ids, key = np.unique(key, return_inverse=True)
            key, room = key.astype(np.uint64), len(ids)
            steps.append(("ids", ids))
        key, room = key * np.uint64(size) + x.astype(np.uint64), room * size
        steps.append(("size", np.uint64(size)))
    key, inv = np.unique(key, return_inverse=True)
    out = []
    for what, x in reversed(steps):
        if what == "size":
            out.append((key % x).astype(np.int64))
            key = key // x
        else:
            key = x[key.astype(np.int64)]
    return [key.astype(np.int64), *reversed(out)], inv.ravel()


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


class Chunk:
    """Pieces of documents as one array of word numbers; every piece begins with its context of ``span`` words."""

    def __init__(self, pieces: list[tuple], hashes: list[np.ndarray], span: int):
        flat = np.concatenate(hashes)
        self.words, seq = np.unique(flat, return_inverse=True)
        self.seq = seq.astype(np.uint32)
        self.pieces = pieces  # (row, doc_id, held out, elements)
        self.span = span

    def save(self) -> bytes:
        return pickle.dumps((self.pieces, self.span, _ints(self.seq), self.words.tobytes()))

    @classmethod
    def load(cls, raw: bytes) -> Chunk:
        c = cls.__new__(cls)
        c.pieces, c.span, seq, ws = pickle.loads(raw)
        c.seq, c.words = _numbers(seq), np.frombuffer(ws, np.uint64)
        return c

    def count(self) -> Chunk:
        """Tokens to learn from and all occurrences, as token or context, of each word."""
        sizes = np.array([p[3] for p in self.pieces])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.token = np.ones(len(self.seq), bool)
        for i in range(self.span):
            self.token[starts + i] = False
        self.train = np.repeat(np.array([not p[2] for p in self.pieces]), sizes) & self.token
        self.counts = np.bincount(self.seq[self.train], minlength=len(self.words))
        self.seen = np.bincount(self.seq, minlength=len(self.words))
        return self

    def derive(self, numbers: np.ndarray) -> Chunk:
        """The distinct sequences of ``span`` context words, nearest first, and the word they precede, by the
        corpus's numbers of the words and in their order; how often each is learned from."""
        train = self.count().train
        at = np.flatnonzero(self.token)
        order = np.argsort(numbers)
        self.numbers, local = numbers[order], np.empty(len(order), np.int64)
        local[order] = np.arange(len(order))
        seq = local[self.seq]
        self.grams, self.gram_of = _distinct([seq[at - i] for i in (*range(1, self.span + 1), 0)], [len(order)] * (self.span + 1))
        self.gram_counts = np.bincount(self.gram_of[train[at]], minlength=len(self.grams[0]))
        self.order = order
        return self


def _bytes(name: str) -> bytes:
    fs, path = pafs.FileSystem.from_uri(name)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def _read(name: str) -> Chunk:
    return Chunk.load(_bytes(name))


def _write(folder: str, name: str, raw: bytes) -> str:
    """A file that appears whole; a second attempt writes the same."""
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    temp = f"{base}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(temp, compression=None) as f:
        f.write(raw)
    fs.move(temp, f"{base}/{name}")
    return f"{folder}/{name}"


def _chunks(folder: str, size: int, span: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        pieces: list[tuple] = []
        parts: list[np.ndarray] = []
        n = number = row = 0

        def flush() -> pa.RecordBatch:
            nonlocal pieces, parts, n, number
            name = _write(folder, f"chunk-{task:06d}-{number:06d}", Chunk(pieces, parts, span).save())
            out = {"chunk": pa.array([(task << 24) + number], pa.int64()), "file": pa.array([name]), "tokens": pa.array([n], pa.int64())}
            pieces, parts, n, number = [], [], 0, number + 1
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = np.concatenate([[BEGIN] * span, hash_words(words(text.as_py(), lower=True)), [END]]).astype(np.uint64)
                row_id, held, at = (task << 40) + row, held_out(doc_id), 0
                row += 1
                while at < len(h) - span:  # a piece repeats the last words before it as its context
                    part = h[at : at + span + max(1, size - n)]
                    pieces.append((row_id, doc_id, held, len(part)))
                    parts.append(part)
                    n, at = n + len(part) - span, at + len(part) - span
                    if n >= size:
                        yield flush()
        if pieces:
            yield flush()

    return work


def _cuts(number: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) of the buckets that occur, each once."""
    if not len(number):
        return
    order = np.argsort(number, kind="stable")
    new = np.flatnonzero(np.append(True, number[order][1:] != number[order][:-1]))
    for a, b in zip(new, [*new[1:], len(order)], strict=True):
        yield int(number[order[a]]), order[a:b]


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


_ASK = "bucket bigint, chunk bigint, file string, data binary"


def _message(bucket: int, chunk: int, file: str, data: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "chunk": pa.array([chunk], pa.int64()), "file": pa.array([file]), "data": pa.array([pickle.dumps(data)], pa.binary())})


# Exchange 1: words


def _send_words(bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, file in zip(batch.column("chunk").to_pylist(), batch.column("file").to_pylist(), strict=True):
                c = _read(file).count()
                for bucket, x in _cuts(_bucket(c.words, bits)):
                    yield _message(bucket, chunk, file, (c.words[x].tobytes(), _pack(c.counts[x].astype(np.uint32)), _pack(c.seen[x].astype(np.uint32))))

    return work


def _totals(bits: int):
    """Per word of each chunk: tokens to learn from and occurrences in the whole corpus, and its number, whose
    low bits are the bucket's."""

    def finish(bucket: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        sent = [pickle.loads(r["data"]) for r in rows]
        ws = [np.frombuffer(s[0], np.uint64) for s in sent]
        known, inv = np.unique(np.concatenate(ws), return_inverse=True)
        count, seen = (np.bincount(inv, weights=np.concatenate([_unpack(s[i], np.uint32) for s in sent]), minlength=len(known)).astype(np.int64) for i in (1, 2))
        at = [np.searchsorted(known, w) for w in ws]
        yield _answer(rows, 0, [pickle.dumps((_ints(count[i]), _ints(seen[i]), _ints(i << bits | bucket, rising=True))) for i in at], int((count > 0).sum()), float(count.sum()))

    return _by("bucket", finish)


def _words_of(c: Chunk, rows: list[dict], bits: int) -> list[np.ndarray]:
    """The answers of the buckets of words, as arrays over a chunk's words."""
    data, out = {r["bucket"]: r["data"] for r in rows}, [np.zeros(len(c.words), np.int64) for _ in range(3)]
    for bucket, x in _cuts(_bucket(c.words, bits)):
        for o, packed in zip(out, pickle.loads(data[bucket]), strict=True):
            o[x] = _numbers(packed)
    return out


# Exchange 2: sequences by their last context word


def _shares(c: Chunk, seen: np.ndarray, limit: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, gram numbers, parts of their last context word) of the buckets that a chunk has grams for.
    A context's followers are dealt over the parts, and parts over the buckets."""
    parts = np.maximum(1, -(-seen // limit)).astype(np.uint64)[c.order][c.grams[0]]
    part = mix64(c.numbers.astype(np.uint64)[c.grams[-1]] ^ np.uint64(0x5851F42D4C957F2D)) % parts
    for bucket, x in _cuts(_bucket(mix64(mix64(c.numbers.astype(np.uint64)[c.grams[0]]) + part * np.uint64(0x9E3779B97F4A7C15)), bits)):
        yield bucket, x, parts[x]


def _send_grams(bits: int, wbits: int, limit: int):
    def finish(chunk: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        c = _read(rows[0]["file"])
        _, seen, numbers = _words_of(c, rows, wbits)
        c.derive(numbers)
        for bucket, x, parts in _shares(c, seen, limit, bits):
            columns = [g[x] for g in c.grams]
            ids, local = np.unique(np.concatenate(columns), return_inverse=True)
            first, *others = local.reshape(len(columns), len(x))
            split = np.unique(first[parts > 1])
            data = (_ints(c.numbers[ids], rising=True), [_ints(first, rising=True), *map(_ints, others)], _ints(c.gram_counts[x]), _ints(split))
            yield _message(bucket, chunk, rows[0]["file"], data)

    return _by("chunk", finish)


_STIRLING: dict[float, np.ndarray] = {}


def stirling(d: float) -> np.ndarray:
    """log S(c, t): seatings of c customers at t tables of one dish, weighted by discount d."""
    if d not in _STIRLING:
        s = np.full((EXACT + 1, EXACT + 1), -np.inf)
        s[1, 1] = 0
        for c in range(1, EXACT):
            t = np.arange(1, c + 2)
            stay = np.log(np.maximum(c - d * t, 1e-300)) + s[c, t]
            s[c + 1, t] = np.logaddexp(s[c, t - 1], np.where(t <= c, stay, -np.inf))
        _STIRLING[d] = s
    return _STIRLING[d]


def _limit(d: float) -> np.ndarray:
    """d t S(n, t + 1) / S(n, t) of n = EXACT, from t = 0 on: beyond, it depends on t / n ** d only."""
    last = stirling(d)[EXACT]
    return np.append(1.0, d * np.arange(1, EXACT) * np.exp(last[2:] - last[1:-1]))


def _grown(n: int, d: float) -> np.ndarray:
    """log S(n, t), t = 1, 2, ..., less log S(n, 1), for n > EXACT by the scaling limit."""
    shrink = (EXACT / n) ** d
    t = np.arange(1, max(2, int((EXACT - 1) / shrink)))
    return np.append(0.0, np.cumsum(np.log(np.interp(t * shrink, np.arange(EXACT), _limit(d))) - np.log(d * t)))


class Parent:
    """The dishes' own places in the parent restaurant, without their tables: its customers and tables of the
    dish, those of the restaurant, and the probability of the dish in the parent's parent."""

    def __init__(self, c: np.ndarray, t: np.ndarray, guests: np.ndarray, tables: np.ndarray, base: np.ndarray, d: float, theta: float):
        self.c, self.t, self.guests, self.d, self.theta = c, t, guests, d, theta
        self.rest = (theta + d * tables) * base

    def at(self, rows: np.ndarray, most: int) -> np.ndarray:
        """log weight of 1, ..., most tables as customers here."""
        k, c, d = np.arange(most), self.c[rows, None], self.d
        t = np.minimum(self.t[rows, None], c)
        weight = np.log(np.maximum(c + k - d * t, 0) + self.rest[rows, None])
        small = np.flatnonzero(c[:, 0] + most <= EXACT)
        if len(small):
            n = c[small] + k + 1
            need = np.minimum(self.t[rows[small], None], n[:, -1:])
            # summed up below; too few customers for the parent's tables have next to no weight
            weight[small] = np.diff(np.maximum(stirling(d)[n, need], -1e6), axis=1, prepend=0)
        return np.cumsum(weight - np.log(self.theta + self.guests[rows, None] + k), axis=1)


def _draw(weight: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    up = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), axis=1)
    return 1 + np.minimum((up < rng.random(len(weight))[:, None] * up[:, -1:]).sum(1), weight.shape[1] - 1)


def seat(c: np.ndarray, base: np.ndarray | Parent, others: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish with c >= 1 customers, given the tables of the other dishes in its restaurant and
    its base: a probability that stays, or the place in the parent restaurant."""
    t = np.ones(len(c), np.int64)
    table = stirling(d)
    up = base.at if isinstance(base, Parent) else lambda rows, most: np.arange(1, most + 1) * np.log(base[rows, None])
    busy = np.flatnonzero((c > 1) & (c <= EXACT))
    # dishes of about as many customers together; too many tables have no weight
    size = np.where(c[busy] <= 8, c[busy], np.ceil(2.0 ** (np.ceil(2 * np.log2(c[busy])) / 2))).astype(np.int64)
    for n, x in _cuts(np.minimum(size, EXACT)):
        for a in range(0, len(x), max(1, (1 << 18) // n)):
            rows = busy[x[a : a + max(1, (1 << 18) // n)]]
            most = int(c[rows].max())
            weight = table[c[rows], 1 : most + 1] + np.cumsum(np.log(theta + d * (others[rows, None] + np.arange(most))), axis=1) + up(rows, most)
            t[rows] = _draw(weight, rng)
    for i in np.flatnonzero(c > EXACT):
        s, row = _grown(int(c[i]), d), np.array([i])
        weight = s + np.cumsum(np.log(theta + d * (others[i] + np.arange(len(s))))) + up(row, len(s))[0]
        t[i] = _draw(weight[None], rng)[0]
    return t


def gibbs(room: np.ndarray, c: np.ndarray, base: np.ndarray, rooms: int, parts: np.ndarray, d: float, theta: float, seed: int, sweeps: int = SWEEPS, burn: int = BURN) -> np.ndarray:
    """Tables per dish of restaurants whose base stays, averaged over the kept sweeps. parts: how many equal
    parts each restaurant was split into; a part stands for the others."""
    rng = np.random.default_rng(seed)
    t, mean, total = np.ones(len(c), np.int64), np.zeros(len(c)), np.bincount(room, minlength=rooms).astype(float)
    busy = np.flatnonzero(c > 1)
    for sweep in range(sweeps):
        for x in _batches(busy, rng):
            t[x] = seat(c[x], base[x], parts[room[x]] * total[room[x]] - t[x], d, theta, rng)
            total = np.bincount(room, weights=t, minlength=rooms)
        if sweep >= burn:
            mean += t
    return mean / (sweeps - burn)


def _batches(busy: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    part = rng.integers(0, BATCHES, len(busy))
    return [busy[part == i] for i in range(BATCHES)]


class Level:
    """The restaurants of one context length in a bucket. Dishes: restaurant, customers, tables and the same
    word's dish one level up; restaurants: customers and tables here, and in other buckets."""

    def __init__(self, room: np.ndarray, rooms: int, up: np.ndarray, split: np.ndarray, keys: np.ndarray):
        self.room, self.rooms, self.up, self.split, self.keys = room, rooms, up, split, keys
        self.far = np.zeros((2, rooms), np.int64)

    def save(self) -> tuple:
        return _ints(self.room, rising=True), self.rooms, _ints(self.up), _ints(self.split), self.keys.tobytes()

    @classmethod
    def load(cls, raw: tuple) -> Level:
        return cls(_numbers(raw[0]), raw[1], _numbers(raw[2]), _numbers(raw[3]), np.frombuffer(raw[4], np.uint64))

    def fill(self, c: np.ndarray, t: np.ndarray) -> None:
        self.c, self.t = c, t
        self.total()

    def total(self) -> None:
        self.guests, self.tables = (np.bincount(self.room, weights=x, minlength=self.rooms).astype(np.int64) + f for x, f in zip((self.c, self.t), self.far, strict=True))

    def probabilities(self, above: np.ndarray, d: float, theta: float) -> np.ndarray:
        return (np.maximum(self.c - d * self.t, 0) + (theta + d * self.tables[self.room]) * above[self.up]) / (theta + self.guests[self.room])


class Restaurants:
    """All restaurants whose contexts end with a bucket's words; levels from one context word to the longest."""

    def __init__(self, sent: list[tuple]):
        dicts = [_numbers(s[0]) for s in sent]
        self.known = np.unique(np.concatenate(dicts))
        at = [np.searchsorted(self.known, x) for x in dicts]
        columns = [np.concatenate([a[_numbers(s[1][i])] for a, s in zip(at, sent, strict=True)]) for i in range(len(sent[0][1]))]
        hot = np.zeros(len(self.known), bool)
        for a, s in zip(at, sent, strict=True):
            hot[a[_numbers(s[3])]] = True
        sizes = [len(self.known)] * len(columns)
        grams, inv = _distinct(columns, sizes)
        self.counts = np.bincount(inv, weights=np.concatenate([_numbers(s[2]) for s in sent]), minlength=len(grams[0])).astype(np.int64)
        cut = np.cumsum([0, *(len(_numbers(s[2])) for s in sent)])
        self.asked = [inv[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        self.levels = []
        while len(grams) > 1:  # from the longest contexts up
            context, room = _distinct(grams[:-1], sizes[: len(grams) - 1])
            above, up = _distinct([*grams[:-2], grams[-1]], sizes[: len(grams) - 1]) if len(grams) > 2 else ([], grams[-1])
            split = np.flatnonzero(hot[context[0]])
            keys = np.full(len(split), len(grams), np.uint64)
            for x in context:
                keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + self.known.astype(np.uint64)[x[split]])
            self.levels.insert(0, Level(room, len(context[0]), up, split, keys))
            grams = above
        self.fill([])

    def save(self) -> bytes:
        return pickle.dumps((_ints(self.known, rising=True), _ints(self.counts), [_ints(x, rising=True) for x in self.asked], [x.save() for x in self.levels]))

    @classmethod
    def load(cls, raw: bytes, tables: bytes | None) -> Restaurants:
        r = cls.__new__(cls)
        known, counts, asked, levels = pickle.loads(raw)
        r.known, r.counts, r.levels = _numbers(known), _numbers(counts), [Level.load(x) for x in levels]
        r.asked = asked
        r.fill([] if tables is None else [_numbers(x) for x in pickle.loads(tables)])
        return r

    def save_tables(self) -> bytes:
        return pickle.dumps([_ints(x.t[x.c > 1]) for x in self.levels])

    def fill(self, tables: list[np.ndarray]) -> None:
        """Tables of the dishes of more than one customer; at first, one each."""
        c = self.counts
        for i in range(len(self.levels) - 1, -1, -1):
            level, t = self.levels[i], np.minimum(c, 1)
            if tables:
                t[c > 1] = tables[i]
            level.fill(c, t)
            c = np.bincount(level.up, weights=t, minlength=len(self.levels[i - 1].room) if i else len(self.known)).astype(np.int64)
        self.own = c

    def take(self, answer: tuple, sums: tuple) -> None:
        """What came back from the restaurant of all words and from the other parts of split ones."""
        self.top_c, self.top_t, far = answer
        self.top_sums, self.was = sums, self.own.copy()
        at = 0
        for level in self.levels:
            level.far[:, level.split] = far[:, at : at + len(level.split)]
            level.total()
            at += len(level.split)

    def top(self, p: list[tuple], vocabulary: int) -> np.ndarray:
        (d, theta), (guests, tables) = p[0], self.top_sums
        return (np.maximum(self.top_c - d * self.top_t, 0) + (theta + d * tables) / (vocabulary + 1)) / (theta + guests)

    def probabilities(self, p: list[tuple], vocabulary: int, levels: int) -> np.ndarray:
        """Of the dishes after so many context words; of the words without."""
        out = self.top(p, vocabulary)
        for level, (d, theta) in zip(self.levels[:levels], p[1:], strict=False):
            out = level.probabilities(out, d, theta)
        return out

    def _place(self, i: int, up: np.ndarray, t: np.ndarray, base: np.ndarray, p: list[tuple], vocabulary: int) -> Parent:
        if i:
            level = self.levels[i - 1]
            room = level.room[up]
            return Parent(level.c[up] - t, level.t[up], level.guests[room] - t, level.tables[room], base[level.up[up]], *p[i])
        c = self.top_c[up] + self.own[up] - self.was[up]
        guests = np.full(len(up), self.top_sums[0] + int(self.own.sum() - self.was.sum()))
        return Parent(np.maximum(c - t, 0), np.minimum(self.top_t[up], c), guests - t, np.full(len(up), self.top_sums[1]), np.full(len(up), 1 / (vocabulary + 1)), *p[0])

    def sweep(self, p: list[tuple], vocabulary: int, rng: np.random.Generator) -> None:
        for i in range(len(self.levels) - 1, -1, -1):
            level, (d, theta) = self.levels[i], p[i + 1]
            for x in _batches(np.flatnonzero(level.c > 1), rng):
                if not len(x):
                    continue
                base = self.probabilities(p, vocabulary, i - 1) if i else None
                old, up = level.t[x], level.up[x]
                t = seat(level.c[x], self._place(i, up, old, base, p, vocabulary), level.tables[level.room[x]] - old, d, theta, rng)
                self._move(i, x, t)

    def _move(self, i: int, x: np.ndarray, t: np.ndarray) -> None:
        """Gives dishes of a level other numbers of tables. Customers above follow, and tables there that
        their customers left."""
        while len(x):
            level = self.levels[i]
            change, up = t - level.t[x], level.up[x]
            level.t[x] = t
            np.add.at(level.tables, level.room[x], change)
            if not i:
                np.add.at(self.own, up, change)
                return
            i, above = i - 1, self.levels[i - 1]
            np.add.at(above.c, up, change)
            np.add.at(above.guests, above.room[up], change)
            x = np.unique(up[above.t[up] > above.c[up]])
            t = above.c[x]


def _by(key: str, finish) -> object:
    """Rows sorted by key to finish(key, rows), one key at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if rows and r[key] != now:
                    yield from finish(now, rows)
                    rows = []
                now = r[key]
                rows.append(r)
        if rows:
            yield from finish(now, rows)

    return work


_ANSWER = "chunk bigint, file string, kind int, bucket bigint, data binary, v bigint, n double"


def _answer(rows: list[dict], kind: int, data: list[bytes], v: int, n: float) -> pa.RecordBatch:
    k = len(rows)
    return pa.RecordBatch.from_pydict({"chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "file": pa.array([r["file"] for r in rows], pa.string()), "kind": pa.array([kind] * k, pa.int32()), "bucket": pa.array([r["bucket"] for r in rows], pa.int64()), "data": pa.array(data, pa.binary()), "v": pa.array([v] + [0] * (k - 1), pa.int64()), "n": pa.array([float(n)] + [0.0] * (k - 1), pa.float64())})


# Exchange 3, once a round: tables by word, and restaurants that are split


def _report(bucket: int, r: Restaurants, wbits: int) -> Iterator[pa.RecordBatch]:
    mask = (1 << wbits) - 1
    split = [np.concatenate(x) for x in zip(*((v.keys, v.tables[v.split] - v.far[1, v.split], v.guests[v.split] - v.far[0, v.split]) for v in r.levels), strict=True)]
    at, rooms = dict(_cuts(r.known & mask)), dict(_cuts((split[0] & np.uint64(mask)).astype(np.int64)))
    for to in sorted({*at, *rooms}):
        x, y = at.get(to, np.zeros(0, np.int64)), rooms.get(to, np.zeros(0, np.int64))
        yield _message(to, bucket, "", (_ints(r.known[x] >> wbits, rising=True), _ints(r.own[x]), split[0][y].tobytes(), _ints(split[1][y]), _ints(split[2][y])))


def _open(folder: str, wbits: int):
    """Adds up the sequences of a bucket and keeps them, every dish at one table."""

    def finish(bucket: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        r = Restaurants([pickle.loads(x["data"]) for x in rows])
        _write(folder, f"bucket-{bucket}", pickle.dumps(([(x["chunk"], x["file"]) for x in rows], r.save())))
        yield from _report(bucket, r, wbits)

    return _by("bucket", finish)


def _top(wbits: int, vocabulary: int, d: float, theta: float, number: int):
    """Seats a bucket's words in the restaurant of all words and adds up split restaurants."""

    def finish(bucket: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        sent = [pickle.loads(r["data"]) for r in rows]
        at, own = [_numbers(s[0]) for s in sent], [_numbers(s[1]) for s in sent]
        c = np.bincount(np.concatenate(at), weights=np.concatenate(own)).astype(np.int64) if any(map(len, at)) else np.zeros(0, np.int64)
        live, t = np.flatnonzero(c), np.zeros(len(c), np.int64)
        # a bucket of words stands for the others
        t[live] = gibbs(np.zeros(len(live), np.int64), c[live], np.full(len(live), 1 / (vocabulary + 1)), 1, np.array([float(1 << wbits)]), d, theta, number << 32 | bucket, INNER, INNER - 1)
        keys = [np.frombuffer(s[2], np.uint64) for s in sent]
        known, inv = np.unique(np.concatenate(keys), return_inverse=True)
        mine = [np.concatenate([_numbers(s[i]) for s in sent]) for i in (4, 3)]
        far = [np.bincount(inv, weights=x, minlength=len(known)).astype(np.int64)[inv] - x for x in mine]
        cut = np.cumsum([0, *map(len, keys)])
        yield _answer(rows, 3, [pickle.dumps((_ints(c[x]), _ints(t[x]), *(_ints(f[a:b]) for f in far))) for x, a, b in zip(at, cut, cut[1:], strict=False)], int(c.sum()), float(t.sum()))

    return _by("bucket", finish)


def _load(folder: str, bucket: int, rows: list[dict], wbits: int, number: int, sums: tuple) -> tuple[list, Restaurants]:
    """A bucket's restaurants with the tables of the round before and the answers to it."""
    asked, raw = pickle.loads(_bytes(f"{folder}/bucket-{bucket}"))
    r = Restaurants.load(raw, _bytes(f"{folder}/tables-{bucket}-{number - 1}") if number > 1 else None)
    top, keys = np.zeros((2, len(r.known)), np.int64), np.concatenate([x.keys for x in r.levels])
    far, mask = np.zeros((2, len(keys)), np.int64), (1 << wbits) - 1
    at, rooms = dict(_cuts(r.known & mask)), dict(_cuts((keys & np.uint64(mask)).astype(np.int64)))
    for row in rows:
        data = [_numbers(x) for x in pickle.loads(row["data"])]
        for out, x, got in ((top, at, data[:2]), (far, rooms, data[2:])):
            if row["bucket"] in x:
                out[:, x[row["bucket"]]] = got
    r.take((top[0], top[1], far), sums)
    return asked, r


def _round(folder: str, wbits: int, vocabulary: int, sums: tuple, p: list[tuple], number: int):
    def finish(bucket: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        _, r = _load(folder, bucket, rows, wbits, number, sums)
        rng = np.random.default_rng([bucket, number])
        for _ in range(INNER):
            r.sweep(p, vocabulary, rng)
        _write(folder, f"tables-{bucket}-{number}", r.save_tables())
        yield from _report(bucket, r, wbits)

    return _by("chunk", finish)  # the asker of an answer is a bucket of contexts


def _probabilities(folder: str, wbits: int, vocabulary: int, sums: tuple, p: list[tuple], number: int):
    """Answers the chunks: the probability of each of their sequences, averaged over the kept sweeps."""

    def finish(bucket: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        asked, r = _load(folder, bucket, rows, wbits, number, sums)
        rng, mean = np.random.default_rng([bucket, number]), 0.0
        for _ in range(KEPT):
            r.sweep(p, vocabulary, rng)
            mean = mean + r.probabilities(p, vocabulary, len(r.levels))
        logp = np.log10(mean / KEPT).astype(np.float32)
        for (chunk, file), x in zip(asked, r.asked, strict=True):
            yield _answer([{"chunk": chunk, "file": file, "bucket": bucket}], 2, [_pack(logp[_numbers(x)])], 0, 0.0)

    return _by("chunk", finish)


_SCORES = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _score(bits: int, wbits: int, limit: int, total: float, vocabulary: int):
    def finish(chunk: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        c = _read(rows[0]["file"])
        count, seen, numbers = _words_of(c, [r for r in rows if r["kind"] == 1], wbits)
        c.derive(numbers)
        answers, gram = {r["bucket"]: r["data"] for r in rows if r["kind"] == 2}, np.zeros(len(c.grams[0]))
        for bucket, x, _ in _shares(c, seen, limit, bits):
            gram[x] = _unpack(answers[bucket], np.float32)
        logp = gram[c.gram_of]
        words_at = c.seq[c.token]
        base = np.log10((count[words_at] + 1) / (total + vocabulary + 1))
        known = count[words_at] > 0
        size = np.array([x[3] - c.span for x in c.pieces])
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        add = lambda x: np.add.reduceat(x, begin)
        yield pa.RecordBatch.from_pydict({
            "row": pa.array([x[0] for x in c.pieces], pa.int64()), "doc_id": pa.array([x[1] for x in c.pieces], pa.int64()), "held_out": pa.array([x[2] for x in c.pieces]),
            "n_tokens": pa.array(size, pa.int64()), "n_known": pa.array(add(known.astype(np.int64)), pa.int64()), "base_score": pa.array(add(base)), "score": pa.array(add(logp)),
        })

    return _by("chunk", finish)


def score(docs: DataFrame, chunk: int = CHUNK, bucket: int = BUCKET, discount: float = DISCOUNT, strength: float = STRENGTH, top_discount: float = TOP_DISCOUNT, top_strength: float = TOP_STRENGTH, order: int = 2) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one
    unigram) and score (log10 probability under the model of sequences of ``order`` words, 2 at
    least). The perplexity of a text is 10 ** (-score / n_tokens)."""
    if order < 2:
        raise ValueError("order must be at least 2")
    spark = docs.sparkSession
    folder = scratch_path(spark, "chunks")
    folder = folder if "://" in folder else "file:///" + folder.removeprefix("file:").lstrip("/")
    chunks = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_chunks(folder, chunk, order - 1), "chunk bigint, file string, tokens bigint")
    chunks = store(chunks, "chunk_list")
    tokens, number = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    bits = max(0, int(np.ceil(np.log2(max(1, 2 * tokens / bucket)))))
    wbits, limit = max(0, bits - 2), max(1, bucket // 2)  # words are fewer than sequences

    def each(df: DataFrame, key: str) -> DataFrame:
        return df.repartition(key).sortWithinPartitions(key, *(["bucket"] if key == "chunk" else ["chunk"]))

    def sums(df: DataFrame) -> tuple:
        return df.agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()

    listed = chunks.select("chunk", "file").repartition(max(1, min(number, 20_000)), "chunk")  # short rows, long work
    totals = store(each(listed.mapInArrow(_send_words(wbits), _ASK), "bucket").mapInArrow(_totals(wbits), _ANSWER), "totals")
    vocabulary, total = (int(x) for x in sums(totals))
    totals = totals.withColumn("kind", F.lit(1))
    asks = each(each(totals, "chunk").mapInArrow(_send_grams(bits, wbits, limit), _ASK), "bucket").mapInArrow(_open(folder, wbits), _ASK)
    path = scratch_path(spark, "restaurants")
    p = [(top_discount, top_strength)] + [(discount, strength)] * (order - 1)
    for i in range(1, ROUNDS + 2):
        answers = store(each(asks, "bucket").mapInArrow(_top(wbits, vocabulary, *p[0], i), _ANSWER), "restaurants", f"{path}/{i}")
        if i > 1:
            remove(spark, f"{path}/{i - 1}")
        guests, tables = (int(x) for x in sums(answers))
        asks = each(answers, "chunk").mapInArrow((_round if i <= ROUNDS else _probabilities)(folder, wbits, vocabulary, (guests, tables), p, i), _ASK if i <= ROUNDS else _ANSWER)
    scored = each(asks.union(totals), "chunk").mapInArrow(_score(bits, wbits, limit, float(total), vocabulary), _SCORES)
    out = scored.groupBy("row", "doc_id", "held_out").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")
