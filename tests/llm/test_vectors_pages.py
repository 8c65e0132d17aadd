import hashlib
import io
import math
import struct
from collections import Counter

import numpy as np
import pyarrow.fs as pafs
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from keyloom.llm import ann, mixing, topk, urlfilter, warc
from keyloom.llm.common import store
from llm_help import SF, brute_components, spec_words, uneven_copies

VEC = "vec_id bigint, embedding array<float>, rank int"


@pytest.fixture(scope="session")
def odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)], i) for i in range(300)]
    rows += [(i, rows[0][1], None) for i in range(300, 420)]  # a very common vector
    rows += [(500, None, 1), (520, [], 1), (540, [1.0, None] + [0.0] * 6, 1), (560, [float("nan")] * 8, 1), (580, [float("inf")] * 8, 1), (600, [0.0] * 8, 1), (None, [1.0] * 8, 1), (640, [1.0, 2.0], 1), (660, [2.0, 1.0], 1), (20, rows[20][1], 1)]
    return spark.createDataFrame(rows, VEC).repartition(3)


def live(df):
    return [(r.vec_id, np.array(r.embedding, float)) for r in df.collect() if r.vec_id is not None and r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding)]


def test_top_k(spark, odd_vectors):
    rows = [(i, np.floor(64 * v)) for i, v in live(odd_vectors)]
    got = {}
    for r in topk.exact_top_k(odd_vectors, k=20, every=20, shard_size=64, block_size=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    for q in {i for i, _ in rows if i % 20 == 0}:
        want = []
        for v in [v for i, v in rows if i == q]:
            want += [(-int(v @ w), i) for i, w in rows if i != q and len(w) == len(v)]
        if q != 20:  # 20 is there twice, and asks twice
            assert [(s, i) for _, s, i in sorted(got.get(q, []))] == [(-s, i) for s, i in sorted(want)[:20]]
    assert topk.exact_top_k(odd_vectors.limit(0)).count() == 0


def test_wide_numbers():
    rng = np.random.default_rng(0)
    v = np.array([[int(x) for x in row] for row in rng.integers(-(1 << 40), 1 << 40, (300, 4))], object)
    t = topk.Tree(np.arange(300), v)
    r, ids, score = t.top(np.array([0]), v[:1], 5, np.full(1, -(1 << 100), object))
    want = sorted(((-int((v[0] * v[i]).sum()), i) for i in range(1, 300)))[:5]
    assert sorted(zip((-s for s in score), ids, strict=True)) == want


def test_trees_of_many_rows():
    """More rows than 2 ** 14 in one shard, as of one repeated id: positions are decoded right."""
    v = np.random.default_rng(0).integers(-50, 50, (20_000, 4)).astype(float)
    v[-1] = 2 * v[0]
    for scale in (1, 3_000_000):
        t = topk.Tree(np.arange(len(v)), v * scale)
        r, ids, score = t.top(np.array([-1]), v[:1] * scale, 5, np.full(1, -(1 << 61), np.int64))
        want = sorted(((-int(x), i) for i, x in enumerate((v * scale) @ (v[0] * scale))))[:5]
        assert sorted((-int(x) for x in score)) == [x for x, _ in want]
        assert all(int((v[i] * scale) @ (v[0] * scale)) == int(x) for i, x in zip(ids, score, strict=True))


def test_nearest(spark, odd_vectors):
    rows = [(i, v) for i, v in live(odd_vectors) if np.abs(v).max() > 0]
    got = {}
    for r in ann.nearest(odd_vectors, k=5, every=50, shard_size=128, block_size=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    hit = total = 0
    for q, v in rows:
        if q % 50 == 0:
            want = sorted((-float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), i) for i, w in rows if i != q and len(w) == len(v))[:5]
            found = [(s, i) for _, s, i in sorted(got.get(q, []))]
            assert found == sorted(found, key=lambda x: (-x[0], x[1])) and len(found) == len(want)
            hit += sum(s >= -want[-1][0] - 1e-12 for s, _ in found)
            total += len(want)
    assert hit / total >= 0.9
    assert ann.nearest(odd_vectors.limit(0)).count() == 0


def test_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = live(e)
    ids, u = np.array([i for i, _ in rows]), np.array([v / np.linalg.norm(v) for _, v in rows])
    got = {}
    for r in ann.nearest(e).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = sum(len(got[q] & set(ids[np.argsort(-np.where(ids == q, -2, u @ u[ids == q][0]))[:5]])) for q in ids[ids % 50 == 0])
    assert hit / (5 * (ids % 50 == 0).sum()) >= 0.95


@pytest.mark.parametrize("spread", [0.05, 0.3, 1.0, None])
def test_graphs_of_clusters(spread):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(3000, 24))
    if spread is not None:
        v = (rng.normal(size=(30, 24)) * 4)[rng.integers(0, 30, 3000)] + v * spread
    g = ann.Graph(np.arange(3000), np.concatenate([v[:2990], v[:10]]))
    assert len(g.unit) == 2990  # copies are one node
    for layer in g.layers:  # no list names a node twice, or its own
        for i, x in enumerate(layer):
            x = x[x >= 0]
            assert len(set(x)) == len(x) and i not in x
    q = g.unit[::7]
    found, near = g.find(q, ann.BEAM)
    exact = -np.sort(-(q @ g.unit.T), axis=1)[:, :6]
    assert (near[:, :6] >= exact - 1e-9).mean() >= 0.95
    assert np.allclose(near, np.where(found >= 0, np.einsum("qkd,qd->qk", g.unit[found], q), -2))


def test_a_node_is_searched_once_a_level(monkeypatch):
    compared, beam = [], ann.Graph._beam

    def counted(self, layer, q, here, sim, width):
        out = beam(self, layer, q, here, sim, width)
        compared.append(len(q))
        return out

    monkeypatch.setattr(ann.Graph, "_beam", counted)
    g = ann.Graph(np.arange(2000), np.random.default_rng(3).normal(size=(2000, 8)))
    levels = sum(int((layer >= 0).any(1).sum()) for layer in g.layers)
    assert 1900 <= sum(compared) <= levels  # one search a node and level


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_small_graphs(n):
    g = ann.Graph(np.arange(n), np.eye(4)[:n])
    assert len(g.unit) == n
    if n:
        found, _ = g.find(np.eye(4)[:n], 8)
        assert [sorted(x[x >= 0]) for x in found] == [list(range(n))] * n


# URL filters


def test_list_as_of_fetch(spark):
    events = spark.sql("SELECT * FROM VALUES ('d:x.com', DATE'2024-01-05', true), ('d:x.com', DATE'2024-01-10', false), ('d:x.com', DATE'2024-02-01', true), ('d:x.com', DATE'2024-02-01', false), ('h:a.y.org', DATE'2024-01-01', true), ('p:z.net/bad/', DATE'2024-01-01', true), ('p:z.net/bad/deep/', DATE'2024-01-01', true), (null, DATE'2024-01-01', true), ('d:w', null, true) AS t(pattern, day, added)")
    cases = [
        ("http://x.com/", "2024-01-04", 0), ("http://X.com./", "2024-01-05", 1), ("https://u:p@sub.x.com:80/a", "2024-01-09", 1), ("http://x.com/", "2024-01-10", 0), ("http://notx.com/", "2024-01-06", 0), ("http://x.com/", "2024-02-01", 0),
        ("http://a.y.org/", "2024-03-01", 1), ("http://b.a.y.org/", "2024-03-01", 0), ("http://z.net/bad/x", "2024-03-01", 1), ("http://z.net/bad/deep/x", "2024-03-01", 2), ("http://z.net/bad", "2024-03-01", 0), ("http://z.net/bad/?q=/a/", "2024-03-01", 1),
        (None, "2024-03-01", 0), ("junk", "2024-03-01", 0), ("", None, 0), ("http://a.y.org/", None, 0), ("http://a.y.org/", "2024-03-01", 1),
    ]
    df = spark.createDataFrame([(i, u, d, n, "clash") for i, (u, d, n) in enumerate(cases)], "page_id int, url string, fetched string, want int, rule string").withColumns({"_u": F.lit(1), "_b": F.lit("x"), "_URL": F.lit(2), "Since": F.lit(3)}).withColumn("fetched", F.col("fetched").cast("date"))
    rows = urlfilter.judge(df, events).collect()
    assert len(rows) == len(cases) and all(r.active_rules == r.want and r.blocked == (r.want > 0) for r in rows)
    assert next(r.rule for r in rows if r.want == 2) == "p:z.net/bad/deep/"
    assert urlfilter.judge(df, events.limit(0)).where("blocked").count() == 0 == urlfilter.judge(df.limit(0), events).count()


# WARC


def test_archives(spark):
    big = "<p>" + "é" * 100 + "</p>"
    rows = [(5, "http://a/", big, "x"), (3, "http://b/ c", big, None), (9, None, big, None), (1, "http://d/", "short", None), (2, "http://e/", "short", None), (7, "http://f/", None, None), (None, "http://g/", big, None), (3, "http://b/ c", big, None), (11, "u", "y" * 300_000, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, refers_to string").repartition(2)
    manifest = warc.archive(spark, df)
    got = sorted((tuple(r) for r in warc.read_archives(manifest).select("page_id", "payload_bytes", "record_type", "refers_to", "html").collect()), key=str)
    n = len(big.encode())
    want = [(5, n, "revisit", 3, None), (3, n, "response", None, big), (3, n, "response", None, big), (9, n, "revisit", 3, None), (1, 5, "response", None, "short"), (2, 5, "response", None, "short"), (7, 0, "response", None, ""), (None, n, "response", None, big), (11, 300_000, "response", None, "y" * 300_000)]
    assert got == sorted(want, key=str)
    empty = warc.archive(spark, df.limit(0))
    assert empty.count() == 0 == warc.read_archives(empty).count()
    fs, path = pafs.FileSystem.from_uri(manifest.first().archive)
    raw = fs.open_input_stream(path, compression=None).read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == warc.DICTIONARY_MAGIC
    d = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    one = zstandard.ZstdDecompressor(dict_data=d).decompressobj().decompress(raw[8 + size :])  # the first frame is one record
    assert one.startswith(b"WARC/1.1\r\n") and one.count(b"WARC/1.1") == 1


def test_trained_dictionary_helps(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    recs = [warc.record(r.page_id, r.url, r.html.encode(), hashlib.sha256(r.html.encode()).hexdigest(), len(r.html.encode()), None, "d") for r in pages.collect()]
    out = io.BytesIO()
    w = warc.ArchiveWriter(out, warc.build_dictionary(recs))
    for x in recs:
        w.add(x)
    plain = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(x)) for x in recs)
    assert len(out.getvalue()) < plain
    out.seek(0)
    assert len(list(warc.read_archive(out))) == len(recs)


# pipeline


def test_one_of_each_large_group_stays(spark):
    """Groups well above neardup.SMALL, whose keys no half divides: the ids that stay are those of
    brute force."""
    texts = uneven_copies()
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts], spark.read.parquet(f"{SF}/documents.parquet").schema)
    got = [r.doc_id for r in corpus_pipeline.one_of_each(spark, df, SF).collect()]
    assert sorted(got) == sorted(i for i, (_, c) in brute_components(texts, 5).items() if i == c)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, seen = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.columns == docs.columns, name
        seen.append(at.count())
    assert seen[0] > seen[1] > seen[2] == seen[3]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sum(r.length for r in rows) > 0 and {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_on_odd_rows(spark, odd_docs, tmp_path):
    """Nulls, empty and very long texts, copies, repeated rows and an extra column, stage by stage against
    brute force; and tables without rows."""
    import public_tokenizers as public
    from tokenizers import Tokenizer

    passage, own = " ".join(f"p{i}" for i in range(60)), [" ".join(f"{s}{i}" for i in range(100)) for s in "xy"]
    docs = odd_docs.union(spark.createDataFrame([(11, f"{own[0]} {passage} {own[1]}", "en", "a", 9, "x"), (11, own[0], "en", "a", 9, "x")], odd_docs.schema))
    folder, bare = f"file://{tmp_path}/odd", f"file://{tmp_path}/bare"
    labels = spark.createDataFrame([(None, 1, 0), (1, None, None)], "doc_id bigint, quality int, toxic int")
    for f, d, l in ((folder, docs, labels), (bare, docs.limit(0), labels.limit(0))):
        d.write.parquet(f"{f}/documents.parquet")
        l.write.parquet(f"{f}/labels.parquet")
    at, given = spark.read.parquet(f"{folder}/documents.parquet"), {}
    rows = lambda df: sorted(map(str, df.collect()))
    for name, stage in corpus_pipeline.STAGES:
        given[name], at = at, store(stage(spark, at, folder), name)
    assert rows(given["near_duplicates"]) == rows(docs)  # labels without evidence reject nothing
    left = given["substrings"].collect()
    every = brute_components([((r.doc_id, r.text), r.text) for r in docs.where("doc_id is not null").collect()], 5)
    assert Counter(r.doc_id for r in left if spec_words(r.text)) == Counter(i for (i, t), (_, c) in every.items() if (i, t) == c and spec_words(t)) + Counter([None])
    assert {r.doc_id for r in left if not spec_words(r.text)} == {3, 4, 5}
    words_of = lambda df: Counter((r.doc_id, tuple(spec_words(r.text))) for r in df.collect())
    want = Counter((r.doc_id, tuple(spec_words(r.text.replace(passage, "") if r.doc_id == 11 else r.text))) for r in left)
    assert words_of(given["mixing"]) == want
    taken, mixed = Counter(), given["packing"].collect()
    for r in mixing.allot(given["mixing"]).collect():
        taken[r.doc_id] += r.taken
    got = Counter()
    for r in mixed:
        ws = tuple(spec_words(r.text))
        assert any(ws == w[: len(ws)] for i, w in want if i == r.doc_id)
        got[r.doc_id] += len(ws)
    assert got == +taken
    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert Counter(r.doc_id for r in mixed).keys() == {r.doc_id for r in at.collect()}
    assert sum(r.length for r in at.collect()) == sum(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)
    assert corpus_pipeline.run(spark, bare).count() == 0
