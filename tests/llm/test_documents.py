import hashlib
import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import mixing, neardup, packing, pitman_yor, quality, queries, substrings
from keyloom.llm.common import store
from llm_help import SF, brute_components, brute_repeats, spec_words, uneven_copies
from oracle import same_rows


def test_words_follow_the_pattern():
    from keyloom.llm.common import words

    text = "a b c\td\x0be\x0cf\rg\nh \x1c\x85 É"
    assert words(text) == [w.encode() for w in spec_words(text)]


# mixing


@pytest.mark.parametrize("name", ["op1_mixing", "op2_near_duplicates", "op9_substrings", "op4_exact_top_k", "op8_url_filter", "op10_warc"])
def test_same_as_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), queries.SQL[name], SF)


def test_mixing_targets(spark, odd_docs):
    rows = mixing.allot(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.taken <= 3 * r.size for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    total = sum(r.size for r in rows)
    assert math.isclose(sum(g[0].target for g in by.values()), total)
    for g in by.values():
        assert abs(sum(r.taken for r in g) - g[0].target) <= 1 and g[0].target <= 3 * g[0].source_size
    assert sorted(map(tuple, mixing.allot(odd_docs).collect()), key=str) == sorted(map(tuple, rows), key=str)  # reruns agree
    assert mixing.allot(odd_docs.limit(0)).count() == 0


def test_mixing_repeats_and_cuts(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{i}_{j}" for j in range(10 + i)), "en", s, 1) for i in range(40) for s in ["a" if i < 5 else "b"]], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    taken = {r.doc_id: r.taken for r in mixing.allot(df).collect()}
    got = Counter()
    for r in mixing.mix(df).collect():
        got[r.doc_id] += len(r.text.split())
    assert got == Counter({k: v for k, v in taken.items() if v})


def test_mixing_keeps_null_ids(spark):
    """Rows without an id, of different and of equal sizes, and rows that share one id are drawn as allotted."""
    rows = [(None if i % 5 == 0 else 3 if i < 5 else i, " ".join(f"w{i}_{j}" for j in range(10 + i // 2)), "en", "a" if i < 10 else "b", 1) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    taken, got = Counter(), Counter()
    for r in mixing.allot(df).collect():
        taken[r.doc_id, r.source] += r.taken
    for r in mixing.mix(df).collect():
        got[r.doc_id, r.source] += len(r.text.split())
    assert taken[None, "a"] > 0 and got == Counter({k: v for k, v in taken.items() if v})


def test_mix_leaves_clashing_columns(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(5 + i)), "a" if i < 8 else None, i, "x", i) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _taken int, _SIZE string, _cut int")
    out = mixing.mix(df)
    assert out.columns == df.columns and all(r._taken == r._cut == r.doc_id and r._SIZE == "x" for r in out.collect()) and out.count()


# near duplicates


@pytest.mark.parametrize("shingle", [4, 5])
def test_components(spark, docs, odd_docs, shingle):
    for df in (docs, odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])):
        want = brute_components([(r.doc_id, r.text) for r in df.collect()], shingle)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, shingle).collect()}
        assert got == want


def test_components_edge_cases(spark, odd_docs):
    rows = neardup.near_duplicates(odd_docs, 4).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[None].component_id is None and by[None].kept is None
    assert by[3].n_shingles == by[4].n_shingles == by[5].n_shingles == 0 and by[3].kept
    assert by[7].component_id == 6 and by[6].n_shingles == 1 and by[9].component_id == 1 and not by[9].kept
    assert neardup.near_duplicates(odd_docs.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in neardup.keep_first(odd_docs).collect()).count("9") == 0


def test_rows_that_share_an_id(spark):
    """Texts decide: an id shared is no link, and a row goes for its own text only."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "k"), (2, a + " x", "k"), (2, b, "k"), (5, b + " y", "k"), (5, "five words of its own", None), (7, a + " z", "k"), (7, a + " z", "k"), (None, a, "k"), (9, None, "k"), (9, "", "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _id string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept, r.chief) for r in neardup.near_duplicates(df).collect()}
    assert got == {(1, 36, 1, True, True), (2, 37, 1, False, False), (2, 36, 2, True, True), (5, 37, 2, False, False), (5, 1, 5, True, True), (7, 37, 1, False, False), (None, 36, None, None, True), (9, 0, 9, True, True)}
    kept = sorted(map(str, neardup.keep_first(df).collect()))
    assert kept == sorted(map(str, (r for r in df.collect() if r.text in (a, b, None, "", "five words of its own"))))


def test_large_keys_are_divided(spark, monkeypatch):
    """Many texts around one core, so that keys are larger than SMALL and hold several components."""
    monkeypatch.setattr(neardup, "SMALL", 3)
    rng = np.random.default_rng(1)
    core = [f"c{i}" for i in range(200)]
    texts = []
    for i in range(60):
        ws = list(core)
        for j in rng.choice(200, int(rng.integers(2, 9)), replace=False):
            ws[j] = f"x{i}_{j}"
        texts.append((i, " ".join(ws)))
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 4).collect()} == brute_components(texts, 4)


def test_keys_that_no_half_divides(spark):
    """Keys well above SMALL whose nodes share most halves: no link across them is missed."""
    texts = uneven_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string"), 5).collect()}
    assert neardup.SMALL == 48 and got == brute_components(texts, 5)


def test_blocks_of_a_large_key(spark, monkeypatch):
    """Blocks of a few nodes, and links that only the later rounds try."""
    monkeypatch.setattr(neardup, "BLOCK", 40)
    monkeypatch.setattr(neardup, "FEW", 2)
    texts = uneven_copies(200, 150)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string"), 5).collect()}
    assert got == brute_components(texts, 5)


def test_parity_keeps_links():
    rng = np.random.default_rng(0)
    for n, d in ((50, 6), (400, 44), (5000, 555)):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[d // 2 :], rng.integers(0, 1 << 63, d // 2, dtype=np.uint64)])
        apart = sum((x ^ y).bit_count() for x, y in zip(neardup.parity(a), neardup.parity(b), strict=True))
        assert apart <= len(np.setxor1d(a, b))


# substrings


def test_repeats(spark, docs, odd_docs, monkeypatch):
    for df in (docs, odd_docs.where("doc_id is not null")):
        for asked, sent in ((4096, 1024), (1, 1)):
            monkeypatch.setattr(substrings, "ASKED", asked)
            monkeypatch.setattr(substrings, "SENT", sent)
            want = brute_repeats([(r.doc_id, r.text) for r in df.collect()])
            got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.find_repeats(df).collect()}
            assert got == want


def test_common_passage_costs_rows_in_proportion(spark, monkeypatch):
    """A passage in every document: each has a few rows of its own at every step, however many hold it."""
    passage, rows = " ".join(f"p{i}" for i in range(90)), {}

    def counting(df, name, path=None):
        out = store(df, name, path)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(substrings, "store", counting)
    made = []
    for n in (500, 2000):
        texts = [(i, " ".join(f"a{i}_{j}" for j in range(i % 40)) + f" {passage} " + " ".join(f"z{i}_{j}" for j in range(i % 30))) for i in range(n)]
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.find_repeats(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
        assert got == brute_repeats(texts)
        made.append(dict(rows))
    assert made[1]["asks"] <= 2000 and made[1]["shared"] <= made[0]["shared"] + 50  # one row a document; windows of the passage only
    assert all(made[1][k] <= 4.5 * made[0][k] + 50 for k in made[1])


def test_alike_compares_words():
    a = [b"%d" % i for i in range(200)]
    b = list(a)
    b[60] = b[120] = b"x"
    assert substrings.alike(a, b) == [(0, 60), (61, 120), (121, 200)] and substrings.alike(a, a) == [(0, 200)] and substrings.alike(a[:49], a[:49]) == []


def test_strip_goes_by_row(spark):
    """Rows that share an id, or have none, are cut each by its own text; clashing columns stay as they are."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage, 1, "k", 7), (2, "alpha " + passage, 2, "k", 7), (2, "quite another text", 3, None, 7), (None, passage + " omega", 4, "k", 7), (None, "no repeats here", 5, "k", 7), (None, None, None, "k", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, kept string, _ID int")
    got = sorted(str((str(r.doc_id), r.text, r.n_chars, r.kept)) for r in substrings.strip(df).collect())
    want = [("1", passage, 1, "k"), ("2", "alpha", 5, "k"), ("2", "quite another text", 3, None), ("None", "omega", 5, "k"), ("None", "no repeats here", 5, "k"), ("None", None, None, "k")]
    assert got == sorted(map(str, want))


def test_repeats_edge_cases(spark, odd_docs):
    rows = {r.doc_id: r for r in substrings.find_repeats(odd_docs, with_text=True).collect()}
    assert rows[9].n_removed == 62 and rows[9].kept == "" and rows[2].spans == [[1, 61]] and rows[2].kept == "gamma"
    assert rows[8].n_removed == 0  # its own repeats stay
    assert rows[3].n_words == 0 and rows[3].kept_sha256 == hashlib.sha256(b"").hexdigest() and rows[None].n_words == 4
    assert substrings.find_repeats(odd_docs.limit(0)).count() == 0
    out = substrings.strip(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()


# quality


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    odd = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 1
    got = quality.assess(docs, labels.where(odd)).join(labels.where(~odd).withColumnsRenamed({"quality": "q", "toxic": "t"}), "doc_id")
    n, right = got.agg(F.count("*"), F.sum((F.col("kept") == ((F.col("q") == 1) & (F.col("t") == 0))).cast("int"))).first()
    assert n > 1000 and right / n > 0.97


def test_quality_edge_cases(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.assess(odd_docs, none).where("kept").count() == odd_docs.count()  # no evidence, no rejection
    some = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (7, None, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = quality.assess(odd_docs, some).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.quality <= 1 for r in rows)
    assert quality.assess(odd_docs.limit(0), some).count() == 0
    assert quality.keep_good(odd_docs, some).columns == odd_docs.columns


def brute_posterior(rows, base):
    """Posterior of each (host, path, p) by plain loops: moments, shrinkage, the row itself left out."""
    hosts, paths = defaultdict(list), defaultdict(list)
    for h, p, x in rows:
        hosts[h].append(x)
        paths[h, p].append(x)
    overall = sum(x for _, _, x in rows) / len(rows)

    def concentration(groups, around):
        many = {k: g for k, g in groups.items() if len(g) > 1}
        n = sum(map(len, many.values()))
        spread = sum(len(g) * (sum(g) / len(g) - around(k)) ** 2 for k, g in many.items())
        inside = sum((sum(x * x for x in g) - sum(g) ** 2 / len(g)) / len(g) for g in many.values())
        law = sum(len(g) * around(k) * (1 - around(k)) for k, g in many.items())
        return min(1e6, max(1.0, law / n / max(1e-6, (spread - inside) / n) - 1)) if n and law else 10.0

    k = concentration(hosts, lambda _: overall)
    h_share = {h: (k * overall + sum(g)) / (k + len(g)) for h, g in hosts.items()}
    k = concentration(paths, lambda key: h_share[key[0]])
    logit = lambda x: math.log(min(max(x, 1e-9), 1 - 1e-9) / (1 - min(max(x, 1e-9), 1 - 1e-9)))
    out = []
    for h, p, x in rows:
        a, b = k * h_share[h] + sum(paths[h, p]), k + len(paths[h, p])
        out.append((h_share[h], a / b, 1 / (1 + math.exp(-(logit(x) - logit(base) + logit((a - x) / (b - 1)))))))
    return out


def test_posterior_against_brute_force(spark, monkeypatch):
    """All documents of a table through the query's own path: shares, concentrations, posteriors, kept."""
    d = "/root/testdata/sf0.01"
    models = []
    monkeypatch.setattr(quality, "fit", lambda *a, fit=quality.fit: models.append(fit(*a)) or models[-1])
    rows = queries.op3_quality(spark, d).collect()
    assert len(rows) == 1000
    q, t = (brute_posterior([(r.host, r.path, r[f"p_{x}"]) for r in rows], models[0].base[x]) for x in ("quality", "toxic"))
    for r, (qh, qp, qq), (th, tp, tt) in zip(rows, q, t, strict=True):
        assert np.allclose([r.quality_host, r.quality_path, r.quality, r.toxic_host, r.toxic_path, r.toxic], [qh, qp, qq, th, tp, tt], rtol=1e-6, atol=1e-9)
        assert r.kept == (qq >= 0.5 and tt < 0.5)


def test_markers_against_brute_force(spark):
    """Counted on the executors as in one place."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").where("toxic is not null")
    rows = spark.read.parquet(f"{d}/documents.parquet").join(labels, "doc_id").select("text", "toxic").collect()
    n, c = Counter(), {0: Counter(), 1: Counter()}
    for r in rows:
        n[r.toxic] += 1
        c[r.toxic].update({m for w in set((r.text or "").lower().split()) for m in quality.marks(w)})
    odds = {m: math.log((k + 0.1) / (n[1] + 0.2) / ((c[0][m] + 0.1) / (n[0] + 0.2))) for m, k in c[1].items() if k >= quality.SUPPORT}
    want = {m: v for m, v in odds.items() if v > 2.5}
    got = quality.fit(spark.read.parquet(f"{d}/documents.parquet"), labels).table
    assert want and got.keys() == want.keys() and all(math.isclose(got[m], want[m]) for m in want)


def test_keep_good_goes_by_row(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    gone = quality.assess(docs, labels).where("not kept").select("doc_id").limit(1)
    bad, good = docs.join(gone, "doc_id").first(), docs.join(quality.assess(docs, labels).where("kept").select("doc_id").limit(1), "doc_id").first()
    more = spark.createDataFrame([(good.doc_id, bad.text, bad.lang, bad.source, 1), (None, bad.text, bad.lang, bad.source, 1)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    out = quality.keep_good(docs.unionByName(more), labels.where(F.col("doc_id") != good.doc_id))
    assert out.where(F.col("doc_id") == good.doc_id).collect() == [good] and out.where("doc_id is null").count() == 0


def test_sparse_sites_are_shrunk(spark):
    rows = [("big", "p", 0.9)] * 200 + [("poor", "p", 0.1)] * 200 + [("tiny", "p", 0.1)]
    df = spark.createDataFrame([(i, h, p, h, p, v) for i, (h, p, v) in enumerate(rows)], "doc_id int, host string, path string, hk string, pk string, p_quality double")
    share = {r.host: r.quality_path for r in quality.posterior(df, "quality", 0.5).collect()}
    assert share["poor"] < share["tiny"] < share["big"] and share["poor"] < 0.15


# language model


def test_scores(spark, docs):
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b" end"]) for r in docs.collect()]
    train = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    c = Counter(w for i, ws in rows if train(i) for w in ws)
    n, v = sum(c.values()), len(c)
    for kw in ({}, {"chunk": 3000, "bucket": 20_000}):
        got = {r.doc_id: r for r in pitman_yor.score(docs, **kw).collect()}
        held = [0.0, 0.0]
        for i, ws in rows:
            r = got[i]
            assert (r.n_tokens, r.n_known, r.held_out, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), not train(i), n)
            assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
            if r.held_out:
                held[0] += r.base_score
                held[1] += r.score
        assert held[1] > held[0]  # better than the base on what was not learned


def test_hot_contexts_are_split(spark):
    texts = [(i, " ".join(w for j in range(300) for w in ("the", f"n{(i * 7 + j) % 90}"))) for i in range(12)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    one, many = (sum(r.score for r in pitman_yor.score(df, **kw).collect()) for kw in ({}, {"chunk": 1000, "bucket": 1000}))
    assert abs(one - many) < 0.05 * abs(one)


def test_scores_edge_cases(spark, odd_docs):
    rows = pitman_yor.score(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(math.isfinite(r.score) for r in rows)
    assert next(r for r in rows if r.doc_id == 3).n_tokens == 1
    assert pitman_yor.score(odd_docs.limit(0)).count() == 0


def test_scores_by_hand(spark):
    """Pairs and words that occur once leave the sampler no choice: every score is a closed formula."""
    train, held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 != 2), [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    k, d, theta, d0, theta0 = 30, 0.8, 1.0, 0.7, 10.0
    texts = {train: " ".join(f"w{i}" for i in range(k)), held[0]: "w3 W4 new w5 w29", held[1]: ""}
    v = n = k + 1
    after = {"w%d" % i: "w%d" % (i + 1) for i in range(k - 1)} | {None: "w0", f"w{k - 1}": "end"}
    parent = lambda w: ((1 - d0 if w in after.values() else 0) + (theta0 + d0 * n) / (v + 1)) / (theta0 + n)
    def pair(u, w):
        return ((1 - d if after[u] == w else 0) + (theta + d) * parent(w)) / (theta + 1) if u in after else parent(w)
    got = {r.doc_id: r.score for r in pitman_yor.score(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    for i, text in texts.items():
        ws = [*text.lower().split(), "end"]
        assert math.isclose(got[i], sum(math.log10(pair(u, w)) for u, w in zip([None, *ws], ws, strict=False)), rel_tol=1e-7)


def test_gibbs_against_enumeration():
    """Mean tables of the dishes of one small restaurant, by all seatings."""
    d, theta, c, base = 0.8, 1.0, (5, 3), (0.2, 0.05)
    s = np.exp(pitman_yor.stirling(d))
    mean, total = np.zeros(2), 0.0
    for t0 in range(1, 6):
        for t1 in range(1, 4):
            w = s[5, t0] * s[3, t1] * base[0] ** t0 * base[1] ** t1 * math.prod(theta + d * k for k in range(t0 + t1))
            mean, total = mean + w * np.array([t0, t1]), total + w
    rooms = 20_000
    t = pitman_yor.gibbs(np.repeat(np.arange(rooms), 2), np.tile(c, rooms), np.tile(base, rooms), rooms, np.ones(rooms), d, theta, 1)
    assert np.allclose(t.reshape(-1, 2).mean(0), mean / total, rtol=0.02)


def test_contexts_are_split_by_their_number(spark):
    """Contexts that are no large share of the corpus are split as soon as they overfill a bucket, and
    chunks send to occupied buckets only."""
    rng = np.random.default_rng(0)
    texts = [(i, " ".join(f"c{j}" if k % 2 else f"n{j}" for k, j in enumerate(rng.integers(0, 300, 400).tolist()))) for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    one, many = ({r.doc_id: (r.n_known, r.base_score, r.score) for r in pitman_yor.score(df, **kw).collect()} for kw in ({}, {"chunk": 2000, "bucket": 20}))
    assert all(one[i][0] == many[i][0] and math.isclose(one[i][1], many[i][1]) and abs(one[i][2] - many[i][2]) < 0.05 * abs(one[i][2]) for i in one)


def test_seating():
    rng = np.random.default_rng(0)
    c = np.repeat([1, 2, 30, 500], 4000)
    t = pitman_yor.seat(c, np.full(len(c), 0.01), np.full(len(c), 5.0), 0.5, 1.0, rng)
    assert (t >= 1).all() and (t <= c).all() and (t[c == 1] == 1).all()
    new = (1 + 0.5 * (5 + 0)) * 0.01
    second = (1 + 0.5 * (5 + 1)) * 0.01
    assert abs((t[c == 2] == 2).mean() - second / (second + 0.5)) < 0.01 and new > 0


def _all_seatings(grams: dict, p: list, vocabulary: int) -> dict:
    """Mean predictive probability of each sequence (nearest context word first) by all seatings of the whole hierarchy."""
    tables = [np.exp(pitman_yor.stirling(d)[:20, :20]) for d, _ in p]
    place = lambda g: [(*g[:k], g[-1]) for k in range(len(g))]  # noqa: E731  (word), (nearest, word), ...
    rising = lambda a, b, n: math.prod(a + b * i for i in range(n))
    sums, total = dict.fromkeys(grams, 0.0), 0.0

    def descend(k, counts, seated, weight):
        nonlocal total
        if k < 0:
            prob = {(): 1 / (vocabulary + 1)}
            for j, (d, theta) in enumerate(p):
                cs, ts = seated[j]
                for g in grams:
                    x = place(g)[j]
                    room = [y for y in cs if y[:-1] == x[:-1]]
                    up = prob[place(g)[j - 1]] if j else prob[()]
                    prob[x] = (max(cs.get(x, 0) - d * ts.get(x, 0), 0) + (theta + d * sum(ts[y] for y in room)) * up) / (theta + sum(cs[y] for y in room))
            total += weight
            for g in grams:
                sums[g] += weight * prob[g]
            return
        d, theta = p[k]
        for t in itertools.product(*(range(1, c + 1) for c in counts.values())):
            ts, w, above = dict(zip(counts, t, strict=True)), weight, Counter()
            for x, c in counts.items():
                w *= tables[k][c, ts[x]]
                above[(*x[:-2], x[-1])] += ts[x]
            for room in {x[:-1] for x in counts}:
                inside = [x for x in counts if x[:-1] == room]
                w *= rising(theta, d, sum(ts[x] for x in inside)) / rising(theta, 1, sum(counts[x] for x in inside))
            descend(k - 1, above, {**seated, k: (counts, ts)}, w * (vocabulary + 1.0) ** -sum(t) if k == 0 else w)

    descend(len(p) - 1, {g: c for g, c in grams.items() if c}, {}, 1.0)
    return {g: s / total for g, s in sums.items()}


@pytest.mark.parametrize(
    "grams",
    [
        {(0, 1, 2): 3, (0, 2, 2): 2, (0, 1, 3): 2, (1, 0, 2): 2, (0, 1, 1): 0, (3, 3, 3): 0},
        {(0, 2): 4, (0, 3): 2, (1, 2): 3, (1, 1): 0},
    ],
)
def test_hierarchy_against_enumeration(grams):
    """Sweeps over all levels, with the restaurant of all words between them, sample the joint posterior."""
    order, vocabulary, p = len(next(iter(grams))), 3, [(0.5, 2.0), (0.6, 1.5), (0.7, 1.0)]
    p = p[:order]
    want = _all_seatings(grams, p, vocabulary)
    columns = [np.array([g[i] for g in sorted(grams)]) for i in range(order)]
    r = pitman_yor.Restaurants([(pitman_yor._ints(np.arange(4), rising=True), [pitman_yor._ints(x) for x in columns], pitman_yor._ints(np.array([grams[g] for g in sorted(grams)])), pitman_yor._ints(np.zeros(0, np.int64)))])
    rng, mean, rounds = np.random.default_rng(1), 0.0, 3000
    for i in range(rounds):
        live, t = np.flatnonzero(r.own), np.zeros(4, np.int64)
        t[live] = pitman_yor.gibbs(np.zeros(len(live), int), r.own[live], np.full(len(live), 1 / (vocabulary + 1)), 1, np.ones(1), *p[0], i, 2, 1)
        r.take((r.own.copy(), t, np.zeros((2, 0), np.int64)), (int(r.own.sum()), int(t.sum())))
        r.sweep(p, vocabulary, rng)
        r.take((r.own.copy(), np.minimum(t, r.own), np.zeros((2, 0), np.int64)), (int(r.own.sum()), int(t.sum())))
        mean = mean + r.probabilities(p, vocabulary, order - 1)
    got = dict(zip(sorted(grams), mean[r.asked[0]] / rounds, strict=True))
    assert all(math.isclose(got[g], want[g], rel_tol=0.05) for g in grams), (got, want)


def test_words_two_back_matter(spark, tmp_path):
    """The query's contexts are longer than one word: after "x", only the word before it tells c from d."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    rows = [(i, "a x c" if n % 2 else "b x d") for n, i in enumerate(ids[:200])] + list(zip(held, ("a x c", "a x d", "b x d", "b x c"), strict=True))
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in queries.op6_pitman_yor(spark, str(tmp_path)).collect()}
    assert got[held[0]] > got[held[1]] + 1 and got[held[2]] > got[held[3]] + 1


def test_split_contexts_of_two_words(spark):
    """Parts of a split context tell each other their customers: with many small chunks and buckets as with one."""
    rng = np.random.default_rng(0)
    texts = [(i, " ".join(f"c{j % 7}" if k % 2 else f"n{j}" for k, j in enumerate(rng.integers(0, 60, 300).tolist()))) for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    one, many = ({r.doc_id: (r.n_known, r.base_score, r.score) for r in pitman_yor.score(df, order=3, **kw).collect()} for kw in ({}, {"chunk": 2000, "bucket": 400}))
    assert all(one[i][0] == many[i][0] and math.isclose(one[i][1], many[i][1]) and abs(one[i][2] - many[i][2]) < 0.02 * abs(one[i][2]) for i in one)


# packing


def test_packing_round_trip(spark, docs, odd_docs):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for df in (docs, odd_docs):
        rows = packing.pack(df, with_ids=True).collect()
        want = Counter((r.doc_id, tuple(tok.encode(r.text or "", add_special_tokens=False).ids) + (1,)) for r in df.collect())
        by, seqs = defaultdict(list), defaultdict(list)
        for r in rows:
            ids = np.frombuffer(r.ids, "<u4")
            assert len(ids) == r.length <= 2048 and zlib.crc32(r.ids) == r.ids_crc32
            by[r.doc_id].append((r.start, tuple(ids), r.doc_tokens))
            seqs[r.sequence_id].append((r.offset, r.length))
        assert sum(len(p[1]) for ps in by.values() for p in ps) == sum(len(k[1]) * n for k, n in want.items())
        for (i, ids), n in want.items():
            if n == 1 and len([k for k in want if k[0] == i]) == 1:
                assert tuple(x for p in sorted(by[i]) for x in p[1]) == ids
        for pieces in seqs.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 2048
        assert packing.pack(df.limit(0)).count() == 0


def _odd_texts(rng: np.random.Generator, number: int) -> list[str]:
    """Texts of random code points of several scripts, spaces, digits, marks and controls."""
    ranges = [(0x20, 0x7F), (0x00, 0x20), (0xA0, 0x250), (0x300, 0x370), (0x370, 0x530), (0x590, 0x700), (0x900, 0xE00), (0x2000, 0x2070), (0x3000, 0x3100), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFB00, 0xFFFD), (0x1F300, 0x1FAFF), (0x20000, 0x20100), (0xE0000, 0x10FFFF)]
    pools = [np.arange(a, b) for a, b in ranges]
    common = np.array([ord(x) for x in "  \n\t\r'sdmtlrve0123456789.,-_ABCxyz\u00a0\u2028\u3000\u0085"])
    out = []
    for _ in range(number):
        chosen = [pools[i] for i in rng.integers(0, len(pools), 2)] + [common]
        points = np.concatenate([rng.choice(c, rng.integers(0, 14)) for c in chosen])
        out.append("".join(map(chr, rng.permutation(points))))
    return out


def test_ids_are_those_of_the_json_file():
    from tokenizers import Tokenizer

    paths = packing.default_tokenizer()
    ours, theirs = packing.encoder(paths), Tokenizer.from_file(paths[0])
    rng = np.random.default_rng(11)
    texts = _odd_texts(rng, 20_000)
    texts += [c * n for c in ("a", " ", "\n", "0", "ab", "\u3042", "\U0001f600", "-", " \n") for n in (1, 2, 3, 1_000, 50_000)]
    texts += ["", "<|endoftext|>", "a<|endoftext|> b", "<|endoftext|", "I'll we've 'S 'LL ''s", "\ud7ff\ue000\ufffd"]
    texts.append("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 60_000)))
    for text in texts:
        assert ours(text).tolist() == theirs.encode(text, add_special_tokens=False).ids, ascii(text[:100])


def test_packing_is_tight(spark):
    rows = packing.pack(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert rows[1] * 2048 / rows[0] < 1.01


def test_cutting_stock():
    rng = np.random.default_rng(0)
    for top, mean in ((256, 30), (64, 5), (256, 0.3)):
        sizes, demand = np.arange(1, top), rng.poisson(mean, top - 1)
        sizes, demand = sizes[demand > 0], demand[demand > 0].astype(float)
        plan = packing.cut_stock(sizes, demand, top)
        assert (sum(p * n for p, n in plan) == demand).all() and all(p @ sizes <= top for p, _ in plan)
        assert sum(n for _, n in plan) <= 1.01 * (sizes * demand).sum() / top + 2
    assert packing.cut_stock(np.array([], int), np.array([]), 256) == []
