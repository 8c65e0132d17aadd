"""Document quality by hierarchical empirical Bayes.

A classifier gives each document evidence for two traits, good quality and toxicity. Documents
belong to a path on a host; the share of a trait on a host is a Beta variable around the global
share, the share on a path a Beta variable around its host's. Both concentrations are estimated by
moments from the grouped scores, so hosts or paths with few documents are drawn to the level above
and large ones speak for themselves. A document's posterior log odds are its evidence (log odds of
the classifier less those of the labelled sample) plus the prior log odds of its path, with the
document itself left out of that prior. A document is kept if it is good and not toxic.

The classifier is fitted on at most ``sample`` labelled rows, the first by a hash of the id; their words
are counted on the executors, and the driver gets ``sample`` rows of a dozen numbers and at most three
tables of ``MARKERS`` words and word beginnings, however long the texts are. Everything else covers
all documents: scores, host and path sums, concentrations.

Nulls: a null text is empty; a null host or path is a site of its own; labels with a null id or
trait are ignored. Without labels of both kinds for a trait the classifier has no evidence, and a
trait without evidence never rejects. Rows that
share an id are scored each, and each is kept or goes by its own text. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import rows_of, store, text_key, without

SAMPLE, MARKERS, SUPPORT = 8000, 20_000, 4
_EDGE = ".,;:!?\"'()[]{}<>|*%&$#-_"
_CACHED = 50_000
#: Bytes counted as letters: A-Z, then a-z and the first bytes of characters beyond ASCII.
_UPPER = bytes(range(65, 91))
_OTHER = bytes(range(97, 123)) + bytes(range(0xC2, 0xF5))
NAMES = ("upper", "letters", "bars", "marked", "repeats", "kinds", "lines", "length")


def shape(text: str) -> list[float]:
    """Shares that tell running text from shouting, tables, marked-up and repeated text."""
    ws = text.split()
    n = max(1, len(ws))
    raw = text.encode("utf-8", "surrogatepass")
    upper = len(raw) - len(raw.translate(None, _UPPER))
    letters = upper + len(raw) - len(raw.translate(None, _OTHER))
    lines = text.split("\n")
    known = set(ws)
    return [
        upper / max(1, letters),
        min(1.0, letters / max(1, len(text) - text.count(" ") - text.count("\n"))),
        ws.count("|") / n,
        sum(1 for w in ws if len(w) > 2 and not w[-1].isalnum() and not w[-2].isalnum()) / n,
        sum(map(str.__eq__, ws, ws[1:])) / n,
        np.log1p(len(known)) / np.log1p(n) if ws else 0.0,
        len(set(lines)) / len(lines),
        min(1.0, np.log1p(n) / 10),
    ]


def marks(word: str) -> list[str]:
    """What a word may be recognised by: itself and its beginnings, without edge punctuation."""
    w = word.strip(_EDGE)
    return [w, w[:6] + "~", w[:5] + "~", w[:4] + "~"] if len(w) > 3 else [w] if w else []


def _expand(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), x, x * x], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 25) -> np.ndarray:
    """Weights by Newton steps; written without a BLAS, whose threads can stall in a forked driver."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip((x * w).sum(1), -30, 30)))
        grad = (x * (p - y)[:, None]).sum(0) + ridge * w
        s = p * (1 - p)
        hess = np.array([(x * (s * x[:, i])[:, None]).sum(0) for i in range(x.shape[1])]) + ridge * np.eye(x.shape[1])
        step = solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gaussian elimination for a small system."""
    m = np.concatenate([a, b[:, None]], axis=1)
    for i in range(len(b)):
        j = i + int(np.abs(m[i:, i]).argmax())
        m[[i, j]] = m[[j, i]]
        m[i] /= m[i, i]
        f = m[:, i].copy()
        f[i] = 0
        m -= f[:, None] * m[i]
    return m[:, -1]


class _Weights(dict):
    """Marker weight of a word: the largest of what it may be recognised by."""

    def __init__(self, table: dict[str, float]):
        super().__init__()
        self.table = table

    def __missing__(self, word: str) -> float:
        if len(self) >= _CACHED:
            self.clear()
        v = self[word] = max((self.table.get(m, 0.0) for m in marks(word)), default=0.0)
        return v


class Model:
    """Logistic weights over the shape for quality; words that mark toxicity with their log odds, and
    logistic weights over their sum, maximum and number. A trait without both kinds has no weights."""

    def __init__(self, quality: np.ndarray | None, toxic: np.ndarray | None, table: dict[str, float], base: dict[str, float]):
        self.quality, self.toxic, self.table, self.base = quality, toxic, table, base

    @staticmethod
    def sums(values: list[float]) -> list[float]:
        hit = [v for v in values if v]
        return [min(sum(hit), 30.0) / 10, max(hit, default=0.0) / 5, min(len(hit), 5) / 5]

    def score(self, shapes: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of both traits; NaN where there is no evidence."""
        sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.full(len(shapes), np.nan)
        good = none if self.quality is None else sig((_expand(shapes) * self.quality).sum(1))
        bad = none if self.toxic is None else sig((np.concatenate([np.ones((len(sums), 1)), sums], 1) * self.toxic).sum(1))
        return good, bad


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py() or "" for t in batch.column("text")]
        yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("quality", "toxic", "fold")} | {"shape": pa.array([shape(t) for t in texts], pa.list_(pa.float64())), "words": pa.array([sorted(set(t.lower().split())) for t in texts], pa.list_(pa.string()))})


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text the different markers it holds."""
    for batch in batches:
        found = [sorted({m for w in ws.as_py() for m in marks(w)}) for ws in batch.column("words")]
        yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "fold": batch.column("fold"), "mark": pa.array(found, pa.list_(pa.string()))})


def markers(features: DataFrame, sides: list[Column]) -> list[dict[str, float]]:
    """For the texts of each side, the markers at least ``SUPPORT`` toxic ones hold, with the log of how
    much oftener these hold them: of each side the ``MARKERS`` strongest."""
    bad, out = F.col("toxic") == 1, []
    n = features.agg(*(F.count(F.when(side & (bad == x), 1)) for side in sides for x in (True, False))).first()
    each = features.select("toxic", "fold", "words").mapInArrow(_marks, "toxic double, fold int, mark array<string>").select("toxic", "fold", F.explode("mark").alias("mark"))
    counts = each.groupBy("mark").agg(*(F.count(F.when(side & (bad == x), 1)).alias(f"{'b' if x else 'g'}{i}") for i, side in enumerate(sides) for x in (True, False)))
    counts = store(counts.where(F.greatest(*(F.col(f"b{i}") for i in range(len(sides))), F.lit(0)) >= SUPPORT), "markers")
    for i in range(len(sides)):
        rate = lambda c, all_: (F.col(c) + 0.1) / (max(1, all_) + 0.2)
        odds = F.log(rate(f"b{i}", n[2 * i]) / rate(f"g{i}", n[2 * i + 1])).alias("v")
        strong = counts.where(F.col(f"b{i}") >= SUPPORT).select("mark", odds).where("v > 2.5").orderBy(F.col("v").desc(), F.col("mark").desc()).limit(MARKERS)
        out.append({r["mark"]: r["v"] for r in strong.collect()})
    return out


def _crossed(tables: list[dict[str, float]]):
    """Marker sums of the texts of each fold, by the table of the other one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [_Weights(t) for t in tables]
        for batch in batches:
            sums = [Model.sums([weights[1 - fold][w] for w in ws.as_py()]) for ws, fold in zip(batch.column("words"), batch.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "sums": pa.array(sums, pa.list_(pa.float64()))})

    return work


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents. Markers and their calibration come from
    different halves of the texts, dealt by a hash of the id."""
    good = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    sign = lambda c: F.when(F.col(c) > 0, F.lit(1.0)).when(F.col(c).isNotNull(), F.lit(0.0)).alias(c)
    chosen = good.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", sign("quality"), sign("toxic"), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int").alias("fold"))
    chosen = store(chosen, "labelled")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    features = store(rows_of(texts, chosen, ["doc_id"]).mapInArrow(_features, "quality double, toxic double, fold int, shape array<double>, words array<string>"), "features")
    weights: dict[str, np.ndarray | None] = {"quality": None, "toxic": None}
    base, table = {}, {}
    q = features.where("quality is not null").select("quality", "shape").toArrow()
    y = q.column("quality").to_numpy()
    if 0 < y.sum() < len(y):
        weights["quality"], base["quality"] = logistic(_expand(np.array(q.column("shape").to_pylist(), float)), y), float(y.mean())
    judged = features.where("toxic is not null")
    n, bad = judged.agg(F.count("*"), F.sum("toxic")).first()
    if n and 0 < bad < n:
        *halves, table = markers(judged, [F.col("fold") == 0, F.col("fold") == 1, F.lit(True)])
        t = judged.select("toxic", "fold", "words").mapInArrow(_crossed(halves), "toxic double, sums array<double>").toArrow()
        sums, y = np.array(t.column("sums").to_pylist(), float), t.column("toxic").to_numpy()
        weights["toxic"], base["toxic"] = logistic(np.concatenate([np.ones((len(y), 1)), sums], 1), y), float(y.mean())
    return Model(weights["quality"], weights["toxic"], table, base)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_key, host, path, p_quality, p_toxic per row of (doc_id, text_key, host, path, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(model.table)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            shapes = np.array([shape(t) for t in texts], float).reshape(-1, len(NAMES))
            sums = np.array([model.sums([v for v in map(weights.__getitem__, set(t.lower().split())) if v]) for t in texts], float).reshape(-1, 3)
            good, bad = model.score(shapes, sums)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", "text_key", "host", "path")} | {"p_quality": pa.array(good, from_pandas=True), "p_toxic": pa.array(bad, from_pandas=True)})

    return docs.mapInArrow(work, "doc_id bigint, text_key bigint, host string, path string, p_quality double, p_toxic double")


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def _spread(groups: DataFrame, share: Column, around: Column) -> float:
    """Concentration of a Beta law of group shares, by moments: variance of the shares around the
    level above, less what their own documents' variance explains."""
    row = groups.where("n > 1").agg(F.sum(F.col("n") * F.pow(share - around, 2)), F.sum(F.col("v") / F.col("n")), F.sum("n"), F.sum(F.col("n") * around * (1 - around))).first()
    if not row[2] or not row[3]:
        return 10.0
    between = max(1e-6, (row[0] - row[1]) / row[2])
    return float(min(1e6, max(1.0, row[3] / row[2] / between - 1)))


def posterior(scored: DataFrame, trait: str, base: float | None) -> DataFrame:
    """scored with <trait>_host, <trait>_path (posterior shares) and <trait> (posterior probability)."""
    p = F.col(f"p_{trait}")
    if base is None:
        return scored.withColumns({f"{trait}_host": F.lit(None).cast("double"), f"{trait}_path": F.lit(None).cast("double"), trait: F.lit(None).cast("double")})
    paths = store(scored.groupBy("hk", "pk").agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("s2")), "paths")
    hosts = paths.groupBy("hk").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2"))
    total = hosts.agg(F.sum("s"), F.sum("n")).first()
    overall = total[0] / total[1] if total[1] else 0.5
    var = (F.col("s2") - F.col("s") * F.col("s") / F.col("n")).alias("v")
    k = _spread(hosts.select("n", "s", var), F.col("s") / F.col("n"), F.lit(overall))
    hosts = store(hosts.select("hk", ((F.lit(k * overall) + F.col("s")) / (F.lit(k) + F.col("n"))).alias("h")), "hosts")
    paths = paths.join(hosts, "hk")
    k = _spread(paths.select("n", "s", "h", var), F.col("s") / F.col("n"), F.col("h"))
    paths = store(paths.select("hk", "pk", "h", (F.lit(k) * F.col("h") + F.col("s")).alias("a"), (F.lit(k) + F.col("n")).alias("b")), "path_shares")
    odds = _logit(p) - _logit(F.lit(base)) + _logit((F.col("a") - p) / (F.col("b") - 1))
    out = scored.join(paths, ["hk", "pk"]).withColumns({f"{trait}_host": F.col("h"), f"{trait}_path": F.col("a") / F.col("b"), trait: 1 / (1 + F.exp(-odds))})
    return out.drop("h", "a", "b")


def assess(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Per row of docs: doc_id, text_key, host, path, p_quality, p_toxic, host and path shares, quality, toxic, kept."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text")
    model = fit(docs, labels, sample)
    key = lambda c: F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(c)))
    scored = store(classify(rows, model).withColumns({"hk": key("host"), "pk": key("path")}), "scored")
    for trait in ("quality", "toxic"):
        scored = posterior(scored, trait, model.base.get(trait))
    kept = (F.coalesce("quality", F.lit(1.0)) >= 0.5) & (F.coalesce("toxic", F.lit(0.0)) < 0.5)
    return scored.withColumn("kept", kept).drop("hk", "pk")


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """docs without rejected documents."""
    return without(docs, assess(docs, labels, host, path).where("not kept"))
