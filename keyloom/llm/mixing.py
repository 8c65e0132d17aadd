"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words: its share by weight of all words, stopped at
``max_repeat`` times its own size, with the excess shared again by weight. Inside a source the
expected copies of a document rise with the bit length of its size (long documents carry more
connected text): whole copies are certain, the remaining fraction p is the inclusion probability.
Pareto order sampling ranks documents by random odds over inclusion odds,
``(u / (1 - u)) / (p / (1 - p))``, and the first ones that fill the source's remaining words are
the sample. The sample size is fixed in words, so the last one may be taken in part.

No task holds a source: the cut in the ranking is found from a histogram of about sqrt(n) bins per
source, and only the bin that holds the cut is sorted.

Nulls: a null source is a source of its own, ranked last; a null text has no words; a null id is
drawn as the text ''. Documents without words are never taken. Repeated rows with one id draw the
same number and are ordered by size. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import WORD, fresh, global_rank, store, text_key, word_count

WEIGHTS = (5, 2, 1)


def uniform(key: Column) -> Column:
    """A number in (0, 1) that depends on the key only: 52 bits of its MD5, at the bin's middle."""
    digits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13), 16, 10)
    return (digits.cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """Adds weight and target to (source, source_size, ...). The level (words per unit of weight)
    is raised until no source is above its stop; each round is one small aggregate."""
    ranked = global_rank(sources, [F.col("source").asc_nulls_last()], "source_rank")
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), (F.col("source_rank") % len(weights) + 1).cast("int")).cast("double")
    ranked = store(ranked.withColumn("weight", w).withColumn("stop", F.col("source_size") * max_repeat), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        is_stopped = F.col("stop") <= F.lit(level) * F.col("weight")
        n, words, free = ranked.agg(F.count(F.when(is_stopped, 1)), F.sum(F.when(is_stopped, F.col("stop"))), F.sum(F.when(~is_stopped, F.col("weight")))).first()
        if n == stopped or not free:
            break
        stopped, level = n, (total - (words or 0)) / free
    target = F.when(F.col("stop") <= F.lit(level) * F.col("weight"), F.col("stop").cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return ranked.withColumn("target", target)


def allot(docs: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken (words, repeats counted), text_key."""
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), text_key(text).alias("text_key"))
    sized = store(sized.withColumn("_k", key).withColumn("_c", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0)), "sizes")
    classes = sized.groupBy("_k", "source", "_c").agg(F.sum("size").alias("_s"), F.count("*").alias("_n"))
    sources = classes.groupBy("_k", "source").agg(F.sum("_s").alias("source_size"), F.sum("_n").alias("_n"))
    sources = store(source_targets(sources, weights, max_repeat), "targets")

    # expected copies min(max_repeat, c * class) with c such that a source's expected words are its target
    top = Window.partitionBy("_k").orderBy(F.col("_c").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("_k").orderBy(F.col("_c").desc()).rowsBetween(0, Window.unboundedFollowing)
    per = classes.drop("_n").join(sources.select("_k", "target"), "_k").where("_c > 0")
    tried = (F.col("target") - max_repeat * F.coalesce(F.sum("_s").over(top), F.lit(0))) / F.sum(F.col("_c") * F.col("_s")).over(rest)
    per = per.withColumn("_try", tried).withColumn("_rate", F.max(F.when(F.col("_try") * F.col("_c") <= max_repeat, F.col("_try"))).over(Window.partitionBy("_k")))
    first = F.max(F.when(F.col("_try") * F.col("_c") <= max_repeat, F.col("_c"))).over(Window.partitionBy("_k"))
    per = per.withColumn("_first", first).withColumn("_rate", F.max(F.when(F.col("_c") == F.col("_first"), F.col("_try"))).over(Window.partitionBy("_k")))
    copies = F.when(F.col("_c") <= F.col("_first"), F.col("_rate") * F.col("_c")).otherwise(F.lit(float(max_repeat)))
    per = per.withColumn("_e", copies).withColumn("_whole", F.floor("_e")).withColumn("_p", F.col("_e") - F.col("_whole"))
    quota = F.floor(F.col("target") - F.sum(F.col("_whole") * F.col("_s")).over(Window.partitionBy("_k")) + F.lit(0.5))
    per = store(per.withColumn("_quota", quota).select("_k", "_c", "_whole", "_p", "_quota"), "classes")

    u = uniform(F.col("doc_id"))
    odds = (u / (1 - u)) / (F.col("_p") / (1 - F.col("_p")))
    facts = sources.select("_k", "source_size", "target", F.floor(F.sqrt("_n")).alias("_bins"))
    rows = sized.join(facts, "_k").join(per, ["_k", "_c"], "left").withColumn("_v", F.when(F.col("_p") > 0, odds / (1 + odds)))
    rows = rows.withColumn("_b", F.floor(F.col("_v") * F.col("_bins")))
    hist = rows.where("_v is not null").groupBy("_k", "_b", "_quota").agg(F.sum("size").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = hist.withColumn("_before", before).where("_before < _quota and _quota <= _before + _s").select("_k", F.col("_b").alias("_cut"), "_before")
    short = hist.groupBy("_k").agg((F.sum("_s") < F.max("_quota")).alias("_all"))
    cut = short.join(cut, "_k", "left")
    rows = rows.join(store(cut, "cuts"), "_k", "left")
    whole = F.coalesce(F.col("_whole"), F.lit(0)) * F.col("size")
    keep = ["doc_id", "source", "size", "source_size", "target", "text_key"]
    inside = F.col("_b") == F.col("_cut")
    clear = rows.where(~F.coalesce(inside, F.lit(False)))
    clear = clear.select(*keep, (whole + F.when(F.col("_v").isNotNull() & (F.col("_all") | (F.col("_b") < F.col("_cut"))), F.col("size")).otherwise(0)).alias("taken"))
    so_far = F.coalesce(F.sum("size").over(Window.partitionBy("_k").orderBy("_v", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = rows.where(inside).withColumn("_left", F.col("_quota") - F.col("_before") - so_far)
    edge = edge.select(*keep, (whole + F.greatest(F.lit(0), F.least("size", "_left"))).cast("bigint").alias("taken"))
    return clear.union(edge)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """The mixed documents, with the columns of docs: each taken whole as often as it was drawn;
    a part taken is its first words, joined by spaces. A row is found again by id, source and text; rows
    alike in all three share their allotments out, the largest first."""
    names = fresh(docs.columns, "_id", "_no_id", "_src", "_no_src", "_key", "_nth", "_taken", "_size", "_cut")
    i, no_i, s, no_s, k, nth, taken, size, cut = names
    key = lambda text: [F.coalesce("doc_id", F.lit(0)).alias(i), F.col("doc_id").isNull().alias(no_i), F.coalesce("source", F.lit("")).alias(s), F.col("source").isNull().alias(no_s), text.alias(k)]
    drawn = store(allot(docs, weights, max_repeat).select(*key(F.col("text_key")), F.col("taken").alias(taken), F.col("size").alias(size)), "drawn")
    rows, on = docs.select("*", *key(text_key())), names[:5]
    if not drawn.groupBy(*on).count().where("count > 1").isEmpty():
        number = lambda order: F.row_number().over(Window.partitionBy(*names[:5]).orderBy(order)).alias(nth)
        rows, drawn, on = rows.select("*", number(F.col(k))), drawn.select("*", number(F.col(taken).desc())), names[:6]
    drawn = drawn.where(F.col(taken) > 0)
    whole = F.floor(F.col(taken) / F.greatest(size, F.lit(1)))
    part = F.col(taken) - whole * F.col(size)
    sizes = F.concat(F.array_repeat(F.col(size), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    out = rows.join(drawn, on).withColumn(cut, F.explode(sizes))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col(cut).cast("int")), " ")
    uncut = F.col(cut) == F.col(size)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(uncut, F.col("n_chars")).otherwise(F.char_length(first).cast("bigint")))
    return out.withColumn("text", F.when(uncut, F.col("text")).otherwise(first)).select(docs.columns)


#: The same rows in SQL.
SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w, 3 * source_size AS stop FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(stop) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lv FROM s1
  WINDOW b AS (ORDER BY stop / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, coalesce((SELECT lv FROM s2 WHERE stop > lv * w ORDER BY stop / w, source NULLS LAST LIMIT 1), 0) AS level FROM s2),
s AS (SELECT source, source_size, CASE WHEN stop <= level * w THEN stop::DOUBLE ELSE level * w END AS target FROM s3),
c0 AS (SELECT source, length(bin(size)) AS c, sum(size)::BIGINT AS sz FROM d WHERE size > 0 GROUP BY ALL),
c1 AS (SELECT c0.*, target, (target - 3 * coalesce(sum(sz) OVER (PARTITION BY c0.source ORDER BY c DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(c * sz) OVER (PARTITION BY c0.source ORDER BY c DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t
  FROM c0 JOIN s ON c0.source IS NOT DISTINCT FROM s.source),
c2 AS (SELECT *, max(CASE WHEN t * c <= 3 THEN c END) OVER (PARTITION BY source) AS f FROM c1),
c3 AS (SELECT *, max(CASE WHEN c = f THEN t END) OVER (PARTITION BY source) AS rate FROM c2),
c4 AS (SELECT *, CASE WHEN c <= f THEN rate * c ELSE 3.0::DOUBLE END AS e FROM c3),
c AS (SELECT source, c, floor(e)::BIGINT AS whole, e - floor(e) AS p, floor(target - sum(floor(e)::BIGINT * sz) OVER (PARTITION BY source) + 0.5::DOUBLE)::BIGINT AS quota FROM c4),
r0 AS (SELECT d.*, whole, p, quota, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND length(bin(size)) = c AND size > 0),
r1 AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM r0),
r AS (SELECT doc_id, whole * size + CASE WHEN q IS NULL THEN 0 ELSE greatest(0, least(size, quota - coalesce(sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q / (1 + q), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) END AS taken FROM r1)
SELECT d.doc_id, d.size, s.source_size, s.target, coalesce(r.taken, 0)::BIGINT AS taken FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN r ON d.doc_id = r.doc_id
"""
