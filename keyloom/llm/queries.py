"""One query per operator over its whole table, and the pipeline; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from keyloom.llm import ann, mixing, neardup, packing, pitman_yor, quality, substrings, topk, urlfilter, warc


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def op1_mixing(s, d):
    return mixing.allot(_t(s, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_near_duplicates(s, d):
    return neardup.near_duplicates(_t(s, d, "documents"), shingle=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op3_quality(s, d):
    return quality.assess(_t(s, d, "documents"), _t(s, d, "labels")).drop("text_key")


def op4_exact_top_k(s, d):
    return topk.exact_top_k(_t(s, d, "embeddings"), k=20, every=20, scale=64.0)


def op5_nearest(s, d):
    return ann.nearest(_t(s, d, "embeddings"), k=5, every=50)


def op6_pitman_yor(s, d):
    return pitman_yor.score(_t(s, d, "documents"), order=3)


def op7_packing(s, d):
    return packing.pack(_t(s, d, "documents"))


def op8_url_filter(s, d):
    pages = _t(s, d, "pages").select("page_id", "url")
    return urlfilter.judge(pages.withColumn("fetched", urlfilter.fetch_day(F.col("page_id"))), urlfilter.demo_events(pages))


def op9_substrings(s, d):
    return substrings.find_repeats(_t(s, d, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_warc(s, d):
    manifest = warc.archive(s, _t(s, d, "pages"))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_mixing, op2_near_duplicates, op3_quality, op4_exact_top_k, op5_nearest, op6_pitman_yor, op7_packing, op8_url_filter, op9_substrings, op10_warc)}
QUERIES["pipeline"] = corpus_pipeline.run

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP2 = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, hash(g) AS h, md5(g) AS g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(list_slice(ws, i, i + 3), ' ')) END) AS g FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS a, x AS b FROM e UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id, coalesce(c.m, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""
_OP9 = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN f USING (g) WHERE m < doc_id),
ps AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT ps.doc_id, count(gone.p) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY ps.p) FILTER (gone.p IS NULL), '') AS kept FROM ps LEFT JOIN gone ON ps.doc_id = gone.doc_id AND ps.p = gone.p GROUP BY ps.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
SQL = {"op1_mixing": mixing.SQL, "op2_near_duplicates": _OP2, "op4_exact_top_k": topk.SQL, "op8_url_filter": urlfilter.SQL, "op9_substrings": _OP9, "op10_warc": warc.SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
