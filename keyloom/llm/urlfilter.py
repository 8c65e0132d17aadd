"""Temporal URL filters: every capture is judged by the list as it stood when it was fetched.

A list is a log of dated events (pattern, day, added or removed). Per pattern the events become
validity intervals [from, to); the last event of a day counts. An as-of join then finds, for every
capture, the intervals that hold at its fetch day. Patterns are ``d:<domain>`` (the domain and
all below it), ``h:<host>`` (that host only) and ``p:<host>/<path>/`` (a folder and all below it).
A capture is looked up by equality only: its host, its parent domains and its leading folders, as
deep as the deepest listed folder.

Captures are judged once per different (url, day), so repeated URLs cost one row. Joins are on
pattern keys; a hot host's rows are split by Spark's skew handling and lists are aggregated first.

A null or hostless URL, or a null fetch day, matches nothing and is not blocked. Events with a null
pattern, day or kind are ignored. Repeated captures are all returned. Empty lists block nothing.
Columns of captures are kept; clashing names of the result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import fresh

RESULT = ("host", "active_rules", "rule", "since", "blocked")


def host(url: Column) -> Column:
    """Lower-case host without user, port or trailing dot; '' where there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.lower(F.rtrim(found, F.lit(".")))


def intervals(events: DataFrame) -> DataFrame:
    """(pattern, since, until) of the spans in which a pattern is listed; until is null while open.
    events: pattern, day, added. On one day a removal wins over an addition."""
    day = events.where("pattern is not null and day is not null and added is not null").groupBy("pattern", "day").agg(F.min("added").alias("added"))
    w = Window.partitionBy("pattern").orderBy("day")
    turned = day.withColumn("_was", F.lag("added").over(w)).where("_was is null or _was <> added")
    return turned.withColumn("until", F.lead("day").over(w)).where("added").select("pattern", F.col("day").alias("since"), "until")


def patterns_of(url: Column, host_: Column, depth: int) -> Column:
    """All patterns that could match: the host, its domains, its leading folders down to depth."""
    labels = F.split(host_, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^?#]*/)", 1)
    folders = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.least(F.size(folders), F.lit(depth))
    paths = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("p:"), host_, F.lit("/"), F.array_join(F.slice(folders, F.lit(1), i), "/"), F.lit("/"))))
    return F.concat(F.array(F.concat(F.lit("h:"), host_)), domains, F.coalesce(paths, F.array().cast("array<string>")))


def judge(captures: DataFrame, events: DataFrame, url: str = "url", day: str = "fetched") -> DataFrame:
    """captures with host, active_rules (patterns that hold), rule (the longest of them), since
    (start of that rule's interval) and blocked."""
    spans = intervals(events)
    depth = spans.where("pattern like 'p:%'").agg(F.max(F.size(F.split("pattern", "/")) - 2)).first()[0] or 0
    kept = [c for c in captures.columns if c.lower() not in RESULT]
    if url not in kept or day not in kept:
        raise ValueError("url and day bear names of the result")
    u, d = fresh(captures.columns, "_url", "_day")
    distinct = captures.select(F.col(url).alias("_u"), F.col(day).alias("_d")).where("_u is not null and _d is not null").distinct()
    distinct = distinct.withColumn("_h", host(F.col("_u"))).where("_h <> ''")
    asked = distinct.select("_u", "_d", F.explode(patterns_of(F.col("_u"), F.col("_h"), int(depth))).alias("pattern"))
    held = asked.join(spans, "pattern").where("since <= _d and (until is null or _d < until)")
    best = F.max(F.struct(F.length("pattern").alias("n"), "pattern", "since"))
    verdict = held.groupBy(F.col("_u").alias(u), F.col("_d").alias(d)).agg(F.count("*").alias("active_rules"), best.alias("rule"))
    out = captures.select(*kept, F.coalesce(host(F.col(url)), F.lit("")).alias("host"))
    out = out.join(verdict, (out[url] == verdict[u]) & (out[day] == verdict[d]), "left")
    active = F.coalesce("active_rules", F.lit(0))
    return out.select(*kept, "host", active.alias("active_rules"), F.col("rule.pattern").alias("rule"), F.col("rule.since").alias("since"), (active > 0).alias("blocked"))


def demo_events(pages: DataFrame) -> DataFrame:
    """A dated list for pages, which come without one: a quarter of their hosts, domains and first
    folders are listed on a day drawn from the pattern's MD5, removed later, and some listed again."""
    h = host(F.col("url"))
    first = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)/", 1)
    found = F.array(F.concat(F.lit("h:"), h), F.concat(F.lit("d:"), F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1)), F.when(first != "", F.concat(F.lit("p:"), h, F.lit("/"), first, F.lit("/"))))
    n = F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("int")
    listed = pages.select(F.explode(found).alias("pattern")).where("pattern is not null").distinct().withColumn("n", n).where("n % 4 = 0")
    a = F.floor(F.col("n") / 4) % 300
    b = a + 10 + F.floor(F.col("n") / 1000) % 100
    day = lambda k: F.date_add(F.lit("2024-01-01").cast("date"), k.cast("int"))
    row = lambda k, added: F.struct(day(k).alias("day"), F.lit(added).alias("added"))
    rows = F.filter(F.array(row(a, True), row(b, False), F.when(F.col("n") % 8 == 0, row(b + 30, True))), lambda x: x.isNotNull())
    return listed.select("pattern", F.inline(rows))


def fetch_day(page_id: Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), (page_id * 37 % 366).cast("int"))


_HOST = "rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.')"
SQL = f"""
WITH pg AS (SELECT page_id, url, {_HOST} AS host, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetched,
   regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)/', 1) AS folder FROM pages),
pat AS (SELECT 'h:' || host AS pattern FROM pg UNION SELECT 'd:' || regexp_extract(host, '([^.]+\\.[^.]+)$', 1) FROM pg UNION SELECT 'p:' || host || '/' || folder || '/' FROM pg WHERE folder <> ''),
li AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 6))::INTEGER AS n FROM pat WHERE ('0x' || substr(md5(pattern), 1, 6))::INTEGER % 4 = 0),
ab AS (SELECT pattern, n, n // 4 % 300 AS a, n // 4 % 300 + 10 + n // 1000 % 100 AS b FROM li),
sp AS (SELECT pattern, DATE '2024-01-01' + a::INTEGER AS since, DATE '2024-01-01' + b::INTEGER AS until FROM ab UNION ALL SELECT pattern, DATE '2024-01-01' + (b + 30)::INTEGER, NULL FROM ab WHERE n % 8 = 0),
hit AS (SELECT page_id, pattern, since FROM pg JOIN sp ON since <= fetched AND (until IS NULL OR fetched < until) AND (pattern = 'h:' || host
   OR pattern LIKE 'd:%' AND ('.' || host) LIKE '%.' || substr(pattern, 3) OR pattern = 'p:' || host || '/' || folder || '/')),
best AS (SELECT page_id, count(*) AS active_rules, max({{'n': length(pattern), 'p': pattern, 's': since}}) AS b FROM hit GROUP BY page_id)
SELECT pg.page_id, url, fetched, host, coalesce(active_rules, 0) AS active_rules, b.p AS rule, b.s AS since, active_rules IS NOT NULL AS blocked FROM pg LEFT JOIN best ON pg.page_id = best.page_id
"""
