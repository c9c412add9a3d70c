"""URL filters with a temporal list join.

A list is a history: dated entries (pattern, action, category, at), where a pattern is a host with all hosts below it (example.com) or a host and the
begin of a path (example.com/ads; case counts in paths, a slash at the end doesn't), and an action is block, allow or remove. The entries of a pattern become intervals of validity, each ending where the
next begins. A capture asks for the keys that its URL can match (every host suffix, every path prefix), joins them by equality, and each key is evaluated as of the
time of the fetch. Of the patterns then in force the most specific one decides. Keys with more labels, steps or characters than any pattern of the list has can't match and aren't made, so
a URL with very many steps gives no more keys than the list is deep.

The list is broadcast if it has at most `broadcast_rows` intervals; beyond that both sides are shuffled by key and salt, so that a host with any
share of the captures is split over `salts` tasks. One more exchange by row brings the keys of a capture together; its rows are combined before.

Result: one row per capture: id, host, blocked, entry (the pattern that decided), category, listed_at; the last three null if no pattern was in force.

Edge cases: a null or malformed URL has no host and is never blocked; a null fetch time matches nothing; repeated captures are rows of their own; very long URLs are matched whole; of entries of a pattern
with the same date block wins over allow over remove, and equal entries count once; null patterns or dates are no entries. Empty captures or an empty list are fine. Other columns
aren't read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_enough

#: A small history of lists, in the form that `filter_urls` takes: pattern, action, category, day.
HISTORY = [
    ("adult-x.example.com", "block", "adult", "2023-02-01"),
    ("adult-x.example.com", "remove", "adult", "2023-09-15"),
    ("adult-x.example.com", "block", "adult", "2024-03-01"),
    ("spam-farm.example.org", "block", "spam", "2023-01-20"),
    ("www.spam-farm.example.org", "allow", "spam", "2023-06-01"),
    ("www.spam-farm.example.org", "block", "spam", "2023-12-24"),
    ("cheap-pills.example.net", "block", "pharmacy", "2023-04-04"),
    ("blog.cheap-pills.example.net/en", "allow", "pharmacy", "2023-08-08"),
    ("ads-track.example.com", "block", "tracking", "2023-03-03"),
    ("ads-track.example.com", "remove", "tracking", "2024-05-05"),
    ("casino-win.example.com", "block", "gambling", "2023-05-01"),
    ("casino-win.example.net", "block", "gambling", "2023-05-01"),
    ("casino-win.example.net", "allow", "gambling", "2023-05-01"),
    ("free-bets.example.net", "block", "gambling", "2023-07-07"),
    ("free-bets.example.com", "block", "gambling", "2023-07-07"),
    ("tionble.example.org/de", "block", "takedown", "2023-10-10"),
    ("tionble.example.org/de", "remove", "takedown", "2024-02-02"),
    ("blog.tionsh.example.com/fr", "block", "takedown", "2023-11-11"),
    ("nowhere.example", "block", "spam", "2023-01-01"),
]


_PATTERN = "rtrim('/', concat(lower(regexp_extract(pattern, '^[^/]*', 0)), regexp_extract(pattern, '/.*', 0)))"


def intervals(entries: DataFrame) -> DataFrame:
    """entries (pattern, action, category, at) as (pattern, action, category, since, until), only those that block or allow."""
    rank = F.expr("case action when 'block' then 2 when 'allow' then 1 else 0 end")
    one = entries.where("pattern is not null and at is not null").select(F.expr(_PATTERN).alias("pattern"), "at", F.struct(rank.alias("rank"), "category").alias("e")).groupBy("pattern", "at").agg(F.max("e").alias("e"))
    until = F.lead("at").over(Window.partitionBy("pattern").orderBy("at"))
    return one.select("pattern", "e.category", F.expr("e.rank = 2").alias("blocks"), F.col("at").alias("since"), until.alias("until"), F.col("e.rank").alias("rank")).where("rank > 0").drop("rank")


_HOST = r"rtrim('.', lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#]*)', 1), ':[0-9]*$', '')))"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1)"
_SUFFIXES = "transform(sequence(greatest(1, size(labels) - {labels} + 1), size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))"
_PREFIXES = "transform(filter(sequence(2, least(size(steps), {steps})), i -> steps[i - 1] <> ''), i -> concat(host, array_join(slice(steps, 1, i), '/')))"


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, time_col: str, broadcast_rows: int = 200_000, salts: int = 32) -> DataFrame:
    rows = captures.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{time_col}`").alias("fetched"))
    listed = intervals(entries)
    # how deep the list goes: three numbers
    deep = listed.agg(F.max(F.expr("size(split(pattern, '[.]'))")).alias("labels"), F.max(F.expr("size(split(pattern, '/'))")).alias("steps"), F.max(F.length("pattern")).alias("length")).first()
    labels, steps, length = deep.labels or 0, deep.steps or 0, deep.length or 0
    rows = rows.withColumn("host", F.expr(f"nullif({_HOST}, '')")).withColumn("labels", F.expr("split(host, '[.]')")).withColumn("steps", F.expr(f"split(left({_PATH}, {length + 1}), '/', {steps + 1})"))
    keys = f"concat({_SUFFIXES.format(labels=max(1, labels))}, if(size(steps) > 1 and {steps} > 1, {_PREFIXES.format(steps=max(2, steps))}, array()))"
    keyed = rows.withColumn("key", F.expr(f"explode_outer(filter(array_distinct({keys}), k -> length(k) <= {length}))"))
    keyed = keyed.select("uid", "id", "host", "fetched", "key")
    if small_enough(listed, broadcast_rows):
        listed, same = F.broadcast(listed), F.col("key") == F.col("pattern")
    else:
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)))
        listed = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        same = (F.col("key") == F.col("pattern")) & (F.col("salt") == F.col("_salt"))
    active = keyed.join(listed, same & (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))), "left")
    best = F.max(F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern").alias("n"), "pattern", "blocks", "category", "since"))).alias("best")
    done = active.groupBy("uid").agg(F.first("id").alias("id"), F.first("host").alias("host"), best)
    return done.select(F.col("id").alias(id_col), "host", F.coalesce("best.blocks", F.lit(False)).alias("blocked"), F.col("best.pattern").alias("entry"), F.col("best.category").alias("category"), F.col("best.since").alias("listed_at"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages bear no fetch time: here page k was fetched on day 37 k mod 600 from 1 January 2023."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.expr("date_add(date'2023-01-01', cast(page_id * 37 % 600 as int))").alias("fetched_on"))
    entries = spark.createDataFrame(HISTORY, "pattern string, action string, category string, at string").withColumn("at", F.col("at").cast("date"))
    return filter_urls(pages, entries, "page_id", "url", "fetched_on").withColumn("listed_at", F.col("listed_at").cast("string"))


_VALUES = ", ".join(f"({i}, '{p}', '{a}', '{c}', DATE '{d}')" for i, (p, a, c, d) in enumerate(HISTORY))
ORACLE = rf"""WITH e AS (SELECT pattern, category, CASE action WHEN 'block' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END AS rank, at_day FROM (VALUES {_VALUES}) t(i, pattern, action, category, at_day)),
    d AS (SELECT *, row_number() OVER (PARTITION BY pattern, at_day ORDER BY rank DESC, category DESC) AS k FROM e),
    v AS (SELECT pattern, category, rank, at_day AS since, lead(at_day) OVER (PARTITION BY pattern ORDER BY at_day) AS until FROM d WHERE k = 1),
    p AS (SELECT page_id, DATE '2023-01-01' + (page_id * 37 % 600)::INTEGER AS fetched,
        nullif(rtrim(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#]*)', 1), ':[0-9]*$', '')), '.'), '') AS host,
        regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
    m AS (SELECT page_id, pattern, category, rank, since, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, pattern DESC) AS k FROM p JOIN v
        ON rank > 0 AND since <= fetched AND (until IS NULL OR fetched < until)
        AND (host = pattern OR host LIKE '%.' || pattern OR (contains(pattern, '/') AND starts_with(host || path || '/', pattern || '/'))))
    SELECT page_id, host, coalesce(rank = 2, false) AS blocked, pattern AS entry, category, since::VARCHAR AS listed_at FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (page_id)"""

QUERIES = {"op8_url_filters": op8_url_filters}
ORACLES = {"op8_url_filters": ORACLE}
