"""URL verdicts: longest-match rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes are counted per host, registered domain and suffix. Each level's bad rate has a beta prior
centred on its parent's posterior mean; the prior's strength is fitted to the spread of the rates on that level by
the method of moments. A host is blocked when the lower bound of its posterior bad rate reaches the threshold; a host
without outcomes is judged by its prior, so by what its domain, or else its suffix, has shown.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (  # fixed values: host, path, verdict
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD, Z = 0.5, 1.645
LEAST, MOST = 1.0, 1000.0  # limits of a prior's strength, in pages


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits, or null. ``rules`` is a short list."""
    found = [
        F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in rules
    ]
    return F.greatest(*found, F.lit(None)) if len(found) > 1 else found[0]


def _strength(level: DataFrame) -> DataFrame:
    """One row: the beta prior's strength that explains the spread of this level's rates around their parents'."""
    # for y ~ Binomial(n, p), p ~ Beta(mean m, strength k): var(y / n) = m (1 - m) (1 + (n - 1) / (k + 1)) / n
    m = F.greatest(F.least(F.col("prior"), F.lit(0.999)), F.lit(0.001))
    spread = m * (1 - m)
    seen = F.col("n").cast("double") * F.pow(F.col("bad") / F.col("n") - m, F.lit(2.0))
    found = level.agg(F.sum(seen - spread).alias("extra"), F.sum(spread * (F.col("n") - 1)).alias("room"))
    share = F.col("extra") / F.col("room")
    return found.select(F.when((F.col("room") > 0) & (share > 0), F.greatest(F.least(1 / share - 1, F.lit(MOST)), F.lit(LEAST))).otherwise(F.lit(MOST)).alias("k"))


def _posterior(level: DataFrame) -> DataFrame:
    """Adds a, b: the beta posterior given ``prior`` (mean) and the level's fitted strength."""
    k = _strength(level.filter("n > 0"))  # one row
    return level.crossJoin(F.broadcast(k)).withColumn("a", F.col("prior") * F.col("k") + F.col("bad")).withColumn("b", (1 - F.col("prior")) * F.col("k") + F.col("n") - F.col("bad")).drop("k")


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """``outcomes`` (host, bad 0/1 or null) -> host, mean, bound: posterior bad rate and its lower bound of every host.

    A host, domain or suffix with null outcomes only has its parent's mean.
    The registered domain is the last two labels of a host, its suffix the last one. Counts cover all outcomes.
    """
    hosts = outcomes.filter("host <> ''").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("prior"))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    up = _posterior(suffixes.crossJoin(F.broadcast(total))).select("suffix", mean.alias("prior"))
    mid = _posterior(domains.join(up, "suffix")).select("domain", mean.alias("prior"))
    low = _posterior(hosts.select("host", "domain", "n", "bad").join(mid, "domain"))
    sd = F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    return low.select("host", mean.alias("mean"), (mean - Z * sd).alias("bound"))


def url_verdicts(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``outcomes`` (page_id, bad 0/1) are the labelled pages. A url that is null or has no ``://`` has an empty host and
    path, fits no rule and is allowed. Repeated pages each give a row and count their outcome each; a null page_id stays
    null and has no outcome. An empty table of pages gives an empty result; without outcomes only rules block.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    labelled = rows.join(outcomes.select(F.col("page_id").cast("long").alias("page_id"), F.col("bad").cast("long").alias("bad")), "page_id", "left")
    blocked = host_reputation(labelled.select("host", "bad")).filter(F.col("bound") >= threshold).select("host", F.lit("block").alias("learned"))
    fit = longest_rule(F.col("host"), F.col("path"), rules)
    judged = rows.withColumn("fit", fit).join(blocked, "host", "left")
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "learned", F.lit("allow")).alias("verdict"))


def page_outcomes(labels: DataFrame) -> DataFrame:
    """Outcomes from ``labels``, which number pages as they number documents: bad is low quality or toxic."""
    return labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), r AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
), f AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM r
), h AS (
  SELECT host, CAST(count(doc_id) AS DOUBLE) AS n, CAST(sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS bad
  FROM r LEFT JOIN labels ON doc_id = page_id WHERE host <> '' GROUP BY host
), hd AS (
  SELECT *, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, string_split(host, '.')[-1] AS suffix FROM h
), d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hd GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
s1 AS (SELECT *, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM s) AS prior FROM s),
sk AS (SELECT sum(n * pow(bad / n - m, 2) - m * (1 - m)) AS extra, sum(m * (1 - m) * (n - 1)) AS room FROM (SELECT *, greatest(least(prior, 0.999), 0.001) AS m FROM s1 WHERE n > 0)),
s2 AS (SELECT suffix, (prior * k + bad) / (k + n) AS prior FROM s1, (SELECT CASE WHEN room > 0 AND extra / room > 0 THEN greatest(least(room / extra - 1, 1000.0), 1.0) ELSE 1000.0 END AS k FROM sk)),
d1 AS (SELECT d.*, s2.prior FROM d JOIN s2 USING (suffix)),
dk AS (SELECT sum(n * pow(bad / n - m, 2) - m * (1 - m)) AS extra, sum(m * (1 - m) * (n - 1)) AS room FROM (SELECT *, greatest(least(prior, 0.999), 0.001) AS m FROM d1 WHERE n > 0)),
d2 AS (SELECT domain, (prior * k + bad) / (k + n) AS prior FROM d1, (SELECT CASE WHEN room > 0 AND extra / room > 0 THEN greatest(least(room / extra - 1, 1000.0), 1.0) ELSE 1000.0 END AS k FROM dk)),
h1 AS (SELECT hd.*, d2.prior FROM hd JOIN d2 USING (domain)),
hk AS (SELECT sum(n * pow(bad / n - m, 2) - m * (1 - m)) AS extra, sum(m * (1 - m) * (n - 1)) AS room FROM (SELECT *, greatest(least(prior, 0.999), 0.001) AS m FROM h1 WHERE n > 0)),
h2 AS (SELECT host, n, k, (prior * k + bad) / (k + n) AS mean FROM h1, (SELECT CASE WHEN room > 0 AND extra / room > 0 THEN greatest(least(room / extra - 1, 1000.0), 1.0) ELSE 1000.0 END AS k FROM hk)),
b AS (SELECT host FROM h2 WHERE mean - 1.645 * sqrt(mean * (1 - mean) / (k + n + 1)) >= 0.5)
SELECT f.page_id, f.host, f.path, f.rule,
       CASE WHEN f.rule IN ('net/', 'example.com/de/') THEN 'block' WHEN f.rule IS NOT NULL THEN 'allow' WHEN b.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM f LEFT JOIN b USING (host)
"""
