"""URL filters: rules, and where none fits, an empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted by host, registered domain and suffix. Each level's share of
bad pages is a beta-binomial posterior whose prior is the level above: its mean is the parent's posterior
mean, its strength comes from all groups of the level by the method of moments. A host is blocked if the
lower posterior bound (mean less z standard deviations) of its share of bad pages exceeds the threshold; a
host without labelled pages is judged by its domain's posterior, and thin evidence is drawn towards it.

Registered domains come from a table of public suffixes where one is given (rules as such lists have them, with
*. for any label and ! for exceptions), else from a short list of second-level labels under country codes.

All of it is DataFrame operations: counts are combined before their shuffle, each level is written once and read
by the next, and pages meet their host's verdict in a join that the engine can split where a host is hot.

Defined results: a null url, or one without ://, has an empty host and path and is judged by the outcomes of
such urls together; rows without page_id are judged but have no outcome; of several labels the worst holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Second-level labels below which names are registered under a country's two letters.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
LEAST_RHO, MOST_RHO = 1e-4, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def plain_name(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")


def listed_levels(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """hosts with domain and suffix by the rules of a table of public suffixes (column suffix); a host that no rule fits has its last label.

    Each host meets the rules by the few names that its labels make, so the table may be of any size.
    """
    rows = hosts.withColumn("_labels", F.split(plain_name(F.col("host")), r"\."))
    n = F.size("_labels")
    tail = lambda k: F.array_join(F.slice("_labels", n - k + 1, k), ".")
    tried = lambda rule, size, exact: F.struct(rule.alias("suffix"), size.alias("size"), F.lit(exact).alias("exact"))
    names = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda k: F.array(tried(tail(k), k, False), tried(F.concat(F.lit("*."), tail(k - 1)), k, False), tried(F.concat(F.lit("!"), tail(k)), k - 1, True))))
    met = rows.select("host", F.inline(names)).join(suffixes.select(F.lower(F.trim("suffix")).alias("suffix")).distinct(), "suffix")
    best = met.groupBy("host").agg(F.max(F.struct("exact", "size")).alias("_best"))
    rows = rows.join(best, "host", "left").withColumn("_size", F.least(n, F.coalesce("_best.size", F.lit(1))))
    numeric = F.col("host").rlike(r"^(.*@)?\d+(\.\d+){3}(:\d*)?$")
    whole = tail(n)
    rows = rows.withColumn("suffix", F.when(numeric, whole).otherwise(tail(F.col("_size")))).withColumn("domain", F.when(numeric, whole).otherwise(tail(F.least(n, F.col("_size") + 1))))
    return rows.drop("_labels", "_best", "_size")


def name_levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user and port."""
    name = plain_name(host)
    labels = F.split(name, r"\.")
    n = F.size(labels)
    last, second = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    wide = (n >= 3) & (F.length(last) == 2) & second.isin(*SECOND_LEVEL)
    numeric = name.rlike(r"^\d+(\.\d+){3}$")
    suffix = F.when(numeric, name).when(wide, F.concat_ws(".", second, last)).otherwise(last)
    take = F.when(wide, 3).otherwise(2)
    domain = F.when(numeric | (n <= take), name).otherwise(F.concat_ws(".", F.slice(labels, n - take + 1, take)))
    return domain, suffix


def posterior(groups: DataFrame, parents: DataFrame, key: str, parent: str) -> DataFrame:
    """key, parent, a and b: the beta posterior of each group's share of bad pages."""
    rows = groups.join(parents.select(F.col(parent), (F.col("a") / (F.col("a") + F.col("b"))).alias("m")), parent)
    n, x, m = F.col("n"), F.col("bad"), F.col("m")
    excess = F.sum((x - n * m) * (x - n * m) - n * m * (1 - m))
    room = F.sum(n * (n - 1) * m * (1 - m))
    rho = F.when(room > 0, excess / room).otherwise(F.lit(LEAST_RHO))
    strength = rows.agg((1 / F.least(F.greatest(rho, F.lit(LEAST_RHO)), F.lit(MOST_RHO)) - 1).alias("strength"))
    rows = rows.crossJoin(F.broadcast(strength))  # one row
    return rows.select(key, parent, (F.col("strength") * m + x).alias("a"), (F.col("strength") * (1 - m) + n - x).alias("b"))


def host_reputations(outcomes: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """outcomes: host, bad (0, 1 or null where unlabelled). host, domain, a and b for every host."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    if suffixes is None:
        domain, suffix = name_levels(F.col("host"))
        hosts = hosts.withColumn("domain", domain).withColumn("suffix", suffix)
    else:
        hosts = listed_levels(hosts, suffixes)
    hosts = written(hosts, "hosts")
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    names = written(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("root", F.lit(0)), "suffixes")
    # One bad and one good page stand for what is known before any label.
    root = names.groupBy("root").agg((F.sum("bad") + 1).alias("a"), (F.sum("n") - F.sum("bad") + 1).alias("b"))
    by_suffix = written(posterior(names, root, "suffix", "root"), "suffix-posteriors")
    by_domain = written(posterior(domains, by_suffix, "domain", "suffix"), "domain-posteriors")
    return posterior(hosts, by_domain, "host", "domain")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]], *, threshold: float = 0.5, z: float = 1.645, suffixes: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    outcomes: page_id, bad. rules: (allow or block, host, path); a rule fits its host and all below it where the
    url's path begins with its own, and the longest fitting one wins (the first of equals). suffixes: public suffixes, if any.
    """
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    labelled = outcomes.groupBy("page_id").agg(F.max("bad").alias("bad")).filter("page_id is not null")
    known = urls.select("page_id", "host").join(labelled, "page_id", "left")
    a, b = F.col("a"), F.col("b")
    mean, spread = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    verdicts = host_reputations(known, suffixes).select("host", (mean - z * spread > threshold).alias("bad_host"))
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule_host, rule_path in reversed(ordered):
        fits = ((F.col("host") == rule_host) | F.col("host").endswith("." + rule_host)) & F.col("path").startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path).otherwise(rule)
        ruled = F.when(fits, verdict).otherwise(ruled)
    joined = urls.join(verdicts, "host", "left")
    method = F.when(F.col("bad_host"), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, method).alias("verdict"))


#: SQL for judge_urls() with op7's rules, outcomes and default parameters.
SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM u
), p AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM s
), o AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), h0 AS (
  SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad,
         regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '') AS name
  FROM p LEFT JOIN o ON p.page_id = o.doc_id GROUP BY host
), h1 AS (
  SELECT *, string_split(name, '.') AS l, regexp_matches(name, '^\d+(\.\d+){3}$') AS num FROM h0
), h2 AS (
  SELECT *, len(l) >= 3 AND length(l[-1]) = 2 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') AS wide FROM h1
), hosts AS (
  SELECT host, n, bad,
         CASE WHEN num OR len(l) <= CASE WHEN wide THEN 3 ELSE 2 END THEN name ELSE array_to_string(l[len(l) - CASE WHEN wide THEN 2 ELSE 1 END:], '.') END AS domain,
         CASE WHEN num THEN name WHEN wide THEN l[-2] || '.' || l[-1] ELSE l[-1] END AS suffix
  FROM h2
), domains AS (
  SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL
), r AS (
  SELECT (sum(bad) + 1) / (sum(n) + 2) AS m FROM suffixes
), s1 AS (
  SELECT *, 1 / least(greatest(CASE WHEN sum(n * (n - 1) * m * (1 - m)) OVER () > 0 THEN sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)) OVER () / sum(n * (n - 1) * m * (1 - m)) OVER () ELSE 1e-4 END, 1e-4), 0.5) - 1 AS k FROM suffixes, r
), s2 AS (
  SELECT suffix, (k * m + bad) / (k + n) AS m FROM s1
), d1 AS (
  SELECT *, 1 / least(greatest(CASE WHEN sum(n * (n - 1) * m * (1 - m)) OVER () > 0 THEN sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)) OVER () / sum(n * (n - 1) * m * (1 - m)) OVER () ELSE 1e-4 END, 1e-4), 0.5) - 1 AS k FROM domains JOIN s2 USING (suffix)
), d2 AS (
  SELECT domain, (k * m + bad) / (k + n) AS m FROM d1
), h3 AS (
  SELECT *, 1 / least(greatest(CASE WHEN sum(n * (n - 1) * m * (1 - m)) OVER () > 0 THEN sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)) OVER () / sum(n * (n - 1) * m * (1 - m)) OVER () ELSE 1e-4 END, 1e-4), 0.5) - 1 AS k FROM hosts JOIN d2 USING (domain)
), h4 AS (
  SELECT host, k * m + bad AS a, k * (1 - m) + n - bad AS b FROM h3
), v AS (
  SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 AS bad_host FROM h4
), x AS (
  SELECT p.*, bad_host, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p LEFT JOIN v USING (host)
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bad_host THEN 'block' ELSE 'allow' END AS verdict
FROM x
"""
