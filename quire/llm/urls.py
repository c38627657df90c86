"""URL filters: listed rules first, then the reputation of the host.

A host's share of bad pages is shrunk towards that of its registered domain, and that towards its suffix's,
by beta-binomial priors: the fewer pages a host has, the more its domain speaks for it. The verdict looks at
the upper bound of what share of good pages the posterior still allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The rules of the query, as (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pages that the prior of each level is worth, at most.
STRENGTH = 20.0
#: Standard deviations of the posterior bound, and the share of bad pages it must exceed for a block.
Z, LIMIT = 1.64, 0.5


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def registered_domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def public_suffix(host: Column) -> Column:
    """The last label of a host."""
    return F.substring_index(host, ".", -1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does.

    Rules are a parameter of the operator, at most some thousands; equal ones give their first verdict.
    """
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, name, prefix in rules:
        by_host.setdefault(name, []).append((name + prefix, prefix, verdict))
    if not by_host:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    # every domain that the host belongs to is looked up, so the work doesn't grow with the rules of other hosts
    table = F.create_map(
        *[
            x
            for name, own in by_host.items()
            for x in (
                F.lit(name),
                F.array(*[F.struct(F.lit(-len(r)).alias("size"), F.lit(i).alias("ord"), F.lit(r).alias("rule"), F.lit(p).alias("prefix"), F.lit(v).alias("verdict")) for i, (r, p, v) in enumerate(own)]),
            )
        ]
    )
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.call_function("substring_index", host, F.lit("."), -i))
    fits = F.filter(
        F.flatten(F.filter(F.transform(domains, lambda d: F.try_element_at(table, d)), lambda x: x.isNotNull())),
        lambda r: F.startswith(path, r["prefix"]),
    )
    best = F.array_min(fits)
    return best["rule"], best["verdict"]


def page_outcomes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, outcome) of each page: 1 if its text shows it to be bad, 0 if good, null with under 100 letters.

    The label of a page: what stands outside tags is bad if symbols or upper case fill it.
    """
    body = pages.select(
        host_of(F.col(url_col)).alias("host"),
        F.regexp_replace(F.coalesce(html_col, F.lit("")), r"<[^>]*>", " ").alias("body"),
    )
    kinds = body.select(
        "host",
        F.length(F.regexp_replace("body", r"[^A-Za-z]+", "")).alias("letters"),
        F.length(F.regexp_replace("body", r"[^A-Z]+", "")).alias("upper"),
        (F.size(F.split("body", r"[#*$%|!]")) - 1).alias("symbols"),
    )
    bad = (F.lit(20) * F.col("symbols") > F.col("letters")) | (F.lit(2) * F.col("upper") > F.col("letters"))
    return kinds.select("host", F.when(F.col("letters") >= 100, bad.cast("int")).alias("outcome"))


def host_reputation(outcomes: DataFrame, z: float = Z, strength: float = STRENGTH) -> DataFrame:
    """host, n, bad, expected share of bad pages and its lower bound, from (host, outcome) rows.

    Pages are counted by host before anything else moves, so one host with a third of all pages is a row; a
    domain's counts are sums of its hosts'. Each level's posterior mean is the next one's prior, worth at most
    `strength` pages and no more than the level above has. Null outcomes are not counted.
    """
    hosts = outcomes.where("host is not null").groupBy("host").agg(
        F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).cast("long").alias("bad")
    )
    hosts = hosts.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", public_suffix(F.col("host")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("domain_n"), F.sum("bad").alias("domain_bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("domain_n").alias("suffix_n"), F.sum("domain_bad").alias("suffix_bad"))
    everything = suffixes.agg(F.sum("suffix_n").alias("all_n"), F.sum("suffix_bad").alias("all_bad"))

    def shrunk(bad: str, n: str, prior: str, above: str) -> Column:
        weight = F.least(F.lit(strength), F.col(above) + 1.0)
        return (F.col(bad) + weight * F.col(prior)) / (F.col(n) + weight)

    weight = F.least(F.lit(strength), F.col("domain_n") + 1.0)
    total = F.col("n") + weight
    return (
        hosts.join(domains, ["domain", "suffix"])
        .join(suffixes, "suffix")
        .join(F.broadcast(everything))  # one row
        .withColumn("base", (F.col("all_bad") + 1.0) / (F.col("all_n") + 2.0))
        .withColumn("suffix_share", shrunk("suffix_bad", "suffix_n", "base", "all_n"))
        .withColumn("domain_share", shrunk("domain_bad", "domain_n", "suffix_share", "suffix_n"))
        .withColumn("share", shrunk("bad", "n", "domain_share", "domain_n"))
        .withColumn("low", F.col("share") - z * F.sqrt(F.col("share") * (1 - F.col("share")) / (total + 1)))
        .select("host", "n", "bad", "share", "low")
    )


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    limit: float = LIMIT,
) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_share and bad_low (null without a reputation), a row for each page.

    outcomes: (host, outcome), outcome 1 for a bad page, 0 for a good one, null for none. The longest fitting
    rule decides; else a host is blocked whose posterior share of bad pages exceeds limit even at its lower
    bound. A null url, or one without ://, has an empty host and path and is judged as the host "". Hosts join
    by key, which Spark splits where one host holds many pages.
    """
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, listed = matching_rule(F.col("host"), F.col("path"), rules)
    known = host_reputation(outcomes).select(F.col("host").alias("known"), F.col("share").alias("bad_share"), F.col("low").alias("bad_low"))
    return (
        parsed.withColumn("rule", rule)
        .withColumn("listed", listed)
        .join(known, F.col("host") == F.col("known"), "left")
        .withColumn("verdict", F.coalesce("listed", F.when(F.col("bad_low") > limit, "block").otherwise("allow")))
        .select("page_id", "host", "path", "rule", "verdict", "bad_share", "bad_low")
    )


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, page_outcomes(pages), RULES).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
           regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g') AS body
    FROM pages),
o AS (SELECT *, length(regexp_replace(body, '[^A-Za-z]', '', 'g')) AS letters,
        length(regexp_replace(body, '[^A-Z]', '', 'g')) AS uppers,
        length(regexp_replace(body, '[^#*$%|!]', '', 'g')) AS symbols FROM p),
l AS (SELECT *, CASE WHEN letters >= 100 THEN CAST(20 * symbols > letters OR 2 * uppers > letters AS INT) END AS outcome FROM o),
h AS (SELECT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain,
        string_split(host, '.')[-1] AS suffix, count(outcome) AS n, coalesce(sum(outcome), 0) AS bad FROM l GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS dn, sum(bad) AS dbad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(dn) AS sn, sum(dbad) AS sbad FROM d GROUP BY ALL),
a AS (SELECT sum(sn) AS an, (sum(sbad) + 1.0) / (sum(sn) + 2.0) AS base FROM s),
r1 AS (SELECT suffix, sn, (sbad + least(20.0, an + 1.0) * base) / (sn + least(20.0, an + 1.0)) AS sshare FROM s, a),
r2 AS (SELECT domain, suffix, dn, (dbad + least(20.0, sn + 1.0) * sshare) / (dn + least(20.0, sn + 1.0)) AS dshare
       FROM d JOIN r1 USING (suffix)),
r3 AS (SELECT host, n + least(20.0, dn + 1.0) AS total, (bad + least(20.0, dn + 1.0) * dshare) / (n + least(20.0, dn + 1.0)) AS share
       FROM h JOIN r2 USING (domain, suffix)),
r AS (SELECT host, share - 1.64 * sqrt(share * (1 - share) / (total + 1)) AS low FROM r3),
x AS (SELECT l.page_id, l.host, l.path, low,
        CASE WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
             WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
             WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
             WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
             WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
      FROM l LEFT JOIN r USING (host))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN low > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM x
"""
