"""URL filter: empirical-Bayes reputation of hosts, with explicit rules taking precedence.

Labelled outcomes (good or bad pages) are counted per host, registered
domain and suffix. Each level's success rate gets a beta prior centred on
its parent's posterior mean; the prior's strength is fitted per level by the
method of moments (variance between children beyond the sampling variance).
A host is blocked when the lower posterior bound of its good rate is below a
threshold; a host without labels stands on its domain's posterior, a domain
without labels on its suffix's, a suffix without labels on the global rate.

For the hierarchy alone, user names, ports and a last dot are stripped from the
host; the suffix is the longest of the table ``suffixes`` that the host ends
with, else its last label, and the domain has one label more. An IP address is
its own domain, and all of them share a suffix of their own.

Null urls and urls without ``://`` have an empty host and path; they take
the verdict of the empty host. Repeated pages return once per row; a page's
outcome counts once for a host, however often page and outcome are repeated,
and contradicting outcomes count as one each. Of rules equally long the last
in code-point order wins. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# (verdict, host, path): fixed values of the query's contract.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]

THRESHOLD = 0.5      # least acceptable lower bound of the good rate
Z = 1.645            # one-sided 95 % bound (normal form of the beta posterior)
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0

# Second-level names under which the public registers domains, by country: the default table of suffixes.
SECOND_LEVEL = {
    "ae": "ac co gov net org sch",
    "ar": "com edu gob net org",
    "at": "ac co com gv or",
    "au": "asn com edu gov id net org",
    "bd": "ac com edu gov info mil net org",
    "bh": "com edu gov net org",
    "bo": "com edu gov net org",
    "br": "art blog com eco edu emp eng gov ind jus leg med mil net org tur",
    "cn": "ac com edu gov net org",
    "co": "com edu gov mil net nom org",
    "cy": "com edu gov net org",
    "do": "com edu gov net org",
    "ec": "com edu gov net org",
    "eg": "com edu gov net org",
    "es": "com edu gob net org",
    "gh": "com edu gov net org",
    "gr": "com edu gov net org",
    "gt": "com edu gov net org",
    "hk": "com edu gov idv net org",
    "id": "ac co desa go my net or sch web",
    "il": "ac co gov k12 muni net org",
    "in": "ac co edu firm gen gov ind net nic org res",
    "ir": "ac co gov net org",
    "jp": "ac ad co ed go gr lg ne or",
    "ke": "ac co go me ne or sc",
    "kr": "ac co go ne or pe re",
    "kw": "com edu gov net org",
    "lb": "com edu gov net org",
    "lk": "com edu gov net org",
    "ma": "ac co gov net org",
    "mt": "com edu gov net org",
    "mx": "com edu gob net org",
    "my": "com edu gov net org",
    "ng": "com edu gov net org",
    "ni": "com edu gov net org",
    "np": "com edu gov net org",
    "nz": "ac co geek gen govt iwi kiwi maori net org school",
    "om": "com edu gov net org",
    "pa": "com edu gov net org",
    "pe": "com edu gob net org",
    "ph": "com edu gov net org",
    "pk": "ac com edu gov net org",
    "pl": "com edu gov info net org",
    "pt": "com edu gov net org",
    "py": "com edu gov net org",
    "qa": "com edu gov net org",
    "sa": "com edu gov net org",
    "sg": "com edu gov net org per",
    "sv": "com edu gov net org",
    "th": "ac co go in mi net or",
    "tr": "av bel biz com edu gen gov info k12 net org pol tel web",
    "tw": "com edu gov idv net org",
    "tz": "ac co go ne or",
    "ua": "com edu gov in net org",
    "ug": "ac co go ne or",
    "uk": "ac co gov ltd me net nhs org plc police sch",
    "uy": "com edu gov net org",
    "ve": "com edu gov net org",
    "vn": "com edu gov net org",
    "za": "ac co edu gov law net nom org web",
}
SUFFIXES = tuple(sorted(f"{name}.{country}" for country, names in SECOND_LEVEL.items() for name in names.split()))
ADDRESSES = "[ip]"   # the suffix of IP addresses; no host ends so


def host_of(url) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def hierarchy(host: Column, suffixes: Iterable[str] = SUFFIXES) -> tuple[Column, Column]:
    """The registered domain and the suffix of a host."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"\.$", "")
    address = bare.rlike(r"^([0-9]+\.){3}[0-9]+$|^\[")
    domain, suffix = F.substring_index(bare, ".", -2), F.substring_index(bare, ".", -1)
    suffixes = set(suffixes)
    for n in sorted({s.count(".") + 1 for s in suffixes}):       # the longest comes last and decides
        end = F.substring_index(bare, ".", -n)
        listed = end.isin([s for s in suffixes if s.count(".") + 1 == n])
        domain = F.when(listed, F.substring_index(bare, ".", -n - 1)).otherwise(domain)
        suffix = F.when(listed, end).otherwise(suffix)
    return F.when(address, bare).otherwise(domain), F.when(address, F.lit(ADDRESSES)).otherwise(suffix)


def _match(rules, value: str) -> Column:
    """The ``value`` ("rule" or "verdict") of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.lit(host + path if value == "rule" else verdict)).otherwise(out)
    return out


def _strength(level: DataFrame) -> DataFrame:
    """One row: prior strength of a level from (good, n, parent mean) of its members."""
    p = F.col("good") / F.col("n")
    m = F.col("parent_mean")
    return level.agg(
        F.sum(F.col("n") * m * (1 - m)).alias("sampling"),
        F.sum(F.col("n") * (p - m) * (p - m) * F.col("n")).alias("spread"),
        F.sum(F.col("n") * (F.col("n") - 1) * m * (1 - m)).alias("room"),
    ).select(F.when((F.col("spread") - F.col("sampling")) * MAX_STRENGTH > F.col("room"),
                    F.greatest(F.lit(MIN_STRENGTH), F.col("room") / (F.col("spread") - F.col("sampling")) - 1))
             .otherwise(F.lit(MAX_STRENGTH)).alias("k"))


def _posterior(children: DataFrame, key: str, parents: DataFrame | None, parent_key: str | None) -> DataFrame:
    """Posterior mean of each child from its parent's mean and the level's fitted strength."""
    if parents is not None:
        children = children.join(parents.select(parent_key, F.col("mean").alias("parent_mean")), parent_key)
    k = _strength(children.filter("n > 0"))
    # one row: always small
    return (children.crossJoin(F.broadcast(k))
            .withColumn("a", F.col("good") + F.col("k") * F.col("parent_mean"))
            .withColumn("b", F.col("n") - F.col("good") + F.col("k") * (1 - F.col("parent_mean")))
            .withColumn("mean", F.col("a") / (F.col("a") + F.col("b"))))


def reputation(pages: DataFrame, outcomes: DataFrame, threshold: float = THRESHOLD, z: float = Z,
               suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """``pages (page_id, host)`` and ``outcomes (page_id, good 0/1)`` -> one row per host with its bound and verdict.

    Without any outcome the global rate is taken as 1 (nothing speaks against a host).
    """
    found = outcomes.filter("good is not null").select("page_id", "good").distinct()
    labelled = pages.select("page_id", "host").distinct().join(found, "page_id", "left")
    hosts = labelled.groupBy("host").agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.count("good").alias("n"))
    domain, suffix = hierarchy(F.col("host"), suffixes)
    # written: every level of the hierarchy reads it
    hosts = cut_lineage(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "url-hosts")
    total = hosts.agg(F.coalesce(F.sum("good") / F.nullif(F.sum("n"), F.lit(0)), F.lit(1.0)).alias("parent_mean"))
    counts = lambda *by: hosts.groupBy(*by).agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    tops = _posterior(counts("suffix").crossJoin(F.broadcast(total)), "suffix", None, None)
    domains = _posterior(counts("domain", "suffix"), "domain", tops, "suffix")
    judged = _posterior(hosts.drop("suffix"), "host", domains, "domain")
    a, b = F.col("a"), F.col("b")
    bound = F.col("mean") - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return judged.select("host", "n", "mean", bound.alias("bound")).withColumn(
        "verdict", F.when(F.col("bound") >= threshold, "allow").otherwise("block"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold: float = THRESHOLD,
                suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """One row per page: page_id, host, path, the rule that decided (or null) and the verdict."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = reputation(parsed, outcomes, threshold, suffixes=suffixes).select("host", F.col("verdict").alias("by_reputation"))
    return parsed.join(judged, "host", "left").select(
        "page_id", "host", "path", _match(rules, "rule").alias("rule"),
        F.coalesce(_match(rules, "verdict"), "by_reputation").alias("verdict"))


def oracle() -> str:
    """The same judgement in DuckDB SQL over ``pages`` and ``labels``."""
    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))

    def case(value):
        whens = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') "
                         f"THEN '{h + p if value == 'rule' else v}'" for v, h, p in order)
        return f"CASE {whens} ELSE NULL END"

    def level(name, source, keys, parent):
        return f"""
{name}_in AS ({source}),
{name}_k AS (
  SELECT CASE WHEN (spread - sampling) * {MAX_STRENGTH} > room
              THEN greatest({MIN_STRENGTH}, room / (spread - sampling) - 1) ELSE {MAX_STRENGTH} END AS k
  FROM (SELECT sum(n * m * (1 - m)) AS sampling,
               sum(n * (CAST(good AS DOUBLE) / n - m) * (CAST(good AS DOUBLE) / n - m) * n) AS spread,
               sum(n * (n - 1) * m * (1 - m)) AS room
        FROM {name}_in WHERE n > 0)),
{name} AS (SELECT *, a / (a + b) AS mean FROM (
  SELECT {keys}, good + k * m AS a, n - good + k * (1 - m) AS b FROM {name}_in, {name}_k))"""

    levels = ",".join([
        level("suffixes", "SELECT suffix, sum(good) AS good, sum(n) AS n, any_value(rate) AS m FROM hosts, total GROUP BY 1",
              "suffix", None),
        level("domains", "SELECT h.domain, sum(h.good) AS good, sum(h.n) AS n, any_value(s.mean) AS m "
              "FROM hosts h JOIN suffixes s USING (suffix) GROUP BY 1", "domain", None),
        level("judged", "SELECT h.host, h.good, h.n, d.mean AS m FROM hosts h JOIN domains d USING (domain)",
              "host", None)])
    listed = ", ".join(f"'{x}'" for x in SUFFIXES)          # all of two labels
    return f"""
WITH parsed AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
counted AS (
  SELECT host, coalesce(sum(quality), 0) AS good, count(quality) AS n
  FROM (SELECT DISTINCT page_id, host FROM parsed)
  LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels WHERE quality IS NOT NULL) ON page_id = doc_id GROUP BY 1),
bare AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.$', '') AS b FROM counted),
cut AS (
  SELECT *, string_split(b, '.') AS labels, regexp_matches(b, '^([0-9]+\\.){{3}}[0-9]+$|^\\[') AS is_address,
         array_to_string(string_split(b, '.')[-2:], '.') AS last_two FROM bare),
hosts AS (
  SELECT host, good, n,
         CASE WHEN is_address THEN b WHEN last_two IN ({listed}) THEN array_to_string(labels[-3:], '.') ELSE last_two END AS domain,
         CASE WHEN is_address THEN '{ADDRESSES}' WHEN last_two IN ({listed}) THEN last_two ELSE labels[-1] END AS suffix FROM cut),
total AS (SELECT coalesce(CAST(sum(good) AS DOUBLE) / nullif(sum(n), 0), 1.0) AS rate FROM hosts),
{levels}
SELECT page_id, p.host, path, {case('rule').replace('host', 'p.host')} AS rule,
       coalesce({case('verdict').replace('host', 'p.host')},
                CASE WHEN mean - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) >= {THRESHOLD}
                     THEN 'allow' ELSE 'block' END) AS verdict
FROM parsed p JOIN judged USING (host)"""
