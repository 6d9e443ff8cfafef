"""Operator 4: URL filter by rules and empirical-Bayes host reputation.

Each page that a rule fits is a labelled outcome (block 1, allow 0). Outcomes are counted per host (map-side combined, so a
hot host costs one row per task) and rolled up host -> registered domain (last two labels) -> suffix (last label) -> all.
A level's rate has a beta prior whose mean is the posterior mean of the level above it and whose strength is the
beta-binomial moment estimate over all labelled units of that level. A page without a rule is blocked when the lower posterior
bound of its host's block rate (mean less Z standard deviations) is above BLOCK_AT. A host, domain or suffix without
outcomes simply keeps its prior. The three moment estimates are single-row aggregates; the rest are joins on host, domain and suffix.
Pages meet their host's reputation by broadcast under a bound of bytes, else over salted hosts, so that a hot host is many tasks.

Defined results: a null url or one without "://" has empty host and path, no rule, and the verdict of the prior; very long urls are
read whole; of rules that fit the longest wins, of equally long ones the last by name; an empty table gives an empty table; repeated
rows are outcomes of their own; a null page_id is kept; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import Kept, spread, table

#: Verdict, host and path of each rule.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Z = 1.645
BLOCK_AT = 0.5
#: Bounds of a prior's strength in outcomes, where moments say none or endless.
WEAKEST, STRONGEST = 1.0, 1000.0


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict): the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # longer ones come later and win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _strength(units: DataFrame) -> DataFrame:
    """One row (m, s): pooled rate, and prior strength by the beta-binomial's first two moments over units (n, k)."""
    sums = units.agg(
        F.coalesce(F.sum("k"), F.lit(0)).cast("double").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"),
        F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).cast("double").alias("nn"), F.count(F.lit(1)).alias("u"),
        F.coalesce(F.sum(F.col("k") * F.col("k") / F.col("n")), F.lit(0.0)).alias("kk"))
    m = F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.5)
    between = F.col("kk") - F.col("n") * m * m  # sum n_i (p_i - m)^2
    rho = (between - (F.col("u") - 1) * m * (1 - m)) / ((F.col("n") - F.col("nn") / F.col("n") - (F.col("u") - 1)) * m * (1 - m))
    s = F.when((F.col("u") > 1) & (F.col("n") > F.col("u")) & (m > 0) & (m < 1) & (F.col("n") - F.col("nn") / F.col("n") - (F.col("u") - 1) > 0),
               F.when(rho <= 0, STRONGEST).otherwise(F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), 1 / rho - 1)))).otherwise(WEAKEST)
    return sums.select(m.alias("m"), s.alias("s"))


def reputation(judged: DataFrame) -> DataFrame:
    """(host, posterior, bound): posterior mean block rate and its lower bound for every host of (host, verdict)."""
    hosts = judged.groupBy("host").agg(
        F.count("verdict").alias("n"), F.count(F.when(F.col("verdict") == "block", 1)).alias("k")).select(
        "host", "n", "k", F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0).alias("domain"), F.regexp_extract("host", r"[^.]*$", 0).alias("suffix"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    labelled = F.col("n") > 0
    top, mid, low = (_strength(x.where(labelled)) for x in (suffixes, domains, hosts))

    def post(above: Column) -> Column:
        return (F.col("s") * above + F.col("k")) / (F.col("s") + F.col("n"))

    suffixes = suffixes.join(F.broadcast(top)).select("suffix", post(F.col("m")).alias("p_suffix"))
    domains = domains.join(suffixes, "suffix").join(F.broadcast(mid)).select("domain", post(F.col("p_suffix")).alias("p_domain"))
    hosts = hosts.join(domains, "domain").join(F.broadcast(low)).select("host", post(F.col("p_domain")).alias("posterior"), (F.col("s") + F.col("n")).alias("weight"))
    return hosts.select("host", "posterior", (F.col("posterior") - Z * F.sqrt(F.col("posterior") * (1 - F.col("posterior")) / (F.col("weight") + 1))).alias("bound"))


def url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict): one row per page."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict"))
    known = Kept(reputation(rows), F.octet_length("host") + 64)
    method = F.when(F.col("bound") > BLOCK_AT, "block").otherwise("allow")
    return spread(rows, known.df, known.bytes, "host").select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"))


_STRENGTH = """SELECT CASE WHEN n > 0 THEN k / n ELSE 0.5 END AS m, CASE WHEN u > 1 AND n > u AND k > 0 AND k < n AND n - nn / n - (u - 1) > 0 THEN
  CASE WHEN kk - n * (k / n) * (k / n) - (u - 1) * (k / n) * (1 - k / n) <= 0 THEN 1000.0 ELSE
    greatest(1.0, least(1000.0, ((n - nn / n - (u - 1)) * (k / n) * (1 - k / n)) / (kk - n * (k / n) * (k / n) - (u - 1) * (k / n) * (1 - k / n)) - 1)) END ELSE 1.0 END AS s
  FROM (SELECT coalesce(sum(k), 0)::DOUBLE AS k, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(n * n), 0)::DOUBLE AS nn, count(*) AS u, coalesce(sum(k * k / n::DOUBLE), 0) AS kk FROM {} WHERE n > 0)"""
ORACLE = rf"""
WITH r AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM r),
j AS (SELECT *, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow' END AS v FROM (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM u)),
h AS (SELECT host, regexp_extract(host, '([^.]*\.)?[^.]*$', 0) AS domain, regexp_extract(host, '[^.]*$', 0) AS suffix, count(v) AS n, count(CASE WHEN v = 'block' THEN 1 END) AS k FROM j GROUP BY host),
d AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM d GROUP BY suffix),
st AS ({_STRENGTH.format('s')}), dt AS ({_STRENGTH.format('d')}), ht AS ({_STRENGTH.format('h')}),
sp AS (SELECT suffix, (st.s * st.m + k) / (st.s + n) AS p FROM s, st),
dp AS (SELECT domain, (dt.s * sp.p + k) / (dt.s + n) AS p FROM d JOIN sp USING (suffix), dt),
hp AS (SELECT host, (ht.s * dp.p + k) / (ht.s + n) AS p, ht.s + n AS w FROM h JOIN dp USING (domain), ht)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN p - {Z} * sqrt(p * (1 - p) / (w + 1)) > {BLOCK_AT} THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN hp USING (host)
"""
