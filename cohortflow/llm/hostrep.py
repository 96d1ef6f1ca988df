"""Host reputation by empirical Bayes, and rules that come before it.

Labelled page outcomes are counted per host.  Each level of suffix, registered
domain and host has a beta prior around the posterior mean of the level above:
its concentration comes from the spread between the level's units beyond
binomial noise (moments of the beta-binomial).  A host with few labels is so
drawn to its domain, and that to its suffix.  A page is blocked when even the
upper bound of its host's posterior good rate lies below ``least_good``; hosts of
which nothing bad is known pass.

The bound is that of a normal on the logit scale: log(a / b) +- z * sqrt(1/a + 1/b).

Rules (host, path prefix, verdict) override it: a rule fits its host and all
subdomains when the path starts with the rule's; the longest wins, and of
equally long ones the first given.

Defined results: a null url or one without ``://`` has an empty host and path and
belongs to the host ''; a null outcome is not counted; without any outcome every
good rate is ``NEUTRAL``; repeated rows are judged alike; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import materialize

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
LEAST_GOOD, Z, NEUTRAL = 0.5, 1.645, 0.5
RHO_LOW, RHO_HIGH = 0.001, 0.95  # of the correlation within a unit; concentration is 1 / rho - 1
# Suffixes of two labels under which names are registered, beside the one-label default (fixed values, a parameter).
TWO_LABEL_SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "co.jp", "ne.jp", "or.jp", "com.au", "net.au", "org.au", "com.br", "co.in", "co.kr", "co.nz", "co.za", "com.cn", "com.mx", "com.tr")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both '' if null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def domain_and_suffix(host: Column, two_label=TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host; an address of digits is its own domain, with suffix ''."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    address = name.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$")
    two = F.substring_index(name, ".", -2)
    long = two.isin(*two_label)
    suffix = F.when(long, two).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(long, F.substring_index(name, ".", -3)).otherwise(two)
    return F.when(address, name).otherwise(domain), F.when(address, "").otherwise(suffix)


def _shrink(units: DataFrame, parent: Column) -> DataFrame:
    """Posterior of ``units`` (good, n) around their parents' means: adds a, b, mean.

    One row of sums gives the level's concentration: three numbers on the driver.
    """
    spread = F.when(F.col("n") > 0, F.col("n") * F.pow(F.col("good") / F.col("n") - parent, F.lit(2.0)))
    noise = F.when(F.col("n") > 0, parent * (1 - parent))
    s = units.agg(F.sum(spread).alias("s"), F.sum(noise).alias("e"), F.sum(noise * (F.col("n") - 1)).alias("d")).first()
    rho = min(max((s["s"] - s["e"]) / s["d"], RHO_LOW), RHO_HIGH) if s["d"] else RHO_HIGH
    kappa = 1 / rho - 1
    units = units.withColumns({"a": F.lit(kappa) * parent + F.col("good"), "b": F.lit(kappa) * (1 - parent) + (F.col("n") - F.col("good"))})
    return units.withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))


def host_reputation(hosts: DataFrame, z: float = Z, neutral: float = NEUTRAL) -> DataFrame:
    """``hosts`` (host, good, n; one row per host, n may be 0) with good_rate and upper."""
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    total = hosts.agg(F.sum("good").alias("g"), F.sum("n").alias("n")).first()
    # one label of each outcome is added, so that no mean is 0 or 1
    base = (total["g"] + 1) / (total["n"] + 2) if total["n"] else neutral
    sums = [F.sum("good").alias("good"), F.sum("n").alias("n")]
    suffixes = _shrink(hosts.groupBy("suffix").agg(*sums), F.lit(base)).select("suffix", F.col("mean").alias("above"))
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes, "suffix")
    domains = _shrink(domains, F.col("above")).select("domain", "suffix", F.col("mean").alias("above"))
    out = _shrink(hosts.join(domains, ["domain", "suffix"]), F.col("above"))
    logit = F.log(F.col("a") / F.col("b")) + F.lit(z) * F.sqrt(1 / F.col("a") + 1 / F.col("b"))
    return out.select("host", "n", F.col("mean").alias("good_rate"), (1 / (1 + F.exp(-logit))).alias("upper"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", least_good: float = LEAST_GOOD) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, n_labelled, good_rate, upper.

    ``outcomes`` has (url, good boolean).  Only ids and urls are read; a host's
    pages meet its one row of reputation in a join Spark can split by skew.
    """
    host, path = host_and_path(F.col(url))
    pages = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    good = outcomes.filter(F.col("good").isNotNull()).select(host_and_path(F.col("url"))[0].alias("host"), F.col("good").cast("long").alias("good"))
    counts = good.groupBy("host").agg(F.sum("good").alias("good"), F.count("*").alias("n"))
    hosts = pages.select("host").distinct().join(counts, "host", "full").select(
        "host", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("n", F.lit(0)).alias("n"))
    known = host_reputation(materialize(hosts, "hosts"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("upper") < least_good, "block").otherwise("allow")
    return pages.join(known, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"),
        F.col("n").alias("n_labelled"), "good_rate", "upper")


def _levels(two_label) -> str:
    listed = ", ".join(f"'{s}'" for s in two_label)
    name = r"regexp_replace(host, ':[0-9]*$', '')"
    return rf"""
  named as (select *, {name} as nm, string_split({name}, '.') as p from hosts),
  split as (select *, regexp_matches(nm, '^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$') as addr, array_to_string(p[-2:], '.') in ({listed}) as two from named),
  leveled as (select host, good, n,
      case when addr then nm when two then array_to_string(p[-3:], '.') else array_to_string(p[-2:], '.') end as domain,
      case when addr then '' when two then array_to_string(p[-2:], '.') else p[-1] end as suffix from split),"""


def _posterior(name: str, source: str, keys: str) -> str:
    """SQL of one level: posterior of ``source`` (good, n, above)."""
    return f"""
  {name}_k as (select case when d > 0 then least(greatest((s - e) / d, {RHO_LOW}), {RHO_HIGH}) else {RHO_HIGH} end as rho from (
      select sum(n * power(good / n - above, 2)) filter (n > 0) as s, sum(above * (1 - above)) filter (n > 0) as e,
             sum(above * (1 - above) * (n - 1)) filter (n > 0) as d from {source})),
  {name} as (select {keys}, n, a, b, a / (a + b) as mean from (
      select {keys}, n, (1 / rho - 1) * above + good as a, (1 / rho - 1) * (1 - above) + (n - good) as b from {source}, {name}_k)),"""


def oracle_sql(outcomes: str, rules=RULES) -> str:
    """DuckDB SQL of ``judge_urls`` over pages; ``outcomes`` is SQL giving (url, good)."""
    parts = r"""case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end"""
    host = f"translate(regexp_extract({parts}, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    path = f"regexp_extract({parts}, '^[^/?#]*([^?#]*)', 1)"
    fits = [(h + p, v, f"(u.host = '{h}' or ends_with(u.host, '.{h}')) and starts_with(path, '{p}')") for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))]
    rule = "case " + " ".join(f"when {c} then '{r}'" for r, _, c in fits) + " end"
    verdict = "case " + " ".join(f"when {c} then '{v}'" for _, v, c in fits) + f" when upper < {LEAST_GOOD} then 'block' else 'allow' end"
    return f"""
with u as (select page_id, {host} as host, {path} as path from (select page_id, coalesce(url, '') as url from pages)),
  o as (select {host} as host, good::bigint as good from ({outcomes}) where good is not null),
  hosts as (select h.host, coalesce(c.good, 0)::double as good, coalesce(c.n, 0)::double as n
      from (select host from u union select host from o) h left join (select host, sum(good) as good, count(*) as n from o group by host) c on h.host = c.host),
  {_levels(TWO_LABEL_SUFFIXES)}
  base as (select case when sum(n) > 0 then (sum(good) + 1) / (sum(n) + 2) else {NEUTRAL} end as above from leveled),
  sx as (select suffix, sum(good) as good, sum(n) as n, any_value(above) as above from leveled, base group by suffix),
  {_posterior("sp", "sx", "suffix")}
  dx as (select d.domain, d.suffix, d.good, d.n, sp.mean as above from (select domain, suffix, sum(good) as good, sum(n) as n from leveled group by 1, 2) d join sp on d.suffix = sp.suffix),
  {_posterior("dp", "dx", "domain, suffix")}
  hx as (select l.host, l.good, l.n, dp.mean as above from leveled l join dp on l.domain = dp.domain and l.suffix = dp.suffix),
  {_posterior("hp", "hx", "host")}
  known as (select host, n::bigint as n, mean as good_rate, 1 / (1 + exp(-(ln(a / b) + {Z} * sqrt(1 / a + 1 / b)))) as upper from hp)
select page_id, u.host, path, {rule} as rule, {verdict} as verdict, n as n_labelled,
  round(good_rate, 6) as good_rate, round(upper, 6) as upper
from u join known on u.host = known.host"""
