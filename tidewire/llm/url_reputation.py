"""URL filters by empirical-Bayes host reputation, with rules in front.

A page that holds a labelled document has an outcome: good unless its quality is 0 or it is toxic. Outcomes are
counted per host; the share of good pages is shrunk from level to level through beta-binomial
priors: a suffix towards all pages, a registered domain towards its suffix, a host towards its
domain. The strength of each level's prior is estimated from how much more the counts of that
level vary around their prior means than binomial counts would. A host is allowed when the
lower bound of its posterior share reaches a limit. Everything is DataFrame and SQL functions;
the only joins are by page id and by host, with counts aggregated before the shuffle.

Rules come first: a rule has a host and a path, fits that host and its subdomains where the path
of the url starts with the rule's, and of several fitting rules the longest wins (block, if two are
as long). For reputations a host loses its user and port; its suffix is the longest of a given list
that ends it (else its last label), its registered domain one label more. An address in numbers is a
domain of its own, and all such addresses share one suffix.

Defined results: a url that is null or has no `://` has an empty host and path, which count as a
host of their own; labels that are null on both counts say nothing; several labels of one page
make it bad if one does; rows that repeat a page_id are judged each and count each; without any
outcome no host is blocked; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.session import staged

LIMIT = 0.5
#: Standard deviations below the posterior mean: a one-sided bound of 95 %.
DEVIATIONS = 1.645
#: Suffixes of several labels under which unrelated owners register; a user passes a longer list.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "github.io", "gov.uk", "org.au", "org.uk")


class Rule(NamedTuple):
    verdict: str
    text: str  # host and path, as in example.org/es/

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def _strength(level: str) -> str:
    """Prior strength of a level from the excess of squared deviations over binomial ones; between 1 and 10,000."""
    return f"""(select 1 / greatest(1e0 / 10001, least(0.5e0, coalesce(
      sum((k - n * prior) * (k - n * prior) - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0.5e0))) - 1 from {level} where n > 0)"""


def reputation_sql(suffixes: tuple[str, ...] = SUFFIXES) -> str:
    """Posterior mean and bound of every row of a table `hosts` (host, n, k); the same text runs in other SQL engines."""
    # the leftmost match is the longest suffix
    ends = "|".join([x.replace(".", "[.]") for x in suffixes] + ["[^.]*"])
    return f"""
with plain as (
  select host, n, k, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as name from hosts
), marked as (
  select *, case when substr(name, 1, 1) = '[' then name else regexp_extract(name, '^[0-9]+([.][0-9]+){{3}}$', 0) end as address from plain
), named as (
  select host, n, k, case when address <> '' then address else regexp_extract(name, '([^.]*[.])?({ends})$', 0) end as domain,
    case when address <> '' then '[address]' else regexp_extract(name, '(^|[.])({ends})$', 2) end as suffix
  from marked
), suffixes as (
  select suffix, sum(n) as n, sum(k) as k, max(p) as prior
  from named, (select (sum(k) + 1e0) / (sum(n) + 2e0) as p from named) as everything group by suffix
), suffix_means as (
  select suffix, (k + m * prior) / (n + m) as mean from (select *, {_strength("suffixes")} as m from suffixes) as s
), domains as (
  select domain, sum(n) as n, sum(k) as k, max(mean) as prior from named join suffix_means using (suffix) group by domain
), domain_means as (
  select domain, (k + m * prior) / (n + m) as mean from (select *, {_strength("domains")} as m from domains) as d
), host_priors as (
  select host, n, k, mean as prior from named join domain_means using (domain)
), posteriors as (
  select host, n, (k + m * prior) / (n + m) as mean, n + m as weight from (select *, {_strength("host_priors")} as m from host_priors) as h
)
select host, mean, mean - {DEVIATIONS}e0 * sqrt(mean * (1 - mean) / (weight + 1)) as bound, (select sum(n) from named) as outcomes from posteriors
"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    known = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    rest = F.when(known, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def winning_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct of the winning rule's text and verdict, or null. For a list that a person writes: one test per rule."""
    out = F
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = out.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict")))
    return out if rules else F.lit(None).cast("struct<rule:string,verdict:string>")


def outcomes(labels: DataFrame) -> DataFrame:
    """One row per labelled page: good 1 or 0."""
    good = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 0).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 1)
    return labels.select(F.col("doc_id").cast("long").alias("page_id"), good.alias("good")).where("good is not null and page_id is not null").groupBy("page_id").agg(F.min("good").alias("good"))


def reputations(pages: DataFrame, labels: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """host, mean, bound and the number of all outcomes, for every host of pages(document, host)."""
    counted = pages.select(F.col("document").alias("page_id"), "host").join(outcomes(labels), "page_id", "left").groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    return pages.sparkSession.sql(reputation_sql(suffixes).replace("{", "{{").replace("}", "}}").replace(" from hosts", " from {hosts}"), hosts=staged(counted, "hosts"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule], limit: float = LIMIT, document: Column | None = None, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's posterior mean and bound, for every row of pages(page_id, url).

    `document`: id of the labelled document that a page holds, from the columns of pages; its page_id unless given.
    """
    document = (F.col("page_id") if document is None else document).cast("long")
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), document.alias("document"), host.alias("host"), path.alias("path"))
    known = reputations(rows, labels, suffixes)
    ruled = rows.withColumn("ruled", winning_rule(F.col("host"), F.col("path"), rules))
    own = F.when((F.col("outcomes") == 0) | (F.col("bound") >= limit), "allow").otherwise("block")
    return ruled.join(known, "host").select(
        "page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", own).alias("verdict"), "mean", "bound"
    )
