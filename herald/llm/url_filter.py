"""URL filters: given rules first, else the reputation of the host by empirical Bayes.

Every level of a host name has a beta prior on its rate of bad pages: a host's
prior comes from its registered domain, a domain's from its suffix, a suffix's
from all labelled pages. A group of ``n`` labelled pages, ``k`` of them bad,
whose parent has rate ``p``, gets the rate ``(k + m * p) / (n + m)``. The
strength ``m`` of a level is that of the beta-binomial whose variance its
groups show: their squared distance from ``n * p`` estimates the correlation
``rho`` of two pages of one group, and ``m = 1 / rho - 1``. The variance of a
group's rate is that of its beta and, as far as the prior counts, that of its
parent's rate, so one bad host makes no new domain of its suffix a bad one. A
host is blocked if even the lower bound of its posterior, ``z`` standard
deviations below its mean, is above the limit.

Groups are pre-aggregated by host, so no shuffle sees a row of a page but the
join with the table of hosts, which has a row for each host; a very common host
is split there by AQE. All of it is DataFrame expressions.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herald.llm._common import materialize

#: The list of rules, (action, host and start of the path).
RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]
#: Public suffixes of two labels that are in common use; of other names the suffix is the last label.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.in", "co.jp", "co.kr", "co.nz", "co.za", "com.br", "com.cn",
    "com.mx", "com.tr",
)
#: Pseudo-counts (bad, good) of the rate of all labelled pages.
START = (1.0, 4.0)
#: The correlation of pages of a group is held between these.
RHO = (1e-4, 0.5)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty for a null one and one without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def registered_domain(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host name; a name of one label and an address are their own."""
    name = F.regexp_replace(host, r"^[^@]*@|:[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    long = two.isin(*SUFFIXES)
    alone = name.rlike(r"^[0-9]+(\.[0-9]+){3}$") | ~name.contains(".")
    suffix = F.when(alone, name).when(long, two).otherwise(F.substring_index(name, ".", -1))
    return F.when(alone, name).when(long, F.substring_index(name, ".", -3)).otherwise(two), suffix


def _strength(groups: DataFrame) -> float:
    """Pseudo-counts of the prior of a level: ``groups`` has n, k and the parent's rate p."""
    n, k, p = (F.col(c).cast("double") for c in ("n", "k", "p"))
    spread = F.sum((k - n * p) ** 2 - n * p * (1 - p))
    row = groups.agg(spread.alias("s"), F.sum(n * (n - 1) * p * (1 - p)).alias("pairs")).first()
    rho = row["s"] / row["pairs"] if row["pairs"] else 0.0
    return 1 / min(max(rho, RHO[0]), RHO[1]) - 1


def _posterior(groups: DataFrame) -> list[Column]:
    """Rate p and variance v of groups, from n, k and the parent's p and v."""
    m = F.lit(_strength(groups))
    n, p = F.col("n"), (F.col("k") + m * F.col("p")) / (F.col("n") + m)
    share = m / (n + m)
    return [p.alias("p"), (p * (1 - p) / (n + m + 1) + share * share * F.col("v")).alias("v")]


def host_reputation(urls: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, n, k, rate, bound) for each host of ``urls`` (page_id, host).

    ``outcomes`` has page_id and the boolean ``bad``. Outcomes that are null,
    or of a null or unknown page, are not counted; repeated rows count each.
    Hosts without outcomes get what their domain or suffix says; without any
    outcome at all every host gets the starting rate. The empty host is a
    host. An empty table gives an empty result.
    """
    known = outcomes.filter("bad is not null").select(F.col("page_id").alias("__id"), F.col("bad").cast("long").alias("__bad"))
    labelled = urls.join(known, F.col("page_id") == F.col("__id")).groupBy("host").agg(
        F.count("*").alias("n"), F.sum("__bad").alias("k"))
    domain, suffix = registered_domain(F.col("host"))
    hosts = urls.select("host").distinct().join(labelled, "host", "left")
    hosts = materialize(hosts.select(
        "host", domain.alias("domain"), suffix.alias("suffix"), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in "nk"]))
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    total = hosts.agg(*sums).first()
    rate = ((total["k"] or 0) + START[0]) / ((total["n"] or 0) + sum(START))
    start = rate * (1 - rate) / ((total["n"] or 0) + sum(START) + 1)
    suffixes = hosts.groupBy("suffix").agg(*sums).withColumns({"p": F.lit(rate), "v": F.lit(start)})
    suffixes = suffixes.select("suffix", *_posterior(suffixes))
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes, "suffix")
    domains = domains.select("domain", "suffix", *_posterior(domains))
    of = materialize(hosts.join(domains, ["domain", "suffix"]).select("host", "n", "k", "p", "v"))
    out = of.select("host", "n", "k", *_posterior(of))
    return out.select("host", "n", "k", F.col("p").alias("rate"), (F.col("p") - z * F.sqrt("v")).alias("bound"))


def fitting_rules(hosts: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(host, rules) of the hosts that some rule fits: (rule, action, path) of each, the longest first.

    A host meets the rules of itself and of all domains above it by a join on
    their names. A rule without a slash fits every path. Rules of equal length
    are in the order of their hosts' lengths, longest first.
    """
    spark = hosts.sparkSession
    rows = [(r.partition("/")[0].lower(), "/" + r.partition("/")[2] if "/" in r else "", r, a) for a, r in dict.fromkeys(rules)]
    table = spark.createDataFrame(rows, "above string, path string, rule string, action string")
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = hosts.select("host", F.explode(above).alias("above")).join(table, "above")
    key = F.struct((-F.length("rule")).alias("a"), (-F.length("above")).alias("b"), "rule", "action", "path")
    return met.groupBy("host").agg(F.sort_array(F.collect_list(key)).alias("rules"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, limit: float = 0.5, z: float = 1.645,
    page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """One row (page_id, host, path, rule, verdict, n_labelled, bound) for each row of ``pages``.

    ``verdict`` is the action of the longest rule that fits, else ``block`` if
    the lower bound of the host's rate of bad pages is above ``limit``, else
    ``allow``. Null URLs and those without ``://`` have an empty host and path,
    which no rule fits. Very long URLs are treated like others. Repeated rows
    are judged each. Other columns of ``pages`` are not read. An empty table
    gives an empty result.
    """
    host, path = host_and_path(F.col(url))
    urls = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    known = host_reputation(urls.select("page_id", "host"), outcomes, z)
    known = materialize(known.join(fitting_rules(known.select("host"), rules), "host", "left"))
    found = urls.join(known.withColumnRenamed("host", "__host"), F.col("host") == F.col("__host"))
    rule = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    found = found.withColumn("__rule", rule)
    verdict = F.coalesce(F.col("__rule.action"), F.when(F.col("bound") > limit, F.lit("block")).otherwise(F.lit("allow")))
    return found.select(
        "page_id", "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), F.col("n").alias("n_labelled"),
        F.round("bound", 6).alias("bound"))


def keep_allowed(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, limit: float = 0.5, z: float = 1.645
) -> DataFrame:
    """The rows of ``pages`` (page_id, url, others) whose verdict is ``allow``, all columns as they were.

    The verdict of a row is a function of its URL, so equal URLs go together.
    """
    judged = judge(pages, outcomes, rules, limit, z)
    blocked = judged.filter("verdict = 'block'").select(F.col("host").alias("__h"), F.col("path").alias("__p")).distinct()
    host, path = host_and_path(F.col("url"))
    return pages.join(blocked, (host == F.col("__h")) & (path == F.col("__p")), "left_anti")


def outcomes_of_labels(labels: DataFrame) -> DataFrame:
    """Outcomes (page_id, bad): a page whose id has a label is bad if its quality is 0; a null quality is no outcome."""
    return labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))


def sql(rules: Sequence[tuple[str, str]] = RULES, limit: float = 0.5, z: float = 1.645) -> str:
    """SQL for :func:`judge` over ``pages`` and the outcomes of ``labels``."""
    two = ", ".join(f"'{s}'" for s in SUFFIXES)
    table = ", ".join(f"('{a}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for a, r in rules)
    rho = "least(greatest(CASE WHEN sum(n * (n - 1) * p * (1 - p)) > 0 THEN sum(power(k - n * p, 2) - n * p * (1 - p)) / sum(n * (n - 1) * p * (1 - p)) ELSE 0 END, {0}), {1})".format(*RHO)

    def level(name: str, keys: str) -> str:
        return f"""{name}1 AS (SELECT 1 / {rho} - 1 AS m FROM {name}),
{name}2 AS (
  SELECT {keys}, q AS p, q * (1 - q) / (n + m + 1) + power(m / (n + m), 2) * v AS v
  FROM (SELECT *, (k + m * p) / (n + m) AS q FROM {name}, {name}1))"""

    return rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)),
l AS (
  SELECT host, count(*) AS n, sum((quality = 0)::INT) AS k FROM u JOIN labels ON doc_id = page_id WHERE quality IS NOT NULL GROUP BY 1),
h AS (
  SELECT host, coalesce(n, 0)::DOUBLE AS n, coalesce(k, 0)::DOUBLE AS k, regexp_replace(host, '^[^@]*@|:[0-9]*$', '', 'g') AS name
  FROM (SELECT DISTINCT host FROM u) LEFT JOIN l USING (host)),
parts AS (SELECT *, string_split(name, '.') AS x, regexp_matches(name, '^[0-9]+(\.[0-9]+){{3}}$') OR NOT contains(name, '.') AS alone FROM h),
named AS (
  SELECT host, n, k,
         CASE WHEN alone THEN name WHEN array_to_string(x[-2:], '.') IN ({two}) THEN array_to_string(x[-3:], '.') ELSE array_to_string(x[-2:], '.') END AS domain,
         CASE WHEN alone THEN name WHEN array_to_string(x[-2:], '.') IN ({two}) THEN array_to_string(x[-2:], '.') ELSE x[-1] END AS suffix
  FROM parts),
g AS (
  SELECT p, p * (1 - p) / (n + {sum(START) + 1}) AS v
  FROM (SELECT coalesce(sum(n), 0) AS n, (coalesce(sum(k), 0) + {START[0]}) / (coalesce(sum(n), 0) + {sum(START)}) AS p FROM named)),
s AS (SELECT * FROM (SELECT suffix, sum(n) AS n, sum(k) AS k FROM named GROUP BY 1), g),
{level("s", "suffix")},
d AS (SELECT x.*, p, v FROM (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM named GROUP BY 1, 2) x JOIN s2 USING (suffix)),
{level("d", "domain, suffix")},
o AS (SELECT host, n, k, p, v FROM named JOIN d2 USING (domain, suffix)),
{level("o", "host, n")},
c AS (SELECT host, n, p - {z} * sqrt(v) AS bound FROM o2),
r(action, rule, rule_host, rule_path) AS (VALUES {table}),
f AS (
  SELECT DISTINCT ON (host, path) host, path, rule, action
  FROM (SELECT DISTINCT host, path FROM u) JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  ORDER BY host, path, length(rule) DESC)
SELECT page_id, u.host, u.path, rule, coalesce(action, CASE WHEN bound > {limit} THEN 'block' ELSE 'allow' END) AS verdict,
       n::BIGINT AS n_labelled, round(bound, 6) AS bound
FROM u JOIN c ON u.host = c.host LEFT JOIN f ON u.host = f.host AND u.path = f.path
"""
