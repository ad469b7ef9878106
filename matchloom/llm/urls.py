"""URL filters: rules first, then the reputation of the host by empirical Bayes.

A page whose url a rule fits gets the rule's verdict. The other pages are judged
by their host. Labelled page outcomes (good or bad) are counted for each host,
registered domain and suffix; a beta-binomial prior at each level is centred on
the level above, and its strength is estimated from how much more the outcomes
of the level's units spread than binomial counts would. A host is allowed if the
lower bound of its posterior, mean less ``Z`` standard deviations, reaches
``THRESHOLD``.

Counting combines within each task first, and the table of hosts is broadcast
only below ``BROADCAST_HOSTS`` rows; beyond, the join is salted, so that a host
that has a third of all pages is no single task.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule and is judged like other pages of an empty host. Null outcomes do
not count. Of two rules that are equally long and fit, the one that sorts first
holds. Urls of any length are read whole. Repeated pages get one row each;
columns that are added replace those of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.session import staged

Z = 1.0
THRESHOLD = 0.5
BROADCAST_HOSTS = 500_000
SALTS = 32
#: Suffixes of two labels under which domains are registered.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "com.cn", "co.in", "co.za")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of its text and verdict, or null."""
    chain = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        chain = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(chain)
    return chain


def bare(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")


def suffix_of(host: Column) -> Column:
    """The public suffix: the last label, or two of a known pair; an address is its own suffix."""
    name = bare(host)
    two = F.regexp_extract(name, r"([^.]*\.[^.]*)$", 1)
    return F.when(name.rlike(r"^[0-9.]+$|^\["), name).when(two.isin(*LONG_SUFFIXES), two).otherwise(F.regexp_extract(name, r"([^.]*)$", 1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and the label before it."""
    name = bare(host)
    two, three = F.regexp_extract(name, r"([^.]*\.[^.]*)$", 1), F.regexp_extract(name, r"([^.]*\.[^.]*\.[^.]*)$", 1)
    plain = F.when(two == "", name).otherwise(two)
    return F.when(name.rlike(r"^[0-9.]+$|^\["), name).when(two.isin(*LONG_SUFFIXES), F.when(three == "", two).otherwise(three)).otherwise(plain)


def strength(units: DataFrame, good: str, n: str, mean: str) -> Column:
    """The prior's strength by moments, from units with a prior mean: the intra-class correlation rho gives 1 / rho - 1."""
    spread = F.sum((F.col(good) - F.col(n) * F.col(mean)) * (F.col(good) - F.col(n) * F.col(mean)) - F.col(n) * F.col(mean) * (1 - F.col(mean)))
    room = F.sum(F.col(n) * (F.col(n) - 1) * F.col(mean) * (1 - F.col(mean)))
    rho = F.greatest(F.lit(0.001), F.least(F.lit(0.5), F.coalesce(F.try_divide(spread, room), F.lit(0.5))))
    return (1 / rho - 1).alias("strength")


def reputation(outcomes: DataFrame, host: str = "host", outcome: str = "outcome") -> DataFrame:
    """(host, n, good, posterior_mean, posterior_sd) of each host in ``outcomes``, whose outcome is 1, 0 or null."""
    hosts = outcomes.groupBy(F.col(host).alias("host")).agg(F.count(outcome).alias("n"), F.coalesce(F.sum(outcome), F.lit(0)).cast("long").alias("good"))
    # read by every level, so it is a table
    hosts = staged(hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "good"), "url-hosts")
    total = hosts.agg(((F.sum("good") + 1.0) / (F.sum("n") + 2.0)).alias("mean"))

    def level(names: list[str], above: DataFrame, by: list[str]) -> DataFrame:
        """The units of a level with their posterior means, given those of the level above as ``mean``."""
        units = hosts.groupBy(*names).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        units = units.join(above, by) if by else units.crossJoin(F.broadcast(above))  # one row
        prior = units.agg(strength(units, "good", "n", "mean"))
        units = units.crossJoin(F.broadcast(prior))  # one row
        alpha, beta = F.col("good") + F.col("strength") * F.col("mean"), F.col("n") - F.col("good") + F.col("strength") * (1 - F.col("mean"))
        return units.select(*names, "n", "good", (alpha / (alpha + beta)).alias("posterior_mean"), F.sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))).alias("posterior_sd"))

    suffixes = level(["suffix"], total, [])
    domains = level(["suffix", "domain"], suffixes.select("suffix", F.col("posterior_mean").alias("mean")), ["suffix"])
    return level(["suffix", "domain", "host"], domains.select("suffix", "domain", F.col("posterior_mean").alias("mean")), ["suffix", "domain"]).drop("suffix", "domain")


def judged(pages: DataFrame, rules: list[Rule], url: str = "url", outcome: Column | None = None, z: float = Z, threshold: float = THRESHOLD, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the lower bound ``reputation``.

    ``outcome`` labels a page good (1), bad (0) or not at all (null); without
    it, the rules' own verdicts are the labelled outcomes.
    """
    added = ("host", "path", "rule", "verdict", "reputation")
    label = outcome if outcome is not None else None
    base = pages.withColumn("__outcome", label) if label is not None else pages
    base = base.withColumn("__host", host_of(F.col(url))).withColumn("__path", path_of(F.col(url)))
    base = base.select(*(c for c in base.columns if c.lower() not in added)).withColumn("__fit", fitting(F.col("__host"), F.col("__path"), rules))
    if label is None:
        base = base.withColumn("__outcome", F.when(F.col("__fit.verdict") == "allow", 1).when(F.col("__fit.verdict") == "block", 0))
    hosts = reputation(base.select(F.col("__host").alias("host"), F.col("__outcome").alias("outcome")))
    hosts = staged(hosts.select(F.col("host").alias("__host"), (F.col("posterior_mean") - z * F.col("posterior_sd")).alias("reputation")), "url-reputation")
    if hosts.count() <= broadcast_hosts:
        joined = base.join(F.broadcast(hosts), "__host")
    else:
        salted = hosts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = base.withColumn("__salt", F.pmod(F.xxhash64(F.col(url), F.rand(7)), F.lit(SALTS)).cast("int")).join(salted, ["__host", "__salt"]).drop("__salt")
    verdict = F.coalesce("__fit.verdict", F.when(F.round("reputation", 9) >= threshold, "allow").otherwise("block"))
    found = joined.withColumn("host", F.col("__host")).withColumn("path", F.col("__path")).withColumn("rule", F.col("__fit.rule")).withColumn("verdict", verdict)
    keep = [c for c in pages.columns if c.lower() not in added]
    return found.select(*keep, *added)
