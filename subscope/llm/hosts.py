"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are counted per host, registered domain
and public suffix. Every level gets a beta-binomial prior: its mean is the
parent's posterior mean (suffixes: the overall rate), its strength follows
from the over-dispersion of the level's counts around their parents' means
(method of moments). So a host with few labels leans on its domain, that on
its suffix, that on the whole. A page is blocked if the upper bound of its
host's posterior (mean plus ``z`` standard deviations) is under
``least_good``; hosts without a label are judged by their parents' prior.

Hand-written rules come first: a rule (action, host, path) fits its host and
all subdomains if the URL's path starts with the rule's; the longest fitting
rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subscope.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Z, LEAST_GOOD = 1.645, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end,
    A-Z lower-cased; path: then up to ``?``, ``#`` or the end. Both empty for
    a null URL or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(raw) + 1), "^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, action) of the longest fitting rule, or null."""
    out = None
    for action, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return F.lit(None).cast("struct<rule:string,action:string>") if out is None else out


def domain_of(host: Column) -> Column:
    """Registered domain: the last two labels (there is no suffix list on the
    box); a host of one label is its own."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _shrunk(units: DataFrame) -> DataFrame:
    """``units``: n, k and the parent's mean ``m``. Adds the posterior
    parameters ``a`` and ``b`` and the posterior ``mean``."""
    v = F.col("m") * (1 - F.col("m"))
    spread = units.agg(
        F.try_divide(F.sum(F.pow(F.col("k") - F.col("n") * F.col("m"), 2)) - F.sum(F.col("n") * v),
                     F.sum(F.col("n") * (F.col("n") - 1) * v)).alias("r"))
    # correlation of two labels of one unit; none measurable: next to nothing
    rho = F.least(F.greatest(F.coalesce(spread.scalar(), F.lit(0.0)), F.lit(1e-4)), F.lit(0.9999))
    strength = 1 / rho - 1
    out = units.select("*", (strength * F.col("m") + F.col("k")).alias("a"),
                       (strength * (1 - F.col("m")) + F.col("n") - F.col("k")).alias("b"))
    return out.withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))


def reputations(outcomes: DataFrame) -> DataFrame:
    """(host, n, k, a, b, mean) of every host in ``outcomes`` (host, good):
    good is true, false or null (page without label)."""
    hosts = outcomes.groupBy("host").agg(
        F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("int")), F.lit(0)).alias("k"))
    # counted once; every level below reads these rows, one per host
    hosts = stored(hosts.select("*", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix")),
                   "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    overall = suffixes.agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("m")).scalar()
    s = _shrunk(suffixes.withColumn("m", overall)).select("suffix", F.col("mean").alias("m"))
    d = _shrunk(domains.join(s, "suffix")).select("domain", F.col("mean").alias("m"))
    return _shrunk(hosts.join(d, "domain")).select("host", "n", "k", "a", "b", "mean")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], z: float = Z,
          least_good: float = LEAST_GOOD, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, reputation) of every page.

    ``labels``: (``id_col``, good); a page labelled more than once counts as
    good only if all its labels say so. Pages with a null URL share the empty
    host. Repeated rows and null ids stay; a null id has no label."""
    host, path = host_and_path(F.col(url_col))
    p = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    one = labels.groupBy(F.col(id_col).alias("_id")).agg(F.min("good").alias("good"))
    rep = reputations(p.join(one, "_id", "left").select("host", "good"))
    a, b = F.col("a"), F.col("b")
    upper = F.col("mean") + z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    rep = rep.select("host", "mean", F.when(upper < least_good, "block").otherwise("allow").alias("own"))
    found = rule_for(F.col("host"), F.col("path"), rules)
    return p.join(rep, "host").select(
        F.col("_id").alias(id_col), "host", "path", found["rule"].alias("rule"),
        F.coalesce(found["action"], F.col("own")).alias("verdict"), F.round("mean", 6).alias("reputation"))
