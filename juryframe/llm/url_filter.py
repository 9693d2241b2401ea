"""URL filters: explicit rules, and for all other pages the reputation of their host by empirical Bayes.

Page outcomes (bad or not) are counted by host. The rate of bad pages is shrunk down the hierarchy suffix, registered
domain, host: each level's prior mean is the posterior mean of the level above, and the prior's strength at a level is
estimated from how far its rates lie from their parents' beyond what chance explains (the moment estimator of the
beta-binomial's intraclass correlation). A page is blocked if its host's rate is above a limit with a given posterior
probability, that is if the lower quantile of the beta posterior is above it; hosts without outcomes have their domain's
prior, and so on up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juryframe.llm.beta import beta_cdf
from juryframe.llm.common import cut

#: Suffixes of two labels and more below which domains are registered; a fuller table is given as a parameter.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "co.jp", "com.br", "com.cn", "co.nz", "co.in")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: User, port and trailing dots, which do not tell sites apart.
NOT_NAME = r"^.*@|(:[0-9]*)?$"
NUMBER = r"^[0-9.]+$"
#: Limits of the prior's strength, counted in pages.
WEAKEST, STRONGEST = 1.0, 1000.0
#: A page's share of JUNK characters above which it counts as bad, where pages are their own outcomes.
JUNK, JUNK_SHARE = r"[*%#$|]", 0.03
#: Hosts are blocked whose rate of bad pages is above LIMIT with probability SURE.
LIMIT, SURE = 0.08, 0.6


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; rules are (verdict, "host/path")."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), len(r[1].split("/")[0]), r[0] == "block")):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def name_of(host: Column) -> Column:
    """The host without user, port and trailing dots."""
    return F.rtrim(F.regexp_replace(host, NOT_NAME, ""), F.lit("."))


def _labels(name: Column, suffixes: Sequence[str]) -> Column:
    """How many labels a name's suffix has; of several that fit the longest counts."""
    out = F.lit(1)
    for k in sorted({s.count(".") + 1 for s in suffixes} - {1}):
        out = F.when(F.substring_index(name, ".", -k).isin([s for s in suffixes if s.count(".") == k - 1]), k).otherwise(out)
    return out


def _last(name: Column, labels: Column) -> Column:
    parts = F.split(name, r"\.", -1)
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - labels + 1, F.lit(1)), labels), ".")


def suffix_of(name: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    return F.when(name.rlike(NUMBER), name).otherwise(_last(name, _labels(name, suffixes)))


def domain_of(name: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The registered domain: the suffix and one label more; a numeric address is its own domain."""
    return F.when(name.rlike(NUMBER), name).otherwise(_last(name, _labels(name, suffixes) + 1))


def _posterior(level: DataFrame) -> DataFrame:
    """``level`` (keys, n, bad, prior mean m) with a and b, the parameters of each key's posterior, in place of m.

    One strength for the level: with S the sum of n (rate - m)**2 / (m (1 - m)) over C keys with outcomes and N the sum of n,
    rho = (S - C) / (N - C) and the strength is 1 / rho - 1.
    """
    fit = level.filter("n > 0").agg(
        F.sum(F.col("n") * (F.col("bad") / F.col("n") - F.col("m")) ** 2 / (F.col("m") * (1 - F.col("m")))).alias("s"),
        F.count(F.lit(1)).alias("c"),
        F.sum("n").alias("total"),
    )
    rho = F.when(F.col("total") > F.col("c"), (F.col("s") - F.col("c")) / (F.col("total") - F.col("c")))
    strength = F.when(rho > 0, F.least(F.greatest(1 / rho - 1, F.lit(WEAKEST)), F.lit(STRONGEST))).otherwise(F.lit(STRONGEST)).alias("strength")
    return (
        level.join(F.broadcast(fit.select(strength)), how="cross")  # one row
        .withColumn("a", F.col("strength") * F.col("m") + F.col("bad"))
        .withColumn("b", F.col("strength") * (1 - F.col("m")) + F.col("n") - F.col("bad"))
        .drop("strength", "m")
    )


def reputation(hosts: DataFrame, limit: float = LIMIT, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(name, domain, suffix, n, bad, a, b) of (name, n, bad): the beta posterior of each host's rate of bad pages.

    To the rate of all pages one more counts that is bad to the degree of ``limit``, so that without outcomes nothing is known
    to be above it. Each level is written once, as it is used for its fit and for the level below. Names are different and not null; the
    empty one is a name like any other. Hosts with n 0 have their domain's prior, ties are not broken but shared, an empty table stays empty, and other
    columns stay as they are.
    """
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    mean = (F.col("a") / (F.col("a") + F.col("b"))).alias("m")
    hosts = cut(hosts.withColumns({"domain": domain_of(F.col("name"), suffixes), "suffix": suffix_of(F.col("name"), suffixes)}))
    domains = cut(hosts.groupBy("suffix", "domain").agg(*sums))
    tops = cut(domains.groupBy("suffix").agg(*sums))
    overall = tops.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + F.lit(float(limit))) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("m"))
    tops = cut(_posterior(tops.join(F.broadcast(overall), how="cross")))  # one row
    domains = cut(_posterior(domains.join(tops.select("suffix", mean), "suffix")))
    return _posterior(hosts.join(domains.select("suffix", "domain", mean), ["suffix", "domain"]))


def junk_outcomes(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", share: float = JUNK_SHARE) -> DataFrame:
    """(page_id, bad): pages that are their own outcomes. More than ``share`` of a bad page's characters are junk; null is none.

    A row for each of ``pages``, repeated ones and null ids too; a share equal to the limit is not beyond it, so an empty html is not bad. An empty
    table stays empty, html may be of any length, and other columns are not read, whatever their names.
    """
    html = F.coalesce(pages[html_col], F.lit(""))
    return pages.select(pages[id_col].alias("page_id"), (F.regexp_count(html, F.lit(JUNK)) > F.lit(share) * F.length(html)).alias("bad"))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str]],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    limit: float = LIMIT,
    sure: float = SURE,
    suffixes: Sequence[str] = SUFFIXES,
) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict (allow or block), rate (its host's posterior mean) and above
    (the posterior probability that the rate is above ``limit``).

    ``outcomes`` has page_id and bad (boolean); rows with nulls are not used, a page with two outcomes is bad if one says
    so. A null url, or one without ``://``, has empty host and path, and the empty host a reputation like any other. Urls
    may be of any length. User, port and trailing dots of a host do not count for its reputation. ``suffixes`` are those of
    two labels and more; of several that fit the longest counts. Rows that repeat are judged each; an empty table stays
    empty. Other columns are not read, whatever their names. The pages' counts are summed where they lie, so a host with a third
    of all pages costs no more than others.
    """
    own = pages.select(pages[id_col].alias("page_id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path")).withColumn("name", name_of(F.col("host")))
    marks = outcomes.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.bool_or("bad").alias("bad"))
    known = own.select("page_id", "name").join(marks, "page_id", "left")
    hosts = reputation(known.groupBy("name").agg(F.count("bad").alias("n"), F.count_if("bad").alias("bad")), limit, suffixes)
    above = cut(hosts.select("name", (F.col("a") / (F.col("a") + F.col("b"))).alias("rate"), (1 - beta_cdf(F.lit(float(limit)), F.col("a"), F.col("b"))).alias("above")))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("above") >= sure, F.lit("block")).otherwise(F.lit("allow"))
    return own.join(above, "name").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "rate", "above")
