"""Verdicts on URLs: fixed rules, else the host's reputation from labelled pages, shrunk by empirical Bayes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path): a rule fits its host and all subdomains, below its path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/")]

BAD_SHARE = 0.5  # a host is blocked if its share of bad pages is above this ...
Z = 1.645  # ... with 95 % posterior probability, by the normal approximation of the beta posterior
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0  # of a prior, in pages


#: Labels below a country under which names are registered; other suffixes are one label long.
SECOND_LEVEL = {
    "ar": "com edu gob net org", "at": "ac co gv or", "au": "asn com edu gov id net org", "br": "com edu gov net org",
    "cn": "ac com edu gov net org", "es": "com edu gob nom org", "fr": "asso com gouv nom", "hk": "com edu gov net org",
    "id": "ac co go or sch web", "il": "ac co gov net org", "in": "ac co edu firm gen gov ind net nic org res",
    "jp": "ac ad co ed go gr lg ne or", "kr": "ac co go ne or pe re", "mx": "com edu gob net org",
    "my": "com edu gov net org", "nz": "ac co geek gen govt iwi maori net org school", "pl": "com edu gov net org",
    "pt": "com edu gov org", "sg": "com edu gov net org", "th": "ac co go in net or", "tr": "com edu gov net org",
    "tw": "com edu gov net org", "ua": "com edu gov net org", "uk": "ac co gov ltd me net nhs org plc police sch",
    "za": "ac co gov net org web"}
SUFFIXES = [f"{label}.{country}" for country, labels in SECOND_LEVEL.items() for label in labels.split()]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    rest = F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    rest = F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def bare(host: Column) -> Column:
    """A host without user, port and closing dot."""
    return F.regexp_replace(F.regexp_replace(host, "(?s)^.*@", ""), r"\.?(:[0-9]*)?\z", "")


def _last(name: Column, labels: int) -> Column:
    return F.substring_index(name, ".", -labels)  # the whole name, if it has fewer


def _by_suffix(name: Column, suffixes: list[str], address: Column, more: int) -> Column:
    """The labels of the longest suffix that `name` ends in, and `more` before it; `address` for an IP address."""
    out = F.when(name.rlike(r"^([0-9.]+|\[[^\]]*\])\z"), address)
    for labels in sorted({s.count(".") + 1 for s in suffixes}, reverse=True):
        listed = [s for s in suffixes if s.count(".") + 1 == labels]
        out = out.when(_last(name, labels).isin(listed), _last(name, labels + more))
    return out.otherwise(_last(name, 1 + more))


def domain_of(host: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """The registered domain: the longest suffix and the label before it. A suffix or an address is its own domain."""
    return _by_suffix(bare(host), suffixes, bare(host), 1)


def suffix_of(domain: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """The longest listed suffix of a domain, else its last label; empty for an address."""
    return _by_suffix(domain, suffixes, F.lit(""), 0)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(length, rule, verdict) of the longest fitting rule, or null. The rules are a list in the program."""
    fitting = [F.when(((host == name) | host.endswith("." + name)) & path.startswith(below),
                      F.struct(F.lit(len(name + below)).alias("length"), F.lit(name + below).alias("rule"),
                               F.lit(verdict).alias("verdict"))) for verdict, name, below in rules]
    nothing = F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    return F.array_max(F.array(nothing, *fitting))


def _strength(children: DataFrame) -> Column:
    """Strength of the prior, in pages, from how far the rates of `children` (n, bad) spread: the moment estimate of
    a beta-binomial. Rates that spread no more than chance give the largest strength."""
    n, bad = F.sum("n").cast("double"), F.sum("bad").cast("double")
    p, k = F.try_divide(bad, n), F.count("*").cast("double")
    spread = F.sum(F.col("bad") * F.col("bad") / F.col("n").cast("double")) - bad * p
    room = p * (1 - p)
    squares = F.sum(F.col("n") * F.col("n")).cast("double")
    rho = F.try_divide(spread - room * (k - 1), room * (n - F.try_divide(squares, n) - (k - 1)))
    strength = F.when(rho > 0, F.least(F.greatest(F.try_divide(F.lit(1.0), rho) - 1, F.lit(LEAST_STRENGTH)),
                                       F.lit(MOST_STRENGTH)))
    return F.round(F.coalesce(strength, F.lit(MOST_STRENGTH)), 3)


def reputation(labelled: DataFrame, listed: list[str] = SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """From (host, bad 0/1) rows: posteriors of suffixes, domains and hosts, and of all pages (one row).

    Each has its name and (a, b) of its beta posterior; the prior of a host is centred on its domain's
    posterior mean, that of a domain on its suffix's, that of a suffix on all pages. The strength of each level's
    priors comes from the spread of the rates on that level.
    """
    hosts = labelled.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = stored(hosts.select("host", domain_of(F.col("host"), listed).alias("domain"), "n", "bad"),
                   "hosts")
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = domains.select("domain", suffix_of(F.col("domain"), listed).alias("suffix"), "n", "bad")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("mean"))

    def posterior(level: DataFrame, name: str, strength: DataFrame) -> DataFrame:
        return (level.crossJoin(strength)  # one row
                .select(name, (F.col("bad") + F.col("m") * F.col("mean")).alias("a"),
                        (F.col("n") - F.col("bad") + F.col("m") * (1 - F.col("mean"))).alias("b")))

    of_suffix = posterior(suffixes.crossJoin(total), "suffix", suffixes.agg(_strength(suffixes).alias("m")))
    of_domain = posterior(domains.join(_means(of_suffix), "suffix"), "domain", domains.agg(_strength(domains).alias("m")))
    m = hosts.agg(_strength(hosts).alias("m"))
    of_host = posterior(hosts.join(_means(of_domain), "domain"), "host", m)
    return of_suffix, of_domain, of_host, total.crossJoin(m)


def _means(level: DataFrame) -> DataFrame:
    return level.select(level.columns[0], (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES,
          bad_share: float = BAD_SHARE, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_bound) per row of `pages` (page_id, url).

    The longest rule that fits decides. Else the page is blocked if the lower bound of its host's share of bad pages
    is above `bad_share`; hosts without labelled pages have the posterior of a host of their domain, suffix or all
    pages that has none. `outcomes` are (page_id, bad 0/1): a page labelled twice is bad if any label says so,
    rows with nulls say nothing. Pages of an empty host (null url, no `://`) have no reputation and are allowed.
    `suffixes` lists the suffixes of several labels below which names are registered; it is a list in the program.
    Without outcomes, all pages without a rule are allowed. Other columns are ignored.
    """
    located = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = outcomes.select("page_id", "bad").dropna().groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    labelled = (located.select("page_id", "host").filter("page_id is not null and host <> ''").distinct()
                .join(labels, "page_id").select("host", "bad"))
    of_suffix, of_domain, of_host, total = reputation(labelled, suffixes)
    named = (located.filter("host <> ''").select("host").distinct()
             .withColumn("domain", domain_of(F.col("host"), suffixes))
             .withColumn("suffix", suffix_of(F.col("domain"), suffixes)))
    mean = F.coalesce("domain_mean", "suffix_mean", "mean")
    a, b = F.coalesce("a", F.col("m") * mean), F.coalesce("b", F.col("m") * (1 - mean))
    known = (named.join(of_host, "host", "left")
             .join(_means(of_domain).withColumnRenamed("mean", "domain_mean"), "domain", "left")
             .join(_means(of_suffix).withColumnRenamed("mean", "suffix_mean"), "suffix", "left")
             .crossJoin(total)  # one row
             .select("host", a.alias("a"), b.alias("b")))
    rate = F.col("a") / (F.col("a") + F.col("b"))
    bound = rate - Z * F.sqrt(rate * (1 - rate) / (F.col("a") + F.col("b") + 1))
    bounds = known.select("host", bound.alias("bad_bound"))
    chosen = rule_for(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("bad_bound") > bad_share, "block").otherwise("allow"))
    return (located.join(bounds, "host", "left").withColumn("fit", chosen)
            .select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "bad_bound"))
