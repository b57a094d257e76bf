"""URL filter by empirical-Bayes host reputation, in DataFrame functions only.

Labelled pages say how many pages of a host are good. Counts of a host are shrunk towards its
registered domain, those of the domain towards its suffix, those of the suffix towards the whole:
at each level the counts are taken as beta-binomial around the parent's mean, and the strength of
the prior comes from the spread of all groups of the level (method of moments). A host is allowed
if the lower bound of its posterior reaches a limit. Short hand-written rules override the method.

Cases: a null url or one without ``://`` has an empty host and path and shares the reputation of the
empty host. Hosts without labelled pages inherit from domain and suffix; with no labels at all every
mean is one half, and the bound blocks. Several labels of one page count by their smallest. A url
fits no rule whose path it does not start with, so ``http://a.net`` without a slash fits none of
them. Repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = [
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
]


@dataclass(frozen=True)
class Settings:
    least: float = 0.5  # lower bound of the share of good pages that allows a host
    deviations: float = 1.645
    weakest: float = 2.0  # prior strengths, in pages
    strongest: float = 1000.0


# Which two last labels of a host are a suffix below which names are registered (fixed values): usual
# second labels under any country, hosting names, and every second label under some countries, with
# exceptions. Under anything else names are registered below the last label.
SECOND_LABELS = "ac co com edu go gob gov govt gv ltd mil ne net nhs nom or org plc sch".split()
HOSTING = (
    "azurewebsites.net blogspot.com firebaseapp.com fly.dev github.io gitlab.io herokuapp.com neocities.org netlify.app "
    "onrender.com pages.dev readthedocs.io surge.sh vercel.app web.app wordpress.com workers.dev"
).split()
WILDCARDS = "bd ck er fk jm kh mm np pg".split()
EXCEPTIONS = ["www.ck"]
SUFFIX_PATTERN = rf"^({'|'.join(SECOND_LABELS)})\.[a-z][a-z]$|^[^.]+\.({'|'.join(WILDCARDS)})$"


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """``page_id, host, path``."""
    parts = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    url = F.coalesce("url", F.lit(""))
    return pages.select(
        F.col("page_id").cast("long"),
        lower_ascii(F.regexp_extract(url, parts, 1)).alias("host"),
        F.regexp_extract(url, parts, 2).alias("path"),
    )


def _names(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix; a bare address or a single label is its own of both."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    two, three = F.substring_index(bare, ".", -2), F.substring_index(bare, ".", -3)
    address = bare.rlike(r"^[0-9.]+$|^\[")
    special = two.isin(HOSTING) | two.rlike(SUFFIX_PATTERN) & ~two.isin(EXCEPTIONS)
    domain = F.when(address, bare).when(special, three).otherwise(two)
    suffix = F.when(address, bare).when(special, two).otherwise(F.substring_index(bare, ".", -1))
    return domain, suffix


def _strength(groups: DataFrame, settings: Settings) -> float:
    """Prior strength of a level from ``n, g, parent`` of its groups."""
    spread = F.pow(F.col("g") - F.col("n") * F.col("parent"), 2) / F.col("n")
    binomial = F.col("parent") * (1 - F.col("parent"))
    sums = groups.where("n > 0").agg(
        F.coalesce(F.sum(spread) - F.sum(binomial), F.lit(0.0)).alias("over"),
        F.coalesce(F.sum(binomial * (F.col("n") - 1)), F.lit(0.0)).alias("scale"),
    ).first()
    share = sums.over / sums.scale if sums.scale > 0 else 0.0
    share = min(max(share, 1 / (1 + settings.strongest)), 1 / (1 + settings.weakest))
    return 1 / share - 1


def host_reputation(hosts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``host, n_labelled, mean, bound`` from ``host, n, g`` (pages labelled, and of these good).

    Each level is a sum of the one below, and one row of sums per level comes to the driver.
    """
    domain, suffix = _names(F.col("host"))
    hosts = hosts.select("host", "n", "g", domain.alias("domain"), suffix.alias("suffix"))
    sums = [F.sum("n").alias("n"), F.sum("g").alias("g")]
    domains = hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), *sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    total = suffixes.agg(*sums).first()
    whole = ((total.g or 0) + 1) / ((total.n or 0) + 2)

    def shrunk(groups: DataFrame) -> tuple[DataFrame, Column, float]:
        strength = _strength(groups, settings)
        mean = (F.col("g") + strength * F.col("parent")) / (F.col("n") + strength)
        return groups, mean, strength

    level, mean, _ = shrunk(suffixes.withColumn("parent", F.lit(whole)))
    means = level.select("suffix", mean.alias("parent"))
    level, mean, _ = shrunk(domains.join(means, "suffix"))
    means = level.select("domain", mean.alias("parent"))
    level, mean, strength = shrunk(hosts.join(means, "domain"))
    level = level.select("host", "n", mean.alias("mean"))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + strength + 1))
    bound = F.col("mean") - settings.deviations * deviation
    return level.select("host", F.col("n").alias("n_labelled"), "mean", bound.alias("bound"))


def _rule(rules: list[Rule], value) -> Column:
    """What the longest fitting rule says; null where none fits."""
    said = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda rule: (len(rule.text), rule.text)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        said = F.when(fits, F.lit(value(rule))).otherwise(said)
    return said


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: list[Rule] = RULES, settings: Settings = Settings()
) -> DataFrame:
    """``page_id, host, path, rule, verdict, n_labelled, mean, bound`` per row of ``pages``.

    ``outcomes``: ``host, good`` (0 or 1) of labelled pages. Both sides are counted per host inside
    each task first, so a host with a third of all pages costs one row per task, and written once; where pages join
    the hosts, adaptive execution splits such a host.
    """
    parts = with_host_and_path(pages)
    counts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.sum("good").alias("g"))
    hosts = parts.select("host").distinct().join(counts, "host", "left").na.fill(0, ["n", "g"])
    hosts = stored(hosts, "hosts")  # each level and the last join read these rows, not the pages again
    judged = parts.join(host_reputation(hosts, settings), "host")
    by_method = F.when(F.col("bound") >= settings.least, "allow").otherwise("block")
    return judged.select(
        "page_id",
        "host",
        "path",
        _rule(rules, lambda rule: rule.text).alias("rule"),
        F.coalesce(_rule(rules, lambda rule: rule.verdict), by_method).alias("verdict"),
        "n_labelled",
        "mean",
        "bound",
    )


def outcomes_by_document(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``host, good`` of pages whose path names a labelled document, as ``/en/825``: good is its
    quality. Pages that name none stay out of the join, so null keys cannot gather."""
    named = with_host_and_path(pages).select(
        "host", F.expr(r"try_cast(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1) AS BIGINT)").alias("doc_id")
    )
    quality = labels.where("quality is not null and doc_id is not null")
    quality = quality.groupBy(F.col("doc_id").cast("long")).agg(F.min(F.col("quality").cast("long")).alias("good"))
    return named.where("doc_id is not null").join(quality, "doc_id").select("host", "good")
