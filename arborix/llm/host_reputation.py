"""URL filter: empirical-Bayes host reputation, DataFrame functions only.

Labelled page outcomes (good = quality 1 and not toxic) are counted by host. Three beta-binomial
levels shrink them: the suffix towards the global mean, the registered domain towards its suffix's
posterior mean, the host towards its domain's; a level's prior strength is estimated by moments from
the spread of its children's rates. A host is allowed while the upper bound of its posterior (mean
plus ``z`` standard deviations) reaches ``least``; so unknown hosts pass and only evidence blocks.

Explicit rules come first: a rule (host, path prefix) fits its host and all subdomains when the url's
path starts with the rule's path; the longest rule wins (ties: the smallest rule text).

Suffix and domain leave out a port; the number of a machine is a suffix and a domain of its own. Each level is written
once, as the next one up and its own spread both read it.

Edge cases: a null url, or one without ``://``, has an empty host and path, and the empty host's
reputation is the global prior; a null label counts for nothing; repeated rows are judged alike; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborix.llm._spark import save

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# second-level names that act as public suffixes below two-letter country domains
_SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")


def host_and_path(url: Column) -> tuple[Column, Column]:
    # (?s): '.' also takes line ends, so that "the first ://" and "to the end" hold for any text
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UP, _LOW), path


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    name = F.regexp_replace(host, ":[0-9]*$", "")
    parts = F.split(name, r"\.")
    n = F.size(parts)
    two = (n >= 3) & (F.length(F.element_at(parts, -1)) == 2) & F.element_at(parts, -2).isin(*_SECOND)
    k = F.when(name.rlike("^[0-9.]+$"), n).when(two, 2).otherwise(1)
    tail = lambda m: F.array_join(F.slice(parts, F.greatest(n - m + 1, F.lit(1)), F.least(m, n)), ".")
    return tail(k), tail(k + 1)


def _shrunk(level: DataFrame, keys: list[str], parent: DataFrame | None, on: list[str], mean: Column) -> DataFrame:
    """Posterior alpha and beta of each row of ``level`` (keys, good, n), given the parent's mean."""
    df = level if parent is None else level.join(parent, on, "left")
    df = df.withColumn("prior", mean)
    # moments: var(rate) = m(1-m) * (1 + (n-1) * rho) / n, strength = 1/rho - 1, kept within [2, 200]
    rate = F.col("good") / F.col("n")
    stats = df.where("n > 0").agg(
        F.sum((rate - F.col("prior")) ** 2 * F.col("n")).alias("ss"),
        F.sum(F.col("prior") * (1 - F.col("prior")) * (F.col("n") - 1)).alias("vn"),
        F.sum(F.col("prior") * (1 - F.col("prior"))).alias("v"),
    )
    rho = F.when(F.col("vn") > 0, (F.col("ss") - F.col("v")) / F.col("vn")).otherwise(F.lit(0.1))
    stats = stats.select(F.least(F.greatest(1 / F.greatest(F.coalesce(rho, F.lit(0.1)), F.lit(1e-6)) - 1, F.lit(2.0)), F.lit(200.0)).alias("strength"))
    a = F.col("prior") * F.col("strength") + F.col("good")
    b = (1 - F.col("prior")) * F.col("strength") + F.col("n") - F.col("good")
    return df.join(F.broadcast(stats)).select(*keys, a.alias("a"), b.alias("b"))  # stats: one row


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, good, n: the labelled outcomes of each host; the number that ends a page's path names its document."""
    host, path = host_and_path(F.col("url"))
    ref = pages.select(host.alias("host"), F.regexp_extract(path, r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1).alias("ref"))
    ref = ref.where("ref <> ''").select("host", F.col("ref").cast("long").alias("doc_id"))
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(
        F.min(F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1).otherwise(0)).alias("good")
    )
    # pages of one host first meet per document, so a hot host is summed before it is dealt out
    return ref.join(known, "doc_id").groupBy("host").agg(F.sum("good").alias("good"), F.count("*").alias("n"))


def reputation(seen: DataFrame) -> DataFrame:
    """host, a, b: beta posteriors for every host in ``seen`` (host, good, n); n = 0 for hosts without labels."""
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = save(seen.withColumns({"suffix": suffix, "domain": domain}), "hosts")
    domains = save(hosts.groupBy("suffix", "domain").agg(F.sum("good").alias("good"), F.sum("n").alias("n")), "domains")
    suffixes = save(domains.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n")), "suffixes")
    total = suffixes.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("mean0"))
    s = _shrunk(suffixes.join(F.broadcast(total)), ["suffix"], None, [], F.col("mean0"))  # total: one row
    s = save(s.select("suffix", (F.col("a") / (F.col("a") + F.col("b"))).alias("up")), "suffix-means")
    d = _shrunk(domains, ["suffix", "domain"], s, ["suffix"], F.col("up"))
    d = save(d.select("suffix", "domain", (F.col("a") / (F.col("a") + F.col("b"))).alias("up")), "domain-means")
    return _shrunk(hosts, ["host"], d, ["suffix", "domain"], F.col("up"))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule (text) that fits best and its verdict; both null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, name, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule, verdict = F.when(fits, name + prefix).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, least: float = 0.5, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict, posterior mean and bound of every page."""
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = judged.select("host").distinct().join(outcomes(pages, labels), "host", "left").na.fill(0, ["good", "n"])
    a, b = F.col("a"), F.col("b")
    mean, sd = a / (a + b), F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    known = reputation(seen).select(F.col("host").alias("h"), mean.alias("posterior_mean"), F.least(mean + z * sd, F.lit(1.0)).alias("posterior_bound"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return (
        judged.join(known, F.col("host") == F.col("h"), "left")
        .drop("h")
        .withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("posterior_bound") >= least, "allow").otherwise("block"))})
        .select("page_id", "host", "path", "rule", "verdict", "posterior_mean", "posterior_bound")
    )
