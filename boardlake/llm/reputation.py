"""URL filters: explicit host and path rules, and host reputation for every other url.

Reputation is empirical Bayes over labelled page outcomes. Bad and good pages are counted per
host, registered domain and suffix. The rate of a suffix is shrunk toward the overall rate, that
of a domain toward its suffix, that of a host toward its domain, each as the posterior mean of
a beta-binomial whose prior strength is estimated per level from the spread of the rates (method
of moments). A url is blocked when even the lower bound of its host's posterior (mean less ``z``
deviations) is above ``max_bad``; hosts without labels inherit the posterior of the next level.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and is
judged by the overall rate. Users, ports and dots at the end of a host do not count for its domain; an address
is a domain of its own. An empty table gives an empty result. Null labels and ids are no outcomes. Repeated rows count as often as
they occur. No labels at all: everything is allowed. Only the columns used are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, lower_ascii

#: Second-level labels that, before a two-letter country, belong to the suffix.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: What a host may have besides its place among domains, and addresses in numbers.
USER, PORT, DOTS, ADDRESS = "^.*@", ":[0-9]*$", "[.]+$", r"^([0-9]{1,3}([.][0-9]{1,3}){3}|\[.*\])$"
MAX_BAD = 0.5
Z = 2.0


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def place_of(host: Column) -> Column:
    """The host's place among domains: without a user, a port and dots at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, USER, ""), PORT, ""), DOTS, "")


def suffix_of(host: Column) -> Column:
    """The public suffix; an address is its own."""
    place = place_of(host)
    labels = F.split(place, r"\.")
    last, before = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    two = (F.length(last) == 2) & before.isin(*SECOND_LEVEL) & (F.size(labels) > 2)
    return F.when(place.rlike(ADDRESS), place).when(two, F.concat_ws(".", before, last)).otherwise(last)


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one label more; the host's place itself where it has no more, or is an address."""
    place = place_of(host)
    labels, depth = F.split(place, r"\."), F.size(F.split(suffix, r"\.")) + 1
    return F.when(place.rlike(ADDRESS), place).otherwise(F.array_join(F.slice(labels, F.greatest(F.size(labels) - depth + 1, F.lit(1)), depth), "."))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct ``rule`` and ``verdict`` of the longest rule that fits, null if none does."""
    out = None
    for verdict, at, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        value = F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _strength(groups: DataFrame, parent_rate: str) -> DataFrame:
    """Prior strength of a level, one row: how closely its groups follow their parents.

    With rates p of n outcomes around the parent rate m, the spread beyond chance gives the
    intraclass correlation r; the strength is 1 / r - 1, held between 1 and 1000.
    """
    n, bad, m = F.col("n").cast("double"), F.col("bad").cast("double"), F.col(parent_rate)
    var = m * (1 - m)
    seen = F.sum(n * (bad / n - m) * (bad / n - m))
    chance = F.sum(var)
    extra = F.sum((n - 1) * var)
    rho = F.when(extra > 0, (seen - chance) / extra)
    held = F.least(F.greatest(1 / F.greatest(F.coalesce(rho, F.lit(0.0)), F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(1000.0))
    return groups.agg(held.alias("strength"))


def reputations(outcomes: DataFrame) -> dict[str, DataFrame]:
    """Posterior ``a`` and ``b`` per suffix, domain and host, and overall.

    ``outcomes`` has ``host`` and boolean ``bad``. Counting is pre-aggregated per task, so a
    host with a third of all pages costs one row per task.
    """
    counted = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("bigint")).alias("bad"))
    counted = counted.withColumn("suffix", suffix_of(F.col("host")))
    counted = checkpoint(counted.withColumn("domain", domain_of(F.col("host"), F.col("suffix"))))
    overall = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    top = (overall["bad"] + 1.0) / (overall["n"] + 2.0)
    levels: dict[str, DataFrame] = {}
    parent = None
    for level, above in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        keep = [level] if above is None else [level, above]
        groups = counted.groupBy(*keep).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        if parent is None:
            groups = groups.withColumn("m", F.lit(top))
        else:
            groups = groups.join(parent.select(F.col(above), F.col("rate").alias("m")), above)
        strength = F.lit(_strength(groups, "m").first()["strength"])
        a, b = F.col("m") * strength + F.col("bad"), (1 - F.col("m")) * strength + F.col("n") - F.col("bad")
        parent = checkpoint(groups.select(level, a.alias("a"), b.alias("b"), (a / (a + b)).alias("rate")))
        levels[level] = parent
    one = counted.sparkSession.createDataFrame([(float(overall["bad"] + 1), float(overall["n"] - overall["bad"] + 1))], "a double, b double")
    levels["overall"] = one if overall["n"] else one.select(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))
    return levels


def lower_bound(a: Column, b: Column, z: float = Z) -> Column:
    mean, total = a / (a + b), a + b
    return F.greatest(mean - z * F.sqrt(mean * (1 - mean) / (total + 1)), F.lit(0.0))


def judged(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = MAX_BAD, z: float = Z) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``bad_bound`` of every page.

    ``outcomes`` has ``page_id`` and boolean ``bad``; a page's outcomes reach its host through
    its url. The posteriors of each level are joined on their key, never collected.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    facts = outcomes.where(F.col("bad").isNotNull()).select(F.col("page_id").alias("_page"), "bad")
    levels = reputations(urls.join(facts, F.col("page_id") == F.col("_page")).where(F.col("host") != "").select("host", "bad"))
    known = checkpoint(
        urls.select("host").distinct()
        .withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    )
    for level in ("suffix", "domain", "host"):
        post = levels[level].select(level, F.struct("a", "b").alias(f"_{level}"))
        known = known.join(post, level, "left")
    whole = levels["overall"].first()
    best = F.coalesce("_host", "_domain", "_suffix", F.struct(F.lit(whole["a"]).alias("a"), F.lit(whole["b"]).alias("b")))
    bounds = checkpoint(known.select(F.col("host").alias("_h"), lower_bound(best["a"], best["b"], z).alias("bad_bound")))
    rows = urls.withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules))
    out = rows.join(bounds, F.col("host") == F.col("_h"), "left")
    method = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    return out.select(
        "page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce(F.col("_fit.verdict"), method).alias("verdict"),
        F.round("bad_bound", 6).alias("bad_bound"),
    )
