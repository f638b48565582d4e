"""Matching requests against host rules of filter lists (`||host^` with options, and `@@` exceptions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("script", "image", "stylesheet", "object", "xmlhttprequest", "subdocument", "ping", "websocket", "font", "media", "other")


def parsed(rules: DataFrame, rule: str = "rule") -> tuple[DataFrame, DataFrame]:
    """(host rules as columns, rules of other forms, which are not matched)."""
    r = F.col(rule)
    form = r"^(@@)?\|\|([A-Za-z0-9.-]+)\^?(?:\$(.*))?$"
    options = F.split(F.lower(F.regexp_extract(r, form, 3)), ",")
    domains = F.split(F.regexp_replace(F.coalesce(F.get(F.filter(options, lambda o: o.startswith("domain=")), 0), F.lit("")), "^domain=", ""), r"\|")
    named = F.filter(options, lambda o: o.isin(*TYPES))
    unnamed = F.transform(F.filter(options, lambda o: o.startswith("~") & F.substring(o, 2, 100).isin(*TYPES)), lambda o: F.substring(o, 2, 100))
    out = rules.where(r.rlike(form)).select(
        F.col(rule),
        (F.regexp_extract(r, form, 1) == "@@").alias("exception"),
        F.lower(F.regexp_extract(r, form, 2)).alias("rule_host"),
        named.alias("types"),
        unnamed.alias("other_types"),
        F.when(F.array_contains(options, "third-party"), True).when(F.array_contains(options, "~third-party"), False).alias("third_party"),
        F.filter(domains, lambda d: (d != "") & ~d.startswith("~")).alias("on"),
        F.transform(F.filter(domains, lambda d: d.startswith("~")), lambda d: F.substring(d, 2, 253)).alias("off"),
    )
    return out, rules.where(~r.rlike(form) | r.isNull())


def host_suffixes(host: Column) -> Column:
    """The host and all it ends with after a dot: an equi-join on these replaces a scan of all rules."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def blocked(requests: DataFrame, rules: DataFrame, key: list[str], host: str = "host", site: str = "site_host", resource_type: str = "resource_type", third_party: str = "third_party_request") -> DataFrame:
    """(key, blocked) of requests that a rule names: blocked if some rule applies and no exception does."""
    each = requests.select(*key, host, site, resource_type, third_party, F.explode(host_suffixes(F.col(host))).alias("rule_host"))
    sites = host_suffixes(F.col(site))
    applies = (
        ((F.size("types") == 0) | F.array_contains("types", F.col(resource_type)))
        & ~F.array_contains("other_types", F.col(resource_type))
        & (F.col("third_party").isNull() | (F.col("third_party") == F.col(third_party)))
        & ((F.size("on") == 0) | F.arrays_overlap("on", sites))
        & ~F.arrays_overlap("off", sites)
    )
    found = each.join(rules, "rule_host").where(applies)
    return found.groupBy(*key).agg((F.max((~F.col("exception")).cast("int")) > F.max(F.col("exception").cast("int"))).alias("blocked"))
