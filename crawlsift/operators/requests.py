"""Web-request operators: status and header handling, filters, the two-arm difference and request features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsift.functions import text as tx
from crawlsift.functions import urls
from crawlsift.operators.diff import count_mismatches, fuzzy_matches, matched_domains, only_in

MAX_AGE, MIN_IMAGE, MIN_OTHER = 40 * 24 * 3600, 2048, 100
#: Resource types, cache directives and ignored third parties.
RESOURCE_TYPES = ("main_frame", "sub_frame", "stylesheet", "script", "image", "font", "object", "xmlhttprequest", "ping", "csp_report", "media", "websocket", "other", "unknown")
DIRECTIVES = ("no-cache", "no-store", "must-revalidate", "public", "private", "max-age", "proxy-revalidate", "none")
IGNORED_PARTIES = ("doubleclick.net", "twitter.com", "facebook.com", "addthis.com", "google.com")


def header(parsed: Column, name: str) -> Column:
    """The last value of a response header, by lower-case name; null if absent."""
    found = F.filter(parsed["responseHeaders"], lambda h: F.lower(h["name"]) == name)
    return F.when(F.size(found) > 0, F.element_at(found, -1)["value"])


def successful(events: DataFrame) -> DataFrame:
    """Drops events whose parsed status is known and not 200; missing or malformed details stay as unknown."""
    return events.where(F.col("parsed").isNull() | F.col("parsed.statusCode").isNull() | (F.col("parsed.statusCode") == 200))


def detail(field: str) -> Column:
    """A field of the details where the status is 200."""
    return F.when(F.col("parsed.statusCode") == 200, F.col(f"parsed.{field}"))


def url_attributes(events: DataFrame, by: list[str]) -> DataFrame:
    """(by, url, ...) one row a URL: first content type, last known resource type, cache control and length.

    A length that is not a whole number counts as -1. Order is trial, then place.
    """
    order = F.struct("trial", "place")
    kind, rtype, cache = header(F.col("parsed"), "content-type"), F.col("parsed.type"), header(F.col("parsed"), "cache-control")
    length = header(F.col("parsed"), "content-length")
    known = lambda c, o=order: F.max_by(c, F.when(c.isNotNull(), o))
    parts = successful(events).where(F.col("url").isNotNull()).withColumns({"content_type": kind, "resource_type": rtype, "cache_control": cache, "length": F.when(length.isNotNull(), F.coalesce(length.try_cast("long"), F.lit(-1)))})
    return parts.groupBy(*by, "url").agg(
        F.min_by("content_type", F.when(F.col("content_type").isNotNull(), order)).alias("content_type"),
        known(F.col("resource_type")).alias("resource_type"),
        known(F.col("cache_control")).alias("cache_control"),
        F.coalesce(known(F.col("length")), F.lit(-1)).alias("length"),
        F.min("trial").alias("first_trial"),
    )


def with_url_parts(rows: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, subdomain, registrable and domain_path."""
    h = urls.host(F.col(url))
    rows = rows.withColumns({"host": h, "path": urls.path(F.col(url))})
    rows = rows.withColumns({"subdomain": urls.subdomain(F.col("host")), "registrable": urls.registrable(F.col("host"))})
    return rows.withColumn("domain_path", F.concat(urls.bare_host(F.col("host")), F.col("path")))


def worth_keeping(party: Column, cache_control: Column, content_type: Column, length: Column) -> Column:
    """First-party requests; others if they are not cached for 40 days or more and not tiny.

    A max-age that is no number does not pass; a request without one does. Lengths of -1 are unknown and pass.
    """
    image = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("image"))
    long_enough = (length == -1) | F.when(image, length > MIN_IMAGE).otherwise(length > MIN_OTHER)
    return party | (tx.younger(cache_control, MAX_AGE) & long_enough)


def allowed(requests: DataFrame, blocked: DataFrame, by: list[str]) -> DataFrame:
    """Requests that the blocker did not stop on their site, and the ignored third parties left out of the variant.

    requests: by, arm, url, registrable; blocked: by, arm, url.
    """
    kept = requests.join(blocked.select(*by, "arm", "url").distinct(), [*by, "arm", "url"], "left_anti")
    return kept.where((F.col("arm") == "control") | ~F.col("registrable").isin(*IGNORED_PARTIES))


def request_difference(requests: DataFrame, by: list[str], least: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(paths that one arm alone has, marked where a similar host of the other arm serves the same path; and
    directories that both arms have but use unequally).

    requests: by, arm and the columns of with_url_parts.
    """
    only = only_in(requests, by, "domain_path")
    parts = requests.select(*by, "domain_path", "host", "path", "subdomain", "registrable").dropDuplicates([*by, "domain_path"])
    only = only.join(parts, [*by, "domain_path"])
    both = matched_domains(only, by, "registrable")
    side = lambda s: both.where((F.col("side") == s) & (F.col("subdomain") != "www"))
    near = fuzzy_matches(side("variant"), side("control"), [*by, "registrable"], "subdomain", least)
    other = side("control").select(*by, "registrable", F.col("subdomain").alias("right"), "path").distinct()
    moved = near.join(other, [*by, "registrable", "right"]).select(*by, "registrable", F.col("left").alias("subdomain"), "path").distinct().withColumn("moved", F.lit(True))
    marked = only.join(moved, [*by, "registrable", "subdomain", "path"], "left").withColumn("moved", F.coalesce("moved", F.lit(False)) & (F.col("side") == "variant"))
    folders = requests.withColumn("directory", urls.top_directory(F.col("path")))
    return marked, count_mismatches(folders, by, ["host", "directory"])


def untracked(requests: DataFrame, tracking: DataFrame) -> DataFrame:
    """Requests that the tracking list does not name by registrable site, URL and resource type."""
    named = tracking.select(F.col("sld").alias("site_sld"), "url", F.col("type").alias("resource_type")).distinct()
    return requests.join(named, ["site_sld", "url", "resource_type"], "left_anti")


def _lengths(parts: Column) -> Column:
    return F.transform(F.filter(parts, lambda x: F.trim(x) != ""), lambda x: F.length(x).cast("long"))


def _sums(numbers: Column) -> Column:
    """Of an array of whole numbers: how many, their sum, sum of squares and largest."""
    zero = F.lit(0).cast("long")
    add = lambda t, n: F.struct((t["n"] + 1).alias("n"), (t["sum"] + n).alias("sum"), (t["squares"] + n * n).alias("squares"), F.greatest(t["most"], n).alias("most"))
    return F.aggregate(numbers, F.struct(*(zero.alias(x) for x in ("n", "sum", "squares", "most"))), add)


def _entropies(parts: Column) -> Column:
    """Of an array of texts: how many are not empty, and the sum of their entropies."""
    some = F.filter(parts, lambda x: F.length(x) > 0)
    return F.named_struct(F.lit("n"), F.size(some).cast("long"), F.lit("sum"), F.aggregate(F.transform(some, tx.entropy), F.lit(0.0), lambda t, x: t + x))


def _mean(total: Column, n: Column) -> Column:
    return F.coalesce(F.bround(total / F.nullif(n, F.lit(0)), 2), F.lit(0.0))


def _spread(n: Column, total: Column, squares: Column) -> Column:
    """Sample variance from sums of whole numbers; 0 for fewer than two."""
    return F.coalesce(F.bround((squares - total * total / F.nullif(n, F.lit(0))) / F.nullif(n - 1, F.lit(0)), 2), F.lit(0.0))


def _characters(path: Column) -> Column:
    """Totals and largest counts, in a section, of digits, special characters, capitals and small letters."""
    patterns = {"number": "[0-9]", "special_chars": "[^A-Za-z0-9]", "upper_chars": "[A-Z]", "lower_chars": "[a-z]"}
    count = lambda p: F.transform(urls.sections(path), lambda s: tx.character_counts(s, p).cast("long"))
    return F.named_struct(*(c for name, p in patterns.items() for x in ("sum", "most") for c in (F.lit(f"{name}_{x}"), _sums(count(p))[x])))


CHARACTERS = ("number", "special_chars", "upper_chars", "lower_chars")
_PARTY = {"1": "first_party", "3rd": "third_party"}


def _labels() -> Column:
    """The groups of requests that a request counts in: its arm and party, those with each cache directive, content class.

    A request that only the header filter removed counts among the originals alone.
    """
    side = F.concat(F.when(F.col("arm") == "control", "ctr").otherwise("var"), F.lit("|"), F.when(F.col("first_party"), "1").otherwise("3rd"))
    cache = F.coalesce("cache_control", F.lit("none"))  # a response without the header has no directive
    having = F.filter(F.array(*(F.when(F.contains(cache, F.lit(d)), F.lit(d)) for d in DIRECTIVES)), lambda d: d.isNotNull())
    groups = F.concat(F.array(F.lit("all")), having, F.array(F.concat(F.lit("content:"), urls.content_class(F.col("content_type")))))
    whole = F.array(F.concat(F.when(F.col("arm") == "control", "ctr").otherwise("var"), F.lit("|both")))
    return F.when(F.col("kept"), F.concat(whole, F.transform(groups, lambda g: F.concat(side, F.lit("|"), g)))).otherwise(whole)


def request_features(requests: DataFrame, by: list[str]) -> DataFrame:
    """One row a site with the 427 request features.

    requests: by, arm (control or variant), url, host, path, subdomain, registrable, first_party, content_type,
    resource_type, cache_control, kept (false for what the header filter removed, which counts for mismatches of
    content only), mismatched (true for requests of unequal directories, counted in variant_mismatch_resources_count
    only) and growth, an array of the site's trials in order with urls_seen and domains_seen, the same in all its
    rows of an arm. Columns that are missing count as null, kept as true.

    Each request gives sums of its own parts, and is counted in each group that it belongs to: one scan, one shuffle
    by site and group of pre-aggregated sums, one by site.
    """
    missing = {"arm": F.lit("variant"), "kept": F.lit(True), "mismatched": F.lit(False), "growth": F.lit(None).cast("array<struct<urls_seen:long,domains_seen:long>>")}
    rows = requests.withColumns({c: v for c, v in missing.items() if c not in requests.columns})
    path, keys = F.col("path"), urls.query_keys(F.col("url"))
    wrong = urls.content_mismatch(path, F.col("content_type"))
    resource = F.lower(F.coalesce("resource_type", F.lit("")))
    common = F.exists(F.array_intersect(urls.sections(path), F.split("subdomain", r"\.")), lambda x: F.length(x) >= 3)
    each = rows.select(
        *by,
        "arm", "growth", "subdomain", "registrable", "mismatched", "kept",
        F.explode(_labels()).alias("label"),
        _sums(_lengths(F.split(path, "/"))).alias("pth"), _sums(F.transform(keys, lambda k: F.length(k).cast("long"))).alias("qk"),
        _entropies(F.split(path, "/")).alias("path_e"), _entropies(keys).alias("key_e"), _entropies(urls.query_values(F.col("url"))).alias("value_e"),
        _characters(path).alias("chars"),
        F.when(F.col("subdomain") != "", tx.entropy(F.col("subdomain"))).alias("sub_e"),
        urls.short_special_section(path).alias("special"), common.alias("same_name"),
        F.struct(*(wrong[k].alias(k) for k in urls.MISMATCHES)).alias("wrong"), urls.content_class(F.col("content_type")).alias("class"), resource.alias("resource"),
    )
    kept = F.col("kept") & ~F.col("mismatched")
    total = lambda c: F.coalesce(F.sum(F.when(kept, c)), F.lit(0))
    most = lambda c: F.coalesce(F.max(F.when(kept, c)), F.lit(0))
    sums = {"n": F.count_if(kept), "mismatched": F.count_if(F.col("mismatched"))}
    for part in ("pth", "qk"):
        sums |= {f"{part}_{x}": total(F.col(f"{part}.{x}")) for x in ("n", "sum", "squares")} | {f"{part}_most": most(F.col(f"{part}.most"))}
    sums |= {f"{part}_{x}": total(F.col(f"{part}.{x}")) for part in ("path_e", "key_e", "value_e") for x in ("n", "sum")}
    sums |= {f"{c}_sum": total(F.col(f"chars.{c}_sum")) for c in CHARACTERS} | {f"{c}_most": most(F.col(f"chars.{c}_most")) for c in CHARACTERS}
    sums |= {"sub_e_n": F.count(F.when(kept, F.col("sub_e"))), "sub_e_sum": total(F.col("sub_e"))}
    sums |= {"special": F.max(F.coalesce(kept & F.col("special"), F.lit(False)).cast("int")), "same_name": F.max(F.coalesce(kept & F.col("same_name"), F.lit(False)).cast("int"))}
    sums |= {f"wrong_{k}": F.count_if(~F.col("mismatched") & F.col(f"wrong.{k}")) for k in urls.MISMATCHES}
    sums |= {f"class_{k}": F.count_if(kept & (F.col("class") == k)) for k in urls.CONTENT_CLASSES}
    sums |= {f"resource_{k}": F.count_if(kept & (F.col("resource") == k)) for k in RESOURCE_TYPES}
    # the distinct hosts of one page's requests; only the groups of a whole arm and party carry them
    sums["hosts"] = F.collect_set(F.when(kept & F.col("label").endswith("|all"), F.struct("subdomain", "registrable")))
    sums["growth"] = F.first("growth", ignorenulls=True)
    grouped = each.groupBy(*by, "label").agg(*(c.alias(n) for n, c in sums.items()))
    wide = grouped.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct(*sums)))).alias("m"))
    groups: dict[str, str] = {}
    columns = _request_columns(groups)
    # each group is looked up once
    found = wide.select(*by, *(F.try_element_at("m", F.lit(label)).alias(name) for label, name in groups.items()))
    return found.select(*by, *(c.alias(n) for n, c in columns.items()))


def _request_columns(groups: dict[str, str]) -> dict[str, Column]:
    """Feature name to expression over the sums of groups; fills groups with each group's column name."""

    def of(label: str, x: str, none: str = "0") -> str:
        return f"coalesce({groups.setdefault(label, f'_g{len(groups)}')}.{x}, {none})"

    mean = lambda total, n: f"coalesce(bround({total} / nullif({n}, 0), 2), 0.0)"
    spread = lambda n, s, q: f"coalesce(bround(({q} - {s} * {s} / nullif({n}, 0)) / nullif({n} - 1, 0), 2), 0.0)"
    entropy = lambda label, part: mean(of(label, f"{part}_sum"), of(label, f"{part}_n"))
    hosts = lambda arm, party: F.expr(of(f"{arm}|{party}|all", "hosts", "array()"))["subdomain"]
    out: dict[str, str | Column] = {}
    arms = {"control": "ctr", "variant": "var"}
    rates = {}
    for arm, a in arms.items():
        for p, party in _PARTY.items():
            out[f"{arm}_{party}_count"] = of(f"{a}|{p}|all", "n")
            e = _entropies(hosts(a, p))
            out[f"{arm}_{party}_subdomain_entropy"] = _mean(e["sum"], e["n"])
        both = F.concat(hosts(a, "1"), hosts(a, "3rd"))
        out[f"{arm}_subdomain_length_more5"] = F.exists(both, lambda x: urls.long_subdomain_with_digit(x))
        t = _sums(F.flatten(F.transform(both, urls.subdomain_lengths)))
        out[f"{arm}_subdomain_mean"], out[f"{arm}_subdomain_variance"], out[f"{arm}_subdomain_max_val"] = _mean(t["sum"], t["n"]), _spread(t["n"], t["sum"], t["squares"]), t["most"]
        for x in ("urls", "domains"):
            values = F.expr(of(f"{a}|both", f"growth.{x}_seen", "array()"))
            out[f"{arm}_trials_{x}"] = F.coalesce(F.try_element_at(values, F.lit(-1)), F.lit(0))
            out[f"{arm}_trials_{x}_slope"] = _slope(values)
            rates[a, x] = _growth(values)
    for x in ("urls", "domains"):
        out[f"variant_ratio_{x}_growth_rate"] = F.when(rates["ctr", x] > 0, rates["var", x] / F.nullif(rates["ctr", x], F.lit(0.0))).otherwise(F.lit(0.0))
    for p, party in _PARTY.items():
        every = f"var|{p}|all"
        joined = F.array_join(hosts("var", p), "")
        out[f"variant_{party}_number_in_subdomain_count"] = tx.character_counts(joined, "[0-9]")
        out[f"variant_{party}_dash_in_subdomain_count"] = tx.character_counts(joined, "-")
        for c in CHARACTERS:
            out[f"variant_{party}_{c}_in_path_avg"] = f"coalesce(floor({of(every, f'{c}_sum')} / nullif({of(every, 'n')}, 0)), 0)"
            out[f"variant_{party}_{c}_in_path_max"] = of(every, f"{c}_most")
        short = {"1": "fp", "3rd": "tp"}[p]
        for k in urls.CONTENT_CLASSES:
            label = f"var|{p}|content:{k}"
            out[f"var_ct_{short}_subdomain_entropy__{k}"], out[f"var_ct_{short}_path_entropy__{k}"] = entropy(label, "sub_e"), entropy(label, "path_e")
        for a in arms.values():
            label = f"{a}|{p}|all"
            out[f"{a}_{p}_path_entropy"], out[f"{a}_{p}_query_entropy"] = entropy(label, "path_e"), entropy(label, "key_e")
            if (a, p) != ("ctr", "1"):
                out[f"{a}_{p}_query_val_entropy"] = entropy(label, "value_e")
            out[f"{a}_{p}_spec_char_path"], out[f"{a}_{p}_dom_as_path"] = of(label, "special"), of(label, "same_name")
            for d in DIRECTIVES:
                label, mark = f"{a}|{p}|{d}", "_" if p == "1" else ""
                for part, name in (("pth", "pth_len"), ("qk", "query_len")):
                    n, s, q = (of(label, f"{part}_{x}") for x in ("n", "sum", "squares"))
                    out[f"{a}_{p}_{name}_mean{d}"], out[f"{a}_{p}_{name}_variance{d}"], out[f"{a}_{p}_{name}_max_val{d}"] = mean(s, n), spread(n, s, q), of(label, f"{part}_most")
                for part, name in (("path_e", "path_entropy"), ("key_e", "query_entropy"), ("value_e", "query_val_entropy")):
                    out[f"{a}_{p}_{name}{mark}{d}"] = entropy(label, part)
    out["variant_mismatch_resources_count"] = of("var|both", "mismatched")
    families = (("content_type", "class", urls.CONTENT_CLASSES), ("content_type_mismatch", "wrong", urls.MISMATCHES), ("resource_type", "resource", RESOURCE_TYPES))
    for name, part, kinds in families:
        each = {k: of("var|both", f"{part}_{k}") for k in kinds}
        out |= {f"variant_{name}__{k}": c for k, c in each.items()}
        out[f"variant_{name}"] = " + ".join(c for k, c in each.items() if part != "wrong" or k != "unknown")
    return {k: (F.expr(c) if isinstance(c, str) else c).cast("double") for k, c in out.items()}


def _growth(values: Column) -> Column:
    """Compound growth over the points of an array; see text.growth."""
    n, first, last = F.size(values), F.get(values, 0), F.try_element_at(values, F.lit(-1))
    return F.when((n > 0) & (first > 0), F.pow(last / F.nullif(first, F.lit(0)), 1 / F.nullif(n, F.lit(0))) - 1).otherwise(F.lit(0.0))


def _slope(values: Column) -> Column:
    """Least-squares slope of an array's values over their places; 0 for fewer than two."""
    n = F.size(values)
    middle = (n - 1) / 2
    up = F.aggregate(F.transform(values, lambda v, i: (i - middle) * v), F.lit(0.0), lambda t, x: t + x)
    across = F.aggregate(F.transform(values, lambda v, i: (i - middle) * (i - middle)), F.lit(0.0), lambda t, x: t + x)
    return F.coalesce(up / F.nullif(across, F.lit(0.0)), F.lit(0.0))
