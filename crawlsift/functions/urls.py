"""URL parts as Spark expressions. No Python runs per row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Second labels that are public suffixes under country codes, and the codes where they are not, or not all: fixed values.
GENERIC = ("com", "edu", "gov", "net", "org")
NOT_GENERIC = (
    "ae", "at", "be", "bg", "ca", "cc", "ch", "cl", "cz", "de", "dk", "es", "eu", "fi", "fr", "gg", "hu", "id", "ie", "il", "ir", "it", "je", "jp",
    "ke", "kr", "li", "lt", "lu", "me", "nl", "no", "nz", "ro", "rs", "se", "sk", "su", "th", "tk", "tv", "uk", "us", "za",
)
#: Rules of public suffixes beyond these and the general one, that a host's last label is a suffix: fixed values. `*`
#: stands for any label, `!` excepts a host from a rule. Whole lists are tables: with_listed_suffix, with_listed_parts.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk", "sch.uk",
    "ac.jp", "ad.jp", "co.jp", "ed.jp", "go.jp", "gr.jp", "lg.jp", "ne.jp", "or.jp",
    "co.in", "ac.in", "co.kr", "or.kr", "go.kr", "ac.kr", "co.nz", "net.nz", "org.nz", "co.za", "org.za", "net.za", "gov.za", "edu.za",
    "co.id", "or.id", "go.id", "ac.id", "co.il", "org.il", "gov.il", "net.il", "co.th", "or.th", "go.th", "ac.th", "ac.cn",
    "com.fr", "edu.it", "gov.it", "org.hu", "org.se", "com.es", "org.es", "edu.es", "net.me", "org.me", "edu.me", "gov.me", "com.ro", "org.ro",
    "co.ke", "or.ke", "go.ke", "ac.ke", "co.ae", "net.ae", "org.ae", "gov.ae", "gov.ie", "gov.cl", "co.ir", "org.ir", "net.ir", "gov.ir", "co.rs", "org.rs", "edu.rs", "gov.rs",
    "*.ck", "!www.ck", "*.bd", "*.np", "*.mm", "*.kh",
)

_SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def part(url: Column, group: int) -> Column:
    """RFC 3986 part of a URL: 1 scheme, 2 authority, 3 path, 4 query, 5 fragment; absent parts are empty."""
    return F.regexp_extract(url, _SPLIT, group)


def host(url: Column) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.regexp_extract(part(url, 2), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))


def path(url: Column) -> Column:
    """Path without the parameters of its last segment."""
    return F.regexp_replace(part(url, 3), r";[^/]*$", "")


def query(url: Column) -> Column:
    return part(url, 4)


def is_ip(h: Column) -> Column:
    return h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | h.startswith("[")


def suffix_pattern(suffixes: tuple[str, ...] = SUFFIXES) -> str:
    """A host as (subdomain), (domain word), (public suffix): the longest rule wins, exceptions count as no rule.

    The built-in rules go with GENERIC under country codes; a list of one's own stands alone.
    """
    some = lambda r: re.escape(r).replace(r"\*", "[^.]+")
    excepted = [some(r[1:]) for r in suffixes if r.startswith("!")]
    rules = sorted((r for r in suffixes if r[0] != "!" and "." in r), key=lambda r: (-r.count("."), "*" in r, r))
    unless = f"(?!(?:{'|'.join(excepted)})$)" if excepted else ""
    known = "|".join(f"{unless}{some(r)}" if "*" in r else some(r) for r in rules)
    if suffixes == SUFFIXES:
        known += rf"|(?:{'|'.join(GENERIC)})\.(?!(?:{'|'.join(NOT_GENERIC)})$)[a-z][a-z]"
    return rf"^(?:(.*?)\.)??([^.]+)\.({known + '|' if known else ''}[^.]+)$"


def _host_part(h: Column, suffixes: tuple[str, ...], group: int) -> Column:
    return F.when(is_ip(h), F.lit("")).otherwise(F.regexp_extract(h, suffix_pattern(suffixes), group))


def suffix(h: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Public suffix of a host: by the longest rule, else its last label; none for addresses and single labels."""
    return _host_part(h, suffixes, 3)


def domain_word(h: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The label before the public suffix; the whole host for an address or a single label."""
    word = _host_part(h, suffixes, 2)
    return F.when(word == "", h).otherwise(word)


def registrable(h: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """domain.suffix; a trailing dot where there is no suffix."""
    return F.concat(domain_word(h, suffixes), F.lit("."), suffix(h, suffixes))


def subdomain(h: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """What stands before the registrable domain."""
    return _host_part(h, suffixes, 1)


def with_listed_suffix(rows: DataFrame, host: str, rules: DataFrame) -> DataFrame:
    """Adds suffix by a whole list of rules (rule), joined by the tails of the distinct hosts: for lists of any length."""
    hosts = rows.select(F.col(host).alias("_host")).where(~is_ip(F.col("_host"))).distinct().withColumn("_labels", F.split("_host", r"\."))
    tail = lambda i: F.array_join(F.slice("_labels", i, F.size("_labels")), ".")
    wild = lambda i: F.concat_ws(".", F.lit("*"), F.when(i < F.size("_labels"), F.array_join(F.slice("_labels", i + 1, F.size("_labels")), ".")))
    # a tail that is the whole host is none: a registrable domain has a label more
    places = F.when(F.size("_labels") > 1, F.sequence(F.lit(1), F.size("_labels")))
    each = hosts.select("_host", "_labels", F.posexplode(places).alias("_at", "_i"))
    asked = each.select("_host", "_i", F.size("_labels").alias("_n"), tail(F.col("_i")).alias("_tail"), F.explode(F.array(tail(F.col("_i")), wild(F.col("_i")), F.concat(F.lit("!"), tail(F.col("_i"))))).alias("rule"))
    known = asked.join(rules.select("rule").distinct(), "rule")
    excepted = F.max(F.when(F.col("rule").startswith("!"), F.regexp_replace("_tail", r"^[^.]*\.", "")))
    longest = F.max_by(F.when(~F.col("rule").startswith("!") & (F.col("_i") > 1), F.col("_tail")), F.when(~F.col("rule").startswith("!") & (F.col("_i") > 1), F.length("_tail")))
    found = known.groupBy("_host").agg(F.coalesce(excepted, longest).alias("_suffix"))
    joined = rows.join(found, F.col(host) == F.col("_host"), "left").drop("_host")
    general = F.when(is_ip(F.col(host)) | ~F.contains(F.col(host), F.lit(".")), F.lit("")).otherwise(F.substring_index(host, ".", -1))
    return joined.withColumn("suffix", F.coalesce("_suffix", general)).drop("_suffix")


def listed_parts(hosts: DataFrame, host: str, rules: DataFrame) -> DataFrame:
    """(host, suffix, domain_word, registrable, subdomain) of the distinct hosts, by a whole list of rules: the table that
    all other tables of the hosts join. Parts are those of suffix, domain_word, registrable and subdomain."""
    h = F.col(host)
    rows = with_listed_suffix(hosts.select(host).where(h.isNotNull()).distinct(), host, rules)
    before = F.when(F.col("suffix") != "", F.expr(f"left(`{host}`, length(`{host}`) - length(suffix) - 1)"))
    word = F.coalesce(F.nullif(F.substring_index(before, ".", -1), F.lit("")), h)
    rows = rows.withColumns({"domain_word": word, "_before": F.coalesce(before, F.lit(""))})
    above = F.expr("left(_before, greatest(0, length(_before) - length(domain_word) - 1))")
    return rows.select(host, "suffix", "domain_word", F.concat("domain_word", F.lit("."), "suffix").alias("registrable"), above.alias("subdomain"))


def with_listed_parts(rows: DataFrame, host: str, rules: DataFrame) -> DataFrame:
    """rows with suffix, domain_word, registrable and subdomain of their host by a list of rules; columns of these names
    are replaced, null hosts have none. A host of many rows is looked up once."""
    names = ("suffix", "domain_word", "registrable", "subdomain")
    kept = rows.drop(*names)
    return kept.join(listed_parts(rows, host, rules), host, "left").select(*kept.columns, *names)


def bare_host(h: Column) -> Column:
    """Host with every `www.` taken out."""
    return F.replace(h, F.lit("www."), F.lit(""))


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)[?#].*$", "")


def _pairs(url: Column) -> Column:
    """key=value strings of the query, split at &amp; else ; else & ."""
    q = F.regexp_replace(query(url), r"^\?", "")
    at = F.when(q.contains("&amp;"), F.split(q, "&amp;")).when(q.contains(";"), F.split(q, ";")).otherwise(F.split(q, "&"))
    return F.when(q == "", F.array().cast("array<string>")).otherwise(at)


def query_keys(url: Column) -> Column:
    return F.filter(F.transform(_pairs(url), lambda p: F.substring_index(p, "=", 1)), lambda k: k != "")


def query_values(url: Column) -> Column:
    value = lambda p: F.when(F.instr(p, "=") > 0, F.regexp_replace(p, r"^[^=]*=", "")).otherwise(F.lit(""))
    return F.filter(F.transform(_pairs(url), value), lambda v: v != "")


def sections(p: Column) -> Column:
    """Non-empty sections of a path."""
    return F.filter(F.split(p, "/"), lambda s: s != "")


def directory(p: Column) -> Column:
    """Parent directory of a path; the root stays."""
    kept = F.regexp_replace(F.regexp_replace(p, r"/+$", ""), r"/?[^/]*$", "")
    return F.when(kept == "", F.lit("/")).otherwise(kept)


def top_directory(p: Column, levels: int = 3) -> Column:
    """The first levels of the parent directory."""
    return F.concat(F.lit("/"), F.array_join(F.slice(sections(directory(p)), 1, levels), "/"))


def first_party(h: Column, site_word: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The site's domain word is part of the host's registrable domain or subdomain."""
    return F.contains(registrable(h, suffixes), site_word) | F.contains(subdomain(h, suffixes), site_word)


def strict_first_party(h: Column, site_host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    return registrable(h, suffixes) == registrable(site_host, suffixes)


def short_special_section(p: Column) -> Column:
    """Some section is a single non-word character."""
    return F.exists(F.split(p, "/"), lambda s: s.rlike(r"^\W$"))


def long_subdomain_with_digit(sub: Column, least: int = 5) -> Column:
    return (F.length(sub) >= least) & sub.rlike("[0-9]")


def subdomain_lengths(sub: Column) -> Column:
    """Lengths of a subdomain's labels but `www` and blanks."""
    labels = F.filter(F.split(sub, r"\."), lambda s: (F.trim(s) != "") & (s != "www"))
    return F.transform(labels, lambda s: F.length(s))


def absolute(value: Column, site: Column) -> Column:
    """An attribute's value as an absolute URL: http kept, // and / completed, background:url() unwrapped; else null."""
    inner = F.when(value.rlike(r"(?i)background[^:]*:.*url\("), F.regexp_extract(value, r"(?i)url\(\s*['\"]?([^'\")]*)", 1)).otherwise(value)
    return F.when(inner.startswith("http"), inner).when(inner.startswith("//"), F.concat(F.lit("http:"), inner)).when(inner.startswith("/"), F.concat(F.lit("http://"), site, inner))


def cut_at_marker(url: Column, marker: str = "g00") -> Column:
    """URLs with a per-visit marker, cut before it."""
    return F.when(F.contains(url, F.lit(marker)), F.substring_index(url, marker, 1)).otherwise(url)


#: Endings of paths of style sheets, scripts and images; fixed values, some without their dot.
IMPORTANT_ENDINGS = (".css", ".js", ".png", "jpeg", "gif", "jpg", "webp")
#: Endings of media files; fixed values.
MEDIA_ENDINGS = (".jpg", ".png", ".jpeg", ".gif", ".tif", ".woff", ".woff2")
CONTENT_CLASSES = ("unknown", "octet", "json", "js", "media", "html", "css", "xml", "other", "font")
MISMATCHES = ("unknown", "json", "js", "media", "html", "css")


def important_resource(p: Column) -> Column:
    """Style sheets, scripts and images by the path's ending."""
    return F.exists(F.array(*map(F.lit, IMPORTANT_ENDINGS)), lambda e: F.endswith(p, e))


def common_tokens(a: Column, b: Column, least: int = 3) -> Column:
    """Two token arrays share a token of `least` characters or more."""
    return F.exists(F.array_intersect(a, b), lambda t: F.length(t) >= least)


def content_class(content_type: Column) -> Column:
    """One of CONTENT_CLASSES: the first that holds; a missing or octet type is unknown."""
    t = F.lower(F.coalesce(content_type, F.lit("unknown")))
    has = lambda x: F.contains(t, F.lit(x))
    out = F.when((t == "unknown") | has("octet"), "unknown")
    for mark, name in (("javascript", "js"), ("html", "html"), ("xml", "xml"), ("css", "css"), ("json", "json"), ("image", "media"), ("font", "font")):
        out = out.when(has(mark), name)
    return out.otherwise("other")


def content_mismatch(p: Column, content_type: Column) -> dict[str, Column]:
    """For each of MISMATCHES: the path's ending contradicts the content type. Unknown types contradict nothing else."""
    t, path_ = F.lower(F.coalesce(content_type, F.lit("unknown"))), F.lower(p)
    has = lambda *marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(t, m))
    unknown = (t == "unknown") | has("octet")
    script = path_.endswith(".js") & ~has("javascript", "html", "xml")
    media = F.exists(F.array(*map(F.lit, MEDIA_ENDINGS)), lambda e: F.endswith(path_, e)) & ~has("image", "font")
    return {
        "unknown": unknown,
        "json": ~unknown & path_.endswith("json") & ~has("json", "javascript"),
        "js": ~unknown & script,
        "media": ~unknown & ~script & media,
        "html": ~unknown & path_.endswith("html") & ~has("html"),
        "css": ~unknown & path_.endswith("css") & ~has("css"),
    }


def different_path(url: Column, site: Column) -> Column:
    """A link leads to another path than the page's own; trailing slashes do not count."""
    bare = lambda u: F.regexp_replace(path(u), r"/+$", "")
    return bare(url) != bare(site)


def distinct_hosts(rows: DataFrame, url: str, by: list[str], keep_www: bool = False, rules: DataFrame | None = None) -> DataFrame:
    """(by, host, registrable) of the distinct hosts of a table of URLs; by a list of suffix rules, if there is one."""
    h = host(F.col(url))
    out = rows.select(*by, (h if keep_www else bare_host(h)).alias("host")).where(F.col("host") != "").distinct()
    if rules is not None:
        return with_listed_parts(out, "host", rules).select(*by, "host", "registrable")
    return out.withColumn("registrable", registrable(F.col("host")))


def parties(rows: DataFrame, url: str, site_word: Column, rules: DataFrame | None = None) -> DataFrame:
    """Adds host, registrable, subdomain and party (first, third), so that a split keeps each request's host; by a list of
    suffix rules, if there is one."""
    out = rows.withColumn("host", host(F.col(url)))
    if rules is not None:
        out = with_listed_parts(out, "host", rules).drop("suffix", "domain_word")
    else:
        out = out.withColumns({"registrable": registrable(F.col("host")), "subdomain": subdomain(F.col("host"))})
    own = F.contains("registrable", site_word) | F.contains("subdomain", site_word)
    return out.withColumn("party", F.when(own, "first").otherwise("third"))
