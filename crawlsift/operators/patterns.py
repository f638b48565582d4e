"""Matching requests against filter rules of any pattern (`||`, `|`, `*`, `^`, paths, options, exceptions).

An inverted index from pieces of patterns to rules: a URL that matches a rule has every piece that the rule's pattern is
sure to leave in it, so the rule is looked up by the one of its pieces that the fewest URLs have, and its compiled
pattern decides there. No URL meets all rules, no rule all URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsift.functions.text import grams
from crawlsift.operators.rules import TYPES, host_suffixes
from crawlsift.sources.stored import spread, stored

#: Options that are understood besides types and domains; fixed values.
OPTIONS = ("third-party", "~third-party", "match-case", "~match-case", "collapse", "~collapse")
#: Resource types of requests by the name that rules give them; fixed values.
NAMES = {"sub_frame": "subdocument", "xhr": "xmlhttprequest"}
#: What a separator is not, as a character class.
_INNER = r"\p{L}\p{N}_.%-"
_OPTIONS = r"\$(~?[\w-]+(?:=[^,\s]*)?(?:,~?[\w-]+(?:=[^,\s]*)?)*)$"
#: An expression between slashes that is but text.
_TEXT = r"^/(?:[\w%~-]|\\[./-])+/$"
_GRAM = 3
#: Characters of a token's part that a rule is looked up by.
PART = 8
#: Characters of an index that every executor may hold.
SENT = 32 * 2**20
#: URLs that one task cuts into pieces.
URLS = 10_000
_ASKED = ("exception", "types", "other_types", "third_party", "on", "off")


def _lower(text: Column) -> Column:
    """ASCII capitals folded, whatever stands around them."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def compiled(rules: DataFrame, rule: str = "rule") -> tuple[DataFrame, DataFrame]:
    """(distinct rules with their pattern as an expression, their pieces and options; (rule, why) of the others).

    Others are comments and empty or null lines (`comment`), hiding rules and snippets (`element`), rules with an option
    that is not about a request's URL, type, party or site (`option`), and regular expressions (`expression`) but those
    that are mere text. A rule without text (`*`, `^`) has no pieces.
    """
    lines = rules.select(F.trim(F.col(rule)).alias("rule")).distinct()
    bare = F.regexp_replace("rule", "^@@", "")
    named = F.regexp_extract(bare, _OPTIONS, 1)
    rows = lines.withColumns({"_options": F.filter(F.split(F.lower(named), ","), lambda o: o != ""), "_body": F.regexp_replace(bare, _OPTIONS, "")})
    understood = F.forall("_options", lambda o: o.isin(*TYPES, *(f"~{t}" for t in TYPES), *OPTIONS) | o.startswith("domain="))
    why = (
        F.when(F.coalesce(F.col("rule"), F.lit("")).rlike(r"^$|^!|^\["), "comment")
        .when(F.col("rule").rlike("##|#@#|#[?$]#"), "element")
        .when(~understood, "option")
        .when(F.col("_body").rlike("^/.+/$") & ~F.col("_body").rlike(_TEXT), "expression")
    )
    rows = rows.withColumn("why", why)

    text = F.col("_body").rlike(_TEXT)
    body = F.when(text, F.regexp_replace(F.regexp_replace("_body", r"^/|/$", ""), r"\\(.)", "$1")).otherwise(F.col("_body"))
    domains = F.split(F.regexp_replace(F.coalesce(F.get(F.filter("_options", lambda o: o.startswith("domain=")), 0), F.lit("")), "^domain=", ""), r"\|")
    out = rows.where(F.col("why").isNull()).withColumns(
        {
            "exception": F.col("rule").startswith("@@"),
            "types": F.filter("_options", lambda o: o.isin(*TYPES)),
            "other_types": F.filter(F.transform(F.filter("_options", lambda o: o.startswith("~")), lambda o: F.ltrim(o, F.lit("~"))), lambda o: o.isin(*TYPES)),
            "third_party": F.when(F.array_contains("_options", "third-party"), True).when(F.array_contains("_options", "~third-party"), False),
            "on": F.filter(domains, lambda d: (d != "") & ~d.startswith("~")),
            "off": F.transform(F.filter(domains, lambda d: d.startswith("~")), lambda d: F.ltrim(d, F.lit("~"))),
            "_body": body,
            "_start": F.when(text, "").otherwise(F.regexp_extract(body, r"^(\|\|?)", 1)),
            "_end": F.when(text | (F.length(body) < 2), "").otherwise(F.regexp_extract(body, r"(\|)$", 1)),
        }
    )
    core = F.expr("substring(_body, 1 + length(_start), length(_body) - length(_start) - length(_end))")
    out = out.withColumn("_core", F.when(F.col("_body") == F.col("_start"), "").otherwise(core))
    return _with_pieces(out).select("rule", *_ASKED, _expression().alias("pattern"), "pieces"), rows.where("why is not null").select("rule", "why")


def _expression() -> Column:
    literal = F.regexp_replace("_core", r"([\\\[\](){}.+?$|])", r"\\$1")
    free = F.regexp_replace(F.regexp_replace(literal, r"\*+", ".*"), r"\^", rf"(?:[^{_INNER}]|\\z)".replace("\\p", "\\\\p"))
    start = F.when(F.col("_start") == "||", rf"^[A-Za-z][A-Za-z0-9+.-]*:/+(?:[{_INNER}]*[.])?").when(F.col("_start") == "|", "^").otherwise("")
    case = F.when(F.array_contains("_options", "match-case"), "(?s)").otherwise("(?is)")
    return F.concat(case, start, free, F.when(F.col("_end") == "|", r"\z").otherwise(""))


def _marked(mark: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.concat(F.lit(mark), n))


def _with_pieces(rows: DataFrame) -> DataFrame:
    """Host, whole tokens (letters and digits between other characters), ends of tokens that a pattern leaves open (PART
    characters at most: a start, an end, or any place of a token); without all these, runs of three characters of the
    longest text."""
    none = F.array().cast("array<string>")
    core = _lower(F.col("_core"))
    runs = F.filter(F.split(core, r"[*^]+"), lambda r: r != "")
    rows = rows.withColumns(
        {
            "_closed": F.concat(F.when(F.col("_start") == "", "").otherwise("/"), core, F.when(F.col("_end") == "", "").otherwise("/")),
            "_longest": F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"],
        }
    )
    host = F.regexp_extract("_closed", r"^/([a-z0-9_-]+(?:\.[a-z0-9_-]+)*)[\^/:?|]", 1)
    found = lambda before, after: F.regexp_extract_all("_closed", F.lit(f"{before}([a-z0-9%]+){after}"), F.lit(1))
    left, right = "(?<=[^a-z0-9%*])", "(?=[^a-z0-9%*])"
    # an open side is a star or the pattern's own end
    open_left, open_right = r"(?<![^*])", r"(?![^*])"
    starts = F.transform(found(left, open_right), lambda n: F.left(n, F.lit(PART)))
    ends = F.transform(found(open_left, right), lambda n: F.right(n, F.lit(PART)))
    inner = F.flatten(F.transform(found(open_left, open_right), lambda n: F.when(F.length(n) <= PART, F.array(n)).otherwise(grams(n, PART))))
    whole = F.concat(F.when((F.col("_start") == "||") & (host != ""), F.array(F.concat(F.lit("h"), host))).otherwise(none), _marked("t", found(left, right)))
    rows = rows.withColumn("_whole", F.array_distinct(F.concat(whole, _marked("p", starts), _marked("s", ends), _marked("i", inner))))
    some = F.when(F.length("_longest") < _GRAM, F.array("_longest")).otherwise(grams(F.col("_longest"), _GRAM))
    return rows.withColumn("pieces", F.when(F.size("_whole") > 0, F.col("_whole")).when(F.col("_longest").isNull(), none).otherwise(F.array_distinct(_marked("g", some))))


def _pieces_of_url(url: Column, kinds: list[tuple[str, int]]) -> Column:
    """The pieces that patterns may ask of a URL; of those of a fixed length only the kinds (mark, length) that some does."""
    low = _lower(url)
    host = F.regexp_extract(low, rf"^[a-z][a-z0-9+.-]*:/+([{_INNER}]*)", 1)
    parts = [_marked("t", F.regexp_extract_all(low, F.lit("([a-z0-9%]+)"), F.lit(1))), _marked("h", host_suffixes(host))]
    inside = "[a-z0-9%]"
    forms = {"p": rf"(?<!{inside})({inside}{{n}})", "s": rf"({inside}{{n}})(?!{inside})", "i": rf"(?=({inside}{{n}}))"}
    for mark, n in kinds:
        some = grams(low, n) if mark == "g" else F.regexp_extract_all(low, F.lit(forms[mark].replace("{n}", f"{{{n}}}")), F.lit(1))
        parts.append(_marked(mark, some))
    return F.array_distinct(F.concat(*parts))


def matching(seen: DataFrame, patterns: DataFrame, url: str = "url") -> DataFrame:
    """(url, rule): each distinct URL with each rule whose pattern it matches; rules without pieces are left out.

    Pieces are whole tokens and open parts of tokens, so that a number that a rule names is one, whatever stands around it,
    and few URLs meet a rule that they do not match. A rule is looked up by that of its pieces which the fewest URLs have
    (ties: the longest, then by name); a rule with a piece that no URL has is done. The index is stored and its characters
    are summed: up to SENT it is broadcast, beyond that both sides are shuffled by piece, where a frequent piece is a skewed
    join that AQE splits. Null URLs match nothing.
    """
    seen = stored(seen.where(F.col(url).isNotNull()).select(F.col(url).alias("_url")).distinct(), "urls")
    asked = stored(patterns.select("rule", F.explode("pieces").alias("piece")), "pieces")
    kind = asked.select(F.substring("piece", 1, 1).alias("mark"), (F.length("piece") - 1).alias("n"))
    kinds = sorted((r.mark, r.n) for r in kind.where(~F.col("mark").isin("h", "t")).distinct().collect())  # 3 * PART + _GRAM at most
    # outer: else a filter on the arrays' sizes works them out once more; joins drop nulls
    at = spread(seen, URLS).select("_url", F.explode_outer(_pieces_of_url(F.col("_url"), kinds)).alias("piece"))
    counts = at.join(_sent(asked.select("piece").distinct(), "piece"), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("piece")).alias("l"), "piece"))
    chosen = asked.join(counts, "piece", "left").groupBy("rule").agg(rarest.alias("_k")).where("_k.n > 0").select("rule", "_k.piece")
    index = stored(patterns.select("rule", "pattern").join(chosen.withColumnRenamed("piece", "_piece"), "rule"), "index")
    size = index.agg(F.sum(F.length("rule") + F.length("pattern") + F.length("_piece"))).first()[0] or 0
    if size <= SENT:
        index = F.broadcast(index)
    else:  # most pieces of URLs are no rule's: those go before the shuffle where the pieces asked can be sent
        at = at.join(_sent(index.select(F.col("_piece").alias("piece")).distinct(), "piece"), "piece", "left_semi").hint("merge")
    return at.join(index, [F.col("piece") == F.col("_piece"), F.rlike("_url", "pattern")]).select(F.col("_url").alias(url), "rule")


def _sent(names: DataFrame, column: str) -> DataFrame:
    """Names to broadcast if they have SENT characters at most."""
    size = names.agg(F.sum(F.length(column))).first()[0] or 0
    return F.broadcast(names) if size <= SENT else names


def judged(requests: DataFrame, patterns: DataFrame, url: str = "url", site: str = "site_host", resource_type: str = "resource_type", third_party: str = "third_party_request") -> DataFrame:
    """The requests that some rule applies to, with all their columns and blocked: no exception applies.

    A type that rules do not know, or none, and an unknown party are not asked about. Of the domains that a rule names, the
    longest that the site ends with decides; a site that it does not name is ruled out if the rule names others to be on.
    Repeated requests stay; those with a null URL, or that no rule applies to, go.
    """
    kind = F.lower(F.col(resource_type))
    for known, name in NAMES.items():
        kind = F.when(kind == known, name).otherwise(kind)
    of = {"_u": F.col(url), "_s": F.lower(F.coalesce(F.col(site), F.lit(""))), "_t": F.when(kind.isin(*TYPES), kind), "_p": F.col(third_party)}
    asked = requests.where(F.col(url).isNotNull()).withColumns(of)
    contexts = spread(stored(asked.select(*of).distinct(), "contexts"), URLS).withColumn("_sites", host_suffixes(F.col("_s")))
    patterns = stored(patterns, "patterns")
    known = patterns.select("rule", *(F.col(c).alias(f"_{c}") for c in _ASKED), F.size("pieces").alias("_pieces"), F.col("pattern").alias("_pattern"))

    length = lambda names: F.coalesce(F.array_max(F.transform(F.array_intersect(names, "_sites"), lambda d: F.length(d))), F.lit(-1))
    on = F.when(length("_on") > 0, length("_on")).otherwise(F.when(F.size("_on") == 0, 0).otherwise(-1))
    applies = (
        (F.col("_t").isNull() | (((F.size("_types") == 0) | F.array_contains("_types", F.col("_t"))) & ~F.array_contains("_other_types", F.col("_t"))))
        & F.coalesce(F.col("_third_party") == F.col("_p"), F.lit(True))
        & (on > length("_off"))
    )
    ruled = matching(contexts.select("_u"), patterns, "_u").join(known, "rule")
    by_url = contexts.join(ruled, "_u").where(applies).select(*of, "_exception")
    # rules without text meet by the site they name, or by none
    free = known.where("_pieces = 0").drop("rule").distinct().withColumn("_at", F.explode(F.when(F.size("_on") > 0, F.col("_on")).otherwise(F.array(F.lit("")))))
    by_site = contexts.withColumn("_at", F.explode(F.array_distinct(F.concat("_sites", F.array(F.lit("")))))).join(free, "_at").where(applies & F.rlike("_u", "_pattern")).select(*of, "_exception")
    verdict = by_url.unionByName(by_site).groupBy(*of).agg((~F.max("_exception")).alias("blocked"))
    verdict = verdict.select(*(F.col(c).alias(f"_v{c}") for c in of), "blocked")
    same = [F.col(c).eqNullSafe(F.col(f"_v{c}")) for c in of]
    return asked.drop("blocked").join(verdict, same).select(*(c for c in requests.columns if c != "blocked"), "blocked")
