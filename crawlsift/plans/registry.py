"""Named queries over the driver tables and their SQL for DuckDB.

The tables hold no captures, so the queries give events the roles of one: a site, an arm and a trial follow from
user_id, event types are the signals, and pages stand for requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlsift.functions import text as tx
from crawlsift.functions import urls
from crawlsift.operators import diff, features, html, patterns, requests, rules, series
from crawlsift.plans import crawl, groups, more, scalers, slots
from crawlsift.sources import lists

KEY, BINS, STEP = ["site", "arm", "trial"], 240, 3 * 3600 * 1000
SIGNALS = {"views": "view", "clicks": "click", "purchases": "purchase", "errors": "error", "signups": "signup"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, user = _table(spark, sf_dir, "events"), F.col("user_id")
    roles = [(user % 7).alias("site"), (F.floor(user / 7) % 2).alias("arm"), (F.floor(user / 14) % 4).alias("trial"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t")]
    return e.select("event_id", *roles, "event_type", "props", "value")


def bin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    start = e.groupBy("site").agg(F.min("t").alias("t0"))
    counts = {n: F.col("event_type") == v for n, v in SIGNALS.items()}
    return series.binned(e.join(start, "site"), KEY, "t", F.col("t0"), STEP, BINS, counts)


def _of_series(f):
    return lambda spark, sf_dir: f(bin_counts(spark, sf_dir))


def _json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return _events(spark, sf_dir).groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("known"), F.max(k).alias("most"))


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).withColumn("item", F.concat_ws("/", "event_type", "props"))


def _cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.cumulative_distinct(_keyed(spark, sf_dir), ["site", "arm"], "trial", "item", 4)


def _last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diff.last_surplus_events(_keyed(spark, sf_dir), ["site"], "item", ["t", "event_id"], control=0, variant=1)
    return out.select("site", "item", "side", "event_id")


def _growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.growth_and_slope(_cumulative(spark, sf_dir), ["site", "arm"], "trial", "seen")
    return out.withColumns({c: F.round(c, 6) for c in ("growth", "slope")})


def _averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_trial = bin_counts(spark, sf_dir).groupBy(*KEY).agg(F.sum("views").alias("views"), F.sum("errors").alias("blocked"))
    return series.trial_averages(per_trial, ["site"], "arm", ["views", "blocked"], 0, 1)


def _complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.complete_groups(_table(spark, sf_dir, "events"), ["user_id"], ["event_type"], 5)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages").select("page_id", "url").withColumns({"host": urls.host(F.col("url")), "path": urls.path(F.col("url"))})
    return p.withColumns({"registrable": urls.registrable(F.col("host")), "subdomain": urls.subdomain(F.col("host"))})


def _url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).withColumns({"plain": urls.without_query(F.col("url")), "directory": urls.directory(F.col("path")), "query": urls.query(F.col("url"))})


def _query_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).select("page_id", F.explode(F.arrays_zip(urls.query_keys(F.col("url")).alias("key"), urls.query_values(F.col("url")).alias("value"))).alias("p"))
    return rows.select("page_id", "p.key", "p.value")


def _path_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _pages(spark, sf_dir).select("registrable", F.explode(urls.sections(F.col("path"))).alias("section"))
    return each.groupBy("registrable").agg(F.round(F.avg(tx.entropy(F.col("section"))), 6).alias("entropy"), F.count("*").alias("sections"))


def _path_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _pages(spark, sf_dir).select("registrable", "page_id", F.explode(urls.sections(F.col("path"))).alias("s"))
    out = []
    for name, pattern in (("digits", "[0-9]"), ("dashes", "-"), ("letters", "[A-Za-z]"), ("others", "[^A-Za-z0-9-]")):
        n = tx.character_counts(F.col("s"), pattern)
        out += [F.sum(n).cast("long").alias(name), F.max(n).alias(f"most_{name}"), F.floor(F.sum(n) / F.count_distinct("page_id")).alias(f"mean_{name}")]
    return each.groupBy("registrable").agg(*out)


def _subdomains(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _pages(spark, sf_dir).select("registrable", F.explode(urls.subdomain_lengths(F.col("subdomain"))).alias("n"))
    return each.groupBy("registrable").agg(tx.mean_or_zero(F.col("n")).alias("mean"), tx.variance_or_zero(F.col("n")).alias("variance"), tx.max_or_zero(F.col("n")).alias("most"))


def _party(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = urls.first_party(F.col("host"), F.lit("tion"))
    return _pages(spark, sf_dir).groupBy(F.when(own, "first").otherwise("third").alias("party")).agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"))


def _fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).where(F.col("subdomain") != "")
    out = diff.fuzzy_matches(p.where(F.col("page_id") % 2 == 0), p.where(F.col("page_id") % 2 == 1), ["registrable"], "subdomain")
    return out.withColumn("similarity", F.round("similarity", 6))


def _directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).withColumns({"arm": F.col("page_id") % 2, "directory": urls.top_directory(F.col("path"))})
    return diff.count_mismatches(p, [], ["registrable", "directory"], control=0, variant=1)


def _initiated(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).withColumn("initiator", F.concat("host", urls.directory(F.col("path"))))
    return diff.initiated(p, ["registrable"], "url", "initiator").select("page_id", "initiator")


def _link_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "html", urls.host(F.col("url")).alias("host"))
    return html.links(pages, ["page_id", "host"], F.col("host")).drop("host")


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.elements(_table(spark, sf_dir, "pages").select("page_id", "html"))
    return rows.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"), F.max("depth").alias("depth"))


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the elements that the features select, which the table lacks: links around images, links without
    content and frames, in numbers that follow from page_id."""
    p, n = _table(spark, sf_dir, "pages"), F.col("page_id")
    host = urls.host(F.col("url"))
    some = lambda k, text: F.repeat(text, (n % k).cast("int"))
    image = F.concat(F.lit('<div><a href="http://ad.'), host, F.lit('/go?u=1" target="_blank" rel="nofollow"><img src="http://img.'), host, F.lit('/b/c.gif?q=z" width="300"></a></div>'))
    plain = F.lit('<p><a href="/x" target="t"><img src="/y/z.jpg"></a></p>')
    leaf, frame = F.lit('<a href="http://o.com/leaf" rel="x"></a>'), F.lit('<div><iframe src="http://f.org/frame?k=v"></iframe></div>')
    extra = F.concat(some(3, image), some(4, plain), some(5, leaf), some(2, frame))
    return p.select("page_id", "url", F.concat(F.lit("<html><body><main>"), extra, F.lit("</main>"), F.coalesce("html", F.lit("")), F.lit("</body></html>")).alias("html"), host.alias("host"))


def _page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _framed(spark, sf_dir).withColumns({"site_sld": urls.registrable(F.col("host")), "site_word": urls.domain_word(F.col("host")), "trial": F.lit(0)})
    found = html.elements(pages.select("page_id", "trial", "site_sld", "site_word", "html"), eligible=True)
    measured = html.element_measures(html.qualified(html.selected(found), ["page_id", "trial"], "site_sld", "site_word"))
    return html.page_features(measured, pages, ["page_id"], "trial")


def _page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.selected(html.elements(_framed(spark, sf_dir).select("page_id", "html")))
    return found.groupBy("page_id").agg(*(F.count_if(F.col("class") == c).alias(f"n{c}") for c in html.CLASSES))


def _new_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return diff.word_set_difference(d.where("lang = 'fr'"), d.where("lang = 'es'"), "text")


def _changed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").dropDuplicates()
    following = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("new"))
    both = c.join(following, ["conv_id", "turn"])
    return both.groupBy("conv_id").agg(F.sum(F.size(F.split(tx.word_difference(F.col("new"), F.col("text")), " "))).cast("long").alias("words"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("url"), F.col("quality").alias("label"))
    rows = features.labelled(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), truth, "doc_id")
    return rows.groupBy("cv_detect").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


def _pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    p = F.col("o_orderpriority")
    counts = [F.count_if(p == n).alias(f"p{n[0]}") for n in names]
    return _table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(*counts, F.count_if(~p.isin(*names)).alias("others"))


_TYPES = ("text/css", "text/html; charset=utf-8", "image/png", "application/javascript", "application/json", "application/octet-stream", "font/woff2", "text/xml", "video/mp4")
_ENDINGS = (".css", ".js", ".png", ".html", ".json", ".woff2", "")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as responses: the type and the path's ending follow from page_id."""
    pick = lambda v, k: F.element_at(F.array(*map(F.lit, v)), (F.floor(F.col("page_id") / k) % len(v) + 1).cast("int"))
    return _pages(spark, sf_dir).withColumns({"content_type": F.when(F.col("page_id") % 11 != 0, pick(_TYPES, 1)), "path": F.concat("path", pick(_ENDINGS, 9))})


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _typed(spark, sf_dir)
    wrong = urls.content_mismatch(F.col("path"), F.col("content_type"))
    kind = urls.content_class(F.col("content_type"))
    return rows.groupBy(kind.alias("class")).agg(F.count("*").alias("n"), *(F.count_if(wrong[k]).alias(f"wrong_{k}") for k in urls.MISMATCHES))


def _resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return lists.not_done(_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), done, "c_custkey")


def _scaled(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        columns = ["l_quantity", "l_extendedprice", "l_discount"]
        rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *columns)
        fit = features.scale_parameters(rows, columns, how)
        out = features.scaled(rows, fit)
        return out.groupBy("l_linenumber").agg(*(F.round(f(c), 6).alias(f"{n}_{c}") for c in columns for n, f in (("avg", F.avg), ("max", F.max))))

    return run


#: Forms of rules; H is where a page's host goes.
_RULES = (
    "||H^", "||H^$script,image", "@@||H^", "H##.ad", "H,~a.b###top", "H#?#div:has(x)", "H#$#abort-on-property-read y", "H#$#hide-if-contains z", "H#$#hide-if-shadow-contains z",
    "H#$#log abort", "H#$#log", "/x$domain=H|~c.d", "/x$domain=~H|c.d|-e.f", "||H/path", "||H^$third-party", "||H^$popup", "! H", "H#@#.ad", "-H##.x", "/ads/*",
)


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.element_at(F.array(*map(F.lit, _RULES)), (F.col("page_id") % len(_RULES) + 1).cast("int"))
    return _pages(spark, sf_dir).select("page_id", "registrable", F.replace(form, F.lit("H"), F.col("host")).alias("rule"))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ruled(spark, sf_dir)
    return rows.select("page_id", lists.rule_class(F.col("rule")).alias("class"), F.array_join(lists.rule_domains(F.col("rule")), " ").alias("domains"))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = ["||example.net^$image", "||example.org^$third-party", "@@||example.org^$font", "/other/*"]
    known, _ = rules.parsed(spark.createDataFrame([(t,) for t in text], "rule string"))
    kind = F.element_at(F.array(*map(F.lit, ("script", "image", "font"))), (F.col("page_id") % 3 + 1).cast("int"))
    seen = _pages(spark, sf_dir).select("page_id", "host", F.lit("www.example.com").alias("site_host"), kind.alias("resource_type"), (F.col("registrable") != "example.com").alias("third_party_request"))
    return rules.blocked(seen, known, ["page_id"])


#: Forms of general rules; H is where a page's host goes, N its number, D its directory.
_PATTERNS = (
    "||H^*N", "@@||H^$image", "N?page=", "/N.html|", "|http://H/*^N^", "|https:*D/N", "*$font,domain=H", "||H^$third-party,domain=www.H|~m.H", "/N/", "@@-farm.*N", "utm_source=*|", "D/N#$~script",
    "||H^$popup", "@@||H/D/$script", "/en/N*#top|", "||example.*^N?$~third-party", "TH*.example.NET^EN^N$match-case", "H##.ad",
)


def _general_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page gives a rule; all pages are requests that its rules judge."""
    p = _pages(spark, sf_dir)
    form = F.element_at(F.array(*map(F.lit, _PATTERNS)), (F.col("page_id") % len(_PATTERNS) + 1).cast("int"))
    number = F.regexp_extract("path", r"(\d+)", 1)
    text = F.replace(F.replace(F.replace(form, F.lit("H"), F.col("host")), F.lit("N"), number), F.lit("D"), urls.directory(F.col("path")))
    known, _ = patterns.compiled(p.select(text.alias("rule")))
    kind = F.element_at(F.array(*map(F.lit, ("script", "image", "font", "main_frame"))), (F.col("page_id") % 4 + 1).cast("int"))
    seen = p.select("page_id", "url", F.concat(F.element_at(F.array(F.lit("www."), F.lit("m."), F.lit("")), (F.col("page_id") % 3 + 1).cast("int")), "host").alias("site_host"), kind.alias("resource_type"), (F.col("page_id") % 5 > 0).alias("third_party_request"))
    return patterns.judged(seen, known).select("page_id", "blocked")


def _requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as requests of both arms of a site (their registrable domain): headers follow from page_id."""
    n = F.col("page_id")
    pick = lambda k, *v: F.element_at(F.array(*map(F.lit, v)), (F.floor(n / k) % len(v) + 1).cast("int"))
    return _typed(spark, sf_dir).withColumns({
        "arm": F.when(n % 3 == 0, "control").otherwise("variant"),
        "first_party": urls.first_party(F.col("host"), F.lit("tion")),
        "resource_type": pick(2, "script", "image", "main_frame", "Stylesheet"),
        "cache_control": F.when(n % 7 != 0, pick(1, "max-age=60", "no-store", "public, max-age=9", "private,no-cache", "max-age=x", "max-age=99999999")),
        "length": F.when(n % 13 == 0, -1).otherwise(n * 37 % 5000),
    })


def _request_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.request_features(_requested(spark, sf_dir), ["registrable"])


def _request_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _requested(spark, sf_dir).withColumn("site", F.col("page_id") % 5).drop("page_id")
    wide = requests.request_features(rows, ["site"])
    return wide.select("site", *(F.col(f"`{c}`") for c in _request_sql()[0]))


def _worth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _requested(spark, sf_dir)
    keep = requests.worth_keeping(F.lit(False), F.col("cache_control"), F.col("content_type"), F.col("length"))
    return rows.select("page_id", keep.alias("keep"), tx.max_age(F.col("cache_control")).alias("age"), urls.important_resource(F.col("path")).alias("important"))


def _request_sql() -> tuple[list[str], str]:
    """Names of the request features that the SQL below works out, and the SQL."""
    arms, parties = {"ctr": "control", "var": "variant"}, {"1": "first_party", "3rd": "NOT first_party"}
    out: dict[str, str] = {}
    entropy = "list_sum(list_transform(list_distinct(string_split({x}, '')), lambda c: -(len({x}) - len(replace({x}, c, ''))) / len({x}) * log2((len({x}) - len(replace({x}, c, ''))) / len({x}))))"
    for a, arm in arms.items():
        for p, party in parties.items():
            f = f"FILTER (arm = '{arm}' AND {party})"
            out[f"{arm}_{'first' if p == '1' else 'third'}_party_count"] = f"count(*) {f}"
            for d in ("", *requests.DIRECTIVES):
                f = f"FILTER (arm = '{arm}' AND {party}" + (f" AND contains(coalesce(cache_control, 'none'), '{d}'))" if d else ")")
                mark = "_" if p == "1" and d else ""
                out[f"{a}_{p}_path_entropy{mark}{d}"] = f"coalesce(round_even(sum(path_e) {f} / nullif(sum(path_n) {f}, 0), 2), 0)"
                if d:
                    n, s, q = (f"sum(sec_{x}) {f}" for x in ("n", "sum", "squares"))
                    out[f"{a}_{p}_pth_len_mean{d}"] = f"coalesce(round_even({s} / nullif({n}, 0), 2), 0)"
                    out[f"{a}_{p}_pth_len_variance{d}"] = f"coalesce(round_even(({q} - {s} * {s} / nullif({n}, 0)) / nullif({n} - 1, 0), 2), 0)"
                    out[f"{a}_{p}_pth_len_max_val{d}"] = f"coalesce(max(sec_most) {f}, 0)"
    for p, party in parties.items():
        f, name = f"FILTER (arm = 'variant' AND {party})", "first" if p == "1" else "third"
        for c, pattern in (("number", "[0-9]"), ("special_chars", "[^A-Za-z0-9]"), ("upper_chars", "[A-Z]"), ("lower_chars", "[a-z]")):
            each = f"list_transform(secs, lambda s: len(regexp_extract_all(s, '{pattern}')))"
            out[f"variant_{name}_party_{c}_in_path_avg"] = f"coalesce(floor(sum(list_sum({each})) {f} / nullif(count(*) {f}, 0)), 0)"
            out[f"variant_{name}_party_{c}_in_path_max"] = f"coalesce(max(list_max({each})) {f}, 0)"
        for k in urls.CONTENT_CLASSES:
            g = f"FILTER (arm = 'variant' AND {party} AND class = '{k}')"
            out[f"var_ct_{'fp' if p == '1' else 'tp'}_path_entropy__{k}"] = f"coalesce(round_even(sum(path_e) {g} / nullif(sum(path_n) {g}, 0), 2), 0)"
    v = "arm = 'variant'"
    out |= {f"variant_content_type__{k}": f"count(*) FILTER ({v} AND class = '{k}')" for k in urls.CONTENT_CLASSES} | {"variant_content_type": f"count(*) FILTER ({v})"}
    out |= {f"variant_resource_type__{k}": f"count(*) FILTER ({v} AND lower(resource_type) = '{k}')" for k in requests.RESOURCE_TYPES}
    out |= {f"variant_content_type_mismatch__{k}": f"count(*) FILTER ({v} AND wrong_{k})" for k in urls.MISMATCHES}
    sql = f"""WITH {_REQUESTS}, x AS (
      SELECT *, page_id % 5 AS site, list_filter(string_split(path, '/'), lambda s: s <> '') AS secs FROM rq
    ), y AS (
      SELECT *, len(secs) AS path_n, list_sum(list_transform(secs, lambda s: {entropy.format(x='s')})) AS path_e, len(secs) AS sec_n, list_sum(list_transform(secs, lambda s: len(s))) AS sec_sum,
        list_sum(list_transform(secs, lambda s: len(s) * len(s))) AS sec_squares, list_max(list_transform(secs, lambda s: len(s))) AS sec_most FROM x
    ) SELECT site, {", ".join(f'CAST({e} AS DOUBLE) AS "{n}"' for n, e in out.items())} FROM y GROUP BY site"""
    return list(out), sql


FLAGSHIP = "spike_stats"
QUERIES = {
    "bin_counts": bin_counts,
    FLAGSHIP: _of_series(lambda s: series.spike_stats(s, KEY, ["views", "clicks"])),
    "event_freq_parts": _of_series(lambda s: series.frequencies(s, KEY, "views", 5, BINS)),
    "gap_mean": _of_series(lambda s: series.mean_gap(s, KEY, "views", 2).withColumn("mean_gap", F.round("mean_gap", 6))),
    "run_clusters": _of_series(lambda s: series.run_stats(s, KEY, "views").withColumn("mean_run", F.round("mean_run", 6))),
    "block_delay": _of_series(lambda s: series.block_delays(s, KEY, "errors", "views", start="signups").withColumn("mean_delay", F.round("mean_delay", 6))),
    "after_last_event": _of_series(lambda s: series.events_after_last(s, KEY, "errors", ["views", "clicks"])),
    "trial_average_diff": _averages,
    "cumulative_distinct": _cumulative,
    "growth_and_slope": _growth,
    "arm_set_diff": lambda s, d: diff.only_in(_keyed(s, d), ["site"], "item", control=0, variant=1),
    "arm_multiset_diff": lambda s, d: diff.multiset_surplus(_keyed(s, d), ["site"], "item", control=0, variant=1),
    "keep_last_k": _last_events,
    "json_field_agg": _json_fields,
    "completeness_filter": _complete,
    "url_parts": _url_parts,
    "url_query_kv": _query_parts,
    "path_entropy": _path_entropy,
    "path_char_classes": _path_characters,
    "subdomain_stats": _subdomains,
    "party_split": _party,
    "fuzzy_subdomain": _fuzzy,
    "dir_count_mismatch": _directories,
    "substring_self_join": _initiated,
    "link_rank": _link_rank,
    "html_tags": _tags,
    "page_source_features": _page_features,
    "page_classes": _page_classes,
    "header_filter": _worth,
    "request_feature_parts": _request_parts,
    "word_set_diff": _new_words,
    "word_diff_scalar": _changed_words,
    "label_join": _labels,
    "pivot_types": _pivot,
    "mismatch_predicate": _classes,
    "anti_resume": _resume,
    "scale_standard": _scaled("standard"),
    "scale_minmax": _scaled("minmax"),
    "scale_robust": _scaled("robust"),
    "rule_classify": _rules,
    "rule_matching": _matched,
    "rule_patterns": _general_rules,
    "request_features": _request_features,
}

_E = """e AS (
  SELECT event_id, user_id % 7 AS site, (user_id // 7) % 2 AS arm, (user_id // 14) % 4 AS trial, epoch_ms(ts) AS t,
    event_type, props, concat_ws('/', event_type, props) AS item FROM events
)"""
_S = f"""{_E}, st AS (SELECT site, min(t) AS t0 FROM e GROUP BY site), b AS (
  SELECT e.*, CAST(least({BINS - 1}, greatest(0, ceil((t - t0) / {STEP}.0) - 1)) AS INTEGER) AS bin FROM e JOIN st USING (site)
), c AS (
  SELECT site, arm, trial, bin, {", ".join(f"count(*) FILTER (event_type = '{v}') AS {n}" for n, v in SIGNALS.items())} FROM b GROUP BY ALL
), s AS (
  SELECT k.site, k.arm, k.trial, g.bin, {", ".join(f"coalesce({n}, 0) AS {n}" for n in SIGNALS)}
  FROM (SELECT DISTINCT site, arm, trial FROM b) k CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range({BINS})) g
  LEFT JOIN c USING (site, arm, trial, bin)
)"""
_K = "site, arm, trial"
_W = "(PARTITION BY site, arm, trial ORDER BY bin)"
_P = r"""u AS (
  SELECT page_id, url, lower(regexp_extract(url, '^(?:[^:/?#]+:)?(?://([^/?#:]*))?', 1)) AS host,
    regexp_extract(url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages
), p AS (
  SELECT *, string_split(host, '.') AS l, array_to_string(string_split(host, '.')[-2:], '.') AS registrable,
    array_to_string(string_split(host, '.')[:-3], '.') AS subdomain,
    CASE WHEN regexp_replace(regexp_replace(path, '/+$', ''), '/?[^/]*$', '') = '' THEN '/' ELSE regexp_replace(regexp_replace(path, '/+$', ''), '/?[^/]*$', '') END AS directory
  FROM u
)"""
_T = f"""{_P}, ty AS (
  SELECT p.*, CASE WHEN page_id % 11 <> 0 THEN {list(_TYPES)!r}[page_id % {len(_TYPES)} + 1] END AS content_type, path || {list(_ENDINGS)!r}[page_id // 9 % {len(_ENDINGS)} + 1] AS full_path FROM p
), tz AS (
  SELECT *, coalesce(content_type, 'unknown') AS t, lower(full_path) AS e FROM ty
), tc AS (
  SELECT *, CASE WHEN t = 'unknown' OR contains(t, 'octet') THEN 'unknown' WHEN contains(t, 'javascript') THEN 'js' WHEN contains(t, 'html') THEN 'html' WHEN contains(t, 'xml') THEN 'xml'
      WHEN contains(t, 'css') THEN 'css' WHEN contains(t, 'json') THEN 'json' WHEN contains(t, 'image') THEN 'media' WHEN contains(t, 'font') THEN 'font' ELSE 'other' END AS class FROM tz
), tw AS (
  SELECT *, class = 'unknown' AS wrong_unknown, class <> 'unknown' AND e LIKE '%json' AND NOT (contains(t, 'json') OR contains(t, 'javascript')) AS wrong_json,
    class <> 'unknown' AND e LIKE '%.js' AND NOT (contains(t, 'javascript') OR contains(t, 'html') OR contains(t, 'xml')) AS wrong_js,
    class <> 'unknown' AND regexp_matches(e, '\\.(jpg|png|jpeg|gif|tif|woff|woff2)$') AND NOT (contains(t, 'image') OR contains(t, 'font')) AS wrong_media,
    class <> 'unknown' AND e LIKE '%html' AND NOT contains(t, 'html') AS wrong_html, class <> 'unknown' AND e LIKE '%css' AND NOT contains(t, 'css') AS wrong_css FROM tc
)"""
_REQUESTS = f"""{_T}, rq AS (
  SELECT * EXCLUDE (path), full_path AS path, CASE WHEN page_id % 3 = 0 THEN 'control' ELSE 'variant' END AS arm, contains(registrable, 'tion') OR contains(subdomain, 'tion') AS first_party,
    ['script', 'image', 'main_frame', 'Stylesheet'][page_id // 2 % 4 + 1] AS resource_type,
    CASE WHEN page_id % 7 <> 0 THEN ['max-age=60', 'no-store', 'public, max-age=9', 'private,no-cache', 'max-age=x', 'max-age=99999999'][page_id % 6 + 1] END AS cache_control,
    CASE WHEN page_id % 13 = 0 THEN -1 ELSE page_id * 37 % 5000 END AS length FROM tw
)"""
_SECTIONS = "sec AS (SELECT registrable, page_id, unnest(list_filter(string_split(path, '/'), lambda x: x <> '')) AS x FROM p)"


def _spikes(v: str) -> str:
    f = f"FILTER ({v} >= 2)"
    return f"count(*) {f} AS {v}_spikes, coalesce(max({v}) {f}, 0) AS {v}_max, coalesce(min({v}) {f}, 0) AS {v}_min, coalesce(max(bin) {f}, 0) AS {v}_last"


def _scale_sql(centre: str, spread: str) -> str:
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    fit = ", ".join(f"{centre.format(c=c)} AS m_{c}, {spread.format(c=c)} AS d_{c}" for c in columns)
    x = lambda c: f"({c} - m_{c}) / (CASE WHEN d_{c} = 0 THEN 1 ELSE d_{c} END)"
    out = ", ".join(f"round(avg({x(c)}), 6) AS avg_{c}, round(max({x(c)}), 6) AS max_{c}" for c in columns)
    return f"WITH f AS (SELECT {fit} FROM lineitem) SELECT l_linenumber, {out} FROM lineitem CROSS JOIN f GROUP BY l_linenumber"


_CHARS = ", ".join(
    f"CAST(sum(len(regexp_extract_all(x, '{p}'))) AS BIGINT) AS {n}, max(len(regexp_extract_all(x, '{p}'))) AS most_{n}, CAST(floor(sum(len(regexp_extract_all(x, '{p}'))) / count(DISTINCT page_id)) AS BIGINT) AS mean_{n}"
    for n, p in (("digits", "[0-9]"), ("dashes", "-"), ("letters", "[A-Za-z]"), ("others", "[^A-Za-z0-9-]"))
)

ORACLES = {
    "bin_counts": f"WITH {_S} SELECT {_K}, bin, {', '.join(SIGNALS)} FROM s",
    FLAGSHIP: f"WITH {_S} SELECT {_K}, {_spikes('views')}, {_spikes('clicks')} FROM s GROUP BY ALL",
    "event_freq_parts": f"WITH {_S} SELECT {_K}, avg((views >= 1)::INT) AS freq, {', '.join(f'avg((views >= 1)::INT) FILTER (bin * 5 // {BINS} = {k}) AS freq_{k}' for k in range(5))} FROM s GROUP BY ALL",
    "gap_mean": f"WITH {_S}, g AS (SELECT {_K}, bin - lag(bin) OVER {_W} AS gap FROM s WHERE views >= 2), k AS (SELECT DISTINCT {_K} FROM s) SELECT {_K}, round(coalesce(avg(gap), 0), 6) AS mean_gap FROM k LEFT JOIN g USING ({_K}) GROUP BY ALL",
    "run_clusters": f"""WITH {_S}, n AS (SELECT {_K}, bin, views, CASE WHEN bin - lag(bin) OVER {_W} <= 2 THEN 0 ELSE 1 END AS new FROM s WHERE views > 0),
      r AS (SELECT *, sum(new) OVER {_W} AS run FROM n), m AS (SELECT {_K}, run, count(*) FILTER (views >= 2) AS members FROM r GROUP BY ALL HAVING members > 0)
      SELECT {_K}, count(members) AS runs, round(coalesce(avg(members), 0), 6) AS mean_run FROM (SELECT DISTINCT {_K} FROM s) k LEFT JOIN m USING ({_K}) GROUP BY ALL""",
    "block_delay": f"""WITH {_S}, f AS (SELECT *, min(bin) FILTER (signups > 0) OVER (PARTITION BY {_K}) AS f FROM s), g AS (SELECT * FROM f WHERE f IS NULL OR bin >= f),
      m AS (SELECT *, last_value(CASE WHEN errors > 0 THEN bin END IGNORE NULLS) OVER (PARTITION BY {_K} ORDER BY bin ROWS UNBOUNDED PRECEDING) AS block FROM g),
      d AS (SELECT {_K}, block, min(bin) - block AS delay FROM m WHERE errors = 0 AND views >= 2 AND block IS NOT NULL GROUP BY {_K}, block)
      SELECT {_K}, round(coalesce(avg(delay), 0), 6) AS mean_delay, count(delay) AS delays FROM (SELECT DISTINCT {_K} FROM g) k LEFT JOIN d USING ({_K}) GROUP BY ALL""",
    "after_last_event": f"WITH {_S}, l AS (SELECT *, max(bin) FILTER (errors > 0) OVER (PARTITION BY {_K}) AS last FROM s) SELECT {_K}, count(*) FILTER (bin >= last AND greatest(views, clicks) >= 2) AS after_last FROM l GROUP BY ALL",
    "trial_average_diff": f"""WITH {_S}, t AS (SELECT {_K}, sum(views) AS v, sum(errors) AS b FROM s GROUP BY ALL),
      a AS (SELECT site, coalesce(round(avg(v) FILTER (arm = 0), 2), 0) AS control_views, coalesce(round(avg(v) FILTER (arm = 1), 2), 0) AS variant_views,
        coalesce(round(avg(b) FILTER (arm = 0), 2), 0) AS control_blocked, coalesce(round(avg(b) FILTER (arm = 1), 2), 0) AS variant_blocked FROM t GROUP BY site)
      SELECT *, round(variant_views - control_views, 2) AS views_diff FROM a""",
    "cumulative_distinct": f"""WITH {_E}, f AS (SELECT site, arm, item, min(trial) AS trial FROM e GROUP BY ALL), n AS (SELECT site, arm, trial, count(*) AS c FROM f GROUP BY ALL)
      SELECT site, arm, trial, coalesce(c, 0) AS new, CAST(sum(coalesce(c, 0)) OVER (PARTITION BY site, arm ORDER BY trial) AS BIGINT) AS seen
      FROM (SELECT DISTINCT site, arm, range AS trial FROM e CROSS JOIN range(4)) k LEFT JOIN n USING (site, arm, trial)""",
    "growth_and_slope": f"""WITH {_E}, f AS (SELECT site, arm, item, min(trial) AS trial FROM e GROUP BY ALL), n AS (SELECT site, arm, trial, count(*) AS c FROM f GROUP BY ALL),
      q AS (SELECT site, arm, trial, sum(coalesce(c, 0)) OVER (PARTITION BY site, arm ORDER BY trial) AS seen FROM (SELECT DISTINCT site, arm, range AS trial FROM e CROSS JOIN range(4)) k LEFT JOIN n USING (site, arm, trial))
      SELECT site, arm, round(CASE WHEN min_by(seen, trial) = 0 THEN 0 ELSE pow(max_by(seen, trial) / min_by(seen, trial), 0.25) - 1 END, 6) AS growth, round(coalesce(regr_slope(seen, trial), 0), 6) AS slope FROM q GROUP BY ALL""",
    "arm_set_diff": f"""WITH {_E}, a AS (SELECT DISTINCT site, item, arm FROM e) SELECT site, item, CASE WHEN min(arm) = 0 THEN 'control' ELSE 'variant' END AS side FROM a GROUP BY site, item HAVING count(*) = 1""",
    "arm_multiset_diff": f"""WITH {_E}, d AS (SELECT site, item, count(*) FILTER (arm = 1) - count(*) FILTER (arm = 0) AS d FROM e GROUP BY ALL)
      SELECT site, item, CASE WHEN d > 0 THEN 'variant' ELSE 'control' END AS side, abs(d) AS surplus FROM d WHERE d <> 0""",
    "keep_last_k": f"""WITH {_E}, d AS (SELECT site, item, count(*) FILTER (arm = 1) - count(*) FILTER (arm = 0) AS d FROM e GROUP BY ALL),
      r AS (SELECT e.*, d.d, row_number() OVER (PARTITION BY e.site, e.item, e.arm ORDER BY t DESC, event_id DESC) AS r FROM e JOIN d USING (site, item) WHERE (d.d > 0 AND arm = 1) OR (d.d < 0 AND arm = 0))
      SELECT site, item, CASE WHEN d > 0 THEN 'variant' ELSE 'control' END AS side, event_id FROM r WHERE r <= abs(d)""",
    "json_field_agg": "SELECT event_type, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS known, max(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY event_type",
    "completeness_filter": "SELECT user_id, count(DISTINCT event_type) AS parts FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = 5",
    "url_parts": f"WITH {_P} SELECT page_id, url, host, path, registrable, subdomain, regexp_replace(url, '[?#].*$', '') AS plain, directory, query FROM p",
    "url_query_kv": f"""WITH {_P}, q AS (SELECT page_id, unnest(string_split(query, '&')) AS kv FROM p WHERE query <> '')
      SELECT page_id, split_part(kv, '=', 1) AS key, regexp_replace(kv, '^[^=]*=', '') AS value FROM q""",
    "path_entropy": f"""WITH {_P}, {_SECTIONS}, h AS (SELECT registrable, list_sum(list_transform(list_distinct(string_split(x, '')), lambda c: -(len(x) - len(replace(x, c, ''))) / len(x) * log2((len(x) - len(replace(x, c, ''))) / len(x)))) AS h FROM sec)
      SELECT registrable, round(avg(h), 6) AS entropy, count(*) AS sections FROM h GROUP BY registrable""",
    "path_char_classes": f"WITH {_P}, {_SECTIONS} SELECT registrable, {_CHARS} FROM sec GROUP BY registrable",
    "subdomain_stats": f"""WITH {_P}, n AS (SELECT registrable, len(unnest(list_filter(string_split(subdomain, '.'), lambda x: trim(x) <> '' AND x <> 'www'))) AS n FROM p)
      SELECT registrable, coalesce(round_even(avg(n), 2), 0) AS mean, coalesce(round_even(var_samp(n), 2), 0) AS variance, CAST(max(n) AS DOUBLE) AS most FROM n GROUP BY registrable""",
    "party_split": f"WITH {_P} SELECT CASE WHEN contains(registrable, 'tion') OR contains(subdomain, 'tion') THEN 'first' ELSE 'third' END AS party, count(*) AS n, count(DISTINCT host) AS hosts FROM p GROUP BY 1",
    "fuzzy_subdomain": f"""WITH {_P}, x AS (
        SELECT DISTINCT a.registrable, a.subdomain AS l, b.subdomain AS r, 1 - levenshtein(a.subdomain, b.subdomain) / greatest(len(a.subdomain), len(b.subdomain)) AS sim
        FROM (SELECT DISTINCT registrable, subdomain FROM p WHERE subdomain <> '' AND page_id % 2 = 0) a JOIN (SELECT DISTINCT registrable, subdomain FROM p WHERE subdomain <> '' AND page_id % 2 = 1) b USING (registrable)
      ), r AS (SELECT *, row_number() OVER (PARTITION BY registrable, l ORDER BY sim DESC, r) AS n FROM x WHERE sim >= 0.7)
      SELECT registrable, l AS "left", r AS "right", round(sim, 6) AS similarity FROM r WHERE n = 1""",
    "dir_count_mismatch": f"""WITH {_P}, d AS (SELECT registrable, '/' || array_to_string(list_filter(string_split(directory, '/'), lambda x: x <> '')[1:3], '/') AS directory, page_id % 2 AS arm FROM p)
      SELECT registrable, directory, count(*) FILTER (arm = 0) AS n_control, count(*) FILTER (arm = 1) AS n_variant FROM d GROUP BY ALL HAVING n_control > 0 AND n_variant > 0 AND n_control <> n_variant""",
    "substring_self_join": f"""WITH {_P} SELECT a.page_id, a.host || a.directory AS initiator FROM p a
      WHERE EXISTS (SELECT 1 FROM p b WHERE b.registrable = a.registrable AND contains(b.url, a.host || a.directory) AND b.url <> a.url)""",
    "word_set_diff": """WITH w AS (SELECT DISTINCT lang, unnest(regexp_split_to_array(trim(text, E' \\t\\n\\r'), '\\s+')) AS word FROM documents WHERE lang IN ('fr', 'es'))
      SELECT DISTINCT word FROM w WHERE lang = 'fr' AND word <> '' AND word NOT IN (SELECT word FROM w WHERE lang = 'es')""",
    "word_diff_scalar": """WITH c AS (SELECT DISTINCT conv_id, turn, text FROM conversations), b AS (SELECT c.conv_id, c.text AS old, n.text AS new FROM c JOIN c n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1)
      SELECT conv_id, CAST(sum(CASE WHEN coalesce(old, '') = '' THEN len(string_split(coalesce(new, ''), ' ')) WHEN coalesce(new, '') = '' THEN len(string_split(old, ' '))
        ELSE greatest(1, len(list_distinct(list_filter(string_split(new, ' '), lambda w: NOT list_contains(string_split(old, ' '), w))))) END) AS BIGINT) AS words FROM b GROUP BY conv_id""",
    "label_join": "WITH l AS (SELECT doc_id, max(quality) AS y FROM labels GROUP BY doc_id) SELECT coalesce(y, -1) AS cv_detect, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents LEFT JOIN l USING (doc_id) GROUP BY 1",
    "pivot_types": "SELECT o_orderstatus, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{n}') AS p{n[0]}" for n in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + ", count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')) AS others FROM orders GROUP BY o_orderstatus",
    "mismatch_predicate": f"WITH {_T} SELECT class, count(*) AS n, {', '.join(f'count(*) FILTER (wrong_{k}) AS wrong_{k}' for k in urls.MISMATCHES)} FROM tw GROUP BY class",
    "link_rank": f"""WITH {_P}, l AS (
        SELECT DISTINCT p.page_id, p.registrable, p.subdomain, unnest(regexp_extract_all(pages.html, '<a href="([^"]*)">', 1)) AS href FROM p JOIN pages USING (page_id)
      ), f AS (
        SELECT page_id, 'http://' || registrable || href AS link, len(href) - len(replace(href, '/', '')) AS path_depth, subdomain NOT IN ('', 'www') AS other_subdomain, NOT contains(href, '?') AS other_path FROM l
        WHERE starts_with(href, '/') AND href <> '/' AND NOT regexp_matches(href, 'contact|login|terms|help|account|privacy|policies|#|iframe|faq|about|upload|download|subscribe|mailto|signup|[.]')
      )
      SELECT *, len(link) AS length, CAST(row_number() OVER (PARTITION BY page_id ORDER BY path_depth DESC, other_subdomain DESC, other_path DESC, len(link) DESC, link) AS INTEGER) AS place FROM f WHERE other_subdomain OR other_path""",
    "header_filter": f"""WITH {_REQUESTS} SELECT page_id,
      (cache_control IS NULL OR NOT contains(cache_control, 'max-age') OR coalesce(TRY_CAST(regexp_extract(cache_control, 'max-age=([^,:]*)', 1) AS BIGINT) < 3456000, false))
        AND (length = -1 OR CASE WHEN contains(coalesce(content_type, ''), 'image') THEN length > 2048 ELSE length > 100 END) AS keep,
      TRY_CAST(regexp_extract(cache_control, 'max-age=([^,:]*)', 1) AS BIGINT) AS age, regexp_matches(path, '(\\.css|\\.js|\\.png|jpeg|gif|jpg|webp)$') AS important FROM rq""",
    "request_feature_parts": _request_sql()[1],
    "page_classes": "SELECT page_id, page_id % 3 AS n, page_id % 4 AS n_no_rel, page_id % 5 AS n_leaf, page_id % 2 AS n_iframe FROM pages WHERE page_id % 3 + page_id % 4 + page_id % 5 + page_id % 2 > 0",
    "anti_resume": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 200000)",
    "scale_standard": _scale_sql("avg({c})", "stddev_pop({c})"),
    "scale_minmax": _scale_sql("min({c})", "max({c}) - min({c})"),
    "scale_robust": _scale_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
    "rule_matching": f"""WITH {_P} SELECT page_id, NOT (registrable = 'example.org' AND page_id % 3 = 2) AS blocked FROM p
      WHERE (registrable = 'example.net' AND page_id % 3 = 1) OR registrable = 'example.org'""",
    "rule_patterns": rf"""WITH {_P}, t AS (
        SELECT DISTINCT replace(replace(replace({list(_PATTERNS)!r}[page_id % {len(_PATTERNS)} + 1], 'H', host), 'N', regexp_extract(path, '\d+')), 'D', directory) AS r FROM p
      ), o AS (
        SELECT r, starts_with(r, '@@') AS exc, regexp_replace(split_part(r, '$', 1), '^@@', '') AS b, string_split(split_part(r, '$', 2), ',') AS o FROM t WHERE NOT contains(r, '##') AND NOT contains(r, '$popup')
      ), d AS (
        SELECT *, CASE WHEN regexp_matches(b, '^/[0-9]+/$') THEN b[2:-2] ELSE regexp_replace(b, '^[|]+|[|]$', '', 'g') END AS core, list_filter(o, lambda x: x IN ('script', 'image', 'font')) AS types,
          string_split(coalesce(list_filter(o, lambda x: starts_with(x, 'domain='))[1][8:], ''), '|') AS doms FROM o
      ), e AS (
        SELECT *, CASE WHEN list_contains(o, 'match-case') THEN '(?s)' ELSE '(?is)' END || CASE WHEN starts_with(b, '||') THEN '^[A-Za-z][A-Za-z0-9+.-]*:/+([\w.%-]*[.])?' WHEN starts_with(b, '|') THEN '^' ELSE '' END
          || replace(replace(replace(replace(core, '.', '[.]'), '?', '[?]'), '*', '.*'), '^', '([^\w.%-]|\z)') || CASE WHEN ends_with(b, '|') THEN '\z' ELSE '' END AS pattern FROM d
      ), q AS (
        SELECT page_id, url, ['www.', 'm.', ''][page_id % 3 + 1] || host AS site, ['script', 'image', 'font', NULL][page_id % 4 + 1] AS kind, page_id % 5 > 0 AS third FROM p
      ), m AS (
        SELECT page_id, exc, list_filter(doms, lambda x: x <> '' AND NOT starts_with(x, '~')) AS ons, list_filter(doms, lambda x: site = x OR ends_with(site, '.' || x)) AS a,
          list_filter(doms, lambda x: starts_with(x, '~') AND (site = x[2:] OR ends_with(site, '.' || x[2:]))) AS z
        FROM q JOIN e ON regexp_matches(url, pattern) AND (kind IS NULL OR (types = [] OR list_contains(types, kind)) AND NOT list_contains(o, '~' || kind))
          AND NOT (list_contains(o, 'third-party') AND NOT third) AND NOT (list_contains(o, '~third-party') AND third)
      )
      SELECT page_id, NOT bool_or(exc) AS blocked FROM m
      WHERE CASE WHEN a <> [] THEN list_max(list_transform(a, lambda x: len(x))) WHEN ons = [] THEN 0 ELSE -1 END > CASE WHEN z <> [] THEN list_max(list_transform(z, lambda x: len(x) - 1)) ELSE -1 END GROUP BY page_id""",
    "rule_classify": f"""WITH {_P}, r AS (SELECT page_id, replace({list(_RULES)!r}[page_id % {len(_RULES)} + 1], 'H', host) AS r FROM p), d AS (
        SELECT page_id, r, CASE WHEN starts_with(r, '!') OR starts_with(r, '@@') OR contains(r, '$popup') OR contains(r, 'third-party') THEN []
          WHEN contains(r, 'domain=') THEN list_filter(string_split(split_part(r, 'domain=', 2), '|'), lambda x: NOT starts_with(x, '~'))
          WHEN starts_with(r, '||') THEN CASE WHEN contains(r, '^') THEN [split_part(substr(r, 3), '^', 1)] ELSE [] END
          WHEN regexp_matches(r, '#[$?]?#') THEN string_split(regexp_extract(r, '^(.*?)(?:#\\$#|#\\?#|##)', 1), ',') ELSE [] END AS d FROM r)
      SELECT page_id, CASE WHEN starts_with(r, '!') THEN NULL WHEN starts_with(r, '@@') OR contains(r, '#@#') THEN 'whitelist'
        WHEN contains(r, '#$#') THEN CASE WHEN contains(r, 'abort') THEN 'snippet_abort' WHEN regexp_matches(r, 'hide-if-(contains|has-and-matches-style|shadow-contains)') THEN 'snippet_hide' ELSE 'snippet_misc' END
        WHEN contains(r, '#?#') OR contains(r, '##') THEN 'element_hiding' ELSE 'request_blocking' END AS class,
        array_to_string(list_filter(list_transform(d, lambda x: regexp_replace(x, '^-', '')), lambda x: x <> ''), ' ') AS domains FROM d""",
}
QUERIES |= more.QUERIES | slots.QUERIES | groups.QUERIES | scalers.QUERIES
QUERIES["site_rows"], ORACLES["site_rows"] = crawl.site_rows, crawl.SITE_ROWS_SQL
ORACLES |= more.ORACLES | slots.ORACLES | groups.ORACLES | scalers.ORACLES
