"""From captures of page loads to one feature row a site: the main query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.functions import urls
from crawlsift.operators import diff, dom, features, html, requests, series
from crawlsift.sources import captures
from crawlsift.sources.stored import stored

#: Columns that a model was trained on; fixed values.
MODEL_FEATURES = (
    "var_1_path_entropy", "var_1_query_entropy", "var_1_query_val_entropy", "var_1_query_len_varianceprivate", "var_3rd_path_entropyproxy-revalidate",
    "var_1_spec_char_path", "var_3rd_dom_as_path", "var_3rd_path_entropy", "var_3rd_path_entropypublic", "var_3rd_query_entropy",
    "var_3rd_query_val_entropy", "var_3rd_spec_char_path", "var_3rd_pth_len_meanmax-age", "var_ct_fp_path_entropy__media", "var_ct_fp_path_entropy__html",
    "var_ct_fp_path_entropy__json", "var_ct_fp_path_entropy__js", "var_ct_tp_path_entropy__media", "var_ct_fp_subdomain_entropy__css",
    "var_ct_fp_subdomain_entropy__html", "var_ct_fp_subdomain_entropy__js", "var_ct_fp_subdomain_entropy__other", "var_ct_tp_subdomain_entropy__html",
    "var_ct_tp_subdomain_entropy__json", "var_ct_tp_subdomain_entropy__media", "var_ct_tp_subdomain_entropy__unknown",
    "var_ct_tp_subdomain_entropy__other", "var_ct_tp_subdomain_entropy__xml", "var_ct_tp_subdomain_entropy__css", "var_ct_tp_subdomain_entropy__js",
    "variant_content_type", "variant_content_type__css", "variant_content_type__json", "variant_content_type__media", "variant_content_type_mismatch",
    "variant_content_type_mismatch__html", "variant_content_type_mismatch__js", "variant_content_type_mismatch__media",
    "variant_first_party_dash_in_subdomain_count", "variant_first_party_number_in_path_avg", "variant_first_party_upper_chars_in_path_avg",
    "variant_mismatch_resources_count", "variant_ratio_domains_growth_rate", "variant_ratio_urls_growth_rate",
    "variant_third_party_dash_in_subdomain_count", "variant_third_party_upper_chars_in_path_avg", "pagesource_var_adblock_keyword",
    "pagesource_var_text_diff", "pagesource_var_parent_path_entropy", "pagesource_var_parent_depth", "pagesource_var_parent_depth_no_rel",
    "pagesource_var_parent_query_entropy", "pagesource_var_parent_query_val_entropy", "pagesource_var_parent_query_entropy_no_rel",
    "pagesource_var_parent_query_val_entropy_no_rel", "pagesource_var_parent_subdomain_entropy", "pagesource_var_path_entropy_leaf",
    "pagesource_var_subdomain_entropy_leaf", "pagesource_var_subdomain_entropy_no_rel", "pagesource_var_path_entropy_no_rel",
    "pagesource_var_path_entropy_iframe", "pagesource_var_query_entropy_iframe", "pagesource_var_query_val_entropy_iframe",
    "dom_attribute_changed__background", "dom_attribute_changed__class", "dom_attribute_changed__data", "dom_attribute_changed__display",
    "dom_attribute_changed__float", "dom_attribute_changed__height", "dom_attribute_changed__left", "dom_attribute_changed__position",
    "dom_attribute_changed__right", "dom_attribute_changed__src", "dom_attribute_changed__visibility", "dom_blocked_elements__div",
    "dom_node_changed_added__a", "dom_node_changed_added__img", "dom_node_changed_added__others", "dom_node_changed_removed__iframe",
    "dom_node_changed_removed__link", "ts_attribute_changed_cluster_avg_diff", "ts_attribute_changed_min_diff", "ts_nodes_added_cluster_avg_diff",
    "ts_nodes_removed_cluster_avg_diff", "ts_text_changed_cluster_avg_diff", "ts_text_changed_spikes_diff", "ts_blocked_event_freq_second_half",
    "ts_blocked_event_freq_first_half", "pagesourcecorres_var_corresp_iframe_fp", "pagesourcecorres_var_corresp_iframe_tp",
    "pagesourcecorres_var_corresp_img_fp", "pagesourcecorres_var_corresp_img_tp",
)
#: DOM features that a row leaves out; fixed values.
LEFT_OUT = ("dom_node_changed_added__audio", "dom_node_changed_added__header", "dom_node_changed_added__video", "dom_node_changed_removed__audio", "dom_node_changed_removed__header", "dom_node_changed_removed__video")


def with_site(rows: DataFrame, site: str = "site") -> DataFrame:
    """Adds site_host, site_sld (registrable domain) and site_word of the site's URL."""
    rows = rows.withColumn("site_host", urls.host(F.col(site)))
    return rows.withColumns({"site_sld": urls.registrable(F.col("site_host")), "site_word": urls.domain_word(F.col("site_host"))})


def request_growth(events: DataFrame, trials: int) -> DataFrame:
    """(key, arm, growth): of each trial in order, the distinct URLs and hosts seen up to it."""
    by = ["key", "arm"]
    seen = requests.successful(events).where(F.col("url").isNotNull()).select(*by, "trial", "url").distinct().withColumn("host", urls.bare_host(urls.host(F.col("url"))))
    of = lambda c, name: series.cumulative_distinct(seen, by, "trial", c, trials).withColumnRenamed("seen", name).drop("new")
    both = of("url", "urls_seen").join(of("host", "domains_seen"), [*by, "trial"])
    ordered = F.array_sort(F.collect_list(F.struct("trial", "urls_seen", "domains_seen")))
    return both.groupBy(*by).agg(F.transform(ordered, lambda x: F.named_struct(F.lit("urls_seen"), x["urls_seen"].cast("long"), F.lit("domains_seen"), x["domains_seen"].cast("long"))).alias("growth"))


def request_rows(events: DataFrame, trials: int, tracking: DataFrame | None = None) -> DataFrame:
    """What requests.request_features takes, from captures.request_events of both arms.

    URLs that one arm alone has by host and path, without those that merely moved to a similar host; of these the ones
    worth keeping by their headers (variant requests that start others stay in any case), that no tracking list names
    and that the blocker did not stop; and the variant's style sheets, scripts and images in directories used unequally.
    """
    done = events.where(F.col("status") == "onCompleted")
    parts = with_site(requests.with_url_parts(requests.url_attributes(done, ["key", "site", "arm"])))
    parts = parts.withColumn("first_party", F.contains("registrable", F.col("site_word")) | F.contains("subdomain", F.col("site_word")))
    only, unequal = requests.request_difference(parts, ["key"])
    mine = only.where(~F.col("moved")).select("key", "domain_path", F.col("side").alias("arm")).distinct()
    alone = parts.join(mine, ["key", "arm", "domain_path"])
    # requests whose initiator is part of another variant request's URL
    from_url = requests.successful(done).where((F.col("arm") == "variant") & F.col("parsed.initiator").isNotNull()).select("key", "url", F.col("parsed.initiator").alias("initiator"))
    starters = from_url.withColumn("initiator_path", F.concat(urls.bare_host(urls.host(F.col("initiator"))), urls.path(F.col("initiator")))).where(F.col("initiator_path") != "").distinct()
    asking = starters.join(alone.where("arm = 'variant'").select("key", "url"), ["key", "url"], "left_semi")
    saved = diff.initiated(asking, ["key"], "url", "initiator_path").select("key", "url").distinct()
    alone = alone.join(saved.withColumn("_saved", F.lit(True)), ["key", "url"], "left")
    worth = requests.worth_keeping(F.col("first_party"), F.lower("cache_control"), F.col("content_type"), F.coalesce("length", F.lit(-1)))
    alone = alone.withColumn("kept", F.coalesce("_saved", F.lit(False)) & (F.col("arm") == "variant") | worth).drop("_saved")
    if tracking is not None:
        alone = requests.untracked(alone.where("arm = 'variant'"), tracking).unionByName(alone.where("arm = 'control'"))
    stopped = captures.blocked_requests(events).select("key", "arm", "url")
    alone = requests.allowed(alone, stopped, ["key"]).withColumn("mismatched", F.lit(False))
    folders = parts.where("arm = 'variant'").withColumn("directory", urls.top_directory(F.col("path"))).where(urls.important_resource(F.col("path")))
    wrong = folders.join(unequal.select("key", "host", "directory"), ["key", "host", "directory"], "left_semi").drop("directory").withColumns({"kept": F.lit(True), "mismatched": F.lit(True)})
    rows = alone.unionByName(wrong)
    growth = request_growth(done, trials)
    # an arm without a request of its own still has its growth
    return growth.join(rows, ["key", "arm"], "left").withColumns({"kept": F.coalesce("kept", F.lit(False)), "mismatched": F.coalesce("mismatched", F.lit(False)), "first_party": F.coalesce("first_party", F.lit(False)), "subdomain": F.coalesce("subdomain", F.lit("")), "path": F.coalesce("path", F.lit("")), "url": F.coalesce("url", F.lit(""))})


def page_rows(pages: DataFrame, blocked: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(key, 104 page-source and 4 correspondence features).

    Each page is parsed once: its elements are stored, and all features are read from there.

    pages: key, site, arm, trial, html; blocked: (key, trial, url) that the blocker stopped in the variant.
    """
    where = ["key", "trial"]
    found = stored(html.elements(with_site(pages).select("key", "trial", "arm", "site_sld", "site_word", "html")), "elements")
    variant, control = found.where("arm = 'variant'").drop("arm"), found.where("arm = 'control'").drop("arm")
    sources = html.selected(control).select(*where, F.explode(html.value_urls(F.map_filter("attributes", lambda k, _: k == "src"), F.col("site_sld"))).alias("u"))
    sources = sources.groupBy(*where).agg(F.collect_set(urls.without_query(F.col("u"))).alias("control_sources"))
    stopped = blocked.groupBy(*where).agg(F.collect_set("url").alias("stopped"))
    chosen = html.selected(variant).join(sources, where, "left").join(stopped, where, "left")
    measured = html.element_measures(html.qualified(chosen, where, "site_sld", "site_word", sizes, "stopped", "control_sources"))
    trials = pages.where("arm = 'variant'").select(*where)
    out = html.page_features(measured, trials, ["key"], "trial")
    words = html.text_features(["key"], variant, control)
    same = html.corresponding_features(html.corresponding(control, variant, where, "site_sld", "site_word"), trials, ["key"], "trial")
    return out.join(words, "key", "left").join(same, "key", "left").fillna(0)


def mutation_rows(events: DataFrame) -> DataFrame:
    """(key, 291 DOM features); sites without a surplus event have no row."""
    keyed = dom.keyed_events(events)
    return dom.mutation_features(dom.mutation_difference(keyed), keyed, ["key"])


def series_of(mutations: DataFrame, events: DataFrame, trials: int) -> DataFrame:
    """(key, 97 series features) of sites with all trials of both arms."""
    load = ["key", "arm", "trial"]
    rows = series.capture_features(mutations, captures.blocked_requests(events), load)
    return series.series_features(rows, ["key"], "arm", "control", "variant", trials)


def site_rows(request_events: DataFrame, mutation_events: DataFrame, pages: DataFrame, trials: int, truth: DataFrame | None = None, tracking: DataFrame | None = None, sizes: DataFrame | None = None, include_control: bool = False) -> tuple[DataFrame, DataFrame]:
    """(feature rows: crawl_url, the features by family and name, cv_detect; audit of sites that lack a signal).

    The events of captures.request_events and captures.mutation_events, page sources with key, site, arm, trial and html,
    all of both arms. A site with requests, mutations and a series of every trial has a row; the audit says what
    others lack (0 requests, 1 mutations, 2 series). include_control keeps the control's request features.
    """
    wide = requests.request_features(request_rows(request_events, trials, tracking), ["key"])
    names = sorted(c for c in wide.columns if c != "key")
    wide = wide.select("key", *(names if include_control else features.variant_only(names)))
    stopped = captures.blocked_requests(request_events.where("arm = 'variant'")).select("key", "trial", "url").distinct()
    sources = page_rows(pages, stopped, sizes)
    changes = mutation_rows(mutation_events)
    changes = changes.select("key", *features.without(sorted(c for c in changes.columns if c != "key"), LEFT_OUT))
    times = series_of(mutation_events, request_events, trials)
    whole, audit = features.complete_rows([wide.select("key"), mutation_events.select("key").distinct(), times.select("key")], "key")
    site = request_events.groupBy("key").agg(F.min("site").alias("crawl_url"))
    rows = site.join(whole, "key")
    ordered = []
    for part in (wide, sources, changes, times):
        rows = rows.join(part, "key", "left")
        ordered += sorted(c for c in part.columns if c != "key")
    rows = rows.fillna(0)
    rows = features.labelled(rows, truth, "crawl_url") if truth is not None else rows.withColumn("cv_detect", F.lit(-1))
    return rows.select("crawl_url", *(F.col(f"`{c}`") for c in ordered), "cv_detect"), audit
