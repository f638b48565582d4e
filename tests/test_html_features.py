"""Page elements, feature tables, scoring and streams, with hand-worked expectations."""

import pytest
from pyspark.sql import functions as F

from crawlsift.operators import features, html
from crawlsift.streaming import series as streams

PAGE = """<!DOCTYPE html><html><body>
<div><p><a rel="nofollow" target="_blank" href="http://o.net/x?k=v"><img src="http://i.ad.net/ad.png" width="300" height="250"></a><span>near</span></p><ul><li>a</li></ul></div>
<a rel="noopener" href="http://o.net/y"><img src="/small.png" width="119" height="250"></a>
<a rel="no" href="http://o.net/z"><img src="/facebook.png"></a>
<div style="display:none"><p><a rel="no" href="/h"><img src="/hid.png"></a></p></div>
<a target="t" href="http://q.net/own"><img src="/own.png"></a>
<a class="leaf" target="_blank" href="https://c.example.net/d"></a><a target="_blank" href="/words">words</a>
<iframe src="//f.example.net/i"></iframe><iframe></iframe><iframe src="//g.net/tiny" width="1"></iframe><iframe src="http://h.com/self"></iframe>
<a rel="no" target="blank" href="http://o.net/bg"><div style="background-image: url('http://bg.net/b.png')" src="x">text here</div></a>
<footer><a rel="no" href="/f"><img src="/foot.png" abp-blocked-element="true"></a></footer>
<noscript><a rel="no" href="/n"><img src="/n.png"></a></noscript><p>more <b>text</b></body></html>"""


@pytest.fixture(scope="module")
def rows(spark):
    return html.elements(spark.createDataFrame([(1, PAGE, "k"), (2, None, "k"), (3, "", "k"), (4, "<a<<b>&nope;<p", "k")], "page int, html string, tag_ string"))


def test_elements(rows):
    one = rows.where("page = 1")
    assert one.where("tag = 'img'").count() == 7 and one.where("in_noscript and tag = 'img'").count() == 1
    assert rows.where("page in (2, 3)").count() == 0
    deepest = one.where(F.col("attributes")["src"] == "/hid.png").first()
    assert deepest.depth == 5 and deepest.siblings == 0 and deepest.hidden_above and not deepest.hidden
    words = {r.word for r in html.visible_words(["page"], one).collect()}
    assert {"text", "here", "more", "near"} <= words
    first = one.where("tag = 'div'").orderBy("number").first()
    assert one.where(f"number > {first.number} and number <= {first.last}").count() == 6
    link = one.where(F.col("attributes")["src"] == "http://i.ad.net/ad.png").first().link
    assert (link.tag, link.siblings, link.levels, link.before_tag, link.after_tag, link.after_contents, link.word_above) == ("a", 1, 2, None, "ul", 1, False)


def test_deep_pages_stay_small(spark):
    """Unclosed elements are nested, but an element's row does not grow with its depth."""
    page = "<p>" * 5000
    found = html.elements(spark.createDataFrame([(1, page)], "p int, html string"))
    r = found.agg(F.count("*").alias("n"), F.max("depth").alias("d"), F.max("last").alias("last")).first()
    assert (r.n, r.d, r["last"]) == (5000, 4999, 4999)


def test_selection_and_ladder(rows):
    chosen = html.selected(rows.where("page = 1"))
    assert {(r["class"], r.attributes.get("src")) for r in chosen.collect()} == {("", "http://i.ad.net/ad.png"), ("", "/small.png"), ("", "/facebook.png"), ("", "x"), ("_no_rel", "/own.png"), ("_leaf", None), ("_iframe", "//f.example.net/i"), ("_iframe", "http://h.com/self")}
    ready = chosen.withColumns({"site": F.lit("h.com"), "word": F.lit("h")})
    kept = html.qualified(ready, ["page"], "site", "word")
    # too small, a social word, and a frame of the site itself are out; the image among words has no sibling
    assert {(r["class"], r.attributes.get("src")) for r in kept.collect()} == {("", "http://i.ad.net/ad.png"), ("", "x"), ("_no_rel", "/own.png"), ("_leaf", None), ("_iframe", "//f.example.net/i")}
    stopped = html.qualified(ready.withColumn("stopped", F.array(F.lit("http://i.ad.net/ad.png"), F.lit("http:https://c.example.net/d"), F.lit("https://c.example.net/d"))), ["page"], "site", "word", blocked="stopped")
    assert {(r["class"], r.attributes.get("src")) for r in stopped.collect()} == {("", "x"), ("_no_rel", "/own.png"), ("_iframe", "//f.example.net/i")}
    sizes = ready.sparkSession.createDataFrame([("//h.com/own.png", 50, 50)], "url string, width int, height int")
    assert html.qualified(ready, ["page"], "site", "word", sizes).where("class = '_no_rel'").count() == 0
    own = ready.where("class = '_no_rel'").withColumns({"site": F.lit("q.net"), "word": F.lit("q"), "there": F.array(F.lit("http://q.net/own.png"))})
    assert html.qualified(own, ["page"], "site", "word").count() == 1 and html.qualified(own, ["page"], "site", "word", control="there").count() == 0
    measured = html.element_measures(kept)
    trials = ready.sparkSession.createDataFrame([(1, 0), (1, 1)], "page int, trial int")
    f = html.page_features(measured.withColumn("trial", F.lit(0)), trials, ["page"], "trial").first().asDict()
    assert len(f) == 1 + 100
    # one of two trials has elements: halves
    assert f["pagesource_var_sld_mm_with_parent_count"] == 1.0 and f["pagesource_var_parent_sibling_count"] == 7.0 and f["pagesource_var_parent_depth"] == 0.5
    assert f["pagesource_var_ancestor_next_tag_count_ul"] == 0.5 and f["pagesource_var_ancestor_next_children"] == 0.25 and f["pagesource_var_ancestor_previous_tag_count_div"] == 0.0 and f["pagesource_var_subdomain_entropy_leaf"] == 0.0


def test_text_features(spark):
    pages = spark.createDataFrame([("s", "v", "<p>please Disable now</p><script>x</script>"), ("s", "c", "<p>please</p><noscript>now</noscript>")], "site string, arm string, html string")
    e = html.elements(pages)
    f = html.text_features(["site"], e.where("arm = 'v'"), e.where("arm = 'c'")).first()
    assert (f.pagesource_var_text_diff, f.pagesource_var_characters, f.pagesource_var_adblock_keyword, f.pagesource_var_new_lines) == (1, 7, 1, 0)


def test_correspondence(spark):
    frame = lambda x: f'<html><body><div id="slot" class="{x}"><iframe src="http://o.net/f"></iframe></div><div><iframe src="http://h.com/f"></iframe></div></body></html>'
    variant = '<html><body><div id="slot" class="a"><img src="1"><p><img src="2"></p><img src="3" width="5"></div><div><iframe></iframe></div></body></html>'
    make = lambda text: html.elements(spark.createDataFrame([(1, 0, text)], "page int, trial int, html string")).withColumns({"site": F.lit("h.com"), "word": F.lit("h")})
    # a div after another differs by its place; the second slot is the site's own
    r = html.corresponding(make(frame("a")), make(variant), ["page", "trial"], "site", "word").first()
    assert (r.corresp_img_tp, r.corresp_iframe_tp, r.corresp_img_fp, r.corresp_iframe_fp) == (2, 0, 0, 1)
    loose = html.corresponding(make(frame("other")), make(variant), ["page", "trial"], "site", "word").first()
    assert loose.corresp_img_tp == 2
    few = html.corresponding(make(frame("a")), make(variant), ["page", "trial"], "site", "word", most=0).first()
    assert few.corresp_img_tp == 0
    f = html.corresponding_features(html.corresponding(make(frame("a")), make(variant), ["page", "trial"], "site", "word"), spark.createDataFrame([(1, 0), (1, 1)], "page int, trial int"), ["page"], "trial").first()
    assert f.pagesourcecorres_var_corresp_img_tp == 1.0


def test_links(spark):
    page = "".join(f'<a href="{h}">x</a>' for h in ("/a/b/c", "/d", "#f", "javascript:1", "/", "/x.html", "/about/us", "http://blog.shop.com/", "http://blog.shop.com/p?q=1", "http://other.net/a", "/e#part", "http://shop.com/long/er", "/d?q=1")) + '<a rel="x" href="/r">3</a>'
    found = html.links(spark.createDataFrame([(1, page)], "p int, html string"), ["p"], F.lit("www.shop.com"))
    assert [(r.link, r.path_depth, r.other_subdomain) for r in found.orderBy("place").collect()] == [("http://shop.com/a/b/c", 3, False), ("http://shop.com/long/er", 2, False), ("http://blog.shop.com/p?q=1", 1, True), ("http://shop.com/d", 1, False)]


def test_feature_tables(spark):
    assert features.without(["a", "b_x", "c"], ["a"], ["_x"]) == ["c"] and features.variant_only(["var_a", "control_b", "variant_c"]) == ["var_a", "variant_c"]
    a, b = spark.createDataFrame([("u", 1), ("v", 2)], "site string, x int"), spark.createDataFrame([("u", 5)], "site string, y int")
    joined = {r.site: (r.x, r.y) for r in features.feature_row([a, b], "site").collect()}
    assert joined == {"u": (1, 5), "v": (2, 0)}
    whole, lacking = features.complete_rows([a, b], "site")
    assert [r.site for r in whole.collect()] == ["u"] and [(r.site, r.missing) for r in lacking.collect()] == [("v", [1])]
    truth = spark.createDataFrame([("u", 0), ("u", 1)], "url string, label int")
    rows = features.labelled(a, truth, "site")
    assert {r.site: r.cv_detect for r in rows.collect()} == {"u": 1, "v": -1}
    known, unknown = features.training_split(rows.unionByName(spark.createDataFrame([("w", 0, 1)], "site string, x int, cv_detect int")), ["x"])
    assert [r.site for r in known.collect()] == ["u"] and [r.site for r in unknown.collect()] == ["v"]
    categories = spark.createDataFrame([("u", "en", "News;Sport"), ("v", "en", "Adult")], "domain string, language string, categories string")
    assert [r.site for r in features.in_categories(a, categories, "site", ["en"], ["News"], ["Adult"]).collect()] == ["u"]


def test_scaling_and_scores(spark):
    rows = spark.createDataFrame([(float(i), float(i % 2), i % 2) for i in range(40)], "a double, b double, cv_detect int")
    p = features.scale_parameters(rows, ["a"], "minmax")
    assert features.scaled(rows, p).agg(F.min("a"), F.max("a")).first() == (0.0, 1.0)
    q = [r.a for r in features.quantile_scaled(rows, rows, ["a"], 10).orderBy("a").collect()]
    assert q[0] == 0.0 and q[-1] == 1.0 and q == sorted(q)
    skewed = rows.select((F.exp(F.col("a") / 4)).alias("a"))
    assert features.fit_power(skewed, "a") < 0.5 and -0.5 <= features.fit_power(rows.select(F.randn(1).alias("a")), "a") <= 2
    model = features.train_classifier(rows, ["a", "b"])
    out = features.scored(rows, model, ["a", "b"])
    assert out.where("predicted = cv_detect").count() == 40 and out.columns == ["a", "b", "cv_detect", "score", "predicted"]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("x", "2024-01-01 00:00:10"), ("x", "2024-01-01 00:00:50"), ("y", "2024-01-01 00:01:00"), ("x", "2024-01-01 02:00:00")], "site string, t string").withColumn("t", F.to_timestamp("t"))
    path = str(tmp_path / "in")
    rows.write.parquet(path)
    source = spark.readStream.schema(rows.schema).parquet(path)

    def run(df, name):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        return {(r.site, r.n) for r in spark.table(name).collect()}

    assert ("x", 2) in run(streams.windowed_counts(source, "t", "1 minute", "1 minute", ["site"]), "w")
    assert {("x", 2), ("y", 1)} <= run(streams.sessions(source, "t", "5 minutes", "1 minute", ["site"]), "s")
