"""Capture files read from disk, request and mutation differences, and lists, with hand-worked expectations."""

import json
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crawlsift.functions import text as tx
from crawlsift.functions import urls
from crawlsift.operators import dom, requests, rules
from crawlsift.sources import captures, lists, sinks


def event(url, t, status=200, headers=(), kind="onCompleted", details=None, rtype="script", **more):
    d = details if details is not None else json.dumps({"statusCode": status, "type": rtype, "responseHeaders": [{"name": n, "value": v} for n, v in headers], **more})
    return {"type": kind, "event": {"tabId": 1, "requestId": "1", "url": url, "requestTime": t, "status": kind, "details": d}}


def capture(root, key, arm, trial, events):
    folder = root / arm
    folder.mkdir(exist_ok=True)
    name = f"site__{key}__trial{trial}--cvwebrequests{'vanilla' if arm == 'control' else ''}.json"
    (folder / name).write_text(json.dumps({"url": "http://news.example.com/", "startTime": "", "endTime": 9, "cvwebrequests": events}))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("captures")
    shared = event("http://cdn.example.com/lib.js", 1.0, headers=[("Content-Type", "text/javascript"), ("Cache-Control", "max-age=3600"), ("content-length", "4000")])
    gone = event("http://a1.ads.example.net/old/banner.png", 2.0, headers=[("content-type", "image/png"), ("Content-Length", "x")], rtype="image")
    for trial in (0, 1):
        capture(root, "k1", "control", trial, [shared, gone, event("http://x.example.com/404", 3.0, status=404)])
        capture(root, "k1", "variant", trial, [shared, shared, event("http://a2.ads.example.net/old/banner.png", 2.0, details="{broken"), event("http://t.example.org/p?a=1&b=2", 4.0, kind="onErrorOccurred", error="net::ERR_BLOCKED_BY_CLIENT")])
    capture(root, "k2", "control", 0, [])
    (root / "control" / "site__k3__trial0--cvwebrequestsvanilla.json").write_text("{not json")
    return str(root)


@pytest.fixture(scope="module")
def events(spark, folder):
    good, _ = captures.read_files(spark, folder, captures.REQUESTS)
    return captures.request_events(good)


def test_files(spark, folder):
    good, bad = captures.read_files(spark, folder, captures.REQUESTS)
    files = captures.inventory(good)
    assert {(r.key, r.arm, r.trial, r.signal) for r in files.collect()} == {("k1", a, t, "requests") for a in ("control", "variant") for t in (0, 1)} | {("k2", "control", 0, "requests")}
    assert bad.count() == 1
    groups = {r.key: r for r in sinks.diff_groups(good, 2).collect()}
    assert not groups["k1"].discard and groups["k2"].discard and len(groups["k1"].control_ids) == 2


def test_requests(events):
    assert captures.blocked_requests(events).count() == 2
    assert events.where("type = 'onCompleted'").count() == 2 * 3 + 2 * 3
    kept = requests.successful(events)
    assert kept.where(F.contains("url", F.lit("404"))).count() == 0 and kept.where(F.contains("url", F.lit("a2."))).count() == 2
    found = {(r.arm, r.url): r for r in requests.url_attributes(events, ["key", "arm"]).collect()}
    lib = found["control", "http://cdn.example.com/lib.js"]
    assert (lib.content_type, lib.cache_control, lib.length, lib.resource_type) == ("text/javascript", "max-age=3600", 4000, "script")
    assert found["control", "http://a1.ads.example.net/old/banner.png"].length == -1


def test_request_difference(events):
    rows = requests.with_url_parts(requests.url_attributes(events, ["key", "arm"]))
    only, folders = requests.request_difference(rows, ["key"], least=0.5)
    got = {(r.side, r.domain_path, r.moved) for r in only.collect()}
    # the variant's a2.ads serves the path that the control's a1.ads served
    assert got == {("control", "a1.ads.example.net/old/banner.png", False), ("variant", "a2.ads.example.net/old/banner.png", True), ("variant", "t.example.org/p", False)}
    assert folders.count() == 0
    parted = rows.withColumn("first_party", urls.first_party(F.col("host"), F.lit("example")))
    f = requests.request_features(parted, ["key"]).first().asDict()
    assert len(f) == 1 + 427
    assert f["control_first_party_count"] + f["control_third_party_count"] == rows.where("arm = 'control'").count()
    assert f["variant_first_party_count"] + f["variant_third_party_count"] == f["variant_content_type"] == rows.where("arm = 'variant'").count()
    assert f["variant_content_type_mismatch"] == sum(f[f"variant_content_type_mismatch__{k}"] for k in urls.MISMATCHES if k != "unknown")
    keep = rows.select(requests.worth_keeping(F.lit(False), F.lit("max-age=99999999"), F.lit("text/css"), F.lit(500)).alias("a"), requests.worth_keeping(F.lit(False), F.lit(None).cast("string"), F.lit("image/png"), F.lit(2048)).alias("b"), requests.worth_keeping(F.lit(False), F.lit("max-age: 9"), F.lit(None).cast("string"), F.lit(-1)).alias("c")).first()
    assert tuple(keep) == (False, False, False)


def node(tag, kind=1, attributes=(), value=None):
    return {"id": "", "NoChildNodes": 0, "NodeType": kind, "NodeValue": value, "nodeName": tag.upper(), "localName": tag, "namespaceURI": "", "parentNode": "", "NodesAttributes": [list(a) for a in attributes]}


def test_mutations(spark, tmp_path):
    added = lambda sel, tag, **k: {"type": "nodes added", "target": json.dumps({"selector": sel}), "nodes": json.dumps([{"selector": tag.upper(), "nodeId": 1}]), "nodeInfo": [[node(tag, **k)]], "parentNode": "html > body"}
    change = lambda name, new: {"type": "attribute changed", "target": json.dumps({"selector": "DIV.a"}), "attribute": name, "oldValue": "", "newValue": new}
    text = {"type": "text changed", "target": json.dumps({"selector": "P"}), "oldValue": "a b", "newValue": "a c d"}
    alert = {"type": "nodes added", "target": "Page", "nodes": '["Alert"]', "nodeInfo": []}
    arms = {
        "control": [added("DIV", "img"), added("DIV", "img"), added("DIV", "img"), change("style", "x"), change("id", "zz"), alert],
        "variant": [added("DIV", "img"), added("DIV", "iframe"), change("abp-blocked-element", "true"), change("anticv-hidden", "1"), text, added("P", "#text", kind=3, value="hello there")],
    }
    for arm, list_ in arms.items():
        (tmp_path / arm).mkdir()
        rows = [{"type": e["type"], "time": i, "event": e} for i, e in enumerate(list_)]
        (tmp_path / arm / f"s__k__trial0--cvdommutation{'vanilla' if arm == 'control' else ''}.json").write_text(json.dumps({"url": "u", "startTime": "", "endTime": 1, "dommutation": rows}))
    good, bad = captures.read_files(spark, str(tmp_path), captures.MUTATIONS)
    assert bad.count() == 0
    keyed = dom.keyed_events(captures.mutation_events(good))
    assert keyed.where("blocked").count() == 1
    left = dom.mutation_difference(keyed)
    assert {(r.side, r.kind, r.tag, r.time) for r in left.collect()} == set([("control", "added", "img", 1), ("control", "added", "img", 2), ("control", "attribute", "", 3), ("variant", "added", "iframe", 1), ("variant", "text", None, 4), ("variant", "added_text", "#text", 5)])
    f = dom.mutation_features(left, keyed, ["key"]).first().asDict()
    assert len(f) == 1 + 291
    some = {k: v for k, v in f.items() if v and k != "key"}
    assert some == {"dom_node_changed_added__iframe": 1, "dom_node_changed_added__total": 1, "dom_text_changed__characters": 3, "dom_text_changed__words": 2, "dom_text_changed__total": 5, "dom_text_changed__node_added": 1}


def test_mutation_keys_and_counts(spark):
    """Keys hold names, counts and lengths, no values; attribute changes count by name and by style."""
    info = {**node("div", attributes=[["class", "abcde"], ["id", "zz"], ["style", "width: 1px; height: 2px"], ["transform", "x"], ["data-a", "qq"]], value="abc"), "NoChildNodes": 2, "parentNode": "body"}
    schema = f"n {captures.NODE}"
    row = spark.createDataFrame([(info,)], schema).select(dom.node_info(F.col("n"))).first()
    assert row[0] == "_NodeNameDIV__ChildCount2__NodeValueLen3__NodeType1_class5style[width][height]transformdata-a2"
    base = {"key": "k", "site": "s", "trial": 0, "target_selector": "DIV.a > P", "target": "", "nodes": None, "nodeInfo": None, "targetType": "DIV", "parentNode": "HTML > Body", "recd": [info]}
    change = lambda arm, place, name, old, new, **k: {**base, "arm": arm, "place": place, "time": place, "type": "attribute changed", "attribute": name, "oldValue": old, "newValue": new, **k}
    events = [
        change("variant", 0, "style", "width: 1px", "width: 2px; display: none"), change("variant", 1, "style", "width: 1px", "width: 2px; display: none"), change("variant", 2, "data-x", "1.5", "2"),
        change("variant", 3, "data-y", "7", "8"), change("variant", 4, "title", "a", "b"), change("variant", 5, "ab", "a", "b"), change("control", 0, "title", "c", "d"), change("control", 1, "title", "e", "f"),
        change("variant", 6, "abp-blocked-element", None, "true", targetType="IFRAME"),
    ]
    kinds = f"key string, site string, trial int, target_selector string, target string, nodes string, nodeInfo array<array<{captures.NODE}>>, targetType string, parentNode string, recd array<{captures.NODE}>, arm string, place int, time bigint, type string, attribute string, oldValue string, newValue string"
    rows = spark.createDataFrame([tuple(e[c.strip().split(" ")[0]] for c in re.split(r", (?=\w+ )(?![^<]*>)", "key string, site string, trial int, target_selector string, target string, nodes string, nodeInfo x, targetType string, parentNode string, recd x, arm string, place int, time bigint, type string, attribute string, oldValue string, newValue string")) for e in events], kinds)
    keyed = dom.keyed_events(rows)
    key = {r.place: r.event_key for r in keyed.where("arm = 'variant'").collect()}
    assert key[4] == f"title__div.a > p__div__body__{row[0].lower()}" and key[2] == key[3] and key[2].startswith("data__")
    f = {k: v for k, v in dom.mutation_features(dom.mutation_difference(keyed), keyed, ["key"]).first().asDict().items() if v and k != "key"}
    # both style changes are one; numbers in values are no difference, so the two data changes are one as well
    assert f == {"dom_attribute_changed__style": 1, "dom_attribute_changed__data": 1, "dom_attribute_changed__display": 1, "dom_attribute_changed___modify_width": 1, "dom_attribute_changed__total": 2, "dom_blocked_elements__iframe": 1}


def test_selector(spark):
    row = spark.range(1).select(dom.simple_selector(F.lit("DIV.a.bb > P#top")), dom.parent_tag(F.lit("html > Body "))).first()
    assert tuple(row) == ("DIV12 > id5", "body")


def test_url_functions(spark):
    u = "HTTPS://user@www.Shop.Example.co.uk:8443/a/b;x=1/c.php;v=2?k=1;k2=#top"
    q = F.lit("http://h.com/?a=1&amp;b=2&c")
    c = F.lit(u)
    row = spark.range(1).select(
        urls.host(c), urls.path(c), urls.registrable(urls.host(c)), urls.subdomain(urls.host(c)), urls.query_keys(c), urls.query_values(c), urls.query_keys(q),
        urls.directory(F.lit("/a/b/c.js")), urls.directory(F.lit("/")), urls.top_directory(F.lit("/a/b/c/d/e")), urls.registrable(F.lit("10.0.0.1")), urls.registrable(F.lit("localhost")),
        urls.without_query(F.lit("http://h/p#?x")), urls.absolute(F.lit("//c.d/e"), F.lit("s.com")), urls.absolute(F.lit("background: url('/i.png')"), F.lit("s.com")),
    ).first()
    assert list(row) == ["www.shop.example.co.uk", "/a/b;x=1/c.php", "example.co.uk", "www.shop", ["k", "k2"], ["1"], ["a", "b"], "/a/b", "/", "/a/b/c", "10.0.0.1.", "localhost.", "http://h/p", "http://c.d/e", "http://s.com/i.png"]


def test_text_functions(spark):
    row = spark.range(1).select(
        tx.entropy(F.lit("aabc")), tx.entropy(F.lit("")), tx.similarity(F.lit("abcd"), F.lit("abxd")), tx.similarity(F.lit(""), F.lit("")), tx.max_age(F.lit("public, max-age=3600")), tx.pixels(F.lit("12px")), tx.pixels(F.lit("50%")),
        tx.style_map(F.lit("color: red; background: url(http://x); color:blue"))["color"], tx.hidden_style(F.lit("x; display : none")), tx.comma_floats(F.lit("1.5,2")), tx.comma_floats(F.lit("1,x")), tx.word_difference(F.lit("a b c"), F.lit("b")),
    ).first()
    assert list(row) == [1.5, None, 0.75, 1.0, 3600, 12, None, "blue", True, True, False, "a c"]


def test_lists(spark, tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert {tuple(r) for r in lists.read_ground_truth(spark, write("truth", "a\n!b\n!a\n")).collect()} == {("a", 1), ("b", 0)}
    assert lists.read_sites(spark, write("sites", "1,a\n2,b\n3,c\n"), 2, 3).count() == 2
    assert [r.url for r in lists.read_sites(spark, str(tmp_path / "sites"), 0, 1, by_rank=False).collect()] == ["a"]
    assert lists.read_tracking(spark, write("tracking", "p;;s;;u;;script\nbad;;line\np;;s;;u;;script\n")).count() == 1
    assert {tuple(r) for r in lists.read_image_sizes(spark, write("sizes", "http://x/i;;10.7;;5\nhttps://x/i;;20;;6\n")).collect()} == {("//x/i", 20, 6)}
    read = lists.read_rules(spark, write("rules", "[Adblock]\n! c\n||a.com^\nb.com,-c.com##.x\n@@||d.com^\ne.com#$#abort-on x\n/p$domain=f.com|~g.com\nh.com#?#div\n"))
    assert {(r["class"], tuple(r.domains)) for r in read.collect()} == {("request_blocking", ("a.com",)), ("element_hiding", ("b.com", "c.com")), ("whitelist", ()), ("snippet_abort", ("e.com",)), ("request_blocking", ("f.com",)), ("element_hiding", ("h.com",))}
    commit = spark.createDataFrame([("--- a",), ("+++ b",), ("-||a.com^",), ("+||a.com^$script",), ("+||b.com^",), ("-||c.com^",)], "line string")
    assert {tuple(r) for r in lists.commit_domains(commit).collect()} == {("a.com", "modified"), ("b.com", "added"), ("c.com", "removed")}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "instances")
    rows = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "id int, v string")
    sinks.insert_absent(spark, rows(1, 1, 2), path, ["id"])
    sinks.insert_absent(spark, rows(2, 3), path, ["id"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    table = spark.createDataFrame([("http://a,b", 2, 1, 1)], "crawl_url string, z int, y int, cv_detect int")
    sinks.feature_csv(table, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["crawl_url", "y", "z", "cv_detect"] and back.first().crawl_url == "http://a__b"


def test_rule_matching(spark):
    text = ["||ads.net^", "||cdn.org^$script,third-party", "||img.io^$~image", "@@||ok.ads.net^", "||t.com^$domain=a.com|~b.a.com", "/banner/*", "##.ad"]
    known, rest = rules.parsed(spark.createDataFrame([(t,) for t in text], "rule string"))
    assert rest.count() == 2
    seen = [(1, "x.ads.net", "a.com", "image", True), (2, "ok.ads.net", "a.com", "image", True), (3, "cdn.org", "a.com", "script", True), (4, "cdn.org", "cdn.org", "script", False), (5, "img.io", "a.com", "image", True), (6, "img.io", "a.com", "font", True), (7, "t.com", "www.a.com", "image", True), (8, "t.com", "b.a.com", "image", True), (9, "myads.net", "a.com", "image", True)]
    table = spark.createDataFrame(seen, "id int, host string, site_host string, resource_type string, third_party_request boolean")
    assert {r.id for r in rules.blocked(table, known, ["id"]).where("blocked").collect()} == {1, 3, 6, 7}


def test_suffixes(spark, tmp_path):
    hosts = ["a.b.xyz", "x.yandex.ru", "foo.jp", "a.foo.co.jp", "www.ck", "q.b.ck", "a.q.b.ck", "localhost", "10.0.0.1", "b.example.com", "x.y.city.kawasaki.jp", "p.q.kawasaki.jp", "a.p.q.kawasaki.jp"]
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r.host: (r.s, r.r, r.u) for r in frame.select("host", urls.suffix(F.col("host")).alias("s"), urls.registrable(F.col("host")).alias("r"), urls.subdomain(F.col("host")).alias("u")).collect()}
    assert got["a.b.xyz"] == ("xyz", "b.xyz", "a") and got["x.yandex.ru"] == ("ru", "yandex.ru", "x") and got["foo.jp"] == ("jp", "foo.jp", "") and got["a.foo.co.jp"] == ("co.jp", "foo.co.jp", "a")
    assert got["www.ck"] == ("ck", "www.ck", "") and got["q.b.ck"] == ("b.ck", "q.b.ck", "") and got["a.q.b.ck"] == ("b.ck", "q.b.ck", "a") and got["localhost"] == ("", "localhost.", "") and got["10.0.0.1"] == ("", "10.0.0.1.", "")
    (tmp_path / "list").write_text("// comment\ncom\njp\nco.jp\n*.kawasaki.jp\n!city.kawasaki.jp\n*.ck\n!www.ck\n")
    rules = lists.read_suffix_rules(spark, str(tmp_path / "list"))
    listed = {r.host: r.suffix for r in urls.with_listed_suffix(frame, "host", rules).collect()}
    assert listed == {"a.b.xyz": "xyz", "x.yandex.ru": "ru", "foo.jp": "jp", "a.foo.co.jp": "co.jp", "www.ck": "ck", "q.b.ck": "b.ck", "a.q.b.ck": "b.ck", "localhost": "", "10.0.0.1": "", "b.example.com": "com", "x.y.city.kawasaki.jp": "kawasaki.jp", "p.q.kawasaki.jp": "q.kawasaki.jp", "a.p.q.kawasaki.jp": "q.kawasaki.jp"}


def test_listed_parts_agree_with_built_in_ones(spark):
    hosts = ["a.shop.foo.com.vn", "foo.edu.cn", "x.gov.in", "a.b.com.de", "q.co.uk", "co.uk", "localhost", "10.0.0.1", "", None, "a.www.ck", "z.a.b.ck", "a.shop.foo.com.vn"]
    frame = spark.createDataFrame([(h, 1) for h in hosts], "host string, suffix int")
    built = [F.col("host"), urls.suffix(F.col("host")).alias("suffix"), urls.domain_word(F.col("host")).alias("domain_word"), urls.registrable(F.col("host")).alias("registrable"), urls.subdomain(F.col("host")).alias("subdomain")]
    rules = spark.createDataFrame([(r,) for r in ("com.vn", "edu.cn", "gov.in", "co.uk", "*.ck", "!www.ck", "co.uk")], "rule string")
    listed = urls.with_listed_parts(frame, "host", rules)
    assert listed.columns == ["host", "suffix", "domain_word", "registrable", "subdomain"]
    assert Counter(map(tuple, listed.collect())) == Counter(map(tuple, frame.select(*built).collect()))
    got = {r.host: (r.registrable, r.subdomain) for r in listed.collect()}
    assert got["a.shop.foo.com.vn"] == ("foo.com.vn", "a.shop") and got["a.b.com.de"] == ("com.de", "a.b") and got["co.uk"] == ("co.uk", "") and got[None] == (None, None)
    seen = spark.createDataFrame([("http://t.foo.com.vn/a",), ("http://foo.net/",)], "url string")
    assert {r.host: (r.registrable, r.party) for r in urls.parties(seen, "url", F.lit("foo.com"), rules).collect()} == {"t.foo.com.vn": ("foo.com.vn", "first"), "foo.net": ("foo.net", "third")}
    assert {r.registrable for r in urls.distinct_hosts(seen, "url", [], rules=rules).collect()} == {"foo.com.vn", "foo.net"}


def test_header_filter(spark):
    cases = [("max-age=60", "text/css", 50, False), ("max-age=60", "text/css", 101, True), ("max-age=x", "text/css", 500, False), (None, "text/css", -1, True), ("public, max-age=9999999", "a", 500, False), ("max-age=1", "x/image-y", 2048, False), ("max-age=1", "image/png", 2049, True), ("private:max-age=5", None, 200, True)]
    frame = spark.createDataFrame(cases, "cache string, type string, length long, want boolean")
    keep = requests.worth_keeping(F.lit(False), F.col("cache"), F.col("type"), F.col("length"))
    assert frame.where(keep != F.col("want")).count() == 0
    assert frame.where(requests.worth_keeping(F.lit(True), F.col("cache"), F.col("type"), F.col("length"))).count() == len(cases)


def test_groups_and_instances(spark, tmp_path):
    (tmp_path / "groups.csv").write_text("URL Crawled,Chunk,cv_detect,a0,b0,c0,d0,a1,b1,c1,d1\nhttp://u,1,0,cr,vr,cm,vm,cr1,,cm1,vm1\n")
    read = lists.read_groups(spark, str(tmp_path / "groups.csv"))
    assert {(r.trial, r.signal, r.arm, r.file) for r in read.collect()} == {(0, "requests", "control", "cr"), (0, "requests", "variant", "vr"), (0, "mutations", "control", "cm"), (0, "mutations", "variant", "vm"), (1, "requests", "control", "cr1"), (1, "mutations", "control", "cm1"), (1, "mutations", "variant", "vm1")}
    files = [(f"/d/{arm}/site__k__trial{t}--cvwebrequests{'vanilla' if arm == 'control' else ''}.json", "http://u") for arm in ("control", "variant") for t in (0, 1)]
    frame = spark.createDataFrame(files, "file string, url string")
    instances = captures.inventory(frame.select("*", *captures.file_parts(F.col("file"))))
    assert {(r.crawl_group_name, r.is_control) for r in instances.collect()} == {("site__k", True), ("site__k", False)} and instances.select("id").distinct().count() == 4
    named = captures.instance_of(instances.select("crawl_group_name", "file_name").unionByName(spark.createDataFrame([("site__k", "none")], "crawl_group_name string, file_name string")), instances)
    assert named.where("instance_id is null").count() == 1 and named.count() == 5
    groups = sinks.diff_groups(instances, 2)
    rows, lacking = captures.group_instances(groups, instances)
    assert {(r.arm, r.trial) for r in rows.collect()} == {("control", 0), ("control", 1), ("variant", 0), ("variant", 1)} and lacking.count() == 0
    _, lacking = captures.group_instances(groups, instances.where("arm = 'control'"))
    assert lacking.count() == 2
    paired = captures.paired_groups(groups, groups)
    assert paired.count() == 1 and len(paired.first().request_control_ids) == 2
    assert captures.paired_groups(groups.withColumn("discard", F.lit(True)), groups).count() == 0
    assert lists.of_group(instances, "site__k", one=True, arm="control").count() == 1 and lists.of_group(instances, "no").count() == 0
    asked = spark.createDataFrame([(instances.first().id,), (5,)], "i long")
    assert sorted(str(r.url) for r in lists.with_url(asked, instances, "i").collect()) == ["None", "http://u"]
    assert {r.source_name for r in captures.source_names(instances).collect()} == {"site__k__trial0.html", "site__k__trial1.html"}


def test_versions_of_groups(spark, tmp_path):
    path = str(tmp_path / "groups")
    rows = lambda *r: spark.createDataFrame(r, "crawl_group_name string, crawl_type string, url string, discard boolean")
    sinks.upsert_groups(spark, rows(("a", "w", "1", False), ("b", "w", "1", False)), path)
    sinks.upsert_groups(spark, rows(("a", "w", "2", False), ("b", "w", "2", True), ("c", "w", "2", False)), path)
    assert {tuple(r) for r in sinks.latest_groups(spark, path).select("crawl_group_name", "url", "discard").collect()} == {("a", "1", False), ("b", "2", True), ("c", "2", False)}
    assert sinks.table_versions(spark, path) == ["v00000000", "v00000001"] and sinks.table_versions(spark, path + "x") == []


def test_an_instance_an_arm(spark):
    files = [("/d/control/site__k__trial0--cvwebrequests.json", "c"), ("/d/variant/site__k__trial0--cvwebrequests.json", "v"), ("/b/variant/site__k__trial0--cvwebrequests.json", "b")]
    rows = captures.inventory(spark.createDataFrame(files, "file string, url string").select("*", *captures.file_parts(F.col("file")))).collect()
    assert {(r.arm, r.url) for r in rows} == {("control", "c"), ("variant", "b")} and len({r.id for r in rows}) == 2


def test_lost_and_competing_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "groups")
    rows = lambda *r: spark.createDataFrame(r, "crawl_group_name string, crawl_type string, url string, discard boolean")
    sinks.upsert_groups(spark, rows(("a", "w", "1", False)), path)
    (tmp_path / "groups" / "data-lost" / "discard=false").mkdir(parents=True)  # a writer that never came to its claim
    (tmp_path / "groups" / "_versions" / ".data-lost").write_text("data-lost")
    sinks.upsert_groups(spark, rows(("b", "w", "1", False)), path)
    assert {r.crawl_group_name for r in sinks.latest_groups(spark, path).collect()} == {"a", "b"}
    # another writer commits between this one's reading and its claim: both writers' rows stay
    claim = sinks._claim

    def late(*args):
        monkeypatch.setattr(sinks, "_claim", claim)
        sinks.upsert_groups(spark, rows(("c", "w", "1", False), ("d", "w", "first", False)), path)
        return claim(*args)

    monkeypatch.setattr(sinks, "_claim", late)
    sinks.upsert_groups(spark, rows(("d", "w", "second", False), ("e", "w", "1", False)), path)
    assert {(r.crawl_group_name, r.url) for r in sinks.latest_groups(spark, path).collect()} == {("a", "1"), ("b", "1"), ("c", "1"), ("d", "first"), ("e", "1")}
    assert len(sinks.table_versions(spark, path)) == 4


def test_commits(spark):
    text = ["diff --git a/list.txt b/list.txt", "index 1..2", "--- a/list.txt", "+++ b/list.txt", "@@ -1 +1 @@", "-||a.com^", "+b.com##.x", "+! note", "diff --git a/README.md b/README.md", "+||c.com^", "diff --git a/l b/l", "+d.com#$#abort-y"]
    frame = spark.createDataFrame([("c1", i, t) for i, t in enumerate(text)], "commit string, n int, line string")
    r = lists.commit_rule_types(frame, ["commit"], "n").first()
    assert (r.request_blocking, r.element_hiding, r.snippet_abort, r.whitelist) == (1, 1, 1, 0)
    h = spark.createDataFrame([("c1", 2)], "commit string, element_hiding int")
    m = lists.merged_histograms([lists.commit_rule_types(frame, ["commit"], "n"), h], ["commit"]).first()
    assert (m.element_hiding, m.request_blocking) == (3, 1)


def test_saved_scalers(spark, tmp_path):
    rows = spark.createDataFrame([(f"http://{i},x", float(i), i % 3 - 1) for i in range(9)], "crawl_url string, a double, cv_detect int")
    p = {"a": (4.0, 2.0)}
    sinks.scaled_csv(rows, p, str(tmp_path / "scaled"))
    assert sinks.load_parameters(spark, str(tmp_path / "scaled" / "scaler")) == p
    back = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "scaled" / "rows"))
    assert back.agg(F.max("a")).first()[0] == 2.0
    sinks.truncated_csv(rows, str(tmp_path / "cut"), ["a"])
    assert spark.read.option("header", True).csv(str(tmp_path / "cut" / "unlabelled")).count() == 3
