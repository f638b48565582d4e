"""From capture files of a small crawl to feature rows: names, counts and hand-worked values."""

import json

import pytest
from pyspark.sql import functions as F

from crawlsift.operators import series
from crawlsift.plans import site_rows
from crawlsift.sources import captures

TRIALS = 2


def request(url, at, status=200, kind="script", headers=(), initiator=None, event="onCompleted", error=None):
    details = {"statusCode": status, "type": kind, "responseHeaders": [{"name": n, "value": v} for n, v in headers]}
    if initiator:
        details["initiator"] = initiator
    if error:
        details = {"error": error}
    return {"type": event, "event": {"tabId": 1, "requestId": "1", "url": url, "requestTime": at, "status": event, "details": json.dumps(details)}}


def node(tag, kind=1):
    return {"id": "", "NoChildNodes": 0, "NodeType": kind, "NodeValue": None, "nodeName": tag.upper(), "localName": tag, "namespaceURI": "", "parentNode": "", "NodesAttributes": []}


def added(at, tag, selector="BODY", kind=1):
    return {"type": "event", "time": at, "event": {"type": "nodes added", "target": json.dumps({"selector": selector}), "nodes": json.dumps([{"selector": tag.upper(), "nodeId": 2}]), "nodeInfo": [[node(tag, kind)]], "targetType": "BODY"}}


def changed(at, attribute, new, tag="DIV"):
    return {"type": "event", "time": at, "event": {"type": "attribute changed", "target": json.dumps({"selector": "DIV"}), "targetType": tag, "attribute": attribute, "oldValue": "", "newValue": new, "recd": [node("div")]}}


def loaded(at):
    return {"type": "event", "time": at, "event": {"type": "DOMContentLoaded"}}


PAGES = {
    "control": "<html><body><main><div id='s'><iframe src='http://ads.net/f'></iframe></div></main><p>same</p></body></html>",
    "variant": "<html><body><main><div id='s'><img src='/a.png' width='300' height='250'></div></main><p>same</p><p>adblocker detected</p><a href='http://go.net/x?u=12' rel='nofollow'><img src='http://cdn.shop.com/b.png'></a></body></html>",
}


@pytest.fixture(scope="module")
def crawl(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("crawl")
    cached = [("Content-Type", "application/javascript"), ("Cache-Control", "public, max-age=60"), ("Content-Length", "500")]
    for arm in ("control", "variant"):
        for t in range(TRIALS):
            tail = "vanilla" if arm == "control" else ""
            stem = f"shop.com__k1__trial{t}"
            (root / arm).mkdir(exist_ok=True)
            calls = [request("http://shop.com/", 1000.0, kind="main_frame"), request("http://shop.com/js/app.js", 1010.0, headers=cached), request("http://shop.com/gone", 1020.0, 404)]
            calls.append(request("http://tiny.net/p.gif", 1030.0, kind="image", headers=[("content-type", "image/gif"), ("content-length", "43")]) if arm == "variant" else request("http://ads.net/ad.js", 1030.0, headers=cached))
            if arm == "variant":
                calls += [request("http://x1.new.net/Ab-9/t.js?k1=vv&k=w", 1040.0 + t, headers=cached), request("http://static.shop.com/-/detect.js", 1041.0, headers=[*cached[:1], ("cache-control", "private")]), request("http://ads.net/ad.js", 1042.0, event="onErrorOccurred", error="net::ERR_BLOCKED_BY_CLIENT")]
            (root / arm / f"{stem}--cvwebrequests{tail}.json").write_text(json.dumps({"url": "http://shop.com/", "startTime": "1", "endTime": 2, "cvwebrequests": calls}))
            events = [loaded(1100), added(1150, "div"), added(1151, "div")]
            if arm == "variant":
                events += [changed(1200, "abp-blocked-element", "true", "IFRAME"), changed(1210, "anticv-hidden", "true"), *(added(1420 + i, "img") for i in range(3)), changed(1430, "style", "display: none"), changed(26050, "src", "http://f/", "IFRAME")]
            (root / arm / f"{stem}--cvdommutation{tail}.json").write_text(json.dumps({"url": "http://shop.com/", "startTime": "1", "endTime": 2, "dommutation": events}))
            (root / arm / f"{stem}.html").write_text(PAGES[arm])
    good, bad = captures.read_files(spark, str(root), captures.REQUESTS + ", " + captures.MUTATIONS.split(",", 4)[-1].strip())
    assert bad.count() == 0
    calls, changes = captures.request_events(good.where("signal = 'requests'")), captures.mutation_events(good.where("signal = 'mutations'"))
    sources = captures.with_sources(good, captures.read_sources(spark, str(root))).withColumn("site", F.lit("http://shop.com/"))
    return calls, changes, sources


def test_series_of_a_load(crawl):
    calls, changes, _ = crawl
    rows = series.capture_series(changes, captures.blocked_requests(calls), ["key", "arm", "trial"]).where("arm = 'variant' and trial = 0")
    assert rows.count() == 250
    got = {r.bin: {k: v for k, v in r.asDict().items() if k in series.COUNTERS and v} for r in rows.collect() if any(r[c] for c in series.COUNTERS)}
    # the load starts with the blocked request at 1042; both ends of a bin belong to it, the earlier one wins
    assert got == {
        0: {"blocked": 1, "web_req_blocked": 1, "dom_content_loaded": 1},
        1: {"blocked": 1, "elem_blocked": 1, "iframe_blocked": 1, "nodes_added": 2, "total_changes": 2},
        3: {"nodes_added": 3, "attribute_changed": 1, "total_changes": 4},
        249: {"attribute_changed": 1, "iframe_src_changed": 1, "total_changes": 1},
    }
    f = series.trial_features(rows, ["key", "arm", "trial"]).first().asDict()
    assert len(f) == 3 + 58
    assert (f["ts__last_time"], f["ts_nodes_added_cluster_avg"], f["ts_nodes_added_max"], f["ts_nodes_added_min"], f["ts_nodes_added_spikes"]) == (300.0, 2.0, 3.0, 2.0, 2.0)
    assert f["ts_blocked_event_freq_first_half"] == 2 / 125 and f["ts_blocked_time_between_first_half"] == 1.0 and f["ts_blocked_event_freq_first_fifth"] == 0.04
    assert f["ts__spikes_after_domloaded"] == 2.0 and f["ts__spikes_after_last_iframe_blocked"] == 2.0 and f["ts__spikes_after_last_iframe"] == 0.0
    file = series.series_rows(rows, ["key"]).orderBy("bin_norm").first()
    assert file.bin_norm == 0 and file.Date == "1970-01-01T00:00:01.042" and len(file) == 15


def test_site_rows(spark, crawl):
    calls, changes, sources = crawl
    truth = spark.createDataFrame([("http://shop.com/", 1)], "url string, label int")
    rows, audit = site_rows.site_rows(calls, changes, sources, TRIALS, truth)
    assert len(rows.columns) == 754 and rows.columns[0] == "crawl_url" and rows.columns[-1] == "cv_detect"
    assert set(site_rows.MODEL_FEATURES) <= set(rows.columns) and len(set(site_rows.MODEL_FEATURES)) == 92
    assert audit.count() == 0
    f = rows.first().asDict()
    assert f["crawl_url"] == "http://shop.com/" and f["cv_detect"] == 1
    # the variant alone has the pixel (too small), the new script and the site's own detector
    assert f["variant_third_party_count"] == 1 and f["variant_first_party_count"] == 1 and f["variant_content_type__js"] == 2
    assert f["var_3rd_query_len_meanpublic"] == 1.5 and f["var_3rd_query_len_max_valmax-age"] == 2 and f["var_1_spec_char_path"] == 1 and f["var_3rd_spec_char_path"] == 0
    assert f["variant_third_party_number_in_path_max"] == 1 and f["variant_third_party_upper_chars_in_path_avg"] == 1 and f["variant_third_party_number_in_subdomain_count"] == 1
    assert f["variant_trials_urls"] == 5 and f["dom_node_changed_added__img"] == 6 and f["dom_node_changed_added__total"] == 6
    assert f["dom_attribute_changed__display"] == 1 and f["dom_attribute_changed__src"] == 1 and f["dom_blocked_elements__iframe"] == 2
    assert f["pagesource_var_text_diff"] == 2 and f["pagesource_var_adblock_keyword"] == 1 and f["pagesource_var_parent_query_entropy"] == 0.0 and f["pagesource_var_parent_query_val_entropy"] == 1.0
    assert f["pagesourcecorres_var_corresp_img_tp"] == 1.0 and f["ts_nodes_added_spikes_diff"] == 1.0 and f["ts_blocked_spikes"] == 2.0
    wide, lacking = site_rows.site_rows(calls, changes.where("trial = 0"), sources, TRIALS, include_control=True)
    assert len(wide.columns) == 754 + 427 - 262
    assert [r.missing for r in lacking.collect()] == [[2]]
