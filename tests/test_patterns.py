"""General filter rules against a matcher that tries every rule on every URL."""

import random
import re

import pytest
from pyspark.sql import functions as F

from crawlsift.operators import patterns

INNER = re.compile(r"[\w.%-]", re.UNICODE)
SCHEMA = "id int, url string, site_host string, resource_type string, third_party_request boolean"


def found_at(body: str, url: str, at: int, ends: bool) -> bool:
    """Whether the pattern's text matches from a place on: by backtracking, without expressions."""
    if not body:
        return not ends or at == len(url)
    if body[0] == "*":
        return any(found_at(body[1:], url, i, ends) for i in range(at, len(url) + 1))
    if body[0] == "^":
        if at == len(url):
            return found_at(body[1:], url, at, ends)
        return not INNER.match(url[at]) and found_at(body[1:], url, at + 1, ends)
    return at < len(url) and body[0] == url[at] and found_at(body[1:], url, at + 1, ends)


def brute(rule: str, url: str) -> bool:
    """A rule without options on a URL."""
    body, url = rule.removeprefix("@@").lower(), url.lower()
    ends = len(body) > 1 and body.endswith("|")
    body = body[:-1] if ends else body
    if body.startswith("||"):
        scheme = re.match(r"[a-z][a-z0-9+.-]*:/+", url)
        if not scheme:
            return False
        first = range(1, scheme.end() - url.index("/") + 1)
        starts = {url.index("/") + k for k in first}
        for s in list(starts):
            i = s
            while i < len(url) and INNER.match(url[i]):
                i += 1
                if url[i - 1] == ".":
                    starts.add(i)
        return any(found_at(body[2:], url, s, ends) for s in starts)
    if body.startswith("|"):
        return found_at(body[1:], url, 0, ends)
    return any(found_at(body, url, s, ends) for s in range(len(url) + 1))


@pytest.fixture(scope="module")
def random_cases():
    rng = random.Random(5)
    words = ["ad", "ads", "banner", "x", "img", "net", "com", "example", "a1", "%20", "é"]
    url = lambda: rng.choice(["http", "https", "HTTP"]) + "://" + ".".join(rng.choices(words[:9], k=rng.randint(1, 4))) + rng.choice(["", ":80", "/", "@e.com/"]) + "".join(rng.choice("/-_.?&=") + rng.choice(words) for _ in range(rng.randint(0, 5)))
    urls = sorted({url() for _ in range(250)})
    rules = set()
    while len(rules) < 250:
        u = rng.choice(urls)
        a = rng.randrange(len(u))
        body = u[a : a + rng.randint(1, 14)]
        if rng.random() < 0.4:
            i = rng.randrange(len(body))
            body = body[:i] + rng.choice("*^") + body[i + 1 :]
        if rng.random() < 0.3:
            body = "||" + ".".join(rng.choices(words[:9], k=rng.randint(1, 3))) + rng.choice(["^", "", "/", "^*x", "|", "^ad"])
        rules.add(rng.choice(["", "", "|"] if not body.startswith("|") else [""]) + body + rng.choice(["", "", "|"]))
    return urls, sorted(r for r in rules if r.strip() == r and not re.search(r"^/.*/$|^[!\[]|##|\$", r))


@pytest.mark.parametrize("sent", [patterns.SENT, 0])
def test_matching_against_brute_force(spark, random_cases, sent, monkeypatch):
    monkeypatch.setattr(patterns, "SENT", sent)
    urls, text = random_cases
    known, rest = patterns.compiled(spark.createDataFrame([(r,) for r in text + text[:9]], "rule string"))
    assert rest.count() == 0 and known.count() == len(text)
    free = {r.rule for r in known.where(F.size("pieces") == 0).collect()}
    seen = spark.createDataFrame([(u,) for u in urls + urls[:5]] + [(None,), ("",)], "url string")
    got = [(r.url, r.rule) for r in patterns.matching(seen, known).collect()]
    want = {(u, r) for u in urls for r in text if r not in free and brute(r, u)}
    assert len(got) == len(set(got)) and len(want) > 500
    assert set(got) == want


def judge(spark, rules, rows):
    known, _ = patterns.compiled(spark.createDataFrame([(r,) for r in rules], "rule string"))
    return {r.id: r.blocked for r in patterns.judged(spark.createDataFrame(rows, SCHEMA), known).collect()}


def test_options_exceptions_and_sites(spark):
    rules = ["/banner/*", "@@||ok.net^$image", "||cdn.org^$script,third-party", "-ad.gif|", "|https://x.io^$~image", "/Case/$match-case", "/plain/", "||t.com^$domain=a.com|~b.a.com|c.b.a.com", "*$websocket,domain=w.com", "^$ping"]
    cases = [
        (1, "http://s.net/banner/1", "a.com", "image", True, True), (2, "http://ok.net/banner/1", "a.com", "image", True, False), (3, "http://ok.net/banner/1", "a.com", "script", True, True),
        (4, "https://cdn.org/", "a.com", "script", True, True), (5, "https://cdn.org/", "a.com", "script", False, None), (6, "https://cdn.org/", "a.com", "main_frame", None, True),
        (7, "http://q/x-ad.gif", "a.com", None, None, True), (8, "http://q/x-ad.gif?a", "a.com", "image", None, None), (9, "https://x.io:8/", "a.com", "image", True, None), (10, "https://x.io:8/", "a.com", "font", True, True),
        (11, "http://x.io/", "a.com", "font", True, None), (12, "http://q/plain", "a.com", "font", True, True), (13, "http://t.com/", "www.A.com", "font", True, True), (14, "http://t.com/", "b.a.com", "font", True, None),
        (15, "http://t.com/", "x.c.b.a.com", "font", True, True), (16, "http://t.com/", None, "font", True, None), (17, "wss://z/", "q.w.com", "websocket", True, True), (18, "wss://z/", "v.com", "websocket", True, None),
        (19, "http://z/", "v.com", "ping", True, True), (20, None, "w.com", "websocket", True, None), (21, "http://z/", "v.com", None, None, True),
    ]
    got = judge(spark, rules, [c[:5] for c in cases])
    assert got == {c[0]: c[5] for c in cases if c[5] is not None}


def test_rules_left_out_and_empty_tables(spark):
    text = ["! note", "[Adblock]", "", None, "a.com##.x", "a.com#?#p", "a.com#$#log", "||a.com^$popup", r"/ad[0-9]+\.js/", r"/ad\.js/", "||b.com^$~script"]
    frame = spark.createDataFrame([(t,) for t in text], "rule string")
    known, rest = patterns.compiled(frame)
    assert {r.rule: r.why for r in rest.collect()} == {"! note": "comment", "[Adblock]": "comment", "": "comment", None: "comment", "a.com##.x": "element", "a.com#?#p": "element", "a.com#$#log": "element", "||a.com^$popup": "option", r"/ad[0-9]+\.js/": "expression"}
    assert {r.rule for r in known.collect()} == {r"/ad\.js/", "||b.com^$~script"}
    none = spark.createDataFrame([], SCHEMA)
    assert patterns.judged(none, known).count() == 0
    row = spark.createDataFrame([(1, "http://b.com/", "a.com", "image", True)] * 2, SCHEMA)
    assert patterns.judged(row, patterns.compiled(frame.limit(0))[0]).count() == 0
    clash = row.withColumns({"rule": F.lit(1), "blocked": F.lit("x"), "pattern": F.lit("("), "piece": F.lit(2)})
    out = patterns.judged(clash, known)
    assert out.columns == [c for c in clash.columns if c != "blocked"] + ["blocked"] and [r.blocked for r in out.collect()] == [True, True]


def test_rules_meet_few_urls_that_they_do_not_match(spark):
    """Rules that share all their whole tokens with many URLs are told apart by the numbers that they leave open."""
    urls = [f"http://www.a.com/en/{n}?page=2" for n in range(1000, 1400)]
    text = [f for n in range(1000, 1400) for f in (f"||a.com^*{n}", f"{n}?page=", f"|http:*/en/{n}", f"/en/{n}*page", f"/{n}/", f"-a.*{n}")]
    known, _ = patterns.compiled(spark.createDataFrame([(r,) for r in text], "rule string"))
    kinds = [("i", 4), ("p", 4), ("s", 4)]
    at = spark.createDataFrame([(u,) for u in urls], "url string").select("url", F.explode(patterns._pieces_of_url(F.col("url"), kinds)).alias("piece"))
    counts = at.groupBy("piece").count()
    rarest = known.select("rule", F.explode("pieces").alias("piece")).join(counts, "piece").groupBy("rule").agg(F.min("count").alias("n"))
    assert rarest.agg(F.max("n")).first()[0] == 1
    got = patterns.matching(spark.createDataFrame([(u,) for u in urls], "url string"), known)
    assert got.count() == 5 * 400


def test_long_parts_of_tokens(spark):
    long = "abcdefghij0123456789" * 3
    urls = [f"http://x.com/q-{long}-1", f"http://x.com/q-{long[1:]}", f"http://x.com/{long}z", "http://x.com/abcdefgh"]
    rules = [f"{long}-", f"-{long}*1", long[5:40], f"{long[2:]}|", f"*{long}z*", "abcdefgh*"]
    known, _ = patterns.compiled(spark.createDataFrame([(r,) for r in rules], "rule string"))
    got = {(r.url, r.rule) for r in patterns.matching(spark.createDataFrame([(u,) for u in urls], "url string"), known).collect()}
    assert got == {(u, r) for u in urls for r in rules if brute(r, u)} and len(got) > 8
