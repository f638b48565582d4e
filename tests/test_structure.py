"""Selectors and the elements they name, against a matcher that reads the selector's text."""

import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from crawlsift.operators import html, structure

VOID = {"img", "br", "meta"}


class Tree(HTMLParser):
    """Elements with parent, kids and attributes, without noscript."""

    def __init__(self, text):
        super().__init__()
        self.rows, self.open = [], []
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        up = self.open[-1] if self.open else None
        self.rows.append({"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "up": up, "kids": [], "n": len(self.rows)})
        if up is not None:
            self.rows[up]["kids"].append(len(self.rows) - 1)
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_endtag(self, tag):
        names = [self.rows[i]["tag"] for i in self.open]
        if tag in names:
            del self.open[len(names) - 1 - names[::-1].index(tag) :]

    def above(self, e):
        while e["up"] is not None:
            e = self.rows[e["up"]]
            yield e

    def named(self, selector):
        """Numbers of the elements that the selector's text names."""
        first, rest = selector.split(" ", 1)
        assert first == ":not([abp-blocked-element])"
        parts = re.findall(r"'(?:[^'\\]|\\.)*'| > |.", rest)  # quoted text is one part
        steps = "".join("\0" if x == " > " else x for x in parts).split("\0")[::-1]
        return [e["n"] for e in self.rows if self.path(e, steps)]

    def path(self, e, steps):
        chain = [e, *self.above(e)]
        if len(chain) <= len(steps) or not all(self.step(c, s) for c, s in zip(chain, steps, strict=False)):
            return False
        return any("abp-blocked-element" not in a["attrs"] for a in chain[len(steps) :])

    def step(self, e, text):
        tag = re.match(r"[^:\[]+", text)[0]
        if e["tag"] != tag or "abp-blocked-element" in e["attrs"]:
            return False
        for k, v in re.findall(r"\[([^\]*=]+)(?:\*='((?:[^'\\]|\\.)*)')?\]", text.replace(":not([abp-blocked-element])", "")):
            if k not in e["attrs"] or re.sub(r"\\(.)", r"\1", v) not in (" ".join(e["attrs"][k].split()) if k in structure.WORD_LISTS else e["attrs"][k]):
                return False
        at = re.search(r":nth-last-child\((\d+)\):nth-child\((\d+)\)$", text)
        if at:
            kids = self.rows[e["up"]]["kids"] if e["up"] is not None else [e["n"]]
            i = kids.index(e["n"])
            return i + 1 == int(at[2]) and len(kids) - i == int(at[1])
        return True


def page(rng, depth=0):
    """Nested elements with few names, so that selectors name several of them."""
    out = []
    for _ in range(rng.choice((0, 1, 1, 2, 3)) if depth else 3):
        tag = rng.choice(("div", "div", "p", "span", "img"))
        given = {"class": rng.choice(("a", " a  b ", "b", "")), "id": rng.choice(("x", "it's", "x\\y", "x > y")), "data-1": "z", "onclick": "f()", "abp-blocked-element": "true", "style": "q", "a.b": "1", "c": "1", "d": "2", "e": "3", "f": "4"}
        kept = [k for k in given if rng.random() < (0.05 if k == "abp-blocked-element" else 0.3)]
        attrs = "".join(f' {k}="{given[k]}"' for k in kept)
        out.append(f"<{tag}{attrs}>" + ("" if tag in VOID else page(rng, depth + 1) + f"</{tag}>" if depth < 6 else f"</{tag}>"))
    return "".join(out)


def run(spark, sources):
    rows = html.elements(spark.createDataFrame([(i, s) for i, s in enumerate(sources)], "k int, html string")).cache()
    made = structure.selectors(rows, rows.select("k", "number"), ["k"]).cache()
    both = made.withColumn("k", F.explode(F.array("k", ((F.col("k") + 1) % len(sources)).cast("int"))))  # its own page and the next
    asked = both.groupBy("k", "loose", "selector").agg(F.min_by(F.struct("path", "rank", "others", "held"), "number").alias("s")).select("k", "loose", "selector", "s.*")
    found = {}
    for r in structure.matching(rows, asked, ["k"]).select("k", "selector", "number").collect():
        found.setdefault((r.k, r.selector), set()).add(r.number)
    return rows, made, asked, found


def test_selectors_name_what_their_text_names(spark):
    rng = random.Random(3)
    sources = [f"<html><head><meta></head><body>{page(rng)}</body></html>" for _ in range(8)] + [page(rng), "", "<p>"]
    _, made, asked, found = run(spark, sources)
    trees = [Tree(s) for s in sources]
    texts = [(r.k, r.selector) for r in asked.select("k", "selector").collect()]
    assert len(texts) > 100
    expected = {t: set(trees[t[0]].named(t[1])) for t in texts}
    assert {t: n for t, n in expected.items() if n} == found and len(found) > 100
    # each selector names, on its own page, its own element, unless something on the way is blocked or nothing is above it
    for r in made.collect():
        e = trees[r.k].rows[r.number]
        chain = [e, *trees[r.k].above(e)]
        if len(chain) > len(r.path) and not any("abp-blocked-element" in a["attrs"] for a in chain):
            assert r.number in trees[r.k].named(r.selector), r.selector


def test_two_hundred_siblings_behind_heads_of_any_length(spark):
    body = "<body><div>" + "".join(f"<p class='c'><img src='/i{i}.png'></p>" for i in range(200)) + "</div></body>"
    sources = [f"<html><head></head>{body}</html>", f"<html><head><meta><meta></head>{body}</html>"]
    rows, _, asked, found = run(spark, sources)
    paragraphs = {k: [r.number for r in rows.where((F.col("k") == k) & (F.col("tag") == "p")).orderBy("number").collect()] for k in (0, 1)}
    assert paragraphs[0] != paragraphs[1]
    for k in (0, 1):
        strict = [r.selector for r in asked.where((F.col("k") == k) & ~F.col("loose") & F.col("selector").contains("p:not") & ~F.col("selector").contains("img")).collect()]
        assert len(strict) == 200 and sorted(n for s in strict for n in found[(k, s)]) == paragraphs[k]


def test_steps_and_edges(spark):
    one = lambda text, tag: [(r.loose, r.selector) for r in (lambda rows: structure.selectors(rows, rows.where(F.col("tag") == tag).select("k", "number"), ["k"]))(html.elements(spark.createDataFrame([(1, text)], "k int, html string"))).orderBy("loose").collect()]
    no = ":not([abp-blocked-element])"
    assert one('<html><body><i></i><div id="s" class="a  b" data-1="x" onclick="f" title="t"><u></u></div></body></html>', "div") == [
        (False, f"{no} body{no} > div{no}[id*='s'][class*='a b'][title*='t']:nth-last-child(1):nth-child(2)"),
        (True, f"{no} body{no} > div{no}[id][class]:nth-last-child(1):nth-child(2)"),
    ]
    # not the body itself, not what mentions it, not what has too little above it, not what noscript holds
    assert one("<html><body></body></html>", "body") == [] and [r[0] for r in one('<html><body><div id="body2"></div></body></html>', "div")] == [True]
    assert one("<div><p><u></u></p></div>", "u") == [] and one("<html><body><noscript><u></u></noscript></body></html>", "u") == []
    assert len(one("<b><div><p><s><u></u></s></p></div></b>", "u")) == 2


def test_caps_and_frames_of_documents(spark):
    """Too many images do not count, unless the slot held half as many; a frame's own document counts as third party."""
    make = lambda text: html.elements(spark.createDataFrame([(1, 0, text)], "page int, trial int, html string")).withColumns({"site": F.lit("h.com"), "word": F.lit("h")})
    slot = lambda inner: f'<html><body><div id="slot">{inner}</div></body></html>'
    count = lambda control, variant: tuple(html.corresponding(make(slot(control)), make(slot(variant)), ["page", "trial"], "site", "word").select("corresp_img_fp", "corresp_iframe_fp", "corresp_img_tp", "corresp_iframe_tp").first())
    frame, image = '<iframe src="http://o.net/f"></iframe>', '<img src="1">'
    assert count(frame, image * 10) == (0, 0, 10, 0) and count(frame, image * 11) == (0, 0, 0, 0)
    assert count(frame * 6, image * 11) == (0, 0, 11, 0) and count(frame * 6, image * 12) == (0, 0, 0, 0)
    assert count(frame, image * 11 + "<iframe></iframe>") == (0, 0, 0, 1)
    assert count('<iframe src="http://h.com/f" srcdoc="x"></iframe>', image) == (1, 0, 1, 0)
    assert count('<iframe src="http://o.net/twitter" srcdoc="x"></iframe>', image) == (0, 0, 1, 0)
