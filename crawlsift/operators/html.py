"""Page sources as element tables, and the element selections and features over them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsift.functions import text as tx
from crawlsift.functions import urls
from crawlsift.operators import structure
from crawlsift.sources.stored import stored

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Ancestors that count, smallest advertisement and largest hidden ancestor; fixed values.
LEVELS, SMALL_WIDTH, SMALL_HEIGHT, HIDDEN_SIZE = 10, 120, 57, 2
#: Attributes that hold no URL, words of elements to leave out, words of blocker notices, words of links to leave out; fixed values.
IGNORED_ATTRIBUTES = ("srcset", "src-set", "alt", "title", "class", "target", "rel", "height", "width", "border", "data-srcset")
IGNORE_WORDS = ("social", "twitter", "weibo", "facebook", "youtube", "pinterest", "instagram", "dailymotion", "digg", "email", "mailto", "Apple", "App Store", "nav", "feed", "menu", "footer", "embed", "linkedin")
NOTICE_WORDS = ("disable", "detected", "adblocker", "whitelisting", "ad block", "support", "sponsor", "subscribe")
LINK_WORDS = ("contact", "login", "terms", "help", "account", "privacy", "policies", "#", "iframe", "faq", "about", "upload", "download", "subscribe", "mailto", "signup", ".")
BLOCKED, HIDDEN = "abp-blocked-element", "anticv-hidden"
_HIDDEN = re.compile(r"display:\s*none|visibility:\s*hidden|opacity:\s*0")
#: Context that links give to what is inside them: blank and rel, rel alone, target alone, target outside forms.
IN_REL, IN_ONLY_REL, IN_NO_REL, IN_TARGET = 1, 2, 4, 8

LINK = "struct<tag:string,attributes:map<string,string>,siblings:int,levels:int,before_tag:string,before_contents:int,after_tag:string,after_contents:int,word_above:boolean>"
ELEMENTS = f"number int, parent int, depth int, tag string, attributes map<string,string>, children int, contents int, siblings int, text string, string string, in_noscript boolean, hidden boolean, hidden_above boolean, word_above boolean, plain_above boolean, plain_out_of_form boolean, inside int, last int, rank int, open_above boolean, link {LINK}"


class _Element:
    __slots__ = ("parent", "tag", "attrs", "kids", "contents", "texts", "noscript", "inside", "plain", "unformed", "last", "depth", "hidden", "single", "rank", "open", "_small", "_word")

    def __init__(self, parent: int, tag: str, attrs: dict[str, str]):
        self.parent, self.tag, self.attrs = parent, tag, attrs
        self.kids, self.contents, self.texts, self.single = [], 0, [], None
        self.rank = 0  # among its parent's kids, from 1
        self.hidden = bool(attrs) and bool(_HIDDEN.search(attrs.get("style", "")))
        self._small = self._word = None

    # what only the ancestors of some elements are asked is worked out then, once
    @property
    def small(self) -> bool:
        if self._small is None:
            style = self.attrs.get("style", "")
            self._small = bool(self.attrs) and any(n is not None and n <= HIDDEN_SIZE for n in (_size(self.attrs, style, "height"), _size(self.attrs, style, "width")))
        return self._small

    @property
    def word(self) -> bool:
        if self._word is None:
            values = "\0".join(self.attrs.values()).lower()
            self._word = any(w in values for w in IGNORE_WORDS) or "google" in values and any("google" in v and "play" in v for v in values.split("\0"))
        return self._word


def _size(attrs: dict[str, str], style: str, name: str) -> int | None:
    """Whole pixels of an element by its style, its attribute, or as the browser measured it."""
    named = re.findall(rf"(?:^|;)\s*{name}\s*:\s*(-?\d+)(?:px)?\s*(?:!important)?\s*(?=;|$)", style, re.I) if style else ()
    for value in (*named[-1:], attrs.get(name), attrs.get(f"anticv-offset{name}")):
        found = value and re.fullmatch(r"\s*(-?\d{1,9})(?:px)?\s*", value)
        if found:
            return int(found[1])
    return None


class _Page(HTMLParser):
    """Collects elements in order; unclosed ones end with their parent. What is in noscript has no siblings or place."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[_Element] = []
        self.open: list[int] = []
        self.names: Counter[str] = Counter()  # of open elements

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        parent = self.open[-1] if self.open else -1
        e, up = _Element(parent, tag, {k: v or "" for k, v in attrs}), self.rows[parent] if parent >= 0 else None
        e.noscript = tag == "noscript" or up is not None and up.noscript
        e.depth = up.depth + 1 if up else 0
        clear = BLOCKED not in e.attrs and HIDDEN not in e.attrs
        open_up = up is not None and BLOCKED not in up.attrs and HIDDEN not in up.attrs
        e.plain = up is not None and (up.plain or open_up and up.tag != "footer")
        e.unformed = up is not None and (up.unformed or open_up and up.tag not in ("footer", "form"))
        e.inside = up.inside | _context(up) if up else 0
        e.open = up is not None and (up.open or BLOCKED not in up.attrs)
        number = len(self.rows)
        self.rows.append(e)
        e.last = number
        if up is not None and not e.noscript:
            up.kids.append(number)
            e.rank = len(up.kids)
            up.contents += 1
            up.single = number if up.contents == 1 else None
        e.plain = e.plain and clear if tag == "a" else e.plain
        if tag not in VOID:
            self.open.append(number)
            self.names[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1) if self.names[tag] else ():
            if self.rows[self.open[i]].tag == tag:
                self._close(i)
                return

    def _close(self, i: int) -> None:
        for number in self.open[i:]:
            self.rows[number].last = len(self.rows) - 1
            self.names[self.rows[number].tag] -= 1
        del self.open[i:]

    def handle_data(self, data: str) -> None:
        if self.open:
            up = self.rows[self.open[-1]]
            if not up.texts or up.contents == 0 or up.kids:
                up.contents += 1
                up.single = data if up.contents == 1 else None
            elif isinstance(up.single, str):
                up.single += data
            up.texts.append(data)

    def finish(self) -> None:
        self.close()
        self._close(0)


def _context(a: _Element) -> int:
    """What a link says about the elements inside it."""
    if a.tag != "a" or "href" not in a.attrs or BLOCKED in a.attrs or HIDDEN in a.attrs:
        return 0
    target, rel = a.attrs.get("target"), a.attrs.get("rel")
    no = rel is not None and "no" in rel.lower()
    out = IN_TARGET if target is not None and a.unformed else 0
    if a.plain:
        out |= IN_REL if no and target is not None and "blank" in target.lower() else 0
        out |= IN_ONLY_REL if no and target is None else 0
        out |= IN_NO_REL if rel is None and target is not None else 0
    return out


def _string(rows: list[_Element], e: _Element) -> str | None:
    """The text of an element with nothing but one text inside it, however deep; else null."""
    while isinstance(e.single, int):
        e = rows[e.single]
    return e.single


def _above(rows: list[_Element], e: _Element) -> list[_Element]:
    """The nearest ancestors below the body, LEVELS at most."""
    out, at = [], e.parent
    while at >= 0 and len(out) < LEVELS and rows[at].tag != "body":
        out.append(rows[at])
        at = rows[at].parent
    return out


def _siblings(rows: list[_Element], e: _Element) -> int:
    return len(rows[e.parent].kids) - 1 if e.parent >= 0 and not e.noscript else 0


def _link(rows: list[_Element], e: _Element) -> dict | None:
    """The nearest ancestor with target or rel, and what features ask of it."""
    for a in _above(rows, e):
        if a.tag == "noscript":
            return None
        if a.attrs.get("target") or a.attrs.get("rel"):
            levels, up = 0, a.parent
            while up >= 0 and rows[up].tag != "body":
                levels += _siblings(rows, rows[up]) > 0
                up = rows[up].parent
            first = last = None
            if a.parent >= 0 and rows[a.parent].parent >= 0:
                kids = rows[rows[a.parent].parent].kids
                first = kids[0] if kids[0] != a.parent else None
                last = kids[-1] if kids[-1] != a.parent else None
            far = lambda n: (None, 0) if n is None else (rows[n].tag, rows[n].contents)
            (before, n_before), (after, n_after) = far(first), far(last)
            return {"tag": a.tag, "attributes": list(a.attrs.items()), "siblings": _siblings(rows, a), "levels": levels, "before_tag": before, "before_contents": n_before, "after_tag": after, "after_contents": n_after, "word_above": any(x.word or x.tag == "noscript" for x in _above(rows, a))}
    return None


def _eligible(e: _Element) -> bool:
    """All that selected takes is, by what the element itself says."""
    if e.noscript or e.hidden:
        return False
    return "src" in e.attrs and (e.inside > 0 or e.tag == "iframe") or e.tag == "a" and not e.kids and "href" in e.attrs or e.tag == "span" and e.inside & IN_TARGET > 0


def _described(source: str | None, eligible: bool = False) -> Iterator[tuple]:
    page = _Page()
    page.feed(source or "")
    page.finish()
    rows = page.rows
    for n, e in enumerate(rows):
        if eligible and not _eligible(e):
            continue
        above = _above(rows, e)
        linked = e.inside & (IN_REL | IN_ONLY_REL | IN_NO_REL) and "src" in e.attrs
        yield (
            n, e.parent, e.depth, e.tag, list(e.attrs.items()), len(e.kids), e.contents, _siblings(rows, e), "".join(e.texts), _string(rows, e), e.noscript,
            e.hidden, any(a.tag == "noscript" or a.hidden or a.small for a in above), any(a.word or a.tag == "noscript" for a in above), e.plain, e.unformed, e.inside, e.last,
            e.rank, e.open, _link(rows, e) if linked else None,
        )


def _arrow(kind: str) -> pa.DataType:
    known = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    if kind in known:
        return known[kind]
    fields = re.findall(r"(\w+):(map<string,string>|\w+)", kind[len("struct<") : -1])
    return pa.struct([(n, known[t]) for n, t in fields])


def elements(pages: DataFrame, html: str = "html", eligible: bool = False) -> DataFrame:
    """A row an element of each page, with the other columns of pages. Null html has no elements.

    The one step that needs a parser: each page is parsed once, in Arrow batches; all that follows is SQL. Beside its
    own tag, attributes and texts a row says what features ask of its surroundings: siblings; hidden, or with words to
    leave out, among the nearest ancestors; the kind of link it is inside of (inside, IN_*) and, for images in such a
    link, the nearest ancestor with target or rel; the last number of its descendants, which follow it in order; its
    rank among its siblings, from 1; and whether some ancestor is not blocked.

    eligible: only elements that selected may take leave the parser, for features that read no others.
    """
    kept = [c for c in pages.columns if c != html]
    fields = [f.split(" ", 1) for f in ELEMENTS.split(", ")]
    types = [_arrow(t) for _, t in fields]
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html), ELEMENTS])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, source in enumerate(batch.column(batch.num_columns - 1)):
                rows = list(_described(source.as_py(), eligible))
                columns = [c.take(pa.array([i] * len(rows), pa.int64())) for c in batch.columns[:-1]]
                columns += [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *(n for n, _ in fields)])

    return pages.select(*kept, F.col(html)).mapInArrow(parse, kind)


def attribute(name: str) -> Column:
    return F.col("attributes")[name]


def has(*names: str) -> Column:
    """The element has all of these attributes."""
    out = F.lit(True)
    for n in names:
        out = out & F.map_contains_key("attributes", F.lit(n))
    return out


def value_urls(attributes: Column, site: Column) -> Column:
    """URLs among an element's attribute values, as absolute ones; attributes that hold none are left out."""
    values = F.map_values(F.map_filter(attributes, lambda k, _: ~k.isin(*IGNORED_ATTRIBUTES)))
    return F.filter(F.transform(values, lambda v: urls.absolute(v, site)), lambda u: F.trim(u) != "")


def element_urls(rows: DataFrame, site: Column) -> DataFrame:
    """A row a URL of an element."""
    return rows.select("*", F.explode(value_urls(F.col("attributes"), site)).alias("element_url"))


def pixels(name: str, attributes: Column | None = None) -> Column:
    """Width or height: of the style, else the attribute, else as the browser measured it; percentages are none."""
    a = F.col("attributes") if attributes is None else attributes
    style = F.regexp_replace(tx.style_map(F.coalesce(a["style"], F.lit("")))[name], "!important", "")
    return F.coalesce(tx.pixels(style), tx.pixels(a[name]), tx.pixels(a[f"anticv-offset{name}"]))


def too_small(width: Column, height: Column, icon: Column) -> Column:
    """Smaller than an advertisement, or an icon file."""
    return F.coalesce((width < SMALL_WIDTH) | (height < SMALL_HEIGHT), F.lit(False)) | F.coalesce(icon, F.lit(False))


def ignorable(attributes: Column | None = None) -> Column:
    """Some attribute's value has a word of social buttons, navigation and the like."""
    values = F.transform(F.map_values(F.col("attributes") if attributes is None else attributes), F.lower)
    words = F.array(*map(F.lit, IGNORE_WORDS))
    return F.exists(values, lambda v: F.exists(words, lambda w: F.contains(v, w)) | (F.contains(v, F.lit("google")) & F.contains(v, F.lit("play"))))


def _shown(tag: str, *needed: str) -> Column:
    """Elements of a tag that style and size do not hide, with the attributes needed."""
    style = F.coalesce(attribute("style"), F.lit(""))
    tiny = F.coalesce(attribute("height").isin("0", "1"), F.lit(False)) | F.coalesce(attribute("width").isin("0", "1"), F.lit(False))
    return (F.col("tag") == tag) & has(*needed) & ~has(BLOCKED) & ~tiny & ~style.rlike("display: ?none|visibility: ?hidden|opacity: ?0")


CLASSES = ("", "_no_rel", "_leaf", "_iframe")


def selected(rows: DataFrame) -> DataFrame:
    """Elements of the classes that may be advertisements, by class: images in links with rel (the empty name), in links
    with target alone (_no_rel), links with nothing inside (_leaf), frames (_iframe). Hidden ones are left out."""
    clear = ~has(BLOCKED) & ~has(HIDDEN)
    within = lambda bits: F.col("inside").bitwiseAND(F.lit(bits)) > 0
    style = F.coalesce(attribute("style"), F.lit(""))
    image = (F.col("tag") == "img") & has("src") & clear
    background = has("src") & clear & F.contains(style, F.lit("background-image"))
    empty = F.coalesce(F.col("string") == "", F.lit(True))
    bare = (F.col("tag") == "a") & clear & (F.col("children") == 0) & has("href") & (has("target") | has("rel")) & F.col("plain_out_of_form")
    block = (F.col("tag") == "span") & F.contains(style, F.lit("block")) & within(IN_TARGET)
    frame = _shown("iframe", "src") & clear & (F.col("depth") > 0)
    kinds = F.array(
        F.when((image & within(IN_REL | IN_ONLY_REL)) | (background & within(IN_REL)), ""),
        F.when(image & within(IN_NO_REL), "_no_rel"),
        F.when((bare | block) & empty, "_leaf"),
        F.when(frame, "_iframe"),
    )
    live = rows.where(~F.col("in_noscript") & ~F.col("hidden") & ~F.col("hidden_above"))
    return live.select("*", F.explode(F.array_compact(kinds)).alias("class"))


def _skipped(attributes: Column, tag: Column, urls_: Column, site: Column, blocked: Column, small: Column, siblings: Column) -> Column:
    """Whether an element is left out: the first rule that holds decides.

    Nothing to load; a frame of the site itself; a URL that the blocker stopped; for links, a URL inside another (kept)
    or a media file; image data in its source set; smaller than an advertisement; words to leave out; siblings, where
    those count.
    """
    own = lambda u: urls.registrable(urls.host(u)) == site
    linked = (F.coalesce(attributes["rel"], F.lit("")) != "") | (F.coalesce(attributes["target"], F.lit("")) != "")
    media = lambda u: F.exists(F.array(*map(F.lit, urls.MEDIA_ENDINGS)), lambda e: F.endswith(F.lower(urls.path(u)), e))
    twice = lambda u: F.regexp_count(u, F.lit("http")) > 1
    decisive = F.get(F.filter(urls_, lambda u: twice(u) | media(u)), 0)
    return (
        F.when(F.size(urls_) == 0, True)
        .when((F.lower(tag) == "iframe") & F.forall(urls_, own), True)
        .when(F.arrays_overlap(urls_, F.coalesce(blocked, F.array().cast("array<string>"))), True)
        .when(linked & decisive.isNotNull(), ~twice(decisive))
        .when(F.coalesce(attributes["srcset"].startswith("data:"), F.lit(False)), True)
        .when(small, True)
        .when(ignorable(attributes), True)
        .otherwise(siblings)
    )


def qualified(rows: DataFrame, page: list[str], site: str, site_word: str, sizes: DataFrame | None = None, blocked: str | None = None, control: str | None = None) -> DataFrame:
    """Selected elements that may be advertisements, with element_urls and link_urls.

    site: the column of the site's registrable domain, site_word that of its domain word. sizes (url without its scheme,
    width, height): known sizes of images. blocked and control: columns with the URLs that the blocker stopped in the
    page's trial, and the sources of the control's selected elements without their queries: an image in a link of the
    site itself is left out if the control has it. Images in a link are judged with that link and its ancestors, other
    elements with their own ancestors.
    """
    none = F.lit(None).cast("array<string>")
    link = F.col("link")
    rows = rows.withColumns({"element_urls": value_urls(F.col("attributes"), F.col(site)), "link_urls": F.when(link.isNotNull(), value_urls(link["attributes"], F.col(site)))})
    width, height = pixels("width"), pixels("height")
    if sizes is not None:
        bare = lambda u: F.regexp_replace(u, "^https?:", "")
        each = rows.where(width.isNull() | height.isNull()).select(*page, "number", F.posexplode("element_urls").alias("_at", "_u")).select(*page, "number", "_at", bare(F.col("_u")).alias("url"))
        found = each.join(sizes.select("url", "width", "height"), "url").groupBy(*page, "number").agg(F.min_by(F.struct("width", "height"), "_at").alias("_known"))
        rows = rows.join(found, [*page, "number"], "left")
        lacking = F.col("_known").isNotNull() & (width.isNull() | height.isNull())
        width, height = F.when(lacking, F.col("_known.width")).otherwise(width), F.when(lacking, F.col("_known.height")).otherwise(height)
    icon = F.exists("element_urls", lambda u: F.contains(u, F.lit(".ico")))
    # icons are told by URL where the size is not known
    small = too_small(width, height, icon & (width.isNull() | height.isNull()))
    stopped = none if blocked is None else F.col(blocked)
    alone = F.when(F.col("class") == "_no_rel", F.col("siblings") > 0).otherwise(F.lit(False))
    skip = _skipped(F.col("attributes"), F.col("tag"), F.col("element_urls"), F.col(site), stopped, small, alone)
    in_link = F.col("class").isin("", "_no_rel")
    link_small = too_small(pixels("width", link["attributes"]), pixels("height", link["attributes"]), F.lit(False))
    skip_link = _skipped(link["attributes"], link["tag"], F.col("link_urls"), F.col(site), stopped, link_small, F.lit(False))
    first = F.exists("link_urls", lambda u: (urls.registrable(urls.host(u)) == F.col(site)) | F.contains(F.col(site_word), urls.domain_word(urls.host(u))))
    known = F.lit(False) if control is None else F.arrays_overlap(F.transform("element_urls", urls.without_query), F.coalesce(control, none, F.array().cast("array<string>")))
    by_link = F.when(link.isNull(), False).otherwise(skip_link | (first & known) | link["word_above"])
    return rows.where(~F.coalesce(skip, F.lit(False)) & ~F.coalesce(F.when(in_link, by_link).otherwise(F.col("word_above")), F.lit(False)))


BASE_KEYS = ("subdomain_entropy", "path_entropy", "query_entropy", "query_val_entropy")
ANCESTOR_TAGS = ("div", "span", "other", "ul", "li", "script")
PARENT_KEYS = (
    "sld_mm_with_parent_count", "parent_subdomain_entropy", "parent_path_entropy", "parent_query_entropy", "parent_query_val_entropy",
    "parent_sibling_count", "parent_depth", "ancestor_previous_children", "ancestor_next_children",
    *(f"ancestor_{side}_tag_count_{t}" for side in ("previous", "next") for t in ANCESTOR_TAGS),
)


def _mean_entropy(parts: Column) -> Column:
    """Mean entropy, to 2 places, of the texts that are not empty; null without one."""
    some = F.filter(parts, lambda x: F.length(x) > 0)
    total = F.aggregate(F.transform(some, tx.entropy), F.lit(0.0), lambda t, x: t + x)
    return F.bround(total / F.nullif(F.size(some), F.lit(0)), 2)


def _url_measures(u: Column) -> dict[str, Column]:
    return {
        "subdomain_entropy": _mean_entropy(F.transform(u, lambda x: urls.subdomain(urls.host(x)))),
        "path_entropy": _mean_entropy(F.flatten(F.transform(u, lambda x: F.split(urls.path(x), "/")))),
        "query_entropy": _mean_entropy(F.flatten(F.transform(u, urls.query_keys))),
        "query_val_entropy": _mean_entropy(F.flatten(F.transform(u, urls.query_values))),
    }


def element_measures(rows: DataFrame) -> DataFrame:
    """Adds BASE_KEYS and PARENT_KEYS of each qualified element; what does not count is null."""
    some = lambda c: F.when(c > 0, c)
    link, known = F.col("link"), F.col("link").isNotNull() & F.col("class").isin("", "_no_rel")
    out = {k: some(c) for k, c in _url_measures(F.col("element_urls")).items()}
    above = _url_measures(F.col("link_urls"))
    out["parent_subdomain_entropy"] = F.when(known, some(above["subdomain_entropy"]))
    out |= {f"parent_{k}": F.when(known, F.coalesce(above[k], F.lit(0.0))) for k in BASE_KEYS[1:]}
    domains = lambda u: F.transform(u, lambda x: urls.registrable(urls.host(x)))
    out["sld_mm_with_parent_count"] = F.when(known & (F.size(F.array_except(domains(F.col("element_urls")), domains(F.col("link_urls")))) > 0), 1)
    out["parent_sibling_count"], out["parent_depth"] = F.when(known, link["siblings"]), F.when(known, link["levels"])
    for side, name in (("before", "previous"), ("after", "next")):
        tag = link[f"{side}_tag"]
        out[f"ancestor_{name}_children"] = F.when(known, link[f"{side}_contents"])
        for t in ANCESTOR_TAGS:
            mine = ~tag.isin(*(x for x in ANCESTOR_TAGS if x != "other")) if t == "other" else tag == t
            out[f"ancestor_{name}_tag_count_{t}"] = F.when(known & mine, 1)
    return rows.withColumns({k: c.cast("double") for k, c in out.items()})


def page_features(measured: DataFrame, trials: DataFrame, by: list[str], trial: str) -> DataFrame:
    """The 100 element features of a site: of each class and key, the mean over trials, to 2 places.

    Of a trial: the mean of its elements' values, or their sum where `count` is in the name; 0 if the sum is not
    positive. trials: (by, trial) of all pages that there are, so that pages without elements count as 0.
    """
    keys = [*BASE_KEYS, *PARENT_KEYS]
    each = []
    for c in CLASSES:
        of = lambda k, c=c: F.when(F.col("class") == c, F.col(k))
        each += [(F.sum(of(k)) if "count" in k else F.avg(of(k))).alias(f"{k}{c}") for k in keys]
    names = [f"{k}{c}" for c in CLASSES for k in keys]
    per_trial = measured.groupBy(*by, trial).agg(*each)
    rows = trials.select(*by, trial).distinct().join(per_trial, [*by, trial], "left")
    value = lambda n: F.greatest(F.coalesce(F.col(n), F.lit(0.0)), F.lit(0.0))
    return rows.groupBy(*by).agg(*(F.bround(F.avg(value(n)), 2).alias(f"pagesource_var_{n}") for n in names))


def visible_words(page: list[str], rows: DataFrame, noscript: bool = False) -> DataFrame:
    """(page, word) of distinct words in a page's text, scripts and styles left out, and noscript unless asked for."""
    shown = rows.where(~F.col("tag").isin("script", "style", "template"))
    shown = shown if noscript else shown.where(~F.col("in_noscript"))
    return shown.select(*page, F.explode(tx.words(F.col("text"))).alias("word")).distinct()


def text_features(by: list[str], variant: DataFrame, control: DataFrame) -> DataFrame:
    """The 4 text features: words of the variant's pages that no control page has, their characters and line feeds, and
    whether one has a word of blocker notices. A control page's noscript counts. Sites without new words have zeros."""
    marked = visible_words(by, variant).withColumn("_v", F.lit(True)).unionByName(visible_words(by, control, True).withColumn("_v", F.lit(False)))
    words = marked.groupBy(*by, "word").agg(F.max("_v").alias("v"), F.max(~F.col("_v")).alias("c"))
    new = F.col("v") & ~F.col("c")
    notice = F.exists(F.array(*map(F.lit, NOTICE_WORDS)), lambda w: F.contains(F.lower("word"), w))
    return words.groupBy(*by).agg(
        F.count_if(new).cast("double").alias("pagesource_var_text_diff"),
        F.coalesce(F.sum(F.when(new, F.length("word") - F.length(F.replace(F.col("word"), F.lit("\n"), F.lit(""))))), F.lit(0)).cast("double").alias("pagesource_var_new_lines"),
        F.coalesce(F.sum(F.when(new, F.length("word"))), F.lit(0)).cast("double").alias("pagesource_var_characters"),
        F.max(F.coalesce(new & notice, F.lit(False)).cast("double")).alias("pagesource_var_adblock_keyword"),
    )


def corresponding(control: DataFrame, variant: DataFrame, page: list[str], site: str, site_word: str, most: int = 10) -> DataFrame:
    """(page, corresp_img_fp, corresp_iframe_fp, corresp_img_tp, corresp_iframe_tp): elements of the variant's page that
    stand where the control's page had frames, by the frames' party.

    The variant's images and frames below elements that the selector of a frame's parent names count, if there are
    `most` or fewer, or fewer than twice the parent's children; if no selector of a party has any, loose ones are
    tried. Equal selectors are asked once, with the children of the first. Frames with a document of their own count as
    third party, whatever their words. Places among siblings are counted in elements.
    control, variant: elements of pages, with page, site and site_word; both are read more than once, so a table pays.
    """
    clear = ~has(HIDDEN)
    frames = control.where(_shown("iframe") & clear & (F.col("depth") > 0) & (has("src") | has("srcdoc")) & ~F.col("in_noscript"))
    host = lambda u: urls.host(u)
    own = F.exists(value_urls(F.col("attributes"), F.col(site)), lambda u: F.contains(urls.registrable(host(u)), F.col(site_word)) | F.contains(urls.subdomain(host(u)), F.col(site_word)))
    kind = lambda party, late: F.struct(party.alias("party"), F.lit(late).alias("late"))
    kinds = F.array_compact(F.array(F.when(has("src") & ~ignorable(), kind(F.when(own, "fp").otherwise("tp"), 0)), F.when(has("srcdoc"), kind(F.lit("tp"), 1))))
    parents = frames.select(*page, F.col("parent"), F.col("number").alias("frame"), F.explode(kinds).alias("k")).groupBy(*page, F.col("parent").alias("number"), "k.party").agg(F.min(F.struct("k.late", "frame")).alias("first"))
    made = structure.selectors(control, parents, page)
    asked = made.groupBy(*page, "party", "loose", "selector").agg(F.min_by(F.struct("path", "rank", "others", "held"), "first").alias("s"))
    asked = stored(asked.select(*page, "party", "loose", "selector", "s.*"), "selectors")
    wanted = (_shown("img") | _shown("iframe")) & ~F.col("in_noscript") & ~ignorable() & ~too_small(pixels("width"), pixels("height"), F.lit(False))
    matched = structure.matching(variant, asked, page)
    counts = structure.below(matched, variant.where(wanted), page, ["party", "loose", "selector", "held"])
    fits = (F.col("n") <= most) | ((F.col("held") >= 1) & (F.col("n") < 2 * F.col("held")))
    tags = {(t, f): F.coalesce(F.sum(F.when(fits & (F.col("tag") == t) & (F.col("loose") == f), F.col("n"))), F.lit(0)) for t in ("img", "iframe") for f in (False, True)}
    sums = counts.groupBy(*page, "party").agg(*(x.alias(f"{t}_{int(f)}") for (t, f), x in tags.items()))
    some = F.col("img_0") + F.col("iframe_0") > 0
    out = [F.coalesce(F.max(F.when(F.col("party") == p, F.when(some, F.col(f"{t}_0")).otherwise(F.col(f"{t}_1")))), F.lit(0)).alias(f"corresp_{t}_{p}") for p in ("fp", "tp") for t in ("img", "iframe")]
    return parents.select(*page, "party").distinct().join(sums, [*page, "party"], "left").groupBy(*page).agg(*out)


def corresponding_features(found: DataFrame, trials: DataFrame, by: list[str], trial: str) -> DataFrame:
    """The 4 correspondence features of a site: means over all its trials, to 2 places."""
    names = [f"corresp_{t}_{p}" for p in ("fp", "tp") for t in ("img", "iframe")]
    rows = trials.select(*by, trial).distinct().join(found, [*by, trial], "left").fillna(0, names)
    return rows.groupBy(*by).agg(*(F.bround(F.avg(n), 2).alias(f"pagesourcecorres_var_{n}") for n in names))


def links(pages: DataFrame, page: list[str], site: Column, html: str = "html") -> DataFrame:
    """Candidate next pages of the same site: links without rel, script and fragments, to pages that may have more on them.

    Left out are other sites, the root, and paths with words of LINK_WORDS (files, forms and notices). A link counts if
    its subdomain is another, or its path is another and it has no query. site: host of the page. place ranks a page's
    links from 1: deeper paths, other subdomains, other paths and longer ones first, ties by name.
    """
    anchors = elements(pages.select(*page, html, site.alias("_site")), html).where((F.col("tag") == "a") & ~has("rel"))
    href = attribute("href")
    kept = anchors.where(href.isNotNull() & ~href.contains("javascript") & ~href.startswith("#")).select(*page, "_site", href.alias("href")).distinct()
    own = urls.registrable(F.col("_site"))
    full = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).when(F.col("href").startswith("/"), F.concat(F.lit("http://"), own, "href")).otherwise(F.col("href"))
    rows = kept.withColumn("link", full).withColumns({"_host": urls.host(F.col("link")), "_path": urls.path(F.col("link"))})
    word = F.exists(F.array(*map(F.lit, LINK_WORDS)), lambda w: F.contains("_path", w))
    rows = rows.where((urls.part(F.col("link"), 5) == "") & ~word & (F.trim("_path") != "/") & (F.col("_host") != "") & urls.first_party(F.col("_host"), urls.domain_word(F.col("_site"))))
    www = lambda c: F.when(c == "", "www").otherwise(c)
    other = www(urls.subdomain(F.col("_host"))) != www(urls.subdomain(F.col("_site")))
    away = (F.regexp_replace("_path", "/+$", "") != "") & (urls.query(F.col("link")) == "")
    rows = rows.withColumns({"other_subdomain": other, "other_path": away, "path_depth": F.regexp_count(F.col("_path"), F.lit("/")), "length": F.length("link")}).where(F.col("other_subdomain") | F.col("other_path"))
    rows = rows.select(*page, "link", "path_depth", "other_subdomain", "other_path", "length").distinct()
    w = Window.partitionBy(*page).orderBy(F.col("path_depth").desc(), F.col("other_subdomain").desc(), F.col("other_path").desc(), F.col("length").desc(), "link")
    return rows.withColumn("place", F.row_number().over(w))
