"""Structure of pages: selectors made for elements, and the elements of other pages that selectors name, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Structure: steps above an element's own, attributes of a step, and attributes of which only the name tells; fixed values.
STEPS, STEP_ATTRIBUTES = 3, 5
LOOSE = ("srcset", "src-set", "class", "id", "style", "data")
#: Attributes that are lists of words, compared with one space between them; handlers that no step names; fixed values.
WORD_LISTS = ("class", "rel", "rev", "accept-charset", "headers", "accesskey", "dropzone")
HANDLERS = "onclick|onload|onerror"
BLOCKED = "abp-blocked-element"
TESTS = "array<struct<name:string,part:string>>"


def _plain(name: Column, value: Column) -> Column:
    return F.when(name.isin(*WORD_LISTS), F.trim(F.regexp_replace(value, r"\s+", " "))).otherwise(value)


def tests(attributes: Column, loose: Column) -> Column:
    """What a step asks of an element's attributes: parts of the values of the first STEP_ATTRIBUTES that have one, or,
    if loose, only that those of LOOSE are there. Names with digits and handlers are not asked."""
    named = F.filter(F.map_entries(attributes), lambda e: ~e["key"].rlike(rf"\p{{Nd}}|{HANDLERS}"))
    each = F.transform(named, lambda e: F.struct(e["key"].alias("name"), _plain(e["key"], e["value"]).alias("part")))
    strict = F.slice(F.filter(each, lambda t: (t["part"] != "") & ~t["name"].rlike("[.?]")), 1, STEP_ATTRIBUTES)
    names = F.transform(F.filter(each, lambda t: t["name"].isin(*LOOSE)), lambda t: F.struct(t["name"].alias("name"), F.lit(None).cast("string").alias("part")))
    return F.when(loose, names).otherwise(strict).cast(TESTS)


def _text(step: Column) -> Column:
    """A step as CSS."""
    quoted = lambda v: F.regexp_replace(v, r"(['\\])", r"\\$1")
    asked = F.transform(step["tests"], lambda t: F.concat(F.lit("["), t["name"], F.coalesce(F.concat(F.lit("*='"), quoted(t["part"]), F.lit("'")), F.lit("")), F.lit("]")))
    return F.concat(step["tag"], F.lit(f":not([{BLOCKED}])"), F.array_join(asked, ""))


def _agrees(step: Column, tag: Column, attributes: Column) -> Column:
    """The element is what the step asks for."""
    one = lambda t: F.map_contains_key(attributes, t["name"]) & (t["part"].isNull() | F.contains(_plain(t["name"], attributes[t["name"]]), t["part"]))
    return F.coalesce((tag == step["tag"]) & ~F.map_contains_key(attributes, F.lit(BLOCKED)) & F.forall(step["tests"], one), F.lit(False))


def selectors(rows: DataFrame, wanted: DataFrame, page: list[str]) -> DataFrame:
    """Two selectors (loose false and true) for each element that wanted names by page and number, with wanted's columns.

    A selector is a path of steps, from the element up: STEPS above its own, or up to one that mentions the body. The
    element's place among its siblings counts where it has some, from both ends. Elements that mention the body have
    none, nor do those with fewer steps above and no body. rank and others are null for only children.

    rows: elements of pages. Adds loose, path, rank, others, held (the element's children) and selector, the CSS text.
    """
    live = rows.where(~F.col("in_noscript"))
    own = live.select(*page, "number", F.col("parent").alias("_up"), "tag", "attributes", "rank", F.col("siblings").alias("others"), F.col("children").alias("held"))
    chain = wanted.join(own, [*page, "number"]).withColumn("_raw", F.array(F.struct("tag", "attributes"))).drop("tag", "attributes")
    for _ in range(STEPS):
        above = live.select(*page, F.col("number").alias("_up"), F.col("parent").alias("_next"), F.struct("tag", "attributes").alias("_above"))
        chain = chain.join(above, [*page, "_up"], "left").withColumn("_raw", F.concat("_raw", F.array("_above"))).drop("_above", "_up").withColumnRenamed("_next", "_up")
    forms = chain.drop("_up").withColumn("_raw", F.array_compact("_raw")).withColumn("loose", F.explode(F.array(F.lit(False), F.lit(True))))
    steps = forms.withColumn("path", F.transform("_raw", lambda e: F.struct(e["tag"].alias("tag"), tests(e["attributes"], F.col("loose")).alias("tests")))).drop("_raw")
    texts = steps.withColumn("_css", F.transform("path", _text))
    ends = texts.withColumn("_end", F.array_position(F.transform("_css", lambda s: F.contains(s, F.lit("body"))), True))
    cut = ends.where((F.col("_end") > 1) | ((F.col("_end") == 0) & (F.size("path") == STEPS + 1)))
    n = F.when(F.col("_end") > 0, F.col("_end")).otherwise(F.lit(STEPS + 1)).cast("int")
    only = F.col("others") == 0
    cut = cut.withColumns({"path": F.slice("path", 1, n), "_css": F.slice("_css", 1, n), "rank": F.when(~only, F.col("rank")), "others": F.when(~only, F.col("others"))})
    nth = F.coalesce(F.concat(F.lit(":nth-last-child("), (F.col("others") - F.col("rank") + 2).cast("string"), F.lit("):nth-child("), F.col("rank").cast("string"), F.lit(")")), F.lit(""))
    upper = F.reverse(F.slice("_css", 2, F.size("_css")))
    text = F.concat(F.lit(f":not([{BLOCKED}]) "), F.array_join(F.concat(upper, F.array(F.concat(F.col("_css")[0], nth))), " > "))
    return cut.withColumn("selector", text).drop("_css", "_end")


def matching(rows: DataFrame, asked: DataFrame, page: list[str]) -> DataFrame:
    """A row an element (number, last) of a page that a selector asked of that page names, with asked's columns.

    Candidates meet a selector by page, tag and, where it has one, place among siblings; then each step above is one
    join by page and parent. The topmost has to lie below an element that is not blocked.

    asked: page, path, rank and others as selectors gives them; its columns do not begin with an underscore.
    """
    live = rows.where(~F.col("in_noscript"))
    own = live.select(*page, F.col("tag").alias("_tag"), F.col("attributes").alias("_a"), F.col("rank").alias("_rank"), F.col("siblings").alias("_others"), "number", "last", F.col("parent").alias("_up"), F.col("open_above").alias("_open"))
    leaves = asked.withColumn("_tag", F.col("path")[0]["tag"])
    alone = leaves.where("rank is null").join(own, [*page, "_tag"])
    placed = leaves.where("rank is not null").withColumns({"_rank": F.col("rank"), "_others": F.col("others")}).join(own, [*page, "_tag", "_rank", "_others"])
    found = placed.unionByName(alone).where(_agrees(F.col("path")[0], F.col("_tag"), F.col("_a"))).drop("_tag", "_a", "_rank", "_others")
    above = live.select(*page, F.col("number").alias("_up"), F.col("parent").alias("_next"), F.col("tag").alias("_tag"), F.col("attributes").alias("_a"), F.col("open_above").alias("_top"))
    for i in range(1, STEPS + 1):
        done = F.size("path") <= i
        found = found.join(above, [*page, "_up"], "left").where(done | _agrees(F.get("path", F.lit(i)), F.col("_tag"), F.col("_a")))
        found = found.withColumns({"_open": F.when(done, F.col("_open")).otherwise(F.col("_top")), "_up": F.col("_next")}).drop("_next", "_tag", "_a", "_top")
    return found.where("_open").drop("_open", "_up")


def below(matched: DataFrame, found: DataFrame, page: list[str], by: list[str]) -> DataFrame:
    """(page, by, tag, n): how many of found, elements of pages, lie below matched ones, by tag: joined by page, told by
    the interval of numbers that a matched element spans."""
    inner = found.select(*page, "tag", F.col("number").alias("_n"))
    under = matched.select(*page, *by, "number", "last").join(inner, page).where((F.col("_n") > F.col("number")) & (F.col("_n") <= F.col("last")))
    return under.groupBy(*page, *by, "tag").agg(F.count_distinct("_n").alias("n"))
