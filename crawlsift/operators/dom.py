"""DOM-mutation operators: event keys, blocked events, the multiset difference, and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsift.functions.text import comma_floats, style_map
from crawlsift.operators.diff import last_surplus_events

KINDS = {"nodes added": "added", "nodes removed": "removed", "attribute changed": "attribute", "text changed": "text"}
BLOCKED_ATTRIBUTE, BLOCKED_SNIPPET, OWN_PREFIX = "abp-blocked-element", "abp-blocked-snippet", "anticv-"
#: Characters of a value, names of a style and classes of a selector's step that a key holds; fixed values.
VALUE_CHARS, STYLE_NAMES, STEP_CLASSES = 15, 11, 19
#: Attributes whose values' lengths are no part of a node's key; fixed values.
UNMEASURED = ("transform", "d", "x", "x1", "x2", "y", "y1", "y2", "r")
#: Tags, CSS names and attributes that features count; fixed values.
TAGS = (
    "script", "img", "div", "a", "header", "iframe", "audio", "video", "span", "link", "style", "canvas", "rect",
    "circle", "section", "textarea", "option", "svg", "line", "text", "image", "table", "path", "g", "td", "tr",
    "tbody", "ul", "li", "form", "input", "select", "fieldset", "center", "br", "hr", "h1", "h2", "h3", "h4", "h5",
    "h6", "small", "button", "noscript", "meta", "embed", "picture", "article", "#comment", "aside", "nav", "footer",
    "p", "i", "source", "symbol", "null", "figure", "ins", "b",
)
CSS_NAMES = (
    "display", "visibility", "opacity", "height", "width", "background", "max-height", "max-width", "important",
    "padding", "margin", "position", "overflow", "min-width", "transform", "text-align", "bottom", "top", "left",
    "right", "float", "z-index", "background-image", "margin-left", "margin-right", "text-anchor", "fill", "stroke",
    "font-weight", "font-size", "overflow-y", "overflow-x", "box-sizing", "min-height", "cursor", "padding-right",
    "padding-left", "background-color", "padding-top", "padding-bottom", "zoom", "margin-top", "color",
    "vertical-align", "margin-bottom",
)
ATTRIBUTES = ("id", "style", "src", "class", "data", "href")
TEXTS = ("new_line", "characters", "words")


def kind(event_type: Column) -> Column:
    """added, removed, attribute or text; others (page events) are null."""
    return F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[event_type]


def simple_selector(selector: Column) -> Column:
    """Each step as its tag and the lengths of its classes: `DIV.a.bb > SPAN` gives `DIV12 > SPAN`.

    A step with an id becomes `id` and the length of what it would have been.
    """

    def step(s: Column) -> Column:
        names = F.split(s, r"\.")
        lengths = F.transform(F.slice(names, 2, STEP_CLASSES), lambda c: F.length(c).cast("string"))
        short = F.concat(names[0], F.array_join(lengths, ""))
        return F.when(F.contains(short, F.lit("#")), F.concat(F.lit("id"), F.length(short).cast("string"))).otherwise(short)

    return F.array_join(F.transform(F.split(F.trim(selector), " > "), step), " > ")


def parent_tag(selector: Column) -> Column:
    """Lower-case last step of a selector."""
    return F.lower(F.trim(F.element_at(F.split(selector, " > "), -1)))


def node_info(node: Column) -> Column:
    """A node as text: name, children, length of its value, type, and its attributes with the lengths of their values.

    Attributes of one or two characters are left out; of a style, the names alone are in. Empty: `ninfonull`.
    """
    name = lambda a: F.get(a, 0)
    value = lambda a: F.coalesce(F.get(a, 1), F.lit(""))
    styles = lambda a: F.array_join(F.transform(F.slice(F.map_keys(style_map(value(a))), 1, STYLE_NAMES), lambda k: F.concat(F.lit("["), k, F.lit("]"))), "")
    size = lambda a: F.when(name(a).isin(*UNMEASURED), F.lit("")).otherwise(F.length(value(a)).cast("string"))
    attribute = lambda a: F.concat(name(a), F.when(name(a) == "style", styles(a)).otherwise(size(a)))
    pairs = F.filter(F.coalesce(node["NodesAttributes"], F.array().cast("array<array<string>>")), lambda a: (F.size(a) == 2) & (F.length(name(a)) > 2))
    part = lambda label, v, known: F.when(known, F.concat(F.lit(f"_{label}"), v.cast("string"), F.lit("_"))).otherwise(F.lit(""))
    whole = F.concat(
        part("NodeName", node["nodeName"], F.coalesce(node["nodeName"] != "", F.lit(False))),
        part("ChildCount", node["NoChildNodes"], F.coalesce(node["NoChildNodes"] != 0, F.lit(False))),
        part("NodeValueLen", F.length(node["NodeValue"]), F.coalesce(node["NodeValue"] != "", F.lit(False))),
        part("NodeType", node["NodeType"], F.coalesce(node["NodeType"] != 0, F.lit(False))),
        F.array_join(F.transform(pairs, attribute), ""),
    )
    return F.when(F.coalesce(whole, F.lit("")) == "", F.lit("ninfonull")).otherwise(whole)


def node_events(events: DataFrame) -> DataFrame:
    """A row a node of added and removed events: its place in the event, name, key, text flag and blocked flag."""
    rows = events.withColumn("kind", kind(F.col("type"))).where(F.col("kind").isin("added", "removed"))
    selectors = F.transform(F.coalesce(F.from_json("nodes", "array<struct<selector string>>"), F.array().cast("array<struct<selector:string>>")), lambda n: n["selector"])
    infos = F.transform(F.coalesce("nodeInfo", F.array().cast(events.schema["nodeInfo"].dataType)), lambda i: F.get(i, 0))
    pairs = F.slice(F.arrays_zip(selectors.alias("selector"), infos.alias("node")), 1, F.least(F.size(selectors), F.size(infos)))
    each = rows.select(*events.columns, "kind", F.posexplode(pairs).alias("node_place", "p")).select(*events.columns, "kind", "node_place", F.coalesce("p.selector", F.lit("")).alias("node_selector"), F.col("p.node").alias("node"))
    target = F.coalesce("target_selector", F.lit(""))
    parent = F.when(F.col("node.parentNode").isNotNull(), parent_tag(target)).otherwise(F.lit(""))
    selector = F.when(F.col("node_selector") == "", F.lit("nsnull")).otherwise(F.col("node_selector"))
    flags = {
        "text_node": F.coalesce(F.col("node.NodeType") == 3, F.lit(False)),
        "blocked": (F.col("kind") == "added") & F.contains("node_selector", F.lit(BLOCKED_SNIPPET)),
        "tag": F.lower(F.coalesce("node.nodeName", F.lit(""))),
        "event_key": F.lower(F.concat_ws("__", target, selector, parent, F.coalesce(node_info(F.col("node")), F.lit("")))),
    }
    return each.withColumns(flags)


def attribute_events(events: DataFrame) -> DataFrame:
    """Attribute changes that count: names of three characters or more without the tool's own marks, with keys.

    Names that contain `data` have one key together. value_key also tells apart the values' first characters, numbers
    as nothing. Changes of the blocking mark are flagged as blocked.
    """
    name = F.coalesce("attribute", F.lit(""))
    rows = events.where((kind(F.col("type")) == "attribute") & (F.length(name) > 2) & ~F.contains(name, F.lit(OWN_PREFIX)))
    plain = F.when(F.contains(name, F.lit("data")), F.lit("data")).otherwise(name)
    info = F.get("recd", 0)
    parent = F.when(F.coalesce(info["parentNode"], F.lit("")) != "", info["parentNode"]).otherwise(F.coalesce("parentNode", F.lit("")))
    key = F.concat_ws("__", plain, F.coalesce("target_selector", F.lit("")), F.coalesce("targetType", F.lit("")), parent_tag(parent), F.when(info.isNull(), F.lit("")).otherwise(node_info(info)))

    def shown(column: str) -> Column:
        start = F.substring(F.coalesce(F.col(column), F.lit("null")), 1, VALUE_CHARS)
        return F.when(F.coalesce(comma_floats(start), F.lit(False)) | plain.isin("transform", "translate"), F.lit("")).otherwise(start)

    both = F.concat(key, F.lit("__oldvalue"), shown("oldValue"), F.lit("__newvalue"), shown("newValue"))
    return rows.withColumns({"kind": F.lit("attribute"), "blocked": name == BLOCKED_ATTRIBUTE, "event_key": F.lower(key), "value_key": F.lower(both), "plain": F.lower(plain)})


def changed_words(new: Column, old: Column) -> Column:
    """Distinct words of new that old lacks; the whole of the one if the other has no words."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))
    return F.when(F.size(words(old)) == 0, F.coalesce(new, F.lit(""))).when(F.size(words(new)) == 0, old).otherwise(F.array_join(F.array_except(words(new), words(old)), " "))


def text_events(events: DataFrame) -> DataFrame:
    """Text changes keyed by place and the first characters of both values."""
    rows = events.where(kind(F.col("type")) == "text")
    start = lambda c: F.substring(F.coalesce(F.col(c), F.lit("null")), 1, VALUE_CHARS)
    key = F.concat(F.coalesce("target_selector", F.lit("")), F.lit("__oldvalue"), start("oldValue"), F.lit("__newvalue"), start("newValue"))
    return rows.withColumns({"kind": F.lit("text"), "blocked": F.lit(False), "event_key": F.lower(key), "words": changed_words(F.col("newValue"), F.col("oldValue"))})


def keyed_events(events: DataFrame) -> DataFrame:
    """All mutation events with kind (text nodes apart from elements), key, tag and blocked flag.

    value is what features read: the changed words of a text, else null. attribute, old_value and new_value are of
    attribute changes; tag is a node's name or the type of a changed element.
    """
    common = ["key", "site", "arm", "trial", "place", "time"]
    none = F.lit(None).cast("string")
    nodes = node_events(events)
    nodes = nodes.withColumn("kind", F.when(F.col("text_node") & ~F.col("blocked"), F.concat("kind", F.lit("_text"))).otherwise(F.col("kind")))
    extra = ("value", "value_key", "attribute", "old_value", "new_value")
    out = nodes.select(*common, "kind", "event_key", "blocked", "tag", F.col("node.NodeValue").alias("value"), *(none.alias(c) for c in extra[1:]))
    changes = attribute_events(events).select(*common, "kind", "event_key", "blocked", F.lower(F.coalesce("targetType", F.lit(""))).alias("tag"), none.alias("value"), "value_key", F.col("plain").alias("attribute"), F.col("oldValue").alias("old_value"), F.col("newValue").alias("new_value"))
    texts = text_events(events).select(*common, "kind", "event_key", "blocked", none.alias("tag"), F.col("words").alias("value"), *(none.alias(c) for c in extra[1:]))
    return out.unionByName(changes).unionByName(texts)


def mutation_difference(keyed: DataFrame, by: Sequence[str] = ("key",)) -> DataFrame:
    """The events that one arm has more often than the other: its last ones of each kind and key. Blocked ones are apart."""
    return last_surplus_events(keyed.where(~F.col("blocked")), [*by, "kind"], "event_key", ["trial", "time", "place"])


def _first(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Of the rows of each key the first by trial, time and place."""
    rest = [c for c in rows.columns if c not in key]
    least = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("trial", "time", "place")).alias("_r"))
    return least.select(*(c if c in key else F.col(f"_r.`{c}`").alias(c) for c in rows.columns))


def mutation_features(difference: DataFrame, blocked: DataFrame, by: Sequence[str]) -> DataFrame:
    """The 291 DOM features of the variant's surplus events, one row a group.

    difference: mutation_difference; blocked: the blocked rows of keyed_events. Attribute changes count once for each
    place and pair of values. A style's names count where they are new and, as modified, where their value changed; a
    name that is in none of the lists counts as other.
    """
    only = difference.where(F.col("side") == "variant").withColumn("_blocked", F.lit(False))
    # equal changes are one: the first of each key and pair of values
    mine = only.where(F.col("kind") != "attribute").unionByName(_first(only.where(F.col("kind") == "attribute"), [*by, "value_key"]))
    stopped = blocked.where((F.col("arm") == "variant") & F.col("blocked")).withColumns({"side": F.lit("variant"), "_blocked": F.lit(True)})
    rows = mine.unionByName(stopped, allowMissingColumns=True)
    new, old = style_map(F.coalesce("new_value", F.lit(""))), style_map(F.coalesce("old_value", F.lit("")))
    style = F.col("attribute") == "style"
    fresh = F.when(style, F.array_except(F.map_keys(new), F.map_keys(old)))
    modified = F.when(style, F.filter(F.array_intersect(F.map_keys(new), F.map_keys(old)), lambda k: F.element_at(new, k) != F.element_at(old, k)))
    rows = rows.withColumns({"_fresh": fresh, "_modified": modified})
    live = ~F.col("_blocked")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out: dict[str, Column] = {}
    for k in ("added", "removed"):
        of = live & (F.col("kind") == k)
        for t in TAGS:
            out[f"dom_node_changed_{k}__{t}"] = count(of & (F.col("tag") == t))
        out[f"dom_node_changed_{k}__others"] = count(of & ~F.col("tag").isin(*TAGS))
        out[f"dom_node_changed_{k}__total"] = count(of)
    change = live & (F.col("kind") == "attribute")
    counted = {}
    for name in CSS_NAMES:
        counted[f"dom_attribute_changed__{name}"] = count(change & F.array_contains("_fresh", name))
    for name in ATTRIBUTES:
        counted[f"dom_attribute_changed__{name}"] = count(change & (F.col("attribute") == name))
    for name in CSS_NAMES:
        counted[f"dom_attribute_changed___modify_{name}"] = count(change & F.array_contains("_modified", name))
    counted["dom_attribute_changed__other"] = count(change & ~F.col("attribute").isin(*ATTRIBUTES))
    out |= counted
    out["dom_attribute_changed__total"] = count(change)
    value = F.coalesce("value", F.lit(""))
    text = live & (F.col("kind") == "text")
    measured = {
        "new_line": F.length(value) - F.length(F.replace(value, F.lit("\n"), F.lit(""))),
        "characters": F.length(value),
        "words": F.size(F.filter(F.split(value, " "), lambda w: F.trim(w) != "")),
    }
    totals = {n: F.coalesce(F.sum(F.when(text, c)), F.lit(0)) for n, c in measured.items()}
    out |= {f"dom_text_changed__{n}": c for n, c in totals.items()}
    out["dom_text_changed__total"] = sum(totals.values(), F.lit(0))
    out["dom_text_changed__node_added"] = count(live & (F.col("kind") == "added_text"))
    out["dom_text_changed__node_removed"] = count(live & (F.col("kind") == "removed_text"))
    for t in TAGS:
        out[f"dom_blocked_elements__{t}"] = count(F.col("_blocked") & (F.col("kind") == "attribute") & (F.col("tag") == t))
    return rows.groupBy(*by).agg(*(c.cast("double").alias(n) for n, c in out.items()))
