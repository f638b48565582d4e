"""Time series of events: fixed bins, spikes, runs, delays and trial averages.

Every operator takes the columns that tell series apart (`by`). A series has a fixed, small number of bins, so what
needs their order packs a series into one array of that length and folds it: one scan, one shuffle, no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsift.sources.stored import spread, stored

SPIKE = 2
#: Loads whose series one task takes.
LOADS = 2000


def bin_number(t: Column, start: Column, step: int, bins: int) -> Column:
    """Bin of a time: both ends belong to a bin, the earlier one wins, and what is outside goes to the end bins."""
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.ceil((t - start) / F.lit(step)) - 1)).cast("int")


def series_start(dom_first: Column, request_first: Column) -> Column:
    """The earlier of both signals' first times, whole; a missing or zero request time does not count."""
    return F.floor(F.least(dom_first, F.when(request_first != 0, request_first)))


def _found(events: DataFrame, by: Sequence[str], time: str, start: Column, step: int, bins: int, counts: dict[str, Column]) -> DataFrame:
    """(by, _found): a series' bins that are not empty, as a map from bin to a struct of counts."""
    found = events.withColumn("bin", bin_number(F.col(time), start, step, bins)).groupBy(*by, "bin").agg(*(F.sum(c.cast("long")).alias(n) for n, c in counts.items()))
    return found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct(*counts)))).alias("_found"))


def binned(events: DataFrame, by: Sequence[str], time: str, start: Column, step: int, bins: int, counts: dict[str, Column]) -> DataFrame:
    """(by, bin, counts...): conditions counted, or numbers added up, over the events of every bin, empty ones included.

    events are aggregated to (by, bin), then a series' bins to a map that the scaffold of all bins looks up.
    """
    series = _found(events, by, time, start, step, bins, counts)
    each = series.select(*by, "_found", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return each.select(*by, "bin", *(F.coalesce(F.get(F.transform(F.array(F.try_element_at("_found", F.col("bin"))), lambda x: x[n]), 0), F.lit(0).cast("long")).alias(n) for n in counts))


def packed(series: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(by, _series): a series' bins in order, as an array of structs of bin and values."""
    return series.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", *dict.fromkeys(values)))).alias("_series"))


def spike_stats(series: DataFrame, by: Sequence[str], values: Sequence[str], least: int = SPIKE) -> DataFrame:
    """Of each value: number of spikes, largest and smallest spike (0 without one), and the last spike's bin (0)."""
    out = []
    for v in values:
        up = F.col(v) >= least
        out += [
            F.sum(up.cast("long")).alias(f"{v}_spikes"),
            F.coalesce(F.max(F.when(up, F.col(v))), F.lit(0)).alias(f"{v}_max"),
            F.coalesce(F.min(F.when(up, F.col(v))), F.lit(0)).alias(f"{v}_min"),
            F.coalesce(F.max(F.when(up, F.col("bin"))), F.lit(0)).alias(f"{v}_last"),
        ]
    return series.groupBy(*by).agg(*out)


def frequencies(series: DataFrame, by: Sequence[str], value: str, parts: int, bins: int, least: int = 1) -> DataFrame:
    """Share of bins with `least` or more, overall and in each of `parts` equal stretches of the series."""
    hit = (F.col(value) >= least).cast("int")
    stretch = F.floor(F.col("bin") * parts / bins)
    return series.groupBy(*by).agg(F.avg(hit).alias("freq"), *(F.avg(F.when(stretch == k, hit)).alias(f"freq_{k}") for k in range(parts)))


def gap(up: Column) -> Column:
    """Mean distance in bins between consecutive bins that are up; 0 with fewer than two. An aggregate."""
    first, last, n = F.min(F.when(up, F.col("bin"))), F.max(F.when(up, F.col("bin"))), F.count_if(up)
    return F.when(n > 1, (last - first) / F.nullif(n - 1, F.lit(0))).otherwise(F.lit(0.0))


def mean_gap(series: DataFrame, by: Sequence[str], value: str, least: int = 1) -> DataFrame:
    """Mean distance in bins between consecutive bins with `least` or more; 0 with fewer than two."""
    return series.groupBy(*by).agg(gap(F.col(value) >= least).alias("mean_gap"))


def run_totals(s: Column, value: str, least: int = SPIKE, quiet: int = 2) -> Column:
    """Struct of runs and members of a packed series: non-zero bins with fewer than `quiet` zero bins in between.

    Only bins of `least` or more are members; smaller non-zero bins keep a run alive. Runs without members are none.
    """
    zero = F.lit(0).cast("long")

    def step(t: Column, x: Column) -> Column:
        left = F.when(x[value] == 0, F.greatest(t["left"] - 1, zero)).otherwise(F.lit(quiet).cast("long"))
        mine = t["mine"] + (x[value] >= least).cast("long")
        ends = (left == 0) & (mine > 0)
        return F.struct(
            left.alias("left"),
            F.when(ends, zero).otherwise(mine).alias("mine"),
            (t["runs"] + ends.cast("long")).alias("runs"),
            (t["members"] + F.when(ends, mine).otherwise(zero)).alias("members"),
        )

    end = lambda t: F.struct((t["runs"] + (t["mine"] > 0).cast("long")).alias("runs"), (t["members"] + t["mine"]).alias("members"))
    return F.aggregate(s, F.struct(*(zero.alias(n) for n in ("left", "mine", "runs", "members"))), step, end)


def mean_run(s: Column, value: str, least: int = SPIKE, quiet: int = 2) -> Column:
    """Mean number of members of a packed series' runs; 0 without one."""
    t = run_totals(s, value, least, quiet)
    return F.coalesce(t["members"] / F.nullif(t["runs"], F.lit(0)), F.lit(0.0))


def run_stats(series: DataFrame, by: Sequence[str], value: str, least: int = SPIKE, quiet: int = 2) -> DataFrame:
    """Number and mean length of runs; 0 without one."""
    rows = packed(series, by, [value])
    return rows.select(*by, run_totals(F.col("_series"), value, least, quiet)["runs"].alias("runs"), mean_run(F.col("_series"), value, least, quiet).alias("mean_run"))


def spiking(x: Column, values: Sequence[str], least: int = SPIKE) -> Column:
    return F.greatest(*(x[v] for v in values), F.lit(0)) >= least


def delay_totals(s: Column, block: str, values: Sequence[str], least: int = SPIKE, start: str | None = None) -> Column:
    """Struct of bins and delays of a packed series: from each block to the first spike after it.

    A bin that has both only counts as a block. With `start`, bins before the first one where it is positive do
    not count; if it never is, all do.
    """
    if start is not None:
        first = F.array_min(F.transform(F.filter(s, lambda x: x[start] > 0), lambda x: x["bin"]))
        s = F.filter(s, lambda x: x["bin"] >= F.coalesce(first, F.lit(0)))
    none, zero = F.lit(None).cast("int"), F.lit(0).cast("long")

    def step(t: Column, x: Column) -> Column:
        blocked = x[block] > 0
        hit = ~blocked & spiking(x, values, least) & t["since"].isNotNull()
        return F.struct(
            F.when(blocked, x["bin"]).when(hit, none).otherwise(t["since"]).alias("since"),
            (t["bins"] + F.when(hit, x["bin"] - t["since"]).otherwise(zero)).alias("bins"),
            (t["delays"] + hit.cast("long")).alias("delays"),
        )

    return F.aggregate(s, F.struct(none.alias("since"), zero.alias("bins"), zero.alias("delays")), step)


def mean_delay(s: Column, block: str, values: Sequence[str], least: int = SPIKE, start: str | None = None) -> Column:
    """Mean bins from a block to the first spike after it; 0 without one."""
    t = delay_totals(s, block, values, least, start)
    return F.coalesce(t["bins"] / F.nullif(t["delays"], F.lit(0)), F.lit(0.0))


def block_delays(series: DataFrame, by: Sequence[str], block: str, spike: str, least: int = SPIKE, start: str | None = None) -> DataFrame:
    """Mean bins from a block to the first spike after it, and their number; see delay_totals."""
    rows = packed(series, by, [block, spike, *[start] * (start is not None)])
    args = (F.col("_series"), block, [spike], least, start)
    return rows.select(*by, mean_delay(*args).alias("mean_delay"), delay_totals(*args)["delays"].alias("delays"))


def after_last(s: Column, key: str, values: Sequence[str], least: int = SPIKE) -> Column:
    """Bins of a packed series from the last one where key is positive on, in which any value spikes; 0 if it never is."""
    last = F.array_max(F.transform(F.filter(s, lambda x: x[key] > 0), lambda x: x["bin"]))
    return F.when(last.isNull(), 0).otherwise(F.size(F.filter(s, lambda x: (x["bin"] >= last) & spiking(x, values, least)))).cast("long")


def events_after_last(series: DataFrame, by: Sequence[str], key: str, values: Sequence[str], least: int = SPIKE) -> DataFrame:
    """Bins from the last one where key is positive on, in which any of the values spikes; 0 if key never is."""
    return packed(series, by, [key, *values]).select(*by, after_last(F.col("_series"), key, values, least).alias("after_last"))


def trial_averages(trials: DataFrame, by: Sequence[str], arm: str, values: Sequence[str], control: object, variant: object) -> DataFrame:
    """Of each value: mean over trials (2 places) in both arms, and the variant's less the control's.

    Values whose name contains `block` get no difference.
    """
    out = []
    for v in values:
        means = {n: F.coalesce(F.round(F.avg(F.when(F.col(arm) == F.lit(a), F.col(v))), 2), F.lit(0.0)) for n, a in (("control", control), ("variant", variant))}
        out += [m.alias(f"{n}_{v}") for n, m in means.items()]
        if "block" not in v:
            out.append(F.round(means["variant"] - means["control"], 2).alias(f"{v}_diff"))
    return trials.groupBy(*by).agg(*out)


def cumulative_distinct(events: DataFrame, by: Sequence[str], trial: str, item: str, trials: int) -> DataFrame:
    """(by, trial, new, seen): items first seen in each trial from 0, and distinct items up to it."""
    first = events.where(F.col(item).isNotNull()).groupBy(*by, item).agg(F.min(trial).alias(trial))
    counted = first.groupBy(*by, trial).agg(F.count("*").alias("new"))
    every = events.select(*by).distinct().withColumn(trial, F.explode(F.sequence(F.lit(0), F.lit(trials - 1)).cast(f"array<{events.schema[trial].dataType.simpleString()}>")))
    w = Window.partitionBy(*by).orderBy(trial).rowsBetween(Window.unboundedPreceding, 0)
    return every.join(counted, [*by, trial], "left").fillna(0, ["new"]).withColumn("seen", F.sum("new").over(w))


def growth_and_slope(cumulative: DataFrame, by: Sequence[str], trial: str, value: str) -> DataFrame:
    """Compound growth a trial, exponent 1 / trials (0 from a first of 0), and the least-squares slope (0 if none)."""
    last = F.max_by(value, trial)
    first = F.min_by(value, trial)
    rate = F.when(first == 0, F.lit(0.0)).otherwise(F.pow(last / first, 1 / F.count("*")) - 1)
    return cumulative.groupBy(*by).agg(rate.alias("growth"), F.coalesce(F.regr_slope(F.col(value).cast("double"), F.col(trial).cast("double")), F.lit(0.0)).alias("slope"))


#: Counters of a capture's time series, in the order of the series file; fixed values.
COUNTERS = ("blocked", "web_req_blocked", "elem_blocked", "snippet_blocked", "nodes_added", "nodes_removed", "attribute_changed", "text_changed", "dom_content_loaded", "iframe_src_changed", "iframe_blocked", "total_changes")
CHANGES = ("nodes_added", "nodes_removed", "attribute_changed", "text_changed")
BLOCKS = ("blocked", "web_req_blocked", "elem_blocked", "snippet_blocked")
CAPTURE_STEP, CAPTURE_BINS = 100, 250
BLOCKED_ATTRIBUTE, BLOCKED_SNIPPET, OWN_PREFIX = "abp-blocked-element", "abp-blocked-snippet", "anticv-"


def _snippet_nodes(events_nodes: Column) -> Column:
    """For each node of an added event: the blocker's snippet put it in."""
    selectors = F.transform(F.coalesce(F.from_json(events_nodes, "array<struct<selector string>>"), F.array().cast("array<struct<selector:string>>")), lambda n: n["selector"])
    return F.transform(selectors, lambda x: F.coalesce(F.contains(x, F.lit(BLOCKED_SNIPPET)), F.lit(False)))


def event_counters() -> dict[str, Column]:
    """What a row of captures.mutation_events adds to each counter; nothing is exploded."""
    kind, attribute = F.col("type"), F.coalesce("attribute", F.lit(""))
    snippets = _snippet_nodes(F.col("nodes"))
    node = F.coalesce(F.transform("nodeInfo", lambda n: F.coalesce(F.get(n, 0)["NodeType"] == 3, F.lit(False))), F.array().cast("array<boolean>"))
    each = F.zip_with(node, snippets, lambda t, s: F.struct(F.coalesce(t, F.lit(False)).alias("text"), F.coalesce(s, F.lit(False)).alias("snippet")))
    n = lambda f: F.size(F.filter(each, f))
    added, removed = kind == "nodes added", kind == "nodes removed"
    changed = (kind == "attribute changed") & ~F.contains(attribute, F.lit(OWN_PREFIX))
    element = changed & (attribute == BLOCKED_ATTRIBUTE)
    plain = changed & ~element
    frame = F.contains(F.lower(F.coalesce("targetType", F.lit(""))), F.lit("iframe"))
    none = F.lit(0)
    snippet = F.when(added, n(lambda x: x["snippet"])).otherwise(none)
    out = {
        "blocked": (element | (snippet > 0)).cast("int"),
        "web_req_blocked": none,
        "elem_blocked": element.cast("int"),
        "snippet_blocked": snippet,
        "nodes_added": F.when(added, n(lambda x: ~x["snippet"] & ~x["text"])).otherwise(none),
        "nodes_removed": F.when(removed, n(lambda x: ~x["text"])).otherwise(none),
        "attribute_changed": plain.cast("int"),
        "text_changed": F.when(added, n(lambda x: ~x["snippet"] & x["text"])).when(removed, n(lambda x: x["text"])).when(kind == "text changed", F.lit(1)).otherwise(none),
        "dom_content_loaded": (kind == "DOMContentLoaded").cast("int"),
        "iframe_src_changed": (plain & frame & (attribute == "src") & (F.length(F.coalesce("newValue", F.lit(""))) > 0)).cast("int"),
        "iframe_blocked": (element & frame).cast("int"),
    }
    out = {k: F.coalesce(v, none) for k, v in out.items()}
    return out | {"total_changes": out["nodes_added"] + out["nodes_removed"] + out["attribute_changed"] + out["text_changed"]}


def _capture_events(mutations: DataFrame, blocked_requests: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, start, time, COUNTERS...): what each event of a load adds to its counters, of loads with mutations."""
    m = mutations.where(F.col("time").isNotNull()).select(*by, F.col("time").cast("double").alias("time"), F.lit(False).alias("request"), *(c.alias(n) for n, c in event_counters().items()))
    mine = {n: F.lit(int(n in ("blocked", "web_req_blocked"))) for n in COUNTERS}
    r = blocked_requests.where(F.col("requestTime").isNotNull()).select(*by, F.col("requestTime").alias("time"), F.lit(True).alias("request"), *(c.alias(n) for n, c in mine.items()))
    both = m.unionByName(r)
    first = lambda request: F.min(F.when(F.col("request") == request, F.col("time")))
    starts = both.groupBy(*by).agg(first(False).alias("_dom"), first(True).alias("_request")).where(F.col("_dom").isNotNull())
    starts = starts.select(*by, series_start(F.col("_dom"), F.col("_request")).alias("start"))
    return both.join(starts, list(by))


def capture_series(mutations: DataFrame, blocked_requests: DataFrame, by: Sequence[str], step: int = CAPTURE_STEP, bins: int = CAPTURE_BINS) -> DataFrame:
    """(by, start, bin, COUNTERS...): the time series of page loads, a row a bin.

    mutations: captures.mutation_events; blocked_requests: captures.blocked_requests; both with the columns in by. A
    load starts at the earlier of both signals' first times, a request time of 0 not counting. Loads without
    mutations have no series.
    """
    return binned(_capture_events(mutations, blocked_requests, by), [*by, "start"], "time", F.col("start"), step, bins, {n: F.col(n) for n in COUNTERS})


def capture_features(mutations: DataFrame, blocked_requests: DataFrame, by: Sequence[str]) -> DataFrame:
    """trial_features of capture_series. A load's bins stay in its one row and are never shuffled, grouped or sorted.

    The bins that are not empty are stored, since few bytes stand for much work: tasks are dealt by loads, LOADS each.
    """
    found = stored(_found(_capture_events(mutations, blocked_requests, by), by, "time", F.col("start"), CAPTURE_STEP, CAPTURE_BINS, {n: F.col(n) for n in COUNTERS}), "bins")
    none = F.lit(0).cast("long")
    bin_of = lambda i, x: F.struct(i.alias("bin"), *(F.coalesce(x[n], none).alias(n) for n in COUNTERS))
    whole = F.transform(F.sequence(F.lit(0), F.lit(CAPTURE_BINS - 1)), lambda i: F.transform(F.array(F.try_element_at("_found", i)), lambda x: bin_of(i, x))[0])
    return _load_features(spread(found, LOADS).select(*by, whole.alias("_series")), by)


def series_rows(series: DataFrame, by: Sequence[str], step: int = CAPTURE_STEP) -> DataFrame:
    """The 14 columns of a series file: bin in milliseconds, time of the bin (ISO, UTC), and the counters."""
    at = F.timestamp_millis((F.col("start") + F.col("bin") * step).cast("long"))
    return series.select(*by, (F.col("bin") * step).alias("bin_norm"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("Date"), *COUNTERS)


def trial_features(series: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, 58 features) of each load's series, in one pass.

    series: by, bin and COUNTERS. Halves and fifths are of the bins that a series has; a short series has no fifths.
    """
    return _load_features(packed(series, by, COUNTERS), by)


def _load_features(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    s, n = F.col("_series"), F.size("_series")
    up = lambda v, least: F.filter(s, lambda x: x[v] >= least)
    values = lambda v, least: F.transform(up(v, least), lambda x: x[v])
    share = lambda v, first, end: F.coalesce(F.size(F.filter(up(v, 1), lambda x: (x["bin"] >= first) & (x["bin"] < end))) / F.nullif(end - first, F.lit(0)), F.lit(0.0))

    def between(v: str, first: Column, end: Column) -> Column:
        at = F.transform(F.filter(up(v, 1), lambda x: (x["bin"] >= first) & (x["bin"] < end)), lambda x: x["bin"])
        return F.coalesce((F.array_max(at) - F.array_min(at)) / F.nullif(F.size(at) - 1, F.lit(0)), F.lit(0.0))

    out = {"ts__last_time": F.coalesce(F.array_max(F.transform(up("total_changes", SPIKE), lambda x: x["bin"])), F.lit(0)) * CAPTURE_STEP}
    out |= {f"ts_{v}_cluster_avg": mean_run(s, v) for v in CHANGES}
    out["ts__spikes_after_domloaded"] = mean_delay(s, "blocked", CHANGES, start="dom_content_loaded")
    out["ts__spikes_after_last_iframe"] = after_last(s, "iframe_src_changed", CHANGES)
    out["ts__spikes_after_last_iframe_blocked"] = after_last(s, "iframe_blocked", CHANGES)
    middle = F.floor(n / 2).cast("int")
    for name, first, end in (("first", F.lit(0), middle), ("second", middle, n)):
        out[f"ts_blocked_event_freq_{name}_half"] = share("blocked", first, end)
        out[f"ts_blocked_time_between_{name}_half"] = between("blocked", first, end)
    fifth = CAPTURE_BINS // 5
    for v in ("blocked", "elem_blocked", *CHANGES):
        for k, name in enumerate(("first", "second", "third", "fourth", "fifth")):
            out[f"ts_{v}_event_freq_{name}_fifth"] = F.when(n == CAPTURE_BINS, share(v, F.lit(k * fifth), F.lit((k + 1) * fifth))).otherwise(F.lit(0.0))
    for v in BLOCKS:  # the kinds of block count in blocked bins only
        out[f"ts_{v}_spikes"] = F.size(F.filter(up(v, 1), lambda x: x["blocked"] > 0))
    for v in CHANGES:
        out[f"ts_{v}_spikes"] = F.size(up(v, SPIKE))
        out[f"ts_{v}_max"] = F.coalesce(F.array_max(values(v, SPIKE)), F.lit(0))
        out[f"ts_{v}_min"] = F.coalesce(F.array_min(values(v, SPIKE)), F.lit(0))
    return rows.select(*by, *(c.cast("double").alias(k) for k, c in out.items()))


def series_features(trials: DataFrame, by: Sequence[str], arm: str, control: object, variant: object, wanted: int) -> DataFrame:
    """(by, 97 features): means over the variant's trials (2 places), and less the control's where `block` is not in the name.

    trials: by, arm and the columns of trial_features, a row a trial. Sites without `wanted` trials of both arms have none.
    """
    names = [c for c in trials.columns if c.startswith("ts_")]
    of = lambda a, c: F.avg(F.when(F.col(arm) == F.lit(a), F.col(c)))
    out = []
    for c in names:
        mine = F.bround(of(variant, c), 2)
        out.append(mine.alias(c))
        if "block" not in c:
            out.append(F.bround(mine - of(control, c), 2).alias(f"{c}_diff"))
    n = lambda a: F.count_if(F.col(arm) == F.lit(a))
    rows = trials.groupBy(*by).agg(n(control).alias("_c"), n(variant).alias("_v"), *out)
    return rows.where((F.col("_c") == wanted) & (F.col("_v") == wanted)).drop("_c", "_v")
