"""Differences between the arms of a crawl: sets, multisets, counts and fuzzy groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsift.functions.text import grams, similarity
from crawlsift.sources.stored import stored

CONTROL, VARIANT = "control", "variant"


def only_in(rows: DataFrame, by: Sequence[str], key: str, arm: str = "arm", control: object = CONTROL, variant: object = VARIANT) -> DataFrame:
    """(by, key, side) of keys that one arm alone has.

    One aggregation of both arms instead of two anti joins: keys meet in a single shuffle, pre-aggregated.
    """
    side = F.when(F.col("c") & ~F.col("v"), F.lit(CONTROL)).when(F.col("v") & ~F.col("c"), F.lit(VARIANT))
    has = lambda a: F.max(F.col(arm) == F.lit(a))
    both = rows.where(F.col(key).isNotNull()).groupBy(*by, key).agg(has(control).alias("c"), has(variant).alias("v"))
    return both.select(*by, key, side.alias("side")).where(F.col("side").isNotNull())


def multiset_surplus(rows: DataFrame, by: Sequence[str], key: str, arm: str = "arm", control: object = CONTROL, variant: object = VARIANT) -> DataFrame:
    """(by, key, side, surplus): how many more events of a key an arm has than the other."""
    n = lambda a: F.sum((F.col(arm) == F.lit(a)).cast("long"))
    both = rows.where(F.col(key).isNotNull()).groupBy(*by, key).agg((n(variant) - n(control)).alias("d")).where(F.col("d") != 0)
    return both.select(*by, key, F.when(F.col("d") > 0, VARIANT).otherwise(CONTROL).alias("side"), F.abs("d").alias("surplus"))


def last_surplus_events(rows: DataFrame, by: Sequence[str], key: str, order: Sequence[str], arm: str = "arm", control: object = CONTROL, variant: object = VARIANT) -> DataFrame:
    """The events that a multiset difference leaves: of each key, the last ones of the arm that has more.

    Counts come first, so only keys with a surplus are ranked.
    """
    surplus = multiset_surplus(rows, by, key, arm, control, variant)
    tagged = rows.withColumn("side", F.when(F.col(arm) == F.lit(variant), VARIANT).when(F.col(arm) == F.lit(control), CONTROL))
    mine = tagged.join(surplus, [*by, key, "side"])
    w = Window.partitionBy(*by, key, "side").orderBy(*(F.col(c).desc() for c in order))
    return mine.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= F.col("surplus")).drop("_rank", "surplus")


def count_mismatches(rows: DataFrame, by: Sequence[str], keys: Sequence[str], arm: str = "arm", control: object = CONTROL, variant: object = VARIANT) -> DataFrame:
    """Keys that both arms have, but not equally often."""
    n = lambda a: F.sum((F.col(arm) == F.lit(a)).cast("long"))
    both = rows.groupBy(*by, *keys).agg(n(control).alias("n_control"), n(variant).alias("n_variant"))
    return both.where((F.col("n_control") > 0) & (F.col("n_variant") > 0) & (F.col("n_control") != F.col("n_variant")))


def matched_domains(only: DataFrame, by: Sequence[str], domain: str) -> DataFrame:
    """Rows of an only_in result whose domain occurs on both sides."""
    sides = only.groupBy(*by, domain).agg(F.count_distinct("side").alias("n")).where(F.col("n") == 2).drop("n")
    return only.join(sides, [*by, domain], "left_semi")


def _grams(name: Column, size: int = 2) -> Column:
    """Pairs of neighbouring characters of a name with marked ends, numbered where they repeat."""
    padded = F.concat(F.lit("^"), name, F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - size + 1), lambda i: F.substring(padded, i, F.lit(size)))
    return F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, F.lit(1), i), lambda h: h == g)).cast("string")))


def _alike(left: DataFrame, right: DataFrame, by: Sequence[str], name: str, least: float) -> DataFrame:
    """(by, left, right, similarity): pairs of distinct names of the same block with a similarity of least or more.

    Names meet only where they share a pair of characters among the first of theirs, in one order for all names. An edit
    changes two of the n + 1 pairs of a name of n characters, and a name within reach has n / least characters at most:
    with k edits allowed, any 2k + 1 pairs hold a shared one. So no match is lost, and a domain of very many names is no
    single group. least is a half or more: names further apart need not share a pair.
    """
    if least < 0.5:
        raise ValueError("names this far apart need not share a pair of characters")
    a = left.select(*by, F.col(name).alias("left")).distinct()
    b = right.select(*(F.col(c).alias(f"_{c}") for c in by), F.col(name).alias("right")).distinct()

    def keyed(rows: DataFrame, column: str) -> DataFrame:
        edits = F.floor(F.length(column) * (1 - least) / least + 1e-9)
        ordered = F.array_sort(F.transform(_grams(F.col(column)), lambda g: F.xxhash64(g)))
        return rows.select("*", F.explode(F.slice(ordered, F.lit(1), (2 * edits + 1).cast("int"))).alias(f"_k_{column}"))

    same = [F.col(c) == F.col(f"_{c}") for c in by]
    near = F.least(F.length("left"), F.length("right")) >= F.greatest(F.length("left"), F.length("right")) * least - 1e-9
    pairs = keyed(a, "left").join(keyed(b, "right"), [*same, F.col("_k_left") == F.col("_k_right"), near])
    return pairs.select(*by, "left", "right").distinct().withColumn("similarity", similarity(F.col("left"), F.col("right"))).where(F.col("similarity") >= least)


def fuzzy_matches(left: DataFrame, right: DataFrame, by: Sequence[str], name: str, least: float = 0.7) -> DataFrame:
    """(by, left, right, similarity): for each distinct name of left the most similar one of right in the same block.

    Ties go to the smaller name. least is a half or more.
    """
    best = F.min_by(F.struct("right", "similarity"), F.struct((-F.col("similarity")).alias("s"), "right"))
    return _alike(left, right, by, name, least).groupBy(*by, "left").agg(best.alias("_b")).select(*by, "left", "_b.right", "_b.similarity")


def _leaders(names: DataFrame, by: Sequence[str], least: float) -> DataFrame:
    """(by, name): the names that no leader before them, in order of their digests, resembles.

    Digests deal the names of a block to batches, each as large as all before it. A batch first drops what a leader
    resembles; of the rest few resemble each other, since a crowd of like names has had a leader by then. Within a batch
    those without a like name before them lead, what resembles them is dropped, and so on: few rounds, as the order is
    that of a hash.
    """
    most = names.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    share = F.conv(F.substring(F.md5("name"), 1, 8), 16, 10).cast("long") + 1  # of 2^32
    last = max(most - 1, 0).bit_length()
    dealt = stored(names.withColumn("_batch", F.least(F.floor(32 - F.log2(share.cast("double"))), F.lit(last))), "names")
    found = None
    for batch in range(last, -1, -1):
        open_ = dealt.where(F.col("_batch") == batch).drop("_batch")
        if found is not None:
            open_ = open_.join(_alike(open_, found, by, "name", least).select(*by, F.col("left").alias("name")), [*by, "name"], "left_anti")
        open_ = stored(open_, "open")
        pairs = stored(_alike(open_, open_, by, "name", least).where(F.md5("left") < F.md5("right")).select(*by, "left", "right"), "pairs")
        new = []
        while not pairs.isEmpty():
            later = pairs.select(*by, F.col("right").alias("name")).distinct()
            new.append(stored(open_.join(later, [*by, "name"], "left_anti"), "new"))
            dropped = pairs.join(new[-1].withColumnRenamed("name", "left"), [*by, "left"], "left_semi").select(*by, F.col("right").alias("name")).distinct()
            left = pairs.join(dropped.withColumnRenamed("name", "right"), [*by, "right"], "left_anti").join(dropped.withColumnRenamed("name", "left"), [*by, "left"], "left_anti")
            open_ = stored(open_.join(new[-1], [*by, "name"], "left_anti").join(dropped, [*by, "name"], "left_anti"), "open")
            pairs = stored(left.select(*by, "left", "right"), "pairs")
        grown = reduce(DataFrame.unionByName, [*new, open_] if found is None else [found, *new, open_])
        found = stored(grown, "leaders") if found is not None or new else open_
    return found


def leader_groups(rows: DataFrame, by: Sequence[str], name: str, arm: str = "arm", first: object = VARIANT, least: float = 0.7) -> DataFrame:
    """(by, arm, name, leader, similarity): the groups of like names of each block.

    Names of the first arm are taken in order of their MD5 digests: each joins the leader before it that is most like
    it, with a similarity of least or more, or leads a group of its own. Names of other arms then join the most similar
    leader, if there is one; others have no row. Ties go to the later leader. Null names have none. The order is fixed,
    so groups do not hang on the order of rows, and no task holds a block.
    """
    names = rows.where(F.col(name).isNotNull()).select(*by, F.col(arm).alias("arm"), F.col(name).alias("name")).distinct()
    leaders = _leaders(names.where(F.col("arm") == first).select(*by, "name"), by, least)
    own = (F.col("arm") != first) | (F.md5("leader") <= F.md5("name"))
    alike = _alike(names, leaders, by, "name", least).withColumnsRenamed({"left": "name", "right": "leader"})
    best = F.max_by(F.struct("leader", "similarity"), F.struct("similarity", F.md5("leader").alias("o")))
    return names.join(alike, [*by, "name"]).where(own).groupBy(*by, "arm", "name").agg(best.alias("_b")).select(*by, "arm", "name", "_b.leader", "_b.similarity")


#: Runs of RUN characters, of which the least by hash of each WINDOW neighbours stands for them.
RUN = WINDOW = 8
#: Length of the runs by which shorter texts meet.
SHORT_RUN = 4


def _shifted(column: str, by: int, join: Callable[[Column, Column], Column]) -> Column:
    """Each element joined with the one `by` places later; null where there is none."""
    return F.zip_with(column, F.slice(column, F.lit(by + 1), F.greatest(F.size(column), F.lit(1))), join)


def _least_runs(rows: DataFrame, text: str) -> DataFrame:
    """rows with _keys: a hash for each window of runs, the least of its runs'. A text of a window or more has them in common
    with every text that contains it, at about two in nine places. Steps double the length, so the work is linear."""
    out = rows.withColumn("_keys", F.split(text, ""))
    for n in (1, 2, 4):
        out = out.withColumn("_keys", _shifted("_keys", n, lambda a, b: F.concat(a, b)))
    out = out.withColumn("_keys", F.transform(F.filter("_keys", lambda r: r.isNotNull()), lambda r: F.xxhash64(r)))
    for n in (1, 2, 4):
        out = out.withColumn("_keys", _shifted("_keys", n, lambda a, b: F.when(b.isNotNull(), F.least(a, b))))
    return out.withColumn("_keys", F.array_distinct(F.filter("_keys", lambda h: h.isNotNull())))


def _hashed_grams(text: Column, n: int) -> Column:
    return F.array_distinct(F.transform(grams(text, n), lambda g: F.xxhash64(g, F.lit(n))))


def initiated(requests: DataFrame, by: Sequence[str], url: str, initiator_path: str) -> DataFrame:
    """Requests whose initiator (host and path) is part of another request's URL on the same site; repeated requests stay,
    and null or empty initiators, null URLs and null sites find none.

    An initiator is looked up by that of its keys which the fewest of the site's URLs have: hashes of the least runs of
    its windows, which a URL that contains it has too. Those shorter than a window meet by short runs, which URLs give only if
    there is such an initiator. Of the URLs that contain one only the least and the greatest are kept: one of them is another
    than the request's own, or none is. So rows grow with the URLs and the matches, not with pairs of requests.
    """
    site = [f"_b{i}" for i in range(len(by))]
    of = [F.col(c).alias(s) for c, s in zip(by, site)]
    known = F.lit(True)
    for c in (*by, url):
        known &= F.col(c).isNotNull()
    parts = stored(requests.where(known & (F.length(initiator_path) > 0)).select(*of, F.col(initiator_path).alias("_part")).distinct(), "initiators")
    seen = stored(requests.where(known).select(*of, F.col(url).alias("_url")).distinct(), "urls")
    size = F.least(F.length("_part"), F.lit(SHORT_RUN))
    short = F.length("_part") < RUN + WINDOW - 1
    sizes = sorted(r[0] for r in parts.where(short).select(size).distinct().collect())  # SHORT_RUN numbers at most
    # outer: else a filter on the arrays' sizes is pushed through all steps, which works them out many times over; joins drop nulls
    few = [parts.where(short & (size == n)).select("*", F.explode(_hashed_grams(F.col("_part"), n)).alias("_key")) for n in sizes]
    asked = reduce(DataFrame.unionByName, few, _least_runs(parts.where(~short), "_part").select(*site, "_part", F.explode_outer("_keys").alias("_key")))
    more = [_hashed_grams(F.col("_url"), n) for n in sizes]
    at = _least_runs(seen, "_url").select(*site, "_url", F.explode_outer(F.array_distinct(F.concat("_keys", *more))).alias("_key"))
    counts = at.join(asked.select(*site, "_key").distinct(), [*site, "_key"], "left_semi").groupBy(*site, "_key").agg(F.count("*").alias("_n"))
    chosen = asked.join(counts, [*site, "_key"]).groupBy(*site, "_part").agg(F.min(F.struct("_n", "_key")).alias("_k"))
    chosen = chosen.select(*site, "_part", F.col("_k._key").alias("_key"))
    inside = at.join(chosen, [*site, "_key"]).where(F.contains("_url", "_part")).groupBy(*site, "_part").agg(F.min("_url").alias("_least"), F.max("_url").alias("_greatest"))
    same = [F.col(c) == F.col(s) for c, s in zip(by, site)]
    other = (F.col("_least") != F.col(url)) | (F.col("_greatest") != F.col(url))
    return requests.join(inside, [*same, F.col(initiator_path) == F.col("_part"), other], "left_semi")


def complete_groups(rows: DataFrame, by: Sequence[str], parts: Sequence[str], wanted: int) -> DataFrame:
    """Groups that have `wanted` distinct combinations of parts (trial, signal, arm)."""
    return rows.select(*by, *parts).distinct().groupBy(*by).agg(F.count("*").alias("parts")).where(F.col("parts") == wanted)


def word_set_difference(left: DataFrame, right: DataFrame, text: str) -> DataFrame:
    """(word) of distinct words in left's texts that right's lack."""
    words = lambda d: d.select(F.explode(F.split(F.trim(F.col(text)), r"\s+")).alias("word")).where(F.col("word") != "").distinct()
    return words(left).join(words(right), "word", "left_anti")
