"""String, number and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(s: Column) -> Column:
    """Shannon entropy, base 2, of a string's characters; null for an empty or null string."""
    chars = F.split(s, "")
    n = F.length(s)
    share = lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n
    total = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda t, c: t - share(c) * F.log2(share(c)))
    return F.when(n > 0, total)


def grams(s: Column, n: int) -> Column:
    """All runs of n characters of a string, in order; none of a shorter one. Linear in its length."""
    chars = F.split(s, "")
    runs = chars
    for k in range(1, n):
        runs = F.zip_with(runs, F.slice(chars, F.lit(k + 1), F.size(chars)), lambda a, b: F.concat(a, b))
    return F.filter(runs, lambda r: r != "")


def similarity(a: Column, b: Column) -> Column:
    """Normalised Levenshtein similarity; two empty strings are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def mean_or_zero(c: Column) -> Column:
    """Mean to 2 places, halves to even."""
    return F.coalesce(F.bround(F.avg(c), 2), F.lit(0.0))


def variance_or_zero(c: Column) -> Column:
    """Sample variance to 2 places, halves to even."""
    return F.coalesce(F.bround(F.var_samp(c), 2), F.lit(0.0))


def max_or_zero(c: Column) -> Column:
    return F.coalesce(F.max(c).cast("double"), F.lit(0.0))


def style_map(css: Column) -> Column:
    """Inline CSS as a map: split at `;`, then at the first `:`; the last of equal names wins."""
    parts = F.filter(F.split(css, ";"), lambda p: F.instr(p, ":") > 0)
    name = lambda p: F.lower(F.trim(F.substring_index(p, ":", 1)))
    names = F.array_distinct(F.transform(parts, name))
    last = lambda n: F.element_at(F.filter(parts, lambda p: name(p) == n), -1)
    value = lambda n: F.trim(F.regexp_replace(last(n), r"^[^:]*:", ""))
    return F.map_from_arrays(names, F.transform(names, value))


def comma_floats(s: Column) -> Column:
    """Every comma-separated part is a number."""
    return F.forall(F.split(s, ","), lambda p: p.try_cast("double").isNotNull())


def max_age(cache_control: Column) -> Column:
    """Seconds of the last valid max-age, null without one."""
    parts = F.filter(F.split(cache_control, "[,:]"), lambda p: F.contains(p, F.lit("max-age")))
    seconds = F.transform(parts, lambda p: F.trim(F.replace(p, F.lit("max-age="), F.lit(""))).try_cast("long"))
    return F.try_element_at(F.filter(seconds, lambda n: n.isNotNull()), F.lit(-1))


def younger(cache_control: Column, seconds: int) -> Column:
    """Some max-age of a cache control is less than so many seconds, or it has none; an unreadable one is not less."""
    parts = F.filter(F.split(cache_control, "[,:]"), lambda p: F.contains(p, F.lit("max-age")))
    less = F.exists(parts, lambda p: F.coalesce(F.trim(F.replace(p, F.lit("max-age="), F.lit(""))).try_cast("long") < seconds, F.lit(False)))
    return F.coalesce(F.when(F.contains(cache_control, F.lit("max-age")), less), F.lit(True))


def pixels(value: Column) -> Column:
    """Whole pixels of a dimension; percentages, auto and fractions are null."""
    return F.regexp_extract(F.trim(value), r"^(-?\d{1,9})(?:px)?$", 1).try_cast("int")


def hidden_style(css: Column) -> Column:
    return F.coalesce(F.lower(css).rlike(r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(\.0+)?\s*(;|$|!)"), F.lit(False))


def words(s: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != "")


def word_difference(new: Column, old: Column) -> Column:
    """Distinct words of new that old lacks, in new's order; all of new if old is empty, and the other way round."""
    gone = F.array_except(F.split(new, " "), F.split(old, " "))
    return F.when(F.coalesce(old, F.lit("")) == "", F.coalesce(new, F.lit(""))).when(F.coalesce(new, F.lit("")) == "", old).otherwise(F.array_join(gone, " "))


def character_counts(s: Column, pattern: str) -> Column:
    """Characters of s that match a one-character pattern."""
    return F.length(s) - F.length(F.regexp_replace(s, pattern, ""))


def growth(first: Column, last: Column, n: Column) -> Column:
    """Compound growth a step over n points, exponent 1/n; 0 if the first is 0."""
    return F.when(first == 0, F.lit(0.0)).otherwise(F.pow(last / first, 1 / n) - 1)


def iso_time(millis: Column) -> Column:
    """Milliseconds since 1970 as ISO text, in the session's time zone."""
    return F.date_format(F.timestamp_millis(millis.cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS")
