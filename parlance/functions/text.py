"""Text functions as Column expressions: all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAK = "\u0001"


def let(value: Column, then) -> Column:
    """then(value), with value computed once however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def rows_of(df: DataFrame, array: Column, *names: str) -> DataFrame:
    """df with a row for each element of an array, as posexplode(array).alias(*names) makes them, where computing the array is dear: the engine puts a filter on size(array) before a plain posexplode, which computes it twice."""
    return df.select("*", F.posexplode_outer(array).alias(*names)).filter(F.col(names[0]).isNotNull())


def strip(x: Column) -> Column:
    """Without white space at either end (trim() would only drop spaces)."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def words(x: Column) -> Column:
    """Runs of characters between white space."""
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def tokens(x: Column, least: int = 3) -> Column:
    """Lower-case runs of letters, marks, digits and underscores of at least `least` characters."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{M}\p{N}_]{%d,})" % least), 1)


def long_ones(parts: Column, least: int = 10) -> Column:
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > least)


def split_terminated(text: Column) -> Column:
    return long_ones(F.split(F.regexp_replace(text, r"([.!?।॥])\s+", "$1" + BREAK), BREAK))


def sentences(text: Column) -> Column:
    """Sentences of more than 10 characters; else lines; else blocks of 30 words."""

    def blocks(w: Column) -> Column:
        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(30)), lambda i: F.array_join(F.slice(w, i + 1, 30), " "))).otherwise(F.array().cast("array<string>"))

    def lines(s: Column) -> Column:
        few = (F.size(s) <= 1) & (F.length(text) > 100)
        return F.when(few, long_ones(F.split(text, "\n"))).otherwise(s)

    def last(s: Column) -> Column:
        return F.when((F.size(s) <= 1) & (F.length(text) > 200), let(words(text), blocks)).otherwise(s)

    return let(let(split_terminated(F.coalesce(text, F.lit(""))), lines), last)


def stamp(sec: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on; fractions are cut off."""
    s = F.floor(sec).cast("int")
    h, m, r = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def clock(sec: Column, mark: str) -> Column:
    """HH:MM:SS and thousandths behind `mark` (, for SRT and . for VTT)."""
    ms = F.floor(sec * 1000).cast("long")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3_600_000), F.floor(ms % 3_600_000 / 60_000), F.floor(ms % 60_000 / 1000), ms % 1000)


def span(sec: Column) -> Column:
    """1h 2m 3s, 2m 3s or 3s."""
    s = F.floor(sec).cast("int")
    h, m, r = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


def script_language(text: Column) -> Column:
    """hi if over half of the Devanagari and Latin letters are Devanagari, en if not, unknown if there are none."""
    d, a = F.regexp_count(text, F.lit(r"[ऀ-ॿ]")), F.regexp_count(text, F.lit("[a-zA-Z]"))
    return F.when(F.coalesce(d + a, F.lit(0)) == 0, "unknown").when(d * 2 > d + a, "hi").otherwise("en")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def entity_id(name: Column, kind: Column) -> Column:
    return F.substring(F.md5(F.concat(kind, F.lit(":"), F.lower(strip(name)))), 1, 12)


def pair_id(a: Column, b: Column) -> Column:
    return F.concat(F.lit("xref-"), F.substring(F.md5(F.concat_ws(":", F.least(a, b), F.greatest(a, b))), 1, 10))


def file_name(title: Column) -> Column:
    return F.regexp_replace(F.substring(strip(F.regexp_replace(title, r"[^\w\s-]", "")), 1, 50), r"\s+", "_")


def five_labels(score: Column, far: float, near: float) -> Column:
    return F.when(score > far, "very_positive").when(score > near, "positive").when(score < -far, "very_negative").when(score < -near, "negative").otherwise("neutral")
