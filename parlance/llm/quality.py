"""Quality rules (operator 2): thresholds learned for each language and source from mergeable quantile sketches.

A sketch is a histogram with log-linear buckets (32 to each power of two, exact below 32): any quantile is known to
about 3 %, sketches of two sets of rows add up bucket by bucket, and the result doesn't depend on how rows were dealt.
Each partition adds up its own rows first, those that pass the base rules; only bucket counts are shuffled. A group of
few rows takes the sketch of its language, and that of all rows where the language is rare too.

No rule has a number of its own. Of all pairs of quantiles that hold half of a group's rows between them, the closest is
its middle: junk on one side, up to nearly half of the group, doesn't move it. Limits lie `spread` times its width
beyond either end. Where half of the rows share one value, as rates of rare things do, the closest pair that holds nine
tenths is taken. A document fails if it has over `chance` more of what is counted than the limit allows: where none is
usual, three may come by chance (the rule of three). Rows join their group's limits and are judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import SPACE, U64, bytes_of, exact_hashes, hold, mix, parts, plain, runs_of, save, ship, slices, words_of

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct"]
SYMBOLS, PUNCT, UPPER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
PUNCT[33:48] = PUNCT[58:65] = PUNCT[91:97] = PUNCT[123:127] = True
UPPER[65:91] = True

#: Rule: (numerator, denominator, whether there can be too little of it). Repeated words have their limit in the base rules.
RULES = {
    "symbol_rate": ("n_symbols", "n_words", False),
    "upper_rate": ("n_upper", "word_chars", False),
    "punct_rate": ("n_punct", "word_chars", False),
    "dup_line_rate": ("n_dup_lines", "n_lines", False),
    "word_length": ("word_chars", "n_words", True),
}
#: Quantiles are taken at every twentieth; of them, half the rows lie between ten steps, nine tenths between 18.
STEPS, HALF, MOST = 20, 10, 18


def counts(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """COUNTS of each row of a slice."""
    n = len(offs) - 1

    def per_row(flag: np.ndarray) -> np.ndarray:
        c = np.zeros(len(flag) + 1, np.int64)
        np.cumsum(flag, out=c[1:])
        return c[offs[1:]] - c[offs[:-1]]

    starts, ends, rows = words_of(data, offs, SPACE == False)  # noqa: E712
    n_words = np.bincount(rows, minlength=n)
    chars = per_row(~SPACE[data] & ((data & 0xC0) != 0x80))
    # Lines: cut at each \n and at the ends of rows; those without a word don't count.
    line = np.ones(256, bool)
    line[10] = False
    ls, le, lr = words_of(data, offs, line)
    has = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le, lr = ls[has], le[has], lr[has]
    salt = lambda r: mix(r.astype(U64) + U64(0x51ED270B))
    _, at = np.unique(exact_hashes(data, ls, le) ^ salt(lr), return_index=True)
    n_lines = np.bincount(lr, minlength=n)
    dup = n_lines - np.bincount(lr[at], minlength=n)
    # Windows of 8 words, those within one row.
    repeat = np.zeros(n, np.int64)
    if len(starts) >= 8:
        ok = np.flatnonzero(rows[7:] == rows[:-7])
        if len(ok):
            h = runs_of(exact_hashes(data, starts, ends), 8)[ok] ^ salt(rows[ok])
            order = np.argsort(h, kind="stable")
            s = h[order]
            same = s[1:] == s[:-1]
            twice = np.zeros(len(s), bool)
            twice[1:] |= same
            twice[:-1] |= same
            hit = ok[order[twice]]
            if len(hit):
                cover = np.zeros(len(starts) + 1, np.int64)
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + 8, -1)
                repeat = np.bincount(rows[np.cumsum(cover[:-1]) > 0], minlength=n)
    up = UPPER[data]
    up[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    return [n_words, chars, per_row(SYMBOLS[data]), dup, repeat, n_lines, per_row(up), per_row(PUNCT[data])]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds COUNTS to each row; columns of these names are replaced. A null text counts as empty: all are 0."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in COUNTS]
    src = docs.select(*(F.col(f"`{c}`") for c in kept))
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for b in parts(batches, 2048):
            data, offs = bytes_of(b.column(at))
            made = [counts(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in slices(offs)]
            cols = [np.concatenate([m[k] for m in made]) if made else np.zeros(0, np.int64) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in cols)], [*kept, *COUNTS])

    return src.mapInArrow(run, src.select("*", *(F.lit(0).cast("long").alias(c) for c in COUNTS)).schema)


def rate(rule: str) -> Column:
    a, b, _ = RULES[rule]
    return F.expr(f"CASE WHEN {b} > 0 THEN (1000 * {a}) DIV {b} ELSE 0 END")


def bucket(v: Column) -> Column:
    """Exact below 32; then the power of two and the next five bits."""
    e = F.length(F.bin(v)) - 1
    return F.when(v < 32, v).otherwise(32 * (e - 5) + F.floor(v / F.pow(F.lit(2.0), e - 5)).cast("long"))


def lowest(b: Column) -> Column:
    """The smallest value of a bucket."""
    e = F.floor(b / 32) + 4
    return F.when(b < 32, b).otherwise(((b % 32 + 32) * F.pow(F.lit(2.0), e - 5)).cast("long"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, rule, bucket, n: the histograms of rows that pass the base rules. rows: lang, source and COUNTS."""
    each = rows.filter(~base_failed()).select("lang", "source", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), bucket(rate(r)).alias("bucket")) for r in RULES))).alias("x"))
    return each.select("lang", "source", "x.*").groupBy("lang", "source", "rule", "bucket").agg(F.count("*").alias("n"))


def middle(h: Column) -> Column:
    """width, lo, hi of a sketch (sorted structs of upto, lo, hi): the closest pair of quantiles that holds half of the rows, or nine tenths where that is one value."""
    least = lambda k: F.get(F.filter(h, lambda x: x["upto"] * STEPS >= F.element_at(h, -1)["upto"] * k), F.lit(0))

    def closest(q):
        pair = lambda k, step: F.struct((F.get(q, k + step)["hi"] - F.get(q, k)["lo"]).alias("width"), F.get(q, k)["lo"].alias("lo"), F.get(q, k + step)["hi"].alias("hi"))
        pairs = lambda step: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(STEPS - step)), lambda k: pair(k, step)))
        both = F.transform(F.array(F.lit(HALF), F.lit(MOST)), pairs)
        return F.coalesce(F.get(F.filter(both, lambda x: x["width"] > 0), F.lit(0)), F.get(both, F.lit(0)))

    return F.get(F.transform(F.array(F.transform(F.sequence(F.lit(0), F.lit(STEPS)), least)), closest), F.lit(0))


def limits(sketch: DataFrame, *, spread: int = 8, least: int = 100) -> DataFrame:
    """g_lang, g_source, then lo_<rule> and hi_<rule> for each group, from its own rows or from the smallest larger set that has `least` rows.

    A group's sketch has as many entries as there are buckets, some hundreds at most, and is one row where it is read.
    """
    levels = [["lang", "source", "rule"], ["lang", "rule"], ["rule"]]
    made = []
    for keys in levels:
        m = sketch.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket"))
        m = m.select(*keys, F.struct(upto.alias("upto"), lowest(F.col("bucket")).alias("lo"), (lowest(F.col("bucket") + 1) - 1).alias("hi")).alias("x"))
        made.append(m.groupBy(*keys).agg(F.sort_array(F.collect_list("x")).alias("h")).select(*keys, F.element_at("h", -1)["upto"].alias("all"), middle(F.col("h")).alias("m")))
    fine, lang, whole = made
    a, b, c = fine.alias("a"), lang.alias("b"), whole.alias("c")
    one = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.rule") == F.col("b.rule"))).join(c, F.col("a.rule") == F.col("c.rule"))
    m = F.when(F.col("a.all") >= least, F.col("a.m")).when(F.col("b.all") >= least, F.col("b.m")).otherwise(F.col("c.m"))
    one = one.select(F.col("a.lang").alias("g_lang"), F.col("a.source").alias("g_source"), F.col("a.rule").alias("rule"), m.alias("m"))
    one = one.select("g_lang", "g_source", "rule", (F.col("m.lo") - spread * F.col("m.width")).alias("lo"), (F.col("m.hi") + spread * F.col("m.width")).alias("hi"))
    return one.groupBy("g_lang", "g_source").agg(*(F.max(F.when(F.col("rule") == r, F.col(x))).alias(f"{x}_{r}") for r in RULES for x in ("lo", "hi")))


def judged(rows: DataFrame, lim: DataFrame, chance: int = 3) -> DataFrame:
    """Adds base_failed and kept to rows with lang, source and COUNTS. A group without limits has no row that passes the base rules."""
    ok = F.lit(True)
    for r, (a, b, low) in RULES.items():
        ok = ok & (1000 * (F.col(a) - chance) <= F.col(f"hi_{r}") * F.col(b))
        if low:
            ok = ok & (1000 * (F.col(a) + chance) >= F.col(f"lo_{r}") * F.col(b))
    both = rows.join(lim, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    return both.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(ok, F.lit(True))).drop(*lim.columns)


def quality(docs: DataFrame, *, spread: int = 8, least: int = 100) -> DataFrame:
    """doc_id, lang, source, COUNTS, base_failed, kept: one row for each row of docs (doc_id, text, lang, source).

    Null languages and sources are groups of their own; a null or empty text fails the base rules; repeated rows are
    judged alike; an empty table gives an empty result. Other columns are ignored. A group of fewer than `least` rows
    that pass the base rules is judged by its language's limits, a language of fewer by those of all rows.
    """
    rows = save(measured(docs.select("doc_id", "lang", "source", "text")).drop("text"), "quality")
    return judged(rows, limits(sketches(rows), spread=spread, least=least))


def keep(docs: DataFrame, *, spread: int = 8, least: int = 100) -> DataFrame:
    """The rows of docs that the rules keep, with its columns, whatever their names. Texts are read twice, once to learn limits, and never shuffled for it unless the limits are too many to broadcast."""
    lim = save(limits(sketches(measured(docs.select("lang", "source", "text")).drop("text")), spread=spread, least=least), "limits")
    src, at = plain(docs), {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    mine = measured(src, f"c{docs.columns.index('text')}").withColumn("lang", at["lang"]).withColumn("source", at["source"])
    return judged(mine, lim).filter("kept").select(*src.columns).toDF(*docs.columns)
