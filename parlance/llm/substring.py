"""Substring dedup (operator 1): lines and paragraphs that repeat, then passages that repeat within other lines.

First pass, by the method's name: each line and each paragraph (lines up to an empty one) of at least `least` words is a
unit. Units are normalised (ASCII letters in lower case, white space as one break), their 128-bit digests are grouped
globally, the earliest occurrence by (doc_id, text hash, place) stays, and the others go.

Second pass: repeated passages that are spliced into a line have none of their lines in common, so units there are runs
of `gram` words, cut anywhere, and sampled by winnowing: of each `window` neighbouring runs the one of least hash is a
unit, so any passage of gram + window - 1 = 50 words has a unit that depends on the passage alone. Units are normalised
and grouped as above. All but the earliest are joined to runs, each is extended word by word on both sides as long as it
agrees with the earlier text, and runs of at least `least` words go too. Original character offsets are retained.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import SPACE, U64, bytes_of, drop, hold, mix, parts, plain, runs_of, save, ship, slices, word_hashes, words_of

GRAM, WINDOW, LEAST = 26, 25, 50
LAST = 2**63 - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """d, th, text: a null id ranks last; rows alike in id and text are one occurrence."""
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("d"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))


def units(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """d, th, h, pos: the sampled runs of each text; pos counts words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for b in parts(batches, 2048):
            data, offs = bytes_of(b.column(2))
            for i, j in slices(offs):
                d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                starts, ends, rows = words_of(d, o, ~SPACE)
                span = gram + window - 1
                if len(starts) < span:
                    continue
                h = runs_of(word_hashes(d, starts, ends), gram)
                # Position in the low bits: the least value of a window names its place.
                low = U64((1 << 24) - 1)
                if len(h) >= 1 << 24:
                    low = U64((1 << 32) - 1)
                v = (h & ~low) | np.arange(len(h), dtype=U64)
                m, size = v, 1
                while size < window:
                    step = min(size, window - size)
                    nxt = m.copy()
                    np.minimum(m[:-step], m[step:], out=nxt[:-step])
                    m, size = nxt, size + step
                full = np.flatnonzero(rows[span - 1 :] == rows[: len(rows) - span + 1])
                at = np.unique((m[full] & low).astype(np.int64))
                per = np.bincount(rows, minlength=j - i)
                r = rows[at]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i).take(pa.array(r)), b.column(1).slice(i, j - i).take(pa.array(r)), pa.array(h[at].view(np.int64)), pa.array((at - (np.cumsum(per) - per)[r]).astype(np.int32))],
                    ["d", "th", "h", "pos"],
                )

    return _keyed(docs).mapInArrow(run, "d long, th long, h long, pos int")


def lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """d, th, h, k, a, b: digest and place, in words [a, b), of each line and paragraph of at least `least` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for batch in parts(batches, 2048):
            data, offs = bytes_of(batch.column(2))
            for i, j in slices(offs):
                d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                starts, ends, rows = words_of(d, o, ~SPACE)
                if len(starts) < least:
                    continue
                wh = word_hashes(d, starts, ends)
                breaks = np.cumsum(d == 10)[starts]  # line feeds before each word
                fresh, gap = np.diff(rows, prepend=-1) > 0, np.diff(breaks, prepend=0)
                begin = np.searchsorted(rows, np.arange(j - i))
                found = [np.zeros(0, np.int64)] * 2
                for many in (1, 2):  # a line ends at one line feed, a paragraph at two
                    cut = np.flatnonzero(fresh | (gap >= many))
                    to = np.append(cut[1:], len(starts))
                    long_ = to - cut >= least
                    found = [np.concatenate([f, x[long_]]) for f, x in zip(found, (cut, to), strict=True)]
                both = np.unique(np.stack(found, 1), axis=0)  # a paragraph of one line is one unit
                if not len(both):
                    continue
                a, b = both[:, 0], both[:, 1]
                lens = b - a
                base = np.cumsum(lens) - lens
                nth = np.arange(int(lens.sum())) - np.repeat(base, lens)
                word = wh[np.repeat(a, lens) + nth]
                keys = [mix(np.add.reduceat(mix(word + nth.astype(U64) * U64(mul) + U64(c)), base) + lens.astype(U64)) for c, mul in ((0, 0x9E3779B97F4A7C15), (1, 0xC2B2AE3D27D4EB4F))]
                r = rows[a]
                some = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(r)), some.column(1).take(pa.array(r)), *(pa.array(x.view(np.int64)) for x in keys), *(pa.array((x - begin[r]).astype(np.int32)) for x in (a, b))],
                    ["d", "th", "h", "k", "a", "b"],
                )

    return _keyed(docs).mapInArrow(run, "d long, th long, h long, k long, a int, b int")


def repeated_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """d, th, a, b: the lines and paragraphs that an earlier place has too."""
    ship(docs.sparkSession)
    u = save(lines(docs, least), "lines")
    first = u.groupBy("h", "k").agg(F.count("*").alias("n"), F.min(F.struct("d", "th", "a")).alias("f")).filter("n > 1").select("h", "k", "f")
    first = save(first, "first")  # a join whose sides are both plain exchanges can be split where a line is hot
    out = save(u.join(first, ["h", "k"]).filter(F.struct("d", "th", "a") != F.col("f")).select("d", "th", "a", "b").distinct(), "line_spans")
    drop(u, first)
    return out


def contexts(rows: DataFrame, reach: int) -> DataFrame:
    """d, th, side, edge, ctx: hashes of up to `reach` words before (side 0, nearest first) or from (side 1) each edge asked for. rows: d, th, text, edges (array of side, edge)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            data, offs = bytes_of(b.column(2))
            out: list[list] = [[], [], [], [], []]
            for i in range(b.num_rows):
                t = data[offs[i] : offs[i + 1]]
                starts, ends, _ = words_of(t, np.array([0, len(t)]), ~SPACE)
                wh = (word_hashes(t, starts, ends) >> U64(32)).astype(np.uint32).view(np.int32)
                d, th = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                for x in b.column(3)[i].as_py():
                    e = x["edge"]
                    c = wh[max(0, e - reach) : e][::-1] if x["side"] == 0 else wh[e : e + reach]
                    for o, y in zip(out, (d, th, x["side"], e, c), strict=True):
                        o.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.list_(pa.int32()))], ["d", "th", "side", "edge", "ctx"])

    return rows.select("d", "th", "text", "edges").mapInArrow(run, "d long, th long, side int, edge int, ctx array<int>")


def repeats(docs: DataFrame, *, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """d, th, a, b: the runs of words [a, b) that an earlier place has too."""
    ship(docs.sparkSession)
    u = save(units(docs, gram, window), "units")
    # Most units stand alone. Counts need only their hashes; whole units are shuffled once, and what repeats is little.
    many = save(u.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "repeated")
    again = save(u.join(many.hint("merge"), "h", "left_semi"), "again")
    drop(u, many)
    first = again.groupBy("h").agg(F.min(F.struct("d", "th", "pos")).alias("f")).select("h", F.col("f.d").alias("fd"), F.col("f.th").alias("fth"), F.col("f.pos").alias("fpos"))
    first = save(first, "first")  # a join whose sides are both plain exchanges can be split where a unit is hot
    own = (F.col("d") == F.col("fd")) & (F.col("th") == F.col("fth"))
    later = again.join(first, "h").filter(~own | (F.col("pos") - F.col("fpos") >= gram)).select("d", "th", "pos", "fd", "fth", (F.col("pos") - F.col("fpos")).alias("shift")).distinct()
    w = Window.partitionBy("d", "th").orderBy("pos")
    same = (F.lag("fd").over(w) == F.col("fd")) & (F.lag("fth").over(w) == F.col("fth")) & (F.lag("shift").over(w) == F.col("shift")) & (F.col("pos") - F.lag("pos").over(w) <= gram)
    runs = later.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    runs = save(runs.groupBy("d", "th", "run").agg(F.min("pos").alias("a"), (F.max("pos") + gram).alias("b"), F.first("fd").alias("fd"), F.first("fth").alias("fth"), F.first("shift").alias("shift")), "runs")
    drop(again, first)

    side = lambda s, e: F.struct(F.lit(s).alias("side"), e.cast("int").alias("edge"), (e - F.col("shift")).cast("int").alias("fedge"))
    ends = runs.select("d", "th", "run", "fd", "fth", F.explode(F.array(side(0, F.col("a")), side(1, F.col("b")))).alias("e")).select("d", "th", "run", "fd", "fth", "e.*")
    asked = ends.select("d", "th", "side", "edge").union(ends.select("fd", "fth", "side", "fedge")).distinct()
    asked = save(asked.groupBy("d", "th").agg(F.collect_list(F.struct("side", "edge")).alias("edges")), "asked")
    reach = window - 1
    # Texts meet the little that is known of them in one way at every size: by an exchange, without a sort of the texts.
    texts = _keyed(docs).join(asked.hint("shuffle_hash"), ["d", "th"])
    ctx = save(contexts(texts, reach).dropDuplicates(["d", "th", "side", "edge"]), "contexts")
    drop(asked)
    theirs = ctx.select(F.col("d").alias("fd"), F.col("th").alias("fth"), "side", F.col("edge").alias("fedge"), F.col("ctx").alias("fctx"))
    both = ends.join(ctx, ["d", "th", "side", "edge"]).join(theirs, ["fd", "fth", "side", "fedge"])
    stop = F.array_position(F.zip_with("ctx", "fctx", lambda x, y: x.eqNullSafe(y)), False)
    more = F.when(stop == 0, F.size("ctx")).otherwise(stop - 1).cast("int")
    grown = both.select("d", "th", "run", "side", F.when(F.col("side") == 0, F.col("edge") - more).otherwise(F.col("edge") + more).alias("at"))
    out = save(grown.groupBy("d", "th", "run").agg(F.min("at").alias("a"), F.max("at").alias("b")).drop("run"), "run_spans")
    drop(runs, ctx)
    return out


def substring_dedup(docs: DataFrame, *, least: int = LEAST, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """docs with `text` cut and with spans (array of start, end: characters of the original text) and n_removed (words).

    A repeated run goes with the white space behind it; what stays is not changed otherwise. Columns named spans or
    n_removed are replaced. Null texts stay null, short ones as they are; rows alike in id and text are one occurrence
    and are treated alike; a null id ranks last. In a text that repeats itself, what doesn't overlap its model goes.
    """
    spans = repeated_lines(docs, least).unionByName(repeats(docs, gram=gram, window=window))
    marks = save(spans.groupBy("d", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("spans", "n_removed")))
    at, names = kept.columns.index("text"), [f"c{i}" for i in range(len(kept.columns))]
    src = plain(kept).withColumn("d", F.coalesce(F.col(names[kept.columns.index("doc_id")]), F.lit(LAST))).withColumn("th", F.xxhash64(names[at]))
    src = src.join(marks.hint("shuffle_hash"), ["d", "th"], "left").select(*names, "spans")
    schema = src.select(*names, F.expr("cast(null as array<struct<start: long, end: long>>)").alias("spans"), F.lit(0).cast("long").alias("n_removed")).schema
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            texts, spans, gone = [], [], []
            for t, s in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                found, n = [], 0
                if s:
                    joined: list[list[int]] = []
                    for a, e in sorted((x["a"], x["b"]) for x in s):
                        if joined and a <= joined[-1][1]:
                            joined[-1][1] = max(joined[-1][1], e)
                        else:
                            joined.append([a, e])
                    joined = [x for x in joined if x[1] - x[0] >= least]
                    if joined:
                        raw = np.frombuffer(t.encode(), np.uint8)
                        starts, _, _ = words_of(raw, np.array([0, len(raw)]), ~SPACE)
                        chars = np.cumsum((raw & 0xC0) != 0x80) - 1
                        place = np.append(chars[starts], len(t))
                        found = [(int(place[a]), int(place[e])) for a, e in joined]
                        n = sum(e - a for a, e in joined)
                        stay, last = [], 0
                        for a, e in found:
                            stay.append(t[last:a])
                            last = e
                        t = "".join([*stay, t[last:]])
                texts.append(t)
                spans.append([{"start": a, "end": e} for a, e in found])
                gone.append(n)
            cols = [pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, kind), pa.array(gone, pa.int64())], [*names, "spans", "n_removed"])

    return src.mapInArrow(run, schema).toDF(*kept.columns, "spans", "n_removed")
