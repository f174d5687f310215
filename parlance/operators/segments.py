"""Topics and chapters of transcripts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance import lexicons as lex
from parlance.functions import text as T
from parlance.operators.hooks import hashed


def kept_tokens(text: Column, stop: list[str] | None = None) -> Column:
    """Tokens of a text that aren't stop words."""
    return F.filter(T.tokens(text), lambda w: ~w.isin(stop or lex.STOP_WORDS))


def ranked(tokens: Column, k: int = 15) -> Column:
    """The k most frequent of an array of tokens, best first, ties by first place; all within the row."""

    def best(t):
        # What is left without a token tells how often it came; removing is one pass of the engine's own code.
        counted = F.transform(F.array_distinct(t), lambda w: F.struct(F.size(F.array_remove(t, w)).alias("rest"), F.array_position(t, w).alias("at"), w.alias("w")))
        return F.slice(F.transform(F.array_sort(counted), lambda s: s["w"]), 1, k)

    return T.let(tokens, best)


def similarities(s: Column, least: int = 3, stop: list[str] | None = None) -> Column:
    """Structs of idx and similarity for an array of sentences: keyword overlap of the up to three before and from each place on.

    Sentences are cut into tokens once, and each window of three is ranked once, though two places look at it.
    """

    def scored(tok):
        top = lambda at, n: ranked(F.flatten(F.slice(tok, at + 1, n)))
        from_ = lambda n: F.when(F.size(tok) > n, F.sequence(F.lit(n), F.greatest(F.size(tok) - 1, F.lit(n)))).otherwise(F.array().cast("array<int>"))

        def pairs(wins):
            def one(i):
                a, b = F.get(wins, i - 3), F.get(wins, i)
                if least < 3:
                    a, b = F.when(i < 3, top(F.lit(0), i)).otherwise(a), F.when(i < 3, top(i, i)).otherwise(b)
                return T.let(F.struct(a.alias("a"), b.alias("b")), lambda x: F.when((F.size(x["a"]) > 0) & (F.size(x["b"]) > 0), F.struct(i.alias("idx"), F.round(F.size(F.array_intersect(x["a"], x["b"])) / F.size(F.array_union(x["a"], x["b"])), 6).alias("similarity"))))

            return F.filter(F.transform(from_(least), one), lambda x: x.isNotNull())

        return T.let(F.transform(from_(0), lambda i: top(i, 3)), pairs)

    return T.let(F.transform(s, lambda x: kept_tokens(x, stop)), scored)


def boundary_scores(docs: DataFrame, least: int = 3, stop: list[str] | None = None) -> DataFrame:
    """video_id, idx, similarity: keyword overlap of the up to three sentences before and from each place on. No shuffle."""
    s = docs.select("video_id", T.let(T.sentences(F.col("text")), lambda s: similarities(s, least, stop)).alias("x"))
    return s.select("video_id", F.explode("x").alias("x")).select("video_id", "x.idx", "x.similarity")


def embedding_scores(docs: DataFrame, embed: Callable[[list[str]], np.ndarray] = hashed, size: int = 3) -> DataFrame:
    """video_id, idx, similarity: cosine of the mean vectors of up to `size` sentences before and from each place on. No shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for v, s in zip(batch["video_id"], batch["s"], strict=True):
                w = max(1, min(size, len(s) // 4))
                at = np.arange(w, len(s) - w)
                if not len(at):
                    continue
                e = np.asarray(embed(list(s)), float)
                sums = np.vstack([np.zeros(e.shape[1]), e.cumsum(axis=0)])
                a, b = (sums[at] - sums[at - w]) / w, (sums[at + w] - sums[at]) / w
                cos = (a * b).sum(axis=1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1) + 1e-8)
                yield pd.DataFrame({"video_id": v, "idx": at, "similarity": cos.round(6)})

    return docs.select("video_id", T.sentences(F.col("text")).alias("s")).mapInPandas(run, "video_id string, idx int, similarity double")


def starting(at: Column, least: int = 3) -> Column:
    """0 and the places of a sorted array that lie at least `least` behind the last that counted."""
    return F.aggregate(at, F.array(F.lit(0)), lambda a, x: F.when(x - F.element_at(a, -1) >= least, F.concat(a, F.array(x))).otherwise(a))


def boundaries(scores: DataFrame, least: int = 3, below: float = 0.2) -> DataFrame:
    """video_id, starts: places of low similarity, each at least `least` sentences behind the last that counted."""
    g = scores.filter(F.col("similarity") < below).groupBy("video_id").agg(F.array_sort(F.collect_list("idx")).alias("c"))
    return g.select("video_id", starting(F.col("c"), least).alias("starts"))


def cut(rows: DataFrame, least: int, most: int, below: float, stop: list[str], k: int = 15, named: int = 10) -> DataFrame:
    """rows (video_id, whole, s, tok: the tokens of each sentence) without tok and with starts, the first `most` of starting(), and best, the `named` most frequent tokens of each part.

    As similarities() and ranked() have it, in time that grows with the tokens: a part is as long as the rest of its text.
    Tokens are numbered by batch, so windows of sentences are slices of one list. Rows without sentences are left out.
    """
    schema = pa.list_(pa.int32()), pa.list_(pa.list_(pa.string()))

    def parts(at: list[int], codes: list[int], n: int) -> tuple[list[int], list[list[int]]]:
        """at: where each of n sentences begins in codes, and the end of the last."""
        tops: dict[tuple[int, int], set[int]] = {}

        def ranking(a: int, b: int, many: int) -> list[int]:
            c = Counter(codes[at[a] : at[min(b, n)]])  # in the order of first places, which sorting keeps for equal counts
            return sorted(c, key=c.get, reverse=True)[:many] if len(c) > 1 else list(c)

        def top(a: int, b: int) -> set[int]:
            if (a, b) not in tops:
                tops[a, b] = set(ranking(a, b, k))
            return tops[a, b]

        starts, i = [0], least
        while n >= least and i < n and len(starts) < most:
            w = min(3, i)
            a, b = (top(i - w, i), top(i, i + w)) if i - starts[-1] >= least else (None, None)
            if a and b and round(len(a & b) / len(a | b), 6) < below:
                starts.append(i)
            i += 1
        return starts[: max(most, 0)], [ranking(a, b, named) for a, b in zip(starts, [*starts[1:], n], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            # Texts without sentences go here: a filter of the engine's would cut each text twice.
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("tok")), 0))
            tok = batch.column("tok")
            inner = tok.flatten()
            flat = inner.flatten().dictionary_encode()
            code = flat.indices.to_numpy(zero_copy_only=False)
            keep = ~pc.is_in(flat.dictionary, pa.array(stop, pa.string())).to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, bool)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(inner).to_numpy(zero_copy_only=False))]).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(keep)]).astype(np.int64)[ends].tolist()
            codes, lengths = code[keep].tolist(), pc.list_value_length(tok).to_pylist()
            starts, best, first = [], [], 0
            for n in lengths:
                s, b = parts(at[first : first + n + 1], codes, n)
                starts.append(s)
                best.append(b)
                first += n
            every = [x for b in best for y in b for x in y]
            names = flat.dictionary.take(pa.array(every, pa.int32()))
            size = lambda xs: pa.array(np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int32))
            lists = pa.ListArray.from_arrays(size(best), pa.ListArray.from_arrays(size([y for b in best for y in b]), names))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("video_id", "whole", "s")] + [pa.array(starts, schema[0]), lists], ["video_id", "whole", "s", "starts", "best"])

    return rows.mapInArrow(run, "video_id string, whole string, s array<string>, starts array<int>, best array<array<string>>")


def topics(docs: DataFrame, least: int = 3, most: int = 20, stop: list[str] | None = None, below: float = 0.2, ends: DataFrame | None = None) -> DataFrame:
    """video_id, topic_id, title, summary, start_time, end_time, start_index, end_index, text, keywords, confidence.

    Boundaries are found beside the row, by cut(): no text is shuffled. A sentence takes 3 s, or its share of the video's
    length where `ends` (video_id, end: of the last recognised segment) has one.
    """
    few = F.size("s") < least
    j = docs.select("video_id", "text", T.sentences(F.col("text")).alias("s"))
    j = j.select("video_id", F.when(few, F.col("text")).alias("whole"), "s", F.transform("s", lambda x: T.tokens(x)).alias("tok"))
    j = cut(j, least, most, below, stop or lex.STOP_WORDS)
    if ends is not None:
        j = j.join(ends.select("video_id", F.col("end").cast("double").alias("long")), "video_id", "left")
    else:
        j = j.withColumn("long", F.lit(None).cast("double"))
    e = j.select("*", F.posexplode("starts").alias("topic_id", "start_index"))
    e = e.withColumn("end_index", F.coalesce(F.get("starts", F.col("topic_id") + 1), F.size("s"))).withColumn("part", F.slice("s", F.col("start_index") + 1, F.col("end_index") - F.col("start_index")))
    e = e.withColumn("keywords", F.get("best", F.col("topic_id")))
    first = F.get("part", F.lit(0))
    title = F.when(F.length(first) <= 60, F.regexp_replace(first, r"\.+$", "")).when(F.size("keywords") > 0, F.array_join(F.transform(F.slice("keywords", 1, 4), F.initcap), " — ")).otherwise(F.concat(F.array_join(F.slice(T.words(first), 1, 8), " "), F.lit("...")))
    head = F.array_join(F.slice("part", 1, 3), " ")
    summary = F.when(F.length(head) > 400, F.concat(F.substring(head, 1, 397), F.lit("..."))).otherwise(head)
    whole = F.when(F.length("whole") > 300, F.concat(F.substring("whole", 1, 300), F.lit("..."))).otherwise(F.col("whole"))
    time = lambda i: F.when(F.col("long") > 0, F.round(F.col(i) / F.size("s") * F.col("long"), 6)).otherwise(F.col(i) * 3.0)
    return e.select(
        "video_id", "topic_id", F.when(few, "Main Content").otherwise(title).alias("title"), F.when(few, whole).otherwise(summary).alias("summary"),
        F.when(few, 0.0).otherwise(time("start_index")).alias("start_time"), F.when(few, F.coalesce("long", F.lit(0.0))).otherwise(time("end_index")).alias("end_time"),
        "start_index", "end_index", F.when(few, F.col("whole")).otherwise(F.array_join("part", " ")).alias("text"), "keywords", F.when(few, 1.0).when(F.size("part") >= 5, 0.7).otherwise(0.5).alias("confidence"),
    )


def average_duration(tops: DataFrame) -> DataFrame:
    """video_id, average: the mean length of the topics that have any; 0 where none has."""
    d = F.col("end_time") - F.col("start_time")
    return tops.groupBy("video_id").agg(F.round(F.coalesce(F.avg(F.when(d > 0, d)), F.lit(0.0)), 6).alias("average"))


def chapters(tops: DataFrame, shortest: float = 60.0, most: int = 15, alike: float = 0.6) -> DataFrame:
    """video_id, chapter_id, title, start_time, end_time, duration, summary, topic_ids: topics joined in order.

    A topic joins the group before it while that is shorter than `shortest` or their keywords are alike; then the
    neighbours that are shortest together are joined until at most `most` are left. Two folds over a video's topics,
    which are few; of a topic's text only its length is shuffled. tops may have that length as `size` instead.
    """
    size = F.col("size") if "size" in tops.columns else F.length("text")
    t = F.struct("topic_id", "title", "start_time", "end_time", "summary", size.alias("size"), "keywords")
    v = tops.groupBy("video_id").agg(F.array_sort(F.collect_list(t)).alias("t"))
    long_ = lambda g: F.aggregate(g, F.lit(0.0), lambda a, x: a + (x["end_time"] - x["start_time"]))

    def grow(groups, x):
        last = F.element_at(groups, -1)
        joins = (long_(last) < shortest) | (T.jaccard(F.element_at(last, -1)["keywords"], x["keywords"]) > alike)
        return F.when(joins, F.concat(F.slice(groups, 1, F.size(groups) - 1), F.array(F.concat(last, F.array(x))))).otherwise(F.concat(groups, F.array(F.array(x))))

    def shrink(groups, _):
        pairs = F.transform(F.sequence(F.lit(0), F.size(groups) - 2), lambda i: F.struct((long_(F.get(groups, i)) + long_(F.get(groups, i + 1))).alias("d"), i.alias("i")))
        def merged(i):
            return F.concat(F.slice(groups, 1, i), F.array(F.concat(F.get(groups, i), F.get(groups, i + 1))), F.slice(groups, i + 3, F.size(groups)))
        return F.when(F.size(groups) > max(most, 1), T.let(F.array_min(pairs)["i"], merged)).otherwise(groups)

    grown = F.aggregate(F.slice("t", 2, F.size("t")), F.array(F.slice("t", 1, 1)), grow)
    v = v.select("video_id", grown.alias("g"))
    v = v.select("video_id", F.aggregate(F.sequence(F.lit(1), F.size("g")), F.col("g"), shrink).alias("g"))
    e = v.select("video_id", F.posexplode("g").alias("chapter_id", "g"))
    title = F.array_min(F.transform("g", lambda x, i: F.struct((-x["size"]).alias("n"), i.alias("i"), x["title"].alias("title"))))["title"]
    told = F.substring(F.array_join(F.filter(F.transform("g", lambda x: x["summary"]), lambda x: x != ""), " "), 1, 500)
    start, end = F.get("g", F.lit(0))["start_time"], F.element_at("g", -1)["end_time"]
    return e.select("video_id", "chapter_id", title.alias("title"), start.alias("start_time"), end.alias("end_time"), (end - start).alias("duration"), told.alias("summary"), F.transform("g", lambda x: x["topic_id"]).alias("topic_ids"))


def nearest(targets: DataFrame, signals: DataFrame, within: float = 10.0) -> DataFrame:
    """targets with `at`: the signal of the same video nearest to t, at most `within` away; ties to the smaller. targets: video_id, id, t; signals: video_id, s.

    Times are dealt to buckets of `within` seconds, so the join has equal keys and no bucket meets another.
    """
    b = F.floor(F.col("t") / within)
    t = targets.withColumn("b", F.explode(F.array(b - 1, b, b + 1)))
    s = signals.select("video_id", "s", F.floor(F.col("s") / within).alias("b"))
    near = t.join(s, ["video_id", "b"]).filter(F.abs(F.col("t") - F.col("s")) <= within)
    best = near.groupBy("video_id", "id").agg(F.min(F.struct(F.round(F.abs(F.col("t") - F.col("s")), 6).alias("d"), "s")).alias("m"))
    return targets.join(best, ["video_id", "id"], "left").select("video_id", "id", "t", F.col("m.s").alias("at"))


def chapter_list(chaps: DataFrame, fmt: str = "youtube") -> DataFrame:
    """video_id, body: the chapters as youtube, srt, vtt or ffmpeg text."""
    i, c = F.col("chapter_id") + 1, F.col
    if fmt == "youtube":
        line, sep, head = F.concat_ws(" ", T.stamp(c("start_time")), c("title")), "\n", ""
    elif fmt == "srt":
        line, sep, head = F.concat_ws("\n", i.cast("string"), F.concat_ws(" --> ", T.clock(c("start_time"), ","), T.clock(c("end_time"), ",")), c("title"), F.lit("")), "\n", ""
    elif fmt == "vtt":
        line, sep, head = F.concat_ws("\n", F.concat_ws(" --> ", T.clock(c("start_time"), "."), T.clock(c("end_time"), ".")), c("title"), F.lit("")), "\n", "WEBVTT\n\n"
    elif fmt == "ffmpeg":
        ms = lambda x: F.floor(c(x) * 1000).cast("string")
        line, sep, head = F.concat_ws("\n", F.lit("[CHAPTER]"), F.lit("TIMEBASE=1/1000"), F.concat(F.lit("START="), ms("start_time")), F.concat(F.lit("END="), ms("end_time")), F.concat(F.lit("title="), c("title"))), "\n", ";FFMETADATA1\n"
    else:
        raise ValueError(f"no such format: {fmt}")
    g = chaps.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("chapter_id", line.alias("l")))).alias("l"))
    return g.select("video_id", F.concat(F.lit(head), F.array_join("l.l", sep)).alias("body"))
