"""Sentences, keywords, sentiment, phrases and insights of transcripts (video_id, text). One row for each sentence or finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance import lexicons as lex
from parlance.functions import text as T


def sentence_split(docs: DataFrame) -> DataFrame:
    """video_id, idx, sentence. No shuffle."""
    return docs.select("video_id", F.posexplode(T.sentences(F.col("text"))).alias("idx", "sentence"))


def keywords(docs: DataFrame, k: int = 15, stop: list[str] | None = None) -> DataFrame:
    """video_id, rank, token, n: the k most frequent tokens that aren't stop words; ties by first place."""
    t = docs.select("video_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "token")).filter(~F.col("token").isin(stop or lex.STOP_WORDS))
    c = t.groupBy("video_id", "token").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("n"), "first"))
    return c.withColumn("rank", rank).filter(F.col("rank") <= k).select("video_id", "rank", "token", "n")


def running(d: Column, block: int = 256) -> Column:
    """Sums of the integers before each element and, last, of all: by blocks, so that long arrays aren't copied for each element."""
    add = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    zero = F.array(F.lit(0).cast("long"))

    def inner(d):
        at = F.when(F.size(d) > 0, F.sequence(F.lit(1), F.greatest(F.size(d), F.lit(1)), F.lit(block))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.aggregate(F.slice(d, i, block), zero, add))

    def joined(parts):
        before = F.aggregate(parts, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(x, -1))))
        rest = lambda bases: F.flatten(F.transform(parts, lambda x, i: F.transform(F.slice(x, 2, F.size(x)), lambda y: y + F.get(bases, i))))
        return F.concat(zero, T.let(before, rest))

    return T.let(T.let(d, inner), joined)


def clocked(s: Column) -> Column:
    """Structs of sentence, start and end (tenths of a second) of an array of sentences: 0.4 s a word, and a second at least."""
    long_ = lambda x: F.greatest(F.lit(10), F.size(T.words(x)) * 4).cast("long")
    each = lambda s: T.let(running(F.transform(s, long_)), lambda c: F.transform(s, lambda x, i: F.struct(x.alias("sentence"), F.get(c, i).alias("a"), F.get(c, i + 1).alias("b"))))
    return T.let(s, each)


def spoken(text: Column) -> Column:
    """The text's sentences; a text without any is one."""
    t = F.coalesce(text, F.lit(""))

    def or_whole(s):
        return F.when((F.size(s) == 0) & (T.strip(t) != ""), F.array(T.strip(t))).otherwise(s)

    return T.let(T.split_terminated(t), or_whole)


def timed_sentences(docs: DataFrame) -> DataFrame:
    """video_id, idx, sentence, start, end, total: 0.4 s a word and a second at least; a text without sentences is one. A fold in the row: no shuffle."""
    s = docs.select("video_id", clocked(spoken(F.col("text"))).alias("s"))
    e = T.rows_of(s, F.col("s"), "idx", "x").withColumn("total", F.size("s").cast("long"))
    return e.select("video_id", "idx", "x.sentence", (F.col("x.a") / 10).alias("start"), (F.col("x.b") / 10).alias("end"), "total")


def timed_segments(segments: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """As timed_sentences(), from recognised segments (video_id, ord, start, end, text) where a video has any that isn't blank, in their order and with their times; else from docs (video_id, text)."""
    t = T.strip(F.coalesce("text", F.lit("")))
    said = segments.select("video_id", "ord", t.alias("sentence"), F.coalesce(F.col("start").cast("double"), F.lit(0.0)).alias("start"), F.coalesce(F.col("end").cast("double"), F.lit(0.0)).alias("end")).filter("sentence <> ''")
    w = Window.partitionBy("video_id")
    said = said.select("video_id", (F.row_number().over(w.orderBy("ord")) - 1).alias("idx"), "sentence", "start", "end", F.count("*").over(w).alias("total"))
    if docs is None:
        return said
    return said.unionByName(timed_sentences(docs.join(said.select("video_id").distinct(), "video_id", "left_anti")))


def sentiment_arc(timed: DataFrame, positive: list[str] | None = None, negative: list[str] | None = None, size: int = 5) -> DataFrame:
    """video_id, idx, start, end, score, label: windows of `size` sentences, every size // 2; shorter at the end."""
    w = Window.partitionBy("video_id").orderBy("idx").rowsBetween(0, size - 1)
    s = timed.select("video_id", "idx", "start", F.last("end").over(w).alias("end"), F.array_join(F.collect_list("sentence").over(w), " ").alias("text"))
    s = s.filter(F.col("idx") % max(1, size // 2) == 0).withColumn("w", F.array_distinct(T.tokens(F.col("text"), 1)))
    hits = lambda x: F.size(F.array_intersect("w", F.array(*map(F.lit, x))))
    s = s.withColumn("p", hits(positive or lex.POSITIVE)).withColumn("n", hits(negative or lex.NEGATIVE))
    score = F.when(F.col("p") + F.col("n") == 0, 0.0).otherwise((F.col("p") - F.col("n")) / F.greatest(F.col("p") + F.col("n"), F.lit(1)))
    return s.withColumn("score", F.round(score, 6)).select("video_id", "idx", "start", "end", "score", T.five_labels(F.col("score"), 0.5, 0.15).alias("label"))


def overall_sentiment(arc: DataFrame) -> DataFrame:
    o = arc.groupBy("video_id").agg(F.round(F.avg("score"), 6).alias("score"), F.count("*").alias("windows"))
    return o.select("video_id", "score", "windows", T.five_labels(F.col("score"), 0.3, 0.1).alias("label"))


def phrases(timed: DataFrame, least: int = 2, sizes: tuple[int, int] = (3, 6), stop: list[str] | None = None) -> DataFrame:
    """video_id, phrase, n, first_idx, first_pos: word runs said `least` times or more, without those of over 60 % stop words.

    Sentences are dealt by video once; runs are counted there by a 64-bit hash, which nothing but its video shares, and
    only what is said often enough becomes a string again.
    """
    stop_words = stop or lex.PHRASE_STOP_WORDS
    s = timed.select("video_id", "idx", T.words(F.lower("sentence")).alias("w")).filter(F.size("w") >= sizes[0]).repartition("video_id")
    f = s.select("video_id", "idx", "w", F.transform("w", lambda x: x.isin(stop_words).cast("int")).alias("f"))
    e = f.select("video_id", "idx", "w", "f", F.explode(F.sequence(F.lit(0), F.size("w") - sizes[0])).alias("pos"))
    word = lambda i: F.get("w", F.col("pos") + i)
    stops = lambda n: sum((F.get("f", F.col("pos") + i) for i in range(n)), F.lit(0))
    runs = [F.when(F.col("pos") + n <= F.size("w"), F.when(stops(n) * 10 <= n * 6, F.struct(F.lit(n).alias("n"), F.xxhash64(*map(word, range(n))).alias("h")))) for n in range(sizes[0], sizes[1] + 1)]
    g = e.select("video_id", "idx", "pos", F.explode(F.array(*runs)).alias("r")).filter("r is not null")
    place = F.shiftleft(F.col("idx").cast("long"), 32) + F.col("pos")
    c = g.groupBy("video_id", "r.n", "r.h").agg(F.count("*").alias("c"), F.min(place).alias("at")).filter(F.col("c") >= least)
    c = c.groupBy("video_id").agg(F.collect_list(F.struct("n", "c", "at")).alias("l"))
    words = s.groupBy("video_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "w"))).alias("m"))
    j = c.join(words.hint("shuffle_hash"), "video_id").select("video_id", "m", F.explode("l").alias("x"))
    idx, pos = F.shiftright("x.at", 32).cast("int"), F.col("x.at").bitwiseAND(F.lit(2**32 - 1)).cast("int")
    return j.select("video_id", F.array_join(F.slice(F.col("m")[idx], pos + 1, F.col("x.n")), " ").alias("phrase"), F.col("x.c").alias("n"), idx.alias("first_idx"), pos.alias("first_pos"))


def _chosen(found: DataFrame, most: int) -> DataFrame:
    """video_id, l: the most frequent phrases none of which contains another, best first; a fold over each video's sorted list."""
    size = F.size(F.split("phrase", " "))
    g = found.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "first_idx", size.alias("size"), "first_pos", "phrase"))).alias("l"))
    none = F.slice("l", 1, 0)
    fold = F.aggregate("l", none, lambda a, x: F.when((F.size(a) >= most) | F.exists(a, lambda y: F.contains(y["phrase"], x["phrase"]) | F.contains(x["phrase"], y["phrase"])), a).otherwise(F.concat(a, F.array(x))))
    return g.select("video_id", fold.alias("l"))


def repeated(found: DataFrame, most: int = 10) -> DataFrame:
    """video_id, phrases: the most frequent phrases none of which contains another; of equal ones the first said, then the shorter."""
    return _chosen(found, most).select("video_id", F.col("l.phrase").alias("phrases"))


def matches(timed: DataFrame, patterns: dict[str, list[str]] | None = None, *, least: float = 0.3, weights: dict[str, float] | None = None) -> DataFrame:
    """video_id, idx, ord, type, text, start, end, importance, confidence, context: one row for each sentence and type whose patterns match."""
    pats, weights = patterns or lex.PATTERNS, weights or lex.TYPE_WEIGHTS
    w = Window.partitionBy("video_id").orderBy("idx")
    s = timed.withColumn("context", F.substring(F.concat_ws(" ", F.lag("sentence").over(w), F.lit("[...]"), F.lead("sentence").over(w)), 1, 300))
    rel = F.col("idx") / F.greatest(F.col("total") - 1, F.lit(1))
    n = F.size(T.words(F.col("sentence")))
    bonus = F.when((rel < 0.15) | (rel > 0.85), 0.15).when((rel < 0.3) | (rel > 0.7), 0.05).otherwise(0.0)
    bonus = bonus + F.when(n.between(8, 25), 0.1).otherwise(0.0) + F.when(F.col("sentence").rlike(r"\d"), 0.05).otherwise(0.0)
    bonus = bonus + F.when(F.col("sentence").rlike(lex.PROPER), 0.05).otherwise(0.0)
    hits = [sum((F.col("sentence").rlike("(?i)" + p).cast("int") for p in ps), F.lit(0)) for ps in pats.values()]
    kinds = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(k).alias("type"), h.alias("hits"), F.lit(float(weights.get(k, 0.3))).alias("weight")) for i, (k, h) in enumerate(zip(pats, hits, strict=True))))
    e = s.withColumn("bonus", bonus).withColumn("k", F.explode(F.filter(kinds, lambda x: x["hits"] > 0)))
    e = e.withColumn("importance", F.round(F.least(F.lit(1.0), F.col("k.weight") + F.col("bonus")), 6)).filter(F.col("importance") >= least)
    return e.select("video_id", "idx", F.col("k.ord").alias("ord"), F.col("k.type").alias("type"), F.col("sentence").alias("text"), "start", "end", "importance", F.round(F.least(F.lit(1.0), 0.5 + 0.15 * F.col("k.hits")), 6).alias("confidence"), "context")


def best(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """Of rows whose texts begin alike (80 characters) the first by `order`, then the `most` most important, with their rank."""
    e = rows.withColumn("first", F.row_number().over(Window.partitionBy("video_id", F.lower(F.col("text")).substr(1, 80)).orderBy(*order))).filter("first = 1")
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("importance"), *order))
    return e.drop("first").withColumn("rank", rank).filter(F.col("rank") <= most)


def insights(timed: DataFrame, patterns: dict[str, list[str]] | None = None, *, least: float = 0.3, most: int = 50, weights: dict[str, float] | None = None) -> DataFrame:
    """video_id, idx, type, text, start, end, importance, confidence, context, rank: what patterns find.

    One finding for each sentence and type whose patterns match; the first type of a text counts; best first.
    """
    return best(matches(timed, patterns, least=least, weights=weights), most, "idx", "ord").drop("ord")


def numbered(mark: str, *order: str) -> Column:
    """mark, the beginning of the video's id, and a number of four digits or more within the video."""
    n = F.row_number().over(Window.partitionBy("video_id").orderBy(*order))
    return F.format_string("%s-%s-%04d", F.lit(mark), F.substring("video_id", 1, 8), n)


def findings(timed: DataFrame, patterns: dict[str, list[str]] | None = None, *, least: float = 0.3, most: int = 50, strong: list[str] | None = None, backreference: bool = True, stop: list[str] | None = None) -> DataFrame:
    """video_id, insight_id, type, text, start, end, importance, confidence, context, tags, rank: patterns' findings, quotes and repeated phrases together.

    Each kind is numbered before they meet. Of texts that begin alike the first stays: patterns before quotes before
    phrases. Only patterns' findings must reach `least`. The most important come first.
    """
    none, words = F.lit("").alias("context"), lambda *x: F.array(*map(F.lit, x)).alias("tags")
    a = matches(timed, patterns, least=least).withColumn("insight_id", numbered("INS", "idx", "ord"))
    a = a.select("video_id", F.lit(0).alias("src"), "idx", "ord", "insight_id", "type", "text", "start", "end", "importance", "confidence", "context", tags(F.col("text"), F.col("type")).alias("tags"))
    q = quotes(timed, backreference=backreference, strong=strong).withColumn("insight_id", numbered("QUO", "idx"))
    q = q.select("video_id", F.lit(1).alias("src"), "idx", F.lit(0).alias("ord"), "insight_id", F.lit("quote").alias("type"), "text", "start", "end", F.round(F.least(F.lit(1.0), F.col("score") + 0.1), 6).alias("importance"), F.least(F.lit(1.0), "score").alias("confidence"), none, words("quote", "highlight"))
    r = _chosen(phrases(timed, stop=stop), 10).select("video_id", F.posexplode("l").alias("ord", "x"))
    r = r.join(timed.select("video_id", F.col("idx").alias("first_idx"), "start", "end"), (F.col("x.first_idx") == F.col("first_idx")) & (r["video_id"] == timed["video_id"])).drop(timed["video_id"])
    count = -F.col("x.n")
    r = r.select("video_id", F.lit(2).alias("src"), F.col("x.first_idx").alias("idx"), "ord", F.format_string("REP-%s-%04d", F.substring("video_id", 1, 8), F.col("ord") + 1).alias("insight_id"), F.lit("emphasis").alias("type"), F.col("x.phrase").alias("text"), "start", "end",
                 F.round(F.least(F.lit(1.0), 0.4 + 0.1 * count), 6).alias("importance"), F.lit(0.7).alias("confidence"), F.format_string("Repeated %d times across the video", count).alias("context"), words("repetition", "emphasis"))
    # Phrases keep their own order, findings of sentences that of the sentences.
    u = a.unionByName(q).unionByName(r.withColumn("idx", F.lit(0)))
    return best(u, most, "src", "idx", "ord").drop("src", "idx", "ord")


def with_speakers(found: DataFrame, turns: DataFrame) -> DataFrame:
    """found with the speaker_id of the first turn (video_id, speaker_id, idx, start, end) that holds its start; null if none does."""
    from parlance.operators import speakers

    at = speakers.speaker_at(found.select("video_id", F.col("start").alias("at")).distinct(), turns)
    return found.join(at.withColumnRenamed("at", "start"), ["video_id", "start"], "left")


def highlights(found: DataFrame, most: int = 20) -> DataFrame:
    """The `most` best findings of each video."""
    return found.filter(F.col("rank") <= most)


def top_quotes(found: DataFrame, most: int = 10) -> DataFrame:
    """The `most` best quotes of each video's findings, as `place` 1 and on."""
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("rank"))
    return found.filter("type = 'quote'").withColumn("place", n).filter(F.col("place") <= most)


def type_counts(found: DataFrame) -> DataFrame:
    """video_id, type, n."""
    return found.groupBy("video_id", "type").agg(F.count("*").alias("n"))


def tone_counts(arc: DataFrame) -> DataFrame:
    """video_id, label, n."""
    return arc.groupBy("video_id", "label").agg(F.count("*").alias("n"))


def reel_stats(videos: DataFrame, found: DataFrame, acts: DataFrame) -> DataFrame:
    """video_id, total_insights, total_action_items, highlight_density (of at most 20, a minute), avg_importance. videos: video_id, duration."""
    f = found.groupBy("video_id").agg(F.count("*").alias("total_insights"), F.round(F.avg("importance"), 6).alias("avg_importance"))
    a = acts.groupBy("video_id").agg(F.count("*").alias("total_action_items"))
    j = videos.select("video_id", F.coalesce(F.col("duration").cast("double"), F.lit(0.0)).alias("duration")).join(f, "video_id", "left").join(a, "video_id", "left").fillna(0)
    dense = F.least(F.lit(20), F.col("total_insights")) / F.greatest(F.col("duration") / 60, F.lit(1.0))
    return j.select("video_id", "total_insights", "total_action_items", F.round(dense, 6).alias("highlight_density"), "avg_importance")


def tags(text, kind):
    """Type, acronyms in capitals, and domains; at most ten."""
    up = F.transform(F.regexp_extract_all(text, F.lit("(?i)(" + lex.ACRONYMS + ")"), 1), F.upper)
    more = [F.when(text.rlike("(?i)" + p), F.array(F.lit(t))).otherwise(F.array().cast("array<string>")) for t, p in lex.TAGS.items()]
    return F.slice(F.array_distinct(F.concat(F.array(kind), up, *more)), 1, 10)


def quotes(timed: DataFrame, *, backreference: bool = True, strong: list[str] | None = None, least: float = 0.3) -> DataFrame:
    """video_id, idx, text, start, end, score: sentences of 30 to 200 characters that could stand alone."""
    s = F.col("sentence")
    score = F.when(s.rlike("(?i)" + lex.POINTING), 0.0).otherwise(0.1)
    score = score + F.when(F.arrays_overlap(T.words(F.lower(s)), F.array(*map(F.lit, strong or lex.STRONG_WORDS))), 0.2).otherwise(0.0)
    score = score + F.when(s.rlike("(?i)" + lex.SIMILE), 0.15).otherwise(0.0) + F.when(F.length(s) < 80, 0.1).otherwise(0.0)
    if backreference:
        score = score + F.when(s.rlike(lex.PARALLEL), 0.1).otherwise(0.0)
    score = score + F.when(F.contains(s, F.lit('"')) | F.contains(s, F.lit("«")), 0.3).otherwise(0.0)
    q = timed.filter(F.length("sentence").between(30, 200)).withColumn("score", F.round(score, 6)).filter(F.col("score") >= least)
    return q.select("video_id", "idx", s.alias("text"), "start", "end", "score")


def actions(found: DataFrame, timed: DataFrame) -> DataFrame:
    """video_id, action_id, text, priority, start, confidence: action insights by rank, then imperative sentences, numbered; the first of equal beginnings."""
    i = F.col("importance")
    a = found.filter("type = 'action_item'").select("video_id", "text", F.when(i > 0.7, "high").when(i > 0.4, "medium").otherwise("low").alias("priority"), "start", "confidence", F.lit(0).alias("src"), F.col("rank").alias("ord"))
    b = timed.filter(F.col("sentence").rlike(lex.IMPERATIVE)).select("video_id", F.col("sentence").alias("text"), F.lit("medium").alias("priority"), "start", F.lit(0.6).alias("confidence"), F.lit(1).alias("src"), F.col("idx").alias("ord"))
    u = a.unionByName(b).withColumn("action_id", F.format_string("ACT-%04d", F.row_number().over(Window.partitionBy("video_id").orderBy("src", "ord"))))
    first = F.row_number().over(Window.partitionBy("video_id", F.lower("text").substr(1, 60)).orderBy("src", "ord"))
    return u.withColumn("k", first).filter("k = 1").select("video_id", "action_id", "text", "priority", "start", "confidence")


def search(found: DataFrame, query: str = "", kind: str | None = None, least: float = 0.0, video_id: str | None = None, limit: int = 50) -> DataFrame:
    """Insights that hold the query in text or tags, best first (importance, then video and place)."""
    q = query.lower()
    hit = F.contains(F.lower("text"), F.lit(q)) | F.exists(tags(F.col("text"), F.col("type")), lambda t: F.contains(F.lower(t), F.lit(q)))
    out = found.filter(hit & (F.col("importance") >= least))
    if kind:
        out = out.filter(F.col("type") == kind)
    if video_id:
        out = out.filter(F.col("video_id") == video_id)
    return out.orderBy(F.desc("importance"), "video_id", "idx").limit(limit)
