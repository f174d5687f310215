"""Structured knowledge from a language model's replies (video_id, title, reply), and entities from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import segments

SCHEMA = "summary string, key_concepts array<struct<concept:string,explanation:string>>, key_quotes array<string>, sanskrit_terms array<struct<term:string,meaning:string,transliteration:string>>, study_questions array<string>, follow_up_topics array<string>"
FIELDS = ["summary", "key_concepts", "key_quotes", "sanskrit_terms", "study_questions", "follow_up_topics"]
# What stands in for fields that a reply lacks, and where only a list could be read.
NO_SUMMARY = "Summary not available due to extraction error."
QUESTIONS = ["What are the main themes discussed in this content?", "How can these teachings be applied in daily life?", "What questions does this content raise for further exploration?"]
LIST_QUESTIONS = ["What are the main themes discussed?", "How can these insights be applied practically?", "What aspects require further study?"]
LIST_SUMMARY, LIST_EXPLANATION = "Knowledge extraction from: ", "Extracted from partial response"
UNTITLED_SUMMARY = "Knowledge extraction completed with partial results."
HEADS = ["summary", "concept", "quote", "question"]


def parsed(replies: DataFrame) -> DataFrame:
    """video_id and the fields of each reply: of its JSON object, with defaults; else of its headed lists. A null reply is an empty list."""
    j = F.from_json("reply", SCHEMA)
    good = F.coalesce(F.regexp_like("reply", F.lit(r"(?s)^\s*\{.*\}\s*$")), F.lit(False)) & F.coalesce(F.try_parse_json("reply").isNotNull(), F.lit(False))
    r = replies.select("video_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("reply", F.lit("")).alias("reply"), j.alias("j"), good.alias("good"))
    line = r.filter("not good").select("video_id", F.posexplode(F.split("reply", "\n")).alias("pos", "line")).withColumn("line", T.strip(F.col("line"))).filter("line <> ''")
    head = F.lit(None).cast("string")
    for h in reversed(HEADS):
        head = F.when(F.contains(F.lower("line"), F.lit(h)), h).otherwise(head)
    line = line.withColumn("head", head).withColumn("part", F.last("head", True).over(Window.partitionBy("video_id").orderBy("pos")))
    item = line.filter("head is null and line rlike '^[-*]'").withColumn("item", T.strip(F.regexp_replace("line", r"^[-* ]+", ""))).filter("item <> ''")
    listed = lambda part, more: F.array_sort(F.collect_list(F.when((F.col("part") == part) & more, F.struct("pos", "item"))))["item"]
    got = item.groupBy("video_id").agg(listed("concept", F.lit(True)).alias("c"), listed("quote", F.lit(True)).alias("q"), listed("question", F.contains("item", F.lit("?"))).alias("s"))
    r = r.join(got, "video_id", "left")
    none = lambda k: F.from_json(F.lit("[]"), dict(zip(FIELDS, SCHEMA.split(", "), strict=True))[k].split(" ", 1)[1])
    texts = lambda xs: F.array(*map(F.lit, xs))
    clip = lambda x: F.when(F.length(x) > 50, F.concat(F.substring(x, 1, 50), F.lit("..."))).otherwise(x)
    empty = F.array().cast("array<string>")
    concepts = F.transform(F.coalesce("c", empty), lambda x: F.struct(clip(x).alias("concept"), F.lit(LIST_EXPLANATION).alias("explanation")))
    a = {k: F.coalesce(F.col(f"j.{k}"), none(k)) for k in FIELDS if k not in ("summary", "study_questions")}
    a |= {"summary": F.coalesce("j.summary", F.lit(NO_SUMMARY)), "study_questions": F.coalesce("j.study_questions", texts(QUESTIONS))}
    b = {"summary": F.when(F.col("title") != "", F.concat(F.lit(LIST_SUMMARY), "title")).otherwise(UNTITLED_SUMMARY), "key_concepts": concepts, "key_quotes": F.coalesce("q", empty), "study_questions": F.concat(texts(LIST_QUESTIONS), F.coalesce("s", empty))}
    return r.select("video_id", *(F.when(F.col("good"), a[k]).otherwise(b[k] if k in b else none(k)).alias(k) for k in FIELDS))


def entities(known: DataFrame) -> DataFrame:
    """video_id, entity_id, name, entity_type, frequency, description: concepts, terms and follow-up topics; a topic counts only where nothing else names it."""
    row = lambda x, name, kind, told, n: F.struct(name.alias("name"), F.lit(kind).alias("entity_type"), told.alias("description"), F.lit(n).alias("n"))
    every = F.concat(
        F.transform("key_concepts", lambda x: row(x, x["concept"], "concept", F.coalesce(x["explanation"], F.lit("")), 1)),
        F.transform("sanskrit_terms", lambda x: row(x, x["term"], "term", F.coalesce(x["meaning"], F.lit("")), 1)),
        F.transform("follow_up_topics", lambda x: row(x, x, "concept", F.concat(F.lit("Related topic: "), x), 0)),
    )
    e = known.select("video_id", F.posexplode(every).alias("ord", "e")).select("video_id", "ord", "e.*").filter("name <> ''")
    e = e.withColumn("entity_id", T.entity_id(F.col("name"), F.col("entity_type")))
    g = e.groupBy("video_id", "entity_id").agg(F.min(F.struct("ord", "name", "entity_type", "description")).alias("f"), F.greatest(F.sum("n"), F.lit(1)).alias("frequency"))
    return g.select("video_id", "entity_id", "f.name", "f.entity_type", "frequency", "f.description")


def markdown(videos: DataFrame, known: DataFrame) -> DataFrame:
    """video_id, body: parsed() knowledge in Markdown; sections without entries are left out, but for the concepts. videos: video_id, title, language, source, duration, url."""
    text = lambda c, other="": F.coalesce(c, F.lit(other))
    lines = lambda c, line: F.array_join(F.transform(F.coalesce(c, F.array().cast(known.schema[c].dataType)), line), "")
    part = lambda c, head, line, end="\n": F.when(F.size(c) > 0, F.concat(F.lit(f"## {head}\n\n"), lines(c, line), F.lit(end))).otherwise("")
    top = F.concat(
        F.lit("# "), text("title"), F.lit("\n\n**Video ID:** "), F.col("video_id"), F.lit("  \n**Language:** "), text("language"), F.lit("  \n**Source:** "), text("source"),
        F.lit("  \n**Duration:** "), text(F.col("duration").cast("string"), "Unknown"), F.lit(" seconds  \n**URL:** "), text("url"), F.lit("\n\n## Summary\n\n"), text("summary", NO_SUMMARY), F.lit("\n\n## Key Concepts\n\n"),
    )
    body = F.concat(
        top,
        lines("key_concepts", lambda x: F.concat(F.lit("### "), text(x["concept"]), F.lit("\n\n"), text(x["explanation"]), F.lit("\n\n"))),
        part("key_quotes", "Key Quotes", lambda x: F.concat(F.lit("> "), text(x), F.lit("\n\n")), ""),
        part("sanskrit_terms", "Sanskrit Terms", lambda x: F.concat(F.lit("- **"), text(x["term"]), F.lit("** ("), text(x["transliteration"]), F.lit("): "), text(x["meaning"]), F.lit("\n"))),
        part("study_questions", "Study Questions", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), text(x), F.lit("\n"))),
        part("follow_up_topics", "Follow-up Topics", lambda x: F.concat(F.lit("- "), text(x), F.lit("\n")), ""),
    )
    return videos.join(known, "video_id").select("video_id", body.alias("body"))


def extractive(docs: DataFrame, k: int = 5) -> DataFrame:
    """The fields of parsed() without a language model: the best keywords as concepts with the first sentence that holds each, quotes, and the usual questions. docs: video_id, text."""
    s = T.sentences(F.col("text"))
    top = lambda s: F.struct(s.alias("s"), F.slice(segments.ranked(F.flatten(F.transform(s, lambda x: segments.kept_tokens(x)))), 1, k).alias("w"))
    d = docs.select("video_id", T.let(s, top).alias("x")).select("video_id", F.col("x.s").alias("s"), F.col("x.w").alias("w"))
    first = lambda w: F.coalesce(F.get(F.filter("s", lambda x: F.contains(F.lower(x), w)), F.lit(0)), F.lit(""))
    concepts = F.transform("w", lambda w: F.struct(w.alias("concept"), first(w).alias("explanation")))
    none = lambda k: F.from_json(F.lit("[]"), dict(zip(FIELDS, SCHEMA.split(", "), strict=True))[k].split(" ", 1)[1])
    quotes = F.slice(F.filter("s", lambda x: F.length(x).between(30, 200)), 1, k)
    return d.select("video_id", F.array_join(F.slice("s", 1, 3), " ").alias("summary"), concepts.alias("key_concepts"), quotes.alias("key_quotes"), none("sanskrit_terms").alias("sanskrit_terms"), F.array(*map(F.lit, QUESTIONS)).alias("study_questions"), F.slice("w", 1, 3).alias("follow_up_topics"))
