"""Entities, relationships and cross-references as DataFrames."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance import lexicons as lex
from parlance.functions import text as T
from parlance.operators.hooks import with_model
from parlance.sources.scratch import kept

REFERENCE = "ref_id string, source_video string, target_video string, shared long, similarity double, ref_type string"
SPACES = re.compile(r"\s")
NAME = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"


def entities(docs: DataFrame, name: str = NAME, longer: int = 5, scriptures: list[str] | None = None, common: list[str] | None = None, *, ordered: bool = False) -> DataFrame:
    """video_id, entity_id, name, entity_type, frequency: capitalised names, scriptures and Devanagari terms of each text. ordered: with ord, where each was found first."""
    t = F.coalesce(F.col("text"), F.lit(""))
    found = lambda p: F.regexp_extract_all(t, F.lit(p), 1)
    kinds = [(found(name), "concept"), *((found("(?i)" + p), "text") for p in scriptures or lex.SCRIPTURES), (F.array_distinct(found("([ऀ-ॿ]{3,})")), "term")]
    typed = lambda c, k: F.transform(c, lambda x: F.struct(x.alias("name"), F.lit(k).alias("entity_type")))
    all_ = F.concat(*(typed(c, k) for c, k in kinds))
    e = T.rows_of(docs, all_, "ord", "e").select("video_id", "ord", "e.*")
    plain = (F.length("name") > longer) & ~F.substring_index("name", " ", 1).isin(common or lex.COMMON_FIRST_WORDS)
    e = e.filter((F.col("entity_type") != "concept") | plain).withColumn("entity_id", T.entity_id(F.col("name"), F.col("entity_type")))
    g = e.groupBy("video_id", "entity_id").agg(F.min(F.struct("ord", "name", "entity_type")).alias("f"), F.count("*").alias("frequency"))
    return g.select("video_id", "entity_id", "f.name", "f.entity_type", "frequency", *(["f.ord"] if ordered else []))


def recognised(docs: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame] | None = None, longest: int = 100_000) -> DataFrame:
    """video_id, entity_id, name, entity_type, frequency: names that an outside model finds in the first `longest` characters of each text.

    model: from batches of video_id, text to rows of video_id, name, label; labels without a type here and names of under
    three characters are left out. Without a model there are none.
    """
    none = lambda batch: batch.iloc[:0][["video_id"]].assign(name="", label="")
    got = with_model(docs.select("video_id", F.substring(F.coalesce("text", F.lit("")), 1, longest).alias("text")), "video_id string, name string, label string", model, none)
    kind = F.coalesce(*(F.when(F.col("label") == k, F.lit(v)) for k, v in lex.NER_TYPES.items()))
    e = got.select("video_id", T.strip(F.col("name")).alias("name"), kind.alias("entity_type")).filter((F.length("name") >= 3) & F.col("entity_type").isNotNull())
    e = e.withColumn("entity_id", T.entity_id(F.col("name"), F.col("entity_type")))
    return e.groupBy("video_id", "entity_id").agg(F.min("name").alias("name"), F.min("entity_type").alias("entity_type"), F.count("*").alias("frequency"))


def united(*parts: DataFrame) -> DataFrame:
    """video_id, entity_id, name, entity_type, frequency, description, ord: what several extractors found, the earlier ones first.

    Frequencies add up; the name and type come from the first that found it, the description from the first longest. Each
    part has video_id, entity_id, name, entity_type, frequency, and may have description and ord.
    """
    one = lambda i, p: p.select("video_id", "entity_id", "name", "entity_type", F.col("frequency").cast("long").alias("frequency"), (F.col("description") if "description" in p.columns else F.lit("")).alias("description"), F.lit(i).alias("src"), (F.col("ord").cast("int") if "ord" in p.columns else F.lit(0)).alias("ord"))
    u = reduce(lambda a, b: a.unionByName(b), (one(i, p) for i, p in enumerate(parts)))
    g = u.groupBy("video_id", "entity_id").agg(F.min(F.struct("src", "ord", "name", "entity_type")).alias("f"), F.sum("frequency").alias("frequency"), _longest())
    return g.select("video_id", "entity_id", "f.name", "f.entity_type", "frequency", "description", (F.shiftleft(F.col("f.src").cast("long"), 32) + F.col("f.ord")).alias("ord"))


def _longest(order: str = "src") -> Column:
    """The longest description of a group; of several the first by `order`."""
    d = F.coalesce("description", F.lit(""))
    return F.min(F.struct((-F.length(d)).alias("n"), F.col(order), d.alias("d")))["d"].alias("description")


def merged(ents: DataFrame) -> DataFrame:
    """entity_id, name, entity_type, frequency, videos: entities over all videos; each (entity, video) counts once, so a second load changes nothing."""
    once = ents.dropDuplicates(["entity_id", "video_id"])
    g = once.groupBy("entity_id").agg(F.min(F.struct("video_id", "name", "entity_type")).alias("f"), F.sum("frequency").alias("frequency"), F.count("*").alias("videos"))
    return g.select("entity_id", "f.name", "f.entity_type", "frequency", "videos")


def cooccurrences(docs: DataFrame, ents: DataFrame) -> DataFrame:
    """source_id, target_id, weight: in how many sentences two entities of a video stand together. A name counts wherever its characters stand, also within a longer word.

    A sentence's names are found in its own row, so pairs never leave it before they are added up.
    """
    s = docs.select("video_id", F.posexplode(T.sentences(F.col("text"))).alias("idx", "sentence")).withColumn("low", F.lower("sentence"))
    names = ents.groupBy("video_id").agg(F.collect_set(F.struct("entity_id", F.lower("name").alias("name"))).alias("names"))
    j = s.join(names, "video_id").withColumn("hit", F.array_sort(F.array_distinct(F.transform(F.filter("names", lambda n: F.contains(F.col("low"), n["name"])), lambda n: n["entity_id"]))))
    pairs = F.flatten(F.transform("hit", lambda a: F.transform(F.filter("hit", lambda b: b > a), lambda b: F.struct(a.alias("source_id"), b.alias("target_id")))))
    return j.select(F.explode(pairs).alias("p")).groupBy("p.source_id", "p.target_id").agg(F.count("*").alias("weight"))


def relationships(docs: DataFrame, ents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """source_id, target_id, relation_type, weight, context, source_video: entities of a video in one sentence, and concepts that explain a term.

    ents: video_id, entity_id, name, ord, and aliases (array) where there are any; pairs go from the entity found first.
    known: the parsed knowledge of videos; a concept whose explanation holds a term or its transliteration explains it,
    with weight 2. Weights of equal pairs add up; context (200 characters) and video are those of the first.
    """
    # Sentences end at a mark before white space, which goes; short ones count too.
    cut = F.split(F.coalesce("text", F.lit("")), r"[.!?।॥]\s+").alias("s")
    alias = F.col("aliases") if "aliases" in ents.columns else F.array().cast("array<string>")
    all_ = ents.select("video_id", "entity_id", "ord", F.posexplode(F.concat(F.array("name"), F.coalesce(alias, F.array().cast("array<string>")))).alias("k", "name"))
    # Of a video's entities with one name the last is meant, in the place of the first.
    one = all_.withColumn("name", F.lower("name")).groupBy("video_id", "name").agg(F.max(F.struct("ord", "entity_id"))["entity_id"].alias("entity_id"), F.min(F.struct("ord", "k")).alias("at"))
    names = one.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("at", "name", "entity_id"))).alias("names"))
    s = docs.select("video_id", "text").join(names, "video_id").select("video_id", "names", cut)
    j = named_pairs(s.withColumn("low", F.transform("s", lambda x: F.lower(x))))
    r = j.select("source_id", "target_id", F.lit("related_to").alias("relation_type"), F.lit(1.0).alias("weight"), F.struct("video_id", "idx", "context").alias("f"))
    if known is not None:
        r = r.unionByName(_explained(known, ents))
    return merged_relationships(r)


def named_pairs(rows: DataFrame, clip: int = 200) -> DataFrame:
    """video_id, idx, context, source_id, target_id: the pairs of different entities whose names stand in one sentence, in the order of names. rows: video_id, s (sentences), low (the same in lower case), names (structs of name, in lower case, and entity_id).

    Every name is looked for in every sentence, in time that grows with the text: names with white space are found by the
    five characters around its first, others by a search of the whole text each.
    """

    def holding(low: list[str], names: list[str | None]) -> dict[int, set[int]]:
        """The places of the names that stand in a sentence, by sentence."""
        text, starts = "\n".join(low), [0]
        for x in low:
            starts.append(starts[-1] + len(x) + 1)
        found: dict[int, set[int]] = {}
        keys: dict[str, list[tuple[int, int, str]]] = {}
        for k, name in enumerate(names):
            if name is None:
                continue
            space = SPACES.search(name, 2)
            if space and space.start() + 2 < len(name):
                at = space.start()
                keys.setdefault(name[at - 2 : at + 3], []).append((k, at, name))
                continue
            at = text.find(name)
            while at >= 0:
                i = bisect_right(starts, at) - 1
                if i >= len(low):
                    break
                inside = at + len(name) < starts[i + 1]
                if inside:
                    found.setdefault(i, set()).add(k)
                at = text.find(name, starts[i + 1] if inside else at + 1)
        if keys:
            for m in SPACES.finditer(text):
                p = m.start()
                for k, at, name in keys.get(text[p - 2 : p + 3], ()) if p > 1 else ():
                    if p >= at and text.startswith(name, p - at):
                        i = bisect_right(starts, p - at) - 1
                        if p - at + len(name) < starts[i + 1]:
                            found.setdefault(i, set()).add(k)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            out: list[tuple] = []
            columns = (batch.column(c) for c in ("video_id", "s", "low", "names"))
            for v, s, low, names in zip(*columns, strict=True):
                names, said = names.as_py(), s.values
                ids = [x["entity_id"] for x in names]
                for i, hit in sorted(holding(low.as_py(), [x["name"] for x in names]).items()):
                    if len(hit) > 1:
                        h = [ids[k] for k in sorted(hit)]
                        context = said[i].as_py()[:clip]
                        out += [(v.as_py(), i, context, a, b) for n, a in enumerate(h) for b in h[n + 1 :] if b != a]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))], ["video_id", "idx", "context", "source_id", "target_id"])

    return rows.select("video_id", "s", "low", "names").mapInArrow(run, "video_id string, idx int, context string, source_id string, target_id string")


def _explained(known: DataFrame, ents: DataFrame) -> DataFrame:
    """Pairs of a concept and a term of one video that its explanation holds, made in the video's own row."""
    low = lambda x: F.lower(F.coalesce(x, F.lit("")))
    holds = lambda c, t: F.contains(low(c["explanation"]), low(t["term"])) | ((low(t["transliteration"]) != "") & F.contains(low(c["explanation"]), low(t["transliteration"])))
    pair = lambda c, i, t, k: F.struct((i * 10_000 + k).alias("idx"), low(c["concept"]).alias("a"), low(t["term"]).alias("b"), holds(c, t).alias("ok"))
    some = lambda x: F.coalesce(x, F.array().cast(known.schema[x].dataType))
    p = F.flatten(F.transform(some("key_concepts"), lambda c, i: F.filter(F.transform(some("sanskrit_terms"), lambda t, k: pair(c, i, t, k)), lambda x: x["ok"])))
    e = known.select("video_id", F.explode(p).alias("p")).select("video_id", "p.*").filter("a <> '' and b <> ''")
    of = lambda x: ents.groupBy("video_id", F.lower("name").alias(x)).agg(F.max(F.struct("ord", "entity_id", "name")).alias(f"e{x}"))
    j = e.join(of("a"), ["video_id", "a"]).join(of("b"), ["video_id", "b"])
    told = F.concat("ea.name", F.lit(" relates to "), "eb.name")
    return j.select(F.col("ea.entity_id").alias("source_id"), F.col("eb.entity_id").alias("target_id"), F.lit("explains").alias("relation_type"), F.lit(2.0).alias("weight"), F.struct("video_id", "idx", told.alias("context")).alias("f"))


def merged_relationships(rows: DataFrame) -> DataFrame:
    """Weights of equal (source_id, target_id, relation_type) added up; context and source_video of the first. rows: with f (video_id, idx, context)."""
    g = rows.groupBy("source_id", "target_id", "relation_type").agg(F.sum("weight").alias("weight"), F.min("f").alias("f"))
    return g.select("source_id", "target_id", "relation_type", "weight", F.col("f.context").alias("context"), F.col("f.video_id").alias("source_video"))


def entity_nodes(ents: DataFrame) -> DataFrame:
    """entity_id, name, entity_type, frequency, source_videos (sorted), description: entities over all videos; each (entity, video) counts once.

    source_videos of an entity that stands in very many videos is as long as that; merged() gives their number instead.
    """
    e = ents if "description" in ents.columns else ents.withColumn("description", F.lit(""))
    once = e.dropDuplicates(["entity_id", "video_id"])
    g = once.groupBy("entity_id").agg(F.min(F.struct("video_id", "name", "entity_type")).alias("f"), F.sum("frequency").alias("frequency"), F.array_sort(F.collect_list("video_id")).alias("source_videos"), _longest("video_id"))
    return g.select("entity_id", "f.name", "f.entity_type", "frequency", "source_videos", "description")


@dataclass
class Graph:
    """mentions: video_id, entity_id, name, entity_type, frequency, description; relations: as relationships(), a row for each video's; references: as cross_references()."""

    mentions: DataFrame
    relations: DataFrame
    references: DataFrame


def build_graph(mentions: DataFrame, relations: DataFrame, references: DataFrame | None = None, existing: Graph | None = None) -> Graph:
    """A graph of what is new, or `existing` with it: an (entity, video) or reference known already isn't added again; relations' weights add up."""
    m = mentions if "description" in mentions.columns else mentions.withColumn("description", F.lit(""))
    m = m.select("video_id", "entity_id", "name", "entity_type", "frequency", "description")
    r = references if references is not None else mentions.sparkSession.createDataFrame([], REFERENCE)
    if existing is not None:
        m = existing.mentions.unionByName(m.join(existing.mentions, ["entity_id", "video_id"], "left_anti").select(*m.columns))
        both = existing.relations.withColumn("k", F.lit(0)).unionByName(relations.withColumn("k", F.lit(1)))
        relations = merged_relationships(both.withColumn("f", F.struct(F.col("k").alias("o"), F.col("source_video").alias("video_id"), "context")))
        r = existing.references.unionByName(r.join(existing.references, "ref_id", "left_anti").select(*existing.references.columns))
    return Graph(m, relations, r)


def named_degrees(edges: DataFrame, ents: DataFrame, k: int = 10) -> DataFrame:
    """name, entity_type, connections: the k nodes of most edges."""
    names = ents.groupBy("entity_id").agg(F.min(F.struct("video_id", "name", "entity_type")).alias("f"))
    j = degrees(edges, k).join(names, F.col("node") == F.col("entity_id"))
    return j.select("entity_id", "f.name", "f.entity_type", F.col("degree").alias("connections"))


def matching(mentions: DataFrame, name: str | None = None, kind: str | None = None, video_id: str | None = None) -> DataFrame:
    """entity_id, name, entity_type of entities whose name (or one of whose aliases) holds `name`, of that type, in that video."""
    m = mentions
    if name:
        hit = F.contains(F.lower("name"), F.lit(name.lower()))
        if "aliases" in m.columns:
            hit = hit | F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(name.lower())))
        m = m.filter(F.coalesce(hit, F.lit(False)))
    if kind:
        m = m.filter(F.col("entity_type") == kind)
    if video_id:
        m = m.filter(F.col("video_id") == video_id)
    return m.groupBy("entity_id").agg(F.min(F.struct("video_id", "name", "entity_type")).alias("f")).select("entity_id", "f.name", "f.entity_type")


def query(g: Graph, name: str | None = None, kind: str | None = None, video_id: str | None = None, depth: int = 2, most: int = 50, most_references: int = 20) -> dict[str, DataFrame]:
    """entities that match; nodes within `depth` edges of them; relationships they have on the way, the heaviest `most`; references of their videos, the most alike."""
    hit = matching(g.mentions, name, kind, video_id)
    near = reach(g.relations, hit.select(F.col("entity_id").alias("node")), depth)
    inner = near.filter(F.col("depth") < depth).select("node")
    touched = lambda c: g.relations.join(inner, F.col(c) == F.col("node"), "left_semi")
    rel = touched("source_id").unionByName(touched("target_id")).distinct().orderBy(F.desc("weight"), "source_id", "target_id", "relation_type").limit(most)
    videos = g.mentions.join(hit, "entity_id", "left_semi").select("video_id").distinct()
    side = lambda c: g.references.join(videos, F.col(c) == F.col("video_id"), "left_semi")
    refs = side("source_video").unionByName(side("target_video")).dropDuplicates(["ref_id"]).orderBy(F.desc("similarity"), "ref_id").limit(most_references)
    return {"entities": hit, "nodes": near.filter("depth > 0"), "relationships": rel, "cross_references": refs}


def degrees(edges: DataFrame, k: int = 10) -> DataFrame:
    """node, degree: the k nodes of most edges."""
    n = edges.select(F.col("source_id").alias("node")).union(edges.select(F.col("target_id")))
    return n.groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(k)


def _alike(ents: DataFrame, least: int, alike: float) -> tuple[DataFrame, DataFrame]:
    """Classes of videos with equal entities, and the pairs of classes that are alike: members (k, video_id), pairs (k1, k2, shared, similarity), each pair once and each class with itself.

    With n the size of the smaller set, two sets that are alike share at least m = max(least, 2 alike / (1 + alike) x n)
    entities, and at least max(least, alike x n) for the size n of the larger. So, rarest first, they meet within the
    first n - m + 1 of each: however common an entity is, no pair is lost, and common ones lead to pairs only where a set
    has little else. Behind the place where they first meet enough must be left.
    """
    e = ents.select("video_id", "entity_id").filter("video_id is not null and entity_id is not null")
    own = kept(e.groupBy("video_id").agg(F.collect_set("entity_id").alias("ids")).filter(F.size("ids") >= least))
    # Any one order of entities does. The most frequent come last; the rest, whose order matters little, by their ids.
    often = own.select(F.explode("ids").alias("entity_id")).groupBy("entity_id").agg(F.count("*").alias("v")).filter("v > 1").orderBy(F.desc("v"), "entity_id").limit(50_000)
    v = own.select("video_id", F.explode("ids").alias("entity_id")).join(F.broadcast(often), "entity_id", "left")
    videos = v.groupBy("video_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("v", F.lit(0)).alias("v"), "entity_id"))), lambda x: x["entity_id"]).alias("ids"))
    videos = kept(videos.withColumn("k", F.min("video_id").over(Window.partitionBy("ids"))))
    members = videos.select("k", "video_id")
    sets = videos.filter("k = video_id").select("k", "ids", F.size("ids").alias("n"))
    # Similarities are rounded to six places before they are compared.
    low = alike - 1e-6
    must = lambda share, n: F.greatest(F.lit(least), F.ceil(n * share - 1e-9).cast("int"))
    first = lambda x, share: sets.select(F.col("k").alias(f"k{x}"), F.col("n").alias(f"n{x}"), F.posexplode(F.slice("ids", F.lit(1), F.col("n") - must(share, F.col("n")) + 1)).alias(f"p{x}", "entity_id"))
    of = lambda df, x: df.select(*(F.col(c).alias(f"{c}{x}") for c in df.columns))
    left = F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2"))
    near = (F.struct("n1", "k1") < F.struct("n2", "k2")) & (F.col("n1") >= F.col("n2") * low) & (left >= must(low / (1 + low), F.col("n1") + F.col("n2")))
    pairs = first(1, 2 * low / (1 + low)).join(first(2, low), "entity_id").filter(near).select("k1", "k2").distinct()
    c = pairs.join(of(sets, 1), "k1").join(of(sets, 2), "k2").withColumn("shared", F.size(F.array_intersect("ids1", "ids2")).cast("long"))
    c = c.select("k1", "k2", "n1", "n2", "shared").union(sets.select("k", "k", "n", "n", F.col("n").cast("long")))
    c = c.withColumn("similarity", F.round(F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared")), 6)).filter((F.col("shared") >= least) & (F.col("similarity") >= alike))
    return members, c.drop("n1", "n2")


def _kind() -> Column:
    return F.when(F.col("similarity") > 0.7, "concept_continuation").when(F.col("shared") > 5, "topic_overlap").otherwise("entity_shared")


def cross_references(ents: DataFrame, least: int = 2, alike: float = 0.3) -> DataFrame:
    """ref_id, source_video, target_video, shared, similarity, ref_type: videos that share entities, by Jaccard similarity.

    Videos of equal entities are handled once, until the last join.
    """
    members, c = _alike(ents, least, alike)
    of = lambda df, x: df.select(*(F.col(c).alias(f"{c}{x}") for c in df.columns))
    c = c.join(of(members, 1), "k1").join(of(members, 2), "k2").filter("k1 != k2 or video_id1 < video_id2")
    c = c.withColumn("source_video", F.least("video_id1", "video_id2")).withColumn("target_video", F.greatest("video_id1", "video_id2"))
    return c.select(T.pair_id(F.col("source_video"), F.col("target_video")).alias("ref_id"), "source_video", "target_video", "shared", "similarity", _kind().alias("ref_type"))


def best_references(ents: DataFrame, most: int = 10, least: int = 2, alike: float = 0.3) -> DataFrame:
    """video_id, other, shared, similarity, ref_type: of cross_references(), seen from each of a pair's videos, the `most` most alike; ties to the smaller other.

    The most alike of a video are among the first most + 1 members of the most + 1 classes most alike to its own (by
    similarity, then by their first member): pairs of copies are never made, however many copies there are.
    """
    members, c = _alike(ents, least, alike)
    n = most + 1
    both = c.select(F.col("k1").alias("k"), F.col("k2").alias("l"), "shared", "similarity").union(c.filter("k1 != k2").select("k2", "k1", "shared", "similarity"))
    best = both.withColumn("_n", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("similarity"), "l"))).filter(F.col("_n") <= n).drop("_n")
    heads = members.withColumn("_n", F.row_number().over(Window.partitionBy("k").orderBy("video_id"))).filter(F.col("_n") <= n)
    shown = best.join(heads.select(F.col("k").alias("l"), F.col("video_id").alias("other")), "l")
    shown = shown.withColumn("_n", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("similarity"), "other"))).filter(F.col("_n") <= n)
    lists = shown.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("_n", "other", "shared", "similarity"))).alias("x"))
    own = members.join(lists, "k").select("video_id", F.slice(F.filter("x", lambda x: x["other"] != F.col("video_id")), 1, most).alias("x"))
    return own.select("video_id", F.explode("x").alias("x")).select("video_id", "x.other", "x.shared", "x.similarity").withColumn("ref_type", _kind())


def reach(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """node, depth: nodes within `depth` edges of the start nodes, over edges in either direction."""
    both = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    both = both.union(both.select("b", "a")).distinct()
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        front = both.join(front, F.col("a") == F.col("node"), "left_semi").select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.union(front)
    return seen


def statistics(ents: DataFrame, edges: DataFrame, references: DataFrame) -> DataFrame:
    """One row: totals of entities (by type), relationships, cross-references and videos, and entities a video."""
    e = ents.agg(F.count_distinct("entity_id").alias("entities"), F.count_distinct("video_id").alias("videos"))
    for kind in ("concept", "term", "text"):
        e = e.crossJoin(ents.filter(F.col("entity_type") == kind).agg(F.count_distinct("entity_id").alias(f"{kind}s")))  # one row each
    e = e.crossJoin(edges.agg(F.count("*").alias("relationships"))).crossJoin(references.agg(F.count("*").alias("cross_references")))
    return e.withColumn("entities_per_video", F.round(F.col("entities") / F.greatest("videos", F.lit(1)), 6))
