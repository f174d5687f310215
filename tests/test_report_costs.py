import time

from pyspark.sql import functions as F

from parlance.operators import graph, segments

DOC = "video_id string, text string"


def test_topics_of_a_long_text_take_linear_time(spark):
    text = " ".join(f"word{i}" for i in range(60_000))
    began = time.time()
    (row,) = segments.topics(spark.createDataFrame([("v", text)], DOC)).filter("topic_id = 19").collect()
    assert time.time() - began < 20 and len(row.keywords) == 10


def test_topics_start_where_boundary_scores_are_low(spark, sf_docs="/root/testdata/sf0.001"):
    d = spark.read.parquet(f"{sf_docs}/documents.parquet").select(F.col("doc_id").cast("string").alias("video_id"), "text")
    for least, below in ((3, 0.2), (2, 0.05)):
        want = segments.boundaries(segments.boundary_scores(d, least), least, below).select("video_id", F.slice("starts", 1, 20).alias("s"))
        got = segments.topics(d, least=least, below=below).groupBy("video_id").agg(F.array_sort(F.collect_list("start_index")).alias("g"))
        assert got.join(want, "video_id", "left").filter("g != coalesce(s, array(0))").count() == 0


def test_best_references_are_the_first_of_all_and_copies_are_not_paired(spark):
    rows = [(f"c{i:04d}", e) for i in range(3000) for e in "abcd"] + [(f"x{i}", e) for i in range(30) for e in "abcdefghijkl"[i % 5 : i % 5 + 2 + i % 7]]
    ents = spark.createDataFrame(rows, "video_id string, entity_id string")
    few = ents.filter("video_id < 'c0040' or video_id > 'd'")
    refs = [(r.source_video, r.target_video, r.similarity) for r in graph.cross_references(few).collect()]
    seen: dict = {}
    for a, b, s in refs:
        seen.setdefault(a, []).append((-s, b))
        seen.setdefault(b, []).append((-s, a))
    got: dict = {}
    for r in graph.best_references(few).collect():
        got.setdefault(r.video_id, []).append((-r.similarity, r.other))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:10] for k, v in seen.items()}
    sets: dict = {}
    for v, e in few.collect():
        sets.setdefault(v, set()).add(e)
    pairs = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) > 1}
    assert {(a, b): s for a, b, s in refs} == {k: s for k, s in pairs.items() if s >= 0.3}
    assert graph.best_references(ents).filter("video_id < 'd'").count() == 30_000


def test_relationships_find_names_within_words_and_only_within_sentences(spark):
    d = spark.createDataFrame([("v", "An Ada Byroness met xgrace hopper and om. Then Ada. Byron and om om")], DOC)
    ents = spark.createDataFrame([("v", "1", "Ada Byron", 0), ("v", "2", "Grace Hopper", 1), ("v", "3", "om", 2), ("v", "4", "b c", 3)], "video_id string, entity_id string, name string, ord int")
    assert {(r.source_id, r.target_id, r.weight) for r in graph.relationships(d, ents).collect()} == {("1", "2", 1.0), ("1", "3", 1.0), ("2", "3", 1.0)}
