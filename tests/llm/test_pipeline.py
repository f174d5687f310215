"""The corpus pipeline: each stage on what the one before kept, odd input, and the whole against the stages one by one."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parlance.llm import langid, neardup, quality
from tests.llm.conftest import ODD, frame
from tests.llm.test_dedup import brute_classes, covered


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Clean texts of two languages, copies, a passage that many share, junk, and a text without letters."""
    rng = random.Random(11)
    vocabulary = {"aa": ["".join(rng.choice("aeiklmn") for _ in range(6)) for _ in range(4000)], "bb": ["".join(rng.choice("oustrzw") for _ in range(6)) for _ in range(4000)]}
    say = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    passage, rows = say("aa", 60), []
    for i in range(240):
        lang = "ab"[i % 2] * 2
        rows.append((i, say(lang, 90), lang, "s"))
    rows += [(300 + i, rows[i][1] + " end", rows[i][2], "s") for i in range(20)]
    rows += [(400 + i, say("aa", 40) + " " + passage + " " + say("aa", 40), "aa", "s") for i in range(6)]
    rows += [(500 + i, " ".join(f"{w}***" for w in say("aa", 60).split()), "aa", "s") for i in range(5)]
    rows += [(600, "12 34 " * 40, "aa", "s"), (601, None, "aa", "s"), (602, "", None, None), (None, say("bb", 90), "bb", "s")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path_factory.mktemp("pipe"))
    df.coalesce(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_take_effect_in_order(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = langid.fitted(docs)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, table)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    said = {i for i, t in texts.items() if (p := model.predict(t))[0] != "und" and p[1] >= model.least}
    assert set(kept["language_id"]) == said and len(said) > 260 and not said & {600, 601, 602}
    judged = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame([(i, t, "aa" if i is not None and i >= 400 or (i or 0) % 2 == 0 and (i or 0) < 300 else "x", "s") for i, t in kept["language_id"].items()], "doc_id long, text string, lang string, source string")).collect()}
    assert not any(500 <= (i or 0) < 505 for i in kept["quality_rules"]) and set(kept["quality_rules"]) <= {i for i in judged}
    groups = brute_classes([(-1 if i is None else i, t) for i, t in kept["quality_rules"].items()])
    assert {-1 if i is None else i for i in kept["near_dedup"]} == {i for i, top in groups.items() if i == top}
    assert set(kept["near_dedup"]) == set(kept["substring_dedup"])
    must = covered([(10**9 if i is None else i, t) for i, t in kept["near_dedup"].items()], 50)
    for i, t in kept["near_dedup"].items():
        assert len(kept["substring_dedup"][i].split()) == len(t.split()) - sum(must[10**9 if i is None else i])
    pieces = corpus_pipeline.run(spark, table).collect()
    again = corpus_pipeline.pack(spark, docs, table).collect()
    ids = lambda rows: collections.Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    assert ids(pieces) == ids(again) and sum(r.length for r in pieces) == sum(r.length for r in again)


@pytest.mark.parametrize("empty", [False, True])
def test_odd_tables(spark, tmp_path, empty):
    df = frame(spark, ODD).withColumn("kept", F.lit("k")).withColumn("lang_pred", F.lit(1)).withColumn("class_id", F.lit(2)).withColumn("length", F.lit(3)).withColumn("d", F.lit(4)).withColumn("row", F.lit(5))
    (df.limit(0) if empty else df).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names
        assert out.count() <= docs.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert neardup.dedup(docs.limit(0)).count() == 0
