"""Language ID and quality rules: held-out accuracy, clean rows kept, and defined results on odd input."""

import collections

from pyspark.sql import functions as F

from parlance.llm import langid, quality, substring
from tests.llm.conftest import ODD, frame


def test_held_out_accuracy(spark, docs):
    model = langid.fitted(docs)
    out = langid.identify(docs.select("doc_id", "text", "lang"), model).withColumn("held", langid.held_out(F.col("doc_id")))
    rows = out.filter("held").collect()
    assert len(rows) > 20
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.97
    assert all(0 <= r.score <= 1 and r.lang_pred in model.langs for r in rows)
    assert sum(r.rejected for r in rows) <= 0.02 * len(rows)


def test_no_letter_is_und(spark, docs):
    model = langid.fitted(docs)
    assert model.predict("12 34 !!! ½") == ("und", 0.0) == model.predict(None) == model.predict("")
    out = langid.identify(frame(spark, ODD), model)
    assert {r.doc_id: (r.lang_pred, r.rejected) for r in out.collect() if r.doc_id in (1, 2, 5)} == {1: ("und", True), 2: ("und", True), 5: ("und", True)}
    assert langid.fitted(frame(spark, ODD).limit(0)).predict("some words") == ("und", 0.0)
    assert langid.identify(frame(spark, ODD).limit(0), model).count() == 0


def test_languages_of_most_rows_are_learned(spark):
    rows = [(i, f"some words {i} of it", ("aa", "bb", "cc")[i % 3 if i < 200 else i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(df, rows=2)
    assert "strategy=broadcast" in got._jdf.queryExecution().analyzed().toString()  # texts stay where they are
    assert {r.lang for r in langid.sample(df, rows=300).collect()} == {"aa", "bb", "cc"} and {r.lang for r in got.collect()} <= {"aa", "bb"}


def brute(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.defaultdict(list)
    for i in range(len(w) - 7):
        grams[tuple(w[i : i + 8])].append(i)
    again = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_counts_equal_brute_force(spark, docs):
    extra = ["a b c d e f g h " * 3, "x\ny\nx\n\n \n", "Ünï|cödé\t<b>\x0bq", "same line\r\nsame line\r\n", " "]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    for r in quality.measured(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)


def test_buckets_hold_their_values(spark):
    v = spark.range(0, 5000, 7).union(spark.range(10**6, 10**6 + 50)).select("id", quality.bucket(F.col("id")).alias("b")).select("id", quality.lowest(F.col("b")).alias("lo"))
    assert all(r.lo <= r.id < r.lo * 1.04 + 1 for r in v.collect())


def test_rules_keep_clean_and_drop_junk(spark):
    clean = " ".join(f"word{i % 37} other{i % 41}" for i in range(60))
    rows = [(i, f"{clean} tail{i}", "en", f"s{i % 2}") for i in range(300)]
    rows += [(1000 + i, " ".join(f"w{i}x{j}***" for j in range(60)), "en", "s0") for i in range(20)]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(20))


def test_limits_follow_the_groups(spark):
    """Limits come from the rows alone: they scale with a group's distribution, and a third of junk doesn't move them."""
    assert all(len(x) == 3 and not any(type(v) in (int, float) for v in x) for x in quality.RULES.values())
    told = dict.fromkeys(quality.COUNTS, 0) | {"n_words": 100, "word_chars": 500, "n_lines": 5}
    make = lambda lang, source, **x: {"lang": lang, "source": source} | told | x
    rows = [make("en", "a", n_symbols=i % 7) for i in range(700)] + [make("en", "b", n_symbols=50 + 5 * (i % 7)) for i in range(700)]
    rows += [make("en", "c", n_symbols=i % 7 if i % 3 else 90) for i in range(900)] + [make("de", "a", n_symbols=0 if i % 25 else 80) for i in range(500)]
    rows += [make("en", "few", n_symbols=99) for _ in range(5)]
    names = ["lang", "source", *quality.COUNTS]
    df = spark.createDataFrame([[r[k] for k in names] for r in rows], "lang string, source string, " + ", ".join(f"{c} long" for c in quality.COUNTS))
    lim = {(r.g_lang, r.g_source): r for r in quality.limits(quality.sketches(df)).collect()}
    hi = {k: r.hi_symbol_rate for k, r in lim.items()}
    assert hi["en", "a"] < hi["en", "c"] < 900 and hi["en", "a"] < 500 < hi["en", "b"] and hi["de", "a"] == 0
    assert hi["en", "few"] not in (hi["en", "a"], hi["en", "b"])
    kept = collections.Counter((r.lang, r.source, r.n_symbols) for r in quality.judged(df, quality.limits(quality.sketches(df))).filter("not kept").collect())
    assert set(kept) == {("en", "c", 90), ("de", "a", 80), ("en", "few", 99)}
    assert quality.limits(quality.sketches(df), spread=1).filter("hi_symbol_rate < 100").count() > 0


def test_stages_keep_columns_of_any_name(spark):
    odd = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, lang_pred string, rejected boolean, c0 string, kept string, base_failed int, hi_symbol_rate int, spans string, n_removed int, `a.b` int, _spans int"
    text = " ".join(f"word{i % 37} other{i % 41}" for i in range(60))
    rows = [(i, f"{text} {i}", "en", "s", 1, 2, 0.5, "x", True, "c", "k", 1, 2, "s", 3, 4, 5) for i in range(30)]
    df = spark.createDataFrame(rows, odd)
    model = langid.fitted(df)
    for out in (langid.keep(df, model), quality.keep(df)):
        assert out.schema.names == df.schema.names and {tuple(r) for r in out.collect()} <= set(rows)
    assert quality.keep(df).count() == 30
    cut = substring.substring_dedup(df)
    assert cut.columns == [c for c in df.columns if c not in ("spans", "n_removed")] + ["spans", "n_removed"] and cut.count() == 30
    assert {r._spans for r in cut.collect()} == {5}


def test_quality_odd(spark):
    df = frame(spark, ODD)
    out = quality.quality(df).collect()
    assert len(out) == len(ODD) and all(r.base_failed and not r.kept for r in out)
    assert quality.keep(df).columns == df.columns
    assert quality.keep(df.limit(0)).count() == 0 == quality.quality(df.limit(0)).count()
