"""Language features of runs of letters of any length."""

import zlib

import numpy as np

from parlance.llm import langid

BUCKETS = 512
RUN = "".join(chr(0x4E00 + i * i % 3001) for i in range(10_000))


def grams(word):
    w = f"<{word}>"
    return [zlib.crc32(w[i : i + n].encode()) % BUCKETS for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)]


def test_scores_read_whole_runs():
    table = np.random.default_rng(1).random((BUCKETS, 3)).astype(np.float32)
    for text in (RUN, RUN[:41], RUN[:40], f"some words {RUN[:5000]} and {RUN[100:300]} others", "one two two"):
        m = langid.Model(["a", "b", "c"], table)
        f = [x for w in text.split() for x in grams(w)]
        assert np.allclose(m.scores(text), table[f].mean(0, dtype=np.float64), rtol=1e-5)
        assert all(len(w) <= 40 for w in m.known)


def test_training_reads_whole_runs(spark):
    """No id is held out for certain, so several rows of one text are given."""
    df = spark.createDataFrame([(i, f"{RUN} {RUN[:60]}", "zh") for i in range(10)], "doc_id long, text string, lang string")
    got = langid.sample(df, buckets=BUCKETS).collect()
    want = np.bincount(grams(RUN) + grams(RUN[:60]), minlength=BUCKETS)
    assert got
    for r in got:
        assert r.idx == np.flatnonzero(want).tolist()
        assert np.allclose(r.wt, want[want > 0] / want.sum())
