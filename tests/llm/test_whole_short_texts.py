"""Shingles of tables of a single short text."""

import pytest

from parlance.llm import neardup

WORDS = "one two three four five six"


@pytest.mark.parametrize("n", range(7))
def test_one_text_of_few_words(n):
    """Fewer than five words are one shingle, none is none."""
    ((i, rows, h, r, count, keys),) = neardup.shingled([" ".join(WORDS.split()[:n])])
    want = 0 if n == 0 else max(1, n - 4)
    assert (i, rows, len(h), list(r), list(count)) == (0, 1, want, [0] * want, [1] * want)
    assert (keys[0, 0] != 0) == (n > 0)


def test_table_of_one_three_word_text(spark):
    df = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    assert [(r.doc_id, r.class_id) for r in neardup.near_duplicates(df).collect()] == [(1, 1)]
    assert neardup.dedup(df).count() == 1
