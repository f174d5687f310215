"""Near dedup of ids that don't tell rows apart."""

import collections

from parlance.llm import neardup
from tests.llm.conftest import frame

ONE = "a long walk along the river took them past the old mill and back again"
TWO = "seven engines stood idle in the yard while nobody could find a single key"
THREE = "bake the bread until its crust turns brown then let it cool for an hour"
FOUR = "every vote was counted twice before any result went up on the board"
ROWS = [(None, ONE), (None, TWO), (7, TWO), (8, ONE + " today"), (9, THREE), (9, FOUR), (9, FOUR), (10, FOUR), (None, ""), (None, "!"), (None, None)]


def test_shared_ids_keep_unrelated_groups(spark):
    """Null ids and a repeated id on unrelated texts: each group keeps one row, and rows without words all stay."""
    df = frame(spark, ROWS, "doc_id long, text string")
    out = collections.Counter((r.doc_id, r.text) for r in neardup.dedup(df).collect())
    assert out == collections.Counter([(None, ONE), (None, TWO), (9, THREE), (9, FOUR), (None, ""), (None, "!"), (None, None)])
    rows = neardup.near_duplicates(df).collect()
    kept = {(r.doc_id, r.class_hash) for r in rows if r.kept}
    assert len(kept) == sum(r.kept for r in rows) == len({r.class_hash for r in rows}) == 7
    assert sorted(r.doc_id for r in rows if not r.kept) == [7, 8, 10]
