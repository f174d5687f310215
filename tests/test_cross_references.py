"""Cross-references against brute force, with entities that many videos share."""

import itertools
import random

from parlance.operators import graph


def test_common_entities_lead_to_pairs(spark):
    """Entities a and b are in more than 100 videos; some videos have nothing else."""
    rng = random.Random(7)
    sets = {f"v{i:03d}": {"a", "b", *rng.sample("cdefghijklmnop", rng.choice((0, 0, 1, 2, 5)))} for i in range(140)} | {"x0": {"a"}, "x1": {"a", "c"}, "x2": set("cdefg"), "x3": set("cdefh")}
    want = {}
    for s, t in itertools.combinations(sorted(sets), 2):
        n = len(sets[s] & sets[t])
        alike = round(n / len(sets[s] | sets[t]), 6)
        if n >= 2 and alike >= 0.3:
            want[s, t] = (n, alike)
    df = spark.createDataFrame([(v, e) for v, es in sets.items() for e in es], "video_id string, entity_id string")
    rows = graph.cross_references(df).collect()
    assert len(rows) == len(want)
    assert {(r.source_video, r.target_video): (r.shared, r.similarity) for r in rows} == want
