"""Near and substring dedup against brute force, and their defined results on odd input."""

import collections
import itertools
import random
import re

import numpy as np
import pytest

from parlance.llm import neardup, substring
from tests.llm.conftest import ODD, frame

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return collections.Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])


def brute_classes(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        m, n = x.total(), y.total()
        if x and y and min(m, n) * 5 >= 4 * max(m, n) and 100 * (x & y).total() >= 80 * (x | y).total():
            p, q = sorted((top(a), top(b)))
            up[q] = p
    return {i: top(i) for i in sets}


def edited(words, rng, share):
    return [w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in words]


@pytest.fixture(scope="module")
def planted():
    """Groups of near copies from loose to tight, and texts that share a long passage but are otherwise different."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for share in (0.0, 0.005, 0.01, 0.02, 0.04):
        base = [word() for _ in range(200)]
        rows += [" ".join(edited(base, rng, share)) for _ in range(12)]
    passage = [word() for _ in range(150)]
    rows += [" ".join([*(word() for _ in range(40)), *passage, *(word() for _ in range(20))]) for _ in range(30)]
    return list(enumerate(rows))


@pytest.mark.parametrize("small", [48, 1])
def test_classes_equal_brute_force(spark, planted, small):
    """small=1 sends every bucket through the comparison in blocks."""
    df = spark.createDataFrame(planted, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df, small=small).collect()}
    assert got == brute_classes(planted)
    assert len(set(got.values())) < len(got)


def test_weights_decide(spark):
    """Texts of the same shingles, one of which repeats a part many times, are not alike; links are counted."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join(base + base[:30] * 4)), (3, " ".join([*base, "end"])), (4, " ".join(base + base[:30] * 4 + ["end"])), (5, " ".join([*base, "end"]))]
    got = {r.doc_id: (r.class_id, r.links) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (1, 1), 4: (2, 1), 5: (1, 1)}
    plain = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), counted=False).collect()}
    assert set(plain.values()) == {1}


def test_classes_on_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert got == brute_classes(rows)


def test_blocks_find_all_pairs(spark):
    """apart() alone: pairs of other labels with equal signatures come out whatever the block size."""
    rows = [(1, i, i, i > 0) for i in range(7)]
    cast = "cast({} as decimal(38,0))"
    members = spark.createDataFrame(rows, "bh long, n int, l int, out boolean").selectExpr("bh", cast.format("n") + " node", cast.format("l") + " label", "out")
    sets = spark.createDataFrame([(i, [i // 2], bytes([i // 2]) * neardup.FINE) for i in range(7)], "n int, sh array<int>, sig binary").selectExpr(cast.format("n") + " node", "sh", "sig")
    for block in (2, 100):
        got = {(int(r.a), int(r.b)) for r in neardup.apart(members, sets, 80, block).collect()}
        assert got == {(0, 1), (2, 3), (4, 5)}
    assert {(int(r.a), int(r.b)) for r in neardup.apart_small(members, sets, 80).collect()} == {(0, 1), (2, 3), (4, 5)}


def test_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(1)
    elems = rng.integers(0, 2**63, 300, dtype=np.uint64)
    wa, wb = rng.random(300) * 3 + 0.1, rng.random(300) * 3 + 0.1
    k = 1000
    sig = neardup.darts(np.concatenate([elems, elems]), np.concatenate([wa, wb]), np.repeat([0, 1], 300), 2, k)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / k)


def test_near_dedup_odd(spark):
    df = frame(spark, ODD)
    c = neardup.near_duplicates(df).collect()
    assert len(c) == 6
    assert {r.class_id for r in c if r.doc_id in (None, 4)} == {None}
    out = neardup.dedup(df)
    assert out.columns == df.columns
    assert collections.Counter(r.doc_id for r in out.collect()) == {1: 1, 2: 1, None: 1, 3: 1, 5: 1}
    assert neardup.dedup(df.limit(0)).count() == 0 == neardup.near_duplicates(df.limit(0)).count()


def tokens(text):
    return [(m.group(), m.start()) for m in re.finditer(r"[^\t-\r ]+", text or "")]


def covered(rows, k):
    """For each document, which words lie in a run of k words that an earlier place has too."""
    first, out = {}, {}
    for i, text in sorted(rows):
        low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w, _ in tokens(text)]
        out[i] = m = [False] * len(low)
        for p in range(len(low) - k + 1):
            j, q = first.setdefault(tuple(low[p : p + k]), (i, p))
            if (j, q) != (i, p) and (j != i or p - q >= k):
                m[p : p + k] = [True] * k
    return out


def test_passages_equal_brute_force(docs):
    """All words of passages of 50 words go; and what goes lies in runs of at least 26 words that an earlier place has."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    must, may = covered(rows, 50), covered(rows, 26)
    seen = 0
    for r in substring.substring_dedup(docs).collect():
        text = dict(rows)[r.doc_id]
        gone = {i for i, (_, at) in enumerate(tokens(text)) if any(s.start <= at < s.end for s in r.spans)}
        assert {i for i, x in enumerate(must[r.doc_id]) if x} <= gone
        lone = [i for i in gone if not may[r.doc_id][i]]
        assert len(lone) <= 48 * len(r.spans)
        left = list(text)
        for s in reversed(r.spans):
            del left[s.start : s.end]
        assert "".join(left) == r.text and len(gone) == r.n_removed
        seen += len(r.spans)
    assert seen


def units_of(text, least):
    """Words [a, b) of lines and paragraphs, by splitting."""
    out, low = set(), [w for w, _ in tokens(text)]
    for mark in (r"\n", r"\n[\t-\r ]*\n"):
        at = 0
        for part in re.split(mark, text or ""):
            n = len(tokens(part))
            if n >= least:
                out.add((at, at + n, tuple(low[at : at + n])))
            at += n
    return out


def test_lines_and_paragraphs_equal_brute_force(spark, docs):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    some = [" ".join(word() for _ in range(rng.randrange(3, 9))) for _ in range(30)]
    rows = [(i, "".join(rng.choice(some) + rng.choice(["\n", "\n", " ", "\n\n", "\n \n", "\r\n"]) for _ in range(rng.randrange(12)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "\n\n"), (303, "one " * 50 + "\n" + "ONE  " * 50)]
    for table, least in ((rows, 6), ([(r.doc_id, r.text) for r in docs.collect()], 20)):
        places = collections.defaultdict(list)
        for i, t in table:
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
            for a, b, key in units_of(low, least):
                places[key].append((i, a, b))
        want = {x for p in places.values() for x in sorted(p)[1:]}
        got = [(r.d, r.a, r.b) for r in substring.repeated_lines(spark.createDataFrame(table, "doc_id long, text string"), least).collect()]
        assert set(got) == want and len(got) == len(want) > 5


def test_passage_spliced_into_lines(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("klmnopqrst") for _ in range(6))
    passage = [word() for _ in range(51)]
    rows = [(i, " ".join([word() for _ in range(30)]) + " " + " ".join(passage) + " " + " ".join(word() for _ in range(30))) for i in range(40)]
    out = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert {r.doc_id: r.n_removed for r in out} == {i: 51 if i else 0 for i in range(40)}
    assert all(" ".join(passage) not in r.text for r in out if r.doc_id)


def test_substring_odd(spark):
    df = frame(spark, ODD)
    out = substring.substring_dedup(df).collect()
    assert collections.Counter((r.doc_id, r.text) for r in out if r.doc_id != 3) == collections.Counter((r[0], r[1]) for r in ODD if r[0] != 3)
    (long,) = [r for r in out if r.doc_id == 3]
    assert long.n_removed > 8900 and long.text.startswith("été " * 26)
    assert substring.substring_dedup(df.limit(0)).count() == 0
