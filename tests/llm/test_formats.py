"""Packing, sharding, search, archives, licenses and BPE against the libraries or brute force."""

import base64
import collections
import hashlib
import io
import random
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from parlance.llm import bpe, licenses, packing, sharding, topk, warc
from tests.llm.conftest import ODD, frame

WORD = public_tokenizers.path("word_bpe_49k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def check_packing(rows, texts, size=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    t.encode_special_tokens = True
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at and n > 0
            at += n
        assert at <= size
    want = collections.Counter(map(len, ids))
    assert sum(r.length for r in rows) == sum(n * c for n, c in want.items())
    return ids, seqs


def test_packing(spark, docs):
    src = docs.orderBy("doc_id").limit(150).repartition(5)
    texts = {r.doc_id: r.text for r in src.collect()}
    rows = packing.pack(src, WORD, windows=4, fan_in=2).collect()
    ids, seqs = check_packing(rows, list(texts.values()))
    by = dict(zip(texts, ids, strict=True))
    for d, full in by.items():
        at = 0
        for r in sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start):
            raw = np.array(full[r.start : r.start + r.length], "<u4").tobytes()
            assert r.start == at and r.ids_crc32 == zlib.crc32(raw) and r.doc_tokens == len(full)
            at += r.length
        assert at == len(full)
    assert len(seqs) * 2048 < 1.05 * sum(map(len, ids)) + 2048


def test_packing_odd(spark):
    rows = packing.pack(frame(spark, ODD), WORD).collect()
    check_packing(rows, [r[1] for r in ODD])
    assert packing.pack(frame(spark, ODD).limit(0), WORD).count() == 0


def test_word_ids_equal_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    t.encode_special_tokens = True
    rng = random.Random(4)
    texts = ["İstanbul ΣΑΣ don't I'LL", "\x1c\x1d a\x85b\xa0c", "é ́x", "<|endoftext|> a<|endoftext|>b"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF)])) for _ in range(400)) for _ in range(30)]
    texts += ["", "one" * 40_000, "one" * 40_000 + " two"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for table in (packing.TABLE, 2000, 0):
        bpe = packing.WordBPE(WORD, table)
        for _ in range(3):  # from the second time on, words come from both tables
            ids, counts = bpe.encode(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(x.encode()) for x in texts)]))
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
            assert not len(bpe.known.lens) or bpe.known.lens.max() <= packing.LONG


def test_sharding(spark, docs):
    rows = sharding.shard(docs, 7).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    by = collections.defaultdict(list)
    where = collections.defaultdict(set)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes"
        by[r.shard].append(r)
        where[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in by.values())
    sizes = [sum(r.size for r in s) for s in by.values()]
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes) / 7 + max(r.size for r in rows)


def test_shards_equal_brute_force(spark, docs):
    """With every group scheduled for itself, loads are those of the definition."""
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.text or ""] += len((r.text or "").encode()) + 16
    for n in (3, 40):
        loads = [0] * n
        for x in sorted(sizes.values(), reverse=True):
            loads[loads.index(min(loads))] += x
        got = collections.Counter()
        for r in sharding.shard(docs, n, fine=10**9).collect():
            got[r.shard] += r.size
        assert sorted(got.values()) == sorted(x for x in loads if x)
        bundled = collections.Counter()
        for r in sharding.shard(docs, n).collect():
            bundled[r.shard] += r.size
        # No bundle or group of its own is larger than the greater of these, and the last one placed makes the difference.
        assert max(bundled.values()) - min(loads) <= max(max(sizes.values()), sum(sizes.values()) // n)


def test_sharding_odd(spark):
    rows = sharding.shard(frame(spark, ODD), 3).collect()
    assert len(rows) == len(ODD) and len({r.shard for r in rows if r.doc_id in (1, 2)}) == 1
    assert sharding.shard(frame(spark, ODD).limit(0)).count() == 0
    assert sharding.schedule([("a", 5), ("b", 4), ("c", 3), ("d", 3)], 2) == [("a", 0), ("b", 1), ("c", 1), ("d", 0)]


@pytest.mark.parametrize("block", [40, 16_384])
def test_search_equals_brute_force(spark, block):
    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, (230, 6)) / 4
    rows = [(i % 225, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(300, None), (350, [1.0, None, 0.0]), (400, [float("nan")] * 6), (450, [float("inf")] * 6), (500, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = [(i, np.floor(256 * np.pad(np.array(x), (0, 6 - len(x)))).astype(int)) for i, x in rows if x and None not in x and np.isfinite(x).all()]
    want = collections.Counter()
    for a, (i, x) in enumerate(q):
        if i % 50 == 0:
            best = sorted((-int(x @ y), j) for b, (j, y) in enumerate(q) if a != b)[:5]
            want.update((i, k + 1, j, -s) for k, (s, j) in enumerate(best))
    got = collections.Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df, block=block, chunk=3).collect())
    assert got == want
    assert topk.search(df.limit(0)).count() == 0


def test_search_of_large_components(spark):
    """What a long can hold is exact, also where doubles would round; what it can't is an error."""
    rows = [(0, [2.9e6, 1.0]), (50, [2.9e6, 1.00390625]), (1, [2.9e6, -1.0]), (2, [-2.9e6, 5.0])]
    rows = [(i, [x * 4 for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows}
    want = {(q, j): sum(a * b for a, b in zip(v[q], v[j], strict=True)) for q in (0, 50) for j in v if j != q}
    assert max(want.values()) > 2**62
    got = topk.search(df).collect()
    assert {(r.query_id, r.vec_id): r.score for r in got} == want
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == [50, 1, 2]
    for x in (1e30, 1e14):
        with pytest.raises(Exception, match="beyond 64 bits"):
            topk.search(spark.createDataFrame([(0, [x, 1.0]), (1, [x, 2.0])], "vec_id long, embedding array<double>")).collect()


def test_stops_only_on_proof():
    """Rows ruled out early are never among the best, whatever the distribution of impacts."""
    rng = np.random.default_rng(8)
    for V in (rng.integers(-300, 300, (900, 16)), (rng.standard_cauchy((900, 16)) * 20).astype(int), np.zeros((900, 4), int), np.ones((3, 4), int)):
        Q, index = V[::9], topk.Block(V.astype(np.int64))
        for i, found in enumerate(index.search(Q.astype(np.int64), 6, np.full(len(Q), -1), np.full(len(Q), -np.inf))):
            s = V @ Q[i]
            assert set(np.flatnonzero(s >= np.sort(s)[-min(6, len(s))])) <= set(found.tolist())


def pages(spark):
    big = "<p>é" + "x" * 200
    rows = [(5, "http://a/\r\nb", big), (3, None, big), (9, "u", "small"), (4, "u", "small"), (7, "u", None), (None, "u", big), (8, "u", big), (8, "u", big), (10, "u", "")]
    return rows, spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, first string")


def test_archives_round_trip(spark):
    rows, df = pages(spark)
    out = warc.read(warc.write(df.repartition(3))).collect()
    assert len(out) == len(rows)
    for r in out:
        raw = next((h or "").encode() for p, _, h in rows if p == r.page_id)
        assert r.payload_bytes == len(raw) and r.payload_digest == hashlib.sha256(raw).hexdigest()
        again = len(raw) >= 100 and r.page_id in (5, 8)
        assert (r.record_type, r.refers_to) == (("revisit", 3) if again else ("response", None))
        assert r.payload == (None if again else raw)
    assert warc.read(warc.write(df.limit(0))).count() == 0


class Held:
    def __init__(self, raw):
        self.raw = raw

    def read_at(self, n, at):
        return self.raw[at : at + n]


@pytest.mark.parametrize("small", [False, True])
def test_directories(monkeypatch, small):
    """small: limits so low that the writer uses ZIP64 records throughout."""
    if small:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a/é.txt", "first member")
        z.writestr("b.txt", "second member, longer")
        z.comment = b"PK\x05\x06 in a comment"
    f = Held(buf.getvalue())
    got = {m.name: f.read_at(m.size, warc.begin(f, m)) for m in warc.members(f, len(f.raw))}
    assert got == {"a/é.txt": b"first member", "b.txt": b"second member, longer"}
    with pytest.raises(ValueError):
        warc.members(Held(b"no archive"), 10)


def words(t):
    import regex

    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]


def contained(text, template):
    """Share, first and last word of the template's shingles in the text, by the definition."""
    w, x = words(text), words(template)
    n = min(5, len(x))
    g = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
    at = [k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in g]
    return (len({tuple(w[k : k + n]) for k in at}) / len(g), at[0], at[-1] + n - 1) if at else (0, 0, 0)


@pytest.mark.parametrize("listed", [licenses.LISTED, 0])
def test_licenses(spark, docs, listed):
    """listed=0 joins texts' bands with the templates' table."""
    rng = random.Random(6)
    given = licenses.TEMPLATES | {"short": "All rights reserved.", "one": "Copyleft", "long": " ".join(f"t{i}" for i in range(300))}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    grant = given["mit-grant"].split()
    more = ["before " * 30 + " ".join(grant) + " after" * 9, " ".join(grant[:30] + ["other"] + grant[31:]), " ".join(grant[:20]), None, "x", "all rights Reserved", "copyleft", "Rights all reserved."]
    more += [" ".join([*grant[:35], *["meanwhile"] * 500, *grant[35:]]), " ".join(grant * 3)]
    for _ in range(40):  # what is lost leaves runs of few shingles
        x = given[rng.choice(["mit-grant", "long", "gpl-header", "isc"])].split()
        for k in range(rng.randrange(20), len(x), rng.randrange(18, 40)):
            x[k] = "changed"
        more.append(" ".join(["pad"] * rng.randrange(5) + x))
    rows += [(10**6 + i, t) for i, t in enumerate(more)]
    want = {(i, n): c for i, t in rows for n, x in given.items() if (c := contained(t, x))[0] >= 0.8}
    got = licenses.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, h string"), given, listed=listed).collect()
    assert {(r.doc_id, r.license): (r.containment, r.first_word, r.last_word) for r in got} == want and len(got) == len(want) > 20
    assert {n for _, n in want} >= {"short", "one", "long", "mit-grant"}
    assert licenses.scan(frame(spark, ODD), listed=listed).count() == 0 == licenses.scan(docs.limit(0), listed=listed).count()


def test_no_python_on_the_path(spark, docs):
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_bpe_equals_library(docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = bpe.coder(MULTI, public_tokenizers.PATTERN)
    rng = random.Random(9)
    texts = ["", "a" * 3000, " \t\n\x1c\x1dy  z\x85", "ab" * 2000, "\U0001f600é" * 50, "don't I'LL 123456 !!!???"]
    texts += ["".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(500)) for _ in range(20)]
    texts += ["".join(rng.choice(" \tab\x1f\x0b\xa01.") for _ in range(2000)), *(r.text or "" for r in docs.limit(40).collect())]
    for t in texts:
        ids = mine.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(t)
        assert mine.decode(ids) == t.encode()


def test_bpe_odd(spark):
    df = frame(spark, ODD).withColumn("ids", F.lit(1))
    for r in bpe.encode(df, MULTI, public_tokenizers.PATTERN).collect():
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.digests(df.limit(0), MULTI, public_tokenizers.PATTERN).count() == 0
