"""MinHash near-dedup (operator 8) with DartMinHash signatures.

A text is the weighted set of its five-word shingles (words: lower-case runs of letters and digits; fewer than five words
are one shingle), a shingle's weight how often it comes; similarity is the sum of the lesser weights over that of the
greater. Every element owns a region of weight x rank; darts are thrown into unit cells of it, as many to a cell as a
hash draws from the Poisson distribution of mean 1, and a dart counts if it lies below the element's weight and below a
rank that is chosen so that about k (ln k + 4) darts count in all. Each dart belongs to one of k coordinates by its
hash, and the earliest of each is the signature: two texts agree in a coordinate with the chance that is their weighted
Jaccard similarity. Work is linear in the text plus k ln k, not their product.

Texts of the same words are one node. 25 bands of 5 coordinates deal nodes into buckets: texts of similarity 0.8 share
one with a chance of 0.99995. In each bucket all nodes are compared with a pivot, on all shingles (by 32 bits of their
hashes, which moves a similarity by some millionths), and components follow. Members that the pivot did not reach get a
second pivot; those still apart from others of their bucket are then compared with all of these, in blocks. A signature
of FINE coordinates rules pairs out there, with a chance of one in 10^9 for a pair that is a link. So but for these
stated chances no link is lost, while groups of alike texts never form all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import ALNUM, U64, bytes_of, drop, hold, mix, parts, runs_of, save, ship, slices, word_hashes, words_of

WORDS, BANDS, ROWS = 5, 25, 5
#: Coordinates of the signature by which pairs within a bucket are told apart before the exact check; one byte of each is kept.
FINE = 512
NODE = "decimal(38,0)"
_CDF = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def darts(elems: np.ndarray, weights: np.ndarray, rows: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k signatures of weighted sets: each element's hash, weight above 0 and row. Rows without elements stay 0."""
    out = np.zeros((n, k), np.uint32)
    total = np.bincount(rows, weights, minlength=n)
    limit = np.where(total > 0, k * (math.log(k) + 4) / np.maximum(total, 1e-300), 0.0)
    todo = total > 0
    none = U64(2**64 - 1)
    # Cells along the weight axis: only the last one of an element may be cut.
    cells = np.ceil(weights).astype(np.int64)
    if len(cells) and cells.max() > 1:
        e = np.repeat(elems, cells)
        m = np.arange(len(e)) - np.repeat(np.cumsum(cells) - cells, cells)
        part = np.minimum(1.0, np.repeat(weights, cells) - m)
        base, rows = mix(e + m.astype(U64) * U64(0xA24BAED4963EE407)), np.repeat(rows, cells)
    else:
        base, part = mix(elems.copy()), weights
    while todo.any():
        live = np.flatnonzero(todo[rows])
        high = np.ceil(limit[rows[live]]).astype(np.int64)
        best = np.full(n * k, none)
        for lo in range(0, len(live), 1 << 16):
            at, ranks = live[lo : lo + (1 << 16)], high[lo : lo + (1 << 16)]
            start = 0
            while start < len(at):  # at most some hundred thousand cells at a time
                stop = start + max(1, int(np.searchsorted(np.cumsum(ranks[start:]), 1 << 17)))
                a, r = at[start:stop], ranks[start:stop]
                start = stop
                cell = np.repeat(a, r)
                j = np.arange(len(cell)) - np.repeat(np.cumsum(r) - r, r)
                c = mix(base[cell] + j.astype(U64) * U64(0x9FB21C651E98DF25))
                many = np.searchsorted(_CDF, (c >> U64(11)) * 2.0**-53)
                i = 0
                while len(c):
                    more = many > i
                    c, cell, j, many = c[more], cell[more], j[more], many[more]
                    if not len(c):
                        break
                    i += 1
                    d = mix(c + U64(i * 0xD1342543DE82EF95 & (2**64 - 1)))
                    rank = j + (d >> U64(32)) * 2.0**-32
                    row = rows[cell]
                    ok = (rank < limit[row]) & ((d & U64(0xFFFF)) * 2.0**-16 < part[cell])
                    dart = mix(d[ok])
                    key = row[ok] * k + (dart >> U64(32)).astype(np.int64) % k
                    np.minimum.at(best, key, ((rank[ok] * 2.0**20).astype(U64) << U64(32)) | (dart & U64(0xFFFFFFFF)))
        best = best.reshape(n, k)
        full = todo & (best != none).all(1)
        out[full] = (best[full] & U64(0xFFFFFFFF)).astype(np.uint32)
        todo &= ~full
        limit[todo] *= 2
    return out


def shingled(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the texts: first row, number of rows, distinct shingles' hashes, their rows, their counts, and two 64-bit keys of each row's word sequence (0: no word)."""
    data, offs = bytes_of(pa.array([(t or "").lower().encode() for t in texts], pa.binary()))
    for i, j in slices(offs):
        d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        n = j - i
        starts, ends, rows = words_of(d, o, ALNUM)
        wh = word_hashes(d, starts, ends)
        per = np.bincount(rows, minlength=n)
        begin = np.cumsum(per) - per
        keys = np.zeros((n, 2), U64)
        some = per > 0
        if some.any():
            pos = (np.arange(len(wh)) - begin[rows]).astype(U64)
            for c, mul in ((0, 0x9E3779B97F4A7C15), (1, 0xC2B2AE3D27D4EB4F)):
                keys[some, c] = mix(np.add.reduceat(mix(wh + pos * U64(mul) + U64(c)), begin[some]) + per[some].astype(U64)) | U64(1)
        got, who = [], []
        for size in range(1, WORDS + 1):
            h = runs_of(wh, size)
            at = np.flatnonzero(rows[WORDS - 1 :] == rows[: max(0, len(rows) - WORDS + 1)]) if size == WORDS else begin[per == size]
            got.append(h[at] if h is not None else h)
            who.append(rows[at])
        h, r = np.concatenate(got), np.concatenate(who)
        _, at, count = np.unique(h ^ mix(r.astype(U64) + U64(0x632BE5AB)), return_index=True, return_counts=True)
        order = np.argsort(at, kind="stable")
        at, count = at[order], count[order]
        r, h = r[at], h[at]
        order = np.argsort(r, kind="stable")
        yield i, n, h[order], r[order], count[order], keys


def _nodes(keys: np.ndarray) -> pa.Array:
    """Both keys as one decimal of 126 bits; null where there is no word."""
    raw = np.stack([keys[:, 0], keys[:, 1] >> U64(2)], 1)
    ok = np.packbits(keys[:, 0] != 0, bitorder="little")
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(keys), [pa.py_buffer(ok.tobytes()), pa.py_buffer(np.ascontiguousarray(raw).tobytes())])


def _lists(values: np.ndarray, lens: np.ndarray, kind: pa.DataType) -> pa.Array:
    offs = np.zeros(len(lens) + 1, np.int32)
    np.cumsum(lens, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))


def _keyed(docs: DataFrame) -> DataFrame:
    """d, th, text: a row's id (null: the lowest number) and a hash of its text, which tell rows apart that share an id."""
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("d"), F.xxhash64("text").alias("th"), "text")


def signed(docs: DataFrame, *, counted: bool = True) -> DataFrame:
    """d, th, node, bands of each row. counted: weights are counts, else 1."""
    k = BANDS * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for b in parts(batches):
            for i, n, h, r, count, keys in shingled(b.column(2).to_pylist()):
                sig = darts(h, count.astype(float) if counted else np.ones(len(h)), r, n, k).astype(U64).reshape(n, BANDS, ROWS)
                v = np.zeros((n, BANDS), U64)
                for c in range(ROWS):
                    v = mix(v * U64(0xD6E8FEB86659FD93) + sig[:, :, c] + U64(1))
                v = mix(v + np.arange(BANDS, dtype=U64) * U64(0x9E3779B97F4A7C15))
                cut = b.slice(i, n)
                lens = np.where(keys[:, 0] != 0, BANDS, 0)
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), _nodes(keys), _lists(v[lens > 0].reshape(-1).view(np.int64), lens, pa.int64())], ["d", "th", "node", "bands"])

    return _keyed(docs).mapInArrow(run, f"d long, th long, node {NODE}, bands array<long>")


def occurrences(h: np.ndarray, r: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each occurrence: what two texts share of these is the sum of the lesser counts."""
    if not len(count) or count.max() == 1:
        return h, r
    e = np.repeat(h, count)
    nth = np.arange(len(e)) - np.repeat(np.cumsum(count) - count, count)
    return np.where(nth > 0, mix(e + nth.astype(U64) * U64(0xA24BAED4963EE407)), e), np.repeat(r, count)


def sets_of(rows: DataFrame, *, counted: bool = True) -> DataFrame:
    """node, sh (32-bit hashes of shingles' occurrences, or of shingles if not counted), sig (FINE bytes) of rows with node and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            for i, n, h, r, count, _ in shingled(b.column(1).to_pylist()):
                sig = darts(h, count.astype(float) if counted else np.ones(len(h)), r, n, FINE).astype(np.uint8)
                if counted:
                    h, r = occurrences(h, r, count)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, n), _lists((h >> U64(32)).astype(np.uint32).view(np.int32), np.bincount(r, minlength=n), pa.int32()), pa.array([x.tobytes() for x in sig], pa.binary())],
                    ["node", "sh", "sig"],
                )

    return rows.select("node", "text").mapInArrow(run, f"node {NODE}, sh array<int>, sig binary")


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of each linked node's component. Labels spread over links and jump to their label's label until none changes."""
    both = save(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = save(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        up = labels.select(F.col("node").alias("u"), F.col("label").alias("up"))
        step = labels.join(near, F.col("node") == F.col("a")).join(up, F.col("label") == F.col("u"))
        new = save(step.select("node", F.least("label", "near", "up").alias("label"), (F.least("near", "up") < F.col("label")).alias("moved")), "labels")
        going = new.filter("moved").limit(1).count()
        drop(labels)
        labels = new
        if not going:
            drop(both)
            return labels.select("node", "label")


def agreed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose Jaccard similarity, on all their shingles, is at least `percent`."""
    a, b = (sets.select(F.col("node").alias(x), F.col("sh").alias(f"sh_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b")
    both = both.withColumn("i", F.size(F.array_intersect("sh_a", "sh_b"))).withColumn("n", F.size("sh_a") + F.size("sh_b") - F.col("i"))
    return both.filter(F.col("i") * 100 >= F.col("n") * percent).select("a", "b")


def possible(percent: int) -> int:
    """How many of FINE bytes texts of that similarity share at least, but for a chance of one in 10^9."""
    p = percent / 100
    return int((p - 6 * math.sqrt(p * (1 - p) / FINE)) * FINE)


def _keys(col: pa.Array) -> np.ndarray:
    """A number for each decimal, by which equal ones are known."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    raw = np.frombuffer(col.buffers()[1], np.uint64).reshape(-1, 2)[col.offset : col.offset + len(col)]
    return raw[:, 0] ^ mix(raw[:, 1].copy())


def _bytes(col: pa.Array) -> np.ndarray:
    data, offs = bytes_of(col)
    return data.reshape(len(offs) - 1, FINE)


#: Rows of a broadcast table of key hashes, whatever the input's size; past some millions of keys it rules nothing out any more.
SIEVE = 1 << 18


def sieve(keys: DataFrame) -> DataFrame:
    """The hashes of keys (d, th), SIEVE at most: rows that meet none of them have none of the keys, and needn't be shuffled to find out."""
    return F.broadcast(keys.select(_sifted().alias("bk")).distinct())


def _sifted():
    return F.pmod(F.xxhash64("d", "th"), F.lit(SIEVE))


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def apart_small(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """As apart(), for buckets of few members, each of which is one row here: only pairs that may be similar are made."""
    one = rows.join(sets.select("node", "sig"), "node").groupBy("bh").agg(F.collect_list(F.struct("node", "label", "out", "sig")).alias("m"))
    least = possible(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            m = b.column(0)
            flat, ends = m.flatten(), np.cumsum(m.value_lengths().to_numpy(zero_copy_only=False))
            node, label, out, sig = (flat.field(i) for i in range(4))
            label, out, sig = _keys(label), out.to_numpy(zero_copy_only=False), _bytes(sig)
            x, y, at = [], [], 0
            for end in ends.tolist():
                for q in np.flatnonzero(out[at:end]) + at:
                    hit = np.flatnonzero(((sig[at:end] == sig[q]).sum(1) >= least) & (label[at:end] != label[q])) + at
                    x += hit.tolist()
                    y += [q] * len(hit)
                at = end
            yield pa.RecordBatch.from_arrays([node.take(pa.array(x, pa.int64())), node.take(pa.array(y, pa.int64()))], ["x", "y"])

    return one.select("m").mapInArrow(run, f"x {NODE}, y {NODE}").select(*_ordered("x", "y")).distinct()


def apart(rows: DataFrame, sets: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """Links between different labels in buckets of many members: those outside the pivot's component (`out`) against all, in blocks.

    rows: bh, node, label, out. Signatures rule pairs out, shingle sets decide on the rest within the block, and a pair
    whose labels the block has linked already is passed over: fewer links come out of a block than it has members.
    """
    counts = rows.groupBy("bh").agg(F.ceil(F.count("*") / block).cast("int").alias("gr"), F.ceil(F.count_if("out") / block).cast("int").alias("go"))
    r = save(rows.join(sets, "node").join(save(counts, "counts"), "bh"), "members")
    deal = lambda g, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(g)).cast("int")
    many = lambda g: F.explode(F.sequence(F.lit(0), F.col(g) - 1))
    cols = ("node", "label", "sig", "sh")
    left = r.select("bh", deal("gr", 1).alias("i"), many("go").alias("j"), *cols)
    right = r.filter("out").select(F.col("bh").alias("bh2"), many("gr").alias("i2"), deal("go", 2).alias("j2"), *(F.col(c).alias(f"{c}2") for c in cols))
    least = possible(percent)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = [], []
        if a.num_rows and b.num_rows:
            sa, sb, la, lb = _bytes(a.column("sig")), _bytes(b.column("sig2")), _keys(a.column("label")), _keys(b.column("label2"))
            fa, fb = a.column("sh").combine_chunks(), b.column("sh2").combine_chunks()
            va, oa, vb, ob = fa.flatten().to_numpy(), np.append(0, np.cumsum(fa.value_lengths())), fb.flatten().to_numpy(), np.append(0, np.cumsum(fb.value_lengths()))
            names, ids = np.unique(np.concatenate([la, lb]), return_inverse=True)
            ia, ib, group = ids[: len(la)], ids[len(la) :], np.arange(len(names))
            for q in range(len(sb)):
                mine = np.unique(vb[ob[q] : ob[q + 1]])
                hit = np.flatnonzero(((sa == sb[q]).sum(1) >= least) & (group[ia] != group[ib[q]]))
                if not len(hit):
                    continue
                lens = oa[hit + 1] - oa[hit]
                base = np.cumsum(lens) - lens
                all_ = va[np.arange(int(lens.sum())) - np.repeat(base - oa[hit], lens)]
                at = np.minimum(np.searchsorted(mine, all_), len(mine) - 1)
                both = np.add.reduceat((mine[at] == all_).astype(np.int64), base)
                for h in hit[both * 100 >= (lens + len(mine) - both) * percent]:
                    if group[ia[h]] != group[ib[q]]:
                        group[group == group[ia[h]]] = group[ib[q]]
                        x.append(int(h))
                        y.append(q)
        return pa.table({"x": a.column("node").take(pa.array(x, pa.int64())), "y": b.column("node2").take(pa.array(y, pa.int64()))})

    return left.groupBy("bh", "i", "j").cogroup(right.groupBy("bh2", "i2", "j2")).applyInArrow(run, f"x {NODE}, y {NODE}").select(*_ordered("x", "y")).distinct()


def classes(docs: DataFrame, *, percent: int = 80, counted: bool = True, small: int = 48) -> DataFrame:
    """d, th, class_id, class_th, copies, links: one row for each distinct pair of id and text hash in docs (doc_id, text).

    class_id, class_th: the smallest pair of doc_id and text hash of the group (null ids count as the lowest number);
    both name it, as unrelated texts can share an id. A text without a word, null included, is in no group and has its
    own pair; copies: how many rows share d and th; links: with how many other texts the text was compared and found alike
    (pairs that a group holds together without are not compared). Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = save(signed(docs, counted=counted), "signed")
    nodes = save(rows.filter("node is not null").groupBy("node").agg(F.min(F.struct("d", "th")).alias("rep"), F.first("bands").alias("bands")), "nodes")
    bands = nodes.select("node", F.explode("bands").alias("bh"))
    # Written first: a join whose sides are both plain exchanges can be split where a bucket is hot.
    buckets = save(bands.groupBy("bh").agg(F.count("*").alias("c"), F.min("node").alias("pivot")).filter("c > 1"), "buckets")
    shared = save(bands.join(buckets, "bh"), "shared")
    wanted = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "rep.d", "rep.th")
    wanted = save(wanted, "wanted")
    maybe = _keyed(docs).withColumn("bk", _sifted()).join(sieve(wanted), "bk", "left_semi")
    sets = save(sets_of(maybe.join(wanted, ["d", "th"]), counted=counted).dropDuplicates(["node"]), "sets")
    drop(buckets)

    first = shared.filter("node != pivot").select(*_ordered("node", "pivot")).distinct()
    links = save(agreed(first, sets, percent), "pairs")
    labels = components(links)

    def labelled(rows_: DataFrame, node: str, name: str) -> DataFrame:
        lab = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        return rows_.join(lab, F.col(node) == F.col("_n"), "left").withColumn(name, F.coalesce("_l", node)).drop("_n", "_l")

    # A second pivot for what the first did not reach, in buckets that have more to compare than one pair.
    more = labelled(labelled(shared.filter("c > 2"), "node", "label"), "pivot", "home")
    outside = save(more.filter("label != home"), "outside")
    if outside.limit(1).count():
        second = save(outside.groupBy("bh").agg(F.min("node").alias("pivot2")), "second")
        pairs = outside.join(second, "bh").filter("node != pivot2").select(*_ordered("node", "pivot2")).distinct().join(first, ["a", "b"], "left_anti")
        links = save(links.union(agreed(pairs, sets, percent)), "pairs")
        labels = components(links)
        more = labelled(labelled(shared.filter("c > 2"), "node", "label"), "pivot", "home")
        apart_in = more.groupBy("bh").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("bh")
        rest = save(more.join(apart_in, "bh", "left_semi").select("bh", "c", "node", "label", (F.col("label") != F.col("home")).alias("out")), "rest")
        few = apart_small(rest.filter(F.col("c") <= small), sets, percent)
        found = [agreed(few.join(first, ["a", "b"], "left_anti"), sets, percent)]
        large = rest.filter(F.col("c") > small)
        if large.limit(1).count():
            found.append(apart(large, sets, percent))
        for f in found:
            links = links.union(f)
        links = save(links.distinct(), "pairs")
        labels = components(links)

    # Only texts with links need a name from elsewhere. Written first, as above: a group may hold a third of all texts.
    near = labels.join(nodes.select("node", "rep"), "node")
    named = save(near.groupBy("label").agg(F.min("rep").alias("rep")), "named")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    linked = labels.join(named, "label").join(degree, "node").select("node", F.col("rep.d").alias("l_d"), F.col("rep.th").alias("l_th"), "links")
    by_node = nodes.join(linked, "node", "left").select("node", F.coalesce("l_d", "rep.d").alias("class_id"), F.coalesce("l_th", "rep.th").alias("class_th"), F.coalesce("links", F.lit(0)).alias("links"))
    every = rows.groupBy("d", "th").agg(F.count("*").alias("copies"), F.first("node").alias("node"))
    out = every.join(by_node, "node", "left")
    return out.select("d", "th", F.coalesce("class_id", "d").alias("class_id"), F.coalesce("class_th", "th").alias("class_th"), "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def _chosen():
    """Of classes(): the one row that stays of its group."""
    return (F.col("d") == F.col("class_id")) & (F.col("th") == F.col("class_th"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, kept, copies, links, class_hash of each distinct document; class_id and class_hash name its group, of which one is kept."""
    c = classes(docs, **options)
    real = lambda x: F.when(F.col(x) != -(2**63), F.col(x))
    return c.select(real("d").alias("doc_id"), real("class_id").alias("class_id"), _chosen().alias("kept"), "copies", "links", F.col("class_th").alias("class_hash"))


def dedup(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group: that of the smallest id (of several, of the smallest text hash), and of rows alike in id and text one. Rows without words all stay but for such repeats."""
    c = save(classes(docs, **options), "classes")
    only = c.filter(_chosen()).select("d", "th", "copies")
    cols = [F.col(f"`{x}`") for x in docs.columns]
    mine = docs.select(F.struct(*cols).alias("row"), F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("d"), F.xxhash64("text").alias("th"))
    only = save(only, "only")
    # Most rows stay and stand alone: those that share no hash with a key of another kind pass without a shuffle.
    others = sieve(c.select("d", "th").join(only.filter("copies = 1").select("d", "th"), ["d", "th"], "left_anti"))
    mine = mine.withColumn("bk", _sifted())
    kept = mine.join(others, "bk", "left_semi").join(only, ["d", "th"])
    once, often = kept.filter("copies = 1"), kept.filter("copies > 1").dropDuplicates(["d", "th"])
    return mine.join(others, "bk", "left_anti").select("row.*").unionByName(once.select("row.*")).unionByName(often.select("row.*"))
