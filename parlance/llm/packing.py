"""Packing (operator 4): bounded-space online packing of token runs into sequences of fixed length.

Each partition keeps a fixed number of open windows. A document's run of ids goes to the window that it fills best; if
none can take it whole, the fullest window is filled up with the run's head where that saves at least `min_cut` ids of
padding, and is then emitted. Longer runs first give whole sequences. What is open at a partition's end is carried,
ids included, to a merge that packs leftovers again, tier by tier, until one task holds the last few.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import SPACE, U64, bytes_of, exact_hashes, hold, save, ship, slices, words_of

#: Bytes of one generation of the table of words; two are held. Words of more than LONG bytes are not kept.
TABLE, LONG = 32 << 20, 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
TYPES = [pa.int64()] * 7 + [pa.binary()]


def spread(begin: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1 and so on, lens[i] of them, for each i."""
    base = np.cumsum(lens) - lens
    return np.repeat(begin - base, lens) + np.arange(int(lens.sum()))


class Words:
    """Words with their ids, found by hash and told apart by their bytes. Arrays only: a word takes some 40 bytes."""

    def __init__(self):
        self.hash, self.where = np.zeros(0, U64), np.zeros(0, np.int32)
        self.lens, self.counts = np.zeros(0, np.uint8), np.zeros(0, np.uint8)  # at most LONG, and an id takes a byte at least
        self.begin, self.first = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.data, self.ids = np.zeros(0, np.uint8), np.zeros(0, "<u4")

    def size(self) -> int:
        return sum(x.nbytes for x in vars(self).values())

    def find(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The number of each word here, or -1."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.hash) or not len(h):
            return out
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        k = self.where[at]
        maybe = np.flatnonzero((self.hash[at] == h) & (self.lens[k] == lens))
        k = k[maybe]
        differ = data[spread(starts[maybe], lens[maybe])] != self.data[spread(self.begin[k], lens[maybe])]
        ends = np.cumsum(lens[maybe])
        wrong = np.diff(np.cumsum(differ)[ends - 1], prepend=0) > 0 if len(ends) else np.zeros(0, bool)
        out[maybe[~wrong]] = k[~wrong]
        return out

    def add(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, lens: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """h: sorted, each once. A word whose hash another word has already is found by nobody, and encoded each time."""
        n, to = len(self.lens), np.searchsorted(self.hash, h, side="right")
        more = {"begin": len(self.data) + np.cumsum(lens) - lens, "first": len(self.ids) + np.cumsum(counts) - counts, "lens": lens, "counts": counts, "data": data[spread(starts, lens)], "ids": ids}
        for k, v in more.items():
            old = getattr(self, k)
            setattr(self, k, np.concatenate([old, v.astype(old.dtype)]))
        self.hash, self.where = np.insert(self.hash, to, h), np.insert(self.where, to, n + np.arange(len(h)))


class WordBPE:
    """The library's ids of texts, remembered for each run of characters between ASCII white space.

    Normalising, splitting and merging never reach over white space, so the runs' ids joined are the text's ids. Runs not
    yet known are encoded by the library many at a time, joined by spaces; where each one's ids end follows from the
    number of bytes that each id stands for. Runs whose normal form could differ in length are encoded one by one.
    What is remembered is bounded in bytes: a full table becomes the older one, from which what is used is taken over.
    """

    def __init__(self, path: str, table: int = TABLE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        vocab = self.lib.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for t, i in vocab.items():
            self.width[i] = len(t.removesuffix("</w>"))
        self.table, self.known, self.older = table, Words(), Words()

    def alone(self, word: bytes) -> np.ndarray:
        return np.array(self.lib.encode_batch_fast([word.decode()], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, new: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list = [None] * len(new)
        plain: list[int] = []
        sizes: list[int] = []
        for k, c in enumerate(new):
            s = c.decode()
            if c.isascii() and s.isprintable():
                sizes.append(len(c))
            elif s.isprintable() and max(s) < "\u0250" and "\u0130" not in s:
                sizes.append(len(s.lower().encode()))
            else:
                out[k] = self.alone(c)
                continue
            plain.append(k)
        step = 256
        groups = [plain[i : i + step] for i in range(0, len(plain), step)]
        texts = [b" ".join(new[k] for k in g).decode() for g in groups]
        for n, (g, one) in enumerate(zip(groups, self.lib.encode_batch_fast(texts, add_special_tokens=False), strict=True)):
            ids = np.array(one.ids, "<u4")
            have, want = np.cumsum(self.width[ids]), np.cumsum(sizes[n * step : (n + 1) * step])
            cut = np.searchsorted(have, want) + 1
            if not len(have) or len(have) != cut[-1] or not np.array_equal(have[cut - 1], want):
                for k in g:
                    out[k] = self.alone(new[k])
                continue
            at = 0
            for k, to in zip(g, cut.tolist(), strict=True):
                out[k] = ids[at:to]
                at = to
        return out

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and how many each has."""
        n = len(offs) - 1
        starts, ends, rows = words_of(data, offs, ~SPACE)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(n, np.int64)
        lens = ends - starts
        h, rep, which = np.unique(exact_hashes(data, starts, ends), return_index=True, return_inverse=True)
        inside = np.flatnonzero(~SPACE[data])
        if not (np.array_equal(lens, lens[rep[which]]) and np.array_equal(data[inside], data[spread(starts[rep[which]], lens)])):
            # Two words share a hash: no table for this slice.
            each = [self.alone(data[a:b].tobytes()) for a, b in zip(offs, offs[1:], strict=False)]
            return np.concatenate([np.zeros(0, "<u4"), *each]), np.array([len(x) for x in each], np.int64)
        s, size = starts[rep], lens[rep]
        if self.known.size() > self.table:
            self.older, self.known = self.known, Words()
        at = self.known.find(h, data, s, size)
        todo = np.flatnonzero(at < 0)
        back = self.older.find(h[todo], data, s[todo], size[todo])
        found, miss = todo[back >= 0], todo[back < 0]
        back = back[back >= 0]
        raw = data.tobytes()
        made = self.learn([raw[a : a + b] for a, b in zip(s[miss].tolist(), size[miss].tolist(), strict=True)])
        both = np.concatenate([found, miss])
        again = self.older.counts[back].astype(np.int64)
        count = np.concatenate([again, np.array([len(x) for x in made], np.int64)])
        ids = np.concatenate([self.older.ids[spread(self.older.first[back], again)], *made, np.zeros(0, "<u4")])
        # Ids of this slice's words: those known from before, then the others in the order of `both`.
        old = np.flatnonzero(at >= 0)
        counts, first = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        counts[old], first[old] = self.known.counts[at[old]], self.known.first[at[old]]
        counts[both], first[both] = count, len(self.known.ids) + np.cumsum(count) - count
        per = counts[which]
        out = spread(first[which], per)
        fresh = out >= len(self.known.ids)
        out, out[fresh] = self.known.ids[np.where(fresh, 0, out)] if len(self.known.ids) else np.zeros(len(out), "<u4"), ids[out[fresh] - len(self.known.ids)]
        keep = np.sort(both[size[both] <= LONG])
        self.known.add(h[keep], data, s[keep], size[keep], ids[spread(first[keep] - len(self.known.ids), counts[keep])], counts[keep])
        total = np.zeros(len(per) + 1, np.int64)
        np.cumsum(per, out=total[1:])
        bounds = np.searchsorted(rows, np.arange(n + 1))
        return out, np.diff(total[bounds])


@lru_cache(2)
def coder(path: str) -> WordBPE:
    return WordBPE(path)


class Packer:
    """Open windows, least room first. A run is (doc_id, start, total, ids)."""

    def __init__(self, size: int, windows: int, min_cut: int, first_id: int):
        self.size, self.windows, self.min_cut, self.next_id = size, windows, min_cut, first_id
        self.open: list[tuple[int, int]] = []  # room, key
        self.held: dict[int, list[tuple]] = {}
        self.made = 0

    def place(self, room: int, key: int, run: tuple) -> list | None:
        self.held[key].append(run)
        room -= len(run[3]) // 4
        if room:
            insort(self.open, (room, key))
            return None
        return self.held.pop(key)

    def add(self, doc_id, start: int, total: int, ids: bytes) -> Iterator[list[tuple]]:
        """Places a run; yields the windows that this fills or closes."""
        n, whole = len(ids) // 4, self.size * 4
        while n >= self.size:
            yield [(doc_id, start, total, ids[:whole])]
            ids, start, n = ids[whole:], start + self.size, n - self.size
        while n:
            at = bisect_left(self.open, (n, -1))
            if at < len(self.open):
                room, key = self.open.pop(at)
            elif len(self.open) < self.windows:
                room, key = self.size, self.made
                self.made += 1
                self.held[key] = []
            else:
                room, key = self.open.pop(0)
                if room >= self.min_cut:
                    self.held[key].append((doc_id, start, total, ids[: room * 4]))
                    ids, start, n = ids[room * 4 :], start + room, n - room
                yield self.held.pop(key)
                continue
            if (full := self.place(room, key, (doc_id, start, total, ids))) is not None:
                yield full
            n = 0

    def rows(self, window: list[tuple], keep: bool) -> list[tuple]:
        out, offset = [], 0
        for doc_id, start, total, ids in window:
            n = len(ids) // 4
            out.append((doc_id, start, n, zlib.crc32(ids), total, self.next_id, offset, ids if keep else None))
            offset += n
        self.next_id += 1
        return out

    def rest(self) -> list[list[tuple]]:
        left = [self.held.pop(key) for _, key in self.open]
        self.open = []
        return left


def batches_of(rows: Iterator[list[tuple]], most: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held += r
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), TYPES, strict=True)], NAMES)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), TYPES, strict=True)], NAMES)


def pack(docs: DataFrame, path: str, *, size: int = 2048, end_id: int = 1, windows: int = 32, min_cut: int = 16, fan_in: int = 32) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    docs: doc_id, text. A null or empty text is end_id alone. ids (binary) is null for what a partition emitted itself
    and is kept only for leftovers until they are merged. Repeated rows are packed each for itself. Columns besides
    doc_id and text are ignored. The last window of all is cut so that all but one sequence are full.
    The sequences of a partition depend on its rows in their order, so a task run again gives the same.
    """
    spark = docs.sparkSession
    ship(spark)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("packing", coder.cache_clear)
        part = TaskContext.get().partitionId()
        p, bpe, end = Packer(size, windows, min_cut, part << 32), coder(path), np.array([end_id], "<u4").tobytes()

        def go():
            for b in batches:
                data, offs = bytes_of(b.column(1))
                for i, j in slices(offs, 1 << 19):
                    ids, counts = bpe.encode(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    to = np.cumsum(counts)
                    for d, n, z in zip(b.column(0).slice(i, j - i).to_pylist(), counts.tolist(), to.tolist(), strict=True):
                        for w in p.add(d, 0, n + 1, ids[z - n : z].tobytes() + end):
                            yield p.rows(w, False)
            for w in p.rest():
                yield p.rows(w, True)

        return batches_of(go())

    src = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    parts = src.rdd.getNumPartitions()
    done = save(src.mapInArrow(first, SCHEMA), "packed")
    out, left, tier = done.filter("ids is null"), done.filter("ids is not null"), 1
    while True:
        parts = max(1, -(-parts // fan_in))
        last = parts == 1
        base = tier << 56

        def again(batches: Iterator[pa.RecordBatch], last=last, base=base) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            p = Packer(size, windows, min_cut, base + (part << 32))

            def go():
                for b in batches:
                    for r in b.to_pylist():
                        for w in p.add(r["doc_id"], r["start"], r["doc_tokens"], r["ids"]):
                            yield p.rows(w, False)
                rest = p.rest()
                if not last:
                    for w in rest:
                        yield p.rows(w, True)
                    return
                room, cur = size, []
                for run in (r for w in rest for r in w):
                    doc_id, start, total, ids = run
                    while ids:
                        head = ids[: room * 4]
                        cur.append((doc_id, start, total, head))
                        room -= len(head) // 4
                        start += len(head) // 4
                        ids = ids[len(head) :]
                        if not room:
                            yield p.rows(cur, False)
                            room, cur = size, []
                if cur:
                    yield p.rows(cur, False)

            return batches_of(go())

        # The window's id says which partition it came from: neighbours meet, in an order that a second run repeats.
        near = left.withColumn("to", ((F.col("sequence_id") % F.lit(1 << 56)) / F.lit((1 << 32) * fan_in)).cast("int"))
        near = near.repartition(parts, "to") if parts > 1 else near.repartition(1)
        merged = near.sortWithinPartitions("sequence_id", "offset").drop("to").mapInArrow(again, SCHEMA)
        if last:
            return out.unionByName(merged)
        merged = save(merged, "packed")
        out, left, tier = out.unionByName(merged.filter("ids is null")), merged.filter("ids is not null"), tier + 1
