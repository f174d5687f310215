"""Byte-level BPE (operator 10): exact merges by backtracking over longest matches, and decoding.

Each byte is mapped to the Latin-1 character of the same number, so that an Aho-Corasick automaton over strings
(pyahocorasick) finds every vocabulary entry in a piece in one pass. A greedy longest match is kept only while each
pair of neighbours is compatible, that is while merging the two tokens' bytes gives those two tokens again; else the
match is shortened or taken back. Positions that led nowhere are marked and not tried twice, so the work is linear.
Compatibility and whole pieces are memoised in tables of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import hold, parts, ship

PIECES, PAIRS, LONG = 400_000, 400_000, 200


class ByteBPE:
    """encode() gives little-endian unsigned 32-bit ids, as bytes; decode() takes them back."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        # \s of the other library is the property White_Space; here it would also hold for 1C to 1F.
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.found = ahocorasick.Automaton()
        for t, i in self.ranks.items():
            self.found.add_word(t.decode("latin-1"), (len(t), i))
        self.found.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.shorter: dict[int, int | None] = {}

    def merged(self, b: bytes) -> list[int]:
        """By the definition: of all neighbours the pair of lowest rank is merged, leftmost first. For two tokens' bytes only."""
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 1:
            best = min((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1], 1 << 60)) is not None)
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return ok

    def prefix(self, token: int) -> int | None:
        """The longest entry that is a proper prefix of a token."""
        if token not in self.shorter:
            b = self.bytes_of[token]
            self.shorter[token] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks), None)
        return self.shorter[token]

    def backtrack(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest: list = [None] * n
        size = [0] * n
        for end, (length, i) in self.found.iter(piece.decode("latin-1")):
            at = end - length + 1
            if length > size[at]:
                size[at], longest[at] = length, i
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            last = out[-1] if out else None
            while True:
                end = pos + len(self.bytes_of[token])
                if open_[end] and (last is None or self.compatible(last, token)):
                    out.append(token)
                    pos = end
                    token = longest[end] if end < n else None
                    break
                less = self.prefix(token)
                if less is not None:
                    token = less
                    continue
                if last is None:
                    raise ValueError("the vocabulary lacks a byte")
                open_[pos] = 0
                out.pop()
                pos -= len(self.bytes_of[last])
                token = last
                break
        return out

    def encode(self, text: str) -> bytes:
        known, parts = self.pieces, []
        for p in self.split.findall(text):
            ids = known.get(p)
            if ids is None:
                ids = self.older.get(p)
                if ids is None:
                    ids = np.array(self.backtrack(p.encode()), "<u4").tobytes()
                if len(p) <= LONG:
                    if len(known) >= PIECES:  # what was used of late is found again among the older ones
                        self.older, self.pieces = known, {}
                        known = self.pieces
                    known[p] = ids
            parts.append(ids)
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def coder(path: str, pattern: str) -> ByteBPE:
    """One for each worker process, which serves task after task."""
    return ByteBPE(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", *, ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """Adds the ids (binary, little-endian unsigned 32-bit) and what decoding them gives (binary) to each row.

    A null or empty text has no ids and decodes to nothing. An existing column of the new names is replaced.
    Rows keep their order, and each is handled alone: no shuffle, so groups of copies or long texts meet nowhere.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    src = docs.select(*(F.col(f"`{c}`") for c in kept))
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("bpe", coder.cache_clear)
        bpe = coder(path, pattern)
        for b in parts(batches):
            made = [bpe.encode(t or "") for t in b.column(at).to_pylist()]
            cols = [*b.columns, pa.array(made, pa.binary())]
            if decoded:
                cols.append(pa.array([bpe.decode(x) for x in made], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, [*kept, ids, *([decoded] if decoded else [])])

    schema = src.select("*", F.lit(b"").alias(ids), *([F.lit(b"").alias(decoded)] if decoded else [])).schema
    return src.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, hashed beside the operator's columns.

    The digests are taken in the worker: ids and decoded bytes need not cross to the JVM for that.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("bpe", coder.cache_clear)
        bpe = coder(path, pattern)
        for b in parts(batches):
            made = [bpe.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) // 4 for x in made], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in made]),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in made]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
