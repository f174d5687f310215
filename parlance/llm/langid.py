"""Language ID (operator 3): averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A word's features are the character n-grams of <word>, hashed into a fixed number of rows of an embedding; a text is
the mean over all its words' features; a linear softmax names the language. As mean and softmax's weights are linear, a
word's share of every language's score is one short vector, kept in a bounded table by each worker. The softmax is
calibrated by a temperature on rows held back from training, where the limit for rejection comes from too.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import hold, parts, plain, ship

WORD = re.compile(r"[^\W\d_]+")
GRAMS = (1, 2, 3, 4)
WORDS = 300_000
#: Longer runs of letters, as of scripts without spaces, seldom come again: they are read whole but not kept in the table.
LONG = 40


def features(word: str, buckets: int, piece: int = 4096) -> Iterator[list[int]]:
    """All n-grams of <word>, of any length, in lists of those that begin within `piece` characters."""
    w = f"<{word}>"
    for at in range(0, len(w), piece):
        yield [zlib.crc32(w[i : i + n].encode()) % buckets for n in GRAMS for i in range(at, min(at + piece, len(w) - n + 1))]


def tally(words: list[str], buckets: int) -> np.ndarray:
    """How often each feature comes in the words."""
    count, some = np.zeros(buckets, np.int64), []
    for w in words:
        for f in features(w, buckets):
            some += f
            if len(some) > 1 << 16:
                count += np.bincount(some, minlength=buckets)
                some = []
    return count + np.bincount(np.array(some, np.int64), minlength=buckets)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x languages: each feature's share of the scores
    heat: float = 1.0
    least: float = 0.0
    known: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray | None = None

    def __getstate__(self):
        return {"langs": self.langs, "table": self.table, "heat": self.heat, "least": self.least, "known": {}, "rows": None}

    def forget(self) -> None:
        self.known, self.rows = {}, None

    def scores(self, text: str | None) -> np.ndarray | None:
        """Mean share of the whole text's words; None if it has no letter."""
        words = WORD.findall((text or "").lower())
        if not words or not any(c.isalpha() for w in words for c in w):
            return None
        known, total = self.known, np.zeros(len(self.langs) + 1)
        for w in words:
            if len(w) > LONG:
                for f in features(w, len(self.table)):
                    total[:-1] += self.table[f].sum(0, dtype=np.float64)
                    total[-1] += len(f)
        words = [w for w in words if len(w) <= LONG]
        if self.rows is None:
            self.rows = np.zeros((1024, len(self.langs) + 1), np.float32)
        new = {w for w in words if w not in known}
        if len(known) + len(new) > WORDS:
            known.clear()
            new = set(words)
        for w in new:
            at = known[w] = len(known)
            if at == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            (f,) = features(w, len(self.table))
            self.rows[at, :-1] = self.table[f].sum(0)
            self.rows[at, -1] = len(f)
        s = total + self.rows[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(0, dtype=np.float64)
        return s[:-1] / s[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        s = self.scores(text) if self.langs else None
        if s is None:
            return "und", 0.0
        e = np.exp((s - s.max()) / self.heat)
        best = int(np.argmax(e))
        return self.langs[best], float(e[best] / e.sum())


def sample(docs: DataFrame, *, rows: int = 2400, buckets: int = 1 << 15, salt: int = 17) -> DataFrame:
    """lang, h, idx, wt: features of at most `rows` rows, spread evenly over the languages by a hash of doc_id.

    Whole texts are read. As `rows` rows can show no more than `rows` languages, those of most rows are taken (ties by
    name): the counts that are broadcast have at most that many rows, and no text is shuffled by its language, of which
    one may hold most of the corpus.
    """
    ship(docs.sparkSession)
    fit = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "doc_id", "text")
    many = fit.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(rows)
    many = F.broadcast(many.select("l", "n", F.count("*").over(Window.partitionBy()).alias("k")))
    h = F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30))
    some = fit.withColumn("h", h).join(many, F.col("lang") == F.col("l")).filter(F.col("h") < F.lit(float(1 << 30)) * rows / F.col("k") / F.col("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            idx, wt = [], []
            for t in b.column(2).to_pylist():
                c = tally(WORD.findall(t.lower()), buckets)
                i = np.flatnonzero(c).astype(np.int32)
                c = c[i]
                idx.append(i)
                wt.append((c / max(1, c.sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(idx, pa.list_(pa.int32())), pa.array(wt, pa.list_(pa.float32()))], ["lang", "h", "idx", "wt"])

    return some.select("lang", "h", "text").orderBy("h", "lang", F.xxhash64("text")).limit(rows).mapInArrow(run, "lang string, h long, idx array<int>, wt array<float>")


def train(rows: list, *, buckets: int = 1 << 15, dim: int = 12, epochs: int = 4, rate: float = 4.0, reject: float = 0.005, seed: int = 3) -> Model:
    """rows: (lang, h, idx, wt). A fifth is held back: its temperature has the least loss, and its scores' lower tail of share `reject` is rejected, where that is under one half."""
    rows = [r for r in rows if len(r[2])]
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((1, 0), np.float32))
    rng, at = np.random.default_rng(seed), {x: i for i, x in enumerate(langs)}
    E = (rng.standard_normal((buckets, dim)) / dim).astype(np.float32)
    W = np.zeros((len(langs), dim), np.float32)
    data = [(at[r[0]], np.asarray(r[2]), np.asarray(r[3], np.float32)) for r in rows]
    fit, back = [x for i, x in enumerate(data) if i % 5], data[::5]
    fit = fit or data
    for epoch in range(epochs):
        for k, i in enumerate(rng.permutation(len(fit))):
            y, idx, wt = fit[i]
            step = rate * (1 - (epoch + k / len(fit)) / epochs)
            e = E[idx]
            h = wt @ e
            p = W @ h
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            g = p @ W
            W -= step * np.outer(p, h)
            E[idx] = e - step * np.outer(wt, g)
    m = Model(langs, (E @ W.T).astype(np.float32))
    s = np.array([wt @ m.table[idx] for _, idx, wt in back])
    ys = np.array([y for y, _, _ in back])

    def chances(heat: float) -> np.ndarray:
        e = np.exp((s - s.max(1, keepdims=True)) / heat)
        return e / e.sum(1, keepdims=True)

    loss = lambda heat: -np.log(np.maximum(chances(heat)[np.arange(len(ys)), ys], 1e-12)).mean()
    m.heat = float(min((2.0 ** (x / 2) for x in range(-6, 9)), key=loss))
    m.least = float(min(0.5, np.quantile(chances(m.heat).max(1), reject)))
    return m


def fitted(docs: DataFrame, *, rows: int = 2400, buckets: int = 1 << 15) -> Model:
    """The model learned from docs (doc_id, text, lang). What reaches the driver is bounded by `rows` and `buckets`; it comes as Arrow columns."""
    got = sample(docs.select("doc_id", "text", "lang"), rows=rows, buckets=buckets).toArrow().combine_chunks()
    cols = [got.column(c).combine_chunks() for c in ("idx", "wt")] if got.num_rows else []
    feats = [[c.flatten().to_numpy()[a:b] for a, b in zip(o, o[1:], strict=False)] for c in cols for o in [np.append(0, np.cumsum(c.value_lengths().to_numpy()))]]
    made = zip(got.column("lang").to_pylist(), got.column("h").to_pylist(), *feats, strict=True) if feats else ()
    model = train(sorted(made, key=lambda r: (r[1], r[0], len(r[2]))), buckets=buckets)
    del got, cols, feats, made
    pa.default_memory_pool().release_unused()  # the driver keeps the model alone
    return model


def _told(docs: DataFrame, model: Model, text: str, only: bool) -> DataFrame:
    """docs' columns as c0, c1, ... with n0, n1, n2: language, score and whether it is rejected; or, with `only`, the rows that aren't."""
    src, at = plain(docs), docs.columns.index(text)
    names = [*src.columns, "n0", "n1", "n2"]
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        hold(f"langid {id(m)}", m.forget)
        for b in parts(batches):
            got = [m.predict(t) for t in b.column(at).to_pylist()]
            bad = [g[0] == "und" or g[1] < m.least for g in got]
            if only:
                yield b.filter(pa.array([not x for x in bad], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array(bad, pa.bool_())], names)

    return src.mapInArrow(run, src.schema if only else src.select("*", F.lit("").alias("n0"), F.lit(0.0).alias("n1"), F.lit(False).alias("n2")).schema)


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (calibrated chance of it) and rejected to each row; columns of these names are replaced.

    A null text or one without a letter is `und` with score 0 and rejected. Nothing but the text is read for a prediction.
    """
    new = ["lang_pred", "score", "rejected"]
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new))
    return _told(kept, model, text, False).toDF(*kept.columns, *new)


def keep(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows of docs that aren't rejected, with its columns, whatever their names. Each goes to a worker once."""
    return _told(docs, model, text, True).toDF(*docs.columns)
