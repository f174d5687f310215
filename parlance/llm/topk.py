"""Exact top-k search (operator 6): an impact-ordered index, processed score at a time.

The index is cut into blocks of rows. A posting is a component's value in one row, its impact the value's magnitude,
quantised to one of a few levels; embeddings are dense, so the postings of one level, of all components' lists, are held
as one matrix: a segment. Segments are added to all scores of a batch of queries in descending order of impact. What is
left can move a row's score by at most the product of the query's length and that of the row's postings not yet added.
Once that proves that all but a few rows are below the k-th best, those few are scored exactly, in integers. Nothing
stops without that proof, so results are exact. The k-th best score of earlier blocks is carried along as a floor.
Queries meet blocks in (block, chunk of queries) groups of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import drop, save, ship

OUT = "qr long, query_id long, vec_id long, score long"
#: The levels of impact: values of a magnitude above these shares of the greatest, then the rest.
LEVELS = (1 / 4, 1 / 16)
SAFE = float(2**52)


class Block:
    """Segments of the rows of V (rows x components, integers)."""

    def __init__(self, V: np.ndarray):
        self.V = V
        mags = np.abs(V)
        self.top = int(mags.max(initial=0))
        bars = [int(self.top * x) for x in LEVELS] + [-1]
        self.segments, self.left = [], []
        above = np.full(V.shape, False)
        for bar in bars:
            now = (mags > bar) & ~above
            above |= now
            self.segments.append(np.where(now, V, 0).astype(np.float64).T)
            rest = np.where(above, 0, V).astype(np.float64)
            self.left.append(np.sqrt((rest * rest).sum(1)) * (1 + 1e-9))

    def search(self, Q: np.ndarray, k: int, own: np.ndarray, floor: np.ndarray, few: int = 64) -> list[np.ndarray]:
        """For each query the rows that can be among its k best, `own` (-1: none) excepted; floor: scores that a member must reach."""
        n, out = len(self.V), [np.zeros(0, np.int64)] * len(Q)
        if self.top * float(np.abs(Q).max(initial=0)) * Q.shape[1] >= SAFE:  # sums could be rounded: no bounds, all rows are possible
            return [np.setdiff1d(np.arange(n), [o]) for o in own]
        q = Q.astype(np.float64)
        size = np.sqrt((q * q).sum(1)) * (1 + 1e-9)
        acc, open_ = np.zeros((len(q), n)), np.arange(len(q))
        for s, left in zip(self.segments, self.left, strict=True):
            acc[open_] += q[open_] @ s
            a = acc[open_]
            mine = np.flatnonzero(own[open_] >= 0)
            a[mine, own[open_][mine]] = -np.inf
            rest = size[open_][:, None] * left[None, :]
            kth = np.partition(a - rest, n - k, axis=1)[:, n - k] if n > k else np.full(len(open_), -np.inf)
            maybe = (a + rest >= np.maximum(kth, floor[open_])[:, None]) & (a > -np.inf)
            done = (maybe.sum(1) <= max(few, n // 64)) | (not left.any())
            for i in np.flatnonzero(done):
                out[open_[i]] = np.flatnonzero(maybe[i])
            open_ = open_[~done]
            if not len(open_):
                break
        return out


def exact(V: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in integers; an error where one is beyond 64 bits."""
    if float(np.abs(V).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, len(q)) < float(2**62):
        return V @ q
    s = [sum(a * b for a, b in zip(v, q.tolist(), strict=True)) for v in V.tolist()]
    if any(not -(2**63) <= x < 2**63 for x in s):
        raise ValueError("a score is beyond 64 bits")
    return np.array(s, np.int64)


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, v (floor(256 x) of each component), r (a number of the row's own). Vectors that are null or hold a null, NaN or infinity are left out; a component beyond 64 bits is an error."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("embedding").isNotNull() & ~bad)
    whole = lambda x: F.when(F.abs(256 * x) < float(2**62), F.floor(256 * x)).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("long"))
    return v.select("vec_id", F.transform("embedding", whole).alias("v"), F.monotonically_increasing_id().alias("r"))


def search(vectors: DataFrame, k: int = 5, *, every: int = 50, block: int = 65_536, chunk: int = 8192, part: int = 8192, batch: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row whose vec_id is divisible by `every`.

    Score: integer inner product; ties to the smaller vec_id. Rows that share a vec_id are rows of their own; a null
    vec_id is never a query and comes last in ties. Shorter vectors count as ended by zeros. Fewer than k rows give all.
    Components or scores that no long can hold are an error; large ones that it can hold are scored exactly.

    Vectors are sent once for each chunk of queries, queries once for each block: at n vectors that is
    n x ceil(n / every / chunk) and n / every x ceil(n / block) rows; time grows with n x n / every, as it must.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = save(quantised(vectors), "vectors")
    is_query = F.col("vec_id") % every == 0
    n, nq = rows.agg(F.count("*"), F.coalesce(F.count_if(is_query), F.lit(0))).first()
    # As many groups as the session has partitions, more where a block or a chunk would be too large.
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks, chunks = max(1, -(-n // block), min(tasks, n // 1024)), max(1, -(-nq // chunk))
    deal = lambda m, salt: F.pmod(F.xxhash64("r", F.lit(salt)), F.lit(m)).cast("int")
    cands = rows.select(deal(blocks, 1).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("c"), "vec_id", "v", "r")
    qs = rows.filter(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), deal(chunks, 2).alias("c"), "vec_id", "v", "r")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("qr", "query_id", "vec_id", "score")
        if not left.num_rows or not right.num_rows:
            return pa.table({x: pa.array([], pa.int64()) for x in names})

        def dense(t: pa.Table, d: int) -> np.ndarray:
            v = t.column("v").combine_chunks()
            lens = np.diff(v.offsets.to_numpy())
            m = np.zeros((len(lens), d), np.int64)
            m[np.arange(d) < lens[:, None]] = v.flatten().to_numpy()
            return m

        d = max(1, *(int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max()) for t in (left, right)))
        ids, rs, V = left.column("vec_id").fill_null(2**63 - 1).to_numpy(), left.column("r").to_numpy(), dense(left, d)
        Q, qr, qid = dense(right, d), right.column("r").to_numpy(), right.column("vec_id").to_numpy()
        best_id, best = [np.zeros(0, np.int64)] * len(Q), [np.zeros(0, np.int64)] * len(Q)
        floor = np.full(len(Q), -np.inf)
        for at in range(0, len(V), part):
            index, place = Block(V[at : at + part]), {r: i for i, r in enumerate(rs[at : at + part].tolist())}
            for lo in range(0, len(Q), batch):
                own = np.array([place.get(r, -1) for r in qr[lo : lo + batch].tolist()], np.int64)
                for i, found in enumerate(index.search(Q[lo : lo + batch], k + 1, own, floor[lo : lo + batch]), lo):
                    score = np.concatenate([best[i], exact(index.V[found], Q[i])])
                    who = np.concatenate([best_id[i], ids[at + found]])
                    top = np.lexsort((who, -score))[:k]
                    best_id[i], best[i] = who[top], score[top]
                    if len(top) == k and abs(int(score[top[-1]])) < SAFE:
                        floor[i] = score[top[-1]]
        lens = [len(x) for x in best]
        cols = (np.repeat(qr, lens), np.repeat(qid, lens), np.concatenate(best_id), np.concatenate(best))
        return pa.table({x: pa.array(c, pa.int64()) for x, c in zip(names, cols, strict=True)})

    each = cands.groupBy("b", "c").cogroup(qs.groupBy("b", "c")).applyInArrow(run, OUT)
    rank = F.row_number().over(Window.partitionBy("qr").orderBy(F.desc("score"), "vec_id"))
    best = save(each.withColumn("rank", rank).filter(F.col("rank") <= k), "found")
    drop(rows)
    return best.select("query_id", "rank", F.when(F.col("vec_id") < 2**63 - 1, F.col("vec_id")).alias("vec_id"), "score")
