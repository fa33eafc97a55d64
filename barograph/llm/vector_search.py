"""Exact top-k inner-product search by columnar branch-and-bound.

Vectors are scaled to integers and laid out by dimension, ``ROWS`` candidates at a time.  The dimensions of such a
block have one order for all queries, by the mass of the candidates and the queries there, and the masses that remain
after each ``DIMS`` of them are summed once.  Scores are accumulated some dimensions at a time; a candidate's score so
far plus the largest that the remaining dimensions can add (Cauchy-Schwarz on the remaining masses) bounds its score.
A query's k-th best score of the blocks before, or the k-th best lower bound in the first one, is what a bound must
reach; as long as most candidates do, whole blocks of queries go on together, then each query compacts its survivors.
Those have exact integer scores.  Each partition keeps k candidates a query, and a window ranks what they kept.
Sums of integers below 2**53 are exact as doubles; vectors that could go beyond are multiplied as 64-bit integers.

Queries are a stated set searched against all rows.  They go out in blocks of at most ``block`` rows, so what is
broadcast doesn't grow with the data; with more than one block each block's result is written before the next.

Nulls and edges: a vector that is null, empty or holds a null or non-finite component takes part neither as query
nor as candidate, nor does a row of null id.  Vectors of different lengths are padded with zeros.  Rows with a
query's own id are not its candidates; a repeated id is a candidate once for each row, and a query once, by the
vector that sorts first.  Equal scores go to the smaller id.  Fewer rows than k give fewer ranks; empty tables
give no rows.  Scores must fit in 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved, shared_dir, small_batches

#: Dimensions that are accumulated between two compactions, candidates of one vertical block, queries that go together.
DIMS, ROWS, TOGETHER = 16, 8192, 256
#: Queries go on together while this share of their candidates is alive.
SHARE = 0.5


def scaled(col, scale: int = 1024):
    """floor(scale * x) of each component as double."""
    return F.transform(col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


class Block:
    """Candidates in vertical layout (dimensions by rows), and what they need for a stated set of queries."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, queries: np.ndarray):
        big = (int(np.abs(x).max(initial=0)), int(np.abs(queries).max(initial=0)))
        kind = np.float64 if big[0] * big[1] * max(len(x), 1) < 1 << 53 else np.int64
        mass, wanted = x.astype(float) ** 2, queries.astype(float) ** 2
        order = np.argsort(-mass.sum(1) * wanted.sum(0), kind="stable")
        self.ids, self.queries = ids, queries[:, order].astype(kind)
        self.x = np.ascontiguousarray(x[order], dtype=kind)
        self.cuts = [slice(a, a + DIMS) for a in range(0, len(order), DIMS)]
        # masses of the dimensions beyond each cut
        beyond = lambda m: [np.sqrt(m[c.stop :].sum(0)) for c in self.cuts]
        self.rest, self.query_rest = beyond(mass[order]), beyond(wanted[:, order].T)

    def search(self, at: slice, own: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For the queries ``at``: ids and scores of candidates among which are all of the k best not below ``floor``.

        own: ids that aren't the query's candidates.  floor: scores that are reached already, or -inf.
        """
        queries, free = self.queries[at], self.ids[None] != own[:, None]
        part = np.zeros((len(queries), len(self.ids)), self.x.dtype)
        floor, out = floor.copy(), []
        for b, dims in enumerate(self.cuts):
            part += queries[:, dims] @ self.x[dims]
            if b + 1 == len(self.cuts):
                alive = free & (part >= floor[:, None])
                break
            slack = self._slack(part, self.query_rest[b][at, None] * self.rest[b][None])
            open_ = np.isneginf(floor)
            if open_.any() and len(self.ids) > k:
                low = np.where(free[open_], part[open_] - slack[open_], -np.inf)
                floor[open_] = np.partition(low, len(self.ids) - k, axis=1)[:, len(self.ids) - k]
            alive = free & (part + slack >= floor[:, None])
            if alive.mean() < SHARE:
                break
        for j in range(len(queries)):
            rows = np.flatnonzero(alive[j])
            score = part[j, rows]
            for c in range(b + 1, len(self.cuts)):
                dims = self.cuts[c]
                score = score + queries[j, dims] @ self.x[dims][:, rows]
                if c + 1 < len(self.cuts):
                    slack = self._slack(score, self.query_rest[c][at][j] * self.rest[c][rows])
                    least = floor[j]
                    if len(rows) > k:
                        least = max(least, np.partition(score - slack, len(rows) - k)[len(rows) - k])
                    keep = score + slack >= least
                    rows, score = rows[keep], score[keep]
            out.append((self.ids[rows], score.astype(np.int64)))
        return out

    @staticmethod
    def _slack(part: np.ndarray, most: np.ndarray) -> np.ndarray:
        """What the remaining dimensions can add or take, with room for rounding."""
        return most * (1 + 1e-9) + np.abs(part) * 1e-12 + 1


def _matrix(col: pa.ListArray, dims: int) -> np.ndarray:
    at = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False)
    out = np.zeros((dims, len(col)), np.int64)
    size = np.diff(at)
    if len(col) and (size == dims).all():
        out[:] = flat[at[0] : at[-1]].reshape(len(col), dims).T
    else:
        for i in range(len(col)):
            out[: min(size[i], dims), i] = flat[at[i] : at[i] + min(size[i], dims)]
    return out


def _partial(ids: np.ndarray, vectors: np.ndarray, k: int):
    """For each query of the block the k best rows of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]
        held: list[pa.RecordBatch] = []

        def search() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            cand, x = t["id"].to_numpy(), _matrix(t["v"].chunk(0), vectors.shape[1])
            block = Block(x, cand, vectors)
            for a in range(0, len(ids), TOGETHER):
                some = range(a, min(a + TOGETHER, len(ids)))
                floor = np.array([best[j][1][-1] if len(best[j][1]) == k else -np.inf for j in some])
                for j, (v, s) in zip(some, block.search(slice(a, some.stop), ids[a : some.stop], floor, k), strict=True):
                    v, s = np.r_[best[j][0], v], np.r_[best[j][1], s]
                    top = np.lexsort((v, -s))[:k]
                    best[j] = v[top], s[top]

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= ROWS:
                search()
                rows = 0
        if rows:
            search()
        many = [len(v) for v, _ in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, many)), pa.array(np.concatenate([v for v, _ in best])), pa.array(np.concatenate([s for _, s in best]))], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: of all ``vectors`` (id, v) the k of largest integer inner product for each row of ``queries`` (id, v)."""
    spark = vectors.sparkSession
    small_batches(spark)

    def sound(df: DataFrame) -> DataFrame:
        df = df.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
        df = df.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
        return df.select("id", scaled(F.col("v"), scale).alias("v"))

    cand, asked = sound(vectors), sound(queries).groupBy("id").agg(F.min("v").alias("v"))
    schema = "query_id long, vec_id long, score long"
    total = asked.count()
    blocks = -(-total // block)
    if blocks > 1:
        asked = saved(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(2 * blocks)).cast("int")), "queries")
    path = f"{shared_dir(spark)}/" if blocks > 1 else ""
    parts = []
    for b in range(2 * blocks if blocks > 1 else 1):
        rows = (asked.where(F.col("block") == b) if blocks > 1 else asked).select("id", "v").toArrow()
        if not rows.num_rows:
            continue
        ids, dims = rows["id"].to_numpy(), max(map(len, rows["v"].to_pylist()))
        # components beyond a query's own length meet zeros
        found = cand.mapInArrow(_partial(ids, np.ascontiguousarray(_matrix(rows["v"].combine_chunks(), dims).T), k), schema)
        parts.append(saved(_ranked(found, k), "found") if path else found)
    if not parts:
        return _ranked(spark.createDataFrame([], schema), k)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out if path else _ranked(out, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
