"""Operator 1, nearest neighbours by query-centred collision counting.

Vectors get one more component so that the largest inner product is the least Euclidean distance, and lie in blocks of
about BLOCK rows. A block keeps PROJECTIONS sorted arrays, one for each random line. For a query a window around its own
projection opens on every line and widens by a constant factor (virtual rehashing: no array is rebuilt, a window is a range
of places in it, and a query begins at the width that served the one before); a vector that lies in the windows of at least
ALPHA of the lines is a candidate. Widening ends at a width that gives k + BETA * rows candidates or more, all of which are verified on the
original vectors in double precision; there is no cap on them. Each block gives its k best, and the k best of all blocks
are the answer. A stated set of queries, in chunks, meets each block of vectors in one task; nothing is broadcast.

A score is the sum of the products in the order of components, so equal vectors have equal scores wherever they lie, and
ties go to the smaller vec_id. Vectors are scaled by the largest component before they are projected, so any finite values
do; a score beyond the range of doubles is infinite.

Vectors that are null or zero, hold a null, NaN or infinite component, or whose length is not the commonest one take no
part; nor do rows with a null vec_id. Rows that share a vec_id are separate candidates, but never answer a query of their
own vec_id; queries that share a vec_id are one by one, each with its own ranks only if their vectors are equal too. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, save

BLOCK, QUERY_BLOCK = 16_384, 1_024
PROJECTIONS, ALPHA, BETA, WIDEN = 64, 0.85, 0.15, 1.25


def inner_products(columns: np.ndarray, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of some rows with q; `columns` has a row for each component. Every sum runs in the order of components."""
    out = np.zeros(len(rows))
    with np.errstate(over="ignore", invalid="ignore"):
        for c, v in zip(columns, q.tolist(), strict=True):
            out += c[rows] * v
    return out


class BlockIndex:
    """Sorted projections of the rows of x, which are scaled so that no component exceeds 1; `most` is the largest length of all blocks."""

    def __init__(self, x: np.ndarray, most: float, projections: int = PROJECTIONS, seed: int = 7):
        d = x.shape[1]
        self.lines = np.random.default_rng(seed).standard_normal((d + 1, projections)).astype(np.float32)
        tail = np.sqrt(np.maximum(0.0, most * most - np.einsum("ij,ij->i", x, x)))
        p = (x.astype(np.float32) @ self.lines[:d] + tail[:, None].astype(np.float32) * self.lines[d]).T
        order = np.argsort(p, axis=1, kind="stable")
        self.sorted = np.take_along_axis(p, order, 1)
        # where each row stands in each sorted array: a window of an array is a range of these
        self.place = np.empty(p.shape, np.uint16 if len(x) <= 65_536 else np.uint32)
        np.put_along_axis(self.place, order, np.arange(len(x), dtype=self.place.dtype)[None, :], 1)
        self.most = most

    def collisions(self, q: np.ndarray, width: float) -> np.ndarray:
        """On how many lines each row lies within `width` of the projected query."""
        kind = self.place.dtype.type
        a = np.array([s.searchsorted(v) for s, v in zip(self.sorted, q - np.float32(width), strict=True)])
        b = np.array([s.searchsorted(v, "right") for s, v in zip(self.sorted, q + np.float32(width), strict=True)])
        # unsigned: a place before the window wraps to a large number
        inside = (self.place - a.astype(kind)[:, None]) < (b - a).clip(0, np.iinfo(kind).max).astype(kind)[:, None]
        return np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint16)

    def candidates(self, q: np.ndarray, k: int, alpha: float = ALPHA, beta: float = BETA, widen: float = WIDEN):
        """(number of the query, rows that collide on enough lines), in the order of how narrow the queries start."""
        lines, n = self.place.shape
        enough, least = min(n, k + math.ceil(beta * n)), math.ceil(alpha * lines)
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        qp = (q / norm * self.most).astype(np.float32) @ self.lines[:-1]
        reach = min(n, max(2 * k, n // 200)) // 2
        at = np.stack([np.searchsorted(self.sorted[p], qp[:, p]) for p in range(lines)])
        wide = np.take_along_axis(self.sorted, np.minimum(at + reach, n - 1), 1) - np.take_along_axis(self.sorted, np.maximum(at - reach, 0), 1)
        start = np.maximum(np.median(wide, axis=0) / 2, 1e-9)
        width, before = None, 0.0
        for j in np.argsort(start, kind="stable").tolist():
            # begin where the last query ended if that one started alike
            width = float(start[j]) if width is None or start[j] > 1.2 * before else width
            before = float(start[j])
            found = self.collisions(qp[j], width) >= least
            if int(found.sum()) < enough:
                while int(found.sum()) < enough:
                    width *= widen
                    found = self.collisions(qp[j], width) >= least
            else:
                while int(found.sum()) > 2 * enough and width > start[j]:
                    less = self.collisions(qp[j], width / widen) >= least
                    if int(less.sum()) < enough:
                        break
                    width, found = width / widen, less
            yield j, np.flatnonzero(found)


def search(vectors: DataFrame, k: int = 20, every: int = 20, block: int = BLOCK, query_block: int = QUERY_BLOCK, **tuning) -> DataFrame:
    """query_id, rank, vec_id, score for queries whose vec_id is divisible by `every`."""
    prepare(vectors.sparkSession)
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x")).where("vec_id is not null and x is not null and size(x) > 0")
    v = v.where("forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity')) and exists(x, c -> c <> 0)")
    v = save(v.withColumn("d", F.size("x")).withColumn("top", F.array_max(F.transform("x", F.abs))), "vectors")
    sizes = v.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"), F.max("top").alias("top")).orderBy(F.desc("n"), "d").first()
    out = "query_id long, vec_id long, score double"
    if sizes is None:
        return v.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, top = sizes["d"], float(sizes["top"])
    v = v.where(F.col("d") == d).select("vec_id", "x")
    most = float(v.agg(F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + (c / top) * (c / top))))).first()[0])
    blocks, chunks = max(1, math.ceil(sizes["n"] / block)), max(1, math.ceil(sizes["q"] / query_block))
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", "x", F.lit(seed)), F.lit(n)).cast("int")
    # by number in the table just written, so that rows that repeat are dealt out, too
    row = F.xxhash64("vec_id", F.monotonically_increasing_id())
    data = v.withColumn("block", F.pmod(row, F.lit(blocks)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = v.where(F.col("vec_id") % every == 0).withColumn("chunk", deal(chunks, 2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def cell(left, right):
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return empty
        matrix = lambda t: t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), d)
        ids, x, q_ids, q = left["vec_id"].to_numpy(), matrix(left), right["vec_id"].to_numpy(), matrix(right)
        columns = np.ascontiguousarray(x.T)
        found = []
        for j, rows in BlockIndex(x / top, most, tuning.get("projections", PROJECTIONS)).candidates(q / top, k + int((ids == q_ids[:, None]).sum(1).max()), tuning.get("alpha", ALPHA), tuning.get("beta", BETA), tuning.get("widen", WIDEN)):
            rows = rows[ids[rows] != q_ids[j]]
            score = inner_products(columns, rows, q[j])
            best = np.lexsort((ids[rows], -score))[:k]
            found.append((np.full(len(best), q_ids[j]), ids[rows[best]], score[best]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True))) if found else empty

    best = data.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInArrow(cell, out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return best.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)
