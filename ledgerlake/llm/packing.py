"""Operator 4, packing by minimum bin slack.

Each document is cut into full windows and one remainder. Only how many remainders have each length (fewer than `size`
numbers, whatever the corpus) reaches the planner. It takes the longest remainder left, finds by a bitset of reachable
sums which other lengths bring the window closest to full, traces back how many of each, and repeats that choice as
often as the counts allow. Where no choice fills the window, one more remainder is cut to fill the slack and what is
left of it goes back. Documents then find their places by their rank among the remainders of their length.

A null or empty text is its end id alone. A null doc_id is packed like any other. Rows that share a doc_id are separate
documents. Other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import prefix_sums, prepare, save
from .encode import pieces

SIZE = 1024


def fullest(counts: dict[int, int], capacity: int) -> tuple[int, dict[int, int]]:
    """The largest sum of lengths that is at most capacity, and how many of each length give it."""
    bits, mask, trail = 1, (1 << (capacity + 1)) - 1, []
    for v in sorted(counts, key=lambda v: (-counts[v], v)):
        if v > capacity:
            continue
        trail.append((v, bits))
        for _ in range(min(counts[v], capacity // v)):
            more = bits | (bits << v) & mask
            if more == bits:
                break
            bits = more
        if bits >> capacity & 1:
            break
    best = left = bits.bit_length() - 1
    taken: dict[int, int] = {}
    for v, before in reversed(trail):
        while not before >> left & 1:
            left -= v
            taken[v] = taken.get(v, 0) + 1
    return best, taken


class Plan:
    """Places of remainders: rows (length, first rank, end rank, cut from, cut length, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], size: int = SIZE):
        self.rows: list[tuple[int, int, int, int, int, int, int]] = []
        self.sequences = 0
        self.left = {v: [(v, 0, 0, n)] for v, n in counts.items() if n}  # length: (origin, cut from, first rank, end rank)
        self.count = {v: n for v, n in counts.items() if n}
        while self.count:
            self._step(size)

    def _take(self, v: int, n: int, use: int, offset: int) -> None:
        """Place the first `use` ids of n items of length v, one in each of the next n sequences."""
        self.count[v] -= n
        at, rest = self.sequences, []
        while n:
            origin, cut, a, b = self.left[v].pop()
            k = min(n, b - a)
            self.rows.append((origin, a, a + k, cut, use, at, offset))
            if k < b - a:
                self.left[v].append((origin, cut, a + k, b))
            if use < v:
                rest.append((origin, cut + use, a, a + k))
            n, at = n - k, at + k
        if not self.count[v]:
            del self.count[v], self.left[v]
        for x in rest:
            self.left.setdefault(v - use, []).append(x)
            self.count[v - use] = self.count.get(v - use, 0) + x[3] - x[2]

    def _step(self, size: int) -> None:
        top = max(self.count)
        others = dict(self.count)
        others[top] -= 1
        best, taken = fullest({v: n for v, n in others.items() if n}, size - top)
        taken[top] = taken.get(top, 0) + 1
        slack = size - top - best
        times = min(self.count[v] // c for v, c in taken.items())
        cut = 0
        if slack:
            open_ = [v for v, n in self.count.items() if v > slack and n > taken.get(v, 0)]
            if open_:
                cut = max(open_, key=lambda v: (self.count[v] // (taken.get(v, 0) + 1), v))
                times = min(times, self.count[cut] // (taken.get(cut, 0) + 1))
        offset = 0
        for v, c in sorted(taken.items()):
            for _ in range(c):
                self._take(v, times, v, offset)
                offset += v
        if cut:
            self._take(cut, times, slack, offset)
        self.sequences += times

    def by_length(self) -> dict[int, np.ndarray]:
        out: dict[int, list] = {}
        for length, *row in self.rows:
            out.setdefault(length, []).append(row)
        return {v: np.array(x, np.int64) for v, x in out.items()}


def pack(docs: DataFrame, path: str, end_id: int = 0, size: int = SIZE) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of docs(doc_id, text)."""
    spark = docs.sparkSession
    prepare(spark)

    def cut(batches):
        coder, part = pieces(path), TaskContext.get().partitionId()
        seen, windows = [0] * size, 0
        end = np.array([end_id], np.uint32).tobytes()
        for batch in batches:
            n, full, rest, rank, before = [], [], [], [], []
            for a, b, all_ids, at in coder.column(T.rows_with(batch, "text")):
                at = at.tolist()
                for k in range(b - a):
                    data = all_ids[at[k] : at[k + 1]].tobytes() + end
                    n.append(len(data) // 4)
                    q, r = divmod(n[-1], size)
                    full.append([zlib.crc32(data[4 * size * j : 4 * size * (j + 1)]) for j in range(q)])
                    ids = np.frombuffer(data, np.uint32, r, 4 * size * q)
                    rest.append((ids.astype("<u2") if r == 0 or ids.max() < 65536 else ids).tobytes())
                    rank.append(seen[r])
                    before.append(windows)
                    seen[r] += 1
                    windows += q
            yield pa.record_batch(
                [pa.array([part] * len(n), pa.int32()), T.rows_with(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(rest, pa.binary()), pa.array(rank, pa.int64()), pa.array(before, pa.int64())],
                names=["part", "doc_id", "n", "full", "rest", "rank", "before"],
            )

    cuts = save(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "part int, doc_id long, n long, full array<long>, rest binary, rank long, before long"), "cuts")
    cuts = cuts.withColumn("r", F.col("n") % size)
    # fewer than `size` lengths a part
    held = cuts.groupBy("part", "r").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("full")).alias("windows"))
    ranks = prefix_sums(held.select("part", "r", "docs"), "part", "docs", "r_before", ["r"]).select("part", "r", "r_before")
    bases = prefix_sums(held.groupBy("part").agg(F.sum("windows").alias("w")), "part", "w", "w_before").select("part", "w_before")
    counts = {x["r"]: x["docs"] for x in held.groupBy("r").agg(F.sum("docs").alias("docs"), F.sum("windows").alias("w")).collect()}
    windows = held.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    counts.pop(0, None)
    plan = spark.sparkContext.broadcast(Plan(counts, size).by_length())

    def place(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            doc_ids = T.rows_with(batch, "doc_id").to_pylist()
            for k, (n, r, rest, rank) in enumerate(zip(*(T.rows_with(batch, c).to_pylist() for c in ("n", "r", "rest", "rank")), strict=True)):
                if not r:
                    continue
                rows = plan.value[r]
                ids = np.frombuffer(rest, "<u2" if len(rest) == 2 * r else "<u4").astype("<u4")
                for a, _, c, use, seq, offset in rows[(rows[:, 0] <= rank) & (rank < rows[:, 1])].tolist():
                    for x, v in zip(out, (doc_ids[k], n - r + c, use, zlib.crc32(ids[c : c + use]), n, windows + seq + rank - a, offset), strict=True):
                        x.append(v)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    whole = (
        cuts.where(F.size("full") > 0)
        .join(F.broadcast(bases), "part")
        .select("doc_id", "n", (F.col("w_before") + F.col("before")).alias("b"), F.posexplode("full").alias("k", "ids_crc32"))
        .select("doc_id", (F.col("k") * F.lit(size)).cast("long").alias("start"), F.lit(size).cast("long").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"), (F.col("b") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    )
    ranked = cuts.where("r > 0").join(ranks, ["part", "r"]).select("doc_id", "n", "r", "rest", (F.col("rank") + F.col("r_before")).alias("rank"))
    return whole.unionByName(ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))
