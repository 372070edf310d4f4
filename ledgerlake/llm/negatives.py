"""Operator 11, hard negatives by a distributed kNN join over a Voronoi partition.

Vectors get one more component, so that the largest inner product is the least Euclidean distance (an anchor's is 0), and go
to the nearest of a few pivots. A cell is cut into RINGS rings of its distances and these into blocks; a block knows between
which distances from its pivot its rows lie. Anchors go to their nearest pivot, too; those of a cell form groups of at most
about GROUP. By the triangle inequality pivots and distances bound every score of a group (in a task: of an anchor) with a
block, and a block is replicated only to the groups with an anchor that it might serve. Groups and parts of about PART rows
meet in one task each, where scores are exact; the best of all parts are merged by a window.

Both joins, for positives and for negatives, have two rounds: the cell next to a group gives every anchor a first list, whose
last score is the bound that blocks must be able to reach in the second round, which reads all others. Bounds only spare work:
where vectors lie all over the sphere they spare next to none, and every group meets every block once.

Only pivots (taken from the SAMPLE rows of least hash), counts and ring bounds of cells, and groups' bounds pass through the
driver: at most PIVOTS cells, and one row for each group, PORTION groups at a time.

Scores are integers, computed exactly whatever the components' size; beyond the range of long they are its end. Rows with a
null vec_id or label, a null or empty vector, any null or non-finite component, or whose vector's length is not the
commonest one take no part; zero vectors do. A row that repeats is a row of its own, as anchor (its rows are returned again),
as positive and as negative; rows with the anchor's vec_id are none of its positives. An anchor without positives, or a
positive without a negative in its range, gives no row. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, save

GROUP, BLOCK, PART, RINGS = 16_384, 2_048, 65_536, 16
PIVOTS, SAMPLE, PORTION = (16, 1_024), 4_096, 100_000
POSITIVES, NEGATIVES = 5, 10
#: How far beyond a bound a score is still looked at, as a share of the largest possible one: rounding of distances.
SLACK = 1e-9
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
FOUND = "key long, t int, vec_id long, score long"


def whole(x: np.ndarray) -> np.ndarray:
    """Components as the smallest numbers that hold them; those beyond 32 bits stay doubles, which are integers, too."""
    top = float(np.abs(x).max(initial=0.0))
    return x.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.float64)


def pack(x: np.ndarray) -> bytes:
    """Components with their width in front."""
    return bytes([x.dtype.itemsize]) + np.ascontiguousarray(x).tobytes()


def unpack(b: bytes, d: int) -> np.ndarray:
    return np.frombuffer(b, {2: np.int16, 4: np.int32, 8: np.float64}[b[0]], offset=1).reshape(-1, d).astype(np.float64)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of integers, (rows of q, rows of x): exact in doubles where these hold every sum, else in Python's integers."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] < 1 << 53:
        return (q @ x.T).astype(np.int64)
    ints = lambda m: np.array([[int(c) for c in r] for r in m.tolist()], object).reshape(m.shape)
    most = (1 << 63) - 1  # its negative is a long, too
    return np.clip(ints(q).dot(ints(x).T), -most, most).astype(np.int64)


def pivots_of(x: np.ndarray, n: int, rounds: int = 4, seed: int = 11) -> np.ndarray:
    """At most n centres of x by Lloyd's rounds; a centre without rows is left out."""
    c = np.unique(x, axis=0)
    c = c[np.random.default_rng(seed).permutation(len(c))[:n]]
    for _ in range(rounds):
        near = nearest(x, c)[0]
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = total[count > 0] / count[count > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T))


def nearest(x: np.ndarray, c: np.ndarray, rows: int = 8_192) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and how far it is."""
    cell, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    for a in range(0, len(x), rows):
        d = distances(x[a : a + rows], c)
        cell[a : a + rows] = d.argmin(1)
        far[a : a + rows] = d.min(1)
    return cell, far


def augmented(x: np.ndarray, top: float, most: float, anchors: bool = False) -> np.ndarray:
    """Scaled rows with one more component: it brings data to length `most`, an anchor's is 0."""
    x = x / top
    tail = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(0.0, most * most - (x * x).sum(1)))
    return np.column_stack([x, tail])


def score_range(near, far, norm: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest scaled score of an anchor of length `norm` with rows between two distances from it."""
    s = most * most + norm * norm
    slack = SLACK * (s + 1)
    return (s - far * far) / 2 - slack, (s - near * near) / 2 + slack


def place_of(key) -> int:
    """A number of a group's key that is the same everywhere."""
    h = 0
    for k in key:
        h = (h * 1_000_003 + int(k.as_py()) + 12_345) & 0x7FFFFFFF
    return (h * 2_654_435_761 >> 8) & 0x7FFFFFFF


def mine(vectors: DataFrame, every: int = 100, relabel: int = 7, classes: int = 10, positives: int = POSITIVES, negatives: int = NEGATIVES, group: int = GROUP, block: int = BLOCK, part: int = PART, pivots: tuple[int, int] = PIVOTS, report: dict | None = None) -> DataFrame:
    """Hard negatives of the anchors, vec_id divisible by `every`; see the module. `report` gets how many (group, block) pairs each round kept, of how many."""
    spark = vectors.sparkSession
    prepare(spark)
    changed = F.when(F.col("vec_id") % relabel == 0, F.pmod(F.col("label").cast("long") + 1, F.lit(classes))).otherwise(F.col("label").cast("long"))
    v = vectors.select(F.col("vec_id").cast("long"), F.col("label"), F.col("embedding").cast("array<double>").alias("x")).where("vec_id is not null and label is not null and x is not null and size(x) > 0")
    v = v.where("forall(x, c -> c is not null and not isnan(c) and abs(256 * c) < double('infinity'))").select("vec_id", changed.alias("label"), "x")
    sizes = v.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("a"), F.max(F.array_max(F.transform("x", F.abs))).alias("top")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], OUT)
    d, n = sizes["d"], sizes["n"]
    top = max(256.0 * float(sizes["top"]), 1.0) + 1.0
    v = v.where(F.size("x") == d)
    size = lambda c: (F.abs(256.0 * c) + 1) / top  # noqa: E731  # at least that of the whole number below
    most = float(v.agg(F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + size(c) * size(c))))).first()[0])
    chosen = v.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(SAMPLE).select("x").toArrow()  # SAMPLE rows, whatever the table
    sample = np.floor(256.0 * np.array(chosen["x"].to_pylist(), float).reshape(-1, d))
    c = pivots_of(augmented(sample, top, most), max(pivots[0], min(pivots[1], math.ceil(sizes["a"] / group))))
    shared = spark.sparkContext.broadcast(c)  # at most PIVOTS rows

    def assign(batches):
        seen = 0
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("vec_id").to_numpy()
            x = np.floor(256.0 * b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
            cell, dist = nearest(augmented(x, top, most), shared.value)
            asked = ids % every == 0
            q_cell, q_dist = np.full(len(ids), -1), np.zeros(len(ids))
            if asked.any():
                q_cell[asked], q_dist[asked] = nearest(augmented(x[asked], top, most, True), shared.value)
            # rows are told apart by where they were read; what is written here is read from then on
            key = (TaskContext.get().partitionId() << 40) + seen + np.arange(len(ids))
            seen += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column("vec_id"), b.column("label"), pa.array([pack(whole(r)) for r in x], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(dist), pa.array(q_cell.astype(np.int32)), pa.array(q_dist)], names=["key", "vec_id", "label", "x", "cell", "dist", "q_cell", "q_dist"])

    rows = save(v.mapInArrow(assign, "key long, vec_id long, label long, x binary, cell int, dist double, q_cell int, q_dist double"), "cells")
    edges = [k / RINGS for k in range(1, RINGS)]
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("dist", edges, 1000).alias("edges"))
    many = cells.select("cell", "edges", F.greatest(F.lit(1), F.ceil(F.col("n") / (RINGS * block))).alias("slices"))
    deal = F.xxhash64("key")
    placed = rows.join(F.broadcast(many), "cell").select("vec_id", "label", "x", "dist", "cell", F.size(F.filter("edges", lambda e: e < F.col("dist"))).alias("ring"), F.pmod(deal, F.col("slices")).alias("slice"))  # at most PIVOTS cells
    parts = max(1, math.ceil(n / part))

    def blocks_of(key, t):
        x = np.concatenate([unpack(b, d) for b in t["x"].to_pylist()])
        dist = t["dist"].to_numpy()
        place = place_of(key) % parts
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([place], pa.int32()), "n": pa.array([len(x)], pa.int32()), "low": [float(dist.min())], "high": [float(dist.max())], "ids": pa.array([t["vec_id"].to_numpy().tobytes()], pa.binary()), "labels": pa.array([t["label"].to_numpy().tobytes()], pa.binary()), "x": pa.array([pack(whole(x))], pa.binary())})

    blocks = save(placed.groupBy("cell", "ring", "slice").applyInArrow(blocks_of, "cell int, part int, n int, low double, high double, ids binary, labels binary, x binary"), "blocks")
    per_cell = {r["q_cell"]: max(1, math.ceil(r["a"] / group)) for r in rows.where("q_cell >= 0").groupBy("q_cell").agg(F.count(F.lit(1)).alias("a")).collect()}  # a row for each cell
    if not per_cell:
        return spark.createDataFrame([], OUT)
    start, at = {}, 0
    for k in sorted(per_cell):
        start[k], at = at, at + per_cell[k]
    places = spark.createDataFrame([(k, start[k], per_cell[k]) for k in start], "q_cell int, first int, slices int")
    asked = rows.where("q_cell >= 0").join(F.broadcast(places), "q_cell")
    anchors = save(asked.select("key", "vec_id", "label", "x", "q_cell", "q_dist", (F.col("first") + F.pmod(deal, F.col("slices"))).cast("int").alias("group")), "anchors")
    filled = {r["cell"] for r in cells.select("cell").collect()}  # at most PIVOTS
    join = partial(_joined, blocks, parts, shared, filled, d, top, most, report)

    every_score = anchors.withColumn("t", F.lit(0)).withColumn("lo", F.lit(-(1 << 63) + 1)).withColumn("hi", F.lit((1 << 63) - 1))
    first = save(_best(join(every_score, positives, True, "near"), positives), "positives")
    reach = first.groupBy("key").agg(F.when(F.count(F.lit(1)) >= positives, F.min("score")).alias("least"))
    rest = join(every_score.join(reach, "key", "left").withColumn("lo", F.coalesce("least", "lo")).drop("least"), positives, True, "far")
    found = save(_best(first.drop("rank").unionByName(rest), positives), "positives")

    # 30 p <= 100 s <= 90 p, in integers without a product that could leave the range
    wanted = found.select("key", F.col("rank").alias("t"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).where("positive_score >= 0")
    wanted = wanted.withColumn("lo", F.expr("(positive_score div 10) * 3 + (3 * (positive_score % 10) + 9) div 10")).withColumn("hi", F.expr("(positive_score div 10) * 9 + (9 * (positive_score % 10)) div 10")).where("lo <= hi")
    ranges = anchors.join(wanted, "key")
    first = save(_best(join(ranges, negatives, False, "near"), negatives), "negatives")
    reach = first.groupBy("key", "t").agg(F.when(F.count(F.lit(1)) >= negatives, F.min("score")).alias("least"))
    rest = join(ranges.join(reach, ["key", "t"], "left").withColumn("lo", F.coalesce("least", "lo")).drop("least"), negatives, False, "far")
    last = _best(first.drop("rank").unionByName(rest), negatives)
    named = wanted.join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key").select("key", "t", "anchor_id", "positive_id", "positive_score")
    return last.join(named, ["key", "t"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("key", "t").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("*", rank).where(F.col("rank") <= k)


def _joined(blocks: DataFrame, parts: int, shared, filled: set[int], d: int, top: float, most: float, report: dict | None, targets: DataFrame, k: int, same: bool, which: str) -> DataFrame:
    """(key, t, vec_id, score): of each part the k best rows for each target, with a score from lo to hi and the anchor's label or another.

    `which`: "near" for the group's next cell that has rows, "far" for all other cells.
    """
    spark = blocks.sparkSession
    c, scale = shared.value, top * top
    between = distances(c, c)
    some = np.array(sorted(filled))
    groups = targets.groupBy("group").agg(F.first("q_cell").alias("cell"), F.min("q_dist").alias("near"), F.max("q_dist").alias("far"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    groups = save(groups, "groups")  # a row for each group
    numbers = [r[0] for r in groups.agg(F.max("group")).collect()]
    if numbers[0] is None:
        return spark.createDataFrame([], FOUND)
    out = None
    for a in range(0, numbers[0] + 1, PORTION):
        g = groups.where(F.col("group").between(a, a + PORTION - 1)).orderBy("group").toArrow()
        number, cell = g["group"].to_numpy(), g["cell"].to_numpy()
        home = some[between[cell][:, some].argmin(1)]
        bounds = spark.sparkContext.broadcast((number, cell, home, g["near"].to_numpy(), g["far"].to_numpy(), g["lo"].to_numpy() / scale, g["hi"].to_numpy() / scale))

        def replicate(batches, bounds=bounds, payload=True):
            number, cell, home, near, far, lo, hi = bounds.value
            between = distances(shared.value, shared.value)
            for b in batches:
                keep_row, keep_group = [], []
                for r, (own, low, high) in enumerate(zip(b.column("cell").to_pylist(), b.column("low").to_pylist(), b.column("high").to_pylist(), strict=True)):
                    if which == "near":
                        hit = home == own
                    else:
                        # an anchor lies at near..far from its pivot, so at some distance between these from the block's
                        gap = between[cell, own]
                        close = np.maximum(0.0, np.maximum(gap - far, near - gap))
                        away = gap + far
                        closest, farthest = np.maximum(0.0, np.maximum(close - high, low - away)), away + high
                        # the range of scores for the shortest and the longest anchor that a group may have
                        least = score_range(closest, farthest, np.zeros(1), most)[0]
                        best = score_range(closest, farthest, np.full(1, most), most)[1]
                        hit = (home != own) & (best >= lo) & (least <= hi)
                    keep_group.append(number[hit])
                    keep_row.append(np.full(int(hit.sum()), r))
                if not keep_row or not sum(map(len, keep_row)):
                    continue
                take, group = pa.array(np.concatenate(keep_row)), pa.array(np.concatenate(keep_group).astype(np.int32))
                step = 64 if payload else len(take)  # replicated blocks go on in small batches
                for s in range(0, len(take), step):
                    kept = b.take(take[s : s + step])
                    yield pa.RecordBatch.from_arrays([group[s : s + step], *kept.columns], names=["group", *b.schema.names])

        sent = blocks.mapInArrow(replicate, "group int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema))
        pairs = blocks.select("cell", "low", "high", "part").mapInArrow(partial(replicate, payload=False), "group int, cell int, low double, high double, part int")
        if report is not None:
            done, total = report.get(which, (0, 0))
            report[which] = (done + pairs.count(), total + len(number) * blocks.count())
        met = targets.join(pairs.select("group", "part").distinct(), "group")

        def cell_join(left, right):
            return _cell(left, right, shared.value, d, top, most, k, same)

        one = sent.groupBy("group", "part").cogroup(met.groupBy("group", "part")).applyInArrow(cell_join, FOUND)
        out = one if out is None else out.unionByName(one)
    return out


def _cell(left: pa.Table, right: pa.Table, c: np.ndarray, d: int, top: float, most: float, k: int, same: bool, step: int = 128) -> pa.Table:
    """The blocks of one part against the targets of one group."""
    keep: list[tuple[np.ndarray, ...]] = []
    if len(left) and len(right):
        right = right.sort_by([("key", "ascending"), ("t", "ascending")])
        key, first = np.unique(right["key"].to_numpy(), return_index=True)
        cut = np.append(first, len(right)).tolist()
        label, own = right["label"].to_numpy()[first], right["vec_id"].to_numpy()[first]
        t, lo, hi = right["t"].to_numpy(), right["lo"].to_numpy(), right["hi"].to_numpy()
        q = np.concatenate([unpack(right["x"][int(i)].as_py(), d) for i in first])
        least, largest = np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)
        q1 = augmented(q, top, most, True)
        norm, away = np.sqrt((q1 * q1).sum(1)), distances(q1, c)
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for b in left.to_pylist():
            dist = away[:, b["cell"]]
            low, high = score_range(np.maximum(0.0, np.maximum(dist - b["high"], b["low"] - dist)), dist + b["high"], norm, most)
            some = np.flatnonzero((high >= least / (top * top)) & (low <= largest / (top * top)))
            if not len(some):
                continue
            ids, labels, x = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["labels"], np.int64), unpack(b["x"], d)
            for a in range(0, len(some), step):
                chunk = some[a : a + step]
                for j, s in zip(chunk.tolist(), products(x, q[chunk]), strict=True):
                    may = (labels == label[j]) & (ids != own[j]) if same else labels != label[j]
                    may &= (s >= least[j]) & (s <= largest[j])
                    rows = np.flatnonzero(may)
                    if not len(rows):
                        continue
                    if cut[j + 1] - cut[j] == 1 and len(rows) > 4 * k:  # one range: only what may be among its best
                        s_rows = s[rows]
                        rows = rows[s_rows >= np.partition(s_rows, len(rows) - k)[len(rows) - k]]
                    rows = rows[np.lexsort((ids[rows], -s[rows]))]
                    down = -s[rows]
                    for i in range(cut[j], cut[j + 1]):
                        x0, x1 = np.searchsorted(down, -hi[i]), np.searchsorted(down, -lo[i], "right")
                        x1 = min(x1, x0 + k)
                        if x1 > x0:
                            new = (ids[rows[x0:x1]], -down[x0:x1])
                            if i in best:
                                new = tuple(map(np.concatenate, zip(best[i], new, strict=True)))
                                order = np.lexsort((new[0], -new[1]))[:k]
                                new = (new[0][order], new[1][order])
                            best[i] = new
        place = np.repeat(np.arange(len(key)), np.diff(cut))
        keep = [(np.full(len(i), key[place[r]]), np.full(len(i), t[r]), i, s) for r, (i, s) in best.items()]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
    columns = [np.concatenate(x) for x in zip(*keep, strict=True)] if keep else [[]] * 4
    return pa.table({n: pa.array(x, k) for n, x, k in zip(("key", "t", "vec_id", "score"), columns, kinds, strict=True)})


ORACLE = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: CAST(floor(256 * c::DOUBLE) AS BIGINT)) AS x FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10"""
