"""Operator 12, quality by a generalised additive model with pairwise interactions.

FEATURES of a whole text (sizes, shares of kinds of bytes and words, repetition, and the worst of its segments of SEGMENT
words) are computed once, in batches. Training bins each by quantiles and boosts shallow trees in cycles, one feature after
the other: every tree adds to the feature's lookup table, so the table is all that is left of the trees. The PAIRS pairs of
features that reduce the rest most then get tables of their own, coarse in both. The score of a text is the logistic
function of an intercept and one addition for each table.

Training takes the SAMPLE labelled rows with the least hash, spread over both labels as they come; only their features reach
the driver. All rows are scored. Features come from a text and from nothing else.

Null and empty texts are texts without words. Null labels are not learnt from; where rows of labels share a doc_id the smaller label
counts. Rows that repeat are learnt from once and scored alike; rows that share a doc_id are scored one by one. Null doc_ids are not held
out and are scored. If the sample lacks either label, all scores are the share of label 1 in it (0.5 without any). An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import id_crc, prepare, save

SAMPLE, THRESHOLD = 20_000, 0.7
SEGMENT = 64
BINS, COARSE, PAIRS = 64, 12, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, LEAST = 150, 60, 0.1, 4, 20

FEATURES = [
    "log_words", "word_bytes", "upper", "digit", "stop", "symbol", "other_bytes", "distinct_words", "repeats_last", "longest_run", "short_words", "long_words", "marked_words", "alone_marks",
    "line_words", "distinct_lines", "worst_symbol", "worst_upper", "worst_repeats", "worst_marked", "worst_distinct",
]

# kinds of bytes: 0 other, 1 lower-case, 2 upper-case, 3 digit, 4 full stops and commas, 5 other marks of ASCII, 6 beyond ASCII
_KIND = np.zeros(256, np.int64)
_KIND[0x21:0x7F] = 5
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[0x2C, 0x2E]] = 4
_KIND[0x80:] = 6


def _per_row(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(value, dtype=np.float64))
    return total[at[1:]] - total[at[:-1]]


def _distinct(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """How many distinct hashes each row has."""
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    return np.bincount(r[new], minlength=rows).astype(float)


def _ratio(a, b):
    return a / np.maximum(b, 1)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, FEATURES) of the texts in a buffer."""
    rows = len(offsets) - 1
    low, s, e, at = T.words(data, offsets)
    n = np.diff(at).astype(float)
    row = np.repeat(np.arange(rows), np.diff(at))
    kind = _KIND[data]
    size = np.diff(offsets).astype(float)
    kinds = np.stack([_per_row(kind == k, offsets) for k in range(7)])
    seen = kinds[1:].sum(0)
    counts = np.stack([np.append(0, np.cumsum(kind == k)) for k in range(7)])  # up to each byte
    inside = counts[:, e] - counts[:, s]
    length = (e - s).astype(float)
    h = T.hashes(low, s, e)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    # runs of a word and itself
    start = np.flatnonzero(~same)
    run = np.diff(np.append(start, len(h)))
    longest = np.zeros(rows)
    if len(start):
        np.maximum.at(longest, row[start], run)
    marked = inside[5] > 0
    alone = marked & (inside[5] == length)
    line = np.append(0, np.cumsum(data == 10))
    lines = line[offsets[1:]] - line[offsets[:-1]] + 1.0
    # a line is known by the sum of its words' hashes by place
    line_of = line[s] if len(s) else np.zeros(0, np.int64)
    first = np.ones(len(s), bool)
    first[1:] = (line_of[1:] != line_of[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(first)
    filled = np.bincount(row[begin], minlength=rows).astype(float)
    place = np.arange(len(s)) - np.repeat(begin, np.diff(np.append(begin, len(s))))
    mixed = np.add.reduceat(T.mix(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), begin) if len(begin) else np.zeros(0, np.uint64)
    # segments of words: the worst of each text
    segment = np.arange(len(s)) - at[row] if len(s) else np.zeros(0, np.int64)
    opens = np.flatnonzero(segment % SEGMENT == 0)
    seg_row, seg_n = row[opens], np.diff(np.append(opens, len(s))).astype(float)
    by = lambda v: np.add.reduceat(v.astype(float), opens) if len(opens) else np.zeros(0)
    seg_of = np.repeat(np.arange(len(opens)), np.diff(np.append(opens, len(s))))
    enough = seg_n >= np.minimum(SEGMENT / 2, n[seg_row])  # the rest at a text's end may be too short to tell

    def worst(v, least=False):
        out = np.zeros(rows) if not least else np.where(n > 0, 1.0, 0.0)
        (np.minimum if least else np.maximum).at(out, seg_row[enough], v[enough])
        return out

    seg_bytes = by(length)
    return np.column_stack([
        np.log1p(n), _ratio(_per_row(length, at), n), _ratio(kinds[2], kinds[1] + kinds[2]), _ratio(kinds[3], seen), _ratio(kinds[4], n), _ratio(kinds[5], seen), _ratio(kinds[6], seen),
        _ratio(_distinct(row, h, rows), n), _ratio(_per_row(same, at), n), np.log1p(longest), _ratio(_per_row(length <= 3, at), n), _ratio(_per_row(length > 20, at), n), _ratio(_per_row(marked, at), n), _ratio(_per_row(alone, at), n),
        np.log1p(_ratio(n, lines)), _ratio(_distinct(row[begin], mixed, rows), filled), worst(_ratio(by(inside[5]), seg_bytes)), worst(_ratio(by(inside[2]), by(inside[1] + inside[2]))), worst(_ratio(by(same), seg_n)), worst(_ratio(by(marked), seg_n)), worst(_ratio(_distinct(seg_of, h, len(opens)), seg_n), True),
    ])


def edges_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Inner bounds of at most `bins` bins of each column, at its quantiles; equal values share a bin."""
    return [np.unique(np.quantile(c, np.arange(1, bins) / bins, method="inverted_cdf")) for c in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = LEAVES, least: int = LEAST, ridge: float = 1.0) -> np.ndarray:
    """The value of a tree with at most `leaves` leaves in each bin, from sums of gradients, curvatures and rows by bin."""
    cut = [0, len(g)]
    cg, ch, cn = (np.append(0.0, np.cumsum(v)) for v in (g, h, n))
    for _ in range(leaves - 1):
        best, where = 1e-9, None
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            k = np.arange(a + 1, b)
            k = k[(cn[k] - cn[a] >= least) & (cn[b] - cn[k] >= least)]
            if len(k):
                gain = (cg[k] - cg[a]) ** 2 / (ch[k] - ch[a] + ridge) + (cg[b] - cg[k]) ** 2 / (ch[b] - ch[k] + ridge) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
                if gain.max() > best:
                    best, where = float(gain.max()), int(k[gain.argmax()])
        if where is None:
            break
        cut = sorted([*cut, where])
    out = np.zeros(len(g))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _split_pair(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """The best tree that cuts one feature once and then each side of the other one once; its values by cell, and its gain."""
    best, out = 0.0, np.zeros_like(g)
    for flip in (False, True):
        cg, ch = (np.cumsum(v.T if flip else v, axis=0) for v in (g, h))
        for k in range(len(cg) - 1):
            value, gain = np.zeros(cg.shape), -cg[-1].sum() ** 2 / (ch[-1].sum() + ridge)
            for a, b, x, y in ((0, k + 1, cg[k], ch[k]), (k + 1, len(cg), cg[-1] - cg[k], ch[-1] - ch[k])):
                lx, ly = np.cumsum(x)[:-1], np.cumsum(y)[:-1]
                one = lx**2 / (ly + ridge) + (x.sum() - lx) ** 2 / (y.sum() - ly + ridge)
                m = int(one.argmax())
                gain += one[m]
                value[a:b, : m + 1] = -lx[m] / (ly[m] + ridge)
                value[a:b, m + 1 :] = -(x.sum() - lx[m]) / (y.sum() - ly[m] + ridge)
            if gain > best:
                best, out = gain, value.T.copy() if flip else value
    return out, best


class Model:
    """An intercept, a table for each feature and one for each pair."""

    def __init__(self, base: float, edges: list[np.ndarray], coarse: list[np.ndarray]):
        self.base, self.edges, self.coarse = base, edges, coarse
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(x):
            return out
        b = binned(x, self.edges)
        for k, t in enumerate(self.tables):
            out += t[b[:, k]]
        if self.pairs:
            c = binned(x, self.coarse)
            for (i, j), t in self.pairs.items():
                out += t[c[:, i], c[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x).clip(-30, 30)))


def _slopes(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-raw))
    return p - y, np.maximum(p * (1 - p), 1e-6)


def train(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS, rate: float = RATE) -> Model:
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Model(base if len(y) else 0.0, [np.zeros(0)] * x.shape[1], [np.zeros(0)] * x.shape[1])
    m = Model(base, edges_of(x, BINS), edges_of(x, COARSE))
    b, c, raw = binned(x, m.edges), binned(x, m.coarse), np.full(len(y), base)
    rows = [np.bincount(b[:, k], minlength=len(t)).astype(float) for k, t in enumerate(m.tables)]
    for _ in range(rounds):
        for k, t in enumerate(m.tables):
            if len(t) < 2:
                continue
            g, h = _slopes(raw, y)
            step = rate * _split(np.bincount(b[:, k], g, len(t)), np.bincount(b[:, k], h, len(t)), rows[k])
            t += step
            raw += step[b[:, k]]
    g, h = _slopes(raw, y)
    gains = {}
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            gains[i, j] = _split_pair(*_cells(c, i, j, m, g, h))[1]
    for ij in sorted(gains, key=lambda p: (-gains[p], p))[:pairs]:
        m.pairs[ij] = np.zeros((len(m.coarse[ij[0]]) + 1, len(m.coarse[ij[1]]) + 1))
    for _ in range(pair_rounds):
        for (i, j), t in m.pairs.items():
            g, h = _slopes(raw, y)
            step = rate * _split_pair(*_cells(c, i, j, m, g, h), ridge=5.0)[0]
            t += step
            raw += step[c[:, i], c[:, j]]
    # tables average nothing over the sample; the intercept has what they had
    for k, t in enumerate(m.tables):
        mean = float(t[b[:, k]].mean())
        t -= mean
        m.base += mean
    return m


def _cells(c: np.ndarray, i: int, j: int, m: Model, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = len(m.coarse[j]) + 1
    shape = (len(m.coarse[i]) + 1, wide)
    code = c[:, i] * wide + c[:, j]
    return np.bincount(code, g, shape[0] * wide).reshape(shape), np.bincount(code, h, shape[0] * wide).reshape(shape)


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of docs(doc_id, text), one row for each."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, offsets = T.buffers(batch.column(1))
            x = np.concatenate([features(d, o) for _, _, d, o in T.chunks(data, offsets)]) if batch.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))], names=["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, features array<double>")


def fit(rows: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, sample: int = SAMPLE) -> Model:
    """The model of at most `sample` rows(doc_id, features) with a label whose crc32(doc_id) mod `modulus` is not `held`."""
    y = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y is not null").where(id_crc("doc_id") % modulus != held).groupBy("doc_id").agg(F.min("y").alias("y"))
    chosen = rows.join(y, "doc_id").select("doc_id", "features", "y").distinct().orderBy(F.xxhash64("doc_id", "features"), "doc_id").limit(sample).toArrow()
    x = chosen["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return train(x, (chosen["y"].to_numpy() > 0).astype(float))


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of docs(doc_id, text)."""
    rows = save(described(docs), "features")
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, modulus, held, sample))  # a few tables

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(x), pa.float64())], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(id_crc("doc_id") % modulus == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
