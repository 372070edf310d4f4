"""Operator 7, toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A step of the network is a word: the embedding of its hash (word input) and the sum of the embeddings of its character
trigrams with boundaries (character input). Two gated recurrent layers read each window of WINDOW words in both
directions, attention pools the states and a logistic unit scores the window. Windows start every STRIDE words and cover
the whole text, whatever its length; the score of a text is that of its worst window.

Training takes a bounded sample: the SAMPLE rows of either label with the least hash of doc_id among the rows that may
be learnt from, whole texts of any length. These stay on the executors, which count in how many of them each feature is;
embeddings start from the log odds of a feature between the two labels. Of each text the TOP windows with the largest log
odds go to the driver, and OTHERS more of a clean one (windows of more than MOST_BYTES are not learnt from); each round
trains on the window that now scores highest of each text and on another one of each clean text.

Null and empty texts score 0. Null labels are not learnt from; where rows of labels share a doc_id the larger label
counts. Null doc_ids are not held out and are scored. If the sample lacks either label, all scores are 0. Other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import textops as T
from .common import give_back, id_crc, prepare, save

SAMPLE, WINDOW, STRIDE = 1_200, 64, 32
#: Bounds of what is learnt from: windows of a text, and bytes of a window.
TOP, OTHERS, MOST_BYTES = 3, 2, 8_192
WORDS, GRAMS, DW, DC, H = 1 << 17, 1 << 15, 4, 6, 8
THRESHOLD, LEAST, STEPS, DROP = 0.3, 4, 240, 0.3


def word_inputs(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct word: bucket, its trigram buckets and their offsets; and the distinct word of each word."""
    h = T.hashes(low, starts, ends)
    u, first, back = np.unique(h, return_index=True, return_inverse=True)
    s, n = starts[first], ends[first] - starts[first]
    at = np.concatenate(([0], np.cumsum(n)))
    pos = np.arange(at[-1]) - np.repeat(at[:-1] - s, n)
    mid = low[pos].astype(np.uint32)
    left, right = np.empty_like(mid), np.empty_like(mid)
    left[1:], right[:-1] = mid[:-1], mid[1:]
    left[at[:-1]], right[at[1:] - 1] = 1, 2
    code = (left << np.uint32(16)) | (mid << np.uint32(8)) | right
    return (u >> np.uint64(64 - 17)).astype(np.int32), ((code * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int32), at, back


def windows(at: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, length) of each window; a text without words has none."""
    n = np.diff(at)
    count = np.where(n == 0, 0, np.maximum(0, -(-(n - window) // stride)) + 1)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    first = at[row] + k * stride
    return row, first, np.minimum(window, at[row + 1] - first)


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) * 0.3 / np.sqrt(s[0])).astype(np.float32)
        z = lambda *s: np.zeros(s, np.float32)
        self.p = {"word": z(WORDS, DW), "gram": z(GRAMS, DC), "u": f(2 * H), "w": f(2 * H), "c": z(1)}
        for side in "fb":
            self.p |= {f"W{side}": f(DW + DC, 3 * H) * 3, f"U{side}": f(H, 3 * H), f"b{side}": z(3 * H)}
        self.p["word"][:, 1:] = r.standard_normal((WORDS, DW - 1)) * 0.05
        self.p["gram"][:, 1:] = r.standard_normal((GRAMS, DC - 1)) * 0.05

    def inputs(self, bucket, gram, at) -> np.ndarray:
        n = np.diff(at)
        x = np.empty((len(bucket), DW + DC), np.float32)
        x[:, :DW] = self.p["word"][bucket]
        if len(bucket):
            x[:, DW:] = np.add.reduceat(self.p["gram"][gram], at[:-1], axis=0) / np.sqrt(n)[:, None]
        return x

    def _pass(self, side: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """x: (steps, windows, 3H), projected inputs in reading order; mask 0 keeps the state."""
        steps, n, _ = x.shape
        U = self.p[f"U{side}"]
        h = np.zeros((n, H), np.float32)
        out = np.empty((steps, n, H), np.float32)
        for t in range(steps):
            g = h @ U
            zr = x[t, :, : 2 * H] + g[:, : 2 * H]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            c = np.tanh(x[t, :, 2 * H :] + zr[:, H:] * g[:, 2 * H :])
            m = mask[t][:, None]
            if keep is not None:
                keep.append((h, zr, g[:, 2 * H :], c))
            h = h + m * (1 - zr[:, :H]) * (c - h)
            out[t] = h
        return out

    def forward(self, x: np.ndarray, index: np.ndarray, length: np.ndarray, train: bool = False):
        """Logits of windows; index (steps, windows) into rows of x."""
        steps = index.shape[0]
        mask = (np.arange(steps)[:, None] < length[None, :]).astype(np.float32)
        kept: dict = {"f": [], "b": []} if train else {"f": None, "b": None}
        states = []
        for side in "fb":
            projected = x @ self.p[f"W{side}"] + self.p[f"b{side}"]
            at = index if side == "f" else index[::-1]
            m = mask if side == "f" else mask[::-1]
            s = self._pass(side, projected[at], m, kept[side])
            states.append(s if side == "f" else s[::-1])
        h = np.concatenate(states, 2)
        a = h @ self.p["u"] + (mask - 1) * 1e4
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnh->nh", a, h)
        logit = pooled @ self.p["w"] + self.p["c"][0]
        return (logit, (mask, kept, h, a, pooled)) if train else logit

    def gradients(self, x, index, length, target):
        logit, (mask, kept, h, a, pooled) = self.forward(x, index, length, True)
        n = len(target)
        d = ((_sig(logit) - target) / n).astype(np.float32)
        g = {"w": pooled.T @ d, "c": np.array([d.sum()], np.float32)}
        dp = d[:, None] * self.p["w"][None, :]
        da = np.einsum("nh,tnh->tn", dp, h)
        ds = a * (da - (a * da).sum(0))
        g["u"] = np.einsum("tn,tnh->h", ds, h)
        dh_all = a[:, :, None] * dp[None] + ds[:, :, None] * self.p["u"]
        dx = np.zeros_like(x)
        for side, part in (("f", dh_all[:, :, :H]), ("b", dh_all[::-1, :, H:])):
            U, at, m = self.p[f"U{side}"], index if side == "f" else index[::-1], mask if side == "f" else mask[::-1]
            dU, dh = np.zeros_like(U), np.zeros((n, H), np.float32)
            dproj = np.empty((len(at), n, 3 * H), np.float32)
            for t in range(len(at) - 1, -1, -1):
                h0, zr, gn, c = kept[side][t]
                dh = dh + part[t]
                step = dh * m[t][:, None]
                z, r = zr[:, :H], zr[:, H:]
                dc = step * (1 - z) * (1 - c * c)
                dz = step * (h0 - c) * z * (1 - z)
                dr = dc * gn * r * (1 - r)
                dproj[t] = np.concatenate([dz, dr, dc], 1)
                dg = np.concatenate([dz, dr, dc * r], 1)
                dU += h0.T @ dg
                dh = dh - step * (1 - z) + dg @ U.T
            flat = dproj.reshape(-1, 3 * H)
            g[f"U{side}"], g[f"b{side}"] = dU, flat.sum(0)
            rows = np.zeros((len(x), 3 * H), np.float32)
            np.add.at(rows, at.reshape(-1), flat)
            g[f"W{side}"] = x.T @ rows
            dx += rows @ self.p[f"W{side}"].T
        return g, dx, float(np.mean(np.logaddexp(0, logit) - target * logit))


def _step_index(first: np.ndarray, length: np.ndarray, back: np.ndarray) -> np.ndarray:
    steps = int(length.max())
    return back[first[None, :] + np.minimum(np.arange(steps)[:, None], length[None, :] - 1)]


def feature_counts(batches):
    """(feature, n1, n0) of batches(text, y): texts of either label that hold each word bucket, or gram bucket (from WORDS on)."""
    sums = np.zeros((2, WORDS + GRAMS), np.int64)
    for batch in batches:
        data, offsets = T.buffers(T.rows_with(batch, "text"))
        label = T.rows_with(batch, "y").to_numpy(zero_copy_only=False) > 0
        for a, b, d, o in T.chunks(data, offsets):
            low, s, e, at = T.words(d, o)
            if not len(s):
                continue
            bucket, gram, gram_at, back = word_inputs(low, s, e)
            pairs = np.unique(np.repeat(np.arange(b - a), np.diff(at)) * len(bucket) + back)
            row, word = pairs // len(bucket), pairs % len(bucket)
            n = np.diff(gram_at)[word]
            own = gram[np.arange(n.sum()) + np.repeat(gram_at[word] - np.cumsum(n) + n, n)]
            for rows, feature in ((row, bucket[word]), (np.repeat(row, n), WORDS + own)):
                code = np.unique(rows * (WORDS + GRAMS) + feature)
                for y in (0, 1):
                    sums[y] += np.bincount(code[label[a + code // (WORDS + GRAMS)] == y] % (WORDS + GRAMS), minlength=WORDS + GRAMS)
    some = np.flatnonzero(sums.any(0))
    yield pa.record_batch([pa.array(some), pa.array(sums[1][some]), pa.array(sums[0][some])], names=["feature", "n1", "n0"])


def log_odds(f1: np.ndarray, f0: np.ndarray, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of features, and which are in at least LEAST texts; others have 0."""
    often = f1 + f0 >= LEAST
    return np.where(often, np.log((f1 + 0.5) / max(n1, 1)) - np.log((f0 + 0.5) / max(n0, 1)), 0.0).clip(-3, 6).astype(np.float32) / 3, often


def likely_windows(batches, odds: np.ndarray, seed: int = 5):
    """(text, y, window, strength) of batches(text_no, text, y): the TOP windows by log odds, OTHERS more of clean texts."""
    for batch in batches:
        data, offsets = T.buffers(T.rows_with(batch, "text"))
        keys, label = T.rows_with(batch, "text_no").to_pylist(), T.rows_with(batch, "y").to_pylist()
        for a, b, d, o in T.chunks(data, offsets):
            low, s, e, at = T.words(d, o)
            row, first, length = windows(at)
            if not len(row):
                continue
            bucket, gram, gram_at, back = word_inputs(low, s, e)
            one = odds[bucket] + np.add.reduceat(odds[WORDS + gram], gram_at[:-1]) / np.sqrt(np.diff(gram_at))
            size = np.append(0, np.cumsum(e - s + 1))
            fits = size[first + length] - size[first] <= MOST_BYTES
            value = np.array([one[back[f : f + n]].max() for f, n in zip(first.tolist(), length.tolist(), strict=True)])
            cut = np.searchsorted(row, np.arange(b - a + 1))
            out = []
            for k in range(b - a):
                own = cut[k] + np.flatnonzero(fits[cut[k] : cut[k + 1]])
                own = own[np.argsort(-value[own], kind="stable")]
                more = np.random.default_rng([seed, keys[a + k] & 0xFFFFFFFF]).permutation(own[TOP:])[: 0 if label[a + k] else OTHERS]
                out += [(keys[a + k], label[a + k], b" ".join(low[s[w] : e[w]].tobytes() for w in range(first[x], first[x] + length[x])).decode(), float(value[x])) for x in [*own[:TOP], *more]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int32(), pa.string(), pa.float64()), strict=True)], names=["text_no", "y", "window", "strength"])


def train(words: np.ndarray, text_of: np.ndarray, labels: np.ndarray, strength: np.ndarray, odds: np.ndarray, often: np.ndarray, rounds: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 5) -> Network:
    """A network fitted to windows (an Arrow array of words joined by spaces) of texts; `text_of` in order, labels by text."""
    labels = np.asarray(labels, np.float32)
    data, offsets = T.buffers(words)
    low, s, e, at = T.words(data, offsets)
    first, length = at[:-1], np.diff(at)
    bucket, gram, gram_at, back = word_inputs(low, s, e)
    del data, low, s, e
    net, r = Network(), np.random.default_rng(seed)
    # a feature of fewer texts than LEAST stays at zero, as does one that training never met
    often_word, often_gram = often[:WORDS], often[WORDS:]
    net.p["word"][:, 0], net.p["gram"][:, 0] = odds[:WORDS], odds[WORDS:]
    net.p["word"] *= often_word[:, None]
    net.p["gram"] *= often_gram[:, None]
    gram_n = np.diff(gram_at)
    # Adam on the dense parts; embeddings move by plain steps on the rows of a batch
    dense = [k for k in net.p if k not in ("word", "gram")]
    m1, m2, t = {k: np.zeros_like(net.p[k]) for k in dense}, {k: np.zeros_like(net.p[k]) for k in dense}, 0
    cut = np.searchsorted(text_of, np.arange(len(labels) + 1))
    rows = np.flatnonzero(np.diff(cut))
    rounds = max(rounds, -(-STEPS * batch // (len(rows) + int((labels[rows] == 0).sum()))))
    for k in range(rounds):
        # before the first round: the window with the largest log odds
        value = score_windows(net, net.inputs(bucket, gram, gram_at), back, first, length) if k else strength
        best = np.array([cut[i] + int(np.argmax(value[cut[i] : cut[i + 1]])) for i in rows])
        other = np.array([r.integers(cut[i], cut[i + 1]) for i in rows if labels[i] == 0], np.int64)
        chosen = np.concatenate([best, other])
        r.shuffle(chosen)
        for a in range(0, len(chosen), batch):
            w = chosen[a : a + batch]
            index = _step_index(first[w], length[w], back)
            u, inverse = np.unique(index, return_inverse=True)
            own = np.concatenate([gram[gram_at[i] : gram_at[i + 1]] for i in u])
            own_at = np.concatenate(([0], np.cumsum(gram_n[u])))
            x = net.inputs(bucket[u], own, own_at)
            kept = np.repeat(r.random((len(u), 2)) > DROP, (DW, DC), axis=1) / np.float32(1 - DROP)  # a word is seen by one input only, or not at all
            x *= kept
            g, dx, _ = net.gradients(x, inverse.reshape(index.shape), length[w], labels[text_of[w]])
            dx *= kept
            t += 1
            lr = rate * (0.5 if k >= rounds // 2 else 1.0)
            for name in dense:
                m1[name] += 0.1 * (g[name] - m1[name])
                m2[name] += 0.01 * (g[name] ** 2 - m2[name])
                net.p[name] *= 1 - 0.02 * lr
                net.p[name] -= lr * (m1[name] / (1 - 0.9**t)) / (np.sqrt(m2[name] / (1 - 0.99**t)) + 1e-8)
            np.subtract.at(net.p["word"], bucket[u], (lr * 20 * dx[:, :DW] * often_word[bucket[u], None]).clip(-0.1, 0.1))
            np.subtract.at(net.p["gram"], own, (lr * 20 * np.repeat(dx[:, DW:] / np.sqrt(gram_n[u])[:, None], gram_n[u], axis=0) * often_gram[own, None]).clip(-0.1, 0.1))
    return net


def score_windows(net: Network, x: np.ndarray, back: np.ndarray, first: np.ndarray, length: np.ndarray, most: int = 1024) -> np.ndarray:
    out = np.empty(len(first), np.float32)
    # windows of like length together: short ones don't wait for long ones
    order = np.argsort(length, kind="stable")
    for a in range(0, len(order), most):
        w = order[a : a + most]
        out[w] = net.forward(x, _step_index(first[w], length[w], back), length[w])
    return out


def score_texts(net: Network | None, column: pa.Array) -> np.ndarray:
    data, offsets = T.buffers(column)
    out = np.zeros(len(offsets) - 1)
    if net is None:
        return out
    for a, b, d, o in T.chunks(data, offsets):
        low, s, e, at = T.words(d, o)
        row, first, length = windows(at)
        if not len(row):
            continue
        bucket, gram, gram_at, back = word_inputs(low, s, e)
        best = np.full(b - a, -np.inf)
        np.maximum.at(best, row, score_windows(net, net.inputs(bucket, gram, gram_at), back, first, length))
        out[a:b] = 1 / (1 + np.exp(-best.clip(-30, 30))) * (best > -np.inf)
    return out


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, sample: int = SAMPLE) -> Network | None:
    """Train on at most `sample` ids of either label whose crc32(doc_id) mod `modulus` is not `held`, and 4 * `sample` different texts of theirs."""
    prepare(docs.sparkSession)
    y = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y")).where(id_crc("doc_id") % modulus != held)
    y = y.join(docs.select(F.col("doc_id").cast("long")), "doc_id", "left_semi")
    pick = lambda c: y.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = pick("y > 0").unionByName(pick("y = 0"))
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")  # at most two samples of ids
    # rows that repeat are learnt from once; an id with very many texts doesn't bring them all
    texts = texts.select(F.xxhash64("doc_id", "text").alias("text_no"), "text", "y").dropDuplicates(["text_no"])
    texts = save(texts, "labelled")
    texts = texts.join(F.broadcast(texts.select("text_no").orderBy("text_no").limit(4 * sample)), "text_no", "left_semi").select("text_no", "text", "y")
    n1, n0 = texts.agg(F.count_if(F.col("y") > 0), F.count_if(F.col("y") == 0)).first()
    # a row for each bucket, however many texts
    found = texts.select("text", "y").mapInArrow(feature_counts, "feature long, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).toArrow()
    f1, f0 = np.zeros(WORDS + GRAMS), np.zeros(WORDS + GRAMS)
    f1[found["feature"].to_numpy()], f0[found["feature"].to_numpy()] = found["n1"].to_numpy(), found["n0"].to_numpy()
    odds, often = log_odds(f1, f0, n1, n0)
    shared = docs.sparkSession.sparkContext.broadcast(odds)  # one number for each bucket
    picked = texts.mapInArrow(lambda batches: likely_windows(batches, shared.value), "text_no long, y int, window string, strength double").orderBy("text_no", F.desc("strength"), "window").toArrow()
    shared.unpersist()
    picked = picked.combine_chunks()
    keys, text_of = np.unique(picked["text_no"].to_numpy(), return_inverse=True)
    label = np.zeros(len(keys), np.float32)
    label[text_of] = picked["y"].to_numpy() > 0
    if len(set(label.tolist())) < 2:
        return None
    net = train(picked["window"], text_of, label, picked["strength"].to_numpy(), odds, often)
    del picked, text_of, keys, odds, often, found, f1, f0
    give_back()
    # from the sample's share of toxic rows to that of all labelled rows
    all_1, all_n = y.agg(F.count_if(F.col("y") > 0), F.count(F.lit(1))).first()
    net.p["c"] += np.float32(np.log(all_1 / (all_n - all_1)) - np.log(n1 / n0))
    return net


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs with a column `score`; all columns stay."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(net)
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])

    def run(batches):
        for batch in batches:
            s = pa.array(score_texts(shared.value, T.rows_with(batch, "text")), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, s], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of docs(doc_id, text)."""
    net = fit(docs, labels, modulus, held)
    scored = score(docs.select(F.col("doc_id").cast("long"), "text"), net)
    return scored.select("doc_id", F.coalesce(id_crc("doc_id") % modulus == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
