"""Operators 11 to 13 against brute force, held-out labels and odd tables."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerlake.llm import negatives, quality, resampling
from ledgerlake.llm import textops as T

VECTORS = "vec_id long, embedding array<double>, label int"


def mined(rows):
    """Hard negatives by looking at every pair; Python's integers."""
    x = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * c) for c in v]) for i, v, y in rows]
    out = []
    for i, y, q in x:
        if i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(q, v)), j, z) for j, z, v in x]
        best = sorted((-s, j) for s, j, z in scored if z == y and j != i)[:5]
        for s, j in best:
            near = sorted((-n, k) for n, k, z in scored if z != y and -30 * s <= 100 * n <= -90 * s)[:10]
            out += [(i, j, r + 1, k, -s, -n) for r, (n, k) in enumerate(near)]
    return sorted(out)


def columns(df, names="anchor_id positive_id rank negative_id positive_score negative_score"):
    return sorted(tuple(r[c] for c in names.split()) for r in df.collect())


def clustered(n, d=8, centres=12, spread=0.05, seed=3):
    r = np.random.default_rng(seed)
    c = r.standard_normal((centres, d)) * 3
    k = r.integers(0, centres, n)
    # other labels at a share of the cluster's length, so that negatives lie within the wanted range
    scale = np.where(r.random(n) < 0.5, 1.0, r.uniform(0.4, 0.8, n))
    v = (c[k] + r.standard_normal((n, d)) * spread) * scale[:, None]
    return [(int(i), [float(x) for x in v[i]], int(scale[i] == 1.0) + 2 * int(k[i] % 3)) for i in range(n)]


def test_hard_negatives_equal_brute_force(spark):
    rows = clustered(2_000)
    want = mined(rows)
    assert len(want) > 50
    report = {}
    got = negatives.mine(spark.createDataFrame(rows, VECTORS), block=64, part=256, group=8, report=report)
    assert columns(got) == want
    done, total = report["far"]
    assert done < 0.9 * total  # bounds spare blocks where there are clusters


def test_hard_negatives_of_the_table(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in v.collect()]
    assert columns(negatives.mine(v, block=50, part=100)) == mined(rows)


def test_hard_negatives_odd_rows(spark):
    base = clustered(400, d=4, centres=3)
    odd = [(None, [1.0, 1.0, 1.0, 1.0], 1), (500, None, 1), (600, [1.0, None, 1.0, 1.0], 1), (700, [1.0, float("nan"), 1.0, 1.0], 2), (800, [1.0, float("inf"), 0.0, 0.0], 2), (900, [1.0] * 4, None), (1000, [1.0] * 3, 1), (1100, [], 1)]
    zero = [(1200, [0.0] * 4, 1), (1201, [0.0] * 4, 2)]
    # ties and rows that repeat: one vector many times, also as anchors, and a vec_id with two rows
    again = [(2000 + k, base[0][1], k % 2) for k in range(150)] + [(2400, base[1][1], 1)] * 3
    rows = base + zero + again
    df = spark.createDataFrame(rows + odd, VECTORS)
    want = mined(rows)
    assert columns(negatives.mine(df, block=16, part=64, group=4)) == want
    extra = df.selectExpr("*", "'a' AS x", "1 AS key", "2 AS t", "'g' AS group", "0 AS score", "0 AS cell")
    assert columns(negatives.mine(extra)) == want
    assert negatives.mine(df.limit(0)).collect() == []
    assert negatives.mine(spark.createDataFrame([(1, [1.0], 1), (2, [2.0], 2)], VECTORS)).collect() == []  # no anchor


def test_hard_negatives_large_components(spark):
    r = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in r.standard_normal(3) * 10.0 ** int(r.integers(0, 7))], int(i % 3)) for i in range(201)]
    assert columns(negatives.mine(spark.createDataFrame(rows, VECTORS), block=32, part=64)) == mined(rows)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def resampled(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = [0] * 10_000, [0] * 10_000
    for texts, to in (([x for _, x in docs], s), (target, t)):
        for x in texts:
            for f in runs(x)[1]:
                to[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    out = []
    for i, x in docs:
        n, f = runs(x)
        weight = sum(gain[bucket(g)] for g in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], (r[0] is not None, r[0] or 0)))
    for k, r in enumerate(may[: len(may) * 5 // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def texts_of(n, seed=2):
    r = np.random.default_rng(seed)
    words = ["alpha", "Beta", "gamma9", "é", "ß-x", "", "7", "Zeta\n", "日本", "don't"]
    return [(i, " ".join(words[k] for k in r.integers(0, len(words), r.integers(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("chunk", [1 << 16, 40])
def test_resampling_equals_brute_force(spark, chunk):
    docs = texts_of(300) + [(1_000, None), (1_001, ""), (None, "alpha " * 30), (1_002, "alpha beta gamma " * 2_000), (1_003, "x" * 5_000)]
    docs += [(5, "alpha gamma9 " * 20)] * 3 + [(2_000 + k, docs[7][1]) for k in range(50)]
    target = ["Alpha beta gamma9", None, "zeta 7 日本 alpha beta"]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), chunk=chunk)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got.collect()), key=repr) == resampled(docs, target)


def test_resampling_odd_tables(spark):
    docs, goal = spark.createDataFrame(texts_of(60), "doc_id long, text string"), spark.createDataFrame([("a b",)], "text string")
    extra = docs.selectExpr("*", "1 AS row", "'x' AS piece", "2 AS own", "3 AS weight", "4 AS score", "5 AS rank")
    assert sorted(resampling.resample(extra, goal).collect()) == sorted(resampling.resample(docs, goal).collect())
    assert resampling.resample(docs.limit(0), goal).collect() == []
    assert len(resampling.resample(docs, goal.limit(0)).collect()) == 60


def test_chunks_own_every_word_once():
    text = ("aa b-c " * 50 + "z" * 300 + " é").encode()
    for chunk in (1, 7, 64, 10_000):
        parts = list(resampling.cut_long(text, chunk))
        assert sum(own for _, own in parts) == len(WORD.findall(text.decode()))


@pytest.fixture(scope="module")
def labelled(spark):
    r, rows, labels = np.random.default_rng(1), [], []
    for i in range(1_200):
        w = ["".join(r.choice(list("abcdefgh"), r.integers(2, 8))) for _ in range(int(r.integers(20, 90)))]
        bad = i % 5 == 0
        if bad and i % 10 == 0:
            w = [x + "!!" for x in w]
        elif bad:
            w = [w[0]] * len(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_of_held_out_rows(spark, labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    held = [i for i in got if got[i].held_out]
    assert held == [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].predicted == int(i % 5 > 0) for i in held) > 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_quality_learns_nothing_from_held_out_rows(spark, labelled):
    from pyspark.sql import functions as F

    docs, labels = labelled
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(quality.quality(docs, labels).collect()) == sorted(quality.quality(docs, turned).collect())


def test_quality_odd_tables(spark, labelled):
    docs, labels = labelled
    odd = spark.createDataFrame([(5_000, None), (5_001, ""), (None, "abc abc"), (5_002, "wordy text " * 100_000), (7, "abc " * 30), (7, "abc " * 30)], "doc_id long, text string")
    more = labels.unionByName(spark.createDataFrame([(None, 1, 0), (5_000, None, 1), (7, 0, 0)], labels.schema))
    got = quality.quality(docs.unionByName(odd), more).collect()
    assert len(got) == 1_206 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 7}) == 2  # the repeated rows are scored alike
    assert not next(r for r in got if r.doc_id is None).held_out
    assert quality.quality(docs.limit(0), labels).collect() == []
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    clash = docs.selectExpr("*", "1 AS score", "2 AS features", "3 AS y", "0 AS quality", "0 AS held_out")
    assert sorted(quality.quality(clash, labels).collect()) == sorted(quality.quality(docs, labels).collect())


def test_quality_features_one_by_one():
    """Batches don't leak into each other, and plain counts hold."""
    texts = ["Aa bb! 9", "", "x x x y\nx x x y\nz", "é é", "  ", "!! a"]
    alone = np.concatenate([quality.features(*T.buffers(pa.array([t]))) for t in texts])
    assert np.allclose(quality.features(*T.buffers(pa.array(texts))), alone)
    named = [dict(zip(quality.FEATURES, x)) for x in alone]
    assert named[0]["log_words"] == pytest.approx(math.log(4)) and named[0]["upper"] == pytest.approx(1 / 4) and named[0]["digit"] == pytest.approx(1 / 6)
    assert named[0]["marked_words"] == pytest.approx(1 / 3) and named[5]["alone_marks"] == pytest.approx(1 / 2)
    assert named[2]["distinct_words"] == pytest.approx(3 / 9) and named[2]["repeats_last"] == pytest.approx(4 / 9) and named[2]["distinct_lines"] == pytest.approx(2 / 3)
    assert named[2]["longest_run"] == pytest.approx(math.log1p(3))
    assert not alone[1].any() and not alone[4].any()


def test_model_is_its_tables():
    """A score is the intercept and one addition for each table."""
    r = np.random.default_rng(0)
    x = r.random((3_000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # an interaction that no single table can hold
    m = quality.train(x, y, rounds=20)
    assert (0, 1) in m.pairs and ((m.score(x) > 0.5) == y).mean() > 0.95
    k = 17
    one = m.base + sum(t[np.searchsorted(e, v)] for t, e, v in zip(m.tables, m.edges, x[k])) + sum(t[np.searchsorted(m.coarse[i], x[k, i]), np.searchsorted(m.coarse[j], x[k, j])] for (i, j), t in m.pairs.items())
    assert m.raw(x)[k] == pytest.approx(one)
