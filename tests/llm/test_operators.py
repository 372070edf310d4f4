"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlake.llm import bpe, classlm, encode, graph, imatch, jaccard, language, licenses, neighbours, packing, repair, toxicity

LONG = " ".join(f"w{k % 97}" for k in range(20_000))
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 3
TEXTS = [None, "", "   ", "Hello", BASE, BASE, BASE + "tail", BASE.replace("twenty", "TWENTY"), "totally different words that nobody else has used in this small table", LONG, "  two  spaces \n\n and\ttabs 's don't 日本語 😀", "x" * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "other", 1.0) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4]], "doc_id long, text string, lang string, row string, score double").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def coder():
    c = bpe.coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={}), c


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))


def test_jaccard(docs, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    sets = {i: ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w := words(t)) >= 5 else {tuple(w)} if w else set()) for i, t in texts(docs)}
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == {(i, len(s), comp[i]) for i, s in sets.items()}
    assert jaccard.near_duplicates(empty).count() == 0


def test_jaccard_null_id(spark):
    x = spark.createDataFrame([(None, BASE), (3, BASE)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(x).collect()} == {(None, None), (3, 3)}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "u long, v long")
    assert {r.comp for r in graph.components(edges).collect()} == {0, 100}


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_tree_bpe_is_bpe(t):
    k, c = coder()
    ids = c.encode(t)
    assert ids.tolist() == k.encode_ordinary(t) and c.decode(ids) == t.encode()


_PARTS = ["a", "B", " ", "  ", "\n", " \n", "\t", "'s", "'", "1", "23", ".", "é", "日", "\u00a0", "\u3000", "\x1c", "\x85", "<|endoftext|>", "<|end", "oftext|>", "😀", "don't", "\u2028"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(_PARTS), st.text(max_size=3)), max_size=14).map("".join), min_size=1, max_size=6))
def test_columns_encode_as_the_library_does(rows):
    library, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), encode.pieces(P.path("byte_bpe_50k.json"))
    got = [ids[x:y].tolist() for a, b, ids, at in own.column(pa.array(rows)) for x, y in zip(at[:-1], at[1:], strict=True)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in rows]


def test_strings_of_added_tokens_have_their_id():
    own = encode.pieces(P.path("byte_bpe_50k.json"))
    (_, _, ids, at), = own.column(pa.array(["x <|endoftext|> y", "<|endof", "text|>", None]))
    assert ids[: at[1]].tolist() == [87, 220, 50256, 331] and 50256 not in ids[at[1] :] and at[3] == at[4]


def test_tree_bpe_table(docs, empty):
    k, _ = coder()
    want = Counter((i, len(ids := k.encode_ordinary(t)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts(docs))
    assert Counter(map(tuple, bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect())) == want
    assert bpe.round_trip(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=400), st.data())
def test_repair_round_trip(ids, data):
    a = np.array(ids * 4, "<u4")
    s = repair.Shard(repair.pack(np.array([7]), np.array([len(a)]), a, 6))
    assert s.ids().tolist() == a.tolist()
    start = data.draw(st.integers(0, len(a)))
    n = data.draw(st.integers(0, len(a) - start))
    if n:
        assert s.slice(start, n).tolist() == a[start : start + n].tolist()


def test_repair_goes_on_until_pairs_are_rare():
    r = np.random.default_rng(9)
    for ids in (np.tile(np.arange(1000), 600), np.zeros(50_000, int), r.zipf(1.3, 60_000) % 500, r.integers(0, 40_000, 5000)):
        rules, s = repair.compress(ids, 50_000)
        assert repair.expand(rules, s, 50_000).tolist() == ids.tolist()
        # overlapping places of one pair of equal symbols are replaced by turns
        left = Counter((a, b) for a, b in zip(s.tolist(), s[1:].tolist()) if a != b)
        assert not left or max(left.values()) < repair.LEAST
        assert set(range(50_000, 50_000 + len(rules))) <= set(s.tolist()) | set(rules.reshape(-1).tolist())


def test_slices_start_at_marks():
    r = np.random.default_rng(10)
    ids = r.integers(0, 3000, 30_000)
    s = repair.Shard(repair.pack(np.array([1]), np.array([len(ids)]), ids.astype(np.uint32), 3000))
    assert len(s.marks) > 5 and s.ids().tolist() == ids.tolist()
    for a, n in [(0, 1), (1023, 2), (1024, 1024), (29_999, 1), (0, 30_000), (5, 0), *((int(x), 700) for x in r.integers(0, 29_000, 20))]:
        assert s.slice(a, n).tolist() == ids[a : a + n].tolist()


def test_shards(docs, empty):
    k, _ = coder()
    got = sorted(map(tuple, repair.read_shards(repair.write_shards(docs, P.path("byte_bpe_50k.json"), 2, shard=3000)).collect()), key=lambda r: r[1])
    at = 0
    for (i, start, n, crc), (j, t) in zip(got, sorted(texts(docs)), strict=True):
        ids = np.array([*k.encode_ordinary(t), 2], "<u4")
        assert (i, start, n, crc) == (j, at, len(ids), zlib.crc32(ids.tobytes()))
        at += n
    assert repair.read_shards(repair.write_shards(empty, P.path("byte_bpe_50k.json"), 2)).count() == 0


def test_shards_keep_null_and_extreme_ids(spark):
    ids = [None, None, -(1 << 63), -(1 << 63), 0, (1 << 63) - 1]
    x = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    for shard in (1, 7, 3000):
        got = repair.read_shards(repair.write_shards(x, P.path("byte_bpe_50k.json"), 2, shard=shard)).orderBy("start").collect()
        assert [r.doc_id for r in got] == ids


def test_packing(docs, empty):
    k, _ = coder()
    rows = packing.pack(docs, P.path("byte_bpe_50k.json")).collect()
    ids = {i: np.array([*k.encode_ordinary(t), 0], "<u4") for i, t in texts(docs)}
    covered = Counter()
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        covered.update((r.doc_id, x) for x in range(r.start, r.start + r.length))
    assert covered == Counter((i, x) for i, _ in texts(docs) for x in range(len(ids[i])))
    seqs: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == seqs.get(r.sequence_id, 0)
        seqs[r.sequence_id] = r.offset + r.length
    assert sum(n < 1024 for n in seqs.values()) <= 1 and max(seqs.values()) <= 1024
    assert packing.pack(empty, P.path("byte_bpe_50k.json")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 9), max_size=12))
def test_plan_places_each_id_once(counts):
    plan, seen, fill = packing.Plan(counts, 64), Counter(), Counter()
    for length, a, b, cut, use, seq, offset in plan.rows:
        for r in range(a, b):
            seen.update((length, r, x) for x in range(cut, cut + use))
            fill[seq + r - a] += use
    assert seen == Counter((v, r, x) for v, n in counts.items() for r in range(n) for x in range(v))
    assert sum(v != 64 for v in fill.values()) <= 1 and max(fill.values(), default=0) <= 64


def test_fullest_is_the_best_sum():
    assert packing.fullest({7: 2, 5: 1, 3: 1}, 16) == (15, {7: 1, 5: 1, 3: 1})
    assert packing.fullest({}, 16) == (0, {})


@pytest.mark.parametrize("known", [3, 1_000_000])
def test_class_lm(docs, empty, known):
    count, tok = Counter(), []
    for i, t in texts(docs):
        w = [*words(t), None]
        tok.append((i, w))
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(w)
    total, kinds = sum(count.values()), len(count)
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in classlm.score(docs, known=known, frequent=2).collect())
    assert got == Counter((i, zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(count[x] > 0 for x in w), total, round(sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w), 5)) for i, w in tok)
    assert classlm.score(empty).count() == 0


def test_class_lm_of_many_repeated_rows(spark):
    rows = [(1, "one two three")] * 3000 + [(2, None), (3, "one four")]
    got = classlm.score(spark.createDataFrame(rows, "doc_id long, text string"), frequent=2).collect()
    train = sum(4 if i == 1 else len((t or "").split()) + 1 for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2)
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {train}
    assert len({(r.base_score, r.score) for r in got if r.doc_id == 1}) == 1


def test_exchange_finds_two_classes():
    a = np.zeros((6, 6))
    a[np.ix_([0, 1], [2, 3])] = 50
    a[np.ix_([2, 3], [0, 1])] = 50
    of = classlm.exchange(a, 2)
    assert of[0] == of[1] != of[2] == of[3] and of[4:].tolist() == [2, 3]


def test_placer_gives_the_gain_of_exchange():
    r = np.random.default_rng(3)
    n, k = 12, 3
    tokens = r.integers(0, n, 4000)  # words 0 to 5 are the core, of classes 0 to 2, the others open
    cls = np.array([0, 0, 1, 1, 2, 2, *[k] * (n - 6)])
    like = lambda of: (lambda t: classlm._xlogx(t).sum() - classlm._xlogx(t.sum(0)).sum() - classlm._xlogx(t.sum(1)).sum())(np.histogram2d(of[tokens[:-1]], of[tokens[1:]], bins=k + 2, range=[[0, k + 2]] * 2)[0])
    moves = np.histogram2d(cls[tokens[:-1]], cls[tokens[1:]], bins=k + 2, range=[[0, k + 2]] * 2)[0]
    for w in range(6, n):
        at = np.flatnonzero(tokens[1:-1] == w) + 1
        if tokens[0] == w or tokens[-1] == w:
            continue
        side = lambda x: np.where(x == w, k + 2, cls[x])
        got = classlm.Placer(moves).gains(np.zeros(len(at), np.int64), side(tokens[at - 1]), side(tokens[at + 1]), 1)[0]
        want = np.array([like(np.where(np.arange(n) == w, b, cls)) for b in range(k)])
        assert np.allclose(got - got[0], want - want[0])


@pytest.mark.parametrize("known", [5, 1_000_000])
def test_words_outside_the_core_have_classes(spark, known):
    core = [(k, " ".join(["aa", "bb", "aa", "bb"] * 3)) for k in range(300)]
    # xx stands where bb does, yy where aa does, both as often
    rare = [(1000 + k, "aa bb aa xx aa bb yy bb aa bb") for k in range(40)]
    ask = [(5000, "aa xx aa"), (5001, "aa yy aa"), (5002, "xx yy"), (5003, "yy xx"), (5004, "xx xx")]
    docs = spark.createDataFrame(core + rare + ask, "doc_id long, text string")
    got = {r.doc_id: r.score for r in classlm.score(docs, modulus=1, held=1, frequent=2, classes=2, known=known).collect()}
    assert got[5000] > got[5001] + 1 and got[5002] > got[5004] and got[5003] > got[5004]


def test_class_lm_is_the_same_for_words_not_at_hand(spark):
    r = np.random.default_rng(5)
    docs = spark.createDataFrame([(k, " ".join(f"v{int(x)}" for x in r.zipf(1.4, 60) % 400)) for k in range(200)], "doc_id long, text string")
    near, far = ({x.doc_id: tuple(x) for x in classlm.score(docs, frequent=10, classes=4, known=known).collect()} for known in (1_000_000, 20))
    assert near.keys() == far.keys() and all(np.allclose(near[k], far[k]) for k in near)


def test_neighbours(spark):
    r = np.random.default_rng(1)
    v = r.standard_normal((1500, 16))
    v[700:720] = v[0]
    rows = [(k, x.tolist(), 0) for k, x in enumerate(v)] + [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] * 16, 0), (5060, [1.0], 0), (5080, [None] * 16, 0)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int"), block=700).toPandas()
    s = v[::20] @ v.T
    hits = 0
    for j, q in enumerate(range(0, 1500, 20)):
        s[j, q] = -np.inf
        want = np.lexsort((np.arange(1500), -s[j]))[:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine.score, [v[q] @ v[i] for i in mine.vec_id])
        hits += len(set(want) & set(mine.vec_id))
    assert hits / (75 * 20) >= 0.9 and set(got.query_id) == set(range(0, 1500, 20))
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_rows_that_repeat_are_dealt_over_blocks(spark):
    r = np.random.default_rng(3)
    v = r.standard_normal((300, 8))
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(7, v[7].tolist())] * 400
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=50).toPandas()
    assert set(got.query_id) == set(range(0, 300, 20)) and (got.groupby("query_id")["rank"].max() == 20).all()
    for q in range(0, 300, 20):
        # every copy is a candidate of its own: they take all places behind the nearer ones
        nearer = [i for i in range(300) if i != q and v[q] @ v[i] > v[q] @ v[7]]
        if len(nearer) < 20:
            assert (got[got.query_id == q].vec_id == 7).sum() >= 20 - len(nearer)


def test_equal_vectors_are_in_the_order_of_their_ids(spark):
    r = np.random.default_rng(6)
    v = r.standard_normal((900, 24))
    v[r.integers(0, 900, 300)] = v[7]
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=250).toPandas()
    for q, mine in got.groupby("query_id"):
        mine = mine.sort_values("rank")
        assert all((a > b) or (a == b and i < j) for a, b, i, j in zip(mine.score, mine.score[1:], mine.vec_id, mine.vec_id[1:]))
        for i, s in zip(mine.vec_id, mine.score):
            want = 0.0
            for x, y in zip(v[i], v[q]):
                want += x * y
            assert s == want


@pytest.mark.parametrize("scale", [1e38, 1e150, 1e-150])
def test_vectors_of_any_finite_size(spark, scale):
    r = np.random.default_rng(8)
    v = r.standard_normal((300, 8))
    rows = [(k, (x * scale).tolist()) for k, x in enumerate(v)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    s = v[::20] @ v.T
    for j, q in enumerate(range(0, 300, 20)):
        s[j, q] = -np.inf
        mine = set(got[got.query_id == q].vec_id)
        assert len(mine) == 20 and len(mine & set(np.argsort(-s[j])[:20])) >= 14


def test_imatch(docs, empty):
    got = sorted(imatch.fingerprints(docs).collect(), key=lambda r: (r.doc_id, r.edited_sha256))
    rows = sorted(texts(docs))
    want = []
    for k, (i, t) in enumerate(rows):
        h = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - h] + rows[(k + 1) % len(rows)][1][:h]).encode()).hexdigest()))
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in got] == sorted(want, key=lambda r: (r[0], r[2]))
    same = [r for r in got if r.doc_id in (4, 5)]
    assert len({r.fingerprint for r in same}) == 1 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert [r.near_next for r in same if r.doc_id == 4] == [1.0, 1.0]
    assert imatch.fingerprints(empty).count() == 0


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _spark_hash(spark, values):
    """xxhash64(value, seed number) of terms, by Spark itself: the hash isn't what is tested."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select("v", *[F.xxhash64(F.xxhash64("v"), F.lit(r)).alias(f"h{r}") for r in range(imatch.REPEATS)]).collect()
    return {x.v: [x[f"h{r}"] for r in range(imatch.REPEATS)] for x in rows}


def test_imatch_by_brute_force(spark):
    r = np.random.default_rng(12)
    vocab = [f"t{k}" for k in range(400)]
    texts = [" ".join(r.choice(vocab, 60)) for _ in range(40)]
    texts += [texts[0], texts[1] + " extra", "common " * 30, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    low, high = 0.05, 0.5
    got = {x.doc_id: x for x in imatch.fingerprints(docs, low, high).collect()}
    n = len(texts)
    terms = lambda t: sorted(set(re.findall(r"[^\W_]+", t.lower())))
    df = Counter(w for t in texts for w in terms(t))
    band = {w for w, c in df.items() if max(2, low * n) <= c <= max(2, high * n)}
    hashes = _spark_hash(spark, sorted(band | {"x"}))

    def fingerprint(t):
        slots = {}
        for w in terms(t):
            if w in band:
                for k, h in enumerate(hashes[w]):
                    if h & 3 == 0:
                        level = next((j for j in range(imatch.LEVELS - 1) if h & ((1 << 2 * j + 4) - 1)), imatch.LEVELS - 1)
                        slots.setdefault(imatch.LEVELS * k + level, []).append(h)
        if not slots:
            return "t" + hashlib.sha256(t.encode()).hexdigest()[:16]
        out = []
        for s, hs in sorted(slots.items()):
            x = 0
            for h in sorted(hs):
                x ^= h & ((1 << 64) - 1)
            out.append(f"{s:02d}{x:X}")
        return ".".join(out)

    def like(a, b):
        if a == b:
            return 1.0
        if a[0] == "t" or b[0] == "t":
            return 0.0
        x, y = set(a.split(".")), set(b.split("."))
        return len(x & y) / len({e[:2] for e in x | y})

    for k, t in enumerate(texts):
        other = texts[(k + 1) % n]
        h = len(t) // 2
        edited = t[: len(t) - h] + other[:h]
        want = (fingerprint(t), fingerprint(edited), like(fingerprint(t), fingerprint(edited)), like(fingerprint(t), fingerprint(other)))
        assert (got[k].fingerprint, got[k].edited_fingerprint, pytest.approx(got[k].near_edited), pytest.approx(got[k].near_next)) == want, k


def test_class_model_scores_by_brute_force(spark):
    from ledgerlake.llm import textops as T

    r = np.random.default_rng(13)
    texts = [" ".join(f"v{int(x)}" for x in r.zipf(1.5, 40) % 30) for _ in range(80)] + ["", "never seen words v1"]
    got = {x.doc_id: x.score for x in classlm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), frequent=1000, classes=4).collect()}
    train = [k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 7 != 2]
    count = Counter(w for k in train for w in texts[k].split())
    low, s, e, _ = T.words(*T.buffers(pa.array(sorted(count))))
    hashes = dict(zip(sorted(count), T.hashes(low, s, e).tolist()))
    number = {w: k for k, w in enumerate(sorted(count, key=lambda w: (-count[w], hashes[w])))}
    n = len(number)
    of_text = lambda t: [n + 1, *[number.get(w, n) for w in t.split()], n + 1]
    table = np.zeros((n + 2, n + 2))
    for k in train:
        for a, b in zip(of_text(texts[k]), of_text(texts[k])[1:]):
            table[a, b] += 1
    of = classlm.exchange(table, 4)
    c = int(of[-1]) + 1
    moves = np.zeros((c, c))
    for k in train:
        for a, b in zip(of_text(texts[k]), of_text(texts[k])[1:]):
            moves[of[a], of[b]] += 1
    into = moves.sum(0) + 1 / c
    p = (moves + 5 * into / into.sum()) / (moves.sum(1, keepdims=True) + 5)
    assert np.allclose(p.sum(1), 1)
    size = Counter()
    for w, k in number.items():
        size[of[k]] += count[w]
    for k, t in enumerate(texts):
        x = of_text(t)
        want = sum(math.log10(p[of[a], of[b]]) for a, b in zip(x, x[1:])) + sum(math.log10(count[w] / size[of[number[w]]]) for w in t.split() if w in number)
        assert got[k] == pytest.approx(want, abs=1e-6), k


def test_language_evidence_by_brute_force(spark):
    r = np.random.default_rng(14)
    sets = {"aa": "abcde", "bb": "vwxyz"}
    say = lambda n, k=30: " ".join("".join(r.choice(list(sets[n]), 5)) for _ in range(k))
    train = spark.createDataFrame([(k, say(n), n) for j, n in enumerate(sets) for k in range(100 * j, 100 * j + 20)], "doc_id long, text string, lang string")
    names, model = language.fit(train)
    rows = [(k, say("aa" if k % 3 else "bb", 6), "aa" if k % 2 else None, ("h1", "h2", None)[k % 3], ("s", None)[k % 2], 7) for k in range(60)] + [(60, None, None, None, None, 7), (61, "", "bb", "h1", "s", 7), (62, "x" * 20_000 + say("bb"), "aa", "h9", "s", 7), (1, "abc", None, None, None, 7)]
    df = spark.createDataFrame(rows, "k long, text string, declared string, host string, suffix string, lang_ int")
    got = Counter((x.k, x.lang, round(x.confidence, 6), x.lang_) for x in language.identify(df, names, model).collect())
    e = language.text_evidence(pa.array([x[1] for x in rows]), model)
    soft = np.exp(e - e.max(1, keepdims=True))
    soft /= soft.sum(1, keepdims=True)
    n, k, s = len(rows), len(names) + 1, language.SMOOTH
    total = soft.sum(0)
    prior = (total + 1) / (total.sum() + k)
    lean = lambda own, up: (own + s * up) / (own.sum() + s)
    want = Counter()
    for j, (key, _, d, h, x, _) in enumerate(rows):
        own = lambda f, v: soft[[i for i in range(n) if f(rows[i]) == v]].sum(0)
        up = lean(own(lambda q: q[4], x), prior)
        host = lean(own(lambda q: (q[4], q[3]), (x, h)), up)
        c = own(lambda q: q[2], d)
        said = np.log((c + s * (c.sum() + 1) / (total.sum() + k)) / (total + s)) if d else 0
        f = e[j] + said + np.log(host)
        bare = not e[j].any() and not d and not h
        want[key, language.UNKNOWN if bare else [*names, "und"][int(f.argmax())], round(1 / np.exp(f - f.max()).sum(), 6), 7] += 1
    assert got == want
    assert language.identify(df.limit(0), names, model).count() == 0


def test_toxicity_keeps_clashing_columns_and_scores_long_and_repeated_texts(spark):
    net = toxicity.Network()
    docs = spark.createDataFrame([(1, LONG, 0.1), (2, LONG, 0.2), (2, LONG, 0.2), (3, None, 0.3)], "doc_id long, text string, other double")
    got = toxicity.score(docs, net).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id < 3}) == 1 and [r.score for r in got if r.doc_id == 3] == [0.0]


def test_toxicity_learns_a_word(spark, empty):
    r = np.random.default_rng(2)
    vocab = [f"word{k}" for k in range(300)]
    rows = [(k, " ".join([*r.choice(vocab, 40), *(["nasty"] * (k % 4 == 0)), *r.choice(vocab, 30)])) for k in range(400)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0), 1) for k in range(400)] + [(None, 1, 1), (1000, None, 0)], "doc_id long, toxic int, quality int")
    got = {x.doc_id: x for x in toxicity.toxicity(docs, labels).collect()}
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got) and got[1000].score == got[1001].score == 0
    held = [k for k in range(400) if got[k].held_out]
    assert np.mean([got[k].predicted == (k % 4 == 0) for k in held]) > 0.9
    assert toxicity.toxicity(empty, labels).count() == 0


def test_windows_cover_all_words():
    at = np.array([0, 0, 10, 74, 1000])
    row, first, length = toxicity.windows(at)
    for k in range(4):
        seen = {x for r, f, n in zip(row, first, length, strict=True) if r == k for x in range(f, f + n)}
        assert seen == set(range(at[k], at[k + 1]))


def test_forward_pass_step_by_step():
    """Logits of whole windows against one window, one word and one number at a time."""
    net = toxicity.Network(seed=9)
    r = np.random.default_rng(4)
    for name in ("u", "w", "bf", "bb"):
        net.p[name] = r.standard_normal(net.p[name].shape).astype(np.float32)
    x, index, length = r.standard_normal((6, toxicity.DW + toxicity.DC)).astype(np.float32), r.integers(0, 6, (5, 4)), np.array([5, 3, 1, 4])
    got = net.forward(x, index, length)
    sig = lambda v: 1 / (1 + math.exp(-v))
    H = toxicity.H
    for j, n in enumerate(length.tolist()):
        words = [x[index[t, j]].astype(float) for t in range(n)]
        states = {}
        for side, order in (("f", range(n)), ("b", range(n - 1, -1, -1))):
            W, U, b = (net.p[f"{k}{side}"].astype(float) for k in "WUb")
            h = [0.0] * H
            for t in order:
                a = [sum(words[t][i] * W[i, k] for i in range(len(words[t]))) + b[k] for k in range(3 * H)]
                g = [sum(h[i] * U[i, k] for i in range(H)) for k in range(3 * H)]
                z, gate = [sig(a[k] + g[k]) for k in range(H)], [sig(a[H + k] + g[H + k]) for k in range(H)]
                c = [math.tanh(a[2 * H + k] + gate[k] * g[2 * H + k]) for k in range(H)]
                h = [z[k] * h[k] + (1 - z[k]) * c[k] for k in range(H)]
                states[side, t] = h
        both = [states["f", t] + states["b", t] for t in range(n)]
        weight = [math.exp(sum(v * float(u) for v, u in zip(s, net.p["u"]))) for s in both]
        pooled = [sum(w * s[k] for w, s in zip(weight, both)) / sum(weight) for k in range(2 * H)]
        assert got[j] == pytest.approx(sum(v * float(w) for v, w in zip(pooled, net.p["w"])) + float(net.p["c"][0]), abs=1e-4)


def test_gradients():
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, index, length, y = r.standard_normal((5, toxicity.DW + toxicity.DC)), r.integers(0, 5, (7, 3)), np.array([7, 4, 2]), np.array([1.0, 0.0, 1.0])
    g, _, _ = net.gradients(x, index, length, y)
    for name in ("Uf", "Wb", "u", "bf"):
        flat, e = net.p[name].reshape(-1), 1e-3
        flat[1] += e
        up = net.gradients(x, index, length, y)[2]
        flat[1] -= 2 * e
        down = net.gradients(x, index, length, y)[2]
        flat[1] += e
        assert abs((up - down) / (2 * e) - g[name].reshape(-1)[1]) < 1e-3


def test_language(spark):
    en, de = "the house and the garden with the other people ", "das haus und der garten mit den anderen leuten "
    train = spark.createDataFrame([(k, (en if k % 2 else de) * 5, "en" if k % 2 else "de") for k in range(40)] + [(None, en, "en"), (99, en, None)], "doc_id long, text string, lang string")
    names, model = language.fit(train)
    assert names == ["de", "en"]
    pages = [(1, "http://a.example.de/x", "<html lang='de'><p>" + de + "</p>"), (2, "http://b.example.com", "<p>" + en * 3), (3, None, None), (4, "http://a.example.de/y", "<html lang=de>"), (5, "", "<html lang='xx'>12345")]
    got = {r.page_id: r for r in language.identify(language.page_rows(spark.createDataFrame(pages, "page_id long, url string, html string")), names, model).collect()}
    assert (got[1].lang, got[2].lang, got[3].lang, got[4].lang, got[5].lang) == ("de", "en", "und", "de", "und")
    assert all(0 < r.confidence <= 1 for r in got.values())


def test_language_of_repeated_rows_extra_columns_and_empty_tables(spark):
    en, de = "the house and the garden with the other people ", "das haus und der garten mit den anderen leuten "
    train = spark.createDataFrame([(k, (en if k % 2 else de) * 5, "en" if k % 2 else "de", 0.5) for k in range(40)], "doc_id long, text string, lang string, lang_score double")
    names, model = language.fit(train)
    pages = [(1, None, "<p>" + de * 500, 1)] * 50 + [(2, None, "<p>" + en, 2)]
    x = spark.createDataFrame(pages, "page_id long, url string, html string, text int")
    got = Counter((r.page_id, r.lang) for r in language.identify(language.page_rows(x), names, model).collect())
    assert got == {(1, "de"): 50, (2, "en"): 1}
    assert language.identify(language.page_rows(x.limit(0)), names, model).count() == 0
    none = language.fit(train.limit(0))
    assert none[0] == [] and {r.lang for r in language.identify(language.page_rows(x), *none).collect()} == {"und"}


def test_language_has_a_model_of_every_language(spark):
    r = np.random.default_rng(4)
    names = [f"l{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
    sets = {n: ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30)] for n in names}
    say = lambda n: " ".join(r.choice(sets[n], 60))
    train = spark.createDataFrame([(100 * j + k, say(n), n) for j, n in enumerate(names) for k in range(12)] + [(9000 + k, "дом", "qq") for k in range(3)], "doc_id long, text string, lang string")
    got_names, model = language.fit(train)
    assert got_names == names
    rows = [(j, say(n), None) for j, n in enumerate(names)] + [(100, "дом и сад у реки где никто не жил", "qq"), (101, say(names[3]), "zz"), (102, "12345", "qq"), (103, "дом и сад у реки где никто не жил", None)]
    x = spark.createDataFrame([(*row, None, None) for row in rows], "k long, text string, declared string, host string, suffix string")
    got = {r.k: r.lang for r in language.identify(x, got_names, model).collect()}
    assert got == {**dict(enumerate(names)), 100: "qq", 101: names[3], 102: "und", 103: "und"}


def test_licenses(docs, empty, spark):
    lines = ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 1.1.", "Text. Released under the MIT License. More text here.", "a licence to thrill", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0."]
    x = spark.createDataFrame([(1, "\n".join(["plain", *lines, lines[0]])), (2, None)], "doc_id long, text string")
    got = {(r.doc_id, r.line, r.license, r.differences) for r in licenses.licenses(x).collect()}
    assert got == {(1, 1, "Apache-2.0", 0), (1, 3, "MIT", 0), (1, 5, "CC-BY-NC-4.0", 0), (1, 6, "CC-BY-4.0", 0), (1, 7, "Apache-2.0", 0)}
    assert licenses.licenses(docs).count() == 0 and licenses.licenses(empty).count() == 0


def test_licenses_inside_long_lines_and_over_line_ends(spark):
    prose = "and the river ran past the old mill where nobody had lived for years " * 40
    notices = {k: v for k, v in licenses.TEMPLATES.items()}
    rows, want = [], set()
    for j, (name, t) in enumerate(notices.items()):
        w = t.split()
        wrapped = "\n".join(" ".join(w[a : a + 4]) for a in range(0, len(w), 4))
        for k, x in enumerate([prose + t + " " + prose, "x\n" + wrapped + "\n" + prose, prose + t]):
            rows.append((10 * j + k, x))
            want.add((10 * j + k, int(k == 1), name, 0))
    rows.append((1000, prose + notices["MIT"] + " " + notices["MIT"] + " " + prose + notices["GPL-2.0"].replace("2", "4") + prose))
    got = [(r.doc_id, r.line, r.license, r.differences) for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert Counter(got) == Counter([*want, (1000, 0, "MIT", 0), (1000, 0, "MIT", 0)])


def test_cue_lines_of_the_tables(spark):
    x = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "All-rights-reserved", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    lines = Counter((r.doc_id, k, line) for r in x.select("doc_id", "text").collect() for k, line in enumerate((r.text or "").split("\n")) if re.search(licenses.CUE, line))
    assert lines and Counter((r.doc_id, r.line, r.license, r.differences) for r in licenses.licenses(x).collect()) == Counter({(i, k, want[line], 0): n for (i, k, line), n in lines.items()})
    full = [(1, licenses.TEMPLATES["Proprietary"]), (2, "Copyright 2020 Some One. All rights reserved. More text here.")]
    assert {(r.doc_id, r.license) for r in licenses.licenses(spark.createDataFrame(full, "doc_id long, text string")).collect()} == {(1, "Proprietary"), (2, "All-rights-reserved")}


def test_licenses_of_files_and_whole_texts():
    scanner, prose = licenses.Scanner(), "and the river ran past the old mill where nobody had lived for years " * 10
    for name, t in [*licenses.TEMPLATES.items(), *licenses.TEXTS]:
        w = t.split()
        comment = "/*\n" + "\n".join(" * " + " ".join(w[a : a + 9]) for a in range(0, len(w), 9)) + "\n */\n"
        for x in (prose + t + " " + prose, comment + prose):
            assert [(found, n) for found, _, n, _ in scanner.scan(x)] == [(name, 0)], t
    one = lambda t: [x[0] for x in scanner.scan(t)]
    assert one("// SPDX-License-Identifier: GPL-3.0-or-later") == ["GPL-3.0"] and one("# SPDX-License-Identifier: LGPL-3.0") == ["LGPL-3.0"]
    assert one("Released under the Apache License, Version 2.0.") == ["Apache-2.0"] and one("Distributed under the MIT license") == ["MIT"]
    assert one("Released under the BSD License.") == one("Released under the Eclipse License") == one("SPDX-License-Identifier: Other") == []


def test_licenses_by_brute_force():
    """The template found is the one with fewest differences over all windows of a text, laid on every template."""
    scanner, rng = licenses.Scanner(), random.Random(5)
    short = [k for k, w in enumerate(scanner.words) if len(w) <= 24]
    filler = "and the river ran past the old mill where nobody had lived for years".split()
    found = missed = 0
    for k in short * 2:
        t = [x.lower() if rng.random() < 0.5 else x for x in licenses._WORD.findall([*licenses.TEMPLATES.values(), *(t for _, t in licenses.TEXTS)][k])]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(t))
            if not re.search(licenses.CUE, t[at]):
                t[at : at + rng.randrange(2)] = rng.choice([[], ["river"]])
        text = " ".join(filler + t + filler)
        words, least = licenses.wording(text), {}
        for j in short:
            n = len(scanner.words[j])
            more = int(licenses.DIFFERENT * n)
            for a in range(len(words)):
                different, fixed, x, y = licenses.differences(scanner.words[j], words[max(0, a - more) : a + n + more])
                if y and not fixed and different <= licenses.DIFFERENT * n:
                    least[j] = min(least.get(j, different), different)
        got = scanner.scan(text)
        if not least:
            assert got == [], text
            missed += 1
            continue
        # of those with fewest differences, unless it lies inside a longer one
        (name, _, different, _) = got[0]
        assert len(got) == 1 and any(scanner.names[j] == name and n == different for j, n in least.items()), (text, got, least)
        assert different <= min(n for j, n in least.items() if len(scanner.words[j]) == max(len(scanner.words[i]) for i in least)), (text, got, least)
        found += 1
    assert found > 60 and missed > 5


def test_text_scan_matches_regex():
    from ledgerlake.llm import textops as T

    data, offsets = T.buffers(pa.array(TEXTS))
    low, s, e, at = T.words(data, offsets)
    got = [[bytes(low[a:b]).decode() for a, b in zip(s[i:j], e[i:j], strict=True)] for i, j in zip(at[:-1], at[1:], strict=True)]
    assert got == [words(t or "") for t in TEXTS]
