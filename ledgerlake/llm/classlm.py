"""Operator 9, a class-based bigram model in the manner of Brown.

1. Training words are counted by 64-bit hash in each batch, then summed by hash.
2. The FREQUENT commonest words, the core, are assigned to CLASSES classes by exchange: words move to the class that raises the
   likelihood of the class bigrams most, until a sweep moves none. Their bigram counts (at most FREQUENT squared numbers) come from all
   training text.
3. Every other training word that occurs LEAST times goes to the class that raises the same likelihood most, given the core's
   class bigrams: what stands before and after each occurrence meets by word in a shuffle of packed blocks. Words seen once stay in
   the open class, which stands for words never seen as well; the end of a text is a class of its own.
4. A token has probability P(class | class before) * P(word | class): transitions, counted over all training text by the classes of
   all words, interpolated with the class distribution, emissions by relative frequency, in the open class with absolute discounting
   whose mass goes to the one slot of unknown words. So the probabilities of all known words and of "unknown" sum to 1 after any history.

The KNOWN commonest words with their counts and classes are broadcast (20 bytes each, a fixed bound); occurrences of the others meet
their counts and classes by a shuffle of packed (row, place, hash) blocks, so nothing that grows with the corpus goes through one place.
The number of buckets grows with the training tokens.

Null and empty texts are the end token alone. Null doc_ids count as held in. Rows that share a doc_id are scored each.
Without training rows every word is unknown and scores are those of an empty model. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import HashIndex, id_crc, partitions, prepare, save

FREQUENT, CLASSES, KNOWN, SWEEPS = 1000, 48, 1_000_000, 12
#: Occurrences from which on a word has a class: words seen once are the model of words not seen.
LEAST = 2
#: Training tokens in a bucket, on average and at most.
BUCKET = 4_000_000


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each word: greedy exchange on the log likelihood of class bigrams.

    The last two rows and columns (other words, end of text) keep classes of their own.
    """
    n = len(bigrams) - 2
    k = min(classes, max(1, n))
    of = np.empty(n + 2, np.int64)
    of[:n] = np.arange(n) % k
    of[n:] = k, k + 1
    c = k + 2
    side = np.zeros((n + 2, c))
    side[np.arange(n + 2), of] = 1
    table = side.T @ bigrams @ side
    f = _xlogx
    for _ in range(sweeps):
        moved = 0
        out_c, in_c = bigrams @ side, (side.T @ bigrams).T
        for w in range(n):
            a, loop = of[w], bigrams[w, w]
            o, i = out_c[w].copy(), in_c[w].copy()
            o[a] -= loop
            i[a] -= loop
            base = table.copy()  # without w
            base[a] -= o
            base[:, a] -= i
            base[a, a] -= loop
            # gain of adding w to each class: its row, its column, their crossing, the margins
            rows = f(base + o[None, :]).sum(1) - f(base).sum(1)
            cols = f(base + i[:, None]).sum(0) - f(base).sum(0)
            d = np.arange(c)
            cell = base[d, d]
            cross = f(cell + o + i + loop) - f(cell + o) - f(cell + i) + f(cell)
            # what comes before and after w counts in the margins wherever w goes
            left, right = base.sum(1) + i, base.sum(0) + o
            total_o, total_i = o.sum() + loop, i.sum() + loop
            gain = rows + cols + cross - (f(left + total_o) - f(left)) - (f(right + total_i) - f(right))
            b = int(np.argmax(gain[:k]))
            if gain[b] <= gain[a] + 1e-9:
                continue
            table = base
            table[b] += o
            table[:, b] += i
            table[b, b] += loop
            side[w, a], side[w, b], of[w] = 0, 1, b
            out_c[:, a] -= bigrams[:, w]
            out_c[:, b] += bigrams[:, w]
            in_c[:, a] -= bigrams[w]
            in_c[:, b] += bigrams[w]
            moved += 1
        if not moved:
            break
    return of


class Placer:
    """Best class of words outside the core, by the gain of exchange() against the core's class bigrams.

    `moves` counts class bigrams with all these words in the open class, the last but one; the end of a text is the last.
    """

    def __init__(self, moves: np.ndarray, top: int = 32):
        self.t, self.c, self.k, self.top = moves, len(moves), len(moves) - 2, top
        n, t = np.arange(1, top + 1)[:, None, None], moves[:, : self.k]
        self.cols = _xlogx(t + n) - _xlogx(t)  # by count, class of the neighbour, class
        t = moves[: self.k].T
        self.rows = _xlogx(t + n) - _xlogx(t)

    def _sides(self, counts: np.ndarray, small: np.ndarray, t: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Gain of a row (or column) of t(neighbour, class); the open class has lost `other`, the word's own bigrams."""
        k, out = self.k, np.zeros((len(counts), self.k))
        most = counts[:, : self.c].copy()
        most[:, k] = 0
        w, j = np.nonzero(most)
        n = most[w, j]
        for a in range(0, len(w), 50_000):
            wa, ja, na = w[a : a + 50_000], j[a : a + 50_000], n[a : a + 50_000].astype(np.int64)
            gain = small[np.minimum(na, self.top) - 1, ja]
            big = np.flatnonzero(na > self.top)
            gain[big] = _xlogx(t[ja[big]] + na[big, None]) - _xlogx(t[ja[big]])
            first = np.flatnonzero(np.append(True, wa[1:] != wa[:-1]))
            out[wa[first]] += np.add.reduceat(gain, first, axis=0)
        own = t[k] - other
        return out + _xlogx(own + counts[:, k : k + 1]) - _xlogx(own)

    def gains(self, word: np.ndarray, before: np.ndarray, after: np.ndarray, n: int) -> np.ndarray:
        """(n, classes) gains of words 0 to n - 1 from their occurrences; a neighbour of class len(moves) is the word itself."""
        table = lambda side: np.bincount(word * (self.c + 1) + side, minlength=n * (self.c + 1)).reshape(n, -1).astype(float)
        i, o, k, f = table(before), table(after), self.k, _xlogx
        total, loop, cell = o.sum(1, keepdims=True), o[:, -1:], np.diag(self.t)[:k]
        gain = self._sides(o, self.rows, self.t[:k].T, i[:, :k]) + self._sides(i, self.cols, self.t[:, :k], o[:, :k])
        gain += f(cell + o[:, :k] + i[:, :k] + loop) - f(cell + o[:, :k]) - f(cell + i[:, :k]) + f(cell)
        for margin in (self.t.sum(1)[:k], self.t.sum(0)[:k]):
            gain -= f(margin + total) - f(margin)
        return gain

    def place(self, word: np.ndarray, before: np.ndarray, after: np.ndarray, n: int) -> np.ndarray:
        """Class of words 0 to n - 1; `word` is in order."""
        c = np.bincount(word, minlength=n)
        out, at = np.full(n, self.k, np.int32), np.append(0, np.cumsum(c))
        for a in range(0, n, 4096):
            b = min(n, a + 4096)
            part = slice(at[a], at[b])
            often = np.flatnonzero(c[a:b] >= LEAST)
            to = np.full(b - a, -1, np.int64)
            to[often] = np.arange(len(often))
            mine = to[word[part] - a]
            use = mine >= 0
            if len(often):
                out[a + often] = self.gains(mine[use], before[part][use], after[part][use], len(often)).argmax(1)
        return out


def _tokens(batch: pa.RecordBatch):
    data, offsets = T.buffers(T.rows_with(batch, "text"))
    for a, b, d, o in T.chunks(data, offsets):
        low, s, e, at = T.words(d, o)
        yield a, b, T.hashes(low, s, e), at


def _trains(batch: pa.RecordBatch) -> np.ndarray:
    return ~T.rows_with(batch, "held_out").to_numpy(zero_copy_only=False)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(hash, c) of words in training rows of docs(text, held_out): counted in each batch, then by a plain aggregation."""

    def count(batches):
        for batch in batches:
            train = _trains(batch)
            found = [h[np.repeat(train[a:b], np.diff(at))] for a, b, h, at in _tokens(batch)]
            h, c = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["hash", "c"])

    return docs.mapInArrow(count, "hash long, c long").groupBy("hash").agg(F.sum("c").alias("c"))


def bigram_counts(docs: DataFrame, index: HashIndex) -> np.ndarray:
    """Counts of neighbours among the indexed words, other words and the end of a text, over all training rows."""
    n = index.n
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches):
        size, total = (n + 2) ** 2, None
        for batch in batches:
            train = _trains(batch)
            total = np.zeros(size, np.int64) if total is None else total
            for a, b, h, at in _tokens(batch):
                now, before = _with_ends(shared.value.find(h), at, n)
                keep = np.repeat(train[a:b], np.diff(at) + 1)
                total += np.bincount(before[keep] * (n + 2) + now[keep], minlength=size)
        if total is not None:
            some = np.flatnonzero(total)
            for k in range(0, len(some), 50_000):
                yield pa.record_batch([pa.array(some[k : k + 50_000]), pa.array(total[some[k : k + 50_000]])], names=["cell", "n"])

    rows = docs.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((n + 2) ** 2)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(n + 2, n + 2)


def _with_ends(found: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all tokens, each text followed by its end, and the number before each (first: the end)."""
    ends = at[1:] + np.arange(len(at) - 1)
    now = np.empty(len(found) + len(at) - 1, np.int64)
    word = np.ones(len(now), bool)
    word[ends] = False
    now[word] = np.where(found < 0, n, found)
    now[ends] = n + 1
    before = np.empty_like(now)
    before[0:1] = n + 1
    before[1:] = now[:-1]
    return now, before


def _packed(h: np.ndarray, buckets: int, *columns: np.ndarray) -> tuple[list[int], list[pa.Array]]:
    """Buckets that some of the hashes h fall in, and for each column the bytes of each bucket's values."""
    to = h % np.uint64(buckets)
    order = np.argsort(to, kind="stable")
    cut = np.append(0, np.flatnonzero(np.diff(to[order])) + 1) if len(h) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(h))
    some = to[order[cut]].astype(np.int32).tolist()
    return some, [pa.array([x[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()) for x in (y[order] for y in columns)] if some else [pa.array([], pa.binary()) for _ in columns]


def place_others(docs: DataFrame, core: HashIndex, of: np.ndarray, moves: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, hash, c, class) of all words of training rows outside the core; `of` are classes of the core, other words, the end."""
    n, itself = core.n, len(moves)
    shared = docs.sparkSession.sparkContext.broadcast((core, of, moves))

    def give(batches):
        index, of, _ = shared.value
        for batch in batches:
            train = _trains(batch)
            hs, codes = [], []
            for a, b, h, at in _tokens(batch):
                now, before = _with_ends(index.find(h), at, n)
                full = np.zeros(len(now), np.uint64)
                full[now != n + 1] = h
                at_now = np.flatnonzero((now == n) & np.repeat(train[a:b], np.diff(at) + 1))
                own = full[at_now]
                left, right = of[before[at_now]], of[now[at_now + 1]]  # a text's end follows its last word
                left[(before[at_now] == n) & (full[at_now - 1] == own)] = itself
                right[(now[at_now + 1] == n) & (full[at_now + 1] == own)] = itself
                hs.append(own)
                codes.append((left * (itself + 1) + right).astype(np.uint32))
            if hs:
                h, code = np.concatenate(hs), np.concatenate(codes)
                code = code.astype(np.uint16) if (itself + 1) ** 2 <= 1 << 16 else code
                some, packed = _packed(h, buckets, h, code)
                yield pa.record_batch([pa.array(some, pa.int32()), *packed], names=["bucket", "h", "code"])

    def place(part):
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in part["h"].to_pylist()])
        code = np.concatenate([np.frombuffer(x, np.uint16 if (itself + 1) ** 2 <= 1 << 16 else np.uint32) for x in part["code"].to_pylist()])
        order = np.argsort(h, kind="stable")
        h, code = h[order], code[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        c = np.diff(np.append(first, len(h)))
        cls = Placer(shared.value[2]).place(np.repeat(np.arange(len(c)), c), code // (itself + 1), code % (itself + 1), len(c))
        return pa.table({"bucket": pa.array(np.full(len(c), part["bucket"][0].as_py(), np.int32)), "hash": h[first].view(np.int64), "c": c.astype(np.int64), "class": cls})

    return docs.mapInArrow(give, "bucket int, h binary, code binary").groupBy("bucket").applyInArrow(place, "bucket int, hash long, c long, class int")


def _kinds(batch: pa.RecordBatch, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all tokens of a batch, and each row's offsets into these."""
    column = T.rows_with(batch, "kinds").to_pylist()
    return np.frombuffer(b"".join(column), dtype).astype(np.int64), np.append(0, np.cumsum([len(x) for x in column], dtype=np.int64)) // np.dtype(dtype).itemsize


def score(docs: DataFrame, modulus: int = 7, held: int = 2, frequent: int = FREQUENT, classes: int = CLASSES, known: int = KNOWN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs(doc_id, text)."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(id_crc("doc_id") % modulus == held, F.lit(False)).alias("held_out"))
    vocab = save(vocabulary(docs), "vocabulary")
    sums = vocab.agg(F.sum("c"), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    texts = docs.where("not held_out").count()
    total, distinct, once, twice = (sums[0] or 0) + texts, sums[1] + (texts > 0), sums[2], sums[3]
    slot = lambda x: F.floor(16 * F.log2(x))
    steps = {r["s"]: r["n"] for r in vocab.groupBy(slot(F.col("c")).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, held_n = 0, sum(steps.values())
    for s in sorted(steps):  # the least slot from which on at most `known` words are left
        if held_n <= known:
            break
        held_n -= steps[s]
        least = s + 1
    at_hand = vocab.where(slot(F.col("c")) >= least).select("hash", "c").toArrow()
    hand, hand_c = at_hand["hash"].to_numpy().view(np.uint64), at_hand["c"].to_numpy()
    order = np.lexsort((hand, -hand_c))[:frequent]
    common, n_common = hand[order], len(order)
    table = bigram_counts(docs, HashIndex(common))
    of = exchange(table, classes)
    n_class = int(of[-1]) + 1
    opened = n_class - 2
    side = np.zeros((len(of), n_class))
    side[np.arange(len(of)), of] = 1
    buckets = partitions(spark) * max(1, -(-int(total) // (partitions(spark) * BUCKET)))
    words = save(place_others(docs, HashIndex(common), of, side.T @ table @ side, buckets), "classes")
    class_c = np.bincount(of[:n_common], weights=hand_c[order], minlength=n_class)
    open_n = open_v = 0
    for r in words.groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():  # a row for each class
        class_c[r["class"]] += r["c"]
        if r["class"] == opened:
            open_n, open_v = r["c"], r["n"]
    discount = once / (once + 2.0 * twice) if once and twice else 0.5
    unknown = np.log10(discount * open_v / open_n) if open_v else 0.0
    base_0 = np.log10(total + distinct + 1.0) if total else 0.0

    def emission(c, cls):
        return np.where(cls == opened, np.log10(np.maximum(c - discount, 1e-9) / max(open_n, 1)), np.log10(np.maximum(c, 1) / np.maximum(class_c[cls], 1)))

    near = words.where(slot(F.col("c")) >= least).select("hash", "c", "class").toArrow()
    hand = np.concatenate([common, near["hash"].to_numpy().view(np.uint64)])
    hand_c = np.concatenate([hand_c[order], near["c"].to_numpy()])
    hand_cls = np.concatenate([of[:n_common], near["class"].to_numpy()]).astype(np.int32)
    all_at_hand = least == 0
    kind_type = np.uint8 if n_class <= 256 else np.uint32
    shared = spark.sparkContext.broadcast((HashIndex(hand), hand_c, hand_cls))

    def code(batches):
        index, counts, cls = shared.value
        # the last stands for words not at hand
        log_base, log_emit, cls = np.append(np.log10(counts + 1.0), 0.0), np.append(emission(counts, cls), unknown), np.append(cls, opened).astype(kind_type)
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, held = T.rows_with(batch, "doc_id"), T.rows_with(batch, "held_out")
            for a, b, h, at in _tokens(batch):
                found = index.find(h)
                have = found >= 0
                of_row = np.repeat(np.arange(b - a), np.diff(at))
                known, base, s = (np.bincount(of_row, weights=x, minlength=b - a) for x in (have, log_base[found], log_emit[found]))
                kinds, n = cls[found], np.diff(at) + 1
                key = (np.int64(part) << np.int64(36)) + row + np.arange(b - a)
                row += b - a
                empty = pa.nulls(b - a, pa.binary())
                yield pa.record_batch(
                    [pa.array(key), ids.slice(a, b - a), held.slice(a, b - a), pa.array(n), pa.array(known.astype(np.int64) + (texts > 0)), pa.array(base + np.log10(texts + 1.0) - n * base_0), pa.array(s), pa.array([kinds[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.nulls(b - a, pa.int32()), empty, empty, empty],
                    names=_NAMES,
                )
                if all_at_hand or have.all():
                    continue
                rare = np.flatnonzero(~have)
                some, packed = _packed(h[rare], buckets, key[of_row[rare]], rare - np.asarray(at)[of_row[rare]], h[rare])
                yield pa.record_batch([*(pa.nulls(len(some), t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())), pa.array(some, pa.int32()), *packed], names=_NAMES)

    both = save(docs.mapInArrow(code, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, kinds binary, bucket int, rows binary, places binary, hashes binary"), "coded")
    coded = both.where("bucket is null").drop("bucket", "rows", "places", "hashes")

    def lookup(left, right):
        if not len(left):
            return pa.table({"row": pa.array([], pa.int64()), "k": pa.array([], pa.int64()), "b": pa.array([], pa.float64()), "s": pa.array([], pa.float64()), "places": pa.array([], pa.binary()), "found": pa.array([], pa.binary())})
        rows, places = (np.concatenate([np.frombuffer(x, np.int64) for x in left[name].to_pylist()]) for name in ("rows", "places"))
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in left["hashes"].to_pylist()])
        found = HashIndex(right["hash"].to_numpy().view(np.uint64)).find(h)
        some = np.flatnonzero(found >= 0)
        some = some[np.argsort(rows[some], kind="stable")]
        rows, places, c, cls = rows[some], places[some], right["c"].to_numpy()[found[some]], right["class"].to_numpy()[found[some]]
        u, first, back = np.unique(rows, return_index=True, return_inverse=True)
        ends, kinds = np.append(first[1:], len(rows)), cls.astype(kind_type)
        sums = [np.bincount(back, weights=x, minlength=len(u)) for x in (np.log10(c + 1.0), emission(c, cls) - unknown)]
        return pa.table({"row": u, "k": ends - first, "b": sums[0], "s": sums[1], "places": pa.array([places[x:y].tobytes() for x, y in zip(first, ends, strict=True)], pa.binary()), "found": pa.array([kinds[x:y].tobytes() for x, y in zip(first, ends, strict=True)], pa.binary())})

    def fill(batches):
        for batch in batches:
            kinds = T.rows_with(batch, "kinds").to_pylist()
            for r, more in enumerate(batch.column(batch.schema.get_field_index("more")).to_pylist()):
                if more:
                    own = np.frombuffer(kinds[r], kind_type).copy()
                    for x in more:
                        own[np.frombuffer(x["places"], np.int64)] = np.frombuffer(x["found"], kind_type)
                    kinds[r] = own.tobytes()
            keep = [c for c in batch.schema.names if c not in ("kinds", "more")]
            yield pa.record_batch([*(T.rows_with(batch, c) for c in keep), pa.array(kinds, pa.binary())], names=[*keep, "kinds"])

    if not all_at_hand:
        rest = words.where(slot(F.col("c")) < least)
        asked = both.where("bucket is not null").select("bucket", "rows", "places", "hashes")
        more = asked.groupBy("bucket").cogroup(rest.groupBy("bucket")).applyInArrow(lookup, "row long, k long, b double, s double, places binary, found binary")
        more = more.groupBy("row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s"), F.collect_list(F.struct("places", "found")).alias("more"))
        plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        coded = coded.join(more, "row", "left").select("doc_id", "held_out", "n_tokens", plus("n_known", "k"), plus("base_score", "b"), plus("score", "s"), "kinds", "more")
        coded = save(coded.mapInArrow(fill, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, kinds binary"), "filled")

    def count(batches):
        sums = np.zeros(n_class**2, np.int64)
        for batch in batches:
            now, before = _with_ends(*_kinds(batch, kind_type), opened)
            sums += np.bincount(before * n_class + now, minlength=n_class**2)
        yield pa.record_batch([pa.array(np.flatnonzero(sums)), pa.array(sums[sums > 0])], names=["cell", "n"])

    cells = coded.where("not held_out").select("kinds").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    moves = np.zeros(n_class**2)
    moves[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    moves = moves.reshape(n_class, n_class)
    into = moves.sum(0) + 1.0 / n_class
    prior = into / into.sum()
    moves = np.log10((moves + 5.0 * prior) / (moves.sum(1, keepdims=True) + 5.0))

    def run(batches):
        for batch in batches:
            kinds, at = _kinds(batch, kind_type)
            now, before = _with_ends(kinds, at, opened)
            more = np.bincount(np.repeat(np.arange(len(at) - 1), np.diff(at) + 1), weights=moves[before, now], minlength=len(at) - 1)
            keep = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
            yield pa.record_batch([*(T.rows_with(batch, c) for c in keep), pa.array(T.rows_with(batch, "score").to_numpy() + more)], names=[*keep, "score"])

    scored = coded.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "kinds").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


_NAMES = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "kinds", "bucket", "rows", "places", "hashes"]
