"""Operator 2, token ids in Re-Pair compressed shards.

Texts are dealt out by ranges of doc_id, encoded, and gathered into shards of about SHARD ids. In each shard the
frequent pairs of neighbouring ids become nonterminals, round after round, until no pair occurs LEAST times. A round
replaces all pairs that occur at least an eighth as often as the commonest one, so rounds grow with the depth of the
grammar, not with the number of rules. A shard record holds the rules, how many ids each rule expands to, the shortened
sequence, the place in the ids of every STEP-th symbol of it and the lengths of its documents: a run of ids is found by
its nearest marked symbol and decoded without the rest. Records are rows of a Parquet table (part, seq, base, n_tokens,
payload) in ascending (part, seq), which is ascending doc_id.

Strings of the tokenizer's added tokens in a text have their own ids, the library's default. A null text is empty, a null
doc_id sorts first, rows that share a doc_id stay side by side in the order of their text. A text of any length is in one
shard. Other columns are ignored; an empty table gives no shards.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import partitions, prefix_sums, prepare, save
from .encode import pieces

SHARD, LEAST, STEP = 2_000_000, 24, 1024
#: A round takes the pairs that occur at least this part as often as those of the round before.
FALL = 8
_MAGIC, _BITS = b"RPR3", 19
_SYMBOL = 31  # bits of a symbol in the key of a pair: more than a shard can have, since no text has 2^31 bytes


def _slots(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    h = (a * np.uint32(0x9E3779B1 + 2 * seed) + b * np.uint32(0x85EBCA77 + 6 * seed)) * np.uint32(0xC2B2AE3D)
    return (h >> np.uint32(32 - _BITS)).astype(np.int64)


def _frequent(s: np.ndarray, at: np.ndarray | None, seed: int, least: int, all_of_them: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, their places, which pair stands at each place) of pairs that occur `least` times or more among places `at`.

    Places are counted by hash slot first. Where not all pairs are asked for, a slot gives one; others wait for another seed.
    """
    a, b = (s[:-1], s[1:]) if at is None else (s[at], s[at + 1])
    slot = _slots(a, b, seed)
    hot = np.flatnonzero((np.bincount(slot, minlength=1 << _BITS) >= least)[slot])
    key = (a[hot].astype(np.int64) << _SYMBOL) | b[hot]
    if all_of_them:
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(key)))
        chosen = count >= least
        pairs = key[order[first[chosen]]]
        which = np.full(len(key), -1, np.int64)
        which[order] = np.repeat(np.where(chosen, np.cumsum(chosen) - 1, -1), count)
    else:
        slot = slot[hot]
        one = np.full(1 << _BITS, -1, np.int64)
        one[slot] = key
        mine = one[slot] == key
        chosen = np.flatnonzero(np.bincount(slot[mine], minlength=1 << _BITS) >= least)
        number = np.full(1 << _BITS, -1, np.int64)
        number[chosen] = np.arange(len(chosen))
        which, pairs = np.where(mine, number[slot], -1), one[chosen]
    use = which >= 0
    places = hot[use] if at is None else at[hot[use]]
    return pairs, places, which[use]


def compress(ids: np.ndarray, vocabulary: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(rules, sequence). Rule k is a pair of smaller symbols and is itself symbol vocabulary + k.

    Once all pairs that occur `least` times are replaced, only pairs with a symbol of the last round can be frequent.
    """
    s, rules, top, seed, fresh = ids.astype(np.uint32), [], vocabulary, 0, None
    level = max(least, int(np.bincount(_slots(s[:-1], s[1:], 0)).max()) // FALL) if len(s) > 1 else least
    while len(s) > least:
        if top + len(s) >= 1 << _SYMBOL:
            raise ValueError("too many symbols for one shard")
        at = None
        if fresh is not None:
            new = s >= fresh
            at = np.flatnonzero(new[:-1] | new[1:])
        pairs, at, which = _frequent(s, at, seed, level, level == least)
        seed += 1
        if not len(pairs):
            if level == least:
                break
            level = max(least, level // FALL)
            continue
        if level == least:
            fresh = top
        level = max(least, level // FALL)
        # of overlapping pairs every other one, from the left
        run = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
        if len(run) < len(at):
            keep = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0
            at, which = at[keep], which[keep]
        rules.append(np.stack([pairs >> _SYMBOL, pairs & ((1 << _SYMBOL) - 1)], 1))
        s[at] = (which + top).astype(np.uint32)
        top += len(pairs)
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s = s[keep]
    return _used(np.concatenate(rules), s, vocabulary) if rules else (np.zeros((0, 2), np.int64), s)


def _used(rules: np.ndarray, s: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Without rules that nothing refers to: neighbours may have taken all places of a pair."""
    live = np.zeros(len(rules), bool)
    live[s[s >= vocabulary].astype(np.int64) - vocabulary] = True
    for k in range(len(rules) - 1, -1, -1):
        if live[k]:
            for x in rules[k].tolist():
                if x >= vocabulary:
                    live[x - vocabulary] = True
    if live.all():
        return rules, s
    to = np.append(np.arange(vocabulary), vocabulary + np.cumsum(live) - 1)
    return to[rules[live]], to[s].astype(np.uint32)


def expand(rules: np.ndarray, sequence: np.ndarray, vocabulary: int) -> np.ndarray:
    """Ids of a sequence, level by level."""
    s = sequence.astype(np.int64)
    while len(s) and (big := s >= vocabulary).any():
        to = np.cumsum(1 + big) - 1 - big
        out = np.empty(len(s) + int(big.sum()), np.int64)
        out[to[~big]] = s[~big]
        pair = rules[s[big] - vocabulary]
        out[to[big]], out[to[big] + 1] = pair[:, 0], pair[:, 1]
        s = out
    return s


def spans(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """How many ids each rule expands to."""
    n: list[int] = []
    for a, b in rules.tolist():
        n.append((n[a - vocabulary] if a >= vocabulary else 1) + (n[b - vocabulary] if b >= vocabulary else 1))
    return np.array(n, np.int64)


def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, vocabulary: int, nulls: int = 0) -> bytes:
    """A payload. The first `nulls` of the doc_ids are null, whatever stands there."""
    rules, s = compress(ids, vocabulary)
    n = spans(rules, vocabulary)
    size = np.append(np.ones(vocabulary, np.int64), n)[s]
    marks = (np.cumsum(size) - size)[::STEP]
    wide = "<u2" if vocabulary + len(rules) < 65536 else "<u4"
    parts = [doc_ids.astype("<i8"), lengths.astype("<i8"), rules.astype("<u4"), n.astype("<i8"), marks.astype("<i8"), s.astype(wide)]
    return _MAGIC + struct.pack("<6Q", vocabulary, len(doc_ids), nulls, len(rules), len(s), len(ids)) + b"".join(x.tobytes() for x in parts)


class Shard:
    """A payload that is decoded as far as asked."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not a shard")
        self.vocabulary, docs, self.nulls, rules, n, self.n_tokens = struct.unpack_from("<6Q", data, 4)
        at = 52

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, count, at)
            at += x.nbytes
            return x

        self.doc_ids, self.lengths = take("<i8", docs), take("<i8", docs)
        self.rules, self.spans = take("<u4", 2 * rules).astype(np.int64).reshape(-1, 2), take("<i8", rules)
        self.marks = take("<i8", -(-n // STEP))
        self.sequence = take("<u2" if self.vocabulary + rules < 65536 else "<u4", n)

    def ids(self) -> np.ndarray:
        """All ids: each rule is expanded once, then symbols take their runs of ids."""
        pool = np.append(np.arange(self.vocabulary), expand(self.rules, self.vocabulary + np.arange(len(self.rules)), self.vocabulary)).astype(np.uint32)
        size = np.append(np.ones(self.vocabulary, np.int64), self.spans)
        first = np.cumsum(size) - size
        n = size[self.sequence]
        at = np.arange(self.n_tokens)
        at += np.repeat(first[self.sequence] - np.cumsum(n) + n, n)
        return pool[at]

    def slice(self, start: int, length: int) -> np.ndarray:
        """Ids start .. start + length: from the marked symbol before them on, expanding only the symbols that cover them."""
        if not length:
            return np.zeros(0, np.int64)
        a = (int(np.searchsorted(self.marks, start, "right")) - 1) * STEP
        b = int(np.searchsorted(self.marks, start + length, "left")) * STEP
        s = self.sequence[a:b].astype(np.int64)
        size = np.ones(len(s), np.int64)
        big = s >= self.vocabulary
        size[big] = self.spans[s[big] - self.vocabulary]
        ends = np.cumsum(size) + int(self.marks[a // STEP])
        x, y = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + length, "left") + 1
        skip = start - int(ends[x] - size[x])
        return expand(self.rules, s[x:y], self.vocabulary)[skip : skip + length]


def write_shards(docs: DataFrame, path: str, end_id: int, shard: int = SHARD) -> DataFrame:
    """The shard table of docs(doc_id, text), written to the shared folder; `path` is the tokenizer file."""
    prepare(docs.sparkSession)

    def run(batches):
        part, seq, base = TaskContext.get().partitionId(), 0, 0
        coder = pieces(path)
        from tokenizers import Tokenizer

        vocabulary = max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1)
        end = np.array([end_id], np.uint32)
        ids, sizes, found, n = [], [], [], 0

        def flush():
            payload = pack(np.array([i or 0 for i in ids], np.int64), np.array(sizes, np.int64), np.concatenate(found), vocabulary, ids.count(None))
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([base], pa.int64()), pa.array([n], pa.int64()), pa.array([payload], pa.large_binary())], names=["part", "seq", "base", "n_tokens", "payload"])

        for batch in batches:
            doc_ids = T.rows_with(batch, "doc_id").to_pylist()
            for a, b, all_ids, at in coder.column(T.rows_with(batch, "text")):
                at = at.tolist()
                for k in range(b - a):
                    ids.append(doc_ids[a + k])  # nulls come first
                    sizes.append(at[k + 1] - at[k] + 1)
                    found += [all_ids[at[k] : at[k + 1]], end]
                    n += sizes[-1]
                    if n >= shard:
                        yield flush()
                        seq, base = seq + 1, base + n
                        ids, sizes, found, n = [], [], [], 0
        if ids:
            yield flush()

    x = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return save(x.mapInArrow(run, "part int, seq int, base long, n_tokens long, payload binary"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 decoded from a shard table."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = prefix_sums(totals, "part", "n", "before").select("part", "before")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row["payload"])
                ids = memoryview(s.ids().astype("<u4", copy=False))
                ends = np.cumsum(s.lengths)
                at = ends - s.lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch(
                    [pa.array(s.doc_ids, mask=np.arange(len(s.doc_ids)) < s.nulls), pa.array(at + row["base"] + row["before"]), pa.array(s.lengths), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.select("part", "base", "payload").join(F.broadcast(before), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
