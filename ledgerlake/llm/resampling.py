"""Operator 13, importance resampling towards a target distribution, with overlap chunking of long texts.

A text longer than CHUNK bytes is split at word boundaries into chunks that carry the next n - 1 words of the text, too. A
chunk owns the starting positions of its own words, so every run of 1 to n words is counted by exactly one chunk; chunks are
rows of their own and counts and weights are summed by document. What a task holds at once is a chunk, however long a text is
(only the split itself reads a long text as a whole, in steps of CHUNK).

Features are runs of 1 to n words; the bucket of a feature is the crc32 of its bytes modulo BUCKETS. The checksum of a run is
made from those of its words: going on over len bytes is a linear map of the register, kept as tables for each power of two.
All documents and the whole target are counted bucket by bucket inside the tasks; the gains of the BUCKETS buckets are the
only thing that the driver sees. A document's weight is the sum of its features' gains, its score adds Gumbel noise that a hash of
doc_id gives, and the highest scores are drawn: all rows are sorted by range, numbered inside a range, and the ranges'
sizes are summed, so no task sorts them all.

Words are runs of letters and digits of ASCII and of all other characters from U+0080 on; A-Z are lower-cased. A null or
empty text has no words, weight 0, and isn't drawn (fewer than `least` words). A null doc_id is hashed as an empty id and
comes before all others among equal scores. Rows that share a doc_id are documents of their own; rows that are equal in all
that ranks may take each other's place. An empty table gives no rows; an empty target counts nothing. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import partitions, prefix_sums, prepare, save

BUCKETS, SIZE, LEAST, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Bytes of a chunk of a long text, about.
CHUNK = 1 << 16

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _table() -> np.ndarray:
    """Register after one byte, by the register's low byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


_BYTE = _table()


def _steps(powers: int = 40) -> list[np.ndarray]:
    """For each k four tables, by byte of the register: the register after 2 ** k zero bytes."""
    one = np.zeros((4, 256), np.uint32)
    for b in range(4):
        r = np.arange(256, dtype=np.uint32) << np.uint32(8 * b)
        one[b] = _BYTE[r & np.uint32(255)] ^ (r >> np.uint32(8))
    out = [one]
    for _ in range(powers - 1):
        last = out[-1]
        out.append(np.stack([_apply(last, last[b]) for b in range(4)]))
    return out


def _apply(t: np.ndarray, r: np.ndarray) -> np.ndarray:
    return t[0][r & np.uint32(255)] ^ t[1][(r >> np.uint32(8)) & np.uint32(255)] ^ t[2][(r >> np.uint32(16)) & np.uint32(255)] ^ t[3][r >> np.uint32(24)]


_POWERS = _steps()


def forward(r: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Registers after `length` zero bytes each."""
    r = r.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        some = np.flatnonzero(length >> k & 1)
        r[some] = _apply(_POWERS[k], r[some])
    return r


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, first and end byte of each word, and each row's offsets into the words."""
    low = _LOWER[data]
    inside = np.append(_WORD[low], False)
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    before = np.append(False, inside[:-1])
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return low, starts, ends, np.searchsorted(starts, offsets)


def registers(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The register over the bytes of each word, begun at zero: distinct words are read byte by byte, all at once."""
    length = ends - starts
    _, first, back = np.unique(T.hashes(low, starts, ends), return_index=True, return_inverse=True)
    order = np.argsort(-length[first], kind="stable")
    s, n = starts[first][order], length[first][order]
    r = np.zeros(len(s), np.uint32)
    for k in range(int(n.max(initial=0))):
        live = int(np.searchsorted(-n, -k, "left"))  # those longer than k
        r[:live] = _BYTE[(r[:live] ^ low[s[:live] + k]) & np.uint32(255)] ^ (r[:live] >> np.uint32(8))
    out = np.empty(len(s), np.uint32)
    out[order] = r
    return out[back]


def buckets(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, size: int = SIZE, modulus: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(first word, bucket) of every run of 1 to `size` words that stays in its row."""
    n = len(starts)
    own, length = registers(low, starts, ends), ends - starts
    # a word after a space: the space's register, carried over the word
    space = _BYTE[(0 ^ 0x20) & 255]
    spaced = forward(np.full(n, space, np.uint32), length) ^ own
    r = forward(np.full(n, 0xFFFFFFFF, np.uint32), length) ^ own
    end = np.repeat(at[1:], np.diff(at))
    first, found = [np.arange(n)], [(~r) % np.uint32(modulus)]
    i = first[0]
    for k in range(1, size):
        more = i + k < end[i]
        i, r = i[more], r[more]
        r = forward(r, length[i + k] + 1) ^ spaced[i + k]
        first.append(i)
        found.append((~r) % np.uint32(modulus))
    return np.concatenate(first), np.concatenate(found).astype(np.int64)


def cut_long(text: bytes, chunk: int = CHUNK, carry: int = SIZE - 1):
    """(piece, own words) of a text: pieces end between words and go on with the next `carry` words, which they don't own."""
    a, n = 0, len(text)
    while a < n:
        b = min(n, a + chunk)
        while b < n and _WORD[_LOWER[text[b]]] and _WORD[_LOWER[text[b - 1]]]:
            b += 1
        e = b
        for _ in range(carry):
            while e < n and not _WORD[_LOWER[text[e]]]:
                e += 1
            while e < n and _WORD[_LOWER[text[e]]]:
                e += 1
        own = len(words(np.frombuffer(text, np.uint8, b - a, a), np.array([0, b - a]))[1])
        yield text[a:e], own
        a = b


def pieces(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(row, doc_id, piece, own): short texts as they are, with neither row nor own; long ones cut, under a number of their row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    x = docs.select(F.col("doc_id").cast("long"), text.cast("binary").alias("piece"))
    short = x.where(F.octet_length("piece") <= chunk).select(F.lit(None).cast("long").alias("row"), "doc_id", "piece", F.lit(None).cast("long").alias("own"))
    schema = "row long, doc_id long, piece binary, own long"

    def cut(batches):
        seen = 0
        for b in batches:
            for doc_id, piece in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                row = (TaskContext.get().partitionId() << 40) + seen
                seen += 1
                out, size = [], 0
                for part in cut_long(piece.as_py(), chunk):
                    out.append(part)
                    size += len(part[0])
                    if size > 64 * chunk:
                        yield pa.RecordBatch.from_arrays([pa.array([row] * len(out)), pa.array([doc_id] * len(out), pa.int64()), pa.array([p for p, _ in out], pa.binary()), pa.array([o for _, o in out], pa.int64())], names=["row", "doc_id", "piece", "own"])
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(out)), pa.array([doc_id] * len(out), pa.int64()), pa.array([p for p, _ in out], pa.binary()), pa.array([o for _, o in out], pa.int64())], names=["row", "doc_id", "piece", "own"])

    # written: rows keep their numbers; dealt out anew, so the chunks of one text go to many tasks
    long = save(x.where(F.octet_length("piece") > chunk).mapInArrow(cut, schema).repartition(partitions(spark), F.xxhash64("row", F.md5("piece"))), "chunks")
    return short.unionByName(long)


def _features(column: pa.Array, own: list):
    """(rows, first row, row of each feature, bucket of each feature, words of each row) of pieces in runs of about T.CHUNK bytes."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    limit = np.array([-1 if o is None else o for o in own], np.int64)
    for a, b, d, o in T.chunks(data, offsets - offsets[0]):
        low, s, e, at = words(d, o)
        n = np.diff(at)
        kept = np.where(limit[a:b] < 0, n, np.minimum(n, limit[a:b]))
        first, bucket = buckets(low, s, e, at)
        row = np.searchsorted(at, first, "right") - 1 if len(first) else first
        mine = first - at[row] < kept[row] if len(first) else np.zeros(0, bool)
        yield b - a, a, row[mine], bucket[mine], kept


def bucket_counts(texts: DataFrame, modulus: int = BUCKETS) -> DataFrame:
    """(bucket, n) of pieces: each task counts all its texts and passes on at most `modulus` rows."""

    def count(batches):
        sums = np.zeros(modulus, np.int64)
        for b in batches:
            for *_, bucket, _ in _features(b.column(0), b.column(1).to_pylist()):
                sums += np.bincount(bucket, minlength=modulus)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["bucket", "n"])

    return texts.select("piece", "own").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The gain of each bucket from its counts in all documents and in the target."""
    m, all_s, all_t = len(s), int(s.sum()), int(t.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (all_s + m) / ((a + 1) * (all_t + m)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weighed(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): one row for each document of pieces, in no order."""
    shared = texts.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def weigh(batches):
        for b in batches:
            g = shared.value
            n, sums, size = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for rows, a, row, bucket, own in _features(b.column(2), b.column(3).to_pylist()):
                n[a : a + rows] = np.bincount(row, minlength=rows)
                at = np.searchsorted(np.sort(row), np.arange(rows + 1))
                total = np.append(0, np.cumsum(g[bucket[np.argsort(row, kind="stable")]]))
                sums[a : a + rows] = total[at[1:]] - total[at[:-1]]
                size[a : a + rows] = own
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size), pa.array(n), pa.array(sums)], names=["row", "doc_id", "n_words", "n_features", "weight"])

    found = texts.select("row", "doc_id", "piece", "own").mapInArrow(weigh, "row long, doc_id long, n_words long, n_features long, weight long")
    found = save(found, "weights")
    whole = found.where("row is null").drop("row")
    sums = found.where("row is not null").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.sum("n_features").alias("n_features"), F.sum("weight").alias("weight"))
    return whole.unionByName(sums.drop("row"))


def noise(doc_id, seed: int = SEED) -> F.Column:
    """Gumbel noise in thousandths, from the first 32 bits of sha256("seed:doc_id")."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000.0 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def numbered(scored: DataFrame, first: F.Column) -> DataFrame:
    """`place` from 1 in the order of (first, score descending, doc_id): sorted by range, numbered inside a range, ranges summed."""
    spark = scored.sparkSession
    # the last key parts rows that are equal in all others, so no range is larger than its share
    order = [first.desc(), F.desc("score"), F.asc("doc_id"), F.asc("part")]
    x = scored.withColumn("part", F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()))
    x = save(x, "scored").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    names = [f.name for f in scored.schema]

    def count(batches):
        seen = 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(np.full(n, TaskContext.get().partitionId(), np.int64)), pa.array(np.arange(seen + 1, seen + n + 1))], names=[*names, "range", "inside"])
            seen += n

    x = save(x.mapInArrow(count, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema) + ", range long, inside long"), "ranges")
    before = prefix_sums(x.groupBy("range").agg(F.count(F.lit(1)).alias("n")), "range", "n", "before").select("range", "before")
    # a row for each range: as many as shuffle partitions
    return x.join(F.broadcast(before), "range").select(*names, (F.col("before") + F.col("inside")).alias("place"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_features, weight, score, rank of docs(doc_id, text); rank is null where a document isn't drawn."""
    spark = docs.sparkSession
    prepare(spark)
    texts = pieces(docs, chunk)
    goal = pieces(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), chunk)

    def counts(x: DataFrame) -> np.ndarray:
        out, got = np.zeros(BUCKETS, np.int64), bucket_counts(x).toArrow()  # at most BUCKETS rows
        out[got["bucket"].to_numpy()] = got["n"].to_numpy()
        return out

    gain = gains(counts(texts), counts(goal))
    scored = weighed(texts, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    may = F.col("n_words") >= least
    ranked = numbered(scored, may)
    drawn = scored.where(may).count() * percent // 100
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(may & (F.col("place") <= drawn), F.col("place")).alias("rank"))


#: The same in SQL: crc32 from its table of 256 registers, for each distinct run of words. The polynomial and the contract's numbers.
ORACLE = r"""WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t),
texts AS (SELECT row_number() OVER () AS k, *, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT 0 AS target, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark)),
f AS (SELECT k, target, unnest(w) AS f FROM texts
 UNION ALL SELECT k, target, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM texts WHERE len(w) > 1
 UNION ALL SELECT k, target, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM texts WHERE len(w) > 2),
c AS (SELECT k, target, f, count(*) AS n FROM f GROUP BY 1, 2, 3),
u AS (SELECT f, xor(4294967295, list_reduce(list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT), lambda r, b: xor(t[(xor(r, b) & 255) + 1], r >> 8), 4294967295)) % 10000 AS bucket FROM (SELECT DISTINCT f FROM c), tab),
b AS (SELECT bucket, coalesce(sum(n) FILTER (target = 0), 0) AS s, coalesce(sum(n) FILTER (target = 1), 0) AS t FROM c JOIN u ON u.f = c.f GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE)) AS BIGINT) AS gain FROM b),
d AS (SELECT k, sum(n) AS n_features, sum(n * gain) AS weight FROM c JOIN u ON u.f = c.f JOIN g ON g.bucket = u.bucket WHERE target = 0 GROUP BY 1),
s AS (SELECT texts.k, doc_id, len(w) >= 20 AS may, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
 CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM texts LEFT JOIN d ON d.k = texts.k WHERE target = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) AS place, sum(may::INT) OVER () * 5 // 100 AS drawn FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= drawn THEN place END AS rank FROM r"""
