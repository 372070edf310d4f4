"""Operator 10, n-gram Jaccard join by grouped prefixes.

1. `shared_counts` sends a 32-bit key of each distinct shingle to the bucket of its hash, in packed blocks, and counts
   how many of a text's shingles some other text may have too. A text needs 80 % of them to link with another one, so
   the rest leaves here. A key that two shingles share by chance only keeps a text that could have left. What repeats
   inside a block is counted there and sent once, so a shingle of very many texts is a row for each block that has it;
   the number of buckets grows with the bytes of text.
2. What is left collapses by equal shingle sets into classes; a class of a million copies is one row from here on.
3. Shingles are put in order (rarest first, then by hash); two classes that link share one of the first
   size - ceil(0.8 size) + 1. Shingles of one class only lead that order and can't match, so only the others of the
   prefix are posted. Classes with the same posted prefix, size and component are one group.
4. Each posted shingle first joins its classes to one hub (the class most of whose shingles are common), and those
   that really link form components; then group pairs of different components in one posting, within the size bound,
   expand to class pairs and are verified on whole sets. Pairs inside one component add nothing to components.
No candidate is dropped: every pair that shares a posted shingle is verified, or already connected.

Shingles are 64-bit hashes of words that are 64-bit hashes, and classes are known by a 64-bit hash of their set: by chance two
of n distinct ones are equal with probability n * n / 2 ** 65, about 3 in 10 million for the classes of 10 ** 6 texts.

Nulls and empty texts: no shingles, linked with nothing. A null doc_id takes no part and has a null component. Rows that
share a doc_id count as one document with the links of all of them. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import partitions, prepare, save
from .graph import components

SHINGLE, PERCENT = 5, 80
#: Bytes of text whose shingles share a bucket, on average; shingles that are packed at once, at most.
BUCKET_TEXT, BLOCK = 24 << 20, 3_000_000
#: Ids up to this count are broadcast (16 MB); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    data, offsets = T.buffers(T.rows_with(batch, "text"))
    for a, b, d, o in T.chunks(data, offsets):
        low, s, e, at = T.words(d, o)
        yield a, b, T.shingle_sets(T.hashes(low, s, e), at, size)


def shingle_sizes(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and n_shingles of each row."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            n = [len(x) for _, _, sets in _sets(batch, size) for x in sets]
            yield pa.record_batch([T.rows_with(batch, "doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long")


def signed_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, sig (a hash of the whole set), size, set; rows without shingles are left out."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids = T.rows_with(batch, "doc_id").to_pylist()
            for a, _, sets in _sets(batch, size):
                full = [(ids[a + k], x) for k, x in enumerate(sets) if len(x)]
                sig = [int((T.mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True) + np.full(1, len(x), np.uint64)).view(np.int64)[0]) for _, x in full]
                yield pa.record_batch(
                    [pa.array([i for i, _ in full], pa.int64()), pa.array(sig, pa.int64()), pa.array([len(x) for _, x in full], pa.int32()), pa.array([x.view(np.int64) for _, x in full], pa.list_(pa.int64()))],
                    names=["doc_id", "sig", "size", "set"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(run, "doc_id long, sig long, size int, set array<long>")


def shared_counts(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, size, shared: an upper bound of how many of its shingles another row has."""
    spark = docs.sparkSession
    prepare(spark)
    told = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(spark), -(-told // BUCKET_TEXT))
    block = min(BLOCK, 2000 * buckets)

    def packed(ids, sizes, sets):
        """The record batch of some texts' shingles by bucket."""
        n = sizes.astype(np.int64)
        h, row = np.concatenate(sets), np.repeat(np.arange(len(ids), dtype=np.uint32), n)
        # by bucket, and equal shingles side by side
        order = np.lexsort((h, h % np.uint64(buckets)))
        h, row = h[order], row[order]
        same = h[1:] == h[:-1]
        repeated = np.append(False, same) | np.append(same, False)
        to = (h % np.uint64(buckets)).astype(np.int32)
        sent = ~np.append(False, same)  # of a repeated shingle one, which is nobody's
        nobody = np.uint16(65535) if len(ids) < 65535 else np.uint32(0xFFFFFFFF)
        cut = np.searchsorted(to, np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cut)).tolist()
        out = [[] for _ in range(5)]
        for k in some:
            part = slice(cut[k], cut[k + 1])
            u, back = np.unique(row[part], return_inverse=True)
            mine, keep = repeated[part], sent[part]
            place = np.where(mine, nobody, back.astype(type(nobody)))[keep].astype(type(nobody))
            known = np.bincount(back[mine], minlength=len(u)).astype(np.int32)
            for c, x in zip(out, (ids[u], sizes[u], known, place, (h[part][keep] >> np.uint64(32)).astype(np.uint32)), strict=True):
                c.append(x.tobytes())
        return pa.record_batch([pa.array(some, pa.int32()), *(pa.array(c, pa.binary()) for c in out)], names=["bucket", "ids", "sizes", "known", "rows", "keys"])

    def deal(batches):
        ids, sizes, sets, n = [], [], [], 0
        for batch in batches:
            own = np.asarray(T.rows_with(batch, "doc_id").to_numpy(zero_copy_only=False), np.int64)
            for a, b, found in _sets(batch, size):
                ids.append(own[a:b])
                sizes.append(np.array([len(x) for x in found], np.int32))
                sets += found
                n += int(sizes[-1].sum())
                if n >= block:
                    yield packed(np.concatenate(ids), np.concatenate(sizes), sets)
                    ids, sizes, sets, n = [], [], [], 0
        if n:
            yield packed(np.concatenate(ids), np.concatenate(sizes), sets)

    def count(part):
        ids, sizes, known, rows, keys, base = [], [], [], [], [], 0
        for r in part.select(["ids", "sizes", "known", "rows", "keys"]).to_pylist():
            ids.append(np.frombuffer(r["ids"], np.int64))
            sizes.append(np.frombuffer(r["sizes"], np.int32))
            known.append(np.frombuffer(r["known"], np.int32))
            keys.append(np.frombuffer(r["keys"], np.uint32))
            own = np.frombuffer(r["rows"], np.uint16 if len(r["rows"]) == 2 * len(keys[-1]) else np.uint32)
            rows.append(np.where(own == np.iinfo(own.dtype).max, -1, own.astype(np.int64) + base))
            base += len(ids[-1])
        ids, sizes, known, rows, keys = map(np.concatenate, (ids, sizes, known, rows, keys))
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        same = k[1:] == k[:-1]
        more = np.append(False, same) | np.append(same, False)
        hit = rows[order[more]]
        n = known + np.bincount(hit[hit >= 0], minlength=base)
        some = np.flatnonzero(n)
        ids, sizes, n = ids[some], sizes[some], n[some].astype(np.int32)
        # texts go on in packed slices: as rows there would be one for each text and bucket
        to = (T.mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cut)).tolist()
        packed = lambda x: pa.array([x[order[cut[k] : cut[k + 1]]].tobytes() for k in full], pa.binary())
        return pa.table({"slice": pa.array(full, pa.int32()), "ids": packed(ids), "sizes": packed(sizes), "n": packed(n)})

    def total(part):
        ids, sizes, n = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in part[c]]) for c, kind in (("ids", np.int64), ("sizes", np.int32), ("n", np.int32)))
        order = np.lexsort((sizes, ids))
        ids, sizes = ids[order], sizes[order]
        first = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (sizes[1:] != sizes[:-1]))))
        return pa.table({"doc_id": ids[first], "size": sizes[first], "shared": np.add.reduceat(n[order].astype(np.int64), first)})

    dealt = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(deal, "bucket int, ids binary, sizes binary, known binary, rows binary, keys binary")
    hits = dealt.groupBy("bucket").applyInArrow(count, "slice int, ids binary, sizes binary, n binary")
    return hits.groupBy("slice").applyInArrow(total, "doc_id long, size int, shared long")


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of classes that link, on whole sets."""
    one = lambda c: classes.select(F.col("sig").alias(c), F.col("set").alias(f"{c}_set"))
    both = F.size(F.array_intersect("u_set", "v_set"))
    return pairs.join(one("u"), "u").join(one("v"), "v").where(100 * both >= percent * (F.size("u_set") + F.size("v_set") - both)).select("u", "v")


def class_links(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, comp) of classes (sig, size, set) that link with another one, by the grouped prefix join."""
    shingles = classes.select("sig", "size", F.explode("set").alias("s"))
    common = shingles.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # shared is the number of shingles that some other class has; rarest first
    own = (
        shingles.join(common, "s")
        .groupBy("sig", "size")
        .agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("order"))
        .withColumn("shared", F.size("order"))
        .where(F.col("shared") * 100 >= F.col("size") * percent)
        .withColumn("posted", F.expr(f"shared - cast(ceil({percent} * size / 100.0) as int) + 1"))
        .select("sig", "size", (F.col("size") - F.col("shared")).alias("lone"), (F.col("shared") / F.col("size")).alias("score"), F.expr("transform(slice(order, 1, greatest(posted, 0)), x -> x.s)").alias("prefix"))
    )
    own = save(own, "prefixes")

    def may(a: str, b: str):
        """Enough is left behind a common shingle: at the first one of a pair that links this always holds."""
        x, y = F.col(f"size{a}"), F.col(f"size{b}")
        return (100 + percent) * F.least(x - F.col(f"at{a}"), y - F.col(f"at{b}")) >= percent * (x + y)

    post = lambda d, *keep: d.select(*keep, "size", "lone", F.posexplode("prefix").alias("k", "s")).withColumn("at", F.col("lone") + F.col("k")).drop("lone", "k")
    postings = post(own, "sig", "score")
    hubs = postings.groupBy("s").agg(F.max(F.struct("score", "sig", "size", "at")).alias("h")).select("s", F.col("h.sig").alias("hub"), F.col("h.size").alias("size_h"), F.col("h.at").alias("at_h"))
    star = postings.join(hubs, "s").where((F.col("sig") != F.col("hub")) & may("", "_h")).select(F.least("sig", "hub").alias("u"), F.greatest("sig", "hub").alias("v")).distinct()
    first = save(_verified(star, classes, percent), "star")
    comps = components(first)
    grouped = (
        own.join(comps.withColumnRenamed("node", "sig"), "sig", "left")
        .withColumn("comp", F.coalesce("comp", "sig"))
        .groupBy("prefix", "size", "lone", "comp")
        .agg(F.collect_set("sig").alias("members"))
        .withColumn("gid", F.xxhash64("prefix", "size", "lone", "comp"))
    )
    grouped = save(grouped, "groups")
    tokens = post(grouped, "gid", "comp")
    mixed = tokens.groupBy("s").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("s")
    left = tokens.join(mixed, "s")
    right = left.select("s", F.col("gid").alias("gid2"), F.col("size").alias("size_2"), F.col("at").alias("at_2"), F.col("comp").alias("comp2"))
    cross = left.join(right, "s").where((F.col("comp") < F.col("comp2")) & may("", "_2")).select("gid", "gid2").distinct()
    members = grouped.select("gid", F.explode("members").alias("m"))
    pairs = cross.join(members.withColumnRenamed("m", "u"), "gid").join(members.select(F.col("gid").alias("gid2"), F.col("m").alias("v")), "gid2").select("u", "v").distinct()
    second = save(_verified(pairs, classes, percent), "cross")
    if second.isEmpty():
        return comps
    return components(first.unionByName(second))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs(doc_id, text)."""
    bound = shared_counts(docs, size).where(F.col("shared") * 100 >= F.col("size") * percent).select("doc_id").distinct()
    bound = save(bound, "candidates")
    few = bound.count() <= BROADCAST_IDS
    left = docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(bound) if few else bound, "doc_id", "left_semi")
    sets = save(signed_sets(left, size), "sets")
    classes = save(sets.groupBy("sig", "size").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("set").alias("set")), "classes")
    linked = class_links(classes.select("sig", "size", "set"), percent)
    # classes that link take the least document of their component, the others that of their own copies
    tops = classes.select("sig", "rep").join(linked.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    least = tops.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_class = tops.join(least, "comp").select("sig", "component_id")
    found = sets.select("doc_id", "sig").join(of_class, "sig").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    all_docs = shingle_sizes(docs, size)
    return all_docs.join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
