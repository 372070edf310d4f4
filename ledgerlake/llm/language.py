"""Operator 8, language identification by fusing evidence.

The log likelihood of a text under byte trigram models of each language (and of "und", where all trigrams are alike) is
tempered and joined with three pieces of evidence by Bayes' rule: the language that the markup declares, the suffix of
the address, and the host. What a declaration or a suffix is worth is measured by grouped aggregation: expected counts
of (declared, language) and (suffix, language) by text alone, smoothed. Host priors are smoothed in a hierarchy: a host
leans on its suffix, a suffix on all rows.

Trigram models are fitted for every language that LEAST_ROWS rows declare, on a bounded sample: the SAMPLE rows with the least
hash of their id. Declarations without a model are evidence together, worth what is measured like that of the others; where
a text is of no known language, its declaration is the answer. All counts for priors cover all rows; they are summed before anything is shuffled, and hosts meet their rows in a
join that carries no text.

A null or empty text has no text evidence and gets the priors' answer; with no other evidence either it is "und". Null or
odd addresses and declarations count as absent. Rows that share an id are each answered. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textops as T
from .common import give_back, prepare, save

SAMPLE, BITS = 400, 16
#: Rows from which on a declared language has a model.
LEAST_ROWS = 10
#: Trigrams are not independent: the mean log ratio counts as that of TEMPER trigrams at most.
TEMPER, SMOOTH = 60.0, 20.0
#: How much less likely, in nats, a text with letters is to be of no known language.
MARGIN = 15.0
UNKNOWN = "und"
#: Hosts that meet their rows by broadcast, at most.
HOT = 1000
#: Stands for all declarations without a model; no language has this name.
OTHER = "?"
TAG = r"^[a-z]{2,8}([-_][a-z0-9]{1,8})*$"


_LETTER = np.full(256, 32, np.uint8)
_LETTER[128:] = np.arange(128, 256)
_LETTER[97:123] = _LETTER[65:91] = np.arange(97, 123)


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter byte, and each row's offsets into these; what is no letter is a space."""
    low = _LETTER[data].astype(np.uint32)
    left, right = np.full_like(low, 32), np.full_like(low, 32)
    left[1:], right[:-1] = low[:-1], low[1:]
    edge = offsets[(offsets > 0) & (offsets < len(low))]
    left[edge], right[edge - 1] = 32, 32
    at = np.flatnonzero(low != 32)
    code = (left[at] << np.uint32(16)) | (low[at] << np.uint32(8)) | right[at]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64), np.searchsorted(at, offsets)


def trigram_counts(batches):
    """(l, counts) of batches(text, l): how often each trigram bucket occurs in the texts of a language, as packed integers."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        data, offsets = T.buffers(T.rows_with(batch, "text"))
        names = T.rows_with(batch, "l").to_pylist()
        for a, b, d, o in T.chunks(data, offsets):
            code, at = _codes(d, o)
            for k in range(b - a):
                c = np.bincount(code[at[k] : at[k + 1]], minlength=1 << BITS)
                sums[names[a + k]] = c if names[a + k] not in sums else sums[names[a + k]] + c
    yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([c.astype("<i8").tobytes() for c in sums.values()], pa.binary())], names=["l", "counts"])


def added_counts(part: pa.Table) -> pa.Table:
    """One row (l, counts) for the rows of a language."""
    total = np.zeros(1 << BITS, np.int64)
    for x in part["counts"]:
        total += np.frombuffer(x.as_buffer(), "<i8")
    return pa.table({"l": part["l"][:1], "counts": pa.array([total.tobytes()], pa.binary())})


def ratios(counts: dict[str, np.ndarray], languages: list[str]) -> np.ndarray:
    """Log ratio of each trigram's probability in a language to its even share; the last column, und, is zero."""
    out = np.zeros((1 << BITS, len(languages) + 1), np.float32)
    used = np.zeros(1 << BITS, bool)
    for c in counts.values():
        used |= c > 0
    even = 1.0 / max(1, used.sum())
    for k, name in enumerate(languages):
        c = counts[name]
        out[:, k] = np.log((c + 0.02) / (c.sum() + 0.02 * (1 << BITS)) / even)
    return out


def fit(docs: DataFrame, sample: int = SAMPLE, label: str = "lang", key: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages and trigram table from at most `sample` rows of each language that LEAST_ROWS rows declare.

    Texts are counted where they lie; a table of counts for each language reaches the driver.
    """
    prepare(docs.sparkSession)
    lang = F.lower(F.trim(F.col(label)))
    d = docs.select(F.col(key).cast("long").alias("k"), lang.alias("l")).where("l is not null and k is not null and l <> '' and l <> 'und'")
    names = sorted(r["l"] for r in d.groupBy("l").count().where(F.col("count") >= LEAST_ROWS).select("l").collect())
    if not names:
        return [], np.zeros((1 << BITS, 1), np.float32)
    order = Window.partitionBy("l").orderBy(F.xxhash64("k"), "k")
    kept = F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in names], "l string"))  # a row for each language
    chosen = d.join(kept, "l").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample).select("k", "l")
    texts = docs.select(F.col(key).cast("long").alias("k"), "text", lang.alias("l")).join(F.broadcast(chosen.distinct()), ["k", "l"])  # ids of the samples
    found = texts.select("text", "l").mapInArrow(trigram_counts, "l string, counts binary").groupBy("l").applyInArrow(added_counts, "l string, counts binary")
    counts = {r["l"]: np.frombuffer(r["counts"], "<i8") for r in found.toLocalIterator()}
    table = ratios(counts, names)
    del counts
    give_back()
    return names, table


def text_evidence(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """(rows, languages + 1) tempered log likelihood ratios."""
    data, offsets = T.buffers(column)
    out = np.zeros((len(offsets) - 1, table.shape[1]))
    for a, b, d, o in T.chunks(data, offsets, 1 << 20):
        code, at = _codes(d, o)
        if not len(code):
            continue
        n = np.diff(at)
        some = np.flatnonzero(n)
        sums = np.add.reduceat(table[code], at[:-1][some], axis=0)
        out[a + some] = sums / n[some, None] * np.minimum(n[some], TEMPER)[:, None]
        out[a + some, -1] = -MARGIN
    return out


def identify(rows: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """rows(key, text, declared, host, suffix) with lang, confidence, text_lang; text is dropped, other columns stay."""
    spark = rows.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(table)
    names = [*languages, UNKNOWN]

    def run(batches):
        for batch in batches:
            e = text_evidence(T.rows_with(batch, "text"), shared.value)
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(T.rows_with(batch, c) for c in keep), pa.array(list(e), pa.list_(pa.float64()))], names=[*keep, "evidence"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    scored = rows.mapInArrow(run, f"{schema}, evidence array<double>")
    k = len(names)
    top = F.array_max("evidence")
    scored = scored.withColumn("_e", F.transform("evidence", lambda x: F.exp(x - top)))
    scored = scored.withColumn("_sum", F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)).withColumn("soft", F.transform("_e", lambda x: x / F.col("_sum"))).drop("_e", "_sum")
    said = F.lower(F.trim("declared"))
    known = F.when(said.isin(languages), said).when((said != UNKNOWN) & said.rlike(TAG), OTHER)
    scored = scored.withColumn("_d", F.coalesce(known, F.lit(""))).withColumn("_s", F.coalesce("suffix", F.lit(""))).withColumn("_h", F.coalesce("host", F.lit("")))
    scored = save(scored, "language")
    sums = lambda d: d.agg(*(F.sum(F.col("soft")[i]).alias(f"n{i}") for i in range(k)))
    vector = lambda t: np.array([[r[f"n{i}"] or 0.0 for i in range(k)] for r in t]).reshape(-1, k)
    # a row for each language, one for other declarations, one for none
    found = sums(scored.groupBy("_d")).collect()
    counts = vector(found)
    total = counts.sum(0) if len(counts) else np.zeros(k)
    prior = (total + 1.0) / (total.sum() + k)
    declared_given = {r["_d"]: np.log((c + SMOOTH * (c.sum() + 1) / (total.sum() + k)) / (total + SMOOTH)) for r, c in zip(found, counts, strict=True)}
    lit = lambda v: F.array(*(F.lit(float(x)) for x in v))
    worth = [(name, [float(x) for x in (v if name else np.zeros(k))]) for name, v in declared_given.items()]
    worth = F.broadcast(spark.createDataFrame(worth, "_d string, _dv array<double>"))  # a row for each declared value
    lean = lambda own, up: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.get(own, i) + SMOOTH * F.get(up, i)) / (F.aggregate(own, F.lit(0.0), lambda a, b: a + b) + SMOOTH))
    array = F.array(*(F.col(f"n{i}") for i in range(k)))
    suffixes = sums(scored.groupBy("_s")).select("_s", lean(array, lit(prior)).alias("_sp"))
    hosts = scored.groupBy("_s", "_h").agg(F.count(F.lit(1)).alias("_rows"), *(F.sum(F.col("soft")[i]).alias(f"n{i}") for i in range(k)))
    hosts = save(hosts.select("_s", "_h", "_rows", array.alias("_hn")).join(suffixes, "_s").select("_s", "_h", "_rows", lean(F.col("_hn"), F.col("_sp")).alias("_hp")), "hosts")
    # hosts with a thousandth of all rows or more are at most HOT: they meet their rows by broadcast, the others in a shuffle
    n = hosts.agg(F.sum("_rows")).first()[0] or 0
    often = hosts.where(F.col("_rows") * HOT >= n).select("_s", "_h", F.col("_hp").alias("_hot"))
    with_hot = scored.join(F.broadcast(often), ["_s", "_h"], "left").join(worth, "_d", "left")
    rare = with_hot.where("_hot is null").drop("_hot").join(hosts.where(F.col("_rows") * HOT < n).select("_s", "_h", "_hp"), ["_s", "_h"])
    joined = with_hot.where("_hot is not null").withColumnRenamed("_hot", "_hp").unionByName(rare)
    fused = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get("evidence", i) + F.get("_dv", i) + F.log(F.get("_hp", i)))
    joined = joined.withColumn("_f", fused).withColumn("_top", F.array_max("_f"))
    name_of = lambda c: F.element_at(F.array(*map(F.lit, names)), F.array_position(c, F.array_max(c)).cast("int"))
    joined = joined.withColumn("lang", name_of(F.col("_f"))).withColumn("text_lang", name_of(F.col("evidence")))
    joined = joined.withColumn("confidence", 1 / F.aggregate(F.transform("_f", lambda x: F.exp(x - F.col("_top"))), F.lit(0.0), lambda a, b: a + b))
    bare = (F.array_max("evidence") == 0) & (F.array_min("evidence") == 0) & F.col("_d").isin("", OTHER) & (F.col("_h") == "")
    joined = joined.withColumn("lang", F.when(bare, UNKNOWN).otherwise(F.col("lang"))).withColumn("text_lang", F.when((F.array_max("evidence") == 0) & (F.array_min("evidence") == 0), UNKNOWN).otherwise(F.col("text_lang")))
    letters = (F.array_max("evidence") != 0) | (F.array_min("evidence") != 0)
    joined = joined.withColumn("lang", F.when((F.col("lang") == UNKNOWN) & letters & (F.col("_d") == OTHER), said).otherwise(F.col("lang")))
    return joined.drop("_d", "_dv", "_s", "_h", "_f", "_top", "_hp", "evidence", "soft")


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, text, declared, host, suffix of raw pages(page_id, url, html)."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>|&#?\w{1,8};", " ")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    some = F.when(host != "", host)
    return pages.select(
        F.col("page_id").cast("long"),
        F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"),
        F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?\s*([a-z]{2,3})""", 1)).alias("declared"),
        some.alias("host"),
        F.regexp_extract(some, r"([^.]+)$", 1).alias("suffix"),
    )
