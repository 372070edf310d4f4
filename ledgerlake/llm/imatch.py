"""Operator 3, I-Match fingerprints, with DataFrame functions only.

Terms are maximal runs of letters and digits, lower case. The lexicon holds the terms whose document frequency lies in
a band of the corpus, so of inverse document frequency too. REPEATS random permutations of the lexicon each hold four
disjoint subsets that get fewer terms by a factor of four; a text's distinct terms in each subset are hashed as a set:
the exclusive-or of their hashes, which like the hash of the sorted terms doesn't depend on their order. A fingerprint
lists subset number and all 64 bits of the hash of the subsets that hold a term, or the hash of the text if none does.
Likeness is the share of equal hashes among the subsets that have terms in either text; equal fingerprints have 1.

The band starts at LOW of all documents, so the lexicon has at most (mean number of distinct terms of a document) / LOW
entries however large the corpus is; that bound lets it be broadcast. Texts are dealt out once, by ranges of doc_id, and
a range also gets the first document of the next one (the last: the very first), so "the next document" needs no other
shuffle.

Null texts are empty. Null doc_ids sort first. Rows that share a doc_id follow each other in the order of their text; a
single document is its own next one. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, save

LOW, HIGH = 0.002, 0.2
REPEATS, LEVELS = 10, 4
_FIRST = -(1 << 63)


def term_hashes(text: F.Column) -> F.Column:
    """64-bit hashes of the distinct terms of a text."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Hashes of the terms in the band; a term of a single document is never in it."""
    n = docs.count()
    df = docs.select(F.explode(F.array_distinct(term_hashes(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.where((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= max(2.0, high * n))).select("term")


def _slot(first: F.Column, h: F.Column) -> F.Column:
    """The subset of a term in one repeat: by pairs of trailing zero bits; most terms, with none, fall in no subset."""
    level = F.lit(LEVELS - 1)
    for j in range(LEVELS - 1, 0, -1):
        level = F.when(h.bitwiseAND((1 << 2 * j + 2) - 1) != 0, j - 1).otherwise(level)
    return F.when(first < 0, first).when(h.bitwiseAND(3) == 0, first + level)


def likeness(a: F.Column, b: F.Column) -> F.Column:
    """Of two fingerprints: 1 if equal, else the share of equal hashes where either has one."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    slots = lambda v: F.transform(v, lambda e: F.substring(e, 1, 2))
    share = F.size(F.array_intersect(x, y)) / F.size(F.array_union(slots(x), slots(y)))
    return F.when(a == b, 1.0).when(a.startswith("t") | b.startswith("t"), 0.0).otherwise(share)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, part, at, halo, next: rows in parts by ranges of doc_id, each with the text after it.

    Rows with halo are guests at the end of a part; they belong to another part, too.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("o", F.coalesce("doc_id", F.lit(_FIRST)))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("o"))
    cuts = ids.agg(F.percentile_approx("o", [k / n for k in range(1, n)] or [0.5], 10 * n)).first()[0]
    # one number for each part, whatever the number of rows
    cuts = sorted(set(cuts or [])) if n > 1 else []
    part = F.size(F.filter(F.array(*(F.lit(c).cast("long") for c in cuts)), lambda c: c < F.col("o"))) if cuts else F.lit(0)
    firsts = sorted((r["part"], r["o"]) for r in ids.withColumn("part", part).groupBy("part").agg(F.min("o").alias("o")).collect())
    guests = [(firsts[(k + 1) % len(firsts)][1], firsts[k][0]) for k in range(len(firsts))]
    guests = spark.createDataFrame(guests, "o long, guest int") if guests else spark.createDataFrame([], "o long, guest int")
    place = lambda p, halo: F.struct(p.cast("int").alias("part"), F.lit(halo).alias("halo"))
    dealt = d.join(F.broadcast(guests), "o", "left").withColumn("p", F.explode(F.array(place(part, False), place(F.col("guest"), True)))).where("p.part is not null")
    dealt = dealt.select("doc_id", "o", "text", "p.part", "p.halo").repartition(n, "part")
    line = Window.partitionBy("part").orderBy("halo", "o", "text")
    return dealt.withColumn("next", F.lead("text").over(line)).withColumn("at", F.row_number().over(line)).drop("o")


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of docs(doc_id, text)."""
    lex = save(lexicon(docs, low, high), "lexicon")
    x = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"), F.substring("next", F.lit(1), half))
    x = x.withColumn("edited", F.when(~F.col("halo"), edited))
    both = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t"))))
    v = x.select("part", "at", "halo", "doc_id", "n_chars", both.alias("v")).where("v.t is not null")
    of_text = ["part", "at", "kind", "halo", "doc_id", "n_chars", "sha"]
    # a column made beside a generator would be made again for each of its rows
    v = v.select("part", "at", "halo", "doc_id", "n_chars", "v.kind", F.sha2(F.col("v.t"), 256).alias("sha"), term_hashes(F.col("v.t")).alias("terms"))
    v = v.select(*of_text, F.posexplode_outer("terms").alias("k", "term"))
    # a text's first term stays whether it is in the band or not, so that no text is lost
    v = v.join(F.broadcast(lex.withColumn("known", F.lit(True))), "term", "left").where("known or k is null or k = 0")
    hashed = v.select(*of_text, "k", *(F.when(F.col("known"), F.xxhash64("term", F.lit(r))).alias(f"h{r}") for r in range(REPEATS)))
    each = [F.when(F.col(f"h{r}").isNotNull(), F.struct(F.lit(LEVELS * r).alias("first"), F.col(f"h{r}").alias("h"))) for r in range(REPEATS)]
    each.append(F.when(F.coalesce("k", F.lit(0)) == 0, F.struct(F.lit(-1).alias("first"), F.lit(0).cast("long").alias("h"))))
    dealt = hashed.select(*of_text, F.explode(F.array(*each)).alias("e")).select(*of_text, _slot(F.col("e.first"), F.col("e.h")).alias("slot"), "e.h").where("slot is not null")
    # the exclusive-or of the hashes of distinct terms is the same for any order of them, as the hash of the sorted list is
    subsets = dealt.groupBy(*of_text, "slot").agg(F.bit_xor("h").alias("h"))
    entry = F.when(F.col("slot") >= 0, F.concat(F.lpad(F.col("slot").cast("string"), 2, "0"), F.hex("h")))
    texts = subsets.groupBy(*of_text).agg(F.sort_array(F.collect_list(entry)).alias("s"))
    texts = texts.select(*of_text, F.when(F.size("s") == 0, F.concat(F.lit("t"), F.substring("sha", 1, 16))).otherwise(F.array_join("s", ".")).alias("fp"))
    one = texts.groupBy("part", "at").agg(
        F.first("halo").alias("halo"),
        F.first("doc_id").alias("doc_id"),
        F.first("n_chars").alias("n_chars"),
        F.max(F.when(F.col("kind") == 1, F.col("sha"))).alias("edited_sha256"),
        F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fingerprint"),
        F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fingerprint"),
    )
    line = Window.partitionBy("part").orderBy("at")
    one = one.withColumn("next_fp", F.lead("fingerprint").over(line)).where(~F.col("halo"))
    return one.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"))
