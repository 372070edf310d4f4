"""Text, retrieval and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..operators import passages as P
from ..operators import search as S
from ..operators import vectors as V
from ..sources.tables import parquet, scratch, stored


def fold_text(spark, d):
    return parquet(spark, d, "documents").select("doc_id", F.md5(C.fold(F.col("text"))).alias("folded"))


#: How an amount is printed, by remainder of its key.
_STYLES = ["{}", "({})", "-", "x{}", "{},5"]


def parse_amounts(spark, d):
    o = parquet(spark, d, "orders").withColumn("amount", F.floor("o_totalprice"))
    k, n = F.col("o_orderkey") % 5, F.format_number("amount", 0)
    cell = F.when(k == 0, n).when(k == 1, F.concat(F.lit("("), F.translate(n, ",", "."), F.lit(")"))).when(k == 2, "-").when(k == 3, F.concat(F.lit("V."), n)).otherwise(F.concat(F.col("amount").cast("string"), F.lit(",5")))
    return o.select("o_orderkey", C.parse_amount(cell).alias("value"))


def html_tables(text: F.Column) -> F.Column:
    return F.regexp_extract_all(text, F.lit(r"(?is)<table.*?</table>"), F.lit(0))


def html_table_roundtrip(spark, d):
    """Nations as rows of one table for each region, written as HTML and read back."""
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>"))
    rows = parquet(spark, d, "nation").withColumn("tr", F.concat(F.lit("<tr>"), cell("n_nationkey"), cell("n_name"), F.lit("</tr>")))
    pages = rows.groupBy("n_regionkey").agg(F.concat(F.lit("<p>x</p><table>"), F.array_join(F.sort_array(F.collect_list("tr")), ""), F.lit("</table>")).alias("html"))
    tr = pages.select("n_regionkey", F.explode(html_tables(F.col("html"))).alias("t")).select("n_regionkey", F.explode(F.regexp_extract_all("t", F.lit(r"(?is)<tr.*?</tr>"), F.lit(0))).alias("tr"))
    td = tr.select("n_regionkey", F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda x: F.trim(x)).alias("c"))
    return td.select("n_regionkey", C.parse_amount(F.col("c")[0]).cast("int").alias("n_nationkey"), F.col("c")[1].alias("n_name"))


def chrome_lines(spark, d):
    """Lines that many documents share, digits masked."""
    lines = parquet(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"[A-Za-z]"))
    keyed = lines.select("doc_id", F.lower(F.regexp_replace("line", r"[0-9]+", "#")).alias("key")).distinct()
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).where("docs >= 5").select(F.md5("key").alias("line"), "docs")


def page_digit_share(spark, d):
    share = C.digit_share(F.col("text"))
    x = parquet(spark, d, "documents").select("doc_id", F.round(share, 6).alias("share"))
    return x.withColumn("kind", F.when(F.col("share") > 0.35, "numeric").when(F.col("share") > 0.10, "table").otherwise("text"))


def chunk_overlap(spark, d):
    x = parquet(spark, d, "documents").select("doc_id", F.filter(F.split("text", r"[ \n\t\r]+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    x = x.select("doc_id", F.posexplode(C.chunks(F.col("w"))).alias("chunk", "words"))
    return x.select("doc_id", "chunk", F.size("words").alias("n"), F.md5(F.array_join("words", " ")).alias("digest"))


def section_carry_forward(spark, d):
    """The last user turn before each turn of a conversation."""
    c = parquet(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return c.select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(w).alias("section"))


_indexes: dict[tuple[str, str], str] = {}
#: Scores are compared to eight decimals here, so that sums in another order give the same ranks.
PLACES = 8


def index(spark, d) -> S.Index:
    """The index of all documents, tagged by language, written once in a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes:
        path = scratch(spark)
        S.Index.write(parquet(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang"), path, tag="lang")
        _indexes[key] = path
    return S.Index.read(spark, _indexes[key])


def questions(spark, d) -> DataFrame:
    """q, text: every passage of the benchmark."""
    return parquet(spark, d, "benchmark").select(F.col("item_id").alias("q"), "text")


def vectors(spark, d) -> DataFrame:
    return parquet(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def text_vectors(spark, d) -> DataFrame:
    """id, embedding of every document, from its words."""
    return stored(spark, d, "text_vectors", lambda: V.hashed(parquet(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id"))


def question_vectors(spark, d) -> DataFrame:
    return stored(spark, d, "question_vectors", lambda: V.hashed(questions(spark, d), "q", "vector"))


def gold(spark, d) -> DataFrame:
    """q, id of documents that hold the passage whole."""
    return stored(spark, d, "gold", lambda: P.containing(parquet(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), questions(spark, d)))


def gold_passages(spark, d):
    """Which documents hold which passages of the benchmark."""
    return gold(spark, d)


def tfidf_weights(spark, d):
    return index(spark, d).texts.select(F.col("id").alias("doc_id"), "terms", F.round("top", 6).alias("top"), F.round("total", 4).alias("total"))


def upserted_index(spark, d):
    """Every seventh document is replaced by its neighbour's text, every eleventh deleted: term counts and idf of what is left."""
    docs = parquet(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    part = docs.where("id % 7 = 0").select((F.col("id") - 1).alias("id"), "text", "lang").where("id >= 0")
    path = scratch(spark)
    now = S.Index.write(docs, path, tag="lang", weigh=False).upsert(part, "lang", delete=docs.where("id % 11 = 0 and id % 7 <> 6").select("id"))
    return now.texts.select("id", "terms", F.round("top", 6).alias("top"), F.round("total", 4).alias("total"), F.lit(now.size).cast("long").alias("texts"))


def _shown(x: DataFrame) -> DataFrame:
    return x.select("q", "id", "rank", F.round("score", 6).alias("score"))


def lexical_topk(spark, d):
    """The 30 best documents for every passage of the benchmark."""
    return _shown(S.lexical(index(spark, d), questions(spark, d), places=PLACES))


def lexical_filtered(spark, d):
    """The same among documents in English; weights stay those of all documents."""
    asked = questions(spark, d).withColumn("tags", F.array(F.lit("en")))
    return _shown(S.lexical(index(spark, d), asked, 10, "tags", PLACES))


def dense_topk(spark, d):
    """The 30 nearest other vectors of every hundredth one."""
    v = vectors(spark, d)
    asked = v.where("id % 100 = 0").select(F.col("id").alias("q"), F.col("embedding").alias("vector"))
    return _shown(S.best(S.dense(v, asked, S.CANDIDATES + 1, places=PLACES).where("id <> q").drop("rank"), S.CANDIDATES))


def dense_filtered(spark, d):
    """The 10 nearest vectors of every fiftieth one among those of two labels: the next and the one after."""
    v = vectors(spark, d).withColumn("tag", F.col("label").cast("string"))
    tags = F.array(*[((F.col("label") + k) % 10).cast("string") for k in (1, 2)])
    asked = v.where("id % 50 = 0").select(F.col("id").alias("q"), F.col("embedding").alias("vector"), tags.alias("tags"))
    return _shown(S.dense(v, asked, 10, "tag", PLACES))


def hybrid_rrf(spark, d):
    """The six best of both rankings for every passage of the benchmark; vectors are made of the words of texts."""
    x = S.search("hybrid", index(spark, d), questions(spark, d), text_vectors(spark, d), question_vectors(spark, d), places=PLACES)
    return x.select("q", "id", "rank", F.round("score", 6).alias("score"))


def retrieval_eval(spark, d):
    """Recall and mean reciprocal rank of each mode over all passages; a hit holds the passage."""
    q = questions(spark, d)
    answers = gold(spark, d)
    out = None
    for mode in ("lexical", "dense", "hybrid"):
        hits = S.search(mode, index(spark, d), q, text_vectors(spark, d), question_vectors(spark, d), places=PLACES)
        one = S.evaluated(hits, answers, q.select("q")).select(F.lit(mode).alias("mode"), F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def recall_by_kind(spark, d):
    """Mean recall by number of passages kept and by label of the question, for every hundredth vector; a hit has its label."""
    v = vectors(spark, d)
    asked = v.where("id % 100 = 0").select(F.col("id").alias("q"), F.col("embedding").alias("vector"), F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("lang"), "label")
    hits = S.best(S.dense(v, asked, 11, places=PLACES).where("id <> q").drop("rank"), 10)
    right = asked.select("q", "label").join(v.select("id", "label"), "label").select("q", "id")
    of = lambda k: S.evaluated(hits.where(F.col("rank") <= k), right, asked.select("q", "lang"), "lang").withColumn("mode", F.lit(f"top {k}"))
    x = S.by_language(of(1).unionByName(of(3)).unionByName(of(10)), ["even", "odd"])
    return x.select("mode", F.round("even", 6).alias("even"), F.round("odd", 6).alias("odd"))


def filled(claims: DataFrame, metrics: DataFrame) -> DataFrame:
    """{{id}} in a text replaced by the metric's figure; claims(claim_id, text), metrics(id, shown)."""
    refs = claims.select("claim_id", F.explode(F.regexp_extract_all("text", F.lit(r"\{\{([^{}]+)\}\}"), F.lit(1))).alias("id")).distinct()
    found = refs.join(metrics, "id").groupBy("claim_id").agg(F.sort_array(F.collect_list(F.struct("id", "shown"))).alias("m"))
    x = claims.join(found, "claim_id", "left")
    text = F.aggregate(F.coalesce("m", F.array().cast("array<struct<id:string,shown:string>>")), F.col("text"), lambda t, m: F.replace(t, F.concat(F.lit("{{"), m["id"], F.lit("}}")), m["shown"]))
    return x.select("claim_id", text.alias("text"))


def _claims(spark, d):
    c = parquet(spark, d, "customer")
    ref = F.concat(F.lit("c"), F.col("c_custkey"), F.when(F.col("c_custkey") % 4 == 0, ".gone").otherwise(".balance"))
    text = F.concat(F.lit("Balance is {{"), ref, F.lit("}}"), F.when(F.col("c_custkey") % 3 == 0, " or 12.5").otherwise(""), F.lit("."))
    return c.select(F.col("c_custkey").alias("claim_id"), text.alias("text"))


def _metrics(spark, d):
    return parquet(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey"), F.lit(".balance")).alias("id"), F.col("c_nationkey").cast("string").alias("shown"))


def placeholder_fill(spark, d):
    return filled(_claims(spark, d), _metrics(spark, d))


def claim_checks(spark, d):
    """Problems of a claim: a metric nobody computed, a figure typed by hand."""
    c = _claims(spark, d)
    refs = c.select("claim_id", F.explode(F.regexp_extract_all("text", F.lit(r"\{\{([^{}]+)\}\}"), F.lit(1))).alias("id"))
    unknown = refs.join(_metrics(spark, d), "id", "left_anti").select("claim_id", F.lit("unknown metric").alias("problem"))
    bare = F.regexp_replace("text", r"\{\{[^{}]+\}\}", "")
    typed = c.where(bare.rlike(r"[0-9]")).select("claim_id", F.lit("typed number").alias("problem"))
    return unknown.unionByName(typed)


def template_claims(spark, d):
    """A sentence for each customer all of whose figures exist."""
    o = parquet(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))
    return o.where("p > 0 and o > 0").select("o_custkey", F.format_string("%d open and %d pending", F.col("o"), F.col("p")).alias("text"))


def citation_numbering(spark, d):
    """Sources numbered by first use in reading order, for each conversation."""
    c = parquet(spark, d, "conversations").select("conv_id", "turn", "role")
    first = c.groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    return first.select("conv_id", "role", F.dense_rank().over(Window.partitionBy("conv_id").orderBy("first", "role")).alias("number"))


QUERIES = {f.__name__: f for f in (fold_text, parse_amounts, html_table_roundtrip, chrome_lines, page_digit_share, chunk_overlap, section_carry_forward, tfidf_weights, upserted_index, gold_passages, lexical_topk, lexical_filtered, dense_topk, dense_filtered, hybrid_rrf, retrieval_eval, recall_by_kind, placeholder_fill, claim_checks, template_claims, citation_numbering)}

_TOKENS = """t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM documents),
terms AS (SELECT doc_id, unnest(t) AS term FROM t UNION ALL SELECT doc_id, unnest(list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1])) FROM t WHERE len(t) > 1),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
raw AS (SELECT doc_id, tf.term, (1 + ln(tf)) * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1) AS w FROM tf JOIN df ON df.term = tf.term),
weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""
_LEXICAL = _TOKENS + """, idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1 AS idf FROM df),
qt AS (SELECT item_id AS q, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM benchmark),
qterms AS (SELECT q, unnest(t) AS term FROM qt UNION ALL SELECT q, unnest(list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1])) FROM qt WHERE len(t) > 1),
qraw AS (SELECT q, c.term, (1 + ln(n)) * idf AS w FROM (SELECT q, term, count(*) AS n FROM qterms GROUP BY 1, 2) c JOIN idf ON idf.term = c.term),
qw AS (SELECT q, term, w / sqrt(sum(w * w) OVER (PARTITION BY q)) AS asked FROM qraw),
scores AS (SELECT q, doc_id AS id, round(sum(weight * asked), 8) AS score FROM weights JOIN qw ON qw.term = weights.term GROUP BY 1, 2),
lexical AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INTEGER) AS rank FROM scores WHERE score > 0)"""
_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_SIZE = "sqrt(list_sum(list_transform({v}.embedding, lambda p: p::DOUBLE * p::DOUBLE)))"
_COSINE = f"round({_DOT} / ({_SIZE.format(v='a')} * {_SIZE.format(v='b')}), 8)"
_NEAR = f"near AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INTEGER) AS rank FROM (SELECT b.vec_id AS q, a.vec_id AS id, a.label, b.label AS own, {_COSINE} AS score FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0 AND a.vec_id <> b.vec_id))"
_DENSE = """words AS (SELECT 0 AS asked, doc_id AS id, unnest(t) AS w FROM t UNION ALL SELECT 1, q, unnest(t) FROM qt), hashed AS (SELECT asked, id, ('0x' || substr(md5(w), 1, 7))::BIGINT AS h FROM words),
hv AS MATERIALIZED (SELECT asked, id, h % 64 AS k, sum(CASE WHEN h // 64 % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM hashed GROUP BY 1, 2, 3), size AS (SELECT asked, id, sqrt(sum(v * v)) AS size FROM hv GROUP BY 1, 2 HAVING sum(v * v) > 0),
dots AS (SELECT b.id AS q, a.id, sum(a.v * b.v) AS dot FROM hv a JOIN hv b ON a.k = b.k AND a.asked = 0 AND b.asked = 1 GROUP BY 1, 2),
dense AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INTEGER) AS rank FROM (SELECT b.id AS q, a.id, round(coalesce(dot, 0) / (a.size * b.size), 8) AS score FROM size a JOIN size b ON a.asked = 0 AND b.asked = 1 LEFT JOIN dots ON dots.q = b.id AND dots.id = a.id))"""
_FUSED = "SELECT q, id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM ({lists}) GROUP BY 1, 2"
_RANKED = "SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INTEGER) AS rank FROM ({fused})"
_LISTS = {"lexical": "SELECT q, id, rank FROM lexical WHERE rank <= 30", "dense": "SELECT q, id, rank FROM dense WHERE rank <= 30"}
_LISTS["hybrid"] = " UNION ALL ".join(_LISTS.values())


def _hits(mode: str) -> str:
    return _RANKED.format(fused=_FUSED.format(lists=_LISTS[mode]))


def _scored(mode: str) -> str:
    return f"SELECT '{mode}' AS mode, round(avg((f IS NOT NULL)::INT::DOUBLE), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / f, 0)), 6) AS mrr, count(*) AS n FROM (SELECT item_id, min(rank) FILTER (rank <= 6 AND g.id IS NOT NULL) AS f FROM benchmark LEFT JOIN ({_hits(mode)}) h ON h.q = item_id LEFT JOIN gold g ON g.q = h.q AND g.id = h.id GROUP BY 1)"


def _kind(k: int) -> str:
    return f"SELECT 'top {k}' AS mode, " + ", ".join(f"round(avg(hit) FILTER (label % 2 = {r}), 6) AS {n}" for r, n in ((0, "even"), (1, "odd"))) + f" FROM (SELECT q, any_value(own) AS label, max((label = own AND rank <= {k})::INT::DOUBLE) AS hit FROM near GROUP BY 1)"


_CLAIM = "SELECT c_custkey AS claim_id, c_custkey % 4 = 0 AS gone, c_custkey % 3 = 0 AS typed, c_nationkey FROM customer"

ORACLES = {
    "parse_amounts": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN floor(o_totalprice) WHEN 1 THEN -floor(o_totalprice) WHEN 2 THEN 0.0 WHEN 3 THEN NULL ELSE floor(o_totalprice) + 0.5 END AS value FROM orders",
    "html_table_roundtrip": "SELECT n_regionkey, n_nationkey, n_name FROM nation",
    "chrome_lines": "WITH l AS (SELECT DISTINCT doc_id, lower(regexp_replace(line, '[0-9]+', '#', 'g')) AS key FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[A-Za-z]')) SELECT md5(key) AS line, count(*) AS docs FROM l GROUP BY key HAVING count(*) >= 5",
    "page_digit_share": "WITH s AS (SELECT doc_id, round(length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(regexp_replace(text, '[^0-9]', '', 'g')) + length(regexp_replace(text, '[^\\p{L}]', '', 'g')), 1), 6) AS share FROM documents) SELECT doc_id, share, CASE WHEN share > 0.35 THEN 'numeric' WHEN share > 0.10 THEN 'table' ELSE 'text' END AS kind FROM s",
    "chunk_overlap": "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda x: x <> '') AS w FROM documents), k AS (SELECT *, len(w) AS n, CASE WHEN len(w) <= 380 THEN len(w) ELSE ceil(len(w) / ceil(len(w) / 300.0::DOUBLE))::BIGINT END AS step FROM w WHERE len(w) > 0), c AS (SELECT doc_id, w, step, n, unnest(generate_series(0, n - 1, step)) AS i FROM k) SELECT doc_id, CAST(i // step AS INTEGER) AS chunk, CAST(least(i + step, n) - greatest(i - 50, 0) AS INTEGER) AS n, md5(array_to_string(w[greatest(i - 50, 0) + 1 : least(i + step, n)], ' ')) AS digest FROM c",
    "section_carry_forward": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS section FROM conversations",
    "tfidf_weights": f"WITH {_TOKENS} SELECT doc_id, count(*) AS terms, round(max(weight), 6) AS top, round(sum(weight), 4) AS total FROM weights GROUP BY 1",
    "upserted_index": f"WITH documents AS (SELECT * FROM (SELECT doc_id - 1 AS doc_id, text FROM documents WHERE doc_id % 7 = 0 AND doc_id > 0 UNION ALL SELECT doc_id, text FROM documents WHERE doc_id + 1 NOT IN (SELECT doc_id FROM documents WHERE doc_id % 7 = 0 AND doc_id > 0) AND NOT (doc_id % 11 = 0 AND doc_id % 7 <> 6))), {_TOKENS} SELECT doc_id AS id, count(*) AS terms, round(max(weight), 6) AS top, round(sum(weight), 4) AS total, (SELECT count(*) FROM documents) AS texts FROM weights GROUP BY 1",
    "gold_passages": "SELECT item_id AS q, doc_id AS id FROM documents, benchmark WHERE contains(documents.text, benchmark.text) AND benchmark.text <> ''",
    "dense_filtered": f"SELECT q, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM (SELECT b.vec_id AS q, a.vec_id AS id, {_COSINE} AS score FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0 AND a.label IN ((b.label + 1) % 10, (b.label + 2) % 10))) WHERE rank <= 10",
    "lexical_topk": f"WITH {_LEXICAL} SELECT q, id, rank, round(score, 6) AS score FROM lexical WHERE rank <= 30",
    "lexical_filtered": f"WITH {_LEXICAL} SELECT q, id, CAST(row_number() OVER (PARTITION BY q ORDER BY scores.score DESC, id) AS INTEGER) AS rank, round(scores.score, 6) AS score FROM scores JOIN documents ON doc_id = id WHERE lang = 'en' AND scores.score > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY scores.score DESC, id) <= 10",
    "dense_topk": f"WITH {_NEAR} SELECT q, id, rank, round(score, 6) AS score FROM near WHERE rank <= 30",
    "hybrid_rrf": f"WITH {_LEXICAL}, {_DENSE} SELECT q, id, rank, round(score, 6) AS score FROM ({_hits('hybrid')}) WHERE rank <= 6",
    "retrieval_eval": f"WITH {_LEXICAL}, {_DENSE}, gold AS (SELECT item_id AS q, doc_id AS id FROM documents, benchmark WHERE contains(documents.text, benchmark.text)) {' UNION ALL '.join(map(_scored, ('lexical', 'dense', 'hybrid')))}",
    "recall_by_kind": f"WITH {_NEAR} {' UNION ALL '.join(map(_kind, (1, 3, 10)))}",
    "placeholder_fill": f"SELECT claim_id, 'Balance is ' || CASE WHEN gone THEN '{{{{c' || claim_id || '.gone}}}}' ELSE c_nationkey::VARCHAR END || CASE WHEN typed THEN ' or 12.5' ELSE '' END || '.' AS text FROM ({_CLAIM})",
    "claim_checks": f"SELECT claim_id, 'unknown metric' AS problem FROM ({_CLAIM}) WHERE gone UNION ALL SELECT claim_id, 'typed number' FROM ({_CLAIM}) WHERE typed",
    "template_claims": "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') || ' open and ' || count(*) FILTER (o_orderstatus = 'P') || ' pending' AS text FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'O') > 0 AND count(*) FILTER (o_orderstatus = 'P') > 0",
    "citation_numbering": "SELECT conv_id, role, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY f, role) AS INTEGER) AS number FROM (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY 1, 2)",
    "fold_text": "SELECT doc_id, md5(trim(lower(regexp_replace(strip_accents(text), '\\s+', ' ', 'g')))) AS folded FROM documents",
}
