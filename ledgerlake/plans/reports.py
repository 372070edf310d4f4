"""Questions, planned searches, claims and citations over the driver tables, through the operators of claims and search.

Customers stand in for companies under tickers of three letters; documents are dealt to customers and years as pages of
their reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import claims as R
from ..operators import search as S
from ..sources.tables import parquet, saved, scratch
from .retrieval import _TOKENS, PLACES

#: Companies that documents are dealt to, and the years of their reports.
COMPANIES, FIRST, YEARS = 40, 2021, 4


def ticker(k: Column) -> Column:
    """Three letters for a number under 26 ** 3; larger ones begin anew."""
    letter = lambda n: F.chr(F.lit(65) + (k / F.lit(n)).cast("long") % 26)
    return F.concat(letter(676), letter(26), letter(1))


_TICKER = "chr(CAST(65 + {k} // 676 % 26 AS INTEGER)) || chr(CAST(65 + {k} // 26 % 26 AS INTEGER)) || chr(CAST(65 + {k} % 26 AS INTEGER))"


def pages(spark, d) -> DataFrame:
    """id, entity, year, page, text: every document as a page."""
    k = F.col("doc_id")
    return parquet(spark, d, "documents").select(k.alias("id"), ticker(k % COMPANIES).alias("entity"), (k % YEARS + FIRST).cast("int").alias("year"), (k / COMPANIES + 1).cast("int").alias("page"), "text")


def questions(spark, d) -> DataFrame:
    """One question for each customer: of one, two or no known company, with two years, one or none, in either language."""
    c = F.col("c_custkey")
    years = F.when(c % 3 == 0, " 2022 2023").when(c % 3 == 1, " 2031").otherwise("")
    who = F.when(c % 5 == 0, F.concat(ticker(c % COMPANIES), F.lit(" vs "), ticker((c + 7) % COMPANIES))).when(c % 5 == 1, F.lit("ZZZ")).otherwise(ticker(c % COMPANIES))
    words = F.when(c % 2 == 0, "Vì sao doanh thu thay đổi: ").otherwise("What changed revenue of ")
    return parquet(spark, d, "customer").select(c.alias("report"), F.concat(words, who, years).alias("question"))


def question_intents(spark, d):
    """What each question asks for."""
    x = R.intents(questions(spark, d), pages(spark, d).select("entity", "year").distinct())
    return x.select("report", F.array_join("entities", ",").alias("entities"), "start_year", "end_year", "kind", "language")


def declined_questions(spark, d):
    return R.declined(R.intents(questions(spark, d), pages(spark, d).select("entity", "year").distinct()))


def asked(spark, d) -> DataFrame:
    """report, entity, start_year, end_year: two companies a report; the last company has no pages."""
    rows = spark.range(COMPANIES + 1).select((F.col("id") / 2).cast("long").alias("report"), ticker(F.col("id")).alias("entity"), F.lit(FIRST).alias("start_year"), (F.lit(FIRST) + F.col("id") % 3 + 1).cast("int").alias("end_year"))
    return rows.join(parquet(spark, d, "documents").select(F.lit(1)).limit(1))  # nothing is asked where there is no document


def planned_searches(spark, d):
    """The questions asked of each company's pages."""
    return R.planned(asked(spark, d), pages(spark, d), spark)


def unplanned_companies(spark, d):
    return R.unplanned(asked(spark, d), pages(spark, d), "en")


def batch_search(spark, d):
    """All planned questions in one batch, each within the pages of its company and year: the best two of each, a page once a report.

    Questions also look for the commonest word of the tables' languages, so that they find something here.
    """
    p = pages(spark, d).withColumn("tag", F.concat_ws("/", "entity", "year"))
    index = S.Index.write(p.select("id", "text", "tag"), scratch(spark), tag="tag")
    q = planned_searches(spark, d).withColumn("q", F.concat_ws("/", "report", "entity", "year", "k")).withColumn("tags", F.array(F.concat_ws("/", "entity", "year"))).withColumn("text", F.concat("text", F.lit(" the de and die of la")))
    hits = S.lexical(index, q.select("q", "text", "tags"), 2, "tags", PLACES)
    found = S.gathered(q.select("q", "report", "topic", F.concat_ws("/", F.lpad(F.col("k").cast("string"), 2, "0"), "entity", "year").alias("k")), hits)
    return found.select("report", "id", "topic", "rank")


def claims(spark, d) -> DataFrame:
    """Ten kinds of claims, by remainder of the customer's number: right ones and one of each rule broken."""
    c = F.col("c_custkey")
    id_ = lambda name, period: F.concat(F.lit("{{"), c.cast("string"), F.lit(f".{name}.{period}}}}}"))
    texts = [
        F.concat(F.lit("Revenue was "), id_("revenue", 2024), F.lit(".")),
        F.concat(F.lit("Revenue was "), id_("revenue", 2030), F.lit(".")),
        F.concat(F.lit("Sales rose "), id_("rev_g", 2024), F.lit(".")),
        F.concat(F.lit("Sales fell "), id_("rev_g", 2024), F.lit(".")),
        F.concat(F.lit("From "), id_("revenue", 2023), F.lit(" it grew to "), id_("revenue", 2024), F.lit(".")),
        F.concat(F.lit("From "), id_("revenue", 2023), F.lit(" it declined to "), id_("revenue", 2024), F.lit(".")),
        F.concat(F.lit("Orders of "), (c + 1000).cast("string"), F.lit(" were met.")),
        F.concat(F.lit("Orders of "), (c + 7).cast("string"), F.lit(",5 were met.")),
        F.lit("The outlook is bright."),
        F.lit("Nothing else is known in 2024."),
    ]
    text = F.coalesce(*[F.when(c % 10 == k, t) for k, t in enumerate(texts)])
    cited = F.when(c % 10 == 6, F.array(F.concat(F.lit("p"), c.cast("string")))).when(c % 10 == 7, F.array(F.concat(F.lit("p"), c.cast("string")), F.lit("gone"))).when(c % 10 == 9, F.array(F.lit("gone"))).otherwise(F.array().cast("array<string>"))
    return parquet(spark, d, "customer").select((c % 5).alias("report"), c.alias("claim_id"), F.lit("revenue").alias("section"), text.alias("text"), cited.alias("evidence_ids"))


def metrics(spark, d) -> DataFrame:
    """Revenue of two years, which rises for even numbers of the nation, and its growth."""
    c = parquet(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("entity"), F.when(F.col("c_nationkey") % 2 == 0, 1.0).otherwise(-1.0).alias("s"))
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("period"), v.alias("value"), F.lit(u).alias("unit"), F.lit(w).alias("label")) for n, p, v, u, w in (("revenue", "2023", F.lit(5e12), "vnd", "Net revenue"), ("revenue", "2024", 5e12 + 1e12 * F.col("s"), "vnd", "Net revenue"), ("rev_g", "2024", 0.2 * F.col("s"), "pct", "Revenue growth"))])
    x = c.select("entity", F.explode(rows).alias("m")).select("entity", "m.*")
    return x.select("entity", F.concat_ws(".", "entity", "name", "period").alias("id"), "name", "period", "value", "unit", "label", F.lit("s").alias("source"))


def evidence(spark, d) -> DataFrame:
    """A passage for each customer, which prints the figure of every second one with points."""
    c = F.col("c_custkey")
    text = F.concat(F.lit("In the year, orders of "), F.when(c % 20 == 6, (c + 1000).cast("string")).when(c % 20 == 16, "none").otherwise(F.concat((c + 7).cast("string"), F.lit(".5"))), F.lit(" were met."))
    return parquet(spark, d, "customer").select(F.concat(F.lit("p"), c.cast("string")).alias("id"), text.alias("text"), ticker(c % COMPANIES).alias("entity"), (c % YEARS + FIRST).cast("int").alias("year"), (c % 9 + 1).cast("int").alias("page"))


def _checked(spark, d) -> tuple[DataFrame, DataFrame]:
    c = claims(spark, d)
    found = R.problems(c, metrics(spark, d), evidence(spark, d))
    verdicts = c.where("claim_id % 30 = 6").select("claim_id", F.lit("unsupported").alias("verdict"))
    return R.checked(c, found, verdicts), found


def claim_problems(spark, d):
    """What speaks against each claim."""
    return _checked(spark, d)[1]


def claim_statistics(spark, d):
    """How the claims of each report stand."""
    return R.statistics(_checked(spark, d)[0], "report")


def judge_view(spark, d):
    """Claims as a judge reads them: figures with what they are."""
    return R.filled(claims(spark, d), R.for_judges(metrics(spark, d), "en")).select("claim_id", "text")


def cited_sources(spark, d):
    """The numbered sources of each report, as they are printed."""
    kept = _checked(spark, d)[0]
    e = evidence(spark, d)
    return R.numbered(kept).join(R.large(e), "id").select("report", "number", "id", R.citation(F.col("entity"), F.col("year"), F.col("page"), "en").alias("source"))


def rendered_reports(spark, d):
    """Whole reports in Markdown: claims, sources, notes and how the claims stand."""
    kept = saved(_checked(spark, d)[0])
    a = kept.select("report").distinct().select("report", F.lit(0).alias("pos"), F.lit("1").alias("entity"), F.lit(2023).alias("start_year"), F.lit(2024).alias("end_year"))
    notes = a.where("report % 2 = 1").select("report", "entity", F.lit("figures in billions").alias("note"))
    topics = spark.createDataFrame([], "report long, id string, topic string, rank int")
    out = R.rendered(a, kept, metrics(spark, d), evidence(spark, d), topics, notes, "en", spark)
    return out.select("report", F.md5("markdown").alias("markdown"), F.length("markdown").alias("length"))


QUERIES = {f.__name__: f for f in (question_intents, declined_questions, planned_searches, unplanned_companies, batch_search, claim_problems, claim_statistics, judge_view, cited_sources, rendered_reports)}

_PAGES = f"pages AS (SELECT doc_id AS id, {_TICKER.format(k=f'(doc_id % {COMPANIES})')} AS entity, CAST(doc_id % {YEARS} + {FIRST} AS INTEGER) AS year, text FROM documents), latest AS (SELECT entity, max(year) AS latest FROM pages GROUP BY 1)"
_QUESTIONS = f"""qs AS (SELECT c_custkey AS c, {_TICKER.format(k=f'(c_custkey % {COMPANIES})')} AS a, {_TICKER.format(k=f'((c_custkey + 7) % {COMPANIES})')} AS b FROM customer),
named AS (SELECT c, unnest(CASE WHEN c % 5 = 0 THEN [a, b] WHEN c % 5 = 1 THEN ['ZZZ'] ELSE [a] END) AS entity, generate_subscripts(CASE WHEN c % 5 = 0 THEN [a, b] ELSE [a] END, 1) AS pos FROM qs),
known AS (SELECT c, list(n.entity ORDER BY pos) AS entities, max(latest) AS latest FROM named n JOIN latest l ON l.entity = n.entity GROUP BY 1),
spans AS (SELECT qs.c, coalesce(entities, []) AS entities, CASE WHEN c % 3 = 0 AND latest > 2023 THEN 2023 ELSE latest END AS e FROM qs LEFT JOIN known USING (c))"""
_ASKED = f"asked AS (SELECT k // 2 AS report, {_TICKER.format(k='k')} AS entity, {FIRST} AS s, CAST({FIRST} + k % 3 + 1 AS INTEGER) AS e FROM range({COMPANIES + 1}) t(k)), covered AS (SELECT DISTINCT report, a.entity, year FROM asked a JOIN pages p ON p.entity = a.entity AND year >= greatest(s, e - 1) AND year <= e)"
_LOOKED = ", ".join(f"({k}, '{t}', '{w}', '{o}')" for k, (t, w, o) in enumerate(R.LOOKED_FOR))
_PLANNED = f"planned AS (SELECT report, entity, k, topic, year, words || ' ' || entity || ' ' || CASE WHEN of_ = 'next' THEN year + 1 ELSE year END AS text FROM (SELECT *, max(year) OVER (PARTITION BY report, entity) AS last FROM covered) c, (VALUES {_LOOKED}) t(k, topic, words, of_) WHERE of_ = 'both' OR year = last)"
_RISES = "(c_nationkey % 2 = 0)"
_PROBLEMS = f"""found AS (SELECT c_custkey AS claim_id, 'unknown metric' AS kind, c_custkey || '.revenue.2030' AS detail FROM customer WHERE c_custkey % 10 = 1
UNION ALL SELECT c_custkey, 'direction', 'rose ' || c_custkey || '.rev_g.2024' FROM customer WHERE c_custkey % 10 = 2 AND NOT {_RISES} UNION ALL SELECT c_custkey, 'direction', 'fell ' || c_custkey || '.rev_g.2024' FROM customer WHERE c_custkey % 10 = 3 AND {_RISES}
UNION ALL SELECT c_custkey, 'wording', c_custkey || '.revenue.2023 ' || c_custkey || '.revenue.2024' FROM customer WHERE (c_custkey % 10 = 4 AND NOT {_RISES}) OR (c_custkey % 10 = 5 AND {_RISES})
UNION ALL SELECT c_custkey, 'number', (c_custkey + 1000)::VARCHAR FROM customer WHERE c_custkey % 20 = 16 AND NOT regexp_matches((c_custkey + 1000)::VARCHAR, '^(19|20)\\d\\d$')
UNION ALL SELECT c_custkey, 'unknown evidence', 'gone' FROM customer WHERE c_custkey % 10 IN (7, 9) UNION ALL SELECT c_custkey, 'no support', '' FROM customer WHERE c_custkey % 10 = 8)"""
_KEPT = f"{_PROBLEMS}, stands AS (SELECT c_custkey AS c, c_custkey NOT IN (SELECT claim_id FROM found) AS passed, c_custkey % 10 IN (6, 7, 9) AS cited, c_custkey % 30 = 6 AS refused FROM customer)"
_SHOWN_NOW = f"'VND ' || CASE WHEN {_RISES} THEN '6,000' ELSE '4,000' END || ' bn'"
_RATE = f"CASE WHEN {_RISES} THEN '20.0%' ELSE '-20.0%' END"


def _text(revenue: str, before: str, rate: str, unknown: str) -> str:
    return f"""CASE c_custkey % 10 WHEN 0 THEN 'Revenue was ' || {revenue} || '.' WHEN 1 THEN 'Revenue was ' || {unknown} || '.' WHEN 2 THEN 'Sales rose ' || {rate} || '.' WHEN 3 THEN 'Sales fell ' || {rate} || '.' WHEN 4 THEN 'From ' || {before} || ' it grew to ' || {revenue} || '.' WHEN 5 THEN 'From ' || {before} || ' it declined to ' || {revenue} || '.' WHEN 6 THEN 'Orders of ' || (c_custkey + 1000) || ' were met.' WHEN 7 THEN 'Orders of ' || (c_custkey + 7) || ',5 were met.' WHEN 8 THEN 'The outlook is bright.' ELSE 'Nothing else is known in 2024.' END"""


_UNKNOWN = "'{{' || c_custkey || '.revenue.2030}}'"
_JUDGED = _text(f"'⟦' || {_SHOWN_NOW} || ' = Net revenue, 2024⟧'", "'⟦VND 5,000 bn = Net revenue, 2023⟧'", f"'⟦' || {_RATE} || ' = Revenue growth, 2024⟧'", _UNKNOWN)
_READ = _text(_SHOWN_NOW, "'VND 5,000 bn'", _RATE, _UNKNOWN)
_CITED = f"cited AS (SELECT c % 5 AS report, c, row_number() OVER (PARTITION BY c % 5 ORDER BY c) AS number, {_TICKER.format(k=f'(c % {COMPANIES})')} || ' Annual Report ' || (c % {YEARS} + {FIRST}) || ', p. ' || (c % 9 + 1) AS source FROM stands WHERE passed AND cited AND NOT refused)"
_STATS = "stats AS (SELECT c % 5 AS report, count(*) AS claims, count(*) FILTER (passed AND NOT (cited AND refused)) AS kept, count(*) FILTER (NOT passed) AS dropped_deterministic, count(*) FILTER (passed AND refused) AS dropped_unsupported, count(*) FILTER (passed AND cited) AS qualitative, 0::BIGINT AS supported, 0::BIGINT AS partial, count(*) FILTER (passed AND cited AND NOT refused) AS unchecked FROM stands GROUP BY 1)"
_LINES = f"""lines AS (SELECT c_custkey % 5 AS report, string_agg('- ' || {_READ} || coalesce(' [' || number || ']', ''), chr(10) ORDER BY c_custkey) AS body FROM customer JOIN stands ON c = c_custkey LEFT JOIN cited ON cited.c = c_custkey WHERE passed AND NOT (stands.cited AND refused) GROUP BY 1),
refs AS (SELECT report, string_agg('- [' || number || '] ' || source, chr(10) ORDER BY number) AS body FROM cited GROUP BY 1)"""
_MARKDOWN = """'# Research note: 1 (2023–2024)' || chr(10) || chr(10) || chr(10) || '## Revenue' || chr(10) || chr(10) || l.body || chr(10) || CASE WHEN s.report % 2 = 1 THEN chr(10) || '## Notes' || chr(10) || chr(10) || '- figures in billions' || chr(10) ELSE '' END
 || chr(10) || '## Checks' || chr(10) || chr(10) || CASE WHEN qualitative = 0 THEN '- No qualitative statements.' WHEN unchecked = qualitative THEN '- Statements cited but not checked: ' || qualitative ELSE '- Statements supported, partly supported, all: 0, 0, ' || qualitative END || CASE WHEN claims > kept THEN chr(10) || '- Removed: ' || (claims - kept) ELSE '' END
 || chr(10) || chr(10) || '## References' || chr(10) || chr(10) || '- Audited statements 2023–2024' || coalesce(chr(10) || r.body, '')"""
ORACLES = {
    "question_intents": f"WITH {_PAGES}, {_QUESTIONS} SELECT c AS report, array_to_string(entities, ',') AS entities, CAST(CASE WHEN c % 3 = 0 AND 2022 < e THEN 2022 ELSE e - {R.SPAN} + 1 END AS INTEGER) AS start_year, e AS end_year, CASE WHEN len(entities) > 1 THEN 'compare' WHEN len(entities) = 1 THEN 'analyze' END AS kind, CASE WHEN c % 2 = 0 THEN 'vi' ELSE 'en' END AS language FROM spans",
    "declined_questions": f"WITH {_PAGES}, {_QUESTIONS} SELECT c AS report, CASE WHEN c % 2 = 0 THEN 'Câu hỏi không nêu công ty nào có báo cáo.' ELSE 'The question names no company that has reports.' END AS message FROM spans WHERE len(entities) = 0",
    "planned_searches": f"WITH {_PAGES}, {_ASKED}, {_PLANNED} SELECT * FROM planned",
    "unplanned_companies": f"WITH {_PAGES}, {_ASKED} SELECT report, entity, 'Documents: none of ' || entity || ' for these years; nothing is said beyond figures.' AS note FROM asked WHERE (report, entity) NOT IN (SELECT (report, entity) FROM covered)",
    "batch_search": f"""WITH {_TOKENS}, {_PAGES}, {_ASKED}, {_PLANNED}, idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1 AS idf FROM df),
q AS (SELECT *, report || '/' || entity || '/' || year || '/' || k AS q, regexp_extract_all(lower(text || ' the de and die of la'), '[\\p{{L}}\\p{{N}}_]+') AS t FROM planned),
qterms AS (SELECT q, unnest(t) AS term FROM q UNION ALL SELECT q, unnest(list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1])) FROM q WHERE len(t) > 1),
qraw AS (SELECT q, c.term, (1 + ln(n)) * idf AS w FROM (SELECT q, term, count(*) AS n FROM qterms GROUP BY 1, 2) c JOIN idf ON idf.term = c.term), qw AS (SELECT q, term, w / sqrt(sum(w * w) OVER (PARTITION BY q)) AS asked FROM qraw),
hits AS (SELECT q.q, q.report, q.topic, printf('%02d', q.k) || '/' || q.entity || '/' || q.year AS k, p.id, round(sum(w.weight * qw.asked), 8) AS score FROM q JOIN qw ON qw.q = q.q JOIN pages p ON p.entity = q.entity AND p.year = q.year JOIN weights w ON w.doc_id = p.id AND w.term = qw.term GROUP BY ALL HAVING round(sum(w.weight * qw.asked), 8) > 0),
top AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM hits QUALIFY rank <= 2), once AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY report, id ORDER BY k, rank) = 1)
SELECT report, id, topic, CAST(row_number() OVER (PARTITION BY report, topic ORDER BY k, rank, id) AS INTEGER) AS rank FROM once""",
    "claim_problems": f"WITH {_PROBLEMS} SELECT * FROM found",
    "claim_statistics": f"WITH {_KEPT}, {_STATS} SELECT * FROM stats",
    "judge_view": f"SELECT c_custkey AS claim_id, {_JUDGED} AS text FROM customer",
    "cited_sources": f"WITH {_KEPT}, {_CITED} SELECT report, CAST(number AS INTEGER) AS number, 'p' || c AS id, source FROM cited",
    "rendered_reports": f"WITH {_KEPT}, {_CITED}, {_STATS}, {_LINES} SELECT s.report, md5({_MARKDOWN}) AS markdown, CAST(length({_MARKDOWN}) AS INTEGER) AS length FROM stats s JOIN lines l ON l.report = s.report LEFT JOIN refs r ON r.report = s.report",
}
