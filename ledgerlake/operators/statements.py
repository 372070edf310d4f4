"""Coded statement tables read from HTML: rows with spans laid out, code and amount columns, kind, unit, report facts.

Every step after finding the tables is a relation keyed by the document key and the number of the table in it. Only
finding tables and laying out their spans is Python: each document is read once, its tables are written as rows, and lines,
reports and checks read these. A document it can't read gets an error text.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fold, parse_amount, relative_error, sum_with_head
from ..sources.tables import saved

TABLE = r"(?is)<table.*?</table>"
#: The HTML standard bounds both spans.
WIDEST, LONGEST = 1000, 65534

# Patterns over folded text that decide columns, kinds and units.
CODE = r"^\d{1,3}[a-zA-Z]?$"
CODE_HEADER = r"\bma ?so\b|^ms$|^m\.?s\.?$|\bcodes?\b|^ma$"
CLOSING = r"cuoi nam|cuoi ky|nam nay|ky nay|so cuoi|closing|current year|ending"
OPENING = r"dau nam|dau ky|nam truoc|ky truoc|so dau|opening|previous year|prior year|beginning"
INCOME_TITLE = r"ket qua (hoat dong )?kinh doanh|income statement|profit (or|and) loss|b ?02"
CASH_TITLE = r"luu chuyen tien|cash flow|b ?03"
INCOME_WORDS = r"doanh thu ban hang|doanh thu thuan|gia von|loi nhuan gop|chi phi ban hang|chi phi quan ly|thu nhap khac|lai co ban|lai suy giam|chi phi thue|net revenue|net sales|cost of|gross profit|selling expense|administrati|earnings per share|other income"
CASH_WORDS = r"luu chuyen|khau hao|tien chi|tien thu|tang,? ?giam|\(tang\)|tien va (cac khoan )?tuong duong|cash flow|net cash|depreciation|payments? |proceeds|increase|decrease|cash and cash equivalents at"
CONSOLIDATED, ENGLISH = r"hop nhat|consolidated", r"balance sheet|financial position|income statement"
#: Total rows of a balance sheet that are printed without a code.
TOTALS = [(r"^tong (cong )?tai san\b|^total assets", "270"), (r"^tong (cong )?nguon von\b|^total (resources|liabilities and)", "440")]
#: Wordings that the key codes of a statement carry.
KEY_LABELS = {
    "IS": {"10": r"doanh thu thuan|net revenue|net sales|net turnover", "11": r"gia von|cost of", "20": r"loi nhuan gop|lo gop|gross", "50": r"truoc thue|before tax", "60": r"sau thue|after tax|net profit|profit for the"},
    "BS": {"100": r"ngan han|current assets", "200": r"dai han|non-?current|long-?term", "270": r"tong (cong )?tai san|total assets", "300": r"no phai tra|liabilities", "400": r"von chu so huu|equity|nguon von", "440": r"tong (cong )?nguon von|total"},
    "CF": {"20": r"hoat dong (san xuat,? ?)?kinh doanh|operating", "30": r"dau tu|investing", "40": r"tai chinh|financing"},
}
UNITS = [(r"ty (dong|vnd)|billion", 1e9), (r"trieu (dong|vnd)|million|vnd ?million|tr\.? ?d\b", 1e6), (r"(nghin|ngan|1\.000|1000) (dong|vnd)|thousand|'000", 1e3)]


class _Cells(HTMLParser):
    """The cells of a table in source order: rows of (text, rowspan, colspan)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list]] = []
        self.open = False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        self.open = tag in ("td", "th") or self.open and tag != "tr"
        if tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            given = dict(attrs)
            span = [min(most, max(1, int(v))) if (v := (given.get(k) or "").strip()).isdecimal() else 1 for k, most in (("rowspan", LONGEST), ("colspan", WIDEST))]
            self.rows[-1].append(["", *span])
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self.open = False

    def handle_data(self, data):
        if self.open and self.rows and self.rows[-1]:
            self.rows[-1][-1][0] += data


def laid_out(table: str | None) -> list[list[str]]:
    """Rows of a table; a spanning cell has its text in its first place and blanks in the others; rows without cells go."""
    parser = _Cells()
    parser.feed(table or "")
    parser.close()
    below: dict[int, int] = {}  # column: rows that a cell from above still takes
    out = []
    for cells in parser.rows:
        row: list[str] = []
        taken, below = below, {c: n - 1 for c, n in below.items() if n > 1}
        for text, down, across in cells:
            while len(row) in taken:
                row.append("")
            for k in range(across):
                if down > 1:
                    below[len(row)] = down - 1
                row.append("" if k else " ".join(text.split()))
        while len(row) in taken:
            row.append("")
        if row:
            out.append(row)
    return out


#: Characters before a table that may hold its title and unit, and lines of them.
BEFORE, LINES = 3000, 8
_TABLE = re.compile(TABLE)


def tables_of(text: str | None):
    """(text before, line, rows) of each table with a row, one after the other."""
    line = done = 0
    for m in _TABLE.finditer(text or ""):
        line, done = line + text.count("\n", done, m.start()), m.start()
        rows = laid_out(m.group())
        if rows:
            before = _TABLE.sub(" ", text[max(0, m.start() - BEFORE) : m.start()]).split("\n")
            yield " // ".join([x.strip() for x in before if x.strip()][-LINES:]), line, rows


def tables_in(text: str | None) -> tuple[list[tuple[str, int, list[list[str]]]], str | None]:
    """The tables of a document, and what went wrong if anything did: such a document has none."""
    try:
        return list(tables_of(text)), None
    except Exception as e:  # one unreadable document doesn't stop the others
        return [], f"{type(e).__name__}: {e}"[:200]


#: Tables that a task hands on at once: a document of any number of them is never held as a whole.
STEP = 64
#: Characters of a document that say what it is.
HEAD = 4000


def parsed(docs: DataFrame, key: str, html: str, seen=None) -> DataFrame:
    """Every document read once, as rows that are written: (key, table_no, before, line, rows) of each table, and for the document
    itself a row with table_no null, n_tables, error and its head.

    Tables stream out as they are found. `seen`, an accumulator, counts the documents read.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()
    grid = pa.list_(pa.list_(pa.string()))
    names = [key, "table_no", "before", "line", "rows", "n_tables", "error", "head"]

    def run(batches):
        for b in batches:
            ids = b.column(0)
            kinds = (ids.type, pa.int32(), pa.string(), pa.int32(), grid, pa.int32(), pa.string(), pa.string())

            def out(rows, kinds=kinds):
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

            rows = []
            for k, text in zip(ids.to_pylist(), b.column(1), strict=True):
                text, n, error = text.as_py(), 0, None
                if seen is not None:
                    seen.add(1)
                try:
                    for before, line, cells in tables_of(text):
                        rows.append((k, n, before, line, cells, None, None, None))
                        n += 1
                        if len(rows) >= STEP:
                            yield out(rows)
                            rows = []
                except Exception as e:  # one unreadable document doesn't stop the others
                    n, error = 0, f"{type(e).__name__}: {e}"[:200]
                rows.append((k, None, None, None, None, n, error, (text or "")[:HEAD]))
            if rows:
                yield out(rows)

    x = docs.select(key, html).mapInArrow(run, f"`{key}` {kind}, table_no int, before string, line int, rows array<array<string>>, n_tables int, error string, head string")
    return saved(x)


def rows_of(tables: DataFrame, key: str) -> DataFrame:
    """(key, table_no, context, line, row, cells) of parsed(); a document with an error has none.

    `context` is the folded end of the text before the table, outside other tables: its last LINES lines that aren't blank.
    """
    bad = tables.where("table_no is null and error is not null").select(F.col(key).alias("_bad")).distinct()
    good = tables.where("table_no is not null").join(bad, F.col(key).eqNullSafe(F.col("_bad")), "left_anti")
    return good.select(key, "table_no", fold(F.col("before")).alias("context"), "line", F.posexplode("rows").alias("row", "cells"))


def table_rows(docs: DataFrame, key: str, html: str) -> DataFrame:
    """rows_of() the documents' tables; a null document has none."""
    return rows_of(parsed(docs, key, html), key)


def _is_code(x: Column) -> Column:
    return F.trim(x).rlike(CODE)


def code_columns(rows: DataFrame, key: str) -> DataFrame:
    """(key, table_no, code_col): of the first five columns, the one whose header says so or the leftmost with most codes."""
    cells = rows.select(key, "table_no", "row", F.posexplode(F.slice("cells", 1, 5)).alias("col", "text"))
    named = (F.col("row") < 3) & fold(F.col("text")).rlike(CODE_HEADER)
    by_column = cells.groupBy(key, "table_no", "col").agg(F.count_if(_is_code(F.col("text"))).alias("n"), F.min(F.when(named, F.col("row"))).alias("head")).where("n > 0")
    chosen = by_column.groupBy(key, "table_no").agg(
        F.max("n").alias("most"),
        F.min(F.when((F.col("n") >= 3) & F.col("head").isNotNull(), F.struct("head", "col"))).alias("named"),
        F.collect_list(F.struct("n", "col")).alias("all"),
    )
    leftmost = F.array_min(F.transform(F.filter("all", lambda x: x["n"] >= 0.8 * F.col("most")), lambda x: x["col"]))
    return chosen.where("most >= 3").select(key, "table_no", F.coalesce(F.col("named.col"), leftmost).alias("code_col"))


def coded_rows(rows: DataFrame, key: str) -> DataFrame:
    """rows of tables that have a code column, with code (null where the row has none), the label's text and the folded label."""
    x = rows.join(code_columns(rows, key), [key, "table_no"])
    code = F.trim(F.get("cells", F.col("code_col")))
    words = F.filter("cells", lambda c, k: (k != F.col("code_col")) & (F.length(F.regexp_replace(c, r"[^\p{L}]", "")) >= 3))
    x = x.withColumn("code", F.when(code.rlike(CODE), code)).withColumn("text", F.trim(F.array_join(words, " ")))
    return x.withColumn("label", fold(F.col("text")))


def value_columns(coded: DataFrame, key: str) -> DataFrame:
    """(key, table_no, cur_col, prev_col, from_header): the last two amount columns, ordered by years or cue words."""
    cells = coded.where("code is not null").select(key, "table_no", "code_col", F.posexplode("cells").alias("col", "text")).where("col > code_col")
    amount = (F.abs(parse_amount(F.col("text"))) >= 1000) | F.trim("text").isin("-", "–", "—")
    numeric = cells.groupBy(key, "table_no", "col").agg(F.count_if(amount).alias("n"))
    sizes = coded.groupBy(key, "table_no").agg(F.count("code").alias("codes"))
    kept = numeric.join(sizes, [key, "table_no"]).where(F.col("n") >= F.greatest(F.lit(2.0), 0.3 * F.col("codes")))
    pair = kept.groupBy(key, "table_no").agg(F.sort_array(F.collect_list("col")).alias("cols")).where("size(cols) >= 2")
    pair = pair.select(key, "table_no", F.element_at("cols", -2).alias("a"), F.element_at("cols", -1).alias("b"))
    heads = coded.where("row < 4 and code is null").join(pair, [key, "table_no"])
    text = lambda c: fold(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", F.coalesce(F.get("cells", F.col(c)), F.lit("")).alias("t")))), lambda x: x["t"]), " "))
    heads = heads.groupBy(key, "table_no").agg(text("a").alias("ha"), text("b").alias("hb"))
    year = lambda c: F.array_max(F.regexp_extract_all(c, F.lit(r"(?<!\d)(20[0-3]\d)(?!\d)"), F.lit(1)))
    x = pair.join(heads, [key, "table_no"], "left").withColumn("ya", year("ha")).withColumn("yb", year("hb"))
    hint = lambda c, p: F.coalesce(F.col(c).rlike(p), F.lit(False))
    first = F.when(F.col("ya") != F.col("yb"), F.col("ya") > F.col("yb")).when(hint("ha", OPENING) & hint("hb", CLOSING), False).when(hint("ha", CLOSING) & hint("hb", OPENING), True)
    x = x.withColumn("first", first).withColumn("swap", ~F.coalesce("first", F.lit(True)))
    return x.select(key, "table_no", F.when(F.col("swap"), F.col("b")).otherwise(F.col("a")).alias("cur_col"), F.when(F.col("swap"), F.col("a")).otherwise(F.col("b")).alias("prev_col"), F.col("first").isNotNull().alias("from_header"))


def kinds(coded: DataFrame, key: str) -> DataFrame:
    """(key, table_no, kind, unit): BS, IS, CF or null; unit from the text before the table and its first rows."""
    long = F.length(F.regexp_replace("code", r"\D", "")) == 3
    t = coded.groupBy(key, "table_no").agg(
        F.count("code").alias("n"),
        F.count_if(long).alias("three"),
        F.count_if(F.col("code").isNotNull() & F.col("label").rlike(INCOME_WORDS)).alias("income"),
        F.count_if(F.col("code").isNotNull() & F.col("label").rlike(CASH_WORDS)).alias("cash"),
        F.first("context").alias("context"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("row") < 3, F.struct("row", fold(F.array_join("cells", " ")).alias("t"))))).getField("t"), " ").alias("top"),
    )
    tail = F.expr("right(context, 260)")
    says_income, says_cash = tail.rlike(INCOME_TITLE), tail.rlike(CASH_TITLE)
    income = F.col("income") + F.when(says_income & ~says_cash, 2).otherwise(0)
    cash = F.col("cash") + F.when(says_cash & ~says_income, 2).otherwise(0)
    kind = F.when(F.col("n") < 3, None).when(F.col("three") >= 0.6 * F.col("n"), "BS").when(F.col("three") > 0.3 * F.col("n"), None).when(income + cash == 0, None).when(income > cash, "IS").otherwise("CF")
    # a unit further up belongs to something else
    said = F.concat_ws(" ", F.expr("right(context, 200)"), "top")
    unit = F.coalesce(*[F.when(said.rlike(p), F.lit(v)) for p, v in UNITS], F.lit(1.0))
    return t.select(key, "table_no", kind.alias("kind"), unit.alias("unit"), F.expr("right(context, 200)").alias("title"))


def statement_tables(coded: DataFrame, key: str) -> DataFrame:
    """(key, table_no, kind, cur_col, prev_col, unit, title, from_header) of tables that are statements; the last three are those of the first table of the kind."""
    x = value_columns(coded, key).join(kinds(coded, key).where("kind is not null"), [key, "table_no"])
    first = x.groupBy(key, "kind").agg(F.min_by(F.struct("unit", "title", "from_header"), "table_no").alias("first"))
    return x.drop("unit", "title", "from_header").join(first, [key, "kind"]).select(key, "table_no", "kind", "cur_col", "prev_col", "first.*")


def statement_lines(docs: DataFrame, key: str, html: str) -> DataFrame:
    """(key, statement, code, label, cur, prev, unit): of codes that a document repeats, the first in table and row order.

    Rows too short for both amounts are passed over. Total rows of a balance sheet without a code are known by their label.
    """
    coded = coded_rows(table_rows(docs, key, html), key)
    return lines_of(coded, statement_tables(coded, key), key)


def lines_of(coded: DataFrame, tables: DataFrame, key: str) -> DataFrame:
    x = coded.join(tables, [key, "table_no"]).where(F.size("cells") > F.greatest("code_col", "cur_col", "prev_col"))
    at = lambda c: parse_amount(F.get("cells", F.col(c)))
    digits = F.regexp_extract("code", r"\d+", 0)
    printed = F.concat(F.when(F.length(digits) == 1, F.lpad(digits, 2, "0")).otherwise(digits), F.lower(F.regexp_extract("code", r"[a-zA-Z]?$", 0)))
    total = F.coalesce(*[F.when((F.col("kind") == "BS") & F.col("label").rlike(p), F.lit(c)) for p, c in TOTALS])
    x = x.select(key, F.col("kind").alias("statement"), F.coalesce(printed, total).alias("code"), F.struct("table_no", "row").alias("at"), F.struct(F.substring("text", 1, 80).alias("label"), at("cur_col").alias("cur"), at("prev_col").alias("prev"), "unit").alias("line"))
    return x.where("code is not null").groupBy(key, "statement", "code").agg(F.min_by("line", "at").alias("line")).select(key, "statement", "code", "line.*")


#: Codes that the identities read.
IDENTITY_CODES = [(k, c) for k, cs in (("BS", "100 200 270 300 400 440"), ("IS", "10 11 20"), ("CF", "20 30 40 50")) for c in cs.split()]


def checks(lines: DataFrame, key: str) -> DataFrame:
    """A row for each document of lines(key, statement, code, label, cur, prev), in one aggregation: err_assets, err_funding,
    err_balance, err_gross, err_cash, label_BS, label_IS, label_CF, n_BS, n_IS, n_CF.

    An error is the larger relative gap of both columns, null where an amount is missing in both; a total that is lost
    counts as the sum of its parts in err_balance. A label share is that of a statement's key codes that are there with
    their wording.
    """
    at = lambda k, c: (F.col("statement") == k) & (F.col("code") == c)
    amounts = [F.max(F.when(at(k, c), F.col(w))).alias(f"{k}{c}{w}") for k, c in IDENTITY_CODES for w in ("cur", "prev")]
    hits = [F.max((at(k, c) & F.col("_label").rlike(p)).cast("int")).alias(f"hit_{k}{c}") for k, keys in KEY_LABELS.items() for c, p in keys.items()]
    sizes = [F.count_if(F.col("statement") == k).cast("int").alias(f"n_{k}") for k in KEY_LABELS]
    asked = F.coalesce(*[F.when(F.col("statement") == k, F.col("code").isin(*keys)) for k, keys in KEY_LABELS.items()])
    x = lines.withColumn("_label", fold(F.when(asked, F.col("label")))).groupBy(key).agg(*amounts, *hits, *sizes)
    return _checked(x, [key])


def place(statement: Column, code: Column) -> Column:
    """Where a line stands: one value for statement and code."""
    return F.concat(statement, F.lit(" "), code)


#: A report's lines as arrays side by side: place, folded label, current and prior amount of each line. A code stands once.
LINE_ARRAYS = ("places", "labels", "currents", "priors")
_PART = dict(zip(("label", "cur", "prev"), LINE_ARRAYS[1:], strict=True))


def line_at(statement: str, code: str, part: str) -> Column:
    """label, cur or prev of the line at a code in LINE_ARRAYS; null where there is none."""
    return F.get(F.col(_PART[part]), (F.array_position("places", F.lit(f"{statement} {code}")) - 1).cast("int"))


def checks_within(reports: DataFrame) -> DataFrame:
    """reports with the columns of checks(); each report holds its lines as LINE_ARRAYS, so nothing is shuffled."""
    amounts = [line_at(k, c, w).alias(f"{k}{c}{w}") for k, c in IDENTITY_CODES for w in ("cur", "prev")]
    hits = [line_at(k, c, "label").rlike(p).cast("int").alias(f"hit_{k}{c}") for k, keys in KEY_LABELS.items() for c, p in keys.items()]
    of = F.transform("places", lambda at: F.substring_index(at, " ", 1))
    sizes = [F.coalesce(F.size(of) - F.size(F.array_remove(of, k)), F.lit(0)).alias(f"n_{k}") for k in KEY_LABELS]
    own = [c for c in reports.columns if c not in LINE_ARRAYS]
    return _checked(reports.select(*own, *amounts, *hits, *sizes), own)


def _checked(x: DataFrame, own: list[str]) -> DataFrame:
    """own columns, errors, label shares and sizes, from the amounts and label hits of each document."""

    def gaps(w: str) -> dict[str, Column]:
        v = lambda k, c: F.col(f"{k}{c}{w}")
        assets, funding = sum_with_head(v("BS", "100"), v("BS", "200")), sum_with_head(v("BS", "300"), v("BS", "400"))
        gross = v("IS", "10") - F.abs(F.coalesce(v("IS", "11"), F.lit(0.0)))
        return {
            "err_assets": relative_error(v("BS", "270"), assets),
            "err_funding": relative_error(v("BS", "440"), funding),
            "err_balance": F.least(*[relative_error(a, f) for a in (v("BS", "270"), assets) for f in (v("BS", "440"), funding)]),
            "err_gross": relative_error(v("IS", "20"), gross),
            "err_cash": relative_error(v("CF", "50"), sum_with_head(v("CF", "20"), v("CF", "30"), v("CF", "40"))),
        }

    cur, prev = gaps("cur"), gaps("prev")
    shares = [(sum(F.coalesce(F.col(f"hit_{k}{c}"), F.lit(0)) for c in keys) / F.lit(float(len(keys)))).alias(f"label_{k}") for k, keys in KEY_LABELS.items()]
    return x.select(*own, *[F.greatest(cur[n], prev[n]).alias(n) for n in cur], *shares, *[f"n_{k}" for k in KEY_LABELS])


def identities(lines: DataFrame, key: str) -> DataFrame:
    return checks(lines, key).select(key, "err_assets", "err_funding", "err_balance", "err_gross", "err_cash")


def reports(docs: DataFrame, key: str, html: str) -> DataFrame:
    """A row for each document: counts, flags, identities, label shares, units and number of lines of its statements, error."""
    tables = parsed(docs, key, html)
    base = tables.where("table_no is null").select(key, fold(F.col("head")).alias("head"), "n_tables", "error")
    coded = saved(coded_rows(rows_of(tables, key), key))
    tables = statement_tables(coded, key)
    lines = lines_of(coded, tables, key)
    # titles in the order in which the kinds of statement begin
    kinds_ = tables.groupBy(key, "kind").agg(F.min(F.struct("table_no", "title")).alias("t"), F.count(F.lit(1)).alias("n"))
    titles = kinds_.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["title"]), " ").alias("titles"), F.sum("n").cast("int").alias("n_coded_tables"))
    units = lines.groupBy(key).agg(*[F.max(F.when(F.col("statement") == s, F.col("unit"))).alias(f"unit_{s}") for s in KEY_LABELS])
    x = base
    for part in (titles, units, checks(lines, key)):
        x = x.join(part, key, "left")
    said = F.coalesce("titles", F.lit(""))
    x = x.withColumn("consolidated_title", F.concat_ws(" ", said, "head").rlike(CONSOLIDATED)).withColumn("english", said.rlike(ENGLISH)).drop("head", "titles")
    return x.fillna(0, ["n_coded_tables", *[f"n_{s}" for s in KEY_LABELS]]).fillna(0.0, [f"label_{s}" for s in KEY_LABELS])
