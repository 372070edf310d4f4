"""Layout, statement tables and report facts on small fixtures."""

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import layout, quality, statements


def _table(*rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def test_spans():
    assert statements.laid_out('<table><tr><td rowspan="2">a</td><td colspan=2>b</td></tr><tr><td>c</td></tr><tr><td></td></tr><tr></tr></table>') == [["a", "b", ""], ["", "c"], [""]]
    assert statements.laid_out(None) == [] and statements.laid_out("<table></table>") == []
    assert statements.laid_out('<table><tr><td rowspan="x">a&amp;b</td></tr></table>') == [["a&b"]]


def test_income_statement(spark):
    rows = [("Code", "Item", "2023", "2024"), ("01", "Net revenue", "1,000", "2,000"), ("11", "Cost of sales", "3,000", "4,000"), ("20", "Gross profit", "(5,000)", "-"), ("20", "Again", "7,000", "8,000")]
    docs = spark.createDataFrame([(1, "x\nIncome statement\nUnit: million dong\n" + _table(*rows)), (2, None), (3, ""), (4, _table(("a", "b")))], "id long, html string")
    got = {r["code"]: (r["statement"], r["cur"], r["prev"], r["unit"]) for r in statements.statement_lines(docs, "id", "html").collect()}
    assert got == {"01": ("IS", 2000.0, 1000.0, 1e6), "11": ("IS", 4000.0, 3000.0, 1e6), "20": ("IS", 0.0, -5000.0, 1e6)}


# Wordings of a balance sheet whose totals agree, in the order (code, label, current, prior).
BALANCE = [("100", "A. TÀI SẢN NGẮN HẠN", "600", "500"), ("200", "B. TÀI SẢN DÀI HẠN", "400", "300"), ("270", "TỔNG CỘNG TÀI SẢN", "1.000", "800"), ("300", "C. NỢ PHẢI TRẢ", "700", "500"), ("400", "D. VỐN CHỦ SỞ HỮU", "300", "300"), ("440", "TỔNG CỘNG NGUỒN VỐN", "1.000", "800")]
MILLIONS = ".000.000"
LAYOUTS = {
    "code first, years": (("Mã số", "TÀI SẢN", "Thuyết minh", "2024 VND", "2023 VND"), lambda c, t, a, b: (c, t, "", a, b)),
    "label first, cues": (("CHỈ TIÊU", "Mã số", "Thuyết minh", "Số cuối năm", "Số đầu năm"), lambda c, t, a, b: (t, c, "5", a, b)),
    "label in two cells": (("", "CHỈ TIÊU", "Mã số", "Thuyết minh", "Số cuối năm", "Số đầu năm"), lambda c, t, a, b: ("I.", t, c, "V.1", a, b)),
    "prior column first": (("CHỈ TIÊU", "Mã số", "Số đầu năm", "Số cuối năm"), lambda c, t, a, b: (t, c, b, a)),
    "years glued to letters": (("Mã số", "TÀI SẢN", "nam2023", "nam2024"), lambda c, t, a, b: (c, t, b, a)),
    "totals without a code": (("Mã số", "TÀI SẢN", "2024", "2023"), lambda c, t, a, b: ("" if c in ("270", "440") else c, t, a, b)),
    "a row too short comes first": (("Mã số", "TÀI SẢN", "2024", "2023"), lambda c, t, a, b: (c, t, a, b)),
}


@pytest.fixture(scope="module")
def balances(spark):
    docs = []
    for name, (head, place) in LAYOUTS.items():
        rows = [place(c, t, a + MILLIONS, b + MILLIONS) for c, t, a, b in BALANCE]
        if name.startswith("a row too short"):
            rows.insert(0, ("270", "TỔNG"))
        docs.append((name, "BẢNG CÂN ĐỐI KẾ TOÁN\nĐơn vị tính: VND\n" + _table(head, *rows)))
    docs += [("unit far above", "triệu đồng " + "x" * 400 + "\n" + docs[0][1]), ("no table", "Consolidated report"), ("null", None)]
    return spark.createDataFrame(docs, "id string, html string")


def test_every_layout_gives_the_same_balance(balances):
    got = {}
    for r in statements.statement_lines(balances, "id", "html").collect():
        got.setdefault(r["id"], {})[r["code"]] = (r["cur"], r["prev"], r["unit"], r["label"])
    assert set(got) == {*LAYOUTS, "unit far above"}
    for name, lines in got.items():
        assert lines["270"][:3] == (1e9, 8e8, 1.0), name
        assert lines["400"][3].endswith("VỐN CHỦ SỞ HỮU") and len(lines) == 6, name


def test_report_facts(balances):
    got = {r["id"]: r for r in statements.reports(balances, "id", "html").collect()}
    assert len(got) == balances.count()
    for name in LAYOUTS:
        r = got[name]
        assert (r["err_balance"], r["err_assets"], r["err_funding"], r["err_gross"], r["n_BS"], r["label_BS"], r["n_tables"], r["n_coded_tables"]) == (0.0, 0.0, 0.0, None, 6, 1.0, 1, 1), name
        assert not r["consolidated_title"] and not r["english"] and r["error"] is None
    assert got["no table"]["consolidated_title"] and got["no table"]["n_tables"] == 0 and got["null"]["label_IS"] == 0.0


def test_lost_totals_count_as_the_sum_of_their_parts(spark):
    lines = [("a", "BS", c, "", v, v) for c, v in (("100", 60.0), ("200", 40.0), ("300", 70.0), ("400", 30.0))] + [("b", "BS", c, "", v, None) for c, v in (("100", 60.0), ("270", 50.0))] + [("c", "IS", "10", "", 10.0, None), ("c", "IS", "11", "", -4.0, None), ("c", "IS", "20", "", 6.0, None), ("c", "CF", "50", "", 1.0, 0.0), ("c", "CF", "20", "", 2.0, 0.0)]
    got = {r["id"]: r for r in statements.identities(spark.createDataFrame(lines, "id string, statement string, code string, label string, cur double, prev double"), "id").collect()}
    assert (got["a"]["err_balance"], got["a"]["err_assets"]) == (0.0, None)
    assert got["b"]["err_assets"] == pytest.approx(1 / 6) and got["b"]["err_balance"] is None
    assert got["c"]["err_gross"] == 0.0 and got["c"]["err_cash"] == 0.5


def test_unreadable_document_has_an_error(monkeypatch):
    assert statements.tables_in(_table(("a",)))[1] is None

    def fail(_):
        raise ValueError("x" * 500)

    monkeypatch.setattr(statements, "laid_out", fail)
    assert statements.tables_in(_table(("a",))) == ([], ("ValueError: " + "x" * 500)[:200])


def test_grades_scope_and_selection(spark):
    names = [(n,) for n in ("Cong_ty_me_2020", "BCTC-Hop-nhat", "abc.hn.2020", "thanh", "rieng", None)]
    assert [r.s for r in spark.createDataFrame(names, "n string").select(quality.name_scope(F.col("n")).alias("s")).collect()] == ["parent", "consolidated", "consolidated", "unknown", "parent", "unknown"]
    rows = [("A", 2020, "f1", "unknown", True, 0.0, 0.0, 0.5, 1.0, 1.0, 1.0), ("A", 2020, "f2", "unknown", False, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), ("B", 2020, "f3", "unknown", None, None, 0.0, 0.0, 1.0, 0.6, 1.0), ("B", 2020, "f4", "unknown", False, 0.005, 0.006, 0.0, 1.0, 0.6, 0.5), ("C", 2020, "f5", "consolidated", False, 0.0, 0.0, 0.0, 0.7, 1.0, 1.0)]
    x = spark.createDataFrame(rows, "entity string, year int, file string, name_scope string, consolidated_title boolean, err_balance double, err_gross double, err_cash double, label_IS double, label_BS double, label_CF double").withColumn("english", F.lit(False))
    x = quality.graded(x.withColumns({f"n_{k}": F.lit(1) for k in ("BS", "IS", "CF")}))
    assert {r.file: (r.scope, r.quality, r.corporate) for r in x.collect()} == {"f1": ("consolidated", 2, True), "f2": ("parent", 3, True), "f3": ("single", 2, True), "f4": ("single", 1, True), "f5": ("consolidated", 2, False)}
    assert {r.file for r in quality.selected(x).collect()} == {"f1", "f3"}
    (c,) = quality.coverage(x).collect()
    assert (c.reports, c.entities, c.bs_ok) == (5, 3, 0.8)


def test_layout(spark):
    lines = spark.createDataFrame([(1, "b", 10.0, 20.0), (1, "a", 12.0, 10.0), (1, "d", 60.0, 20.2), (1, "c", 60.0, 10.1)], "page int, text string, x double, y double").withColumn("width", F.lit(100.0)).withColumn("height", F.lit(100.0))
    assert layout.reading_order(lines, ["page"]).first()["texts"] == ["a", "b", "c", "d"]
    assert layout.page_rows(lines, ["page"]).first()["texts"] == ["a | c", "b | d"]
    head = spark.sql("SELECT 'Annual report' AS t, 14.0 AS s UNION ALL SELECT 'Annual report.', 14.0 UNION ALL SELECT 'Annual report', 12.0").select(layout.is_heading(F.col("t"), F.col("s"), F.lit(10.0)).alias("h"))
    assert [r.h for r in head.collect()] == [True, False, False]


def test_packed(spark):
    rows = spark.createDataFrame([(["a b", "c d", "e"],), ([],), (["a b c d e f"],)], "r array<string>")
    assert [r.p for r in rows.select(layout.packed(F.col("r"), 3).alias("p")).collect()] == [[0, 1, 1], [], [0]]


def test_each_document_is_read_once(spark):
    docs = spark.createDataFrame([(k, f"Balance sheet\n{_table(('Code', 'Item', '2024', '2023'), *[(c, 'line', '2,000', '1,000') for c in ('100', '200', '270')])}" * 3) for k in range(20)] + [(99, None)], "id long, html string").repartition(3)
    read = spark.sparkContext.accumulator(0)
    p = statements.parsed(docs, "id", "html", read)
    assert read.value == 21
    assert statements.rows_of(p, "id").select("id", "table_no").distinct().count() == 60 and p.where("table_no is null").count() == 21
    lines = statements.lines_of(c := statements.coded_rows(statements.rows_of(p, "id"), "id"), statements.statement_tables(c, "id"), "id")
    assert lines.count() == 60 and read.value == 21  # the written rows are read, not the documents


def test_a_document_of_very_many_tables_streams(spark):
    many = 3 * statements.STEP + 5
    docs = spark.createDataFrame([(1, _table(("a", "b")) * many), (2, "x"), (3, _table(("c",)))], "id long, html string")
    got = statements.rows_of(statements.parsed(docs, "id", "html"), "id")
    assert sorted(r.table_no for r in got.where("id = 1").collect()) == list(range(many)) and got.where("id = 3").count() == 1
