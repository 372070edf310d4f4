"""Answers of the tools on small serving tables."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions.columns import fold
from ledgerlake.operators import fundamentals as O
from ledgerlake.operators import tools as T


@pytest.fixture(scope="module")
def store(spark):
    amounts = {("A", 2021): {"revenue": 100.0, "net_income": 10.0, "cfo": 4.0, "capex": 1.0, "st_debt": 3.0, "lt_debt": 2.0}, ("A", 2022): {"revenue": None, "net_income": 1.0}, ("A", 2024): {"revenue": 172.8, "net_income": -5.0, "cfo": 3.0}, ("B", 2024): {"revenue": 20.0, "net_income": 2.0}}
    f = [(e, y, n, v, 5.0 if n == "net_income" else None) for (e, y), a in amounts.items() for n, v in a.items()]
    reports = [(e, y, "consolidated", True) for e, y in amounts] + [(f"P{k}", 2024, "single", k != 5) for k in range(7)]
    ratios = [("A", 2024, "roe", 0.3), ("A", 2024, "debt_g", 9.98), ("A", 2024, "m_pct_in_sector", 0.8), ("A", 2024, "m_score", -1.0), ("A", 2024, "debt_to_equity", 0.5), ("A", 2024, "accruals_pct_in_sector", 0.9), ("A", 2024, "accruals", -0.1)] + [(f"P{k}", 2024, "roe", round(0.1 * k, 1)) for k in range(7)]
    return {
        "fundamentals": spark.createDataFrame(f, "entity string, year int, field string, value double, value_prev double"),
        "reports": spark.createDataFrame(reports, "entity string, year int, scope string, usable boolean"),
        "ratios": spark.createDataFrame(ratios, "entity string, year int, name string, value double"),
        "companies": spark.createDataFrame([("A", "tech"), ("B", None)] + [(f"P{k}", "tech") for k in range(7)], "entity string, sector string"),
    }


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "entity string, start_year int, end_year int")


def values(metrics):
    rows = metrics.collect()
    assert len({r.id for r in rows}) == len(rows)
    return {r.id: r.value for r in rows}


def test_amounts_and_missing_years(spark, store):
    q = asked(spark, ("A", 2020, 2024))
    x = T.financials(q, store["reports"], store["fundamentals"])
    got = values(x)
    assert got["A.revenue.2021"] == 100 and got["A.debt.2021"] == 5 and got["A.fcf.2021"] == 3 and "A.revenue.2022" not in got and "A.debt.2024" not in got
    assert x.where("id = 'A.revenue.2021'").first().source == "BCTC kiểm toán 2021 (hợp nhất)"
    assert [r.note for r in T.missing_years(q, store["reports"], "en").collect()] == ["No audited statements for A in: 2020, 2023"]
    shown = {r.label: r.cells for r in T.table_of(x, "en", "entity").collect()}
    assert shown["Doanh thu thuần"] == {"2021": "VND 0 bn", "2024": "VND 0 bn"}


def test_unknown_entity(spark, store):
    with pytest.raises(T.UnknownEntity, match="ZZZ"):
        T.known(asked(spark, ("A", 2020, 2021), ("ZZZ", 2020, 2021)), store["reports"])
    assert T.known(asked(spark, ("A", 1900, 1901)), store["reports"]).count() == 1


def test_ratios_and_compound_growth(spark, store):
    got = values(T.ratios(asked(spark, ("A", 2021, 2024)), store["reports"], store["fundamentals"], store["ratios"], "en"))
    assert got["A.revenue_cagr.2021_2024"] == pytest.approx(0.2) and "A.net_income_cagr.2021_2024" not in got
    assert got["A.net_income_g.2021"] == 1.0 and got["A.cfo_to_net_income.2021"] == 0.4 and "A.cfo_to_net_income.2024" not in got and got["A.roe.2024"] == 0.3
    assert "A.revenue_cagr.2021_2021" not in values(T.ratios(asked(spark, ("A", 2021, 2022)), store["reports"], store["fundamentals"], store["ratios"], "en"))


def test_peers(spark, store):
    q = asked(spark, ("A", 2024, 2024), ("B", 2024, 2024), ("P5", 2024, 2024))
    got = values(T.peers(q, store["companies"], store["reports"], store["ratios"], lang="en"))
    # P5 isn't usable: it is no peer and has no place
    assert got == {"A.roe_sector_median.2024": pytest.approx(0.3), "A.roe_sector_pct.2024": pytest.approx(5 / 7)}
    notes = {r.entity: r.note for r in T.peer_notes(q, store["companies"], store["reports"], store["ratios"], lang="en").collect()}
    assert notes["A"] == "Compared with the sector tech (7 companies, 2024)" and notes["B"] == "The sector is unknown of B"


def test_risk_flags(spark, store):
    figures, flags, notes = T.risk(asked(spark, ("A", 2021, 2024), ("B", 2024, 2024), ("A", 2021, 2021)), store["ratios"], store["fundamentals"], "en")
    assert {(r.entity, r.year, r.rule) for r in flags.collect()} == {("A", 2024, "m_score"), ("A", 2024, "debt"), ("A", 2021, "cash")}
    assert "{{A.debt_g.2024}}" in flags.where("rule = 'debt'").first().text and values(figures)["A.debt_g.2024"] == 9.98
    assert [r.note for r in notes.collect()] == ["Not enough data to compute risk signals of 2024"]


def test_forecast_takes_off_what_leaves(spark, store):
    f = spark.createDataFrame([("A", 2024, "old", -1.0, -1.0, -1.0), ("A", 2025, "g", -0.1, 0.1, 0.3), ("B", 2025, "g", 0.0, 0.1, 0.2)], "entity string, target_year int, vol_group string, growth_lo double, growth_mid double, growth_hi double")
    c = spark.createDataFrame([("A", 2025, "deconsolidation", "B", "ghi", "B Telecom leaves", "s"), ("A", 2025, "deconsolidation", "C", "ghi", "C leaves", "s"), ("B", 2024, "deconsolidation", "A", "ghi", "past", "s")], "entity string, effective_year int, kind string, counterpart string, note string, note_en string, source string")
    m, notes = T.forecast(asked(spark, ("A", 2021, 2024), ("B", 2024, 2024), ("P1", 2024, 2024)), f, store["reports"], store["fundamentals"], c, lang="en")
    got = values(m)
    assert got["A.forecast_base_reported.2024"] == 172.8 and got["A.forecast_base_removed.2024"] == 20 and got["A.forecast_base.2024"] == pytest.approx(152.8)
    assert got["A.forecast_revenue_mid.2025"] == pytest.approx(152.8 * 1.1) and got["A.forecast_revenue_lo.2025"] < got["A.forecast_revenue_mid.2025"] < got["A.forecast_revenue_hi.2025"]
    assert got["B.forecast_base.2024"] == 20 and "B.forecast_base_reported.2024" not in got and got["B.forecast_interval_coverage.2025"] == 0.8
    said = {(r.entity, r.note) for r in notes.collect()}
    assert {("A", "B Telecom leaves (source: s)"), ("A", "No revenue to take off is known of C"), ("P1", "No forecast for P1")} <= said and not any("past" in n for _, n in said)


def test_drivers(spark):
    f = spark.createDataFrame([("A", 2025, 0.3), ("B", 2025, 0.3)], "entity string, target_year int, pred_rel double")
    c = spark.createDataFrame([("A", 2025, "x", -0.4), ("A", 2025, "y", 0.2), ("A", 2025, "bias", 0.5), ("B", 2025, "x", 0.1)], "entity string, target_year int, feature string, contribution double")
    m, notes = T.drivers(c, f, {"x": ("iks", "ex")}, top=1, lang="en")
    assert values(m) == {"A.forecast_rel.2025": 0.3, "A.driver_x.2025": -0.4} and [r.entity for r in notes.collect()] == ["B"]
    assert m.where("name = 'driver_x'").first().label == "Contribution to the forecast: ex"


def test_wide_row(spark):
    lines = [("f", "IS", "24", "Chi phí bán hàng", 3.0, None), ("f", "IS", "25", "Selling expenses", -4.0, 1.0), ("f", "IS", "26", "Chi phí bán hàng", 9.0, 9.0), ("f", "BS", "440", "Tổng nguồn vốn", 7.0, None), ("f", "BS", "100", "Tài sản ngắn hạn", 1.0, 2.0), ("f", "BS", "200", "Tài sản dài hạn", 1.0, 3.0), ("f", "CF", "20", "operating", 5.0, 5.0), ("g", "BS", "100", "Tài sản ngắn hạn", 1.0, 1.0)]
    facts = spark.createDataFrame(lines, "file string, statement string, code string, label string, cur double, prev double")
    chosen = spark.createDataFrame([("A", 2020, "f", "single", False, True, True, False, 1e6, None, 1.0), ("B", 2020, "none", "single", False, True, True, True, None, None, None)], "entity string, year int, file string, scope string, english boolean, bs_ok boolean, is_ok boolean, cf_ok boolean, unit_BS double, unit_IS double, unit_CF double")
    got = {r.entity: r for r in O.wide(facts, chosen).collect()}
    a = got["A"]
    assert (a.selling_exp, a.selling_exp_prev, a.admin_exp) == (4.0, 1.0, None) and (a.total_assets, a.total_assets_prev) == (7e6, 5e6) and a.inventory == 0 and a.cfo is None
    assert got["B"].inventory == 0 and got["B"].revenue is None and set(got) == {"A", "B"}


def test_figures(spark):
    assert len(O.names()) == 49
    fields = [f + s for f in O.AMOUNTS for s in ("", "_prev")]
    base = {f: 100.0 for f in fields} | {"revenue": 400.0, "revenue_prev": 320.0, "cogs": 300.0, "net_income": 40.0, "cfo": 10.0, "total_assets": 1000.0, "total_assets_prev": 600.0, "trade_receivables": 100.0, "trade_receivables_prev": 80.0, "selling_exp": None}
    df = spark.createDataFrame([("A", 2020, *base.values()), ("B", 2020, *[None if f == "trade_receivables_prev" else v for f, v in base.items()])], "entity string, year int, " + ", ".join(f"{f} double" for f in base))
    a, b = O.with_ratios(df).orderBy("entity").collect()
    assert (a.rev_g, a.recv_minus_rev_g, a.roa, a.dso, a.dsri) == (0.25, 0.0, 0.05, 91.25, 1.0) and a.accruals == 30 / 800 and a.sga_ratio == 0.25 and a.log_revenue == math.log(400)
    assert b.dsri is None and b.recv_g is None and a.m_score == pytest.approx(b.m_score)  # a missing index counts as no change
    assert O.bounds("recv_minus_rev_g") == (-0.95, 5) and O.bounds("gross_margin_chg") == (-1, 1) and O.bounds("m_score") is None and O.bounds("payout") == (0, 50)
    high = df.withColumn("st_debt_prev", F.lit(0.1)).withColumn("lt_debt_prev", F.lit(0.0))
    assert O.with_ratios(high).first().debt_g > 1000 and O.clipped(O.with_ratios(high), O.names()).first().debt_g == 5.0


def test_m_score_adds_in_the_order_of_its_definition(spark):
    fields = [f + s for f in O.AMOUNTS for s in ("", "_prev")]
    made = [(f"E{i}", 2020, *[float(100 + (i * 37 + k * 61) % 211) for k in range(len(fields))]) for i in range(200)]
    df = O.with_ratios(spark.createDataFrame(made, "entity string, year int, " + ", ".join(f"{f} double" for f in fields)))
    index = lambda v: 1.0 if v is None else max(0.0, min(10.0, v))
    rows = df.where("m_score is not null").collect()
    want = [-4.84 + 0.92 * index(r.dsri) + 0.528 * index(r.gmi) + 0.404 * index(r.aqi) + 0.892 * index(r.sgi) + 0.115 * index(r.depi) - 0.172 * index(r.sgai) + 4.679 * max(-1.0, min(1.0, r.tata)) - 0.327 * index(r.lvgi) for r in rows]
    assert len(rows) > 100 and [r.m_score for r in rows] == want  # to the last bit, so equal scores tie as they do in SQL


def test_printed_lines_need_no_panel(spark, monkeypatch):
    from ledgerlake.plans import company

    def unused(*_):
        raise AssertionError("wide rows and the panel aren't needed")

    monkeypatch.setattr(company, "rows", unused)
    monkeypatch.setattr(company, "table", unused)
    assert company.statement_amounts(spark, "/root/testdata/sf0.001").count() == 30


def _side_by_side(spark):
    """Lines of three reports, one by one and as arrays: a whole one, one with gaps and a null label, one without lines."""
    from ledgerlake.operators import statements as T

    lines = [("a", "BS", "100", "Tài sản ngắn hạn", 7.0, 6.0), ("a", "BS", "200", "Tài sản  dài hạn", 5.0, None), ("a", "BS", "270", "TỔNG CỘNG TÀI SẢN", 12.0, 11.0), ("a", "BS", "440", "Tổng nguồn vốn", 13.0, 11.0), ("a", "IS", "10", "Doanh thu thuần", 9.0, 8.0), ("a", "IS", "25", "Chi phí quản lý", 1.0, 2.0), ("a", "IS", "24", "Chi phí bán hàng", 3.0, 4.0), ("b", "IS", "10", None, 5.0, 5.0), ("b", "IS", "25", "Chi phí bán hàng", None, 6.0), ("b", "IS", "26", "Chi phí quản lý", -7.0, 7.0), ("b", "CF", "20", "Lưu chuyển tiền từ hoạt động kinh doanh", 2.0, 2.0)]
    facts = spark.createDataFrame(lines, "file string, statement string, code string, label string, cur double, prev double")
    parts = facts.groupBy("file").agg(F.collect_list(F.struct(T.place(F.col("statement"), F.col("code")).alias("p"), fold(F.col("label")).alias("l"), "cur", "prev")).alias("x"))
    arrays = parts.select("file", *[F.col(f"x.{c}").alias(n) for c, n in zip(("p", "l", "cur", "prev"), T.LINE_ARRAYS, strict=True)])
    return T, facts, arrays


def test_lines_as_arrays_are_checked_as_lines_without_a_shuffle(spark):
    T, facts, arrays = _side_by_side(spark)
    got = T.checks_within(arrays)
    assert got.columns == T.checks(facts, "file").columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, T.checks(facts, "file").collect()), key=str)
    one = spark.range(1).select(F.lit("a").alias("file"), F.array(F.lit("IS 10")).alias("places"), F.array(F.lit("doanh thu thuan")).alias("labels"), F.array(F.col("id").cast("double")).alias("currents"), F.array(F.lit(1.0)).alias("priors"))
    assert "Exchange" not in T.checks_within(one)._jdf.queryExecution().executedPlan().toString()


def test_wide_rows_of_arrays_are_those_of_lines(spark):
    T, facts, arrays = _side_by_side(spark)
    chosen = spark.createDataFrame([(1, 2020, "a"), (1, 2021, "b"), (2, 2020, "c")], "entity long, year int, file string").select("*", F.lit("single").alias("scope"), F.lit(False).alias("english"), *[F.lit(True).alias(c) for c in ("bs_ok", "is_ok", "cf_ok")], *[F.lit(2.0).alias(f"unit_{k}") for k in ("BS", "IS", "CF")])
    got = {r.file: r for r in O.wide_within(chosen.join(arrays, "file", "left")).collect()}
    assert got == {r.file: r for r in O.wide(facts, chosen).collect()}
    a, b, c = (got[k] for k in "abc")
    assert (a.selling_exp, a.admin_exp, a.total_assets, a.total_assets_prev) == (6.0, 2.0, 24.0, 22.0)  # 24 sells where 25 administers
    assert (b.selling_exp, b.selling_exp_prev, b.admin_exp, b.revenue) == (None, 12.0, 14.0, None)  # the first code that fits counts, even where its amount is missing
    assert c.revenue is None and c.inventory == 0.0


def test_sets_of_figures_that_share_no_id_are_gathered_without_comparing(spark):
    from ledgerlake.operators import tools as Q

    row = lambda e, n, v: (e, f"{e}.{n}.2020", n, "2020", v, "x", n, "s")
    of = lambda rows: spark.createDataFrame(rows, "entity long, id string, name string, period string, value double, unit string, label string, source string")
    ratios, risk = of([row(1, "m_score", 1.0), row(1, "roe", 2.0)]), of([row(1, "m_score", 1.0), row(1, "debt_g", 3.0)])
    apart = Q.gathered(ratios, Q.own_signals(risk), apart=True)
    assert sorted(r.id for r in apart.collect()) == sorted(r.id for r in Q.gathered(ratios, risk).collect()) == ["1.debt_g.2020", "1.m_score.2020", "1.roe.2020"]
    assert "Exchange" not in apart._jdf.queryExecution().executedPlan().toString()
