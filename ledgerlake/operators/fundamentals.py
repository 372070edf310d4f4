"""From statement lines to one wide row for each report, its ratios, and the panel of entities and years.

A ratio or growth rate is computed inside one report, from its current and prior column. A ratio is a function of the
column it is read from, so its change compares the same expression over both columns. All of a row's figures are one
projection; only lags, the next year and group medians look at other rows.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, fold, growth, holds, safe_div
from . import windows as W
from .statements import LINE_ARRAYS, line_at, place

#: field: (statement, codes that may fill it, best first, pattern of its folded label). Fixed values.
FIELDS = {
    "revenue": ("IS", ("10",), r"doanh thu thuan|net revenue|net sales|net turnover"),
    "cogs": ("IS", ("11",), r"gia von|cost of"),
    "gross_profit": ("IS", ("20",), r"gop|gross"),
    "fin_income": ("IS", ("21",), r"tai chinh|financ"),
    "fin_expense": ("IS", ("22",), r"tai chinh|financ"),
    "interest_expense": ("IS", ("23",), r"lai vay|interest"),
    "selling_exp": ("IS", ("25", "24"), r"ban hang|selling"),
    "admin_exp": ("IS", ("26", "25"), r"quan ly|administrat"),
    "op_profit": ("IS", ("30",), r"hoat dong kinh doanh|operating"),
    "pbt": ("IS", ("50",), r"truoc thue|before tax"),
    "net_income": ("IS", ("60",), r"sau thue|after tax|net profit|profit for the"),
    "current_assets": ("BS", ("100",), r"ngan han|current"),
    "cash": ("BS", ("110",), r"tien|cash"),
    "st_investments": ("BS", ("120",), r"dau tu|investment"),
    "st_receivables": ("BS", ("130",), r"phai thu|receivable"),
    "trade_receivables": ("BS", ("131",), r"phai thu|receivable"),
    "inventory": ("BS", ("140",), r"ton kho|inventor"),
    "noncurrent_assets": ("BS", ("200",), r"dai han|non-?current|long-?term"),
    "fixed_assets": ("BS", ("220",), r"co dinh|fixed assets"),
    "total_assets": ("BS", ("270",), r"tong (cong )?tai san|total assets"),
    "liabilities": ("BS", ("300",), r"no phai tra|liabilities"),
    "current_liabilities": ("BS", ("310",), r"ngan han|current"),
    "st_debt": ("BS", ("320",), r"vay|borrowing|loan"),
    "lt_debt": ("BS", ("338",), r"vay|borrowing|loan"),
    "equity": ("BS", ("400",), r"von chu so huu|equity|nguon von"),
    "funding_total": ("BS", ("440",), r"tong (cong )?nguon von|total"),
    "depreciation": ("CF", ("02",), r"khau hao|depreciation"),
    "cfo": ("CF", ("20",), r"kinh doanh|operating"),
    "capex": ("CF", ("21",), r"mua sam|xay dung|purchase|acquisition|construction"),
    "cfi": ("CF", ("30",), r"dau tu|investing"),
    "cff": ("CF", ("40",), r"tai chinh|financing"),
    "dividends_paid": ("CF", ("36",), r"co tuc|loi nhuan da tra|dividend"),
}
# Printed with either sign; and missing means none. Fixed values.
UNSIGNED = ("cogs", "fin_expense", "interest_expense", "selling_exp", "admin_exp", "capex", "dividends_paid", "depreciation")
ZERO_IF_MISSING = ("st_debt", "lt_debt", "inventory", "trade_receivables", "st_investments", "fixed_assets")
AMOUNTS = tuple(f for f in FIELDS if f != "funding_total")
#: Least revenue of a usable row, and how far a restated base may lie from the reported one (a factor). Fixed values.
LEAST_REVENUE, RESTATED = 1e10, 1.25
UNKNOWN_SECTOR = "Không rõ"

#: Ranges of figures; the first pattern that a name matches holds. Fixed values.
CLIPS = [
    (r"^log_|^m_score$", None),
    (r"^(dso|dio)$", (0, 1500)),
    (r"^(dso|dio)_chg$", (-1500, 1500)),
    (r"_chg$", (-1, 1)),
    (r"margin", (-2, 1)),
    (r"_g($|_)", (-0.95, 5)),
    (r"^(roe|roa|accruals|tata|cff_to_assets)$", (-2, 2)),
    (r"^interest_cover$", (-50, 200)),
    (r".", (0, 50)),
]
#: Weights in the M-Score, on top of -4.84, in the order in which they are added. Fixed values.
M_SCORE = {"dsri": 0.92, "gmi": 0.528, "aqi": 0.404, "sgi": 0.892, "depi": 0.115, "sgai": -0.172, "tata": 4.679, "lvgi": -0.327}


def wide(facts: DataFrame, selected: DataFrame) -> DataFrame:
    """selected(entity, year, file, scope, english, bs_ok, is_ok, cf_ok, unit_BS, unit_IS, unit_CF) with <field> and <field>_prev.

    Of a field's codes the best one whose label fits counts. Amounts are scaled, made unsigned, zero where a blank means
    none, and missing where the statement's identity fails, in this order. Total assets fall back to the funding total,
    then to current and non-current assets.
    """
    x = facts.select("file", "statement", "code", fold(F.col("label")).alias("label"), "cur", "prev")
    fits = [(F.col("statement") == statement) & F.col("code").isin(*codes) & F.col("label").rlike(pattern) for statement, codes, pattern in FIELDS.values()]
    used = x.where(reduce(or_, fits))  # of a code that a report repeats, a line that fits
    found = used.groupBy("file").agg(F.collect_list(F.struct(place(F.col("statement"), F.col("code")).alias("place"), "label", "cur", "prev")).alias("l"))
    arrays = [F.col(f"l.{part}").alias(out) for part, out in zip(("place", "label", "cur", "prev"), LINE_ARRAYS, strict=True)]
    return wide_within(selected.join(found.select("file", *arrays), "file", "left"))  # reports without lines stay


def wide_within(selected: DataFrame) -> DataFrame:
    """wide() of reports that hold their lines as LINE_ARRAYS: nothing is shuffled."""

    def best(statement: str, codes: tuple[str, ...], pattern: str, field: str) -> Column:
        """cur and prev of the first code whose label fits."""
        one = lambda c: F.when(line_at(statement, c, "label").rlike(pattern), F.struct(*[line_at(statement, c, w).alias(w) for w in ("cur", "prev")]))
        return F.coalesce(*map(one, codes)).alias(field)

    kept = ["entity", "year", "file", "scope", "english", "bs_ok", "is_ok", "cf_ok"]
    x = selected.select(*kept, "unit_BS", "unit_IS", "unit_CF", *[best(*rule, f) for f, rule in FIELDS.items()])

    def amount(field: str, side: str) -> Column:
        statement = FIELDS[field][0]
        v = F.col(f"{field}.{side}") * F.coalesce(F.col(f"unit_{statement}"), F.lit(1.0))
        v = F.abs(v) if field in UNSIGNED else v
        v = F.coalesce(v, F.lit(0.0)) if field in ZERO_IF_MISSING else v
        return F.when(holds(F.col(f"{statement.lower()}_ok")), v)

    columns = {f"{f}{end}": amount(f, side) for f in FIELDS for side, end in (("cur", ""), ("prev", "_prev"))}
    for end in ("", "_prev"):
        columns[f"total_assets{end}"] = F.coalesce(columns[f"total_assets{end}"], columns.pop(f"funding_total{end}"), columns[f"current_assets{end}"] + columns[f"noncurrent_assets{end}"])
    return x.select(*kept, *[c.alias(n) for n, c in columns.items()])


def ratios() -> dict[str, Column]:
    """The 49 figures of a wide row by name; nothing is clipped. A ratio needs a positive denominator."""

    def of(side: str) -> dict[str, Column]:
        """What is read from one column of a report."""
        v = lambda f: F.col(f + side)
        sga = F.coalesce(v("selling_exp"), F.lit(0.0)) + F.coalesce(v("admin_exp"), F.lit(0.0))
        return {
            "gross_margin": safe_div(v("gross_profit"), v("revenue")),
            "op_margin": safe_div(v("op_profit"), v("revenue")),
            "net_margin": safe_div(v("net_income"), v("revenue")),
            "dso": 365 * safe_div(v("trade_receivables"), v("revenue")),
            "dio": 365 * safe_div(v("inventory"), v("cogs")),
            "sga_ratio": safe_div(sga, v("revenue")),
            "receivables": safe_div(v("trade_receivables"), v("revenue")),
            "soft": 1 - safe_div(v("current_assets") + v("fixed_assets"), v("total_assets")),
            "wear": safe_div(v("depreciation"), v("depreciation") + v("fixed_assets")),
            "leverage": safe_div(v("lt_debt") + v("current_liabilities"), v("total_assets")),
            "debt": v("st_debt") + v("lt_debt"),
        }

    now, then, c = of(""), of("_prev"), F.col
    mean = lambda f: (c(f) + c(f"{f}_prev")) / 2
    out = {f"{n}_g": growth(c(f), c(f"{f}_prev")) for n, f in (("rev", "revenue"), ("assets", "total_assets"), ("equity", "equity"), ("liab", "liabilities"), ("recv", "trade_receivables"), ("inv", "inventory"), ("fixed", "fixed_assets"))}
    out |= {f"{n}_minus_rev_g": out[f"{n}_g"] - out["rev_g"] for n in ("recv", "inv")}
    out |= {n: now[n] for n in ("gross_margin", "op_margin", "net_margin", "sga_ratio", "dso", "dio")}
    out |= {f"{n}_chg": now[n] - then[n] for n in ("gross_margin", "op_margin", "net_margin", "dso", "dio")}
    out |= {n: safe_div(a, b) for n, a, b in (
        ("roe", c("net_income"), mean("equity")),
        ("roa", c("net_income"), mean("total_assets")),
        ("cfo_margin", c("cfo"), c("revenue")),
        ("accruals", c("net_income") - c("cfo"), mean("total_assets")),
        ("capex_to_rev", c("capex"), c("revenue")),
        ("capex_to_dep", c("capex"), c("depreciation")),
        ("capex_to_fixed", c("capex"), c("fixed_assets_prev")),
        ("fcf_margin", c("cfo") - c("capex"), c("revenue")),
        ("payout", c("dividends_paid"), c("net_income")),
        ("cff_to_assets", c("cff"), mean("total_assets")),
        ("asset_turnover", c("revenue"), mean("total_assets")),
        ("liab_to_assets", c("liabilities"), c("total_assets")),
        ("debt_to_equity", now["debt"], c("equity")),
        ("current_ratio", c("current_assets"), c("current_liabilities")),
        ("cash_to_assets", c("cash") + c("st_investments"), c("total_assets")),
        ("fixed_to_assets", c("fixed_assets"), c("total_assets")),
        ("interest_cover", c("pbt") + F.coalesce(c("interest_expense"), F.lit(0.0)), c("interest_expense")),
    )}
    out |= {"debt_g": growth(now["debt"], then["debt"]), "log_revenue": F.when(c("revenue") > 0, F.ln("revenue")), "log_assets": F.when(c("total_assets") > 0, F.ln("total_assets"))}
    # indices compare this year's ratio with last year's; margins and wear the other way round
    out |= {n: safe_div(now[r], then[r]) for n, r in (("dsri", "receivables"), ("aqi", "soft"), ("sgai", "sga_ratio"), ("lvgi", "leverage"))}
    out |= {n: safe_div(then[r], now[r]) for n, r in (("gmi", "gross_margin"), ("depi", "wear"))}
    out |= {"sgi": safe_div(c("revenue"), c("revenue_prev")), "tata": safe_div(c("net_income") - c("cfo"), c("total_assets"))}
    return out


def with_ratios(rows: DataFrame) -> DataFrame:
    """rows with the figures of ratios() and the M-Score, in which a missing index counts as no change."""
    x = rows.withColumns(ratios())
    index = lambda n: F.coalesce(clip(F.col(n), 0.0, 10.0), F.lit(1.0))
    # added in the order of the definition (tata before leverage): many scores lie in the middle of two printed ones, where the last bit decides
    score = F.lit(-4.84)
    for n, w in M_SCORE.items():
        score = score + w * (clip(F.col(n), -1.0, 1.0) if n == "tata" else index(n))
    return x.withColumn("m_score", F.when(F.col("tata").isNotNull() & F.col("sgi").isNotNull(), score))


def bounds(name: str) -> tuple[float, float] | None:
    return next(b for pattern, b in CLIPS if re.search(pattern, name))



def clipped(x: DataFrame, names: list[str]) -> DataFrame:
    return x.withColumns({n: clip(F.col(n), float(b[0]), float(b[1])) for n in names if (b := bounds(n))})


def names() -> list[str]:
    """All figures of with_ratios."""
    return [*ratios(), "m_score"]


def panel(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """The wide rows as a panel: clipped figures, lags, means, next year's growth, flags, sector and market medians.

    `companies` has entity, sector. The target is the growth that the next year's report states, on its own base; a base
    that lies far from what this report states means that the two don't describe the same accounts.
    """
    meta = ["entity", "year", "revenue", "revenue_prev", "total_assets", "net_income", "cfo", "scope", "is_ok", "bs_ok", "cf_ok"]
    x = clipped(with_ratios(rows), names()).select(*meta, *names())
    after = lambda c: F.max(c).over(W.calendar(1))
    x = x.withColumns({"_next": after("revenue"), "_base": after("revenue_prev"), "_scope": after("scope"), "_ok": after("is_ok")})
    x = x.withColumns({f"{n}_lag{k}": W.lagged(n, -k) for n in ("rev_g", "gross_margin") for k in (1, 2)})
    x = x.withColumns({"rev_g_3y_mean": F.avg("rev_g").over(W.trailing()), "rev_g_3y_std": F.stddev_samp("rev_g").over(W.trailing())})
    gap = F.when((F.col("revenue") > 0) & (F.col("_base") > 0), F.abs(F.ln(F.col("_base") / F.col("revenue"))))
    x = x.withColumn("target", F.when((F.col("_next") > 0) & (F.col("_base") > 0), F.ln(F.col("_next") / F.col("_base")))).withColumn("restated", holds(gap > F.ln(F.lit(RESTATED))))
    x = x.withColumn("usable", holds(F.col("is_ok")) & holds(F.col("revenue") >= LEAST_REVENUE) & holds(F.col("revenue_prev") > 0))
    x = x.withColumn("has_target", F.col("usable") & F.col("target").isNotNull() & ~F.col("restated") & holds(F.col("_ok")) & holds(F.col("_scope") == F.col("scope")))
    x = x.drop("_next", "_base", "_scope", "_ok").join(companies.select("entity", "sector"), "entity", "left").withColumn("sector", F.coalesce("sector", F.lit(UNKNOWN_SECTOR)))
    return with_group_medians(x)


def with_group_medians(x: DataFrame) -> DataFrame:
    """x with sector_rev_g, sector_n and market_rev_g: over usable rows, given to all rows."""
    counts = x.where("usable").groupBy("sector", "year", "rev_g").agg(F.count(F.lit(1)).alias("_n"))
    sizes = counts.groupBy("sector", "year").agg(F.sum("_n").alias("sector_n"))
    sector = sizes.join(W.group_median(counts, "rev_g", ["sector", "year"], "sector_rev_g", "_n"), ["sector", "year"], "left")
    market = W.group_median(counts, "rev_g", ["year"], "market_rev_g", "_n")
    return x.join(sector, ["sector", "year"], "left").join(market, "year", "left")


#: Columns of the panel that no model sees. Fixed values.
NOT_FEATURES = ("entity", "year", "target", "usable", "has_target", "restated", "scope", "is_ok", "bs_ok", "cf_ok", "revenue", "revenue_prev", "total_assets", "net_income", "cfo", "sector", "sector_n", "m_score", "sgi", "tata", "market_rev_g")


def features(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c not in NOT_FEATURES]


def long(rows: DataFrame, fields: list[str]) -> DataFrame:
    """entity, year, field, value, value_prev of wide rows; pairs without either amount go."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.col(f"{f}_prev").alias("value_prev")) for f in fields])
    return rows.select("entity", "year", F.explode(parts).alias("z")).select("entity", "year", "z.*").where("value is not null or value_prev is not null")


def named(rows: DataFrame, columns: list[str]) -> DataFrame:
    """entity, year, name, value of the columns that have one."""
    return rows.unpivot(["entity", "year"], columns, "name", "value").where("value is not null")


def sector_positions(figures: DataFrame, places: int | None = None) -> DataFrame:
    """entity, year, m_pct_in_sector, accruals_pct_in_sector of usable rows(entity, year, sector, usable, m_score, accruals) with a score.

    `places` rounds figures before they are ranked, for those to whom the last bits of a sum are no difference.
    """
    scored = figures.where(holds(F.col("usable")) & F.col("m_score").isNotNull())
    ranked = lambda c: (F.col(c) if places is None else F.round(c, places)).alias(c)
    one = lambda c, out: W.with_ranks(scored.select("entity", "year", "sector", ranked(c)), c, ["sector", "year"]).select("entity", "year", F.col("pct").alias(out))
    return one("m_score", "m_pct_in_sector").join(one("accruals", "accruals_pct_in_sector"), ["entity", "year"], "left")


def printed_lines(selected: DataFrame, facts: DataFrame) -> DataFrame:
    """entity, year, statement, code, label, value, value_prev: the lines of the selected reports in the currency's unit."""
    units = [f"unit_{s}" for s in ("BS", "IS", "CF")]
    # both sides grow with the reports: neither goes through the driver
    x = facts.select("file", "statement", "code", "label", "cur", "prev").join(selected.select("file", "entity", "year", *units).hint("merge"), "file").where(F.col("statement").isin("BS", "IS", "CF"))
    unit = F.coalesce(*[F.when(F.col("statement") == u[-2:], F.col(u)) for u in units], F.lit(1.0))
    return x.select("entity", "year", "statement", "code", "label", (F.col("cur") * unit).alias("value"), (F.col("prev") * unit).alias("value_prev"))


def serving(selected: DataFrame, facts: DataFrame, rows: DataFrame, table: DataFrame, places: int | None = None) -> dict[str, DataFrame]:
    """The tables that are searched: reports, fundamentals, statement_lines, metrics (what models see) and ratios (what readers see)."""
    true = with_ratios(rows)
    positions = sector_positions(true.select("entity", "year", "m_score", "accruals").join(table.select("entity", "year", "usable", "sector"), ["entity", "year"]), places)
    return {
        "reports": selected.select("entity", "year", "file", "scope", "bs_ok", "is_ok", "cf_ok").join(table.select("entity", "year", "usable"), ["entity", "year"], "left"),
        "fundamentals": long(rows, list(AMOUNTS)),
        "statement_lines": printed_lines(selected, facts),
        "metrics": named(table, [*features(table), "m_score", "sgi", "tata", "market_rev_g"]),
        "ratios": named(true, names()).unionByName(named(positions, ["m_pct_in_sector", "accruals_pct_in_sector"])),
    }
