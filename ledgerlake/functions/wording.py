"""Labels of figures in Vietnamese and English, with their units. Fixed values."""

from __future__ import annotations

AMOUNTS = {
    "revenue": ("Doanh thu thuần", "Net revenue"),
    "gross_profit": ("Lợi nhuận gộp", "Gross profit"),
    "op_profit": ("Lợi nhuận thuần từ hoạt động kinh doanh", "Operating profit"),
    "pbt": ("Lợi nhuận trước thuế", "Profit before tax"),
    "net_income": ("Lợi nhuận sau thuế", "Net profit"),
    "total_assets": ("Tổng tài sản", "Total assets"),
    "liabilities": ("Nợ phải trả", "Total liabilities"),
    "equity": ("Vốn chủ sở hữu", "Equity"),
    "cash": ("Tiền và tương đương tiền", "Cash and cash equivalents"),
    "trade_receivables": ("Phải thu khách hàng", "Trade receivables"),
    "inventory": ("Hàng tồn kho", "Inventory"),
    "debt": ("Vay và nợ thuê tài chính", "Borrowings"),
    "cfo": ("Dòng tiền từ hoạt động kinh doanh", "Operating cash flow"),
    "capex": ("Chi mua sắm tài sản cố định", "Capital expenditure"),
    "fcf": ("Dòng tiền tự do", "Free cash flow"),
    "dividends_paid": ("Cổ tức, lợi nhuận đã trả", "Dividends and profits paid"),
}
RATIOS = {
    "rev_g": ("Tăng trưởng doanh thu", "Revenue growth", "pct"),
    "net_income_g": ("Tăng trưởng lợi nhuận sau thuế", "Net profit growth", "pct"),
    "gross_margin": ("Biên lợi nhuận gộp", "Gross margin", "pct"),
    "op_margin": ("Biên lợi nhuận hoạt động", "Operating margin", "pct"),
    "net_margin": ("Biên lợi nhuận ròng", "Net margin", "pct"),
    "roe": ("ROE", "ROE", "pct"),
    "roa": ("ROA", "ROA", "pct"),
    "liab_to_assets": ("Nợ phải trả / tổng tài sản", "Liabilities / total assets", "pct"),
    "debt_to_equity": ("Vay / vốn chủ sở hữu", "Debt / equity", "x"),
    "current_ratio": ("Hệ số thanh toán hiện hành", "Current ratio", "x"),
    "asset_turnover": ("Vòng quay tài sản", "Asset turnover", "x"),
    "dso": ("Số ngày phải thu", "Days sales outstanding", "days"),
    "dio": ("Số ngày tồn kho", "Days inventory outstanding", "days"),
    "cfo_to_net_income": ("Dòng tiền kinh doanh / lợi nhuận sau thuế", "Operating cash flow / net profit", "x"),
    "fcf_margin": ("Dòng tiền tự do / doanh thu", "Free cash flow / revenue", "pct"),
    "accruals": ("Dồn tích / tổng tài sản", "Accruals / total assets", "pct"),
    "m_score": ("Beneish M-Score", "Beneish M-Score", "score"),
}
SIGNALS = {
    "m_score": ("Beneish M-Score", "Beneish M-Score", "score"),
    "m_pct_in_sector": ("Vị trí M-Score trong ngành", "M-Score position in sector", "pctile"),
    "accruals": ("Dồn tích / tổng tài sản", "Accruals / total assets", "pct"),
    "accruals_pct_in_sector": ("Vị trí dồn tích trong ngành", "Accruals position in sector", "pctile"),
    "recv_minus_rev_g": ("Tăng trưởng phải thu trừ tăng trưởng doanh thu", "Receivables growth minus revenue growth", "pp"),
    "dso_chg": ("Thay đổi số ngày phải thu", "Change in days sales outstanding", "days"),
    "debt_g": ("Tăng trưởng vay", "Growth in borrowings", "pct"),
    "debt_to_equity": ("Vay / vốn chủ sở hữu", "Debt / equity", "x"),
}
PEERS = ("rev_g", "gross_margin", "net_margin", "roe", "debt_to_equity", "dso", "accruals", "m_score")
SCOPES = {"consolidated": ("hợp nhất", "consolidated"), "parent": ("công ty mẹ", "parent company"), "single": ("riêng lẻ", "separate")}
SECTIONS = {
    "summary": ("Tóm tắt", "Executive summary"),
    "revenue": ("Doanh thu", "Revenue"),
    "profitability": ("Lợi nhuận", "Profitability"),
    "cash_flow": ("Dòng tiền và cấu trúc vốn", "Cash flow and capital structure"),
    "risk": ("Tín hiệu rủi ro", "Risk signals"),
    "forecast": ("Dự báo", "Forecast"),
}
