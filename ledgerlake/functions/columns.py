"""Null-safe column helpers: all missing values are NULL, never NaN, and nothing raises under ANSI mode."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b where b > 0, else missing."""
    return F.when(b > 0, a / b)


def growth(now: Column, before: Column) -> Column:
    return safe_div(now, before) - 1


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def holds(x: Column) -> Column:
    """A comparison with a missing value is false."""
    return F.coalesce(x, F.lit(False))


def relative_error(a: Column, b: Column) -> Column:
    scale = F.greatest(F.abs(a), F.abs(b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(scale == 0, 0.0).otherwise(F.abs(a - b) / scale)


def sum_with_head(head: Column, *rest: Column) -> Column:
    """Missing if the head is; other missing parts count as zero."""
    out = head
    for x in rest:
        out = out + F.coalesce(x, F.lit(0.0))
    return out


def _base_letters() -> tuple[str, str]:
    """Letters whose canonical decomposition starts with another letter, and those first letters, from the Unicode data."""
    pairs = []
    for code in range(0xC0, 0x1F00):
        c = chr(code)
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and unicodedata.category(c)[0] == "L" and all(unicodedata.category(x) == "Mn" for x in d[1:]):
            pairs.append((c, d[0]))
    pairs += [("đ", "d"), ("Đ", "D")]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _base_letters()


def fold(x: Column) -> Column:
    """Without accents, lower case, single spaces."""
    plain = F.translate(x, _FROM, _TO)
    spaced = F.regexp_replace(F.regexp_replace(plain, r"\p{Mn}", ""), r"(?U)\s+", " ")
    # most labels are plain by now: one look tells, where two replacements would take most of the time
    return F.trim(F.lower(F.when(plain.rlike(r"[^\x20-\x7e]|  "), spaced).otherwise(plain)))


def parse_amount(cell: Column) -> Column:
    """A printed amount as a number: thousands marks, brackets or a dash for negatives, a lone dash or underscore for zero."""
    s = F.regexp_replace(cell, r"(?U)\s| ", "")
    negative = s.rlike(r"^\(|\)$") | (s.rlike(r"^[-–—]") & (F.length(s) > 1))
    body = F.regexp_replace(s, r"^[(\-–—]+|\)+$", "")
    grouped = F.when(body.rlike(r"^\d{1,3}([.,]\d{3})+$") | body.rlike(r"^\d+$"), F.regexp_replace(body, "[.,]", ""))
    short = F.when(body.rlike(r"^\d+[.,]\d{1,2}$"), F.translate(body, ",", "."))
    value = F.coalesce(grouped, short).try_cast("double")
    return F.when(s == "", F.lit(None).cast("double")).when(s.rlike(r"^[-–—_]$"), 0.0).when(negative, -value).otherwise(value)


#: Wording of a figure by unit and language: before, factor, decimals, after. Fixed values.
UNITS = {
    "vnd": {"en": ("VND ", 1e-9, 0, " bn"), "vi": ("", 1e-9, 0, " tỷ đồng")},
    "pct": {"en": ("", 100, 1, "%"), "vi": ("", 100, 1, "%")},
    "pp": {"en": ("", 100, 1, " pp"), "vi": ("", 100, 1, " điểm %")},
    "x": {"en": ("", 1, 2, "x"), "vi": ("", 1, 2, " lần")},
    "days": {"en": ("", 1, 0, " days"), "vi": ("", 1, 0, " ngày")},
    "pctile": {"en": ("percentile ", 100, 0, ""), "vi": ("phân vị ", 100, 0, "")},
    "score": {"en": ("", 1, 2, ""), "vi": ("", 1, 2, "")},
}


def format_metric(value: Column, unit: Column, lang: str = "en") -> Column:
    """A figure as a reader sees it, by unit: vnd, pct, pp (a difference, with its sign), x, days, pctile, score."""
    out = None
    for name, words in UNITS.items():
        before, factor, places, after = words[lang]
        scaled = value / 1e9 if factor == 1e-9 else value * factor
        number = F.format_number(scaled, places)
        number = number if lang == "en" else F.translate(number, ",.", ".,")
        sign = F.when(value > 0, "+").otherwise("") if name == "pp" else F.lit("")
        text = F.concat(F.lit(before), sign, number, F.lit(after))
        out = F.when(unit == name, text) if out is None else out.when(unit == name, text)
    return out


def digit_share(text: Column) -> Column:
    """Digits among digits and letters."""
    digits = F.length(F.regexp_replace(text, r"[^0-9]", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return digits / F.greatest(digits + letters, F.lit(1))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def chunks(words: Column, most: int = 380, target: int = 300, overlap: int = 50) -> Column:
    """Overlapping runs of words: all of a short text, else equal steps, each run starting `overlap` words early."""
    n = F.size(words)
    step = F.ceil(n / F.ceil(n / target)).cast("int")
    starts = F.when(n <= most, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.when(n <= most, F.greatest(n, F.lit(1))).otherwise(step)))
    width = F.when(n <= most, n).otherwise(step)

    def run(i: Column) -> Column:
        a = F.greatest(i - overlap, F.lit(0))
        return F.slice(words, a + 1, i + width - a)

    return F.transform(starts, run)
