"""Money, dates, fiscal years and small scalar helpers as column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def parse_money(c: Column) -> Column:
    """Text with $ and thousands commas to DECIMAL(15,2); unreadable text is null."""
    return F.regexp_replace(F.trim(c.cast("string")), r"[$,]", "").try_cast("decimal(15,2)")


def parse_date(c: Column, *formats: str, cut: int | None = None) -> Column:
    """The first format that fits wins."""
    text = F.trim(c.cast("string"))
    if cut:
        text = F.left(text, F.lit(cut))
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def first_nonempty(*cols: Column) -> Column:
    """Ordered fallback over columns; a blank value wins and is then trimmed to empty."""
    return F.trim(F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cols]))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def state_fiscal_year(d: Column) -> Column:
    """September to August."""
    return F.year(d) + F.when(F.month(d) >= 9, 1).otherwise(0)


def federal_fiscal_year(d: Column) -> Column:
    """October to September."""
    return F.year(d) + F.when(F.month(d) >= 10, 1).otherwise(0)


def fiscal_years(d: Column) -> Column:
    return F.struct(
        state_fiscal_year(d).alias("state"),
        federal_fiscal_year(d).alias("federal"),
        F.year(d).alias("calendar"),
    )


def state_fy_start(fy: Column) -> Column:
    return F.make_date(fy - 1, F.lit(9), F.lit(1))


def state_fy_end(fy: Column) -> Column:
    return F.make_date(fy, F.lit(8), F.lit(31))


def federal_fy_start(fy: Column) -> Column:
    return F.make_date(fy - 1, F.lit(10), F.lit(1))


def federal_fy_end(fy: Column) -> Column:
    return F.make_date(fy, F.lit(9), F.lit(30))


def fiscal_year_of(day: dt.date, first_month: int = 9) -> int:
    return day.year + (day.month >= first_month)


def add_business_days(d: Column, n: int) -> Column:
    """n working days after d. A weekend start counts from the Friday before."""
    wd = F.weekday(d)
    back = F.greatest(wd - 4, F.lit(0))
    base_wd = F.least(wd, F.lit(4))
    return F.date_add(d, n - back + 2 * F.floor((base_wd + n) / 5).cast("int"))


def initials_code(name: Column, words: int = 4) -> Column:
    """First letters of the first words, upper case."""
    parts = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(F.slice(parts, 1, words), lambda w: F.upper(F.left(w, F.lit(1)))), "")


def clip(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def json_text(c: Column, key: str) -> Column:
    return F.get_json_object(c, f"$['{key}']")


def share(part: Column, whole: Column) -> Column:
    """part / whole in double, null where whole is zero."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))


SEVERITIES = ("low", "medium", "high")  # rising order


def severity_rank(c: Column) -> Column:
    """low < medium < high; text order would be wrong."""
    return F.coalesce(*[F.when(c == s, F.lit(i)) for i, s in enumerate(SEVERITIES)])


def severity(default: str, *cases: tuple[str, Column]) -> Column:
    """Later cases override earlier ones."""
    expr = None
    for name, cond in reversed(cases):
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return F.lit(default) if expr is None else expr.otherwise(default)


def first_places(ranked, k: int | None):
    """The rows of a ranked table with place up to k; all of them where k is None."""
    return ranked if k is None else ranked.where(F.col("place") <= k)
