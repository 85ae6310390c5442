"""Lookup and report queries over the audit tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import lookup, normalize_vendor_name
from ..functions.scalars import json_text, severity_rank, share, state_fiscal_year

# Codes and spellings of vendor categories.
HUB_CATEGORIES = {
    "X": "Multiple Certs", "N": "Non-HUB", "I": "American Indian", "A": "Asian Pacific", "R": "Black American",
    "D": "Disabled Vet", "M": "Hispanic", "V": "Veteran", "G": "Service Disabled Vet", "Non HUB": "Non-HUB", "N/A": "Non-HUB",
    "Woman Owned": "Woman Owned", "Disabled Veteran": "Disabled Vet", "Asian/Male": "Asian Pacific",
    "Asian/Female": "Asian Pacific - Woman", "Hispanic/Male": "Hispanic", "Hispanic/Female": "Hispanic - Woman",
    "Black/Male": "Black American", "Black/Female": "Black American - Woman", "Native American/Male": "American Indian",
    "Native American/Female": "American Indian - Woman",
}
# Eligibility codes kept in the source record.
ELIGIBILITY = {"HI": "Hispanic", "BL": "Black American", "WO": "Woman Owned", "AS": "Asian Pacific", "AI": "American Indian", "DV": "Disabled Veteran"}



def hub_category(status: Column) -> Column:
    """Category of a code: known codes first, then words in the text."""
    s = F.trim(status)
    low = F.lower(s)
    has = lambda word: F.contains(low, F.lit(word))
    woman = has("woman") | has("female")
    return (
        F.when(F.coalesce(status, F.lit("")) == "", "Unknown")
        .when(F.try_element_at(lookup(HUB_CATEGORIES), s).isNotNull(), F.try_element_at(lookup(HUB_CATEGORIES), s))
        .when(woman & has("asian"), "Asian Pacific - Woman").when(woman & has("hispanic"), "Hispanic - Woman")
        .when(woman & has("black"), "Black American - Woman").when(woman, "Woman Owned")
        .when(has("asian"), "Asian Pacific").when(has("hispanic"), "Hispanic").when(has("black"), "Black American")
        .when(has("veteran"), "Disabled Vet").when(has("non"), "Non-HUB").otherwise(s)
    )


def _count(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count("*").cast("double").alias("value")).select(F.lit(label).alias("item"), "value")


def _rows(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _paid(t: dict) -> DataFrame:
    return t["payment"].where(F.col("vendor_id").isNotNull()).groupBy("vendor_id").agg(F.sum("amount").alias("total"), F.count("*").alias("payments"))


def _spend(t: dict) -> DataFrame:
    return t["payment"].agg(F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("value")).select(F.lit("total_spend").alias("item"), "value")


def page(df: DataFrame, number: int, size: int = 50) -> DataFrame:
    """One page of an ordered table; pages count from 0."""
    return df.offset(number * size).limit(size)


def overview(t: dict) -> DataFrame:
    """Rows (item, value): sizes of the main tables and total spend."""
    return _rows(*[_count(t[n], n) for n in ("vendor", "payment", "contract", "alert")], _spend(t))


def latest_syncs(t: dict, sources: DataFrame) -> DataFrame:
    """The latest run of every listed source, also of those never run."""
    last = t["sync_status"].groupBy("source_name").agg(
        F.max_by(F.struct("status", "records_synced", "started_at"), F.struct("started_at", "run_id")).alias("s")).select("source_name", "s.*")
    return sources.join(last, "source_name", "left").withColumn("status", F.coalesce("status", F.lit("never")))


def alert_counts(t: dict, by: str) -> DataFrame:
    return t["alert"].groupBy(by).agg(F.count("*").alias("n"))


def _worst_first(df: DataFrame) -> DataFrame:
    return df.orderBy(severity_rank(F.col("severity")).desc(), F.desc("created_at"), F.desc("id"))


def top_alerts(t: dict, k: int = 8) -> DataFrame:
    """Most severe first, then newest; severity ranks low < medium < high."""
    return _worst_first(t["alert"]).limit(k).select("id", "alert_type", "severity", "title", "created_at")


def alerts_page(t: dict, severity: str | None = None, number: int = 0, size: int = 50) -> DataFrame:
    df = t["alert"] if severity is None else t["alert"].where(F.col("severity") == severity)
    return page(_worst_first(df), number, size).select("id", "alert_type", "severity", "title", "status", "created_at")


def alerts_list(t: dict, severity: str | None = None, status: str | None = None, k: int = 20) -> DataFrame:
    df = t["alert"]
    df = df if severity is None else df.where(F.col("severity") == severity)
    df = df if status is None else df.where(F.col("status") == status)
    return df.orderBy(F.desc("created_at"), F.desc("id")).limit(k).select("id", "alert_type", "severity", "status", "title", "created_at")


def alert_detail(t: dict, alert_id: int) -> DataFrame:
    return t["alert"].where(F.col("id") == alert_id)


def top_vendors(t: dict, k: int = 8) -> DataFrame:
    v = t["vendor"].select(F.col("id").alias("vendor_id"), "name")
    return _paid(t).join(v, "vendor_id").orderBy(F.desc("total"), "vendor_id").limit(k)


def vendors_page(t: dict, search: str | None = None, high_risk: bool = False, number: int = 0, size: int = 50) -> DataFrame:
    """Vendors by spend; unpaid vendors sort first, as in descending order of the source system."""
    v = t["vendor"]
    v = v if search is None else v.where(F.ilike("name", F.lit(f"%{search}%")))
    v = v.where(F.col("risk_score") >= 50) if high_risk else v
    rows = v.select("id", "name", "hub_status", "in_cmbl", "risk_score").join(
        _paid(t).select(F.col("vendor_id").alias("id"), "total"), "id", "left")
    return page(rows.orderBy(F.col("total").desc_nulls_first(), "id"), number, size)


def payments_page(t: dict, low: float | None = None, high: float | None = None, number: int = 0, size: int = 50) -> DataFrame:
    df = t["payment"]
    df = df if not low else df.where(F.col("amount") >= low)
    df = df if not high else df.where(F.col("amount") <= high)
    return page(df.orderBy(F.desc("amount"), "id"), number, size).select("id", "vendor_id", "agency_id", "amount", "payment_date")


def contracts_page(t: dict, as_of: dt.date, search: str | None = None, expiring: bool = False, number: int = 0, size: int = 50) -> DataFrame:
    df = t["contract"]
    if search is not None:
        df = df.where(F.ilike("contract_number", F.lit(f"%{search}%")) | F.ilike("description", F.lit(f"%{search}%")))
    if expiring:
        df = df.where(F.col("end_date").between(F.lit(as_of), F.lit(as_of + dt.timedelta(days=90))))
    return page(df.orderBy(F.col("current_value").desc_nulls_last(), "id"), number, size).select(
        "id", "contract_number", "vendor_id", "current_value", "end_date")


def vendor_detail(t: dict, vendor_id: int) -> DataFrame:
    """One vendor with contract and payment totals."""
    pay = t["payment"].where(F.col("vendor_id") == vendor_id).agg(F.count("*").alias("payment_count"), F.coalesce(F.sum("amount"), F.lit(0)).alias("payment_total"))
    con = t["contract"].where(F.col("vendor_id") == vendor_id).agg(F.count("*").alias("contract_count"), F.coalesce(F.sum("current_value"), F.lit(0)).alias("contract_total"))
    v = t["vendor"].where(F.col("id") == vendor_id)
    return v.select(
        "id", "vendor_id", "name", "address", "city", "state", "hub_status", "in_cmbl", "risk_score",
        *[pay.select(c).scalar().alias(c) for c in pay.columns], *[con.select(c).scalar().alias(c) for c in con.columns])


def payment_detail(t: dict, payment_id: int) -> DataFrame:
    v = t["vendor"].select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor_name"))
    a = t["agency"].select(F.col("id").alias("agency_id"), F.col("name").alias("agency_name"))
    return t["payment"].where(F.col("id") == payment_id).join(v, "vendor_id", "left").join(a, "agency_id", "left").select(
        "id", "amount", "payment_date", "vendor_id", "vendor_name", "agency_id", "agency_name", "is_confidential")


def contract_detail(t: dict, contract_id: int, as_of: dt.date) -> DataFrame:
    """One contract with payments of its vendor and agency and the days left."""
    v = t["vendor"].select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor_name"))
    c = t["contract"].where(F.col("id") == contract_id)
    pay = t["payment"].select(F.col("vendor_id").alias("pv"), F.col("agency_id").alias("pa"), "amount")
    sums = c.join(pay, (F.col("pv") == F.col("vendor_id")) & F.col("pa").eqNullSafe(F.col("agency_id"))).groupBy("id").agg(
        F.count("*").alias("payment_count"), F.sum("amount").alias("payment_total"))
    return c.join(v, "vendor_id", "left").join(sums, "id", "left").select(
        "id", "contract_number", "vendor_name", "current_value", "max_value", "start_date", "end_date",
        F.coalesce("payment_count", F.lit(0)).alias("payment_count"), F.coalesce("payment_total", F.lit(0)).alias("payment_total"),
        F.datediff("end_date", F.lit(as_of)).alias("days_remaining"))


def summary(t: dict) -> DataFrame:
    """Rows (item, value) of the statistics page."""
    hub = F.col("hub_status")
    return _rows(
        _count(t["vendor"], "vendors"), _count(t["payment"], "payments"), _count(t["contract"], "contracts"), _count(t["alert"], "alerts"), _spend(t),
        _count(t["vendor"].where((F.coalesce(hub, F.lit("")) != "") & ~hub.isin("N", "Non HUB")), "hub_vendors"),
        _count(t["debarred"].where("is_active"), "active_exclusions"))


def hub_distribution(t: dict, k: int = 10) -> DataFrame:
    hub = F.col("hub_status")
    v = t["vendor"].where(hub.isNotNull() & ~hub.isin("", "Non HUB", "N"))
    code = json_text(F.col("raw_data"), "ELIGIBILITY CODE")
    cat = F.when((hub == "X") & code.isNotNull(), F.coalesce(F.try_element_at(lookup(ELIGIBILITY), code), F.lit("Other"))).otherwise(hub_category(hub))
    looked_up = (hub == "X") & code.isNotNull()
    kept = v.select(cat.alias("category"), looked_up.alias("known")).where(F.col("known") | ~F.col("category").isin("Non-HUB", "Unknown", "Multiple Certs"))
    return kept.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(k)


def top_agencies(t: dict, k: int = 10) -> DataFrame:
    per = t["payment"].where(F.col("agency_id").isNotNull()).groupBy("agency_id").agg(F.sum("amount").alias("total"))
    a = t["agency"].select(F.col("id").alias("agency_id"), "name")
    return per.join(a, "agency_id").orderBy(F.desc("total"), "agency_id").limit(k)


def spend_by_year(t: dict, years: int = 8) -> DataFrame:
    """The last fiscal years, oldest first."""
    fy = F.col("fiscal_year_state") if "fiscal_year_state" in t["payment"].columns else state_fiscal_year(F.col("payment_date"))
    per = t["payment"].select(fy.alias("fiscal_year"), "amount").where("fiscal_year is not null").groupBy("fiscal_year").agg(F.sum("amount").alias("total"))
    return per.orderBy(F.desc("fiscal_year")).limit(years).orderBy("fiscal_year")


def _buckets(df: DataFrame, value: Column, edges: list[tuple[str, float | None, float | None]]) -> DataFrame:
    """Counts per half-open range in one pass; empty ranges stay."""
    aggs = []
    for i, (_, low, high) in enumerate(edges):
        cond = F.lit(True)
        cond = cond if low is None else cond & (value >= low)
        cond = cond if high is None else cond & (value < high)
        aggs.append(F.count_if(cond).alias(f"b{i}"))
    entries = [F.struct(F.lit(i).alias("place"), F.lit(label).alias("bucket"), F.col(f"b{i}").alias("n")) for i, (label, _, _) in enumerate(edges)]
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def payment_sizes(t: dict) -> DataFrame:
    return _buckets(t["payment"], F.col("amount"), [("$0-1K", 0, 1e3), ("$1K-10K", 1e3, 1e4), ("$10K-100K", 1e4, 1e5), ("$100K-1M", 1e5, 1e6), ("$1M+", 1e6, None)])


def contract_durations(t: dict) -> DataFrame:
    years = F.datediff("end_date", "start_date") / 365.25
    dated = t["contract"].where(F.col("start_date").isNotNull() & F.col("end_date").isNotNull())
    return _buckets(dated, years, [("< 1 year", None, 1), ("1-2 years", 1, 2), ("2-5 years", 2, 5), ("5+ years", 5, None)])


def vendor_states(t: dict, k: int = 10) -> DataFrame:
    return t["vendor"].where(F.length("state") > 0).groupBy("state").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "state").limit(k)


def hub_split(t: dict) -> DataFrame:
    is_hub = (F.coalesce("hub_status", F.lit("")) != "") & ~F.col("hub_status").isin("N", "N/A", "Non HUB", "X")
    is_hub = F.coalesce(is_hub, F.lit(False))
    return t["vendor"].agg(F.count_if(is_hub).alias("hub"), F.count_if(~is_hub).alias("non_hub")).withColumn(
        "hub_share", F.round(share(F.col("hub"), F.col("hub") + F.col("non_hub")) * 100, 1))


def employee_match_counts(matches: DataFrame) -> DataFrame:
    ev = (F.col("entity_type_1") == "employee") & (F.col("entity_type_2") == "vendor")
    return matches.agg(F.count_if(ev).alias("matches"), F.count_if(ev & (F.col("confidence_score") >= 0.9)).alias("high_confidence"))


def contributing_vendors(t: dict, k: int = 10) -> DataFrame:
    """Vendors under a contributor's exact name, paid over 10,000; each side is summed before the join."""
    gifts = t["contribution"].groupBy(F.col("contributor_normalized").alias("name_normalized")).agg(F.sum("contribution_amount").alias("contributed"))
    v = t["vendor"].select(F.col("id").alias("vendor_id"), "name", "name_normalized")
    return v.join(gifts, "name_normalized").join(_paid(t).where("total > 10000"), "vendor_id").orderBy(F.desc("total"), "vendor_id").limit(k).select(
        "vendor_id", "name", "contributed", "total")


def ghost_indicators(t: dict) -> DataFrame:
    listed = F.col("in_cmbl")
    v = t["vendor"].agg(F.count_if(listed).alias("in_cmbl"), F.count_if(~listed).alias("not_in_cmbl"), F.count_if(F.coalesce("address", F.lit("")) == "").alias("no_address"))
    paid = t["vendor"].where(~listed).join(t["payment"].select(F.col("vendor_id").alias("id")), "id", "left_semi").agg(F.count("*"))
    return v.withColumn("paid_not_in_cmbl", paid.scalar())


def year_end_months(t: dict) -> DataFrame:
    m, a = F.month("payment_date"), F.col("amount")
    s = t["payment"].agg(F.sum(F.when(m == 8, a)).alias("august"), F.sum(F.when(m == 9, a)).alias("september"), (F.sum(a).cast("double") / 12).alias("average"))
    r8, r9 = F.coalesce(F.col("august").cast("double"), F.lit(0.0)) / F.col("average"), F.coalesce(F.col("september").cast("double"), F.lit(0.0)) / F.col("average")
    return s.select("august", "september", F.round("average", 2).alias("average"), F.round(r8, 4).alias("august_ratio"), F.round(r9, 4).alias("september_ratio"),
                    ((r8 > 1.5) | (r9 > 1.5)).alias("elevated"))


def exclusions_summary(t: dict, source: str = "sam_gov") -> DataFrame:
    return t["debarred"].agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"), F.count_if(F.col("source") == source).alias("from_source"))


def debarment_alerts(t: dict, k: int = 5) -> DataFrame:
    """Latest screening alerts with the overall and high-severity counts."""
    a = t["alert"].where(F.col("alert_type") == "debarred_vendor")
    total = a.agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "high").alias("h"))
    return a.orderBy(F.desc("created_at"), F.desc("id")).limit(k).select("id", "title", "severity", total.select("n").scalar().alias("alerts"), total.select("h").scalar().alias("high"))


def search_vendors(t: dict, text: str, k: int = 20) -> DataFrame:
    return t["vendor"].where(F.ilike("name", F.lit(f"%{text}%"))).orderBy("id").limit(k).select("id", "vendor_id", "name", "city", "state", "risk_score")


def show_vendor(t: dict, key: str) -> DataFrame:
    """By state id or, where the text is a number, by id."""
    return t["vendor"].where((F.col("vendor_id") == key) | (F.col("id") == F.lit(key).try_cast("bigint")))


def search_contributions(t: dict, column: str, text: str, min_amount: float | None = None) -> DataFrame:
    """Contributions whose contributor (normalised text) or filer holds the text, largest first."""
    wanted = F.concat(F.lit("%"), normalize_vendor_name(F.lit(text)) if column == "contributor_normalized" else F.lit(text), F.lit("%"))
    hit = t["contribution"].where(F.ilike(column, wanted))
    hit = hit if not min_amount else hit.where(F.col("contribution_amount") >= min_amount)
    return hit.orderBy(F.desc("contribution_amount"), "id")


def top_contributors(t: dict, k: int = 100, min_amount: float | None = None) -> DataFrame:
    c = t["contribution"] if not min_amount else t["contribution"].where(F.col("contribution_amount") >= min_amount)
    per = c.groupBy("contributor_normalized", "contributor_name").agg(F.sum("contribution_amount").alias("total_amount"), F.count("*").alias("contributions"))
    return per.orderBy(F.desc("total_amount"), "contributor_normalized", "contributor_name").limit(k)


def salary_stats(t: dict) -> DataFrame:
    """Per agency: count, least, greatest, mean and upper median salary.

    The median is found on salary counts, so an agency is never gathered as one list.
    """
    from pyspark.sql import Window

    counts = t["employee"].where(F.col("annual_salary") != 0).groupBy("agency_id", "annual_salary").agg(F.count("*").alias("n"))
    w = Window.partitionBy("agency_id")
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy("annual_salary"))).withColumn("total", F.sum("n").over(w))
    return run.groupBy("agency_id").agg(
        F.sum("n").alias("employees"), F.min("annual_salary").alias("least"), F.max("annual_salary").alias("greatest"),
        F.round(F.sum(F.col("annual_salary") * F.col("n")).cast("double") / F.sum("n"), 2).alias("mean"),
        F.min(F.when(F.col("upto") > F.expr("total div 2"), F.col("annual_salary"))).alias("median"))


def search_employees(t: dict, text: str, k: int = 100) -> DataFrame:
    wanted = F.concat(F.lit("%"), normalize_vendor_name(F.lit(text)), F.lit("%"))
    return t["employee"].where(F.ilike("name_normalized", wanted)).orderBy("id").limit(k).select("id", "name", "agency_id", "job_title")


def agency_award_profile(t: dict) -> DataFrame:
    """Awards per agency and year."""
    return t["grant"].groupBy("agency_id", "fiscal_year").agg(F.count("*").alias("awards"), F.sum("amount_awarded").alias("amount"), F.count_distinct("recipient_id").alias("recipients"))


def search_awards(t: dict, text: str | None = None, kinds: list[str] | None = None, first_year: int | None = None, last_year: int | None = None, k: int = 100) -> DataFrame:
    """Awards by text, kind and federal fiscal years (October to September), largest first."""
    g = t["grant"]
    g = g if text is None else g.where(F.ilike("description", F.lit(f"%{text}%")))
    g = g if kinds is None else g.where(F.col("program_name").isin(kinds))
    g = g if first_year is None else g.where(F.col("start_date") >= F.lit(dt.date(first_year - 1, 10, 1)))
    g = g if last_year is None else g.where(F.col("start_date") <= F.lit(dt.date(last_year, 9, 30)))
    return g.orderBy(F.desc("amount_awarded"), "id").limit(k).select("id", "description", "program_name", "amount_awarded", "start_date")


def select_rows(df: DataFrame, columns: list[str] | None = None, where: str | None = None, order: list[str] | None = None, k: int = 1000) -> DataFrame:
    """Ad-hoc look at a table: columns, condition, order (a column, or a column and desc) and limit."""
    out = df if where is None else df.where(where)
    keys = [F.desc(o[:-5]) if o.endswith(" desc") else F.asc(o) for o in order or []]
    out = out.orderBy(*keys) if keys else out
    return (out if columns is None else out.selectExpr(*columns)).limit(k)


def search_permits(t: dict, text: str, k: int = 100) -> DataFrame:
    return t["tax_permit"].where(F.contains(F.upper("taxpayer_normalized"), F.upper(F.lit(text)))).orderBy("id").limit(k)


