"""Queries of the reports, the alert life cycle, requests and the load log."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from spendwarden.operators import tables
from spendwarden.plans import alerts, duplicates, employee_match, reports, requests, splitting, sync_log
from spendwarden.plans import engine
from spendwarden.plans.rulebook import Rulebook
from spendwarden.session import cut

from .registry import BODIES, P, register
from .rules_matching import _EMP, _SIDES, EDGES, MEMBERS, PAIRS
from .rules_relational import _split_sql, fy
from .sqltext import names_cte

D = P.as_of
_PD = "(select vendor_id, sum(amount) as total, count(*) as payments from payment_v where vendor_id is not null group by 1)"

register("q01_overview", "vendor payment contract alert", lambda t, p: reports.overview(t), """
select 'vendor' as item, count(*)::double as value from vendor_v union all select 'payment', count(*) from payment_v union all select 'contract', count(*) from contract_v
union all select 'alert', count(*) from alert_v union all select 'total_spend', sum(amount)::double from payment_v""")
register("q02_latest_syncs", "sync_status region", lambda t, p: reports.latest_syncs(t, t["sync_status"].select("source_name").union(
    t["region"].select(F.concat(F.lit("region_"), "r_name"))).distinct()).drop("started_at"), """
with s as (select distinct source_name from sync_status_v union select 'region_' || r_name from region),
l as (select *, row_number() over (partition by source_name order by started_at desc, run_id desc) as rn from sync_status_v)
select s.source_name, coalesce(status, 'never') as status, records_synced from s left join l on l.source_name = s.source_name and rn = 1""")
_RANK = "case severity when 'low' then 0 when 'medium' then 1 else 2 end"
register("q03_alerts_by_severity", "alert", lambda t, p: reports.alert_counts(t, "severity"), "select severity, count(*) as n from alert_v group by 1")
register("q03_top_alerts", "alert", lambda t, p: reports.top_alerts(t),
         f"select id, alert_type, severity, title, created_at from alert_v order by {_RANK} desc, created_at desc, id desc limit 8")
register("q04_top_vendors", "vendor payment", lambda t, p: reports.top_vendors(t), f"""
select vendor_id, total::double as total, payments, name from (select p.*, v.name from {_PD} p join vendor_v v on v.id = p.vendor_id) order by total desc, vendor_id limit 8""")
register("q05_vendors_page", "vendor payment", lambda t, p: reports.vendors_page(t, "ring", number=1), f"""
select v.id, v.name, hub_status, in_cmbl, risk_score::bigint as risk_score, total::double as total from vendor_v v left join {_PD} p on p.vendor_id = v.id
where v.name ilike '%ring%' order by total desc nulls first, v.id limit 50 offset 50""")
register("q05_risky_vendors", "vendor payment", lambda t, p: reports.vendors_page(t, None, True), f"""
select v.id, v.name, hub_status, in_cmbl, risk_score::bigint as risk_score, total::double as total from vendor_v v left join {_PD} p on p.vendor_id = v.id
where risk_score >= 50 order by total desc nulls first, v.id limit 50""")
register("q06_payments_page", "payment", lambda t, p: reports.payments_page(t, 20000, 60000, 2), """
select id, vendor_id, agency_id, amount::double as amount, payment_date from payment_v where amount between 20000 and 60000 order by amount desc, id limit 50 offset 100""")
register("q07_contracts_page", "contract", lambda t, p: reports.contracts_page(t, D, "urgent", True), """
select id, contract_number, vendor_id, current_value::double as current_value, end_date from contract_v where (contract_number ilike '%urgent%' or description ilike '%urgent%')
and end_date between date '2001-07-31' and date '2001-10-29' order by current_value desc nulls last, id limit 50""")
register("q08_vendor_detail", "vendor payment contract", lambda t, p: reports.vendor_detail(t, 8), """
select id, vendor_id, name, address, city, state, hub_status, in_cmbl, risk_score::bigint as risk_score, (select count(*) from payment_v where vendor_id = 8) as payment_count,
  (select coalesce(sum(amount), 0)::double from payment_v where vendor_id = 8) as payment_total, (select count(*) from contract_v where vendor_id = 8) as contract_count,
  (select coalesce(sum(current_value), 0)::double from contract_v where vendor_id = 8) as contract_total from vendor_v where id = 8""")
register("q08_contract_detail", "contract vendor payment", lambda t, p: reports.contract_detail(t, 6, D), """
select c.id, contract_number, v.name as vendor_name, current_value::double as current_value, max_value::double as max_value, start_date, end_date,
  (select count(*) from payment_v p where p.vendor_id = c.vendor_id and p.agency_id is not distinct from c.agency_id) as payment_count,
  (select coalesce(sum(amount), 0)::double from payment_v p where p.vendor_id = c.vendor_id and p.agency_id is not distinct from c.agency_id) as payment_total,
  (end_date - date '2001-07-31')::bigint as days_remaining from contract_v c left join vendor_v v on v.id = c.vendor_id where c.id = 6""")
register("q08_payment_detail", "payment vendor agency", lambda t, p: reports.payment_detail(t, t["payment"].agg(F.max("id")).first()[0]), """
select p.id, amount::double as amount, payment_date, p.vendor_id, v.name as vendor_name, p.agency_id, a.name as agency_name, is_confidential from payment_v p
left join vendor_v v on v.id = p.vendor_id left join agency_v a on a.id = p.agency_id where p.id = (select max(id) from payment_v)""")
register("q09_alerts_page", "alert", lambda t, p: reports.alerts_page(t, "medium", 1), f"""
select id, alert_type, severity, title, status, created_at from alert_v where severity = 'medium' order by {_RANK} desc, created_at desc, id desc limit 50 offset 50""")
register("q10_summary", "vendor payment contract alert debarred", lambda t, p: reports.summary(t), """
select 'vendors' as item, count(*)::double as value from vendor_v union all select 'payments', count(*) from payment_v union all select 'contracts', count(*) from contract_v
union all select 'alerts', count(*) from alert_v union all select 'total_spend', sum(amount)::double from payment_v
union all select 'hub_vendors', count(*) from vendor_v where hub_status is not null and hub_status not in ('', 'N', 'Non HUB')
union all select 'active_exclusions', count(*) from debarred_v where is_active""")
register("q11_hub_distribution", "vendor", lambda t, p: reports.hub_distribution(t), """
select category, count(*) as n from (select case when hub_status = 'X' and json_extract_string(raw_data, '$."ELIGIBILITY CODE"') = 'BL' then 'Black American'
  when hub_status = 'X' then 'Woman Owned' else hub_status end as category from vendor_v where hub_status is not null) group by 1 order by n desc, category limit 10""")
register("q12_top_agencies", "payment agency", lambda t, p: reports.top_agencies(t), """
select agency_id, sum(amount)::double as total, a.name from payment_v p join agency_v a on a.id = p.agency_id group by 1, 3 order by sum(amount) desc, agency_id limit 10""")
register("q13_spend_by_year", "payment", lambda t, p: reports.spend_by_year(t, 4), f"""
select {fy('payment_date')} as fiscal_year, sum(amount)::double as total from payment_v where payment_date is not null group by 1 order by 1 desc limit 4""")
register("q14_payment_sizes", "payment", lambda t, p: reports.payment_sizes(t), """
select b.place, b.bucket, count(p.id) as n from (values (0::bigint, '$0-1K', 0, 1e3), (1, '$1K-10K', 1e3, 1e4), (2, '$10K-100K', 1e4, 1e5), (3, '$100K-1M', 1e5, 1e6),
(4, '$1M+', 1e6, 1e18)) b(place, bucket, lo, hi) left join payment_v p on p.amount >= b.lo and p.amount < b.hi group by 1, 2""")
register("q15_contract_durations", "contract", lambda t, p: reports.contract_durations(t), """
select b.place, b.bucket, count(c.id) as n from (values (0::bigint, '< 1 year', -1e9, 1), (1, '1-2 years', 1, 2), (2, '2-5 years', 2, 5), (3, '5+ years', 5, 1e9)) b(place, bucket, lo, hi)
left join contract_v c on (end_date - start_date) / 365.25 >= b.lo and (end_date - start_date) / 365.25 < b.hi group by 1, 2""")
register("q16_vendor_states", "vendor", lambda t, p: reports.vendor_states(t), "select state, count(*) as n from vendor_v group by 1 order by 2 desc, 1 limit 10")
register("q17_alerts_by_type", "alert", lambda t, p: reports.alert_counts(t, "alert_type"), "select alert_type, count(*) as n from alert_v group by 1")
register("q18_alerts_by_status", "alert", lambda t, p: reports.alert_counts(t, "status"), "select status, count(*) as n from alert_v group by 1")
register("q19_hub_split", "vendor", lambda t, p: reports.hub_split(t), """
select hub, total - hub as non_hub, round(hub::double / total * 100, 1) as hub_share
from (select count(*) filter (where hub_status is not null and hub_status not in ('', 'N', 'N/A', 'Non HUB', 'X')) as hub, count(*) as total from vendor_v)""")
register("q20_employee_match_counts", "employee vendor payment",
         lambda t, p: reports.employee_match_counts(employee_match.entity_match_rows(employee_match.name_matches(t, p), employee_match.address_sides(t))), f"""with {_EMP}, {_SIDES}
select (select count(*) from em) + (select count(*) from es where address in (select address from vs)) as matches, (select count(*) from em) as high_confidence""")
register("q21_contributing_vendors", "contribution vendor payment", lambda t, p: reports.contributing_vendors(t), f"""
select v.id as vendor_id, v.name, c.s::double as contributed, p.total::double as total from vendor_v v
join (select contributor_normalized as n, sum(contribution_amount) as s from contribution_v group by 1) c on c.n = v.name_normalized
join {_PD} p on p.vendor_id = v.id where total > 10000 order by p.total desc, v.id limit 10""")
register("q22_ghost_indicators", "vendor payment", lambda t, p: reports.ghost_indicators(t), """
select count(*) filter (where in_cmbl) as in_cmbl, count(*) filter (where not in_cmbl) as not_in_cmbl, count(*) filter (where address is null or address = '') as no_address,
  (select count(distinct p.vendor_id) from payment_v p join vendor_v v on v.id = p.vendor_id where not in_cmbl) as paid_not_in_cmbl from vendor_v""")
register("q23_year_end_months", "payment", lambda t, p: reports.year_end_months(t), """
select a::double as august, s::double as september, round(m, 2) as average, round(a::double / m, 4) as august_ratio, round(s::double / m, 4) as september_ratio,
       a::double / m > 1.5 or s::double / m > 1.5 as elevated from (select sum(amount) filter (where month(payment_date) = 8) as a,
       sum(amount) filter (where month(payment_date) = 9) as s, sum(amount)::double / 12 as m from payment_v)""")
register("q24_exclusions_summary", "debarred", lambda t, p: reports.exclusions_summary(t, "SAM"),
         "select count(*) as total, count(*) filter (where is_active) as active, count(*) filter (where source = 'SAM') as from_source from debarred_v")
register("q25_debarment_alerts", "alert", lambda t, p: reports.debarment_alerts(t), """
select id, title, severity, (select count(*) from alert_v where alert_type = 'debarred_vendor') as alerts,
  (select count(*) from alert_v where alert_type = 'debarred_vendor' and severity = 'high') as high
from alert_v where alert_type = 'debarred_vendor' order by created_at desc, id desc limit 5""")
register("q26_search_vendors", "vendor", lambda t, p: reports.search_vendors(t, "WIDGET"), """
select id, vendor_id, name, city, state, risk_score::bigint as risk_score from vendor_v where name ilike '%widget%' order by id limit 20""")
register("q27_show_vendor", "vendor", lambda t, p: reports.show_vendor(t, "1000008").select("id", "vendor_id", "name"),
         "select id, vendor_id, name from vendor_v where vendor_id = '1000008' or id = 1000008")
register("q28_alerts_list", "alert", lambda t, p: reports.alerts_list(t, "high", "new"), """
select id, alert_type, severity, status, title, created_at from alert_v where severity = 'high' and status = 'new' order by created_at desc, id desc limit 20""")
register("q28_alert_detail", "alert", lambda t, p: reports.alert_detail(t, 6), "select * from alert_v where id = 6")
register("q29_contributions_by_contributor", "contribution", lambda t, p: reports.search_contributions(t, "contributor_normalized", "ring", 500).drop("contributor_name"), """
select id, filer_name, contributor_normalized, contribution_amount::double as contribution_amount, contribution_date from contribution_v
where contributor_normalized ilike '%RING%' and contribution_amount >= 500""")
register("q29_contributions_by_filer", "contribution", lambda t, p: reports.search_contributions(t, "filer_name", "filer 3", 100).drop("contributor_name"), """
select id, filer_name, contributor_normalized, contribution_amount::double as contribution_amount, contribution_date from contribution_v
where filer_name ilike '%filer 3%' and contribution_amount >= 100""")
register("q30_top_contributors", "contribution", lambda t, p: reports.top_contributors(t, 100, 50), """
select contributor_normalized, contributor_name, sum(contribution_amount)::double as total_amount, count(*) as contributions from contribution_v where contribution_amount >= 50
group by 1, 2 order by sum(contribution_amount) desc, 1, 2 limit 100""")
register("q31_requests", "pia_request", lambda t, p: requests.list_requests(t["pia_request"], "pending"), """
select * from pia_request_v where status = 'pending' order by submitted_date desc, id desc limit 20""")
_SPLIT_P = P.but(contract_splitting_min=20000, contract_splitting_max=500000, contract_splitting_months=60)
register("q32_draft_requests", "alert contract", lambda t, p: requests.draft_requests(t["alert"], splitting.alert_contracts(t["alert"], t["contract"], _SPLIT_P)).select(
    "related_alert_id", "agency_id", "subject", "status", "letter", F.regexp_count("request_text", F.lit(r"(?m)^  - C-")).alias("listed")), """
select a.id as related_alert_id, (a.entity_id % 25) as agency_id, 'Records Request: ' || title as subject, 'draft' as status,
  case alert_type when 'contract_splitting' then 'splitting' when 'duplicate_payment' then 'duplicate' when 'vendor_cluster_name' then 'relationship' else 'general' end as letter,
  case when alert_type = 'contract_splitting' then (select count(*) from contract_v c where c.vendor_id = a.eid and c.agency_id = a.entity_id
    and c.current_value between 20000 and 500000 and c.start_date >= date '2001-07-31' - 1800) else 0 end as listed
from (select * exclude (entity_id), entity_id as eid, cast(json_extract_string(evidence, '$.agency_id') as bigint) as entity_id from alert_v) a""")
register("q31_show_request", "pia_request agency alert", lambda t, p: requests.show_request(t["pia_request"], t["agency"], t["alert"], 6), """
select r.*, a.name as agency_name, o.title as alert_title from pia_request_v r left join agency_v a on a.id = r.agency_id left join alert_v o on o.id = r.related_alert_id where r.id = 6""")
register("q33_submit_and_overdue", "pia_request", lambda t, p: requests.mark_overdue(requests.submit(t["pia_request"], F.col("submitted_date")), D).select(
    "id", "status", "submitted_date", "due_date"), """
with days as (select r.id, d::date as d, row_number() over (partition by r.id order by d) as n from pia_request_v r, unnest(generate_series(r.submitted_date + 1, r.submitted_date + 16, interval 1 day)) as x(d)
  where isodow(d) < 6 and r.status = 'draft'),
s as (select r.id, case when r.status = 'draft' then 'pending' else r.status end as status, submitted_date, coalesce(days.d, r.due_date) as due_date
      from pia_request_v r left join days on days.id = r.id and days.n = 10)
select id, case when status = 'pending' and due_date < date '2001-07-31' then 'overdue' else status end as status, submitted_date, due_date from s""")
register("q34_salary_stats", "employee", lambda t, p: reports.salary_stats(t), """
select agency_id, count(*) as employees, min(annual_salary)::double as least, max(annual_salary)::double as greatest, round(sum(annual_salary)::double / count(*), 2) as mean,
  list_sort(list(annual_salary))[count(*) // 2 + 1]::double as median from employee_v group by 1""")
register("q34_search_employees", "employee", lambda t, p: reports.search_employees(t, "employee 12"), """
select id, name, agency_id, job_title from employee_v where name_normalized ilike '%EMPLOYEE 12%' order by id limit 100""")
register("q35_agency_awards", "grant", lambda t, p: reports.agency_award_profile(t), """
select agency_id, fiscal_year::bigint as fiscal_year, count(*) as awards, sum(amount_awarded)::double as amount, count(distinct recipient_id) as recipients from grant_v group by 1, 2""")
register("s21_select_rows", "contract", lambda t, p: reports.select_rows(t["contract"], ["id", "current_value * 2 as twice"], "max_value > 800000", ["current_value desc", "id"], 25), """
select id, (current_value * 2)::double as twice from contract_v where max_value > 800000 order by current_value desc, id limit 25""")
register("s21_search_permits", "tax_permit", lambda t, p: reports.search_permits(t, "plate"), """
select * from tax_permit_v where taxpayer_normalized like '%PLATE%' order by id limit 100""")
register("s23_search_awards", "grant", lambda t, p: reports.search_awards(t, "to 1", ["TYPE F", "TYPE O"], 1997, 1999, 60), """
select id, description, program_name, amount_awarded::double as amount_awarded, start_date from grant_v where description ilike '%to 1%' and program_name in ('TYPE F', 'TYPE O')
and start_date between date '1996-10-01' and date '1999-09-30' order by amount_awarded desc, id limit 60""")


def _fresh(t, p):
    found = alerts.as_findings(duplicates.near_duplicates(t, p)).unionByName(alerts.as_findings(duplicates.exact_duplicates(t, p)))
    return alerts.new_alerts(found, t["alert"])


_DUP = """
found as (select 'near_duplicate_payment' as alert_type, sev, vendor_id from (select vendor_id, case when n >= 6 or amount >= 25000 then 2 when n >= 4 then 1 else 0 end as sev
  from (select vendor_id, amount, run, count(*) as n from (select p.vendor_id, p.amount, p.payment_date, r.run from payment_v p join (
      select *, sum(case when payment_date - prev <= 30 then 0 else 1 end) over (partition by vendor_id, amount order by payment_date) as run from (
        select *, lag(payment_date) over (partition by vendor_id, amount order by payment_date) as prev from (
          select distinct vendor_id, amount, payment_date from payment_v where vendor_id is not null and amount >= 5000 and payment_date is not null))) r
      on r.vendor_id = p.vendor_id and r.amount = p.amount and r.payment_date = p.payment_date) group by 1, 2, 3 having count(distinct payment_date) > 1))
  union all select 'duplicate_payment', case when n >= 5 or amount >= 50000 then 2 when n >= 3 or amount >= 10000 then 1 else 0 end, vendor_id
  from (select vendor_id, amount, payment_date, count(*) as n from payment_v where vendor_id is not null and amount > 100 group by 1, 2, 3 having count(*) > 1)),
best as (select alert_type, vendor_id, max(sev) as sev from found group by 1, 2)
"""
register("k01_alert_rows", "payment vendor alert", lambda t, p: alerts.to_alert_rows(_fresh(t, p), dt.datetime(2001, 8, 1)).select(
    "alert_type", "severity", "entity_type", "entity_id", "status", "created_at", (F.count_if(F.col("id").isNotNull()).over(
        __import__("pyspark").sql.Window.partitionBy("id"))).alias("same_id")), f"""with {_DUP}
select b.alert_type, case sev when 2 then 'high' when 1 then 'medium' else 'low' end as severity, 'vendor' as entity_type, b.vendor_id as entity_id, 'new' as status,
  timestamp '2001-08-01' as created_at, 1::bigint as same_id from best b where not exists (select 1 from alert_v a where a.alert_type = b.alert_type and a.entity_type = 'vendor'
  and a.entity_id = b.vendor_id and a.status not in ('resolved', 'false_positive'))""")
register("k02_new_alerts", "payment vendor alert", lambda t, p: _fresh(t, p).select("alert_type", "severity", "entity_type", "entity_id"), f"""with {_DUP}
select b.alert_type, case sev when 2 then 'high' when 1 then 'medium' else 'low' end as severity, 'vendor' as entity_type, b.vendor_id as entity_id
from best b where not exists (select 1 from alert_v a where a.alert_type = b.alert_type and a.entity_type = 'vendor' and a.entity_id = b.vendor_id
  and a.status not in ('resolved', 'false_positive'))""")
register("k07_sources_to_load", "sync_status", lambda t, p: sync_log.sources_to_load(t["sync_status"].select("source_name").distinct(), t["sync_status"]), """
select distinct source_name from sync_status_v where source_name not in (select source_name from sync_status_v where status = 'success' and records_synced > 0)""")
register("k07_last_success", "sync_status", lambda t, p: sync_log.last_success(t["sync_status"]),
         "select source_name, max(started_at) as last_success from sync_status_v where status = 'success' group by 1")


def _events(t):
    return t["lineitem"].select(F.col("l_orderkey").alias("alert_id"), F.when(F.col("l_returnflag") == "A", "acknowledged").when(
        F.col("l_returnflag") == "R", "resolved").otherwise("false_positive").alias("status"),
        F.when(F.col("l_linestatus") == "F", F.lit("seen")).alias("note"), F.col("l_shipdate").cast("timestamp").alias("at"))


register("k08_current_alerts", "alert lineitem", lambda t, p: alerts.current_alerts(t["alert"], _events(t)).select(
    "id", "status", "notes", "acknowledged_at", "resolved_at"), """
with ev as (select l_orderkey as alert_id, case l_returnflag when 'A' then 'acknowledged' when 'R' then 'resolved' else 'false_positive' end as status,
  l_linestatus = 'F' as noted, l_shipdate as ts from lineitem)
select a.id, coalesce((select first(e.status order by e.ts desc, e.status desc) from ev e where e.alert_id = a.id), a.status) as status,
  (select string_agg('seen', chr(10)) from ev e where e.alert_id = a.id and e.noted) as notes, (select max(ts) from ev e where e.alert_id = a.id and e.status = 'acknowledged') as acknowledged_at,
  (select max(ts) from ev e where e.alert_id = a.id and e.status <> 'acknowledged') as resolved_at from alert_v a""")

_ALL = "vendor payment contract agency employee contribution tax_permit debarred alert entity_match"


def _run_all(t, p):
    found, outcome = engine.run_all(t, p)
    bad = [o for o in outcome if o["status"] == "failed"]
    if bad:
        raise RuntimeError(str(bad))
    return found.groupBy("alert_type", "severity").agg(F.count("*").alias("findings"))


def _with_defaults() -> dict[str, str]:
    """Rule SQL with the default thresholds in place of those the single queries use."""
    since = "2000-08-05"
    out = {"d01": _split_sql(45000, 50000, since, "'high'"),
           "d02": _split_sql(22000, 25000, since, "case when g.cv < 0.1 and g.n >= 5 then 'high' else 'medium' end")}
    changes = {
        "d04_exact_duplicates": (), "d05_near_duplicates": (), "d06_related_vendor_duplicates": (("<= 60", "<= 30"),), "d07_address_clusters": (),
        "d08_similar_name_alerts": (), "d09_sequential_alerts": (), "d11_round_numbers": (("n >= 4", "n >= 5"), ("0.08", "0.25")), "d12_large_first_payments": (),
        "d13_over_contract": (), "d14_unlisted_vendors": (), "d15_august_spikes": (("0.09", "0.20"),), "d16_high_confidentiality": (("0.10", "0.20"),),
        "d17_confidentiality_spikes": (("rn >= 5 and hn >= 10 and r > h + 0.01", "rn >= 50 and hn >= 100 and r > h + 0.10"),),
        "d18_vendor_confidentiality": (("r >= 0.20", "r >= 0.50"),), "d21_hub_vendors": (("m + 2 * sd", "m + 3 * sd"), ("d > m + sd", "d > m + 2 * sd")),
        "d22_vendor_clusters": (), "d23_exclusive": (("0.002", "0.80"),), "d25_raw_address_clusters": (), "d27_pay_to_play": (), "d28_unregistered_vendors": (),
        "d30_employee_vendor_names": (), "d31_employee_vendor_addresses": (), "d32_ghost_vendors": (), "d33_incomplete_addresses": (), "d34_suspicious_addresses": (),
        "d35_fiscal_year_rush": (), "d36_vendor_year_end": (), "d37_year_end_clusters": (), "d38_related_party_networks": (), "d39_triangles": (),
        "d40_circular_patterns": (), "d41_debarred_vendors": (),
    }
    for key, pairs in changes.items():
        body = BODIES[key]
        for old, new in pairs:
            if old not in body:
                raise ValueError((key, old))
            body = body.replace(old, new)
        for block in (MEMBERS, PAIRS, EDGES, names_cte("nm", "vendor_v", "name_normalized")):  # stated once, in front
            body = body.replace(block, "")
        body = re.sub(r"^\s*with[\s,]*(?=select)", "", body)
        body = re.sub(r"^\s*with[\s,]+", "with recursive ", body)
        out[key] = body
    return out


def _counts(parts: list[str]) -> str:
    rows = " union all ".join(f"(select alert_type, severity from ({b.strip()}) as r{i})" for i, b in enumerate(parts))
    return f"select alert_type, severity, count(*) as findings from ({rows}) group by 1, 2"


_RULE_SQL = _with_defaults()
register("d45_run_all", _ALL, _run_all, f"with {MEMBERS}, {PAIRS}, {EDGES} " + _counts(list(_RULE_SQL.values())))
register("d46_run_rule", _ALL, lambda t, p: engine.run_rule("payment-anomalies", t, p).groupBy("alert_type", "severity").agg(F.count("*").alias("findings")),
         _counts([b for k, b in _RULE_SQL.items() if k[:3] in ("d11", "d12", "d13", "d14", "d15")]))


def _relations(t):
    """Old and new relationship rows in either order of the pair."""
    old = t["orders"].selectExpr("o_custkey as vendor_id_1", "o_orderkey % 97 as vendor_id_2", "'similar_name' as relationship_type",
                                 "cast(o_totalprice / 1000000 as decimal(5,4)) as confidence_score", "o_orderpriority as evidence")
    new = t["lineitem"].selectExpr("l_suppkey as vendor_id_1", "l_partkey % 97 as vendor_id_2", "'similar_name' as relationship_type",
                                   "cast(l_discount * 5 as decimal(5,4)) as confidence_score", "l_returnflag as evidence")
    return tables.ordered_pair(old, "vendor_id_1", "vendor_id_2"), tables.ordered_pair(new, "vendor_id_1", "vendor_id_2")


_KEEP = ["vendor_id_1", "vendor_id_2", "relationship_type"]


def _k03(t, p):
    old, new = _relations(t)
    return tables.keep_best(tables.keep_best(old.limit(0), old, _KEEP, "confidence_score"), new, _KEEP, "confidence_score")


register("k03_relationship_upsert", "orders lineitem", _k03, """
with o as (select least(o_custkey, o_orderkey % 97) as a, greatest(o_custkey, o_orderkey % 97) as b, cast(o_totalprice / 1000000 as decimal(5,4)) as c, o_orderpriority as e, 0 as n from orders),
m as (select least(l_suppkey, l_partkey % 97) as a, greatest(l_suppkey, l_partkey % 97) as b, cast(l_discount * 5 as decimal(5,4)) as c, l_returnflag as e, 1 as n from lineitem)
select a as vendor_id_1, b as vendor_id_2, 'similar_name' as relationship_type, max(c)::double as confidence_score, first(e order by c desc, n, e desc) as evidence
from (select * from o union all select * from m) group by 1, 2""")


def _k04(t, p):
    rows = cut(employee_match.entity_match_rows(employee_match.name_matches(t, p), employee_match.address_sides(t)))
    weaker = rows.withColumn("confidence_score", F.lit(0.5))
    return tables.keep_best(weaker, rows, ["entity_type_1", "entity_id_1", "entity_type_2", "entity_id_2", "match_type"], "confidence_score").select(
        "entity_id_1", "entity_id_2", "match_type", F.round("confidence_score", 6).alias("confidence_score"))


register("k04_entity_match_upsert", "employee vendor payment", _k04, f"""with {_EMP}, {_SIDES}
select employee_id as entity_id_1, vendor_id as entity_id_2, 'name' as match_type, round(score / 100, 6) as confidence_score from em union all
select es.id, min(vs.id), 'address', 0.85 from es join vs on vs.address = es.address group by es.id""")
register("k06_insert_absent", "contract", lambda t, p: tables.insert_absent(
    t["contract"].where("source = 'F'").select("contract_number", "description"), t["contract"].selectExpr("concat('C-', cast(vendor_id as string)) as contract_number", "description", "id"),
    ["contract_number"], F.col("id")).select("contract_number", "description"), """
select contract_number, description from contract_v where source = 'F' union all
select 'C-' || vendor_id, first(description order by id) from contract_v where 'C-' || vendor_id not in (select contract_number from contract_v where source = 'F') group by 1""")
register("k06_upsert", "contract", lambda t, p: tables.upsert(
    t["contract"].where("source = 'F'").select("contract_number", "description", "agency_id"),
    t["contract"].selectExpr("concat('C-', cast(vendor_id as string)) as contract_number", "description", "agency_id", "id"), ["contract_number"], F.col("id"), keep_if_null=("agency_id",)), """
with n as (select 'C-' || vendor_id as k, last(description order by id) as d, arg_max(struct_pack(x := agency_id), id).x as a from contract_v group by 1),
o as (select * from contract_v where source = 'F')
select coalesce(n.k, o.contract_number) as contract_number, case when n.k is null then o.description else n.d end as description,
       case when n.k is null then o.agency_id else coalesce(n.a, o.agency_id) end as agency_id from n full join o on o.contract_number = n.k""")


def _user_rule(t, p):
    """A rule of a user's own, with a shared input of its own, among two of the library's."""
    book = engine.BOOK.copy()
    book.shared("weekend", "payment", lambda t, p: t["payment"].where(F.dayofweek("payment_date").isin(1, 7) & F.col("vendor_id").isNotNull()))

    @book.rule("weekend_payments", "weekend", before="duplicates")
    def _(t, p):
        per = t["weekend"].groupBy("vendor_id").agg(F.count("*").alias("payments"), F.sum("amount").alias("total")).where("payments >= 5")
        return per.select(F.lit("weekend_payments").alias("alert_type"), F.when(F.col("total") >= 300000, "high").otherwise("low").alias("severity"), F.lit("vendor").alias("entity_type"),
                          F.col("vendor_id").alias("entity_id"), "payments", "total")

    found, outcome = engine.run_all(t, p, Rulebook(s for s in book.steps.values() if not s.rule or s.name in ("weekend_payments", "confidentiality", "debarment")))
    if any(o["status"] == "failed" for o in outcome):
        raise RuntimeError(str(outcome))
    return found.select("rule_order", "alert_type", "severity", "entity_id")


register("d45_user_rule", "vendor payment agency debarred", _user_rule, f"""with found as ({{}})
select 0::bigint as rule_order, 'weekend_payments' as alert_type, case when sum(amount) >= 300000 then 'high' else 'low' end as severity, vendor_id as entity_id
from payment_v where isodow(payment_date) >= 6 and vendor_id is not null group by vendor_id having count(*) >= 5
union all select 1, alert_type, severity, entity_id from (select * from found) where alert_type <> 'debarred_vendor'
union all select 2, alert_type, severity, entity_id from found where alert_type = 'debarred_vendor'""".format(
    " union all ".join(f"(select alert_type, severity, entity_id from ({_RULE_SQL[k].strip()}) as r{i})" for i, k in enumerate(
        ("d16_high_confidentiality", "d17_confidentiality_spikes", "d18_vendor_confidentiality", "d41_debarred_vendors")))))
