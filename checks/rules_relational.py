"""Queries of the rules that need only grouping, joins and windows."""

from __future__ import annotations

from spendwarden.plans import anomalies, confidentiality, duplicates, fiscal, ghost, splitting

from .registry import P, register

_WIDE = P.but(contract_splitting_min=20000, contract_splitting_max=50000, contract_splitting_months=36)
_SMALL = P.but(esbd_threshold=25000, esbd_band=20000, contract_splitting_months=48)
_FY = "(year({d}) + case when month({d}) >= 9 then 1 else 0 end)"


def fy(d: str) -> str:
    return _FY.replace("{d}", d)


def _split_sql(low, high, since, sev):
    return f"""
select 'contract_splitting' as alert_type, {sev} as severity, 'vendor' as entity_type, g.vendor_id as entity_id, v.name as vendor_name,
       g.agency_id as agency_id, coalesce(a.name, 'Unknown') as agency_name, g.n as contract_count, cast(g.total as double) as total_value,
       round(cast(g.total as double) / g.n, 2) as avg_value, round(g.cv, 3) as coefficient_of_variation, cast({high} as double) as threshold
from (select vendor_id, agency_id, count(*) as n, sum(current_value) as total,
             stddev_pop(cast(current_value as double)) / avg(cast(current_value as double)) as cv
      from contract_v where current_value between {low} and {high} and start_date >= date '{since}' and vendor_id is not null
      group by vendor_id, agency_id having count(*) >= 3) g
join vendor_v v on v.id = g.vendor_id left join agency_v a on a.id = g.agency_id"""


def _rounded(df):
    from pyspark.sql import functions as F
    return df.withColumn("avg_value", F.round(F.col("total_value").cast("double") / F.col("contract_count"), 2))


register("d01_contract_splitting", "contract vendor agency", lambda t, p: _rounded(splitting.contract_splitting(t, _WIDE)),
         _split_sql(20000, 50000, "1998-08-15", "'high'"))
register("d02_contract_splitting_small", "contract vendor agency", lambda t, p: _rounded(splitting.contract_splitting_small(t, _SMALL)),
         _split_sql(5000, 25000, "1997-08-20", "case when g.cv < 0.1 and g.n >= 5 then 'high' else 'medium' end"))
register("d01_splitting_contracts", "contract vendor agency",
         lambda t, p: splitting.splitting_contracts(t, _WIDE, splitting.contract_splitting(t, _WIDE), 20000, 50000), """
select vendor_id, agency_id, contract_number, cast(current_value as double) as current_value, start_date, description
from (select *, count(*) over (partition by vendor_id, agency_id) as n from contract_v
      where current_value between 20000 and 50000 and start_date >= date '1998-08-15' and vendor_id is not null) where n >= 3""")
register("d03_splitting_candidates", "contract vendor", lambda t, p: splitting.splitting_candidates(t, 2, 50000, 30000), """
select g.vendor_id, g.n as contract_count, cast(g.total as double) as total_value, v.name as vendor_name, v.vendor_id as vendor_vid
from (select vendor_id, count(*) as n, sum(current_value) as total from contract_v where current_value between 20000 and 50000
      and vendor_id is not null group by 1 having count(*) >= 2) g join vendor_v v on v.id = g.vendor_id""")

register("d04_exact_duplicates", "payment vendor", duplicates.exact_duplicates, """
select 'duplicate_payment' as alert_type, case when n >= 5 or amount >= 50000 then 'high' when n >= 3 or amount >= 10000 then 'medium' else 'low' end as severity,
       'vendor' as entity_type, g.vendor_id as entity_id, v.name as vendor_name, cast(amount as double) as amount, payment_date,
       n as duplicate_count, cast(amount * n as double) as total_duplicate_amount, agencies
from (select vendor_id, amount, payment_date, count(*) as n, count(distinct agency_id) as agencies from payment_v
      where vendor_id is not null and amount > 100 group by 1, 2, 3 having count(*) > 1) g join vendor_v v on v.id = g.vendor_id""")
register("d04_duplicate_payments", "payment vendor", lambda t, p: duplicates.exact_duplicate_payments(t, duplicates.exact_duplicates(t, p)), """
select vendor_id, cast(amount as double) as amount, payment_date, id, agency_id, description, source_system
from (select *, count(*) over (partition by vendor_id, amount, payment_date) as n from payment_v where vendor_id is not null and amount > 100) where n > 1""")

_RUNS = """
with days as (select *, lag(payment_date) over (partition by vendor_id, amount order by payment_date) as prev
     from (select distinct vendor_id, amount, payment_date from payment_v where vendor_id is not null and amount >= 5000 and payment_date is not null)),
runs as (select vendor_id, amount, payment_date, sum(case when payment_date - prev <= 30 then 0 else 1 end)
     over (partition by vendor_id, amount order by payment_date) as run from days),
pays as (select p.*, r.run, min(p.payment_date) over (partition by p.vendor_id, p.amount, r.run) as first_date,
     max(p.payment_date) over (partition by p.vendor_id, p.amount, r.run) as last_date
     from payment_v p join runs r on p.vendor_id = r.vendor_id and p.amount = r.amount and p.payment_date = r.payment_date)
"""
register("d05_near_duplicates", "payment vendor", duplicates.near_duplicates, _RUNS + """
select 'near_duplicate_payment' as alert_type, case when n >= 6 or amount >= 25000 then 'high' when n >= 4 then 'medium' else 'low' end as severity,
       'vendor' as entity_type, g.vendor_id as entity_id, v.name as vendor_name, cast(amount as double) as amount, n as payment_count, days,
       first_date, last_date, cast(amount * n as double) as total_amount
from (select vendor_id, amount, run, first_date, last_date, count(*) as n, count(distinct payment_date) as days from pays group by all
      having count(distinct payment_date) > 1) g join vendor_v v on v.id = g.vendor_id""")
register("d05_near_duplicate_payments", "payment vendor", duplicates.near_duplicate_payments, _RUNS + """
select vendor_id, cast(amount as double) as amount, first_date, payment_date, id, agency_id from pays where first_date <> last_date""")

_ROUND = P.but(round_number_amounts=(10000, 25000, 50000, 100000), round_number_min_count=4, round_number_min_share=0.08)
register("d11_round_numbers", "payment vendor", lambda t, p: anomalies.round_numbers(t, _ROUND), """
select 'round_number_payments' as alert_type, case when n * 2 >= total or s >= 500000 then 'medium' else 'low' end as severity, 'vendor' as entity_type,
       g.vendor_id as entity_id, v.name as vendor_name, cast(amount as double) as round_amount, n as round_count, total as total_payments,
       round(n::double / total * 100, 1) as round_percentage, cast(s as double) as total_round_value
from (select vendor_id, amount, count(*) as n, sum(amount) as s from payment_v where amount in (10000, 25000, 50000, 100000) group by 1, 2) g
join (select vendor_id, count(*) as total from payment_v group by 1) t on t.vendor_id = g.vendor_id
join vendor_v v on v.id = g.vendor_id where n >= 4 and n::double / total >= 0.08""")
register("d12_large_first_payments", "payment vendor", anomalies.large_first_payments, """
select 'large_first_payment' as alert_type, case when amount >= 500000 then 'high' else 'medium' end as severity, 'vendor' as entity_type,
       p.vendor_id as entity_id, v.name as vendor_name, p.id as payment_id, cast(amount as double) as amount, payment_date, first_seen, in_cmbl, agency_id
from (select *, min(payment_date) over (partition by vendor_id) as first_date from payment_v where vendor_id is not null) p
join vendor_v v on v.id = p.vendor_id where payment_date = first_date and amount >= 100000 and (first_seen is null or first_seen >= date '1999-08-01')""")
register("d13_over_contract", "payment contract", anomalies.over_contract_payments, """
select 'over_contract_payment' as alert_type, case when ex * 2 >= max_value or ex >= 100000 then 'high' else 'medium' end as severity, 'contract' as entity_type,
       id as entity_id, contract_number, vendor_id, agency_id, cast(max_value as double) as max_value, cast(total as double) as total_payments,
       cast(ex as double) as excess_amount, round(cast(ex as double) / cast(max_value as double) * 100, 1) as excess_percentage
from (select c.*, t.total, t.total - c.max_value as ex from contract_v c
      join (select vendor_id, agency_id, sum(amount) as total from payment_v group by 1, 2) t
        on t.vendor_id = c.vendor_id and t.agency_id is not distinct from c.agency_id where c.max_value > 0) where ex > 0""")
register("d14_unlisted_vendors", "payment vendor", anomalies.unlisted_vendors, """
select 'ghost_vendor' as alert_type, case when sum(amount) >= 500000 then 'high' else 'medium' end as severity, 'vendor' as entity_type, v.id as entity_id,
       v.name as vendor_name, cast(sum(amount) as double) as total_payments, count(*) as payment_count, v.address
from payment_v p join vendor_v v on v.id = p.vendor_id where not in_cmbl group by v.id, v.name, v.address having sum(amount) >= 50000""")
register("d15_august_spikes", "payment agency", lambda t, p: anomalies.august_spikes(t, P.but(august_share=0.09)), f"""
select 'fy_end_spike' as alert_type, case when pct >= 0.35 then 'medium' else 'low' end as severity, 'agency' as entity_type, g.agency_id as entity_id,
       a.name as agency_name, f as fiscal_year, cast(aug as double) as august_spending, cast(total as double) as fy_total_spending,
       round(pct * 100, 1) as august_percentage
from (select agency_id, {fy('payment_date')} as f, sum(case when month(payment_date) = 8 then amount else 0 end) as aug, sum(amount) as total,
             cast(sum(case when month(payment_date) = 8 then amount else 0 end) as double) / cast(sum(amount) as double) as pct
      from payment_v where agency_id is not null and {fy('payment_date')} between 1996 and 2000 group by 1, 2) g
join agency_v a on a.id = g.agency_id where pct >= 0.09""")

_CONF = P.but(confidentiality_rate_threshold=0.10)
_CONF_SQL = """
select 'high_confidentiality_rate' as alert_type, case when c::double / n >= 0.4 then 'high' else 'medium' end as severity, 'agency' as entity_type,
       g.agency_id as entity_id, a.name as agency_name, n as total_count, c as confidential_count, c::double / n as rate, cast(s as double) as total_amount,
       cast(cs as double) as confidential_amount, round(cast(cs as double) / cast(s as double) * 100, 1) as confidential_amount_rate
from (select agency_id, count(*) as n, count(*) filter (where is_confidential) as c, sum(amount) as s,
             sum(case when is_confidential then amount else 0 end) as cs from payment_v where agency_id is not null group by 1) g
join agency_v a on a.id = g.agency_id where n >= 100 and c::double / n >= 0.10"""
register("d16_high_confidentiality", "payment agency", lambda t, p: confidentiality.high_confidentiality(t, _CONF), _CONF_SQL)
register("k05_agency_rates", "payment agency",
         lambda t, p: confidentiality.agencies_with_rate(t["agency"], confidentiality.high_confidentiality(t, _CONF)), f"""
select a.*, cast(cast(f.rate as decimal(5,4)) as double) as confidentiality_rate from agency_v a left join ({_CONF_SQL}) f on f.entity_id = a.id""")
_SPIKE = P.but(confidentiality_recent_min=5, confidentiality_history_min=10, confidentiality_spike_delta=0.01)
register("d17_confidentiality_spikes", "payment agency", lambda t, p: confidentiality.confidentiality_spikes(t, _SPIKE), """
select 'confidentiality_spike' as alert_type, case when r - h >= 0.25 then 'high' else 'medium' end as severity, 'agency' as entity_type,
       agency_id as entity_id, name as agency_name, rn as recent_count, rc as recent_confidential, hn as history_count, hc as history_confidential,
       round((r - h) * 100, 1) as increase
from (select p.agency_id, a.name, count(*) filter (where payment_date >= date '2001-05-02') as rn,
             count(*) filter (where payment_date >= date '2001-05-02' and is_confidential) as rc,
             count(*) filter (where payment_date < date '2001-05-02') as hn,
             count(*) filter (where payment_date < date '2001-05-02' and is_confidential) as hc,
             rc::double / rn as r, hc::double / hn as h
      from payment_v p join agency_v a on a.id = p.agency_id where payment_date >= date '2000-07-31' group by 1, 2)
where rn >= 5 and hn >= 10 and r > h + 0.01""")
register("d18_vendor_confidentiality", "payment vendor",
         lambda t, p: confidentiality.vendor_confidentiality(t, P.but(vendor_confidentiality_rate=0.20)), """
select 'vendor_high_confidentiality' as alert_type, case when r >= 0.9 and s >= 100000 then 'high' when r >= 0.75 then 'medium' else 'low' end as severity,
       'vendor' as entity_type, g.vendor_id as entity_id, v.name as vendor_name, n as total_count, c as confidential_count,
       round(r * 100, 1) as confidential_rate, cast(s as double) as total_amount
from (select vendor_id, count(*) as n, count(*) filter (where is_confidential) as c, sum(amount) as s, c::double / n as r
      from payment_v where vendor_id is not null group by 1) g join vendor_v v on v.id = g.vendor_id where n >= 10 and r >= 0.20""")
register("d19_confidentiality_summary", "payment", lambda t, p: confidentiality.confidentiality_summary(t), """
select n as total_transactions, c as confidential_transactions, cast(s as double) as total_amount, cast(cs as double) as confidential_amount,
       round(c::double / n * 100, 2) as confidential_rate, round(cast(cs as double) / cast(s as double) * 100, 2) as confidential_amount_rate
from (select count(*) as n, count(*) filter (where is_confidential) as c, sum(amount) as s, sum(amount) filter (where is_confidential) as cs from payment_v)""")

register("d32_ghost_vendors", "payment vendor", ghost.ghost_vendors, """
select 'ghost_vendor' as alert_type, case when total >= 500000 or (vid is null)::int + (address is null or city is null)::int + (phone is null)::int + (ag >= 3)::int >= 3
            then 'high' else 'medium' end as severity, 'vendor' as entity_type, id as entity_id, name as vendor_name, cast(total as double) as total_payments,
       n as payment_count, ag as agency_count, d1 as first_payment, d2 as last_payment,
       concat_ws('|', case when vid is null then 'No state vendor ID' end, case when address is null or city is null then 'Incomplete address' end,
                 case when phone is null then 'No phone number' end, case when ag >= 3 then 'Payments from ' || ag || ' different agencies' end) as red_flags
from (select v.id, v.name, v.vendor_id as vid, v.address, v.city, v.phone, sum(amount) as total, count(*) as n, count(distinct agency_id) as ag,
             min(payment_date) as d1, max(payment_date) as d2 from payment_v p join vendor_v v on v.id = p.vendor_id where not in_cmbl group by 1,2,3,4,5,6)
where total >= 25000""")
register("d33_incomplete_addresses", "payment vendor", ghost.incomplete_addresses, """
select 'incomplete_vendor_address' as alert_type, case when total >= 100000 or m >= 3 then 'high' else 'medium' end as severity, 'vendor' as entity_type,
       id as entity_id, name as vendor_name, cast(total as double) as total_payments, n as payment_count,
       concat_ws('|', case when a then 'street address' end, case when city is null then 'city' end, case when zip_code is null then 'ZIP code' end) as missing_fields
from (select v.id, v.name, v.city, v.zip_code, (v.address is null or length(v.address) < 5) as a, sum(amount) as total, count(*) as n,
             a::int + (v.city is null)::int + (v.zip_code is null)::int as m
      from payment_v p join vendor_v v on v.id = p.vendor_id where in_cmbl and (v.address is null or length(v.address) < 5 or city is null) group by all)
where total >= 25000""")
register("d34_suspicious_addresses", "payment vendor", ghost.suspicious_addresses, """
select 'suspicious_vendor_address' as alert_type, case when total >= 500000 or len(flags) >= 3 then 'high' when total >= 100000 then 'medium' else 'low' end as severity,
       'vendor' as entity_type, id as entity_id, name as vendor_name, cast(total as double) as total_payments, n as payment_count, address,
       array_to_string(flags, '|') as red_flags
from (select *, pats || (case when array_to_string(pats, ' ') like '%box%' and total >= 250000 then ['Large payments to PO Box address'] else [] end)
             || (case when length(address) < 10 then ['Very short address'] else [] end) as flags
      from (select v.id, v.name, v.address, sum(amount) as total, count(*) as n,
                   list_filter(['po box','p.o. box','p o box','pmb','suite 0','apt 0','unit 0','unknown','n/a','none','general delivery'],
                               lambda x: contains(lower(v.address), x)) as pats
            from payment_v p join vendor_v v on v.id = p.vendor_id where v.address is not null group by 1, 2, 3))
where len(pats) > 0 and total >= 25000""")

register("d35_fiscal_year_rush", "payment agency", fiscal.spending_rush, f"""
select 'fiscal_year_spending_rush' as alert_type, case when ar >= 3 or fin::double / total::double >= 0.35 then 'high' else 'medium' end as severity, 'agency' as entity_type,
       agency_id as entity_id, a.name as agency_name, f as fiscal_year, total::double as fy_total, fin::double as final_months, jul::double as july, aug::double as august,
       n as payment_count, round(fr, 2) as final_months_ratio, round(ar, 2) as august_ratio
from (select *, fin::double / ((total - fin)::double / 10) as fr, aug::double / ((total - fin)::double / 10) as ar from (
        select agency_id, {fy('payment_date')} as f, sum(amount) as total, sum(case when month(payment_date) in (7, 8) then amount else 0 end) as fin,
               sum(case when month(payment_date) = 7 then amount else 0 end) as jul, sum(case when month(payment_date) = 8 then amount else 0 end) as aug, count(*) as n
        from payment_v where agency_id is not null and {fy('payment_date')} between 1996 and 2000 group by 1, 2)) g
join agency_v a on a.id = g.agency_id where total > fin and (fr >= 2 or ar >= 2) and fin >= 100000""")
register("d36_vendor_year_end", "payment vendor", fiscal.vendor_year_end, f"""
select 'vendor_fy_end_concentration' as alert_type, case when pct >= 0.9 or fin >= 500000 then 'high' else 'medium' end as severity, 'vendor' as entity_type,
       vendor_id as entity_id, vname as vendor_name, f as fiscal_year, total::double as fy_total, fin::double as final_months, n as payment_count, fn as final_months_count,
       round(pct * 100, 1) as final_months_percentage
from (select p.vendor_id, v.name as vname, {fy('payment_date')} as f, sum(amount) as total, sum(case when month(payment_date) in (7, 8) then amount else 0 end) as fin,
             count(*) as n, count(*) filter (where month(payment_date) in (7, 8)) as fn, fin::double / total::double as pct
      from payment_v p join vendor_v v on v.id = p.vendor_id where {fy('payment_date')} between 1998 and 2000 group by 1, 2, 3)
where total >= 50000 and pct >= 0.7""")
_LAST = f"""(select agency_id, {fy('payment_date')} as f, sum(amount) as total, count(*) as n, count(distinct vendor_id) as vn from payment_v
      where agency_id is not null and {fy('payment_date')} between 1996 and 2000 and month(payment_date) = 8 and day(payment_date) >= 27 group by 1, 2
      having sum(amount) >= 100000)"""
register("d37_year_end_clusters", "payment agency", fiscal.year_end_clusters, f"""
select 'fy_end_payment_cluster' as alert_type, case when total >= 1000000 or n >= 50 then 'high' else 'medium' end as severity, 'agency' as entity_type,
       agency_id as entity_id, a.name as agency_name, f as fiscal_year, total::double as final_days_total, n as payment_count, vn as vendor_count
from {_LAST} g join agency_v a on a.id = g.agency_id""")
register("d37_year_end_top_vendors", "payment agency", fiscal.year_end_top_vendors, f"""
select agency_id, fiscal_year, vendor_id, amount, place from (
  select p.agency_id, g.f as fiscal_year, p.vendor_id, sum(p.amount)::double as amount,
         row_number() over (partition by p.agency_id, g.f order by sum(p.amount) desc, p.vendor_id) as place
  from payment_v p join {_LAST} g on g.agency_id = p.agency_id and g.f = {fy('p.payment_date')}
  where month(payment_date) = 8 and day(payment_date) >= 27 and vendor_id is not null group by 1, 2, 3)""")
