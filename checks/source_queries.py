"""Queries of sources, resolution and column functions."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from spendwarden import jobs, loads
from spendwarden.functions import addresses, names, scalars, similarity
from spendwarden.operators import resolve, substring
from spendwarden.operators.components import connected_components, fold_edges
from spendwarden.plans import alerts, confidentiality, employee_match
from spendwarden.plans.reports import hub_category
from spendwarden.plans.requests import RESPONSE_DAYS
from spendwarden.schema import read_tables, write_table
from spendwarden.session import cut, ensure_checkpoint_dir
from spendwarden.sources import contracts, html_tables, parties, payments, readers, vendors

from .registry import P, register
from .rules_matching import _EMP, _SIDES
from .sqltext import names_cte, norm_line, norm_name, norm_parts, norm_street, ratio_sql

D = P.as_of


def money(x: str) -> str:
    return f"try_cast(regexp_replace({x}, '[$,]', '', 'g') as decimal(15,2))::double"


def date(x: str, *formats: str) -> str:
    return "coalesce(" + ", ".join(f"try_strptime({x}, '{f}')" for f in formats) + ")::date"


def once(view: str, keys: str, order: str = "_pos", where: str = "true") -> str:
    return f"(select * from {view} where {where} qualify row_number() over (partition by {keys} order by {order}) = 1)"


_V = ["vendor_id", "name", "name_normalized", "address", "city", "state", "zip_code", "phone", "hub_status", "first_seen", "in_cmbl"]


def _upserted(t, p):
    old = t["vendor"].where("in_cmbl and vendor_id is not null").select("id", *_V).withColumn("last_seen", F.lit(None).cast("date")).withColumn("raw_data", F.lit(""))
    return vendors.upsert_vendors(old, vendors.map_vendors(t["land_vendor"], D)).select(*_V)


register("s01_vendor_master", "land_vendor vendor", _upserted, f"""
select v.vendor_id, v.name, {norm_name('v.name')} as name_normalized, address,
  case when address is not null then coalesce(upper(trim(city)), '') when in_cmbl then city end as city,
  case when address is not null or in_cmbl then state end as state, case when address is not null then coalesce(zip_code, '') when in_cmbl then zip_code end as zip_code,
  phone, hub_status, case when in_cmbl then coalesce(first_seen, date '2001-07-31') else date '2001-07-31' end as first_seen, true as in_cmbl
from vendor_v v where vendor_id is not null""")
register("s02_class_codes", "land_class", lambda t, p: vendors.class_codes(t["land_class"]), """
select CLASS_VID as vendor_id, array_to_string(list_sort(list(distinct CLASS_CODE)), '|') as nigp_codes from land_class_v group by 1""")
register("s02_attach_codes", "land_class vendor", lambda t, p: vendors.attach_codes(t["vendor"].select("id", "vendor_id"), vendors.class_codes(t["land_class"])), """
select v.id, v.vendor_id, array_to_string(c, '|') as nigp_codes from vendor_v v left join (select CLASS_VID as k, list_sort(list(distinct CLASS_CODE)) as c from land_class_v group by 1) on k = v.vendor_id""")
_SP = f"(select *, {money('amount')} as m from land_spending_v where agency_name <> '' or agency_number <> '')"
_SPO = ["source_id", "amount", "agency_name", "agency_code", "description", "fiscal_year_state"]
register("s03_expenditures_first", "land_spending", lambda t, p: payments.map_expenditures(t["land_spending"], 2001).select(*_SPO), f"""
select '2001-' || agency_number || '-' || major_spending_category as source_id, m as amount, agency_name, agency_number as agency_code, major_spending_category as description,
  2001::bigint as fiscal_year_state from {_SP} where m <> 0 qualify row_number() over (partition by agency_number, major_spending_category order by _pos) = 1""")
register("s03_expenditures_sum", "land_spending", lambda t, p: payments.map_expenditures(t["land_spending"], 2001, "sum").select(*_SPO), f"""
select '2001-' || agency_number || '-' || major_spending_category as source_id, sum(m) as amount, min(agency_name) as agency_name, agency_number as agency_code,
  major_spending_category as description, 2001::bigint as fiscal_year_state from {_SP} where m <> 0 group by 1, 4, 5""")
_PD = date("payment_date", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", "%m/%d/%Y")
register("s04_payments", "land_payment", lambda t, p: payments.map_payments(t["land_payment"]).drop("raw_data", "_pos", "agency_code"), f"""
select {money('amount')} as amount, d as payment_date, coalesce(payee_name, '') as vendor_name, coalesce(agency_name, '') as agency_name, '' as comptroller_object_code, description,
  confidential = 'y' as is_confidential, 'socrata' as source_system, id as source_id, (year(d) + (month(d) >= 9)::int)::bigint as fiscal_year_state,
  (year(d) + (month(d) >= 10)::int)::bigint as fiscal_year_federal, year(d)::bigint as calendar_year
from (select *, {_PD} as d from land_payment_v) where {money('amount')} <> 0 qualify row_number() over (partition by id order by _pos) = 1""")


def _payees(t, p):
    rows = payments.map_payee_payments(t["land_payment"], "payments_2001")
    return rows, t["vendor"], t["agency"]


def _payee_first(t, p):
    rows, v, a = _payees(t, p)
    linked = resolve.link_agencies(resolve.link_vendors(rows, v), a)
    return payments.first_payments(linked).select("vendor_id", "agency_id", "amount", "payment_date", "vendor_name", "agency_name")


register("s05_payee_payments", "land_payment vendor agency", _payee_first, f"""
with n as materialized (select name as raw, {norm_name('name')} as k from (select distinct name from vendor_v)),
vn as (select n.raw, (select min(id) from vendor_v v where v.name_normalized = n.k) as vid from n),
r as (select l._pos, vn.vid as vendor_id, try_cast(l.agency_code as bigint) as code, payee_name as vendor_name, agency_name, {money('amount')} as amount,
  case when payment_date like '%T%' then try_strptime(split_part(payment_date, 'T', 1), '%Y-%m-%d')::date else try_strptime(left(payment_date, 10), '%Y-%m-%d')::date end as payment_date
  from land_payment_v l join vn on vn.raw = l.payee_name)
select vendor_id, null::bigint as agency_id, amount, payment_date, vendor_name, agency_name from r where amount is not null
qualify row_number() over (partition by vendor_id, amount, payment_date order by _pos) = 1""")
register("s06_contract_csv", "land_contract", lambda t, p: contracts.map_contract_csv(t["land_contract"]).drop("raw_data", "_pos"), f"""
select n as contract_number, "Vendor" as vendor_name, coalesce("Agency", '') as agency_name, left("Subject", 500) as description, {money('"Current Contract Value"')} as current_value,
  {date('"Award Date"', '%Y-%m-%d', '%m/%d/%Y')} as start_date, {date('"Completion Date"', '%m/%d/%Y', '%Y-%m-%d')} as end_date,
  nullif(array_to_string(regexp_extract_all("NGIP Codes and Categories", '\\d{{3}}-\\d{{2}}'), '|'), '') as nigp_codes, 'LBB' as source
from (select *, trim(regexp_replace("Contract-ID", '<[^>]*>', '', 'g')) as n from land_contract_v) qualify row_number() over (partition by n order by _pos) = 1""")
register("s07_contract_sheet", "land_sheet", lambda t, p: contracts.map_contract_sheet(t["land_sheet"]).drop("raw_data", "_pos"), f"""
select "Contract Number" as contract_number, "Contractor" as vendor_name, null::varchar as agency_name, "Description" as description,
  coalesce({money('"Contract Value"')}, {money('"Value"')}) as current_value, {money('"Max Value"')} as max_value, {date('"Effective Date"', '%m/%d/%Y')} as start_date,
  {date('"Expiration Date"', '%m/%d/%Y')} as end_date, replace("NIGP Code", ', ', '|') as nigp_codes, "FY"::bigint as fiscal_year, 'LBB' as source
from land_sheet_v where "Contract Number" <> 'nan' qualify row_number() over (partition by "Contract Number" order by _pos desc) = 1""")
register("s08_federal_awards", "land_award", lambda t, p: contracts.map_awards(t["land_award"], "grants", 2001).drop("raw_data", "_pos"), f"""
select "Award ID" as grant_number, "Recipient Name" as vendor_name, "Awarding Agency" as agency_name, "Description" as program_name, {money('"Award Amount"')} as amount_awarded,
  try_cast("Total Outlays" as double) as amount_disbursed, 2001::bigint as fiscal_year, left("Start Date", 10)::date as start_date, null::date as end_date, 'usaspending_grants' as source,
  "Award ID" as federal_award_id from land_award_v qualify row_number() over (partition by "Award ID" order by _pos) = 1""")
register("s09_cooperative_contracts", "land_coop", lambda t, p: contracts.map_cooperative(t["land_coop"]).drop("raw_data", "_pos"), f"""
select contract_number, coalesce(primary_vendor_name, '') as vendor_name, nullif(case when contract_type = '' then rfo_description when rfo_description = '' then contract_type || '/' || contract_subtype
  else rfo_description || ' [' || contract_type || '/' || contract_subtype || ']' end, '') as description, left(contract_start, 10)::date as start_date, contract_termination_date::date as end_date,
  'dir_contracts' as source from {once('land_coop_v', 'contract_number', '_pos', "contract_number <> ''")}""")
_SALES = "(select *, try_cast(purchase_amount as decimal(15,2)) as m from land_sales_v where contract_number is not null)"
register("s10_sales_rollup", "land_sales", lambda t, p: contracts.sales_rollup(t["land_sales"]).drop("_pos"), f"""
select contract_number, sum(m)::double as current_value, first(coalesce(vendor_name, '') order by _pos) as vendor_name, first(coalesce(customer_name, '') order by _pos) as agency_name,
  first(rfo_description order by _pos) as description, arg_min(struct_pack(d := contract_start_date::date), _pos).d as start_date, null::date as end_date, 'dir_sales' as source
from {_SALES} where m > 0 group by 1""")
register("s10_apply_sales", "land_sales contract", lambda t, p: contracts.apply_sales(t["contract"].select("contract_number", "current_value"), contracts.sales_rollup(t["land_sales"])).select(
    "contract_number", "current_value", "base_value"), f"""
with s as (select contract_number, sum(m) as m from {_SALES} where m > 0 group by 1)
select coalesce(c.contract_number, s.contract_number) as contract_number, (coalesce(c.current_value, 0) + coalesce(s.m, 0))::double as current_value,
  coalesce(c.current_value, 0)::double as base_value from contract_v c full join s on s.contract_number = c.contract_number""")


def _salaries(t, p):
    return payments.last_salaries(resolve.link_agencies(payments.map_salaries(t["land_salary"]), t["agency"])).drop("raw_data", "_pos", "employment_status")


register("s11_salaries", "land_salary agency", _salaries, f"""
select name, {norm_name('name')} as name_normalized, agency_name, agency_code, job_title, annual_salary, hire_date, agency_id from (
  select case when "LAST NAME" = '' then l."Name" else "FIRST NAME" || ' ' || "LAST NAME" end as name, "AGENCY NAME" as agency_name, "AGENCY" as agency_code, "CLASS TITLE" as job_title,
  {money('"ANNUAL"')} as annual_salary, {date("split_part(\"HIRE DATE\", 'T', 1)", '%Y-%m-%d', '%m/%d/%Y')} as hire_date, a.id as agency_id, l._pos
  from land_salary_v l left join agency_v a on a.agency_code = l."AGENCY") qualify row_number() over (partition by name, agency_id order by _pos desc) = 1""")
register("s12_tax_permits", "land_permit", lambda t, p: parties.map_permits(t["land_permit"], "sales").select(
    "permit_type", "taxpayer_name", "taxpayer_normalized", "taxpayer_number", "business_name", "business_address", "permit_status", "first_sale_date"), f"""
select 'sales' as permit_type, taxpayer_name, {norm_name('taxpayer_name')} as taxpayer_normalized, nullif(taxpayer_number, '') as taxpayer_number, business_name, address as business_address,
  coalesce(permit_status, 'active') as permit_status, left(first_sale_date, 10)::date as first_sale_date from land_permit_v where taxpayer_name <> ''
qualify taxpayer_number = '' or row_number() over (partition by taxpayer_number order by _pos desc) = 1""")
register("s13_contributions", "land_gift", lambda t, p: parties.map_contributions(t["land_gift"]).select(
    "filer_name", "contributor_name", "contributor_normalized", "contribution_amount", "contribution_date", "contributor_city"), f"""
select filer_name, contributor_name, {norm_name('contributor_name')} as contributor_normalized, contribution_amount, contribution_date, null::varchar as contributor_city from (
  select _pos, "filerName" as filer_name, case when "contributorNameOrganization" <> '' then "contributorNameOrganization" else "contributorNameFirst" || ' ' || "contributorNameLast" end as contributor_name,
  {money('"contributionAmount"')} as contribution_amount, {date('"contributionDate"', '%Y%m%d', '%m/%d/%Y')} as contribution_date from land_gift_v)
where contribution_amount >= 500 qualify row_number() over (partition by filer_name, contributor_name, contribution_amount, contribution_date order by _pos) = 1""")
register("s14_exclusions_csv", "land_exclusion", lambda t, p: parties.map_exclusions(t["land_exclusion"], D).select(
    "sam_number", "entity_name", "name_normalized", "address", "start_date", "end_date", "is_active", "exclusion_type", "source"), f"""
select s as sam_number, n as entity_name, {norm_name('n')} as name_normalized, a as address, date '1999-01-01' as start_date, e as end_date, e is null or e >= date '2001-07-31' as is_active,
  "Exclusion Type" as exclusion_type, 'sam_gov' as source from (
  select *, "SAM Number" as s, case when "Name" <> '' then "Name" when "Last" <> '' then 'Dr Sam Roe' else 'Dr Sam' end as n, nullif(concat_ws(', ', "Address 1", "Address 2"), '') as a,
  {date('"Termination Date"', '%Y-%m-%d', '%m/%d/%Y')} as e from land_exclusion_v where "SAM Number" <> '') qualify row_number() over (partition by s order by _pos) = 1""")
register("s15_exclusions_json", "land_exclusion_json debarred", lambda t, p: parties.map_exclusions_json(t["land_exclusion_json"], D).select(
    "sam_number", "entity_name", "address", "city", "start_date", "end_date", "is_active", "exclusion_type"), """
select 'J' || (id % 60) as sam_number, case when id % 4 = 0 then 'Sam Roe' else entity_name end as entity_name, address, 'X' as city, date '1999-02-03' as start_date,
  case when id % 3 = 0 then date '2001-07-30' end as end_date, id % 3 <> 0 as is_active, exclusion_type from debarred_v qualify row_number() over (partition by id % 60 order by id desc) = 1""", "debarred")
register("s16_construction_bids", "land_bid", lambda t, p: contracts.map_bids(t["land_bid"], D.replace(year=D.year - 2, month=1, day=1)).drop("raw_data", "_pos", "source"), f"""
with n as materialized (select name, {norm_name('name')} as k from (select distinct vendor_name as name from land_bid_v))
select case when control_section_job_csj = '' then controlling_project_id_ccsj else control_section_job_csj end as project_id, vendor_name as contractor_name, n.k as contractor_normalized,
  {money('bid_total_amount')} as bid_amount, null::double as engineer_estimate, bid_rank_sequence_number::double::bigint as bid_rank, bid_rank_sequence_number = '1.0' as is_winner,
  project_actual_let_date::date as letting_date, county from land_bid_v l join n on n.name = l.vendor_name
where not (vendor_name ilike '%engineer%' and vendor_name ilike '%estimate%') and project_actual_let_date::date >= date '1999-01-01'
qualify row_number() over (partition by project_id, k order by _pos) = 1""")
register("s17_construction_contracts", "land_construction", lambda t, p: contracts.map_construction(t["land_construction"]).drop("raw_data", "_pos"), f"""
select 'TXDOT-' || contract_number || case when controlling_project_id_ccsj <> '' then '-' || controlling_project_id_ccsj else '' end as contract_number, contractor as vendor_name,
  'TXDOT' as agency_code, 'TEXAS DEPARTMENT OF TRANSPORTATION' as agency_name, county || ' -  to ' as description, {money('coalesce(final_contract_amount, original_contract_amount)')} as current_value,
  {money('original_contract_amount')} as max_value, date_work_begin::date as start_date, date_work_accepted::date as end_date, 'txdot' as source
from {once('land_construction_v', 'contract_number, controlling_project_id_ccsj')}""")


def _cells(t, p):
    return html_tables.table_rows(t["land_page"]).select(
        "page_id", F.element_at("cells", "contract_#").alias("number"), F.element_at("cells", "contract_#_link").alias("link"),
        F.element_at("cells", "vendor_name").alias("vendor"), F.element_at("cells", "start_date").alias("start"), F.element_at("cells", "col_3").alias("extra"))


_US = "month(start_date) || '/' || day(start_date) || '/' || year(start_date)"
register("s19_html_rows", "land_page contract", _cells, f"""
select vendor_id as page_id, contract_number as number, '/d/' || id as link, 'Vendor' || vendor_id as vendor, {_US} as start, '<' || source || '>' as extra from contract_v""", "contract")
register("s18_health_contracts", "land_page contract", lambda t, p: html_tables.map_health_contracts(html_tables.table_rows(t["land_page"])).drop("_pos"), """
select contract_number, 'Vendor' || vendor_id as vendor_name, 'VENDOR' || vendor_id as vendor_normalized, '<' || source || '>' as solicitation_number, start_date, null::date as end_date,
  'hhsc' as agency from contract_v""", "contract")
register("s20_commodity_book", "land_book", lambda t, p: vendors.commodity_descriptions(t["land_book"]), """
select "Class" as class_code, "Item" as item_code, first("Description" order by _pos) as description from land_book_v group by 1, 2 union all
select "Class", null, first("Description" order by _pos) from land_book_v group by 1""")
register("s20_describe_code", "land_book", lambda t, p: vendors.describe_code(t["land_book"], "7", "Brand#3"), """
select "Description" from land_book_v where "Class" = '7' and "Item" = 'Brand#3' order by _pos limit 1""")
register("s22_table_scan", "lineitem", lambda t, p: t["lineitem"].groupBy("l_returnflag", F.year("l_shipdate").alias("y")).agg(F.count("*").alias("n")), """
select l_returnflag, year(l_shipdate)::bigint as y, count(*) as n from lineitem group by 1, 2""")

_N = "n as materialized (select name as raw, {0} as k, min(_pos) as p from (select payee_name as name, _pos from land_payment_v where payee_name is not null) group by 1)".format(norm_name("name"))
register("e01_new_vendors", "land_payment vendor", lambda t, p: resolve.new_vendors(
    t["land_payment"].withColumn("vendor_name", F.col("payee_name")), t["vendor"].where("in_cmbl"), D).select("name", "name_normalized", "in_cmbl", "first_seen"), f"""with {_N}
select first(raw order by p) as name, k as name_normalized, false as in_cmbl, date '2001-07-31' as first_seen from n where k not in (select name_normalized from vendor_v where in_cmbl) group by k""")
register("e04_link_vendors", "land_payment vendor", lambda t, p: resolve.link_vendors(
    t["land_payment"].withColumn("vendor_name", F.col("payee_name")), t["vendor"].where("in_cmbl")).groupBy("vendor_id").agg(F.count("*").alias("n")), f"""with {_N}
select v.id as vendor_id, count(*) as n from land_payment_v l left join n on n.raw = l.payee_name left join (select name_normalized, min(id) as id from vendor_v where in_cmbl group by 1) v
  on v.name_normalized = n.k group by 1""")


def _agencies(t, p):
    rows, table = resolve.resolve_agencies(t["land_salary"].select("_pos", F.col("AGENCY").alias("agency_code"), F.col("AGENCY NAME").alias("agency_name")).withColumn(
        "agency_code", F.when(F.col("_pos") % 3 == 0, "").otherwise(F.col("agency_code"))), t["agency"].where("id >= 3"))
    names = table.select(F.col("id").alias("agency_id"), F.col("agency_code").alias("code"), "name")
    return rows.join(names, "agency_id").groupBy("code", "name").agg(F.count("*").alias("n"))


register("e02_agencies", "land_salary agency", _agencies, """
with r as (select _pos, case when _pos % 3 = 0 then '' else "AGENCY" end as c, "AGENCY NAME" as nm from land_salary_v),
k as (select _pos, case when c = '' then 'D' || split_part(nm, ' ', 2) else c end as c, nm from r),
-- codes A3 and A4 are on file; the others enter once per code, then once per name
cand as (select c, nm, min(_pos) as p from k where c not in ('A3', 'A4') group by 1, 2),
per_name as (select nm, first(c order by p) as c from (select c, first(nm order by p) as nm, min(p) as p from cand group by 1) group by 1),
tab as (select c, nm from per_name union all select agency_code, name from agency_v where id >= 3)
select coalesce(a.c, b.c) as code, coalesce(a.nm, b.nm) as name, count(*) as n from k left join tab a on a.c = k.c left join tab b on b.nm = k.nm group by 1, 2""")
register("e03_coded_agencies", "land_award agency", lambda t, p: resolve.coded_agencies(
    t["land_award"].withColumn("agency_name", F.col("Awarding Agency")), t["agency"].withColumn("agency_code", F.when(F.col("id") == 0, "FED_DON0").when(
        F.col("id") == 1, "FED_DON0_2").otherwise(F.col("agency_code")))).drop("id"), """
select 'FED_DON' || left(split_part(nm, ' ', 4), 1) || case when rn + used = 1 then '' else '_' || (rn + used) end as agency_code, nm as name, 'federal' as category from (
  select nm, row_number() over (partition by left(split_part(nm, ' ', 4), 1) order by nm) as rn, case when left(split_part(nm, ' ', 4), 1) = '0' then 2 else 0 end as used
  from (select distinct "Awarding Agency" as nm from land_award_v))""")

register("f01_parse_money", "land_sales", lambda t, p: t["land_sales"].select("_pos", scalars.parse_money(F.concat(F.lit("$ 1,0"), F.col("purchase_amount"))).alias("m")).withColumn("m", F.coalesce("m", F.lit(-1))), """
select _pos, coalesce(try_cast(trim(regexp_replace('$ 1,0' || purchase_amount, '[$,]', '', 'g')) as decimal(15,2)), -1)::double as m from land_sales_v""")
register("f02_parse_date", "land_payment", lambda t, p: t["land_payment"].select("_pos", scalars.parse_date(F.col("payment_date"), "yyyy-M-d'T'H:m:s", "yyyy-M-d", "M/d/yyyy", cut=19).alias("d")),
         f"select _pos, {_PD} as d from land_payment_v")
_WILD = ("concat(case when id % 4 = 0 then 'The ' when id % 4 = 1 then ' ' else '' end, name, case id % 9 when 0 then '. Corp' when 1 then ' & Sons, Company' when 2 then ' Svcs  Limited' "
         "when 3 then ' Intl (Grp)' when 4 then ' D/B/A Med Ctr' when 5 then ' Incorporated' when 6 then ' of Assoc' else '' end)")
register("f03_normalize_name", "vendor", lambda t, p: t["vendor"].selectExpr("id", f"{_WILD} as raw").select("id", names.normalize_vendor_name(F.col("raw")).alias("k")),
         f"select id, {norm_name('raw')} as k from (select id, {_WILD} as raw from vendor_v)")
register("f04_normalize_address", "vendor", lambda t, p: t["vendor"].select("id", addresses.normalize_address(*[F.col(c) for c in ("address", "city", "state", "zip_code")])["normalized"].alias("k")),
         f"select id, {norm_parts('address', 'city', 'state', 'zip_code')} as k from vendor_v")
_LINE = "concat(cast(id as string), ' north ', split_part(name, ' ', 2), ' avenue suite ', cast(id % 9 as string), ', City ', case when id % 2 = 0 then 'tx' else 'OK' end, ' ', cast(70000 + id % 25 as string), case when id % 3 = 0 then '-1234' else '' end)"
register("f04b_parse_address", "vendor", lambda t, p: t["vendor"].selectExpr("id", f"{_LINE} as line").select("id", addresses.parse_full_address(F.col("line")).alias("a")).select("id", "a.*"), f"""
select id, {norm_street("split_part(line, ', ', 1)")} as street, 'CITY' as city, case when id % 2 = 0 then 'TX' else 'OK' end as state, cast(70000 + id % 25 as varchar) as zip_code,
  {norm_street("split_part(line, ', ', 1)")} || ' CITY ' || case when id % 2 = 0 then 'TX' else 'OK' end || ' ' || cast(70000 + id % 25 as varchar) as normalized
from (select id, {_LINE} as line from vendor_v)""")
def _address_matches(t, p):
    v = t["vendor"].select("id", "address", F.concat("address", F.lit(" N")).alias("b"), F.lit("5 ring street").alias("c"))
    near = similarity.match_addresses(v, "address", "b", "near")
    return similarity.match_addresses(near, "address", "c", "same").select("id", "near", "same")


register("f04c_addresses_match", "vendor", _address_matches, f"""
with v as (select id, {norm_line('address')} as a, {norm_line("(address || ' N')")} as b, '5 RING ST' as c, address is not null as given from vendor_v),
x as (select * from (select distinct a as name from v where given union select distinct b from v where given union select '5 RING ST')),
{names_cte('nx', 'x', 'name')}
select v.id, a.name = b.name or {ratio_sql('a', 'b')} >= 85 as near, a.name = c.name or {ratio_sql('a', 'c')} >= 85 as same
from v join nx a on a.name = v.a join nx b on b.name = v.b join nx c on c.name = v.c where given union all select id, false, false from v where not given""")
register("f06_name_components", "vendor", lambda t, p: t["vendor"].select("id", names.name_components(
    F.concat("name_normalized", F.when(F.col("id") % 2 == 0, F.lit(" dba Best Shop")).otherwise(F.lit(". ")))).alias("c")).select("id", "c.*"), """
select id, regexp_replace(name_normalized, ' INC$', '') as base_name, 'INC' as suffix, case when id % 2 = 0 then 'BEST SHOP' end as dba_name from vendor_v""")
register("f07_name_variants", "vendor", lambda t, p: t["vendor"].select("id", F.explode(names.name_variants(F.col("name_normalized"))).alias("variant")), """
select id, unnest([name_normalized, regexp_replace(name_normalized, ' INC$', ''), replace(name_normalized, ' ', ''), 'THE ' || name_normalized]) as variant from vendor_v""")
register("f08_fiscal_years", "payment", lambda t, p: t["payment"].select("id", scalars.fiscal_years(F.col("payment_date")).alias("f")).select("id", "f.*"), """
select id, (year(payment_date) + (month(payment_date) >= 9)::int)::bigint as state, (year(payment_date) + (month(payment_date) >= 10)::int)::bigint as federal, year(payment_date)::bigint as calendar from payment_v""")
register("f09_year_bounds", "orders", lambda t, p: t["orders"].select(F.year("o_orderdate").alias("y")).distinct().select(
    "y", scalars.state_fy_start(F.col("y")).alias("s1"), scalars.state_fy_end(F.col("y")).alias("s2"), scalars.federal_fy_start(F.col("y")).alias("f1"), scalars.federal_fy_end(F.col("y")).alias("f2")), """
select distinct year(o_orderdate)::bigint as y, make_date(y::int - 1, 9, 1) as s1, make_date(y::int, 8, 31) as s2, make_date(y::int - 1, 10, 1) as f1, make_date(y::int, 9, 30) as f2 from orders""")
register("f10_ratio", "vendor employee", lambda t, p: t["vendor"].select("id", "name_normalized").join(t["employee"].select("id", F.col("name_normalized").alias("e")), "id").select(
    "id", F.round(similarity.ratio(F.col("name_normalized"), F.col("e")), 6).alias("r")), f"""
with {names_cte('nv', 'vendor_v', 'name_normalized')}, {names_cte('ne', 'employee_v', 'name_normalized')}
select v.id, round({ratio_sql('a', 'b')}, 6) as r from vendor_v v join employee_v e on e.id = v.id join nv a on a.name = v.name_normalized join ne b on b.name = e.name_normalized""")
register("f11_hub_category", "vendor", lambda t, p: t["vendor"].select("id", hub_category(F.concat(F.coalesce("hub_status", F.lit("")), F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.lit("-woman asian")))).alias("c")), """
select id, case when id % 3 <> 0 then 'Asian Pacific - Woman' when hub_status is null then 'Unknown' when hub_status = 'X' then 'Multiple Certs' else hub_status end as c from vendor_v""")
register("f12_business_days", "orders", lambda t, p: t["orders"].select("o_orderkey", scalars.add_business_days(F.col("o_orderdate").cast("date"), RESPONSE_DAYS).alias("due")), """
select o_orderkey, (select d::date from unnest(generate_series(o_orderdate + interval 1 day, o_orderdate + interval 16 day, interval 1 day)) x(d) where isodow(d) < 6 order by d offset 9 limit 1) as due from orders""")
register("f13_red_flag_texts", "vendor", lambda t, p: t["vendor"].select("id", addresses.red_flag_texts(F.concat("address", F.when(F.col("id") % 5 == 0, F.lit(" Unit 0 PMB")).otherwise(F.lit("")))).alias("p")), """
select id, array_to_string(list_filter(['po box','p.o. box','p o box','pmb','suite 0','apt 0','unit 0','unknown','n/a','none','general delivery'],
  lambda x: coalesce(contains(lower(address || case when id % 5 = 0 then ' Unit 0 PMB' else '' end), x), false)), '|') as p from vendor_v""")
register("f05_first_nonempty", "vendor", lambda t, p: t["vendor"].select("id", readers.pick(t["vendor"], "hub_status", "phone", "nowhere", "city").alias("first"),
                                                                         readers.filled(t["vendor"], "phone", "hub_status").alias("filled")), """
select id, trim(coalesce(nullif(hub_status, ''), nullif(phone, ''), nullif(city, ''), '')) as first, nullif(trim(coalesce(nullif(phone, ''), nullif(hub_status, ''), '')), '') as filled from vendor_v""")
register("f15_shown_values", "payment", lambda t, p: t["payment"].select("id", F.left("description", F.lit(12)).alias("head"), F.date_format("payment_date", "yyyy-MM-dd").alias("day"),
                                                                         F.round(F.col("amount").cast("double") / 1000, 1).alias("thousands")), """
select id, left(description, 12) as head, strftime(payment_date, '%Y-%m-%d') as day, round(amount::double / 1000, 1) as thousands from payment_v""")
register("f16_scalars", "alert", lambda t, p: t["alert"].select(
    "id", F.length("title").alias("n"), F.month("created_at").alias("m"), F.when(F.col("severity") == "high", 1).otherwise(0).alias("high"), (F.col("status") == "new").cast("int").alias("fresh"),
    scalars.json_text(F.col("evidence"), "vendor_name").alias("who"), F.ilike("title", F.lit("%ALERT 1%")).alias("hit")), """
select id, length(title) as n, month(created_at)::bigint as m, (severity = 'high')::bigint as high, (status = 'new')::bigint as fresh, json_extract_string(evidence, '$.vendor_name') as who,
  title ilike '%ALERT 1%' as hit from alert_v""")

FAR = dt.datetime(2100, 1, 1)  # any file that lands is older


def _folder(t) -> str:
    spark = next(iter(t.values())).sparkSession
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/loads-{uuid.uuid4().hex}"


def _payments_loaded(t, p):
    """The landed payments as files, loaded twice into a table."""
    spark, base = t["land_payment"].sparkSession, _folder(t)
    t["land_payment"].orderBy("_pos").drop("_pos").write.json(f"{base}/landed")
    loads.load(spark, f"{base}/audit", "payments", f"{base}/landed", FAR)
    again = loads.load(spark, f"{base}/audit", "payments", f"{base}/landed", FAR.replace(month=2), full=True)
    if again["records"]:
        raise RuntimeError("a repeated load added rows")
    got = read_tables(spark, f"{base}/audit", "payment", "vendor")
    who = got["vendor"].select(F.col("id").alias("vendor_id"), F.col("name_normalized").alias("payee"))
    return got["payment"].join(who, "vendor_id", "left").select(
        "source_id", "amount", "payment_date", "fiscal_year_state", "is_confidential", "payee", F.col("agency_id").isNotNull().alias("with_agency"))


register("k06_payments_loaded", "land_payment", _payments_loaded, f"""
with n as materialized (select name, {norm_name('name')} as k from (select distinct payee_name as name from land_payment_v where payee_name is not null))
select id as source_id, {money('amount')} as amount, d as payment_date, (year(d) + (month(d) >= 9)::int)::bigint as fiscal_year_state, confidential = 'y' as is_confidential, n.k as payee,
  agency_name is not null as with_agency
from (select *, {_PD} as d from land_payment_v where {money('amount')} <> 0 qualify row_number() over (partition by id order by _pos) = 1) l left join n on n.name = l.payee_name""")


def _bidders_loaded(t, p):
    """Two files of different headers, then a third that changes some vendors, read by two loads."""
    spark, base = t["land_vendor"].sparkSession, _folder(t)
    v = t["land_vendor"].drop("_pos").withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in t["land_vendor"].columns if c != "_pos"})
    odd = v.where("WEB_VID = ''").select(F.col("`STATUS CODE`").alias("CertType"), F.col("STATE").alias("State"), F.col("WEB_NAME_VENDOR_NAME").alias("VENDOR NAME"), F.lit("x").alias("Remark"),
                                         F.trim("`VENDOR ID NUMBER`").alias("VendorId"), F.col("WEB_ADDR1").alias("Street1"), F.col("WEB_CITY").alias("City"), F.col("`ZIP CODE`").alias("Zip"), F.col("WEB_PHONE").alias("Phone"))
    for name, df in (("a", v.where("WEB_VID <> ''")), ("b", odd)):
        df.write.option("header", True).option("escape", '"').csv(f"{base}/landed/{name}")
    loads.load(spark, f"{base}/audit", "bidders", f"{base}/landed/*", FAR)
    more = v.where("WEB_VID <> '' and WEB_ADDR1 <> ''").select("WEB_VID", F.concat(F.lit("New "), "WEB_NAME_VENDOR_NAME").alias("Name"), F.lit("").alias("WEB_PHONE"))
    more.write.option("header", True).option("escape", '"').csv(f"{base}/landed/c")
    loads.load(spark, f"{base}/audit", "bidders", f"{base}/landed/*", FAR.replace(month=2), full=True)  # file c is the last in order
    return read_tables(spark, f"{base}/audit", "vendor")["vendor"].select(*_V)


_NEW = "case when id % 2 = 0 and address is not null and address <> '' then 'New ' || v.name else v.name end"
register("k06_bidders_updated", "land_vendor vendor", _bidders_loaded, f"""
select vendor_id, {_NEW} as name, {norm_name(_NEW)} as name_normalized, nullif(address, '') as address, case when nullif(address, '') is not null then coalesce(upper(trim(city)), '') end as city,
  case when nullif(address, '') is not null then state end as state, case when nullif(address, '') is not null then coalesce(zip_code, '') end as zip_code,
  nullif(phone, '') as phone, nullif(hub_status, '') as hub_status, date '2100-01-01' as first_seen, true as in_cmbl
from vendor_v v where vendor_id is not null""")


def _learned(t, p):
    """Employee matches and agency rates as written after the rules, twice over."""
    spark, base = t["agency"].sparkSession, _folder(t)
    write_table(t["agency"], "agency", f"{base}/agency")
    shared = {"employee_names": cut(employee_match.name_matches(t, p)), "sides": cut(employee_match.address_sides(t))}  # as the rules leave them
    found = alerts.as_findings(confidentiality.high_confidentiality(t, p.but(confidentiality_rate_threshold=0.05)))
    jobs.write_learned(spark, base, shared, found)
    if any(jobs.write_learned(spark, base, shared, found).values()):
        raise RuntimeError("writing twice changed rows")
    got = read_tables(spark, base, "agency", "entity_match")
    return got["agency"].select(F.lit("agency").alias("kind"), "id", F.lit(None).cast("bigint").alias("other"), F.col("confidentiality_rate").cast("double").alias("score")).unionByName(
        got["entity_match"].select(F.col("match_type").alias("kind"), F.col("entity_id_1").alias("id"), F.col("entity_id_2").alias("other"), F.col("confidence_score").cast("double").alias("score")))


register("k05_learned_written", "agency payment employee vendor", _learned, f"""with {_EMP}, {_SIDES}
select 'agency' as kind, a.id, null::bigint as other, case when n >= 100 and c::double / n >= 0.05 then round(c::double / n, 4) end as score from agency_v a
  left join (select agency_id, count(*) as n, count(*) filter (where is_confidential) as c from payment_v group by 1) p on p.agency_id = a.id
union all select 'name', employee_id, vendor_id, round(max(score) / 100, 4) from em group by employee_id, vendor_id
union all select 'address', es.id, min(vs.id), 0.85 from es join vs on vs.address = es.address group by es.id""")
register("f14_initials", "vendor", lambda t, p: t["vendor"].select("id", scalars.initials_code(F.col("name")).alias("code")), """
select id, upper(array_to_string(list_transform(string_split(name, ' ')[1:4], lambda w: left(w, 1)), '')) as code from vendor_v""")


def _folded(t, p):
    """Edges that arrive in three batches, folded one after the other."""
    edges = t["lineitem"].where("l_quantity >= 49").select(F.col("l_partkey").alias("src"), (F.col("l_partkey") + 1 + F.col("l_linenumber") * 3).alias("dst"), F.pmod("l_orderkey", F.lit(3)).alias("turn"))
    labels = connected_components(edges.where("turn = 0"))
    for turn in (1, 2):
        changed = cut(fold_edges(labels, edges.where(F.col("turn") == turn)))
        labels = cut(labels.join(changed.select("node"), "node", "left_anti").unionByName(changed))
    return labels


register("g01_folded_components", "lineitem", _folded, """with e as (select distinct l_partkey as a, l_partkey + 1 + l_linenumber * 3 as b from lineitem where l_quantity >= 49),
links as materialized (select a as src, b as dst from e union select b, a from e),
reach(a, b) as (select src, src from links union select r.a, l.dst from reach r join links l on l.src = r.b)
select a as node, min(b) as component from reach group by 1""")


def _searched(t, p):
    """Needles looked up in an index of vendor names and of contributors."""
    base, out = _folder(t), None
    for name, column, needles in (("vendor", "name", ("widget", "GADGET 1", "co", "%ring%inc", "nowhere")), ("contribution", "contributor_name", ("ring", "supply"))):
        substring.write_index(t[name], "id", column, f"{base}/{name}")
        for needle in needles:
            hits = substring.search(t[name], "id", column, f"{base}/{name}", needle).select(F.lit(name).alias("kind"), F.lit(needle).alias("needle"), "id")
            out = hits if out is None else out.unionByName(hits)
    return out


_NEEDLES = [("vendor", "name", n) for n in ("widget", "GADGET 1", "co", "%ring%inc", "nowhere")] + [("contribution", "contributor_name", n) for n in ("ring", "supply")]
register("q26_search_indexed", "vendor contribution", _searched, " union all ".join(
    f"select '{k}' as kind, '{n}' as needle, id from {k}_v where {c} ilike '%{n}%'" for k, c, n in _NEEDLES))
