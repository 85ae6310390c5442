"""Canonical audit tables derived from the driver tables.

One SQL text per view serves both engines: Spark reads it with the base tables as DataFrames, the SQL checks use
it as leading CTEs. Every view covers all rows of its base tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages",
        "conversations")

VIEWS: dict[str, str] = {}

VIEWS["agency"] = """
select cast(n_nationkey as bigint) as id, concat('A', cast(n_nationkey as string)) as agency_code,
       concat('AGENCY ', n_name) as name, concat('CATEGORY ', cast(n_regionkey as string)) as category
from {nation}
"""

VIEWS["vbase"] = """
select c_custkey as id,
       c_custkey - (case when c_custkey % 10 = 9 then 1 when c_custkey % 50 = 7 then 1 else 0 end) as nk,
       c_custkey % 10 = 9 as twin, c_nationkey, c_mktsegment, c_acctbal,
       (select count(*) from {part}) as parts
from {customer}
"""

VIEWS["vendor"] = """
select b.id, case when b.id % 7 = 0 then null else cast(1000000 + b.id as string) end as vendor_id,
       concat(w1.p_name, ' ', w2.p_name, ' ', cast(b.nk as string), case when b.twin then 's, Inc' else ' Inc' end) as name,
       concat(upper(w1.p_name), ' ', upper(w2.p_name), ' ', cast(b.nk as string),
              case when b.twin then 'S INC' else ' INC' end) as name_normalized,
       case when b.id % 11 = 0 then null
            when b.id % 13 = 0 then concat('P.O. Box ', cast(b.id % 5 as string))
            when b.id % 53 = 0 then 'N/A'
            else concat(cast(b.id % 31 as string), ' ', split_part(w1.p_name, ' ', 2), ' Street') end as address,
       case when b.id % 17 = 0 then null else concat('City ', cast(b.c_nationkey as string)) end as city,
       case when b.c_nationkey % 2 = 0 then 'TX' else 'OK' end as state,
       case when b.id % 19 = 0 then null else cast(70000 + b.c_nationkey as string) end as zip_code,
       case when b.id % 6 = 0 then null else concat('555-', cast(1000 + b.id as string)) end as phone,
       case when b.id % 5 = 0 then 'X' when b.id % 5 = 1 then 'BLF' when b.id % 5 = 2 then 'WOF, HIF'
            when b.id % 5 = 3 then null else b.c_mktsegment end as hub_status,
       case when b.id % 4 = 0 then null when b.id % 4 = 1 then date '2001-01-15' else date '1997-03-01' end as first_seen,
       case when b.id % 9 = 0 then cast(b.id % 101 as int) else null end as risk_score,
       b.id % 3 <> 0 as in_cmbl,
       concat('{{"ELIGIBILITY CODE": "', case when b.id % 2 = 0 then 'BL' else 'WO' end, '"}}') as raw_data
from {vbase} b join {part} w1 on w1.p_partkey = (b.nk * 7) % b.parts
     join {part} w2 on w2.p_partkey = (b.nk * 13 + cast(floor(b.nk / 200) as bigint) * 17 + 5) % b.parts
"""

VIEWS["payment"] = """
select ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey as id,
       case when l_partkey % 101 = 0 then null else o_custkey end as vendor_id,
       case when l_suppkey % 29 = 0 then null else l_suppkey % 25 end as agency_id,
       cast(floor(l_extendedprice / 5000) * 5000 as decimal(15,2)) as amount,
       case when l_partkey % 97 = 0 then null else cast(l_shipdate as date) end as payment_date,
       (l_returnflag = 'R' and l_suppkey % 3 = 0) as is_confidential,
       concat('ship ', l_linestatus) as description, 'state' as source_system
from {lineitem} join {orders} on l_orderkey = o_orderkey
"""

VIEWS["contract"] = """
select o_orderkey as id, concat('C-', cast(o_orderkey as string)) as contract_number,
       o_custkey as vendor_id, case when o_orderkey % 23 = 0 then null else o_orderkey % 5 end as agency_id,
       concat(o_orderpriority, ' work for ', cast(o_custkey as string)) as description,
       cast(floor(o_totalprice / 10) as decimal(15,2)) as current_value,
       case when o_orderkey % 31 = 0 then null else cast(floor(o_totalprice * 2) as decimal(15,2)) end as max_value,
       cast(o_orderdate as date) as start_date,
       case when o_orderkey % 37 = 0 then null
            else cast(o_orderdate as date) + cast(o_orderkey % 2500 as int) end as end_date,
       o_orderstatus as source
from {orders}
"""

VIEWS["employee"] = """
select id, id % 25 as agency_id, concat('Worker ', name) as name,
       case when id % 20 = 0 then name_normalized when id % 20 = 4 then concat(name_normalized, 'X')
            when id % 20 = 8 then concat('THE ', name_normalized)
            else concat('EMPLOYEE ', cast(id as string)) end as name_normalized,
       concat('Grade ', cast(id % 4 as string)) as job_title,
       cast(30000 + (id * 37) % 90000 as decimal(15,2)) as annual_salary,
       case when id % 15 = 0 and address is not null
            then concat('{{"address": "', address, '", "city": "', coalesce(city, ''), '", "state": "', state, '", "zip": "',
                        coalesce(zip_code, ''), '"}}')
            when id % 15 = 1 then null
            else concat('{{"address": "', cast(id as string), ' Home Lane", "city": "Staffville", "state": "TX"}}')
            end as raw_data
from {vendor}
"""

VIEWS["contribution"] = """
select e.event_id as id, concat('FILER ', cast(e.event_id % 7 as string)) as filer_name,
       v.name as contributor_name,
       case when e.user_id % 4 = 0 then concat(v.name_normalized, 'ORP') else v.name_normalized end as contributor_normalized,
       cast(floor(e.value * 10) as decimal(15,2)) as contribution_amount, cast(e.ts as date) as contribution_date
from {events} e join {vendor} v on v.id = e.user_id where e.event_type = 'purchase'
"""

VIEWS["tax_permit"] = """
select id, case when id % 2 = 0 then name_normalized else concat('PERMIT ', cast(id as string), ' HOLDER') end as taxpayer_normalized,
       'sales' as permit_type
from {vendor}
"""

VIEWS["debarred"] = """
select s.s_suppkey as id, case when s.s_suppkey % 4 = 0 then 'STATE' else 'SAM' end as source,
       concat('SAM', cast(s.s_suppkey as string)) as sam_number, v.name as entity_name,
       case when s.s_suppkey % 3 = 0 then v.name_normalized
            when s.s_suppkey % 3 = 1 then concat(substr(v.name_normalized, 1, length(v.name_normalized) - 4), ' LLC')
            else concat('EXCLUDED PARTY ', cast(s.s_suppkey as string)) end as name_normalized,
       v.address as address, s.s_acctbal >= 0 as is_active, 'Ineligible' as exclusion_type
from {supplier} s join {vendor} v on v.id = s.s_suppkey
"""

VIEWS["entity_match"] = """
select 'vendor' as entity_type_1, nk as entity_id_1, 'vendor' as entity_type_2, id as entity_id_2, 'twin' as match_type,
       cast(0.99 as double) as confidence_score
from {vbase} where nk <> id
"""

VIEWS["alert"] = """
select o_orderkey as id,
       case when o_orderpriority = '1-URGENT' then 'duplicate_payment' when o_orderpriority = '2-HIGH' then 'contract_splitting'
            when o_orderpriority = '3-MEDIUM' then 'debarred_vendor' when o_orderpriority = '5-LOW' then 'vendor_cluster_name'
            else 'ghost_vendor' end as alert_type,
       case when o_totalprice >= 400000 then 'high' when o_totalprice >= 200000 then 'medium' else 'low' end as severity,
       concat('Alert ', cast(o_orderkey as string)) as title, concat('About vendor ', cast(o_custkey as string)) as description,
       case when o_custkey % 10 = 0 then 'agency' else 'vendor' end as entity_type,
       case when o_orderkey % 41 = 0 then null else o_custkey end as entity_id,
       concat('{{"vendor_name": "V', cast(o_custkey as string), '", "agency_id": ', cast(o_custkey % 25 as string),
              ', "total_value": ', cast(cast(floor(o_totalprice) as bigint) as string), ', "agency_name": "AGENCY ',
              cast(o_custkey % 25 as string), '"}}') as evidence,
       case when o_orderstatus = 'F' then 'resolved' when o_orderkey % 6 = 1 then 'false_positive'
            when o_orderstatus = 'P' then 'acknowledged' else 'new' end as status,
       cast(o_orderdate as timestamp) as created_at
from {orders}
"""

VIEWS["sync_status"] = """
select concat('source_', cast(l_linenumber as string)) as source_name, cast(l_shipdate as timestamp) as started_at,
       cast(l_orderkey * 100000 + l_partkey as bigint) as run_id,
       case when l_returnflag = 'N' then 'failed' when l_returnflag = 'A' then 'success' else 'in_progress' end as status,
       cast(case when l_linenumber = 3 then 0 else l_quantity end as bigint) as records_synced
from {lineitem}
"""

VIEWS["pia_request"] = """
select o_orderkey as id, o_orderkey % 25 as agency_id, concat('Request ', cast(o_orderkey as string)) as subject,
       case when o_orderstatus = 'O' then 'draft' when o_orderstatus = 'P' then 'pending' else 'received' end as status,
       cast(o_orderdate as date) as submitted_date, cast(o_orderdate as date) + 14 as due_date, o_orderkey as related_alert_id
from {orders}
"""

VIEWS["grant"] = """
select o_orderkey as id, o_orderkey % 25 as agency_id, o_custkey as recipient_id,
       cast(floor(o_totalprice) as decimal(15,2)) as amount_awarded, cast(year(o_orderdate) as int) as fiscal_year,
       concat('TYPE ', o_orderstatus) as program_name, concat('AWARD TO ', cast(o_custkey as string)) as description,
       cast(o_orderdate as date) as start_date
from {orders}
"""

_ISO = "cast(cast({d} as date) as string)"
_US = "(cast(month({d}) as string) || '/' || cast(day({d}) as string) || '/' || cast(year({d}) as string))"


def _iso(d: str) -> str:
    return _ISO.replace("{d}", d)


def _us(d: str) -> str:
    return _US.replace("{d}", d)


# Landed files: text columns under the names the sources use.
VIEWS["land_vendor"] = """
select id as _pos, case when id % 2 = 0 then coalesce(vendor_id, '') else '' end as WEB_VID, case when id % 2 = 1 then concat(' ', vendor_id) end as `VENDOR ID NUMBER`,
       name as WEB_NAME_VENDOR_NAME, address as WEB_ADDR1, city as WEB_CITY, lower(state) as STATE, zip_code as `ZIP CODE`, phone as WEB_PHONE, hub_status as `STATUS CODE`
from {vendor}
"""
VIEWS["land_class"] = """
select l_orderkey * 10 + l_linenumber as _pos, cast(1000000 + l_suppkey as string) as CLASS_VID, concat(cast(l_linenumber as string), l_returnflag) as CLASS_CODE from {lineitem}
"""
VIEWS["land_spending"] = """
select o_orderkey as _pos, case when o_orderkey % 53 = 0 then '0' when o_orderkey % 59 = 0 then 'none' else concat('$', cast(cast(floor(o_totalprice) as bigint) as string)) end as amount,
       case when o_orderkey % 61 = 0 then '' else concat('AGENCY NATION_', cast(o_custkey % 25 as string)) end as agency_name,
       case when o_orderkey % 61 = 0 then '' else cast(o_custkey % 25 as string) end as agency_number, o_orderpriority as major_spending_category
from {orders}
"""
VIEWS["land_payment"] = f"""
select p.id as _pos, concat('$', cast(p.amount as string)) as amount,
       case when p.id % 3 = 0 then {_iso('p.payment_date')} || 'T00:00:00' when p.id % 3 = 1 then {_iso('p.payment_date')} else {_us('p.payment_date')} end as payment_date,
       v.name as payee_name, 'Agency nation ' || cast(p.agency_id as string) as agency_name, cast(p.agency_id as string) as agency_code,
       case when p.is_confidential then 'y' else 'N' end as confidential, cast(cast(floor(p.id / 1000000000) as bigint) as string) as id, p.description as description
from {{payment}} p left join {{vendor}} v on v.id = p.vendor_id
"""
VIEWS["land_contract"] = f"""
select id as _pos, case when id % 3 = 0 then concat('<a href="/c">', contract_number, ' </a>') else concat('C-', cast(id % 9973 as string)) end as `Contract-ID`,
       concat('Vendor ', cast(vendor_id as string)) as `Vendor`, 'Board of Agency ' || cast(agency_id as string) as `Agency`, description as `Subject`,
       concat('$', cast(current_value as string)) as `Current Contract Value`, case when id % 2 = 0 then {_iso('start_date')} else {_us('start_date')} end as `Award Date`,
       case when id % 2 = 0 then {_iso('end_date')} else {_us('end_date')} end as `Completion Date`,
       case when id % 4 = 0 then '' else concat('915-0', cast(id % 10 as string), ' Paper; 920-4', cast(id % 7 as string), ' Ink') end as `NGIP Codes and Categories`
from {{contract}}
"""
VIEWS["land_sheet"] = f"""
select id as _pos, case when id % 71 = 0 then 'nan' else concat('S-', cast(id % 4999 as string)) end as `Contract Number`, concat('Vendor ', cast(vendor_id as string)) as `Contractor`,
       'nan' as `Agency`, description as `Description`, case when id % 5 = 0 then 'nan' else cast(current_value as string) end as `Contract Value`,
       cast(max_value as string) as `Value`, cast(max_value as string) as `Max Value`, {_us('start_date')} as `Effective Date`, {_us('end_date')} as `Expiration Date`,
       concat('1', cast(id % 10 as string), ', 22') as `NIGP Code`, cast(year(start_date) as string) as `FY`
from {{contract}}
"""
VIEWS["land_award"] = f"""
select id as _pos, concat('FA', cast(id % 11000 as string)) as `Award ID`, concat('Recipient ', cast(recipient_id as string)) as `Recipient Name`,
       concat(cast(cast(amount_awarded as bigint) as string), '.00') as `Award Amount`, case when id % 3 = 0 then 'bad' else '12' end as `Total Outlays`,
       description as `Description`, concat({_iso('start_date')}, ' 00:00') as `Start Date`, concat('Department of Nation ', cast(agency_id as string)) as `Awarding Agency`
from {{grant}}
"""
VIEWS["land_coop"] = f"""
select id as _pos, case when id % 67 = 0 then '' else concat('DIR-', cast(id % 8000 as string)) end as contract_number, concat({_iso('start_date')}, 'T00:00:00') as contract_start,
       {_iso('end_date')} as contract_termination_date, concat('Vendor ', cast(vendor_id as string)) as primary_vendor_name,
       case when id % 5 = 0 then '' else description end as rfo_description, case when id % 7 = 0 then '' else 'IT' end as contract_type,
       case when id % 7 = 0 then '' else source end as contract_subtype
from {{contract}}
"""
VIEWS["land_sales"] = f"""
select id as _pos, 'C-' || cast(vendor_id * 20 as string) as contract_number, case when id % 50 = 0 then '-5' when id % 51 = 0 then 'x' else cast(amount as string) end as purchase_amount,
       'Vendor ' || cast(vendor_id as string) as vendor_name, 'Customer ' || cast(agency_id as string) as customer_name, {_iso('payment_date')} as contract_start_date,
       description as rfo_description
from {{payment}}
"""
VIEWS["land_salary"] = """
select id as _pos, case when id % 3 = 0 then '' else 'Ann' end as `FIRST NAME`, case when id % 3 = 0 then '' else concat('Lee ', cast(id % 400 as string)) end as `LAST NAME`,
       concat('Worker ', cast(id % 300 as string)) as `Name`, concat('A', cast(agency_id % 5 as string)) as `AGENCY`, concat('Dept ', cast(agency_id % 5 as string)) as `AGENCY NAME`, job_title as `CLASS TITLE`,
       concat('$', cast(annual_salary as string)) as `ANNUAL`, case when id % 2 = 0 then '2001-02-03T00:00:00' else '4/5/1999' end as `HIRE DATE`
from {employee}
"""
VIEWS["land_permit"] = """
select id as _pos, case when id % 41 = 0 then '' else taxpayer_normalized end as taxpayer_name, case when id % 10 = 3 then '' else cast(id % 997 as string) end as taxpayer_number,
       concat('Shop ', cast(id as string)) as business_name, cast(null as string) as physical_address, concat(cast(id as string), ' Main') as address,
       case when id % 2 = 0 then 'closed' end as permit_status, '1999-12-31T00:00:00' as first_sale_date
from {tax_permit}
"""
VIEWS["land_gift"] = f"""
select id as _pos, filer_name as `filerName`, case when id % 3 = 0 then contributor_name else '' end as `contributorNameOrganization`, 'Pat' as `contributorNameFirst`,
       concat('Doe', cast(id % 50 as string)) as `contributorNameLast`, concat('$', cast(contribution_amount as string)) as `contributionAmount`,
       case when id % 2 = 0 then replace({_iso('contribution_date')}, '-', '') else {_us('contribution_date')} end as `contributionDate`, '' as `contributorCity`
from {{contribution}}
"""
VIEWS["land_exclusion"] = """
select id as _pos, case when id % 29 = 0 then '' else concat('S4', cast(id % 80 as string)) end as `SAM Number`, case when id % 4 = 0 then '' else entity_name end as `Name`,
       'Dr' as `Prefix`, 'Sam' as `First`, '' as `Middle`, case when id % 8 = 0 then 'Roe' else '' end as `Last`, address as `Address 1`, case when id % 2 = 0 then 'Suite 4' end as `Address 2`,
       '01-JAN-1999' as `Active Date`, case when id % 3 = 0 then '07/30/2001' when id % 3 = 1 then '2001-07-31' else 'Indefinite' end as `Termination Date`, exclusion_type as `Exclusion Type`
from {debarred}
"""
VIEWS["land_exclusion_json"] = """
select id as _pos, concat('J', cast(id % 60 as string)) as `samNumber`,
       named_struct('name', case when id % 4 = 0 then '' else entity_name end, 'firstName', 'Sam', 'lastName', 'Roe') as `exclusionIdentification`,
       named_struct('exclusionType', exclusion_type) as `exclusionDetails`, named_struct('addressLine1', address, 'city', 'X') as `exclusionAddress`,
       named_struct('activeDate', '1999-02-03', 'terminationDate', case when id % 3 = 0 then '2001-07-30' end) as `exclusionActions`
from {debarred}
"""
VIEWS["land_bid"] = f"""
select l_orderkey * 10 + l_linenumber as _pos, case when l_linenumber = 1 then '' else concat('CSJ', cast(l_partkey as string)) end as control_section_job_csj,
       concat('CC', cast(l_partkey as string)) as controlling_project_id_ccsj, case when l_linenumber = 2 then 'Engineer''s Estimate' else v.name end as vendor_name,
       concat('$', cast(cast(l_extendedprice as decimal(15,2)) as string)) as bid_total_amount, concat(cast(l_linenumber as string), '.0') as bid_rank_sequence_number,
       {_iso('l_shipdate')} as project_actual_let_date, l_returnflag as county
from {{lineitem}} join {{vendor}} v on v.id = l_suppkey
"""
VIEWS["land_construction"] = f"""
select id as _pos, cast(id % 5000 as string) as contract_number, case when id % 4 = 0 then '' else cast(id % 3 as string) end as controlling_project_id_ccsj, description as contractor,
       {_iso('start_date')} as date_work_begin, {_iso('end_date')} as date_work_accepted, case when id % 2 = 0 then cast(current_value as string) end as final_contract_amount,
       cast(max_value as string) as original_contract_amount, source as county
from {{contract}}
"""
VIEWS["land_book"] = """
select p_partkey as _pos, cast(p_size as string) as `Class`, p_brand as `Item`, p_name as `Description` from {part}
"""
VIEWS["land_page"] = f"""
select vendor_id as page_id, concat('<html><body><table><tr><td>x</td></tr></table><table class="wide dataTable">',
  '<thead><tr><th> Contract # </th><th>Vendor Name</th><th>Start Date</th></tr></thead><tbody>', rows, '</tbody></table></body></html>') as html
from (select vendor_id, array_join(array_sort(collect_list(concat('<tr><td><a href="/d/', cast(id as string), '"> ', contract_number, ' </a></td><td>Vendor <b>', cast(vendor_id as string),
        '</b></td><td>', {_us('start_date')}, '</td><td>&lt;', source, '&gt;</td></tr><tr><td>short</td></tr>'))), '') as rows from {{contract}} group by vendor_id)
"""

_REF = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def _needs(name: str) -> list[str]:
    return list(dict.fromkeys(_REF.findall(VIEWS[name])))


def closure(names) -> list[str]:
    """The named views and the views under them, in building order."""
    out: list[str] = []

    def visit(n: str) -> None:
        if n in BASE or n in out:
            return
        for d in _needs(n):
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """DataFrames of the named views."""
    order = closure(names)
    base = {d for n in order for d in _needs(n) if d in BASE} | {n for n in names if n in BASE}
    made = {b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in base}
    for n in order:
        made[n] = spark.sql(VIEWS[n], **{d: made[d] for d in _needs(n)})
    return {n: made[n] for n in names}


def ctes(*names: str) -> str:
    """The same views as the head of one SQL statement; names end in _v so that none hides a base table."""
    parts = []
    for n in closure(names):
        text = _REF.sub(lambda m: m.group(1) if m.group(1) in BASE else m.group(1) + "_v", VIEWS[n])
        parts.append(f"{n}_v as ({text.replace('{{', '{').replace('}}', '}').replace('`', chr(34)).replace('named_struct(', 'NAMED(').strip()})")
    return ",\n".join(parts)
