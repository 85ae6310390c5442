"""Queries of the rules that compare names and addresses or walk the vendor graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendwarden.plans import clustering, crossref, duplicates, employee_match, network, related, screening

from spendwarden.session import cut

from .registry import P, register
from .sqltext import names_cte, norm_line, norm_name, norm_parts, pairs_cte, ratio_sql

MEMBERS = f"""
{names_cte('nm', 'vendor_v', 'name_normalized')},
addr as materialized (select id as vendor_id, {norm_parts('address', 'city', 'state', 'zip_code')} as address, name_normalized as name
  from vendor_v where length(address) > 0),
grp as (select address, count(*) as vendors, min(vendor_id) as lo, max(vendor_id) as hi from addr group by 1 having count(*) > 1),
two as (select g.address from grp g join addr p on p.vendor_id = g.lo join addr q on q.vendor_id = g.hi join nm a on a.name = p.name
  join nm b on b.name = q.name where g.vendors = 2 and {ratio_sql('a', 'b')} > 90),
members as materialized (select a.address, a.vendor_id, g.vendors from addr a join grp g on g.address = a.address
  where a.address not in (select address from two))"""

PAIRS = f"""
{pairs_cte('half', 'nm', 'nm', 85, 'a.name < b.name and ')},
pr as (select * from half union all select right_name, left_name, score from half union all select name, name, 100.0 from nm),
rel_name as materialized (select distinct least(v.id, w.id) as vendor_id_1, greatest(v.id, w.id) as vendor_id_2, 'similar_name' as relationship_type, b.score / 100 as confidence_score
  from pr b join vendor_v v on v.name_normalized = b.left_name join vendor_v w on w.name_normalized = b.right_name
  where b.left_name <> b.right_name),
rel_seq as materialized (select least(v.id, w.id) as vendor_id_1, greatest(v.id, w.id) as vendor_id_2, 'sequential_id' as relationship_type,
  {ratio_sql('a', 'b')} / 100 as confidence_score, v.id as first_vendor
  from vendor_v v join vendor_v w on cast(w.vendor_id as bigint) = cast(v.vendor_id as bigint) + 1
  join nm a on a.name = v.name_normalized join nm b on b.name = w.name_normalized where {ratio_sql('a', 'b')} >= 70),
pairs as (select * from rel_name union all select vendor_id_1, vendor_id_2, relationship_type, confidence_score from rel_seq)"""

EDGES = """
edges as materialized (select coalesce(p.vendor_id, c.vendor_id) as vendor_id, coalesce(p.agency_id, c.agency_id) as agency_id,
  coalesce(p.n, 0) as payment_count, coalesce(p.s, 0) as payment_total, coalesce(c.n, 0) as contract_count, coalesce(c.s, 0) as contract_value
  from (select vendor_id, agency_id, count(*) as n, sum(amount) as s from payment_v where vendor_id is not null and agency_id is not null group by 1, 2) p
  full join (select vendor_id, agency_id, count(*) as n, sum(current_value) as s from contract_v where vendor_id is not null and agency_id is not null
             group by 1, 2) c on c.vendor_id = p.vendor_id and c.agency_id = p.agency_id)"""

# links: every linked pair in both directions; reach: all nodes reachable
REACH = """
reach(a, b) as (select src, src from links union select r.a, l.dst from reach r join links l on l.src = r.b),
label as materialized (select a as vendor_id, min(b) as component from reach group by 1)"""
LINKS = """
one_way as materialized (select vendor_id_1 as src, vendor_id_2 as dst from pairs union
  select m.vendor_id, n.vendor_id from members m join members n on n.address = m.address and m.vendor_id < n.vendor_id),
links as materialized (select src, dst from one_way union select dst, src from one_way)"""


def _pairs(t):
    return cut(clustering.sequential_relationships(t, P).drop("first_vendor"))


def _graph(t):
    return cut(clustering.name_graph(t, P))


def _members(t):
    return cut(clustering.address_members(t))


register("d06_related_vendor_duplicates", "vendor payment", lambda t, p: duplicates.related_vendor_duplicates(t, p.but(duplicate_payment_window_days=60), _members(t)),
         f"""with {MEMBERS},
pay as (select m.address, m.vendor_id, p.amount, p.payment_date, p.id from members m join payment_v p on p.vendor_id = m.vendor_id where p.amount >= 1000),
mine as (select distinct address, vendor_id, amount, payment_date from pay)
select 'related_vendor_duplicate' as alert_type, 'medium' as severity, 'vendor' as entity_type, a.vendor_id as entity_id, max(b.vendor_id) as related_vendor_id,
       cast(a.amount as double) as amount, a.payment_date, a.address as shared_address
from mine a join pay b on b.address = a.address and b.amount = a.amount and b.vendor_id > a.vendor_id
where a.payment_date is null or b.payment_date is null or abs(a.payment_date - b.payment_date) <= 60 group by a.vendor_id, a.amount, a.payment_date, a.address""")
register("d07_address_members", "vendor", lambda t, p: _members(t), f"with {MEMBERS} select * from members")
register("d07_address_clusters", "vendor payment", lambda t, p: clustering.address_clusters(t, p, _members(t)), f"""with {MEMBERS}
select 'vendor_cluster_address' as alert_type, case when n >= 5 or s >= 1000000 then 'high' else 'medium' end as severity, 'vendor' as entity_type, lo as entity_id,
       address, n as vendor_count, cast(s as double) as total_payments
from (select m.address, count(distinct m.vendor_id) as n, min(m.vendor_id) as lo, coalesce(sum(amount), 0) as s from members m
      left join payment_v p on p.vendor_id = m.vendor_id where vendors >= 3 group by 1)""")
register("d07_address_relationships", "vendor", lambda t, p: clustering.address_relationships(_members(t)).drop("evidence"), f"""with {MEMBERS}
select lo as vendor_id_1, vendor_id as vendor_id_2, 'same_address' as relationship_type, 0.8::double as confidence_score
from (select *, min(vendor_id) over (partition by address) as lo from members) where vendor_id > lo""")
_NAMES = f"{names_cte('nm', 'vendor_v', 'name_normalized')}, {PAIRS}"


def _r6(df):
    return df.withColumn("confidence_score", F.round("confidence_score", 6))


register("d08_similar_names", "vendor", lambda t, p: _r6(clustering.name_relationships_of(t, P)), f"""with {_NAMES}
select v.id as vendor_id, b.left_name as name, b.right_name as other_name, count(*) as other_vendors, min(w.id) as first_vendor, 'similar_name' as relationship_type,
       round(b.score / 100, 6) as confidence_score
from pr b join vendor_v v on v.name_normalized = b.left_name join vendor_v w on w.name_normalized = b.right_name where b.left_name <> b.right_name group by 1, 2, 3, b.score""")
register("d08_similar_name_alerts", "vendor", lambda t, p: clustering.similar_name_alerts(t, p), f"""with {_NAMES}
select 'vendor_cluster_name' as alert_type, 'medium' as severity, 'vendor' as entity_type, v.id as entity_id, min(w.id) as related_vendor_id, count(*) as related_vendors,
       v.name as name_1, arg_min(w.name, w.id) as name_2, round(b.score / 100, 4) as similarity
from pr b join vendor_v v on v.name_normalized = b.left_name join vendor_v w on w.name_normalized = b.right_name
where b.left_name <> b.right_name and b.score >= 90 and length(v.address) > 0 and length(w.address) > 0 and {norm_line('v.address')} <> {norm_line('w.address')}
group by v.id, v.name, b.right_name, b.score""")
register("d09_sequential_ids", "vendor", lambda t, p: _r6(clustering.sequential_relationships(t, p).drop("evidence")), f"""with {_NAMES}
select vendor_id_1, vendor_id_2, relationship_type, round(confidence_score, 6) as confidence_score, first_vendor from rel_seq""")
register("d09_sequential_alerts", "vendor", lambda t, p: clustering.sequential_alerts(clustering.sequential_relationships(t, p)), f"""with {_NAMES}
select 'vendor_cluster_sequential' as alert_type, 'low' as severity, 'vendor' as entity_type, first_vendor as entity_id,
       vendor_id_1 + vendor_id_2 - first_vendor as related_vendor_id, round(confidence_score, 4) as similarity from rel_seq where confidence_score >= 0.85""")
register("d10_related_vendors", "vendor", lambda t, p: _r6(clustering.related_to(t, 8, _pairs(t), _members(t), clustering.similar_names_of(t, P, 8))), f"""with {MEMBERS}, {PAIRS},
r as (select vendor_id_2 as id, relationship_type, confidence_score from pairs where vendor_id_1 = 8 union all
      select vendor_id_1, relationship_type, confidence_score from pairs where vendor_id_2 = 8 union all
      select b.vendor_id, 'same_address', 0.8 from members a join members b on a.address = b.address where a.vendor_id = 8 and b.vendor_id <> 8)
select r.id, relationship_type, round(confidence_score::double, 6) as confidence_score, v.vendor_id as vendor_vid, v.name from r join vendor_v v on v.id = r.id""")

register("d20_spending_edges", "payment contract vendor agency", lambda t, p: network.spending_edges(t), f"""with {EDGES}
select vendor_id, agency_id, payment_count, payment_total::double as payment_total, contract_count, contract_value::double as contract_value from edges""")
register("d20_vendor_links", "vendor", lambda t, p: network.linked_vendors(t, _pairs(t), _members(t), None, p), f"""with {MEMBERS}, {PAIRS}
select vendor_id_1 as src, vendor_id_2 as dst from pairs union
select lo, vendor_id from (select *, min(vendor_id) over (partition by address) as lo from members) where vendor_id > lo""")
_HUB = P.but(hub_sigmas=1.0)
_HUB_SQL = f"""with {EDGES},
deg as (select vendor_id, count(*) as d, sum(payment_total) as s from edges group by 1), st as (select avg(d) as m, stddev_pop(d::double) as sd from deg)
select 'hub_vendor' as alert_type, case when d >= m + 2 * sd then 'medium' else 'low' end as severity, 'vendor' as entity_type, deg.vendor_id as entity_id,
       v.name as vendor_name, d as agency_count, s::double as total_value from deg cross join st join vendor_v v on v.id = deg.vendor_id where d > m + sd and d >= 10"""
register("d21_hub_vendors", "payment contract vendor agency", lambda t, p: network.hub_vendors(t, _HUB, network.spending_edges(t)), _HUB_SQL)


def _hub_agencies(t, p):
    e = network.spending_edges(t)
    return network.hub_agencies(e, network.hub_vendors(t, _HUB, e)).drop("contract_count", "contract_value", "payment_count")


register("d21_hub_agencies", "payment contract vendor agency", _hub_agencies, f"""with {EDGES},
deg as (select vendor_id, count(*) as d from edges group by 1), st as (select avg(d) as m, stddev_pop(d::double) as sd from deg)
select vendor_id, agency_id, payment_total::double as payment_total, place from (select e.*, row_number() over (partition by e.vendor_id
  order by payment_total desc, agency_id) as place from edges e join deg using (vendor_id) cross join st where d > m + sd and d >= 10)""")
register("d22_vendor_clusters", "payment contract vendor agency",
         lambda t, p: network.vendor_clusters(t, p, network.spending_edges(t), _pairs(t), _members(t), graph=_graph(t)), f"""with {MEMBERS}, {PAIRS}, {EDGES}, {LINKS}, {REACH},
sz as (select component, count(*) as n from label group by 1 having count(*) between 3 and 20),
ag as (select l.component, sz.n, e.agency_id, count(*) as c, sum(payment_total) as s from label l join sz using (component) join edges e on e.vendor_id = l.vendor_id group by 1, 2, 3)
select 'vendor_cluster' as alert_type, case when n >= 5 and sum(s) >= 1000000 then 'high' else 'medium' end as severity, 'vendor' as entity_type,
       component as entity_id, n as vendor_count, count(*) filter (where c >= 2) as common_agencies, sum(s)::double as total_value
from ag group by component, n having count(*) filter (where c >= 2) > 0""")
register("d23_exclusive", "payment contract vendor agency",
         lambda t, p: network.exclusive_relationships(t, p.but(exclusive_share=0.002), network.spending_edges(t)), f"""with {EDGES}
select 'exclusive_relationship' as alert_type, case when x / total >= 0.95 or x >= 5000000 then 'high' else 'medium' end as severity, 'agency' as entity_type,
       agency_id as entity_id, a.name as agency_name, top as top_vendor_id, x as top_vendor_value, total as total_value, n as vendor_count,
       round(x / total * 100, 1) as top_vendor_share
from (select agency_id, max(payment_total)::double as x, sum(payment_total)::double as total, count(*) as n,
             first(vendor_id order by payment_total desc, vendor_id) as top from edges group by 1) g join agency_v a on a.id = g.agency_id
where total >= 100000 and x / total >= 0.002""")
register("d24_network_stats", "payment contract vendor agency",
         lambda t, p: network.network_stats(t, network.spending_edges(t), _pairs(t), _members(t), None, p), f"""with {MEMBERS}, {PAIRS}, {EDGES},
one_way as materialized (select vendor_id_1 as src, vendor_id_2 as dst from pairs union
  select m.vendor_id, n.vendor_id from members m join members n on n.address = m.address and m.vendor_id < n.vendor_id),
both_kinds as (select src * 2 as src, dst * 2 as dst from one_way union all select vendor_id * 2, agency_id * 2 + 1 from edges),
links as materialized (select src, dst from both_kinds union select dst, src from both_kinds),
{REACH},
c as (select (select count(*) from vendor_v) as v, (select count(*) from agency_v) as a, (select count(*) from edges) as e, (select count(*) from one_way) as l,
      (select count(*) from label) as touched, (select count(distinct component) from label) as parts)
select v + a as total_nodes, e + l as total_edges, v as vendor_count, a as agency_count, (e + 2 * l)::double / v as avg_vendor_degree,
       e::double / a as avg_agency_degree, parts + v + a - touched as connected_components from c""")

_RAW = """(select v.address, v.city, v.state, count(*) as n, min(v.id) as lo, coalesce(sum(p.s), 0) as ps, coalesce(sum(c.s), 0) as cs from vendor_v v
  left join (select vendor_id, sum(amount) as s from payment_v group by 1) p on p.vendor_id = v.id
  left join (select vendor_id, sum(current_value) as s from contract_v group by 1) c on c.vendor_id = v.id
  where v.address is not null and v.address <> '' and v.city is not null group by 1, 2, 3 having count(*) >= 3)"""
register("d25_raw_address_clusters", "vendor payment contract", crossref.raw_address_clusters, f"""
select 'address_cluster' as alert_type, case when ps + cs > 1000000 then 'high' when ps + cs > 100000 then 'medium' else 'low' end as severity, 'vendor' as entity_type,
       lo as entity_id, address, city, state, n as vendor_count, ps::double as total_payments, cs::double as total_contracts from {_RAW}""")
register("d25_raw_address_vendors", "vendor payment contract", lambda t, p: crossref.raw_address_vendors(t, crossref.raw_address_clusters(t, p)), f"""
select address, city, state, place, id, vendor_id, name from (select v.*, row_number() over (partition by v.address, v.city, v.state order by v.id) as place
from vendor_v v join {_RAW} g on g.address = v.address and g.city = v.city and g.state = v.state)""")
register("d26_employee_vendor_scan", "employee vendor", crossref.employee_vendor_scan, f"""with
listed as (select * from vendor_v where in_cmbl or risk_score is not null),
{names_cte('en', 'employee_v', 'name_normalized')}, {names_cte('vn', 'listed', 'name_normalized')}, {pairs_cte('pr', 'en', 'vn', 90)}
select e.id as employee_id, v.id as vendor_id, round(score / 100, 4) as confidence, score >= 95 as alerting
from pr join employee_v e on e.name_normalized = left_name join listed v on v.name_normalized = right_name""")
_GIFTS = """gifts as materialized (select contributor_normalized as name, sum(contribution_amount) as s, count(distinct filer_name) as r from contribution_v
  where contribution_amount >= 500 and contributor_normalized is not null group by 1 having sum(contribution_amount) >= 5000)"""
_PLAY = f"""{_GIFTS}, {names_cte('gn', 'gifts', 'name')}, {names_cte('vn', 'vendor_v', 'name_normalized')}, {pairs_cte('pr', 'gn', 'vn', 90)}"""
register("d27_pay_to_play", "contribution vendor payment contract", crossref.pay_to_play, f"""with {_PLAY},
m as (select g.name, g.s, g.r, b.score, v.id as vid from pr b join gifts g on g.name = b.left_name join vendor_v v on v.name_normalized = b.right_name),
x as (select m.*, coalesce((select sum(amount) from payment_v p where p.vendor_id = vid), 0) as ps, coalesce((select sum(current_value) from contract_v c where c.vendor_id = vid), 0) as cs from m)
select 'pay_to_play' as alert_type, case when (ps + cs)::double / s::double > 100 then 'high' when (ps + cs)::double / s::double > 10 then 'medium' else 'low' end as severity,
       'vendor' as entity_type, vid as entity_id, name as contributor_name, s::double as total_contributions, r as recipients, ps::double as vendor_payments,
       cs::double as vendor_contracts, round(score, 2) as match_score, round((ps + cs)::double / s::double, 4) as roi from x""")
register("d27_contribution_recipients", "contribution vendor payment contract",
         lambda t, p: crossref.contribution_recipients(t, p, crossref.pay_to_play(t, p)), f"""with {_PLAY}
select name as contributor_name, filer_name, place from (select contributor_normalized as name, filer_name, row_number() over (partition by contributor_normalized order by filer_name) as place
from (select distinct contributor_normalized, filer_name from contribution_v where contribution_amount >= 500 and contributor_normalized in (select left_name from pr)))""")
register("d28_unregistered_vendors", "vendor payment tax_permit", crossref.unregistered_vendors, f"""with
sus as materialized (select v.id, v.name, v.name_normalized, sum(amount) as s from vendor_v v join payment_v p on p.vendor_id = v.id where not in_cmbl and state = 'TX'
  group by 1, 2, 3 having sum(amount) >= 10000),
{names_cte('sn', 'sus', 'name_normalized')}, {names_cte('tn', 'tax_permit_v', 'taxpayer_normalized')}, {pairs_cte('pr', 'sn', 'tn', 90)}
select 'ghost_vendor' as alert_type, case when s > 100000 then 'high' when s > 25000 then 'medium' else 'low' end as severity, 'vendor' as entity_type, id as entity_id,
       name as vendor_name, s::double as total_payments from sus where name_normalized not in (select left_name from pr)""")
_EMP = f"""{names_cte('en', 'employee_v', 'name_normalized')}, {names_cte('vn', 'vendor_v', 'name_normalized')}, {pairs_cte('be', 'en', 'vn', 90)},
pd as materialized (select vendor_id, count(*) as n, sum(amount) as s, max(payment_date) as d from payment_v where vendor_id is not null group by 1 having sum(amount) <> 0),
em as materialized (select e.id as employee_id, e.name as employee_name, min(h.id) as vendor_id, count(*) as vendors, be.score, sum(pd.n)::bigint as n, sum(pd.s) as s, max(pd.d) as d
  from be join employee_v e on e.name_normalized = be.left_name join vendor_v h on h.name_normalized = be.right_name join pd on pd.vendor_id = h.id group by e.id, e.name, be.right_name, be.score)"""
register("d30_employee_vendor_names", "employee vendor payment", lambda t, p: employee_match.name_alerts(employee_match.name_matches(t, p)), f"""with {_EMP}
select 'employee_vendor_match' as alert_type, case when score >= 98 or (score >= 95 and s >= 100000) then 'high' else 'medium' end as severity, 'employee' as entity_type,
       employee_id as entity_id, employee_name, vendor_id, vendors, round(score / 100, 4) as name_similarity, n as payment_count, s::double as total_payments, d as last_payment from em""")
_SIDES = f"""
ea as (select id, json_extract_string(raw_data, '$.address') as a, json_extract_string(raw_data, '$.city') as c, json_extract_string(raw_data, '$.state') as s,
  coalesce(json_extract_string(raw_data, '$.zip'), '') as z from employee_v),
es as materialized (select id, {norm_parts('a', 'c', 's', 'z')} as address from ea where length(a) > 0),
vs as materialized (select id, {norm_parts('address', 'city', 'state', 'zip_code')} as address from vendor_v where length(address) > 0)"""
register("d31_address_sides", "employee vendor", lambda t, p: employee_match.address_sides(t), f"""with {_SIDES}
select address, 'employee' as side, id from es where address in (select address from vs) union all select address, 'vendor', id from vs where address in (select address from es)""")
register("d31_employee_vendor_addresses", "employee vendor payment", lambda t, p: employee_match.address_alerts(t, employee_match.address_sides(t)), f"""with {_SIDES}
select 'employee_vendor_address_match' as alert_type, 'high' as severity, 'employee' as entity_type, es.id as entity_id, min(vs.id) as vendor_id, es.address as shared_address,
       count(*) as vendors, sum(p.n)::bigint as payment_count, sum(p.s)::double as total_payments
from es join vs on vs.address = es.address join (select vendor_id, count(*) as n, sum(amount) as s from payment_v group by 1 having sum(amount) <> 0) p on p.vendor_id = vs.id
group by es.id, es.address""")


def _entity_network(t, p):
    matches = employee_match.entity_match_rows(employee_match.name_matches(t, p, NETWORK_OF), employee_match.address_sides(t))
    return crossref.entity_network(t, NETWORK_OF, matches, t["alert"]).withColumn("score", F.round("score", 4))


NETWORK_OF = 8
register("d29_entity_network", "vendor contract employee payment alert", _entity_network, f"""with {_EMP}, {_SIDES}, {names_cte('nm', 'vendor_v', 'name_normalized')},
near as (select w.* from vendor_v v join vendor_v w on w.address = v.address and w.city = v.city and w.id <> v.id where v.id = {NETWORK_OF}),
seat as (select address, min(id) as id from vs group by 1)
select 'same_address' as kind, id, name as label, null::double as score from near union all
select 'similar_name', w.id, w.name, round({ratio_sql('a', 'b')}, 4) from vendor_v v join nm a on a.name = v.name_normalized cross join nm b join vendor_v w on w.name_normalized = b.name
  where v.id = {NETWORK_OF} and w.id <> {NETWORK_OF} and {ratio_sql('a', 'b')} >= 85 and {ratio_sql('a', 'b')} < 100 union all
select 'contract', id, contract_number, null from contract_v where vendor_id = {NETWORK_OF} union all
select 'risk', count(*), 'Shares address with ' || count(*) || ' other vendors', null from near having count(*) >= 2 union all
select 'employee', employee_id, employee_name, round(score / 100, 4) from em where vendor_id = {NETWORK_OF} union all
select 'employee', e.id, e.name, 0.85 from seat join es on es.address = seat.address join employee_v e on e.id = es.id where seat.id = {NETWORK_OF} union all
select 'alert', id, upper(severity) || ': ' || title, null from alert_v where entity_type = 'vendor' and entity_id = {NETWORK_OF}""")

register("d38_related_party_networks", "vendor payment entity_match",
         lambda t, p: related.related_party_networks(t, p, _pairs(t), _members(t), t["entity_match"], None, _graph(t)), f"""with {MEMBERS}, {PAIRS},
all_pairs as materialized (select vendor_id_1 as src, vendor_id_2 as dst, relationship_type as kind from pairs union all
  select m.vendor_id, n.vendor_id, 'same_address' from members m join members n on n.address = m.address and m.vendor_id < n.vendor_id union all
  select entity_id_1, entity_id_2, 'match ' || match_type from entity_match_v),
links as materialized (select src, dst from all_pairs union select dst, src from all_pairs), {REACH},
k as (select component, count(distinct kind) as kinds, count(*) as rels from all_pairs join label on label.vendor_id = src group by 1),
z as (select component, count(*) as n, coalesce(sum(s), 0) as s from label left join (select vendor_id, sum(amount) as s from payment_v group by 1) p using (vendor_id) group by 1)
select 'related_party_network' as alert_type, case when n >= 5 or s >= 2000000 or kinds >= 3 then 'high' else 'medium' end as severity, 'vendor' as entity_type,
       component as entity_id, n as network_size, s::double as total_value, kinds, rels as relationship_count from z join k using (component) where n >= 3 and s >= 500000""")
_RICH = f"""paidv as materialized (select v.id, v.name_normalized, p.s, p.n from vendor_v v join (select vendor_id, sum(amount) as s, count(*) as n from payment_v group by 1 having sum(amount) <> 0) p
  on p.vendor_id = v.id),
{names_cte('pn', 'paidv', 'name_normalized')}, {names_cte('cn', 'contribution_v', 'contributor_normalized')}, {pairs_cte('bc', 'pn', 'cn', 80)},
rich as materialized (select v.id as vendor_id, any_value(v.s) as s, any_value(v.n) as n, sum(c.contribution_amount) as given, count(*) as gifts from bc
  join paidv v on v.name_normalized = bc.left_name join contribution_v c on c.contributor_normalized = bc.right_name group by 1)"""


def _triangles(t, p):
    return related.contributor_triangles(t, p, employee_match.name_matches(t, p), employee_match.address_sides(t))


_TRI = f"""with {_EMP}, {_SIDES}, {_RICH},
tri as (select employee_id, vendor_id, 'name' as match_type from em union all
  select id, vendor_id, 'address' from (select es.id, r.vendor_id, row_number() over (partition by es.id order by r.s desc, r.vendor_id desc) as rn
    from es join vs on vs.address = es.address join rich r on r.vendor_id = vs.id) where rn = 1)"""
register("d39_triangles", "employee vendor payment contribution", _triangles, _TRI + """
select 'employee_vendor_contributor_triangle' as alert_type, case when given >= 10000 or s >= 500000 then 'high' else 'medium' end as severity, 'employee' as entity_type,
       employee_id as entity_id, vendor_id, match_type, s::double as vendor_payments, n as payment_count, gifts as contribution_count, given::double as total_contributions
from tri join rich using (vendor_id)""")
register("d39_triangle_recipients", "employee vendor payment contribution", lambda t, p: related.triangle_recipients(t, p, _triangles(t, p)), _TRI + """
select vendor_id, filer_name, amount, place from (select v.id as vendor_id, filer_name, sum(contribution_amount)::double as amount,
  row_number() over (partition by v.id order by sum(contribution_amount) desc, filer_name) as place
  from paidv v join bc on bc.left_name = v.name_normalized join contribution_v c on c.contributor_normalized = bc.right_name
  where v.id in (select vendor_id from tri join rich using (vendor_id)) group by 1, 2)""")
def _circular(t, p, edges):
    return related.circular_patterns(t, p, edges, _pairs(t), _members(t), circles=related.name_circles(t, p, edges))


register("d40_circular_patterns", "vendor payment contract agency",
         lambda t, p: _circular(t, p, cut(network.spending_edges(t))), f"""with {MEMBERS}, {PAIRS}, {EDGES},
pe as (select vendor_id, agency_id, payment_total as s from edges where payment_count > 0),
x as (select p.vendor_id_1 as entity_id, p.vendor_id_2 as related_vendor_id, relationship_type, count(*) as c, sum(a.s) as t1, sum(b.s) as t2 from rel_seq p
  join pe a on a.vendor_id = p.vendor_id_1 join pe b on b.vendor_id = p.vendor_id_2 and b.agency_id = a.agency_id where confidence_score >= 0.7 group by 1, 2, 3
  union all select id, min(lo), 'similar_name', count(*), sum(s), sum(o) from (
    select v.id, n.right_name, a.agency_id, a.s, min(w.id) as lo, sum(b.s) as o from pr n join vendor_v v on v.name_normalized = n.left_name join vendor_v w on w.name_normalized = n.right_name
    join pe a on a.vendor_id = v.id join pe b on b.vendor_id = w.id and b.agency_id = a.agency_id where n.left_name <> n.right_name group by 1, 2, 3, 4) group by id, right_name
  union all select vendor_id, null, 'same_address', count(*), sum(s), sum(o) from (
    select m.vendor_id, m.address, a.agency_id, a.s, sum(b.s) as o from members m join pe a on a.vendor_id = m.vendor_id
    join members n on n.address = m.address and n.vendor_id <> m.vendor_id join pe b on b.vendor_id = n.vendor_id and b.agency_id = a.agency_id group by 1, 2, 3, 4) group by 1, address)
select 'circular_payment_pattern' as alert_type, case when c >= 3 or t1 + t2 >= 1000000 then 'high' else 'medium' end as severity, 'vendor' as entity_type, entity_id,
       related_vendor_id, relationship_type, c as common_agencies, t1::double as total_1, t2::double as total_2 from x where t1 >= 50000 and t2 >= 50000""")

_SCREEN = f"""paid as (select vendor_id, sum(amount) as s from payment_v where vendor_id is not null group by 1 having sum(amount) >= 1000),
vv as materialized (select v.id as vendor_id, v.name_normalized as vname, {norm_name('v.address')} as vaddr, s from vendor_v v join paid on paid.vendor_id = v.id),
xx as materialized (select id as x_id, name_normalized as xname, {norm_name('address')} as xaddr from debarred_v where is_active),
nx as materialized (select xname, count(*) as exclusions, min(x_id) as exclusion_id from xx group by 1),
rest as materialized (select * from vv where vname not in (select xname from nx)),
{names_cte('ln', 'rest', 'vname')}, {names_cte('rn', 'nx', 'xname')}, {pairs_cte('pr', 'ln', 'rn', 90)},
bn as materialized (select vendor_id, 'exact_name' as match_type, xname as matched, 1.0::double as score, exclusions, exclusion_id, s from vv join nx on xname = vname
  union all select vendor_id, 'fuzzy_name', xname, score / 100, exclusions, exclusion_id, s from pr join rest on vname = left_name join nx on xname = right_name),
allm as (select * from bn union all
  select v.vendor_id, 'address', x.xaddr, 0.85, count(*), (select min(x_id) from xx y where y.xaddr = x.xaddr), v.s from vv v join xx x on x.xaddr = v.vaddr
  where not exists (select 1 from bn b where b.vendor_id = v.vendor_id and b.matched = x.xname) group by v.vendor_id, x.xaddr, v.s)"""
register("d41_debarred_vendors", "vendor payment debarred", screening.debarred_vendors, f"""with {_SCREEN}
select 'debarred_vendor' as alert_type, case when match_type = 'exact_name' or score >= 0.95 then 'high' when score >= 0.9 then 'medium' else 'low' end as severity,
       'vendor' as entity_type, vendor_id as entity_id, match_type, matched, exclusion_id, exclusions, round(score, 4) as match_score, s::double as total_payments from allm""")
register("d41_largest_payments", "vendor payment debarred", lambda t, p: screening.largest_payments(t, screening.debarred_vendors(t, p)), f"""with {_SCREEN}
select vendor_id, place, id, amount::double as amount, payment_date, agency_id from (select p.*, row_number() over (partition by vendor_id order by amount desc, id) as place
from payment_v p where vendor_id in (select vendor_id from allm))""")


def _screen_sql(name_sql: str, cutoff: float) -> str:
    return f"""with who as (select {name_sql} as name),
{names_cte('a1', 'who', 'name')}, {names_cte('b1', 'debarred_v', 'name_normalized')}
select d.id as exclusion_id, entity_name, source, sam_number, case when a.name = b.name then 'exact' else 'fuzzy' end as match_type,
       round({ratio_sql('a', 'b')} / 100, 4) as score, exclusion_type
from a1 a cross join b1 b join debarred_v d on d.name_normalized = b.name where is_active and {ratio_sql('a', 'b')} >= {cutoff}"""


register("d42_screen_vendor", "vendor debarred", lambda t, p: screening.screen_vendor(t, 28, 0.60),
         _screen_sql("(select name_normalized from vendor_v where id = 28)", 60))
register("d43_exclusion_stats", "debarred alert", lambda t, p: screening.exclusion_stats(t, t["alert"]), """
select 'total' as item, count(*) as n from debarred_v union all select 'active', count(*) from debarred_v where is_active union all
select 'source ' || source, count(*) from debarred_v group by source union all select 'alerts', count(*) from alert_v where alert_type = 'debarred_vendor'""")
register("d44_screen_name", "debarred", lambda t, p: screening.screen_name(t, "The Excluded Party, 50", 0.90), _screen_sql("'EXCLUDED PARTY 50'", 90))
