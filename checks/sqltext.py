"""SQL text builders for the checks: the same meaning as the column functions, written for the other engine."""

from __future__ import annotations

from .views import ctes

# Fixed values of the name and address rules, as in the library, spelled for SQL.
_FORMS = [("L\\.L\\.C\\.", "LLC"), ("INC\\.", "INC"), ("INCORPORATED", "INC"), ("CORP\\.", "CORP"), ("CORPORATION", "CORP"),
          ("CO\\.", "CO"), ("COMPANY", "CO"), ("LTD\\.", "LTD"), ("LIMITED", "LTD"), ("L\\.P\\.", "LP"), ("L\\.L\\.P\\.", "LLP"),
          ("P\\.L\\.L\\.C\\.", "PLLC"), ("P\\.C\\.", "PC"), ("D/B/A", "DBA"), ("D\\.B\\.A\\.", "DBA")]
_LONG = {"INTL": "INTERNATIONAL", "INT''L": "INTERNATIONAL", "NATL": "NATIONAL", "NAT''L": "NATIONAL", "SVCS": "SERVICES",
         "SVC": "SERVICE", "MGMT": "MANAGEMENT", "MGT": "MANAGEMENT", "ASSOC": "ASSOCIATES", "ASSN": "ASSOCIATION", "GRP": "GROUP",
         "SYS": "SYSTEMS", "TECH": "TECHNOLOGY", "TECHS": "TECHNOLOGIES", "GOVT": "GOVERNMENT", "GOV": "GOVERNMENT",
         "UNIV": "UNIVERSITY", "HOSP": "HOSPITAL", "MED": "MEDICAL", "CTR": "CENTER", "CNTR": "CENTER"}
_PLACES = {"AVENUE": "AVE", "BOULEVARD": "BLVD", "CIRCLE": "CIR", "COURT": "CT", "DRIVE": "DR", "EXPRESSWAY": "EXPY", "FREEWAY": "FWY",
           "HIGHWAY": "HWY", "LANE": "LN", "PARKWAY": "PKWY", "PLACE": "PL", "ROAD": "RD", "STREET": "ST", "TERRACE": "TER",
           "TRAIL": "TRL", "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW",
           "SOUTHEAST": "SE", "SOUTHWEST": "SW", "APARTMENT": "APT", "BUILDING": "BLDG", "FLOOR": "FL", "SUITE": "STE", "ROOM": "RM",
           "#": "UNIT"}


def _case(var: str, table: dict[str, str]) -> str:
    return f"case {var} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + f" else {var} end"


def norm_name(x: str) -> str:
    t = f"trim(regexp_replace(upper({x}), '\\s+', ' ', 'g'))"
    for form, std in _FORMS:
        t = f"regexp_replace({t}, '\\b{form}\\b', '{std}', 'g')"
    t = f"array_to_string(list_transform(string_split({t}, ' '), lambda w: {_case('w', _LONG)}), ' ')"
    t = f"regexp_replace({t}, '[.,;:!?\"()\\[\\]{{}}]', '', 'g')"
    t = f"regexp_replace({t}, '\\s*&\\s*', ' AND ', 'g')"
    w = f"list_filter(string_split_regex({t}, '\\s+'), lambda w: w <> '')"
    return (f"(select nullif(array_to_string(case when len(ws) > 1 then list_filter(ws, lambda w: w not in "
            f"('THE','OF','AND','&','FOR','A','AN')) else ws end, ' '), '') from (select {w} as ws))")


def norm_street(x: str) -> str:
    t = f"trim(regexp_replace(upper({x}), '\\s+', ' ', 'g'))"
    t = f"replace(array_to_string(list_transform(string_split({t}, ' '), lambda w: {_case('w', _PLACES)}), ' '), '.', '')"
    return f"regexp_replace({t}, '\\bPO\\s*BOX\\b', 'PO BOX', 'g')"


def norm_state(x: str) -> str:
    s = f"lower(trim({x}))"
    return (f"case when length({s}) = 2 then upper({s}) when {s} = 'texas' then 'TX' when {s} = 'oklahoma' then 'OK' "
            f"when {s} = 'new mexico' then 'NM' when {s} = 'arkansas' then 'AR' when {s} = 'louisiana' then 'LA' else left(upper({s}), 2) end")


def norm_parts(a: str, c: str, s: str, z: str) -> str:
    """Joined address where at least the state is known."""
    return (f"concat_ws(' ', nullif({norm_street(f'nullif({a}, {chr(39)*2})')}, ''), nullif(trim(upper({c})), ''), "
            f"nullif({norm_state(f'nullif({s}, {chr(39)*2})')}, ''), nullif(left(regexp_replace({z}, '[^0-9]', '', 'g'), 5), ''))")


def norm_line(a: str) -> str:
    """Joined address of a line that has neither comma, ZIP code nor state (all lines of the derived tables)."""
    t = f"trim(regexp_replace(upper({a}), '\\s+', ' ', 'g'))"
    zipless = f"trim(regexp_replace({t}, '\\b(\\d{{5}})(-\\d{{4}})?\\s*$', ''))"
    state = f"nullif(regexp_extract({zipless}, '\\b([A-Z]{{2}})\\s*$', 1), '')"
    street = f"nullif(trim(regexp_replace({zipless}, '\\b([A-Z]{{2}})\\s*$', '')), '')"
    zip_code = f"nullif(regexp_extract({t}, '\\b(\\d{{5}})(-\\d{{4}})?\\s*$', 1), '')"
    return f"concat_ws(' ', {norm_street(street)}, {state}, {zip_code})"


def names_cte(alias: str, source: str, column: str) -> str:
    """Distinct names with length, letter positions and numbered letters."""
    return f"""
{alias}_c as materialized (select name, length(name) as n, unnest(string_split(name, '')) as c, generate_subscripts(string_split(name, ''), 1) as i
  from (select distinct {column} as name from {source} where length({column}) > 0)),
{alias} as materialized (select name, any_value(n) as n, map_from_entries(list((c, m))) as m, flatten(list(l)) as l
  from (select *, list_transform(range(k), lambda x: c || x::varchar) as l from (
    select name, n, c, cast(sum(cast(1 as bigint) << cast(i - 1 as bigint)) as bigint) as m, count(*) as k from {alias}_c group by all)) group by name)"""


def ratio_sql(a: str, b: str) -> str:
    """Similarity of two rows of names_cte."""
    v = (f"list_reduce(list_transform(string_split({b}.name, ''), lambda c: coalesce({a}.m[c], 0)), "
         f"lambda v, x: ((v + (v & x)) | (v - (v & x))) & ((cast(1 as bigint) << {a}.n) - 1), (cast(1 as bigint) << {a}.n) - 1)")
    return f"200.0::double * ({a}.n - bit_count({v})) / ({a}.n + {b}.n)"


def pairs_cte(out: str, left: str, right: str, cutoff: float, extra: str = "") -> str:
    """All pairs of two names_cte relations that reach the cutoff; letters in common are counted first."""
    return f"""
{out}_near as materialized (select a.name as left_name, b.name as right_name, a.m as m, a.n as n, b.n as bn from {left} a join {right} b
  on {extra}200 * least(a.n, b.n) >= {cutoff} * (a.n + b.n)
  where len(list_intersect(a.l, b.l)) >= ceil({cutoff} * (a.n + b.n) / 200.0 - 1e-9)),
{out} as materialized (select left_name, right_name, score from (
  select a.left_name, a.right_name, {ratio_sql('a', 'b').replace('b.name', 'a.right_name').replace('b.n)', 'a.bn)')} as score from {out}_near a)
  where score >= {cutoff})"""


def statement(views: tuple[str, ...], body: str) -> str:
    """One SQL statement: the views it needs, its own CTEs (body may start with 'with') and the query."""
    body = body.strip()
    head = ctes(*views) if views else ""
    if body.lower().split(None, 1)[0] == "with":
        rest = body[4:].lstrip()
        return f"with recursive {head},\n{rest}" if head else f"with recursive {rest}"
    return f"with recursive {head}\n{body}" if head else body
