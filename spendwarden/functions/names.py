"""Vendor name cleaning."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import let

# Legal-form spellings and the standard form, applied in this order.
LEGAL_FORMS = (
    ("LLC", "LLC"), ("L.L.C.", "LLC"),
    ("INC", "INC"), ("INC.", "INC"), ("INCORPORATED", "INC"),
    ("CORP", "CORP"), ("CORP.", "CORP"), ("CORPORATION", "CORP"),
    ("CO", "CO"), ("CO.", "CO"), ("COMPANY", "CO"),
    ("LTD", "LTD"), ("LTD.", "LTD"), ("LIMITED", "LTD"),
    ("LP", "LP"), ("L.P.", "LP"), ("LLP", "LLP"), ("L.L.P.", "LLP"),
    ("PLLC", "PLLC"), ("P.L.L.C.", "PLLC"), ("PC", "PC"), ("P.C.", "PC"),
    ("DBA", "DBA"), ("D/B/A", "DBA"), ("D.B.A.", "DBA"),
)

# Abbreviations written out.
LONG_FORMS = {
    "INTL": "INTERNATIONAL", "INT'L": "INTERNATIONAL",
    "NATL": "NATIONAL", "NAT'L": "NATIONAL",
    "SVCS": "SERVICES", "SVC": "SERVICE",
    "MGMT": "MANAGEMENT", "MGT": "MANAGEMENT",
    "ASSOC": "ASSOCIATES", "ASSN": "ASSOCIATION",
    "GRP": "GROUP", "SYS": "SYSTEMS",
    "TECH": "TECHNOLOGY", "TECHS": "TECHNOLOGIES",
    "GOVT": "GOVERNMENT", "GOV": "GOVERNMENT",
    "UNIV": "UNIVERSITY", "HOSP": "HOSPITAL", "MED": "MEDICAL",
    "CTR": "CENTER", "CNTR": "CENTER",
}

# Filler words.
FILLERS = ("THE", "OF", "AND", "&", "FOR", "A", "AN")

# Legal forms recognised at the end of a name.
TAIL_FORMS = "LLC|INC|CORP|CO|LTD|LP|LLP|PLLC|PC"


def lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_vendor_name(name: Column, strip_suffix: bool = False, lower: bool = False) -> Column:
    """Match key of a vendor name. Legal forms are kept unless strip_suffix."""
    text = squeeze(F.upper(name))
    changes = [(form, std) for form, std in LEGAL_FORMS if form != std]
    text = reduce(
        lambda c, fs: F.regexp_replace(c, r"(?U)\b" + re.escape(fs[0]) + r"\b", fs[1]), changes, text
    )
    table = lookup(LONG_FORMS)
    text = F.array_join(
        F.transform(F.split(text, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " "
    )
    text = F.regexp_replace(text, r'[.,;:!?"()\[\]{}]', "")
    text = F.regexp_replace(text, r"(?U)\s*&\s*", " AND ")
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    out = let(words, lambda ws: F.array_join(F.when(F.size(ws) > 1, F.filter(ws, lambda w: ~w.isin(*FILLERS))).otherwise(ws), " "))
    if strip_suffix:
        out = F.trim(F.regexp_replace(out, rf"(?:\b(?:{TAIL_FORMS})\s*)+$", ""))
    out = F.nullif(out, F.lit(""))
    return F.lower(out) if lower else out


def name_components(name: Column) -> Column:
    """Struct of base name, legal form at the end and doing-business-as name."""
    dba_at, tail_at = r"(?s)\b(?:DBA|D/B/A|D\.B\.A\.)\s+(.+)$", rf"\b({TAIL_FORMS})\.?\s*$"

    def tail(head: Column, dba: Column) -> Column:
        suffix = F.nullif(F.regexp_extract(head, tail_at, 1), F.lit(""))
        cut_off = F.when(head.rlike(tail_at), F.trim(F.regexp_replace(head, tail_at, ""))).otherwise(head)
        base = F.regexp_replace(cut_off, r"[,.\s]+$", "")
        return F.struct(base.alias("base_name"), suffix.alias("suffix"), dba.alias("dba_name"))

    def split_dba(upper: Column) -> Column:
        found = upper.rlike(dba_at)
        dba = F.when(found, F.trim(F.regexp_extract(upper, dba_at, 1)))
        return let(F.when(found, F.trim(F.regexp_replace(upper, dba_at, ""))).otherwise(upper), lambda h: tail(h, dba))

    return let(F.upper(name), split_dba)


def name_variants(name: Column) -> Column:
    """Array of spellings to look up: as normalised, without legal form, without spaces, with or without THE."""

    def spell(norm: Column) -> Column:
        the = F.when(norm.startswith("THE "), F.substring(norm, 5, 100000)).otherwise(F.concat(F.lit("THE "), norm))
        found = F.array(norm, name_components(norm)["base_name"], F.replace(norm, F.lit(" "), F.lit("")), the)
        return F.when(norm.isNotNull(), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))

    return let(normalize_vendor_name(name), spell)
