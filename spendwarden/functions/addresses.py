"""Address cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import lookup, squeeze
from .scalars import let

# Postal abbreviations of street types.
STREET_TYPES = {
    "AVENUE": "AVE", "BOULEVARD": "BLVD", "CIRCLE": "CIR", "COURT": "CT", "DRIVE": "DR",
    "EXPRESSWAY": "EXPY", "FREEWAY": "FWY", "HIGHWAY": "HWY", "LANE": "LN", "PARKWAY": "PKWY",
    "PLACE": "PL", "ROAD": "RD", "STREET": "ST", "TERRACE": "TER", "TRAIL": "TRL",
}
# Directions.
DIRECTIONS = {
    "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W",
    "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW",
}
# Unit words.
UNIT_TYPES = {
    "APARTMENT": "APT", "BUILDING": "BLDG", "FLOOR": "FL", "SUITE": "STE", "ROOM": "RM", "#": "UNIT",
}
# Spelled-out states.
STATES = {"texas": "TX", "oklahoma": "OK", "new mexico": "NM", "arkansas": "AR", "louisiana": "LA"}

# Address text that deserves a second look.
RED_FLAG_TEXTS = (
    "po box", "p.o. box", "p o box", "pmb", "suite 0", "apt 0", "unit 0",
    "unknown", "n/a", "none", "general delivery",
)


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalize_street(street: Column) -> Column:
    table = lookup({**STREET_TYPES, **DIRECTIONS, **UNIT_TYPES})
    words = F.transform(F.split(squeeze(F.upper(street)), " "), lambda w: F.coalesce(F.try_element_at(table, w), w))
    flat = F.replace(F.array_join(words, " "), F.lit("."), F.lit(""))
    return F.regexp_replace(flat, r"\bPO\s*BOX\b", "PO BOX")


def normalize_state(state: Column) -> Column:
    s = F.lower(F.trim(state))
    return F.when(F.length(s) == 2, F.upper(s)).otherwise(
        F.coalesce(F.try_element_at(lookup(STATES), s), F.left(F.upper(s), F.lit(2)))
    )


def normalize_zip(zip_code: Column) -> Column:
    return F.left(F.regexp_replace(zip_code, r"[^\d]", ""), F.lit(5))


def _assemble(street: Column, city: Column, state: Column, zip_code: Column) -> Column:
    return F.struct(
        street.alias("street"), city.alias("city"), state.alias("state"), zip_code.alias("zip_code"),
        F.concat_ws(" ", _filled(street), _filled(city), _filled(state), _filled(zip_code)).alias("normalized"),
    )


def parse_full_address(address: Column) -> Column:
    """Split one address line: ZIP at the end, two-letter state before it, city after the last comma."""
    zip_at, state_at = r"\b(\d{5})(?:-\d{4})?\s*$", r"\b([A-Z]{2})\s*$"

    def split_city(text: Column, state: Column, zip_code: Column) -> Column:
        comma = F.instr(text, ",") > 0
        city = F.when(comma, F.trim(F.regexp_extract(text, r"^.*,([^,]*)$", 1)))
        street = F.when(comma, F.trim(F.regexp_extract(text, r"^(.*),[^,]*$", 1))).otherwise(text)
        return let(normalize_street(street), lambda st: _assemble(st, city, state, zip_code))

    def split_state(text: Column, zip_code: Column) -> Column:
        state = _filled(F.regexp_extract(text, state_at, 1))
        rest = F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, state_at, "")), r",+$", ""))
        return let(rest, lambda r: split_city(r, state, zip_code))

    def split_zip(text: Column) -> Column:
        zip_code = _filled(F.regexp_extract(text, zip_at, 1))
        return let(F.trim(F.regexp_replace(text, zip_at, "")), lambda r: split_state(r, zip_code))

    return let(squeeze(F.upper(_filled(address))), split_zip)


def normalize_address(address: Column, city=None, state=None, zip_code=None) -> Column:
    """Struct of street, city, state, zip_code and the joined normalized text."""
    none = F.lit(None).cast("string")
    c, s, z = (none if x is None else _filled(x) for x in (city, state, zip_code))
    has_parts = c.isNotNull() | s.isNotNull() | z.isNotNull()
    if city is None and state is None and zip_code is None:
        return parse_full_address(address)
    parts = let(normalize_street(_filled(address)), lambda st: _assemble(st, F.trim(F.upper(c)), normalize_state(s), normalize_zip(z)))
    return F.when(has_parts, parts).otherwise(parse_full_address(address))


def red_flag_texts(address: Column) -> Column:
    """The suspicious phrases the address holds."""
    low = F.lower(address)
    return F.filter(F.array(*[F.lit(p) for p in RED_FLAG_TEXTS]), lambda p: F.contains(low, p))
