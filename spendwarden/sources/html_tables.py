"""Contract tables inside web pages."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalize_vendor_name
from ..functions.scalars import parse_date
from ..operators.tables import pick_per_key


class _Tables(HTMLParser):
    """Collects the tables of one page: attributes, headings and rows of cells (text, link)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self._open, self._cell = [], [], None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "table":
            self.tables.append({"id": attrs.get("id"), "class": attrs.get("class") or "", "head": None, "rows": [], "part": None, "body": False})
            self._open.append(self.tables[-1])
        elif not self._open:
            return
        elif tag in ("thead", "tbody", "tfoot"):
            self._open[-1]["part"] = tag
            self._open[-1]["body"] |= tag == "tbody"
        elif tag == "tr":
            self._open[-1]["rows"].append((self._open[-1]["part"], []))
        elif tag in ("td", "th"):
            t = self._open[-1]
            if not t["rows"]:
                t["rows"].append((t["part"], []))
            self._cell = {"tag": tag, "text": [], "link": None}
            t["rows"][-1][1].append(self._cell)
        elif tag == "a" and self._cell is not None and self._cell["link"] is None:
            self._cell["link"] = attrs.get("href") or ""

    def handle_endtag(self, tag):
        if tag == "table" and self._open:
            self._open.pop()
            self._cell = None
        elif tag in ("td", "th", "tr"):
            self._cell = None
        elif tag in ("thead", "tbody", "tfoot") and self._open:
            self._open[-1]["part"] = None

    def handle_data(self, data):
        if self._cell is not None and data.strip():
            self._cell["text"].append(data.strip())


# Tags of plain pages: quoted values without references. All other markup (comments, scripts, odd quotes) is left to the parser.
_TAG = re.compile(r'<(?:/([a-zA-Z][a-zA-Z0-9]*)|([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][-a-zA-Z0-9_:]*="[^"<>&]*")*))[ \t\n\r\f]*>')
_VALUE = re.compile(r'([a-zA-Z][-a-zA-Z0-9_:]*)="([^"]*)"')
_RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"))


def _plain(html: str, into: _Tables) -> bool:
    """Feeds a plain page to the handlers as the parser would, in about a third of its time; False, perhaps halfway, if it isn't plain."""
    if "\0" in html:
        return False
    at = 0
    for m in _TAG.finditer(html):
        text = html[at : m.start()]
        if text:
            if "<" in text:
                return False
            into.handle_data(unescape(text) if "&" in text else text)
        at = m.end()
        end, start, values = m.groups()
        if end:
            into.handle_endtag(end.lower())
            continue
        start = start.lower()
        if start in _RAW:
            return False
        into.handle_starttag(start, [(k.lower(), v) for k, v in _VALUE.findall(values)] if values else ())
    rest = html[at:]
    if "<" in rest or "&" in rest:  # the parser waits for the end of these
        return False
    if rest:
        into.handle_data(rest)
    return True


def _tables(html: str) -> list[dict]:
    parser = _Tables()
    if not _plain(html, parser):
        parser = _Tables()
        parser.feed(html)
    return parser.tables


def _page_rows(html: str):
    found = _tables(html or "")
    pick = [t for t in found if t["id"] == "contracts-table"] or [t for t in found if "dataTable" in t["class"]] or found
    if not pick:
        return
    table = pick[0]
    head = [c for part, cells in table["rows"] if part == "thead" for c in cells if c["tag"] == "th"]
    keys = ["".join(c["text"]).lower().replace(" ", "_") for c in head]
    rows = [cells for part, cells in table["rows"] if part == "tbody"] if table["body"] else [cells for _, cells in table["rows"]][1:]
    for n, cells in enumerate(rows):
        if len(cells) < 3:
            continue
        out = {}
        for i, c in enumerate(cells):
            key = keys[i] if i < len(keys) else f"col_{i}"
            out[key] = "".join(c["text"])
            if c["link"]:
                out[f"{key}_link"] = c["link"]
        yield n, out


def table_rows(pages: DataFrame) -> DataFrame:
    """(page_id, row_no, cells) of the contract table of each page; pages are parsed where they lie."""
    def parse(batches):
        for pdf in batches:
            rows = [(pid, n, list(cells.items())) for pid, html in zip(pdf["page_id"], pdf["html"]) for n, cells in _page_rows(html)]
            yield pd.DataFrame(rows, columns=["page_id", "row_no", "cells"])

    flat = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "html").mapInPandas(
        parse, "page_id bigint, row_no bigint, cells array<struct<key: string, value: string>>")
    return flat.select("page_id", "row_no", F.map_from_entries("cells").alias("cells"))


def map_health_contracts(rows: DataFrame) -> DataFrame:
    """Contracts from table rows, headings drifting; first row per number."""
    def cell(*keys: str):
        return F.coalesce(*[F.nullif(F.try_element_at("cells", F.lit(k)), F.lit("")) for k in keys])

    formats = ("yyyy-M-d", "M/d/yyyy", "M-d-yyyy", "yyyy/M/d", "d-MMM-yyyy", "MMM d, yyyy")
    vendor = cell("vendor", "vendor_name", "contractor", "col_1")
    out = rows.select(
        F.trim(cell("contract_number", "contract", "contract_#", "col_0")).alias("contract_number"), vendor.alias("vendor_name"),
        normalize_vendor_name(vendor).alias("vendor_normalized"), cell("solicitation", "solicitation_number", "rfp", "col_3").alias("solicitation_number"),
        parse_date(cell("start_date", "effective_date", "date", "col_2"), *formats).alias("start_date"),
        parse_date(cell("end_date", "expiration_date"), *formats).alias("end_date"), F.lit("hhsc").alias("agency"),
        F.struct("page_id", "row_no").alias("_pos")).where("contract_number is not null and vendor_name is not null")
    return pick_per_key(out, ["contract_number"], F.col("_pos"))
