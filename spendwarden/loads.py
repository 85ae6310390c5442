"""Loads: landed files of every source into the stored tables, only files not read before, only partitions that change.

Each load writes its start to the log, reads the files that arrived since the last load that succeeded, maps them, gives
them vendor and agency ids, adds or updates rows, and writes its success with the number of rows, or its failure. A load
that failed leaves the log's read_until where it was, so the next one reads the same files again; rows are known by their
natural keys, so nothing enters twice.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.resolve import coded_agencies, link_agencies, link_vendors, new_agencies, new_vendors, surrogate_id
from .operators.tables import insert_into, stored, update_in
from .plans import sync_log
from .schema import read_tables, store
from .session import cut
from .sources import contracts, html_tables, parties, payments, vendors
from .sources.readers import read_json, read_named

BIDDERS, CERTIFIED = False, True


@dataclass
class Job:
    """One run of a load: where tables lie, the landed path, the day it counts as, and options of the source."""

    spark: SparkSession
    root: str
    path: str
    as_of: dt.date
    window: dict[str, str]  # reader options that pick the new files
    options: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return stored(self.spark, self.root, name)

    def named(self, encoding: str = "ISO-8859-1", glob: str | None = None, key: Callable[[str], str] = str.strip) -> DataFrame:
        return read_named(self.spark, self.path, self.options.get("encoding", encoding), glob, key, **self.window)

    def records(self) -> DataFrame:
        return read_json(self.spark, self.path, multi_line=self.options.get("multi_line", False), **self.window)

    def with_vendors(self, rows: DataFrame, name: str = "vendor_name") -> DataFrame:
        """rows with vendor_id; vendors not known yet are added first."""
        rows = cut(rows)
        insert_into(self.spark, self.root, "vendor", new_vendors(rows, self.table("vendor"), self.as_of, name), ["name_normalized"], F.col("id"))
        return link_vendors(rows, self.table("vendor"), name)

    def with_agencies(self, rows: DataFrame, by_code: bool = True) -> DataFrame:
        """rows with agency_id; agencies not known yet are added first."""
        rows = cut(rows)
        insert_into(self.spark, self.root, "agency", new_agencies(rows, self.table("agency"), by_code), ["name"], F.col("id"))
        return link_agencies(rows, self.table("agency"), by_code)

    def insert(self, name: str, rows: DataFrame, keys: list[str]) -> int:
        rows = rows.withColumn("id", surrogate_id(F.lit(name), *[F.col(k).cast("string") for k in keys]))
        return insert_into(self.spark, self.root, name, rows, keys, F.col("_pos"))

    def update(self, name: str, rows: DataFrame, keys: list[str], **how) -> int:
        if "id" not in rows.columns:
            rows = rows.withColumn("id", surrogate_id(F.lit(name), *[F.col(k).cast("string") for k in keys]))
            how["keep_always"] = ("id", *how.get("keep_always", ()))
        return update_in(self.spark, self.root, name, rows, keys, F.col("_pos"), **how)


def _bidders(certified: bool) -> Callable[[Job], int]:
    def load(j: Job) -> int:
        rows = vendors.map_vendors(j.named(), j.as_of, certified)
        return j.update("vendor", rows, ["vendor_id"], keep_if_null=("address", "city", "state", "zip_code", "phone", "hub_status"), keep_always=("id", "first_seen"))

    return load


def _classes(j: Job) -> int:
    """Codes go to vendors already there; a vendor's codes are those of the newest files that name it."""
    rows = vendors.class_codes(j.named()).withColumn("_pos", F.lit(0))
    return update_in(j.spark, j.root, "vendor", rows, ["vendor_id"], F.col("_pos"), only_known=True)


def _own_place(*more: str) -> tuple[Column, Column]:
    """What tells a record without a number from all others: its file and text, and which of the file's equal records it is."""
    text = F.sha2(F.concat_ws("|", F.col("_pos.file"), "raw_data", *more), 256)
    return text, F.row_number().over(Window.partitionBy(text).orderBy("_pos")).cast("string")


def _expenditures(j: Job) -> int:
    rows = payments.map_expenditures(j.records(), j.options["fiscal_year"], j.options.get("dedupe", "first"))
    return j.insert("payment", j.with_agencies(rows), ["source_system", "source_id"])


def _payments(j: Job) -> int:
    """Rows without an id of their own are known by their file, their content and which of equal rows of the file they are."""
    rows = j.with_agencies(j.with_vendors(payments.map_payments(j.records())))
    own = rows.where("source_id is not null").unionByName(rows.where("source_id is null").withColumn("source_id", F.concat_ws("-", F.lit("row"), *_own_place())))
    return j.insert("payment", own, ["source_system", "source_id"])


def _payee_payments(j: Job) -> int:
    """Known by vendor, agency, amount and date, whatever source a stored payment came from."""
    return j.insert("payment", j.with_agencies(j.with_vendors(payments.map_payee_payments(j.records(), j.options["dataset"]))), ["vendor_id", "agency_id", "amount", "payment_date"])


def _contracts(j: Job) -> int:
    return j.insert("contract", j.with_agencies(j.with_vendors(contracts.map_contract_csv(j.named())), by_code=False), ["contract_number"])


def _sheet(j: Job) -> int:
    """Stored contracts are updated with what the sheet says; cells it leaves empty change nothing."""
    rows = j.with_agencies(j.with_vendors(contracts.map_contract_sheet(j.named("UTF-8", key=contracts.plain_heading))), by_code=False)
    return j.update("contract", rows, ["contract_number"], keep_if_null=(
        "vendor_id", "agency_id", "description", "current_value", "max_value", "start_date", "end_date", "nigp_codes", "fiscal_year"))


def _awards(j: Job) -> int:
    rows = cut(contracts.map_awards(j.records(), j.options["award_type"], j.options["fiscal_year"]))
    insert_into(j.spark, j.root, "agency", coded_agencies(rows, j.table("agency")), ["name"], F.col("id"))
    rows = link_agencies(j.with_vendors(rows), j.table("agency"), by_code=False)
    return j.insert("grant", rows.withColumnRenamed("vendor_id", "recipient_id"), ["grant_number"])


def _cooperative(j: Job) -> int:
    return j.insert("contract", j.with_vendors(contracts.map_cooperative(j.records())), ["contract_number"])


def _sales(j: Job) -> int:
    """Sales are kept per contract and file; a contract is worth its base and all its sales, however often files are read."""
    raw = cut(j.records())
    sold = cut(contracts.sales_rollup(raw))
    by_file = contracts.sales_rollup(raw, "file")
    update_in(j.spark, j.root, "contract_sale", by_file.select("contract_number", "file", F.col("current_value").alias("amount"), "_pos"), ["contract_number", "file"], F.col("_pos"))
    fresh = j.with_agencies(j.with_vendors(sold.drop("current_value")), by_code=False)
    added = j.insert("contract", fresh.withColumn("base_value", F.lit(0).cast("decimal(15,2)")), ["contract_number"])
    total = j.table("contract_sale").join(sold.select("contract_number"), "contract_number", "left_semi").groupBy("contract_number").agg(F.sum("amount").alias("_sold"))
    base = F.coalesce("base_value", "current_value", F.lit(0))
    worth = j.table("contract").join(total, "contract_number").select(
        "contract_number", base.cast("decimal(15,2)").alias("base_value"), (base + F.col("_sold")).cast("decimal(15,2)").alias("current_value"), F.lit(0).alias("_pos"))
    return max(added, update_in(j.spark, j.root, "contract", worth, ["contract_number"], F.col("_pos"), only_known=True))


def _salaries(j: Job) -> int:
    rows = cut(payments.last_salaries(j.with_agencies(payments.map_salaries(j.named()))))
    return j.update("employee", rows, ["name_normalized", "agency_id"], keep_always=("name",))


def _permits(j: Job) -> int:
    """Permits without a number are known by their file, their record and which of equal records of the file they are."""
    rows = cut(parties.map_permits(j.records(), j.options["permit_type"]))
    bare = rows.where("taxpayer_number is null").withColumn("id", surrogate_id(F.lit("tax_permit"), *_own_place("permit_type")))
    return j.update("tax_permit", rows.where("taxpayer_number is not null"), ["taxpayer_number", "permit_type"]) + insert_into(
        j.spark, j.root, "tax_permit", bare, ["id", "raw_data"], F.col("_pos"))


def _gifts(j: Job) -> int:
    """Files with contrib in their name; all CSV files where there is none."""
    try:
        rows = j.named(glob="*[cC][oO][nN][tT][rR][iI][bB]*.[cC][sS][vV]")
        some = not rows.isEmpty()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        some = False
    rows = parties.map_contributions(rows if some else j.named(glob="*.[cC][sS][vV]"))
    return j.insert("contribution", rows, ["filer_name", "contributor_name", "contribution_amount", "contribution_date"])


def _exclusions(j: Job) -> int:
    return j.update("debarred", parties.map_exclusions(j.named("UTF-8"), j.as_of), ["source", "sam_number"])


def _exclusions_json(j: Job) -> int:
    return j.update("debarred", parties.map_exclusions_json(j.records(), j.as_of), ["source", "sam_number"])


def _bids(j: Job) -> int:
    """Bids of this year and the two before; linked to vendors already there."""
    first = dt.date(j.as_of.year - 2, 1, 1)
    return j.insert("construction_bid", link_vendors(contracts.map_bids(j.records(), first), j.table("vendor"), "contractor_name"), ["project_id", "contractor_normalized"])


def _construction(j: Job) -> int:
    return j.insert("contract", j.with_agencies(j.with_vendors(contracts.map_construction(j.records()))), ["contract_number"])


def _health(j: Job) -> int:
    """Pages as landed, a file each; contracts are linked to vendors already there."""
    pages = j.spark.read.option("wholetext", True).options(**j.window).text(j.path).select(F.xxhash64("_metadata.file_path").alias("page_id"), F.col("value").alias("html"))
    rows = html_tables.map_health_contracts(html_tables.table_rows(pages))
    return j.insert("hhs_contract", link_vendors(rows, j.table("vendor")), ["contract_number"])


# every source by its name in the log
SOURCES: dict[str, Callable[[Job], int]] = {
    "bidders": _bidders(BIDDERS), "certified_bidders": _bidders(CERTIFIED), "class_codes": _classes, "expenditures": _expenditures, "payments": _payments, "payee_payments": _payee_payments,
    "contracts": _contracts, "contract_sheet": _sheet, "awards": _awards, "cooperative_contracts": _cooperative, "contract_sales": _sales, "salaries": _salaries, "permits": _permits,
    "contributions": _gifts, "exclusions": _exclusions, "exclusions_json": _exclusions_json, "bids": _bids, "construction_contracts": _construction, "health_contracts": _health,
}


def _text(at: dt.datetime) -> str:
    return at.strftime("%Y-%m-%dT%H:%M:%S.%f")


def load(spark: SparkSession, root: str, source: str, path: str, at: dt.datetime, full: bool = False, **options) -> dict:
    """Load what landed under path since the source's last load that succeeded; returns the log's last row as a dict.

    at (UTC) is when the load runs: files last modified before it are read and it counts as read_until. full reads all
    files again. options go to the source (fiscal_year, dataset, award_type, permit_type, encoding, ...). An error is
    logged whole, then raised.
    """
    if source not in SOURCES:
        raise ValueError(f"unknown source: {source}")
    at = at.replace(tzinfo=dt.timezone.utc) if at.tzinfo is None else at.astimezone(dt.timezone.utc)
    log, run = f"{root}/sync_status", int(at.timestamp() * 1_000_000)
    until = sync_log.read_until(read_tables(spark, root, "sync_status")["sync_status"], source).select(F.unix_micros("read_until").alias("us")).first()["us"]
    since = None if full or until is None else dt.datetime.fromtimestamp(until / 1_000_000, dt.timezone.utc)
    window = {"modifiedBefore": _text(at), "timeZone": "UTC"}
    if since is not None:  # the reader takes files modified after, to the millisecond; those of the very instant count as new
        window["modifiedAfter"] = _text(since - dt.timedelta(milliseconds=1))

    def say(status: str, **more) -> None:
        store(sync_log.log_row(spark, source, run, status, at, **more), "sync_status", log, "append")

    say("in_progress")
    try:
        n = SOURCES[source](Job(spark, root, path, at.date(), window, options)) if _any_file(spark, path, window) else 0
    except Exception as e:
        say("failed", error=str(e))
        raise
    say("success", records=n, read_until=at)
    return {"source": source, "status": "success", "records": n, "since": since}


def _any_file(spark: SparkSession, path: str, window: dict[str, str]) -> bool:
    """Whether the window holds any file; only names and times are read."""
    try:
        files = spark.read.format("binaryFile").options(**window).option("recursiveFileLookup", True).load(path).select("path", "modificationTime")
        return not files.isEmpty()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return False
