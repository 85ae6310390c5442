import datetime as dt

from pyspark.sql import functions as F

from helpers import table

from spendwarden.params import Params
from spendwarden.plans import duplicates
from spendwarden.streaming import payments

P = Params()
SCHEMA = "id bigint, vendor_id bigint, amount decimal(15,2), payment_date date, paid_at timestamp"


def landed(spark, folder, rows, name):
    df = table(spark, "payment", *rows).selectExpr("id", "vendor_id", "amount", "payment_date", "cast(payment_date as timestamp) as paid_at")
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def drain(spark, stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_stream_equals_batch(spark, tmp_path):
    rows = [{"vendor_id": 1, "amount": 9000, "payment_date": d} for d in ("2001-01-01", "2001-01-01", "2001-01-31", "2001-03-03")]
    rows += [{"vendor_id": 2, "amount": 200, "payment_date": "2001-02-02"}] * 3
    late = [{"id": 99, "vendor_id": 9, "amount": 99999, "payment_date": "2003-01-01"}]  # moves the watermark past the rest
    rows = [{"id": i, **r} for i, r in enumerate(rows)]
    landed(spark, tmp_path / "in", rows, "a")
    landed(spark, tmp_path / "in", late, "b")
    src = lambda: spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    t = {"payment": table(spark, "payment", *rows), "vendor": table(spark, "vendor", {"id": 1, "name": "A"}, {"id": 2, "name": "B"})}
    exact = {(r["entity_id"], r["payment_date"], r["duplicate_count"]) for r in duplicates.exact_duplicates(t, P).collect()}
    got = drain(spark, payments.duplicate_stream(src(), P), "dup")
    assert {(r["vendor_id"], r["payment_date"], r["duplicate_count"]) for r in got.collect()} == exact
    near = {(r["entity_id"], r["payment_count"], r["first_date"], r["last_date"]) for r in duplicates.near_duplicates(t, P).collect()}
    got = drain(spark, payments.near_duplicate_stream(src(), P), "near")
    assert {(r["vendor_id"], r["payment_count"], r["first_date"], r["last_date"]) for r in got.collect()} == near != set()


def test_landing_skips_known_payments(spark, tmp_path):
    first = [{"id": i, "vendor_id": 1, "amount": 5, "payment_date": dt.date(2001, 1, 1).isoformat()} for i in (1, 2, 2)]
    landed(spark, tmp_path / "in", first, "a")
    src = lambda: spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    payments.land(src(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    landed(spark, tmp_path / "in", [{"id": 2, "vendor_id": 1, "amount": 5}, {"id": 3, "vendor_id": 1, "amount": 5}], "b")
    payments.land(src(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_landing_with_bounded_state(spark, tmp_path):
    """Each file repeats some payments of the one before; what is kept in state stays flat while files come."""
    import os

    start, want = 1_700_000_000, {}
    for n in range(10):
        ids = [*range(n * 40, n * 40 + 40), *range(max(n * 40 - 10, 0), n * 40), n * 40]
        rows = [{"id": i, "vendor_id": 1, "amount": i, "payment_date": f"20{(i * 7) % 20:02d}-01-01"} for i in ids]  # payments of any date
        landed(spark, tmp_path / "in", rows, f"{n:02d}")
        want |= {i: i for i in ids}
        for file in (tmp_path / "in" / f"{n:02d}").glob("part-*"):
            os.utime(file, (start + n * 3600, start + n * 3600))
    src = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = payments.land_within(src.withColumn("arrived_at", F.col("_metadata.file_modification_time")), str(tmp_path / "out"), str(tmp_path / "cp"), delay="90 minutes")
    q.awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["id"], int(r["amount"])) for r in got.collect()) == sorted(want.items())
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(kept) <= 160 < len(want)  # a few files' keys, not all


def test_alert_life_cycle_equals_batches(spark, tmp_path):
    from spendwarden.plans import alerts
    from spendwarden.schema import read_tables
    from spendwarden.streaming import alerts as stream

    day = lambda n, h=0: dt.datetime(2024, 1, n, h)
    found_schema = "alert_type string, severity string, title string, description string, entity_type string, entity_id bigint, evidence string, rule_order int, at timestamp"
    f = lambda at, kind, who, evidence, severity="low", order=0: (kind, severity, kind, "d", "vendor", who, evidence, order, at)
    runs = [
        [f(day(1), "ghost", 1, "a"), f(day(1), "ghost", 1, "b", "high"), f(day(1), "ghost", 1, "c", "high", 1), f(day(1), "ghost", 2, "a"), f(day(1), "other", None, "x"), f(day(1), "other", None, "y"),
         f(day(1), "pay_to_play", 1, '{"contributor_name": "A"}'), f(day(1), "pay_to_play", 1, '{"contributor_name": "B"}')],
        [f(day(3), "ghost", 1, "z"), f(day(3), "ghost", 2, "n"), f(day(3), "ghost", 3, "a"), f(day(3), "other", None, "x")],
        [f(day(6), "ghost", 1, "y"), f(day(6), "ghost", 2, "m"), f(day(6), "ghost", 3, "b")],
    ]
    changes = [  # (alert's type, entity, evidence, time of its run), status, note, at; by batch
        [],
        [("ghost", 2, "a", day(1), "resolved", "done", day(2)), ("ghost", 1, "b", day(1), "acknowledged", None, day(2))],
        [("ghost", 1, "b", day(1), "false_positive", "no", day(5)), ("ghost", 1, "b", day(1), "investigating", "look", day(4)), ("ghost", 3, "a", day(3), "acknowledged", "q", day(5))],
        [("ghost", 2, "a", day(1), "acknowledged", "earlier", day(1, 9)), ("ghost", 3, "a", day(3), "resolved", "r", day(7))],  # the first is late
    ]
    change_schema = "alert_type string, entity_type string, entity_id bigint, evidence string, run timestamp, status string, note string, at timestamp"
    id_ = F.xxhash64("alert_type", "entity_type", "entity_id", "evidence", "run")
    change_df = lambda rows: spark.createDataFrame([(k, "vendor", w, e, run, s, n, at) for k, w, e, run, s, n, at in rows], change_schema).withColumn("alert_id", id_)

    # batch by batch
    table_, events = spark.createDataFrame([], "id bigint, alert_type string, severity string, title string, description string, entity_type string, entity_id bigint, evidence string, status string, created_at timestamp"), change_df([])
    for n in range(4):
        events = events.unionByName(change_df(changes[n]))
        if n < 3:
            found = spark.createDataFrame(runs[n], found_schema)
            now = alerts.current_alerts(table_, events.select("alert_id", "status", "note", "at"))
            fresh = alerts.new_alerts(found.drop("at"), now.select(*table_.columns))
            table_ = spark.createDataFrame(table_.unionByName(alerts.to_alert_rows(fresh, runs[n][0][8])).collect(), table_.schema)
    columns = ["id", "alert_type", "severity", "entity_id", "evidence", "status", "created_at", "notes", "acknowledged_at", "resolved_at"]
    want = sorted((tuple(r) for r in alerts.current_alerts(table_, events.select("alert_id", "status", "note", "at")).select(*columns).collect()), key=str)

    # as a stream, one batch after the other, from one checkpoint
    root = str(tmp_path / "audit")
    for n in range(4):
        spark.createDataFrame(runs[n] if n < 3 else [], found_schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "found"))
        change_df(changes[n]).coalesce(1).write.mode("append").parquet(str(tmp_path / "changes"))
        found = spark.readStream.schema(found_schema).parquet(str(tmp_path / "found"))
        changed = spark.readStream.schema(change_df([]).schema).parquet(str(tmp_path / "changes"))
        q = stream.keep(stream.life_cycle(stream.finding_rows(found), stream.change_rows(changed)), root, str(tmp_path / "cp"))
        q.awaitTermination(300)
    got = sorted((tuple(r) for r in read_tables(spark, root, "alert_state")["alert_state"].select(*columns).collect()), key=str)
    assert got == want and len(got) == 10
