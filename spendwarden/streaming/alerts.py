"""The alert life cycle as a stream: findings and status changes of each entity meet in keyed state.

The state of a key (type, entity, and what tells alerts of one type apart) holds its alerts. A finding becomes an alert
unless an open one is there; a change counts for the alert it names, whenever it arrives. Every alert that is new or
changed leaves the stream as it now stands, and is kept in the alert_state table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.scalars import severity_rank
from ..operators.tables import update_in
from ..plans.alerts import CLOSED, alert_part

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
INPUT = ("alert_type string, entity_type string, entity_id bigint, _part string, slot bigint, kind string, at timestamp, alert_id bigint, severity string, title string, "
         "description string, evidence string, place string, status string, note string")
STATE = ("id bigint, alert_type string, severity string, title string, description string, entity_type string, entity_id bigint, evidence string, status string, "
         "created_at timestamp, notes string, acknowledged_at timestamp, resolved_at timestamp")
GROUP = ("alert_type", "entity_type", "_part", "slot")


def _shaped(df: DataFrame, **columns) -> DataFrame:
    names = [c.split()[0] for c in INPUT.split(", ")]
    kinds = dict(c.split() for c in INPUT.split(", "))
    return df.select(*[(columns[n] if n in columns else F.col(n) if n in df.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names])


def finding_rows(findings: DataFrame, at: str = "at") -> DataFrame:
    """Findings (with the time of their run in at) as input; ids as in to_alert_rows. One without an entity is a key of its own."""
    when = F.col(at).cast("timestamp")
    id_ = F.xxhash64("alert_type", "entity_type", "entity_id", "evidence", when)
    place = F.concat(F.lpad(F.col("rule_order").cast("string"), 6, "0"), (F.lit(9) - severity_rank(F.col("severity"))).cast("string"), F.col("evidence"))
    return _shaped(findings, kind=F.lit("finding"), at=when, alert_id=id_, place=place, _part=alert_part(), slot=F.coalesce("entity_id", id_), status=F.lit(None), note=F.lit(None))


def change_rows(changes: DataFrame) -> DataFrame:
    """Status changes (the alert's type, entity and evidence, its id as alert_id, status, note, at) as input."""
    return _shaped(changes, kind=F.lit("change"), _part=alert_part(), slot=F.coalesce("entity_id", "alert_id"))


class _LifeCycle(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.alerts = handle.getMapState("alerts", "id bigint", "record string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: json.loads(v[0]) for k, v in self.alerts.iterator()}
        touched = set()
        table = pd.concat(list(rows)).astype(object)
        table = table.where(table.notna(), None)
        records = sorted(table.to_dict("records"), key=lambda r: (pd.Timestamp(r["at"]).value, r["kind"] == "finding", r["place"] or "", r["status"] or "", r["note"] or ""))
        for r in records:
            at, id_ = pd.Timestamp(r["at"]).value, r["alert_id"]
            if r["kind"] == "change":  # may come before its alert does
                alert = known.setdefault(id_, {"changes": []})
                alert["changes"].append([at, r["status"], r["note"]])
                touched.add(id_)
            elif r["entity_id"] is None or not any("created" in a and self._status(a) not in CLOSED for a in known.values()):
                alert = known.setdefault(id_, {"changes": []})
                if "created" not in alert:
                    alert |= {"created": at, **{c: r[c] for c in ("severity", "title", "description", "evidence", "entity_id")}}
                    touched.add(id_)
        for id_ in touched:
            self.alerts.updateValue((id_,), (json.dumps(known[id_]),))
        out = [self._row(key, id_, known[id_]) for id_ in sorted(touched) if "created" in known[id_]]
        if out:
            yield pd.DataFrame(out)

    @staticmethod
    def _status(alert: dict) -> str:
        return max(((at, s) for at, s, _ in alert["changes"]), default=(0, "new"))[1]

    def _row(self, key, id_: int, alert: dict) -> dict:
        last = lambda *kinds: pd.Timestamp(max((at for at, s, _ in alert["changes"] if s in kinds), default=pd.NaT))
        notes = "\n".join(n for at, _, n in sorted((c for c in alert["changes"] if c[2] is not None), key=lambda c: (c[0], c[2])))
        return {"id": id_, "alert_type": key[0], "severity": alert["severity"], "title": alert["title"], "description": alert["description"], "entity_type": key[1],
                "entity_id": alert["entity_id"], "evidence": alert["evidence"], "status": self._status(alert), "created_at": pd.Timestamp(alert["created"]), "notes": notes or None,
                "acknowledged_at": last("acknowledged"), "resolved_at": last(*CLOSED)}

    def close(self) -> None:
        pass


def life_cycle(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """Alerts that are new or changed, as they stand after each batch; inputs as finding_rows and change_rows give them.

    State is kept per key and grows with the alerts and their changes, not with findings that repeat open alerts.
    """
    findings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return findings.unionByName(changes).groupBy(*GROUP).transformWithStateInPandas(_LifeCycle(), STATE, "Update", "None")


def keep(alerts: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Keep the stream's alerts in the alert_state table under root; a repeated batch changes nothing."""
    def write(batch: DataFrame, number: int) -> None:
        update_in(batch.sparkSession, root, "alert_state", batch, ["id"], F.col("id"))

    return alerts.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

