"""Deletion and retention: what a request reaches, the lifecycle of records, and recalculation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import canon

SCOPE = ["tenant_id", "app_id"]


def lifecycle(requests: DataFrame, expirations: DataFrame) -> DataFrame:
    """(tenant_id, app_id, record_id, lifecycle_status): the last completed request, overridden by expirations, which purge.

    Requests are in order of completed_at and privacy_request_id, where they have these columns; of one
    request's entries for a record the last counts.
    """
    known = [c for c in ("completed_at", "privacy_request_id") if c in requests.columns]
    order = F.struct(F.lit(0).alias("rank"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in known], F.col("at"))
    done = requests.where("status = 'completed'").select(*SCOPE, *known, F.posexplode("affected_records").alias("at", "r")).select(*SCOPE, "r.record_id", "r.lifecycle_status", order.alias("o"))
    gone = expirations.select(*SCOPE, "record_id").distinct().withColumn("purged", F.lit(True))
    last = done.groupBy(*SCOPE, "record_id").agg(F.max_by("lifecycle_status", "o").alias("lifecycle_status"))
    both = last.join(gone, [*SCOPE, "record_id"], "full")
    return both.select(*SCOPE, "record_id", F.when(F.col("purged"), "purged").otherwise(F.col("lifecycle_status")).alias("lifecycle_status"))


def corrections(refunds: DataFrame, redactions: DataFrame, supplied: DataFrame) -> DataFrame:
    """(tenant_id, app_id, correction_id, corrects_record_id, kind) of refunds, redacted records and supplied inputs."""
    a = refunds.where("correction_target_record_id is not null").select(*SCOPE, F.concat(F.lit("correction:"), "record_id").alias("correction_id"), F.col("correction_target_record_id").alias("corrects_record_id"), F.lit("refund").alias("kind"))
    b = redactions.where("lifecycle_status = 'redacted'").select(*SCOPE, F.concat(F.lit("correction:redaction:"), "record_id").alias("correction_id"), F.col("record_id").alias("corrects_record_id"), F.lit("redaction").alias("kind"))
    return reduce(DataFrame.unionByName, [a, b, supplied.select(*SCOPE, "correction_id", "corrects_record_id", F.lit("supplied").alias("kind"))])


def tombstones(requests: DataFrame) -> DataFrame:
    """A tombstone for each record a request reached, with a digest of where it comes from and when it was completed."""
    rows = requests.where("status = 'completed'").select("*", F.explode("affected_records").alias("r"))
    parts = [F.col(c) for c in ("tenant_id", "app_id", "privacy_request_id")] + [F.col("r.record_id"), F.col("completed_at")]
    return rows.select(*SCOPE, "privacy_request_id", F.col("r.record_id").alias("record_id"), F.col("r.lifecycle_status").alias("lifecycle_status"), canon.digest_array(parts).alias("provenance_digest"))


def reach(requests: DataFrame, facts: list[DataFrame], events: DataFrame) -> DataFrame:
    """(privacy_request_id, record_id) that pending requests reach by installation, app or tenant.

    facts: tables with tenant_id, app_id, installation_id, record_id; events: all logical events.
    The three scopes are three equi-joins over one union of facts, instead of one join with an OR.
    """
    ids = reduce(DataFrame.unionByName, [f.select(*SCOPE, "installation_id", "record_id") for f in facts])
    by = lambda scope: requests.where(F.col("deletion_scope") == scope)
    one = by("installation").select(*SCOPE, "installation_id", "privacy_request_id").join(ids, [*SCOPE, "installation_id"])
    two = by("app").select(*SCOPE, "privacy_request_id").join(events.select(*SCOPE, "record_id"), SCOPE)
    three = by("tenant").select("tenant_id", "privacy_request_id").join(events.select("tenant_id", "record_id"), "tenant_id")
    return reduce(DataFrame.unionByName, [x.select("privacy_request_id", "record_id") for x in (one, two, three)]).distinct()


def purgeable(reached: DataFrame, records: DataFrame) -> DataFrame:
    """Payloads of reached records that no other record still uses."""
    held = records.join(reached.select("record_id").distinct(), "record_id", "left_anti").select("payload_ref").distinct()
    mine = records.join(reached.select("record_id").distinct(), "record_id", "left_semi").select("payload_ref").distinct()
    return mine.join(held, "payload_ref", "left_anti")


def affected_runs(runs: DataFrame, reached: DataFrame) -> DataFrame:
    """Metric runs, not superseded, whose evidence names a reached record: what has to be recalculated."""
    from .ledger import not_superseded

    live = not_superseded(runs, "metric_run_id", "supersedes_metric_run_id")
    hit = live.select("metric_run_id", F.explode("evidence_refs").alias("record_id")).join(reached.select("record_id").distinct(), "record_id", "left_semi")
    return hit.groupBy("metric_run_id").agg(F.count_distinct("record_id").alias("records"))


def remaining(records: DataFrame, states: DataFrame, privacy_state: str) -> DataFrame:
    """The records that a metric sees before a deletion (all) or after it (available ones)."""
    if privacy_state == "before":
        return records
    gone = states.where("lifecycle_status <> 'available'").select(*SCOPE, "record_id")
    return records.join(gone, [*SCOPE, "record_id"], "left_anti")
