"""Reports: validated filters, keyset pages, record counts and audits."""

from __future__ import annotations

import base64
import json
import re
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.ledger import not_superseded, page, with_superseded_flag

# Row limits of a page and of an export.
DEFAULT_ROWS, MOST_ROWS, MOST_EXPORT_ROWS = 200, 1000, 200_000
FILTERS = ("metric_name", "campaign_id", "network", "country", "from", "to", "limit", "cursor", "include_superseded")
IDENTIFYING = ("installation_id", "user_id", "device_id", "advertising_id", "click_id")


class FilterError(ValueError):
    pass


@dataclass(frozen=True)
class Filters:
    equal: dict[str, str]
    start: str | None
    end: str | None
    limit: int
    after: tuple | None
    include_superseded: bool


def _day(text: str) -> date:
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
        raise FilterError("invalid_date")
    try:
        return date.fromisoformat(text)
    except ValueError as e:
        raise FilterError("invalid_date") from e


def encode_cursor(key: list) -> str:
    return base64.urlsafe_b64encode(json.dumps(key).encode()).decode().rstrip("=")


def decode_cursor(text: str) -> tuple:
    try:
        return tuple(json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))))
    except ValueError as e:
        raise FilterError("invalid_cursor") from e


def parse(params: list[tuple[str, str]], export: bool = False, most_days: int = 366) -> Filters:
    """Filters of a report from a request's pairs; repeated, unknown and identifying names are refused."""
    names = [k for k, _ in params]
    if len(set(names)) != len(names):
        raise FilterError("duplicate_filter")
    for name in names:
        if name in IDENTIFYING:
            raise FilterError("identifying_filter")
        if name not in FILTERS:
            raise FilterError("unknown_filter")
    got = dict(params)
    start, end = got.get("from"), got.get("to")
    if start and end and not 0 <= (_day(end) - _day(start)).days <= most_days:
        raise FilterError("invalid_range")
    for d in (start, end):
        if d:
            _day(d)
    limit = got.get("limit", str(MOST_EXPORT_ROWS if export else DEFAULT_ROWS))
    if not re.fullmatch("[0-9]{1,6}", limit) or not 1 <= int(limit) <= (MOST_EXPORT_ROWS if export else MOST_ROWS):
        raise FilterError("invalid_limit")
    return Filters({k: got[k] for k in ("metric_name", "campaign_id", "network", "country") if k in got}, start, end, int(limit), decode_cursor(got["cursor"]) if "cursor" in got else None, got.get("include_superseded") == "true")


def metric_report(runs: DataFrame, filters: Filters) -> DataFrame:
    """A page of metric runs, without superseded ones unless they are asked for."""
    df = with_superseded_flag(runs, "metric_run_id", "supersedes_metric_run_id") if filters.include_superseded else not_superseded(runs, "metric_run_id", "supersedes_metric_run_id").withColumn("superseded", F.lit(False))
    for name, value in filters.equal.items():
        df = df.where(F.col(name) == value)
    day = F.coalesce(F.nullif("metric_date", F.lit("")), "cohort_date")
    df = df.withColumn("run_date", day)
    if filters.start:
        df = df.where(F.col("run_date") >= filters.start)
    if filters.end:
        df = df.where(F.col("run_date") <= filters.end)
    return page(df, ["metric_name", "run_date", "metric_run_id"], filters.after, filters.limit)


# Metrics that only aggregate postbacks know.
AGGREGATE_METRICS = ("skan_attributed_installs", "skan_conversion_value_distribution", "aak_attributed_installs")


def dashboard_series(rows: DataFrame) -> DataFrame:
    """One row a metric of a report page: its kind, values in order of grouping and run (null: undefined), undefined runs.

    rows is a page (``metric_report``), at most MOST_ROWS + 1 rows, which bounds the arrays.
    """
    value = F.when(F.col("value_state") == "present", F.col("value_unscaled").cast("double"))
    points = F.array_sort(F.collect_list(F.struct("grouping_digest", "metric_run_id", value.alias("value"))))
    kind = F.when(F.col("metric_name").isin(*AGGREGATE_METRICS), "aggregate").otherwise("deterministic")
    grouped = rows.groupBy("metric_name").agg(F.transform(points, lambda p: p["value"]).alias("series"), F.count_if(F.col("value_state") == "undefined").alias("undefined"))
    return grouped.withColumn("kind", kind)


def dashboard_metadata(rows: DataFrame) -> DataFrame:
    """One row of what a page rests on: distinct snapshots, zones, freshness, definition versions, bundles and policies, sorted."""
    distinct = lambda c: F.sort_array(F.collect_set(c))
    return rows.agg(
        distinct("input_snapshot_id").alias("snapshot_ids"), distinct("aggregation_time_zone").alias("aggregation_time_zones"), distinct("data_freshness").alias("freshness_states"), distinct("metric_definition_version").alias("metric_definition_versions"),
        distinct(F.concat_ws(":", "rule_bundle_id", "rule_bundle_hash")).alias("rule_bundles"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("policy_versions")))).alias("policy_versions"), F.count_if(F.col("value_state") == "undefined").alias("undefined_count"),
    )


def difference_audit(results: DataFrame) -> DataFrame:
    """Counts of reconciliation results by reason, live and replaced."""
    flagged = with_superseded_flag(results, "reconciliation_id", "supersedes_reconciliation_id")
    return flagged.groupBy("tenant_id", "app_id", "difference_reason_code").agg(F.count("*").alias("results"), F.count_if("superseded").alias("superseded"))


def record_counts(events: DataFrame, names: tuple[str, ...], by: list[str], zone: str = "UTC") -> DataFrame:
    """Events by kind, day and dimensions, with the dimensions as JSON without the missing ones."""
    day = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone)).cast("string").alias("metric_date")
    grouped = events.where(F.col("event_name").isin(*names)).groupBy(F.concat(F.lit("daily_"), "event_name", F.lit("s")).alias("metric_name"), day, *by).agg(F.count("*").alias("value"))
    return grouped.withColumn("grouping", F.to_json(F.struct(*sorted(by)))).drop(*by)


def fraud_audit(days: DataFrame, decisions: DataFrame, clicks: DataFrame) -> DataFrame:
    """Source days with their decision and the clicks it rests on; the reference is composed of day and source."""
    ref = F.concat_ws(":", F.lit("source-day"), F.col("day").cast("string"), "source")
    live = not_superseded(decisions, "decision_id", "supersedes_decision_id").select("subject_ref", "decision", "action")
    refs = clicks.groupBy("day", "source").agg(F.array_sort(F.collect_set("click_ref")).alias("click_refs"))
    return days.withColumn("subject_ref", ref).join(live, "subject_ref", "left").join(refs, ["day", "source"], "left")


def fraud_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("day").agg(
        F.count("*").alias("sources"), F.count_if(F.col("decision") == "suspected").alias("suspected"), F.count_if(F.col("action") == "exclude").alias("excluded"), F.count_if(F.col("action") == "flag").alias("flagged"), F.count_if(F.col("decision").isNull()).alias("undecided")
    )


def queue_gauges(queue: DataFrame, now) -> DataFrame:
    """Depth and oldest age in seconds of each queue."""
    return queue.where("status = 'pending'").groupBy("queue").agg(F.count("*").alias("depth"), (F.lit(now).cast("timestamp").cast("long") - F.min("enqueued_at").cast("long")).alias("oldest_s"))


def latency_histogram(samples: DataFrame, column: str, bounds: list[float], by: list[str]) -> DataFrame:
    """Cumulative counts at each bound, as scrapers read them."""
    return samples.groupBy(*by).agg(*[F.count_if(F.col(column) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds], F.count("*").alias("total"))


def gauge_lines(df: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """Text lines name{label="value"} number."""
    parts = [F.concat(F.lit(f'{label}="'), F.col(label).cast("string"), F.lit('"')) for label in labels]
    return df.select(F.concat(F.lit(name + "{"), F.concat_ws(",", *parts), F.lit("} "), F.col(value).cast("string")).alias("line"))
