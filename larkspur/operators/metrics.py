"""Metrics over cohorts of installs and days of events, exact and for all groups at once.

One definition is computed for every value of its grouping in one plan: the cohort is joined with
revenue and sessions once, and the windows of all requested days are conditional aggregates over
that join, so another day costs no further shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import canon, instants, money

from .ledger import latest_by

CALCULATIONS = ("revenue_sum", "revenue_over_cost", "active_installations_over_cohort", "revenue_over_cohort", "cohort_size", "event_count")
GROUPING = ("campaign_id", "network", "country", "cohort_date", "attribution_status", "metric_date", "source_identifier", "conversion_bucket")


# Series by name, with their event, grouping and zone (None: any).
SERIES = {
    "skan_attributed_installs": ("skan_postback", ("metric_date",), "UTC"),
    "skan_conversion_value_distribution": ("skan_postback", ("metric_date", "conversion_bucket"), "UTC"),
    "aak_attributed_installs": ("adattributionkit_postback", ("metric_date",), "UTC"),
    "daily_deep_link_opens": ("deep_link_open", ("metric_date", "campaign_id"), None),
    "daily_deep_link_opens_by_status": ("deep_link_open", ("metric_date", "campaign_id", "attribution_status"), None),
}


@dataclass(frozen=True)
class Definition:
    metric_name: str
    calculation: str
    day: int = 0
    version: str = "1.0.0"
    window: str = "elapsed"  # or calendar_day
    zone: str = "UTC"
    ratio_scale: int = 6
    fraud_policy: str = "gross"
    event_names: tuple[str, ...] = ()
    grouping: tuple[str, ...] = field(default=())

    def check(self) -> None:
        if self.calculation not in CALCULATIONS:
            raise ValueError(f"unknown calculation {self.calculation}")
        if self.window not in ("elapsed", "calendar_day") or self.zone not in ("UTC", "Asia/Tokyo"):
            raise ValueError("unknown window or zone")
        if set(self.grouping) - set(GROUPING):
            raise ValueError("unknown grouping dimension")
        if self.calculation == "event_count" and not self.event_names:
            raise ValueError("event_count needs event names")
        if self.day < 0 or self.fraud_policy not in ("gross", "net"):
            raise ValueError("invalid day or fraud policy")
        self.check_series()

    def check_series(self) -> None:
        """Series with a name of their own have one event, zone and grouping, and no other metric has theirs."""
        own = SERIES.get(self.metric_name)
        if own:
            event, grouping, zone = own
            sound = self.calculation == "event_count" and self.event_names == (event,) and sorted(self.grouping) == sorted(grouping) and self.zone == (zone or self.zone)
        else:
            sound = not set(self.event_names) & {"skan_postback", "adattributionkit_postback"} and "conversion_bucket" not in self.grouping
        if not sound:
            raise ValueError(f"metric_definition_series_mismatch:{self.metric_name}")


def registry() -> dict[str, Definition]:
    """The built-in definitions by name."""
    # Names of metrics.
    out = [
        Definition("d0_install_to_24h_ad_revenue_usd", "revenue_sum"),
        Definition("d0_utc_install_calendar_ad_revenue_usd", "revenue_sum", window="calendar_day"),
        Definition("d0_jst_install_calendar_ad_revenue_usd", "revenue_sum", window="calendar_day", zone="Asia/Tokyo"),
        Definition("cohort_install_count", "cohort_size"),
        Definition("retention_d1", "active_installations_over_cohort", 1),
        Definition("retention_d7", "active_installations_over_cohort", 7),
    ]
    for day in (0, 1, 3, 7):
        out += [Definition(f"d{day}_roas", "revenue_over_cost", day), Definition(f"cohort_ltv_d{day}_usd", "revenue_over_cohort", day)]
    out += [Definition(f"daily_{name}s", "event_count", event_names=(name,), grouping=("metric_date",)) for name in ("click", "install")]
    for name, (event, grouping, _) in SERIES.items():
        out.append(Definition(name, "event_count", event_names=(event,), grouping=grouping))
    return {d.metric_name: d for d in out}


def with_rates(revenue: DataFrame, rates: list[dict], target_scale: int) -> DataFrame:
    """revenue (currency, amount_unscaled, amount_scale) with value in the target unit; null without a rate.

    Each row is converted and rounded by itself.  rates is a policy's list on the driver, one row a
    currency; up to a thousand are broadcast, and there is one conversion for each scale of rates.
    """
    if len({r["currency"] for r in rates}) < len(rates):
        raise ValueError("a policy has one rate a currency")
    spark = revenue.sparkSession
    table = spark.createDataFrame([(r["currency"], str(r["rate_unscaled"]), int(r["rate_scale"])) for r in rates], "currency string, _rate string, _rate_scale int")
    joined = revenue.join(F.broadcast(table) if len(rates) <= 1000 else table, "currency", "left")
    value = F.lit(None).cast(money.UNITS)
    for scale in sorted({int(r["rate_scale"]) for r in rates}):
        value = F.when(F.col("_rate_scale") == scale, money.convert_scaled(F.col("amount_unscaled"), F.col("amount_scale"), F.col("_rate"), scale, target_scale)).otherwise(value)
    return joined.withColumn("value", value).drop("_rate", "_rate_scale").select(*revenue.columns, "value")


def cohort_revenue(cohort: DataFrame, revenue: DataFrame, groups: list[str], days: list[int], keys: list[str]) -> DataFrame:
    """Revenue of each group within the first day+1 days of its installs: revenue_d<day>, zero if none.

    cohort: keys, installed_ms and groups, one row an install.  revenue: keys, occurred_ms, value.
    """
    elapsed = F.col("occurred_ms") - F.col("installed_ms")
    horizon = (max(days) + 1) * instants.DAY_MS
    joined = cohort.join(revenue.select(*keys, "occurred_ms", "value"), keys).where((elapsed >= 0) & (elapsed < horizon))
    sums = joined.groupBy(*groups).agg(*[F.sum(F.when(instants.within_day(elapsed, d), F.col("value"))).alias(f"revenue_d{d}") for d in days], F.sum(F.col("value").isNull().cast("long")).alias("missing_fx"))
    size = cohort.groupBy(*groups).agg(F.count_distinct(*keys).alias("cohort_size"))
    out = size.join(sums, groups, "left")
    return out.select(*groups, "cohort_size", *[F.coalesce(f"revenue_d{d}", F.lit(0)).cast(money.UNITS).alias(f"revenue_d{d}") for d in days], F.coalesce("missing_fx", F.lit(0)).alias("missing_fx"))


def calendar_revenue(cohort: DataFrame, revenue: DataFrame, groups: list[str], zone: str, keys: list[str], day_index: int = 0) -> DataFrame:
    """Revenue on the calendar day, in a zone, that comes day_index times 24 hours after the install."""
    day = lambda c, plus=0: instants.day_in(F.timestamp_millis(F.col(c) + plus * instants.DAY_MS), zone)
    joined = cohort.withColumn("_day", day("installed_ms", day_index)).join(revenue.withColumn("_day", day("occurred_ms")).select(*keys, "_day", "value"), [*keys, "_day"])
    return joined.groupBy(*groups).agg(F.sum("value").cast(money.UNITS).alias("revenue"))


def retained(cohort: DataFrame, sessions: DataFrame, groups: list[str], days: list[int], keys: list[str]) -> DataFrame:
    """Installs of each group with a session on day N after their install: active_d<day>."""
    elapsed = F.col("occurred_ms") - F.col("installed_ms")
    flags = [F.max(instants.on_day(elapsed, d).cast("int")).alias(f"a{d}") for d in days]
    per = cohort.join(sessions.select(*keys, "occurred_ms"), keys).where((elapsed >= 0) & (elapsed < (max(days) + 1) * instants.DAY_MS)).groupBy(*keys, *[g for g in groups if g not in keys]).agg(*flags)
    active = per.groupBy(*groups).agg(*[F.sum(f"a{d}").alias(f"active_d{d}") for d in days])
    out = cohort.groupBy(*groups).agg(F.count_distinct(*keys).alias("cohort_size")).join(active, groups, "left")
    return out.select(*groups, "cohort_size", *[F.coalesce(f"active_d{d}", F.lit(0)).cast("long").alias(f"active_d{d}") for d in days])


def ratio(numerator: Column, denominator: Column, scale: int = 6) -> Column:
    """Unscaled ratio; null if the denominator is zero."""
    return money.half_even_div((money.units(numerator) * money.power_of_ten(scale)).cast(money.UNITS), money.units(denominator))


def undefined_reason(calculation: str, denominator: Column) -> Column:
    reason = "no_attributed_cost" if calculation == "revenue_over_cost" else "empty_cohort"
    return F.when(F.coalesce(denominator, F.lit(0)) == 0, reason)


def current_costs(costs: DataFrame, key: str = "cost_key_digest") -> DataFrame:
    """The latest cost record of each key; of equal as_of the largest id."""
    return latest_by(costs, [key], ["as_of", "cost_record_id"])


def cost_total(costs: DataFrame, groups: list[str], currency: str, target_scale: int, scale: int) -> DataFrame:
    amount = money.rescale(F.col("amount_unscaled"), scale, target_scale)
    return costs.groupBy(*groups).agg(F.sum(amount).cast(money.UNITS).alias("cost"), F.sum((F.col("currency") != currency).cast("long")).alias("mismatched_currency"))


def event_counts(events: DataFrame, names: tuple[str, ...], groups: list[str], zone: str = "UTC", time: str = "occurred_ms") -> DataFrame:
    """Events of the named kinds by calendar day in a zone and group; installs count once each."""
    day = instants.day_in(F.timestamp_millis(F.col(time)), zone).cast("string").alias("metric_date")
    return events.where(F.col("event_name").isin(*names)).groupBy(day, *groups).agg(F.count("*").alias("value"))


def postback_counts(postbacks: DataFrame) -> DataFrame:
    """Verified winning postbacks with a source and a value, by day of receipt in UTC, source and bucket."""
    from .ingest import conversion_bucket

    bucket = conversion_bucket(F.col("conversion_value"), F.col("coarse_conversion_value"))
    good = postbacks.where("signature_verified and did_win and source_identifier is not null").withColumn("conversion_bucket", bucket).where("conversion_bucket is not null")
    return good.groupBy(instants.day_in(F.timestamp_millis("received_ms"), "UTC").cast("string").alias("metric_date"), "source_identifier", "conversion_bucket").agg(F.count("*").alias("value"))


def latest_attribution(cohort: DataFrame, attributions: DataFrame, watermark: str | None = None) -> DataFrame:
    """cohort with the status and reason of each install's last decision (at or before a watermark)."""
    seen = attributions if watermark is None else attributions.where(F.col("decided_at") <= F.lit(watermark))
    last = latest_by(seen, ["tenant_id", "app_id", "subject_ref"], ["decided_at", "attribution_id"])
    last = last.select("tenant_id", "app_id", F.col("subject_ref").alias("installation_id"), F.col("status").alias("attribution_status"), F.col("reason_code").alias("attribution_reason"))
    return cohort.join(last, ["tenant_id", "app_id", "installation_id"], "left")


def net(cohort: DataFrame, policy: str) -> DataFrame:
    """All installs for gross, those whose last decision is no fraud exclusion for net."""
    return cohort if policy == "gross" else cohort.where(~F.col("attribution_reason").eqNullSafe(F.lit("fraud_excluded")))


def snapshot(records: DataFrame, scope: list[str]) -> DataFrame:
    """Digest, size, position and reproducibility of the input records of each scope.

    The digest is over the rows (received_at, record_id, lifecycle, policy_digest) in that order.  Rows
    are sorted within a scope by Spark and hashed as they stream by: a task holds one row, however
    large a scope is.
    """
    fields = ("received_at", "record_id", "lifecycle_status", "policy_digest")
    kinds = dict(records.dtypes)
    names = [*scope, "input_snapshot_digest", "record_count", "ledger_position", "reproducibility"]

    def run(batches):
        key, now, count, position, states = None, None, 0, "", set()

        def done():
            now.update(b"]")
            status = "redaction_affected" if "redacted" in states else "retention_affected" if states - {"available"} else "reproducible"
            return (*key, now.hexdigest(), count, position, status)

        types = None
        for batch in batches:
            types = types or [batch.schema.field(i).type for i in range(len(scope))]
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[: len(scope)] != key:
                    if key is not None:
                        out.append(done())
                    key, now, count, states = row[: len(scope)], hashlib.sha256(b"["), 0, set()
                values = row[len(scope) :]
                now.update((b"," if count else b"") + json.dumps(values, separators=(",", ":"), ensure_ascii=False).encode())
                count, position = count + 1, f"{values[0]}:{values[1]}"
                states.add(values[2])
            if out:
                yield _batch(out, types, names)
        if key is not None:
            yield _batch([done()], types, names)

    sorted_rows = records.select(*scope, *fields).repartition(*scope).sortWithinPartitions(*scope, *fields)
    return sorted_rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in scope), "input_snapshot_digest string", "record_count long", "ledger_position string", "reproducibility string"]))


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    kinds = [*types, pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def evidence_rows(records: DataFrame, scope: list[str], ref: str = "record_id") -> DataFrame:
    """(scope, ref): the evidence of each scope as rows, of any number."""
    return records.select(*scope, F.col(ref).alias("ref")).distinct()


def evidence(records: DataFrame, scope: list[str], ref: str = "record_id") -> DataFrame:
    """Evidence as one sorted array a scope, for the artefact of a metric run; ``evidence_rows`` has no bound."""
    return records.groupBy(*scope).agg(F.sort_array(F.collect_set(ref)).alias("evidence_refs"))


def visible(records: DataFrame, states: DataFrame, watermark: str, privacy_state: str = "before", scope: tuple[str, ...] = ("tenant_id", "app_id")) -> DataFrame:
    """The records that a run with an input watermark reads: received at or before it, with their lifecycle_status.

    ``states`` (scope, record_id, state_seq, lifecycle_status) is an append-only ledger; a record without
    a state is available.  Before a deletion all records count, as available; after it those that still are.
    """
    if privacy_state not in ("before", "after"):
        raise ValueError("privacy state is before or after")
    seen = records.where(F.col("received_at") <= F.lit(watermark))
    if privacy_state == "before":
        return seen.withColumn("lifecycle_status", F.lit("available"))
    last = latest_by(states.select(*scope, "record_id", "state_seq", "lifecycle_status"), [*scope, "record_id"], ["state_seq"]).drop("state_seq")
    return seen.join(last, [*scope, "record_id"], "left").withColumn("lifecycle_status", F.coalesce("lifecycle_status", F.lit("available"))).where("lifecycle_status = 'available'")


def grouping_columns() -> dict[str, Column]:
    """Grouping dimensions of an event: its own field, then the resolved link's, then the import context's."""
    return {
        "campaign_id": F.coalesce("campaign_id", "link_campaign_id", "provider_campaign_ref"),
        "network": F.coalesce("network", "ad_network", "provider_network"),
        "country": F.coalesce("country", "provider_country"),
    }


def matching(events: DataFrame, grouping: dict[str, str], statuses: DataFrame | None = None) -> DataFrame:
    """The events that a metric's grouping selects.

    The cohort date binds installs only; the attribution status binds installs and deep-link opens, by
    their latest decision (tenant_id, app_id, subject_ref, status).
    """
    own = grouping_columns()
    test = F.lit(True)
    for name in ("campaign_id", "network", "country"):
        if name in grouping:
            test = test & own[name].eqNullSafe(F.lit(grouping[name]))
    installed = F.col("event_name") == "install"
    if "cohort_date" in grouping:
        day = instants.day_in(instants.instant(F.col("occurred_at")), "UTC").cast("string")
        test = test & (~installed | (day == grouping["cohort_date"]))
    df = events.where(test)
    if "attribution_status" not in grouping:
        return df
    subject = F.when(installed, F.col("installation_id")).when(F.col("event_name") == "deep_link_open", F.concat(F.lit("engagement:"), "record_id"))
    known = statuses.select("tenant_id", "app_id", F.col("subject_ref").alias("_subject"), F.col("status").alias("_status"))
    joined = df.withColumn("_subject", subject).join(known, ["tenant_id", "app_id", "_subject"], "left")
    return joined.where(F.col("_subject").isNull() & ~installed & (F.col("event_name") != "deep_link_open") | F.col("_status").eqNullSafe(F.lit(grouping["attribution_status"]))).select(*events.columns)


def scoped_costs(costs: DataFrame, cohort: DataFrame, watermark: str, grouping: dict[str, str] | None = None) -> DataFrame:
    """The current cost records of the tenants and apps that have installs in the cohort (of all, if it is empty).

    Only costs known at the watermark and of the grouping count; a grouping by another status than
    non_organic has no cost.
    """
    grouping = grouping or {}
    known = costs.where(F.col("as_of") <= F.lit(watermark))
    for name, column in (("campaign_id", "campaign_id"), ("network", "network"), ("country", "country"), ("cohort_date", "date")):
        if name in grouping:
            known = known.where(F.col(column) == grouping[name])
    if grouping.get("attribution_status", "non_organic") != "non_organic":
        known = known.where("false")
    scopes = cohort.select("tenant_id", "app_id").distinct()
    if scopes.head(1):
        known = known.join(scopes, ["tenant_id", "app_id"], "left_semi")
    return latest_by(known, ["tenant_id", "app_id", "cost_key_digest"], ["as_of", "cost_record_id"])


def aggregate_attribution(records: DataFrame, attributions: DataFrame, watermark: str) -> DataFrame:
    """records with the latest aggregate decision, known at the watermark, whose evidence names them; others go.

    Containment becomes an equi-join over exploded evidence; a record keeps one decision.
    """
    named = attributions.where((F.col("subject_scope") == "aggregate") & (F.col("decided_at") <= F.lit(watermark))).select("tenant_id", "app_id", F.explode(F.array_distinct("evidence_refs")).alias("record_id"), "decided_at", "attribution_id", "status", "reason_code")
    last = latest_by(named, ["tenant_id", "app_id", "record_id"], ["decided_at", "attribution_id"])
    return records.join(last.select("tenant_id", "app_id", "record_id", F.col("status").alias("attribution_status"), F.col("reason_code").alias("attribution_reason")), ["tenant_id", "app_id", "record_id"])


def replay_manifests(runs: DataFrame) -> DataFrame:
    """How each run is computed again: (tenant_id, app_id, source_metric_run_id, metric_replay_manifest_id, created_at, artifact).

    runs: metric_run_id, metric_name, computed_at, and as JSON texts metric_definition, evaluation and
    fx_policy.  The id is a digest of the artefact, so a run has one manifest however often it is written.
    """
    plain = {"version": F.lit(1), "source_metric_run_id": F.col("metric_run_id"), "metric_names": F.array("metric_name"), **{c: canon.canonical_text(F.col(c)) for c in ("metric_definition", "evaluation", "fx_policy")}}
    artifact = canon.canonical_json(plain)
    return runs.select("tenant_id", "app_id", F.col("metric_run_id").alias("source_metric_run_id"), F.concat(F.lit("metric-replay:"), F.substring(F.sha2(artifact, 256), 1, 48)).alias("metric_replay_manifest_id"), F.col("computed_at").alias("created_at"), artifact.alias("artifact")).dropDuplicates(["tenant_id", "app_id", "source_metric_run_id"])


def replays(manifests: DataFrame, evidence: DataFrame, records: DataFrame) -> DataFrame:
    """The manifests whose run has evidence (metric_run_id, ref) among the records (record_id) of a deletion."""
    hit = evidence.join(records.select(F.col("record_id").alias("ref")).distinct(), "ref", "left_semi").select(F.col("metric_run_id").alias("source_metric_run_id")).distinct()
    return manifests.join(hit, "source_metric_run_id", "left_semi")


def evaluations(config: dict, day: str, watermark: str | None = None) -> list[dict]:
    """The evaluations of a definitions file for a day: run-id prefix, watermark, names and grouping of each.

    Without a watermark the last millisecond of the day (UTC) is taken.
    """
    if not config.get("fx_policy") or not config.get("evaluations"):
        raise ValueError("definitions file requires fx_policy and at least one evaluation")
    at = watermark or f"{date.fromisoformat(day).isoformat()}T23:59:59.999Z"
    out = []
    for i, e in enumerate(config["evaluations"]):
        if not e.get("metric_names") or not all(isinstance(n, str) for n in e["metric_names"]):
            raise ValueError(f"evaluation {i} requires metric_names")
        if not isinstance(e.get("grouping"), dict):
            raise ValueError(f"evaluation {i} requires grouping")
        seed = [config, i] if watermark is None else [config, i, watermark]
        out.append({"metric_run_id_prefix": f"manual:{day}:{canon.config_digest(seed)[:24]}", "input_received_at_watermark": at, "computed_at": at, "privacy_state": "before", "metric_names": list(e["metric_names"]), "grouping": {"cohort_date": day, **e["grouping"]}})
    return out


def definition_file(spark, path: str, day: str, watermark: str | None = None) -> dict:
    """The definitions file at a path (read by Spark, so of any store): its scope, rates' policy and the evaluations of a day."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a definitions file is one file")
    config = json.loads(rows[0][0])
    for name in ("tenant_id", "app_id"):
        if not isinstance(config.get(name), str) or not re.fullmatch(r"[A-Za-z0-9._:-]{1,128}", config[name]):
            raise ValueError(f"{name} is invalid")
    return {"tenant_id": config["tenant_id"], "app_id": config["app_id"], "fx_policy": config.get("fx_policy"), "metric_definitions": config.get("metric_definitions", []), "evaluations": evaluations(config, day, watermark)}


def runs(values: DataFrame, definition: Definition, watermark: str, prefix: str, previous: DataFrame | None = None) -> DataFrame:
    """Metric-run rows from values (grouping columns, value): ids by digest, superseding earlier runs of the group."""
    definition.check()
    groups = [c for c in values.columns if c in GROUPING]
    fields = {c: F.col(c).cast("string") for c in groups}
    grouped = canon.digest(fields) if fields else F.sha2(F.lit("{}"), 256)
    out = values.withColumn("grouping_digest", grouped).withColumn("metric_name", F.lit(definition.metric_name)).withColumn("definition_version", F.lit(definition.version)).withColumn("watermark", F.lit(watermark))
    out = out.withColumn("metric_run_id", F.concat(F.lit(f"{prefix}:{definition.metric_name}:"), F.substring("grouping_digest", 1, 24)))
    out = out.withColumn("value_state", F.when(F.col("value").isNull(), "undefined").otherwise("present"))
    if previous is None:
        return out.withColumn("supersedes_metric_run_id", F.lit(None).cast("string"))
    old = previous.where(F.col("metric_name") == definition.metric_name).select("grouping_digest", F.col("metric_run_id").alias("supersedes_metric_run_id"))
    return out.join(old, "grouping_digest", "left")
