"""Fraud rules over clicks, installs and source days, with parameters from a rule bundle."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import canon, instants

from .publication import quantiles


SCOPE = ("tenant_id", "app_id")


# The conservative defaults of the base layer.
BASE = {
    "ctit_lower_bound_seconds": 10,
    "ctit_negative_rate_threshold": 0.05,
    "referrer_redirector_divergence_seconds": 300,
    "source_day_min_clicks": 1000,
    "source_day_cvr_median_multiplier": 0.2,
    "source_day_ctit_p50_min_seconds": 86400,
    "source_day_ctit_p95_p50_max_ratio": 3,
    "quarantine_hours": 72,
}
# Rules with what they read and what they do.
RULES = [
    ("transport-bot-prefetch-v1", ["prefetch_signal"], "exclude"),
    ("transport-replay-v1", ["replay_signal"], "exclude"),
    ("referrer-server-order-v1", ["referrer_click_at_server", "install_begin_at_server"], "flag"),
    ("ctit-lower-bound-v1", ["redirector_click_at", "install_begin_at_server"], "flag"),
    ("ctit-clock-anomaly-v1", ["redirector_click_at", "install_begin_at_server"], "allow"),
    ("referrer-redirector-divergence-v1", ["referrer_click_at_server", "redirector_click_at"], "flag"),
    ("source-day-click-flooding-v1", ["source_day_aggregate"], "flag"),
    ("device-integrity-combination-v1", ["integrity_verdict", "ctit"], "flag"),
]
ACTIONS = ("allow", "flag", "exclude", "quarantine")
BUNDLE_ID, RULE_ID, DIGEST = "^[A-Za-z0-9._:-]{1,128}$", "^[a-z][a-z0-9-]{2,127}$", "^[a-f0-9]{64}$"


@dataclass(frozen=True)
class Bundle:
    """Versioned parameters (layers) and rules; ``registered`` checks and hashes stored revisions in Spark."""

    id: str = "fraud-conservative"
    version: str = "1.0.0"
    layers: dict[str, dict[str, Any]] = field(default_factory=lambda: {"base": dict(BASE)})
    rules: list[dict[str, Any]] = field(default_factory=lambda: [{"id": i, "inputs": list(inputs), "action": action} for i, inputs, action in RULES])

    def number(self, name: str) -> float:
        value = self.layers["base"].get(name)
        usable = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
        return float(value if usable else BASE[name])

    def action(self, rule: str, fallback: str = "flag") -> str:
        return next((r["action"] for r in self.rules if r["id"] == rule), fallback)

    def check(self) -> None:
        if not re.fullmatch(BUNDLE_ID, self.id):
            raise ValueError("fraud_bundle_id_invalid")
        if not 1 <= len(self.version) <= 128:
            raise ValueError("fraud_bundle_version_invalid")
        if not isinstance(self.layers.get("base"), dict):
            raise ValueError("fraud_bundle_layers_invalid")
        if not self.rules:
            raise ValueError("fraud_bundle_rules_invalid")
        private = self.layers.get("private")
        if private is not None and (list(private) != ["digest"] or not re.fullmatch(DIGEST, str(private["digest"]))):
            raise ValueError("fraud_bundle_private_layer_must_be_digest_only")
        for rule in self.rules:
            if not re.fullmatch(RULE_ID, rule["id"]) or not isinstance(rule["inputs"], list) or rule["action"] not in ACTIONS:
                raise ValueError(f"fraud_bundle_rule_invalid:{rule['id']}")
            if rule["inputs"] and set(rule["inputs"]) == {"integrity_verdict"}:
                raise ValueError(f"integrity_only_rule_forbidden:{rule['id']}")

    def hash(self) -> str:
        self.check()
        return canon.config_digest({"id": self.id, "version": self.version, "layers": self.layers, "rules": self.rules})


def _quoted(name: str) -> Column:
    """A text column as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(F.col(name).alias("v"))), r'^\{"v":(.*)\}$', 1)


def registered(revisions: DataFrame) -> DataFrame:
    """Stored revisions (id, version, layers and rules as JSON texts) with their error, or hash and private digest.

    The same checks in the same order as ``Bundle.check``, as columns: one error a revision, null if it is sound.
    """
    layers, rules = F.try_parse_json("layers"), F.from_json("rules", "array<struct<id:string,inputs:array<string>,action:string>>")
    text = lambda v, path: F.try_variant_get(v, path, "string")
    bad = lambda r: ~F.coalesce(r["id"].rlike(RULE_ID), F.lit(False)) | r["inputs"].isNull() | ~F.coalesce(r["action"].isin(*ACTIONS), F.lit(False))
    alone = lambda r: (F.size(r["inputs"]) > 0) & F.forall(r["inputs"], lambda i: i == "integrity_verdict")
    private = F.map_keys(F.from_json(F.col("_private"), "map<string,string>"))
    error = (
        F.when(~F.coalesce(F.col("id").rlike(BUNDLE_ID), F.lit(False)), "fraud_bundle_id_invalid")
        .when(~F.coalesce(F.length("version").between(1, 128), F.lit(False)), "fraud_bundle_version_invalid")
        .when(~F.coalesce(F.col("_base").startswith("{"), F.lit(False)), "fraud_bundle_layers_invalid")
        .when(F.coalesce(F.size("_rules"), F.lit(0)) < 1, "fraud_bundle_rules_invalid")
        .when(F.col("_private").isNotNull() & ~F.coalesce((private == F.array(F.lit("digest"))) & F.col("_digest").rlike(DIGEST), F.lit(False)), "fraud_bundle_private_layer_must_be_digest_only")
        .when(F.col("_wrong").isNotNull(), F.concat(F.when(bad(F.col("_wrong")), "fraud_bundle_rule_invalid:").otherwise("integrity_only_rule_forbidden:"), F.coalesce("_wrong.id", F.lit("null"))))
    )
    body = F.concat(F.lit('{"id":'), _quoted("id"), F.lit(',"layers":'), canon.canonical_text(F.col("layers")), F.lit(',"rules":'), canon.canonical_text(F.col("rules")), F.lit(',"version":'), _quoted("version"), F.lit("}"))
    df = revisions.withColumns({"_base": text(layers, "$.base"), "_private": text(layers, "$.private"), "_digest": text(layers, "$.private.digest"), "_rules": rules})
    df = df.withColumn("_wrong", F.get(F.filter("_rules", lambda r: bad(r) | alone(r)), F.lit(0))).withColumn("error", error)
    return df.withColumn("bundle_hash", F.when(F.col("error").isNull(), F.sha2(body, 256))).withColumn("private_layer_digest", F.when(F.col("error").isNull(), F.col("_digest"))).drop("_base", "_private", "_digest", "_rules", "_wrong")


def policy_digest(policy: dict[str, Any]) -> str:
    return canon.config_digest({k: v for k, v in policy.items() if k != "policy_digest"})


def _hit(test: Column, rule: str, decision: str, action: str, reason: str) -> Column:
    return F.when(test, F.struct(F.lit(rule).alias("rule_id"), F.lit(decision).alias("decision"), F.lit(action).alias("action"), F.lit(reason).alias("reason_code")))


def transport(clicks: DataFrame, bundle: Bundle | None = None) -> DataFrame:
    """A hit for each click that was prefetched by a bot, else for each that looks replayed."""
    b = bundle or Bundle()
    hit = F.coalesce(
        _hit(F.col("bot_prefetch"), "transport-bot-prefetch-v1", "confirmed", b.action("transport-bot-prefetch-v1"), "bot_prefetch"),
        _hit(F.col("replay_suspected"), "transport-replay-v1", "suspected", b.action("transport-replay-v1"), "replay_suspected"),
    )
    return clicks.withColumn("h", hit).where("h is not null").select("tenant_id", "app_id", "record_id", "h.*")


def install_hits(
    install_begin_ms: Column, click_ms: Column, referrer_ms: Column, referrer_status: Column, threshold_seconds: float | None = None, bundle: Bundle | None = None
) -> Column:
    """Array of rule hits of an install; a negative click-to-install time is a diagnostic and ends it."""
    b = bundle or Bundle()
    lower = (b.number("ctit_lower_bound_seconds") if threshold_seconds is None else threshold_seconds) * 1000
    delta = install_begin_ms - click_ms
    order = _hit((referrer_status == "available") & (referrer_ms >= install_begin_ms + 1000), "referrer-server-order-v1", "confirmed", b.action("referrer-server-order-v1"), "referrer_time_inconsistent")
    anomaly = _hit(delta < 0, "ctit-clock-anomaly-v1", "clear", "allow", "ctit_clock_anomaly")
    fast = _hit((delta >= 0) & (delta < lower), "ctit-lower-bound-v1", "suspected", b.action("ctit-lower-bound-v1"), "click_injection_suspected")
    far = _hit((delta >= 0) & (F.abs(referrer_ms - click_ms) > b.number("referrer_redirector_divergence_seconds") * 1000), "referrer-redirector-divergence-v1", "suspected", b.action("referrer-redirector-divergence-v1"), "referrer_time_inconsistent")
    return F.filter(F.array(order, anomaly, fast, far), lambda h: h.isNotNull())


def install_rules(installs: DataFrame, bundle: Bundle | None = None) -> DataFrame:
    """One row a hit, for installs with click_at, install_begin_at_server, referrer_click_at_server(_status) as canonical text."""
    hits = install_hits(*(instants.millis(F.col(c)) for c in ("install_begin_at_server", "click_at", "referrer_click_at_server")), F.col("referrer_click_at_server_status"), bundle=bundle)
    return installs.select("tenant_id", "app_id", "record_id", F.explode(hits).alias("h")).select("tenant_id", "app_id", "record_id", "h.*")


def source_days(clicks: DataFrame, installs: DataFrame, sources: list[str], scope: tuple[str, ...] = SCOPE) -> DataFrame:
    """Clicks, installs and click-to-install times of each tenant, app, source and day.

    clicks: tenant_id, app_id, click_id, day, clicked_ms and the source columns; installs: tenant_id,
    app_id, click_id, install_id, installed_ms.  Sources without a value are one group 'unattributed'.  Percentiles are
    exact, whatever the size of a group, and rounded half to even.
    """
    named = [F.coalesce(F.col(s), F.lit("unattributed")).alias(s) for s in sources]
    joined = clicks.select(*scope, "click_id", "day", "clicked_ms", *named).join(installs.select(*scope, "click_id", "install_id", "installed_ms"), [*scope, "click_id"], "left").withColumn("ctit", F.col("installed_ms") - F.col("clicked_ms"))
    days = joined.groupBy(*scope, "day", *sources).agg(F.count_distinct("click_id").alias("clicks"), F.count_distinct("install_id").alias("installs"), F.expr("count(distinct install_id) filter (where ctit < 0)").alias("ctit_negative_count"))
    groups = [*scope, "day", *sources]
    times = quantiles(joined.where("ctit >= 0"), groups, "ctit", {"ctit_p05_ms": 0.05, "ctit_p50_ms": 0.5, "ctit_p95_ms": 0.95})
    met = days.alias("d").join(times.alias("q"), [F.col(f"d.{g}").eqNullSafe(F.col(f"q.{g}")) for g in groups], "left")
    return met.select("d.*", *[F.bround(f"q.{c}").cast("long").alias(c) for c in ("ctit_p05_ms", "ctit_p50_ms", "ctit_p95_ms")])


def with_median_rate(days: DataFrame, scope: tuple[str, ...] = SCOPE) -> DataFrame:
    """days with the median conversion rate of all sources of a tenant's app on the day.

    Rates are one row a source and day; the medians, one row a scope and day, are joined back.
    """
    rated = days.withColumn("cvr", F.col("installs") / F.col("clicks"))
    return rated.join(rated.groupBy(*scope, "day").agg(F.expr("percentile_cont(0.5) within group (order by cvr)").alias("median_cvr")), [*scope, "day"])


def flooding(days: DataFrame, bundle: Bundle | None = None) -> DataFrame:
    """Source days that look flooded: many clicks, few installs, late and even click-to-install times."""
    b = bundle or Bundle()
    test = (
        (F.col("clicks") >= b.number("source_day_min_clicks"))
        & (F.col("installs") / F.col("clicks") <= F.col("median_cvr") * b.number("source_day_cvr_median_multiplier"))
        & (F.col("ctit_p50_ms") >= b.number("source_day_ctit_p50_min_seconds") * 1000)
        & (F.col("ctit_p95_ms") / F.col("ctit_p50_ms") <= b.number("source_day_ctit_p95_p50_max_ratio"))
    )
    return days.where(test).withColumn("rule_id", F.lit("source-day-click-flooding-v1")).withColumn("reason_code", F.lit("click_flooding_suspected")).withColumn("action", F.lit(b.action("source-day-click-flooding-v1")))


def negative_rates(days: DataFrame, bundle: Bundle | None = None, scope: tuple[str, ...] = SCOPE) -> DataFrame:
    """Share of negative click-to-install times of a tenant's app and day over all sources, and whether the clock guard steps in."""
    b = bundle or Bundle()
    totals = days.groupBy(*scope, "day").agg(F.sum("ctit_negative_count").alias("negative"), F.sum("installs").alias("installs"))
    rate = F.when(F.col("installs") > 0, F.col("negative") / F.col("installs")).otherwise(0.0)
    return totals.withColumn("negative_rate", rate).withColumn("guarded", F.col("negative_rate") > b.number("ctit_negative_rate_threshold"))


def quarantine_until(decided_ms: Column, bundle: Bundle | None = None) -> Column:
    return decided_ms + F.lit(int((bundle or Bundle()).number("quarantine_hours") * 3_600_000))


def expired(quarantines: DataFrame, now_ms: int) -> DataFrame:
    """Quarantines whose deadline has come."""
    return quarantines.where(F.col("until_ms") <= F.lit(now_ms))


def resolutions(decisions: DataFrame, quarantines: DataFrame, now_ms: int) -> DataFrame:
    """The decision that ends each quarantine whose deadline has come: clear, allow, superseding the quarantined one.

    decisions: fraud_decision_id and what a decision has; quarantines: fraud_decision_id, until_ms.  The new id follows from
    the old one and the time, so a batch that runs again appends the same rows.
    """
    due = expired(quarantines, now_ms).select(*SCOPE, "fraud_decision_id").distinct()
    old, now = F.col("fraud_decision_id"), F.lit(now_ms).cast("long")
    ended = decisions.drop("supersedes_fraud_decision_id", "resolution_deadline_at", "quarantine_until").join(due, [*SCOPE, "fraud_decision_id"])
    return ended.withColumns({"supersedes_fraud_decision_id": old, "fraud_decision_id": F.concat(F.lit("fraud:"), canon.uuid_v7(now, old)), "decision": F.lit("clear"), "action": F.lit("allow"), "evaluated_at": instants.canonical(F.timestamp_millis(now))})


def active_bundles(revisions: DataFrame, scope: list[str]) -> DataFrame:
    """The revision of each scope that no other supersedes; evaluation raises for a scope with none or several."""
    from .ledger import not_superseded

    live = not_superseded(revisions, "revision_id", "supersedes_revision_id")
    counted = live.groupBy(*scope).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in live.columns if c not in scope])
    every = revisions.select(*scope).distinct().join(counted, scope, "left")
    return every.where(F.assert_true(F.coalesce("n", F.lit(0)) == 1, F.lit("fraud_bundle_not_unique")).isNull()).drop("n").select(*live.columns)


def install_fraud(installs: DataFrame, clicks: DataFrame, bundle: Bundle | None = None) -> DataFrame:
    """Decisions of the install rules with the click that an install names, if one usable click has its id.

    A click with an invalid time, or without one, is not usable.  installs: tenant_id, app_id,
    record_id, click_id, received_at, install_begin_at_server, referrer_click_at_server(_status).
    """
    b = bundle or Bundle()
    usable = clicks.where("click_id is not null and redirector_click_at is not null and coalesce(redirector_time_status, '') <> 'invalid'")
    one = usable.groupBy(*SCOPE, "click_id").agg(F.count("*").alias("n"), F.first(F.struct("record_id", "redirector_click_at")).alias("c")).where("n = 1").select(*SCOPE, "click_id", F.col("c.record_id").alias("click_record_id"), F.col("c.redirector_click_at").alias("click_at"))
    joined = installs.join(one, [*SCOPE, "click_id"], "left")
    hits = install_hits(*(instants.millis(F.col(c)) for c in ("install_begin_at_server", "click_at", "referrer_click_at_server")), F.col("referrer_click_at_server_status"), bundle=b)
    df = joined.select(*SCOPE, "record_id", "received_at", "click_record_id", F.explode(hits).alias("h")).select(*SCOPE, "record_id", "received_at", "click_record_id", "h.*")
    name = F.when(F.col("rule_id") == "ctit-lower-bound-v1", "click-injection").otherwise(F.col("rule_id"))
    until = F.when(F.col("action") == "quarantine", instants.canonical(F.timestamp_millis(quarantine_until(instants.millis(F.col("received_at")), b))))
    return df.select(
        *SCOPE, F.concat(F.lit("fraud:"), "record_id", F.lit(":"), name).alias("fraud_decision_id"), F.col("record_id").alias("subject_ref"), "rule_id", "decision", "action", "reason_code", F.col("received_at").alias("evaluated_at"), until.alias("quarantine_until"),
        canon.digest_array([F.col("rule_id"), F.coalesce("click_record_id", F.lit("no-redirector-click")), F.col("record_id")]).alias("evidence_digest"),
    )


def clock_guard(attributions: DataFrame, installs: DataFrame, clicks: DataFrame, days: DataFrame, bundle: Bundle | None = None) -> DataFrame:
    """Provisional attributions of installs whose click fell on a day with too many negative click-to-install times.

    days: tenant_id, app_id, day, installs, ctit_negative_count, input_snapshot_id, computed_at, one row
    a source.  A decision that rests on a click of such a day, and that nothing supersedes, is
    superseded by a provisional one.  Days are narrowed first, so only their clicks are joined.
    """
    from .ledger import not_superseded

    guarded = negative_rates(days, bundle).where("guarded").select(*SCOPE, "day")
    snapshot = days.groupBy(*SCOPE, "day").agg(F.sha2(F.to_json(F.sort_array(F.collect_list("input_snapshot_id"))), 256).alias("snapshot"), F.max("computed_at").alias("computed_at"))
    guarded = guarded.join(snapshot, [*SCOPE, "day"])
    hit = clicks.where("click_id is not null").withColumn("day", F.substring("redirector_click_at", 1, 10)).join(guarded, [*SCOPE, "day"]).groupBy(*SCOPE, "click_id", "day").agg(F.first("snapshot").alias("snapshot"), F.first("computed_at").alias("computed_at"))
    subjects = installs.where("click_id is not null").select(*SCOPE, F.col("installation_id").alias("subject_ref"), "click_id").join(hit, [*SCOPE, "click_id"])
    live = not_superseded(attributions, "attribution_id", "supersedes_attribution_id").where("reason_code = 'valid_install_referrer'")
    new = live.join(subjects.drop("click_id"), [*SCOPE, "subject_ref"])
    new = new.withColumn("supersedes_attribution_id", F.col("attribution_id")).withColumn("attribution_id", F.concat("attribution_id", F.lit(":ctit-clock-provisional:"), F.substring("snapshot", 1, 12)))
    return new.withColumn("decided_at", F.col("computed_at")).withColumn("finality", F.lit("provisional")).select(*attributions.columns)
