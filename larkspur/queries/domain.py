"""Ingestion, attribution, metrics, fraud, reconciliation, privacy, imports and reports over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import instants, money
from larkspur.operators import attribution, fraud, ingest, ledger, metrics, privacy, reconcile
from larkspur.plans import reporting
from larkspur.sources import connectors, mapping

from .base import RATES, half_even_sql, query


def attempts(t) -> DataFrame:
    """Delivery attempts made from events: some are sent twice, altered, late, out of scope or withdrawn."""
    at = instants.canonical(F.timestamp_millis("ms"))
    e = t.base().select("*", at.alias("occurred_at"), instants.canonical(F.timestamp_millis(F.col("ms") + 1000)).alias("received_at"))
    payload = lambda v: F.to_json(F.struct(F.col("user_id").cast("string").alias("installation_id"), v.alias("cents")))
    purpose = F.array(F.struct(F.lit("p").alias("processing_purpose_id"), (F.col("event_id") % 2 == 0).alias("consent_required"), F.lit("v1").alias("policy_version")))
    withdrawn = F.array(F.struct(F.lit("p").alias("processing_purpose_id"), F.lit("2024-01-01T00:00:00.000Z").alias("withdrawal_recognized_at"), F.lit(9000).cast("long").alias("withdrawal_recognized_sequence")))
    none = F.array().cast("array<struct<alternative_legal_basis_id:string,processing_purpose_id:string,effective_at:string,policy_version:string>>")

    def sent(df, tag, v, received):
        return df.select(
            F.lit("t").alias("tenant_id"), F.lit("a").alias("app_id"), F.lit("d").alias("policy_digest"),
            F.concat(F.when(F.col("event_id") % 97 == 0, F.lit("same")).otherwise(F.lit(tag)), F.lit(":"), "event_id").alias("record_id"), F.concat(F.lit(f"{tag}:"), "event_id").alias("delivery_id"),
            F.when(F.col("event_id") % 89 == 0, "other").otherwise("t").alias("record_tenant_id"), F.lit("a").alias("record_app_id"), F.lit("sdk").alias("producer"), F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("event_name"), F.lit("1").alias("schema_version"),
            F.when(F.col("event_id") % 83 == 0, "2024-02-30T00:00:00.000Z").otherwise(F.col("occurred_at")).alias("occurred_at"), received.alias("received_at"), (F.col("event_id") % 10 == 0).alias("late"), F.when(F.col("event_id") % 79 == 0, "aggregate").otherwise("installation_level").alias("subject_scope"),
            F.lit("p").alias("processing_purpose_id"), F.col("event_id").alias("processing_sequence"), F.lit(None).cast("string").alias("alternative_legal_basis_id"), payload(v).alias("payload"), purpose.alias("purposes"), withdrawn.alias("withdrawals"), none.alias("bases"), F.lit("2024-01-02T00:00:00.000Z").alias("stale_before"),
        )

    later = instants.canonical(F.timestamp_millis(F.col("ms") + 2000))
    again = e.where("event_id % 7 = 0")
    return sent(e, "a", F.col("cents"), F.col("received_at")).unionByName(sent(again, "b", F.when(F.col("event_id") % 2 == 0, F.col("cents")).otherwise(F.col("cents") + 1), later))


SENT = """
sent AS (
  SELECT event_id, 'a' AS tag, 0 AS turn, ms, cents, event_type FROM base UNION ALL SELECT event_id, 'b', 1, ms, cents + event_id % 2, event_type FROM base WHERE event_id % 7 = 0
), decided AS (
  SELECT *, tag || ':' || event_id AS delivery_id,
    CASE WHEN event_id % 83 = 0 THEN 'unique' WHEN event_id % 97 = 0 AND event_id % 7 = 0 THEN 'record_id_collision' WHEN turn = 0 THEN 'unique' WHEN event_id % 2 = 0 THEN 'duplicate_delivery' ELSE 'event_id_conflict' END AS resolution FROM sent
), final AS (
  SELECT *, CASE WHEN event_id % 83 = 0 THEN 'timestamp_invalid' WHEN event_id % 89 = 0 THEN 'client_scope_mismatch' WHEN resolution = 'record_id_collision' THEN 'record_id_collision'
    WHEN event_id % 2 = 0 AND event_id >= 9000 THEN 'consent_withdrawn' WHEN ms < 1704153600000 THEN 'timestamp_stale' WHEN event_id % 79 = 0 THEN 'aggregate_installation_join_forbidden' WHEN resolution = 'event_id_conflict' THEN 'event_id_conflict' END AS reason FROM decided
)
"""


def _sent(sql: str) -> str:
    from .base import CTES

    return f"WITH base AS ({CTES['base']}), {SENT} {sql}"


@query("d5_ingestion_decisions", _sent("SELECT delivery_id, resolution AS duplicate_resolution, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS ingestion_status, reason AS reason_code, CASE WHEN event_id % 10 = 0 AND event_id % 83 <> 0 THEN 'late' ELSE 'on_time' END AS timeliness, CASE WHEN reason IS NULL OR reason = 'event_id_conflict' THEN 'protected' ELSE 'discarded' END AS payload_disposition FROM final"))
def _(t):
    return ingest.decide(attempts(t)).select("delivery_id", "duplicate_resolution", "ingestion_status", "reason_code", "timeliness", "payload_disposition")


@query("d2_record_collisions", _sent("SELECT delivery_id, reason FROM final WHERE resolution = 'record_id_collision'"))
def _(t):
    return ingest.decide(attempts(t)).where("duplicate_resolution = 'record_id_collision'").select("delivery_id", F.col("reason_code").alias("reason"))


@query("d3_duplicates_and_conflicts", _sent("SELECT resolution, CAST(count(*) AS BIGINT) AS n FROM final GROUP BY resolution"))
def _(t):
    return ingest.decide(attempts(t)).groupBy(F.col("duplicate_resolution").alias("resolution")).agg(F.count("*").alias("n"))


@query("d4_consent", _sent("SELECT delivery_id, CASE WHEN event_id % 2 = 1 THEN 'consent_not_required' WHEN event_id < 9000 THEN 'consent_valid_before_withdrawal' ELSE 'consent_withdrawn' END AS consent_reason FROM final"))
def _(t):
    return ingest.with_consent(attempts(t)).select("delivery_id", "consent_reason")


@query("d9_canonical_records", _sent("SELECT delivery_id, CASE WHEN event_id % 83 <> 0 AND resolution IN ('unique', 'duplicate_delivery', 'event_id_conflict') THEN CASE WHEN event_id % 97 = 0 THEN 'same:' ELSE 'a:' END || event_id END AS canonical_record_id FROM final"))
def _(t):
    return ingest.deliveries(ingest.decide(attempts(t))).select("delivery_id", "canonical_record_id")


@query("d12_rejections", _sent("SELECT 'rejection:' || delivery_id AS rejection_id, reason AS reason_code FROM final WHERE reason IS NOT NULL"))
def _(t):
    return ingest.rejections(ingest.decide(attempts(t))).select("rejection_id", "reason_code")


@query("d12_raw_records", _sent("SELECT CASE WHEN event_id % 97 = 0 THEN 'same:' ELSE tag || ':' END || event_id AS record_id, event_type AS event_name FROM final WHERE (reason IS NULL OR reason = 'event_id_conflict') AND resolution IN ('unique', 'event_id_conflict')"))
def _(t):
    return ingest.raw_records(ingest.decide(attempts(t))).select("record_id", "event_name")


@query("d14_redecide_batch", _sent("SELECT delivery_id, resolution AS duplicate_resolution, reason AS reason_code FROM final WHERE tag = 'b'"))
def _(t):
    sent = attempts(t)
    return ingest.redecide(sent.where("delivery_id like 'b:%'"), sent.where("delivery_id like 'a:%'")).select("delivery_id", "duplicate_resolution", "reason_code")


@query("p21_event_facts", _sent("SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(cents AS VARCHAR) AS cents FROM final WHERE reason IS NULL AND resolution = 'unique' AND event_type = 'purchase'"))
def _(t):
    bought = ingest.accepted(ingest.decide(attempts(t))).where("event_name = 'purchase'")
    return bought.select("event_id", F.get_json_object("payload", "$.cents").alias("cents"))


@query("p17_schema_validation", "SELECT event_id, event_id % 3 = 0 AS valid, CASE event_id % 3 WHEN 1 THEN 'extra' END AS unknown_key, CASE event_id % 3 WHEN 2 THEN 'k' END AS missing_key FROM events")
def _(t):
    payload = F.expr("case event_id % 3 when 0 then props when 1 then concat('{\"extra\":1,', substring(props, 2)) else '{}' end")
    unknown, missing = ingest.unknown_keys(payload, ["k"]), ingest.missing_keys(payload, ["k"])
    return t.read("events").select("event_id", ((F.size(unknown) == 0) & (F.size(missing) == 0)).alias("valid"), F.try_element_at(unknown, F.lit(1)).alias("unknown_key"), F.try_element_at(missing, F.lit(1)).alias("missing_key"))


@query("p25_reserved_names", "SELECT event_id, event_id % 4 = 1 AS reserved FROM events")
def _(t):
    payload = F.expr("case event_id % 4 when 0 then props when 1 then concat('{\"a\":[{\"advertising_id\" : 1}],', substring(props, 2)) when 2 then '{\"a\":\"advertising_id\"}' else '{}' end")
    return t.read("events").select("event_id", ingest.reserved_names(payload, ["advertising_id", "device_id"]).alias("reserved"))


@query("p22_conversion_bucket", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'fine:' || event_id % 64 WHEN event_id % 3 = 1 THEN 'coarse:low' END AS bucket FROM events")
def _(t):
    return t.read("events").select("event_id", ingest.conversion_bucket(F.expr("case when event_id % 3 = 0 then event_id % 64 end"), F.expr("case when event_id % 3 = 1 then 'low' end")).alias("bucket"))


def install_rows(t) -> tuple[DataFrame, DataFrame]:
    """One install a signup and the clicks it may name; every 11th click id is used twice."""
    at = lambda c: instants.canonical(F.timestamp_millis(c))
    clicks = t.base().where("event_type = 'click'")
    click = clicks.select(F.lit("t").alias("tenant_id"), F.lit("a").alias("app_id"), F.concat(F.lit("click:"), "event_id").alias("record_id"), F.concat(F.lit("c"), F.when(F.col("event_id") % 11 == 0, F.lit(0)).otherwise(F.col("event_id"))).alias("click_id"), F.lit("redirector").alias("producer"), F.concat(F.lit("r"), "event_id").alias("remote_click_ref"), (F.col("event_id") % 13 == 0).alias("bot_prefetch"), F.when(F.col("event_id") % 17 != 0, at(F.col("ms"))).alias("redirector_click_at"), F.when(F.col("event_id") % 19 == 0, "invalid").otherwise("available").alias("redirector_time_status"))
    last = ledger.as_of(t.base().where("event_type = 'signup'"), clicks.withColumn("last_click", F.col("event_id")), ["user_id"], "ms", "ms", "last_click", "named")
    status = F.expr("case event_id % 23 when 0 then 'none' when 1 then 'third_party' when 2 then 'unsupported' when 3 then 'unavailable' when 4 then 'not_applicable' else 'available' end")
    install = last.select(F.lit("t").alias("tenant_id"), F.lit("a").alias("app_id"), F.concat(F.lit("install:"), "event_id").alias("record_id"), F.when(F.col("event_id") % 29 == 0, "import:p").otherwise("sdk").alias("producer"), at(F.col("ms")).alias("occurred_at"), at(F.col("ms") + 1000).alias("received_at"), F.col("user_id").cast("string").alias("installation_id"), F.concat(F.lit("c"), F.when(F.col("named") % 11 == 0, F.lit(0)).otherwise(F.col("named"))).alias("click_id"), status.alias("referrer_status"), F.when(F.col("event_id") % 2 == 0, "play_organic_marker").alias("third_party_referrer_classification"), at(F.col("ms")).alias("install_begin_at_server"), F.lit(None).cast("string").alias("install_begin_at_server_status"), F.when(F.col("event_id") % 31 == 0, "decrypted").when(F.col("event_id") % 37 == 0, "auth_failed").alias("encrypted_referrer_status"), F.when(F.col("event_id") % 41 == 0, "attributed").alias("adservices_status"), (F.col("event_id") % 58 == 0).alias("has_import_context"), (F.col("event_id") % 116 == 0).alias("provider_attributed"), F.when(F.col("event_id") % 174 == 0, "organic").alias("provider_attribution_strategy"), F.lit(None).cast("string").alias("provider_confirmed_at"), F.lit(None).cast("string").alias("provider_click_ref"))
    return install, click


ATTRIBUTED = """
click AS (SELECT *, 'c' || CASE WHEN event_id % 11 = 0 THEN 0 ELSE event_id END AS click_id FROM base WHERE event_type = 'click'),
named AS (SELECT s.*, (SELECT arg_max(c.event_id, c.ms) FROM click c WHERE c.user_id = s.user_id AND c.ms <= s.ms) AS named FROM base s WHERE event_type = 'signup'),
install AS (SELECT *, 'c' || CASE WHEN named % 11 = 0 THEN 0 ELSE named END AS click_id FROM named),
keyed AS (SELECT click_id, count(*) AS n, min(event_id) AS one FROM click GROUP BY click_id),
joined AS (SELECT i.*, k.n, c.event_id AS one, c.ms AS click_ms FROM install i LEFT JOIN keyed k ON k.click_id = i.click_id LEFT JOIN click c ON k.n = 1 AND c.event_id = k.one),
reasons AS (SELECT *, CASE
  WHEN event_id % 29 = 0 AND event_id % 58 <> 0 THEN 'provider_unattributed'
  WHEN event_id % 29 = 0 AND event_id % 116 = 0 THEN 'provider_time_authority_unavailable'
  WHEN event_id % 29 = 0 AND event_id % 174 = 0 THEN 'provider_organic'
  WHEN event_id % 29 = 0 THEN 'provider_unattributed'
  WHEN event_id % 31 = 0 THEN 'meta_referrer_decrypted'
  WHEN event_id % 37 = 0 THEN 'meta_referrer_decrypt_failed'
  WHEN event_id % 41 = 0 THEN 'adservices_attributed'
  WHEN event_id % 23 = 0 THEN 'no_referrer'
  WHEN event_id % 23 = 1 AND event_id % 2 = 0 THEN 'no_first_party_referrer'
  WHEN event_id % 23 = 1 THEN 'foreign_referrer_unresolved'
  WHEN event_id % 23 = 2 THEN 'install_referrer_unsupported'
  WHEN event_id % 23 = 3 THEN 'install_referrer_unavailable'
  WHEN event_id % 23 = 4 THEN 'platform_referrer_not_available'
  WHEN n IS NULL THEN 'unknown_click_id'
  WHEN n > 1 THEN 'ambiguous_click_id'
  WHEN one % 13 = 0 THEN 'bot_prefetch'
  WHEN one % 19 = 0 THEN 'authoritative_time_invalid'
  WHEN one % 17 = 0 THEN 'authoritative_time_missing'
  WHEN ms - click_ms < 0 OR ms - click_ms >= 604800000 THEN 'window_expired'
  ELSE 'valid_install_referrer' END AS reason_code FROM joined)
"""


def _attributed(sql: str) -> str:
    from .base import CTES

    return f"WITH base AS ({CTES['base']}), {ATTRIBUTED} {sql}"


@query("t5_install_attribution", _attributed("SELECT 'attr:install:' || event_id AS attribution_id, reason_code, CASE WHEN reason_code IN ('provider_time_authority_unavailable', 'meta_referrer_decrypted', 'adservices_attributed', 'valid_install_referrer') THEN 'non_organic' WHEN reason_code IN ('provider_organic', 'no_referrer', 'no_first_party_referrer') THEN 'organic' ELSE 'unattributed' END AS status FROM reasons"))
def _(t):
    return attribution.installs(*install_rows(t)).select("attribution_id", "reason_code", "status")


@query("t5_attribution_evidence", _attributed("SELECT 'attr:install:' || event_id AS attribution_id, CASE WHEN reason_code IN ('bot_prefetch', 'valid_install_referrer') THEN 'click:' || one || '|' ELSE '' END || 'install:' || event_id AS refs FROM reasons"))
def _(t):
    return attribution.installs(*install_rows(t)).select("attribution_id", F.array_join("evidence_refs", "|").alias("refs"))


@query("j2_attribution_window", _attributed("SELECT reason_code, CAST(count(*) AS BIGINT) AS n, CAST(max(ms - click_ms) AS BIGINT) AS longest_ms FROM reasons WHERE reason_code IN ('window_expired', 'valid_install_referrer') GROUP BY reason_code"))
def _(t):
    return attribution.installs(*install_rows(t)).where(F.col("reason_code").isin("window_expired", "valid_install_referrer")).groupBy("reason_code").agg(F.count("*").alias("n"), F.max("ctit_ms").alias("longest_ms"))


@query("t6_after_lifecycle", _attributed("SELECT 'attr:install:' || event_id || CASE WHEN event_id % 5 = 0 THEN ':recalculated' ELSE '' END AS attribution_id, CASE WHEN event_id % 5 = 0 THEN 'superseded' ELSE 'final' END AS finality, CASE WHEN event_id % 5 = 0 THEN 'attr:install:' || event_id END AS supersedes_attribution_id FROM reasons"))
def _(t):
    install, click = install_rows(t)
    states = t.base().where("event_type = 'signup' and event_id % 5 = 0").select(F.lit("t").alias("tenant_id"), F.lit("a").alias("app_id"), F.concat(F.lit("install:"), "event_id").alias("record_id"), F.lit("redacted").alias("lifecycle_status"))
    return attribution.after_lifecycle(attribution.installs(install, click), states).select("attribution_id", "finality", "supersedes_attribution_id")


@query("t11_fraud_exclusion", _attributed("SELECT 'attr:install:' || event_id || ':fraud' AS attribution_id, 'fraud_excluded' AS reason_code FROM reasons WHERE reason_code = 'valid_install_referrer' AND one % 3 = 0"))
def _(t):
    install, click = install_rows(t)
    excluded = t.base().where("event_type = 'click' and event_id % 3 = 0").select(F.concat(F.lit("click:"), "event_id").alias("click_record_id"))
    return attribution.exclude_for_fraud(attribution.installs(install, click), excluded).where("reason_code = 'fraud_excluded'").select("attribution_id", "reason_code")


@query("t9_late_click", _attributed("SELECT 'attr:install:' || event_id || ':late-click' AS attribution_id, reason_code FROM reasons WHERE reason_code NOT IN ('unknown_click_id') AND event_id % 29 <> 0 AND event_id % 31 <> 0 AND event_id % 37 <> 0 AND event_id % 41 <> 0 AND event_id % 23 > 4 AND n IS NOT NULL"))
def _(t):
    install, click = install_rows(t)
    before = attribution.installs(install, click.where("false"))
    return attribution.superseding(before, attribution.installs(install, click), "late-click").select("attribution_id", "reason_code")


@query("t7_postback_attribution", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'skan_signature_invalid' WHEN event_id % 7 = 0 THEN 'postback_not_winner' WHEN event_id % 11 = 0 THEN 'crowd_anonymity_suppressed' WHEN event_id % 13 = 0 THEN 'conversion_value_null' ELSE 'skan_postback_verified' END AS reason_code, CASE WHEN event_id % 2 = 0 THEN 'skadnetwork' ELSE 'adattributionkit' END AS method FROM events")
def _(t):
    rows = t.read("events").select("event_id", F.col("event_id").cast("string").alias("record_id"), F.expr("case when event_id % 2 = 0 then 'skan_postback' else 'adattributionkit_postback' end").alias("event_name"), (F.col("event_id") % 5 != 0).alias("signature_verified"), (F.col("event_id") % 7 != 0).alias("did_win"), F.when(F.col("event_id") % 11 != 0, "s").alias("source_identifier"), F.when(F.col("event_id") % 13 != 0, 1).alias("conversion_value"), F.lit(None).cast("string").alias("coarse_conversion_value"))
    return attribution.postbacks(rows).select("event_id", "reason_code", "method")


@query("t8_deep_links", "SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'deep_link_install_click_reused' WHEN event_id % 5 IN (0, 1) THEN 'deep_link_open_attributed' WHEN event_id % 5 = 2 THEN 'deep_link_link_inactive' ELSE 'deep_link_unknown_link' END AS reason_code FROM events")
def _(t):
    rows = t.read("events").select("event_id", F.col("event_id").cast("string").alias("record_id"), F.expr("case when event_id % 3 = 0 then 'android_deferred_referrer' else 'universal_link' end").alias("open_source"), F.lit("c").alias("click_id"), F.expr("case when event_id % 2 = 0 then 'c' end").alias("install_click_id"), F.expr("case when event_id % 5 < 2 then 'active' when event_id % 5 = 2 then 'inactive' end").alias("resolution_status"))
    return attribution.deep_links(rows).select("event_id", "reason_code")


@query("j16_link_resolution", """
SELECT e.event_id, coalesce(CASE WHEN e.event_id % 3 = 0 THEN n.n_nationkey END, CASE WHEN c.link < 20 THEN c.link END, -1)::BIGINT AS link FROM events e LEFT JOIN nation n ON n.n_nationkey = e.event_id % 50 AND n.n_nationkey < 20
LEFT JOIN (SELECT user_id, arg_max(event_id % 25, (ts, event_id % 25)) AS link FROM events WHERE event_type = 'click' GROUP BY user_id) c ON c.user_id = e.user_id""")
def _(t):
    tenant = lambda df: df.withColumn("tenant_id", F.lit("t")).withColumn("app_id", F.lit("a"))
    links = tenant(t.read("nation").where("n_nationkey < 20").select(F.concat(F.lit("s"), "n_nationkey").alias("slug"), F.col("n_nationkey").alias("tracking_link_id"), F.lit("active").alias("status")))
    clicks = tenant(t.read("events").where("event_type = 'click'").select(F.col("user_id").alias("click_id"), F.col("ts").alias("received_at"), (F.col("event_id") % 25).cast("int").alias("tracking_link_id")))
    opens = tenant(t.read("events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("s"), F.col("event_id") % 50)).alias("link_slug"), F.col("user_id").alias("click_id")))
    resolved = attribution.resolve_links(opens, links, clicks)
    return resolved.select("event_id", F.when(F.col("resolution_status") == "active", F.col("resolved_link")).otherwise(-1).cast("long").alias("link"))


def _valued(t) -> DataFrame:
    rows = t.revenue().select("event_id", "user_id", "occurred_ms", "currency", F.col("cents").alias("amount_unscaled"), F.lit(2).alias("amount_scale"))
    return metrics.with_rates(rows, RATES, 6)


VALUE = f"CASE currency WHEN 'USD' THEN cents * 10000 WHEN 'EUR' THEN cents * 12500 ELSE {half_even_sql('cents * 6543', '100')} END"
COHORT_REVENUE = f"""
valued AS (SELECT user_id, occurred_ms, {VALUE} AS v FROM revenue),
sums AS (SELECT campaign_id, count(DISTINCT c.user_id) AS size,
  coalesce(sum(v) FILTER (WHERE occurred_ms >= installed_ms AND occurred_ms < installed_ms + 86400000), 0) AS d0,
  coalesce(sum(v) FILTER (WHERE occurred_ms >= installed_ms AND occurred_ms < installed_ms + 4 * 86400000), 0) AS d3,
  coalesce(sum(v) FILTER (WHERE occurred_ms >= installed_ms AND occurred_ms < installed_ms + 8 * 86400000), 0) AS d7 FROM cohort c LEFT JOIN valued v ON v.user_id = c.user_id GROUP BY campaign_id)
"""


def _cohort_sql(sql: str) -> str:
    from .base import CTES, closure

    head = ", ".join(f"{n} AS ({CTES[n]})" for n in closure(("cohort", "revenue")))
    return f"WITH {head}, {COHORT_REVENUE} {sql}"


def cohort_sums(t) -> DataFrame:
    return metrics.cohort_revenue(t.cohort(), _valued(t), ["campaign_id"], [0, 3, 7], ["user_id"])


@query("a1_cohort_revenue", _cohort_sql("SELECT campaign_id, CAST(size AS BIGINT) AS cohort_size, CAST(d0 AS VARCHAR) AS d0, CAST(d3 AS VARCHAR) AS d3, CAST(d7 AS VARCHAR) AS d7 FROM sums"))
def cohort_revenue(t):
    return cohort_sums(t).select("campaign_id", "cohort_size", *[F.col(f"revenue_d{d}").cast("string").alias(f"d{d}") for d in (0, 3, 7)])


@query("a2_return_on_cost", _cohort_sql(f"SELECT campaign_id, CASE WHEN campaign_id = 'BUILDING' THEN NULL ELSE CAST({half_even_sql('d7 * 1000000', '123456789')} AS VARCHAR) END AS roas, CASE WHEN campaign_id = 'BUILDING' THEN 'no_attributed_cost' END AS reason FROM sums"))
def _(t):
    cost = F.when(F.col("campaign_id") == "BUILDING", 0).otherwise(123456789)
    return cohort_sums(t).select("campaign_id", metrics.ratio(F.col("revenue_d7"), cost).cast("string").alias("roas"), metrics.undefined_reason("revenue_over_cost", cost).alias("reason"))


@query("a4_lifetime_value", _cohort_sql(f"SELECT campaign_id, CAST({half_even_sql('d7', 'size')} AS VARCHAR) AS ltv FROM sums"))
def _(t):
    return cohort_sums(t).select("campaign_id", money.half_even_div(F.col("revenue_d7"), money.units(F.col("cohort_size"))).cast("string").alias("ltv"))


@query("a3_retention", f"""
SELECT campaign_id, CAST(count(*) AS BIGINT) AS cohort_size, CAST(sum(a1) AS BIGINT) AS active_d1, CAST(sum(a7) AS BIGINT) AS active_d7, CAST({half_even_sql('sum(a1) * 1000000', 'count(*)')} AS BIGINT) AS retention_d1 FROM (
  SELECT campaign_id, c.user_id, coalesce(max(CASE WHEN s.occurred_ms >= installed_ms + 86400000 AND s.occurred_ms < installed_ms + 2 * 86400000 THEN 1 ELSE 0 END), 0) AS a1,
    coalesce(max(CASE WHEN s.occurred_ms >= installed_ms + 7 * 86400000 AND s.occurred_ms < installed_ms + 8 * 86400000 THEN 1 ELSE 0 END), 0) AS a7 FROM cohort c LEFT JOIN sessions s ON s.user_id = c.user_id GROUP BY campaign_id, c.user_id) GROUP BY campaign_id""", ("cohort", "sessions"))
def _(t):
    out = metrics.retained(t.cohort(), t.sessions(), ["campaign_id"], [1, 7], ["user_id"])
    return out.withColumn("retention_d1", metrics.ratio(F.col("active_d1"), F.col("cohort_size")).cast("long"))


@query("j5_calendar_day_revenue", f"SELECT campaign_id, CAST(sum({VALUE}) AS VARCHAR) AS revenue FROM cohort c JOIN revenue r ON r.user_id = c.user_id AND CAST(epoch_ms(installed_ms) + INTERVAL 9 HOUR AS DATE) = CAST(epoch_ms(occurred_ms) + INTERVAL 9 HOUR AS DATE) GROUP BY campaign_id", ("cohort", "revenue"))
def _(t):
    return metrics.calendar_revenue(t.cohort(), _valued(t), ["campaign_id"], "Asia/Tokyo", ["user_id"]).withColumn("revenue", F.col("revenue").cast("string"))


@query("a6_daily_event_count", "SELECT CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS metric_date, event_type AS event_name, CAST(count(*) AS BIGINT) AS value FROM base WHERE event_type IN ('click', 'signup') GROUP BY ALL", ("base",))
def _(t):
    return metrics.event_counts(t.base().select(F.col("event_type").alias("event_name"), F.col("ms").alias("occurred_ms")), ("click", "signup"), ["event_name"], "Asia/Tokyo")


@query("a7_postback_count", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS metric_date, 's' || user_id % 4 AS source_identifier, CASE WHEN event_id % 2 = 0 THEN 'fine:' || event_id % 64 ELSE 'coarse:low' END AS conversion_bucket, CAST(count(*) AS BIGINT) AS value FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0 GROUP BY ALL")
def _(t):
    rows = t.base().select((F.col("event_id") % 3 != 0).alias("signature_verified"), (F.col("event_id") % 5 != 0).alias("did_win"), F.concat(F.lit("s"), F.col("user_id") % 4).alias("source_identifier"), F.expr("case when event_id % 2 = 0 then event_id % 64 end").alias("conversion_value"), F.expr("case when event_id % 2 = 1 then 'low' end").alias("coarse_conversion_value"), F.col("ms").alias("received_ms"))
    return metrics.postback_counts(rows)


def _costs(t) -> DataFrame:
    return t.chain().select(F.col("subject").cast("string").alias("cost_key_digest"), F.col("o_orderdate").alias("as_of"), F.col("id").alias("cost_record_id"), F.col("cents").alias("amount_unscaled"), F.expr("case when id % 50 = 0 then 'EUR' else 'USD' end").alias("currency"))


@query("a8_current_cost", """
SELECT CAST(subject % 10 AS VARCHAR) AS grp, CAST(sum(cents * 10000) AS VARCHAR) AS cost, CAST(sum(CASE WHEN id % 50 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS mismatched_currency FROM (SELECT subject, arg_max(id, (o_orderdate, id)) AS id, arg_max(cents, (o_orderdate, id)) AS cents FROM chain GROUP BY subject) GROUP BY subject % 10""", ("chain",))
def _(t):
    now = metrics.current_costs(_costs(t)).withColumn("grp", (F.col("cost_key_digest").cast("long") % 10).cast("string"))
    return metrics.cost_total(now, ["grp"], "USD", 6, 2).withColumn("cost", F.col("cost").cast("string"))


@query("j10_latest_attribution", """
SELECT user_id AS installation_id, status AS attribution_status FROM (SELECT DISTINCT user_id FROM base) LEFT JOIN (SELECT subject, arg_max(status, (o_orderdate, CAST(id AS VARCHAR))) AS status FROM chain WHERE o_orderdate <= TIMESTAMP '1998-06-01' GROUP BY subject) ON subject = user_id""", ("base", "chain"))
def _(t):
    scope = [F.lit("t").alias("tenant_id"), F.lit("a").alias("app_id")]
    decisions = t.chain().select(*scope, F.col("subject").alias("subject_ref"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("decided_at"), F.col("id").cast("string").alias("attribution_id"), "status", F.col("status").alias("reason_code"))
    users = t.base().select(*scope, F.col("user_id").alias("installation_id")).distinct()
    return metrics.latest_attribution(users, decisions, "1998-06-01").select("installation_id", "attribution_status")


@query("a17_snapshot_digest", """
SELECT user_id, sha256('[' || string_agg('["' || r || '","' || event_id || '","' || l || '","p"]', ',' ORDER BY r, CAST(event_id AS VARCHAR)) || ']') AS input_snapshot_digest, CAST(count(*) AS BIGINT) AS record_count,
  CASE WHEN bool_or(l = 'redacted') THEN 'redaction_affected' WHEN bool_or(l <> 'available') THEN 'retention_affected' ELSE 'reproducible' END AS reproducibility
FROM (SELECT user_id, event_id, strftime(epoch_ms(ms), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') || 'Z' AS r, CASE WHEN event_id % 500 = 0 THEN 'redacted' WHEN event_id % 100 = 0 THEN 'purged' ELSE 'available' END AS l FROM base) GROUP BY user_id""", ("base",))
def _(t):
    rows = t.base().select("user_id", instants.canonical(F.timestamp_millis("ms")).alias("received_at"), F.col("event_id").cast("string").alias("record_id"), F.expr("case when event_id % 500 = 0 then 'redacted' when event_id % 100 = 0 then 'purged' else 'available' end").alias("lifecycle_status"), F.lit("p").alias("policy_digest"))
    return metrics.snapshot(rows, ["user_id"]).select("user_id", "input_snapshot_digest", "record_count", "reproducibility")


@query("a18_evidence_refs", "SELECT user_id, string_agg(DISTINCT CAST(event_id AS VARCHAR), '|' ORDER BY CAST(event_id AS VARCHAR)) AS refs FROM revenue GROUP BY user_id", ("revenue",))
def _(t):
    return metrics.evidence(t.revenue().withColumn("record_id", F.col("event_id").cast("string")), ["user_id"]).select("user_id", F.array_join("evidence_refs", "|").alias("refs"))


@query("m3_metric_runs", "SELECT 'run:daily_clicks:' || substr(sha256('{\"metric_date\":\"' || d || '\"}'), 1, 24) AS metric_run_id, n AS value, 'present' AS value_state FROM (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS d, CAST(count(*) AS BIGINT) AS n FROM base WHERE event_type = 'click' GROUP BY 1)", ("base",))
def _(t):
    values = metrics.event_counts(t.base().select(F.col("event_type").alias("event_name"), F.col("ms").alias("occurred_ms")), ("click",), [])
    return metrics.runs(values, metrics.registry()["daily_clicks"], "2024-02-01T00:00:00.000Z", "run").select("metric_run_id", "value", "value_state")


def _days(t) -> DataFrame:
    scope = [F.concat(F.lit("t"), F.col("user_id") % 2).alias("tenant_id"), F.lit("a").alias("app_id")]
    clicks = t.clicks().select(*scope, F.col("event_id").alias("click_id"), F.to_date("ts").cast("string").alias("day"), "clicked_ms", F.concat(F.lit("s"), F.col("user_id") % 5).alias("source"))
    installs = ledger.as_of(t.base().where("event_type = 'signup'"), t.clicks().withColumn("c", F.col("event_id")), ["user_id"], "ms", "clicked_ms", "c", "click_id").where("click_id is not null").select(*scope, "click_id", F.col("event_id").alias("install_id"), F.when(F.col("event_id") % 20 == 0, F.col("ms") - 40 * instants.DAY_MS).otherwise(F.col("ms")).alias("installed_ms"))
    return fraud.source_days(clicks, installs, ["source"])


DAYS = """
named AS (SELECT s.event_id AS install_id, CASE WHEN s.event_id % 20 = 0 THEN s.ms - 3456000000 ELSE s.ms END AS installed_ms, (SELECT arg_max(c.event_id, c.clicked_ms) FROM clicks c WHERE c.user_id = s.user_id AND c.clicked_ms <= s.ms) AS click_id FROM base s WHERE event_type = 'signup'),
j AS (SELECT c.event_id AS click_id, 't' || c.user_id % 2 AS tenant_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, 's' || c.user_id % 5 AS source, install_id, installed_ms - clicked_ms AS ctit FROM clicks c LEFT JOIN named n ON n.click_id = c.event_id),
days AS (SELECT tenant_id, day, source, count(DISTINCT click_id) AS clicks, count(DISTINCT install_id) AS installs, count(DISTINCT install_id) FILTER (WHERE ctit < 0) AS neg,
  CAST(round_even(quantile_cont(ctit, 0.5) FILTER (WHERE ctit >= 0), 0) AS BIGINT) AS p50, CAST(round_even(quantile_cont(ctit, 0.95) FILTER (WHERE ctit >= 0), 0) AS BIGINT) AS p95 FROM j GROUP BY tenant_id, day, source)
"""


def _days_sql(sql: str) -> str:
    from .base import CTES

    return f"WITH base AS ({CTES['base']}), clicks AS ({CTES['clicks']}), {DAYS} {sql}"


@query("a10_source_days", _days_sql("SELECT tenant_id, day, source, CAST(clicks AS BIGINT) AS clicks, CAST(installs AS BIGINT) AS installs, CAST(neg AS BIGINT) AS ctit_negative_count FROM days"))
def _(t):
    return _days(t).select("tenant_id", "day", "source", "clicks", "installs", "ctit_negative_count")


@query("a11_percentiles", _days_sql("SELECT tenant_id, day, source, p50 AS ctit_p50_ms, p95 // 1000 AS ctit_p95_s FROM days"))
def _(t):
    return _days(t).select("tenant_id", "day", "source", "ctit_p50_ms", F.expr("ctit_p95_ms div 1000").alias("ctit_p95_s"))


@query("a12_median_rate", _days_sql("SELECT tenant_id, day, round(quantile_cont(installs / clicks, 0.5), 9) AS median_cvr FROM days GROUP BY tenant_id, day"))
def _(t):
    return fraud.with_median_rate(_days(t)).select("tenant_id", "day", F.round("median_cvr", 9).alias("median_cvr")).distinct()


@query("a13_negative_rate", _days_sql("SELECT tenant_id, day, round(CASE WHEN sum(installs) > 0 THEN sum(neg) / sum(installs) ELSE 0 END, 9) AS negative_rate, CASE WHEN sum(installs) > 0 THEN sum(neg) / sum(installs) ELSE 0 END > 0.05 AS guarded FROM days GROUP BY tenant_id, day"))
def _(t):
    return fraud.negative_rates(_days(t)).select("tenant_id", "day", F.round("negative_rate", 9).alias("negative_rate"), "guarded")


@query("r5_flooding", _days_sql("SELECT tenant_id, day, source FROM days JOIN (SELECT tenant_id AS t, day AS d, quantile_cont(installs / clicks, 0.5) AS m FROM days GROUP BY ALL) ON d = day AND t = tenant_id WHERE clicks >= 10 AND installs / clicks <= m * 0.9 AND p50 >= 3600000 AND p95 / p50 <= 20"))
def _(t):
    bundle = fraud.Bundle(layers={"base": {"source_day_min_clicks": 10, "source_day_cvr_median_multiplier": 0.9, "source_day_ctit_p50_min_seconds": 3600, "source_day_ctit_p95_p50_max_ratio": 20}})
    return fraud.flooding(fraud.with_median_rate(_days(t)), bundle).select("tenant_id", "day", "source")


@query("r1_transport", "SELECT CAST(event_id AS VARCHAR) AS record_id, CASE WHEN event_id % 13 = 0 THEN 'transport-bot-prefetch-v1' ELSE 'transport-replay-v1' END AS rule_id, CASE WHEN event_id % 13 = 0 THEN 'confirmed' ELSE 'suspected' END AS decision FROM events WHERE event_type = 'click' AND (event_id % 13 = 0 OR event_id % 7 = 0)")
def _(t):
    clicks = t.clicks().select(F.lit("t").alias("tenant_id"), F.lit("a").alias("app_id"), F.col("event_id").cast("string").alias("record_id"), (F.col("event_id") % 13 == 0).alias("bot_prefetch"), (F.col("event_id") % 7 == 0).alias("replay_suspected"))
    return fraud.transport(clicks).select("record_id", "rule_id", "decision")


@query("r3_install_rules", """
SELECT event_id, unnest(list_filter([CASE WHEN event_id % 3 = 0 AND rf >= ib + 1000 THEN 'referrer-server-order-v1' END, CASE WHEN ib < ck THEN 'ctit-clock-anomaly-v1' END, CASE WHEN ib >= ck AND ib - ck < 10000 THEN 'ctit-lower-bound-v1' END, CASE WHEN ib >= ck AND abs(rf - ck) > 300000 THEN 'referrer-redirector-divergence-v1' END], lambda x: x IS NOT NULL)) AS rule_id
FROM (SELECT event_id, ms AS ib, ms + (event_id % 40 - 30) * 1000 AS ck, ms + (event_id % 900 - 450) * 1000 AS rf FROM base WHERE event_type = 'signup')""", ("base",))
def _(t):
    rows = t.base().where("event_type = 'signup'").select("event_id", F.explode(fraud.install_hits(F.col("ms"), F.expr("ms + (event_id % 40 - 30) * 1000"), F.expr("ms + (event_id % 900 - 450) * 1000"), F.expr("case when event_id % 3 = 0 then 'available' else 'missing' end"))).alias("h"))
    return rows.select("event_id", F.col("h.rule_id").alias("rule_id"))


@query("r7_quarantine", "SELECT event_id, ms + 72 * 3600000 AS until_ms FROM base WHERE event_type = 'click' AND ms + 72 * 3600000 <= 1705000000000", ("base",))
def _(t):
    held = t.base().where("event_type = 'click'").select("event_id", fraud.quarantine_until(F.col("ms")).alias("until_ms"))
    return fraud.expired(held, 1705000000000)


@query("r9_active_bundle", "SELECT CAST(subject AS BIGINT) AS subject, id AS revision_id FROM chain WHERE id NOT IN (SELECT supersedes_id FROM chain WHERE supersedes_id IS NOT NULL)", ("chain",))
def _(t):
    revisions = t.chain().select(F.col("subject").cast("long").alias("subject"), F.col("id").alias("revision_id"), F.col("supersedes_id").alias("supersedes_revision_id"))
    return fraud.active_bundles(revisions, ["subject"]).select("subject", "revision_id")


def _key(kind: str, value, cardinality: str = "one_to_one"):
    return F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"), F.lit("lowercase_ascii").alias("normalization"), F.lit(cardinality).alias("cardinality"), F.lit(None).cast("string").alias("value_encoding"))


@query("c2_difference_reasons", """
SELECT CAST(o_orderkey AS VARCHAR) AS reconciliation_id, CASE WHEN o_orderkey % 31 = 0 THEN 'redaction_caused_recalculation' WHEN o_orderkey % 29 = 0 AND n = 0 THEN 'provider_modeled_conversion' WHEN o_orderkey % 23 = 0 THEN 'join_key_missing' WHEN n = 0 AND o_orderkey % 2 = 0 THEN 'candidate_missing' WHEN n = 0 THEN 'external_row_unmatched'
  WHEN n > 1 THEN 'join_key_ambiguous' WHEN line % 7 = 0 THEN 'candidate_excluded' WHEN line % 7 = 1 THEN 'window_mismatch' WHEN line % 7 = 2 THEN 'freshness_mismatch' ELSE 'matched' END AS reason, CAST(n AS INTEGER) AS candidates
FROM (SELECT o_orderkey, count(l_orderkey) FILTER (WHERE o_orderkey % 23 <> 0) AS n, min(l_partkey) AS line FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey)""")
def reconciled(t):
    scope = [F.lit("t").alias("tenant_id"), F.lit("a").alias("app_id")]
    key = F.concat(F.lit("ORDER"), F.col("o_orderkey"))
    keys = F.when(F.col("o_orderkey") % 23 == 0, F.array().cast(f"array<{reconcile.KEY}>")).when(F.col("o_orderkey") % 2 == 0, F.array(_key("provider_click_id", key))).otherwise(F.array(_key("other_id", key)))
    inputs = t.read("orders").select(*scope, F.col("o_orderkey").cast("string").alias("reconciliation_id"), keys.alias("matching_keys"), F.when(F.col("o_orderkey") % 31 == 0, "redaction").alias("privacy_effect"), (F.col("o_orderkey") % 29 == 0).alias("provider_modeled_without_candidate"), F.lit("fresh").alias("freshness"))
    lines = t.read("lineitem").where("l_returnflag = 'R'")
    value = F.concat(F.lit("order"), F.col("l_orderkey"))
    mine = F.when(F.col("l_orderkey") % 2 == 0, F.array(_key("provider_click_id", value))).otherwise(F.array(_key("other_id", value)))
    candidates = lines.select(*scope, F.col("l_orderkey").cast("string").alias("reconciliation_id"), F.concat_ws("-", F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey"), F.monotonically_increasing_id()).alias("candidate_id"), mine.alias("matching_keys"), F.col("l_partkey").alias("position"), F.when(F.col("l_partkey") % 7 == 1, "out_of_window").otherwise("in_window").alias("window_status"), F.when(F.col("l_partkey") % 7 == 2, "stale").otherwise("fresh").alias("freshness"), (F.col("l_partkey") % 7 == 0).alias("excluded"), F.lit("rule").alias("exclusion_reason"))
    return reconcile.reconcile(inputs, candidates).select("reconciliation_id", F.col("difference_reason_code").alias("reason"), F.size("candidates").alias("candidates"))


@query("c4_duplicate_identities", "SELECT CAST(o_custkey AS VARCHAR) AS reconciliation_id, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def _(t):
    rows = t.read("orders").select(F.lit("t").alias("tenant_id"), F.lit("a").alias("app_id"), F.col("o_custkey").cast("string").alias("reconciliation_id"))
    return reconcile.duplicate_identities(rows).select("reconciliation_id", "n")


@query("v1_lifecycle", "SELECT CAST(event_id AS VARCHAR) AS record_id, CASE WHEN event_id % 9 = 0 THEN 'purged' WHEN event_id % 12 = 0 THEN 'purged' ELSE 'redacted' END AS lifecycle_status FROM events WHERE event_id % 9 = 0 OR event_id % 6 = 0")
def _(t):
    scope = [F.lit("t").alias("tenant_id"), F.lit("a").alias("app_id")]
    e = t.read("events").withColumn("record_id", F.col("event_id").cast("string"))
    asked = lambda rows, at, status: rows.groupBy("user_id").agg(F.collect_list(F.struct("record_id", F.lit(status).alias("lifecycle_status"))).alias("affected_records")).select(*scope, F.lit("completed").alias("status"), F.lit(at).alias("completed_at"), "affected_records")
    done = asked(e.where("event_id % 6 = 0"), "2024-01-02", "redacted").unionByName(asked(e.where("event_id % 12 = 0"), "2024-01-03", "purged")).unionByName(asked(e.where("event_id % 6 = 0"), "2024-01-01", "purged"))
    gone = e.where("event_id % 9 = 0").select(*scope, "record_id", F.lit("expired").alias("lifecycle_status"))
    return privacy.lifecycle(done, gone).select("record_id", "lifecycle_status")


@query("v3_tombstones", """SELECT CAST(event_id AS VARCHAR) AS record_id, sha256('["t","a","q' || user_id || '","' || event_id || '","2024-01-0' || (user_id % 9 + 1) || '"]') AS provenance_digest FROM events WHERE event_id % 6 = 0""")
def _(t):
    e = t.read("events").where("event_id % 6 = 0")
    done = e.groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_id").cast("string").alias("record_id"), F.lit("redacted").alias("lifecycle_status"))).alias("affected_records"))
    done = done.select(F.lit("t").alias("tenant_id"), F.lit("a").alias("app_id"), F.concat(F.lit("q"), "user_id").alias("privacy_request_id"), F.lit("completed").alias("status"), F.concat(F.lit("2024-01-0"), F.col("user_id") % 9 + 1).alias("completed_at"), "affected_records")
    return privacy.tombstones(done).select("record_id", "provenance_digest")


@query("v4_deletion_reach", "SELECT 'q' || user_id AS privacy_request_id, CAST(count(*) AS BIGINT) AS records FROM events WHERE user_id % 10 = 0 GROUP BY user_id")
def _(t):
    scope = [F.lit("t").alias("tenant_id"), F.lit("a").alias("app_id")]
    e = t.read("events").select(*scope, F.col("user_id").alias("installation_id"), F.col("event_id").alias("record_id"), "event_type")
    asked = e.where("installation_id % 10 = 0").select("tenant_id", "app_id", "installation_id", F.concat(F.lit("q"), "installation_id").alias("privacy_request_id"), F.lit("installation").alias("deletion_scope")).distinct()
    tables = [e.where(F.col("event_type") == k) for k in ("click", "signup", "view", "purchase", "error")]
    return privacy.reach(asked, tables, e).groupBy("privacy_request_id").agg(F.count("*").alias("records"))


@query("j22_purgeable", "SELECT DISTINCT l_orderkey // 2 AS payload_ref FROM lineitem WHERE (l_orderkey // 3) % 2 = 0 AND l_orderkey // 2 NOT IN (SELECT l_orderkey // 2 FROM lineitem WHERE (l_orderkey // 3) % 2 = 1)")
def _(t):
    records = t.read("lineitem").select(F.col("l_orderkey").alias("record_id"), F.expr("l_orderkey div 2").alias("payload_ref"))
    return privacy.purgeable(records.where("(record_id div 3) % 2 = 0").select("record_id"), records)


@query("v5_affected_runs", "SELECT o_orderkey AS metric_run_id, CAST(count(DISTINCT l_partkey) AS BIGINT) AS records FROM (SELECT id AS o_orderkey FROM chain WHERE id NOT IN (SELECT supersedes_id FROM chain WHERE supersedes_id IS NOT NULL)) JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey % 10 = 0 GROUP BY o_orderkey", ("chain",))
def _(t):
    refs = t.read("lineitem").groupBy(F.col("l_orderkey").alias("metric_run_id")).agg(F.collect_set("l_partkey").alias("evidence_refs"))
    runs = t.chain().select(F.col("id").alias("metric_run_id"), F.col("supersedes_id").alias("supersedes_metric_run_id")).join(refs, "metric_run_id", "left")
    reached = t.read("part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("record_id"))
    gone = t.read("lineitem").where("l_partkey % 10 = 0").select(F.col("l_partkey").alias("record_id"))
    return privacy.affected_runs(runs, reached.unionByName(gone))


MAPPING = {
    "source_id": "orders", "provider": "p", "kind": "mmp_raw",
    "row_filter": [{"source": "o_orderstatus", "equals": "O"}],
    "rules": [
        {"target": "event_name", "expression": {"source": "o_orderpriority", "map": {"1-URGENT": "click", "2-HIGH": "install"}, "map_default": "custom_event"}},
        {"target": "event_id", "expression": {"source": "o_orderkey", "prefix": "o-"}},
        {"target": "occurred_at", "expression": {"source": "at", "timestamp": {"default_timezone": "UTC"}}},
        {"target": "payload", "expression": {"object": {"customer": {"source": "c_name", "fallback_column": "o_custkey", "default": "none"}, "urgent": {"source": "o_orderpriority", "boolean": {"true_values": ["1-urgent"], "false_values": ["5-low"], "default": False}}}}},
        {"target": "payload.money", "expression": {"source": "amount", "money": {"input": "decimal", "scale": 6, "currency_default": "usd"}}},
    ],
}


@query("p12_import_mapping", r"""
SELECT 'o-' || o_orderkey AS event_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'click' WHEN '2-HIGH' THEN 'install' ELSE 'custom_event' END AS event_name, strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') AS occurred_at,
  CAST(o_custkey AS VARCHAR) AS customer, o_orderpriority = '1-URGENT' AS urgent, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey || '500000' END AS amount, CASE WHEN o_orderkey % 5 = 0 THEN 'money_decimal_unreadable' END AS error
FROM orders WHERE o_orderstatus = 'O'""")
def _(t):
    rows = t.read("orders").withColumn("at", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).withColumn("amount", F.expr("case when o_orderkey % 5 = 0 then '1e5' else concat(o_orderkey, '.5') end"))
    m = mapping.apply(MAPPING, rows.withColumn("o_custkey", F.col("o_custkey").cast("string")))
    return m.select(F.col("mapped.event_id").alias("event_id"), F.col("mapped.event_name").alias("event_name"), F.col("mapped.occurred_at").alias("occurred_at"), F.col("mapped.payload.customer").alias("customer"), F.col("mapped.payload.urgent").alias("urgent"), F.when(F.col("error").isNull(), F.col("mapped.payload.money.amount_unscaled")).alias("amount"), "error")


@query("s6_daily_spend", "SELECT CAST(o_custkey AS VARCHAR) AS campaign_id, strftime(o_orderdate, '%Y-%m-%d') AS date, CAST(o_orderkey AS VARCHAR) || '250000' AS amount_unscaled, CASE WHEN o_orderkey % 2 = 0 THEN 'JP' END AS country FROM orders WHERE o_orderkey > 0")
def _(t):
    rows = t.read("orders").where("o_orderkey > 0").select(F.col("o_custkey").alias("campaign_id"), F.lit("").alias("adset_id"), F.expr("case when o_orderkey % 2 = 0 then 'jp' end").alias("country"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_start"), F.concat("o_orderkey", F.lit(".25")).alias("spend"))
    return connectors.daily_spend({"tenant_id": "t", "app_id": "a", "currency": "usd", "as_of": "x"}, rows, "n").select("campaign_id", "date", "amount_unscaled", "country")


@query("s7_micro_spend", "SELECT CAST(o_orderkey AS VARCHAR) AS campaign_id, n_name AS country, CAST(o_orderkey * 1000 AS VARCHAR) AS amount_unscaled, CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_custkey AS VARCHAR) END AS ad_group_id FROM orders JOIN nation ON n_nationkey = o_orderkey % 25")
def _(t):
    rows = t.read("orders").select(F.col("o_orderkey").alias("campaign_id"), F.col("o_custkey").alias("ad_group_id"), (F.col("o_orderkey") % 2 == 0).alias("is_app_campaign"), (F.col("o_orderkey") % 25).alias("country_criterion_id"), F.lit("2026-01-01").alias("date"), (F.col("o_orderkey") * 1000).alias("cost_micros"))
    codes = t.read("nation").select(F.col("n_nationkey").alias("criterion_id"), F.col("n_name").alias("country"))
    return connectors.micro_spend({"tenant_id": "t", "app_id": "a", "currency": "usd", "as_of": "x"}, rows, codes, "n").select("campaign_id", "country", "amount_unscaled", "ad_group_id")


@query("s13_query_postbacks", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'installation_level' ELSE 'aggregate' END AS subject_scope, CASE WHEN event_id % 2 = 0 THEN 'u ' || user_id END AS installation_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE '12500000' END AS amount_unscaled, event_id + 1700000000 AS occurred_s, CASE WHEN event_id % 3 = 0 THEN 'revenue_invalid' END AS error FROM events")
def _(t):
    line = F.concat(F.expr("case when event_id % 2 = 0 then concat('user_id=u%20', user_id) else 'user_id=' end"), F.expr("case when event_id % 3 = 0 then '&revenue=1e-3' else '&revenue=0.0125' end"), F.lit("&ts="), F.col("event_id") + 1700000000)
    return connectors.query_postbacks(t.read("events").select("event_id", line.alias("query"))).select("event_id", "subject_scope", "installation_id", "amount_unscaled", "occurred_s", "error")


@query("a14_record_counts", """SELECT 'daily_' || event_type || 's' AS metric_name, CAST(CAST(ts AS DATE) AS VARCHAR) AS metric_date, CAST(count(*) AS BIGINT) AS value, CASE WHEN user_id % 3 = 0 THEN '{"network":"n' || user_id % 4 || '"}' ELSE '{"country":"c' || user_id % 3 || '","network":"n' || user_id % 4 || '"}' END AS grouping FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL""")
def _(t):
    e = t.base().select(F.col("event_type").alias("event_name"), F.timestamp_millis("ms").alias("ts"), F.expr("case when user_id % 3 <> 0 then concat('c', user_id % 3) end").alias("country"), F.concat(F.lit("n"), F.col("user_id") % 4).alias("network"))
    return reporting.record_counts(e, ("click", "view"), ["country", "network"])


def _audit(t) -> DataFrame:
    days = t.clicks().groupBy(F.to_date("ts").cast("string").alias("day"), F.concat(F.lit("s"), F.col("user_id") % 5).alias("source")).agg(F.count("*").alias("clicks"))
    decided = days.where("clicks % 2 = 0").select(F.concat_ws(":", F.lit("source-day"), "day", "source").alias("subject_ref"), F.concat_ws(":", "day", "source").alias("decision_id"), F.lit(None).cast("string").alias("supersedes_decision_id"), F.when(F.col("clicks") % 4 == 0, "suspected").otherwise("clear").alias("decision"), F.when(F.col("clicks") % 4 == 0, "exclude").otherwise("flag").alias("action"))
    clicks = t.clicks().select(F.to_date("ts").cast("string").alias("day"), F.concat(F.lit("s"), F.col("user_id") % 5).alias("source"), F.concat(F.lit("c"), F.col("event_id") % 100).alias("click_ref"))
    return reporting.fraud_audit(days, decided, clicks)


AUDIT = "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, 's' || user_id % 5 AS source, count(*) AS clicks, string_agg(DISTINCT 'c' || event_id % 100, '|' ORDER BY 'c' || event_id % 100) AS refs FROM events WHERE event_type = 'click' GROUP BY 1, 2"


@query("a16_fraud_audit_refs", f"SELECT 'source-day:' || day || ':' || source AS subject_ref, refs, CASE WHEN clicks % 4 = 0 THEN 'suspected' WHEN clicks % 2 = 0 THEN 'clear' END AS decision FROM ({AUDIT})")
def _(t):
    return _audit(t).select("subject_ref", F.array_join("click_refs", "|").alias("refs"), "decision")


@query("a15_fraud_audit_counts", f"SELECT day, CAST(count(*) AS BIGINT) AS sources, CAST(count(*) FILTER (WHERE clicks % 4 = 0) AS BIGINT) AS suspected, CAST(count(*) FILTER (WHERE clicks % 4 = 0) AS BIGINT) AS excluded, CAST(count(*) FILTER (WHERE clicks % 4 = 2) AS BIGINT) AS flagged, CAST(count(*) FILTER (WHERE clicks % 2 = 1) AS BIGINT) AS undecided FROM ({AUDIT}) GROUP BY day")
def _(t):
    return reporting.fraud_summary(_audit(t))


@query("s18_audit_csv", f"SELECT day || ',' || source || ',' || clicks || ',' || refs AS line FROM ({AUDIT})")
def _(t):
    from larkspur.sources.files import csv_lines

    return csv_lines(_audit(t).select("day", "source", "clicks", "click_refs"))


@query("m5_metric_report", """
SELECT metric_name, run_date, metric_run_id FROM (SELECT CASE WHEN id % 2 = 0 THEN 'd0_roas' ELSE 'd1_roas' END AS metric_name, strftime(o_orderdate, '%Y-%m-%d') AS run_date, CAST(id AS VARCHAR) AS metric_run_id FROM chain WHERE id NOT IN (SELECT supersedes_id FROM chain WHERE supersedes_id IS NOT NULL))
WHERE metric_name = 'd0_roas' AND run_date >= '1998-01-01' AND run_date <= '1998-12-31' ORDER BY metric_name, run_date, metric_run_id LIMIT 101""", ("chain",))
def _(t):
    runs = t.chain().select(F.expr("case when id % 2 = 0 then 'd0_roas' else 'd1_roas' end").alias("metric_name"), F.lit("").alias("metric_date"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("cohort_date"), F.col("id").cast("string").alias("metric_run_id"), F.col("supersedes_id").cast("string").alias("supersedes_metric_run_id"))
    f = reporting.parse([("metric_name", "d0_roas"), ("from", "1998-01-01"), ("to", "1998-12-31"), ("limit", "100")])
    return reporting.metric_report(runs, f).select("metric_name", "run_date", "metric_run_id")


@query("m5_difference_audit", "SELECT status AS difference_reason_code, CAST(count(*) AS BIGINT) AS results, CAST(count(*) FILTER (WHERE id IN (SELECT supersedes_id FROM chain)) AS BIGINT) AS superseded FROM chain GROUP BY status", ("chain",))
def _(t):
    rows = t.chain().select(F.lit("t").alias("tenant_id"), F.lit("a").alias("app_id"), F.col("id").alias("reconciliation_id"), F.col("supersedes_id").alias("supersedes_reconciliation_id"), F.col("status").alias("difference_reason_code"))
    return reporting.difference_audit(rows).select("difference_reason_code", "results", "superseded")


@query("a21_queue_gauges", "SELECT o_orderstatus AS queue, CAST(count(*) AS BIGINT) AS depth, CAST(epoch(TIMESTAMP '1999-01-01') - epoch(min(o_orderdate)) AS BIGINT) AS oldest_s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1")
def _(t):
    queue = t.read("orders").select(F.col("o_orderstatus").alias("queue"), F.expr("case when o_orderkey % 2 = 0 then 'pending' else 'done' end").alias("status"), F.col("o_orderdate").cast("timestamp").alias("enqueued_at"))
    return reporting.queue_gauges(queue, "1999-01-01 00:00:00")


@query("s19_latency_histogram", "SELECT event_type, CAST(count(*) FILTER (WHERE value <= 10) AS BIGINT) AS le_10, CAST(count(*) FILTER (WHERE value <= 50.5) AS BIGINT) AS le_50_5, CAST(count(*) AS BIGINT) AS total FROM events GROUP BY event_type")
def _(t):
    return reporting.latency_histogram(t.read("events"), "value", [10, 50.5], ["event_type"])


@query("a22_latency_quantiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def _(t):
    return t.read("events").groupBy("event_type").agg(F.expr("percentile_disc(0.5) within group (order by value)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"))


@query("a24_ledger_counts", "SELECT (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer) AS customers")
def _(t):
    rows = [t.read(n).agg(F.count("*").alias(a)) for n, a in (("events", "events"), ("orders", "orders"), ("customer", "customers"))]
    return rows[0].crossJoin(rows[1]).crossJoin(rows[2])
