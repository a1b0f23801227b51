"""Ingestion: which delivery attempts are accepted, and what they become.

Attempts are rows with the scope that the server vouches for (tenant_id, app_id) and the record that
a client sent.  All decisions are windows over record_id and over the logical key, which are their
only shuffles; the rest are expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import canon, instants

SCHEMA = """
    tenant_id string, app_id string, policy_digest string,
    record_id string, delivery_id string, record_tenant_id string, record_app_id string,
    producer string, event_id string, event_name string, schema_version string,
    occurred_at string, received_at string, late boolean, subject_scope string,
    processing_purpose_id string, processing_sequence long, alternative_legal_basis_id string,
    payload string,
    purposes array<struct<processing_purpose_id:string,consent_required:boolean,policy_version:string>>,
    withdrawals array<struct<processing_purpose_id:string,withdrawal_recognized_at:string,withdrawal_recognized_sequence:long>>,
    bases array<struct<alternative_legal_basis_id:string,processing_purpose_id:string,effective_at:string,policy_version:string>>,
    stale_before string
"""
LOGICAL_KEY = ["tenant_id", "app_id", "producer", "event_id"]
# Events that steer processing and need no consent.
CONTROL_EVENTS = ("consent_changed",)


def attempt_order() -> list[Column]:
    """The total order of attempts, in UTF-16 order; a digest of the whole record is last, whose text and bytes have one order."""
    return [*[canon.utf16_key(F.coalesce(F.col(c), F.lit(""))) for c in ("received_at", "record_id", "delivery_id", "tenant_id", "app_id", "schema_version")], F.col("_record_sha256").cast("binary")]


def record_digest() -> Column:
    """Digest of what the client sent, its payload in canonical form."""
    fields = ("record_id", "delivery_id", "record_tenant_id", "record_app_id", "producer", "event_id", "event_name", "schema_version", "occurred_at", "received_at", "subject_scope", "processing_purpose_id", "alternative_legal_basis_id")
    return canon.digest({**{c: F.col(c) for c in fields}, "payload": canon.canonical_text(F.col("payload"))})


def first_of(array: str, test) -> Column:
    return F.try_element_at(F.filter(F.coalesce(F.col(array), F.array()), test), F.lit(1))


def with_consent(attempts: DataFrame) -> DataFrame:
    """attempts with consent_reason, consent_allowed and the policy that was looked at."""
    purpose_id = F.col("processing_purpose_id")
    df = attempts.withColumn("_purpose", first_of("purposes", lambda x: x["processing_purpose_id"] == purpose_id))
    df = df.withColumn("_withdrawal", first_of("withdrawals", lambda x: x["processing_purpose_id"] == purpose_id))
    df = df.withColumn(
        "_basis",
        first_of("bases", lambda x: (x["alternative_legal_basis_id"] == F.col("alternative_legal_basis_id")) & (x["processing_purpose_id"] == purpose_id) & (instants.instant(x["effective_at"]) <= instants.instant(F.col("received_at")))),
    )
    needed = purpose_id.isNotNull() & F.coalesce(F.col("_purpose.consent_required"), F.lit(False)) & ~F.col("event_name").isin(*CONTROL_EVENTS)
    reason = (
        F.when(~needed, "consent_not_required")
        .when(F.col("_withdrawal").isNull() | (F.col("processing_sequence") < F.col("_withdrawal.withdrawal_recognized_sequence")), "consent_valid_before_withdrawal")
        .when(F.col("_basis").isNotNull(), "documented_alternative_legal_basis")
        .otherwise("consent_withdrawn")
    )
    df = df.withColumn("consent_reason", reason).withColumn("consent_allowed", F.col("consent_reason") != "consent_withdrawn")
    return df.withColumn("consent_policy_version", F.coalesce("_purpose.policy_version", F.lit("not-applicable"))).drop("_purpose", "_withdrawal", "_basis")


def examined(attempts: DataFrame) -> DataFrame:
    """attempts with all that a decision needs of one attempt by itself, for ``concluded``.

    ``_alone``: an invalid time, or a logical key with a null, which no other attempt can share.
    ``_before`` and ``_after`` are the reasons that rank above and below a collision of record ids.
    """
    df = attempts if "payload_sha256" in attempts.columns else attempts.withColumn("payload_sha256", F.sha2(canon.canonical_text(F.col("payload")), 256))
    df = with_consent(df.withColumn("_record_sha256", record_digest()))
    occurred, received = instants.instant(F.col("occurred_at")), instants.instant(F.col("received_at"))
    bad = occurred.isNull() | received.isNull()
    df = df.withColumn("_bad_time", bad).withColumn("_alone", reduce(Column.__or__, [bad, *[F.col(c).isNull() for c in LOGICAL_KEY]]))
    scope = F.col("record_tenant_id").eqNullSafe(F.col("tenant_id")) & F.col("record_app_id").eqNullSafe(F.col("app_id"))
    installed = F.get_json_object("payload", "$.installation_id").isNotNull()
    df = df.withColumn("_before", F.when(F.col("_bad_time"), "timestamp_invalid").when(~scope, "client_scope_mismatch"))
    after = F.when(~F.col("consent_allowed"), "consent_withdrawn").when(occurred < instants.instant(F.col("stale_before")), "timestamp_stale").when((F.col("subject_scope") == "aggregate") & installed, "aggregate_installation_join_forbidden")
    df = df.withColumn("_after", after).withColumn("timeliness", F.when(F.col("late") & ~F.col("_bad_time"), "late").otherwise("on_time"))
    return df.withColumn("clock_skew_suspected", F.coalesce(instants.skewed(F.unix_millis(occurred), F.unix_millis(received)), F.lit(False)))


def concluded(df: DataFrame) -> DataFrame:
    """The decision of examined attempts with their ``duplicate_resolution`` and the first record id of their key, ``_first_record_id``."""
    resolution = F.col("duplicate_resolution")
    reason = F.coalesce("_before", F.when(resolution == "record_id_collision", resolution), "_after", F.when(resolution == "event_id_conflict", resolution))
    df = df.withColumn("reason_code", reason).withColumn("ingestion_status", F.when(F.col("reason_code").isNull(), "accepted").otherwise("rejected"))
    canonical = F.when(F.col("_bad_time"), F.lit(None)).when(resolution == "unique", F.col("record_id")).when(resolution.isin("duplicate_delivery", "event_id_conflict"), F.col("_first_record_id"))
    df = df.withColumn("canonical_record_id", canonical)
    return df.withColumn("payload_disposition", F.when(F.col("reason_code").isNotNull() & (F.col("reason_code") != "event_id_conflict"), "discarded").otherwise("protected"))


def decide(attempts: DataFrame) -> DataFrame:
    """attempts with their decision.

    A record_id met more than once rejects all its copies.  Of one logical key the first attempt is
    unique; later ones with its payload are duplicates, others conflicts; payloads are compared in
    canonical form, so the order of keys does not matter.  An attempt with an invalid time is looked at
    by itself: unique, on time and rejected; so is one without a part of its logical key, though not
    rejected for that.  Reasons rank: invalid time, scope, collision, consent, staleness, aggregate scope
    with an installation, conflict.  Attempts that stand alone are dealt by their delivery, so that
    they do not meet in the task of a null key.  Digests are shuffled as bytes.
    """
    df, own = examined(attempts), "payload_sha256" not in attempts.columns
    df = df.withColumn("_record_sha256", F.unhex("_record_sha256"))
    df = df.withColumn("payload_sha256", F.unhex("payload_sha256")) if own else df
    df = df.withColumn("_copies", F.when(F.col("record_id").isNull(), 1).otherwise(F.count("*").over(Window.partitionBy("record_id", F.when(F.col("record_id").isNull(), F.xxhash64("delivery_id"))))))
    by_key = Window.partitionBy("_alone", *LOGICAL_KEY, F.when(F.col("_alone"), F.xxhash64("delivery_id", "_record_sha256"))).orderBy(*attempt_order())
    df = df.withColumn("_first", F.first(F.struct("record_id", "payload_sha256")).over(by_key)).withColumn("_place", F.row_number().over(by_key))
    resolution = F.when(F.col("_bad_time"), "unique").when(F.col("_copies") > 1, "record_id_collision").when(F.col("_alone") | (F.col("_place") == 1), "unique").when(F.col("_first.payload_sha256") == F.col("payload_sha256"), "duplicate_delivery").otherwise("event_id_conflict")
    df = concluded(df.withColumn("duplicate_resolution", resolution).withColumn("_first_record_id", F.col("_first.record_id")))
    df = df.withColumn("payload_sha256", F.lower(F.hex("payload_sha256"))) if own else df
    return df.drop("_bad_time", "_alone", "_before", "_after", "_copies", "_first", "_first_record_id", "_place", "_record_sha256")


def deliveries(decided: DataFrame) -> DataFrame:
    return decided.select("delivery_id", "record_id", "canonical_record_id", "tenant_id", "app_id", "event_name", "ingestion_status", "duplicate_resolution", "timeliness", "clock_skew_suspected", "payload_disposition", "consent_reason", "consent_policy_version", "reason_code")


def rejections(decided: DataFrame) -> DataFrame:
    return decided.where("ingestion_status = 'rejected'").select(F.concat(F.lit("rejection:"), "delivery_id").alias("rejection_id"), "delivery_id", "record_id", "tenant_id", "app_id", "reason_code")


def accepted(decided: DataFrame) -> DataFrame:
    """Accepted first deliveries: one row a logical event."""
    return decided.where("ingestion_status = 'accepted' and duplicate_resolution = 'unique'")


def raw_records(decided: DataFrame) -> DataFrame:
    """Protected payloads: unique deliveries and conflicting ones, which keep their evidence."""
    return decided.where("payload_disposition = 'protected' and duplicate_resolution in ('unique', 'event_id_conflict')").select("record_id", "tenant_id", "app_id", "event_name", "received_at", "payload_sha256", "payload")


def redecide(batch: DataFrame, history: DataFrame) -> DataFrame:
    """Decisions of a new batch against the history of the logical keys and record ids that it touches."""
    keys, ids = batch.select(*LOGICAL_KEY).distinct(), batch.select("record_id").distinct()
    touched = history.join(keys, LOGICAL_KEY, "left_semi").unionByName(history.join(ids, "record_id", "left_semi")).dropDuplicates(["delivery_id", "record_id"])
    both = touched.withColumn("_new", F.lit(False)).unionByName(batch.withColumn("_new", F.lit(True)), allowMissingColumns=True)
    return decide(both).where("_new").drop("_new")


#: The fields that consumers read of each event's payload.
FACTS = {
    "click": "click_id string, tracking_link_id string, redirector_click_at string, redirector_time_status string, bot_prefetch boolean, replay_suspected boolean, campaign_id string, network string, country string, site_id string, remote_click_ref string",
    "install": "installation_id string, install_type string, click_id string, referrer_status string, third_party_referrer_classification string, install_begin_at_server string, install_begin_at_server_status string, referrer_click_at_server string, referrer_click_at_server_status string, campaign_id string, network string, country string",
    "session_start": "installation_id string, session_id string",
    "ad_revenue": "installation_id string, anchor_source string, impression_id string, ad_unit_id string, ad_network string, money struct<amount_unscaled:string,amount_scale:int,currency:string>, revenue_source string, country string",
    "purchase": "transaction_id string, money struct<amount_unscaled:string,amount_scale:int,currency:string>, financial_status string",
    "custom_event": "installation_id string, event_key string, attributes map<string,string>",
    "skan_postback": "signature_verified boolean, did_win boolean, source_identifier string, conversion_value int, coarse_conversion_value string, transaction_id string",
    "deep_link_open": "installation_id string, open_source string, click_id string, link_slug string",
}


def facts(events: DataFrame, event_name: str) -> DataFrame:
    """The narrow table of one event's facts; unknown events raise."""
    parsed = events.where(F.col("event_name") == event_name).withColumn("p", F.from_json("payload", FACTS[event_name]))
    return parsed.select("tenant_id", "app_id", "record_id", "event_id", "occurred_at", "received_at", F.expr("p.*"))


def conversion_bucket(fine: Column, coarse: Column) -> Column:
    return F.when(fine.isNotNull(), F.concat(F.lit("fine:"), fine.cast("string"))).when(coarse.isNotNull(), F.concat(F.lit("coarse:"), coarse))


def unknown_keys(payload: Column, allowed: list[str]) -> Column:
    """Names of a JSON object that a closed schema does not list."""
    return F.array_except(F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")), F.array(*[F.lit(a) for a in allowed]))


def missing_keys(payload: Column, required: list[str]) -> Column:
    return F.array_except(F.array(*[F.lit(r) for r in required]), F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")))


def reserved_names(payload: Column, names: list[str]) -> Column:
    """Whether a reserved name is a key at any depth of a JSON text, however it is spelled.

    The text is parsed and written again first, which undoes escapes in keys; then a name between quotes before
    a colon is a key, since a quote within a text is escaped.  What is no JSON is looked at as it stands.
    """
    return F.coalesce(F.to_json(F.try_parse_json(payload)), payload).rlike('"(?:' + "|".join(names) + ')"\\s*:')


STALE_POLICY = "struct<before:string,authority:string,policy_version:string,policy_digest:string>"
CLICK_POLICY = "struct<threshold_seconds:long,authority:string,policy_version:string,policy_digest:string>"


def policy_errors(attempts: DataFrame) -> DataFrame:
    """Attempts whose server policies do not have the digest of their fields, with the error (empty: the input is sound).

    attempts: record_id, timestamp_stale_policy (STALE_POLICY) and click_injection_policy (CLICK_POLICY), each null if
    there is none.
    """

    def wrong(name: str, *fields: str) -> Column:
        p = F.col(name)
        own = F.sha2(F.to_json(F.struct(*[p[f].alias(f) for f in sorted(fields)])), 256)
        return F.when(p.isNotNull() & ~p["policy_digest"].eqNullSafe(own), f"{name}.policy_digest does not match its canonical policy fields")

    error = F.coalesce(wrong("timestamp_stale_policy", "before", "authority", "policy_version"), wrong("click_injection_policy", "threshold_seconds", "authority", "policy_version"))
    return attempts.select("record_id", error.alias("error")).where("error is not null")


def with_stale_policy(attempts: DataFrame) -> DataFrame:
    """attempts with ``stale_before`` from their policy; a policy whose digest is wrong raises."""
    p = F.col("timestamp_stale_policy")
    own = F.sha2(F.to_json(F.struct(p["authority"].alias("authority"), p["before"].alias("before"), p["policy_version"].alias("policy_version"))), 256)
    checked = F.when(p["policy_digest"].eqNullSafe(own), p["before"]).otherwise(F.raise_error(F.lit("timestamp_stale_policy.policy_digest does not match its canonical policy fields")).cast("string"))
    return attempts.withColumn("stale_before", F.when(p.isNotNull(), checked)).drop("timestamp_stale_policy")


def assert_anchors(revenue: DataFrame, installs: DataFrame) -> DataFrame:
    """Revenue rows of installation scope that have no install to stand on (empty: the input is sound)."""
    keys = ["tenant_id", "app_id", "installation_id"]
    return revenue.where(F.col("installation_id").isNotNull()).join(installs.select(*keys).distinct(), keys, "left_anti")


def assert_provider_context(attempts: DataFrame) -> DataFrame:
    """Imported attempts whose context names another provider than their producer (empty: the input is sound).

    attempts: producer, import_provider.
    """
    return attempts.where(F.col("producer").startswith("import:") & F.col("import_provider").isNotNull() & (F.col("producer") != F.concat(F.lit("import:"), "import_provider")))


def assert_revenue_sources(attempts: DataFrame) -> DataFrame:
    """Ad revenue with an anchor source from a producer that is no postback (empty: the input is sound)."""
    return attempts.where((F.col("event_name") == "ad_revenue") & F.col("anchor_source").isNotNull() & ~F.col("producer").startswith("postback:"))


def assert_install_anchors(installs: DataFrame) -> DataFrame:
    """(record_id, error) of accepted installs that cannot stand: repeated anchors, reinstalls without their prior one.

    installs: tenant_id, app_id, record_id, installation_id, install_type, prior_installation_id.
    """
    scope = ["tenant_id", "app_id"]
    repeated = F.count("*").over(Window.partitionBy(*scope, "installation_id")) > 1
    known = installs.select(*scope, F.col("installation_id").alias("prior_installation_id")).distinct().withColumn("_known", F.lit(True))
    again = F.col("install_type").isin("reinstall", "redownload")
    error = (
        F.when(F.col("_repeated"), "ambiguous installation anchor")
        .when(again & (F.col("prior_installation_id").isNull() | (F.col("prior_installation_id") == F.col("installation_id"))), "invalid reinstall installation anchor")
        .when(again & F.col("_known").isNull(), "missing prior installation anchor")
        .when(~F.coalesce(again, F.lit(False)) & F.col("prior_installation_id").isNotNull(), "first install must not name a prior installation")
    )
    joined = installs.withColumn("_repeated", repeated).join(known, [*scope, "prior_installation_id"], "left")
    return joined.select(*scope, "record_id", error.alias("error")).where("error is not null")


def assert_references(references: DataFrame, records: DataFrame) -> DataFrame:
    """References (tenant_id, app_id, kind, ref_id, record_id) of privacy requests, corrections, expirations and refunds to records that their scope does not have."""
    return references.join(records.select("tenant_id", "app_id", "record_id").distinct(), ["tenant_id", "app_id", "record_id"], "left_anti")


def with_pre_ingestion(decided: DataFrame, refused: DataFrame) -> DataFrame:
    """Deliveries, and those that were refused before ingestion, which are unique, on time and discarded.

    refused: delivery_id, record_id, tenant_id, app_id, reason_code and the consent decision's columns.
    """
    fixed = {"ingestion_status": "rejected", "duplicate_resolution": "unique", "timeliness": "on_time", "payload_disposition": "discarded"}
    rows = refused.select("*", *[F.lit(v).alias(k) for k, v in fixed.items()], F.lit(False).alias("clock_skew_suspected"))
    return deliveries(decided).unionByName(rows, allowMissingColumns=True)


# Extension fields that carry secrets, or that only serve to open them.
PROTECTED = ("meta_install_referrer_protected", "meta_is_ct_unverified", "meta_actual_timestamp_unverified", "adservices_attribution_token_protected", "integrity_token_protected", "integrity_binding", "integrity_binding_mode", "integrity_provider")


def without_protected(records: DataFrame) -> DataFrame:
    """records whose extensions (a map) hold no secrets, with references to the stored body instead, and what to look up.

    records: record_id, producer, event_name, body_ref, extensions.  ``lookup`` and ``verification`` are
    null unless a token came; ``error`` says that a token came from a producer that cannot have it.
    """
    e = lambda name: F.try_element_at("extensions", F.lit(name))
    install = F.col("event_name") == "install"
    token, proof = F.when(install, e("adservices_attribution_token_protected")), e("integrity_token_protected")
    provider = F.when(F.col("producer") == "sdk-ios", "app_attest").otherwise("play_integrity")
    mode = F.when(install, "challenge").otherwise("request_hash")
    error = F.when(token.isNotNull() & ((F.col("producer") != "sdk-ios") | (token == "")), "adservices_token_scope_invalid").when(
        proof.isNotNull() & ~F.coalesce((e("integrity_provider") == provider) & (e("integrity_binding_mode") == mode) & (proof != "") & e("integrity_binding").isNotNull(), F.lit(False)), "integrity_token_scope_invalid"
    )
    referrer = install & e("meta_install_referrer_protected").isNotNull()
    refs = F.filter(
        F.array(*[F.when(c, F.struct(F.lit(k).alias("key"), v.alias("value"))) for c, k, v in ((token.isNotNull(), "adservices_token_evidence_ref", F.col("body_ref")), (proof.isNotNull(), "integrity_token_evidence_ref", F.col("body_ref")))]),
        lambda x: x.isNotNull(),
    )
    clean = F.map_concat(F.map_filter(F.coalesce("extensions", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*PROTECTED)), F.map_from_entries(refs))
    binding = F.when(mode == "request_hash", e("integrity_binding")).otherwise(F.sha2(e("integrity_binding"), 256))
    return (
        records.withColumn("error", error)
        .withColumn("lookup", F.when(token.isNotNull(), F.struct(F.col("record_id").alias("install_record_id"), F.col("body_ref").alias("token_ref"))))
        .withColumn("verification", F.when(proof.isNotNull(), F.struct(F.col("record_id").alias("subject_record_id"), provider.alias("provider"), binding.alias("binding_digest"))))
        .withColumn("protected_referrer_evidence_ref", F.when(referrer, F.concat(F.lit("payload:"), "body_ref")))
        .withColumn("extensions", clean)
    )


def durable_batches(requests: DataFrame) -> DataFrame:
    """Batches to append (tenant_id, app_id, producer, received_at, body as binary, event_count) with id, digest, state or error.

    A batch has 1 to 100 events; others carry ``event_count_out_of_range`` and no id.  The id follows from the time,
    the scope and the body's digest: a batch that is sent again at its time is the same batch.
    """
    error = F.when(~F.coalesce(F.col("event_count").between(1, 100), F.lit(False)), "event_count_out_of_range")
    seed = F.concat_ws(":", "tenant_id", "app_id", "producer", "body_digest")
    df = requests.withColumn("body_digest", F.sha2(F.coalesce("body", F.lit(b"")), 256)).withColumn("error", error)
    return df.withColumn("ingest_batch_id", F.when(F.col("error").isNull(), canon.uuid_v7(instants.millis(F.col("received_at")), seed))).withColumn("status", F.when(F.col("error").isNull(), "pending"))


def append_batches(requests: DataFrame, path: str) -> None:
    """Append sound batches, bodies included, to a folder by day that ``landing`` and batch readers take up."""
    sound = durable_batches(requests).where("error is null").drop("error").withColumn("received_day", F.substring("received_at", 1, 10))
    sound.dropDuplicates(["ingest_batch_id"]).write.mode("append").partitionBy("received_day").parquet(path)
