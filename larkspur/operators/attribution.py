"""Attribution decisions: one reason for each install, postback or deep-link open.

Clicks are reduced to one row a key before they are joined, so a click id that is shared by
thousands of rows stays one join partner; the decisions themselves are ordered expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import instants

from .ledger import unique_match

WINDOW_MS = 7 * instants.DAY_MS


def _decision(*rules: tuple[Column, str, str, str, str]) -> Column:
    """First rule that holds, as struct(status, method, model, reason_code)."""
    out = None
    for test, *values in rules:
        pick = F.struct(*[F.lit(v).alias(n) for n, v in zip(("status", "method", "model", "reason_code"), values)])
        out = F.when(test, pick) if out is None else out.when(test, pick)
    return out


def installs(events: DataFrame, clicks: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """Decisions for install rows.

    events: tenant_id, app_id, record_id, producer, occurred_at, received_at, installation_id, click_id,
    referrer_status, third_party_referrer_classification, install_begin_at_server(_status),
    encrypted_referrer_status, adservices_status, and, of imports, has_import_context,
    provider_attributed, provider_attribution_strategy, provider_confirmed_at, provider_click_ref.
    clicks: accepted unique clicks with tenant_id, app_id, record_id, click_id, producer,
    remote_click_ref, bot_prefetch, redirector_click_at, redirector_time_status.
    """
    scoped = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("\u0001", "tenant_id", "app_id", c))
    fields = ["record_id", "bot_prefetch", "redirector_click_at", "redirector_time_status"]
    by_id = clicks.select(scoped("click_id").alias("_ck"), *fields)
    by_ref = clicks.where("producer = 'redirector'").select(scoped("remote_click_ref").alias("_rk"), "record_id")
    df = events.withColumn("_ik", scoped("click_id")).withColumn("_pk", scoped("provider_click_ref"))
    df = unique_match(df, by_id, "_ik", "_ck", fields, "click_")
    df = unique_match(df, by_ref, "_pk", "_rk", ["record_id"], "ref_")
    imported = F.col("producer").startswith("import:")
    context, provider = F.coalesce(F.col("has_import_context"), F.lit(False)), F.coalesce(F.col("provider_attributed"), F.lit(False))
    strategy = F.col("provider_attribution_strategy")
    click_time = F.coalesce(F.col("click_redirector_time_status"), F.lit("available"))
    begin = F.col("install_begin_at_server")
    begin_time = F.coalesce(F.col("install_begin_at_server_status"), F.when(begin.isNotNull(), "available").otherwise("missing"))
    delta = instants.millis(begin) - instants.millis(F.col("click_redirector_click_at"))
    df = df.withColumn("ctit_ms", delta)
    none = ("none", "none")
    # Status, method, model and reason of each outcome, in the order that the contract ranks them.
    decision = _decision(
        (imported & ~context, "unattributed", "imported", "provider_reported", "provider_unattributed"),
        (imported & provider & (F.coalesce(strategy, F.lit("")) == "modeled"), "non_organic", "imported", "provider_reported", "provider_modeled_conversion"),
        (imported & provider & F.col("provider_confirmed_at").isNull(), "non_organic", "imported", "provider_reported", "provider_time_authority_unavailable"),
        (imported & provider, "non_organic", "imported", "provider_reported", "provider_attributed"),
        (imported & (F.coalesce(strategy, F.lit("")) == "organic"), "organic", "imported", "provider_reported", "provider_organic"),
        (imported, "unattributed", "imported", "provider_reported", "provider_unattributed"),
        (F.col("encrypted_referrer_status") == "decrypted", "non_organic", "meta_install_referrer", "last_click", "meta_referrer_decrypted"),
        (F.col("encrypted_referrer_status").isin("decrypt_failed", "auth_failed"), "unattributed", "meta_install_referrer", "last_click", "meta_referrer_decrypt_failed"),
        (F.col("adservices_status") == "attributed", "non_organic", "apple_adservices", "last_click", "adservices_attributed"),
        (F.col("adservices_status") == "token_expired", "unattributed", "apple_adservices", "last_click", "adservices_token_expired"),
        (F.col("adservices_status") == "not_attributed", "unattributed", "apple_adservices", "last_click", "adservices_not_attributed"),
        (F.col("adservices_status") == "lookup_unavailable", "unattributed", "apple_adservices", "last_click", "adservices_lookup_unavailable"),
        (F.col("referrer_status") == "none", "organic", *none, "no_referrer"),
        ((F.col("referrer_status") == "third_party") & (F.col("third_party_referrer_classification") == "play_organic_marker"), "organic", *none, "no_first_party_referrer"),
        (F.col("referrer_status") == "third_party", "unattributed", *none, "foreign_referrer_unresolved"),
        (F.col("referrer_status") == "unsupported", "unattributed", *none, "install_referrer_unsupported"),
        (F.col("referrer_status") == "unavailable", "unattributed", *none, "install_referrer_unavailable"),
        (F.col("referrer_status") == "not_applicable", "unattributed", *none, "platform_referrer_not_available"),
        (F.col("click_count") == 0, "unattributed", *none, "unknown_click_id"),
        (F.col("click_count") > 1, "unattributed", *none, "ambiguous_click_id"),
        (F.coalesce(F.col("click_bot_prefetch"), F.lit(False)), "unattributed", *none, "bot_prefetch"),
        ((click_time == "invalid") | (begin_time == "invalid"), "unattributed", *none, "authoritative_time_invalid"),
        ((click_time != "available") | (begin_time != "available") | F.col("click_redirector_click_at").isNull() | begin.isNull(), "unattributed", *none, "authoritative_time_missing"),
        ((delta < 0) | (delta >= window_ms), "unattributed", *none, "window_expired"),
        (F.lit(True), "non_organic", "install_referrer", "last_click", "valid_install_referrer"),
    )
    df = df.withColumn("d", decision)
    click = F.when(F.col("d.reason_code").isin("bot_prefetch", "valid_install_referrer"), F.col("click_record_id")).when(imported & provider, F.col("ref_record_id"))
    refs = F.filter(F.array(click, F.col("record_id")), lambda x: x.isNotNull())
    return df.select(F.concat(F.lit("attr:"), "record_id").alias("attribution_id"), "tenant_id", "app_id", "record_id", F.col("installation_id").alias("subject_ref"), "d.*", refs.alias("evidence_refs"), F.col("occurred_at").alias("effective_at"), F.col("received_at").alias("decided_at"), "ctit_ms", F.lit("final").alias("finality"), F.lit(None).cast("string").alias("supersedes_attribution_id"))


def after_lifecycle(attributions: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Attributions, replaced where an evidence record is no longer available.

    lifecycle: tenant_id, app_id, record_id, lifecycle_status.  A replacement is marked superseded and
    names the decision it replaces.
    """
    gone = lifecycle.where("lifecycle_status <> 'available'").select("tenant_id", "app_id", F.col("record_id").alias("ref"))
    hit = attributions.select("tenant_id", "app_id", "attribution_id", F.explode("evidence_refs").alias("ref")).join(gone, ["tenant_id", "app_id", "ref"], "left_semi").select("tenant_id", "app_id", "attribution_id").distinct().withColumn("_hit", F.lit(True))
    df = attributions.join(hit, ["tenant_id", "app_id", "attribution_id"], "left")
    return (
        df.withColumn("supersedes_attribution_id", F.when(F.col("_hit"), F.col("attribution_id")).otherwise(F.col("supersedes_attribution_id")))
        .withColumn("finality", F.when(F.col("_hit"), "superseded").otherwise(F.col("finality")))
        .withColumn("attribution_id", F.when(F.col("_hit"), F.concat("attribution_id", F.lit(":recalculated"))).otherwise(F.col("attribution_id")))
        .drop("_hit")
        .select(*attributions.columns)
    )


def postbacks(events: DataFrame) -> DataFrame:
    """Decisions for aggregate postbacks: signature, then winner, then source, then value."""
    kind = F.when(F.col("event_name") == "skan_postback", "skadnetwork").otherwise("adattributionkit")
    reason = (
        F.when(~F.coalesce(F.col("signature_verified"), F.lit(False)), "skan_signature_invalid")
        .when(~F.coalesce(F.col("did_win"), F.lit(False)), "postback_not_winner")
        .when(F.col("source_identifier").isNull(), "crowd_anonymity_suppressed")
        .when(F.col("conversion_value").isNull() & F.col("coarse_conversion_value").isNull(), "conversion_value_null")
        .otherwise("skan_postback_verified")
    )
    df = events.withColumn("method", kind).withColumn("reason_code", reason).withColumn("model", F.lit("aggregate"))
    df = df.withColumn("status", F.when(F.col("reason_code") == "skan_postback_verified", "non_organic").otherwise("unattributed"))
    return df.withColumn("attribution_id", F.concat(F.lit("attr:"), "record_id")).withColumn("subject_ref", F.concat(F.lit("aggregate:"), "method", F.lit(":"), "record_id"))


def deep_links(opens: DataFrame) -> DataFrame:
    """Decisions for deep-link opens with resolution_status and install_click_id; an install's click does not count twice."""
    reused = (F.col("open_source") == "android_deferred_referrer") & F.coalesce(F.col("install_click_id") == F.col("click_id"), F.lit(False))
    reason = F.when(reused, "deep_link_install_click_reused").when(F.col("resolution_status") == "active", "deep_link_open_attributed").when(F.col("resolution_status") == "inactive", "deep_link_link_inactive").otherwise("deep_link_unknown_link")
    df = opens.withColumn("reason_code", reason).withColumn("status", F.when(F.col("reason_code") == "deep_link_open_attributed", "non_organic").otherwise("unattributed"))
    return df.withColumn("attribution_id", F.concat(F.lit("attr:engagement:"), "record_id")).withColumn("method", F.lit("deep_link")).withColumn("model", F.lit("last_click"))


def resolve_links(opens: DataFrame, links: DataFrame, clicks: DataFrame) -> DataFrame:
    """opens with the link they mean, by slug or else by their click, and its status."""
    own = links.select("tenant_id", "app_id", F.col("slug").alias("link_slug"), F.col("tracking_link_id").alias("slug_link"), F.col("status").alias("slug_status")).dropDuplicates(["tenant_id", "app_id", "link_slug"])
    by_click = clicks.where("click_id is not null").groupBy("tenant_id", "app_id", "click_id").agg(F.max(F.struct("received_at", "tracking_link_id"))["tracking_link_id"].alias("click_link"))
    status = links.select("tenant_id", "app_id", F.col("tracking_link_id").alias("click_link"), F.col("status").alias("click_status")).dropDuplicates(["tenant_id", "app_id", "click_link"])
    df = opens.join(own, ["tenant_id", "app_id", "link_slug"], "left").join(by_click, ["tenant_id", "app_id", "click_id"], "left").join(status, ["tenant_id", "app_id", "click_link"], "left")
    return df.withColumn("resolved_link", F.coalesce("slug_link", "click_link")).withColumn("resolution_status", F.coalesce("slug_status", "click_status", F.lit("unknown"))).drop("slug_link", "slug_status", "click_link", "click_status")


def exclude_for_fraud(attributions: DataFrame, excluded_clicks: DataFrame) -> DataFrame:
    """Attributions and, for those that rest on an excluded click, a superseding unattributed one."""
    hit = attributions.where("status = 'non_organic'").withColumn("click_record_id", F.try_element_at("evidence_refs", F.lit(1)))
    hit = hit.join(excluded_clicks.select("click_record_id").distinct(), "click_record_id", "left_semi").drop("click_record_id")
    new = hit.withColumn("supersedes_attribution_id", F.col("attribution_id")).withColumn("attribution_id", F.concat("attribution_id", F.lit(":fraud"))).withColumn("status", F.lit("unattributed")).withColumn("reason_code", F.lit("fraud_excluded"))
    return attributions.unionByName(new.select(*attributions.columns))


def superseding(stored: DataFrame, fresh: DataFrame, suffix: str) -> DataFrame:
    """Decisions of fresh that differ from the stored one of their subject, as rows that supersede it."""
    old = stored.select("tenant_id", "app_id", "record_id", F.col("attribution_id").alias("_old"), F.col("reason_code").alias("_reason"))
    new = fresh.join(old, ["tenant_id", "app_id", "record_id"]).where("reason_code <> _reason")
    return new.withColumn("supersedes_attribution_id", F.col("_old")).withColumn("attribution_id", F.concat("_old", F.lit(f":{suffix}"))).select(*fresh.columns)


# Reasons of lookups by what came of them.
LOOKUP_REASONS = {"attributed": "adservices_attributed", "not_attributed": "adservices_not_attributed", "token_expired": "adservices_token_expired", "lookup_unavailable": "adservices_lookup_unavailable"}


def complete_lookups(attributions: DataFrame, completions: DataFrame) -> DataFrame:
    """Decisions that supersede those of installs whose lookup was completed, one a completion.

    attributions: tenant_id, app_id, record_id (the install), attribution_id, status, reason_code, evidence_refs and what else a
    decision has; completions: tenant_id, app_id, install_record_id, status, response_ref, response_digest, decided_at.
    A dropped lookup changes nothing; a completion of an install without a decision raises.  The id follows
    from the answer, so a completion that runs again gives the same row.
    """
    reasons = F.create_map(*[F.lit(x) for pair in LOOKUP_REASONS.items() for x in pair])
    done = completions.where(F.col("status").isin(*LOOKUP_REASONS)).select("tenant_id", "app_id", F.col("install_record_id").alias("record_id"), F.col("status").alias("_status"), "response_ref", "response_digest", F.col("decided_at").alias("_at"))
    joined = done.join(attributions.withColumn("_met", F.lit(True)), ["tenant_id", "app_id", "record_id"], "left")
    prior = F.when(F.col("_met"), F.col("attribution_id")).otherwise(F.raise_error(F.lit("adservices_install_attribution_missing")).cast("string"))
    reason = F.element_at(reasons, F.col("_status"))
    seed = F.concat_ws("\u0000", "tenant_id", "app_id", "record_id", "response_digest", reason)
    new = joined.withColumn("supersedes_attribution_id", prior).withColumn("attribution_id", F.concat(F.lit("attr:adservices:"), F.substring(F.sha2(seed, 256), 1, 48)))
    new = new.withColumn("status", F.when(F.col("_status") == "attributed", "non_organic").otherwise("unattributed")).withColumn("reason_code", reason).withColumn("decided_at", F.col("_at"))
    new = new.withColumn("evidence_refs", F.concat(F.coalesce("evidence_refs", F.array().cast("array<string>")), F.array("response_ref")))
    fixed = {"method": "apple_adservices", "model": "last_click", "finality": "final"}
    new = new.withColumns({k: F.lit(v) for k, v in fixed.items()})
    return new.drop("_status", "_at", "_met", "response_ref", "response_digest")
