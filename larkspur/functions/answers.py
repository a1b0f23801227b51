"""What outside services answered: attribution lookups, integrity verdicts, encrypted referrers, conversion schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import canon

# The fields of a lookup's answer, and the words of its two enumerations.
LOOKUP = "attribution boolean, orgId string, campaignId string, adGroupId string, keywordId string, adId string, conversionType string, claimType string, countryOrRegion string, supplyPlacement string, clickDate string, impressionDate string"
CONVERSIONS, CLAIMS = ("Download", "Redownload", "PreOrder"), ("Click", "Impression")
PLAY = "requestDetails struct<requestHash:string,nonce:string>, appIntegrity struct<appRecognitionVerdict:string>, deviceIntegrity struct<deviceRecognitionVerdict:array<string>>"
ATTEST = "binding_digest string, app_id_valid boolean, signature_valid boolean, counter_valid boolean"
#: How long a token is good for; waits after a refusal of ours, a miss, and an error (doubled up to the most); misses until it is given up.
TOKEN_MS, LIMITED_MS, NOT_FOUND_MS, ERROR_MS, MOST_MS, MISSES = 23 * 3_600_000, 1000, 5000, 60_000, 3_600_000, 3
META_FIELDS = ("campaign_group_id", "campaign_id", "adgroup_id", "ad_id", "account_id", "ad_objective_name", "is_instagram", "publisher_platform", "platform_position")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lookup_answer(body: Column) -> Column:
    """struct(status, campaign_id, ..., error): an attribution lookup's answer in one form."""
    a = F.from_json(body, LOOKUP)
    wrong = (
        F.when(a["attribution"].isNull(), "adservices_attribution_invalid")
        .when(~a["attribution"], F.lit(None).cast("string"))
        .when(~a["conversionType"].isin(*CONVERSIONS), "conversion_type")
        .when(~a["claimType"].isin(*CLAIMS), "claim_type")
        .when(~a["countryOrRegion"].rlike("^[A-Z]{2}$"), "country_or_region")
    )
    names = {"org_id": "orgId", "campaign_id": "campaignId", "ad_group_id": "adGroupId", "keyword_id": "keywordId", "ad_id": "adId", "conversion_type": "conversionType", "claim_type": "claimType", "country_or_region": "countryOrRegion", "supply_placement": "supplyPlacement", "click_date": "clickDate", "impression_date": "impressionDate"}
    status = F.when(wrong.isNotNull(), F.lit(None)).when(a["attribution"], "attributed").otherwise("not_attributed")
    good = status == "attributed"
    return F.struct(status.alias("status"), *[F.when(good, a[src]).alias(name) for name, src in names.items()], wrong.alias("error"))


def lookup_step(status: Column, attempts: Column, age_ms: Column, now_ms: Column) -> Column:
    """struct(outcome, attempts, next_attempt_ms) after an answer with an HTTP status (null: none was asked for yet).

    A token is good for 23 hours.  Not found is asked again after 5 s and given up at the third miss;
    other errors wait 60 s doubled for each of up to three attempts, an hour at most.
    """
    more = attempts + 1
    few = F.least(F.lit(MISSES), more)
    wait = F.when(status == 404, F.lit(NOT_FOUND_MS).cast("long")).otherwise(F.least(F.lit(MOST_MS), F.lit(ERROR_MS) * F.pow(F.lit(2.0), few)).cast("long"))
    outcome = F.when(age_ms >= TOKEN_MS, "token_expired").when(status == 200, "answered").when(status == 400, "lookup_unavailable").when((status == 404) & (more >= MISSES), "lookup_unavailable").otherwise("retry")
    again = outcome == "retry"
    return F.struct(outcome.alias("outcome"), F.when(again, F.when(status == 404, more).otherwise(few)).cast("int").alias("attempts"), F.when(again, now_ms + wait).alias("next_attempt_ms"))


def integrity_observation(provider: Column, status: Column, body: Column) -> Column:
    """struct(binding, sound, down): what an integrity answer is bound to, whether it is sound, and whether the provider is overloaded or down."""
    p, other = F.from_json(body, PLAY), F.from_json(body, ATTEST)
    play = (p["appIntegrity"]["appRecognitionVerdict"] == "PLAY_RECOGNIZED") & F.array_contains(p["deviceIntegrity"]["deviceRecognitionVerdict"], "MEETS_DEVICE_INTEGRITY")
    attest = other["app_id_valid"] & other["signature_valid"] & other["counter_valid"]
    first = provider == "play_integrity"
    binding = F.when(first, F.coalesce(p["requestDetails"]["requestHash"], p["requestDetails"]["nonce"])).otherwise(other["binding_digest"])
    return F.struct(binding.alias("binding"), F.coalesce(F.when(first, play).otherwise(attest), F.lit(False)).alias("sound"), ((status == 429) | (status >= 500)).alias("down"))


def integrity_verdict(provider: Column, status: Column, body: Column, binding: Column) -> Column:
    """struct(verdict, retain_evidence): verified, failed, or unavailable while the provider is overloaded or down."""
    told = integrity_observation(provider, status, body)
    good = F.coalesce(told["sound"] & (told["binding"] == binding), F.lit(False))
    verdict = F.when(told["down"], "unavailable").when((status == 200) & good, "verified").otherwise("failed")
    return F.struct(verdict.alias("verdict"), (~told["down"]).alias("retain_evidence"))


def decrypt_referrer(data_hex: Column, nonce_hex: Column, keys: dict[str, str]) -> Column:
    """struct(status, key_id, context) of an AES-256-GCM referrer; ``keys`` maps key ids to 64 hexadecimal digits.

    Keys are tried in their order; a wrong key and altered data look the same.  context has the fields
    that are allowed, which must be texts or booleans; others are left out.
    """
    given = F.coalesce(F.nullif(data_hex, F.lit("")), F.nullif(nonce_hex, F.lit("")))
    shaped = F.coalesce(data_hex.rlike("^[a-fA-F0-9]+$") & nonce_hex.rlike("^[a-fA-F0-9]{24}$") & (F.length(data_hex) >= 34) & (F.length(data_hex) % 2 == 0), F.lit(False))
    found = [F.struct(F.lit(i).alias("key_id"), F.try_aes_decrypt(F.concat(F.unhex(nonce_hex), F.unhex(data_hex)), F.unhex(F.lit(k)), F.lit("GCM")).cast("string").alias("plaintext")) for i, k in keys.items() if len(k) == 64]
    first = F.try_element_at(F.filter(F.array(*found), lambda x: x["plaintext"].isNotNull()), F.lit(1)) if found else F.lit(None).cast("struct<key_id:string,plaintext:string>")

    def read(opened: Column) -> Column:
        value = F.try_parse_json(opened["plaintext"])
        parts = [F.struct(F.lit(f).alias("key"), F.try_variant_get(value, f"$.{f}", "string").alias("value"), F.schema_of_variant(F.try_variant_get(value, f"$.{f}", "variant")).alias("kind")) for f in META_FIELDS]
        return F.struct(opened["key_id"].alias("key_id"), opened.isNotNull().alias("opened"), F.json_object_keys(opened["plaintext"]).isNotNull().alias("object"), F.filter(F.array(*parts), lambda p: p["kind"].isNotNull()).alias("present"))

    def judged(r: Column) -> Column:
        good = r["object"] & (F.size(r["present"]) > 0) & F.forall(r["present"], lambda p: p["kind"].isin("STRING", "BOOLEAN"))
        status = F.when(given.isNull(), "absent").when(~shaped | F.lit(not found), "malformed").when(~r["opened"], "auth_failed").when(F.coalesce(good, F.lit(False)), "decrypted").otherwise("malformed")
        context = F.map_from_entries(F.transform(r["present"], lambda p: F.struct(p["key"], p["value"])))
        return F.struct(status.alias("status"), F.when(status == "decrypted", r["key_id"]).alias("key_id"), F.when(status == "decrypted", context).alias("context"))

    return bound(bound(F.when(shaped, first), read), judged)


def conversion_schema(definition: Column) -> Column:
    """Canonical JSON of a conversion schema's definition; null unless it is an object."""
    return F.when(F.json_object_keys(definition).isNotNull(), canon.canonical_text(definition))


def admin_request_digest(action: Column, target_scope: Column, target: Column, tenant: Column, app: Column) -> Column:
    """Digest of an administration request for the audit log: its five parts joined by a zero byte."""
    return F.sha2(F.concat_ws("\u0000", action, target_scope, target, tenant, app), 256)
