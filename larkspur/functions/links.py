"""Redirects and links: referrers, deep-link paths and parameters, the click a redirect records, app associations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The forms of click ids, deep-link paths and parameter values, and the longest path and referrer.
CLICK_ID = r"^[A-Za-z0-9_-]{22,128}$"
PATH = r"^/[A-Za-z0-9._~-]{1,64}(?:/[A-Za-z0-9._~-]{1,64}){0,7}$"
DOTS = r"/\.{1,2}(?:/|$)"
VALUE = r"^[A-Za-z0-9._~-]{1,64}$"
LONGEST_PATH, LONGEST_REFERRER = 256, 512
PREFIX = "dlp_"
#: Columns of a link that its clicks carry.
CARRIED = ("campaign_id", "ad_group_id", "creative_id", "network", "site_id")


def form_encode(text: Column) -> Column:
    """text as a form field: letters, digits and * - . _ stay, a space is a plus sign."""
    return F.url_encode(text)


def encode_referrer(click_id: Column, extras: Column | None = None) -> Column:
    """Install referrer of a click id and a map of extra parameters in order of their names; null for an invalid id."""
    base = F.concat(F.lit("omv=1&cid="), form_encode(click_id))
    if extras is not None:
        pairs = F.array_sort(F.map_entries(F.coalesce(extras, F.create_map().cast("map<string,string>"))))
        base = F.concat_ws("&", base, F.transform(pairs, lambda e: F.concat(form_encode(e["key"]), F.lit("="), form_encode(e["value"]))))
    return F.when(click_id.rlike(CLICK_ID), base)


def decode_referrer(referrer: Column) -> Column:
    """Map of the parameters of a referrer; of a repeated name the last value counts."""
    parts = F.filter(F.split(referrer, "&"), lambda p: p != "")
    pair = lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("key"), F.when(F.instr(p, "=") > 0, F.try_url_decode(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("value"))
    entries = F.transform(parts, pair)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def valid_deep_link(path: Column) -> Column:
    return F.coalesce((F.length(path) <= LONGEST_PATH) & path.rlike(PATH) & ~path.rlike(DOTS), F.lit(False))


def bind_parameters(given: Column, declared: Column) -> Column:
    """struct(values, dropped) of a map of query parameters: those declared, with the prefix and a plain value, are bound."""
    good = lambda k, v: k.startswith(PREFIX) & F.array_contains(declared, F.regexp_replace(k, f"^{PREFIX}", "")) & v.rlike(VALUE)
    kept = F.map_filter(given, lambda k, v: F.coalesce(good(k, v), F.lit(False)))
    return F.struct(F.transform_keys(kept, lambda k, v: F.regexp_replace(k, f"^{PREFIX}", "")).alias("values"), (F.size(given) - F.size(kept)).alias("dropped"))


def deferred_referrer(click_id: Column, path: Column, params: Column, longest: int = LONGEST_REFERRER) -> Column:
    """struct(referrer, status): the deep link goes along if it fits.  Raises for an invalid path."""
    minimal = encode_referrer(click_id)
    checked = F.when(F.assert_true(path.isNull() | valid_deep_link(path), F.lit("deep_link_value_invalid")).isNull(), path)
    named = F.transform_keys(F.coalesce(params, F.create_map().cast("map<string,string>")), lambda k, v: F.concat(F.lit(PREFIX), k))
    expanded = F.concat_ws("&", minimal, F.concat(F.lit("dl="), form_encode(checked)), F.transform(F.array_sort(F.map_entries(named)), lambda e: F.concat(form_encode(e["key"]), F.lit("="), form_encode(e["value"]))))
    status = F.when(path.isNull(), "not_configured").when(F.length(expanded) <= longest, "carried").otherwise("omitted_length")
    return F.struct(F.when(status == "carried", expanded).otherwise(minimal).alias("referrer"), status.alias("status"))


def redirects(requests: DataFrame, links: DataFrame, fallback: str, longest: int = LONGEST_REFERRER) -> DataFrame:
    """Where each request goes and what it leaves behind.

    requests: tracking_link_id, click_id, now, client_class, remote_click_ref, params (a map); links:
    tracking_link_id, status, tenant_id, app_id, destination_url, destination_kind, play_package_name,
    deep_link_value and the CARRIED columns.  An active link gives a click and its destination; an
    inactive or unknown one the fallback and no click.  A bot's request is marked as a prefetch.
    """
    df = requests.join(links, "tracking_link_id", "left").withColumn("active", F.coalesce(F.col("status") == "active", F.lit(False)))
    df = df.withColumn("d", F.when(F.col("active"), deferred_referrer(F.col("click_id"), F.col("deep_link_value"), F.col("params"), longest)))
    sign = F.when(F.instr("destination_url", "?") > 0, "&").otherwise("?")
    store = F.concat("destination_url", sign, F.lit("id="), form_encode(F.col("play_package_name")), F.lit("&referrer="), form_encode(F.col("d.referrer")))
    ready = F.when(F.assert_true(~F.coalesce((F.col("destination_kind") == "play_store") & F.col("active") & F.col("play_package_name").isNull(), F.lit(False)), F.lit("play_package_name_missing")).isNull(), F.col("active"))
    location = F.when(~ready, fallback).when(F.col("destination_kind") == "play_store", store).otherwise(F.col("destination_url"))
    carried = [F.when(F.col("active"), F.col(c)).alias(c) for c in (*CARRIED, "tenant_id", "app_id", "deep_link_value")]
    return df.select("tracking_link_id", "click_id", location.alias("location"), F.col("active").alias("is_click"), F.when(F.col("active"), F.col("now")).alias("redirector_click_at"), "client_class", "remote_click_ref", (F.col("active") & F.coalesce(F.col("client_class") == "bot", F.lit(False))).alias("bot_prefetch"), F.col("d.referrer").alias("referrer"), F.col("d.status").alias("deferred_deep_link_status"), *carried)


def prefetches(requests: DataFrame, links: DataFrame) -> DataFrame:
    """Evidence rows of requests that only looked at a link: no click id, no destination."""
    rows = requests.join(links, "tracking_link_id")
    return rows.select("tracking_link_id", "tenant_id", "app_id", F.col("now").alias("redirector_click_at"), F.coalesce("client_class", F.lit("bot")).alias("client_class"), F.lit(True).alias("bot_prefetch"), "remote_click_ref", *CARRIED)


def asset_links(identities: DataFrame) -> DataFrame:
    """(app_id, statement): the Android association of each app with a package and fingerprints, as JSON in order of app_id."""
    apps = identities.where("android_package_name is not null and size(android_sha256_fingerprints) > 0")
    target = F.struct(F.lit("android_app").alias("namespace"), F.col("android_package_name").alias("package_name"), F.sort_array("android_sha256_fingerprints").alias("sha256_cert_fingerprints"))
    return apps.select("app_id", F.to_json(F.struct(F.array(F.lit("delegate_permission/common.handle_all_urls")).alias("relation"), target.alias("target"))).alias("statement"))


def apple_associations(identities: DataFrame) -> DataFrame:
    """(app_id, detail): the Apple association of each app with a team and a bundle, as JSON."""
    apps = identities.where("apple_team_id is not null and apple_bundle_id is not null")
    return apps.select("app_id", F.concat(F.lit('{"appIDs":["'), "apple_team_id", F.lit("."), "apple_bundle_id", F.lit('"],"components":[{"/":"/r/*"}]}')).alias("detail"))


def newest_links(links: DataFrame, limit: int = 200) -> DataFrame:
    """The newest links of a listing, ties by id."""
    return links.orderBy(F.col("created_at").desc(), F.col("tracking_link_id").desc()).limit(limit)
