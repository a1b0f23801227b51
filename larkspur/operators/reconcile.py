"""Reconciliation of internal records with external reports by matching keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import matching_key

KEY = "struct<type:string,value:string,normalization:string,cardinality:string,value_encoding:string>"
SCOPE = ["tenant_id", "app_id"]


def _keys(column: str):
    one = lambda k: matching_key(k["type"], k["value"], k["normalization"], k["value_encoding"])
    return F.sort_array(F.transform(F.coalesce(F.col(column), F.array().cast(f"array<{KEY}>")), one))


def reconcile(inputs: DataFrame, candidates: DataFrame) -> DataFrame:
    """One result an input: the reason of its difference and the candidates it matched.

    inputs: tenant_id, app_id, reconciliation_id, matching_keys, privacy_effect,
    provider_modeled_without_candidate, freshness.  candidates: tenant_id, app_id,
    reconciliation_id, candidate_id, matching_keys, window_status, freshness, excluded,
    exclusion_reason, position (their order within the input).  Keys are exploded and joined, so no
    pair of an input and a candidate exists unless they share a key.  Repeated keys match once and stay in
    ``keys`` and ``joins``; of candidates at one position the smallest id is first.
    """
    ids = [*SCOPE, "reconciliation_id"]
    left = inputs.withColumn("keys", _keys("matching_keys"))
    a = left.select(*ids, F.explode(F.array_distinct("keys")).alias("key"))
    b = candidates.withColumn("keys", _keys("matching_keys")).select(*ids, "candidate_id", "position", "window_status", "freshness", "excluded", "exclusion_reason", F.explode(F.array_distinct("keys")).alias("key"))
    hits = a.join(b, [*ids, "key"]).drop("key").distinct()
    first = F.min(F.struct("position", "candidate_id", "excluded", "window_status", "freshness"))
    matched = hits.groupBy(*ids).agg(
        F.count("*").alias("n"),
        first.alias("first"),
        F.sort_array(F.collect_list("candidate_id")).alias("candidates"),
        F.sort_array(F.collect_list(F.when(F.col("excluded"), F.col("exclusion_reason")))).alias("exclusions"),
        F.sort_array(F.collect_list(F.concat_ws(":", "candidate_id", "window_status"))).alias("windows"),
    )
    df = left.join(matched, ids, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    typed = F.exists(F.coalesce("matching_keys", F.array().cast(f"array<{KEY}>")), lambda k: k["type"].isin("provider_click_id", "provider_install_id"))
    single = F.exists(F.coalesce("matching_keys", F.array().cast(f"array<{KEY}>")), lambda k: F.coalesce(k["cardinality"] == "one_to_one", F.lit(False)))
    reason = (
        F.when(F.col("privacy_effect") == "redaction", "redaction_caused_recalculation")
        .when(F.coalesce("provider_modeled_without_candidate", F.lit(False)) & (F.col("n") == 0), "provider_modeled_conversion")
        .when(F.size("keys") == 0, "join_key_missing")
        .when((F.col("n") == 0) & typed, "candidate_missing")
        .when(F.col("n") == 0, "external_row_unmatched")
        .when((F.col("n") > 1) & single, "join_key_ambiguous")
        .when(F.col("first.excluded"), "candidate_excluded")
        .when(F.col("first.window_status") == "out_of_window", "window_mismatch")
        .when(F.col("first.freshness") == "stale", "freshness_mismatch")
        .otherwise("matched")
    )
    joins = F.transform("candidates", lambda c: F.concat(F.array_join("keys", ","), F.lit("=>"), c))
    empty = F.array().cast("array<string>")
    return df.select(*ids, reason.alias("difference_reason_code"), "keys", *[F.coalesce(c, empty).alias(c) for c in ("candidates", "exclusions", "windows")], F.coalesce(joins, empty).alias("joins"), F.coalesce("first.freshness", "freshness").alias("freshness"))


def imported_inputs(installs: DataFrame) -> DataFrame:
    """Reconciliation inputs of imported installs: one key for each provider reference that is present."""
    part = lambda c, kind: F.when(F.col(c).isNotNull(), F.struct(F.lit(kind).alias("type"), F.col(c).alias("value"), F.lit("identity").alias("normalization"), F.lit("one_to_one").alias("cardinality"), F.lit(None).cast("string").alias("value_encoding")))
    keys = F.filter(F.array(part("provider_click_ref", "provider_click_id"), part("provider_install_ref", "provider_install_id")), lambda k: k.isNotNull())
    return installs.where(F.col("producer").startswith("import:")).select(*SCOPE, F.concat(F.lit("reconciliation:"), "record_id").alias("reconciliation_id"), keys.alias("matching_keys"), F.lit(None).cast("string").alias("privacy_effect"), (F.coalesce(F.col("provider_attribution_strategy") == "modeled", F.lit(False))).alias("provider_modeled_without_candidate"), F.lit("fresh").alias("freshness"))


def duplicate_identities(inputs: DataFrame) -> DataFrame:
    """Identities that occur more than once (empty: the input is sound)."""
    return inputs.groupBy(*SCOPE, "reconciliation_id").agg(F.count("*").alias("n")).where("n > 1")
