"""Normalisers of providers' answers to cost rows, and decoders of postbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import canon, instants, money
from larkspur.functions.text import query_value
from larkspur.operators.ledger import append_once

from . import mapping

COST = ["tenant_id", "app_id", "network", "campaign_id", "ad_group_id", "country", "date", "amount_unscaled", "amount_scale", "currency", "source", "as_of"]


def _cost(df: DataFrame, scope: dict[str, str], network: Column, campaign: Column, group: Column, country: Column, date: Column, amount: Column, currency: str | None = None) -> DataFrame:
    checked = F.when(F.assert_true(amount.isNotNull(), F.lit("cost amount must be a non-negative decimal within the scale")).isNull(), amount)
    return df.select(F.lit(scope["tenant_id"]).alias("tenant_id"), F.lit(scope["app_id"]).alias("app_id"), network.alias("network"), campaign.cast("string").alias("campaign_id"), group.alias("ad_group_id"), country.alias("country"), date.cast("string").alias("date"), checked.alias("amount_unscaled"), F.lit(6).alias("amount_scale"), F.lit((currency or scope["currency"]).upper()).alias("currency"), F.lit("imported_reported").alias("source"), F.lit(scope["as_of"]).alias("as_of"))


def daily_spend(scope: dict[str, str], rows: DataFrame, network: str) -> DataFrame:
    """Rows (campaign_id, adset_id, country, date_start, spend as decimal text)."""
    return _cost(rows, scope, F.lit(network), F.col("campaign_id"), F.nullif(F.col("adset_id").cast("string"), F.lit("")), F.upper(F.nullif(F.col("country"), F.lit(""))), F.col("date_start"), money.decimal_to_unscaled(F.col("spend").cast("string")))


def micro_spend(scope: dict[str, str], rows: DataFrame, countries: DataFrame, network: str) -> DataFrame:
    """Rows (campaign_id, ad_group_id, is_app_campaign, country_criterion_id, date, cost_micros); unmapped countries raise.

    countries (criterion_id, country) is a code list of some hundred rows; it is broadcast up to a thousand.
    """
    small = countries.select(F.col("criterion_id").cast("string").alias("country_criterion_id"), F.col("country").alias("_country"))
    small = F.broadcast(small) if small.count() <= 1000 else small
    joined = rows.withColumn("country_criterion_id", F.col("country_criterion_id").cast("string")).join(small, "country_criterion_id", "left")
    country = F.when(F.assert_true(F.col("_country").isNotNull(), F.lit("country criterion is unmapped")).isNull(), F.col("_country"))
    group = F.when(~F.coalesce(F.col("is_app_campaign"), F.lit(False)), F.nullif(F.col("ad_group_id").cast("string"), F.lit("")))
    return _cost(joined, scope, F.lit(network), F.col("campaign_id"), group, country, F.col("date"), F.col("cost_micros").cast("string"))


def revenue_backfill(scope: dict[str, str], rows: DataFrame, network: str) -> DataFrame:
    """Rows (network, ad_unit_id, country, day, estimated_revenue as decimal text), in US dollars."""
    return _cost(rows, scope, F.coalesce(F.col("network"), F.lit(network)), F.coalesce(F.col("ad_unit_id"), F.lit("aggregate")), F.lit(None).cast("string"), F.upper(F.nullif(F.col("country"), F.lit(""))), F.col("day"), money.decimal_to_unscaled(F.col("estimated_revenue").cast("string")), "USD")


def dimension_digest(dims: list[str]) -> Column:
    """Digest of the dimensions that are present."""
    return canon.digest({d: F.col(d).cast("string") for d in dims})


def cost_records(rows: DataFrame, dims: tuple[str, ...] = ("tenant_id", "app_id", "network", "campaign_id", "ad_group_id", "country", "date")) -> DataFrame:
    """Cost rows with their key digest and a deterministic id, one a digest of content."""
    keyed = rows.withColumn("cost_key_digest", dimension_digest(list(dims)))
    ids = canon.identifier("cost:", {"key": F.col("cost_key_digest"), "as_of": F.col("as_of"), "amount": F.col("amount_unscaled"), "currency": F.col("currency")})
    return keyed.withColumn("cost_record_id", ids).dropDuplicates(["cost_record_id"])


def cost_file(plan: dict, rows: DataFrame) -> DataFrame:
    """Cost rows of an imported file: its rows filtered and mapped by a mapping of kind manual_cost.

    Rows that lack a required value, or whose date or time is none, raise when they are evaluated.
    """
    if plan.get("kind") != "manual_cost":
        raise ValueError("a cost import requires a manual_cost mapping")
    mapped = mapping.apply(plan, rows)
    have = {f.name for f in mapped.schema["mapped"].dataType.fields}
    get = lambda name: F.col(f"mapped.{name}") if name in have else F.lit(None).cast("string")
    date, as_of = get("date"), instants.normalize(get("as_of"))
    wrong = F.coalesce(
        F.col("error"),
        F.when(get("network").isNull() | (get("network") == ""), "mapped network is required"),
        F.when(~F.coalesce(date.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False)), "mapped date must be YYYY-MM-DD"),
        F.when(as_of.isNull(), "mapped as_of must be a timestamp"),
    )
    checked = mapped.where(F.assert_true(wrong.isNull(), wrong).isNull())
    money_ = F.col("mapped.money")
    values = {"tenant_id": F.lit(plan["tenant_id"]), "app_id": F.lit(plan["app_id"]), "network": get("network"), "campaign_id": get("campaign_id"), "ad_group_id": get("ad_group_id"), "country": get("country"), "date": date, "amount_unscaled": money_["amount_unscaled"].cast("string"), "amount_scale": money_["amount_scale"].cast("int"), "currency": money_["currency"], "source": F.lit("imported_reported"), "as_of": as_of}
    return checked.select(*[v.alias(k) for k, v in values.items()])


def append_costs(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The cost records that an import adds: of one scope, in a sound money form, and not stored yet.

    Each has the digest of its content, which is its id, and the digest of its dimensions; repeated
    rows of a file add one record.
    """
    sound = F.col("currency").rlike("^[A-Z]{3}$") & F.col("amount_unscaled").rlike("^[0-9]+$")
    checked = rows.where(F.assert_true(F.coalesce(sound, F.lit(False)), F.lit("cost money representation is invalid")).isNull())
    scopes = rows.select("tenant_id", "app_id").distinct().limit(2).count()
    if scopes > 1:
        raise ValueError("a cost import cannot mix tenant or app scopes")
    new = cost_records(checked)
    return new if stored is None else append_once(new, stored, ["cost_record_id"])


def query_postbacks(lines: DataFrame, query: str = "query") -> DataFrame:
    """Revenue postbacks from query strings: a user id decides their scope; times are unix seconds."""
    q = F.col(query)
    user = F.nullif(query_value(q, "user_id"), F.lit(""))
    amount = money.decimal_to_unscaled(query_value(q, "revenue"), 9)
    seconds = F.when(query_value(q, "ts").rlike("^[0-9]{1,12}$"), query_value(q, "ts").cast("long"))
    return lines.select("*", F.when(user.isNull(), "aggregate").otherwise("installation_level").alias("subject_scope"), user.alias("installation_id"), query_value(q, "network").alias("ad_network"), query_value(q, "ad_unit_id").alias("ad_unit_id"), amount.alias("amount_unscaled"), seconds.alias("occurred_s"), F.when(amount.isNull(), "revenue_invalid").when(seconds.isNull(), "timestamp_invalid").alias("error"))


def aggregate_postbacks(rows: DataFrame) -> DataFrame:
    """Aggregate postbacks of two versions in one form; fields that a version does not have are null."""
    v4 = F.col("version").cast("double") >= 4
    return rows.select("record_id", "version", "transaction_id", F.when(v4, F.col("source_identifier")).otherwise(F.lpad(F.col("campaign_id").cast("string"), 2, "0")).alias("source_identifier"), F.col("conversion_value"), F.when(v4, F.col("coarse_conversion_value")).alias("coarse_conversion_value"), F.when(v4, F.coalesce(F.col("postback_sequence_index"), F.lit(0))).otherwise(F.lit(0)).alias("sequence_index"), F.coalesce(F.col("did_win"), F.lit(True)).alias("did_win"))
