"""Text expressions of the domain: matching keys, client classes, referrers, links, postback messages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# User-agent tokens of automated clients and of phones.
BOT_TOKENS = ("bot", "crawler", "spider", "preview")
PHONE_TOKENS = ("android", "iphone", "ipad")
# Separator of the fields of a signed postback message.
SEPARATOR = "⁣"

# White space at the edges of a text, line ends and the byte order mark included.
EDGES = r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def matching_key(kind: Column, value: Column, normalization: Column, encoding: Column | None = None) -> Column:
    """type:[encoding:]value with the value as its normalization says."""
    form = F.when(normalization == "lowercase_ascii", lower_ascii(value)).when(normalization == "trim", F.regexp_replace(value, EDGES, "")).otherwise(value)
    middle = F.coalesce(F.concat(encoding, F.lit(":")), F.lit("")) if encoding is not None else F.lit("")
    return F.concat(kind, F.lit(":"), middle, form)


def client_class(user_agent: Column) -> Column:
    agent = F.lower(F.coalesce(user_agent, F.lit("")))
    return F.when(agent.rlike("|".join(BOT_TOKENS)), "bot").when(agent.rlike("|".join(PHONE_TOKENS)), "mobile_app_eligible").otherwise("other")


def query_value(query: Column, name: str) -> Column:
    """First value of a name in a query string, decoded; null if it is missing."""
    raw = F.regexp_extract(query, rf"(?:^|&){name}=([^&]*)", 1)
    return F.when(query.rlike(rf"(?:^|&){name}="), F.try_url_decode(raw))


def referrer_outcome(response: Column, referrer: Column) -> Column:
    """What an install-referrer client's answer means: struct(status, retry, terminal_reason, click_id)."""
    text = F.coalesce(referrer, F.lit(""))
    click = F.nullif(query_value(text, "cid"), F.lit(""))
    ok = response == "ok"
    given = ok & (text != "")
    status = F.when(given, "available").when(ok, "none").when(response == "feature_not_supported", "unsupported").otherwise("unavailable")
    retry = F.when(ok | response.isin("feature_not_supported", "developer_error"), "none").otherwise("bounded")
    reason = (
        F.when(given & click.isNotNull(), F.lit(None).cast("string"))
        .when(given, "unknown_click_id")
        .when(ok, "no_referrer")
        .when(response == "feature_not_supported", "install_referrer_unsupported")
        .otherwise("install_referrer_unavailable")
    )
    return F.struct(status.alias("referrer_status"), retry.alias("retry"), reason.alias("terminal_reason"), F.when(given, click).alias("click_id"))


def destination_error(url: Column, origins: list[str]) -> Column:
    """Why a redirect must not go to a URL; null if it may.

    Store pages may always be opened; else the scheme is https and the origin (host and port) is listed.
    """
    part = lambda name: F.try_parse_url(url, F.lit(name))
    scheme, host, path = F.lower(part("PROTOCOL")), F.lower(part("HOST")), part("PATH")
    port = F.regexp_extract(part("AUTHORITY"), r":([0-9]+)$", 1)
    origin = F.concat(scheme, F.lit("://"), host, F.when(port.isin("", "443"), "").otherwise(F.concat(F.lit(":"), port)))
    store = ((scheme == "market") & (host == "details")) | ((scheme == "https") & (host == "play.google.com") & (path == "/store/apps/details") & port.isin("", "443"))
    listed = [re.sub(r":443$", "", o.lower().rstrip("/")) for o in origins]
    return (
        F.when(scheme.isNull() | host.isNull(), "destination_invalid")
        .when(part("USERINFO").isNotNull(), "destination_credentials_forbidden")
        .when(store, F.lit(None).cast("string"))
        .when(scheme != "https", "destination_scheme_not_allowed")
        .when(~origin.isin(listed), "destination_origin_not_allowed")
    )


def allowed_destination(url: Column, origins: list[str]) -> Column:
    return destination_error(url, origins).isNull()


def signed_message(fields: list[Column]) -> Column:
    """Fields of a postback in order, absent ones left out, joined by the invisible separator."""
    return F.concat_ws(SEPARATOR, *[f.cast("string") for f in fields])


# The fields of a signed postback by version, in the order in which they are signed, and the kind of each.
SIGNED = {
    3: ("version:text", "ad-network-id:text", "campaign-id:integer", "app-id:integer", "transaction-id:text", "redownload:boolean", "source-app-id:integer?", "fidelity-type:integer", "did-win:boolean"),
    4: ("version:text", "ad-network-id:text", "source-identifier:text", "app-id:integer", "transaction-id:text", "redownload:boolean", "source-app-id:integer|source-domain:text", "fidelity-type:integer", "did-win:boolean", "postback-sequence-index:integer"),
}


def postback_message(body: Column) -> Column:
    """struct(message, error) of a postback's JSON text: its signed fields in the order of its version.

    error names the first field that is missing (a text) or invalid (an integer from 0, a boolean), or an
    unsupported version; a field with ``?`` may be left out, of two joined by a bar the first that is there counts.
    """
    parsed = F.try_parse_json(body)
    get = lambda name, kind: F.try_variant_get(parsed, f"$['{name}']", kind)
    there = lambda name: get(name, "variant").isNotNull()
    kind_of = lambda name: F.regexp_extract(F.schema_of_variant(get(name, "variant")), "^[A-Z]+", 0)

    def one(field: str) -> tuple[Column, Column]:
        name, kind = field.rstrip("?").split(":")
        found = F.coalesce(kind_of(name), F.lit(""))
        if kind == "text":
            bad, value = (found != "STRING") | F.coalesce(get(name, "string") == "", F.lit(True)), get(name, "string")
        elif kind == "boolean":
            bad, value = found != "BOOLEAN", get(name, "boolean").cast("string")
        else:
            number = get(name, "double")
            bad = ~found.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT") | ~F.coalesce((number >= 0) & (number == F.floor(number)), F.lit(False))
            value = get(name, "long").cast("string")
        if field.endswith("?"):
            bad = there(name) & bad
        return value, F.when(bad, F.lit(f"{'missing' if kind == 'text' else 'invalid'}_{name}"))

    def told(fields: tuple[str, ...]) -> tuple[Column, Column]:
        values, errors = [], []
        for field in fields:
            first, *other = field.split("|")
            value, error = one(first)
            for second in other:
                there_too, bad = one(second)
                value, error = F.when(there(first.split(":")[0]), value).otherwise(there_too), F.when(there(first.split(":")[0]), error).otherwise(bad)
            values.append(value)
            errors.append(error)
        return signed_message(values), F.coalesce(*errors)

    version = get("version", "string")
    major = F.when(version.rlike(r"^[0-9]+(\.|$)"), F.substring_index(version, ".", 1).cast("int"))
    start = F.when(parsed.isNull() | (F.coalesce(kind_of("version"), F.lit("")) != "STRING") | F.coalesce(version == "", F.lit(True)), "missing_version")
    error, message = F.lit("unsupported_version"), F.lit(None).cast("string")
    for number, fields in SIGNED.items():
        text, wrong = told(fields)
        error, message = F.when(major == number, wrong).otherwise(error), F.when(major == number, text).otherwise(message)
    error = F.coalesce(start, one("ad-network-id:text")[1], error)
    return F.struct(F.when(error.isNull(), message).alias("message"), error.alias("error"))


def boolean_word(value: Column, true_values: list[str], false_values: list[str], default: bool | None = None) -> Column:
    """Boolean of a declared vocabulary, compared trimmed and lowered; null outside of it without a default."""
    word = F.lower(F.trim(value.cast("string")))
    return F.when(word.isin([v.strip().lower() for v in true_values]), True).when(word.isin([v.strip().lower() for v in false_values]), False).otherwise(F.lit(default).cast("boolean"))
