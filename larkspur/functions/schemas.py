"""Closed JSON schemas as column expressions: what is wrong with a text, with the path and the reason of each fault.

``faults`` compiles a schema (the usual keywords, as Python values) to one column over the parsed text, so a
table of payloads is validated in one pass without Python workers.  Keys are those of the parsed text: escapes in
their spelling hide nothing.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAULT = "array<struct<path:string,reason:string>>"
_KINDS = {"string": ("STRING",), "boolean": ("BOOLEAN",), "null": ("VOID",), "object": ("OBJECT",), "array": ("ARRAY",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "integer": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")}

# Grammars of the contract's common parts.
ID = {"type": "string", "minLength": 1, "maxLength": 256}
WHEN = {"type": "string", "pattern": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z$"}
COUNTRY = {"type": "string", "pattern": "^[A-Z]{2}$"}
OPEN = {"type": "object"}
MONEY = {"amount_unscaled": {"type": "string", "pattern": "^-?(0|[1-9][0-9]*)$"}, "amount_scale": {"type": "integer", "minimum": 0, "maximum": 18}, "currency": {"type": "string", "pattern": "^[A-Z]{3}$"}}
SETTLED = {"enum": ["settled", "pending", "reversed"]}
EVENT_KEY = {"type": "string", "pattern": "^[a-z][a-z0-9_]{0,63}$"}
ATTRIBUTES = {"type": "object", "maxProperties": 20, "propertyNames": {"pattern": "^[a-z][a-z0-9_]{0,63}$"}, "additionalProperties": {"anyOf": [{"type": "string", "maxLength": 256}, {"type": "number"}, {"type": "boolean"}, {"type": "null"}]}}
NO_IMPORT_NAMES = {"type": "object", "propertyNames": {"not": {"pattern": "^(import($|_)|imported($|_)|provider($|_))"}}}


def closed(required: str, optional: dict[str, Any] | None = None, **properties: Any) -> dict[str, Any]:
    """An object with no keys but these: ``required`` names what must be there, extensions are open."""
    return {"type": "object", "required": required.split(), "properties": {**properties, "extensions": OPEN, **(optional or {})}, "additionalProperties": False}


def short(most: int) -> dict[str, Any]:
    return {"type": "string", "minLength": 1, "maxLength": most}


# The events and their fields.
EVENTS: dict[str, dict[str, Any]] = {
    "session_start": closed("installation_id session_id", {"extensions": NO_IMPORT_NAMES}, installation_id=ID, session_id=ID, import_context=OPEN),
    "ad_impression": closed("impression_id ad_unit_id ad_network", impression_id={"type": "string"}, ad_unit_id={"type": "string"}, ad_network={"type": "string"}),
    "ad_view": closed("view_id campaign_id network viewed_at", view_id=ID, campaign_id=ID, ad_group_id=ID, creative_id=ID, network=short(128), country=COUNTRY, site_id=short(256), remote_click_ref=short(256), viewed_at=WHEN),
    "purchase": closed("transaction_id amount_unscaled amount_scale currency financial_status", transaction_id=ID, original_transaction_id=ID, financial_status=SETTLED, **MONEY),
    "refund": closed("transaction_id original_transaction_id correction_target_record_id amount_unscaled amount_scale currency financial_status", transaction_id=ID, original_transaction_id=ID, correction_target_record_id=ID, financial_status=SETTLED, **MONEY),
    "consent_changed": closed("consent_state effective_at consent_policy_version", consent_state={"enum": ["granted", "denied", "withdrawn", "not_required", "unknown"]}, effective_at=WHEN, consent_policy_version={"type": "string"}),
    "custom_event": {"type": "object", "required": ["installation_id", "event_key"], "additionalProperties": False, "properties": {"installation_id": ID, "event_key": EVENT_KEY, "money": {"type": "object", "required": list(MONEY), "properties": MONEY, "additionalProperties": False}, "attributes": ATTRIBUTES}},
    "click": closed("click_id", click_id=ID, tracking_link_id=ID, redirector_click_at=WHEN, redirector_time_status={"enum": ["available", "missing", "invalid"]}, bot_prefetch={"type": "boolean"}, replay_suspected={"type": "boolean"}, campaign_id=ID, network=short(128), country=COUNTRY, site_id=short(256), remote_click_ref=short(256), import_context=OPEN),
    "install": closed("installation_id install_type", installation_id=ID, install_type={"enum": ["install", "reinstall", "redownload"]}, prior_installation_id=ID, click_id=ID, referrer_status={"type": "string"}, install_begin_at_server=WHEN, campaign_id=ID, network=short(128), country=COUNTRY, import_context=OPEN),
    "ad_revenue": closed("installation_id revenue_source money", installation_id=ID, anchor_source={"type": "string"}, impression_id=ID, ad_unit_id={"type": "string"}, ad_network={"type": "string"}, revenue_source={"type": "string"}, country=COUNTRY, money={"type": "object", "required": list(MONEY), "properties": MONEY, "additionalProperties": False}),
    "skan_postback": closed("transaction_id signature_verified did_win", transaction_id=ID, signature_verified={"type": "boolean"}, did_win={"type": "boolean"}, source_identifier={"type": "string"}, conversion_value={"type": "integer", "minimum": 0, "maximum": 63}, coarse_conversion_value={"enum": ["low", "medium", "high"]}),
    "adattributionkit_postback": closed("transaction_id signature_verified did_win", transaction_id=ID, signature_verified={"type": "boolean"}, did_win={"type": "boolean"}, source_identifier={"type": "string"}, conversion_value={"type": "integer", "minimum": 0, "maximum": 63}, coarse_conversion_value={"enum": ["low", "medium", "high"]}),
    "deep_link_open": closed("installation_id open_source", installation_id=ID, open_source={"type": "string"}, click_id=ID, link_slug=short(128)),
}


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _keys(value: Column) -> Column:
    return F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>"))


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _each(path: Column, checks: list[tuple[Column, str]]) -> list[Column]:
    """A fault for each check that is true."""
    none = F.lit(None).cast("struct<path:string,reason:string>")
    return [F.filter(F.array(*[F.when(bad, F.struct(path.alias("path"), F.lit(reason).alias("reason"))).otherwise(none) for bad, reason in checks]), lambda f: f.isNotNull())] if checks else []


def _joined(parts: list[Column]) -> Column:
    return reduce(lambda a, b: F.concat(a, b), parts) if parts else F.array().cast(FAULT)


def compiled(schema: dict[str, Any] | bool, value: Column, path: Column) -> Column:
    """The faults of a parsed value (a variant that is there) as ``FAULT``."""
    if schema is True or schema == {}:
        return F.array().cast(FAULT)
    if schema is False:
        return _joined(_each(path, [(F.lit(True), "not_allowed")]))
    return _bound(value, lambda v: _bound(_kind(v), lambda kind: _checked(schema, v, kind, path)))


def _checked(schema: dict[str, Any], v: Column, kind: Column, path: Column) -> Column:
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    is_text, is_number = kind == "STRING", kind.isin(*_KINDS["number"])
    own: list[tuple[Column, str]] = []
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        fits = reduce(Column.__or__, [kind.isin(*_KINDS[n]) & ((number == F.floor(number)) if n == "integer" else F.lit(True)) for n in names])
        own.append((~F.coalesce(fits, F.lit(False)), "type"))
    if "const" in schema or "enum" in schema:
        allowed = schema.get("enum", [schema.get("const")])
        own.append((~F.to_json(v).isin(*[json.dumps(a, ensure_ascii=False) for a in allowed]), "enum" if "enum" in schema else "const"))
    for word, test in (("pattern", lambda x: ~text.rlike(x)), ("minLength", lambda x: F.char_length(text) < x), ("maxLength", lambda x: F.char_length(text) > x)):
        if word in schema:
            own.append((is_text & test(schema[word]), word))
    for word, test in (("minimum", lambda x: number < x), ("maximum", lambda x: number > x)):
        if word in schema:
            own.append((is_number & test(schema[word]), word))
    if "not" in schema:
        own.append((F.size(compiled(schema["not"], v, path)) == 0, "not"))
    out = _each(path, own)
    if _OBJECT & schema.keys():
        out.append(F.when(kind == "OBJECT", _bound(_keys(v), lambda keys: _object(schema, v, keys, path))).otherwise(F.array().cast(FAULT)))
    if "items" in schema:
        items = F.try_variant_get(v, "$", "array<variant>")
        found = F.flatten(F.transform(items, lambda x, i: compiled(schema["items"], x, _child(path, i.cast("string")))))
        out.append(F.when(kind == "ARRAY", F.coalesce(found, F.array().cast(FAULT))).otherwise(F.array().cast(FAULT)))
    for sub in schema.get("allOf", []):
        out.append(compiled(sub, v, path))
    for word in ("anyOf", "oneOf"):
        if word in schema:
            out.append(_bound(F.array(*[compiled(sub, v, path) for sub in schema[word]]), _chosen(word, path)))
    return _joined(out)


def _child(path: Column, name: Column) -> Column:
    return F.concat(F.when(path == "/", "").otherwise(path), F.lit("/"), name)


_OBJECT = {"required", "properties", "additionalProperties", "propertyNames", "maxProperties"}


def _object(schema: dict[str, Any], v: Column, keys: Column, path: Column) -> Column:
    """The faults of an object by its keys."""
    own: list[tuple[Column, str]] = []
    properties: dict[str, Any] = schema.get("properties", {})
    rest = F.array_except(keys, F.array(*[F.lit(p) for p in properties]).cast("array<string>"))
    extra = schema.get("additionalProperties", True)
    if "maxProperties" in schema:
        own.append((F.size(keys) > schema["maxProperties"], "maxProperties"))
    if extra is False:
        own.append((F.size(rest) > 0, "additionalProperties"))
    if "propertyNames" in schema:
        names = schema["propertyNames"]
        bad = (lambda k: k.rlike(names["not"]["pattern"])) if "not" in names else (lambda k: ~k.rlike(names["pattern"]))
        own.append((F.exists(keys, bad), "propertyNames"))
    out = _each(path, own)
    if schema.get("required"):
        missing = F.array_except(F.array(*[F.lit(r) for r in schema["required"]]), keys)
        out.append(F.transform(missing, lambda name: F.struct(_child(path, name).alias("path"), F.lit("required").alias("reason"))))
    for name, sub in properties.items():
        if sub not in ({}, True, OPEN):
            out.append(F.when(F.array_contains(keys, name), compiled(sub, F.try_variant_get(v, f"$['{name}']", "variant"), _child(path, F.lit(name)))).otherwise(F.array().cast(FAULT)))
        elif sub == OPEN:
            wrong = F.array_contains(keys, name) & (_kind(F.try_variant_get(v, f"$['{name}']", "variant")) != "OBJECT")
            out += _each(_child(path, F.lit(name)), [(wrong, "type")])
    if isinstance(extra, dict) and extra:
        entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        found = F.flatten(F.transform(F.filter(entries, lambda e: F.array_contains(rest, e["key"])), lambda e: compiled(extra, e["value"], _child(path, e["key"]))))
        out.append(F.coalesce(found, F.array().cast(FAULT)))
    return _joined(out)


def _chosen(word: str, path: Column):
    """The faults of a choice, from those of its branches: one must fit, of ``oneOf`` only one."""

    def judged(branches: Column) -> Column:
        fitting = F.size(F.filter(branches, lambda f: F.size(f) == 0))
        misfit = fitting == 0 if word == "anyOf" else fitting != 1
        return F.when(misfit, F.concat(F.flatten(branches), F.array(F.struct(path.alias("path"), F.lit(word).alias("reason"))))).otherwise(F.array().cast(FAULT))

    return judged


def faults(payload: Column, schema: dict[str, Any]) -> Column:
    """The faults of a JSON text, sorted and distinct (``FAULT``); what is no JSON object has the one fault ``not_an_object`` at the root."""
    none = F.array(F.struct(F.lit("/").alias("path"), F.lit("not_an_object").alias("reason")))
    found = _bound(F.try_parse_json(payload), lambda v: F.when(F.coalesce(_kind(v) != "OBJECT", F.lit(True)), none).otherwise(compiled(schema, v, F.lit("/"))))
    return F.array_sort(F.array_distinct(found))


def validated(events: DataFrame, event_name: str = "event_name", payload: str = "payload", schemas: dict[str, dict[str, Any]] | None = None) -> DataFrame:
    """events with ``faults`` and their paths as ``invalid_fields`` (empty: valid); unknown events fault at /event_name.

    Input values are never in what is told.
    """
    out = F.array(F.struct(F.lit("/event_name").alias("path"), F.lit("unknown_event").alias("reason")))
    for name, schema in (EVENTS if schemas is None else schemas).items():
        out = F.when(F.col(event_name) == name, faults(F.col(payload), schema)).otherwise(out)
    return events.withColumn("faults", out).withColumn("invalid_fields", F.array_sort(F.array_distinct(F.transform("faults", lambda f: f["path"]))))


def schema_rejections(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attempts with sound payloads, rejections of the others with their invalid fields): what is looked at before decisions."""
    from larkspur.operators.ingest import with_consent

    checked = validated(attempts)
    bad = with_consent(checked.where(F.size("faults") > 0))
    told = bad.select("delivery_id", "record_id", "tenant_id", "app_id", F.lit("payload_schema_invalid").alias("reason_code"), "consent_reason", "consent_policy_version", "invalid_fields")
    return checked.where(F.size("faults") == 0).drop("faults", "invalid_fields"), told
