"""Canonical JSON and digests of flat records, and sort keys of UTF-16 order."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON object with keys in order; null fields are left out.  For strings, integers and booleans."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields, key=lambda k: k.encode("utf-16-be"))]))


def canonical_text(json_text: Column) -> Column:
    """A JSON text with sorted keys and without white space; a text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(json_text)), json_text)


def digest(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def digest_array(values: list[Column]) -> Column:
    """Digest of a JSON array of strings."""
    return F.sha2(F.to_json(F.array(*[v.cast("string") for v in values])), 256)


def identifier(prefix: str, fields: dict[str, Column], length: int = 48) -> Column:
    """Deterministic id: prefix and the head of a digest."""
    return F.concat(F.lit(prefix), F.substring(digest(fields), 1, length))


def uuid_v7(ms: Column, entropy: Column | None = None) -> Column:
    """UUID of version 7: 48 bits of time, then 74 bits of a digest of entropy (without one: random, for attempts)."""
    r = F.sha2(F.expr("uuid()") if entropy is None else entropy, 256)
    time, variant = F.lpad(F.lower(F.hex(ms)), 12, "0"), F.translate(F.substring(r, 4, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(time, 1, 8), F.substring(time, 9, 4), F.concat(F.lit("7"), F.substring(r, 1, 3)), F.concat(variant, F.substring(r, 5, 3)), F.substring(r, 8, 12))


def utf16_key(text: Column) -> Column:
    """Sort key that orders text by UTF-16 code units, where astral letters come before U+E000."""
    return F.encode(text, "UTF-16BE")


def config_digest(value: Any) -> str:
    """Digest of a configuration on the driver: sorted keys, no white space."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
