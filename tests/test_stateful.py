"""Stateful stream operators, over micro-batches in several orders."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import ingest
from larkspur.streaming import stateful


def landed(tmp_path, *batches):
    land = tmp_path / "in"
    land.mkdir(exist_ok=True)
    have = len(list(land.iterdir()))
    for i, batch in enumerate(batches):
        (land / f"{have + i:04}.json").write_text("\n".join(json.dumps(r) for r in batch))
        os.utime(land / f"{have + i:04}.json", (1_700_000_000 + have + i,) * 2)  # files are taken in order of their times
    return str(land)


def drained(spark, tmp_path, schema, operator, name, *batches, conf=None):
    """What an operator tells of batches that come one by one, until the stream is at rest."""
    land = landed(tmp_path, *batches)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(land)
    q = operator(rows).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(240)
        assert q.exception() is None
    finally:
        q.stop()
    return [r.asDict() for r in spark.table(name).collect()]


def attempt(n, record=None, event=None, received=None, v=1, delivery=None, **more):
    row = {"tenant_id": "t", "app_id": "a", "policy_digest": "d", "record_id": f"r{n}" if record is None else record, "delivery_id": delivery or f"d{n}", "record_tenant_id": "t", "record_app_id": "a", "producer": "sdk", "event_id": event or f"e{n}", "event_name": "view", "schema_version": "1"}
    row |= {"occurred_at": "2026-01-02T00:00:00.000Z", "received_at": received or f"2026-01-03T00:00:{n:02}.000Z", "late": False, "subject_scope": "installation_level", "processing_purpose_id": "p", "processing_sequence": n, "payload": json.dumps({"v": v}), "stale_before": "2026-01-01T00:00:00.000Z"}
    return row | {"purposes": [{"processing_purpose_id": "p", "consent_required": n % 5 == 0, "policy_version": "v1"}], "withdrawals": [{"processing_purpose_id": "p", "withdrawal_recognized_sequence": 12}], "bases": []} | more


ROWS = [
    *[attempt(n) for n in range(1, 6)],
    attempt(6, event="e1"), attempt(7, event="e1", v=2), attempt(8, event="e9", received="2026-01-03T00:00:59.000Z"), attempt(9, v=3),  # e9: the first in time may come last
    attempt(10, record="same"), attempt(11, record="same", event="e2"), attempt(15), attempt(20, event="e15"),
    attempt(21, occurred_at="2026-02-30T00:00:00.000Z"), attempt(22, record="same", event="e1", v=5), attempt(23, record_tenant_id="other"),
    attempt(24, occurred_at="2025-12-01T00:00:00.000Z"), attempt(25, subject_scope="aggregate", payload='{"installation_id":"i"}'), attempt(26, v=1), attempt(27, event="e26", payload='{ "v" : 1 }'),
    {k: v for k, v in attempt(28).items() if k != "event_id"}, {k: v for k, v in attempt(29).items() if k != "event_id"}, {k: v for k, v in attempt(30).items() if k != "record_id"}, {k: v for k, v in attempt(31).items() if k != "record_id"},
]
TOLD = ["record_id", "canonical_record_id", "ingestion_status", "duplicate_resolution", "timeliness", "clock_skew_suspected", "payload_disposition", "consent_reason", "consent_policy_version", "reason_code"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stream_ends_in_the_decisions_of_the_table(spark, tmp_path, seed):
    """Collisions, conflicts, consent and reasons, whatever the order and the batches."""
    want = {r["delivery_id"]: tuple(r[c] for c in TOLD) for r in ingest.decide(spark.createDataFrame(ROWS, ingest.SCHEMA)).collect()}
    rows = random.Random(seed).sample(ROWS, len(ROWS))
    told = drained(spark, tmp_path, ingest.SCHEMA, stateful.decisions, f"decided{seed}", *[rows[i : i + 6] for i in range(0, len(rows), 6)])
    last = {}
    for r in sorted(told, key=lambda r: r["version"]):
        last[r["delivery_id"]] = tuple(r[c] for c in TOLD)
    assert last == want
    assert {w[3] for w in want.values()} == {"unique", "duplicate_delivery", "event_id_conflict", "record_id_collision"}


def test_a_delivery_that_comes_again_is_unique_once(spark, tmp_path):
    a, b = attempt(1), attempt(2, event="e1", v=2)
    told = drained(spark, tmp_path, ingest.SCHEMA, stateful.decisions, "again", [a, a], [a, b], [b, a])
    got = sorted((r["delivery_id"], r["receipt"], r["duplicate_resolution"]) for r in told)
    assert got == [("d1", 1, "unique"), *[("d1", i, "duplicate_delivery") for i in (2, 3, 4)], ("d2", 1, "event_id_conflict"), ("d2", 2, "duplicate_delivery")]


def test_a_table_needs_no_state_and_ends_like_its_stream(spark, tmp_path):
    """repeats, copies of a repeated record id and rows without a key, by windows and by the processors."""
    rows = [*ROWS, *ROWS[:8], *ROWS[9:20], ROWS[0], ROWS[21], ROWS[22], ROWS[13] | {"tenant_id": "u"}]
    table = stateful.decisions(spark.createDataFrame(rows, ingest.SCHEMA))
    assert "TransformWithState" not in table._jdf.queryExecution().toString()
    told = drained(spark, tmp_path, ingest.SCHEMA, stateful.decisions, "likewise", rows[:20], rows[20:])
    last = {(r["delivery_id"], r["receipt"]): tuple(r[c] for c in TOLD) for r in sorted(told, key=lambda r: r["version"])}
    assert {(r["delivery_id"], r["receipt"]): tuple(r[c] for c in TOLD) for r in stateful.standing(table).collect()} == last
    assert table.count() == len(rows)


def test_standing_decisions_of_a_table(spark):
    table = spark.createDataFrame([*ROWS, ROWS[0]], ingest.SCHEMA)
    got = {(r["delivery_id"], r["receipt"]): r["duplicate_resolution"] for r in stateful.standing(stateful.decisions(table)).collect()}
    want = {(r["delivery_id"], 1): r["duplicate_resolution"] for r in ingest.decide(spark.createDataFrame(ROWS, ingest.SCHEMA)).collect()}
    assert got == want | {("d1", 2): "duplicate_delivery"}


def test_rows_without_a_key_are_dealt_apart(spark):
    rows = [{k: v for k, v in attempt(n).items() if k not in ("event_id", "producer")} for n in range(20, 50)]
    decided = ingest.decide(spark.createDataFrame(rows, ingest.SCHEMA))
    assert {r["duplicate_resolution"] for r in decided.collect()} == {"unique"}


REQUESTS = "key_id string, request_id string, at_ms long"


class Limiter:
    """A plain limiter with a bound on keys."""

    def __init__(self, rate, burst, most, idle):
        self.rate, self.burst, self.most, self.idle, self.entries = rate, burst, most, idle, {}

    def allow(self, key, now):
        self.entries = {k: e for k, e in self.entries.items() if now - e[1] < self.idle}
        if key not in self.entries and len(self.entries) >= self.most:
            del self.entries[min(self.entries, key=lambda k: (self.entries[k][1], k))]
        tokens, seen = self.entries.get(key, (self.burst, now))
        tokens = min(self.burst, tokens + (now - seen) / 1000 * self.rate)
        self.entries[key] = (tokens - (tokens >= 1), now)
        return tokens >= 1


def test_more_keys_than_the_bound(spark, tmp_path):
    rng, at = random.Random(4), 1_767_225_600_000
    rows = []
    for i in range(400):
        at += rng.choice([1, 5, 40, 300, 2500])
        rows.append({"key_id": f"k{int(rng.paretovariate(0.6)) % 23}", "request_id": f"{i:04}", "at_ms": at})
    limiter = Limiter(0.5, 2, 6, 9000)
    want = {r["request_id"]: limiter.allow(r["key_id"], r["at_ms"]) for r in rows}
    got = drained(spark, tmp_path, REQUESTS, lambda s: stateful.bounded_buckets(s, 0.5, 2, 6, 9000), "bounded", *[rows[i : i + 80] for i in range(0, 400, 80)])
    assert {r["request_id"]: r["allowed"] for r in got} == want
    assert 40 < sum(want.values()) < 360
    with pytest.raises(ValueError):
        stateful.Buckets(1, 1, 0, 5)


LOOKUPS = "tenant_id string, app_id string, lookup_id string, kind string, at_ms long, install_record_id string, token_created_ms long, http_status int, body string"
T0 = 1_767_225_600_000
GOOD = json.dumps({"attribution": True, "orgId": "1", "campaignId": "2", "adGroupId": "3", "conversionType": "Download", "claimType": "Click", "countryOrRegion": "JP"})


def looked(i, kind, at, status=None, body=None, created=T0):
    row = {"tenant_id": "t", "app_id": "a", "lookup_id": f"l{i}", "kind": kind, "at_ms": T0 + at}
    return row | ({"install_record_id": f"install:{i}", "token_created_ms": created} if kind == "queued" else {"http_status": status, "body": body})


def test_lookups_are_asked_again_and_expire(spark, tmp_path):
    """Three misses, doubled waits after errors, refused ones, a token of 23 hours, and answers of all kinds."""
    hour = 3_600_000
    tick = lambda i, at: ([looked(i, "queued", at, created=T0 + at)], [looked(i + 1, "queued", at + 1, created=T0 + at)])  # noqa: E731  moves event time, then its timers run
    batches = [
        [looked(i, "queued", i) for i in range(1, 10)],
        [looked(1, "answer", 1000, 200, GOOD), looked(2, "answer", 1000, 200, '{"attribution":false}'), looked(3, "answer", 1000, 404), looked(4, "answer", 1000, 500), looked(5, "answer", 1000, 400), looked(6, "limited", 1000), looked(7, "answer", 1000, 200, "{}"), looked(8, "token_missing", 1000), looked(99, "answer", 1000, 200, GOOD)],
        *tick(60, 130_000),
        [looked(3, "answer", 140_000, 404), looked(4, "answer", 200_000, 429), looked(1, "answer", 201_000, 404), looked(1, "queued", 202_000)],
        *tick(70, 300_000),
        [looked(3, "answer", 400_000, 404), looked(4, "answer", 500_000, 503)],
        [looked(4, "answer", 1_000_000, None)],
        *tick(80, 24 * hour),
    ]
    told = drained(spark, tmp_path, LOOKUPS, stateful.lookup_queue, "lookups", *batches)
    steps = {}
    for r in sorted(told, key=lambda r: (r["lookup_id"], r["at_ms"])):
        steps.setdefault(r["lookup_id"], []).append((r["step"], r["status"], r["attempts"], r["at_ms"] - T0, None if r["next_attempt_ms"] is None else r["next_attempt_ms"] - r["at_ms"], r["reason"]))
    due = lambda at, n: ("due", None, n, at, None, None)
    assert steps["l1"] == [due(1, 0), ("completed", "attributed", 0, 1000, None, None)]
    assert steps["l2"] == [due(2, 0), ("completed", "not_attributed", 0, 1000, None, None)]
    assert steps["l3"] == [due(3, 0), ("retry", None, 1, 1000, 5000, "not_found"), due(6000, 1), ("retry", None, 2, 140_000, 5000, "not_found"), due(145_000, 2), ("completed", "lookup_unavailable", 2, 400_000, None, None)]
    assert steps["l4"][:2] == [due(4, 0), ("retry", None, 1, 1000, 120_000, "http_500")]
    assert [x for x in steps["l4"] if x[0] != "due"][1:] == [("retry", None, 2, 200_000, 240_000, "http_429"), ("retry", None, 3, 500_000, 480_000, "http_503"), ("retry", None, 3, 1_000_000, 480_000, "http_500"), ("completed", "token_expired", 3, 23 * hour, None, None)]
    assert steps["l5"] == [due(5, 0), ("completed", "lookup_unavailable", 0, 1000, None, None)]
    assert steps["l6"][:3] == [due(6, 0), ("retry", None, 0, 1000, 1000, "rate_limited"), due(2000, 0)] and steps["l6"][-1][:2] == ("completed", "token_expired")
    assert steps["l7"][1][-1] == "answer_invalid" and steps["l8"] == [due(8, 0), ("completed", "dropped", 0, 1000, None, None)]
    assert steps["l9"] == [due(9, 0), ("completed", "token_expired", 0, 23 * hour, None, None)] and "l99" not in steps


CHECKS = "tenant_id string, app_id string, verification_id string, kind string, at_ms long, provider string, subject_record_id string, binding string, http_status int, body string"


def test_verifications_get_one_verdict(spark, tmp_path):
    play = lambda b: json.dumps({"requestDetails": {"requestHash": b}, "appIntegrity": {"appRecognitionVerdict": "PLAY_RECOGNIZED"}, "deviceIntegrity": {"deviceRecognitionVerdict": ["MEETS_DEVICE_INTEGRITY"]}})
    attest = lambda b, ok=True: json.dumps({"binding_digest": b, "app_id_valid": True, "signature_valid": ok, "counter_valid": True})
    row = lambda i, kind, at, provider="play_integrity", **more: {"tenant_id": "t", "app_id": "a", "verification_id": f"v{i}", "kind": kind, "at_ms": T0 + at, "provider": provider} | more
    queued = lambda i, at=0, provider="play_integrity": row(i, "queued", at, provider, subject_record_id=f"s{i}", binding=f"b{i}")
    answer = lambda i, at, status, body, provider="play_integrity": row(i, "answer", at, provider, http_status=status, body=body)
    batches = [
        [queued(1), queued(2), queued(3, provider="app_attest"), queued(4, provider="app_attest"), queued(5), queued(6), answer(7, 10, 200, play("b7"))],
        [answer(1, 1000, 200, play("b1")), answer(2, 1000, 200, play("other")), answer(3, 1000, 200, attest("b3"), "app_attest"), answer(4, 1000, 200, attest("b4", False), "app_attest"), answer(5, 1000, 503, ""), queued(7, 2000)],
        [answer(1, 3000, 503, ""), queued(8, 900_000)],
        [queued(9, 901_000)],
    ]
    told = drained(spark, tmp_path, CHECKS, stateful.integrity_queue, "verdicts", *batches)
    got = {r["verification_id"]: (r["verdict"], r["retain_evidence"], r["at_ms"] - T0) for r in told}
    assert got == {"v1": ("verified", True, 1000), "v2": ("failed", True, 1000), "v3": ("verified", True, 1000), "v4": ("failed", True, 1000), "v5": ("unavailable", False, 1000), "v6": ("unavailable", False, 300_000), "v7": ("verified", True, 2000)}
    assert len(told) == len(got)
