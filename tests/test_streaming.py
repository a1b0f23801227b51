import json
import os

from larkspur.streaming import ingestion as s

SCHEMA = "tenant_id string, app_id string, producer string, event_id string, record_id string, delivery_id string, payload_sha256 string, received_at string"


def rows(name, n, digest):
    return {"tenant_id": "t", "app_id": "a", "producer": "p", "event_id": name, "record_id": f"r{n}", "delivery_id": f"d{n}", "payload_sha256": digest, "received_at": f"2026-01-01T00:00:0{n}.000Z"}


def test_conflicts_are_told_across_batches(spark, tmp_path):
    land, out = tmp_path / "in", tmp_path / "out"
    land.mkdir()

    def drain():
        q = s.append_idempotent(s.resolved(s.landing(spark, str(land), SCHEMA)), str(out), ["delivery_id"], str(tmp_path / "ck"))
        q.awaitTermination()

    (land / "1.json").write_text("\n".join(json.dumps(r) for r in [rows("e1", 1, "x"), rows("e1", 2, "x"), rows("e2", 3, "y")]))
    drain()
    (land / "2.json").write_text("\n".join(json.dumps(r) for r in [rows("e1", 4, "z"), rows("e2", 5, "y")]))
    drain()
    got = {r["delivery_id"]: r["duplicate_resolution"] for r in spark.read.parquet(str(out)).collect()}
    assert got == {"d1": "unique", "d2": "duplicate_delivery", "d3": "unique", "d4": "event_id_conflict", "d5": "duplicate_delivery"}


def run(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck-{name}")).outputMode("append").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    return df.sparkSession.table(name)


def landed(tmp_path, *batches):
    land = tmp_path / "in"
    land.mkdir()
    for i, batch in enumerate(batches):
        (land / f"{i}.json").write_text("\n".join(json.dumps(r) for r in batch))
        os.utime(land / f"{i}.json", (1_700_000_000 + i,) * 2)  # files are read in order of their time
    return str(land)


def test_token_bucket(spark, tmp_path):
    land = landed(tmp_path, [{"key_id": "k", "request_id": str(i), "at_ms": 10**12 + at} for i, at in enumerate([0, 0, 0, 1000])], [{"key_id": "k", "request_id": "4", "at_ms": 10**12 + 1100}, {"key_id": "other", "request_id": "5", "at_ms": 10**12 + 10**7}], [{"key_id": "k", "request_id": "6", "at_ms": 10**12 + 10**7}])
    df = s.token_buckets(s.landing(spark, land, "key_id string, request_id string, at_ms long", 1), 1.0, 2.0)
    assert [r["allowed"] for r in run(df, "buckets", tmp_path).orderBy("request_id").collect()] == [True, True, False, True, False, True, True]


def test_quarantine_ends_with_event_time(spark, tmp_path):
    land = landed(tmp_path, [{"decision_id": "a", "decided_ms": 10**12, "until_ms": 10**12 + 60_000}, {"decision_id": "b", "decided_ms": 10**12, "until_ms": 2 * 10**12}], [{"decision_id": "c", "decided_ms": 10**12 + 10**6, "until_ms": 2 * 10**12}], [{"decision_id": "d", "decided_ms": 10**12 + 10**6, "until_ms": 2 * 10**12}])
    df = s.quarantines(s.landing(spark, land, "decision_id string, decided_ms long, until_ms long", 1))
    got = {(r["decision_id"], r["status"]) for r in run(df, "quarantines", tmp_path).collect()}
    assert got == {("a", "quarantined"), ("a", "released"), ("b", "quarantined"), ("c", "quarantined"), ("d", "quarantined")}


def test_quarantines_renewed_late_and_empty_ones_without_python(spark, tmp_path):
    """a renewed quarantine ends with its last deadline; a release waits until event time is past the deadline, to the millisecond."""
    row = lambda key, at, until: {"decision_id": key, "decided_ms": 10**12 + at, "until_ms": until and 10**12 + until}
    land = landed(tmp_path, [row("a", 0, 500_000), row("b", 0, -1), row("c", 0, 940_000), row("d", 0, 939_999), row("e", 0, None)], [row("a", 400_000, 700_000)], [row("z", 1_000_000, 2_000_000)], [row("f", 100_000, 3_000_000)])
    df = s.quarantines(s.landing(spark, land, "decision_id string, decided_ms long, until_ms long", 1))
    assert "FlatMapGroups" not in df._jdf.queryExecution().toString()
    got = sorted((r["decision_id"], r["until_ms"] and r["until_ms"] - 10**12, r["status"]) for r in run(df, "renewed", tmp_path).collect() if r["decision_id"] != "e")
    told = [("a", 500_000), ("a", 700_000), ("f", 3_000_000), ("b", -1), ("c", 940_000), ("d", 939_999), ("z", 2_000_000)]
    assert got == sorted([*[(*x, "quarantined") for x in told], ("a", 700_000, "released"), ("b", -1, "released"), ("d", 939_999, "released")])


def test_withdrawals_hold_for_later_records(spark, tmp_path):
    row = lambda n, event="session_start", state=None, key="k": {"tenant_id": "t", "installation_key_id": key, "record_id": f"{key}{n}", "event_name": event, "consent_state": state, "processing_sequence": n}
    land = landed(tmp_path, [row(1), row(2, "consent_changed", "withdrawn"), row(3)], [row(4), row(4, key="other"), row(5, "consent_changed", "granted")])
    df = s.withdrawals(s.landing(spark, land, "tenant_id string, installation_key_id string, record_id string, event_name string, consent_state string, processing_sequence long", 1))
    got = {r["record_id"]: r["withdrawn_at_sequence"] for r in run(df, "withdrawals", tmp_path).collect()}
    assert got == {"k1": None, "k2": 2, "k3": 2, "k4": 2, "k5": 2, "other4": None}


def test_inbox_of_query_strings(spark, tmp_path):
    land = landed(tmp_path, [{"inbox_id": "1", "query": "user_id=u&revenue=1.5&ts=1700000000&network=n"}, {"inbox_id": "2", "query": "revenue=x&ts=1"}])
    got = {r["inbox_id"]: (r["status"], r["error"]) for r in run(s.drained_postbacks(s.landing(spark, land, "inbox_id string, query string")), "inbox", tmp_path).collect()}
    assert got == {"1": ("processed", None), "2": ("rejected", "revenue_invalid")}


def test_events_since_install(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    a = landed(tmp_path / "a", [{"installation_id": "i", "installed_at": "2026-01-01T12:00:00Z"}])
    b = landed(tmp_path / "b", [{"installation_id": "i", "occurred_at": t} for t in ("2026-01-01T11:59:59Z", "2026-01-01T12:00:00Z", "2026-01-02T11:59:59Z", "2026-01-02T12:00:00Z")])
    df = s.since_install(s.landing(spark, a, "installation_id string, installed_at timestamp"), s.landing(spark, b, "installation_id string, occurred_at timestamp"), 1)
    assert sorted(str(r["occurred_at"]) for r in run(df, "since", tmp_path).collect()) == ["2026-01-01 12:00:00", "2026-01-02 11:59:59"]


def test_nonces_and_quotas(spark, tmp_path):
    land = landed(tmp_path, [{"ts": "2026-01-01T00:00:00Z", "key_id": "k", "nonce": n} for n in "aab"], [{"ts": "2026-01-01T00:05:00Z", "key_id": "k", "nonce": "a"}], [{"ts": "2026-01-01T09:00:00Z", "key_id": "k", "nonce": "c"}], [{"ts": "2026-01-01T09:00:01Z", "key_id": "k", "nonce": "d"}])
    read = lambda: s.landing(spark, land, "ts timestamp, key_id string, nonce string", 1)
    assert sorted(r["nonce"] for r in run(s.fresh_nonces(read()), "nonces", tmp_path).collect()) == ["a", "b", "c", "d"]
    got = {str(r["hour"]): (r["n"], r["over"]) for r in run(s.hourly_quota(read(), 3), "quota", tmp_path).collect()}
    assert got["2026-01-01 00:00:00"] == (4, True)


def test_replayed_batch_adds_nothing(spark, tmp_path):
    land = landed(tmp_path, [rows("e1", 1, "x"), rows("e1", 1, "x")])
    for _ in range(2):
        s.append_idempotent(s.landing(spark, land, SCHEMA), str(tmp_path / "out"), ["delivery_id"], str(tmp_path / "same")).awaitTermination(60)
    first = spark.read.parquet(str(tmp_path / "out")).count()
    s.append_idempotent(s.landing(spark, land, SCHEMA), str(tmp_path / "out"), ["delivery_id"], str(tmp_path / "lost")).awaitTermination(60)
    assert first == spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_a_lost_checkpoint_replaces_nothing(spark, tmp_path):
    land, out = tmp_path / "in", tmp_path / "out"
    land.mkdir()
    for i, ck in enumerate(("ck1", "ck2")):
        (land / f"{i}.json").write_text(json.dumps(rows(f"e{i}", i, "x")))
        s.append_idempotent(s.landing(spark, str(land), SCHEMA), str(out), ["delivery_id"], str(tmp_path / ck)).awaitTermination()
    assert sorted(r["delivery_id"] for r in spark.read.parquet(str(out)).collect()) == ["d0", "d0", "d1"]


def test_a_delivery_sent_twice_is_unique_once(spark, tmp_path):
    same = rows("e1", 1, "x")
    got = run(s.resolved(s.landing(spark, landed(tmp_path, [same, same]), SCHEMA)), "twice", tmp_path)
    assert sorted(r["duplicate_resolution"] for r in got.collect()) == ["duplicate_delivery", "unique"]


def test_daily_windows(spark, tmp_path):
    land = tmp_path / "in"
    land.mkdir()
    (land / "1.json").write_text("\n".join(json.dumps({"ts": t, "event_name": "click"}) for t in ["2026-01-01T14:59:59Z", "2026-01-01T15:00:00Z", "2026-01-09T00:00:00Z"]))
    (land / "2.json").write_text(json.dumps({"ts": "2026-01-20T00:00:00Z", "event_name": "click"}))
    df = s.daily_counts(s.landing(spark, str(land), "ts timestamp, event_name string", 1), "Asia/Tokyo")
    q = df.writeStream.format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {str(r["metric_date"]): r["value"] for r in spark.table("days").collect()}
    assert got["2026-01-01"] == 1 and got["2026-01-02"] == 1
