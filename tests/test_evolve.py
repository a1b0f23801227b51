"""Schemas, deletions, recalculation and publication over crafted rows."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from larkspur.functions import schemas
from larkspur.operators import deletion, ingest, publication, recalculate
from larkspur.operators.metrics import Definition
from larkspur.queries import QUERIES

MONEY = {"amount_unscaled": "-120", "amount_scale": 2, "currency": "USD"}
SOUND = {
    "session_start": {"installation_id": "i", "session_id": "s", "extensions": {"important": 1}},
    "ad_impression": {"impression_id": "", "ad_unit_id": "u", "ad_network": "n"},
    "ad_view": {"view_id": "v", "campaign_id": "c", "network": "n", "viewed_at": "2026-01-01T00:00:00.000Z", "country": "JP"},
    "purchase": {"transaction_id": "t", "financial_status": "settled", **MONEY},
    "refund": {"transaction_id": "t", "original_transaction_id": "o", "correction_target_record_id": "r", "financial_status": "reversed", **MONEY},
    "consent_changed": {"consent_state": "denied", "effective_at": "2026-01-01T00:00:00.000Z", "consent_policy_version": "1"},
    "custom_event": {"installation_id": "i", "event_key": "k_1", "attributes": {"a": "x", "b": 1.5, "c": None, "d": True}, "money": MONEY},
    "click": {"click_id": "c", "bot_prefetch": False},
    "install": {"installation_id": "i", "install_type": "install"},
    "ad_revenue": {"installation_id": "i", "revenue_source": "s", "money": MONEY},
    "skan_postback": {"transaction_id": "t", "signature_verified": True, "did_win": False, "conversion_value": 63},
    "adattributionkit_postback": {"transaction_id": "t", "signature_verified": True, "did_win": False, "coarse_conversion_value": "low"},
    "deep_link_open": {"installation_id": "i", "open_source": "x", "link_slug": "s"},
}


def test_payloads_of_all_events(spark):
    """Every event's sound payload, and each of its fields missing, of another type, and a key too many, spelled with an escape."""
    rows, want = [], {}

    def add(name, text, faults):
        rows.append((len(rows), name, text))
        want[len(rows) - 1] = sorted(faults)

    for name, payload in SOUND.items():
        add(name, json.dumps(payload), [])
        spec = schemas.EVENTS[name]
        for key in spec["required"]:
            add(name, json.dumps({k: v for k, v in payload.items() if k != key}), [("/" + key, "required")])
        typed = [k for k in payload if spec["properties"][k].get("type") == "string"]
        for key in typed[:2]:
            add(name, json.dumps(payload | {key: 5}), [("/" + key, "type")])
        add(name, '{"\\u0065vil":1,' + json.dumps(payload)[1:], [("/", "additionalProperties")])
        add(name, "[" + json.dumps(payload) + "]", [("/", "not_an_object")])
    add("purchase", json.dumps(SOUND["purchase"] | {"amount_scale": 2.5, "currency": "usd", "transaction_id": ""}), [("/amount_scale", "type"), ("/currency", "pattern"), ("/transaction_id", "minLength")])
    add("custom_event", json.dumps(SOUND["custom_event"] | {"attributes": {"Bad": {}, **{f"k{i}": i for i in range(20)}}}), [("/attributes", "maxProperties"), ("/attributes", "propertyNames"), ("/attributes/Bad", "anyOf"), ("/attributes/Bad", "type")])
    add("session_start", json.dumps(SOUND["session_start"] | {"extensions": {"provider_x": 1}}), [("/extensions", "propertyNames")])
    add("skan_postback", json.dumps(SOUND["skan_postback"] | {"conversion_value": 64}), [("/conversion_value", "maximum")])
    for text in (None, "", "null", "7", "{"):
        add("click", text, [("/", "not_an_object")])
    add("nothing", "{}", [("/event_name", "unknown_event")])
    found = schemas.validated(spark.createDataFrame(rows, "id long, event_name string, payload string"))
    got = {r["id"]: [tuple(f) for f in r["faults"]] for r in found.collect()}
    assert got == want
    assert len(SOUND) == 13 == len(schemas.EVENTS)


def test_items_and_choices(spark):
    schema = {"type": "object", "properties": {"xs": {"type": "array", "items": {"oneOf": [{"type": "integer"}, {"type": "number", "minimum": 5}]}}, "y": {"const": 1}, "z": {"not": {"type": "null"}}, "w": False}}
    text = '{"xs":[1, 5.5, 6, 0.5, "a"], "y": 2, "z": null, "w": 0}'
    got = spark.createDataFrame([(text,)], "p string").select(schemas.faults(F.col("p"), schema)).first()[0]
    assert {tuple(f) for f in got} == {("/w", "not_allowed"), ("/xs/2", "oneOf"), ("/xs/3", "oneOf"), ("/xs/3", "type"), ("/xs/3", "minimum"), ("/xs/4", "oneOf"), ("/xs/4", "type"), ("/y", "const"), ("/z", "not")}


def test_invalid_payloads_are_rejected_before_decisions(spark):
    from .test_stateful import attempt

    rows = [attempt(1, event_name="click", payload='{"click_id":"c"}'), attempt(2, event_name="click", payload='{"click_id":1}'), attempt(10, event_name="click", payload="x")]
    good, bad = schemas.schema_rejections(spark.createDataFrame(rows, ingest.SCHEMA))
    assert [r["delivery_id"] for r in good.collect()] == ["d1"]
    assert sorted((r["delivery_id"], r["reason_code"], tuple(r["invalid_fields"]), r["consent_reason"]) for r in bad.collect()) == [("d10", "payload_schema_invalid", ("/",), "consent_valid_before_withdrawal"), ("d2", "payload_schema_invalid", ("/click_id",), "consent_not_required")]


def test_ledgers_get_an_execution_once(spark, tmp_path):
    scope = ("t", "a")
    raw = spark.createDataFrame([(*scope, "r1", "encrypted:1"), (*scope, "r2", "encrypted:2"), (*scope, "r3", "encrypted:2"), ("t", "b", "r4", "encrypted:4"), ("u", "a", "r5", "encrypted:1")], "tenant_id string, app_id string, record_id string, raw_payload_ref string")
    facts = [spark.createDataFrame([(*scope, "i1", "r1"), (*scope, "i1", "r2"), (*scope, "i2", "r3"), ("u", "a", "i1", "r5"), (*scope, None, "r3")], "tenant_id string, app_id string, installation_id string, record_id string")]
    empty = lambda schema: spark.createDataFrame([], "tenant_id string, app_id string, " + schema)
    batches = spark.createDataFrame([(*scope, "b1", "body1", None), (*scope, "b2", "body2", "i1"), (*scope, "b3", "body3", None)], "tenant_id string, app_id string, ingest_batch_id string, body_ref string, installation_id string")
    members = spark.createDataFrame([(*scope, "b1", "r1"), (*scope, "b3", "r2"), (*scope, "b3", "r3")], "tenant_id string, app_id string, ingest_batch_id string, record_id string")
    ask = lambda *rows: spark.createDataFrame(list(rows), "privacy_request_id string, tenant_id string, app_id string, deletion_scope string, installation_id string, completed_at string")

    def run(*requests):
        deletion.append(deletion.execute(ask(*requests), facts, raw, empty("record_id string, ref string"), batches, members, empty("record_id string, ref string")), str(tmp_path))
        return {k: spark.read.parquet(f"{tmp_path}/{k}") for k in deletion.KEYS}

    one = ("q1", *scope, "installation", "i1", "2026-01-02")
    for _ in range(2):
        now = run(one)
        assert {r["record_id"] for r in now["states"].collect()} == {"r1", "r2"} and now["tombstones"].count() == now["corrections"].count() == 2
        assert {r["ref"] for r in now["purges"].collect()} == {"encrypted:1", "body1", "body2"} and now["audit"].count() == 1
    now = run(one, ("q2", *scope, "app", None, "2026-01-03"), ("q3", "t", "zz", "tenant", None, "2026-01-04"))
    assert {r["record_id"]: r["privacy_request_id"] for r in now["states"].collect()} == {"r1": "q1", "r2": "q1", "r3": "q2", "r4": "q3"}
    assert now["tombstones"].count() == 2 + 3 + 4 and {r["records"] for r in now["audit"].collect()} == {2, 3, 4}
    assert {r["ref"] for r in now["purges"].where("privacy_request_id = 'q2'").collect()} == {"encrypted:1", "encrypted:2", "body1", "body2", "body3"}


def test_a_tenant_is_no_task_and_null_keys_are_stored_once(spark):
    """Requests for an app or a tenant meet its records in many tasks, unsorted; a key with a null is found again."""
    raw = spark.range(4000).select(F.lit("t").alias("tenant_id"), F.when(F.col("id") % 2 == 0, "a").alias("app_id"), F.col("id").cast("string").alias("record_id"))
    facts = [raw.limit(0).withColumn("installation_id", F.lit("i"))]
    schema = "privacy_request_id string, tenant_id string, app_id string, deletion_scope string, installation_id string, completed_at string"
    requests = spark.createDataFrame([("q1", "t", "a", "app", None, "2026-01-02"), ("q2", "t", None, "tenant", None, "2026-01-03")], schema)
    wide = deletion._wide(raw, requests.where("deletion_scope = 'tenant'").select("tenant_id", "privacy_request_id"), ["tenant_id"], "record_id")
    told = wide._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in told and "SortMergeJoin" not in told
    reached = deletion.reached_records(requests, facts, raw)
    assert {r["privacy_request_id"]: r["count"] for r in reached.groupBy("privacy_request_id").count().collect()} == {"q1": 2000, "q2": 4000}
    rows = reached.select("tenant_id", "app_id", "privacy_request_id", "record_id", F.lit("x").alias("lifecycle_status"))
    first = deletion.added(rows.unionByName(rows.withColumn("lifecycle_status", F.lit("w"))), rows.where("false"), "tombstones")
    assert first.columns == rows.columns and {(r["lifecycle_status"], r["count"]) for r in first.groupBy("lifecycle_status").count().collect()} == {("w", 6000)}
    assert deletion.added(rows, first, "tombstones").count() == 0


def test_a_second_execution_meets_every_ledger(spark, tmp_path):
    """A first execution stores the rows of all ledgers, purges too, and a second one meets them."""
    kinds = ("click", "signup", "view", "purchase", "error")
    events = [(i, datetime(2024, 1, 1), i % 20, kinds[i // 20 % 5], 1.0, None) for i in range(400)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    told = {r["ledger"]: (r["first"], r["second"]) for r in QUERIES["v4_second_execution"](spark, str(tmp_path)).collect()}
    assert set(told) == set(deletion.KEYS) and all(first > 0 and second == 0 for first, second in told.values())
    assert told["purges"][0] == QUERIES["v4_purges"](spark, str(tmp_path)).count()


def test_stored_definitions():
    d = Definition("d3_roas", "revenue_over_cost", 3, grouping=("campaign_id",))
    assert recalculate.loaded(recalculate.stored(d)) == d
    for change in ({"calculation": "guess"}, {"more": 1}):
        with pytest.raises(ValueError):
            recalculate.loaded(json.dumps(json.loads(recalculate.stored(d)) | change))


def test_recalculation_of_costs_and_groups_that_vanish(spark):
    own = "tenant_id string, app_id string, installation_id string, "
    installs = spark.createDataFrame([("t", "a", "i1", 0, "x", "n1", "1"), ("t", "a", "i2", 0, "y", "n2", "1")], own + "installed_ms long, campaign_id string, record_id string, received_at string")
    revenue = spark.createDataFrame([("t", "a", "i1", 5, "v1", "1", 300), ("t", "a", "i1", 6, "v2", "2", 100)], own + "occurred_ms long, record_id string, received_at string, value long").withColumn("value", F.col("value").cast("decimal(38,0)"))
    sessions = spark.createDataFrame([], own + "occurred_ms long, record_id string, received_at string")
    events = spark.createDataFrame([], own + "occurred_ms long, record_id string, received_at string, event_name string")
    costs = spark.createDataFrame([("t", "a", "x", 200, "c1", "1")], "tenant_id string, app_id string, campaign_id string, cost long, record_id string, received_at string")
    every = recalculate.Inputs(installs, revenue, sessions, events, costs)
    roas = Definition("d0_roas", "revenue_over_cost", 0, grouping=("campaign_id",))
    runs = recalculate.first_runs([roas], every.until("1"), "metric", "2")
    values = lambda rows: sorted((json.loads(r["grouping"])["campaign_id"], None if r["value"] is None else int(r["value"]), r["undefined_reason"], r["supersedes_metric_run_id"] is not None) for r in rows.collect())
    assert values(runs) == [("x", 1500000, None, False), ("y", None, "no_attributed_cost", False)]
    assert values(recalculate.superseding(runs, every.until("1"), every, every.received_after("1"), "late", "3")) == [("x", 2000000, None, True)]
    gone = spark.createDataFrame([("n2",), ("c1",)], "record_id string")
    again = recalculate.superseding(runs, every, every.without(gone), gone, "privacy", "3")
    assert values(again) == [("x", None, "no_attributed_cost", True), ("y", None, "empty_cohort", True)]
    assert {r["metric_run_id"] for r in again.collect()} == {r["metric_run_id"] for r in recalculate.superseding(runs, every, every.without(gone), gone, "privacy", "9").collect()}


def test_published_snapshots(spark, tmp_path):
    days = spark.createDataFrame([("t", "d1", 5, None), ("t", "d2", 6, 1)], "tenant_id string, day string, clicks long, p50 long")
    none = days.withColumn("input_snapshot_id", F.lit("")).where("false")
    first = publication.publish(days, none, ["tenant_id", "day"])
    assert first.count() == 2 and publication.publish(days, first, ["tenant_id", "day"]).count() == 0
    later = days.withColumn("clicks", F.when(F.col("day") == "d2", 7).otherwise(F.col("clicks")))
    assert [r["clicks"] for r in publication.publish(later, first, ["tenant_id", "day"]).collect()] == [7]
    with pytest.raises(Exception, match="snapshot_content_conflict"):
        publication.publish(days, first.withColumn("clicks", F.col("clicks") + 1), ["tenant_id", "day"]).collect()
    with pytest.raises(Exception, match="snapshot_identity_repeated"):
        publication.publish(days.unionByName(later), none, ["tenant_id", "day"]).collect()
    clicks = spark.createDataFrame([("t", "a", f"c{i}", "d1", i * 10, "s") for i in range(9)], "tenant_id string, app_id string, click_id string, day string, clicked_ms long, site_id string")
    installs = spark.createDataFrame([("t", "a", f"c{i}", f"n{i}", i * 11) for i in range(0, 9, 2)], "tenant_id string, app_id string, click_id string, install_id string, installed_ms long")
    job = lambda c, i, at: publication.daily_job("d1", c, i, ["site_id"], str(tmp_path / "days"), at)
    assert [job(clicks, installs, "1"), job(clicks, installs, "2"), job(clicks, installs.where("install_id <> 'n8'"), "3"), job(clicks.where("false"), installs, "4")] == [1, 0, 1, 0]
    stored = spark.read.parquet(str(tmp_path / "days"))
    assert [(r["installs"], r["ctit_p50_ms"]) for r in publication.latest_snapshots(stored, ["tenant_id", "app_id", "day", "site_id"]).collect()] == [(4, 3)]


def test_quantiles_beside_sorted_lists(spark):
    import random

    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.randint(-(10**12), 10**12), rng.randint(0, 9), None])) for _ in range(3000)] + [("one", 7), ("nulls", None), ("two", -5), ("two", 100_000_000)]
    shares = {"least": 0.0, "p05": 0.05, "p50": 0.5, "p95": 0.95, "most": 1.0}
    got = {r["g"]: r for r in publication.quantiles(spark.createDataFrame(rows, "g string, v long"), ["g"], "v", shares).collect()}
    assert set(got) == {"a", "b", None, "one", "two"}
    for g, r in got.items():
        values = sorted(v for k, v in rows if k == g and v is not None)
        assert r["n"] == len(values)
        for name, share in shares.items():
            at = share * (len(values) - 1)
            low = int(at)
            high = min(low + 1, len(values) - 1)
            assert r[name] == pytest.approx(values[low] + (at - low) * (values[high] - values[low]), rel=1e-9)


def test_policies_lookups_and_series_that_are_unsound(spark, tmp_path):
    from larkspur.operators import attribution, metrics

    policy = lambda digest: (("2026-01-01", "tenant", "v1", digest),)
    good = "sha256 of the fields"
    import hashlib

    good = hashlib.sha256(b'{"authority":"tenant","before":"2026-01-01","policy_version":"v1"}').hexdigest()
    rows = lambda digest: spark.createDataFrame([policy(digest), (None,)], f"timestamp_stale_policy {ingest.STALE_POLICY}")
    assert sorted(str(r["stale_before"]) for r in ingest.with_stale_policy(rows(good)).collect()) == ["2026-01-01", "None"]
    with pytest.raises(Exception, match="policy_digest"):
        ingest.with_stale_policy(rows("0" * 64)).collect()
    none = spark.createDataFrame([], "tenant_id string, app_id string, record_id string, attribution_id string, status string, reason_code string, evidence_refs array<string>, decided_at string")
    done = spark.createDataFrame([("t", "a", "i", "attributed", "r", "d", "1")], "tenant_id string, app_id string, install_record_id string, status string, response_ref string, response_digest string, decided_at string")
    with pytest.raises(Exception, match="adservices_install_attribution_missing"):
        attribution.complete_lookups(none, done).collect()
    assert attribution.complete_lookups(none, done.withColumn("status", F.lit("dropped"))).count() == 0
    for d in metrics.registry().values():
        d.check()
    for change in ({"event_names": ("install",)}, {"grouping": ("metric_date", "country")}, {"calculation": "cohort_size"}, {"zone": "Asia/Tokyo"}):
        import dataclasses

        with pytest.raises(ValueError, match="series_mismatch"):
            dataclasses.replace(metrics.registry()["skan_attributed_installs"], **change).check()
    with pytest.raises(ValueError, match="series_mismatch"):
        Definition("other", "event_count", event_names=("skan_postback",), grouping=("metric_date",)).check()
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"tenant_id": "t", "app_id": "a b", "fx_policy": {"x": 1}, "evaluations": [{"metric_names": ["d0_roas"], "grouping": {}}]}))
    with pytest.raises(ValueError, match="app_id"):
        metrics.definition_file(spark, str(path), "2026-01-01")
    path.write_text(path.read_text().replace("a b", "a"))
    got = metrics.definition_file(spark, str(path), "2026-01-01")
    assert got["evaluations"][0]["grouping"] == {"cohort_date": "2026-01-01"} and got["fx_policy"] == {"x": 1}


def test_pages_of_a_hot_scope(spark):
    """One scope fills most ranges; null scopes, repeats and references in need of escapes; the digest is that of the array."""
    import hashlib
    import random

    from larkspur.operators import pages

    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), rng.choice(['q"', "é", "\\", ""]) + str(rng.randint(0, 900))) for _ in range(4000)] + [("none", None)]
    found = pages.evidence_pages(spark.createDataFrame(rows, "scope string, record_id string"), ["scope"], size=37, parts=7)
    got = {}
    for r in found.orderBy("page").collect():
        got.setdefault(r["scope"], []).append(r["refs"])
    want = {s: sorted({x for k, x in rows if k == s}, key=str.encode) for s in ("hot", "b", None)}
    assert {s: [x for p in ps for x in p] for s, ps in got.items()} == want
    assert all(len(p) == 37 for ps in got.values() for p in ps[:-1])
    told = {r["scope"]: (r["refs_digest"], r["refs"], r["pages"]) for r in pages.pages_digest(found, ["scope"]).collect()}
    assert told == {s: (hashlib.sha256(json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest(), len(x), -(-len(x) // 37)) for s, x in want.items()}


def test_runs_of_a_definitions_file(spark):
    base = "tenant_id string, app_id string, installation_id string, record_id string, received_at string"
    table = lambda extra, *rows: spark.createDataFrame([("t", "a", *r) for r in rows], f"{base}, {extra}")
    installs = table("installed_ms long, campaign_id string, cohort_date string", ("i", "r1", "2026-01-01", 0, "c", "1970-01-01"), ("j", "r2", "2026-01-09", 0, "c", "1970-01-01"))
    revenue = table("occurred_ms long, value long", ("i", "r3", "2026-01-01", 5, 7)).withColumn("value", F.col("value").cast("decimal(38,0)"))
    events = table("occurred_ms long, event_name string", ("i", "r4", "2026-01-01", 5, "click"), ("i", "r5", "2026-01-01", 86_400_005, "click"))
    inputs = recalculate.Inputs(installs, revenue, revenue.drop("value"), events, installs.select("tenant_id", "app_id", "campaign_id", "record_id", "received_at").withColumn("cost", F.lit(1)))
    known = [Definition("size", "cohort_size", grouping=("country",)), Definition("clicks", "event_count", event_names=("view",), grouping=("metric_date",)), Definition("ltv", "revenue_over_cohort", 0)]
    own = {"metric_name": "clicks", "calculation": "event_count", "event_names": ["click"], "grouping": ["metric_date"]}
    one = lambda names, **grouping: {"metric_names": names, "grouping": {"cohort_date": "1970-01-01", **grouping}, "input_received_at_watermark": "2026-01-02", "computed_at": "z", "metric_run_id_prefix": "p"}
    config = {"tenant_id": "t", "app_id": "a", "metric_definitions": [own], "evaluations": [one(["size", "ltv"], campaign_id="c"), one(["size"], campaign_id="none"), one(["clicks"]), one(["clicks"], metric_date="1970-01-02")]}
    got = [(r["metric_name"], r["value"] and int(r["value"]), r["undefined_reason"]) for r in recalculate.file_runs(config, known, inputs).orderBy("metric_name", F.desc("value")).collect()]
    assert got == [("clicks", 1, None), ("clicks", 1, None), ("ltv", 7_000_000, None), ("size", 1, None), ("size", None, "empty_cohort")]
    for wrong in (one(["none"]), one(["size"], planet="x")):
        with pytest.raises(ValueError, match="not defined|unknown grouping"):
            recalculate.file_runs({**config, "evaluations": [wrong]}, known, inputs)


def test_installs_of_recalculations_are_made_once(spark):
    """no definition aggregates or joins the whole ledger again to find its installs."""
    from larkspur.queries.base import Tables
    from larkspur.queries.evolve import inputs

    plan = inputs(Tables(spark, "/root/testdata/sf0.001")).installs._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
