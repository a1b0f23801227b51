import hashlib
import json
import random
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.functions import canon
from larkspur.operators import attribution, fraud, ingest, metrics, reconcile
from larkspur.plans import reporting
from larkspur.sources import delimited, files, mapping


def attempt(**x):
    base = dict(tenant_id="t", app_id="a", policy_digest="d", record_id="r1", delivery_id="d1", record_tenant_id="t", record_app_id="a", producer="sdk", event_id="e1", event_name="purchase", schema_version="1", occurred_at="2026-01-01T00:00:00.000Z", received_at="2026-01-01T00:00:01.000Z", late=False, subject_scope="installation_level", processing_purpose_id=None, processing_sequence=1, alternative_legal_basis_id=None, payload="{}", purposes=[], withdrawals=[], bases=[], stale_before=None)
    return base | x


def decided(spark, *rows):
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ingest.SCHEMA)
    return {r["delivery_id"]: r for r in ingest.decide(df).collect()}


def test_duplicates_conflicts_and_collisions(spark):
    got = decided(spark, attempt(), attempt(record_id="r2", delivery_id="d2", received_at="2026-01-01T00:00:02.000Z"), attempt(record_id="r3", delivery_id="d3", received_at="2026-01-01T00:00:03.000Z", payload='{"x":1}'), attempt(record_id="x", delivery_id="d4", event_id="e2"), attempt(record_id="x", delivery_id="d5", event_id="e3"))
    assert {k: v["duplicate_resolution"] for k, v in got.items()} == {"d1": "unique", "d2": "duplicate_delivery", "d3": "event_id_conflict", "d4": "record_id_collision", "d5": "record_id_collision"}
    assert got["d2"]["canonical_record_id"] == "r1" and got["d3"]["payload_disposition"] == "protected" and got["d4"]["payload_disposition"] == "discarded"


def test_consent_and_times(spark):
    p = [("p", True, "v")]
    w = [("p", "2026-01-01T00:00:00.000Z", 5)]
    basis = [("b", "p", "2026-01-01T00:00:00.000Z", "v2")]
    common = dict(processing_purpose_id="p", purposes=p, withdrawals=w)
    got = decided(spark, attempt(**common, delivery_id="before", record_id="1", event_id="1", processing_sequence=4), attempt(**common, delivery_id="after", record_id="2", event_id="2", processing_sequence=5), attempt(**common, delivery_id="basis", record_id="3", event_id="3", processing_sequence=6, alternative_legal_basis_id="b", bases=basis), attempt(delivery_id="bad", record_id="4", event_id="4", occurred_at="2026-02-30T00:00:00.000Z"), attempt(delivery_id="stale", record_id="5", event_id="5", stale_before="2026-06-01T00:00:00.000Z"), attempt(delivery_id="agg", record_id="6", event_id="6", subject_scope="aggregate", payload='{"installation_id":"i"}'))
    assert {k: v["reason_code"] for k, v in got.items()} == {"before": None, "after": "consent_withdrawn", "basis": None, "bad": "timestamp_invalid", "stale": "timestamp_stale", "agg": "aggregate_installation_join_forbidden"}


def test_decisions_do_not_depend_on_input_order(spark):
    rows = [attempt(record_id=f"r{i}", delivery_id=f"d{i}", event_id=f"e{i % 3}", received_at=f"2026-01-01T00:00:0{i}.000Z", payload=str(i % 2)) for i in range(8)]
    want = {k: v["duplicate_resolution"] for k, v in decided(spark, *rows).items()}
    for step in (3, 5, 7):
        assert {k: v["duplicate_resolution"] for k, v in decided(spark, *[rows[i * step % 8] for i in range(8)]).items()} == want


INSTALL = "tenant_id string, app_id string, record_id string, producer string, occurred_at string, received_at string, installation_id string, click_id string, referrer_status string, third_party_referrer_classification string, install_begin_at_server string, install_begin_at_server_status string, encrypted_referrer_status string, adservices_status string, has_import_context boolean, provider_attributed boolean, provider_attribution_strategy string, provider_confirmed_at string, provider_click_ref string"
CLICK = "tenant_id string, app_id string, record_id string, click_id string, producer string, remote_click_ref string, bot_prefetch boolean, redirector_click_at string, redirector_time_status string"


@pytest.mark.parametrize("begin,want", [("2026-08-07T23:59:59.999Z", "valid_install_referrer"), ("2026-08-08T00:00:00.000Z", "window_expired"), ("2026-08-08T00:00:00.001Z", "window_expired"), ("2026-07-31T23:59:59.999Z", "window_expired"), (None, "authoritative_time_missing")])
def test_seven_day_window(spark, begin, want):
    install = spark.createDataFrame([("t", "a", "i", "sdk", "o", "r", "u", "c", "available", None, begin, None, None, None, None, None, None, None, None)], INSTALL)
    click = spark.createDataFrame([("t", "a", "k", "c", "redirector", None, False, "2026-08-01T00:00:00.000Z", None)], CLICK)
    got = attribution.installs(install, click).first()
    assert got["reason_code"] == want
    assert got["evidence_refs"] == (["k", "i"] if want == "valid_install_referrer" else ["i"])


def test_cohort_fixture(spark):
    cohort = spark.createDataFrame([("i", 0)], "installation_id string, installed_ms long").withColumn("g", F.lit(1))
    day = 86_400_000
    rows = [("i", d * day, "EUR", "100000001", 6) for d in (0, 2, 5)]
    revenue = metrics.with_rates(spark.createDataFrame(rows, "installation_id string, occurred_ms long, currency string, amount_unscaled string, amount_scale int"), [{"currency": "EUR", "rate_unscaled": "5", "rate_scale": 1}], 6)
    got = metrics.cohort_revenue(cohort, revenue, ["g"], [1, 3, 7], ["installation_id"]).first()
    assert [int(got[f"revenue_d{d}"]) for d in (1, 3, 7)] == [50_000_000, 100_000_000, 150_000_000]
    df = spark.createDataFrame([("50000000",), ("100000000",), ("150000000",)], "r string")
    assert [int(r[0]) for r in df.select(metrics.ratio(F.col("r"), F.lit("100000000"))).collect()] == [500_000, 1_000_000, 1_500_000]


def test_postback_buckets(spark):
    rows = [(True, True, "s", 21, None, 0), (True, True, "s", None, "low", 0), (True, True, "s", 7, None, 0), (False, True, "s", 7, None, 0), (True, True, "s", None, None, 0)]
    df = spark.createDataFrame(rows, "signature_verified boolean, did_win boolean, source_identifier string, conversion_value int, coarse_conversion_value string, received_ms long")
    assert {r["conversion_bucket"]: r["value"] for r in metrics.postback_counts(df).collect()} == {"fine:21": 1, "coarse:low": 1, "fine:7": 1}


def test_fraud_rules(spark):
    df = spark.createDataFrame([("neg", 0, 5000, None, None), ("fast", 5000, 0, None, None), ("far", 400_000, 0, 301_000, "available"), ("order", 0, 0, 1000, "available")], "k string, b long, c long, r long, s string")
    hits = df.select("k", fraud.install_hits(F.col("b"), F.col("c"), F.col("r"), F.col("s")).alias("h")).collect()
    assert {r["k"]: [h["rule_id"] for h in r["h"]] for r in hits} == {"neg": ["ctit-clock-anomaly-v1"], "fast": ["ctit-lower-bound-v1"], "far": ["referrer-redirector-divergence-v1"], "order": ["referrer-server-order-v1", "ctit-lower-bound-v1"]}
    with pytest.raises(ValueError):
        fraud.Bundle(id="bad id").hash()


def test_reconciliation_reasons(spark):
    key = lambda v, kind="provider_click_id", n="trim": (kind, v, n, "one_to_one", None)
    inputs = spark.createDataFrame([("t", "a", r, k, None, False, "fresh") for r, k in [("none", []), ("missing", [key("zz")]), ("one", [key(" x ")]), ("two", [key("y")])]], f"tenant_id string, app_id string, reconciliation_id string, matching_keys array<{reconcile.KEY}>, privacy_effect string, provider_modeled_without_candidate boolean, freshness string")
    rows = [("t", "a", "one", "c1", [key("x")], 0, "in_window", "stale", False, None), ("t", "a", "two", "c2", [key("y")], 0, "in_window", "fresh", False, None), ("t", "a", "two", "c3", [key("y")], 1, "in_window", "fresh", False, None)]
    candidates = spark.createDataFrame(rows, f"tenant_id string, app_id string, reconciliation_id string, candidate_id string, matching_keys array<{reconcile.KEY}>, position int, window_status string, freshness string, excluded boolean, exclusion_reason string")
    got = {r["reconciliation_id"]: r for r in reconcile.reconcile(inputs, candidates).collect()}
    assert {k: v["difference_reason_code"] for k, v in got.items()} == {"none": "join_key_missing", "missing": "candidate_missing", "one": "freshness_mismatch", "two": "join_key_ambiguous"}
    assert got["two"]["candidates"] == ["c2", "c3"] and got["one"]["joins"] == ["provider_click_id:x=>c1"]


def test_mapping_errors_and_checks(spark):
    m = {"source_id": "s", "kind": "mmp_raw", "row_filter": {"source": "n", "equals": 1}, "rules": [{"target": "event_name", "expression": {"const": "click"}}, {"target": "event_id", "expression": {"source": "id", "prefix": "p:"}}, {"target": "occurred_at", "expression": {"source": "at", "timestamp": {"default_timezone": "UTC"}}}, {"target": "payload.kind", "expression": {"source": "kind", "map": {"a": "A"}}}]}
    rows = spark.createDataFrame([("1", "2026-01-01", "a", 1), ("2", "x", "a", 1), ("3", "2026-01-01T00:00:00Z", "b", 1), ("4", "2026-01-01", "a", 2), (None, "2026-01-01", "a", 1)], "id string, at string, kind string, n long")
    good, bad = mapping.split(mapping.apply(m, rows))
    assert [(r["mapped"]["event_id"], r["mapped"]["occurred_at"], r["mapped"]["payload"]["kind"]) for r in good.collect()] == [("p:1", "2026-01-01T00:00:00.000Z", "A")]
    assert sorted(r["error"] for r in bad.collect()) == sorted(["enum_value_not_mapped", "source_missing", "timestamp_unreadable"])
    with pytest.raises(ValueError):
        mapping.check({"rules": m["rules"][1:]})
    assert mapping.lint([{**m, "provider": "p"}, {**m, "provider": "p", "source_id": "z"}])[0]["source_ids"] == ["s", "z"]
    ids = mapping.attempts(good, "s").select("record_id").first()[0]
    assert ids.startswith("record:") and len(ids) == 7 + 48


def test_csv_reader(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a, b ,c\r\n1,"x ""q"", y\nz",\r\n,,\r\n2,,3\r\n')
    got = [tuple(r) for r in files.read_csv(spark, str(path)).collect()]
    assert got == [("1", 'x "q", y\nz', ""), ("2", "", "3")]
    (tmp_path / "y.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ValueError):
        files.headers(spark, str(tmp_path / "y.csv"))
    with pytest.raises(ValueError):
        files.read_rows(spark, str(path), "csv", max_rows=1)
    assert files.new_files(files.content_digests(spark, str(path)), spark.createDataFrame([], "digest string")).count() == 1


def test_csv_tasks_hold_little(spark, tmp_path):
    """One large batch of lines is told in batches of about BATCH bytes, records in order; a record over lines is whole."""
    values = [f'{i},"{"x" * 2000}' if i % 2 == 0 else f'{"y" * 2000}",z' for i in range(4000)]
    n = len(values)
    lines = pa.RecordBatch.from_arrays([pa.array(["f"] * n), pa.array([0] * n, pa.int64()), pa.array([False] * n), pa.array(values)], ["file", "block", "inside", "value"])
    got = list(delimited._whole(iter([lines])))
    assert len(got) == 8 and max(b.nbytes for b in got) < 1.2 * delimited.BATCH
    told = [c for b in got for c in b.column("cells").to_pylist()]
    assert told == [[str(i), "x" * 2000 + "\n" + "y" * 2000, "z"] for i in range(0, n, 2)]
    assert list(delimited._fragments(iter([lines]))) == []


def reference_records(source):
    """CSV by a scan of its characters."""
    rows, row, cell, quoted, i = [], [], "", False, 0
    while i < len(source):
        c = source[i]
        if c == '"' and quoted and source[i + 1 : i + 2] == '"':
            cell, i = cell + '"', i + 1
        elif c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            row, cell = [*row, cell], ""
        elif c in "\r\n" and not quoted:
            rows, row, cell = [*rows, [*row, cell]], [], ""
        else:
            cell += c
        i += 1
    return [r for r in [*rows, [*row, cell]] if any(r)]


def test_csv_in_ranges(spark, tmp_path):
    """Records over the borders of ranges, quotes anywhere, all line ends; each cut of the file gives the same records."""
    rng = random.Random(5)
    text = "a,b,c\n" + "".join(rng.choice(['x', 'yy', ',', ',', '\n', '\r\n', '\r', '""', ' ', 'é', '"p,q"', '"l1\nl2\r\nl3"', '"say ""hi"" "', '"' + "long " * 40 + '\n"']) for _ in range(900))
    path = tmp_path / "ranges.csv"
    path.write_bytes(text.encode())
    want = reference_records(text)
    for size in ("397", "100000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = [r["cells"] for r in delimited.records(spark, str(path)).orderBy("file", "block", "number").collect()]
            rows = [tuple(r) for r in files.read_csv(spark, str(path)).collect()]
            digest = files.content_digests(spark, str(path)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == want
        assert sorted(rows) == sorted(tuple((r + ["", "", ""])[:3]) for r in want[1:])
        assert [r["digest"] for r in digest] == [hashlib.sha256(text.encode()).hexdigest()]


def test_csv_headers_and_digests(spark, tmp_path):
    for i, head in enumerate(["a,,b\n1,2,3", "a,a\n1,2", "\n\n", ' a ,"a"\n1,2']):
        (tmp_path / f"{i}.csv").write_text(head)
        with pytest.raises(ValueError):
            files.read_csv(spark, str(tmp_path / f"{i}.csv"))
    (tmp_path / "open.csv").write_text('a,b\n1,"2\n3,4\n')
    with pytest.raises(Exception, match="unterminated"):
        files.read_csv(spark, str(tmp_path / "open.csv"))
    some = tmp_path / "some"
    some.mkdir()
    bodies = [b"", b"\n", b"a\n\n", b"a\r\nb", bytes(range(256)) * 9]
    for i, body in enumerate(bodies):
        (some / f"{i}").write_bytes(body)
    got = {r["path"].rsplit("/", 1)[1]: r["digest"] for r in files.content_digests(spark, str(some)).collect()}
    assert got == {f"{i}": hashlib.sha256(b).hexdigest() for i, b in enumerate(bodies) if b}


def test_report_filters():
    f = reporting.parse([("from", "2026-01-01"), ("to", "2026-01-31"), ("cursor", reporting.encode_cursor(["a", "b", "c"]))])
    assert f.after == ("a", "b", "c") and f.limit == 200
    for bad in ([("limit", "0")], [("limit", "1"), ("limit", "2")], [("installation_id", "x")], [("zzz", "x")], [("from", "2026-02-30")], [("from", "2026-02-02"), ("to", "2026-02-01")]):
        with pytest.raises(reporting.FilterError):
            reporting.parse(bad)


def test_invalid_times_and_key_order(spark):
    """An invalid time is unique, on time and rejected, late or not; payloads are compared without regard to the order of keys."""
    got = decided(
        spark,
        attempt(delivery_id="bad", record_id="b", event_id="b", late=True, occurred_at="2026-02-30T00:00:00.000Z"),
        attempt(delivery_id="one", record_id="1", payload='{"a":1,"b":[1,2]}'),
        attempt(delivery_id="two", record_id="2", payload='{ "b": [1, 2], "a": 1 }', received_at="2026-01-01T00:00:02.000Z"),
        attempt(delivery_id="three", record_id="3", payload='{"b":[2,1],"a":1}', received_at="2026-01-01T00:00:03.000Z"),
    )
    assert {k: (v["duplicate_resolution"], v["timeliness"], v["reason_code"]) for k, v in got.items()} == {"bad": ("unique", "on_time", "timestamp_invalid"), "one": ("unique", "on_time", None), "two": ("duplicate_delivery", "on_time", None), "three": ("event_id_conflict", "on_time", "event_id_conflict")}


def test_definition_files(spark):
    config = {"fx_policy": {"x": 1}, "evaluations": [{"metric_names": ["d0_roas"], "grouping": {"country": "DE"}}]}
    one = metrics.evaluations(config, "2026-01-02")[0]
    assert one["input_received_at_watermark"] == "2026-01-02T23:59:59.999Z" and one["grouping"] == {"cohort_date": "2026-01-02", "country": "DE"} and one["metric_run_id_prefix"].startswith("manual:2026-01-02:")
    assert one != metrics.evaluations(config, "2026-01-02", "2026-01-03T00:00:00.000Z")[0]
    for bad in ({}, {"fx_policy": {"x": 1}, "evaluations": []}, {"fx_policy": {"x": 1}, "evaluations": [{"metric_names": [1], "grouping": {}}]}):
        with pytest.raises(ValueError):
            metrics.evaluations(bad, "2026-01-02")
    for d in metrics.registry().values():
        d.check()


def test_cost_imports_refuse_mixed_scopes(spark):
    from larkspur.sources import connectors

    row = ("t", "a", "n", "c", None, None, "2026-01-01", "5", 6, "USD", "imported_reported", "2026-01-01T00:00:00.000Z")
    schema = "tenant_id string, app_id string, network string, campaign_id string, ad_group_id string, country string, date string, amount_unscaled string, amount_scale int, currency string, source string, as_of string"
    same = spark.createDataFrame([row, row], schema)
    assert connectors.append_costs(same).count() == 1
    assert connectors.append_costs(same, connectors.append_costs(same)).count() == 0
    with pytest.raises(ValueError):
        connectors.append_costs(spark.createDataFrame([row, ("u", *row[1:])], schema))
    with pytest.raises(Exception, match="cost money representation is invalid"):
        connectors.append_costs(spark.createDataFrame([(*row[:7], "-5", *row[8:])], schema)).count()


def test_bundles_on_the_driver_and_in_spark_agree(spark):
    sound = fraud.Bundle(layers={"base": {"quarantine_hours": 48}, "private": {"digest": "a" * 64}})
    cases = [
        (sound, None),
        (fraud.Bundle(id="bad id"), "fraud_bundle_id_invalid"),
        (fraud.Bundle(version=""), "fraud_bundle_version_invalid"),
        (fraud.Bundle(layers={}), "fraud_bundle_layers_invalid"),
        (fraud.Bundle(rules=[]), "fraud_bundle_rules_invalid"),
        (fraud.Bundle(layers={"base": {}, "private": {"digest": "a" * 64, "weights": 1}}), "fraud_bundle_private_layer_must_be_digest_only"),
        (fraud.Bundle(rules=[{"id": "x-rule", "inputs": ["ctit"], "action": "drop"}]), "fraud_bundle_rule_invalid:x-rule"),
        (fraud.Bundle(rules=[{"id": "x-rule", "inputs": ["integrity_verdict"], "action": "flag"}]), "integrity_only_rule_forbidden:x-rule"),
    ]
    stored = [(n, b.id, b.version, json.dumps(b.layers), json.dumps(b.rules)) for n, (b, _) in enumerate(cases)]
    got = fraud.registered(spark.createDataFrame(stored, "n int, id string, version string, layers string, rules string")).orderBy("n").collect()
    assert [r["error"] for r in got] == [e for _, e in cases]
    assert got[0]["bundle_hash"] == sound.hash() and got[0]["private_layer_digest"] == "a" * 64
    for bundle, error in cases[1:]:
        with pytest.raises(ValueError, match=error):
            bundle.check()
    assert sound.number("quarantine_hours") == 48 and sound.number("source_day_min_clicks") == 1000


def test_quarantines_resolve_once(spark):
    decisions = spark.createDataFrame([("t", "a", "d1", "quarantine"), ("t", "a", "d2", "quarantine"), ("t", "b", "d1", "quarantine")], "tenant_id string, app_id string, fraud_decision_id string, action string")
    held = spark.createDataFrame([("t", "a", "d1", 10), ("t", "a", "d1", 10), ("t", "a", "d2", 11)], "tenant_id string, app_id string, fraud_decision_id string, until_ms long")
    got = fraud.resolutions(decisions, held, 10).collect()
    assert [(r["app_id"], r["supersedes_fraud_decision_id"], r["decision"], r["action"], r["evaluated_at"]) for r in got] == [("a", "d1", "clear", "allow", "1970-01-01T00:00:00.010Z")]
    assert got[0]["fraud_decision_id"] == fraud.resolutions(decisions, held, 10).first()["fraud_decision_id"]
    assert fraud.resolutions(decisions, held.limit(0), 10).count() == 0


def test_batches_are_appended_with_their_bodies(spark, tmp_path):
    rows = [("t", "a", "p", "2026-01-01T00:00:00.000Z", bytearray(b"{}"), n) for n in (1, 1, 100, 0, 101, None)]
    requests = spark.createDataFrame(rows, "tenant_id string, app_id string, producer string, received_at string, body binary, event_count int")
    ingest.append_batches(requests, str(tmp_path / "batches"))
    got = spark.read.parquet(str(tmp_path / "batches")).collect()
    assert len(got) == 1 and bytes(got[0]["body"]) == b"{}" and got[0]["status"] == "pending"
    assert ingest.durable_batches(requests).where("error = 'event_count_out_of_range' and ingest_batch_id is null").count() == 3


def test_ids_of_version_7(spark):
    got = [r[0] for r in spark.range(200).select(canon.uuid_v7(F.lit(1_700_000_000_000) + F.col("id"))).collect()]
    assert len(set(got)) == 200 and [x[:13] for x in got] == sorted(x[:13] for x in got)
    assert all(u.version == 7 and u.variant == uuid.RFC_4122 for u in map(uuid.UUID, got))


def test_dashboard_of_a_page(spark):
    columns = "metric_name string, grouping_digest string, metric_run_id string, value_state string, value_unscaled long, input_snapshot_id string, aggregation_time_zone string, data_freshness string, metric_definition_version string, rule_bundle_id string, rule_bundle_hash string, policy_versions array<string>"
    rest = ["s", "UTC", "fresh", "v1", "b", "h", ["p2", "p1"]]
    page = spark.createDataFrame([("m", "b", "1", "present", 5, *rest), ("m", "a", "2", "undefined", None, *rest), ("aak_attributed_installs", "a", "3", "present", 7, *rest)], columns)
    got = {r["metric_name"]: (r["kind"], r["series"], r["undefined"]) for r in reporting.dashboard_series(page).collect()}
    assert got == {"m": ("deterministic", [None, 5.0], 1), "aak_attributed_installs": ("aggregate", [7.0], 0)}
    meta = reporting.dashboard_metadata(page).first()
    assert (meta["rule_bundles"], meta["policy_versions"], meta["undefined_count"]) == (["b:h"], ["p1", "p2"], 1)


def test_digests_of_attempts_are_ordered_as_bytes(spark):
    """F8: the last key of the order is not wider than its digest, and payloads keep their digests as text."""
    rows = spark.createDataFrame([{"tenant_id": "t", "app_id": "a", "record_tenant_id": "t", "record_app_id": "a", "producer": "p", "event_id": "e", "event_name": "x", "schema_version": "1", "record_id": f"r{n}", "delivery_id": f"d{n}", "occurred_at": "2026-01-02T00:00:00.000Z", "received_at": f"2026-01-03T00:00:0{n}.000Z", "late": False, "payload": '{"v":1}' if n < 3 else '{"v":2}'} for n in (1, 2, 3)], ingest.SCHEMA)
    assert ingest.examined(rows).select(F.max(F.octet_length(ingest.attempt_order()[-1]))).first()[0] <= 64
    given = rows.withColumn("payload_sha256", F.when(F.col("delivery_id") == "d3", "no digest").otherwise("one"))
    for table in (rows, given):
        assert [r[0] for r in ingest.decide(table).orderBy("delivery_id").select("duplicate_resolution").collect()] == ["unique", "duplicate_delivery", "event_id_conflict"]
    assert {r[0] for r in ingest.decide(rows).select(F.length("payload_sha256")).collect()} == {64}
