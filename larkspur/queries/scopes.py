"""Queries of input scopes, grouping, costs, replays, guards, links and outside answers over the test tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions import answers, canon, instants, links
from larkspur.operators import fraud, ingest, metrics
from larkspur.plans import reporting
from larkspur.sources import connectors

from .base import query
from .domain import _days_sql, attempts

ISO = "strftime(epoch_ms({0}), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST({0} % 1000 AS VARCHAR), 3, '0') || 'Z'"


def _scope() -> list[Column]:
    return [F.lit("t").alias("tenant_id"), F.lit("a").alias("app_id")]


def _at(ms: Column) -> Column:
    return instants.canonical(F.timestamp_millis(ms))


CUT = "2024-01-15T00:00:00.000Z"


@query("p18_visible_records", f"""
SELECT b.event_id, coalesce(s.l, 'available') AS lifecycle_status FROM base b LEFT JOIN (SELECT id, arg_max(l, seq) AS l FROM (
  SELECT event_id AS id, 1 AS seq, 'redacted' AS l FROM base WHERE event_id % 6 = 0 UNION ALL SELECT event_id, 2, 'available' FROM base WHERE event_id % 12 = 0) GROUP BY id) s ON s.id = b.event_id
WHERE {ISO.format('b.ms')} <= '{CUT}' AND coalesce(s.l, 'available') = 'available'""", ("base",))
def _(t):
    records = t.base().select(*_scope(), "event_id", F.col("event_id").alias("record_id"), _at(F.col("ms")).alias("received_at"))
    state = lambda every, seq, status: records.where(F.col("event_id") % every == 0).select("tenant_id", "app_id", "record_id", F.lit(seq).alias("state_seq"), F.lit(status).alias("lifecycle_status"))
    states = state(6, 1, "redacted").unionByName(state(12, 2, "available"))
    return metrics.visible(records, states, CUT, "after").select("event_id", "lifecycle_status")


@query("z4_input_watermark", f"SELECT event_id FROM base WHERE {ISO.format('ms')} <= '{CUT}'", ("base",))
def _(t):
    records = t.base().select(*_scope(), "event_id", F.col("event_id").alias("record_id"), _at(F.col("ms")).alias("received_at"))
    return metrics.visible(records, records.where("false"), CUT).select("event_id")


def _grouped(t):
    e = t.base().join(t.people(), "user_id", "left")
    part = lambda test, c: F.when(F.expr(test), F.col(c))
    return e.select(*_scope(), "event_id", F.col("event_id").cast("string").alias("record_id"), F.when(F.col("event_type") == "signup", "install").otherwise(F.col("event_type")).alias("event_name"), _at(F.col("ms")).alias("occurred_at"), F.col("user_id").cast("string").alias("installation_id"), part("event_id % 3 = 0", "campaign_id").alias("campaign_id"), F.lit(None).cast("string").alias("link_campaign_id"), part("event_id % 3 > 0", "campaign_id").alias("provider_campaign_ref"), part("event_id % 5 = 0", "network").alias("network"), part("event_id % 5 = 1", "network").alias("ad_network"), part("event_id % 5 > 1", "network").alias("provider_network"), F.lit(None).cast("string").alias("country"), F.col("country").alias("provider_country"))


@query("p20_grouping_match", """
SELECT event_id FROM base JOIN people ON people.user_id = base.user_id WHERE campaign_id = 'BUILDING' AND network IN ('ASIA') AND (event_type <> 'signup' OR CAST(ts AS DATE) = DATE '2024-01-01' + CAST((SELECT min(CAST(ts AS DATE)) FROM base WHERE event_type = 'signup') - DATE '2024-01-01' AS INTEGER)) AND (event_type <> 'signup' OR base.user_id % 3 = 0)""", ("base", "people"))
def _(t):
    first = t.base().where("event_type = 'signup'").agg(F.min(F.to_date("ts")).cast("string")).first()[0]
    statuses = t.people().select(*_scope(), F.col("user_id").cast("string").alias("subject_ref"), F.when(F.col("user_id") % 3 == 0, "non_organic").otherwise("organic").alias("status"))
    return metrics.matching(_grouped(t), {"campaign_id": "BUILDING", "network": "ASIA", "cohort_date": first, "attribution_status": "non_organic"}, statuses).select("event_id")


def _order_costs(t):
    return t.chain().select(F.lit("t").alias("tenant_id"), F.concat(F.lit("a"), F.col("subject") % 7).alias("app_id"), F.col("subject").cast("string").alias("cost_key_digest"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("as_of"), F.col("id").alias("cost_record_id"), F.col("cents").alias("amount_unscaled"), F.expr("case when id % 2 = 0 then 'USD' else 'EUR' end").alias("currency"), F.col("status").alias("network"))


@query("j26_scoped_costs", """
SELECT subject % 7 AS app, CAST(count(*) AS BIGINT) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM (SELECT subject, arg_max(cents, (o_orderdate, id)) AS cents FROM chain WHERE o_orderdate <= TIMESTAMP '1998-01-01' AND status = 'O' GROUP BY subject)
WHERE subject % 7 IN (SELECT CAST(user_id % 5 AS BIGINT) FROM installs) GROUP BY 1""", ("chain", "installs"))
def _(t):
    cohort = t.installs().select(F.lit("t").alias("tenant_id"), F.concat(F.lit("a"), F.col("user_id") % 5).alias("app_id"))
    costs = metrics.scoped_costs(_order_costs(t), cohort, "1998-01-01", {"network": "O"})
    return costs.groupBy(F.substring("app_id", 2, 9).cast("long").alias("app")).agg(F.count("*").alias("n"), F.sum("amount_unscaled").alias("cents"))


@query("j11_aggregate_attribution", """
SELECT CAST(event_id AS VARCHAR) AS record_id, s AS attribution_status FROM (SELECT k, arg_max(s, (d, id)) AS s FROM (
  SELECT o_orderkey AS id, o_orderdate AS d, o_orderstatus AS s, unnest([o_orderkey % 1000, o_custkey % 1000]) AS k FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01') GROUP BY k) x JOIN events ON event_id = k""")
def _(t):
    records = t.read("events").select(*_scope(), F.col("event_id").cast("string").alias("record_id"))
    refs = F.array((F.col("o_orderkey") % 1000).cast("string"), (F.col("o_custkey") % 1000).cast("string"))
    decisions = t.read("orders").select(*_scope(), F.lit("aggregate").alias("subject_scope"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("decided_at"), F.col("o_orderkey").alias("attribution_id"), F.col("o_orderstatus").alias("status"), F.lit("r").alias("reason_code"), refs.alias("evidence_refs"))
    return metrics.aggregate_attribution(records, decisions, "1998-01-01").select("record_id", "attribution_status")


@query("j25_replays", """
SELECT 'run:' || user_id AS source_metric_run_id, 'metric-replay:' || substr(sha256('{"evaluation":"{\\"a\\":1,\\"b\\":' || user_id || '}","fx_policy":"{}","metric_definition":"{\\"n\\":\\"m\\"}","metric_names":["m"],"source_metric_run_id":"run:' || user_id || '","version":1}'), 1, 48) AS metric_replay_manifest_id
FROM base GROUP BY user_id HAVING bool_or(event_id % 200 = 0)""", ("base",))
def _(t):
    users = t.base().select("user_id").distinct()
    run = F.concat(F.lit("run:"), "user_id")
    runs = users.select(*_scope(), run.alias("metric_run_id"), F.lit("m").alias("metric_name"), F.lit(CUT).alias("computed_at"), F.lit('{"n": "m"}').alias("metric_definition"), F.concat(F.lit('{"b": '), "user_id", F.lit(', "a": 1}')).alias("evaluation"), F.lit("{}").alias("fx_policy"))
    evidence = metrics.evidence_rows(t.base().withColumn("metric_run_id", run), ["metric_run_id"], "event_id")
    gone = t.base().where("event_id % 200 = 0").select(F.col("event_id").alias("record_id"))
    return metrics.replays(metrics.replay_manifests(runs), evidence, gone).select("source_metric_run_id", "metric_replay_manifest_id")


@query("s11_cost_file", """
SELECT CAST(o_custkey AS VARCHAR) AS campaign_id, o_orderstatus AS network, strftime(o_orderdate, '%Y-%m-%d') AS date, CAST(CAST(round(o_totalprice * 100) AS BIGINT) * 10000 AS VARCHAR) AS amount_unscaled FROM orders WHERE o_orderstatus = 'F'""")
def _(t):
    spend = F.round(F.col("o_totalprice") * 100).cast("long")
    rows = t.read("orders").select(F.col("o_custkey").cast("string").alias("campaign"), F.col("o_orderstatus").alias("net"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.concat(F.expr("cast(round(o_totalprice * 100) as bigint) div 100"), F.lit("."), F.lpad((spend % 100).cast("string"), 2, "0")).alias("spend"))
    text = lambda target, source: {"target": target, "expression": {"source": source}}
    rules = [text("network", "net"), text("campaign_id", "campaign"), text("date", "day"), {"target": "as_of", "expression": {"const": "2024-01-01T00:00:00Z"}}, {"target": "money", "expression": {"source": "spend", "money": {"input": "decimal", "scale": 6, "currency_default": "usd"}}}]
    plan = {"kind": "manual_cost", "tenant_id": "t", "app_id": "a", "source_id": "s", "row_filter": {"source": "net", "equals": "F"}, "rules": rules}
    return connectors.cost_file(plan, rows).select("campaign_id", "network", "date", "amount_unscaled")


@query("s10_cost_append", """
SELECT o_orderstatus AS network, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT o_orderstatus, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderdate FROM orders WHERE o_orderkey % 2 = 0 EXCEPT SELECT o_orderstatus, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT), o_orderdate FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 1""")
def _(t):
    o = t.read("orders")
    rows = o.select("o_orderkey", *_scope(), F.col("o_orderstatus").alias("network"), F.col("o_custkey").cast("string").alias("campaign_id"), F.lit(None).cast("string").alias("ad_group_id"), F.lit(None).cast("string").alias("country"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.round(F.col("o_totalprice") * 100).cast("long").cast("string").alias("amount_unscaled"), F.lit(2).alias("amount_scale"), F.lit("USD").alias("currency"), F.lit("imported_reported").alias("source"), F.lit(CUT).alias("as_of"))
    stored = connectors.append_costs(rows.where("o_orderkey % 3 = 0").drop("o_orderkey"))
    return connectors.append_costs(rows.where("o_orderkey % 2 = 0").drop("o_orderkey"), stored).groupBy("network").agg(F.count("*").alias("n"))


GUARD = """
guarded AS (SELECT tenant_id, day FROM days GROUP BY tenant_id, day HAVING sum(installs) > 0 AND sum(neg) / sum(installs) > 0.05)
SELECT 'attr:' || n.install_id AS supersedes_attribution_id, 'provisional' AS finality FROM named n JOIN clicks c ON c.event_id = n.click_id JOIN guarded g ON g.tenant_id = 't' || c.user_id % 2 AND g.day = CAST(CAST(c.ts AS DATE) AS VARCHAR) WHERE n.install_id % 4 <> 0
"""


@query("t12_clock_guard", _days_sql(GUARD).replace("AS p95 FROM j GROUP BY tenant_id, day, source)\n", "AS p95 FROM j GROUP BY tenant_id, day, source),\n"))
def _(t):
    from larkspur.operators import ledger

    from .domain import _days

    scope = [F.concat(F.lit("t"), F.col("user_id") % 2).alias("tenant_id"), F.lit("a").alias("app_id")]
    named = ledger.as_of(t.base().where("event_type = 'signup'"), t.clicks().withColumn("c", F.col("event_id")), ["user_id"], "ms", "clicked_ms", "c", "click_id")
    installs = named.where("click_id is not null").select(*scope, F.col("event_id").cast("string").alias("installation_id"), F.col("click_id").cast("string").alias("click_id"))
    clicks = t.clicks().select(*scope, F.col("event_id").cast("string").alias("click_id"), _at(F.col("clicked_ms")).alias("redirector_click_at"))
    first = t.base().where("event_type = 'signup'").select(*scope, F.concat(F.lit("attr:"), "event_id").alias("attribution_id"), F.col("event_id").cast("string").alias("subject_ref"), F.lit("valid_install_referrer").alias("reason_code"), F.lit("x").alias("decided_at"), F.lit("final").alias("finality"), F.lit(None).cast("string").alias("supersedes_attribution_id"), "event_id")
    replaced = first.where("event_id % 4 = 0").withColumn("supersedes_attribution_id", F.col("attribution_id")).withColumn("attribution_id", F.concat("attribution_id", F.lit(":2"))).withColumn("reason_code", F.lit("fraud_excluded"))
    days = _days(t).withColumn("input_snapshot_id", F.col("source")).withColumn("computed_at", F.lit(CUT))
    return fraud.clock_guard(first.unionByName(replaced).drop("event_id"), installs, clicks, days).select("supersedes_attribution_id", "finality")


@query("r4_install_fraud", """
WITH base AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, event_type, user_id FROM events), c AS (SELECT event_id, ms, user_id % 500 AS k FROM base WHERE event_type = 'click' AND event_id % 19 <> 0), one AS (SELECT k, min(event_id) AS event_id, min(ms) AS ms FROM c GROUP BY k HAVING count(*) = 1),
i AS (SELECT b.event_id, b.ms, o.event_id AS click, o.ms AS click_ms FROM base b LEFT JOIN one o ON o.k = b.user_id % 500 WHERE event_type = 'signup')
SELECT 'fraud:' || event_id || CASE rule WHEN 'ctit-lower-bound-v1' THEN ':click-injection' ELSE ':' || rule END AS fraud_decision_id, sha256('["' || rule || '","' || coalesce(CAST(click AS VARCHAR), 'no-redirector-click') || '","' || event_id || '"]') AS evidence_digest FROM (
  SELECT *, 'referrer-server-order-v1' AS rule FROM i WHERE event_id % 2 = 0 UNION ALL SELECT *, 'ctit-clock-anomaly-v1' FROM i WHERE ms < click_ms
  UNION ALL SELECT *, 'ctit-lower-bound-v1' FROM i WHERE ms >= click_ms AND ms - click_ms < 10000 UNION ALL SELECT *, 'referrer-redirector-divergence-v1' FROM i WHERE ms >= click_ms AND event_id % 2 = 0 AND abs(ms + 2000 - click_ms) > 300000)""")
def _(t):
    e = t.base()
    clicks = e.where("event_type = 'click'").select(*_scope(), F.col("event_id").cast("string").alias("record_id"), (F.col("user_id") % 500).alias("click_id"), _at(F.col("ms")).alias("redirector_click_at"), F.when(F.col("event_id") % 19 == 0, "invalid").alias("redirector_time_status"))
    installs = e.where("event_type = 'signup'").select(*_scope(), F.col("event_id").cast("string").alias("record_id"), (F.col("user_id") % 500).alias("click_id"), _at(F.col("ms")).alias("received_at"), _at(F.col("ms")).alias("install_begin_at_server"), F.when(F.col("event_id") % 2 == 0, _at(F.col("ms") + 2000)).alias("referrer_click_at_server"), F.when(F.col("event_id") % 2 == 0, "available").otherwise("none").alias("referrer_click_at_server_status"))
    return fraud.install_fraud(installs, clicks).select("fraud_decision_id", "evidence_digest")


@query("d10_pre_ingestion", "SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'refused' AS reason FROM customer UNION ALL SELECT 'decided' FROM events UNION ALL SELECT 'decided' FROM events WHERE event_id % 7 = 0) GROUP BY reason")
def _(t):
    refused = t.read("customer").select(F.concat(F.lit("x"), "c_custkey").alias("delivery_id"), F.concat(F.lit("x"), "c_custkey").alias("record_id"), *_scope(), F.lit("schema_invalid").alias("reason_code"))
    every = ingest.with_pre_ingestion(ingest.decide(attempts(t)), refused)
    return every.groupBy(F.when((F.col("reason_code") == "schema_invalid") & (F.col("payload_disposition") == "discarded"), "refused").otherwise("decided").alias("reason")).agg(F.count("*").alias("n"))


@query("d11_install_anchors", """
SELECT CAST(event_id AS VARCHAR) AS record_id, CASE WHEN event_id % 10 = 0 THEN 'ambiguous installation anchor' WHEN event_id % 4 = 1 THEN 'invalid reinstall installation anchor' WHEN event_id % 4 = 2 AND event_id % 3 = 0 THEN 'missing prior installation anchor' ELSE 'first install must not name a prior installation' END AS error
FROM events WHERE event_id % 10 = 0 OR event_id % 4 = 1 OR (event_id % 4 = 2 AND event_id % 3 = 0) OR (event_id % 4 = 3 AND event_id % 5 = 1)""")
def _(t):
    own = F.when(F.col("event_id") % 10 == 0, "shared").otherwise(F.concat(F.lit("i"), "event_id"))
    prior = F.expr("case when event_id % 4 = 2 and event_id % 3 = 0 then 'nobody' when event_id % 4 = 2 then 'shared' when event_id % 4 = 3 and event_id % 5 = 1 then 'shared' end")
    rows = t.read("events").select(*_scope(), F.col("event_id").cast("string").alias("record_id"), own.alias("installation_id"), F.expr("case when event_id % 4 in (1, 2) then 'reinstall' when event_id % 4 = 3 then 'first' end").alias("install_type"), prior.alias("prior_installation_id"))
    return ingest.assert_install_anchors(rows).select("record_id", "error")


@query("d11_references", "SELECT 'refund:' || o_orderkey AS ref_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def _(t):
    refs = t.read("orders").select(*_scope(), F.lit("refund").alias("kind"), F.concat(F.lit("refund:"), "o_orderkey").alias("ref_id"), F.col("o_custkey").alias("record_id"))
    return ingest.assert_references(refs, t.read("customer").where("c_acctbal >= 0").select(*_scope(), F.col("c_custkey").alias("record_id"))).select("ref_id")


@query("p24_protected_evidence", """
SELECT event_id, CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'b' || event_id END AS token_ref, CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'keep=x,adservices_token_evidence_ref=b' || event_id ELSE 'keep=x' END AS kept FROM events""")
def _(t):
    e = t.read("events")
    ext = F.map_filter(F.create_map(F.lit("keep"), F.lit("x"), F.lit("adservices_attribution_token_protected"), F.when(F.expr("event_type = 'signup' and event_id % 2 = 0"), F.lit("secret"))), lambda k, v: v.isNotNull())
    rows = e.select("event_id", F.col("event_id").cast("string").alias("record_id"), F.lit("sdk-ios").alias("producer"), F.when(F.col("event_type") == "signup", "install").otherwise(F.col("event_type")).alias("event_name"), F.concat(F.lit("b"), "event_id").alias("body_ref"), ext.alias("extensions"))
    out = ingest.without_protected(rows)
    return out.select("event_id", F.col("lookup.token_ref").alias("token_ref"), F.array_join(F.transform(F.map_entries("extensions"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("kept"))


@query("f17_deferred_referrer", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'omv=1&cid=' || id WHEN 1 THEN 'omv=1&cid=' || id || '&dl=%2Fshop%2Fi' || event_id || '&dlp_k=v' || event_id % 7 ELSE 'omv=1&cid=' || id END AS referrer, CASE event_id % 3 WHEN 0 THEN 'not_configured' WHEN 1 THEN 'carried' ELSE 'omitted_length' END AS status FROM (SELECT event_id, lpad(CAST(event_id AS VARCHAR), 44, 'c') AS id FROM events)""")
def _(t):
    path = F.expr("case event_id % 3 when 1 then concat('/shop/i', event_id) when 2 then '/a/b' end")
    params = F.create_map(F.lit("k"), F.when(F.col("event_id") % 3 == 2, F.repeat(F.lit("x"), 600)).otherwise(F.concat(F.lit("v"), F.col("event_id") % 7)))
    d = links.deferred_referrer(F.lpad(F.col("event_id").cast("string"), 44, "c"), path, params)
    return t.read("events").select("event_id", d.alias("d")).select("event_id", "d.referrer", "d.status")


@query("f17_bound_parameters", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'v' || event_id END AS k, CAST(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 3 END AS INTEGER) AS dropped FROM events")
def _(t):
    given = F.create_map(F.lit("dlp_k"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("v"), "event_id")).otherwise("a b"), F.lit("dlp_other"), F.lit("x"), F.lit("utm"), F.lit("y"))
    return t.read("events").select("event_id", links.bind_parameters(given, F.array(F.lit("k"))).alias("b")).select("event_id", F.try_element_at("b.values", F.lit("k")).alias("k"), "b.dropped")


@query("f18_redirects", """
SELECT event_id, CASE WHEN l >= 20 THEN 'https://home.example/' WHEN l % 2 = 0 THEN 'https://play.google.com/store/apps/details?id=p' || l || '&referrer=omv%3D1%26cid%3D' || lpad(CAST(event_id AS VARCHAR), 44, 'c') ELSE 'https://shop.example/' || l END AS location, l < 20 AND event_id % 5 = 0 AS bot_prefetch, CASE WHEN l < 20 THEN n_name END AS campaign_id
FROM (SELECT event_id, event_id % 30 AS l FROM events) e LEFT JOIN nation ON n_nationkey = l""")
def _(t):
    n = F.col("n_nationkey")
    table = t.read("nation").select(n.alias("tracking_link_id"), F.when(n < 20, "active").otherwise("inactive").alias("status"), *_scope(), F.when(n % 2 == 0, "https://play.google.com/store/apps/details").otherwise(F.concat(F.lit("https://shop.example/"), n)).alias("destination_url"), F.when(n % 2 == 0, "play_store").otherwise("web").alias("destination_kind"), F.concat(F.lit("p"), n).alias("play_package_name"), F.lit(None).cast("string").alias("deep_link_value"), F.col("n_name").alias("campaign_id"), *[F.lit(None).cast("string").alias(c) for c in ("ad_group_id", "creative_id", "network", "site_id")])
    asked = t.read("events").select("event_id", (F.col("event_id") % 30).cast("int").alias("tracking_link_id"), F.lpad(F.col("event_id").cast("string"), 44, "c").alias("click_id"), F.lit(CUT).alias("now"), F.when(F.col("event_id") % 5 == 0, "bot").otherwise("other").alias("client_class"), F.lit(None).cast("string").alias("remote_click_ref"), F.lit(None).cast("map<string,string>").alias("params"))
    out = links.redirects(asked, table, "https://home.example/")
    return out.select(F.ltrim(F.col("click_id"), F.lit("c")).cast("long").alias("event_id"), "location", "bot_prefetch", "campaign_id")


@query("w8_newest_links", "SELECT o_orderkey AS tracking_link_id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200")
def _(t):
    return links.newest_links(t.read("orders").select(F.col("o_orderkey").alias("tracking_link_id"), F.col("o_orderdate").alias("created_at"))).select("tracking_link_id")


@query("f22_encrypted_referrers", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'decrypted' WHEN 1 THEN 'auth_failed' WHEN 2 THEN 'absent' ELSE 'malformed' END AS status, CASE WHEN event_id % 4 = 0 THEN 'c' || event_id END AS campaign_id FROM events")
def _(t):
    keys = {"old": "00" * 32, "now": "11" * 32}
    key = F.when(F.col("event_id") % 4 == 1, F.unhex(F.lit("22" * 32))).otherwise(F.unhex(F.lit(keys["now"])))
    plain = F.concat(F.lit('{"campaign_id":"c'), "event_id", F.lit('","unlisted":1}'))
    sealed = F.hex(F.aes_encrypt(plain.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), F.unhex(F.lpad(F.hex("event_id"), 24, "0"))))
    rows = t.read("events").select("event_id", sealed.alias("sealed")).select("event_id", F.when(F.col("event_id") % 4 == 2, None).otherwise(F.expr("substring(sealed, 25)")).alias("data"), F.when(F.col("event_id") % 4 == 2, None).when(F.col("event_id") % 4 == 3, "zz").otherwise(F.substring("sealed", 1, 24)).alias("nonce"))
    return rows.select("event_id", answers.decrypt_referrer(F.col("data"), F.col("nonce"), keys).alias("r")).select("event_id", "r.status", F.try_element_at("r.context", F.lit("campaign_id")).alias("campaign_id"))


@query("f23_lookup_answers", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'attributed' WHEN 1 THEN 'not_attributed' END AS status, CASE WHEN event_id % 5 = 0 THEN CAST(event_id AS VARCHAR) END AS campaign_id, CASE event_id % 5 WHEN 2 THEN 'adservices_attribution_invalid' WHEN 3 THEN 'country_or_region' WHEN 4 THEN 'claim_type' END AS error FROM events")
def _(t):
    body = F.expr("""case event_id % 5 when 0 then concat('{"attribution":true,"campaignId":', event_id, ',"claimType":"Click"}') when 1 then '{"attribution":false,"claimType":"?"}' when 2 then '{"campaignId":1}' when 3 then '{"attribution":true,"countryOrRegion":"usa"}' else '{"attribution":true,"claimType":"Look"}' end""")
    return t.read("events").select("event_id", answers.lookup_answer(body).alias("a")).select("event_id", "a.status", "a.campaign_id", "a.error")


@query("z14_lookup_steps", """
SELECT o_orderkey, outcome, CASE WHEN outcome = 'retry' THEN CASE WHEN s = 404 THEN 5000 ELSE least(3600000, CAST(60000 * pow(2, least(3, n + 1)) AS BIGINT)) END END AS wait FROM (
  SELECT *, CASE WHEN age >= 82800000 THEN 'token_expired' WHEN s = 200 THEN 'answered' WHEN s = 400 THEN 'lookup_unavailable' WHEN s = 404 AND n >= 2 THEN 'lookup_unavailable' ELSE 'retry' END AS outcome FROM (
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 200 WHEN 1 THEN 400 WHEN 2 THEN 404 ELSE 503 END AS s, o_custkey % 5 AS n, (o_orderkey % 30) * 3600000 AS age FROM orders))""")
def _(t):
    status = F.expr("case o_orderkey % 4 when 0 then 200 when 1 then 400 when 2 then 404 else 503 end")
    step = answers.lookup_step(status, F.col("o_custkey") % 5, (F.col("o_orderkey") % 30) * 3_600_000, F.lit(0).cast("long"))
    return t.read("orders").select("o_orderkey", step.alias("x")).select("o_orderkey", "x.outcome", F.col("x.next_attempt_ms").alias("wait"))


@query("f24_integrity_verdicts", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unavailable' WHEN event_id % 3 = 0 THEN 'verified' ELSE 'failed' END AS verdict FROM events")
def _(t):
    binding = F.concat(F.lit("h"), "event_id")
    play = F.concat(F.lit('{"requestDetails":{"requestHash":"'), F.when(F.col("event_id") % 3 == 1, "other").otherwise(binding), F.lit('"},"appIntegrity":{"appRecognitionVerdict":"PLAY_RECOGNIZED"},"deviceIntegrity":{"deviceRecognitionVerdict":["'), F.when(F.col("event_id") % 3 == 2, "BASIC").otherwise("MEETS_DEVICE_INTEGRITY"), F.lit('"]}}'))
    attest = F.concat(F.lit('{"binding_digest":"'), binding, F.lit('","app_id_valid":true,"counter_valid":true,"signature_valid":'), F.when(F.col("event_id") % 3 == 0, "true").otherwise("false"), F.lit("}"))
    provider = F.when(F.col("event_id") % 2 == 0, "play_integrity").otherwise("app_attest")
    verdict = answers.integrity_verdict(provider, F.when(F.col("event_id") % 7 == 0, 503).otherwise(200), F.when(F.col("event_id") % 2 == 0, play).otherwise(attest), binding)
    return t.read("events").select("event_id", verdict["verdict"].alias("verdict"))


@query("f25_app_associations", """
SELECT 'a' || c_custkey AS app_id, '{"relation":["delegate_permission/common.handle_all_urls"],"target":{"namespace":"android_app","package_name":"p' || c_custkey || '","sha256_cert_fingerprints":["AA","BB"]}}' AS statement FROM customer WHERE c_custkey % 2 = 0""")
def _(t):
    rows = t.read("customer").select(F.concat(F.lit("a"), "c_custkey").alias("app_id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("p"), "c_custkey")).alias("android_package_name"), F.array(F.lit("BB"), F.lit("AA")).alias("android_sha256_fingerprints"))
    return links.asset_links(rows)


@query("f27_conversion_schemas", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"a":[2,1],"b":{"x":' || event_id || ',"y":null}}' END AS canonical FROM events""")
def _(t):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{ "b": {"y": null, "x": '), "event_id", F.lit('}, "a": [2, 1] }'))).otherwise("[1]")
    return t.read("events").select("event_id", answers.conversion_schema(text).alias("canonical"))


@query("p21_click_facts", "SELECT CAST(event_id AS VARCHAR) AS event_id, 'c' || user_id AS click_id, event_id % 3 = 0 AS bot_prefetch FROM events WHERE event_type = 'click'")
def _(t):
    payload = F.to_json(F.struct(F.concat(F.lit("c"), "user_id").alias("click_id"), (F.col("event_id") % 3 == 0).alias("bot_prefetch"), F.lit(1).alias("unlisted")))
    rows = t.read("events").select(*_scope(), F.col("event_id").cast("string").alias("event_id"), F.col("event_id").cast("string").alias("record_id"), F.col("event_type").alias("event_name"), F.lit(CUT).alias("occurred_at"), F.lit(CUT).alias("received_at"), payload.alias("payload"))
    return ingest.facts(rows, "click").select("event_id", "click_id", "bot_prefetch")


@query("j5_later_calendar_day", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(cents) AS VARCHAR) AS revenue FROM installs i JOIN revenue r ON r.user_id = i.user_id AND CAST(epoch_ms(installed_ms + 3 * 86400000) + INTERVAL 9 HOUR AS DATE) = CAST(epoch_ms(occurred_ms) + INTERVAL 9 HOUR AS DATE)", ("installs", "revenue"))
def _(t):
    rows = t.revenue().select("user_id", "occurred_ms", F.col("cents").cast("decimal(38,0)").alias("value"))
    per = metrics.calendar_revenue(t.installs(), rows.withColumn("one", F.lit(1)), ["user_id"], "Asia/Tokyo", ["user_id"], 3)
    n = metrics.calendar_revenue(t.installs(), rows.withColumn("value", F.lit(1).cast("decimal(38,0)")), ["user_id"], "Asia/Tokyo", ["user_id"], 3).agg(F.coalesce(F.sum("revenue"), F.lit(0)).cast("long").alias("n"))
    return per.agg(F.sum("revenue").cast("string").alias("revenue")).join(F.broadcast(n), F.lit(True))


@query("d1_key_order", "SELECT 'd' || o_orderkey AS delivery_id, CASE WHEN o_orderkey % 2 = 0 THEN 'duplicate_delivery' ELSE 'event_id_conflict' END AS resolution FROM orders")
def _(t):
    """The same payload with its keys in another order is a duplicate, another value a conflict."""
    base = attempts(t).limit(0)
    scope = {"tenant_id": F.lit("t"), "app_id": F.lit("a"), "record_tenant_id": F.lit("t"), "record_app_id": F.lit("a"), "producer": F.lit("sdk"), "event_id": F.col("o_orderkey").cast("string"), "occurred_at": F.lit(CUT), "schema_version": F.lit("1"), "event_name": F.lit("x"), "late": F.lit(False)}
    def sent(tag, payload, at):
        given = {**scope, "record_id": F.concat(F.lit(f"{tag}:"), "o_orderkey"), "delivery_id": F.concat(F.lit(tag), "o_orderkey"), "received_at": F.lit(at), "payload": payload}
        return t.read("orders").select(*[given.get(c, F.lit(None)).cast(k).alias(c) for c, k in base.dtypes])
    value = F.col("o_custkey").cast("string")
    one = sent("a", F.concat(F.lit('{"a":1,"b":'), value, F.lit("}")), "2024-01-15T00:00:01.000Z")
    two = sent("d", F.concat(F.lit('{ "b": '), value, F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("0"), F.lit(', "a": 1 }')), "2024-01-15T00:00:02.000Z")
    return ingest.decide(one.unionByName(two)).where("delivery_id like 'd%'").select("delivery_id", F.col("duplicate_resolution").alias("resolution"))


@query("f5_canonical_digests", """SELECT event_id, sha256('{"a":' || event_id || ',"b":"x"}') AS digest FROM events""")
def _(t):
    return t.read("events").select("event_id", F.sha2(canon.canonical_text(F.concat(F.lit('{"b": "x", "a": '), "event_id", F.lit("}"))), 256).alias("digest"))


UUID7 = "substr(lpad(format('{{:x}}', CAST({0} AS BIGINT)), 12, '0'), 1, 8) || '-' || substr(lpad(format('{{:x}}', CAST({0} AS BIGINT)), 12, '0'), 9, 4) || '-7' || substr(sha256({1}), 1, 3) || '-' || translate(substr(sha256({1}), 4, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(sha256({1}), 5, 3) || '-' || substr(sha256({1}), 8, 12)"


@query("f14_time_ordered_ids", f"SELECT event_id, {UUID7.format('ms', 'CAST(event_id AS VARCHAR)')} AS id FROM base", ("base",))
def _(t):
    return t.base().select("event_id", canon.uuid_v7(F.col("ms"), F.col("event_id").cast("string")).alias("id"))


BODY = """sent AS (SELECT o_orderkey, epoch_ms(o_orderdate) AS ms, count(l_orderkey) * 20 AS n, '{"events":[' || coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber), '') || ']}' AS body FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""


@query("s12_durable_batches", f"""
WITH {BODY} SELECT o_orderkey, sha256(body) AS body_digest, CASE WHEN n NOT BETWEEN 1 AND 100 THEN 'event_count_out_of_range' END AS error,
CASE WHEN n BETWEEN 1 AND 100 THEN 'pending' END AS status, CASE WHEN n BETWEEN 1 AND 100 THEN {UUID7.format('ms', "('t:a:' || o_orderkey || ':' || sha256(body))")} END AS ingest_batch_id FROM sent""")
def _(t):
    lines = t.read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.count("*") * 20).alias("event_count"), F.array_join(F.array_sort(F.collect_list("l_linenumber")).cast("array<string>"), ",").alias("numbers"))
    sent = t.read("orders").join(lines, "o_orderkey", "left").select("o_orderkey", *_scope(), F.col("o_orderkey").cast("string").alias("producer"), instants.canonical(F.col("o_orderdate").cast("timestamp")).alias("received_at"), F.coalesce("event_count", F.lit(0)).alias("event_count"), F.encode(F.concat(F.lit('{"events":['), F.coalesce("numbers", F.lit("")), F.lit("]}")), "UTF-8").alias("body"))
    return ingest.durable_batches(sent).select("o_orderkey", "body_digest", "error", "status", "ingest_batch_id")


NOW = 1_705_400_000_000


@query("r7_resolutions", f"""
SELECT 'fraud:' || {UUID7.format(NOW, "('q' || event_id)")} AS fraud_decision_id, CAST(event_id AS VARCHAR) AS subject_ref, 'clear' AS decision, 'allow' AS action, 'click_injection_suspected' AS reason_code, {ISO.format(NOW)} AS evaluated_at, 'q' || event_id AS supersedes_fraud_decision_id
FROM base WHERE event_type = 'click' AND ms + 72 * 3600000 <= {NOW}""", ("base",))
def _(t):
    decided = t.base().where("event_type = 'click'").select(*_scope(), F.concat(F.lit("q"), "event_id").alias("fraud_decision_id"), F.col("event_id").cast("string").alias("subject_ref"), F.lit("suspected").alias("decision"), F.lit("quarantine").alias("action"), F.lit("click_injection_suspected").alias("reason_code"), _at(F.col("ms")).alias("evaluated_at"), F.lit(None).cast("string").alias("supersedes_fraud_decision_id"), "ms")
    held = decided.select("tenant_id", "app_id", "fraud_decision_id", fraud.quarantine_until(F.col("ms")).alias("until_ms"))
    return fraud.resolutions(decided.drop("ms"), held, NOW).drop("tenant_id", "app_id")


@query("r8_registered_bundles", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'fraud_bundle_id_invalid' WHEN 2 THEN 'fraud_bundle_private_layer_must_be_digest_only' WHEN 3 THEN 'integrity_only_rule_forbidden:only-verdict-v1' WHEN 4 THEN 'fraud_bundle_rules_invalid' END AS error,
CASE WHEN o_orderkey % 5 = 0 THEN sha256('{"id":"b' || o_orderkey || '","layers":{"base":{"quarantine_hours":' || o_custkey || '},"private":{"digest":"' || sha256(CAST(o_custkey AS VARCHAR)) || '"}},"rules":[{"action":"flag","id":"ctit-lower-bound-v1","inputs":["ctit"]}],"version":"' || o_orderstatus || '"}') END AS bundle_hash,
CASE WHEN o_orderkey % 5 = 0 THEN sha256(CAST(o_custkey AS VARCHAR)) END AS private_layer_digest FROM orders""")
def _(t):
    kind, key = F.col("o_orderkey") % 5, F.col("o_orderkey").cast("string")
    private = F.when(kind == 2, F.lit('{"threshold":3}')).otherwise(F.concat(F.lit('{"digest": "'), F.sha2(F.col("o_custkey").cast("string"), 256), F.lit('"}')))
    rule = lambda name, inputs: F.lit(f'{{"id": "{name}", "inputs": ["{inputs}"], "action": "flag"}}')
    rules = F.concat(F.lit("["), F.when(kind == 3, rule("only-verdict-v1", "integrity_verdict")).when(kind == 4, "").otherwise(rule("ctit-lower-bound-v1", "ctit")), F.lit("]"))
    layers = F.concat(F.lit('{"private": '), private, F.lit(', "base": {"quarantine_hours": '), F.col("o_custkey").cast("string"), F.lit("}}"))
    revisions = t.read("orders").select("o_orderkey", F.concat(F.when(kind == 1, "b ").otherwise("b"), key).alias("id"), F.col("o_orderstatus").alias("version"), layers.alias("layers"), rules.alias("rules"))
    return fraud.registered(revisions).select("o_orderkey", "error", "bundle_hash", "private_layer_digest")


@query("m6_dashboard_series", """
WITH runs AS (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'skan_attributed_installs' ELSE c_mktsegment END AS metric_name, sha256(CAST(c_nationkey AS VARCHAR)) AS g, CASE WHEN min(c_acctbal) >= -900 THEN count(*) END AS v FROM customer GROUP BY c_mktsegment, c_nationkey)
SELECT metric_name, CASE WHEN metric_name = 'skan_attributed_installs' THEN 'aggregate' ELSE 'deterministic' END AS kind, string_agg(coalesce(CAST(v AS VARCHAR), '-'), ',' ORDER BY g) AS series, CAST(count(*) - count(v) AS BIGINT) AS undefined FROM runs GROUP BY metric_name""")
def _(t):
    name = F.when(F.col("c_mktsegment") == "BUILDING", "skan_attributed_installs").otherwise(F.col("c_mktsegment")).alias("metric_name")
    runs = t.read("customer").groupBy(name, "c_nationkey").agg(F.when(F.min("c_acctbal") >= -900, F.count("*")).alias("value_unscaled"))
    runs = runs.select("metric_name", F.sha2(F.col("c_nationkey").cast("string"), 256).alias("grouping_digest"), F.lit("run").alias("metric_run_id"), "value_unscaled", F.when(F.col("value_unscaled").isNull(), "undefined").otherwise("present").alias("value_state"))
    shown = F.transform("series", lambda v: F.coalesce(v.cast("long").cast("string"), F.lit("-")))
    return reporting.dashboard_series(runs).select("metric_name", "kind", F.array_join(shown, ",").alias("series"), "undefined")
