"""Queries of what flows in and out: streams drained in deliveries, files written and read again, imports of nested rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import canon, instants
from larkspur.operators import attribution, ingest, metrics, reconcile
from larkspur.operators.stored import folder
from larkspur.sources import connectors, files, mapping
from larkspur.streaming import ingestion, stateful

from .base import query
from .domain import _attributed, install_rows

DAY = 86_400_000
TIME = F.timestamp_millis


def halves(df: DataFrame, by: str) -> list[DataFrame]:
    """df as two deliveries, the first with the lower half of the range of a column."""
    middle = df.agg(F.expr(f"(min({by}) + max({by})) div 2")).first()[0] or 0
    return [df.where(F.col(by) <= middle), df.where(F.col(by) > middle)]


def streamed(t, rows: DataFrame, by: str, flow, name: str) -> DataFrame:
    return ingestion.drained(halves(rows, by), flow, folder(t.spark, name))


@query("z6_streamed_days", f"""
SELECT strftime(day, '%Y-%m-%d') AS metric_date, event_name, value FROM (SELECT CAST(epoch_ms(ms + 32400000) AS DATE) AS day, event_type AS event_name, CAST(count(*) AS BIGINT) AS value FROM base GROUP BY ALL)
WHERE epoch_ms(CAST(day AS TIMESTAMP)) + {DAY} - 32400000 <= (SELECT max(ms) FROM base) - {DAY}""", ("base",))
def _(t):
    """Events of each day in Tokyo, told once the watermark has passed the day's end."""
    rows = t.base().select("ms", TIME("ms").alias("ts"), F.col("event_type").alias("event_name"))
    told = streamed(t, rows, "ms", lambda read: ingestion.daily_counts(read(), "Asia/Tokyo"), "days")
    return told.select(F.col("metric_date").cast("string").alias("metric_date"), "event_name", "value")


@query("z13_streamed_quota", """
SELECT h * 3600000 AS hour_ms, key_id, n, n > 3 AS over FROM (SELECT ms // 3600000 AS h, event_type AS key_id, CAST(count(*) AS BIGINT) AS n FROM base GROUP BY ALL)
WHERE (h + 2) * 3600000 <= (SELECT max(ms) FROM base)""", ("base",))
def _(t):
    """Requests of each key and hour, and whether they are over a quota of three."""
    rows = t.base().select("ms", TIME("ms").alias("ts"), F.col("event_type").alias("key_id"))
    return streamed(t, rows, "ms", lambda read: ingestion.hourly_quota(read(), 3), "quota").select(F.unix_millis("hour").alias("hour_ms"), "key_id", "n", "over")


@query("z7_streamed_since_install", f"SELECT r.event_id, i.installed_ms FROM revenue r JOIN installs i ON i.user_id = r.user_id AND r.occurred_ms >= i.installed_ms AND r.occurred_ms < i.installed_ms + 7 * {DAY}", ("installs", "revenue"))
def _(t):
    """Purchases within seven days of their user's install, stream against stream."""
    installs = t.installs().select(F.lit("install").alias("kind"), F.lit(None).cast("long").alias("event_id"), F.col("user_id").alias("installation_id"), F.col("installed_ms").alias("ms"))
    rows = installs.unionByName(t.revenue().select(F.lit("purchase").alias("kind"), "event_id", F.col("user_id").alias("installation_id"), F.col("occurred_ms").alias("ms")))

    def flow(read):
        a = read().where("kind = 'install'").select("installation_id", TIME("ms").alias("installed_at"))
        b = read().where("kind = 'purchase'").select("event_id", "installation_id", TIME("ms").alias("occurred_at"))
        return ingestion.since_install(a, b, 7)

    return streamed(t, rows, "ms", flow, "since").select("event_id", F.unix_millis("installed_at").alias("installed_ms"))


@query("z10_streamed_withdrawals", """
SELECT CAST(event_id AS VARCHAR) AS record_id, max(CASE WHEN event_type = 'error' AND event_id % 3 <> 2 THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS withdrawn_at_sequence FROM base""", ("base",))
def _(t):
    """The last withdrawal of consent up to each record, remembered from one delivery to the next."""
    state = F.expr("case event_id % 3 when 0 then 'withdrawn' when 1 then 'denied' else 'granted' end")
    name = F.when(F.col("event_type") == "error", "consent_changed").otherwise(F.col("event_type"))
    rows = t.base().select(F.lit("t").alias("tenant_id"), F.col("user_id").cast("string").alias("installation_key_id"), F.col("event_id").cast("string").alias("record_id"), name.alias("event_name"), state.alias("consent_state"), F.col("event_id").alias("processing_sequence"))
    return streamed(t, rows, "processing_sequence", lambda read: ingestion.withdrawals(read()), "withdrawals").select("record_id", "withdrawn_at_sequence")


@query("z11_guarded_nonces", """
WITH r AS (SELECT event_id, event_type AS key_id, 'n' || user_id % 10 AS nonce, epoch_us(ts) // 1000 AS at_ms, CASE WHEN event_id % 19 = 0 THEN 'nonce_missing' WHEN event_id % 11 = 0 THEN 'timestamp_out_of_window' END AS refused FROM events),
uses AS (SELECT key_id, nonce, list([at_ms, event_id] ORDER BY at_ms, CAST(event_id AS VARCHAR)) AS l FROM r WHERE refused IS NULL GROUP BY ALL),
let AS (SELECT unnest(list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN x[1][1] - a[-1][1] >= 7200000 THEN list_concat(a, x) ELSE a END)) AS u FROM uses)
SELECT CAST(event_id AS VARCHAR) AS request_id, coalesce(refused, CASE WHEN event_id NOT IN (SELECT u[2] FROM let) THEN 'nonce_reused' END) AS reason FROM r""")
def _(t):
    """Requests refused for a nonce that its key used within two hours, over deliveries and a restart."""
    nonce = F.when(F.col("event_id") % 19 > 0, F.concat(F.lit("n"), F.col("user_id") % 10))
    sent = F.col("ms") - F.when(F.col("event_id") % 11 == 0, 300_001).otherwise(300_000)
    rows = t.base().select(F.col("event_id").cast("string").alias("request_id"), F.col("event_type").alias("key_id"), nonce.alias("nonce"), sent.alias("sent_ms"), F.col("ms").alias("at_ms"))
    return streamed(t, rows, "at_ms", lambda read: stateful.guarded_nonces(read(), 7_200_000), "nonces").select("request_id", "reason")


@query("z16_streamed_quarantines", f"""
WITH q AS (SELECT 'q' || event_id AS decision_id, ms, ms + event_id % 5 * {DAY} AS until_ms FROM (SELECT event_id, event_type, epoch_us(ts) // 1000 AS ms FROM events) WHERE event_type = 'signup')
SELECT decision_id, until_ms, 'quarantined' AS status FROM q UNION ALL SELECT decision_id, until_ms, 'released' FROM q WHERE until_ms < (SELECT max(ms) FROM q) - 60000""")
def _(t):
    """Decisions in quarantine, and their release by event time, also long after their delivery."""
    rows = t.base().where("event_type = 'signup'").select(F.concat(F.lit("q"), "event_id").alias("decision_id"), F.col("ms").alias("decided_ms"), (F.col("ms") + F.col("event_id") % 5 * DAY).alias("until_ms"))
    return streamed(t, rows, "decided_ms", lambda read: ingestion.quarantines(read()), "quarantines")


@query("z3_streamed_postbacks", "SELECT o_orderkey AS inbox_id, CASE WHEN o_orderkey % 3 = 0 THEN 'rejected' ELSE 'processed' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'revenue_invalid' END AS error, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey * 1000000000 + 500000000 AS VARCHAR) END AS amount_unscaled FROM orders")
def _(t):
    """An inbox of query strings, decoded as it lands."""
    line = F.concat(F.lit("user_id=u&revenue="), F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(F.concat("o_custkey", F.lit(".5"))), F.lit("&ts=1700000000"))
    rows = t.read("orders").select(F.col("o_orderkey").alias("inbox_id"), line.alias("query"))
    return streamed(t, rows, "inbox_id", lambda read: ingestion.drained_postbacks(read()), "inbox").select("inbox_id", "status", "error", "amount_unscaled")


@query("s15_stored_once", "SELECT event_id, event_type, CAST(1 AS BIGINT) AS copies FROM events")
def _(t):
    """Rows of two deliveries of which the second repeats part of the first, appended by a stream and again by one without its checkpoint."""
    rows = t.base().select("event_id", "event_type")
    home = folder(t.spark, "appended")
    parts = halves(rows, "event_id")
    for n, part in enumerate((parts[0], parts[1].unionByName(parts[0].where("event_id % 3 = 0")), None)):
        if part is not None:
            part.write.mode("append").parquet(f"{home}/landed")
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{home}/landed")
        ingestion.append_idempotent(stream, f"{home}/told", ["event_id"], f"{home}/state{n // 2}", against_stored=True).awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(f"{home}/told").groupBy("event_id", "event_type").agg(F.count("*").alias("copies"))


@query("s1_csv_again", r"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(lang, '') AS lang, sha256(coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' "a", b' WHEN 1 THEN chr(10) || 'c"' WHEN 2 THEN '  ' ELSE '' END) AS text_sha256 FROM documents""")
def _(t):
    """Whole texts with quotes, commas, line feeds and blanks, written as CSV files and read again in ranges of bytes."""
    tail = F.expr("case doc_id % 4 when 0 then ' \"a\", b' when 1 then concat(chr(10), 'c\"') when 2 then '  ' else '' end")
    path = folder(t.spark, "csv")
    files.write_csv(t.read("documents").select("doc_id", "lang", F.concat(F.coalesce("text", F.lit("")), tail).alias("text")), path)
    return files.read_csv(t.spark, path).select("doc_id", "lang", F.sha2("text", 256).alias("text_sha256"))


@query("s3_json_lines_again", "SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders")
def _(t):
    """Orders written as JSON Lines and read again under the import's limits."""
    path = folder(t.spark, "jsonl")
    files.write_json(t.read("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"), path)
    return files.read_rows(t.spark, path, "jsonl", "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double", max_bytes=1 << 50, max_rows=1 << 50)


def _grouped(t) -> DataFrame:
    """Customers in groups of a hundred keys, each with a JSON array of its rows."""
    row = F.struct("c_custkey", "c_name")
    return t.read("customer").groupBy(F.expr("c_custkey div 100").alias("g")).agg(F.to_json(F.sort_array(F.collect_list(row))).alias("value"))


@query("s2_json_arrays_again", "SELECT c_custkey, c_name FROM customer")
def _(t):
    """Files with one JSON array of a hundred customers each, read as rows."""
    path = folder(t.spark, "json")
    _grouped(t).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_json(t.spark, path, "c_custkey long, c_name string")


@query("s5_new_contents", """
SELECT sha256('[' || string_agg('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}', ',' ORDER BY c_custkey) || ']' || chr(10)) AS digest FROM customer GROUP BY c_custkey // 100 HAVING c_custkey // 100 % 3 <> 0""")
def _(t):
    """Files whose content no earlier import had; every third group was imported, and all files are there twice."""
    path, groups = folder(t.spark, "contents"), _grouped(t)
    for copy in ("a", "b"):
        groups.select("value").write.option("maxRecordsPerFile", 1).text(f"{path}/{copy}")
    manifest = groups.where("g % 3 = 0").select(F.sha2(F.concat("value", F.lit("\n")), 256).alias("digest"))
    return files.new_files(files.content_digests(t.spark, f"{path}/*"), manifest).select("digest")


@query("s8_revenue_backfill", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'n' ELSE 'own' END AS network, CASE WHEN o_orderkey % 3 = 0 THEN 'aggregate' ELSE 'u' || o_custkey END AS campaign_id, CASE WHEN o_orderkey % 5 > 0 THEN 'JP' END AS country, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderkey || '125000' AS amount_unscaled, 'USD' AS currency FROM orders WHERE o_orderkey > 0")
def _(t):
    rows = t.read("orders").where("o_orderkey > 0").select(F.expr("case when o_orderkey % 2 = 1 then 'own' end").alias("network"), F.expr("case when o_orderkey % 3 > 0 then concat('u', o_custkey) end").alias("ad_unit_id"), F.expr("case when o_orderkey % 5 > 0 then 'jp' else '' end").alias("country"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.concat("o_orderkey", F.lit(".125")).alias("estimated_revenue"))
    return connectors.revenue_backfill({"tenant_id": "t", "app_id": "a", "currency": "jpy", "as_of": "x"}, rows, "n").select("network", "campaign_id", "country", "date", "amount_unscaled", "currency")


NESTED = {
    "source_id": "orders", "provider": "p", "kind": "mmp_raw",
    "row_filter": [{"source": "order.detail.status", "equals": "O"}],
    "rules": [
        {"target": "event_name", "expression": {"source": "order.detail.status", "const": "purchase"}},
        {"target": "event_id", "expression": {"source": "order.key", "prefix": "o-"}},
        {"target": "occurred_at", "expression": {"source": "at", "timestamp": {"default_timezone": "UTC"}}},
        {"target": "payload.tier", "expression": {"source": "order.detail.tier", "uppercase": True}},
        {"target": "payload.note", "expression": {"source": "order.note", "omit_if_empty": True}},
        {"target": "payload.deep", "expression": {"source": "at.deeper", "default": "none"}},
        {"target": "payload.tag", "expression": {"source": "tags.a.b", "omit_if_empty": True}},
    ],
}


@query("p15_import_attempts", r"""
WITH rows AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') AS occurred, '{"tier":"T' || o_custkey || '"' || CASE WHEN o_orderkey % 2 = 0 THEN ',"note":"n"' ELSE '' END || ',"deep":"none"' || CASE WHEN o_orderkey % 3 = 0 THEN ',"tag":"' || o_custkey || '"' ELSE '' END || '}' AS payload FROM orders WHERE o_orderstatus = 'O')
SELECT 'record:' || substr(sha256('{"event_id":"o-' || o_orderkey || '","event_name":"purchase","payload":' || CAST(to_json(payload) AS VARCHAR) || ',"source_id":"orders"}'), 1, 48) AS record_id,
  'delivery:' || substr(sha256('{"event_id":"o-' || o_orderkey || '","event_name":"purchase","occurred_at":"' || occurred || '","payload":' || CAST(to_json(payload) AS VARCHAR) || ',"source_id":"orders"}'), 1, 48) AS delivery_id, 'import:orders' AS producer, payload FROM rows""")
def _(t):
    """Nested rows and maps by dotted paths (below a text there is nothing), as attempts whose ids are digests."""
    detail = F.struct(F.col("o_orderstatus").alias("status"), F.concat(F.lit("t"), "o_custkey").alias("tier"))
    order = F.struct(F.col("o_orderkey").alias("key"), F.expr("case when o_orderkey % 2 = 0 then 'n' else '' end").alias("note"), detail.alias("detail"))
    tags = F.create_map(F.when(F.col("o_orderkey") % 3 == 0, "a.b").otherwise("a"), F.col("o_custkey").cast("string"))
    rows = t.read("orders").select(order.alias("order"), tags.alias("tags"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))
    good, _ = mapping.split(mapping.apply(NESTED, rows))
    return mapping.attempts(good, "orders").select("record_id", "delivery_id", "producer", "payload")


# What each event's facts are of the payloads below; {e}, {u} and {c} stand for the event, its user and its cents.
PROJECTED = {
    "install": '"installation_id":"u{u}","install_type":"first","click_id":"c{e}"',
    "session_start": '"installation_id":"u{u}","session_id":"s{e}"',
    "ad_revenue": '"installation_id":"u{u}","money":{{"amount_unscaled":"{c}","amount_scale":2,"currency":"USD"}}',
    "purchase": '"transaction_id":"x{e}","money":{{"amount_unscaled":"{c}","amount_scale":2,"currency":"JPY"}}',
    "custom_event": '"installation_id":"u{u}","event_key":"k","attributes":{{"k":"{c}"}}',
    "skan_postback": '"signature_verified":true,"did_win":false,"conversion_value":{u}',
    "deep_link_open": '"installation_id":"u{u}","link_slug":"l{e}"',
}


def _text(template: str, before: str = "") -> str:
    return "'{" + before + template.format(e="' || event_id || '", u="' || user_id || '", c="' || cents || '") + "}'"


@query("p21_projected_facts", "SELECT event_id, CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(PROJECTED)) + " END AS event_name, CASE event_id % 7 " + " ".join(f"WHEN {i} THEN {_text(x)}" for i, x in enumerate(PROJECTED.values())) + " END AS facts FROM base", ("base",))
def _(t):
    """The facts of seven kinds of events, of payloads with more keys than a projection reads."""
    pick = lambda texts: F.expr("case event_id % 7 " + " ".join(f"when {i} then {x}" for i, x in enumerate(texts)) + " end")
    events = t.base().select(F.lit("t").alias("tenant_id"), F.lit("a").alias("app_id"), F.lit("r").alias("record_id"), "event_id", F.lit("o").alias("occurred_at"), F.lit("o").alias("received_at"), pick([f"'{k}'" for k in PROJECTED]).alias("event_name"), pick([_text(x, '"extra":[{"money":1}],') for x in PROJECTED.values()]).alias("payload"))

    def told(kind: str) -> DataFrame:
        facts = ingest.facts(events, kind)
        return facts.select("event_id", F.lit(kind).alias("event_name"), F.to_json(F.struct(*facts.columns[6:])).alias("facts"))

    return reduce(DataFrame.unionByName, map(told, PROJECTED))


@query("d8_clock_skew", "SELECT event_id, event_id % 13 * 60000 > 300000 AS skewed FROM events")
def _(t):
    return t.base().select("event_id", instants.skewed(F.col("ms") + F.col("event_id") % 13 * 60_000, F.col("ms")).alias("skewed"))


@query("j3_imported_clicks", _attributed("SELECT 'attr:install:' || event_id AS attribution_id, CASE WHEN event_id % 3 = 0 THEN 'provider_modeled_conversion' ELSE 'provider_attributed' END AS reason_code, CASE WHEN n = 1 THEN 'click:' || one || '|' ELSE '' END || 'install:' || event_id AS refs FROM joined"))
def _(t):
    """Imported installs whose provider names a click by its remote reference; a reference of several clicks names none."""
    install, click = install_rows(t)
    ref = F.concat(F.lit("r"), F.substring("click_id", 2, 40))
    install = install.withColumns({"producer": F.lit("import:p"), "has_import_context": F.lit(True), "provider_attributed": F.lit(True), "provider_confirmed_at": F.col("received_at"), "provider_attribution_strategy": F.when(F.substring_index("record_id", ":", -1).cast("long") % 3 == 0, "modeled"), "provider_click_ref": ref})
    decided = attribution.installs(install, click.withColumn("remote_click_ref", ref))
    return decided.select("attribution_id", "reason_code", F.array_join("evidence_refs", "|").alias("refs"))


@query("t3_lookup_outcomes", """
WITH o AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'adservices_attributed' WHEN 1 THEN 'adservices_token_expired' WHEN 2 THEN 'adservices_not_attributed' WHEN 3 THEN 'adservices_lookup_unavailable' ELSE 'platform_referrer_not_available' END AS reason_code FROM events WHERE event_type = 'signup')
SELECT 'attr:install:' || event_id AS attribution_id, CASE WHEN event_id % 5 = 0 THEN 'non_organic' ELSE 'unattributed' END AS status, CASE WHEN event_id % 5 < 4 THEN 'apple_adservices' ELSE 'none' END AS method, reason_code, 'install:' || event_id AS refs FROM o""")
def _(t):
    """Every outcome of a token's lookup, and installs that have none."""
    install, click = install_rows(t)
    told = F.expr("case cast(substring_index(record_id, ':', -1) as long) % 5 when 0 then 'attributed' when 1 then 'token_expired' when 2 then 'not_attributed' when 3 then 'lookup_unavailable' end")
    install = install.withColumns({"producer": F.lit("sdk"), "encrypted_referrer_status": F.lit(None).cast("string"), "referrer_status": F.lit("not_applicable"), "adservices_status": told})
    return attribution.installs(install, click).select("attribution_id", "status", "method", "reason_code", F.array_join("evidence_refs", "|").alias("refs"))


@query("a20_ledger_positions", "SELECT user_id, max(strftime(epoch_ms(ms), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') || 'Z:' || event_id) AS ledger_position FROM base GROUP BY user_id", ("base",))
def _(t):
    rows = t.base().select("user_id", instants.canonical(TIME("ms")).alias("received_at"), F.col("event_id").cast("string").alias("record_id"), F.lit("available").alias("lifecycle_status"), F.lit("p").alias("policy_digest"))
    return metrics.snapshot(rows, ["user_id"]).select("user_id", "ledger_position")


@query("c1_imported_inputs", """
SELECT 'reconciliation:' || event_id AS reconciliation_id, concat_ws('|', CASE WHEN event_id % 3 > 0 THEN 'provider_click_id=p' || user_id END, CASE WHEN event_id % 5 > 0 THEN 'provider_install_id=i' || event_id END) AS keys, event_id % 7 = 0 AS modeled FROM base WHERE event_type = 'signup' AND event_id % 2 = 0""", ("base",))
def _(t):
    rows = t.base().where("event_type = 'signup'").select(F.lit("t").alias("tenant_id"), F.lit("a").alias("app_id"), F.col("event_id").cast("string").alias("record_id"), F.expr("case when event_id % 2 = 0 then 'import:p' else 'sdk' end").alias("producer"), F.expr("case when event_id % 3 > 0 then concat('p', user_id) end").alias("provider_click_ref"), F.expr("case when event_id % 5 > 0 then concat('i', event_id) end").alias("provider_install_ref"), F.expr("case when event_id % 7 = 0 then 'modeled' when event_id % 7 = 1 then 'organic' end").alias("provider_attribution_strategy"))
    made = reconcile.imported_inputs(rows)
    return made.select("reconciliation_id", F.array_join(F.transform("matching_keys", lambda k: F.concat(k["type"], F.lit("="), k["value"])), "|").alias("keys"), F.col("provider_modeled_without_candidate").alias("modeled"))


@query("w4_utf16_keys", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'D83DDE00' WHEN 1 THEN 'E000' ELSE '0061' END || regexp_replace(hex(c_name), '(..)', '00\\1', 'g') AS sort_key FROM customer")
def _(t):
    """Sort keys under which astral letters come before the private ones, as in UTF-16."""
    lead = F.expr("case c_custkey % 3 when 0 then '\U0001f600' when 1 then '' else 'a' end")
    return t.read("customer").select("c_custkey", F.hex(canon.utf16_key(F.concat(lead, "c_name"))).alias("sort_key"))
