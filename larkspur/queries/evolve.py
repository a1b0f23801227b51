"""Queries of what ledgers become: deletions executed, metrics computed again, snapshots published, decisions of a stream."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import schemas, text
from larkspur.operators import attribution, deletion, ingest, metrics, pages, publication, recalculate, reconcile
from larkspur.operators.metrics import Definition
from larkspur.operators.stored import checkpointed, folder
from larkspur.sources import connectors, files
from larkspur.streaming import stateful

from .base import CTES, query
from .domain import _sent, attempts

# One record an event, in three tenants of two apps; some users ask for deletion, as do an app and a tenant.
LEDGER = f"""
base AS ({CTES['base']}),
led AS (SELECT *, 't' || user_id % 3 AS tenant_id, 'a' || user_id % 2 AS app_id, CAST(event_id AS VARCHAR) AS record_id, CAST(user_id AS VARCHAR) AS installation_id FROM base),
req AS (
  SELECT DISTINCT 'q:' || user_id AS privacy_request_id, tenant_id, app_id, 'installation' AS deletion_scope, installation_id, '2024-03-0' || (user_id % 9 + 1) AS completed_at FROM led WHERE event_type = 'signup' AND user_id % 5 = 0
  UNION ALL SELECT 'q:app', 't1', 'a1', 'app', NULL, '2024-03-05' UNION ALL SELECT 'q:tenant', 't2', 'a0', 'tenant', NULL, '2024-03-04'),
reached AS (
  SELECT l.tenant_id, l.app_id, q.privacy_request_id, q.deletion_scope, q.completed_at, l.record_id FROM led l JOIN req q ON q.tenant_id = l.tenant_id AND CASE q.deletion_scope
    WHEN 'installation' THEN q.app_id = l.app_id AND q.installation_id = l.installation_id AND l.event_type <> 'error' WHEN 'app' THEN q.app_id = l.app_id ELSE true END)
"""


def ledger(t) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    return t.base().select("*", F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenant_id"), F.concat(F.lit("a"), F.col("user_id") % 2).alias("app_id"), text("event_id").alias("record_id"), text("user_id").alias("installation_id"))


def asked(t) -> DataFrame:
    users = ledger(t).where("event_type = 'signup' and user_id % 5 = 0").select(F.concat(F.lit("q:"), "user_id").alias("privacy_request_id"), "tenant_id", "app_id", F.lit("installation").alias("deletion_scope"), "installation_id", F.concat(F.lit("2024-03-0"), F.col("user_id") % 9 + 1).alias("completed_at")).distinct()
    wide = t.spark.createDataFrame([("q:app", "t1", "a1", "app", None, "2024-03-05"), ("q:tenant", "t2", "a0", "tenant", None, "2024-03-04")], users.schema)
    return users.unionByName(wide)


def execution(t) -> dict[str, DataFrame]:
    e = ledger(t)
    facts = [e.where(F.col("event_type") == kind) for kind in ("click", "signup", "view", "purchase")]
    ref = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("plain:"), "event_id")).otherwise(F.concat(F.lit("encrypted:"), F.expr("event_id div 2")))
    batch = F.expr("cast(event_id div 4 as string)")
    batches = e.groupBy("tenant_id", "app_id", batch.alias("ingest_batch_id")).agg(F.concat_ws(":", F.lit("body"), F.first("tenant_id"), F.first("app_id"), F.first(batch)).alias("body_ref"), F.lit(None).cast("string").alias("installation_id"))
    scope = ["tenant_id", "app_id", "record_id"]
    inbox = e.where("event_type = 'purchase'").select(*scope, F.concat(F.lit("query:"), "event_id").alias("ref"))
    answers = e.where("event_type = 'signup'").select(*scope, F.concat(F.lit("answer:"), "event_id").alias("ref"))
    return deletion.execute(asked(t), facts, e.withColumn("raw_payload_ref", ref), inbox, batches, e.select(*scope, batch.alias("ingest_batch_id")), answers)


@query("v4_deletion_states", f"WITH {LEDGER}, f AS (SELECT record_id, arg_min(privacy_request_id, completed_at || privacy_request_id) AS q, min(completed_at) AS changed_at FROM reached GROUP BY record_id) SELECT record_id, 'purged' AS lifecycle_status, changed_at, 'tombstone:' || q || ':' || record_id AS privacy_tombstone_id FROM f")
def _(t):
    return execution(t)["states"].select("record_id", "lifecycle_status", "changed_at", "privacy_tombstone_id")


@query("v4_tombstones_and_corrections", f"""WITH {LEDGER} SELECT tenant_id, app_id, privacy_request_id, record_id, sha256('["' || privacy_request_id || '","' || record_id || '","' || completed_at || '"]') AS provenance_digest,
  'correction:' || substr(sha256('["' || privacy_request_id || '","' || record_id || '"]'), 1, 48) AS correction_id FROM reached""")
def _(t):
    done = execution(t)
    corrections = done["corrections"].select("correction_id", F.col("corrects_record_id").alias("record_id"))
    told = done["tombstones"].withColumn("correction_id", F.concat(F.lit("correction:"), F.substring(F.sha2(F.to_json(F.array("privacy_request_id", "record_id")), 256), 1, 48)))
    return told.join(corrections, ["correction_id", "record_id"]).select("tenant_id", "app_id", "privacy_request_id", "record_id", "provenance_digest", "correction_id")


PURGED = f"""{LEDGER},
raw AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN 'plain:' || event_id ELSE 'encrypted:' || event_id // 2 END AS ref, event_id // 4 AS batch FROM led),
own AS (SELECT r.*, q.privacy_request_id AS q, q.deletion_scope AS kind FROM raw r JOIN reached q ON q.record_id = r.record_id AND q.tenant_id = r.tenant_id),
purged AS (
  SELECT DISTINCT q AS privacy_request_id, ref FROM own o WHERE ref LIKE 'encrypted:%' AND (kind <> 'installation' OR NOT EXISTS (SELECT 1 FROM raw s WHERE s.tenant_id = o.tenant_id AND s.ref = o.ref AND s.event_id NOT IN (SELECT event_id FROM own z WHERE z.q = o.q)))
  UNION SELECT q, 'query:' || event_id FROM own WHERE event_type = 'purchase' UNION SELECT q, 'answer:' || event_id FROM own WHERE event_type = 'signup'
  UNION SELECT q, 'body:' || tenant_id || ':' || app_id || ':' || batch FROM own o WHERE kind <> 'installation' OR NOT EXISTS (SELECT 1 FROM raw s WHERE s.tenant_id = o.tenant_id AND s.app_id = o.app_id AND s.batch = o.batch AND s.event_id NOT IN (SELECT event_id FROM own z WHERE z.q = o.q)))
"""


@query("v4_purges", f"WITH {PURGED} SELECT privacy_request_id, ref FROM purged")
def _(t):
    return execution(t)["purges"].select("privacy_request_id", "ref")


@query("v4_second_execution", f"WITH {PURGED} SELECT ledger, CAST(CASE ledger WHEN 'states' THEN (SELECT count(DISTINCT record_id) FROM reached) WHEN 'purges' THEN (SELECT count(*) FROM purged) WHEN 'audit' THEN (SELECT count(*) FROM req) ELSE (SELECT count(*) FROM reached) END AS BIGINT) AS first, CAST(0 AS BIGINT) AS second FROM (VALUES ('states'), ('tombstones'), ('corrections'), ('purges'), ('audit')) AS x(ledger)")
def _(t):
    """Rows that a first execution appends to each ledger, and a second one to what the first has stored."""
    home, after = folder(t.spark, "ledgers"), []
    for _ in range(2):
        deletion.append(execution(t), home)
        stored = [t.spark.read.parquet(f"{home}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("ledger"), "n") for name in deletion.KEYS]
        after.append(checkpointed(reduce(DataFrame.unionByName, stored)))
    first, both = after[0].withColumnRenamed("n", "first"), after[1].withColumnRenamed("n", "both")
    return first.join(both, "ledger").select("ledger", "first", (F.col("both") - F.col("first")).alias("second"))


# Metrics of cohorts by campaign, of an input before and after a deletion, and with late rows.
DEFINITIONS = [
    Definition("cohort_install_count", "cohort_size", grouping=("campaign_id",)),
    Definition("d7_revenue", "revenue_sum", 7, grouping=("campaign_id", "cohort_date")),
    Definition("cohort_ltv_d7_usd", "revenue_over_cohort", 7, grouping=("campaign_id",)),
    Definition("retention_d1", "active_installations_over_cohort", 1, grouping=("campaign_id", "cohort_date")),
    Definition("daily_clicks", "event_count", event_names=("click",), grouping=("metric_date",)),
]
CUT = "2024-01-20"
DELETED = "event_id % 11 = 0 OR user_id % 13 = 0"
LATE = "event_id % 17 = 0"


def inputs(t) -> recalculate.Inputs:
    """The inputs of the definitions: a user's first signup is the install, purchases are revenue, views are sessions."""
    e = ledger(t).withColumn("received_at", F.when(F.expr(LATE), "2024-12-01").otherwise("2024-01-01"))
    day = F.to_date(F.timestamp_millis("ms")).cast("string")
    own = [c for c in e.columns if c not in ("user_id", "ms", "event_id")]
    first = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min(F.struct("ms", "event_id", *own)).alias("f")).select("user_id", "f.*")
    installs = first.join(t.people().select("user_id", "campaign_id"), "user_id", "left")
    # All definitions read the installs, before and after: they are made once.
    installs = checkpointed(installs.select("tenant_id", "app_id", "installation_id", F.col("ms").alias("installed_ms"), F.coalesce("campaign_id", F.lit("none")).alias("campaign_id"), day.alias("cohort_date"), "record_id", "received_at"))
    own = ["tenant_id", "app_id", "installation_id", F.col("ms").alias("occurred_ms"), "record_id", "received_at"]
    costs = e.where("false").select("tenant_id", "app_id", F.lit("none").alias("campaign_id"), F.lit(0).cast("long").alias("cost"), "record_id", "received_at")
    return recalculate.Inputs(installs, e.where("event_type = 'purchase'").select(*own, F.col("cents").cast("decimal(38,0)").alias("value")), e.where("event_type = 'view'").select(*own), e.select(*own, F.col("event_type").alias("event_name")), costs)


def metric_sql(keep: str) -> str:
    """(metric_name, tenant_id, app_id, g1, g2, value) of the definitions, over events that satisfy keep."""
    return f"""
firsts AS (SELECT arg_min(event_id, (ms, event_id)) AS event_id FROM led WHERE event_type = 'signup' GROUP BY user_id),
ins AS (SELECT l.*, coalesce(p.campaign_id, 'none') AS campaign_id, CAST(CAST(l.ts AS DATE) AS VARCHAR) AS cohort_date FROM led l LEFT JOIN people p ON p.user_id = l.user_id WHERE l.event_id IN (SELECT event_id FROM firsts)),
kept AS (SELECT * FROM led WHERE {keep}), kins AS (SELECT * FROM ins WHERE {keep}),
rev AS (SELECT i.user_id, sum(k.cents) AS cents FROM kins i JOIN kept k ON k.user_id = i.user_id AND k.event_type = 'purchase' AND k.ms >= i.ms AND k.ms < i.ms + 8 * 86400000 GROUP BY i.user_id),
act AS (SELECT DISTINCT i.user_id FROM kins i JOIN kept k ON k.user_id = i.user_id AND k.event_type = 'view' AND k.ms >= i.ms + 86400000 AND k.ms < i.ms + 2 * 86400000),
per AS (SELECT i.*, coalesce(r.cents, 0) AS cents_7, CASE WHEN a.user_id IS NULL THEN 0 ELSE 1 END AS active FROM kins i LEFT JOIN rev r ON r.user_id = i.user_id LEFT JOIN act a ON a.user_id = i.user_id),
calc AS (
  SELECT 'cohort_install_count' AS metric_name, tenant_id, app_id, campaign_id AS g1, NULL AS g2, CAST(count(*) AS HUGEINT) AS value FROM per GROUP BY ALL
  UNION ALL SELECT 'd7_revenue', tenant_id, app_id, campaign_id, cohort_date, sum(cents_7) FROM per GROUP BY ALL
  UNION ALL SELECT 'cohort_ltv_d7_usd', tenant_id, app_id, campaign_id, NULL, {_ratio('sum(cents_7)', 'count(*)')} FROM per GROUP BY ALL
  UNION ALL SELECT 'retention_d1', tenant_id, app_id, campaign_id, cohort_date, {_ratio('sum(active)', 'count(*)')} FROM per GROUP BY ALL
  UNION ALL SELECT 'daily_clicks', tenant_id, app_id, CAST(CAST(ts AS DATE) AS VARCHAR), NULL, count(*) FROM kept WHERE event_type = 'click' GROUP BY ALL)
"""


def _ratio(n: str, d: str) -> str:
    from .base import half_even_sql

    return half_even_sql(f"(CAST({n} AS HUGEINT) * 1000000)", d)


def touched_sql(hit: str) -> str:
    """(metric_name, tenant_id, app_id, g1, g2) of the groups that events which satisfy hit have a part in."""
    own = f"SELECT {{0}}, tenant_id, app_id, {{1}} FROM ins i WHERE ({hit})"
    facts = f"SELECT {{0}}, i.tenant_id, i.app_id, {{1}} FROM ins i WHERE EXISTS (SELECT 1 FROM led l WHERE l.user_id = i.user_id AND l.event_type = '{{2}}' AND ({hit.replace('event_id', 'l.event_id').replace('user_id', 'l.user_id')}))"
    one, two = "campaign_id AS g1, NULL AS g2", "campaign_id AS g1, cohort_date AS g2"
    parts = [own.format("'cohort_install_count' AS metric_name", one)]
    for name, cols, kind in (("d7_revenue", two, "purchase"), ("cohort_ltv_d7_usd", one, "purchase"), ("retention_d1", two, "view")):
        parts += [own.format(f"'{name}'", cols), facts.format(f"'{name}'", cols, kind)]
    parts.append(f"SELECT 'daily_clicks', tenant_id, app_id, CAST(CAST(ts AS DATE) AS VARCHAR), NULL FROM led WHERE event_type = 'click' AND ({hit})")
    return "touched AS (" + " UNION ".join(parts) + ")"


def _again_sql(keep: str, hit: str) -> str:
    return f"""WITH {LEDGER}, people AS ({CTES['people']}), {metric_sql(keep)}, {touched_sql(hit)}
SELECT t.metric_name, t.tenant_id, t.app_id, t.g1, t.g2, CAST(c.value AS VARCHAR) AS value, CASE WHEN c.value IS NULL THEN 'undefined' ELSE 'present' END AS value_state
FROM touched t LEFT JOIN calc c ON c.metric_name = t.metric_name AND c.tenant_id = t.tenant_id AND c.app_id = t.app_id AND c.g1 = t.g1 AND c.g2 IS NOT DISTINCT FROM t.g2"""


def shown(runs: DataFrame) -> DataFrame:
    g = lambda name: F.get_json_object("grouping", f"$.{name}")
    return runs.select("metric_name", "tenant_id", "app_id", F.coalesce(g("campaign_id"), g("metric_date")).alias("g1"), g("cohort_date").alias("g2"), F.col("value").cast("string").alias("value"), "value_state")


@query("v5_superseding_runs", _again_sql(f"NOT ({DELETED})", DELETED))
def _(t):
    """Runs of the groups that a deletion touches, computed again without the deleted records."""
    before = inputs(t)
    gone = ledger(t).where(DELETED).select("record_id")
    runs = checkpointed(recalculate.first_runs(DEFINITIONS, before, "metric", "2024-02-01T00:00:00.000Z"))
    return shown(recalculate.superseding(runs, before, before.without(gone), gone, "privacy-reapply", "2024-03-01T00:00:00.000Z"))


@query("z5_late_runs", _again_sql("true", LATE))
def _(t):
    """Runs of the groups that rows after the watermark belong to, over all rows."""
    every = inputs(t)
    before = every.until(CUT)
    runs = checkpointed(recalculate.first_runs(DEFINITIONS, before, "metric", "2024-02-01T00:00:00.000Z"))
    return shown(recalculate.superseding(runs, before, every, every.received_after(CUT), "late", "2024-03-01T00:00:00.000Z", "reproducible"))


@query("v5_standing_values", f"""WITH {LEDGER}, people AS ({CTES['people']}), {metric_sql(f'NOT ({DELETED})')}
SELECT metric_name, tenant_id, app_id, g1, g2, CAST(value AS VARCHAR) AS value, 'present' AS value_state FROM calc""")
def _(t):
    """The values that stand after a recalculation: those of a full computation over what is left."""
    from larkspur.operators.ledger import not_superseded

    before = inputs(t)
    gone = ledger(t).where(DELETED).select("record_id")
    runs = checkpointed(recalculate.first_runs(DEFINITIONS, before, "metric", "2024-02-01T00:00:00.000Z"))
    new = checkpointed(recalculate.superseding(runs, before, before.without(gone), gone, "privacy-reapply", "2024-03-01T00:00:00.000Z"))
    return shown(not_superseded(runs.unionByName(new), "metric_run_id", "supersedes_metric_run_id")).where("value_state = 'present'")


ASKED = ("cohort_install_count", "d7_revenue", "cohort_ltv_d7_usd", "retention_d1")


@query("m4_definition_file_runs", f"""WITH {LEDGER}, people AS ({CTES['people']}), {metric_sql(f'NOT ({LATE})')},
names AS (SELECT DISTINCT c_mktsegment AS campaign_id FROM customer),
one AS (SELECT campaign_id, count(*) AS n, sum(cents_7) AS cents, sum(active) AS act FROM per WHERE tenant_id = 't0' AND app_id = 'a0' AND cohort_date = '2024-01-03' GROUP BY campaign_id),
told AS (
  SELECT campaign_id, 'cohort_install_count' AS metric_name, CAST(n AS HUGEINT) AS value FROM names LEFT JOIN one USING (campaign_id) UNION ALL SELECT campaign_id, 'd7_revenue', cents FROM names LEFT JOIN one USING (campaign_id)
  UNION ALL SELECT campaign_id, 'cohort_ltv_d7_usd', {_ratio('cents', 'n')} FROM names LEFT JOIN one USING (campaign_id) UNION ALL SELECT campaign_id, 'retention_d1', {_ratio('act', 'n')} FROM names LEFT JOIN one USING (campaign_id))
SELECT metric_name, campaign_id, CAST(value AS VARCHAR) AS value, CASE WHEN value IS NULL THEN 'undefined' ELSE 'present' END AS value_state, CASE WHEN value IS NULL THEN 'empty_cohort' END AS undefined_reason, '2024-01-03T23:59:59.999Z' AS computed_at FROM told""")
def _(t):
    """Runs of a definitions file of one day, with an evaluation for each campaign, written and read like any file."""
    campaigns = [r[0] for r in t.read("customer").select("c_mktsegment").distinct().orderBy("c_mktsegment").limit(1000).collect()]
    asked = {"tenant_id": "t0", "app_id": "a0", "fx_policy": {"target_currency": "USD"}, "evaluations": [{"metric_names": list(ASKED), "grouping": {"campaign_id": c}} for c in campaigns]}
    path = folder(t.spark, "definitions")
    t.spark.createDataFrame([(json.dumps(asked),)], "value string").coalesce(1).write.text(path)
    file = metrics.definition_file(t.spark, path, "2024-01-03")
    runs = recalculate.file_runs(file, DEFINITIONS, inputs(t))
    return runs.select("metric_name", F.get_json_object("grouping", "$.campaign_id").alias("campaign_id"), F.col("value").cast("string").alias("value"), "value_state", "undefined_reason", "computed_at")


SNAPSHOTS = """
days AS (SELECT 't' || user_id % 3 AS tenant_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS clicks, sum(cents) AS cents FROM base WHERE event_type = 'click' {0} GROUP BY ALL),
keyed AS (SELECT *, sha256('{{"cents":' || cents || ',"clicks":' || clicks || ',"day":"' || day || '","tenant_id":"' || tenant_id || '"}}') AS input_snapshot_id FROM days)
"""


@query("r6_published_snapshots", f"""WITH base AS ({CTES['base']}), {SNAPSHOTS.format("AND event_id % 200 <> 0").replace('days AS', 'days1 AS').replace('FROM days)', 'FROM days1)').replace('keyed AS', 'old AS')}, {SNAPSHOTS.format('')}
SELECT tenant_id, day, CAST(clicks AS BIGINT) AS clicks, input_snapshot_id FROM keyed WHERE input_snapshot_id NOT IN (SELECT input_snapshot_id FROM old)""")
def _(t):
    """What a day job publishes when late clicks came after its first run: the groups that changed, under new keys."""
    def days(rows):
        return rows.groupBy(F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenant_id"), F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("clicks"), F.sum("cents").alias("cents"))

    clicks, keys = t.base().where("event_type = 'click'"), ["tenant_id", "day"]
    first = days(clicks.where("event_id % 200 <> 0"))
    stored = publication.publish(first, first.withColumn("input_snapshot_id", F.lit("")).where("false"), keys)
    return publication.publish(days(clicks), stored, keys).select("tenant_id", "day", "clicks", "input_snapshot_id")


@query("a11_exact_quantiles", "SELECT l_returnflag AS flag, l_linenumber AS line, CAST(count(*) AS BIGINT) AS n, CAST(round_even(quantile_cont(CAST(round(l_extendedprice * 100) AS BIGINT), 0.05), 0) AS BIGINT) AS p05, CAST(round_even(quantile_cont(CAST(round(l_extendedprice * 100) AS BIGINT), 0.5), 0) AS BIGINT) AS p50, CAST(round_even(quantile_cont(CAST(round(l_extendedprice * 100) AS BIGINT), 0.95), 0) AS BIGINT) AS p95 FROM lineitem GROUP BY ALL")
def _(t):
    rows = t.read("lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("v"))
    found = publication.quantiles(rows, ["flag", "line"], "v", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return found.select("flag", "line", "n", *[F.bround(c).cast("long").alias(c) for c in ("p05", "p50", "p95")])


@query("z2_stream_decisions", _sent("SELECT delivery_id, resolution AS duplicate_resolution, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS ingestion_status, reason AS reason_code, CASE WHEN event_id % 83 <> 0 AND resolution IN ('unique', 'duplicate_delivery', 'event_id_conflict') THEN CASE WHEN event_id % 97 = 0 THEN 'same:' ELSE 'a:' END || event_id END AS canonical_record_id FROM final"))
def _(t):
    """The decisions that stand at the end of a table of attempts; its stream would tell the same ones."""
    told = stateful.standing(stateful.decisions(attempts(t)))
    return told.select("delivery_id", "duplicate_resolution", "ingestion_status", "reason_code", "canonical_record_id")


@query("p17_closed_schemas", f"""WITH base AS ({CTES['base']})
SELECT event_id, CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN '/transaction_id=required' WHEN 2 THEN '/=additionalProperties' WHEN 3 THEN '/=additionalProperties' WHEN 4 THEN '/amount_scale=type'
  WHEN 5 THEN '/financial_status=enum' WHEN 6 THEN '/=not_an_object' WHEN 7 THEN CASE WHEN cents % 2 = 0 THEN '/attributes/k=anyOf|/attributes/k=type|/money/currency=required' ELSE '' END
  ELSE '/amount_scale=maximum|/currency=pattern' END AS faults FROM base""")
def _(t):
    """Faults of payloads that are made from the columns of events, nested and with escaped keys."""
    sound = F.to_json(F.struct(F.concat(F.lit("t"), "event_id").alias("transaction_id"), F.col("cents").cast("string").alias("amount_unscaled"), (F.col("event_id") % 5).alias("amount_scale"), F.lit("USD").alias("currency"), F.when(F.col("cents") % 3 == 0, "settled").otherwise("pending").alias("financial_status"), F.struct(F.col("props").alias("any")).alias("extensions")))
    attributes = F.when(F.col("cents") % 2 == 0, F.concat(F.lit('{"k":['), "event_id", F.lit("]}"))).otherwise(F.concat(F.lit('{"k":'), "event_id", F.lit(',"n":null}')))
    money = F.when(F.col("cents") % 2 == 0, F.lit('{"amount_unscaled":"1","amount_scale":2}')).otherwise(F.lit('{"amount_unscaled":"1","amount_scale":2.0,"currency":"EUR"}'))
    nested = F.concat(F.lit('{"installation_id":"i","event_key":"a_key","attributes":'), attributes, F.lit(',"money":'), money, F.lit("}"))
    n = F.col("event_id") % 9
    payload = (
        F.when(n == 0, sound).when(n == 1, F.replace(sound, F.lit('"transaction_id"'), F.lit('"original_transaction_id"'))).when(n == 2, F.concat(F.lit('{"advertising":'), "cents", F.lit(","), F.substring(sound, 2, 100_000)))
        .when(n == 3, F.concat(F.lit('{"\\u0061dvertising":1,'), F.substring(sound, 2, 100_000))).when(n == 4, F.regexp_replace(sound, '"amount_scale":([0-9])', '"amount_scale":"$1"')).when(n == 5, F.regexp_replace(sound, '"(settled|pending)"', '"$1 now"'))
        .when(n == 6, F.concat(F.lit("["), sound, F.lit("]"))).when(n == 7, nested).otherwise(F.regexp_replace(F.replace(sound, F.lit("USD"), F.lit("usd")), '"amount_scale":[0-9]', '"amount_scale":19'))
    )
    events = t.base().select("event_id", F.when(n == 7, "custom_event").otherwise("purchase").alias("event_name"), payload.alias("payload"))
    return schemas.validated(events, schemas={k: schemas.EVENTS[k] for k in ("purchase", "custom_event")}).select("event_id", F.array_join(F.transform("faults", lambda f: F.concat(f["path"], F.lit("="), f["reason"])), "|").alias("faults"))


@query("p25_reserved_keys", f"""WITH base AS ({CTES['base']}) SELECT event_id, user_id % 4 IN (1, 3) AS reserved FROM base""")
def _(t):
    """Reserved names as keys at some depth, spelled with escapes or not, and as values."""
    deep = F.concat(F.lit('{"a":[{"b":'), F.to_json(F.struct("event_id", "props")), F.lit(',"'), F.when(F.col("user_id") % 4 == 1, F.concat(F.lit("\\u00"), F.lower(F.hex(F.ascii(F.lit("a")))), F.lit("dvertising_id"))).when(F.col("user_id") % 4 == 3, "device_id").otherwise("other_id"), F.lit('" : "advertising_id:"}]}'))
    return t.base().select("event_id", ingest.reserved_names(deep, ["advertising_id", "device_id"]).alias("reserved"))


@query("t10_completed_lookups", """
SELECT 'attr:adservices:' || substr(sha256('t' || chr(0) || 'a' || chr(0) || 'install:' || event_id || chr(0) || 'd' || cents || chr(0) || reason), 1, 48) AS attribution_id, 'attr:install:' || event_id AS supersedes_attribution_id, reason AS reason_code,
  CASE WHEN reason = 'adservices_attributed' THEN 'non_organic' ELSE 'unattributed' END AS status, 'click:' || user_id || '|answer:' || event_id AS refs
FROM (SELECT *, CASE user_id % 5 WHEN 0 THEN 'adservices_attributed' WHEN 1 THEN 'adservices_not_attributed' WHEN 2 THEN 'adservices_token_expired' WHEN 3 THEN 'adservices_lookup_unavailable' END AS reason FROM base WHERE event_type = 'signup') WHERE reason IS NOT NULL""", ("base",))
def _(t):
    """Decisions after lookups were answered, refused, expired or dropped."""
    e = t.base().where("event_type = 'signup'").select(F.lit("t").alias("tenant_id"), F.lit("a").alias("app_id"), "*")
    name = F.concat(F.lit("install:"), "event_id")
    prior = e.select("tenant_id", "app_id", name.alias("record_id"), F.concat(F.lit("attr:"), name).alias("attribution_id"), F.lit("unattributed").alias("status"), F.lit("unknown_click_id").alias("reason_code"), F.array(F.concat(F.lit("click:"), "user_id")).alias("evidence_refs"), F.lit("2024-01-01").alias("decided_at"))
    status = F.expr("case user_id % 5 when 0 then 'attributed' when 1 then 'not_attributed' when 2 then 'token_expired' when 3 then 'lookup_unavailable' else 'dropped' end")
    done = e.select("tenant_id", "app_id", name.alias("install_record_id"), status.alias("status"), F.concat(F.lit("answer:"), "event_id").alias("response_ref"), F.concat(F.lit("d"), "cents").alias("response_digest"), F.lit("2024-01-02").alias("decided_at"))
    return attribution.complete_lookups(prior, done).select("attribution_id", "supersedes_attribution_id", "reason_code", "status", F.array_join("evidence_refs", "|").alias("refs"))


@query("c3_reconciliation_arrays", """
WITH lines AS (SELECT *, 'c' || l_partkey || '-' || l_linenumber AS cand FROM lineitem WHERE l_returnflag = 'R'),
keys AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'id:' || o_custkey || ',id:' || o_orderkey || ',id:' || o_orderkey ELSE 'id:' || o_orderkey END AS keys FROM orders WHERE o_orderkey % 3 <> 0 OR CAST(o_custkey AS VARCHAR) < CAST(o_orderkey AS VARCHAR)
  UNION ALL SELECT o_orderkey, 'id:' || o_orderkey || ',id:' || o_orderkey || ',id:' || o_custkey FROM orders WHERE o_orderkey % 3 = 0 AND CAST(o_custkey AS VARCHAR) >= CAST(o_orderkey AS VARCHAR))
SELECT CAST(k.o_orderkey AS VARCHAR) AS reconciliation_id, k.keys, coalesce(string_agg(cand, '|' ORDER BY cand), '') AS candidates, coalesce(string_agg(CASE WHEN l_suppkey % 2 = 0 THEN 'why' || l_suppkey END, '|' ORDER BY 'why' || l_suppkey), '') AS exclusions,
  coalesce(string_agg(cand || ':in_window', '|' ORDER BY cand || ':in_window'), '') AS windows, coalesce(string_agg(k.keys || '=>' || cand, '|' ORDER BY cand), '') AS joins
FROM keys k LEFT JOIN lines l ON l.l_orderkey = k.o_orderkey GROUP BY k.o_orderkey, k.keys""")
def _(t):
    """All arrays of a result, with inputs that name a key twice."""
    from .domain import _key

    scope = [F.lit("t").alias("tenant_id"), F.lit("a").alias("app_id")]
    text = lambda c: F.col(c).cast("string")
    own = _key("id", text("o_orderkey"))
    inputs = t.read("orders").select(*scope, text("o_orderkey").alias("reconciliation_id"), F.when(F.col("o_orderkey") % 3 == 0, F.array(own, _key("id", text("o_custkey")), own)).otherwise(F.array(own)).alias("matching_keys"), F.lit(None).cast("string").alias("privacy_effect"), F.lit(False).alias("provider_modeled_without_candidate"), F.lit("fresh").alias("freshness"))
    mine = _key("id", text("l_orderkey"))
    candidates = t.read("lineitem").where("l_returnflag = 'R'").select(*scope, text("l_orderkey").alias("reconciliation_id"), F.concat(F.lit("c"), "l_partkey", F.lit("-"), "l_linenumber").alias("candidate_id"), F.array(mine, mine).alias("matching_keys"), F.col("l_linenumber").alias("position"), F.lit("in_window").alias("window_status"), F.lit("fresh").alias("freshness"), (F.col("l_suppkey") % 2 == 0).alias("excluded"), F.concat(F.lit("why"), "l_suppkey").alias("exclusion_reason"))
    found = reconcile.reconcile(inputs, candidates)
    return found.select("reconciliation_id", F.array_join("keys", ",").alias("keys"), *[F.array_join(c, "|").alias(c) for c in ("candidates", "exclusions", "windows", "joins")])


@query("d7_policy_digests", """SELECT CAST(event_id AS VARCHAR) AS record_id, CASE WHEN event_id % 7 = 1 THEN 'timestamp_stale_policy.policy_digest does not match its canonical policy fields' ELSE 'click_injection_policy.policy_digest does not match its canonical policy fields' END AS error FROM events WHERE event_id % 7 IN (1, 2)""")
def _(t):
    """Policies that were made from the columns of events; some have the digest of another threshold."""
    day = F.to_date("ts").cast("string")
    stale = lambda before: F.sha2(F.concat(F.lit('{"authority":"tenant","before":"'), before, F.lit('","policy_version":"v'), "user_id", F.lit('"}')), 256)
    click = lambda n: F.sha2(F.concat(F.lit('{"authority":"tenant","policy_version":"v'), "user_id", F.lit('","threshold_seconds":'), n, F.lit("}")), 256)
    n, version = F.col("event_id") % 7, F.concat(F.lit("v"), "user_id")
    first = F.struct(day.alias("before"), F.lit("tenant").alias("authority"), version.alias("policy_version"), stale(F.when(n == 1, F.lit("1999-01-01")).otherwise(day)).alias("policy_digest"))
    second = F.struct(F.col("event_id").cast("long").alias("threshold_seconds"), F.lit("tenant").alias("authority"), version.alias("policy_version"), click(F.when(n == 2, F.col("event_id") + 1).otherwise(F.col("event_id"))).alias("policy_digest"))
    rows = t.read("events").select(F.col("event_id").cast("string").alias("record_id"), F.when(n != 0, first).alias("timestamp_stale_policy"), F.when(n > 1, second).alias("click_injection_policy"))
    return ingest.policy_errors(rows)


@query("f20_postback_messages", """
SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 2) THEN array_to_string(list_filter([CASE WHEN event_id % 6 = 0 THEN '3.0' ELSE '4.0' END, 'net' || user_id || '.example', CASE WHEN event_id % 6 = 0 THEN CAST(user_id AS VARCHAR) ELSE 's' || user_id END, CAST(event_id AS VARCHAR), 't' || event_id, CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END,
    CASE WHEN event_id % 6 = 2 THEN 'site.example' WHEN event_id % 12 = 6 THEN NULL ELSE '77' END, '1', 'true', CASE WHEN event_id % 6 <> 0 THEN CAST(event_id % 3 AS VARCHAR) END], lambda x: x IS NOT NULL), chr(8291)) END AS message,
  CASE event_id % 6 WHEN 3 THEN 'unsupported_version' WHEN 4 THEN 'invalid_app-id' WHEN 5 THEN 'missing_source-domain' END AS error FROM events""")
def _(t):
    """Signed fields of postbacks of two versions, made from the columns of events; some are unsound."""
    n, text_of = F.col("event_id") % 6, lambda c: F.col(c).cast("string")
    old = n == 0
    part = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    quoted = lambda *c: F.concat(F.lit('"'), *c, F.lit('"'))
    fields = [
        part("did-win", F.lit("true")), part("version", F.when(old, F.lit('"3.0"')).when(n == 3, F.lit('"5.1"')).otherwise(F.lit('"4.0"'))), part("ad-network-id", quoted(F.lit("net"), text_of("user_id"), F.lit(".example"))),
        F.when(old, part("campaign-id", text_of("user_id"))).otherwise(part("source-identifier", quoted(F.lit("s"), text_of("user_id")))), part("app-id", F.when(n == 4, F.concat(F.lit("-"), text_of("event_id"))).otherwise(text_of("event_id"))),
        part("transaction-id", quoted(F.lit("t"), text_of("event_id"))), part("redownload", (F.col("user_id") % 2 == 0).cast("string")), part("fidelity-type", F.lit("1")),
        F.when(n == 2, part("source-domain", F.lit('"site.example"'))).when((F.col("event_id") % 12 == 6) | (n == 5), F.lit(None)).otherwise(part("source-app-id", F.lit("77"))), F.when(~old, part("postback-sequence-index", (F.col("event_id") % 3).cast("string"))),
    ]
    body = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    rows = t.read("events").select("event_id", body.alias("body")).withColumn("m", text.postback_message(F.col("body")))
    return rows.select("event_id", "m.message", "m.error")


@query("s14_aggregate_postbacks", """
SELECT CAST(event_id AS VARCHAR) AS record_id, CASE WHEN event_id % 2 = 0 THEN 's' || user_id ELSE lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') END AS source_identifier, CAST(event_id % 64 AS INTEGER) AS conversion_value,
  CASE WHEN event_id % 2 = 0 THEN CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' END END AS coarse_conversion_value, CAST(CASE WHEN event_id % 2 = 0 AND event_id % 3 = 1 THEN user_id % 3 ELSE 0 END AS INTEGER) AS sequence_index, CASE WHEN event_id % 5 = 0 THEN event_id % 10 = 0 ELSE true END AS did_win FROM events""")
def _(t):
    """Postbacks of both versions in one form."""
    e = t.read("events")
    rows = e.select(F.col("event_id").cast("string").alias("record_id"), F.when(F.col("event_id") % 2 == 0, "4.0").otherwise("3.0").alias("version"), F.lit("t").alias("transaction_id"), F.concat(F.lit("s"), "user_id").alias("source_identifier"), (F.col("user_id") % 100).alias("campaign_id"), (F.col("event_id") % 64).cast("int").alias("conversion_value"), F.expr("case event_id % 3 when 0 then 'low' when 1 then 'high' end").alias("coarse_conversion_value"), F.when(F.col("event_id") % 3 == 1, F.col("user_id") % 3).cast("int").alias("postback_sequence_index"), F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 10 == 0).alias("did_win"))
    return connectors.aggregate_postbacks(rows).drop("version", "transaction_id")


@query("s18_audit_report", """
SELECT 0 AS place, 'event_type,users,events' || chr(13) || chr(10) AS line UNION ALL
SELECT 1, event_type || ',' || string_agg(DISTINCT CAST(user_id AS VARCHAR), '|' ORDER BY CAST(user_id AS VARCHAR)) FILTER (WHERE user_id < 20) || ',' || count(*) || chr(13) || chr(10) FROM events GROUP BY event_type""")
def _(t):
    """A report's file: header, quoted cells, line ends."""
    rows = t.read("events").groupBy("event_type").agg(F.sort_array(F.collect_set(F.when(F.col("user_id") < 20, F.col("user_id").cast("string")))).alias("users"), F.count("*").alias("events"))
    return files.csv_report(rows)


@query("a18_evidence_pages", """
SELECT event_type, CAST((place - 1) // 50 AS BIGINT) AS page, string_agg(ref, '|' ORDER BY ref) AS refs, sha256('["' || string_agg(ref, '","' ORDER BY ref) || '"]') AS digest
FROM (SELECT event_type, CAST(event_id AS VARCHAR) AS ref, row_number() OVER (PARTITION BY event_type ORDER BY CAST(event_id AS VARCHAR)) AS place FROM events) GROUP BY event_type, (place - 1) // 50""")
def _(t):
    """Evidence of large scopes as pages of fifty references."""
    found = pages.evidence_pages(t.read("events"), ["event_type"], "event_id", 50)
    return found.select("event_type", "page", F.array_join("refs", "|").alias("refs"), "digest")


@query("a18_digest_of_pages", """SELECT event_type, sha256('["' || string_agg(CAST(event_id AS VARCHAR), '","' ORDER BY CAST(event_id AS VARCHAR)) || '"]') AS refs_digest, CAST(count(*) AS BIGINT) AS refs, CAST((count(*) + 49) // 50 AS BIGINT) AS pages FROM events GROUP BY event_type""")
def _(t):
    """The digest of a scope's whole array, from its pages."""
    return pages.pages_digest(pages.evidence_pages(t.read("events"), ["event_type"], "event_id", 50), ["event_type"])


@query("a16_audit_pages", """
SELECT subject_ref, CAST((place - 1) // 20 AS BIGINT) AS page, string_agg(ref, '|' ORDER BY ref) AS click_refs FROM (
  SELECT 'source-day:' || day || ':' || source AS subject_ref, ref, row_number() OVER (PARTITION BY day, source ORDER BY ref) AS place FROM (SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, 's' || user_id % 5 AS source, 'c' || event_id AS ref FROM events WHERE event_type = 'click'))
GROUP BY subject_ref, (place - 1) // 20""")
def _(t):
    """The clicks that source days rest on, as pages under the composed reference."""
    clicks = t.clicks().select(F.concat_ws(":", F.lit("source-day"), F.to_date("ts").cast("string"), F.concat(F.lit("s"), F.col("user_id") % 5)).alias("subject_ref"), F.concat(F.lit("c"), "event_id").alias("click_ref"))
    return pages.evidence_pages(clicks, ["subject_ref"], "click_ref", 20).select("subject_ref", "page", F.array_join("refs", "|").alias("click_refs"))
