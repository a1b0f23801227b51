"""Scalar functions and ledger operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import canon, instants, money, text
from larkspur.operators import ledger

from .base import half_even_sql, query


@query("f1_half_even_division", f"""
SELECT l_orderkey, l_linenumber, CAST({half_even_sql('CAST(round(l_extendedprice * 100) AS BIGINT)', 'CAST(l_quantity AS BIGINT) * 2')} AS BIGINT) AS unit,
  CAST({half_even_sql('(CAST(round(l_extendedprice * 100) AS BIGINT) - 1000000)', 'CAST(1000 AS BIGINT)')} AS BIGINT) AS signed_unit FROM lineitem""")
def _(t):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    quantity = F.col("l_quantity").cast("long") * 2
    return t.read("lineitem").select("l_orderkey", "l_linenumber", money.half_even_div(money.units(cents), money.units(quantity)).cast("long").alias("unit"), money.half_even_long(cents - 1_000_000, F.lit(1000)).alias("signed_unit"))


@query("f2_fx_convert", f"""
SELECT event_id, CAST(CASE currency WHEN 'USD' THEN cents * 10000 WHEN 'EUR' THEN cents * 12500 ELSE {half_even_sql('cents * 6543', '100')} END AS VARCHAR) AS converted FROM revenue""", ("revenue",))
def _(t):
    rate = F.expr("case currency when 'USD' then '1000000' when 'EUR' then '1250000' else '6543' end")
    return t.revenue().select("event_id", money.convert(F.col("cents"), 2, rate, 6, 6).cast("string").alias("converted"))


@query("f3_rescale", f"""
SELECT event_id, CAST(cents * 10000 AS VARCHAR) AS finer, CAST({half_even_sql('cents', '10')} AS VARCHAR) AS coarser FROM revenue""", ("revenue",))
def _(t):
    return t.revenue().select("event_id", money.rescale(F.col("cents"), 2, 6).cast("string").alias("finer"), money.rescale(F.col("cents"), 2, 1).cast("string").alias("coarser"))


@query("f4_decimal_to_unscaled", r"""
SELECT o_orderkey, CASE WHEN regexp_matches(s, '^[0-9]+(\.[0-9]+)?$') AND length(coalesce(nullif(split_part(s, '.', 2), ''), '')) <= 6
  THEN regexp_replace(split_part(s, '.', 1) || rpad(split_part(s, '.', 2), 6, '0'), '^0+([0-9])', '\1') END AS unscaled
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '00' || (o_orderkey % 1000) || '.' || (o_orderkey % 7) WHEN 1 THEN CAST(o_orderkey AS VARCHAR) WHEN 2 THEN '1.1234567' ELSE '-3' END AS s FROM orders)""")
def _(t):
    s = F.expr("case o_orderkey % 4 when 0 then concat('00', o_orderkey % 1000, '.', o_orderkey % 7) when 1 then cast(o_orderkey as string) when 2 then '1.1234567' else '-3' end")
    return t.read("orders").select("o_orderkey", money.decimal_to_unscaled(s).alias("unscaled"))


@query("f5_canonical_digest", """
SELECT user_id, sha256('{"campaign_id":"' || campaign_id || '","country":"' || country || '","network":"' || network || '"}') AS digest FROM people""", ("people",))
def _(t):
    return t.people().select("user_id", canon.digest({c: F.col(c) for c in ("network", "campaign_id", "country")}).alias("digest"))


@query("f6_calendar_day", """
SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS utc_day, CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS tokyo_day FROM events""")
def _(t):
    at = F.timestamp_millis("ms")
    return t.base().select("event_id", instants.day_in(at, "UTC").cast("string").alias("utc_day"), instants.day_in(at, "Asia/Tokyo").cast("string").alias("tokyo_day"))


@query("f7_strict_timestamp", r"""
SELECT event_id, CASE WHEN event_id % 5 IN (2, 3, 4) THEN NULL ELSE ms END AS millis, event_id % 5 IN (2, 3, 4) AS invalid FROM base""", ("base",))
def _(t):
    good = instants.canonical(F.timestamp_millis("ms"))
    raw = F.when(F.col("event_id") % 5 == 2, F.lit("2026-02-30T00:00:00.000Z")).when(F.col("event_id") % 5 == 3, F.lit("2026-01-01T24:00:00.000Z")).when(F.col("event_id") % 5 == 4, F.regexp_replace(good, "Z$", "")).otherwise(good)
    df = t.base().withColumn("raw", raw)
    return df.select("event_id", instants.millis(F.col("raw")).alias("millis"), instants.is_invalid(F.col("raw")).alias("invalid"))


@query("f8_date_range", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) >= DATE '1995-03-01' AND CAST(o_orderdate AS DATE) < DATE '1996-03-01' AS inside, o_orderkey % 3 = 0 AS real FROM orders""")
def _(t):
    day = F.to_date("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.lit("2025-02-29")).otherwise(F.lit("2025-2-1"))
    return t.read("orders").select("o_orderkey", ((day >= F.lit("1995-03-01").cast("date")) & (day < F.lit("1996-03-01").cast("date"))).alias("inside"), F.coalesce(instants.valid_date(raw), F.lit(False)).alias("real"))


@query("f9_run_date", "SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END, ''), 'cohort') AS run_date FROM orders")
def _(t):
    json = F.to_json(F.struct(F.expr("case when o_orderkey % 2 = 0 then date_format(o_orderdate, 'yyyy-MM-dd') else '' end").alias("metric_date"), F.lit("cohort").alias("cohort_date")))
    return t.read("orders").select("o_orderkey", F.coalesce(F.nullif(F.get_json_object(json, "$.metric_date"), F.lit("")), F.get_json_object(json, "$.cohort_date")).alias("run_date"))


@query("f10_matching_key", """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'name:' || translate(c_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') WHEN 1 THEN 'name:' || c_name ELSE 'name: ' || c_name || ' ' END AS key FROM customer""")
def _(t):
    mode = F.expr("case c_custkey % 3 when 0 then 'lowercase_ascii' when 1 then 'trim' else 'identity' end")
    value = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ")))
    return t.read("customer").select("c_custkey", text.matching_key(F.lit("name"), value, mode).alias("key"))


@query("f11_provider_key_digest", """
SELECT c_custkey, sha256('{"provider":"p1","type":"' || lower(c_mktsegment) || '","value":"' || c_name || '"}') AS digest FROM customer""")
def _(t):
    return t.read("customer").select("c_custkey", canon.digest({"value": F.col("c_name"), "type": F.lower("c_mktsegment"), "provider": F.lit("p1")}).alias("digest"))


@query("f12_dimension_digest", """
SELECT user_id, sha256('{"campaign_id":"' || campaign_id || '"' || CASE WHEN user_id % 2 = 0 THEN ',"country":"' || country || '"' ELSE '' END || ',"network":"' || network || '"}') AS digest FROM people""", ("people",))
def _(t):
    from larkspur.sources.connectors import dimension_digest

    return t.people().withColumn("country", F.when(F.col("user_id") % 2 == 0, F.col("country"))).select("user_id", dimension_digest(["network", "campaign_id", "country"]).alias("digest"))


@query("f15_client_class", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'bot' WHEN 1 THEN 'mobile_app_eligible' ELSE 'other' END AS client FROM events""")
def _(t):
    agent = F.expr("case event_id % 4 when 0 then 'Android Googlebot/2.1' when 1 then 'Mozilla (iPhone)' when 2 then 'Mozilla (X11)' end")
    return t.read("events").select("event_id", text.client_class(agent).alias("client"))


@query("f16_referrer_outcome", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'available' WHEN 1 THEN 'available' WHEN 2 THEN 'none' WHEN 3 THEN 'unsupported' ELSE 'unavailable' END AS status,
  CASE event_id % 6 WHEN 5 THEN 'bounded' ELSE 'none' END AS retry, CASE WHEN event_id % 6 = 0 THEN 'a b' || event_id END AS click_id,
  CASE event_id % 6 WHEN 1 THEN 'unknown_click_id' WHEN 2 THEN 'no_referrer' WHEN 3 THEN 'install_referrer_unsupported' WHEN 4 THEN 'install_referrer_unavailable' WHEN 5 THEN 'install_referrer_unavailable' END AS reason FROM events""")
def _(t):
    response = F.expr("case event_id % 6 when 3 then 'feature_not_supported' when 4 then 'developer_error' when 5 then 'service_unavailable' else 'ok' end")
    referrer = F.expr("case event_id % 6 when 0 then concat('utm=x&cid=a%20b', event_id) when 1 then 'utm=x' end")
    df = t.read("events").select("event_id", text.referrer_outcome(response, referrer).alias("o"))
    return df.select("event_id", F.col("o.referrer_status").alias("status"), "o.retry", "o.click_id", F.col("o.terminal_reason").alias("reason"))


@query("f19_allowed_destination", "SELECT event_id, CASE event_id % 3 WHEN 1 THEN 'destination_origin_not_allowed' WHEN 2 THEN 'destination_credentials_forbidden' END AS error FROM events")
def _(t):
    host = F.expr("case event_id % 3 when 0 then 'https://Shop.example:443/' when 1 then 'https://shop.example:8443/' else 'https://u:p@shop.example/' end")
    return t.read("events").select("event_id", text.destination_error(F.concat(host, F.lit("e"), "event_id"), ["https://shop.example"]).alias("error"))


@query("f20_signed_message", "SELECT event_id, '4.0' || chr(8291) || event_id || CASE WHEN event_id % 2 = 0 THEN chr(8291) || user_id ELSE '' END || chr(8291) || 'true' AS message FROM events")
def _(t):
    return t.read("events").select("event_id", text.signed_message([F.lit("4.0"), F.col("event_id"), F.when(F.col("event_id") % 2 == 0, F.col("user_id")), F.lit(True)]).alias("message"))


@query("f23_json_answer", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50 THEN 'attributed' ELSE 'not_attributed' END AS status FROM events")
def _(t):
    k = F.from_json("props", "k int")["k"]
    return t.read("events").select("event_id", k.alias("k"), F.when(k >= 50, "attributed").otherwise("not_attributed").alias("status"))


@query("f28_days_since", "SELECT event_id, CAST(floor((ms - 1704067200000) / 86400000.0) AS BIGINT) AS days FROM base", ("base",))
def _(t):
    return t.base().select("event_id", instants.days_between(F.col("ms"), F.lit(1704067200000)).alias("days"))


@query("f30_elapsed_time", "SELECT o_orderkey, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') AS due FROM orders")
def _(t):
    return t.read("orders").select("o_orderkey", F.date_diff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).alias("days"), F.date_format(F.col("o_orderdate") + F.expr("interval 7 days"), "yyyy-MM-dd").alias("due"))


@query("w1_latest_per_key", "SELECT subject, arg_max(id, (o_orderdate, id)) AS id, arg_max(status, (o_orderdate, id)) AS status FROM chain GROUP BY subject", ("chain",))
def _(t):
    return ledger.latest(t.chain(), ["subject"], F.col("o_orderdate").desc(), F.col("id").desc()).select("subject", "id", "status")


@query("w1_latest_by_aggregate", "SELECT subject, arg_max(id, (o_orderdate, id)) AS id, arg_max(cents, (o_orderdate, id)) AS cents FROM chain GROUP BY subject", ("chain",))
def _(t):
    return ledger.latest_by(t.chain(), ["subject"], ["o_orderdate", "id"]).select("subject", "id", "cents")


@query("w3_binary_order", "SELECT c_name, c_mktsegment, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name DESC) AS INTEGER) AS place FROM customer")
def _(t):
    from pyspark.sql import Window

    return t.read("customer").select("c_name", "c_mktsegment", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.col("c_name").desc())).alias("place"))


@query("w5_keyset_page", "SELECT c_mktsegment, c_custkey FROM customer WHERE (c_mktsegment, c_custkey) > ('BUILDING', 100) ORDER BY c_mktsegment, c_custkey LIMIT 51")
def _(t):
    return ledger.page(t.read("customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment", "c_custkey"], ("BUILDING", 100), 50)


@query("w7_due_queue", "SELECT id, cents FROM chain WHERE status = 'O' AND o_orderdate <= TIMESTAMP '1998-01-01' ORDER BY o_orderdate, id LIMIT 100", ("chain",))
def _(t):
    return t.chain().where("status = 'O' and o_orderdate <= timestamp_ntz'1998-01-01 00:00:00'").orderBy("o_orderdate", "id").limit(100).select("id", "cents")


@query("w9_union_of_series", "SELECT series, CAST(count(*) AS BIGINT) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM (SELECT 'revenue' AS series, cents FROM revenue UNION ALL SELECT 'session', 0 FROM sessions) GROUP BY series", ("revenue", "sessions"))
def _(t):
    both = t.revenue().select(F.lit("revenue").alias("series"), "cents").unionByName(t.sessions().select(F.lit("session").alias("series"), F.lit(0).cast("long").alias("cents")))
    return both.groupBy("series").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("w10_distinct_work_list", "SELECT user_id FROM revenue UNION SELECT o_custkey FROM orders", ("revenue",))
def _(t):
    return t.revenue().select("user_id").union(t.read("orders").select("o_custkey")).distinct()


@query("w11_distinct", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def _(t):
    return t.read("lineitem").select("l_suppkey", "l_returnflag").distinct()


@query("j1_unique_match", """
SELECT event_id, CAST(coalesce(n, 0) AS BIGINT) AS m_count, CASE WHEN n = 1 THEN one END AS m_id FROM revenue
LEFT JOIN (SELECT subject, count(*) AS n, min(id) AS one FROM chain WHERE status = 'P' GROUP BY subject) ON subject = user_id""", ("revenue", "chain"))
def _(t):
    return ledger.unique_match(t.revenue(), t.chain().where("status = 'P'"), "user_id", "subject", ["id"]).select("event_id", "m_count", "m_id")


@query("j15_as_of", """
SELECT r.event_id, (SELECT max(s.occurred_ms) FROM sessions s WHERE s.user_id = r.user_id AND s.occurred_ms <= r.occurred_ms) AS session_ms FROM revenue r""", ("revenue", "sessions"))
def _(t):
    right = t.sessions().withColumn("at", F.col("occurred_ms"))
    return ledger.as_of(t.revenue(), right, ["user_id"], "occurred_ms", "occurred_ms", "at", "session_ms").select("event_id", "session_ms")


@query("j17_not_superseded", "SELECT id, subject FROM chain c WHERE NOT EXISTS (SELECT 1 FROM chain n WHERE n.supersedes_id = c.id)", ("chain",))
def _(t):
    return ledger.not_superseded(t.chain()).select("id", "subject")


@query("j18_superseded_flag", "SELECT id, EXISTS (SELECT 1 FROM chain n WHERE n.supersedes_id = c.id) AS superseded FROM chain c", ("chain",))
def _(t):
    return ledger.with_superseded_flag(t.chain()).select("id", "superseded")


@query("j19_net_of_exclusions", """
SELECT event_id, user_id FROM revenue r WHERE NOT EXISTS (SELECT 1 FROM chain x WHERE x.subject = r.user_id AND x.status = 'F' AND NOT EXISTS (SELECT 1 FROM chain n WHERE n.status = 'F' AND n.supersedes_id = x.id))""", ("revenue", "chain"))
def _(t):
    return ledger.net_of(t.revenue(), t.chain().where("status = 'F'"), "user_id", "subject", "id", "supersedes_id").select("event_id", "user_id")


@query("j20_fan_out", """
SELECT series, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(list_filter([CASE WHEN event_type = 'signup' THEN 'install' END, CASE WHEN event_type IN ('signup', 'view') THEN 'activity' END, CASE WHEN cents > 1000 THEN 'large' END], lambda x: x IS NOT NULL)) AS series FROM base) GROUP BY series""", ("base",))
def _(t):
    series = {"install": F.col("event_type") == "signup", "activity": F.col("event_type").isin("signup", "view"), "large": F.col("cents") > 1000}
    return ledger.fan_out(t.base(), series, ["event_id"]).groupBy("series").agg(F.count("*").alias("n"))


@query("j22_unshared_payloads", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R')")
def _(t):
    lines = t.read("lineitem")
    return ledger.unshared(lines.where("l_returnflag = 'R'").select("l_orderkey").distinct(), lines.where("l_returnflag <> 'R'"), "l_orderkey")


@query("j23_key_overlap", """
SELECT DISTINCT a.l_orderkey AS left_id, b.l_orderkey AS right_id, a.l_linestatus AS scope FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_linestatus = b.l_linestatus
WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'A'""")
def _(t):
    lines = t.read("lineitem").withColumn("key", F.concat_ws(":", "l_partkey", "l_suppkey"))
    side = lambda flag, name, keys: lines.where(F.col("l_returnflag") == flag).groupBy(F.col("l_linestatus").alias("scope"), F.col("l_orderkey").alias(name)).agg(F.collect_set("key").alias(keys))
    a, b = side("R", "left_id", "a"), side("A", "right_id", "b")
    return ledger.overlap(a, b, "left_id", "right_id", "a", "b", ["scope"])


@query("d13_idempotent_append", "SELECT min(l_orderkey) AS l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 5000) GROUP BY l_suppkey")
def _(t):
    new = t.read("lineitem").groupBy("l_suppkey").agg(F.min("l_orderkey").alias("l_orderkey"))
    return ledger.append_once(new, t.read("supplier").where("s_acctbal < 5000").withColumnRenamed("s_suppkey", "l_suppkey"), ["l_suppkey"])


@query("j7_rate_join", f"""
SELECT currency, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN rate IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum({half_even_sql('cents * rate', '100')}) AS VARCHAR) AS value
FROM revenue LEFT JOIN (VALUES ('USD', 1000000), ('EUR', 1250000)) r(c, rate) ON c = currency GROUP BY currency""", ("revenue",))
def _(t):
    from larkspur.operators.metrics import with_rates

    from .base import RATES

    valued = with_rates(t.revenue().select("currency", F.col("cents").alias("amount_unscaled"), F.lit(2).alias("amount_scale")), RATES[:2], 6)
    return valued.groupBy("currency").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.sum("value").cast("string").alias("value"))


@query("j8_three_way_join", """
SELECT o_orderstatus, n_name, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_returnflag = 'R' GROUP BY o_orderstatus, n_name""")
def _(t):
    lines = t.read("lineitem").where("l_returnflag = 'R'").select("l_orderkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"))
    orders = t.read("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customers = t.read("customer").select("c_custkey", "c_nationkey").join(F.broadcast(t.read("nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("o_orderstatus", "n_name").agg(F.count("*").alias("n"), F.sum("c").alias("cents"))


@query("j24_evidence_refs", "SELECT k, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS orders FROM (SELECT l_orderkey, unnest([l_partkey, l_suppkey]) AS k FROM lineitem) GROUP BY k")
def _(t):
    return t.read("lineitem").select("l_orderkey", F.explode(F.array("l_partkey", "l_suppkey")).alias("k")).groupBy("k").agg(F.count_distinct("l_orderkey").alias("orders"))
