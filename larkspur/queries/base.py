"""The domain seen in the test tables, once in Spark and once as SQL common table expressions.

Events are the ledger: a click, a signup (the first of a user is the install), a view (a session) and
a purchase (revenue); a customer's segment and nation are campaign and country.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, using: tuple[str, ...] = ()):
    """Register a function of (tables) under a name with the SQL that gives its rows."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(Tables(spark, sf_dir))

        run.__doc__, run.__name__ = f.__doc__, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = (("WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in closure(using)) + "\n") if using else "") + sql.strip()
        return f

    return add


def closure(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        for d in [*closure(NEEDS.get(n, ())), n]:
            if d not in out:
                out.append(d)
    return out


MS = "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"

CTES = {
    "base": "SELECT event_id, epoch_us(ts) // 1000 AS ms, ts, user_id, event_type, value, CAST(round(coalesce(value, 0) * 100) AS BIGINT) AS cents, props FROM events",
    "installs": "SELECT user_id, min(ms) AS installed_ms FROM base WHERE event_type = 'signup' GROUP BY user_id",
    "people": "SELECT c_custkey AS user_id, c_mktsegment AS campaign_id, n_name AS country, r_name AS network FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "cohort": "SELECT i.user_id, i.installed_ms, coalesce(p.campaign_id, 'none') AS campaign_id FROM installs i LEFT JOIN people p ON p.user_id = i.user_id",
    "revenue": "SELECT event_id, user_id, ms AS occurred_ms, cents, CASE event_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'JPY' END AS currency FROM base WHERE event_type = 'purchase'",
    "sessions": "SELECT event_id, user_id, ms AS occurred_ms FROM base WHERE event_type = 'view'",
    "clicks": "SELECT event_id, user_id, ms AS clicked_ms, ts FROM base WHERE event_type = 'click'",
    "chain": "SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS supersedes_id, o_custkey AS subject, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderdate FROM orders",
}
NEEDS = {"installs": ("base",), "cohort": ("installs", "people"), "revenue": ("base",), "sessions": ("base",), "clicks": ("base",)}

# Rates of the examples, six decimals.
RATES = [
    {"currency": "USD", "rate_unscaled": "1000000", "rate_scale": 6},
    {"currency": "EUR", "rate_unscaled": "1250000", "rate_scale": 6},
    {"currency": "JPY", "rate_unscaled": "6543", "rate_scale": 6},
]


def half_even_sql(n: str, d: str) -> str:
    """SQL of a half-even division of integers."""
    q, r = f"(abs({n}) // ({d}))", f"(abs({n}) % ({d}))"
    return f"(CASE WHEN ({n}) < 0 THEN -1 ELSE 1 END * ({q} + CASE WHEN 2 * {r} > ({d}) OR (2 * {r} = ({d}) AND {q} % 2 = 1) THEN 1 ELSE 0 END))"


class Tables:
    """Readers of the test tables and of the domain views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def base(self) -> DataFrame:
        return self.read("events").select("event_id", F.expr(MS).alias("ms"), "ts", "user_id", "event_type", "value", F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long").alias("cents"), "props")

    def installs(self) -> DataFrame:
        return self.base().where("event_type = 'signup'").groupBy("user_id").agg(F.min("ms").alias("installed_ms"))

    def people(self) -> DataFrame:
        n, r = self.read("nation"), self.read("region")
        places = n.join(r, n["n_regionkey"] == r["r_regionkey"])
        return self.read("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("campaign_id"), F.col("n_name").alias("country"), F.col("r_name").alias("network"))

    def cohort(self) -> DataFrame:
        return self.installs().join(self.people().select("user_id", "campaign_id"), "user_id", "left").withColumn("campaign_id", F.coalesce("campaign_id", F.lit("none")))

    def revenue(self) -> DataFrame:
        currency = F.expr("case event_id % 3 when 0 then 'USD' when 1 then 'EUR' else 'JPY' end")
        return self.base().where("event_type = 'purchase'").select("event_id", "user_id", F.col("ms").alias("occurred_ms"), "cents", currency.alias("currency"))

    def sessions(self) -> DataFrame:
        return self.base().where("event_type = 'view'").select("event_id", "user_id", F.col("ms").alias("occurred_ms"))

    def clicks(self) -> DataFrame:
        return self.base().where("event_type = 'click'").select("event_id", "user_id", F.col("ms").alias("clicked_ms"), "ts")

    def chain(self) -> DataFrame:
        before = F.expr("lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey)")
        return self.read("orders").select(F.col("o_orderkey").alias("id"), before.alias("supersedes_id"), F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), "o_orderdate")
