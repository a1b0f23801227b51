"""Structured Streaming: landing files to decided deliveries, with state for what must be remembered.

Logical keys are remembered for good, since a conflict has to be told however late it comes: a
dropped duplicate is not enough.  The state is a digest and an id per key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The total order of attempts of one logical key; columns that a stream lacks do not decide.
ORDER = ["received_at", "record_id", "delivery_id", "schema_version", "record_sha256", "payload_sha256"]
DECIDED = "tenant_id string, app_id string, producer string, event_id string, record_id string, delivery_id string, payload_sha256 string, duplicate_resolution string, canonical_record_id string"


def landing(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """JSON Lines that land in a folder, in micro-batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def _resolve(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames))
    rows = rows.sort_values([c for c in ORDER if c in rows.columns], kind="stable", key=lambda c: c.fillna("").astype(str).map(lambda x: x.encode("utf-16-be", "surrogatepass")))
    first = state.getOption
    if first is None:
        head = rows.iloc[0]
        first = (head["record_id"], head["payload_sha256"])
        state.update(first)
        unique = [True] + [False] * (len(rows) - 1)  # the same delivery again is a duplicate
    else:
        unique = [False] * len(rows)
    resolution = ["unique" if u else "duplicate_delivery" if d == first[1] else "event_id_conflict" for u, d in zip(unique, rows["payload_sha256"])]
    out = rows.assign(duplicate_resolution=resolution, canonical_record_id=first[0])
    out = out.assign(**dict(zip(("tenant_id", "app_id", "producer", "event_id"), key)))
    yield out[[c.split()[0] for c in DECIDED.split(", ")]]


def resolved(attempts: DataFrame) -> DataFrame:
    """Attempts (received_at, payload_sha256 and the logical key) as unique, duplicate or conflict, for good."""
    return attempts.groupBy("tenant_id", "app_id", "producer", "event_id").applyInPandasWithState(_resolve, DECIDED, "record_id string, payload_sha256 string", "append", GroupStateTimeout.NoTimeout)


def fresh_nonces(requests: DataFrame, ttl: str = "10 minutes") -> DataFrame:
    """Requests whose nonce was not seen within its time to live."""
    return requests.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["key_id", "nonce"])


def hourly_quota(requests: DataFrame, quota: int, delay: str = "1 hour") -> DataFrame:
    counts = requests.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "key_id").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("hour"), "key_id", "n", (F.col("n") > quota).alias("over"))


def daily_counts(events: DataFrame, zone: str = "UTC", delay: str = "1 day") -> DataFrame:
    """Events of each calendar day in a zone; the window starts at the zone's midnight."""
    start = {"UTC": "0 hours", "Asia/Tokyo": "15 hours"}[zone]
    counts = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day", "1 day", start), "event_name").agg(F.count("*").alias("value"))
    return counts.select(F.to_date(F.from_utc_timestamp(F.col("window.start"), zone)).alias("metric_date"), "event_name", "value")


def _bucket(rate: float, burst: float):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.getOption or (burst, None)
        rows = pd.concat(list(frames)).sort_values("at_ms", kind="stable")
        allowed = []
        for at in rows["at_ms"].tolist():
            tokens = min(burst, tokens + (0 if last is None else max(0, at - last) / 1000 * rate))
            last = at if last is None else max(at, last)
            allowed.append(tokens >= 1)
            tokens -= 1 if allowed[-1] else 0
        state.update((tokens, last))
        state.setTimeoutTimestamp(max(last + int(burst / rate * 1000), state.getCurrentWatermarkMs()) + 1000)
        yield rows.assign(key_id=key[0], allowed=allowed)[["key_id", "request_id", "at_ms", "allowed"]]

    return run


def token_buckets(requests: DataFrame, rate: float, burst: float, delay: str = "10 minutes") -> DataFrame:
    """Requests (key_id, request_id, at_ms) let through by a token bucket per key.

    A key is forgotten when event time, as far as the watermark knows it, has filled its bucket; no
    clock of the machine takes part, so a stream without new rows comes to rest.
    """
    timed = requests.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", delay)
    return timed.groupBy("key_id").applyInPandasWithState(_bucket(rate, burst), "key_id string, request_id string, at_ms long, allowed boolean", "tokens double, last long", "append", GroupStateTimeout.EventTimeTimeout)


def quarantines(decisions: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Quarantined decisions (decision_id, decided_ms, until_ms), and their release when event time passes the deadline.

    A decision's quarantine is a session from its time to the millisecond after its deadline, or after its own
    time if that is later; those of one decision that meet are one, which ends with the last.  So state, merging
    and expiry are Spark's own, without a Python call a decision.  Every row is told as quarantined, also one that comes
    late; one without a deadline, or that comes after event time has passed it, is not released.
    """
    timed = decisions.withColumn("at", F.timestamp_millis("decided_ms")).withWatermark("at", delay)
    gap = F.make_interval(secs=((F.greatest("until_ms", "decided_ms") - F.col("decided_ms") + 1) / 1000).cast("decimal(18,6)"))
    held = timed.where("until_ms is not null").groupBy("decision_id", F.session_window("at", gap)).agg(F.max("until_ms").alias("until_ms"))
    told = decisions.select("decision_id", "until_ms", F.lit("quarantined").alias("status"))
    return told.unionByName(held.select("decision_id", "until_ms", F.lit("released").alias("status")))


def _withdrawn(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values("processing_sequence", kind="stable")
    since = state.getOption[0] if state.exists else None
    out = []
    for record, sequence, withdrawn in zip(rows["record_id"], rows["processing_sequence"], rows["withdraws"]):
        if withdrawn:
            since = int(sequence)
        out.append((record, *key, int(sequence), since))
    if since is not None:
        state.update((since,))
    yield pd.DataFrame(out, columns=["record_id", "tenant_id", "installation_key_id", "processing_sequence", "withdrawn_at_sequence"]).astype({"withdrawn_at_sequence": "Int64"})


def withdrawals(records: DataFrame) -> DataFrame:
    """Records (tenant_id, installation_key_id, record_id, event_name, consent_state, processing_sequence) with the sequence of the last withdrawal of their installation key up to them.

    The state is one number a key, kept for good: a withdrawal holds for all that comes later.
    """
    marked = records.withColumn("withdraws", F.coalesce((F.col("event_name") == "consent_changed") & F.col("consent_state").isin("withdrawn", "denied"), F.lit(False)))
    schema = "record_id string, tenant_id string, installation_key_id string, processing_sequence long, withdrawn_at_sequence long"
    return marked.groupBy("tenant_id", "installation_key_id").applyInPandasWithState(_withdrawn, schema, "since long", "append", GroupStateTimeout.NoTimeout)


def drained_postbacks(inbox: DataFrame) -> DataFrame:
    """An inbox of query strings (inbox_id, query, received_at) as decoded postbacks, processed or rejected with their error."""
    from larkspur.sources.connectors import query_postbacks

    return query_postbacks(inbox).withColumn("status", F.when(F.col("error").isNull(), "processed").otherwise("rejected"))


def since_install(installs: DataFrame, events: DataFrame, days: int, delay: str = "1 day") -> DataFrame:
    """Events (installation_id, occurred_at) within days of their install (installation_id, installed_at), stream against stream.

    The bound on time lets Spark drop the state of both sides when the watermark has passed it.
    """
    a = installs.withWatermark("installed_at", delay).alias("i")
    b = events.withWatermark("occurred_at", delay).alias("e")
    near = F.expr(f"e.installation_id = i.installation_id and e.occurred_at >= i.installed_at and e.occurred_at < i.installed_at + interval {int(days)} days")
    return b.join(a, near).select("e.*", F.col("i.installed_at").alias("installed_at"))


def drained(deliveries: list[DataFrame], flow: Callable[[Callable[[], DataFrame]], DataFrame], shared: str) -> DataFrame:
    """What a stream tells of deliveries that land one after another in a folder that the cluster shares.

    flow gets a reader of what has landed and may read more than once.  The stream ends after each
    delivery and goes on from its checkpoint with the next, so its state outlives its process.
    """
    spark, schema = deliveries[0].sparkSession, deliveries[0].schema
    told = None
    for rows in deliveries:
        rows.write.mode("append").parquet(f"{shared}/landed")
        told = flow(lambda: spark.readStream.schema(schema).parquet(f"{shared}/landed"))
        writer = told.writeStream.format("parquet").option("path", f"{shared}/told").option("checkpointLocation", f"{shared}/state")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{shared}/told")


def append_idempotent(df: DataFrame, target: str, keys: list[str], checkpoint: str, interval: str | None = None, against_stored: bool = False) -> StreamingQuery:
    """Write a stream to a Parquet folder, one subfolder a batch; a replayed batch replaces its own.

    Subfolders are named by a digest of the rows, so the same batch is stored once, also by a stream that
    starts anew with its checkpoint lost, and other batches of such a stream replace nothing.  Repeats
    within a batch go by keys.  With against_stored a batch also leaves out the keys that are stored (a
    scan of the key columns a batch), so that rows which come again in another batch, as after a lost
    checkpoint, are stored once; without it they are for the stream's keyed state
    (``stateful.decisions``, ``resolved``).
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(keys)
        if against_stored and stored(batch.sparkSession, target):
            rows = rows.join(batch.sparkSession.read.schema(batch.schema).parquet(target).select(*keys), keys, "left_anti")
        rows = rows.persist()
        try:
            n, hashed = rows.agg(F.count("*"), F.sum(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)"))).first()
            if n:
                rows.write.mode("overwrite").parquet(f"{target}/batch={n}-{hashlib.sha256(str(hashed).encode()).hexdigest()[:24]}")
        finally:
            rows.unpersist()

    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def stored(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
