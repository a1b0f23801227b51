"""Executing deletions: what requests reach in every table, and the rows that each ledger gets for it.

All is decided for all requests together.  Scopes nest: an installation's records are those of its facts, an
app's and a tenant's are all their raw records.  Ledgers are append-only, so an execution is a set of rows
that are anti-joined with what is stored by the key of their ledger; a second execution adds nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import canon

from .privacy import SCOPE
from .stored import checkpointed

#: The ledgers that an execution appends to, with the key of each.
KEYS = {
    "states": ["record_id", "lifecycle_status"],
    "tombstones": ["tenant_id", "app_id", "privacy_request_id", "record_id"],
    "corrections": ["correction_id"],
    "purges": ["privacy_request_id", "ref"],
    "audit": ["privacy_request_id"],
}


def _parts(df: DataFrame) -> int:
    """Four tasks a core, or the shuffle partitions if these are fewer: small tasks of small tables would mostly open files."""
    spark = df.sparkSession
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _wide(rows: DataFrame, asked: DataFrame, on: list[str], of: str) -> DataFrame:
    """rows with the few requests for their app or tenant (``on``).

    A tenant can have most of the rows: they are dealt by a hash of the column ``of`` beside the scope, and each part
    gets the requests.  These alone are held in a task; rows stream by unsorted.
    """
    parts = _parts(rows)
    asked = asked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.withColumn("_part", F.pmod(F.xxhash64(of), F.lit(parts)).cast("int")).join(asked.hint("shuffle_hash"), [*on, "_part"]).drop("_part")


def reached_records(requests: DataFrame, facts: list[DataFrame], raw: DataFrame) -> DataFrame:
    """(tenant_id, app_id, privacy_request_id, deletion_scope, completed_at, record_id) of pending requests.

    facts: tables with tenant_id, app_id, installation_id, record_id; raw: all raw records.  A record keeps its own
    app, also where a request for the tenant reaches it.  Rows are dealt into a fixed number of parts, since their
    bytes shrink so much in a shuffle that parts put together by size would be many rows.
    """
    ids = reduce(DataFrame.unionByName, [f.select(*SCOPE, "installation_id", "record_id") for f in facts]).where("installation_id is not null")
    told = ["privacy_request_id", "deletion_scope", "completed_at"]
    ask = lambda scope, *c: requests.where(F.col("deletion_scope") == scope).select(*c, *told)
    one = ids.repartition(_parts(raw), *SCOPE, "installation_id").join(ask("installation", *SCOPE, "installation_id"), [*SCOPE, "installation_id"])
    every = raw.select(*SCOPE, "record_id")
    found = [one, _wide(every, ask("app", *SCOPE), SCOPE, "record_id"), _wide(every, ask("tenant", "tenant_id"), ["tenant_id"], "record_id")]
    return reduce(DataFrame.unionByName, [x.select(*SCOPE, *told, "record_id") for x in found]).repartition(_parts(raw), "record_id").distinct()


def purges(requests: DataFrame, reached: DataFrame, raw: DataFrame, inbox: DataFrame, batches: DataFrame, members: DataFrame, answers: DataFrame) -> DataFrame:
    """(tenant_id, app_id, privacy_request_id, ref): the payloads that requests purge.

    raw: record_id, raw_payload_ref; inbox: record_id, ref; batches: ingest_batch_id, body_ref, installation_id;
    members: ingest_batch_id, record_id; answers: record_id, ref; all with tenant and app.  For an installation an encrypted payload
    goes only if no record outside of the request shares it in the tenant, and a batch only if all its records are
    reached; an app or a tenant loses all its payloads.
    """
    # As in the reach, rows are dealt into a fixed number of parts; what many records share is counted before.
    dealt = lambda rows, *on: rows.repartition(_parts(raw), *on)
    own = dealt(reached.where("deletion_scope = 'installation'").select(*SCOPE, "record_id", "privacy_request_id"), *SCOPE, "record_id")
    encrypted = raw.where("raw_payload_ref like 'encrypted:%'").select(*SCOPE, "record_id", F.col("raw_payload_ref").alias("ref"))
    # Uses of a payload in its tenant, and those that a request reaches: equal if nothing else shares it.
    uses = dealt(encrypted.groupBy("tenant_id", "ref").agg(F.count("*").alias("uses")), "tenant_id", "ref")
    mine = dealt(encrypted.join(own, [*SCOPE, "record_id"]).groupBy("tenant_id", "privacy_request_id", "ref").agg(F.min("app_id").alias("app_id"), F.count("*").alias("mine")), "tenant_id", "ref")
    alone = mine.join(uses, ["tenant_id", "ref"]).where("uses = mine").select(*SCOPE, "privacy_request_id", "ref")
    batch = [*SCOPE, "ingest_batch_id"]
    held = dealt(members.groupBy(*batch).agg(F.count("*").alias("n")), *batch)
    named = requests.where("deletion_scope = 'installation'").select(*SCOPE, "installation_id", "privacy_request_id")
    keyed = batches.join(named, [*SCOPE, "installation_id"]).select(*batch, "privacy_request_id", F.lit(0).alias("hit"))
    touched = members.join(own, [*SCOPE, "record_id"]).select(*batch, "privacy_request_id", F.lit(1).alias("hit")).unionByName(keyed)
    whole = dealt(touched.groupBy(*batch, "privacy_request_id").agg(F.sum("hit").alias("hit")), *batch).join(held, batch, "left").where("hit = coalesce(n, 0)")
    bodies = whole.join(dealt(batches.select(*batch, F.col("body_ref").alias("ref")), *batch), batch).select(*SCOPE, "privacy_request_id", "ref")
    told = reduce(DataFrame.unionByName, [x.select(*SCOPE, "record_id", "ref") for x in (inbox, answers)])
    small = told.join(own, [*SCOPE, "record_id"]).select(*SCOPE, "privacy_request_id", "ref")
    # All payloads of an app or a tenant, by whatever holds them.
    every = reduce(DataFrame.unionByName, [encrypted, told, batches.select(*SCOPE, F.col("ingest_batch_id").alias("record_id"), F.col("body_ref").alias("ref"))])
    ask = lambda scope, *c: requests.where(F.col("deletion_scope") == scope).select(*c, "privacy_request_id")
    large = [_wide(every, ask("app", *SCOPE), SCOPE, "record_id"), _wide(every, ask("tenant", "tenant_id"), ["tenant_id"], "record_id")]
    found = reduce(DataFrame.unionByName, [x.select(*SCOPE, "privacy_request_id", "ref") for x in (alone, bodies, small, *large)]).where("ref is not null")
    return found.groupBy("privacy_request_id", "ref").agg(F.min("tenant_id").alias("tenant_id"), F.min("app_id").alias("app_id"))


def execute(requests: DataFrame, facts: list[DataFrame], raw: DataFrame, inbox: DataFrame, batches: DataFrame, members: DataFrame, answers: DataFrame) -> dict[str, DataFrame]:
    """The rows of an execution by ledger (the keys of ``KEYS``), before what is stored is taken off.

    requests: privacy_request_id, tenant_id, app_id, deletion_scope (installation, app, tenant), installation_id,
    completed_at.  A record that several requests reach gets the state of the first to complete, and a tombstone
    and a correction of each.  The reach is told once, so all ledgers get the same records.
    """
    reached = checkpointed(reached_records(requests, facts, raw))
    at, status = F.col("completed_at"), F.lit("purged")
    first = reached.groupBy("record_id").agg(F.min(F.struct("completed_at", "privacy_request_id", *SCOPE)).alias("f")).select("f.*", "record_id")
    states = first.select(*SCOPE, "record_id", status.alias("lifecycle_status"), at.alias("changed_at"), "privacy_request_id", F.concat_ws(":", F.lit("tombstone"), "privacy_request_id", "record_id").alias("privacy_tombstone_id"))
    digest = lambda *c: canon.digest_array([F.col(x) for x in c])
    tombstones = reached.select(*SCOPE, "privacy_request_id", "record_id", status.alias("lifecycle_status"), F.lit("privacy_deletion").alias("reason_code"), digest("privacy_request_id", "record_id", "completed_at").alias("provenance_digest"), at.alias("created_at"))
    corrections = reached.select(*SCOPE, F.concat(F.lit("correction:"), F.substring(digest("privacy_request_id", "record_id"), 1, 48)).alias("correction_id"), F.col("record_id").alias("corrects_record_id"), F.lit("redaction").alias("correction_type"), F.lit("privacy_deletion").alias("correction_reason"), at.alias("effective_at"))
    counts = reached.groupBy("privacy_request_id").agg(F.count("*").alias("records"))
    audit = requests.join(counts, "privacy_request_id", "left").select(*SCOPE, "privacy_request_id", "deletion_scope", F.lit("privacy_delete").alias("action"), F.coalesce("records", F.lit(0)).alias("records"), at.alias("occurred_at"))
    return {"states": states, "tombstones": tombstones, "corrections": corrections, "purges": purges(requests, reached, raw, inbox, batches, members, answers), "audit": audit}


def added(rows: DataFrame, stored: DataFrame, ledger: str) -> DataFrame:
    """The rows that a ledger does not have yet; of rows with one key the first in order stays.

    Stored keys come first among the rows of their key, so one sort decides; null keys are equal.
    """
    keys = KEYS[ledger]
    rest = [c for c in rows.columns if c not in keys]
    known = stored.select(*keys, *[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c in rest], F.lit(0).alias("_new"))
    both = rows.withColumn("_new", F.lit(1)).unionByName(known)
    one = Window.partitionBy(*keys).orderBy("_new", *rest)
    # Without a row before it; a row_number would be followed back before the shuffle, and sorted there too.
    return both.withColumn("_before", F.lag("_new").over(one)).where("_before is null and _new = 1").select(*rows.columns)


def append(execution: dict[str, DataFrame], folder: str) -> None:
    """Append an execution to the ledgers' folders; what they have stays, and a repeated execution adds nothing."""
    for ledger, rows in execution.items():
        spark, path = rows.sparkSession, f"{folder}/{ledger}"
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path)
        stored = spark.read.schema(rows.schema).parquet(path) if there else rows.where("false")
        added(rows, stored, ledger).write.mode("append").parquet(path)
