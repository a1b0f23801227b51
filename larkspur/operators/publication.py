"""Publishing snapshots under keys that follow from their content, and exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_key(columns: list[str]) -> Column:
    """The digest of a row's values in canonical form, nulls included."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns, key=lambda c: c.encode("utf-16-be"))]), {"ignoreNullFields": "false"}), 256)


def publish(rows: DataFrame, stored: DataFrame, keys: list[str], key: str = "input_snapshot_id") -> DataFrame:
    """The snapshots that are not stored yet, with their key.

    A row's key is a digest of its values, so a rerun finds it stored and a changed row gets another key beside
    the old one.  Stored rows are never changed: a stored row whose key does not follow from its values raises, and so do
    two rows of one identity (``keys``) in one publication.
    """
    values = rows.columns
    made = rows.withColumn(key, snapshot_key(values))
    twice = F.count("*").over(Window.partitionBy(*keys))
    made = made.withColumn("_n", twice).withColumn(key, F.when(F.col("_n") > 1, F.raise_error(F.lit("snapshot_identity_repeated"))).otherwise(F.col(key)).cast("string")).drop("_n")
    sound = stored.withColumn("_own", snapshot_key(values)).select(*keys, F.when(F.col("_own") == F.col(key), F.col(key)).otherwise(F.raise_error(F.lit("snapshot_content_conflict"))).cast("string").alias(key))
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*keys, key]]
    return made.alias("m").join(sound.alias("s"), same, "left_anti").select("m.*")


def latest_snapshots(stored: DataFrame, keys: list[str], at: str = "computed_at") -> DataFrame:
    """Of each identity the snapshot that was computed last."""
    from .ledger import latest_by

    return latest_by(stored, keys, [at])


def daily_job(day: str, clicks: DataFrame, installs: DataFrame, sources: list[str], folder: str, computed_at: str) -> int:
    """Aggregate the source days of a day and publish them to a folder; the number of snapshots that were added.

    Run again for the same day and input it adds nothing; late clicks or installs add a snapshot of their group only.
    """
    from .fraud import SCOPE, source_days

    spark, keys = clicks.sparkSession, [*SCOPE, "day", *sources]
    days = source_days(clicks.where(F.col("day") == F.lit(day)), installs, sources)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    schema = days.withColumn("input_snapshot_id", F.lit("")).withColumn("computed_at", F.lit(computed_at)).schema
    stored = spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema)
    fresh = publish(days, stored.where(F.col("day") == F.lit(day)), keys).withColumn("computed_at", F.lit(computed_at)).cache()
    try:
        count = fresh.count()
        if count:
            fresh.write.mode("append").parquet(folder)
        return count
    finally:
        fresh.unpersist()


#: Values of a group that share a bin of a histogram: what one task holds of a group.
BIN = 1 << 16


def quantiles(rows: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(groups, n, one double column a share) of a long column, exact and interpolated, for groups of any size.

    A histogram of bins of ``BIN`` values tells the bin of each wanted rank; only the rows of these bins are counted by
    value, and the ranks are found among their distinct values.  So no task sorts or keeps a group: a bin
    has at most ``BIN`` distinct values.  Null values are left out; groups of nulls only have no row.
    """
    keyed = rows.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("long").alias("_v"), F.floor(F.col(value) / F.lit(BIN)).cast("long").alias("_bin"))
    up = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    bins = keyed.groupBy(*groups, "_bin").agg(F.count("*").alias("_c"))
    bins = bins.withColumn("_below", F.coalesce(F.sum("_c").over(up(*groups).orderBy("_bin")), F.lit(0))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*groups)))
    at = {name: F.lit(share) * (F.col("_n") - 1) for name, share in shares.items()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in at.values()])))
    wanted = bins.select(*groups, "_bin", "_below", "_n", F.filter(ranks, lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("_c"))).alias("_ranks")).where(F.size("_ranks") > 0)
    same = [F.col(f"k.{g}").eqNullSafe(F.col(f"w.{g}")) for g in [*groups, "_bin"]]
    counted = keyed.alias("k").join(wanted.alias("w"), same, "left_semi").groupBy(*[F.col(f"k.{g}").alias(g) for g in groups], "_bin", "_v").agg(F.count("*").alias("_c"))
    placed = counted.alias("k").join(wanted.alias("w"), same).select("k.*", "_below", "_n", "_ranks")
    first = F.col("_below") + F.coalesce(F.sum("_c").over(up(*groups, "_bin").orderBy("_v")), F.lit(0))
    hits = placed.withColumn("_first", first).select(*groups, "_n", "_v", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col("_c")))).alias("_rank"))
    found = hits.groupBy(*groups).agg(F.max("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_by"))

    def share(p: Column) -> Column:
        low, high = F.floor(p), F.ceil(p)
        a, b = F.element_at("_by", low).cast("double"), F.element_at("_by", high).cast("double")
        return F.when(low == high, a).otherwise((high - p) * a + (p - low) * b)

    return found.select(*groups, F.col("_n").alias("n"), *[share(p).alias(name) for name, p in at.items()])

