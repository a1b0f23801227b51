"""Views over append-only ledgers: the latest of each key, supersession, guards and fan-out.

Each is one shuffle on its key; nothing here sees more than a key's rows together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, which may mix directions and nulls.

    A window limited to its first row keeps one row a key on the map side before the shuffle; ``latest_by``
    does the same by aggregation where the order is ascending columns.
    """
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def latest_by(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row with the largest (by...) of each key, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys and c not in by]
    top = df.groupBy(*keys).agg(F.max(F.struct(*by, *rest)).alias("_top"))
    return top.select(*keys, "_top.*").select(*df.columns)


def not_superseded(df: DataFrame, key: str = "id", supersedes: str = "supersedes_id") -> DataFrame:
    """Rows that no other row names as its predecessor."""
    named = df.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(key)).distinct()
    return df.join(named, key, "left_anti")


def with_superseded_flag(df: DataFrame, key: str = "id", supersedes: str = "supersedes_id", flag: str = "superseded") -> DataFrame:
    named = df.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(key)).distinct().withColumn("_hit", F.lit(True))
    return df.join(named, key, "left").withColumn(flag, F.col("_hit").isNotNull()).drop("_hit")


def net_of(df: DataFrame, exclusions: DataFrame, key: str, excluded_key: str, exclusion_id: str, supersedes: str) -> DataFrame:
    """Rows of df without those that an exclusion names which is itself not superseded."""
    live = not_superseded(exclusions, exclusion_id, supersedes).select(F.col(excluded_key).alias(key)).distinct()
    return df.join(live, key, "left_anti")


def unique_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str, fields: list[str], prefix: str = "m_") -> DataFrame:
    """left with the number of right rows of its key, and the fields of the match if there is one only.

    Right is reduced to a row a key before the join, so that ambiguous keys do not multiply rows.
    """
    one = right.where(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("_k")).agg(F.count("*").alias(f"{prefix}count"), F.min(F.struct(*fields)).alias("_one"))
    picked = [F.when(F.col(f"{prefix}count") == 1, F.col(f"_one.{f}")).alias(f"{prefix}{f}") for f in fields]
    one = one.select("_k", f"{prefix}count", *picked)
    return left.join(one, F.col(left_key) == F.col("_k"), "left").drop("_k").withColumn(f"{prefix}count", F.coalesce(f"{prefix}count", F.lit(0)))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str, out: str) -> DataFrame:
    """left with the value of the last right row of its key at or before its time (null: none).

    Both sides are unioned and scanned once in order of time; at equal times right rows come first.
    """
    a = left.select("*", F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"))
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    order = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(out, F.last("_v", ignorenulls=True).over(order)).where("_side = 1").drop("_t", "_side", "_v")


def overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_keys: str, right_keys: str, scope: list[str]) -> DataFrame:
    """(scope, left_id, right_id) of rows in one scope whose arrays of keys share an element."""
    a = left.select(*scope, left_id, F.explode(F.array_distinct(left_keys)).alias("_key"))
    b = right.select(*scope, right_id, F.explode(F.array_distinct(right_keys)).alias("_key"))
    return a.join(b, [*scope, "_key"]).select(*scope, left_id, right_id).distinct()


def fan_out(df: DataFrame, series: dict[str, Column], keep: list[str], name: str = "series") -> DataFrame:
    """A row for each series whose condition a row meets."""
    hits = F.filter(F.array(*[F.when(cond, F.lit(label)) for label, cond in series.items()]), lambda x: x.isNotNull())
    return df.select(*keep, F.explode(hits).alias(name))


def unshared(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key no row of others uses."""
    return df.join(others.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def append_once(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, one a key, whose key is not stored yet: what an idempotent append writes."""
    return new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def page(df: DataFrame, order: list[str], after: tuple | None, limit: int) -> DataFrame:
    """A keyset page: rows after a key in ascending order, one more than the limit to tell if more follow."""
    if after is not None:
        kinds = dict(df.dtypes)
        df = df.where(F.struct(*order) > F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, after)]))
    return df.orderBy(*order).limit(limit + 1)
