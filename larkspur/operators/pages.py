"""References of scopes of any size as pages: sorted, numbered, digested, and never in one cell.

References are written once in ranges of (scope, reference); a reference's place is its place in the range plus
the rows of its scope in the ranges before.  A page is a bounded number of places, so no task or cell holds a
scope, and a hot scope lies in as many ranges as it fills.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stored import checkpointed


def numbered(df: DataFrame, scope: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df with ``place``, the number from 0 of a row in its scope by order."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*scope, *order]
    rows = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    rows = checkpointed(rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    counts = rows.groupBy(*scope, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*scope).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.withColumn("_shift", F.coalesce(before, F.lit(0)) - F.col("_first"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*scope, "_part"]]
    return rows.alias("r").join(shifts.alias("s"), same).select(*[F.col(f"r.{c}") for c in df.columns], (F.col("_at") + F.col("_shift")).alias("place"))


def evidence_pages(records: DataFrame, scope: list[str], ref: str = "record_id", size: int = 1000, parts: int | None = None) -> DataFrame:
    """(scope, page, refs, digest): the distinct references of each scope in order, ``size`` a page, with the digest of each page.

    Null references are left out; a scope without any has no page.
    """
    one = records.where(F.col(ref).isNotNull()).select(*scope, F.col(ref).cast("string").alias("_ref")).distinct()
    placed = numbered(one, scope, ["_ref"], parts).withColumn("page", F.expr(f"place div {int(size)}"))
    pages = placed.groupBy(*scope, "page").agg(F.sort_array(F.collect_list("_ref")).alias("refs"))
    return pages.withColumn("digest", F.sha2(F.to_json("refs"), 256))


def pages_digest(pages: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, refs_digest, refs, pages): the digest that the array of all references of a scope would have, and their numbers.

    A task streams the pages of its scopes in order and holds one page.
    """
    kinds = dict(pages.dtypes)
    names = [*scope, "refs_digest", "refs", "pages"]

    def run(batches):
        key, now, refs, count, types = None, None, 0, 0, []
        out: list[tuple] = []

        def done():
            now.update(b"]")
            out.append((*key, now.hexdigest(), refs, count))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [*types, pa.string(), pa.int64(), pa.int64()])], names)

        for part in batches:
            types = [part.schema.field(i).type for i in range(len(scope))]
            for *own, text, n in zip(*(c.to_pylist() for c in part.columns)):
                if tuple(own) != key:
                    if key is not None:
                        done()
                    key, now, refs, count = tuple(own), hashlib.sha256(b"["), 0, 0
                now.update((b"," if count else b"") + text[1:-1].encode())
                refs, count = refs + n, count + 1
            if out:
                yield batch()
                out.clear()
        if key is not None:
            done()
            yield batch()

    rows = pages.select(*scope, "page", F.to_json("refs").alias("text"), F.size("refs").alias("n")).repartition(*scope).sortWithinPartitions(*scope, "page")
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in scope), "refs_digest string", "refs long", "pages long"])
    return rows.drop("page").mapInArrow(run, schema)
