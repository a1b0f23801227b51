"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

The documents of a source stand in one order (size, doc_id bucket, doc_id); the prefix sum of expected
copies plus one random offset of the source is followed along that order, and a document is emitted
once for each integer that the sum crosses.  Every document expects target / source_size copies, but
for what large documents (over ``LARGE`` of the target each, so a few hundred in a source) cannot come
to: these are followed first, from the largest down and with an offset of one half, and what they take
too much or too little is spread over the expectation of the others.  So the words taken miss the target
by a document of less than ``LARGE`` of it, unless there are too few words in small documents.

Documents with one expectation make the prefix sum a rank times that expectation.  The rank is built
from counts: of smaller sizes in the source, of lower buckets within (source, size), and of lower
doc_ids within (source, size, bucket).  No window sees all rows of a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\\x20\\x09-\\x0D]+"
#: Parts of the documents that have one source and one size.
BUCKETS = 256
#: Tasks over which a source's buckets are dealt when they meet its target.
SALTS = 64
SHARE = 1.5
WEIGHTS = (3, 1, 2)
#: Share of its source's target from which on a document is large.
LARGE = 0.0025


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, size): one row a source.

    Targets are weight x level, stopped at most x source_size; the level is the one at which they
    add up to share x all sizes, which is where repeated resharing of the excess ends.  The windows
    run over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    pick = "case " + " ".join(f"when (rank - 1) % {len(weights)} = {i} then {w}" for i, w in enumerate(weights)) + " end"
    ranked = per.withColumn("rank", F.row_number().over(order)).withColumn("weight", F.expr(pick).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.partitionBy(F.lit(1)).orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    levels = ranked.withColumn("all", F.sum("source_size").over(every) * F.lit(share)).withColumn("full", F.coalesce(F.sum("cap").over(up), F.lit(0.0)))
    levels = levels.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
    levels = levels.withColumn("level", (F.col("all") - F.col("full")) / F.col("open"))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(every)
    return levels.withColumn("found", first["level"]).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("found"), F.col("cap"))).alias("target"))


def plan(docs: DataFrame, share: float = SHARE, seed: int = 7, most: int = 2) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, ordinal) per row of docs.

    Null texts have size 0; the null source is a source, the last in order.  Rows with equal doc_id
    are separate documents.  A source without words has target 0 and gets no copies.  Reruns agree:
    the offset is a digest of source and seed.  Texts of any length are counted whole, ties in size go
    by doc_id, other columns are not looked at, an empty table gives an empty result.
    """
    rows = docs.select("doc_id", "source", F.coalesce(F.expr(f"regexp_count(text, '{WORD}')"), F.lit(0)).cast("long").alias("size"))
    return deal(rows, share, seed, most)


def deal(rows: DataFrame, share: float = SHARE, seed: int = 7, most: int = 2) -> DataFrame:
    """plan() over (doc_id, source, size)."""
    rows = rows.withColumn("bucket", F.coalesce(F.pmod("doc_id", F.lit(BUCKETS)), F.lit(0)).cast("long"))
    buckets = rows.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = buckets.withColumn("lower", F.coalesce(F.sum("n").over(before(Window.partitionBy("source", "size").orderBy("bucket"))), F.lit(0)))
    levels = buckets.groupBy("source", "size").agg(F.sum("n").alias("n"))
    levels = levels.withColumn("smaller", F.coalesce(F.sum("n").over(before(Window.partitionBy("source").orderBy("size"))), F.lit(0))).withColumn("docs", F.sum("n").over(Window.partitionBy("source")))
    goal = targets(buckets.select("source", (F.col("size") * F.col("n")).alias("size")), share, most=most)
    offset = F.conv(F.substring(F.md5(F.concat(F.coalesce("source", F.lit("")), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    goal = goal.withColumn("each", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("offset", offset)
    same = lambda a, b, on: [a[c].eqNullSafe(b[c]) for c in on]
    until = lambda offset, place, each: F.floor(offset + place * each)
    half, large = F.lit(0.5), F.col("size") > F.col("target") * F.lit(LARGE)
    top = F.col("docs") - F.col("smaller") - F.col("n")  # documents that are larger
    heavy = levels.alias("l").join(goal.alias("g"), F.col("l.source").eqNullSafe(F.col("g.source"))).select("l.*", "target", "each").where(large)
    heavy = heavy.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("large_size"), F.sum(F.col("size") * (until(half, top + F.col("n"), F.col("each")) - until(half, top, F.col("each")))).alias("large_taken"))
    left = F.col("source_size") - F.coalesce("large_size", F.lit(0))
    rest = F.when(left > 0, F.least(F.lit(float(most)), F.greatest(F.lit(0.0), (F.col("target") - F.coalesce("large_taken", F.lit(0))) / left))).otherwise(0.0)
    goal = goal.alias("g").join(heavy.alias("h"), F.col("g.source").eqNullSafe(F.col("h.source")), "left").select("g.*", rest.alias("rest"))
    x = parts.alias("p").join(levels.alias("l"), same(parts, levels, ("source", "size"))).select("p.source", "p.size", "p.bucket", "docs", (F.col("lower") + F.col("smaller")).alias("base"))
    salted = goal.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a hot source lies in as many tasks
    x = x.alias("x").join(salted.alias("g"), F.col("x.source").eqNullSafe(F.col("g.source")) & (F.pmod(F.col("x.bucket"), F.lit(SALTS)) == F.col("g.salt"))).select("x.*", "source_size", "target", "each", "rest", "offset")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("doc_id")))
    out = ranked.alias("r").join(x.alias("x"), [F.col(f"r.{c}").eqNullSafe(F.col(f"x.{c}")) for c in ("source", "size", "bucket")])
    place = F.col("base") + F.col("rank")
    down = F.col("docs") - place
    copies = F.when(F.col("r.size") > F.col("target") * F.lit(LARGE), until(half, down + 1, F.col("each")) - until(half, down, F.col("each"))).otherwise(until(F.col("offset"), place, F.col("rest")) - until(F.col("offset"), place - 1, F.col("rest")))
    return out.select("doc_id", F.col("r.source").alias("source"), F.col("r.size").alias("size"), "source_size", "target", F.least(copies, F.lit(most)).alias("copies"), F.col("rank").alias("ordinal"))


def mixed(docs: DataFrame, share: float = SHARE, seed: int = 7) -> DataFrame:
    """docs with every row repeated as often as the mix takes it.

    Rows that share doc_id, source and size are told apart by their ordinal only in number: the
    copies that they get together are handed to them in the order of their text.  Null texts have size 0
    and may be taken, the null source is a source, texts of any length are counted whole, and a null doc_id
    stands before the others of its size.  Other columns are carried along, whatever their names; an empty
    table gives an empty result.
    """
    size, twin = "_mixing_size", "_mixing_twin"
    sized = docs.withColumn(size, F.coalesce(F.expr(f"regexp_count(text, '{WORD}')"), F.lit(0)).cast("long"))
    dealt = deal(sized.select("doc_id", "source", F.col(size).alias("size")), share, seed)
    dealt = dealt.withColumn(twin, F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("ordinal"))).where("copies > 0").select(F.col("doc_id").alias("_mixing_d"), F.col("source").alias("_mixing_s"), F.col("size").alias("_mixing_z"), F.col("copies").alias("_mixing_n"), F.col(twin).alias("_mixing_t"))
    sized = sized.withColumn(twin, F.row_number().over(Window.partitionBy("doc_id", "source", size).orderBy("text")))
    on = sized["doc_id"].eqNullSafe(dealt["_mixing_d"]) & sized["source"].eqNullSafe(dealt["_mixing_s"]) & (sized[size] == dealt["_mixing_z"]) & (sized[twin] == dealt["_mixing_t"])
    return sized.join(dealt, on).withColumn("_mixing_copy", F.explode(F.expr("sequence(1, cast(_mixing_n as int))"))).select(*[sized[c] for c in docs.columns])


def query(spark, sf_dir):
    from .common import read

    return plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM per
), weighed AS (
  SELECT *, CAST(CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, source_size * CAST(2.0 AS DOUBLE) AS cap FROM ranked
), levels AS (
  SELECT *, cap / weight AS ratio, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS everything,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS filled,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS remaining FROM weighed
), found AS (
  SELECT arg_min((everything - filled) / remaining, (ratio, rank)) AS level FROM levels WHERE (everything - filled) / remaining <= ratio
), goal AS (
  SELECT source, source_size, least(cap, coalesce(weight * level, cap)) AS target,
    CAST(('0x' || substr(md5(coalesce(source, '') || ':7'), 1, 8)) AS BIGINT) / CAST(4294967296.0 AS DOUBLE) AS shift FROM levels, found
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, coalesce(((doc_id % 256) + 256) % 256, 0), doc_id NULLS FIRST) AS place, count(*) OVER (PARTITION BY source) AS docs FROM sized
), dealt AS (
  SELECT p.doc_id, p.source, p.size, g.source_size, g.target, g.shift, p.place, p.docs, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS each, p.size > g.target * CAST(0.0025 AS DOUBLE) AS heavy
  FROM placed p JOIN goal g ON p.source IS NOT DISTINCT FROM g.source
), down AS (
  SELECT *, floor(0.5 + (docs - place + 1) * each) - floor(0.5 + (docs - place) * each) AS large_copies FROM dealt
), spare AS (
  SELECT source, any_value(source_size) AS source_size, any_value(target) AS target, coalesce(sum(size) FILTER (heavy), 0) AS large_size, coalesce(sum(large_copies * size) FILTER (heavy), 0) AS large_taken FROM down GROUP BY source
), rests AS (
  SELECT source, CASE WHEN source_size > large_size THEN least(2.0, greatest(0.0, (target - large_taken) / (source_size - large_size))) ELSE 0.0 END AS rest FROM spare
)
SELECT doc_id, size, source_size, target,
  CAST(least(CASE WHEN heavy THEN large_copies ELSE floor(shift + place * rest) - floor(shift + (place - 1) * rest) END, 2) * size AS BIGINT) AS taken FROM down d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source
"""
