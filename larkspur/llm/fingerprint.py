"""Document fingerprints: a wide digest of the canonical text, exact by comparing bytes.

The canonical text is NFKC-normalised, case-folded and has runs of white space folded to one space;
its fingerprint is 128-bit XXH3.  Texts are alike (1.0) if their fingerprints and then their
canonical bytes are equal, else not (0.0).
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, prepared


def canonical(text: str | None) -> str:
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def digest(canon: str) -> str:
    return xxhash.xxh3_128_hexdigest(canon.encode("utf-8", "surrogatepass"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, canon) per row of docs; null and empty texts are alike."""

    def run(batches):
        for batch in batches:
            canon = [canonical(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(x) for x in canon], pa.string()), pa.array(canon, pa.string())], ["doc_id", "fingerprint", "canon"])

    prepared(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fingerprint string, canon string")


#: Fingerprints with company that may be broadcast; beyond it they are joined by a shuffle.
FEW = 1 << 18


def exact_groups(docs: DataFrame, prints: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """prints (by default doc_id and fingerprint of each row of docs) with group_id, the smallest doc_id of equal canonical texts.

    Buckets of one fingerprint are counted first; only texts of buckets with company are shuffled,
    and there grouped by their bytes.  A bucket of one kind of bytes is a group; members of a bucket
    with several, which only a collision makes, are told apart by their bytes.

    Null and empty texts are one group; texts of any length are read whole; repeated rows and ties
    share a group; columns other than doc_id and text are not looked at; an empty table gives an
    empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    canons = fingerprints(docs)
    prints = scratch.keep(canons.select("doc_id", "fingerprint")) if prints is None else prints
    many = scratch.keep(prints.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"))
    light = many.count() <= FEW
    hint = F.broadcast if light else lambda df: df.hint("shuffle_hash")
    held = canons.join(hint(many), "fingerprint", "left_semi")
    kinds = scratch.keep(held.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("group_id")))
    by_print = kinds.groupBy("fingerprint").agg(F.min("group_id").alias("group_id"), F.count("*").alias("kinds"))
    out = prints.join(hint(by_print), "fingerprint", "left").withColumn("group_id", F.coalesce("group_id", "doc_id"))
    if not by_print.where("kinds > 1").head(1):
        return out.drop("kinds")
    collided = kinds.join(by_print.where("kinds > 1").select("fingerprint"), "fingerprint")
    exact = canons.join(collided, ["fingerprint", "canon"]).select(F.col("doc_id").alias("i"), F.col("fingerprint").alias("f"), F.col("group_id").alias("exact")).distinct()
    met = out.join(exact, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("fingerprint") == F.col("f")), "left")
    return met.withColumn("group_id", F.coalesce("exact", "group_id")).drop("kinds", "i", "f", "exact")


def edited_text(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by the first as many of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows of docs dealt so that each stands before the next one: (part, border, doc_id, text).

    Order is doc_id (nulls first), then a digest of the text.  Parts are ranges of doc_id; the first
    row of a part is also sent, as a border row, behind the last row of the part before it (that of
    the first part behind the last), so text moves once and no task sees more than its part.
    """
    spark = prepared(docs.sparkSession)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(docs.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    bounds = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id").cast("double"))))
    order = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(part.alias("part"), order.alias("h"), "doc_id", "text")
    firsts = sorted((r["part"], r["one"]) for r in rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")).alias("one")).collect())
    id_type = dict(docs.dtypes)["doc_id"]
    heads = [(firsts[i - 1][0], one["doc_id"], one["h"]) for i, (_, one) in enumerate(firsts)]
    heads = F.broadcast(spark.createDataFrame(heads, f"before int, head_id {id_type}, head_h long"))
    at = rows["doc_id"].eqNullSafe(heads["head_id"]) & (rows["h"] == heads["head_h"])
    marked = rows.join(heads, at, "left").select("*", F.when(F.col("before").isNull(), F.array(F.struct(F.col("part").alias("p"), F.lit(False).alias("b")))).otherwise(F.array(F.struct(F.col("part").alias("p"), F.lit(False).alias("b")), F.struct(F.col("before").alias("p"), F.lit(True).alias("b")))).alias("to"))
    dealt = marked.select(F.inline("to").alias("part", "border"), "doc_id", "h", "text")
    return dealt.repartition(parts, "part").sortWithinPartitions("part", "border", F.col("doc_id").asc_nulls_first(), "h").select("part", "border", "doc_id", "text")


def edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    Null texts are empty; texts of any length are read whole.  A single row is followed by itself.  Of
    rows with one doc_id each is followed by the next in order of a digest of the text.  Other columns
    are not looked at; an empty table gives an empty result.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held = None  # (part, border, id, text, canonical text, fingerprint) of the row before
        for batch in batches:
            out = []
            for part, border, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                canon = canonical(text)
                now = (part, border, i, text, canon, digest(canon))
                if held and held[0] == part and not held[1]:
                    _, _, j, body, mine, print_ = held
                    edited = edited_text(body, text)
                    other = canonical(edited)
                    sign = digest(other)
                    out.append((j, len(body), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), print_, sign, float(sign == print_ and other == mine), float(now[5] == print_ and canon == mine)))
                held = now
            columns = list(zip(*out)) or [()] * 7
            kinds = [batch.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return neighbours(docs, parts).mapInArrow(run, f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark, sf_dir):
    from .common import read

    docs = read(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    return exact_groups(docs, scratch.keep(edits(docs)), scratch)
