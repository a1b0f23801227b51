"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct buckets, of ``1 << BITS``, of its words, of its neighbouring
word pairs and of pairs with one or two words between them.  Words are runs of ASCII letters and
digits and of bytes above 127, A-Z lowered, so that shouting and trailing marks do not hide them.
FTRL-proximal keeps a learning rate for each coordinate, and its L1 term leaves nearly all weights
at zero: what is sent to the scoring tasks is at most ``1 << BITS`` numbers, whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared, slices
from .hashing import mix, sorted_distinct, words

BITS = 20
#: The fit takes at most this many labelled rows, those with the lowest digests of doc_id.
SAMPLE = 10_000
THRESHOLD = 0.3
#: Rates of the fit: alpha and beta of the per-coordinate rate, L1, L2, passes.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 8.0, 0.5, 3

SEPARATOR = np.ones(256, dtype=bool)
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every feature occurrence."""
    row, word = words(column, SEPARATOR)
    shift = np.uint64(64 - BITS)
    rows, buckets = [row], [mix(word) >> shift]
    for gap in (1, 2, 3):
        both = row[gap:] == row[:-gap]
        kind = 2 if gap == 1 else 3  # a skip-gram is the same feature for either gap
        pair = word[:-gap] * np.uint64(0xD6E8FEB86659FD93) + mix(word[gap:]) + np.uint64(kind)
        rows.append(row[gap:][both])
        buckets.append(mix(pair)[both] >> shift)
    return np.concatenate(rows), np.concatenate(buckets).astype(np.int64)


def distinct(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = sorted_distinct((row << BITS) | bucket)
    return both >> BITS, both & ((1 << BITS) - 1)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, bias) after PASSES passes over rows of distinct buckets."""
    z, n, bias, bias_n = np.zeros(1 << BITS), np.zeros(1 << BITS), -2.0, 0.0

    def weight(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(PASSES):
        for x, y in zip(rows, labels):
            zi, ni = z[x], n[x]
            w = weight(zi, ni)
            g = 1.0 / (1.0 + np.exp(-min(35.0, max(-35.0, bias + w.sum())))) - y
            more = np.sqrt(ni + g * g)
            z[x] = zi + g - (more - np.sqrt(ni)) / ALPHA * w
            n[x] = ni + g * g
            bias_n += g * g
            bias -= 0.1 * g / (1.0 + np.sqrt(bias_n))
    return weight(z, n), bias


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, their weights, bias), fitted on rows that are not held out.

    The labelled rows are chosen by id before any text is read, so the ids that are broadcast and
    the rows of the one fitting task number ``sample`` at most.  Contradicting labels of one doc_id
    count as toxic; null labels and ids are left out.
    """
    spark = prepared(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), F.col("id") == F.col("doc_id")).select("id", "toxic", "text")

    def gather(batches):
        for batch in (part for whole in batches for part in slices(whole, 2, 1024)):
            row, bucket = distinct(*features(batch.column(2)))
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(bucket, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["id", "toxic", "x"])

    def train(batches):
        ids, toxic, x = [], [], []
        for batch in batches:
            cuts, flat = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
            ids += batch.column(0).to_pylist()
            toxic += batch.column(1).to_pylist()
            x += [flat[a:b].copy() for a, b in zip(cuts[:-1], cuts[1:])]
        if not ids:
            return
        # a bucket of few documents cannot reach the L1 bound, so it cannot change the fit
        common = np.zeros(1 << BITS, np.int32)
        for buckets in x:
            common[buckets] += 1
        common = common * PASSES > L1
        x = [buckets[common[buckets]] for buckets in x]
        number = np.array(ids, np.int64)
        order = np.lexsort((number, mix(number.astype(np.uint64))))
        order = order[np.concatenate([[True], number[order][1:] != number[order][:-1]])]
        w, bias = fit([x[i] for i in order], np.array(toxic)[order] > 0)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], bias))], ["bucket", "weight"])

    rows = texts.mapInArrow(gather, "id long, toxic int, x array<int>").repartition(1)
    found = rows.mapInArrow(train, "bucket long, weight double").toPandas()
    inside = found["bucket"] >= 0
    bias = float(found.loc[~inside, "weight"].iloc[0]) if len(found) else -2.0
    return found.loc[inside, "bucket"].to_numpy(), found.loc[inside, "weight"].to_numpy(), bias


def held_out(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


def _scores(column, weights: np.ndarray, bias: float) -> np.ndarray:
    row, bucket = features(column)
    hit = weights[bucket] != 0
    row, bucket = distinct(row[hit], bucket[hit])
    return 1.0 / (1.0 + np.exp(-(bias + np.bincount(row, weights[bucket], minlength=len(column)))))


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep_below: float | None = None) -> DataFrame:
    """(doc_id, score) per row of docs; with keep_below, the rows of docs whose score is below it.

    Null and empty texts have the score of the bias alone.  Texts of any length are scored whole.
    Repeated rows are scored alike; columns other than text do not enter the score; an empty table gives an
    empty result.
    """
    spark = prepared(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    text = docs.columns.index("text") if keep_below is not None else 1

    def run(batches):
        at, values, bias = sent.value
        weights = np.zeros(1 << BITS)
        weights[at] = values
        for batch in (part for whole in batches for part in slices(whole, text, 1024)):
            score = _scores(batch.column(text), weights, bias)
            if keep_below is None:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])
            else:
                yield batch.filter(pa.array(score < keep_below))

    if keep_below is not None:
        return docs.mapInArrow(run, docs.schema)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def query(spark, sf_dir):
    from .common import read

    docs = read(spark, sf_dir, "documents")
    found = scored(docs, learn(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
