"""Substring dedup by sliding spans of sentences.

Every run of ``run`` consecutive sentences (and as many more as it takes to reach ``least`` words)
is hashed; the hashes are joined over the whole corpus; sentences under a repeated run that is not
its first occurrence, in order of doc_id and position, are removed.

A sentence ends at . ! or ? before white space, or at a line feed, whatever its length.  Runs start
at two sentences: a passage usually begins behind, and ends before, an unfinished sentence of the
document around it, which leaves it its inner sentences only.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, signed, slices, text_bytes

RUN = 2
LEAST = 12
_END = re.compile(rb"(?<=[.!?])[ \t-\r]+|\n+")


def sentences(text: bytes) -> tuple[list[bytes], list[bytes], list[int]]:
    """(pieces that join to text, their normal forms, their word counts)."""
    pieces, forms, counts, at = [], [], [], 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        piece, at = text[at:end], end
        words = piece.lower().split()
        if not words:
            if piece and pieces:
                pieces[-1] += piece
            elif piece:
                pieces, forms, counts = [piece], [b""], [0]
            continue
        pieces.append(piece)
        forms.append(b" ".join(words))
        counts.append(len(words))
    return pieces, forms, counts


def runs(forms: list[bytes], counts: list[int], run: int = RUN, least: int = LEAST) -> list[tuple[int, int, int, int]]:
    """(128-bit hash as two halves, first, end) of each run; a text that is shorter than one run has none."""
    total = np.concatenate([[0], np.cumsum(counts)])
    starts = np.arange(len(forms))
    ends = np.maximum(starts + run, np.searchsorted(total, total[:-1] + least))
    out = []
    for i, j in zip(starts.tolist(), ends.tolist()):
        if j > len(forms):
            break
        h = xxhash.xxh3_128_intdigest(b"\n".join(forms[i:j]))
        out.append((h >> 64, h & (1 << 64) - 1, i, j))
    return out


def covered(docs: DataFrame, scratch: Scratch, run: int, least: int) -> DataFrame:
    """(doc_id, version, froms, tos): ranges of sentences to remove, one row a document that has any."""
    id_type = dict(docs.dtypes)["doc_id"]

    def spans(batches):
        for batch in batches:
            for part in slices(batch, 2, 512):
                rows, found = [], []
                for row, text in enumerate(text_bytes(part.column(2))):
                    got = runs(*sentences(text)[1:], run, least)
                    found += got
                    rows += [row] * len(got)
                take = pa.array(rows, pa.int32())
                h, l, i, j = (np.array(x, np.uint64) for x in zip(*found)) if found else [np.zeros(0, np.uint64)] * 4
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(signed(h)), pa.array(signed(l)), *(pa.array(x.astype(np.int32)) for x in (i, j))], ["doc_id", "version", "hash", "low", "i", "j"])

    rows = scratch.keep(docs.select("doc_id", F.xxhash64("text").alias("version"), "text").mapInArrow(spans, f"doc_id {id_type}, version long, hash long, low long, i int, j int"))
    again = scratch.keep(rows.groupBy("hash", "low").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "version", "i")).alias("one")).where("n > 1").drop("n"))
    later = rows.join(again, ["hash", "low"]).where(~F.struct("doc_id", "version", "i").eqNullSafe(F.col("one")))
    ranges = later.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set(F.struct("i", "j"))).alias("r"))
    return ranges.select("doc_id", "version", F.col("r.i").alias("froms"), F.col("r.j").alias("tos"))


def _left(text: bytes, froms, tos) -> tuple[bytes, int, int]:
    """(kept text, number of sentences, number of removed ones)."""
    pieces = sentences(text)[0]
    edge = np.zeros(len(pieces) + 1, np.int64)
    np.add.at(edge, froms or [], 1)
    np.add.at(edge, tos or [], -1)
    gone = np.cumsum(edge)[:-1] > 0
    return b"".join(p for p, g in zip(pieces, gone) if not g), len(pieces), int(gone.sum())


def deduplicated(docs: DataFrame, run: int = RUN, least: int = LEAST) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed) per row of docs.

    Null texts are empty; texts of any length are read whole.  Rows that agree in doc_id and text are
    one document; of equal texts with different ids the one with the smallest keeps its runs.  Texts
    with fewer than ``run`` sentences or ``least`` words keep all; other columns are not looked at;
    an empty table gives an empty result.
    """
    found = covered(docs, Scratch(docs.sparkSession), run, least).toDF("_range_id", "_range_version", "_range_froms", "_range_tos")
    id_type = dict(docs.dtypes)["doc_id"]
    on = docs["doc_id"].eqNullSafe(found["_range_id"]) & (F.xxhash64(docs["text"]) == found["_range_version"])

    def cut(batches):
        for batch in batches:
            left = [_left(*x) for x in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0].decode("utf-8", "replace") for x in left], pa.string()), pa.array([x[1] for x in left], pa.int64()), pa.array([x[2] for x in left], pa.int64())], ["doc_id", "text", "n_sentences", "n_removed"])

    joined = docs.join(found.hint("shuffle_hash"), on, "left").select(docs["doc_id"], docs["text"], "_range_froms", "_range_tos")
    return joined.mapInArrow(cut, f"doc_id {id_type}, text string, n_sentences long, n_removed long")


def query(spark, sf_dir):
    from .common import read

    left = deduplicated(read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_sentences", "n_removed", F.length("text").cast("long").alias("n_kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
