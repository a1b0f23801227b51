"""CSV files of any size in ranges of bytes, split into records that follow quotes, and digests of files.

A range cannot tell by itself whether it begins inside quotes.  A first pass counts the quotes of each
range; the sums before a range say so, and a second pass cuts every range into records in the order of
the file.  A record over a border comes as fragments, which are put together by their ranges.  Nothing
but these fragments is shuffled, and no task holds more than a batch of about ``BATCH`` bytes each way and
one record, however long the lines are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a task gets or tells at once.
BATCH = 1 << 20
#: Lines that are made Python's at once.
LINES = 256

_PIECE = re.compile(r'"(?:[^"]+|"")*(?:"|\Z)|,|[^",]+')


def cells(record: str) -> list[str]:
    """The cells of a record: quotes switch commas off wherever they stand, and a doubled quote in them is one."""
    out, cell = [], []
    for piece in _PIECE.findall(record):
        if piece == ",":
            out.append("".join(cell))
            cell = []
        elif piece[0] == '"':
            cell.append(piece[1 : -1 if len(piece) > 1 and piece.endswith('"') else None].replace('""', '"'))
        else:
            cell.append(piece)
    return [*out, "".join(cell)]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): lines as they stand, a carriage return at their end included, by file and the range they begin in."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def blocks(rows: DataFrame) -> DataFrame:
    """(file, block, inside): the ranges of lines, and whether each begins inside quotes; an open quote at a file's end raises."""
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    sums = rows.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    order = Window.partitionBy("file").orderBy("block")
    before = F.coalesce(F.sum("quotes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum("quotes").over(Window.partitionBy("file")) % 2 == 1
    checked = F.when(open_, F.raise_error(F.lit("CSV contains an unterminated quoted field"))).otherwise((before % 2 == 1))
    return sums.select("file", "block", checked.cast("boolean").alias("inside"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, LINES):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, LINES).columns))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Records (kind 0), the end of one that began before the range (1), one that does not end in it (2), one that goes through it (3)."""
    key, held, inside, begun, count, out = None, [], False, True, 0, []

    def emit(kind: int) -> None:
        nonlocal held, begun, count
        out.append((*key, count, kind, "".join(held)))
        held, begun, count = [], True, count + 1

    for file, block, started, value in _rows(batches):
        if (file, block) != key:
            if inside:
                emit(2 if begun else 3)
            key, held, inside, begun, count = (file, block), [], started, not started, 0
        for part in re.split("(\r)", value) if "\r" in value else [value]:
            if part == "\r" and not inside:
                emit(0 if begun else 1)
                continue
            held.append(part)
            inside ^= part.count('"') % 2 == 1
        if inside:
            held.append("\n")
        else:
            emit(0 if begun else 1)
        yield from out
        out.clear()
    if inside:
        emit(2 if begun else 3)
        yield from out


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with their bytes before them as batches of about ``BATCH`` bytes."""
    out, size = [], 0

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    for n, *row in rows:
        out.append(row)
        size += n + 64
        if size > BATCH:
            yield told()
            out, size = [], 0
    if out:
        yield told()


_CELLS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("number", pa.int64()), ("cells", pa.list_(pa.string()))])
_PARTS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("number", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of the records that begin and end in a range."""
    return _batched(((len(text), *at, cells(text)) for *at, kind, text in _cut(batches) if kind == 0), _CELLS)


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batched(((len(text), *at, kind, text) for *at, kind, text in _cut(batches) if kind > 0), _PARTS)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batched(((len(text), *at, cells(text)) for *at, text in _rows(batches)), _CELLS)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, number, cells) of the records of CSV files in their order by these; records without text are left out.

    Arrow batches of the session have at most ``BATCH`` bytes from here on.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    rows = lines(spark, path)
    some = rows.join(F.broadcast(blocks(rows)), ["file", "block"]).select("file", "block", "inside", "value")
    parsed = "file string, block long, number long, cells array<string>"
    # A record over borders: one begins (2), some go through (3), one ends (1); they count as the record of the range it begins in.
    order = Window.partitionBy("file").orderBy("block", "number")
    parts = some.mapInArrow(_fragments, "file string, block long, number long, kind int, text string").withColumn("record", F.sum((F.col("kind") == 2).cast("int")).over(order))
    joined = parts.groupBy("file", "record").agg(F.min("block").alias("block"), F.max_by("number", F.col("kind") == 2).alias("number"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("text"))
    found = some.mapInArrow(_whole, parsed).unionByName(joined.select("file", "block", "number", "text").mapInArrow(_parsed, parsed))
    return found.where(F.array_join("cells", "") != "")


def headers(spark: SparkSession, path: str) -> list[str]:
    """Trimmed header names, equal in all files of path; empty or repeated names, and files that differ, raise."""
    first = records(spark, path).where("block = 0").groupBy("file").agg(F.min_by("cells", "number").alias("cells"))
    kinds = [r["cells"] for r in first.select("cells").distinct().limit(2).collect()]
    if len(kinds) > 1:
        raise ValueError("csv files of one import must have one header")
    names = [x.strip() for x in kinds[0]] if kinds else []
    if not names or "" in names or len(set(names)) != len(names):
        raise ValueError("csv headers must be present and unique")
    return names


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text; missing cells are empty, further ones are left out, records without text are dropped.

    Lines end with a line feed, a carriage return or both; quotes may hold any of them.
    """
    names = headers(spark, path)
    found = records(spark, path)
    first = found.where("block = 0").groupBy("file").agg(F.min("number").alias("head"))
    rest = found.join(F.broadcast(first), "file", "left").where((F.col("block") > 0) | (F.col("number") > F.col("head")))
    return rest.select(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    file, now, left, done = None, None, 0, []
    for batch in batches:
        for name, length, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if name != file:
                if file is not None:
                    done.append((file, now.hexdigest()))
                file, now, left = name, hashlib.sha256(), length
            data = (raw + b"\n")[: max(left, 0)]  # the last line may have no end
            now.update(data)
            left -= len(data)
        if len(done) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["path", "digest"])
            done = []
    if file is not None:
        done.append((file, now.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["path", "digest"])


def content_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest): the SHA-256 of files of any size, to tell what has been imported before.

    Bytes come as lines, in the order of their file, to one task a file, which hashes them as they stream by; a
    line is the most that it holds.  Empty files are no rows of Spark's readers and have no digest.
    """
    sizes = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    rows = lines(spark, path).select("file", "block", F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("raw"))
    dealt = sizes.join(rows, "file").repartition("file").sortWithinPartitions("file", "block", "at")
    return dealt.select("file", "length", "raw").mapInArrow(_hashed, "path string, digest string")
