"""Readers and sinks of row files: CSV, JSON and JSON Lines with text cells, limits, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .delimited import content_digests, headers, read_csv

__all__ = ["content_digests", "csv_cell", "csv_lines", "csv_report", "flat", "headers", "new_files", "read_csv", "read_json", "read_jsonl", "read_rows", "write_csv", "write_json"]


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An object or an array of objects."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_rows(spark: SparkSession, path: str, kind: str, schema: str | None = None, max_bytes: int = 1 << 30, max_rows: int = 10_000_000, max_row_bytes: int = 1 << 20) -> DataFrame:
    """Rows of a file, refused as a whole when it has too many bytes or rows or a row is too long."""
    size = spark.read.format("binaryFile").load(path).select("length").agg(F.sum("length")).first()[0]
    if (size or 0) > max_bytes:
        raise ValueError("import file exceeds the byte limit")
    df = read_csv(spark, path) if kind == "csv" else read_json(spark, path, schema) if kind == "json" else read_jsonl(spark, path, schema)
    rows, longest = df.agg(F.count("*"), F.max(F.octet_length(F.to_json(F.struct("*"))))).first()
    if rows > max_rows:
        raise ValueError("import file exceeds the row limit")
    if (longest or 0) > max_row_bytes:
        raise ValueError("import row exceeds the byte limit")
    return df


def new_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose content no earlier run of the source imported; equal files count once."""
    return found.dropDuplicates(["digest"]).join(manifest.select("digest"), "digest", "left_anti")


def flat(df: DataFrame) -> DataFrame:
    """df with nested columns as JSON text, as reports need them."""
    nested = ("struct", "array", "map")
    return df.select(*[F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header each; cells keep the blanks around their text."""
    flat(df).write.csv(path, header=True, quote='"', escape='"', mode="overwrite", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path, mode="overwrite")


def csv_cell(column):
    """A report's cell: quoted where it holds a quote, a comma or a line break."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame, arrays: str = "|") -> DataFrame:
    """One text column of CSV lines; arrays are joined by a bar."""
    cells = [csv_cell(F.array_join(c, arrays) if t.startswith("array") else F.to_json(c) if t.startswith(("struct", "map")) else F.col(c)) for c, t in df.dtypes]
    return df.select(F.concat_ws(",", *cells).alias("line"))


def csv_report(df: DataFrame, arrays: str = "|") -> DataFrame:
    """(place, line): a report as lines that end in a carriage return and a line feed, its header at place 0."""
    header = df.sparkSession.createDataFrame([(0, ",".join(df.columns) + "\r\n")], "place int, line string")
    return header.unionByName(csv_lines(df, arrays).select(F.lit(1).alias("place"), F.concat("line", F.lit("\r\n")).alias("line")))
