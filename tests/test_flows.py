"""Paths of nested rows in mappings, files with blanks, streams that go on from a checkpoint or lose it."""

import pytest
from pyspark.sql import functions as F

from larkspur.operators.stored import folder
from larkspur.sources import files, mapping
from larkspur.streaming import ingestion, stateful


def row(expression, df):
    rules = [{"target": "event_name", "expression": {"const": "click"}}, {"target": "event_id", "expression": {"const": "e"}}, {"target": "occurred_at", "expression": {"const": "2026-01-01T00:00:00Z"}}]
    got = mapping.apply({"source_id": "s", "rules": [*rules, {"target": "payload.x", "expression": expression}]}, df)
    return got.select("mapped.payload.x", "error").first()


def test_paths_end_at_values_that_are_no_rows(spark):
    df = spark.createDataFrame([(("v", {"k.l": "m"}), "text", "header")], "a struct<b:string,c:map<string,string>>, t string, `d.e` string")
    assert tuple(row({"source": "a.b"}, df)) == ("v", None)
    assert tuple(row({"source": "a.c.k.l"}, df)) == ("m", None)
    for name in ("a.b.c", "t.x", "a.none", "none", "d.e"):
        assert tuple(row({"source": name}, df)) == (None, "source_missing")
        assert tuple(row({"source": name, "default": "z"}, df)) == ("z", None)
    assert tuple(row({"source": "t.x", "fallback_column": "a.b"}, df)) == ("v", None)


def test_filters_compare_nested_values_strictly(spark):
    df = spark.range(4).select(F.struct(F.col("id").alias("n"), F.col("id").cast("string").alias("s")).alias("a"), F.lit("1").alias("t"))
    passes = lambda *clauses: df.where(mapping.row_filter({"row_filter": [{"source": s, "equals": v} for s, v in clauses]}, df)).count()
    assert passes(("a.n", 1)) == 1 and passes(("a.s", "1")) == 1 and passes(("a.n", 1), ("t", "1")) == 1
    assert passes(("a.s", 1)) == passes(("a.n", "1")) == passes(("t.n", "1")) == passes(("a", "1")) == 0


def test_csv_keeps_blanks(spark):
    path = folder(spark, "blanks")
    files.write_csv(spark.createDataFrame([("1", "  a "), ("2", " "), ("3", None), ("4", '"\r\n,')], "k string, v string"), path)
    assert {r["k"]: r["v"] for r in files.read_csv(spark, path).collect()} == {"1": "  a ", "2": " ", "3": "", "4": '"\r\n,'}


def test_limits_refuse_a_whole_import(spark):
    path = folder(spark, "limits")
    files.write_json(spark.range(100).select("id", F.repeat(F.lit("x"), 50).alias("v")), path)
    assert files.read_rows(spark, path, "jsonl", "id long, v string", max_rows=100).count() == 100
    for limit in ({"max_rows": 99}, {"max_bytes": 1000}, {"max_row_bytes": 50}):
        with pytest.raises(ValueError, match="limit"):
            files.read_rows(spark, path, "jsonl", "id long, v string", **limit)


def test_rows_that_come_again_without_a_checkpoint_are_stored_once(spark):
    home, schema = folder(spark, "again"), "k long, v string"
    for n in range(3):
        spark.range(10 * n, 10 * n + 15).select(F.col("id").alias("k"), F.lit("v").alias("v")).write.mode("append").parquet(f"{home}/in")
        ingestion.append_idempotent(spark.readStream.schema(schema).parquet(f"{home}/in"), f"{home}/out", ["k"], f"{home}/ck{n}", against_stored=True).awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(f"{home}/out").collect()) == list(range(35))


def test_empty_deliveries_tell_nothing(spark):
    none = spark.createDataFrame([], "ts timestamp, event_name string")
    assert ingestion.drained([none, none], lambda read: ingestion.daily_counts(read()), folder(spark, "none")).count() == 0


def test_nonces_are_free_again_after_their_time(spark):
    asked = [("a", "k", "n", 0, 0), ("b", "k", "n", 99, 99), ("c", "k", "n", 100, 100), ("d", "k", "n", 300, 150), ("e", "k", "n", 200, 200), ("f", "j", "n", 99, 99), ("g", None, "n", 0, 0), ("h", "k", "", 0, 0), ("i", "k", "m", None, 5), ("j", "k", "m", 6, 6)]
    rows = spark.createDataFrame(asked, "request_id string, key_id string, nonce string, sent_ms long, at_ms long")
    got = {r["request_id"]: r["reason"] for r in stateful.guarded_nonces(rows, 100, 100).collect()}
    assert got == {"a": None, "b": "nonce_reused", "c": None, "d": "timestamp_out_of_window", "e": None, "f": None, "g": "nonce_missing", "h": "nonce_missing", "i": "timestamp_out_of_window", "j": None}
    assert stateful.guarded_nonces(rows.where("false")).count() == 0
