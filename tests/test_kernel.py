from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.functions import canon, instants, money, text
from larkspur.operators import ledger


def one(spark, column, **values):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("n,d,want", [(1, 2, 0), (3, 2, 2), (5, 2, 2), (-1, 2, 0), (-3, 2, -2), (1, 3, 0), (2, 3, 1)])
def test_half_even_vectors(spark, n, d, want):
    assert one(spark, money.half_even_div(money.units(F.lit(n)), money.units(F.lit(d)))) == want
    assert one(spark, money.half_even_long(F.lit(n), F.lit(d))) == want


def test_published_conversions(spark):
    assert one(spark, money.convert(F.lit("123456789012345678"), 18, F.lit("125000000"), 8, 6)) == 154321
    assert one(spark, money.convert(F.lit("100000001"), 6, F.lit("5"), 1, 6)) == 50000000
    assert one(spark, money.convert_scaled(F.lit("100000001"), F.lit(6), F.lit("5"), 1, 6)) == 50000000
    assert one(spark, money.half_even_div(money.units(F.lit(1)), money.units(F.lit(0)))) is None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-(10**20), 10**20), st.integers(1, 10**10)), min_size=1, max_size=40))
def test_half_even_against_exact_arithmetic(spark, pairs):
    df = spark.createDataFrame([(Decimal(n), Decimal(d)) for n, d in pairs], "n decimal(38,0), d decimal(38,0)")
    got = [int(r[0]) for r in df.select(money.half_even_div(F.col("n"), F.col("d"))).collect()]

    def exact(n, d):
        q, r = divmod(abs(n), d)
        q += 2 * r > d or (2 * r == d and q % 2 == 1)
        return -q if n < 0 else q

    assert got == [exact(n, d) for n, d in pairs]


def test_fixture_digests(spark):
    rows = spark.createDataFrame([("2026-08-19T00:00:01.000Z", "install-37", "available", "policy-v0.2.1")], "received_at string, record_id string, lifecycle_status string, policy_digest string").withColumn("scope", F.lit(1))
    from larkspur.operators.metrics import snapshot

    got = snapshot(rows, ["scope"]).first()
    assert got["input_snapshot_digest"].startswith("a45ca9ae") and got["input_snapshot_digest"].endswith("5873a9")
    assert got["ledger_position"] == "2026-08-19T00:00:01.000Z:install-37"


def test_timestamps(spark):
    df = spark.createDataFrame([("2026-02-30T00:00:00.000Z",), ("2026-02-28T24:00:00.000Z",), ("2026-02-28T00:00:00Z",), ("2026-02-28T00:00:00.123Z",), (None,)], "t string")
    assert [r[0] for r in df.select(instants.millis(F.col("t"))).collect()] == [None, None, None, 1772236800123, None]
    n = spark.createDataFrame([("2026-01-01 00:00:00.123456",), ("2026-01-01T09:00:00+09:00",), ("nope",)], "t string").select(instants.normalize(F.col("t")).alias("t")).collect()
    assert [r[0] for r in n] == ["2026-01-01T00:00:00.123Z", "2026-01-01T00:00:00.000Z", None]
    assert one(spark, instants.skewed(F.lit(300_000), F.lit(0))) is False and one(spark, instants.skewed(F.lit(300_001), F.lit(0))) is True


def test_utf16_order(spark):
    df = spark.createDataFrame([("",), ("\U0001f600",), ("a",)], "s string")
    assert [r[0] for r in df.orderBy(canon.utf16_key(F.col("s"))).collect()] == ["a", "\U0001f600", ""]


def test_matching_keys_are_ascii_only(spark):
    assert one(spark, text.matching_key(F.lit("k"), F.lit("ÄB"), F.lit("lowercase_ascii"))) == "k:Äb"


def test_ledger_operators(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, None)], "id int, supersedes_id int")
    assert sorted(r["id"] for r in ledger.not_superseded(df).collect()) == [2, 3]
    assert {r["id"]: r["superseded"] for r in ledger.with_superseded_flag(df).collect()} == {1: True, 2: False, 3: False}
    left = spark.createDataFrame([("u", 10), ("u", 5), ("w", 1)], "k string, t long")
    right = spark.createDataFrame([("u", 5, "x"), ("u", 6, "y")], "k string, t long, v string")
    assert {(r["k"], r["t"]): r["o"] for r in ledger.as_of(left, right, ["k"], "t", "t", "v", "o").collect()} == {("u", 10): "y", ("u", 5): "x", ("w", 1): None}
    page = ledger.page(df.select("id"), ["id"], (1,), 1).collect()
    assert [r["id"] for r in page] == [2, 3]
