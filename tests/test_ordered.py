"""Hot groups must give the same columns as plain windows."""

from pyspark.sql import functions as F

from ledgerspark.operators import continuity as C
from ledgerspark.operators import ordered as O
from ledgerspark.operators import validate as V
from ledgerspark.sources.bridge import Ledger

from conftest import SF


def specs():
    v = F.col("v")
    return {
        "rn": O.rownum(),
        "lg": O.lag(v),
        "ld": O.lead(v),
        "lb": O.last_before(v),
        "lu": O.last_upto(v),
        "sm": O.running_sum(v),
        "mx": O.running_max(v),
        "mb": O.max_before(v),
    }


def test_hot_equals_cold(spark):
    value = F.when(F.col("id") % 3 == 0, None).otherwise((F.col("id") * 37) % 101)
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 1, 7).otherwise(F.col("id") % 40).alias("k"), "id", value.alias("v")
    )
    hot = O.find_hot(df, "k", limit=200)
    assert hot is not None and hot.count == 1
    cold = O.with_ordered(df, ["k"], ["id"], specs())
    warm = O.with_ordered(df, ["k"], ["id"], specs(), hot)
    assert cold.columns == warm.columns
    assert cold.exceptAll(warm).count() == 0 and warm.exceptAll(cold).count() == 0


def test_equal_order_keys_are_still_split(spark):
    df = spark.range(2000).select(F.lit(1).alias("k"), F.lit(5).alias("o"))
    hot = O.find_hot(df, "k", limit=100)
    out = O.with_ordered(df, ["k"], ["o"], {"rn": O.rownum()}, hot)
    assert out.select("rn").distinct().count() == 2000


def test_no_hot_group(spark):
    assert O.find_hot(spark.range(100).select((F.col("id") % 10).alias("k")), "k", limit=50) is None


def test_ledger_operators_on_hot_files(spark):
    rows = Ledger(spark, SF).ledger.withColumn(
        "source_file_id", F.when(F.col("source_file_id") % 3 == 0, 0).otherwise(F.col("source_file_id"))
    ).persist()
    hot = O.find_hot(rows, "source_file_id", limit=300)
    assert hot is not None
    for policy in ("validate", "kotak", "sbi"):
        names = ["id", "prev_balance", "expected_balance", "balance_status"]
        plain = C.continuity(rows, policy).select(names)
        split = C.continuity(rows, policy, hot=hot).select(names)
        assert plain.exceptAll(split).count() == 0
    plain = V.flag_duplicates(rows).select("id", "is_duplicate")
    split = V.flag_duplicates(rows, hot).select("id", "is_duplicate")
    assert plain.exceptAll(split).count() == 0
    rows.unpersist()
