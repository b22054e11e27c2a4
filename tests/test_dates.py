import datetime as dt

import pytest
from pyspark.sql import functions as F

from offerlens.functions import dates

D = dt.date
AS_OF = "2026-07-21"

GOLDEN = [
    ("活動期間：2026/07/01～2026/08/31", D(2026, 7, 1), D(2026, 8, 31), "high", "active"),
    ("活動期間：民國115年7月1日至115年8月31日", D(2026, 7, 1), D(2026, 8, 31), "high", "active"),
    ("活動期間：2026/07/23～08/05", D(2026, 7, 23), D(2026, 8, 5), "high", "upcoming"),
    ("活動期間：2025/12/01 (一) – 2025/12/14 (日)", D(2025, 12, 1), D(2025, 12, 14), "high", "ended"),
    (
        "活動期間內完成申貸並於2027/1/31前成功撥款。本專案活動期間自2026/06/30 18:00~2026/12/31 23:59止。",
        D(2026, 6, 30), D(2026, 12, 31), "high", "active",
    ),
    (
        "一、活動時間\n2026/4/1～2026/5/31\n信用卡通用權益\n活動期間：2026/3/1～2026/8/31",
        D(2026, 4, 1), D(2026, 5, 31), "high", "ended",
    ),
    ("活動期間：2026年7月16日起，回饋每月重新計算", D(2026, 7, 16), None, "low", "active"),
    ("活動日期：2026年7月21日，僅限當日有效", D(2026, 7, 21), D(2026, 7, 21), "medium", "active"),
    ("活動期間：2026/06/01～2026/07/20", D(2026, 6, 1), D(2026, 7, 20), "high", "ended"),
    (
        "activity_start_time: 2026/07/01 00:00\nactivity_end_time: 2026/08/31 23:59",
        D(2026, 7, 1), D(2026, 8, 31), "high", "active",
    ),
    ("startDate: 2026-07-23\nendDate: 2026-09-30", D(2026, 7, 23), D(2026, 9, 30), "high", "upcoming"),
    # Year roll-over, a range with no label, impossible dates, nothing at all.
    ("優惠期間：2026/12/20～1/10", D(2026, 12, 20), D(2027, 1, 10), "high", "upcoming"),
    ("自2026/7/1到2026/7/31皆可", D(2026, 7, 1), D(2026, 7, 31), "low", "active"),
    ("活動期間：2026/2/30～2026/3/31 民國115年7月1日至115年8月31日", None, None, "none", "unknown"),
    ("只有文字", None, None, "none", "unknown"),
    ("", None, None, "none", "unknown"),
    ("活動期間：２０２６/7/1", None, None, "none", "unknown"),
]


def test_golden_periods(spark):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "i int, text string")
    df = df.withColumn("p", dates.resolve_period(F.col("text")))
    df = df.withColumn("life", dates.lifecycle(F.col("p.start"), F.col("p.end"), AS_OF))
    got = {r.i: (r.p.start, r.p.end, r.p.confidence, r.life) for r in df.collect()}
    for i, g in enumerate(GOLDEN):
        assert got[i] == g[1:], g[0]


def test_cancelled_flag(spark):
    row = spark.range(1).select(
        dates.lifecycle(F.lit(None).cast("date"), F.lit(None).cast("date"), AS_OF, F.lit(True)).alias("x")
    ).first()
    assert row.x == "cancelled"


@pytest.mark.parametrize(
    "value,lenient,strict",
    [
        ("2026-07-01", D(2026, 7, 1), D(2026, 7, 1)),
        (" 2026-07-01T00:00", D(2026, 7, 1), None),
        ("2026-02-30", None, None),
        ("民國115年7月", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_coercion(spark, value, lenient, strict):
    df = spark.createDataFrame([(value,)], "v string")
    row = df.select(dates.lenient_date(F.col("v")).alias("a"), dates.strict_date(F.col("v")).alias("b")).first()
    assert (row.a, row.b) == (lenient, strict)


def test_dash_period_and_slash_range(spark):
    df = spark.createDataFrame(
        [(" 2026-07-01 ~ 2026-08-31 ", "2026/7/1 - 2026/8/31"), ("2026-02-30~2026-03-01", "none")], "a string, b string"
    )
    rows = df.select(dates.dash_period(F.col("a")).alias("a"), dates.slash_range(F.col("b")).alias("b")).collect()
    assert (rows[0].a.start, rows[0].a.end) == (D(2026, 7, 1), D(2026, 8, 31)) == (rows[0].b.start, rows[0].b.end)
    assert rows[1].a is None and rows[1].b is None


def test_months(spark):
    row = spark.createDataFrame([("7月與８月 2026/9/1 13月 0月",)], "t string").select(
        dates.mentioned_months(F.col("t")).alias("m")
    ).first()
    assert row.m == [7, 8, 9]


def test_long_texts_are_dealt_over_all_cores(spark, tmp_path):
    """A customer table of one row group is one task to read; the long texts made of it are parsed by many."""
    from offerlens.plans.q_periods import long_text_decisions
    from offerlens.plans.base import Tables

    spark.createDataFrame([(k, k % 25) for k in range(40)], "c_custkey bigint, c_nationkey int").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    out = long_text_decisions(Tables(spark, str(tmp_path)))
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {(r["c_custkey"], r["months"]) for r in out.collect()} == {(k, str(k % 25 % 12 + 1)) for k in range(40)}


def test_texts_without_colon_tab_or_label(spark):
    """What is looked for before a regex runs does not change its result."""
    rows = ["startDate: 2026-07-01\nendDate: 2026-07-02", "\u017ftartDate: 2026-07-01 endDate: 2026-07-02", "startDate\uff1a2026-07-01", "a\t\r\tb 2026/7/1~2026/7/2", "回饋期間\t2026/7/1", None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, text string")
    got = {r["k"]: r for r in df.select("k", dates.resolve_period(F.col("text")).alias("p"), dates.low_window(F.col("text")).alias("low"), F.size(dates.period_windows(F.col("text"))).alias("n")).collect()}
    assert [got[k]["p"]["confidence"] for k in range(7)] == ["high", "high", "none", "low", "low", "none", "none"]
    assert got[3]["low"] == "a b 2026/7/1~2026/7/2" and got[5]["low"] is None and got[6]["low"] == ""
    assert [got[k]["n"] for k in (3, 4, 6)] == [0, 1, 0]
