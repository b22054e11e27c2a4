"""Reward insight over offers. Row-local except the final statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import rewards as r
from offerlens.functions.dates import as_date_lit
from offerlens.functions.text import number_text, strip_spaces

PROSE_FIELDS = ("title", "conditions_summary", "description", "content", "summary", "highlights")


def activity_text(df: DataFrame, out: str = "prose") -> DataFrame:
    """Prose fields and evidence excerpts of an offer, blank ones left out, one per line."""
    parts: list[Column] = []
    for name in PROSE_FIELDS:
        if name not in df.columns:
            continue
        if df.schema[name].dataType.typeName() == "array":
            parts.append(F.filter(F.transform(name, strip_spaces), lambda x: x != ""))
        else:
            parts.append(F.array(F.nullif(strip_spaces(F.col(name)), F.lit(""))))
    if "evidence" in df.columns:
        parts.append(F.filter(F.transform("evidence", lambda e: strip_spaces(e["excerpt"])), lambda x: x != ""))
    none = F.array().cast("array<string>")
    return df.withColumn(out, F.array_join(F.array_compact(F.concat(*[F.coalesce(p, none) for p in parts])), "\n"))


def percent_mentions(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every percentage with its context and whether it is a reward."""
    return df.select(key, F.posexplode(r.percent_mentions(F.col(text))).alias("pos", "m")).select(
        key, "pos", "m.before", "m.value", "m.after", r.is_reward_percent(F.col("m")).alias("is_reward")
    )


def with_rewards(df: DataFrame, text: str = "prose") -> DataFrame:
    return (
        df.withColumn("max_reward_percent", F.array_max(r.reward_percents(F.col(text))))
        .withColumn("fixed_reward_amount", F.array_max(r.fixed_rewards(F.col(text))))
        .transform(with_reward_flags)
    )


def with_reward_flags(df: DataFrame) -> DataFrame:
    pct = F.coalesce(F.col("max_reward_percent") >= r.HIGH_PERCENT, F.lit(False))
    fix = F.coalesce(F.col("fixed_reward_amount") >= r.HIGH_AMOUNT, F.lit(False))
    return df.withColumn("high_percentage", pct).withColumn("high_fixed", fix).withColumn("is_high_return", pct | fix)


def with_timing(df: DataFrame, as_of: dt.date | str, start: str = "start_date", end: str = "end_date") -> DataFrame:
    today = as_date_lit(as_of)
    return (
        df.withColumn("starts_in_days", F.datediff(F.col(start), today))
        .withColumn("ends_in_days", F.datediff(F.col(end), today))
        .withColumn("is_upcoming", F.coalesce(F.col("starts_in_days").between(1, r.UPCOMING_DAYS), F.lit(False)))
        .withColumn("is_expiring_soon", F.coalesce(F.col("ends_in_days").between(0, r.EXPIRING_DAYS), F.lit(False)))
    )


# Tag and summary wording.
STATUS_TAGS = {"sold_out": "已額滿", "partial_sold_out": "部分額滿", "unknown_app_only": "需至 App 確認"}
STATUS_PHRASES = {
    "sold_out": "官方資訊顯示活動已額滿",
    "partial_sold_out": "部分期別或子活動已額滿",
    "unknown_app_only": "額滿狀態需至 App 確認",
}
NO_REWARD_PHRASE = "尚未辨識出明確回饋幅度，請查看官方活動辦法"


def with_tags(df: DataFrame) -> DataFrame:
    tags = [
        F.when(F.col("high_percentage"), "高回饋"),
        F.when(F.col("high_fixed"), "高額回饋"),
        F.when(F.col("is_upcoming"), "即將開始"),
        F.when(F.col("is_expiring_soon"), "即將結束"),
        F.coalesce(*[F.when(F.col("quota_status") == k, F.lit(v)) for k, v in STATUS_TAGS.items()]),
    ]
    return df.withColumn("insight_tags", F.array_compact(F.array(*tags)))


def with_summary(df: DataFrame) -> DataFrame:
    pct, fix = F.col("max_reward_percent"), F.col("fixed_reward_amount")
    days_in, days_left = F.col("starts_in_days"), F.col("ends_in_days")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    phrases = [
        F.when(
            pct.isNotNull(),
            text("最高 ", number_text(pct), "% 回饋", F.when(F.col("high_percentage"), "，屬高回饋活動").otherwise("")),
        ),
        F.when(
            fix.isNotNull(),
            text("固定回饋最高 ", number_text(fix), " 元", F.when(F.col("high_fixed"), "，屬高額回饋").otherwise("")),
        ),
        F.when(F.col("is_upcoming"), text("將於 ", days_in.cast("string"), " 天後開始")).when(days_in == 0, "今天開始"),
        F.when(
            F.col("is_expiring_soon"),
            F.when(days_left == 0, "今天截止").otherwise(text("將於 ", days_left.cast("string"), " 天後截止")),
        ),
        F.coalesce(*[F.when(F.col("quota_status") == k, F.lit(v)) for k, v in STATUS_PHRASES.items()]),
    ]
    joined = F.concat_ws("；", *phrases)
    return df.withColumn(
        "human_summary", F.concat(F.when(joined == "", NO_REWARD_PHRASE).otherwise(joined), F.lit("。"))
    )


def with_insights(df: DataFrame, as_of: dt.date | str) -> DataFrame:
    """The whole insight record of an offer."""
    return (
        df.transform(activity_text)
        .transform(with_rewards)
        .transform(with_timing, as_of)
        .transform(with_tags)
        .transform(with_summary)
    )


def reward_stats(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("offers"),
        F.count("max_reward_percent").alias("with_percent"),
        F.max("max_reward_percent").alias("max_percent"),
        F.round(F.avg("max_reward_percent"), 6).alias("avg_percent"),
        F.round(F.median("max_reward_percent"), 6).alias("median_percent"),
        F.max("fixed_reward_amount").alias("max_fixed"),
        F.count_if("is_high_return").alias("high_return"),
    )
