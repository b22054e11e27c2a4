"""Period resolution over a corpus. Row-local: no operator here shuffles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.functions import dates


def period_windows(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Candidate windows as rows: every labelled window, then the wide low-confidence one."""
    labelled = F.transform(
        dates.period_windows(F.col(text)), lambda w: F.struct(F.lit("high").alias("confidence"), w.alias("window"))
    )
    low = F.array(F.struct(F.lit("low").alias("confidence"), dates.low_window(F.col(text)).alias("window")))
    return documents.select(key, F.posexplode(F.concat(labelled, low)).alias("pos", "w")).select(
        key, "pos", "w.confidence", "w.window"
    )


def resolve_periods(documents: DataFrame, text: str) -> DataFrame:
    """Adds ``start_date, end_date, date_confidence, date_excerpt``."""
    return _spread(documents.withColumn("__p", dates.resolve_period(F.coalesce(F.col(text), F.lit("")))))


def _spread(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("start_date", F.col("__p.start"))
        .withColumn("end_date", F.col("__p.end"))
        .withColumn("date_confidence", F.col("__p.confidence"))
        .withColumn("date_excerpt", F.col("__p.excerpt"))
        .drop("__p")
    )


def override_periods(
    documents: DataFrame,
    text: str,
    title: str,
    adapter: str,
    list_start: str,
    list_end: str,
    title_first: tuple[str, ...] = ("jkopay_detail",),
) -> DataFrame:
    """Body, title and listing periods by source priority.

    The title wins for adapters whose pages mix in other deadlines, or when the
    body gave nothing better than a lone date; the listing fills a period that
    still lacks an end.
    """
    staged = documents.withColumn("__b", dates.resolve_period(F.coalesce(F.col(text), F.lit("")))).withColumn(
        "__t", dates.resolve_title_period(F.col(title))
    )
    full_title = F.col("__t.start").isNotNull() & F.col("__t.end").isNotNull()
    use_title = full_title & (
        F.coalesce(F.col(adapter).isin(*title_first), F.lit(False)) | F.col("__b.confidence").isin("none", "low")
    )
    chosen = F.when(use_title, F.col("__t").withField("confidence", F.lit("high"))).otherwise(F.col("__b"))
    first, last = dates.strict_date(F.col(list_start)), dates.strict_date(F.col(list_end))
    from_list = F.struct(
        first.alias("start"), last.alias("end"), F.lit("high").alias("confidence"), F.lit("official listing API").alias("excerpt")
    )
    use_list = (
        (F.col("__c.start").isNull() | F.col("__c.end").isNull()) & first.isNotNull() & last.isNotNull()
    )
    return _spread(
        staged.withColumn("__c", chosen)
        .withColumn("__p", F.when(use_list, from_list).otherwise(F.col("__c")))
        .drop("__b", "__t", "__c")
    )


def with_lifecycle(df: DataFrame, as_of: dt.date | str, start: str = "start_date", end: str = "end_date", cancelled: str | None = None) -> DataFrame:
    flag = F.col(cancelled) if cancelled else None
    return df.withColumn("lifecycle", dates.lifecycle(F.col(start), F.col(end), as_of, flag))


def parse_period(df: DataFrame, col: str, as_of: dt.date | str) -> DataFrame:
    """Rows whose ``YYYY-MM-DD~YYYY-MM-DD`` text is valid and not over, with both dates."""
    return (
        df.withColumn("__p", dates.dash_period(F.col(col)))
        .filter(F.col("__p.end") >= dates.as_date_lit(as_of))
        .withColumn("start_date", F.col("__p.start"))
        .withColumn("end_date", F.col("__p.end"))
        .drop("__p")
    )
