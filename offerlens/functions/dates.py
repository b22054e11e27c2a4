"""Date columns: period parsing (Gregorian and ROC years), lifecycle, lenient and strict coercion.

Everything stays inside one row: candidate windows are an array, so resolving
a corpus needs no shuffle at all.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens.functions.text import all_matches, ascii_digits, first_match, head, let

# Labels that announce a validity period.
PERIOD_LABELS = (
    "活動期間",
    "活動時間",
    "活動日期",
    "優惠期間",
    "優惠時間",
    "適用期間",
    "回饋期間",
    "activity_start_time",
)
# The written forms of dates and ranges.
RANGE_WORD = r"(?:至|到|起至|～|~|—|–|-|－)"
DATE_NOTE = r"(?:\s*[（(][^）)\n]{0,12}[）)])?(?:\s+\d{1,2}:\d{2}(?::\d{2})?)?"
YEAR_MARK, MONTH_MARK, DAY_MARK = r"\s*(?:年|[./-])\s*", r"\s*(?:月|[./-])\s*", r"\s*日?"
GREGORIAN_YEAR, ROC_YEAR, ROC_WORD, ROC_OFFSET = r"20\d{2}", r"1\d{2}", r"(?:民國\s*)?", 1911
ONE_DAY = (r"(?:僅限|只限|限於).{0,50}(?:當日|一天)", r"(?:當日|一天).{0,30}(?:活動|限定|有效)")
# What "near a label" means: characters and lines behind it that can hold its period.
NEAR_CHARS, NEAR_LINES, NEAR_KEEP = 520, 3, 420
# Characters of a window that are shown beside a period; decides nothing.
SHOWN_CHARS = 260

_MONTH_DAY = rf"(\d{{1,2}}){MONTH_MARK}(\d{{1,2}}){DAY_MARK}"


def _date_pattern(year: str, prefix: str = "") -> str:
    return rf"(?Ud){prefix}({year}){YEAR_MARK}{_MONTH_DAY}"


def _range_pattern(year: str, prefix: str = "") -> str:
    return (
        rf"(?Ud){prefix}({year}){YEAR_MARK}{_MONTH_DAY}{DATE_NOTE}\s*{RANGE_WORD}\s*"
        rf"{prefix}(?:({year}){YEAR_MARK})?{_MONTH_DAY}"
    )


PERIOD_STRUCT = "struct<start:date,end:date,confidence:string,excerpt:string>"


def build_date(year: Column, month: Column, day: Column) -> Column:
    """NULL for impossible dates."""
    return F.concat_ws("-", year, month, day).try_cast("date")


def _parts(hit: Column, pattern: str, groups: int) -> Column:
    """All groups of a match as one struct of strings, digits normalised."""
    return F.struct(*[ascii_digits(first_match(hit, pattern, g)).alias(f"g{g}") for g in range(1, groups + 1)])


def _ymd(hit: Column, pattern: str, offset: int) -> Column:
    return let(
        _parts(hit, pattern, 3),
        lambda p: build_date((p["g1"].try_cast("int") + offset).cast("string"), p["g2"], p["g3"]),
    )


def _range_of(hit: Column, pattern: str, offset: int) -> Column:
    """``struct<start,end>`` from a matched range; a missing end year rolls over New Year."""

    def dated(p: Column) -> Column:
        start_year = p["g1"].try_cast("int") + offset
        end_year = F.coalesce(p["g4"].try_cast("int") + offset, start_year)
        return F.struct(
            build_date(start_year.cast("string"), p["g2"], p["g3"]).alias("start"),
            build_date(end_year.cast("string"), p["g5"], p["g6"]).alias("end"),
            build_date((end_year + 1).cast("string"), p["g5"], p["g6"]).alias("next"),
            (p["g4"] == "").alias("open"),
        )

    return let(
        let(_parts(hit, pattern, 6), dated),
        lambda d: F.struct(
            d["start"].alias("start"),
            F.when(d["open"] & (d["end"] < d["start"]), d["next"]).otherwise(d["end"]).alias("end"),
        ),
    )


_GREGORIAN_RANGE = _range_pattern(GREGORIAN_YEAR)
_ROC_RANGE = _range_pattern(ROC_YEAR, ROC_WORD)
_GREGORIAN_DATE = _date_pattern(GREGORIAN_YEAR)
_ROC_DATE = _date_pattern(ROC_YEAR, ROC_WORD)


def parse_range(window: Column) -> Column:
    """First range of a window. A Gregorian hit, even an impossible one, ends the search."""
    roc = let(
        first_match(window, _ROC_RANGE), lambda h: F.when(h != "", _range_of(h, _ROC_RANGE, ROC_OFFSET))
    )
    return let(
        first_match(window, _GREGORIAN_RANGE),
        lambda h: F.when(h != "", _range_of(h, _GREGORIAN_RANGE, 0)).otherwise(roc),
    )


def single_date(window: Column) -> Column:
    roc = let(first_match(window, _ROC_DATE), lambda h: F.when(h != "", _ymd(h, _ROC_DATE, ROC_OFFSET)))
    return let(
        first_match(window, _GREGORIAN_DATE),
        lambda h: F.when(h != "", _ymd(h, _GREGORIAN_DATE, 0)).otherwise(roc),
    )


def period_windows(text: Column, chars: int = NEAR_CHARS, lines: int = NEAR_LINES, keep: int = NEAR_KEEP) -> Column:
    """One window per period label, in document order: the text near the label, as the arguments define near."""
    return _windows(low_window(text), chars, lines, keep)


def _windows(flat: Column, chars: int = NEAR_CHARS, lines: int = NEAR_LINES, keep: int = NEAR_KEEP) -> Column:
    raw = all_matches(
        flat, r"(?=(" + "|".join(PERIOD_LABELS) + r"))(?=([\s\S]{0," + str(chars) + r"}))", 2
    )
    # Looking for the labels as plain strings costs a fraction of trying them at every place of a long text.
    labelled = reduce(Column.__or__, [flat.contains(label) for label in PERIOD_LABELS])
    raw = F.when(~labelled, F.array().cast("array<string>")).otherwise(raw)
    return F.transform(
        raw,
        lambda w: F.substring(
            F.array_join(F.slice(F.split(w, "\n"), 1, lines), " "), 1, keep
        ),
    )


def low_window(text: Column) -> Column:
    """The whole text: a period far down counts as well. A text without tabs is not rewritten."""
    tabs = text.contains("\t") | text.contains("\r")
    return F.when(tabs, F.regexp_replace(text, r"[\t\r]+", " ")).otherwise(text)


def _period(start: Column, end: Column, confidence, excerpt: Column) -> Column:
    conf = F.lit(confidence) if isinstance(confidence, str) else confidence
    return F.struct(
        start.alias("start"), end.alias("end"), conf.alias("confidence"), excerpt.alias("excerpt")
    ).cast(PERIOD_STRUCT)


def _labelled_pair(text: Column, start_names: str, end_names: str) -> Column:
    start_pat = rf"(?iUd)(?:{start_names})\s*:\s*([^\n]{{0,60}})"
    end_pat = rf"(?iUd)(?:{end_names})\s*:\s*([^\n]{{0,60}})"
    dated = F.struct(
        single_date(first_match(text, start_pat, 1)).alias("start"),
        single_date(first_match(text, end_pat, 1)).alias("end"),
    )
    note = F.concat(first_match(text, start_pat), F.lit("; "), first_match(text, end_pat))
    return F.when(
        # Both need a colon; looking for one costs far less than trying the names at every place of a long text.
        text.contains(":") & text.rlike(start_pat) & text.rlike(end_pat),
        let(
            dated,
            lambda d: F.when(
                d["start"].isNotNull() & d["end"].isNotNull(), _period(d["start"], d["end"], "high", note)
            ),
        ),
    )


def _range_in(window: Column, confidence: str) -> Column:
    return let(
        parse_range(window),
        lambda found: F.when(
            found["start"].isNotNull() & found["end"].isNotNull(),
            _period(found["start"], found["end"], confidence, F.substring(window, 1, SHOWN_CHARS)),
        ),
    )


def _single_in(window: Column) -> Column:
    one_day = window.rlike("(?Ud)" + "|".join(f"(?:{p})" for p in ONE_DAY))
    excerpt = F.substring(window, 1, SHOWN_CHARS)
    return let(
        single_date(window),
        lambda day: F.when(
            day.isNotNull(),
            F.when(one_day, _period(day, day, "medium", excerpt)).otherwise(
                _period(day, F.lit(None).cast("date"), "low", excerpt)
            ),
        ),
    )


def resolve_period(text: Column) -> Column:
    """``struct<start,end,confidence,excerpt>``: the first stage that yields a period wins.

    Order: labelled API pairs, a range near a label, a range anywhere in
    the text, a single date near a label. ``coalesce`` stops at the first hit, so the
    wide window is only searched when nothing better was found.
    """
    found = lambda items: head(F.filter(items, lambda p: p.isNotNull()))
    in_windows = let(
        low_window(text),
        lambda flat: let(
            _windows(flat),
            lambda windows: F.coalesce(
                found(F.transform(windows, lambda w: _range_in(w, "high"))),
                _range_in(flat, "low"),
                found(F.transform(windows, _single_in)),
            ),
        ),
    )
    return F.coalesce(
        _labelled_pair(text, "startDate|start_date", "endDate|end_date"),
        _labelled_pair(text, "activity_start_time", "activity_end_time"),
        in_windows,
        _period(F.lit(None).cast("date"), F.lit(None).cast("date"), "none", F.lit("")),
    )


def resolve_title_period(title: Column) -> Column:
    """A title is read as if it followed a period label."""
    return resolve_period(F.concat(F.lit("活動期間："), F.coalesce(title, F.lit(""))))


def as_date_lit(as_of: dt.date | str) -> Column:
    return F.lit(str(as_of)).cast("date")


def lifecycle(start: Column, end: Column, as_of: dt.date | str, cancelled: Column | None = None) -> Column:
    today = as_date_lit(as_of)
    base = (
        F.when(start > today, "upcoming")
        .when(end < today, "ended")
        .when(start.isNotNull() | end.isNotNull(), "active")
        .otherwise("unknown")
    )
    return base if cancelled is None else F.when(cancelled, "cancelled").otherwise(base)


ISO_DATE = r"\A\d{4}-\d{2}-\d{2}\z"


def lenient_date(text: Column) -> Column:
    """First ten characters as an ISO date, else NULL."""
    value = F.substring(F.trim(text), 1, 10)
    return F.when(value.rlike(ISO_DATE), value.try_cast("date"))


def strict_date(text: Column) -> Column:
    """The whole string as an ISO date, else NULL."""
    return F.when(text.rlike(ISO_DATE), text.try_cast("date"))


def dash_period(text: Column) -> Column:
    """``YYYY-MM-DD~YYYY-MM-DD`` as ``struct<start,end>``; NULL unless both are real dates."""
    pattern = r"(?U)\A\s*(20\d{2}-\d{2}-\d{2})\s*~\s*(20\d{2}-\d{2}-\d{2})\s*\z"
    start, end = (strict_date(first_match(text, pattern, g)) for g in (1, 2))
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def slash_range(text: Column) -> Column:
    """Card date text ``2026/7/1 - 2026/8/31`` as ``struct<start,end>``; both or NULL."""
    pattern = r"(?U)(20\d{2})[/-](\d{1,2})[/-](\d{1,2})\s*-\s*(20\d{2})[/-](\d{1,2})[/-](\d{1,2})"
    g = lambda i: first_match(text, pattern, i)
    start, end = build_date(g(1), g(2), g(3)), build_date(g(4), g(5), g(6))
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def mentioned_months(text: Column) -> Column:
    """Distinct months 1..12 named in a text, as ints."""
    plain = all_matches(text, r"(?Ud)(?<!\d)(\d{1,2})\s*月", 1)
    dated = all_matches(text, r"(?Ud)20\d{2}[年/.\-](\d{1,2})[月/.\-]", 1)
    numbers = F.transform(F.concat(plain, dated), lambda m: ascii_digits(m).try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda m: m.between(1, 12))))
