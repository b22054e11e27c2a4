"""Quota evidence: rule packs (tables of patterns) and the sentence classifier built from them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions.dates import build_date
from offerlens.functions.text import any_of, ascii_digits, first_match, has_any, head, let, sentence_list

# The phrases that decide a quota status, one family per list.
ZH_RULES: dict[str, tuple[str, ...]] = {
    "sold_out": (
        r"(?:[（(]\s*活動額滿\s*[）)]|已(?:於.{0,24})?(?:全數|全部)?額滿|業已(?:全數|全部)?額滿)",
        r"(?:回饋|額度|名額|活動).{0,30}(?:已達|達到).{0,12}(?:上限|額度)",
        r"已(?:贈|送|領|兌換|發放)(?:罄|完)",
        r"(?:已|自.{0,20}起)(?:停止回饋|提前結束)",
    ),
    "conditional": (
        r"(?:若|如|倘|一旦).{0,120}(?:額滿|達.{0,8}上限|停止回饋|提前結束)",
        r"(?:是否|有無).{0,12}(?:額滿|達.{0,8}上限)",
        r"(?:額滿|送完|用完|達.{0,8}上限)(?:為止|即止|即停止)",
        r"(?:額滿|達.{0,8}上限).{0,30}(?:將|會|另行|另於).{0,20}(?:公告|停止|結束)",
        r"除.{0,8}(?:已達|達到).{0,35}(?:上限|額滿)(?:外|者)",
        r"(?:當|若|如).{0,45}(?:出現|顯示|標示).{0,18}(?:已額滿|額滿)",
    ),
    "personal_cap": (r"(?:每人|每戶|每卡|每一帳戶|單一帳戶).{0,35}(?:上限|額滿)",),
    "total_cap": (r"(?:活動總|每月總|總回饋|總贈點|總名額).{0,8}上限",),
    "example": (r"(?:舉例|例如|假設|範例).{0,100}(?:已達|額滿)",),
    "already": (r"(?:已於|業已|截至.{0,20}(?:已|額滿))",),
    "app_only": (
        r"(?:App|APP|應用程式).{0,30}額滿公告",
        r"(?:額滿|回饋).{0,45}(?:僅公告於|僅於|請至).{0,35}(?:App|APP|應用程式)",
        r"(?:額滿|剩餘|回饋).{0,35}(?:僅|請).{0,20}(?:App|APP|應用程式).{0,30}(?:公告|查詢|顯示|通知)",
        r"(?:App|APP|應用程式).{0,30}(?:最新消息|公告).{0,30}(?:額滿|回饋上限)",
        r"(?:本網站|官網).{0,20}不另行公告.{0,30}(?:App|APP)",
    ),
    "whole": (
        r"(?:本活動|活動回饋|總回饋).{0,24}(?:全數|全部)?(?:已.{0,12})?額滿",
        r"(?:所有|全部).{0,16}(?:名額|回饋|額度).{0,12}(?:額滿|用罄)",
    ),
    "partial": (
        r"(?:\d{1,2}\s*月(?:份)?|活動[一二三四1234]|第[一二三四1234]重|加碼|指定通路|指定銀行).{0,40}(?:額滿|已達上限)",
        r"(?:額滿|已達上限).{0,40}(?:\d{1,2}\s*月(?:份)?|活動[一二三四1234]|第[一二三四1234]重|加碼)",
        r"(?:首週|本週|第[一二三四五六七八九十\d]+週|週次).{0,40}(?:額滿|已達上限)",
        r"(?:額滿|已達上限).{0,40}(?:首週|本週|第[一二三四五六七八九十\d]+週|週次)",
    ),
}
# Per rule, in the same order, words without which it cannot match: one of every group.
_LIMIT, _FULL, _APP = ("額滿", "上限", "停止回饋", "提前結束"), ("額滿", "已達上限"), ("App", "APP", "應用程式")
ZH_WORDS: dict[str, tuple[tuple[tuple[str, ...], ...], ...]] = {
    "sold_out": (
        (("額滿",), ("已", "活動額滿")),
        (("已達", "達到"), ("上限", "額度"), ("回饋", "額度", "名額", "活動")),
        (("罄", "完"), ("已",)),
        (("停止回饋", "提前結束"), ("已", "自")),
    ),
    "conditional": (
        (("若", "如", "倘", "一旦"), _LIMIT),
        (("是否", "有無"), ("額滿", "上限")),
        (("為止", "即止", "即停止"),),
        (("將", "會", "另行", "另於"), ("公告", "停止", "結束"), ("額滿", "上限")),
        (("除",), ("已達", "達到"), ("上限", "額滿")),
        (("出現", "顯示", "標示"), ("額滿",)),
    ),
    "personal_cap": ((("每人", "每戶", "每卡", "每一帳戶", "單一帳戶"), ("上限", "額滿")),),
    "total_cap": ((("上限",),),),
    "example": ((("舉例", "例如", "假設", "範例"), ("已達", "額滿")),),
    "already": ((("已於", "業已", "截至"),),),
    "app_only": (
        (("額滿公告",), _APP),
        (_APP, ("僅公告於", "僅於", "請至")),
        (_APP, ("公告", "查詢", "顯示", "通知")),
        (_APP, ("最新消息", "公告")),
        (("不另行公告",), _APP),
    ),
    "whole": ((("本活動", "活動回饋", "總回饋"), ("額滿",)), (("所有", "全部"), ("額滿", "用罄"))),
    "partial": (
        (("月", "活動", "第", "加碼", "指定通路", "指定銀行"), _FULL),
        (("月", "活動", "第", "加碼"), _FULL),
        (("週",), _FULL),
        (("週",), _FULL),
    ),
}
_WORDS_OF = {p: w for f, ps in ZH_RULES.items() for p, w in zip(ps, ZH_WORDS[f], strict=True)}
# How a partial sentence names its period and component, and the two date forms.
COMPONENT_MONTH = r"(?Ud)(?<!\d)(\d{1,2})\s*月(?:份)?"
COMPONENT_WEEK = r"(?Ud)(首週|本週|第[一二三四五六七八九十\d]+週)"
_PART = r"活動[一二三四1234]|第[一二三四1234]重"
COMPONENT_PART, COMPONENT_NAME = rf"(?Ud)({_PART})", rf"(?Ud)({_PART}|[^，。；]{{0,16}}加碼)"
FULL_DATE = r"(?Ud)(20\d{2})[年/.\-](\d{1,2})[月/.\-](\d{1,2})日?"
SHORT_DATE = r"(?Ud)(?<!\d)(\d{1,2})[月/](\d{1,2})日?"

FAMILIES = tuple(ZH_RULES)
RULE_SCHEMA = "family string, ord int, pattern string"


@dataclass(frozen=True)
class RulePack:
    """Rules of one language. A family without rules never matches."""

    rules: dict[str, tuple[str, ...]] = field(default_factory=lambda: ZH_RULES)

    @classmethod
    def from_rows(cls, rows: Iterable) -> RulePack:
        """From rows ``(family, ord, pattern)``; rule tables are configuration-sized."""
        grouped: dict[str, list[tuple[int, str]]] = defaultdict(list)
        for family, ord_, pattern in rows:
            if family not in FAMILIES:
                raise ValueError(f"unknown rule family {family!r}")
            grouped[family].append((ord_, pattern))
        return cls({f: tuple(p for _, p in sorted(v)) for f, v in grouped.items()})

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(f, i, p) for f, ps in self.rules.items() for i, p in enumerate(ps)]
        return spark.createDataFrame(rows, RULE_SCHEMA)

    def possible(self, family: str, text: Column) -> Column:
        """Whether a rule of the family can match in a sentence of the text, by its words alone."""
        tests = [
            reduce(Column.__and__, [has_any(text, ws) for ws in _WORDS_OF[p]]) if p in _WORDS_OF else F.lit(True)
            for p in self.rules.get(family, ())
        ]
        return reduce(Column.__or__, tests) if tests else F.lit(False)

    def hits(self, family: str, sentence: Column) -> Column:
        """Whether a rule of the family matches. A rule whose words are known is tried where these stand only."""
        patterns = self.rules.get(family, ())
        tests = [
            reduce(Column.__and__, [has_any(sentence, ws) for ws in _WORDS_OF[p]]) & sentence.rlike(any_of((p,)))
            for p in patterns
            if p in _WORDS_OF
        ]
        # Literal patterns are compiled once per task.
        if unknown := [p for p in patterns if p not in _WORDS_OF]:
            tests.append(sentence.rlike(any_of(unknown)))
        return reduce(Column.__or__, tests) if tests else F.lit(False)

    def conditional(self, sentence: Column) -> Column:
        """A rule about what would happen, not a notice that it did."""
        return (
            F.when(self.hits("personal_cap", sentence) & ~self.hits("total_cap", sentence), True)
            .when(self.hits("example", sentence), True)
            .when(self.hits("already", sentence), False)
            .otherwise(self.hits("conditional", sentence))
        )

    def explicit(self, sentence: Column) -> Column:
        return self.hits("sold_out", sentence) & ~self.conditional(sentence)


ZH_PACK = RulePack()


def sold_out_date(excerpt: Column, fallback_year: Column) -> Column:
    """Date inside a notice; the short form borrows the offer's year."""
    part = lambda p, g: ascii_digits(first_match(excerpt, p, g))
    full = first_match(excerpt, FULL_DATE) != ""
    short = first_match(excerpt, SHORT_DATE) != ""
    return F.when(full, build_date(part(FULL_DATE, 1), part(FULL_DATE, 2), part(FULL_DATE, 3))).when(
        short, build_date(fallback_year.cast("string"), part(SHORT_DATE, 1), part(SHORT_DATE, 2))
    )


def component_of(sentence: Column) -> Column:
    def found(pattern: str, *words: str) -> Column:
        return F.when(has_any(sentence, words), first_match(sentence, pattern, 1)).otherwise(F.lit(""))

    month = ascii_digits(found(COMPONENT_MONTH, "月")).try_cast("int")
    week = F.nullif(found(COMPONENT_WEEK, "週"), F.lit(""))
    name = F.when(sentence.contains("加碼"), first_match(sentence, COMPONENT_NAME, 1)).otherwise(found(COMPONENT_PART, "活動", "第"))
    return F.struct(
        F.lit("sold_out").alias("status"),
        sentence.alias("evidence"),
        F.coalesce(F.concat(F.lpad(month.cast("string"), 2, "0"), F.lit("月")), week).alias("period"),
        F.nullif(F.trim(name), F.lit("")).alias("component"),
    )


def quota_of(text: Column, pack: RulePack = ZH_PACK) -> Column:
    """``struct<status,excerpt,complete,components>`` of a text, as one expression.

    Sentences are split once and every stage is bound once. One expression
    also means that a filter on the result, which Catalyst pushes below the
    projection, repeats the work at most once instead of once per stage.
    """
    none = F.array().cast("array<struct<status:string,evidence:string,period:string,component:string>>")

    def verdict(status, excerpt: Column, complete: bool, components: Column = none) -> Column:
        return F.struct(
            F.lit(status).alias("status"),
            excerpt.alias("excerpt"),
            F.lit(complete).alias("complete"),
            components.alias("components"),
        )

    clear = verdict("not_marked_full", F.lit(""), True)

    def sold(explicit: Column) -> Column:
        first = F.get(explicit, 0)
        part = F.filter(explicit, lambda x: pack.hits("partial", x))
        whole = F.exists(explicit, lambda x: pack.hits("whole", x) & ~pack.hits("partial", x))
        return let(
            part,
            lambda p: F.when(
                (F.size(p) > 0) & ~whole, verdict("partial_sold_out", first, True, F.transform(p, component_of))
            ).otherwise(verdict("sold_out", first, True)),
        )

    def judged(sentences: Column) -> Column:
        app = let(
            head(F.filter(sentences, lambda x: pack.hits("app_only", x))),
            lambda a: F.when(a.isNotNull(), verdict("unknown_app_only", a, False)).otherwise(clear),
        )
        return let(F.filter(sentences, pack.explicit), lambda e: F.when(F.size(e) > 0, sold(e)).otherwise(app))

    # A text without the words of any notice needs no sentences.
    return F.when(
        pack.possible("sold_out", text) | pack.possible("app_only", text), let(sentence_list(text), judged)
    ).otherwise(clear)


def with_quota(df: DataFrame, text: str, pack: RulePack = ZH_PACK, prefix: str = "quota_") -> DataFrame:
    """Adds ``{prefix}status, excerpt, complete, components`` for the text column.

    Nothing is exploded, so a corpus is classified in its scan stage without a
    shuffle.
    """
    bound = df.withColumn("__quota", quota_of(F.col(text), pack))
    fields = {f"{prefix}{n}": F.col(f"__quota.{n}") for n in ("status", "excerpt", "complete", "components")}
    return bound.withColumns(fields).drop("__quota")
