"""Reward mentions in prose, found with their context in one walk over the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens.functions.text import all_matches, compact, let

# Number forms and the words around a number that make it a reward.
CURRENCY = r"(?:新臺幣|新台幣|臺幣|台幣|NTD|NT\$)"
AMOUNT = r"[0-9]{1,9}(?:,[0-9]{3})*(?:\.\d+)?"
PERCENT_AFTER = r"(?Ud)^(?:等值)?(?:現金|點數|紅利點數|全點)?\s*(?:回饋|返現|回贈)"
PERCENT_BEFORE = (
    r"(?Ud)(?:最高(?:可)?(?:享)?|加碼(?:最高)?(?:享)?|再加碼(?:最高)?(?:享)?|"
    r"享(?:有)?|可享|回饋|返現|回贈)\s*$"
)
PERCENT_CAP_BEFORE = r"(?Ud)(?:回饋|返現)(?:總額|總金額|金額)?上限\s*$"
PERCENT_NOT_AFTER = r"(?Ud)^(?:的)?\s*(?:手續費|服務費|利率|稅|折扣)"
FIXED_BEFORE = rf"(?Ud)(?:送|贈|贈送|可得|獲得|享|可享|享有|回饋|回饋金)\s*(?:價值\s*)?(?:{CURRENCY}\s*)?$"
FIXED_AFTER = r"(?Ud)^(?:等值)?(?:現金)?\s*(?:回饋|返現|優惠券|折價券|抵用券|購物金|現金券)"
FIXED_NOT_BEFORE = (
    r"(?Ud)(?:消費|單筆|累積|交易|訂單)?\s*(?:滿|達|超過)\s*$|"
    r"(?:個人|每人|每戶|每帳戶|每卡|每月|單筆|活動)?(?:最高)?"
    r"(?:回饋|回饋金|回饋金額|總回饋|總金額)?\s*(?:上限|為限)\s*$"
)
FIXED_NOT_AFTER = r"(?Ud)^\s*(?:為限|上限|額滿|封頂)"
PERCENT_LEFT, PERCENT_RIGHT, FIXED_LEFT, FIXED_RIGHT, FIXED_NEAR = 24, 20, 32, 22, 22
HIGH_PERCENT, HIGH_AMOUNT, UPCOMING_DAYS, EXPIRING_DAYS = 10.0, 100.0, 14, 7


# One pass walks the text from mention to mention: "\G" keeps it linear, and the
# stretch before each mention is part of the match, so left context needs no
# look-behind (whose cost is quadratic in its width).
_WALK = r"(?U)\G(?s:.*?)"
_PERCENT = r"(?<![\d.])(\d{1,3}(?:\.\d+)?)\s*[%％]"
_YUAN = rf"(?:{CURRENCY}\s*)?(?<![\d.])({AMOUNT})\s*元"
_NT = rf"(?i:NTD|NT\$)\s*({AMOUNT})"


def _mentions(text: Column, pattern: str, left: int, right: int, shortest: int, extra: str = "") -> Column:
    """``array<struct<before,number,after,extra,hit>>`` of a pattern's matches with raw context.

    ``shortest`` is the least length of a match: it bounds how many earlier
    matches the left context can reach into.
    """
    walk = _WALK + pattern
    steps = F.arrays_zip(
        all_matches(text, walk, 0).alias("step"),
        all_matches(text, walk + rf"(?=((?s:.{{0,{right}}}))){extra}", 2).alias("after"),
        (all_matches(text, walk + extra, 2) if extra else all_matches(text, walk, 1)).alias("extra"),
    )
    reach = -(-left // shortest)

    def shaped(steps: Column, m: Column, i: Column) -> Column:
        first = F.greatest(i - (reach - 1), F.lit(1))
        upto = F.array_join(F.transform(F.slice(steps, first, i + 2 - first), lambda s: s["step"]), "")
        hit = F.regexp_extract(m["step"], "(?U)" + pattern + r"\z", 0)
        row = F.struct(upto.alias("upto"), hit.alias("hit"))
        return let(
            row,
            lambda r: F.struct(
                F.right(
                    F.substring(r["upto"], F.lit(1), F.length(r["upto"]) - F.length(r["hit"])), F.lit(left)
                ).alias("before"),
                F.regexp_extract(r["hit"], "(?U)" + pattern, 1).alias("number"),
                m["after"].alias("after"),
                m["extra"].alias("extra"),
                r["hit"].alias("hit"),
            ),
        )

    return let(steps, lambda all_: F.transform(all_, lambda m, i: shaped(all_, m, i)))


def percent_mentions(text: Column) -> Column:
    """``array<struct<before,value,after>>`` of every percentage, rewards or not."""
    return F.transform(
        _mentions(text, _PERCENT, PERCENT_LEFT, PERCENT_RIGHT, 2),
        lambda m: F.struct(
            compact(m["before"]).alias("before"),
            m["number"].cast("double").alias("value"),
            compact(m["after"]).alias("after"),
        ),
    )


def is_reward_percent(mention: Column) -> Column:
    before, after, value = mention["before"], mention["after"], mention["value"]
    return (
        (value > 0)
        & (value <= 1000)
        & ~before.rlike(PERCENT_CAP_BEFORE)
        & ~after.rlike(PERCENT_NOT_AFTER)
        & (after.rlike(PERCENT_AFTER) | before.rlike(PERCENT_BEFORE))
    )


def reward_percents(text: Column) -> Column:
    found = F.when(
        text.contains("%") | text.contains("％"), F.filter(percent_mentions(text), is_reward_percent)
    )
    return F.transform(found, lambda m: m["value"])


def _fixed_context(before: Column, after: Column) -> Column:
    near = F.struct(compact(before).alias("b"), compact(after).alias("a"))
    return let(
        near,
        lambda c: c["a"].rlike(FIXED_AFTER)
        & c["b"].rlike(FIXED_BEFORE)
        & ~c["a"].rlike(FIXED_NOT_AFTER)
        & ~F.right(c["b"], F.lit(FIXED_NEAR)).rlike(FIXED_NOT_BEFORE),
    )


def fixed_rewards(text: Column) -> Column:
    """Accepted fixed amounts: first every 元 form, then NT$ forms not already counted.

    An NT$ hit can only lie inside an accepted 元 hit when both start at the
    same currency word, so the overlap is decided locally at that position.
    """
    number = lambda m: F.replace(m["number"], F.lit(","), F.lit("")).cast("double")
    accepted = lambda m: _fixed_context(m["before"], m["after"])
    yuan = _mentions(text, _YUAN, FIXED_LEFT, FIXED_RIGHT, 2)
    nt = _mentions(
        text, _NT, FIXED_LEFT, FIXED_RIGHT, 4, rf"(?=(\s*元(?s:.{{0,{FIXED_RIGHT}}}))?)"
    )
    counted = lambda m: (
        (m["extra"] != "")
        & m["hit"].rlike(r"\A(?:NTD|NT\$)")
        & _fixed_context(m["before"], F.regexp_replace(m["extra"], r"(?U)\A\s*元", ""))
    )
    none = F.array().cast("array<double>")
    return F.concat(
        F.when(text.contains("元"), F.transform(F.filter(yuan, accepted), number)).otherwise(none),
        F.when(
            text.rlike(r"(?i)NTD|NT\$"), F.transform(F.filter(nt, lambda m: accepted(m) & ~counted(m)), number)
        ).otherwise(none),
    )
