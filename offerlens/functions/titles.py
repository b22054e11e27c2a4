"""Title columns: clean-up of page titles and the normal forms used for matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens.functions.text import FLAGS, head, squash, strip_spaces

# Titles that say nothing, separators before a site name, words ignored in matching.
UNKNOWN_TITLE = "未辨識活動名稱"
GENERIC_PAGE_TITLES = ("最新消息", "優惠活動", "活動內容")
GENERIC_PAGE_PREFIX = "活動訊息"
SITE_SEPARATORS = (" | ", "｜", " - ", "_")
GENERIC_OFFER_TITLES = (
    "活動訊息",
    "最新消息",
    "優惠活動",
    "台灣pay",
    "橘子支付",
    "line pay money",
    "redirecting...",
)
GENERIC_OFFER_PREFIXES = ("悠遊付｜一卡一付", "活動訊息")
MENU_LINES = ("首頁", "回上一頁", "活動內容", "活動訊息")
MENU_PREFIXES = ("首頁", "Menu", ":::", "活動訊息 -")
GENERIC_MATCH_TITLES = (
    "活動訊息",
    "最新消息",
    "優惠活動",
    "活動專區",
    "公告",
    "台灣pay",
    "橘子支付",
    "linepaymoney",
)
CORE_STOP_WORDS = (
    "ipassmoney",
    "linepaymoney",
    "icashpay",
    "一卡通",
    "悠遊付",
    "全支付",
    "台灣pay",
    "街口支付",
    "橘子支付",
    "活動",
    "優惠",
    "回饋",
    "額滿",
    "公告",
    "通知",
    "最高",
    "已於",
)
NOTICE_BRACKET = r"【[^】]*(?:額滿|公告)[^】]*】"
NOTICE_WORDS = r"(?:額滿公告|額滿通知|活動公告|優惠活動)"
SOLD_OUT_MARK = r"[（(【\[]\s*活動額滿\s*[）)】\]]"


def best_title(title: Column, heading: Column, text: Column) -> Column:
    """Page title without the site name; a heading or text line when the title says nothing."""
    title = F.coalesce(title, F.lit(""))
    generic = (
        (F.length(title) < 4)
        | title.startswith(GENERIC_PAGE_PREFIX)
        | F.lower(F.trim(title)).isin(*GENERIC_PAGE_TITLES)
    )
    cuts = F.filter(
        F.array(
            *[
                F.when(title.contains(sep), F.trim(F.substring_index(title, sep, 1)))
                for sep in SITE_SEPARATORS
            ]
        ),
        lambda t: t.isNotNull() & (F.length(t) >= 4),
    )
    own = F.coalesce(head(cuts), title)
    line = head(F.filter(F.split(text, "\n"), lambda x: F.length(x).between(4, 120)))
    return (
        F.when(generic & F.length(heading).between(4, 180), heading)
        .when(F.length(own) < 4, F.coalesce(line, F.lit(UNKNOWN_TITLE)))
        .otherwise(own)
    )


def final_title(title: Column, hint: Column, text: Column) -> Column:
    """Offer title: a say-nothing title yields to the list's hint, then to the first fitting line."""
    hint = squash(F.coalesce(hint, F.lit("")))
    generic = (
        (title == UNKNOWN_TITLE)
        | (F.length(title) < 4)
        | F.lower(strip_spaces(title)).isin(*GENERIC_OFFER_TITLES)
        | title.contains("{{")
    )
    for prefix in GENERIC_OFFER_PREFIXES:
        generic = generic | title.startswith(prefix)

    def fits(line: Column) -> Column:
        ok = F.length(line).between(6, 180) & ~F.lower(line).isin(*GENERIC_OFFER_TITLES, *MENU_LINES)
        for prefix in MENU_PREFIXES:
            ok = ok & ~line.startswith(prefix)
        return ok

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip_spaces)
    return (
        F.when(~generic, title)
        .when(F.length(hint).between(4, 180), hint)
        .otherwise(F.coalesce(head(F.filter(lines, fits)), title))
    )


def normal_title(title: Column) -> Column:
    bare = F.regexp_replace(title, FLAGS + NOTICE_BRACKET, "")
    letters = F.lower(F.regexp_replace(bare, r"[^0-9A-Za-z\u4e00-\u9fff]", ""))
    return F.when(title != "", F.regexp_replace(letters, NOTICE_WORDS, "")).otherwise(F.lit(""))


def core_title(title: Column) -> Column:
    """What is left of a title without brand, campaign and date words."""
    value = normal_title(title)
    for word in CORE_STOP_WORDS:
        value = F.replace(value, F.lit(word), F.lit(""))
    return F.regexp_replace(value, r"[0-9年月日至起止]", "")


def comparable_title(title: Column) -> Column:
    bare = F.lower(F.regexp_replace(title, r"(?U)" + SOLD_OUT_MARK, ""))
    return F.regexp_replace(bare, r"[^0-9a-z\u4e00-\u9fff]", "")
