"""Plain look-ups in front of costly patterns decide as the patterns alone do."""

import re

import pytest
from pyspark.sql import functions as F

from offerlens.functions import quota, text, urls
from offerlens.operators import search
from offerlens.plans import q_linkage, q_run
from offerlens.plans.base import Tables

WORDS = sorted({w for rules in quota.ZH_WORDS.values() for groups in rules for g in groups for w in g})
#: Sentences that the rules accept, and the words alone and in pairs.
NOTICES = [
    "（活動額滿）", "已於7月額滿", "業已全數額滿", "回饋金額已達本月上限", "名額達到額度", "已贈罄", "已兌換完", "自七月起停止回饋", "已提前結束",
    "若額滿則停止回饋", "倘達每月上限", "是否額滿", "有無達上限", "送完為止", "達本期上限即止", "額滿後將另行公告", "除名額已達本期上限外", "當頁面出現圖示標示已額滿",
    "每人回饋上限", "單一帳戶額滿", "活動總回饋上限", "舉例當月已達", "截至今日已額滿", "APP內額滿公告", "額滿僅公告於官方App", "剩餘名額請至應用程式查詢",
    "App最新消息公告回饋上限", "官網不另行公告請見App", "本活動全數額滿", "全部名額用罄", "7月份已達上限", "額滿通路第二重", "本週額滿", "額滿週次", "第三週已額滿", "加碼額滿", "", None,
]


def test_rules_decide_as_their_patterns_alone(spark):
    texts = NOTICES + [a + "x" + b for a in WORDS for b in WORDS]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").repartition(8)
    s = F.col("s")
    plain = {f: s.rlike(text.any_of(ps)) for f, ps in quota.ZH_RULES.items()}
    differ = [~quota.ZH_PACK.hits(f, s).eqNullSafe(p) for f, p in plain.items()]
    missed = [p & ~quota.ZH_PACK.possible(f, s) for f, p in plain.items()]
    counts = rows.select(*[F.count_if(c) for c in (*differ, *missed)]).first()
    assert set(counts) == {0}
    hits = rows.select(*[F.count_if(c) for c in plain.values()]).first()
    assert min(hits) > 0


def test_no_text_without_the_words_of_a_notice_is_split(spark):
    """Before, every text was split into sentences and every sentence tried by every pattern."""
    assert re.search(r"contains\(.*額滿", str(quota.quota_of(F.col("s"))), re.IGNORECASE)
    rows = spark.createDataFrame([("a。b", 0), ("已額滿。a", 1), ("b！請至App查詢 回饋\n。c", 2), (None, 3)], "s string, n int")
    got = {r["n"]: (r["q"]["status"], r["q"]["excerpt"]) for r in rows.select("n", quota.quota_of(F.col("s")).alias("q")).collect()}
    assert got == {0: ("not_marked_full", ""), 1: ("sold_out", "已額滿。"), 2: ("not_marked_full", ""), 3: ("not_marked_full", "")}


def test_sentences_are_those_of_the_pattern(spark):
    texts = ["a。b", "。。a!\n\nb ? c；　d;;", "\n", "", "a b\tc\x1cd  e", None, " 。\x85！ "]
    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    plain = F.filter(F.transform(F.split("s", r"(?<=[。！？!?；;])|\n+"), text.squash), lambda x: x != "")
    for r in rows.select(text.sentence_list(F.col("s")).alias("a"), plain.alias("b")).collect():
        assert r["a"] == r["b"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://a.example.com/x/y", "https://a.example.com/x/y"),
        ("HTTPS://A.example.com/X", "https://a.example.com/X"),
        (" https://a.example.com/x\t", "https://a.example.com/x"),
        ("https://a.example.com", "https://a.example.com/"),
        ("https://a.example.com/x#f", "https://a.example.com/x"),
        ("https://a.example.com/o?b=2&a=%7e+x&utm_source=n&c&=d&e=f=g#z?", "https://a.example.com/o?=d&a=~+x&b=2&c=&e=f%3Dg"),
        ("https://a.example.com/o?b=2&a=1", "https://a.example.com/o?a=1&b=2"),
        ("https://a.example.com/o?", "https://a.example.com/o"),
        (None, None),
    ],
)
def test_canonical_spellings(spark, url, want):
    rows = spark.createDataFrame([(url,)], "u string")
    assert rows.select(urls.canonical_url(F.col("u"))).first()[0] == want


def test_identifiers_without_query_or_name(spark):
    rows = spark.createDataFrame(
        [("https://a/x", "EVENTID：e1 見 https://b.c/d)."), ("https://a/x?ID=7&id=", "活動編號:zz Event_Id=q9"), ("https://a/x?nid=%41b", ""), (None, None), ("https://a", None)], "u string, t string"
    )
    got = [tuple(r) for r in rows.select(urls.event_identifiers(F.col("u"), F.col("t")), urls.mentioned_urls(F.col("t"))).collect()]
    assert got == [(["e1"], ["https://b.c/d"]), (["7", "zz", "q9"], []), (["ab"], []), ([], None), ([], None)]


def _dealt(df) -> int:
    return df.rdd.getNumPartitions()


def test_pages_of_a_run_are_dealt(spark, sf):
    """Before, one task wrote all pages of a file of one row group."""
    assert _dealt(q_run.pages(Tables(spark, sf), "d1").select("capture_id")) >= 8


def test_offers_and_notices_are_dealt(spark, sf, monkeypatch):
    monkeypatch.setattr(q_linkage, "staged", lambda df, name: df)
    t = Tables(spark, sf)
    assert _dealt(q_linkage.linked_offers(t).select("activity_id")) >= 8
    assert _dealt(q_linkage.notices(t).select("announcement_id")) >= 8


def test_index_is_written_without_a_shuffle_of_grams(spark, tmp_path):
    """Before, all grams were computed twice, for the ranges and for the rows, and shuffled."""
    texts = ["Offer one", "offer two 回饋 回饋", "of", "", None, "offer one"]
    rows = spark.createDataFrame([(k, t and t.lower()) for k, t in enumerate(texts)], "seq long, search_text string")
    path = str(tmp_path / "postings")
    search.write_postings(rows, path, "seq")
    found = spark.read.parquet(path)
    want = {(t[i : i + 3].lower(), k) for k, t in enumerate(texts) if t for i in range(len(t) - 2)}
    got = [(r["gram"], r["seq"]) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    per_file = found.groupBy(F.input_file_name()).agg(F.countDistinct("seq").alias("n"), F.collect_set("seq").alias("keys")).collect()
    held = [k for r in per_file for k in r["keys"]]
    assert sorted(held) == sorted(set(held))  # the grams of a row lie in one file
    for asked in ("offer one", "回饋", "one", "of", "", "none"):
        hits = {r["seq"] for r in search.search_indexed(rows, found, "seq", asked).collect()}
        assert hits == {k for k, t in enumerate(texts) if t is not None and asked in t.lower()}
