import datetime as dt

from pyspark.sql import functions as F

from offerlens.functions import quota
from offerlens.functions.text import sentence_list

GOLDEN = [
    ("活動總回饋上限40萬點，送完為止；若額滿將另行公告。", "not_marked_full"),
    ("名額額滿將於全支付APP公告，惟額滿公告之系統時間並不等同活動實際額滿之時間。", "unknown_app_only"),
    ("【額滿公告】本活動回饋已於2026/7/18全數額滿。", "sold_out"),
    ("若額滿則停止回饋", "not_marked_full"),
    ("回饋額滿為止", "not_marked_full"),
    ("如達活動上限將提前結束", "not_marked_full"),
    ("請至 APP 留意當月是否已額滿", "not_marked_full"),
    ("舉例如下：小通消費1300元，10%回饋已達每人每月回饋上限100點。", "not_marked_full"),
    ("除已達各項活動回饋總金額上限外，可一併獲得所有優惠。", "not_marked_full"),
    ("TWQR花火狂歡Pay享10%回饋【每月額滿詳活動提醒】", "not_marked_full"),
    ("當活動頁面出現「已額滿」即代表已發送完畢。", "not_marked_full"),
    ("若交易成功後未收到悠遊付現金回饋券，除有其他活動辦法所指事由，即為本活動已額滿。", "not_marked_full"),
    ("title: （活動額滿）市場回饋活動", "sold_out"),
    ("暑假遊韓20%回饋【電支機構APP額滿公告詳如活動提醒】", "unknown_app_only"),
    ("活動二7月份回饋已額滿，8、9月仍可參加。", "partial_sold_out"),
    ("9 月因活動總回饋上限已額滿，故 9 月消費不符合回饋資格。", "partial_sold_out"),
    ("(首週回饋已額滿)，次週活動仍將繼續。", "partial_sold_out"),
    ("回饋額滿資訊僅公告於悠遊付App，本網站不另行公告。", "unknown_app_only"),
    ("", "not_marked_full"),
    (None, "not_marked_full"),
]


def _assess(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return {r.i: r for r in quota.with_quota(df, "text").collect()}


def test_golden_statuses(spark):
    got = _assess(spark, [t for t, _ in GOLDEN])
    for i, (text, status) in enumerate(GOLDEN):
        assert got[i].quota_status == status, text


def test_components_and_flags(spark):
    got = _assess(
        spark,
        [
            "活動二7月份回饋已額滿，8、9月仍可參加。",
            "9 月因活動總回饋上限已額滿，故 9 月消費不符合回饋資格。",
            "(首週回饋已額滿)，次週活動仍將繼續。",
            "回饋額滿資訊僅公告於悠遊付App，本網站不另行公告。",
            "7月份回饋已額滿。本活動回饋已全數額滿。",
        ],
    )
    assert (got[0].quota_components[0].period, got[0].quota_components[0].component) == ("07月", "活動二")
    assert got[1].quota_components[0].period == "09月"
    assert got[2].quota_components[0].period == "首週"
    assert got[3].quota_complete is False and got[0].quota_complete is True
    assert got[4].quota_status == "sold_out" and got[4].quota_components == []


def test_sold_out_date(spark):
    df = spark.createDataFrame(
        [("本活動回饋已於2026/7/18全數額滿。",), ("7月18日已額滿",), ("13月40日",), ("無",)], "t string"
    )
    got = [r[0] for r in df.select(quota.sold_out_date(F.col("t"), F.lit(2025))).collect()]
    assert got == [dt.date(2026, 7, 18), dt.date(2025, 7, 18), None, None]


def test_sentences_squash_wide_space(spark):
    df = spark.createDataFrame([("甲　  乙。丙！\n\n 丁;戊",)], "t string")
    assert df.select(sentence_list(F.col("t"))).first()[0] == ["甲 乙。", "丙！", "丁;", "戊"]


def test_rule_pack_round_trip(spark):
    pack = quota.RulePack.from_rows(quota.ZH_PACK.to_df(spark).collect())
    assert pack.rules == quota.ZH_RULES
