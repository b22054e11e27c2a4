import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from offerlens.functions import rewards

GOLDEN = [
    ("生活圈 Pay你遊壢享20%回饋\n活動期間2026/7/1至2026/9/30，單筆消費不限金額享20%現金回饋，每一帳戶最高回饋新臺幣1,500元為限，活動總回饋上限50萬元。", 20.0, None),
    ("使用行動支付累積消費滿150元送50元優惠券。", None, 50.0),
    ("新戶完成首筆付款贈100元現金回饋", None, 100.0),
    ("消費總額享3.5%回饋，每人每月回饋上限150點，單筆交易回饋金上限300元，活動總金額47萬元為上限。", 3.5, None),
    ("海外交易另收1.5%手續費，分期年利率6%。", None, None),
    ("基本享3.5%回饋，首次付款再加碼最高享10%回饋。", 10.0, None),
    ("首刷送NT$1,200回饋", None, 1200.0),
    ("首刷送NT$ 300元回饋", None, 300.0),
    ("", None, None),
]


def test_golden_rewards(spark):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "i int, t string")
    rows = df.select(
        "i",
        F.array_max(rewards.reward_percents(F.col("t"))).alias("p"),
        F.array_max(rewards.fixed_rewards(F.col("t"))).alias("f"),
    ).collect()
    got = {r.i: (r.p, r.f) for r in rows}
    for i, g in enumerate(GOLDEN):
        assert got[i] == g[1:], g[0]


def test_both_money_forms_counted_once(spark):
    df = spark.createDataFrame([("送NT$300元回饋，送NT$50回饋，送NT$20元。",)], "t string")
    assert df.select(rewards.fixed_rewards(F.col("t"))).first()[0] == [300.0, 50.0]


PIECES = ["送", "NT$", "NTD ", "100", "元", "回饋", "，", "滿", "1,500", "上限", "優惠券", "20", "%", "享", "x" * 30, " "]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=300, max_size=300))
def test_fixed_mentions_against_offset_scan(spark, texts):
    """Brute force: scan with offsets and drop NT hits that start inside an accepted 元 hit."""
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.f for r in df.select("i", rewards.fixed_rewards(F.col("t")).alias("f")).collect()}
    cur = rewards.CURRENCY
    yuan = re.compile(rf"(?:{cur}\s*)?(?<![\d.])({rewards.AMOUNT})\s*元")
    nt = re.compile(rf"(?:NTD|NT\$)\s*({rewards.AMOUNT})", re.I)
    rx = {n: re.compile(getattr(rewards, n).replace("(?Ud)", "")) for n in ("FIXED_BEFORE", "FIXED_AFTER", "FIXED_NOT_BEFORE", "FIXED_NOT_AFTER")}

    def ok(text, m):
        before = re.sub(r"\s+", "", text[max(0, m.start() - 32) : m.start()])
        after = re.sub(r"\s+", "", text[m.end() : m.end() + 22])
        if rx["FIXED_NOT_AFTER"].search(after) or rx["FIXED_NOT_BEFORE"].search(before[-22:]):
            return False
        return bool(rx["FIXED_BEFORE"].search(before) and rx["FIXED_AFTER"].search(after))

    for i, t in enumerate(texts):
        spans = [m for m in yuan.finditer(t) if ok(t, m)]
        want = [float(m[1].replace(",", "")) for m in spans]
        want += [
            float(m[1].replace(",", ""))
            for m in nt.finditer(t)
            if not any(s.start() <= m.start() < s.end() for s in spans) and ok(t, m)
        ]
        assert got[i] == want, t
