"""Linkage against a pairwise brute force and the golden cases."""

import random
import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.functions import titles
from offerlens.operators import linkage, quota, similarity

SOLD, PART = "本活動回饋已全數額滿", "7月份週六加碼已額滿"
ACT = "activity_id string, provider_id string, url string, title string, text string, quota_status string"
ANN = "announcement_id string, provider_id string, url string, title string, text string"


def run(spark, acts, anns):
    a = linkage.keyed_activities(spark.createDataFrame(acts, ACT))
    n = linkage.keyed_announcements(quota.assess(spark.createDataFrame(anns, ANN), "text"))
    rows = linkage.apply_matches(a, n).select("activity_id", "matched", "new_status").collect()
    return {r.activity_id: (r.matched, r.new_status) for r in rows}


def test_golden_cases(spark):
    e = "https://example.com/"
    cases = [
        # provider per case, so cases cannot meet each other
        ((e + "event/1", "活動訊息", "2026/7/1-8/31"), (e + "event/2", "活動訊息", "另一活動已額滿"), False),
        ((e + "event?EventId=89", "延三夜市回饋", ""), (e + "news/1", "全支付夜市活動額滿通知", "EventId=89 已額滿"), True),
        ((e + "event?EventId=8", "活動八", ""), (e + "news/1", "另一個活動公告", f"official_link: {e}event?EventId=82 指定活動已額滿"), False),
        ((e + "events/summer?b=2&a=1", "夏日活動", ""), (e + "news/1", "公告", f"official_link: {e}events/summer?a=1&b=2 回饋已額滿"), True),
        ((e + "event/2", "悠遊付「迺夜市最高35%回饋」", "活動期間：2026/7/1～2026/8/31"), (e + "news/2", "【額滿公告】悠遊付 迺夜市 7月週六加碼回饋已額滿", PART), True),
        ((e + "event/aug", "台灣Pay×OK超商", "活動期間：2026/8/1～2026/8/31"), (e + "news/jul", "台灣Pay×OK超商 7月回饋已額滿", "2026年7月份已額滿"), False),
        # The same page under both roles is not linked to itself.
        ((e + "event?a=1&b=2", "同一頁活動名稱", ""), (e + "event?b=2&a=1", "同一頁活動名稱", SOLD), False),
    ]
    acts = [(f"a{i}", f"p{i}", *a, "not_marked_full") for i, (a, _, _) in enumerate(cases)]
    anns = [(f"n{i}", f"p{i}", *n) for i, (_, n, _) in enumerate(cases)]
    got = run(spark, acts, anns)
    assert [got[f"a{i}"][0] for i in range(len(cases))] == [want for _, _, want in cases]


def test_status_precedence(spark):
    u = "https://example.com/event?EventId="
    acts = [("a1", "p", u + "10", "", "", "not_marked_full"), ("a2", "p", u + "20", "", "", "sold_out"), ("a3", "p", u + "30", "", "", "unknown_app_only")]
    anns = [
        ("n1", "p", "https://n/1", "", "EventId=10 " + SOLD),
        ("n2", "p", "https://n/2", "", "EventId=10 7月份回饋已額滿"),
        ("n3", "p", "https://n/3", "", "EventId=20 7月份回饋已額滿"),
        ("n4", "p", "https://n/4", "", "EventId=30 若額滿則停止回饋"),
    ]
    got = run(spark, acts, anns)
    assert got == {"a1": (True, "sold_out"), "a2": (True, "sold_out"), "a3": (False, "unknown_app_only")}


CHARS = "夜市超商週末滿額現金券日咖啡外送百貨全國加油站ABC12"


def _titles(seed, n):
    rng = random.Random(seed)
    stems = ["".join(rng.choices(CHARS, k=rng.randint(1, 14))) for _ in range(n)]
    out = list(stems)
    for s in stems:
        t = list(s)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(CHARS)
        out += ["".join(t), s + rng.choice(CHARS), s]
    return out


def test_similar_titles_against_all_pairs(spark):
    """Every pair at the threshold is found, for short and long titles, with one hot provider."""
    left = [("hot" if i % 3 else "p2", t.lower()) for i, t in enumerate(_titles(1, 60))]
    right = [("hot" if i % 3 else "p2", t.lower()) for i, t in enumerate(_titles(1, 60)[::-1] + _titles(2, 30))]
    cols = "provider_id string, norm string"
    got = linkage.similar_titles(spark.createDataFrame(left, cols), spark.createDataFrame(right, cols)).collect()
    want = {
        (p, a, b)
        for p, a in set(left)
        for q, b in set(right)
        if p == q and SequenceMatcher(None, a, b).ratio() >= 0.78
    }
    assert {(r.provider_id, r.a_norm, r.n_norm) for r in got} == want
    assert len(got) == len(want) > 100


def test_contained_cores_against_all_pairs(spark):
    left = [("p", t) for t in _titles(3, 50)]
    right = [("p", t) for t in _titles(3, 50) + [a[:5] for _, a in left]]
    cols = "provider_id string, core string"
    got = linkage.contained_cores(spark.createDataFrame(left, cols), spark.createDataFrame(right, cols)).collect()
    want = {
        (a, b)
        for _, a in left
        for _, b in right
        if min(len(a), len(b)) >= 3 and (a in b or b in a)
    }
    assert {(r.a_core, r.n_core) for r in got} == want and len(got) == len(want)


def test_title_statuses_against_brute_force(spark):
    """Whole title rule, pair by pair: ratio or containment, generic and month vetoes."""
    rng = random.Random(5)
    names = _titles(7, 25)
    acts = [(f"a{i}", "p", f"https://a/{i}", t + rng.choice(["", " 7月", " 8月"]), rng.choice(["", "2026/7/1"]), "not_marked_full") for i, t in enumerate(names)]
    anns = [(f"n{i}", "p", f"https://n/{i}", t + rng.choice(["", "優惠", "7月"]), rng.choice([SOLD, PART, "若額滿則停止回饋"])) for i, t in enumerate(rng.sample(names, 40))]
    got = run(spark, acts, anns)
    df = spark.createDataFrame([(t,) for t in {x[3] for x in acts} | {x[3] for x in anns}], "t string")
    forms = {r.t: (r.n, r.c) for r in df.select("t", titles.normal_title(F.col("t")).alias("n"), titles.core_title(F.col("t")).alias("c")).collect()}

    def months(text):
        found = re.findall(r"(?<!\d)(\d{1,2})\s*月", text) + re.findall(r"20\d{2}[年/.\-](\d{1,2})[月/.\-]", text)
        return {int(m) for m in found if 1 <= int(m) <= 12}

    def match(a, n):
        (an, ac), (nn, nc) = forms[a[3]], forms[n[3]]
        if not an or not nn or {an, nn} & set(titles.GENERIC_MATCH_TITLES):
            return False
        ma, mn = months(a[3] + a[4]), months(n[3] + n[4])
        if ma and mn and not ma & mn:
            return False
        if SequenceMatcher(None, an, nn).ratio() >= 0.78:
            return True
        short, long_ = sorted((ac, nc), key=len)
        return len(short) >= 3 and short in long_

    hits = 0
    for a in acts:
        texts = [n[4] for n in anns if n[4] != "若額滿則停止回饋" and match(a, n)]
        want = "sold_out" if SOLD in texts else "partial_sold_out" if texts else "not_marked_full"
        hits += bool(texts)
        assert got[a[0]] == (bool(texts), want), a
    assert 10 < hits < len(acts)


def test_evidence_pairs(spark):
    acts = linkage.keyed_activities(spark.createDataFrame([("a", "p", "https://e/x?EventId=77", "夜市滿額現金活動", "", "x")], ACT))
    anns = linkage.keyed_announcements(
        quota.assess(
            spark.createDataFrame(
                [("n1", "p", "https://n/1", "夜市滿額現金活動", "EventId=77 " + SOLD), ("n2", "p", "https://n/2", "夜市滿額現金活動額滿通知", SOLD), ("n3", "p", "https://e/x?EventId=77", "夜市滿額現金活動", SOLD)],
                ANN,
            ),
            "text",
        )
    )
    links = linkage.activity_links(acts, linkage.title_links(acts, anns))
    out = linkage.evidence_of(acts.select("activity_id", "canonical_url", "norm"), links, linkage.announcement_links(anns))
    assert {(r.announcement_id, r.method) for r in out.collect()} == {("n1", "event_id_or_url"), ("n2", "normalized_title_period")}
    assert {r.kind for r in out.collect()} == {"latest_announcement:event_id_or_url:1.00", "latest_announcement:normalized_title_period:1.00"}


def test_hot_core_is_one_key_per_month_set(spark):
    """A campaign name with numbers: links stay as few as the month sets, not offers times notices."""
    acts = [(f"a{i}", "p", f"https://a/{i}", f"夜市滿額現金{i}", "", "not_marked_full") for i in range(40)]
    anns = [(f"n{i}", "p", f"https://n/{i}", f"夜市滿額現金{i + 500}", SOLD) for i in range(40)]
    a = linkage.keyed_activities(spark.createDataFrame(acts, ACT))
    n = linkage.keyed_announcements(quota.assess(spark.createDataFrame(anns, ANN), "text"))
    cores = linkage.title_links(a, n).filter("score IS NULL")
    assert cores.count() == 1
    assert all(r.new_status == "sold_out" for r in linkage.apply_matches(a, n).collect())


def all_pairs(left, right):
    return {(p, a, b): SequenceMatcher(None, a, b).ratio() for p, a in set(left) for q, b in set(right) if p == q and a and b and SequenceMatcher(None, a, b).ratio() >= 0.78}


@pytest.mark.parametrize("largest", [4096, 7])
def test_similar_titles_of_any_alphabet_against_all_pairs(spark, largest):
    """Mixed alphabets and lengths, hot providers, keys split by second and third grams and by blocks."""
    rng = random.Random(largest)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve 夜市 超商 滿額 現金 咖啡".split()
    stems = ["".join(rng.choices(syllables[: rng.choice((6, 30, 35))], k=rng.randint(1, 30))) for _ in range(24)] + ["".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(14)]

    def edited(t):
        out = list(t)
        for _ in range(rng.randint(0, len(out) // 4 + 1)):
            at = rng.randrange(len(out) + 1)
            out[at : at + rng.randint(0, 1)] = rng.choice(("", "x", "市", "th"))
        return "".join(out)

    titled = lambda n: [(rng.choice(("hot", "hot", "p2", None)), edited(rng.choice(stems))) for _ in range(n)]
    left, right = titled(220), titled(220) + [("hot", ""), ("hot", None)]
    left += right[:20]
    cols = "provider_id string, norm string"
    got = similarity.similar_titles(spark.createDataFrame(left, cols), spark.createDataFrame(right, cols), largest=largest).collect()
    want = all_pairs([x for x in left if x[0] and x[1]], [x for x in right if x[0] and x[1]])
    assert {(r.provider_id, r.a_norm, r.n_norm): r.score for r in got} == want
    assert len(got) == len(want) > 200


def test_no_key_stays_large_where_titles_share_enough(spark):
    """5000 titles of one provider and one phrase: keys of two and three grams hold a small share of them."""
    rng = random.Random(3)
    words = "dining market coffee weekend cashback summer voucher station online travel rewards member".split()
    rows = [(k, "hot", "special offer " + " ".join(rng.sample(words, 4)) + f" {k}") for k in range(5000)]
    keys = similarity.title_keys(spark.createDataFrame(rows, "id bigint, provider_id string, norm string"), largest=400)
    sizes = keys.groupBy("band", "key", "pair").count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * 400 + 100
    assert sizes.filter("key LIKE '% %'").count() > 0


def test_bounds_of_shared_grams_hold():
    """Whatever two titles reach the ratio, they share as many grams as the keys rely on, and lie in neighbouring bands."""
    rng = random.Random(12)
    lows = similarity.bands(0.78, 400)
    band = lambda t: sum(low <= len(t) for low in lows) - 1
    seen = 0
    for _ in range(6000):
        a = "".join(rng.choices("abcdef夜", k=rng.randint(1, 40)))
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 4 + 1)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(("", "x", "a"))
        b = "".join(b)
        if not b or SequenceMatcher(None, a, b).ratio() < 0.78:
            continue
        seen += 1
        low = lows[min(band(a), band(b))]
        assert abs(band(a) - band(b)) <= 1
        for width in (1, 2):
            grams = [Counter(t[k : k + width] for k in range(len(t) - width + 1)) for t in (a, b)]
            assert (grams[0] & grams[1]).total() >= max(similarity.shared_grams(len(t), low, 0.78, width) for t in (a, b))
    assert seen > 2000


def test_bound_of_matched_characters_is_the_longest_common_subsequence():
    rng = random.Random(13)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for k, y in enumerate(b):
                before, row[k + 1] = row[k + 1], before + 1 if x == y else max(row[k], row[k + 1])
        return row[-1]

    titles = ["".join(rng.choices("abcd夜", k=rng.choice((1, 5, 30, 63, 64, 65, 130, 600)))) for _ in range(60)]
    batch = similarity._Batch(titles, 0.78)
    pairs = [(i, j) for i in range(60) for j in range(60)]
    got = batch.close(np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))
    for (i, j), close in zip(pairs, got):
        a, b = sorted((titles[i], titles[j]), key=len)
        reach = 2 * lcs(a, b) >= 0.78 * (len(a) + len(b))
        assert close or not reach
        if len(a) <= similarity.PATTERN:
            assert close == reach


def test_titles_of_one_language_meet_once(spark):
    """Where most titles share most grams, all of a band meet once in pairs of blocks, not again under every gram."""
    rng = random.Random(8)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it".split()
    rows = [(k, "hot", "".join(rng.choices(syllables, k=20))) for k in range(300)]
    titles_ = spark.createDataFrame(rows, "id bigint, provider_id string, norm string")
    keys = similarity._meetings(similarity._keyed(titles_, 0.78), 64).collect()
    assert {r.key for r in keys} == {""}
    home = [r for r in keys if r.own]
    groups = {}
    for r in home:
        groups.setdefault((r.band, r.pair), []).append(r)
    met = Counter()
    for members in groups.values():
        for i, x in enumerate(members):
            for y in members[i + 1 :]:
                if x.side != y.side or x.side == 2:
                    met[frozenset((x.id, y.id))] += 1
    assert len({r.band for r in home}) == 1 and len(met) == 300 * 299 // 2 and set(met.values()) == {1}


def test_bound_of_common_characters_loses_no_pair():
    rng = random.Random(14)
    titles_ = ["".join(rng.choices("abcd夜", k=rng.choice((1, 5, 30, 64, 130)))) for _ in range(50)]
    batch = similarity._Batch(titles_, 0.78)
    pairs = [(i, j) for i in range(50) for j in range(50)]
    got = batch.common(np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))
    for (i, j), ok in zip(pairs, got):
        a, b = titles_[i], titles_[j]
        assert ok or 2 * (Counter(a) & Counter(b)).total() < 0.78 * (len(a) + len(b))
