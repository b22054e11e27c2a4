import json

from pyspark.sql import functions as F

from offerlens.functions import urls
from offerlens.operators import extract, state
from offerlens.streaming import jobs

CAP = "doc_id int, final_url string, text string"


def test_page_parsing_and_quarantine(spark):
    html = (
        "<html><head><title>活動訊息 | 站名</title><script>var x='<p>no</p>'</script></head><body><h1>夏日 <b>回饋</b></h1>"
        "<p>第一段&amp;nbsp;</p><style>p{}</style>text<br>next <a href='../x?a=1'>see <i>it</i></a><a>no link</a></body></html>"
    )
    docs = extract.extract_pages(spark.createDataFrame([(1, "https://e.example.com/a/b", html), (2, "https://e.example.com/", None)], CAP))
    rows = {r.doc_id: r for r in extract.resolve_titles(docs.filter("status = 'ok'")).collect()}
    assert rows[1].title == "夏日 回饋"
    assert [tuple(x) for x in rows[1].links] == [("https://e.example.com/x?a=1", "see it")]
    assert rows[1].text.split("\n") == ["活動訊息 | 站名", "夏日 回饋", "第一段", "text", "next see itno link"]
    assert [r.doc_id for r in extract.failures(docs).collect()] == [2]


def test_shared_title_wins_and_lone_heading(spark):
    html = '<title>t</title><meta property="og:title" content="分享的標題"><h2>first</h2><h1>second</h1>'
    r = extract.extract_pages(spark.createDataFrame([(1, "https://e/", html)], CAP)).first()
    assert (r.raw_title, r.heading) == ("分享的標題", "first")


def test_detail_hides_siblings(spark):
    body = {"body": {"campaignDetail": {"systemSeq": "1", "title": "甲活動", "content": "<p>內容</p>"}, "recommendedCampaigns": [{"title": "（活動額滿）乙"}]}}
    rows = [(1, "https://e/", json.dumps(body)), (2, "https://e/", '{"a": [{"name": "abc", "u": "https://e/x."}, "loose"], "n": 1}'), (3, "https://e/", "{broken")]
    got = {r.doc_id: r for r in extract.flatten_json(spark.createDataFrame(rows, CAP)).collect()}
    assert got[1].text == "systemSeq: 1\ntitle: 甲活動\ncontent: 內容" and got[1].raw_title == "甲活動"
    assert got[2].text == "name: abc\nu: https://e/x." and [x.url for x in got[2].links] == ["https://e/x"]
    assert got[3].status == "failed"


def test_canonical_urls(spark):
    cases = [
        ("HTTPS://A.Example.com?b=2&a=1&utm_source=x#f", "https://a.example.com/?a=1&b=2"),
        ("https://a.example.com/p?q=%E5%A4%8F+x&flag&z=~*", "https://a.example.com/p?flag=&q=%E5%A4%8F+x&z=~%2A"),
        (" https://a.example.com/p?x=%zz ", "https://a.example.com/p?x=%25zz"),
        ("https://u@a.example.com:8080/x", "https://u@a.example.com:8080/x"),
    ]
    df = spark.createDataFrame(cases, "u string, want string")
    for r in df.select("want", urls.canonical_url(F.col("u")).alias("got")).collect():
        assert r.got == r.want
    rel = spark.createDataFrame([("../x/./y?b=1#z", "https://e.com/a/b/c"), ("?q=1", "https://e.com/a/b"), ("//h.com/p", "http://e.com/"), ("/r", "https://e.com/a")], "u string, b string")
    got = [r[0] for r in rel.select(urls.resolve_url(F.col("u"), F.col("b"))).collect()]
    assert got == ["https://e.com/a/x/y?b=1#z", "https://e.com/a/b?q=1", "http://h.com/p", "https://e.com/r"]


def test_discover_links_limits_and_excludes_self(spark):
    links = [("https://e.example.com/event/1?utm_source=a", "x"), ("https://e.example.com/event/1", "dup"), ("https://other.org/event/9", "off"), ("https://e.example.com/list", "event self"), ("https://e.example.com/event/2", "y"), ("https://e.example.com/event/3", "z")]
    df = spark.createDataFrame([("s", "https://e.example.com/list", links)], "source_id string, final_url string, links array<struct<url:string,anchor:string>>")
    out = extract.discover_links(df, {"s": ["event"]}, {"s": 2}, domains=["example.com"]).orderBy("pos").collect()
    assert [(r.link_url, r.anchor, r.total_found) for r in out] == [(links[0][0], "x", 3), (links[4][0], "y", 3)]


def test_history_helpers(spark):
    h = spark.createDataFrame([("b", "z"), ("a", "y"), ("a", "x")], "provider_name string, title string")
    assert [r.title for r in state.load_history(h).collect()] == ["x", "y", "z"]
    assert state.is_bootstrapped(h) and not state.is_bootstrapped(h.limit(0))
    df = spark.createDataFrame([(["c"], ["a", "b", "c"])], "cur array<string>, prev array<string>")
    assert df.select(state.merge_components(F.col("cur"), F.col("prev"))).first()[0] == ["b", "a", "c"]


OBS = "k string, ts timestamp, quota_status string"


def test_tracker_over_several_batches(spark, tmp_path):
    """Batch and stream agree, late observations do not overwrite, replays change nothing, changes are fed."""
    src, table, ckpt = (str(tmp_path / n) for n in ("src", "log", "ckpt"))
    first = [("a", "2024-01-02", "not_marked_full"), ("b", "2024-01-02", "unknown_app_only"), ("c", "2024-01-02", "sold_out")]
    second = [("a", "2024-01-03", "sold_out"), ("b", "2024-01-01", "confirmed_available"), ("c", "2024-01-03", "not_marked_full")]

    def write(rows):
        df = spark.createDataFrame(rows, "k string, t string, quota_status string")
        df.select("k", F.col("t").cast("timestamp").alias("ts"), "quota_status").coalesce(1).write.mode("append").parquet(src)

    def step():
        stream = spark.readStream.schema(OBS).parquet(src)
        jobs._finish(jobs.track_status(stream, ["k"], "quota_status", ["ts"], table, ckpt))

    write(first)
    step()
    write(second)
    step()
    step()
    now = {r.k: r.quota_status for r in jobs.current_status(spark, table, ["k"]).collect()}
    assert now == {"a": "sold_out", "b": "unknown_app_only", "c": "sold_out"}
    batch = state.sticky_status(spark.read.parquet(src), ["k"], "quota_status", ["ts"])
    assert {r.k: r.quota_status for r in batch.collect()} == now
    last = spark.read.parquet(table).agg(F.max("batch_id")).first()[0]
    feed = [tuple(r) for r in jobs.change_feed(spark, table, ["k"], last).select("k", "from_status", "to_status").collect()]
    assert feed == [("a", "not_marked_full", "sold_out")]
