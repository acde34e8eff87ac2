import http.server
import threading

import pytest
from pyspark.sql import functions as F

from millrace.operators import frontier, stats, store
from millrace.operators.tables import Work
from millrace.plans import crawl
from millrace.settings import Settings
from millrace.sources import readers
from millrace.streaming import log as stream


def test_enqueue(spark):
    new = spark.createDataFrame([(1, "https://a.com/1", 2), (2, "https://a.com/1", 0), (3, "https://b.com/1", 0), (4, "https://a.com/2", 1)], "seq long, url string, depth int")
    known = spark.createDataFrame([("https://a.com/2",)], "url string")
    saved = spark.createDataFrame([("b.com", 5)], "domain string, n long")
    got = {r["url"]: tuple(r)[1:] for r in frontier.enqueue(new, known, saved, Settings(domain_budget=5)).select("url", "depth", "status", "skip_reason").collect()}
    assert got == {"https://a.com/1": (2, "queued", None), "https://b.com/1": (0, "skipped", "domain_budget_exceeded")}


def test_robots_rules():
    text = "User-agent: *\nDisallow: /private\nAllow: /private/open\nCrawl-delay: 3\n\nUser-agent: millrace\nDisallow: /*.pdf$\n"
    assert frontier.robots_allow(text, "other", "/private/x") is False and frontier.robots_allow(text, "other", "/private/open") is True
    assert frontier.robots_allow(text, "millrace/1", "/private/x") is True and frontier.robots_allow(text, "millrace/1", "/a.pdf") is False and frontier.robots_allow(None, "x", "/") is True
    assert frontier.parse_robots(text, "other")[1] == 3.0


def test_upsert(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, url string, title string")
    new = spark.createDataFrame([(1, "b", "y1"), (2, "b", "y2"), (3, "c", "z")], "seq long, url string, title string")
    assert sorted(tuple(r) for r in store.upsert(t, new, "seq").collect()) == [(1, "a", "x"), (2, "b", "y2"), (3, "c", "z")]


def test_search_bounds(spark):
    t = spark.createDataFrame([(1, "a", "T", "m", 0.5, "p", "2024")], "id long, url string, title string, main_content string, quality_score double, page_type string, published_date string")
    assert store.search(t, "").count() == 1 and store.search(t, "%").count() == 1 and store.search(t, least_quality=0.6).count() == 0
    for bad in ({"limit": 0}, {"limit": 201}, {"offset": -1}, {"sort": "x"}):
        with pytest.raises(ValueError):
            store.search(t, **bad)


def test_empty_statistics(spark):
    from millrace import schemas

    log, articles = spark.createDataFrame([], schemas.CRAWL_LOG), spark.createDataFrame([], schemas.ARTICLES)
    r = stats.totals(log, articles).first()
    assert r["total_attempted"] == 0 and r["crawl_success_rate"] == 0.0 and r["avg_quality"] == 0.0
    assert stats.per_domain(log, articles).count() == 0


def test_seeds(spark, tmp_path):
    (tmp_path / "s.txt").write_text("https://a.com\n# no\n  # kept\n\n https://b.com \n")
    assert sorted(r["url"] for r in readers.seeds(spark, str(tmp_path / "s.txt")).collect()) == ["# kept", "https://a.com", "https://b.com"]
    for bad in ([], ["# x"], ["u"] * 31):
        with pytest.raises(ValueError):
            readers.seed_list(spark, bad)
    (tmp_path / "p.html").write_text("<p>x</p>")
    assert [tuple(r) for r in readers.fixtures(spark, str(tmp_path)).collect()] == [("p", "https://example.com/p", "<p>x</p>")]
    assert readers.database_url("postgres://h/d") == "jdbc:postgresql://h/d" and readers.database_url("x.db") == "jdbc:sqlite:x.db"


def test_fetch(spark):
    class H(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(403 if self.path == "/no" else 200)
            self.end_headers()
            self.wfile.write(b"<p>hi</p>")

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    got = {r["url"]: r for r in readers.fetch(spark, [f"{base}/a", f"{base}/no", "http://127.0.0.1:1/x"], delay=0, timeout=5).collect()}
    server.shutdown()
    assert got[f"{base}/a"]["status"] == 200 and got[f"{base}/a"]["html"] == "<p>hi</p>" and got[f"{base}/no"]["status"] == 403
    assert got["http://127.0.0.1:1/x"]["status"] == 0 and got["http://127.0.0.1:1/x"]["blocked_reason"]


WORDS = " ".join(f"w{i}" for i in range(300))
BODY = "<article><h1>{t}</h1><p>{b}</p></article>"


def test_curation_trace(spark):
    page = lambda t, b: BODY.format(t=t, b=b)
    rows = [
        (1, "https://e.com/news/clean", 200, page("Clean", WORDS)), (2, "https://e.com/category/x", 200, page("C", WORDS)), (3, "https://e.com/news/cf", 200, "Just a moment"), (4, "https://e.com/archive/2021/05/page/400", 200, "x"),
        (5, "https://e.com/amp/news/clean", 200, page("Clean", WORDS)), (6, "https://e.com/news/copy", 200, page("Clean", WORDS + " end")), (7, "https://e.com/news/gone", 404, None), (8, "https://e.com/news/new", 200, page("New", WORDS[::-1])),
    ]
    d = spark.createDataFrame(rows, "seq long, url string, status int, html string").withColumn("headers", F.lit(None).cast("map<string,string>"))
    articles, log = crawl.curate(d, Work(spark, "t"), F.lit("2024-06-01 00:00:00").cast("timestamp"))
    assert {r["seq"]: r["decision"] for r in log.collect()} == {1: "saved", 2: "skipped", 3: "blocked", 4: "skipped", 5: "duplicate", 6: "duplicate", 7: "skipped", 8: "saved"}
    assert sorted(r["seq"] for r in articles.collect()) == [1, 8]


def test_crawl_rounds(spark):
    base = "https://e.com/news/"
    page = lambda t, *to: BODY.format(t=t, b=" ".join(f"{t}{i}" for i in range(300))) + "".join(f"<a href='{base}{x}'>{x}</a>" for x in to)
    held = {"a": page("a", "b", "cf", "gone", "a"), "b": page("b", "copy", "c"), "cf": "Just a moment", "copy": page("a", "z"), "c": page("c", "d"), "d": page("d")}
    pages_ = spark.createDataFrame([(base + k, v) for k, v in held.items()] + [("https://e.com/category/x", page("x", "never"))], "url string, html string")
    seeds = spark.createDataFrame([(0, base + "a"), (1, "https://e.com/category/x"), (2, base + "a")], "seq long, url string")
    known, articles = crawl.crawl(spark, seeds, pages_, Work(spark, "t"), 2)
    got = {r["url"].rsplit("/", 1)[1]: (r["depth"], r["status"], r["skip_reason"]) for r in known.collect()}
    reason = got.pop("x")
    assert reason[:2] == (0, "skipped") and reason[2]
    # links of the copy and of pages that are not content are not taken, those at the last depth neither
    assert got == {"a": (0, "done", None), "b": (1, "done", None), "cf": (1, "blocked", None), "gone": (1, "in_progress", None), "copy": (2, "in_progress", None), "c": (2, "done", None)}
    assert sorted(r["url"].rsplit("/", 1)[1] for r in articles.collect()) == ["a", "b", "c"]
    tight = crawl.crawl(spark, seeds, pages_, Work(spark, "t"), 2, Settings(domain_budget=1))[0]
    got = {r["url"].rsplit("/", 1)[1]: r["skip_reason"] for r in tight.collect()}
    assert got["b"] == got["cf"] == got["gone"] == "domain_budget_exceeded" and "c" not in got
    nothing = crawl.crawl(spark, seeds.limit(0), pages_.limit(0), Work(spark, "t"), 2)
    assert nothing[0].count() == nothing[1].count() == 0


def test_jobs():
    job = crawl.Job(["x"])
    with pytest.raises(RuntimeError):
        job.run(lambda j: (_ for _ in ()).throw(RuntimeError("no")))
    assert job.status == "error" and len(job.id) == 8


def test_event_stream(spark, tmp_path):
    from millrace import schemas

    row = dict.fromkeys([c.split()[0] for c in schemas.CRAWL_LOG.split(", ")])
    rows = [{**row, "id": i, "url": f"https://e.com/{i % 3}", "status": "200", "blocked": i == 0, "extraction_ok": True} for i in range(5)]
    spark.createDataFrame([tuple(r.values()) for r in rows], schemas.CRAWL_LOG).withColumn("crawled_at", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 20)")).coalesce(1).write.parquet(str(tmp_path / "log"))
    seen = []
    q = stream.send(stream.read_log(spark, str(tmp_path / "log")), lambda k, v: seen.append((k, v)), str(tmp_path / "cp"))
    q.awaitTermination()
    assert [r["id"] for k, v in seen if k == "log" for r in v] == [0, 1, 2, 3, 4] and {r["decision"]: r["n"] for r in seen[-1][1]} == {"blocked": 1, "saved": 4}
    assert stream.frames("close", []).startswith("event: close") and stream.frames("log", [{"id": 1}]).startswith("data: ")
    out = str(tmp_path / "first")
    q = stream.first_sights(stream.read_log(spark, str(tmp_path / "log"))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp2")).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_repeated_urls_in_writes(spark):
    from millrace.operators import frontier, store

    table = spark.createDataFrame([("a",)], "url string")
    rows = spark.createDataFrame([("b", 2, 20), ("b", 1, 10), ("a", 3, 30), ("c", 4, 40), (None, 6, 60), (None, 5, 50)], "url string, seq int, x int")
    assert sorted(map(tuple, store.insert_absent(table, rows, "seq").collect()), key=str) == [("b", 1, 10), ("c", 4, 40), (None, 5, 50)]
    held = spark.createDataFrame([("a", "queued", None), ("b", "queued", "old")], "url string, status string, skip_reason string")
    updates = spark.createDataFrame([("a", "done", None, 3), ("a", "skipped", "late", 2), ("a", "in_progress", "first", 1)], "url string, status string, skip_reason string, seq int")
    assert sorted(map(tuple, frontier.mark(held, updates).collect())) == [("a", "done", "late"), ("b", "queued", "old")]
    articles = spark.createDataFrame([("a", "x"), ("b", "y")], "url string, next_recrawl_at string")
    times = spark.createDataFrame([("a", "new", 2), ("a", "old", 1)], "url string, next_at string, seq int")
    assert sorted(map(tuple, store.set_recrawl(articles, times).collect())) == [("a", "new"), ("b", "y")]


def test_tail_is_sorted_in_ranges(spark):
    """No task gets all rows, as with an offset in the plan; equal ids and nulls are counted one by one."""
    log = spark.createDataFrame([(i, f"u{k}") for k, i in enumerate([None, None, 1, 1, 1, 2, 3, 3, 4])], "id long, url string")
    for offset in range(11):
        out = store.tail(log, offset)
        assert [r["id"] for r in out.collect()] == [None, None, 1, 1, 1, 2, 3, 3, 4][offset:]
        assert out.columns == ["id", "url"]
    plan = store.tail(spark.range(100).withColumn("url", F.lit("u")), 10)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(id" in plan and "offset=" not in plan.lower().replace("offset=0", "") and "GlobalLimit" not in plan
