"""The frontier over a local site, the folder of landed pages, and the landing stream."""

import datetime
import http.server
import json
import threading
import time

import pytest
from pages import script
from pyspark.sql import functions as F

from playbill import model
from playbill.sources import base, frontier, store
from playbill.sources.landing import LandingSource

DAY = datetime.date(2026, 3, 20)


def film(slug, directors, poster):
    return json.dumps({"id": slug, "slug": slug, "title": slug, "sessions": [{"date": "2026-03-25", "time": {"start": "21:30"}}], "directors": directors, "poster": poster})


@pytest.fixture
def site():
    """Nine venues on one server; `seen` has every request, in order and with its time."""
    seen, pages = [], {}

    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            seen.append((self.path, time.monotonic()))
            body = pages.get(self.path)
            self.send_response(404 if body is None else 200)
            self.end_headers()
            self.wfile.write((body or "").encode())

        def do_POST(self):  # noqa: N802
            self.rfile.read(int(self.headers["Content-Length"]))
            self.do_GET()

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    days = [(DAY + datetime.timedelta(days=k)).isoformat() for k in range(14)]
    pages |= {f"/c/Programacao.aspx?date={d}": '<a href="?id=5"><div>25/03/2026, 15h30</div><div class="infoTitle">DUNE</div><div>1984 - 137 min</div><span class="colorPink">de </span>Ana Sá</a>' for d in days[1:]}
    pages[f"/c/Programacao.aspx?date={days[0]}"] = '<a href="?id=7"><div>20/03/2026, 15h30</div><div class="infoTitle">ONE SHORT | TWO SHORT</div></a><a href="?id=8"><div>20/03/2026, 19h00</div><div class="infoTitle">THE SHINING</div></a>'
    pages["/Programacao.aspx?id=7&date=2026-03-20"] = pages["/Programacao.aspx?id=8&date=2026-03-20"] = "nothing"
    event = lambda k, link, kind="filme": {"id": k, "link": link, "class_list": [f"categoria-de-evento-{kind}"], "title": {"rendered": f"T{k}"}}
    pages["/s/wp-json/evento?after=2026-02-18T00:00:00"] = json.dumps([event(1, f"{url}/s/e1"), event(2, f"{url}/s/e2", "concerto"), event(3, f"{url}/s/gone")])
    pages["/s/e1"] = "x"
    shown = {"a": {"title": "A", "url": f"{url}/filmes/a", "theaters": {"x": "1"}}, "b": {"title": "B", "url": f"{url}/eventos/b", "theaters": {"x": "1"}}, "c": {"title": "C", "url": f"{url}/filmes/a", "theaters": {}}}
    pages["/m/filmes-em-exibicao"], pages["/filmes/a"] = script({"schedule": {"events": shown}}), script({"film": {}})
    pages["/f/Programacao"] = '<h2>>Programação<</h2><h2><b>qua, 25 mar</b><br>21h00 - <a href="DOG">DOG</a><br>22h00 - <a href="DOG">DOG</a></h2>'
    pages["/DOG"] = "<h1>Dog</h1>"
    pages["/b/fetch"] = json.dumps({"error": None, "items": []})
    pages["/t/programa"] = "<script>" + json.dumps([film("p", ["2", "3"], "9"), film("q", ["2"], None), " " * 1000]) + "</script>"
    pages |= {"/api/directors/2": "{}", "/api/directors/3": "{}", "/api/media/9": "{}"}
    pages |= {"/i/session/with-movies": "[]", "/i/no-cinema/": "x"}
    pages["/en/whats-on/schedule/events/?typology=5"] = '<a href="/en/whats-on/full-view/">x</a><a href="/en/whats-on/indie/?a=1">I</a><a href="/en/whats-on/indie">again</a>'
    # what an event page leads to is parsed for the venue's own address alone
    pages["/en/whats-on/indie"] = "x"
    pages["/g/home"] = "x"
    yield url, seen, pages, days
    server.shutdown()


def starts(url):
    return (
        frontier.Start("sao_jorge", url + "/s/wp-json/evento?after={since}T00:00:00", back=30),
        frontier.Start("cinemateca", url + "/c/Programacao.aspx?date={day}", days=14),
        frontier.Start("medeia", url + "/m/filmes-em-exibicao"),
        frontier.Start("fernando", url + "/f/Programacao"),
        frontier.Start("batalha", url + "/b/fetch", options={"post": "{}", "errorfield": "error"}),
        frontier.Start("trindade", url + "/t/programa", options={"attempts": "2", "pause": "0", "expect": "<script"}),
        frontier.Start("ideal", url + "/i/session/with-movies"),
        frontier.Start("ideal", url + "/i/no-cinema/"),
        frontier.Start("culturgest", url + "/en/whats-on/schedule/events/?typology=5", options={"prime": url + "/g/home", "ajax": "true"}),
    )


def test_from_nine_addresses_every_page_once(spark, site, tmp_path):
    url, seen, pages, days = site
    path = f"file://{tmp_path}/landing"
    go = lambda **more: frontier.crawl(spark, path, F.lit(DAY), starts(url), records=f"{url}/api", festival=f"{url}/fest", **more)
    assert go(pause=0.02) == 2 and len(starts(url)) == 9
    asked = [p for p, _ in seen if p != "/g/home"]
    assert sorted(asked) == sorted(set(pages) - {"/g/home"} | {"/s/gone"})
    assert [d for d in days if f"/c/Programacao.aspx?date={d}" in asked] == days and not any("2026-04-03" in p for p in asked)
    at = [t for _, t in seen]
    assert min(b - a for a, b in zip(at, at[1:])) >= 0 and sum(b - a >= 0.019 for a, b in zip(at, at[1:])) >= len(set(asked)) - 12  # one host, one after another
    rows = store.landed(spark, path).collect()
    assert len(rows) == len({(r["source"], r["url"]) for r in rows}) and {r["url"].removeprefix(url): r["status"] for r in rows}["/s/gone"] == 404
    # nothing new: nothing is asked for; out of date: all of it again
    before = len(seen)
    assert go(pause=0) == 0 and len(seen) == before
    later = max(r["fetched_at"] for r in rows) + datetime.timedelta(microseconds=1)
    assert go(pause=0, since=F.lit(later)) == 2 and len(seen) == 2 * before
    assert store.landed(spark, path).count() == 2 * len(rows)


def test_frontier_of_odd_landings(spark):
    none = frontier.frontier(spark.createDataFrame([], model.LANDING), F.lit(DAY))
    got = [tuple(r) for r in none.collect()]
    assert len(got) == 8 + 14 and ("cinemateca", "https://cinemateca.pt/Programacao.aspx?date=2026-04-02") in got
    assert any("after=2026-02-18T" in u for _, u in got) and len(set(got)) == len(got)
    at = datetime.datetime(2026, 3, 20, 8)
    rows = [(s.source, s.url, at, 200, body) for s in frontier.STARTS for body in ("", "{", "[]", "<a href=")] + [(None, None, None, None, None), ("medeia", "u", at, 200, None)]
    assert frontier.links(spark.createDataFrame(rows, model.LANDING), F.lit(DAY)).count() == 0


def test_next_candidates(spark):
    wanted = spark.createDataFrame([("1", 0, "lbxd", "a"), ("1", 1, "lbxd", "b"), ("2", 0, "lbxd", "a"), ("2", 1, "lbxd", "c"), ("3", 0, "lbxd", "d")], "id string, pos int, source string, url string")
    tried = spark.createDataFrame([("lbxd", "a"), ("omdb", "d")], frontier.ADDRESS)
    settled = spark.createDataFrame([("2",)], "id string")
    assert sorted(r["url"] for r in frontier.next_candidates(wanted, ["id"], tried, settled).collect()) == ["b", "d"]


def test_plans_read_their_own_pages(spark, tmp_path):
    path = f"file://{tmp_path}/landing"
    at = datetime.datetime(2026, 3, 20, 8)
    rows = [(s, f"https://{s}/{k}", at, 200, f"body {k}") for s in ("a", "b") for k in range(200)] + [("a", "https://a/3", at + datetime.timedelta(hours=1), 200, "newer"), ("a", "https://a/4", at, 500, None)]
    store.land(spark.createDataFrame(rows, model.LANDING), path)
    landing = store.landed(spark, path)
    explained = lambda df: df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    plan = explained(base.pages(landing, "a"))
    assert "PartitionFilters: [isnotnull(source" in plan and "(source" in plan.split("PartitionFilters:")[1].split("\n")[0]
    wanted = spark.createDataFrame([("x", "https://a/3"), ("y", "https://a/4"), ("z", "https://a/none"), ("w", "https://a/3")], "id string, url string").where("id <> 'q'")
    found = store.looked_up(wanted, landing, "a")
    assert {(r["id"], r["body"]) for r in found.collect()} == {("x", "newer"), ("w", "newer"), ("y", "body 4")}
    assert "dynamicpruning" in explained(found).lower()


@pytest.fixture
def shaky(tmp_path):
    """Pages that fail at first: /once at its first request of each day, /never always."""
    seen = []

    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            seen.append(self.path)
            good = "never" not in self.path and ("once" not in self.path or seen.count(self.path) > 1)
            self.send_response(200 if good else 503)
            self.end_headers()
            self.wfile.write(f"{self.path} {seen.count(self.path)}".encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_stream_lands_every_address_once_a_day(spark, shaky, tmp_path):
    """Stops between attempts, days and in the midst of a batch: nothing is lost and nothing comes twice."""
    url, seen = shaky
    spark.dataSource.register(LandingSource)
    urls = "\n".join([f"{url}/a?{{day}}", f"{url}/once?{{day}}", f"{url}/never?{{day}}", f"{url}/w?{{window}}", f"{url}/a?{{day}}"])
    batches, fail = [], [False]

    def keep(batch, number):
        rows = batch.collect()
        if fail[0]:
            raise RuntimeError("stopped in the midst")
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
        batches.append((number, {(r["url"].removeprefix(url), r["status"]) for r in rows}))

    def go(until):
        stream = spark.readStream.format("landing").option("source", "s").option("urls", urls).option("from", "2026-03-20").option("until", until)
        stream = stream.option("attempts", "2").option("window", "2").option("spool", f"file://{tmp_path}/spool").load()
        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/ck").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    go("2026-03-20 1")
    assert batches.pop() == (0, {("/a?2026-03-20", 200), ("/w?2026-03-20", 200), ("/w?2026-03-21", 200)})
    fail[0] = True
    with pytest.raises(Exception, match="in the midst"):
        go("2026-03-20 2")
    asked = list(seen)
    fail[0] = False
    go("2026-03-20 2")  # the batch is run again, from the spool
    assert batches.pop() == (1, {("/once?2026-03-20", 200), ("/never?2026-03-20", 503)}) and seen == asked
    go("2026-03-20 2")
    assert not batches and seen == asked
    go("2026-03-22")  # two days at once
    assert batches.pop() == (2, {(f"/{p}?2026-03-{d}", 503 if p == "never" else 200) for d in (21, 22) for p in ("a", "once", "never", "w")} | {("/w?2026-03-23", 200)})
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    pairs = [(r["url"], r["fetched_at"]) for r in got]
    assert len(pairs) == len(set(pairs)) == 5 + 10 and max(seen.count(p) for p in seen if "w?" not in p) == 2
