"""Every venue's parser on small pages, and the whole refresh."""

import json
from functools import cache

import pytest
from pages import ASOF, landing
from pyspark.sql import functions as F

from playbill import model
from playbill.functions import html as H
from playbill.functions.temporal import lisbon_time
from playbill.plans import publish, refresh
from playbill.sources import catalogue, registry
from playbill.sources.cinemateca import films_of


@pytest.fixture(scope="module")
def movies(spark):
    rows = registry.extract(landing(spark), F.lit(ASOF)).collect()
    return {r["id"]: r for r in rows}


def times(m):
    return [(s["date"], s["time"]) for s in m["sessions"]]


def test_ideal(movies):
    m = movies["ideal_barrio_triste"]
    assert (m["title"], m["director"], m["poster"], m["festival"], m["src_rank"]) == ("Barrio Triste", "Ana Sá", "p.jpg", "INDIE Lisboa", 6)
    assert times(m) == [("2026-04-02", "14:30"), ("2026-04-03", "14:30")] and m["link"].endswith("movieid=7")
    assert movies["ideal_tom___ana"]["title"] == "Tom & Ana" and "ideal_cancelled" not in movies


def test_trindade(movies):
    m = movies["trindade_55"]
    assert (m["title"], m["director"], m["poster"], m["year"], m["duration"]) == ("Projeto Global", "Ivo Ferreira, Zé & Cia", "m.jpg", 2025, 100)
    assert times(m) == [("2026-03-22", "18:00"), ("2026-03-25", "21:30")] and m["sessions"][1]["labels"] == ["debate"] and m["sessions"][0]["labels"] is None


def test_batalha(movies):
    m = movies["batalha_F1"]
    assert (m["title"], m["director"], m["year"], m["duration"]) == ("Um & Dois", "A, B", 1999, 88)
    assert times(m) == [("2026-04-01", "22:15"), ("2026-04-02", "22:15")] and m["sessions"][0]["labels"] == ["Com X"]
    assert movies["batalha_g2"]["title"] == "Old Film"


def test_medeia(movies):
    m = movies["nimas_o-filme"]
    assert (m["title"], m["director"], m["year"], m["duration"], m["genres"]) == ("O Filme", "Eva & Rui", 2024, 90, ["Drama", "Crime"])
    assert times(m) == [("2026-03-21", "15:00"), ("2026-03-21", "21:30")] and m["sessions"][0]["labels"] == ["Presença da equipa e elenco"]
    assert times(movies["campo_alegre_o-filme"]) == [("2026-03-23", "19:00")]


def test_sao_jorge(movies):
    m = movies["sao_jorge_1"]
    assert (m["title"], m["director"], m["duration"], m["festival"], m["poster"]) == ("Cão & Gato", "João Canijo", 127, "Festa do Cinema", "f.jpg")
    assert m["genres"] == ["Drama", "Ficção Científica", "New Wave"] and times(m) == [("2026-03-29", "19:00"), ("2026-03-30", "20:00")]
    assert m["sessions"][0]["labels"] == ["Sessão de Abertura", "Conversa com Rita Silva,"] and "sao_jorge_2" not in movies and "sao_jorge_3" not in movies


def test_culturgest(movies):
    m = movies["culturgest_um-filme"]
    assert (m["title"], m["director"], m["poster"], times(m)) == ("Um Filme", "Ana Vaz", "https://www.culturgest.pt/a.jpg", [("2026-05-13", "19:00")])
    f = movies["culturgest_indie_blue_heron"]
    assert (f["duration"], f["festival"], times(f)) == (96, "INDIE", [("2026-05-02", "15:00")]) and f["link"].endswith("/aa")
    assert not any("talk" in k or "else" in k or "velho" in k or "unlisted" in k for k in movies if k.startswith("culturgest"))
    # the listing's order, which is not that of the addresses; the festival's films stand where the festival does
    ours = sorted((m for k, m in movies.items() if k.startswith("culturgest")), key=lambda m: m["src_ord"])
    assert [m["id"] for m in ours] == ["culturgest_indie_blue_heron", "culturgest_um-filme", "culturgest_another"] and movies["culturgest_another"]["title"] == "Another <3>"


def test_festival_days_need_a_listed_festival(spark):
    pages = landing(spark)
    day = pages.where("url not like '%/whats-on/indie'")
    assert {r["id"] for r in registry.extract(day.where("source = 'culturgest'"), F.lit(ASOF)).collect()} == {"culturgest_um-filme", "culturgest_another"}


def test_fernando(movies):
    m = movies["fernando_dogfight"]
    assert (m["title"], m["director"], m["year"], m["duration"], m["genres"], m["poster"]) == ("Dogfight", "Nancy Savoca", 1991, 94, ["Drama"], "https://freight.cargo.site/p.jpg")
    assert times(m) == [("2026-03-25", "21:00")] and m["sessions"][0]["labels"] == ["Última sessão"]
    series = {k: v for k, v in movies.items() if k.startswith("fernando_ciclo")}
    assert {v["title"] for v in series.values()} == {"Parte Um", "Parte Dois"} and {v["festival"] for v in series.values()} == {"Ciclo"}
    plain = movies["fernando_o_velho_e_a_espada"]
    assert plain["title"] == "O Velho E A Espada" and plain["sessions"][0]["labels"] == ["Sessão especial"]
    assert not any("nada" in k for k in movies)


def test_cinemateca(movies):
    m = movies["cinemateca_11"]
    assert (m["title"], m["director"], m["year"], m["duration"]) == ("The Shining", "Stanley Kubrick", 1980, 142)
    assert times(m) == [("2026-03-25", "15:30"), ("2026-03-26", "21:30")] and m["sessions"][0]["labels"] == ["Com a presença de Zé"]
    assert "cinemateca_12" not in movies
    assert [(movies[f"cinemateca_12_{k}"]["title"], movies[f"cinemateca_12_{k}"]["year"], movies[f"cinemateca_12_{k}"]["duration"]) for k in (0, 1)] == [("First Short", 1966, 4), ("Second Short", 1979, 44)]


def described(spark, *texts):
    rows = films_of(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), ["k"]).collect()
    found = {r["k"]: [(f["title"], f["director"], f["year"], f["duration"]) for f in r["films"]] for r in rows}
    return [found.get(k, []) for k in range(len(texts))]


def test_descriptions(spark):
    texts = [
        "A VIDA\nde Rui Sá\nPortugal, 1999 – 20 min\n\nOUTRA\nde Ana\nFrança, 2001/2002 - 30 min\nlegendado",
        "PRIMEIRO\r\nDOIS\nTRÊS\nde Ana\nPortugal, 1966, 1979 – 4, 44 min",
        None, "só texto", "",
        "UM FILME\n“Um”\nDOIS\ncom Zé e outros\nde Ana\nPortugal, 1966, 1979 – 4, 44 min\nUltimo\nde\u00a0Rui\nEUA, 2000 – 90 min\nDuração total: 138 min\nDEPOIS\nde Eva\nEUA, 2001 - 5 min",
        "Sem director\n1999 – 20 min\n\n\nBOM\nfrase em minúsculas\nde Eva\nde Rui e Eva\n1980 - 7 min",
        "de Ana\nA VIDA\nde Rui Sá\nPortugal, 1999 – 20 min\n\nFrança, 1999 – 20 min\nUM\nde Eva\nEUA, 2000 – 5 min",
    ]
    assert described(spark, *texts) == [
        [("A Vida", "Rui Sá", 1999, 20), ("Outra", "Ana", 2001, 30)],
        [("Primeiro", "Ana", 1966, 4), ("Dois", "Ana", 1979, 44), ("Três", "Ana", 1979, 44)],
        [], [], [],
        [("Um Filme", "Ana", 1966, 4), ("Dois", "Ana", 1979, 44), ("Ultimo", "Rui", 2000, 90)],
        [("Bom", "Rui e Eva", 1980, 7)],
        [("de Ana", "Rui Sá", 1999, 20), ("França, 1999 – 20 min", "Eva", 2000, 5)],
    ]


def test_entities_that_look_like_tags_stay(spark):
    from playbill.sources.fernando import bare_title, tidy

    raw = "<i>A &lt;MIL&gt; &amp; UM</i> <small>x</small> - última sessão"
    df = spark.createDataFrame([(raw,)], "raw string").select(bare_title(F.col("raw")).alias("bare"))
    assert df.select(tidy(H.unescape(F.col("bare")))).first()[0] == "A <Mil> & Um"
    assert spark.createDataFrame([(["a &amp; b", "", "c"],), ([],)], "t array<string>").select(H.unescape_all(F.col("t")).alias("t")).collect() == [(["a & b", "", "c"],), ([],)]


def test_local_time_does_not_depend_on_the_session(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            df = spark.createDataFrame([("2026-07-01T20:15:00Z",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
            assert df.select(F.date_format(lisbon_time(F.col("t"), civil=True), "yyyy-MM-dd HH:mm")).first()[0] == "2026-07-01 21:15"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@cache
def _snapshots(spark):
    empty = lambda ddl: spark.createDataFrame([], ddl)
    lbxd = spark.createDataFrame([("projeto-global-2025", 3.9, "lb.jpg", "Plot", ["Drama"], "Portugal", "Rui & Cia", "ivo", 2025), ("the-shining-1980", 4.3, None, None, None, None, "Someone Else", None, 1980)], model.LBXD)
    omdb = spark.createDataFrame([("The Shining", 1980, "True", "The Shining", "1980", "Stanley Kubrick", "om.jpg", "Horror, Drama, X, Y", "Cold", "UK, USA", "146 min")], model.OMDB)
    return refresh.Snapshots(lbxd, omdb, spark.createDataFrame([("Stanley Kubrick", "k.jpg", "b")], model.WIKI), empty(model.ALIAS), empty(model.ALIAS))


def test_refresh_publish_and_fall_back(spark, tmp_path):
    none = spark.createDataFrame([], model.MOVIE)
    movies, people, errors = refresh.refresh(landing(spark), none, _snapshots(spark), F.lit(ASOF))
    got = {r["id"]: r for r in movies.collect()}
    shining, global_ = got["cinemateca_11"], got["trindade_55"]
    assert (shining["poster"], shining["genres"], shining["plot"], shining["country"], shining["rating"]) == ("om.jpg", ["Horror", "Drama", "X"], "Cold", "UK", None)
    assert (global_["rating"], global_["poster"], global_["director_lbxd_slug"], global_["country"]) == (3.9, "lb.jpg", "ivo", "Portugal")
    # the two venues of one house list the same film
    assert "campo_alegre_o-filme" not in got and {s["cinema"] for s in got["nimas_o-filme"]["sessions"]} == {"nimas", "campo_alegre"}
    assert errors.count() == 0 and {r["name"]: r["photo"] for r in people.collect()}["Stanley Kubrick"] == "k.jpg"
    path = f"file://{tmp_path}/out"
    publish.publish(publish.document(movies, people, errors, "2026-03-20T00:00:00Z"), path)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    doc = json.loads(text.strip().removeprefix(publish.PREFIX).removesuffix(";"))
    assert len(doc["movies"]) == len(got) and doc["movies"][0]["id"] == "sao_jorge_1" and "rating" not in doc["movies"][0] and doc["movies"][0]["year"] is None
    assert doc["directors"]["Stanley Kubrick"]["bio"] == "b"
    back = publish.previous(spark, path)
    assert {r["id"]: r["sessions"] for r in back.collect()} == {k: v["sessions"] for k, v in got.items()}
    assert publish.previous(spark, f"file://{tmp_path}/nothing").count() == 0
    # an update that failed half way leaves the earlier document aside
    (tmp_path / "out").rename(tmp_path / "out.old")
    assert publish.previous(spark, path).count() == len(got)
    publish.publish(publish.document(movies, people, errors, "2026-03-20T00:00:00Z"), path)
    publish.publish(publish.document(movies, people, errors, "2026-03-21T00:00:00Z"), path)
    assert "2026-03-21" in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")) and {p.name for p in tmp_path.iterdir()} == {"out"}
    assert [json.loads(r["value"])["id"] for r in publish.source_dump(movies, 0).collect()] == ["sao_jorge_1"]
    # a venue that fails keeps what it had
    kept = refresh.merged(landing(spark, skip=("fernando",)), publish.previous(spark, path), F.lit(ASOF))
    assert "fernando_dogfight" in {r["id"] for r in kept.collect()}
    assert [tuple(r) for r in registry.errors(landing(spark, skip=("fernando", "ideal"))).collect()] == [("Fernando Lopes", "https://x: status 500")]
    counted = publish.metrics(movies, errors).first()
    assert counted["movies"] == len(got) and counted["sessions"] == sum(len(v["sessions"]) for v in got.values())
    assert refresh.whats_on(movies, F.lit(ASOF)).agg(F.sum("sessions")).first()[0] == counted["sessions"]


def test_catalogues(spark):
    from pages import DAY

    page = '<title>Film (2020) directed</title><meta name="twitter:data2" content="3.5 out"><script>"image": "https://a.ltrbxd.com/x-0-230-0-345-crop.jpg"</script><meta property="og:description" content="A &amp; B"><a href="/films/genre/science-fiction/">x</a><a href="/films/country/france/"> France </a><a href="/director/ana/"> Ana </a>'
    rows = [
        ("lbxd", "https://l/film/a-film/", DAY, 200, page),
        ("omdb", "https://o/?t=The+Film&y=2020", DAY, 200, '{"Response": "True", "Title": "The Film", "Year": "2020"}'),
        ("wiki", "https://w/api?titles=Ana+L", DAY, 200, '{"query": {"pages": {"12": {"extract": "One. Two. Three. Four.", "thumbnail": {"source": "t.jpg"}}}}}'),
        ("wikidata_search", "https://d/api?search=Rui", DAY, 200, '{"search": [{"id": "Q1", "label": "Other"}, {"id": "Q2", "label": "RUI"}]}'),
        ("wikidata_entity", "https://d/entity/Q2", DAY, 200, '{"claims": {"P18": [{"mainsnak": {"datavalue": {"value": "A b.jpg"}}}]}, "descriptions": {"en": {"value": "director"}}}'),
    ]
    df = spark.createDataFrame(rows, model.LANDING)
    assert tuple(catalogue.lbxd_pages(df).first()) == ("a-film", 3.5, "https://a.ltrbxd.com/x-0-500-0-750-crop.jpg", "A & B", ["Science Fiction"], "France", "Ana", "ana", 2020)
    assert tuple(catalogue.omdb_records(df).first())[:4] == ("The Film", 2020, "True", "The Film")
    from playbill.operators.enrich import wiki_entries

    got = {r["name"]: r for r in wiki_entries(catalogue.wiki_pages(df), catalogue.wikidata_search(df), catalogue.wikidata_entities(df)).collect()}
    assert (got["Ana L"]["photo"], got["Ana L"]["bio"]) == ("t.jpg", "One. Two. Three.") and got["Rui"]["bio"] == "director" and "A_b.jpg" in got["Rui"]["photo"]


@pytest.fixture
def site():
    """A server that counts requests, sets a cookie, fails twice, and answers posts."""
    import http.server
    import threading

    seen = []

    class Site(http.server.BaseHTTPRequestHandler):
        def answer(self, code, body, **headers):
            self.send_response(code)
            for k, v in headers.items():
                self.send_header(k.replace("_", "-"), v)
            self.end_headers()
            self.wfile.write(body.encode())

        def do_GET(self):  # noqa: N802
            seen.append((self.path, dict(self.headers)))
            if self.path == "/home":
                self.answer(200, "home", Set_Cookie="k=v")
            elif self.path == "/shaky" and sum(p == "/shaky" for p, _ in seen) < 3:
                self.answer(503, "later")
            elif self.path == "/empty":
                self.answer(200, "no films")
            else:
                self.answer(200, "page é")

        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.answer(200, json.dumps({"error": asked.get("fail"), "items": [asked]}))

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_fetching(spark, site):
    from playbill.sources.landing import LandingSource

    base, seen = site
    spark.dataSource.register(LandingSource)

    def fetch(*paths, **options):
        reader = spark.read.format("landing").option("source", "s").option("urls", "\n".join(base + p for p in paths)).option("pause", "0")
        return {r["url"].removeprefix(base): (r["status"], r["body"]) for r in reader.options(**options).load().collect()}

    assert fetch("/a", "/b", useragent="me") == {"/a": (200, "page é"), "/b": (200, "page é")}
    assert {h["User-Agent"] for _, h in seen} == {"me"}
    assert fetch("/list", prime=f"{base}/home", ajax="true") == {"/list": (200, "page é")}
    headers = next(h for p, h in seen if p == "/list")
    assert (headers["Cookie"], headers["Referer"], headers["X-Requested-With"]) == ("k=v", f"{base}/home", "XMLHttpRequest")
    assert fetch("/shaky") == {"/shaky": (503, None)} and fetch("/shaky", attempts="3") == {"/shaky": (200, "page é")}
    assert fetch("/empty", expect="<script", attempts="2") == {"/empty": (None, "nothing like <script")} and sum(p == "/empty" for p, _ in seen) == 2
    assert json.loads(fetch("/q", post='{"page": 0}', errorfield="error")["/q"][1])["items"] == [{"page": 0}]
    assert fetch("/q", post='{"fail": "bad"}', errorfield="error") == {"/q": (None, "error: bad")}
    assert fetch("/a", errorfield="error") == {"/a": (None, "error: no JSON")}


def test_cache_is_written_only_if_it_changed(spark, tmp_path):
    from playbill.sources import cache

    path, schema = f"file://{tmp_path}/cache", "title string, year int, slug string"
    rows = [("É um", 2000, "e-um"), ("Dois", None, None)]
    assert cache.load(spark, path, schema).count() == 0
    assert cache.save(spark.createDataFrame(rows, schema), path) and not cache.save(spark.createDataFrame(rows[::-1], schema), path)
    assert cache.save(spark.createDataFrame([*rows, rows[0]], schema), path)
    assert sorted(cache.load(spark, path, schema).collect(), key=repr) == sorted([*rows, rows[0]], key=repr)
    (tmp_path / "cache").rename(tmp_path / "cache.old")
    assert cache.load(spark, path, schema).count() == 3


def test_a_cluster_without_a_shared_folder_is_refused(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from playbill import scratch

    conf = {}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: conf.get(k, d), set=conf.__setitem__), sparkContext=SimpleNamespace(master="spark://m:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.folder(session)
    session.sparkContext.master = "local[2]"
    assert scratch.folder(session) == conf["spark.checkpoint.dir"]


def test_a_step_removes_what_it_wrote(spark):
    from pathlib import Path

    from playbill import scratch

    with scratch.step(spark) as keep:
        kept, path = scratch.stored(spark.range(3), "kept")
        _, other = scratch.stored(spark.range(4), "other")
        keep.append(path)
    assert kept.count() == 3 and Path(path.removeprefix("file://")).exists() and not Path(other.removeprefix("file://")).exists()
    scratch.remove(spark, path)
