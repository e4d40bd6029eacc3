"""Small landed pages for every venue."""

import datetime
import json

DAY = datetime.datetime(2026, 3, 20, 8, 0)
ASOF = datetime.date(2026, 3, 20)


def script(data):
    return f"<html><script>var x;</script><script>global.data = {json.dumps(data)};</script></html>"


MEDEIA = "https://medeiafilmes.com"
PAGES = [
    # box office and directors
    ("ideal", "https://b/session/with-movies", json.dumps([
        {"sessionState": 0, "dateTime": "2026-04-03T14:30:00", "movie": {"id": 7, "title": "INDIE BARRIO TRISTE 138", "imageUrl": ""}},
        {"sessionState": 0, "dateTime": "2026-04-02T14:30:00", "movie": {"id": 7, "title": "INDIE BARRIO TRISTE 138", "imageUrl": "p.jpg"}},
        {"sessionState": 1, "dateTime": "2026-04-02T20:00:00", "movie": {"id": 8, "title": "Cancelled"}},
        {"dateTime": "2026-04-04T20:00:00", "movie": {"id": 9, "title": "Tom &amp; Ana"}},
    ])),
    ("ideal", "https://i/no-cinema/", '<div data-movie-date="x"><div class="nome_filme_em_cartaz"><p>Barrio Triste</p></div><div class="nome_realizador_em_cartaz"><p><b>Ana Sá</b></p></div></div>'),
    # hydration payload
    ("trindade", "https://t/programa", "<script>[1]</script><script>" + json.dumps([3, "x", "[1]", "{bad", json.dumps({
        "id": 55, "slug": "projeto-global", "title": "Projeto Global", "year": 2025, "runtime": 100, "poster": 9, "directors": [2, 3, 1],
        "sessions": [{"date": "2026-03-25", "time": {"start": "21:30"}, "notes": " debate "}, {"date": "2026-03-01", "time": {"start": "21:30"}}, {"date": "2026-03-22", "time": {"start": "18:00"}, "notes": None}],
    }), " " * 1000]) + "</script>"),
    ("trindade", "https://t/wp-json/director/1", json.dumps({"title": {"rendered": "Zé &amp; Cia"}})),
    ("trindade", "https://t/wp-json/director/2", json.dumps({"title": {"rendered": "Ivo Ferreira"}})),
    ("trindade", "https://t/wp-json/media/9", json.dumps({"media_details": {"sizes": {"medium": {"source_url": "m.jpg"}}}, "source_url": "full.jpg"})),
    # query API
    ("batalha", "https://api/x", json.dumps({
        "items": [
            {"datetime_date": "2026-04-01T20:15:00Z", "text_presencas": {"pt": "<b>Com X</b>"}, "ref_film": "F1"},
            {"datetime_date": "2026-04-01T20:15:00Z", "ref_film": "F1"},
            {"datetime_date": "2026-04-02T20:15:00Z", "multiRef_films": {"g2": 2, "F1": 1}},
            {"datetime_date": "2026-04-02T20:15:00Z"}, {"ref_film": "F1"},
        ],
        "related": {"F1": {"text_title": {"all": "Um &amp; Dois"}, "text_director1": "A", "text_director2": "B", "number_year_of_production": 1999, "number_minutes": 88}, "G2": {"_slug": "old-film"}},
    })),
    # list and film pages of a house
    ("medeia", f"{MEDEIA}/filmes-em-exibicao", script({"schedule": {"events": {
        "1": {"title": "O Filme", "director": "Eva &amp; Rui", "image": "i.jpg", "url": f"{MEDEIA}/filmes/o-filme", "theaters": {"cinema-medeia-nimas": {"a": 1}, "teatro-campo-alegre": {}}},
        "2": {"title": "Other", "url": f"{MEDEIA}/eventos/x", "theaters": {"cinema-medeia-nimas": {}}},
    }}})),
    ("medeia", f"{MEDEIA}/filmes/o-filme", script({"film": {"production_year": "2024/25", "length": "1h30", "genre": "Drama, , Crime", "programme": {
        "a": {"slug": "cinema-medeia-nimas", "sessions": {"s": {"date": "2026-03-21", "hours": ["21:30", "15:00"], "info": {"k": {"type": "text", "text": "<i>presença dos actores X, Y, Z</i>"}, "l": {"type": "icon", "text": "no"}}}}},
        "b": {"slug": "teatro-campo-alegre", "sessions": {"s": {"date": "2026-03-23", "hours": ["19:00"], "info": {}}}},
    }}})),
    # events and their pages
    ("sao_jorge", "https://s/wp-json/wp/v2/evento", json.dumps([
        {"id": 1, "link": "https://s/e1", "class_list": ["categoria-de-evento-filme", "genre-drama", "genre-ficcao-cientifica", "genre-new-wave"], "title": {"rendered": "Cão &#038; Gato | sessão de abertura"}, "_embedded": {"wp:featuredmedia": [{"source_url": "f.jpg"}]}},
        {"id": 2, "link": "https://s/e2", "class_list": ["categoria-de-evento-filme"], "title": {"rendered": "Cinema de Colo"}},
        {"id": 3, "link": "https://s/e3", "class_list": ["categoria-de-evento-concerto"], "title": {"rendered": "Concerto"}},
    ])),
    ("sao_jorge", "https://s/e1", "<script>x</script><span class='a'></span><span class=\"big tag x\">Festa do Cinema</span> 127' Realização João Canijo Com Rita Blanco. Conversa com Rita Silva, hoje "
     '<time datetime="2026-03-30">seg</time> <time datetime="20:00">20</time><time datetime="2026-03-30">seg</time> <time datetime="20:00">20</time><time datetime="2026-03-29">dom</time> <time datetime="19:00">19</time>'),
    # events with a page each, and festival days
    ("culturgest", "https://www.culturgest.pt/en/whats-on/schedule/events/?typology=5", '<a href="/en/whats-on/full-view/">x</a><a href="/en/whats-on/indie/?a=1">I</a><a href="/en/whats-on/velho/">v</a><a href="/en/whats-on/um-filme/#top">f</a>'
     '<a href="/en/whats-on/indie">again</a><a href="/en/whats-on/another/">z</a><a href="/en/about">no</a>'),
    ("culturgest", "https://www.culturgest.pt/en/whats-on/indie", 'IndieLisboa <div class="event-info-block date"><p>30 APR – 3 MAY 2026</p></div><header class="event-detail-header"><h1>Festival</h1></header>'),
    ("culturgest", "https://www.culturgest.pt/en/whats-on/another", '<div class="event-info-block date"><p>14 MAY 2026<br />THU 21:30</p></div><header class="event-detail-header"><h1>Another &lt;3&gt;</h1></header>'),
    ("culturgest", "https://www.culturgest.pt/en/whats-on/unlisted", '<div class="event-info-block date"><p>14 MAY 2026<br />THU 21:30</p></div><header class="event-detail-header"><h1>Unlisted</h1></header>'),
    ("culturgest", "https://www.culturgest.pt/en/whats-on/um-filme", '<div class="event-info-block date"><p>13 MAY 2026<br />WED 19:00</p></div><header class="event-detail-header"><h1>Ana Vaz</h1><p class="subtitle">Um Filme</p></header><div class="x highlight-banner y"><source srcset="/a.jpg"></div>'),
    ("culturgest", "https://www.culturgest.pt/en/whats-on/velho", '<div class="event-info-block date"><p>13 JAN 2026<br />WED 19:00</p></div><header class="event-detail-header"><h1>Velho</h1></header>'),
    ("culturgest", "https://indielisboa.com/en/festival/schedule/?caldt=2026-05-02", '<h2>X</h2><a href="https://indielisboa.com/en/screening/aa"><b>Blue Heron</b></a><h2>May 02 2026, Saturday, 15:00 (96\')</h2><h2>Culturgest, A</h2>'
     '<a href="https://indielisboa.com/en/screening/bb">Lisbon Talk</a><h2>May 02 2026, Saturday, 18:00</h2><h2>Culturgest</h2><a href="https://indielisboa.com/en/screening/cc">Else</a><h2>May 02 2026, Saturday, 19:00</h2><h2>São Jorge</h2>'),
    # a schedule in lines
    ("fernando", "https://cinemafernandolopes.pt/Programacao", '<h1>x</h1><h2>>Programação<</h2><h2><b>qua, 25 mar</b><br>21h00 - <a href="DOGFIGHT">DOGFIGHT <small>s</small></a> última sessão<br/>15h30 - <a href="CICLO">Parte Um</a><br>19h00 - O VELHO E A ESPADA - sessão especial</h2>'
     '<h2><b>qui, 26 mar</b><br>15h30 - <a href="CICLO">Parte Dois</a><br>21h00 newsletter <a href="N">Nada</a><br>25:21h00</h2>'),
    ("fernando", "https://cinemafernandolopes.pt/DOGFIGHT", '<h1>{css}</h1><h1>Dogfight</h1><small>"Duelo" / 1991 / M/12 / Drama / 94 MIN.</small><h2><small>REALIZAÇÃO</small></h2><h2>Nancy Savoca</h2>'
     '<img width="900" height="500" data-src="https://freight.cargo.site/w.jpg"><img width="500" height="700" data-src="https://freight.cargo.site/p.jpg">'),
    # daily pages and a joint programme
    ("cinemateca", "https://cinemateca.pt/Programacao.aspx?date=2026-03-25", '<a href="?id=11&date=x"><div class="infoDate">25/03/2026, 15h30 | Sala</div><div class="infoTitle a">THE SHINING</div><div><span class="colorPink">de </span>Stanley Kubrick</div><div>EUA, 1980 - 142 min </div>'
     '<div class="infoText">com a presença de Zé</div></a><a href="?id=12"><div>25/03/2026, 19h00</div><div class="infoTitle">FIRST SHORT | SECOND SHORT</div></a>'),
    ("cinemateca", "https://cinemateca.pt/Programacao.aspx?date=2026-03-26", '<a href="?id=11"><div>26/03/2026, 21h30</div><div class="infoTitle">THE SHINING</div></a>'),
    ("cinemateca", "https://cinemateca.pt/Programacao.aspx?id=12&date=2026-03-25", '<div class="infoText">nada</div><div class="infoText x">FIRST SHORT\n“Primeiro”\nSECOND SHORT\nde Ana Lima\nPortugal, 1966, 1979 – 4, 44 min\n\nDuração total: 48 min</div>'),
]


def landing(spark, skip=()):
    from playbill import model

    rows = [(s, u, DAY, 200, b) for s, u, b in PAGES if s not in skip]
    rows += [(s, "https://x", DAY, 500, None) for s in skip]
    return spark.createDataFrame(rows, model.LANDING)
