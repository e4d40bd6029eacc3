"""A list of events as JSON, and a page for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.text import capital_first, capitals, special_suffix
from .base import as_movies, gather, numbered, pages, session

CINEMA = "sao_jorge"
EVENTS = "ARRAY<STRUCT<id: STRING, link: STRING, class_list: ARRAY<STRING>, title: STRUCT<rendered: STRING>, _embedded: STRUCT<`wp:featuredmedia`: ARRAY<STRUCT<source_url: STRING>>>>>"
#: Classes of events that are films, and the names of genres.
NO_FILM = r"(?iu)cinema\s+de\s+colo"
FILM_CLASS = "categoria-de-evento-(filme|sessao-de-festival|afim-de-filmes)"
GENRES = {
    "drama": "Drama", "comedia": "Comédia", "thriller": "Thriller", "terror": "Terror", "documentario": "Documentário", "animacao": "Animação",
    "romance": "Romance", "accao": "Acção", "ficcao-cientifica": "Ficção Científica",
}
# Name words, and what ends a director's name
_WORD = r"(?:[A-ZÀ-Ú][a-zà-ú]+|da|de|do|dos|das)"
_DIRECTOR = rf"(?:Realiza(?:ção|dor)|Dire(?:ção|tor))\s+({_WORD}(?:\s+{_WORD})*)(?=\s+(?:Com|Ano|País|Duração|Realiz|M/\d|Sala|Ficha|Morada|\d{{4}}\b))"
_ENDS = r"\s+(?:Com|Ano|País|Duração|Ficha|Sala|Realizaç)\b.*$"
# How guests are announced, best first
_GUESTS = (
    r"(?iuU)com\s+a\s+presen[çc]a\s+d[eo]\s+([\w\s.\-]+?)(?:[,.\n]|$)",
    r"(?iuU)(conversa|debate|q&a)\s+com\s+([\w\s.\-]+?)(?:[,.\n]|$)",
    r"(?iuU)presen[çc]a\s+d[oa]\s+realizador[a]?(?:\s+e\s+[\w\s]+)?",
    r"(?iuU)seguida\s+de\s+(debate|conversa)",
)
# A page's tag, its length in minutes, and its pairs of day and hour
TAG = r'<span[^>]+class="[^"]*\btag\b[^"]*"[^>]*>([^<]{4,80})</span>'
MINUTES = r"\b(\d{2,3})['′’]"
SHOWING = r'<time datetime="(\d{4}-\d{2}-\d{2})"[^>]*>.*?<time datetime="(\d{2}:\d{2})"'


def metadata(text: Column, page: Column) -> dict[str, Column]:
    """length, director, festival and guest from a page and its visible text."""
    raw = F.btrim(F.regexp_replace(F.regexp_extract(text, _DIRECTOR, 1), _ENDS, ""))
    tag = F.btrim(H.unescape(F.regexp_extract(page, TAG, 1)))
    guest = F.coalesce(*[F.nullif(F.regexp_extract(text, g, 0), F.lit("")) for g in _GUESTS])
    return {
        "duration": F.regexp_extract(text, MINUTES, 1).try_cast("int"),
        "director": F.nullif(raw, F.lit("")),
        "festival": F.when((tag != "") & ~tag.rlike(r"^M/\d+$"), tag),
        "guest": capital_first(F.btrim(guest)),
    }


def genres(classes: Column) -> Column:
    """F32: genres from classes, unknown ones in title case, each once."""
    names = F.transform(F.filter(classes, lambda c: c.startswith("genre-")), lambda c: F.substr(c, F.lit(7)))
    known = F.create_map(*[F.lit(x) for kv in GENRES.items() for x in kv])
    return F.array_distinct(F.transform(names, lambda g: F.coalesce(known[g], capitals(F.replace(g, F.lit("-"), F.lit(" "))))))


def film_events(landing: DataFrame) -> DataFrame:
    """(ord, e, plain) of the listed events that are films."""
    events = pages(landing, CINEMA, "wp-json").select(F.posexplode(F.from_json("body", EVENTS)).alias("ord", "e"))
    events = events.where(F.exists("e.class_list", lambda c: c.rlike(FILM_CLASS))).withColumn("plain", H.unescape(F.col("e.title.rendered")))
    return events.where(~F.col("plain").rlike(NO_FILM))


def parse(landing: DataFrame, asof: Column, rank: int) -> DataFrame:
    """Events that are films, with the date and time pairs of their pages."""
    events = film_events(landing).withColumn("t", special_suffix(F.col("e.title.rendered")))
    details = pages(landing, CINEMA).select("url", F.col("body").alias("page"), H.unescape(H.visible_text(F.col("body"))).alias("text"))
    joined = events.join(details, events["e.link"] == details["url"])
    joined = joined.withColumns(metadata(F.col("text"), F.col("page"))).withColumn("labels", F.array_compact(F.array("t.label", "guest")))
    pairs = F.arrays_zip(H.all_of(F.col("page"), SHOWING, 1).alias("d"), H.all_of(F.col("page"), SHOWING, 2).alias("h"))
    rows = joined.select("*", F.posexplode(pairs).alias("pos", "x")).withColumn("session", session(F.col("x.d"), F.col("x.h"), CINEMA, F.col("labels")))
    rows = rows.select(F.struct("ord", "pos").alias("ord"), F.col("e.id").alias("event"), F.col("t.title").alias("title"), "director", "duration", "festival", F.try_element_at(F.col("e._embedded.wp:featuredmedia"), F.lit(1))["source_url"].alias("poster"),
                       genres(F.col("e.class_list")).alias("genres"), F.col("e.link").alias("link"), "session")
    movies = gather(rows, ["event"], ["title", "director", "duration", "festival", "poster", "genres", "link"])
    return as_movies(numbered(movies, "src_ord").withColumns({"title": H.unescape(F.col("title")), "id": F.concat(F.lit("sao_jorge_"), "event")}), rank)
