"""Two venues of one house: a list page and film pages, each with JSON in a script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.temporal import leading_int, minutes
from ..functions.text import capital_first, comma_parts, last_segment, presence_label
from ..functions.truthy import truthy
from .base import as_movies, gather, numbered, pages, session

LIST = "schedule STRUCT<events: MAP<STRING, STRUCT<title: STRING, director: STRING, image: STRING, url: STRING, theaters: MAP<STRING, STRING>>>>"
INFO = "MAP<STRING, STRUCT<type: STRING, text: STRING>>"
FILM = f"film STRUCT<production_year: STRING, length: STRING, genre: STRING, programme: MAP<STRING, STRUCT<slug: STRING, sessions: MAP<STRING, STRUCT<date: STRING, hours: ARRAY<STRING>, info: {INFO}>>>>>"


def parse(landing: DataFrame, asof: Column, rank: int, cinema: str, slug: str) -> DataFrame:
    """Events shown at the venue, with the sessions that their film page has for it."""
    house = pages(landing, "medeia")
    listed = house.where("url like '%filmes-em-exibicao%'").select(F.posexplode(F.map_values(F.from_json(H.script_json(F.col("body")), LIST)["schedule"]["events"])).alias("ord", "e"))
    listed = listed.where(F.map_contains_key("e.theaters", F.lit(slug)) & F.col("e.url").contains("/filmes/") & truthy("e.title"))
    films = house.select("url", F.from_json(H.script_json(F.col("body")), FILM)["film"].alias("film")).where("film is not null")
    joined = listed.join(films, listed["e.url"] == films["url"])
    programme = F.filter(F.map_values("film.programme"), lambda p: p["slug"] == slug)
    shown = joined.select("*", F.explode(F.flatten(F.transform(programme, lambda p: F.map_values(p["sessions"])))).alias("s"))
    notes = F.transform(F.filter(F.map_values("s.info"), lambda i: i["type"] == "text"), lambda i: F.btrim(H.strip_tags(i["text"])))
    shown = shown.withColumn("notes", H.unescape_all(F.coalesce(notes, F.array().cast("array<string>"))))
    labels = F.transform(F.filter("notes", lambda n: n != ""), lambda n: capital_first(presence_label(n)))
    rows = shown.select("ord", "e", "film", "url", "s", labels.alias("labels"), F.posexplode("s.hours").alias("pos", "hour"))
    rows = rows.select(F.col("ord").alias("place"), "url", H.unescape(F.btrim("e.title")).alias("title"), F.nullif(H.unescape(F.btrim("e.director")), F.lit("")).alias("director"), F.nullif("e.image", F.lit("")).alias("poster"),
                       leading_int(F.col("film.production_year"), 4).alias("year"), minutes(F.col("film.length")).alias("duration"), comma_parts(F.col("film.genre")).alias("genres"),
                       F.struct("ord", "pos").alias("ord"), session(F.col("s.date"), F.col("hour"), cinema, F.col("labels")).alias("session"))
    movies = gather(rows, ["url"], ["title", "director", "poster", "year", "duration", "genres"], dedupe=False)
    return as_movies(numbered(movies, "src_ord").withColumns({"id": F.concat(F.lit(f"{cinema}_"), last_segment(F.col("url"))), "link": F.col("url")}), rank)
