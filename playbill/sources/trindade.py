"""Films in a page's hydration payload; directors and posters from keyed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.text import last_segment
from ..functions.truthy import first_truthy, truthy
from ..operators.ordered import joined_list
from .base import as_movies, gather, numbered, pages, session

CINEMA = "trindade"
BASE = "https://cinematrindade.pt"
FILM = "id STRING, slug STRING, title STRING, year INT, runtime INT, poster STRING, directors ARRAY<STRING>, sessions ARRAY<STRUCT<date: STRING, time: STRUCT<start: STRING>, notes: STRING>>"


def films(landing: DataFrame) -> DataFrame:
    """Film records of the first script that has any; a record is a JSON text within a JSON array."""
    scripts = pages(landing, CINEMA, "programa").select(F.posexplode(H.all_of(F.col("body"), r"<script[^>]*>(.*?)</script>")).alias("script", "js"))
    scripts = scripts.where((F.length("js") >= 1000) & F.col("js").startswith("["))
    items = scripts.select("script", F.posexplode(F.from_json("js", "ARRAY<STRING>")).alias("ord", "item"))
    there = F.get_json_object("item", "$.sessions").isNotNull() & F.get_json_object("item", "$.slug").isNotNull()
    found = items.where(F.col("item").startswith("{") & there)
    first = found.agg(F.min("script").alias("script"))
    return found.join(first, "script").select("ord", F.from_json("item", FILM).alias("f")).select("ord", "f.*")


def parse(landing: DataFrame, asof: Column, rank: int) -> DataFrame:
    film = films(landing).withColumn("film", F.coalesce("id", "slug")).withColumn("title", F.btrim(H.unescape(F.col("title"))))
    rows = film.where(truthy("title")).select("*", F.posexplode("sessions").alias("pos", "s"))
    rows = rows.where(truthy("s.date") & truthy("s.time.start") & (F.col("s.date") >= F.date_format(asof, "yyyy-MM-dd")))
    note = F.btrim(F.coalesce("s.notes", F.lit("")))
    labels = F.filter(F.array(note), lambda n: n != "")
    rows = rows.withColumn("session", session(F.col("s.date"), F.col("s.time.start"), CINEMA, labels)).withColumn("ord", F.struct("ord", "pos"))
    movies = gather(rows, ["film"], ["title", "year", "runtime", "slug", "poster", "directors"], dedupe=False)
    people = pages(landing, CINEMA, "/director").select(last_segment(F.col("url")).alias("did"), F.get_json_object("body", "$.title.rendered").alias("raw")).withColumn("name", F.btrim(H.unescape(F.col("raw"))))
    names = joined_list(movies.where(F.size("directors") > 0), "directors", people, "did", "name", ["film"])
    size = lambda s: F.get_json_object("body", f"$.media_details.sizes.{s}.source_url")
    media = pages(landing, CINEMA, "/media").select(last_segment(F.col("url")).alias("mid"), first_truthy(size("medium_large"), size("medium"), F.get_json_object("body", "$.source_url")).alias("image"))
    movies = numbered(movies, "src_ord").join(names, "film", "left").join(media, movies["poster"] == media["mid"], "left")
    return as_movies(
        movies.withColumns({"id": F.concat(F.lit("trindade_"), "film"), "director": F.col("names"), "poster": F.col("image"), "duration": F.col("runtime"), "link": F.concat(F.lit(f"{BASE}/pt/filmes/"), "slug")}), rank
    )
