"""Box-office JSON of sessions, and the site's page of directors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.temporal import iso_parts
from ..functions.text import id_slug, indie_title
from ..functions.truthy import first_truthy
from .base import as_movies, gather, pages, session

CINEMA = "ideal"
SESSIONS = "ARRAY<STRUCT<sessionState: INT, dateTime: STRING, movie: STRUCT<id: STRING, title: STRING, imageUrl: STRING>>>"
#: Billing titles without the festival's prefix.
OVERRIDES = {"NÃO DESVIAR O OLHAR 429": "Não Desviar o Olhar"}


def directors(landing: DataFrame) -> DataFrame:
    """(key, director) by upper-case title; the last of equal titles."""
    blocks = pages(landing, CINEMA, "no-cinema").select(F.posexplode(F.split("body", r'data-movie-date="[^"]*"[^>]*>')).alias("pos", "b"))
    field = lambda name: F.btrim(H.unescape(H.strip_tags(H.inner(F.col("b"), rf"{name}[^>]*>.*?<p>(.*?)</p>"))))
    found = blocks.select("pos", F.upper(field("nome_filme_em_cartaz")).alias("key"), field("nome_realizador_em_cartaz").alias("director"))
    return found.where("key <> '' and director <> ''").groupBy("key").agg(F.max_by("director", "pos").alias("director"))


def parse(landing: DataFrame, asof: Column, rank: int) -> DataFrame:
    rows = pages(landing, CINEMA, "session/with-movies").select(F.posexplode(F.from_json("body", SESSIONS)).alias("ord", "s"))
    rows = rows.where(F.coalesce("s.sessionState", F.lit(0)) == 0)
    at = iso_parts(F.col("s.dateTime"))
    rows = rows.select(
        "ord", F.btrim(H.unescape(F.col("s.movie.title"))).alias("raw"), F.col("s.movie.imageUrl").alias("poster"),
        F.concat(F.lit("https://bilheteira.cinemaidealemcasa.pt/?movieid="), "s.movie.id").alias("link"), session(at["date"], at["time"], CINEMA).alias("session"),
    )
    movies = gather(rows, ["raw"], ["poster", "link"], dedupe=False, fill=("poster",)).withColumn("t", indie_title(F.col("raw"), OVERRIDES))
    movies = movies.withColumn("title", F.col("t.title")).withColumn("festival", F.when(F.col("t.is_indie"), "INDIE Lisboa"))
    # By the clean title, by the raw one in capitals, by the raw one
    asked = movies.select("raw", F.posexplode(F.array(F.upper("title"), F.upper("raw"), F.col("raw"))).alias("pos", "key"))
    named = asked.join(directors(landing), "key").groupBy("raw").agg(F.min_by("director", "pos").alias("director"))
    movies = movies.join(named, "raw", "left").withColumn("director", first_truthy("director"))
    return as_movies(movies.withColumn("id", F.concat(F.lit("ideal_"), id_slug(F.col("title")))), rank)
