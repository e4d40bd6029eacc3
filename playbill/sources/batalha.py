"""A query API's items and the records that they refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.temporal import lisbon_time
from ..functions.text import capitals, joined_names
from ..functions.truthy import first_truthy, truthy
from ..operators.ordered import map_order
from .base import as_movies, gather, numbered, pages, session

CINEMA = "batalha"
BASE = "https://www.batalhacentrodecinema.pt"
FILM = "text_display_title: STRING, text_title: STRING, _slug: STRING, text_director1: STRING, text_director2: STRING, number_year_of_production: DOUBLE, number_minutes: DOUBLE, image_photo: STRING"
BODY = f"items ARRAY<STRUCT<datetime_date: STRING, text_presencas: STRING, ref_film: STRING, multiRef_films: STRING>>, related MAP<STRING, STRUCT<{FILM}>>"


def parse(landing: DataFrame, asof: Column, rank: int, civil_time: bool = False) -> DataFrame:
    body = pages(landing, CINEMA).select(F.from_json("body", BODY).alias("b"))
    items = body.select(F.posexplode("b.items").alias("ord", "i")).where(truthy("i.datetime_date"))
    refs = F.col("i.multiRef_films")
    # One reference, or several as a list or as a map by value
    several = F.when(refs.startswith("["), F.from_json(refs, "ARRAY<STRING>")).otherwise(map_order(F.from_json(refs, "MAP<STRING, INT>")))
    ids = F.when(truthy("i.ref_film"), F.array("i.ref_film")).otherwise(several)
    local = lisbon_time(F.col("i.datetime_date").try_cast("timestamp"), civil_time)
    label = H.unescape(H.localised(F.col("i.text_presencas")))
    rows = items.withColumn("label", label).withColumn("session", session(F.date_format(local, "yyyy-MM-dd"), F.date_format(local, "HH:mm"), CINEMA, F.filter(F.array("label"), lambda x: F.coalesce(x != "", F.lit(False)))))
    rows = rows.select(F.col("ord").alias("item"), "session", F.posexplode(ids).alias("pos", "film")).withColumn("ord", F.struct("item", "pos"))
    movies = gather(rows, ["film"], [])
    # By id, then by id in lower case
    related = body.select(F.explode("b.related").alias("rid", "r"))
    exact = related.select(F.col("rid").alias("film"), F.col("r").alias("r1"))
    low = related.groupBy(F.lower("rid").alias("low")).agg(F.max_by("r", "rid").alias("r2"))
    movies = movies.join(exact, "film", "left").join(low, F.lower("film") == F.col("low"), "left").withColumn("r", F.coalesce("r1", "r2"))
    text = lambda c: H.unescape(H.localised(F.col(f"r.{c}")))
    movies = movies.withColumns({k: text(c) for k, c in {"shown": "text_display_title", "plain": "text_title", "slug": "_slug", "d1": "text_director1", "d2": "text_director2", "poster": "image_photo"}.items()})
    fallback = capitals(F.lower(F.replace(first_truthy("slug", "film"), F.lit("-"), F.lit(" "))))
    return as_movies(
        numbered(movies, "src_ord").withColumns(
            {
                "id": F.concat(F.lit("batalha_"), "film"), "title": first_truthy(F.col("shown"), F.col("plain"), fallback), "director": joined_names(F.col("d1"), F.col("d2")),
                "year": F.col("r.number_year_of_production").cast("int"), "duration": F.col("r.number_minutes").cast("int"),
                "link": F.concat(F.lit(f"{BASE}/filmes/"), first_truthy(F.col("slug"), F.replace("film", F.lit("_"), F.lit("-")))),
            }
        ),
        rank,
    )
