"""Snapshots of external catalogues from landed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.text import capitals, last_segment
from .base import pages


def lbxd_pages(landing: DataFrame) -> DataFrame:
    """One row per film page, as model.LBXD says."""
    page = F.col("body")
    one = lambda pattern, group=1: F.nullif(F.btrim(F.regexp_extract(page, pattern, group)), F.lit(""))
    person = r'href="/director/([^/]+)/"[^>]*>\s*([^<]+?)\s*</a>'
    genres = F.transform(F.array_distinct(F.regexp_extract_all(page, F.lit(r'href="/films/genre/([^/"]+)/"'), F.lit(1))), lambda g: capitals(F.replace(g, F.lit("-"), F.lit(" "))))
    return pages(landing, "lbxd").select(
        last_segment(F.col("url")).alias("slug"),
        one(r'twitter:data2" content="([\d.]+)').try_cast("double").alias("rating"),
        F.regexp_replace(one(r'"image"\s*:\s*"(https://a\.ltrbxd\.com[^"]+)"'), r"-0-\d+-0-\d+-crop", "-0-500-0-750-crop").alias("poster"),
        F.btrim(H.unescape(one(r'<meta property="og:description" content="([^"]+)"'))).alias("description"),
        F.when(F.size(genres) > 0, genres).alias("genres"),
        one(r'href="/films/country/[^/"]+/"[^>]*>\s*([^<]+?)\s*<').alias("country"),
        one(person, 2).alias("lb_director"), one(person, 1).alias("lb_director_slug"),
        one(r"<title>[^(]*\((\d{4})\)").try_cast("int").alias("lb_year"),
    )


def omdb_records(landing: DataFrame) -> DataFrame:
    """One row per query, as model.OMDB says; the query is in the address."""
    fields = ["Response", "Title", "Year", "Director", "Poster", "Genre", "Plot", "Country", "Runtime"]
    record = F.from_json("body", ", ".join(f"{f} STRING" for f in fields))
    asked = lambda name: F.nullif(F.parse_url("url", F.lit("QUERY"), F.lit(name)), F.lit(""))
    rows = pages(landing, "omdb").select(F.url_decode(asked("t")).alias("query_title"), asked("y").try_cast("int").alias("query_year"), record.alias("r"))
    return rows.select("query_title", "query_year", *[F.col(f"r.{f}").alias(f) for f in fields])


def wiki_pages(landing: DataFrame) -> DataFrame:
    """(name, photo, extract) of encyclopedia pages; the name asked for is in the address."""
    page = "ARRAY<STRUCT<extract: STRING, thumbnail: STRUCT<source: STRING>>>"
    first = F.try_element_at(F.map_values(F.from_json(F.get_json_object("body", "$.query.pages"), f"MAP<STRING, {page[6:-1]}>")), F.lit(1))
    name = F.url_decode(F.parse_url("url", F.lit("QUERY"), F.lit("titles")))
    return pages(landing, "wiki").select(name.alias("name"), first["thumbnail"]["source"].alias("photo"), first["extract"].alias("extract"))


def wikidata_search(landing: DataFrame) -> DataFrame:
    """(name, pos, id, label) of search hits."""
    hits = F.from_json(F.get_json_object("body", "$.search"), "ARRAY<STRUCT<id: STRING, label: STRING>>")
    name = F.url_decode(F.parse_url("url", F.lit("QUERY"), F.lit("search")))
    return pages(landing, "wikidata_search").select(name.alias("name"), F.posexplode(hits).alias("pos", "h")).select("name", "pos", "h.id", "h.label")


def wikidata_entities(landing: DataFrame, width: int = 300) -> DataFrame:
    """(id, photo, description): the image claim becomes an address of the commons."""
    item = last_segment(F.col("url"))
    image: Column = F.get_json_object("body", "$.claims.P18[0].mainsnak.datavalue.value")
    photo = F.when(image.isNotNull(), F.concat(F.lit("https://commons.wikimedia.org/wiki/Special:FilePath/"), F.url_encode(F.replace(image, F.lit(" "), F.lit("_"))), F.lit(f"?width={width}")))
    return pages(landing, "wikidata_entity").select(item.alias("id"), photo.alias("photo"), F.get_json_object("body", "$.descriptions.en.value").alias("description"))
