"""Schemas of the listings engine, as DDL."""

SESSION = "STRUCT<date: STRING, time: STRING, cinema: STRING, labels: ARRAY<STRING>>"

#: A movie with its sessions. src_rank and src_ord carry the order in which sources and their items were listed: list order
#: decides which record leads a merge, so it is a column and never left to the order of rows.
MOVIE = (
    "id STRING, title STRING, director STRING, year INT, duration INT, festival STRING, poster STRING, genres ARRAY<STRING>, link STRING, "
    f"sessions ARRAY<{SESSION}>, rating DOUBLE, plot STRING, country STRING, director_lbxd_slug STRING, src_rank INT, src_ord INT"
)

#: Fetched pages; fetching itself is outside the engine.
LANDING = "source STRING, url STRING, fetched_at TIMESTAMP, status INT, body STRING"

LBXD = "slug STRING, rating DOUBLE, poster STRING, description STRING, genres ARRAY<STRING>, country STRING, lb_director STRING, lb_director_slug STRING, lb_year INT"
OMDB = "query_title STRING, query_year INT, Response STRING, Title STRING, Year STRING, Director STRING, Poster STRING, Genre STRING, Plot STRING, Country STRING, Runtime STRING"
WIKI = "name STRING, photo STRING, bio STRING"
ALIAS = "key STRING, value STRING, ordinal INT"
ERROR = "cinema STRING, error STRING"
