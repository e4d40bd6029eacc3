"""A schedule written as lines under dates, and a page for each film."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.temporal import pt_date, pt_time
from ..functions.text import capitals, id_slug, keyword_labels, slug_title, venue_slug
from ..functions.truthy import first_truthy, truthy
from ..operators.merge import union_sessions
from ..operators.ordered import carry_forward, first_seen, series_keys
from .base import as_movies, gather, pages, session

CINEMA = "fernando"
BASE = "https://cinemafernandolopes.pt"
_DASH = r"[-–]"
# Page patterns, and notes that follow a title
_TIME = r"(?<![:/\d])(\d{1,2}h\d{2})(?!\d)"
_DAY_HEADING = r"(?U)<b>\s*(\w+,\s*\d{1,2}\s+\w+)\s*</b>"
_NO_SESSION = "(?i)(?:screenings|newsletter|subscriv)"
_SPECIAL = rf"(?iu)\s*{_DASH}\s*sess[aã]o\s+especial.*$"
LINK = r"<a\s[^>]*href=[\"']([^\"'#?][^\"']*)[\"'][^>]*>(.*?)</a>"
_BOLD_NOTE = r"(?siu)<b>.*?(?:mostra|última\s+sessão|essencial|with\s+english).*?</b>"
_SMALL = r"(?s)<small>.*?</small>"
_NOTE = r"(?:mostra\s+essencial|última\s+sessão|with\s+english\s+subtitles)"
# A film's page: its heading, its facts, which of them are years, lengths and no genres, its director and pictures
_PAGE_HEADING = r"<h1[^>]*>(.*?)</h1>"
_FACTS = r"(?i)<small>([^<]{8,}MIN[^<]*)</small>"
_YEAR, _LENGTH, _NO_GENRE = r"^(19|20)\d{2}$", r"(?i)^\d{2,3}\s*MIN\.?$", r'^M/\d+$|^["“”]|^\d'
_DIRECTOR = r"(?iu)<h2>\s*<small>\s*REALIZA[ÇC][ÃA]O\s*</small>\s*</h2>\s*<h2>(.*?)</h2>"
_IMAGE, _IMAGE_SOURCE = r"<img\s([^>]+)>", r'data-src="(https://freight\.cargo\.site[^"]+)"'


def bare_title(raw: Column) -> Column:
    """F11, first half: a link's markup without notes and small print; entities are still there, as they may look like tags."""
    return F.regexp_replace(H.strip_tags(F.regexp_replace(F.regexp_replace(raw, _BOLD_NOTE, ""), _SMALL, "")), rf"(?iu)\s*{_DASH}?\s*{_NOTE}.*$", "")


def tidy(text: Column) -> Column:
    """F11, second half: single blanks, no dash at either end, and title case for capitals."""
    text = F.btrim(F.regexp_replace(F.regexp_replace(text, rf"^\s*{_DASH}\s*|\s*{_DASH}\s*$", ""), r"\s+", " "))
    return F.when((F.upper(text) == text) & (F.length(text) > 1), capitals(F.lower(text))).otherwise(text)


def schedule(landing: DataFrame, asof: Column) -> DataFrame:
    """(pos, title, slug, date, time, labels) of every session."""
    body = pages(landing, CINEMA, "Programacao").select("body")
    start = F.instr("body", ">Programação<")
    body = body.select(F.when(start > 0, F.substr("body", start)).otherwise(F.col("body")).alias("body"))
    lines = body.select(F.posexplode(F.split(F.regexp_replace("body", r"(?i)<br\s*/?>|</h2>", "\n"), "\n")).alias("pos", "raw")).withColumn("line", F.btrim("raw")).where("line <> ''")
    heading = F.regexp_extract("line", _DAY_HEADING, 1)
    # one page's lines: a window over them is as long as the page
    dated = carry_forward(lines.withColumn("page", F.lit(1)), pt_date(heading, asof), ["page"], ["pos"], "date")
    clock = F.regexp_extract("line", _TIME, 1)
    rows = dated.where("date is not null").withColumn("time", pt_time(F.nullif(clock, F.lit("")))).where("time is not null")
    rows = rows.where(~F.col("line").rlike(_NO_SESSION))
    rows = rows.withColumn("rest", F.substr("line", F.instr("line", clock)))
    slugs = F.filter(F.transform(H.all_of(F.col("rest"), LINK, 1), lambda s: F.btrim(s)), lambda s: s != "")
    rows = rows.withColumn("linked", H.unescape_all(F.transform(H.all_of(F.col("rest"), LINK, 2), lambda t: bare_title(t))))
    titles = F.filter(F.transform("linked", lambda t: tidy(t)), lambda t: F.length(t) > 2)
    plain = F.regexp_replace(F.regexp_replace(H.unescape(H.strip_tags(F.col("rest"))), rf"^\s*\d{{1,2}}h\d{{2}}\s*{_DASH}?\s*", ""), _SPECIAL, "")
    rows = rows.withColumn("title", first_truthy(F.try_element_at(titles, F.lit(1)), tidy(plain))).where(F.length("title") >= 2)
    rows = rows.withColumn("slug", F.coalesce(F.try_element_at(slugs, F.lit(1)), venue_slug(F.col("title"))))
    rows = rows.select("pos", "title", "slug", "date", "time", keyword_labels(F.col("line")).alias("labels"))
    return first_seen(rows, ["date", "time", "slug"], ["pos"])


def film_pages(landing: DataFrame) -> DataFrame:
    """(slug, page_title, director, year, duration, genres, poster)."""
    page = F.col("body")
    heads = F.filter(F.transform(H.unescape_all(F.transform(H.all_of(page, _PAGE_HEADING), lambda h: H.strip_tags(h))), lambda h: F.btrim(h)), lambda h: (F.length(h) > 2) & ~h.rlike("[{}]"))
    parts = F.transform(F.split(H.unescape(H.inner(page, _FACTS)), " / "), lambda p: F.btrim(p))
    genre = lambda p: ~p.rlike(_YEAR) & ~p.rlike(_LENGTH) & ~p.rlike(_NO_GENRE) & (F.length(p) > 1)
    images = F.transform(
        H.all_of(page, _IMAGE),
        lambda a: F.struct(F.regexp_extract(a, r'width="(\d+)"', 1).try_cast("int").alias("w"), F.regexp_extract(a, r'height="(\d+)"', 1).try_cast("int").alias("h"), F.regexp_extract(a, _IMAGE_SOURCE, 1).alias("src")),
    )
    films = pages(landing, CINEMA).where("url not like '%Programacao'").select(F.regexp_replace("url", f"^{BASE}/", "").alias("slug"), "body")
    return films.select(
        "slug", F.try_element_at(heads, F.lit(1)).alias("page_title"),
        F.nullif(F.btrim(H.unescape(H.strip_tags(H.inner(page, _DIRECTOR)))), F.lit("")).alias("director"),
        F.try_element_at(F.filter(parts, lambda p: p.rlike(_YEAR)), F.lit(-1)).try_cast("int").alias("year"),
        F.regexp_extract(F.try_element_at(F.filter(parts, lambda p: p.rlike(_LENGTH)), F.lit(-1)), r"\d+", 0).try_cast("int").alias("duration"),
        F.filter(parts, genre).alias("genres"), F.try_element_at(F.filter(images, lambda i: (i["w"] < i["h"]) & (i["src"] != "")), F.lit(1))["src"].alias("poster"),
    )


def parse(landing: DataFrame, asof: Column, rank: int) -> DataFrame:
    """Films by slug, and by title too where one slug has several."""
    rows = series_keys(schedule(landing, asof), "slug", "title")
    rows = rows.select("slug", "group_title", "title", F.col("pos").alias("ord"), session(F.col("date"), F.col("time"), CINEMA, F.col("labels")).alias("session"))
    movies = gather(rows, ["slug", "group_title"], ["title"], dedupe=False).join(film_pages(landing), "slug", "left")
    series = F.col("group_title") != ""
    usable = truthy("page_title") & (F.length("page_title") <= 200)
    movies = movies.withColumns(
        {
            "title": F.when(~series & usable, F.col("page_title")).otherwise(F.col("title")),
            "poster": F.when(~series, F.col("poster")),
            "festival": F.when(series, slug_title(F.lower("slug"))),
            "link": F.concat(F.lit(f"{BASE}/"), "slug"),
        }
    )
    movies = movies.withColumn("id", F.concat(F.lit("fernando_"), F.regexp_replace(id_slug(F.concat_ws("_", "slug", F.nullif("group_title", F.lit(""))), collapse=True), "^_+|_+$", "")))
    # equal director and poster, both known: one film under its shortest title, with the sessions of all
    key = F.when(truthy("director") & truthy("poster"), F.concat_ws("\u0001", "director", "poster")).otherwise(F.col("id"))
    movies = movies.withColumn("film", key)
    fields = ["id", "director", "year", "duration", "poster", "genres", "link", "festival"]
    heads = movies.groupBy("film").agg(F.min_by("title", F.struct(F.length("title"), "src_ord")).alias("title"), *[F.min_by(c, "src_ord").alias(c) for c in fields], F.min("src_ord").alias("first"))
    sessions = union_sessions(movies.select("film", "src_ord", F.posexplode("sessions").alias("pos", "session")), ["film"], ["src_ord", "pos"])
    return as_movies(heads.join(sessions, "film").withColumnRenamed("first", "src_ord"), rank)
