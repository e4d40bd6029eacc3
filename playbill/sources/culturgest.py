"""Single events with a page each, in the order of a listing, and a festival's days at the venue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.temporal import day_range, en_date_time, heading_time
from ..functions.text import absolute_url, id_slug, last_segment, path_only
from ..functions.truthy import first_truthy, truthy
from ..operators.ordered import first_seen
from .base import as_movies, gather, numbered, pages, session

CINEMA = "culturgest"
BASE = "https://www.culturgest.pt"
#: Where the events are listed, their links, and the pages of the menu among them.
LISTING = "/en/whats-on/schedule/events/"
EVENT_LINK = r'<a href="(/en/whats-on/[^"]+)"'
MENU = ("full-view", "by-event", "filter", "archive", "pdf-agenda")
DATE_BLOCK = r'class="event-info-block date"[^>]*>(.*?)</div>'
# Parts of an event's page, and of a day's page of the festival
HEADER = r'class="event-detail-header">(.*?)</header>'
BANNER = r'class="[^"]*highlight-banner[^"]*"[^>]*>(.*?)</div>'
HEADING, SUBTITLE = r"<h1[^>]*>(.*?)</h1>", r'class="subtitle"[^>]*>(.*?)</'
POSTER = r'<source\s+srcset="([^"]+)"'
TOKEN = r'(<h2[^>]*>.*?</h2>|<a href="https://indielisboa\.com/en/screening/[^"]+"[^>]*>.*?</a>)'
LISTED_DAY = r"caldt=(\d{4}-\d{2}-\d{2})"
#: Talks and workshops are no films.
SKIP = r"(?iu)(?:lisbon\s*talk|indietalk|talk\s*#\d|workshop|debate|conversa|lecture)"


def _clean(part: Column) -> Column:
    return F.btrim(H.unescape(H.strip_tags(part, " ")))


def listed(landing: DataFrame) -> DataFrame:
    """(place, path) of the events that the listing links to: no pages of the menu, the first of equal paths."""
    links = pages(landing, CINEMA, LISTING).select(F.posexplode(H.all_of(F.col("body"), EVENT_LINK)).alias("place", "link"))
    paths = links.select("place", path_only(F.col("link")).alias("path")).where(~last_segment(F.col("path")).isin(*MENU))
    return first_seen(paths, ["path"], ["place"])


def event_pages(landing: DataFrame) -> DataFrame:
    """(place, url, body, block) of the listed events whose page has a date block; `block` is its text."""
    block = H.inner(F.col("body"), DATE_BLOCK)
    found = pages(landing, CINEMA, "/en/whats-on/").join(listed(landing), F.col("url") == F.concat(F.lit(BASE), "path"))
    return found.where(block.isNotNull()).select("place", "url", "body", _clean(F.regexp_replace(block, r"(?i)<br\s*/?>", " ")).alias("block"))


def events(landing: DataFrame, asof: Column) -> DataFrame:
    """Events with one date and time, from today on; a subtitle is the film and the heading its director."""
    page = F.col("body")
    header, banner = H.inner(page, HEADER), H.inner(page, BANNER)
    found = event_pages(landing).withColumns(
        {
            "at": en_date_time(F.col("block")),
            "head": _clean(H.inner(header, HEADING)),
            "sub": _clean(H.inner(header, SUBTITLE)),
            "poster": absolute_url(H.inner(banner, POSTER), BASE),
        }
    )
    found = found.where(F.col("at.date") >= F.date_format(asof, "yyyy-MM-dd")).withColumn("title", first_truthy("sub", "head")).where(truthy("title"))
    return found.select(
        F.concat(F.lit("culturgest_"), last_segment(F.col("url"))).alias("id"), "title", F.when(truthy("sub"), F.col("head")).alias("director"), "poster", F.col("url").alias("link"),
        F.array(session(F.col("at.date"), F.col("at.time"), CINEMA)).alias("sessions"), "place",
    )


def festival_days(landing: DataFrame) -> DataFrame:
    """(place, day) of the listed events of the festival that span several days; a day belongs to the first of them."""
    spans = event_pages(landing).where(F.col("body").rlike("(?i)indielisboa") & en_date_time(F.col("block"))["date"].isNull())
    return first_seen(spans.select("place", F.explode(day_range(F.col("block"))).alias("day")), ["day"], ["place"])


def festival(landing: DataFrame, asof: Column, label: str = "INDIE Lisboa") -> DataFrame:
    """The label is followed by the year of the day. G10, D5, D6, F18, C14: headings of date and venue in pairs, each with the nearest link before it."""
    day = F.regexp_extract("url", LISTED_DAY, 1)
    dated = pages(landing, CINEMA, "caldt=").withColumn("day", day).join(festival_days(landing), "day")
    tokens = dated.where(F.col("day") >= F.date_format(asof, "yyyy-MM-dd")).select("day", "place", F.posexplode(H.all_of(F.col("body"), TOKEN)).alias("pos", "t"))
    tokens = tokens.withColumns({"h2": F.col("t").startswith("<h2"), "text": F.btrim(H.unescape(H.strip_tags(F.col("t")))), "href": H.inner(F.col("t"), r'<a href="([^"]+)"')})
    by_pos = Window.partitionBy("day").orderBy("pos")
    link = F.when(~F.col("h2"), F.struct("text", "href"))
    tokens = tokens.withColumn("link", F.last(link, ignorenulls=True).over(by_pos.rowsBetween(Window.unboundedPreceding, -1)))
    heads = tokens.where("h2").withColumn("venue", F.lead("text").over(by_pos)).withColumn("at", heading_time(F.col("text")))
    rows = heads.where(F.col("venue").contains("Culturgest") & F.col("at.date").isNotNull() & F.col("link").isNotNull() & ~F.col("link.text").rlike(SKIP))
    rows = rows.select(F.btrim(F.lower("link.text")).alias("key"), F.col("link.text").alias("title"), F.col("link.href").alias("link"), F.col("at.duration").alias("duration"),
                       F.struct("place", "day", "pos").alias("ord"), session(F.col("at.date"), F.col("at.time"), CINEMA, F.array(F.concat_ws(" ", F.lit(label), F.substring("day", 1, 4)))).alias("session"))
    movies = gather(rows, ["key"], ["title", "link", "duration"], dedupe=False)
    return movies.select(F.concat(F.lit("culturgest_indie_"), id_slug(F.col("key"))).alias("id"), "title", "duration", "link", F.lit("INDIE").alias("festival"), "sessions", F.col("src_ord.place").alias("place"), F.col("src_ord").alias("ord"))


def parse(landing: DataFrame, asof: Column, rank: int) -> DataFrame:
    """Single events and the festival's films, in the order of the listing; a festival's films stand where its event does."""
    both = events(landing, asof).unionByName(festival(landing, asof), allowMissingColumns=True)
    return as_movies(numbered(both.drop("src_ord"), "place", "ord", "id"), rank)
