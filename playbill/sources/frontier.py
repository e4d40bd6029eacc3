"""The crawl frontier: what to fetch next follows from the pages that have landed.

Addresses are rows. Those of the venues' first pages come from a list, all others are derived from landed pages by the same plans
that parse them; what has landed already is taken away by an anti-join, and the rest is fetched, dealt by host, with a
pause between two requests to one host. This goes on until nothing new is found.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import html as H
from ..functions.text import is_multi_title
from ..operators.ordered import ranked_pick
from ..scratch import remove, stored
from . import cinemateca, culturgest, fernando, medeia, sao_jorge, trindade
from .base import pages
from .landing import answer
from .store import land, landed

ADDRESS = "source STRING, url STRING"
#: Link after link, a site is not deeper than this; more rounds are a sign that addresses do not settle.
ROUNDS = 50


@dataclass(frozen=True)
class Start:
    """A venue's first page: `{day}` in its address is each of `days` days from the crawl's day on, `{since}` the day `back` before it.

    `options`: how these pages are fetched, as for the landing source; pages that they lead to are fetched plainly.
    """

    source: str
    url: str
    days: int = 1
    back: int = 0
    options: dict[str, str] = field(default_factory=dict)


# Where the venues list what they show, the window of days, and the request of the query API
_QUERY = '{"collection": "sessoes", "page": 0, "pageSize": 500}'
STARTS = (
    Start("sao_jorge", "https://cinemasaojorge.pt/wp-json/wp/v2/evento?per_page=50&_embed=1&after={since}T00:00:00&orderby=modified&order=desc", back=30),
    Start("cinemateca", f"{cinemateca.BASE}/Programacao.aspx?date={{day}}", days=14),
    Start("medeia", "https://medeiafilmes.com/filmes-em-exibicao"),
    Start("fernando", f"{fernando.BASE}/Programacao"),
    Start("batalha", "https://repeater.bondlayer.com/fetch", options={"post": _QUERY, "errorfield": "error"}),
    Start("trindade", f"{trindade.BASE}/pt/programa%C3%A7%C3%A3o", options={"attempts": "3", "pause": "3", "expect": "<script"}),
    Start("ideal", "https://bilheteira.cinemaidealemcasa.pt/session/with-movies"),
    Start("ideal", "https://www.cinemaidealemcasa.pt/no-cinema/"),
    Start("culturgest", f"{culturgest.BASE}{culturgest.LISTING}?typology=5", options={"prime": f"{culturgest.BASE}/en/whats-on/by-event/?typology=5", "ajax": "true"}),
)
#: Where keyed records and a festival's days are, which their lists do not say.
RECORDS, FESTIVAL = "https://api.cinematrindade.pt/wp-json/wp/v2", "https://indielisboa.com/en/festival/schedule/"


def first_pages(spark: SparkSession, asof: Column, starts: tuple[Start, ...] = STARTS) -> DataFrame:
    """ADDRESS of the starts, one row for each day of a window."""
    rows = spark.createDataFrame([(s.source, s.url, s.days, s.back) for s in starts or ()], "source STRING, url STRING, days INT, back INT")
    day = F.explode(F.sequence(F.lit(0), F.col("days") - 1)).alias("k")
    on = lambda days: F.date_format(F.date_add(asof.cast("date"), days), "yyyy-MM-dd")
    url = F.replace(F.replace("url", F.lit("{day}"), on(F.col("k"))), F.lit("{since}"), on(-F.col("back")))
    return rows.select("*", day).select("source", url.alias("url")).distinct()


def _site(landing: DataFrame, source: str, like: str) -> str:
    """The site that the source's list pages are on; empty if none has landed, and then nothing is listed either."""
    return pages(landing, source, like).agg(F.min(F.regexp_extract("url", r"^\w+://[^/]+", 0))).first()[0] or ""


def links(landing: DataFrame, asof: Column, records: str = RECORDS, festival: str = FESTIVAL) -> DataFrame:
    """ADDRESS of the pages that landed pages lead to; addresses without a site are on the site of their page."""

    def out(source: str, df: DataFrame, url: Column) -> DataFrame:
        return df.select(F.lit(source).alias("source"), url.alias("url"))

    shows = sao_jorge.film_events(landing)
    house = pages(landing, "medeia", "filmes-em-exibicao").select(F.explode(F.map_values(F.from_json(H.script_json(F.col("body")), medeia.LIST)["schedule"]["events"])).alias("e"))
    site = {source: _site(landing, source, like) for source, like in (("fernando", "Programacao"), ("culturgest", culturgest.LISTING), ("cinemateca", r"Programacao\.aspx"))}
    film = trindade.films(landing)
    # joint titles, and films whose listing lacks a director or a year, are described on pages of their own
    lacking = cinemateca.listed(landing).where(is_multi_title(F.col("title")) | F.col("director").isNull() | F.col("year").isNull())
    lacking = lacking.groupBy("film_id").agg(F.min("session.date").alias("day"))
    found = [
        out("sao_jorge", shows, F.col("e.link")),
        out("medeia", house.where(F.col("e.url").contains("/filmes/")), F.col("e.url")),
        out("fernando", fernando.schedule(landing, asof), F.concat(F.lit(site["fernando"] + "/"), "slug")),
        out("trindade", film.select(F.explode("directors").alias("did")), F.concat(F.lit(f"{records}/directors/"), "did")),
        out("trindade", film.where("poster is not null"), F.concat(F.lit(f"{records}/media/"), "poster")),
        out("culturgest", culturgest.listed(landing), F.concat(F.lit(site["culturgest"]), "path")),
        out("culturgest", culturgest.festival_days(landing), F.concat(F.lit(f"{festival}?caldt="), "day")),
        out("cinemateca", lacking, F.concat(F.lit(site["cinemateca"] + "/Programacao.aspx?id="), "film_id", F.lit("&date="), "day")),
    ]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.where("url rlike '^\\\\w+://[^/]+'").distinct()


def next_candidates(candidates: DataFrame, keys: list[str], tried: DataFrame, settled: DataFrame) -> DataFrame:
    """ADDRESS of each key's best candidate that was not tried; keys that are settled ask for no more.

    `candidates`: keys, pos, source, url; `tried`: source, url; `settled`: keys. So a key costs one request a round and stops at the
    first answer that will do.
    """
    left = candidates.join(settled.select(*keys).distinct(), keys, "left_anti").join(tried.select("source", "url").distinct(), ["source", "url"], "left_anti")
    return ranked_pick(left, keys, [F.lit(True)], ["pos"]).select("source", "url").distinct()


def frontier(landing: DataFrame, asof: Column, starts: tuple[Start, ...] = STARTS, since: Column | None = None, **places: str) -> DataFrame:
    """ADDRESS of what is to be fetched now: the first pages and all links, without what has landed.

    `since`: what landed before it is out of date, so it is fetched again and its links do not count.
    """
    fresh = landing if since is None else landing.where(F.col("fetched_at") >= since)
    wanted = first_pages(landing.sparkSession, asof, starts).unionByName(links(fresh, asof, **places)).distinct()
    return wanted.join(fresh.select("source", "url").distinct(), ["source", "url"], "left_anti")


def fetch(addresses: DataFrame, starts: tuple[Start, ...] = STARTS, pause: float = 0.3) -> DataFrame:
    """model.LANDING: the pages of ADDRESS; one host's addresses are one task's, asked for one after another, `pause` seconds apart."""
    special = [(s.source, s.url.partition("{")[0], s.options) for s in starts if s.options]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, float] = {}
        for rows in batches:
            for source, url, host in zip(*(rows.column(c).to_pylist() for c in ("source", "url", "host"))):
                wait = last.get(host, float("-inf")) + pause - time.monotonic()
                if wait > 0:
                    time.sleep(wait)
                status, body = answer(url, next((o for name, start, o in special if source == name and url.startswith(start)), {}))
                last[host] = time.monotonic()
                cols = [pa.array([source]), pa.array([url]), pa.array([datetime.now(UTC)], pa.timestamp("us", tz="UTC")), pa.array([status], pa.int32()), pa.array([body], pa.string())]
                yield pa.record_batch(cols, names=["source", "url", "fetched_at", "status", "body"])

    hosted = addresses.select("source", "url", F.coalesce(F.parse_url("url", F.lit("HOST")), F.lit("")).alias("host"))
    return hosted.repartition("host").sortWithinPartitions("host", "source", "url").mapInArrow(run, model.LANDING)


def crawl(spark: SparkSession, path: str, asof: Column, starts: tuple[Start, ...] = STARTS, pause: float = 0.3, since: Column | None = None, **places: str) -> int:
    """Fetch to the folder of landed pages until there is nothing new; the number of rounds that fetched.

    A round's addresses are written down before they are asked for, so a lost executor costs a task's pages, not others.
    """
    for number in range(ROUNDS):
        todo, scratch = stored(frontier(landed(spark, path), asof, starts, since, **places), "frontier")
        some = not todo.isEmpty()
        if some:
            land(fetch(todo, starts, pause), path)
        remove(spark, scratch)
        if not some:
            return number
    raise RuntimeError(f"the frontier did not settle in {ROUNDS} rounds")
