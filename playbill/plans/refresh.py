"""The whole job as one plan: landed pages to movies, merged, enriched and ready to publish."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.truthy import truthy
from ..operators import enrich as E
from ..operators.merge import exact_merge, fuzzy_merge
from ..scratch import written
from ..sources import registry
from ..sources.keyed import KeyedTable


@dataclass(frozen=True)
class Snapshots:
    """External catalogues as tables; see model."""

    lbxd: DataFrame
    omdb: DataFrame
    wiki: DataFrame
    lbxd_aliases: DataFrame
    omdb_aliases: DataFrame


def clean(movies: DataFrame) -> DataFrame:
    """B1: asterisks go from titles and times."""
    bare = lambda c: F.btrim(F.replace(c, F.lit("*"), F.lit("")))
    return movies.withColumns({"title": bare(F.col("title")), "sessions": F.transform("sessions", lambda s: s.withField("time", bare(s["time"])))})


def upcoming(movies: DataFrame, asof: Column) -> DataFrame:
    """Sessions from the day on; movies without any go."""
    day = F.date_format(asof, "yyyy-MM-dd")
    return movies.withColumn("sessions", F.filter("sessions", lambda s: s["date"] >= day)).where(F.size("sessions") > 0)


def with_fallback(movies: DataFrame, previous: DataFrame) -> DataFrame:
    """A venue without movies keeps those of the previous document that have a session there."""
    spark = movies.sparkSession
    venues = spark.createDataFrame([(s.cinema, s.rank) for s in registry.sources()], "cinema STRING, rank INT")
    empty = venues.join(movies.select(F.col("src_rank").alias("rank")).distinct(), "rank", "left_anti")
    shown = previous.withColumn("_venue", F.explode(F.array_distinct(F.transform("sessions", lambda s: s["cinema"]))))
    kept = shown.join(empty, shown["_venue"] == empty["cinema"]).withColumn("src_rank", F.col("rank"))
    return movies.unionByName(kept.select(*movies.columns))


def merged(landing: DataFrame, previous: DataFrame, asof: Column, session_order: str = "append") -> DataFrame:
    """Stages 2 to 8."""
    movies = with_fallback(registry.extract(landing, asof), previous)
    # both merges read their input several times: it is parsed once, and written
    once = written(upcoming(clean(movies), asof), "upcoming")
    return written(fuzzy_merge(written(exact_merge(once), "exact"), session_order), "merged")


def refresh(landing: DataFrame, previous: DataFrame, snapshots: Snapshots, asof: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(movies, directors, errors), as they are published."""
    movies = merged(landing, previous, asof)
    movies = written(E.enrich(movies, snapshots.lbxd, snapshots.omdb, snapshots.lbxd_aliases, snapshots.omdb_aliases), "enriched")
    return movies, E.directors(movies, snapshots.wiki), registry.errors(landing)


#: Answers of both catalogues for a title and a year, null where there was none; what is known of a person.
ANSWER = f"title STRING, year INT, lbxd STRUCT<{E.LBXD_ANSWER}>, omdb STRUCT<{E.OMDB_ANSWER}>"
PERSON = "name STRING, photo STRING, bio STRING"
#: (movies, whether directors must agree) -> both lookups' results; names -> PERSON.
Ask = Callable[[DataFrame, bool], tuple[DataFrame, DataFrame]]
AskPeople = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Caches:
    """Tables of ANSWER and PERSON, kept between runs."""

    answers: KeyedTable
    people: KeyedTable

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> Caches:
        return cls(KeyedTable(spark, f"{path}/answers", ANSWER, ["title", "year"]), KeyedTable(spark, f"{path}/people", PERSON, ["name"]))


def asking(snapshots: Snapshots) -> tuple[Ask, AskPeople]:
    """Lookups in snapshots; others may fetch."""

    def catalogues(movies: DataFrame, check_director: bool) -> tuple[DataFrame, DataFrame]:
        return E.lbxd_lookup(movies, snapshots.lbxd, snapshots.lbxd_aliases, check_director), E.omdb_lookup(movies, snapshots.omdb, snapshots.omdb_aliases)

    return catalogues, lambda names: snapshots.wiki.join(names, "name", "left_semi")


def answers(movies: DataFrame, cache: KeyedTable, ask: Ask) -> DataFrame:
    """ANSWER for every title and year of the movies; the catalogues are asked only for what the cache lacks.

    Of movies with one title and year the first is asked for, its director must agree. What has no answer is kept as
    such, so it is not asked for again. An answer without a description or a country is asked for once more in each run, whatever the
    director, and replaced if there is one now.
    """
    firsts = movies.groupBy("title", "year").agg(F.min_by(F.struct("id", "src_rank", "src_ord", "director"), F.struct("src_rank", "src_ord", "id")).alias("m")).select("title", "year", "m.*")
    firsts = written(firsts, "asked")
    known = written(cache.look_up(firsts), "known")
    same = lambda a, b: a["title"].eqNullSafe(b["title"]) & a["year"].eqNullSafe(b["year"])
    misses = written(firsts.join(known, same(firsts, known), "left_anti"), "misses")
    old = known.where("lbxd is not null and (lbxd.description is null or lbxd.country is null)")
    stale = written(firsts.join(old, same(firsts, old), "left_semi"), "stale")

    def told(asked: DataFrame, check: bool) -> DataFrame:
        lbxd, omdb = ask(asked, check)
        whole = lambda df, kind: df.select(*E.KEY, F.struct(*[x.split()[0] for x in kind.split(", ")]).alias("a"))
        both = asked.join(whole(lbxd, E.LBXD_ANSWER).withColumnRenamed("a", "lbxd"), E.KEY, "left").join(whole(omdb, E.OMDB_ANSWER).withColumnRenamed("a", "omdb"), E.KEY, "left")
        return both.select("title", "year", "lbxd", "omdb")

    if not misses.isEmpty():
        cache.put(told(misses, True))
    if not stale.isEmpty():
        again = told(stale, False).where("lbxd is not null").drop("omdb")
        cache.put(known.withColumnsRenamed({"title": "t", "year": "y", "lbxd": "before"}).join(again, F.col("t").eqNullSafe(F.col("title")) & F.col("y").eqNullSafe(F.col("year"))).select("title", "year", "lbxd", "omdb"))
    return cache.look_up(firsts)


def people(movies: DataFrame, cache: KeyedTable, ask: AskPeople) -> DataFrame:
    """PERSON for the movies' directors; only names that the cache lacks are asked for, and kept even if nothing is known."""
    names = written(movies.where(truthy("director")).select(F.col("director").alias("name")).distinct(), "names")
    misses = written(names.join(cache.look_up(names), "name", "left_anti"), "misses")
    if not misses.isEmpty():
        cache.put(misses.join(ask(misses), "name", "left").select("name", "photo", "bio"))
    return cache.look_up(names)


def refresh_cached(landing: DataFrame, previous: DataFrame, asof: Column, caches: Caches, ask: Ask, ask_people: AskPeople) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(movies, directors, errors), as they are published; catalogues are asked only for what earlier runs have not learned."""
    movies, directors = enrich_cached(merged(landing, previous, asof), caches, ask, ask_people)
    return movies, directors, registry.errors(landing)


def enrich_cached(movies: DataFrame, caches: Caches, ask: Ask, ask_people: AskPeople) -> tuple[DataFrame, DataFrame]:
    """(movies, directors) enriched from the caches: those of a refresh, or of an earlier document."""
    found = answers(movies, caches.answers, ask).withColumnsRenamed({"title": "a_title", "year": "a_year"})
    keyed = movies.select(*E.KEY, "title", "year").join(found, F.col("title").eqNullSafe(F.col("a_title")) & F.col("year").eqNullSafe(F.col("a_year")))
    lbxd = keyed.where("lbxd is not null").select(*E.KEY, "lbxd.*")
    omdb = keyed.where("omdb is not null").select(*E.KEY, "omdb.*")
    done = written(E.resolve(movies, lbxd, omdb), "enriched")
    return done, E.directors(done, people(done, caches.people, ask_people))


def missing_keys(movies: DataFrame, cache: DataFrame) -> DataFrame:
    """3.3: the titles and years that the snapshots lack."""
    return E.cache_split(movies, cache)[1].select("title", "year").distinct()


def whats_on(movies: DataFrame, asof: Column) -> DataFrame:
    """Sessions by day and venue."""
    shown = upcoming(movies, asof).select("id", F.explode("sessions").alias("s"))
    return shown.groupBy("s.date", "s.cinema").agg(F.count("*").alias("sessions"), F.count_distinct("id").alias("movies"))
