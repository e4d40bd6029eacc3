"""What the venue parsers share. A parser is a plan from landed pages to movies; it fetches nothing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions.truthy import truthy

_TYPES = dict(x.split(" ", 1) for x in model.MOVIE.replace(model.SESSION, "S").split(", "))
_TYPES["sessions"] = f"ARRAY<{model.SESSION}>"


@dataclass(frozen=True)
class Source:
    """A venue: the rank is its place among the sources. `swallows`: a failed fetch leaves no error row."""

    name: str
    cinema: str
    rank: int
    parse: Callable[[DataFrame, Column], DataFrame]
    swallows: bool = False


def pages(landing: DataFrame, source: str, like: str = "") -> DataFrame:
    """The latest page of each address that was fetched and is not empty: url, body. Retries are the fetch layer's."""
    good = landing.where((F.col("source") == source) & (F.col("status") == 200) & truthy("body") & F.col("url").rlike(like))
    return good.groupBy("url").agg(F.max_by("body", "fetched_at").alias("body"))


def session(date: Column, time: Column, cinema: str, labels: Column | None = None) -> Column:
    """A session; no labels are a null array."""
    labels = F.lit(None).cast("array<string>") if labels is None else F.when(F.size(labels) > 0, labels)
    return F.struct(date.alias("date"), time.alias("time"), F.lit(cinema).alias("cinema"), labels.alias("labels"))


def gather(rows: DataFrame, keys: list[str], heads: list[str], dedupe: bool = True, fill: tuple[str, ...] = ()) -> DataFrame:
    """Movies from rows of one session each, in the order of `ord`.

    The first row of a key gives the heads; those in `fill` come from the first row that has them. Of sessions at equal date
    and time the first stays if `dedupe`; sessions are by date and time.
    """
    s = F.col("session")
    if dedupe:
        w = Window.partitionBy(*keys, s["date"], s["time"]).orderBy("ord")
        rows = rows.withColumn("_n", F.row_number().over(w))
    else:
        rows = rows.withColumn("_n", F.lit(1))
    tagged = F.when(F.col("_n") == 1, F.struct(s["date"].alias("a"), s["time"].alias("b"), "ord", s.alias("s")))
    first = [F.min_by(h, "ord").alias(h) if h not in fill else F.min_by(F.when(truthy(h), F.col(h)), F.when(truthy(h), F.col("ord"))).alias(h) for h in heads]
    grouped = rows.groupBy(*keys).agg(*first, F.min("ord").alias("src_ord"), F.array_sort(F.collect_list(tagged)).alias("_s"))
    return grouped.withColumn("sessions", F.transform("_s", lambda x: x["s"])).drop("_s")


def numbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """src_ord: the movies' places by the order columns, which are total. One venue's listing, some thousands of movies at most, so one partition is enough."""
    return df.withColumn("src_ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def as_movies(df: DataFrame, rank: int) -> DataFrame:
    """The movie's columns, those that a source lacks as null; genres are never null."""
    have = set(df.columns)
    out = {c: (F.col(c) if c in have else F.lit(None)).cast(t) for c, t in _TYPES.items()}
    out["src_rank"] = F.lit(rank)
    out["genres"] = F.coalesce(out["genres"], F.array().cast("array<string>"))
    return df.select(*[v.alias(k) for k, v in out.items()])
