"""A1: the venues in order of their rank, which is their priority in merges."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from . import batalha, cinemateca, culturgest, fernando, ideal, medeia, sao_jorge, trindade
from .base import Source, as_movies

_NIMAS = partial(medeia.parse, cinema="nimas", slug="cinema-medeia-nimas")
_CAMPO = partial(medeia.parse, cinema="campo_alegre", slug="teatro-campo-alegre")


def sources() -> list[Source]:
    """One identifier serves for a venue's rows and its sessions, so the fallback finds them."""
    listed = [
        ("São Jorge", "sao_jorge", sao_jorge.parse, False),
        ("Cinemateca", "cinemateca", cinemateca.parse, True),
        ("Medeia Nimas", "nimas", _NIMAS, False),
        ("Fernando Lopes", "fernando", fernando.parse, False),
        ("Batalha", "batalha", batalha.parse, False),
        ("Trindade", "trindade", trindade.parse, True),
        ("Cinema Ideal", "ideal", ideal.parse, True),
        ("Campo Alegre", "campo_alegre", _CAMPO, False),
        ("Culturgest", "culturgest", culturgest.parse, True),
    ]
    return [Source(name, cinema, rank, partial(fn, rank=rank), swallows) for rank, (name, cinema, fn, swallows) in enumerate(listed)]


def errors(landing: DataFrame) -> DataFrame:
    """Failed fetches of the venues that report them: cinema, error: what was wrong with the answer if that is known, else its status."""
    spark = landing.sparkSession
    house = {"nimas": "medeia", "campo_alegre": "medeia"}
    rows = [(house.get(s.cinema, s.cinema), s.name) for s in sources() if not s.swallows]
    named = spark.createDataFrame(rows, "source STRING, cinema STRING")
    wrong = F.when(F.col("status").isNull(), F.nullif("body", F.lit("")))
    failed = landing.where("status is null or status <> 200").select("source", F.concat(F.coalesce("url", F.lit("")), F.lit(": "), F.coalesce(wrong, F.concat(F.lit("status "), F.coalesce(F.col("status").cast("string"), F.lit("none"))))).alias("error"))
    good = landing.where("status = 200").select("source").distinct()
    return failed.join(good, "source", "left_anti").join(named, "source").groupBy("cinema").agg(F.min("error").alias("error"))


def extract(landing: DataFrame, asof: Column) -> DataFrame:
    """All venues' movies; session cinema is the venue that listed them."""
    spark: SparkSession = landing.sparkSession
    out = spark.createDataFrame([], model.MOVIE)
    for source in sources():
        out = out.unionByName(source.parse(landing, asof))
    return out


__all__ = ["as_movies", "errors", "extract", "sources"]
