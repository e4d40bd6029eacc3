"""Payloads without a fixed schema, as variants: what is there is read, what is not is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variant(text: Column) -> Column:
    """The JSON value of a text; null for null and for what is no JSON."""
    return F.try_parse_json(text)


def at(value: Column, path: str, kind: str = "string") -> Column:
    """What is at a path, cast; null where there is nothing, or nothing that can be cast."""
    return F.try_variant_get(value, path, kind)


def entries(df: DataFrame, value: str, path: str = "$") -> DataFrame:
    """df with pos, key and entry for each element of the array, or field of the object, at the path; rows without any go.

    Elements are in their order and have no key; fields are in the order of their names.
    """
    inner = df.withColumn("_inner", F.try_variant_get(value, path, "variant"))
    spread = inner.sparkSession.tvf.variant_explode(F.col("_inner").outer())
    return inner.lateralJoin(spread.withColumnRenamed("value", "entry")).drop("_inner")


def film_records(scripts: DataFrame, js: str = "js") -> DataFrame:
    """scripts' columns, ord, slug, title, year and sessions of films in hydration payloads: arrays of JSON texts.

    A record is a text that is itself a JSON object with a slug and sessions, whatever else it has.
    """
    items = entries(scripts.withColumn("_list", variant(F.col(js))).where(F.schema_of_variant("_list").startswith("ARRAY")), "_list").withColumnRenamed("pos", "ord")
    film = items.withColumn("_film", variant(at(F.col("entry"), "$", "string")))
    film = film.where(at(F.col("_film"), "$.slug").isNotNull() & F.try_variant_get("_film", "$.sessions", "array<variant>").isNotNull())
    return film.select(*scripts.columns, "ord", at(F.col("_film"), "$.slug").alias("slug"), at(F.col("_film"), "$.title").alias("title"), at(F.col("_film"), "$.year", "int").alias("year"), F.try_variant_get("_film", "$.sessions", "variant").alias("sessions"))
