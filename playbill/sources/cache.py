"""Answers of catalogues, kept between runs as lines of JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.publish import replace_folder


def load(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The cache, or the one put aside by an update that failed; empty if there is none."""
    empty = spark.createDataFrame([], schema)
    for place in (path, path + ".old"):
        try:
            lines = spark.read.text(place)
        except AnalysisException:  # no such folder
            continue
        return lines.select(F.from_json("value", empty.schema).alias("r")).select("r.*")
    return empty


def save(cache: DataFrame, path: str) -> bool:
    """Write the cache if it differs from what is there; whether it did. Rows count as often as they occur, in any order."""
    spark = cache.sparkSession
    stored = load(spark, path, cache.schema)
    as_json = lambda df: df.select(F.to_json(F.struct(*cache.columns)).alias("j")).groupBy("j").agg(F.count("*").alias("n"))
    if as_json(cache).join(as_json(stored), ["j", "n"], "left_anti").isEmpty() and as_json(stored).join(as_json(cache), ["j", "n"], "left_anti").isEmpty():
        return False
    cache.write.mode("overwrite").json(path + ".next")
    replace_folder(spark, path)
    return True
