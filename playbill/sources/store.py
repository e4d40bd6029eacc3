"""The folder of landed pages: by source, and within it by a hash of the address.

A venue's plan reads its own pages only, as the source is a folder. Pages that are looked up by address carry the shard on both
sides of the join, so that shards nobody asks for are not read either.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model

#: Shards of a source.
SHARDS = 32
LAYOUT = "url STRING, fetched_at TIMESTAMP, status INT, body STRING, source STRING, shard INT"


def shard(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(SHARDS)).cast("int")


def land(pages: DataFrame, path: str) -> None:
    """Append model.LANDING to the folder; a shard's pages of one call are one file."""
    dealt = pages.withColumn("shard", shard(F.col("url"))).repartition("source", "shard")
    dealt.write.mode("append").partitionBy("source", "shard").option("compression", "zstd").parquet(path)


def landed(spark: SparkSession, path: str) -> DataFrame:
    """All landed pages: model.LANDING and their shard; none if there is no such folder."""
    try:
        pages = spark.read.schema(LAYOUT).parquet(path)
    except AnalysisException:  # no such folder
        return spark.createDataFrame([], model.LANDING).withColumn("shard", F.lit(0))
    return pages.select("source", "url", "fetched_at", "status", "body", "shard")


def looked_up(wanted: DataFrame, landing: DataFrame, source: str, url: str = "url") -> DataFrame:
    """`wanted` with body: the latest good page at the address in `url`; rows without one go.

    The shards that are asked for become known when the wanted addresses do, and only those are read.
    """
    good = landing.where((F.col("source") == source) & (F.col("status") == 200)).select(F.col("url").alias("_url"), "fetched_at", "body", F.col("shard").alias("_shard"))
    asked = wanted.withColumn("_asked", shard(F.col(url)))
    found = good.join(asked.select(F.col(url).alias("_url"), F.col("_asked").alias("_shard")).distinct(), ["_shard", "_url"], "left_semi")
    newest = found.groupBy("_shard", "_url").agg(F.max_by("body", "fetched_at").alias("body"))
    return asked.join(newest, (F.col("_asked") == F.col("_shard")) & (F.col(url) == F.col("_url"))).drop("_asked", "_shard", "_url")
