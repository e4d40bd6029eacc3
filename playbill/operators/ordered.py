"""Operators whose outcome depends on an explicit order: carry-forward, as-of, neighbours, first-seen, ranked picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(df: DataFrame, value: Column, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The last value that is not null, up to and with the row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def until_marker(df: DataFrame, marker: Column, keys: list[str], order: list[str]) -> DataFrame:
    """The rows before the first that is marked."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_stop", F.max(marker.cast("int")).over(w)).where("_stop = 0").drop("_stop")


def asof_before(left: DataFrame, right: DataFrame, key: str, time: str, columns: list[str]) -> DataFrame:
    """Each left row with the columns of the latest right row of its key that is strictly earlier, nulls if none.

    Both sides become one stream, sorted once within a key; at equal times the left row comes first, so it sees only what
    is earlier. No pairs are made.
    """
    row = F.struct(*[F.col(c) for c in columns])
    one = left.select(key, time, F.struct(*left.columns).alias("_l"), F.lit(0).alias("_s"), F.lit(None).cast(right.select(row).schema[0].dataType).alias("_r"))
    two = right.select(key, time, F.lit(None).cast(one.schema["_l"].dataType).alias("_l"), F.lit(1).alias("_s"), row.alias("_r"))
    w = Window.partitionBy(key).orderBy(time, "_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = one.unionByName(two).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_s = 0")
    return seen.select("_l.*", *[F.col(f"_r.{c}").alias(f"prev_{c}") for c in columns])


def with_next(df: DataFrame, columns: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """The columns of the next row, as next_*."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ranked_pick(df: DataFrame, keys: list[str], tiers: list[Column], order: list[str]) -> DataFrame:
    """For each key the candidate of the best tier that has any, the first in order within it; none: no row."""
    tier = F.coalesce(*[F.when(t, F.lit(k)) for k, t in enumerate(tiers)])
    ranked = df.withColumn("_tier", tier).where("_tier is not null")
    best = ranked.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct("_tier", *order)).alias("_b"))
    return best.select("_b.*")


def series_keys(df: DataFrame, slug: str, title: str) -> DataFrame:
    """Adds `group_title`: the title where the slug has more than one, else empty."""
    many = df.groupBy(slug).agg((F.count_distinct(title) > 1).alias("_series"))
    return df.join(many, slug).withColumn("group_title", F.when(F.col("_series"), F.col(title)).otherwise("")).drop("_series")


def fall_back(current: DataFrame, previous: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """The current rows, and for sources that have none, the previous rows."""
    empty = sources.select(key).distinct().join(current.select(key).distinct(), key, "left_anti")
    return current.unionByName(previous.join(empty, key, "left_semi"))


def joined_list(df: DataFrame, ids: str, dimension: DataFrame, dim_id: str, dim_name: str, keys: list[str], sep: str = ", ") -> DataFrame:
    """D3: (keys, names): the names of an array of ids, in its order; ids without a name are left out."""
    one = df.select(*keys, F.posexplode(ids).alias("_pos", "_id"))
    named = one.join(dimension.select(F.col(dim_id).alias("_id"), F.col(dim_name).alias("_name")), "_id").where("coalesce(_name, '') <> ''")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_name"))), lambda p: p["_name"])
    names = named.groupBy(*keys).agg(F.array_join(parts, sep).alias("names"))
    return df.select(*keys).distinct().join(names, keys, "left")


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A literal map with repeated keys: the last entry counts."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def map_order(entries: Column) -> Column:
    """The keys of a map by its values, then keys."""
    return F.transform(F.array_sort(F.transform(F.map_entries(entries), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k")))), lambda e: e["k"])


def padded(items: Column, values: Column) -> Column:
    """struct(item, value) with the last value where values run out."""
    return F.transform(items, lambda t, k: F.struct(t.alias("item"), F.try_element_at(values, F.least(k + 1, F.size(values))).alias("value")))
