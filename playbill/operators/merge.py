"""Entity resolution of listings: null-aware exact merge, edit-distance merge, filling of fields, union of sessions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_key
from ..functions.truthy import truthy
from ..scratch import remove, stored, written
from .components import components

#: Links of a component that one task scans: some MB.
COMPONENT = 500_000

#: Fields that a merged record takes from later ones where it has none, with their kinds.
FILLED = {"director": "string", "year": "number", "duration": "number", "poster": "string", "genres": "array", "link": "string", "festival": "string"}


def null_aware_key(df: DataFrame, title_key: str, year: str, order: list[str]) -> DataFrame:
    """Adds `group_year`, which with the title key is the key of the merge.

    A title whose first record has no year takes all its records together. Otherwise a record without a year joins the last
    year seen before it. `order` must be total.
    """
    w = Window.partitionBy(title_key).orderBy(*order)
    first = F.first(year).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.last(year, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("group_year", F.when(first.isNotNull(), last))


def fill(column: str, kind: str, order: Column) -> Column:
    """C4: the first value in order that is there, as an aggregate."""
    return F.min_by(F.when(truthy(column, kind), F.col(column)), F.when(truthy(column, kind), order)).alias(column)


def union_sessions(df: DataFrame, keys: list[str], order: list[str], session: str = "session", by_time: bool = True) -> DataFrame:
    """One ordered array of sessions for each key; of equal (date, time, cinema) the first stays with its labels.

    `df` has one session a row, in `session`, with the order columns.
    """
    s = F.col(session)
    parts = Window.partitionBy(*keys, s["date"], s["time"], s["cinema"]).orderBy(*order)
    # dealt by the keys alone, which serves the window and the grouping: one shuffle
    once = df.repartition(*[F.col(k) for k in keys]).withColumn("_n", F.row_number().over(parts)).where("_n = 1")
    head = [s["date"].alias("a"), s["time"].alias("b")] if by_time else []
    tagged = F.struct(*head, *[F.col(o).alias(f"o{k}") for k, o in enumerate(order)], s.alias("s"))
    return once.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(tagged)), lambda x: x["s"]).alias("sessions"))


def _merged(movies: DataFrame, keys: list[str], by_time: bool) -> DataFrame:
    """One record for each key: the first in order, its gaps filled from the later ones, all sessions together."""
    order = F.struct("src_rank", "src_ord")
    plain = [c for c in movies.columns if c not in {*keys, *FILLED, "sessions", "src_rank", "src_ord"}]
    heads = movies.groupBy(*keys).agg(
        *[F.min_by(c, order).alias(c) for c in plain], *[fill(c, k, order) for c, k in FILLED.items()], F.min(order).alias("_first")
    )
    sessions = movies.select(*keys, "src_rank", "src_ord", F.posexplode("sessions").alias("pos", "session"))
    joined = union_sessions(sessions, keys, ["src_rank", "src_ord", "pos"], by_time=by_time).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [heads[k].eqNullSafe(joined[f"_{k}"]) for k in keys]
    out = heads.join(joined, same, "left").withColumn("sessions", F.coalesce("sessions", F.expr("array()").cast(movies.schema["sessions"].dataType)))
    return out.withColumns({"src_rank": F.col("_first.src_rank"), "src_ord": F.col("_first.src_ord"), "genres": F.coalesce("genres", F.array().cast("array<string>"))}).select(*movies.columns)


def exact_merge(movies: DataFrame) -> DataFrame:
    """Movies with equal keys become one; sessions by date and time."""
    keyed = null_aware_key(movies.withColumn("_title", norm_key(F.col("title"))), "_title", "year", ["src_rank", "src_ord"])
    keyed = keyed.withColumnRenamed("group_year", "_year")
    keys = ["_title", "_year"]
    return _merged(keyed, keys, by_time=True).drop(*keys)


def deletions(text: Column) -> Column:
    """The text and the text without each one of its characters: texts one edit apart share one of these."""
    each = F.transform(F.sequence(F.lit(1), F.length(text)), lambda k: F.concat(F.substring(text, 1, k - 1), F.substr(text, k + 1)))
    return F.array_distinct(F.concat(F.array(text), F.when(F.length(text) > 0, each).otherwise(F.array().cast("array<string>"))))


def near_keys(keys: DataFrame, key: str = "k", least: int = 8) -> DataFrame:
    """Pairs (a, b), a < b, of distinct keys at most one edit apart that differ in more than digits.

    Keys shorter than `least` have no pairs. Candidates come from an equality join on deletions, never from all pairs.
    """
    signs = keys.select(F.col(key).alias("k")).where(F.length(key) >= least).distinct().select("k", F.explode(deletions(F.col("k"))).alias("sign"))
    pairs = signs.select(F.col("k").alias("a"), "sign").join(signs.select(F.col("k").alias("b"), "sign"), "sign").where("a < b").select("a", "b").distinct()
    masked = lambda c: F.regexp_replace(c, r"\d", "#")
    return pairs.where(masked("a") != masked("b")).where(F.levenshtein("a", "b", 1).between(0, 1))


def title_classes(nodes: DataFrame) -> DataFrame:
    """(ord, k, year, n) of distinct keys and years: the least ord, and how many nodes (ord, k, year) there are.

    Nodes of one class have the same near titles and so the same fate in the greedy scan: popular titles are linked once.
    """
    return nodes.groupBy("k", "year").agg(F.min("ord").alias("ord"), F.count("*").alias("n")).select("ord", "k", "year", "n")


def fuzzy_links(classes: DataFrame) -> DataFrame:
    """Links (i, j), i < j, between classes (ord, k, year): near keys, years at most one apart or unknown."""
    pairs = near_keys(classes)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = classes.select(F.col("ord").alias("i"), F.col("k").alias("a"), F.col("year").alias("y1"))
    right = classes.select(F.col("ord").alias("j"), F.col("k").alias("b"), F.col("year").alias("y2"))
    close = F.coalesce(F.abs(F.col("y1") - F.col("y2")) <= 1, F.lit(True))
    return left.join(both, "a").join(right, "b").where((F.col("i") < F.col("j")) & close).select("i", "j")


def scanned(links: pd.DataFrame) -> pd.DataFrame:
    """(j, owner) of one component's links (i, j), i < j, by the greedy scan."""
    absorbed: dict[int, int] = {}
    for i, j in zip(*(links.sort_values(["j", "i"])[c].tolist() for c in "ij")):
        if j not in absorbed and i not in absorbed:
            absorbed[j] = i
    return pd.DataFrame({"j": list(absorbed), "owner": list(absorbed.values())}, dtype="int64")


def star_owners(links: DataFrame) -> DataFrame:
    """(j, owner) of every class that is absorbed, by the greedy scan in order.

    A class is absorbed by its least earlier neighbour that is not absorbed itself; absorbed ones absorb nothing. The scan never
    leaves a connected component: those of up to COMPONENT links are scanned by one task each, however long their chains,
    and only larger ones are settled in rounds.
    """
    links, path = stored(links.distinct(), "links")
    roots, scratch = components(links.select(F.col("i").alias("u"), F.col("j").alias("v")))
    # every j is the greater end of a link, so it is no root
    joined, joined_path = stored(links.join(roots.select(F.col("node").alias("j"), "root"), "j"), "rooted")
    giants, giants_path = stored(joined.groupBy("root").count().where(F.col("count") > COMPONENT).select("root"), "giants")
    small = joined.join(giants, "root", "left_anti").groupBy("root").applyInPandas(lambda rows: scanned(rows[["i", "j"]]), "j long, owner long")
    owners = small if giants.isEmpty() else small.unionByName(_by_rounds(joined.join(giants, "root", "left_semi").select("i", "j")))
    owners = written(owners, "owners")
    for done in (path, joined_path, giants_path, *scratch):
        remove(links.sparkSession, done)
    return owners


def _by_rounds(links: DataFrame) -> DataFrame:
    """(j, owner) by rounds over all links at once, each written before the next.

    A round settles those whose earlier neighbours are settled, or of which one leads: as many rounds as the longest chain of
    undecided neighbours.
    """
    spark = links.sparkSession
    links, links_path = stored(links, "links")
    nodes = links.select(F.col("i").alias("n")).union(links.select("j")).distinct()
    first = nodes.join(links.select(F.col("j").alias("n")).distinct(), "n", "left_anti").select("n", F.lit(True).alias("leads"))
    state, path = stored(first, "state")
    while True:
        open_links = links.join(state.select(F.col("n").alias("j")), "j", "left_anti")
        seen = open_links.join(state.withColumnRenamed("n", "i"), "i", "left").groupBy("j").agg(F.bool_or(F.coalesce("leads", F.lit(False))).alias("led"), F.bool_or(F.col("leads").isNull()).alias("waits"))
        more, more_path = stored(seen.where("led or not waits").select(F.col("j").alias("n"), (~F.col("led")).alias("leads")), "state")
        if more.isEmpty():
            break
        both, both_path = stored(state.unionByName(more), "state")
        remove(spark, path)
        remove(spark, more_path)
        state, path = both, both_path
    leaders = state.where("leads").select(F.col("n").alias("i"))
    absorbed = state.where("not leads").select(F.col("n").alias("j"))
    owners = written(links.join(leaders, "i").join(absorbed, "j").groupBy("j").agg(F.min("i").alias("owner")), "owners")
    for done in (links_path, path, more_path):
        remove(spark, done)
    return owners


def absorbed(nodes: DataFrame) -> DataFrame:
    """(ord, owner) of every node (ord, k, year) that is absorbed."""
    classes = written(title_classes(nodes), "classes")
    owned = classes.join(star_owners(fuzzy_links(classes)).withColumnRenamed("j", "ord"), "ord").select(F.col("k").alias("ok"), F.col("year").alias("oy"), "owner")
    return nodes.join(owned, (F.col("k") == F.col("ok")) & F.col("year").eqNullSafe(F.col("oy"))).select("ord", "owner")


def fuzzy_merge(movies: DataFrame, session_order: str = "append") -> DataFrame:
    """Movies one edit apart become one. Sessions are appended, or `sorted` by date and time."""
    rank = F.col("src_rank").cast("long") * (1 << 31) + F.col("src_ord")
    movies = movies.withColumn("_ord", rank)
    owners = absorbed(movies.select(F.col("_ord").alias("ord"), norm_key(F.col("title")).alias("k"), "year")).withColumnRenamed("ord", "_j")
    owned = movies.join(owners, movies["_ord"] == owners["_j"], "left").withColumn("_owner", F.coalesce("owner", "_ord")).drop("_j", "owner", "_ord")
    return _merged(owned, ["_owner"], by_time=session_order == "sorted").drop("_owner")


def shortest_title_merge(df: DataFrame, key: list[str], title: str, order: str) -> DataFrame:
    """Rows that agree in the whole key, none of it null, become one with the shortest title; others stay alone."""
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    grouped = df.withColumn("_solo", F.when(~whole, F.col(order)))
    w = Window.partitionBy(*key, "_solo").orderBy(F.length(title), order)
    return grouped.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_solo")
