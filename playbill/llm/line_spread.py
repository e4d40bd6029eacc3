"""Operator 2: boilerplate lines by the number of distinct sites that carry them. DataFrame functions only.

Every line has a key of 96 bits of hashes. A HyperLogLog sketch of the sites of each key is built where the lines are and
merged by aggregation, so a hot line or a hot site sends one sketch from each task. Keys whose estimate is clearly above the
threshold are boilerplate, keys clearly below are not, and keys near it get an exact count of their distinct sites.
Boilerplate lines then leave all documents. The keys of up to `SENT_KEYS` such lines are sent to the documents as one hashed
array, so that no text is shuffled; more of them are joined, and the texts meet the lines that they lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import narrow, persist_table

#: Distinct sites that make a line boilerplate.
MIN_SITES = 8
#: log2 of the registers of a sketch: a standard error of about 1.6 %.
LOG_REGISTERS = 12
#: Estimates within this share of the threshold are counted exactly: more than ten standard errors.
NEAR = 0.25
#: Boilerplate keys that are sent to all tasks: 40 bytes each, 8 MB at most.
SENT_KEYS = 200_000


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, site, pos, k1, k2 of every line that is not blank; line ends are line feeds."""
    rows = narrow(docs, doc_id="long", text="string", source="string")
    split = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), F.col("source").alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    trimmed = split.select("doc_id", "row_key", "site", "pos", F.trim("line").alias("line")).where("line <> ''")
    return trimmed.select("doc_id", "row_key", "site", "pos", *_key(F.col("line")))


def _key(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line).alias("k1"), F.hash(F.lit("line"), line).alias("k2")


def boilerplate(found: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The keys (k1, k2) of lines on at least `min_sites` distinct sites; lines without a site count for none."""
    sited = found.where("site is not null").select("k1", "k2", "site")
    spread = sited.groupBy("k1", "k2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_REGISTERS)).alias("sites"))
    # below this even the sketch's whole error does not reach the threshold
    spread = spread.where(F.col("sites") >= min_sites * (1 - NEAR))
    spread, _ = persist_table(spread, "spread")
    clear = spread.where(F.col("sites") > min_sites * (1 + NEAR)).select("k1", "k2")
    near = spread.where(F.col("sites") <= min_sites * (1 + NEAR)).select("k1", "k2")
    exact = sited.join(near, ["k1", "k2"], "left_semi").distinct().groupBy("k1", "k2").count().where(F.col("count") >= min_sites).select("k1", "k2")
    return clear.unionByName(exact)


def _hashed(keys: DataFrame, slots: int) -> DataFrame:
    """One row: the keys in an array of `slots` lists, each key in the list of its k1 modulo `slots`."""
    slot = F.pmod("k1", F.lit(slots)).alias("slot")
    lists = keys.groupBy(slot).agg(F.collect_list(F.struct("k1", "k2")).alias("keys"))
    every = keys.sparkSession.range(slots).withColumnRenamed("id", "slot").join(lists, "slot", "left")
    every = every.agg(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("keys", F.array().cast("array<struct<k1:bigint,k2:int>>")).alias("keys")))).alias("every"))
    return every.select(F.transform("every", lambda e: e["keys"]).alias("hashed"))


def _sent(rows: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """rows and `gone`, the numbers of their boilerplate lines, by looking every line up in the array of `n` keys."""
    slots = max(1, n)

    def gone(line: Column, pos: Column, hashed: Column) -> Column:
        k1, k2 = _key(F.trim(line))
        found = F.get(hashed, F.pmod(k1, F.lit(slots)).cast("int"))
        return F.when(F.array_contains(found, F.struct(k1.alias("k1"), k2.alias("k2"))), pos)

    looked_up = rows.withColumns({"parts": F.split("text", "\n"), "hashed": _hashed(keys, slots).scalar()})
    numbers = F.transform("parts", lambda line, pos: gone(line, pos, F.col("hashed")))
    return looked_up.withColumn("gone", F.filter(numbers, lambda k: k.isNotNull())).drop("hashed")


def _joined(rows: DataFrame, docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The same by joins: of all lines with the keys, and of the texts with the numbers of the lines that they lose."""
    lost = lines(docs).join(keys, ["k1", "k2"], "left_semi").groupBy("doc_id", "row_key").agg(F.collect_set("pos").alias("gone")).withColumnRenamed("doc_id", "of")
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    return keyed.join(lost, (F.col("key") == F.col("row_key")) & F.col("doc_id").eqNullSafe(F.col("of")), "left").withColumn("parts", F.split("text", "\n"))


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, text without the lines on at least `min_sites` sites.

    Lines are compared without spaces at their ends; blank lines are counted and never removed. Null text stays null with
    no lines; empty text is one blank line. A null source counts for no site; a null doc_id is a document like any other.
    Repeated rows are cleaned alike. An empty table gives an empty result; other columns are ignored.
    """
    keys, _ = persist_table(boilerplate(lines(docs), min_sites), "boilerplate")
    rows, n = narrow(docs, doc_id="long", text="string"), keys.count()
    marked = _sent(rows, keys, n) if n <= SENT_KEYS else _joined(rows, docs, keys)
    # a column of its own, so that it is made once for a row and not for every line
    marked = marked.withColumn("cut", F.array_sort(F.coalesce("gone", F.array().cast("array<int>"))))
    # the lines between one that goes and the next, as whole slices: a document's work grows with its lines
    before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get("cut", k - 1))
    after = lambda k: F.coalesce(F.get("cut", k), F.size("parts"))
    between = F.transform(F.sequence(F.lit(0), F.size("cut")), lambda k: F.slice("parts", before(k) + 2, after(k) - before(k) - 1))
    return marked.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size("parts")).cast("long").alias("n_lines"),
        F.size("cut").cast("long").alias("n_removed"),
        F.when(F.size("cut") == 0, F.col("text")).otherwise(F.array_join(F.flatten(between), "\n")).alias("text"),
    )
