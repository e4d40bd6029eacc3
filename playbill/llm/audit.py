"""Operator 13: how filters interact, for every order in which they may be applied.

Each document becomes a mask: bit k is set if it fails filter k. Masks are counted per part, so what is left of the corpus is
at most 32 rows for each part. A subset-zeta transform over the masks gives, for every set of filters, how many documents
survive all of them. What a step of an order keeps, removes or finds gone already are then differences between survivors of
neighbouring sets, and likewise for the labels; the orders are never applied to the documents.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import join_groups, persist_table

FILTERS = "ABCDE"
#: Bounds of the filters: words, percent of distinct words, percent of capitals.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("n", "good", "toxic")
REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def own_failures(text: Column) -> Column:
    """The bits of the filters that look at one text alone: A is 1, B 2, C 4, D 8."""

    def bits(words: Column) -> Column:
        n, distinct = F.size(words), F.size(F.array_distinct(words))
        capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
        fails = (n < MIN_WORDS, 100 * distinct.cast("long") < MIN_DISTINCT * n, 100 * capitals.cast("long") > MAX_CAPITALS * F.length(text), text.rlike(r"[#$%&*|]"))
        return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))

    # the words are bound once by the lambda, so the text is split once
    return F.transform(F.array(F.array_remove(F.split(text, r"[ \t-\r]+"), "")), bits)[0]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail.

    `docs`: doc_id, text (null: empty), lang (null: part ''). E fails if the same text has a smaller doc_id anywhere; a null
    doc_id is neither smaller nor larger than another, and repeated rows of one doc_id do not fail E for each other. `labels`:
    doc_id, quality, toxic; of several rows for one id any that says quality 1 (toxic 1) counts; ids that documents repeat are
    counted as often. Texts are compared by their SHA-256. Empty tables give no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), own_failures(text).alias("mask"))
    # equal rows are one row with a count, before anything is joined
    rows, _ = persist_table(rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n")), "masked")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    told = join_groups(rows, groups, "digest", "rows", rows.count())
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).cast("int").alias("good"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    marks = marks.where("doc_id is not null and (good = 1 or toxic = 1)").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    told = told.select("doc_id", "part", (F.col("mask") + F.when(again, 16).otherwise(0)).alias("mask"), "n").join(marks, "doc_id", "left")
    share = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
    return told.groupBy("part", "mask").agg(F.sum("n").alias("n"), share("good"), share("toxic"))


def survivors(by_mask: np.ndarray) -> np.ndarray:
    """Subset-zeta transform: entry S becomes the sum over all masks that share no filter with the set S."""
    out, sets = by_mask.copy(), np.arange(len(by_mask))
    for bit in (1 << k for k in range(len(by_mask).bit_length() - 1)):
        held = sets[sets & bit > 0]
        out[held] += out[held ^ bit]
    return out[::-1]  # entry U was the sum over the masks within U: the survivors of all filters outside U


def report(by_mask: np.ndarray, filters: str = FILTERS) -> list[tuple]:
    """Rows of REPORT without the part, for one part's counts (2 ** filters, COUNTS)."""
    left = survivors(by_mask)
    bit = {f: 1 << k for k, f in enumerate(filters)}
    everything = (1 << len(filters)) - 1
    rows, total = [], dict.fromkeys(filters, 0)
    for order in permutations(filters):
        gone = 0
        for step, f in enumerate(order, 1):
            lost = left[gone] - left[gone | bit[f]]
            fails = left[0] - left[bit[f]]
            alone = left[everything ^ bit[f]] - left[everything]
            gone |= bit[f]
            total[f] += int(lost[0])
            rows.append(("".join(order), step, int(left[gone][0]), int(lost[0]), int(fails[0] - lost[0]), int(alone[0]), int(lost[1]), int(lost[2])))
    return [(*row, total[row[0][row[1] - 1]]) for row in rows]


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """REPORT: one row for each part, order and step, zeros included. `counts`: what `masks` returns, one row per part and mask."""
    names = [f.split()[0] for f in REPORT.split(", ")]

    def solve(rows: pa.Table) -> pa.Table:
        table = np.zeros((1 << len(filters), len(COUNTS)), np.int64)
        table[rows.column("mask").to_numpy()] = np.stack([rows.column(c).to_numpy() for c in COUNTS], 1)
        part = rows.column("part")[0].as_py()
        out = [(part, *row) for row in report(table, filters)]
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return counts.groupBy("part").applyInArrow(solve, REPORT)
