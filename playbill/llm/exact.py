"""Operator 8: exact deduplication against historical digests held in a minimal perfect hash.

Historical rows are reduced to distinct digests with the winner (least doc_id) and the number of rows. The digests are dealt
into shards by their leading bits; each shard becomes a minimal perfect hash (a cascade of bit arrays, ranked by running
popcounts) whose slots hold the full digest and the winner's locator. Incoming rows are reduced to distinct digests before
they are shuffled, looked up in their shard, and compared byte for byte with the slot. Members are repeats of the historical
winner. Nonmembers are grouped among themselves, which their reduction has already done. The decisions, one per distinct
digest, then go to the rows; stored, they are the history of the next run.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import NO_ID, ROW, join_groups, keep_rows, persist_table, row_key

#: Digests that a shard is planned to hold: about 70 bytes each, with the work space a few MB.
SHARD = 50_000
#: Width of the first bit array for each digest; larger is faster to build, smaller is denser.
GAMMA = 1.7
SPACES = r"[ \t-\r]+"
#: One row per distinct digest: the row that stays, how many rows there are, and whether the history held it.
DECISION = "digest binary, row_id long, row_h1 long, row_h2 int, group_size long, known boolean"


def normalised(text: Column) -> Column:
    """Each run of space, tab, line feed, vertical tab, form feed or carriage return becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests.

    Level k has a bit array; a digest that alone takes its place there keeps it, the others go on to level k + 1. A digest's
    slot is the rank of its bit over all levels: a running popcount of whole words, and of the bits before it in its word.
    About 1.5 bytes for each digest. `lookup` also answers for strangers, which the caller must compare.
    """

    def __init__(self, digests: np.ndarray) -> None:
        """digests: (n, 4) unsigned 64-bit words, distinct."""
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, base = digests, 0
        while len(left):
            size = max(64, int(GAMMA * len(left)))
            place = self._place(left, len(self.levels), size)
            alone = np.bincount(place, minlength=-(-size // 64) * 64) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.int32)
            self.levels.append((size, words, base + np.cumsum(ones, dtype=np.int32) - ones))
            base += int(ones.sum())
            left = left[~alone[place]]

    @staticmethod
    def _place(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        """A place for each digest; every level mixes all four words anew."""
        with np.errstate(over="ignore"):
            x = np.full(len(digests), 0x9E3779B97F4A7C15 * (2 * level + 1) % 2**64, np.uint64)
            for k in range(4):
                x = (x ^ digests[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
                x ^= x >> np.uint64(32)
        return (x % np.uint64(size)).astype(np.int64)

    def lookup(self, digests: np.ndarray) -> np.ndarray:
        """The slot of every digest that was built in; any slot or -1 for others."""
        slot = np.full(len(digests), -1, np.int64)
        rest = np.arange(len(digests))
        for level, (size, words, before) in enumerate(self.levels):
            place = self._place(digests[rest], level, size)
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            there = (words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            slot[rest[there]] = (before[word] + below)[there]
            rest = rest[~there]
        return slot


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4) if len(digests) else np.zeros((0, 4), np.uint64)


def _decide(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """One shard: historical digests (left), incoming distinct digests (right) → a decision for each distinct digest."""
    columns = ["digest", *ROW, "group_size"]
    right = right[[f"new_{c}" for c in columns]].set_axis(columns, axis=1)
    past, now = _words(left["digest"]), _words(right["digest"])
    table = PerfectHash(past)
    slots = left.iloc[np.argsort(table.lookup(past))].reset_index(drop=True)  # slot k: digest, winner, rows
    past = _words(slots["digest"])
    at = table.lookup(now)
    member = at >= 0
    member[member] = (past[at[member]] == now[member]).all(axis=1)
    hit, found = at[member], right[member]
    size, locator = slots["group_size"].to_numpy(np.int64, copy=True), slots[list(ROW)].to_numpy(np.int64, copy=True)
    size[hit] += found["group_size"].to_numpy()
    ours, theirs = locator[hit], found[list(ROW)].to_numpy(np.int64)
    apart = ours != theirs
    column = apart.argmax(axis=1)  # the first place where the two locators differ decides which is less
    rows = np.arange(len(hit))
    less = apart.any(axis=1) & (theirs[rows, column] < ours[rows, column])
    locator[hit[less]] = theirs[less]
    own = pd.DataFrame({"digest": slots["digest"], **{c: locator[:, k] for k, c in enumerate(ROW)}, "group_size": size, "known": True})
    return pd.concat([own, right[~member].assign(known=False)], ignore_index=True)


def reduced(rows: DataFrame) -> DataFrame:
    """Rows (digest, ROW) as one row per digest, as DECISION says."""
    winner = F.min(F.struct(*ROW)).alias("w")
    return rows.groupBy("digest").agg(winner, F.count("*").alias("group_size")).select("digest", "w.*", "group_size", F.lit(False).alias("known"))


def decisions(history: DataFrame, incoming: DataFrame, total: int) -> DataFrame:
    """What DECISION says for each distinct digest of both, which are reduced; `total` is about how many digests there are."""
    shards = max(1, -(-total // SHARD))
    # the leading 28 bits of the digest, scaled to the number of shards
    shard = lambda d: F.floor(F.conv(F.substring(F.hex(d), 1, 7), 16, 10).cast("long") * shards / F.lit(1 << 28)).cast("int")
    past = history.select("digest", *ROW, "group_size", shard("digest").alias("shard"))
    # both sides may come from one table: the second gets names, and so columns, of its own
    now = incoming.select(*[F.col(c).alias(f"new_{c}") for c in ("digest", *ROW, "group_size")])
    now = now.withColumn("new_shard", shard("new_digest"))
    return past.groupBy("shard").cogroup(now.groupBy("new_shard")).applyInPandas(_decide, DECISION)


def _judged(docs: DataFrame, history_share: float, history: DataFrame | None) -> DataFrame:
    """One row per document: ROW, digest, and of its group keep_id, keep_h1, keep_h2, group_size and known."""
    rows = docs.select(F.unhex(F.sha2(normalised(F.col("text").cast("string")), 256)).alias("digest"), *row_key(docs))
    rows, _ = persist_table(rows, "digests")
    total = rows.count()  # of footers
    if history is None:
        ends = rows.where(F.col("row_id") < NO_ID).agg(F.min("row_id").alias("lo"), F.max("row_id").alias("hi")).first()
        split = 0 if ends["lo"] is None else ends["lo"] + int((ends["hi"] - ends["lo"] + 1) * history_share)
        past, now = reduced(rows.where(F.col("row_id") < split)), reduced(rows.where(F.col("row_id") >= split))
        decided = decisions(past, now, total)
    else:
        decided = decisions(history, reduced(rows), total + history.count())
    decided, _ = persist_table(decided, "decisions")
    groups = decided.withColumnsRenamed({"row_id": "keep_id", "row_h1": "keep_h1", "row_h2": "keep_h2"})
    return join_groups(rows, groups, "digest", "group_size", total)


def exact_duplicates(docs: DataFrame, history_share: float = 0.5, history: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Of equal texts the row with the least doc_id stays. `history` is what an earlier `take_in` stored. Without one, the rows in
    the lower `history_share` of the range of doc_id stand for what was taken in earlier and form the perfect hash, and the
    others are looked up in it; the outcome is the same for any share. Null or empty texts are equal to each other. A null
    doc_id counts as the largest; such rows are never kept unless all copies lack an id, then keep_id is null and all are
    marked. Repeated rows with the kept doc_id are all marked as kept; `drop_duplicates` leaves one of them. An empty table
    gives an empty result; other columns are ignored.
    """
    judged = _judged(docs, history_share, history)
    return judged.select(
        F.nullif("row_id", F.lit(NO_ID)).alias("doc_id"), F.nullif("keep_id", F.lit(NO_ID)).alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def take_in(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """The history with the documents: one row per distinct digest, as DECISION says, to be stored for the next run."""
    new = reduced(docs.select(F.unhex(F.sha2(normalised(F.col("text").cast("string")), 256)).alias("digest"), *row_key(docs)))
    return new if history is None else decisions(history, new, history.count() + docs.count())


def drop_duplicates(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """The documents that stay, one for each text, all columns as they were.

    The least doc_id stays, a null one only where no copy has an id. Of rows with that id, or of rows without one, the least
    hash of the whole row stays, and of rows equal throughout one. Texts that `history` holds go.
    """
    judged = _judged(docs, 0.5, history)
    same = (F.col("row_id") == F.col("keep_id")) & (F.col("row_h1") == F.col("keep_h1")) & (F.col("row_h2") == F.col("keep_h2"))
    return keep_rows(docs, judged.select(*ROW, (same if history is None else same & ~F.col("known")).alias("stays")))
