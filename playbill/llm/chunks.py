"""Operator 6: substring deduplication by content-defined chunks.

A gear hash rolls over the UTF-8 bytes: every byte adds its table value and older bytes are shifted out after 16 steps, so a
cut depends on the last 16 bytes only and an insertion moves no cut but those near it. Chunks are compared by a 96-bit
digest. A chunk that an earlier document (by doc_id) holds too is a repeat; a passage is a run of neighbouring repeats of at
least `RUN_WORDS` words that one earlier document holds. What only repeats within one document is left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import NO_ID, join_groups, map_batches, narrow, persist_table, text_bytes

#: A cut is sought after so many bytes, stands every so many bytes on average after that, and is forced at the last figure.
LEAST, MEAN, MOST = 8, 32, 1024
#: Words of a run of repeated chunks that make it a repeated passage.
RUN_WORDS = 18
#: A document: its id (NO_ID for none), and a hash of its text, as ids may repeat.
UNIT = ("doc_id", "h")


def _gear() -> np.ndarray:
    """The 256 values of the gear table, from a fixed rule."""
    raw = b"".join(hashlib.blake2b(bytes([b]), digest_size=2, person=b"gear table").digest() for b in range(256))
    return np.frombuffer(raw, "<u2")


_GEAR = _gear()
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ends of chunks, over texts laid end to end; `starts` has each text's start and the end of the last.

    A text's own ends are cuts, and no cut falls inside a character.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    h = np.zeros(len(data), np.uint16)
    value = _GEAR[data]
    for back in range(min(16, len(data))):
        h[back:] += value[: len(value) - back] << np.uint16(back)
    ready = np.flatnonzero(h < 65536 // MEAN) + 1
    # windows that reach back into the text before are not this text's: drop what is within 16 bytes of a start
    ready = ready[ready - starts[np.searchsorted(starts, ready - 1, side="right") - 1] >= 16]
    ready = ready[ready < len(data)]
    while (inside := (data[ready] & 0xC0) == 0x80).any():  # to the end of the character
        ready = ready + inside
        ready = ready[ready < len(data)]
    ready = ready.tolist()
    out, k, n = [], 0, len(ready)
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
        at = lo
        while k < n and ready[k] <= lo:
            k += 1
        while k < n and ready[k] < hi:
            cut = ready[k]
            while cut - at > MOST:
                at = _whole(data, at + MOST)
                out.append(at)
            if cut - at >= LEAST:
                out.append(cut)
                at = cut
            k += 1
        while hi - at > MOST:
            at = _whole(data, at + MOST)
            out.append(at)
        if hi > at:
            out.append(hi)
    return np.array(out, np.int64)


def _whole(data: np.ndarray, at: int) -> int:
    while at > 0 and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def chunks(docs: DataFrame) -> DataFrame:
    """UNIT, start, end (code points), words, d1, d2 (digest) of every chunk of every text."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        data, starts = text_bytes(rows.column("text"))
        ends = cuts(data, starts)
        if not len(ends):
            return None
        begins = np.concatenate(([0], ends[:-1]))
        row = np.searchsorted(starts, begins, side="right") - 1
        raw = data.tobytes()
        digest = hashlib.blake2b
        keys = b"".join([digest(raw[a:b], digest_size=12).digest() for a, b in zip(begins.tolist(), ends.tolist())])
        keys = np.frombuffer(keys, np.dtype([("d1", "<i8"), ("d2", "<i4")]))
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        blank = _BLANK[data]
        first = ~blank & np.concatenate(([True], blank[:-1]))
        first[starts[:-1][starts[:-1] < len(data)]] |= ~blank[starts[:-1][starts[:-1] < len(data)]]
        words = np.concatenate(([0], np.cumsum(first)))
        return pa.record_batch(
            [
                *(rows.column(c).take(pa.array(row)) for c in UNIT),
                pa.array((chars[begins] - chars[starts[row]]).astype(np.int32)),
                pa.array((chars[ends] - chars[starts[row]]).astype(np.int32)),
                pa.array((words[ends] - words[begins]).astype(np.int32)),
                pa.array(keys["d1"]),
                pa.array(keys["d2"]),
            ],
            names=[*UNIT, "start", "end", "words", "d1", "d2"],
        )

    rows = narrow(docs, doc_id="long", text="string").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.hash("text").alias("h"), "text")
    return map_batches(rows, batch, "doc_id long, h int, start int, end int, words int, d1 long, d2 int")


def _near_firsts(held: DataFrame) -> DataFrame:
    """For each repeated chunk the first documents of the neighbouring runs, where those begin later than its own first one.

    In a passage of document A, a chunk that also occurs in a still earlier document has that one as its first. Whether A holds
    it too is then to be asked: at most two questions for a chunk.
    """
    place = Window.partitionBy(*UNIT).orderBy("start")
    # running values in either direction: a frame that ends at the last row would be gone through again for each row
    back = place.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*UNIT).orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, 0)
    begins = F.coalesce((F.lag("end").over(place) != F.col("start")) | (F.lag("first").over(place) != F.col("first")), F.lit(True))
    ends = F.coalesce((F.lead("start").over(place) != F.col("end")) | (F.lead("first").over(place) != F.col("first")), F.lit(True))
    # of the neighbours only those that touch
    before = F.when(F.lag("end").over(place) == F.col("start"), F.lag("first").over(place))
    after = F.when(F.lead("start").over(place) == F.col("end"), F.lead("first").over(place))
    # a struct around the value tells a run without a neighbour from a chunk inside a run
    marked = held.withColumns({"_b": F.when(begins, F.struct(before.alias("x"))), "_a": F.when(ends, F.struct(after.alias("x")))})
    marked = marked.withColumns({"_b": F.last("_b", ignorenulls=True).over(back)["x"], "_a": F.last("_a", ignorenulls=True).over(ahead)["x"]})
    asked = marked.withColumn("source", F.explode(F.array_distinct(F.array("_b", "_a")))).drop("_b", "_a")
    return asked.where((F.col("source") > F.col("first")) & (F.col("source") < _unit()))


def _unit() -> Column:
    return F.struct(*UNIT)


def repeats(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """One row per repeated passage: doc_id, start, end (code points, end exclusive), words, chunks, first_doc_id.

    first_doc_id is an earlier document that holds the whole passage; a document has no row for what it is the first to hold.
    Passages may overlap, but none lies in another. Null and empty texts have no chunks. A document without an id comes after
    all others, by the hash of its text, and so do different texts with one id among themselves; rows with equal id and text
    are one document. An empty table gives an empty result; other columns are ignored.
    """
    return _repeats(docs, run_words).select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "start", "end", "words", "chunks", F.nullif("source.doc_id", F.lit(NO_ID)).alias("first_doc_id"))


def _repeats(docs: DataFrame, run_words: int) -> DataFrame:
    found, _ = persist_table(chunks(docs), "chunks")
    digest = ["d1", "d2"]
    spread = found.groupBy(*digest).agg(F.min(_unit()).alias("first"), F.max(_unit()).alias("last"), F.count("*").alias("n"))
    spread, _ = persist_table(spread.where("first < last").drop("last"), "spread")
    held = join_groups(found, spread, digest, "n", found.count()).select(*UNIT, "start", "end", "words", "d1", "first").distinct()
    held, _ = persist_table(held, "held")
    asked, _ = persist_table(_near_firsts(held), "asked")
    key = ["a_doc", "a_h", "d1"]
    asked = asked.select("*", F.col("source.doc_id").alias("a_doc"), F.col("source.h").alias("a_h"))
    holders = held.select(F.col("doc_id").alias("a_doc"), F.col("h").alias("a_h"), "d1").distinct()
    answered = asked.groupBy(*key).agg(F.count("*").alias("n")).join(holders, key, "left_semi")
    chunk = [*UNIT, "start", "end", "words", "source"]
    more = join_groups(asked, answered, key, "n", asked.count()).select(*chunk)
    own = held.where(F.col("first") < _unit()).withColumnRenamed("first", "source").select(*chunk)
    # runs of neighbouring chunks of one document from one source; as many rows as it has chunks, times three, at most
    place = Window.partitionBy(*UNIT, "source").orderBy("start")
    fresh = own.unionByName(more).withColumn("fresh", F.coalesce((F.lag("end").over(place) != F.col("start")).cast("int"), F.lit(1)))
    runs = fresh.withColumn("run", F.sum("fresh").over(place)).groupBy(*UNIT, "source", "run").agg(
        F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), F.sum("words").alias("words"), F.count("*").alias("chunks")
    )
    wide = Window.partitionBy(*UNIT).orderBy("start", F.desc("end"), "source").rowsBetween(Window.unboundedPreceding, -1)
    return runs.where(F.col("words") >= run_words).withColumn("reach", F.max("end").over(wide)).where("reach is null or end > reach")


def drop_repeats(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """All documents, without their repeated passages; other columns as they were."""
    spans = _repeats(docs, run_words).groupBy(*UNIT).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cut")).withColumnsRenamed({"doc_id": "_of", "h": "_h"})
    text, cut = docs["text"], spans["_cut"]
    joined = docs.join(spans, (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == spans["_of"]) & (F.hash(text) == spans["_h"]), "left")
    # what stands between the cut spans, which may overlap
    piece = lambda at, to: F.substr(text, (at + 1).cast("int"), F.greatest(to - at, F.lit(0)).cast("int"))
    kept = F.aggregate(
        cut,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(F.concat(acc["out"], piece(acc["at"], s["start"])).alias("out"), F.greatest(acc["at"], s["end"]).alias("at")),
        lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"))),
    )
    cleaned = F.when(cut.isNull(), text).otherwise(kept)
    return joined.select(*[cleaned.alias(c) if c == "text" else docs[c] for c in docs.columns])
