"""Operator 11: cohort retention by prefix sums that are searched at period boundaries.

Events of one client and instant are one row with their cents added up. Each client's rows are dealt into chunks, so that a client with
a third of all events is many tasks; in a chunk they are sorted by time, with running sums of cents. For each period in
which anything happened the boundaries start + k * period are searched in the sorted times: the difference of the running sums
between two boundaries is what the period earned. Chunks' sums are added per client and period, clients are
added up in cells. Two states of knowledge are held side by side: what had arrived before a day, and everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import join_groups, persist_table

#: Rows of a client that one chunk holds, about.
CHUNK = 2_000
#: Rows that a task gathers before it searches them.
BATCH = 200_000
DAY = 86_400_000_000
#: Cents beyond these are taken for a broken value and count as nothing.
MOST_CENTS = 9 * 10**15


def micros(ts: Column) -> Column:
    """Microseconds from 1970-01-01 00:00 on the clock that the timestamp shows, in whatever zone."""
    day = F.unix_date(F.to_date(ts)).cast("long") * 86400
    return (day + F.hour(ts) * 3600 + F.minute(ts) * 60) * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def cents(value: Column) -> Column:
    """floor(100 * value + 0.5); nothing for null, NaN or values beyond MOST_CENTS."""
    amount = F.floor(100 * value + 0.5)
    return F.when(F.abs(100 * value) <= MOST_CENTS, amount).otherwise(0).cast("long")


def crc(number: Column) -> Column:
    return F.crc32(number.cast("string").cast("binary"))


def instants(clicks: DataFrame, cutoff: Column, kind: str, late: Column) -> DataFrame:
    """(client_id, t, early, cents, start): one row per client, instant and whether it was known before the cutoff."""
    names = ("click_id", "ts", "arrived_at", "client_id", "kind", "value", "props")
    rows = clicks.select(*names).where("ts is not null and client_id is not null").distinct()
    known = micros(F.col("arrived_at")) + F.coalesce(late, F.lit(0)) * DAY
    rows = rows.select(
        F.col("client_id").cast("long").alias("client_id"), micros(F.col("ts")).alias("t"), F.coalesce(known < micros(cutoff), F.lit(False)).alias("early"),
        cents(F.col("value").cast("double")).alias("cents"), F.coalesce(F.col("kind") == kind, F.lit(False)).alias("start"),
    )
    return rows.groupBy("client_id", "t", "early").agg(F.sum("cents").alias("cents"), F.max("start").alias("start"))


def starts(rows: DataFrame, clients: DataFrame) -> DataFrame:
    """(client_id, start0, start1, rows, segment) of clients that have a start; of several rows of a client the least segment."""
    when = lambda known: F.min(F.when(known, F.col("t")))
    found = rows.groupBy("client_id").agg(when(F.col("start") & F.col("early")).alias("start0"), when(F.col("start")).alias("start1"), F.count("*").alias("rows"))
    segments = clients.select(F.col("client_id").cast("long").alias("client_id"), F.col("segment").cast("string").alias("segment")).where("client_id is not null")
    segments = segments.groupBy("client_id").agg(F.min("segment").alias("segment"))
    return found.where("start1 is not null").join(segments, "client_id", "left").withColumn("segment", F.coalesce("segment", F.lit("")))


def occupied(t: np.ndarray, run: np.ndarray, start: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """The periods with events from `start` on, and their cents: `run` are the running sums of cents over the sorted times."""
    k = np.unique((t[np.searchsorted(t, start) :] - start) // period)
    lo, hi = np.searchsorted(t, start + k * period), np.searchsorted(t, start + (k + 1) * period)
    return k, run[hi] - run[lo]


def _search(period: int):
    """mapInArrow body over rows sorted by client, chunk, late and t: (state, client_id, period, cents) of each chunk."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        client, chunk, t, late, money = (rows.column(c).to_numpy() for c in ("client_id", "chunk", "t", "late", "cents"))
        begin = [rows.column(c).to_numpy() for c in ("start0", "start1")]
        edge = np.flatnonzero(np.concatenate(([True], (client[1:] != client[:-1]) | (chunk[1:] != chunk[:-1]) | (late[1:] != late[:-1])))).tolist()
        out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for a, b in zip(edge, [*edge[1:], len(t)]):
            times, run = t[a:b], np.concatenate(([0], np.cumsum(money[a:b])))
            for state in (0, 1):
                # what arrived late is known in state 1 alone; no start: no rows
                if begin[state][a] != NEVER and not (late[a] and state == 0):
                    out.append((state, client[a], *occupied(times, run, int(begin[state][a]), period)))
        many = [len(x[2]) for x in out]
        head = [np.repeat(np.array([x[i] for x in out], k), many) for i, k in ((0, np.int32), (1, np.int64))]
        tail = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in (2, 3)]
        return pa.record_batch([*map(pa.array, head), *map(pa.array, tail)], names=["state", "client_id", "period", "cents"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in (b for b in batches if b.num_rows):
            held.append(batch)
            n += batch.num_rows
            if n >= BATCH:  # a chunk that goes on in the next batch is two chunks: sums are added later
                yield solve(pa.Table.from_batches(held).combine_chunks())
                held, n = [], 0
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return run


#: Stands for a start that there is not.
NEVER = -(2**63)


def retention(clicks: DataFrame, clients: DataFrame, cutoff: str = "2024-02-15 00:00:00", kind: str = "signup", cohort_days: int = 1, period_days: int = 1, late: Column | None = None) -> DataFrame:
    """One row per nonempty cell: state, segment, cohort, period, users, users_crc32, moved, cents.

    `clicks`: click_id, ts, arrived_at, client_id, kind, value, props. Rows equal in all of these count once; those without ts or
    client_id go. State 0 knows what arrived before `cutoff` (a null arrived_at did not), state 1 everything; `late` are
    days by which an event's arrival is put off. A client starts with its earliest known event of `kind`; clients without one
    have no cells. cohort: floor(start's day / cohort_days); period: floor((ts - start) / period_days), to the microsecond. All known
    events from the start on count, of whatever kind, those at the same instant too. `clients`: client_id, segment (null or
    no such client: ''; of repeated rows the least). moved: users whose cohorts of the two states differ. cents: see `cents`.
    An empty table of clicks gives an empty result; other columns are ignored.
    """
    rows, _ = persist_table(instants(clicks, F.lit(cutoff).cast("timestamp_ntz"), kind, F.lit(0) if late is None else late), "instants")
    begun, _ = persist_table(starts(rows, clients), "starts")
    key = begun.select("client_id", F.coalesce("start0", F.lit(NEVER)).alias("start0"), "start1", F.ceil(F.col("rows") / CHUNK).alias("chunks"), "rows")
    told = join_groups(rows.select("client_id", "t", "early", "cents"), key, "client_id", "rows", rows.count())
    told = told.where("t >= start1")  # the earlier of the two starts
    chunk = F.pmod(F.xxhash64("t", "early"), "chunks").cast("int").alias("chunk")
    told = told.select("client_id", "t", (~F.col("early")).alias("late"), "cents", "start0", "start1", chunk)
    told = told.repartition("client_id", "chunk").sortWithinPartitions("client_id", "chunk", "late", "t")
    found = told.mapInArrow(_search(period_days * DAY), "state int, client_id long, period long, cents long")
    found = found.groupBy("state", "client_id", "period").agg(F.sum("cents").alias("cents"))
    cohort = lambda start: F.expr(f"({start} - pmod({start}, {cohort_days * DAY}L)) div {cohort_days * DAY}L")
    found = found.join(begun.select("client_id", "segment", cohort("start0").alias("c0"), cohort("start1").alias("c1")), "client_id")
    cell = found.select("state", "segment", F.when(F.col("state") == 0, F.col("c0")).otherwise(F.col("c1")).alias("cohort"), "period", "client_id", "cents", F.coalesce(F.col("c0") != F.col("c1"), F.lit(False)).alias("moved"))
    return cell.groupBy("state", "segment", "cohort", "period").agg(
        F.count("*").alias("users"), F.sum(crc(F.col("client_id"))).alias("users_crc32"), F.sum(F.col("moved").cast("long")).alias("moved"), F.sum("cents").alias("cents")
    )
