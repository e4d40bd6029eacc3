"""What the operators of this subpackage share: Arrow batch helpers, stable samples, decisions about single rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import remove as drop_table
from ..scratch import release, step
from ..scratch import stored as persist_table

__all__ = ["drop_table", "persist_table", "release", "step"]

#: Rows, and bytes of text, that a function works on at once; a longer text is a piece of its own.
PIECE_ROWS, PIECE_BYTES = 512, 4 << 20
#: Groups with more than one row of so many are hot; there can only be as many hot groups as this figure.
HOT_GROUPS = 10_000
#: Stands for a null doc_id among winners: larger than any id.
NO_ID = 2**63 - 1


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast; extra columns, whatever their names, never reach an operator."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])


# -- batches --------------------------------------------------------------------------------------------------------


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most PIECE_ROWS rows and PIECE_BYTES of the text column, if there is one."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.zeros(n + 1, np.int64)
        if text in batch.schema.names:
            _, size = text_bytes(batch.column(text))
        at = 0
        while at < n:
            end = int(np.searchsorted(size, size[at] + PIECE_BYTES, side="right")) - 1
            end = min(n, at + PIECE_ROWS, max(end, at + 1))
            yield batch.slice(at, end - at)
            at = end


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """mapInArrow over one piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            if (out := fn(piece)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and each row's start (one more at the end); null is empty."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    starts = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[starts[0] : starts[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, starts - starts[0]


# -- samples --------------------------------------------------------------------------------------------------------


def lot(salt: str, *columns: str) -> Column:
    """A number from 0 to 2**30 - 1 by a hash: the same for a row at every run and partitioning."""
    return F.pmod(F.xxhash64(F.lit(salt), *columns), F.lit(1 << 30))


def sampled(rows: DataFrame, bound: int, salt: str, *columns: str) -> DataFrame:
    """About `bound` rows, with the column `lot`: those below a threshold on a hash of the columns. Needs no shuffle.

    Rows that agree in the columns are in or out together, so the caller still has to cut at the bound, by `lot`.
    """
    n = rows.count()
    # a little more than the bound, so that the cut leaves as many
    least = 1 << 30 if n <= bound else (1 << 30) * min(n, bound + 4 * int(bound**0.5) + 4) // n
    return rows.withColumn("lot", lot(salt, *columns)).where(F.col("lot") < least)


# -- groups ---------------------------------------------------------------------------------------------------------


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """rows joined to one row per group, by `key`; `size` is a group's number of rows, `total` that of all.

    Groups with more than total / HOT_GROUPS rows are at most HOT_GROUPS: they are sent to the rows, which so stay where they
    are. The rest is small groups, which a shuffle deals evenly. `rows` is read twice, so it should be a written table.
    """
    hot = F.broadcast(groups.where(F.col(size) * HOT_GROUPS > total))
    small = groups.where(F.col(size) * HOT_GROUPS <= total)
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(small, key))


# -- decisions about single rows ------------------------------------------------------------------------------------

ROW = ("row_id", "row_h1", "row_h2")


def row_key(docs: DataFrame) -> list[Column]:
    """A row's own key: its id and 96 bits of hashes of all its columns. Only rows that are equal throughout share one.

    A null id is NO_ID. Columns that cannot be hashed (maps) are left out of the hashes.
    """
    parts = [F.col(f"`{f.name}`") for f in docs.schema if not _holds_map(f.dataType)]
    # null and empty must differ, so every column is followed by whether it is there
    parts = [x for c in parts for x in (c, c.isNull())]
    values = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(*parts), F.hash(F.lit("row"), *parts))
    return [v.alias(n) for v, n in zip(values, ROW)]


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType))


def drop_keys(keyed: DataFrame, names: list[str], gone: DataFrame) -> DataFrame:
    """The rows whose key is not in `gone`, a written table of distinct keys and `n`, the number of rows of each.

    The keys of very many rows are sent to the rows, which are then gone before a shuffle could put them together.
    """
    total = gone.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") * HOT_GROUPS > total
    return keyed.join(F.broadcast(gone.where(hot)), names, "left_anti").join(gone.where(~hot), names, "left_anti")


def keep_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents that stay, all columns as they were.

    `rows`: one row per document: ROW and `stays`, equal for equal keys. Of several rows that are equal throughout one stays.
    Only keys are aggregated; the documents meet the keys of those that go.
    """
    verdict = rows.groupBy(*ROW).agg(F.first("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1")
    verdict, _ = persist_table(verdict, "verdict")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *row_key(docs))
    left = drop_keys(keyed, list(ROW), verdict.where("not stays"))
    again = verdict.where("stays").select(*ROW)
    if not again.isEmpty():
        once = left.join(again, list(ROW), "left_semi").groupBy(*ROW).agg(F.first("doc").alias("doc"))
        left = left.join(again, list(ROW), "left_anti").select(*ROW, "doc").unionByName(once)
    return left.select("doc.*")
