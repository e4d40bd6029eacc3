"""Operator 4: best-fit packing into sequences of several permitted lengths.

Documents become pieces of at most the greatest length. Pieces are dealt into groups by a hash, each group is packed by one
task: longest first, into the open sequence with the least room that is enough. Where none is, a sequence is opened, and its
length is the one that promises the least cost for each token: for every permitted length the pieces still to come are laid
in greedily and the cost of the length that this content needs is divided by the tokens. At the end every sequence shrinks
to the least permitted length that holds its contents.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import narrow, persist_table, pieces

LENGTHS = (1024, 2048, 4096, 8192)
#: The cost of a sequence in tokens: its length, its square over this figure (attention), and a fixed part.
ATTENTION, OVERHEAD = 65536, 16
#: Pieces that one task packs, about.
GROUP = 20_000
#: One token after each document.
END = 1
# fixed value: the public vocabulary's own way to part words
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# what that pattern takes for white space, in runs on which its search would take long
_LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{32,}")


def counter(vocabulary: bytes) -> Callable[[str], int]:
    """Counts a text's tokens, as the public tokenizer's pattern and vocabulary make them.

    The pattern takes a run of white space as one word, but for its last character, which begins the next word if there is
    one. Its search goes back over a run from each of its characters and breaks on very long ones; longer runs are cut out here, by that rule, and
    encoded as the one word that they are.
    """
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    blank = tiktoken.Encoding("blank", pat_str=r"\s+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def count(text: str) -> int:
        n = at = 0
        for run in _LONG_BLANK.finditer(text):
            if run.start() > at:
                n += len(encode(text[at : run.start()]))
            at = run.end() if run.end() == len(text) else run.end() - 1
            n += len(blank(text[run.start() : at]))
        return n + len(encode(text[at:])) if at < len(text) else n

    return count


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens of every whole text, its end token included; null and empty texts have none.

    The vocabulary, a file of about 1 MB, is read on the driver and sent to the workers.
    """
    raw = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches):
        count = counter(raw.value)
        for rows in pieces(batches):
            n = [count(t) + END if t else 0 for t in rows.column("text").to_pylist()]
            yield pa.record_batch([rows.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return narrow(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_tokens long")


def cost(length: int) -> float:
    return length + length * length / ATTENTION + OVERHEAD


def pack_sizes(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int]]:
    """The sequence of every piece, and the length of every sequence.

    `sizes` descend, and none is above the greatest length.
    """
    lengths = tuple(sorted(set(lengths)))
    needs = lambda used: lengths[bisect_left(lengths, used)]
    negative = [-s for s in sizes]  # ascending, for bisect
    room: list[int] = []
    by_room: dict[int, list[int]] = {}
    free = 0  # bit r is set if an open sequence has room r
    where = []
    for k, size in enumerate(sizes):
        fit = free >> size
        if fit:
            r = (fit & -fit).bit_length() - 1 + size
            box = by_room[r].pop()
            if not by_room[r]:
                free &= ~(1 << r)
        else:
            best = None
            for length in lengths[bisect_left(lengths, size) :]:
                used, nxt = size, k + 1
                while (nxt := bisect_left(negative, used - length, nxt)) < len(sizes):  # the longest later piece that fits
                    used, nxt = used + sizes[nxt], nxt + 1
                price = cost(needs(used)) / used
                if best is None or price < best[0]:
                    best = price, length
            box, r = len(room), best[1]
            room.append(r)
        where.append(box)
        r -= size
        room[box] = r
        if r:
            by_room.setdefault(r, []).append(box)
            free |= 1 << r
    used = np.bincount(where, sizes, len(room)).astype(int) if sizes else []
    return where, [needs(int(u)) for u in used]


def pack(counts: DataFrame, lengths: tuple[int, ...] = LENGTHS, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, token_start, token_end, bin_id, bin_length, bin_offset.

    `counts`: doc_id, n_tokens. A document longer than the greatest length is cut into pieces of that length and a rest.
    Documents without tokens (null or empty texts, null counts) have one row without a bin. Repeated rows are packed as
    often as they occur; a null doc_id is packed like any other. Pieces are dealt by the hash of id and piece, and of a number
    among pieces of that id, so rows that share an id or have none are dealt too. An empty table gives an empty result.
    """
    top = max(lengths)
    # a number for every row: its partition, and its place in it; the written table keeps it from changing
    counts, _ = persist_table(narrow(counts, doc_id="long", n_tokens="long").withColumn("row", F.monotonically_increasing_id()), "counts")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_tokens") - 1, F.lit(0)), F.lit(top).cast("long"))
    cut = counts.where("n_tokens > 0").select("doc_id", "row", "n_tokens", F.posexplode(starts).alias("piece", "token_start"))
    cut = cut.select("doc_id", "row", "piece", "token_start", F.least(F.col("n_tokens"), F.col("token_start") + top).alias("token_end"))
    total = counts.agg(F.sum(F.ceil(F.col("n_tokens") / top))).first()[0] or 0
    groups = max(1, round(int(total) / group))
    cut = cut.withColumn("lot", F.pmod(F.xxhash64(F.lit("pack"), "row", "piece"), F.lit(groups)))

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(size=rows["token_end"] - rows["token_start"]).sort_values(["size", "doc_id", "piece", "row"], ascending=[False, True, True, True], ignore_index=True)
        where, length = pack_sizes(rows["size"].tolist(), lengths)
        rows["bin_id"] = int(key[0]) * (1 << 32) + np.array(where, np.int64)
        rows["bin_length"] = np.array(length, np.int64)[where]
        rows["bin_offset"] = rows.groupby("bin_id")["size"].cumsum() - rows["size"]
        return rows.drop(columns=["lot", "size", "row"])

    schema = "doc_id long, piece int, token_start long, token_end long, bin_id long, bin_length long, bin_offset long"
    packed = cut.groupBy("lot").applyInPandas(solve, schema)
    none = counts.where("coalesce(n_tokens, 0) <= 0").selectExpr("doc_id", "0 as piece", "0L as token_start", "0L as token_end", "cast(null as long) as bin_id", "cast(null as long) as bin_length", "cast(null as long) as bin_offset")
    return packed.unionByName(none)


def pack_documents(docs: DataFrame, vocabulary: str, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """Count tokens and pack: one row per piece, as `pack` says."""
    return pack(token_counts(docs, vocabulary), lengths)
