"""Operator 5: benchmark decontamination by greedy string tiling.

Tokens are lower-cased words without ASCII punctuation. Every run of `SEED` tokens of a benchmark item is a seed. One scan of
the documents hashes all their runs; a Bloom filter of the seeds lets through those that may be one, as (text, seed, place),
and these are joined to the items by the seed. No tile can lie outside what is joined. Each pair of text and item is then
tiled by running Karp-Rabin: the longest matches of tokens that are not yet marked are marked first, then shorter ones, down
to the seed's length. A document is contaminated if the tiles cover at least `COVERAGE` of some item, in whatever order they
stand.

Only seeds are shuffled, never texts, and nothing of the benchmark's size passes through the driver but the filter, whose size
is bounded: a larger benchmark lets more runs through, which the join then drops.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import drop_keys, join_groups, narrow, persist_table, pieces, text_bytes

#: Tokens of a seed, which is also the shortest tile.
SEED = 5
#: Share of an item's tokens that must be covered.
COVERAGE = 0.5
#: Bits of the filter for each seed, and in all at most (as a power of two: 64 MB).
FILTER_BITS, FILTER_MOST = 64, 29

# ASCII letters, digits and all bytes beyond ASCII make tokens; the rest parts them
_WORD = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
_PARTING = bytes(b if _WORD[b] else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """The tokens of a text, lower-cased character by character."""
    return pc.utf8_lower(pa.scalar(text or "")).as_py().encode().translate(_PARTING).split()


# -- tiling ---------------------------------------------------------------------------------------------------------

_BASE, _MOD = 1_000_003, (1 << 61) - 1


def _runs(marked: list[bool]) -> Iterator[tuple[int, int]]:
    """Stretches without marks."""
    start = None
    for k, m in enumerate(marked):
        if m and start is not None:
            yield start, k
            start = None
        elif not m and start is None:
            start = k
    if start is not None:
        yield start, len(marked)


def _hashes(row: list[int], spans: list[tuple[int, int]], size: int) -> Iterator[tuple[int, int]]:
    """(place, hash) of every run of `size` within the spans, by a rolling hash."""
    lead = pow(_BASE, size - 1, _MOD)
    for a, b in spans:
        if b - a < size:
            continue
        h = 0
        for x in row[a : a + size]:
            h = (h * _BASE + x + 1) % _MOD
        yield a, h
        for k in range(a + size, b):
            h = ((h - (row[k - size] + 1) * lead) * _BASE + row[k] + 1) % _MOD
            yield k - size + 1, h


def tile(item: list[int], doc: list[int], least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in doc, length): repeatedly the longest match of unmarked tokens, at least `least` long.

    Of equally long matches the first in the item, then in the document, is taken. Both are lists of token numbers.
    """
    tiles: list[tuple[int, int, int]] = []
    in_item, in_doc = [False] * len(item), [False] * len(doc)
    size = min(len(item), len(doc))
    while size >= least:
        free, there = list(_runs(in_item)), list(_runs(in_doc))
        size = min(size, max((b - a for a, b in free), default=0), max((b - a for a, b in there), default=0))
        if size < least:
            break
        places: dict[int, deque[int]] = {}
        for k, h in _hashes(doc, there, size):
            places.setdefault(h, deque()).append(k)
        before = len(tiles)
        for i, h in _hashes(item, free, size):
            # this round's tiles are all `size` long, so one that overlaps a place covers one of its ends
            if in_item[i] or in_item[i + size - 1] or not (queue := places.get(h)):
                continue
            while queue and (in_doc[queue[0]] or in_doc[queue[0] + size - 1]):
                queue.popleft()  # marks stay, so no later place of the item can use it
            j = next((j for j in queue if not (in_doc[j] or in_doc[j + size - 1]) and item[i : i + size] == doc[j : j + size]), None)
            if j is not None:
                in_item[i : i + size] = in_doc[j : j + size] = [True] * size
                tiles.append((i, j, size))
        size = size - 1 if len(tiles) > before else _next_size(item, doc, free, there, least, size)
    return tiles


def _next_size(item: list[int], doc: list[int], free: list[tuple[int, int]], there: list[tuple[int, int]], least: int, above: int) -> int:
    """The length of the longest match of unmarked tokens, known to be below `above`: halving on hashes, as any part of a match matches."""
    low, high = least - 1, above
    while high - low > 1:
        mid = (low + high) // 2
        known = {h for _, h in _hashes(doc, there, mid)}
        if any(h in known for _, h in _hashes(item, free, mid)):
            low = mid
        else:
            high = mid
    return low


# -- seeds ----------------------------------------------------------------------------------------------------------


def _table() -> np.ndarray:
    """A 64-bit value for every byte, from a fixed rule."""
    return np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8, person=b"token").digest() for b in range(256)), "<u8")


_VALUE, _STEP = _table(), np.uint64(0x9E3779B97F4A7C15)


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every token of many texts, and each text's first token (one more at the end)."""
    data, starts = text_bytes(pc.utf8_lower(column))
    word = _WORD[data]
    first = word & np.concatenate(([True], ~word[:-1])) if len(word) else word
    heads = starts[:-1][starts[:-1] < len(data)]
    first[heads] = word[heads]  # no token goes on in the next text
    begin, at = np.flatnonzero(first), np.flatnonzero(word)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    head = np.searchsorted(at, begin)
    place = at - np.repeat(begin, np.diff(np.append(head, len(at))))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(place.max()) + 1, _STEP))
        h = np.add.reduceat(_VALUE[data[at]] * power[place], head)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32)), np.searchsorted(begin, starts)


def run_hashes(hashes: np.ndarray, places: np.ndarray, size: int, salt: int) -> np.ndarray:
    """The 64-bit hash of the run of `size` tokens at every place."""
    with np.errstate(over="ignore"):
        x = np.full(len(places), (size * 0x9E3779B97F4A7C15 + salt * 0xD6E8FEB86659FD93) % 2**64, np.uint64)
        for k in range(size):
            x = (x ^ hashes[places + k]) * np.uint64(0xFF51AFD7ED558CCD)
            x ^= x >> np.uint64(32)
    return x


def run_places(starts: np.ndarray, size: int) -> np.ndarray:
    """The places where a run of `size` tokens lies within one text."""
    n = int(starts[-1])
    inside = np.arange(n) <= n - size
    for back in range(1, size):
        at = starts[1:-1] - back
        inside[at[at >= 0]] = False
    return np.flatnonzero(inside)


#: Places of a hash in the filter.
LOOKS = 4


def _bit(h: np.ndarray, look: int, log: int) -> np.ndarray:
    """One of the places of a hash in a filter of 2**log bits."""
    with np.errstate(over="ignore"):
        return (h + np.uint64(look) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64((1 << log) - 1)


def item_seeds(items: DataFrame, least: int) -> DataFrame:
    """(item, n, words, h, c) of distinct texts (item, text): number of tokens, the tokens, and every seed's two hashes.

    An item with fewer tokens than a seed is its own seed; one without tokens has no row.
    """

    def run(batches):
        for rows in pieces(batches):
            hashes, starts = token_hashes(rows.column("text"))
            out = []
            for item, text, lo, hi in zip(rows.column("item").to_pylist(), rows.column("text").to_pylist(), starts[:-1], starts[1:]):
                if n := int(hi - lo):
                    size = min(least, n)
                    at = np.arange(lo, hi - size + 1)
                    h, c = (run_hashes(hashes, at, size, salt) for salt in (0, 1))
                    out.append((item, n, b" ".join(tokens(text)).decode(), h.view(np.int64), (c >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            if out:
                types = (pa.binary(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["item", "n", "words", "h", "c"])

    return items.mapInArrow(run, "item binary, n int, words string, h array<long>, c array<int>")


def seed_filter(seeds: DataFrame) -> tuple[bytes, int]:
    """The bits of a Bloom filter of the column h, and the logarithm of their number.

    The executors make whole words of it; the driver gets as many of them as the filter has, 64 MB at most.
    """
    log = min(FILTER_MOST, max(10, int(seeds.count() * FILTER_BITS - 1).bit_length()))

    def run(batches):
        for rows in (r for r in batches if r.num_rows):
            h = rows.column("h").to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([_bit(h, k, log) for k in range(LOOKS)]))
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            yield pa.record_batch([pa.array(word[first]), pa.array(np.bitwise_or.reduceat(bit, first).view(np.int64))], names=["word", "bits"])

    words = seeds.select("h").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (log - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.tobytes(), log


def document_seeds(docs: DataFrame, bits: bytes, log: int, sizes: list[int]) -> DataFrame:
    """(doc_id, key, h, c, at) of every document with runs that pass the filter: both hashes and the place of each.

    `docs`: doc_id, key, text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        words = np.frombuffer(shared.value, np.uint64)
        for rows in pieces(batches):
            hashes, starts = token_hashes(rows.column("text"))
            found = []
            for size in sizes:
                at = run_places(starts, size)
                h = run_hashes(hashes, at, size, 0)
                for look in range(LOOKS):
                    place = _bit(h, look, log)
                    there = (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                    at, h = at[there], h[there]
                found.append((at, h, run_hashes(hashes, at, size, 1)))
            at, h, c = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(at, kind="stable")
            at, h, c = at[order], h[order].view(np.int64), (c[order] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            ends = np.searchsorted(at, starts)
            own = np.flatnonzero(ends[1:] > ends[:-1])
            if len(own):
                cut = pa.array(np.append(ends[own], ends[-1]), pa.int32())  # rows without runs take no part of the lists
                place = (at - np.repeat(starts[own], ends[own + 1] - ends[own])).astype(np.int32)
                lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (h, c, place)]
                yield pa.record_batch([*(rows.column(x).take(pa.array(own)) for x in ("doc_id", "key")), *lists], names=["doc_id", "key", "h", "c", "at"])

    return docs.mapInArrow(run, "doc_id long, key binary, h array<long>, c array<int>, at array<int>")


# -- the search -----------------------------------------------------------------------------------------------------


def candidates(held: DataFrame, seeds: DataFrame, least: int, coverage: float) -> DataFrame:
    """Pairs (key, item) of texts and items that may be covered enough.

    `held`: (key, h, c, at); `seeds`: (item, n, h, c). Tiles that cover C tokens hold at least C / least seeds of the item, so
    an item's commonest seeds, fewer places than that, need not be joined: a seed that very many texts share makes no pairs
    unless the items consist of such seeds.
    """
    often = held.groupBy("h", "c").agg(F.count("*").alias("often"))
    need = F.greatest(F.lit(1), F.ceil(F.ceil(F.lit(coverage) * F.col("n")) / F.least(F.lit(least), F.col("n"))))
    places = seeds.groupBy("item", "n", "h", "c").agg(F.count("*").alias("places")).join(often, ["h", "c"])
    rarer = Window.partitionBy("item").orderBy(F.desc("often"), "h", "c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = places.withColumn("so_far", F.sum("places").over(rarer)).where(F.col("so_far") >= need).select("item", "h", "c")
    return held.select("key", "h", "c").distinct().join(asked, ["h", "c"]).select("key", "item").distinct()


TILES = "array<struct<item_at: int, doc_at: int, length: int>>"


def tiled(hits: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    """(key, item, n, covered, tiles) of the texts that cover an item enough. `items` as `item_seeds` makes them."""
    texts = hits.groupBy("key").agg(F.first(F.arrays_zip("h", "c", "at")).alias("x"))  # equal texts have equal runs
    held, _ = persist_table(texts.select("key", F.inline("x")), "held")
    seeds = items.select("item", "n", F.inline(F.arrays_zip("h", "c")))
    pairs = candidates(held, seeds, least, coverage)
    shared = pairs.join(seeds.select("item", "h", "c").distinct(), "item").join(held, ["key", "h", "c"])
    matched = shared.groupBy("key", "item").agg(F.collect_list(F.struct("at", "h")).alias("runs")).join(items.select("item", "n", "words", F.col("h").alias("own")), "item")

    def run(batches):
        kind = pa.list_(pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("length", pa.int32())]))
        for rows in batches:
            out = []
            for key, item, runs, words, own in zip(*(rows.column(c).to_pylist() for c in ("key", "item", "runs", "words", "own"))):
                number: dict[str, int] = {}
                row = [number.setdefault(w, len(number)) for w in words.split(" ")]
                size = len(row) - len(own) + 1
                doc, places = rebuilt(row, {h: i for i, h in enumerate(own)}, sorted((r["at"], r["h"]) for r in runs), size)
                tiles = [(i, places[j], k) for i, j, k in tile(row, doc, size)]
                covered = sum(k for _, _, k in tiles)
                if covered >= coverage * len(row):
                    out.append((key, item, len(row), covered, [{"item_at": i, "doc_at": j, "length": k} for i, j, k in tiles]))
            if out:
                types = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), kind)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["key", "item", "n", "covered", "tiles"])

    return matched.mapInArrow(run, f"key binary, item binary, n int, covered int, tiles {TILES}")


def rebuilt(item: list[int], where: dict[int, int], runs: list[tuple[int, int]], size: int) -> tuple[list[int], list[int]]:
    """The tokens of a text in the runs that it shares with an item, stretches parted by -1, and each token's place in the text.

    `where`: a place in the item for each seed; `runs`: (place in the text, seed), in order. No tile reaches beyond these runs.
    """
    doc: list[int] = []
    places: list[int] = []
    for at, h in runs:
        i = where[h]
        if places and at <= places[-1]:  # goes on where the last run is
            new = at + size - 1 - places[-1]
        else:
            new = size
            if places:
                doc.append(-1)
                places.append(-1)
        doc += item[i + size - new : i + size]
        places += range(at + size - new, at + size)
    return doc, places


def _search(docs: DataFrame, benchmark: DataFrame, least: int, coverage: float) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Hits, pairs that are covered enough, and distinct (item_id, item); None if no item has a token."""
    ids = narrow(benchmark, item_id="long", text="string").dropna(subset="text").withColumn("item", F.unhex(F.md5("text")))
    items, _ = persist_table(item_seeds(ids.groupBy("item").agg(F.first("text").alias("text")), least), "items")
    sizes = sorted(r["size"] for r in items.select(F.least(F.lit(least), "n").alias("size")).distinct().collect())  # as many as a seed's tokens at most
    if not sizes:
        return None
    bits, log = seed_filter(items.select(F.explode("h").alias("h")))
    keyed = narrow(docs, doc_id="long", text="string").select("doc_id", F.unhex(F.md5("text")).alias("key"), "text")
    hits, _ = persist_table(document_seeds(keyed, bits, log, sizes), "hits")
    found, _ = persist_table(tiled(hits, items, least, coverage), "tiled")
    return hits, found, ids.select("item_id", "item").distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, item_tokens, covered_tokens, coverage, n_tiles, tiles.

    Tiles are (item_at, doc_at, length) in tokens. An item of fewer tokens than a seed must occur as a whole. Null or empty
    texts, on either side, match nothing; items and documents without an id keep a null id. Repeated documents give repeated
    rows, and so do different texts with one item id; equal items count once. Empty tables give an empty result; other columns
    are ignored.
    """
    schema = f"doc_id long, item_id long, item_tokens int, covered_tokens int, coverage double, n_tiles int, tiles {TILES}"
    if (searched := _search(docs, benchmark, least, coverage)) is None:
        return docs.sparkSession.createDataFrame([], schema)
    hits, found, ids = searched
    named = found.join(ids, "item").select("key", F.struct("item_id", F.col("n").alias("item_tokens"), F.col("covered").alias("covered_tokens"), (F.col("covered") / F.col("n")).alias("coverage"), F.size("tiles").alias("n_tiles"), "tiles").alias("o"))
    rows = hits.select("doc_id", "key")
    groups = named.groupBy("key").agg(F.collect_list("o").alias("all")).join(rows.groupBy("key").agg(F.count("*").alias("rows")), "key")
    return join_groups(rows, groups, "key", "rows", rows.count()).select("doc_id", F.inline("all"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """The documents that cover no item, all columns as they were. What a text covers decides; ids play no part."""
    if (searched := _search(docs, benchmark, least, coverage)) is None:
        return docs
    hits, found, _ = searched
    gone = found.select("key").distinct().join(hits.groupBy("key").agg(F.count("*").alias("n")), "key")
    gone, _ = persist_table(gone.select(F.col("key").alias("text_key"), "n"), "leaks")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.unhex(F.md5(F.col("text").cast("string"))).alias("text_key"))
    return drop_keys(keyed, ["text_key"], gone).select("doc.*")
