"""Operator 7 for similar texts: SimHash tries find candidates, exact Jaccard similarities of five-word shingles decide.

Texts at a Jaccard similarity of 0.8 differ in 15 % of the bits of their fingerprints: far too many of 64 bits to be told from
chance, and for tries led by equal bands. So a fingerprint has 256 bits here. Each trie orders bits by a permutation of its
own: texts that agree in the leading bits, its root, are walked against each other, node pair by node pair, and a pair is
dropped when its bits differ beyond the budget, which grows with the depth. What is left counts as a candidate if all bits
allow the similarity, with `DOUBT` standard errors to spare. A subtree with very many leaves is searched from pivots (see
`cover`), and one beyond `PART` is dealt into parts of which every two meet: no candidate is lost to its size.

Candidates only tie texts into groups. Within a group the shingles themselves decide: an exact prefix-filtered set join links
every pair at the threshold or above that is not linked already, and nothing below it. Texts outside groups, most of a corpus,
never move; a Bloom filter picks out the others. A group with very many shingles is dealt into parts of which every two meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .decontam import LOOKS, _bit, seed_filter
from .runtime import NO_ID, ROW, join_groups, keep_rows, map_batches, persist_table, pieces, row_key
from .simhash import forest, walk

#: Bits of a fingerprint, in words of 64; bits of a path after its root.
WORDS, DEEP = 4, 48
#: Leaves of a subtree on average, at most; the chance that no trie holds a pair at the threshold in one subtree.
CROWD, MISS = 256, 0.01
#: Standard errors that a budget leaves above the share of bits that may differ.
DOUBT = 3.0
#: Leaves of a subtree from which on it is searched from pivots; leaves of which one task searches all at once.
SUBTREE, PART = 512, 20_000
#: Leaves that a task gathers before it walks them; bytes that a task gathers at most, but for groups that are larger.
WALK, GATHER = 40_000, 64 << 20
#: Shingles of a group that one task compares, about.
PART_SHINGLES = 2_000_000


def shingles(text: str | None, words: int = 5, seed: int = 42) -> tuple[np.ndarray, int]:
    """The distinct shingles' XXH64, ascending, and a digest of all words: A-Z lower-cased, parted by ASCII white space."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64), 0
    joined, n = b" ".join(tokens), len(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: max(1, n - words + 1)].tolist(), ends[min(words, n) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(first, last)], np.uint64)), digest(joined, seed + 1)


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """The SimHash of a set of shingles: WORDS * 64 bits mixed from each one's hash; all zero for none."""
    votes = np.zeros(WORDS * 64, np.int64)
    salt = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 2048):
        with np.errstate(over="ignore"):
            x = hashes[at : at + 2048, None] ^ salt
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(31))).astype("<u8")
        votes += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes()


def apart(similarity: float) -> float:
    """The share of bits that differ at a Jaccard similarity, of texts of equal size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_bits(similarity: float, bits: int = WORDS * 64) -> int:
    """How many of so many bits a pair at the similarity differs in, with DOUBT standard errors to spare."""
    share = apart(similarity)
    return int(bits * share + DOUBT * math.sqrt(bits * share * (1 - share)))


def tries(leaves: int, similarity: float) -> list[np.ndarray]:
    """For each trie the bits of its path, its root's first, and nothing else."""
    root = max(0, math.ceil(math.log2(max(1, leaves) / CROWD)))
    hit = (1 - apart(similarity)) ** root
    many = 1 if hit == 1 else math.ceil(math.log(MISS) / math.log(1 - hit))
    return [np.random.default_rng(k).permutation(WORDS * 64)[: root + DEEP] for k in range(many)]


# -- candidates -----------------------------------------------------------------------------------------------------


def cover(full: np.ndarray, most: int) -> np.ndarray:
    """For each leaf (rows of words) the least leaf of its class, over all pairs that differ in at most `most` bits.

    A pivot is compared with all leaves and covers those near it; the next uncovered leaf is the next pivot. Pairs within the largest
    class need no more tests. Of any other pair one leaf lies outside that class: it was a pivot, or is compared with all now.
    So a dense subtree costs its leaves times its pivots, not its pairs.
    """
    n = len(full)
    root, covered, pivots = np.arange(n), np.zeros(n, bool), np.zeros(n, bool)

    def meet(p: int) -> None:
        near = np.flatnonzero(np.bitwise_count(full ^ full[p]).sum(axis=1) <= most)
        covered[near] = True
        labels = np.unique(root[near])
        if len(labels) > 1:
            root[np.isin(root, labels[1:])] = labels[0]

    for p in range(n):
        if not covered[p]:
            pivots[p] = True
            meet(p)
    largest = np.bincount(root).argmax()
    for p in np.flatnonzero((root != largest) & ~pivots).tolist():
        if root[p] != largest:
            meet(p)
    return root


def _bits(fps: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")


def _number(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as numbers, the first bit the highest."""
    return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(bits.shape[1] - 1, -1, -1, dtype=np.uint64))


def _keys(paths: list[np.ndarray], whole: bool):
    """mapInArrow body: a leaf for every trie: trie, root, and if `whole` its fp and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (r for r in batches if r.num_rows):
            bits = _bits(rows.column("fp").to_pylist())
            for k, path in enumerate(paths):
                cols = [pa.array(np.full(len(bits), k, np.int32)), pa.array(_number(bits[:, path[: len(path) - DEEP]]).astype(np.int64))]
                yield pa.record_batch([*cols, *([rows.column("fp"), rows.column("node")] if whole else [])], names=["trie", "root", "fp", "node"][: 4 if whole else 2])

    return run


def _groups(keys: tuple[str, ...], solve: Callable[[pa.Table], pa.RecordBatch | None], size: int):
    """mapInArrow body over sorted rows: `solve` gets about `size` rows at a time, or GATHER bytes, but always whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most, room = [], 0, size, GATHER
        for batch in (b for b in batches if b.num_rows):
            held.append(batch)
            n += batch.num_rows
            if n < most and sum(b.nbytes for b in held) < room:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([rows.column(c).to_numpy() for c in keys])
            at = int(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)).max(initial=-1)) + 1
            if at and (done := solve(rows.slice(0, at))) is not None:
                yield done
            held, n = rows.slice(at).to_batches(), rows.num_rows - at
            most, room = max(size, 2 * n), max(GATHER, 2 * sum(b.nbytes for b in held))  # a group that goes on is looked at again when it has doubled
        if held and (done := solve(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield done

    return run


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns begin a new group, and the number of rows."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), len(change))


def _walks(paths: list[np.ndarray], similarity: float):
    """mapInArrow body over leaves sorted by trie, root, p and q: links that tie what is near within subtrees."""
    most = most_bits(similarity)
    budget = [most_bits(similarity, d) for d in range(1, DEEP + 1)]

    def solve(rows: pa.Table) -> pa.RecordBatch | None:
        trie, root, p, q, node = (rows.column(c).to_numpy() for c in ("trie", "root", "p", "q", "node"))
        fps = rows.column("fp").to_pylist()
        full, deep = np.frombuffer(b"".join(fps), np.uint64).reshape(-1, WORDS), np.zeros(len(fps), np.uint64)
        bits = _bits(fps)
        for k in np.unique(trie):
            own = np.flatnonzero(trie == k)
            deep[own] = _number(bits[own][:, paths[k][-DEEP:]])
        order = np.lexsort((node, deep, q, p, root, trie))
        full, deep, node = full[order], deep[order], node[order]
        edge = _edges(*(c[order] for c in (trie, root, p, q)))
        lo, hi = edge[:-1], edge[1:]
        small = hi - lo <= SUBTREE
        groups = np.stack((lo, hi, lo, hi), 1)[small & (hi - lo > 1)]
        near = lambda i, j: np.bitwise_count(full[i] ^ full[j]).sum(axis=1) <= most
        least = forest(len(node), walk(deep << np.uint64(64 - DEEP), groups, budget, 0, near))
        for a, b in zip(lo[~small].tolist(), hi[~small].tolist()):
            least[a:b] = a + cover(full[a:b], most)
        linked = np.flatnonzero(least != np.arange(len(node)))
        return pa.record_batch([pa.array(node[linked]), pa.array(node[least[linked]])], names=["u", "v"]) if len(linked) else None

    return _groups(("trie", "root", "p", "q"), solve, WALK)


def _dealt(rows: DataFrame, parts: Column, key: Column) -> DataFrame:
    """Rows with p and q: dealt into `parts` by `key`, every row as often as its part meets another, or itself."""
    own = F.pmod(F.xxhash64(F.lit("part"), key), parts)
    other = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    return rows.select("*", own.alias("own"), other.alias("other")).withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")}).drop("own", "other")


def candidates(leaves: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Links (u, v) between the nodes of leaves (fp, node): they tie all that the tries find near, but u and v need not be."""
    paths = tries(leaves.count(), similarity)
    crowded = leaves.select("fp").mapInArrow(_keys(paths, False), "trie int, root long").groupBy("trie", "root").count().where(F.col("count") > PART)
    crowded, _ = persist_table(crowded.select("trie", "root", F.ceil(F.col("count") / PART).cast("long").alias("parts")), "crowded")
    keyed = leaves.select("fp", "node").mapInArrow(_keys(paths, True), "trie int, root long, fp binary, node long")
    alone = F.lit(0).cast("long")
    if (hot := crowded.count()) == 0:
        tasks = keyed.select("*", alone.alias("p"), alone.alias("q"))
    else:
        told = keyed.join(F.broadcast(crowded) if hot <= 100_000 else crowded, ["trie", "root"], "left")
        told = _dealt(told.withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))), F.col("parts"), F.col("node")).drop("parts")
        tasks = told
    tasks = tasks.repartition("trie", "root", "p", "q").sortWithinPartitions("trie", "root", "p", "q")
    return tasks.mapInArrow(_walks(paths, similarity), "u long, v long")


# -- exact similarities ---------------------------------------------------------------------------------------------


def exact_links(sets: list[np.ndarray], side: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Pairs (i, j) of sets with a Jaccard similarity of at least `similarity`, as many as tie all such pairs together.

    Sets come rare shingles first: two similar ones share one of their first few. Of the pairs that do, those whose sizes
    allow it and that are not tied yet are compared exactly. With `side` only pairs of different sides count.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sets, sizes = [sets[k] for k in order], sizes[order]
    which = None if side is None else side[order]
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token, count = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    rare = np.empty(len(count), np.int64)
    rare[np.argsort(count, kind="stable")] = np.arange(len(count))
    token = rare[token]
    token = token[np.lexsort((token, owner))]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    # what can be shared without the first shingles falls short of the threshold
    prefix = np.where(sizes > 0, sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1, 0)
    leading = np.arange(len(owner)) - starts[owner] < prefix[owner]
    post_owner, post_token = owner[leading], token[leading]
    by_token = np.argsort(post_token, kind="stable")
    post_owner, post_token = post_owner[by_token], post_token[by_token]
    root, stamp, out = np.arange(len(sets)), np.zeros(len(count), bool), []
    for i in range(len(sets)):
        mine = token[starts[i] : starts[i + 1]]
        first = mine[: prefix[i]]
        lo, hi = np.searchsorted(post_token, first), np.searchsorted(post_token, first, side="right")
        found = [post_owner[a:b] for a, b in zip(lo.tolist(), hi.tolist()) if b - a > 1]
        if not found:
            continue
        j = np.unique(np.concatenate(found))
        j = j[j > i]  # not smaller
        j = j[(sizes[i] >= similarity * sizes[j] - 1e-9) & (root[j] != root[i])]
        if which is not None:
            j = j[which[j] != which[i]]
        if not len(j):
            continue
        stamp[mine] = True
        at = np.repeat(starts[j] - np.concatenate(([0], np.cumsum(sizes[j])[:-1])), sizes[j]) + np.arange(int(sizes[j].sum()))
        shared = np.add.reduceat(stamp[token[at]].astype(np.int64), np.concatenate(([0], np.cumsum(sizes[j])[:-1])))
        stamp[mine] = False
        for k in j[shared >= similarity * (sizes[i] + sizes[j] - shared) - 1e-9].tolist():
            if root[k] != root[i]:
                root[root == root[k]] = root[i]
                out.append((int(order[i]), int(order[k])))
    return out


def _compared(similarity: float):
    """mapInArrow body over rows sorted by class, p and q: links between similar texts of each class."""

    def solve(rows: pa.Table) -> pa.RecordBatch | None:
        group, p, q, own, node = (rows.column(c).to_numpy() for c in ("class", "p", "q", "part", "node"))
        raw = rows.column("shingles").to_pylist()
        edge = _edges(group, p, q)
        u, v = [], []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if b - a < 2:
                continue
            _, once = np.unique(node[a:b], return_index=True)  # repeated rows of one text
            once = once + a
            side = None if p[a] == q[a] else own[once]
            for i, j in exact_links([np.frombuffer(raw[k], np.uint64) for k in once], side, similarity):
                u.append(node[once[i]])
                v.append(node[once[j]])
        return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"]) if u else None

    return _groups(("class", "p", "q"), solve, 4096)


def _sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(class, parts, node, shingles) of the texts in `members` (ROW, class, parts, node): the rest is left where it is."""
    seeds, _ = persist_table(members.select(F.xxhash64(*ROW).alias("h")), "wanted")
    bits, log = seed_filter(seeds)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.frombuffer(shared.value, np.uint64)
        for rows in pieces(batches):
            h, at = rows.column("h").to_numpy().view(np.uint64), np.arange(rows.num_rows)
            for look in range(LOOKS):
                place = _bit(h[at], look, log)
                at = at[(filled[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
            if len(at):
                part = rows.take(pa.array(at))
                sets = [shingles(t, words)[0].tobytes() for t in part.column("text").to_pylist()]
                yield pa.record_batch([*(part.column(c) for c in ROW), pa.array(sets, pa.binary())], names=[*ROW, "shingles"])

    keyed = docs.select(*row_key(docs), F.col("text").cast("string").alias("text"))
    keyed = keyed.select(*ROW, F.xxhash64(*ROW).alias("h"), "text")
    return keyed.mapInArrow(run, "row_id long, row_h1 long, row_h2 int, shingles binary").join(members, list(ROW)).select("class", "parts", "node", "shingles")


def _verified(docs: DataFrame, leaves: DataFrame, found: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (u, v) between nodes whose texts are similar, within the classes (node, root) of candidates."""
    heads = found.select(F.col("root").alias("node"), F.col("root").alias("class")).distinct()
    tied = leaves.join(found.select("node", F.col("root").alias("class")).unionByName(heads), "node").select("node", "class", "size", "first.*")
    tied, _ = persist_table(tied, "tied")
    sizes = tied.groupBy("class").agg(F.count("*").alias("n"), F.greatest(F.lit(1), F.ceil(F.sum("size") / PART_SHINGLES)).cast("long").alias("parts"))
    members, _ = persist_table(join_groups(tied, sizes, "class", "n", tied.count()).select(*ROW, "class", "parts", "node"), "tied")
    rows = _sets(docs, members, words)
    dealt = _dealt(rows, F.col("parts"), F.col("node")).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "node"), "parts"))
    dealt = dealt.select("class", "p", "q", "part", "node", "shingles").repartition("class", "p", "q").sortWithinPartitions("class", "p", "q")
    return dealt.mapInArrow(_compared(similarity), "u long, v long")


def _judged(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """ROW and lead (the least row of its class) of every document."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in rows.column("text").to_pylist():
            own, digest = shingles(text, words)
            out.append((wide_fingerprint(own), digest, len(own)))
        fps, digests, sizes = zip(*out)
        cols = [pa.array(fps, pa.binary()), pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(sizes, pa.int32())]
        return pa.record_batch([*(rows.column(c) for c in ROW), *cols], names=[*ROW, "fp", "digest", "size"])

    keyed = docs.select(*row_key(docs), F.col("text").cast("string").alias("text"))
    prints, _ = persist_table(map_batches(keyed, batch, "row_id long, row_h1 long, row_h2 int, fp binary, digest long, size int"), "prints")
    # texts with the same words are one leaf; the written table keeps the nodes' numbers from changing
    leaves = prints.groupBy("fp", "digest").agg(F.min(F.struct(*ROW)).alias("first"), F.first("size").alias("size"), F.count("*").alias("n"))
    leaves, _ = persist_table(leaves.withColumn("node", F.monotonically_increasing_id()), "leaves")
    tied, _ = components(candidates(leaves, similarity))
    roots, _ = components(_verified(docs, leaves, tied, words, similarity))
    member = leaves.join(roots, "node", "left").select("fp", "digest", "n", "first", F.coalesce("root", "node").alias("class"))
    member, _ = persist_table(member, "members")
    lead = member.groupBy("class").agg(F.min("first").alias("lead"), F.count("*").alias("prints"))
    led = join_groups(member, lead, "class", "prints", member.count()).select("fp", "digest", "n", "lead")
    led, _ = persist_table(led, "classes")
    return join_groups(prints, led, ["fp", "digest"], "n", prints.count())


def similar_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per document: doc_id, component_id (least doc_id reachable over links between similar texts).

    Similar: the Jaccard similarity of the sets of shingles is `similarity` or more; no link is below it, and a pair at it is found with
    a probability of about 0.99 (see `tries`), more surely the more alike. Null or empty texts are equal to each other and to
    no others. Fewer than `words` words: the whole sequence is the only shingle. Texts that differ in white space or the
    case of A-Z alone are equal. A null doc_id is linked like any other; a class without any id is null. Repeated rows are
    one text. An empty table gives an empty result; other columns are ignored.
    """
    judged = _judged(docs, words, similarity)
    return judged.select(F.nullif("row_id", F.lit(NO_ID)).alias("doc_id"), F.nullif("lead.row_id", F.lit(NO_ID)).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each class, all columns as they were: chosen as in `simhash.keep_one`."""
    judged = _judged(docs, words, similarity)
    return keep_rows(docs, judged.select(*ROW, (F.struct(*ROW) == F.col("lead")).alias("stays")))
