"""Operator 7: SimHash near-duplicates, linked by a self-join of binary tries.

A fingerprint is a path of 64 bits. Two fingerprints at most `budget` bits apart agree wholly in one of budget + 1 bands
of bits, so there are budget + 1 tries, each over the bits arranged to start with another band. In the trie of a band where
a pair agrees, the traversal of node pairs stays on the diagonal for that band's bits: those top levels are the shuffle
key, and each subtree is then walked against itself, node pair by node pair. A pair of nodes carries the number of bits in
which the paths differ so far and is dropped as soon as this exceeds the budget.

With very many fingerprints a single band parts them too little. Of budget + 1 + k bands a pair agrees wholly in k + 1, so
there is then a trie for every k + 1 bands: more tries, but with subtrees that stay small. The links are the same for any k.

Only distinct fingerprints enter, so exact copies, however many, are one leaf. A subtree with more than `SUBTREE` leaves is
split by its next bits, and those pairs of its nodes meet whose paths differ in no more bits than the budget; a node that is
still too large is dealt into parts, and every two parts meet. Each such pair is walked by its own task: the work of a hot
subtree spreads and nothing is left out. A task returns a spanning forest of the links that it finds, which is enough for the
classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import NO_ID, ROW, join_groups, keep_rows, map_batches, persist_table, row_key

#: Leaves of a subtree that one task walks; more are split.
SUBTREE = 4096
#: Next bits by which a subtree is split, at most.
SPLIT_BITS = 16
#: Leaves of a subtree on average, at most; beyond that the tries start with more bands.
CROWD = 1500
#: Bands beyond budget + 1, at most: with a budget of 4, 70 tries that start with 32 bits, for 2**40 fingerprints.
SPARE = 3
#: Leaves that a task gathers before it walks them.
WALK = 60_000
#: Node pairs expanded at once.
FRONTIER = 200_000
#: Node pairs with at most this many leaf pairs are compared leaf by leaf.
LEAF_PAIRS = 8


# -- fingerprints ---------------------------------------------------------------------------------------------------


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The SimHash of a text: A-Z lower-cased, words parted by ASCII white space, shingles hashed by XXH64."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined, n = b" ".join(tokens), len(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    m = max(1, n - words + 1)
    first, last = starts[:m].tolist(), ends[min(words, n) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, m, 4096):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(first[at : at + 4096], last[at : at + 4096])], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > m, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """ROW and fp of every row, fp being the fingerprint's 64 bits as a signed long."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, words) for t in rows.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        return pa.record_batch([*(rows.column(c) for c in ROW), pa.array(fps)], names=[*ROW, "fp"])

    keyed = docs.select(*row_key(docs), F.col("text").cast("string").alias("text"))
    return map_batches(keyed, batch, "row_id long, row_h1 long, row_h2 int, fp long")


# -- the walk -------------------------------------------------------------------------------------------------------


def _ones_before(bits: np.ndarray) -> np.ndarray:
    """For each depth, how many leaves before a place have bit 1 there: (64, n + 1)."""
    out = np.zeros((64, len(bits) + 1), np.int32)
    for depth in range(64):
        np.cumsum(((bits >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int32), out=out[depth, 1:])
    return out


def walk(bits: np.ndarray, groups: np.ndarray, budget: Sequence[int], depth: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs (places in `bits`) that are near.

    `bits`: leaves, sorted within each tree; `groups`: rows (a_lo, a_hi, b_lo, b_hi) of root pairs whose first `depth`
    bits are equal; a root pair with the same range twice is a self-join. `budget`: how many bits may differ down to each
    depth, beginning with the first; a pair of nodes that differs in more is dropped. `near` tests pairs of leaves.
    """
    if not len(groups):
        return
    last = len(budget)
    ones = _ones_before(bits)
    stack = [(np.asarray(groups, np.int64), np.zeros(len(groups), np.int64), depth)]
    while stack:
        nodes, spent, at = stack.pop()
        if len(nodes) > FRONTIER:
            for k in range(0, len(nodes), FRONTIER):
                stack.append((nodes[k : k + FRONTIER], spent[k : k + FRONTIER], at))
            continue
        a_lo, a_hi, b_lo, b_hi = nodes.T
        own = a_lo == b_lo
        size = (a_hi - a_lo) * (b_hi - b_lo)
        small = (size <= LEAF_PAIRS) | (at >= last)
        if small.any():
            yield from _leaf_pairs(nodes[small], size[small], near)
            keep = ~small
            nodes, spent, own = nodes[keep], spent[keep], own[keep]
            if not len(nodes):
                continue
            a_lo, a_hi, b_lo, b_hi = nodes.T
        count = ones[at]
        a_mid = a_hi - (count[a_hi] - count[a_lo])
        b_mid = b_hi - (count[b_hi] - count[b_lo])
        left = np.stack((a_lo, a_mid, b_lo, b_mid), 1), spent
        right = np.stack((a_mid, a_hi, b_mid, b_hi), 1), spent
        cross = np.stack((a_lo, a_mid, b_mid, b_hi), 1), spent + 1
        back = np.stack((a_mid, a_hi, b_lo, b_mid), 1)[~own], spent[~own] + 1
        nodes = np.concatenate([left[0], right[0], cross[0], back[0]])
        spent = np.concatenate([left[1], right[1], cross[1], back[1]])
        alive = (spent <= budget[at]) & (nodes[:, 0] < nodes[:, 1]) & (nodes[:, 2] < nodes[:, 3])
        alive &= ~((nodes[:, 0] == nodes[:, 2]) & (nodes[:, 1] - nodes[:, 0] < 2))  # a leaf against itself
        if alive.any():
            stack.append((nodes[alive], spent[alive], at + 1))


def _leaf_pairs(nodes: np.ndarray, size: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    block = max(1, 1_000_000 // int(size.max()))
    for k in range(0, len(nodes), block):
        part, n = nodes[k : k + block], size[k : k + block]
        row = np.repeat(np.arange(len(part)), n)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        width = part[row, 3] - part[row, 2]
        i, j = part[row, 0] + offset // width, part[row, 2] + offset % width
        once = (i < j) | (part[row, 0] != part[row, 2])
        i, j = i[once], j[once]
        close = near(i, j)
        if close.any():
            yield i[close], j[close]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n items the least item of its class."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
    return root


def _tries(budget: int, leaves: int) -> list[tuple[list[tuple[int, int]], int]]:
    """For each trie: the bands (first bit, length) in its order, the shared ones in front, and how many bits those have."""
    for spare in range(min(SPARE, 63 - budget) + 1):
        edges = np.linspace(0, 64, budget + 2 + spare).astype(int).tolist()
        bands = [(a, b - a) for a, b in zip(edges[:-1], edges[1:])]
        tries = [([*front, *(x for x in bands if x not in front)], sum(n for _, n in front)) for front in combinations(bands, spare + 1)]
        if leaves <= CROWD << min(length for _, length in tries):
            break
    return tries


def _arranged(x: np.ndarray, bands: list[tuple[int, int]]) -> np.ndarray:
    """The bits of x in the order of the bands."""
    out = np.zeros_like(x)
    for at, n in bands:
        out = (out << np.uint64(n)) | ((x << np.uint64(at)) >> np.uint64(64 - n))
    return out


def _path(bands: list[tuple[int, int]], start: int, length: int) -> Column:
    """The bits from `start` on, `length` of them, in the order of the bands, of the column fp."""
    out, skip, left = F.lit(0).cast("long"), start, length
    for at, n in bands:
        at, n, skip = at + min(skip, n), n - min(skip, n), skip - min(skip, n)
        n = min(n, left)
        if n:
            left -= n
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.shiftleft("fp", at), 64 - n), left))
    return out


def _join_walks(budget: int, tries: list[tuple[list[tuple[int, int]], int]]):
    """mapInArrow body: rows sorted by task (band, root, p, q); side 0 belongs to part p, side 1 to part q; band is the trie's number."""

    def solve(rows: pa.Table) -> pa.RecordBatch | None:
        cols = {c: rows.column(c).to_numpy() for c in ("band", "root", "p", "q", "side", "fp")}
        fp, out_u, out_v = cols["fp"].view(np.uint64), [], []
        for number, (bands, length) in enumerate(tries):
            own = np.flatnonzero(cols["band"] == number)
            if not len(own):
                continue
            bits = _arranged(fp[own], bands)
            order = np.lexsort((bits, *(cols[c][own] for c in ("side", "q", "p", "root"))))
            own, bits = own[order], bits[order]
            key = np.stack([cols[c][own] for c in ("root", "p", "q", "side")])
            lo = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0))))
            hi = np.append(lo[1:], len(own))
            p, q, side = key[1:, lo]
            selfs = p == q
            groups = [np.stack((lo, hi, lo, hi), 1)[selfs & (hi - lo > 1)]]
            two = np.flatnonzero(~selfs & (side == 0))
            two = two[two + 1 < len(lo)]
            two = two[(key[:3, lo[two]] == key[:3, lo[two + 1]]).all(axis=0)]
            groups.append(np.stack((lo[two], hi[two], lo[two + 1], hi[two + 1]), 1))
            near = lambda i, j, bits=bits: np.bitwise_count(bits[i] ^ bits[j]) <= budget
            root = forest(len(own), walk(bits, np.concatenate(groups), [budget] * 64, length, near))
            linked = np.flatnonzero(root != np.arange(len(own)))
            out_u.append(cols["fp"][own[linked]])
            out_v.append(cols["fp"][own[root[linked]]])
        if not out_u:
            return None
        return pa.record_batch([pa.array(np.concatenate(out_u)), pa.array(np.concatenate(out_v))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < WALK:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([rows.column(c).to_numpy() for c in ("band", "root", "p", "q")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1  # the last task may go on in the next batch
            if not len(cuts):
                continue
            cut = int(cuts[-1])
            if (done := solve(rows.slice(0, cut))) is not None:
                yield done
            held, n = rows.slice(cut).to_batches(), rows.num_rows - cut
        if held and (done := solve(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield done

    return run


def _tasks(keyed: DataFrame, budget: int) -> DataFrame:
    """The leaves (band, root, deep, fp) as often as they are walked: with parts p and q, whose walk it is, and the leaf's side.

    `deep` holds the SPLIT_BITS bits after the root. In a subtree with too many leaves, nodes are the next bits, as many as
    would leave SUBTREE leaves to each; a node has parts if it still has more.
    """
    none = F.lit(0).cast("long")
    trees = keyed.groupBy("band", "root").count().where("count > 1")
    bits = F.least(F.lit(SPLIT_BITS), F.ceil(F.log2(F.col("count") / SUBTREE))).cast("int")
    trees, _ = persist_table(trees.select("band", "root", F.when(F.col("count") > SUBTREE, bits).otherwise(0).alias("bits")), "subtrees")
    whole = keyed.join(trees.where("bits = 0"), ["band", "root"]).select("band", "root", "fp", none.alias("p"), none.alias("q"), F.lit(0).alias("side"))
    large = trees.where("bits > 0")
    if large.isEmpty():
        return whole
    leaves = keyed.join(F.broadcast(large) if large.count() <= 100_000 else large, ["band", "root"])
    leaves = leaves.select("band", "root", "fp", "bits", F.expr(f"shiftright(deep, {SPLIT_BITS} - bits)").alias("node"))
    nodes = leaves.groupBy("band", "root", "bits", "node").agg(F.ceil(F.count("*") / SUBTREE).cast("long").alias("parts"))
    nodes, _ = persist_table(nodes, "nodes")
    # every node with the nodes whose paths are near; as many rows as nodes times near paths at most
    near = [(bits, m) for bits in range(1, SPLIT_BITS + 1) for m in range(1 << bits) if m.bit_count() <= budget]
    masks = keyed.sparkSession.createDataFrame(near, "bits int, mask long")  # some thousands of rows, whatever the input
    other = nodes.select("band", "root", F.col("node").alias("other"), F.col("parts").alias("other_parts"))
    met = nodes.join(F.broadcast(masks), "bits")
    met = met.withColumn("other", F.col("node").bitwiseXOR(F.col("mask"))).join(other, ["band", "root", "other"])
    dealt = leaves.join(met.select("band", "root", "node", "parts", "other", "other_parts"), ["band", "root", "node"])
    part = lambda node, number: F.shiftleft(node, 32).bitwiseOR(number)
    dealt = dealt.withColumn("own", part("node", F.pmod(F.xxhash64(F.lit("part"), "fp"), "parts")))
    dealt = dealt.select("band", "root", "fp", "own", "other", F.explode(F.sequence(none, F.col("other_parts") - 1)).alias("number"))
    dealt = dealt.withColumn("o", part("other", F.col("number")))
    return whole.unionByName(dealt.select("band", "root", "fp", F.least("own", "o").alias("p"), F.greatest("own", "o").alias("q"), (F.col("o") < F.col("own")).cast("int").alias("side")))


def links(leaves: DataFrame, budget: int = 4) -> DataFrame:
    """Links (u, v) between distinct fingerprints: a spanning forest of all pairs within the budget. `leaves`: fp, distinct."""
    tries = _tries(budget, leaves.count())
    paths = F.array(*[F.struct(_path(bands, 0, n).alias("root"), _path(bands, n, SPLIT_BITS).alias("deep")) for bands, n in tries])
    keyed = leaves.select("fp", F.posexplode(paths).alias("band", "x")).select("fp", "band", "x.root", "x.deep")
    tasks = _tasks(keyed, budget)
    tasks = tasks.repartition("band", "root", "p", "q").sortWithinPartitions("band", "root", "p", "q")
    return tasks.mapInArrow(_join_walks(budget, tries), "u long, v long")


def classes(prints: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(fp, n, lead): for each distinct fingerprint of ROW and fp its number of rows, and the least row of its class.

    `linked` makes links (u, v) between the nodes of leaves (fp, node); a node is a number of the leaf's own.
    """
    leaves = prints.groupBy("fp").agg(F.min(F.struct(*ROW)).alias("first"), F.count("*").alias("n"))
    # the written table keeps the numbers from changing
    leaves, _ = persist_table(leaves.withColumn("node", F.monotonically_increasing_id()), "leaves")
    roots, _ = components(linked(leaves.select("fp", "node")))
    member = leaves.join(roots, "node", "left").select("fp", "n", "first", F.coalesce("root", "node").alias("class"))
    member, _ = persist_table(member, "members")
    lead = member.groupBy("class").agg(F.min("first").alias("lead"), F.count("*").alias("prints"))
    return join_groups(member, lead, "class", "prints", member.count()).select("fp", "n", "lead")


def _by_node(pairs: DataFrame, leaves: DataFrame) -> DataFrame:
    """Links between fingerprints as links between their nodes."""
    for end in ("u", "v"):
        pairs = pairs.join(leaves.select(F.col("fp").alias(end), F.col("node").alias(f"{end}_node")), end).drop(end).withColumnRenamed(f"{end}_node", end)
    return pairs.select("u", "v")


def _judged(docs: DataFrame, words: int, budget: int) -> DataFrame:
    """ROW, fp, n and lead of every document."""
    prints, _ = persist_table(fingerprints(docs, words), "prints")
    # a fingerprint of 64 bits is a number of its own already
    found, _ = persist_table(classes(prints, lambda leaves: _by_node(links(leaves.select("fp"), budget), leaves)), "classes")
    return join_groups(prints, found, "fp", "n", prints.count())


def near_duplicates(docs: DataFrame, words: int = 4, budget: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (least doc_id reachable).

    Null or empty text: fingerprint zero, linked like any other. Fewer than `words` words: the whole sequence is the only
    shingle. Repeated rows keep one output row each, and rows with one id may be in different classes. A row whose doc_id is
    null is linked like any other; its class is null if no row of it has an id. An empty table gives an empty result; other
    columns are ignored.
    """
    judged = _judged(docs, words, budget)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return judged.select(F.nullif("row_id", F.lit(NO_ID)).alias("doc_id"), hexed.alias("fingerprint"), F.nullif("lead.row_id", F.lit(NO_ID)).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 4, budget: int = 4) -> DataFrame:
    """One document of each class, all columns as they were.

    The least doc_id stays, a null one only where no row of the class has an id; of rows with that id, or without one, the
    least hash of the whole row, and of rows equal throughout one.
    """
    judged = _judged(docs, words, budget)
    return keep_rows(docs, judged.select(*ROW, (F.struct(*ROW) == F.col("lead")).alias("stays")))
