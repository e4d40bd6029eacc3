"""Exact, near and substring duplicates, and boilerplate lines, against brute force."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from helpers import CLASHING, ODD, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from playbill.llm import chunks, components, exact, line_spread, similar, simhash


def classes(n, linked):
    """The least member of each one's class."""
    root = list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in linked:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(k) for k in range(n)]


# -- exact ----------------------------------------------------------------------------------------------------------


def brute_exact(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), t in zip(rows, norm):
        groups[t].append(i)
    out = []
    for (i, _), t in zip(rows, norm):
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_exact(spark, share):
    rnd = random.Random(1)
    rows = [(k, rnd.choice(["a  b", "a b", "a\tb", "c", None, "", " "]) if k % 3 else f"only {k}") for k in range(200)] + [r[:2] for r in ODD]
    got = exact.exact_duplicates(documents(spark, rows), share).collect()
    assert sorted(map(tuple, got), key=repr) == brute_exact(rows)


def test_exact_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(exact, "SHARD", 7)
    rows = [(k, f"text {k % 61}") for k in range(180)]
    assert sorted(map(tuple, exact.exact_duplicates(documents(spark, rows)).collect()), key=repr) == brute_exact(rows)
    # what is dropped is decided on fewer columns of the same plan
    assert sorted(r["doc_id"] for r in exact.drop_duplicates(documents(spark, rows)).collect()) == [r[0] for r in sorted(brute_exact(rows)) if r[3]]


def test_exact_drops_copies_only(spark):
    kept = exact.drop_duplicates(documents(spark, [(1, "a"), (2, "a"), (3, "b"), (None, "b"), (None, "c"), (None, "c")]))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "c"), (1, "a"), (3, "b")] and set(CLASHING) <= set(kept.columns)


#: Repeated and missing ids, rows that are equal throughout, and rows that share an id with one that goes.
TANGLED = [(1, "A b"), (5, "A b"), (5, "unique"), (1, "x y"), (1, "x y"), (1, "x  y"), (None, "A b"), (None, "alone"), (None, "alone"), (None, "alone "), (5, "alone"), (7, None), (7, ""), (None, None)]


def test_exact_decides_row_by_row(spark):
    kept = exact.drop_duplicates(documents(spark, TANGLED)).select("doc_id", "text").collect()
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    best = {}
    for i, t in TANGLED:
        best[norm(t)] = min(best.get(norm(t), math.inf), math.inf if i is None else i)
    assert len(kept) == len(best) and {norm(t): math.inf if i is None else i for i, t in kept} == best


def test_history_is_kept_from_run_to_run(spark):
    first, second = [(4, "a b"), (5, "c"), (6, "c")], [(1, "a  b"), (9, "new"), (10, "new"), (None, "c")]
    history = exact.take_in(documents(spark, second), exact.take_in(documents(spark, first)))
    got = {(r["row_id"], r["group_size"], r["known"]) for r in history.collect()}
    assert got == {(1, 2, True), (5, 3, True), (9, 2, False)}
    past = exact.take_in(documents(spark, first))
    assert [r["doc_id"] for r in exact.drop_duplicates(documents(spark, second), past).collect()] == [9]
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_duplicates(documents(spark, second), history=past).collect()} == {
        1: (1, 2, True), 9: (9, 2, True), 10: (9, 2, False), None: (5, 3, False)
    }


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 2**32))
def test_perfect_hash_is_minimal(n, seed):
    keys = np.unique(np.random.default_rng(seed).integers(0, 2**63, (n, 4), dtype=np.uint64), axis=0)
    slots = exact.PerfectHash(keys).lookup(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))


# -- near -----------------------------------------------------------------------------------------------------------


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(grams))


def brute_near(rows, budget=4):
    prints = [brute_print(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= budget]
    ids = defaultdict(list)
    cls = classes(len(rows), linked)
    for (i, _), c in zip(rows, cls):
        ids[c] += [i] if i is not None else []
    return sorted(((i, f"{p:016x}", min(ids[c], default=None)) for (i, _), p, c in zip(rows, prints, cls)), key=repr)


def test_near(spark):
    rnd = random.Random(2)
    base = [" ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(120)) for _ in range(12)]
    rows = [r[:2] for r in ODD]
    for k in range(90):
        words = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = rnd.choice(["Alpha", "omega", "psi"])
        rows.append((100 + k, "  ".join(words)))
    assert sorted(map(tuple, simhash.near_duplicates(documents(spark, rows)).collect()), key=repr) == brute_near(rows)


@pytest.mark.parametrize("subtree, spare", [(2, 0), (4096, 0), (4096, 1), (2, 2), (4096, 3)])
def test_links_of_dense_and_random_prints(spark, monkeypatch, subtree, spare):
    """A cluster of neighbours, chains, and noise; also when every subtree is dealt into parts, and with more bands."""
    monkeypatch.setattr(simhash, "SUBTREE", subtree)
    if spare:
        monkeypatch.setattr(simhash, "CROWD", 0)
        monkeypatch.setattr(simhash, "SPARE", spare)
    rnd = random.Random(4)
    prints, at = [rnd.getrandbits(64) for _ in range(60)], rnd.getrandbits(64)
    for _ in range(60):
        prints.append(prints[0] ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    for _ in range(40):  # a chain of small steps
        for b in rnd.sample(range(64), 4):
            at ^= 1 << b
        prints.append(at)
    prints = sorted(set(prints))
    want = classes(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    assert linked_classes(spark, prints) == want


def linked_classes(spark, prints):
    """The class of each fingerprint: the least place of its members."""
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    roots, _ = components.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4))
    got = {r["node"]: r["root"] for r in roots.collect()}
    first = {}
    return [first.setdefault(got.get(p, p), k) for k, p in enumerate(signed)]


def test_a_hot_subtree_is_split_by_its_next_bits(spark):
    """All prints begin with the same band: its trie has one subtree. Planted near pairs are found, and rows stay few."""
    rng, n = np.random.default_rng(3), 30_000
    tail = rng.integers(0, 2**52, n, dtype=np.uint64)
    pairs = tail[:200].copy()
    for _ in range(4):
        pairs ^= np.uint64(1) << rng.integers(0, 52, 200).astype(np.uint64)
    prints = np.unique(np.concatenate([tail, pairs]) | np.uint64(0xABC << 52))
    leaves = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    tries = simhash._tries(4, len(prints))
    first = next(k for k, (bands, _) in enumerate(tries) if bands[0][0] == 0)
    keyed = leaves.selectExpr("fp", f"{first} as band", "shiftrightunsigned(fp, 52) as root", "shiftrightunsigned(fp, 36) & 65535 as deep")
    assert simhash._tasks(keyed, 4).count() <= len(prints) * 2 ** math.ceil(math.log2(len(prints) / simhash.SUBTREE))
    edges = {frozenset((r["u"], r["v"])) for r in simhash.links(leaves, 4).collect()}
    place = {x: k for k, x in enumerate(prints.tolist())}
    roots = classes(len(prints), [[place[x % 2**64] for x in e] for e in edges])
    for a, b in zip((tail[:200] | np.uint64(0xABC << 52)).tolist(), (pairs | np.uint64(0xABC << 52)).tolist()):
        assert roots[place[a]] == roots[place[b]]


@pytest.mark.parametrize("leaves, tries, bits", [(0, 5, 12), (1 << 20, 5, 12), (10**8, 15, 20), (10**10, 35, 27), (10**12, 70, 32), (10**15, 70, 32)])
def test_more_prints_take_more_bands(leaves, tries, bits):
    made = simhash._tries(4, leaves)
    assert len(made) == tries and min(length for _, length in made) >= bits
    x = np.random.default_rng(leaves % 97).integers(0, 2**64, 50, dtype=np.uint64)
    for bands, length in made:
        assert sorted(k for at, n in bands for k in range(at, at + n)) == list(range(64))
        for raw, new in zip(x.tolist(), simhash._arranged(x, bands).tolist()):
            source = f"{raw:064b}"
            assert f"{new:064b}" == "".join(source[at : at + n] for at, n in bands)


def test_components_of_chains_and_none(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(90, 80), (80, 80)]
    roots, _ = components.components(spark.createDataFrame(chain, "u long, v long"))
    assert {r["node"]: r["root"] for r in roots.collect()} == {**{k: 0 for k in range(1, 41)}, 90: 80}
    assert components.components(spark.createDataFrame([], "u long, v long"))[0].count() == 0


def test_near_keeps_one_of_each_class(spark):
    rows = [(3, "a b c d e f"), (1, "A b c d e f"), (2, "something else entirely than that"), (None, "unnamed row of words")]
    kept = simhash.keep_one(documents(spark, rows)).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 2]


def test_near_decides_row_by_row(spark):
    kept = simhash.keep_one(documents(spark, TANGLED)).select("doc_id", "text").collect()
    prints = [brute_print(t) for _, t in TANGLED]
    cls = classes(len(TANGLED), [(i, j) for i in range(len(TANGLED)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    best = {}
    for (i, _), c in zip(TANGLED, cls):
        best[c] = min(best.get(c, math.inf), math.inf if i is None else i)
    got = {cls[TANGLED.index((i, t))]: math.inf if i is None else i for i, t in kept}
    assert len(kept) == len(best) and got == best


# -- similar --------------------------------------------------------------------------------------------------------


def grams(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_wide(text):
    votes, own = [0] * 256, grams(text)
    for g in own:
        for w in range(4):
            x = xxhash.xxh64_intdigest(g.encode(), 42) ^ (w + 1) * 0x9E3779B97F4A7C15 % 2**64
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
            x ^= x >> 31
            for b in range(64):
                votes[64 * w + b] += x >> b & 1
    return sum(1 << b for b in range(256) if votes[b] * 2 > len(own))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_similar(rows, least=0.8):
    """The least id of each one's class: exact Jaccard similarities of all pairs; texts without words are equal to each other."""
    sets = [grams(t) for _, t in rows]
    cls = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= least])
    ids = defaultdict(list)
    for (i, _), c in zip(rows, cls):
        ids[c] += [i] if i is not None else []
    return {i: min(ids[c], default=None) for (i, _), c in zip(rows, cls)}


@pytest.mark.parametrize("text", [*(t for _, t in ODD if t is None or len(t) < 1000), "a b c d e f", "a b c d e a b c d e a b c d e", "One two THREE four five six  seven\teight nine"])
def test_wide_fingerprints_equal_brute_force(text):
    assert int.from_bytes(similar.wide_fingerprint(similar.shingles(text)[0]), "little") == brute_wide(text)


def edited(rnd, text, share):
    return " ".join(rnd.choice(["omega", "psi", "chi"]) if rnd.random() < share else w for w in text.split())


@pytest.mark.parametrize("subtree, part, shingles", [(512, 20_000, 2_000_000), (16, 60, 500)])
def test_similar_texts_equal_brute_force(spark, monkeypatch, subtree, part, shingles):
    """Copies with more or fewer changed words, near the threshold too; pivots, subtrees in parts, classes in parts."""
    monkeypatch.setattr(similar, "SUBTREE", subtree)
    monkeypatch.setattr(similar, "PART", part)
    monkeypatch.setattr(similar, "PART_SHINGLES", shingles)
    rnd = random.Random(31)
    base = [prose(rnd, 150) for _ in range(30)]
    rows = [(k, edited(rnd, rnd.choice(base), rnd.choice([0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.2]))) for k in range(240)] + [(300 + k, t) for k, (_, t) in enumerate(ODD)] + [(None, base[0]), (None, prose(rnd, 50))]
    got = Counter((r["doc_id"], r["component_id"]) for r in similar.similar_classes(documents(spark, rows)).collect() if r["doc_id"] is not None)
    want = brute_similar([r for r in rows if r[0] is not None])
    assert got == Counter(want.items()) and 60 < len(set(want.values())) < 220


def test_many_tries_find_the_pairs_and_link_no_others(spark, monkeypatch):
    """Small subtrees and many tries: at least 0.97 of the pairs at 0.8 or more share a class, and every class is one of brute force or a part of it."""
    monkeypatch.setattr(similar, "CROWD", 8)
    rnd = random.Random(37)
    rows = []
    for k in range(250):
        text = prose(rnd, rnd.choice([60, 200]))
        rows += [(2 * k, text), (2 * k + 1, edited(rnd, text, rnd.choice([0.01, 0.015, 0.02, 0.025, 0.03])))]
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_classes(documents(spark, rows)).collect()}
    want = brute_similar(rows)
    pairs = [k for k in range(0, 500, 2) if want[k] == want[k + 1]]
    assert 100 < len(pairs) < 240 and sum(got[k] == got[k + 1] for k in pairs) >= 0.97 * len(pairs)
    assert all(want[k] == want[c] for k, c in got.items())


@pytest.mark.parametrize("n, most", [(1, 3), (300, 4), (300, 9), (300, 20)])
def test_cover_equals_brute_force(n, most):
    rnd = np.random.default_rng(n + most)
    full = (rnd.integers(0, 2**16, (6, 4), dtype=np.uint64)[rnd.integers(0, 6, n)] ^ (np.uint64(1) << rnd.integers(0, 16, (n, 4)).astype(np.uint64))).astype(np.uint64)
    linked = [(i, j) for i in range(n) for j in range(i) if sum(int(a ^ b).bit_count() for a, b in zip(full[i].tolist(), full[j].tolist())) <= most]
    assert similar.cover(full, most).tolist() == classes(n, linked)


def test_exact_links_equal_brute_force():
    rnd = random.Random(3)
    base = rnd.sample(range(10**6), 60)
    sets = [{x if rnd.random() > p else rnd.randrange(10**6) for x in rnd.sample(base, rnd.choice([1, 5, 30, 55, 60]))} for p in [0, 0.01, 0.02, 0.05, 0.1] * 40] + [set(), set()]
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    for side in (None, np.arange(len(sets)) % 2):
        near = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8 and (side is None or side[i] != side[j])]
        got = similar.exact_links(arrays, side, 0.8)
        assert classes(len(sets), got) == classes(len(sets), near) and all((max(p), min(p)) in near for p in got)


def test_a_dense_cluster_is_one_class(spark, monkeypatch):
    """Very many distinct near copies of one text, in subtrees that are searched from pivots."""
    monkeypatch.setattr(similar, "SUBTREE", 64)
    rnd = random.Random(33)
    base = prose(rnd, 200).split()
    rows = [(k, " ".join([*base[: k % 200], f"w{k}", *base[k % 200 + 1 :]])) for k in range(1500)] + [(5000 + k, prose(rnd, 60)) for k in range(50)]
    kept = [r["doc_id"] for r in similar.keep_one(documents(spark, rows)).select("doc_id").collect()]
    assert sorted(kept) == [0, *range(5000, 5050)]
    assert similar.keep_one(documents(spark, [])).count() == 0


# -- chunks ---------------------------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=300), min_size=1, max_size=5))
def test_cuts_cover_each_text_alone(texts):
    raws = [t.encode() for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(r) for r in raws])))
    ends = chunks.cuts(np.frombuffer(b"".join(raws), np.uint8), starts).tolist()
    assert set(starts[1:].tolist()) - {0} <= set(ends) and ends == sorted(set(ends))
    for raw, lo, hi in zip(raws, starts[:-1], starts[1:]):
        own = [e - lo for e in ends if lo < e <= hi]
        assert own == chunks.cuts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).tolist()  # neighbours change nothing
        for e in own:
            raw[:e].decode()  # whole characters


def prose(rnd, n):
    return " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def test_repeated_passages(spark):
    rnd = random.Random(7)
    passage = prose(rnd, 60)
    rows = [(k, prose(rnd, 150)) for k in range(30)]
    rows += [(100 + k, f"{prose(rnd, rnd.randint(5, 90))} {passage} {prose(rnd, 40)}") for k in range(6)]
    rows += [(200, prose(rnd, 80) + " a short one that is shared by two " + prose(rnd, 30)), (201, prose(rnd, 50) + " a short one that is shared by two " + prose(rnd, 20))]
    rows += [(300, "same " * 500)] + [r[:2] for r in ODD]
    found = chunks.repeats(documents(spark, rows)).collect()
    texts = dict(rows)
    late = {r["doc_id"] for r in found if 100 <= r["first_doc_id"] < 106}
    assert late == {101, 102, 103, 104, 105}
    assert {r["doc_id"] for r in found} - late <= {6, 300}  # the same word over and over
    assert {(r["doc_id"], r["first_doc_id"]) for r in found if r["doc_id"] not in late} <= {(300, 6)}
    for r in found:
        if r["doc_id"] in late:
            assert texts[r["doc_id"]][r["start"] : r["end"]] in texts[r["first_doc_id"]]
    clean = {r["doc_id"]: r["text"] for r in chunks.drop_repeats(documents(spark, rows)).collect() if r["doc_id"] is not None}
    assert clean[100] == texts[100] and all(len(texts[k]) - len(clean[k]) > 150 for k in late) and clean[200] == texts[200]
    assert chunks.repeats(documents(spark, [])).count() == 0


def brute_passages(rows, run_words):
    """Runs of chunks that one earlier document holds, none within another, by comparing every two documents' chunks."""
    cut = {}
    for i, t in rows:
        raw = (t or "").encode()
        ends = chunks.cuts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).tolist()
        cut[i] = [raw[a:b] for a, b in zip([0, *ends], ends)]
    out = set()
    for i, mine in cut.items():
        runs = set()
        for j in (j for j in cut if j < i):
            held, at = set(cut[j]), 0
            while at < len(mine):
                end = at
                while end < len(mine) and mine[end] in held:
                    end += 1
                words = sum(len(re.findall(rb"(?<![^\x20\x09-\x0d])[^\x20\x09-\x0d]", b"".join(mine[:k + 1]))) - len(re.findall(rb"(?<![^\x20\x09-\x0d])[^\x20\x09-\x0d]", b"".join(mine[:k]))) for k in range(at, end))
                if words >= run_words:
                    runs.add((at, end))
                at = max(end, at + 1)
        size = lambda k: len(b"".join(mine[:k]).decode())
        out |= {(i, size(a), size(b)) for a, b in runs if not any((c, d) != (a, b) and c <= a and b <= d for c, d in runs)}
    return out


def test_passages_equal_brute_force(spark):
    rnd = random.Random(21)
    passages = [prose(rnd, n) for n in (40, 60, 90)]
    rows = [(k, " ".join(prose(rnd, rnd.randint(0, 30)) if rnd.random() < 0.5 else rnd.choice(passages) for _ in range(4))) for k in range(25)]
    found = chunks.repeats(documents(spark, rows)).collect()
    assert {(r["doc_id"], r["start"], r["end"]) for r in found} == brute_passages(rows, chunks.RUN_WORDS) and len(found) > 10


def test_pieces_of_several_documents_are_no_passage(spark):
    """Some chunks each of six documents, laid end to end: no earlier document holds them all."""
    rnd = random.Random(12)
    rows = [(k, prose(rnd, 80)) for k in range(6)]
    parts = []
    for _, text in rows:
        ends = chunks.cuts(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])).tolist()
        parts.append(text[ends[3] : ends[5]])
    whole = "".join(parts)
    for r in chunks.repeats(documents(spark, [*rows, (9, whole)])).collect():
        assert r["doc_id"] == 9 and whole[r["start"] : r["end"]] in rows[r["first_doc_id"]][1]


def test_passages_of_documents_without_or_with_one_id(spark):
    rnd = random.Random(13)
    passage = prose(rnd, 60)
    rows = [(4, f"{prose(rnd, 20)} {passage}"), (4, f"{passage} {prose(rnd, 20)}"), (None, f"{prose(rnd, 9)} {passage}"), (None, f"{prose(rnd, 7)} {passage}"), (4, prose(rnd, 40))]
    found = chunks.repeats(documents(spark, [*rows, rows[2]])).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["4", "None", "None"] and {r["first_doc_id"] for r in found} == {4}
    clean = chunks.drop_repeats(documents(spark, rows)).collect()
    assert len(clean) == len(rows) and sum(len(r["text"]) < 250 for r in clean) >= 3


def test_insertions_move_few_cuts():
    rnd = random.Random(9)
    text = prose(rnd, 2000)

    def cut(t):
        ends = chunks.cuts(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])).tolist()
        return {t[a:b] for a, b in zip([0, *ends], ends)}

    a, b = cut(text), cut(text[:5000] + "INSERTED" + text[5000:])
    assert len(a - b) <= 4


# -- lines ----------------------------------------------------------------------------------------------------------


def brute_lines(rows, least):
    sites = defaultdict(set)
    for _, text, _, source in rows:
        for line in (text or "").split("\n"):
            if source is not None:
                sites[line.strip(" ")].add(source)
    out = Counter()
    for i, text, _, _ in rows:
        parts = [] if text is None else text.split("\n")
        gone = [p.strip(" ") != "" and len(sites[p.strip(" ")]) >= least for p in parts]
        out[i, len(parts), sum(gone), None if text is None else "\n".join(p for p, g in zip(parts, gone) if not g)] += 1
    return out


@pytest.mark.parametrize("sent", [line_spread.SENT_KEYS, 0])
def test_lines(spark, monkeypatch, sent):
    """Boilerplate keys sent to the documents, and joined with them."""
    monkeypatch.setattr(line_spread, "SENT_KEYS", sent)
    rnd = random.Random(11)
    pool = [f"line {k}" for k in range(40)]
    rows = [(k, "\n".join(rnd.choice(pool[: 5 + k % 36]) + rnd.choice(["", "  "]) for _ in range(rnd.randint(1, 9))), "en", rnd.choice([f"site{s}" for s in range(12)] + [None])) for k in range(150)]
    rows += [(*r[:2], "en", "odd") for r in ODD] + [(400, "\n\n", "en", "s"), (401, "line 1", "en", "s"), (401, "line 1", "en", "s")]
    got = Counter(map(tuple, line_spread.drop_boilerplate(documents(spark, rows)).collect()))
    assert got == brute_lines(rows, line_spread.MIN_SITES) and sum(r[2] for r in got) > 0
    assert line_spread.drop_boilerplate(documents(spark, [])).count() == 0


def test_many_lines_go_in_linear_time(spark):
    """A document of very many lines, every second one boilerplate."""
    lines = [f"menu {k}" if k % 2 else f"own {k}" for k in range(60_000)]
    rows = [(k, "\n".join(lines[1::2]), "en", f"site{k}") for k in range(8)] + [(9, "\n".join(lines), "en", "site9")]
    begun = time.perf_counter()
    got = {r["doc_id"]: r for r in line_spread.drop_boilerplate(documents(spark, rows)).collect()}
    assert got[9]["text"] == "\n".join(lines[::2]) and got[9]["n_removed"] == 30_000 and got[0]["text"] == ""
    assert time.perf_counter() - begun < 60


def test_empty_tables(spark):
    none = documents(spark, [])
    assert exact.exact_duplicates(none).count() == 0 and simhash.near_duplicates(none).count() == 0
