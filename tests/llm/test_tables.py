"""Cohort retention, byte-level BPE and the filter audit, against brute force."""

import hashlib
import os
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from itertools import permutations
from math import floor
from zlib import crc32

import numpy as np
import pytest
import regex
import tiktoken
from helpers import ODD, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from playbill.llm import audit, bpe, queries, retention

SF = "/root/testdata/sf0.001"

# -- retention ------------------------------------------------------------------------------------------------------

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, state int, cents string"
CUTOFF = datetime(2024, 2, 15)


def some_clicks(n, hot):
    rnd = random.Random(n)
    rows = []
    for k in range(n):
        client = rnd.choice([1, 1, 1, None, *range(2, 12)] if hot else range(40))
        ts = None if rnd.random() < 0.02 else datetime(2024, 2, 1) + timedelta(days=rnd.randrange(40), microseconds=rnd.choice([0, 1, 86_399_999_999, rnd.randrange(10**10)]))
        arrived = None if ts is None or rnd.random() < 0.02 else ts + timedelta(minutes=rnd.randrange(90))
        value = rnd.choice([None, 1.5, -2.345, 0.005, float("nan"), float("inf"), 1e300, rnd.random() * 100])
        rows.append((rnd.choice([k, k, None]), ts, arrived, client, rnd.choice(["signup", "view", None]), value, rnd.choice([None, "{}", "x"]), 7, "clash"))
    return rows + rnd.sample(rows, n // 5)


def brute_cells(clicks, segments, cohort_days=1, period_days=1):
    nan = lambda v: None if v != v else v
    seen = {(r[0], r[1], r[2], r[3], r[4], "nan" if r[5] is not None and r[5] != r[5] else r[5], r[6]) for r in clicks if r[1] is not None and r[3] is not None}
    by_state = defaultdict(lambda: defaultdict(list))
    for click, ts, arrived, client, kind, value, _ in seen:
        value = None if value == "nan" or value is not None and abs(value) > 1e13 else nan(value)
        h = 0 if click is None else crc32(str(click).encode())
        known = arrived and arrived + timedelta(days=h % 100 if click is not None and h % 3 == 0 else 0)
        for state in (0, 1):
            if state == 1 or known is not None and known < CUTOFF:
                by_state[state][client].append((ts, kind, 0 if value is None else floor(100 * value + 0.5)))
    begun = {(s, c): min((t for t, k, _ in rows if k == "signup"), default=None) for s, x in by_state.items() for c, rows in x.items()}
    day = lambda t: (t - datetime(1970, 1, 1)).days // cohort_days
    users, money = defaultdict(set), Counter()
    for state, x in by_state.items():
        for client, rows in x.items():
            start = begun[state, client]
            for ts, _, cents in rows:
                if start is not None and ts >= start:
                    cell = (state, segments.get(client) or "", day(start), (ts - start) // timedelta(days=period_days))
                    users[cell].add(client)
                    money[cell] += cents
    moved = lambda c: begun.get((0, c)) is not None and begun.get((1, c)) is not None and day(begun[0, c]) != day(begun[1, c])
    return sorted((*cell, len(u), sum(crc32(str(c).encode()) for c in u), sum(map(moved, u)), money[cell]) for cell, u in users.items())


@pytest.mark.parametrize(("n", "hot", "days"), [(600, True, 1), (600, False, 1), (300, True, 7), (0, True, 1)])
def test_retention(spark, monkeypatch, n, hot, days):
    monkeypatch.setattr(retention, "CHUNK", 9)  # a client is many chunks
    monkeypatch.setattr(retention, "BATCH", 16)
    clicks = some_clicks(n, hot) if n else []
    clients = [(k, ["a", "b", None, ""][k % 4], "clash") for k in range(9)] + [(None, "z", "clash"), (1, "c", "clash")]
    segments = {k: s for k, s, _ in clients if k is not None} | {1: "b"}
    h = retention.crc(F.col("click_id"))
    late = F.when(F.pmod(h, F.lit(3)) == 0, F.pmod(h, F.lit(100)))
    got = retention.retention(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(clients, "client_id long, segment string, start0 string"), cohort_days=days, period_days=days, late=late)
    assert sorted(map(tuple, got.collect())) == brute_cells(clicks, segments, days, days)


def test_retention_over_ages(spark):
    """A broken time far in the future makes one period, not millions of boundaries."""
    rows = [(1, datetime(1970, 1, 1), datetime(2024, 1, 1), 5, "signup", 1.0, None), (2, datetime(9999, 12, 31), datetime(2024, 1, 1), 5, "view", 2.0, None)]
    got = retention.retention(spark.createDataFrame(rows, CLICKS.rsplit(", ", 2)[0]), spark.createDataFrame([], "client_id long, segment string"))
    assert sorted((r["state"], r["period"], r["cents"]) for r in got.collect()) == [(s, p, c) for s in (0, 1) for p, c in ((0, 100), (2932896, 200))]


def test_occupied():
    t, money = np.array([5, 5, 9, 30, 31]), np.array([1, 2, 4, 8, 16])
    k, cents = retention.occupied(t, np.concatenate(([0], np.cumsum(money))), 5, 10)
    assert k.tolist() == [0, 2] and cents.tolist() == [7, 24]


# -- byte-level BPE -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("plain", pat_str=bpe.PATTERN, mergeable_ranks=bpe.ranks(queries.VOCABULARY), special_tokens={})


@pytest.fixture(scope="module")
def table():
    import zlib

    return np.frombuffer(zlib.decompress(bpe.character_classes()), np.uint8)


def cut_texts(texts, table):
    raw = [t.encode() for t in texts]
    data, starts = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    words, sizes = bpe._words(data, starts, table)
    words, at = [w.decode() for w in words.to_pylist()], np.concatenate(([0], np.cumsum(sizes))).tolist()
    return [words[a:b] for a, b in zip(at, at[1:])]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("asterveldm' \n\t 　!?.#0719²½éßж字ا́\U0001f600\x00\x1c")), max_size=4))
def test_cut(table, texts):
    assert cut_texts(texts, table) == [regex.findall(bpe.PATTERN, t) for t in texts]


@pytest.mark.parametrize("texts", [["it's 'tis we'll'll ''s 'S 're'r've'd'm x's"], ["a" * 300_000, " " * 300_000 + "a", "\n" * 4000 + "b", "9" * 70_000 + "!" * 70_000], ["", "a", "", " ", "  ", "'", "'s", "s"], []])
def test_cut_of_long_runs(table, texts):
    assert cut_texts(texts, table) == [regex.findall(bpe.PATTERN, t) for t in texts]


def expected(plain, rows):
    out = []
    for doc, text in rows:
        ids = [k for w in regex.findall(bpe.PATTERN, text or "") for k in plain._encode_single_piece(w.encode())]
        assert len(text or "") > 100_000 or ids == plain.encode_ordinary(text or "")
        out.append((doc, len(ids), np.array(ids, "<u4").tobytes(), (text or "").encode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("frequent", [10**6, 20])
def test_bpe(spark, plain, monkeypatch, frequent):
    monkeypatch.setattr(bpe, "FREQUENT", frequent)  # with 20 nearly all words are asked for
    monkeypatch.setattr(bpe, "PIECE_ROWS", 5)
    monkeypatch.setattr(bpe, "BUCKET_WORDS", 7)
    rows = [r[:2] for r in ODD] + [(100 + k, f"it's the {k}th word, isn't it?  we'll see {'ж' * k}\n\n x") for k in range(40)] + [(7, "!" * 50_000), (8, (" " * 4000 + "a") * 20), (9, "\U0001f600" * 3000), (3, "\x00 \x1c a")]
    both = bpe.decode(bpe.encode(documents(spark, rows), queries.VOCABULARY), queries.VOCABULARY)
    assert sorted(((r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in both.collect()), key=repr) == expected(plain, rows)


def test_bpe_without_rows(spark):
    assert bpe.decode(bpe.encode(documents(spark, []), queries.VOCABULARY), queries.VOCABULARY).collect() == []
    got = bpe.decode(bpe.encode(documents(spark, [(1, ""), (None, None)]), queries.VOCABULARY), queries.VOCABULARY).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], bytes(r["decoded"])) for r in got), key=repr) == [(1, 0, b""), (None, 0, b"")]


def test_bpe_refuses_a_changing_order(spark, monkeypatch):
    monkeypatch.setattr(bpe, "FREQUENT", 20)
    rows = documents(spark, [(k, f"some words {k} {k * k} and more") for k in range(300)])
    mixed = lambda batches: (b.sample(frac=1, random_state=int.from_bytes(os.urandom(4))) for b in batches)
    with pytest.raises(Exception, match="another order"):
        bpe.encode(rows.mapInPandas(mixed, rows.schema), queries.VOCABULARY).collect()


def test_op12_over_the_documents(spark, plain):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d, n, hashlib.sha256(i).hexdigest(), hashlib.sha256(t).hexdigest()) for d, n, i, t in expected(plain, map(tuple, rows)))
    assert sorted(map(tuple, queries.op12_byte_bpe(spark, SF).collect())) == want


# -- filter audit ---------------------------------------------------------------------------------------------------


def brute_audit(docs, labels):
    words = lambda t: regex.findall("[^\x20\x09-\x0d]+", t)
    texts = defaultdict(list)
    for doc, text, _ in docs:
        texts[text or ""].append(doc)
    fails, marks = [], defaultdict(lambda: [0, 0])
    for doc, quality, toxic in labels:
        marks[doc] = [max(marks[doc][0], quality == 1), max(marks[doc][1], toxic == 1)]
    for doc, text, lang in docs:
        text = text or ""
        w = words(text)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(regex.findall("[A-Z]", text)) > 3 * len(text), "D": bool(regex.search("[#$%&*|]", text))}
        bad["E"] = doc is not None and any(d is not None and d < doc for d in texts[text])
        fails.append((lang or "", {f for f in bad if bad[f]}, *(marks[doc] if doc is not None else [0, 0])))
    out = []
    for part in {f[0] for f in fails}:
        own, shapley = [f for f in fails if f[0] == part], Counter()
        rows = []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                lost = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(lost)
                rows.append((part, "".join(order), step, len(left), len(lost), sum(f in x[1] for x in own) - len(lost), sum(x[1] == {f} for x in own), sum(x[2] for x in lost), sum(x[3] for x in lost)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def test_audit(spark):
    rnd = random.Random(5)
    make = lambda: " ".join(rnd.choice(["a", "Bc", "d#e", *map(str, range(90))]) for _ in range(rnd.choice([5, 199, 200, 201, 400])))
    texts = [make() for _ in range(12)] + [None, "", " \t\n", "HELLO", "\x1cé " * 300, "w " * 20_000]
    docs = [(rnd.choice([k, k, k, None, 3]), rnd.choice(texts), rnd.choice(["en", "de", None, ""])) for k in range(150)]
    labels = [(rnd.randrange(160), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(200)] + [(None, 1, 1)]
    frame = documents(spark, docs)
    marks = spark.createDataFrame([(*r, "clash") for r in labels], "doc_id long, quality int, toxic int, mask string")
    got = audit.interactions(audit.masks(frame, marks))
    assert sorted(map(tuple, got.collect())) == brute_audit([(d, t, lg) for d, t, lg in docs], labels)
    none = audit.interactions(audit.masks(documents(spark, []), marks.limit(0)))
    assert none.collect() == [] and none.columns == got.columns


def test_survivors():
    counts = np.random.default_rng(3).integers(0, 9, (32, 3))
    left = audit.survivors(counts)
    for out in range(32):
        assert (left[out] == counts[[m for m in range(32) if not m & out]].sum(axis=0)).all()
