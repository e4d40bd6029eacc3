"""Entity resolution against sequential scans."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from playbill import model
from playbill.operators import merge

SESSION = ("2026-05-01", "18:00", "v", None)


def movie(title, year=None, rank=0, order=0, sessions=(SESSION,), **more):
    row = dict.fromkeys(x.split(" ")[0] for x in model.MOVIE.replace(model.SESSION, "S").split(", "))
    return row | {"id": f"{rank}_{order}", "title": title, "year": year, "genres": [], "sessions": [list(s) for s in sessions], "src_rank": rank, "src_ord": order} | more


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], model.MOVIE)


def scan_keys(years):
    """The sequential rule: which group each record of one title joins."""
    out, current = [], None
    for y in years:
        if current is not None and (y is None or current[0] is None):
            out.append(current[0])
        else:
            current = (y,)
            out.append(y)
    return out


def test_null_aware_key(spark):
    rnd, rows = random.Random(3), []
    for t in range(300):
        rows += [(f"t{t}", rnd.choice([None, 2020, 2021, 2022]), k) for k in range(rnd.randint(1, 7))]
    got = merge.null_aware_key(spark.createDataFrame(rows, "t string, y int, k int"), "t", "y", ["k"]).orderBy("t", "k").collect()
    by_title = {}
    for r in got:
        by_title.setdefault(r["t"], []).append((r["y"], r["group_year"]))
    for pairs in by_title.values():
        assert [g for _, g in pairs] == scan_keys([y for y, _ in pairs])


def test_exact_merge_fills_and_unites(spark):
    rows = [
        movie("Filme", 2020, 0, 0, [("2026-05-02", "18:00", "a", ["first"]), ("2026-05-01", "18:00", "a", None)], director=""),
        movie("FILME!", None, 1, 0, [("2026-05-02", "18:00", "a", ["second"]), ("2026-05-02", "18:00", "b", None)], director="X", duration=90),
        movie("Outro", None, 1, 1, []),
    ]
    got = {r["title"]: r for r in merge.exact_merge(frame(spark, rows)).collect()}
    assert set(got) == {"Filme", "Outro"}
    film = got["Filme"]
    assert (film["director"], film["duration"], film["year"], film["src_rank"]) == ("X", 90, 2020, 0)
    assert [(s["date"], s["cinema"], s["labels"]) for s in film["sessions"]] == [("2026-05-01", "a", None), ("2026-05-02", "a", ["first"]), ("2026-05-02", "b", None)]
    assert got["Outro"]["sessions"] == []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab1", min_size=6, max_size=10), min_size=2, max_size=40))
def test_near_keys_are_complete(spark, keys):
    keys = sorted(set(keys))
    mask = lambda s: "".join("#" if c.isdigit() else c for c in s)
    want = {(a, b) for a in keys for b in keys if a < b and min(len(a), len(b)) >= 8 and mask(a) != mask(b) and distance(a, b) <= 1}
    got = merge.near_keys(spark.createDataFrame([(k,) for k in keys], "k string")).collect()
    assert {tuple(r) for r in got} == want


def test_star_owners_follow_the_scan(spark):
    rnd = random.Random(5)
    links = {tuple(sorted(rnd.sample(range(80), 2))) for _ in range(110)}
    owner = {}
    for i in range(80):
        if i not in owner:
            for j in range(i + 1, 80):
                if (i, j) in links and j not in owner:
                    owner[j] = i
    got = merge.star_owners(spark.createDataFrame(sorted(links), "i long, j long")).collect()
    assert {r["j"]: r["owner"] for r in got} == owner
    assert merge.star_owners(spark.createDataFrame([], "i long, j long")).count() == 0


def test_equal_titles_share_their_fate(spark):
    """Popular titles are linked once; the scan over all records gives the same owners."""
    rnd = random.Random(6)
    words = ["abcdefgh", "abcdefgi", "abcdefhi", "abcdehhi", "abcdefghx", "zzzzzzzzzz"]
    nodes = [(k, rnd.choice(words), rnd.choice([None, 2000, 2001, 2002])) for k in range(70)]
    near = lambda a, b: a[1] != b[1] and distance(a[1], b[1]) <= 1 and (a[2] is None or b[2] is None or abs(a[2] - b[2]) <= 1)
    owner = {}
    for x in nodes:
        if x[0] not in owner:
            owner.update({y[0]: x[0] for y in nodes if y[0] > x[0] and y[0] not in owner and near(x, y)})
    got = merge.absorbed(spark.createDataFrame(nodes, "ord long, k string, year int")).collect()
    assert {r["ord"]: r["owner"] for r in got} == owner and len(owner) > 20


def test_fuzzy_merge(spark):
    rows = [
        movie("Projeto Global", 2025, 0, 0, [("2026-05-04", "10:00", "a", None)]),
        movie("Projecto Global", 2026, 1, 0, [("2026-05-03", "10:00", "b", None)], poster="p"),
        movie("SILVESTRE CURTAS 3", None, 1, 1),
        movie("SILVESTRE CURTAS 4", None, 1, 2),
        movie("Projeto Global", 2030, 2, 0),
    ]
    got = merge.fuzzy_merge(frame(spark, rows)).orderBy("src_rank", "src_ord").collect()
    assert [r["title"] for r in got] == ["Projeto Global", "SILVESTRE CURTAS 3", "SILVESTRE CURTAS 4", "Projeto Global"]
    assert got[0]["poster"] == "p" and [s["date"] for s in got[0]["sessions"]] == ["2026-05-04", "2026-05-03"]
    by_day = merge.fuzzy_merge(frame(spark, rows), "sorted").orderBy("src_rank", "src_ord").first()
    assert [s["date"] for s in by_day["sessions"]] == ["2026-05-03", "2026-05-04"]


def test_shortest_title_keeps_incomplete_rows(spark):
    df = spark.createDataFrame([("d", "p", "Long title", 1), ("d", "p", "Short", 2), (None, "p", "a", 3), (None, "p", "b", 4)], "d string, p string, t string, k int")
    assert {r["t"] for r in merge.shortest_title_merge(df, ["d", "p"], "t", "k").collect()} == {"Short", "a", "b"}
    assert df.where(F.lit(False)).count() == 0
