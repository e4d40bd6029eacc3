"""Ordered operators, enrichment rules, streaming, and the registered queries against DuckDB."""

import datetime
import os
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from playbill import model, registry
from playbill.operators import enrich, ordered
from playbill.streaming import refresh as stream

SMALL = "/root/testdata/sf0.001"


def test_asof_is_strict_and_keeps_nulls(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, "b", 1), (4, None, 9)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 3, "x"), ("a", 5, "y"), ("b", 1, "z")], "k string, t int, v string")
    got = {r["id"]: r["prev_v"] for r in ordered.asof_before(left, right, "k", "t", ["v"]).collect()}
    assert got == {1: "x", 2: None, 3: None, 4: None}


def test_ranked_pick_prefers_tiers(spark):
    df = spark.createDataFrame([("a", 1, None, "p"), ("a", 2, 3.0, None), ("b", 1, None, "p"), ("c", 1, None, None)], "k string, pos int, rating double, poster string")
    got = ordered.ranked_pick(df, ["k"], [F.col("rating").isNotNull(), F.col("poster").isNotNull()], ["pos"]).collect()
    assert {(r["k"], r["pos"]) for r in got} == {("a", 2), ("b", 1)}


def test_lists_and_maps(spark):
    df = spark.createDataFrame([(1, [2, 9, 1]), (2, [])], "id int, ids array<int>")
    dim = spark.createDataFrame([(1, "one"), (2, "two"), (9, "")], "did int, name string")
    assert {r["id"]: r["names"] for r in ordered.joined_list(df, "ids", dim, "did", "name", ["id"]).collect()} == {1: "two, one", 2: None}
    row = spark.range(1).select(ordered.map_order(F.expr("map('x', 2, 'a', 1)")).alias("m"), ordered.padded(F.array(F.lit("t"), F.lit("u")), F.array(F.lit(7))).alias("p")).first()
    assert row["m"] == ["a", "x"] and [tuple(x) for x in row["p"]] == [("t", 7), ("u", 7)]


def test_candidates_follow_the_order(spark):
    movies = spark.createDataFrame([("1", "A Alegria (La gioia)", "Ana Sá", 2020, 0, 0), ("2", "Nostalgia (1983)", None, None, 0, 1)], "id string, title string, director string, year int, src_rank int, src_ord int")
    none = spark.createDataFrame([], model.ALIAS)
    slugs = {}
    for r in enrich.lbxd_candidates(enrich.with_alias(movies, none, "alias_slug")).orderBy("id", "pos").collect():
        slugs.setdefault(r["id"], []).append(r["slug"])
    assert slugs["1"] == ["la-gioia-2020", "la-gioia-2019", "la-gioia-2018", "la-gioia", "a-alegria-2020", "a-alegria-2019", "a-alegria-2018", "a-alegria"]
    assert slugs["2"] == ["nostalgia"]
    alias = spark.createDataFrame([("A ALEGRIA", "first", 1), ("A ALEGRIA", "second", 2)], model.ALIAS)
    tries = enrich.omdb_attempts(enrich.with_alias(movies, alias, "alias_title")).where("id = '1'").orderBy("pos").collect()
    assert [(r["query_title"], r["query_year"]) for r in tries] == [("La gioia", 2020), ("La gioia", 2019), ("La gioia", 2018), ("La gioia", None), ("second", 2020), ("second", 2019), ("second", 2018), ("second", None)]


def test_cache_refresh(spark):
    ddl = "title string, year int, slug string, description string, country string"
    cache = spark.createDataFrame([("a", 1, "s", None, None), ("b", None, None, None, None), ("c", 2, "s", "d", "e")], ddl)
    fresh = spark.createDataFrame([("a", 1, "s", "new", "x"), ("c", 2, "s", "no", "no")], ddl)
    assert {r["title"]: r["description"] for r in enrich.refreshed(cache, fresh).collect()} == {"a": "new", "b": None, "c": "d"}


def test_stream_keeps_the_newest_page(spark, tmp_path):
    at = lambda h: datetime.datetime(2026, 1, 1, h)
    seen = {}

    def keep(landing, number):
        seen[number] = {r["url"]: r["body"] for r in landing.collect()}

    for k, rows in enumerate([[("s", "u", at(1), 200, "old"), ("s", "v", at(1), 200, "v")], [("s", "u", at(2), 200, "new"), ("s", "v", at(3), 500, "")]]):
        spark.createDataFrame(rows, model.LANDING).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream.listen(spark, f"{tmp_path}/in", f"{tmp_path}/state", f"{tmp_path}/ck", keep).awaitTermination()
        assert seen[k]["u"] == ("old", "new")[k] and seen[k]["v"] == "v"
    events = spark.createDataFrame([(at(1), "x"), (at(1), "x"), (at(3), "y")], "ts timestamp, event_type string")
    assert {r["event_type"]: r["n"] for r in stream.rolling_counts(events).collect()} == {"x": 2, "y": 1}


def test_landing_source_reads_files(spark, tmp_path):
    from playbill.sources.landing import LandingSource

    (tmp_path / "p.html").write_text("<p>hi</p>")
    spark.dataSource.register(LandingSource)
    rows = spark.read.format("landing").option("source", "s").option("urls", f"file://{tmp_path}/p.html\nfile://{tmp_path}/none").load().collect()
    assert sorted((r["status"] or 0, r["body"] or "") for r in rows) == [(0, ""), (200, "<p>hi</p>")]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in Path(SMALL).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = duck.sql(f"select {', '.join(columns)} from ({registry.ORACLE_SQL[name]})").fetchall()
    rows = [tuple(plain(v) for v in r) for r in got.select(*columns).collect()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(plain(v) for v in r)) for r in want)


def test_map_order_refs_of_every_order(spark, duck):
    got = {r["o_orderkey"] for r in registry.QUERIES["q27_map_order_refs"](spark, SMALL).select("o_orderkey").distinct().collect()}
    assert got == {r[0] for r in duck.sql("select distinct l_orderkey from lineitem").fetchall()} and max(got) > 400


def test_norm_key_goes_to_the_end_of_the_text(spark, tmp_path):
    rows = [(1, "a" * 60 + "É b"), (2, "a" * 60 + "é  c!"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in registry.QUERIES["q01_norm_key"](spark, str(tmp_path)).collect()}
    assert got[1]["n_chars"] == 63 and got[1]["digest"] != got[2]["digest"] and got[2]["n_chars"] == 63 and got[3]["n_chars"] == 0


def test_star_owners_of_whole_titles(spark, duck):
    """The sequential scan over the pairs that SQL finds, for the first records of equal titles."""
    before, owners = {}, {}
    for i, j in duck.sql(f"select i, j from ({registry.ORACLE_SQL['q04_fuzzy_pairs']})").fetchall():
        before.setdefault(j, []).append(i)
    for j in sorted(before):
        leaders = [i for i in before[j] if i not in owners]
        if leaders:
            owners[j] = min(leaders)
    got = {r["ord"]: r["owner"] for r in registry.QUERIES["q05_fuzzy_star_owner"](spark, SMALL).collect()}
    assert owners and {k: v for k, v in got.items() if k in owners} == owners and set(got.values()) == set(owners.values())


def test_fuzzy_titles_are_not_cut(spark, tmp_path):
    long = "a very long title of a part without an end"
    rows = [(1, f"{long} worn", 1), (27, f"{long} worn", 1), (53, f"{long} work", 9), (3, f"{long} other", 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert {tuple(r) for r in registry.QUERIES["q04_fuzzy_pairs"](spark, str(tmp_path)).collect()} == {(1, 27)}


def test_lists_and_names_are_not_cut(spark, tmp_path):
    text = "w " * 150 + "a, b, " + "c" * 300 + ", d"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    long = "a name of a part with more than thirty letters"
    spark.createDataFrame([(1, long, "letters"), (2, f"{long} and more", long)], "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert run("q31_genre_topk")[0]["g3"] == "c" * 300
    assert [r["item"] for r in run("q28_parallel_pad")] == text.split(" ")
    assert [(r["agrees"], r["overrun"]) for r in sorted(run("q30_name_guards"))] == [(True, False), (True, False)]


def test_every_current_order_stays(spark, duck):
    got = {r["o_orderkey"] for r in registry.QUERIES["q24_source_fallback"](spark, SMALL).collect()}
    want = duck.sql("select o_orderkey, o_custkey % 10 from orders where o_orderdate >= DATE '1998-07-01'").fetchall()
    assert got >= {k for k, _ in want} and any(m >= 6 for _, m in want)


def test_entry(spark):
    import __spark_entry__ as entry

    if os.path.isdir(SMALL):
        assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
