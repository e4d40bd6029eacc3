"""The keyed table and the cached refresh, keyed state in the stream, and the document written in parts."""

import datetime
import json
from pathlib import Path

import pytest
from pages import landing
from pyspark.sql import functions as F

from playbill import model
from playbill.plans import publish, refresh, sink
from playbill.sources.keyed import KeyedTable
from playbill.streaming import refresh as stream
from playbill.streaming import state

AT = datetime.datetime(2026, 3, 20, 8)
LISTED = "a string, b int, v string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_keyed_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    table = KeyedTable(spark, path, LISTED, ["a", "b"], buckets=4)
    put = lambda data, **more: table.put(spark.createDataFrame(data, LISTED), **more)
    assert rows(table.read()) == [] and not put([]) and table.manifest()[0] == 0
    first = [("x", 1, "p"), (None, 1, "q"), ("x", None, None), (None, None, "z")] + [(f"k{k}", k, "n") for k in range(40)]
    assert put([*first, first[0], ("x", 1, "a")])  # of several rows with a key the greatest
    assert rows(table.read()) == sorted(first, key=repr)
    assert not put(first) and not put(first[:2]) and table.manifest()[0] == 1 and len(table.manifest()[1]["versions"]) == 1
    assert put([("x", 1, "new"), ("x", None, None), ("y", 1, None)])
    want = sorted([("x", 1, "new"), ("y", 1, None), *first[1:]], key=repr)
    assert rows(table.read()) == want and spark.read.parquet(f"{path}/version_number=2").count() == 2  # what is the same is not written
    wanted = spark.createDataFrame([("x", None), (None, None), ("none", 3), ("x", None)], "a string, b int")
    assert set(rows(table.look_up(wanted))) == {(None, None, "z"), ("x", None, None)}
    # a run that failed before its manifest left a folder that does not count, and its number is free
    spark.createDataFrame([("x", 1, "lost", 0)], LISTED + ", key_bucket int").write.partitionBy("key_bucket").parquet(f"{path}/version_number=3/run=lost")
    assert rows(table.read()) == want
    assert put([("y", 1, "late")], tag="s", place=4) and not put([("y", 1, "again")], tag="s", place=4) and not put([("y", 1, "again")], tag="s", place=3)
    want = sorted([("y", 1, "late"), *[r for r in want if r[0] != "y"]], key=repr)
    assert rows(table.read()) == want
    before = table.read()  # a reader from before the compaction
    table.compact()
    assert rows(table.read()) == want == rows(before) and len(table.manifest()[1]["versions"]) == 1 and table.manifest()[1]["tags"] == {"s": 4}
    table.tidy()
    assert rows(table.read()) == want and [p.parent.name for p in (tmp_path / "t").glob("version_number=*/run=*")] == ["version_number=4"] and len(list((tmp_path / "t/_manifests").glob("*.json"))) == 1


def test_two_writers_do_not_lose_each_other(spark, tmp_path, monkeypatch):
    one, two = (KeyedTable(spark, f"file://{tmp_path}/t", LISTED, ["a"]) for _ in range(2))
    one.put(spark.createDataFrame([("x", 1, "p")], LISTED))
    seen = two.manifest()
    one.put(spark.createDataFrame([("y", 1, "p")], LISTED))
    monkeypatch.setattr(two, "manifest", lambda: seen)
    with pytest.raises(RuntimeError, match="another run"):
        two.put(spark.createDataFrame([("z", 1, "p")], LISTED))
    assert {r["a"] for r in one.read().collect()} == {"x", "y"}


def test_lookup_reads_the_wanted_buckets(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "s string, a string, v string", ["s", "a"], lead=("s",), buckets=64)
    table.put(spark.createDataFrame([(s, f"k{k}", "v") for s in "pq" for k in range(300)], "s string, a string, v string"))
    found = table.look_up(spark.createDataFrame([("p", "k7")], "s string, a string"))
    assert rows(found) == [("p", "k7", "v")]
    (bucket,) = {r[0] for r in found.select(table.bucket()).collect()}
    assert f"key_bucket#" in (plan := found._jdf.queryExecution().toString()) and f"= {bucket})" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert len(table.read(F.col("s") == "p").inputFiles()) > 0 and rows(table.read(F.col("s") == "q").select("s").distinct()) == [("q",)]


CATALOGUE = [("o-filme-2024", 4.0, "p.jpg", "plot", ["Drama"], "Portugal", "Rui", "rui", 2024), ("dogfight-1991", 3.0, "d.jpg", None, ["War"], None, "Nancy Savoca", "nancy", 1991)]


def test_second_run_asks_for_misses_alone(spark, tmp_path):
    none = lambda ddl: spark.createDataFrame([], ddl)
    wiki = spark.createDataFrame([("Eva & Rui", "eva.jpg", "Bio.")], model.WIKI)
    lbxd = spark.createDataFrame(CATALOGUE, model.LBXD)
    snapshots = refresh.Snapshots(lbxd, none(model.OMDB), wiki, none(model.ALIAS), none(model.ALIAS))
    caches = refresh.Caches.at(spark, f"file://{tmp_path}/cache")
    look, look_people = refresh.asking(snapshots)
    asked, people = [], []

    def ask(movies, check):
        asked.append((check, sorted((r["title"], r["year"] or 0) for r in movies.collect())))
        return look(movies, check)

    def ask_people(names):
        people.append(sorted(r["name"] for r in names.collect()))
        return look_people(names)

    every = refresh.merged(landing(spark, ("cinemateca", "culturgest", "sao_jorge", "batalha", "trindade", "ideal")), none(model.MOVIE), F.lit(datetime.date(2026, 3, 20)))
    run = lambda movies: refresh.enrich_cached(movies, caches, ask, ask_people)
    # one film is missing at first
    movies, directors = run(every.where("title <> 'Dogfight'"))
    filled = {r["title"]: r for r in movies.collect()}
    assert len(filled) > 2 and len(asked) == 1 and asked[0][0] and {t for t, _ in asked[0][1]} == set(filled)
    assert filled["O Filme"]["plot"] == "plot" and {r["name"]: r["photo"] for r in directors.collect()}["Eva & Rui"] == "eva.jpg"
    first = people.pop()
    assert set(first) == {r["director"] for r in filled.values() if r["director"]} and asked.pop()
    movies, _ = run(every)
    assert [(c, {t for t, _ in m}) for c, m in asked] == [(True, {"Dogfight"})] and people.pop() == ["Nancy Savoca"]
    # everything is known now, also what the catalogues lack; what lacks a description is asked for again, whatever the director
    asked.clear()
    again, directors = run(every)
    assert rows(again.select("id", "plot", "rating")) == rows(movies.select("id", "plot", "rating")) and not people
    assert [(c, {t for t, _ in m}) for c, m in asked] == [(False, {"Dogfight"})]
    assert {r["name"]: r["bio"] for r in directors.collect()}["Eva & Rui"] == "Bio."
    # the same as without caches
    plain = refresh.E.enrich(every, snapshots.lbxd, snapshots.omdb, snapshots.lbxd_aliases, snapshots.omdb_aliases)
    assert rows(plain.drop("sessions")) == rows(again.drop("sessions"))


def test_stale_answers_are_asked_for_without_the_director(spark, tmp_path):
    movies = spark.createDataFrame([("1", "A", 2000, "Ana Sá", 0, 0), ("2", "A", 2000, "Other", 0, 1), ("3", "B", None, None, 1, 0)], "id string, title string, year int, director string, src_rank int, src_ord int")
    table = KeyedTable(spark, f"file://{tmp_path}/t", refresh.ANSWER, ["title", "year"])
    calls = []

    def ask(asked, check):
        calls.append((check, sorted(r["id"] for r in asked.collect())))
        full = None if check else "new"
        found = asked.where("title = 'A'").select("id", "src_rank", "src_ord", F.lit(1.0).alias("rating"), F.lit("p").alias("poster"), F.lit(full).cast("string").alias("description"), F.lit(None).cast("array<string>").alias("genres"), F.lit("x").alias("country"), F.lit("d").alias("lb_director"), F.lit("s").alias("lb_director_slug"), F.lit(1).alias("lb_year"))
        omdb = asked.where("title = 'C'").select("id", "src_rank", "src_ord", *[F.lit(None).cast("string").alias(c.split()[0]) for c in refresh.E.OMDB_ANSWER.split(", ")])
        return found, omdb

    told = lambda: {r["title"]: r["lbxd"] and r["lbxd"]["description"] for r in refresh.answers(movies, table, ask).collect()}
    assert told() == {"A": None, "B": None} and calls == [(True, ["1", "3"])]
    assert told() == {"A": "new", "B": None} and calls[1:] == [(False, ["1"])]
    assert told() == {"A": "new", "B": None} and len(calls) == 2


# -- the stream -----------------------------------------------------------------------------------------------------


def drain(df, sink_rows, checkpoint, mode="update"):
    def keep(batch, number):
        sink_rows.append(sorted(map(tuple, batch.collect()), key=repr))

    df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_changed_pages_over_restarts(spark, tmp_path):
    state.with_state_store(spark)
    at = lambda h: AT + datetime.timedelta(hours=h)
    arrivals = [
        [("s", "u", at(1), 200, "old"), ("s", "v", at(1), 200, "v"), ("s", "u", at(0), 200, "older"), (None, "x", at(1), 200, "x"), ("s", "w", at(1), 500, "")],
        [("s", "u", at(2), 200, "new"), ("s", "v", at(3), 200, "v"), ("s", "v", at(4), 500, "bad")],
        [("s", "u", at(1), 200, "late"), ("t", "u", at(1), 200, "t"), ("s", "v", None, 200, "x")],
    ]
    want = [{("s", "u", "old"), ("s", "v", "v")}, {("s", "u", "new")}, {("t", "u", "t")}]
    for k, some in enumerate(arrivals):
        spark.createDataFrame(some, model.LANDING).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = []
        drain(state.changed_pages(spark.readStream.schema(model.LANDING).parquet(f"{tmp_path}/in")), out, f"{tmp_path}/ck")
        assert {(r[0], r[1], r[4]) for batch in out for r in batch} == want[k]


def test_last_good_movies(spark, tmp_path):
    state.with_state_store(spark)
    arrivals = [[("a", 1, ["m1", "m2"]), ("b", 1, []), (None, 1, ["x"])], [("a", 2, []), ("b", 2, ["n"])], [("a", 1, ["late"]), ("a", 2, ["twice"])], [("a", 3, ["m3"]), ("a", 4, None)]]
    want = [[("a", 1, ["m1", "m2"], False)], [("a", 2, ["m1", "m2"], True), ("b", 2, ["n"], False)], None, None]
    for k, some in enumerate(arrivals):
        spark.createDataFrame(some, state.LISTED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = []
        drain(state.last_good(spark.readStream.schema(state.LISTED).parquet(f"{tmp_path}/in")), out, f"{tmp_path}/ck")
        if want[k] is not None:
            assert sorted(r for batch in out for r in batch) == want[k]


def test_a_batch_reads_what_it_touches(spark, tmp_path):
    """Sources that a batch does not change are neither read nor written again."""
    seen = {}
    args = (f"{tmp_path}/in", f"file://{tmp_path}/pages", f"file://{tmp_path}/ck", lambda pages, number: seen.update({number: {(r["source"], r["url"]): r["body"] for r in pages.collect()}}))
    first = [(s, f"u{k}", AT, 200, f"{s}{k}") for s in "abc" for k in range(20)]
    second = [("b", "u3", AT + datetime.timedelta(hours=1), 200, "new"), ("c", "u4", AT + datetime.timedelta(hours=1), 500, None)]
    for some in (first, second):
        spark.createDataFrame(some, model.LANDING).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream.listen(spark, *args).awaitTermination()
    assert len(seen) == 2 and len(seen[0]) == 60 and set(seen[1]) == {("b", f"u{k}") for k in range(20)} and seen[1]["b", "u3"] == "new"
    assert spark.read.parquet(f"{tmp_path}/pages/version_number=2").count() == 1


# -- the document ---------------------------------------------------------------------------------------------------


def document_tables(spark, n):
    movie = lambda k: (f"m{k}", f"Título \"{k}\"\n", None, 2000 + k % 5 if k % 3 else None, None, None, None, ["Drama"] if k % 2 else [], "l", [("2026-03-25", "21:30", "x", None)], None, None, None, None, k % 4, k // 4)
    movies = spark.createDataFrame([movie(k) for k in range(n)], model.MOVIE).repartition(7)
    names = [f"Ana {k}" for k in range(n // 2)] + (["Zé " + "x" * (1_100_000 if n == 1 else 10_000)] if n else [])
    people = spark.createDataFrame([(name, None, "p.jpg", None) for name in names], "name string, lbxd_slug string, photo string, bio string")
    return movies, people, spark.createDataFrame([("a", "x"), ("b", "y: \"z\"")][: n and 2], model.ERROR)


@pytest.mark.parametrize("n", [0, 1, 300])
def test_document_in_parts_has_the_same_bytes(spark, tmp_path, n):
    tables = document_tables(spark, n)
    sink.write_document(*tables, "2026-03-20T10:00:00Z", f"file://{tmp_path}/doc")
    written = (tmp_path / "doc/document.txt").read_bytes()
    publish.publish(publish.document(*tables, "2026-03-20T10:00:00Z"), f"file://{tmp_path}/one")
    (one,) = (tmp_path / "one").glob("part-*")
    assert written == one.read_bytes()
    whole = json.loads(written.decode().removeprefix(publish.PREFIX).rstrip().removesuffix(";"))
    assert len(whole["movies"]) == n and len(whole["directors"]) == n // 2 + bool(n)
    if n != 1:  # a reader of JSON takes no key of a million characters
        assert rows(publish.previous(spark, f"file://{tmp_path}/doc").select("id")) == sorted((f"m{k}",) for k in range(n))
    sink.write_dump(tables[0], 2, f"file://{tmp_path}/dump")
    assert [m["id"] for m in json.loads((tmp_path / "dump/document.txt").read_text())] == [f"m{k}" for k in range(2, n, 4)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["doc", "dump", "one"]


def test_a_document_is_read_back_in_parts(spark, tmp_path):
    path, small = f"file://{tmp_path}/doc", {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "0"}
    n = 300
    sink.write_document(*document_tables(spark, n), "2026-03-20T10:00:00Z", path)
    text = (tmp_path / "doc/document.txt").read_text()
    whole = json.loads(text.removeprefix(publish.PREFIX).rstrip().removesuffix(";"))
    want = [(k, m["id"], m["title"], m["sessions"][0]["time"]) for k, m in enumerate(whole["movies"])]

    def read(path=path):
        back = publish.previous(spark, path)
        return back, [(r["src_ord"], r["id"], r["title"], r["sessions"][0]["time"]) for r in back.orderBy("src_ord").collect()]

    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        back, got = read()
        assert got == want
        # not one task with the whole of it
        assert back.rdd.getNumPartitions() > 1
        # other layouts give the same, a document that breaks off nothing
        layouts = {"indented": json.dumps(whole, ensure_ascii=False, indent=2), "compact": json.dumps(whole, ensure_ascii=False, separators=(",", ":")), "two": json.dumps(whole, ensure_ascii=False, separators=(",", ":")).replace('},{"id":"m8"', '},\n{"id":"m8"', 1)}
        for name, body in layouts.items():
            (tmp_path / name).mkdir()
            (tmp_path / name / "document.txt").write_text(f"{publish.PREFIX}{body};")
            assert read(f"file://{tmp_path}/{name}")[1] == want
        (tmp_path / "cut").mkdir()
        (tmp_path / "cut/document.txt").write_text(text[: len(text) // 2])
        assert publish.previous(spark, f"file://{tmp_path}/cut").count() == 0
    finally:
        for k in small:
            spark.conf.unset(k)


def test_a_document_that_fails_leaves_the_earlier_one(spark, tmp_path):
    path = f"file://{tmp_path}/doc"
    tables = document_tables(spark, 5)
    sink.write_document(*tables, "then", path)
    before = (tmp_path / "doc/document.txt").read_bytes()
    broken = tables[0].withColumn("title", F.when(F.col("id") == "m3", F.raise_error(F.lit("no title"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="no title"):
        sink.write_document(broken, *tables[1:], "now", path)
    assert (tmp_path / "doc/document.txt").read_bytes() == before and not [p for p in Path(tmp_path).rglob(".*") if p.is_dir()]
