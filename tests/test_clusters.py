"""Components and greedy clusters, payloads without a schema, names in every script, spans, figures taken while writing."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from playbill.functions import html as H
from playbill.functions import payload as P
from playbill.functions import text as X
from playbill.operators import components, enrich, merge
from playbill.plans import publish, sink


def owners_of(links):
    """The sequential scan."""
    out = {}
    for j, i in sorted({(j, i) for i, j in links}):
        if j not in out and i not in out:
            out[j] = i
    return out


def got_owners(spark, links):
    frame = spark.createDataFrame(links, "i long, j long") if isinstance(links, list) else links
    return {r["j"]: r["owner"] for r in merge.star_owners(frame).collect()}


@pytest.mark.parametrize("most", [500_000, 3])
def test_star_owners_equal_the_sequential_scan(spark, monkeypatch, most):
    monkeypatch.setattr(merge, "COMPONENT", most)  # with 3 nearly all are settled in rounds
    rnd = random.Random(4)
    links = [tuple(sorted(rnd.sample(range(k * 20, k * 20 + 9), 2))) for k in range(12) for _ in range(9)]
    assert got_owners(spark, links + links[:5]) == owners_of(links)
    assert got_owners(spark, []) == {}


def test_a_chain_of_ten_thousand_titles(spark):
    links = [(k, k + 1) for k in range(10_000)]
    assert got_owners(spark, links) == {k: k - 1 for k in range(1, 10_001, 2)}


def test_components_of_a_star_of_a_million(spark):
    links = spark.range(1, 1_000_001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v")).unionByName(spark.createDataFrame([(-5, -7), (-7, -9), (None, 3), (4, None), (6, 6)], "u long, v long"))
    found, _ = components.components(links)
    assert found.count() == 1_000_002 and found.where("node > 0").select("root").distinct().collect()[0][0] == 0
    assert {(r["node"], r["root"]) for r in found.where("node < 0").collect()} == {(-5, -9), (-7, -9)}


def test_scanned_is_the_sequential_scan():
    links = pd.DataFrame({"i": [1, 2, 1, 3], "j": [2, 3, 4, 4]})
    assert dict(merge.scanned(links).values.tolist()) == {2: 1, 4: 1} == owners_of(links.values.tolist())


def test_hydration_payload(spark):
    rows = [
        (1, '[3, "x", "[1]", "{bad", "{\\"slug\\": \\"s\\", \\"title\\": \\"T\\", \\"year\\": \\"2025\\", \\"sessions\\": [{\\"date\\": \\"d\\"}, {\\"time\\": {\\"start\\": \\"21:30\\"}}], \\"more\\": [1]}", "{\\"slug\\": \\"no sessions\\"}"]'),
        (2, "no json"), (3, None), (4, "{}"), (5, "[]"), (6, '["{\\"sessions\\": []}", null]'),
    ]
    found = P.film_records(spark.createDataFrame(rows, "id int, js string"))
    (film,) = found.select("id", "ord", "slug", "title", "year").collect()
    assert tuple(film) == (1, 4, "s", "T", 2025)
    shown = P.entries(found, "sessions").select("pos", P.at(F.col("entry"), "$.date").alias("date"), P.at(F.col("entry"), "$.time.start").alias("start")).orderBy("pos")
    assert [tuple(r) for r in shown.collect()] == [(0, "d", None), (1, None, "21:30")]
    fields = P.entries(spark.createDataFrame([(1, '{"b": 1, "a": {"c": "x"}}'), (2, None)], "id int, js string").withColumn("v", P.variant(F.col("js"))), "v")
    assert [(r["key"], r["k"]) for r in fields.select("key", F.col("entry").cast("string").alias("k")).orderBy("key").collect()] == [("a", '{"c":"x"}'), ("b", "1")]


def test_names_agree_in_every_script(spark):
    pairs = [("ÉRIC Ø", "eric ø", True), ("Сергей ЭЙЗЕНШТЕЙН", "сергей эйзенштейн", True), ("ΘΌΔΩΡΟΣ", "θοδωρος", True), ("黒澤 明", "黒澤 明", True), ("Ana", "Anna", False), ("İpek", "ipek", True)]
    rows = spark.createDataFrame(pairs, "a string, b string, same boolean").select("*", (X.folded(F.col("a")) == X.folded(F.col("b"))).alias("got"))
    assert all(r["got"] == r["same"] for r in rows.collect())
    pages = spark.createDataFrame([], "name string, photo string, extract string")
    search = spark.createDataFrame([("ЛАРИСА", 0, "Q1", "Other"), ("ЛАРИСА", 1, "Q2", "лариса"), ("Zoë", 0, "Q3", "Zoe")], "name string, pos int, id string, label string")
    entities = spark.createDataFrame([("Q1", "1", "a"), ("Q2", "2", "b"), ("Q3", "3", "c")], "id string, photo string, description string")
    assert {r["name"]: r["photo"] for r in enrich.wiki_entries(pages, search, entities).collect()} == {"ЛАРИСА": "2", "Zoë": "3"}


def test_match_spans(spark):
    texts = ["ab<x>c<y>", "<x>", "none", "", None, "é<😀>\n<b\nc><><x><x>tail"]
    found = H.matches(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), ["id"], "text", "<[^>]*>").collect()
    want = [(k, n, m.start(), m.end(), m.group()) for k, t in enumerate(texts) for n, m in enumerate(re.finditer("<[^>]*>", t or ""))]
    assert sorted(map(tuple, found)) == want


def test_figures_are_taken_while_the_document_is_written(spark, tmp_path):
    from test_state import document_tables

    movies, people, errors = document_tables(spark, 30)
    figures = sink.write_document(movies, people, errors, "now", f"file://{tmp_path}/doc")
    plain = publish.metrics(movies, errors).first()
    assert (figures["movies"], figures["sessions"], figures["failed"]) == tuple(plain) == (30, 30, ["a", "b"])
