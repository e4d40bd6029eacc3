"""Column functions on worked examples."""

import datetime
import unicodedata

import pytest
from pyspark.sql import functions as F

from playbill.functions import html, temporal, text
from playbill.functions.truthy import first_truthy, truthy

ASOF = datetime.date(2026, 3, 20)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "fn, given, expected",
    [
        (text.norm_key, "A-B  Ção!", "ab cao"),
        (text.norm_key, None, ""),
        (text.clean_title, "Spider-Man", "Spider"),
        (text.clean_title, "A Alegria (La gioia)", "A Alegria"),
        (text.title_slug, "La  Gioia é", "la-gioia-e"),
        (text.title_case, "THE SHINING", "The Shining"),
        (text.title_case, "DON'T LOOK", "Don’t Look"),
        (text.title_case, "The MAN", "The MAN"),
        (text.word_case, "RIVER'S EDGE", "River's Edge"),
        (text.venue_slug, "O Velho e a Espáda!", "O-VELHO-E-A-ESPADA"),
        (text.id_slug, "São Tomé", "s_o_tom_"),
        (text.capital_first, "com x", "Com x"),
        (text.presence_label, "Presença dos actores X, Y, Z, o produtor W e outros", "Presença da equipa e elenco"),
        (text.presence_label, "Presença do realizador X, Y", "Presença do realizador e equipa"),
        (text.presence_label, "curta", "curta"),
        (text.info_label, "SESSÃO com a presença de X", "Com a presença de X"),
        (text.info_label, "nada", None),
        (text.first_sentences, "A b. C d! E? F", "A b. C d! E?"),
        (text.last_segment, "https://a/b/c/", "c"),
        (text.path_only, "/a/b/?x#y", "/a/b"),
        (temporal.pt_time, "21h00", "21:00"),
        (temporal.minutes, "2h02", 122),
        (temporal.minutes, "1h30", 90),
        (temporal.minutes, "2h", None),
        (temporal.minutes, "95min", 95),
        (html.strip_tags, "<b>x</b>y", "xy"),
        (html.localised, '{"pt": "<i>olá</i> "}', "olá"),
        (html.localised, " x ", "x"),
    ],
)
def test_examples(spark, fn, given, expected):
    assert one(spark, fn(F.col("t")), t=given) == expected


def test_norm_covers_every_latin_letter(spark):
    letters = [chr(c) for c in range(0x80, 0x2000) if (d := unicodedata.normalize("NFD", chr(c).lower())) and d[0].isascii() and d[0].isalnum() and all(unicodedata.combining(x) for x in d[1:])]
    got = spark.createDataFrame([(c,) for c in letters], "t string").select(text.norm_key(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [unicodedata.normalize("NFD", c.lower())[0] for c in letters]


def test_dates(spark):
    assert one(spark, temporal.pt_date(F.col("t"), F.lit(ASOF)), t="qua, 25 mar") == "2026-03-25"
    assert one(spark, temporal.pt_date(F.col("t"), F.lit(ASOF)), t="sex, 2 jan") == "2027-01-02"
    assert one(spark, temporal.pt_date(F.col("t"), F.lit(ASOF)), t="seg, 30 fev") is None
    assert tuple(one(spark, temporal.en_date_time(F.col("t")), t="13 MAY 2026 WED 19:00")) == ("2026-05-13", "19:00")
    assert tuple(one(spark, temporal.en_date_time(F.col("t")), t="30 APR – 10 MAY 2026")) == (None, None)
    assert len(one(spark, temporal.day_range(F.col("t")), t="30 APR – 10 MAY 2026")) == 11
    assert one(spark, temporal.day_range(F.col("t")), t="30 DEC – 2 JAN 2026") == []
    assert tuple(one(spark, temporal.heading_time(F.col("t")), t="May 02 2026, Saturday, 15:00 (96')")) == ("2026-05-02", "15:00", 96)
    assert tuple(one(spark, temporal.slashed_date_time(F.col("t")), t="25/03/2026, 15h30 | Sala")) == ("2026-03-25", "15:30")
    stamp = F.lit("2026-07-01 20:00:00").cast("timestamp")
    assert one(spark, F.date_format(temporal.lisbon_time(stamp), "HH:mm")) == "22:00"
    assert one(spark, F.date_format(temporal.lisbon_time(stamp, civil=True), "HH:mm")) == "21:00"


def test_titles(spark):
    assert tuple(one(spark, text.indie_title(F.col("t"), {}), t="INDIE BARRIO TRISTE 138")) == ("Barrio Triste", True)
    assert tuple(one(spark, text.indie_title(F.col("t"), {"X 1": "y"}), t="X 1")) == ("y", True)
    assert tuple(one(spark, text.indie_title(F.col("t"), {}), t="Plain")) == ("Plain", False)
    assert tuple(one(spark, text.special_suffix(F.col("t")), t="Filme | sessão de abertura")) == ("Filme", "Sessão de Abertura")
    assert tuple(one(spark, text.special_suffix(F.col("t")), t="Filme")) == ("Filme", None)
    assert one(spark, text.is_multi_title(F.col("t")), t="MAVRO + ASPRO") is False
    assert one(spark, text.is_multi_title(F.col("t")), t="SOFT AND HARD + JLG/JLG") is False
    assert one(spark, text.is_multi_title(F.col("t")), t="A LONG FIRST TITLE + A SECOND ONE") is True
    assert one(spark, text.overruns(F.col("a"), F.col("b")), a="SEN", b="Sen Kimsin?") is True
    assert one(spark, text.last_word_in(F.col("a"), F.col("b")), a="João César Monteiro", b="J. C. MONTEIRO") is True
    assert one(spark, text.comma_parts(F.col("t"), 2), t=" a, ,b ,c") == ["a", "b"]
    assert one(spark, text.bad_poster(F.col("t")), t="https://x/Captura-de-ECRA.png") is True
    assert one(spark, html.unescape(F.col("t")), t="a &amp; &#39;b&#39;") == "a & 'b'"
    assert one(spark, html.script_json(F.col("t")), t='<script>x; global.data = {"a": 1};</script>') == '{"a": 1}'


def test_missing_values(spark):
    df = spark.createDataFrame([(None, "", 0, []), ("N/A", "x", 2, ["g"])], "a string, b string, n int, g array<string>")
    got = df.select(truthy("b"), truthy("n", "number"), truthy("g", "array"), first_truthy("a", "b", sentinel="N/A")).collect()
    assert [tuple(r) for r in got] == [(False, False, False, None), (True, True, True, "x")]


def test_a_range_of_days_is_worked_out_once(spark):
    for text, days in (("28 FEB - 2 MAR 2024", ["2024-02-28", "2024-02-29", "2024-03-01", "2024-03-02"]), ("5 MAY–5 June 0001", 32), ("30 FEB – 2 MAR 2026", []), ("1 XXX – 2 MAR 2026", []), ("0 MAY – 2 MAY 2026", []), ("1 MAY – 2 MAY 0000", []), ("x", []), (None, [])):
        got = one(spark, temporal.day_range(F.col("t")), t=text)
        assert len(got) == days if isinstance(days, int) else got == days
    # how often the plan names the text is how often it is made for each row
    plan = spark.createDataFrame([("x",)], "t string").select(temporal.day_range(F.upper("t")).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1


def test_day_ranges_are_not_dealt_out_row_by_row(spark):
    from playbill import registry

    df = registry.QUERIES["q42_day_range"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortAggregate" not in plan and "HashAggregate" in plan
