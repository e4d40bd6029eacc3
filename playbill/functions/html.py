"""Markup as Column expressions: tags, entities, anchors, embedded JSON."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def unescape(text: Column) -> Column:
    """entities become characters. Only texts with an ampersand are sent to Python."""
    return F.coalesce(_unescape(F.when(text.contains("&"), text)), text)


def unescape_all(texts: Column) -> Column:
    """F9 for an array of texts: they go through Python as one; the separator is no character of a text."""
    return F.when(F.size(texts) > 0, F.split(unescape(F.array_join(texts, "\u0001")), "\u0001")).otherwise(texts)


def strip_tags(text: Column, by: str = "") -> Column:
    """F8: tags go, or become `by`."""
    return F.regexp_replace(text, "<[^>]+>", by)


def visible_text(text: Column) -> Column:
    """F27, first part: without scripts, styles and tags, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)<script[^>]*>.*?</script>", ""), r"(?s)<style[^>]*>.*?</style>", "")
    return F.regexp_replace(strip_tags(bare, " "), r"\s+", " ")


def inner(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern over lines, null without a match."""
    return F.nullif(F.regexp_extract(text, "(?s)" + pattern, group), F.lit(""))


def all_of(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)" + pattern), F.lit(group))


def matches(texts: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """(keys, pos, start, end, match): where each match of a pattern is, in characters from 0, `end` exclusive.

    The text is parted by the pattern; a match begins where the parts and matches before it end. `keys` are a row's own, and the
    pattern, which has no look-around across its ends, never matches nothing. A null text and one without a match have no rows.
    """
    inside = f"(?s){pattern}"
    # the last part has no match after it
    each = F.arrays_zip(F.split(text, inside, -1).alias("before"), F.regexp_extract_all(text, F.lit(inside), F.lit(0)).alias("match"))
    rows = texts.select(*keys, F.posexplode(each).alias("pos", "x")).select(*keys, "pos", F.length("x.before").alias("before"), F.col("x.match").alias("match")).where("match is not null")
    end = F.sum(F.col("before") + F.length("match")).over(Window.partitionBy(*keys).orderBy("pos"))
    return rows.select(*keys, "pos", (end - F.length("match")).alias("start"), end.alias("end"), "match")


def anchors(text: Column) -> Column:
    """G1: array of (href, text) in order."""
    pattern = r'<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
    return F.arrays_zip(all_of(text, pattern, 1).alias("href"), F.transform(all_of(text, pattern, 2), lambda t: strip_tags(t)).alias("text"))


def script_json(text: Column, marker: str = "global.data = ") -> Column:
    """The JSON text that the first script with the marker assigns."""
    scripts = F.filter(all_of(text, r"<script>(.*?)</script>"), lambda s: s.contains(marker))
    found = F.try_element_at(scripts, F.lit(1))
    return F.regexp_replace(F.btrim(F.substring_index(found, marker, -1)), ";+$", "")


def localised(value: Column) -> Column:
    """a text, or the `all`, `pt` or `en` entry of a JSON object; tags stripped, trimmed."""
    entry = F.coalesce(*[F.nullif(F.get_json_object(value, f"$.{k}"), F.lit("")) for k in ("all", "pt", "en")])
    return F.nullif(F.btrim(strip_tags(F.when(value.startswith("{"), entry).otherwise(value))), F.lit(""))
