"""Lookups in catalogue snapshots, and which value wins for each field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bad_poster, clean_title, comma_parts, last_word_in, overruns, strip_accents, title_slug
from ..functions.truthy import first_truthy, truthy
from .ordered import last_wins, ranked_pick

KEY = ["id", "src_rank", "src_ord"]
#: The columns that the two lookups give besides KEY.
LBXD_ANSWER = "rating DOUBLE, poster STRING, description STRING, genres ARRAY<STRING>, country STRING, lb_director STRING, lb_director_slug STRING, lb_year INT"
OMDB_ANSWER = ", ".join(f"om_{c} STRING" for c in ("Response", "Title", "Year", "Director", "Poster", "Genre", "Plot", "Country", "Runtime"))


def original_title(title: Column) -> Column:
    """The part in parentheses, unless it is a bare year."""
    inner = F.regexp_extract(title, r"\(([^)]+)\)", 1)
    return F.when((inner != "") & ~inner.rlike(r"^\s*\d{4}\s*$"), F.btrim(inner))


def alias_keys(title: Column) -> Column:
    """The four spellings that alias tables are asked for, best first."""
    clean = F.upper(clean_title(title))
    return F.array(F.upper(title), F.upper(strip_accents(title)), clean, strip_accents(clean))


def with_alias(movies: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """Adds the alias by the best of the four keys; later entries of the table replace earlier ones."""
    table = last_wins(aliases, "key", "value", "ordinal")
    asked = movies.select(*KEY, F.posexplode(alias_keys(F.col("title"))).alias("pos", "key"))
    found = asked.join(table, "key").groupBy(*KEY).agg(F.min_by("value", "pos").alias(name))
    return movies.join(found, KEY, "left")


def _years(text: Column, year: Column, back: int = 2) -> Column:
    """struct(text, year) for the year and the `back` years before."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(back)), lambda k: F.struct(text.alias("text"), (year - k).alias("year")))
    return F.when(text.isNotNull() & year.isNotNull(), spread).otherwise(F.array().cast("array<struct<text: string, year: int>>"))


def _plain(text: Column) -> Column:
    return F.when(text.isNotNull(), F.array(F.struct(text.alias("text"), F.lit(None).cast("int").alias("year")))).otherwise(F.array().cast("array<struct<text: string, year: int>>"))


def lbxd_candidates(movies: DataFrame) -> DataFrame:
    """(KEY, pos, slug): alias, then slugs of the original and of the clean title, with the year and two before, then bare."""
    dated = lambda t: F.transform(_years(t, F.col("year")), lambda x: F.concat(x["text"], F.lit("-"), x["year"].cast("string")))
    bare = lambda t: F.transform(_plain(t), lambda x: x["text"])
    original = F.nullif(title_slug(original_title(F.col("title"))), F.lit(""))
    clean = F.nullif(title_slug(clean_title(F.col("title"))), F.lit(""))
    slugs = F.concat(bare(F.col("alias_slug")), dated(original), bare(original), dated(clean), bare(clean))
    return movies.select(*KEY, "director", F.posexplode(F.array_distinct(slugs)).alias("pos", "slug"))


def lbxd_lookup(movies: DataFrame, catalogue: DataFrame, aliases: DataFrame, check_director: bool = True) -> DataFrame:
    """KEY and the catalogue's columns: the first candidate with a rating, else the first with a poster, whose director agrees."""
    asked = lbxd_candidates(with_alias(movies, aliases, "alias_slug"))
    found = asked.join(catalogue, "slug")
    if check_director:
        known = truthy("director") & truthy("lb_director")
        found = found.where(~known | last_word_in(F.col("lb_director"), F.col("director")))
    return ranked_pick(found, KEY, [truthy("rating", "number"), truthy("poster")], ["pos"]).drop("director", "pos", "slug")


def omdb_attempts(movies: DataFrame) -> DataFrame:
    """(KEY, director, pos, query_title, query_year), first-seen order without repeats."""
    title, year = F.col("title"), F.col("year")
    original, alias = original_title(title), F.col("alias_title")
    clean = clean_title(title)
    bare = F.when(strip_accents(clean) != clean, strip_accents(clean))
    by_year = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.concat(*[F.transform(_plain(t), lambda x: F.struct(x["text"].alias("text"), (year - k).alias("year"))) for t in (clean, bare)])))
    none = F.array().cast("array<struct<text: string, year: int>>")
    aliased = F.concat(_years(alias, year), _plain(alias))
    from_original = F.concat(_years(original, year), _plain(original), aliased)
    dated = F.when(year.isNotNull(), F.concat(by_year, _years(alias, year), _plain(clean))).otherwise(none)
    attempts = F.when(original.isNotNull(), from_original).otherwise(F.concat(dated, _plain(clean), _plain(bare), _plain(alias)))
    return movies.select(*KEY, "director", F.posexplode(F.array_distinct(attempts)).alias("pos", "a")).select(*KEY, "director", "pos", F.col("a.text").alias("query_title"), F.col("a.year").alias("query_year"))


def omdb_lookup(movies: DataFrame, catalogue: DataFrame, aliases: DataFrame) -> DataFrame:
    """KEY and the catalogue's columns of the first attempt that passes B18, B19 and B20."""
    asked = omdb_attempts(with_alias(movies, aliases, "alias_title"))
    records = catalogue.withColumnsRenamed({c: c.replace("query_", "q_") if c.startswith("query_") else f"om_{c}" for c in catalogue.columns})
    same = (F.col("query_title") == F.col("q_title")) & F.col("query_year").eqNullSafe(F.col("q_year"))
    found = asked.join(records, same).drop("q_title", "q_year")
    agrees = ~truthy("director") | (truthy("om_Director") & (F.col("om_Director") != "N/A") & last_word_in(F.col("om_Director"), F.col("director")))
    off = F.abs(F.substring("om_Year", 1, 4).try_cast("int") - F.col("query_year"))
    passing = found.where("om_Response = 'True'").where(agrees & F.coalesce(off <= 2, F.lit(True)) & ~F.coalesce(overruns(F.col("query_title"), F.col("om_Title")), F.lit(False)))
    return ranked_pick(passing, KEY, [F.lit(True)], ["pos"]).drop("director", "pos", "query_title", "query_year")


def resolve(movies: DataFrame, lbxd: DataFrame, omdb: DataFrame) -> DataFrame:
    """2.H: which value wins for each field; every right-hand side reads the values as they were."""
    lb = lbxd.withColumnsRenamed({"rating": "lb_rating", "poster": "lb_poster", "description": "lb_plot", "genres": "lb_genres", "country": "lb_country"})
    x = movies.join(lb, KEY, "left").join(omdb, KEY, "left")
    c, na = F.col, "N/A"
    own_poster = F.when(~F.coalesce(bad_poster(c("poster")), F.lit(False)), c("poster"))
    om_genres = F.when(truthy("om_Genre") & (c("om_Genre") != na), comma_parts(c("om_Genre"), 3))
    om_country = F.btrim(F.element_at(F.split("om_Country", ","), 1))
    clean = lambda name: F.nullif(c(name), F.lit(na))
    out = {
        "poster": first_truthy(c("lb_poster"), own_poster, clean("om_Poster")),
        "rating": F.when(truthy("lb_rating", "number"), c("lb_rating")).otherwise(c("rating")),
        "year": first_truthy(c("lb_year"), c("year"), F.substring("om_Year", 1, 4).try_cast("int"), kind="number"),
        "genres": F.coalesce(first_truthy(c("lb_genres"), c("genres"), om_genres, kind="array"), F.array().cast("array<string>")),
        "plot": first_truthy(c("lb_plot"), c("plot"), clean("om_Plot")),
        "country": first_truthy(c("lb_country"), c("country"), F.nullif(om_country, F.lit(na))),
        "director_lbxd_slug": first_truthy(c("director_lbxd_slug"), c("lb_director_slug")),
        "director": first_truthy(c("director"), clean("om_Director")),
        "duration": first_truthy(c("duration"), F.regexp_extract("om_Runtime", r"^\s*(\d+)", 1).try_cast("int"), kind="number"),
    }
    return x.withColumns(out).select(*movies.columns)


def enrich(movies: DataFrame, lbxd: DataFrame, omdb: DataFrame, lbxd_aliases: DataFrame, omdb_aliases: DataFrame) -> DataFrame:
    """Both lookups, then the fields."""
    return resolve(movies, lbxd_lookup(movies, lbxd, lbxd_aliases), omdb_lookup(movies, omdb, omdb_aliases))


def cache_split(movies: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with the cache's columns, misses), by title and year as they were before enrichment."""
    same = movies["title"].eqNullSafe(cache["title"]) & movies["year"].eqNullSafe(cache["year"])
    return movies.join(cache.withColumnsRenamed({c: f"cached_{c}" for c in cache.columns}), F.col("title").eqNullSafe(F.col("cached_title")) & F.col("year").eqNullSafe(F.col("cached_year"))), movies.join(cache, same, "left_anti")


def refreshed(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entries that lack a description or a country take the fresh one, where there is one."""
    stale = cache.where("slug is not null and (description is null or country is null)").select("title", "year")
    taken = fresh.join(stale, ["title", "year"], "left_semi").where("slug is not null")
    return cache.join(taken.select("title", "year"), ["title", "year"], "left_anti").unionByName(taken.select(*cache.columns))


def directors(movies: DataFrame, wiki: DataFrame) -> DataFrame:
    """2.I: one row per director: the first movie's slug even if null, with photo and biography from the snapshot."""
    named = movies.where(truthy("director"))
    first = named.groupBy(F.col("director").alias("name")).agg(F.min_by("director_lbxd_slug", F.struct("src_rank", "src_ord")).alias("lbxd_slug"))
    # of several entries for a name: one with a photo, one with a biography, then the least
    order = F.struct(F.col("photo").isNull().alias("a"), F.col("bio").isNull().alias("b"), "photo", "bio")
    known = wiki.groupBy("name").agg(F.min_by(F.struct("photo", "bio"), order).alias("w"))
    return first.join(known, "name", "left").select("name", "lbxd_slug", "w.photo", "w.bio")


def wiki_entries(pages: DataFrame, search: DataFrame, entities: DataFrame) -> DataFrame:
    """Photo and biography by name: the page's, else those of the best search hit, where the page has no photo.

    pages: name, photo, extract. search: name, pos, id, label. entities: id, photo, description.
    """
    from ..functions.text import first_sentences

    hit = search.withColumn("other", F.collate("label", "UNICODE_CI") != F.collate("name", "UNICODE_CI")).groupBy("name").agg(F.min_by("id", F.struct("other", "pos")).alias("id"))
    linked = hit.join(entities.withColumnsRenamed({"photo": "e_photo", "description": "e_bio"}), "id")
    bio = F.nullif(first_sentences(F.col("extract")), F.lit(""))
    out = pages.join(linked, "name", "full")
    return out.select("name", F.coalesce(F.nullif("photo", F.lit("")), "e_photo").alias("photo"), F.when(truthy("photo"), bio).otherwise(F.coalesce(bio, "e_bio")).alias("bio"))
