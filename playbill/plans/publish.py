"""The published document: one JSON object behind an assignment, and the movies of an earlier one."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..scratch import remove, stored

PREFIX = "window.CINEMA_DATA = "
#: Where a document that has a line for each entry begins, and what follows its last movie.
HEAD, AFTER_MOVIES = r'^\s*window\.\w+\s*=\s*\{"generated":"[^"]*","movies":\[', '],"directors":{'
#: Fields that are always written, null or not; the others only where they are there.
ALWAYS = ("id", "title", "director", "year", "duration", "poster", "genres", "link", "sessions")
SOMETIMES = ("festival", "rating", "plot", "country", "director_lbxd_slug")


def movie_json(movies: DataFrame) -> DataFrame:
    """K1: (src_rank, src_ord, js): each movie as JSON."""
    slim = F.transform("sessions", lambda s: F.to_json(s))
    always = F.to_json(F.struct(*[c for c in ALWAYS if c != "sessions"]), {"ignoreNullFields": "false"})
    some = F.to_json(F.struct(*SOMETIMES))
    head = F.regexp_replace(always, r"\}$", "")
    tail = F.when(some == "{}", F.lit("")).otherwise(F.concat(F.lit(","), F.regexp_replace(some, r"^\{|\}$", "")))
    return movies.select("src_rank", "src_ord", F.concat(head, tail, F.lit(',"sessions":['), F.array_join(slim, ","), F.lit("]}")).alias("js"))


def document(movies: DataFrame, directors: DataFrame, errors: DataFrame, generated: str) -> DataFrame:
    """K1: one row, `value`: the whole document, for small ones; `sink.write_document` writes it in parts."""
    films = movie_json(movies).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src_rank", "src_ord", "js"))), lambda m: m["js"]), ",\n").alias("movies"))
    key = F.regexp_replace(F.expr("substring(to_json(struct(name as k)), 6)"), r"\}$", "")
    people = directors.select(F.struct("name", F.concat(key, F.lit(":"), F.to_json(F.struct("lbxd_slug", "photo", "bio"), {"ignoreNullFields": "false"})).alias("js")).alias("d"))
    people = people.agg(F.array_join(F.transform(F.array_sort(F.collect_list("d")), lambda d: d["js"]), ",\n").alias("directors"))
    failed = errors.agg(F.to_json(F.array_sort(F.collect_list(F.struct("cinema", "error")))).alias("errors"))
    one = films.selectExpr("'m' as k", "movies as v").union(people.selectExpr("'d' as k", "directors as v")).union(failed.selectExpr("'e' as k", "errors as v"))
    part = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    return one.agg(
        F.concat(F.lit(f'{PREFIX}{{"generated":"{generated}","movies":['), part("m"), F.lit('],"directors":{'), part("d"), F.lit('},"errors":'), part("e"), F.lit("};")).alias("value")
    )


def replace_folder(spark: SparkSession, path: str) -> None:
    """Put what is at the path aside, move in what was written beside it (.next), then drop the earlier one.

    A failure at any point leaves a whole folder, at the path or aside (.old).
    """
    target, fresh, aside = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".next", ".old"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.delete(aside, True)
        if not fs.rename(target, aside):
            raise OSError(f"cannot put {path} aside")
    if not fs.rename(fresh, target):
        raise OSError(f"cannot move the new version to {path}")
    fs.delete(aside, True)


def publish(doc: DataFrame, path: str) -> None:
    """Write beside the target, then replace it; `previous` finds a whole document whenever that fails."""
    doc.coalesce(1).write.mode("overwrite").text(path + ".next")
    replace_folder(doc.sparkSession, path)


def previous(spark: SparkSession, path: str) -> DataFrame:
    """The movies of a published document, or of the one put aside by an update that failed; none if there is no document."""
    text = None
    for place in (path, path + ".old"):
        try:
            text = spark.read.text(place, wholetext=True)
            break
        except AnalysisException:  # no such document
            continue
    if text is None:
        return spark.createDataFrame([], model.MOVIE)
    found = _of_lines(spark.read.text(place))
    if found is None:
        bare = F.regexp_replace(F.regexp_replace(F.btrim("value"), r"^window\.\w+\s*=\s*", ""), r";\s*$", "")
        rows = text.select(F.from_json(bare, f"movies {_movie_list()}")["movies"].alias("m")).where("m is not null")
        found = rows.select(F.posexplode("m").alias("pos", "m"))
    out = found.select("m.*", F.lit(0).alias("src_rank"), F.col("pos").alias("src_ord"))
    return out.withColumn("genres", F.coalesce("genres", F.array().cast("array<string>")))


def _of_lines(lines: DataFrame) -> DataFrame | None:
    """(pos, m): the movies of a document that has a line for each, as K1 writes it, read by many tasks; None for any other.

    A line's place is its place in its block of the file and the number of movies in the blocks before; only these numbers, one row a
    block, go to the driver. Lines are parsed once, and written, as blocks may be cut otherwise when a file is read again.
    """
    c, spark = F.col, lines.sparkSession
    if len(lines.inputFiles()) != 1:
        return None
    start = lines.where(c("_metadata.file_block_start") == 0).select(c("value").rlike(HEAD).alias("k")).first()
    if start is None or not start["k"]:
        return None
    rest = F.regexp_replace("value", HEAD, "")
    listed = F.concat(F.lit("["), F.when(c("last"), rest).otherwise(F.concat(F.regexp_replace(rest, r",\s*$", ""), F.lit("]"))))
    rows = lines.where("trim(value) <> ''").select(c("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    rows = rows.withColumns({"entry": c("value").rlike(HEAD) | c("value").startswith("{"), "last": c("value").contains(AFTER_MOVIES), "end": c("value").rlike(r"\};\s*$")})
    rows = rows.select("block", "at", "entry", "last", "end", F.when(c("entry"), F.json_array_length(listed)).alias("n"), F.when(c("entry"), F.from_json(listed, _movie_list())).alias("m"))
    rows, scratch = stored(rows, "previous")
    of_entries = lambda x: F.when(c("entry"), x)
    blocks = rows.groupBy("block").agg(
        F.count(of_entries(c("at"))).alias("lines"), F.min(of_entries(c("at"))).alias("first"), F.max(of_entries(c("at"))).alias("latest"), F.count("n").alias("read"), F.coalesce(F.sum("n"), F.lit(0)).alias("movies"),
        F.collect_list(F.when(c("last"), c("at"))).alias("lasts"), F.max_by("end", "at").alias("end"),
    ).orderBy("block").collect()
    held = [b for b in blocks if b["lines"]]
    lasts = [(b["block"], at) for b in blocks for at in b["lasts"]]
    one_each = sum(b["lines"] for b in held) in (1, sum(b["movies"] for b in held))
    if not (one_each and blocks[-1]["end"] and lasts == [(held[-1]["block"], held[-1]["latest"])] and all(b["read"] == b["lines"] == b["latest"] - b["first"] + 1 for b in held)):
        remove(spark, scratch)
        return None
    before = [sum(b["movies"] for b in held[:k]) for k in range(len(held))]
    starts = spark.createDataFrame([(b["block"], k - b["first"]) for b, k in zip(held, before, strict=True)], "block BIGINT, shift BIGINT")
    placed = rows.where("entry").join(F.broadcast(starts), "block")
    return placed.select((c("at") + c("shift")).alias("line"), F.posexplode("m").alias("k", "m")).select((c("line") + c("k")).cast("int").alias("pos"), "m")


def _movie_list() -> str:
    flat = model.MOVIE.replace(model.SESSION, "S").split(", ")
    return f"ARRAY<STRUCT<{', '.join(f'{k}: {t}'.replace('<S>', f'<{model.SESSION}>') for k, t in (x.split(' ', 1) for x in flat) if not k.startswith('src_'))}>>"


def source_dump(movies: DataFrame, rank: int) -> DataFrame:
    """K2: (value) what one source gave, as JSON in the order of its listing."""
    return movie_json(movies.where(F.col("src_rank") == rank)).orderBy("src_ord").select(F.col("js").alias("value"))


def metrics(movies: DataFrame, errors: DataFrame) -> DataFrame:
    """K3: movies, sessions, venues that failed."""
    rows = movies.select(F.lit(1).alias("m"), F.size("sessions").alias("s"), F.lit(None).cast("string").alias("f"))
    rows = rows.unionByName(errors.select(F.lit(0).alias("m"), F.lit(0).alias("s"), F.col("cinema").alias("f")))
    return rows.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("movies"), F.coalesce(F.sum("s"), F.lit(0)).alias("sessions"), F.array_sort(F.collect_list("f")).alias("failed"))
