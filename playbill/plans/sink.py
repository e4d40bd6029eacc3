"""K1, K2: a document written in parts by many tasks and put together at the commit.

Entries come in the document's order, dealt to tasks by ranges of it. A task writes its own run of entries; its message says
where they are and with which entry they begin. The commit copies the runs one after another between the document's fixed parts, so no
task and not the driver ever holds more than a block of it. A job that fails removes its parts and leaves the target as it was.
"""

from __future__ import annotations

import json
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row

from ..scratch import remove, stored
from .publish import PREFIX, movie_json, replace_folder

#: An entry: the section that it belongs to, its place there, and its text.
ENTRY = "section INT, rank INT, ord INT, name STRING, js STRING"


@dataclass
class Runs(WriterCommitMessage):
    """What one task wrote: of each section the first entry's place, and the file."""

    runs: list[tuple[tuple, str]]


class _Parts(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = Path(options["path"].removeprefix("file://"))
        self.head, self.sections = json.loads(options["frame"])
        self.parts = self.path.parent / f".{self.path.name}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Runs:
        self.parts.mkdir(parents=True, exist_ok=True)
        runs, out, section = [], None, None
        try:
            for row in iterator:
                if row["section"] != section:
                    if out is not None:
                        out.close()
                    section, name = row["section"], uuid.uuid4().hex
                    out = (self.parts / name).open("w", encoding="utf-8", newline="")
                    runs.append(((section, row["rank"], row["ord"], (row["name"] or "").encode(), row["js"].encode()), name))
                else:
                    out.write(self.sections[section][0])
                out.write(row["js"])
        finally:
            if out is not None:
                out.close()
        return Runs(runs)

    def commit(self, messages: list[Runs | None]) -> None:
        runs = sorted(r for m in messages if m is not None for r in m.runs)
        self.path.mkdir(parents=True, exist_ok=True)
        with (self.path / "document.txt").open("wb") as whole:
            whole.write(self.head.encode())
            for section, (between, after) in enumerate(self.sections):
                for number, (_, name) in enumerate(r for r in runs if r[0][0] == section):
                    whole.write(between.encode() if number else b"")
                    with (self.parts / name).open("rb") as run:
                        shutil.copyfileobj(run, whole)
                whole.write(after.encode())
            whole.write(b"\n")
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list[Runs | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class DocumentSink(DataSource):
    """`df.write.format("document").option("frame", json).mode("overwrite").save(path)`: ENTRY rows, sorted over all tasks by section, rank, ord, name.

    `frame`: JSON of the text before the first section, and for each section the texts between two entries and after the last. The
    folder must be one that driver and executors share.
    """

    @classmethod
    def name(cls) -> str:
        return "document"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Parts(dict(self.options))


def entries(movies: DataFrame, directors: DataFrame, errors: DataFrame) -> DataFrame:
    """ENTRY: movies by rank and listing, directors by name, errors by venue."""
    none = F.lit(None)
    quoted = F.regexp_replace(F.expr("substring(to_json(struct(name as k)), 6)"), r"\}$", "")
    person = F.concat(quoted, F.lit(":"), F.to_json(F.struct("lbxd_slug", "photo", "bio"), {"ignoreNullFields": "false"}))
    rows = movie_json(movies).select(F.lit(0), F.col("src_rank"), F.col("src_ord"), none.cast("string"), "js")
    rows = rows.union(directors.select(F.lit(1), F.lit(0), F.lit(0), F.col("name"), person))
    rows = rows.union(errors.select(F.lit(2), F.lit(0), F.lit(0), F.concat_ws("\0", "cinema", "error"), F.to_json(F.struct("cinema", "error"))))
    return rows.toDF(*[c.split()[0] for c in ENTRY.split(", ")])


def observed(movies: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame, Observation, Observation]:
    """K3: both frames with their figures attached: movies and sessions, venues that failed. What reads the frames takes them."""
    one, two = Observation(), Observation()
    count = (F.count("*").alias("movies"), F.coalesce(F.sum(F.size("sessions")), F.lit(0)).alias("sessions"))
    return movies.observe(one, *count), errors.observe(two, F.array_sort(F.collect_set("cinema")).alias("failed")), one, two


def write_document(movies: DataFrame, directors: DataFrame, errors: DataFrame, generated: str, path: str) -> dict:
    """The published document, written beside the target by many tasks, then put in its place; `publish.previous` reads it.

    The same bytes as `publish.document` gives. Returns movies, sessions and failed venues, counted while the job writes.
    """
    spark = movies.sparkSession
    spark.dataSource.register(DocumentSink)
    frame = [f'{PREFIX}{{"generated":{json.dumps(generated)},"movies":[', [[",\n", '],"directors":{'], [",\n", '},"errors":['], [",", "]};"]]]
    # entries are made once; ranges of them are found on the written table, so that nothing is counted twice
    movies, errors, one, two = observed(movies, errors)
    rows, scratch = stored(entries(movies, directors, errors), "entries")
    rows = rows.orderBy("section", "rank", "ord", "name", "js")
    rows.write.format("document").option("frame", json.dumps(frame)).mode("overwrite").save(path + ".next")
    replace_folder(spark, path)
    remove(spark, scratch)
    return one.get | two.get


def write_dump(movies: DataFrame, rank: int, path: str) -> None:
    """K2: what one source gave, as a JSON list."""
    spark = movies.sparkSession
    spark.dataSource.register(DocumentSink)
    none = F.lit(None).cast("string")
    rows = movie_json(movies.where(F.col("src_rank") == rank)).select(F.lit(0).alias("section"), F.lit(0).alias("rank"), F.col("src_ord").alias("ord"), none.alias("name"), "js")
    rows.orderBy("section", "rank", "ord", "js").write.format("document").option("frame", json.dumps(["[", [[",\n", "]"]]])).mode("overwrite").save(path + ".next")
    replace_folder(spark, path)
