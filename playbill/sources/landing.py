"""A Python data source that fills the landing table from addresses; the engine itself never fetches."""

from __future__ import annotations

import hashlib
import http.cookiejar
import json
import re
import shutil
import time
import urllib.request
import uuid
from collections.abc import Callable
from datetime import UTC, date, datetime, timedelta
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..model import LANDING


def answer(url: str, options: dict[str, str]) -> tuple[int | None, str | None]:
    """The page, or the last failure: its status (null if there was no answer) and, as body, what was wrong."""
    status, body = None, None
    for attempt in range(int(options.get("attempts", "1"))):
        if attempt:
            time.sleep(float(options.get("pause", "3")))
        status, body = _fetch(url, options.get)
        if status == 200:
            break
    return status, body


def _fetch(url: str, get: Callable) -> tuple[int | None, str | None]:
    jar = urllib.request.build_opener(urllib.request.HTTPCookieProcessor(http.cookiejar.CookieJar()))
    wait = float(get("timeout", "15"))
    headers = {"User-Agent": get("useragent", "playbill/1.0")}
    try:
        if first := get("prime"):  # its cookies go with the request
            jar.open(urllib.request.Request(first, headers=headers), timeout=wait).read()
            headers["Referer"] = first
        if get("ajax", "false").lower() == "true":
            headers["X-Requested-With"] = "XMLHttpRequest"
        data = get("post")
        if data is not None:
            headers["Content-Type"] = "application/json"
        with jar.open(urllib.request.Request(url, None if data is None else data.encode(), headers), timeout=wait) as page:
            status, body = getattr(page, "status", None) or 200, page.read().decode("utf-8", errors="ignore")
    except OSError as failure:
        return getattr(failure, "code", None), None
    if (field := get("errorfield")) and (wrong := _field(body, field)):
        return None, f"{field}: {wrong}"
    if (wanted := get("expect")) and not re.search(wanted, body):
        return None, f"nothing like {wanted}"
    return status, body


class _Pages(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.options.get("urls", "").split("\n") if u]

    def read(self, partition: InputPartition):
        yield self.options.get("source", ""), partition.value, datetime.now(UTC), *answer(partition.value, self.options)


class Due(InputPartition):
    """One host's addresses of a day, for the attempts from `first` to `last`."""

    def __init__(self, day: str, first: int, last: int, urls: tuple[str, ...]) -> None:
        self.day, self.first, self.last, self.urls = day, first, last, urls


class _Arriving(DataSourceStreamReader):
    """Offsets are (day, attempt): what all attempts up to this one of the days up to this one have brought.

    A day's addresses are due at its start; those that failed are due again every `retry` hours, `attempts` times in all. What
    is due at an offset follows from the offset and the options, so a batch that is replayed after a failure asks
    for the same addresses. Each answer lies in the spool, one file for a day, address and attempt, written whole or not at all:
    a replay takes what is there, and a later attempt asks only for what no earlier one got. So every address
    lands once a day, a good page at the attempt that got it and a failure at the last, however often the query stops.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.options = {k.lower(): v for k, v in options.items()}
        self.attempts = int(self.options.get("attempts", "1"))
        if not self.options.get("spool"):
            raise ValueError("the stream needs a spool, a folder that the driver and all executors share")
        self.spool = Path(self.options["spool"].removeprefix("file://"))

    def initialOffset(self) -> dict:  # noqa: N802
        first = date.fromisoformat(self.options.get("from") or datetime.now(UTC).date().isoformat())
        return {"day": (first - timedelta(days=1)).isoformat(), "attempt": self.attempts}

    def latestOffset(self) -> dict:  # noqa: N802
        if until := self.options.get("until"):  # "2026-03-20 2": no further than this attempt
            day, _, attempt = until.partition(" ")
            return {"day": day, "attempt": int(attempt or self.attempts)}
        now = datetime.now(UTC)
        return {"day": now.date().isoformat(), "attempt": min(self.attempts, 1 + int(now.hour / float(self.options.get("retry", "1"))))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """A task for each day and host; a batch that covers several attempts makes them one after another."""
        out, day, done = [], date.fromisoformat(start["day"]), start["attempt"]
        while day <= date.fromisoformat(end["day"]):
            last = end["attempt"] if day.isoformat() == end["day"] else self.attempts
            if done < last:
                hosts: dict[str, list[str]] = {}
                for url in dict.fromkeys(self._due(day)):
                    hosts.setdefault(urlsplit(url).netloc, []).append(url)
                out += [Due(day.isoformat(), done + 1, last, tuple(urls)) for _, urls in sorted(hosts.items())]
            day, done = day + timedelta(days=1), 0
        return out

    def _due(self, day: date) -> list[str]:
        """The addresses of a day: {day} is the day itself, {window} each of `window` days from it on."""
        days = [(day + timedelta(days=k)).isoformat() for k in range(int(self.options.get("window", "14")))]
        urls = [u for u in self.options.get("urls", "").split("\n") if u]
        return [x for u in urls for x in ([u.replace("{window}", d) for d in days] if "{window}" in u else [u.replace("{day}", days[0])])]

    def _place(self, day: str, url: str, attempt: int) -> Path:
        return self.spool / day / f"{hashlib.sha256(url.encode()).hexdigest()}.{attempt}"

    def read(self, partition: Due):
        gap, asked = float(self.options.get("gap", "0")), False
        for url in partition.urls:
            earlier = [self._place(partition.day, url, k) for k in range(1, partition.first)]
            if any(p.exists() and json.loads(p.read_text())[1] == 200 for p in earlier):
                continue  # it landed with an earlier batch
            for attempt in range(partition.first, partition.last + 1):
                place = self._place(partition.day, url, attempt)
                if not place.exists():
                    time.sleep(gap * asked)  # between two requests to one host
                    asked = True
                    found = answer(url, self.options | {"attempts": "1"})
                    place.parent.mkdir(parents=True, exist_ok=True)
                    fresh = place.with_name(f"{place.name}.{uuid.uuid4().hex}")
                    fresh.write_text(json.dumps([datetime.now(UTC).isoformat(), *found]))
                    fresh.replace(place)
                at, status, body = json.loads(place.read_text())
                if status == 200 or attempt == self.attempts:
                    yield self.options.get("source", ""), url, datetime.fromisoformat(at), status, body
                    break

    def commit(self, end: dict) -> None:
        """What is stored is not asked for again: days before the offset's need no spool."""
        for folder in self.spool.iterdir() if self.spool.exists() else ():
            if folder.name < end["day"]:
                shutil.rmtree(folder, ignore_errors=True)


def _field(body: str, name: str) -> object:
    try:
        answer = json.loads(body)
    except ValueError:
        return "no JSON"
    return answer.get(name) if isinstance(answer, dict) else None


class LandingSource(DataSource):
    """`spark.read.format("landing").option("source", …).option("urls", "a\\nb").load()`: one partition per address.

    Options: `useragent`; `timeout` in seconds; `prime`, an address that is fetched first, for its cookies and as referer;
    `ajax` for that header; `post`, a JSON body to send; `errorfield`, a field of a JSON answer that means failure; `expect`, a
    pattern that a good page has; `attempts` and `pause` in seconds, for pages that fail.

    As a stream (`spark.readStream`) it lands the addresses day by day: `{day}` in an address is the day, `{window}` each of
    `window` days (14) from it on; `from` and `until` are the first and last day; `attempts` for pages that fail, `retry`
    hours apart; `gap`, seconds between requests to one host; `spool`, a folder that all executors share.
    """

    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return LANDING

    def reader(self, schema) -> DataSourceReader:
        return _Pages(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Arriving(dict(self.options))
