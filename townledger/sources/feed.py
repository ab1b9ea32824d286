"""Recorded pages of an event feed as a Spark data source, for batches and streams, and their meetings and documents."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

EVENT = "EventId bigint, EventBodyName string, EventDate string, EventMedia string, EventAgendaFile string, EventMinutesFile string"
# Where a recording's page names its caption file, and the site that the file is on.
TRACK = r'(?i)tracks:\s*\[\s*\{\s*file:\s*"(documents/seattlechannel/closedcaption/\d{4}/[A-Za-z0-9_]+\.(?:srt|vtt))"'
SITE = "https://www.seattlechannel.org/"


def _files(path: str) -> list[str]:
    """The pages below a folder in the order of their names, on any file system that pyarrow knows."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(path)
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".json"))


class _Page(InputPartition):
    def __init__(self, file: str):
        self.file = file


def _events(path: str, page: _Page | None) -> Iterator[tuple[str, int, str]]:
    from pyarrow import fs

    if page is None:  # what Spark reads where there are no partitions
        return
    with fs.FileSystem.from_uri(path)[0].open_input_stream(page.file) as f:
        try:
            events = json.loads(f.read())
        except ValueError as err:
            raise ValueError(f"invalid json in {page.file}") from err
    if not isinstance(events, list):
        raise ValueError(f"no list of events in {page.file}")
    name = page.file.rpartition("/")[2]
    for i, event in enumerate(events):
        yield name, i, json.dumps(event, ensure_ascii=False)


class _Batch(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_Page(f) for f in _files(self.path)]

    def read(self, partition: _Page) -> Iterator[tuple[str, int, str]]:
        return _events(self.path, partition)


class _Stream(DataSourceStreamReader):
    """An offset is the name of the last page read; pages are added under rising names and never changed."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        files = _files(self.path)
        return {"after": files[-1].rpartition("/")[2] if files else ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Page(f) for f in _files(self.path) if start["after"] < f.rpartition("/")[2] <= end["after"]]

    def read(self, partition: _Page) -> Iterator[tuple[str, int, str]]:
        return _events(self.path, partition)


class EventFeed(DataSource):
    """spark.read or readStream .format("event_feed").load(folder): (page, position, event), a row for each event of each page.

    A page is a file NAME.json that holds a list of events; a task reads one page. What is no list fails the job.
    A folder without pages, or one that isn't there yet, has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "event_feed"

    def schema(self) -> str:
        return "page string, position int, event string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventFeed)


def _recording(media: Column) -> Column:
    return F.when(media.startswith("http"), media)


def meetings(events: DataFrame, city: str) -> DataFrame:
    """A meeting for each event (event: JSON); a recording counts if its address begins with http.

    An event seen on several pages is one meeting, of the last page and position. Events without a number or without a
    date go, as does what is no JSON.
    """
    rows = events.select("page", "position", F.from_json("event", EVENT).alias("e")).withColumn("day", F.try_to_date(F.substring("e.EventDate", 1, 10)))
    rows = rows.filter(F.col("e.EventId").isNotNull() & F.col("day").isNotNull())
    last = rows.groupBy("e.EventId").agg(F.max_by(F.struct("e", "day"), F.struct("page", "position")).alias("m")).select("m.*")
    key = F.col("e.EventId").cast("string")
    return last.select(
        F.concat(F.lit(f"{city}-"), key).alias("id"), F.lit(city).alias("city_id"), F.col("e.EventBodyName").alias("body"), F.col("day").alias("meeting_date"),
        F.concat_ws(" ", "e.EventBodyName", F.col("day").cast("string")).alias("title"), key.alias("source_key"), _recording(F.col("e.EventMedia")).alias("recording_url"),
        F.col("e.EventAgendaFile").alias("agenda_url"), F.col("e.EventMinutesFile").alias("minutes_url"),
    )


def documents(found: DataFrame, recordings: DataFrame) -> DataFrame:
    """The documents of meetings: agenda and minutes where the event has them, and the caption file that the recording's page names.

    recordings: url, html of the pages that could be fetched; of several pages of one address the greatest text counts.
    """
    pages = recordings.groupBy(F.col("url").alias("recording_url")).agg(F.max(F.regexp_extract("html", TRACK, 1)).alias("track"))
    rows = found.join(pages, "recording_url", "left")
    pdf = lambda kind, url: F.struct(F.lit(kind).alias("kind"), url.alias("source_url"), F.lit("application/pdf").alias("media_type"))
    captions = F.struct(F.lit("transcript").alias("kind"), F.concat(F.lit(SITE), F.nullif("track", F.lit(""))).alias("source_url"), F.when(F.lower("track").endswith(".srt"), "application/x-subrip").otherwise("text/vtt").alias("media_type"))
    each = F.filter(F.array(pdf("agenda", F.col("agenda_url")), pdf("minutes", F.col("minutes_url")), captions), lambda x: x["source_url"].isNotNull())
    made = rows.select("city_id", "source_key", F.col("id").alias("meeting_id"), F.inline(each))
    return made.select(F.concat_ws("-", "city_id", "kind", "source_key").alias("id"), "meeting_id", "city_id", "kind", "source_url", "media_type")
