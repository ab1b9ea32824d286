import json

import pytest
from pyspark.sql import functions as F

from townledger.operators import buckets
from townledger.sources import feed


def _page(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text(json.dumps(events), encoding="utf-8")


def _event(n, **kw):
    return {"EventId": n, "EventBodyName": "Board é", "EventDate": "2024-03-05T00:00:00", "EventMedia": None, "EventAgendaFile": None, "EventMinutesFile": None, "More": 1, **kw}


def test_feed_is_read_as_a_batch_and_as_a_stream(spark, tmp_path):
    feed.register(spark)
    folder = tmp_path / "pages"
    assert spark.read.format("event_feed").load(str(folder)).count() == 0
    _page(folder, "p1", [_event(1), _event(2)])
    _page(folder, "p2", [])
    read = lambda: [(r["page"], r["position"], json.loads(r["event"])["EventId"]) for r in spark.read.format("event_feed").load(str(folder)).orderBy("page", "position").collect()]
    assert read() == [("p1.json", 0, 1), ("p1.json", 1, 2)]

    def stream():
        q = spark.readStream.format("event_feed").load(str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(json.loads(r["event"])["EventId"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert stream() == [1, 2]
    _page(folder, "p3", [_event(3)])
    assert stream() == [1, 2, 3] and stream() == [1, 2, 3]
    _page(folder, "p4", {"no": "list"})
    with pytest.raises(Exception, match="no list of events"):
        read()


def test_meetings_and_documents_of_events(spark):
    video = "https://v/1"
    events = [
        ("p1", 0, json.dumps(_event(1, EventMedia=video, EventAgendaFile="a.pdf"))), ("p2", 0, json.dumps(_event(1, EventMedia=video, EventAgendaFile="b.pdf", EventMinutesFile="m.pdf"))),
        ("p1", 1, json.dumps(_event(2, EventMedia="ftp://v"))), ("p1", 2, json.dumps(_event(3, EventDate="soon"))), ("p1", 3, json.dumps(_event(None))), ("p1", 4, "no json"), ("p1", 5, None),
    ]
    found = feed.meetings(spark.createDataFrame(events, "page string, position int, event string"), "sea")
    assert sorted((r["id"], r["title"], r["recording_url"]) for r in found.collect()) == [("sea-1", "Board é 2024-03-05", video), ("sea-2", "Board é 2024-03-05", None)]
    html = 'x tracks: [ {file: "documents/seattlechannel/closedcaption/2024/ab_1.SRT"}]'
    pages = spark.createDataFrame([(video, html), (video, "none"), ("other", None)], "url string, html string")
    got = sorted((r["id"], r["source_url"], r["media_type"]) for r in feed.documents(found, pages).collect())
    assert got == [("sea-agenda-1", "b.pdf", "application/pdf"), ("sea-minutes-1", "m.pdf", "application/pdf"), ("sea-transcript-1", feed.SITE + "documents/seattlechannel/closedcaption/2024/ab_1.SRT", "application/x-subrip")]
    assert feed.documents(found, pages.limit(0)).count() == 2


def test_documents_are_replaced_in_buckets(spark, tmp_path):
    path, schema = str(tmp_path / "units"), "document_id string, unit int"
    rows = lambda: sorted((r["document_id"] or "", r["unit"]) for r in buckets.current_rows(spark, path, spark.createDataFrame([], schema).schema).collect())
    assert rows() == []
    many = spark.range(10_000).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("document_id"), F.explode(F.array(F.lit(1), F.lit(1), F.lit(2))).alias("unit"))
    assert buckets.replace_rows(many, path, buckets=8) == 1 and len(rows()) == 30_000
    before = {str(p) for p in (tmp_path / "units" / "data").rglob("*.parquet")}
    assert len(before) <= 64
    change = spark.createDataFrame([("d7", 9), (None, 5), ("new", 1)], schema)
    gone = spark.createDataFrame([("d8",), ("not there",)], "document_id string")
    assert buckets.replace_rows(change, path, gone=gone) == 2
    want = sorted([(f"d{i}", u) for i in range(10_000) if i not in (7, 8) for u in (1, 1, 2)] + [("d7", 9), ("", 5), ("new", 1)])
    assert rows() == want
    assert before <= {str(p) for p in (tmp_path / "units" / "data").rglob("*.parquet")}  # copied on write
    buckets.replace_rows(spark.createDataFrame([(None, 6)], schema), path)
    assert rows() == sorted([("", 6), *(r for r in want if r[0])])
    buckets.replace_rows(spark.createDataFrame([], schema), path)
    assert len(rows()) == len(want)


def test_a_version_without_its_manifest_does_not_count(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "document_id string, unit int"
    buckets.replace_rows(spark.createDataFrame([("a", 1), ("b", 1)], schema), path)
    buckets.replace_rows(spark.createDataFrame([("a", 2)], schema), path)
    (tmp_path / "t" / "manifest" / "v2" / "_SUCCESS").unlink()
    read = lambda: sorted(tuple(r) for r in buckets.current_rows(spark, path, spark.createDataFrame([], schema).schema).collect())
    assert read() == [("a", 1), ("b", 1)]
    assert buckets.replace_rows(spark.createDataFrame([("b", 3)], schema), path) == 2 and read() == [("a", 1), ("b", 3)]
    with pytest.raises(ValueError):
        buckets.replace_rows(spark.createDataFrame([("a", 1)], f"document_id string, {buckets.BUCKET} int"), path)
