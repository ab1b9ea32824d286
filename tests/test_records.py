import pytest
from pyspark.sql import functions as F

from townledger.operators import records, search
from townledger.sources import labels


def test_records_are_told_apart_by_kind(spark):
    kind = "mover string, seconder string, ayes int, noes int, abstain int, absent int, members array<struct<name:string,value:string>>, identifier string, outcome string, amount_usd double, speaker string"
    fields = [x.split(" ", 1)[0] for x in kind.split(", ")]
    r = lambda **kw: tuple(kw.get(f) for f in fields)
    vote = r(ayes=2, noes=0, abstain=0, absent=0, members=[("Ann Gee", "aye"), ("Bo", "aye")])
    cases = [
        ("vote", vote, r(ayes=2, noes=0, abstain=0, absent=0, members=[("BO", "aye"), ("A. Gee", "aye")]), True), ("vote", vote, r(ayes=2, noes=0, abstain=0, absent=0), False), ("vote", r(ayes=1, noes=0, abstain=0, absent=0, members=[]), r(ayes=1, noes=0, abstain=0, absent=0, members=[("x", "no")]), True),
        ("amount", r(amount_usd=5.0), r(amount_usd=5.004), True), ("amount", r(amount_usd=5.0), r(), False), ("motion", r(mover="Ann Gee"), r(mover="GEE"), True), ("motion", r(mover="Gee"), r(mover="Gee", seconder="Bo"), False),
        ("ordinance", r(identifier="cb  1", outcome="passed"), r(identifier="CB 1", outcome="passed"), True), ("statement", r(speaker=" "), r(), False), ("other", r(), r(), False),
    ]
    typed = "struct<" + ",".join(x.replace(" ", ":", 1) for x in kind.split(", ")) + ">"
    df = spark.createDataFrame([(i, k, g, f) for i, (k, g, f, _) in enumerate(cases)], f"i int, kind string, gold {typed}, found {typed}")
    got = {x["i"]: x["same"] for x in df.select("i", records.same_record(F.col("kind"), F.col("gold"), F.col("found")).alias("same")).collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}


def test_places_of_a_literal(spark):
    df = spark.createDataFrame([(1, "aaaa"), (2, "xaa.aa"), (3, None), (1, "aa"), (4, "")], "k int, t string")
    assert sorted((r["k"], r["start"], r["end"]) for r in records.find_all(df, "k", "t", "aa").collect()) == [(1, 0, 2), (1, 0, 2), (1, 2, 4), (2, 1, 3), (2, 4, 6)]
    assert [r["start"] for r in records.find_all(df, "k", "t", ".").collect()] == [3]
    with pytest.raises(ValueError):
        records.find_all(df, "k", "t", "")


def test_labels_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 5)], "id int, kind string, n int")
    for compression in ("none", "gzip"):
        labels.export_labels(df, str(tmp_path / compression), "id", compression=compression)
        got = labels.read_labels(spark, str(tmp_path / compression), "id int, kind string, n int")
        assert sorted(map(tuple, got.collect())) == [(1, "a", 5), (2, "b", None)]


def test_samples_do_not_depend_on_partitions(spark):
    a, b = (sorted(r["id"] for r in records.sampled(spark.range(500).repartition(n), "id", 20, 7).collect()) for n in (2, 9))
    assert a == b and len(a) == 20 and a != sorted(r["id"] for r in records.sampled(spark.range(500), "id", 20, 8).collect())


def test_questions_are_checked(spark):
    df = spark.createDataFrame([(1, "water main", "a"), (2, "water", "a")], "doc_id int, text string, g string")
    for bad in ({"query": " "}, {"query": "x" * 501}, {"query": "x", "k": 51}, {"query": "x", "mode": "none"}):
        with pytest.raises(ValueError):
            search.search(df, **bad)
    for mode in search.MODES:
        assert [r["doc_id"] for r in search.search(df, "water main", mode, group="g").collect()] == [1]
