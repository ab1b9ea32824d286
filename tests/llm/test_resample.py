import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from townledger.llm import resample
from townledger.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, low, high):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in range(low, high + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, s):
    bucket = lambda f: zlib.crc32(f.encode()) % s.buckets
    source = Counter(bucket(f) for _, t in docs for f in grams(t, s.low, s.high)[1])
    aim = Counter(bucket(f) for t in target for f in grams(t, s.low, s.high)[1])
    S, T = sum(source.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (S + s.buckets) / ((source[b] + 1) * (T + s.buckets))))
    rows = []
    for i, t in docs:
        n, f = grams(t, s.low, s.high)
        w = sum(gain(bucket(x)) for x in f)
        rows.append((i, n, len(f), w, w + resample.noise(i, s.seed)))
    fit = sorted((r for r in rows if r[1] >= s.min_words), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    return rows, fit[: s.percent * len(fit) // 100]


@pytest.mark.parametrize("settings", [resample.Settings(percent=30), resample.Settings(buckets=97, low=1, high=3, min_words=3, percent=50), resample.Settings(buckets=1 << 16, low=2, high=2, percent=100)])
def test_odd_rows_equal_a_loop(spark, odd, none, settings):
    target = spark.createDataFrame([("one two three four",), (None,), ("",), ("Abc ünï 漢字 one two",)], "text string")
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    rows, drawn = plain(docs, [r[0] for r in target.collect()], settings)
    got = resample.resample(spark, odd, target, settings).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r[:5])
    assert sorted(map(key, got)) == sorted(map(key, rows))
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and [(r["doc_id"], r["score"]) for r in ranked] == [(r[0], r[4]) for r in drawn]
    assert resample.resample(spark, none, target, settings).count() == 0
    assert len(resample.resample(spark, odd, none, settings).collect()) == len(docs)


def test_query_equals_its_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = sorted(c.execute(ORACLES["op11_importance_resampling"]).fetchall())
    got = sorted(tuple(r) for r in QUERIES["op11_importance_resampling"](spark, SF).collect())
    assert got == want and sum(r[4] is not None for r in got) > 50


def test_drawing_moves_towards_the_target(spark):
    docs = spark.createDataFrame([(i, " ".join((["sea", "ship", "sail"] if i % 4 == 0 else ["hill", "rock", "path"]) * 8)) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([("the ship and the sail at sea",)] * 20, "text string")
    got = resample.resample(spark, docs, target).filter("rank is not null").collect()
    assert len(got) == 40 and sum(r["doc_id"] % 4 == 0 for r in got) >= 38
