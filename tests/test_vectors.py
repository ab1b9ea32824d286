import numpy as np
from pyspark.sql import functions as F

from townledger.operators import vectors
from townledger.plans import registry

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, n=3000, dim=16, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(40, dim))
    m = (centres[r.integers(0, 40, n)] + 0.6 * r.normal(size=(n, dim))).astype(np.float32)
    m[5::7] = m[5]  # many equal vectors
    m[11] = 0
    rows = [(i, m[i].tolist()) for i in range(n)] + [(n, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), m


def brute(m, q, k):
    u = m.astype(float)
    size = np.linalg.norm(u, axis=1)
    s = np.where(size == 0, -np.inf, np.round(u @ u[q] / np.where(size == 0, 1, size) / np.linalg.norm(u[q]), 12))
    return sorted(range(len(m)), key=lambda i: (-s[i], i))[:k]


def test_exact_search_equals_brute_force(spark):
    df, m = table(spark)
    q = df.filter("vec_id % 100 = 3 or vec_id = 5").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in vectors.exact_search(df, q, k=7).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert {i: [x[n] for n in range(1, 8)] for i, x in got.items()} == {i: brute(m, i, 7) for i in [5, *range(3, 3000, 100)]}
    few = vectors.exact_search(df.filter("vec_id in (11, 20, 3000)"), q.filter("query_id = 5"), k=7).orderBy("rank").collect()
    assert [r["vec_id"] for r in few] == [20, 11] and few[1]["score"] == float("-inf")
    assert vectors.exact_search(df.limit(0), q).count() == 0 == vectors.exact_search(df, q.limit(0)).count()


def test_index_recall_and_blocks(spark, monkeypatch):
    df, _ = table(spark)
    q = df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = vectors.exact_search(df, q).cache()
    found = vectors.indexed_search(df, q)
    got = vectors.recall(found, exact).collect()
    assert len(got) == 151 - 1 and np.mean([r["recall"] for r in got]) >= 0.9
    whole = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 50)  # every list in several blocks finds the same rows
    assert sorted(map(tuple, vectors.indexed_search(df, q).collect())) == whole
    every = vectors.indexed_search(df, q, vectors.Lists(lists=4, probes=4))
    assert all(r["recall"] == 1 for r in vectors.recall(every, exact).collect())
    assert vectors.indexed_search(df.limit(0), q).count() == 0


def test_recall_of_the_query(spark):
    got = registry.QUERIES["ann_recall"](spark, "/root/testdata/sf0.1").collect()
    assert len(got) == 20 and np.mean([r["recall"] for r in got]) >= 0.9
