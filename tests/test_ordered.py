from itertools import accumulate, groupby

from pyspark.sql import functions as F

from townledger.operators import ordered, structure
from townledger.streaming import jobs


def test_running_sums_equal_a_loop(spark):
    rows = [("hot", i, (i * 37) % 11) for i in range(900)] + [(None, i, i) for i in range(40)] + [(f"g{i % 50}", i, i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(5)
    want = {}
    for g, own in groupby(sorted(rows, key=lambda r: (r[0] or "", r[1])), key=lambda r: r[0]):
        own = list(own)
        want |= {(g, r[1]): (s, n) for r, s, n in zip(own, accumulate(r[2] for r in own), range(1, len(own) + 1), strict=True)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one part
    try:
        got = ordered.running_sums(df, ["g"], ["i"], {"s": F.col("v"), "n": F.lit(1)})
        assert {(r["g"], r["i"]): (r["s"], r["n"]) for r in got.collect()} == want
        cut = ordered.parts(df, ["g"], ["i"])
        assert cut.filter("g = 'hot'").select(ordered.PART).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_without_groups_and_of_nothing(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(500)], "i long, s long")
    got = ordered.numbered(df, [], [F.desc("s"), F.col("i")], "rank").collect()
    assert [r["i"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(range(500), key=lambda i: (-(i % 3), i))
    assert sorted(r["rank"] for r in got) == list(range(1, 501))
    assert ordered.numbered(df.filter("i < 0"), ["s"], ["i"], "n").count() == 0
    nulls = ordered.running_sums(spark.createDataFrame([(1, 1, None), (1, 2, 5), (1, 3, None)], "g int, i int, v int"), ["g"], ["i"], {"s": F.col("v")})
    assert [r["s"] for r in nulls.orderBy("i").collect()] == [None, 5, 5]


def test_sessions_batches_and_budgets_across_parts(spark):
    """A hot group lies in many parts; its sessions, batches and budget are those of a loop."""
    rows = [("hot", i, (i * i) % 17 + (60 if i % 41 == 0 else 0), (i * 37) % 29) for i in range(1500)] + [(None, i, i % 90, 5) for i in range(60)] + [("one", 0, 3, 99)]
    at = {}
    for g, own in groupby(sorted(rows, key=lambda r: (r[0] or "", r[1])), key=lambda r: r[0]):
        clock, session, used, batch, spent, last = 0, 1, 99, 0, 0, None
        for _, i, step, n in own:
            clock += step
            session += last is not None and clock - last > 50
            last = clock
            used, batch = (min(n, 40), batch + 1) if used + min(n, 40) > 40 else (used + min(n, 40), batch)
            spent += n
            at[g, i] = (clock, session, batch, spent <= 9000)
    df = spark.createDataFrame([(g, i, at[g, i][0], n) for g, i, _, n in rows], "g string, i long, at long, n long").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["g"], r["i"]): r["session"] for r in structure.gap_sessions(df, "g", F.col("at"), "i", 50).collect()}
        assert got == {k: v[1] for k, v in at.items()}
        got = {(r["g"], r["i"]): r["batch"] for r in structure.greedy_batches(df, "g", "i", F.col("n"), 40).collect()}
        assert got == {k: v[2] for k, v in at.items()}
        got = {(r["g"], r["i"]): r["allowed"] for r in jobs.budget_cutoff(df, "g", "i", "n", 9000).collect()}
        assert got == {k: v[3] for k, v in at.items()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
