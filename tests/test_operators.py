import datetime as dt

import pytest
from pyspark.sql import functions as F

from townledger.functions import text as T
from townledger.operators import facts, metrics, search, structure, vectors
from townledger.plans import catalog, guard
from townledger.sources import captions, listings
from townledger.streaming import jobs


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_fusion(spark):
    lists = [spark.createDataFrame([(i, r) for r, i in enumerate(x, 1)], "id int, rank int") for x in ([1, 2, 3], [3, 1, 4])]
    got = [(r["id"], round(r["score"], 9)) for r in search.fuse(lists, "id").orderBy(F.desc("score"), "id").collect()]
    assert got == [(1, round(1 / 61 + 1 / 62, 9)), (3, round(1 / 63 + 1 / 61, 9)), (2, round(1 / 62, 9)), (4, round(1 / 63, 9))]


def test_keywords(spark):
    df = spark.createDataFrame([(1, "A budget for the budget"), (2, "The mayor"), (3, "budget hearing")], "doc_id int, text string")
    assert [r["doc_id"] for r in search.keyword_search(df, "What is the budget?").collect()] == [1, 3]
    assert search.keyword_search(df, "what is the").count() == 0


def test_hybrid_keeps_one_of_a_group(spark):
    df = spark.createDataFrame([(1, "water budget", "a"), (2, "budget", "a"), (3, "water", None), (4, "water", None)], "doc_id int, text string, g string")
    assert [(r["doc_id"], r["rank"]) for r in search.hybrid_search(df, "water budget", group="g").orderBy("rank").collect()] == [(1, 1), (3, 2), (4, 3)]


@pytest.mark.parametrize("q,want", [("Ayes: Ann, Bo, Cy, Di\nNoes: Ed\nAbsent: None\nAbstain: None", (4, 1, 0, 0)), ("It passed (7-0-0-0) Ayes: A, B", (7, 0, 0, 0)), ("In Favor: 3 - A, B, C\nOpposed: None", (3, 0, 0, 0)), ("Ann | Aye\nBo | Aye\nCy | No", (2, 1, 0, 0)), ("Ann - Aye Bo - Nay", (1, 1, 0, 0)), ("", (0, 0, 0, 0))])
def test_votes(spark, q, want):
    assert tuple(one(spark, facts.votes(F.col("q")), q=q)) == want


def test_amounts(spark):
    assert one(spark, T.amounts(F.col("q")), q="paid $184,500 and then $1.2 million, $3k") == [184500.0, 1200000.0, 3000.0]


FACT = "ayes int, noes int, abstain int, absent int, members array<struct<name:string,value:string>>, amount_usd double, identifier string, names array<string>"


def test_facts_against_their_source(spark):
    source = "The  board\nvoted.\nAyes: Ann, Bo\nNoes: None\nIt costs $5 million 😀 (a+b)."
    vote = lambda ayes=2, members=(("Ann", "aye"),): (ayes, 0, 0, 0, list(members), None, None, None)
    fact = lambda **kw: (None, None, None, None, None, kw.get("amount"), kw.get("identifier"), kw.get("names"))
    quote = "Ayes: Ann, Bo Noes: None"
    cases = [
        ("vote", quote, vote(), (None, 18, 42)), ("vote", quote, vote(ayes=3), ("vote_count_mismatch", 18, 42)), ("vote", quote, vote(members=[("Ann", "no")]), ("vote_members_mismatch", 18, 42)),
        ("amount", "costs $5 million", fact(amount=5e6), (None, 46, 62)), ("amount", "costs $5 million", fact(amount=5.0), ("amount_not_in_quote", 46, 62)), ("ordinance", "board voted", fact(identifier="CB 1"), ("identifier_not_in_quote", 5, 16)),
        ("motion", "board voted", fact(names=["Al Board", None]), (None, 5, 16)), ("motion", "board voted", fact(names=["  "]), ("name_not_in_quote", 5, 16)), ("statement", "not there", fact(names=["x"]), ("quote_not_found", None, None)), ("statement", None, fact(), ("quote_not_found", None, None)),
        ("statement", "😀 (a+b).", fact(names=[]), (None, 63, 71)),
    ]
    df = spark.createDataFrame([(i, k, q, source, f) for i, (k, q, f, _) in enumerate(cases)], f"i int, kind string, quote string, source string, fact struct<{', '.join(x.strip().replace(' ', ':', 1) for x in FACT.split(', '))}>")
    got = {r["i"]: (r["error"], r["start"], r["end"]) for r in facts.verify_facts(df).collect()}
    assert got == {i: want for i, (_, _, _, want) in enumerate(cases)}


def test_text_functions(spark):
    assert one(spark, T.valid_token_ratio(F.lit("The Council met, 12:30 xqz"))) == pytest.approx(0.8)
    assert one(spark, T.time_label(F.lit(3_723_456))) == "01:02:03" and one(spark, T.time_ms(F.lit("01:02:03,456"))) == 3_723_456
    assert one(spark, T.numeric_tokens(F.lit("$1,200.00 or 5% of 7"))) == ["1200", "5", "7"]
    assert one(spark, T.strict_numeric_tokens(F.lit("7 of 20 or $7, 21"))) == ["7", "21"]
    assert one(spark, T.normalize(F.lit("a  “b” \nc\t d  "))) == 'a "b"\nc d'
    assert one(spark, T.needs_ocr(F.lit("abc"), F.lit(0.9))) and not one(spark, T.needs_ocr(F.lit("abc"), F.lit(0.1)))
    assert one(spark, T.title_tokens(F.lit("Adopt a Resolution No. 2024-07 for the Oak Park"))) == ["for", "the", "oak", "park"]


def test_metrics(spark):
    v = spark.createDataFrame([(0.1,), (0.4,), (0.2,)], "v double")
    assert tuple(v.agg(*metrics.run_summary(F.col("v"))).first()) == (3, 0.1, 0.2, 0.4)
    assert tuple(v.union(spark.createDataFrame([(None,)], "v double")).agg(*metrics.run_summary(F.col("v"))).first()) == (4, None, None, None)
    k = spark.createDataFrame([(True, True), (True, True), (False, False), (False, True)], "a boolean, b boolean")
    assert k.agg(metrics.kappa(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.5)
    assert k.limit(0).agg(metrics.kappa(F.col("a"), F.col("b"))).first()[0] is None
    r = spark.range(1, 21)
    assert tuple(r.agg(metrics.nearest_rank("id", 0.5), metrics.nearest_rank("id", 0.95)).first()) == (10, 19)
    p = spark.createDataFrame([(1, 100, 200, 100, 130), (1, 100, 200, 170, 200), (2, 100, 200, 100, 160), (2, 100, 200, 140, 200)], "d int, s int, e int, l int, r int")
    assert {x["d"]: x["covered"] for x in metrics.covered_length(p, ["d", "s", "e"], "s", "e", "l", "r").collect()} == {1: 60, 2: 100}
    g = metrics.gate(spark.createDataFrame([("a", 0.9), ("c", 1.1)], "metric string, value double"), spark.createDataFrame([("a", 0.92), ("b", 1.0), ("c", 1.0)], "metric string, base double"), F.lit(0.05), F.col("metric") != "c")
    assert {x["metric"]: x["passed"] for x in g.collect()} == {"a": True, "b": False, "c": False}


def test_chunks_and_cues():
    assert structure.pack_lines("ab\n" + "x" * 9 + "\ncd\n\nef", 4) == [(0, 2), (3, 7), (7, 11), (11, 12), (13, 16), (17, 19)]
    got = structure.cue_segments([(0, 1000, "SPEAKER 1 (COUNCIL): Hello"), (1500, 2000, "there"), (9000, 9500, "later"), (9600, 80_000, "long")])
    assert [(a, b, t, s) for a, b, t, s in got] == [(0, 2000, "SPEAKER 1 (COUNCIL): Hello there", "SPEAKER 1 (COUNCIL)"), (9000, 9500, "later", None), (9600, 80_000, "long", None)]


def agenda(spark, lines, dialect):
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "d int, text string")
    return [tuple(r)[2:] for r in structure.segment_agendas(df, "d", "text", dialect).orderBy("ordinal").collect()]


def test_agendas(spark):
    lettered = ["Town", "A. CALL TO ORDER", "AN ORDINANCE about", "trees", "CB 12", "1. Res 34 A  RESOLUTION on water", "In Favor: 3", "CB 12", "CB 56 In Favor: 3 of them", "D. ADJOURNMENT"]
    want = [(0, "section", "PREAMBLE", "Preamble"), (1, "section", "A", "CALL TO ORDER"), (2, "business", "CB 12", "AN ORDINANCE about trees"), (5, "business", "Res 34", "A  RESOLUTION on water"), (8, "business", "CB 56", ""), (9, "section", "D", "ADJOURNMENT")]
    assert agenda(spark, lettered, "lettered") == want
    numbered = ["1. ROLL CALL", "2.A Approve the notes", "of June", "Ayes: All", "2.B. Other", "2.A again", "1. ROLL CALL"]
    assert agenda(spark, numbered, "numbered") == [(0, "section", "1.", "ROLL CALL"), (1, "business", "2.A", "Approve the notes of June"), (4, "business", "2.B", "Other")]
    assert agenda(spark, ["x"], "numbered") == [(0, "section", "PREAMBLE", "Preamble")]


def test_links_are_one_to_one(spark):
    c = spark.createDataFrame([("m", 1, 5, 0.9), ("m", 1, 4, 0.9), ("m", 2, 4, 0.8), ("m", 2, 6, 0.6), ("m", 3, 4, 0.7)], "g string, record int, item int, similarity double")
    assert {(r["record"], r["item"]) for r in structure.link_items(c, "g").collect()} == {(1, 4), (2, 6)}


def test_captions(spark):
    srt = "1\r\n00:00:01,000 --> 00:00:02,500\n<i>Hi</i> &amp;  you\n\n2\nbroken\n\n3\n0:00:03,000 --> 0:00:04,000\nthere\nand on\n4\n00:00:05,000 --> 00:00:06,000\nend"
    vtt = "\ufeffWEBVTT\n\nNOTE x\n00:00:01.000 --> 00:00:02.000\nno\n\n00:00:03.000 --> 00:00:04.000 align:left\ne\u0301\n"
    df = spark.createDataFrame([(1, srt), (2, vtt)], "path int, value string")
    got = {i: [tuple(r)[2:] for r in captions.cues(df).orderBy("cue").collect() if r["path"] == i] for i in (1, 2)}
    assert got == {1: [(1000, 2500, "Hi & you"), (3000, 4000, "there and on"), (5000, 6000, "end")], 2: [(3000, 4000, "\u00e9")]}
    none = spark.createDataFrame([(3, "nothing"), (4, None)], "path int, value string")
    assert captions.cues(none, empty="pass").count() == 0
    with pytest.raises(Exception, match="no cues in"):
        captions.cues(none).collect()


def test_listings(spark, tmp_path):
    page = "<table><tr><td>July 2, 2024</td><td><a href='x?clip_id=7'>Council</a></td></tr><tr><td>July 3, 2024 Cancelled</td><td>clip_id=8</td></tr><tr><td>July 4, 2024 clip_id=7</td></tr></table>"
    rows = listings.table_rows(spark.createDataFrame([(1, page)], "id int, html string"), "id", "html")
    assert [(r["clip"], str(r["meeting_date"])) for r in listings.meetings_of(rows).collect()] == [("7", "2024-07-02")]
    (tmp_path / "m.json").write_text('{"meetings": [{"id": "m1", "city_id": "c", "meeting_date": "2024-05-01"}, {"id": "m2", "city_id": "c", "meeting_date": "2024-06-01"}], "documents": [{"id": "d1", "meeting_id": "m1"}, {"id": "d2", "meeting_id": "m2"}]}')
    m, d = listings.manifest(spark, str(tmp_path / "m.json"), last="2024-05-01")
    assert [r["id"] for r in m.collect()] == ["m1"] and [r["id"] for r in d.collect()] == ["d1"]


@pytest.fixture(scope="module")
def civic(spark):
    rows = {
        "meetings": [("m1", "c", "Council", dt.date(2024, 5, 1), "t", "k", None, None)],
        "documents": [("d1", "m1", "c", "record", "pdf", "page", "downloaded", None, "h", 1), ("d2", "m1", "c", "agenda", "pdf", "page", "failed", None, "h", 1)],
        "units": [("d1", 1, "page", "text", "pdf", None, None, None, None, None)],
        "items": [(1, "d1", 1, "business", "2.A", "t", 1, 0, 1, 4, None)],
        "facts": [(1, "d1", 1, "vote", 1, "q", 0, 1, True, None, '{"ayes": 4, "noes": 1, "members": [{"name": "Gray", "value": "aye"}]}'), (2, "d1", 1, "amount", 1, "q", 0, 1, True, None, '{"amount_usd": 12.5}'), (3, "d1", 1, "vote", 1, "q", 0, 1, False, "x", "{}")],
    }
    catalog.register(spark, {k: spark.createDataFrame(v, catalog.SCHEMAS[k]) for k, v in rows.items()})


def test_views(spark, civic):
    assert [tuple(r) for r in spark.sql("select ayes, noes, absent from v_votes").collect()] == [(4, 1, None)]
    assert [r["id"] for r in spark.table("v_documents").collect()] == ["d1"] and spark.table("v_facts").count() == 2
    assert [tuple(r) for r in spark.sql("select name, value from v_vote_members").collect()] == [("Gray", "aye")]


def test_guarded_sql(spark, civic):
    assert guard.run(spark, "with a as (select amount_usd from v_amounts) select * from a") == {"columns": ["amount_usd"], "rows": [[12.5]]}
    spark.createDataFrame([(1, "hidden")], "id int, secret string").createOrReplaceTempView("secret")
    for query in ("select * from secret -- , secret as (", "select * from secret where 'x, secret as (' != ''", "with secret as (select * from secret) select * from secret", "select * from secret where 1 in (with secret as (select 1 as id) select id from secret)",
                  "select (select max(secret) from secret)", "select 1 from v_facts where exists (select 1 from secret)", "with a as (with secret as (select 1) select * from secret) select * from secret", "select * from `secret`", "select java_method('java.lang.Math', 'abs', -1)", "select * from v_facts join lateral (select * from secret)"):
        with pytest.raises(guard.SqlError) as e:
            guard.run(spark, query)
        assert e.value.code == "permission_denied", query
    for query in ("select * from identifier('secret')", "select * from identifier('sec' || 'ret')", "with a as (select * from identifier('secret')) select * from a", "select identifier('reflect')('java.lang.System', 'getProperty', 'user.name')", "select (select max(x) from identifier('secret') as t(x, y))",
                  "select * from v_facts lateral view reflect('java.lang.System', 'exit', 1) t as x", "select * from v_facts lateral view identifier('explode')(array(1)) t as x", "select * from v_facts version as of 1", "select * from v_facts where id = :p", "select transform(array(1), x -> reflect('a', 'b'))",
                  "select * from v_facts |> where exists (select 1 from identifier('secret'))", "select input_file_name()", "select current_user()", "from v_facts select transform(id) using 'cat' as x", "select * from read_files('/etc')", "select sum(id) over (order by java_method('a', 'b')) from v_facts"):
        with pytest.raises(guard.SqlError) as e:
            guard.run(spark, query)
        assert e.value.code in ("permission_denied", "sql_error") and e.value.code != "timeout", query
        if "identifier(" in query:
            assert e.value.code == "permission_denied", query
    for query in ("select kind, count(*) as n from v_facts group by rollup(kind) having count(*) > 0 order by n desc nulls last limit 2", "select row_number() over (partition by kind order by id) as r, lag(id) over w as l from v_facts window w as (order by id)", "select * except (kind) from v_facts where id in (1, 2) and not kind like 'x%' or kind is null",
                  "select * from (values (1, 'a'), (2, 'b')) as t(a, b) union all select 3, cast(4 as string) except select 9, 'x'", "select case when id > 1 then -id else id % 2 end as c, id || 'x' as d from v_facts a left join v_amounts b using (id) where exists (select 1 from v_votes)", "with recursive r(n) as (select 1 union all select n + 1 from r where n < 5) select max(n) from r",
                  "select filter(array(1, 2), x -> x > 1)[0] as f, explode(array(1, 2)) as e", "select date '2020-01-01' + interval 1 day as d, extract(year from current_date) > 2000 as y, trim(both 'x' from 'xax') as t", "select x from v_facts lateral view explode(array(id)) e as x", "select id from v_facts |> where id = 1 |> limit 1"):
        assert guard.run(spark, query)["columns"], query
    assert guard.run(spark, "with secret as (select amount_usd as x from v_amounts) select count(*) as n, round(sum(x), 1) as s from secret")["rows"] == [[1, 12.5]]
    with pytest.raises(guard.SqlError) as e:
        guard.run(spark, "select sum(a.id * b.id) as s from range(10000000) a join range(10000000) b on a.id < b.id", seconds=0.5)
    assert e.value.code == "timeout"
    for query, code in (("", "invalid_arguments"), ("x" * 4001, "invalid_arguments"), ("drop view v_facts", "read_only_violation"), ("insert into v_facts values (1)", "read_only_violation"), ("set a=b", "read_only_violation"), ("select 1; select 2", "multiple_statements"),
                        ("select * from facts", "permission_denied"), ("select * from parquet.`/tmp`", "permission_denied"), ("select reflect('java.lang.System', 'exit', 1)", "permission_denied"), ("selec 1", "sql_error"), ("select nope from v_facts", "sql_error"), ("select * from range(201)", "row_limit_exceeded")):
        with pytest.raises(guard.SqlError) as e:
            guard.run(spark, query)
        assert e.value.code == code, query


def test_jobs(spark, tmp_path):
    queue = spark.createDataFrame([("s", 1, "done"), ("s", 2, "running")], "stage string, doc int, status string")
    new = spark.createDataFrame([("s", 1), ("s", 1), ("s", 2), ("s", 3)], "stage string, doc int")
    assert sorted(r["doc"] for r in jobs.enqueue(new, queue, ["stage", "doc"]).collect()) == [1, 3]


def test_job_states_as_a_stream(spark, tmp_path):
    """Claims, ends, retries, a wait after a failure, a late claim, and a stale run put back by its timer."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    begin = dt.datetime(2024, 5, 1, 12)
    first = [(1, "claim", 0), (1, "complete", 5), (2, "claim", 0), (2, "fail", 9), (2, "claim", 10), (3, "complete", 1), (4, "claim", 3), (5, "claim", 1), (5, "release", 2), (6, "claim", 0), (6, "fail_for_good", 1)]
    first += [(7, e, 10_000 * i + k) for i in range(5) for k, e in enumerate(("claim", "fail"))]
    late = [(2, "claim", 39_600), (5, "claim", 400), (8, "claim", 40_100), (7, "retry", 41_000)]  # of two late claims, that of 2 is within the allowed time
    last = [(9, "claim", 90_000)]
    for n, rows in enumerate((first, late, last)):
        spark.createDataFrame([(j, e, begin + dt.timedelta(seconds=s)) for j, e, s in rows], "job_id long, event string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("job_id long, event string, at timestamp").parquet(str(tmp_path / "in"))
        q = jobs.job_states(stream).writeStream.outputMode("update").foreachBatch(lambda df, i, n=n: df.write.mode("append").parquet(str(tmp_path / f"out{n}"))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(180)
    got = [sorted({(r["job_id"], r["status"], r["attempts"]) for r in spark.read.schema("job_id long, status string, attempts int").parquet(str(tmp_path / f"out{n}")).collect()}) for n in range(3)]
    assert [x for x in got[0] if x[0] != 4] == [(1, "done", 1), (2, "queued", 1), (3, "queued", 0), (5, "queued", 0), (6, "failed", 1), (7, "dead", 5)]
    assert (4, "running", 1) in got[0] and (4, "queued", 1) in got[0] + got[1]  # put back by its timer once time has passed
    assert (2, "running", 2) in got[1] and (7, "queued", 0) in got[1] and (8, "running", 1) in got[1]
    assert not any(x[0] == 5 for x in got[1])
    assert (9, "running", 1) in got[2] and (8, "queued", 1) in got[2]


def test_job_events_in_order():
    assert jobs.after(("queued", 1, 5000), "claim", 4000) == ("queued", 1, 5000)  # not before its wait is over
    assert jobs.after(("running", 1, 0), "complete", 900_000) == ("queued", 1, 900_000)  # too late: it has gone stale
    assert jobs.after(("running", 1, 0), "claim", 900_001) == ("running", 2, 900_001)
    assert jobs.after(("done", 1, 0), "retry", 1) == ("done", 1, 0)


def test_vector_search_in_blocks_and_within_a_label(spark, monkeypatch):
    """More queries than a block holds are broadcast in several; a label is matched before ranks are given."""
    df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)], i % 2) for i in range(40)], "vec_id long, embedding array<double>, label int")
    q = df.filter("vec_id < 9").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("ql"))
    rows = lambda d: sorted(map(tuple, d.collect()))
    whole = rows(search.vector_search_many(df, q, k=3))
    monkeypatch.setattr(vectors, "MAX_QUERIES", 3)
    blocked = search.vector_search_many(df, q, k=3)
    assert rows(blocked) == whole and len(whole) == 27
    near = rows(search.vector_search_many(df, q, k=3, within=("label", "ql")))
    ranked = rows(search.vector_search_many(df, q, k=40))
    want = sorted((i, v, s) for n in range(9) for i, v, s in [(i, v, s) for i, v, s, r in sorted(ranked, key=lambda t: (t[0], t[3])) if i == n and v % 2 == n % 2][:3])
    assert [t[:3] for t in near] == want
