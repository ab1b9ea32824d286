from pyspark.sql import functions as F

from townledger.operators import facts, hits, matching, rules

RECORD = (
    "struct<mover:string,seconder:string,ayes:int,noes:int,abstain:int,absent:int,members:array<struct<name:string,value:string>>,"
    "identifier:string,outcome:string,amount_usd:double,speaker:string>"
)


def _record(amount=None, speaker=None):
    return (None, None, None, None, None, None, None, None, None, amount, speaker)


def test_a_case_is_right_if_any_accepted_prediction_meets_it(spark):
    cases = spark.createDataFrame(
        [("d", "amount", 1, 10, 20, "x", _record(5.0)), ("d", "amount", 1, 10, 20, "x", _record(5.0)), ("d", "amount", 2, 0, 9, "y", _record(7.0)), (None, "amount", 1, 0, 9, None, _record(1.0))],
        f"document_id string, kind string, unit int, start int, end int, city string, gold {RECORD}",
    )
    given = [
        (0, "d", "amount", 1, 19, 30, _record(5.0), None), (0, "d", "amount", 1, 10, 20, _record(5.0), None),  # two for one case
        (1, "d", "amount", 1, 20, 30, _record(5.0), None), (1, "d", "amount", 1, 0, 10, _record(5.0), None),  # beside it
        (2, "d", "amount", 1, 10, 20, _record(5.0), "quote_not_found"), (2, "d", "amount", 2, 8, 9, _record(7.001), None),
        (3, "d", "amount", 1, 10, 20, _record(9.0), None), (4, None, "amount", 1, 0, 9, _record(1.0), None), (5, "d", "amount", 1, 10, 20, _record(5.0), None), (0, "d", "vote", 2, 0, 9, _record(7.0), None),
    ]
    found = spark.createDataFrame(given, f"sample int, document_id string, kind string, unit int, start int, end int, record {RECORD}, error string")
    assert sorted((r["sample"], r["unit"]) for r in matching.right_cases(cases, found).collect()) == [(0, 1), (0, 1), (2, 2)]
    got = {(r["level"], r["name"]): (r["cases"], r["runs"], r["least"], r["median"], r["most"]) for r in matching.extraction_accuracy(cases, found).collect()}
    assert got == {("overall", "all"): (4, 5, 0.0, 0.0, 0.5), ("kind", "amount"): (4, 5, 0.0, 0.0, 0.5), ("city", "x"): (2, 5, 0.0, 0.0, 1.0), ("city", "y"): (1, 5, 0.0, 0.0, 1.0), ("city", None): (1, 5, 0.0, 0.0, 0.0)}
    assert [tuple(r) for r in matching.reject_rate(found).collect()] == [(10, 1, 0.1)]
    assert [tuple(r) for r in matching.reject_rate(found.limit(0)).collect()] == [(0, 0, 0.0)]
    assert matching.extraction_accuracy(cases.limit(0), found).count() == 0
    assert {r["most"] for r in matching.extraction_accuracy(cases, found.limit(0)).collect()} == {0.0}


def test_facts_by_rules(spark):
    text = "\n".join([
        "1. RESOLUTION 2024-7 and Res 12, CB 1", "Councilmember Ångström motioned to approve, motion was seconded by", "Commissioner Bo", "In Favor: 2 - Ann Gee, Bo Opposed: None", "between",
        "Cy  | No ", "Dee | Excused", "Fee $1,200.50 and $3", "Passed by the body, CB 12",
    ])
    df = spark.createDataFrame([(1, "9.A", "T", text), (2, "x", None, None), (3, None, None, ""), (4, "4.B", "T", "Ayes: A\nNoes: B, C"), (5, "e", "T", "| aye")], "id int, identifier string, title string, text string")
    got = [r.asDict(True) for r in rules.rule_facts(df, "id").orderBy("id", "number").collect()]
    one = [g for g in got if g["id"] == 1]
    assert [(g["kind"], text[g["start"] : g["end"]] == g["quote"]) for g in one] == [("vote", True), ("amount", True), ("amount", True), ("motion", True)] + [("ordinance", True)] * 4
    vote = one[0]
    assert (vote["identifier"], vote["ayes"], vote["noes"], vote["absent"], vote["outcome"]) == ("RESOLUTION 2024-7", 2, 1, 1, "passed") and vote["quote"].count("\n") == 3
    assert [(m["name"], m["value"]) for m in vote["members"]] == [("Ann Gee", "aye"), ("Bo", "aye"), ("Cy", "no"), ("Dee", "absent")]
    assert [(g["amount_usd"], g["title"]) for g in one[1:3]] == [(1200.5, "T"), (3.0, "T")]
    assert (one[3]["mover"], one[3]["seconder"], one[3]["outcome"]) == ("Ångström", "Bo", "passed")
    laws = [(g["identifier"], g["legislation_type"], g["start"]) for g in one[4:]]
    assert laws == [("RESOLUTION 2024-7", "resolution", 0), ("Res 12", "resolution", 0), ("CB 1", "council_bill", 0), ("CB 12", "council_bill", text.index("Passed"))]
    rest = [(g["id"], g["kind"], g["identifier"], g["ayes"], g["noes"], g["outcome"], len(g["members"])) for g in got if g["id"] != 1]
    assert rest == [(4, "vote", "4.B", 1, 2, "failed", 3), (5, "vote", "e", 1, 0, "passed", 1)]


def test_quotes_are_found_across_any_white_space(spark):
    df = spark.createDataFrame([("x a b c", "a b  c"), ("a\u001cb", "a b"), ("ab", "a b")], "source string, quote string")
    assert [r["at"] and tuple(r["at"]) for r in df.select(facts.place(F.col("source"), F.col("quote")).alias("at")).collect()] == [(2, 7), (0, 3), None]


def test_spans_of_an_item_and_of_the_linked_one(spark):
    chunks = spark.createDataFrame([(1, 10, 2, 4), (2, 10, 1, 3), (3, 10, 3, 1), (4, 20, 1, 2), (5, 20, 2, 9), (6, 20, 3, 0), (7, None, 1, 50), (8, 30, 1, None)], "chunk_id int, item_id int, ordinal int, size int")
    items = spark.createDataFrame([(10, 20), (20, 20), (30, 99)], "item_id int, linked_item_id int")
    found = spark.createDataFrame([("q", 1, 2), ("q", 3, 1), ("q", 7, 3), ("r", 5, 1), ("r", 8, 2), ("r", 77, 3)], "query_id string, chunk_id int, rank int")
    best = hits.best_of_items(hits.hydrate(found, chunks, items))
    assert sorted((r["query_id"], r["chunk_id"]) for r in best.collect()) == [("q", 3), ("q", 7), ("r", 5), ("r", 8)]
    spans = lambda budget: {k: [c for _, c in sorted(v)] for k, v in _grouped(hits.item_spans(best, chunks, budget)).items()}
    assert spans(9000) == {("q", 3): [3, 2, 1, 4, 5, 6], ("q", 7): [7], ("r", 5): [5, 4, 6], ("r", 8): [8]}
    assert spans(10) == {("q", 3): [3, 2, 1, 4], ("q", 7): [7], ("r", 5): [5], ("r", 8): [8]}  # a span too long ends the list
    assert hits.item_spans(best.limit(0), chunks).count() == 0


def _grouped(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["query_id"], r["hit"]), []).append((r["position"], r["chunk_id"]))
    return out
