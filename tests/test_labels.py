from pyspark.sql import functions as F

from townledger.operators import labels as L

LABEL = "type string, city string, answerable boolean, question_type string, reason string, kind string, documents array<struct<id:string,kind:string>>"


def test_rules_without_labels_and_with_nulls(spark):
    bounds = [L.Bound("Q-1", 1, 1, whole=True), L.Bound("Q-3", 1, 1, "answerable"), L.Bound("Q-5", 1), L.Bound("Q-6", None, 1), L.Bound("X-2", None, 0, "vote")]
    broken = lambda rows: sorted((r["rule"], r["city"] or "", r["part"] or "", r["n"]) for r in L.label_violations(spark.createDataFrame(rows, LABEL), bounds, ["a"]).collect())
    assert broken([]) == [("Q-1", "", "", 0), ("Q-3", "a", "answerable", 0), ("Q-5", "a", "", 0)]
    asked = ("question", "a", True, None, None, None, [("7", "k"), ("7", "k")])
    assert broken([asked]) == []
    assert broken([asked, asked, (None,) * 7, ("extraction", "b", None, None, None, "vote", None)]) == [("Q-1", "", "", 2), ("Q-3", "a", "answerable", 2), ("Q-6", "a", "7", 2), ("X-2", "b", "vote", 1)]


def test_answers_are_declined_or_renumbered(spark):
    cases = [(0, [("A.", [9, 4], True), ("B.", [2], False), ("C.", [4, 7], True)]), (1, [("A.", [1], True), ("B.", [1], False), ("C.", [1], None)]), (2, []), (3, None), (4, [("A.", [], True)])]
    df = spark.createDataFrame(cases, "i int, s array<struct<text:string,cites:array<int>,supported:boolean>>")
    got = {r["i"]: (r["text"], r["cites"], r["reason"]) for r in df.select("i", L.finalize(F.col("s")).alias("f")).select("i", "f.*").collect()}
    assert got[0] == ("A. [1][2] C. [2][3]", [9, 4, 7], None) and got[1] == (None, None, "unsupported") and got[2][2] == got[3][2] == "unsupported" and got[4] == ("A.", [], None)
