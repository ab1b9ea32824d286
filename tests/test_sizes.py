"""Queries on rows that the small test tables do not have."""

import re

import duckdb
import pytest

from townledger.functions import text as T
from townledger.operators import facts, rules, search
from townledger.plans import registry

from test_queries import rows


def check(spark, folder, name, **tables):
    """A query over the given tables (name: rows, schema) equals its SQL."""
    duck = duckdb.connect()
    for t, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        duck.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    assert rows(registry.QUERIES[name](spark, str(folder)).toPandas()) == rows(duck.execute(registry.ORACLES[name]).df())


def test_numbers_of_ids_that_look_like_the_amount(spark, tmp_path):
    ids = [0, 7, 20, 30, 500, 999, 12499, 12500, 12600, 12999, 112600, 1012600]
    check(spark, tmp_path, "numeric_subset", documents=([(i,) for i in ids], "doc_id long"))


def test_page_layout_sorts_no_words_by_shuffle(spark):
    plan = registry.QUERIES["page_layout"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(page" not in plan


def test_documents_of_no_and_many_words(spark, tmp_path):
    texts = [None, "", "--", "a", " ".join(f"w{i}" for i in range(240)), " ".join(f"w{i}" for i in range(2000)), "Ünï café x" * 50]
    check(spark, tmp_path, "page_layout", documents=([(i, texts[i % 7]) for i in range(42)], "doc_id long, text string"))


def test_a_text_is_split_and_squeezed_once(spark):
    """What the rules use several times is worked out once for an item, not once for each use."""
    df = spark.createDataFrame([(1, "i", "t", "In Favor: A\nB | Aye")], "id int, identifier string, title string, text string")
    plan = rules.rule_facts(df, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(coalesce(text") <= 1


def test_lines_come_from_arrow_columns(spark, tmp_path):
    texts = [None, "", "\n", "a\n\nbé\n", "\r\nx", "no end"]
    check(spark, tmp_path, "line_offsets", documents=([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    plan = registry.QUERIES["line_offsets"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan


@pytest.mark.parametrize("name", ["line_packing", "normalize_text"])
def test_batches_for_python_end_by_bytes(spark, name):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_tokens_of_ids_that_stand_twice_or_nowhere(spark, tmp_path):
    texts = ["aa bb aa", "bb the cc bb", None, "", "aa"]
    check(spark, tmp_path, "tokenize", documents=([(i, t) for i, t in zip([1, 1, 2, 3, None], texts)], "doc_id long, text string"))
    check(spark, tmp_path / "own", "tokenize", documents=([(i, t) for i, t in zip([1, 4, 2, 3, None], texts)], "doc_id long, text string"))
    plan = registry.QUERIES["tokenize"](spark, str(tmp_path / "own"))._jdf.queryExecution().executedPlan().toString()
    assert "distinct" not in plan and plan.count("HashAggregate") == 2


def test_cases_move_before_they_are_repeated_for_samples(spark):
    plan = registry.QUERIES["extraction_accuracy"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joined = [x for x in plan.split("\n") if "hashpartitioning(document_id" in x]
    assert joined and not any("sample" in x for x in joined)


@pytest.mark.parametrize("ids", [[1, 2, 3, 4, 5, 6, 7, 8], [1, 1, 2, 3, 3, 3, 4, None], ["b", "a", None, "d", "c", "f", "e", "g"]])
def test_best_passages_of_many_queries_are_kept_inside_tasks(spark, ids):
    texts = ["aa bb aa", "bb cc, the AA", None, "", "aa aa\ncc cc", "dd", "bb-aa", "cc aa"]
    df = spark.createDataFrame(list(zip(ids, texts)), f"doc_id {'string' if isinstance(ids[1], str) else 'long'}, text string").repartition(3)
    asked = spark.createDataFrame([(7, "aa AA bb"), (8, "cc the"), (8, "cc"), (9, "zz"), (None, "dd cc")], "query_id long, query string")
    found = search.keyword_search_many(df, asked, k=2)
    want = {}
    for q, terms in {7: "aa bb", 8: "cc", 9: "zz", None: "dd cc"}.items():
        hits = {i: sum(w in terms.split() for j, t in zip(ids, texts) if i == j for w in re.findall("[a-z0-9]+", (t or "").lower())) for i in set(ids)}
        order = sorted((-n, i is not None, i or type(ids[0])(), i) for i, n in hits.items() if n)[:2]
        want |= {(q, x[3]): (-x[0], rank) for rank, x in enumerate(order, 1)}
    assert {(r["query_id"], r["doc_id"]): (r["hits"], r["rank"]) for r in found.collect()} == want
    if len(set(ids)) == len(ids):
        assert "explode" not in found._jdf.queryExecution().executedPlan().toString()


def test_words_of_a_text_are_cut_between_words():
    low = "ab cd, é12ef\0ggg  h".encode()
    for size in range(1, 20):
        assert sum(T.word_runs(low, size), []) == [b"ab", b"cd", b"12ef", b"ggg", b"h"]


@pytest.mark.parametrize("name", ["bag_search", "hashed_bow", "hybrid_search"])
def test_words_of_bags_are_hashed_once_in_a_task(spark, tmp_path, name):
    texts = [None, "", "the of", "Thread THREAD hely é", "reation, ndster" + " x" * 9, "x\0thread a b", "Ünï THE hely ndster thread", "zz yy xx", "thread"]
    docs = [(i, t, f"s{i % 4}") for i, t in enumerate(texts)]
    check(spark, tmp_path, name, documents=(docs, "doc_id long, text string, source string"))
    plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "sha2" not in plan


@pytest.mark.parametrize("name", ["keyword_search_near", "keyword_search_stems"])
def test_words_of_stems_are_found_in_one_pass(spark, tmp_path, name):
    near = "erators thonly Thtioning, did erator é thonly x y thtionings THONLY erator"
    texts = [None, "", "the of", near, near.upper(), "eratings of things", "era" + "s" * 60 + "q ndster " + near, "ndsters\0erate onherly thing " + near * 3, "x " * 50 + near]
    check(spark, tmp_path, name, documents=(list(enumerate(texts)), "doc_id long, text string"))
    plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "regexp" not in plan


def test_quotes_of_a_text_are_placed_with_one_pass_over_its_white_space(spark, tmp_path):
    texts = [None, "", " \n\t ", "a\tb \n c" * 400, "ab  cd " * 700 + "é\n", "x" * 1200, "y" * 1201, "\\Qa.b*\\E  [c] " * 200]
    check(spark, tmp_path, "quote_locate", documents=(list(enumerate(texts)), "doc_id long, text string"))
    plan = registry.QUERIES["quote_locate"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp_extract" not in plan
    assert facts.spans(" aa b\x1cc aa b", ["aa  b", "a\nb\tc", "b c", " ", None, "a", "zz", "c aa"]) == [(1, 5), (2, 7), (4, 7), None, None, (1, 2), None, (6, 10)]
