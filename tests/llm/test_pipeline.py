import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_models import toxic_corpus
from townledger.llm.common import shared_dir, stored


def test_stages_keep_clean_rows_and_all_columns(spark, odd, tmp_path):
    """Each stage on odd rows: what goes is what its rule names, and what stays is as it was."""
    long = " ".join("w%d" % (i * i % 977) for i in range(60))
    spark.createDataFrame([(1, "nothing of this"), (2, " ".join(long.split()[20:40]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    extra = odd.filter("doc_id = 6").limit(1).withColumns({"doc_id": F.lit(500).cast("long"), "text": F.lit(long)})
    docs = odd.unionByName(extra)
    folder = shared_dir(spark)
    key = lambda r: (r["doc_id"], r["text"])
    before = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        rows = {key(r): tuple(r) for r in docs.collect()}
        docs = stored(stage(spark, docs, str(tmp_path)), f"{folder}/{i}")
        assert docs.columns == odd.columns
        after = docs.collect()
        assert all(rows[key(r)] == tuple(r) for r in after)
        before[name] = set(rows) - {key(r) for r in after}
    assert all(not any(c.isalpha() for c in t or "") for _, t in before["language ID"])
    assert not before["toxicity"]
    assert {i for i, _ in before["n-gram Jaccard join"]} >= {5, 7, 8, 15} and not {i for i, _ in before["n-gram Jaccard join"]} & {4, 6, 9, 10, 500, None}
    assert {i for i, _ in before["benchmark decontamination"]} == {500}
    ids = [r["doc_id"] for r in docs.collect()]
    assert ids.count(6) == 1
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in pieces.collect()} == set(ids)


def test_copies_go_row_by_row(spark):
    """Null ids, copies without any id, and different texts under one id: one row of each group stays, and every unique text."""
    text = lambda k: " ".join("%s%d" % (k, i * i % 977) for i in range(60))
    rows = [(7, text("a")), (3, text("a") + " more"), (None, text("a")), (None, text("u")), (None, text("p")), (None, text("p")), (7, text("t")), (9, text("v")), (9, text("w")), (9, text("w")), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.deduplicate(spark, docs, "").collect()]
    want = [(3, text("a") + " more"), (None, text("u")), (None, text("p")), (7, text("t")), (9, text("v")), (9, text("w")), (None, None), (4, "")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_toxic_documents_go_and_clean_ones_stay(spark, tmp_path):
    rows, labels = toxic_corpus()
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows] + [(None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.clean(spark, docs, str(tmp_path)).collect()}
    toxic = {i for i, y in labels if y}
    assert None in kept and len(kept & toxic) <= 0.03 * len(toxic) and len(kept - toxic) >= 0.97 * (len(labels) - len(toxic))


def test_pipeline_of_nothing(spark, none, tmp_path):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "an item of some words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
