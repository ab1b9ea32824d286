"""Queries of records, answers, chunks and hits over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from townledger.functions import text as T
from townledger.operators import records as R
from townledger.operators import search as S
from townledger.operators import structure as X
from townledger.plans.retrieval import _BAG, _KW, QUESTION
from townledger.plans.structural import ORACLES as STRUCTURE
from townledger.plans.tables import table


def record_equality(spark, d):
    """Orders as gold records of five kinds, and changed ones as found."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c"), (F.col("o_orderkey") % 5).cast("int").alias("k"), (F.col("o_custkey") % 3).cast("int").alias("m"), F.col("o_orderstatus").alias("s"))
    text = lambda same, other: F.when(F.col("m") != 0, same).otherwise(other)

    def record(found: bool):
        who = text(F.concat(F.lit("A. B"), F.col("c").cast("string")), F.concat(F.lit("A. X"), F.col("c").cast("string"))) if found else F.concat(F.lit("Ann  b"), F.col("c").cast("string"))
        n = (F.col("c") % 9 + ((F.col("m") == 0).cast("int") if found else 0)).cast("int")
        member = F.struct(who.alias("name"), F.lit("aye").alias("value"))
        return F.struct(who.alias("mover"), F.lit(None).cast("string").alias("seconder"), n.alias("ayes"), F.lit(1).alias("noes"), F.lit(0).alias("abstain"), F.lit(0).alias("absent"), F.when(F.col("c") % 2 == 0, F.array(member)).alias("members"),
                        F.concat(F.lit("cb  " if found else "CB "), n.cast("string")).alias("identifier"), F.col("s").alias("outcome"), (n + F.lit(0.004 if found else 0.0)).alias("amount_usd"), who.alias("speaker"))

    kind = F.element_at(F.array(*map(F.lit, ("vote", "amount", "motion", "ordinance", "statement"))), F.col("k") + 1)
    rows = o.select("o_orderkey", kind.alias("kind"), record(False).alias("gold"), record(True).alias("found"))
    return rows.select("o_orderkey", R.same_record(F.col("kind"), F.col("gold"), F.col("found")).alias("same"))


def answer_validity(spark, d):
    o = table(spark, d, "orders")
    kind = F.element_at(F.array(F.lit("number"), F.lit("date"), F.lit("name")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    answer = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 5 == 0, " ").otherwise(F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", R.valid_answer(kind, answer).alias("valid"))


def answer_metrics(spark, d):
    e = table(spark, d, "events").select("event_type", (F.col("event_id") % 3 > 0).alias("answerable"), (F.col("user_id") % 4 == 0).alias("declined"), (F.col("user_id") % 5 < 3).alias("correct"), (F.col("event_id") % 4).alias("supported"), (F.col("event_id") % 4 + F.col("user_id") % 2).alias("sentences"), F.col("value").alias("latency_ms"))
    return R.answer_metrics(e, "event_type")


def agent_metrics(spark, d):
    e = table(spark, d, "events")
    return R.agent_metrics(e.select("event_type", (F.col("event_id") % 3 > 0).alias("completed"), F.array(F.col("event_id") % 5, F.col("event_id") % 7).alias("cited"), F.array(F.col("event_id") % 5, F.col("user_id") % 7).alias("gold"), (F.col("user_id") % 9).alias("steps")), "event_type")


def find_all(spark, d):
    return R.find_all(table(spark, d, "documents"), "doc_id", "text", "the ").select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def quote_units(spans, d):
    """Spans of 300 characters over turns of conversations, as offsets in each turn."""
    units = table(spans, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("unit"), F.length("text").alias("length"))
    rows = units.groupBy("document_id").agg(F.sum(F.col("length") + 1).alias("n")).select("document_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(250))).alias("start")).withColumn("end", F.col("start") + 300)
    out = R.unit_offsets(rows, units)
    return out.select("document_id", F.col("start").cast("long").alias("start"), "unit", F.col("unit_start").cast("long").alias("unit_start"), F.col("unit_end").cast("long").alias("unit_end"))


def image_ratio(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_linenumber") != 2, F.col("l_quantity"))).alias("a"), F.sum("l_quantity").alias("page"))
    return li.select("l_orderkey", F.round(T.image_area_ratio(F.col("a"), F.col("page")), 6).alias("ratio"))


def hit_headings(spark, d):
    docs = table(spark, d, "documents")
    item = F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 11).cast("string"))
    args = (F.col("source"), F.lit("Board"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")), F.col("lang"), item)
    link = T.recording_link(F.lit("v?id=7"), F.col("doc_id") * 997, F.col("doc_id") % 2 == 0)
    return docs.select("doc_id", T.hit_heading(*args).alias("heading"), F.md5(T.hit_snippet(F.col("text"))).alias("snippet"), T.chunk_header(*args, F.lit("On water")).alias("header"), link.alias("link"))


def chunk_stage(spark, d):
    """Chunks of documents by both chunkers, with headers and the columns that searches filter by."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    fixed = X.fixed_windows(docs, "doc_id", "text").select("doc_id", F.lit("fixed").alias("chunker"), (F.col("window") + 1).alias("ordinal"), "start", "end")
    lines = X.line_chunks(docs, "doc_id", "text").select("doc_id", F.lit("item").alias("chunker"), "ordinal", "start", "end")
    return fixed.unionByName(lines).join(docs.select("doc_id", "lang", "source"), "doc_id").withColumn("header", F.concat_ws(" ", "source", "lang", F.concat(F.lit("| "), F.col("ordinal").cast("string"))))


def own_first(spark, d):
    """Documents of one source first, the others after, by id."""
    return table(spark, d, "documents").orderBy((F.col("source") == "src3").desc_nulls_last(), "doc_id").limit(150).select("doc_id", "source")


def label_counts(spark, d):
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("other")
    return R.counts_with_zeros(table(spark, d, "labels").withColumn("kind", kind), "kind", ["good", "other", "toxic", "unseen"])


def minimums(spark, d):
    return R.below_minimum(table(spark, d, "documents"), "source", rows=50, n_chars=150_000)


def upsert_runs(spark, d):
    e = table(spark, d, "events")
    old = e.filter("event_id % 2 = 0").select(F.pmod("event_id", F.lit(500)).alias("run"), "user_id").groupBy("run").agg(F.min("user_id").alias("v"))
    new = e.filter("event_id % 3 = 0").select(F.pmod("event_id", F.lit(700)).alias("run"), "user_id").groupBy("run").agg(F.max("user_id").alias("v"))
    return R.upsert(old, new, "run")


def search_filtered(spark, d):
    docs = S.where_all(table(spark, d, "documents"), F.col("lang") == "en", F.col("n_chars") >= 200)
    return S.search(docs, QUESTION, "keyword", k=20).select("doc_id", "rank", F.round("score", 6).alias("score"))


def search_vector(spark, d):
    return S.search(table(spark, d, "documents"), QUESTION, "vector", k=20).select("doc_id", "rank", F.round("score", 6).alias("score"))


def search_fused(spark, d):
    return S.search(table(spark, d, "documents"), QUESTION, "hybrid", k=20).select("doc_id", "rank", F.round("score", 8).alias("score"))


_FUSED = f"WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({_KW})), b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({_BAG})), f AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM (SELECT * FROM k UNION ALL SELECT * FROM b) GROUP BY doc_id)"
_TOP = "SELECT doc_id, row_number() OVER (ORDER BY {0} DESC, doc_id) AS rank, round({0}, {1}) AS score FROM {2} QUALIFY rank <= 20"

QUERIES = {f.__name__: f for f in (record_equality, answer_validity, answer_metrics, agent_metrics, find_all, quote_units, image_ratio, hit_headings, chunk_stage, own_first, label_counts, minimums, upsert_runs, search_filtered, search_vector, search_fused)}
ORACLES = {
    "record_equality": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN o_custkey % 3 != 0 ELSE o_custkey % 3 != 0 END AS same FROM orders",
    "answer_validity": r"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN regexp_full_match(a, '-?\d+(\.\d+)?') WHEN 1 THEN try_cast(a AS DATE) IS NOT NULL AND length(a) = 10 ELSE length(trim(a)) > 0 END AS valid FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_custkey::VARCHAR END AS a FROM orders)",
    "answer_metrics": "SELECT event_type, round(avg((user_id % 5 < 3)::INT) FILTER (event_id % 3 > 0), 6) AS accuracy, round(avg((user_id % 4 = 0)::INT) FILTER (event_id % 3 = 0), 6) AS decline, round(avg((user_id % 4 = 0)::INT) FILTER (event_id % 3 > 0), 6) AS false_decline, round(sum(event_id % 4)::DOUBLE / sum(event_id % 4 + user_id % 2), 6) AS faithfulness, (list_sort(list(value)))[ceil(0.5 * count(*))::INT] AS p50, (list_sort(list(value)))[ceil(0.95 * count(*))::INT] AS p95 FROM events GROUP BY event_type",
    "agent_metrics": "SELECT event_type, round(avg((event_id % 3 > 0)::INT), 6) AS completion, round(avg(len(list_distinct(list_intersect([event_id % 5, event_id % 7], [event_id % 5, user_id % 7])))::DOUBLE / len(list_distinct([event_id % 5, user_id % 7]))), 6) AS recall, round(avg(user_id % 9), 6) AS steps FROM events GROUP BY event_type",
    "find_all": "WITH p AS (SELECT doc_id, string_split(text, 'the ') AS p FROM documents), x AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i, len(p) AS n FROM p), s AS (SELECT doc_id, i, n, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT + (i - 1) * 4 AS start FROM x) SELECT doc_id, start, start + 4 AS \"end\" FROM s WHERE i < n",
    "quote_units": "WITH u AS (SELECT conv_id AS document_id, turn AS unit, length(text) AS n, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM conversations), s AS (SELECT document_id, unnest(range(0, sum(n + 1)::BIGINT, 250)) AS start FROM u GROUP BY 1) SELECT document_id, start, unit, greatest(0, start - pos)::BIGINT AS unit_start, least(n, start + 300 - pos)::BIGINT AS unit_end FROM s JOIN u USING (document_id) WHERE start < pos + n AND start + 300 > pos",
    "image_ratio": "SELECT l_orderkey, round(coalesce(max(l_quantity) FILTER (l_linenumber != 2) / sum(l_quantity), 0)::DOUBLE, 6) AS ratio FROM lineitem GROUP BY 1",
    "hit_headings": "SELECT doc_id, source || ' Board, ' || d || ', ' || lang || CASE WHEN doc_id % 3 = 0 THEN ', item ' || doc_id % 11 ELSE '' END AS heading, md5(substr(replace(text, chr(10), ' '), 1, 240)) AS snippet, substr(concat_ws(' ', source, 'Board', d, lang) || CASE WHEN doc_id % 3 = 0 THEN ' | ' || doc_id % 11 || ' On water' ELSE '' END, 1, 200) AS header, CASE WHEN doc_id % 2 = 0 THEN 'v?id=7&entrytime=' || doc_id * 997 // 1000 END AS link FROM (SELECT *, (DATE '2024-01-01' + (doc_id % 300)::INT)::DATE::VARCHAR AS d FROM documents)",
    "chunk_stage": f"WITH c AS (SELECT doc_id, 'fixed' AS chunker, \"window\" + 1 AS ordinal, start, \"end\" FROM ({STRUCTURE['fixed_windows']}) UNION ALL SELECT doc_id, 'item', ordinal, start, \"end\" FROM ({STRUCTURE['line_packing']})) SELECT c.*, lang, source, concat_ws(' ', source, lang, '| ' || ordinal) AS header FROM c JOIN documents USING (doc_id)",
    "own_first": "SELECT doc_id, source FROM documents ORDER BY coalesce(source = 'src3', FALSE) DESC, doc_id LIMIT 150",
    "label_counts": "SELECT v AS value, count(k) AS n FROM (SELECT unnest(['good', 'other', 'toxic', 'unseen']) AS v) LEFT JOIN (SELECT CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'other' END AS k FROM labels) ON k = v GROUP BY v",
    "minimums": "SELECT source, m.measure AS measure, m.n AS n, m.least AS least FROM (SELECT source, unnest([{'measure': 'rows', 'n': count(*)::BIGINT, 'least': 50}, {'measure': 'n_chars', 'n': sum(n_chars)::BIGINT, 'least': 150000}]) AS m FROM documents GROUP BY source) WHERE m.n < m.least",
    "upsert_runs": "WITH o AS (SELECT event_id % 500 AS run, min(user_id) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), n AS (SELECT event_id % 700 AS run, max(user_id) AS v FROM events WHERE event_id % 3 = 0 GROUP BY 1) SELECT * FROM n UNION ALL SELECT * FROM o WHERE run NOT IN (SELECT run FROM n)",
    "search_filtered": _TOP.format("score", 6, "(" + _KW.replace("FROM documents WHERE", "FROM documents WHERE lang = 'en' AND n_chars >= 200 AND") + ")"),
    "search_vector": _TOP.format("score", 6, f"({_BAG})"),
    "search_fused": f"{_FUSED} " + _TOP.format("s", 8, "f"),
}
