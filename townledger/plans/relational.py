"""Relational queries: filters, joins, grouped and windowed views, sorts and set operations over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from townledger.operators.ordered import numbered
from townledger.operators.search import where_all
from townledger.plans.tables import table


def paged_sort(spark, d):
    return table(spark, d, "orders").orderBy(F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last()).offset(40).limit(20).select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("total"))


def json_extract(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).groupBy("k").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def facts_listing(spark, d):
    """Orders with customer and nation, filtered by what is asked, newest first."""
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    kept = where_all(joined, F.col("o_orderstatus") == "F", F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp"), None, F.instr(F.lower("c_mktsegment"), "mach") > 0)
    return kept.orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(100).select("o_orderkey", "c_name", "n_name", F.round("o_totalprice", 2).alias("total"))


def left_join_on_predicate(spark, d):
    """Every customer with its open orders: the predicate is part of the join, so customers without one stay."""
    o = table(spark, d, "orders").filter("o_orderstatus = 'O'")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("open_orders"))


def segmentation_counts(spark, d):
    li = table(spark, d, "lineitem").filter("l_returnflag = 'R'")
    return table(spark, d, "orders").select("o_orderkey").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_linenumber").alias("returned")).groupBy("returned").agg(F.count("*").alias("orders"))


def lateral_explode(spark, d):
    words = F.filter(F.split("p_name", " "), lambda w: F.length(w) > 3)
    return table(spark, d, "part").select("p_brand", F.explode(words).alias("word")).groupBy("p_brand", "word").agg(F.count("*").alias("n"))


def semi_join_flag(spark, d):
    late = table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("large", F.lit(True))
    return table(spark, d, "orders").join(late, "o_orderkey", "left").select("o_orderkey", F.coalesce("large", F.lit(False)).alias("large"))


def anti_join_latest(spark, d):
    """Users' last error when no purchase came after it."""
    e = table(spark, d, "events")
    last = e.filter("event_type = 'error'").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    bought = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("bought"))
    return last.join(bought, (last["user_id"] == bought["user_id"]) & (bought["bought"] > last["event_id"]), "left_anti")


def group_summary(spark, d):
    n = table(spark, d, "nation")
    per = table(spark, d, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("s"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), F.count("*").alias("customers"))
    out = n.join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return out.select("n_name", F.array_join(F.coalesce("s", F.array().cast("array<string>")), ",").alias("segments"), "lo", "hi", F.coalesce("customers", F.lit(0)).alias("customers"))


def content_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha"))
    first = docs.groupBy("lang", "sha").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return docs.join(first, ["lang", "sha"]).select("doc_id", "first_id", "copies", F.when(F.col("doc_id") == F.col("first_id"), "downloaded").otherwise("duplicate").alias("status"))


def count_over_all(spark, d):
    docs = table(spark, d, "documents").filter("n_chars > 2000")
    total = docs.agg(F.count("*").alias("total"))
    return docs.orderBy("doc_id").limit(20).join(F.broadcast(total)).select("doc_id", "n_chars", "total")


def sequential_label_ids(spark, d):
    docs = numbered(table(spark, d, "documents").select("source", "doc_id"), ["source"], ["doc_id"], "n")
    return docs.select("doc_id", F.concat_ws("-", "source", F.lpad(F.col("n").cast("string"), F.greatest(F.length(F.col("n").cast("string")), F.lit(4)), "0")).alias("label_id"))


def next_boundary(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    c = c.withColumn("start", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return c.withColumn("next_start", F.lead("start").over(w)).select("conv_id", "turn", "start", F.coalesce("next_start", F.col("start") + F.col("n")).alias("end"))


def union_distinct(spark, d):
    ids = [table(spark, d, "labels").filter("toxic = 1").select("doc_id"), table(spark, d, "documents").filter("n_chars > 9000").select("doc_id"), table(spark, d, "documents").filter("lang = 'es'").select("doc_id")]
    return ids[0].union(ids[1]).union(ids[2]).distinct()


def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def region_revenue(spark, d):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    j = table(spark, d, "lineitem").join(table(spark, d, "orders").filter(F.year("o_orderdate") == 1997), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.round(F.sum(net), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


QUERIES = {f.__name__: f for f in (paged_sort, json_extract, facts_listing, left_join_on_predicate, segmentation_counts, lateral_explode, semi_join_flag, anti_join_latest, group_summary, content_dedup, count_over_all, sequential_label_ids, next_boundary, union_distinct, pricing_summary, region_revenue)}
ORACLES = {
    "paged_sort": "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40",
    "json_extract": "SELECT (props->>'$.k')::INT AS k, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1",
    "facts_listing": "SELECT o_orderkey, c_name, n_name, round(o_totalprice, 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1997-01-01' AND strpos(lower(c_mktsegment), 'mach') > 0 ORDER BY o_orderdate DESC, o_orderkey LIMIT 100",
    "left_join_on_predicate": "SELECT c_custkey, count(o_orderkey) AS open_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'O' GROUP BY c_custkey",
    "segmentation_counts": "SELECT returned, count(*) AS orders FROM (SELECT o_orderkey, count(l_linenumber) AS returned FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey) GROUP BY returned",
    "lateral_explode": "SELECT p_brand, word, count(*) AS n FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS word FROM part) WHERE length(word) > 3 GROUP BY ALL",
    "semi_join_flag": "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49) AS large FROM orders",
    "anti_join_latest": "SELECT user_id, event_id FROM (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY user_id) l WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND b.user_id = l.user_id AND b.event_id > l.event_id)",
    "group_summary": "SELECT n_name, coalesce(string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment), '') AS segments, min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name",
    "content_dedup": "SELECT doc_id, min(doc_id) OVER w AS first_id, count(*) OVER w AS copies, CASE WHEN doc_id = min(doc_id) OVER w THEN 'downloaded' ELSE 'duplicate' END AS status FROM documents WINDOW w AS (PARTITION BY lang, sha256(text))",
    "count_over_all": "SELECT doc_id, n_chars, count(*) OVER () AS total FROM documents WHERE n_chars > 2000 ORDER BY doc_id LIMIT 20",
    "sequential_label_ids": "SELECT doc_id, source || '-' || lpad(n, greatest(4, length(n))::INT, '0') AS label_id FROM (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id))::VARCHAR AS n FROM documents)",
    "next_boundary": "WITH c AS (SELECT conv_id, turn, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations) SELECT conv_id, turn, start, coalesce(lead(start) OVER (PARTITION BY conv_id ORDER BY turn), start + n)::BIGINT AS \"end\" FROM c",
    "union_distinct": "SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM documents WHERE n_chars > 9000 UNION SELECT doc_id FROM documents WHERE lang = 'es'",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "region_revenue": "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE year(o_orderdate) = 1997 GROUP BY r_name",
}
