"""Queries of the evaluation suite: corpus statistics, run summaries, agreement, coverage, gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from townledger.functions import text as T
from townledger.operators import metrics as M
from townledger.plans.tables import table


def corpus_stats_docs(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))


def corpus_stats_pivot(spark, d):
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs"), *[one(F.col("lang") == x).alias(x) for x in ("en", "de", "fr", "es")], one(F.col("n_chars") < 50).alias("short"), F.countDistinct(F.sha2("text", 256)).alias("texts"))


def parse_quality(spark, d):
    r = T.valid_token_ratio(F.col("text"))
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("pages"), F.sum((T.solid_chars(F.col("text")) < 50).cast("int")).alias("empty_pages"), F.round(F.avg(r), 6).alias("quality"))


def corpus_version(spark, d):
    return table(spark, d, "documents").agg(F.sha2(F.concat_ws(":", F.count("*"), F.max("doc_id")), 256).alias("version"))


def cost_per_key(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.sum(F.col("value").cast("decimal(12,2)")).cast("double").alias("cost"))


def strict_mean(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    j = docs.filter("n_chars > 3000").join(labels, "doc_id", "left")
    return j.groupBy("source", "lang").agg(F.round(M.strict_mean(F.col("quality")), 6).alias("quality"))


def run_summary(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") != 77, F.col("value")))
    runs = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(M.strict_mean(F.col("v")), 6).alias("m"))
    return runs.groupBy("event_type").agg(*M.run_summary(F.col("m")))


def latency_percentiles(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(M.nearest_rank("value", 0.5).alias("p50"), M.nearest_rank("value", 0.95).alias("p95"), F.count("*").alias("n"))


def segmentation_metrics(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("pred"))
    err = F.coalesce("pred", F.lit(0)) - (F.col("o_orderkey") % 5 + 2)
    j = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderpriority", err.alias("e"))
    return j.groupBy("o_orderpriority").agg(F.round(F.avg((F.col("e") == 0).cast("int")), 6).alias("exact_rate"), F.round(F.avg(F.abs("e")), 6).alias("mae"))


def cohen_kappa(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return j.groupBy("lang").agg(F.round(M.kappa(F.col("quality") == 1, F.col("n_chars") > 300), 6).alias("kappa"))


def _spans(spark, d):
    """Passages are the whole texts in runs of 1000 characters; spans are places in all documents, which events point to."""
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("int").alias("n")).filter("n > 0")
    p = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(1000))).alias("ps"), "n").select("doc_id", "ps", F.least(F.col("ps") + 1000, "n").alias("pe"))
    most = docs.agg((F.max("doc_id") + 1).alias("m"))
    e = table(spark, d, "events").crossJoin(F.broadcast(most)).withColumn("doc_id", F.pmod(F.col("event_id") * 7, "m")).join(docs, "doc_id")
    sl = F.pmod(F.col("event_id") * 7919, "n").cast("int")
    return p, e.select("doc_id", sl.alias("sl"), F.least(F.col("n"), sl + F.floor(F.col("value") * 9) + 1).cast("int").alias("sr"), F.pmod(F.col("event_id"), F.lit(20)).alias("rank"))


def interval_overlap(spark, d):
    p, e = _spans(spark, d)
    j = p.join(e, "doc_id").filter("sl < pe AND sr > ps")
    return j.groupBy("doc_id", "ps").agg(F.count("*").alias("spans"), F.sum(F.least("pe", "sr") - F.greatest("ps", "sl")).alias("overlap"))


def _covered(p, e):
    j = p.join(e, "doc_id").filter("sl < pe AND sr > ps")
    return M.covered_length(j, ["doc_id", "ps", "pe"], "ps", "pe", "sl", "sr").withColumn("half", F.col("covered") * 2 >= F.col("pe") - F.col("ps"))


def interval_union_coverage(spark, d):
    return _covered(*_spans(spark, d)).select("doc_id", "ps", F.col("covered").cast("long").alias("covered"), "half")


def recall_at_k(spark, d):
    p, e = _spans(spark, d)
    both = p.join(_covered(p, e.filter("rank < 10")).select("doc_id", "ps", "half"), ["doc_id", "ps"], "left").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return both.groupBy("source").agg(F.round(F.avg(F.coalesce("half", F.lit(False)).cast("int")), 6).alias("recall"), F.count("*").alias("passages"))


def accuracy_grouping_sets(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return j.groupingSets([[], ["lang"], ["source"]], "lang", "source").agg(F.round(F.avg(good.cast("int")), 6).alias("accuracy"), F.count("*").alias("cases"))


def top_n_per_group(spark, d):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, d, "documents").withColumn("r", F.row_number().over(w)).filter("r <= 15").select("source", "r", "doc_id")


def _measures(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.concat_ws("_", "event_type", F.pmod("user_id", F.lit(4))).alias("metric")).agg(F.round(F.avg("value"), 4).alias("value"))


def gate_compare(spark, d):
    base = table(spark, d, "events").groupBy(F.concat_ws("_", "event_type", F.pmod("user_id", F.lit(5))).alias("metric")).agg(F.round(F.avg("value"), 4).alias("base"))
    cost = F.col("metric").startswith("purchase")
    out = M.gate(_measures(spark, d), base, F.when(cost, 0.05).otherwise(2.0), ~cost)
    return out.select("metric", "value", "base", "passed")


def report_rows(spark, d):
    v = F.col("value")
    shown = F.when(v.isNull(), "n/a").otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%.6f", v), "0+$", ""), r"\.$", ""))
    return _measures(spark, d).select("metric", F.concat(F.lit("| "), "metric", F.lit(" | "), shown, F.lit(" |")).alias("line"))


def rule_violations(spark, d):
    """Sources whose counts of labels of a kind miss what the rules ask for."""
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    got = j.groupBy("source").agg(F.count("quality").alias("labels"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    rules = [F.when(F.col("labels") < 20, F.concat(F.lit("labels "), F.col("labels").cast("string"), F.lit(" of 20"))), F.when(F.col("toxic") < 3, F.concat(F.lit("toxic "), F.col("toxic").cast("string"), F.lit(" of 3")))]
    return got.select("source", F.explode(F.array_compact(F.array(*rules))).alias("violation"))


_P = "d AS (SELECT doc_id, n_chars::INT AS n FROM documents WHERE n_chars > 0), p AS (SELECT doc_id, ps::INT AS ps, least(ps + 1000, n)::INT AS pe FROM (SELECT doc_id, n, unnest(range(0, n, 1000)) AS ps FROM d)), e AS (SELECT doc_id, event_id * 7919 % n AS sl, least(n, event_id * 7919 % n + floor(value * 9) + 1) AS sr, event_id % 20 AS rank FROM (SELECT *, event_id * 7 % (SELECT max(doc_id) + 1 FROM d) AS doc_id FROM events) JOIN d USING (doc_id))"
_COVER = "SELECT doc_id, ps, pe, sum(greatest(0, r - greatest(l, coalesce(c, ps))))::BIGINT AS covered FROM (SELECT *, max(r) OVER (PARTITION BY doc_id, ps ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM (SELECT doc_id, ps, pe, greatest(ps, sl) AS l, least(pe, sr) AS r FROM p JOIN e USING (doc_id) WHERE sl < pe AND sr > ps {0})) GROUP BY ALL"
_RATIO = r"""coalesce(len(list_filter(w, lambda t: (regexp_full_match(t, '[A-Za-z]+([''’-][A-Za-z]+)*') AND (length(t) = 1 OR regexp_matches(t, '[aeiouyAEIOUY]'))) OR regexp_full_match(t, '[0-9]+([.,:/-][0-9]+)*[A-Za-z]{0,2}') OR regexp_full_match(t, '[A-Z]{1,5}[0-9]+[A-Za-z0-9-]*')))::DOUBLE / nullif(len(w), 0), 0)"""
RATIO_WORDS = r"""list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda t: trim(t, '.,;:!?()[]"''$%-–/|*')), lambda t: length(t) > 0)"""
_MEAS = "SELECT event_type || '_' || (user_id % 4) AS metric, round(avg(value), 4) AS value FROM events GROUP BY 1"

QUERIES = {f.__name__: f for f in (corpus_stats_docs, corpus_stats_pivot, parse_quality, corpus_version, cost_per_key, strict_mean, run_summary, latency_percentiles, segmentation_metrics, cohen_kappa, interval_overlap, interval_union_coverage, recall_at_k, accuracy_grouping_sets, top_n_per_group, gate_compare, report_rows, rule_violations)}
ORACLES = {
    "corpus_stats_docs": "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL",
    "corpus_stats_pivot": "SELECT source, count(*) AS docs, " + ", ".join(f"count(*) FILTER (lang = '{x}') AS {x}" for x in ("en", "de", "fr", "es")) + ", count(*) FILTER (n_chars < 50) AS short, count(DISTINCT sha256(text)) AS texts FROM documents GROUP BY source",
    "parse_quality": f"SELECT lang, count(*) AS pages, count(*) FILTER (length(regexp_replace(text, '\\s', '', 'g')) < 50) AS empty_pages, round(avg({_RATIO}), 6) AS quality FROM (SELECT lang, text, {RATIO_WORDS} AS w FROM documents) GROUP BY lang",
    "corpus_version": "SELECT sha256(count(*) || ':' || max(doc_id)) AS version FROM documents",
    "cost_per_key": "SELECT user_id, sum(value::DECIMAL(12,2))::DOUBLE AS cost FROM events GROUP BY user_id",
    "strict_mean": "SELECT source, lang, CASE WHEN count(*) = count(quality) THEN round(avg(quality), 6) END AS quality FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars > 3000 GROUP BY ALL",
    "run_summary": "WITH r AS (SELECT event_type, ts::DATE AS day, CASE WHEN count(*) = count(v) THEN round(avg(v), 6) END AS m FROM (SELECT *, CASE WHEN event_id != 77 THEN value END AS v FROM events) GROUP BY ALL) SELECT event_type, count(*) AS runs, CASE WHEN count(*) = count(m) THEN min(m) END AS least, CASE WHEN count(*) = count(m) THEN quantile_cont(m, 0.5) END AS median, CASE WHEN count(*) = count(m) THEN max(m) END AS most FROM r GROUP BY event_type",
    "latency_percentiles": "SELECT event_type, (list_sort(list(value)))[ceil(0.5 * count(*))::INT] AS p50, (list_sort(list(value)))[ceil(0.95 * count(*))::INT] AS p95, count(*) AS n FROM events GROUP BY event_type",
    "segmentation_metrics": "SELECT o_orderpriority, round(avg((e = 0)::INT), 6) AS exact_rate, round(avg(abs(e)), 6) AS mae FROM (SELECT o_orderpriority, coalesce(pred, 0) - (o_orderkey % 5 + 2) AS e FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS pred FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) GROUP BY 1",
    "cohen_kappa": "WITH s AS (SELECT lang, avg(((quality = 1) = (n_chars > 300))::INT) AS o, avg((quality = 1)::INT) AS a, avg((n_chars > 300)::INT) AS b FROM labels JOIN documents USING (doc_id) GROUP BY lang) SELECT lang, round(CASE WHEN a * b + (1 - a) * (1 - b) = 1 THEN (o = 1)::INT::DOUBLE ELSE (o - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))) END, 6) AS kappa FROM s",
    "interval_overlap": f"WITH {_P} SELECT p.doc_id, ps, count(*) AS spans, sum(least(pe, sr) - greatest(ps, sl))::BIGINT AS overlap FROM p JOIN e ON p.doc_id = e.doc_id AND sl < pe AND sr > ps GROUP BY ALL",
    "interval_union_coverage": f"WITH {_P} SELECT doc_id, ps, covered, covered * 2 >= pe - ps AS half FROM ({_COVER.format('')})",
    "recall_at_k": f"WITH {_P}, c AS ({_COVER.format('AND rank < 10')}) SELECT source, round(avg((coalesce(covered, 0) * 2 >= p.pe - p.ps)::INT), 6) AS recall, count(*) AS passages FROM p LEFT JOIN c USING (doc_id, ps) JOIN documents USING (doc_id) GROUP BY source",
    "accuracy_grouping_sets": "SELECT lang, source, round(avg((quality = 1 AND toxic = 0)::INT), 6) AS accuracy, count(*) AS cases FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source))",
    "top_n_per_group": "SELECT source, r, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 15",
    "gate_compare": f"WITH m AS ({_MEAS}), b AS (SELECT event_type || '_' || (user_id % 5) AS metric, round(avg(value), 4) AS base FROM events GROUP BY 1), j AS (SELECT metric, value, base, metric LIKE 'purchase%' AS c FROM b LEFT JOIN m USING (metric)), k AS (SELECT *, CASE WHEN c THEN base * (1 + 0.05::DOUBLE) ELSE base - 2.0::DOUBLE END AS bound FROM j) SELECT metric, value, base, value IS NOT NULL AND (abs(value - bound) <= 1e-12 * greatest(abs(value), abs(bound)) OR NOT (CASE WHEN c THEN value > bound ELSE value < bound END)) AS passed FROM k",
    "report_rows": f"SELECT metric, '| ' || metric || ' | ' || regexp_replace(regexp_replace(printf('%.6f', value), '0+$', ''), '\\.$', '') || ' |' AS line FROM ({_MEAS})",
    "rule_violations": "WITH g AS (SELECT source, count(quality) AS labels, coalesce(sum(toxic), 0)::BIGINT AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source) SELECT source, 'labels ' || labels || ' of 20' AS violation FROM g WHERE labels < 20 UNION ALL SELECT source, 'toxic ' || toxic || ' of 3' FROM g WHERE toxic < 3",
}
