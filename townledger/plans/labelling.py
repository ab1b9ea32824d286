"""Queries of label rules, nested metrics and answers over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from townledger.operators import labels as L
from townledger.plans.tables import table

#: (rule, low, high, part, whole) that the test labels are asked for.
BOUNDS = (
    ("Q-1", 60, 60, None, True), ("C-1", 20, 20, None, True), ("X-1", 220, 220, None, True), ("A-1", 20, 20, None, True), ("Q-2", 2, 2, None, False), ("C-1", 2, 2, None, False), ("X-1", 2, 2, None, False), ("A-1", 2, 2, None, False),
    ("Q-3", 1, 1, "answerable", False), ("Q-3", 1, 1, "unanswerable", False), *(("Q-4", 1, 1, x, False) for x in ("en", "de", "fr", "es")), ("Q-5", 2, None, None, False), ("Q-6", None, 1, None, False),
    *(("Q-7", 1, None, x, False) for x in ("k0", "k1", "k2")), *(("Q-8", 1, None, x, False) for x in ("r0", "r1")), *(("X-2", 1, 1, x, False) for x in ("m0", "m1", "m2", "m3")),
)
CITIES = ("src1", "src2", "nowhere")


def label_rules(spark, d):
    """Labelled documents as questions, counts, extractions and tasks of their sources, held against rules."""
    r = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    i = F.col("doc_id").cast("long")
    kind = F.element_at(F.array(*map(F.lit, L.TOTAL)), (i % 4 + 1).cast("int"))
    part = lambda p, n: F.concat(F.lit(p), (F.floor(i / 4) % n).cast("string"))
    place = lambda k: F.struct((k % 7).cast("string").alias("id"), F.concat(F.lit("k"), (k % 3).cast("string")).alias("kind"))
    made = r.select(
        kind.alias("type"), F.col("source").alias("city"), F.when(kind == "question", F.col("quality") == 1).alias("answerable"), F.col("lang").alias("question_type"),
        part("r", 2).alias("reason"), part("m", 4).alias("kind"), F.array(place(i), place(i + 7), place(i + 1)).alias("documents"),
    )
    return L.label_violations(made, [L.Bound(*b) for b in BOUNDS], CITIES).fillna(-1, ["low", "high"])


def metric_paths(spark, d):
    """Numbers of nested results by their dotted paths."""
    e = table(spark, d, "events").withColumn("body", F.concat(F.lit('{"cost":{"mean":'), F.col("user_id").cast("string"), F.lit(',"kind":"x"},"n":'), F.when(F.col("event_id") % 3 == 0, "null").otherwise(F.col("event_id").cast("string")), F.lit("}")))
    return e.select("event_id", *(L.metric_at(F.col("body"), p).alias(a) for a, p in (("mean", "cost.mean"), ("kind", "cost.kind"), ("n", "n"), ("gone", "cost.least.x"))))


def answers_finalized(spark, d):
    """The turns of each conversation as sentences of an answer, of which two of five lack support."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.substring("text", 1, 20).alias("text"), ((F.col("turn") * 3 + F.col("conv_id")) % 5).alias("a"), (F.col("turn") % 4).alias("b"))
    one = F.struct("turn", "text", F.array(F.col("a").cast("int"), F.col("b").cast("int")).alias("cites"), ((F.col("conv_id") * 7 + F.col("turn") * F.col("turn")) % 5 < 3).alias("supported"))
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("s")).select("conv_id", L.finalize(F.col("s")).alias("f")).select("conv_id", "f.text", F.concat_ws(",", F.transform("f.cites", lambda x: x.cast("string"))).alias("cites"), "f.reason")


_LIST = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
_BOUNDS = ", ".join("(" + ", ".join(map(_LIST, b)) + ")" for b in BOUNDS)

QUERIES = {f.__name__: f for f in (label_rules, metric_paths, answers_finalized)}
ORACLES = {
    "label_rules": f"""WITH l AS (SELECT (['Q', 'C', 'X', 'A'])[doc_id % 4 + 1] AS t, source AS city, quality = 1 AS ok, lang, 'r' || (doc_id // 4 % 2) AS reason, 'm' || (doc_id // 4 % 4) AS kind, doc_id AS i FROM labels JOIN documents USING (doc_id)),
        b AS (SELECT * FROM (VALUES {_BOUNDS}) v(rule, low, high, part, whole)),
        e AS (SELECT t || '-1' AS rule, NULL AS city, NULL AS part, i FROM l UNION ALL SELECT CASE t WHEN 'Q' THEN 'Q-2' ELSE t || '-1' END, city, NULL, i FROM l
            UNION ALL SELECT 'Q-3', city, CASE WHEN ok THEN 'answerable' ELSE 'unanswerable' END, i FROM l WHERE t = 'Q' UNION ALL SELECT 'Q-4', city, lang, i FROM l WHERE t = 'Q' AND ok
            UNION ALL SELECT DISTINCT 'Q-6', city, (k % 7)::VARCHAR, i FROM (SELECT *, unnest([i, i + 7, i + 1]) AS k FROM l) WHERE t = 'Q' AND ok UNION ALL SELECT DISTINCT 'Q-7', city, 'k' || k % 3, i FROM (SELECT *, unnest([i, i + 7, i + 1]) AS k FROM l) WHERE t = 'Q' AND ok
            UNION ALL SELECT 'Q-8', city, reason, i FROM l WHERE t = 'Q' AND NOT ok UNION ALL SELECT 'X-2', city, kind, i FROM l WHERE t = 'X'),
        g AS (SELECT rule, city, part, count(*) AS n FROM e GROUP BY ALL), h AS (SELECT * FROM g UNION ALL SELECT 'Q-5', city, NULL, count(*) FROM g WHERE rule = 'Q-6' GROUP BY city),
        c AS (SELECT t, city FROM l UNION SELECT t, city FROM (SELECT unnest(['Q', 'C', 'X', 'A']) AS t), (SELECT unnest({list(CITIES)}) AS city)),
        x AS (SELECT rule, city, part, low, high FROM b JOIN c ON left(rule, 1) = t WHERE NOT whole AND rule != 'Q-6' UNION ALL SELECT rule, NULL, part, low, high FROM b WHERE whole UNION ALL SELECT g.rule, g.city, g.part, low, high FROM g JOIN b ON g.rule = b.rule WHERE g.rule = 'Q-6')
        SELECT x.rule, x.city, x.part, coalesce(n, 0) AS n, coalesce(low, -1)::BIGINT AS low, coalesce(high, -1)::BIGINT AS high FROM x LEFT JOIN h ON x.rule = h.rule AND x.city IS NOT DISTINCT FROM h.city AND x.part IS NOT DISTINCT FROM h.part WHERE coalesce(n, 0) < low OR coalesce(n, 0) > high""",
    "metric_paths": "SELECT event_id, user_id::DOUBLE AS mean, NULL::DOUBLE AS kind, CASE WHEN event_id % 3 != 0 THEN event_id::DOUBLE END AS n, NULL::DOUBLE AS gone FROM events",
    "answers_finalized": """WITH s AS (SELECT conv_id, turn, substr(text, 1, 20) AS text, [(turn * 3 + conv_id) % 5, turn % 4] AS cites, (conv_id * 7 + turn * turn) % 5 < 3 AS ok FROM conversations),
        u AS (SELECT conv_id, c, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn * 2 + j)) AS n FROM (SELECT conv_id, turn, unnest(cites) AS c, unnest([0, 1]) AS j FROM s WHERE ok) GROUP BY conv_id, c),
        m AS (SELECT conv_id, turn, string_agg('[' || n || ']', '' ORDER BY j) AS marks FROM (SELECT conv_id, turn, c, min(j) AS j FROM (SELECT conv_id, turn, unnest(cites) AS c, unnest([0, 1]) AS j FROM s WHERE ok) GROUP BY ALL) JOIN u USING (conv_id, c) GROUP BY ALL),
        a AS (SELECT s.conv_id, count(*) AS all_n, count(*) FILTER (ok) AS kept, string_agg(trim(text) || ' ' || marks, ' ' ORDER BY s.turn) FILTER (ok) AS text FROM s LEFT JOIN m ON s.conv_id = m.conv_id AND s.turn = m.turn GROUP BY s.conv_id),
        k AS (SELECT conv_id, string_agg(c::VARCHAR, ',' ORDER BY n) AS cites FROM u GROUP BY conv_id)
        SELECT conv_id, CASE WHEN NOT bad THEN text END AS text, CASE WHEN bad THEN '' ELSE cites END AS cites, CASE WHEN bad THEN 'unsupported' END AS reason FROM (SELECT *, kept = 0 OR (all_n - kept) * 2 > all_n AS bad FROM a) LEFT JOIN k USING (conv_id)""",
}
