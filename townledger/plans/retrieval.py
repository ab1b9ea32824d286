"""Queries of ranked search over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from townledger.functions import stems as P
from townledger.functions import text as T
from townledger.operators import search as S
from townledger.operators import vectors as V
from townledger.plans.tables import table

QUESTION = "the thread of reation and hely ndster"
STEMMED = "how the erating of onherly things and ndster"
NEAR = "what erators did by thonly thtioning"
_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")"
_TOK = f"list_filter(regexp_extract_all(lower({{0}}), '[a-z0-9]+'), lambda t: length(t) >= 2 AND t NOT IN {_STOP})"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_TERMS = "['thread', 'reation', 'hely', 'ndster']"
_Q = f"(SELECT {_TERMS} AS terms)"


def tokenize(spark, d):
    """Sorted tokens show which one is the first of its kind in a row, so one aggregate by term counts both, where no id stands twice."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    if docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        return docs.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))
    first = lambda w: F.transform(w, lambda t, i: F.struct(t.alias("term"), ((i == 0) | (F.get(w, i - 1) != t)).alias("first")))
    terms = docs.select("doc_id", F.inline(F.flatten(F.transform(F.array(F.sort_array(T.tokens(F.col("text")))), first))))
    return terms.groupBy("term").agg(F.count("*").alias("n"), F.count_if(F.col("first") & F.col("doc_id").isNotNull()).alias("docs"))


def keyword_search(spark, d):
    return S.keyword_search(table(spark, d, "documents"), QUESTION, k=50).select("doc_id", F.round("score", 6).alias("score"))


def keyword_search_many(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return S.keyword_search_many(table(spark, d, "documents"), q, k=5)


def keyword_search_stems(spark, d):
    return S.stem_search(table(spark, d, "documents"), STEMMED, k=50).select("doc_id", F.round("score", 6).alias("score"))


def keyword_search_near(spark, d):
    return S.stem_search(table(spark, d, "documents"), NEAR, k=50, near=True).select("doc_id", F.round("score", 6).alias("score"))


def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 0").select(F.lit(0).alias("query_id"), "embedding")
    return S.vector_search_many(e, q, k=10).select("vec_id", F.round("score", 4).alias("score"), "rank")


def vector_topk_many(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return S.vector_search_many(e, q, k=10).select("query_id", "vec_id", F.round("score", 4).alias("score"))


def rrf_fusion(spark, d):
    docs = table(spark, d, "documents")
    hits = S.keyword_search(docs, QUESTION, k=50)
    short = docs.join(hits, "doc_id").select("doc_id", "n_chars")
    lists = [S.ranked(hits, F.desc("score"), "doc_id"), S.ranked(short, "n_chars", "doc_id")]
    return S.fuse(lists, "doc_id").select("doc_id", F.round("score", 8).alias("score"))


def rerank_overlap(spark, d):
    scored = table(spark, d, "documents").select("doc_id", S.overlap_score(QUESTION, F.col("text")).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(50).select("doc_id", F.round("score", 6).alias("score"))


def dedup_best_per_group(spark, d):
    scored = table(spark, d, "documents").select("doc_id", F.nullif("source", F.lit("src0")).alias("grp"), S.overlap_score(QUESTION, F.col("text")).alias("score"))
    return S.best_per_group(scored, "grp", F.desc("score"), "doc_id").select("doc_id", "grp", F.round("score", 6).alias("score"))


def span_budget(spark, d):
    docs = table(spark, d, "documents")
    return S.within_budget(docs.select("source", "doc_id", "n_chars"), "source", F.col("n_chars"), 9000, "doc_id").select("source", "doc_id", "used")


def hashed_bow(spark, d):
    return S.hashed_bag(table(spark, d, "documents"), "doc_id", "text").groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


def label_recall(spark, d):
    """Recall at 10 of a search by the label's vectors alone against the exact one."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("ql"))
    exact = S.vector_search_many(e, q, k=10).select("query_id", "vec_id")
    near = S.vector_search_many(e.select("vec_id", "embedding", "label"), q, k=10, within=("label", "ql"))
    return V.recall(near, exact).select("query_id", F.round("recall", 4).alias("recall"))


def ann_recall(spark, d):
    """Recall at 10 of the inverted file against the exact search, for every query."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return V.recall(V.indexed_search(e, q), S.vector_search_many(e, q, k=10)).select("query_id", F.round("recall", 4).alias("recall"))


def hybrid_search(spark, d):
    return S.hybrid_search(table(spark, d, "documents"), QUESTION, group="source", k=10).select("doc_id", "rank", F.round("score", 6).alias("score"))


def bag_search(spark, d):
    return S.bag_search(table(spark, d, "documents"), QUESTION, k=50).select("doc_id", F.round("score", 6).alias("score"))


def optional_filters(spark, d, source="src3", lang=None, least=500, most=None):
    docs = table(spark, d, "documents")
    kept = S.where_all(docs, F.col("source") == source if source else None, F.col("lang") == lang if lang else None, F.col("n_chars") >= least if least else None, F.col("n_chars") <= most if most else None)
    return kept.select("doc_id", "lang", "n_chars")


def text_search(spark, d):
    docs = table(spark, d, "documents").withColumn("pos", F.locate("licensed under", F.lower("text")))
    return docs.filter("pos > 0").select("doc_id", "pos", T.snippet(F.col("text"), F.col("pos"), F.lit(14)).alias("snippet"))


_HITS = f"list_filter({_TOK.format('text')}, lambda t: list_contains({_TERMS}, t))"
_OVER = f"coalesce(len(list_intersect({_TERMS}, {_TOK.format('text')}))::DOUBLE / nullif(len({_TERMS}), 0), 0)"
_KW = f"SELECT doc_id, 0.1::DOUBLE * len({_HITS}) / (1 + 0.1::DOUBLE * len({_HITS})) AS score FROM documents WHERE len({_HITS}) > 0 ORDER BY score DESC, doc_id LIMIT 50"
_BUCKET = "(('0x' || substr(sha256(t), 1, 8))::BIGINT % 768)"
_BAGS = f"SELECT doc_id, {_BUCKET} AS bucket, count(*) AS n FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS t FROM documents) GROUP BY ALL"
_ASKED = f"SELECT {_BUCKET} AS bucket, count(*) AS q FROM (SELECT unnest(terms) AS t FROM {_Q}) GROUP BY ALL"
_BAG = f"SELECT doc_id, dot / norm / (SELECT sqrt(sum(q * q)) FROM ({_ASKED})) AS score FROM (SELECT doc_id, sum(n * q) AS dot FROM ({_BAGS}) JOIN ({_ASKED}) USING (bucket) GROUP BY doc_id) JOIN (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM ({_BAGS}) GROUP BY doc_id) USING (doc_id) ORDER BY score DESC, doc_id LIMIT 50"
_COS = f"({_DOT.format('e.embedding', 'q.embedding')}) / (sqrt({_DOT.format('e.embedding', 'e.embedding')}) * sqrt({_DOT.format('q.embedding', 'q.embedding')}))"
_NEAR = f"SELECT q.vec_id AS query_id, e.vec_id, q.label AS ql, e.label, {_COS} AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q"

def _sql_stems(words: str) -> str:
    """CTEs that end in stemmed(word, stem): the suffix rules once more, in SQL, for the words of a query."""
    longest = lambda suffixes: "|".join(sorted(suffixes, key=lambda x: (-len(x), x)))
    quoted = lambda values: ", ".join(f"'{v}'" for v in values)
    less = lambda n: f"left(w, (length(w) - {n})::BIGINT)"
    swapped = lambda rules: "CASE m " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.items()) + " END"
    keep = "word, stop, r1, r2"
    step = lambda name, before, suffixes: f"{name} AS (SELECT {keep}, w, regexp_extract(w, '({longest(suffixes)})$', 1) AS m FROM {before})"
    into = lambda name, before, rules, region, extra: f"{name} AS (SELECT {keep}, CASE WHEN NOT stop AND m != '' AND length(w) - length(m) >= {region} AND {extra} THEN {less('length(m)')} || {swapped(rules)} ELSE w END AS w FROM {before})"
    irregular = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in P.IRREGULAR.items())
    return f"""w0 AS (SELECT DISTINCT word FROM ({words})),
        w1 AS (SELECT word, length(word) < 3 OR word IN ({quoted([*P.IRREGULAR, *P.KEPT])}) AS stop, CASE word {irregular} ELSE regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') END AS w FROM w0),
        w2 AS (SELECT *, coalesce(nullif(length(regexp_extract(w, '^(?:{P.BEGINNINGS})|{P.REGION}')), 0), length(w)) AS r1 FROM w1),
        w3 AS (SELECT *, coalesce(nullif(length(regexp_extract(substr(w, r1 + 1), '{P.REGION}')), 0) + r1, length(w)) AS r2 FROM w2),
        {step('a1', 'w3', ('sses', 'ied', 'ies', 'us', 'ss', 's'))},
        a2 AS (SELECT {keep}, CASE WHEN stop THEN w WHEN m = 'sses' OR m IN ('ied', 'ies') AND length(w) > 4 THEN {less(2)} WHEN m IN ('ied', 'ies') OR m = 's' AND regexp_matches(w, '[aeiouy].+s$') THEN {less(1)} ELSE w END AS w FROM a1),
        a3 AS (SELECT word, stop OR w IN ({quoted(P.KEPT_WITHOUT_S)}) AS stop, r1, r2, w FROM a2),
        {step('b1', 'a3', ('eed', 'eedly', 'ed', 'edly', 'ing', 'ingly'))},
        b2 AS (SELECT *, {less('length(m)')} AS b FROM b1),
        b3 AS (SELECT {keep}, CASE WHEN stop OR m = '' THEN w WHEN m IN ('eed', 'eedly') THEN CASE WHEN length(b) >= r1 THEN b || 'ee' ELSE w END WHEN NOT regexp_matches(b, '[aeiouy]') THEN w
            WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e' WHEN regexp_matches(b, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(b, length(b) - 1) WHEN r1 >= length(b) AND regexp_matches(b, '{P.SHORT}') THEN b || 'e' ELSE b END AS w FROM b2),
        c1 AS (SELECT {keep}, CASE WHEN NOT stop AND regexp_matches(w, '^.+[^aeiouy][yY]$') THEN {less(1)} || 'i' ELSE w END AS w FROM b3),
        {step('d1', 'c1', P.STEP_2)}, {into('d2', 'd1', P.STEP_2, 'r1', "(m != 'ogi' OR w LIKE '%logi') AND (m != 'li' OR regexp_matches(w, '[cdeghkmnrt]li$'))")},
        {step('e1', 'd2', P.STEP_3)}, {into('e2', 'e1', P.STEP_3, 'r1', "(m != 'ative' OR length(w) - 5 >= r2)")},
        {step('f1', 'e2', P.STEP_4)}, {into('f2', 'f1', dict.fromkeys(P.STEP_4, ''), 'r2', "(m != 'ion' OR regexp_matches(w, '[st]ion$'))")},
        stemmed AS (SELECT word, lower(CASE WHEN NOT stop AND (length(w) - 1 >= r2 AND regexp_matches(w, '(e|ll)$') OR length(w) - 1 >= r1 AND w LIKE '%e' AND NOT regexp_matches({less(1)}, '{P.SHORT}')) THEN {less(1)} ELSE w END) AS stem FROM f2)"""


def _sql_places(query: str) -> str:
    """CTEs that end in places(doc_id, pos, term): where each stem of a query stands in each document."""
    return f"""every AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents)),
        terms AS (SELECT unnest({T.search_terms(query)}) AS word), {_sql_stems('SELECT word FROM every UNION SELECT word FROM terms')},
        asked AS (SELECT DISTINCT stem FROM terms JOIN stemmed USING (word)),
        places AS (SELECT doc_id, pos, stem AS term FROM every JOIN stemmed USING (word) JOIN asked USING (stem) WHERE length(word) >= 2 AND word NOT IN {_STOP})"""


QUERIES = {f.__name__: f for f in (tokenize, keyword_search, keyword_search_stems, keyword_search_near, keyword_search_many, vector_topk, vector_topk_many, rrf_fusion, rerank_overlap, dedup_best_per_group, span_budget, hashed_bow, label_recall, ann_recall, hybrid_search, bag_search, optional_filters, text_search)}
ORACLES = {
    "tokenize": f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY term",
    "keyword_search": f"SELECT doc_id, round(score, 6) AS score FROM ({_KW})",
    "keyword_search_stems": f"""WITH {_sql_places(STEMMED)}
        SELECT doc_id, round(s / (1 + s), 6) AS score FROM (SELECT doc_id, 0.1::DOUBLE * count(*) AS s FROM places GROUP BY doc_id) ORDER BY s DESC, doc_id LIMIT 50""",
    # A cover ends at a place where the earliest of the terms' last places has moved on.
    "keyword_search_near": f"""WITH {_sql_places(NEAR)},
        l AS (SELECT p.doc_id, p.pos, a.stem, max(CASE WHEN p.term = a.stem THEN p.pos END) OVER (PARTITION BY p.doc_id, a.stem ORDER BY p.pos) AS last, row_number() OVER (PARTITION BY p.doc_id, a.stem ORDER BY p.pos) AS n FROM places p, asked a),
        m AS (SELECT doc_id, pos, n, CASE WHEN count(last) = count(*) THEN min(last) END AS low FROM l GROUP BY ALL),
        c AS (SELECT m.doc_id, m.pos - m.low - (m.n - f.n) AS noise FROM (SELECT *, lag(low) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM m) m JOIN (SELECT DISTINCT doc_id, pos, n FROM m) f ON f.doc_id = m.doc_id AND f.pos = m.low WHERE m.before IS NULL OR m.low > m.before)
        SELECT doc_id, round(s / (1 + s), 6) AS score FROM (SELECT doc_id, sum(0.1::DOUBLE / (1 + noise)) AS s FROM c GROUP BY doc_id) ORDER BY s DESC, doc_id LIMIT 50""",
    "keyword_search_many": f"""WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOK.format('text')}) AS term FROM benchmark),
        p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY ALL),
        h AS (SELECT query_id, doc_id, sum(tf)::BIGINT AS hits FROM q JOIN p USING (term) GROUP BY ALL)
        SELECT query_id, doc_id, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id) AS rank FROM h) WHERE rank <= 5""",
    "vector_topk": f"SELECT vec_id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT e.vec_id, {_COS} AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q)) WHERE rank <= 10",
    "vector_topk_many": f"SELECT query_id, vec_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM ({_NEAR})) WHERE r <= 10",
    "rrf_fusion": f"""WITH h AS ({_KW}), r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS a, row_number() OVER (ORDER BY n_chars, doc_id) AS b FROM h JOIN documents USING (doc_id))
        SELECT doc_id, round(1.0::DOUBLE / (60 + a) + 1.0::DOUBLE / (60 + b), 8) AS score FROM r""",
    "rerank_overlap": f"SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, {_OVER} AS score FROM documents ORDER BY score DESC, doc_id LIMIT 50)",
    "dedup_best_per_group": f"""WITH s AS (SELECT doc_id, nullif(source, 'src0') AS grp, {_OVER} AS score FROM documents)
        SELECT doc_id, grp, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, doc_id) AS n FROM s) WHERE n = 1 OR grp IS NULL""",
    "span_budget": "SELECT source, doc_id, used FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS used FROM documents) WHERE used <= 9000",
    "hashed_bow": f"SELECT bucket, sum(n)::BIGINT AS n, count(*) AS docs FROM ({_BAGS}) GROUP BY bucket",
    "label_recall": f"""WITH s AS ({_NEAR}), x AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10),
        a AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s WHERE label = ql) WHERE r <= 10)
        SELECT x.query_id, round(count(a.vec_id) / 10.0::DOUBLE, 4) AS recall FROM x LEFT JOIN a ON x.query_id = a.query_id AND x.vec_id = a.vec_id GROUP BY x.query_id""",
    "bag_search": f"SELECT doc_id, round(score, 6) AS score FROM ({_BAG})",
    "hybrid_search": f"""WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({_KW})), b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({_BAG})),
        f AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM (SELECT * FROM k UNION ALL SELECT * FROM b) GROUP BY doc_id ORDER BY s DESC, doc_id LIMIT 50),
        r AS (SELECT doc_id, source, {_OVER} AS score FROM documents WHERE doc_id IN (SELECT doc_id FROM f)),
        g AS (SELECT doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS n FROM r) WHERE n = 1)
        SELECT doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM g) WHERE rank <= 10""",
    "optional_filters": "SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src3' AND n_chars >= 500",
    "text_search": "SELECT doc_id, pos::INT AS pos, substr(text, greatest(1, pos - 80), pos + 14 + 80 - greatest(1, pos - 80)) AS snippet FROM (SELECT doc_id, text, strpos(lower(text), 'licensed under') AS pos FROM documents) WHERE pos > 0",
}
