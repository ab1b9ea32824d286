"""Queries of the text functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from townledger.functions import text as T
from townledger.operators import facts
from townledger.plans.evaluation import _RATIO, RATIO_WORDS
from townledger.plans.retrieval import _TOK
from townledger.plans.tables import table


def _docs(spark, d):
    return table(spark, d, "documents")


def normalize_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.normalize(F.col("text"))).alias("h"))


def valid_token_ratio(spark, d):
    return _docs(spark, d).select("doc_id", F.round(T.valid_token_ratio(F.col("text")), 6).alias("ratio"))


def levenshtein(spark, d):
    b = table(spark, d, "benchmark")
    cut = lambda c: F.regexp_replace(c, "[^ -~]", "?")  # noqa: E731  DuckDB counts bytes
    return b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id").select("item_id", F.levenshtein(cut("text"), cut("other")).alias("distance"))


def needs_ocr(spark, d):
    return _docs(spark, d).select("doc_id", T.needs_ocr(F.col("text"), F.col("doc_id") % 10 / F.lit(10.0)).alias("ocr"))


def numeric_tokens(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(T.numeric_tokens(F.col("text"))).alias("number"))


def numeric_subset(spark, d):
    docs = _docs(spark, d)
    own = F.concat(F.col("doc_id").cast("string"), F.lit(".5"))  # with a fraction no id, as 12600, bears out the amount 12,600
    claim = F.concat(F.lit("There were 7 of $12,"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.lit(" and 30.0% with "), own)
    source = F.concat(F.lit("12,"), F.lpad((F.col("doc_id") % 500).cast("string"), 3, "0"), F.lit(" 30 "), own)
    return docs.select("doc_id", T.numbers_supported(claim, source).alias("supported"))


def amounts(spark, d):
    text = F.concat(F.lit("paid $"), F.format_string("%,d", "l_orderkey"), F.lit(" and $"), F.col("l_linenumber").cast("string"), F.lit(".5 million to"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.transform(T.amounts(text), lambda x: x.cast("long").cast("string")), ",").alias("amounts")).distinct()


def vote_counts(spark, d):
    """Votes read back from quotes made of customers' names."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.sum((F.col("c_acctbal") > 6000).cast("int")).alias("y"), F.sum((F.col("c_acctbal") < 500).cast("int")).alias("n"))
    names = lambda k: F.when(F.col(k) == 0, "None").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col(k))), lambda i: F.concat(F.lit("Member "), F.chr(i % 26 + 65))), ", "))
    quote = F.concat(F.lit("Ayes: "), names("y"), F.lit("\nNoes: "), names("n"), F.lit("\nAbsent: None"))
    return c.select("c_nationkey", facts.votes(quote).alias("v")).select("c_nationkey", "v.*")


def fact_check(spark, d):
    """Facts of four kinds against quotes that bear out some of them."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("p"), (F.col("o_orderkey") % 4).cast("int").alias("k"), (F.col("o_custkey") % 7).cast("int").alias("c"), (F.col("o_orderkey") % 5).cast("int").alias("m"))
    listed = F.concat(F.lit("Ayes: "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("c")), lambda i: F.concat(F.lit("Member "), F.chr(i + 65))), ", "), F.lit("\nNoes: None"))
    quote = F.element_at(F.array(listed, F.concat(F.lit("a sum of $"), F.col("c").cast("string"), F.lit(".50 million")), F.concat(F.lit("Bill  CB "), F.col("c").cast("string")), F.concat(F.lit("moved by Ann "), F.substring("p", 3, 99))), F.col("k") + 1)
    none = lambda kind: F.lit(None).cast(kind)
    member = F.array(F.struct(F.lit("Member A").alias("name"), F.when(F.col("m") == 4, "no").otherwise("aye").alias("value")))
    fact = F.struct(
        (F.col("c") + 1 + (F.col("m") == 3).cast("int")).alias("ayes"), F.lit(0).alias("noes"), none("int").alias("abstain"), F.lit(0).alias("absent"), member.alias("members"),
        ((F.col("c") + 0.5) * F.when(F.col("m") == 3, 1000.0).otherwise(1e6)).cast("double").alias("amount_usd"), F.concat(F.lit("cb "), F.when(F.col("m") == 3, "x").otherwise(F.col("c").cast("string"))).alias("identifier"),
        F.array(F.when(F.col("m") == 3, F.lit("Bo Nobody")).otherwise(F.concat(F.lit("A. "), F.substring("p", 3, 99))), none("string")).alias("names"),
    )
    source = F.concat(F.lit("It began. "), F.when(F.col("m") == 2, "").otherwise(F.regexp_replace("quote", " ", "  \n")), F.lit(" It ended."))
    rows = o.withColumn("quote", quote).select("o_orderkey", F.element_at(F.array(*map(F.lit, ("vote", "amount", "ordinance", "motion"))), F.col("k") + 1).alias("kind"), "quote", source.alias("source"), fact.alias("fact"))
    return facts.verify_facts(rows).select("o_orderkey", "error", F.coalesce("start", F.lit(-1)).alias("start"))


def ngram_overlap(spark, d, most=1_000_000):
    """Documents and benchmark items that share six words in a row; up to most of the items' n-grams are broadcast."""
    grams = lambda t, k: table(spark, d, t).select(k, F.explode(T.ngrams(F.regexp_extract_all(F.lower("text"), F.lit("[^ \t\r\n]+"), F.lit(0)), 6)).alias("g"))
    items = grams("benchmark", "item_id")
    items = F.broadcast(items) if items.limit(most + 1).count() <= most else items
    return grams("documents", "doc_id").join(items, "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


def stage_hash(spark, d):
    return _docs(spark, d).select("doc_id", T.stage_hash(F.sha2("text", 256), "parse=1,segment=3").alias("h"))


def cache_key(spark, d):
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.sha2(F.concat_ws("|", F.lit("final"), T.canonical_question(F.col("text"))), 256).alias("key"))


def llm_cost(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.ceil(F.sum(F.when(F.col("role") != "assistant", F.length("text")).otherwise(0)) / 4).alias("i"), F.ceil(F.sum(F.when(F.col("role") == "assistant", F.length("text")).otherwise(0)) / 4).alias("o"))
    return c.select("conv_id", F.bround((F.col("i") * 0.15 + F.col("o") * 0.6) / 1e6, 6).alias("cost"))


def routing_flag(spark, d):
    c = table(spark, d, "conversations")
    q = F.concat(F.col("text"), F.when(F.col("turn") % 3 == 0, " List all of them").otherwise(""))
    return c.select("conv_id", "turn", T.is_easy(q, F.col("conv_id") % 10 / F.lit(10.0)).alias("easy"))


def grade_exact(spark, d):
    o = table(spark, d, "orders")
    kind = F.element_at(F.array(F.lit("number"), F.lit("name"), F.lit("date"), F.lit("identifier")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    answer = F.concat(F.lit("It cost $1,"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lit(".00 on "), F.date_format("o_orderdate", "M/d/yyyy"), F.lit(" for Res-"), (F.col("o_orderkey") % 50).cast("string"), F.lit(" by "), F.col("o_orderpriority"))
    gold = F.when(kind == "number", F.concat(F.lit("1"), F.lpad((F.col("o_custkey") % 500).cast("string"), 3, "0"))).when(kind == "name", F.lit("Medium")).when(kind == "date", F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd")).otherwise(F.lit("RES 4"))
    return o.select("o_orderkey", T.grade_exact(kind, gold, answer).alias("right"))


def backoff(spark, d):
    return table(spark, d, "events").select("event_id", F.least(F.lit(600.0), F.lit(5.0) * F.pow(F.lit(2.0), F.col("event_id") % 12)).alias("seconds"))


def time_label(spark, d):
    return table(spark, d, "events").select("event_id", T.time_label(F.col("event_id") * 7919).alias("label"))


def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.html_text(F.col("html"))).alias("h"))


def jaccard_pairs(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    return b.join(other, "item_id").select("item_id", F.round(T.jaccard(F.col("t"), F.col("u")), 6).alias("similarity"))


_NUM = r"list_transform(regexp_extract_all({0}, '\$?\d[\d,]*(?:\.\d+)?%?'), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '[$,]', '', 'g'), '%$', ''), '\.0+$', ''))"
_SQ = r"trim(regexp_replace({0}, '[\s\x{{00A0}}]+', ' ', 'g'))"

QUERIES = {f.__name__: f for f in (normalize_text, valid_token_ratio, levenshtein, needs_ocr, numeric_tokens, numeric_subset, amounts, vote_counts, fact_check, ngram_overlap, stage_hash, cache_key, llm_cost, routing_flag, grade_exact, backoff, time_label, html_text, jaccard_pairs)}
ORACLES = {
    "normalize_text": r"SELECT doc_id, md5(array_to_string(list_transform(string_split(regexp_replace(translate(nfc_normalize(text), chr(160) || '‘’“”', ' ''''""'), '[ \t]+', ' ', 'g'), chr(10)), lambda x: rtrim(x, ' ')), chr(10))) AS h FROM documents",
    "valid_token_ratio": f"SELECT doc_id, round({_RATIO}, 6) AS ratio FROM (SELECT doc_id, {RATIO_WORDS} AS w FROM documents)",
    "levenshtein": "SELECT a.item_id, levenshtein(regexp_replace(a.text, '[^ -~]', '?', 'g'), regexp_replace(b.text, '[^ -~]', '?', 'g'))::INT AS distance FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1",
    "needs_ocr": r"SELECT doc_id, (length(regexp_replace(text, '\s', '', 'g')) < 50 AND doc_id % 10 / 10.0 >= 0.5) OR coalesce(length(regexp_replace(text, '[^\x{FFFD}\x{E000}-\x{F8FF}]', '', 'g'))::DOUBLE / nullif(length(text), 0), 0) >= 0.2 AS ocr FROM documents",
    "numeric_tokens": f"SELECT DISTINCT doc_id, unnest({_NUM.format('text')}) AS number FROM documents",
    "numeric_subset": "SELECT doc_id, (doc_id % 1000 = doc_id % 500) AS supported FROM documents",
    "amounts": "SELECT DISTINCT l_orderkey, l_linenumber, l_orderkey || ',' || (l_linenumber * 1000000 + 500000)::BIGINT AS amounts FROM lineitem",
    "vote_counts": "SELECT c_nationkey, count(*) FILTER (c_acctbal > 6000)::INT AS ayes, count(*) FILTER (c_acctbal < 500)::INT AS noes, 0 AS abstain, 0 AS absent FROM customer GROUP BY 1",
    "fact_check": "SELECT o_orderkey, CASE WHEN m = 2 THEN 'quote_not_found' WHEN m = 3 THEN ['vote_count_mismatch', 'amount_not_in_quote', 'identifier_not_in_quote', 'name_not_in_quote'][k + 1] WHEN m = 4 AND k = 0 THEN 'vote_members_mismatch' END AS error, CASE WHEN m != 2 THEN 10 ELSE -1 END::INT AS start FROM (SELECT o_orderkey, o_orderkey % 4 AS k, o_orderkey % 5 AS m FROM orders)",
    "ngram_overlap": r"""WITH g AS (SELECT doc_id, regexp_extract_all(lower(text), '[^ \t\r\n]+') AS w FROM documents), h AS (SELECT item_id, regexp_extract_all(lower(text), '[^ \t\r\n]+') AS w FROM benchmark),
        a AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 4)), lambda i: array_to_string(w[i:i + 5], ' '))) AS s FROM g), b AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(1, len(w) - 4)), lambda i: array_to_string(w[i:i + 5], ' '))) AS s FROM h)
        SELECT doc_id, item_id, count(*) AS shared FROM a JOIN b USING (s) GROUP BY ALL""",
    "stage_hash": "SELECT doc_id, sha256(sha256(text) || '|parse=1,segment=3') AS h FROM documents",
    "cache_key": f"SELECT conv_id, turn, sha256('final|' || regexp_replace({_SQ.format('lower(text)')}, '[?.!]+$', '')) AS key FROM conversations WHERE role = 'user'",
    "llm_cost": "SELECT conv_id, round((ceil(sum(CASE WHEN role != 'assistant' THEN length(text) ELSE 0 END) / 4) * 0.15::DOUBLE + ceil(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) / 4) * 0.6::DOUBLE) / 1e6::DOUBLE, 6) AS cost FROM conversations GROUP BY conv_id",
    "routing_flag": r"SELECT conv_id, turn, conv_id % 10 / 10.0 >= 0.8 AND NOT regexp_matches(text || CASE WHEN turn % 3 = 0 THEN ' List all of them' ELSE '' END, '(?i)\b(compare|comparison|since|between|trend|over time|how many times|how often|each|every|all|total|list)\b') AS easy FROM conversations",
    "grade_exact": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey % 1000 = o_custkey % 500 OR 1000 + o_custkey % 500 = o_orderkey % 50 WHEN 1 THEN strpos(lower(o_orderpriority), 'medium') > 0 WHEN 2 THEN day(o_orderdate) = 1 ELSE o_orderkey % 50 = 4 OR o_orderkey % 50 // 10 = 4 END AS \"right\" FROM orders",
    "backoff": "SELECT event_id, least(600.0, 5.0 * pow(2, event_id % 12))::DOUBLE AS seconds FROM events",
    "time_label": "SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS label FROM (SELECT event_id, event_id * 7919 // 1000 AS s FROM events)",
    "html_text": "SELECT page_id, md5(" + _SQ.format("regexp_replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;?', '&', 'g')") + ") AS h FROM pages",
    "jaccard_pairs": f"WITH t AS (SELECT item_id, list_distinct({_TOK.format('text')}) AS t FROM benchmark) SELECT a.item_id, round(coalesce(len(list_intersect(a.t, b.t))::DOUBLE / nullif(len(list_distinct(list_concat(a.t, b.t))), 0), 0), 6) AS similarity FROM t a JOIN t b ON b.item_id = a.item_id + 1",
}
