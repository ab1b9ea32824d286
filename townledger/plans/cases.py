"""Queries of extraction cases, facts by rules and the spans of hits over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from townledger.operators import hits as H
from townledger.operators import facts, matching, rules
from townledger.operators import structure as X
from townledger.plans.structural import ORACLES as STRUCTURE
from townledger.plans.tables import sql, table
from townledger.sources import feed

# Order lines as gold cases of three kinds in two units of an order.
_CASES = """
SELECT l_orderkey AS document_id, l_linenumber % 2 AS unit, l_suppkey % 60 + 20 AS "start", l_suppkey % 60 + 35 AS "end", l_returnflag AS city,
  CASE l_linenumber % 3 WHEN 0 THEN 'amount' WHEN 1 THEN 'vote' ELSE 'motion' END AS kind, l_partkey, l_suppkey, l_quantity, l_extendedprice
FROM {lineitem}"""


def _found(spark, d, *keys):
    """What five samples predict of each order line: moved, changed and partly rejected. Lines move by keys, if any, before the samples are made."""
    lines = sql(spark, d, _CASES.replace('"', "`"), "lineitem")
    c = (lines.repartition(*keys) if keys else lines).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(4))))
    n, start = F.col("l_partkey") + F.col("sample"), F.col("start") + (F.col("l_partkey") * 7 + F.col("sample") * 11) % 40 - 20
    name = F.concat(F.lit("A. S"), F.col("l_suppkey").cast("string"), F.when(n % 6 == 0, "x").otherwise(""))
    record = _record(name, F.col("l_quantity").cast("int") + (n % 5 == 0).cast("int"), F.col("l_extendedprice") + F.when(n % 4 == 0, 0.01).otherwise(0.004))
    error = F.when((F.col("l_suppkey") + F.col("sample")) % 9 == 0, "quote_not_found")
    return c.select("sample", "document_id", "kind", "unit", start.alias("start"), (start + 15).alias("end"), record.alias("record"), error.alias("error"), "city")


def _record(mover, ayes, amount):
    text, none = F.lit(None).cast("string"), F.lit(0)
    members = F.lit(None).cast("array<struct<name:string,value:string>>")
    return F.struct(mover.alias("mover"), text.alias("seconder"), ayes.alias("ayes"), none.alias("noes"), none.alias("abstain"), none.alias("absent"), members.alias("members"), text.alias("identifier"), text.alias("outcome"), amount.alias("amount_usd"), text.alias("speaker"))


def extraction_accuracy(spark, d):
    gold = _record(F.concat(F.lit("Ann  s"), F.col("l_suppkey").cast("string")), F.col("l_quantity").cast("int"), F.col("l_extendedprice"))
    cases = sql(spark, d, _CASES.replace('"', "`"), "lineitem").withColumn("gold", gold)
    out = matching.extraction_accuracy(cases, _found(spark, d, *matching.KEYS))
    return out.select("level", "name", "cases", "runs", *(F.round(c, 6).alias(c) for c in ("least", "median", "most")))


def reject_rate(spark, d):
    return matching.reject_rate(_found(spark, d), "city").withColumn("rate", F.round("rate", 6))


# Orders as texts of items: motions, lists and table rows of votes, amounts and legislation.
_ITEMS = """
SELECT o_orderkey, 'Item ' || o_custkey AS identifier, o_orderpriority AS title, concat_ws(chr(10), 'ORDER ' || o_orderkey,
  CASE WHEN o_custkey % 3 = 0 THEN 'Councilmember C' || o_custkey || ' motioned to approve, motion was seconded by  Commissioner D' || o_orderkey % 7 END,
  CASE WHEN o_custkey % 4 = 0 THEN 'In Favor: A' || o_custkey || ', B Opposed: None' END, v,
  CASE WHEN o_custkey % 5 = 0 THEN 'Pay $' || {money} || ' and $5' END,
  CASE WHEN o_custkey % 2 = 0 THEN 'CB 1' || o_custkey || ' amends CB ' || o_custkey % 9 || ', ORDINANCE 77A' END,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Passed by all' END) AS text
FROM {orders} LEFT JOIN ({rows}) ON o_orderkey = l_orderkey"""
_ROW = "'S' || l_suppkey || ' | ' || CASE l_linenumber % 3 WHEN 0 THEN 'Aye' WHEN 1 THEN 'No' ELSE 'Absent ' END"


def rule_facts(spark, d):
    rows = f"SELECT l_orderkey, array_join(transform(array_sort(collect_list(struct(l_linenumber, {_ROW} AS v))), x -> x.v), chr(10)) AS v FROM {{lineitem}} GROUP BY l_orderkey"
    items = sql(spark, d, _ITEMS.replace("{rows}", rows).replace("{money}", "format_number(o_totalprice, 2)"), "orders", "lineitem")
    out = rules.rule_facts(items, "o_orderkey")
    names = F.array_join(F.array_sort(F.transform("members", lambda m: F.concat_ws("=", m["name"], m["value"]))), ",")
    return out.select("o_orderkey", "kind", "start", "end", F.md5("quote").alias("quote"), "identifier", "legislation_type", "title", "amount_usd", "mover", "seconder", "outcome", *(F.col(c).cast("double").alias(c) for c in facts.VOTES), names.alias("members"))


def linked_spans(spark, d):
    """The spans of the best window of every document and of the document that it is linked to."""
    docs = table(spark, d, "documents")
    windows = X.fixed_windows(docs, "doc_id", "text", keep=["source"]).withColumn("chunk_id", F.col("doc_id") * 1_000_000 + F.col("window"))
    chunks = windows.select("chunk_id", F.col("doc_id").alias("item_id"), F.col("window").alias("ordinal"), (F.col("end") - F.col("start")).alias("size"))
    linked = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") + 1).when(F.col("doc_id") % 3 == 0, F.col("doc_id") - 1)
    items = docs.select(F.col("doc_id").alias("item_id"), linked.alias("linked_item_id"))
    found = windows.select("chunk_id", F.coalesce("source", F.lit("")).alias("query_id"), ((F.col("window") * 7 + F.col("doc_id")) % 5).alias("rank"))
    hits = H.best_of_items(H.hydrate(found, chunks, items))
    out = H.item_spans(hits, chunks)
    return out.select("query_id", "hit", "position", "chunk_id", F.col("size").cast("long").alias("size"))


# Orders as events of a feed, some seen again on a later page, and customers as pages of recordings.
_EVENTS = """
SELECT o_orderkey AS id, 'Board ' || o_custkey % 7 AS body, CASE WHEN o_custkey % 4 IN (1, 3) THEN 'http://v/' || o_custkey WHEN o_custkey % 4 = 2 THEN 'rtsp://v' END AS media,
  CASE WHEN o_orderkey % 3 > 0 THEN 'a' || o_orderkey || '-' || again || '.pdf' END AS agenda, CASE WHEN o_orderkey % 5 > 2 THEN 'm' || o_orderkey || '.pdf' END AS minutes, again, o_orderdate AS day
FROM {orders} CROSS JOIN (SELECT 0 AS again UNION ALL SELECT 1 AS again) WHERE again = 0 OR o_orderkey % 10 = 0"""
_TRACKS = """
SELECT 'http://v/' || c_custkey AS url, '<script>tracks: [{{ file: "documents/seattlechannel/closedcaption/' || CASE WHEN c_custkey % 5 = 0 THEN 'old' ELSE '2024' END || '/c' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '.SRT' ELSE '.vtt' END || '"}}]' AS html
FROM {customer} WHERE c_custkey % 11 > 0"""


def _feed(spark, d):
    e = sql(spark, d, _EVENTS, "orders")
    event = F.to_json(F.struct(F.col("id").alias("EventId"), F.col("body").alias("EventBodyName"), F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss").alias("EventDate"), F.col("media").alias("EventMedia"), F.col("agenda").alias("EventAgendaFile"), F.col("minutes").alias("EventMinutesFile")))
    return feed.meetings(e.select(F.concat(F.lit("p"), F.col("again").cast("string")).alias("page"), F.lit(0).alias("position"), event.alias("event")), "c1")


def feed_meetings(spark, d):
    return _feed(spark, d).select("id", "title", "recording_url", F.col("meeting_date").cast("string").alias("meeting_date"))


def feed_documents(spark, d):
    return feed.documents(_feed(spark, d), sql(spark, d, _TRACKS, "customer"))


QUERIES = {f.__name__: f for f in (extraction_accuracy, reject_rate, rule_facts, linked_spans, feed_meetings, feed_documents)}

_C = _CASES.format(lineitem="lineitem")
_F = f"""SELECT s, document_id, kind, unit, city, "start" + (l_partkey * 7 + s * 11) % 40 - 20 AS a, 'A. S' || l_suppkey || CASE WHEN (l_partkey + s) % 6 = 0 THEN 'x' ELSE '' END AS mover,
  l_quantity::INT + ((l_partkey + s) % 5 = 0)::INT AS ayes, l_extendedprice + CASE WHEN (l_partkey + s) % 4 = 0 THEN 0.01::DOUBLE ELSE 0.004::DOUBLE END AS amount, (l_suppkey + s) % 9 = 0 AS bad FROM ({_C}), range(5) r(s)"""
_T = _ITEMS.format(orders="orders", money="format('{:,.2f}', o_totalprice)", rows=f"SELECT l_orderkey, string_agg({_ROW}, chr(10) ORDER BY l_linenumber, {_ROW}) AS v FROM lineitem GROUP BY l_orderkey")
_M = f"SELECT *, CASE WHEN media LIKE 'http%' THEN media END AS url FROM ({_EVENTS.format(orders='orders')}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY again DESC) = 1"
_NONE = "NULL::VARCHAR"
ORACLES = {
    "extraction_accuracy": f"""
WITH c AS (SELECT *, row_number() OVER () AS i FROM ({_C})), f AS ({_F}),
hit AS (SELECT DISTINCT i, s FROM c JOIN f USING (document_id, kind, unit) WHERE NOT bad AND a < "end" AND a + 15 > "start" AND CASE kind WHEN 'amount' THEN abs(amount - l_extendedprice) <= 0.005
  WHEN 'vote' THEN ayes = l_quantity::INT ELSE lower(regexp_extract(mover, '\\S+$')) = lower(regexp_extract('Ann  s' || l_suppkey, '\\S+$')) END),
e AS (SELECT i, kind, city, s, hit.i IS NOT NULL AS good FROM (SELECT * FROM c, range(5) r(s)) c LEFT JOIN hit USING (i, s)),
l AS (SELECT 'overall' AS level, 'all' AS name, s, good FROM e UNION ALL SELECT 'kind', kind, s, good FROM e UNION ALL SELECT 'city', city, s, good FROM e),
p AS (SELECT level, name, s, count(*) AS n, avg(good::INT) AS x FROM l GROUP BY ALL)
SELECT level, name, max(n) AS cases, count(*) AS runs, round(min(x), 6) AS least, round(median(x), 6) AS median, round(max(x), 6) AS most FROM p GROUP BY level, name""",
    "reject_rate": f"SELECT city, count(*) AS produced, count(*) FILTER (bad) AS rejected, round(avg(bad::INT), 6) AS rate FROM ({_F}) GROUP BY city",
    "rule_facts": rf"""
WITH t AS ({_T}), l AS (SELECT o_orderkey, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM t),
m AS (SELECT *, nullif(lower(regexp_extract(line, '\|\s*(Aye|No|Absent)\s*$', 1)), '') AS row, contains(line, 'In Favor:') AS list FROM l),
q AS (SELECT o_orderkey, min(n) AS a, max(n) AS b FROM m WHERE row IS NOT NULL OR list GROUP BY 1),
n AS (SELECT o_orderkey, n, trim(x) AS name, 'aye' AS value FROM (SELECT o_orderkey, n, unnest(string_split(regexp_extract(line, 'In Favor:(.*)Opposed:', 1), ',')) AS x FROM m WHERE list) UNION ALL SELECT o_orderkey, n, trim(split_part(line, '|', 1)), row FROM m WHERE row IS NOT NULL),
w AS (SELECT o_orderkey, count(*) FILTER (value = 'aye')::INT AS ayes, count(*) FILTER (value = 'no')::INT AS noes, count(*) FILTER (value = 'absent')::INT AS absent, string_agg(name || '=' || value, ',' ORDER BY name || '=' || value) AS members FROM n GROUP BY 1),
v AS (SELECT o_orderkey, string_agg(line, chr(10) ORDER BY n) AS quote FROM m JOIN q USING (o_orderkey) WHERE n BETWEEN a AND b GROUP BY 1),
facts AS (
  SELECT o_orderkey, 'vote' AS kind, quote, coalesce(nullif(regexp_extract(text, 'ORDINANCE \d+[A-Z]?|(CB|Res) \d+'), ''), identifier) AS identifier, {_NONE} AS legislation_type, {_NONE} AS title, NULL::DOUBLE AS amount_usd, {_NONE} AS mover, {_NONE} AS seconder, CASE WHEN ayes > noes THEN 'passed' ELSE 'failed' END AS outcome, ayes, noes, 0 AS abstain, absent, members FROM v JOIN w USING (o_orderkey) JOIN t USING (o_orderkey)
  UNION ALL SELECT o_orderkey, 'amount', line, NULL, NULL, title, replace(replace(x, '$', ''), ',', '')::DOUBLE, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT o_orderkey, line, unnest(regexp_extract_all(line, '\$\d[\d,]*(\.\d+)?')) AS x FROM l) JOIN t USING (o_orderkey)
  UNION ALL SELECT o_orderkey, 'motion', x, NULL, NULL, NULL, NULL, regexp_extract(x, 'member (\w+)', 1), regexp_extract(x, '(\w+)$', 1), CASE WHEN contains(text, 'Passed by') THEN 'passed' ELSE 'unknown' END, NULL, NULL, NULL, NULL, NULL FROM (SELECT *, unnest(regexp_extract_all(text, 'Councilmember \w+ motioned to \w+, motion was seconded by\s+Commissioner\s+\w+')) AS x FROM t)
  UNION ALL SELECT o_orderkey, 'ordinance', (SELECT line FROM l WHERE l.o_orderkey = z.o_orderkey AND contains(line, x) ORDER BY n LIMIT 1), x, CASE WHEN x LIKE 'CB%' THEN 'council_bill' ELSE 'ordinance' END, title, NULL, NULL, NULL, 'unknown', NULL, NULL, NULL, NULL, NULL FROM (SELECT o_orderkey, title, unnest(list_distinct(regexp_extract_all(text, 'ORDINANCE \d+[A-Z]?|CB \d+'))) AS x FROM t) z)
SELECT o_orderkey, kind, (strpos(text, quote) - 1)::INT AS start, (strpos(text, quote) - 1 + length(quote))::INT AS "end", md5(quote) AS quote, f.identifier AS identifier, legislation_type, f.title AS title, amount_usd, mover, seconder, outcome, ayes::DOUBLE AS ayes, noes::DOUBLE AS noes, abstain::DOUBLE AS abstain, absent::DOUBLE AS absent, members FROM facts f JOIN t USING (o_orderkey)""",
    "linked_spans": f"""
WITH w AS (SELECT doc_id, doc_id * 1000000 + "window" AS chunk_id, "window" AS ordinal, ("end" - start)::BIGINT AS size FROM ({STRUCTURE['fixed_windows']})),
b AS (SELECT coalesce(source, '') AS query_id, w.*, CASE WHEN doc_id % 2 = 0 THEN doc_id + 1 WHEN doc_id % 3 = 0 THEN doc_id - 1 END AS linked FROM w JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY (ordinal * 7 + doc_id) % 5, chunk_id) = 1),
s AS (SELECT query_id, b.chunk_id AS hit, CASE WHEN w.chunk_id = b.chunk_id THEN 0 WHEN w.doc_id = b.doc_id THEN 1 ELSE 2 END AS place, w.ordinal, w.chunk_id, w.size FROM b JOIN w ON w.doc_id = b.doc_id OR w.doc_id = b.linked)
SELECT query_id, hit, row_number() OVER o AS position, chunk_id, size FROM s WINDOW o AS (PARTITION BY query_id, hit ORDER BY place, ordinal, chunk_id) QUALIFY place = 0 OR sum(size) OVER o <= 9000""",
    "feed_meetings": f"SELECT 'c1-' || id AS id, body || ' ' || strftime(day, '%Y-%m-%d') AS title, url AS recording_url, strftime(day, '%Y-%m-%d') AS meeting_date FROM ({_M})",
    "feed_documents": rf"""
WITH m AS ({_M}), t AS (SELECT url, regexp_extract(html, 'file: "(documents/seattlechannel/closedcaption/\d{{4}}/\w+\.(srt|vtt))"', 1, 'i') AS track FROM ({_TRACKS.format(customer='customer')})),
x AS (SELECT id, 'agenda' AS kind, agenda AS source_url FROM m UNION ALL SELECT id, 'minutes', minutes FROM m UNION ALL SELECT id, 'transcript', 'https://www.seattlechannel.org/' || track FROM m JOIN t USING (url) WHERE track != '')
SELECT 'c1-' || kind || '-' || id AS id, 'c1-' || id AS meeting_id, 'c1' AS city_id, kind, source_url, CASE WHEN kind != 'transcript' THEN 'application/pdf' WHEN lower(source_url) LIKE '%.srt' THEN 'application/x-subrip' ELSE 'text/vtt' END AS media_type FROM x WHERE source_url IS NOT NULL""",
}
