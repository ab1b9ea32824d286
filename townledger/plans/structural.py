"""Queries of text structure over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from townledger.operators import facts
from townledger.operators import structure as X
from townledger.plans.tables import table
from townledger.sources import captions, listings


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def line_offsets(spark, d):
    return X.line_offsets(_docs(spark, d), "doc_id", "text").select("doc_id", "line", "start", "end", F.md5("line_text").alias("h"))


def fixed_windows(spark, d):
    return X.fixed_windows(_docs(spark, d), "doc_id", "text")


def line_packing(spark, d):
    return X.line_chunks(_docs(spark, d), "doc_id", "text")


def _cues(spark, d):
    """Turns of conversations as cues of 3 seconds, with a pause after every seventh."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", "\n", " ").alias("text"))
    return c.withColumn("start_ms", F.col("turn") * 4000 + F.floor(F.col("turn") / 7) * 9000).withColumn("end_ms", F.col("start_ms") + 3000)


def caption_cues(spark, d):
    """Cues written as SRT files, one for each conversation, and read again."""
    ms = lambda c: F.format_string("%02d:%02d:%02d,%03d", F.floor(c / 3600000), F.floor(c / 60000) % 60, F.floor(c / 1000) % 60, c % 1000)
    one = F.concat_ws("\n", (F.col("turn") + 1).cast("string"), F.concat(ms(F.col("start_ms")), F.lit(" --> "), ms(F.col("end_ms"))), "text")
    files = _cues(spark, d).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("c")))), lambda x: x["c"]), "\n\n").alias("body"))
    return captions.cues(files, "conv_id", "body", vtt=False).select("conv_id", F.col("cue").cast("long").alias("cue"), "start_ms", "end_ms", F.length("text").alias("n"))


def cue_segments(spark, d):
    out = X.caption_segments(_cues(spark, d), "conv_id", "turn", "start_ms", "end_ms", "text")
    return out.select("conv_id", "segment", "start_ms", "end_ms", F.length("text").alias("n"))


def gap_sessions(spark, d):
    e = X.gap_sessions(table(spark, d, "events"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "event_id", 6 * 3600)
    return e.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("event_id").alias("first_id"))


def html_rows(spark, d):
    return listings.table_rows(table(spark, d, "pages"), "page_id", "html", "li").select("page_id", "row", "cell_html")


def _agenda(spark, d, lines):
    """A text of lines of each block of 50 customers of a nation."""
    own = F.struct("c_custkey", *(x.alias(f"l{i}") for i, x in enumerate(lines)))
    c = table(spark, d, "customer").groupBy("c_nationkey", F.floor(F.col("c_custkey") / 50).alias("block")).agg(F.array_sort(F.collect_list(own)).alias("x"))
    body = F.array_join(F.transform("x", lambda x: F.concat_ws("\n", *(x[f"l{i}"] for i in range(len(lines))))), "\n")
    return c.select(F.concat_ws("-", "c_nationkey", "block").alias("doc"), body.alias("text"))


def anchor_extract(spark, d):
    """Numbered agendas: an entry for each customer, of which the first of each letter counts."""
    agenda = _agenda(spark, d, [F.concat(F.lit("1."), F.chr(F.col("c_custkey") % 26 + 65), F.lit(" "), "c_name"), F.col("c_mktsegment"), F.lit("Ayes: All")])
    return X.segment_agendas(agenda, "doc", "text", "numbered")


def anchor_lettered(spark, d):
    """Lettered agendas: entries with a title of their own, or with one above them."""
    bare = F.col("c_custkey") % 3 == 0
    entry = F.concat(F.lit("CB "), (F.col("c_custkey") % 40).cast("string"))
    agenda = _agenda(spark, d, [F.when(bare, F.concat(F.lit("AN ORDINANCE of "), "c_name")).otherwise(F.concat(entry, F.lit(" "), "c_name")), F.when(bare, entry).otherwise(F.col("c_mktsegment")), F.when(F.col("c_custkey") % 2 == 0, "In Favor: 3").otherwise("The Committee recommends")])
    return X.segment_agendas(agenda, "doc", "text", "lettered")


def item_text(spark, d):
    """Texts of a conversation joined by line ends, without short ones."""
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("t"))
    return t.filter(F.length("t") >= 40).select("conv_id", F.md5("t").alias("h"), F.length("t").alias("n"))


def quote_locate(spark, d):
    """Where each window of 1,200 characters of a document, its white space changed, first stands in it."""
    w = _docs(spark, d).select("doc_id", "text", X.window_spans(F.col("text")).alias("spans"))
    quote = lambda x: F.trim(F.regexp_replace(F.substr("text", x["start"] + 1, x["end"] - x["start"]), r"\s+", "  "))
    at = w.select("doc_id", "spans", facts.places(F.col("text"), F.transform("spans", quote)).alias("at"))
    return at.select("doc_id", F.inline(F.arrays_zip("spans", "at"))).select("doc_id", "spans.window", F.col("at.start").alias("first"), F.col("at.end").alias("last"))


def greedy_batches(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return X.greedy_batches(docs, "source", "doc_id", F.col("n_chars"), 24_000)


def speaker_statements(spark, d):
    c = table(spark, d, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", F.substring(F.regexp_replace("text", r"^[^,]*, ", ""), 1, 300).alias("summary"))


def slice_equality(spark, d):
    """Passages whose offsets lie in the text and whose text is what stands there."""
    docs = _docs(spark, d).withColumns({"s": F.col("doc_id") % 97, "e": F.col("doc_id") % 97 + 40})
    passage = F.when(F.col("doc_id") % 5 == 0, F.upper(F.substr("text", F.col("s") + 1, F.lit(40)))).otherwise(F.substr("text", F.col("s") + 1, F.lit(40)))
    ok = (F.col("e") <= F.length("text")) & (F.substr("text", F.col("s") + 1, F.col("e") - F.col("s")) == passage) & F.length(passage).between(10, 2000)
    return docs.select("doc_id", ok.alias("ok"))


def item_end_offsets(spark, d):
    units = table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), (F.col("turn") + 1).alias("unit"), F.length("text").alias("length"))
    items = units.filter("unit % 2 = 1").select("document_id", "unit", F.when(F.col("unit") % 3 == 0, F.lit(5)).otherwise(F.lit(0)).alias("offset"))
    items = items.withColumn("ordinal", F.row_number().over(Window.partitionBy("document_id").orderBy("unit", "offset")))
    return X.item_ends(items, units).select("document_id", "ordinal", "end_unit", F.col("end_offset").cast("long").alias("end_offset"))


def item_links(spark, d):
    """Items of one half of the benchmark linked with those of the other by words of their texts."""
    from townledger.functions import text as T

    b = table(spark, d, "benchmark").select(F.floor(F.col("item_id") / 8).alias("meeting"), F.col("item_id").cast("int").alias("ordinal"), T.title_tokens(F.col("text")).alias("tokens"))
    return X.link_items(X.link_candidates(b.filter("ordinal % 2 = 0"), b.filter("ordinal % 2 = 1"), "meeting", least=0.1), "meeting")


_CUES = "cues AS (SELECT conv_id, turn, replace(text, chr(10), ' ') AS text, turn * 4000 + turn // 7 * 9000 AS start_ms, turn * 4000 + turn // 7 * 9000 + 3000 AS end_ms FROM conversations)"

QUERIES = {f.__name__: f for f in (line_offsets, fixed_windows, line_packing, caption_cues, cue_segments, gap_sessions, html_rows, anchor_extract, anchor_lettered, item_text, quote_locate, greedy_batches, speaker_statements, slice_equality, item_end_offsets, item_links)}
ORACLES = {
    "line_offsets": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents), s AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM l) SELECT doc_id, line::INT AS line, start, (start + length(t))::INT AS \"end\", md5(t) AS h FROM s",
    "fixed_windows": "WITH w AS (SELECT doc_id, length(text) AS n, unnest(range(0, ceil(greatest(0, length(text) - 1200) / 1000)::INT + 1)) AS i FROM documents WHERE length(trim(regexp_replace(text, '\\s', ' ', 'g'))) > 0) SELECT doc_id, i::INT AS \"window\", (i * 1000)::INT AS start, least(i * 1000 + 1200, n)::INT AS \"end\" FROM w",
    "line_packing": r"""WITH RECURSIVE l AS (SELECT doc_id, i, s, s + length(t) AS e FROM (SELECT doc_id, i, t, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))),
        f AS (SELECT doc_id, i, CASE WHEN e - s <= 1200 THEN s END AS cs, CASE WHEN e - s <= 1200 THEN e END AS ce, NULL::BIGINT AS os, NULL::BIGINT AS oe FROM l WHERE i = 1
            UNION ALL SELECT l.doc_id, l.i, CASE WHEN e - s > 1200 THEN NULL WHEN cs IS NOT NULL AND e - cs <= 1200 THEN cs ELSE s END, CASE WHEN e - s > 1200 THEN NULL ELSE e END,
            CASE WHEN cs IS NOT NULL AND NOT (e - s <= 1200 AND e - cs <= 1200) THEN cs END, CASE WHEN cs IS NOT NULL AND NOT (e - s <= 1200 AND e - cs <= 1200) THEN ce END FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1),
        a AS (SELECT doc_id, os AS s, oe AS e FROM f WHERE os IS NOT NULL UNION ALL SELECT f.doc_id, cs, ce FROM f JOIN (SELECT doc_id, max(i) AS i FROM l GROUP BY 1) m ON f.doc_id = m.doc_id AND f.i = m.i WHERE cs IS NOT NULL
            UNION ALL SELECT doc_id, p, least(p + 1200, e) FROM (SELECT doc_id, e, unnest(range(s, e, 1200)) AS p FROM l WHERE e - s > 1200)),
        k AS (SELECT a.doc_id, s, e FROM a JOIN documents d ON a.doc_id = d.doc_id WHERE length(trim(regexp_replace(substr(text, s + 1, e - s), '\s', ' ', 'g'))) > 0)
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s))::INT AS ordinal, s::INT AS start, e::INT AS "end" FROM k""",
    "caption_cues": f"WITH {_CUES} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS cue, start_ms, end_ms, length(trim(regexp_replace(text, '[ \\t]+', ' ', 'g'))) AS n FROM cues WHERE trim(text) != ''",
    "gap_sessions": "WITH e AS (SELECT user_id, event_id, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 > 21600, FALSE)::INT AS g, ts FROM events), s AS (SELECT *, 1 + sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM e) SELECT user_id, session, count(*) AS events, min(event_id) AS first_id FROM s GROUP BY ALL",
    "cue_segments": f"""WITH RECURSIVE {_CUES}, c AS (SELECT conv_id, start_ms AS a, end_ms AS b, length(p) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS k,
            regexp_matches(p, '^(?:>>+\\s*|--\\s*)?((?:SPEAKER \\d+ \\([A-Z ]+\\))|(?:[A-Z][A-Z .''-]{{1,39}})):\\s') OR regexp_matches(p, '^(>>+|--)\\s') AS t
            FROM (SELECT *, substr(text, (i * 1200 + 1)::INT, 1200) AS p FROM (SELECT *, unnest(range(0, (length(text) + 1199) // 1200)) AS i FROM cues WHERE length(text) > 0))),
        f AS (SELECT conv_id, k, 1 AS segment, a, b, n FROM c WHERE k = 1
            UNION ALL SELECT conv_id, k, segment + z::INT, CASE WHEN z THEN a2 ELSE a END, b2, CASE WHEN z THEN n2 ELSE n + 1 + n2 END
            FROM (SELECT c.conv_id, c.k, segment, f.a, f.n, c.a AS a2, c.b AS b2, c.n AS n2, c.b - f.a > 60000 OR f.n + 1 + c.n > 1200 OR (c.t AND f.n >= 300) OR c.a - f.b > 5000 AS z FROM f JOIN c ON c.conv_id = f.conv_id AND c.k = f.k + 1))
        SELECT conv_id, segment, min(a) AS start_ms, max(b) AS end_ms, max(n)::INT AS n FROM f GROUP BY conv_id, segment""",
    "anchor_extract": "WITH c AS (SELECT c_nationkey || '-' || c_custkey // 50 AS doc, *, chr((c_custkey % 26 + 65)::INT) AS l, row_number() OVER (PARTITION BY c_nationkey, c_custkey // 50 ORDER BY c_custkey) - 1 AS i FROM customer), f AS (SELECT *, row_number() OVER (PARTITION BY doc, l ORDER BY i) AS r FROM c) SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY i))::INT AS ordinal, (3 * i)::INT AS line, 'business' AS kind, '1.' || l AS identifier, c_name || ' ' || c_mktsegment AS title FROM f WHERE r = 1",
    "anchor_lettered": "WITH c AS (SELECT c_nationkey || '-' || c_custkey // 50 AS doc, *, c_custkey % 40 AS l, row_number() OVER (PARTITION BY c_nationkey, c_custkey // 50 ORDER BY c_custkey) - 1 AS i FROM customer), f AS (SELECT *, row_number() OVER (PARTITION BY doc, l ORDER BY i) AS r FROM c) SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY i))::INT AS ordinal, (3 * i)::INT AS line, 'business' AS kind, 'CB ' || l AS identifier, CASE WHEN c_custkey % 3 = 0 THEN 'AN ORDINANCE of ' || c_name ELSE c_name || ' ' || c_mktsegment END AS title FROM f WHERE r = 1",
    "quote_locate": """WITH w AS (SELECT doc_id, text, i, substr(text, (i * 1000 + 1)::INT, least(1200, length(text) - i * 1000)::INT) AS q FROM (SELECT doc_id, text, unnest(range(0, ceil(greatest(0, length(text) - 1200) / 1000)::INT + 1)) AS i FROM documents WHERE length(trim(regexp_replace(text, '\\s', ' ', 'g'))) > 0)),
        p AS (SELECT *, regexp_extract(text, '(?s)' || regexp_replace(regexp_replace(trim(q, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '([!-/:-@\\[-`{-~])', '\\\\\\1', 'g'), '\\s+', '\\\\s+', 'g')) AS m FROM w)
        SELECT doc_id, i::INT AS "window", CASE WHEN m != '' THEN strpos(text, m) - 1 END::INT AS first, CASE WHEN m != '' THEN strpos(text, m) - 1 + length(m) END::INT AS last FROM p""",
    "item_links": f"""WITH RECURSIVE b AS (SELECT item_id // 8 AS meeting, item_id::INT AS o, list_distinct(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(lower(text), 'adopt(ed)? (a )?resolution( no\\.?)?( \\d{{4}}-\\d+)?', ' ', 'g'), 'ordinance( no\\.?)? \\d+[a-z]?', ' ', 'g'), '[^a-z0-9]', ' ', 'g'), ' '), lambda x: length(x) >= 3)) AS t FROM benchmark),
        p AS (SELECT r.meeting, r.o AS record, i.o AS item, len(list_intersect(r.t, i.t))::DOUBLE / len(list_distinct(list_concat(r.t, i.t))) AS s FROM b r JOIN b i ON r.meeting = i.meeting AND r.o % 2 = 1 AND i.o % 2 = 0),
        l AS (SELECT meeting, record, list(item ORDER BY s DESC, item) AS items, row_number() OVER (PARTITION BY meeting ORDER BY record) AS k FROM p WHERE s >= 0.1 GROUP BY meeting, record),
        f AS (SELECT meeting, record, k, items[1] AS item, [items[1]] AS used FROM l WHERE k = 1
            UNION ALL SELECT l.meeting, l.record, l.k, list_filter(l.items, lambda x: NOT list_contains(f.used, x))[1], list_append(f.used, list_filter(l.items, lambda x: NOT list_contains(f.used, x))[1]) FROM f JOIN l ON l.meeting = f.meeting AND l.k = f.k + 1)
        SELECT meeting, record, item FROM f WHERE item IS NOT NULL""",
    "html_rows": "SELECT page_id, (generate_subscripts(c, 1) - 1)::INT AS row, unnest(c) AS cell_html FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1) AS c FROM pages)",
    "item_text": "SELECT conv_id, md5(t) AS h, length(t) AS n FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1) WHERE length(t) >= 40",
    "greedy_batches": "WITH RECURSIVE d AS (SELECT source, doc_id, least(n_chars, 24000) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents), f AS (SELECT source, doc_id, i, n AS used, 1 AS batch FROM d WHERE i = 1 UNION ALL SELECT d.source, d.doc_id, d.i, CASE WHEN used + n > 24000 THEN n ELSE used + n END, CASE WHEN used + n > 24000 THEN batch + 1 ELSE batch END FROM f JOIN d ON d.source = f.source AND d.i = f.i + 1) SELECT source, doc_id, batch FROM f",
    "speaker_statements": "SELECT conv_id, turn, substr(regexp_replace(text, '^[^,]*, ', ''), 1, 300) AS summary FROM conversations WHERE role = 'user'",
    "slice_equality": "WITH p AS (SELECT doc_id, text, doc_id % 97 AS s, CASE WHEN doc_id % 5 = 0 THEN upper(substr(text, doc_id % 97 + 1, 40)) ELSE substr(text, doc_id % 97 + 1, 40) END AS p FROM documents) SELECT doc_id, s + 40 <= length(text) AND substr(text, s + 1, 40) = p AND length(p) BETWEEN 10 AND 2000 AS ok FROM p",
    "item_end_offsets": "WITH u AS (SELECT conv_id AS document_id, turn + 1 AS unit, length(text) AS length FROM conversations), i AS (SELECT document_id, unit, CASE WHEN unit % 3 = 0 THEN 5 ELSE 0 END AS off FROM u WHERE unit % 2 = 1), n AS (SELECT *, row_number() OVER w AS ordinal, lead(unit) OVER w AS nu, lead(off) OVER w AS no FROM i WINDOW w AS (PARTITION BY document_id ORDER BY unit, off)), m AS (SELECT document_id, max(unit) AS last FROM u GROUP BY 1), x AS (SELECT n.document_id, ordinal, nu, no, n.unit, CASE WHEN nu IS NULL THEN last WHEN no = 0 AND nu != n.unit THEN nu - 1 ELSE nu END AS end_unit FROM n JOIN m USING (document_id)) SELECT x.document_id, ordinal::INT AS ordinal, end_unit, CASE WHEN nu IS NULL OR (no = 0 AND nu != x.unit) THEN length ELSE no END::BIGINT AS end_offset FROM x JOIN u ON u.document_id = x.document_id AND u.unit = x.end_unit",
}
