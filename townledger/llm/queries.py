"""The queries of this package: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townledger.llm import chat, decontam, htmltext, langid, licenses, media, ngram_join, packing, repair, resample, sharding, tokenfiles, toxicity
from townledger.llm.common import shared_dir, table


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("loss_spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return out.select("conv_id", "perspective", F.col("part").cast("long").alias("part"), F.col("n_turns").cast("long").alias("n_turns"), "text", spans.alias("loss_spans"), F.col("char_start").cast("long").alias("char_start"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.join_ngrams(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id")


def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"))


def op4_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.find_matches(spark, docs, table(spark, sf_dir, "benchmark"), without=("text",)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(spark, docs, without=("text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op6_html_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(spark, table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 40)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(spark, docs, table(spark, sf_dir, "labels"), without=("text",)).select("doc_id", "held_out", "score", "predicted")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark)
    tokenfiles.write_token_files(table(spark, sf_dir, "documents"), out, end=2, meta=("lang", "source"))
    return tokenfiles.token_digest(spark, out)


def op10_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = media.media_of_embeddings(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return media.find_copies(spark, images)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resample(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), without=("text",))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(spark, repair.damage(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_perspective_rotation, op2_ngram_jaccard_join, op3_mixture_packing, op4_suffix_array_decontamination, op5_language_id, op6_html_tree_model, op7_rendezvous_sharding, op8_toxicity, op9_token_files, op10_media_copies, op11_importance_resampling, op12_license_scan, op13_conversation_repair)
}

#: Only what SQL can express; the rest is tested against brute force, round trips and held-out accuracy.
ORACLES: dict[str, str] = {
    "op1_perspective_rotation": """
        WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body, turn // 64 AS run FROM conversations),
        c AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker != 'system'),
        l AS (SELECT t.*, perspective, CASE WHEN speaker = 'system' THEN '<|system|>' || chr(10) WHEN speaker = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user:' || speaker || '|>' || chr(10) END AS head FROM t JOIN c USING (conv_id)),
        p AS (SELECT *, head || body || '<|end|>' || chr(10) AS line, sum(length(head) + length(body) + 8) OVER (PARTITION BY conv_id, perspective, run ORDER BY turn, speaker, body ROWS UNBOUNDED PRECEDING) - length(head) - length(body) - 8 AS pos FROM l),
        g AS (SELECT conv_id, perspective, run, count(*) AS n_turns, string_agg(line, '' ORDER BY turn, speaker, body) AS text,
            coalesce(string_agg((pos + length(head)) || '-' || (pos + length(head) + length(body) + 7), ',' ORDER BY turn, speaker, body) FILTER (speaker = perspective), '') AS loss_spans FROM p GROUP BY ALL)
        SELECT conv_id, perspective, row_number() OVER w - 1 AS part, n_turns, text, loss_spans, coalesce(sum(length(text)) OVER (PARTITION BY conv_id, perspective ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start
        FROM g WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY run)""",
    # crc32 is worked out for each distinct word, byte by byte, from the table of its polynomial.
    "op11_importance_resampling": r"""
        WITH step AS (SELECT list(list_reduce([n] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS tab FROM range(256) r(n)),
        w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
        dw AS (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS word FROM w) GROUP BY ALL),
        v AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
        b AS (SELECT word, xor(4294967295, list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, y: xor(tab[1 + xor(c & 255, y)], c >> 8))) % 10000 AS bucket FROM v, step),
        s AS (SELECT bucket, sum(c) AS s FROM dw JOIN b USING (word) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS t FROM bw JOIN b USING (word) GROUP BY bucket),
        g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM (SELECT DISTINCT bucket FROM b) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
        m AS (SELECT doc_id, sum(c * gain)::BIGINT AS weight FROM dw JOIN b USING (word) JOIN g USING (bucket) GROUP BY doc_id),
        z AS (SELECT doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN m USING (doc_id)),
        r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM r) THEN rank END AS rank FROM z LEFT JOIN r USING (doc_id)""",
}
