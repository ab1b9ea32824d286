"""The tables of civic records as Spark schemas, and the public views over them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "cities": "id string, name string, state string, item_format string",
    "meetings": "id string, city_id string, body string, meeting_date date, title string, source_key string, recording_url string, recording_seek string",
    "documents": "id string, meeting_id string, city_id string, kind string, media_type string, unit_kind string, status string, duplicate_of string, sha256 string, bytes long",
    "units": "document_id string, unit_index int, kind string, text string, text_source string, ocr_confidence float, start_ms long, end_ms long, speaker string, boxes array<struct<start:int,end:int,x0:double,top:double,x1:double,bottom:double>>",
    "items": "id long, document_id string, ordinal int, kind string, identifier string, title string, start_unit int, start_offset int, end_unit int, end_offset int, linked_item_id long",
    "facts": "id long, document_id string, item_id long, kind string, unit_index int, quote string, quote_start int, quote_end int, verified boolean, verify_error string, data string",
}

#: Columns of the views of one kind of fact: name, path in the fact's JSON, type.
FACT_VIEWS = {
    "v_motions": ("motion", (("mover", "string"), ("seconder", "string"), ("text", "string"), ("outcome", "string"))),
    "v_votes": ("vote", (("ayes", "int"), ("noes", "int"), ("abstain", "int"), ("absent", "int"), ("result", "string"))),
    "v_ordinances": ("ordinance", (("identifier", "string"), ("title", "string"), ("action", "string"))),
    "v_amounts": ("amount", (("amount_usd", "decimal(18,2)"), ("purpose", "string"))),
    "v_statements": ("statement", (("speaker", "string"), ("summary", "string"))),
}
VIEWS = ("v_meetings", "v_documents", "v_units", "v_items", "v_facts", "v_vote_members", *FACT_VIEWS)


def views(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The public views: only downloaded documents and verified facts are seen, facts of a kind with typed columns."""
    documents = tables["documents"].filter("status = 'downloaded'").join(tables["meetings"].select(F.col("id").alias("meeting_id"), "body", "meeting_date"), "meeting_id")
    facts = tables["facts"].filter("verified")
    base = ["id", "document_id", "item_id", "unit_index", "quote"]
    out = {"v_meetings": tables["meetings"], "v_documents": documents, "v_units": tables["units"].drop("boxes"), "v_items": tables["items"], "v_facts": facts.drop("data", "verify_error")}
    for name, (kind, columns) in FACT_VIEWS.items():
        own = facts.filter(F.col("kind") == kind)
        out[name] = own.select(*base, *[F.get_json_object("data", f"$.{c}").try_cast(t).alias(c) for c, t in columns])
    members = F.from_json(F.get_json_object("data", "$.members"), "array<struct<name:string,value:string>>")
    out["v_vote_members"] = facts.filter("kind = 'vote'").select("id", "document_id", F.inline(members))
    return out


def register(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    for name, df in views(tables).items():
        df.createOrReplaceTempView(name)
