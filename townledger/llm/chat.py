"""Perspective rotation: a dialogue rendered once for each of its participants, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns of one part of a rendering; a longer dialogue comes in several parts, none of its turns is left out.
PART_TURNS = 64


def rotate_perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", narrator: str = "system", part_turns: int = PART_TURNS) -> DataFrame:
    """One row for each (dialogue, participant, part): the participant is the assistant, all others named users.

    A turn of the participant is rendered ``<|assistant|>`` newline text ``<|end|>`` newline, one of the
    narrator ``<|system|>...``, any other ``<|user:NAME|>...``.  loss_spans holds [start, end) in code points of
    the participant's texts with their end mark: what a loss counts; all else is masked.  Participants are the
    speakers other than the narrator who have a turn, so a dialogue of only narration gives no row.

    Order: turn, nulls first, then speaker and text.  A null speaker is the participant "unknown", a null text
    is empty; a null dialogue id is a dialogue of its own.  Parts are runs of turn numbers (turn div part_turns)
    cut again where ties fill them, so a dialogue of any length spreads over tasks; char_start
    is where a part begins in the whole rendering.  Repeated rows are turns of their own.
    """
    t = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    t = t.withColumn("_run", F.coalesce(F.floor(F.col("turn") / F.lit(part_turns)), F.lit(-(1 << 62))))
    # Ties: a run of turn numbers may hold any number of rows, and is then cut into pieces by what orders its rows.
    sized = t.groupBy("conv_id", "_run", "turn", "speaker").agg(F.count(F.lit(1)).alias("_n"))
    runs = sized.groupBy("conv_id", "_run").agg(F.sum("_n").alias("_n"))
    crowded = runs.filter(F.col("_n") > 4 * part_turns).select("conv_id", "_run", F.lit(True).alias("_many"))
    same = t["conv_id"].eqNullSafe(crowded["conv_id"]) & (t["_run"] == crowded["_run"])
    t = t.join(crowded, same, "left").select(t["*"], F.when(F.col("_many"), F.struct(F.col("turn").alias("a"), t["speaker"].alias("b"), F.substring(F.sha2(t["text"], 256), 1, 4).alias("c"))).alias("_piece"))

    cast = t.filter(F.col("speaker") != narrator).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    me = F.col("speaker") == F.col("perspective")
    head = F.when(F.col("speaker") == narrator, F.lit("<|system|>\n")).when(me, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user:"), F.col("speaker"), F.lit("|>\n")))
    tail = F.lit("<|end|>\n")
    seen = t.alias("t").join(cast.alias("c"), F.col("t.conv_id").eqNullSafe(F.col("c.conv_id"))).select("t.*", "c.perspective")
    lines = seen.select(
        "conv_id", "perspective", "_run", "_piece", "turn", "speaker", "text", F.concat(head, F.col("text"), tail).alias("line"),
        me.alias("mine"), F.length(head).alias("h"), F.length("text").alias("n"),
    )
    one = F.struct("turn", "speaker", "text", "line", "mine", "h", "n")
    parts = lines.groupBy("conv_id", "perspective", "_run", "_piece").agg(F.array_sort(F.collect_list(one)).alias("_turns"))
    parts = parts.withColumn("text", F.array_join(F.transform("_turns", lambda x: x["line"]), ""))
    fold = F.aggregate(
        "_turns",
        F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["line"])).alias("at"),
            F.when(x["mine"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["h"]).alias("start"), (acc["at"] + x["h"] + x["n"] + F.lit(7)).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    parts = parts.select("conv_id", "perspective", "_run", "_piece", "text", fold["spans"].alias("loss_spans"), F.size("_turns").alias("n_turns"), F.length("text").cast("long").alias("_len"))
    order = Window.partitionBy("conv_id", "perspective").orderBy("_run", F.col("_piece").asc_nulls_first())
    return parts.select(
        "conv_id", "perspective", (F.row_number().over(order) - 1).alias("part"), "n_turns", "text", "loss_spans",
        F.coalesce(F.sum("_len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("char_start"),
    )
