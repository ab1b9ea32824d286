"""Text structure: lines, windows and chunks, caption segments, batches, agenda items, links and quotes.

Offsets are code points from 0. Folds that need a document's rows in order run in Python for each document (or page)
over Arrow batches; all else are expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townledger.functions.text import small_batches
from townledger.operators import ordered

WINDOW, STEP, BATCH_CHARS, TITLE_CHARS = 1200, 1000, 24_000, 300


def line_offsets(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, start, end, line_text): lines from 0, with their places in the text."""
    kind = df.schema[key].dataType.simpleString()
    small_batches(df.sparkSession)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = pc.split_pattern(batch.column(1), "\n")
            n = pc.fill_null(pc.list_value_length(lines), 0).to_numpy(False)
            texts = lines.flatten()
            size = pc.utf8_length(texts).to_numpy(False).astype(np.int64)
            row, first = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n) - n, n)
            ends = np.cumsum(size + 1)
            end = ends - np.append(0, ends)[first] - 1
            columns = [batch.column(0).take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (np.arange(len(row)) - first, end - size, end)), texts]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "line", "start", "end", "line_text"])

    return df.select(key, text).mapInArrow(per_task, f"{key} {kind}, line int, start int, end int, line_text string")


def window_spans(text: Column, size: int = WINDOW, step: int = STEP) -> Column:
    """An array of (window, start, end): windows of size characters every step, the last ending with the text; a blank text has none."""
    blank = F.length(F.trim(F.regexp_replace(text, r"\s", " "))) == 0
    last = lambda n: F.ceil(F.greatest(F.lit(0), n - size) / step).cast("int")
    span = lambda i, n: F.struct(i.alias("window"), (i * step).cast("int").alias("start"), F.least(i * step + size, n).cast("int").alias("end"))
    spans = lambda n: F.transform(F.sequence(F.lit(0), last(n)), lambda i: span(i, n))
    return F.when(~blank, F.flatten(F.transform(F.array(F.length(text)), spans)))  # the length stands in an array of one, so that it is worked out once


def fixed_windows(df: DataFrame, key: str, text: str, size: int = WINDOW, step: int = STEP, keep: Sequence[str] = ()) -> DataFrame:
    """(key, *keep, window, start, end): the windows of each text, see window_spans."""
    return df.select(key, *keep, F.inline(window_spans(F.col(text), size, step)))


def pack_lines(text: str, size: int = WINDOW) -> list[tuple[int, int]]:
    """Spans of whole lines of up to size characters; longer lines are cut, spans of white space dropped."""
    spans: list[tuple[int, int]] = []
    held: tuple[int, int] | None = None
    at = 0
    for line in text.split("\n"):
        a, b = at, at + len(line)
        at = b + 1
        fits = b - a <= size
        if held and fits and b - held[0] <= size:
            held = (held[0], b)
            continue
        if held:
            spans.append(held)
        held = (a, b) if fits else None
        if not fits:
            spans += [(x, min(x + size, b)) for x in range(a, b, size)]
    if held:
        spans.append(held)
    return [(a, b) for a, b in spans if text[a:b].strip()]


def line_chunks(df: DataFrame, key: str, text: str, size: int = WINDOW) -> DataFrame:
    """(key, ordinal, start, end): the packed lines of each text."""
    kind = df.schema[key].dataType.simpleString()
    small_batches(df.sparkSession)

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, a, b) for k, t in zip(pdf[key], pdf[text]) for i, (a, b) in enumerate(pack_lines(t or "", size), 1)]
            yield pd.DataFrame(rows, columns=[key, "ordinal", "start", "end"])
            del pdf, rows  # before the next batch is read

    return df.select(key, text).mapInPandas(per_batch, f"{key} {kind}, ordinal int, start int, end int")


# How captions mark a speaker or a change of speakers.
SPEAKER = r"^(?:>>+\s*|--\s*)?((?:SPEAKER \d+ \([A-Z ]+\))|(?:[A-Z][A-Z .'-]{1,39})):\s"
MARKER = r"^(?:>>+|--)\s"


def _split_cues(cues: pd.DataFrame, size: int) -> pd.DataFrame:
    """Cues of start, end and text; texts of over size characters as several cues of the same time."""
    parts = cues["text"].map(lambda t: [t[i : i + size] for i in range(0, len(t), size)])
    return cues.assign(text=parts).explode("text").dropna(subset="text").reset_index(drop=True)


def segment_starts(start: np.ndarray, end: np.ndarray, size: np.ndarray, turn: np.ndarray, most: int, span_ms: int, gap_ms: int, marked: int) -> list[int]:
    """Where segments of cues in order begin: from each, straight to the first cue that one of four limits keeps out.

    The limits are the length of the joined text, the time since the segment's start, a pause, and a change of
    speakers once the segment has some text.
    """
    n, chars = len(start), np.concatenate([[0], np.cumsum(size + 1)])
    paused = np.flatnonzero(start[1:] - end[:-1] > gap_ms) + 1
    turns = np.flatnonzero(turn)
    first = lambda places, least: int(places[k]) if (k := np.searchsorted(places, least)) < len(places) else n
    out, i = [], 0
    while i < n:
        out.append(i)
        full = int(np.searchsorted(chars, chars[i] + most + 1, "right")) - 1
        told = int(np.searchsorted(chars, chars[i] + marked + 1))
        stop = min(max(full, i + 1), first(paused, i + 1), first(turns, max(told, i + 1)))
        late = np.flatnonzero(end[i + 1 : stop] - start[i] > span_ms)
        i = i + 1 + int(late[0]) if len(late) else stop
    return out


def cue_segments(cues: list[tuple[int, int, str]], size: int = WINDOW, span_ms: int = 60_000, gap_ms: int = 5_000, marked: int = 300) -> list[tuple[int, int, str, str | None]]:
    """(start, end, text, speaker) of the segments of caption cues in order."""
    rows = _split_cues(pd.DataFrame(cues, columns=["start", "end", "text"]), size)
    if rows.empty:
        return []
    who = rows["text"].str.extract(SPEAKER, expand=False)
    turn = who.notna() | rows["text"].str.contains(MARKER)
    at = segment_starts(rows["start"].to_numpy(np.int64), rows["end"].to_numpy(np.int64), rows["text"].str.len().to_numpy(), turn.to_numpy(), size, span_ms, gap_ms, marked)
    return [(int(rows["start"][a]), int(rows["end"][b - 1]), " ".join(rows["text"][a:b]), None if pd.isna(who[a]) else who[a]) for a, b in zip(at, [*at[1:], len(rows)])]


def caption_segments(cues: DataFrame, key: str, order: str, start: str, end: str, text: str) -> DataFrame:
    """(key, segment, start_ms, end_ms, text, speaker) of each document's cues."""
    kind = cues.schema[key].dataType.simpleString()

    def per_document(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        made = cue_segments(list(zip(pdf[start].tolist(), pdf[end].tolist(), pdf[text].tolist())))
        return pd.DataFrame([(pdf[key].iloc[0], i, *s) for i, s in enumerate(made, 1)], columns=[key, "segment", "start_ms", "end_ms", "text", "speaker"])

    return cues.select(key, order, start, end, text).groupBy(key).applyInPandas(per_document, f"{key} {kind}, segment int, start_ms long, end_ms long, text string, speaker string")


def _chains(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sizes in order: sums before each item (and of all), and for a batch that begins at each item, how many batches follow to the end, itself included, and what the last one holds."""
    sums = np.concatenate([[0], np.cumsum(n)])
    after = np.maximum(np.searchsorted(sums, sums[:-1] + most, "right") - 1, np.arange(1, len(n) + 1))
    count, fill = np.ones(len(n) + 1, np.int64), np.zeros(len(n) + 1, np.int64)
    for i in range(len(n) - 1, -1, -1):
        j = after[i]
        count[i], fill[i] = (1, sums[-1] - sums[i]) if j >= len(n) else (count[j] + 1, fill[j])
    return sums, count, fill


def greedy_batches(items: DataFrame, group: str, order: str, size: Column, most: int = BATCH_CHARS) -> DataFrame:
    """(group, order, batch): from 1 in each group; a batch closes before an item that would take it over most characters.

    Where a batch begins depends on all before it, but only through how full the open batch is. So each sorted part tells, for
    every item at which its first new batch may begin, how many batches follow and how full the last one is; a group's parts
    (not its items) are chained, and then each part numbers its own items. Larger items count as most.
    """
    kinds = {c: items.schema[c].dataType.simpleString() for c in (group, order)}
    dealt = ordered.parts(items.select(group, order, F.least(size, F.lit(most)).cast("long").alias("_n")), [group], [order])

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        sums, count, fill = _chains(pdf.sort_values(order)["_n"].to_numpy(), most)
        k = np.searchsorted(sums, most, "right")
        return pd.DataFrame({group: pdf[group].iloc[:1].to_numpy(), ordered.PART: [pdf[ordered.PART].iloc[0]], "sums": [sums[:k]], "count": [count[:k]], "fill": [fill[:k]], "items": [len(pdf)], "total": [sums[-1]]})

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        out, used, batch = [], most + 1, 0  # before the first part: no batch is open
        for r in pdf.sort_values(ordered.PART).itertuples(index=False):
            out.append((used, batch))
            i = int(np.searchsorted(r.sums, most - used, "right")) - 1 if used <= most else 0
            if used <= most and i >= r.items:
                used += r.total
            else:
                used, batch = int(r.fill[i]), batch + int(r.count[i])
        return pd.DataFrame({group: pdf.sort_values(ordered.PART)[group].to_numpy(), ordered.PART: np.sort(pdf[ordered.PART].to_numpy()), "_used": [u for u, _ in out], "_batch": [b for _, b in out]})

    def numbered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        used, batch, out = int(pdf["_used"].iloc[0]), int(pdf["_batch"].iloc[0]), []
        for n in pdf["_n"].tolist():
            used, batch = (n, batch + 1) if used + n > most else (used + n, batch)
            out.append(batch)
        return pdf[[group, order]].assign(batch=out)

    parts = dealt.groupBy(group, ordered.PART).applyInPandas(told, f"{group} {kinds[group]}, {ordered.PART} int, sums array<long>, count array<long>, fill array<long>, items long, total long")
    carried = parts.groupBy(group).applyInPandas(chained, f"{group} {kinds[group]}, {ordered.PART} int, _used long, _batch long")
    same = dealt[group].eqNullSafe(carried[group]) & (dealt[ordered.PART] == carried[ordered.PART])
    opened = dealt.join(carried, same).select(dealt["*"], "_used", "_batch")
    return opened.groupBy(group, ordered.PART).applyInPandas(numbered, f"{group} {kinds[group]}, {order} {kinds[order]}, batch int")


def gap_sessions(df: DataFrame, key: str, at: Column, order: str, gap: float) -> DataFrame:
    """df with session: from 1 for each key, a new one after a gap of more than gap seconds."""
    dealt = ordered.previous_in_parts(ordered.parts(df.withColumn("_at", at), [key], ["_at", order]), [key], ["_at", order], "_at", "_last")
    new = F.coalesce((F.col("_at") - F.col("_last") > gap).cast("long"), F.lit(0))
    return ordered.sums_of_parts(dealt, [key], ["_at", order], {"session": new}).withColumn("session", F.col("session") + 1).drop("_at", "_last", ordered.PART)


def item_ends(items: DataFrame, units: DataFrame, doc: str = "document_id") -> DataFrame:
    """items (doc, ordinal, unit, offset) with end_unit, end_offset: where the next item starts, or, if that is the start of another unit, where the unit before it ends; the last ends with the document.

    units: (doc, unit, length), numbered without gaps in the order of reading.
    """
    w = Window.partitionBy(doc).orderBy("unit", "offset")
    ahead = items.withColumns({"nu": F.lead("unit").over(w), "no": F.lead("offset").over(w)})
    last = units.groupBy(doc).agg(F.max("unit").alias("last_unit"))
    back = (F.col("no") == 0) & (F.col("nu") != F.col("unit"))
    ahead = ahead.join(last, doc).withColumn("end_unit", F.when(F.col("nu").isNull(), F.col("last_unit")).when(back, F.col("nu") - 1).otherwise(F.col("nu")))
    sized = ahead.join(units.select(doc, F.col("unit").alias("end_unit"), "length"), [doc, "end_unit"])
    return sized.withColumn("end_offset", F.when(F.col("nu").isNull() | back, F.col("length")).otherwise(F.col("no"))).drop("nu", "no", "last_unit", "length")


# The two agenda dialects. A heading or an entry begins an item; a title ends before a line that begins
# with a stop (in the numbered dialect also before one that says "motioned").
HEADING = {"lettered": r"^([A-L])\. ([A-Z][A-Z ,&/'-]{3,}):?$", "numbered": r"^(\d{1,2})\.\s+([A-Z][A-Z0-9 ,&/()'-]{2,}.*)$"}
ENTRY = {"lettered": r"^(?:\d{1,3}\.\s+)?((?:CB|Res|CF|Appt|Min|IRC|Inf) \d+)\b(.*)$", "numbered": r"^(\d{1,2}\.[A-Z]{1,2})\.?(?:\s+|$)(.*)$"}
TITLE_BEGINS = ("AN ORDINANCE", "A RESOLUTION", "Appointment", "Reappointment", "Council Bill", "Clerk File")
STOPS = {
    "lettered": (r"The Committee recommends", r"In Favor:", r"Opposed:", r"Supporting", r"Attachments:", r"The .* was "),
    "numbered": (r"Ayes:", r"Noes:", r"Seeing no", r"[A-Z][a-z]+ [A-Z][a-z]+(?:,.*)? presented\b", r"(?i:.*\bmotioned\b)"),
}


def _title(lines: Column, stops: Sequence[str] = ()) -> Column:
    """The lines before the first stop, trimmed, joined by blanks, at most TITLE_CHARS."""
    if stops:
        stop = F.array_position(F.transform(lines, lambda x: F.ltrim(x).rlike("^(?:" + "|".join(stops) + ")")), True)
        lines = F.when(stop > 0, F.slice(lines, 1, F.greatest(stop.cast("int") - 1, F.lit(0)))).otherwise(lines)
    solid = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    return F.trim(F.substring(F.array_join(solid, " "), 1, TITLE_CHARS))


def segment_agendas(docs: DataFrame, key: str, text: str, dialect: str) -> DataFrame:
    """(key, ordinal, line, kind, identifier, title) of every document's items; what is before the first is PREAMBLE.

    The first entry of an identifier counts; later ones only end titles. In the lettered dialect an entry without a
    title of its own takes the lines above it, from where a title begins; in the numbered one the first heading of a number
    counts and later ones are plain text. A null text has no items.
    """
    lettered, entry, heading = dialect == "lettered", ENTRY[dialect], HEADING[dialect]
    lines = F.split(F.col(text), "\n")
    mark = lambda x, i: F.when(
        x.rlike(entry), F.struct(i.alias("line"), F.lit("business").alias("kind"), F.regexp_extract(x, entry, 1).alias("name"), F.regexp_extract(x, entry, 2).alias("own"))
    ).when(x.rlike(heading), F.struct(i.alias("line"), F.lit("section").alias("kind"), F.regexp_extract(x, heading, 1).alias("name"), F.regexp_extract(x, heading, 2).alias("own")))
    rows = docs.filter(F.col(text).isNotNull()).select(key, lines.alias("lines")).withColumn("marks", F.array_compact(F.transform("lines", mark)))
    named = F.transform("marks", lambda m: F.concat_ws(" ", m["kind"], m["name"]))
    rows = rows.withColumn("named", named)
    first = lambda m, i: F.array_position(F.col("named"), F.concat_ws(" ", m["kind"], m["name"])) == i + 1
    if not lettered:
        rows = rows.withColumn("marks", F.filter("marks", lambda m, i: (m["kind"] == "business") | first(m, i))).withColumn("named", named)
    else:  # where the title above an entry begins
        before = lambda i: F.when(i > 0, F.get("marks", i - 1)["line"] + 1).otherwise(F.lit(0))
        begins = lambda m, i: F.array_position(F.transform(F.slice("lines", before(i) + 1, m["line"] - before(i)), lambda x: x.rlike(rf"^(?:{'|'.join(TITLE_BEGINS)})\b")), True).cast("int")
        rows = rows.withColumn("tops", F.transform("marks", lambda m, i: F.when(begins(m, i) > 0, before(i) + begins(m, i) - 1).otherwise(m["line"])))
    end = F.transform("marks", lambda m, i: F.coalesce(F.get("marks", i + 1)["line"], F.size("lines")))
    rows = rows.withColumn("ends", end)
    if lettered:  # a title above the next entry is not this one's
        rows = rows.withColumn("ends", F.transform("ends", lambda e, i: F.when(F.get("marks", i + 1)["kind"] == "business", F.least(e, F.get("tops", i + 1))).otherwise(e)))
    keep = F.transform("marks", lambda m, i: (m["kind"] == "section") | first(m, i))
    each = F.arrays_zip(F.col("marks").alias("m"), F.col("ends").alias("end"), keep.alias("keep"), *([F.col("tops").alias("top")] if lettered else []))
    items = rows.select(key, "lines", F.explode_outer(each).alias("z"))
    m = {c: F.col(f"z.m.{c}") for c in ("line", "kind", "name", "own")}
    section, below = m["kind"] == "section", F.concat(F.array(m["own"]), F.slice("lines", m["line"] + 2, F.greatest(F.lit(0), F.col("z.end") - m["line"] - 1)))
    line, title = m["line"], _title(below, STOPS[dialect])
    if lettered:
        bare = ~section & (F.trim(m["own"]) == "")
        line = F.when(bare, F.col("z.top")).otherwise(line)
        above = F.when(F.col("z.top") < m["line"], _title(F.slice("lines", F.col("z.top") + 1, m["line"] - F.col("z.top")))).otherwise(F.get("lines", m["line"]))
        title = F.when(bare, above).otherwise(title)
    name = m["name"] if lettered else F.when(section, F.concat(m["name"], F.lit("."))).otherwise(m["name"])
    found = items.filter("z.m IS NOT NULL AND z.keep").select(key, line.alias("line"), m["kind"].alias("kind"), name.alias("identifier"), F.when(section, F.substring(m["own"], 1, TITLE_CHARS)).otherwise(title).alias("title"))
    start = docs.filter(F.col(text).isNotNull()).select(key).join(found.groupBy(key).agg(F.min("line").alias("first")), key, "left").filter("first IS NULL OR first > 0")
    found = found.unionByName(start.select(key, F.lit(0).alias("line"), F.lit("section").alias("kind"), F.lit("PREAMBLE").alias("identifier"), F.lit("Preamble").alias("title")))
    order = Window.partitionBy(key).orderBy("line", "kind", "identifier")
    return found.select(key, F.row_number().over(order).alias("ordinal"), "line", "kind", "identifier", "title")


def link_candidates(items: DataFrame, records: DataFrame, group: str, tokens: str = "tokens", least: float = 0.5) -> DataFrame:
    """(group, record, item, similarity) of items that share a title token and have Jaccard similarity of at least least."""
    a = items.select(group, F.col("ordinal").alias("item"), F.col(tokens).alias("at"), F.explode(tokens).alias("t"))
    r = records.select(group, F.col("ordinal").alias("record"), F.col(tokens).alias("rt"), F.explode(tokens).alias("t"))
    both = a.join(r, [group, "t"]).groupBy(group, "record", "item").agg(F.count(F.lit(1)).alias("k"), F.first(F.size("at")).alias("na"), F.first(F.size("rt")).alias("nr"))
    return both.withColumn("similarity", F.col("k") / (F.col("na") + F.col("nr") - F.col("k"))).filter(F.col("similarity") >= least).select(group, "record", "item", "similarity")


def link_items(candidates: DataFrame, group: str) -> DataFrame:
    """(group, record, item): records in order take their most similar item that is left, the lower one on ties."""
    kind = candidates.schema[group].dataType.simpleString()

    def per_meeting(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[int] = set()
        rows = []
        for record, own in pdf.sort_values(["record", "similarity", "item"], ascending=[True, False, True]).groupby("record", sort=True):
            pick = next((i for i in own["item"] if i not in used), None)
            if pick is not None:
                used.add(pick)
                rows.append((pdf[group].iloc[0], record, pick))
        return pd.DataFrame(rows, columns=[group, "record", "item"])

    return candidates.groupBy(group).applyInPandas(per_meeting, f"{group} {kind}, record int, item int")
