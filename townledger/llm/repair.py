"""Conversation structure repair: the cheapest edits that give a dialogue the grammar (s?(ua)+)?, by a forward Viterbi pass.

The grammar has four states: nothing yet (0), after a system turn (1), after a user turn (2), after an assistant turn (3);
0 and 3 may end a dialogue. A layer holds, for each state, the least (cost, audit) of the turns so far, audit being the
initials of the edits: Keep, Rerole, Delete, Insert. Of one cost and one number of turns no audit begins another one (only
inserts could follow, and they cost), so the least audit of a layer stays least whatever follows.

Dialogues of ordinary length are solved each in one group. A longer one is cut into blocks: each block's layers from all four
states, then the blocks' joined ones, and at last each block's turns by the edits found for it.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from townledger.llm.common import shared_dir, small_batches, stored
from townledger.operators.ordered import PART, parts

#: A dialogue with more turns or bytes of text is cut into blocks.
LONG_TURNS, LONG_BYTES = 4096, 16 << 20
#: Ids of long dialogues, or first places of repeated turns in them, that a broadcast may hold; beyond, Spark joins by shuffle.
MAX_BROADCAST = 100_000
#: Bytes of repaired text in one row on its way to the digest.
PIECE_BYTES = 1 << 20

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ENDS = (0, 3)
BLANKS = " \t\n\x0b\x0c\r"
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ADDED = {0: "u", 1: "u", 2: "a", 3: "u"}  # the only turn of a user or an assistant that may follow each state
_NAMES = {"u": "user", "a": "assistant"}
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
Layer = dict[int, tuple[int, str]]

REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _closed(layer: Layer) -> Layer:
    """The layer with every insert that helps. Three rounds are enough: a fourth insert would come back to a state it has seen."""
    for _ in range(3):
        for p, (cost, audit) in list(layer.items()):
            q, new = _NEXT[p, _ADDED[p]], (cost + INSERT, audit + "I")
            if q not in layer or new < layer[q]:
                layer[q] = new
    return layer


def advance(layer: Layer, symbols: Iterable[tuple[str, int]]) -> Layer:
    """The layer after runs of (symbol, times). A symbol is a role's initial (s, u, a, x for others, e for an empty role), upper
    case for a truncated turn, or d for a turn that must go. What all audits of a layer share is set aside now and then."""
    shared: list[str] = []
    for at, (symbol, times) in enumerate(symbols):
        if symbol == "d":  # deletes sort before inserts, so a run of them is one step
            layer = _closed({p: (c + DELETE * times, a + "D" * times) for p, (c, a) in layer.items()})
        else:
            for _ in range(times):
                more = TRUNCATED if symbol.isupper() else 0
                own = symbol.lower()
                new: Layer = {}
                for p, (c, a) in layer.items():
                    for q, edit in ((p, (c + DELETE, a + "D")), (p if own == "e" else _NEXT.get((p, own)), (c + more, a + "K")), (_NEXT[p, _ADDED[p]], (c + REROLE + more, a + "R"))):
                        if q is not None and (q not in new or edit < new[q]):
                            new[q] = edit
                layer = _closed(new)
        if at % 256 == 255:
            head = os.path.commonprefix([a for _, a in layer.values()])
            shared.append(head)
            layer = {p: (c, a[len(head) :]) for p, (c, a) in layer.items()}
    head = "".join(shared)
    return {p: (c, head + a) for p, (c, a) in layer.items()} if head else layer


def start() -> Layer:
    return _closed({0: (0, "")})


def chosen(layer: Layer) -> tuple[int, str]:
    return min(layer[p] for p in ENDS if p in layer)


@lru_cache(1 << 16)
def _solved(symbols: str) -> tuple[int, str]:
    return chosen(advance(start(), ((s, len(list(run))) for s, run in groupby(symbols))))


def replay(state: int, audit: str, turns: Iterable[tuple[str, str, str, int]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that the edits leave, from (symbol, role, text, times) of what they were made for."""
    letters = iter(audit)
    for symbol, role, text, times in turns:
        for _ in range(times):
            for edit in letters:
                if edit == "I":
                    added = _ADDED[state]
                    state = _NEXT[state, added]
                    yield "I", _NAMES[added], ""
                    continue
                if edit == "R":
                    added = _ADDED[state]
                    state = _NEXT[state, added]
                    yield "R", _NAMES[added], text
                elif edit == "K":
                    state = state if symbol.lower() == "e" else _NEXT[state, symbol.lower()]
                    yield "K", role, text
                break
    for _ in letters:  # inserts after the last turn
        added = _ADDED[state]
        state = _NEXT[state, added]
        yield "I", _NAMES[added], ""


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations with faults planted by crc32 of "conv_id:turn" modulo 20, for measuring repairs.

    0 drops a turn, 1 empties its text, 2 takes . ! ? out of it, 3 repeats it (same turn), 4 makes its role user. A null
    counts as one space, in the key too, but a null conv_id or turn stays null. A dialogue whose turns are all dropped
    keeps one row, with a null role and text: it has no turns.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", word("conv_id"), word("turn")).cast("binary")) % 20
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    kept = t.filter("kind != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")
    none = t.groupBy("conv_id").agg(F.count(F.when(F.col("kind") != 0, 1)).alias("n")).filter("n = 0")
    return kept.unionByName(none.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")))


def _coded(turns: DataFrame) -> DataFrame:
    """Turns with initial, fault (0, 1 blank, 3 truncated), and two 64-bit digests of role and text together."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    first = F.substring("role", 1, 1)
    initial = F.when(F.col("role") == "", F.lit("e")).when(first.isin("s", "u", "a"), first).otherwise(F.lit("x"))
    fault = F.when(end == "", F.lit(1)).when(F.right(end, F.lit(1)).isin(".", "!", "?"), F.lit(0)).otherwise(F.lit(3))
    return turns.select("conv_id", "turn", "role", "text", initial.alias("initial"), fault.alias("fault"), F.xxhash64(F.lit(1), "role", "text").alias("d1"), F.xxhash64(F.lit(2), "text", "role").alias("d2"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """(conv_id, rows) of each dialogue in a sorted stream; the rows of one dialogue at a time."""
    each = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, rows in groupby(each, key=lambda r: r[0]):
        yield key, list(rows)


def _tallied(rows: list[tuple[int | None, str, int, bool, int]]) -> tuple[list[int], list[tuple[str, int]]]:
    """[blank, duplicate, truncated, illegal] of sorted (turn, initial, fault, seen before, times), and their symbols in runs."""
    n, symbols, last = [0, 0, 0, 0], [], None
    for _, initial, fault, seen, times in rows:
        if fault == 1:
            n[0] += times
            symbols.append(("d", times))
        else:
            gone = times if seen else times - 1
            n[1] += gone
            if not seen:
                n[2] += fault == 3
                symbols.append((initial.upper() if fault == 3 else initial, 1))
            if gone:
                symbols.append(("d", gone))
        n[3] += (last is not None and (last, initial) not in _LEGAL) + (times - 1)  # no role may follow itself
        last = initial
    return n, symbols


def _gaps(turns: Iterable[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _short(turns: DataFrame, whole: bool) -> DataFrame:
    """Dialogues that fit a group: their report, or (whole) their repaired turns."""
    kind = turns.schema["conv_id"].dataType
    cols = ("conv_id", "turn", "role", "text", "initial", "fault", "d1", "d2")
    schema = f"conv_id {kind.simpleString()}, " + ("part int, seq long, edit string, role string, text string" if whole else ", ".join(f"{c} long" for c in REPORT) + ", audit string, repaired_sha256 string")
    arrow = lambda b: pa.array([], b.schema.field(0).type).type

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        key_type = arrow(first)

        def chained() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        made, size = [], 0

        def flush() -> pa.RecordBatch:
            types = [key_type, pa.int32(), pa.int64(), *[pa.string()] * 3] if whole else [key_type, *[pa.int64()] * len(REPORT), pa.string(), pa.string()]
            names = [x.split()[0] for x in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=names)

        for key, rows in _runs(chained()):
            seen: set[tuple[int, int]] = set()
            coded = []
            for _, turn, _, _, initial, fault, a, b in rows:
                coded.append((turn, initial, fault, (a, b) in seen, 1))
                seen.add((a, b))
            n, symbols = _tallied(coded)
            cost, audit = _solved("".join(s * k for s, k in symbols))
            left = replay(0, audit, ((s, r[2], r[3], 1) for (s, _), r in zip(symbols, rows, strict=True)))
            if whole:
                made += [(key, 0, i, *x) for i, x in enumerate(left)]
                size += sum(len(x[-1]) for x in made[-len(rows) :])
            else:
                text = "\n".join(f"{role}:{body}" for _, role, body in left)
                made.append((key, _gaps(r[1] for r in rows), *n, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
            if len(made) >= 4000 or size > PIECE_BYTES:
                yield flush()
                made, size = [], 0
        if made:
            yield flush()

    return turns.select(*cols).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "d1", "d2").mapInArrow(per_task, schema)


def _fits(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def _block(table: pa.Table) -> pa.Table:
    """A block's layers from all four states, its tallies, and what its neighbours need of it."""
    rows = sorted(zip(*(table[c].to_pylist() for c in ("turn", "role", "d1", "d2", "initial", "fault", "seen", "times")), strict=True), key=lambda r: (r[0] is not None, *(x if x is not None else 0 for x in r[:4])))
    n, symbols = _tallied([(r[0], *r[4:]) for r in rows])
    layers = [(p, q, cost, audit) for p in range(4) for q, (cost, audit) in advance({p: (0, "")}, symbols).items()]
    known = [r[0] for r in rows if r[0] is not None]
    one = {"conv_id": table["conv_id"][0], PART: table[PART][0], "n": n, "first": rows[0][4], "last": rows[-1][4], "least": min(known, default=None), "most": max(known, default=None), "turns": len(set(known))}
    out = {k: [v.as_py() if isinstance(v, pa.Scalar) else v] for k, v in one.items()}
    out["layers"] = [[{"p": p, "q": q, "cost": c, "audit": a} for p, q, c, a in layers]]
    return pa.table(out, schema=pa.schema([("conv_id", table.schema.field("conv_id").type), (PART, pa.int32()), ("n", pa.list_(pa.int64())), ("first", pa.string()), ("last", pa.string()), ("least", pa.int64()), ("most", pa.int64()), ("turns", pa.int64()),
                                           ("layers", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))]))


def _joined(table: pa.Table) -> pa.Table:
    """Of all blocks of a dialogue: a row with its report (block -1), and one a block with the state and edits it has."""
    blocks = sorted(table.to_pylist(), key=lambda b: b[PART])
    layer = {p: (cost, audit, ((p, audit),)) for p, (cost, audit) in start().items()}  # the last: (state at its end, edits) of each block
    n, least, most, turns, last = [0, 0, 0, 0], [], [], 0, None
    for b in blocks:
        new: dict[int, tuple] = {}
        for x in b["layers"]:
            if x["p"] in layer:
                cost, audit, path = layer[x["p"]]
                made = (cost + x["cost"], audit + x["audit"])
                if x["q"] not in new or made < new[x["q"]][:2]:
                    new[x["q"]] = (*made, (path, (x["q"], x["audit"])))
        layer = new
        n = [a + c for a, c in zip(n, b["n"], strict=True)]
        n[3] += last is not None and (last[0], b["first"]) not in _LEGAL
        turns += b["turns"] - (last is not None and last[1] is not None and last[1] == b["least"])
        last = (b["last"], b["most"])
        least += [b["least"]] if b["least"] is not None else []
        most += [b["most"]] if b["most"] is not None else []
    cost, audit, path = min(layer[p] for p in ENDS if p in layer)
    edits = []
    while len(path) == 2:
        path, own = path
        edits.append(own)
    edits.append(path[0])
    edits.reverse()
    gaps = max(most) - min(least) + 1 - turns if least else 0
    key = blocks[0]["conv_id"]
    rows = [(key, -1, 0, audit, gaps, *n, cost)]
    for i, b in enumerate(blocks):  # inserts before the first turn belong to the first block
        state, own = (0, edits[0][1] + edits[1][1]) if i == 0 else (edits[i][0], edits[i + 1][1])
        rows.append((key, b[PART], state, own, *[None] * 6))
    names = ["conv_id", PART, "state", "audit", *REPORT]
    types = [table.schema.field("conv_id").type, pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 6]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _edited(turns: pa.Table, plan: pa.Table, whole: bool) -> pa.Table:
    """A block's repaired turns, or (not whole) their lines in pieces."""
    rows = sorted(zip(*(turns[c].to_pylist() for c in ("turn", "role", "d1", "d2", "initial", "fault", "seen", "times", "text")), strict=True), key=lambda r: (r[0] is not None, *(x if x is not None else 0 for x in r[:4])))
    each = []
    for _, role, _, _, initial, fault, seen, times, text in rows:
        goes = fault == 1 or seen
        each.append(("d" if goes else initial, role, text, 1))
        if times > 1:
            each.append(("d", role, text, times - 1))
    left = replay(plan["state"][0].as_py(), plan["audit"][0].as_py(), each)
    key, part = turns["conv_id"][0].as_py(), turns[PART][0].as_py()
    head = [("conv_id", turns.schema.field("conv_id").type), ("part", pa.int32()), ("seq", pa.int64())]
    if whole:
        made = [(key, part, i, *x) for i, x in enumerate(left)]
        kinds = [*head, ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
    else:
        made, lines, size = [], [], 0
        for _, role, text in left:
            lines.append(f"{role}:{text}".encode())
            size += len(lines[-1])
            if size >= PIECE_BYTES:
                made.append((key, part, len(made), b"\n".join(lines)))
                lines, size = [], 0
        if lines:
            made.append((key, part, len(made), b"\n".join(lines)))
        kinds = [*head, ("piece", pa.binary())]
    cols = list(zip(*made, strict=True)) or [[]] * len(kinds)
    return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])


def _digests(pieces: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of pieces in order. A digest of a whole text is sequential: a task streams a dialogue's pieces, and holds one."""
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, key, digest, kind = False, None, None, None
        for b in batches:
            kind = b.schema.field(0).type
            for k, piece in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if known and k == key:
                    digest.update(b"\n")
                else:
                    if known:
                        yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])
                    known, key, digest = True, k, hashlib.sha256()
                digest.update(piece.as_buffer())
        if known:
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").select("conv_id", "piece")
    return ordered.mapInArrow(per_task, f"conv_id {kind}, repaired_sha256 string")


def _long(turns: DataFrame, folder: str, whole: bool) -> DataFrame:
    """Dialogues of any length, in blocks by range of their turns. Equal turns are one row with a count, so that no number of copies fills a block."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    once = turns.groupBy("conv_id", "turn", "role", "d1", "d2", "initial", "fault").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
    once = stored(once, f"{folder}/once")
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = once.groupBy("conv_id", "d1", "d2").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv_id").alias("_c"), F.col("d1").alias("_a"), F.col("d2").alias("_b"), "first")
    again = stored(again, f"{folder}/again")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("d1") == F.col("_a")) & (F.col("d2") == F.col("_b"))
    marked = once.join(_fits(again), same, "left").withColumn("seen", F.coalesce(F.col("first") < at, F.lit(False))).drop("_c", "_a", "_b", "first")
    cut = parts(marked, ["conv_id"], ["turn", "role", "d1", "d2"])
    layers = cut.drop("text").groupBy("conv_id", PART).applyInArrow(_block, f"conv_id {kind}, {PART} int, n array<long>, first string, last string, least long, most long, turns long, layers array<struct<p:int,q:int,cost:long,audit:string>>")
    plan = stored(layers.groupBy("conv_id").applyInArrow(_joined, f"conv_id {kind}, {PART} int, state int, audit string, " + ", ".join(f"{c} long" for c in REPORT)), f"{folder}/plan")
    schema = f"conv_id {kind}, part int, seq long, " + ("edit string, role string, text string" if whole else "piece binary")
    edited = cut.groupBy("conv_id", PART).cogroup(plan.filter(F.col(PART) >= 0).groupBy("conv_id", PART)).applyInArrow(lambda a, b: _edited(a, b, whole), schema)
    if whole:
        return edited
    digests = _digests(edited).select(F.col("conv_id").alias("_c"), "repaired_sha256")
    report = plan.filter(F.col(PART) < 0).join(digests, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    return report.select("conv_id", *REPORT, "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def _solve(spark: SparkSession, turns: DataFrame, whole: bool, long_turns: int) -> DataFrame:
    small_batches(spark)
    folder = shared_dir(spark)
    turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    there = turns.filter(F.col("role").isNotNull() | F.col("text").isNotNull()).select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    sizes = turns.groupBy("conv_id").agg(F.count(F.coalesce("role", "text")).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    sizes = stored(sizes, f"{folder}/sizes")
    long = sizes.filter((F.col("n") > long_turns) | (F.col("bytes") > LONG_BYTES)).select(F.col("conv_id").alias("_c"))
    coded = _coded(there)
    if long.isEmpty():
        out = _short(coded, whole)
    else:
        long = _fits(long)
        same: Column = F.col("conv_id").eqNullSafe(F.col("_c"))
        out = _short(coded.join(long, same, "left_anti"), whole).unionByName(_long(coded.join(long, same, "left_semi"), folder, whole))
    if whole:
        return out
    zero = [F.lit(0).cast("long").alias(c) for c in REPORT]
    return out.unionByName(sizes.filter("n = 0").select("conv_id", *zero, F.lit("").alias("audit"), F.sha2(F.lit(b""), 256).alias("repaired_sha256")))


def report(spark: SparkSession, turns: DataFrame, long_turns: int = LONG_TURNS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every dialogue.

    Turns come by turn, nulls first, then by role and a hash of role and text. A turn's first fault counts: blank (only blanks),
    duplicate (role and text seen earlier in the dialogue), truncated (the last character that is no blank is not . ! or ?).
    illegal: neighbours whose initials are not su, ua or au; gaps: turn numbers missing between the least and the largest.
    Keeping is free, a new role costs 3, deleting 4 (a must for blank and duplicate turns), an empty turn of a user or an
    assistant 3, a truncated turn that stays 3; of equal costs the audit that sorts first is taken. A null role or text is
    one space, a row with neither is no turn but names its dialogue, which then has zeros; an empty role has no initial, so
    it is kept anywhere; a null conv_id is a dialogue of its own; repeated rows are turns of their own; an empty table gives
    no row. Other columns are not read.
    """
    return _solve(spark, turns, False, long_turns)


def repaired(spark: SparkSession, turns: DataFrame, long_turns: int = LONG_TURNS) -> DataFrame:
    """conv_id, part, seq, edit, role, text: the turns that the edits of report leave, in order of part and seq."""
    return _solve(spark, turns, True, long_turns)
