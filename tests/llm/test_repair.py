import hashlib
import heapq
import random
import re
import zlib

import pytest

from townledger.llm import repair as R
from townledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, audit string, part int"
EMPTY = hashlib.sha256(b"").hexdigest()


def damaged(rows):
    """conversation -> damaged turns (turn, role, text), by a loop."""
    out = {}
    for c, t, role, text in rows:
        word = lambda x: " " if x is None else str(x)
        role, text = word(role), word(text)
        kind = zlib.crc32(f"{word(c)}:{word(t)}".encode()) % 20
        own = out.setdefault(c, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(t, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return out


def faults(turns):
    seen, kinds = set(), []
    for _, role, text in turns:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return kinds


def searched(turns):
    """The least (cost, audit) and its turns by a best-first search over whole edit lists and the role pattern as a prefix test."""
    kinds = faults(turns)
    ok = lambda s: re.fullmatch(r"(s?(ua)*u?)?", s)
    heap, done = [(0, "", 0, "", ())], set()
    best = None
    while heap:
        cost, audit, i, initials, left = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if (i, initials[-1:], len(initials) > 0, cost, audit) in done:
            continue
        done.add((i, initials[-1:], len(initials) > 0, cost, audit))
        if i == len(turns) and re.fullmatch(r"(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, left)
        steps = [("I", 3, r[0], (r, "")) for r in ("user", "assistant")]
        if i < len(turns):
            _, role, text = turns[i]
            more = 3 * (kinds[i] == "truncated")
            steps.append(("D", 4, "", None))
            if kinds[i] not in ("blank", "duplicate"):
                steps += [("K", more, role[:1], (role, text))] + [("R", 3 + more, r[0], (r, text)) for r in ("user", "assistant")]
        for letter, price, initial, turn in steps:
            if ok(initials + initial):
                heapq.heappush(heap, (cost + price, audit + letter, i + (letter != "I"), initials + initial, left + ((turn,) if turn else ())))
    return best


def plain(turns):
    kinds, initials = faults(turns), [r[:1] for _, r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    cost, audit, left = searched(turns)
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())


def order(own):
    return sorted(own, key=lambda r: (r[0] is not None, r[0] or 0))


def test_query_equals_a_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: plain(order(own)) for c, own in damaged(rows).items()}
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in QUERIES["op13_conversation_repair"](spark, SF).collect()}
    assert got == want and sum(w[5] > 0 for w in want.values()) > 20


def odd_turns(seed, n, convs, texts=("Yes.", "No!", "cut off", "", " \n", "Why?", None)):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        c = r.choice(convs)
        t = r.choice([None, *range(12)])
        rows.append((c, t, r.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), r.choice(texts), "x", 1))
    return list({(x[0], x[1]): x for x in rows}.values())  # one row a turn, so that the order is given


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("long_turns", [4096, 2])
def test_odd_conversations_equal_a_search(spark, seed, long_turns):
    """Long ones too: with two turns as the bound, and one row a partition, every dialogue is cut into blocks."""
    rows = odd_turns(seed, 150, [None, *range(25)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        want = {c: plain(order(own)) for c, own in damaged([r[:4] for r in rows]).items()}
        got = {r["conv_id"]: tuple(r)[1:] for r in R.report(spark, R.damage(df), long_turns).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
        assert got == want
        left = {}
        for r in sorted(R.repaired(spark, R.damage(df), long_turns).collect(), key=lambda r: (r["part"], r["seq"])):
            left.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        assert {c: hashlib.sha256("\n".join(left.get(c, [])).encode()).hexdigest() for c in want} == {c: w[-1] for c, w in want.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ties_copies_and_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert R.report(spark, R.damage(none)).count() == R.repaired(spark, none).count() == 0
    rows = [(1, 5, "user", "Same.", "x", 1)] * 400 + [(1, 6, "assistant", "Same.", "x", 1)] * 3 + [(2, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for bound in (4096, 10):
        got = {r["conv_id"]: r for r in R.report(spark, df, bound).collect()}
        one = got[1]
        assert (one["duplicate"], one["illegal"], one["gaps"], one["cost"], one["audit"]) == (401, 401, 0, 4 * 401, "K" + "D" * 399 + "K" + "DD")
        assert one["repaired_sha256"] == hashlib.sha256(b"user:Same.\nassistant:Same.").hexdigest()
        assert got[2]["audit"] == "" and got[2]["repaired_sha256"] == EMPTY


def test_long_dialogues_are_the_same_in_blocks(spark):
    r = random.Random(9)
    rows = [(7, t, r.choice(["user", "assistant", "assistant", "user", "system", "bot"]), f"{t % 700} is said" + r.choice([".", "!", "", "?"]), "x", 1) for t in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert R.report(spark, df).collect() == R.report(spark, df, 100).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
