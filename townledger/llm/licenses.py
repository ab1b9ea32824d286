"""Licence scans: Aho-Corasick over words finds notices and identifier tags, a shunting-yard parser values the tags' expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from townledger.llm.common import ALNUM, small_batches, text_chunks, words

# Phrases of notices and the label of each; the first four are the base ones.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu library general public license": "lgpl", "gnu affero general public license": "agpl",
    "mozilla public license": "mpl", "eclipse public license": "epl", "isc license": "isc", "bsd license": "bsd", "zlib license": "zlib", "boost software license": "boost",
    "redistribution and use in source and binary forms": "bsd", "permission is hereby granted free of charge": "mit", "the unlicense": "unlicense",
    "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc", "cc by nc nd": "cc-by-nc", "cc0": "cc0",
    "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution noncommercial": "cc-by-nc",
    "public domain": "public-domain", "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx license identifier", "license expression")
# How freely a text under a licence may be used, from 0 to 1.
FREEDOM = {
    "public-domain": 1.0, "cc0": 1.0, "unlicense": 1.0, "mit": 1.0, "isc": 1.0, "bsd": 1.0, "zlib": 1.0, "boost": 1.0, "apache": 1.0, "cc-by": 0.9,
    "mpl": 0.6, "epl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.5, "other": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "all-rights-reserved": 0.1,
}
#: What an exception (`with`) lifts a licence to at least.
EXCEPTED = 0.6

PLACE = "array<struct<label:string,word:long,n_words:int>>"
VALUED = "array<struct<word:long,expression:string,score:double>>"
_BINDS = {"OR": 1, "AND": 2, "WITH": 3}
_WORD = re.compile(r"[0-9A-Za-z]+")
_LEAD = re.compile(r"[\"']?[ \t]*[:=]?[ \t]*[\"']?[ \t]*")
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")


def family(identifier: str) -> str:
    """The label of a licence identifier, whatever its version: Apache-2.0 is apache, LGPL-3.0-or-later is lgpl; "other" if unknown."""
    name = identifier.lower().rstrip(".")
    if name == "bsl-1.0":
        return "boost"
    for label in sorted(FREEDOM, key=len, reverse=True):
        if name == label or name.startswith((f"{label}-", f"{label}+")) or name == "0bsd" and label == "bsd":
            return label
    return "other"


def _joined(op: str, a: tuple[float, frozenset], b: tuple[float, frozenset]) -> tuple[float, frozenset]:
    if op == "WITH":
        return max(a[0], EXCEPTED), a[1]
    return (max if op == "OR" else min)(a[0], b[0]), a[1] | b[1]


def value(text: str) -> tuple[str, float, frozenset]:
    """(expression, score, labels) of the licence expression that a text begins with; ("", 0, none) if it begins with none.

    A shunting-yard: operands and operators on two stacks, `with` before `and` before `or`, from left to right. `or` leaves
    the freer licence, `and` the stricter one, `with` an exception. The expression ends where its grammar does: before a second
    operand in a row, a bracket that closes nothing, an operator without a right side; brackets left open close at the end.
    """
    operands: list[tuple[float, frozenset]] = []
    operators: list[str] = []

    def reduce() -> None:
        b = operands.pop()
        operands.append(_joined(operators.pop(), operands.pop(), b))

    at = _LEAD.match(text).end()
    began, end, opened, due = at, at, 0, True  # due: an operand comes next
    pending: list[tuple[str, list[str]]] = []  # what came after the last operand and counts only if one follows
    exception = False
    while m := _TOKEN.match(text, at):
        token = m[1]
        op = token.upper()
        if token == "(":
            if not due or exception:
                break
            pending.append((token, []))
        elif token == ")":
            if due or not opened:
                break
            while operators[-1] != "(":
                reduce()
            operators.pop()
            opened -= 1
            end = m.end()
        elif op in _BINDS:
            if due or op == "WITH" and text[:at].endswith(")"):
                break
            pending.append((op, []))
            due, exception = True, op == "WITH"
        else:
            if not due:
                break
            for held, _ in pending:
                while held != "(" and operators and operators[-1] != "(" and _BINDS[operators[-1]] >= _BINDS[held]:
                    reduce()
                operators.append(held)
                opened += held == "("
            pending.clear()
            label = family(token)
            operands.append((0.0, frozenset()) if exception else (FREEDOM[label], frozenset([label])))
            due, exception, end = False, False, m.start(1) + len(token.rstrip(".:-"))
        at = m.end()
    while operators:
        if operators[-1] == "(":
            operators.pop()
        else:
            reduce()
    return (text[began:end], *operands[0]) if operands else ("", 0.0, frozenset())


@dataclass(frozen=True)
class Rules:
    base: Mapping[str, str]
    notices: Mapping[str, str]
    tags: tuple[str, ...]

    def key(self) -> tuple:
        return tuple(self.base.items()), tuple(self.notices.items()), self.tags


@lru_cache(4)
def _machine(key: tuple) -> tuple[ahocorasick.Automaton, np.ndarray, np.ndarray]:
    """The automaton over word numbers, and the words' hashes (sorted) with their numbers. Values are lists of (kind, label, words)."""
    kinds = [(p, 0, x) for p, x in key[0]] + [(p, 1, x) for p, x in key[1]] + [(p, 2, "") for p in key[2]]
    data = [p.encode() for p, _, _ in kinds]
    h, _, _, first = words(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in data])]).astype(np.int64), ALNUM)
    vocabulary, ids = np.unique(h, return_inverse=True)
    at: dict[tuple, list] = {}
    for i, (_, kind, label) in enumerate(kinds):
        seq = tuple((ids[first[i] : first[i + 1]] + 1).tolist())
        if not seq:
            raise ValueError("a phrase has no word")
        at.setdefault(seq, []).append((kind, label, len(seq)))
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for seq, values in at.items():
        machine.add_word(seq, values)
    machine.make_automaton()
    return machine, vocabulary, np.arange(1, len(vocabulary) + 1)


def _places(h: np.ndarray, first: np.ndarray, key: tuple) -> Iterator[tuple[int, int, int, str, int]]:
    """(document, word, kind, label, words) of every place of every phrase in a chunk; only words of some phrase go through the automaton."""
    machine, vocabulary, numbers = _machine(key)
    near = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    some = np.flatnonzero(vocabulary[near] == h)
    if not len(some):
        return
    doc = np.searchsorted(first, some, side="right") - 1
    apart = np.concatenate([[0], np.cumsum((some[1:] != some[:-1] + 1) | (doc[1:] != doc[:-1]))])
    at = np.arange(len(some)) + apart  # a 0, which no phrase has, stands between words that do not follow each other
    seq = np.zeros(at[-1] + 1, np.int64)
    seq[at] = numbers[near[some]]
    word, own = np.zeros(len(seq), np.int64), np.zeros(len(seq), np.int64)
    word[at], own[at] = some, doc
    for end, values in machine.iter(tuple(seq.tolist())):
        for kind, label, n in values:
            yield int(own[end]), int(word[end]) - n + 1, kind, label, n


def scan(docs: DataFrame, text: str = "text", without: tuple[str, ...] = (), base: Mapping[str, str] = BASE, notices: Mapping[str, str] = NOTICES, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """Every document, but for the columns without, and what its whole text says of licences.

    n_words; n_base, first_word, last_word: how many places base phrases have, and the smallest and largest word they start at
    (null without one); base_labels and labels: distinct, sorted, joined by commas, labels with those of all notices and tags;
    notices: every place (label, word, n_words); expressions: what stands after each tag, with its score; score: the least
    freedom of all expressions and of the notices outside of them, 0 if there is none. A null text is empty, an empty one has no words and empty
    labels; repeated rows are each scanned; columns of these names are replaced.
    """
    made = [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double"), ("notices", PLACE), ("expressions", VALUED)]
    keep = [c for c in docs.columns if c not in dict(made) or c == text]
    small_batches(docs.sparkSession)
    returned = [f for f in docs.select(*(f"`{c}`" for c in keep)).schema.fields if f.name not in without and f.name not in dict(made)]
    back = [keep.index(f.name) for f in returned]
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in returned), *(f"{n} {k}" for n, k in made)])
    key = Rules(base, notices, tags).key()
    place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int32())]))
    valued = pa.list_(pa.struct([("word", pa.int64()), ("expression", pa.string()), ("score", pa.float64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), place, valued]

    def one(n: int, found: list[tuple[int, int, str, int]], tail) -> tuple:
        own = [(w, x) for w, kind, x, _ in found if kind == 0]
        seen = [{"label": x, "word": w, "n_words": k} for w, kind, x, k in found if kind < 2]
        exprs, spans, labels = [], [], {x["label"] for x in seen}
        for w, kind, _, k in found:
            if kind == 2:
                expression, score, names = value(tail(w + k - 1))
                if names:
                    exprs.append({"word": w, "expression": expression, "score": score})
                    labels |= names
                    spans.append((w, w + k + len(_WORD.findall(expression))))
        noticed = [x["label"] for x in seen if not any(a <= x["word"] < b for a, b in spans)]
        score = min([FREEDOM.get(x, FREEDOM["other"]) for x in noticed] + [x["score"] for x in exprs], default=0.0)
        starts = [w for w, _ in own]
        return n, len(own), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in own})), ",".join(sorted(labels)), score, seen, exprs

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lo, hi, data, offs in text_chunks(batch, text):
                h, start, length, first = words(data, offs, ALNUM)
                found: list[list] = [[] for _ in range(hi - lo)]
                for doc, w, *rest in _places(h, first, key):
                    found[doc].append((w - int(first[doc]), *rest))
                for i, own in enumerate(found):

                    def tail(w: int, i: int = i) -> str:
                        """What stands behind a word, up to the end of its line."""
                        a = int(start[first[i] + w] + length[first[i] + w])
                        line = data[a : offs[i + 1]].tobytes() if offs[i + 1] - a < 4096 else data[a : a + int(np.argmax(np.append(data[a : offs[i + 1]] == 10, True)))].tobytes()
                        return line.split(b"\n", 1)[0].decode("utf-8", "replace")

                    rows.append(one(int(first[i + 1] - first[i]), own, tail))
            cols = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in back), *cols], names=[*(batch.schema.names[i] for i in back), *(n for n, _ in made)])

    return docs.select(*(f"`{c}`" for c in keep)).mapInArrow(per_batch, out)
