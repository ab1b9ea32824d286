import random
import re

from townledger.llm import licenses as L
from townledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    """The base columns and the notices' labels by a loop over all words and phrases."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = lambda p: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    base = [(i, x) for p, x in L.BASE.items() for i in at(p)]
    more = {x for p, x in L.NOTICES.items() if at(p)}
    starts = [i for i, _ in base]
    return len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), {x for _, x in base} | more


def test_query_equals_a_loop(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op12_license_scan"](spark, SF).collect()
    assert len(got) == len(docs) and sum(r["n_base"] > 0 for r in got) > 10
    for r in got:
        *base, labels = plain(docs[r["doc_id"]])
        assert [r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]] == base
        assert r["labels"] == ",".join(sorted(labels))
        assert r["score"] == min((L.FREEDOM[x] for x in labels), default=0.0)


def tree(r, depth=3):
    """A random expression, its freedom and its labels, from the tree it is made of."""
    ids = {"MIT": "mit", "Apache-2.0": "apache", "GPL-2.0-only": "gpl", "LGPL-3.0-or-later": "lgpl", "BSD-3-Clause": "bsd", "CC-BY-NC-4.0": "cc-by-nc", "CC-BY-SA-4.0": "cc-by-sa", "AGPL-3.0+": "agpl", "Odd-1": "other", "MPL-2.0": "mpl"}
    if not depth or r.random() < 0.3:
        name = r.choice(sorted(ids))
        if r.random() < 0.2:
            return f"{name} {r.choice(['WITH', 'with'])} Classpath-exception-2.0", max(L.FREEDOM[ids[name]], L.EXCEPTED), {ids[name]}, 3
        return name, L.FREEDOM[ids[name]], {ids[name]}, 3
    op, binds, f = r.choice([("OR", 1, max), ("AND", 2, min)])
    sides = [tree(r, depth - 1) for _ in range(2)]
    texts = [f"({s[0]})" if s[3] < binds or r.random() < 0.2 and " with " not in s[0].lower() else s[0] for s in sides]
    return f"{texts[0]} {op if r.random() < 0.7 else op.lower()} {texts[1]}", f(sides[0][1], sides[1][1]), sides[0][2] | sides[1][2], binds


def test_expressions_equal_their_trees():
    r = random.Random(5)
    for _ in range(500):
        text, score, labels, _ = tree(r)
        assert L.value(": " + text) == (text, score, labels)
        assert L.value(f': "{text}" and more') [1:] == (score, labels)


def test_where_expressions_end():
    assert L.value(": MIT This file is free")[0] == "MIT"
    assert L.value(": (MIT OR GPL-2.0")[1:] == (1.0, {"mit", "gpl"})
    assert L.value(": MIT AND") == ("MIT", 1.0, {"mit"})
    assert L.value(": MIT AND (") == ("MIT", 1.0, {"mit"})
    assert L.value(": AND MIT") == L.value("") == L.value(" : ()") == ("", 0.0, frozenset())
    assert L.value(": GPL-2.0 WITH (MIT)")[0] == "GPL-2.0"
    assert L.value(" MIT) OR GPL-2.0")[0] == "MIT"
    assert L.value(": Apache-2.0. */")[0] == "Apache-2.0"
    assert L.value(": " + "(" * 50_000 + "MIT" + ")" * 50_000)[1] == 1.0


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = L.scan(odd).collect()
    assert len(got) == len(rows) and L.scan(none).count() == 0
    assert sorted((r["text"] or "", r["n_words"]) for r in got) == sorted((t or "", plain(t)[0]) for _, t in rows)
    assert all(r["queue"] in ("x", None) for r in got)
    texts = ["MIT Licensed under the mit LICENSE, cc-by-nc 4.0\ncc by", "x " * 50_000 + "Apache License", "license-expression = 'CC-BY-NC-4.0 OR MIT'", "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND CC-BY-SA-4.0\nmit", "gnu general public license " * 3, "apache\nlicense", "mit", "license", None]
    out = L.scan(spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id int, text string, labels string").coalesce(1)).orderBy("doc_id").collect()
    for r, t in zip(out, texts, strict=True):
        assert [r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")] == list(plain(t)[:5])
    assert [r["labels"] for r in out] == ["cc-by,cc-by-nc,mit", "apache", "cc-by,cc-by-nc,mit", "cc-by,cc-by-sa,gpl,mit", "gpl", "apache", "", "", ""]
    assert [r["score"] for r in out] == [0.2, 1.0, 1.0, 0.5, 0.4, 1.0, 0.0, 0.0, 0.0]
    assert out[3]["expressions"][0]["expression"] == "(MIT OR GPL-2.0-only) AND CC-BY-SA-4.0"
