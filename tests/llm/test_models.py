import html
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from townledger.llm import chat, htmltext, langid, sharding, toxicity
from townledger.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(spark, docs).filter("held_out").collect()
    assert len(got) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and 0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(spark, odd, none):
    got = langid.identify(spark, odd).collect()
    assert len(got) == odd.count()
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and r["queue"] in ("x", None)
    assert langid.identify(spark, none).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(spark, none)).collect()} == {"und"}


def test_language_counts_equal_a_loop():
    data = [t.encode() for t in ("Ab c", "", "é9z")]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    points, at, letters = langid._chars(np.frombuffer(b"".join(data), np.uint8), offs)
    assert letters.tolist() == [3, 0, 2] and at.tolist() == [0, 4, 4, 7]
    n = [int(ok.sum()) for _, ok in langid._grams(points, at, 1 << 16)]
    texts = ["ab c", "", "é z"]
    want = [sum(1 for t in texts for i in range(len(t) - k + 1) if t[i] != " " or t[i + k - 1] != " ") for k in (1, 2, 3)]
    assert n == want


def test_language_scores_equal_a_loop(spark, odd):
    """Posteriors from dictionaries, for few and for many languages, in one block and in several."""
    s = langid.Settings(buckets=1 << 10, block=7)
    r = random.Random(2)
    rows = [(i, "".join(r.choice("abcdé ") for _ in range(r.randint(1, 40))), f"l{r.randint(0, 24):02d}") for i in range(400)] + [(900, None, "l03"), (901, "9 9", "l04"), (902, "ab", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)

    def grams(text):
        data = (text or "").encode()
        points, at, letters = langid._chars(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        return ([int(b) for bucket, ok in langid._grams(points, at, s.buckets) for b in bucket[ok]] if data else []), bool(data and letters[0])

    seen, docs = {}, {}
    for _, t, x in rows:
        if x:
            docs[x] = docs.get(x, 0) + 1
            for b in grams(t)[0]:
                seen.setdefault(x, {})[b] = seen.setdefault(x, {}).get(b, 0) + 1
    names = sorted(docs)
    want = {}
    for i, t, _ in rows:
        g, letters = grams(t)
        z = {}
        for x in names:
            own = seen.get(x, {})
            size = np.log(sum(own.values()) + s.alpha * s.buckets)
            z[x] = np.log(docs[x] / sum(docs.values())) + sum(np.log(own.get(b, 0) + s.alpha) - size for b in g) * min(1, s.evidence / max(1, len(g)))
        top = max(z, key=z.get)
        want[i] = (top, 1 / sum(np.exp(v - z[top]) for v in z.values())) if letters else ("und", 0.0)
    for settings in (s, langid.Settings(buckets=1 << 10)):
        got = langid.predict(df, langid.fit(spark, df, settings=settings), settings=settings, without=("text",)).collect()
        assert len(got) == len(rows)
        for x in got:
            assert x["lang_pred"] == want[x["doc_id"]][0] and abs(x["score"] - want[x["doc_id"]][1]) < 1e-4


def toxic_corpus(seed=0, n=400):
    r = random.Random(seed)
    plain = ["".join(r.choice(["ba", "do", "ki", "lu", "me", "no"]) for _ in range(r.randint(1, 4))) for _ in range(600)]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(plain) for _ in range(r.randint(5, 200))]
        y = int(i % 5 == 1 or i % 9 == 2)
        if y:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randrange(len(w)), "zwurgh" + r.choice(["el", "ik", "onda", "us", "at", "erox", "y"]))
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    return rows, labels


def test_toxicity_of_unseen_spellings(spark):
    rows, labels = toxic_corpus()
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(spark, docs, lab)
    fresh = spark.createDataFrame([(1, "ba do ki zwurghali noba"), (2, "ba do ki luba noba"), (3, "Zwurghonda"), (4, None), (5, ""), (6, "bado " * 30000)], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.predict(fresh, model).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0}
    held = {r["doc_id"]: r for r in toxicity.score(spark, docs, lab).filter("held_out").collect()}
    y = dict(labels)
    assert np.mean([r["predicted"] == y[i] for i, r in held.items()]) > 0.97 and all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held)


def test_toxicity_training_holds_few_arrays(spark, monkeypatch):
    """Training holds two numbers for each subword of a distinct word and little more, and its sums are those of bincount."""
    r = random.Random(5)
    parts = ["".join(r.choice("abdeiklmnorstuz") for _ in range(3)) for _ in range(60)]
    rows = [(i, " ".join("".join(r.choices(parts, k=5)) for _ in range(300)), i % 2) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    toxicity.fit(docs)
    tracemalloc.start()
    try:
        toxicity.fit(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    words = {w for _, text, _ in rows for w in text.split()}
    subwords = sum(3 * len(w) - 2 for w in words)
    assert len(words) > 50_000 and peak < 30 * subwords
    at, values = np.array([r.randrange(50) for _ in range(1000)], np.int32), np.array([r.gauss(0, 1) for _ in range(1000)])
    monkeypatch.setattr(toxicity, "SUMMED", 7)
    assert (toxicity._sums(at, lambda a: values[a], 60) == np.bincount(at, values, 60)).all()


def test_toxicity_of_odd_rows(spark, odd, none):
    lab = spark.createDataFrame([(i, i % 2) for i in range(6, 16)] + [(None, 1), (3, None), (9999, 1), (6, 0)], "doc_id long, toxic int")
    got = toxicity.score(spark, odd, lab).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.score(spark, none, lab).count() == 0
    assert toxicity.score(spark, odd, lab.limit(0)).count() == odd.count()


def test_shards_by_rendezvous(spark, odd, none):
    rows = sharding.shard_documents(odd, 7).collect()
    assert len(rows) == odd.count() and all(r["law"] == "key" and (r["grown_shard"] in (r["shard"], 7)) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert by and 0 <= r["shard"] < 7
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    text = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in rows:
        if r["doc_id"] is not None:
            assert r["size"] == len(text[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
    assert sharding.shard_documents(none).count() == 0


def test_shards_follow_weights(spark):
    keys = spark.range(30_000)
    got = {r["s"]: r["n"] for r in keys.groupBy(sharding.rendezvous(F.col("id"), [1.0, 2.0, 0.0, 3.0]).alias("s")).agg(F.count("*").alias("n")).collect()}
    assert 2 not in got and abs(got[0] / 5000 - 1) < 0.06 and abs(got[1] / 10000 - 1) < 0.05 and abs(got[3] / 15000 - 1) < 0.05


def test_numbers_are_gapless_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 50)
    rows = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    got = sharding.numbered(rows, "g", ["id"], 1000).collect()
    for g in range(3):
        assert sorted(r["slot"] for r in got if r["g"] == g) == list(range(sum(r["g"] == g for r in got)))


TURNS = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi 😀"), (1, 2, "bob", "Hello"), (1, 3, "ann", None), (2, 0, None, "who?"), (2, None, "x", "first"), (3, 0, "system", "alone"), (None, 1, "ann", "lost"), (1, 1, "ann", "Hi 😀")]


def test_perspectives(spark):
    turns = spark.createDataFrame([(*t, "z") for t in TURNS], "conv_id long, turn long, role string, text string, perspective string")
    rows = {(r["conv_id"], r["perspective"]): r for r in chat.rotate_perspectives(turns).collect()}
    assert set(rows) == {(1, "ann"), (1, "bob"), (2, "unknown"), (2, "x"), (None, "ann")}
    r = rows[1, "bob"]
    assert r["text"] == "<|system|>\nBe kind.<|end|>\n" + "<|user:ann|>\nHi 😀<|end|>\n" * 2 + "<|assistant|>\nHello<|end|>\n<|user:ann|>\n<|end|>\n"
    assert [r["text"][s["start"] : s["end"]] for s in r["loss_spans"]] == ["Hello<|end|>"]
    assert [rows[1, "ann"]["text"][s["start"] : s["end"]] for s in rows[1, "ann"]["loss_spans"]] == ["Hi 😀<|end|>", "Hi 😀<|end|>", "<|end|>"]
    whole = "".join(x["text"] for x in sorted(chat.rotate_perspectives(turns).filter("conv_id = 2 and perspective = 'x'").collect(), key=lambda x: x["part"]))
    assert whole == "<|assistant|>\nfirst<|end|>\n<|user:unknown|>\nwho?<|end|>\n"
    assert chat.rotate_perspectives(turns.limit(0)).count() == 0


def test_long_dialogues_come_in_parts(spark):
    turns = spark.range(500).select(F.lit(5).alias("conv_id"), F.when(F.col("id") < 100, F.lit(0)).otherwise(F.col("id")).alias("turn"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    rows = sorted(chat.rotate_perspectives(turns, part_turns=16).filter("perspective = 'a'").collect(), key=lambda r: r["part"])
    assert [r["part"] for r in rows] == list(range(len(rows))) and len(rows) > 20 and sum(r["n_turns"] for r in rows) == 500
    at = 0
    for r in rows:
        assert r["char_start"] == at
        at += len(r["text"])
    assert len(re.findall(r"t\d+<", "".join(r["text"] for r in rows))) == 500


def test_perspectives_equal_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = c.execute(ORACLES["op1_perspective_rotation"]).df()
    got = QUERIES["op1_perspective_rotation"](spark, SF).toPandas()[list(want.columns)]
    key = ["conv_id", "perspective", "part"]
    a, b = got.sort_values(key).values.tolist(), want.sort_values(key).values.tolist()
    assert a == b


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav><!-- c --><div class="ad">Buy now, it is cheap.</div>
<article><h1>A  title &amp more</h1><p><b>First para, with some words in it. And more of them, as it goes.<br><p>Second&nbsp; para &lt;here&gt;, also long enough to be read by anyone.</p></article>
<div id="comments"><h3>Comments</h3><div class="comment"><p>I liked it a lot, thank you. Really.</p></div></div><aside class="sidebar"><ul><li><a href="/q">Other</a></li></ul></aside><form><input><button>Send</button></form><footer>&copy; x. All rights.</footer></body></html>"""


def test_article_of_a_page(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "z"), (2, None, None, None), (3, "u", "", "z"), (4, "u", "<div>" * 3000 + "deep", "z"), (None, "u", "plain text < 3 & more", "z"), (6, "u", PAGE[:-40], "z")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in htmltext.extract(spark, pages).collect()}
    want = "A title & more\nFirst para, with some words in it. And more of them, as it goes.\nSecond para <here>, also long enough to be read by anyone."
    assert got[1]["text"] == want == got[6]["text"] and got[1]["n_chars"] == len(want)
    assert got[2]["text"] == got[3]["text"] == "" and len(got) == 6
    assert htmltext.extract(spark, pages.limit(0)).count() == 0


def test_articles_of_the_test_pages(spark):
    for r, p in zip(htmltext.extract(spark, spark.read.parquet(f"{SF}/pages.parquet")).orderBy("page_id").collect(), spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()):
        art = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", art))
        assert r["text"] == "\n".join(x for x in parts if x)


def test_marginals_equal_enumeration():
    model = htmltext.trained()
    page = htmltext.Page("<div class=menu><a>x</a></div><article><p>y, z.</p></article>")
    kinds, looks = htmltext.features(page)
    n = len(page.tags)
    up = np.array([sum(model.look[htmltext._bucket(x)] * htmltext.LOOK_WEIGHTS[x[0]] for x in own) for own in looks])
    total = np.zeros((n, 3))
    for code in range(3**n):
        s = [code // 3**i % 3 for i in range(n)]
        w = model.root[s[0]] + sum(up[i, s[i]] for i in range(n)) + sum(model.pair[kinds[i], s[page.parent[i]], s[i]] for i in range(1, n))
        total[range(n), s] += np.exp(w)
    assert np.allclose(model.marginals([page])[0], total / total.sum(1, keepdims=True))


def test_content_of_held_out_layouts():
    pages = htmltext.labelled_pages(80, seed=99)
    good = found = real = 0
    for page, states in pages:
        p = htmltext.trained().marginals([page])[0][:, htmltext.CONTENT] >= 0.5
        for block in page.blocks:
            for node, raw in block:
                k = len(raw.strip())
                real += k * (states[node] == htmltext.CONTENT)
                found += k * bool(p[node])
                good += k * bool(p[node] and states[node] == htmltext.CONTENT)
    assert good / found > 0.93 and good / real > 0.97


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_is_named_for_its_operator(name):
    assert re.match(r"op([1-9]|1[0-3])_\w+$", name)


def test_a_quote_in_a_tag_is_no_string(spark):
    pages = ["<html><body><article><h1>Title</h1><p don't>first part of it, which is long enough to be a text.</p><p>second part of it, and this too is a text.</p></article></body></html>", "<article><p title='a > b' data-x=\"c > d\">Whole text here, with a comma and an end.</p><p it's=y\">More text there, with a comma too.</p></article>"]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark, spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")).collect()}
    assert got[0].split("\n")[-2:] == ["first part of it, which is long enough to be a text.", "second part of it, and this too is a text."]
    assert got[1] == "Whole text here, with a comma and an end.\nMore text there, with a comma too."
