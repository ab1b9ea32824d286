import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from townledger.llm import components, decontam, media, ngram_join
from townledger.llm.common import SPACED, words

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, percent=80, n=5):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs."""
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, s) in enumerate(sets):
        for b in range(a):
            t = sets[b][1]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                root[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return [(i, len(s), least.get(find(x)) if s else i) for x, (i, s) in enumerate(sets)]


def joined(spark, docs, **kw):
    return [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join_ngrams(spark, docs, **kw).collect()]


def same(a, b):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(a, key=key) == sorted(b, key=key)


def test_join_equals_all_pairs_on_odd_rows(spark, odd):
    same(joined(spark, odd), brute([(r["doc_id"], r["text"]) for r in odd.collect()]))


def test_join_of_nothing(spark, none):
    assert joined(spark, none) == []


def families(seed=1):
    """Small and large sets, chains of near copies, and families whose common part is just too small."""
    r = np.random.default_rng(seed)
    word = lambda: "w%d" % r.integers(0, 500)
    rows, i = [], 0
    for size in (3, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 60, 150):
        for _ in range(3):
            t = [word() for _ in range(size)]
            for _ in range(5):
                rows.append((i, " ".join(t)))
                i += 1
                k = int(r.integers(0, len(t)))
                t = t[:k] + [word() for _ in range(int(r.integers(0, 3)))] + t[k + int(r.integers(0, 2)) :]
    shared = [word() for _ in range(60)]
    for _ in range(40):
        rows.append((i, " ".join(shared + [word() for _ in range(int(r.integers(4, 14)))])))
        i += 1
    return rows


@pytest.mark.parametrize("percent", [80, 60, 100])
def test_join_equals_all_pairs_on_families(spark, percent):
    rows = families()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same(joined(spark, docs, settings=ngram_join.Settings(percent=percent)), brute(rows, percent))


def test_boundary_follows_cost():
    s = ngram_join.Settings()
    assert ngram_join.choose_boundary({n: 1 for n in range(4, 500)}, 1.0, s) < ngram_join.choose_boundary({n: 1 for n in range(4, 500)}, 60.0, s)


def test_words_are_hashed_alike_wherever_they_stand():
    t = ["Ab ab", "ab", "x" * 70 + " ab", "", "ab\x0bé"]
    b = [x.encode() for x in t]
    h, _, _, first = words(np.frombuffer(b"".join(b), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in b])]), SPACED)
    assert list(np.diff(first)) == [2, 1, 2, 0, 2] and h[0] == h[1] == h[2] == h[4] == h[5] and len(set(h.tolist())) == 3


def test_components(spark):
    r = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(int(a), int(b)) for a, b in r.integers(2000, 2300, (220, 2))]
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert got == {x: find(x) for x in {y for e in edges if e[0] != e[1] for y in e}}


def hits(rows, items, window):
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    win = defaultdict(set)
    for i, t in items:
        w = tok(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            win[tuple(w[j : j + n])].add("null" if i is None else str(i))
    out = []
    for i, t in rows:
        w, it = tok(t), set()
        hit = [0] * len(w)
        for g, own in win.items():
            for j in range(len(w) - len(g) + 1):
                if tuple(w[j : j + len(g)]) == g:
                    it |= own
                    hit[j : j + len(g)] = [1] * len(g)
        out.append((i, len(w), sum(hit), len(it), hashlib.sha256(",".join(sorted(it)).encode()).hexdigest(), sum(hit) > 0))
    return out


@pytest.mark.parametrize("block", [1 << 25, 300])
def test_decontamination_equals_search(spark, odd, none, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    docs = odd.filter("doc_id is null or doc_id != 10")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    text = dict(rows)
    cut = text[6].split()
    items = [(1, " ".join(cut[50:75])), (2, " ".join(cut[300:315]) + " q " + " ".join(cut[10:25])), (3, "one two"), (4, None), (5, ""), (None, "12345"), (7, text[101]), (7, text[101]), (8, "nothing of this is there at all in them ever so"), (9, " ".join(cut[55:66]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_matches(spark, docs, bench)
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key) == sorted(hits(rows, items, 10), key=key)
    longest = {(m["item_id"], m["doc_word"], m["item_word"], m["n_words"]) for m in got.filter("doc_id = 6").first()["matches"]}
    assert {("1", 50, 0, 25), ("2", 300, 0, 15), ("2", 10, 16, 15), ("9", 55, 0, 11)} <= longest
    assert decontam.decontaminate(spark, docs, bench).columns == docs.columns
    assert decontam.find_matches(spark, none, bench).count() == 0
    assert decontam.find_matches(spark, docs, bench.limit(0)).filter("contaminated").count() == 0


def test_suffix_array_is_sorted():
    r = np.random.default_rng(1)
    codes = r.integers(0, 3, 400)
    sa, _, _ = decontam.suffix_array(codes, 400)
    tails = [tuple(codes[i:].tolist()) for i in sa]
    assert tails == sorted(tails)


def test_media_copies(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i % 50).normal(size=8)]) for i in range(60)]
    images = media.media_of_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    odd_ = spark.createDataFrame([(900, None), (901, b""), (902, b"P5 9"), (903, media.encode(np.zeros((40, 40)))), (None, media.encode(np.zeros((40, 40))))], "image_id long, image binary")
    got = {r["image_id"]: r for r in media.find_copies(spark, images.union(odd_)).collect()}
    assert len(got) == 65
    changed = lambda i: zlib.crc32(str(i).encode()) % 4 == 0 and i > 0
    for i in range(50):
        if not changed(i):
            twin = got[i + 50]["class_id"] if i + 50 < 60 and not changed(i + 50) else None
            assert twin in (None, got[i]["class_id"])
    known = [(i, i - 1) for i in range(1, 50) if changed(i) and not changed(i - 1)]
    assert sum(got[a]["class_id"] == got[b]["class_id"] for a, b in known) >= 0.9 * len(known)
    assert got[900]["class_id"] == got[901]["class_id"] == 900 and got[903]["n_exact"] == 2
    assert media.find_copies(spark, images.limit(0)).count() == 0
    assert got[7]["class_id"] != got[9]["class_id"] or not F


def enlarged(image, by):
    """A picture by bilinear sampling; by < 1 shrinks it."""
    h, w = image.shape
    ys, xs = (np.arange(int(h * by)) + 0.5) / by - 0.5, (np.arange(int(w * by)) + 0.5) / by - 0.5
    y, x = np.clip(ys.astype(int), 0, h - 2), np.clip(xs.astype(int), 0, w - 2)
    fy, fx = np.clip(ys - y, 0, 1)[:, None], np.clip(xs - x, 0, 1)[None]
    a = image.astype(float)
    return np.rint((a[np.ix_(y, x)] * (1 - fx) + a[np.ix_(y, x + 1)] * fx) * (1 - fy) + (a[np.ix_(y + 1, x)] * (1 - fx) + a[np.ix_(y + 1, x + 1)] * fx) * fy).astype(np.uint8)


def test_crops_turns_and_sizes_of_images(spark):
    """Copies of pictures of 128 pixels: turned, cropped to half of each side, and from half to twice their size; every one finds its own original and no other."""
    r = np.random.default_rng(4)
    kinds = {"turned": np.rot90, "half": lambda a: a[(y := int(r.integers(0, 64))) : y + 64, (x := int(r.integers(0, 64))) : x + 64], "0.5": lambda a: enlarged(a, 0.5), "0.8": lambda a: enlarged(a, 0.8), "1.5": lambda a: enlarged(a, 1.5), "2": lambda a: enlarged(a, 2.0), "light": lambda a: media.edited(a, 7)}
    rows, of = [], {}
    for i in range(6):
        image = media.picture(b"big%d" % i, 128)
        for j, f in enumerate([lambda a: a, *kinds.values()]):
            rows.append((100 * i + j, bytearray(media.encode(np.ascontiguousarray(f(image))))))
            of[100 * i + j] = 100 * i
    got = {r["image_id"]: r["class_id"] for r in media.find_copies(spark, spark.createDataFrame(rows, "image_id long, image binary").repartition(4)).collect()}
    for j, kind in enumerate(kinds, 1):
        assert np.mean([got[100 * i + j] == 100 * i for i in range(6)]) >= 0.9, kind
    assert all(c in (i, of[i]) for i, c in got.items())  # no link to another picture


def test_media_link_under_keys_of_two_and_of_many(spark, monkeypatch):
    """Two images with three corners of their own and two that many images have: no one sort of key holds the five that a link needs."""
    r = np.random.default_rng(3)
    code = lambda: tuple(int(v) for v in r.integers(-(2**62), 2**62, 2))
    corner = lambda c, i: (*c, 40.0 * i, 40.0, 1.0, 0.0)
    many, own = [code() for _ in range(2)], [code() for _ in range(3)]
    rows = [(i, 1000 + i, [corner(c, j) for j, c in enumerate(many + (own if i in (7, 23) else [code() for _ in range(3)]))]) for i in range(60)]
    described = spark.createDataFrame(rows, "image_id long, cls long, corners array<struct<c0:long,c1:long,x:float,y:float,s:float,a:float>>")
    monkeypatch.setattr(media, "_described", lambda images, s: described)
    got = {x["image_id"]: (x["class_id"], x["n_links"]) for x in media.find_copies(spark, spark.createDataFrame([], "image_id long, image binary")).collect()}
    assert got == {i: (7, 1) if i in (7, 23) else (i, 0) for i in range(60)}


def test_media_keys_that_stand_once_become_no_rows(spark, tmp_path):
    """The keys that several classes have are those of a loop, and the filter lets hardly any other become a row."""
    r = np.random.default_rng(8)
    codes = r.integers(-(2**62), 2**62, (30, 20, 2))
    codes[5, :4], codes[9, 2], codes[12, 3] = codes[4, :4], codes[4, 2], codes[12, 7]
    rows = [(i, 500 + i, [(int(a), int(b), 1.0 * j, 2.0, 1.0, 0.0) for j, (a, b) in enumerate(codes[i][: i if i < 2 else 20])]) for i in range(30)]
    once = spark.createDataFrame(rows, "image_id long, cls long, corners array<struct<c0:long,c1:long,x:float,y:float,s:float,a:float>>").repartition(3)
    got = media._shared(once, str(tmp_path))
    owners = {}
    for _, cls, corners in rows:
        for a, b, *_ in corners:
            bands = [x >> n & 0xFFFFFFFF for x in (a, b) for n in (0, 32)]
            for i in range(4):
                for j in range(i):
                    owners.setdefault((i, j, bands[i], bands[j]), []).append(cls)
    want = [len(x) for x in owners.values() if len(set(x)) > 1]
    assert got.count() == sum(want) and got.filter("two").count() == sum(n for n in want if n == 2)
    bits = spark.read.parquet(f"{tmp_path}/counts").filter("range IS NOT NULL").select("bits").collect()
    passed = sum(bin(int.from_bytes(b["bits"], "big")).count("1") for b in bits)
    assert 0 < passed <= 2 * sum(len(x) > 1 for x in owners.values()) + 2


def of_corners(spark, monkeypatch, corners):
    """{image_id: (class_id, n_links)} of images with these corners (c0, c1, x, y)."""
    rows = [(i, 1000 + i, [(int(a), int(b), float(x), float(y), 1.0, 0.0) for a, b, x, y in own]) for i, own in enumerate(corners)]
    described = spark.createDataFrame(rows, "image_id long, cls long, corners array<struct<c0:long,c1:long,x:float,y:float,s:float,a:float>>").repartition(3)
    monkeypatch.setattr(media, "_described", lambda images, s: described)
    return {x["image_id"]: (x["class_id"], x["n_links"]) for x in media.find_copies(spark, spark.createDataFrame([], "image_id long, image binary")).collect()}


def test_media_meetings_by_chance_become_no_rows(spark, monkeypatch, tmp_path):
    """Images that meet each other once or twice by chance: no table written has a row a meeting, nor corners a key."""
    r = np.random.default_rng(6)
    code = lambda: r.integers(-(2**62), 2**62, 2)
    common, true = [code() for _ in range(12)], [code() for _ in range(8)]
    corners = [[(*c, 40.0 * j, 40.0) for j, c in enumerate([common[i % 12], common[(i * 5 + 1) % 12], *(true if i in (3, 31) else [code() for _ in range(8)])])] for i in range(120)]
    monkeypatch.setattr(media, "shared_dir", lambda spark: str(tmp_path))
    got = of_corners(spark, monkeypatch, corners)
    assert got == {i: (3, 1) if i in (3, 31) else (i, 0) for i in range(120)}
    rows = {d.name: spark.read.parquet(str(d)).count() for d in tmp_path.iterdir() if d.name not in ("counts", "matches")}
    assert len(rows) > 3 and max(rows.values()) <= 120 + 6, rows  # an image each, or the keys of 12 + 8 corners


def test_media_links_are_all_that_a_loop_over_pairs_finds(spark, monkeypatch):
    """Groups of near copies, corners that many images have, one that stands often in an image, keys in parts of 4: n_links counts every link, inside a group too."""
    r = np.random.default_rng(9)
    code = lambda: [int(v) for v in r.integers(0, 2**63, 2)]
    common, families, again = [code() for _ in range(5)], [[code() for _ in range(9)] for _ in range(3)], code()

    def near(c, bits):
        for b in r.integers(0, 127, bits).tolist():
            c = [c[0] ^ (1 << b if b < 63 else 0), c[1] ^ (1 << b - 64 if b > 63 else 0)]
        return c

    corners = []
    for i in range(36):
        own = [(*near(c, int(r.integers(0, 3))), 40 * (j % 3) + i, 40 * (j // 3) + 2 * i) for j, c in enumerate(families[i % 3]) if r.random() < 0.9] if i < 30 else [(*code(), 40 * j, 0) for j in range(6)]
        corners.append(own + [(*common[j], *r.integers(0, 300, 2).tolist()) for j in r.integers(0, 5, 2)])
    corners += [[(*again, 40 * j, 300) for j in range(n)] for n in (8, 8, 1)] + [[]]

    band = lambda c: [x >> n & 0xFFFFFFFF for x in c for n in (0, 32)]
    alike = lambda a, b: sum(x == y for x, y in zip(band(a), band(b))) >= 2 and sum((x ^ y).bit_count() for x, y in zip(a, b)) <= media.DISTANCE
    links = []
    for v, other in enumerate(corners):
        for u, own in enumerate(corners[:v]):
            m = np.array([(*a[2:], 1.0, 0.0, *b[2:], 1.0, 0.0) for a in own for b in other if alike(a[:2], b[:2])], float)
            if len(m) >= 5 and media.consensus(m, media.Settings()) >= 5:
                links.append((u, v))
    root = list(range(len(corners)))
    for _ in root:
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    monkeypatch.setattr(media, "LIST", 4)
    monkeypatch.setattr(media, "CELL", 50)
    got = of_corners(spark, monkeypatch, corners)
    assert got == {i: (root[i], sum(i in p for p in links)) for i in range(len(corners))}
    assert len(links) > 60 and (36, 37) in links and root[38] == 38


def test_components_end_when_all_links_are_stars(spark, monkeypatch):
    """A round that finds stars is the last one: what is written is read as it is, not by another round."""
    from townledger.llm import components as C

    rounds = []
    monkeypatch.setattr(C, "stored", lambda df, path, write=C.stored: rounds.append(path) or write(df, path))
    links = lambda pairs: spark.createDataFrame(pairs, "u long, v long")
    got = {r["node"]: r["root"] for r in C.components(links([(1, i) for i in range(2, 9)] + [(20, 21)])).collect()}
    assert got == {**{i: 1 for i in range(1, 9)}, 20: 20, 21: 20} and len(rounds) == 2
    chain = [(i, i + 1) for i in range(40)] + [(90, 80), (80, 85), (90, 90)]
    got = {r["node"]: r["root"] for r in C.components(links(chain)).collect()}
    assert got == {**{i: 0 for i in range(41)}, 80: 80, 85: 80, 90: 80}
    assert C.components(links([])).count() == 0
