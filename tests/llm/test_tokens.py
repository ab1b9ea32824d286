import glob
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from townledger.llm import packing, tokenfiles, tokens
from townledger.llm.common import shared_dir
from townledger.llm.tokens import default_path, encoder

ODD = ["a  b", "a   b", " \n b", "it's we'll 'sample ''s x", "a \n\n  b  ", "\t\ta b  c  　 d", " ", "", "   ", "<|endoftext|> x<|endoftext|>", "naïve café 漢字 テスト 😀 x", "1234 12,5 ٣٤ x", "don't I'LL", "a\x1c b \x85 c", "   x", "\r\n a\r\n\r\n b", "word,word .x ,y.", "é.", "ab."]


def ids(text, end):
    return encoder(default_path())._tok.encode(text or "", add_special_tokens=False).ids + [end]


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


@pytest.mark.parametrize("text", ODD)
def test_pieces_equal_the_library(text):
    e = encoder(default_path())
    assert e.ids(text).tolist() == e._tok.encode(text, add_special_tokens=False).ids


def test_random_texts_equal_the_library(monkeypatch):
    """Texts of odd pieces, many at a time, with a table of pieces that is given up again and again."""
    monkeypatch.setattr(tokens, "PIECES", 100)
    e, r = encoder(default_path()), random.Random(4)
    pool = ["a", "B", "é", "×", "÷", "ß", "ő", "漢", "１", "٣", "5", "12", "'", "'s", "'ll", "’", "-", ".", ", ", " ", "  ", "\n", " \n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "😀", "<|endoftext|>", "x" * 40, "_", "\r\n"]
    for _ in range(20):
        texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 30))) for _ in range(200)]
        raw = [t.encode() for t in texts]
        ids, at = e.batch(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == e._tok.encode(t, add_special_tokens=False).ids


def test_token_files_round_trip(spark, odd, none):
    out = shared_dir(spark)
    tokenfiles.write_token_files(odd, out, end=2, meta=("lang", "source"))
    got = sorted(tokenfiles.token_digest(spark, out).collect(), key=lambda r: r["start"])
    want = defaultdict(list)
    for r in odd.collect():
        want[r["doc_id"]].append(ids(r["text"], 2))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        assert (r["n_tokens"], r["ids_crc32"]) in {(len(x), crc(x)) for x in want[r["doc_id"]]}
    assert len(got) == odd.count() and at == sum(len(x) for v in want.values() for x in v)
    known = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert known == sorted(known)
    assert set(tokenfiles.read_token_files(spark, out, "lang").columns) == {"lang"}
    footers = [pq.ParquetFile(f).metadata for f in glob.glob(f"{out}/*.parquet".replace("file:", ""))]
    chunks = [m.row_group(g).column(c) for m in footers for g in range(m.num_row_groups) for c in range(m.num_columns)]
    assert chunks and all(c.has_offset_index and c.has_column_index for c in chunks)
    assert all("RLE_DICTIONARY" in c.encodings for c in chunks if c.path_in_schema.startswith("ids")) and {c.compression for c in chunks} == {"ZSTD"}
    plan = tokenfiles.read_token_files(spark, out, "doc_id", "n_tokens").filter("doc_id > 100")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan and "GreaterThan(doc_id,100)" in plan
    empty = shared_dir(spark)
    tokenfiles.write_token_files(none, empty)
    assert tokenfiles.token_digest(spark, empty).count() == 0


def sequences(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    sizes = {}
    for k, pieces in by.items():
        at = 0
        for o, n in sorted(pieces):
            assert o == at and n > 0
            at += n
        sizes[k] = at
    return sizes


@pytest.mark.parametrize("weights", [None, {"s0": 3.0, "s1": 1.0}])
def test_packing_places_each_id_once(spark, odd, weights):
    rows = packing.pack(spark, odd, size=256, weights=weights, with_ids=True).collect()
    sizes = sequences(rows)
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(n == 256 or n & (n - 1) == 0 for n in sizes.values())
    want = defaultdict(list)  # every document, rebuilt from its pieces
    for r in odd.collect():
        want[r["doc_id"]].append(ids(r["text"], 1))
    for r in rows:
        assert r["ids_crc32"] == crc(r["ids"]) and len(r["ids"]) == r["length"]
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
    assert set(got) == set(want)
    for i, pieces in got.items():
        if len(want[i]) == 1:
            assert [x for r in sorted(pieces, key=lambda r: r["start"]) for x in r["ids"]] == want[i][0]
        assert sorted(x for r in pieces for x in r["ids"]) == sorted(x for w in want[i] for x in w)


def test_windows_keep_the_mixture(spark):
    docs = spark.createDataFrame([(i, "word " * (5 + i % 90), "abcd"[min(3, i % 7)]) for i in range(900)], "doc_id long, text string, source string")
    rows = packing.pack(spark, docs, size=512).collect()
    share = defaultdict(int)
    for r in rows:
        share[r["queue"]] += r["length"]
    whole = sum(share.values())
    got = defaultdict(lambda: defaultdict(int))
    for r in rows:
        got[r["sequence_id"]][r["queue"]] += r["length"]
    for k in range(whole // 512):
        for q, n in share.items():
            assert abs(got[k][q] - 512 * n / whole) <= 2


@pytest.mark.parametrize("weights", [None, {"q007": 1.0, "q008": 3.0}])
def test_many_small_sources_keep_the_mixture(spark, weights):
    """300 sources, each under 1/256 of all bytes, and a few that are far smaller; small sources that weights name."""
    docs = spark.createDataFrame([(i, "word " * (20 + i % 7), f"q{i // 20:03d}") for i in range(6000)] + [(9000 + i, "word " * (3 + 2 * i), f"z{i}") for i in range(4)], "doc_id long, text string, source string")
    rows = packing.pack(spark, docs, size=2048, weights=weights, with_ids=True).join(docs.select("doc_id", "source"), "doc_id").collect()
    sequences(rows)
    assert all(r["ids_crc32"] == crc(r["ids"]) for r in rows)
    by = defaultdict(int)
    for r in rows:
        by[r["source"]] += r["length"]
    whole = sum(by.values())
    assert whole == sum(len(ids(r["text"], 1)) for r in docs.collect())
    got, full = defaultdict(int), whole // 2048
    for r in rows:
        got[r["sequence_id"], r["source"]] += r["length"]
    if weights:
        assert got[0, "q007"] == 512 and got[0, "q008"] == 1536 or by["q007"] + by["q008"] < 2048 and got[0, "q007"] > 0 and got[0, "q008"] > 0
        return
    for q, n in by.items():
        had = 0
        for k in range(full):
            had += got[k, q]
            assert abs(had - n * (k + 1) / (whole / 2048)) <= 24


def test_tiny_queues_stay_in_the_mixture():
    """Queues of under a token a window are served all along, by what their deficits come to, in windows that are full."""
    totals = {"big": 900_000, "mid": 90_000, **{f"tiny{i}": 30 + 7 * i for i in range(9)}}
    for weights in (None, {"big": 1.0, "mid": 0.4, "tiny3": 0.0004}):
        phase = packing.make_phases(totals, 2048, weights)[0]
        lay, used = packing.Layout(phase, 2048), defaultdict(int)
        whole = phase.total()
        for j, (q, n) in enumerate(zip(phase.queues, phase.counts)):
            at = 0
            for a, b, seq, _ in lay.pieces(j, 0, n):
                assert a == at and abs(a - n * 2048 * seq / whole) <= max(3, 2 * 2048 * n / whole) or seq >= lay.full
                used[seq] += b - a
                at = b
            assert at == n
        assert all(used[k] == 2048 for k in range(lay.full)) and set(phase.queues) == (set(totals) if weights is None else set(weights))


def test_packing_nothing(spark, none):
    assert packing.pack(spark, none).count() == 0


def test_phases_serve_all():
    for totals in ({"a": 10, "b": 100_000, "c": 1}, {"a": 1}, {}, {c: 7 for c in "abcdefgh"}):
        for weights in (None, {"a": 1.0}, {"a": 1.0, "b": 0.001}):
            phases = packing.make_phases(totals, 64, weights)
            got = defaultdict(int)
            for p in phases:
                lay, placed = packing.Layout(p, 64), defaultdict(set)
                for j, (q, n) in enumerate(zip(p.queues, p.counts)):
                    got[q] += n
                    at = 0
                    for a, b, s, o in lay.pieces(j, 0, n):
                        assert a == at
                        at = b
                        placed[s] |= set(range(o, o + b - a))
                    assert at == n
                assert sum(map(len, placed.values())) == p.total()
            assert got == totals


def test_kept_pieces_take_little_memory():
    """A worker keeps a piece in arrays, at under 100 bytes, and finds it again."""
    import tracemalloc

    e = tokens.Encoder(tokens.default_path())
    r = np.random.default_rng(1)
    text = " ".join("".join(map(chr, w)) for w in r.integers(97, 123, (60_000, 6)))
    e.ids("one two")
    tracemalloc.start()
    try:
        first = e.ids(text)
        del text
        kept = tracemalloc.get_traced_memory()[0] - first.nbytes
    finally:
        tracemalloc.stop()
    n = e._n
    assert n > 50_000 and kept < 100 * n
    again = " ".join("".join(map(chr, w)) for w in np.random.default_rng(1).integers(97, 123, (60_000, 6)))
    assert (e.ids(again) == first).all() and e._n == n
