"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townledger.llm.common import crc_of_id, give_back, small_batches, text_chunks, tidy

U32 = np.uint32
#: Bytes of text scored at once.
CHUNK = 1 << 18
#: Words of a vocabulary that are spelled at once, and numbers that training adds up at once.
NAMES, SUMMED = 1 << 14, 1 << 18


@dataclass(frozen=True)
class Settings:
    """At most max_rows documents of each label, none of over max_bytes bytes, are fitted: the first by a hash of their ids.

    A document is scored by its most toxic window of so many words, each window is a bag of its words' subwords; with
    window 0 the whole text is one bag.
    """

    buckets: int = 1 << 17
    dim: int = 4
    window: int = 3
    max_rows: int = 1500
    max_bytes: int = 20_000
    #: Subwords of fewer documents teach nothing, lest single texts be learned by heart.
    min_docs: int = 8
    steps: int = 40
    rate: float = 0.7
    decay: float = 2e-4
    #: How much more a toxic document weighs than another.
    lift: float = 3.0
    seed: int = 7


@lru_cache(1)
def _fold() -> np.ndarray:
    """The lower case of each letter or digit; 0 for all else."""
    lower = np.zeros(0x110000, U32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalnum():
            lower[c] = ord(y) if len(y := x.lower()) == 1 else c
    return lower


class Words:
    """The words of a chunk of texts, each with the buckets of its character 3-, 4- and 5-grams (with both ends) and of itself."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, buckets: int) -> None:
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), U32)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        # A blank at the start and after each document keeps its words apart.
        docs = len(offs) - 1
        at = lead[offs]
        c = np.zeros(len(points) + docs + 8, U32)
        c[1 + np.arange(len(points)) + np.repeat(np.arange(docs), np.diff(at))] = _fold()[points]
        letter = c != 0
        self.start = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        self.end = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        self.first = np.searchsorted(self.start, at + np.arange(docs + 1))
        self.c, self.shift = c, U32(32 - (buckets.bit_length() - 1))
        self.size = self.end - self.start
        self.count = 1 + self.size + np.maximum(self.size - 1, 0) + np.maximum(self.size - 2, 0)

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> U32(15))) * U32(0x85EBCA77)
        return (h ^ (h >> U32(13))) * U32(0xC2B2AE35) >> self.shift

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(buckets by place, first place of each word, end place): a word's n-grams begin one before it."""
        c = self.c
        h = c * U32(0x9E3779B1)
        for n in range(2, 6):
            h = h[:-1] * U32(0x01000193) + c[n - 1 :] * U32(0x27D4EB2F) + U32(n)
            if n > 2:
                yield self._bucket(h), self.start - 1, np.maximum(self.start - 1, self.end + 2 - n)

    def whole(self) -> np.ndarray:
        """The bucket of each word itself."""
        k = np.arange(len(self.c)) - np.repeat(np.append(0, self.start), np.diff(np.concatenate([[0], self.start, [len(self.c)]])))
        part = (self.c * U32(0x9E3779B1) + U32(0x7F4A7C15)) * ((k.astype(U32) * U32(2) + U32(1)) * U32(0x85EBCA6B)) * (self.c != 0)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
        h = ((total[self.end] - total[self.start]) & np.uint64(0xFFFFFFFF)).astype(U32)
        return self._bucket(h ^ (self.size.astype(U32) * U32(0xC2B2AE3D)))

    def mean(self, value: np.ndarray) -> np.ndarray:
        """For each word the mean value of its buckets."""
        total = value[self.whole()].astype(np.float64)
        for bucket, a, b in self.grams():
            run = np.concatenate([[0.0], np.cumsum(value[bucket], dtype=np.float64)])
            total += run[b] - run[a]
        return total / self.count

    def kinds(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each kind of subword, the word itself and then its 3-, 4- and 5-grams: (buckets in the order of words, how many each word has)."""
        yield self.whole().astype(np.int32), np.ones(len(self.start), np.int64)
        for bucket, a, b in self.grams():
            n = b - a
            yield bucket[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - a, n)].astype(np.int32), n


def sample(labelled: DataFrame, s: Settings, text: str, label: str, order) -> DataFrame:
    """(label, text) of the rows to fit: of each label the first max_rows by order, by partial sorts, never a sort of all."""
    some = labelled.select(label, text, order.alias("_h")).filter(F.col(label).isin(0, 1) & (F.octet_length(text) <= s.max_bytes))
    return some.filter(F.col(label) == 1).orderBy("_h").limit(s.max_rows).union(some.filter(F.col(label) == 0).orderBy("_h").limit(s.max_rows))


def _bags(rows: DataFrame, s: Settings, text: str, label: str) -> DataFrame:
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(0).to_pylist()
            for lo, hi, data, offs in text_chunks(batch, text, CHUNK):
                w = Words(data, offs, s.buckets)
                chars = "".join(map(chr, np.where(w.c == 0, 32, w.c)))
                names = [chars[a:b] for a, b in zip(w.start.tolist(), w.end.tolist())]
                docs = [names[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
                yield pa.RecordBatch.from_pydict({"label": pa.array(labels[lo:hi], pa.int32()), "words": pa.array(docs, pa.list_(pa.string()))})

    return rows.select(F.col(label).cast("int").alias(label), text).mapInArrow(tidy(per_task), "label int, words array<string>")


def _spelled(names: list[str], s: Settings) -> Iterator[tuple[int, Words]]:
    """The words of a vocabulary, some at a time: (number of the first, words)."""
    for lo in range(0, len(names), NAMES):
        raw = np.frombuffer(" ".join(names[lo : lo + NAMES]).encode(), np.uint8)
        yield lo, Words(raw, np.array([0, len(raw)]), s.buckets)


def _subwords(names: list[str], spread: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets that enough documents have, for each of their subwords which of them it is, and its word, by kind and then by word, subwords of each word in all).

    Words are spelled twice, so that the subwords of rare buckets are never held.
    """
    total, seen, lens = np.zeros(s.buckets), np.zeros(s.buckets, bool), np.zeros(len(names), np.int64)
    for lo, w in _spelled(names, s):
        lens[lo : lo + len(w.count)] = w.count
        for bucket, n in w.kinds():
            total += np.bincount(bucket, np.repeat(spread[lo : lo + len(n)], n), s.buckets)
            seen[bucket] = True
    used = np.flatnonzero(seen & (total >= s.min_docs))
    place = np.full(s.buckets, -1, np.int32)
    place[used] = np.arange(len(used))
    flat, of_word = [[] for _ in range(4)], [[] for _ in range(4)]
    for lo, w in _spelled(names, s):
        for k, (bucket, n) in enumerate(w.kinds()):
            at = place[bucket]
            flat[k].append(at[at >= 0])
            of_word[k].append(np.repeat(np.arange(lo, lo + len(n), dtype=np.int32), n)[at >= 0])
    return used, np.concatenate(sum(flat, [])), np.concatenate(sum(of_word, [])), lens


def _sums(at: np.ndarray, values: Callable[[slice], np.ndarray], size: int) -> np.ndarray:
    """What bincount gives for at and values, with values made some at a time."""
    out = np.zeros(size)
    for lo in range(0, len(at), SUMMED):
        some = slice(lo, lo + SUMMED)
        np.add.at(out, at[some].astype(np.intp), values(some))
    return out


def train(labels: np.ndarray, n: np.ndarray, names: list[str], ids: np.ndarray, s: Settings) -> np.ndarray:
    """The logit that each bucket adds, with the bias last: embeddings and the softmax's weights learned together.

    Documents of n words each stand one after the other in ids, numbers of names. Windows' probabilities combine
    to that of a document as noisy-or, so a label of a long document is put down to its telling windows. Both labels
    weigh the same. Beside the subwords and their words no array is as long as they are.
    """
    if not names or len(set(labels.tolist())) < 2:
        out = np.zeros(s.buckets + 1, np.float32)
        share = (labels.mean() if len(labels) else 0.0) * 0.98 + 0.01
        out[-1] = np.log(share / (1 - share))
        return out
    vocabulary, spread, lo = len(names), np.zeros(len(names), np.int64), 0
    for k in n.tolist():
        spread[np.unique(ids[lo : lo + k])] += 1
        lo += k
    used, flat, of_word, lens = _subwords(names, spread, s)
    names.clear()
    windows = np.maximum(1, -(-n // s.window)) if s.window else np.ones(len(n), np.int64)
    owner = np.repeat(np.arange(len(n), dtype=np.int32), windows)
    sizes = np.clip(n[owner] - s.window * (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)), 0, s.window).astype(np.int32) if s.window else n
    some = sizes > 0
    of_window = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    share_w, share_g = 1.0 / s.window if s.window else 1.0 / np.maximum(sizes, 1), 1.0 / lens
    give_back()
    y = labels.astype(float)
    weight = np.where(y > 0, s.lift, 1.0) / len(y)

    rng = np.random.default_rng(s.seed)
    E, W = rng.normal(0, 0.05, (len(used), s.dim)), rng.normal(0, 0.5, s.dim)
    b = -4.0
    state = [np.zeros_like(E), np.zeros_like(E), np.zeros_like(W), np.zeros_like(W), 0.0, 0.0]
    V, X = np.empty((vocabulary, s.dim)), np.empty((len(sizes), s.dim))
    for step in range(1, s.steps + 1):
        for k in range(s.dim):
            V[:, k] = _sums(of_word, lambda a: E[flat[a], k], vocabulary) * share_g
        for k in range(s.dim):
            X[:, k] = _sums(of_window, lambda a: V[ids[a], k], len(sizes)) * share_w
        z = X @ W + b
        p = 1 / (1 + np.exp(-z))
        total = np.bincount(owner, np.logaddexp(0, z), len(n))
        positive = np.exp(-total) / np.maximum(1 - np.exp(-total), 1e-9)
        slope = np.where(y > 0, -positive, 1.0) * weight
        g = slope[owner] * p * some
        gW = X.T @ g
        each = g * share_w
        of_v = _sums(ids, lambda a: each[of_window[a]], vocabulary) * share_g
        gE = _sums(flat, lambda a: of_v[of_word[a]], len(used))[:, None] * W
        gb = g.sum()
        rate = s.rate * (1 - step / (s.steps + 1))
        for i, (param, grad) in enumerate(((E, gE), (W, gW))):
            m, v = state[2 * i], state[2 * i + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param -= rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7) + s.decay * param)
        state[4] += 0.1 * (gb - state[4])
        state[5] += 0.01 * (gb * gb - state[5])
        b -= rate * state[4] / (1 - 0.9**step) / (np.sqrt(state[5] / (1 - 0.99**step)) + 1e-7)
    out = np.zeros(s.buckets + 1, np.float32)
    out[used] = E @ W
    out[-1] = b
    return out


def _numbered(bags: pa.Table) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(labels, words of each document, the distinct words, the number among them of each word of all documents); the words' text itself is let go."""
    n = bags["words"].combine_chunks() if bags.num_rows else pa.array([], pa.list_(pa.string()))
    words = n.flatten().dictionary_encode()
    return bags["label"].to_numpy().astype(np.int64), np.diff(n.offsets.to_numpy()), words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False)


def fit(labelled: DataFrame, settings: Settings = Settings(), text: str = "text", label: str = "toxic", key: str = "doc_id") -> np.ndarray:
    """The model of labelled documents (key, text, label 0 or 1): buckets + 1 numbers. A row without a label teaches nothing.

    Only the bounded sample of Settings comes to the driver, as lists of words.
    """
    small_batches(labelled.sparkSession)
    rows = sample(labelled, settings, text, label, F.xxhash64(F.lit(settings.seed), key))
    return train(*_numbered(_bags(rows, settings, text, label).toArrow()), settings)


def predict(docs: DataFrame, model: np.ndarray, settings: Settings = Settings(), text: str = "text", without: tuple[str, ...] = ()) -> DataFrame:
    """docs, but for the columns without, with score double and predicted int: the softmax's probability of each text's most toxic window of words.

    A null or empty text, or one without words, has the score of an empty window. Texts of any
    length are scored whole. Columns named score or predicted are replaced.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    returned = [f for f in docs.select(*keep).schema.fields if f.name not in without]
    back = [keep.index(f.name) for f in returned]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in returned]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = sent.value
        logit, bias = value[:-1], float(value[-1])
        for batch in batches:
            best = np.zeros(batch.num_rows)
            for lo, hi, data, offs in text_chunks(batch, text, CHUNK):
                w = Words(data, offs, settings.buckets)
                n = np.diff(w.first)
                if not n.sum():
                    continue
                mean = w.mean(logit)
                # Windows begin at every word, so that a phrase is seen whole wherever it stands.
                run = np.concatenate([[0.0], np.cumsum(mean)])
                some = np.flatnonzero(n)
                if not settings.window:
                    best[lo + some] = (run[w.first[1:]] - run[w.first[:-1]])[some] / n[some]
                    continue
                end = np.minimum(np.arange(len(mean)) + settings.window, np.repeat(w.first[1:], n))
                z = (run[end] - run[:-1]) / settings.window
                best[lo + some] = np.maximum.reduceat(z, w.first[:-1][some])
            score = 1 / (1 + np.exp(-np.clip(best + bias, -40, 40)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in back), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*(batch.schema.names[i] for i in back), "score", "predicted"])

    return docs.select(*keep).mapInArrow(tidy(per_batch), ", ".join([*kinds, "score double", "predicted int"]))


def held_out(key: str = "doc_id"):
    """Whether crc32 of the id as text has remainder 0 by 5; a null id is not held out."""
    return F.coalesce(F.pmod(crc_of_id(key), F.lit(5)) == 0, F.lit(False))


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """The model of documents (doc_id, text) joined with labels (doc_id, toxic) on ids that are not held out.

    The ids of the sample are picked from the labels alone, so texts of no other documents move; where few are labelled,
    the others' texts are passed over by a broadcast of the sample's ids.
    """
    order = F.xxhash64(F.lit(settings.seed), "doc_id")
    own = labels.select("doc_id", "toxic").filter(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).distinct().withColumn("_h", order)
    twice = 2 * settings.max_rows  # some may be too long, or have no text
    ids = own.filter("toxic = 1").orderBy("_h").limit(twice).union(own.filter("toxic = 0").orderBy("_h").limit(twice)).select("doc_id", "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    model = fit(rows, settings)
    give_back()
    return model


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), without: tuple[str, ...] = ()) -> DataFrame:
    """Every document, but for the columns without, with held_out, score and predicted; labels, lang, source and doc_id are not inputs of a score."""
    return predict(docs.withColumn("held_out", held_out()), learn(spark, docs, labels, settings), settings, without=without)
