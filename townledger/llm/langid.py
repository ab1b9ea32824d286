"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townledger.llm.common import crc_of_id, shared_dir, small_batches, stored, text_chunks, tidy

U32 = np.uint32
#: Bytes of text scored at once.
CHUNK = 1 << 18


@dataclass(frozen=True)
class Settings:
    """buckets: a power of two. The model has buckets x languages numbers, in blocks of so many languages, one pass over the texts each."""

    buckets: int = 1 << 16
    block: int = 256
    alpha: float = 0.5
    #: n-grams that count as independent evidence: longer texts have their mean log-likelihood times this.
    evidence: float = 64.0


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case (letters) or a blank (all else), and whether it is a letter."""
    lower = np.full(0x110000, 32, U32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            lower[c] = ord(y) if len(y := x.lower()) == 1 else c
    return lower, lower != 32


def _chars(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points of a chunk, the offsets of its documents in them, and each document's letters."""
    lower, letter = _letters()
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), U32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    at = lead[offs]
    is_letter = np.concatenate([[0], np.cumsum(letter[points])])
    return lower[points], at, is_letter[at[1:]] - is_letter[at[:-1]]


def _grams(points: np.ndarray, at: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, whether it counts) at each code point for n = 1, 2, 3; n-grams lie in one document and begin or end at a letter."""
    shift = U32(32 - (buckets.bit_length() - 1))
    n = len(points)
    h = points * U32(0x9E3779B1)
    yield (h ^ (h >> U32(15))) * U32(0x85EBCA77) >> shift, points != 32
    for k in (2, 3):
        h = h[: n - k + 1] * U32(0x01000193) + points[k - 1 :] * U32(0xC2B2AE3D) + U32(k)
        ok = (points[: n - k + 1] != 32) | (points[k - 1 :] != 32)
        for b in range(1, k):
            cut = at[1:-1] - b
            ok[cut[(cut >= 0) & (cut < len(ok))]] = False
        yield (h ^ (h >> U32(15))) * U32(0x85EBCA77) >> shift, ok


def counts(labelled: DataFrame, text: str, lang: str, s: Settings) -> DataFrame:
    """lang, bucket, n over all rows of labelled: each task adds up its own rows before the shuffle."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(batch.schema.get_field_index(lang)).to_pylist()
            for lo, hi, data, offs in text_chunks(batch, text, CHUNK):
                if not len(data):
                    continue
                points, at, _ = _chars(data, offs)
                own = np.array(langs[lo:hi], dtype=object)
                names = sorted(set(langs[lo:hi]))
                code = np.zeros(hi - lo, np.int64)
                for i, x in enumerate(names):
                    code[own == x] = i
                    docs[x] = docs.get(x, 0) + int((own == x).sum())
                of_point = np.repeat(code, np.diff(at)) * s.buckets
                total = np.zeros(len(names) * s.buckets, np.int64)
                for bucket, ok in _grams(points, at, s.buckets):
                    total += np.bincount((of_point[: len(bucket)] + bucket)[ok], minlength=len(total))
                for i, x in enumerate(names):
                    part = total[i * s.buckets : (i + 1) * s.buckets]
                    tables[x] = tables[x] + part if x in tables else part
        for x, t in tables.items():
            some = np.flatnonzero(t)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x] * (len(some) + 1), pa.string()), "bucket": pa.array(np.append(some, -1).astype(np.int32)), "n": pa.array(np.append(t[some], docs[x]))})

    part = labelled.select(text, lang).mapInArrow(tidy(per_task), "lang string, bucket int, n long")
    return part.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """names, their log priors, and log P(bucket | language) as broadcast matrices of s.block languages each."""

    names: list[str]
    prior: np.ndarray
    blocks: list[Broadcast]


def fit(spark: SparkSession, labelled: DataFrame, text: str = "text", lang: str = "lang", settings: Settings = Settings()) -> Model:
    """The model of all labelled rows with a non-null lang. Texts without letters teach nothing but their prior.

    The driver holds the names and one block's matrix at a time, whatever the number of languages.
    """
    small_batches(spark)
    table = stored(counts(labelled.filter(F.col(lang).isNotNull()), text, lang, settings), f"{shared_dir(spark)}/counts")
    docs = table.filter("bucket < 0").orderBy("lang").toArrow()
    names, prior = docs["lang"].to_pylist(), docs["n"].to_numpy().astype(float)
    blocks = []
    for at in range(0, len(names), settings.block):
        own = names[at : at + settings.block]
        cols = table.filter((F.col("bucket") >= 0) & F.col("lang").between(own[0], own[-1])).toArrow()
        full = np.zeros((settings.buckets, len(own)))
        code = {x: i for i, x in enumerate(own)}
        np.add.at(full, (cols["bucket"].to_numpy(), np.array([code[x] for x in cols["lang"].to_pylist()], np.int64)), cols["n"].to_numpy())
        logp = np.log(full + settings.alpha) - np.log(full.sum(0) + settings.alpha * settings.buckets)
        blocks.append(spark.sparkContext.broadcast(logp.astype(np.float32)))
    return Model(names, np.log(prior / prior.sum()) if names else prior, blocks)


def evidence(data: np.ndarray, offs: np.ndarray, prior: np.ndarray, logp: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Tempered log-posteriors but for their sum, and letters, of the texts of a chunk: prior + mean log-likelihood times the n-grams that count."""
    points, at, letters = _chars(data, offs)
    total, n = np.zeros((len(offs) - 1, len(prior))), np.zeros(len(offs) - 1)
    some = np.flatnonzero(np.diff(at))
    for bucket, ok in _grams(points, at, s.buckets):
        if not len(bucket):
            continue
        run = np.concatenate([[0], np.cumsum(ok)])
        starts = run[np.minimum(at[:-1], len(bucket))]
        ends = run[np.minimum(at[1:], len(bucket))]
        here = some[ends[some] > starts[some]]
        if len(here):
            total[here] += np.add.reduceat(logp[bucket[ok]], starts[here], axis=0, dtype=np.float64)
            n[here] += (ends - starts)[here]
    return prior + total * np.minimum(1.0, s.evidence / np.maximum(n, 1))[:, None], letters


def predict(docs: DataFrame, model: Model, text: str = "text", settings: Settings = Settings(), without: tuple[str, ...] = ()) -> DataFrame:
    """docs, but for the columns without, and lang_pred string, score double: the likeliest language and its tempered posterior.

    A null text or one without a letter is `und` with score 0, and so is every text if nothing was learned. Of equal
    languages the first by name is taken. Columns named lang_pred or score are replaced. More than settings.block languages
    take a pass for each block, which carries the best so far and the log of the sum over all.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    small_batches(docs.sparkSession)
    rows = docs.select(*keep)
    carried = ["_best", "_z", "_sum"]
    if set(carried) & set(keep):
        raise ValueError("docs has a column named _best, _z or _sum")
    passes = max(1, len(model.blocks))
    for i in range(passes):
        last, first = i == passes - 1, i == 0
        returned = [f for f in docs.select(*keep).schema.fields if not (last and f.name in without)]
        out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in returned), "_best string, _z double, _sum double"])
        sent = model.blocks[i] if model.blocks else None
        at = i * settings.block
        names, prior = model.names[at : at + settings.block], model.prior[at : at + settings.block]

        def per_batch(batches: Iterator[pa.RecordBatch], sent=sent, names=names, prior=prior, first=first, returned=tuple(f.name for f in returned)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                if first:
                    best, z, total = np.full(n, "und", object), np.full(n, -np.inf), np.full(n, -np.inf)
                else:
                    best, z, total = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).copy() for c in ("_best", "_z", "_sum"))
                for lo, hi, data, offs in text_chunks(batch, text, CHUNK):
                    if not len(data) or sent is None:
                        continue
                    own, letters = evidence(data, offs, prior, sent.value, settings)
                    top = own.max(1)
                    better = (letters > 0) & (top > z[lo:hi])
                    best[lo:hi] = np.where(better, np.array(names, object)[own.argmax(1)], best[lo:hi])
                    z[lo:hi] = np.where(better, top, z[lo:hi])
                    total[lo:hi] = np.logaddexp(total[lo:hi], top + np.log(np.exp(own - top[:, None]).sum(1)))
                back = [batch.schema.get_field_index(c) for c in returned]
                yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in back), pa.array(best, pa.string()), pa.array(z), pa.array(total)], names=[*returned, "_best", "_z", "_sum"])

        rows = rows.mapInArrow(tidy(per_batch), out)
    score = F.when(F.col("_best") == "und", F.lit(0.0)).otherwise(F.exp(F.col("_z") - F.col("_sum")))
    return rows.select(*(f"`{f.name}`" for f in returned), F.col("_best").alias("lang_pred"), score.alias("score"))


def identify(spark: SparkSession, docs: DataFrame, settings: Settings = Settings(), without: tuple[str, ...] = ()) -> DataFrame:
    """Every document, but for the columns without, with lang_pred, score and held_out; learned from the documents that are not held out.

    held_out: crc32 of doc_id as text has remainder 2 by 4. A null doc_id is not held out. lang is read for
    learning alone.
    """
    held = F.coalesce(F.pmod(crc_of_id(), F.lit(4)) == 2, F.lit(False))
    model = fit(spark, docs.filter(~held).select("text", "lang"), settings=settings)
    return predict(docs.withColumn("held_out", held), model, settings=settings, without=without)
