"""Reading order of pages from their words: table cells, lines, a gutter between two columns, and bands of full-width lines.

Spark deals out pages, each a row with its words and cells as arrays; a page holds what one sheet of paper can. Inside a task the
words of many pages are sorted and numbered at once, as columns.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townledger.functions.text import small_batches

# Words whose tops are this near share a line; a page has so many bins across; what a gutter needs.
LINE, BINS = 3, 200
BODY = (0.08, 0.92)
FIRST_BIN, LAST_BIN, LEAST_WIDTH, LEAST_WORDS = 60, 140, 0.025, 25
#: Pages whose words are in columns at once.
PAGES = 256

WORD = ("word", "text", "x0", "top", "x1", "bottom")
CELL = ("table", "row", "cell", "x0", "top", "x1", "bottom", "t_x0", "t_top", "t_x1", "t_bottom")
_ARRAYS = "array<struct<word:long,text:string,x0:double,top:double,x1:double,bottom:double>>", "array<struct<table:int,row:int,cell:int," + ",".join(f"{c}:double" for c in CELL[3:]) + ">>"


_PLAIN = str.maketrans("\u00a0\u2018\u2019\u201c\u201d", " ''\"\"")
_ENDS = re.compile("[ \t]+(?=[\n\r\x85\u2028\u2029]|\\Z)")


def _normal(text: str) -> str:
    """What functions.text.normalize gives."""
    plain = unicodedata.normalize("NFC", text).translate(_PLAIN)
    return _ENDS.sub("", re.sub("[ \t]+", " ", plain))


def _texts(given: pa.Array) -> pa.Array:
    """Normalised texts, null ones empty."""
    texts = pc.fill_null(given, "")
    odd = np.flatnonzero(pc.or_(pc.invert(pc.string_is_ascii(texts)), pc.match_substring_regex(texts, "[ \t]")).to_numpy(False))
    if len(odd):
        mask = np.zeros(len(texts), bool)
        mask[odd] = True
        texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([_normal(t) for t in texts.take(pa.array(odd)).to_pylist()], pa.string()))
    return texts


def _columns(lists: pa.ListArray, names: tuple[str, ...]) -> tuple[np.ndarray, dict]:
    """The page of each element of a batch's arrays, and the elements' fields; text stays an Arrow array."""
    page = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(False))
    fields = dict(zip(names, lists.flatten().flatten()))
    return page, {n: c if n == "text" else c.to_numpy(False) for n, c in fields.items()}


def _new(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before in some column; the first one does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _kept(page: np.ndarray, c: dict) -> tuple[np.ndarray, dict]:
    """The cells of tables of at least two rows and two cells in a row, by (page, table, row, cell)."""
    order = np.lexsort((c["cell"], c["row"], c["table"], page))
    page, c = page[order], {n: v[order] for n, v in c.items()}
    if not len(page):
        return page, c
    table = np.cumsum(_new(page, c["table"])) - 1
    row = np.cumsum(_new(table, c["row"])) - 1
    table_of_row = table[_new(row)]
    good = (np.bincount(table_of_row) >= 2) & (np.maximum.reduceat(np.bincount(row), np.flatnonzero(_new(table_of_row))) >= 2)
    keep = good[table]
    return page[keep], {n: v[keep] for n, v in c.items()}


def _cell_of(page: np.ndarray, w: dict, cell_page: np.ndarray, c: dict, pages: int) -> np.ndarray:
    """For each word the number of the first cell that holds its middle, or -1."""
    at = np.full(len(page), -1)
    n = np.bincount(cell_page, minlength=pages)
    words = np.flatnonzero(n[page] > 0)
    if len(words):
        many = n[page[words]]
        word = np.repeat(words, many)
        cell = np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many) + np.searchsorted(cell_page, page[word])
        x, y = (w["x0"][word] + w["x1"][word]) / 2, (w["top"][word] + w["bottom"][word]) / 2
        inside = np.ones(len(word), bool)
        for p in ("", "t_"):
            inside &= (x >= c[f"{p}x0"][cell]) & (x < c[f"{p}x1"][cell]) & (y >= c[f"{p}top"][cell]) & (y < c[f"{p}bottom"][cell])
        word, cell = word[inside], cell[inside]
        first = _new(word)
        at[word[first]] = cell[first]
    return at


def _gutters(page: np.ndarray, w: dict, width: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) for each page, of the widest run of empty bins that divides it, the leftmost of equal ones; else not a number.

    From left to right, bins are empty between the furthest end so far and the next word; the words before such a gap are all
    left of it, the others right of it.
    """
    out = np.full(len(width), np.nan), np.full(len(width), np.nan)
    body = np.flatnonzero((w["top"] >= BODY[0] * height[page]) & (w["top"] <= BODY[1] * height[page]))
    body = body[np.lexsort((w["word"][body], w["x1"][body], w["x0"][body], page[body]))]
    if not len(body):
        return out
    page, x0, x1 = page[body], w["x0"][body], w["x1"][body]
    size, first = width[page] / BINS, np.flatnonzero(_new(page))
    n = np.diff(np.append(first, len(page)))
    before = np.arange(len(page)) - np.repeat(first, n)
    n = np.repeat(n, n)
    marks = x1 > np.floor(x0 / size) * width[page] / BINS  # a word of no width on an edge is in no bin
    ends = pd.Series(np.where(marks, x1, -np.inf)).groupby(page).cummax().to_numpy()
    p = np.where(before > 0, np.roll(ends, 1), -np.inf)
    gap = np.flatnonzero(marks & (x0 > p) & (p > -np.inf) & (before >= LEAST_WORDS) & (n - before >= LEAST_WORDS))
    page, p, x0, size = page[gap], p[gap], x0[gap], size[gap]
    edge = lambda i: i * width[page] / BINS
    a, b = np.ceil(p / size), np.floor(x0 / size)
    a = np.where(edge(a) < p, a + 1, np.where(edge(a - 1) >= p, a - 1, a))
    b = np.where(edge(b) > x0, b - 1, np.where(edge(b + 1) <= x0, b + 1, b))
    left, right = edge(a), edge(b)
    fit = np.flatnonzero((a >= FIRST_BIN) & (b <= LAST_BIN) & (right - left >= LEAST_WIDTH * width[page]))
    fit = fit[np.lexsort((left[fit], left[fit] - right[fit], page[fit]))]
    best = fit[_new(page[fit])]
    out[0][page[best]], out[1][page[best]] = left[best], right[best]
    return out


def _line_tops(page: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The top from which each word's line reaches LINE further down."""
    order = np.lexsort((top, page))
    tops, at, start = [], None, 0.0
    for p, t in zip(page[order].tolist(), top[order].tolist()):
        if p != at or t - start > LINE:
            at, start = p, t
        tops.append(start)
    out = np.empty(len(page))
    out[order] = tops
    return out


def _read(words: pa.ListArray, cells: pa.ListArray, width: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """(page, word, lead, body) of what the pages' texts are made of, in order; lead is what stands before body. A cell without words has word -1."""
    page, w = _columns(words, WORD)
    cell_page, c = _kept(*_columns(cells, CELL))
    texts = _texts(w["text"])
    at = _cell_of(page, w, cell_page, c, len(width))
    free, held = np.flatnonzero(at < 0), np.flatnonzero(at >= 0)
    loose = page[free], {n: v[free] for n, v in w.items() if n != "text"}
    gutters = _gutters(*loose, width, height)
    left, right = (g[loose[0]] for g in gutters)
    x0, x1, line_top = loose[1]["x0"], loose[1]["x1"], _line_tops(loose[0], loose[1]["top"])
    # Rows: free words, words of cells, cells without words.
    bare = np.flatnonzero(np.bincount(at[held], minlength=len(cell_page))[: len(cell_page)] == 0)
    cell = np.concatenate([at[held], bare])
    if len(cell_page):
        of_row = np.cumsum(_new(cell_page, c["table"], c["row"])) - 1
        row_top = np.minimum.reduceat(c["top"], np.flatnonzero(_new(of_row)))[of_row]
    else:
        row_top = np.empty(0)
    none, gone = np.zeros(len(free), int), np.zeros(len(bare))
    word = np.concatenate([free, held, np.full(len(bare), -1)])
    pages = np.concatenate([loose[0], cell_page[cell]])
    line = (np.concatenate([line_top, row_top[cell]]), np.concatenate([none, np.ones(len(cell), int)]), *(np.concatenate([none, c[n][cell]]) for n in ("table", "row")))
    whole = np.concatenate([(x0 < left) & (x1 > right), np.ones(len(cell), bool)])
    side = np.concatenate([np.where(x1 <= (left + right) / 2, 0, 1), np.zeros(len(cell), int)])
    inside = np.concatenate([none, c["cell"][cell]])
    # Equal places of words are told apart by the word's number, as they came.
    a = np.concatenate([np.zeros(len(free)), np.rint(w["top"][held]), gone])
    b = np.concatenate([x0, w["x0"][held], gone])
    d = np.concatenate([loose[1]["top"], np.zeros(len(held)), gone])
    number = np.concatenate([loose[1]["word"], w["word"][held], gone.astype(int)])
    if not len(word):
        return pages, word, pa.array([], pa.string()), pa.array([], pa.string())

    order = np.lexsort((*line[::-1], pages))
    new = _new(pages[order], *(x[order] for x in line))
    starts = np.flatnonzero(new)
    line_no = np.empty(len(word), int)
    line_no[order] = np.cumsum(new) - 1
    whole = np.logical_or.reduceat(whole[order], starts)
    page_of = pages[order][starts]
    upto = np.cumsum(whole)
    first = np.flatnonzero(_new(page_of))
    upto = upto - np.repeat((upto - whole)[first], np.diff(np.append(first, len(page_of))))
    free_page = np.zeros(len(width), bool)
    free_page[loose[0]] = True
    two = ~np.isnan(gutters[0][pages]) & free_page[pages]
    band = np.where(two, (upto - whole)[line_no], 0)
    side = np.where(two, np.where(whole[line_no], 2, side), 0)

    block = (pages * (int(band.max()) + 1) + band) * 3 + side
    order = np.lexsort((number, d, b, a, inside, line_no, block))
    block, line_no, inside = block[order], line_no[order], inside[order]
    lead = np.where(_new(pages[order]), 0, np.where(_new(block, line_no), 1, np.where(_new(inside), 2, 3)))
    word = word[order]
    body = pc.fill_null(texts.take(pa.array(word, mask=word < 0)), "")
    return pages[order], np.where(word < 0, -1, word), pa.array(["", "\n", " | ", " "]).take(pa.array(lead)), body


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, PAGES):
            b = batch.slice(lo, PAGES)
            yield b, _read(b.column("words"), b.column("cells"), b.column("width").to_numpy(False), b.column("height").to_numpy(False))


def _sent(pages: DataFrame) -> DataFrame:
    small_batches(pages.sparkSession)
    arrays = (F.coalesce(n, F.array()).cast(kind).alias(n) for n, kind in zip(("words", "cells"), _ARRAYS))
    return pages.select("page", *arrays, *(F.col(n).cast("double").alias(n) for n in ("width", "height")))


def read_pages(pages: DataFrame) -> DataFrame:
    """(page, text) of rows that are a page each: page, words (an array of WORD), cells (an array of CELL), width and height.

    A page without words and cells has no row. See page_texts.
    """
    kind = pages.schema["page"].dataType.simpleString()

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (page, _, lead, body) in _batches(batches):
            own = np.flatnonzero(_new(page)) if len(page) else np.empty(0, int)
            lists = pa.ListArray.from_arrays(pa.array(np.append(own, len(page)), pa.int32()), pc.binary_join_element_wise(lead, body, ""))
            yield pa.RecordBatch.from_arrays([b.column("page").take(pa.array(page[own])), pc.binary_join(lists, "")], names=["page", "text"])

    return _sent(pages).mapInArrow(per_task, f"page {kind}, text string")


def _pages(words: DataFrame, cells: DataFrame) -> DataFrame:
    """Words and cells as rows, brought together by page."""
    w = words.groupBy("page").agg(F.collect_list(F.struct(*(F.col(n).cast("long").alias(n) if n == "word" else n for n in WORD))).alias("words"), F.max("width").alias("width"), F.max("height").alias("height"))
    c = cells.groupBy("page").agg(F.collect_list(F.struct(*CELL)).alias("cells"))
    return w.join(c, "page", "full")


def word_boxes(words: DataFrame, cells: DataFrame) -> DataFrame:
    """(page, word, start, end, x0, y0, x1, y1): where each word stands in its page's text, and its box in shares of the page."""
    kinds = {n: words.schema[n].dataType.simpleString() for n in ("page", "word")}

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (page, word, lead, body) in _batches(batches):
            n = pc.utf8_length(body).to_numpy(False)
            end = np.cumsum(pc.utf8_length(lead).to_numpy(False) + n)
            end -= np.repeat(np.append(0, end)[first := np.flatnonzero(_new(page))], np.diff(np.append(first, len(page)))) if len(page) else 0
            kept = word >= 0
            fields = dict(zip(WORD, b.column("words").flatten().flatten()))
            size = {n: b.column(n).take(pa.array(page[kept])) for n in ("width", "height")}
            own = {n: c.take(pa.array(word[kept])) for n, c in fields.items() if n != "text"}
            columns = {"page": b.column("page").take(pa.array(page[kept])), "word": own["word"], "start": pa.array((end - n)[kept], pa.int64()), "end": pa.array(end[kept], pa.int64()), **{n: own[n] for n in WORD[2:]}, **size}
            yield pa.RecordBatch.from_pydict(columns)

    placed = _sent(_pages(words, cells)).mapInArrow(per_task, f"page {kinds['page']}, word long, start long, end long, x0 double, top double, x1 double, bottom double, width double, height double")
    share = lambda c, of: F.round(F.col(c) / F.col(of), 4)
    return placed.select("page", F.col("word").cast(kinds["word"]).alias("word"), "start", "end", share("x0", "width").alias("x0"), share("top", "height").alias("y0"), share("x1", "width").alias("x1"), share("bottom", "height").alias("y1"))


def page_texts(words: DataFrame, cells: DataFrame) -> DataFrame:
    """(page, text) of every page with a word or a table, in reading order.

    words: page, word (a number that tells a page's words apart), text, x0, top, x1, bottom, width and height of the page.
    cells: page, table, row, cell, x0, top, x1, bottom, and the table's box t_x0, t_top, t_x1, t_bottom. Words whose middle is in a
    cell belong to it, to the first of several; a row's cells are joined by " | ", its words by a blank. Other words make lines:
    tops within 3 of a line's first. Two columns are read one after the other between lines that cross the gutter and rows of
    tables. A null text is empty; words without a place are not given.
    """
    return read_pages(_pages(words, cells))
