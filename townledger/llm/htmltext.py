"""Main text of web pages: a tree-structured graphical model over the DOM with exact sum-product marginals.

Each element has one of three states: STRUCTURE (holds the article and other things), CONTENT (in the
article) or BOILERPLATE. Potentials join parent and child by the child's kind of tag; what an element looks like
(tag, words of class and id, length, links, punctuation) adds to each state. All are learned from labelled pages.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from townledger.llm.common import small_batches, text_chunks

#: Bytes of pages whose trees are in memory at once; a longer page is alone.
CHUNK = 1 << 20
STRUCTURE, CONTENT, BOILERPLATE = range(3)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never text of a page: what is not rendered, and controls of forms.
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video form button select textarea option".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "legend", "summary", "figcaption"}
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

# A quote opens a value only behind an equals sign; elsewhere it is part of a name.
_TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)(?:>|\Z))", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]{2,}")
BUCKETS = 1 << 12
#: Lengths, links and punctuation repeat from parent to child, so each counts for less; names say the most.
LOOK_WEIGHTS = {"t": 0.5, "s": 0.15, "l": 0.4, "p": 0.15, "n": 2.0}


class Page:
    """The elements of a page in document order, and its blocks of text as runs (element, raw text)."""

    __slots__ = ("tags", "parent", "names", "depth", "blocks", "hidden")

    def __init__(self, page: str) -> None:
        self.tags, self.parent, self.names, self.depth, self.hidden = ["#root"], [-1], [""], [0], [False]
        self.blocks: list[list[tuple[int, str]]] = [[]]
        stack, at, n = [0], 0, len(page)
        for m in _TAG.finditer(page):
            if m.start() < at:
                continue
            if m.start() > at:
                self._text(stack[-1], page[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                self._close(stack, tag)
                continue
            if tag in CLOSES_P:
                self._close_in(stack, ("p",), ("div", "article", "section", "td", "li", "blockquote", "body"))
            if tag in SAME:
                self._close_in(stack, SAME[tag], SCOPE[tag])
            if tag in BLOCK:
                self._break()
            if tag == "br":
                self._text(stack[-1], " ")
            if tag in VOID:
                continue
            i = len(self.tags)
            self.tags.append(tag)
            self.parent.append(stack[-1])
            self.depth.append(len(stack))
            self.hidden.append(self.hidden[stack[-1]] or tag in HIDDEN)
            attrs = m[3]
            self.names.append(" ".join(x for g in _NAMES.findall(attrs) for x in g if x).lower() if "=" in attrs else "")
            if attrs.rstrip().endswith("/") and tag not in BLOCK:
                continue
            stack.append(i)
            if tag in RAW:
                end = re.compile(rf"</{tag}\b", re.I).search(page, at)
                if end is None and tag in ("script", "style"):
                    at = n
                elif end is not None:
                    if not self.hidden[i]:
                        self._text(i, page[at : end.start()])
                    at = end.start()
        if at < n:
            self._text(stack[-1], page[at:])

    def _text(self, node: int, raw: str) -> None:
        if not self.hidden[node]:
            self.blocks[-1].append((node, raw))

    def _break(self) -> None:
        if self.blocks[-1]:
            self.blocks.append([])

    def _close(self, stack: list[int], tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tags[stack[k]] == tag:
                if any(self.tags[i] in BLOCK for i in stack[k:]):
                    self._break()
                del stack[k:]
                return
            if tag not in BLOCK and self.tags[stack[k]] in BLOCK:
                return

    def _close_in(self, stack: list[int], tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            t = self.tags[stack[k]]
            if t in tags:
                self._break()
                del stack[k:]
                return
            if t in scope:
                return


_KIND = {t: i for i, t in enumerate("html body div section main article p span a li ul ol nav header footer aside h1 h2 h3 h4 td tr table form b i em strong blockquote pre figure label".split(), 1)}
KINDS = len(_KIND) + 1


def features(page: Page) -> tuple[np.ndarray, list[list[str]]]:
    """The kind of tag of each element and what it looks like."""
    n = len(page.tags)
    size, link, stops = [0] * n, [0] * n, [0] * n
    for block in page.blocks:
        for node, raw in block:
            k = len(raw.strip())
            size[node] += k
            stops[node] += raw.count(".") + raw.count(",")
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        if page.tags[i] == "a":
            link[i] = size[i]
        size[p] += size[i]
        link[p] += link[i]
        stops[p] += stops[i]
    kinds = np.array([_KIND.get(t, 0) for t in page.tags])
    out = []
    for i in range(n):
        s = size[i]
        own = [f"t:{page.tags[i]}", f"s:{min(12, int(math.log2(s + 1)))}", f"l:{int(4 * link[i] / s) if s else 9}", f"p:{min(6, int(120 * stops[i] / s)) if s else 9}"]
        if page.names[i]:
            own += {f"n:{x}" for x in _WORD.findall(page.names[i])}
        out.append(own)
    return kinds, out


@lru_cache(100_000)
def _bucket(look: str) -> int:
    return zlib.crc32(look.encode()) % BUCKETS


class Model:
    """Log potentials: of the root, of (parent, child) by kind of tag, and of each look by state."""

    def __init__(self, pages: list[tuple[Page, list[int]]], smooth: float = 0.3) -> None:
        root, pair, look = np.full(3, smooth), np.full((KINDS, 3, 3), smooth), np.zeros((BUCKETS, 3))
        base = np.full((3, 3), 0.02)
        per_state = np.zeros(3)
        for page, states in pages:
            kinds, looks = features(page)
            root[states[0]] += 1
            for i, s in enumerate(states):
                if i:
                    pair[kinds[i], states[page.parent[i]], s] += 1
                    base[states[page.parent[i]], s] += 1
                per_state[s] += len(looks[i])
                for x in looks[i]:
                    look[_bucket(x), s] += 1
        pair += 3 * base / base.sum(1, keepdims=True)
        self.root = np.log(root / root.sum())
        self.pair = np.log(pair / pair.sum(2, keepdims=True))
        # What was never seen says nothing: all states get the same there.
        seen = look.sum(1, keepdims=True) > 0
        self.look = np.where(seen, np.log((look + smooth) / (per_state + smooth * BUCKETS)), 0.0)
        self.look -= self.look.max(1, keepdims=True)

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        """P(state) of every element of each page: messages go up from the leaves and down from the root, level by level for all pages at once."""
        first = np.concatenate([[0], np.cumsum([len(p.tags) for p in pages])])
        n = int(first[-1])
        parent = np.concatenate([np.array(p.parent) + a for p, a in zip(pages, first)])
        depth = np.concatenate([np.array(p.depth) for p in pages])
        both = [features(p) for p in pages]
        kinds = np.concatenate([k for k, _ in both])
        looks = [x for _, l in both for x in l]
        lens = np.array([len(x) for x in looks])
        flat = np.fromiter((_bucket(y) for x in looks for y in x), np.int64, int(lens.sum()))
        weight = np.fromiter((LOOK_WEIGHTS[y[0]] for x in looks for y in x), float, len(flat))
        up = np.add.reduceat(self.look[flat] * weight[:, None], np.cumsum(lens) - lens, axis=0)
        roots = depth == 0
        up[roots] += self.root
        order = np.argsort(depth, kind="stable")
        cut = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        sent = np.zeros((n, 3))
        for d in range(int(depth.max()), 0, -1):
            own = order[cut[d] : cut[d + 1]]
            x = self.pair[kinds[own]] + up[own][:, None, :]
            top = x.max(2)
            sent[own] = top + np.log(np.exp(x - top[:, :, None]).sum(2))
            np.add.at(up, parent[own], sent[own])
        down = np.zeros((n, 3))
        for d in range(1, int(depth.max()) + 1):
            own = order[cut[d] : cut[d + 1]]
            over = (up + down)[parent[own]] - sent[own]
            x = self.pair[kinds[own]] + over[:, :, None]
            top = x.max(1)
            down[own] = top + np.log(np.exp(x - top[:, None, :]).sum(1))
            down[own] -= down[own].max(1, keepdims=True)
        z = up + down
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        return [z[a:b] for a, b in zip(first[:-1], first[1:])]


def page_text(page: Page, content: np.ndarray) -> str:
    """Blocks in page order, of the runs whose element is content; white space is one space inside a block."""
    blocks = []
    for block in page.blocks:
        t = " ".join(entities.unescape("".join(raw for node, raw in block if content[node])).split())
        if t:
            blocks.append(t)
    return "\n".join(blocks)


def labelled_pages(count: int = 240, seed: int = 11) -> list[tuple[Page, list[int]]]:
    """Made pages of many layouts with the state of each element, from a seeded grammar of page parts.

    Elements of the article carry the attribute data-y=1 and those of other parts data-y=2 while a page is made.
    """
    rng = random.Random(seed)
    say = lambda n: " ".join("".join(rng.choice("ba de ki lo mu ra se ti vo an er".split()) for _ in range(rng.randint(1, 4))) for _ in range(n))
    sentence = lambda: say(rng.randint(4, 18)).capitalize() + rng.choice([".", ".", ".", "!", "?"])
    prose = lambda k: " ".join(sentence().replace(" ", ", ", rng.randint(0, 1)) for _ in range(k))
    links = lambda k: "".join(f"<li data-y=2><a data-y=2 href='/{say(1)}'>{say(rng.randint(1, 3))}</a></li>" for _ in range(k))
    named = lambda words: f"{rng.choice(['class', 'id', 'class'])}=\"{rng.choice(words)}\"" if rng.random() < 0.85 else ""

    def junk() -> str:
        kind = rng.randrange(12)
        if kind == 0:
            t = rng.choice(["nav", "div", "nav"])
            return f"<{t} data-y=2 {named(['menu', 'navbar', 'navigation', 'nav main-nav', 'topmenu', 'breadcrumbs', 'breadcrumb', 'pagination', 'toc'])}><ul data-y=2>{links(rng.randint(2, 9))}</ul></{t}>"
        if kind == 1:
            t = rng.choice(["header", "div"])
            return f"<{t} data-y=2 {named(['header', 'site-header', 'masthead', 'top', 'banner', 'logo'])}><a data-y=2 href='/'>{say(2)}</a> <span data-y=2>{say(4)}</span></{t}>"
        if kind == 2:
            t = rng.choice(["footer", "div"])
            return f"<{t} data-y=2 {named(['footer', 'site-footer', 'copyright', 'bottom', 'legal'])}>&copy; {say(2)} &middot; {prose(rng.randint(1, 2))}</{t}>"
        if kind == 3:
            t = rng.choice(["aside", "div", "section"])
            inner = rng.choice([f"<ul data-y=2>{links(5)}</ul>", f"<p data-y=2>{prose(rng.randint(1, 4))}</p>", f"<h3 data-y=2>{say(2)}</h3><ul data-y=2>{links(4)}</ul>"])
            return f"<{t} data-y=2 {named(['sidebar', 'side', 'widget', 'related', 'related-posts', 'recommended', 'more-stories', 'trending', 'aside'])}>{inner}</{t}>"
        if kind in (4, 5):
            return f"<div data-y=2 {named(['ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'ad-slot', 'banner-ad'])}>{rng.choice([prose(rng.randint(1, 3)), say(3), f'<p data-y=2>{prose(2)}</p>'])}</div>"
        if kind in (6, 7):
            t = rng.choice(["section", "div", "div"])
            notes = "".join(f"<div data-y=2 {named(['comment', 'comment-body', 'reply'])}><p data-y=2>{prose(rng.randint(1, 5))}</p></div>" for _ in range(rng.randint(1, 6)))
            if rng.random() < 0.3:
                notes = "<ol data-y=2>" + "".join(f"<li data-y=2><p data-y=2>{prose(rng.randint(1, 4))}</p></li>" for _ in range(rng.randint(1, 5))) + "</ol>"
            return f"<{t} data-y=2 {rng.choice(['class', 'id'])}=\"{rng.choice(['comments', 'discussion', 'comment-list', 'responses', 'disqus', 'reader-comments', 'replies'])}\"><h3 data-y=2>{say(2)}</h3>{notes}</{t}>"
        if kind == 8:
            t = rng.choice(["div", "section", "aside", "p"])
            return f"<{t} data-y=2 {rng.choice(['class', 'id'])}=\"{rng.choice(['cookie', 'cookie-notice', 'notice', 'gdpr', 'consent', 'alert', 'disclaimer', 'banner', 'popup', 'modal', 'newsletter', 'subscribe', 'signup', 'paywall'])}\">{prose(rng.randint(1, 3))}</{t}>"
        if kind == 9:
            return f"<div data-y=2 {named(['share', 'social', 'sharing', 'tags', 'byline', 'meta', 'author', 'tools'])}>" + " ".join(f"<a data-y=2 href='#'>{say(1)}</a>" for _ in range(rng.randint(2, 6))) + "</div>"
        if kind == 10:
            return f"<form data-y=2><label data-y=2>{say(2)}</label><input><button data-y=2>{say(1)}</button></form>"
        return f"<ul data-y=2 {named(['menu', 'links', 'nav'])}>{links(rng.randint(3, 10))}</ul>"

    def story() -> str:
        t = rng.choice(["article", "article", "main", "div", "div", "section", "td"])
        names = named(["content", "article", "article-body", "post", "entry", "entry-content", "story", "main", "post-content", "text", "main-content", "body-text"]) if t in ("div", "section", "td") else rng.choice(["", named(["post", "article", "content"])])
        parts = [f"<h1 data-y=1>{say(rng.randint(3, 9)).capitalize()}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.randint(1, 14)):
            k = rng.random()
            text = prose(rng.randint(1, 8)) if rng.random() < 0.8 else sentence()
            if k < 0.1:
                text = text.replace(" ", f" <a data-y=1 href='/x'>{say(1)}</a> ", 1)
            if k > 0.9:
                text = f"<{(b := rng.choice(['b', 'em', 'strong', 'i', 'span']))} data-y=1>{text}</{b}>"
            if k < 0.62 or k > 0.9:
                parts.append(f"<p data-y=1>{text}" + ("</p>" if rng.random() < 0.9 else "<br>"))
            elif k < 0.68:
                parts.append(f"<h{(h := rng.choice([2, 3]))} data-y=1>{say(4)}</h{h}>")
            elif k < 0.74:
                parts.append("<ul data-y=1>" + "".join(f"<li data-y=1>{sentence()}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif k < 0.78:
                parts.append(f"<blockquote data-y=1><p data-y=1>{text}</p></blockquote>")
            elif k < 0.83:
                parts.append(f"<div data-y=1>{text}</div>")
            elif k < 0.86:
                parts.append(junk())
            else:
                parts.append(f"<p data-y=1><b data-y=1>{text}<br>")
        body = "".join(parts)
        if t == "td":
            return f"<table data-y=0><tr data-y=0><td data-y=1 {names}>{body}</td></tr></table>"
        return f"<{t} data-y=1 {names}>{body}</{t}>"

    pages = []
    for _ in range(count):
        inner = "".join(junk() for _ in range(rng.randint(0, 3))) + story() + "".join(junk() for _ in range(rng.randint(0, 4)))
        for _ in range(rng.choice([0, 0, 1, 2])):
            inner = f"<div data-y=0 {named(['wrapper', 'container', 'page', 'row', 'layout', 'site', 'wrap', 'main'])}>{inner}</div>"
        made = f"<!DOCTYPE html><html data-y=0><head><title>{say(3)}</title></head><body data-y=0>" + "".join(junk() for _ in range(rng.randint(0, 3))) + inner + "".join(junk() for _ in range(rng.randint(0, 3))) + "</body></html>"
        marks = [m[1] for m in re.finditer(r"<[a-z][a-z0-9]*(?:[^>]*?data-y=(\d))?[^>]*>", made) if not re.match(r"<(br|input|meta)", m[0])]
        page = Page(re.sub(r" data-y=\d", "", made))
        states = [STRUCTURE, *(int(m) if m else BOILERPLATE for m in marks)]
        if len(states) == len(page.tags):
            pages.append((page, states))
    return pages


@lru_cache(1)
def trained() -> Model:
    return Model(labelled_pages())


def extract(spark: SparkSession, pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with the columns text (the article, empty if there is none) and n_chars (its code points).

    A null page is empty; so is the text of a page without content. Pages of any length and depth are read
    whole. Character references are decoded. Columns with the names of the new ones are replaced.
    """
    keep = [c for c in pages.columns if c not in (text, "n_chars")]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema.fields]
    small_batches(spark)
    sent = spark.sparkContext.broadcast(trained())

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(html))
            for lo, hi, _, _ in text_chunks(batch, html, CHUNK):
                parsed = [Page(x or "") for x in column.slice(lo, hi - lo).to_pylist()]
                texts = [page_text(p, m[:, CONTENT] >= 0.5) for p, m in zip(parsed, model.marginals(parsed))]
                own = [c.slice(lo, len(parsed)) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names, text, "n_chars"])

    return pages.select(*keep).mapInArrow(per_batch, ", ".join([*kinds, f"`{text}` string", "n_chars long"]))
