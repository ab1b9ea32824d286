import random

import pytest

from townledger.operators import layout

WORDS = "page int, word int, text string, x0 double, top double, x1 double, bottom double, width double, height double"
CELLS = "page int, table int, row int, cell int, x0 double, top double, x1 double, bottom double, t_x0 double, t_top double, t_x1 double, t_bottom double"


def plain(words, tables, width, height):
    """A page's text by loops. words: (number, text, x0, top, x1, bottom); tables: (box, rows of boxes)."""
    cells_of, free = {}, []
    good = [(t, box, rows) for t, (box, rows) in enumerate(tables) if len(rows) > 1 and max(map(len, rows)) > 1]
    holds = lambda b, x, y: b[0] <= x < b[2] and b[1] <= y < b[3]
    for w in words:
        x, y = (w[2] + w[4]) / 2, (w[3] + w[5]) / 2
        at = next(((t, i, j) for t, box, rows in good if holds(box, x, y) for i, row in enumerate(rows) for j, c in enumerate(row) if holds(c, x, y)), None)
        cells_of.setdefault(at, []).append(w) if at else free.append(w)
    body = [w for w in free if 0.08 * height <= w[3] <= 0.92 * height]
    edge = [i * width / 200 for i in range(201)]
    full = [any(w[2] < edge[i + 1] and w[4] > edge[i] for w in body) for i in range(200)]
    runs = [(i, j) for i in range(200) for j in range(i + 1, 201) if not any(full[i:j]) and (i == 0 or full[i - 1]) and (j == 200 or full[j])]
    gaps = [(edge[i], edge[j]) for i, j in runs if i >= 60 and j <= 140 and edge[j] - edge[i] >= 0.025 * width and sum(w[4] <= edge[i] for w in body) >= 25 and sum(w[2] >= edge[j] for w in body) >= 25]
    gap = min(gaps, key=lambda g: (g[0] - g[1], g[0]), default=None)
    lines = []
    for w in sorted(free, key=lambda w: (w[3], w[2], w[0])):
        if not lines or w[3] - lines[-1][0] > 3:
            lines.append((w[3], 0, 0, 0, [[]]))
        lines[-1][4][0].append(w)
    lines = [(*x[:4], [sorted(x[4][0], key=lambda w: (w[2], w[3], w[0]))]) for x in lines]
    for t, _, rows in good:
        for i, row in enumerate(rows):
            lines.append((min(c[1] for c in row), 1, t, i, [sorted(cells_of.get((t, i, j), []), key=lambda w: (round(w[3]), w[2], w[0])) for j in range(len(row))]))
    out, left, right = [], [], []
    for *key, cells in sorted(lines, key=lambda x: x[:4]):
        if gap is None or key[1] or any(w[2] < gap[0] and w[4] > gap[1] for w in cells[0]):
            out += [*left, *right, cells]
            left, right = [], []
        else:
            mid = (gap[0] + gap[1]) / 2
            for side, of in ((left, [w for w in cells[0] if w[4] <= mid]), (right, [w for w in cells[0] if w[4] > mid])):
                if of:
                    side.append([of])
    return "\n".join(" | ".join(" ".join(w[1] for w in c) for c in cells) for cells in [*out, *left, *right])


def frames(spark, pages):
    words = [(p, *w, float(width), float(height)) for p, (ws, _, width, height) in enumerate(pages) for w in ws]
    cells = [(p, t, i, j, *map(float, c), *map(float, box)) for p, (_, ts, _, _) in enumerate(pages) for t, (box, rows) in enumerate(ts) for i, row in enumerate(rows) for j, c in enumerate(row)]
    return spark.createDataFrame(words, WORDS), spark.createDataFrame(cells, CELLS)


def page(r):
    width, height = r.choice([(600, 800), (612, 792), (1000, 1000)])
    n, words = 0, []
    columns = r.choice([1, 2, 2])
    y = 40.0
    while y < height * 0.95:
        if columns == 1 or r.random() < 0.1:
            spans = [(0.1, 0.9)]
        else:
            spans = [(0.08, 0.45), (0.55, 0.92)]
        for a, b in spans:
            x = a * width
            while x < b * width - 50:
                size = r.uniform(10, 45)
                words.append((n, f"w{n}", x, y + r.uniform(0, 2.9), x + size, y + 9))
                n, x = n + 1, x + size + r.uniform(2, 6)
            if len(spans) == 1 and columns == 2:
                words.append((n, f"w{n}", 0.3 * width, y + 1, 0.7 * width, y + 9))
                n += 1
        y += r.uniform(8, 14)
    tables = []
    if r.random() < 0.7:
        top = r.uniform(200, 400)
        tables.append(((100.0, top, 500.0, top + 70), [[(100.0 + 130 * j, top + 20 * i, 230.0 + 130 * j, top + 20 * (i + 1)) for j in range(r.choice([1, 2, 3]))] for i in range(r.choice([1, 2, 3]))]))
    r.shuffle(words)
    return words, tables, width, height


@pytest.mark.parametrize("seed", [1, 2])
def test_pages_equal_a_loop(spark, seed):
    r = random.Random(seed)
    pages = [page(r) for _ in range(25)]
    words, cells = frames(spark, pages)
    got = {x["page"]: x["text"] for x in layout.page_texts(words, cells).collect()}
    want = {p: plain(*x) for p, x in enumerate(pages)}
    assert got == want
    boxes = layout.word_boxes(words, cells).collect()
    assert len(boxes) == sum(len(x[0]) for x in pages)
    text = {(p, w[0]): w[1] for p, x in enumerate(pages) for w in x[0]}
    assert all(want[b["page"]][b["start"] : b["end"]] == text[b["page"], b["word"]] and 0 <= b["x0"] <= b["x1"] <= 1 for b in boxes)


def test_columns_tables_and_nothing(spark):
    left = [(i, f"l{i}", 100.0, 100.0 + 10 * i, 350.0, 108.0 + 10 * i) for i in range(30)]
    right = [(50 + i, f"r{i}", 650.0, 105.0 + 10 * i, 900.0, 113.0 + 10 * i) for i in range(30)]
    few = right[:24]
    cells = [((50, 100, 250, 160), [[(50, y, 150, y + 20), (150, y, 250, y + 20)] for y in (100, 120, 140)])]
    table = [(k, t, float(x), float(y), x + 30.0, y + 8.0) for k, (t, x, y) in enumerate([("Member", 55, 105), ("Vote", 155, 105), ("Gray", 55, 125), ("Aye", 155, 125), ("Hale", 55, 145), ("“no one”", 270, 125)])]
    words, boxes = frames(spark, [(left + right, [], 1000, 1000), (left + few, [], 1000, 1000), (table, cells, 600, 800), (table, [(cells[0][0], cells[0][1][:1])], 600, 800)])
    got = {x["page"]: x["text"] for x in layout.page_texts(words, boxes).collect()}
    assert got[0].split("\n") == [w[1] for w in left + right]
    assert got[1].split("\n")[:4] == ["l0", "r0", "l1", "r1"]
    assert got[2] == 'Member | Vote\nGray | Aye\n"no one"\nHale | '
    assert got[3] == 'Member Vote\nGray Aye "no one"\nHale'
    assert layout.page_texts(words.limit(0), boxes.limit(0)).count() == 0
