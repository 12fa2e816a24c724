"""Brute-force models of the queries that SQL can't express: rows from the tables, a row or page at a time."""

import difflib
from collections import Counter, defaultdict

import pyarrow.parquet as pq

from tests.test_matching import _model as title_span


def rows(sf, name):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def boxes(sf):
    pages = defaultdict(list)
    for r in rows(sf, "lineitem"):
        x0, y0, n = float(r["l_partkey"] % 300), float(r["l_suppkey"] % 700), r["l_linenumber"]
        pages[r["l_orderkey"] % 100, r["l_orderkey"]].append((n, x0, y0, x0 + float(r["l_quantity"]) * 9 + 20, y0 + n * 6 + 8.0))
    return pages


def blocks(sf):
    for r in rows(sf, "documents"):
        for k, line in enumerate(r["text"].split("\n") if r["text"] is not None else []):
            yield r["doc_id"], k, line


def cluster_rects(sf):
    """Any two boxes that are near are joined, until none are."""
    out = Counter()
    for (paper, page), own in boxes(sf).items():
        todo = [[*b[1:], 1] for b in own]
        near = lambda a, b: a[0] <= b[2] + 6 and b[0] <= a[2] + 6 and a[1] <= b[3] + 20 and b[1] <= a[3] + 20
        while pair := next(((i, j) for i in range(len(todo)) for j in range(i) if near(todo[i], todo[j])), None):
            a, b = (todo.pop(k) for k in pair)
            todo.append([min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), a[4] + b[4]])
        out.update((paper, page, *b) for b in todo)
    return ["paper_id", "page", "x0", "y0", "x1", "y1", "n"], out


def caption_match(sf):
    """The best pair of those left, again and again."""
    out = Counter()
    for (paper, page), own in boxes(sf).items():
        images, texts = [b for b in own if b[0] % 3 == 0], [b for b in own if b[0] % 3]
        while True:
            best = None
            for i in images:
                for t in texts:
                    gap = t[2] - i[4] if t[2] >= i[4] else i[2] - t[4]
                    if min(t[3], i[3]) - max(t[1], i[1]) > 0 and -min(24.0, (t[4] - t[2]) * 0.25) <= gap <= 90:
                        best = min(best or (1e9,), (abs(gap) + 8.0 * (gap < 0), i[0], t[0]))
            if best is None:
                break
            out[paper, page, best[1], best[2]] += 1
            images, texts = [i for i in images if i[0] != best[1]], [t for t in texts if t[0] != best[2]]
    return ["paper_id", "page", "image", "text"], out


def gutter(sf, width=612.0):
    """Every x of the middle of a page in steps of a half, by how many boxes it crosses and how far it is from the middle."""
    out = Counter()
    for (paper, page), own in boxes(sf).items():
        left = [(x0, y0, min(x1, x0 + 120), y1) for _, x0, y0, x1, y1 in own]
        found = None
        while left:
            x, k = None, None
            for step in range(int(width * 0.3 / 0.5) + 1):
                at = width * 0.35 + 0.5 * step
                n = sum(b[0] < at < b[2] for b in left)
                if k is None or (n, abs(at - width / 2), at) < k:
                    x, k = at, (n, abs(at - width / 2), at)
            if k[0] > max(1, int(0.06 * len(left))):
                left = [b for b in left if not b[0] < x < b[2]]
                continue
            sides = [b for b in left if b[2] <= x], [b for b in left if b[0] >= x]
            if all(sides):
                heights = [max(b[3] for b in side) - min(b[1] for b in side) for side in sides]
                if min(heights) >= 0.5 * max(heights) > 0 or min(map(len, sides)) >= 2:
                    found = x
            break
        out[paper, page, found] += 1
    return ["paper_id", "page", "gutter"], out


def guarded_edit(sf):
    out = Counter()
    for paper, k, old in blocks(sf):
        new = [old, old[::-1], old.replace("e", "é"), ""][k % 4].strip()
        old = old.strip()
        like = difflib.SequenceMatcher(None, old, new).ratio()
        why = "empty" if not new else "unchanged" if new == old else "grown" if len(new) > 3 * len(old) + 300 else "rewritten" if like < 0.55 else ""
        out[paper, k, why] += 1
    return ["paper_id", "ord", "verdict"], out


def ext_approx_distinct(sf):
    """Within a twentieth of the exact number."""
    return ["users"], lambda got: abs(got[0][0] - len({r["user_id"] for r in rows(sf, "events")})) <= 0.05 * got[0][0]


def title_spans(sf):
    import re

    out = Counter()
    for r in rows(sf, "documents"):
        title = r["text"] and r["text"][:40]
        entry = None if title is None else "Name, A. " + re.sub("([a-z]{3})([a-z]{3})", r"\1- \2", title) + ". 2020."
        out[(r["doc_id"], *(title_span(entry, title) if entry else (None, None)))] += 1
    return ["paper_id", "start", "end"], out


def title_replaced(sf):
    out = Counter()
    for r in rows(sf, "documents"):
        title = r["text"][:40] if r["text"] is not None else ""
        flat = " ".join(f"Name, A. {title}. 2020.".split()) if r["text"] is not None else ""
        new = " ".join(title.split()) if r["doc_id"] % 3 == 0 else "译名"
        start, end = title_span(flat, title)
        chinese = any("㐀" <= c <= "䶿" or "一" <= c <= "鿿" or "豈" <= c <= "\ufaff" for c in new)
        faults = {"no title": start is None, "all of the entry": start is not None and end - start > 0.9 * len(flat), "not Chinese": not chinese, "too long": start is not None and len(new) > 2.5 * (end - start) + 60}
        refused = ", ".join(k for k, bad in faults.items() if bad)
        out[r["doc_id"], "" if refused else flat[:start] + new + flat[end:], refused] += 1
    return ["paper_id", "text", "refused"], out


def reference_entries(sf):
    """Each line is an entry under its number, as long as there are two and none is too long."""
    out, papers = Counter(), defaultdict(list)
    for paper, k, line in blocks(sf):
        papers[paper].append(f"[{k + 1}] {line}")
    for paper, own in papers.items():
        cut = [" ".join(x.split()) for x in own]
        sound = len(own) > 1 and max(map(len, cut)) <= 2000
        out.update((paper, n, e) for n, e in enumerate(cut if sound else own, 1))
    return ["paper_id", "n", "entry"], out


MODELS = {f.__name__: f for f in (cluster_rects, caption_match, gutter, guarded_edit, ext_approx_distinct, title_spans, title_replaced, reference_entries)}
