"""Alignment of pages with many siblings: the optimum by recursion, and bounded time and memory."""

from __future__ import annotations

import random
import time
import tracemalloc

import pytest

from tochi.llm import webpages


def _tree(rng, depth):
    tag = rng.choice(["div", "p", "ul", "section", "h2"])
    inner = "".join(_tree(rng, depth - 1) for _ in range(rng.randint(0, 4))) if depth else "x"
    return f"<{tag}>{inner}{'t' if rng.random() < 0.5 else ''}</{tag}>"


def _best(a, b):
    """Simple tree matching, straight from its recursion."""
    if a.tag != b.tag:
        return 0
    rows = [[0] * (len(b.children) + 1)]
    for x in a.children:
        rows.append([0])
        for j, y in enumerate(b.children):
            rows[-1].append(max(rows[-2][j + 1], rows[-1][j], rows[-2][j] + _best(x, y)))
    return rows[-1][-1] + 1


@pytest.mark.parametrize("seed", range(60))
def test_the_matching_is_an_optimum(seed):
    rng = random.Random(seed)
    aligner = webpages.Aligner("".join(_tree(rng, 3) for _ in range(rng.randint(1, 8))))
    page = aligner.tree("".join(_tree(rng, 3) for _ in range(rng.randint(1, 8))))
    assert aligner._size(page, aligner.pivot) == _best(page, aligner.pivot)
    todo, size = [(page, aligner.pivot)], 0
    while todo:
        a, b = todo.pop()
        size += 1
        pairs = list(zip(a.children, b.children)) if a.shape == b.shape else list(aligner._pairs(a, b))[::-1]
        for side, children in ((0, a.children), (1, b.children)):
            places = [next(k for k, c in enumerate(children) if c is p[side]) for p in pairs]
            assert places == sorted(set(places))  # in order, none twice
        todo += pairs
    assert size == aligner._size(page, aligner.pivot)


@pytest.mark.parametrize(("page", "pivot"), [(4000, 4000), (100_000, 300), (300, 20_000)])
def test_wide_pages_take_seconds_and_little_memory(page, pivot):
    aligner = webpages.Aligner("".join(f"<p>a{k}</p>" + "<hr>" * (k % 3 == 0) for k in range(pivot)))
    wide = "".join(f"<p>b{k}</p>" for k in range(page))
    tracemalloc.start()
    began = time.process_time()
    runs = list(webpages._runs(aligner.align(wide)))
    took, (_, peak) = time.process_time() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(runs) == page and sum(r.slot >= 0 for r in runs) == min(page, pivot)
    slots = [r.slot for r in runs if r.slot >= 0]
    assert slots == sorted(slots) and took < 60 and peak < 400e6
