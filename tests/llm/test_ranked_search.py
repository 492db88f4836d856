"""The best documents of each query text against a plain ranking of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from text_fixtures import frame, shipped  # noqa: F401

from casoteca.llm import ranked_search


def terms(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain(docs, items, top=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    total, words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, mine in wanted.items():
        scores = []
        for i, c, n in held:
            m = 100 - 90 + 90 * n * total // words
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in mine if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if gone else i, -s) for r, (s, gone, i) in enumerate(sorted(scores)[:top], 1)]
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("cells, leaf, pairs", [(1 << 22, 64, 1 << 16), (900, 2, 40)])
def test_against_plain_ranking(frame, monkeypatch, cells, leaf, pairs):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "ß", "A", "x9", "日本"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]

    def text(n):
        return rng.choice([" ", "-", ", ", "\n"]).join(rng.choices(vocabulary, weights, k=n))

    docs = [(i, text(rng.choice([1, 2, 5, 30, 200]))) for i in range(300)]
    docs += [(i, docs[i % 7][1]) for i in range(300, 420)]                # copies: equal scores
    docs += [(5, "w1 w2"), (5, "w1 w2"), (None, "w3 w40"), (None, "É é"), (500, None), (501, ""), (502, "-- !"),
             (503, "w50 " * 70_000)]
    items = [(i, text(rng.choice([1, 4, 20]))) for i in range(25)]
    items += [(3, "w7 w7 W8"), (None, "w3"), (90, None), (91, ""), (92, "nowhere"), (93, "w1 nowhere É")]
    for name, value in (("CELLS", cells), ("LEAF", leaf), ("BLOCK_PAIRS", pairs)):
        monkeypatch.setattr(ranked_search, name, value)
    found = ranked_search.ranked(frame(docs), frame(items, "item_id"))
    assert order(found.collect()) == order(plain(docs, items))
    assert dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_empty_tables(frame):
    some = [(1, "a b"), (2, "b")]
    assert ranked_search.ranked(frame([]), frame(some, "item_id")).collect() == []
    assert ranked_search.ranked(frame(some), frame([], "item_id")).collect() == []
    assert ranked_search.ranked(frame([(1, None)]), frame(some, "item_id")).collect() == []


def test_bounds_hold_and_leave_documents_out(monkeypatch):
    """Every node's bound covers its documents, and a search skips leaves."""
    monkeypatch.setattr(ranked_search, "LEAF", 4)
    rng = np.random.default_rng(1)
    n, width = 2000, 50
    tf = (rng.random((n, width)) < 1 / (2 + np.arange(width))) * rng.integers(1, 9, (n, width))
    row, rank = np.nonzero(tf)
    m, ids = rng.integers(10, 400, n), rng.permutation(n)
    tree = ranked_search.Tree.build(np.searchsorted(row, np.arange(n + 1)), rank, tf[row, rank], m, ids, width)
    for node in range(len(tree.low)):
        a, b = tree.low[node], tree.high[node]
        assert (tree.bound[node] >= tree.value[a:b].max(0)).all()
        assert tree.least_id[node] == tree.ids[a:b].min()
    leaves = [(tree.low[i], tree.high[i]) for i, (p, q) in enumerate(tree.children) if p == q]
    assert sorted(x for a, b in leaves for x in range(a, b)) == list(range(n))
    terms, weight = np.array([3, 20, 45, 49]), np.array([100.0, 2000.0, 4000.0, 5000.0])
    best = ranked_search.Best(5)
    looked = tree.search([(terms, weight)], [best])
    scores = (weight * ranked_search.worth(tf[:, terms], m[:, None])).sum(1).astype(int)
    want = np.lexsort((ids, -scores))[:5]
    assert best.score.tolist() == scores[want].tolist() and best.ids.tolist() == ids[want].tolist()
    assert looked < len(leaves) / 2
