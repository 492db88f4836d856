"""Places and lengths of verbatim benchmark matches against every pair of places."""

import random

import numpy as np
import pyarrow as pa
import pytest
from text_fixtures import frame, shipped  # noqa: F401

from casoteca.llm import decontaminate


def spans(text, items, window):
    out, w = set(), (text or "").split()
    for i, item in items:
        v = item.split()
        need = min(window, len(v))
        for b in range(len(v) - need + 1 if v else 0):
            for a in range(len(w)):
                n = 0
                while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                    n += 1
                if n >= need and not (a and b and w[a - 1] == v[b - 1]):
                    out.add((i, b, a, n))
    return out


@pytest.mark.parametrize("block", [1 << 24, 40])
def test_matches_and_longest_match(frame, monkeypatch, block):
    rng = random.Random(11)
    words = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(1, "p q r s t u v"), (2, "x p q r s"), (3, "a b"), (4, words(25)), (5, words(9)), (6, "z z z z z z")]
    # 1 and 2 lie in one part and match item 1 for 5 and 7 words; 3 matches item 2 for longer than item 1
    rows = [(1, "p q r s t n"), (2, "n p q r s t u v"), (3, "x p q r s"), (4, None), (5, ""), (6, "z " * 15),
            *((i, words(40)) for i in range(7, 30)), (30, items[3][1] + " " + items[4][1])]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    found = decontaminate.contamination(frame(rows).coalesce(1), frame(items, "item_id"), window=4).collect()
    assert len(found) == len(rows)
    for r in found:
        want = spans(dict(rows)[r.doc_id], items, 4)
        assert {tuple(m) for m in r.matches} == want and len(r.matches) == len(want)
        assert r.longest_match == max((m[3] for m in want), default=0)
        assert r["items"] == sorted({m[0] for m in want})


def test_search_in_chunks_of_pairs(monkeypatch):
    """``PAIRS`` holds where the operator runs in this process."""
    items = decontaminate.Items.build([(1, "a a a a a a"), (2, "b a a a a")], 3)
    windows = decontaminate.Windows.build(items)
    words, first = decontaminate.words_of(pa.array(["a a a a b a a a", "a a a"]))
    shard = decontaminate.search_shard(words, first, items, windows.chosen)
    whole = decontaminate.matches(shard, items, windows)
    monkeypatch.setattr(decontaminate, "PAIRS", 1)
    assert all((x == y).all() for x, y in zip(whole, decontaminate.matches(shard, items, windows)))
    doc = np.searchsorted(first, whole[1], side="right") - 1
    found = {(int(items.item_ids[items.item[s]]), int(items.inside[s]), int(p - first[d]), int(n), int(d))
             for s, p, n, d in zip(whole[0], whole[1], whole[2], doc)}
    texts = ["a a a a b a a a", "a a a"]
    assert found == {(*m, d) for d, t in enumerate(texts)
                     for m in spans(t, [(1, "a a a a a a"), (2, "b a a a a")], 3)}


@pytest.mark.parametrize("sizes", [[10] * 30 + [3000] * 4, [5000, *[1] * 50], [70] * 9])
def test_blocks_hold_at_most_their_bytes(spark, monkeypatch, sizes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    items = spark.createDataFrame([(3 * i, "é" * (n // 2)) for i, n in enumerate(sizes)] + [(None, "zz"), (1, None)],
                                  "item_id long, text string")
    rows = {r[0]: r[1] for r in items.where("item_id is not null").selectExpr(
        "item_id", "coalesce(octet_length(text), 0)").collect()}
    blocks = [[i for i in rows if low <= i <= high] for low, high in decontaminate._blocks(items, "item_id", "text")]
    assert sorted(i for b in blocks for i in b) == sorted(rows)
    assert all(len(b) == 1 or sum(rows[i] for i in b) <= 200 for b in blocks)
