"""Near duplicates and near vectors where rows share an id or have none, row by row."""

import itertools
import random
from collections import Counter

import numpy as np
from text_fixtures import frame, shipped  # noqa: F401

from casoteca.llm import minhash, vectors


def components(n, links):
    group = list(range(n))
    for a, b in links:
        x, y = group[a], group[b]
        group = [x if g == y else g for g in group]
    return group


def expected(ids, links):
    """(id, component) of every row; rows without an id have no links."""
    links = [(a, b) for a, b in links if ids[a] is not None and ids[b] is not None]
    group = components(len(ids), links)
    out = []
    for i, g in zip(ids, group):
        mine = [j for j, h in zip(ids, group) if h == g and j is not None]
        out.append((i, None if i is None else min(mine)))
    return Counter(out)


def test_documents_that_share_ids(frame):
    rng = random.Random(6)
    texts = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdef"}
    near = {k: t.replace(f"{k}30", "other") for k, t in texts.items()}        # 51 of 61 shingles are common
    rows = [(1, texts["a"]), (1, texts["b"]), (2, texts["a"]), (3, texts["b"]), (3, near["c"]), (4, texts["c"]),
            (None, texts["d"]), (None, texts["d"]), (9, texts["d"]), (5, None), (5, ""), (6, "x y"), (6, "x y"), (7, "x y")]
    rng.shuffle(rows)
    sets = [minhash_set(t) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    found = minhash.near_duplicates(frame(rows), percent=80).collect()
    assert Counter((r.doc_id, r.component_id) for r in found) == expected([i for i, _ in rows], links)
    assert all(r.kept == (None if r.doc_id is None else r.doc_id == r.component_id) for r in found)


def minhash_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_vectors_that_share_ids(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8))
    rows = [(int(rng.integers(1, 12)) if k % 7 else None, (base[k % 6] + rng.normal(scale=0.12, size=8)).tolist(),
             "ab"[k % 2]) for k in range(60)]
    rows += [(1, [1.0] + [0.0] * 7, "c"), (1, [0.0, 1.0] + [0.0] * 6, "c"), (2, [1.0] + [0.0] * 7, "c"), (2, None, "c")]
    unit = [None if v is None else np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2)
             if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.93]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(3)
    found = vectors.near_vectors(table).collect()
    assert Counter((r.vec_id, r.component_id) for r in found) == expected([r[0] for r in rows], links)
    degree = Counter(x for a, b in links if rows[a][0] is not None and rows[b][0] is not None for x in (a, b))
    assert Counter((r.vec_id, r.n_links) for r in found) == Counter((rows[k][0], degree[k]) for k in range(len(rows)))
