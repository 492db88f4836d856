"""Repeats, near duplicates, benchmark passages and vectors against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from text_fixtures import SF, frame, shipped  # noqa: F401

from casoteca.llm import components, decontaminate, minhash, repeats, vectors


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def union(n, links):
    parent = {i: i for i in n}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def removed(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        words, gone = spaced(text), set()
        for a in range(len(words) - 19):
            window = tuple(words[a:a + 20])
            if window in seen:
                gone.update(range(a, a + 20))
            seen.add(window)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("dealt", [repeats.DEAL_WORDS, 30])
def test_repeats(spark, frame, documents, monkeypatch, dealt):
    monkeypatch.setattr(repeats, "DEAL_WORDS", dealt)
    random.seed(5)
    some = [f"w{i}" for i in range(6)]
    base = [random.choice(some) for _ in range(200)]
    rows = [(1000, None), (1001, ""), (1002, "a " * 19), (1003, "a " * 100), (1004, "x y\t" * 40)]
    for i in range(40):
        a = random.randrange(150)
        rows.append((-i, " ".join(base[a:a + random.randrange(15, 60)] + random.choices(some, k=30))))
    for data in (rows, documents):
        expected = removed(data)
        found = repeats.remove_repeats(frame(data), keep_text=True).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in found} == expected
        assert len(found) == len(data)
    odd = frame([(None, "q " * 30), (None, "q " * 30), (1, "q " * 30), (1, "q " * 30), (1, "z")])
    assert sorted(r.n_removed for r in repeats.remove_repeats(odd).collect()) == [0, 0, 0, 0, 29]
    assert repeats.remove_repeats(frame([])).count() == 0


def test_parity_bits_bound_the_difference():
    draw = np.random.default_rng(3)
    pool = draw.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(draw.choice(pool, n)) for n in (0, 1, 5, 60, 400, 400, 2500)]
    bits = minhash.parity_bits(np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets]))
    for x, p in zip(sets, bits):
        for y, q in zip(sets, bits):
            apart = sum(int(v).bit_count() for v in (p ^ q).view(np.uint64))
            differ = len(np.setxor1d(x, y))
            assert apart <= differ and apart % 2 == differ % 2
            assert differ > 60 or apart > 0.7 * differ or differ == apart


def groups(rows, percent=85):
    sets = {}
    for i, text in rows:
        words = spaced(lower(text))
        sets[i] = {tuple(words)} if 0 < len(words) < 5 else {tuple(words[k:k + 5]) for k in range(len(words) - 4)}
    index, links = {}, []
    for i in sorted(sets):
        common = {}
        for shingle in sets[i]:
            for j in index.setdefault(shingle, []):
                common[j] = common.get(j, 0) + 1
            index[shingle].append(i)
        links += [(i, j) for j, n in common.items() if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n)]
    return {i: (len(sets[i]), c) for i, c in union(sets, links).items()}


def test_near_duplicates(frame, documents):
    rows = documents + [(9000, None), (9001, ""), (9002, "a b"), (9003, "A  b"), (9004, "x " * 900), (9005, "x " * 7)]
    found = minhash.near_duplicates(frame(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == groups(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    empty = minhash.near_duplicates(frame([]))
    assert empty.count() == 0


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(3)
    for similarity in (0.3, 0.85):
        a = rng.integers(0, 2**63, 400).astype(np.uint64)
        k = int(800 * similarity / (1 + similarity))
        b = np.concatenate((a[:k], rng.integers(0, 2**63, 400 - k).astype(np.uint64)))
        x, y = minhash.super_minhash(np.concatenate((a, b)), np.array([0, 400, 800]))
        assert abs((x == y).mean() - similarity) < 0.15
    assert len(set((minhash.super_minhash(a[:1], np.array([0, 1]))[0] >> np.uint64(40)).tolist())) == minhash.PLACES


def hits(rows, items, window=10):
    words = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    known = {}
    for i, text in items:
        w = words(text)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if w and i is not None else 0):
            known.setdefault(tuple(w[a:a + k]), set()).add(i)
    out = {}
    for i, text in rows:
        w, hit, met = words(text), set(), set()
        for k in {len(x) for x in known}:
            for a in range(len(w) - k + 1):
                if (found := known.get(tuple(w[a:a + k]))) is not None:
                    met |= found
                    hit.update(range(a, a + k))
        digest = hashlib.sha256(",".join(sorted(map(str, met))).encode()).hexdigest()
        out[i] = (len(w), len(hit), len(met), digest, bool(hit))
    return out


@pytest.mark.parametrize("block", [1 << 24, 60])
def test_contamination(spark, frame, documents, monkeypatch, block):
    items = [(1, "a b"), (2, None), (3, "b c d"), (4, "a b " * 6), (5, "q " * 12), (6, "..."), (None, "zz")]
    rows = [(1, "a b c d"), (2, None), (3, ""), (4, "x " + "a b " * 8), (5, "A, b c"), (6, "q " * 60), (7, "zz")]
    if block > 60:
        items += [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id + 100", "text").collect()]
        rows += [(i + 100, t) for i, t in documents]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    found = decontaminate.contamination(frame(rows), frame(items, "item_id")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found} == hits(rows, items)
    none = decontaminate.contamination(frame(rows), frame([], "item_id")).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n, v in ((0, 1), (1, 1), (300, 2), (2000, 50)):
        first = np.array([0, n // 3, n // 3, n])
        ids = rng.integers(1, v + 1, n)
        left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
        order = decontaminate.suffix_array(ids, left, 40)
        keys = [tuple(ids[i:i + min(left[i], 40)]) for i in range(n)]
        assert [keys[i] for i in order] == sorted(keys)


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * 0.25).tolist(), i % 2) for i in range(300)]
    rows += [(300 + i, [1.0, 0.5], 1) for i in range(40)]
    rows += [(400, [1.0, 0.0], None), (401, None, 1), (402, [0.0, 0.0], 1), (403, [nan, 1.0], 1), (404, [inf, 1.0], 1),
             (405, [1.0, None], 1), (406, [], 1), (407, [1e300, 5e299], 1), (408, [-0.0, 1.0], 3), (409, [0.0, 1.0], 3)]
    unit, links = {}, []
    for i, v, label in rows:
        if label is None or v is None or any(x is None for x in v):
            continue
        v = np.array(v)
        if np.isfinite(v).all() and v.any():
            v = v / np.abs(v).max()
            unit.setdefault((label, len(v)), []).append((i, v / np.linalg.norm(v)))
    for same in unit.values():
        links += [(a, b) for a, x in same for b, y in same if a < b and x @ y >= 0.93]
    component, counts = union([r[0] for r in rows], links), dict.fromkeys((r[0] for r in rows), 0)
    for pair in links:
        for i in pair:
            counts[i] += 1
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as node")
    found = vectors.near_vectors(table).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == {
        i: (counts[i], component[i], component[i] == i) for i in counts}
    assert vectors.near_vectors(table.limit(0)).count() == 0


def test_bound_drops_pairs_early():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 64)) * np.linspace(3, 0.1, 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j, work = vectors.near_pairs(x, x, 0.93)
    assert set(zip(*np.nonzero(x @ x.T >= 0.93))) <= set(zip(i.tolist(), j.tolist()))
    assert work < 200 * 200 * 64 / 2


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    found = components.components(spark.createDataFrame(chain, "a long, b long")).collect()
    expected = union({x for p in chain for x in p}, chain)
    assert {r.node: r.component for r in found} == expected and len(found) == len(expected)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
