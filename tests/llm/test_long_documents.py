"""Decontamination of single documents that no part boundary cuts."""

import numpy as np
import pytest
from test_duplicates import hits
from text_fixtures import frame, shipped  # noqa: F401

from casoteca.llm import decontaminate


def test_document_above_two_million_words(frame):
    leak = " ".join(f"leak{k}" for k in range(14))
    half = "a b c d " * 262_144
    rows = [(1, f"{half}{leak} {half}"), (2, leak), (3, "a b c")]
    items = [(1, leak), (2, "d a b c " * 3), (3, "a b c d d"), (4, "nowhere")]
    found = decontaminate.contamination(frame(rows), frame(items, "item_id")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found} == hits(rows, items)


@pytest.mark.parametrize("n", [(1 << 21) - 1, 1 << 21])
def test_suffix_array_on_both_sides_of_wide_keys(n):
    ids = np.random.default_rng(5).integers(1, 4000, n)
    order = decontaminate.suffix_array(ids, n - np.arange(n), 3)
    padded = np.append(ids, [0, 0])
    key = (padded[:-2] << 24) | (padded[1:-1] << 12) | padded[2:]
    assert (np.sort(order) == np.arange(n)).all() and (np.diff(key[order]) >= 0).all()
