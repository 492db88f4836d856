"""Units: stretches of text that a tokenizer handles on their own.

A tokenizer that never joins two neighbouring bytes gives the same tokens when
the text is cut between them. Cut there, most of a corpus repeats few units,
and each distinct unit of a part of a batch is tokenized once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from casoteca.llm.text import hashes, segments


def cut(data: np.ndarray, offsets: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Begin of every unit; ``joined[a, b]`` says that a cut between bytes a and b is wrong."""
    if not len(data):
        return np.zeros(0, np.int64)
    begins = np.zeros(len(data), bool)
    begins[1:] = ~joined[data[:-1], data[1:]]
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(begins)


def distinct(data: np.ndarray, start: np.ndarray,
             end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct units, where one of each lies, and which one every unit is."""
    return np.unique(hashes(data, start, end), return_index=True, return_inverse=True)


class Known:
    """What distinct units became, kept from part to part of a task, up to ``limit`` units."""

    def __init__(self, limit: int = 1_000_000, values: type = np.int64):
        self.limit, self.type = limit, values
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.values = np.zeros(0, self.type)

    def look_up(self, keys: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]],
                ) -> tuple[np.ndarray, np.ndarray]:
        """(begin, size) in ``self.values`` for sorted distinct ``keys``.

        ``make`` gets the positions of unknown keys and returns all their values
        and how many each has.
        """
        at = np.searchsorted(self.keys, keys)
        found = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        found[inside] = self.keys[at[inside]] == keys[inside]
        if not found.all():
            if len(self.keys) + np.count_nonzero(~found) > self.limit and len(self.keys):
                self._clear()
                return self.look_up(keys, make)
            new = np.flatnonzero(~found)
            values, size = make(new)
            begin = len(self.values) + np.cumsum(size) - size
            self.values = np.concatenate((self.values, np.asarray(values, self.values.dtype)))
            place = np.searchsorted(self.keys, keys[new])
            self.keys = np.insert(self.keys, place, keys[new])
            self.begin = np.insert(self.begin, place, begin)
            self.size = np.insert(self.size, place, size)
            at = np.searchsorted(self.keys, keys)
        return self.begin[at], self.size[at]


def spread(values: np.ndarray, begin: np.ndarray, size: np.ndarray,
           which: np.ndarray) -> np.ndarray:
    """The values of every unit, one unit after another."""
    n = size[which]
    return values[np.repeat(begin[which], n) + segments(n)]


def unit_texts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist())]
