"""Benchmark decontamination with suffix arrays over shards of the training words.

Each part of a training partition is a shard. Its words become integers, its
suffixes are sorted, and every suffix of every benchmark item is looked up by
binary search. A range of the suffix array gives all places where a window of
the item occurs; every suffix with that window is extended at each of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casoteca.llm.text import ALNUM, LOWER, hashes, parts, segments, text_bytes, word_bounds

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text that one pass over the documents takes along.
BLOCK_BYTES = 16 << 20
#: Pairs of suffixes and places that are compared at once.
PAIRS = 1 << 20
#: A verbatim match: first word in the item, first word in the document, words.
MATCH = "struct<item_id: bigint, item_start: bigint, start: bigint, length: bigint>"


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the index of each text's first word."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    start, end, first = word_bounds(data, offsets, ALNUM)
    return hashes(data, start, end), first


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of word sequences in the order of their first ``depth`` words.

    ``ids`` are word numbers from 1 on, ``left`` the words from each place to the
    end of its document; the end sorts before every word. Each round triples
    the sorted depth and looks only at suffixes that are still tied. Three ranks
    fit one 64-bit key below 2**21 words; longer sequences sort by three keys.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    bits = np.uint64(21)
    rank, sorted_to, step = ids.astype(np.uint64), 1, 1
    order = np.arange(n)
    tied = np.ones(n, bool)            # places in ``order`` that share their rank
    while True:
        places = np.flatnonzero(tied)
        at = order[places]

        def ahead(k: int) -> np.ndarray:
            out = np.zeros(len(at), np.uint64)
            near = left[at] > k
            out[near] = rank[at[near] + k]
            return out

        keys = [rank[at], ahead(step), ahead(2 * step)]
        if n < 1 << 21:
            keys = [keys[0] << (bits + bits) | keys[1] << bits | keys[2]]
            by = np.argsort(keys[0], kind="stable")
        else:
            by = np.lexsort(keys[::-1])
        at = at[by]
        order[places] = at
        new = np.zeros(len(at), bool)
        new[:1] = True
        for key in keys:
            new[1:] |= key[by[1:]] != key[by[:-1]]
        fresh = places[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))] + 1
        rank = rank.copy()
        if sorted_to == 1:
            rank[:] = 0
        rank[at] = fresh.astype(np.uint64)
        sorted_to *= 3
        step = sorted_to
        last = np.append(new[1:], True) if len(new) else new
        tied = np.zeros(n, bool)
        tied[places[~(new & last)]] = True
        if sorted_to >= depth or not tied.any():
            return order


@dataclass
class Items:
    """Benchmark items as word hashes, with every suffix that starts a window."""

    item_ids: np.ndarray
    words: np.ndarray
    begin: np.ndarray      # of each suffix, in ``words``
    need: np.ndarray       # words of its window
    length: np.ndarray     # words to the end of its item
    item: np.ndarray       # index of its item
    inside: np.ndarray     # words before it in its item

    @classmethod
    def build(cls, rows: list[tuple[int, str | None]], window: int) -> Items:
        words, first = words_of(pa.array([t for _, t in rows], pa.string()))
        count = np.diff(first)
        suffixes = np.where(count >= window, count - window + 1, (count > 0).astype(np.int64))
        item = np.repeat(np.arange(len(rows)), suffixes)
        inside = np.arange(suffixes.sum()) - np.repeat(np.cumsum(suffixes) - suffixes, suffixes)
        begin = first[item] + inside
        return cls(np.array([i for i, _ in rows], np.int64), words, begin,
                   np.minimum(count[item], window), count[item] - inside, item, inside)


def _compare(ids: np.ndarray, left: np.ndarray, at: np.ndarray, query: np.ndarray,
             begin: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common words of suffixes and queries (up to ``most``), and whether the suffix is smaller."""
    same = np.zeros(len(at), np.int64)
    smaller = np.zeros(len(at), bool)
    live = np.arange(len(at))
    k = 0
    while len(live):
        live = live[most[live] > k]
        place = at[live]
        ours = np.where(left[place] > k, ids[np.minimum(place + k, len(ids) - 1)], 0)
        theirs = query[begin[live] + k]
        smaller[live] = ours < theirs
        live = live[ours == theirs]
        same[live] += 1
        k += 1
    return same, smaller


def _search(order: np.ndarray, ids: np.ndarray, left: np.ndarray, query: np.ndarray,
            begin: np.ndarray, most: np.ndarray, after: bool) -> np.ndarray:
    """First place in the suffix array not before (or beyond) the queries' first words."""
    low, high = np.zeros(len(begin), np.int64), np.full(len(begin), len(order), np.int64)
    while True:
        live = np.flatnonzero(low < high)
        if not len(live):
            return low
        middle = (low[live] + high[live]) >> 1
        same, smaller = _compare(ids, left, order[middle], query, begin[live], most[live])
        right = smaller | ((same == most[live]) & after)
        low[live[right]] = middle[right] + 1
        high[live[~right]] = middle[~right]


@dataclass
class Shard:
    """A shard's words as numbers, its items' words in the same numbers, and where windows occur."""

    ids: np.ndarray
    left: np.ndarray       # words from each place to the end of its document
    query: np.ndarray      # words of the items; -1 if the shard does not have them
    suffix: np.ndarray     # for each occurrence of a window, the suffix that stands for it
    place: np.ndarray      # and where it occurs


def search_shard(words: np.ndarray, first: np.ndarray, items: Items, suffixes: np.ndarray) -> Shard:
    """Look up the windows of the chosen suffixes of ``items`` in one shard."""
    known, ids = np.unique(words, return_inverse=True)
    ids = ids + 1
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(words))
    order = suffix_array(ids, left, int(items.need.max(initial=1)))
    at = np.searchsorted(known, items.words)
    there = at < len(known)
    there[there] = known[at[there]] == items.words[there]
    query = np.where(there, at + 1, -1)
    begin, need = items.begin[suffixes], items.need[suffixes]
    gaps = np.concatenate(([0], np.cumsum(query < 0)))
    able = gaps[begin + need] == gaps[begin]
    suffixes, begin, need = suffixes[able], begin[able], need[able]
    low = _search(order, ids, left, query, begin, need, False)
    size = _search(order, ids, left, query, begin, need, True) - low
    place = order[np.repeat(low, size) + segments(size)]
    return Shard(ids, left, query, np.repeat(suffixes, size), place)


@dataclass
class Windows:
    """The distinct windows of the items: one suffix stands for all suffixes with the same window."""

    chosen: np.ndarray
    members: np.ndarray    # all suffixes, those of one window together
    begin: np.ndarray      # of a chosen suffix's window, in ``members``
    count: np.ndarray

    @classmethod
    def build(cls, items: Items) -> Windows:
        seen: dict[tuple, int] = {}
        same = np.array([seen.setdefault(tuple(items.words[b:b + n].tolist()), i)
                         for i, (b, n) in enumerate(zip(items.begin, items.need))], np.int64)
        count = np.bincount(same, minlength=len(same))
        return cls(np.unique(same), np.argsort(same, kind="stable"), np.cumsum(count) - count, count)


def matches(shard: Shard, items: Items, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix, place and words of every verbatim match that no word before it prolongs.

    A suffix that begins inside such a match has what is left of it.
    """
    count = windows.count[shard.suffix]
    ends = np.cumsum(count)
    out = [(np.zeros(0, np.int64),) * 3]
    at = 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        n = count[at:to]
        place = np.repeat(shard.place[at:to], n)
        suffix = windows.members[np.repeat(windows.begin[shard.suffix[at:to]], n) + segments(n)]
        # the words before both; at a document's first word the one before has a single word left
        inner = (items.inside[suffix] > 0) & (place > 0) & (shard.left[place - 1] > 1)
        before = items.begin[suffix] - 1
        whole = ~(inner & (shard.ids[place - 1] == shard.query[before]))
        suffix, place = suffix[whole], place[whole]
        length, _ = _compare(shard.ids, shard.left, place, shard.query, items.begin[suffix],
                             np.minimum(items.length[suffix], shard.left[place]))
        out.append((suffix, place, length))
        at = to
    return tuple(map(np.concatenate, zip(*out)))


#: The text among the fields of a whole row.
INSIDE = "_whole_text"


def _text(batch: pa.RecordBatch) -> pa.Array:
    """The text, which the row holds if all columns are asked for."""
    row = batch["row"]
    return row.field(INSIDE) if pa.types.is_struct(row.type) and row.type.get_field_index(INSIDE) >= 0 else batch["text"]


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts by the size of the text, wherever it is."""
    for batch in batches:
        sized = pa.RecordBatch.from_arrays([*batch.columns, _text(batch)], [*batch.schema.names, "_sized"])
        for part in parts(iter([sized]), "_sized"):
            yield part.select(batch.schema.names)


def _hits(part: pa.RecordBatch, items: Items, windows: Windows, last: bool) -> pa.RecordBatch:
    """The rows of a part with what this block of the benchmark adds to what earlier ones found."""
    words, first = words_of(_text(part))
    shard = search_shard(words, first, items, windows.chosen)
    reach = np.zeros(len(words) + 1, np.int64)
    np.add.at(reach, shard.place, 1)
    np.add.at(reach, shard.place + items.need[shard.suffix], -1)
    hit = np.cumsum(reach[:-1]) > 0
    suffix, place, length = matches(shard, items, windows)
    doc = np.searchsorted(first, place, side="right") - 1
    longest = np.asarray(part["longest"], np.int64).copy()
    np.maximum.at(longest, doc, length)
    found: dict[int, set[tuple]] = {}
    for d, *match in zip(*(x.tolist() for x in (doc, items.item_ids[items.item[suffix]], items.inside[suffix],
                                                place - first[doc], length))):
        found.setdefault(d, set()).add(tuple(match))
    lists, spans = part["items"].to_pylist(), part["matches"].to_pylist()
    for d, more in found.items():
        lists[d] = sorted({m[0] for m in more}.union(lists[d]))
        spans[d] += [dict(zip(("item_id", "item_start", "start", "length"), m)) for m in sorted(more)]
    for d, bits in enumerate(part["hit"].to_pylist()):
        if bits:
            mine = slice(first[d], first[d + 1])
            hit[mine] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=first[d + 1] - first[d]) > 0
    total = np.concatenate(([0], np.cumsum(hit)))
    n_hit = total[first[1:]] - total[first[:-1]]
    bits = [np.packbits(hit[a:b]).tobytes() if n and not last else b""
            for a, b, n in zip(first[:-1], first[1:], n_hit)]
    text = pa.nulls(part.num_rows, pa.string()) if last else part["text"]    # or it is in the row
    return pa.RecordBatch.from_arrays(
        [part["row"], text, pa.array(bits, pa.binary()), pa.array(np.diff(first)), pa.array(n_hit),
         pa.array(lists, pa.list_(pa.int64())), pa.array(longest), pa.array(spans, part["matches"].type)],
        ["row", "text", "hit", "n_words", "n_hit", "items", "longest", "matches"])


def _blocks(benchmark: DataFrame, id_column: str, text_column: str) -> list[tuple[int, int]]:
    """Bounds of item ids whose texts have at most ``BLOCK_BYTES`` together, one id at least.

    A range with more bytes is halved at its median id until its own sum fits.
    """
    sized = benchmark.select(F.col(id_column).cast("long").alias("item_id"),
                             F.coalesce(F.octet_length(F.col(text_column).cast("string")), F.lit(0)).alias("size"))
    ranges, fit = [(-(1 << 63), (1 << 63) - 1)], []
    while ranges:
        low, high = ranges.pop()
        size, least, most, middle = sized.where(F.col("item_id").between(low, high)).agg(
            F.sum("size"), F.min("item_id"), F.max("item_id"), F.percentile_approx("item_id", 0.5)).first()
        if least is None:
            continue
        if size <= BLOCK_BYTES or least == most:
            fit.append((low, high))
        else:
            cut = min(middle, most - 1)
            ranges += [(cut + 1, high), (low, cut)]
    return fit


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  id_column: str = "doc_id", text_column: str = "text",
                  item_column: str = "item_id", item_text: str = "text", whole_rows: bool = False) -> DataFrame:
    """Words of each document that lie in an occurrence of a benchmark window.

    Text is compared by lower-cased words of letters and digits. A window is
    ``window`` consecutive words of an item; an item with fewer words, but not
    none, is one window. The benchmark goes along with the tasks in blocks of
    checked size (``BLOCK_BYTES``); each block is one pass over the documents.

    Returns one row per document row: the id, n_words, n_hit, items (ids of items
    with occurring windows), n_items, items_sha256 (of those ids sorted as
    strings and joined by commas), longest_match (words of the document's longest
    verbatim match that starts with a window), contaminated, matches (item_id,
    item_start, start and length in words of every verbatim match that starts
    with a window and that no word before it prolongs).
    NULL and empty texts have no words; items without an id are left out;
    repeated documents get a row each; other columns are not looked at. With
    ``whole_rows`` all columns come back in place of the id, as one named ``row``.
    """
    text = F.col(text_column).cast("string")
    if whole_rows:      # the text goes along once, as a part of the row
        row = F.struct(*(F.col(f"`{c}`") for c in documents.columns if c != text_column), text.alias(INSIDE))
        text = F.lit(None).cast("string")
    else:
        row = F.col(id_column)
    found = documents.select(
        row.alias("row"), text.alias("text"),
        F.lit(b"").alias("hit"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
        F.array().cast("array<long>").alias("items"), F.lit(0).cast("long").alias("longest"),
        F.array().cast(f"array<{MATCH}>").alias("matches"))
    schema = StructType([found.schema["row"], *StructType.fromDDL(
        "text string, hit binary, n_words long, n_hit long, items array<long>, longest long, "
        f"matches array<{MATCH}>")])
    bounds = _blocks(benchmark, item_column, item_text) or [(0, -1)]
    for low, high in bounds:
        block = benchmark.select(F.col(item_column).cast("long"), F.col(item_text).cast("string")) \
            .where(F.col(item_column).between(low, high))
        items = Items.build([tuple(r) for r in block.collect()], window)
        windows = Windows.build(items)

        def run(batches: Iterator[pa.RecordBatch], items: Items = items, windows: Windows = windows,
                last: bool = (low, high) == bounds[-1]) -> Iterator[pa.RecordBatch]:
            for part in _sliced(batches):
                yield _hits(part, items, windows, last)

        found = found.mapInArrow(run, schema)
    listed = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    if whole_rows:
        given = F.struct(*(F.col("row").getField(INSIDE if c == text_column else c).alias(c) for c in documents.columns)).alias("row")
    else:
        given = F.col("row").alias(id_column)
    return found.select(
        given, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "items", F.col("longest").alias("longest_match"),
        "matches")
