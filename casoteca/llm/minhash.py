"""MinHash near-dedup with SuperMinHash signatures.

Documents become sets of word shingles; documents with equal sets become one class.
A SuperMinHash signature of every class is cut into bands. Classes that share a
band are candidates; they are compared on their full sets and linked classes are
grouped with union-find. All candidates that could still change a group are compared:

* rounds compare every class of a bucket with one leader of the bucket (other
  bands have other leaders), leaving out pairs that are in one group already;
* a closing pass compares what is left: pairs of a bucket in different groups.

Parity bits of the sets, an exact bound, rule out most pairs before their sets move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casoteca.llm.components import components, over_rows
from casoteca.llm.text import (LOWER, PART_BYTES, SPACED, hashes, mix, parts, segments, text_bytes, windows,
                               word_bounds)
from casoteca.sources.session import freed_shuffles
from casoteca.sources.workspace import cut_lineage

SHINGLE = 5
#: Signature places; bands x rows use the first of them.
PLACES = 128
#: At a similarity of 0.85 a pair shares no band with probability 4e-7.
BANDS, ROWS = 25, 5
#: Elements whose permutations are worked on at a time.
_CHUNK = 1 << 15
#: Bands of each leader round.
ROUNDS = ((0, 2), (2, 25))
#: Columns of 64 parity bits each; a pair is looked at closer only if these bits allow a link.
PARITY = [f"p{i}" for i in range(8)]


def shingle_sets(column: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in rising order, and where each text's begin.

    Words are lower-cased (A-Z) and split at white space. A text with fewer words
    than ``width`` is one shingle; a text without words has none.
    """
    data, offsets = text_bytes(column)
    data = LOWER[data]
    start, end, first = word_bounds(data, offsets, SPACED)
    words = hashes(data, start, end)
    begin, value = windows(words, first, width)
    doc = np.searchsorted(first, begin, side="right") - 1
    count = np.diff(first)
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        whole = np.zeros(len(few), np.uint64)
        for k in range(width - 1):
            more = count[few] > k
            whole[more] = mix(whole[more] * np.uint64(3) + words[first[few[more]] + k] + np.uint64(k + 1))
        value, doc = np.concatenate((value, whole)), np.concatenate((doc, few))
    by = np.lexsort((value, doc))
    value, doc = value[by], doc[by]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.searchsorted(doc[new], np.arange(len(column) + 1))


def super_minhash(value: np.ndarray, first: np.ndarray, places: int = PLACES) -> np.ndarray:
    """SuperMinHash signatures, a row per set; empty sets get the largest number everywhere.

    Every element walks through a random permutation of the places. In step j
    it offers j plus a random fraction to its j-th place, so early steps give the
    small numbers. A set stops when no place holds more than the next step offers.
    """
    out = np.full((len(first) - 1, places), np.iinfo(np.uint64).max, np.uint64)
    low = 0
    while low < len(first) - 1:
        high = max(low + 1, int(np.searchsorted(first, first[low] + _CHUNK, side="right")) - 1)
        _signatures(value[first[low]:first[high]], first[low:high + 1] - first[low], out[low:high])
        low = high
    return out


def _signatures(value: np.ndarray, first: np.ndarray, out: np.ndarray) -> None:
    places = out.shape[1]
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    flat = out.ravel()
    order = None
    for j in range(places):
        random = mix(value + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        other = j + ((random & np.uint64(0xFFFFFF)) % np.uint64(places - j)).astype(np.int64)
        if order is None:
            place = other
        else:
            rows = np.arange(len(value))
            place = order[rows, other].astype(np.int64)
            order[rows, other] = order[:, j]
        offer = np.uint64(j) << np.uint64(40) | random >> np.uint64(24)
        np.minimum.at(flat, owner * places + place, offer)
        open_ = (out >= np.uint64(j + 1) << np.uint64(40)).any(axis=1)
        live = open_[owner]
        if not live.any():
            return
        if order is None:
            value, owner, other = value[live], owner[live], other[live]
            order = np.tile(np.arange(places, dtype=np.uint8), (len(value), 1))
            order[np.arange(len(value)), other] = 0
        elif not live.all():
            value, owner, order = value[live], owner[live], order[live]


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.empty((len(signatures), bands), np.int64)
    for b in range(bands):
        key = np.full(len(signatures), b, np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(31) + signatures[:, b * rows + r])
        out[:, b] = key.view(np.int64)
    return out


def parity_bits(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """512 bits of each set as eight numbers: is the count of elements that fall on a bit odd?

    Two sets differ in at least as many elements as their bits differ.
    """
    n, width = len(first) - 1, len(PARITY)
    slot = np.repeat(np.arange(n), np.diff(first)) * width + (value >> np.uint64(61)).astype(np.int64)
    odd = np.zeros(len(value) + 1, np.uint64)
    np.bitwise_xor.accumulate(np.uint64(1) << (value >> np.uint64(55) & np.uint64(63)), out=odd[1:])
    edge = odd[np.searchsorted(slot, np.arange(n * width + 1))]
    return (edge[1:] ^ edge[:-1]).view(np.int64).reshape(n, width)


def _may_link(x: str, y: str, percent: int) -> Column:
    """False only for pairs that their sizes or parity bits rule out: an exact bound, no estimate.

    With sizes summing to s and d elements in one set only, the similarity is (s - d) / (s + d).
    The columns of either side end in ``x`` and ``y``.
    """
    nx, ny = F.col("n" + x), F.col("n" + y)
    differ = sum((F.bit_count(F.col(p + x).bitwiseXOR(F.col(p + y))) for p in PARITY), F.lit(0))
    return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) \
        & (differ * (100 + percent) <= (nx + ny) * (100 - percent))


def _lists(first: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(first.astype(np.int32), pa.array(values))


def _sketches(rows: DataFrame, width: int) -> DataFrame:
    """id, n (size of the set), two numbers that stand for the set, a key for each band, parity bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, size=PART_BYTES // 2):
            value, first = shingle_sets(part["text"], width)
            size = np.diff(first)
            totals = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(s)))))
                      for s in (11, 12)]
            d1, d2 = (mix(t[first[1:]] - t[first[:-1]] + size.astype(np.uint64)).view(np.int64) for t in totals)
            keys = band_keys(super_minhash(value, first))
            lists = _lists(np.arange(part.num_rows + 1) * BANDS, keys.ravel())
            bits = [pa.array(b) for b in parity_bits(value, first).T]
            yield pa.RecordBatch.from_arrays(
                [part["id"], pa.array(size), pa.array(d1), pa.array(d2), lists, *bits],
                ["id", "n", "d1", "d2", "keys", *PARITY])

    return rows.mapInArrow(run, "id long, n long, d1 long, d2 long, keys array<long>, "
                           + ", ".join(f"{p} long" for p in PARITY))


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """node and the bytes of its set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, size=PART_BYTES // 2):
            value, first = shingle_sets(part["text"], width)
            raw = value.tobytes()
            sets = pa.array([raw[8 * a:8 * b] for a, b in zip(first[:-1], first[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([part["id"], sets], ["node", "shingles"])

    return rows.mapInArrow(run, "node long, shingles binary")


#: Rows of two or three numbers up to which a table goes along with the tasks (some 50 MB).
FEW_ROWS = 2_000_000


def few_rows(table: DataFrame) -> DataFrame:
    """The table, marked for broadcast if a count shows that it is small; else it is shuffled."""
    return F.broadcast(table) if table.limit(FEW_ROWS + 1).count() <= FEW_ROWS else table


def _linked(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Those of the (distinct) pairs a < b whose full sets are similar enough.

    Sizes and parity bits rule most pairs out before any set moves. Sets
    move once a pair on one side and once a distinct document on the other.
    """
    a, b = (sizes.select(F.col("node").alias(s), *(F.col(c).alias(c + s) for c in ("n", *PARITY))) for s in "ab")
    near = cut_lineage(pairs.join(a, "a").join(b, "b").where(_may_link("a", "b", percent)).select("a", "b"))
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")) \
        .join(few_rows(near.select("a").distinct()), "a", "left_semi")
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).join(few_rows(near), "b")
    both = other.join(one, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch["x"], batch["y"])):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                z = np.concatenate((x, y))
                z.sort()
                common = np.count_nonzero(z[1:] == z[:-1])
                ok[i] = 100 * common >= percent * (len(x) + len(y) - common)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, percent: int = 85, width: int = SHINGLE,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Groups of documents whose shingle sets overlap by ``percent`` or more.

    Returns per document row: the id, n_shingles (size of its set), component_id
    (smallest id reachable by links, itself included), kept (id = component_id).
    NULL texts and texts without words have empty sets and link with nothing. Rows
    that share an id are compared like others, row by row; a row without an id has no
    links. Other columns are not looked at.
    """
    rows = documents.select(F.col(id_column).cast("long").alias("id"),
                            F.col(text_column).cast("string").alias("text"))
    with freed_shuffles(documents.sparkSession):
        return over_rows(rows, lambda r: _near_rows(r, percent, width)).withColumnRenamed("id", id_column)


def _near_rows(rows: DataFrame, percent: int, width: int) -> DataFrame:
    """``near_duplicates`` of rows with unique ids."""
    spark = rows.sparkSession
    sketches = cut_lineage(_sketches(rows, width))
    described = sketches.select("id", "n", "d1", "d2")
    heads = cut_lineage(described.where("n > 0 and id is not null").groupBy("d1", "d2", "n")
                        .agg(F.min("id").alias("node")))
    bands = heads.join(sketches.withColumnRenamed("id", "node"), ["node", "n", "d1", "d2"]) \
        .select("node", F.posexplode("keys").alias("band", "key"))
    firsts = bands.groupBy("band", "key").agg(
        F.min_by("node", F.xxhash64("node", "band")).alias("leader"), F.count("*").alias("size")).where("size > 1")
    buckets = cut_lineage(bands.join(firsts, ["band", "key"]).select("band", "key", "node", "leader"))
    # only documents that share a band with others are read once more, for their full sets
    candidates = cut_lineage(buckets.select(F.col("node").alias("id")).distinct())
    sizes = cut_lineage(sketches.select("id", "n", *PARITY).join(few_rows(candidates), "id", "left_semi")
                        .withColumnRenamed("id", "node").distinct())
    sets = cut_lineage(_sets(rows.join(few_rows(candidates), "id", "left_semi"), width))
    links = spark.createDataFrame([], "a long, b long")
    groups = spark.createDataFrame([], "node long, component long")
    compared = links
    for low, high in ROUNDS:
        star = buckets.where(F.col("band").between(low, high - 1) & (F.col("node") != F.col("leader"))) \
            .select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
        pairs = cut_lineage(_apart(star, groups).join(compared, ["a", "b"], "left_anti"))
        found = cut_lineage(_linked(pairs, sets, sizes, percent))
        compared = compared.unionByName(pairs)
        links = links.unionByName(found)
        groups = components(links)
    # Closing: within a bucket, classes in different groups that were not compared.
    member = buckets.join(groups, "node", "left").select(
        "band", "key", "node", F.coalesce("component", "node").alias("group"))
    mixed = member.groupBy("band", "key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")) \
        .where("lo != hi").select("band", "key")
    open_ = member.join(mixed, ["band", "key"]).join(sizes, "node")
    open_ = cut_lineage(open_)
    x, y = (open_.select("band", "key", *(F.col(c).alias(c + s) for c in ("node", "group", "n", *PARITY)))
            for s in "xy")
    rest = x.join(y, ["band", "key"]).where(
        (F.col("nodex") < F.col("nodey")) & (F.col("groupx") != F.col("groupy"))
        & _may_link("x", "y", percent)) \
        .select(F.col("nodex").alias("a"), F.col("nodey").alias("b")).distinct()
    rest = cut_lineage(rest.join(compared, ["a", "b"], "left_anti"))
    more = cut_lineage(_linked(rest, sets, sizes, percent))
    groups = components(links.unionByName(more))
    per_class = heads.join(groups, "node", "left").select(
        "d1", "d2", "n", F.coalesce("component", "node").alias("component"))
    out = described.join(per_class, ["d1", "d2", "n"], "left")
    own = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component"))
    return out.select(
        "id", F.col("n").alias("n_shingles"),
        F.coalesce(own, F.col("id")).alias("component_id"),
        (F.coalesce(own, F.col("id")) == F.col("id")).alias("kept"))


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose ends are not known to be in one group."""
    a = groups.select(F.col("node").alias("a"), F.col("component").alias("ga"))
    b = groups.select(F.col("node").alias("b"), F.col("component").alias("gb"))
    return pairs.join(a, "a", "left").join(b, "b", "left") \
        .where("ga is null or gb is null or ga != gb").select("a", "b")
