"""Ranked lexical search over document FP-trees.

Documents are restricted to the terms that some query text has. In a tree, the restricted vectors are
written as paths of terms, most frequent first, so that documents share the beginnings of their paths. Every subtree
knows the largest count of each term and the smallest length weight among its documents. Both bound the
score of all its documents, so a depth-first search that has ten good documents leaves most subtrees out.

Each task makes trees of the documents it has, one after another, and keeps the best documents of each
query text from tree to tree. Nothing but these leaves the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casoteca.llm.text import ALNUM, LOWER, hashes, parts, segments, text_bytes, word_bounds
from casoteca.sources.workspace import cut_lineage

#: Pairs of a query text and a term that go along with the tasks at a time; more are searched in further passes.
BLOCK_PAIRS = 1 << 16
#: Documents times terms of one tree.
CELLS = 1 << 22
#: Subtrees with so many documents or fewer are scored at once.
LEAF = 64
#: Parts that the partial results of a query text are dealt to before the last ranking.
SALTS = 64

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST_ID = np.iinfo(np.int64).max


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(TERM), F.lit(0))


def worth(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The share of a term's weight that ``tf`` occurrences give; rises with tf and falls with m."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


@dataclass
class Terms:
    """Distinct terms of a block of query texts: their hashes in rising order and each text's terms."""

    item_ids: list[int | None]
    items: list[np.ndarray]
    keys: np.ndarray

    @classmethod
    def build(cls, pairs: list[tuple[int | None, str]]) -> Terms:
        raw = [t.encode() for _, t in pairs]
        size = np.array([len(t) for t in raw], np.int64)
        end = np.cumsum(size)
        values = hashes(np.frombuffer(b"".join(raw), np.uint8), end - size, end)
        keys, which = np.unique(values, return_inverse=True)
        item_ids = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i))
        at = {i: k for k, i in enumerate(item_ids)}
        owner = np.array([at[i] for i, _ in pairs], np.int64)
        return cls(item_ids, [np.unique(which[owner == k]) for k in range(len(item_ids))], keys)


def restricted(column: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text in all, and its terms among ``keys``: where they begin, which, how often."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    start, end, first = word_bounds(data, offsets, ALNUM)
    words = hashes(data, start, end)
    at = np.searchsorted(keys, words)
    at[at == len(keys)] = 0
    hit = np.flatnonzero(keys[at] == words) if len(keys) else np.zeros(0, np.int64)
    doc = np.searchsorted(first, hit, side="right") - 1
    pair, count = np.unique(doc * max(len(keys), 1) + at[hit], return_counts=True)
    doc, term = np.divmod(pair, max(len(keys), 1))
    return np.diff(first), np.searchsorted(doc, np.arange(len(column) + 1)), term, count


def _vectors(documents: DataFrame, terms: Terms) -> DataFrame:
    keys = terms.keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            n, first, term, count = restricted(part["text"], keys)
            first = first.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part["id"], pa.array(n), pa.ListArray.from_arrays(first, pa.array(term.astype(np.int32))),
                 pa.ListArray.from_arrays(first, pa.array(count))], ["id", "n", "terms", "counts"])

    found = documents.mapInArrow(run, "id long, n long, terms array<int>, counts array<long>")
    return cut_lineage(found.where("n > 0"))


@dataclass
class Tree:
    """Documents in the order of their paths; a node is a range of them.

    Node 0 is the root. Children of a node are neighbours; a node without children is scored
    document by document. ``value`` holds what each term is worth in each document, ``bound`` what it is
    worth at most below each node: with the largest tf and the smallest m of the subtree. Both are whole
    numbers below 10^6, so that sums of their products with weights are exact in doubles.
    """

    value: np.ndarray
    ids: np.ndarray
    low: list[int]
    high: list[int]
    children: list[tuple[int, int]]
    bound: np.ndarray
    least_id: list[int]

    @classmethod
    def build(cls, first: np.ndarray, rank: np.ndarray, count: np.ndarray, m: np.ndarray, ids: np.ndarray,
              width: int) -> Tree:
        """``rank``: the places of each document's terms in the order of frequency."""
        tf = np.zeros((len(m), width), np.int64)
        tf[np.repeat(np.arange(len(m)), np.diff(first)), rank] = count
        # documents in the order of their paths: the one that has the first term the other lacks comes first
        bits = np.packbits(tf > 0, axis=1)
        order = np.argsort(bits.view(f"S{bits.shape[1]}").ravel(), kind="stable")[::-1]
        tf, m, ids = tf[order], m[order], ids[order]
        path = [np.flatnonzero(row) for row in tf]
        low, high, children = [0], [len(m)], [(0, 0)]
        at = 0
        while at < len(low):
            a, b = low[at], high[at]
            if b - a > LEAF:
                x, y = path[a], path[b - 1]
                short = min(len(x), len(y))
                other = np.flatnonzero(x[:short] != y[:short])
                d = int(other[0]) if len(other) else short      # all documents of the range share d terms
                if d < max(len(x), len(y)):
                    following = np.array([p[d] if len(p) > d else -1 for p in path[a:b]])
                    begin = len(low)
                    for p, q in _ranges(np.flatnonzero(np.diff(following)) + a + 1, a, b):
                        low.append(p)
                        high.append(q)
                        children.append((0, 0))
                    children[at] = (begin, len(low))
            at += 1
        most, least_m = np.empty((len(low), width), np.int64), np.empty(len(low), np.int64)
        least_id = [0] * len(low)
        for i in range(len(low) - 1, -1, -1):
            p, q = children[i]
            if q > p:
                most[i], least_m[i], least_id[i] = most[p:q].max(0), least_m[p:q].min(), min(least_id[p:q])
            else:
                a, b = low[i], high[i]
                most[i], least_m[i], least_id[i] = tf[a:b].max(0), m[a:b].min(), int(ids[a:b].min())
        return cls(_values(tf, m), ids, low, high, children, _values(most, least_m), least_id)

    def search(self, items: list[tuple[np.ndarray, np.ndarray]], best: list[Best]) -> int:
        """Adds the documents of this tree to the best of each query text; gives the leaves looked at."""
        looked = 0
        for (terms, weight), mine in zip(items, best):
            bound = (self.bound[:, terms] @ weight).tolist()
            stack = [0]
            while stack:
                node = stack.pop()
                if not mine.open(bound[node], self.least_id[node]):
                    continue
                p, q = self.children[node]
                if q > p:
                    stack += sorted(range(p, q), key=bound.__getitem__)
                else:
                    a, b = self.low[node], self.high[node]
                    mine.add((self.value[a:b, terms] @ weight).astype(np.int64), self.ids[a:b])
                    looked += 1
        return looked


def _values(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``worth`` of every count, as doubles; most counts are 0."""
    out = np.zeros(tf.shape)
    row, column = np.nonzero(tf)
    out[row, column] = worth(tf[row, column], m[row])
    return out


def _ranges(cuts: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """Subtrees between the cuts; small neighbours are put together up to ``LEAF`` documents."""
    edges = [low, *cuts.tolist(), high]
    out: list[tuple[int, int]] = []
    for a, b in zip(edges[:-1], edges[1:]):
        if out and b - out[-1][0] <= LEAF:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


class Best:
    """The best documents of one query text: highest scores, then lowest ids."""

    def __init__(self, top: int):
        self.top = top
        self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def open(self, bound: int, least_id: int) -> bool:
        """Could a document with at most this score and at least this id be among the best?"""
        if bound <= 0:
            return False
        if len(self.score) < self.top:
            return True
        return bound > self.score[-1] or (bound == self.score[-1] and least_id < self.ids[-1])

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        good = score > 0
        if len(self.score) == self.top:
            good &= score >= self.score[-1]
        if not good.any():
            return
        score, ids = np.concatenate((self.score, score[good])), np.concatenate((self.ids, ids[good]))
        order = np.lexsort((ids, -score))[:self.top]
        self.score, self.ids = score[order], ids[order]


def _candidates(vectors: DataFrame, terms: Terms, weight: np.ndarray, rank: np.ndarray, total: int, words: int,
                top: int) -> DataFrame:
    """The best documents of each query text among those of each task."""
    width = max(len(terms.keys), 1)
    items = [(rank[t], weight[t].astype(float)) for t in terms.items]
    most = max(1, CELLS // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in items]
        for batch in batches:
            for low in range(0, batch.num_rows, most):
                part = batch.slice(low, most)
                lists = part["terms"]
                first = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
                place = rank[lists.flatten().to_numpy(zero_copy_only=False)]
                n = part["n"].to_numpy()
                m = 10 + 90 * n * total // words
                ids = part["id"].fill_null(_LAST_ID).to_numpy(zero_copy_only=False)
                tree = Tree.build(first, place, part["counts"].flatten().to_numpy(zero_copy_only=False), m, ids, width)
                tree.search(items, best)
        which = np.repeat(np.arange(len(items)), [len(b.score) for b in best])
        ids = np.concatenate([b.ids for b in best]) if best else np.zeros(0, np.int64)
        score = np.concatenate([b.score for b in best]) if best else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([terms.item_ids[i] for i in which.tolist()], pa.int64()), pa.array(ids, mask=ids == _LAST_ID),
             pa.array(score)], ["item_id", "id", "score"])

    return vectors.mapInArrow(run, "item_id long, id long, score long")


def _blocks(spark: SparkSession, items: DataFrame, id_column: str, text_column: str) -> Iterator[Terms]:
    """The query texts in blocks of about ``BLOCK_PAIRS`` pairs of a text and a term, one text at least."""
    pairs = cut_lineage(items.select(F.col(id_column).cast("long").alias("item_id"),
                                     F.explode(terms_of(F.col(text_column).cast("string"))).alias("term")).distinct())
    blocks = -(-pairs.count() // BLOCK_PAIRS)
    for k in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        if mine:
            yield Terms.build([tuple(r) for r in mine])


def ranked(documents: DataFrame, items: DataFrame, top: int = 10, id_column: str = "doc_id",
           text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``top`` best documents for each query text: item_id, rank, doc_id, score.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. With N documents
    that have terms, L terms in them, n terms in a document, and df documents that hold a term, a term weighs
    w = floor(1000 ln((2N + 2) / (2df + 1))), a document's m is 10 + 90 n N div L, and its score is the
    sum of w * (10^9 tf div (1000 tf + 8 m)) over the distinct terms of the query text. Only scores above 0 count;
    equal scores are ordered by id, rows without an id last. Repeated rows are ranked one by one. Query texts
    that share an id (or have none) are one query text. NULL and texts without terms find nothing
    and are not found; an empty table gives no rows. Other columns are not looked at.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    found = spark.createDataFrame([], "item_id long, id long, score long")
    for terms in _blocks(spark, items, item_column, item_text):
        vectors = _vectors(rows, terms)
        total, words = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not total:
            continue
        df = np.zeros(len(terms.keys), np.int64)
        for term, count in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[term] = count
        weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        rank = np.empty(len(df), np.int64)
        rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
        found = found.unionByName(_candidates(vectors, terms, weight, rank, total, words, top))
    order = [F.desc("score"), F.asc_nulls_last("id")]
    dealt = found.withColumn("salt", F.spark_partition_id() % SALTS)
    few = dealt.withColumn("place", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))) \
        .where(F.col("place") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return best.where(F.col("rank") <= top).select(
        F.col("item_id").alias(item_column), "rank", F.col("id").alias(id_column), "score")
