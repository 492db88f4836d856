"""Toxicity by a classifier chain of linear models over hashed word features.

The chain predicts one category after another. The model of a category sees, beside
the words, the probabilities of the categories before it. While it is trained these
come from models that did not see the row (out of fold), so that it learns how far
they can be trusted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from casoteca.llm.text import LOWER, PART_BYTES, byte_table, hashes, parts, text_bytes, word_bounds
from casoteca.sources.workspace import cut_lineage

#: Words of the features: everything but ASCII signs and white space.
_WORD = byte_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)], False)
#: Bytes of the word beginnings that are features beside the whole word.
STEMS = (4, 5, 6)
BUCKETS = 1 << 18
#: Labelled rows that a fit takes at most, chosen by a hash of their id.
MAX_LABELLED = 20_000
FOLDS = 3
#: Features that a fit keeps, and the partitions of its bounded table.
MAX_FEATURES, FIT_PARTITIONS = 4096, 6


def features(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text, text after text, and where each text's begin.

    A feature is a whole lower-cased word or its first bytes. Texts without words
    have none.
    """
    data, offsets = text_bytes(column)
    data = LOWER[data]
    start, end, first = word_bounds(data, offsets, _WORD)
    doc = np.repeat(np.arange(len(column)), np.diff(first)).astype(np.uint64)
    size = end - start
    keys = [doc * np.uint64(buckets) + (hashes(data, start, end) & np.uint64(buckets - 1))]
    for n in STEMS:
        long = size > n
        stem = hashes(data, start[long], start[long] + n, seed=n) & np.uint64(buckets - 1)
        keys.append(doc[long] * np.uint64(buckets) + stem)
    found = np.unique(np.concatenate(keys))
    doc_of = found >> np.uint64(buckets.bit_length() - 1)
    return ((found & np.uint64(buckets - 1)).astype(np.int64),
            np.searchsorted(doc_of, np.arange(len(column) + 1, dtype=np.uint64)))


@dataclass
class Chain:
    """Weights of every category's model: words first, then the categories before it."""

    categories: list[str]
    words: np.ndarray          # category x bucket
    earlier: list[np.ndarray]
    intercept: np.ndarray

    def probabilities(self, index: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A row per text, a column per category."""
        n = len(first) - 1
        out = np.zeros((n, len(self.categories)))
        for c in range(len(self.categories)):
            total = np.concatenate(([0.0], np.cumsum(self.words[c][index])))
            margin = self.intercept[c] + total[first[1:]] - total[first[:-1]]
            margin += out[:, :c] @ self.earlier[c]
            out[:, c] = 1 / (1 + np.exp(-np.clip(margin, -60, 60)))
        return out


def _vectors(rows: DataFrame, buckets: int) -> DataFrame:
    """Adds the feature numbers of the text as an array."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, size=PART_BYTES // 2):
            index, first = features(part["text"], buckets)
            lists = pa.ListArray.from_arrays(first.astype(np.int32), pa.array(index.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [*(part[c] for c in names if c != "text"), lists],
                [*(c for c in names if c != "text"), "index"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{fields}, index array<int>")


def train(documents: DataFrame, labels: DataFrame, categories: dict[str, str],
          max_labelled: int = MAX_LABELLED, folds: int = FOLDS, buckets: int = BUCKETS,
          id_column: str = "doc_id", text_column: str = "text") -> Chain:
    """Fit the chain on labelled documents.

    ``categories`` maps each category, in chain order, to a boolean SQL expression
    over ``labels``. At most ``max_labelled`` labelled documents are used, those whose
    ids hash lowest; that bounds the fit, not what is scored. Rows with a NULL
    category or id are left out; a category with one class only gets a constant model. Of
    labels that share an id the least ones count, of documents that do the least text. Every model
    looks at the ``MAX_FEATURES`` features that tell most, among those of three documents or more.
    """
    names = list(categories)
    marks = labels.select(F.col(id_column).alias("id"),
                          *(F.expr(e).cast("double").alias(f"y{i}") for i, e in enumerate(categories.values()))) \
        .where(F.col("id").isNotNull()).dropna()
    marks = marks.groupBy("id").agg(F.min(F.struct(*marks.columns[1:])).alias("y")).select("id", "y.*")
    marks = marks.withColumn("order", F.xxhash64("id")).orderBy("order", "id").limit(max_labelled)
    texts = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    rows = texts.join(F.broadcast(marks), "id")      # at most ``max_labelled`` rows of three numbers
    rows = rows.groupBy(*marks.columns).agg(F.min("text").alias("text"))
    table = cut_lineage(_vectors(rows, buckets).coalesce(FIT_PARTITIONS))       # what is scanned is not coalesced

    def fit(rows: DataFrame, c: int) -> tuple[np.ndarray, float]:
        """Weights of all buckets and the categories before, and the intercept."""
        share = rows.agg(F.avg(f"y{c}")).first()[0]
        if share is None or share in (0.0, 1.0):
            return np.zeros(buckets + c), -30.0 if not share else 30.0
        chosen = _telling(rows, c, share)
        width = len(chosen) + c

        @F.udf(VectorUDT())
        def vector(index, earlier):
            at = np.searchsorted(chosen, index)
            at = at[(at < len(chosen)) & (chosen[np.minimum(at, len(chosen) - 1)] == np.asarray(index))] \
                if len(index) and len(chosen) else np.zeros(0, np.int64)
            return SparseVector(width, [*at.tolist(), *range(len(chosen), width)],
                                [1.0] * len(at) + list(earlier))

        earlier = F.array(*(F.col(f"p{i}") for i in range(c))) if c else F.array().cast("array<double>")
        model = LogisticRegression(featuresCol="x", labelCol=f"y{c}", maxIter=40, regParam=2e-4,
                                   elasticNetParam=0.5, standardization=False) \
            .fit(rows.select(f"y{c}", vector("index", earlier).alias("x")))
        found = model.coefficients.toArray()
        weights = np.zeros(buckets + c)
        weights[chosen], weights[buckets:] = found[:len(chosen)], found[len(chosen):]
        return weights, float(model.intercept)

    fold = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(folds))
    chain = Chain(names, np.zeros((len(names), buckets)), [], np.zeros(len(names)))
    for c in range(len(names)):
        weights, chain.intercept[c] = fit(table, c)
        chain.words[c] = weights[:buckets]
        chain.earlier.append(weights[buckets:])
        if c + 1 < len(names):
            models = [fit(table.where(fold != k), c) for k in range(folds)]
            table = cut_lineage(_out_of_fold(table, models, fold, buckets, c))
    return chain


def _telling(rows: DataFrame, c: int, share: float) -> np.ndarray:
    """The features that depart most from the category's share, by chi-square over the rows."""
    met = rows.select(F.explode("index").alias("index"), F.col(f"y{c}").alias("y")) \
        .groupBy("index").agg(F.count("*").alias("n"), F.sum("y").alias("k")).where("n >= 3")
    departs = F.pow(F.col("k") - F.col("n") * share, 2) / F.col("n")
    best = met.orderBy(departs.desc(), "index").limit(MAX_FEATURES).select("index").collect()
    return np.array(sorted(r[0] for r in best), np.int64)


def _out_of_fold(table: DataFrame, models: list[tuple[np.ndarray, float]], fold, buckets: int,
                 c: int) -> DataFrame:
    """Adds p<c>: each row's probability by the model that was fitted without its fold."""
    names = table.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["index"]
            first = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            index = lists.flatten().to_numpy()
            which = np.asarray(batch["fold"])
            before = np.stack([np.zeros(batch.num_rows), *(np.asarray(batch[f"p{i}"]) for i in range(c))])
            p = np.empty(batch.num_rows)
            for k, (weights, intercept) in enumerate(models):
                total = np.concatenate(([0.0], np.cumsum(weights[index])))
                margin = intercept + total[first[1:]] - total[first[:-1]] \
                    + weights[buckets:buckets + c] @ before[1:]
                mine = which == k
                p[mine] = 1 / (1 + np.exp(-np.clip(margin[mine], -60, 60)))
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(p)],
                                             [*names, f"p{c}"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return table.withColumn("fold", fold.cast("int")).mapInArrow(run, f"{fields}, p{c} double")


def score(documents: DataFrame, chain: Chain, buckets: int = BUCKETS, id_column: str = "doc_id",
          text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The id (or the columns ``keep``) and the probability of every category (p_<category>) for every document row.

    NULL and empty texts have no features and get the models' prior. Repeated
    ids keep their rows. The weights go along with the tasks; their size is fixed.
    """
    names, kept = [f"p_{c}" for c in chain.categories], keep or [id_column]
    weights = documents.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, text_column, PART_BYTES // 2):
            index, first = features(part[-1], buckets)
            p = weights.value.probabilities(index, first)
            yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), *(pa.array(x) for x in p.T)], [*kept, *names])

    rows = documents.select(*(F.col(f"`{c}`") for c in kept if c != text_column),
                            F.col(f"`{text_column}`").cast("string"))
    rows = rows.toDF(*rows.columns[:-1], text_column)          # the text goes along once, as the last column
    schema = StructType([*(rows.schema[c] for c in kept), *(StructField(n, DoubleType()) for n in names)])
    return rows.mapInArrow(run, schema)


#: The chain of the labelled tables: poor texts first, then toxic ones.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
#: Probability from which a document counts as toxic.
THRESHOLD = 0.4


def toxic_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the probability of every category, and ``toxic``."""
    chain = train(documents, labels, CATEGORIES)
    return score(documents, chain).withColumn("toxic", F.col("p_toxic") >= threshold)
