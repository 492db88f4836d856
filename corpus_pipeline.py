"""The corpus pipeline: what is left of a document table, as pieces of a vocabulary.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet and gives the reread table to the next stage. All but the last return the columns of
``documents``. Stages judge what their predecessor kept, and rows without an id like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casoteca.llm import decontaminate, minhash, pieces, repeats, toxicity
from casoteca.llm.queries import table
from casoteca.sources.session import freed_shuffles
from casoteca.sources.workspace import cut_lineage, new_folder, passing_tables

#: Shingle overlap, in percent, from which documents are near duplicates.
NEAR_PERCENT = 80


#: Rows that go to Python at a time in sessions that keep Spark's default; whole rows of text
#: are a few MB then, in the JVM as in the workers.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def _whole(docs: DataFrame):
    """All columns of a row as one, so that decisions need no join."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier chain finds toxic."""
    _small_batches(spark)
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.CATEGORIES)
    scored = toxicity.score(docs, chain, keep=docs.columns)
    return scored.where(F.col("p_toxic") < toxicity.THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group, the one with the smallest id.

    Rows are numbered, as several may share an id or have none; a row with an id
    is kept rather than one without. Rows without words are in no group.
    """
    _small_batches(spark)
    with freed_shuffles(spark), passing_tables(spark):
        numbered = cut_lineage(docs.select(_whole(docs), F.monotonically_increasing_id().alias("number")), keep=True)
        found = minhash.near_duplicates(numbered.select("number", F.col("row.text").alias("text")),
                                        percent=NEAR_PERCENT, id_column="number")
        grouped = cut_lineage(found.join(numbered.select("number", F.col("row.doc_id").alias("id")), "number")
                              .select("number", "component_id", "id"))
        first = grouped.groupBy("component_id").agg(
            F.min(F.struct(F.col("id").isNull(), "id", "number")).alias("first")).select("first.number")
        gone = minhash.few_rows(cut_lineage(grouped.select("number").join(first, "number", "left_anti"), keep=True))
    return numbered.join(gone, "number", "left_anti").select("row.*")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that start earlier elsewhere; texts without any stay as they are."""
    _small_batches(spark)
    kept = repeats.remove_repeats(docs, keep_text=True, whole_rows=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long"))
           .otherwise(F.col("row.n_chars"))}
    return kept.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a verbatim benchmark passage."""
    _small_batches(spark)
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), whole_rows=True)
    return found.where("not contaminated").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the piece ids of the text, their score and the text they decode to."""
    _small_batches(spark)
    coded = pieces.encode_pieces(docs.select("doc_id", "lang", "source", "text"),
                                 public_tokenizers.path("piece_bpe_32k.model"))
    return coded.drop("text")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", drop_repeats),
          ("decontamination", drop_benchmark), ("pieces", encode)]

#: SQL has neither the classifier nor the vocabulary; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
