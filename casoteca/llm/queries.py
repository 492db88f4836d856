"""Registered queries of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from casoteca.llm import (checks, decontaminate, language_model, minhash, phrases, pieces,
                          ranked_search, repeats, secret_scan, token_files, toxicity, transcripts, vectors)
from casoteca.sources.workspace import new_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn
    return add


_ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table; Python workers started from now on find this package."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = token_files.write_token_files(
        table(spark, sf_dir, "documents"), new_folder(spark, "token-files"),
        public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(blocks)


@query("op5_suffix_array_decontamination")
def op5_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"),
                                       table(spark, sf_dir, "benchmark"))


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_counts(table(spark, sf_dir, "documents"),
                               public_tokenizers.path("piece_bpe_32k.model"))


@query("op7_unigram_pieces")
def op7_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"),
                                public_tokenizers.path("piece_bpe_32k.model"))


@query("op1_toxicity_chain")
def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_pca_tiled_vectors")
def op9_pca_tiled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op10_super_minhash")
def op10_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_de_bruijn_repeats")
def op2_de_bruijn_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query("op3_transcript_roles")
def op3_transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts made of all conversations, their roles recovered without looking at them."""
    turns = transcripts.raw_turns(table(spark, sf_dir, "conversations"))
    return transcripts.summary(transcripts.parse(turns, transcripts.train(turns)))


@query("op8_deleted_interpolation")
def op8_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents"))


@query("op11_document_fp_tree", checks.RANKED)
def op11_document_fp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_secret_automaton", checks.SECRETS)
def op12_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


@query("op13_son_phrases", checks.COLLOCATIONS)
def op13_son_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
