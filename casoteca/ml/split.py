"""Temporal and stratified splits, folds and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casoteca.functions.ordered import hash_rank


def temporal_split(df: DataFrame, validation_year: int = 2025, test_year: int = 2026,
                   year: str = "ANO") -> DataFrame:
    """Adds ``split``: train before the validation year, then validation and test.

    Rows of other years are dropped. One aggregate checks that no year is
    missing and no part is empty.
    """
    y = F.col(year)
    part = (F.when(y < validation_year, "train").when(y == validation_year, "validation")
            .when(y == test_year, "test"))
    tagged = df.withColumn("split", part)
    seen = tagged.agg(F.count_if(y.isNull()).alias("sem_ano"),
                      *[F.count_if(F.col("split") == p).alias(p)
                        for p in ("train", "validation", "test")]).first()
    if seen["sem_ano"]:
        raise ValueError(f"anos ausentes em {seen['sem_ano']} linhas")
    if not seen["train"]:
        raise ValueError(f"parte de treino vazia: nada antes de {validation_year}")
    if not seen["validation"]:
        raise ValueError(f"parte de validacao vazia: {validation_year}")
    if not seen["test"]:
        raise ValueError(f"parte de teste vazia: {test_year}")
    return tagged.filter(F.col("split").isNotNull())


def _test_quota(ranked: DataFrame, label: str, test_fraction: float) -> DataFrame:
    """Test rows per class: shares rounded down, the rest to the largest remainders."""
    sizes = ranked.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("n").over(everything)
    # shares as whole numbers: products of two counts do not fit into a long
    wide = "decimal(19,0)"
    sizes = sizes.withColumns({"total": total, "teste": F.ceil(total * test_fraction)})
    sizes = sizes.withColumn("produto", F.col("teste").cast(wide) * F.col("n").cast(wide)) \
        .withColumn("quota", F.expr("produto div total")) \
        .withColumn("resto", F.expr("produto % total"))
    spare = F.col("teste") - F.sum("quota").over(everything)
    place = F.row_number().over(everything.orderBy(F.desc("resto"), label))
    return sizes.select(label, (F.col("quota") + F.when(place <= spare, 1).otherwise(0))
                        .alias("quota"))


def stratified_split(df: DataFrame, label: str, key: str, test_fraction: float = 0.25) -> DataFrame:
    """Adds ``split`` (train/test) with the class ratio kept, exactly sized and repeatable."""
    ranked = hash_rank(df, label, key)
    quota = _test_quota(df.select(label), label, test_fraction)
    # one row per class
    return (ranked.join(F.broadcast(quota), label)
            .withColumn("split", F.when(F.col("posicao") <= F.col("quota"), "test")
                        .otherwise("train"))
            .drop("posicao", "tamanho", "quota"))


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5) -> DataFrame:
    """Adds ``fold`` (0 .. folds-1); every fold has the class ratio of the whole."""
    ranked = hash_rank(df, label, key)
    return (ranked.withColumn("fold", F.pmod(F.col("posicao") - 1, F.lit(folds)).cast("int"))
            .drop("posicao", "tamanho"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights ``rows / (classes * rows of the class)``, one row per class."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))
    weight = F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))
    return sizes.select(label, "n", weight.alias("peso"))


def with_class_weights(df: DataFrame, label: str, name: str = "peso") -> DataFrame:
    # one row per class
    weights = class_weights(df, label).select(label, F.col("peso").alias(name))
    return df.join(F.broadcast(weights), label)
