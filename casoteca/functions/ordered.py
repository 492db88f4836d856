"""Exact order statistics without a single-task sort.

A running total or a rank over a whole table would normally pull every row of
a group into one task. Here the ordered axis is cut into blocks first: rows
are ranked inside their block, and the totals of the earlier blocks (a table
with a few thousand rows at most per group) are added as an offset.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer, QuantileDiscretizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = "__bloco"
_HASH = "__hash"
#: Rows per block of a running total, however large the table is.
BLOCK_ROWS = 1_000_000


def _block_offsets(block_sums: DataFrame, by: list[str], totals: list[str],
                   descending: bool) -> DataFrame:
    """Per block: sums of the blocks before it, and sums of the whole group."""
    order = F.desc(_BLOCK) if descending else F.asc(_BLOCK)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return block_sums.select(
        *by, _BLOCK,
        *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(f"{t}__antes") for t in totals],
        *[F.sum(t).over(group).alias(f"{t}__total") for t in totals],
    )


def _default_blocks(df: DataFrame) -> int:
    """As many blocks as the rows need, and no fewer than there are shuffle tasks."""
    return max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // BLOCK_ROWS)


def running_totals(df: DataFrame, order: str, counts: dict[str, Column], by: list[str] = (),
                   descending: bool = False, blocks: int | None = None) -> DataFrame:
    """Cumulative sums of ``counts`` along the numeric column ``order``.

    One row per distinct (``by``, ``order``) with, for every name in
    ``counts``: the sum at that value (``name``), up to and including it
    (``name__acum``) and over the whole group (``name__total``).

    Equal values are summed before the shuffle, so a hot value is one row.
    Block limits are quantiles of the rows, hence no block holds more distinct
    values than its share of the rows. They only steer the distribution of
    work; results do not depend on them. There are as many blocks as shuffle
    tasks, at least 64, and at least one for every ``BLOCK_ROWS`` rows.
    """
    by, names = list(by), list(counts)
    df = df.filter(F.col(order).isNotNull() & ~F.isnan(F.col(order).cast("double")))
    blocks = blocks or _default_blocks(df.select(order))
    values = (df.withColumn(order, F.col(order).cast("double")).groupBy(*by, order)
              .agg(*[expr.alias(name) for name, expr in counts.items()]))
    axis = df.select(F.col(order).cast("double").alias(order))
    limits = QuantileDiscretizer(numBuckets=blocks, inputCol=order, outputCol=_BLOCK,
                                 relativeError=0.5 / blocks).fit(axis).getSplits()
    # Bucketizer needs one inner limit; an axis with a single value has none.
    if len(limits) < 3:
        limits = [-float("inf"), 0.0, float("inf")]
    placed = Bucketizer(splits=limits, inputCol=order, outputCol=_BLOCK).transform(values)
    sums = placed.groupBy(*by, _BLOCK).agg(*[F.sum(n).alias(n) for n in names])
    offsets = _block_offsets(sums, by, names, descending)
    inside = (Window.partitionBy(*by, _BLOCK)
              .orderBy(F.desc(order) if descending else F.asc(order))
              .rowsBetween(Window.unboundedPreceding, 0))
    return placed.join(offsets, [*by, _BLOCK]).select(
        *by, order, *names,
        *[(F.sum(n).over(inside) + F.col(f"{n}__antes")).alias(f"{n}__acum") for n in names],
        *[f"{n}__total" for n in names],
    )


def exact_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact median of each numeric column, one row per column (``atributo``, ``mediana``)."""
    long = (df.select(*[F.col(c).cast("double").alias(c) for c in columns])
            .unpivot([], columns, "atributo", "valor"))
    ranked = running_totals(long, "valor", {"n": F.count(F.lit(1))}, by=["atributo"])
    upto, total = F.col("n__acum"), F.col("n__total")
    low, high = F.floor((total + 1) / 2), F.floor(total / 2) + 1
    covers = [(upto - F.col("n") < pos) & (pos <= upto) for pos in (low, high)]
    halves = [F.max(F.when(hit, F.col("valor"))) for hit in covers]
    return ranked.groupBy("atributo").agg(((halves[0] + halves[1]) / 2).alias("mediana"))


def hash_rank(df: DataFrame, by: str, key: str, prefix: int = 3) -> DataFrame:
    """Rank of every row inside its ``by`` group, ordered by the MD5 of ``key``.

    Adds ``posicao`` (1, 2, ...) and ``tamanho`` (rows of the group). The order
    is pseudo-random yet the same on every run and every cluster. Hash prefixes
    cut each group into ``16 ** prefix`` even blocks, so a group with half of
    all rows spreads over thousands of tasks. ``key`` must be unique and ``by``
    must have few values.
    """
    h = F.md5(F.col(key).cast("string"))
    placed = df.withColumn(_HASH, h).withColumn(_BLOCK, F.substring(_HASH, 1, prefix))
    sizes = placed.groupBy(by, _BLOCK).agg(F.count(F.lit(1)).alias("n"))
    # at most 16 ** prefix rows per group of a label with few values
    offsets = _block_offsets(sizes, [by], ["n"], descending=False)
    inside = Window.partitionBy(by, _BLOCK).orderBy(_HASH, key)
    return (placed.join(offsets, [by, _BLOCK])
            .withColumn("posicao", F.row_number().over(inside) + F.col("n__antes"))
            .withColumn("tamanho", F.col("n__total"))
            .drop(_HASH, _BLOCK, "n__antes", "n__total"))
