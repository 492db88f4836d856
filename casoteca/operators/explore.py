"""Exploratory tables over raw-like records: cleaning, series, histograms, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casoteca.functions import columns as C
from casoteca.functions import fixed
from casoteca.operators.cleaning import canonical_codes, normalize_column_names
from casoteca.sources.workspace import cut_lineage

HISTOGRAM_BINS = 30
DENSITY_POINTS = 200


def exploratory_clean(df: DataFrame) -> DataFrame:
    """Dates parsed, copies dropped, age clipped to 0..120 whatever its unit, sex I unknown."""
    df = df.transform(normalize_column_names).transform(canonical_codes)
    dates = {n: C.parse_date(F.col(n)) for n in fixed.EXPLORATORY_DATES if n in df.columns}
    numbers = {n: C.to_number(F.col(n)) for n in ("EVOLUCAO", "UTI") if n in df.columns}
    df = df.withColumns(dates).dropDuplicates() if dates else df.dropDuplicates()
    if "NU_IDADE_N" in df.columns:
        age = C.to_number(F.col("NU_IDADE_N"))
        numbers["NU_IDADE_N"] = F.when(age.between(0, 120), age)
    if "CS_SEXO" in df.columns:
        numbers["CS_SEXO"] = F.nullif("CS_SEXO", F.lit("I"))
    return df.withColumns(numbers) if numbers else df


def _state_column(df: DataFrame) -> str | None:
    return next((n for n in fixed.STATE_COLUMNS if n in df.columns), None)


def in_state(df: DataFrame, uf: str):
    """Predicate "row belongs to the state"; no state column means every row does."""
    column = _state_column(df)
    return F.lit(True) if column is None else F.coalesce(F.upper(column) == uf, F.lit(False))


def filter_state(df: DataFrame, uf: str) -> DataFrame:
    return df.filter(in_state(df, uf))


def state_share(df: DataFrame, uf: str) -> DataFrame:
    """Rows of the state, all rows, and the share in per cent."""
    counts = df.agg(F.count_if(in_state(df, uf)).alias("casos_uf"),
                    F.count(F.lit(1)).alias("casos_total"))
    share = F.try_divide(F.col("casos_uf").cast("double"), F.col("casos_total").cast("double"))
    return counts.withColumn("percentual", F.bround(share * 100, 1))


def monthly_dense(df: DataFrame, uf: str) -> DataFrame:
    """Monthly counts of the whole table and of one state, gaps filled with zero.

    Each series runs from its own first to its own last month and is dated on
    the month's last day. Rows are reduced to months first; a calendar between
    the ends of each series is then joined with them.
    """
    counts = (df.filter(F.col("DT_SIN_PRI").isNotNull())
              .groupBy(F.trunc("DT_SIN_PRI", "month").alias("inicio"))
              .agg(F.count(F.lit(1)).alias("TOTAL"), F.count_if(in_state(df, uf)).alias(uf))
              .unpivot("inicio", ["TOTAL", uf], "serie", "n").filter(F.col("n") > 0))
    months = F.sequence(F.min("inicio"), F.max("inicio"), F.expr("interval 1 month"))
    calendar = (counts.groupBy("serie").agg(months.alias("meses"))
                .select("serie", F.explode("meses").alias("inicio")))
    return (calendar.join(counts, ["serie", "inicio"], "left")
            .select("serie", F.last_day("inicio").alias("mes"),
                    F.coalesce("n", F.lit(0)).alias("casos"))
            .orderBy("serie", "mes"))


def _value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per distinct value, written once: the steps that follow read it several times."""
    return cut_lineage(
        df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x"))
        .agg(F.count(F.lit(1)).alias("n")))


def age_histogram(df: DataFrame, column: str = "NU_IDADE_N",
                  bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins between minimum and maximum, empty bins included.

    The range is a scalar subquery, so no row is joined to it. A single value
    gets a range of one around it.
    """
    values = _value_counts(df, column)
    pad = F.when(F.min("x") == F.max("x"), 0.5).otherwise(0.0)
    lo = values.agg(F.min("x") - pad).scalar()
    width = values.agg((F.max("x") - F.min("x") + 2 * pad) / bins).scalar()
    position = F.floor((F.col("x") - lo) / width)
    filled = (values.groupBy(F.least(position, F.lit(bins - 1)).alias("faixa"))
              .agg(F.sum("n").alias("n")))
    edges = df.sparkSession.range(bins).select(
        F.col("id").alias("faixa"), (lo + F.col("id") * width).alias("inicio"),
        (lo + (F.col("id") + 1) * width).alias("fim"))
    return (edges.filter(F.col("inicio").isNotNull()).join(filled, "faixa", "left")
            .select("faixa", "inicio", "fim", F.coalesce("n", F.lit(0)).alias("casos"))
            .orderBy("faixa"))


def age_density(df: DataFrame, column: str = "NU_IDADE_N", points: int = DENSITY_POINTS,
                bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Gaussian kernel density on an even grid between minimum and maximum.

    Bandwidth is Scott's rule, ``n ** (-1/5)`` sample deviations. Each distinct
    value spreads over the fixed grid and is summed per grid point before the
    shuffle. ``frequencia`` is the density scaled to the histogram's counts.
    """
    values = _value_counts(df, column)
    n = F.sum("n")
    # squares of departures from the mean: squares of the values would cancel on large ones
    mean = values.agg(F.try_divide(F.sum(F.col("x") * F.col("n")), n)).scalar()
    squares = F.sum(F.pow(F.col("x") - F.col("mean"), 2) * F.col("n"))
    deviation = F.sqrt(F.try_divide(squares, n - 1))
    total = values.agg(n).scalar()
    lo = values.agg(F.min("x")).scalar()
    extent = values.agg(F.max("x") - F.min("x")).scalar()
    bandwidth = values.withColumn("mean", mean).agg(deviation * F.pow(n, F.lit(-0.2))).scalar()
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    spread = values.select("x", "n", grid.alias("ponto"))
    spread = spread.withColumn("idade", lo + F.col("ponto") * extent / (points - 1))
    z = (F.col("idade") - F.col("x")) / bandwidth
    kernel = F.exp(-0.5 * z * z) / (F.sqrt(F.lit(2.0) * F.pi()) * bandwidth)
    density = F.sum(F.col("n") * kernel) / total
    return (spread.groupBy("ponto", "idade").agg(density.alias("densidade"))
            .withColumn("frequencia", F.col("densidade") * total * extent / bins)
            .orderBy("ponto"))


def value_counts(df: DataFrame, column: str, name: str) -> DataFrame:
    return (df.na.drop(subset=[column]).groupBy(F.col(column).alias(name))
            .agg(F.count(F.lit(1)).alias("casos")).orderBy(F.desc("casos"), name))


def cases_by_sex(df: DataFrame) -> DataFrame:
    return value_counts(df, "CS_SEXO", "sexo")


def cases_by_outcome(df: DataFrame) -> DataFrame:
    """Cases per labelled outcome; rows are counted per code, then named."""
    known = df.filter(F.col("EVOLUCAO").isin(*fixed.EXPLORATORY_OUTCOME_LABELS))
    label = C.label_of(F.col("EVOLUCAO"), fixed.EXPLORATORY_OUTCOME_LABELS)
    return (known.groupBy("EVOLUCAO").agg(F.count(F.lit(1)).alias("casos"))
            .select(label.alias("evolucao"), "casos").orderBy(F.desc("casos"), "evolucao"))


def icu_rate_by_band(df: DataFrame) -> DataFrame:
    """Per cent in intensive care per right-closed age band; "ignored" stays in the base.

    The average skips rows without an answer. Ages outside all bands form a
    group of their own, dropped after the aggregate: as a filter on rows the
    band expression would be evaluated once more below the removal of copies.
    """
    rate = F.avg(F.when(F.col("UTI") == 1, 100.0).when(F.col("UTI").isNotNull(), 0.0))
    banded = df.select(C.exploratory_age_band(F.col("NU_IDADE_N")).alias("faixa_etaria"), "UTI",
                       "NU_IDADE_N")
    return (banded.groupBy("faixa_etaria")
            .agg(rate.alias("taxa_uti"), F.min("NU_IDADE_N").alias("idade_minima"))
            .filter(F.when(F.col("taxa_uti").isNotNull(), F.col("faixa_etaria")).isNotNull())
            .orderBy("idade_minima").select("faixa_etaria", "taxa_uti"))


def comorbidity_prevalence(df: DataFrame) -> DataFrame:
    """Per cent of all rows with each condition, rarest first."""
    present = [n for n in fixed.EXPLORATORY_COMORBIDITIES if n in df.columns]
    share = [F.avg(F.when(C.answered_yes(F.col(n)), 100.0).otherwise(0.0)).alias(n)
             for n in present]
    return (df.agg(*share).unpivot([], present, "comorbidade", "percentual")
            .orderBy("percentual", "comorbidade"))


def top_municipalities(df: DataFrame, limit: int = 15) -> DataFrame:
    return value_counts(df, "ID_MUNICIP", "municipio").limit(limit)


def cases_deaths_by_month(df: DataFrame) -> DataFrame:
    """Cases and deaths per onset month; both counts share one grouped scan."""
    return (df.filter(F.col("DT_SIN_PRI").isNotNull())
            .groupBy(C.year_month(F.col("DT_SIN_PRI")).alias("ano_mes"))
            .agg(F.count(F.lit(1)).alias("casos"),
                 F.count_if(F.col("EVOLUCAO") == 2).alias("obitos")).orderBy("ano_mes"))


def cases_by_month(df: DataFrame) -> DataFrame:
    return (df.filter(F.col("DT_SIN_PRI").isNotNull())
            .groupBy(C.year_month(F.col("DT_SIN_PRI")).alias("ano_mes"))
            .agg(F.count(F.lit(1)).alias("casos")).orderBy("ano_mes"))


def obesity_icu_crosstab(df: DataFrame) -> DataFrame:
    """Share of intensive care among obese and non-obese cases, per cent of each row."""
    obese, icu = C.to_number(F.col("OBESIDADE")), C.to_number(F.col("UTI"))
    counts = (df.filter(obese.isin(*fixed.OBESITY_LABELS) & icu.isin(*fixed.ICU_LABELS))
              .groupBy(obese.alias("codigo"))
              .agg(F.count(F.lit(1)).alias("n"), F.count_if(icu == 1).alias("sim")))
    return counts.select(
        C.label_of(F.col("codigo"), fixed.OBESITY_LABELS).alias("obesidade"),
        F.bround((F.col("n") - F.col("sim")) / F.col("n") * 100, 2).alias("uti_nao"),
        F.bround(F.col("sim") / F.col("n") * 100, 2).alias("uti_sim")).orderBy("obesidade")


def target_rates(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows, positives and base rate of a 0/1 target."""
    return df.agg(F.count(label).alias("n"),
                  F.coalesce(F.sum(F.col(label).cast("bigint")), F.lit(0)).alias("positivos"),
                  F.avg(label).alias("taxa"))
