"""Targets and model tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casoteca.functions import columns as C
from casoteca.functions import fixed

ADMISSION_FEATURES = (fixed.DEMOGRAPHIC_FEATURES + fixed.SYMPTOM_FEATURES
                      + fixed.COMORBIDITY_FEATURES + fixed.GEOGRAPHIC_FEATURES
                      + fixed.TEMPORAL_FEATURES)


def validate_features(features: Iterable[str] = ADMISSION_FEATURES) -> None:
    """Error when a feature would only be known after admission."""
    leaked = sorted(set(features) & set(fixed.LEAKAGE_FEATURES))
    if leaked:
        raise ValueError("Features com risco de leakage: " + ", ".join(leaked))


def eligible_outcome(source: str = "DESFECHO_NORMALIZADO") -> Column:
    return F.coalesce(F.col(source).isin(*fixed.ADMISSION_TARGET), F.lit(False))


def mortality_target(source: str = "DESFECHO_NORMALIZADO") -> Column:
    """0 cured, 1 death, NULL otherwise."""
    flag = F.when(F.col(source) == fixed.DEATH, 1)
    return flag.when(eligible_outcome(source), 0).cast("int")


@dataclass(frozen=True)
class AdmissionDataset:
    """One table with its feature, target and metadata columns named."""

    table: DataFrame
    features: list[str]
    metadata: list[str]
    label: str = "label"


def admission_dataset(cases: DataFrame, features: Iterable[str] = ADMISSION_FEATURES,
                      keys: Iterable[str] = ()) -> AdmissionDataset:
    """Rows with an eligible outcome, features that exist, target and metadata.

    Metadata that is also a feature (the state) gets a ``META_`` copy, so that
    preprocessing one never alters the other. ``keys`` are carried along.
    """
    chosen = [f for f in features if f in cases.columns]
    validate_features(chosen)
    metadata = {f"META_{m}" if m in chosen else m: F.col(m)
                for m in fixed.ADMISSION_METADATA if m in cases.columns}
    table = cases.filter(eligible_outcome()).select(
        *keys, *chosen, mortality_target().alias("label"),
        *[c.alias(name) for name, c in metadata.items()])
    return AdmissionDataset(table, chosen, list(metadata))


def state_target(df: DataFrame, target: str = "EVOLUCAO") -> DataFrame:
    """Codes 1 and 2 only; positive is death (``EVOLUCAO`` 2) or intensive care (``UTI`` 1)."""
    positive = {"EVOLUCAO": 2, "UTI": 1}[target]
    code = C.to_number(F.col(target))
    return (df.filter(code.isin(1, 2))
            .withColumn("label", F.when(code == positive, 1).otherwise(0)))


def patient_target(df: DataFrame) -> DataFrame:
    """``OBITO``: 1 for death by any cause (2, 3), 0 for cure (1); other rows dropped."""
    if "EVOLUCAO" not in df.columns:
        raise KeyError("Coluna 'EVOLUCAO' nao encontrada.")
    code = C.to_number(F.col("EVOLUCAO"))
    return (df.withColumn("OBITO", F.when(code.isin(2, 3), 1).when(code == 1, 0))
            .filter(F.col("OBITO").isNotNull()))
