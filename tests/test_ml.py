import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Observation
from pyspark.sql import functions as F

from casoteca.functions import fixed
from casoteca.ml import dataset, evaluate, models, preprocess, split
from conftest import rows


# ---------------------------------------------------------------- datasets

def test_feature_registry_is_free_of_leakage():
    dataset.validate_features()
    assert len(dataset.ADMISSION_FEATURES) == 28
    with pytest.raises(ValueError, match="UTI"):
        dataset.validate_features(["CS_SEXO", "UTI"])


def test_admission_dataset(text_frame):
    outcomes = ["CURA", "OBITO_SRAG", "OBITO_OUTRAS_CAUSAS", "IGNORADO", None]
    df = text_frame([{"DESFECHO_NORMALIZADO": o, "ANO": 2024, "NU_IDADE_N": i, "CS_SEXO": "F",
                      "DISPNEIA": 1, "UTI": 1} for i, o in enumerate(outcomes)])
    data = dataset.admission_dataset(df)
    assert data.features == ["CS_SEXO", "NU_IDADE_N", "DISPNEIA"] and data.metadata == ["ANO"]
    assert sorted(rows(data.table.select("NU_IDADE_N", "label"))) == [("0", 0), ("1", 1)]
    with pytest.raises(ValueError, match="leakage"):
        dataset.admission_dataset(df, ["UTI"])


def test_three_death_definitions(text_frame):
    df = text_frame([{"EVOLUCAO": c, "UTI": 2} for c in (1, 2, 3, 9, None, "x")])
    assert sorted(rows(dataset.patient_target(df).select("EVOLUCAO", "OBITO"))) == [
        ("1", 0), ("2", 1), ("3", 1)]
    assert sorted(rows(dataset.state_target(df).select("EVOLUCAO", "label"))) == [
        ("1", 0), ("2", 1)]
    with pytest.raises(KeyError):
        dataset.patient_target(df.drop("EVOLUCAO"))


# ---------------------------------------------------------------- splits

def years(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "ANO int")


def test_temporal_split(spark):
    df = split.temporal_split(years(spark, 2023, 2024, 2025, 2026, 2027))
    assert sorted(rows(df)) == [(2023, "train"), (2024, "train"), (2025, "validation"),
                                (2026, "test")]
    for bad, message in (((2024, 2025, 2026, None), "ausentes"), ((2025, 2026), "treino"),
                         ((2024, 2026), "validacao"), ((2024, 2025), "teste")):
        with pytest.raises(ValueError, match=message):
            split.temporal_split(years(spark, *bad))


def test_stratified_split_and_folds(spark):
    df = spark.createDataFrame([(str(i), int(i % 4 == 0)) for i in range(402)],
                               "id string, label int")
    parts = {(r["label"], r["split"]): r["count"] for r in split.stratified_split(
        df, "label", "id").groupBy("label", "split").count().collect()}
    assert parts[0, "test"] + parts[1, "test"] == 101
    # exact shares are 75.6 and 25.4 of 101; the larger remainder gets the spare row
    assert parts == {(0, "train"): 225, (0, "test"): 76, (1, "train"): 76, (1, "test"): 25}
    folds = split.stratified_folds(df, "label", "id").groupBy("fold", "label").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in folds if r["label"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "label int")
    assert sorted(rows(split.class_weights(df, "label"))) == [(0, 3, 4 / 6), (1, 1, 2.0)]


# ---------------------------------------------------------------- preprocessing

def test_statistics_come_from_training_rows_only(spark):
    train = spark.createDataFrame([(20.0,), (40.0,), (None,)], "NU_IDADE_N double")
    model = preprocess.fit_preprocessor(train, preprocess.Recipe(["NU_IDADE_N"]))
    later = spark.createDataFrame([(1000.0,), (None,)], "NU_IDADE_N double")
    deviation = (200 / 3) ** 0.5
    got = [r["NU_IDADE_N__num"] for r in model.transform(later).collect()]
    assert got == [pytest.approx(970 / deviation), pytest.approx(0.0)]


def test_unknown_category_gives_zeros(spark):
    train = spark.createDataFrame([("F",), ("M",), ("M",), (None,)], "CS_SEXO string")
    recipe = preprocess.Recipe(categorical=["CS_SEXO"])
    model = preprocess.fit_preprocessor(train, recipe)
    assert preprocess.slot_names(model, recipe) == ["CS_SEXO=F", "CS_SEXO=M"]
    later = spark.createDataFrame([("I",), (None,), ("F",)], "CS_SEXO string")
    vectors = [list(r["features"].toArray()) for r in model.transform(later).collect()]
    assert vectors == [[0, 0], [0, 1], [1, 0]]


def test_columns_with_too_many_categories_are_an_error(spark):
    df = spark.range(2_000_000).select(F.col("id").cast("string").alias("wide"), F.lit("a").alias("narrow"))
    with pytest.raises(ValueError, match="wide") as error:
        preprocess.fit_preprocessor(df, preprocess.Recipe(categorical=["narrow", "wide"]))
    assert "narrow" not in str(error.value)


def test_most_frequent_breaks_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), ("c",)], "x string")
    assert rows(preprocess.most_frequent(df, ["x"])) == [("x", "a")]


def test_recipe_guards(spark):
    with pytest.raises(ValueError):
        preprocess.Recipe()
    df = spark.createDataFrame([(1,)], "a int")
    assert preprocess.balance_training_data(df) is df
    with pytest.raises(ValueError, match="smote"):
        preprocess.balance_training_data(df, "smote")


def test_unify_categorical_types(text_frame):
    records = [{"a": "1.0", "b": "M", "c": "1", "k": i} for i in range(30)]
    records += [{"a": None, "b": "nan", "c": "x", "k": 98}, {"a": "x", "b": None, "c": "y", "k": 99}]
    df = preprocess.unify_categorical_types(text_frame(records), ["a", "b", "c", "absent"])
    got = {r["k"]: (r["a"], r["b"], r["c"]) for r in df.collect()}
    assert got["0"] == ("1", "M", "1") and got["98"] == (None, None, "x")
    assert got["99"] == (None, None, "y")


def test_patient_recipe_reports_absent_columns(text_frame):
    recipe, absent = preprocess.patient_recipe(text_frame([{"NU_IDADE_N": 1, "UTI": 1}]))
    assert recipe.numeric == ["NU_IDADE_N"] and recipe.fill == {"UTI": "9"}
    wanted = fixed.PATIENT_NUMERIC + fixed.PATIENT_YES_NO + fixed.PATIENT_NOMINAL
    assert len(absent) == len(wanted) - 2


# ---------------------------------------------------------------- evaluation

@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(7)
    data = [(i, int(rng.random() < 0.3), round(rng.random(), 1)) for i in range(400)]
    return data, spark.createDataFrame(data, "id int, label int, score double")


def test_ranking_metrics_against_all_pairs(scored):
    data, df = scored
    pos = [s for _, y, s in data if y]
    neg = [s for _, y, s in data if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, seen = 0.0, 0.0
    for t in sorted({s for *_, s in data}, reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(n >= t for n in neg)
        ap, seen = ap + (tp / len(pos) - seen) * tp / (tp + fp), tp / len(pos)
    row = evaluate.ranking_metrics(df).first()
    assert row["auc"] == pytest.approx(auc) and row["precisao_media"] == pytest.approx(ap)


def test_best_threshold_against_every_threshold(scored):
    data, df = scored
    def f1(t):
        tp = sum(y and s >= t for _, y, s in data)
        p, r = tp / sum(s >= t for *_, s in data), tp / sum(y for _, y, _ in data)
        return 2 * (p * r) / (p + r + 1e-12)
    best = max(sorted({s for *_, s in data}), key=f1)
    row = evaluate.best_threshold(df).first()
    assert row["limiar"] == best and row["f1"] == pytest.approx(f1(best))


def test_undefined_scores_are_zero(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.2)], "label int, score double")
    row = evaluate.threshold_metrics(df, 0.5).first()
    assert (row["precisao"], row["recall"], row["f1"], row["acuracia"]) == (0.0, 0.0, 0.0, 0.5)
    assert sorted(rows(evaluate.confusion_matrix(df, 0.5))) == [
        (0, 0, 1), (0, 1, 0), (1, 0, 1), (1, 1, 0)]


def test_report_lines(scored):
    lines = evaluate.classification_report(scored[1], [0.5, 0.7]).collect()
    assert len(lines) == 10
    assert {r["suporte"] for r in lines if r["classe"] == "weighted avg"} == {400}


# ---------------------------------------------------------------- models

def test_too_few_rows_are_not_modelled(text_frame):
    df = text_frame([{"CASE_ID": i, "EVOLUCAO": 1 + i % 2, "NU_IDADE_N": i, "UTI": 1}
                     for i in range(50)])
    assert models.state_benchmark(df) is None
    one_class = text_frame([{"CASE_ID": i, "EVOLUCAO": 1, "NU_IDADE_N": i, "UTI": 1}
                            for i in range(150)])
    assert models.state_benchmark(one_class) is None


@pytest.fixture(scope="module")
def patients(text_frame):
    rng = random.Random(3)
    def case(i):
        age = rng.randrange(100)
        return {"CASE_ID": i, "NU_IDADE_N": age, "UTI": rng.choice("129"),
                "FEBRE": rng.choice(["1", "2", None]), "CS_SEXO": rng.choice("MF"),
                "EVOLUCAO": 2 if age + rng.randrange(60) > 90 else 1}
    return models.patient_data(text_frame([case(i) for i in range(400)]))


def test_reduction_keeps_the_fewest_components(spark, patients):
    reduction = models.fit_reduction(patients.part("train"), patients.recipe)
    shares = [r["variancia_acumulada"] for r in reduction.components(spark).collect()]
    assert shares[-1] > 0.90 and all(s <= 0.90 for s in shares[:-1])
    assert reduction.loadings(spark, top=2).count() == 2 * min(5, reduction.kept)


def test_patient_models_learn_and_can_be_saved(spark, patients, tmp_path):
    fitted = models.fit_patient_models(patients, models.Size(iterations=50).shrunk(3))
    assert tuple(fitted.models) == models.MODEL_NAMES
    test = patients.part("test")
    auc = {r["modelo"]: r["auc"] for r in evaluate.ranking_metrics(
        fitted.score(test), label="OBITO", by=["modelo"]).collect()}
    assert all(v > 0.7 for v in auc.values())
    name = "stacking_ensemble"
    models.save_model(fitted, name, 0.4, ["NU_IDADE_N"], str(tmp_path / "m"), spark)
    pipeline, meta = models.load_model(spark, str(tmp_path / "m"))
    assert meta.first()["limiar_decisao"] == 0.4
    again = pipeline.transform(test).select("CASE_ID", F.col(f"prob_{name}").alias("p"))
    want = {r["CASE_ID"]: r["score"] for r in fitted.score(test).filter(
        F.col("modelo") == name).collect()}
    assert {r["CASE_ID"]: float(r["p"][1]) for r in again.collect()} == pytest.approx(want)


def test_models_score_in_a_session_that_has_observed(spark):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    df = spark.range(40).select(
        array_to_vector(F.array(F.col("id").cast("double"))).alias("features"),
        (F.col("id") > 20).cast("int").alias("label"), F.lit(1.0).alias("peso"))
    for estimator in (models.logistic(40, 5), models.forest(2)):
        scored = models.fitted(estimator, df).transform(df)
        assert scored.filter("prediction = label").count() > 30


def test_rows_for_fits_are_in_a_part_for_every_core(spark):
    few = spark.range(5000).coalesce(1)
    written = models.for_fits(few, "id")
    assert written.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    sizes = written.rdd.glom().map(len).collect()
    assert sum(sizes) == 5000 and max(sizes) < 1000
