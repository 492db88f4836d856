"""Queries over model datasets, splits, preprocessing, evaluation and fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casoteca.ml import dataset, evaluate, models, preprocess, split
from casoteca.operators import explore
from casoteca.plans.registry import query
from casoteca.plans.typed_sql import over_cases
from casoteca.sources.derived import stored_cases, stored_explored
from casoteca.sources.files import union_by_name
from casoteca.sources.workspace import cut_lineage, new_folder


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# ---------------------------------------------------------------- targets and datasets

_TARGET = "CASE DESFECHO_NORMALIZADO WHEN 'OBITO_SRAG' THEN 1 WHEN 'CURA' THEN 0 END"


@query("mortality_target", over_cases(f"""
    SELECT CASE_ID, DESFECHO_NORMALIZADO IN ('CURA', 'OBITO_SRAG') AS elegivel,
      cast({_TARGET} AS int) AS alvo FROM cases"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stored_cases(spark, sf).select(
        "CASE_ID", dataset.eligible_outcome().alias("elegivel"),
        dataset.mortality_target().alias("alvo"))


_ADMISSION = ("CS_SEXO", "NU_IDADE_N", "FEBRE", "DISPNEIA", "CARDIOPATI", "DIABETES", "OBESIDADE",
              "SG_UF")


@query("admission_dataset", over_cases(f"""
    SELECT CASE_ID, {', '.join(_ADMISSION)}, cast({_TARGET} AS int) AS label, ANO,
      SG_UF AS META_SG_UF, DT_NOTIFIC
    FROM cases WHERE DESFECHO_NORMALIZADO IN ('CURA', 'OBITO_SRAG')"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.admission_dataset(stored_cases(spark, sf), keys=["CASE_ID"]).table


_PART = "CASE WHEN ANO < 2025 THEN 'train' WHEN ANO = 2025 THEN 'validation' ELSE 'test' END"
_ELIGIBLE = "DESFECHO_NORMALIZADO IN ('CURA', 'OBITO_SRAG') AND ANO <= 2026"


def _admission(spark: SparkSession, sf: str) -> DataFrame:
    """Admission rows with a numeric age and their temporal part."""
    data = dataset.admission_dataset(stored_cases(spark, sf), keys=["CASE_ID"])
    numbers = F.col("NU_IDADE_N").try_cast("double")
    return split.temporal_split(data.table).withColumn("NU_IDADE_N", numbers)


@query("temporal_split", over_cases(
    f"SELECT CASE_ID, {_PART} AS split FROM cases WHERE {_ELIGIBLE}"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _admission(spark, sf).select("CASE_ID", "split")


@query("balance_none", over_cases(
    "SELECT CASE_ID, cast(" + _TARGET + f" AS int) AS label FROM cases WHERE {_ELIGIBLE} "
    "AND ANO < 2025"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    train = _admission(spark, sf).filter("split = 'train'").select("CASE_ID", "label")
    return preprocess.balance_training_data(train)


# ---------------------------------------------------------------- preprocessing

_AGE = "try_cast(NU_IDADE_N AS double)"
_LEARNED_AGE = f"""
    , adm AS (SELECT *, {_PART} AS part, {_AGE} AS age FROM cases WHERE {_ELIGIBLE}),
    med AS (SELECT median(age) AS m FROM adm WHERE part = 'train'),
    st AS (SELECT any_value(m) AS m, avg(coalesce(age, m)) AS mu,
             stddev_pop(coalesce(age, m)) AS sd FROM adm, med WHERE part = 'train')"""
_CATEGORIES = ("CS_SEXO", "FEBRE", "DISPNEIA", "CARDIOPATI", "OBESIDADE")


def _train_modes(columns: tuple[str, ...], source: str, where: str) -> str:
    """One single-row table per column with its most frequent value, smallest on ties."""
    return ", ".join(
        f"mode_{c} AS (SELECT {c} AS v FROM {source} WHERE {where} AND {c} IS NOT NULL "
        f"GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" for c in columns)


def _one_hot(columns: tuple[str, ...], source: str, known: str) -> str:
    """Long rows for filled-in categories that occur in the training rows."""
    return " UNION ALL ".join(
        f"SELECT CASE_ID, part AS split, '{c}=' || coalesce({c}, v) AS atributo, 1.0::double "
        f"AS valor FROM {source}, mode_{c} WHERE coalesce({c}, v) IN "
        f"(SELECT coalesce({c}, v) FROM {source}, mode_{c} WHERE {known})" for c in columns)


@query("numeric_preprocess", over_cases(f"""{_LEARNED_AGE}
    SELECT CASE_ID, part AS split, round((coalesce(age, m) - mu) / sd, 6) AS NU_IDADE_N
    FROM adm, st"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = _admission(spark, sf)
    model = preprocess.fit_preprocessor(rows.filter("split = 'train'"),
                                        preprocess.Recipe(numeric=["NU_IDADE_N"]))
    scaled = preprocess.transform_partitions(model, rows)
    return scaled.select("CASE_ID", "split", F.round("NU_IDADE_N__num", 6).alias("NU_IDADE_N"))


@query("categorical_preprocess", over_cases(f"""{_LEARNED_AGE},
    {_train_modes(_CATEGORIES, 'adm', "part = 'train'")}
    {_one_hot(_CATEGORIES, 'adm', "part = 'train'")}"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = _admission(spark, sf)
    recipe = preprocess.Recipe(categorical=list(_CATEGORIES))
    model = preprocess.fit_preprocessor(rows.filter("split = 'train'"), recipe)
    return preprocess.long_form(model.transform(rows), preprocess.slot_names(model, recipe),
                                ["CASE_ID", "split"])


@query("preprocess_partitions", over_cases(f"""{_LEARNED_AGE},
    {_train_modes(("CS_SEXO", "SG_UF"), 'adm', "part = 'train'")}
    SELECT CASE_ID, part AS split, 'NU_IDADE_N' AS atributo,
      round((coalesce(age, m) - mu) / sd, 6) AS valor
    FROM adm, st WHERE coalesce(age, m) <> mu
    UNION ALL {_one_hot(("CS_SEXO", "SG_UF"), 'adm', "part = 'train'")}"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = _admission(spark, sf)
    train = rows.filter("split = 'train'")
    recipe = preprocess.admission_recipe(train, ["NU_IDADE_N", "CS_SEXO", "SG_UF"])
    model = preprocess.fit_preprocessor(train, recipe)
    out = preprocess.long_form(preprocess.transform_partitions(model, rows),
                               preprocess.slot_names(model, recipe), ["CASE_ID", "split"])
    return _rounded(out, "valor")


# ---------------------------------------------------------------- state-level benchmark

@query("legacy_targets", over_cases("""
    SELECT CASE_ID, 'EVOLUCAO' AS alvo, cast(EVOLUCAO = 2 AS int) AS label FROM explore
    WHERE EVOLUCAO IN (1, 2)
    UNION ALL SELECT CASE_ID, 'UTI', cast(UTI = 1 AS int) FROM explore WHERE UTI IN (1, 2)"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored_explored(spark, sf)
    parts = [dataset.state_target(rows, t).select("CASE_ID", F.lit(t).alias("alvo"), "label")
             for t in ("EVOLUCAO", "UTI")]
    return parts[0].union(parts[1])


_STATE_NUMBERS = ("NU_IDADE_N", "FEBRE", "DISPNEIA", "CARDIOPATI", "DIABETES", "OBESIDADE", "ASMA")


@query("legacy_feature_matrix", over_cases(f"""
    , base AS (SELECT *, 'all' AS part FROM explore WHERE EVOLUCAO IN (1, 2)),
    {', '.join(f"med_{c} AS (SELECT median(cast({c} AS double)) AS m FROM base)"
               for c in _STATE_NUMBERS)},
    {_train_modes(("CS_SEXO",), 'base', 'true')}
    {' UNION ALL '.join(
        f"SELECT CASE_ID, '{c}' AS atributo, coalesce(cast({c} AS double), m) AS valor "
        f"FROM base, med_{c} WHERE coalesce(cast({c} AS double), m) <> 0" for c in _STATE_NUMBERS)}
    UNION ALL SELECT CASE_ID, 'CS_SEXO=' || coalesce(CS_SEXO, v), 1.0::double
    FROM base, mode_CS_SEXO WHERE coalesce(CS_SEXO, v) <>
      (SELECT min(coalesce(CS_SEXO, v)) FROM base, mode_CS_SEXO)"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    matrix, names = models.state_matrix(stored_explored(spark, sf), "EVOLUCAO", "CASE_ID")
    return preprocess.long_form(matrix, names, ["CASE_ID"])


# ---------------------------------------------------------------- scores for evaluation

_SCORE = "round(floor(IDADE_ANOS / 5) * 0.03, 2)"
_SCORED = f"""
    , scored AS (SELECT CASE_ID, cast(EVOLUCAO = '2' AS int) AS label, {_SCORE} AS score
                 FROM cases WHERE EVOLUCAO IN ('1', '2') AND IDADE_ANOS IS NOT NULL)"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Cured and dead cases with a score that grows with age."""
    cases = stored_cases(spark, sf).filter("EVOLUCAO IN ('1', '2') AND IDADE_ANOS IS NOT NULL")
    return cases.select("CASE_ID", (F.col("EVOLUCAO") == "2").cast("int").alias("label"),
                        F.round(F.floor(F.col("IDADE_ANOS") / 5) * F.lit(0.03), 2).alias("score"))


@query("target_rates", over_cases(f"""{_SCORED}
    SELECT cast(count(*) AS bigint) AS n, cast(sum(label) AS bigint) AS positivos,
      round(avg(label), 6) AS taxa FROM scored"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(explore.target_rates(_scored(spark, sf)), "taxa")


_RANKED = """
    , ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CASE_ID), CASE_ID)
        AS pos, count(*) OVER (PARTITION BY label) AS size FROM scored)"""


@query("stratified_split", over_cases(f"""{_SCORED}{_RANKED},
    parts AS (SELECT DISTINCT label, size, (SELECT ceil(count(*) * 0.25) FROM scored) * size
        / (SELECT count(*) FROM scored) AS exact FROM ranked),
    quota AS (SELECT label, floor(exact) + CASE WHEN row_number() OVER
        (ORDER BY exact - floor(exact) DESC, label) <= (SELECT ceil(count(*) * 0.25) FROM scored)
          - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS q FROM parts)
    SELECT CASE_ID, label, CASE WHEN pos <= q THEN 'test' ELSE 'train' END AS split
    FROM ranked JOIN quota USING (label)"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return split.stratified_split(_scored(spark, sf), "label", "CASE_ID").select(
        "CASE_ID", "label", "split")


@query("cv_folds", over_cases(f"""{_SCORED}{_RANKED}
    SELECT CASE_ID, label, cast((pos - 1) % 5 AS int) AS fold FROM ranked"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return split.stratified_folds(_scored(spark, sf), "label", "CASE_ID").select(
        "CASE_ID", "label", "fold")


@query("class_weights", over_cases(f"""{_SCORED}
    SELECT label, cast(count(*) AS bigint) AS n,
      round((SELECT count(*) FROM scored) / (2.0::double * count(*)), 6) AS peso
    FROM scored GROUP BY label"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(split.class_weights(_scored(spark, sf), "label"), "peso")


# ---------------------------------------------------------------- evaluation

_POINTS = f"""{_SCORED},
    totals AS (SELECT sum(label) AS tp, sum(1 - label) AS tn FROM scored),
    d AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM scored GROUP BY score),
    points AS (SELECT score, p, n, sum(p) OVER w AS vp, sum(n) OVER w AS fp, tp, tn
               FROM d, totals WINDOW w AS (ORDER BY score DESC)),
    curve AS (SELECT score, vp / (vp + fp)::double AS pr, vp / tp::double AS re FROM points),
    f AS (SELECT score, pr, re, 2 * (pr * re) / (pr + re + 1e-12) AS f1 FROM curve)"""
_AUC = "sum(n * (vp - p + p / 2.0)) / (any_value(tp) * any_value(tn))::double"
_AP = "sum(p / tp::double * vp / (vp + fp)::double)"


@query("roc_points", over_cases(f"""{_POINTS}
    SELECT score AS limiar, round(fp / tn::double, 6) AS tfp, round(vp / tp::double, 6) AS tvp
    FROM points UNION ALL SELECT 'inf'::double, 0::double, 0::double"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.roc_points(_scored(spark, sf)), "tfp", "tvp")


@query("pr_curve", over_cases(f"""{_POINTS}
    SELECT score AS limiar, round(pr, 6) AS precisao, round(re, 6) AS recall, round(f1, 6) AS f1
    FROM f"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.pr_curve(_scored(spark, sf)), "precisao", "recall", "f1")


@query("best_threshold", over_cases(f"""{_POINTS}
    SELECT score AS limiar, round(f1, 6) AS f1, round(pr, 6) AS precisao, round(re, 6) AS recall
    FROM f ORDER BY f.f1 DESC, score LIMIT 1"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.best_threshold(_scored(spark, sf)), "f1", "precisao", "recall")


@query("average_precision", over_cases(f"""{_POINTS}
    SELECT round({_AUC}, 6) AS auc, round({_AP}, 6) AS precisao_media FROM points"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.ranking_metrics(_scored(spark, sf)), "auc", "precisao_media")


_CELLS = """count(*) FILTER (WHERE label = 1 AND score >= {t}) AS vp,
      count(*) FILTER (WHERE label = 0 AND score >= {t}) AS fp,
      count(*) FILTER (WHERE label = 1 AND score < {t}) AS fn,
      count(*) FILTER (WHERE label = 0 AND score < {t}) AS vn"""


@query("classification_metrics", over_cases(f"""{_POINTS},
    c AS (SELECT {_CELLS.replace('{t}', '0.3')} FROM scored)
    SELECT round((vp + vn) / (vp + fp + fn + vn)::double, 6) AS acuracia,
      round(vp / (vp + fp)::double, 6) AS precisao, round(vp / (vp + fn)::double, 6) AS recall,
      round(2 * vp / (2 * vp + fp + fn)::double, 6) AS f1,
      (SELECT round({_AUC}, 6) FROM points) AS auc,
      (SELECT round({_AP}, 6) FROM points) AS precisao_media FROM c"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.classification_metrics(_scored(spark, sf), threshold=0.3),
                    "acuracia", "precisao", "recall", "f1", "auc", "precisao_media")


@query("confusion_matrix", over_cases(f"""{_SCORED},
    g AS (SELECT r.i AS real, p.i AS previsto FROM range(2) r(i), range(2) p(i))
    SELECT cast(g.real AS int) AS real, cast(g.previsto AS int) AS previsto,
      cast(count(s.label) AS bigint) AS casos
    FROM g LEFT JOIN scored s ON s.label = g.real AND cast(s.score >= 0.3 AS int) = g.previsto
    GROUP BY ALL"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion_matrix(_scored(spark, sf), threshold=0.3)


def _report_sql(t: str) -> str:
    def line(name: str, p: str, r: str, f: str, n: str) -> str:
        return (f"SELECT round({t}, 6) AS limiar, '{name}' AS classe, round({p}, 6) AS precisao, "
                f"round({r}, 6) AS recall, round({f}, 6) AS f1, "
                f"cast({n} AS bigint) AS suporte FROM k")
    rows = [line("sobrevivente", "p0", "r0", "f0", "n0"), line("obito", "p1", "r1", "f1", "n1"),
            line("accuracy", "a", "a", "a", "n0 + n1"),
            line("macro avg", "(p0 + p1) / 2", "(r0 + r1) / 2", "(f0 + f1) / 2", "n0 + n1"),
            line("weighted avg", "(p0 * n0 + p1 * n1) / (n0 + n1)",
                 "(r0 * n0 + r1 * n1) / (n0 + n1)", "(f0 * n0 + f1 * n1) / (n0 + n1)", "n0 + n1")]
    return f"""(WITH c AS (SELECT {_CELLS.replace('{t}', t)} FROM scored),
      k AS (SELECT coalesce(vn / nullif(vn + fn, 0)::double, 0) AS p0, vn / (vn + fp)::double AS r0,
        2 * vn / (2 * vn + fn + fp)::double AS f0, vn + fp AS n0,
        coalesce(vp / nullif(vp + fp, 0)::double, 0) AS p1, vp / (vp + fn)::double AS r1,
        2 * vp / (2 * vp + fp + fn)::double AS f1, vp + fn AS n1,
        (vp + vn) / (vp + fp + fn + vn)::double AS a FROM c)
      {' UNION ALL '.join(rows)})"""


@query("classification_report", over_cases(
    f"{_POINTS}, best AS (SELECT score AS t FROM f ORDER BY f1 DESC, score LIMIT 1) "
    f"{_report_sql('0.5::double')} UNION ALL {_report_sql('(SELECT t FROM best)')}"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scored(spark, sf)
    tuned = evaluate.best_threshold(scored).first()["limiar"]
    return _rounded(evaluate.classification_report(scored, [0.5, tuned]),
                    "limiar", "precisao", "recall", "f1")


@query("best_model", over_cases(f"""{_SCORED},
    s AS (SELECT 'idade' AS modelo, label, score FROM scored
          UNION ALL SELECT 'idade_invertida', label, -score FROM scored
          UNION ALL SELECT 'faixa_larga', label, floor(score / 0.15) FROM scored),
    d AS (SELECT modelo, score, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY ALL),
    points AS (SELECT modelo, p, n, sum(p) OVER w AS vp, sum(p) OVER (PARTITION BY modelo) AS tp,
                 sum(n) OVER (PARTITION BY modelo) AS tn
               FROM d WINDOW w AS (PARTITION BY modelo ORDER BY score DESC))
    SELECT modelo, round({_AUC}, 6) AS auc FROM points GROUP BY modelo
    ORDER BY auc DESC, modelo LIMIT 1"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scored(spark, sf)
    variants = {"idade": F.col("score"), "idade_invertida": -F.col("score"),
                "faixa_larga": F.floor(F.col("score") / F.lit(0.15)).cast("double")}
    wide = scored.select("label", *[c.alias(n) for n, c in variants.items()])
    long = wide.unpivot(["label"], list(variants), "modelo", "score")
    metrics = evaluate.ranking_metrics(long, by=["modelo"]).select("modelo", "auc")
    return _rounded(evaluate.best_model(metrics), "auc")


# ---------------------------------------------------------------- patient level

@query("patient_target", over_cases("""
    SELECT CASE_ID, cast(EVOLUCAO IN ('2', '3') AS int) AS OBITO FROM cases
    WHERE EVOLUCAO IN ('1', '2', '3')"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.patient_target(stored_cases(spark, sf)).select("CASE_ID", "OBITO")


_FLAGS = ("FEBRE", "DISPNEIA", "CARDIOPATI", "OBESIDADE", "DIABETES", "ASMA", "UTI")


@query("patient_preprocess", over_cases(f"""
    , base AS (SELECT *, {_AGE} AS age FROM cases WHERE EVOLUCAO IN ('1', '2', '3')),
    med AS (SELECT median(age) AS m FROM base),
    st AS (SELECT any_value(m) AS m, avg(coalesce(age, m)) AS mu,
             stddev_pop(coalesce(age, m)) AS sd FROM base, med)
    SELECT CASE_ID, 'NU_IDADE_N' AS atributo, round((coalesce(age, m) - mu) / sd, 6) AS valor
    FROM base, st WHERE coalesce(age, m) <> mu
    UNION ALL {' UNION ALL '.join(
        f"SELECT CASE_ID, '{c}=' || coalesce({c}, '9'), 1.0::double FROM base" for c in _FLAGS)}
    UNION ALL SELECT CASE_ID, 'CS_SEXO=' || coalesce(CS_SEXO, 'DESCONHECIDO'), 1.0::double
    FROM base"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = dataset.patient_target(stored_cases(spark, sf))
    recipe, _absent = preprocess.patient_recipe(rows)
    rows = preprocess.unify_categorical_types(
        rows.select("CASE_ID", *recipe.numeric, *recipe.categorical), recipe.categorical).withColumn(
        "NU_IDADE_N", F.col("NU_IDADE_N").try_cast("double"))
    # the statistics below read these rows many times
    rows = cut_lineage(rows)
    model = preprocess.fit_preprocessor(rows, recipe)
    return _rounded(preprocess.long_form(model.transform(rows),
                                         preprocess.slot_names(model, recipe), ["CASE_ID"]),
                    "valor")


# ---------------------------------------------------------------- fitted models (rows only)

def _patient(spark: SparkSession, sf: str) -> models.PatientData:
    return models.patient_data(stored_cases(spark, sf))


# the two outcomes of the state benchmark
TARGETS = ("EVOLUCAO", "UTI")


def _state_benchmarks(spark: SparkSession, sf: str) -> dict[str, models.StateBenchmark]:
    """The benchmark of each target that has enough rows of both classes; targets side by side."""
    rows = stored_explored(spark, sf)
    found = models.in_parallel({t: (lambda t=t: models.state_benchmark(rows, t)) for t in TARGETS}, len(TARGETS))
    return {t: b for t, b in found.items() if b is not None}


@query("model_comparison")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "metrics")
    schema = ("modelo string, acuracia double, precisao double, recall double, f1 double, "
              "auc double, precisao_media double, alvo string")
    found = _state_benchmarks(spark, sf)
    for target, benchmark in found.items():
        benchmark.write_metrics(f"{path}/alvo={target}")
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.option("header", True).csv(path, schema=schema)


@query("feature_importance")
def _(spark: SparkSession, sf: str) -> DataFrame:
    none = spark.createDataFrame(
        [], "modelo string, atributo string, importancia double, posicao int, alvo string")
    return union_by_name([none, *(b.importance().withColumn("alvo", F.lit(t))
                                  for t, b in _state_benchmarks(spark, sf).items())])


@query("pca_components")
def _(spark: SparkSession, sf: str) -> DataFrame:
    data = _patient(spark, sf)
    return models.fit_reduction(data.part("train"), data.recipe).components(spark)


@query("pca_loadings")
def _(spark: SparkSession, sf: str) -> DataFrame:
    data = _patient(spark, sf)
    return models.fit_reduction(data.part("train"), data.recipe).loadings(spark)


def _patient_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all five models on the test part, written once for what reads them."""
    data = _patient(spark, sf)
    return cut_lineage(models.fit_patient_models(data).score(data.part("test")))


@query("patient_models")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.classification_metrics(_patient_scores(spark, sf), label="OBITO", by=["modelo"])


@query("stacking")
def _(spark: SparkSession, sf: str) -> DataFrame:
    scored = _patient_scores(spark, sf).filter("modelo = 'stacking_ensemble'")
    return evaluate.classification_metrics(scored, label="OBITO", by=["modelo"])


_validated: dict[tuple[str, str], DataFrame] = {}


def _cv_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-validated scores of all five models, written the first time a session asks."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _validated:
        data = _patient(spark, sf)
        _validated[key] = cut_lineage(models.cv_scores(
            models.cross_validate(data.part("train"), data.recipe)))
    return _validated[key]


@query("cv_scores")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _cv_scores(spark, sf)


@query("save_model")
def _(spark: SparkSession, sf: str) -> DataFrame:
    data = _patient(spark, sf)
    name = evaluate.best_model(_cv_scores(spark, sf), metric="roc_auc").first()["modelo"]
    fitted = models.fit_patient_models(data)
    scored = cut_lineage(fitted.score(data.part("test")).filter(F.col("modelo") == name))
    threshold = evaluate.best_threshold(scored, label="OBITO").first()["limiar"]
    path = new_folder(spark, "model")
    columns = [*data.recipe.numeric, *data.recipe.categorical]
    models.save_model(fitted, name, threshold, columns, path, spark)
    pipeline, metadata = models.load_model(spark, path)
    test = pipeline.transform(data.part("test"))
    counts = test.groupBy(F.lit(name).alias("modelo")).agg(
        F.count(F.lit(1)).alias("casos"), F.sum(f"pred_{name}").cast("bigint").alias("previstos"))
    return metadata.join(counts, "modelo")
