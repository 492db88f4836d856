"""The near-duplicate stage of the pipeline on rows that share an id or have none."""

import corpus_pipeline
from text_fixtures import shipped  # noqa: F401


def test_one_row_of_each_group_stays(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcde"}
    rows = [(1, text["a"], "w"), (1, text["a"], "w"),              # a row that occurs twice
            (2, text["b"], "w"), (7, text["b"], "x"), (7, text["c"], "y"),  # a copy shares its id with a clean text
            (None, text["d"], "x"), (None, text["d"], "y"), (9, text["d"], "z"),
            (None, text["e"], "x"), (None, text["e"], "x"), (5, None, "n"), (6, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=repr) == sorted([
        (1, text["a"], "w"), (2, text["b"], "w"), (7, text["c"], "y"), (9, text["d"], "z"),
        (None, text["e"], "x"), (5, None, "n"), (6, "", "e")], key=repr)


def odd_documents(spark, rows):
    """Documents with columns whose names clash with those of the operators."""
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long") \
        .selectExpr("doc_id", "text", "n_chars", "1 as row", "'x' as id", "'h' as hit", "2 as n", "cast(null as int) as doc") \
        .repartition(3)


def test_stages_keep_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 200").orderBy("item_id").first().text
    clean = [" ".join(f"{c}{i}" for i in range(60)) for c in "uvw"]
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, clean[0], 9), (1, clean[1], 9), (None, clean[2], 9), (None, None, None), (3, "", 0), (3, "", 0),
            (4, None, None), (5, passage + " one", 9), (6, "two " + passage, 9), (7, item, 9), (7, "x y z", 9),
            (8, "word " * 120_000, 9)]
    docs = odd_documents(spark, rows)
    key = lambda r: tuple((x is None, x) for x in r)

    def left(stage):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        return sorted((r[:3] for r in map(tuple, out.collect())), key=key)

    assert left(corpus_pipeline.drop_benchmark) == sorted((r for r in rows if r[1] != item), key=key)
    kept = left(corpus_pipeline.drop_repeats)
    changed = {(6, "two", 3), (8, "word", 4)}
    assert kept == sorted([r for r in rows if r[0] not in (6, 8)] + list(changed), key=key)
    toxic = left(corpus_pipeline.drop_toxic)
    assert set(toxic) <= set(rows) and {r[1] for r in toxic} >= {None, "", "x y z", *clean}
    coded = corpus_pipeline.encode(spark, docs.withColumn("lang", docs["id"]).withColumn("source", docs["id"]), sf)
    assert coded.count() == len(rows)


def test_stages_on_an_empty_table(spark):
    docs = odd_documents(spark, []).selectExpr("*", "id as lang", "id as source")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0
