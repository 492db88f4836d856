"""What operators leave on disk: shuffle files and passing tables."""

import time
from pathlib import Path

import corpus_pipeline
from text_fixtures import frame, shipped  # noqa: F401

from casoteca.llm import repeats
from casoteca.sources.workspace import cut_lineage, passing_tables, shared_root


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def tables(spark):
    return {p.name for p in Path(shared_root(spark)).glob("casoteca/*/table-*")}


def left_over(spark, before):
    """New shuffle files that are still there after 10 s; Spark removes them in the background."""
    for _ in range(20):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.5)
    return left


def texts(rows=300):
    return [(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(40 + i % 30))) for i in range(rows)]


def test_repeats_leave_no_shuffle_files(spark, frame):
    before = shuffle_files(spark)
    found = repeats.remove_repeats(frame(texts()), keep_text=True)
    assert not left_over(spark, before)
    assert found.where("n_removed > 0").count() > 0 and found.count() == 300
    assert found.count() == 300 and found.groupBy("n_words").count().count() == 30


def test_near_duplicates_leave_two_tables(spark, frame):
    docs = frame(texts())
    before, known = shuffle_files(spark), tables(spark)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert not left_over(spark, before)
    assert len(tables(spark) - known) == 2             # the numbered rows and the numbers of those that go
    assert 0 < left.count() < 300 and left.count() == left.distinct().count()


def test_passing_tables(spark):
    known = tables(spark)
    outer = cut_lineage(spark.range(5))
    with passing_tables(spark):
        inner = cut_lineage(outer.where("id > 1"))
        with passing_tables(spark):
            assert cut_lineage(inner.where("id > 3")).count() == 1
        assert len(tables(spark) - known) == 2
        kept = cut_lineage(inner.where("id > 2"), keep=True)
    assert outer.count() == 5 and kept.count() == 2 and len(tables(spark) - known) == 2
