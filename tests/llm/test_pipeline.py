import corpus_pipeline
from flowgauge.llm.registry import MODULES
from pyspark.sql import functions as F

from tests.llm.conftest import SMALL
from tests.llm.test_near_duplicates import brute


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in MODULES) == list(range(1, 14))


def test_stages(spark, documents, prose):
    base = prose(1, 80)
    rows = [
        (1, base), (2, base + " end"), (3, prose(2, 90) + "\nHome | News | Help | More\nwrite to a.b@c.example now"), (3, prose(2, 90)),
        (4, "short"), (5, None), (6, ""), (None, prose(3, 50)), (7, prose(4, 60)), (7, prose(4, 60)),
    ]
    docs = documents([r for r in rows if r != (3, prose(2, 90))]).withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.withColumn("kept", F.lit("own"))
    good = corpus_pipeline.good_lines(spark, docs, SMALL)
    assert good.columns == docs.columns
    kept = {r.doc_id: r for r in good.collect()}
    assert set(kept) == {1, 2, 3, None, 7} and all(r.kept == "own" for r in kept.values())
    assert "Home" not in kept[3].text and kept[3].n_chars == len(kept[3].text)
    single = corpus_pipeline.one_of_each_group(spark, good, SMALL)
    assert sorted(str(r.doc_id) for r in single.collect()) == ["1", "3", "7", "None"] and single.columns == docs.columns
    clean = {r.doc_id: r for r in corpus_pipeline.masked_personal_data(spark, single, SMALL).collect()}
    assert "[email]" in clean[3].text and clean[3].n_chars == len(clean[3].text) and clean[1].text == base
    pieces = corpus_pipeline.packed(spark, spark.createDataFrame(list(clean.values()), docs.schema), SMALL)
    assert {r.doc_id for r in pieces.collect()} == {1, 3, 7, None}


def test_no_text_is_lost_by_its_id(spark, documents, prose):
    rows = [(1, prose(1, 60)), (1, prose(2, 60)), (1, prose(2, 60)), (None, prose(3, 60)), (None, prose(3, 60)), (None, prose(4, 60)), (2, prose(4, 60))]
    rows += [(-5, prose(1, 60) + " end")]
    kept = corpus_pipeline.one_of_each_group(spark, documents(rows), SMALL).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted(
        [("-5", prose(1, 60) + " end"), ("1", prose(2, 60)), ("None", prose(3, 60)), ("2", prose(4, 60))]
    )


def test_empty_table(spark, documents):
    docs = documents([(1, "x")]).withColumn("n_chars", F.lit(1).cast("long")).where("false")
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SMALL)
        assert found.count() == 0, name
        assert name == "packing" or found.columns == docs.columns


HARD = [" " * 2_000_000, "a" + "\n" * 2_000_000 + "b", "\t" * 2_000_000, "0" * 5000 + ".1.1.1", "w" * 5_000_000, "9" * 100_000 + "@x.y"]


def test_no_text_ends_a_stage(spark, documents):
    docs = documents(list(enumerate(HARD))).withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).select("doc_id").distinct().count() == (0 if name == "quality_rules" else len(HARD)), name


def test_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    quiet = corpus_pipeline.without_toxic(spark, docs, SMALL)
    assert quiet.columns == docs.columns
    lost = docs.join(quiet, "doc_id", "left_anti").join(labels, "doc_id").where("toxic = 0").count()
    assert lost <= 1
    good = corpus_pipeline.good_lines(spark, quiet, SMALL)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    groups = {component for _, component in brute(rows).values()}
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in pieces} == groups
