import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as C
from wattframe.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in C.STAGES]
    assert names == ["quality", "lines", "near", "mix", "pack"]
    made = {}
    now = docs
    for name, stage in C.STAGES:
        now = made[name] = stage(spark, now, SF).cache()
        assert name == "pack" or now.columns == docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi")
    assert good.join(made["quality"], "doc_id", "left_anti").count() <= 0.02 * good.count()
    assert made["lines"].count() == made["quality"].count()
    near = made["near"]
    assert near.count() == near.select("doc_id").distinct().count() < made["lines"].count()
    mixed = {r.doc_id for r in made["mix"].collect()}
    assert mixed <= {r.doc_id for r in near.collect()}
    assert {r.doc_id for r in made["pack"].collect()} == mixed


def test_run_gives_the_last_stage(spark):
    assert C.run(spark, SF).agg(F.max("offset")).first()[0] < 1024


def test_queries_are_registered():
    every = entry.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(every)
    assert set(queries.ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_agree_with_sql(spark, name):
    from oracle import compare, connect

    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name]) is None
