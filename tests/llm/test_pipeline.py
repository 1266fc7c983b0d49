"""The corpus pipeline and the registered queries."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quarry.llm import common, queries

from .conftest import DOC_SCHEMA, rows

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(names) | {"pipeline"} <= set(entry.queries())
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    from tests import compare

    assert compare.difference(spark, compare.connection(FOLDER), FOLDER, queries.queries()[name], queries.oracle_sql()[name]) is None


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, empty):
    docs = spark.createDataFrame([] if empty else rows(), DOC_SCHEMA)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.written(stage(spark, docs, FOLDER), "stage")
        seen.append((name, before.count(), docs.count()))
        if name != "sentencepiece":
            assert docs.columns == before.columns
    assert empty or seen[0][1] >= seen[0][2] > 0
    assert empty or seen[1][2] < seen[1][1] and seen[2][1] == seen[2][2] and seen[4][1] == seen[4][2]


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 0 and out.where("not round_trip").count() == 0
