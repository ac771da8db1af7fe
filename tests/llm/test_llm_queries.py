"""The corpus queries against their SQL, and every operator on awkward tables."""

from __future__ import annotations

import pytest
from compare import connect, differences
from conftest import SF, SF_SMALL
from llm_tables import CLASHING, awkward, empty

import __spark_entry__ as contract
from skylag.llm import chat, decontaminate, exact_dedup, jaccard_join, licenses, packing, quality, secrets, sharding, warc
from skylag.llm.queries import ORACLES, QUERIES, archive, vocabulary


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_all_operators_and_the_pipeline_are_registered():
    names = contract.queries()
    assert [n for k in range(1, 14) for n in names if n.startswith(f"op{k}_")] == list(QUERIES)
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, SF), duck, ORACLES[name]) == []


OPERATORS = {
    "shard": lambda d, spark: sharding.shard(d, 4),
    "quality": lambda d, spark: quality.score(d, spark.createDataFrame([(1, 1), (2, 0), (7, 0)], "doc_id long, quality int"), contract_good()),
    "select": lambda d, spark: quality.select_documents(d, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), contract_good()),
    "duplicates": lambda d, spark: exact_dedup.duplicates(d),
    "deduplicate": lambda d, spark: exact_dedup.deduplicate(d),
    "jaccard": lambda d, spark: jaccard_join.near_duplicates(d),
    "keep one": lambda d, spark: jaccard_join.keep_one(d),
    "contamination": lambda d, spark: decontaminate.contamination(d, spark.createDataFrame([(1, "a b"), (None, "x"), (3, None)], "item_id long, text string")),
    "decontaminate": lambda d, spark: decontaminate.decontaminate(d, spark.createDataFrame([(1, "a b")], "item_id long, text string")),
    "no benchmark": lambda d, spark: decontaminate.contamination(d, spark.createDataFrame([], "item_id long, text string")),
    "pack": lambda d, spark: packing.pack_documents(d, vocabulary()),
    "secrets": lambda d, spark: secrets.digest(secrets.find_secrets(d)),
    "licenses": lambda d, spark: licenses.scan(d),
}
WHOLE_ROWS = {"select", "deduplicate", "keep one", "decontaminate"}


def contract_good():
    from pyspark.sql import functions as F

    return F.col("quality") == 1


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table_gives_empty_result(spark, name):
    assert OPERATORS[name](empty(spark), spark).count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_rows_get_one_result_each(spark, name):
    docs = awkward(spark)
    out = OPERATORS[name](docs, spark)
    rows = out.collect()
    n = docs.count()
    if name in WHOLE_ROWS:
        assert out.columns == docs.columns and set(CLASHING) <= set(out.columns)
        assert 0 < len(rows) <= n
    elif name == "pack":
        assert len({(r["doc_id"], r["piece"]) for r in rows}) <= len(rows) and len(rows) >= n
    else:
        assert len(rows) == n


def test_empty_conversations_and_archive(spark):
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert warc.resolve(archive(spark.read.parquet(f"{SF_SMALL}/pages.parquet").limit(0))).count() == 0
