import pytest

from shardloom.plans.queries import QUERIES, SQL
from tests.oracle import same

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_its_sql_gives(spark, name):
    same(QUERIES[name](spark, DATA), SQL[name], DATA)


def test_every_dataset_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["file", "segment", "shard_id", "offset", "global_offset"]
