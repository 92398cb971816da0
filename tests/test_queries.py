import pytest

from compare import assert_same
from trovelight.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir)


def test_every_query_runs_and_keeps_its_schema(spark, sf_dir):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, sf_dir).count() > 0, name


def test_inverted_file_finds_nine_of_ten(spark, sf_dir):
    assert registry.queries()["vector_recall"](spark, sf_dir).first()["recall"] >= 0.9


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
