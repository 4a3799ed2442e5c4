import __spark_entry__ as entry
import pytest

SMALL = "/root/testdata/sf0.001"
HERE = __import__("os").path.isdir(SMALL)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not HERE, reason="no test data")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "chain_len" in df.columns
