"""Driver contract: entry runs, every query has a callable, oracle keys are queries."""

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["query_id", "rank", "date", "url", "score", "sentence", "sentence_distance"]


def test_oracle_keys_are_registered():
    assert set(E.oracle_sql()) <= set(E.queries())
