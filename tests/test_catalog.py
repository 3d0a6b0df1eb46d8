import parity
import pytest

from pairbench.plans import catalog, contract, corpus, genome, lookups, names, reports, scores, study

EVERY = {name: (query, sql) for part in (catalog, study, contract, lookups, names, scores, genome, reports, corpus) for name, query, sql in part.CATALOG}


@pytest.mark.parametrize("name", [n for n, (_, sql) in EVERY.items() if sql])
def test_query_equals_sql(spark, sf_dir, name):
    query, sql = EVERY[name]
    assert parity.spark_rows(query(spark, sf_dir)) == parity.sql_rows(sf_dir, sql)
