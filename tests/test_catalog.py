import pytest

from marlstone.plans import catalog, catalog_index  # noqa: F401
from tests.compare import same


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, small, name):
    same(catalog.QUERIES[name](spark, small), catalog.SQL[name], small)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_embedding_has_unit_length(spark, small):
    for r in catalog.embed_hash(spark, small).collect():
        assert abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5


def test_filters_reach_the_scan(spark, small):
    plan = catalog.metadata_filter(spark, small)._jdf.queryExecution().toString()
    assert "EqualTo(source,src3)" in plan and "EqualTo(lang,en)" in plan
    assert "text:string" not in plan.split("ReadSchema")[1]
