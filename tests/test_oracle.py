"""Every registered query against its DuckDB oracle (sf0.001), and the
driver entry point."""

import pytest

from papyra.plans import check
from papyra.plans.catalog import load_all

SF_SMALL = "/root/testdata/sf0.001"

REG = load_all()


@pytest.fixture(scope="module")
def duck():
    return check.duck_connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(REG))
def test_query_matches_oracle(spark, duck, name):
    fn, sql = REG[name]
    res = check.compare(spark, SF_SMALL, name, fn, sql, duck)
    assert sql is not None, "every query of the core has an oracle"
    assert res["values_match"], res


def test_entry(spark):
    import importlib.util
    import os
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(here, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.columns == ["query_doc_id", "doc_id", "paper_id", "title", "score", "candidate_rank", "rank"]
    con = check.duck_connect(SF_SMALL)
    assert df.count() == len(con.sql(REG[mod.FLAGSHIP][1]).df()) > 0
    assert set(REG) <= set(mod.queries()) and set(REG) <= set(mod.oracle_sql()) <= set(mod.queries())
