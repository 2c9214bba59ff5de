"""Every query of the subpackage: against its SQL, or that it runs and has the right columns."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import assert_same, connect  # noqa: E402

from pagesift.llm.catalogue import QUERIES, SQL  # noqa: E402

COLUMNS = {
    "p1_found": ["top_k", "page_id", "hit_id"], "p2_found": ["page_id", "group_no"], "p3_found": ["id_a", "id_b"], "p4_found": ["sample_id", "label", "lang"],
    "p5_found": ["key_a", "key_b"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, con, name):
    assert_same(QUERIES[name](spark, data).toPandas(), con.execute(SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    assert len(set(map(str, rows))) == len(rows)


def test_every_problem_has_queries():
    assert {n.split("_")[0] for n in QUERIES} == {f"p{i}" for i in range(1, 9)}
