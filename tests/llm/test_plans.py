"""Shapes of the physical plans of the training-data queries."""

import pytest

from weir.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
PYTHON = ("EvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups", "FlatMapCoGroups")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_native_where_asked(spark, name):
    text = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name.split("_")[0] in ("op5", "op9", "op10", "op11"):
        assert not any(x in text for x in PYTHON)


def test_the_texts_are_dealt_out_once(spark):
    """op13 shuffles the texts in one exchange that all its uses read."""
    text = QUERIES["op13_suffixes"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(doc_id") >= 1 and "CollectLimit" not in text
