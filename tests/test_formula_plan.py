"""Lines of formulas are not sent through the driver."""

from oracle import SF

from fathomline import registry


def test_lines_are_not_broadcast(spark):
    text = registry.QUERIES["formula_lines"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Broadcast" not in text
