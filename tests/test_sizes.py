"""What must not go by way of the driver, told from plans: texts and rows made from them look small to the planner."""

import re

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["rule_cognitive", "aliased_imports", "configured_imports", "import_verdicts", "violation_snippets", "block_findings", "methods_from_text", "type_findings", "definitions_from_text", "grouped_report", "symbol_graph"])
def test_no_derived_table_is_broadcast(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and not re.findall(r"Broadcast\w+Join \[(?!_size|_part|law)[^\]]*\][^\n]*", plan)


def test_locality_report_judges_edges_once(spark):
    plan = entry.queries()["locality_report"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
