"""Physical plans: what is read, what moves, what is broadcast."""

import os
import re

import pytest

from alertfold.operators.boxes import assign_boxes
from alertfold.operators.folding import compact
from alertfold.options import Options
from alertfold_checks import queries as registry
from alertfold_checks.inputs import Inputs

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, SF_DIR)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moves(df):
    return len(re.findall(r"Exchange (?:hash|range|Single|Round)", plan(df)))


BATCH = [n for n in registry.QUERIES if n not in ("enqueue", "read_spool", "write_outbox") and "stream" not in n]


@pytest.mark.parametrize("name", BATCH)
def test_no_query_joins_everything_with_everything(inputs, name):
    text = plan(registry.QUERIES[name](inputs))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_compaction_moves_messages_twice(inputs):
    """Once to number them per chat and tick, once to spread the boxes."""
    assert moves(assign_boxes(inputs.alerts, 86_400)) == 1
    assert moves(compact(inputs.alerts, Options(wait=86_400))) == 2
    assert moves(compact(inputs.alerts, Options(), tick=7)) == 2
    assert moves(compact(inputs.notes, Options())) == 2
    for name in ("similarity_pairs", "assign_heads", "resolve_roots", "group_sizes", "singles", "fold_groups"):
        assert moves(registry.QUERIES[name](inputs)) == 2, name


def test_broadcast_mutes_do_not_move_messages(inputs):
    text = plan(registry.QUERIES["compact"](inputs))
    scans = [line for line in text.splitlines() if "Exchange hashpartitioning(chat_id" in line]
    assert len(scans) == 1 and text.count("REPARTITION_BY_NUM") == 1 and text.count("BroadcastHashJoin") == 3 and "LeftAnti" in text


def test_distances_stay_in_the_jvm(inputs):
    for name in ("similarity_pairs", "assign_heads", "resolve_roots", "group_sizes"):
        assert "ArrowEvalPython" not in plan(registry.QUERIES[name](inputs)), name


def test_distances_are_computed_once(inputs):
    """Arrays of a box are used several times; none of the uses may compute them again."""
    for name in ("similarity_pairs", "assign_heads", "resolve_roots", "group_sizes", "fold_groups", "compact"):
        text = registry.QUERIES[name](inputs)._jdf.queryExecution().executedPlan().toString()
        assert text.count("levenshtein(") == 1, name
        assert text.count("array_position(") <= 3, name


def test_scans_read_what_they_need(inputs):
    text = plan(registry.QUERIES["open_problems"](inputs))
    (customers,) = [line for line in text.splitlines() if "customer.parquet" in line]
    assert "c_mktsegment" not in customers
    (orders,) = [line for line in text.splitlines() if "FileScan" in line and "orders.parquet" in line]
    assert "GreaterThanOrEqual(o_orderdate" in orders
    text = plan(registry.QUERIES["list_actions"](inputs))
    (parts,) = [line for line in text.splitlines() if "part.parquet" in line]
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_size:int>" in parts
    text = plan(registry.QUERIES["maintenance_log_from_commands"](inputs))
    assert "Exchange" not in text


def test_aggregates_combine_before_they_move(inputs):
    text = plan(registry.QUERIES["latest_event"](inputs))
    assert text.count("HashAggregate") + text.count("SortAggregate") >= 2
    assert moves(registry.QUERIES["latest_event"](inputs)) == 1


def test_pages_come_from_one_scan(inputs):
    """One of triggers and one of their events; the problems themselves are computed once."""
    text = plan(registry.QUERIES["paginate_problems"](inputs))
    assert text.count("FileScan parquet") == 2 and text.count("WindowGroupLimit") == 0
