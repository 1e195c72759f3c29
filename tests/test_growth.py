"""What queries shuffle, against the size of their tables."""

import os

import pytest

from flowtide.operators import names
from flowtide.plans.figures import measured
from flowtide.queries import QUERIES
from flowtide.sources import tables

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="supplied tables are not here")


def shuffled(spark, query, data=DATA):
    with measured(spark) as cost:
        query(spark, data).write.format("noop").mode("overwrite").save()
    return cost["rows_shuffled"]


@pytest.mark.parametrize(("name", "most"), [("call_edges", 1.5), ("definition_chains", 2), ("reached_from_alloc_forward", 2), ("call_reach", 1.5), ("arg_param_match", 4), ("unresolved_calls", 4)])
def test_nodes_are_shuffled_once_or_twice(spark, name, most):
    """Chains within functions are followed by one sort of the nodes; joins see only definitions that take a value from another one."""
    assert shuffled(spark, QUERIES[name]) < most * tables.load(spark, DATA, "lineitem").count()


def test_pairs_of_paths_are_not_shuffled(spark):
    """dep_reach has 33 pairs an event; what is shuffled are links, a few times."""
    assert shuffled(spark, QUERIES["dep_reach"]) < 25 * tables.load(spark, DATA, "events").count()


def test_names_seen_below_wide_ancestors(spark, monkeypatch):
    """Ancestors of many functions are looked up apart from the others; the rows are the same."""
    rows = lambda: sorted(map(tuple, QUERIES["visible_in"](spark, DATA).collect()))
    want = rows()
    monkeypatch.setattr(names, "WIDE", 6)
    assert rows() == want


def test_resolving_joins_what_is_new(spark):
    """resolve_calls sorts nodes by their values twice, whatever the number of rounds; a round shuffles what is asked anew, and values are asked once for all queries."""
    assert shuffled(spark, QUERIES["resolve_calls"]) < 8 * tables.load(spark, DATA, "lineitem").count()


@pytest.mark.parametrize("name", ["forward_reach", "backward_reach", "forward_callers"])
def test_functions_are_walked_in_one_pass(spark, name):
    """Nodes are brought together by function once, not joined anew in each round."""
    assert shuffled(spark, QUERIES[name]) < 12 * tables.load(spark, DATA, "lineitem").count()
