"""Set-valued relations: live sets and maps, joins on call edges and points-to facts, counts and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import closure, closure_by_doubling, propagate
from ..plans.program import Program


def multimap(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, size): each key's distinct values and how many there are."""
    sets = pairs.select(key, value).distinct()
    return sets.join(sets.groupBy(key).agg(F.count("*").alias("size")), key)


def total_facts(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Sum of the sizes of all sets."""
    return pairs.select(key, value).distinct().agg(F.count("*").alias("total"))


def contained(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    return candidates.join(edges, edges.columns, "left_semi")


def tag_counts(events: DataFrame, tag: str) -> DataFrame:
    """Tags by how often they occur, most first, ties by tag."""
    return events.groupBy(tag).agg(F.count("*").alias("count")).orderBy(F.desc("count"), tag)


def argument_matches(p: Program, call_edge: DataFrame) -> DataFrame:
    """(call_id, callee_id, position, reg, param): arguments that have a parameter; others are dropped."""
    params = p.heads.select(F.col("func_id").alias("callee_id"), F.posexplode("params").alias("position", "param"))
    return call_edge.join(p.call_arg.withColumnRenamed("node_id", "call_id"), "call_id").join(params, ["callee_id", "position"]).select("call_id", "callee_id", "position", "reg", "param")


def unresolved(p: Program, call_edge: DataFrame) -> DataFrame:
    """External calls without a callee."""
    return p.node.where("kind = 'Call' and not is_internal").select(F.col("node_id").alias("call_id")).join(call_edge, "call_id", "left_anti")


def unhandled(p: Program, states: DataFrame, call_edge: DataFrame, handled: DataFrame | None = None) -> DataFrame:
    """Of the values that queries reach at calls (call_id, key, query_id), those at external calls without a callee that weren't handled before.

    What was handled is told apart by call, value and query: another value at the same call is still open.
    """
    left = states.join(unresolved(p, call_edge), "call_id", "left_semi")
    return left if handled is None else left.join(handled, ["call_id", "key", "query_id"], "left_anti")


def edge_count(call_edge: DataFrame) -> DataFrame:
    return call_edge.select("call_id", "callee_id").distinct().agg(F.count("*").alias("edges"))


def function_reach(p: Program, call_edge: DataFrame) -> DataFrame:
    """(src, dst): every function dst that some chain of calls leads to from function src, for all functions and edges.

    Edges that come with the calling function (func_id) don't have it looked up among all nodes.
    """
    if "func_id" not in call_edge.columns:
        call_edge = call_edge.join(p.node.select(F.col("node_id").alias("call_id"), "func_id"), "call_id")
    return closure(call_edge.select(F.col("func_id").alias("src"), F.col("callee_id").alias("dst")))


def dependencies(pairs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """All queries that a query (src) depends on, directly or not."""
    if asked is None:
        return closure_by_doubling(pairs, "from_query", "to_query")
    return closure(pairs, "from_query", "to_query", asked)


def error_rollup(pairs: DataFrame, errors: DataFrame) -> DataFrame:
    """(from_query, error): errors of a query and of all it depends on, taken along the dependencies (from_query, to_query)."""
    return propagate(pairs.toDF("src", "dst"), errors.select(F.col("query_id").alias("node"), F.col("error").alias("label"))).toDF("from_query", "error")


def query_counts(asked: DataFrame) -> DataFrame:
    """(direction, queries, calls, accesses) of asked nodes (direction, node_id, kind, func_reg): how many there are, and the calls and property accesses among them."""
    is_call = F.col("kind") == "Call"
    access = F.when(F.col("kind").isin("ReadProperty", "WriteProperty") | (is_call & (F.col("func_reg") == -1)), F.col("node_id"))
    return asked.groupBy("direction").agg(F.count_distinct("node_id").alias("queries"), F.count_distinct(F.when(is_call, F.col("node_id"))).alias("calls"), F.count_distinct(access).alias("accesses"))
