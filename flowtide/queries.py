"""Queries over the supplied tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import flows, names, relations, scans
from .operators.transfer import Transfer
from .plans.fixpoint import propagate, shared_folder
from .sources import files, tables
from .streaming.live import LiveSet, Settling, settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_WITH = f"WITH RECURSIVE {tables.SQL}"
_DECLARED = """, vars AS (SELECT DISTINCT func_id, name FROM node WHERE kind = 'DeclareVariable'),
declared AS (SELECT func_id, name FROM vars UNION SELECT func_id, unnest(params) FROM func),
up AS (SELECT func_id, func_id AS anc_id, CAST(0 AS BIGINT) AS depth FROM func
  UNION ALL SELECT up.func_id, f.outer_func_id, depth + 1 FROM up JOIN func f ON f.func_id = anc_id WHERE f.outer_func_id IS NOT NULL)"""
_VISIBLE = _DECLARED + """, visible AS (
  SELECT up.func_id, name, arg_min(anc_id, depth) AS decl_id FROM up JOIN declared d ON d.func_id = anc_id GROUP BY ALL)"""
_FREE = _DECLARED + """, bound AS (SELECT func_id, name FROM func UNION SELECT func_id, name FROM vars),
local AS (SELECT DISTINCT func_id, name FROM node WHERE kind = 'ReadVariable' EXCEPT SELECT func_id, name FROM bound),
free AS (SELECT DISTINCT anc_id AS func_id, name FROM local JOIN up USING (func_id))"""
_CHAINS = """, defs AS (
  SELECT func_id, idx, node_id, 'r' || result_reg AS key, CASE WHEN kind = 'ReadVariable' THEN 'v:' || name END AS nxt,
    CASE kind WHEN 'NewObject' THEN 'obj|' || node_id WHEN 'Constant' THEN 'const|' || node_id WHEN 'DeclareFunction' THEN 'func|' || node_id END AS alloc
  FROM node WHERE result_reg >= 0 AND kind IN ('NewObject', 'Constant', 'DeclareFunction', 'ReadVariable', 'Call', 'ReadProperty')
  UNION ALL SELECT func_id, idx, node_id, 'v:' || name, 'r' || value_reg, NULL FROM node WHERE kind = 'WriteVariable'
), links AS (
  SELECT d.node_id AS node, arg_max(e.node_id, e.idx) AS prev
  FROM defs d JOIN defs e ON e.func_id = d.func_id AND e.key = d.nxt AND e.idx < d.idx GROUP BY d.node_id
), chain AS (
  SELECT d.node_id AS node, d.node_id AS root, CAST(0 AS BIGINT) AS hops FROM defs d WHERE d.node_id NOT IN (SELECT node FROM links)
  UNION ALL SELECT l.node, c.root, c.hops + 1 FROM chain c JOIN links l ON l.prev = c.node
), asked AS (SELECT node_id AS query_id, func_id, idx, 'r' || func_reg AS key FROM node WHERE kind = 'Call' AND NOT is_internal AND func_reg >= 0),
hit AS (SELECT query_id, arg_max(d.node_id, d.idx) AS node FROM asked a JOIN defs d ON d.func_id = a.func_id AND d.key = a.key AND d.idx < a.idx GROUP BY query_id),
reaching AS (SELECT query_id, alloc FROM hit JOIN chain USING (node) JOIN defs d ON d.node_id = root WHERE alloc IS NOT NULL),
edges AS (SELECT DISTINCT query_id AS call_id, n.declares AS callee_id FROM reaching JOIN node n ON alloc = 'func|' || n.node_id)"""
_SINKS = "('v1', 'v2', 'v3', 'p1')"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# -- scans and predicates -----------------------------------------------------


@query(f"{_WITH} SELECT node_id, func_id, result_reg FROM node WHERE kind = 'Call'")
def scan_calls(spark, d):
    return scans.calls(tables.program(spark, d)).select("node_id", "func_id", "result_reg")


@query(f"{_WITH} SELECT node_id, kind, property FROM node WHERE kind IN ('ReadProperty', 'WriteProperty') OR kind = 'Call' AND func_reg = -1 AND NOT is_internal")
def prop_access_nodes(spark, d):
    return scans.property_accesses(tables.program(spark, d)).select("node_id", "kind", "property")


@query(f"{_WITH} SELECT func_id, count(*) AS n_nodes, max(idx) AS last_idx FROM node GROUP BY func_id")
def all_nodes_by_function(spark, d):
    return tables.program(spark, d).node.groupBy("func_id").agg(F.count("*").alias("n_nodes"), F.max("idx").alias("last_idx"))


@query(f"{_WITH} SELECT node_id, idx, kind FROM node WHERE func_id = 1")
def nodes_in_function(spark, d):
    return scans.nodes_of(tables.program(spark, d), 1).select("node_id", "idx", "kind")


@query(f"{_WITH} SELECT min(func_id) AS func_id, name FROM func WHERE name = 'v7' GROUP BY name")
def function_by_name(spark, d):
    return scans.function_named(tables.program(spark, d), "v7").select("func_id", "name")


@query(f"{_WITH} SELECT node_id, kind FROM node WHERE node_id = {tables.SPAN + 1}")
def node_by_index(spark, d):
    return scans.node_at(tables.program(spark, d), tables.SPAN + 1).select("node_id", "kind")


@query(f"{_WITH} SELECT node_id, property FROM node WHERE kind = 'Call' AND func_reg = -1 AND property IS NOT NULL")
def static_method_calls(spark, d):
    return tables.program(spark, d).node.where(scans.is_method_call()).select("node_id", "property")


@query(f"{_WITH} SELECT node_id AS query_id, func_id, idx, 'r' || func_reg AS key FROM node WHERE kind = 'Call' AND NOT is_internal AND func_reg >= 0")
def call_site_queries(spark, d):
    return flows.callee_queries(tables.program(spark, d))


@query(f"{_WITH} SELECT src, dst FROM cfg_edge")
def cfg_succ(spark, d):
    return tables.program(spark, d).cfg_edge


@query(f"{_WITH} SELECT n.node_id, n.kind, e.src AS pred_id FROM node n JOIN cfg_edge e ON e.dst = n.node_id")
def cfg_pred(spark, d):
    p = tables.program(spark, d)
    return p.node.join(p.cfg_edge, F.col("node_id") == F.col("dst")).select("node_id", "kind", F.col("src").alias("pred_id"))


# -- names --------------------------------------------------------------------


@query(f"{_WITH}{_DECLARED} SELECT func_id, anc_id, depth FROM up")
def scope_chain(spark, d):
    return names.ancestors(tables.program(spark, d))


_KNOWN = """, known AS (SELECT func_id AS anc_id, name FROM declared UNION SELECT outer_func_id, name FROM func WHERE outer_func_id IS NOT NULL),
near AS (SELECT up.func_id, name, arg_min(anc_id, depth) AS decl_id FROM up JOIN known USING (anc_id) GROUP BY ALL)"""


@query(f"""{_WITH}{_DECLARED}{_KNOWN} SELECT node_id, n.name, coalesce(CASE WHEN n.name = 'process' THEN m.anc_id ELSE decl_id END, n.func_id) AS decl_id FROM node n
LEFT JOIN near v ON v.func_id = n.func_id AND v.name = n.name LEFT JOIN (SELECT up.func_id, anc_id FROM up JOIN func f ON f.func_id = anc_id AND f.is_main) m ON m.func_id = n.func_id
WHERE kind IN ('ReadVariable', 'WriteVariable')""")
def declaring_scope(spark, d):
    p = tables.program(spark, d, keep=True)
    return names.declaring_scope(p, names.ancestors(p))


@query(f"{_WITH}{_VISIBLE} SELECT func_id, name, decl_id FROM visible")
def visible_in(spark, d):
    p = tables.program(spark, d, keep=True)
    return names.visible(p, names.ancestors(p))


@query(f"{_WITH}{_FREE} SELECT func_id, name FROM bound")
def bound_names(spark, d):
    return names.bound_names(tables.program(spark, d))


@query(f"{_WITH}{_FREE} SELECT func_id, name FROM free")
def free_vars(spark, d):
    p = tables.program(spark, d, keep=True)
    return names.free_names(p, names.ancestors(p))


@query(f"{_WITH}{_FREE} SELECT f.outer_func_id AS func_id, f.func_id AS inner_id, free.name FROM free JOIN func f USING (func_id) WHERE f.outer_func_id IS NOT NULL")
def captured_names(spark, d):
    p = tables.program(spark, d, keep=True)
    return names.capturing(p, names.ancestors(p))


@query(f"""{_WITH}{_DECLARED}{_KNOWN} SELECT node_id, f.func_id AS callee_id FROM node n JOIN near ON near.func_id = n.func_id AND near.name = n.name
JOIN func f ON f.outer_func_id = decl_id AND f.name = n.name WHERE kind = 'ReadVariable'""")
def static_refs(spark, d):
    p = tables.program(spark, d, keep=True)
    return names.static_references(p, names.ancestors(p))


@query(f"""{_WITH}{_DECLARED}, rebound AS (SELECT DISTINCT func_id AS anc_id, unnest(params) AS name FROM func),
stop AS (SELECT up.func_id, name, min(depth) AS stop FROM up JOIN rebound USING (anc_id) GROUP BY ALL)
SELECT f.func_id AS callee_id, node_id FROM node n JOIN up ON up.func_id = n.func_id JOIN func f ON f.outer_func_id = anc_id AND f.name = n.name
LEFT JOIN stop s ON s.func_id = n.func_id AND s.name = n.name WHERE kind = 'ReadVariable' AND (stop IS NULL OR depth <= stop)""")
def function_references(spark, d):
    p = tables.program(spark, d, keep=True)
    return names.function_references(p, names.ancestors(p))


# -- value flow and calls -----------------------------------------------------


@query(f"{_WITH}{_CHAINS} SELECT node, root, hops FROM chain")
def definition_chains(spark, d):
    return flows.definition_roots(tables.program(spark, d))


@query(f"{_WITH}{_CHAINS} SELECT query_id, alloc FROM reaching")
def reaching_alloc_backward(spark, d):
    return flows.reaching(tables.program(spark, d))


@query(f"{_WITH}{_CHAINS} SELECT r.alloc, d.node_id, d.key FROM chain JOIN defs r ON r.node_id = root JOIN defs d ON d.node_id = node WHERE r.alloc IS NOT NULL")
def reached_from_alloc_forward(spark, d):
    return flows.reached_from(tables.program(spark, d))


@query(f"{_WITH}{_CHAINS} SELECT call_id, callee_id FROM edges")
def call_edges(spark, d):
    return flows.local_call_edges(tables.program(spark, d)).distinct()


@query(f"{_WITH}{_CHAINS} SELECT callee_id AS func_id, count(*) AS n_callers, min(call_id) AS first_call FROM edges GROUP BY callee_id")
def callers(spark, d):
    return flows.local_call_edges(tables.program(spark, d)).distinct().groupBy(F.col("callee_id").alias("func_id")).agg(F.count("*").alias("n_callers"), F.min("call_id").alias("first_call"))


@query(f"{_WITH}{_CHAINS} SELECT call_id, callee_id, position, reg, params[position + 1] AS param FROM edges JOIN call_arg ON node_id = call_id JOIN func ON func_id = callee_id WHERE position < len(params)")
def arg_param_match(spark, d):
    p = tables.program(spark, d, keep=True)
    return relations.argument_matches(p, flows.local_call_edges(p).distinct())


@query(f"{_WITH}{_CHAINS} SELECT node_id AS call_id FROM node WHERE kind = 'Call' AND NOT is_internal AND node_id NOT IN (SELECT call_id FROM edges)")
def unresolved_calls(spark, d):
    p = tables.program(spark, d, keep=True)
    return relations.unresolved(p, flows.local_call_edges(p))


@query(f"{_WITH}{_CHAINS} SELECT n.node_id AS call_id, 'r' || reg AS key, n.func_id AS query_id FROM node n JOIN call_arg a ON a.node_id = n.node_id WHERE NOT is_internal AND n.node_id NOT IN (SELECT call_id FROM edges) AND position <> 0")
def unhandled_unresolved_calls(spark, d):
    """Argument values at calls without a callee, when the first arguments have been handled."""
    p = tables.program(spark, d, keep=True)
    states = p.call_arg.join(p.node.select("node_id", F.col("func_id").alias("query_id")), "node_id").select(F.col("node_id").alias("call_id"), F.concat(F.lit("r"), F.col("reg").cast("string")).alias("key"), "query_id", "position")
    return relations.unhandled(p, states.drop("position"), flows.local_call_edges(p), states.where("position = 0"))


@query(f"""{_WITH}{_CHAINS}, fe AS (SELECT DISTINCT n.func_id AS src, callee_id AS dst FROM edges JOIN node n ON n.node_id = call_id),
r AS (SELECT src, dst FROM fe UNION SELECT r.src, fe.dst FROM r JOIN fe ON fe.src = r.dst) SELECT src, dst FROM r""")
def call_reach(spark, d):
    p = tables.program(spark, d)
    return relations.function_reach(p, flows.local_calls(p))


@query(f"{_WITH}{_CHAINS} SELECT count(*) AS edges FROM edges")
def edge_count(spark, d):
    return relations.edge_count(flows.local_call_edges(tables.program(spark, d)))


@query()
def resolve_calls(spark, d):
    """Callees of all calls across functions, with strata; tested against a brute-force solver."""
    return flows.resolve_calls(tables.program(spark, d, keep=True))[0]


@query(f"""{_WITH}, sink AS (
  SELECT node_id, result_reg, name AS s FROM node WHERE kind = 'ReadVariable' AND name IN {_SINKS}
  UNION ALL SELECT node_id, result_reg, property FROM node WHERE kind = 'ReadProperty' AND property IN {_SINKS}
), called AS (SELECT s, n.node_id AS call_id, func_reg, coalesce(n.property IN {_SINKS}, false) AS is_sink FROM sink JOIN cfg_edge ON src = sink.node_id JOIN node n ON n.node_id = dst
  WHERE n.kind = 'Call' AND (func_reg = sink.result_reg OR n.property IN {_SINKS}))
SELECT s AS sink, call_id, 'argument' AS role, reg FROM called JOIN call_arg ON node_id = call_id
UNION SELECT s, call_id, CASE WHEN func_reg = -1 THEN 'no receiver' ELSE 'receiver' END, func_reg FROM called WHERE is_sink""")
def taint_sinks(spark, d):
    sinks = spark.createDataFrame([("v1",), ("v2",), ("v3",), ("p1",)], "name string")
    return scans.sink_queries(tables.program(spark, d, keep=True), sinks)


@query()
def whole_call_reach(spark, d):
    """call_reach from all functions over all edges of resolve_calls."""
    p = tables.program(spark, d, keep=True)
    return relations.function_reach(p, flows.resolve_calls(p)[0])


# -- sets, maps, counts -------------------------------------------------------


def _told(spark: SparkSession, *views: tuple[DataFrame, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The rows that rules on views of live sets hand on."""
    heard = LiveSet(views[0][1](views[0][0]).where("false"))
    sets = [LiveSet(rows.distinct()) for rows, _ in views]
    for s, (_, view) in zip(sets, views, strict=True):
        s.map("heard", view, lambda new: (heard, new))
    settle(*sets)
    return heard.total


@query("SELECT DISTINCT l_suppkey % 1000 AS element FROM lineitem")
def live_map(spark, d):
    return _told(spark, (tables.load(spark, d, "lineitem").select("l_suppkey"), lambda new: new.select((F.col("l_suppkey") % 1000).alias("element"))))


@query("SELECT DISTINCT l_partkey AS element FROM lineitem WHERE l_partkey % 2 = 0")
def live_filter(spark, d):
    return _told(spark, (tables.load(spark, d, "lineitem").select("l_partkey"), lambda new: new.where("l_partkey % 2 = 0").select(F.col("l_partkey").alias("element"))))


@query("SELECT l_partkey AS element FROM lineitem UNION SELECT l_suppkey FROM lineitem")
def live_union(spark, d):
    rows, element = tables.load(spark, d, "lineitem"), lambda new: new.toDF("element")
    return _told(spark, (rows.select("l_partkey"), element), (rows.select("l_suppkey"), element))


_SCOPES = {"func": "func_id long, outer_id long", "up": "func_id long, outer_id long, anc_id long, depth int"}


def _scope_rules(sets: dict[str, LiveSet]) -> None:
    """Functions around functions that come in any order.

    A function's ancestors are those of the one around it, a level higher: rows are joined by their own function, so that no ancestor's rows meet in
    one task. A function has one outer one, so an ancestor is at one depth, and what a round finds is compared with the rows of its depth only.
    Rows keep the outer function that they were joined by: equal ones are then in one task already, and aren't shuffled again to be told apart.
    """
    func, up = sets["func"], sets["up"]
    at = lambda rows, anc, depth: rows.select("func_id", "outer_id", F.col(anc).alias("anc_id"), F.lit(depth).alias("depth"))

    def inward(inner, outer):
        around = outer.where("depth > 0").select(F.col("func_id").alias("outer_id"), "anc_id", "depth")
        return inner.join(around, "outer_id").select("func_id", "outer_id", "anc_id", (F.col("depth") + 1).alias("depth"))

    # Outer ones come from the functions themselves, as they need not be functions; those further out from the rows of depth 1 and more.
    func.on_add("itself", lambda new: (up, at(new, "func_id", 0)))
    func.on_add("outer", lambda new: (up, at(new.where("outer_id is not null"), "outer_id", 1)))
    func.on_add("below", lambda new: (up, inward(new, up.total)))
    up.on_add("inward", lambda new: (up, inward(func.total, new)))


@query(f"{_WITH}{_DECLARED} SELECT DISTINCT func_id, anc_id FROM up")
def stream_scope_chain(spark, d):
    """scope_chain without its depths, over a stream of orders: functions and their outer ones are live sets that settle with each batch."""
    orders = tables.load(spark, d, "orders").select("o_orderkey")
    folder = f"{shared_folder(orders)}/stream-{uuid.uuid4().hex}"

    def feed(batch):
        key = F.col("o_orderkey")
        return {"func": batch.select(key.alias("func_id"), F.when(key > 0, F.floor(key / tables.NESTING)).cast("long").alias("outer_id"))}

    settling = Settling(f"{folder}/state", _SCOPES, feed, _scope_rules)
    tables.stream(spark, d, "orders").select("o_orderkey").writeStream.foreachBatch(settling).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    return settling.totals(spark)["up"].select("func_id", "anc_id")


@query("WITH s AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), n AS (SELECT l_partkey, count(*) AS size FROM s GROUP BY 1) SELECT l_partkey, l_suppkey, size FROM s JOIN n USING (l_partkey)")
def multimap_both_ways(spark, d):
    return relations.multimap(tables.load(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("SELECT count(*) AS total FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def total_facts(spark, d):
    return relations.total_facts(tables.load(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')")
def contains_edge(spark, d):
    rows = tables.load(spark, d, "lineitem")
    return relations.contained(rows.select("l_partkey", "l_suppkey").distinct(), rows.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey"))


@query("SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def handler_stats(spark, d):
    return relations.tag_counts(tables.load(spark, d, "events"), "event_type")


@query(f"{_WITH} SELECT count(*) AS n_queries, count(*) FILTER (is_internal) AS n_internal, count(DISTINCT func_id) AS n_functions, sum(CASE WHEN func_reg = -1 THEN 1 ELSE 0 END)::BIGINT AS n_method FROM node WHERE kind = 'Call'")
def query_counts(spark, d):
    n = scans.calls(tables.program(spark, d))
    return n.agg(F.count("*").alias("n_queries"), F.count_if("is_internal").alias("n_internal"), F.count_distinct("func_id").alias("n_functions"), F.count_if(F.col("func_reg") == -1).alias("n_method"))


@query(f"""{_WITH} SELECT direction, count(DISTINCT query) AS queries, count(DISTINCT call_id) AS calls, count(DISTINCT access_id) AS accesses FROM (
  SELECT 'backward' AS direction, node_id AS query, CASE WHEN kind = 'Call' THEN node_id END AS call_id, CASE WHEN kind <> 'Call' OR func_reg = -1 THEN node_id END AS access_id FROM node WHERE kind = 'Call' AND NOT is_internal OR kind IN ('ReadProperty', 'WriteProperty')
  UNION ALL SELECT 'forward', node_id, NULL, NULL FROM node WHERE kind IN ('DeclareFunction', 'NewObject')) GROUP BY direction""")
def queries_by_direction(spark, d):
    """Backward queries of calls and property accesses, forward ones of allocations, and the calls and accesses asked about."""
    p = tables.program(spark, d)
    back = scans.property_accesses(p).unionByName(scans.external_calls(p)).select(F.lit("backward").alias("direction"), "node_id", "kind", "func_reg")
    ahead = p.node.where("kind in ('DeclareFunction', 'NewObject')").select(F.lit("forward").alias("direction"), "node_id", "kind", "func_reg")
    return relations.query_counts(back.unionByName(ahead))


@query(f"{_WITH} SELECT count(*) FILTER (kind = 'Call') AS calls, count(*) FILTER (kind IN ('ReadProperty', 'WriteProperty') OR kind = 'Call' AND func_reg = -1 AND NOT is_internal) AS accesses FROM node")
def node_totals(spark, d):
    n = tables.program(spark, d).node
    return n.agg(F.count_if(F.col("kind") == "Call").alias("calls"), F.count_if(scans.is_property_access()).alias("accesses"))


@query(f"{_WITH} SELECT func_id, printf('%.2f%%', CASE WHEN count(*) FILTER (kind = 'Call') = 0 THEN 100.0 ELSE 100.0 * count(*) FILTER (kind = 'Call' AND NOT is_internal) / count(*) FILTER (kind = 'Call') END) AS covered FROM node GROUP BY func_id")
def coverage_pct(spark, d):
    n = tables.program(spark, d).node
    return n.groupBy("func_id").agg(scans.percentage(F.count_if((F.col("kind") == "Call") & ~F.col("is_internal")), F.count_if(F.col("kind") == "Call")).alias("covered"))


@query("SELECT user_id, max(event_id) AS most, sum(event_id)::BIGINT AS total, sum(event_id)::BIGINT // count(*) AS mean FROM events GROUP BY user_id")
def run_stats(spark, d):
    e = tables.load(spark, d, "events")
    return e.groupBy("user_id").agg(F.max("event_id").alias("most"), F.sum("event_id").alias("total"), F.expr("sum(event_id) div count(*)").alias("mean"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS index FROM events")
def zip_with_index(spark, d):
    return scans.indexed(tables.load(spark, d, "events"), "ts", "event_id").select("event_id", "index")


@query(f"""{_WITH}, o AS (SELECT node_id, row_number() OVER (ORDER BY md5('42:' || node_id), node_id) - 1 AS index FROM node WHERE kind = 'Call' AND NOT is_internal),
shapes(size, most) AS (VALUES {", ".join(map(str, scans.BATCHES))})
SELECT size, CASE WHEN size = 0 THEN 0 ELSE index // size END AS batch, index, node_id FROM o, shapes WHERE CASE WHEN size = 0 THEN 0 ELSE index // size END < most""")
def query_batches(spark, d):
    return scans.batches(scans.external_calls(tables.program(spark, d)), "node_id")


@query(f"{_WITH} SELECT node_id FROM node WHERE kind = 'Call' ORDER BY md5('42:' || node_id), node_id LIMIT 1")
def random_call(spark, d):
    return scans.calls(tables.program(spark, d)).orderBy(F.md5(F.concat(F.lit("42:"), F.col("node_id").cast("string"))), "node_id").limit(1).select("node_id")


# -- what nodes do to values, forward and backward -------------------------------

#: Nodes with the facts that they mention.
_FACTS = f"""{_DECLARED}{_KNOWN}, scope AS (
  SELECT n.node_id, 'v|' || coalesce(CASE WHEN n.name = 'process' THEN m.anc_id ELSE near.decl_id END, n.func_id) || '|' || n.name AS variable
  FROM node n LEFT JOIN near ON near.func_id = n.func_id AND near.name = n.name
  LEFT JOIN (SELECT up.func_id, anc_id FROM up JOIN func f ON f.func_id = anc_id AND f.is_main) m ON m.func_id = n.func_id
), static AS (
  SELECT DISTINCT node_id FROM node n JOIN near ON near.func_id = n.func_id AND near.name = n.name JOIN func f ON f.outer_func_id = decl_id AND f.name = n.name WHERE kind = 'ReadVariable'
), fact AS MATERIALIZED (
  SELECT n.node_id AS place, n.func_id, kind, 'r|' || n.func_id || '|' || nullif(result_reg, -1) AS result, 'r|' || n.func_id || '|' || nullif(base_reg, -1) AS base,
    'r|' || n.func_id || '|' || nullif(value_reg, -1) AS stored, value_reg, variable, declares, 'v|' || n.func_id || '|' || d.name AS funcvar, static.node_id IS NOT NULL AS static,
    CASE kind WHEN 'NewObject' THEN 'obj|' || n.node_id || '|' || result_reg WHEN 'Constant' THEN 'const|' || n.node_id WHEN 'DeclareFunction' THEN 'func|' || n.node_id END AS alloc
  FROM node n LEFT JOIN scope USING (node_id) LEFT JOIN func d ON d.func_id = declares LEFT JOIN static ON static.node_id = n.node_id
)"""
_AHEAD = _FACTS + """, rebound AS (SELECT DISTINCT func_id AS anc_id, unnest(params) AS name FROM func),
stop AS (SELECT up.func_id, name, min(depth) AS stop FROM up JOIN rebound USING (anc_id) GROUP BY ALL),
reference AS (
  SELECT f.func_id AS declares, e.dst, 'r|' || n.func_id || '|' || n.result_reg AS result
  FROM node n JOIN up ON up.func_id = n.func_id JOIN func f ON f.outer_func_id = anc_id AND f.name = n.name
  LEFT JOIN stop s ON s.func_id = n.func_id AND s.name = n.name JOIN cfg_edge e ON e.src = n.node_id WHERE kind = 'ReadVariable' AND (stop IS NULL OR depth <= stop)
), onward AS MATERIALIZED (
  SELECT src AS place, way, dst, CAST(NULL AS VARCHAR) AS referred FROM cfg_edge CROSS JOIN (VALUES (1), (2), (3)) w(way)
  UNION ALL SELECT place, 4, dst, r.result FROM fact JOIN reference r USING (declares) WHERE kind = 'DeclareFunction'
), after AS (
  SELECT place AS start, place, alloc AS fact FROM fact WHERE alloc IS NOT NULL
  UNION SELECT start, dst, CASE way WHEN 1 THEN a.fact WHEN 2 THEN result WHEN 3 THEN variable ELSE referred END
  FROM after a JOIN fact f USING (place) JOIN onward o USING (place)
  WHERE CASE way
    WHEN 1 THEN CASE kind WHEN 'DeclareFunction' THEN a.fact <> coalesce(alloc, '') AND (a.fact <> coalesce(result, '') AND result IS NOT NULL OR funcvar IS NOT NULL AND a.fact <> funcvar)
      WHEN 'ReadProperty' THEN a.fact <> result WHEN 'ReadVariable' THEN a.fact <> result WHEN 'WriteVariable' THEN a.fact <> variable ELSE true END
    WHEN 2 THEN result IS NOT NULL AND (kind IN ('Constant', 'DeclareFunction') AND a.fact = alloc OR kind = 'ReadVariable' AND a.fact = variable)
    WHEN 3 THEN kind = 'WriteVariable' AND (a.fact = stored OR a.fact LIKE 'obj|%' AND split_part(a.fact, '|', 3) = CAST(value_reg AS VARCHAR))
    ELSE a.fact = alloc END
)"""
_BEHIND = _FACTS + """, before AS (
  SELECT node_id AS start, node_id AS place, 'r|' || func_id || '|' || func_reg AS fact FROM node WHERE kind = 'Call' AND NOT is_internal AND func_reg >= 0
  UNION SELECT start, src, CASE WHEN kind = 'ReadVariable' AND fact = result OR kind = 'ReadVariable' AND fact = base THEN variable WHEN kind = 'WriteVariable' AND fact = variable THEN stored ELSE fact END
  FROM before JOIN fact USING (place) JOIN cfg_edge ON dst = place
  WHERE CASE WHEN kind = 'DeclareFunction' AND result IS NULL THEN fact <> coalesce(funcvar, '') WHEN kind IN ('Call', 'Constant', 'NewObject', 'DeclareFunction', 'ReadProperty') THEN fact <> coalesce(result, '')
    WHEN kind = 'ReadVariable' THEN fact <> result OR NOT static ELSE true END
)"""


@query(f"{_WITH}{_AHEAD} SELECT start, place, fact FROM after")
def forward_reach(spark, d):
    """Where every allocation gets to within its function, by the forward rule of each node; functions also to where their names are read."""
    return Transfer(tables.program(spark, d, keep=True)).within(F.col("alloc"), True)


@query(f"{_WITH}{_BEHIND} SELECT start, place, fact FROM before")
def backward_reach(spark, d):
    """What every call's function register can be before each node of the calling function, by the backward rules."""
    return Transfer(tables.program(spark, d, keep=True)).within(F.when((F.col("kind") == "Call") & ~F.col("internal"), F.col("callee")), False)


@query(f"""{_WITH}{_AHEAD}, caught AS (SELECT start, n.node_id AS call_id FROM after JOIN node n ON n.node_id = place AND kind = 'Call' AND NOT is_internal AND func_reg >= 0 AND fact = 'r|' || n.func_id || '|' || func_reg)
SELECT DISTINCT call_id, declares AS callee_id FROM caught JOIN node ON node_id = start WHERE declares IS NOT NULL""")
def forward_callers(spark, d):
    """The calls that a declared function gets to, forward, without passing a call or a field."""
    p = tables.program(spark, d, keep=True)
    reached = Transfer(p).within(F.when(F.col("declares").isNotNull(), F.col("alloc")), True, F.when((F.col("kind") == "Call") & ~F.col("internal"), F.col("callee")))
    declared = p.node.where("declares is not null").select(F.col("node_id").alias("start"), F.col("declares").alias("callee_id"))
    return reached.join(declared, "start").select(F.col("place").alias("call_id"), "callee_id").distinct()


# -- dependencies and errors --------------------------------------------------

_DEPS = """WITH RECURSIVE o AS (SELECT event_id, event_type, user_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events),
dep AS (SELECT event_id AS from_query, nxt AS to_query FROM o WHERE nxt IS NOT NULL),
errors AS (SELECT event_id AS query_id, 'error ' || (event_id % 7) AS error FROM events WHERE event_type = 'error'),
reach AS (SELECT from_query AS src, to_query AS dst FROM dep UNION SELECT src, to_query FROM reach JOIN dep ON from_query = dst)"""


def _deps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every link from an event to its user's next one, and the errors."""
    e = tables.load(spark, d, "events")
    ordered = e.select(F.col("event_id").alias("from_query"), F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("to_query"))
    errors = e.where("event_type = 'error'").select(F.col("event_id").alias("query_id"), F.concat(F.lit("error "), (F.col("event_id") % 7).cast("string")).alias("error"))
    return ordered.where("to_query is not null"), errors


@query(f"{_DEPS} SELECT from_query, to_query FROM dep")
def direct_deps(spark, d):
    return _deps(spark, d)[0]


@query(f"{_DEPS} SELECT src, dst FROM reach")
def dep_reach(spark, d):
    return relations.dependencies(_deps(spark, d)[0])


@query(f"{_DEPS} SELECT query_id AS from_query, error FROM errors UNION SELECT src, error FROM reach JOIN errors ON query_id = dst")
def errors_impacting(spark, d):
    return relations.error_rollup(*_deps(spark, d))


@query(f"{_DEPS}, asked AS (SELECT query_id AS q FROM errors UNION SELECT to_query FROM asked JOIN dep ON from_query = q) SELECT q AS query_id FROM asked")
def demanded_queries(spark, d):
    """The failing queries and all sub-queries that they create, each once."""
    deps, errors = _deps(spark, d)
    asked = errors.select(F.col("query_id").alias("node"), F.lit(True).alias("label"))
    return propagate(deps.select(F.col("to_query").alias("src"), F.col("from_query").alias("dst")), asked).select(F.col("node").alias("query_id"))


# -- output forms -------------------------------------------------------------


@query(f"""{_WITH}{_CHAINS}, first AS (SELECT func_id, arg_min(CAST(idx AS INTEGER), idx) AS line FROM node GROUP BY func_id)
SELECT 'tables' AS program_id, '{{"callee":{{"start":{{"line":' || f.line || ',"column":0}}}},"caller":{{"start":{{"line":' || n.idx || ',"column":0}}}}}}' AS value
FROM edges JOIN node n ON n.node_id = call_id JOIN first f ON f.func_id = callee_id""")
def callgraph_json(spark, d):
    p = tables.program(spark, d, keep=True)
    return files.call_graph_json(p, flows.local_call_edges(p))


@query(f"{_WITH}{_CHAINS} SELECT 'call ' || call_id || ' -> function ' || callee_id AS value FROM edges")
def callgraph_text(spark, d):
    return files.call_graph_text(flows.local_call_edges(tables.program(spark, d)))


@query(f"""{_DEPS} SELECT '"' || from_query || '" -> "' || to_query || '";' AS value FROM dep""")
def dependency_dot(spark, d):
    return files.dot(_deps(spark, d)[0], "from_query", "to_query")
