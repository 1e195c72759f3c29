"""Value flow and call resolution as recursive relations.

Within a function, a value (a register `r1` or a variable `v:name`) is followed
backwards from definition to definition. Nodes that don't mention a value don't
stop it, so instead of walking node by node each definition is linked to the one
before it that gives it its value: a sparse graph with one hop per definition.

Across functions, the callees of a call are the function values that reach its
function register. Parameters take the arguments of every known caller, results
take the callee's return register, variables of outer functions are looked up where
they are declared. Call edges found on the way bring new callers and callees, so
both relations grow together; after they are still, calls without any callee
pass their arguments to their result, and the search goes on (snapshot strata).
Only values that a query asks for are followed.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import lacking, merged, roots, stored
from ..plans.program import Program

#: The register of a function's return value.
RETURN = "r1"


def register(column) -> F.Column:
    return F.concat(F.lit("r"), F.col(column).cast("string"))


def variable(column) -> F.Column:
    return F.concat(F.lit("v:"), F.col(column))


def definitions(p: Program) -> DataFrame:
    """(func_id, idx, node_id, key, next, alloc): what a node defines, out of which value, or which allocation it is.

    Calls and property reads define their result out of nothing that is followed here.
    """
    n = p.node
    none = F.lit(None).cast("string")
    result = n.where((F.col("result_reg") >= 0) & F.col("kind").isin("NewObject", "Constant", "DeclareFunction", "ReadVariable", "Call", "ReadProperty"))
    alloc = F.when(F.col("kind") == "NewObject", "obj|").when(F.col("kind") == "Constant", "const|").when(F.col("kind") == "DeclareFunction", "func|")
    registers = result.select("func_id", "idx", "node_id", register("result_reg").alias("key"), F.when(F.col("kind") == "ReadVariable", variable("name")).alias("next"), F.concat(alloc, F.col("node_id").cast("string")).alias("alloc"))
    writes = n.where("kind = 'WriteVariable'").select("func_id", "idx", "node_id", variable("name").alias("key"), register("value_reg").alias("next"), none.alias("alloc"))
    return registers.unionByName(writes)


def before(asked: DataFrame, defs: DataFrame) -> DataFrame:
    """Of each asked value (func_id, idx, key, any other columns) the last definition before idx; rows that agree in all columns count once.

    Questions and definitions of a (function, key) are sorted together and each question takes the definition seen last, so that
    the work grows with their number, not with that of pairs.
    """
    rest = F.struct(*asked.columns)
    questions = asked.distinct().select("func_id", "key", "idx", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("def"), rest.alias("q"))
    known = defs.select("func_id", "key", "idx", F.lit(1).alias("rank"), F.col("node_id").alias("def"), F.lit(None).cast(questions.schema["q"].dataType).alias("q"))
    # A question stands before a definition at the same place, which is no definition before it.
    sorted_ = Window.partitionBy("func_id", "key").orderBy("idx", "rank")
    found = questions.union(known).withColumn("def_id", F.last("def", True).over(sorted_))
    return found.where("q is not null and def_id is not null").select("q.*", "def_id")


def linked(p: Program) -> DataFrame:
    """(func_id, node_id, idx, key, role, next, alloc, declares, def_id, def_alloc, def_declares): what every node defines, and what it takes its value from.

    role `def` is a definition out of nothing that is followed here, `value` one out of `next`, with the definition before that gives it
    (`def_id`, null at the function's entry), and `callee` an external call, with the definition of its function register. All are found in one
    sort of each function's nodes: they are shuffled by function once, or not at all where they come from a table that was just numbered by function.
    """
    kind, none = F.col("kind"), F.lit(None).cast("string")
    is_result = (F.col("result_reg") >= 0) & kind.isin("NewObject", "Constant", "DeclareFunction", "ReadVariable", "Call", "ReadProperty")
    is_write = kind == "WriteVariable"
    alloc = F.concat(F.when(kind == "NewObject", "obj|").when(kind == "Constant", "const|").when(kind == "DeclareFunction", "func|"), F.col("node_id").cast("string"))
    key = F.when(is_result, register("result_reg")).when(is_write, variable("name"))
    next_ = F.when(is_result & (kind == "ReadVariable"), variable("name")).when(is_write, register("value_reg"))
    callee = F.when(F.expr("kind = 'Call' and not is_internal and func_reg >= 0"), register("func_reg"))
    place = lambda at, rank, role: F.struct(at.alias("at"), F.lit(rank).alias("rank"), F.lit(role).alias("role"))
    defines = is_result | is_write
    # A question stands before a definition at the same place, which is no definition before it. A definition out of nothing asks nothing.
    places = F.array_compact(F.array(
        F.when(callee.isNotNull(), place(callee, 0, "callee")), F.when(defines & next_.isNotNull(), place(next_, 0, "value")),
        F.when(defines, place(key, 1, "def")),
    ))
    rows = p.node.select("func_id", "node_id", "idx", key.alias("key"), next_.alias("next"), F.when(is_result, alloc).otherwise(none).alias("alloc"), F.when(is_result & (kind == "DeclareFunction"), F.col("declares")).alias("declares"), F.explode(places).alias("p"))
    rows = rows.select("func_id", "node_id", "idx", "key", "next", "alloc", "declares", "p.*")
    last = Window.partitionBy("func_id", "at").orderBy("idx", "rank")
    known = F.last(F.when(F.col("role") == "def", F.struct("node_id", "alloc", "declares")), True).over(last)
    rows = rows.withColumn("known", known).where("role <> 'def' or next is null")
    found = lambda c: F.when(F.col("role") != "def", F.col(f"known.{c}"))
    return rows.select("func_id", "node_id", "idx", "key", "role", "next", "alloc", "declares", found("node_id").alias("def_id"), found("alloc").alias("def_alloc"), found("declares").alias("def_declares"))


def _rooted(rows: DataFrame) -> DataFrame:
    """(node, root, hops, root_alloc, root_declares) of the definitions in `linked` that take their value from another one."""
    links = stored(rows.where("role = 'value' and def_id is not null").select(F.col("node_id").alias("node"), F.col("def_id").alias("prev"), F.col("def_alloc").alias("root_alloc"), F.col("def_declares").alias("root_declares")))
    ends = links.select(F.col("node").alias("last"), F.col("prev").alias("root"), "root_alloc", "root_declares")
    # The link before the root knows what the root is.
    chains = roots(links.join(links.select(F.col("node").alias("prev"), F.lit(True).alias("more")), "prev", "left").select("node", F.when(F.col("more"), F.col("prev")).alias("prev")))
    return chains.withColumnRenamed("root", "last").join(ends, "last").select("node", "root", (F.col("hops") + 1).alias("hops"), "root_alloc", "root_declares")


def _ends(rows: DataFrame) -> DataFrame:
    """(node, key, root, hops, alloc) of all definitions in `linked`: the definition that each one's value comes from in the same function."""
    alone = rows.where("role = 'def' or role = 'value' and def_id is null").select(F.col("node_id").alias("node"), "key", F.col("node_id").alias("root"), F.lit(0).cast("long").alias("hops"), "alloc")
    far = rows.where("role = 'value' and def_id is not null").select(F.col("node_id").alias("node"), "key").join(_rooted(rows), "node")
    return alone.union(far.select("node", "key", "root", "hops", F.col("root_alloc").alias("alloc")))


def definition_roots(p: Program) -> DataFrame:
    """(node, root, hops): the definition that each definition's value comes from in the same function."""
    return _ends(stored(linked(p))).select("node", "root", "hops")


def _callees(p: Program) -> DataFrame:
    """(func_id, query_id, alloc, declares): the allocation in its own function that reaches the function register of each external call, and the function that it declares."""
    rows = stored(linked(p).where("role <> 'def' and def_id is not null"))
    asked = rows.where("role = 'callee'").select("func_id", F.col("node_id").alias("query_id"), F.col("def_id").alias("node"), "def_alloc", "def_declares")
    far = _rooted(rows).select("node", "root_alloc", "root_declares")
    found = asked.join(far.withColumn("far", F.lit(True)), "node", "left")
    pick = lambda a, b: F.when(F.col("far"), F.col(a)).otherwise(F.col(b))
    return found.select("func_id", "query_id", pick("root_alloc", "def_alloc").alias("alloc"), pick("root_declares", "def_declares").alias("declares")).where("alloc is not null")


def reaching(p: Program) -> DataFrame:
    """(query_id, alloc): the allocation in its own function that reaches each external call's function register."""
    return _callees(p).select("query_id", "alloc")


def reached_from(p: Program) -> DataFrame:
    """(alloc, node_id, key): every definition in an allocation's function that takes its value from it."""
    return _ends(stored(linked(p))).where("alloc is not null").select("alloc", F.col("node").alias("node_id"), "key")


def callee_queries(p: Program) -> DataFrame:
    """One query per external call with a function register: (query_id, func_id, idx, key)."""
    return p.node.where("kind = 'Call' and not is_internal and func_reg >= 0").select(F.col("node_id").alias("query_id"), "func_id", "idx", register("func_reg").alias("key"))


def local_call_edges(p: Program) -> DataFrame:
    """(call_id, callee_id) of calls whose callee is a function declared in the same function."""
    return local_calls(p).select("call_id", "callee_id")


def local_calls(p: Program) -> DataFrame:
    """As local_call_edges, with the calling function (func_id)."""
    return stored(_callees(p).where("declares is not null").select("func_id", F.col("query_id").alias("call_id"), F.col("declares").alias("callee_id")))


class _Known:
    """A table that rounds add to, in few parts."""

    def __init__(self, rows: DataFrame):
        self.rows, self.parts = rows, [(rows, rows.count())]

    def add(self, new: DataFrame) -> int:
        """Adds a stored table of new rows; how many they are."""
        n = new.count()
        if n:
            self.parts = merged([*self.parts, (new, n)])
            self.rows = functools.reduce(DataFrame.union, [df for df, _ in self.parts])
        return n


def _entry(func, key) -> F.Column:
    return F.concat(F.lit("e|"), F.col(func).cast("string"), F.lit("|"), F.col(key))


def _entries(terms: DataFrame, term: str = "term") -> DataFrame:
    """terms that are values at the entry of a function, with func_id and key."""
    func = F.substring_index(F.substring_index(term, "|", 2), "|", -1)
    return terms.where(F.col(term).startswith("e|")).withColumn("func_id", func.cast("long")).withColumn("key", F.col(term).substr(F.length(func) + 4, F.length(term)))


def _terms(p: Program, allocs: bool) -> DataFrame:
    """(node, term): what the value of each definition is in terms of its function: an allocation `a|alloc`, the result of a call
    (or property read) `c|node`, a variable at the entry `e|func|key`, or null for what is followed no further."""
    rows = stored(linked(p))
    alloc = F.when(F.lit(allocs) | F.col("alloc").startswith("func|"), F.concat(F.lit("a|"), "alloc"))
    term = F.when(F.col("next").startswith("v:"), _entry("func_id", "next")).when(F.col("next").isNull() & F.col("alloc").isNotNull(), alloc).when(F.col("next").isNull(), F.concat(F.lit("c|"), F.col("node_id").cast("string")))
    alone = stored(rows.where("role = 'def' or role = 'value' and def_id is null").select(F.col("node_id").alias("root"), term.alias("term")))
    return stored(alone.union(_rooted(rows).select("node", "root").join(alone, "root").select("node", "term")).toDF("node", "term"))


def resolve_calls(p: Program, asked: DataFrame | None = None, strata: bool = True, allocs: bool = False) -> tuple[DataFrame, DataFrame]:
    """Call edges (call_id, callee_id) and points-to facts (query_id, alloc) of the asked values, across functions.

    asked: (query_id, func_id, idx, key); all external calls by default. strata:
    also let calls without a callee pass their arguments to their result. Facts are those of functions, with `allocs` those of objects and constants too.

    What a value is in terms of its own function is found once, for all questions. Terms (results of calls, parameters) are asked once, however many
    queries need them, and linked to the terms that they take their value from; only terms, links and functions that reach them are joined in a round.
    """
    n = p.node
    asked = callee_queries(p) if asked is None else asked
    external = n.where("kind = 'Call' and not is_internal")
    sites = stored(external.where("func_reg >= 0").select("node_id"))
    terms, defs = _terms(p, allocs), definitions(p)
    declared = stored(n.where("declares is not null").select(F.concat(F.lit("func|"), F.col("node_id").cast("string")).alias("alloc"), F.col("declares").alias("callee_id")))
    # Questions: the asked values, and the arguments of external calls.
    questions = asked.select("func_id", "idx", "key", F.col("query_id").alias("id"), F.lit(-1).alias("position")).union(
        p.call_arg.join(external.select("node_id", "func_id", "idx"), "node_id").select("func_id", "idx", register("reg"), "node_id", "position")
    )
    variables = questions.where(F.col("key").startswith("v:")).distinct()
    defined = before(questions, defs)
    told = defined.join(terms, F.col("def_id") == F.col("node")).where("term is not null").select("id", "position", "term")
    at_entry = variables.join(before(variables, defs).select(variables.columns), variables.columns, "left_anti").select("id", "position", _entry("func_id", "key"))
    told = stored(told.union(at_entry))
    asking = stored(told.where("position = -1").select(F.col("id").alias("query_id"), "term"))
    args = stored(told.where("position >= 0").select(F.col("id").alias("call_id"), "position", F.col("term").alias("dst")))
    # The last values of functions: a null term is a value that is followed no further, no row one that isn't defined there.
    last = defs.where(F.col("key").startswith("v:") | (F.col("key") == RETURN)).groupBy("func_id", "key").agg(F.max_by("node_id", "idx").alias("node"))
    last = stored(last.join(terms, "node", "left").select("func_id", "key", F.coalesce("term", F.lit("")).alias("dst")))
    returns = stored(last.where((F.col("key") == RETURN) & (F.col("dst") != "")).select(F.col("func_id").alias("callee_id"), "dst"))
    params = stored(p.heads.select("func_id", F.posexplode("params").alias("position", "param")).select("func_id", "position", F.concat(F.lit("v:"), "param").alias("key")))
    outer = p.heads.where("outer_func_id is not null").select("func_id", F.col("outer_func_id").alias("outer_id"))
    outer = stored(outer.join(n.select(F.col("func_id").alias("outer_id")).distinct(), "outer_id").select("func_id", "outer_id"))

    def parted(entry: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Entry values of parameters, with their position, and of other variables. Only the few that are asked about are sent to tasks, so that no large table is shuffled in a round."""
        entry = stored(entry)
        bound = stored(entry.join(params, ["func_id", "key"]))
        return bound, stored(entry.join(bound.select("src", "func_id", "key"), ["src", "func_id", "key"], "left_anti"))

    def outside(free: DataFrame) -> DataFrame:
        """(src, dst): what the entry values (src, func_id, key) of variables that are no parameters are, at the ends of the functions around."""
        out = []
        while not free.isEmpty():
            up = stored(free.join(outer, "func_id").select("src", F.col("outer_id").alias("func_id"), "key"))
            known = stored(up.join(last, ["func_id", "key"]).select("src", "func_id", "key", "dst"))
            through = up.join(known, ["src", "func_id", "key"], "left_anti").select("src", _entry("func_id", "key").alias("dst"))
            out.append(known.where("dst <> '' and not startswith(dst, 'e|')").select("src", "dst"))
            bound, free = parted(_entries(known.select("src", "dst").union(through).distinct(), "dst"))
            out.append(bound.select("src", "dst").distinct())
        return functools.reduce(DataFrame.union, out, free.select("src", F.lit("").alias("dst")))

    def parameters(terms: DataFrame, via: DataFrame) -> DataFrame:
        return terms.join(via, "callee_id").join(args, ["call_id", "position"]).select("src", "dst")

    def returned(terms: DataFrame, via: DataFrame) -> DataFrame:
        return terms.join(via, "call_id").join(returns, "callee_id").select("src", "dst")

    def passed(terms: DataFrame, via: DataFrame) -> DataFrame:
        return terms.join(via, "call_id").join(args, "call_id").select("src", "dst")

    def called_by(facts: DataFrame) -> DataFrame:
        """Edges of sites among the queries that new facts (src, alloc) are about."""
        return facts.join(asking.withColumnRenamed("term", "src"), "src").join(sites.withColumnRenamed("node_id", "query_id"), "query_id", "left_semi").join(declared, "alloc").select(F.col("query_id").alias("call_id"), "callee_id").distinct()

    alloc_of = lambda c: F.col(c).substr(F.lit(3), F.length(c))
    open_ = lambda df, c: df.where(F.col(c).startswith("e|") | F.col(c).startswith("c|")).select(F.col(c).alias("src")).distinct()
    direct = stored(asking.where(F.col("term").startswith("a|")).select(F.col("term").alias("src"), alloc_of("term").alias("alloc")).distinct())
    added = stored(open_(asking, "term"))
    fresh = stored(called_by(direct))
    none = lambda schema: _Known(stored(n.sparkSession.createDataFrame([], schema)))
    seen, edges, links, facts = _Known(added), none("call_id long, callee_id long"), none("src string, dst string"), none("src string, alloc string")
    bound, called, handled = none("src string, callee_id long, position int"), none("src string, call_id long"), none("call_id long")
    new_handled = handled.rows
    while True:
        # What is new is looked up once; the rules then join it with everything known, and all of it with what is new.
        new_bound, free = parted(_entries(added, "src"))
        new_bound = new_bound.select("src", F.col("func_id").alias("callee_id"), F.col("position").cast("int").alias("position"))
        new_called = stored(added.where(F.col("src").startswith("c|")).select("src", alloc_of("src").cast("long").alias("call_id")))
        out = outside(free).union(parameters(bound.rows, fresh)).union(returned(called.rows, fresh)).union(passed(called.rows, new_handled))
        edges.add(fresh)
        handled.add(new_handled)
        out = stored(out.union(parameters(new_bound, edges.rows)).union(returned(new_called, edges.rows)).union(passed(new_called, handled.rows)).distinct())
        bound.add(new_bound)
        called.add(new_called)
        # Functions go along new links from what was known, and along all links from then on.
        found = out.where(F.col("dst").startswith("a|")).select("src", alloc_of("dst").alias("alloc")).union(out.join(facts.rows.withColumnRenamed("src", "dst"), "dst").select("src", "alloc"))
        found = stored(lacking(stored(found.distinct()), facts.rows))
        links.add(out)
        told_now = none("src string, alloc string")
        while facts.add(found):
            told_now.add(found)
            found = stored(lacking(stored(links.rows.join(found.withColumnRenamed("src", "dst"), "dst").select("src", "alloc").distinct()), facts.rows))
        fresh = stored(lacking(stored(called_by(told_now.rows)), edges.rows))
        added = stored(lacking(stored(open_(out, "dst")), seen.rows))
        seen.add(added)
        new_handled = handled.rows.where("false")
        if added.isEmpty() and fresh.isEmpty():
            if not strata:
                break
            silent = called.rows.select("call_id").distinct().join(edges.rows, "call_id", "left_anti").join(handled.rows, "call_id", "left_anti")
            new_handled = stored(silent.join(external.select(F.col("node_id").alias("call_id")), "call_id", "left_semi"))
            if new_handled.isEmpty():
                break
    return edges.rows, asking.withColumnRenamed("term", "src").join(facts.rows.union(direct), "src").select("query_id", "alloc").distinct()
