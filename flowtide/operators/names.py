"""Lexical scope: ancestors, declarations, visibility, free and static names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import stored
from ..plans.program import Program


#: An ancestor of more functions than that is looked up in a broadcast table, so that none of its rows meet in one task.
WIDE = 100_000


def ancestors(p: Program) -> DataFrame:
    """(func_id, anc_id, depth) of every function and each function around it, itself at depth 0.

    Each round doubles the depth that is known, so that rounds are few in programs nested as deep as they like. A round writes what it adds.
    """
    own = stored(p.heads.select("func_id", "outer_func_id"))
    total = own.select("func_id", F.col("func_id").alias("anc_id"), F.lit(0).cast("long").alias("depth"))
    jump = stored(own.where("outer_func_id is not null").select("func_id", F.col("outer_func_id").alias("to")).join(own.select(F.col("func_id").alias("to")), "to").select("func_id", "to"))
    reach = 1
    while not jump.isEmpty():
        further = stored(jump.join(total.withColumnRenamed("func_id", "to"), "to").select("func_id", "anc_id", (F.col("depth") + reach).alias("depth")))
        total = total.union(further)
        jump = stored(jump.join(jump.select(F.col("func_id").alias("to"), F.col("to").alias("next")), "to").select("func_id", F.col("next").alias("to")))
        reach *= 2
    return total


def declarations(p: Program) -> DataFrame:
    """(func_id, name) of parameters and variables."""
    return p.function.select("func_id", F.explode(F.array_union("params", "vars")).alias("name")).distinct()


def visible(p: Program, up: DataFrame) -> DataFrame:
    """(func_id, name, decl_id): the nearest function around each function that declares the name."""
    declared = stored(declarations(p).withColumnRenamed("func_id", "anc_id"))
    wide = stored(up.groupBy("anc_id").count().where(F.col("count") > WIDE).select("anc_id"))
    around = F.broadcast(declared.join(wide, "anc_id"))
    seen = up.join(around, "anc_id").union(up.join(F.broadcast(wide), "anc_id", "left_anti").join(declared, "anc_id"))
    return seen.groupBy("func_id", "name").agg(F.min_by("anc_id", "depth").alias("decl_id"))


def inner_names(p: Program) -> DataFrame:
    """(func_id, name): names of the functions declared in each function."""
    return p.heads.where("outer_func_id is not null and name is not null").select(F.col("outer_func_id").alias("func_id"), "name").distinct()


def nearest(p: Program, up: DataFrame, known: DataFrame, used: DataFrame) -> DataFrame:
    """(func_id, name, decl_id): for each used (func_id, name) the nearest function around that is in known (func_id, name)."""
    at = known.select(F.col("func_id").alias("anc_id"), "name").distinct()
    return used.distinct().join(up, "func_id").join(at, ["anc_id", "name"]).groupBy("func_id", "name").agg(F.min_by("anc_id", "depth").alias("decl_id"))


def declaring_scope(p: Program, up: DataFrame) -> DataFrame:
    """(node_id, name, decl_id) of every variable read and write: the nearest function around with a parameter, variable or function of that name.

    `process` is always the main function's; another name that isn't declared belongs to the function that uses it.
    """
    uses = p.node.where(F.col("kind").isin("ReadVariable", "WriteVariable")).select("node_id", "func_id", "name")
    found = nearest(p, up, declarations(p).union(inner_names(p)), uses.where("name <> 'process'").select("func_id", "name"))
    main = up.join(p.heads.where("is_main").select(F.col("func_id").alias("anc_id")), "anc_id").select("func_id", F.lit("process").alias("name"), F.col("anc_id").alias("decl_id"))
    return uses.join(found.union(main), ["func_id", "name"], "left").select("node_id", "name", F.coalesce("decl_id", "func_id").alias("decl_id"))


def bound_names(p: Program) -> DataFrame:
    """(func_id, name): a function's own name and its variables, without its parameters."""
    own = p.function.where("name is not null").select("func_id", "name")
    return own.union(p.function.select("func_id", F.explode("vars").alias("name"))).distinct()


def free_names(p: Program, up: DataFrame) -> DataFrame:
    """(func_id, name): names read in a function or one nested in it, each without the reading function's own bound names.

    Names free in a nested function stay free in the outer one even if that binds them.
    """
    reads = p.node.where(F.col("kind").isin("ReadVariable", "Catch") & F.col("name").isNotNull()).select("func_id", "name").distinct()
    local = reads.join(bound_names(p), ["func_id", "name"], "left_anti")
    return local.join(up.select("func_id", "anc_id"), "func_id").select(F.col("anc_id").alias("func_id"), "name").distinct()


def capturing(p: Program, up: DataFrame) -> DataFrame:
    """(func_id, inner_id, name): functions nested directly in a function, with the names that they take from outside."""
    inner = p.function.where("outer_func_id is not null").select(F.col("outer_func_id").alias("outer_id"), F.col("func_id"))
    return free_names(p, up).join(inner, "func_id").select(F.col("outer_id").alias("func_id"), F.col("func_id").alias("inner_id"), "name")


def static_references(p: Program, up: DataFrame) -> DataFrame:
    """(node_id, callee_id): reads of a name and the functions that are declared under it in the nearest scope that knows it.

    A function declaration reaches every read of its own level, whatever else is declared there, and goes
    into nested functions until one has a parameter, variable or function of the same name.
    """
    functions = p.heads.where("outer_func_id is not null and name is not null").select(F.col("outer_func_id").alias("decl_id"), "name", F.col("func_id").alias("callee_id"))
    reads = p.node.where("kind = 'ReadVariable'").select("node_id", "func_id", "name")
    found = nearest(p, up, declarations(p).union(inner_names(p)), reads.select("func_id", "name"))
    return reads.join(found, ["func_id", "name"]).join(functions, ["decl_id", "name"]).select("node_id", "callee_id")


def function_references(p: Program, up: DataFrame, asked: DataFrame | None = None, *columns: str) -> DataFrame:
    """(callee_id, node_id): reads of a function's name at its declaration's level and below, not past a function whose parameters have that name.

    asked (func_id): only references to these functions; columns: more columns of the reads.
    """
    functions = p.heads.where("outer_func_id is not null and name is not null").select(F.col("outer_func_id").alias("anc_id"), "name", F.col("func_id").alias("callee_id"))
    if asked is not None:
        functions = stored(functions.join(asked.select(F.col("func_id").alias("callee_id")), "callee_id", "left_semi").select("anc_id", "name", "callee_id"))
    rebound = p.heads.select(F.col("func_id").alias("anc_id"), F.explode("params").alias("name")).distinct()
    reads = p.node.where("kind = 'ReadVariable'").select("node_id", "func_id", "name")
    used = reads.select("func_id", "name").distinct()
    if asked is not None:
        # Most names that are read belong to no asked function: only those that do are looked up on the way there.
        used = stored(used.join(up, "func_id").join(functions.select("anc_id", "name"), ["anc_id", "name"], "left_semi").select("func_id", "name").distinct())
    at = used.join(up, "func_id")
    first = at.join(rebound, ["anc_id", "name"]).groupBy("func_id", "name").agg(F.min("depth").alias("stop"))
    seen = at.join(first, ["func_id", "name"], "left").where("stop is null or depth <= stop").join(functions, ["anc_id", "name"])
    return seen.join(reads, ["func_id", "name"]).select("callee_id", "node_id", *columns)
