"""Scans, predicates and counts over program tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.program import Program


def is_method_call() -> Column:
    """A call without a function register and with a fixed property."""
    return (F.col("kind") == "Call") & (F.col("func_reg") == -1) & F.col("property").isNotNull()


def calls(p: Program) -> DataFrame:
    return p.node.where("kind = 'Call'")


def external_calls(p: Program) -> DataFrame:
    """Calls that are no internal or synthetic ones: the universe of callee queries."""
    return calls(p).where(~F.col("is_internal"))


def is_property_access() -> Column:
    """Property reads and writes, and calls without a function register that aren't internal."""
    return F.col("kind").isin("ReadProperty", "WriteProperty") | ((F.col("kind") == "Call") & (F.col("func_reg") == -1) & ~F.col("is_internal"))


def property_accesses(p: Program) -> DataFrame:
    return p.node.where(is_property_access())


def nodes_of(p: Program, func_id: int) -> DataFrame:
    return p.node.where(F.col("func_id") == func_id)


def function_named(p: Program, name: str) -> DataFrame:
    """The first function of that name by id; no row if there is none."""
    return p.function.where(F.col("name") == name).orderBy("func_id").limit(1)


def node_at(p: Program, node_id: int) -> DataFrame:
    """The node with an id; an unknown id is an error."""
    found = p.node.where(F.col("node_id") == node_id)
    if found.isEmpty():
        raise KeyError(f"no node {node_id}")
    return found


def sink_nodes(p: Program, names: DataFrame) -> DataFrame:
    """Reads of a listed variable name and of a listed property, as one relation (sinks are named by either)."""
    names = names.select(F.col("name").alias("sink")).distinct()
    variables = p.node.where("kind = 'ReadVariable'").join(names, F.col("name") == F.col("sink"))
    properties = p.node.where("kind = 'ReadProperty'").join(names, F.col("property") == F.col("sink"))
    return variables.unionByName(properties)


def sink_queries(p: Program, names: DataFrame) -> DataFrame:
    """Taint queries of the calls that a sink read leads to: (sink, call_id, role, reg).

    A read's block has to have one successor. Of that block's calls those count whose function register
    is the read's result, or whose own property is a sink. Each argument is asked for; of a call of a sink
    property its function register too, which is -1 for a method call: kept, but flagged by its role.
    """
    sinks = sink_nodes(p, names).select("block", "sink", F.col("result_reg").alias("read_reg"))
    single = p.block_edge.groupBy(F.col("src").alias("block")).agg(F.min("dst").alias("next"), F.count_distinct("dst").alias("n")).where("n = 1")
    calls_after = p.node.where("kind = 'Call'").select(F.col("block").alias("next"), F.col("node_id").alias("call_id"), "func_reg", "property")
    listed = names.select(F.col("name").alias("property"), F.lit(True).alias("is_sink")).distinct()
    met = sinks.join(single.select("block", "next"), "block").join(calls_after, "next").join(listed, "property", "left")
    called = met.where("func_reg = read_reg or is_sink").select("sink", "call_id", "func_reg", F.coalesce("is_sink", F.lit(False)).alias("is_sink"))
    args = called.join(p.call_arg, F.col("call_id") == F.col("node_id")).select("sink", "call_id", F.lit("argument").alias("role"), F.col("reg"))
    receivers = called.where("is_sink").select("sink", "call_id", F.when(F.col("func_reg") == -1, "no receiver").otherwise("receiver").alias("role"), F.col("func_reg").alias("reg"))
    return args.union(receivers).distinct()


def percentage(part: Column, total: Column) -> Column:
    """Two decimals and a percent sign; nothing of nothing is all."""
    return F.format_string("%.2f%%", F.when(total == 0, F.lit(100.0)).otherwise(100.0 * part / total))


def indexed(df: DataFrame, *order) -> DataFrame:
    """Rows numbered from 0 in a total order, by range partitions: counts of partitions are summed, not rows in one task."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    from ..plans.fixpoint import cut

    parts = cut(parts)
    sizes = parts.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = Window.partitionBy("part").orderBy(*order)
    return parts.join(F.broadcast(before), "part").withColumn("index", (F.col("before") + F.row_number().over(own) - 1).cast("long")).drop("part", "before")


#: Batches of the standard experiment: (size, how many); size 0 is the whole program.
BATCHES = ((1, 10), (5, 10), (10, 5), (50, 2), (100, 2), (250, 2), (500, 2), (1000, 1), (0, 1))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A pseudo-random order that depends on the seed and the key alone."""
    return indexed(df.withColumn("draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))), "draw", key).drop("draw")


def batches(queries: DataFrame, key: str, shapes=BATCHES, seed: int = 42) -> DataFrame:
    """Each query with the batches it is in: size, batch and its index in the shuffled order. The last, incomplete batch of a size counts."""
    out = None
    order = shuffled(queries.select(key), key, seed)
    for size, most in shapes:
        batch = F.floor(F.col("index") / size) if size else F.lit(0)
        part = order.withColumn("size", F.lit(size)).withColumn("batch", batch.cast("long")).where(F.col("batch") < most)
        out = part if out is None else out.unionByName(part)
    return out.select("size", "batch", "index", key)
