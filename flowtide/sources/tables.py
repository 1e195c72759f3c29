"""A program encoded in the supplied order tables.

Orders are functions, nested by their keys; line items are nodes in a fixed total
order. The same encoding is stated twice, as DataFrames and as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import stored
from ..plans.program import Program

#: Nodes of a function have ids from func_id * SPAN on; a function of more nodes is an error.
SPAN, NAMES, NESTING = 1 << 20, 20, 6


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files. The path is a pattern, since a stream takes no path that is one file."""
    return spark.readStream.schema(load(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _name(column) -> F.Column:
    return F.concat(F.lit("v"), (column % NAMES).cast("string"))


def nodes(lineitem: DataFrame) -> DataFrame:
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    line = F.col("l_linenumber").cast("long")
    pair = F.concat("l_returnflag", "l_linestatus")
    kind = (
        F.when(pair == "AF", "NewObject")
        .when((pair == "AO") & (F.col("l_quantity") < 40), "WriteVariable")
        .when(pair == "AO", "WriteProperty")
        .when(pair == "NF", "ReadVariable")
        .when(pair == "NO", "Call")
        .when((pair == "RF") & (F.col("l_quantity") >= 30), "ReadProperty")
        .when((pair == "RF") & (F.col("l_partkey") % 2 == 0), "DeclareFunction")
        .when(pair == "RF", "Constant")
        .otherwise("DeclareVariable")
    )
    none = F.lit(-1).cast("long")
    other = line % 7 + 1
    is_kind = lambda *k: F.col("kind").isin(*k)
    method = is_kind("Call") & (F.col("l_tax") == 0)
    named = lineitem.withColumn("idx", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("long")).withColumn("kind", kind)
    node_id = F.when(F.col("idx") < SPAN, F.col("l_orderkey") * SPAN + F.col("idx")).otherwise(F.raise_error(F.lit(f"more than {SPAN} nodes in a function")).cast("long"))
    return named.select(
        F.col("l_orderkey").alias("func_id"), "idx", node_id.alias("node_id"), "kind",
        F.when(is_kind("NewObject", "Constant", "DeclareFunction", "ReadVariable", "Call"), line).when(is_kind("ReadProperty"), other).otherwise(none).alias("result_reg"),
        F.when(is_kind("ReadProperty", "WriteProperty"), line).when(method, other).otherwise(none).alias("base_reg"),
        F.when(is_kind("WriteVariable"), line).when(is_kind("WriteProperty"), other).otherwise(none).alias("value_reg"),
        F.when(is_kind("Call") & ~method, other).otherwise(none).alias("func_reg"),
        F.when(is_kind("ReadVariable", "WriteVariable", "DeclareVariable"), _name(F.col("l_suppkey"))).alias("name"),
        F.when(is_kind("ReadProperty", "WriteProperty") | method, F.concat(F.lit("p"), (F.col("l_partkey") % 5).cast("string"))).alias("property"),
        (is_kind("Call") & (F.col("l_quantity") < 3)).alias("is_internal"), F.lit(False).alias("is_ctor"),
        F.when(is_kind("DeclareFunction"), F.col("l_partkey")).alias("declares"), F.col("idx").cast("int").alias("line"), F.lit(0).alias("col"), node_id.alias("block"),
    )


def program(spark: SparkSession, sf_dir: str, keep: bool = False) -> Program:
    """keep: the nodes are numbered once and stored, for queries that need them several times. Every node is a block of its own."""
    node = nodes(load(spark, sf_dir, "lineitem"))
    node = stored(node) if keep else node
    declared = node.where("kind = 'DeclareVariable'").groupBy("func_id").agg(F.sort_array(F.collect_set("name")).alias("vars"))
    key = F.col("o_orderkey")
    signatures = load(spark, sf_dir, "orders").select(
        F.lit("tables").alias("program_id"), key.alias("func_id"), _name(key).alias("name"),
        F.when(key > 0, F.floor(key / NESTING)).cast("long").alias("outer_func_id"), (key == 0).alias("is_main"),
        F.array(_name(F.col("o_custkey")), _name(F.col("o_custkey") + 7)).alias("params"),
    )
    function = signatures.join(declared, "func_id", "left").select("program_id", "func_id", "name", "outer_func_id", "is_main", "params", F.coalesce("vars", F.array().cast("array<string>")).alias("vars"), (F.col("func_id") * SPAN + 1).alias("entry"), F.lit(None).cast("long").alias("exit"))
    own = Window.partitionBy("func_id").orderBy("idx")
    edges = node.select(F.col("node_id").alias("src"), F.lead("node_id").over(own).alias("dst")).where("dst is not null")
    args = node.where("kind = 'Call'").select("node_id", "result_reg", F.explode(F.array(F.lit(0), F.lit(1))).alias("position")).select("node_id", "position", ((F.col("result_reg") + F.col("position")) % 7 + 1).alias("reg"))
    return Program(function, node, edges, args, edges, signatures, straight=True)


#: The encoding in SQL: relations node, func, cfg_edge, call_arg.
SQL = f"""
raw AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS i,
    CAST(l_linenumber AS BIGINT) AS ln, CAST(l_linenumber % 7 + 1 AS BIGINT) AS other,
    CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'NewObject' WHEN 'AO' THEN CASE WHEN l_quantity < 40 THEN 'WriteVariable' ELSE 'WriteProperty' END
      WHEN 'NF' THEN 'ReadVariable' WHEN 'NO' THEN 'Call'
      WHEN 'RF' THEN CASE WHEN l_quantity >= 30 THEN 'ReadProperty' WHEN l_partkey % 2 = 0 THEN 'DeclareFunction' ELSE 'Constant' END
      ELSE 'DeclareVariable' END AS kind
  FROM lineitem
), node AS (
  SELECT l_orderkey AS func_id, CAST(i AS BIGINT) AS idx, CAST(CAST(l_orderkey AS BIGINT) * {SPAN} + i AS BIGINT) AS node_id, kind,
    CASE WHEN kind IN ('NewObject', 'Constant', 'DeclareFunction', 'ReadVariable', 'Call') THEN ln WHEN kind = 'ReadProperty' THEN other ELSE -1 END AS result_reg,
    CASE WHEN kind IN ('ReadProperty', 'WriteProperty') THEN ln WHEN kind = 'Call' AND l_tax = 0 THEN other ELSE -1 END AS base_reg,
    CASE WHEN kind = 'WriteVariable' THEN ln WHEN kind = 'WriteProperty' THEN other ELSE -1 END AS value_reg,
    CASE WHEN kind = 'Call' AND l_tax <> 0 THEN other ELSE -1 END AS func_reg,
    CASE WHEN kind IN ('ReadVariable', 'WriteVariable', 'DeclareVariable') THEN 'v' || (l_suppkey % {NAMES}) END AS name,
    CASE WHEN kind IN ('ReadProperty', 'WriteProperty') OR kind = 'Call' AND l_tax = 0 THEN 'p' || (l_partkey % 5) END AS property,
    kind = 'Call' AND l_quantity < 3 AS is_internal,
    CASE WHEN kind = 'DeclareFunction' THEN l_partkey END AS declares
  FROM raw
), func AS (
  SELECT o_orderkey AS func_id, 'v' || (o_orderkey % {NAMES}) AS name, CASE WHEN o_orderkey > 0 THEN o_orderkey // {NESTING} END AS outer_func_id,
    o_orderkey = 0 AS is_main, ['v' || (o_custkey % {NAMES}), 'v' || ((o_custkey + 7) % {NAMES})] AS params
  FROM orders
), cfg_edge AS (
  SELECT * FROM (SELECT node_id AS src, lead(node_id) OVER (PARTITION BY func_id ORDER BY idx) AS dst FROM node) WHERE dst IS NOT NULL
), call_arg AS (
  SELECT node_id, p AS position, (result_reg + p) % 7 + 1 AS reg FROM node, (VALUES (0), (1)) t(p) WHERE kind = 'Call'
)"""
