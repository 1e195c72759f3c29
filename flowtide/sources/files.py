"""Files in and out: source trees, sink lists, the flowgraph text form, call graphs as JSON, text and DOT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import fixpoint
from ..plans.program import Program

#: How the text form calls kinds of nodes whose name isn't that of the kind in small letters with hyphens.
TEXT_NAMES = {"DeclareVariable": "vardecl", "DeclareFunction": "function-decl"}


def sources(spark: SparkSession, path: str, extension: str = "js", recursive: bool = False) -> DataFrame:
    """(program_id, source) of every file with the extension."""
    reader = spark.read.option("pathGlobFilter", f"*.{extension}")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("program_id"), F.col("value").alias("source"))


def sink_names(spark: SparkSession, path: str) -> DataFrame:
    """One name a line; blank lines don't count."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''").distinct()


def flowgraph(dumps: DataFrame) -> DataFrame:
    """Nodes of flowgraph dumps (program_id, source): line_no, function, block, tag, node_id, op, operands (null: none), place and the block's successors.

    Lines are taken apart by expressions alone; the function and block that a line
    stands in are the last ones named before it in the same dump.
    """
    lines = dumps.select("program_id", F.posexplode(F.split("source", "\r?\n")).alias("line_no", "line"))
    before = Window.partitionBy("program_id").orderBy("line_no")
    pick = lambda pattern, i=1: F.nullif(F.regexp_extract("line", pattern, i), F.lit(""))
    marked = lines.select(
        "program_id", "line_no", "line",
        F.last(F.when(F.col("line").rlike(r"^\S"), F.col("line")), True).over(before).alias("function"),
        F.last(pick(r"^\s+block (\d+):"), True).over(before).cast("long").alias("block"),
        F.last(F.when(F.col("line").rlike(r"^\s+block "), F.regexp_extract("line", r"\[([\w-]+)\]", 1)), True).over(before).alias("tag"),
    )
    successors = marked.where(F.col("line").rlike(r"^\s+->\[")).select("program_id", "block", F.transform(F.regexp_extract_all("line", F.lit(r"block (\d+)")), lambda b: b.cast("long")).alias("successors"))
    node = r"^\s+node (\d+): ([\w-]+)(?:\[(.*)\])? \(([^()]*)\)\s*$"
    bracket = r"^\s+node \d+: [\w-]+\["
    nodes = marked.where(F.col("line").rlike(node)).select(
        "program_id", "line_no", "function", "block", "tag", F.regexp_extract("line", node, 1).cast("long").alias("node_id"), F.regexp_extract("line", node, 2).alias("op"),
        F.when(F.col("line").rlike(bracket), F.regexp_extract("line", node, 3)).alias("operands"), F.regexp_extract("line", node, 4).alias("place"),
    )
    return nodes.join(successors, ["program_id", "block"], "left")


def flowgraph_text(nodes: DataFrame) -> DataFrame:
    """(program_id, line_no, value): the dump of parsed nodes, to be written in that order; lines of functions and blocks stand before and behind their nodes."""
    label = lambda b: F.concat(F.lit("block "), b.cast("string"))
    operands = F.when(F.col("operands").isNull(), "").otherwise(F.concat(F.lit("["), F.col("operands"), F.lit("]")))
    own = nodes.select("program_id", "line_no", F.lit(0).alias("rank"), F.concat(F.lit("    node "), F.col("node_id").cast("string"), F.lit(": "), F.col("op"), operands, F.lit(" ("), F.col("place"), F.lit(")")).alias("value"))
    blocks = nodes.groupBy("program_id", "function", "block").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.first("tag").alias("tag"), F.first("successors").alias("successors"))
    tag = F.when(F.coalesce("tag", F.lit("")) == "", "").otherwise(F.concat(F.lit(" ["), F.col("tag"), F.lit("]")))
    heads = blocks.select("program_id", F.col("first").alias("line_no"), F.lit(-1).alias("rank"), F.concat(F.lit("  "), label(F.col("block")), F.lit(":"), tag).alias("value"))
    ends = blocks.where("successors is not null").select("program_id", F.col("last").alias("line_no"), F.lit(1).alias("rank"), F.concat(F.lit("    ->["), F.concat_ws(", ", F.transform("successors", label)), F.lit("]")).alias("value"))
    functions = blocks.groupBy("program_id", "function").agg(F.min("first").alias("line_no")).select("program_id", "line_no", F.lit(-2).alias("rank"), F.col("function").alias("value"))
    order = Window.partitionBy("program_id").orderBy("line_no", "rank")
    return own.union(heads).union(ends).union(functions).select("program_id", F.row_number().over(order).alias("line_no"), "value")


def program_text(p: Program) -> DataFrame:
    """(program_id, line_no, value): the text form of every program, to be written in that order.

    Functions stand in the order of their ids, blocks likewise with the entry first; a block without nodes has its
    lines too. What a program's tables don't hold is written as `-`: values of constants, registers that aren't there.
    """
    register = lambda c: F.when(F.col(c) >= 0, F.concat(F.lit("v"), F.col(c).cast("string"))).otherwise("-")
    quoted = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("'"), F.col(c), F.lit("'")))
    head = lambda name, params: F.concat(F.lit("function "), F.coalesce(name, F.lit("")), F.lit("("), F.array_join(params, ", "), F.lit(")"))
    label = lambda b: F.concat(F.lit("block "), b.cast("string"))
    owner = p.function.select("func_id", "program_id", "entry", "exit")
    seeds = p.node.select("block", "func_id").union(p.function.select("entry", "func_id")).union(p.function.select("exit", "func_id")).distinct()
    hop = p.block_edge.select(F.col("src").alias("block"), "dst").distinct()
    owned = fixpoint(seeds, lambda new, _: new.join(hop, "block").select(F.col("dst").alias("block"), "func_id")).join(owner, "func_id")
    # A line's place: function, whether it is of a block, whether that isn't the entry, block, head or node or end, node.
    at = lambda block, later, part, idx: F.struct("func_id", F.lit(block).alias("block_line"), later.alias("later"), (F.col("block") if block else F.lit(-1)).cast("long").alias("block"), F.lit(part).alias("part"), idx.cast("long").alias("idx")).alias("at")
    later = F.col("block") != F.col("entry")
    tag = F.when(F.col("block") == F.col("entry"), " [entry]").when(F.col("block") == F.col("exit"), " [exit-ordinary]").otherwise("")
    heads = owned.select("program_id", at(1, later, 0, F.lit(0)), F.concat(F.lit("  "), label(F.col("block")), F.lit(":"), tag).alias("value"))
    next_ = hop.groupBy("block").agg(F.array_sort(F.collect_list("dst")).alias("next"))
    ends = owned.join(next_, "block", "left").select("program_id", at(1, later, 2, F.lit(0)), F.concat(F.lit("    ->["), F.array_join(F.transform(F.coalesce("next", F.array().cast("array<bigint>")), label), ", "), F.lit("]")).alias("value"))
    functions = p.function.select("program_id", at(0, F.lit(False), 0, F.lit(0)), F.when(F.col("is_main"), F.concat(F.lit("<main> "), F.lit("function()"))).otherwise(head(F.col("name"), F.col("params"))).alias("value"))
    given = p.call_arg.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", register("reg").alias("r")))), lambda x: x.r).alias("given"))
    declared = p.function.select(F.col("func_id").alias("declares"), head(F.col("name"), F.col("params")).alias("declared"))
    n = p.node.join(owner, "func_id").join(given, "node_id", "left").join(declared, "declares", "left").withColumn("given", F.coalesce("given", F.array().cast("array<string>")))
    kind, result, value, base = F.col("kind"), register("result_reg"), register("value_reg"), register("base_reg")
    callee = F.when((F.col("func_reg") < 0) & F.col("property").isNotNull(), quoted("property")).otherwise(register("func_reg"))
    operands = (
        F.when(kind == "Constant", F.array(F.lit("-"), result)).when(kind == "NewObject", F.array(result)).when(kind == "DeclareVariable", F.array(quoted("name")))
        .when(kind == "DeclareFunction", F.array("declared", result)).when(kind == "ReadVariable", F.array(quoted("name"), result, F.lit("-"))).when(kind == "WriteVariable", F.array(value, quoted("name")))
        .when(kind == "ReadProperty", F.array(base, quoted("property"), result)).when(kind == "WriteProperty", F.array(base, quoted("property"), value))
        .when(kind == "Call", F.concat(F.array(base, callee, result), F.col("given"))).when(kind.isin("BinaryOperator", "UnaryOperator"), F.concat(F.col("given"), F.array(result)))
        .otherwise(F.filter(F.array(value, base, result), lambda x: x != "-"))
    )
    plain = F.lower(F.regexp_replace("kind", "(?<=[a-z])(?=[A-Z])", "-"))
    name = F.coalesce(F.create_map(*(F.lit(x) for pair in TEXT_NAMES.items() for x in pair))[kind], F.when((kind == "Call") & F.col("is_ctor"), "construct").otherwise(plain))
    shown = F.when(F.size(operands) == 0, "").otherwise(F.concat(F.lit("["), F.array_join(operands, ",", "-"), F.lit("]")))
    place = F.concat_ws(":", F.regexp_replace("program_id", r"[()\r\n]", "_"), F.col("line").cast("string"), F.col("col").cast("string"))
    nodes = n.select("program_id", at(1, later, 1, F.col("idx")), F.concat(F.lit("    node "), F.col("node_id").cast("string"), F.lit(": "), name, shown, F.lit(" ("), place, F.lit(")")).alias("value"))
    order = Window.partitionBy("program_id").orderBy("at")
    return functions.union(heads).union(nodes).union(ends).select("program_id", F.row_number().over(order).alias("line_no"), "value")


def write_program_text(p: Program, folder: str) -> None:
    """The text form as a folder of lines for each program."""
    lines = program_text(p).repartition("program_id").sortWithinPartitions("program_id", "line_no")
    lines.select("program_id", "value").write.mode("overwrite").partitionBy("program_id").text(folder)


def call_graph_spans(p: Program, edges: DataFrame) -> DataFrame:
    """(program_id, caller, callee): spans of call sites and of the functions called."""
    site = p.node.select(F.col("node_id").alias("call_id"), "func_id", F.struct(F.struct("line", F.col("col").alias("column")).alias("start")).alias("caller"))
    # Only functions that are called are looked for in the nodes.
    first = p.node.join(edges.select(F.col("callee_id").alias("func_id")).distinct(), "func_id", "left_semi").groupBy("func_id").agg(F.min_by(F.struct(F.struct("line", F.col("col").alias("column")).alias("start")), "idx").alias("callee")).withColumnRenamed("func_id", "callee_id")
    owner = p.heads.select("func_id", "program_id")
    return edges.distinct().join(site, "call_id").join(owner, "func_id").join(first, "callee_id").select("program_id", "caller", "callee")


def call_graph_json(p: Program, edges: DataFrame) -> DataFrame:
    """One JSON object per edge (JSON lines): a call graph of any size is written by all tasks."""
    return call_graph_spans(p, edges).select("program_id", F.to_json(F.struct("callee", "caller")).alias("value"))


def call_graph_text(edges: DataFrame) -> DataFrame:
    return edges.distinct().select(F.concat_ws(" -> ", F.concat(F.lit("call "), F.col("call_id").cast("string")), F.concat(F.lit("function "), F.col("callee_id").cast("string"))).alias("value"))


def dot(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Edge statements of a DOT digraph; the writer puts the braces around them."""
    return edges.select(src, dst).distinct().select(F.concat(F.lit('"'), F.col(src).cast("string"), F.lit('" -> "'), F.col(dst).cast("string"), F.lit('";')).alias("value"))
