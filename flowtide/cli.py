"""Command line: which values reach the sinks of JavaScript programs, and which functions their calls invoke."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import experiments, resolve
from .sources import files
from .sources.javascript import programs


def options() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="flowtide", description=__doc__)
    source = out.add_mutually_exclusive_group(required=True)
    source.add_argument("-d", "--directory", help="all .js files of a folder and those below")
    source.add_argument("-f", "--file", help="one file")
    out.add_argument("-o", "--output", help="folder for the call graph as JSON lines")
    out.add_argument("-s", "--sinks", help="text file with a sink name a line; without it every call is resolved")
    out.add_argument("-fg", "--flowgraph", help="folder for the flowgraphs as text, a folder each program")
    out.add_argument("-tq", "--taint-queries", help="indexes of sink queries to run, comma-separated")
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    args = options().parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    source = files.sources(spark, args.directory, recursive=True) if args.directory else files.sources(spark, args.file)
    p, errors = programs(source)
    errors.show(truncate=False)
    if args.flowgraph:
        files.write_program_text(p, args.flowgraph)
    if args.sinks:
        chosen = [int(i) for i in args.taint_queries.split(",")] if args.taint_queries else None
        found, edges = experiments.taint(p, files.sink_names(spark, args.sinks), chosen)
        found.orderBy("index", "alloc").show(truncate=False)
    else:
        edges = resolve.edges(resolve.known(p))
    if args.output:
        files.call_graph_json(p, edges).select(F.col("value")).write.mode("overwrite").text(args.output)
    return edges


if __name__ == "__main__":
    main()
