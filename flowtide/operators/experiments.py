"""Runs in batches with a time limit, their figures, and the reports on them."""

from __future__ import annotations

import contextlib
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.figures import measured
from ..plans.fixpoint import scratch, stored
from ..plans.program import Program
from . import resolve, scans

RESULT = "size long, batch long, whole boolean, n_queries long, timed_out boolean, wall_ms long, task_ms long, cpu_ms long, rows_shuffled long, heap_mb long, n_points long, n_calls_asked long, n_flows long, n_facts long, n_edges long, n_handled long"


@contextlib.contextmanager
def limited(spark: SparkSession, seconds: float):
    """Jobs of this thread that run inside are cancelled when the time is over, and those begun after that; TimeoutError then."""
    context, tag = spark.sparkContext, f"limit-{uuid.uuid4().hex}"
    done, over = threading.Event(), threading.Event()

    def watch():
        if not done.wait(max(0, seconds)):
            over.set()
            while not done.wait(0.2):
                context.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        yield
    except Exception as e:
        if over.is_set():
            raise TimeoutError(f"stopped after {seconds} s") from e
        raise
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)


def usage(spark: SparkSession) -> tuple[int, int]:
    """Milliseconds that executors have spent in tasks since the session began, and MB of heap that the driver holds."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    return sum(executors.apply(i).totalDuration() for i in range(executors.size())), (heap.totalMemory() - heap.freeMemory()) >> 20


def run(p: Program, shapes=scans.BATCHES, timeout_s: float = 300, seed: int = 42, captures: str = "exit") -> DataFrame:
    """One row per batch of callee queries in a seeded order; a batch that runs out of time is stopped, its running jobs too, and has the limit as its time.

    task_ms: time of all tasks of the batch, summed over executors; cpu_ms: what of it they computed; heap_mb: heap of the driver when the batch ends.
    The tables that rules look things up in are made once for all batches; what a batch has written goes when its figures are known.
    """
    spark = p.function.sparkSession
    queries, rules = stored(scans.batches(scans.external_calls(p), "node_id", shapes, seed)), resolve.Rules(p, captures)
    out = []
    for size, batch in sorted(tuple(r) for r in queries.select("size", "batch").distinct().collect()):
        calls = queries.where((F.col("size") == size) & (F.col("batch") == batch)).select(F.col("node_id").alias("call_id"))
        n_queries = calls.count()
        begun, counts, late = time.monotonic(), {}, False
        with measured(spark) as cost, scratch(queries):
            try:
                with limited(spark, timeout_s):
                    counts = {r.tag: r.n for r in resolve.status(resolve.known(p, calls=calls, captures=captures, deadline=begun + timeout_s, rules=rules)).collect()}
            except TimeoutError:
                late = True
        wall = int(1000 * timeout_s) if late else cost["wall_ms"]
        figures = (wall, cost["task_ms"], cost["cpu_ms"], cost["rows_shuffled"], usage(spark)[1])
        out.append((size, batch, size == 0, n_queries, late, *figures, *(counts.get(t, 0) for t in ("point", "ask", "flow", "pts", "edge", "handled"))))
    return spark.createDataFrame(out, RESULT)


def report(results: DataFrame) -> DataFrame:
    """Totals, maxima and whole-number means by batch size."""
    return results.groupBy("size").agg(
        F.count("*").alias("batches"), F.sum("n_queries").alias("queries"), F.max("wall_ms").alias("slowest_ms"),
        F.expr("sum(wall_ms) div count(*)").alias("mean_ms"), F.sum("task_ms").alias("task_ms"), F.sum("cpu_ms").alias("cpu_ms"), F.max("heap_mb").alias("most_heap_mb"),
        F.max("n_edges").alias("most_edges"), F.count_if("timed_out").alias("timed_out"),
    )


def by_program(p: Program, queries: DataFrame, edges: DataFrame) -> DataFrame:
    """(program_id, queries, edges): queries (call_id) and different call edges of each program, also of those that have none."""
    owner = p.node.join(p.function.select("func_id", "program_id"), "func_id").select(F.col("node_id").alias("call_id"), "program_id")
    count = lambda rows, name: rows.distinct().join(owner, "call_id").groupBy("program_id").agg(F.count("*").alias(name))
    programs = p.function.select("program_id").distinct()
    return programs.join(count(queries.select("call_id"), "queries"), "program_id", "left").join(count(edges.select("call_id", "callee_id"), "edges"), "program_id", "left").na.fill(0)


def program_report(programs: DataFrame, elapsed_ms: int) -> DataFrame:
    """One row of totals, maxima and whole-number means over the rows of `by_program`; a mean over nothing is null."""
    total = programs.agg(F.count("*").alias("programs"), F.coalesce(F.sum("queries"), F.lit(0)).alias("queries"), F.max("queries").alias("most_queries"), F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"))
    mean = lambda over, by: F.expr(f"{over} div nullif({by}, 0)")
    return total.select(
        "programs", "queries", mean("queries", "programs").alias("queries_per_program"), "most_queries", "edges", F.lit(elapsed_ms).cast("long").alias("elapsed_ms"),
        mean(f"{int(elapsed_ms)}L", "programs").alias("ms_per_program"), mean(f"{int(elapsed_ms)}L", "queries").alias("ms_per_query"),
    )


def write(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def taint(p: Program, sinks: DataFrame, chosen: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(index, call_id, role, point, alloc) of what reaches the sinks (name), and the call graph found on the way.

    chosen: only the queries with these indexes; an index out of range is an error.
    """
    asked = scans.sink_queries(p, sinks).where("reg >= 0").join(p.node.select(F.col("node_id").alias("call_id"), "func_id", "block", "idx"), "call_id")
    asked = scans.indexed(asked.select("call_id", "sink", "role", resolve.point_of("reg").alias("point")), "call_id", "role", "sink", "point")
    if chosen is not None:
        n = asked.count()
        if any(not 0 <= i < n for i in chosen):
            raise IndexError(f"there are {n} queries")
        asked = asked.where(F.col("index").isin(chosen))
    rows = resolve.known(p, points=asked.select("point"))
    return asked.join(resolve.points_to(rows), "point", "left").select("index", "call_id", "role", "point", "alloc"), resolve.edges(rows)
