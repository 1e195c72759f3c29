"""Files in and out, live sets, batch runs and the command line."""

import json
import time

import pytest
from pyspark.sql import functions as F

from flowtide import cli
from flowtide.operators import experiments, relations, resolve, scans
from flowtide.plans.fixpoint import propagate, roots
from flowtide.sources import files, tables
from flowtide.sources.javascript import programs
from flowtide.streaming import live

DUMP = """<main> function()
  block 0: [entry]
    node 0: constant[undefined,v1] (a.js)
    node 1: vardecl['t'] (a.js:1:5)
    ->[block 1]
  block 1:
    node 2: constant["x [y] (z)",v2] (a.js:1:9)
    node 3: nop (a.js:2:1)
    ->[block 2, block 3]
  block 2:
    node 4: call[v3,'field',-] (a.js:3:1)
    ->[block 3]
  block 3: [exit-ordinary]
    node 5: return[v1] (a.js)
    ->[]
function inner(q)
  block 4: [entry]
    node 6: new-object[v7] (a.js:5:1)
    ->[]
"""


def test_flowgraph_text_both_ways(spark):
    dumps = spark.createDataFrame([("a", DUMP), ("b", DUMP.replace("a.js", "b.js"))], "program_id string, source string")
    nodes = files.flowgraph(dumps)
    got = {r.node_id: r for r in nodes.where("program_id = 'a'").collect()}
    assert sorted(got) == list(range(7)) and got[6].function == "function inner(q)" and got[3].successors == [2, 3]
    assert (got[2].op, got[2].operands, got[2].place) == ("constant", '"x [y] (z)",v2', "a.js:1:9") and got[3].operands is None
    lines = files.flowgraph_text(nodes).orderBy("program_id", "line_no").collect()
    assert "\n".join(r.value for r in lines if r.program_id == "a") + "\n" == DUMP


def test_flowgraph_text_of_programs(spark):
    text = "var o = {}; function one(a, b) { if (a) { return b.q; } else { o.p = a; } while (b) { b = one(a, o); } return -a; } one(o, 1); o.m(2); new one(o);"
    p, _ = programs(spark.createDataFrame([("x.js", text), ("y.js", "z(1 + 2);"), ("none.js", "")], "program_id string, source string"))
    lines = files.program_text(p).orderBy("program_id", "line_no").collect()
    dumps = {}
    for r in lines:
        dumps.setdefault(r.program_id, []).append(r.value)
    assert set(dumps) == {"x.js", "y.js", "none.js"} and [x for x in dumps["x.js"] if x[0] != " "] == ["<main> function()", "function one(a, b)"]
    again = files.flowgraph(spark.createDataFrame([(k, "\n".join(v)) for k, v in dumps.items()], "program_id string, source string"))
    got = {r.node_id: r for r in again.collect()}
    nodes = {n.node_id: n for n in p.node.collect()}
    assert set(got) == set(nodes) and all(got[i].block == n.block and got[i].place.endswith(f".js:{n.line}:{n.col}") for i, n in nodes.items())
    ends = {}
    for e in p.block_edge.collect():
        ends.setdefault(e.src, []).append(e.dst)
    assert all(sorted(r.successors) == sorted(set(ends.get(r.block, []))) for r in got.values())
    order = sorted(nodes.values(), key=lambda n: (n.block, n.idx))
    assert [n.node_id for n in order] == [r.node_id for r in sorted(got.values(), key=lambda r: (r.block, r.line_no))]
    shown = {(nodes[i].kind, r.op) for i, r in got.items()}
    assert {("Call", "call"), ("Call", "construct"), ("WriteProperty", "write-property"), ("NewObject", "new-object"), ("DeclareFunction", "function-decl")} <= shown
    method = next(r for i, r in got.items() if nodes[i].kind == "Call" and nodes[i].property == "m")
    n, args = nodes[method.node_id], [r.reg for r in p.call_arg.where(f"node_id = {method.node_id}").orderBy("position").collect()]
    assert method.operands == ",".join([f"v{n.base_reg}", "'m'", f"v{n.result_reg}" if n.result_reg >= 0 else "-", *(f"v{x}" for x in args)])
    heads = sum(x.startswith("  block ") for own in dumps.values() for x in own)
    assert heads == sum(x.startswith("    ->[") for own in dumps.values() for x in own) == len({n.block for n in nodes.values()} | {b for e in p.block_edge.collect() for b in e} | {b for f in p.function.collect() for b in (f.entry, f.exit)})


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "below").mkdir()
    for name, text in (("a.js", "f();"), ("b.txt", "no"), ("below/c.js", "g();")):
        (tmp_path / name).write_text(text)
    assert {r.source for r in files.sources(spark, str(tmp_path)).collect()} == {"f();"}
    assert {r.source for r in files.sources(spark, str(tmp_path), recursive=True).collect()} == {"f();", "g();"}
    (tmp_path / "sinks.txt").write_text("exec\n\n  eval \nexec\n")
    assert {r.name for r in files.sink_names(spark, str(tmp_path / "sinks.txt")).collect()} == {"exec", "eval"}


def test_live_sets(spark):
    """A rule sees what is there and what comes, once under a tag; the same tag on a view is another rule; sets settle through cycles."""
    low = live.LiveSet(spark.createDataFrame([(1,), (2,), (2,)], "n int"))
    high, odd, unasked = (live.LiveSet(spark.createDataFrame([], "n int")) for _ in range(3))
    calls = []
    low.on_add("up", lambda new: calls.append(new.count()) or (high, new.select((F.col("n") + 1).alias("n"))))
    low.on_add("up", lambda new: pytest.fail("a second rule under one tag"))
    view = lambda new: new.where("n % 2 = 1")
    low.map("up", view, lambda new: (odd, new))
    low.map("up", view, lambda new: pytest.fail("a second rule under one tag of one view"))
    high.on_add("back", lambda new: (low, new.where("n < 6")))
    low.on_add("out", lambda new: (unasked, new))
    assert live.settle(low, high, odd) > 3
    values = lambda s: sorted(r.n for r in s.total.collect())
    assert values(low) == [1, 2, 3, 4, 5] and values(high) == [2, 3, 4, 5, 6] and values(odd) == [1, 3, 5] and values(unasked) == [1, 2, 3, 4, 5]
    assert sum(calls) == 5 and live.status(low).first().total == 5
    low.on_add("late", lambda new: (odd, new.where("n = 2")))
    live.settle(low, odd)
    assert values(odd) == [1, 2, 3, 5]


def test_arrivals(spark, tmp_path):
    for i, n in enumerate((3, 5)):
        spark.createDataFrame([(k,) for k in range(n)], "k int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.arrivals(spark.readStream.schema("k int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), ["k"])
    query = stream.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.k for r in spark.table("arrived").collect()) == [0, 1, 2, 3, 4]


SOURCE = """function send(v) { return v; }
var secret = {};
var log = send;
log(secret);
other.write(secret);
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "one.js").write_text(SOURCE)
    (tmp_path / "src" / "broken.js").write_text("var = ;")
    return tmp_path


def test_command_line(spark, folder):
    edges = cli.main(["-d", str(folder / "src"), "-o", str(folder / "graph"), "-fg", str(folder / "nodes")], spark)
    assert edges.count() == 1
    rows = [json.loads(r.value) for r in spark.read.text(str(folder / "graph")).collect()]
    assert [(r["caller"]["start"]["line"], r["callee"]["start"]["line"]) for r in rows] == [(4, 1)]
    dump = [r.value for r in spark.read.text(str(folder / "nodes")).where("program_id like '%one.js'").select("value").collect()]
    assert dump[0] == "<main> function()" and dump[1].endswith(": [entry]") and sum(": call[" in x for x in dump) == 2 and "function send(v)" in dump
    with pytest.raises(SystemExit):
        cli.main([], spark)


def test_taint_and_batches(spark, folder):
    p, errors = programs(files.sources(spark, str(folder / "src")))
    assert errors.count() == 1
    results = experiments.run(p, shapes=((1, 1), (0, 1)))
    assert {(r["size"], r.n_queries, r.timed_out) for r in results.collect()} == {(1, 1, False), (0, 2, False)}
    experiments.write(results, str(folder / "results"))
    again = spark.read.json(str(folder / "results"))
    assert again.count() == 2 and {r.batches for r in experiments.report(results).collect()} == {1}
    assert all(r.task_ms > 0 and r.heap_mb > 0 for r in results.collect())
    sinks = spark.createDataFrame([("write",)], "name string")
    with pytest.raises(IndexError):
        experiments.taint(p, sinks, [99])
    points, _ = experiments.taint(p, sinks)
    assert points.columns == ["index", "call_id", "role", "point", "alloc"]
    assert resolve.edges(resolve.known(p)).count() == 1


def test_limit_stops_running_jobs(spark):
    begun = time.monotonic()
    with pytest.raises(TimeoutError), experiments.limited(spark, 1):
        spark.range(10**13).agg(F.sum(F.col("id") % 7)).collect()
    assert time.monotonic() - begun < 30
    before = experiments.usage(spark)[0]
    with experiments.limited(spark, 60):
        assert spark.range(10**6).agg(F.sum("id")).first()[0] == 499999500000
    with pytest.raises(ValueError), experiments.limited(spark, 60):
        raise ValueError
    time.sleep(0.5)
    task_ms, heap_mb = experiments.usage(spark)
    assert task_ms > before and heap_mb > 0


def test_small_relations(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "call_id long, callee_id long")
    assert relations.edge_count(edges).first().edges == 2
    tags = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "tag string")
    assert [tuple(r) for r in relations.tag_counts(tags, "tag").collect()] == [("c", 2), ("a", 1), ("b", 1)]
    pct = spark.createDataFrame([(0, 0), (1, 3), (2, 2)], "a int, b int").select(scans.percentage(F.col("a"), F.col("b")).alias("p"))
    assert [r.p for r in pct.collect()] == ["100.00%", "33.33%", "100.00%"]
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "src long, dst long")
    got = propagate(links, spark.createDataFrame([(4, "x"), (2, "y"), (9, "z")], "node long, label string"))
    assert sorted(map(tuple, got.collect())) == [(1, "x"), (1, "y"), (2, "x"), (2, "y"), (3, "x"), (3, "y"), (4, "x"), (9, "z")]
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)] + [(100, 101), (101, 100), (102, 100)], "node long, prev long")
    assert sorted(map(tuple, roots(chain).collect())) == [(i, 0, i) for i in range(40)]


def test_too_many_nodes(spark, monkeypatch):
    monkeypatch.setattr(tables, "SPAN", 3)
    with pytest.raises(Exception, match="more than 3 nodes"):
        tables.nodes(tables.load(spark, "/root/testdata/sf0.001", "lineitem")).agg(F.max("node_id")).collect()
