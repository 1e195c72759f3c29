"""Random programs against plain solvers that follow one value at a time."""

import os
import random

import pytest
from pyspark.sql import functions as F

from flowtide.operators import experiments, flows, resolve
from flowtide.plans import program as tables_of
from flowtide.plans.program import Program
from flowtide.sources import tables
from flowtide.sources.javascript import Unreadable, lower
from flowtide.sources.javascript import programs as programs_of

LAST = resolve.LAST


def random_program(r: random.Random, serial: int):
    """Functions, nodes, arguments and block edges of a program of a few nested functions, each an entry, two branches that meet or loop, and an exit."""
    functions, nodes, args, edges = [], [], [], []
    base = serial * 1000
    n = r.randint(2, 4)
    ids = [base + i for i in range(n)]
    for i, f in enumerate(ids):
        names = r.sample(["x", "y", "z"], r.randint(0, 2))
        functions.append((f"p{serial}", f, None if i == 0 else f"f{i}", None if i == 0 else r.choice(ids[:i]), i == 0, r.sample(["a", "b", "x"], r.randint(0, 2)) if i else [], names, f * 10, f * 10 + 3))
        shape = r.choice([[(0, 1), (0, 2), (1, 3), (2, 3)], [(0, 1), (1, 0), (1, 3)], [(0, 3)]])
        edges += [(f * 10 + s, f * 10 + d) for s, d in shape]
    children = {f: [x[1] for x in functions if x[3] == f] for f in ids}
    name_of = {x[1]: x[2] for x in functions}
    for f in ids:
        used = sorted({b % 10 for e in edges for b in e if b // 10 == f})
        waiting = list(children[f])
        for block in used:
            for idx in range(r.randint(2, 6)):
                node = base * 100 + len(nodes)
                reg = lambda: r.randint(1, 3)
                row = dict(func_id=f, idx=idx, node_id=node, kind="Nop", result_reg=-1, base_reg=-1, value_reg=-1, func_reg=-1, name=None, property=None, is_internal=False, is_ctor=False, declares=None, line=1, col=1, block=f * 10 + block)
                kind = "DeclareFunction" if waiting else r.choice("NewObject Constant ReadVariable WriteVariable WriteVariable ReadProperty WriteProperty Call Call Call BinaryOperator UnaryOperator Nop".split())
                row["kind"] = kind
                if kind == "DeclareFunction":
                    row["declares"] = waiting.pop()
                    row["name"] = name_of[row["declares"]]
                    row["result_reg"] = reg() if r.random() < 0.6 else -1
                elif kind in ("NewObject", "Constant", "ReadVariable", "BinaryOperator", "UnaryOperator"):
                    row["result_reg"] = reg()
                if kind in ("ReadVariable", "WriteVariable"):
                    row["name"] = r.choice(["x", "y", "z", "a", "b", "nowhere", *filter(None, name_of.values())])
                if kind in ("ReadProperty", "WriteProperty"):
                    row["base_reg"], row["property"] = reg(), r.choice(["p", "q", "a|b", None])
                if kind == "ReadProperty":
                    row["result_reg"] = reg()
                if kind in ("WriteProperty", "WriteVariable"):
                    row["value_reg"] = reg()
                if kind in ("BinaryOperator", "UnaryOperator"):
                    args += [(node, i, reg()) for i in range(2 if kind == "BinaryOperator" else 1)]
                if kind == "Call":
                    row["result_reg"] = r.choice([reg(), reg(), -1])
                    row["is_internal"], row["is_ctor"] = r.random() < 0.05, r.random() < 0.15
                    if r.random() < 0.25:
                        row["base_reg"], row["property"] = reg(), r.choice(["p", "q"])
                    else:
                        row["func_reg"] = reg()
                    args += [(node, i, reg()) for i in range(r.randint(0, 2))]
                nodes.append(row)
    return functions, nodes, args, edges


class Plain:
    """The answers of all calls of one program: sets of points, facts and edges that grow until nothing is new."""

    def __init__(self, functions, nodes, args, edges, captures="exit"):
        self.captures = captures
        self.f = {x[1]: dict(zip("program func_id name outer is_main params vars entry exit".split(), x, strict=True)) for x in functions}
        self.node = {n["node_id"]: n for n in nodes}
        self.args = {}
        for node, i, reg in args:
            self.args.setdefault(node, {})[i] = f"r{reg}"
        self.preds = {}
        for s, d in edges:
            self.preds.setdefault(d, []).append(s)
        self.calls = [n for n in nodes if n["kind"] == "Call" and not n["is_internal"]]

    def declares(self, f):
        return set(self.f[f]["params"]) | set(self.f[f]["vars"])

    def visible(self, f, name):
        while f is not None and name not in self.declares(f):
            f = self.f[f]["outer"]
        return f

    def static(self, n):
        f = n["func_id"]
        while f is not None:
            inner = [x for x in self.f.values() if x["outer"] == f and x["name"] == n["name"]]
            if inner or n["name"] in self.declares(f):
                return {x["func_id"] for x in inner}
            f = self.f[f]["outer"]
        return set()

    def at(self, n, reg):
        return ("V", n["func_id"], n["block"], n["idx"], f"r{reg}")

    def alloc(self, n):
        k = n["kind"]
        return "obj" if k == "NewObject" or k == "Call" and n["is_ctor"] else "const" if k == "Constant" else "func" if k == "DeclareFunction" else None

    def key(self, n):
        if n["kind"] == "WriteVariable" or n["kind"] == "DeclareFunction" and n["result_reg"] < 0 and n["name"]:
            return f"v:{n['name']}"
        return f"r{n['result_reg']}" if n["result_reg"] > 0 and (n["kind"] != "ReadProperty" or n["property"]) else None

    def step(self, point):
        """(allocations, points) that a point takes its value from, and what it asks for."""
        if point[0] == "M":
            n = self.node[point[1]]
            return self.field(self.at(n, n["base_reg"]), n["property"])
        if point[0] == "H":
            out = set()
            for w in self.node.values():
                if w["kind"] == "WriteProperty" and w["property"] == point[1]:
                    base = self.at(w, w["base_reg"])
                    self.points.add(base)
                    if point[2] in self.facts.get(base, ()):
                        out.add(self.at(w, w["value_reg"]))
            return set(), out
        _, f, block, at, key = point
        own = [n for n in self.node.values() if n["block"] == block and n["idx"] < at and self.key(n) == key]
        if own:
            return self.source(max(own, key=lambda n: n["idx"]))
        out = {("V", f, b, LAST, key) for b in self.preds.get(block, ())}
        fun = self.f[f]
        if block == fun["entry"] and not fun["is_main"] and key.startswith("v:"):
            self.asked |= {c["node_id"] for c in self.calls}
            decl = self.visible(f, key[2:])
            if self.captures == "any" and decl is not None and decl != f:
                out.add(("V", decl, self.f[decl]["entry"], 0, key))
                out |= {("V", decl, n["block"], n["idx"] + 1, key) for n in self.node.values() if n["func_id"] == decl and self.key(n) == key}
            for c, callee in self.edges:
                if callee != f:
                    continue
                call, name = self.node[c], key[2:]
                out |= {("V", call["func_id"], call["block"], call["idx"], self.args[c][i]) for i, p in enumerate(fun["params"]) if p == name and i in self.args.get(c, {})}
                mine = self.visible(f, name)
                if name not in self.declares(f) and mine is not None and self.captures == "exit":
                    around = self.f[fun["outer"]]
                    out.add(("V", call["func_id"], call["block"], call["idx"], key) if mine == self.visible(call["func_id"], name) else ("V", around["func_id"], around["exit"], LAST, key))
        return set(), out

    def field(self, base, prop):
        self.points.add(base)
        return set(), {("H", prop, a) for a in self.facts.get(base, ()) if a[0] != "const"}

    def source(self, n):
        if self.alloc(n):
            return {(self.alloc(n), n["node_id"])}, set()
        place = ("V", n["func_id"], n["block"], n["idx"])
        if n["kind"] == "ReadVariable":
            found = {x["node_id"] for x in self.node.values() if x["declares"] in self.static(n)}
            return ({("func", x) for x in found}, set()) if self.static(n) else (set(), {(*place, f"v:{n['name']}")})
        if n["kind"] == "WriteVariable":
            return set(), {self.at(n, n["value_reg"])}
        if n["kind"] in ("BinaryOperator", "UnaryOperator"):
            return set(), {(*place, k) for k in self.args.get(n["node_id"], {}).values()}
        if n["kind"] == "ReadProperty":
            return self.field(self.at(n, n["base_reg"]), n["property"])
        if n["is_internal"]:
            return set(), set()
        c = n["node_id"]
        self.asked.add(c)
        out = {("V", f, self.f[f]["exit"], LAST, "r1") for x, f in self.edges if x == c}
        if c in self.handled:
            out |= {(*place, k) for k in self.args.get(c, {}).values()}
            if n["func_reg"] == -1 and n["property"] and n["base_reg"] >= 0:
                out.add(self.at(n, n["base_reg"]))
        return set(), out

    def solve(self):
        self.points, self.facts, self.edges, self.handled = set(), {}, set(), set()
        self.asked = {c["node_id"] for c in self.calls}
        flows_, size = {}, None
        while True:
            callee = {c: ("M", c) if n["func_reg"] == -1 else self.at(n, n["func_reg"]) for c, n in ((c, self.node[c]) for c in self.asked) if n["func_reg"] >= 0 or n["property"]}
            self.points |= set(callee.values())
            for point in list(self.points):
                allocs, more = self.step(point)
                self.facts.setdefault(point, set()).update(allocs)
                flows_.setdefault(point, set()).update(more)
                self.points |= more
            for point, more in flows_.items():
                for m in more:
                    self.facts.setdefault(point, set()).update(self.facts.get(m, ()))
            self.edges |= {(c, self.node[a[1]]["declares"]) for c, p in callee.items() for a in self.facts.get(p, ()) if a[0] == "func"}
            now = (len(self.points), sum(map(len, self.facts.values())), len(self.edges), len(self.asked), sum(map(len, flows_.values())))
            if now == size:
                open_ = {c for c in self.asked if not self.node[c]["is_ctor"]} - {c for c, _ in self.edges} - self.handled
                if not open_:
                    return self
                self.handled |= open_
            size = now


def frames(spark, programs) -> Program:
    functions, nodes, args, edges = ([x for p in programs for x in p[i]] for i in range(4))
    rows = [tuple(n[c.split()[0]] for c in tables_of.NODE.split(", ")) for n in nodes]
    edge = spark.createDataFrame(edges, "src long, dst long")
    return Program(spark.createDataFrame(functions, tables_of.FUNCTION), spark.createDataFrame(rows, tables_of.NODE), edge, spark.createDataFrame(args, tables_of.ARG), edge)


@pytest.fixture(scope="module")
def solved(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # many rounds over few rows: replanning costs more than it saves
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    r = random.Random(21)
    programs = [random_program(r, i) for i in range(14)]
    p = frames(spark, programs)
    yield p, programs, resolve.known(p)
    for k, v in before.items():
        spark.conf.set(k, v)


def test_random_programs(solved):
    p, programs, rows = solved
    plain = [Plain(*x).solve() for x in programs]
    edges = {e for s in plain for e in s.edges}
    assert {(e.call_id, e.callee_id) for e in resolve.edges(rows).collect()} == edges and len(edges) > 8
    facts = {}
    for r in resolve.points_to(rows).where("point like 'V|%'").collect():
        facts.setdefault(r.point, set()).add(r.alloc)
    want = {"|".join(map(str, point)): {f"{k}|{i}" for k, i in found} for s in plain for point, found in s.facts.items() if found and point[0] == "V"}
    assert facts == want
    assert {int(r.a) for r in rows.where("tag = 'handled'").collect()} == {c for s in plain for c in s.handled}


def test_captured_names_from_any_assignment(solved):
    p, programs, _ = solved
    got = resolve.known(p, captures="any")
    plain = [Plain(*x, captures="any").solve() for x in programs]
    assert {(e.call_id, e.callee_id) for e in resolve.edges(got).collect()} == {e for s in plain for e in s.edges}
    assert {tuple(r) for r in resolve.points_to(got).where("point like 'V|%'").collect()} == {("|".join(map(str, point)), f"{k}|{i}") for s in plain for point, found in s.facts.items() if point[0] == "V" for k, i in found}


def test_what_tells_the_capture_modes_apart(spark):
    text = "function outer() { var v = {}; function inner() { return v; } var kept = inner(); v = {}; } outer();"
    p, _ = programs_of(spark.createDataFrame([("one", text)], "program_id string, source string"))
    point = resolve.value_points(p).join(p.node.where("name = 'kept'").select("node_id"), "node_id").select("point")
    objects = [resolve.points_to(resolve.known(p, points=point, captures=c)).join(point, "point").count() for c in ("exit", "any")]
    assert objects == [1, 2]


def test_views_of_the_rows(solved):
    p, _, rows = solved
    by_call = {(r.call_id, r.callee_id) for r in resolve.edges(rows).collect()}
    assert {(r.call_id, r.func_id) for r in resolve.invocations(p, rows).collect()} == by_call
    held = {}
    for r in resolve.points_to(rows).collect():
        if not r.alloc.startswith("const"):
            held.setdefault(r.point, set()).add(r.alloc)
    some = sorted(held)[::17][:40]
    df = p.node.sparkSession.createDataFrame([(x,) for x in some], "point string")
    assert {tuple(r) for r in resolve.alias_pairs(rows, df, df).collect()} == {(a, b) for a in some for b in some if held[a] & held[b]}
    counts = {r.tag: r.n for r in resolve.status(rows).collect()}
    assert counts["edge"] == len(by_call) and counts["handled"] >= 2
    links = {tuple(r) for r in resolve.dependencies(rows).collect()}
    assert links and all(a.split("|")[0] in "VHM" or a.isdigit() for a, _ in links)



def test_callers_on_demand(solved):
    """Values asked one at a time: what is asked for them is enough, and far from all. Without strata, as these depend on what is asked when."""
    p, programs, _ = solved
    whole = resolve.known(p, strata=False)
    want = {}
    for r in resolve.points_to(whole).collect():
        want.setdefault(r.point, set()).add(r.alloc)
    edges = {(e.call_id, e.callee_id) for e in resolve.edges(whole).collect()}
    points = {r.point for r in whole.where("tag in ('flow', 'heap', 'field')").select(F.col("b").alias("point")).collect()}
    some = sorted(points)[::9]
    got_rows = resolve.known(p, points=p.node.sparkSession.createDataFrame([(x,) for x in some], "point string"), strata=False)
    got = {}
    for r in resolve.points_to(got_rows).collect():
        got.setdefault(r.point, set()).add(r.alloc)
    assert {x: got.get(x, set()) for x in some} == {x: want.get(x, set()) for x in some}
    asked = {int(r.a) for r in got_rows.where("tag = 'ask'").collect()}
    assert {(e.call_id, e.callee_id) for e in resolve.edges(got_rows).collect()} == {e for e in edges if e[0] in asked}
    entered = {int(r.b) for r in got_rows.where("tag in ('entry', 'leaves')").collect()}
    assert {c for c, f in edges if f in entered} <= asked and entered
    assert len(asked) < sum(len(Plain(*x).calls) for x in programs)


def test_calls_on_demand_with_handled_ones(solved):
    """Calls of whole programs, asked by program instead of all at once, give what all give."""
    p, programs, rows = solved
    some = [n["node_id"] for x in programs[:5] for n in x[1] if n["kind"] == "Call" and not n["is_internal"]]
    got = resolve.known(p, calls=p.node.sparkSession.createDataFrame([(c,) for c in some], "call_id long"))
    ours = lambda df: {tuple(r) for r in resolve.edges(df).where(F.col("call_id").isin(some)).collect()}
    assert ours(got) == ours(rows) and ours(got)
    handled = lambda df: {int(r.a) for r in df.where("tag = 'handled'").collect()}
    assert handled(got) == handled(rows) & set(some)


def test_unrelated_functions_are_not_asked(spark):
    """f0 to f19 each pass a new object to their own function and keep what it gets: one such value asks for one call of twenty."""
    text = "".join(f"function g{i}(a) {{ var kept{i} = a; return kept{i}; }} var h{i} = g{i}; var o{i} = {{}}; h{i}(o{i});\n" for i in range(20))
    p, errors = programs_of(spark.createDataFrame([("one", text)], "program_id string, source string"))
    assert errors.isEmpty()
    point = resolve.value_points(p).join(p.node.where("name = 'kept7'").select("node_id"), "node_id").select("point")
    got = resolve.known(p, points=point)
    assert got.where("tag = 'ask'").count() == 1 and resolve.points_to(got).join(point, "point").count() == 1
    assert got.where("tag = 'at'").count() < 12

def test_time_limit(solved):
    p, _, _ = solved
    with pytest.raises(TimeoutError):
        resolve.known(p, deadline=0.0)
    results = experiments.run(p, shapes=((1, 1),), timeout_s=-1)
    assert [(r.n_queries, r.timed_out) for r in results.collect()] == [(1, True)]


def test_lowering():
    functions, nodes, edges = lower("var o = {a: 1, 'b': [2, , 3]}; for (var k in o) { if (k) continue; o[k]++; } do { o.a += 2 } while (x ? 1 : y || z);"
                                    "switch (k) { case 1: f(); break; default: g(function (q) { return q / 2; }) } try { throw /x\\/[/]/.y } catch (e) { e.m(1)() } finally {} var h = (a, b) => a.c[b]; i => { return i };")  # fmt: skip
    assert len(functions) == 4 and [f["params"] for f in functions[1:]] == [["q"], ["a", "b"], ["i"]]
    kinds = {n["kind"] for n in nodes}
    assert {"NewObject", "NextProperty", "Catch", "Throw", "If", "WriteProperty", "BinaryOperator", "Call", "Return"} <= kinds
    blocks = {b for e in edges for b in e}
    assert all(n["block"] in blocks for n in nodes)
    for text in ("f(", "1 = 2", "#", "function (", "a.b..c"):
        with pytest.raises((Unreadable, IndexError)):
            lower(text)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="supplied tables are not here")
def test_straight_lines_against_plain_solver(spark):
    p = tables.program(spark, "/root/testdata/sf0.001")
    got = {tuple(r) for r in flows.resolve_calls(p)[0].select("call_id", "callee_id").collect()}
    nodes, params, outer = {}, {}, {}
    for n in sorted(p.node.collect(), key=lambda n: (n.func_id, n.idx)):
        nodes.setdefault(n.func_id, []).append(n)
    for f in p.function.collect():
        params[f.func_id], outer[f.func_id] = f.params, f.outer_func_id
    by_id = {n.node_id: n for own in nodes.values() for n in own}
    args = {}
    for r in p.call_arg.collect():
        args.setdefault(r.node_id, {})[r.position] = f"r{r.reg}"

    def define(n):
        if n.kind == "WriteVariable":
            return f"v:{n.name}", f"r{n.value_reg}"
        if n.result_reg >= 0 and n.kind in ("NewObject", "Constant", "DeclareFunction", "ReadVariable", "Call", "ReadProperty"):
            return f"r{n.result_reg}", f"v:{n.name}" if n.kind == "ReadVariable" else None
        return None, None

    sites = [n for n in by_id.values() if n.kind == "Call" and not n.is_internal and n.func_reg >= 0]
    edges, handled = set(), set()
    while True:
        callees, callers = {}, {}
        for c, f in edges:
            callees.setdefault(c, set()).add(f)
            callers.setdefault(f, set()).add(c)
        found, results = set(), set()
        for site in sites:
            todo, seen = [(site.func_id, site.idx, f"r{site.func_reg}")], set()
            while todo:
                at = todo.pop()
                if at in seen:
                    continue
                seen.add(at)
                func, idx, key = at
                last = next((n for n in reversed(nodes.get(func, [])) if n.idx < idx and define(n)[0] == key), None)
                if last is None:
                    if not key.startswith("v:"):
                        continue
                    spots = [i for i, x in enumerate(params.get(func, [])) if f"v:{x}" == key]
                    for c in callers.get(func, ()) if spots else ():
                        todo += [(by_id[c].func_id, by_id[c].idx, args[c][i]) for i in spots if i in args[c]]
                    if not spots and outer.get(func) is not None and nodes.get(outer[func]):
                        todo.append((outer[func], nodes[outer[func]][-1].idx + 1, key))
                elif define(last)[1] is not None:
                    todo.append((func, last.idx, define(last)[1]))
                elif last.kind == "DeclareFunction":
                    found.add((site.node_id, last.declares))
                elif last.kind in ("Call", "ReadProperty"):
                    results.add(last.node_id)
                    todo += [(f, nodes[f][-1].idx + 1, "r1") for f in callees.get(last.node_id, ()) if f in nodes]
                    if last.node_id in handled:
                        todo += [(func, last.idx, k) for k in args[last.node_id].values()]
        if not found <= edges:
            edges |= found
            continue
        resolved = {c for c, _ in edges}
        more = {c for c in results if by_id[c].kind == "Call" and not by_id[c].is_internal and c not in resolved} - handled
        if not more:
            break
        handled |= more
    assert got == edges
