"""Call and field stacks of random programs against plain rules and bounded enumeration."""

import random

import pytest
from test_resolve import Plain, frames, random_program

from flowtide.operators import stacks
from flowtide.operators.transfer import Inputs, Templates, Transfer

DEPTH = 6


class Rules(Plain):
    """The moves of one program, one fact at a time; call edges, aliases and handled calls are given."""

    def __init__(self, functions, nodes, args, edges, call_edge, alias, handled):
        super().__init__(functions, nodes, args, edges)
        self.call_edge, self.alias, self.handled = call_edge, alias, handled
        blocks = {}
        for n in sorted(nodes, key=lambda n: n["idx"]):
            blocks.setdefault(n["block"], []).append(n["node_id"])
        self.succ = {n: [] for n in self.node}
        for own in blocks.values():
            for a, b in zip(own, own[1:], strict=False):
                self.succ[a].append(b)
        for s, d in edges:
            self.succ[blocks[s][-1]].append(blocks[d][0])
        self.pred = {n: [m for m in self.node if n in self.succ[m]] for n in self.node}
        self.first = {f: blocks[x["entry"]][0] for f, x in self.f.items()}
        self.last = {f: blocks[x["exit"]][-1] for f, x in self.f.items()}

    def reg(self, n, column):
        return f"r|{n['func_id']}|{n[column]}" if n[column] >= 0 else None

    def all_args(self, n):
        return [f"r|{n['func_id']}|{k[1:]}" for _, k in sorted(self.args.get(n["node_id"], {}).items())]

    def variable(self, n):
        f = n["func_id"]
        while f is not None and n["name"] not in self.declares(f) and not any(x["outer"] == f and x["name"] == n["name"] for x in self.f.values()):
            f = self.f[f]["outer"]
        return f"v|{n['func_id'] if f is None else f}|{n['name']}"

    def key_of(self, n):
        k = self.alloc(n)
        return f"obj|{n['node_id']}|{n['result_reg']}" if k == "obj" else f"{k}|{n['node_id']}" if k else None

    def sees(self, f, fact):
        _, decl, name = fact.split("|", 2)
        return str(self.visible(f, name)) == decl

    def references(self, callee):
        """Reads of a function's name where it is declared and below, not past parameters of that name."""
        home, name, out = self.f[callee]["outer"], self.f[callee]["name"], []
        for n in self.node.values():
            if n["kind"] == "ReadVariable" and n["name"] == name and name is not None:
                f = n["func_id"]
                while f is not None and f != home and name not in self.f[f]["params"]:
                    f = self.f[f]["outer"]
                if f == home:
                    out.append(n)
        return out

    def captures(self, f):
        """Names that a function or one in it takes from outside."""
        bound = {self.f[f]["name"], *self.f[f]["vars"]}
        own = {n["name"] for n in self.node.values() if n["func_id"] == f and n["kind"] == "ReadVariable"} - bound
        return own.union(*(self.captures(x) for x, y in self.f.items() if y["outer"] == f))

    def moves(self, forward, place, fact, seed):
        n, out = self.node[place], set()
        kind, result, stored = n["kind"], self.reg(n, "result_reg"), self.reg(n, "value_reg")
        args, alloc, prop, nexts = self.all_args(n), self.key_of(n), n["property"], (self.succ if forward else self.pred)[place]
        to = lambda move, value, x="": out.update((move, place, fact, m, value, x) for m in nexts)
        home, is_object = self.f[n["func_id"]], fact.startswith("obj|")
        sites = [self.node[c] for c, f in self.call_edge if f == n["func_id"]]
        funcvar = f"v|{n['func_id']}|{self.f[n['declares']]['name']}" if n["declares"] is not None and self.f[n["declares"]]["name"] else None
        if forward:
            if kind in ("BinaryOperator", "UnaryOperator"):
                if fact not in args:
                    to("N", fact)
            elif kind == "Constant":
                to("N", fact)
                if fact == alloc and result:
                    to("N", result)
            elif kind == "DeclareFunction":
                if result and fact == alloc:
                    to("N", result)
                elif result and fact != result:
                    to("N", fact)
                if funcvar and fact == alloc:
                    for r in self.references(n["declares"]):
                        out.update(("N", place, fact, m, self.reg(r, "result_reg"), "") for m in self.succ[r["node_id"]])
                elif funcvar and fact != funcvar:
                    to("N", fact)
            elif kind == "ReadProperty" and prop is not None:
                if fact != result:
                    to("N", fact)
                if is_object and (place, fact) in self.alias:
                    to("FO", result, prop)
            elif kind == "ReadVariable":
                if fact != result:
                    to("N", fact)
                if fact == self.variable(n):
                    to("N", result)
            elif kind == "WriteVariable":
                if fact != self.variable(n):
                    to("N", fact)
                if fact == stored or is_object and int(fact.split("|")[-1]) == n["value_reg"]:
                    to("N", self.variable(n))
                    if fact != self.variable(n):
                        self.closures(out, n["func_id"], n["name"], seed)
            elif kind == "Return":
                if not home["is_main"] and not (fact.startswith(f"r|{n['func_id']}|") and fact != stored):
                    for s in sites:
                        back = self.reg(s, "result_reg")
                        if fact == stored and back:
                            out.add(("O", place, fact, s["node_id"], back, ""))
                        values = {a for a, name in zip(self.all_args(s), home["params"], strict=False) if fact == f"v|{n['func_id']}|{name}"}
                        if fact.startswith("v|") and self.sees(s["func_id"], fact) or fact.split("|")[0] in ("obj", "const", "func"):
                            values.add(fact)
                        out.update(("N", place, fact, m, v, "") for m in self.succ[s["node_id"]] for v in values)
            else:
                to("N", fact)
            if kind == "Constant" and place == self.first[n["func_id"]] and fact.startswith(f"v|{n['func_id']}|"):
                self.closures(out, n["func_id"], fact.split("|", 2)[2], seed)
            if kind == "WriteProperty" and prop is not None and fact == stored:
                for p, a in self.alias:
                    if p == place:
                        to("FP", a, prop)
            if kind == "Call" and not n["is_internal"]:
                for c, callee in self.call_edge:
                    if c == place and (is_object or fact.startswith("v|") and self.sees(callee, fact)):
                        out.add(("P", place, fact, self.first[callee], fact, str(place)))
                    elif c == place:
                        out.update(("P", place, fact, self.first[callee], f"v|{callee}|{name}", str(place)) for a, name in zip(args, self.f[callee]["params"], strict=False) if a == fact)
                if place in self.handled and fact in args and result and n["result_reg"] != 1:
                    to("N", result)
            return out
        values = {fact}
        if kind in ("BinaryOperator", "UnaryOperator") and fact == result:
            values = set(args)
        elif kind in ("Constant", "NewObject") or kind == "ReadProperty" and prop is not None or kind == "DeclareFunction" and result:
            values -= {result}
        elif kind == "Call":
            values = set() if fact == result or fact.startswith("mcall|") else values
        elif kind == "DeclareFunction":
            values -= {funcvar}
        elif kind == "ReadVariable" and fact == result:
            values = set() if self.static(n) else {self.variable(n)}
        elif kind == "WriteVariable" and fact == self.variable(n):
            values = {stored}
        for v in values:
            to("N", v)
        held = [a for p, a in self.alias if p == place]
        method = kind == "Call" and n["func_reg"] < 0 and prop is not None and n["base_reg"] >= 0
        if kind == "Call":
            if not n["is_internal"] and (is_object or fact == result and not (n["is_ctor"] and n["result_reg"] != 1)):
                out.update(("P", place, fact, self.last[f], fact if is_object else f"r|{f}|1", str(place)) for c, f in self.call_edge if c == place)
            if place in self.handled and fact == result:
                for v in {*args, *([self.reg(n, "base_reg")] if method else [])}:
                    to("N", v)
            if fact == f"mcall|{place}":
                out.add(("N", place, fact, place, f"s|{place}", ""))
            if method and fact == f"s|{place}":
                for a in held:
                    to("FP", a, prop)
        if kind == "ReadProperty" and prop is not None and fact == result:
            for a in held:
                to("FP", a, prop)
        if kind == "WriteProperty" and prop is not None and is_object and fact in held:
            to("FO", stored, prop)
        if place == self.first[n["func_id"]] and not home["is_main"]:
            for v in values:
                for s in sites:
                    if v.startswith("v|") and v in (own := [f"v|{n['func_id']}|{x}" for x in home["params"]]):
                        if own.index(v) < len(self.all_args(s)):
                            out.add(("N", place, fact, s["node_id"], self.all_args(s)[own.index(v)], ""))
                    elif v.startswith("v|") or v.startswith("obj|"):
                        seen = v.startswith("v|") and self.sees(s["func_id"], v)
                        if seen or v.startswith("obj|"):
                            out.add(("O", place, fact, s["node_id"], v, ""))
                        if not seen:
                            out.add(("N", place, fact, self.last[home["outer"]], v, ""))
        return out

    def closures(self, out, f, name, seed):
        for x, y in self.f.items():
            if y["outer"] == f and name in self.captures(x):
                for c, callee in self.call_edge:
                    if callee == x:
                        v = f"v|{f}|{name}"
                        out |= {("N", *seed, c, v, ""), ("N", c, v, self.first[x], v, "")}

    def reach(self, forward, place, fact, depth=DEPTH):
        """(facts that both machines reach, those with an empty field stack, moves), with stacks of `depth` at most."""
        reached, moves, derived = set(), set(), set()
        while True:
            by = {}
            for m in moves:
                by.setdefault(m[1:3], []).append(m)
            todo, calls = [(fact, (place,))], set()
            while todo:
                at = todo.pop()
                if at in calls or len(at[1]) > depth:
                    continue
                calls.add(at)
                value, (top, *rest) = at
                for kind, _, _, p2, f2, x in by.get((top, value), ()):
                    if kind == "P":
                        todo.append((f2, (p2, int(x), *rest)))
                    elif kind == "O":
                        todo.append((f2, tuple(rest) if rest else (p2,)))
                    else:
                        todo.append((f2, (p2, *rest)))
            todo, fields = [(place, fact, ())], set()
            while todo:
                at = todo.pop()
                if at in fields or len(at[2]) > depth:
                    continue
                fields.add(at)
                for kind, _, _, p2, f2, x in by.get(at[:2], ()):
                    if kind == "FP":
                        todo.append((p2, f2, (x, *at[2])))
                    elif kind != "FO":
                        todo.append((p2, f2, at[2]))
                    elif at[2] and at[2][0] == x:
                        todo.append((p2, f2, at[2][1:]))
            both = {(s[0], v) for v, s in calls} & {x[:2] for x in fields}
            if both <= reached:
                return reached, {x[:2] for x in fields if not x[2]} & both, moves
            reached |= both
            for x in reached - derived:
                moves |= self.moves(forward, *x, (place, fact))
            derived |= reached


def program(r, serial):
    """A random program with returns, and call edges, aliases and handled calls, as if they had been found."""
    functions, nodes, args, edges = random_program(r, serial)
    for f in functions:
        own = [n for n in nodes if n["block"] == f[8]]
        last = max(own, key=lambda n: n["idx"])
        nodes.append({**last, "idx": last["idx"] + 1, "node_id": serial * 100_000 + 50_000 + f[1] % 1000, "kind": "Return", "result_reg": -1, "base_reg": -1, "func_reg": -1, "value_reg": 1, "name": None, "property": None, "is_internal": False, "is_ctor": False, "declares": None})
    calls = [n for n in nodes if n["kind"] == "Call" and not n["is_internal"]]
    inner = [f[1] for f in functions if not f[4]]
    call_edge = {(c["node_id"], r.choice(inner)) for c in calls for _ in range(r.randint(0, 1))}
    plain = Rules(functions, nodes, args, edges, call_edge, set(), set())
    made = [plain.key_of(n) for n in nodes if plain.key_of(n) and not plain.key_of(n).startswith("const")]
    alias = {(n["node_id"], r.choice(made)) for n in nodes if n["kind"] in ("ReadProperty", "WriteProperty") or n["kind"] == "Call" and n["property"] for _ in range(2) if made}
    handled = {c["node_id"] for c in calls if not any(x == c["node_id"] for x, _ in call_edge)}
    plain.alias, plain.handled = alias, handled
    return (functions, nodes, args, edges), plain


def questions(r, plain):
    made = [(n["node_id"], plain.key_of(n)) for n in plain.node.values() if plain.key_of(n)]
    uses = [(n["node_id"], plain.reg(n, c)) for n in plain.node.values() for c in ("value_reg", "func_reg", "base_reg") if n[c] >= 0]
    uses += [(n["node_id"], f"mcall|{n['node_id']}") for n in plain.node.values() if n["kind"] == "Call" and n["property"]]
    return [(True, *x) for x in r.sample(made, min(3, len(made)))] + [(False, *x) for x in r.sample(uses, min(4, len(uses)))]


@pytest.fixture(scope="module")
def quick(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_one_step_of_every_fact(quick):
    """Rules derived from node tables equal those of the plain generator, for every place and many values."""
    r = random.Random(4)
    made = [program(r, i) for i in range(30)]
    p = frames(quick, [x for x, _ in made])
    facts, want = [], set()
    for _, plain in made:
        values = {v for n in plain.node.values() for v in (plain.key_of(n), plain.reg(n, "result_reg"), plain.reg(n, "value_reg"), *plain.all_args(n), plain.variable(n) if n["kind"] in ("ReadVariable", "WriteVariable") else None) if v}
        values |= {f"v|{f}|{x}" for f, y in plain.f.items() for x in y["params"]} | {f"{k}|{n['node_id']}" for n in plain.node.values() if n["kind"] == "Call" for k in ("mcall", "s")}
        for place in plain.node:
            for v in r.sample(sorted(values), min(12, len(values))):
                for forward in (True, False):
                    system = f"{forward}{place}{v}"
                    facts.append((system, forward, place, v))
                    want |= {(system, *m) for m in plain.moves(forward, place, v, (place, v))}
    given = quick.createDataFrame(facts, "system string, forward boolean, place long, fact string")
    transfer, told = Transfer(p), inputs(quick, made)
    assert {tuple(x) for x in transfer.moves(given, told, given).collect()} == want
    assert {tuple(x) for x in Templates(transfer, told).moves(given, given).collect()} == want
    assert {x[1] for x in want} == {"N", "P", "O", "FP", "FO"}


def inputs(spark, made):
    every = lambda name, of=lambda x: x: [of(x) for _, plain in made for x in getattr(plain, name)]
    return Inputs(
        spark.createDataFrame(every("call_edge"), "call long, callee long"), spark.createDataFrame(every("alias"), "place long, alloc string"), spark.createDataFrame(every("handled", lambda x: (x,)), "call long")
    )


def test_saturation_against_enumeration(quick):
    r = random.Random(8)
    made = [program(r, i) for i in range(5)]
    asked = [(plain, q) for _, plain in made for q in questions(r, plain)]
    solved = stacks.solve(Transfer(frames(quick, [x for x, _ in made])), quick.createDataFrame([q for _, q in asked], "forward boolean, place long, fact string"), inputs(quick, made))
    got, plain_got = {}, {}
    for df, out in ((solved.reached, got), (solved.plain(), plain_got)):
        for x in df.collect():
            out.setdefault(x.system, set()).add((x.place, x.fact))
    deep = balanced = 0
    for plain, (forward, place, fact) in asked:
        reached, whole, moves = plain.reach(forward, place, fact)
        system = f"{'f' if forward else 'b'}~{place}~{fact}"
        assert got[system] == reached and plain_got[system] == whole
        deep += len(reached) > len(whole)
        balanced += any(m[0] == "O" for m in moves)
    assert deep and balanced
    assert [x["round"] for x in solved.rounds] == list(range(1, len(solved.rounds) + 1)) and sum(x["facts"] for x in solved.rounds) == sum(map(len, got.values()))


def test_calls_keep_their_context(quick):
    """A query inside a function goes on at both of its callers; one through a call comes out at that call alone."""
    blank = dict(result_reg=-1, base_reg=-1, value_reg=-1, func_reg=-1, name=None, property=None, is_internal=False, is_ctor=False, declares=None, line=1, col=1)
    body = [
        (0, dict(kind="DeclareFunction", declares=1, result_reg=3)), (0, dict(kind="NewObject", result_reg=1)), (0, dict(kind="WriteVariable", name="x", value_reg=1)), (0, dict(kind="Call", func_reg=3, result_reg=4)),
        (0, dict(kind="Constant", result_reg=2)), (0, dict(kind="WriteVariable", name="x", value_reg=2)), (0, dict(kind="Call", func_reg=3, result_reg=5)), (0, dict(kind="Nop")),
        (1, dict(kind="Nop")), (1, dict(kind="ReadVariable", name="x", result_reg=1)), (1, dict(kind="Return", value_reg=1)),
    ]
    nodes = [{**blank, **own, "func_id": f, "idx": i, "node_id": i, "block": f} for i, (f, own) in enumerate(body)]
    functions = [("p", 0, None, None, True, [], ["x"], 0, 0), ("p", 1, None, 0, False, [], [], 1, 1)]
    whole = (functions, nodes, [], [(0, 0)])
    plain = Rules(*whole, {(3, 1), (6, 1)}, set(), set())
    plain.succ[7], plain.pred[0] = [], []
    p = frames(quick, [whole])
    p.block_edge = p.cfg_edge = p.block_edge.where("false")
    asked = [(False, 10, "r|1|1"), (False, 7, "r|0|4"), (False, 7, "r|0|5")]
    transfer = Transfer(p)
    solved = stacks.solve(transfer, quick.createDataFrame(asked, "forward boolean, place long, fact string"), inputs(quick, [(whole, plain)]))
    got = {}
    for x in solved.reached.collect():
        got.setdefault(x.system, set()).add((x.place, x.fact))
    for forward, place, fact in asked:
        assert got[f"b~{place}~{fact}"] == plain.reach(forward, place, fact)[0]
    answers = {}
    for x in transfer.answers(solved.plain()).collect():
        answers.setdefault(x.system, set()).add(x.alloc)
    assert answers == {"b~10~r|1|1": {"obj|1|1", "const|4"}, "b~7~r|0|4": {"obj|1|1"}, "b~7~r|0|5": {"const|4"}}
