"""The automaton against bounded enumeration of configurations."""

import random

from flowtide.plans.pushdown import heads, post_star, synchronized


def test_post_star(spark):
    r = random.Random(4)
    rules, seeds, want = [], [], {}
    for s in range(12):
        own = []
        for _ in range(r.randint(3, 6)):
            kind = r.choice("NNPO")
            own.append((f"s{s}", kind, r.choice("xy"), r.choice("abc"), r.choice("xy"), "" if kind == "O" else r.choice("abc"), r.choice("abc") if kind == "P" else ""))
        rules += own
        seeds.append((f"s{s}", "x", "a", "end"))
        seen, todo = set(), [("x", "a")]
        while todo:
            p, stack = todo.pop()
            if (p, stack) in seen or len(stack) > 9:
                continue
            seen.add((p, stack))
            todo += [(p2, g2 + g3 + stack[1:]) for _, _, q, g, p2, g2, g3 in own if stack and (q, g) == (p, stack[0])]
        want[f"s{s}"] = {c for c in seen if 0 < len(c[1]) <= 3}
    rules = spark.createDataFrame(rules, "system string, kind string, p string, g string, p2 string, g2 string, g3 string")
    trans = post_star(rules, spark.createDataFrame(seeds, "system string, p string, g string, q string"))
    arcs = {}
    for t in trans.collect():
        arcs.setdefault((t.system, t.p), set()).add((t.g, t.q))

    def accepted(system, p, stack):
        states = {p}
        for g in [*stack, None]:
            grown = True
            while grown:
                more = {q for x in states for label, q in arcs.get((system, x), ()) if not label} - states
                states |= more
                grown = bool(more)
            if g is None:
                return "end" in states
            states = {q for x in states for label, q in arcs.get((system, x), ()) if label == g}

    every = [p + g for g in ("a", "b", "c") for p in ("",)]
    stacks = every + [x + y for x in every for y in every] + [x + y + z for x in every for y in every for z in every]
    for system, configurations in want.items():
        assert {(p, s) for p in "xy" for s in stacks if accepted(system, p, s)} == configurations
    got = {(h.system, h.p, h.g) for h in heads(trans, rules).collect()}
    assert {(s, p, stack[0]) for s, c in want.items() for p, stack in c} <= got


def test_synchronized(spark):
    calls = spark.createDataFrame([("s", "v", "n1", "e"), ("s", "w", "n2", "e")], "system string, p string, g string, q string")
    fields = spark.createDataFrame([("s", "n1|v", "f", "e"), ("s", "n2|v", "f", "e")], "system string, p string, g string, q string")
    assert [tuple(r) for r in synchronized(calls, fields).collect()] == [("s", "n1", "v")]
