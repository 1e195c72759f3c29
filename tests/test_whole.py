"""Queries over whole tables, which SQL can't say in good time, against brute force."""

import datetime
import random
import time
from types import SimpleNamespace

import pytest

from flowtide.operators import flows
from flowtide.plans import fixpoint
from flowtide.plans.fixpoint import closure_by_doubling, propagate
from flowtide.queries import QUERIES
from flowtide.sources import tables


def reach(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    pairs = set()
    for start in after:
        todo = list(after[start])
        while todo:
            at = todo.pop()
            if (start, at) not in pairs:
                pairs.add((start, at))
                todo += after.get(at, ())
    return pairs


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    r = random.Random(9)
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(seconds=r.randint(0, 90)), r.choice("abcd"), r.choice(["view", "error"])) for i in range(150)]
    folder = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame([(i, t, "abcd".index(u), e) for i, t, u, e in rows], "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{folder}/events.parquet")
    chains = {}
    for i, t, u, _ in rows:
        chains.setdefault(u, []).append((t, i))
    links = {(a, b) for c in chains.values() for (_, a), (_, b) in zip(sorted(c), sorted(c)[1:], strict=False)}
    return folder, links, {i for i, _, _, e in rows if e == "error"}


def test_whole_dependencies(spark, events):
    folder, links, errors = events
    rows = lambda name: sorted(map(tuple, QUERIES[name](spark, folder).collect()))
    pairs = reach(links)
    assert any(a % 6 == 0 for a, _ in links)
    assert rows("direct_deps") == sorted(links)
    assert rows("dep_reach") == sorted(pairs)
    assert rows("errors_impacting") == sorted({(a, f"error {b % 7}") for a, b in pairs if b in errors} | {(e, f"error {e % 7}") for e in errors})
    assert rows("demanded_queries") == sorted((x,) for x in errors | {b for a, b in pairs if a in errors})
    assert rows("dependency_dot") == sorted((f'"{a}" -> "{b}";',) for a, b in links)


def test_closure_by_doubling(spark):
    """Also with cycles, branches and repeated edges."""
    r = random.Random(10)
    for n, m in ((12, 14), (20, 60), (30, 25)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(100 + i, 101 + i) for i in range(37)]
        got = closure_by_doubling(spark.createDataFrame(edges + edges[:3], "src long, dst long"))
        assert sorted(map(tuple, got.collect())) == sorted(reach(edges))


def test_closure_of_paths_and_rings(spark, monkeypatch):
    """Paths are joined in blocks of positions, and rings beside them are whole too."""
    monkeypatch.setattr(fixpoint, "BLOCK", 4)
    edges = [(i, i + 1) for i in range(30)] + [(100, 99), (99, 50)] + [(200 + i, 200 + (i + 1) % 5) for i in range(5)] + [(300, 300), (401, 400), (400, 401)]
    got = closure_by_doubling(spark.createDataFrame(edges + edges[:3], "src long, dst long"))
    assert sorted(map(tuple, got.collect())) == sorted(reach(edges))


@pytest.mark.parametrize(("nodes", "links", "chain"), [(2000, 4000, 0), (60, 90, 300), (40, 30, 5)])
def test_labels_of_graphs(spark, nodes, links, chain):
    """Branches, cycles and long chains between them; seconds also where the pairs of nodes are many."""
    r = random.Random(nodes)
    edges = [(r.randrange(nodes), r.randrange(nodes)) for _ in range(links)] + [(10_000 + i, 10_001 + i) for i in range(chain)]
    edges += [(10_000 + chain, r.randrange(nodes)), (r.randrange(nodes), 10_000)]
    labels = [(r.randrange(nodes), f"l{i}") for i in range(2)] + [(10_000 + chain // 2, "mid")]
    want = set()
    for node, label in labels:
        before = {}
        for a, b in edges:
            before.setdefault(b, []).append(a)
        todo = [node]
        while todo:
            at = todo.pop()
            if (at, label) not in want:
                want.add((at, label))
                todo += before.get(at, ())
    began = time.monotonic()
    got = propagate(spark.createDataFrame(edges + edges[:5], "src long, dst long"), spark.createDataFrame(labels + labels[:1], "node long, label string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert time.monotonic() - began < 120


def test_whole_call_reach(spark, monkeypatch):
    """All functions are searched and no edge is dropped, whatever the ids."""
    r = random.Random(11)
    owner = {c: r.randint(1, 400) for c in range(300)}
    edges = [(c, r.randint(1, 400)) for c in owner for _ in range(r.randint(0, 2))]
    p = SimpleNamespace(node=spark.createDataFrame(list(owner.items()), "node_id long, func_id long"))
    monkeypatch.setattr(tables, "program", lambda spark, d, keep=False: p)
    monkeypatch.setattr(flows, "resolve_calls", lambda p: (spark.createDataFrame(edges, "call_id long, callee_id long"), None))
    want = sorted(reach((owner[c], f) for c, f in edges))
    assert any(a >= 200 for a, _ in want)
    assert sorted(map(tuple, QUERIES["whole_call_reach"](spark, "").collect())) == want
