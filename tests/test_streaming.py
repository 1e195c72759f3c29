"""Live sets over streams, stopped and started again; figures of rounds."""

import datetime

import pytest

from flowtide.operators import experiments, resolve
from flowtide.plans.figures import Rounds, measured
from flowtide.plans.fixpoint import fixpoint, lacking, near, scratch, stored, tiered
from flowtide.queries import _SCOPES, QUERIES, _scope_rules
from flowtide.sources.javascript import programs
from flowtide.streaming import live

SCHEMAS = {"link": "src long, dst long", "path": "src long, dst long", "seen": "n long"}
#: A path, a cycle and links that repeat, in the order in which they come.
LINKS = [[(1, 2), (2, 3)], [(3, 4), (1, 2)], [(7, 8)], [(8, 9), (9, 7)], [(4, 5)], [(0, 1), (2, 3)], [(5, 7)], [(20, 21)], [(21, None)]]


def paths(links):
    out = set(links)
    while more := {(a, d) for a, b in out for c, d in links if b == c and b is not None} - out:
        out |= more
    return out


def rules(sets, told=None, late=False, fail=False):
    def first(new):
        if told is not None:
            told.extend(map(tuple, new.collect()))
        if fail:
            raise RuntimeError("stopped")
        return sets["path"], new

    joined = lambda a, b: a.join(b.selectExpr("src as dst", "dst as end"), "dst").selectExpr("src", "end as dst")
    sets["link"].on_add("first", first)
    sets["path"].on_add("further", lambda new: (sets["path"], joined(new, sets["link"].total)))
    sets["link"].on_add("before", lambda new: (sets["path"], joined(sets["path"].total, new)))
    if late:
        sets["path"].map("ends", lambda new: new.selectExpr("dst as n"), lambda new: (sets["seen"], new), view="dst")


def run(spark, tmp_path, settling, most=None):
    stream = spark.readStream.schema(SCHEMAS["link"]).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(settling).option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(300)
    finally:
        query.stop()


def add(spark, tmp_path, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMAS["link"]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_stream_settles_and_is_found_again(spark, tmp_path):
    """A stream that fails within a batch and is started again gives what one run over all rows gives; rules see rows once in what counts."""
    told = []
    make = lambda **k: live.Settling(str(tmp_path / "state"), SCHEMAS, lambda b: {"link": b}, lambda sets: rules(sets, told, **k))
    rows = lambda name: {tuple(r) for r in make().totals(spark)[name].collect()}
    assert rows("path") == set()
    add(spark, tmp_path, LINKS[:3])
    run(spark, tmp_path, make())
    assert rows("link") == {x for b in LINKS[:3] for x in b} and rows("path") == paths(rows("link"))
    add(spark, tmp_path, LINKS[3:4])
    with pytest.raises(Exception, match="stopped"):
        run(spark, tmp_path, make(fail=True))
    assert len(told) == 6 and rows("link") == {x for b in LINKS[:3] for x in b}
    del told[-2:]
    add(spark, tmp_path, LINKS[4:])
    run(spark, tmp_path, make(late=True))
    every = {x for b in LINKS for x in b}
    assert rows("link") == every and rows("path") == paths(every)
    assert sorted(told, key=str) == sorted(every, key=str)
    assert rows("seen") == {(b,) for _, b in paths(every)}
    totals = make().totals(spark)
    assert all(df.count() == df.distinct().count() for df in totals.values())
    assert len(list((tmp_path / "state" / "commits").iterdir())) == 2
    last = max(spark.read.schema(live.COMMIT).option("recursiveFileLookup", "true").parquet(str(tmp_path / "state" / "commits")).collect(), key=lambda r: r.batch)
    assert last.batch == 8 and [(r.first, r.last) for r in last.runs["link"]] == [(0, 7), (8, 8)]
    figures = make().rounds(spark)
    assert {r.batch for r in figures.select("batch").distinct().collect()} == set(range(9))
    assert figures.where("batch = 0").agg({"found": "sum"}).first()[0] == len(paths(LINKS[0])) and figures.where("round = 1 and batch < 8").where("asked = 0").count() == 0
    # A batch that counts is passed over when it is given again.
    make()(spark.createDataFrame([(90, 91)], SCHEMAS["link"]), 8)
    assert (90, 91) not in rows("link")
    with pytest.raises(ValueError, match="no name"):
        bad = lambda sets: sets["link"].map("x", lambda new: new, lambda new: (sets["path"], new))
        live.Settling(str(tmp_path / "other"), SCHEMAS, lambda b: {"link": b}, bad)(spark.createDataFrame([(1, 2)], SCHEMAS["link"]), 0)


def test_empty_batches_and_nulls(spark, tmp_path):
    settling = live.Settling(str(tmp_path), SCHEMAS, lambda b: {"link": b}, rules)
    settling(spark.createDataFrame([], SCHEMAS["link"]), 0)
    settling(spark.createDataFrame([(None, None), (None, None), (1, None)], SCHEMAS["link"]), 1)
    settling(spark.createDataFrame([(None, None)], SCHEMAS["link"]), 2)
    for name in ("link", "path"):
        assert sorted(map(tuple, settling.totals(spark)[name].collect()), key=str) == [(1, None), (None, None)]


def test_scope_chain_of_a_stream(spark, tmp_path):
    orders = [(k, datetime.date(2024, 1, 1)) for k in (0, 1, 5, 7, 43, 44, 300, 301)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate date").write.parquet(str(tmp_path / "orders.parquet"))
    expected = set()
    keys = {k for k, _ in orders}
    for k in keys:
        at = k
        while True:
            expected.add((k, at))
            if at == 0 or at not in keys:
                break
            at //= 6
    got = QUERIES["stream_scope_chain"](spark, str(tmp_path)).collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_scopes_that_come_in_any_order(spark, tmp_path):
    """Functions in several batches, outer ones before and after inner ones, with repeats, nulls and outer ones that are no functions."""
    batches = [[43, 301, 7], [0, 301, -4, None], [1, 50, 50], [300, 8, None, 10830], [], [1805, 44, 100000]]
    outer = lambda k: k // 6 if k is not None and k > 0 else None
    settling = live.Settling(str(tmp_path), _SCOPES, lambda b: {"func": b}, _scope_rules)
    keys, want = set(), set()
    for i, batch in enumerate(batches):
        settling(spark.createDataFrame([(k, outer(k)) for k in batch], _SCOPES["func"]), i)
        keys |= set(batch)
        want = {(k, k, 0) for k in keys}
        while more := {(k, outer(at), n + 1) for k, at, n in want if at in keys and outer(at) is not None} - want:
            want |= more
        got = settling.totals(spark)["up"].select("func_id", "anc_id", "depth").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert (10830, 0, 6) in want and (100000, 16666, 1) in want and (100000, 2777, 2) not in want


def test_rounds_leave_what_they_cannot_find_again(spark, monkeypatch):
    """Rows of other levels than those found are not shuffled: a round costs what it finds, not what is known. Nothing is written twice."""
    levels, width, written = 12, 40, []
    monkeypatch.setattr(live, "lacking", lambda found, known: written.append(1) or lacking(found, known))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        with scratch(spark.range(1)):
            s, log = live.LiveSet(spark.range(width).selectExpr("id", "0 as level")), Rounds(spark)
            s.on_add("next", lambda new: (s, new.where(f"level < {levels}").selectExpr("id", "level + 1 as level")))
            live.settle(s, log=log)
            rows = log.table().collect()
            assert sum(r.found for r in rows) == levels * width and s.total.distinct().count() == s.total.count() == (levels + 1) * width
            # distinct's rows, and one row a task where rows are counted
            assert all(r.rows_shuffled < 2 * width for r in rows), [r.rows_shuffled for r in rows]
            assert not written and len(s.parts) == levels + 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_near(spark):
    known = stored(spark.createDataFrame([(1, "x"), (4, "x"), (None, "y"), (9, "z")], "`a.b` int, c string"))
    rows = lambda *found: (lambda n, df: (n, sorted(map(tuple, df.collect()), key=str)))(*near(spark.createDataFrame(list(found), known.schema), known))
    assert rows((2, "x"), (5, "z")) == (2, [(4, "x")]) and rows((5, "x")) == (1, []) and rows() == (0, [])
    assert rows((None, "x")) == (1, [(None, "y")]) and rows((None, "x"), (9, "q")) == (2, [(9, "z"), (None, "y")])
    assert near(spark.createDataFrame([("x",)], "c string"), known.select("c"))[1].count() == 4


def test_tiered(spark):
    """No table is rewritten while they are few; of many, they stay few and rows are rewritten seldom."""
    parts, writes, most = [], 0, 0
    with scratch(spark.range(1)):
        for i in range(60):
            before = parts
            parts = tiered([*parts, (spark.range(i, i + 1), 1)], most=4)
            writes += 0 if len(parts) > len(before) else parts[-1][1]
            most = max(most, len(parts))
            assert len(parts) == i + 1 or i >= 4
        assert most <= 12 and writes < 5 * 60 and sum(n for _, n in parts) == 60
        assert sorted(r.id for df, _ in parts for r in df.collect()) == list(range(60))


def test_lacking(spark):
    a = stored(spark.createDataFrame([(1, "x"), (None, "x"), (None, None), (2, None)], "`a.b` int, c string"))
    b = spark.createDataFrame([(None, "x"), (2, "y"), (None, None), (5, "z")], "`a.b` int, c string")
    assert sorted(map(tuple, lacking(a, b).collect())) == [(1, "x"), (2, None)]
    assert lacking(a, b.where("false")).count() == 4 and lacking(stored(a.where("false")), b).count() == 0


def test_scratch_goes(spark, tmp_path):
    with scratch(spark.range(1)):
        df = stored(spark.range(5))
        folder = df.inputFiles()[0].rsplit("/", 1)[0]
        assert df.count() == 5 and spark.read.parquet(folder).count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)


def test_figures_of_a_fixpoint(spark):
    """A chain of four links: each round derives what one more step gives."""
    links = stored(spark.createDataFrame([(i, i + 1) for i in range(4)] + [(0, 2)], "src long, dst long"))
    log = Rounds(spark)
    step = lambda new, _: new.join(links.selectExpr("src as dst", "dst as end"), "dst").selectExpr("src", "end as dst")
    assert fixpoint(links, step, log=log).count() == 10
    rows = log.table().collect()
    # by length: 0-1-2, 1-2-3, 2-3-4, 0-2-3 (found: 1-3, 2-4, 0-3); then 0-1-3, 1-3-4 ... until nothing is new
    assert [r["round"] for r in rows] == list(range(1, len(rows) + 1)) and sum(r.found for r in rows) == 5
    assert rows[0].derived == 4 and rows[0].found == 3 and rows[-1].found == 0
    assert all(r.wall_ms > 0 and r.task_ms > 0 and r.rows_shuffled > 0 for r in rows) and sum(r.cpu_ms for r in rows) > 0


def test_measured_is_of_this_work_alone(spark):
    with measured(spark) as outer:
        spark.range(1000).groupBy("id").count().count()
        with measured(spark) as inner:
            spark.range(1000, numPartitions=2).repartition(3).count()
    assert inner["rows_shuffled"] >= 1000 and outer["rows_shuffled"] > inner["rows_shuffled"] and outer["wall_ms"] >= inner["wall_ms"]
    with measured(spark) as nothing:
        pass
    assert nothing["task_ms"] == nothing["rows_read"] == 0


SOURCES = [("a", "function f(x) { return x; } var g = f; g(1); g(2); h(3);"), ("b", "var o = {}; o.m();"), ("c", "var k = 1;")]


def test_figures_of_the_resolver_and_reports(spark):
    p, _ = programs(spark.createDataFrame(SOURCES, "program_id string, source string"))
    log, shared = Rounds(spark), resolve.Rules(p, "exit")
    rows = resolve.known(p, log=log, rules=shared)
    counts = {r.tag: r.n for r in resolve.status(rows).collect()}
    total = log.table().agg({"asked": "sum", "found": "sum", "handled": "sum"}).first().asDict()
    seeds = 4
    assert total["sum(asked)"] + seeds == sum(counts.get(t, 0) for t in resolve.QUESTIONS)
    assert total["sum(handled)"] == counts["handled"] == 2
    assert total["sum(found)"] == sum(n for t, n in counts.items() if t not in (*resolve.QUESTIONS, "handled"))
    with pytest.raises(ValueError):
        resolve.known(p, rules=shared, captures="any")
    calls = p.node.where("kind = 'Call'").selectExpr("node_id as call_id")
    each = experiments.by_program(p, calls.union(calls), resolve.edges(rows))
    assert sorted(map(tuple, each.collect())) == [("a", 3, 2), ("b", 1, 0), ("c", 0, 0)]
    assert experiments.program_report(each, 100).first().asDict() == {"programs": 3, "queries": 4, "queries_per_program": 1, "most_queries": 3, "edges": 2, "elapsed_ms": 100, "ms_per_program": 33, "ms_per_query": 25}
    none = experiments.program_report(each.where("false"), 0).first()
    assert none.programs == none.queries == 0 and none.ms_per_query is None
