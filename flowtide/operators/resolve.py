"""Points-to facts and call edges on demand, over branches, objects, closures and unresolved calls.

What is asked for are points: the value of a register or variable at a place of
a block (`V|function|block|idx|key`), the property of an allocation
(`H|property|allocation`), or the function a method call finds (`M|call`). One
relation of tagged rows holds all that is known; a round joins what the last round
added with it and adds what is new, for all queries and programs at once:

    point a            a is asked for            flow a b      a takes its value from point b
    pts a b            allocation b reaches a    edge a b      call a invokes function b
    ask a              call a's callees are      at a b        function a's value may be at place b
    leaves a b         a may leave function b    gives a b c   a may be argument c of call b (-1: its base)
    calls a b          a is the result of call b entry a b c   a is key c at the entry of function b
    field a b c        a is property c of b      heap a b c    property a takes c if base b holds its object
    callee a b         call a's function is b    handled a     call a has no callee: arguments reach its result

Variables are followed backwards with strong updates, block by block; object
fields are kept apart by allocation and name and updated weakly; parameters take
the arguments of every call of their function. A name from outside is looked up
where the function is called, if it is the same variable there, else at the end of the
function around (`captures="exit"`, what a call site sees), or at every assignment
("any", where a function's value can get to).

Callers are asked for as they are needed. A function whose entry is reached is followed forwards
from its declaration, over places without order (`R|function|register`, `N|function|variable`,
`P|program|property`); a call whose callee may come from such a place is asked. `leaves` and `gives`
wait for edges: a value goes on at the calls of the function that it leaves, and at the parameters
of the functions that a call passes it to. Places only choose what is asked, edges
are found by the exact rules. Where every call is asked from the start, nothing is followed.
"""

from __future__ import annotations

import functools
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import figures
from ..plans.fixpoint import merged, stored
from ..plans.program import Program
from . import names

#: A place behind every node of a block.
LAST = 1 << 40
ROW = ["tag", "a", "b", "c"]
#: Tags of rows that ask for something; the others tell something.
QUESTIONS = ("point", "ask", "at", "leaves", "gives")


def _text(*parts) -> Column:
    return F.concat_ws("|", *(F.lit(p) if isinstance(p, str) and p in ("V", "H", "M") else p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts))


def _at(key: Column, func="func_id", block="block", idx="idx") -> Column:
    return _text("V", func, block, idx, key)


def _register(column: str) -> Column:
    return F.concat(F.lit("r"), F.col(column).cast("string"))


def _property(column: str) -> Column:
    return F.url_encode(column)


def _row(tag: str, a, b="", c="") -> list[Column]:
    col = lambda x: x.cast("string") if isinstance(x, Column) else F.col(x).cast("string") if x else F.lit("")
    return [F.lit(tag).alias("tag"), col(a).alias("a"), col(b).alias("b"), col(c).alias("c")]


def _union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.union, frames)


class Rules:
    """The tables that the rules look things up in, each made once."""

    def __init__(self, p: Program, captures: str):
        if captures not in ("exit", "any"):
            raise ValueError(captures)
        n, self.captures, self.program = p.node, captures, p
        up = names.ancestors(p)
        static = names.static_references(p, up)
        owner = p.function.select("func_id", "program_id")
        declared = n.where("declares is not null").select("node_id", F.col("declares").alias("callee_id"))
        place = F.struct("func_id", "block", "idx")
        variable = F.concat(F.lit("v:"), F.col("name"))
        results = n.where("result_reg > 0 and kind <> 'ReadProperty' or result_reg > 0 and property is not null").select("block", _register("result_reg").alias("key"), "idx", "node_id")
        written = n.where("kind = 'WriteVariable' or kind = 'DeclareFunction' and result_reg < 0 and name is not null").select("block", variable.alias("key"), "idx", "node_id")
        self.defs = stored(results.union(written))  # the last one in a block counts
        operand = p.call_arg.join(n.select("node_id", "func_id", "block", "idx", "kind"), "node_id")
        self.assigned = stored(written.join(n.select("node_id", "func_id"), "node_id").select("func_id", "block", "idx", "key")) if captures == "any" else None
        self.args = stored(operand.where("kind = 'Call'").select(F.col("node_id").cast("string").alias("call"), "position", _at(_register("reg")).alias("value")))
        allocation = F.when(F.col("kind") == "NewObject", "obj").when(F.col("kind") == "Constant", "const").when(F.col("kind") == "DeclareFunction", "func").when((F.col("kind") == "Call") & F.col("is_ctor"), "obj")
        by_name = n.where("kind = 'ReadVariable'").join(static.select("node_id").distinct(), "node_id", "left_anti")
        of_static = static.join(declared.withColumnRenamed("node_id", "decl"), "callee_id").select("node_id", F.lit("pts").alias("tag"), _text(F.lit("func"), "decl").alias("b"), F.lit("").alias("c"))
        flow = lambda df, point: df.select("node_id", F.lit("flow").alias("tag"), point.alias("b"), F.lit("").alias("c"))
        #: What a definition's value is.
        self.source = stored(_union([
            n.where(allocation.isNotNull()).select("node_id", F.lit("pts").alias("tag"), _text(allocation, "node_id").alias("b"), F.lit("").alias("c")),
            of_static,
            flow(by_name, _at(variable)),
            flow(n.where("kind = 'WriteVariable'"), _at(_register("value_reg"))),
            flow(operand.where("kind in ('BinaryOperator', 'UnaryOperator')"), _at(_register("reg"))),
            n.where("kind = 'Call' and not is_ctor and not is_internal").select("node_id", F.lit("calls").alias("tag"), F.col("node_id").cast("string").alias("b"), F.lit("").alias("c")),
            n.where("kind = 'ReadProperty' and property is not null").select("node_id", F.lit("field").alias("tag"), _at(_register("base_reg")).alias("b"), _property("property").alias("c")),
        ]))
        self.before = stored(p.block_edge.select(F.col("dst").alias("block"), F.col("src").alias("pred")))
        self.functions = stored(p.function.select("func_id", "entry", "exit", "outer_func_id", "is_main"))
        self.bound = stored(p.function.select("func_id", F.posexplode("params").alias("position", "name")).select("func_id", "position", F.concat(F.lit("v:"), "name").alias("key")))
        self.own = stored(names.declarations(p).select("func_id", F.concat(F.lit("v:"), "name").alias("key")))
        self.scope = stored(names.visible(p, up).select("func_id", F.concat(F.lit("v:"), "name").alias("key"), "decl_id"))
        external = n.where("kind = 'Call' and not is_internal").join(owner, "func_id")
        self.calls = stored(external.select(F.col("node_id").cast("string").alias("call"), "program_id", F.col("func_id").alias("at_func"), F.col("block").alias("at_block"), F.col("idx").alias("at_idx")))
        method = external.where("func_reg = -1 and property is not null")
        self.callee = stored(
            external.where("func_reg >= 0").select(F.col("node_id").cast("string").alias("call"), _at(_register("func_reg")).alias("point"), F.lit("").alias("base"), F.lit("").alias("property"))
            .union(method.select(F.col("node_id").cast("string"), _text("M", "node_id"), _at(_register("base_reg")), _property("property")))
        )
        self.writes = stored(n.where("kind = 'WriteProperty' and property is not null").join(owner, "func_id").select("program_id", _property("property").alias("property"), _at(_register("base_reg")).alias("base"), _at(_register("value_reg")).alias("value")))
        self.objects = stored(n.where(allocation.isNotNull() & (allocation != "const")).join(owner, "func_id").select(_text(allocation, "node_id").alias("alloc"), "program_id", F.when(F.col("kind") == "DeclareFunction", F.col("declares")).alias("callee_id")))
        passed = p.call_arg.join(n.where("kind = 'Call' and not is_ctor").select("node_id", "func_id", "block", "idx"), "node_id").select(F.col("node_id").cast("string").alias("call"), _at(_register("reg")).alias("value"))
        self.passed = stored(passed.union(method.where("base_reg >= 0 and not is_ctor").select(F.col("node_id").cast("string"), _at(_register("base_reg")))))
        self.ctors = n.where("kind = 'Call' and is_ctor").select(F.col("node_id").cast("string").alias("call"))

    @functools.cached_property
    def forward(self) -> Forward:
        return Forward(self.program, self.scope)

    # -- rules on new rows alone

    def places(self, new: DataFrame) -> list[DataFrame]:
        """Points in blocks: what the last definition before the place gives, else the blocks before, else the function's entry."""
        part = F.split("a", r"\|", 5)
        places = new.where("tag = 'point' and a like 'V|%'").select("a", part[1].cast("long").alias("func_id"), part[2].cast("long").alias("block"), part[3].cast("long").alias("at"), part[4].alias("key"))
        found = places.join(self.defs, ["block", "key"], "left").groupBy("a", "func_id", "block", "at", "key").agg(F.max_by("node_id", F.when(F.col("idx") < F.col("at"), F.col("idx"))).alias("node_id"), F.count_if(F.col("idx") < F.col("at")).alias("n"))
        # The three ways are one relation: a place has a definition, or blocks before it, or is the entry.
        given = self.source.select(F.col("node_id").alias("of"), F.struct("tag", "b", "c").alias("s"))
        before = self.before.select("block", F.col("pred"))
        ways = found.join(given, (F.col("node_id") == F.col("of")) & (F.col("n") > 0), "left").join(before, "block", "left").join(self.functions.select("func_id", "entry", "is_main"), "func_id")
        defined, open_ = F.col("n") > 0, F.col("n") == 0
        rows = F.array(
            F.when(defined & F.col("s").isNotNull(), F.struct(F.col("s.tag").alias("tag"), F.col("a"), F.col("s.b").alias("b"), F.col("s.c").alias("c"))),
            F.when(open_ & F.col("pred").isNotNull(), F.struct(*_row("flow", "a", _at(F.col("key"), block="pred", idx=F.lit(LAST))))),
            F.when(open_ & (F.col("block") == F.col("entry")) & ~F.col("is_main") & F.col("key").startswith("v:"), F.struct(*_row("entry", "a", "func_id", "key"))),
        )
        return [ways.select(F.explode(F.array_compact(rows)).alias("r")).select("r.*")]

    def fields(self, new: DataFrame) -> list[DataFrame]:
        fields = new.where("tag = 'point' and a like 'H|%'").select("a", F.split("a", r"\|", 3)[1].alias("property"), F.split("a", r"\|", 3)[2].alias("alloc"))
        return [fields.join(self.objects, "alloc").join(self.writes, ["program_id", "property"]).select(_row("heap", "a", "base", "value"))]

    def asked(self, new: DataFrame) -> list[DataFrame]:
        asked = new.where("tag = 'ask'").select(F.col("a").alias("call")).join(self.callee, "call")
        rows = F.array(F.struct(*_row("callee", "call", "point")), F.when(F.col("base") != "", F.struct(*_row("field", "point", "base", "property"))))
        return [asked.select(F.explode(F.array_compact(rows)).alias("r")).select("r.*")]

    def declared_at(self, new: DataFrame) -> list[DataFrame]:
        """A function whose callers matter, as its entry is reached or something leaves it, is followed from where it is declared or named."""
        functions = new.where("tag in ('entry', 'leaves')").select(F.col("b").cast("long").alias("func_id")).distinct()
        return [functions.join(self.forward.seeds, "func_id").select(_row("at", "func_id", "place"))]

    def onward(self, new: DataFrame) -> list[DataFrame]:
        went = new.where("tag = 'at'").select(F.col("a").alias("value"), F.col("b").alias("place")).join(self.forward.onward, "place")
        asks = F.col("tag") == "ask"
        return [went.select("tag", F.when(asks, F.col("to")).otherwise(F.col("value")).alias("a"), F.when(asks, "").otherwise(F.col("to")).alias("b"), "c")]

    @staticmethod
    def with_demands(rows: DataFrame) -> DataFrame:
        """Each row and what it asks for at once."""
        more = F.when(F.col("tag").isin("flow", "field", "heap", "callee"), F.struct(*_row("point", "b"))).when(F.col("tag").isin("calls", "gives"), F.struct(*_row("ask", "b")))
        return rows.select(F.explode(F.array_compact(F.array(F.struct(*ROW), more))).alias("r")).select("r.*")

    # -- rules on two rows

    def reach(self, pts: DataFrame, flow: DataFrame) -> list[DataFrame]:
        return [pts.select(F.col("a").alias("p"), F.col("b").alias("alloc")).join(flow.select("a", F.col("b").alias("p")), "p").select(_row("pts", "a", "alloc"))]

    def held(self, pts: DataFrame, waiting: DataFrame) -> list[DataFrame]:
        met = waiting.join(pts.select(F.col("a").alias("b"), F.col("b").alias("alloc")).where("alloc not like 'const|%'"), "b")
        object_ = F.split("a", r"\|", 3)[2]
        return [
            met.where("tag = 'field'").select(_row("flow", "a", _text("H", "c", "alloc"))),
            met.where((F.col("tag") == "heap") & (object_ == F.col("alloc"))).select(_row("flow", "a", "c")),
            met.where("tag = 'callee'").join(self.objects.where("callee_id is not null"), "alloc").select(_row("edge", "a", "callee_id")),
        ]

    def called(self, edge: DataFrame, waiting: DataFrame) -> list[DataFrame]:
        edge = edge.select(F.col("a").alias("call"), F.col("b").cast("long").alias("callee"))
        results = waiting.where("tag = 'calls'").select(F.col("a"), F.col("b").alias("call")).join(edge, "call").join(self.functions, F.col("callee") == F.col("func_id"))
        entry = waiting.where("tag = 'entry'").select("a", F.col("b").cast("long").alias("callee"), F.col("c").alias("key"))
        sites = entry.join(edge, "callee")
        params = sites.join(self.bound.withColumnRenamed("func_id", "callee"), ["callee", "key"]).join(self.args, ["call", "position"])
        out = [results.select(_row("flow", "a", _at(F.lit("r1"), block="exit", idx=F.lit(LAST)))), params.select(_row("flow", "a", "value"))]
        if self.captures == "exit":
            free = sites.join(self.own.withColumnRenamed("func_id", "callee"), ["callee", "key"], "left_anti").join(self.calls, "call")
            mine = self.scope.select(F.col("func_id").alias("callee"), "key", F.col("decl_id").alias("mine"))
            there = self.scope.select(F.col("func_id").alias("at_func"), "key", F.col("decl_id").alias("there"))
            known = free.join(mine, ["callee", "key"]).join(there, ["at_func", "key"], "left")
            out.append(known.where("mine = there").select(_row("flow", "a", _at(F.col("key"), "at_func", "at_block", "at_idx"))))
            around = self.functions.select(F.col("func_id").alias("around"), F.col("exit").alias("around_exit"))
            inner = self.functions.select(F.col("func_id").alias("callee"), F.col("outer_func_id").alias("around"))
            out.append(known.where("mine <> there or there is null").join(inner, "callee").join(around, "around").select(_row("flow", "a", _at(F.col("key"), "around", "around_exit", F.lit(LAST)))))
        return out

    def anywhere(self, new: DataFrame) -> list[DataFrame]:
        """Names from outside take every value that is assigned to them, under captures="any"."""
        if self.captures != "any":
            return []
        free = new.where("tag = 'entry'").select("a", F.col("b").cast("long").alias("func_id"), F.col("c").alias("key")).join(self.own, ["func_id", "key"], "left_anti").join(self.scope, ["func_id", "key"])
        target = free.select("a", "key", F.col("decl_id").alias("func_id"))
        start = target.join(self.functions, "func_id").select(_row("flow", "a", _at(F.col("key"), block="entry", idx=F.lit(0))))
        return [start, target.join(self.assigned, ["func_id", "key"]).select(_row("flow", "a", _at(F.col("key"), idx=F.col("idx") + 1)))]

    def through(self, handled: DataFrame, waiting: DataFrame) -> list[DataFrame]:
        calls = waiting.where("tag = 'calls'").select("a", F.col("b").alias("call"))
        return [calls.join(handled.select(F.col("a").alias("call")), "call").join(self.passed, "call").select(_row("flow", "a", "value"))]

    def carried(self, edge: DataFrame, waiting: DataFrame) -> list[DataFrame]:
        """A value that leaves a function is at the results of its calls; one that a call passes is at the parameters of its callees."""
        edge = edge.select(F.col("a").alias("call"), F.col("b").alias("callee"))
        left = waiting.where("tag = 'leaves'").select("a", F.col("b").alias("callee")).join(edge, "callee").join(self.forward.results, "call")
        given = waiting.where("tag = 'gives'").select("a", F.col("b").alias("call"), F.col("c").alias("position")).join(edge, "call").join(self.forward.params, ["callee", "position"])
        return [left.select(_row("at", "a", "place")), given.select(_row("at", "a", "place"))]

    def past(self, handled: DataFrame, waiting: DataFrame) -> list[DataFrame]:
        """What a call without a callee is given is at its result."""
        given = waiting.where("tag = 'gives'").select("a", F.col("b").alias("call")).distinct()
        return [given.join(handled.select(F.col("a").alias("call")), "call").join(self.forward.results, "call").select(_row("at", "a", "place"))]


class Forward:
    """Where a function's value goes, by places without order; made once, where callers are asked for."""

    def __init__(self, p: Program, scope: DataFrame):
        text = lambda kind, owner, key: F.concat_ws("|", F.lit(kind), owner.cast("string"), key.cast("string"))
        register = lambda column: text("R", F.col("func_id"), F.col(column))
        declared = scope.select("func_id", F.substring("key", 3, 1 << 30).alias("name"), "decl_id")
        n = p.node.join(p.function.select("func_id", "program_id"), "func_id").join(declared, ["func_id", "name"], "left")
        variable = text("N", F.coalesce("decl_id", "func_id"), F.col("name"))
        property_ = text("P", F.col("program_id"), _property("property"))
        writes = F.expr("kind = 'WriteVariable' or kind = 'DeclareFunction' and result_reg < 0 and name is not null")
        defined = F.array_compact(F.array(F.when(F.expr("result_reg > 0"), register("result_reg")), F.when(writes, variable)))
        call = F.col("node_id").cast("string").alias("call")
        static = names.static_references(p, names.ancestors(p)).select("node_id", F.col("callee_id").alias("declared"))
        #: (func_id, place) where a function's value begins.
        self.seeds = stored(
            n.where("declares is not null").select(F.col("declares").alias("func_id"), F.explode(defined).alias("place"))
            .union(n.join(static, "node_id").where("result_reg > 0").select(F.col("declared"), register("result_reg")))
        )
        taken = F.when(F.col("kind") == "ReadVariable", variable).when(F.col("kind").isin("WriteVariable"), register("value_reg")).when(F.expr("kind = 'ReadProperty' and property is not null"), property_)
        step = lambda df, src, dst: df.select(src.alias("place"), F.lit("at").alias("tag"), dst.alias("to"), F.lit("").alias("c"))
        operand = p.call_arg.join(n, "node_id")
        external = n.where("kind = 'Call' and not is_internal")
        method = external.where("func_reg = -1 and property is not null")
        uses = lambda df, src: df.select(src.alias("place"), F.lit("ask").alias("tag"), call.alias("to"), F.lit("").alias("c"))
        gives = lambda df, src, position: df.select(src.alias("place"), F.lit("gives").alias("tag"), call.alias("to"), position.cast("string").alias("c"))
        #: (place, tag, to, c): what follows from being at a place.
        self.onward = stored(_union([
            step(n.where(taken.isNotNull()), taken, F.explode(defined)),
            step(n.where("kind = 'WriteProperty' and property is not null"), register("value_reg"), property_),
            step(operand.where("kind in ('BinaryOperator', 'UnaryOperator')"), register("reg"), F.explode(defined)),
            uses(external.where("func_reg >= 0"), register("func_reg")),
            uses(method, property_),
            gives(operand.where("kind = 'Call' and not is_internal"), register("reg"), F.col("position")),
            gives(method.where("base_reg >= 0 and not is_ctor"), register("base_reg"), F.lit(-1)),
            p.function.select(text("R", F.col("func_id"), F.lit(1)), F.lit("leaves"), F.col("func_id").cast("string"), F.lit("")),
        ]))
        #: (call, place) of results, and (callee, position, place) of parameters.
        self.results = stored(external.where("not is_ctor and result_reg > 0").select(call, register("result_reg").alias("place")))
        self.params = stored(p.function.select("func_id", F.posexplode("params").alias("position", "name")).select(F.col("func_id").cast("string").alias("callee"), F.col("position").cast("string").alias("position"), text("N", F.col("func_id"), F.col("name")).alias("place")))


def point_of(register: str) -> Column:
    """The point of a register at a node (func_id, block, idx)."""
    return _at(_register(register))


def value_points(p: Program) -> DataFrame:
    """(node_id, point) of the value that each variable write stores, as points to ask for."""
    return p.node.where("kind = 'WriteVariable'").select("node_id", _at(_register("value_reg")).alias("point"))


def known(p: Program, points: DataFrame | None = None, calls: DataFrame | None = None, captures: str = "exit", strata: bool = True, most_rounds: int | None = None, deadline: float | None = None, rules: Rules | None = None, log: figures.Rounds | None = None) -> DataFrame:
    """All rows (tag, a, b, c) that the asked points (point) and calls (call_id) need; every external call without either.

    strata: once nothing is new, calls without a callee pass their arguments (and
    a method call its base) to their result, and the search goes on. All such calls are
    judged against one snapshot, as far as they are asked by then. deadline: a time.monotonic() after which no round
    begins; TimeoutError then. rules: those of p with the same captures, where a
    caller asks several times. log takes the figures of each round.
    """
    rules = Rules(p, captures) if rules is None else rules
    if rules.captures != captures:
        raise ValueError(f"rules for captures={rules.captures!r}")
    seeds = []
    if points is not None:
        seeds.append(points.select(_row("point", "point")))
    if calls is not None or points is None:
        seeds.append((rules.calls.select("call") if calls is None else calls.select(F.col("call_id").alias("call"))).select(_row("ask", "call")))
    new = stored(_union(seeds).distinct())
    parts: list[tuple[DataFrame, int]] = []  # what earlier rounds brought, in tables of falling size
    rounds, seen, waits = 0, set(), {"field", "heap", "callee"}
    alone = ((rules.places, {"point"}), (rules.fields, {"point"}), (rules.asked, {"ask"}), (rules.anywhere, {"entry"}))
    together = ((rules.reach, {"pts"}, {"flow"}), (rules.held, {"pts"}, waits), (rules.called, {"edge"}, {"calls", "entry"}), (rules.through, {"handled"}, {"calls"}))
    if points is not None or calls is not None:
        alone += ((rules.declared_at, {"entry", "leaves"}), (rules.onward, {"at"}))
        together += ((rules.carried, {"edge"}, {"leaves", "gives"}), (rules.past, {"handled"}, {"gives"}))
    pick = lambda df, tags: df.where(F.col("tag").isin(*tags))
    # The tags of the new rows, a dozen at most, say which rules have anything to do.
    counts = {r.tag: r.n for r in status(new).collect()}
    total = new
    while counts and (most_rounds is None or rounds < most_rounds):
        rounds += 1
        if deadline is not None and time.monotonic() > deadline:
            raise TimeoutError(f"stopped before round {rounds}")
        earlier = _union([df for df, _ in parts]) if parts else None
        total = new if earlier is None else earlier.union(new)
        fresh, out = set(counts), []
        before, seen = seen, seen | fresh
        with figures.one(log) as row:
            for rule, tags in alone:
                if tags & fresh:
                    out += rule(pick(new, tags))
            for rule, left, right in together:
                if left & fresh and right & seen:
                    out += rule(pick(new, left), pick(total, right))
                if left & before and right & fresh:
                    out += rule(pick(earlier, left), pick(new, right))
            parts = merged([*parts, (new, sum(counts.values()))])
            if out:
                new = stored(figures.counted(log, rules.with_demands(_union(out))).distinct().join(total, ROW, "left_anti"))
                counts = {r.tag: r.n for r in status(new).collect()}
            if (not out or not counts) and strata:
                asked = pick(total, {"ask"}).select(F.col("a").alias("call")).join(rules.ctors, "call", "left_anti")
                open_ = asked.join(pick(total, {"edge"}).select(F.col("a").alias("call")), "call", "left_anti")
                new = stored(open_.select(_row("handled", "call")).join(total, ROW, "left_anti"))
                counts = {r.tag: r.n for r in status(new).collect()}
            elif not out:
                counts = {}
            row["asked"], row["handled"] = sum(counts.get(t, 0) for t in QUESTIONS), counts.get("handled", 0)
            row["found"] = sum(counts.values()) - row["asked"] - row["handled"]
    return total


def edges(rows: DataFrame) -> DataFrame:
    return rows.where("tag = 'edge'").select(F.col("a").cast("long").alias("call_id"), F.col("b").cast("long").alias("callee_id"))


def points_to(rows: DataFrame) -> DataFrame:
    return rows.where("tag = 'pts'").select(F.col("a").alias("point"), F.col("b").alias("alloc"))


def invocations(p: Program, rows: DataFrame) -> DataFrame:
    """(func_id, call_id): calls whose function or method point holds the function, by two joins instead of one with an OR."""
    held = points_to(rows).where("alloc like 'func|%'")
    declared = p.node.where("declares is not null").select(F.concat(F.lit("func|"), F.col("node_id").cast("string")).alias("alloc"), F.col("declares").alias("func_id"))
    calls = rows.where("tag = 'callee'").select(F.col("a").cast("long").alias("call_id"), F.col("b").alias("point"))
    by_register, by_method = calls.where("point like 'V|%'"), calls.where("point like 'M|%'")
    return by_register.join(held, "point").union(by_method.join(held, "point")).join(declared, "alloc").select("func_id", "call_id").distinct()


def alias_pairs(rows: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of asked points (point) that share an object."""
    held = points_to(rows).where("alloc not like 'const|%'")
    first = left.join(held, "point").select(F.col("point").alias("a"), "alloc")
    return first.join(right.join(held, "point").select(F.col("point").alias("b"), "alloc"), "alloc").select("a", "b").distinct()


def dependencies(rows: DataFrame) -> DataFrame:
    """(from_query, to_query): which point's answer each point waits for."""
    return rows.where("tag in ('flow', 'field', 'heap', 'callee')").select(F.col("a").alias("from_query"), F.col("b").alias("to_query")).distinct()


def status(rows: DataFrame) -> DataFrame:
    """(tag, n): what a run has asked, found and handled."""
    return rows.groupBy("tag").agg(F.count("*").alias("n"))
