"""Call and field stacks together, fed by the moves of programs.

Two pushdown automata of every query grow in one loop: in the call automaton (stack C) values are states and places lie on the
stack, in the field automaton (stack F) facts are states and properties lie on it. A fact counts as reached when both
automata reach it; only then are its moves derived, and each round joins what is new with what is known. A call that is
left with an empty stack goes on at every known call of the function, with the query's own end state: there and nowhere else.
All queries, of both directions and of many programs, advance in the same round.
Call edges, aliases and calls without a callee are given, as `resolve` finds them.
"""

from __future__ import annotations

import functools
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import stored
from .resolve import merged
from .transfer import MOVE, Inputs, Templates, Transfer

TRANS = ["system", "stack", "p", "g", "q"]
REACHED = ["system", "place", "fact"]
#: The bottom of a field stack, the end state of every automaton, any label, and how made-up states begin.
BOTTOM, END, ANY, MADE = "_", "end", "*", "mid:"


def _fact(place: str, fact: str) -> Column:
    return F.concat_ws("|", F.col(place).cast("string"), fact)


def machine_rules(moves: DataFrame) -> DataFrame:
    """Both automata's rule of every move: (system, stack, kind, p, g, p2, g2, g3)."""
    kind, field = F.col("kind"), F.col("kind").isin("FP", "FO")
    row = lambda *c: F.struct(*(x.alias(n) for x, n in zip(c, ("stack", "kind", "p", "g", "p2", "g2", "g3"), strict=True)))
    calls = row(F.lit("C"), F.when(field, "N").otherwise(kind), F.col("fact"), F.col("place").cast("string"), F.col("fact2"), F.col("place2").cast("string"), F.when(kind == "P", F.col("x")).otherwise(""))
    fields = row(
        F.lit("F"), F.when(kind == "FP", "P").when(kind == "FO", "O").otherwise("N"), _fact("place", "fact"), F.when(kind == "FO", F.col("x")).otherwise(ANY),
        _fact("place2", "fact2"), F.when(kind == "FP", F.col("x")).when(kind == "FO", "").otherwise(ANY), F.lit(ANY),
    )
    return moves.select("system", F.explode(F.array(calls, fields)).alias("r")).select("system", "r.*")


def _fired(trans: DataFrame, rules: DataFrame) -> DataFrame:
    """What the rules make of transitions; a rule for any label keeps the label."""
    keyed = trans.where("g <> ''").withColumn("key", F.explode(F.when(F.col("stack") == "C", F.array("g")).otherwise(F.array("g", F.lit(ANY)))))
    hit = keyed.join(rules.withColumnRenamed("g", "key"), ["system", "stack", "p", "key"])
    made = F.concat_ws(":", F.lit(MADE[:-1]), "p2", "g2")
    row = lambda p, g, q: F.struct(p.alias("p"), g.alias("g"), q.alias("q"))
    kept = lambda c: F.when(F.col(c) == ANY, F.col("g")).otherwise(F.col(c))
    kind, q = F.col("kind"), F.col("q")
    rows = F.array(
        F.when(kind == "N", row(F.col("p2"), kept("g2"), q)),
        F.when(kind == "P", row(F.col("p2"), F.col("g2"), made)),
        F.when(kind == "P", row(made, kept("g3"), q)),
        F.when(kind == "O", row(F.col("p2"), F.lit(""), q)),
        F.when((kind == "O") & (F.col("stack") == "C") & (q == END), row(F.col("p2"), F.col("g2"), q)),  # an unbalanced pop
    )
    return hit.select("system", "stack", F.explode(F.array_compact(rows)).alias("t")).select("system", "stack", "t.*")


def _skipped(empty: DataFrame, onward: DataFrame) -> DataFrame:
    after = onward.select("system", "stack", F.col("p").alias("q"), F.col("g").alias("g2"), F.col("q").alias("q2"))
    return empty.where("g = ''").select("system", "stack", "p", "q").join(after, ["system", "stack", "q"]).select("system", "stack", "p", F.col("g2").alias("g"), F.col("q2").alias("q"))


def _heads(trans: DataFrame) -> DataFrame:
    """(system, stack, place, fact) that an automaton reaches."""
    real = trans.where((F.col("g") != "") & ~F.col("p").startswith(MADE))
    place = F.when(F.col("stack") == "C", F.col("g")).otherwise(F.substring_index("p", "|", 1))
    fact = F.when(F.col("stack") == "C", F.col("p")).otherwise(F.regexp_replace("p", r"^[^|]*\|", ""))
    return real.select("system", "stack", place.cast("long").alias("place"), fact.alias("fact")).distinct()


def with_names(queries: DataFrame) -> DataFrame:
    """(system, forward, place, fact): the queries (forward, place, fact), each with a name of its own."""
    return queries.select(F.concat_ws("~", F.when(F.col("forward"), "f").otherwise("b"), F.col("place").cast("string"), "fact").alias("system"), "forward", "place", "fact").distinct()


class Grown:
    """A set of rows in tables of falling size, and what the last addition brought."""

    def __init__(self, empty: DataFrame):
        self.empty, self.parts, self.new, self.last = empty, [], empty, 0

    @property
    def total(self) -> DataFrame:
        return functools.reduce(DataFrame.union, [df for df, _ in self.parts]) if self.parts else self.empty

    def add(self, rows: DataFrame) -> int:
        rows = rows.select(self.empty.columns).distinct()
        self.new = stored(rows.join(self.total, self.empty.columns, "left_anti") if self.parts else rows)
        self.last = self.new.count()
        if self.last:
            self.parts = merged([*self.parts, (self.new, self.last)])
        return self.last


@dataclass
class Solved:
    """queries (system, forward, place, fact), transitions, facts that both automata reach, and moves."""

    queries: DataFrame
    trans: DataFrame
    reached: DataFrame
    moves: DataFrame
    rounds: list[dict]

    def plain(self) -> DataFrame:
        """(system, place, fact) reached with an empty field stack: the value itself, not something inside of it."""
        whole = self.trans.where((F.col("stack") == "F") & (F.col("g") == BOTTOM) & (F.col("q") == END) & ~F.col("p").startswith(MADE))
        own = whole.select("system", F.substring_index("p", "|", 1).cast("long").alias("place"), F.regexp_replace("p", r"^[^|]*\|", "").alias("fact"))
        return own.join(self.reached, REACHED, "left_semi")


class Machine:
    """All automata of a program; queries and what the moves are told may be added between runs."""

    def __init__(self, transfer: Transfer, deadline: float | None = None):
        spark = transfer.edges.sparkSession
        frame = lambda schema: spark.range(0).where("false").select(*(F.lit(None).cast(kind).alias(name) for name, kind in map(str.split, schema.split(", "))))
        self.transfer, self.deadline = transfer, deadline
        self.queries = Grown(frame("system string, forward boolean, place long, fact string"))
        self.trans = Grown(frame("system string, stack string, p string, g string, q string"))
        self.reached = Grown(frame("system string, place long, fact string"))
        self.moves = Grown(frame("system string, kind string, place long, fact string, place2 long, fact2 string, x string"))
        self.rounds: list[dict] = []
        self.popping = False  # whether any move leaves a stack: before, no label is empty

    def ask(self, queries: DataFrame) -> int:
        """Adds queries (forward, place, fact); how many are new."""
        n = self.queries.add(with_names(queries))
        if n:
            new = self.queries.new
            calls = new.select("system", F.lit("C").alias("stack"), F.col("fact").alias("p"), F.col("place").cast("string").alias("g"), F.lit(END).alias("q"))
            fields = new.select("system", F.lit("F").alias("stack"), _fact("place", "fact").alias("p"), F.lit(BOTTOM).alias("g"), F.lit(END).alias("q"))
            self.waiting = calls.union(fields)
        return n

    def _derived(self, reached: DataFrame, templates: Templates) -> DataFrame:
        queries = self.queries.total
        return templates.moves(reached.join(queries.select("system", "forward"), "system"), queries)

    def run(self, inputs: Inputs, told: bool = False) -> None:
        """Saturates; told: the inputs have grown, so that facts reached earlier may move further."""
        began, templates = time.monotonic(), Templates(self.transfer, inputs)
        rules = self.moves.add(self._derived(self.reached.total, templates)) if told and self.reached.parts else 0
        new_rules = machine_rules(self.moves.new) if rules else None
        self.popping = self.popping or bool(rules)
        seeds, self.waiting = getattr(self, "waiting", None), None
        while True:
            if self.deadline is not None and time.monotonic() > self.deadline:
                raise TimeoutError(f"stopped before round {len(self.rounds) + 1}")
            found = seeds
            if seeds is None or new_rules is not None:
                steps = self._steps(new_rules)
                found = steps if found is None else found.union(steps)
            trans = self.trans.add(found)
            seeds, new_rules = None, None
            heads = _heads(self.trans.new)
            other = _heads(self.trans.total).withColumnRenamed("stack", "other")
            facts = self.reached.add(heads.join(other, REACHED).where("stack <> other").select(REACHED)) if trans else 0
            rules = self.moves.add(self._derived(self.reached.new, templates)) if facts else 0
            new_rules = machine_rules(self.moves.new) if rules else None
            self.popping = self.popping or bool(rules) and not self.moves.new.where("kind in ('O', 'FO')").isEmpty()
            self.rounds.append({"round": len(self.rounds) + 1, "transitions": trans, "facts": facts, "moves": rules, "seconds": time.monotonic() - began})
            began = time.monotonic()
            if not trans and not rules:
                return

    def _steps(self, new_rules: DataFrame | None) -> DataFrame:
        """One round: new transitions with all rules, all transitions with new rules; and over empty labels, new on either side."""
        new, total = self.trans.new.select(TRANS) if self.trans.last else None, self.trans.total
        out = [] if new is None else [_fired(new, machine_rules(self.moves.total))]
        out += [_skipped(new, total), _skipped(total, new)] if new is not None and self.popping else []
        out += [] if new_rules is None else [_fired(total, new_rules)]
        return functools.reduce(DataFrame.union, out)

    def result(self) -> Solved:
        return Solved(self.queries.total, self.trans.total, self.reached.total, self.moves.total.select(MOVE), self.rounds)


def solve(transfer: Transfer, queries: DataFrame, inputs: Inputs, deadline: float | None = None) -> Solved:
    """What queries (forward, place, fact) reach, the call edges and aliases being given."""
    machine = Machine(transfer, deadline)
    if machine.ask(queries):
        machine.run(inputs)
    return machine.result()
