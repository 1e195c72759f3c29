"""Pushdown systems, many at once: what a stack machine can reach, as an automaton that grows by joins.

Rules (system, kind, p, g, p2, g2, g3) rewrite control state p with g on top of
the stack: kind N to p2 with g2 on top, O to p2 with g taken off, P to p2 with g2
on top of g3. A transition (system, p, g, q) reads g between states; the empty label is
an empty string. No column may be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import fixpoint

TRANS = ["system", "p", "g", "q"]


def post_star(rules: DataFrame, seeds: DataFrame) -> DataFrame:
    """Transitions of the automaton of all that is reachable from the seeds (system, p, g, q): q accepts."""

    def middle(p, g):
        return F.concat(F.lit("mid:"), p, F.lit(":"), g)

    def step(new: DataFrame, total: DataFrame) -> DataFrame:
        hit = new.where("g <> ''").join(rules, ["system", "p", "g"])
        top = F.struct(F.col("p2").alias("p"), F.when(F.col("kind") == "O", "").otherwise(F.col("g2")).alias("g"), F.when(F.col("kind") == "P", middle(F.col("p2"), F.col("g2"))).otherwise(F.col("q")).alias("q"))
        below = F.when(F.col("kind") == "P", F.struct(middle(F.col("p2"), F.col("g2")).alias("p"), F.col("g3").alias("g"), F.col("q").alias("q")))
        moved = hit.select("system", F.explode(F.array_compact(F.array(top, below))).alias("t")).select("system", "t.*")

        def skip(empty: DataFrame, onward: DataFrame) -> DataFrame:
            onward = onward.select("system", F.col("p").alias("q"), F.col("g").alias("g2"), F.col("q").alias("q2"))
            return empty.where("g = ''").select("system", "p", "q").join(onward, ["system", "q"]).select("system", "p", F.col("g2").alias("g"), F.col("q2").alias("q"))

        return moved.union(skip(new, total)).union(skip(total, new))

    return fixpoint(seeds.select(TRANS), step)


def heads(trans: DataFrame, rules: DataFrame) -> DataFrame:
    """(system, p, g): control states with what can be on top of their stack."""
    states = rules.select("system", "p").union(rules.select("system", F.col("p2"))).distinct()
    return trans.where("g <> ''").join(states, ["system", "p"], "left_semi").select("system", "p", "g").distinct()


def synchronized(calls: DataFrame, fields: DataFrame) -> DataFrame:
    """(system, place, value) that both automata reach: the call system has values as states and places on its stack,
    the field system has `place|value` as states; a value counts where the field stack may be anything."""
    at = calls.select("system", F.col("g").alias("place"), F.col("p").alias("value"))
    there = fields.select("system", F.split("p", r"\|", 2)[0].alias("place"), F.split("p", r"\|", 2)[1].alias("value"))
    return at.join(there, ["system", "place", "value"], "left_semi").distinct()
