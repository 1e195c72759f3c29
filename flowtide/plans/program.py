"""A program (or many) as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Kinds of nodes that the rules tell apart.
KINDS = (
    "BinaryOperator BeginForIn BeginLoop BeginWith Call Catch Constant DeclareFunction DeclareVariable DeleteProperty EndForIn EndLoop EndWith "
    "EventDispatcher ExceptionalReturn HasNextProperty If NewObject NextProperty Nop ReadProperty ReadVariable Return Throw Typeof UnaryOperator "
    "WriteProperty WriteVariable"
).split()

FUNCTION = "program_id string, func_id long, name string, outer_func_id long, is_main boolean, params array<string>, vars array<string>, entry long, exit long"
NODE = (
    "func_id long, idx long, node_id long, kind string, result_reg long, base_reg long, value_reg long, func_reg long, "
    "name string, property string, is_internal boolean, is_ctor boolean, declares long, line int, col int, block long"
)
ARG = "node_id long, position int, reg long"


@dataclass
class Program:
    """Functions, nodes (ids are unique over all programs; -1 stands for no register), control flow and arguments.

    idx orders the nodes of a block; functions have an entry and an exit block.
    Arguments are those of calls and the operands of operators. `signatures` has functions without what is only known from their nodes,
    where that is cheaper to read. `straight`: the nodes of a function are one line in the order of idx.
    """

    function: DataFrame
    node: DataFrame
    cfg_edge: DataFrame
    call_arg: DataFrame
    block_edge: DataFrame
    signatures: DataFrame | None = None
    straight: bool = False

    @property
    def heads(self) -> DataFrame:
        """program_id, func_id, name, outer_func_id, is_main and params of every function."""
        return (self.function if self.signatures is None else self.signatures).select("program_id", "func_id", "name", "outer_func_id", "is_main", "params")
