"""JavaScript sources as program tables.

A small per-file helper turns a file into rows of functions, nodes in basic blocks
and block edges; everything that is asked of a program is done on the tables.

Covered is ES5 with arrow functions, `let` and `const`. As in the flowgraph
text form: declarations stand in a function's entry block, every function has an
exit block, register 1 holds the value to return, a method call has a base register
and a property instead of a function register. Code that can't be read gives one
row with an error instead of a program.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scans import indexed
from ..plans.fixpoint import cut, fixpoint, stored
from ..plans.program import Program

TOKEN = re.compile(
    r"""(?P<skip>(?:\s+|//[^\n]*|/\*.*?\*/)+)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>0[xX][\da-fA-F]+|\d*\.?\d+(?:[eE][+-]?\d+)?)|(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`)"""
    r"""|(?P<op>=>|\.\.\.|>>>=?|===|!==|\*\*|<<=|>>=|&&|\|\||[-+*/%&|^]=|[=!<>]=|\+\+|--|<<|>>|[-+*/%=<>!~?:.,;(){}\[\]&|^])""",
    re.S,
)
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
#: Binding strength of binary operators.
BINARY = {op: i for i, ops in enumerate("|| ?? && | ^ & ===.!==.==.!= <.>.<=.>=.in.instanceof <<.>>.>>> +.- *./.% **".split(), 1) for op in ops.split(".")}
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())
CONSTANTS = frozenset("true false null this super".split())
#: Nodes and functions of one file at most; a larger file is an error row.
SPAN = 1 << 22


class Unreadable(Exception):
    pass


def tokens(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, line, column); a slash after a value divides, elsewhere it begins a pattern."""
    out, at, line, start = [], 0, 1, 0
    while at < len(text):
        ends_value = out and (out[-1][0] in ("number", "string") or out[-1][1] in ")]}" or out[-1][0] == "name" and out[-1][1] not in ("return", "typeof", "case", "in", "void", "delete", "throw"))
        m = REGEX.match(text, at) if text[at] == "/" and text[at + 1 : at + 2] not in ("/", "*") and not ends_value else None
        kind = "string" if m else None
        m = m or TOKEN.match(text, at)
        if not m:
            raise Unreadable(f"line {line}: {text[at]!r}")
        kind = kind or m.lastgroup
        if kind != "skip":
            out.append((kind, m[0], line, at - start + 1))
        if breaks := m[0].count("\n"):
            line += breaks
            start = m.start() + m[0].rindex("\n") + 1
        at = m.end()
    return [*out, ("end", "", line, 1)]


class Lowering:
    """One pass over the tokens of a file; functions, nodes, edges and arguments are collected as it goes."""

    def __init__(self, text: str):
        self.t, self.at = tokens(text), 0
        self.functions, self.nodes, self.edges, self.args = [], [], [], []
        self.f = None
        self.block_count = 0
        self.function(None, [], 1, 1)

    # -- rows

    def new_block(self) -> int:
        self.block_count += 1
        return self.block_count - 1

    def to(self, *targets: int) -> None:
        if self.f["block"] is not None:
            self.edges += [(self.f["block"], b) for b in targets]

    def go(self, block: int) -> None:
        """Falls through to a block and goes on there."""
        self.to(block)
        self.f["block"] = block

    def register(self) -> int:
        self.f["registers"] += 1
        return self.f["registers"]

    def node(self, kind: str, at, block: int | None = None, **columns) -> dict:
        if block is None and self.f["block"] is None:  # behind a jump: a block that nothing leads to
            self.f["block"] = self.new_block()
        row = {"func": self.f["id"], "block": self.f["block"] if block is None else block, "kind": kind, "line": at[2], "col": at[3], **columns}
        self.nodes.append(row)
        return row

    def operation(self, kind: str, at, operands: list[int], result: int | None = None) -> int:
        result = result or self.register()
        row = self.node(kind, at, result_reg=result)
        self.args += [(row, i, r) for i, r in enumerate(operands)]
        return result

    # -- tokens

    def peek(self, text: str) -> bool:
        return self.t[self.at][1] == text and self.t[self.at][0] in ("op", "name")

    def take(self, text: str | None = None):
        tok = self.t[self.at]
        if text is not None and not self.peek(text) or tok[0] == "end":
            raise Unreadable(f"line {tok[2]}: {tok[1]!r} instead of {text or 'code'}")
        self.at += 1
        return tok

    def word(self):
        if self.t[self.at][0] != "name":
            raise Unreadable(f"line {self.t[self.at][2]}: {self.t[self.at][1]!r} instead of a name")
        return self.take()

    def has(self, text: str) -> bool:
        self.at += (yes := self.peek(text))
        return yes

    # -- functions

    def function(self, name, params, line: int, column: int, arrow: bool = False) -> dict:
        outer, spot = self.f, (None, None, line, column)
        f = self.f = {"id": len(self.functions), "name": name, "outer": outer and outer["id"], "params": params, "vars": [], "registers": 1, "entry": self.new_block(), "exit": self.new_block(), "loops": [], "line": line, "col": column}
        self.functions.append(f)
        f["block"] = f["entry"]
        self.node("Constant", spot, result_reg=1)
        self.go(self.new_block())
        if outer is None:
            while self.t[self.at][0] != "end":
                self.statement()
        elif arrow and not self.peek("{"):
            self.give(self.assignment(), spot)
        else:
            self.block()
        self.to(f["exit"])
        self.node("Return", spot, f["exit"], value_reg=1)
        self.f = outer
        return f

    def give(self, register: int, at) -> None:
        """A value becomes the function's result."""
        self.operation("UnaryOperator", at, [register], 1)

    def function_from(self, at, declared: bool) -> int:
        """From behind `function`: name, parameters and body. Its declaration node is returned's register (-1: a declaration)."""
        self.has("*")
        name = self.word()[1] if not self.peek("(") else None
        params = self.parameters()
        outer, block = self.f, self.f["block"]
        f = self.function(name, params, at[2], at[3])
        result = -1 if declared else self.register()
        row = self.node("DeclareFunction", at, outer["entry"] if declared else block, result_reg=result, name=name, declares=f["id"])
        if declared:
            row["hoisted"] = True
        return result

    def parameters(self) -> list[str]:
        self.take("(")
        out = []
        while not self.has(")"):
            self.has("...")
            out.append(self.word()[1])
            if self.has("="):
                self.assignment()
            self.has(",")
        return out

    def arrow(self) -> int | None:
        """An arrow function, if one begins here."""
        at, spot = self.at, self.t[self.at]
        if spot[0] == "name" and self.t[at + 1][1] == "=>":
            params = [self.take()[1]]
        elif self.peek("("):
            depth, i = 0, at
            while self.t[i][0] != "end":
                depth += (self.t[i][1] == "(") - (self.t[i][1] == ")")
                i += 1
                if not depth:
                    break
            if self.t[i][1] != "=>":
                return None
            params = self.parameters()
        else:
            return None
        self.take("=>")
        f = self.function(None, params, spot[2], spot[3], True)
        result = self.register()
        self.node("DeclareFunction", spot, result_reg=result, declares=f["id"])
        return result

    # -- statements

    def block(self) -> None:
        self.take("{")
        while not self.has("}"):
            self.statement()

    def declare(self, name: str, at) -> None:
        self.f["vars"].append(name)
        self.node("DeclareVariable", at, self.f["entry"], name=name, hoisted=True)

    def variables(self) -> str | None:
        """Declarations of a list; the last name is returned."""
        name = None
        while True:
            at = self.word()
            name = at[1]
            self.declare(name, at)
            if self.has("="):
                self.node("WriteVariable", at, value_reg=self.assignment(), name=name)
            if not self.has(","):
                return name

    def branch(self, then, other=None) -> None:
        """Two ways from here that meet again."""
        a, b, end = self.new_block(), self.new_block(), self.new_block()
        self.to(a, b)
        for start, body in ((a, then), (b, other)):
            self.f["block"] = start
            if body:
                body()
            self.to(end)
        self.f["block"] = end

    def loop(self, test, body, step=None) -> None:
        head, inside, end, again = (self.new_block() for _ in range(4))
        self.go(head)
        if test:
            test()
        self.to(inside, end)
        self.f["loops"].append((end, again))
        self.f["block"] = inside
        body()
        self.go(again)
        if step:
            step()
        self.to(head)
        self.f["loops"].pop()
        self.f["block"] = end

    def statement(self) -> None:
        at = self.t[self.at]
        word = at[1] if at[0] in ("name", "op") else ""
        if word == "{":
            self.block()
        elif self.has(";"):
            pass
        elif word in ("var", "let", "const"):
            self.take()
            self.variables()
            self.has(";")
        elif word == "function":
            self.take()
            self.function_from(at, True)
        elif word == "if":
            self.take()
            self.take("(")
            self.expression()
            self.take(")")
            self.node("If", at)
            self.branch(self.statement, lambda: self.has("else") and self.statement())
        elif word in ("while", "for", "do"):
            self.take()
            getattr(self, f"{word}_loop")(at)
        elif word in ("return", "throw"):
            self.take()
            value = None
            if not self.peek(";") and not self.peek("}") and self.t[self.at][0] != "end" and self.t[self.at][2] == at[2]:
                value = self.expression()
            self.has(";")
            if word == "throw":
                self.node("Throw", at, value_reg=value)
            elif value is not None:
                self.give(value, at)
            if word == "return":
                self.to(self.f["exit"])
            self.f["block"] = None
        elif word in ("break", "continue"):
            self.take()
            if self.t[self.at][0] == "name" and self.t[self.at][2] == at[2]:
                self.take()
            self.has(";")
            if self.f["loops"]:
                self.to(self.f["loops"][-1][word == "continue"])
            self.f["block"] = None
        elif word == "try":
            self.take()
            before = self.f["block"]
            self.block()
            if self.has("catch"):
                after, caught = self.new_block(), self.new_block()
                self.to(after)
                if before is not None:
                    self.edges.append((before, caught))
                self.to(caught)
                self.f["block"] = caught
                name = None
                if self.has("("):
                    name = self.word()[1]
                    self.take(")")
                self.node("Catch", at, name=name)
                self.block()
                self.go(after)
            if self.has("finally"):
                self.block()
        elif word == "switch":
            self.switch()
        elif at[0] == "name" and self.t[self.at + 1][1] == ":" and word not in ("case", "default"):
            self.at += 2
            self.statement()
        else:
            self.expression()
            self.has(";")

    def condition(self) -> None:
        self.take("(")
        self.expression()
        self.take(")")

    def while_loop(self, at) -> None:
        self.loop(self.condition, self.statement)

    def do_loop(self, at) -> None:
        inside, end, again = (self.new_block() for _ in range(3))
        self.go(inside)
        self.f["loops"].append((end, again))
        self.statement()
        self.go(again)
        self.take("while")
        self.condition()
        self.has(";")
        self.to(inside)
        self.f["loops"].pop()
        self.go(end)

    def for_loop(self, at) -> None:
        self.take("(")
        name = None
        if not self.peek(";"):
            if self.t[self.at][1] in ("var", "let", "const"):
                self.take()
                name = self.variables()
            else:
                begin = self.t[self.at]
                if begin[0] == "name" and self.t[self.at + 1][1] in ("in", "of"):
                    name = self.take()[1]
                else:
                    self.expression()
        if self.has("in") or self.has("of"):
            base = self.expression()
            self.take(")")

            def each():
                self.node("NextProperty", at, base_reg=base)
                self.node("WriteVariable", at, value_reg=self.operation("UnaryOperator", at, []), name=name)
                self.statement()

            self.node("BeginForIn", at, base_reg=base)
            self.loop(lambda: self.node("HasNextProperty", at), each)
            self.node("EndForIn", at)
            return
        self.take(";")
        test = self.skipping(";", self.expression)
        self.take(";")
        step = self.skipping(")", self.expression)
        self.take(")")
        self.loop(test, self.statement, step)

    def skipping(self, end: str, parse):
        """Passes over an expression now and returns what reads it later."""
        start, depth = self.at, 0
        while depth or not self.peek(end):
            tok = self.take()
            if tok[0] == "op":
                depth += (tok[1] in "([{") - (tok[1] in ")]}")
        stop = self.at

        def later():
            back, self.at = self.at, start
            if start < stop:
                parse()
            self.at = back

        return later

    def switch(self) -> None:
        self.take()
        self.condition()
        self.take("{")
        head, end = self.f["block"], self.new_block()
        self.f["loops"].append((end, end))
        while not self.has("}"):
            if self.has("default"):
                pass
            else:
                self.take("case")
                self.expression()
            self.take(":")
            case = self.new_block()
            if head is not None:
                self.edges.append((head, case))
            self.go(case)
            while self.t[self.at][1] not in ("case", "default", "}"):
                self.statement()
        self.f["loops"].pop()
        if head is not None:
            self.edges.append((head, end))
        self.go(end)

    # -- expressions: each returns the register of its value

    def expression(self) -> int:
        value = self.assignment()
        while self.has(","):
            value = self.assignment()
        return value

    def assignment(self) -> int:
        if (found := self.arrow()) is not None:
            return found
        at = self.t[self.at]
        if at[0] == "name" and self.t[self.at + 1][1] in ASSIGN and self.t[self.at + 1][0] == "op":
            self.at += 1
            op = self.take()[1]
            value = self.assignment()
            if op != "=":
                value = self.operation("BinaryOperator", at, [self.read(at), value])
            self.node("WriteVariable", at, value_reg=value, name=at[1])
            return value
        value = self.conditional()
        if self.t[self.at][0] == "op" and self.t[self.at][1] in ASSIGN:
            read = self.nodes.pop() if self.nodes[-1]["kind"] == "ReadProperty" and self.nodes[-1]["result_reg"] == value else None
            if read is None:
                raise Unreadable(f"line {at[2]}: nothing to assign to")
            op = self.take()[1]
            if op != "=":
                self.nodes.append(read)
            given = self.assignment()
            if op != "=":
                given = self.operation("BinaryOperator", at, [value, given])
            self.node("WriteProperty", at, base_reg=read["base_reg"], property=read["property"], value_reg=given)
            return given
        return value

    def conditional(self) -> int:
        at = self.t[self.at]
        value = self.binary(1)
        if not self.has("?"):
            return value
        arms: list[int] = []

        def other():
            self.take(":")
            arms.append(self.assignment())

        self.branch(lambda: arms.append(self.assignment()), other)
        return self.operation("BinaryOperator", at, arms)

    def binary(self, least: int) -> int:
        at = self.t[self.at]
        left = self.unary()
        while (strength := BINARY.get(self.t[self.at][1], 0)) >= least and self.t[self.at][0] in ("op", "name"):
            op = self.take()[1]
            if op in ("&&", "||"):
                arms: list[int] = []
                self.branch(lambda s=strength, a=arms: a.append(self.binary(s + 1)))
                right = arms[0]
            else:
                right = self.binary(strength + 1)
            left = self.operation("BinaryOperator", at, [left, right])
        return left

    def unary(self) -> int:
        at = self.t[self.at]
        if at[0] == "op" and at[1] in ("!", "-", "+", "~") or at[0] == "name" and at[1] in ("void", "await", "delete"):
            self.take()
            return self.operation("DeleteProperty" if at[1] == "delete" else "UnaryOperator", at, [self.unary()])
        if self.has("typeof"):
            return self.operation("Typeof", at, [self.unary()])
        if at[0] == "op" and at[1] in ("++", "--"):
            self.take()
            name, value = self.t[self.at], self.unary()
            return self.stepped(at, name, value)
        name = self.t[self.at]
        value = self.postfix()
        if self.t[self.at][0] == "op" and self.t[self.at][1] in ("++", "--") and self.t[self.at][2] == at[2]:
            self.take()
            self.stepped(at, name, value)
        return value

    def stepped(self, at, name, value: int) -> int:
        result = self.operation("BinaryOperator", at, [value])
        last = next((n for n in reversed(self.nodes) if n.get("result_reg") == value), None)
        if last and last["kind"] == "ReadVariable":
            self.node("WriteVariable", at, value_reg=result, name=name[1])
        elif last and last["kind"] == "ReadProperty":
            self.node("WriteProperty", at, base_reg=last["base_reg"], property=last["property"], value_reg=result)
        return result

    def arguments(self) -> list[int]:
        self.take("(")
        out = []
        while not self.has(")"):
            self.has("...")
            out.append(self.assignment())
            self.has(",")
        return out

    def call(self, at, arguments: list[int], **columns) -> int:
        result = self.register()
        row = self.node("Call", at, result_reg=result, **columns)
        self.args += [(row, i, r) for i, r in enumerate(arguments)]
        return result

    def postfix(self) -> int:
        at = self.t[self.at]
        if self.has("new"):
            name = self.member(self.primary(), at)
            return self.member(self.call(at, self.arguments() if self.peek("(") else [], func_reg=name, is_ctor=True), at, True)
        return self.member(self.primary(), at, True)

    def member(self, value: int, at, calls: bool = False) -> int:
        while True:
            if self.has("."):
                value = self.property(value, at, self.word()[1])
            elif self.has("["):
                tok = self.t[self.at]
                fixed = tok[1][1:-1] if tok[0] == "string" and self.t[self.at + 1][1] == "]" else None
                index = self.expression() if fixed is None else self.take() and None
                self.take("]")
                value = self.property(value, at, fixed)
                if index is not None:
                    self.nodes[-1]["property"] = None
            elif calls and self.peek("("):
                last = self.nodes[-1]
                if last["kind"] == "ReadProperty" and last["result_reg"] == value and last["property"] is not None:
                    last["result_reg"] = -1  # read for the call alone
                    value = self.call(at, self.arguments(), base_reg=last["base_reg"], property=last["property"])
                else:
                    value = self.call(at, self.arguments(), func_reg=value)
            else:
                return value

    def property(self, base: int, at, name: str | None) -> int:
        result = self.register()
        self.node("ReadProperty", at, base_reg=base, property=name, result_reg=result)
        return result

    def read(self, at) -> int:
        result = self.register()
        self.node("ReadVariable", at, name=at[1], result_reg=result)
        return result

    def primary(self) -> int:
        at = self.take()
        if at[0] in ("number", "string") or at[0] == "name" and at[1] in CONSTANTS:
            return self.constant(at)
        if at[1] == "function":
            return self.function_from(at, False)
        if at[1] == "new":
            self.at -= 1
            return self.postfix()
        if at[0] == "name":
            return self.read(at)
        if at[1] == "(":
            value = self.expression()
            self.take(")")
            return value
        if at[1] in "[{":
            return self.literal(at)
        raise Unreadable(f"line {at[2]}: {at[1]!r}")

    def constant(self, at) -> int:
        result = self.register()
        self.node("Constant", at, result_reg=result)
        return result

    def literal(self, at) -> int:
        """An array or object: an allocation and a write for each element."""
        result, close, n = self.register(), {"[": "]", "{": "}"}[at[1]], 0
        self.node("NewObject", at, result_reg=result)
        while not self.has(close):
            key, spot = str(n), self.t[self.at]
            if close == "}":
                key = self.take()[1].strip("'\"")
                value = self.assignment() if self.has(":") else self.read(spot)
            elif self.peek(","):
                value = None
            else:
                self.has("...")
                value = self.assignment()
            if value is not None:
                self.node("WriteProperty", spot, base_reg=result, property=key, value_reg=value)
            n += 1
            self.has(",")
        return result


def lower(text: str) -> tuple[list[dict], list[dict], list[tuple[int, int]]]:
    """Functions, nodes (in order, with idx within their block) and block edges of one file; ids count from 0."""
    low = Lowering(text)
    position: dict[int, int] = {}
    by_row = {id(row): [] for row in low.nodes}
    for row, _, reg in low.args:
        by_row[id(row)].append(reg)
    ordered = sorted(low.nodes, key=lambda r: (r["func"], r["block"], not (r["kind"] == "Constant" and r["result_reg"] == 1 and not r.get("hoisted"))))
    out = []
    for i, row in enumerate(ordered):
        position[row["block"]] = position.get(row["block"], 0) + 1
        regs = {k: -1 if row.get(k) is None else row[k] for k in ("result_reg", "base_reg", "value_reg", "func_reg")}
        out.append({"node": i, "idx": position[row["block"]], "args": by_row[id(row)], "name": None, "property": None, "is_ctor": False, "declares": None, **row, **regs})
    if max(len(out), low.block_count) >= SPAN:
        raise Unreadable("too large")
    return low.functions, out, sorted(set(low.edges))


def programs(sources: DataFrame) -> tuple[Program, DataFrame]:
    """The program tables of all sources (program_id, source), and (program_id, error) of those that can't be read."""
    import pandas as pd

    function = "struct<id:long,name:string,outer:long,params:array<string>,vars:array<string>,entry:long,exit:long,line:int,col:int>"
    node = "struct<node:long,func:long,block:long,idx:long,kind:string,result_reg:long,base_reg:long,value_reg:long,func_reg:long,name:string,property:string,is_ctor:boolean,declares:long,line:int,col:int,args:array<long>>"

    def rows(it):
        for pdf in it:
            for program_id, index, source in zip(pdf.program_id, pdf["index"], pdf.source, strict=True):
                try:
                    functions, nodes, edges, error = *lower(source or ""), None
                except (Unreadable, IndexError, RecursionError) as e:
                    functions, nodes, edges, error = [], [], [], str(e) or type(e).__name__
                yield pd.DataFrame({"program_id": [program_id], "index": [index], "error": [error], "functions": [functions], "nodes": [nodes], "edges": [[{"src": a, "dst": b} for a, b in edges]]})

    numbered = indexed(sources.select("program_id", "source"), "program_id")
    read = cut(numbered.mapInPandas(rows, f"program_id string, index long, error string, functions array<{function}>, nodes array<{node}>, edges array<struct<src:long,dst:long>>"))
    base = F.col("index") * SPAN
    at = lambda column: (base + F.col(column)).cast("long")
    functions = read.select("program_id", "index", F.explode("functions").alias("f")).select(
        "program_id", at("f.id").alias("func_id"), "f.name", at("f.outer").alias("outer_func_id"), F.col("f.outer").isNull().alias("is_main"), "f.params", F.array_distinct("f.vars").alias("vars"),
        at("f.entry").alias("entry"), at("f.exit").alias("exit"), "f.line", "f.col",
    )
    every = read.select("index", F.explode("nodes").alias("n"))
    nodes = every.select(
        at("n.func").alias("func_id"), "n.idx", at("n.node").alias("node_id"), "n.kind", "n.result_reg", "n.base_reg", "n.value_reg", "n.func_reg", "n.name", "n.property",
        F.lit(False).alias("is_internal"), "n.is_ctor", at("n.declares").alias("declares"), "n.line", "n.col", at("n.block").alias("block"),
    )
    args = every.select(at("n.node").alias("node_id"), F.posexplode("n.args").alias("position", "reg"))
    blocks = read.select("index", F.explode("edges").alias("e")).select(at("e.src").alias("src"), at("e.dst").alias("dst"))
    nodes, blocks = stored(nodes), stored(blocks)
    return Program(stored(functions), nodes, node_edges(nodes, blocks), stored(args), blocks), read.where("error is not null").select("program_id", "error")


def node_edges(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Control flow between nodes: within blocks, and from a block's last node to the first of each next block that has nodes."""
    own = Window.partitionBy("block").orderBy("idx")
    inside = nodes.select(F.col("node_id").alias("src"), F.lead("node_id").over(own).alias("dst")).where("dst is not null")
    ends = nodes.groupBy("block").agg(F.min_by("node_id", "idx").alias("first"), F.max_by("node_id", "idx").alias("last"))
    empty = blocks.join(ends, blocks.dst == ends.block, "left_anti")
    hop = blocks.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    through = blocks if empty.isEmpty() else fixpoint(blocks, lambda new, _: new.join(ends, new.dst == ends.block, "left_anti").join(hop, "dst").select("src", F.col("next").alias("dst")))
    a, b = ends.select(F.col("block").alias("src"), F.col("last")), ends.select(F.col("block").alias("dst"), F.col("first"))
    return inside.union(through.join(a, "src").join(b, "dst").select(F.col("last").alias("src"), F.col("first").alias("dst"))).distinct()
