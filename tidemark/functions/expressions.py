"""The expression language: parsed once, compiled to Catalyst columns.

    || && == != < > <= >= + - * / unary - and !, calls, names with dots and $, numbers,
    strings in either quote, true and false.

Null rules: arithmetic, comparison and calls give null if any argument is null (both
branches of ``if`` included); ``&&`` and ``||`` give null if their left side is null,
and decide by it alone where they can.  ``x / 0`` is 0.  Unknown names are null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d*)?|\.\d+)|(?P<str>"[^"]*"|'[^']*')|(?P<name>[$A-Za-z_][\w$]*(?:\.[A-Za-z_]\w*)*)|(?P<op>\|\||&&|==|!=|<=|>=|[<>+\-*/!(),]))""")
#: Binding of the infix operators, loosest first.
LEVELS = [["||"], ["&&"], ["==", "!="], ["<", ">", "<=", ">="], ["+", "-"], ["*", "/"]]


class ExpressionError(ValueError):
    """The expression cannot be parsed or does not type-check."""


@dataclass(frozen=True)
class Node:
    kind: str  # num, str, bool, name, unary, binary, call
    value: object
    args: tuple[Node, ...] = ()

    def names(self) -> set[str]:
        own = {self.value} if self.kind == "name" else set()
        return own.union(*[a.names() for a in self.args]) if self.args else own


@dataclass
class Typed:
    """A column and its kind: number, string, bool, time, set, vector or null."""

    column: Column
    kind: str
    extra: dict = field(default_factory=dict)


def tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        found = TOKEN.match(source, at)
        if not found:
            raise ExpressionError(f"unexpected character at {at} in {source!r}")
        out.append((found.lastgroup, found[found.lastgroup]))
        at = found.end()
    return out


def parse(source: str) -> Node:
    """Syntax tree of an expression."""
    items, at = tokens(source), 0

    def peek() -> tuple[str, str]:
        return items[at] if at < len(items) else ("end", "")

    def take(text: str | None = None) -> tuple[str, str]:
        nonlocal at
        got = peek()
        if text is not None and got[1] != text or got[0] == "end":
            raise ExpressionError(f"expected {text or 'a value'} in {source!r}")
        at += 1
        return got

    def level(k: int) -> Node:
        if k == len(LEVELS):
            return unary()
        left = level(k + 1)
        while peek()[0] == "op" and peek()[1] in LEVELS[k]:
            op = take()[1]
            left = Node("binary", op, (left, level(k + 1)))
        return left

    def unary() -> Node:
        if peek() in (("op", "-"), ("op", "!")):
            return Node("unary", take()[1], (unary(),))
        return primary()

    def primary() -> Node:
        kind, text = take()
        if kind == "num":
            return Node("num", float(text))
        if kind == "str":
            return Node("str", text[1:-1])
        if kind == "name":
            if text in ("true", "false"):
                return Node("bool", text == "true")
            if peek() == ("op", "("):
                take("(")
                args = []
                if peek() != ("op", ")"):
                    args.append(level(0))
                    while peek() == ("op", ","):
                        take(",")
                        args.append(level(0))
                take(")")
                return Node("call", text, tuple(args))
            return Node("name", text)
        if (kind, text) == ("op", "("):
            inner = level(0)
            take(")")
            return inner
        raise ExpressionError(f"unexpected {text!r} in {source!r}")

    tree = level(0)
    if peek()[0] != "end":
        raise ExpressionError(f"unexpected {peek()[1]!r} in {source!r}")
    return tree


def _all_known(args: list[Typed], value: Column) -> Column:
    known = None
    for a in args:
        one = a.column.isNotNull()
        known = one if known is None else known & one
    return F.when(known, value) if known is not None else value


def _need(args: list[Typed], kinds: str, what: str) -> None:
    for a in args:
        if a.kind not in (*kinds.split("|"), "null"):
            raise ExpressionError(f"{what} does not take a {a.kind}")


def _number(function: Callable[..., Column]):
    def call(name: str, args: list[Typed]) -> Typed:
        _need(args, "number", name)
        return Typed(_all_known(args, function(*[a.column for a in args])), "number")

    return call


def _len(name: str, args: list[Typed]) -> Typed:
    _need(args, "string|set|vector", name)
    size = F.length(args[0].column) if args[0].kind == "string" else F.size(args[0].column)
    return Typed(_all_known(args, size.cast("double")), "number")


def _words(name: str, args: list[Typed]) -> Typed:
    _need(args, "string", name)
    found = F.size(F.filter(F.split(args[0].column, r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"), lambda w: w != ""))
    return Typed(_all_known(args, found.cast("double")), "number")


def _case(function: Callable[[Column], Column]):
    def call(name: str, args: list[Typed]) -> Typed:
        _need(args, "string", name)
        return Typed(function(args[0].column), "string")

    return call


def _contains(name: str, args: list[Typed]) -> Typed:
    _need(args[:1], "string|set", name)
    _need(args[1:], "string", name)
    has = F.array_contains(args[0].column, args[1].column) if args[0].kind == "set" else args[0].column.contains(args[1].column)
    return Typed(_all_known(args, has), "bool")


def _if(name: str, args: list[Typed]) -> Typed:
    _need(args[:1], "bool", name)
    kinds = {a.kind for a in args[1:]} - {"null"}
    if len(kinds) > 1:
        raise ExpressionError("branches of if differ in kind")
    return Typed(_all_known(args, F.when(args[0].column, args[1].column).otherwise(args[2].column)), kinds.pop() if kinds else "null")


#: Name -> least and most arguments, and the compiler of a call.
FUNCTIONS: dict[str, tuple[int, int, Callable[[str, list[Typed]], Typed]]] = {
    "abs": (1, 1, _number(F.abs)),
    "round": (1, 1, _number(lambda x: F.signum(x) * F.floor(F.abs(x) + 0.5))),
    "sqrt": (1, 1, _number(F.sqrt)),
    "log1p": (1, 1, _number(F.log1p)),
    "min": (1, 8, _number(lambda *x: F.least(*x) if len(x) > 1 else x[0])),
    "max": (1, 8, _number(lambda *x: F.greatest(*x) if len(x) > 1 else x[0])),
    "clamp": (3, 3, _number(lambda x, lo, hi: F.least(F.greatest(x, lo), hi))),
    "lerp": (3, 3, _number(lambda a, b, t: a + (b - a) * t)),
    "len": (1, 1, _len),
    "words": (1, 1, _words),
    "lower": (1, 1, _case(F.lower)),
    "upper": (1, 1, _case(F.upper)),
    "contains": (2, 2, _contains),
    "if": (3, 3, _if),
}


def _divide(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & (b == 0), F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0.0)))


def build(node: Node, env: dict[str, Typed]) -> Typed:
    """The typed column of a tree under named columns."""
    if node.kind == "num":
        return Typed(F.lit(node.value), "number")
    if node.kind == "str":
        return Typed(F.lit(node.value), "string")
    if node.kind == "bool":
        return Typed(F.lit(node.value), "bool")
    if node.kind == "name":
        return env.get(node.value, Typed(F.lit(None), "null"))
    args = [build(a, env) for a in node.args]
    if node.kind == "call":
        if node.value not in FUNCTIONS:
            raise ExpressionError(f"unknown function {node.value}")
        least, most, make = FUNCTIONS[node.value]
        if not least <= len(args) <= most:
            raise ExpressionError(f"{node.value} takes {least} to {most} arguments")
        return make(node.value, args)
    if node.kind == "unary":
        _need(args, "number" if node.value == "-" else "bool", node.value)
        return Typed(-args[0].column if node.value == "-" else ~args[0].column.cast("boolean"), "number" if node.value == "-" else "bool")
    a, b = args
    op = node.value
    if op in ("&&", "||"):
        _need(args, "bool", op)
        left, right = a.column.cast("boolean"), b.column.cast("boolean")
        decided = ~left if op == "&&" else left
        return Typed(F.when(left.isNotNull(), F.when(decided, F.lit(op == "||")).otherwise(right)), "bool")
    if op in ("==", "!="):
        if "null" in (a.kind, b.kind):
            return Typed(F.lit(None).cast("boolean"), "bool")
        if a.kind != b.kind:
            same = _all_known(args, F.lit(False))
        else:
            same = a.column == b.column
        return Typed(same if op == "==" else ~same, "bool")
    if op in ("<", ">", "<=", ">="):
        _need(args, "number|string", op)
        kinds = {a.kind, b.kind} - {"null"}
        if len(kinds) > 1:
            raise ExpressionError(f"{op} compares like with like")
        pick = {"<": a.column < b.column, ">": a.column > b.column, "<=": a.column <= b.column, ">=": a.column >= b.column}
        return Typed(pick[op], "bool")
    if op == "+":
        kinds = {a.kind, b.kind} - {"null"}
        if kinds == {"string"}:
            return Typed(F.concat(a.column, b.column), "string")
        _need(args, "number", op)
        return Typed(a.column + b.column, "number")
    _need(args, "number", op)
    value = {"-": a.column - b.column, "*": a.column * b.column, "/": _divide(a.column, b.column)}[op]
    return Typed(value, "number")


def compile_column(source: str, env: dict[str, Typed]) -> Typed:
    """Typed column of an expression over named columns."""
    return build(parse(source), env)


#: What a numeric expression may call.
NUMERIC = {"abs", "round", "sqrt", "log1p", "min", "max", "clamp", "lerp"}


def check_numeric(node: Node, variable: str) -> None:
    if node.kind == "name" and node.value != variable or node.kind in ("str", "bool"):
        raise ExpressionError(f"only numbers and {variable} are allowed")
    if node.kind == "call" and node.value not in NUMERIC or node.kind == "binary" and node.value not in "+-*/" or node.value == "!":
        raise ExpressionError(f"{node.value} is not numeric")
    for a in node.args:
        check_numeric(a, variable)


def compile_numeric(source: str, variable: str) -> Callable[[Column], Column]:
    """``Column -> Column`` of an expression in one number."""
    tree = parse(source)
    check_numeric(tree, variable)
    return lambda x: build(tree, {variable: Typed(x, "number")}).column


def evaluate_number(source: str, variable: str, x: float) -> float:
    """Value of a numeric expression on the driver, for knobs and presets."""
    import math

    tree = parse(source)
    check_numeric(tree, variable)
    call = {"abs": abs, "round": lambda v: math.copysign(math.floor(abs(v) + 0.5), v), "sqrt": lambda v: math.sqrt(v) if v >= 0 else math.nan, "log1p": math.log1p, "min": min, "max": max, "clamp": lambda v, lo, hi: min(max(v, lo), hi), "lerp": lambda a, b, t: a + (b - a) * t}

    def run(n: Node) -> float:
        if n.kind == "num":
            return n.value
        if n.kind == "name":
            return x
        a = [run(k) for k in n.args]
        if n.kind == "unary":
            return -a[0]
        if n.kind == "call":
            return min(a) if n.value == "min" else max(a) if n.value == "max" else call[n.value](*a)
        return {"+": lambda: a[0] + a[1], "-": lambda: a[0] - a[1], "*": lambda: a[0] * a[1], "/": lambda: a[0] / a[1] if a[1] else 0.0}[n.value]()

    return run(tree)
