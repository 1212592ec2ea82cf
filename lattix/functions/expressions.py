"""The arithmetic expressions of pixel operators, compiled to columns.

Numbers, names, ``+ - * / ^ %``, comparisons, ``&& || !``, functions and the constants
``pi`` and ``e``. Everything is DOUBLE; truth is 1 or 0. A missing operand makes
arithmetic missing and comparisons false, but ``!=`` true. What has no finite or
infinite value (division by zero, roots and logarithms out of range) is missing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_][A-Za-z_0-9]*)|(\|\||&&|<=|>=|==|!=|[-+*/^%()<>!,]))")


def _clean(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def _truth(value: Column) -> Column:
    return F.coalesce(value != 0, F.lit(True))  # a missing condition counts as not zero


def _number(condition: Column) -> Column:
    return condition.cast("double")


def _factorial(x: Column) -> Column:
    """Factorials of whole numbers up to 170 from their table."""
    table = F.array(*[F.lit(float(math.factorial(k))) for k in range(171)])
    n = F.floor(x).cast("int")
    return F.when(n.between(0, 170), F.element_at(table, n + 1))


def _combinations(n: Column, r: Column) -> Column:
    n, r = F.floor(n), F.floor(r)
    return F.when((r >= 0) & (n >= r), F.round(_factorial(n) / (_factorial(r) * _factorial(n - r))))


FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    "abs": (1, F.abs),
    "acos": (1, F.acos),
    "asin": (1, F.asin),
    "atan": (1, F.atan),
    "atan2": (2, F.atan2),
    "ceil": (1, lambda x: F.ceil(x).cast("double")),
    "cos": (1, F.cos),
    "cosh": (1, F.cosh),
    "exp": (1, F.exp),
    "fac": (1, _factorial),
    "floor": (1, lambda x: F.floor(x).cast("double")),
    "ln": (1, F.ln),
    "log": (1, F.log10),
    "log10": (1, F.log10),
    "ncr": (2, _combinations),
    "npr": (2, lambda n, r: _combinations(n, r) * _factorial(r)),
    "pow": (2, F.pow),
    "sin": (1, F.sin),
    "sinh": (1, F.sinh),
    "sqrt": (1, F.sqrt),
    "tan": (1, F.tan),
    "tanh": (1, F.tanh),
    "round": (1, F.round),
    "min": (2, lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))),
    "max": (2, lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))),
    "iif": (3, lambda c, a, b: F.when(_truth(c), a).otherwise(b)),
    "isnan": (1, lambda x: _number(x.isNull())),
    "isfinite": (1, lambda x: _number(F.coalesce(F.abs(x) < float("inf"), F.lit(False)))),
}
CONSTANTS = {"pi": math.pi, "e": math.e}

Node = tuple


class _Parser:
    LEVELS = [("||",), ("&&",), ("==", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%")]

    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        stripped = text.rstrip()
        while at < len(stripped):
            m = TOKEN.match(stripped, at)
            if not m:
                raise ValueError(f"cannot read {text!r} at {stripped[at:]!r}")
            self.tokens.append(("number", float(m[1])) if m[1] else ("name", m[2].lower()) if m[2] else ("sign", m[3]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, *signs: str) -> str | None:
        kind, value = self.peek()
        if kind == "sign" and value in signs:
            self.at += 1
            return value
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise ValueError(f"{sign!r} is missing in {self.text!r}")

    def whole(self) -> Node:
        node = self.level(0)
        if self.at < len(self.tokens):
            raise ValueError(f"cannot read {self.text!r} behind token {self.at}")
        return node

    def level(self, k: int) -> Node:
        if k == len(self.LEVELS):
            return self.sign()
        node = self.level(k + 1)
        while op := self.take(*self.LEVELS[k]):
            node = ("op", op, node, self.level(k + 1))
        return node

    def sign(self) -> Node:
        if op := self.take("-", "+", "!"):
            node = self.sign()
            return node if op == "+" else ("unary", op, node)
        return self.power()

    def power(self) -> Node:
        node = self.atom()
        while self.take("^"):
            # from the left; a sign may stand before the exponent
            op = self.take("-", "+")
            right = self.atom()
            node = ("op", "^", node, ("unary", "-", right) if op == "-" else right)
        return node

    def atom(self) -> Node:
        kind, value = self.peek()
        if kind == "number":
            self.at += 1
            return ("number", value)
        if kind == "name":
            self.at += 1
            if value in FUNCTIONS:
                arity = FUNCTIONS[value][0]
                if self.take("("):
                    args = [self.level(0)]
                    while self.take(","):
                        args.append(self.level(0))
                    self.need(")")
                else:
                    args = [self.power()]
                if len(args) != arity:
                    raise ValueError(f"{value} takes {arity} values in {self.text!r}")
                return ("call", value, *args)
            if self.take("("):
                if value in CONSTANTS and self.take(")"):
                    return ("number", CONSTANTS[value])
                raise ValueError(f"unknown function {value!r} in {self.text!r}")
            return ("name", value)
        if self.take("("):
            node = self.level(0)
            self.need(")")
            return node
        raise ValueError(f"a value is missing in {self.text!r}")


def parse_expression(text: str) -> Node:
    """The tree of an expression; names are in lower case."""
    return _Parser(text).whole()


def names_in(node: Node) -> set[str]:
    if node[0] == "name":
        return {node[1]}
    return set().union(*(names_in(x) for x in node[1:] if isinstance(x, tuple)), set())


COMPARISONS = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__, "==": Column.__eq__}


def _column(node: Node, names: Mapping[str, Column], text: str) -> Column:
    kind = node[0]
    if kind == "number":
        return F.lit(node[1])
    if kind == "name":
        if node[1] in names:
            return names[node[1]]
        if node[1] in CONSTANTS:
            return F.lit(CONSTANTS[node[1]])
        raise ValueError(f"unknown variable {node[1]!r} in {text!r}")
    if kind == "unary":
        value = _column(node[2], names, text)
        return -value if node[1] == "-" else _number(F.coalesce(value == 0, F.lit(False)))
    if kind == "call":
        return _clean(FUNCTIONS[node[1]][1](*(_column(x, names, text) for x in node[2:])))
    op, a, b = node[1], _column(node[2], names, text), _column(node[3], names, text)
    if op in COMPARISONS:
        return _number(F.coalesce(COMPARISONS[op](a, b), F.lit(False)))
    if op == "!=":
        return _number(F.coalesce(a != b, F.lit(True)))
    if op == "&&":
        return _number(_truth(a) & _truth(b))
    if op == "||":
        return _number(_truth(a) | _truth(b))
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return _clean(a * b)
    if op == "/":
        return _clean(F.try_divide(a, b))
    if op == "%":
        return _clean(F.try_mod(a, b))
    return _clean(F.pow(a, b))


def compile_expression(text: str, names: Mapping[str, Column]) -> Column:
    """An expression over ``names`` (lower case) as a DOUBLE column."""
    return _column(parse_expression(text), names, text)


def compile_predicate(text: str, names: Mapping[str, Column]) -> Column:
    """Whether an expression is not zero; a missing value counts as not zero."""
    return _truth(compile_expression(text, names))

