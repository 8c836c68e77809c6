"""Condition and arithmetic text of cleaning steps, as Spark columns.

The text follows Python expression syntax, so Python's own ``ast`` reads it. Only names,
constants, comparisons, arithmetic, ``and/or/not`` and ``in [...]`` are mapped; everything
else is refused. Text never reaches ``F.expr``.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BadExpression(ValueError):
    pass


_QUOTED = re.compile(r"('[^']*'|\"[^\"]*\")")
_TICKED = re.compile(r"`([^`]+)`")


def column_of(text: str, df: DataFrame, as_filter: bool = False) -> Column:
    """``text`` as a column of ``df``.

    A comparison with a missing value is false, and ``!=`` is true. As a filter, a null
    already drops the row, so without ``not`` the plain comparison is kept: the scan can
    then use it.
    """
    aliases: dict[str, str] = {}

    def alias(match: re.Match) -> str:
        name = f"ticked_{len(aliases)}"
        aliases[name] = match.group(1)
        return name

    parts = _QUOTED.split(_TICKED.sub(alias, text.strip()))
    plain = [
        p if i % 2 else p.replace("&", " and ").replace("|", " or ").replace("~", " not ")
        for i, p in enumerate(parts)
    ]
    try:
        tree = ast.parse("".join(plain).strip(), mode="eval").body
    except SyntaxError as bad:
        raise BadExpression(f"cannot read {text!r}") from bad
    has_not = any(isinstance(n, ast.Not) for n in ast.walk(tree))
    return _Reader(df, aliases, keep_null=as_filter and not has_not).read(tree)


class _Reader:
    def __init__(self, df: DataFrame, aliases: dict[str, str], keep_null: bool):
        self.df, self.aliases, self.keep_null = df, aliases, keep_null

    def read(self, node: ast.AST) -> Column:
        match node:
            case ast.Name(id=name):
                name = self.aliases.get(name, name)
                if name not in self.df.columns:
                    raise BadExpression(f"unknown column {name!r}")
                return F.col(f"`{name}`")
            case ast.Constant(value=bool() | int() | float() | str() as value):
                return F.lit(value)
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -self.read(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return self.read(x)
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return ~self.read(x)
            case ast.BoolOp(op=op, values=values):
                terms = [self.read(v) for v in values]
                joined = terms[0]
                for t in terms[1:]:
                    joined = joined & t if isinstance(op, ast.And) else joined | t
                return joined
            case ast.BinOp(left=a, op=op, right=b):
                return self.arithmetic(op, self.read(a), self.read(b))
            case ast.Compare(left=first, ops=ops, comparators=rest):
                sides = [first, *rest]
                out = None
                for left, op, right in zip(sides, ops, rest):
                    term = self.compare(op, left, right)
                    out = term if out is None else out & term
                return out
        raise BadExpression(f"{type(node).__name__} is not allowed")

    def compare(self, op: ast.cmpop, left: ast.AST, right: ast.AST) -> Column:
        a = self.read(left)
        if isinstance(op, (ast.In, ast.NotIn)):
            if not isinstance(right, (ast.List, ast.Tuple)):
                raise BadExpression("'in' needs a list")
            inside = F.coalesce(a.isin(*[ast.literal_eval(e) for e in right.elts]), F.lit(False))
            return ~inside if isinstance(op, ast.NotIn) else inside
        b = self.read(right)
        match op:
            case ast.NotEq():
                return ~a.eqNullSafe(b) | (a.isNull() & b.isNull())
            case ast.Eq():
                out = a == b
            case ast.Lt():
                out = a < b
            case ast.LtE():
                out = a <= b
            case ast.Gt():
                out = a > b
            case ast.GtE():
                out = a >= b
            case _:
                raise BadExpression(f"{type(op).__name__} is not allowed")
        return out if self.keep_null else F.coalesce(out, F.lit(False))

    def arithmetic(self, op: ast.operator, a: Column, b: Column) -> Column:
        match op:
            case ast.Add():
                return a + b
            case ast.Sub():
                return a - b
            case ast.Mult():
                return a * b
            case ast.Div():
                return F.try_divide(a.cast("double"), b.cast("double"))
            case ast.FloorDiv():
                return F.floor(F.try_divide(a.cast("double"), b.cast("double")))
            case ast.Mod():
                # the result takes the divisor's sign
                return F.when(b != 0, a - b * F.floor(F.try_divide(a.cast("double"), b.cast("double"))))
            case ast.Pow():
                return F.pow(a, b)
            case ast.BitAnd():
                return a & b
            case ast.BitOr():
                return a | b
        raise BadExpression(f"{type(op).__name__} is not allowed")


def is_number(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)
