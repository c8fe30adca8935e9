"""Arithmetic over columns and literals, row by row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from floatq.functions import fp


class Expr:
    def __add__(self, other: object) -> Expr:
        return Binary("+", self, wrap(other))

    def __radd__(self, other: object) -> Expr:
        return Binary("+", wrap(other), self)

    def __sub__(self, other: object) -> Expr:
        return Binary("-", self, wrap(other))

    def __rsub__(self, other: object) -> Expr:
        return Binary("-", wrap(other), self)

    def __mul__(self, other: object) -> Expr:
        return Binary("*", self, wrap(other))

    def __rmul__(self, other: object) -> Expr:
        return Binary("*", wrap(other), self)

    def __truediv__(self, other: object) -> Expr:
        return Binary("/", self, wrap(other))

    def __rtruediv__(self, other: object) -> Expr:
        return Binary("/", wrap(other), self)

    def to_column(self) -> Column:
        raise NotImplementedError

    def columns(self) -> list[str]:
        """Columns it refers to, in order of first use."""
        raise NotImplementedError


@dataclass(frozen=True)
class Col(Expr):
    name: str

    def to_column(self) -> Column:
        return F.col(self.name).cast("double")

    def columns(self) -> list[str]:
        return [self.name]


@dataclass(frozen=True)
class Lit(Expr):
    value: float

    def to_column(self) -> Column:
        return F.lit(float(self.value))

    def columns(self) -> list[str]:
        return []


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr

    def __post_init__(self) -> None:
        if self.op not in "+-*/":
            raise ValueError(f"unknown operator {self.op}")
        if isinstance(self.left, Lit) and isinstance(self.right, Lit):
            raise ValueError("an operation needs a column on one side")

    def to_column(self) -> Column:
        a, b = self.left.to_column(), self.right.to_column()
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: fp.div(a, b)}[self.op]()

    def columns(self) -> list[str]:
        return list(dict.fromkeys([*self.left.columns(), *self.right.columns()]))


def wrap(x: object) -> Expr:
    return x if isinstance(x, Expr) else Lit(float(x))  # type: ignore[arg-type]


def checked(e: Expr) -> Expr:
    """The expression, unless it is a literal alone, which has no rows."""
    if isinstance(e, Lit):
        raise ValueError("a literal alone has no rows")
    return e
