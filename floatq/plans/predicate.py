"""Predicates on one column: equal, not equal, and ranges with 3 x 3 kinds of bounds."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from floatq.functions import fp


class Bound(str, Enum):
    INCLUSIVE = "Inclusive"
    EXCLUSIVE = "Exclusive"
    NONE = "None"


@dataclass(frozen=True)
class Range:
    """From start to end; a bound of kind NONE has no value."""

    start_kind: Bound = Bound.NONE
    start: float | None = None
    end_kind: Bound = Bound.NONE
    end: float | None = None

    def __post_init__(self) -> None:
        for kind, value in ((self.start_kind, self.start), (self.end_kind, self.end)):
            if (kind is Bound.NONE) != (value is None):
                raise ValueError("a bound has a value exactly if it is inclusive or exclusive")

    def to_column(self, v: Column) -> Column:
        out = v.isNotNull()
        if self.start is not None:
            out &= fp.bound(v, self.start, ">=" if self.start_kind is Bound.INCLUSIVE else ">")
        if self.end is not None:
            out &= fp.bound(v, self.end, "<=" if self.end_kind is Bound.INCLUSIVE else "<")
        return out

    def map(self, f: Callable[[float], float]) -> Range:
        return Range(self.start_kind, None if self.start is None else f(self.start), self.end_kind, None if self.end is None else f(self.end))

    def swap(self) -> Range:
        return Range(self.end_kind, self.end, self.start_kind, self.start)


@dataclass(frozen=True)
class Eq:
    value: float

    def to_column(self, v: Column) -> Column:
        return fp.eq(v, self.value)

    def map(self, f: Callable[[float], float]) -> Eq:
        return Eq(f(self.value))


@dataclass(frozen=True)
class Ne:
    value: float

    def to_column(self, v: Column) -> Column:
        return fp.ne(v, self.value)

    def map(self, f: Callable[[float], float]) -> Ne:
        return Ne(f(self.value))


Predicate = Eq | Ne | Range


def at_least(x: float) -> Range:
    return Range(Bound.INCLUSIVE, x)


def above(x: float) -> Range:
    return Range(Bound.EXCLUSIVE, x)


def below(x: float) -> Range:
    return Range(Bound.NONE, None, Bound.EXCLUSIVE, x)


def between(a: float, b: float) -> Range:
    return Range(Bound.INCLUSIVE, a, Bound.INCLUSIVE, b)


def to_json(p: Predicate) -> str:
    """``{"type": ..., "predicate": ...}``; bounds are ``{kind: value}`` or ``"None"``."""
    if isinstance(p, Range):
        side = lambda kind, value: "None" if value is None else {kind.value: value}
        return json.dumps({"type": "Range", "predicate": {"start": side(p.start_kind, p.start), "end": side(p.end_kind, p.end)}})
    return json.dumps({"type": type(p).__name__, "predicate": p.value})


def from_json(text: str) -> Predicate:
    spec = json.loads(text)
    if spec["type"] in ("Eq", "Ne"):
        return {"Eq": Eq, "Ne": Ne}[spec["type"]](float(spec["predicate"]))
    if spec["type"] != "Range":
        raise ValueError(f"unknown predicate type {spec['type']}")
    sides = []
    for name in ("start", "end"):
        side = spec["predicate"].get(name, "None")
        sides += [Bound.NONE, None] if side in ("None", None) else [Bound(next(iter(side))), float(next(iter(side.values())))]
    return Range(*sides)


def rounded(p: Predicate, v: Column, scale: float) -> Column:
    """The predicate on round(v * scale) against its rounded value, as delta codecs compare."""
    import math

    half_away = lambda x: math.copysign(math.floor(abs(x * scale) + 0.5), x)
    return p.map(half_away).to_column(F.round(v * F.lit(float(scale)), 0))


def fixed(p: Predicate, v: Column, fraction_bits: int) -> Column:
    """The predicate on v truncated to so many fraction bits, as byte-sliced codecs compare."""
    unit = float(1 << fraction_bits)
    return p.map(lambda x: float(int(x * unit))).to_column((v * F.lit(unit)).cast("long").cast("double"))
