"""Functions as values: closures of column functions, and codecs for user types.

A closure of n arguments takes them one or several at a time and holds what it was given; with all of them it is a
column. Given arrays instead, it is applied elementwise (the lifted form), captured values to every element alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import flat


@dataclass(frozen=True)
class Closure:
    f: Callable[..., Column]
    n: int
    held: tuple = ()

    def __call__(self, *args):
        held = (*self.held, *args)
        if len(held) > self.n:
            raise TypeError(f"{self.n} arguments expected, {len(held)} given")
        return Closure(self.f, self.n, held) if len(held) < self.n else self.f(*(a if isinstance(a, Column) else F.lit(a) for a in held))

    def lifted(self, *arrays: DataFrame) -> DataFrame:
        """Applied to the elements of arrays (pos, v), as many as are still missing."""
        if len(arrays) != self.n - len(self.held):
            raise TypeError(f"{self.n - len(self.held)} arrays expected")
        return flat.zip_with(lambda *v: self(*v), *arrays)


def closure(n: int) -> Callable[[Callable[..., Column]], Closure]:
    """A decorator: a function of n columns as a closure."""
    return lambda f: Closure(f, n)


def scalar_map(f: Callable[[Column], Column], xs: DataFrame) -> DataFrame:
    return Closure(f, 1).lifted(xs)


def scalar_zip_with(f: Callable[..., Column], *arrays: DataFrame) -> DataFrame:
    return Closure(f, len(arrays)).lifted(*arrays)


# --- user types: a product is a struct, a sum a struct of a tag and one field per alternative


def product(**fields: Column) -> Column:
    return F.struct(*(c.alias(name) for name, c in fields.items()))


def variant(chosen: Column, alternatives: dict[str, Column]) -> Column:
    """A sum type: ``chosen`` is the number of the alternative; the fields of all others are null."""
    return F.struct(chosen.cast("int").alias("tag"), *(F.when(chosen == i, c).alias(name) for i, (name, c) in enumerate(alternatives.items())))


def match(value: Column, cases: dict[str, Callable[[Column], Column]]) -> Column:
    """The case of the alternative that ``value`` holds; cases are in the order of the alternatives."""
    out = None
    for i, (name, f) in enumerate(cases.items()):
        hit = value["tag"] == i
        out = F.when(hit, f(value[name])) if out is None else out.when(hit, f(value[name]))
    return out
