"""Aggregates with their values over nothing: COUNT and SUM 0, MAX and MIN the type's least and greatest, ALL true, ANY false.

AVG over nothing is undefined; within SUMMARIZE a group without tuples has 0.0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TypeMismatch

INT_MIN, INT_MAX, FLOAT_MAX = -(2**31), 2**31 - 1, 1.7976931348623157e308


@dataclass(frozen=True)
class Aggregate:
    """A kind of aggregate and its argument."""

    kind: str
    of: Column | None = None

    def column(self) -> Column:
        """The aggregate of a group; NULL where Spark says so."""
        return {"count": lambda _: F.count(F.lit(1)), "sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "all": F.bool_and, "any": F.bool_or}[self.kind](self.of)

    def over_nothing(self, t: T.DataType):
        """The value for no tuples at all, for an argument of this type."""
        whole = isinstance(t, (T.IntegerType, T.LongType, T.ShortType))
        if self.kind in ("sum", "avg", "max", "min") and not (whole or isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType))):
            raise TypeMismatch(f"{self.kind} needs numbers, not {t.simpleString()}")
        if self.kind in ("all", "any") and not isinstance(t, T.BooleanType):
            raise TypeMismatch(f"{self.kind} needs truth values, not {t.simpleString()}")
        return {"count": 0, "sum": 0, "avg": 0.0, "max": INT_MIN if whole else -FLOAT_MAX, "min": INT_MAX if whole else FLOAT_MAX, "all": True, "any": False}[self.kind]


def _column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def COUNT() -> Aggregate:
    return Aggregate("count")


def SUM(x) -> Aggregate:
    return Aggregate("sum", _column(x))


def AVG(x) -> Aggregate:
    return Aggregate("avg", _column(x))


def MAX(x) -> Aggregate:
    return Aggregate("max", _column(x))


def MIN(x) -> Aggregate:
    return Aggregate("min", _column(x))


def ALL(x) -> Aggregate:
    return Aggregate("all", _column(x))


def ANY(x) -> Aggregate:
    return Aggregate("any", _column(x))


# over relation-valued attributes


def nested_count(rva) -> Column:
    return F.size(rva)


def nested_sum(rva, of) -> Column:
    """``of``: from an element to a number."""
    return F.aggregate(F.transform(rva, of), F.lit(0).cast("long"), lambda a, x: a + x)


def nested_max(rva, of) -> Column:
    return F.array_max(F.transform(rva, of))


def nested_min(rva, of) -> Column:
    return F.array_min(F.transform(rva, of))


def nested_avg(rva, of) -> Column:
    total = F.aggregate(F.transform(rva, lambda x: of(x).cast("double")), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(rva) > 0, total / F.size(rva)).otherwise(F.raise_error(F.lit("aggregate_undefined_error")).cast("double"))


def nested_all(rva, of) -> Column:
    return F.forall(rva, of)


def nested_any(rva, of) -> Column:
    return F.exists(rva, of)


@dataclass(frozen=True)
class Nested:
    """An aggregate over a relation-valued attribute's tuples; ``of``: from a tuple to what is aggregated."""

    kind: str
    rva: str
    of: Callable[[Column], Column] | None = None

    def column(self) -> Column:
        """From the nested relation."""
        rva = F.col(f"`{self.rva}`")
        if self.kind == "count":
            return nested_count(rva)
        return {"sum": nested_sum, "avg": nested_avg, "max": nested_max, "min": nested_min, "all": nested_all, "any": nested_any}[self.kind](rva, self.of)

    def beside(self, one: Column) -> Column:
        """The same value as an aggregate of the tuples that a group is nested from, at least one; ``one``: such a tuple."""
        if self.kind == "count":
            return F.count(F.lit(1)).cast("int")
        value = self.of(one)
        return Aggregate(self.kind, value.cast("double") if self.kind == "avg" else value).column()
