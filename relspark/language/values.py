"""Values of the text language: scalars, tuples and arrays, known now or as a Column of the rows at hand."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relation import Relation


@dataclass
class Val:
    """``value`` is a Python value (tuples are dicts, arrays lists) unless there is a Column. ``relation``: a nested relation."""

    t: T.DataType
    value: object = None
    col: Column | None = None
    relation: bool = False

    @property
    def known(self) -> bool:
        return self.col is None

    def column(self) -> Column:
        return literal(self.value, self.t) if self.col is None else self.col


@dataclass
class Correlated:
    """A relation whose condition names attributes of an outer row; only tests and aggregates take it."""

    df: DataFrame
    schema: T.StructType
    range: Range | None = None


@dataclass
class Range:
    """What a correlated condition says that compares one value of each tuple with an attribute of the outer row."""

    frame: Frame
    attribute: str
    order: str
    values: DataFrame


@dataclass
class Frame:
    """The attributes that an expression sees: of a DataFrame's rows, or of an element of a nested relation.

    ``counts``: counts by ranges that the rows are joined with, by the name of their column; None where they can't be.
    """

    attributes: dict[str, T.DataType]
    get: object
    rows: bool = True
    parent: Frame | None = None
    counts: dict[str, Range] | None = None


def struct_type(fields: dict[str, T.DataType]) -> T.StructType:
    """Tuple types list their attributes by name, so that equal headings are equal types."""
    return T.StructType([T.StructField(n, fields[n]) for n in sorted(fields)])


def type_of(value) -> T.DataType:
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.IntegerType() if -(2**31) <= value < 2**31 else T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, (bytes, bytearray)):
        return T.BinaryType()
    if isinstance(value, dt.datetime):
        return T.TimestampNTZType()
    if isinstance(value, dict):
        return struct_type({n: type_of(v) for n, v in value.items()})
    if isinstance(value, list):
        return T.ArrayType(type_of(value[0]) if value else T.NullType())
    raise TypeError(type(value).__name__)


def literal(value, t: T.DataType) -> Column:
    if isinstance(t, T.StructType):
        return F.struct(*[literal(value[f.name], f.dataType).alias(f.name) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return F.array(*[literal(v, t.elementType) for v in value]).cast(t)
    if isinstance(t, T.BinaryType):
        return F.lit(bytearray(value))
    if isinstance(t, T.TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast(t)
    return F.lit(value).cast(t)


def plain(value):
    """Rows as dicts, all the way down."""
    if isinstance(value, Row):
        return {n: plain(v) for n, v in value.asDict().items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return bytes(value) if isinstance(value, bytearray) else value


def default(t: T.DataType):
    """What a variable holds that nothing has been assigned to."""
    if isinstance(t, T.StructType):
        return {f.name: default(f.dataType) for f in t.fields}
    if isinstance(t, T.ArrayType):
        return []
    return {"boolean": False, "string": "", "double": 0.0, "binary": b"", "timestamp_ntz": dt.datetime(1970, 1, 1)}.get(t.simpleString(), 0)


def text(value) -> str:
    """A value as put shows it: text bare, numbers plain, the rest as a selector."""
    return value if isinstance(value, str) else selector(value)


def selector(value) -> str:
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    if isinstance(value, float):
        return f"{value:.6f}" if value == value and abs(value) < 1e15 else str(value)
    if isinstance(value, bytes):
        return f"X'{value.hex()}'"
    if isinstance(value, dt.datetime):
        return value.strftime("%Y-%m-%dT%H:%M:%S")
    if isinstance(value, dict):
        return "TUPLE {" + ", ".join(f"{n} {selector(v)}" for n, v in sorted(value.items())) + "}"
    if isinstance(value, list):
        return "ARRAY (" + ", ".join(map(selector, value)) + ")"
    if isinstance(value, Relation):
        return "RELATION {" + ", ".join(sorted(selector(plain(t)) for t in value.each())) + "}"
    return str(value)
