"""Type names and Spark types. Headings are compared as sets of (name, type); nothing is converted silently."""

from __future__ import annotations

from pyspark.sql import types as T

from .errors import TypeMismatch, TypeNotFound

#: Scalar types by name; synonyms after them.
SCALARS = {
    "boolean": T.BooleanType(), "integer": T.IntegerType(), "float": T.DoubleType(), "string": T.StringType(),
    "binary": T.BinaryType(), "datetime": T.TimestampNTZType(), "long": T.LongType(),
    "bool": T.BooleanType(), "int": T.IntegerType(), "rational": T.DoubleType(), "rat": T.DoubleType(), "char": T.StringType(),
}
ORDERED = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.StringType, T.TimestampNTZType, T.TimestampType)


def spark_type(name: str) -> T.DataType:
    try:
        return SCALARS[name.lower()]
    except KeyError:
        raise TypeNotFound(name) from None


def type_name(t: T.DataType) -> str:
    """The name of a type: tuples and relations with their attributes in order of name."""
    if isinstance(t, T.StructType):
        return f"TUPLE{{{_attributes(t)}}}"
    if isinstance(t, T.ArrayType):
        return f"RELATION{{{_attributes(t.elementType)}}}" if isinstance(t.elementType, T.StructType) else f"ARRAY {type_name(t.elementType)}"
    for name, other in SCALARS.items():
        if type(other) is type(t):
            return name
    return t.simpleString()


def _attributes(t: T.StructType) -> str:
    return ", ".join(f"{f.name} {type_name(f.dataType)}" for f in sorted(t.fields, key=lambda f: f.name))


def heading(schema: T.StructType) -> dict[str, str]:
    return {f.name: type_name(f.dataType) for f in schema.fields}


def same_heading(a: T.StructType, b: T.StructType, what: str) -> None:
    if heading(a) != heading(b):
        raise TypeMismatch(f"{what}: headings {heading(a)} and {heading(b)} differ")


def ordered(t: T.DataType) -> bool:
    return isinstance(t, ORDERED)
