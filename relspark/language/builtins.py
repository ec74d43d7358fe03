"""The scalar operators that the text language knows, by name and argument types.

Types are letters: i integer, d float, s string, b boolean, x binary, t datetime, * anything. There is no implicit
conversion: an operator that isn't listed for the arguments' types doesn't exist.
"""

from __future__ import annotations

import operator as py
from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from ..errors import InvalidArgument, KINDS

TYPES = {"i": T.IntegerType(), "d": T.DoubleType(), "s": T.StringType(), "b": T.BooleanType(), "x": T.BinaryType(), "t": T.TimestampNTZType()}


def letter(t: T.DataType) -> str:
    if isinstance(t, (T.LongType, T.IntegerType, T.ShortType)):
        return "i"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "d"
    return next((k for k, v in TYPES.items() if type(v) is type(t)), "*")


#: name -> [(argument types, result type, function of Columns)]
OPERATORS: dict[str, list[tuple[str, str, Callable]]] = {}


def _add(name: str, args: str, result: str, f: Callable) -> None:
    OPERATORS.setdefault(name, []).append((args, result, f))


for _name, _args, _result, _f in [
    ("||", "ss", "s", fn.concat), ("strlen", "s", "i", fn.strlen), ("strlen_b", "s", "i", fn.strlen_b), ("substr", "sii", "s", fn.substr),
    ("substr_b", "sii", "s", fn.substr_b), ("substr_b", "si", "s", fn.substr_b), ("strfind_b", "ss", "i", fn.strfind_b),
    ("strfind_b", "ssi", "i", fn.strfind_b), ("starts_with", "ss", "b", fn.starts_with), ("regex_like", "ss", "b", fn.regex_like),
    ("lower", "s", "s", fn.lower), ("upper", "s", "s", fn.upper),
    ("+", "ii", "i", lambda a, b: a + b), ("-", "ii", "i", lambda a, b: a - b), ("*", "ii", "i", lambda a, b: a * b),
    ("/", "ii", "i", fn.div), ("%", "ii", "i", fn.mod), ("negate", "i", "i", lambda a: -a), ("negate", "d", "d", lambda a: -a),
    ("+", "dd", "d", fn.add_float), ("-", "dd", "d", fn.sub_float), ("*", "dd", "d", fn.mul_float), ("/", "dd", "d", fn.div_float),
    ("abs", "i", "i", fn.abs_), ("abs", "d", "d", fn.abs_), ("sqrt", "d", "d", fn.sqrt), ("sin", "d", "d", fn.sin), ("cos", "d", "d", fn.cos),
    ("atan", "d", "d", fn.atan), ("atan2", "dd", "d", fn.atan2), ("power", "dd", "d", fn.power), ("exp", "d", "d", fn.exp),
    ("ln", "d", "d", fn.ln), ("log", "d", "d", fn.log),
    ("and", "bb", "b", fn.and_), ("or", "bb", "b", fn.or_), ("xor", "bb", "b", fn.xor), ("not", "b", "b", fn.not_),
    ("cast_as_binary", "s", "x", fn.cast_as_binary), ("serialize", "*", "x", fn.serialize),
    ("datetime", "iiiiii", "t", fn.datetime), ("now", "", "t", fn.now), ("now_utc", "", "t", fn.now_utc), ("add_seconds", "ti", "t", fn.add_seconds),
    ("weekday", "t", "i", fn.weekday), ("local_to_utc", "t", "t", fn.local_to_utc),
]:
    _add(_name, _args, _result, _f)
for _names, _from, _result, _f in [
    (("integer", "int"), "ds", "i", fn.cast_as_integer), (("float", "rational", "rat"), "is", "d", fn.cast_as_float), (("string", "char"), "idx", "s", fn.cast_as_string),
]:
    for _n in _names:
        for _a in _from:
            _add(f"cast_as_{_n}", _a, _result, _f)
for _n in ("string", "char"):
    _add(f"cast_as_{_n}", "t", "s", lambda d: fn.cast_as_string(d, datetime=True))
for _n in ("year", "month", "day", "hour", "minute", "second"):
    _add(f"the_{_n}", "t", "i", getattr(fn, _n))
for _n in ("<", "<=", ">", ">="):
    for _a in "idst":
        _add(_n, _a * 2, "b", {"<": py.lt, "<=": py.le, ">": py.gt, ">=": py.ge}[_n])

_INT = range(-(2**31), 2**31)


def _whole(v):
    if v not in _INT:
        raise KINDS["type_constraint_violation_error"]("integer overflow")
    return v


#: The same over Python values, for what loops and conditions of scripts compute most; others are computed by Spark.
FAST: dict[tuple[str, str], Callable] = {
    ("+", "ii"): lambda a, b: _whole(a + b), ("-", "ii"): lambda a, b: _whole(a - b), ("*", "ii"): lambda a, b: _whole(a * b),
    ("||", "ss"): py.add, ("strlen", "s"): len, ("negate", "i"): lambda a: _whole(-a), ("negate", "d"): py.neg, ("and", "bb"): py.and_, ("or", "bb"): py.or_,
    ("xor", "bb"): py.ne, ("not", "b"): py.not_,
    **{(n, a * 2): f for n, f in (("<", py.lt), ("<=", py.le), (">", py.gt), (">=", py.ge)) for a in "it"},
}


def find(name: str, kinds: str):
    """(result type, function) for arguments of these types, or None."""
    for args, result, f in OPERATORS.get(name, ()):
        if len(args) == len(kinds) and all(a in ("*", k) for a, k in zip(args, kinds, strict=True)):
            return result, f
    return None


def index_in(k: int, n: int) -> int:
    if not 0 <= k < n:
        raise InvalidArgument(f"index {k} of an array of {n}")
    return k


__all__ = ["FAST", "OPERATORS", "TYPES", "F", "find", "index_in", "letter"]
