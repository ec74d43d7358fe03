"""Scalar operators. Where Spark would give NULL, NaN, infinity or a cut value, these raise the language's error.

All of them are built from JVM functions; errors are raised in the plan by ``raise_error``, so they stay in code generation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "abs_", "add_float", "add_seconds", "and_", "array_", "array_at", "array_length", "atan", "atan2", "cast_as_binary", "cast_as_float",
    "cast_as_integer", "cast_as_string", "concat", "cos", "datetime", "day", "div", "div_float", "exp", "finite", "format_", "glob_regex",
    "hour", "if_then_else", "index_of", "like", "ln", "local_to_utc", "log", "lower", "minute", "mod", "month", "mul_float", "not_", "now",
    "now_utc", "or_", "power", "regex_like", "second", "serialize", "set_component", "sin", "sqrt", "starts_with", "strfind_b", "strlen", "strlen_b", "sub_float",
    "posix_regex", "substr", "substr_b", "tuple_", "tuple_at", "tuple_extend", "tuple_project", "tuple_remove", "tuple_rename", "tuple_union", "upper", "weekday", "xor", "year",
]


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _fail(error: str, kind: str) -> Column:
    return F.raise_error(F.lit(error)).cast(kind)


def guarded(good: Column, value: Column, kind: str, error: str = "invalid_argument_error") -> Column:
    """``value`` where ``good`` holds; else the error is raised."""
    return F.when(good, value).otherwise(_fail(error, kind))


# strings


def concat(a, b) -> Column:
    return F.concat(_c(a), _c(b))


def strlen(s) -> Column:
    """Length in code points."""
    return F.char_length(_c(s))


def strlen_b(s) -> Column:
    """Length in bytes of UTF-8."""
    return F.octet_length(_c(s))


def substr(s, start, length) -> Column:
    """Code points from ``start`` (0-based); a range outside the string is an error."""
    s, start, length = _c(s), _c(start), _c(length)
    n = F.char_length(s)
    return guarded((start >= 0) & (length >= 0) & (start < n) & (start + length <= n), F.substring(s, start + 1, length), "string")


def substr_b(s, start, length=None) -> Column:
    """Bytes from ``start`` (0-based), to the end if no length is given; a range outside the string is an error."""
    data = F.encode(_c(s), "UTF-8")
    start, n = _c(start), F.octet_length(_c(s))
    length = n - start if length is None else _c(length)
    return guarded((start >= 0) & (length >= 0) & (start <= n) & (start + length <= n), F.decode(F.substring(data, start + 1, length), "UTF-8"), "string")


def strfind_b(s, what, at=None) -> Column:
    """Byte offset of the first occurrence, or -1; from byte ``at`` on, which must lie in the string."""
    s, what = _c(s), _c(what)
    if at is None:
        return F.when(F.instr(s, what) > 0, F.octet_length(F.substring(s, F.lit(1), F.instr(s, what) - 1))).otherwise(F.lit(-1))
    at = _c(at)
    rest = substr_b(s, at)
    found = strfind_b(rest, what)
    return guarded((at >= 0) & (at <= F.octet_length(s)), F.when(found >= 0, found + at).otherwise(F.lit(-1)), "int")


def starts_with(s, prefix) -> Column:
    return F.startswith(_c(s), _c(prefix))


#: Named character classes and Java's names of them.
POSIX = {
    "alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}",
    "graph": r"\p{Graph}", "print": r"\p{Print}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "xdigit": r"\p{XDigit}", "space": r"\s",
}


def posix_regex(pattern: str) -> str:
    """A pattern with named classes inside brackets in Java's notation; there, brackets, && and backslashes are escaped."""

    def bracket(m: re.Match) -> str:
        negated, first, body = m[1], m[2], m[3]
        out = []
        for part in re.split(r"(\[:[a-z]+:\])", body):
            if part[:2] == "[:" and part[2:-2] in POSIX:
                out.append(POSIX[part[2:-2]])
            else:
                out.append(re.sub(r"([\[&\\])", r"\\\1", part))
        return f"[{negated}{'\\]' if first else ''}{''.join(out)}]"

    return re.sub(r"(?<!\\)\[(\^?)(\]?)((?:\[:[a-z]+:\]|[^\]])*)\]", bracket, pattern)


def glob_regex(pattern: str) -> str:
    """The anchored regular expression of a glob: ? one character, * any run, [..] a class; nothing escapes."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", k + 2 + (pattern[k + 1 : k + 2] in ("!", "^")))) > 0:
            body = pattern[k + 1 : end]
            negated = body[0] in "!^"
            body = re.sub(r"([\\\[\]&^])", r"\\\1", body[negated:])
            out.append(f"[{'^' if negated else ''}{body}]")
            k = end
        else:
            out.append(re.escape(c))
        k += 1
    return f"(?s)^{''.join(out)}\\z"


def like(s, pattern) -> Column:
    """Whether a glob fits the whole string; one that rows give is translated in the plan."""
    if isinstance(pattern, str):
        return _c(s).rlike(glob_regex(pattern))
    p = F.regexp_replace(pattern, r"([\\.^$|(){}+&])", r"\\$1")
    for old, new in ((r"\[(?![!^]?.[^\]]*\])", r"\\["), (r"\[(?:!|\\\^)", "[^"), (r"\*", ".*"), (r"\?", ".")):
        p = F.regexp_replace(p, old, new)
    return F.rlike(_c(s), F.concat(F.lit("(?s)^"), p, F.lit("\\z")))


def regex_like(s, pattern) -> Column:
    """Whether the pattern is found anywhere; classes such as [:digit:] are of ASCII."""
    return F.rlike(_c(s), F.lit(posix_regex(pattern)) if isinstance(pattern, str) else _c(pattern))


def lower(s) -> Column:
    return F.lower(_c(s))


def upper(s) -> Column:
    return F.upper(_c(s))


def format_(pattern: str, *args) -> Column:
    """printf; %u shows an integer as an unsigned 32-bit number."""
    out, args, k = [], [_c(a) for a in args], 0
    for m in re.finditer(r"%[-+ 0#]*\d*(?:\.\d+)?[doxXuseEfgG%]|[^%]+|%", pattern):
        spec = m[0]
        if spec[0] == "%" and spec[-1] == "u":
            args[k] = args[k].cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
            spec = spec[:-1] + "d"
        if spec[0] == "%" and len(spec) > 1 and spec != "%%":
            k += 1
        out.append(spec)
    return F.format_string("".join(out), *args)


# numbers


def finite(value: Column) -> Column:
    """A float that is neither infinite nor NaN nor NULL, or an error."""
    return guarded(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), value, "double")


def add_float(a, b) -> Column:
    return finite(_c(a) + _c(b))


def sub_float(a, b) -> Column:
    return finite(_c(a) - _c(b))


def mul_float(a, b) -> Column:
    return finite(_c(a) * _c(b))


def div_float(a, b) -> Column:
    return finite(F.try_divide(_c(a), _c(b)))


def div(a, b) -> Column:
    """Integer division that truncates, 64 bits wide; by zero it is an error."""
    a, b = _c(a), _c(b)
    some = F.when(b == 0, F.lit(1)).otherwise(b)
    return guarded(b != 0, F.call_function("div", a, some), "long")


def mod(a, b) -> Column:
    """Remainder with the dividend's sign."""
    a, b = _c(a), _c(b)
    return guarded(b != 0, a % F.when(b == 0, F.lit(1)).otherwise(b), "int")


def abs_(a) -> Column:
    return F.abs(_c(a))


def sqrt(a) -> Column:
    return guarded(_c(a) >= 0, F.sqrt(_c(a)), "double")


def sin(a) -> Column:
    return F.sin(_c(a))


def cos(a) -> Column:
    return F.cos(_c(a))


def atan(a) -> Column:
    return F.atan(_c(a))


def atan2(y, x) -> Column:
    return F.atan2(_c(y), _c(x))


def power(base, x) -> Column:
    return finite(F.pow(_c(base), _c(x)))


def exp(a) -> Column:
    return F.exp(_c(a))


def ln(a) -> Column:
    return finite(F.ln(_c(a)))


def log(a) -> Column:
    """Base 10."""
    return finite(F.log10(_c(a)))


# truth values and conversion


def and_(a, b) -> Column:
    return _c(a) & _c(b)


def or_(a, b) -> Column:
    return _c(a) | _c(b)


def xor(a, b) -> Column:
    return _c(a) != _c(b)


def not_(a) -> Column:
    return ~_c(a)


def if_then_else(test, yes, no) -> Column:
    return F.when(_c(test), _c(yes)).otherwise(_c(no))


def cast_as_integer(a) -> Column:
    """Floats are truncated; what is out of range or not a number, blanks included, is an error."""
    a = _c(a)
    return F.when(_blank(a), _fail("invalid_argument_error", "int")).otherwise(a.cast("int"))


def _blank(a: Column) -> Column:
    """Whether a string's number would have white space around it."""
    return a.cast("string").rlike(r"^\s|\s$")


def cast_as_float(a) -> Column:
    return _c(a).cast("double")


def cast_as_string(a, datetime: bool = False) -> Column:
    return F.date_format(_c(a), "yyyy-MM-dd'T'HH:mm:ss") if datetime else _c(a).cast("string")


def cast_as_binary(s) -> Column:
    return F.encode(_c(s), "UTF-8")


def serialize(a) -> Column:
    """A value with its type as bytes (JSON)."""
    return F.encode(F.to_json(F.struct(F.typeof(_c(a)).alias("type"), _c(a).alias("value"))), "UTF-8")


# date and time

_PARTS = ("year", "month", "day", "hour", "minute", "second")


def datetime(year, month, day, hour, minute, second) -> Column:
    """Fields out of range are an error."""
    return F.make_timestamp_ntz(_c(year), _c(month), _c(day), _c(hour), _c(minute), _c(second))


def year(d) -> Column:
    return F.year(_c(d))


def month(d) -> Column:
    return F.month(_c(d))


def day(d) -> Column:
    return F.dayofmonth(_c(d))


def hour(d) -> Column:
    return F.hour(_c(d))


def minute(d) -> Column:
    return F.minute(_c(d))


def second(d) -> Column:
    return F.second(_c(d))


def set_component(d, part: str, value) -> Column:
    """The datetime with one component replaced."""
    get = dict(zip(_PARTS, (year, month, day, hour, minute, second), strict=True))
    return datetime(*[_c(value) if p == part else get[p](d) for p in _PARTS])


def now() -> Column:
    return F.date_trunc("second", F.localtimestamp()).cast("timestamp_ntz")


def now_utc() -> Column:
    return F.date_trunc("second", F.to_utc_timestamp(F.localtimestamp(), F.current_timezone())).cast("timestamp_ntz")


def add_seconds(d, n) -> Column:
    return F.timestamp_add("SECOND", _c(n), _c(d))


def weekday(d) -> Column:
    """Days since Sunday."""
    return F.dayofweek(_c(d)) - 1


def local_to_utc(d) -> Column:
    return F.to_utc_timestamp(_c(d), F.current_timezone()).cast("timestamp_ntz")


# tuples and arrays


def tuple_(**attributes) -> Column:
    return F.struct(*[_c(v).alias(k) for k, v in attributes.items()])


def tuple_at(t, name: str) -> Column:
    return _c(t).getField(name)


def tuple_project(t, names: list[str]) -> Column:
    return F.struct(*[_c(t).getField(n).alias(n) for n in names])


def tuple_remove(t, names: list[str]) -> Column:
    return _c(t).dropFields(*names)


def tuple_rename(t, names: list[str], renamed: dict[str, str]) -> Column:
    """``names``: the tuple's attributes."""
    return F.struct(*[_c(t).getField(n).alias(renamed.get(n, n)) for n in names])


def tuple_extend(t, **attributes) -> Column:
    for k, v in attributes.items():
        t = _c(t).withField(k, _c(v))
    return t


def tuple_union(a, a_names: list[str], b, b_names: list[str]) -> Column:
    """Both tuples' attributes; common ones must be equal."""
    common = [n for n in a_names if n in b_names]
    merged = F.struct(*[_c(a).getField(n).alias(n) for n in a_names], *[_c(b).getField(n).alias(n) for n in b_names if n not in common])
    for n in common:
        merged = F.when(_c(a).getField(n) == _c(b).getField(n), merged).otherwise(F.when(F.raise_error(F.lit("invalid_argument_error")).isNull(), merged))
    return merged


def array_(*items) -> Column:
    return F.array(*map(_c, items))


def array_at(a, k) -> Column:
    """0-based; out of range it is an error."""
    return _c(a)[_c(k)]


def array_length(a) -> Column:
    return F.size(_c(a))


def index_of(a, x) -> Column:
    """The first index of a value, or -1."""
    return (F.array_position(_c(a), _c(x)) - 1).cast("int")
