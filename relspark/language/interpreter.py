"""Sessions: scripts and expressions of the text language over a database, evaluated as DataFrame plans.

An expression over rows becomes one Column; relations stay lazy until a statement needs a value. An operator that a
program defines is expanded into the plan when its arguments are Columns, so no Python runs on executors.
"""

from __future__ import annotations

import ast
import contextlib
import math
import os
import re
import sys
import time
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from ..database import SERIAL, Change, Database, View
from ..errors import KINDS, ElementExists, InvalidArgument, InUse, NameUnknown, NotFound, NotSupported, OperatorNotFound, RelError, TypeMismatch
from ..operators.aggregates import Aggregate
from ..operators.relation import Relation, canonical, dee, dum
from ..sources import form_to_tuple, hescape, table
from ..types import spark_type, type_name
from ..userdefined import Operator, UserType
from . import builtins
from .syntax import parse_expression, parse_script
from .values import Correlated, Frame, Range, Val, default, literal, plain, selector, struct_type, text, type_of

#: Comparisons, and what they are with their sides exchanged.
_TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
#: Calls within calls: of operators over values, and of operators expanded into a plan.
_DEEPEST, _DEEPEST_PLAN = 500, 25


class _Return(Exception):  # noqa: N818
    def __init__(self, value) -> None:
        self.value = value


class _Leave(Exception):  # noqa: N818
    def __init__(self, label) -> None:
        self.label = label


class Raised(RelError):
    """An error that a program raised, or caught: ``value`` has its type's name and message."""

    def __init__(self, value: dict) -> None:
        super().__init__(value.get("msg", ""))
        self.value, self.name = value, value["__error"]


def error_value(e: BaseException) -> dict:
    """The language's error for one of Python's or Spark's."""
    if isinstance(e, Raised):
        return e.value
    if isinstance(e, RelError):
        return {"__error": e.name, "msg": str(e)}
    message = str(e)
    named = [n for n in re.findall(r"\w+_error", message) if n in KINDS]
    if named:
        return {"__error": named[0], "msg": message}
    kind = "type_constraint_violation_error" if "OVERFLOW" in message and "CAST" not in message else "invalid_argument_error"
    return {"__error": kind, "msg": message}


#: Statements that a reopened database runs again.
_DEFINING = frozenset(["view", "constraint", "operator", "type", "implement", "package", "map", "drop"])


class _Type:
    """A declared type: a Spark type, and whether it is a relation's or an operator's."""

    def __init__(self, t, relation: bool = False, operator: bool = False, user: UserType | None = None) -> None:
        self.t, self.relation, self.operator, self.user = t, relation, operator, user


class Session:
    def __init__(self, spark: SparkSession, db: Database | None = None, lines: list[str] | None = None) -> None:
        """``lines``: what io.get_line reads. What scripts print is in ``output``."""
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 40 * _DEEPEST))
        self.spark, self.db = spark, db or Database(spark)
        self.lines, self.output = list(lines or []), []
        self.scopes: list[dict[str, object]] = [{"current_db": Val(T.StringType(), self.db.name)}]
        self.constants: set[str] = set()
        self.ops: dict[str, list[dict]] = {}
        self.before: Database | None = None
        self._outer = False
        self._depth = 0
        self._package = ""
        for s in map(ast.literal_eval, self.db.definitions):
            if s[0] == "drop":  # of a variable, the catalog knows already
                with contextlib.suppress(RelError):
                    self.run(s)
            else:
                self.run(s)

    # the host's side

    def execute(self, script: str) -> str:
        """Run statements; gives what they printed."""
        start = len(self.output)
        for s in parse_script(script):
            self.run(s)
            if s[0] in _DEFINING and self.db.path:
                self.db.define(repr(s))
        return "".join(self.output[start:])

    def evaluate(self, expression: str):
        """A Relation, or a Python value."""
        return self.host(self.eval(parse_expression(expression)))

    def host(self, v):
        return self.force(v).value if isinstance(v, Val) else v

    def set_var(self, name: str, value) -> None:
        self.scopes[0][name] = value if isinstance(value, (Relation, Val)) else Val(type_of(value), value)

    def attach(self, folder: str, *names: str, keys: dict | None = None) -> Session:
        """Parquet tables as read-only names, without copying them; ``keys``: candidate keys by name."""
        for n in names:
            self.scopes[0][n] = table(self.spark, folder, n, (keys or {}).get(n))
        return self

    # names and types

    def lookup(self, name: str, scope: Frame | None):
        outer, f = False, scope
        while f:
            if name in f.attributes:
                c = f.get(name)
                self._outer |= outer
                return Val(f.attributes[name], col=c.outer() if outer else c)
            outer |= f.rows
            f = f.parent
        for s in (self.scopes[-1], self.scopes[0]):
            if name in s:
                v = s[name]
                if isinstance(v, Val) and not v.known and scope is not None:
                    raise NotSupported(f"parameter {name} inside a nested condition")
                return v
        if name.endswith("'") and self.before is not None:
            return self.before[name[:-1]]
        if name in self.ops:
            return self.ops[name]
        return self.db[name]

    def declared(self, t, scope=None) -> _Type:
        kind = t[0]
        if kind == "scalar":
            user = self.db.user_types.get(t[1]) or self.db.user_types.get(f"{self._package}{t[1]}")
            if user:
                return _Type(self.user_type(user), user=user)
            return _Type(T.StructType() if t[1] in KINDS else spark_type(t[1]))
        if kind == "array":
            return _Type(T.ArrayType(self.declared(t[1]).t))
        if kind in ("tuple", "relation"):
            fields = {n: self.nested(a) for n, a in t[1] if n != "*"}
            return _Type(struct_type(fields), relation=kind == "relation")
        if kind == "operator":
            return _Type(None, operator=True)
        v = self.eval(t[-1], scope)
        if kind == "same_type":
            return _Type(v.df.schema if isinstance(v, Relation) else v.t, relation=isinstance(v, Relation))
        schema = v.df.schema if isinstance(v, Relation) else v.t.elementType if isinstance(v.t, T.ArrayType) else v.t
        return _Type(struct_type({f.name: f.dataType for f in schema.fields}), relation=t[1] == "relation")

    def nested(self, t) -> T.DataType:
        d = self.declared(t)
        return T.ArrayType(d.t) if d.relation else d.t

    @staticmethod
    def user_type(u: UserType) -> T.DataType:
        parts = {c: spark_type(t) if isinstance(t, str) else t for c, t in u.first.items()}
        return next(iter(parts.values())) if u.bare else T.StructType([T.StructField("__type", T.StringType()), *[T.StructField(c, t) for c, t in parts.items()]])

    # values

    def force(self, v: Val) -> Val:
        """The value, computed by Spark if need be."""
        if not isinstance(v, Val) or v.known:
            return v
        row = self.spark.range(1).select(v.col.alias("v")).first()
        return Val(v.t, plain(row[0]), relation=v.relation)

    def known(self, node, scope=None):
        return self.force(self.eval(node, scope)).value

    def truth(self, node) -> bool:
        v = self.known(node)
        if not isinstance(v, bool):
            raise TypeMismatch("a truth value is needed")
        return v

    @staticmethod
    def sealed(r: Relation, scope: Frame | None) -> DataFrame:
        """Rows for a condition that may name an outer row's attributes.

        Without the alias, Spark would first look for such a name among attributes that the rows had before a projection.
        """
        return r.df if scope is None else r.df.alias("__inner")

    def as_relation(self, v) -> Relation:
        if isinstance(v, Relation):
            return v
        if isinstance(v, Val) and v.known and isinstance(v.t, T.ArrayType):
            return self.literal_relation(v.value, v.t.elementType)
        raise TypeMismatch("a relation is needed")

    def literal_relation(self, rows: list[dict], schema: T.StructType) -> Relation:
        if not schema.fields:
            return dee(self.spark) if rows else dum(self.spark)
        return Relation(self.spark.createDataFrame([tuple(r[n] for n in schema.names) for r in rows], schema), distinct=False)

    def nest(self, v) -> Val:
        """A relation as an attribute value; one that isn't known yet is a scalar subquery."""
        if not isinstance(v, Relation):
            return v
        t = struct_type({f.name: f.dataType for f in v.df.schema.fields})
        one = v.df.agg(canonical(F.collect_set(F.struct(*[F.col(f"`{n}`") for n in t.names]))).alias("v"))
        return Val(T.ArrayType(t), col=one.scalar(), relation=True)

    def frame(self, schema: T.StructType, scope: Frame | None) -> Frame:
        return Frame({f.name: f.dataType for f in schema.fields}, lambda n: F.col(f"`{n}`"), True, scope)

    def over(self, node, schema: T.StructType, scope: Frame | None = None) -> Val:
        """An expression over rows of a schema."""
        v = self.nest(self.eval(node, self.frame(schema, scope)))
        if isinstance(v, Correlated):
            raise NotSupported("a correlated relation as a value")
        return v

    def over_rows(self, r: Relation, nodes, scope: Frame | None) -> tuple[Relation, list[Val]]:
        """Expressions over a relation's rows, and the rows with the counts by ranges that they take."""
        frame = self.frame(r.df.schema, scope)
        frame.counts = {}
        found = [self.nest(self.eval(x, frame)) for x in nodes]
        if any(isinstance(v, Correlated) for v in found):
            raise NotSupported("a correlated relation as a value")
        if frame.counts and r.is_empty():  # no tuple is counted for, so none may raise an error
            return Relation(r.df.withColumns({name: F.lit(0).cast("long") for name in frame.counts}), r.keys), found
        for name, c in frame.counts.items():
            r = r.count_values(c.order, c.attribute, c.values, name)
        return r, found

    # expressions

    def eval(self, node, scope: Frame | None = None):
        return getattr(self, f"e_{node[0]}", self.e_relational)(node, scope)

    def e_literal(self, n, scope):
        return Val(type_of(n[1]), n[1])

    def e_name(self, n, scope):
        return self.lookup(n[1], scope)

    def e_nullary(self, n, scope):
        return dee(self.spark) if n[1] else dum(self.spark)

    def e_if(self, n, scope):
        (test,) = self.scalars(n[1:2], scope)
        if not isinstance(test.t, T.BooleanType):
            raise TypeMismatch("IF needs a truth value")
        if test.known:
            return self.eval(n[2] if test.value else n[3], scope)
        yes, no = (self.nest(self.eval(x, scope)) for x in n[2:4])
        self.same(yes.t, no.t)
        return Val(yes.t, col=F.when(test.col, yes.column()).otherwise(no.column()), relation=yes.relation)

    def e_with(self, n, scope):
        self.scopes.append({**self.scopes[-1]})
        try:
            for name, e in n[1]:
                self.scopes[-1][name] = self.eval(e, scope)
            return self.eval(n[2], scope)
        finally:
            self.scopes.pop()

    @staticmethod
    def same(a: T.DataType, b: T.DataType) -> None:
        if builtins.letter(a) != builtins.letter(b) or (builtins.letter(a) == "*" and type_name(a).replace("long", "integer") != type_name(b).replace("long", "integer")):
            raise TypeMismatch(f"{type_name(a)} and {type_name(b)}")

    def scalars(self, nodes, scope) -> list[Val]:
        found = [self.nest(self.eval(x, scope)) for x in nodes]
        if any(not isinstance(v, Val) for v in found):
            raise TypeMismatch("a scalar, tuple or array is needed")
        return found

    def e_tuple(self, n, scope):
        values = dict(zip([a for a, _ in n[1]], self.scalars([e for _, e in n[1]], scope), strict=True))
        if len(values) != len(n[1]):
            raise InvalidArgument("an attribute occurs twice")
        return self.make_tuple(values)

    @staticmethod
    def make_tuple(values: dict[str, Val]) -> Val:
        t = struct_type({a: v.t for a, v in values.items()})
        if all(v.known for v in values.values()):
            return Val(t, {a: values[a].value for a in t.names})
        return Val(t, col=F.struct(*[values[a].column().alias(a) for a in t.names]))

    def e_array(self, n, scope):
        items = self.scalars(n[2], scope)
        t = self.declared(n[1]).t if n[1] else items[0].t if items else None
        if t is None:
            raise TypeMismatch("an array without elements needs a type")
        for v in items:
            self.same(v.t, t)
        if all(v.known for v in items):
            return Val(T.ArrayType(t), [v.value for v in items])
        return Val(T.ArrayType(t), col=F.array(*[v.column() for v in items]))

    def e_relation(self, n, scope):
        items = self.scalars(n[2], scope)
        if n[1] is None and not items:
            raise TypeMismatch("a relation without tuples needs a heading")
        t = struct_type({a: self.nested(k) for a, k in n[1]}) if n[1] is not None else items[0].t
        for v in items:
            self.same(v.t, t)
        if scope is None:
            return self.literal_relation([self.force(v).value for v in items], t)
        return Val(T.ArrayType(t), col=canonical(F.array(*[v.column() for v in items]).cast(T.ArrayType(t))), relation=True)

    def e_to_tuple(self, n, scope):
        r = self.as_relation(self.eval(n[1], scope))
        return Val(struct_type({f.name: f.dataType for f in r.df.schema.fields}), plain(r.to_tuple()))

    def e_subscript(self, n, scope):
        a, k = self.scalars(n[1:3], scope)
        if isinstance(a.t, T.StructType):
            return self.component(a, self.force(k).value)
        if not isinstance(a.t, T.ArrayType) or builtins.letter(k.t) != "i":
            raise TypeMismatch("only arrays and tuples have elements")
        if a.known and k.known:
            return Val(a.t.elementType, a.value[builtins.index_in(k.value, len(a.value))])
        return Val(a.t.elementType, col=fn.array_at(a.column(), k.column()))

    def e_dot(self, n, scope):
        try:
            left = self.eval(n[1], scope)
        except NameUnknown:
            path = self.dotted(n)
            if path is None:
                raise
            return self.lookup(path, scope)
        if not isinstance(left, Val):
            raise TypeMismatch("a relation has no components")
        return self.component(left, n[2])

    @staticmethod
    def dotted(n) -> str | None:
        parts = []
        while n[0] == "dot":
            parts.append(n[2])
            n = n[1]
        return ".".join([n[1], *reversed(parts)]) if n[0] == "name" else None

    def component(self, v: Val, name: str) -> Val:
        if isinstance(v.t, T.StructType) and (name in v.t.names or (v.known and name in v.value)):
            if v.known:
                return Val(v.t[name].dataType if name in v.t.names else T.StringType(), v.value[name])
            return Val(v.t[name].dataType, col=v.col.getField(name))
        return self.call(f"the_{name}", [v])

    def e_op(self, n, scope):
        name = n[1]
        if name in ("=", "<>"):
            v = self.equal(*n[2], scope)
            return v if name == "=" else self.apply("not", [v])
        if name in ("like",):
            s, pattern = self.scalars(n[2], scope)
            if not isinstance(pattern.t, T.StringType) or not isinstance(s.t, T.StringType):
                raise TypeMismatch("LIKE needs strings")
            return Val(T.BooleanType(), col=fn.like(s.column(), pattern.value if pattern.known else pattern.column()))
        args = self.scalars(n[2], scope)
        if name in ("<", "<=", ">", ">=") and self.ops.get("cmp"):
            try:
                return self.apply(name, [self.call("cmp", args), Val(T.IntegerType(), 0)])
            except OperatorNotFound:
                pass
        return self.apply(name, args)

    def equal(self, a, b, scope) -> Val:
        a, b = self.eval(a, scope), self.eval(b, scope)
        if isinstance(a, Relation) and isinstance(b, Relation):
            a, b = self.widened(a, b)
            if scope is None:
                return Val(T.BooleanType(), a.equals(b))
        a, b = self.nest(a), self.nest(b)
        self.same(a.t, b.t)
        if a.known and b.known:
            return Val(T.BooleanType(), a.value == b.value or (isinstance(a.value, float) and math.isnan(a.value) and math.isnan(b.value)))
        return Val(T.BooleanType(), col=a.column() == b.column())

    def apply(self, name: str, args: list[Val]) -> Val:
        """A built-in operator."""
        kinds = "".join(builtins.letter(a.t) for a in args)
        fast = builtins.FAST.get((name, kinds))
        found = builtins.find(name, kinds)
        if found is None:
            raise OperatorNotFound(f"{name}({', '.join(type_name(a.t) for a in args)})")
        result, f = found
        t = builtins.TYPES[result]
        if name == "regex_like" and args[1].known:
            return Val(t, col=f(args[0].column(), args[1].value))
        if result == "i" and any(isinstance(a.t, T.LongType) for a in args):
            t = T.LongType()
        if fast and all(a.known for a in args):
            return Val(t, fast(*[a.value for a in args]))
        c = f(*[a.column() for a in args])
        return Val(t, col=c.cast(t) if result == "i" else c)

    def e_invoke(self, n, scope):
        versions = self.eval(n[1], scope)
        if not isinstance(versions, list):
            raise TypeMismatch("not an operator")
        return self.invoke(versions, [self.eval(a, scope) for a in n[2]], "the operator")

    def e_call(self, n, scope):
        name = n[1]
        for s in (self.scopes[-1], self.scopes[0]):
            if isinstance(s.get(name), list):
                return self.invoke(s[name], [self.eval(a, scope) for a in n[2]], name)
        args = [self.eval(a, scope) for a in n[2]]
        return self.call(name, args, scope)

    def call(self, name: str, args: list, scope: Frame | None = None):
        for full in (f"{self._package}{name}", name):
            if full in self.ops:
                try:
                    return self.invoke(self.ops[full], args, full)
                except OperatorNotFound:
                    if not builtins.OPERATORS.get(name):
                        raise
        if name in KINDS:
            return Val(T.StructType(), {"__error": name, "msg": self.force(args[0]).value if args else ""})
        special = getattr(self, "f_" + name.replace(".", "_"), None)
        if special:
            return special(*args, scope=scope)
        user = self.user_operator(name, args)
        if user is not None:
            return user
        args = [self.nest(a) for a in args]
        if any(not isinstance(a, Val) for a in args):
            raise OperatorNotFound(name)
        return self.apply(name, args)

    def user_operator(self, name: str, args: list):
        """A selector, THE_ operator, or type test of a user's type."""
        for u in self.db.user_types.values():
            if name in (u.name, *u.possreps):
                possrep = u.possreps.get(name, u.first)
                if len(args) != len(possrep):
                    continue
                return Val(self.user_type(u), col=u.select(*[a.column() for a in args], possrep=name))
            if len(args) == 1 and isinstance(args[0], Val):
                if name == f"is_{u.name}":
                    return Val(T.BooleanType(), col=u.is_type(args[0].column()))
                if name == f"treat_as_{u.name}":
                    return Val(self.user_type(u), col=u.treat_as(args[0].column()))
                if name.startswith("the_") and name[4:] in u.first and args[0].t == self.user_type(u):
                    return Val(spark_type(u.first[name[4:]]), col=u.the(name[4:], args[0].column()))
        return None

    # operators that take relations, and what is not in the plan

    def f_tclose(self, r, scope=None):
        return self.as_relation(r).tclose()

    def f_heading(self, r, scope=None):
        if isinstance(r, Relation):
            return r.heading()
        return self.literal_relation([{"name": f.name, "type": type_name(f.dataType)} for f in r.t.fields], struct_type({"name": T.StringType(), "type": T.StringType()}))

    def f_is_empty(self, r, scope=None):
        if isinstance(r, Correlated):
            counted = self.counted(r, scope)
            return Val(T.BooleanType(), col=~r.df.exists() if counted is None else counted == 0)
        if isinstance(r, Relation):
            return Val(T.BooleanType(), r.is_empty()) if scope is None else Val(T.BooleanType(), col=~r.df.exists())
        return Val(T.BooleanType(), col=F.size(r.column()) == 0)

    def f_length(self, a, scope=None):
        return Val(T.IntegerType(), len(a.value)) if a.known else Val(T.IntegerType(), col=fn.array_length(a.column()))

    def f_index_of(self, a, x, scope=None):
        if a.known and x.known:
            return Val(T.IntegerType(), a.value.index(x.value) if x.value in a.value else -1)
        return Val(T.IntegerType(), col=fn.index_of(a.column(), x.column()))

    def f_format(self, pattern, *args, scope=None):
        wanted = self.force(pattern).value
        if not isinstance(wanted, str):
            raise TypeMismatch("FORMAT needs a string")
        specs = [m[0][-1] for m in re.finditer(r"%[-+ 0#]*\d*(?:\.\d+)?([doxXuseEfgG])|%%", wanted) if m[0] != "%%"]
        if len(specs) > len(args):
            raise InvalidArgument("FORMAT: an argument is missing")
        for spec, a in zip(specs, args, strict=False):
            if builtins.letter(a.t) != ("s" if spec == "s" else "d" if spec in "eEfgG" else "i"):
                raise TypeMismatch(f"FORMAT: %{spec} of {type_name(a.t)}")
        return Val(T.StringType(), col=fn.format_(wanted, *[a.column() for a in args]))

    def f_serial(self, scope=None):
        return SERIAL

    def f_io_put(self, v, scope=None):
        self.output.append(text(self.host(v)))

    def f_io_put_line(self, v=None, scope=None):
        self.output.append(("" if v is None else text(self.host(v))) + "\n")

    def f_os_getenv(self, name, scope=None):
        found = os.environ.get(self.force(name).value)
        if found is None:
            raise NotFound(self.force(name).value)
        return Val(T.StringType(), found)

    def f_os_sleep(self, seconds, scope=None):
        time.sleep(self.force(seconds).value)

    def f_net_form_to_tuple(self, form, scope=None):
        found = form_to_tuple(self.force(form).value)
        return Val(type_of(found), found)

    def f_net_hescape(self, s, scope=None):
        return Val(T.StringType(), hescape(self.force(s).value))

    # aggregates

    def e_aggregate(self, n, scope):
        kind, args = n[1], n[2]
        if not args:
            raise InvalidArgument(f"{kind} of nothing")
        r = self.eval(args[0], scope)
        if isinstance(r, Val) and not isinstance(r.t, T.ArrayType):
            raise TypeMismatch(f"{kind} of no relation")
        if isinstance(r, Val):
            return self.nested_aggregate(kind, r, args[1:], scope)
        schema = r.schema if isinstance(r, Correlated) else r.df.schema
        of = self.argument(kind, args[1:], schema)
        a = Aggregate(kind, None if of is None else of.column())
        if isinstance(r, Relation) and scope is None:
            value = r.aggregate(a)
            t = T.DoubleType() if kind == "avg" else type_of(value) if of is None or builtins.letter(of.t) == "i" else of.t
            return Val(t, float(value) if isinstance(t, T.DoubleType) else value)
        if kind == "count" and (counted := self.counted(r, scope)) is not None:
            return Val(T.LongType(), col=counted)
        t = {"count": T.LongType(), "avg": T.DoubleType()}.get(kind) or (T.LongType() if kind == "sum" and builtins.letter(of.t) == "i" else of.t)
        found = r.df.select(a.column().alias("v")).scalar()
        if kind == "avg":
            return Val(t, col=F.coalesce(found, F.raise_error(F.lit("aggregate_undefined_error")).cast("double")))
        return Val(t, col=F.coalesce(found, F.lit(a.over_nothing(of.t if of else T.LongType())).cast(t)))

    def argument(self, kind: str, args, schema: T.StructType, scope=None) -> Val | None:
        if kind == "count":
            return None
        if not args:
            if len(schema.fields) != 1:
                raise InvalidArgument(f"{kind} needs an expression")
            args = (("name", schema.names[0]),)
        v = self.over(args[0], schema, scope)
        if builtins.letter(v.t) not in ("b" if kind in ("all", "any") else "id"):
            raise TypeMismatch(f"{kind} of {type_name(v.t)}")
        return v

    def nested_aggregate(self, kind: str, r: Val, args, scope) -> Val:
        rva = r.column()
        if kind == "count":
            return Val(T.IntegerType(), col=F.size(rva))
        fields = r.t.elementType
        node = args[0] if args else ("name", fields.names[0])
        seen: list[T.DataType] = []

        def of(x):
            v = self.eval(node, self.element(fields, x, scope))
            seen.append(v.t)
            return v.column()

        each = F.transform(rva, of)
        t = seen[0]
        nothing = Aggregate(kind, F.lit(0)).over_nothing(t)
        if kind in ("all", "any"):
            return Val(t, col=F.forall(each, lambda x: x) if kind == "all" else F.exists(each, lambda x: x))
        if kind in ("max", "min"):
            return Val(t, col=F.coalesce((F.array_max if kind == "max" else F.array_min)(each), F.lit(nothing).cast(t)))
        wide = T.DoubleType() if kind == "avg" or builtins.letter(t) == "d" else T.LongType()
        total = F.aggregate(each, F.lit(0).cast(wide), lambda a, x: a + x)
        if kind == "sum":
            return Val(wide, col=total)
        return Val(wide, col=F.when(F.size(rva) > 0, total / F.size(rva)).otherwise(F.raise_error(F.lit("aggregate_undefined_error")).cast("double")))

    @staticmethod
    def element(fields: T.StructType, x, scope: Frame | None) -> Frame:
        return Frame({f.name: f.dataType for f in fields.fields}, x.getField, False, scope)

    # relational operators, on relations, nested relations and tuples

    def e_relational(self, n, scope):
        left = self.eval(n[1], scope)
        if isinstance(left, Val) and left.known and scope is None and isinstance(left.t, T.ArrayType) and isinstance(left.t.elementType, T.StructType):
            left = self.as_relation(left)
        if isinstance(left, Correlated):
            if n[0] in ("project", "remove", "extend", "rename"):
                raise NotSupported(f"{n[0]} of a relation that names an outer row's attributes")
            raise NotSupported(n[0])
        side = "r" if isinstance(left, Relation) else "t" if isinstance(left.t, T.StructType) else "n"
        f: Callable | None = getattr(self, f"{side}_{n[0]}", None)
        if f is None:
            raise NotSupported(f"{n[0]} of {'a relation' if side == 'r' else type_name(left.t)}")
        return f(left, n, scope)

    def widened(self, a: Relation, b: Relation) -> tuple[Relation, Relation]:
        """Common attributes that are 32 bits wide here and 64 there become 64 bits wide."""
        pair = [a, b]
        for k, other in ((0, b), (1, a)):
            wide = {f.name for f in other.df.schema.fields if isinstance(f.dataType, T.LongType)}
            names = [f.name for f in pair[k].df.schema.fields if f.name in wide and isinstance(f.dataType, T.IntegerType)]
            if names:
                pair[k] = Relation(pair[k].df.withColumns({m: F.col(f"`{m}`").cast("long") for m in names}), pair[k].keys)
        return pair[0], pair[1]

    def _two(self, r: Relation, n, scope, f: str) -> Relation:
        a, b = self.widened(r, self.as_relation(self.eval(n[2], scope)))
        return getattr(a, f)(b)

    def r_project(self, r, n, scope):
        return r.project(*n[2])

    def r_remove(self, r, n, scope):
        return r.remove(*n[2])

    def r_where(self, r, n, scope):
        before, self._outer = self._outer, False
        try:
            wide, (test,) = self.over_rows(r, [n[2]], scope)
            if not isinstance(test.t, T.BooleanType):
                raise TypeMismatch("WHERE needs a truth value")
            kept = self.sealed(wide, scope).where(test.column())
            if wide is not r:
                kept = kept.select(*[F.col(f"`{a}`") for a in r.attributes])
            return Correlated(kept, r.df.schema, self.range(r, n[2], scope)) if self._outer else Relation(kept, r.keys)
        finally:
            self._outer = before

    def range(self, r: Relation, condition, scope: Frame | None) -> Range | None:
        """What a condition says of the form value < attribute of the outer row, with others on the tuple alone; else None."""
        if scope is None or scope.counts is None or self.ops.get("cmp"):
            return None
        parts = [condition]
        while wide := next((p for p in parts if p[:2] == ("op", "and")), None):
            parts = [x for p in parts for x in (p[2] if p is wide else (p,))]
        outer = lambda x: x[0] == "name" and x[1] in scope.attributes and x[1] not in r.attributes
        compared = [p for p in parts if p[0] == "op" and p[1] in _TURNED and any(map(outer, p[2]))]
        if len(compared) != 1:
            return None
        _, order, (a, b) = compared[0]
        if outer(a):
            a, b, order = b, a, _TURNED[order]
        self._outer = False
        wide, (value, *tests) = self.over_rows(r, [a, *[p for p in parts if p is not compared[0]]], scope)
        if self._outer or value.known or builtins.letter(value.t) != builtins.letter(scope.attributes[b[1]]):
            return None
        df = wide.df
        for t in tests:
            df = df.where(t.column())
        return Range(scope, b[1], order, df.select(value.column()))

    @staticmethod
    def counted(r, scope: Frame | None) -> Column | None:
        """How many tuples a correlated relation has, if ranges tell."""
        if not isinstance(r, Correlated) or r.range is None or r.range.frame is not scope:
            return None
        name = f"__count{len(scope.counts)}"
        scope.counts[name] = r.range
        return F.col(name)

    def r_rename(self, r, n, scope):
        return r.rename(dict(n[2]))

    def r_extend(self, r, n, scope):
        wide, found = self.over_rows(r, [e for _, e in n[2]], scope)
        made = wide.extend({a: v.column() for (a, _), v in zip(n[2], found, strict=True)})
        return made if wide is r else made.remove(*[a for a in wide.attributes if a not in r.attributes])

    def r_update(self, r, n, scope):
        wide, found = self.over_rows(r, [e for _, e in n[2]], scope)
        made = wide.update({a: v.column() for (a, _), v in zip(n[2], found, strict=True)})
        return made if wide is r else made.remove(*[a for a in wide.attributes if a not in r.attributes])

    def r_union(self, r, n, scope):
        return self._two(r, n, scope, "union")

    def r_d_union(self, r, n, scope):
        return self._two(r, n, scope, "d_union")

    def r_minus(self, r, n, scope):
        return self._two(r, n, scope, "minus")

    def r_intersect(self, r, n, scope):
        return self._two(r, n, scope, "intersect")

    def r_join(self, r, n, scope):
        return self._two(r, n, scope, "join")

    def r_matching(self, r, n, scope):
        return self._two(r, n, scope, "matching")

    def r_semiminus(self, r, n, scope):
        return self._two(r, n, scope, "not_matching")

    def r_subset_of(self, r, n, scope):
        return Val(T.BooleanType(), self._two(r, n, scope, "subset_of"))

    def r_divide(self, r, n, scope):
        a, b = self.widened(r, self.as_relation(self.eval(n[2], scope)))
        both, per = self.widened(a.join(b), self.as_relation(self.eval(n[3], scope)))
        return a.not_matching(both.not_matching(per))

    def r_summarize(self, r, n, scope):
        new = {}
        for name, e in n[3]:
            if e[0] != "aggregate":
                raise InvalidArgument("SUMMARIZE needs aggregates")
            of = self.argument(e[1], e[2][:1], r.df.schema, scope) if e[1] != "count" else None
            new[name] = Aggregate(e[1], None if of is None else of.column())
        per = n[2]
        if per[0] == "project" and per[1] == n[1]:
            return r.summarize(list(per[2]), new)
        return r.summarize(self.widened(r, self.as_relation(self.eval(per, scope)))[1], new)

    def r_wrap(self, r, n, scope):
        return r.wrap({t: list(names) for names, t in n[2]})

    def r_unwrap(self, r, n, scope):
        return r.unwrap(*n[2])

    def r_group(self, r, n, scope):
        return r.group(list(n[2]), n[3])

    def r_ungroup(self, r, n, scope):
        return r.ungroup(n[2])

    def n_project(self, v, n, scope):
        t = struct_type({a: v.t.elementType[a].dataType for a in n[2]})
        col = canonical(F.transform(v.column(), lambda x: F.struct(*[x.getField(a).alias(a) for a in t.names])))
        return Val(T.ArrayType(t), col=col, relation=True)

    def n_remove(self, v, n, scope):
        return self.n_project(v, ("project", None, tuple(a for a in v.t.elementType.names if a not in n[2])), scope)

    def n_where(self, v, n, scope):
        return Val(v.t, col=F.filter(v.column(), lambda x: self.eval(n[2], self.element(v.t.elementType, x, scope)).column()), relation=True)

    def n_rename(self, v, n, scope):
        to = dict(n[2])
        t = struct_type({to.get(f.name, f.name): f.dataType for f in v.t.elementType.fields})
        back = {to.get(a, a): a for a in v.t.elementType.names}
        return Val(T.ArrayType(t), col=canonical(F.transform(v.column(), lambda x: F.struct(*[x.getField(back[a]).alias(a) for a in t.names]))), relation=True)

    def n_extend(self, v, n, scope):
        seen: list[T.StructType] = []

        def each(x):
            made = self.t_extend(Val(v.t.elementType, col=x), n, self.element(v.t.elementType, x, scope))
            seen.append(made.t)
            return made.column()

        col = canonical(F.transform(v.column(), each))
        return Val(T.ArrayType(seen[0]), col=col, relation=True)

    def _nested_two(self, v, n, scope, f):
        other = self.nest(self.eval(n[2], scope))
        self.same(v.t, other.t)
        return Val(v.t, col=canonical(f(v.column(), other.column())), relation=True)

    def n_union(self, v, n, scope):
        return self._nested_two(v, n, scope, F.array_union)

    def n_minus(self, v, n, scope):
        return self._nested_two(v, n, scope, F.array_except)

    def n_intersect(self, v, n, scope):
        return self._nested_two(v, n, scope, F.array_intersect)

    def n_subset_of(self, v, n, scope):
        other = self.nest(self.eval(n[2], scope))
        return Val(T.BooleanType(), col=F.size(F.array_except(v.column(), other.column())) == 0)

    def t_in(self, v, n, scope):
        r = self.eval(n[2], scope)
        if isinstance(r, Val):
            return Val(T.BooleanType(), col=F.array_contains(r.column(), v.column()))
        if set(v.t.names) != set(r.attributes):
            raise TypeMismatch("the tuple has another heading")
        if v.known:
            match = F.lit(True)
            for a in v.t.names:
                match = match & (F.col(f"`{a}`") == literal(v.value[a], v.t[a].dataType))
            found = r.df.where(match)
            return Val(T.BooleanType(), not found.isEmpty()) if scope is None else Val(T.BooleanType(), col=found.exists())
        shifted = self.eval(n[1], Frame({}, None, True, scope))
        match = F.lit(True)
        for a in v.t.names:
            match = match & (F.col(f"`{a}`") == shifted.col.getField(a))
        return Val(T.BooleanType(), col=self.sealed(r, scope).where(match).exists())

    def _parts(self, v: Val) -> dict[str, Val]:
        return {a: self.component(v, a) for a in v.t.names}

    def t_project(self, v, n, scope):
        parts = self._parts(v)
        return self.make_tuple({a: self._attribute(parts, a) for a in n[2]})

    @staticmethod
    def _attribute(parts: dict[str, Val], a: str) -> Val:
        if a not in parts:
            raise NameUnknown(a)
        return parts[a]

    def t_remove(self, v, n, scope):
        return self.make_tuple({a: p for a, p in self._parts(v).items() if a not in n[2]})

    def t_rename(self, v, n, scope):
        to = dict(n[2])
        return self.make_tuple({to.get(a, a): p for a, p in self._parts(v).items()})

    def _computed(self, v: Val, assigns, scope) -> dict[str, Val]:
        """Expressions over a tuple's attributes."""
        if not v.known:
            return {a: self.nest(self.eval(e, self.element(v.t, v.col, scope))) for a, e in assigns}
        self.scopes.append({**self.scopes[-1], **self._parts(v)})
        try:
            return {a: self.nest(self.eval(e, scope)) for a, e in assigns}
        finally:
            self.scopes.pop()

    def t_extend(self, v, n, scope):
        new = self._computed(v, n[2], scope)
        if clash := set(new) & set(v.t.names):
            raise InvalidArgument(f"attribute {sorted(clash)[0]} exists")
        return self.make_tuple({**self._parts(v), **new})

    def t_update(self, v, n, scope):
        return self.make_tuple({**self._parts(v), **self._computed(v, n[2], scope)})

    def t_union(self, v, n, scope):
        (other,) = self.scalars(n[2:3], scope)
        a, b = self._parts(v), self._parts(other)
        if v.known and other.known:
            if any(a[c].value != b[c].value for c in a if c in b):
                raise InvalidArgument("the tuples differ in a common attribute")
            return self.make_tuple({**a, **b})
        t = struct_type({c: p.t for c, p in {**a, **b}.items()})
        return Val(t, col=fn.tuple_union(v.column(), list(a), other.column(), list(b)).cast(t) if list(t.names) == [*a, *[c for c in b if c not in a]] else self.make_tuple({**a, **b}).column())

    def t_wrap(self, v, n, scope):
        parts = self._parts(v)
        packed = {t: self.make_tuple({a: parts[a] for a in names}) for names, t in n[2]}
        gone = {a for names, _ in n[2] for a in names}
        return self.make_tuple({**{a: p for a, p in parts.items() if a not in gone}, **packed})

    def t_unwrap(self, v, n, scope):
        parts = self._parts(v)
        rest = {a: p for a, p in parts.items() if a not in n[2]}
        for a in n[2]:
            rest |= self._parts(parts[a])
        return self.make_tuple(rest)

    # operators of the program

    def invoke(self, versions: list[dict], args: list, name: str):
        for v in versions:
            if self.fits(v["params"], args):
                return self.enter(v, args, name)
        raise OperatorNotFound(f"{name} with {len(args)} arguments")

    def fits(self, params, args) -> bool:
        if len(params) != len(args):
            return False
        for (_, t), a in zip(params, args, strict=True):
            if t.operator:
                if not isinstance(a, list):
                    return False
            elif isinstance(a, list) or t.relation != isinstance(a, Relation):
                return False
            elif not t.relation and builtins.letter(t.t) != builtins.letter(a.t):
                return False
        return True

    def enter(self, v: dict, args: list, name: str):
        if isinstance(v["body"], tuple) and v["body"][:1] == ("extern",):
            return self.outside(v, args, name)
        over_rows = any(isinstance(a, Val) and not a.known for a in args)
        if self._depth > (_DEEPEST_PLAN if over_rows else _DEEPEST):
            raise NotSupported(f"{name} calls itself too deeply, or without end over rows")
        local = dict(zip([p for p, _ in v["params"]], args, strict=True))
        self.scopes.append(local)
        self._depth += 1
        try:
            if over_rows:
                return self.symbolic(v["body"])
            try:
                for s in v["body"]:
                    self.run(s)
            except _Return as r:
                return r.value
            if v["returns"] is not None:
                raise NotSupported(f"{name} ends without RETURN")
            return {p: local[p] for p in v["updates"]}
        finally:
            self._depth -= 1
            self.scopes.pop()

    def outside(self, v: dict, args: list, name: str) -> Val:
        """An operator implemented by the JVM: 'Java' names a class and its static method, 'SQL' a function of the session."""
        _, language, target = v["body"]
        if v["returns"] is None:
            raise NotSupported(f"{name} updates its arguments outside the language")
        t, columns = self.declared(v["returns"]).t, [a.column() for a in args]
        if language.lower() == "sql":
            return Val(t, col=F.call_function(target, *columns).cast(t))
        if language.lower() != "java" or "." not in target:
            raise NotSupported(f"operators in {language}")
        return Val(t, col=F.reflect(*map(F.lit, target.rsplit(".", 1)), *columns).cast(t))

    def symbolic(self, body: tuple):
        """The value a body returns where arguments are Columns: branches become conditional Columns."""
        for k, s in enumerate(body):
            if s[0] == "return":
                return self.nest(self.eval(s[1]))
            if s[0] == "block":
                return self.symbolic((*s[1], *body[k + 1 :]))
            if s[0] == "if_statement":
                test = self.eval(s[1])
                rest = body[k + 1 :]
                if test.known:
                    return self.symbolic((*(s[2] if test.value else s[3]), *rest))
                saved = dict(self.scopes[-1])
                yes = self.symbolic((*s[2], *rest))
                self.scopes[-1].clear()
                self.scopes[-1].update(saved)
                no = self.symbolic((*s[3], *rest))
                return Val(yes.t, col=F.when(test.col, yes.column()).otherwise(no.column()))
            if s[0] in ("while", "for", "for_in", "try"):
                raise NotSupported(f"{s[0]} in an operator applied to rows")
            self.run(s)
        raise NotSupported("an operator ends without RETURN")

    # statements

    def run(self, s) -> None:
        getattr(self, f"s_{s[0]}")(*s[1:])

    def s_block(self, body) -> None:
        for s in body:
            self.run(s)

    def s_begin(self) -> None:
        self.db.begin()

    def s_commit(self) -> None:
        self.db.commit()

    def s_rollback(self) -> None:
        self.db.rollback()

    def local(self, name: str) -> dict:
        return self.scopes[-1] if name in self.scopes[-1] else self.scopes[0]

    def s_var(self, name, kind, declared, init, keys, defaults) -> None:
        keys = [list(k) for k in keys] or None
        t = self.declared(declared) if declared else None
        v = self.eval(init) if init else None
        name = self._package + name
        if kind == "public":
            self.db.public_table(name)
        elif kind in ("real", "private") or (t and t.relation) or isinstance(v, Relation):
            if v is None:
                v = self.literal_relation([], t.t)
            r = self.fit(self.as_relation(v), t.t) if t else self.as_relation(v)
            given = {a: self.host(self.eval(e)) for a, e in defaults}
            (self.db.real if kind == "real" else self.db.private)(name, r, keys, given)
        else:
            if name in self.scopes[-1]:
                raise ElementExists(name)
            if t and t.operator:
                self.scopes[-1][name] = v or []
                return
            if v is None:
                v = self.force(Val(t.t, col=t.user.default())) if t.user else Val(t.t, default(t.t))
            if t:
                self.same(t.t, v.t)
            self.scopes[-1][name] = v if isinstance(v, list) else self.kept(v)

    def kept(self, v: Val) -> Val:
        """In an operator that is being expanded, variables may hold Columns of its arguments."""
        return v if self._depth and not v.known else self.force(v)

    def fit(self, r: Relation, schema: T.StructType) -> Relation:
        """A relation with a variable's types: integers of another width are checked and converted."""
        casts = {f.name: F.col(f"`{f.name}`").cast(schema[f.name].dataType) for f in r.df.schema.fields if f.name in schema.names and f.dataType != schema[f.name].dataType and builtins.letter(f.dataType) == "i"}
        return Relation(r.df.withColumns(casts), r.keys) if casts else r

    def s_const(self, name, e) -> None:
        self.scopes[-1][name] = self.force(self.eval(e))
        self.constants.add(name)

    def s_view(self, name, e) -> None:
        self.db.virtual(self._package + name, self.view(e) or View(of=lambda db, e=e: self.as_relation(self.within(db, e))))

    def within(self, db: Database, e):
        saved, self.db = self.db, db
        try:
            return self.eval(e)
        finally:
            self.db = saved

    def view(self, e) -> View | None:
        """An updatable view, if the expression is a chain of operators that updates pass through."""
        chain = []
        while e[0] in ("where", "project", "remove", "rename", "extend", "wrap", "unwrap"):
            chain.append(e)
            e = e[1]
        if e[0] != "name" or not (e[1] in self.db.relvars or e[1] in self.db.views):
            return None
        r, steps = self.db[e[1]], []
        for n in reversed(chain):
            kind, arg = n[0], n[2]
            if kind == "where":
                arg = self.over(arg, r.df.schema).column()
                r = r.where(arg)
            elif kind in ("project", "remove"):
                arg = [a for a in r.attributes if (a in n[2]) == (kind == "project")] if set(n[2]) <= set(r.attributes) else r._known(n[2])
                kind, r = "project", r.project(*arg)
            elif kind == "unwrap":
                r = r.unwrap(*arg)
            else:
                arg = {"rename": lambda: dict(n[2]), "extend": lambda: {a: self.over(x, r.df.schema).column() for a, x in n[2]}, "wrap": lambda: {t: list(names) for names, t in n[2]}}[kind]()  # noqa: B023
                r = getattr(r, kind)(arg)
            steps.append((kind, arg))
        return View(e[1], steps)

    def s_drop(self, kind, name, version) -> None:
        if kind == "var":
            if name in self.scopes[-1]:
                del self.scopes[-1][name]
            else:
                self.db.drop(name)
        elif kind == "constraint":
            self.db.drop_constraint(name)
        elif kind == "index":
            self.db.drop_index(name)
        elif kind == "type":
            if name not in self.db.user_types:
                raise NotFound(name)
            if any(name in u.supertypes for u in self.db.user_types.values()):
                raise InUse(name)
            del self.db.user_types[name]
        elif kind == "operator":
            if name not in self.ops:
                raise OperatorNotFound(name)
            self.ops[name] = [v for v in self.ops[name] if version and v["version"] != version]
            if not self.ops[name]:
                del self.ops[name]
                self.db.operators.pop(name, None)
        elif kind == "package":
            for names in (self.ops, self.db.operators, self.db.user_types, self.db.public):
                for n in [n for n in names if n.startswith(f"{name}.")]:
                    del names[n]
        else:
            raise NotFound(kind)

    def s_rename_var(self, old, new) -> None:
        self.db.rename_var(old, new)

    def s_load(self, name, e, order, limit) -> None:
        r = self.as_relation(self.eval(e))
        rows = r.load(list(order), None if limit is None else self.known(limit))
        self.local(name)[name] = Val(T.ArrayType(struct_type({f.name: f.dataType for f in r.df.schema.fields})), [plain(x) for x in rows])

    def s_if_statement(self, test, yes, no) -> None:
        self.s_block(yes if self.truth(test) else no)

    def _loop(self, body, label) -> bool:
        """Whether the loop goes on after its body."""
        try:
            self.s_block(body)
        except _Leave as leave:
            if leave.label not in (None, label):
                raise
            return False
        return True

    def s_for(self, name, first, last, body, label) -> None:
        first, last = self.known(first), self.known(last)
        for k in range(first, last + 1):
            self.scopes[-1][name] = Val(T.IntegerType(), k)
            if not self._loop(body, label):
                break

    def s_for_in(self, name, e, order, body, label) -> None:
        v = self.eval(e)
        r = self.as_relation(v)
        t = struct_type({f.name: f.dataType for f in r.df.schema.fields})
        for row in r.each(list(order)):
            self.scopes[-1][name] = Val(t, plain(row))
            if not self._loop(body, label):
                break

    def s_while(self, test, body, label) -> None:
        while self.truth(test) and self._loop(body, label):
            pass

    def s_leave(self, label) -> None:
        raise _Leave(label)

    def s_return(self, e) -> None:
        v = None if e is None else self.eval(e)
        raise _Return(self.force(v) if isinstance(v, Val) else v)

    def s_operator(self, name, params, returns, updates, version, body) -> None:
        full = self._package + name
        versions = self.ops.setdefault(full, [])
        typed = [(p, self.declared(t)) for p, t in params]
        if version and any(v["version"] == version for v in versions):
            raise ElementExists(f"{full} version {version}")
        versions.append({"params": typed, "returns": returns, "updates": updates, "version": version, "body": body})
        known = self.db.operators.setdefault(full, Operator(full, updates=tuple(k for k, (p, _) in enumerate(params) if p in updates)))
        if isinstance(known, Operator):
            known.versions[version or str(len(versions))] = ((object,) * len(params), lambda *a: self.invoke(versions, list(a), full))

    def s_type(self, name, supers, union, ordered, possreps, constraint, init) -> None:
        full = self._package + name
        if full in self.db.user_types:
            raise ElementExists(full)
        reps = {label: {c: t[1] if t[0] == "scalar" else self.nested(t) for c, t in parts} for label, parts in possreps} or {full: {}}
        first = next(iter(reps.values()))
        u = UserType(full, reps, ordered=ordered, supertypes=list(supers))

        def holds(*parts):
            self.scopes.append({c: Val(spark_type(t) if isinstance(t, str) else t, col=p) for (c, t), p in zip(first.items(), parts, strict=True)})
            try:
                return self.eval(constraint).column()
            finally:
                self.scopes.pop()

        if constraint is not None:
            u.constraint = holds
        self.db.user_types[full] = u
        if init is not None:
            u.default = lambda: self.eval(init).column()

    def s_implement(self, what, name, rep, body) -> None:
        if what == "type" and name not in self.db.user_types:
            raise NotFound(name)
        saved = self._package
        self._package = f"{name}." if what == "package" else saved
        try:
            self.s_block(body)
        finally:
            self._package = saved

    def s_package(self, name, body) -> None:
        saved, self._package = self._package, f"{self._package}{name}."
        try:
            self.s_block(body)
        finally:
            self._package = saved

    def s_constraint(self, name, e) -> None:
        def state(db):
            return self.host(self.within(db, e))

        def transition(db, before):
            saved, self.before = self.before, before
            try:
                return state(db)
            finally:
                self.before = saved

        self.db.constraint(name, transition if _mentions_before(e) else state)

    def s_index(self, name, var, names) -> None:
        self.db.index(name, var, list(names))

    def s_map(self, name, e) -> None:
        self.db.map_public(self._package + name, lambda db: self.as_relation(self.within(db, e)))

    def s_try(self, body, arms) -> None:
        depth = len(self.scopes)
        try:
            self.s_block(body)
        except (RelError, PySparkException) as e:
            del self.scopes[depth:]
            value = error_value(e)
            for name, kind, handler in arms:
                if kind in (None, value["__error"]):
                    self.scopes[-1][name] = Val(T.StructType(), value)
                    self.s_block(handler)
                    return
            raise

    def s_raise(self, e) -> None:
        value = self.known(e)
        raise Raised(value if isinstance(value, dict) and "__error" in value else {"__error": "error", "msg": text(value), "value": value})

    def s_explain(self, e, order) -> None:
        v = self.eval(e)
        self.output.append(Relation(v.ordered(list(order)), v.keys).explain() if isinstance(v, Relation) else selector(self.host(v)) + "\n")

    def s_explain_assign(self, s) -> None:
        for c in s[1]:
            self.output.append(f"{c[0]} {c[1]}; constraints: {', '.join(self.db.constraints) or 'none'}\n")

    # calls of update operators, and assignment

    def s_call_statement(self, e) -> None:
        if e[0] != "call":
            raise InvalidArgument("an expression is no statement")
        if e[1] == "io.get_line":
            if not self.lines:
                raise NotFound("end of input")
            self.assign_value(e[2][0], Val(T.StringType(), self.lines.pop(0)))
            return
        changed = self.eval(e)
        if isinstance(changed, dict):
            versions = self.ops.get(f"{self._package}{e[1]}") or self.ops[e[1]]
            params = next([p for p, _ in v["params"]] for v in versions if set(v["updates"]) == set(changed) and len(v["params"]) == len(e[2]))
            for p, v in changed.items():
                self.assign_value(e[2][params.index(p)], v)

    def s_assign(self, changes) -> None:
        """Sources are evaluated before any target changes; relation variables change together."""
        stored, plain_ones = [], []
        for c in changes:
            if c[0] == "set" and not (c[1][0] in ("name", "dot") and self.stored(c[1])):
                plain_ones.append((c[1], self.eval(c[2])))
            else:
                stored.append(self.change(c))
        names = [t for t, _ in plain_ones]
        if len(set(names)) != len(names):
            raise InvalidArgument("a variable is assigned twice")
        if stored:
            self.db.assign(*stored)
        for target, v in plain_ones:
            self.assign_value(target, v)

    def stored(self, target) -> bool:
        name = self.dotted(target)
        return name is not None and name not in self.scopes[-1] and (name in self.db.relvars or name in self.db.views)

    def change(self, c) -> Change:
        kind = c[0]
        if kind == "set":
            name = self.dotted(c[1])
            return self.db.set(name, self.fit(self.as_relation(self.eval(c[2])), self.db[name].df.schema))
        if kind == "update":
            name = self.dotted(c[1])
            schema = self.db[name].df.schema
            test = None if c[2] is None else self.over(c[2], schema).column()
            return self.db.update(name, test, {a: self.over(e, schema).column() for a, e in c[3]})
        name = c[1]
        if kind == "delete_where":
            test = F.lit(True) if c[2] is None else self.over(c[2], self.db[name].df.schema).column()
            return self.db.delete_where(name, test)
        return getattr(self.db, kind)(name, self.tuples(name, c[2]))

    def tuples(self, name: str, e) -> Relation:
        """A relation or one tuple for a variable, with defaults for attributes that aren't given."""
        v = self.eval(e)
        schema = self.db[name].df.schema
        if isinstance(v, Val) and isinstance(v.t, T.StructType):
            v = self.literal_relation([self.force(v).value], v.t)
        r = self.as_relation(v)
        var = self.db.relvars.get(name)
        missing = [a for a in schema.names if a not in r.attributes]
        if var and missing and set(missing) <= set(var.defaults):
            serial = [a for a in missing if var.defaults[a] is SERIAL]
            if serial:
                return self.fit(self.db.tuples(name, [plain(x) for x in r.load()]), schema)
            r = r.extend({a: literal(var.defaults[a], schema[a].dataType) for a in missing})
        return self.fit(r, schema)

    def assign_value(self, target, v) -> None:
        """A variable, or a component of one."""
        kind = target[0]
        if kind == "name":
            name = target[1]
            if name in self.constants:
                raise InvalidArgument(f"{name} is constant")
            if name not in self.scopes[-1] and self.stored(target):
                self.db.assign(self.db.set(name, self.fit(self.as_relation(v), self.db[name].df.schema)))
                return
            home = self.local(name)
            if name not in home:
                raise NameUnknown(name)
            if isinstance(v, Val) and isinstance(home[name], Val):
                self.same(home[name].t, v.t)
                v = self.kept(v)
            home[name] = v
            return
        if kind == "subscript":
            a, k, new = self.force(self.eval(target[1])), self.known(target[2]), self.force(v)
            items = list(a.value)
            items[builtins.index_in(k, len(items))] = new.value
            self.assign_value(target[1], Val(a.t, items))
        elif kind == "call" and target[1] == "length":
            a, n = self.force(self.eval(target[2][0])), self.force(v).value
            if n < 0:
                raise InvalidArgument("an array's length is negative")
            self.assign_value(target[2][0], Val(a.t, [*a.value[:n], *[default(a.t.elementType) for _ in range(n - len(a.value))]]))
        elif kind == "dot" or (kind == "call" and target[1].startswith("the_")):
            inner, name = (target[1], target[2]) if kind == "dot" else (target[2][0], target[1][4:])
            old = self.force(self.eval(inner))
            self.assign_value(inner, self.force(self.with_component(old, name, v)))
        else:
            raise InvalidArgument("this can't be assigned to")

    def with_component(self, old: Val, name: str, v: Val) -> Val:
        if isinstance(old.t, T.TimestampNTZType):
            return Val(old.t, col=fn.set_component(old.column(), name, v.column()))
        for u in self.db.user_types.values():
            if old.t == self.user_type(u) and name in u.first:
                return Val(old.t, col=u.set_the(name, old.column(), v.column()))
        if isinstance(old.t, T.StructType) and name in old.t.names:
            self.same(old.t[name].dataType, v.t)
            return Val(old.t, {**old.value, name: self.force(v).value})
        raise NameUnknown(name)


def _mentions_before(node) -> bool:
    """Whether an expression names a variable's state before the assignment."""
    if not isinstance(node, tuple):
        return False
    if node[:1] == ("name",) and node[1].endswith("'"):
        return True
    return any(map(_mentions_before, node))


def rows(spark: SparkSession, folder: str, names: list[str], expression: str, keys: dict | None = None, script: str = "") -> DataFrame:
    """The rows of an expression over a folder's tables, after a script."""
    session = Session(spark).attach(folder, *names, keys=keys)
    session.execute(script)
    return session.evaluate(expression).df
