"""User-defined types and operators.

A type has possible representations (named components), a constraint and perhaps an order. A value is a struct with the
type's name and its first representation's components, or the bare component if there is one representation of one
component. An operator's body is a function of Columns (a macro, so it stays in the plan), of relations, or of Python
values; versions of an operator are chosen by the types of its arguments.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import ElementExists, NotFound, OperatorNotFound
from .types import spark_type


@dataclass
class UserType:
    """``possreps``: {representation: {component: type}}; others than the first come with functions to and from it."""

    name: str
    possreps: dict[str, dict[str, str]]
    constraint: Callable[..., Column] | None = None
    init: tuple = ()
    ordered: bool = False
    supertypes: list[str] = field(default_factory=list)
    to_first: dict[str, Callable[..., tuple]] = field(default_factory=dict)
    from_first: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    @property
    def first(self) -> dict[str, str]:
        return next(iter(self.possreps.values()))

    @property
    def bare(self) -> bool:
        return len(self.first) == 1 and not self.supertypes

    def select(self, *values, possrep: str | None = None) -> Column:
        """The selector: a value of the type, if its constraint holds."""
        values = [v if isinstance(v, Column) else F.lit(v) for v in values]
        if possrep in self.to_first:
            values = list(self.to_first[possrep](*values))
        parts = [v.cast(spark_type(t)) for v, t in zip(values, self.first.values(), strict=True)]
        value = parts[0] if self.bare else F.struct(F.lit(self.name).alias("__type"), *[p.alias(n) for p, n in zip(parts, self.first, strict=True)])
        if self.constraint is None:
            return value
        broken = F.raise_error(F.lit(f"type_constraint_violation_error: {self.name}")).isNull()
        return F.when(self.constraint(*parts), value).otherwise(F.when(broken, value))

    def default(self) -> Column:
        return self.select(*self.init)

    def the(self, component: str, value: Column) -> Column:
        """THE_component: of the first representation, or derived from it."""
        if component in self.from_first:
            return self.from_first[component](value)
        if component not in self.first:
            raise NotFound(component)
        return value if self.bare else value.getField(component)

    def set_the(self, component: str, value: Column, new) -> Column:
        """The value with one component replaced, under the constraint."""
        return self.select(*[new if c == component else self.the(c, value) for c in self.first])

    def is_type(self, value: Column) -> Column:
        return F.lit(True) if self.bare else value.getField("__type") == self.name

    def treat_as(self, value: Column) -> Column:
        """The value as one of this type, or an error."""
        return F.when(self.is_type(value), value).otherwise(F.when(F.raise_error(F.lit(f"type_mismatch_error: {self.name}")).isNull(), value))

    def sort_key(self, value: Column) -> Column:
        """What an ordered type is sorted by: its components in order."""
        return value if self.bare else F.struct(*[value.getField(c) for c in self.first])


@dataclass
class Operator:
    """``versions``: {version: (argument types, body)}; ``updates``: positions of arguments that are changed."""

    name: str
    versions: dict[str, tuple[tuple, Callable]] = field(default_factory=dict)
    updates: tuple[int, ...] = ()

    def version(self, name: str, types: tuple, body: Callable) -> Operator:
        if name in self.versions:
            raise ElementExists(f"{self.name} version {name}")
        self.versions[name] = (types, body)
        return self

    def __call__(self, *args):
        """The version whose argument types the arguments have; ``object`` fits anything."""
        for types, body in self.versions.values():
            if len(types) == len(args) and all(isinstance(a, t) for a, t in zip(args, types, strict=True)):
                return body(*args)
        raise OperatorNotFound(f"{self.name}({', '.join(type(a).__name__ for a in args)})")


def macro(name: str, body: Callable[..., Column], arity: int) -> Operator:
    """A read-only operator of Columns."""
    return Operator(name).version("1", (object,) * arity, body)
