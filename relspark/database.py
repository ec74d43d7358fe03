"""Databases: relation variables, views, constraints, transactions, and a catalog of relations.

A real variable is a Parquet snapshot; assigning writes a new snapshot and moves a pointer, so a statement takes effect
as a whole or not at all. Private variables live in the session. A transaction is a copy of the pointers. Constraints
are checked against the state that an assignment would give, before the pointers move.

With a folder, a database outlives its process: whenever a statement or the outermost transaction has taken effect, the
pointers of its real variables, its indexes and the definitions that sessions give it are written as the next version of a
catalog file; :meth:`Database.reopen` takes the last version. What a transaction hasn't committed is never written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ElementExists, InvalidArgument, InUse, KeyViolation, NameUnknown, NotFound, NoTransaction, NotSupported, PredicateViolation
from .operators.relation import Relation
from .types import same_heading, type_name

SERIAL = object()
#: Snapshots of a variable that INSERTs leave side by side at most, and new tuples whose keys are looked up as literals.
PARTS, FEW = 16, 100


@dataclass
class Relvar:
    """A variable: what it holds now, its keys and its attributes' defaults."""

    value: Relation
    keys: list[list[str]]
    defaults: dict[str, object] = field(default_factory=dict)
    real: bool = True
    #: Snapshots that the value is the union of.
    parts: int = 1


@dataclass
class View:
    """A virtual variable: a base and steps (where, project, rename, extend, wrap, unwrap), or any function of the database."""

    base: str | None = None
    steps: list[tuple[str, object]] = field(default_factory=list)
    of: Callable[[Database], Relation] | None = None

    def value(self, db: Database) -> Relation:
        if self.of:
            return self.of(db)
        r = db[self.base]
        for kind, arg in self.steps:
            r = r.project(*arg) if kind == "project" else r.unwrap(*arg) if kind == "unwrap" else getattr(r, kind)(arg)
        return r


@dataclass(frozen=True)
class Change:
    """One assignment: its target and the target's new value, from the state before."""

    target: str
    new: Callable[[Relation], Relation]
    #: What an INSERT adds, if the old tuples stay as they are.
    added: Relation | None = None


class Database:
    def __init__(self, spark: SparkSession, path: str | None = None, name: str = "db") -> None:
        """``path``: the folder of the snapshots of real variables; without it they are checkpoints."""
        self.spark, self.path, self.name = spark, path, name
        self.relvars: dict[str, Relvar] = {}
        self.views: dict[str, View] = {}
        self.public: dict[str, Callable[[Database], Relation] | None] = {}
        self.constraints: dict[str, Callable[..., bool]] = {}
        self.indexes: dict[str, tuple[str, list[str]]] = {}
        self.operators: dict[str, object] = {}
        self.user_types: dict[str, object] = {}
        #: Definitions of views, constraints, operators and types by statements, in order, for :meth:`reopen`.
        self.definitions: list[str] = []
        self._version = 0
        self._stack: list[dict[str, Relvar]] = []

    # the catalog file

    def _file(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _publish(self) -> None:
        """Write the next version of the catalog, under another name first."""
        if not self.path or self._stack:
            return
        variables = {}
        for name, v in self.relvars.items():
            if v.real:
                defaults = {a: {"serial": True} if d is SERIAL else {"value": d} for a, d in v.defaults.items()}
                variables[name] = {"schema": v.value.df.schema.json(), "files": v.value.df.inputFiles(), "keys": [sorted(k) for k in v.keys], "defaults": defaults, "parts": v.parts}
        data = json.dumps({"name": self.name, "variables": variables, "indexes": self.indexes, "definitions": self.definitions}, default=str)
        fs, temp = self._file(f".catalog-{uuid.uuid4().hex}")
        out = fs.create(temp)
        out.write(bytearray(data.encode()))
        out.close()
        self._version += 1
        if not fs.rename(temp, self._file(f"catalog-{self._version:09d}.json")[1]):
            raise InUse(f"{self.path}: another process has written version {self._version}")

    @classmethod
    def reopen(cls, spark: SparkSession, path: str) -> Database:
        """The database of a folder, as its last catalog says."""
        db = cls(spark, path)
        fs, folder = db._file("")
        versions = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("catalog-"))
        if not versions:
            raise NotFound(path)
        db._version = int(versions[-1][8:-5])
        data = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/{versions[-1]}", wholetext=True).collect()))
        db.name, db.definitions = data["name"], data["definitions"]
        db.indexes = {n: (var, attributes) for n, (var, attributes) in data["indexes"].items()}
        for name, v in data["variables"].items():
            schema = T.StructType.fromJson(json.loads(v["schema"]))
            df = spark.read.schema(schema).parquet(*v["files"]) if v["files"] else spark.createDataFrame([], schema)
            defaults = {a: SERIAL if "serial" in d else d["value"] for a, d in v["defaults"].items()}
            db.relvars[name] = Relvar(Relation(df, v["keys"]), v["keys"], defaults, True, v["parts"])
        return db

    def define(self, statement: str) -> None:
        """Keep a definition for the sessions of a reopened database."""
        self.definitions.append(statement)
        self._publish()

    # variables

    def real(self, name: str, value: Relation, keys: list[list[str]] | None = None, defaults: dict | None = None) -> None:
        self._declare(name, value, keys, defaults, True)

    def private(self, name: str, value: Relation, keys: list[list[str]] | None = None, defaults: dict | None = None) -> None:
        self._declare(name, value, keys, defaults, False)

    def _declare(self, name, value, keys, defaults, real) -> None:
        self._free(name)
        keys = keys or [value.attributes]
        for a in keys:
            for b in keys:
                if a is not b and set(a) <= set(b):
                    raise InvalidArgument(f"key {sorted(b)} holds key {sorted(a)}")
        var = Relvar(value, keys, defaults or {}, real)
        self._check_keys(name, value, keys)
        var.value = self._kept(name, value, keys)
        self.relvars[name] = var
        self._publish()

    def virtual(self, name: str, view: View | Callable[[Database], Relation]) -> None:
        self._free(name)
        self.views[name] = view if isinstance(view, View) else View(of=view)

    def public_table(self, name: str) -> None:
        """A name that :meth:`map_public` binds to an expression later."""
        self._free(name)
        self.public[name] = None

    def map_public(self, name: str, of: Callable[[Database], Relation]) -> None:
        if name not in self.public:
            raise NameUnknown(name)
        self.public[name] = of

    def _free(self, name: str) -> None:
        if name in self.relvars or name in self.views or name in self.public:
            raise ElementExists(name)

    def __getitem__(self, name: str) -> Relation:
        if name in self.relvars:
            return self.relvars[name].value
        if name in self.views:
            return self.views[name].value(self)
        if self.public.get(name):
            return self.public[name](self)
        if name.startswith("sys_"):
            return self.catalog(name)
        raise NameUnknown(name)

    def drop(self, name: str) -> None:
        used = [v for v, view in self.views.items() if view.base == name]
        if used:
            raise InUse(f"{name} is used by {used}")
        for kind in (self.relvars, self.views, self.public):
            if name in kind:
                del kind[name]
                self._publish()
                return
        raise NameUnknown(name)

    def rename_var(self, old: str, new: str) -> None:
        self._free(new)
        kind = self.relvars if old in self.relvars else self.views
        if old not in kind:
            raise NameUnknown(old)
        kind[new] = kind.pop(old)
        self._publish()

    def index(self, name: str, var: str, attributes: list[str]) -> None:
        """Kept in the catalog; the next snapshot of the variable is sorted by it, so that row groups can be skipped."""
        self.relvars[var].value._known(attributes)
        self.indexes[name] = (var, attributes)
        self._publish()

    def drop_index(self, name: str) -> None:
        if self.indexes.pop(name, None) is None:
            raise NotFound(name)

    # snapshots

    def _kept(self, name: str, value: Relation, keys) -> Relation:
        df = value.df
        for var, attributes in self.indexes.values():
            if var == name:
                df = df.sortWithinPartitions(*attributes)
        if self.path and df.columns:
            path = f"{self.path}/{name}/{uuid.uuid4().hex}"
            df.write.parquet(path)
            df = self.spark.read.schema(df.schema).parquet(path)
        else:
            from .operators.relation import _checkpoints

            _checkpoints(self.spark)
            df = df.checkpoint()
        return Relation(df, keys)

    def _check_keys(self, name: str, value: Relation, keys) -> None:
        for k in keys:
            if any(held <= set(k) for held in value.keys):
                continue
            if not value.df.groupBy(*k).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").isEmpty():
                raise KeyViolation(f"{name}: key {sorted(k)}")

    # assignment

    def assign(self, *changes: Change) -> None:
        """All changes at once: new values from the old state, then keys and constraints, then the pointers move."""
        targets = [c.target for c in changes]
        if len(set(targets)) != len(targets):
            raise InvalidArgument("a variable is assigned twice")
        after = dict(self.relvars)
        for c in changes:
            if c.target not in self.relvars:
                raise NameUnknown(c.target)
            var = self.relvars[c.target]
            if c.added is not None:
                after[c.target] = self._appended(c.target, var, c.added)
                continue
            value = c.new(var.value)
            same_heading(var.value.df.schema, value.df.schema, f"assignment to {c.target}")
            value = Relation(value.df.select(*var.value.attributes), value.keys)
            self._check_keys(c.target, value, var.keys)
            after[c.target] = Relvar(self._kept(c.target, value, var.keys), var.keys, var.defaults, var.real)
        before, self.relvars = self.relvars, after
        try:
            for name, holds in self.constraints.items():
                if not self._holds(holds, before):
                    raise PredicateViolation(name)
        except BaseException:
            self.relvars = before
            raise
        self._publish()

    def _appended(self, name: str, var: Relvar, tuples: Relation) -> Relvar:
        """The variable with new tuples beside its snapshots. The source is evaluated once; only keys of new tuples are
        checked, against old tuples of the same keys: of a few new tuples as conditions that reach the scan."""
        same_heading(var.value.df.schema, tuples.df.schema, f"assignment to {name}")
        new = self._kept(name, Relation(tuples.df.select(*var.value.attributes), tuples.keys, distinct=False), None)
        if not new.attributes:
            return Relvar(self._kept(name, var.value.union(new), var.keys), var.keys, var.defaults, var.real)
        few = new.df.limit(FEW + 1).collect()
        old = var.value
        if len(few) <= FEW:
            test = F.lit(False)
            for k in var.keys:
                for r in few:
                    one = F.lit(True)
                    for a in k:
                        one = one & (F.col(f"`{a}`") == F.lit(r[a]))
                    test = test | one
            if all(isinstance(r[a], (int, float, str)) for k in var.keys for a in k for r in few):
                old = Relation(old.df.where(test), old.keys)
        fresh = new if new.intersect(old).is_empty() else self._kept(name, new.minus(old), None)
        self._check_keys(name, Relation(fresh.df), var.keys)
        for k in var.keys:
            if set(k) != set(new.attributes) and not fresh.matching(old.project(*k)).is_empty():
                raise KeyViolation(f"{name}: key {sorted(k)}")
        if fresh.is_empty():
            return var
        whole = Relation(var.value.df.unionByName(fresh.df), var.keys)
        if var.parts >= PARTS:
            return Relvar(self._kept(name, whole, var.keys), var.keys, var.defaults, var.real)
        return Relvar(whole, var.keys, var.defaults, var.real, var.parts + 1)

    def _holds(self, holds, before: dict[str, Relvar]) -> bool:
        """Transition constraints take the state before as a second argument."""
        if holds.__code__.co_argcount < 2:
            return holds(self)
        old = Database(self.spark, self.path, self.name)
        old.relvars, old.views = before, self.views
        return holds(self, old)

    def set(self, name: str, value: Relation) -> Change:
        return Change(name, lambda _: value)

    def tuples(self, name: str, rows: list[dict]) -> Relation:
        """Literal tuples for a variable, with its defaults filled in; serial attributes are numbered on."""
        var = self.relvars[name]
        schema = var.value.df.schema
        serial = [a for a, d in var.defaults.items() if d is SERIAL]
        for r in rows:
            if bad := [a for a in serial if a in r]:
                raise InvalidArgument(f"{bad[0]} is serial")
            if unknown := set(r) - set(schema.names):
                raise NameUnknown(sorted(unknown)[0])
        last = {a: (var.value.df.agg(F.max(a)).first()[0] or 0) for a in serial}
        filled = []
        for k, r in enumerate(rows, 1):
            full = {**{a: d for a, d in var.defaults.items() if d is not SERIAL}, **r, **{a: last[a] + k for a in serial}}
            if missing := set(schema.names) - set(full):
                raise InvalidArgument(f"no value for {sorted(missing)[0]}")
            filled.append(Row(**{n: full[n] for n in schema.names}))
        return Relation(self.spark.createDataFrame([tuple(r) for r in filled], schema), distinct=False)

    def _through(self, name: str, tuples: Relation, kind: str) -> tuple[str, Relation]:
        """The variable below a view and the view's tuples as tuples of it."""
        while name in self.views:
            view = self.views[name]
            if view.of:
                raise NotSupported(f"{kind} through view {name}")
            for step, arg in reversed(view.steps):
                if step == "where":
                    if not tuples.where(~Relation._c(arg)).is_empty():
                        raise (PredicateViolation if kind == "insert" else NotFound)(name)
                elif step == "rename":
                    tuples = tuples.rename({new: old for old, new in arg.items()})
                elif step == "extend":
                    plain = [n for n in tuples.attributes if n not in arg]
                    base = tuples.project(*plain)
                    if not tuples.minus(base.extend(arg)).is_empty():
                        raise PredicateViolation(name)
                    tuples = base
                elif step == "wrap" and kind == "insert":
                    tuples = tuples.unwrap(*arg)
                elif step == "unwrap" and kind == "insert":
                    parts = {n: [f.name for f in self[view.base].df.schema[n].dataType.fields] for n in arg}
                    tuples = tuples.wrap(parts)
                elif step == "project" and kind == "insert":
                    var = self.relvars.get(view.base)
                    missing = [a for a in self[view.base].attributes if a not in tuples.attributes]
                    if var is None or any(a not in var.defaults or var.defaults[a] is SERIAL for a in missing):
                        raise NotSupported(f"insert through projection {name} without defaults")
                    tuples = tuples.extend({a: F.lit(var.defaults[a]).cast(var.value.df.schema[a].dataType) for a in missing})
                else:
                    raise NotSupported(f"{kind} through {step}")
            name = view.base
        return name, tuples

    def insert(self, name: str, tuples: Relation) -> Change:
        """Tuples that are there already are no error; a key held by another tuple is."""
        target, rows = self._through(name, tuples, "insert")
        return Change(target, lambda old: old.union(rows), rows)

    def d_insert(self, name: str, tuples: Relation) -> Change:
        target, rows = self._through(name, tuples, "insert")

        def new(old: Relation) -> Relation:
            if not old.intersect(rows).is_empty():
                raise ElementExists(target)
            return old.union(rows)

        return Change(target, new)

    def delete(self, name: str, tuples: Relation) -> Change:
        target, rows = self._through(name, tuples, "delete")
        return Change(target, lambda old: old.minus(rows))

    def i_delete(self, name: str, tuples: Relation) -> Change:
        target, rows = self._through(name, tuples, "delete")

        def new(old: Relation) -> Relation:
            if not rows.subset_of(old):
                raise NotFound(target)
            return old.minus(rows)

        return Change(target, new)

    def _below(self, name: str, kinds: tuple[str, ...], what: str):
        """The variable below a view, and a function from it to the view that keeps the base's attributes under a tuple."""
        steps = []
        while name in self.views:
            view = self.views[name]
            if view.of or any(k not in kinds for k, _ in view.steps):
                raise NotSupported(f"{what} through view {name}")
            steps = [*view.steps, *steps]
            name = view.base
        return name, steps

    def delete_where(self, name: str, condition) -> Change:
        target, steps = self._below(name, ("project", "where", "rename", "extend"), "delete")

        def new(old: Relation) -> Relation:
            rows = old.df.select(*old._cols(), F.struct(*old._cols()).alias("__base"))
            for kind, arg in [*steps, ("where", condition)]:
                if kind == "where":
                    rows = rows.where(Relation._c(arg))
                elif kind == "rename":
                    rows = rows.select(*[F.col(f"`{c}`").alias(arg.get(c, c)) for c in rows.columns])
                elif kind == "extend":
                    rows = rows.select("*", *[Relation._c(e).alias(n) for n, e in arg.items()])
                else:
                    rows = rows.select(*arg, "__base")
            return old.minus(Relation(rows.select("__base.*"), old.keys))

        return Change(target, new)

    def update(self, name: str, condition, values: dict) -> Change:
        """Set attributes where the condition holds (None: everywhere), all from the old values."""
        target, steps = self._below(name, ("project",), "update")
        test = F.lit(True) if condition is None else Relation._c(condition)
        if steps and set(values) - set(steps[-1][1]):
            raise NameUnknown(sorted(set(values) - set(steps[-1][1]))[0])
        return Change(target, lambda old: old.update({a: F.when(test, Relation._c(e)).otherwise(F.col(f"`{a}`")) for a, e in values.items()}))

    # constraints and transactions

    def constraint(self, name: str, holds: Callable[..., bool]) -> None:
        """``holds(db)`` or, for transitions, ``holds(db, before)``."""
        if name in self.constraints:
            raise ElementExists(name)
        if not self._holds(holds, self.relvars):
            raise PredicateViolation(name)
        self.constraints[name] = holds

    def drop_constraint(self, name: str) -> None:
        if self.constraints.pop(name, None) is None:
            raise NotFound(name)

    def begin(self) -> None:
        self._stack.append(dict(self.relvars))

    def commit(self) -> None:
        if not self._stack:
            raise NoTransaction
        self._stack.pop()
        self._publish()

    def rollback(self) -> None:
        if not self._stack:
            raise NoTransaction
        self.relvars = self._stack.pop()

    # catalog

    def catalog(self, name: str) -> Relation:
        """The system relations, from the registry."""
        tables = {**{n: v.value for n, v in self.relvars.items()}, **{n: v.value(self) for n, v in self.views.items()}}
        rows, schema = {
            "sys_version_info": lambda: ([(1, 0)], "major int, minor int"),
            "sys_tableattrs": lambda: ([(f.name, t, type_name(f.dataType), k) for t, r in tables.items() for k, f in enumerate(r.df.schema.fields)], "attrname string, tablename string, type string, i_fno int"),
            "sys_tableattr_defvals": lambda: ([(a, t, "serial()" if d is SERIAL else repr(d)) for t, v in self.relvars.items() for a, d in v.defaults.items()], "attrname string, tablename string, default_value string"),
            "sys_rtables": lambda: ([(t, v.real) for t, v in self.relvars.items()], "tablename string, is_real boolean"),
            "sys_vtables": lambda: ([(t, v.base or "") for t, v in self.views.items()], "tablename string, base string"),
            "sys_ptables": lambda: ([(t, v is not None) for t, v in self.public.items()], "tablename string, is_mapped boolean"),
            "sys_dbtables": lambda: ([(t, self.name) for t in tables], "tablename string, dbname string"),
            "sys_keys": lambda: ([(t, k, sorted(key)) for t, v in self.relvars.items() for k, key in enumerate(v.keys)], "tablename string, keyno int, attrs array<string>"),
            "sys_types": lambda: ([(t, getattr(u, "ordered", False)) for t, u in self.user_types.items()], "typename string, ordered boolean"),
            "sys_possrepcomps": lambda: ([(t, p, k, n, c) for t, u in self.user_types.items() for p, cs in u.possreps.items() for k, (n, c) in enumerate(cs.items())], "typename string, possrepname string, compno int, compname string, comptypename string"),
            "sys_ro_ops": lambda: ([(n,) for n, o in self.operators.items() if not getattr(o, "updates", ())], "opname string"),
            "sys_upd_ops": lambda: ([(n,) for n, o in self.operators.items() if getattr(o, "updates", ())], "opname string"),
            "sys_ro_op_versions": lambda: ([(n, v) for n, o in self.operators.items() if not getattr(o, "updates", ()) for v in o.versions], "opname string, version string"),
            "sys_upd_op_versions": lambda: ([(n, v) for n, o in self.operators.items() if getattr(o, "updates", ()) for v in o.versions], "opname string, version string"),
            "sys_constraints": lambda: ([(n,) for n in self.constraints], "constraintname string"),
            "sys_indexes": lambda: ([(n, t, a) for n, (t, a) in self.indexes.items()], "idxname string, tablename string, attrs array<string>"),
            "sys_subtype": lambda: ([(t, s) for t, u in self.user_types.items() for s in getattr(u, "supertypes", ())], "typename string, supertype string"),
        }.get(name, lambda: (None, None))()
        if rows is None:
            raise NameUnknown(name)
        return Relation(self.spark.createDataFrame(rows, schema))
