"""Relational operators, scalar errors, databases and user types on small literal relations."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from relspark import errors
from relspark import functions as fn
from relspark.database import SERIAL, Database, View
from relspark.operators import ALL, ANY, AVG, COUNT, MAX, MIN, SUM, Nested, Relation, dee, dum, relation
from relspark.operators.relation import canonical
from relspark.userdefined import Operator, UserType


@pytest.fixture
def rel(spark):
    return lambda rows, schema, keys=None: relation(spark, rows, schema, keys)


def tuples(r):
    return {tuple(t[n] for n in sorted(r.attributes)) for t in r.load()}


def test_projection_removes_duplicates_only_without_a_key(rel):
    r = rel([(1, "x"), (2, "x")], "a int, b string", [["a"]])
    assert tuples(r.project("b")) == {("x",)}
    assert r.project("a").keys == [frozenset("a")]
    with pytest.raises(errors.NameUnknown):
        r.remove("c")


def test_set_operators(rel):
    a, b = rel([(1, "x"), (2, "y")], "n int, s string"), rel([("y", 2), ("z", 3)], "s string, n int")
    assert tuples(a.union(b)) == {(1, "x"), (2, "y"), (3, "z")}
    assert tuples(a.intersect(b)) == {(2, "y")} and tuples(a.minus(b)) == {(1, "x")}
    with pytest.raises(PySparkException, match="element_exists_error"):
        a.d_union(b).load()
    with pytest.raises(errors.TypeMismatch):
        a.union(rel([(1,)], "n int"))


def test_joins_and_nullary(rel, spark):
    a = rel([(1, "x"), (2, "y")], "a int, b string")
    c = rel([("x", 1), ("x", 2), ("y", 3)], "b string, c int")
    assert tuples(a.join(c)) == {(1, "x", 1), (1, "x", 2), (2, "y", 3)}
    assert tuples(a.join(dee(spark))) == tuples(a) and tuples(a.join(dum(spark))) == set()
    assert tuples(a.matching(dee(spark))) == tuples(a) and tuples(a.not_matching(dee(spark))) == set()
    assert a.project().df.count() == 1
    with pytest.raises(errors.TypeMismatch):
        a.join(rel([(1.0,)], "a double"))


def test_divide_and_tclose(rel):
    pizzas, conds = rel([(1,), (2,)], "p int"), rel([("salami",), ("mushrooms",)], "c string")
    assert tuples(pizzas.divide(conds, rel([(1, "salami"), (2, "salami"), (2, "mushrooms")], "p int, c string"))) == {(2,)}
    g = rel([(1, 2), (2, 3), (3, 12), (10, 10), (10, 8)], "n1 int, n2 int")
    assert tuples(g.tclose()) - tuples(g) == {(1, 3), (1, 12), (2, 12)}


def test_summarize(rel, spark):
    t = rel([(1, 0), (1, 1), (2, 1), (2, 2)], "a int, b int")
    per = rel([(1,), (9,)], "a int")
    new = {"n": COUNT(), "s": SUM("b"), "m": AVG("b"), "hi": MAX("b"), "lo": MIN("b"), "al": ALL(F.col("b") > 0), "an": ANY(F.col("b") > 0)}
    found = {r.a: r for r in t.summarize(per, new).load()}
    assert (found[1].n, found[1].s, found[1].m, found[1].al, found[1].an) == (2, 1, 0.5, False, True)
    assert (found[9].n, found[9].s, found[9].m, found[9].hi, found[9].lo, found[9].al, found[9].an) == (0, 0, 0.0, -(2**31), 2**31 - 1, True, False)
    assert t.where("a > 5").summarize(dee(spark), {"n": COUNT()}).load()[0].n == 0
    assert t.aggregate(SUM("b")) == 4 and t.project("b").aggregate(SUM("b")) == 3
    with pytest.raises(errors.AggregateUndefined):
        t.where("a > 5").aggregate(AVG("b"))
    with pytest.raises(errors.TypeMismatch):
        rel([("x",)], "s string").aggregate(MAX("s"))


def test_nesting(rel):
    t = rel([(1, "x", 1), (1, "y", 2), (2, "z", 3)], "k int, s string, n int")
    assert tuples(t.group(["s", "n"], "g").ungroup("g")) == tuples(t)
    assert tuples(t.wrap({"w": ["s", "n"]}).unwrap("w")) == tuples(t)
    other = rel([(1, "y", 2), (1, "x", 1), (2, "z", 3)], "k int, s string, n int")
    assert t.group(["s", "n"], "g").equals(other.group(["n", "s"], "g"))
    assert t.group([], "g").where("size(g) = 0").df.count() == 3


def test_nesting_compares_no_pairs(spark, rel):
    nan = float("nan")
    t = rel([(1, 0.0, 1), (1, -0.0, 1), (1, nan, 1), (1, nan, 1), (1, 0.0, 2), (2, 3.0, 3)], "k int, x double, n int", [["k", "x", "n"]])
    g = t.group(["x", "n"], "g")
    assert {r.k: [(e.n, abs(e.x) if e.x == e.x else "nan") for e in r.g] for r in g.load()} == {1: [(1, 0.0), (1, "nan"), (2, 0.0)], 2: [(3, 3.0)]}
    assert "array_distinct" not in g.explain()
    lit = spark.range(1).select(canonical(F.expr("array(named_struct('a', 2), named_struct('a', 1), named_struct('a', 2))")), canonical(F.expr("array()").cast("array<struct<a:int>>")), canonical(F.lit(None).cast("array<struct<a:int>>")))
    assert [None if c is None else [e.a for e in c] for c in lit.first()] == [[1, 2], [], None]
    zeros = spark.range(1).select(canonical(F.expr("array(named_struct('a', 0D), named_struct('a', -0D), named_struct('a', double('NaN')), named_struct('a', double('NaN')))")))
    assert len(zeros.first()[0]) == 2
    big = Relation(spark.range(60000).selectExpr("id % 2 AS k", "id AS v", "id % 7 AS w")).group(["v", "w"], "g")
    assert sorted(tuple(r) for r in big.df.selectExpr("k", "size(g)", "g[29999].v").collect()) == [(0, 30000, 59998), (1, 30000, 59999)]


def test_aggregates_beside_a_nested_relation(rel):
    t = rel([(1, 5, 1.5), (1, -2, 4.0), (1, 8, 4.0), (2, 3, -1.0)], "k int, n int, x double", [["n"]])
    n, x = lambda e: e["n"], lambda e: e["x"]
    new = {
        "c": Nested("count", "g"), "s": Nested("sum", "g", n), "hi": Nested("max", "g", x), "lo": Nested("min", "g", n), "a": Nested("avg", "g", n),
        "every": Nested("all", "g", lambda e: e["n"] > 0), "some": Nested("any", "g", lambda e: (e["n"] > 0) & (e["x"] > 3)),
    }
    g = t.group(["n", "x"], "g")
    beside = g.extend({**new, "twice": F.col("k") * 2})
    stored = Relation(g.df.select("*"), g.keys).extend({**new, "twice": F.col("k") * 2})
    assert beside.df.columns == ["k", "g", *new, "twice"] and beside.keys == [frozenset(["k"])]
    assert [f.dataType for f in beside.df.schema] == [f.dataType for f in stored.df.schema]
    assert sorted(beside.load()) == sorted(stored.load())
    assert {r.k: tuple(r[a] for a in new) for r in beside.load()} == {1: (3, 11, 4.0, -2, 11 / 3, False, True), 2: (1, 3, -1.0, 3, 3.0, True, False)}
    assert "collect_set" not in beside.remove("g").df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" in beside.df._jdf.queryExecution().optimizedPlan().toString()


def test_rename_extend_update(rel):
    t = rel([(1, 2)], "a int, b int", [["a"]])
    assert t.rename({"a": "b", "b": "a"}).load()[0].asDict() == {"b": 1, "a": 2}
    assert t.update({"a": F.col("b"), "b": F.col("a")}).load()[0].asDict() == {"a": 2, "b": 1}
    with pytest.raises(errors.InvalidArgument):
        t.extend({"a": F.lit(1)})


def test_quota_and_order(rel):
    t = rel([(1, 7), (2, 7), (3, 5), (4, 20)], "id int, w int", [["id"]])
    assert {r.id: r.below for r in t.count_below("w", "below").load()} == {1: 1, 2: 1, 3: 0, 4: 3}
    assert [r.id for r in t.load([("w", "desc"), ("id", "asc")], 3)] == [4, 1, 2]
    with pytest.raises(errors.InvalidArgument):
        rel([(True,)], "b boolean").load([("b", "asc")])
    with pytest.raises(errors.InvalidArgument):
        t.to_tuple()
    assert t.contains({"id": 3, "w": 5}) and not t.contains({"id": 3, "w": 6})


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_scalar_values(spark):
    lit = F.lit
    assert one(spark, fn.substr(lit("äbc"), 1, 2)) == "bc" and one(spark, fn.strlen_b(lit("ä"))) == 2
    assert one(spark, fn.strfind_b(lit("äbc"), "c")) == 3 and one(spark, fn.strfind_b(lit("abcabc"), "c", 3)) == 5 and one(spark, fn.strfind_b(lit("x"), "y")) == -1
    assert one(spark, fn.div(lit(-7), 2)) == -3 and one(spark, fn.mod(lit(-7), 2)) == -1
    assert one(spark, fn.format_("%5.2f|%03d|%s|%u|%%", lit(1.5), lit(7), lit("x"), lit(-1))) == " 1.50|007|x|4294967295|%"
    assert one(spark, fn.like(lit("a.c"), "a?c")) and one(spark, fn.like(lit("ab"), "[!x]*")) and not one(spark, fn.like(lit("axc"), "a.c"))
    assert one(spark, fn.weekday(fn.datetime(2024, 1, 7, 0, 0, 0))) == 0
    assert str(one(spark, fn.set_component(fn.datetime(2014, 2, 3, 4, 5, 6), "year", 2015))) == "2015-02-03 04:05:06"
    assert one(spark, fn.index_of(fn.array_(1, 2, 3), 3)) == 2 and one(spark, fn.cast_as_integer(lit(-1.9))) == -1


@pytest.mark.parametrize(
    "make",
    [lambda: fn.substr(F.lit("abc"), 3, 0), lambda: fn.substr(F.lit("abc"), -1, 1), lambda: fn.div(F.lit(1), 0), lambda: fn.mod(F.lit(1), 0), lambda: fn.sqrt(F.lit(-1.0)), lambda: fn.ln(F.lit(0.0)), lambda: fn.power(F.lit(1e300), 2.0), lambda: fn.mul_float(F.lit(1e300), 1e300), lambda: fn.array_at(fn.array_(1), 1), lambda: fn.datetime(2024, 13, 1, 0, 0, 0), lambda: F.lit(2**31 - 1) + F.lit(1)],
)
def test_scalar_errors(spark, make):
    with pytest.raises(PySparkException):
        one(spark, make())


def test_database(rel, spark):
    db = Database(spark)
    db.real("r", rel([(1, "red")], "id int, colour string"), [["id"]], {"colour": "green"})
    db.virtual("green", View("r", [("where", "colour = 'green'")]))
    db.assign(db.insert("green", rel([(2, "green")], "id int, colour string")))
    assert tuples(db["green"]) == {("green", 2)}
    with pytest.raises(errors.PredicateViolation):
        db.insert("green", rel([(3, "red")], "id int, colour string"))
    with pytest.raises(errors.KeyViolation):
        db.assign(db.insert("r", rel([(1, "blue")], "id int, colour string")))
    db.assign(db.insert("r", db.tuples("r", [{"id": 5}])))
    assert (("green", 5)) in tuples(db["r"])
    with pytest.raises(errors.ElementExists):
        db.assign(db.d_insert("r", rel([(1, "red")], "id int, colour string")))
    with pytest.raises(errors.NotFound):
        db.assign(db.i_delete("r", rel([(9, "red")], "id int, colour string")))
    db.begin()
    db.assign(db.delete_where("green", "id > 1"))
    assert db["green"].is_empty()
    db.rollback()
    assert db["green"].aggregate(COUNT()) == 2
    db.constraint("few", lambda d: d["r"].aggregate(COUNT()) < 4)
    db.constraint("grow", lambda d, old: old["r"].project("id").subset_of(d["r"].project("id")))
    with pytest.raises(errors.PredicateViolation):
        db.assign(db.delete_where("r", "id = 1"))
    assert db["r"].aggregate(COUNT()) == 3
    with pytest.raises(errors.InvalidArgument):
        db.assign(db.delete_where("r", "id = 1"), db.delete_where("r", "id = 2"))
    with pytest.raises(errors.InUse):
        db.drop("r")
    assert ("id", 0, "r", "integer") in {(t.attrname, t.i_fno, t.tablename, t.type) for t in db["sys_tableattrs"].load()}


def test_serial_and_snapshots(rel, spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.real("s", rel([(1, "a")], "no int, name string"), [["no"]], {"no": SERIAL})
    db.assign(db.insert("s", db.tuples("s", [{"name": "b"}, {"name": "c"}])))
    assert tuples(db["s"]) == {("a", 1), ("b", 2), ("c", 3)}
    with pytest.raises(errors.InvalidArgument):
        db.tuples("s", [{"no": 9, "name": "x"}])
    db.assign(db.update("s", "no = 2", {"name": F.lit("z")}))
    assert ("z", 2) in tuples(db["s"])


def test_user_types_and_operators(spark):
    point = UserType("point", {"point": {"x": "integer", "y": "integer"}}, constraint=lambda x, y: x >= 0)
    assert one(spark, point.the("y", point.set_the("x", point.select(1, 2), F.lit(5)))) == 2
    with pytest.raises(PySparkException, match="type_constraint_violation"):
        one(spark, point.the("x", point.select(-1, 2)))
    op = Operator("f").version("i", (int,), lambda x: x + 1).version("s", (str,), lambda x: x + "!")
    assert op(1) == 2 and op("a") == "a!"
    with pytest.raises(errors.OperatorNotFound):
        op(1.5)


def test_divide_makes_no_product(spark):
    import itertools
    import random

    rng = random.Random(4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n in (0, 1, 3):
            a, b = [(k, k % 2) for k in range(6)], [(k,) for k in range(n)]
            p = [x for x in itertools.product(range(6), range(4)) if rng.random() < 0.7]
            left, right, per = relation(spark, a, "a int, c int"), relation(spark, b, "b int"), relation(spark, p, "a int, b int")
            r = left.divide(right, per)
            assert {tuple(t) for t in r.load()} == {t for t in a if all((t[0], k) in p for (k,) in b)}
            assert "CartesianProduct" not in r.explain() and "NestedLoop" not in r.explain()
            per = per.project("a")  # nothing of the divisor in it
            assert {tuple(t) for t in left.divide(right, per).load()} == {t for t in a if not b or t[0] in {x for x, _ in p}}
        assert "CartesianProduct" not in left.count_below("c", "n").explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_closure_of_a_long_chain(spark):
    n = 40
    r = relation(spark, [(k, k + 1) for k in range(n)], "a int, b int").tclose()
    assert r.df.count() == n * (n + 1) // 2


def test_inserts_append(spark, tmp_path):
    from relspark import database
    from relspark.database import Database
    from relspark.errors import KeyViolation

    db = Database(spark, f"file://{tmp_path}")
    db.real("r", relation(spark, [(k, f"n{k}") for k in range(50)], "k int, s string"), [["k"]])
    first = set(db["r"].df.inputFiles())
    db.assign(db.insert("r", db.tuples("r", [{"k": 100, "s": "x"}])))
    assert first < set(db["r"].df.inputFiles())  # the old snapshot is still read, not written anew
    with pytest.raises(KeyViolation):
        db.assign(db.insert("r", db.tuples("r", [{"k": 7, "s": "other"}])))
    with pytest.raises(KeyViolation):
        db.assign(db.insert("r", db.tuples("r", [{"k": 200, "s": "x"}, {"k": 200, "s": "y"}])))
    db.assign(db.insert("r", db.tuples("r", [{"k": 7, "s": "n7"}])))
    assert db["r"].df.count() == 51
    for k in range(201, 201 + database.PARTS + 2):
        db.assign(db.insert("r", db.tuples("r", [{"k": k, "s": "x"}])))
    assert db["r"].df.count() == 51 + database.PARTS + 2 and db.relvars["r"].parts <= 4
    many = relation(spark, [(k, "m") for k in range(1000, 1300)], "k int, s string")
    db.assign(db.insert("r", many))
    with pytest.raises(KeyViolation):
        db.assign(db.insert("r", many.update({"s": F.lit("z")})))


def test_strict_scalars(spark):
    from relspark import functions as fn

    df = spark.createDataFrame([("a]b", "x-1", "[0-9]*")], "s string, t string, p string")
    found = df.select(
        fn.regex_like(F.col("t"), "^[[:alpha:]]-[[:digit:][:space:]]$"), fn.regex_like(F.col("s"), "[]]"), fn.regex_like(F.col("t"), "[^[:alnum:]-]"), fn.regex_like(F.col("t"), r"\d"),
        fn.like(F.lit("7up"), F.col("p")), fn.like(F.lit("up"), F.col("p")), fn.like(F.lit("a.b"), F.lit("a.?")), fn.like(F.lit("axb"), F.lit("a.?")), fn.like(F.lit("b"), F.lit("[!a]")), fn.like(F.lit("[x"), F.lit("[x")),
        fn.div(F.lit(9000000000), 2), fn.div(F.lit(-7), 2),
    ).first()
    assert list(found) == [True, True, False, True, True, False, True, False, True, True, 4500000000, -3]
    for text in (" 12", "12 ", "1x", ""):
        with pytest.raises(Exception, match=r"invalid_argument_error|CAST_INVALID"):
            spark.range(1).select(fn.cast_as_integer(F.lit(text))).collect()
