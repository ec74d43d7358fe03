"""Scripts of the text language and what they print; queries, host variables, and errors of syntax and types."""

import pytest
from pyspark.errors import PySparkException

from relspark import errors
from relspark.language import Session, parse_expression
from relspark.operators import Relation

SCRIPTS = {
    "join": (
        """
            var planet private init rel {tup {pname 'Mars', moons 2}, tup {pname 'Earth', moons 1}, tup {pname 'Venus', moons 0}} key {pname};
            var visit real rel {probe string, target string} key {probe};
            insert visit rel {tup {probe 'p9', target 'Mars'}, tup {probe 'p2', target 'Venus'}, tup {probe 'p5', target 'Mars'}};
            var row tup {probe string, moons int};
            for row in (visit rename {target as pname} join planet) {probe, moons} order (moons desc, probe asc);
              io.put_line(format('%s:%d', row.probe, row.moons));
            end for;
        """,
        "p5:2\np9:2\np2:0\n",
    ),
    "union": (
        """
            var odd init rel {tup {v 1}, tup {v 3}, tup {v 9}}; var square init rel {tup {v 4}, tup {v 9}};
            io.put(count(odd union square)); io.put(sum(odd union square, v)); io.put(count(odd intersect square));
            try io.put(count(odd d_union square)); catch e element_exists_error; io.put_line(' shared'); end try;
            io.put_line(count(odd d_union (square minus odd)));
        """,
        "4171 shared\n4\n",
    ),
    "quota": (
        """
            var runner private init rel {tup {bib 5, secs 61.5}, tup {bib 6, secs 58.0}, tup {bib 7, secs 75.25}, tup {bib 8, secs 60.0}} key {bib};
            var best array tup same_heading_as(runner);
            load best from runner where count(runner rename {bib as other, secs as faster} where faster < secs) < 2 order (secs asc);
            io.put(length(best)); io.put_line(best[0].bib * 10 + best[1].bib);
        """,
        "268\n",
    ),
    "ops": (
        """
            operator fac(n int) returns int; if n <= 1 then return 1; else return n * fac(n-1); end if; end operator;
            io.put_line(fac(5));
            operator sign(x int) returns string; if x < 0 then return 'neg'; end if; if x = 0 then return 'zero'; else return 'pos'; end if; end operator;
            var r private init rel {tup{a -1}, tup{a 0}, tup{a 5}};
            var t tup{a int, s string};
            for t in extend r : {s := sign(a)} order(a asc); io.put(t.s || ' '); end for;
            operator inc(x int, by int) updates {x}; x := x + by; end operator;
            var k int; k := 4; inc(k, 3); call inc(k, 1); io.put_line(k);
            var f operator(int) returns string; f := sign; io.put_line(f(-3)); io.put_line((f)(3));
        """,
        "120\nneg zero pos 8\nneg\npos\n",
    ),
    "nest": (
        """
            var p init rel {tup{k 1, g rel{tup{a 1, b 'x'}, tup{a 2, b 'y'}}}, tup{k 2, g rel{a int, b string}{}}};
            var t tup{k int, n int, s int};
            for t in (extend p : {n := count(g), s := sum(g where a > 1, a)}) {k, n, s} order (k asc); io.put(t.k); io.put(t.n); io.put(t.s); end for;
            io.put_line(is_empty((p ungroup g) minus rel{tup{k 1, a 1, b 'x'}, tup{k 1, a 2, b 'y'}}));
            io.put_line(count(p where (tup{a 1, b 'x'} in g)));
            io.put_line(((p ungroup g) group {a, b} as g) = (p where k = 1));
            io.put_line(with (z := 3, y := z + 1) : y * 2);
            io.put_line(if 1 = 2 then 'a' else 'b');
        """,
        "122200TRUE\n1\nTRUE\n8\nb\n",
    ),
    "cons": (
        """
            var r real rel{id int, status int} key{id}; constraint ok is_empty(r where status > 9);
            constraint trans is_empty((r' rename {status as old} join r) where status < old);
            insert r tup{id 1, status 1};
            try update r where id = 1 {status := 10}; catch e predicate_violation_error; io.put('c'); end try;
            update r where id = 1 {status := status + 1};
            try update r {status := 0}; catch e predicate_violation_error; io.put('t'); end try;
            try insert r tup{id 1, status 5}; catch e key_violation_error; io.put('k'); end try;
            try io.put(1/0); catch e invalid_argument_error; io.put('z'); end try;
            try raise not_found_error('nope'); catch e not_found_error; io.put(e.msg); end try;
            begin tx; delete r where id = 1; io.put(count(r)); rollback; io.put(count(r));
            var v virtual r where status < 5; insert v tup{id 7, status 3};
            try insert v tup{id 8, status 6}; catch e predicate_violation_error; io.put('v'); end try; io.put(count(r));
            io.put_line((tuple from r where id = 7).status);
        """,
        "ctkznope01v23\n",
    ),
    "type": (
        """
            type point possrep {x int, y int} constraint x >= 0 init point(1, 2); implement type point; end implement;
            var p point; io.put(p.x); p := point(3, 4); the_y(p) := 9; io.put(p.y); p.x := 5; io.put_line(the_x(p));
            try p := point(-1, 0); catch e type_constraint_violation_error; io.put('bad'); end try;
            var r private rel{id int, p point}; insert r tup{id 1, p point(2,3)}; io.put_line((tuple from (extend r: {q := p.y}) {q}).q);
            package k; operator twice(x int) returns int; return 2*x; end operator; end package; io.put_line(k.twice(4));
            var d datetime; d := datetime(2015,3,1,12,0,0); the_year(d) := 2016; io.put_line(cast_as_string(d)); d.month := 2; io.put_line(d.month + d.year);
            var a array int; length(a) := 2; a[1] := 7; io.put_line(a); const c 4; io.put_line(c);
            l: while true; leave l; end while; case when false then io.put('n'); else io.put_line('y'); end case;
            io.put_line(substr('hello', 1, 3)); io.put_line('abc' like 'a*'); io.put_line(cast_as_integer(2.9));
            io.put_line(count(heading(r))); io.put_line(sum(rel{tup{a 1}, tup{a 4}}));io.put_line(avg(rel{tup{a 1}, tup{a 4}}, a));
        """,
        "195\nbad3\n8\n2016-03-01T12:00:00\n2018\nARRAY (0, 7)\n4\ny\nell\nTRUE\n2\n2\n5\n2.500000\n",
    ),
    "sum": (
        """
            var t private init rel{tup{a 1,b 0},tup{a 1,b 1},tup{a 2,b 1},tup{a 2,b 2}};
            var q tup{a int, s int, al boolean, an boolean};
            for q in summarize t per t{a} : {s := sum(b), al := all(b > 0), an := any(b > 1)} order(a asc); io.put(q.s); io.put(q.al); io.put_line(q.an); end for;
            io.put_line(count(tclose(rel{tup{n1 1, n2 2}, tup{n1 2, n2 3}})));
            io.put_line(rel{tup{p 1}, tup{p 2}} divideby rel{tup{c 'a'}, tup{c 'b'}} per rel{tup{p 1, c 'a'}, tup{p 2, c 'a'}, tup{p 2, c 'b'}});
            io.put_line(count(t not matching rel{tup{a 1}})); io.put_line(count(t {all but b}));
            var w init tup{i 1, j 2} union tup{j 2, k 3}; io.put_line(w); io.put_line((w {i,k}) rename {i as z});
            io.put_line(extend tup{a 2} : {b := a * 3});io.put_line(count(table_dee));
        """,
        "1FALSEFALSE\n3TRUETRUE\n3\nRELATION {TUPLE {p 2}}\n2\n2\nTUPLE {i 1, j 2, k 3}\nTUPLE {k 3, z 1}\nTUPLE {a 2, b 6}\n1\n",
    ),
}


@pytest.mark.parametrize("name", SCRIPTS)
def test_script(spark, name):
    script, printed = SCRIPTS[name]
    assert Session(spark).execute(script) == printed


def test_precedence():
    assert parse_expression("a join b rename {c as d}") == parse_expression("a join (b rename {c as d})")
    assert parse_expression("a where x = 1 {x}") == parse_expression("(a where x = 1) {x}")
    assert parse_expression("not a = 1 and b or c") == parse_expression("((not (a = 1)) and b) or c")
    assert parse_expression("1 - 2 - 3 * -4") == parse_expression("(1 - 2) - (3 * (-4))")
    with pytest.raises(errors.SyntaxFault):
        parse_expression("a join")


def test_host_variables_and_results(spark):
    s = Session(spark)
    s.set_var("n", 3)
    s.set_var("t", {"a": 1, "b": "x"})
    assert s.evaluate("n * 2 + t.a") == 7
    assert s.evaluate("extend t : {c := a + n}") == {"a": 1, "b": "x", "c": 4}
    assert [tuple(r) for r in s.evaluate("rel {tup {a 1}, tup {a 5}} where a > n").load()] == [(5,)]
    assert s.evaluate("array(1, 2, 3)[1]") == 2


@pytest.mark.parametrize(
    ("expression", "error"),
    [
        ("1 + 1.0", errors.OperatorNotFound), ("unknown_name", errors.NameUnknown), ("rel {tup {a 1}} union rel {tup {b 1}}", errors.TypeMismatch),
        ("rel {tup {a 1}} {b}", errors.NameUnknown), ("extend rel {tup {a 1}} : {a := 2}", errors.InvalidArgument), ("tuple from rel {a int} {}", errors.InvalidArgument),
        ("avg(rel {a int} {}, a)", errors.AggregateUndefined), ("if 1 then 2 else 3", errors.TypeMismatch), ("array(1)[1]", errors.InvalidArgument),
        ("format('%d', 'x')", errors.TypeMismatch), ("format('%s %d', 'x')", errors.InvalidArgument), ("'a' like 3", errors.TypeMismatch),
        ("2147483647 + 1", errors.TypeConstraintViolation), ("rel {tup {a 1}} where a", errors.TypeMismatch),
    ],
)
def test_errors(spark, expression, error):
    with pytest.raises(error):
        Session(spark).evaluate(expression)


def test_an_operator_over_rows_stays_in_the_plan(spark):
    s = Session(spark)
    s.execute("operator size_of(n int) returns string; if n > 2 then return 'big'; end if; return 'small'; end operator; var r private init rel {tup {a 1}, tup {a 3}};")
    r = s.evaluate("extend r : {z := size_of(a)}")
    assert {tuple(t) for t in r.load()} == {(1, "small"), (3, "big")}
    assert "Python" not in r.explain()


def test_assignments_take_effect_together_or_not_at_all(spark):
    s = Session(spark)
    s.execute("var a real init rel {tup {n 1}} key {n}; var b real init rel {tup {n 1}} key {n}; constraint same a = b;")
    with pytest.raises(errors.PredicateViolation):
        s.execute("insert a tup {n 2};")
    s.execute("insert a tup {n 2}, insert b tup {n 2};")
    assert s.evaluate("count(a) + count(b)") == 4
    with pytest.raises(errors.InvalidArgument):
        s.execute("insert a tup {n 3}, delete a;")


def test_defaults_serial_public_and_recursion(spark):
    s = Session(spark)
    s.execute(
        """var r real rel {i int, c string} key {i} default {c 'xyz'}; insert r tup {i 1};
        var q real rel {no int, name string} key {no} default {no serial()}; insert q tup {name 'a'}; insert q tup {name 'b'};
        var p public rel {i int, c string}; map p r;
        operator fib(n int) returns int; if n < 2 then return n; end if; return fib(n - 1) + fib(n - 2); end operator;"""
    )
    assert [(t["i"], t["c"]) for t in s.evaluate("r").load()] == [(1, "xyz")]
    assert {t["no"]: t["name"] for t in s.evaluate("q").load()} == {1: "a", 2: "b"}
    assert s.evaluate("p = r") is True and s.evaluate("fib(10)") == 55
    with pytest.raises(errors.NotSupported):
        s.evaluate("extend r : {f := fib(i)}")


def test_endpoint(spark):
    import json
    import threading
    import urllib.error
    import urllib.parse
    import urllib.request

    from relspark.sources.rest import server

    s = Session(spark)
    s.execute("var r private init rel {tup {a 1, d datetime(2016, 2, 3, 4, 5, 6), g rel {tup {x 'é'}}}} key {a};")
    http = server({"db": s.evaluate})
    threading.Thread(target=http.serve_forever, daemon=True).start()
    get = lambda e: json.loads(urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}/{urllib.parse.quote(e)}").read())  # noqa: E731, S310
    try:
        assert get("db/r") == [{"a": 1, "d": "2016-02-03T04:05:06", "g": [{"x": "é"}]}]
        assert get("db/count(r) + 1") == 2 and get("db/array('a', 'b')") == ["a", "b"]
        for path, status in (("db/nothing", 400), ("db/1 +", 400), ("other/r", 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                get(path)
            assert e.value.code == status
    finally:
        http.shutdown()


def test_outside_operators_and_environment(spark, monkeypatch):
    s = Session(spark)
    monkeypatch.setenv("RELSPARK_TEST", "here")
    assert s.evaluate("os.getenv('RELSPARK_TEST')") == "here"
    with pytest.raises(errors.NotFound):
        s.evaluate("os.getenv('RELSPARK_NOT_SET')")
    s.execute("operator up(s string) returns string extern 'SQL' 'upper'; operator no(s string) returns string extern 'C' 'x';")
    assert s.evaluate("up('ab') || 'c'") == "ABc"
    with pytest.raises(errors.NotSupported):
        s.evaluate("no('a')")


def test_a_database_is_reopened(spark, tmp_path):
    from relspark.database import Database

    path = f"file://{tmp_path}/db"
    s = Session(spark, Database(spark, path))
    s.execute(
        """var r real rel {no int, name string, size int} key {no} default {no serial(), size 7};
        insert r rel {tup {name 'a'}}; insert r tup {name 'b', size 20};
        operator twice(n int) returns int; return 2 * n; end operator;
        var big virtual (extend r : {double := twice(size)}) where double > 20;
        constraint small is_empty(r where size > 99); index by_size r (size);
        type money possrep {cents int} constraint cents >= 0 init money(0); implement type money; end implement;
        var gone real init rel {tup {x 1}}; drop var gone; operator lost() returns int; return 1; end operator; drop operator lost;
        begin tx; insert r tup {name 'c'}; commit; begin tx; insert r tup {name 'never'};"""
    )
    t = Session(spark, Database.reopen(spark, path))
    assert {(x.no, x.name, x.size) for x in t.evaluate("r").load()} == {(1, "a", 7), (2, "b", 20), (3, "c", 7)}
    assert [x.double for x in t.evaluate("big").load()] == [40] and t.evaluate("money(5).cents") == 5
    t.execute("insert r tup {name 'd', size 50};")
    with pytest.raises(errors.PredicateViolation):
        t.execute("update r {size := 100};")
    with pytest.raises(errors.RelError):
        t.evaluate("lost()")
    again = Session(spark, Database.reopen(spark, path))
    assert again.evaluate("count(r)") == 4 and again.evaluate("max(r, no)") == 4 and again.db.indexes == {"by_size": ("r", ["size"])}
    with pytest.raises(errors.NotFound):
        Database.reopen(spark, f"file://{tmp_path}")


@pytest.mark.parametrize("order", ["<", "<=", ">", ">="])
def test_counts_by_an_inequality_are_not_products(spark, order):
    py = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[order]
    turned = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}[order]
    mine = [(1, 5.0), (2, 5.0), (3, -0.0), (4, 9.5), (5, None), (6, -3.0), (7, 0.0)]
    others = [(1, 5.0, 1), (2, 9.5, 2), (3, 0.0, 3), (4, 5.0, 4), (5, 7.0, 5), (6, None, 6)]
    s = Session(spark)
    s.set_var("r", Relation(spark.createDataFrame(mine, "id int, v double"), [["id"]]))
    s.set_var("o", Relation(spark.createDataFrame(others, "k int, w double, n bigint"), [["k"]]))
    count = lambda x, test=lambda *_: True, value=lambda k, w, n: w: sum(x is not None and o[1] is not None and test(*o) and py(value(*o), x) for o in others)
    few = s.evaluate(f"r where count(o where w {order} v) < 2")
    assert {t.id for t in few.load()} == {i for i, v in mine if count(v) < 2} and few.attributes == ["id", "v"] and few.keys == [frozenset(["id"])]
    several = s.evaluate(f"extend r : {{all_ := count(o where w {order} v), some := count(o where k > 1 and v {turned} w), none := is_empty(o where n {order} id)}}")
    assert {tuple(t) for t in several.load()} == {(i, v, count(v), count(v, lambda k, *_: k > 1), not any(py(o[2], i) for o in others)) for i, v in mine}
    changed = s.evaluate(f"update r : {{v := cast_as_float(count((o where k < 6) where w * 2.0 {order} v))}}")
    assert {tuple(t) for t in changed.load()} == {(i, float(count(v, value=lambda k, w, n: 2 * w))) for i, v in mine}
    for x in (few, several, changed):
        assert "NestedLoop" not in x.explain() and "CartesianProduct" not in x.explain()
    assert s.evaluate(f"count(r where count((o where k > 9) where w {order} v) = 0)") == len(mine)
    with pytest.raises(PySparkException, match="invalid_argument_error"):
        s.evaluate(f"r where count(o where w * 2.0 {order} v) = 0").load()
    assert s.evaluate(f"(r where id > 99) where count(o where w * 2.0 {order} v) = 0").load() == []
    nested = s.evaluate(f"r where count(o where count(r rename {{id as i, v as x}} where x < w) > 2 and w {order} v) > 0")
    kept = [o for o in others if o[1] is not None and sum(v is not None and v < o[1] for _, v in mine) > 2]
    assert {t.id for t in nested.load()} == {i for i, v in mine if v is not None and any(py(o[1], v) for o in kept)}
