"""Queries in the text language over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from ..language.interpreter import rows
from .tables import KEYS

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

#: name -> (expression, SQL)
TEXTS: dict[str, tuple[str, str]] = {
    "text_where_project": (
        "(orders where o_totalprice > 100000.0 and o_orderstatus = 'F') {o_custkey, o_orderstatus}",
        "SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 100000.0 AND o_orderstatus = 'F'",
    ),
    "text_join_rename": (
        "(nation join region rename {r_regionkey as n_regionkey}) {n_name, r_name}",
        "SELECT DISTINCT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey",
    ),
    "text_extend_scalars": (
        """(extend customer : {low := lower(c_mktsegment) || '-' || cast_as_string(c_nationkey), half := c_acctbal / 2.0, odd := c_nationkey % 2 = 1,
           kind := if c_acctbal < 0.0 then 'debt' else 'credit'}) {c_custkey, low, half, odd, kind}""",
        """SELECT c_custkey, lower(c_mktsegment) || '-' || c_nationkey AS low, c_acctbal / 2.0 AS half, c_nationkey % 2 = 1 AS odd,
           CASE WHEN c_acctbal < 0.0 THEN 'debt' ELSE 'credit' END AS kind FROM customer""",
    ),
    "text_summarize_per": (
        "summarize supplier rename {s_nationkey as n_nationkey} per nation {n_nationkey} : {n := count(), most := max(s_suppkey)}",
        """SELECT n_nationkey, count(s_suppkey) AS n, coalesce(max(s_suppkey), -2147483648) AS most
           FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey""",
    ),
    "text_summarize_own": (
        "summarize lineitem per lineitem {l_returnflag, l_linestatus} : {n := count(), few := min(l_quantity), over := any(l_quantity > 49.0)}",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS few, bool_or(l_quantity > 49.0) AS over FROM lineitem GROUP BY ALL",
    ),
    "text_set_operators": (
        "(customer {c_nationkey} rename {c_nationkey as k} minus supplier {s_nationkey} rename {s_nationkey as k}) union ((nation where n_regionkey = 1) {n_nationkey} rename {n_nationkey as k})",
        "(SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 1",
    ),
    "text_matching": (
        "customer {c_custkey, c_name} not matching (orders where o_totalprice > 300000.0) rename {o_custkey as c_custkey}",
        "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000.0)",
    ),
    "text_group_nested": (
        "(extend nation {n_regionkey, n_nationkey} group {n_nationkey} as g : {n := count(g), s := sum(g, n_nationkey), big := count(g where n_nationkey > 10)}) {n_regionkey, n, s, big}",
        """SELECT n_regionkey, CAST(count(*) AS INT) AS n, CAST(sum(n_nationkey) AS BIGINT) AS s, CAST(count(*) FILTER (n_nationkey > 10) AS INT) AS big
           FROM nation GROUP BY n_regionkey""",
    ),
    "text_correlated": (
        "supplier {s_suppkey, s_acctbal} where count(supplier {s_suppkey, s_acctbal} rename {s_suppkey as k, s_acctbal as w} where w > s_acctbal) < 5",
        "SELECT s_suppkey, s_acctbal FROM supplier a WHERE (SELECT count(*) FROM supplier b WHERE b.s_acctbal > a.s_acctbal) < 5",
    ),
    "text_with_divide": (
        """with (have := (customer join nation rename {n_nationkey as c_nationkey}) {c_mktsegment, n_regionkey}, all_regions := region {r_regionkey} rename {r_regionkey as n_regionkey}) :
           have {c_mktsegment} divideby all_regions per (have)""",
        """SELECT c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1
           HAVING count(DISTINCT n_regionkey) = (SELECT count(*) FROM region)""",
    ),
    "text_in_tuple": (
        "nation where (tuple {r_regionkey n_regionkey} in (region where r_name like 'A*') {r_regionkey})",
        "SELECT * FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')",
    ),
    "text_tclose": (
        "tclose((extend nation : {a := n_nationkey, b := (n_nationkey * 3 + 1) % 25}) {a, b})",
        """WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation),
           c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, b FROM c""",
    ),
}


#: name -> (script, expression, SQL)
SCRIPTS: dict[str, tuple[str, str, str]] = {
    "script_variables": (
        """
        var kept real rel {k int, name string} key {k} default {name 'none'};
        kept := (nation {n_nationkey, n_name}) rename {n_nationkey as k, n_name as name};
        insert kept tup {k 100};
        d_insert kept tup {k 101, name 'one'};
        update kept where k < 3 {name := name || '!'};
        delete kept where k >= 20 and k < 25;
        i_delete kept rel {tup {k 101, name 'one'}};
        var numbered real rel {no int, name string} key {no} default {no serial()};
        insert numbered tup {name 'a'}; insert numbered tup {name 'b'};
        rename var numbered as lines; var gone private init rel {tup {x 1}}; drop var gone;
        """,
        "kept union (lines rename {no as k} where k < 3)",
        """SELECT n_nationkey AS k, n_name || CASE WHEN n_nationkey < 3 THEN '!' ELSE '' END AS name FROM nation WHERE n_nationkey < 20
           UNION SELECT 100, 'none' UNION SELECT 1, 'a' UNION SELECT 2, 'b'""",
    ),
    "script_transition_constraint": (
        """
        var stock real init (region {r_regionkey}) key {r_regionkey}; var seen real rel {what string} key {what};
        constraint never_less is_empty(stock' minus stock);
        try delete stock where r_regionkey = 1; catch e predicate_violation_error; insert seen tup {what 'kept'}; end try;
        insert stock rel {tup {r_regionkey 77}};
        begin tx; insert seen tup {what 'undone'}; rollback;
        begin tx; insert seen tup {what 'done'}; commit;
        insert seen tup {what cast_as_string(count(stock))};
        """,
        "seen",
        "SELECT 'kept' AS what UNION ALL SELECT 'done' UNION ALL SELECT CAST(count(*) + 1 AS VARCHAR) FROM region",
    ),
    "script_operators": (
        """
        var out real rel {k string, v int} key {k};
        operator twice(n int) returns int; return 2 * n; end operator;
        operator twice(s string) returns int; return 2 * strlen(s); end operator;
        operator add(total int, by int) updates {total}; total := total + by; end operator;
        operator sum_to(n int) returns int; var s int; var i int; s := 0; for i := 1 to n; s := s + i; end for; return s; end operator;
        operator first_of(least int) returns rel {n_nationkey int}; return (nation where n_nationkey < least) {n_nationkey}; end operator;
        package math; operator cube(n int) returns int; return n * n * n; end operator; end package;
        var n int; n := 5; add(n, 3); call add(n, 1);
        var f operator(int) returns int; f := sum_to;
        insert out rel {tup {k 'updated', v n}, tup {k 'int', v twice(4)}, tup {k 'string', v twice('abc')}, tup {k 'called', v f(10)}, tup {k 'package', v math.cube(3)}};
        insert out tup {k 'rows', v cast_as_integer(cast_as_float(count(first_of(7))))};
        """,
        "out",
        "SELECT * FROM (VALUES ('updated', 9), ('int', 8), ('string', 6), ('called', 55), ('package', 27)) AS t(k, v) UNION ALL SELECT 'rows', CAST(count(*) AS INTEGER) FROM nation WHERE n_nationkey < 7",
    ),
    "script_control": (
        """
        var out real rel {k int, name string} key {k}; var t tup {n_nationkey int, n_name string}; var k int; k := 0;
        walk: for t in (nation where n_regionkey = 2) {n_nationkey, n_name} order (n_name desc);
          if k >= 3 then leave walk; end if;
          case when k = 0 then insert out tup {k 0, name 'first ' || t.n_name}; when k = 1 then insert out tup {k 1, name t["n_name"]}; else insert out tup {k 2, name lower(t.n_name)}; end case;
          k := k + 1;
        end for;
        while k < 6; k := k + 1; end while;
        try raise not_found_error('lost'); catch e not_found_error; insert out tup {k 10 + k, name e.msg}; end try;
        try io.put(cast_as_integer(' 12')); catch e invalid_argument_error; insert out tup {k 20, name 'strict'}; end try;
        insert out tup {k 21, name if array(1, 2) = array(1, 2) then 'same' else 'other'};
        """,
        "out",
        """SELECT CAST(r - 1 AS INTEGER) AS k, CASE r WHEN 1 THEN 'first ' || n_name WHEN 2 THEN n_name ELSE lower(n_name) END AS name
           FROM (SELECT n_name, row_number() OVER (ORDER BY n_name DESC) AS r FROM nation WHERE n_regionkey = 2) WHERE r <= 3
           UNION ALL SELECT 16, 'lost' UNION ALL SELECT 20, 'strict' UNION ALL SELECT 21, 'same'""",
    ),
    "script_types": (
        """
        type span possrep {low int, high int} constraint low <= high init span(0, 0); implement type span; end implement;
        var out private rel {k int, s span} key {k};
        insert out (extend nation {n_nationkey, n_regionkey} : {s := span(n_regionkey, n_nationkey + 5)}) {n_nationkey, s} rename {n_nationkey as k};
        index by_k out (k); drop index by_k;
        """,
        "(extend out : {low := s.low, wide := the_high(s) - the_low(s)}) {k, low, wide}",
        "SELECT n_nationkey AS k, n_regionkey AS low, n_nationkey + 5 - n_regionkey AS wide FROM nation",
    ),
    "script_extern": (
        """
        operator pad(s string, n int, with_ string) returns string extern 'SQL' 'lpad';
        operator greatest_of(a int, b int) returns int extern 'Java' 'java.lang.Math.max';
        var seen private init rel {tup {n_nationkey 500, p pad('x', 3, '-'), m greatest_of(3, 8)}} key {n_nationkey};
        """,
        "((extend nation : {p := pad(n_name, 4, '*'), m := greatest_of(n_nationkey, 11)}) {n_nationkey, p, m}) union seen",
        "SELECT n_nationkey, lpad(n_name, 4, '*') AS p, greatest(n_nationkey, 11) AS m FROM nation UNION ALL SELECT 500, '--x', 8",
    ),
    "script_text_and_forms": (
        """
        var out private rel {k string, v string} key {k};
        insert out rel {tup {k 'form', v net.form_to_tuple('a=1%202&b=x').a}, tup {k 'escaped', v net.hescape('<a & b>')}};
        insert out tup {k 'date', v cast_as_string(add_seconds(datetime(2016, 2, 28, 23, 59, 30), 45))};
        var d datetime; d := datetime(2015, 3, 1, 12, 0, 0); d.year := 2016; the_minute(d) := 30;
        insert out tup {k 'set', v cast_as_string(d)};
        insert out tup {k 'signs', v cast_as_string(-3 + +5) || ' ' || cast_as_string(1.5 + 2.25)};
        insert out tup {k 'bytes', v substr_b('hello', 1, 3) || cast_as_string(strfind_b('hello', 'l', 3))};
        """,
        "out",
        """SELECT * FROM (VALUES ('form', '1 2'), ('escaped', '&lt;a &amp; b&gt;'), ('date', '2016-02-29T00:00:15'), ('set', '2016-03-01T12:30:00'),
           ('signs', '2 3.75'), ('bytes', 'ell3')) AS t(k, v)""",
    ),
}


def queries() -> dict:
    found = {n: (lambda spark, folder, e=e: rows(spark, folder, TABLES, e, KEYS)) for n, (e, _) in TEXTS.items()}
    return found | {n: (lambda spark, folder, s=s, e=e: rows(spark, folder, TABLES, e, KEYS, s)) for n, (s, e, _) in SCRIPTS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (*_, sql) in {**TEXTS, **SCRIPTS}.items()}
