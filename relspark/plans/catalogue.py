"""One query for each operator, over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors
from .. import functions as fn
from ..database import Database, View
from ..operators import ALL, ANY, AVG, COUNT, MAX, MIN, SUM, Nested, Relation, dee, dum, relation
from ..sources import table, to_json
from ..userdefined import UserType, macro
from . import text_queries
from .tables import KEYS

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder as relations."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> Relation:
        return table(self.spark, self._folder, name, KEYS.get(name))


def query(sql: str | None = None):
    """Register a function from tables to a relation or a DataFrame."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            r = f(Tables(spark, sf_dir))
            return r.df if isinstance(r, Relation) else r

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | text_queries.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | text_queries.oracle_sql()


MONEY = "decimal(18,2)"


@query("SELECT * FROM region")
def scan_region(t):
    return t.region


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def project_distinct(t):
    return t.customer.project("c_mktsegment", "c_nationkey")


@query("SELECT DISTINCT r_name FROM region")
def remove_all_but(t):
    return t.region.remove("r_regionkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000.0 AND o_orderstatus = 'F'")
def where_pred(t):
    return t.orders.where("o_totalprice > 100000.0 AND o_orderstatus = 'F'").project("o_orderkey", "o_totalprice")


@query("SELECT n_nationkey AS nk, n_name AS nm, n_regionkey AS rk FROM nation")
def rename_attrs(t):
    return t.nation.rename({"n_nationkey": "nk", "n_name": "nm", "n_regionkey": "rk"})


@query("SELECT n_regionkey AS n_nationkey, n_nationkey AS n_regionkey, n_name FROM nation")
def rename_swap(t):
    return t.nation.rename({"n_nationkey": "n_regionkey", "n_regionkey": "n_nationkey"})


@query("SELECT DISTINCT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_shipdate, CAST(l_quantity AS INTEGER) AS qty FROM lineitem")
def extend_expr(t):
    return t.lineitem.extend({"qty": fn.cast_as_integer(F.col("l_quantity"))}).project("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_shipdate", "qty")


@query("SELECT s_suppkey, s_name, s_nationkey + 1 AS s_nationkey, s_acctbal FROM supplier")
def update_expr(t):
    return t.supplier.update({"s_nationkey": F.col("s_nationkey") + 1})


@query("SELECT c_nationkey AS nk FROM customer UNION SELECT s_nationkey FROM supplier")
def union_set(t):
    return t.customer.project("c_nationkey").rename({"c_nationkey": "nk"}).union(t.supplier.project("s_nationkey").rename({"s_nationkey": "nk"}))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus='F' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus<>'F'")
def d_union_disjoint(t):
    return t.orders.where("o_orderstatus = 'F'").project("o_orderkey").d_union(t.orders.where("o_orderstatus <> 'F'").project("o_orderkey"))


@query("SELECT c_nationkey AS nk FROM customer WHERE c_acctbal > 9700.0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000.0")
def intersect_set(t):
    a = t.customer.where("c_acctbal > 9700.0").project("c_nationkey").rename({"c_nationkey": "nk"})
    return a.intersect(t.supplier.where("s_acctbal > 5000.0").project("s_nationkey").rename({"s_nationkey": "nk"}))


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def minus_set(t):
    return t.orders.project("o_custkey").minus(t.orders.where("o_orderstatus = 'P'").project("o_custkey")).rename({"o_custkey": "k"})


def _buyers(t):
    return t.orders.where("o_totalprice > 200000.0").project("o_custkey").rename({"o_custkey": "c_custkey"})


@query("SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice > 200000.0)")
def semijoin_matching(t):
    return t.customer.matching(_buyers(t))


@query("SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice > 200000.0)")
def semiminus_not_matching(t):
    return t.customer.not_matching(_buyers(t))


@query("SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey=r_regionkey")
def join_natural(t):
    return t.nation.join(t.region.rename({"r_regionkey": "n_regionkey"}))


@query("SELECT n_name, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey WHERE l_quantity > 25 GROUP BY n_name")
def join_three(t):
    items = t.lineitem.where("l_quantity > 25").rename({"l_orderkey": "orderkey"})
    orders = t.orders.project("o_orderkey", "o_custkey").rename({"o_orderkey": "orderkey", "o_custkey": "custkey"})
    customers = t.customer.project("c_custkey", "c_nationkey").rename({"c_custkey": "custkey", "c_nationkey": "nationkey"})
    nations = t.nation.project("n_nationkey", "n_name").rename({"n_nationkey": "nationkey"})
    sums = items.join(orders).join(customers).join(nations).summarize(["n_name"], {"revenue": SUM(F.col("l_extendedprice").cast(MONEY))})
    return Relation(sums.df.withColumn("revenue", F.col("revenue").cast("double")), sums.keys)


@query("SELECT r_regionkey, r_name, n_name FROM region CROSS JOIN (SELECT DISTINCT n_name FROM nation)")
def join_cartesian(t):
    return t.region.join(t.nation.project("n_name"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey")
def join_theta(t):
    a = t.nation.project("n_nationkey").rename({"n_nationkey": "a"})
    return a.join(a.rename({"a": "b"})).where("a < b")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000.0) ON c_custkey = o_custkey WHERE o_orderkey IS NOT NULL UNION SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000.0)")
def join_outer_emulated(t):
    big = t.orders.where("o_totalprice > 400000.0").project("o_orderkey", "o_custkey").rename({"o_custkey": "c_custkey"})
    people = t.customer.project("c_custkey")
    return people.join(big).union(people.not_matching(big).extend({"o_orderkey": F.lit(-1).cast("long")}))


@query("SELECT l_returnflag, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s, AVG(l_linenumber) AS a, MIN(l_quantity) AS mn, MAX(l_quantity) AS mx FROM lineitem GROUP BY l_returnflag")
def summarize_aggs(t):
    return t.lineitem.summarize(["l_returnflag"], {"n": COUNT(), "s": SUM("l_linenumber"), "a": AVG("l_linenumber"), "mn": MIN("l_quantity"), "mx": MAX("l_quantity")})


@query("SELECT l_returnflag, BOOL_AND(l_quantity>0) AS al, BOOL_OR(l_quantity>49) AS an FROM lineitem GROUP BY l_returnflag")
def summarize_all_any(t):
    return t.lineitem.summarize(["l_returnflag"], {"al": ALL(F.col("l_quantity") > 0), "an": ANY(F.col("l_quantity") > 49)})


@query("SELECT n_nationkey, COUNT(c_custkey) AS n FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9900.0) ON c_nationkey=n_nationkey GROUP BY n_nationkey")
def summarize_per_empty(t):
    rich = t.customer.where("c_acctbal > 9900.0").rename({"c_nationkey": "n_nationkey"})
    return rich.summarize(t.nation.project("n_nationkey"), {"n": COUNT()})


@query("SELECT COUNT(*) AS n, MAX(o_totalprice) AS mx FROM orders")
def summarize_dee(t):
    return t.orders.summarize(dee(t.spark), {"n": COUNT(), "mx": MAX("o_totalprice")})


@query("WITH t3 AS (SELECT DISTINCT l_suppkey, l_quantity FROM lineitem WHERE l_returnflag='R'), t2 AS (SELECT DISTINCT l_quantity FROM lineitem) SELECT s_suppkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM t2 WHERE NOT EXISTS (SELECT 1 FROM t3 WHERE t3.l_suppkey=s.s_suppkey AND t3.l_quantity=t2.l_quantity))")
def divide_small(t):
    sold = t.lineitem.where("l_returnflag = 'R'").project("l_suppkey", "l_quantity").rename({"l_suppkey": "s_suppkey"})
    return t.supplier.project("s_suppkey").divide(t.lineitem.project("l_quantity"), sold)


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def wrap_unwrap(t):
    return t.customer.project("c_custkey", "c_name", "c_nationkey").wrap({"w": ["c_name", "c_nationkey"]}).unwrap("w")


@query("SELECT n_regionkey, CAST(COUNT(*) AS INTEGER) AS n FROM nation GROUP BY n_regionkey")
def group_count(t):
    grouped = t.nation.group(["n_nationkey", "n_name"], "g")
    return grouped.extend({"n": F.size("g")}).project("n_regionkey", "n")


@query("SELECT n_regionkey, n_name, n_nationkey FROM nation")
def group_ungroup(t):
    return t.nation.group(["n_nationkey", "n_name"], "g").ungroup("g")


@query("SELECT c_nationkey, CAST(SUM(c_custkey) AS BIGINT) AS s, MAX(c_acctbal) AS mx, round(AVG(CAST(c_custkey AS DOUBLE)), 6) AS a FROM customer GROUP BY c_nationkey")
def rva_aggregates(t):
    grouped = t.customer.project("c_custkey", "c_nationkey", "c_acctbal").group(["c_custkey", "c_acctbal"], "g")
    new = {"s": Nested("sum", "g", lambda x: x["c_custkey"]), "mx": Nested("max", "g", lambda x: x["c_acctbal"]), "a": Nested("avg", "g", lambda x: x["c_custkey"])}
    return grouped.extend(new).update({"a": F.round("a", 6)}).remove("g")


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey*7+3)%25 AS b FROM nation), t(a,b) AS (SELECT a,b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b=e.a) SELECT a, b FROM t")
def tclose_cyclic(t):
    return t.nation.extend({"b": (F.col("n_nationkey") * 7 + 3) % 25}).rename({"n_nationkey": "a"}).project("a", "b").tclose()


def _truth(t, value: bool) -> DataFrame:
    return relation(t.spark, [(value,)], "ok boolean").df


@query("SELECT NOT EXISTS (SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation) AS ok")
def subset_of_fk(t):
    return _truth(t, t.customer.project("c_nationkey").rename({"c_nationkey": "n_nationkey"}).subset_of(t.nation.project("n_nationkey")))


@query("SELECT NOT EXISTS (SELECT n_regionkey FROM nation EXCEPT SELECT r_regionkey FROM region) AND NOT EXISTS (SELECT r_regionkey FROM region EXCEPT SELECT n_regionkey FROM nation) AS ok")
def relation_equal(t):
    return _truth(t, t.nation.project("n_regionkey").equals(t.region.project("r_regionkey").rename({"r_regionkey": "n_regionkey"})))


@query("SELECT NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS ok")
def is_empty_test(t):
    return _truth(t, t.orders.where("o_totalprice < 0").is_empty())


@query("SELECT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3 AND n_regionkey = 3 % 5) AS ok")
def in_test(t):
    return _truth(t, t.nation.project("n_nationkey", "n_regionkey").contains({"n_nationkey": 3, "n_regionkey": 3}))


@query("SELECT 1 AS dee, 0 AS dum")
def nullary(t):
    return relation(t.spark, [(dee(t.spark).df.count(), dum(t.spark).df.count())], "dee int, dum int")


@query("SELECT n_name FROM nation WHERE n_nationkey = 7")
def to_tuple_row(t):
    return relation(t.spark, [tuple(t.nation.where("n_nationkey = 7").project("n_name").to_tuple())], "n_name string")


@query("SELECT n_nationkey, CAST((SELECT COUNT(*) FROM nation x WHERE x.n_regionkey < n.n_regionkey) AS INTEGER) AS rk FROM nation n")
def quota_query(t):
    return t.nation.count_below("n_regionkey", "rk").project("n_nationkey", "rk")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 10")
def load_topk(t):
    return t.orders.project("o_orderkey", "o_totalprice").ordered([("o_totalprice", "desc"), ("o_orderkey", "asc")], 10)


@query("SELECT p_partkey, length(p_name) AS n, substring(p_name,1,3) AS pre, upper(p_brand) AS u, p_name || '-' || p_type AS c, starts_with(p_name,'small') AS sw, strpos(p_name,' ')-1 AS pos FROM part")
def string_ops(t):
    n = F.col("p_name")
    new = {
        "n": fn.strlen(n).cast("long"), "pre": fn.substr(n, 0, 3), "u": fn.upper(F.col("p_brand")), "c": fn.concat(fn.concat(n, "-"), F.col("p_type")),
        "sw": fn.starts_with(n, "small"), "pos": fn.strfind_b(n, " ").cast("long"),
    }
    return t.part.extend(new).project("p_partkey", *new)


@query("SELECT p_partkey, octet_length(encode(p_name)) AS nb, lower(p_brand) AS lo, substring(p_name, 3) AS rest, printf('%05d|%s|%.2f', p_size, p_brand, p_retailprice) AS f FROM part")
def string_ops_b(t):
    n = F.col("p_name")
    new = {"nb": fn.strlen_b(n).cast("long"), "lo": fn.lower(F.col("p_brand")), "rest": fn.substr_b(n, 2), "f": fn.format_("%05d|%s|%.2f", F.col("p_size"), F.col("p_brand"), F.col("p_retailprice"))}
    return t.part.extend(new).project("p_partkey", *new)


@query("SELECT p_partkey, p_name FROM part WHERE p_name GLOB 's*l?ring' OR p_name GLOB 's* ring'")
def like_glob(t):
    n = F.col("p_name")
    return t.part.where(fn.like(n, "s*l?ring") | fn.like(n, "s* ring")).project("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#[1-3]$')")
def regex_like(t):
    return t.part.where(fn.regex_like(F.col("p_brand"), "#[1-3]$")).project("p_partkey")


@query("SELECT c_custkey, (c_nationkey - 12) // 5 AS q, (c_nationkey - 12) % 5 AS m, abs(c_nationkey - 12) AS ab FROM customer")
def int_math(t):
    k = F.col("c_nationkey") - 12
    return t.customer.extend({"q": fn.div(k, 5).cast("int"), "m": fn.mod(k, 5), "ab": fn.abs_(k)}).project("c_custkey", "q", "m", "ab")


@query("SELECT p_partkey, round(sqrt(p_retailprice),6) AS sq, round(ln(p_retailprice),6) AS l, round(log10(p_retailprice),6) AS lg FROM part")
def float_math(t):
    p = F.col("p_retailprice")
    return t.part.extend({"sq": F.round(fn.sqrt(p), 6), "l": F.round(fn.ln(p), 6), "lg": F.round(fn.log(p), 6)}).project("p_partkey", "sq", "l", "lg")


@query("SELECT p_partkey, round(sin(p_size), 6) AS s, round(cos(p_size), 6) AS c, round(atan(p_size), 6) AS a, round(atan2(p_size, 2), 6) AS a2, round(power(p_size, 1.5), 4) AS pw, round(exp(p_size / 10.0), 6) AS e FROM part")
def float_math_more(t):
    p = fn.cast_as_float(F.col("p_size"))
    new = {"s": F.round(fn.sin(p), 6), "c": F.round(fn.cos(p), 6), "a": F.round(fn.atan(p), 6), "a2": F.round(fn.atan2(p, 2.0), 6), "pw": F.round(fn.power(p, 1.5), 4), "e": F.round(fn.exp(fn.div_float(p, 10.0)), 6)}
    return t.part.extend(new).project("p_partkey", *new)


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS sz FROM part")
def if_then(t):
    return t.part.extend({"sz": fn.if_then_else(F.col("p_size") > 25, "big", "small")}).project("p_partkey", "sz")


@query("SELECT c_custkey, (c_acctbal > 0) AND (c_nationkey > 5) AS a, (c_acctbal > 0) OR (c_nationkey > 5) AS o, (c_acctbal > 0) <> (c_nationkey > 5) AS x, NOT (c_acctbal > 0) AS n FROM customer")
def boolean_ops(t):
    a, b = F.col("c_acctbal") > 0, F.col("c_nationkey") > 5
    return t.customer.extend({"a": fn.and_(a, b), "o": fn.or_(a, b), "x": fn.xor(a, b), "n": fn.not_(a)}).project("c_custkey", "a", "o", "x", "n")


@query("SELECT s_suppkey, CAST(trunc(s_acctbal) AS INTEGER) AS i, CAST(s_nationkey AS DOUBLE) AS f, CAST(s_nationkey AS VARCHAR) AS s FROM supplier")
def casts(t):
    new = {"i": fn.cast_as_integer(F.col("s_acctbal")), "f": fn.cast_as_float(F.col("s_nationkey")), "s": fn.cast_as_string(F.col("s_nationkey"))}
    return t.supplier.extend(new).project("s_suppkey", *new)


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(dayofweek(o_orderdate) AS INTEGER) AS wd, o_orderdate + INTERVAL 90 SECOND AS later FROM orders")
def datetime_ops(t):
    d = F.col("o_orderdate")
    return t.orders.extend({"y": fn.year(d), "m": fn.month(d), "wd": fn.weekday(d), "later": fn.add_seconds(d, 90)}).project("o_orderkey", "y", "m", "wd", "later")


@query("SELECT o_orderkey, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(hour(o_orderdate) AS INTEGER) AS h, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS s, make_timestamp(2001, month(o_orderdate), 1, 2, 3, 4.0) AS made FROM orders")
def datetime_parts(t):
    d = F.col("o_orderdate")
    return t.orders.extend({"d": fn.day(d), "h": fn.hour(d), "s": fn.cast_as_string(d, datetime=True), "made": fn.datetime(2001, fn.month(d), 1, 2, 3, 4)}).project("o_orderkey", "d", "h", "s", "made")


@query("SELECT n_nationkey, n_regionkey AS first, CAST(2 AS INTEGER) AS n, CAST(CASE WHEN n_regionkey = n_nationkey THEN 0 ELSE 1 END AS INTEGER) AS at FROM nation")
def array_ops(t):
    a = fn.array_(F.col("n_regionkey"), F.col("n_nationkey"))
    return t.nation.extend({"first": fn.array_at(a, 0), "n": fn.array_length(a), "at": fn.index_of(a, F.col("n_nationkey"))}).project("n_nationkey", "first", "n", "at")


@query("SELECT n_nationkey, n_name AS nm, n_regionkey + 1 AS up FROM nation")
def tuple_ops(t):
    a = fn.tuple_rename(fn.tuple_(n_name=F.col("n_name"), k=F.col("n_nationkey")), ["n_name", "k"], {"n_name": "nm"})
    b = fn.tuple_extend(fn.tuple_(k=F.col("n_nationkey")), up=F.col("n_regionkey") + 1)
    whole = fn.tuple_remove(fn.tuple_union(a, ["nm", "k"], b, ["k", "up"]), ["k"])
    return t.nation.project("n_nationkey", "n_name", "n_regionkey").extend({"t": whole}).project("n_nationkey", "t").unwrap("t")


@query("SELECT * FROM nation WHERE NOT (n_regionkey = 1 AND n_nationkey > 10)")
def view_delete(t):
    db = Database(t.spark)
    db.private("nation", t.nation, [["n_nationkey"]])
    db.virtual("america", View("nation", [("where", "n_regionkey = 1")]))
    db.assign(db.delete_where("america", "n_nationkey > 10"))
    return db["nation"]


@query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey = 3 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_where(t):
    db = Database(t.spark)
    db.private("supplier", t.supplier, [["s_suppkey"]])
    db.assign(db.update("supplier", "s_nationkey = 3", {"s_acctbal": F.lit(0.0)}))
    return db["supplier"]


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 9, 'NEW'")
def multiple_assignment(t):
    db = Database(t.spark)
    db.private("region", t.region, [["r_regionkey"]])
    db.private("gone", t.region.where("false"), [["r_regionkey"]])
    db.constraint("enough", lambda d: not d["region"].is_empty())
    db.begin()
    db.assign(db.delete("region", t.region.where("r_regionkey = 2")), db.insert("gone", t.region.where("r_regionkey = 2")))
    db.commit()
    db.assign(db.insert("region", db.tuples("region", [{"r_regionkey": 9, "r_name": "NEW"}])))
    return db["region"]


@query("SELECT COUNT(*) AS bad FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey=l_orderkey)")
def constraint_violations(t):
    lost = t.lineitem.not_matching(t.orders.project("o_orderkey").rename({"o_orderkey": "l_orderkey"}))
    return lost.summarize(dee(t.spark), {"bad": COUNT()})


@query("SELECT n_nationkey, n_regionkey + n_nationkey AS y, n_regionkey * 10 AS scaled FROM nation")
def user_types_and_operators(t):
    point = UserType("point", {"point": {"x": "integer", "y": "integer"}}, constraint=lambda x, y: x >= 0, init=(0, 0))
    tenfold = macro("tenfold", lambda x: x * 10, 1)
    p = point.select(F.col("n_regionkey"), F.col("n_regionkey") + F.col("n_nationkey"))
    return t.nation.extend({"p": p}).extend({"y": point.the("y", F.col("p")), "scaled": tenfold(point.the("x", F.col("p")))}).project("n_nationkey", "y", "scaled")


@query("SELECT r_regionkey, r_name FROM region")
def json_round_trip(t):
    return to_json(t.region).select(F.from_json("json", "r_regionkey int, r_name string").alias("r")).select("r.*")


_NAMES = "SELECT column_name AS name, lower(CASE column_type WHEN 'BIGINT' THEN 'long' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'float' WHEN 'TIMESTAMP' THEN 'datetime' ELSE column_type END) AS type FROM (DESCRIBE {})"


@query(_NAMES.format("orders"))
def heading_of(t):
    return t.orders.heading()


@query(f"SELECT name AS attrname, 'region' AS tablename, type, CAST(row_number() OVER (ORDER BY name <> 'r_regionkey', name) - 1 AS INTEGER) AS i_fno FROM ({_NAMES.format('region')})")
def catalog_tables(t):
    db = Database(t.spark)
    db.private("region", t.region, [["r_regionkey"]])
    return db["sys_tableattrs"]


@query("SELECT l_orderkey, l_linenumber, CAST(minute(l_shipdate) AS INTEGER) AS mi, CAST(second(l_shipdate) AS INTEGER) AS se, l_extendedprice + 1.5 AS plus, -l_extendedprice AS neg, -l_linenumber AS ineg FROM lineitem GROUP BY ALL")
def getters_and_signs(t):
    d = F.col("l_shipdate")
    new = {"mi": fn.minute(d), "se": fn.second(d), "plus": fn.add_float(F.col("l_extendedprice"), 1.5), "neg": -F.col("l_extendedprice"), "ineg": -F.col("l_linenumber")}
    return t.lineitem.extend(new).project("l_orderkey", "l_linenumber", *new)


@query("SELECT o_orderkey, make_timestamp(1999, month(o_orderdate), 1, 7, 0, 0.0) AS d FROM orders")
def datetime_setters(t):
    d = F.col("o_orderdate")
    for part, value in (("day", 1), ("year", 1999), ("hour", 7), ("minute", 0), ("second", 0)):
        d = fn.set_component(d, part, value)
    return t.orders.extend({"d": d}).project("o_orderkey", "d")


@query("SELECT p_partkey, substring(p_name, 2, 3) AS mid, coalesce(nullif(strpos(substring(p_name, 3), 'e'), 0) + 1, -1) AS at, hex(encode(p_brand)) AS hx FROM part")
def string_bytes(t):
    n = F.col("p_name")
    new = {"mid": fn.substr_b(n, 1, 3), "at": fn.strfind_b(n, "e", 2).cast("long"), "hx": F.hex(fn.cast_as_binary(F.col("p_brand")))}
    return t.part.extend(new).project("p_partkey", *new)


@query("SELECT n_nationkey, 'long' AS kind, n_nationkey AS v, n_regionkey = 0 AS same FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_regionkey FROM nation)")
def serialize_and_arrays(t):
    k = F.col("n_nationkey").cast("long")
    text = F.decode(fn.serialize(k), "UTF-8")
    new = {
        "kind": F.when(F.get_json_object(text, "$.type") == "bigint", "long").otherwise("other"), "v": F.get_json_object(text, "$.value").cast("long"),
        "same": fn.array_(F.col("n_regionkey"), F.lit(0)) == fn.array_(F.lit(0), F.col("n_regionkey")),
    }
    return t.nation.extend(new).project("n_nationkey", *new)


@query("SELECT p_partkey, regexp_matches(p_brand, '[[:digit:]]$') AS d, regexp_matches(p_name, '^[[:alpha:] ]+$') AS a, p_type LIKE '%' || substr(p_name, 1, 1) || '%' AS l FROM part")
def patterns(t):
    n = F.col("p_name")
    new = {"d": fn.regex_like(F.col("p_brand"), "[[:digit:]]$"), "a": fn.regex_like(n, "^[[:alpha:] ]+$"), "l": fn.like(F.col("p_type"), F.concat(F.lit("*"), fn.substr(n, 0, 1), F.lit("*")))}
    return t.part.extend(new).project("p_partkey", *new)


@query("SELECT o_orderkey, o_orderkey * 9000000000 // 7 AS q FROM orders")
def wide_division(t):
    return t.orders.extend({"q": fn.div(F.col("o_orderkey") * F.lit(9000000000), 7)}).project("o_orderkey", "q")


@query("SELECT * FROM region UNION ALL SELECT 10 + r_regionkey, 'X' || r_name FROM region UNION ALL SELECT 30, 'last'")
def insert_deltas(t):
    """INSERTs append; a tuple that is there already is no error."""
    db = Database(t.spark)
    db.private("region", t.region, [["r_regionkey"]])
    more = t.region.update({"r_regionkey": F.col("r_regionkey") + 10, "r_name": F.concat(F.lit("X"), F.col("r_name"))})
    db.assign(db.insert("region", more))
    db.assign(db.insert("region", t.region.where("r_regionkey < 2")))
    db.assign(db.insert("region", db.tuples("region", [{"r_regionkey": 30, "r_name": "last"}])))
    return db["region"]


@query("SELECT n_regionkey, n_nationkey FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 99, n_nationkey FROM nation WHERE n_nationkey % 2 = 1")
def update_through_projection(t):
    db = Database(t.spark)
    db.private("nation", t.nation, [["n_nationkey"]])
    db.virtual("short", View("nation", [("project", ["n_nationkey", "n_regionkey"])]))
    db.assign(db.update("short", "n_nationkey % 2 = 1", {"n_regionkey": F.lit(99)}))
    return db["short"]


@query("SELECT s_suppkey AS id, s_name FROM supplier WHERE s_suppkey BETWEEN 1 AND 5 UNION ALL SELECT 900000 + s_suppkey, 'new' FROM supplier WHERE s_suppkey <= 3")
def insert_through_views(t):
    db = Database(t.spark)
    db.private("s", t.supplier.project("s_suppkey", "s_name").where("s_suppkey <= 5"), [["s_suppkey"]])
    db.virtual("named", View("s", [("rename", {"s_suppkey": "id"}), ("where", "id > 0")]))
    db.assign(db.insert("named", t.supplier.where("s_suppkey <= 3").update({"s_name": F.lit("new"), "s_suppkey": F.col("s_suppkey") + 900000}).project("s_suppkey", "s_name").rename({"s_suppkey": "id"})))
    return db["named"]


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN r_regionkey = 2 THEN 1 ELSE 0 END) AS BIGINT) AS two, 3 AS errors FROM region WHERE r_regionkey <> 4")
def strict_assignments(t):
    """D_INSERT of a tuple that is there, I_DELETE of one that isn't, and a key that another tuple has are errors."""
    db = Database(t.spark)
    db.private("r", t.region, [["r_regionkey"]])
    four, caught = t.region.where("r_regionkey = 4"), 0
    db.assign(db.i_delete("r", four))
    clash = db.tuples("r", [{"r_regionkey": 2, "r_name": "other"}])
    for change in (lambda: db.i_delete("r", four), lambda: db.d_insert("r", t.region.where("r_regionkey = 2")), lambda: db.insert("r", clash)):
        try:
            db.assign(change())
        except (errors.NotFound, errors.ElementExists, errors.KeyViolation):
            caught += 1
    return db["r"].df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("r_regionkey") == 2, 1).otherwise(0)).alias("two"), F.lit(caught).alias("errors"))
