"""The driver's tables and what is promised about them: candidate keys; lineitem's is all its attributes."""

KEYS = {
    "region": [["r_regionkey"]], "nation": [["n_nationkey"]], "customer": [["c_custkey"]], "supplier": [["s_suppkey"]],
    "part": [["p_partkey"]], "orders": [["o_orderkey"]], "events": [["event_id"]],
    "lineitem": [[f"l_{a}" for a in "orderkey partkey suppkey linenumber quantity extendedprice discount tax returnflag linestatus shipdate".split()]],
}
