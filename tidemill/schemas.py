"""Typed schemas of the relations and the projections that the star join needs."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "date": T.DateType(), "decimal(15,2)": T.DecimalType(15, 2)}


def schema(columns: str) -> T.StructType:
    """A schema of ``name type, ...``; needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


#: Delimited-file layouts, all columns.
RELATIONS = {
    "customer": schema("c_custkey bigint, c_name string, c_address string, c_nationkey int, c_phone string, c_acctbal decimal(15,2), c_mktsegment string, c_comment string"),
    "orders": schema("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice decimal(15,2), o_orderdate date, o_orderpriority string, o_clerk string, o_shippriority int, o_comment string"),
    "lineitem": schema(
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity decimal(15,2), l_extendedprice decimal(15,2), l_discount decimal(15,2), l_tax decimal(15,2), "
        "l_returnflag string, l_linestatus string, l_shipdate date, l_commitdate date, l_receiptdate date, l_shipinstruct string, l_shipmode string, l_comment string"
    ),
    "supplier": schema("s_suppkey bigint, s_name string, s_address string, s_nationkey int, s_phone string, s_acctbal decimal(15,2), s_comment string"),
    "nation": schema("n_nationkey int, n_name string, n_regionkey int, n_comment string"),
    "region": schema("r_regionkey int, r_name string, r_comment string"),
    "inner": schema("i_key string, i_cnt bigint"),
    "outer": schema("o_key string, o_cnt bigint"),
}

#: Columns that the star join reads.
STAR_COLUMNS = {
    "customer": ["c_custkey", "c_nationkey"],
    "orders": ["o_orderkey", "o_custkey", "o_orderdate"],
    "lineitem": ["l_orderkey", "l_suppkey", "l_extendedprice", "l_discount"],
    "supplier": ["s_suppkey", "s_nationkey"],
    "nation": ["n_nationkey", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
}
