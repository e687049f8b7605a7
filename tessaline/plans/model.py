"""The driver's tables seen as an include graph, by SQL that both engines run.

Orders are roots; customers, parts, suppliers, nations and regions are headers.
Every frame is one SELECT over the base tables, so a query and its oracle start
from the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import bound_broadcasts, numbered, stored

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def _name(kind: str, key: str, suffix: str) -> str:
    return f"'{kind}/' || cast({key} as varchar(20)) || '{suffix}'"


def order(key: str) -> str:
    return _name("orders", key, ".cc")


def part(key: str) -> str:
    """Parts fall into the path classes that filters tell apart."""
    n = f"cast({key} as varchar(20))"
    return (
        f"(case {key} % 7 when 0 then 'third_party/part/' || {n} || '.h' when 1 then 'third_party/blink/part/' || {n} || '.h' "
        f"when 2 then 'out/Debug/gen/part/' || {n} || '.h' when 3 then 'v8/part/' || {n} || '.h' "
        f"when 4 then 'part/' || {n} || '.mojom.h' else 'part/' || {n} || '.h' end)"
    )


CUSTOMER, SUPPLIER = (lambda k: _name("customer", k, ".h")), (lambda k: _name("supplier", k, ".h"))
NATION, REGION = (lambda k: _name("nation", k, ".h")), (lambda k: _name("region", k, ".h"))

EDGES = f"""
select {order('l_orderkey')} as src, {part('l_partkey')} as dst, cast(sum(cast(l_quantity as bigint)) as bigint) as esize from {{lineitem}} group by l_orderkey, l_partkey
union all select {order('o_orderkey')}, {CUSTOMER('o_custkey')}, cast(o_orderkey % 50 as bigint) from {{orders}}
union all select {part('l_partkey')}, {SUPPLIER('l_suppkey')}, cast(sum(cast(l_linenumber as bigint)) as bigint) from {{lineitem}} group by l_partkey, l_suppkey
union all select {CUSTOMER('c_custkey')}, {NATION('c_nationkey')}, cast(c_custkey % 9 as bigint) from {{customer}}
union all select {SUPPLIER('s_suppkey')}, {NATION('s_nationkey')}, cast(s_suppkey % 9 as bigint) from {{supplier}}
union all select {NATION('n_nationkey')}, {REGION('n_regionkey')}, cast(3 as bigint) from {{nation}}
union all select {REGION('r_regionkey')}, {NATION('r_regionkey')}, cast(4 as bigint) from {{region}}
"""

#: The same edges by number: kind in the high bits, key in the low.
ID_EDGES = """
select distinct l_orderkey as src, 1099511627776 + l_partkey as dst from {lineitem}
union all select o_orderkey, 2 * 1099511627776 + o_custkey from {orders}
union all select distinct 1099511627776 + l_partkey, 3 * 1099511627776 + l_suppkey from {lineitem}
union all select 2 * 1099511627776 + c_custkey, 4 * 1099511627776 + c_nationkey from {customer}
union all select 3 * 1099511627776 + s_suppkey, 4 * 1099511627776 + s_nationkey from {supplier}
union all select 4 * 1099511627776 + n_nationkey, 5 * 1099511627776 + n_regionkey from {nation}
union all select 5 * 1099511627776 + r_regionkey, 4 * 1099511627776 + r_regionkey from {region}
"""

ROOTS = f"select {order('o_orderkey')} as node from {{orders}}"
ID_ROOTS = "select o_orderkey as node from {orders}"

FILES = f"""
select file, size, size * 10 + 7 as tsize, size + 1 as asize, size % 97 as prevalence from (
select {order('o_orderkey')} as file, cast(floor(o_totalprice) as bigint) as size from {{orders}}
union all select {part('p_partkey')}, cast(p_size as bigint) from {{part}}
union all select {CUSTOMER('c_custkey')}, cast(length(c_name) + c_custkey % 11 as bigint) from {{customer}}
union all select {SUPPLIER('s_suppkey')}, cast(length(s_name) as bigint) from {{supplier}}
union all select {NATION('n_nationkey')}, cast(length(n_name) as bigint) from {{nation}}
union all select {REGION('r_regionkey')}, cast(length(r_name) as bigint) from {{region}}) as sized
"""

#: The files of these numbers.
FILE_IDS = f"""
select o_orderkey as id, {order('o_orderkey')} as file from {{orders}}
union all select 1099511627776 + p_partkey, {part('p_partkey')} from {{part}}
union all select 2 * 1099511627776 + c_custkey, {CUSTOMER('c_custkey')} from {{customer}}
union all select 3 * 1099511627776 + s_suppkey, {SUPPLIER('s_suppkey')} from {{supplier}}
union all select 4 * 1099511627776 + n_nationkey, {NATION('n_nationkey')} from {{nation}}
union all select 5 * 1099511627776 + r_regionkey, {REGION('r_regionkey')} from {{region}}
"""

#: Changes in the order of line items; oracles number them by a window, queries by :func:`in_order`.
ORDERED = "row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as pos, "
CHANGES = f"""
select {ORDERED}
  case l_returnflag when 'R' then 'remove' when 'A' then 'add' else 'other' end as change_type,
  l_linenumber as line, {order('l_orderkey')} as includer, {part('l_partkey')} as header, l_extendedprice as weight
from {{lineitem}}
"""

#: Edges suggested for removal and addition, few enough for small closures.
UNUSED = f"select distinct {order('l_orderkey')} as src, {part('l_partkey')} as dst from {{lineitem}} where l_returnflag = 'R'"
ADDS = f"select distinct {part('l_partkey')} as src, {CUSTOMER('l_suppkey')} as dst from {{lineitem}} where l_returnflag = 'A' and l_linenumber = 1"


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A frame of this module over the tables in ``sf_dir``."""
    bound_broadcasts(spark)
    return spark.sql(text.format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


_kept: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table that ``make`` returns, written once in a session, as a loaded analysis is."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = stored(make(), f"model-{name}")
    return _kept[key]


def in_order(spark: SparkSession, sf_dir: str, text: str, name: str) -> DataFrame:
    """A select that :data:`ORDERED` numbers, numbered by ranges and written once in a session."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    bare = text.replace(ORDERED, ", ".join(f"{c} as _o{i}" for i, c in enumerate(order)) + ", ")
    make = lambda: numbered(spark_sql(spark, sf_dir, bare), [f"_o{i}" for i in range(len(order))], "pos").drop(*(f"_o{i}" for i in range(len(order))))
    return kept(spark, sf_dir, name, make)


def oracle(text: str) -> str:
    """The same text over DuckDB's views."""
    return text.format(**{t: t for t in TABLES})
