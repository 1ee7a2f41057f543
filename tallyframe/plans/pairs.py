"""Source and altered target of the driver's tables, from SQL that Spark and DuckDB both run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.pair import TablePair


@dataclass(frozen=True)
class Pair:
    table: str
    keys: tuple[str, ...]
    decimals: tuple[tuple[str, str], ...]
    target: str

    @property
    def source(self) -> str:
        return f"select {', '.join(f'cast({c} as {d}) as {c}' if (d := dict(self.decimals).get(c)) else c for c in COLUMNS[self.table])} from {self.table}"


COLUMNS = {
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "conversations": ("conv_id", "turn", "role", "text"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
}
_D6, _D4 = "decimal(18,6)", "decimal(18,4)"

PAIRS = {
    "orders": Pair("orders", ("o_orderkey",), (("o_totalprice", _D6),), f"""
select o_orderkey, o_custkey, o_orderstatus,
 cast(case when o_orderkey % 4999 = 7 then cast(o_totalprice as {_D6}) + cast(1 as {_D6})
           when o_orderkey % 1777 = 3 then cast(o_totalprice as {_D6}) + cast(0.00005 as {_D6})
           else cast(o_totalprice as {_D6}) end as {_D6}) as o_totalprice, o_orderdate,
 case when o_orderkey % 2999 = 17 then cast(null as string) when o_orderkey % 2503 = 19 then '' else o_orderpriority end as o_orderpriority
from orders where o_orderkey % 3571 <> 11
union all
select o_orderkey + 1000000, o_custkey, o_orderstatus, cast(o_totalprice as {_D6}), o_orderdate, o_orderpriority
from orders where o_orderkey % 4001 = 13"""),
    "customer": Pair("customer", ("c_custkey",), (("c_acctbal", _D4),), f"""
select c_custkey, case when c_custkey % 701 = 5 then concat(c_name,'  ') else c_name end as c_name, c_nationkey,
 cast(case when c_custkey % 499 = 3 then cast(c_acctbal as {_D4}) + cast(0.0002 as {_D4})
           else cast(c_acctbal as {_D4}) end as {_D4}) as c_acctbal, c_mktsegment
from customer where c_custkey % 733 <> 9"""),
    "part": Pair("part", ("p_partkey",), (("p_retailprice", _D4),), f"""
select p_partkey, p_name, p_brand, p_type, case when p_partkey % 611 = 4 then p_size + 1 else p_size end as p_size,
 cast(p_retailprice as {_D4}) as p_retailprice from part"""),
    "events": Pair("events", ("event_id",), (("value", _D4),), f"""
select event_id, case when event_id % 2503 = 8 then date_trunc('second', ts) else ts end as ts, user_id, event_type,
 cast(case when event_id % 1999 = 6 then cast(value as {_D4}) + cast(0.5 as {_D4})
           else cast(value as {_D4}) end as {_D4}) as value, props
from events where event_id % 3001 <> 10"""),
    "conversations": Pair("conversations", ("conv_id", "turn"), (), """
select conv_id, turn, case when (conv_id * 8 + turn) % 97 = 5 then upper(role) else role end as role, text
from conversations where (conv_id * 8 + turn) % 101 <> 7"""),
    "documents": Pair("documents", ("doc_id",), (), """
select doc_id, case when doc_id % 211 = 3 then concat(text,'x')
  when length(text) > 3000 then concat(substr(text,1,1500),'#',substr(text,1502)) else text end as text, lang, source, n_chars
from documents"""),
    "lineitem": Pair("lineitem", (), tuple((c, "decimal(18,2)") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")), """
select l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_quantity as decimal(18,2)) as l_quantity, cast(l_extendedprice as decimal(18,2)) as l_extendedprice,
 cast(l_discount as decimal(18,2)) as l_discount, cast(l_tax as decimal(18,2)) as l_tax, l_returnflag, l_linestatus, l_shipdate
from (select * from lineitem where l_orderkey % 4999 <> 7
union all select * from lineitem where l_orderkey % 6007 = 11) x"""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> TablePair:
    """The pair as DataFrames; the SQL runs over this one table and leaves no view behind."""
    pair = PAIRS[name]
    df = table(spark, sf_dir, pair.table)
    view = "__pair_" + name
    df.createOrReplaceTempView(view)
    try:
        source, target = (spark.sql(_over(text, pair.table, view)) for text in (pair.source, pair.target))
    finally:
        spark.catalog.dropTempView(view)
    return TablePair(source, target, pair.keys)


def _over(text: str, name: str, view: str) -> str:
    import re

    return re.sub(rf"\bfrom {name}\b", f"from {view}", text)


def day(df: DataFrame, column: str = "ts") -> DataFrame:
    return df.withColumn("day", F.date_format(column, "yyyy-MM-dd"))
