"""DuckDB SQL for the registered queries, put together from the pairs' own SQL."""

from __future__ import annotations

from tallyframe.plans.pairs import COLUMNS, PAIRS

KINDS = {
    "o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "str", "o_totalprice": "dec6", "o_orderdate": "ts", "o_orderpriority": "str",
    "c_custkey": "int", "c_name": "str", "c_nationkey": "int", "c_acctbal": "dec4", "c_mktsegment": "str",
    "p_partkey": "int", "p_name": "str", "p_brand": "str", "p_type": "str", "p_size": "int", "p_retailprice": "dec4",
    "event_id": "int", "ts": "ts", "user_id": "int", "event_type": "str", "value": "dec4", "props": "str",
    "conv_id": "int", "turn": "int", "role": "str", "text": "str",
    "doc_id": "int", "lang": "str", "source": "str", "n_chars": "int",
    "l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "dec2", "l_extendedprice": "dec2", "l_discount": "dec2", "l_tax": "dec2", "l_returnflag": "str", "l_linestatus": "str", "l_shipdate": "ts",
}
MICRO = "%Y-%m-%dT%H:%M:%S.%f"


def sides(name: str) -> str:
    return f"src as materialized ({PAIRS[name].source}),\ntgt as materialized ({PAIRS[name].target})"


def columns(name: str, keys: bool = True) -> list[str]:
    p = PAIRS[name]
    return [c for c in COLUMNS[p.table] if keys or c not in p.keys]


def text(c: str, policy: str = "distinct") -> str:
    kind = KINDS[c]
    if kind == "ts":
        value = f"strftime({c}, '%Y-%m-%dT%H:%M:%S')"
    elif kind == "str":
        value = f"trim({c})"
    else:
        value = f"cast({c} as varchar)"
    empty = "<NULL>" if policy == "empty_as_null" else "<EMPTY>"
    null = "<EMPTY>" if policy == "null_as_empty" else "<NULL>"
    return f"coalesce(case when {value} = '' then '{empty}' else {value} end, '{null}')"


def row_text(names, policy: str = "distinct") -> str:
    return " || '|' || ".join(text(c, policy) for c in names)


def row_hash(names) -> str:
    return f"sha256({row_text(names)})"


def digest(names) -> str:
    return f"sha256(string_agg({row_hash(names)}, '' order by {row_hash(names)}))"


def chunk_compare(name: str, chunk: str, by: str = "", extra: str = "") -> str:
    """Digests by chunk of both sides; chunk is the SQL of chunk_id, or a CTE's columns if extra defines srcc and tgtc."""
    names = columns(name, keys=False)
    by_ = f"{by}, " if by else ""
    s, t = ("srcc", "tgtc") if extra else ("src", "tgt")
    keys = [x for x in (by.split(" as ")[-1], "chunk_id") if x]
    using = ", ".join(keys)
    return f"""
with {sides(name)}{extra},
s as (select {by_}{chunk} as chunk_id, count(*) as source_rows, {digest(names)} as source_hash from {s} group by all),
t as (select {by_}{chunk} as chunk_id, count(*) as target_rows, {digest(names)} as target_hash from {t} group by all)
select {using}, coalesce(source_rows, 0) as source_rows, coalesce(target_rows, 0) as target_rows, source_hash, target_hash,
       source_hash is not distinct from target_hash as match
from s full join t using ({using})"""


def _metric(c: str, expr: str) -> str:
    kind = KINDS[c]
    if kind == "ts":
        return f"strftime({expr}, '{MICRO}')"
    return f"cast({expr} as varchar)"


def aggregates(name: str, side: str, names=None, by: str = "") -> str:
    """column_name, metric, value of a side."""
    columns_, metrics_, values = [], [], []
    by_ = f"{by}, " if by else ""
    group = f" group by {by}" if by else ""
    for c in names or columns(name):
        kind = KINDS[c]
        scale = int(kind[3:]) if kind.startswith("dec") else 0
        number = kind not in ("str", "ts")
        low, high = (_metric(c, f"{f}({c})") for f in ("min", "max"))
        if number:
            dec = f"decimal(38,{scale})"
            low, high = (f"cast(cast({f}({c}) as {dec}) as varchar)" for f in ("min", "max"))
            total = f"cast(cast(sum({c}) as {dec}) as varchar)"
            average = f"cast(cast(round({_ratio(c, scale)}, {scale}) as {dec}) as varchar)"
        else:
            total = average = "cast(null as varchar)"
        metrics = (("count", "cast(count(*) as varchar)"), ("min", low), ("max", high), ("distinct_count", f"cast(count(distinct {c}) as varchar)"), ("sum", total), ("avg", average))
        for m, e in metrics:
            columns_.append(f"'{c}'")
            metrics_.append(f"'{m}'")
            values.append(e)
    lists = [f"[{', '.join(x)}]" for x in (columns_, metrics_)]
    return f"select {by_}unnest({lists[0]}) as column_name, unnest({lists[1]}) as metric, unnest(vs) as value from (select {by_}[{', '.join(values)}] as vs from {side}{group})"


def _ratio(c: str, scale: int) -> str:
    """sum over count to six more digits than are kept, in whole numbers: exact up to there."""
    total = f"cast(cast(sum({c}) as decimal(38,{scale})) * {10**scale} as hugeint)"
    tiny = f"0.{'0' * (scale + 5)}1"
    return f"(cast(({total} * 1000000) // nullif(count({c}), 0) as decimal(30,0)) * cast({tiny} as decimal({scale + 7},{scale + 6})))"


def aggregate_compare(name: str, names=None, by: str = "") -> str:
    keys = f"{by + ', ' if by else ''}column_name, metric"
    s = sides(name)
    if by == "day":
        s = s.replace("src as materialized (select ", "src as materialized (select strftime(ts, '%Y-%m-%d') as day, ", 1).replace("tgt as materialized (\nselect ", "tgt as materialized (\nselect strftime(ts, '%Y-%m-%d') as day, ", 1)
    return f"""
with {s},
s as ({aggregates(name, "src", names, by)}),
t as ({aggregates(name, "tgt", names, by)})
select {keys}, s.value as source_value, t.value as target_value, s.value is not distinct from t.value as match
from s full join t using ({keys})"""


def _shown(c: str, side: str) -> str:
    kind = KINDS[c]
    if kind == "ts":
        return f"strftime({side}.{c}, '{MICRO}')"
    return f"cast({side}.{c} as varchar)"


def row_diff(name: str, tolerance: str = "0.0001", where: str = "") -> str:
    """Differences of columns and rows by key, as CTEs up to one named d; where filters it."""
    p = PAIRS[name]
    on = " and ".join(f"src.{k} is not distinct from tgt.{k}" for k in p.keys)
    keys = ", ".join(f"coalesce(src.{k}, tgt.{k}) as {k}" for k in p.keys)
    first = p.keys[0]
    parts = [
        f"select {keys}, cast(null as varchar) as column_name, cast(null as varchar) as source_value, cast(null as varchar) as target_value, cast(null as double) as difference, "
        f"case when tgt.{first} is null then 'missing_in_target' else 'extra_in_target' end as reason from src full join tgt on {on} where src.{first} is null or tgt.{first} is null"
    ]
    for c in columns(name, keys=False):
        number = KINDS[c] not in ("str", "ts")
        gap = f"abs(src.{c} - tgt.{c})"
        different = f"{gap} > {tolerance}" if number else f"src.{c} <> tgt.{c}"
        parts.append(
            f"select {keys}, '{c}', {_shown(c, 'src')}, {_shown(c, 'tgt')}, {f'case when src.{c} is not null and tgt.{c} is not null then cast({gap} as double) end' if number else 'null'}, "
            f"case when src.{c} is null or tgt.{c} is null then 'null_mismatch' else '{'decimal_tolerance_exceeded' if number else 'value_mismatch'}' end "
            f"from src join tgt on {on} where (src.{c} is null) <> (tgt.{c} is null) or {different}"
        )
    return f"with {sides(name)},\nd as ({' union all '.join(parts)})"
