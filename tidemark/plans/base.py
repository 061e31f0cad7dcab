"""The register of queries: a function of (spark, sf_dir), and SQL for the same rows where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The canonical tables as SQL, to be named in front of a query.
TRADES = """trades as (select upper(event_type) as instrument, ts, event_id as seq, value as price,
    cast(regexp_extract(props, '-?[0-9]+') as bigint) as qty, case when event_id % 2 = 0 then 'BUY' else 'SELL' end as side, user_id as account from events)"""
BARS = TRADES + """, bars as (select instrument, date_trunc('hour', ts) as bar_start, first(price order by ts, seq) as open, max(price) as high, min(price) as low,
    last(price order by ts, seq) as close, sum(qty)::bigint as volume, count(*) as n from trades group by 1, 2)"""
FILLS = """fills as (select l_orderkey as order_id, l_linenumber as line, l_partkey as instrument, l_suppkey as venue, l_quantity as qty, l_extendedprice as notional,
    l_discount as rebate_rate, l_tax as fee_rate, l_shipdate as ts, case when l_returnflag = 'R' then 'SELL' else 'BUY' end as side from lineitem)"""
GATES = """gates as (select user_id as subject, event_id as name, case event_type when 'click' then 'pass' when 'view' then 'pass' when 'error' then 'fail'
    when 'signup' then 'unknown' else 'odd' end as status from events)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
