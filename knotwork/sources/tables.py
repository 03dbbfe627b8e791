"""The knowledge-graph model over star-schema tables.

Each view is one SELECT that Spark and other SQL engines can run; the few functions that differ go
by placeholders. A catalog of DataFrames is made for Spark, a WITH prefix for anything else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels", "conversations")

#: Placeholder: (Spark, DuckDB).
DIALECT = {
    "{ymd_o}": ("date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"),
    "{ymd_ts}": ("date_format(ts, 'yyyy-MM-dd')", "strftime(ts, '%Y-%m-%d')"),
    "{k}": ("cast(get_json_object(props, '$.k') as int)", "cast(json_extract_string(props, '$.k') as int)"),
    "{double}": ("double", "double"),
    "{str}": ("string", "varchar"),
}

VIEWS = {
    "kg_nodes": """
        select concat('obj-', r_regionkey) as node_id, 'objective' as node_type, 'okr' as nexus, r_name as title, 'Supplier 1' as owner,
               cast(0.4 as {double}) as confidence, cast('2001-05-01' as date) as updated, 90 as ttl_days, 1 as n_sources, 'normative' as kind, 'fresh' as ripeness, cast(null as {str}) as reports_to from region
        union all select concat('kr-', n_nationkey), 'key-result', 'okr', n_name, case when n_nationkey % 7 = 3 then '' else concat('team-supp-', n_nationkey) end,
               0.4, cast('2001-06-15' as date), 90, 1, 'empirical', 'fresh', null from nation
        union all select concat('cust-', c_custkey), 'system-component', case when c_mktsegment = 'MACHINERY' then 'system' else lower(c_mktsegment) end, c_name, concat('Supp ', c_custkey % 300),
               case when c_custkey % 10 = 0 then null else (c_custkey % 10) / cast(10 as {double}) end,
               cast('2001-08-15' as date) - cast(c_custkey % 200 as int), cast(30 + c_custkey % 5 * 30 as int), cast(c_custkey % 11 as int), case when c_custkey % 13 > 0 then 'empirical' end, case when c_custkey % 8 > 0 then 'fresh' else '' end, null from customer
        union all select concat('team-supp-', s_suppkey), 'person', 'team', s_name, null, 0.9, cast('2001-07-01' as date), 180, 1, 'empirical', 'fresh', case when s_suppkey % 3 > 0 then 'team-supp-1' end from supplier
        union all select concat('feat-', p_partkey), 'feature', 'product', p_name, concat(p_partkey % 150, ' supp'),
               (p_partkey % 10) / cast(10 as {double}), cast('2001-08-31' as date) - p_size, 60, cast(p_partkey % 7 as int), 'empirical', 'ripening', null from part
        union all select concat('pulse-', {ymd_o}, '-', o_orderkey), 'episode', 'pulse', concat('Order ', o_orderkey), null, 0.5, cast(o_orderdate as date), 90, 1, 'empirical', 'wilting', null from orders
    """,
    "kg_edges": """
        select concat('kr-', n_nationkey) as src, concat('obj-', n_regionkey) as dst, 'SERVES' as etype, 'high' as confidence,
               cast(null as date) as valid_at, cast(null as date) as invalid_at, cast(null as date) as expired_at from nation
        union all select concat('cust-', c_custkey), concat('kr-', c_nationkey), 'SERVES', 'high', null, null, case when c_custkey % 97 = 0 then cast('2001-01-01' as date) end from customer
        union all select concat('pulse-', {ymd_o}, '-', o_orderkey), concat('cust-', o_custkey), 'MENTIONS', 'high', cast(o_orderdate as date), null, null from orders
        union all select concat('pulse-', {ymd_o}, '-', o_orderkey), concat('feat-', l_partkey),
               case flag when 'A' then 'ADDRESSES' when 'N' then 'REALIZES' else 'SATISFIES' end, 'medium', cast(o_orderdate as date), ended, null
          from orders join (select l_orderkey, l_partkey, min(l_returnflag) as flag, min(case when l_linestatus = 'F' then cast(l_shipdate as date) end) as ended
                              from lineitem group by l_orderkey, l_partkey) l on l_orderkey = o_orderkey
        union all select distinct concat('pulse-', {ymd_o}, '-', o_orderkey), concat('team-supp-', l_suppkey), 'involves', 'medium', cast(o_orderdate as date), cast(null as date), cast(null as date)
          from orders join lineitem on l_orderkey = o_orderkey
        union all select concat('feat-', l_partkey), concat('team-supp-', min(l_suppkey)), 'OWNS', 'high', null, null, null from lineitem group by l_partkey
    """,
    "kg_claims": """
        select event_id as ord, concat('user-', user_id) as subject, event_type as aspect, cast(cast(round(value) as int) as {str}) as value,
               case when value < 10 then 'negative' when value < 30 then 'neutral' else 'positive' end as polarity,
               concat('user-', user_id) as speaker, event_type as speaker_role, concat('cust-', user_id) as grounded_node,
               concat('pulse-', {ymd_ts}) as episode, case when event_type = 'purchase' then 'commitment' when event_type = 'view' then 'bogus' else 'state' end as aspect_kind,
               'number' as value_type, cast(cast(round(value) as int) as {str}) as value_norm, cast(ts as date) as valid_at,
               case when {k} >= 50 then cast(ts as date) end as invalid_at, case when {k} % 7 = 0 then cast(ts as date) end as expired_at,
               case when {k} % 13 = 0 then 'claim-next' end as superseded_by, ({k} % 10) / cast(10 as {double}) as confidence from events
    """,
    "kg_episodes": """
        select concat('pulse-', {ymd_o}, '-', o_orderkey) as episode_id, cast(o_orderdate as date) as date,
               case when o_orderkey % 9 = 0 then concat({ymd_o}, '-', o_orderkey) else concat('cust-', o_custkey * 2) end as nexus_ref, concat('PRJ-', o_orderkey % 50) as jira_ref,
               concat(case when o_orderkey % 2 = 0 then concat('Supp ', o_orderkey % 130) else concat(o_orderkey % 130, ' supp') end, ' (guest)') as participant from orders
    """,
    "kg_refs": """
        select concat('feat-', l_partkey) as src, 'depends_on' as field, concat('feat-', l_partkey + l_suppkey) as ref from lineitem where l_linenumber = 1
        union all select concat('cust-', c_custkey), 'has_need', concat('feat-', c_custkey * 3) from customer
    """,
}


def render(sql: str, spark: bool) -> str:
    for key, (ours, theirs) in DIALECT.items():
        sql = sql.replace(key, ours if spark else theirs)
    return sql


def with_prefix(*names: str) -> str:
    """WITH ... of the views named, for an engine that has the base tables."""
    return "with " + ",\n".join(f"{n} as ({render(VIEWS[n], False)})" for n in names)


class Catalog:
    """DataFrames of the base tables and of the views, by name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            sql = render(VIEWS[name], True)
            used = {t: self.spark.read.parquet(f"{self.folder}/{t}.parquet") for t in BASE if t in sql.replace("(", " ").replace(")", " ").split()}
            for t in used:
                sql = _braced(sql, t)
            return self.spark.sql(sql, **used)
        if name in BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        raise AttributeError(name)


def _braced(sql: str, table: str) -> str:
    """Table names as references to DataFrames, so that no temporary view is needed."""
    import re

    return re.sub(rf"\b(from|join)\s+{table}\b", rf"\1 {{{table}}}", sql)
