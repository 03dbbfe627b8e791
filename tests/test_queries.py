"""Every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from knotwork.plans import queries as plans
from knotwork.sources.tables import BASE

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5)
        return v

    return sorted(([value(r[i]) for i in order] for r in rows), key=repr)


#: One of each family here, as each run takes seconds; the driver holds all of them against their SQL.
SOME = ["context_ripeness", "derive_spine_edges", "person_resolution", "derive_episode_edges", "spine_invariants", "find_gaps", "candidate_transition", "reconcile_supersede", "contradiction_pairs", "plan_shifts", "authority_check", "shortest_chains", "affected_krs", "ppr_topk", "blast_percentile", "knn_seeds", "snapshot_diff_edges", "risk_gate", "edge_writeback", "frontmatter_parse"]


@pytest.mark.parametrize("name", SOME)
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    rel = con.sql(plans.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rel.fetchall(), rel.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["seed", "episode", "score", "chain"]
    assert set(plans.SQL) <= set(entry.queries())


def test_episode_parse_takes_every_order(spark, tmp_path):
    import datetime as dt

    rows = [(k, 7, dt.datetime(1999, 1, 2)) for k in (1, 1999, 2000, 150000)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    df = plans.QUERIES["episode_parse"](spark, str(tmp_path))
    rel = duckdb.sql(plans.SQL["episode_parse"].replace("from orders", f"from '{tmp_path}/orders.parquet/*.parquet'"))
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    assert len(got) == 4 and got == canonical(rel.fetchall(), rel.columns)


def test_every_goal_has_its_episodes(spark):
    rows = plans.QUERIES["ppr_topk"](spark, SF).collect()
    customers = dict(duckdb.sql(f"select c_custkey, c_nationkey from '{SF}/customer.parquet'").fetchall())
    orders = duckdb.sql(f"select o_custkey, count(distinct o_orderkey) from '{SF}/orders.parquet' group by 1").fetchall()
    have = {}
    for c, n in orders:
        if c in customers:
            have[f"kr-{customers[c]}"] = have.get(f"kr-{customers[c]}", 0) + n
    got = {}
    for r in rows:
        got[r["seed"]] = got.get(r["seed"], 0) + 1
    assert len(have) > 1 and got == {goal: min(10, n) for goal, n in have.items()}


def test_every_50th_vector_is_searched(spark):
    got = plans.QUERIES["knn_seeds"](spark, SF)
    want = [r[0] for r in duckdb.sql(f"select vec_id from '{SF}/embeddings.parquet' where vec_id % 50 = 0 order by 1").fetchall()]
    assert len(want) > 1 and sorted(r["query"] for r in got.collect()) == sorted(want * 8)


def test_whole_graph_queries(spark):
    from knotwork import vocab
    from knotwork.sources.tables import Catalog

    c = Catalog(spark, SF)
    edges = [tuple(r) for r in c.kg_edges.select("src", "dst", "etype").distinct().collect()]
    types = {r[0]: r[1] for r in c.kg_nodes.select("node_id", "node_type").collect()}
    near = {}
    for a, b, etype in edges:
        if etype in vocab.REACHING and a in types and b in types:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    stack = [n for n, t in types.items() if t == "key-result"]
    seen = set(stack)
    while stack:
        new = near.get(stack.pop(), set()) - seen
        seen |= new
        stack += new
    got = {r["node_id"]: r["reached"] for r in plans.QUERIES["reachability_from_kr"](spark, SF).collect()}
    assert got == {n: n in seen for n in types}
    communities = {r["node"] for r in plans.QUERIES["communities_lpa"](spark, SF).collect()}
    assert communities == {x for a, b, _ in edges if a != b for x in (a, b)} and any(n.startswith("feat-") for n in communities)
