"""Operators on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from knotwork import sinks
from knotwork.functions import scalars as S
from knotwork.operators import claims as C
from knotwork.operators import graph as G
from knotwork.operators import insight as I
from knotwork.operators import quality as Q
from knotwork.operators import temporal as T
from knotwork.operators import vectors as V
from knotwork.sources import notes as N

EDGES = "src string, dst string, etype string"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_active_at_bounds(spark):
    d = lambda s: F.lit(s).cast("date")
    assert one(spark, S.active_at(d("2026-01-01"), d(None), d(None), "2026-01-01"))
    assert not one(spark, S.active_at(d("2026-01-01"), d("2026-02-01"), d(None), "2026-02-01"))
    assert not one(spark, S.active_at(d(None), d("2026-02-01"), d(None), None))
    assert not one(spark, S.active_at(d(None), d(None), d("2020-01-01"), None))
    assert one(spark, S.active_at(d(None), d(None), d(None), "1990-01-01"))


def test_percentile_and_severity(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (3,), (5,)], "v int")
    got = {r["v"]: r["percentile"] for r in G.midrank(df, "v").collect()}
    assert got[3] == 0.6 and got[5] == 0.9
    assert one(spark, S.severity(F.lit(0.5), F.lit(1), F.lit(0.5))) == 0.45
    assert one(spark, S.severity(F.lit(0.9), F.lit(1), F.lit(None).cast("double"))) == 0.65


def test_names(spark):
    assert one(spark, S.name_key(F.lit('"Ann"  Bee Cee'))) == "ann bee"
    assert one(spark, S.name_key(F.lit("Ann"))) is None
    assert one(spark, S.without_remark(F.lit("Ann Bee (guest)"))) == "Ann Bee"


def test_ripeness_classes(spark):
    for days, want in ((10, "fresh"), (50, "ripening"), (100, "wilting")):
        day = dt.date(2026, 7, 3) - dt.timedelta(days)
        assert one(spark, S.ripeness(F.lit(day), F.lit(90), "2026-07-03")) == want
    assert one(spark, S.ripeness(F.lit(dt.date(2026, 1, 1)), F.lit(0), "2026-07-03")) is None


def test_three_values_make_three_pairs(spark):
    rows = [(i, "s", "a", v, "neutral", "n", None, None, None) for i, v in enumerate("xyz")] + [(9, "s", "a", "x", "neutral", "n", None, None, "later")]
    df = spark.createDataFrame(rows, "ord long, subject string, aspect string, value string, polarity string, grounded_node string, invalid_at date, expired_at date, superseded_by string")
    assert sorted((r["a"], r["b"]) for r in C.contradictions(df).collect()) == [(0, 1), (0, 2), (1, 2)]


def test_supersede_ends_and_revives(spark):
    day = dt.date(2020, 1, 1)
    stored = spark.createDataFrame([("a", "SERVES", "b", day, None), ("c", "SERVES", "d", day, day), ("e", "OWNS", "f", day, None)], "src string, etype string, dst string, valid_at date, invalid_at date")
    asserted = spark.createDataFrame([("c", "SERVES", "d", None), ("g", "SERVES", "h", None)], "src string, etype string, dst string, valid_at date")
    got = {r["src"]: (r["valid_at"], r["invalid_at"]) for r in T.supersede(stored, asserted, "2021-01-01").collect()}
    new = dt.date(2021, 1, 1)
    assert got == {"a": (day, new), "c": (day, None), "e": (day, None), "g": (new, None)}


def test_reachability(spark):
    nodes = spark.createDataFrame([("kr-1", "key-result"), ("init-a", "x"), ("init-b", "x")], "node_id string, node_type string")
    edges = spark.createDataFrame([("init-a", "kr-1", "DELIVERS"), ("init-b", "kr-1", "MENTIONS")], EDGES)
    assert {r["node_id"]: r["reached"] for r in G.reachability(nodes, edges).collect()} == {"kr-1": True, "init-a": True, "init-b": False}


def test_communities_are_triangles(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z")]
    edges = spark.createDataFrame([(*p, "SERVES") for p in pairs], EDGES)
    got = {r["node"]: r["community"] for r in G.label_propagation(edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "x"}


def test_communities_by_number_are_those_by_name(spark, monkeypatch):
    held = spied(monkeypatch)
    pairs = [(k, (k * k + 5) % 40) for k in range(40)] + [(k, k + 1) for k in range(0, 39, 3)]
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", "SERVES") for a, b in pairs] + [("n1", None, "SERVES"), ("x", "x", "SERVES")], EDGES)
    got = {r["node"]: r["community"] for r in G.label_propagation(edges).collect()}
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(f"n{a}", set()).add(f"n{b}")
            near.setdefault(f"n{b}", set()).add(f"n{a}")
    labels, seen = {n: n for n in near}, []
    while labels not in seen:
        seen.append(labels)
        votes = {n: [labels[n], *(labels[m] for m in near[n])] for n in near}
        labels = {n: min(set(v), key=lambda x: (-v.count(x), x)) for n, v in votes.items()}
    least = {x: min(n for n in labels if labels[n] == x) for x in labels.values()}
    assert got == {n: least[x] for n, x in labels.items()}
    assert all(t == "bigint" for types, _ in held if "label" in types for t in types.values())


def test_components_of_a_path_and_loops(spark):
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}", "SERVES") for i in range(20)] + [("z", "z", "SERVES")], EDGES)
    got = {r["node"]: r["component"] for r in G.components(edges).collect()}
    assert set(got.values()) == {"n00", "z"} and len(got) == 22


def test_pagerank_sums_to_one_and_stays_in_its_component(spark):
    edges = spark.createDataFrame([("kr-1", "a", "SERVES"), ("a", "pulse-1", "SERVES"), ("q", "pulse-2", "SERVES")], EDGES)
    seeds = spark.createDataFrame([("kr-1", "kr-1", 1.0), ("kr-9", "kr-9", 1.0)], "seed string, node string, weight double")
    got = G.pagerank(edges, seeds, 8).collect()
    assert abs(sum(r["score"] for r in got) - 1) < 1e-9 and {r["node"] for r in got} == {"kr-1", "a", "pulse-1"}


def spied(monkeypatch):
    """What graph.kept writes from now on: column types and rows of each table."""
    held, real = [], G.kept

    def kept(df):
        out = real(df)
        held.append((dict(out.dtypes), out.count()))
        return out

    monkeypatch.setattr(G, "kept", kept)
    return held


def test_pagerank_of_many_seeds_holds_a_row_a_node(spark, monkeypatch):
    monkeypatch.setattr(G, "WIDTH", 4)
    held = spied(monkeypatch)
    pairs = [(k, (k * 7 + 3) % 12) for k in range(12)] + [(0, k) for k in range(1, 12)]
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", "SERVES") for a, b in pairs] + [("n1", None, "SERVES")], EDGES)
    seeds = [(f"s{k}", f"n{j}", 0.5) for k in range(7) for j in (k, k + 2)] + [("gone", "nowhere", 1.0)]
    got = {(r["seed"], r["node"]): r["score"] for r in G.pagerank(edges, spark.createDataFrame(seeds, "seed string, node string, weight double"), 100, 0.85, 1e-3).collect()}
    near = {n: {b for a, b in pairs if a == n} | {a for a, b in pairs if b == n} for n in range(12)}
    near = {n: x - {n} for n, x in near.items()}
    start = {(s, int(n[1:])): w for s, n, w in seeds if n != "nowhere"}
    now, change = start, 1.0
    while change >= 12 * 1e-3:
        new = {k: 0.15 * w for k, w in start.items()}
        for (s, n), p in now.items():
            for m in near[n]:
                new[s, m] = new.get((s, m), 0.0) + 0.85 * p / len(near[n])
        now, change = new, sum(abs(p - now.get(k, 0.0)) for k, p in new.items())
    assert got.keys() == {(s, f"n{n}") for s, n in now} and all(abs(got[s, f"n{n}"] - p) < 1e-9 for (s, n), p in now.items())
    # Two blocks of seeds: no state of a round has a row for each seed and node.
    assert max(n for types, n in held if "node" in types) <= 2 * 12 < 7 * 12


def fixpoint(near, seed, alpha=0.85):
    """Scores of a plain loop that runs until nothing changes any more."""
    now = {n: float(n == seed) for n in near}
    for _ in range(400):
        now = {n: sum(alpha * now[m] / len(near[m]) for m in near[n]) + (1 - alpha) * (n == seed) for n in near}
    return now


def small_graph(spark):
    pairs = [("kr-1", "c1"), ("kr-1", "c2"), ("kr-2", "c2"), ("kr-2", "c3")] + [(f"pulse-{k:02}", f"c{1 + k % 3}") for k in range(40)] + [(f"pulse-{k:02}", f"f{k % 7}") for k in range(0, 40, 3)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return spark.createDataFrame([(a, b, "SERVES") for a, b in pairs], EDGES), near


def test_pagerank_leaves_no_state_of_its_rounds(spark):
    import pathlib

    edges, near = small_graph(spark)
    G.kept(edges)
    folder = (spark.conf.get("spark.checkpoint.dir", None) or f"file://{G._own[0]}").removeprefix("file:")
    held = lambda: set(pathlib.Path("/" + folder.lstrip("/"), "knotwork-graph").iterdir())
    before = held()
    seeds = spark.createDataFrame([(f"s{k}", f"kr-{k}", 1.0) for k in (1, 2)], "seed string, node string, weight double")
    best = V.episodes_for(edges, seeds, 3)
    # One table of results, and the seeds: no pairs, numbers or scores of any round.
    assert len(held() - before) <= 3
    for k in (1, 2):
        want = fixpoint(near, f"kr-{k}")
        top = sorted((n for n in near if n.startswith("pulse-")), key=lambda n: (round(want[n], 9), n))[:-4:-1]
        assert [(r["episode"], r["score"]) for r in sorted(best.where(F.col("seed") == f"s{k}").collect(), key=lambda r: (want[r["episode"]].__round__(9), r["episode"]), reverse=True)] == [(n, round(want[n], 4)) for n in top]


def test_pagerank_over_many_blocks(spark, monkeypatch):
    for name, value in (("WIDTH", 1), ("LEAST_BLOCK", 5), ("BLOCK", 5), ("AT_ONCE", 1)):
        monkeypatch.setattr(G, name, value)
    edges, near = small_graph(spark)
    seeds = spark.createDataFrame([(f"kr-{k}", f"kr-{k}", 1.0) for k in (1, 2)], "seed string, node string, weight double")
    got = {(r["seed"], r["node"]): r["score"] for r in G.pagerank(edges, seeds).collect()}
    want = {(s, n): p for s in ("kr-1", "kr-2") for n, p in fixpoint(near, s).items()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-8 for x in want)


def test_no_episode_gives_no_replica(spark):
    edges = spark.createDataFrame([("kr-1", "a", "SERVES"), ("q", "pulse-2", "MENTIONS")], EDGES)
    seeds = spark.createDataFrame([("kr-1", "kr-1", 1.0), ("kr-9", "kr-9", 1.0)], "seed string, node string, weight double")
    assert V.replicas(edges, seeds, 3).collect() == []
    reached = G.hops(edges, spark.createDataFrame([("kr-1",)], "node string"))
    assert G.chains(reached, spark.createDataFrame([("kr-1", "pulse-2")], "seed string, node string")).collect() == []


def test_weighted_seeds_without_similarity(spark):
    assert V.weighted(spark.createDataFrame([("s", "n", 0.0)], "seed string, node string, similarity double")).count() == 0


def test_diff_edges(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node_id string")
    base = spark.createDataFrame([("a", "b", "SERVES")], EDGES)
    new = spark.createDataFrame([("a", "b", "SERVES"), ("a", "n", "SERVES"), ("n", "m", "SERVES"), ("b", "a", "SERVES")], EDGES)
    assert {(r["src"], r["dst"]): r["kind"] for r in I.diff_edges(nodes, base, new).collect()} == {("a", "n"): "connecting", ("n", "m"): "internal", ("b", "a"): "existing"}


def test_write_back_merges(spark):
    nodes = spark.createDataFrame([("kr-1",), ("a",)], "node_id string")
    edges = spark.createDataFrame([("e2", "kr-1", "DELIVERS"), ("e1", "kr-1", "DELIVERS"), ("a", "kr-1", "SERVES"), ("zz", "kr-1", "SERVES")], EDGES)
    assert {(r["node_id"], r["field"]): r["values"] for r in Q.write_back(edges, nodes).collect()} == {("kr-1", "delivered_by"): "e1,e2", ("a", "serves"): "kr-1"}


def test_vault_round_trip(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "_index.md").write_text("---\nnode_id: i\nserves: kr-1\n---\nbody")
    (tmp_path / "a.md").write_text("---\nnode_id: i\nnexus: old\n---\n")
    (tmp_path / "bad.md").write_text("---\n: [\n---\n")
    (tmp_path / "none.md").write_text("no block")
    parsed = N.parse(N.scan(spark, str(tmp_path)))
    assert {r["rel_path"]: r["status"] for r in parsed.collect()} == {"a.md": "ok", "b/_index.md": "ok", "bad.md": "error", "none.md": "none"}
    rows = N.nodes(parsed).collect()
    assert len(rows) == 1 and rows[0]["serves"] == ["kr-1"] and rows[0]["nexus"] is None
    text = sinks.upsert_field(sinks.render_note({"node_id": "x", "nexus": "n"}), "mentions", ["p", "q"])
    assert "mentions:\n- p\n- q" in text and sinks.upsert_field("plain", "k", 1) == "plain"
    assert sinks.write_notes(spark.createDataFrame([("new", text)], "node_id string, text string"), str(tmp_path)) == 1
    assert sinks.write_notes(spark.createDataFrame([("new", "other")], "node_id string, text string"), str(tmp_path)) == 0


def test_queue(spark):
    queue = spark.createDataFrame([("a", "open"), ("b", "open"), ("c", "resolved")], "src string, status string")
    found = spark.createDataFrame([("a",), ("c",), ("d",)], "src string")
    assert {r["src"]: r["status"] for r in Q.queue_transition(queue, found).collect()} == {"a": "open", "b": "resolved", "c": "resolved", "d": "open"}


def test_risk_sink_replaces_its_source_only(spark, tmp_path):
    path = str(tmp_path / "risks")
    schema = "axis string, node string, ref string, goals array<string>, source string"
    sinks.write_risks(spark.createDataFrame([("a", "n", "1", ["g"], "s1"), ("a", "n", "2", [], "s2")], schema), path)
    sinks.write_risks(spark.createDataFrame([("b", "m", "3", [], "s1")], schema), path)
    assert sorted((r["axis"], r["source"]) for r in spark.read.parquet(path).collect()) == [("a", "s2"), ("b", "s1")]


@pytest.mark.parametrize("reach", [0.0, 1.0])
def test_report(reach):
    assert "| n | 0.500 !" in sinks.report({"x": 1}, [("n", 0.5)], ["q"])


def test_streaming_windows(spark, tmp_path):
    from knotwork.streaming import events as E

    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 5), "view", 1.0), (dt.datetime(2024, 1, 1, 0, 50), "view", 2.0), (dt.datetime(2024, 1, 1, 1, 5), "view", 4.0)], "ts timestamp, event_type string, value double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = E.tumbling(stream).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["n"], r["total"]) for r in spark.sql("select * from w").collect()) == [(1, 4.0), (2, 3.0)]


def test_nearest_keeps_ties_by_id_and_what_has_no_distance(spark):
    rows = [(f"n{i:03}", [1.0, 0.0]) for i in range(300)] + [("a", [0.0, 1.0]), ("z", [1.0, 1e-11]), ("y", [1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>").repartition(2)
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query string, q array<double>")
    for k in (3, 302):
        got = sorted(V.nearest(df, asked, k).collect(), key=lambda r: (r["distance"], r["id"]))
        assert [r["id"] for r in got] == sorted((n for n, _ in rows), key=lambda n: ({"a": 2, "y": 1}.get(n, 0), n))[:k]
    odd = df.unionAll(spark.createDataFrame([("none", None), ("gap", [1.0, None])], df.schema))
    assert {r["id"] for r in V.nearest(odd, asked, 2).collect()} == {"gap", "none"}


def test_titles_are_embedded_as_texts(spark):
    df = spark.createDataFrame([(1, "One two ONE"), (2, None), (3, "two one one"), (4, "--")], "id long, text string")
    rows = [{r["id"]: r["embedding"] for r in f(df, "id", "text", 16).collect()} for f in (V.embed, V.embed_titles)]
    assert rows[0] == rows[1] and len(rows[0]) == 4


def test_nearest_takes_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "MOST_QUERIES", 2)
    df = spark.createDataFrame([(i, [float(i * i), 1.0]) for i in range(12)], "vec_id long, embedding array<float>")
    got = {}
    for r in V.nearest(df, df.where("vec_id < 7").selectExpr("vec_id as query", "embedding as q"), 3).collect():
        got.setdefault(r["query"], []).append(r["id"])
    assert {q: sorted(ids) for q, ids in got.items()} == {q: sorted(sorted(range(12), key=lambda i: ((i * i - q * q) ** 2, i))[:3]) for q in range(7)}
