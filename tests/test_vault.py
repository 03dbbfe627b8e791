"""A vault end to end: readers, claims, linter, derivation, queues, snapshots and risks."""

import hashlib

import pytest
from pyspark.sql import functions as F

from knotwork import cli, sinks
from knotwork.operators import claims as C
from knotwork.operators import derive as D
from knotwork.operators import graph as G
from knotwork.operators import insight as I
from knotwork.operators import quality as Q
from knotwork.operators import vectors as V
from knotwork.sources import config
from knotwork.sources import notes as N

EDGES = "src string, dst string, etype string"
GOOD = "nexus: okr\nnode_type: objective\nkind: normative\nowner: Ann Bee\nconfidence: 0.5\nsources: [x]\nupdated: 2024-01-01\nttl_days: 100\nripeness: fresh\n"


def note(node, more="", base=GOOD):
    return f"---\nnode_id: {node}\n{base}{more}---\n"


def parsed(spark, texts):
    return N.parse(spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(sorted(texts.items()))], "scan_ord long, rel_path string, text string"))


def test_linter(spark):
    texts = {
        "a.md": note("a", "serves: b\nmentions: [b, gone]\ndelivered_by: [X-1]\n"),
        "b.md": note("b").replace("objective", "bogus").replace("normative", "odd").replace("0.5", "7"),
        "c/_index.md": note("i").replace("sources: [x]\n", ""),
        "d.md": note("a"),
        "e.md": "---\n: [\n---\n",
        "f.md": "no block",
        "g.md": note("g").replace("2024-01-01", "2023-01-01").replace("nexus: okr", "nexus: else"),
    }
    registry = spark.createDataFrame([("okr",)], "slug string")
    got = {(r["severity"], r["rel_path"], r["rule"], r["detail"]) for r in Q.lint_notes(parsed(spark, texts), registry, "2024-01-20").collect()}
    assert got == {
        ("ERROR", "a.md", "dangling-edge", "mentions gone"), ("ERROR", "b.md", "bad-node-type", "bogus"), ("ERROR", "b.md", "bad-kind", "odd"),
        ("ERROR", "b.md", "bad-confidence", "7"), ("ERROR", "c/_index.md", "missing-key", "sources"), ("WARN", "c/_index.md", "no-sources", ""),
        ("ERROR", "d.md", "duplicate-id", "a"), ("ERROR", "e.md", "unreadable", ""), ("ERROR", "g.md", "unknown-nexus", "else"),
        ("WARN", "g.md", "ripeness-drift", "wilting"), ("WARN", "g.md", "wilting", ""),
    }
    free = Q.lint_notes(parsed(spark, {"g.md": note("g").replace("okr", "any")}), registry.limit(0), "2024-01-20")
    assert free.count() == 0 and Q.lint_failed(free).first()["exit_code"] == 0


def test_linter_parses_once_on_all_cores(spark):
    rows = spark.createDataFrame([(k, f"{k}.md", note(f"n{k}", "serves: n0\n")) for k in range(40)], "scan_ord long, rel_path string, text string")
    made = N.parse(rows.coalesce(1))
    assert len({r[0] for r in made.select(F.spark_partition_id()).collect()}) > 1
    issues = Q.lint_notes(made, spark.createDataFrame([("okr",)], "slug string"), "2024-01-20")
    assert issues.count() == 0 and "MapInArrow" not in issues._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_are_read_alike_by_both_loaders():
    import yaml

    for block in ("a: [x, 1, 2024-01-01]\nb: {c: 'd'}", "a: \u2028b", "- x\n- y: ~", "a:\tb", "[a, b? c]", "{it's? }", "a: yes\na: 0x1F"):
        try:
            want = yaml.safe_load(block)
        except yaml.YAMLError:
            with pytest.raises(yaml.YAMLError):
                N.loader()(block)
        else:
            assert N.loader()(block) == want


def test_claims_of_notes(spark):
    text = "---\nnode_id: pulse-2024-02-03-x\nclaims:\n- {subject: s, aspect: date, value: 5, aspect_kind: commitment, invalid_at: 2024-01-01, expired_at: 2024-01-02}\n- text\n- {subject: s, aspect: ''}\n---\n"
    rows = C.normalise(N.claims(parsed(spark, {"NEXUS/pulse/x.md": text, "NEXUS/okr/y.md": text.replace("pulse-2024", "other-2024")}))).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["value"], r["polarity"], r["aspect_kind"], r["value_type"], str(r["valid_at"]), r["invalid_at"], r["expired_at"]) == ("5", "neutral", "commitment", "text", "2024-02-03", None, None)


def test_readers_and_configuration(spark, tmp_path):
    ground = tmp_path / "GROUND"
    (ground / "NEXUS").mkdir(parents=True)
    (ground / "_index").mkdir()
    assert len(config.problems(str(ground))) == 1 and config.registry(spark, str(ground)).count() == 0
    (ground / "config.yaml").write_text("product: {slug: A b}\n")
    (ground / "NEXUS" / "_registry.yaml").write_text("nexus_types:\n- {slug: okr, source: custom}\n- {slug: 9x, source: odd}\n- text\n")
    assert len(config.problems(str(ground))) == 4 and {r["slug"] for r in config.registry(spark, str(ground)).collect()} == {"okr", "9x"}
    assert sinks.register_nexus(str(ground / "NEXUS" / "_registry.yaml"), "new", "New", "why") and not sinks.register_nexus(str(ground / "NEXUS" / "_registry.yaml"), "okr", "", "")
    path = config.vocabulary_path(str(ground / "NEXUS"))
    assert path == str(ground / "_index" / "aspect-vocab.yaml") and config.vocabulary_path(str(tmp_path)).endswith("GROUND/_index/aspect-vocab.yaml")
    (ground / "_index" / "aspect-vocab.yaml").write_text("aspects:\n- {canonical: date, synonyms: [day, day]}\n- {synonyms: [x]}\n")
    assert [tuple(r) for r in config.vocabulary(spark, path).collect()] == [("date", ["day"])]
    (ground / "p.yaml").write_text("authority:\n- {role: ' Lead ', may_assert: [state]}\n- {role: none}\n")
    assert {tuple(r) for r in config.policy(spark, str(ground / "p.yaml")).collect()} == {("lead", "state"), ("none", None)}
    (ground / "q.yaml").write_text("- {src: b, status: approved, dst: kr-1}\n- {src: a}\n")
    sinks.write_queue(config.queue(spark, str(ground / "q.yaml")), str(ground / "q2.yaml"))
    assert [(r["src"], r["status"], r["dst"]) for r in config.queue(spark, str(ground / "q2.yaml")).collect()] == [("a", "open", None), ("b", "approved", "kr-1")]


def test_pipeline_derives_and_queues(spark):
    schema = "node_id string, node_type string, title string, full_name string, owner string"
    nodes = spark.createDataFrame([("team-ann-bee", "person", "t", "Ann Bee", None), ("feat-1", "feature", "F", None, "Ann Bee"), ("feat-2", "feature", "F", None, "No One"), ("PRJ-9", "task", "T", None, None)], schema)
    goals = spark.createDataFrame([("1.2", "Goal", "1", "EPIC-1"), ("1.2", "Zoal", "1", None)], "goal string, title string, objective string, epic string")
    episodes = spark.createDataFrame([("pulse-2024-01-01-a", "2024-01-01", "a.md"), ("pulse-2024-01-02-b", "2024-01-02", "b.md")], "episode_id string, date string, source string")
    a = "pulse-2024-01-01-a"
    refs = spark.createDataFrame([(a, "nexus", "feat-1"), (a, "nexus", "2024-01-02-b"), (a, "nexus", "gone"), (a, "jira", "PRJ-17"), (a, "jira", "PRJ-9")], "episode_id string, plane string, ref string")
    people = spark.createDataFrame([(a, "Bee Ann (guest)"), (a, "Zed Zed")], "episode_id string, participant string")
    values = spark.createDataFrame([("feat-1", "depends_on", "feat-2"), ("feat-1", "has_need", "none")], "src string, field string, ref string")
    got = D.pipeline(nodes, goals, episodes, refs, people, values, "2024-02-01")
    edges = {(r["etype"], r["src"], r["dst"], r["confidence"]) for r in got["edges"].collect()}
    assert edges == {
        ("OWNS", "feat-1", "team-ann-bee", "high"), ("SERVES", "kr-1-2", "obj-q-1", "high"), ("DELIVERS", "EPIC-1", "kr-1-2", "high"),
        ("DEPENDS_ON", "feat-1", "feat-2", "high"), ("MENTIONS", a, "feat-1", "high"), ("MENTIONS", a, "task-PRJ-17", "medium"),
        ("MENTIONS", a, "PRJ-9", "high"), ("MENTIONS", a, "pulse-2024-01-02-b", "high"), ("involves", a, "team-ann-bee", "high"),
    }
    made = {r["node_id"]: r for r in got["new_nodes"].collect()}
    assert set(made) == {"kr-1-2", "obj-q-1", a, "pulse-2024-01-02-b", "task-PRJ-17"} and made["kr-1-2"]["title"] == "Goal" and made["kr-1-2"]["confidence"] == 0.4
    assert [tuple(r) for r in got["unresolved_owners"].collect()] == [("feat-2", "No One")]
    assert [tuple(r) for r in got["unresolved_participants"].collect()] == [(a, "Zed Zed")]
    assert {tuple(r) for r in got["dangling"].collect()} == {(a, "gone"), ("feat-1", "none")}


def test_gaps_and_write_back(spark):
    nodes = spark.createDataFrame([("a", "x", "A", None, []), ("b", "x", "B", "a", []), ("s", "system", "", None, []), ("m", "x", "M", None, ["a"])], "node_id string, nexus string, title string, reports_to string, manages array<string>").withColumn("node_type", F.lit("entity"))
    edges = spark.createDataFrame([("s", "q", "MENTIONS", 1), ("s", "r", "SERVES", 2)], EDGES + ", ord long")
    assert {(r["node_id"], r["reason"]) for r in Q.gaps(nodes, edges.where("ord = 1")).collect()} == {("a", "isolated"), ("s", "no-serves")}
    assert [r["node_id"] for r in Q.isolated(nodes, edges).collect()] == ["a"]
    more = spark.createDataFrame([("s", "zz", "OWNS", 1), ("s", "aa", "OWNS", 2), ("s", "q", "MENTIONS", 3)], EDGES + ", ord long")
    had = spark.createDataFrame([("s", "mentions", "old"), ("s", "involves", "p")], "node_id string, field string, value string")
    assert {(r["field"], r["values"]) for r in Q.write_back(more, nodes, had, "ord").collect()} == {("owns_node", "aa"), ("mentions", "old,q")}


def test_queue_and_gate_files(spark, tmp_path):
    risks = spark.createDataFrame([("r1", "review", ["e"]), ("r2", "verified", ["e"])], "id string, bucket string, evidence array<string>")
    sinks.write_risk_queue(risks, str(tmp_path / "x" / "risks.yaml"))
    assert (tmp_path / "x" / "risks.yaml").read_text() == "review:\n- id: r1\n  evidence:\n  - e\nunlinkable: []\n"
    gate = spark.createDataFrame([(True, 0.7, "")], "passed boolean, ripeness_min double, reasons string")
    assert sinks.write_gate(gate, str(tmp_path / "g.yaml"), "2024-01-01") == {"ready": True, "ripeness_min": 0.7, "reasons": [], "checked": "2024-01-01"}


def test_an_empty_set_of_risks_leaves_no_stale_rows(spark, tmp_path):
    path, schema = str(tmp_path / "risks"), "axis string, node string, evidence array<string>, goals array<string>, source string"
    one = spark.createDataFrame([("schedule_slip", "n", ["x", "y"], ["kr-1"], "s1"), ("schedule_slip", "n", ["x"], [], "s2")], schema)
    sinks.write_risks(one, path, drop_first=False)
    sinks.write_risks(one, path, drop_first=False)
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 2 and [r["id"] for r in rows if r["source"] == "s1"] == ["risk-schedule_slip-" + hashlib.sha1(b"schedule_slip|x y|kr-1").hexdigest()[:8]]
    sinks.write_risks(one.limit(0), path, sources=("s1",))
    assert [r["source"] for r in spark.read.parquet(path).collect()] == ["s2"]


def test_built_risks(spark):
    schema = "axis string, node string, evidence array<string>, participants array<string>, confidence double"
    reach = spark.createDataFrame([("n", 1.0)], "node_id string, percentile double")
    goals = spark.createDataFrame([("n", ["kr-1", "kr-9"])], "node_id string, goals array<string>")
    got = I.built_risks(spark.createDataFrame([("schedule_slip", "n", ["e"], None, 0.5), ("schedule_slip", "", ["f"], ["p"], 0.75)], schema), reach, goals)
    rows = sorted(got.collect(), key=lambda r: r["evidence"])
    assert [(r["severity"], r["goals"], r["participants"]) for r in rows] == [(0.7, ["kr-1", "kr-9"], []), (0.75, [], ["p"])]
    ends = I.affects(got, spark.createDataFrame([("kr-1",)], "node_id string")).collect()
    assert [(r["src"], r["dst"]) for r in ends] == [(rows[0]["id"], "kr-1")]
    for bad in (("odd", "n", ["e"], None, 0.5), ("schedule_slip", "n", [], None, 0.5)):
        with pytest.raises(Exception):
            I.built_risks(spark.createDataFrame([bad], schema), reach, goals).collect()


def test_snapshot_differences_of_claims(spark):
    text = "---\nnode_id: pulse-2024-02-0{k}-x\nclaims:\n- {{subject: s, aspect: a, value: {v}, polarity: positive, grounded_node: n{more}}}\n---\n"
    old = C.normalise(N.claims(parsed(spark, {"pulse/1.md": text.format(k=1, v=1, more=""), "pulse/2.md": text.format(k=2, v=9, more="")})))
    new = C.normalise(N.claims(parsed(spark, {"pulse/1.md": text.format(k=1, v=1, more=", superseded_by: c"), "pulse/2.md": text.format(k=2, v=9, more=""), "pulse/3.md": text.format(k=3, v=2, more="")})))
    changes = sorted(r["change"] for r in I.diff_claims(old, new).collect())
    assert changes == ["new", "superseded"]
    assert [(r["a"], r["b"]) for r in I.new_contradictions(old, new).collect()] == [(1_000_000, 2_000_000)]
    communities = spark.createDataFrame([("x", "c1"), ("y", "c2"), ("z", "c3")], "node string, community string")
    touched = I.touched_communities(spark.createDataFrame([("x",)], "node_id string"), spark.createDataFrame([("x", "y")], "src string, dst string"), communities)
    assert {r["community"] for r in touched.collect()} == {"c1", "c2"}


def test_pagerank_settles_and_chains_lead_to_episodes(spark):
    edges = spark.createDataFrame([("c1", "kr-1", "SERVES"), ("c2", "kr-1", "SERVES"), ("pulse-a", "c1", "MENTIONS"), ("pulse-b", "c2", "MENTIONS"), ("pulse-b", "c1", "MENTIONS")], EDGES)
    seeds = spark.createDataFrame([("s", "kr-1", 1.0)], "seed string, node string, weight double")
    got = {r["node"]: r["score"] for r in G.pagerank(edges, seeds, tolerance=1e-5).collect()}
    near = {"kr-1": ["c1", "c2"], "c1": ["kr-1", "pulse-a", "pulse-b"], "c2": ["kr-1", "pulse-b"], "pulse-a": ["c1"], "pulse-b": ["c1", "c2"]}
    for n, own in near.items():
        assert abs(got[n] - sum(0.85 * got[x] / len(near[x]) for x in own) - (0.15 if n == "kr-1" else 0)) < 1e-4
    top = V.replicas(edges, seeds, 2).collect()
    assert {r["episode"]: r["chain"] for r in top} == {"pulse-a": ["kr-1", "c1", "pulse-a"], "pulse-b": ["kr-1", "c1", "pulse-b"]}
    similar = spark.createDataFrame([("t", "c1", 0.5), ("t", "outside", 0.5)], "seed string, node string, similarity double")
    assert [tuple(r) for r in V.weighted(similar, edges).collect()] == [("t", "c1", 1.0)]


def test_label_propagation_against_a_plain_loop(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f"), ("x", "y")]
    near = {}
    for a, b in pairs:
        near.setdefault(a, {a}).add(b)
        near.setdefault(b, {b}).add(a)
    labels = {n: n for n in near}
    for _ in range(100):
        new = {}
        for n, own in near.items():
            votes = [labels[x] for x in own]
            new[n] = min(set(votes), key=lambda v: (-votes.count(v), v))
        if new == labels:
            break
        labels = new
    least = {v: min(n for n in labels if labels[n] == v) for v in labels.values()}
    edges = spark.createDataFrame([(a, b, "SERVES") for a, b in pairs], EDGES)
    assert {r["node"]: r["community"] for r in G.label_propagation(edges).collect()} == {n: least[v] for n, v in labels.items()}


def test_embeddings_of_texts(spark):
    rows = V.embed(spark.createDataFrame([(1, "One two ONE"), (2, None), (3, "two one one")], "id long, text string"), "id", "text", 16).collect()
    got = {r["id"]: r["embedding"] for r in rows}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-9 and got[1] == got[3] and not any(got[2])


def test_command_line_lints_and_promotes(spark, tmp_path, capsys):
    ground = tmp_path / "GROUND"
    (ground / "NEXUS").mkdir(parents=True)
    (ground / "config.yaml").write_text("product: {slug: p}\nteam: {roster: {product_engineer: Ann}}\n")
    (ground / "NEXUS" / "k.md").write_text(note("kr-1").replace("objective", "key-result"))
    (ground / "NEXUS" / "a.md").write_text(note("a"))
    at = ["--vault", str(ground / "NEXUS"), "--ground", str(ground), "--warehouse", str(tmp_path / "w"), "--today", "2024-01-10"]
    assert cli.main(["lint", *at]) == 0
    (tmp_path / "q.yaml").write_text("- {src: a, dst: kr-1, status: approved}\n- {src: a2, dst: kr-1, status: approved}\n")
    assert cli.main(["promote", *at, "--queue", str(tmp_path / "q.yaml")]) == 0
    assert {(r["src"], r["status"]) for r in config.queue(spark, str(tmp_path / "q.yaml")).collect()} == {("a", "promoted"), ("a2", "approved")}
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "w" / "promoted")).collect()] == [("a", "SERVES", "kr-1", "0.5")]
