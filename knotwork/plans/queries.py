"""Named queries over the star-schema tables, each with the SQL that another engine runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork import vocab
from knotwork.functions import scalars as S
from knotwork.operators import claims as C
from knotwork.operators import derive as D
from knotwork.operators import graph as G
from knotwork.operators import insight as I
from knotwork.operators import quality as Q
from knotwork.operators import temporal as T
from knotwork.operators import vectors as V
from knotwork.sources import notes as N
from knotwork.sources.tables import Catalog, render, with_prefix
from knotwork.streaming import events as E

TODAY, AT = "2001-09-01", "2000-01-01"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str, recursive: bool = False):
    """Register a function of a Catalog under a name, with SQL over the views named."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql:
            body = render(sql, False).strip()
            if views:
                prefix = with_prefix(*views)
                if recursive:
                    prefix = prefix.replace("with ", "with recursive ", 1)
                body = prefix + (",\n" + body[5:] if body.startswith("with ") else "\n" + body)
            SQL[name] = body
        return f

    return add


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


SEM = _in(vocab.SEMANTIC.values())
AXIS = _in(vocab.VALUE_AXIS.values())
GOALS = "select concat('kr-', n_nationkey) as goal, concat('obj-', n_regionkey) as objective, case when n_nationkey % 3 > 0 then concat('EPIC-', n_nationkey % 5) end as epic from nation"
_RIPE = "case when ttl_days > 0 then (cast('2001-09-01' as date) - updated) / cast(ttl_days as double) end"
_CLASS = f"case when {_RIPE} < 0.5 then 'fresh' when {_RIPE} < 1 then 'ripening' when {_RIPE} is not null then 'wilting' end"
_COMPLETE = "case when nexus <> '' and node_type <> '' and kind <> '' and owner <> '' and confidence is not null and n_sources > 0 and updated is not null and ttl_days is not null and ripeness <> '' then 1.0 else 0.0 end"
_KEYS = "persons as (select case when length(title) - length(replace(title, ' ', '')) > 0 then lower(title) else replace(replace(node_id, 'team-', ''), '-', ' ') end as key, node_id from kg_nodes where node_type = 'person'), idx as (select key, min(node_id) as person from persons group by key having count(*) = 1)"


@query("context_ripeness", f"""
select coalesce(nexus, '?') as nexus, count(*) as n_nodes,
  round(avg({_COMPLETE})
    * coalesce(sum(coalesce(confidence, 0.5) * greatest(0.0, least(1.0, 1 - {_RIPE}))) / sum(case when ttl_days > 0 then coalesce(confidence, 0.5) end), 0.0), 3) as ripeness
from kg_nodes group by 1""", "kg_nodes")  # fmt: skip
def _(c):
    return Q.context_ripeness(c.kg_nodes, TODAY)


def _goals(c: Catalog) -> DataFrame:
    return c.nation.select(
        F.concat(F.lit("kr-"), "n_nationkey").alias("goal"),
        F.concat(F.lit("obj-"), "n_regionkey").alias("objective"),
        F.when(F.col("n_nationkey") % 3 > 0, F.concat(F.lit("EPIC-"), F.col("n_nationkey") % 5)).alias("epic"),
    )


_OWNERS = f"with {_KEYS}, owned as (select node_id, owner, case when owner like '% %' then lower(owner) end as key from kg_nodes where owner is not null and owner <> '')"


@query("derive_spine_edges", f"""{_OWNERS}, goals as ({GOALS})
select 'OWNS' as etype, node_id as src, person as dst, 'high' as confidence from owned join idx using (key)
union all select 'SERVES', goal, min(objective), 'high' from goals group by goal
union all select 'DELIVERS', epic, goal, 'high' from goals where epic is not null""", "kg_nodes")  # fmt: skip
def _(c):
    return D.derive_spine(c.kg_nodes, _goals(c))


@query("owner_resolution_unique", f"{_OWNERS} select node_id, owner, person from owned left join idx using (key)", "kg_nodes")
def _(c):
    return D.resolve_owners(c.kg_nodes)


@query("person_resolution", f"""with {_KEYS}, named as (select episode_id, participant, lower(replace(participant, ' (guest)', '')) as key from kg_episodes)
select episode_id, participant, coalesce(a.person, b.person) as person from named n left join idx a on a.key = n.key
left join idx b on b.key = concat(split_part(n.key, ' ', 2), ' ', split_part(n.key, ' ', 1))""", "kg_nodes", "kg_episodes")  # fmt: skip
def _(c):
    return D.resolve_people(c.kg_episodes.select("episode_id", "participant"), c.kg_nodes, "participant")


@query("derive_value_edges", "select case field when 'depends_on' then 'DEPENDS_ON' else 'HAS_NEED' end as etype, src, ref as dst from kg_refs where ref in (select node_id from kg_nodes)", "kg_nodes", "kg_refs")
def _(c):
    return D.value_edges(c.kg_refs, c.kg_nodes)


@query("dangling_refs", "select src, field, ref from kg_refs where ref not in (select node_id from kg_nodes)", "kg_nodes", "kg_refs")
def _(c):
    return D.dangling(c.kg_refs, c.kg_nodes)


_GROUND = """with refs as (select episode_id, 'nexus' as plane, nexus_ref as ref from kg_episodes union all select episode_id, 'jira', jira_ref from kg_episodes),
hits as (select r.*, n.node_id is not null as hit from refs r left join (select distinct node_id from kg_nodes) n on n.node_id = r.ref)"""


@query("ground_refs", f"""{_GROUND} select episode_id, ref, case when hit then 'nexus' else plane end as plane,
case when hit then ref when plane = 'jira' then concat('task-', ref) end as target, case when hit then 'high' when plane = 'jira' then 'medium' end as trust, hit or plane = 'jira' as resolved from hits""", "kg_nodes", "kg_episodes")  # fmt: skip
def _(c):
    e = c.kg_episodes
    refs = e.select("episode_id", F.lit("nexus").alias("plane"), F.col("nexus_ref").alias("ref")).unionAll(e.select("episode_id", F.lit("jira"), "jira_ref"))
    return D.ground_refs(refs, c.kg_nodes)


@query("mention_trust", f"""{_GROUND} select cast(count_if(hit) as bigint) as high, cast(count_if(not hit and plane = 'jira') as bigint) as medium, cast(count_if(not hit and plane = 'nexus') as bigint) as ungrounded from hits""", "kg_nodes", "kg_episodes")
def _(c):
    e = c.kg_episodes
    refs = e.select("episode_id", F.lit("nexus").alias("plane"), F.col("nexus_ref").alias("ref")).unionAll(e.select("episode_id", F.lit("jira"), "jira_ref"))
    g = D.ground_refs(refs, c.kg_nodes)
    return g.agg(F.count_if(F.col("trust") == "high").alias("high"), F.count_if(F.col("trust") == "medium").alias("medium"), F.count_if(~F.col("resolved")).alias("ungrounded"))


@query("derive_episode_edges", f"""{_GROUND}, {_KEYS}, named as (select episode_id, lower(replace(participant, ' (guest)', '')) as key from kg_episodes)
select distinct * from (select 'MENTIONS' as etype, episode_id as src, case when hit then ref else concat('task-', ref) end as dst, case when hit then 'high' else 'medium' end as confidence from hits where hit or plane = 'jira'
union all select 'MENTIONS', hits.episode_id, e.episode_id, 'high' from hits join (select distinct episode_id from kg_episodes) e on substring(e.episode_id, 7) = ref where not hit and plane = 'nexus'
union all select 'involves', episode_id, coalesce(a.person, b.person), 'high' from named n left join idx a on a.key = n.key
left join idx b on b.key = concat(split_part(n.key, ' ', 2), ' ', split_part(n.key, ' ', 1)) where coalesce(a.person, b.person) is not null)""", "kg_nodes", "kg_episodes")  # fmt: skip
def _(c):
    return D.episode_edges(c.kg_episodes, c.kg_nodes)


@query("edges_by_type", "select etype, count(*) as n from kg_edges group by etype", "kg_edges")
def _(c):
    return Q.edge_counts(c.kg_edges)


@query("node_degree", "select node_id, count(*) as degree from (select src as node_id from kg_edges union all select dst from kg_edges) group by node_id", "kg_edges")
def _(c):
    return Q.degrees(c.kg_edges)


@query("isolated_nodes", "with live as (select src, dst from kg_edges where expired_at is null and etype <> 'involves'), ends as (select src as node_id from live union select dst from live) select n.node_id, node_type from kg_nodes n left join ends e on e.node_id = n.node_id where e.node_id is null and coalesce(reports_to, '') = ''", "kg_nodes", "kg_edges")
def _(c):
    """Nodes that no edge of today's graph touches, involvement aside."""
    return Q.isolated(c.kg_nodes, c.kg_edges.where("expired_at is null and etype <> 'involves'"))


@query("workslop_nodes", "select node_id, nexus from kg_nodes where n_sources = 0", "kg_nodes")
def _(c):
    return Q.unsourced(c.kg_nodes)


@query("broken_edge_ends", """select src, dst, etype, 'dst' as missing from d where dst not in (select node_id from kg_nodes)
union all select src, dst, etype, 'src' from d where etype <> 'DELIVERS' and src not in (select node_id from kg_nodes)""".replace("select src, dst, etype, 'dst'", "with d as (select src, ref as dst, upper(field) as etype from kg_refs) select src, dst, etype, 'dst'", 1), "kg_nodes", "kg_refs")
def _(c):
    return Q.broken_ends(c.kg_nodes, c.kg_refs.select("src", F.col("ref").alias("dst"), F.upper("field").alias("etype")))


_OWN_EDGES = f"{_OWNERS}, goals as ({GOALS}), e as (select 'OWNS' as etype, node_id as src, person as dst from owned join idx using (key) union all select 'OWNS', 'kr-1', 'team-supp-2' union all select 'SERVES', goal, objective from goals where goal <> 'kr-5')"


def _spine(c: Catalog) -> DataFrame:
    """The spine with a goal of two owners and one that serves nothing."""
    spine = D.derive_spine(c.kg_nodes, _goals(c)).select("etype", "src", "dst").where("etype <> 'DELIVERS' and not (etype = 'SERVES' and src = 'kr-5')")
    more = c.spark.createDataFrame([("OWNS", "kr-1", "team-supp-2")], "etype string, src string, dst string")
    return spine.unionByName(more)


_INVARIANTS = """k as (select node_id from kg_nodes where node_type = 'key-result'), o as (select node_id from kg_nodes where node_type = 'objective'),
inv as (select 'no-owner' as rule, node_id, '' as detail from k where node_id not in (select src from e where etype = 'OWNS')
union all select 'spine-orphan', node_id, '' from k where node_id not in (select src from e where etype = 'SERVES')
union all select 'spine-orphan', node_id, '' from o where node_id not in (select dst from e where etype = 'SERVES')
union all select 'many-owners', src, string_agg(distinct dst, ',' order by dst) from e join k on k.node_id = e.src where etype = 'OWNS' group by src having count(distinct dst) > 1)"""


@query("spine_invariants", f"{_OWN_EDGES}, {_INVARIANTS} select * from inv", "kg_nodes")
def _(c):
    return Q.spine_invariants(c.kg_nodes, _spine(c))


@query("gate_status", f"""{_OWN_EDGES}, {_INVARIANTS}, ripe as (select round(avg({_COMPLETE})
    * coalesce(sum(coalesce(confidence, 0.5) * greatest(0.0, least(1.0, 1 - {_RIPE}))) / sum(coalesce(confidence, 0.5)), 0.0), 3) as r from kg_nodes group by nexus),
x as (select (select min(r) from ripe) as ripeness_min, (select count(*) from kg_refs where ref not in (select node_id from kg_nodes)) as n_broken, (select count(*) from inv where rule = 'no-owner') as n_unowned,
(select count(*) from inv where rule = 'spine-orphan') as n_orphans, (select count(*) from inv where rule = 'many-owners') as n_contradictions)
select *, concat_ws(',', case when ripeness_min < 0.6 then 'ripeness' end, case when n_broken > 0 then 'n_broken' end, case when n_unowned > 0 then 'n_unowned' end, case when n_orphans > 0 then 'n_orphans' end, case when n_contradictions > 0 then 'n_contradictions' end) as reasons,
ripeness_min >= 0.6 and n_broken + n_unowned + n_orphans + n_contradictions = 0 as passed from x""", "kg_nodes", "kg_refs")  # fmt: skip
def _(c):
    broken = D.dangling(c.kg_refs, c.kg_nodes)
    return Q.gate(Q.context_ripeness(c.kg_nodes, TODAY), broken, Q.spine_invariants(c.kg_nodes, _spine(c)))


@query("lint_issues", f"""with d as (select src, ref as dst, upper(field) as etype from kg_refs)
select 'ERROR' as severity, 'duplicate-id' as rule, node_id from kg_nodes group by node_id having count(*) > 1
union all select 'ERROR', 'missing-confidence', node_id from kg_nodes where confidence is null
union all select 'ERROR', 'missing-owner', node_id from kg_nodes where coalesce(owner, '') = ''
union all select 'ERROR', 'confidence-range', node_id from kg_nodes where confidence < 0 or confidence > 1
union all select 'ERROR', 'unknown-nexus', node_id from kg_nodes where nexus not in ('okr', 'team', 'product', 'pulse', 'system', 'building')
union all select 'ERROR', 'no-sources', node_id from kg_nodes where n_sources = 0
union all select 'WARN', 'wilting', node_id from kg_nodes where {_RIPE} >= 1
union all select 'ERROR', 'dangling-edge', src from d where dst not in (select node_id from kg_nodes)""", "kg_nodes", "kg_refs")  # fmt: skip
def _(c):
    registry = c.spark.createDataFrame([(s,) for s in ("okr", "team", "product", "pulse", "system", "building")], "slug string")
    return Q.lint(c.kg_nodes, c.kg_refs.select("src", F.col("ref").alias("dst"), F.upper("field").alias("etype")), registry, TODAY)


@query("ripeness_class", f"select node_id, cast(cast('2001-09-01' as date) - updated as int) as age, {_CLASS} as ripeness from kg_nodes", "kg_nodes")
def _(c):
    return Q.ripeness_classes(c.kg_nodes, TODAY)


@query("ripeness_drift", f"select node_id, 'fresh' as declared, {_CLASS} as computed from kg_nodes where {_CLASS} <> 'fresh'", "kg_nodes")
def _(c):
    return Q.ripeness_drift(c.kg_nodes.withColumn("ripe", F.lit("fresh")), "ripe", TODAY)


_SOME = "fewer as (select * from kg_edges where expired_at is null)"
_GAPS = f"{_SOME}, ends as (select src as node_id from fewer union select dst from fewer), gap as (select node_id, coalesce(nullif(title, ''), node_id) as title, case when node_id not in (select node_id from ends) and coalesce(reports_to, '') = '' then 'isolated' when nexus = 'system' and node_id not in (select src from fewer where etype = 'SERVES') then 'no-serves' end as reason from kg_nodes)"


def _some(c: Catalog) -> DataFrame:
    """The edges that have not expired."""
    return c.kg_edges.where("expired_at is null")


@query("find_gaps", f"with {_GAPS} select * from gap where reason is not null", "kg_nodes", "kg_edges")
def _(c):
    return Q.gaps(c.kg_nodes, _some(c))


@query("value_axis_gaps", f"select node_id, nexus from kg_nodes where nexus in {_in(vocab.VALUE_NEXUSES)} and node_id not in (select src from kg_edges where etype in {AXIS} union select dst from kg_edges where etype in {AXIS})", "kg_nodes", "kg_edges")
def _(c):
    return Q.value_axis_gaps(c.kg_nodes, c.kg_edges, Q.value_axis_eligible(S.is_content("node_type", "node_id")))


@query("value_axis_gaps_all", f"select node_id, nexus from kg_nodes where node_id not in (select src from kg_edges where etype in {AXIS} union select dst from kg_edges where etype in {AXIS})", "kg_nodes", "kg_edges")
def _(c):
    return Q.value_axis_gaps(c.kg_nodes, c.kg_edges)


@query("kr_choices", "select distinct node_id, coalesce(nullif(title, ''), node_id) as title from kg_nodes where node_type = 'key-result'", "kg_nodes")
def _(c):
    return Q.goal_choices(c.kg_nodes)


_QUEUE = "queue as (select concat('cust-', c_custkey) as src, case c_custkey % 4 when 0 then 'open' when 1 then 'approved' when 2 then 'promoted' else 'resolved' end as status, concat('kr-', c_custkey % 40) as dst from customer)"


def _queue(c: Catalog) -> DataFrame:
    k = F.col("c_custkey")
    status = F.when(k % 4 == 0, "open").when(k % 4 == 1, "approved").when(k % 4 == 2, "promoted").otherwise("resolved")
    return c.customer.select(F.concat(F.lit("cust-"), k).alias("src"), status.alias("status"), F.concat(F.lit("kr-"), k % 40).alias("dst"))


@query("candidate_transition", f"with {_GAPS}, {_QUEUE}, g as (select node_id as src from gap where reason is not null) select coalesce(queue.src, g.src) as src, case when status is null then 'open' when status = 'open' and g.src is null then 'resolved' else status end as status from queue full join g on g.src = queue.src", "kg_nodes", "kg_edges")
def _(c):
    return Q.queue_transition(_queue(c), Q.gaps(c.kg_nodes, _some(c)).select(F.col("node_id").alias("src")))


@query("promote_candidates", f"with {_QUEUE} select src, dst, case when src in (select node_id from kg_nodes) and dst in (select node_id from kg_nodes where node_type = 'key-result') then 'promoted' else 'skipped' end as outcome from queue where status = 'approved'", "kg_nodes")
def _(c):
    return Q.promote(_queue(c), c.kg_nodes)


_ACTIVE = f"etype in {SEM} and expired_at is null and coalesce(valid_at <= cast('{AT}' as date), true) and coalesce(invalid_at > cast('{AT}' as date), true)"


@query("edges_as_of", f"select * from kg_edges where {_ACTIVE}", "kg_edges")
def _(c):
    return T.as_of(c.kg_edges, AT)


@query("edges_current", f"select * from kg_edges where etype in {SEM} and expired_at is null and invalid_at is null", "kg_edges")
def _(c):
    return T.as_of(c.kg_edges, None)


_STORED = "stored as (select src, etype, dst, min(valid_at) as valid_at, max(invalid_at) as invalid_at from kg_edges where valid_at is null or valid_at < cast('2000-01-01' as date) group by src, etype, dst), asserted as (select src, etype, dst, min(valid_at) as new_valid from kg_edges where expired_at is null and invalid_at is null group by src, etype, dst)"


@query("reconcile_supersede", f"""with {_STORED}, a as (select * from asserted where etype in {SEM})
select coalesce(s.src, a.src) as src, coalesce(s.etype, a.etype) as etype, coalesce(s.dst, a.dst) as dst, case when s.src is not null then s.valid_at else coalesce(new_valid, cast('2002-01-01' as date)) end as valid_at,
case when a.src is not null then null when s.etype in {SEM} and s.invalid_at is null then cast('2002-01-01' as date) else s.invalid_at end as invalid_at
from stored s full join a on a.src = s.src and a.etype = s.etype and a.dst = s.dst""", "kg_edges")  # fmt: skip
def _(c):
    stored = c.kg_edges.where("valid_at is null or valid_at < date '2000-01-01'").groupBy("src", "etype", "dst").agg(F.min("valid_at").alias("valid_at"), F.max("invalid_at").alias("invalid_at"))
    return T.supersede(stored, c.kg_edges.where("expired_at is null and invalid_at is null"), "2002-01-01")


_NORM = """claims as (select ord, concat('claim-', episode, '-', substring(sha1(concat_ws('|', subject, aspect, value, episode)), 1, 8)) as id, subject, aspect, value, coalesce(nullif(polarity, ''), 'neutral') as polarity, speaker, speaker_role,
case when aspect_kind in ('commitment', 'state', 'opinion') then aspect_kind else 'state' end as aspect_kind, value_type, value_norm, grounded_node, confidence, episode, valid_at,
case when invalid_at is null or expired_at is null then invalid_at end as invalid_at, case when invalid_at is null or expired_at is null then expired_at end as expired_at, superseded_by
from kg_claims where subject <> '' and aspect <> '' and value <> '')"""


@query("claims_normalised", f"with {_NORM} select * from claims", "kg_claims")
def _(c):
    return C.normalise(c.kg_claims)


@query("claim_ids", f"with {_NORM} select ord, id from claims", "kg_claims")
def _(c):
    return C.normalise(c.kg_claims).select("ord", "id")


_OPEN = "open_claims as (select * from claims where superseded_by is null and invalid_at is null and expired_at is null)"
_PAIRS = "pairs as (select a.grounded_node, a.subject, a.aspect, a.ord as a, b.ord as b from open_claims a join open_claims b on a.grounded_node = b.grounded_node and a.subject = b.subject and a.aspect = b.aspect and a.ord < b.ord and (a.polarity <> b.polarity or a.value <> b.value))"


@query("contradiction_pairs", f"with {_NORM}, {_OPEN}, {_PAIRS} select * from pairs", "kg_claims")
def _(c):
    return C.contradictions(C.normalise(c.kg_claims))


@query("plan_shifts", f"""with {_NORM}, l as (select *, lag(value_norm) over w as pv, lag(valid_at) over w as pa, lag(speaker) over w as ps, lag(speaker_role) over w as pr from claims where aspect_kind = 'commitment' and value_norm is not null
window w as (partition by subject, aspect order by valid_at nulls last, ord))
select subject, aspect, pv as from_value, value_norm as to_value, pa as from_at, valid_at as to_at, ps as from_speaker, speaker as to_speaker, pr as from_role, speaker_role as to_role, ord from l where pv <> value_norm""", "kg_claims")  # fmt: skip
def _(c):
    return C.plan_shifts(C.normalise(c.kg_claims))


POLICY = [("Purchase ", "commitment"), ("view", "opinion"), ("click", "state"), ("click", "opinion")]


@query("authority_check", f"""with {_NORM}, policy as (select * from (values ('purchase', 'commitment'), ('view', 'opinion'), ('click', 'state'), ('click', 'opinion')) p(role, kind))
select ord, case when speaker_role in (select role from policy) then exists (select 1 from policy where role = speaker_role and kind = aspect_kind) end as authoritative from claims""", "kg_claims")  # fmt: skip
def _(c):
    return C.authority(C.normalise(c.kg_claims), c.spark.createDataFrame(POLICY, "role string, aspect_kind string")).select("ord", "authoritative")


@query("off_vocab_aspects", f"with {_NORM} select distinct aspect from claims where aspect not in ('click', 'view')", "kg_claims")
def _(c):
    return C.off_vocabulary(C.normalise(c.kg_claims), c.spark.createDataFrame([("click",), ("view",)], "canonical string"))


@query("claim_about_kr_3hop", f"with {_NORM} select ord, grounded_node as node_id, etype, dst as goal from claims join kg_edges on src = grounded_node and etype in ('SERVES', 'DELIVERS') where grounded_node in (select node_id from kg_nodes) and dst in (select node_id from kg_nodes where node_type = 'key-result')", "kg_claims", "kg_nodes", "kg_edges")
def _(c):
    return I.about_goals(C.normalise(c.kg_claims), c.kg_nodes, c.kg_edges)


@query("superseded_by_edges", f"with {_NORM} select id as src, superseded_by as dst, superseded_by in (select id from claims) as \"exists\" from claims where superseded_by is not null", "kg_claims")
def _(c):
    return C.superseded_by(C.normalise(c.kg_claims))


_REACHING = _in(vocab.REACHING)


@query("reachability_from_kr", f"""with e as (select src as a, dst as b from kg_edges where etype in {_REACHING} union select dst, src from kg_edges where etype in {_REACHING}),
walk(node) as (select node_id from kg_nodes where node_type = 'key-result' union select e.b from walk join e on e.a = node)
select node_id, node_id in (select node from walk) as reached from kg_nodes""", "kg_nodes", "kg_edges", recursive=True)
def _(c):
    return G.reachability(c.kg_nodes, c.kg_edges)


@query("bfs_hops", """with recursive e as (select src, dst from kg_edges where etype = 'SERVES' union select dst, src from kg_edges where etype = 'SERVES'),
walk(node, depth) as (select 'kr-3', 0 union select e.dst, depth + 1 from walk join e on e.src = node where depth < 4) select 'kr-3' as seed, node, min(depth) as depth from walk group by node""".replace("with recursive e", "with e"), "kg_edges", recursive=True)  # fmt: skip
def _(c):
    seeds = c.spark.createDataFrame([("kr-3",)], "node string")
    return G.hops(c.kg_edges.where("etype = 'SERVES'"), seeds, 4).select("seed", "node", "depth")


@query("shortest_chains", """with e as (select src, dst from kg_edges where etype in ('SERVES', 'MENTIONS')), up as (select src as item, dst as goal from e where dst like 'kr-%' and src like 'cust-%'), m as (select src as episode, dst as item from e where src like 'pulse-%')
select goal as seed, episode as node, concat(goal, '>', item, '>', episode) as chain from up join m using (item) where goal in ('kr-3', 'kr-4')""", "kg_edges")  # fmt: skip
def _(c):
    edges = c.kg_edges.where("etype in ('SERVES', 'MENTIONS') and dst not like 'obj-%'")
    reached = G.kept(G.hops(edges, c.spark.createDataFrame([("kr-3",), ("kr-4",)], "node string"), 2))
    return G.chains(reached, reached.where("node like 'pulse-%'")).select("seed", "node", F.array_join("chain", ">").alias("chain"))


_REGIONS = "labels as (select concat('obj-', r_regionkey) as node, r_regionkey as r from region union all select concat('kr-', n_nationkey), n_regionkey from nation union all select concat('cust-', c_custkey), n_regionkey from customer join nation on n_nationkey = c_nationkey), comp as (select l.node, min(m.node) as component from labels l join (select r, min(node) as node from labels group by r) m using (r) group by l.node)"


@query("connected_components", f"with {_REGIONS} select node, component from comp where node in (select src from kg_edges where etype = 'SERVES' union select dst from kg_edges where etype = 'SERVES')", "kg_edges")
def _(c):
    return G.components(c.kg_edges.where("etype = 'SERVES'"))


@query("affected_krs", f"with {_REGIONS}, g as (select component, node as goal from comp where node like 'kr-%') select c.node, coalesce(string_agg(goal, ',' order by goal), '') as goals from comp c left join g on g.component = c.component and g.goal <> c.node where c.node in (select src from kg_edges where etype = 'SERVES' union select dst from kg_edges where etype = 'SERVES') group by c.node", "kg_edges")
def _(c):
    return G.affected_goals(c.kg_edges.where("etype = 'SERVES'")).select("node", F.array_join("goals", ",").alias("goals"))


_WHICH = "etype in ('SERVES', 'MENTIONS') and dst not like 'obj-%'"
#: Plain rounds of every goal; 0.85 to the 150th is below 1e-10, so all have settled.
_PPR = f"""e as (select src, dst from kg_edges where {_WHICH} union select dst, src from kg_edges where {_WHICH}), l as (select src, dst, count(*) over (partition by src) as deg from e),
r(i, seed, node, p) as (select 0, src, src, cast(1 as double) from (select distinct src from l where src like 'kr-%') union all
select i + 1, seed, n2, sum(x) from (select r.i, r.seed, l.dst as n2, 0.85 * r.p / l.deg as x from r join l on l.src = r.node where r.i < 150 union all select distinct r.i, r.seed, r.seed, cast(0.15 as double) from r where r.i < 150) group by i, seed, n2)"""


@query("ppr_topk", f"""with {_PPR}, best as (select * from (select seed, node as episode, p, row_number() over (partition by seed order by round(p, 9) desc, node desc) as k from r where i = 150 and node like 'pulse-%' and p > 0) where k <= 10)
select seed, episode, round(p, 4) as score, concat(seed, '>', m.dst, '>', episode) as chain from best join kg_edges m on m.src = episode and m.etype = 'MENTIONS' join kg_edges s on s.src = m.dst and s.dst = seed and s.etype = 'SERVES'""", "kg_edges", recursive=True)
def _(c):
    """The ten best episodes of every goal."""
    edges = G.kept(c.kg_edges.where(_WHICH).select("src", "dst", "etype"))
    goals = edges.select(F.explode(F.array("src", "dst")).alias("seed")).where(F.col("seed").startswith(vocab.GOAL)).distinct()
    seeds = G.kept(goals.select("seed", F.col("seed").alias("node"), F.lit(1.0).alias("weight")))
    return V.replicas(edges, seeds, 10).withColumn("chain", F.array_join("chain", ">"))


@query("communities_lpa")
def _(c):
    return G.label_propagation(c.kg_edges)


_MEMBERS = "m as (select concat('cust-', c_custkey) as node, case when c_custkey % 17 > 0 then concat('kr-', c_nationkey) end as community from customer), blast as (select node, community, coalesce(count(*) over (partition by community) - 1, 0) * (case when community is null then 0 else 1 end) as radius from m)"


def _members(c: Catalog) -> DataFrame:
    k = F.col("c_custkey")
    return c.customer.select(F.concat(F.lit("cust-"), k).alias("node"), F.when(k % 17 > 0, F.concat(F.lit("kr-"), "c_nationkey")).alias("community"))


@query("blast_radius", f"with {_MEMBERS} select * from blast")
def _(c):
    return G.blast_radius(_members(c))


@query("blast_distribution", f"with {_MEMBERS} select radius, count(*) as n from blast group by radius")
def _(c):
    return G.blast_radius(_members(c)).groupBy("radius").agg(F.count("*").alias("n"))


_PCT = "pct as (select v.radius, round(((select count(*) from blast b where b.radius < v.radius) + 0.5 * (select count(*) from blast b where b.radius = v.radius)) / (select count(*) from blast), 6) as percentile from (select distinct radius from blast) v)"


@query("blast_percentile", f"with {_MEMBERS}, {_PCT} select * from pct")
def _(c):
    return G.midrank(G.blast_radius(_members(c)), "radius")


@query("risk_severity", f"with {_NORM}, {_OPEN}, {_PAIRS}, {_MEMBERS}, {_PCT}, s as (select grounded_node as node, count(*) as n from pairs group by 1), g as (select grounded_node as node, avg(confidence) as gc from claims group by 1) select node, n, round(round(least(1.0, 0.5 * percentile + 0.3 * least(n / 3.0, 1.0) + 0.2 * (1 - coalesce(gc, 0.5))), 9), 3) as severity from s join g using (node) join blast using (node) join pct using (radius)", "kg_claims")
def _(c):
    claims = C.normalise(c.kg_claims)
    reach = G.blast_radius(_members(c))
    n = C.contradictions(claims).groupBy(F.col("grounded_node").alias("node")).agg(F.count("*").alias("n"))
    gc = claims.groupBy(F.col("grounded_node").alias("node")).agg(F.avg("confidence").alias("gc"))
    rows = n.join(gc, "node").join(reach, "node").join(G.midrank(reach, "radius"), "radius")
    return rows.select("node", "n", S.severity(F.col("percentile"), F.col("n"), F.col("gc")).alias("severity"))


_KNN = "q as (select vec_id as query, embedding as q from embeddings where vec_id % 50 = 0), dist as (select query, vec_id as id, round(list_sum(list_transform(list_zip(embedding, q.q), lambda z: (cast(z[1] as double) - cast(z[2] as double)) * (cast(z[1] as double) - cast(z[2] as double)))), 9) as distance from embeddings, q), knn as (select * from (select *, row_number() over (partition by query order by distance, id) as k from dist) where k <= 8)"


@query("knn_seeds", f"with {_KNN} select query, id, distance, round(greatest(0.0, 1 - distance / 2), 6) as similarity from knn")
def _(c):
    queries = c.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return V.nearest(c.embeddings, queries, 8)


@query("text_to_replica")
def _(c):
    """The names of all nations as texts, the titles of all nodes as what they may mean."""
    texts = c.nation.select(F.concat(F.lit("text-"), "n_nationkey").alias("query"), F.lower("n_name").alias("text"))
    queries = V.embed(texts, "query", "text", 64).withColumnRenamed("embedding", "q")
    similar = V.nearest(V.embed_titles(c.kg_nodes.where("title is not null"), "node_id", "title", 64), queries, 5, "node_id")
    edges = G.kept(T.as_of(c.kg_edges, None).select("src", "dst", "etype"))
    seeds = G.kept(V.weighted(similar.select(F.col("query").alias("seed"), F.col("id").alias("node"), "similarity"), edges))
    return V.episodes_for(edges, seeds, 5)


@query("text_embeddings")
def _(c):
    return V.embed(c.documents, "doc_id", "text", 32)


@query("insight_rollup", f"""with {_NORM} select (select count(distinct node_id) from kg_nodes) as nodes, (select count(*) from kg_edges) as edges, (select count(*) from (select distinct least(src, dst), greatest(src, dst) from kg_edges)) as pairs,
(select count(*) from kg_nodes where node_id not in (select src from kg_edges union select dst from kg_edges)) as isolated, count(*) as claims, cast(count_if(grounded_node in (select node_id from kg_nodes)) as bigint) as grounded,
cast(count_if(grounded_node not in (select node_id from kg_nodes)) as bigint) as ungrounded, cast(count_if(superseded_by is not null) as bigint) as superseded from claims""", "kg_claims", "kg_nodes", "kg_edges")  # fmt: skip
def _(c):
    return I.rollup(c.kg_nodes, c.kg_edges, C.normalise(c.kg_claims))


_COVER = "cover as (select s.dst as goal, m.src as episode from kg_edges s join kg_edges m on m.dst = s.src and m.etype = 'MENTIONS' where s.etype = 'SERVES')"


@query("goal_coverage", f"with {_COVER} select node_id as goal, count(distinct episode) as episodes from kg_nodes left join cover on goal = node_id where node_type = 'key-result' group by 1", "kg_nodes", "kg_edges")
def _(c):
    return I.goal_coverage(c.kg_edges, c.kg_nodes.where("node_type = 'key-result'"))


_BASE = "bn as (select * from kg_nodes where node_type <> 'episode' or updated < cast('2000-01-01' as date)), be as (select * from kg_edges where valid_at is null or valid_at < cast('2000-01-01' as date))"


def _base(c: Catalog) -> tuple[DataFrame, DataFrame]:
    return c.kg_nodes.where("node_type <> 'episode' or updated < date '2000-01-01'"), c.kg_edges.where("valid_at is null or valid_at < date '2000-01-01'")


@query("snapshot_diff_nodes", f"with {_BASE} select 'new' as change, node_id from kg_nodes where node_id not in (select node_id from bn)", "kg_nodes", "kg_edges")
def _(c):
    return I.diff_nodes(_base(c)[0], c.kg_nodes)


@query("snapshot_diff_edges", f"""with {_BASE}, added as (select distinct src, etype, dst from kg_edges except select src, etype, dst from be), ids as (select distinct node_id from bn)
select src, etype, dst, case (a.node_id is not null)::int + (b.node_id is not null)::int when 1 then 'connecting' when 0 then 'internal' else 'existing' end as kind from added left join ids a on a.node_id = src left join ids b on b.node_id = dst""", "kg_nodes", "kg_edges")  # fmt: skip
def _(c):
    nodes, edges = _base(c)
    return I.diff_edges(nodes, edges, c.kg_edges)


@query("snapshot_kr_delta", f"with {_COVER}, b as (select distinct goal, episode from cover where substring(episode, 7, 10) < '2000-01-01'), n as (select distinct goal, episode from cover where substring(episode, 7, 10) >= '1996-01-01') select coalesce(b.goal, n.goal) as goal, cast(count_if(b.goal is null) as bigint) as gained, cast(count_if(n.goal is null) as bigint) as lost from b full join n on b.goal = n.goal and b.episode = n.episode group by 1", "kg_edges")
def _(c):
    serve = c.kg_edges.where("etype = 'SERVES'").select(F.col("src").alias("item"), F.col("dst").alias("goal"))
    mention = c.kg_edges.where("etype = 'MENTIONS'").select(F.col("src").alias("episode"), F.col("dst").alias("item"))
    cover = serve.join(mention, "item").select("goal", "episode")
    out = I.goal_delta(cover.where("substring(episode, 7, 10) < '2000-01-01'"), cover.where("substring(episode, 7, 10) >= '1996-01-01'"))
    return out.select("goal", F.col("gained").cast("long").alias("gained"), F.col("lost").cast("long").alias("lost"))


@query("node_contexts", f"""with {_NORM}, {_OPEN}, {_PAIRS}, b as (select src, etype, dst from kg_edges where etype = 'SERVES' union select dst, etype, src from kg_edges where etype = 'SERVES'), near as (select src, string_agg(distinct concat(etype, ':', dst), ',' order by concat(etype, ':', dst)) as neighbours from b group by src)
select node_id, coalesce(neighbours, '') as neighbours, neighbours is null as isolated, n_sources = 0 as unsourced, node_id in (select grounded_node from pairs) as in_contradiction from kg_nodes left join near on src = node_id where node_type <> 'episode'""", "kg_claims", "kg_nodes", "kg_edges")  # fmt: skip
def _(c):
    bad = C.contradictions(C.normalise(c.kg_claims)).select(F.col("grounded_node").alias("node_id"))
    return I.contexts(c.kg_nodes.where("node_type <> 'episode'"), c.kg_edges.where("etype = 'SERVES'"), bad)


@query("reflexion_share", "select (select count(*) from documents) as contexts, cast(count_if(quality = 1) as bigint) as understood, cast(count_if(quality <> 1) as bigint) as not_understood, round(count_if(quality = 1) / cast((select count(*) from documents) as double), 6) as share from labels")
def _(c):
    return I.reflexion(c.documents.select("doc_id"), c.labels.select((F.col("quality") == 1).alias("understood")))


_RISKS = f"""{_NORM}, {_OPEN}, {_PAIRS}, {_MEMBERS}, {_PCT}, src as (select 'understanding_gap' as axis, node_id as node, '' as ref, 1 as n, cast(null as double) as grounding from kg_nodes where node_type = 'system-component' and n_sources = 0
union all select 'expectation_divergence', pairs.grounded_node, concat(a, '-', b), 2, (ca.confidence + cb.confidence) / 2 from pairs join claims ca on ca.ord = a join claims cb on cb.ord = b
union all select case when aspect in ('purchase', 'error') then 'schedule_slip' else 'requirements_change' end, grounded_node, cast(ord as varchar), 1, confidence from claims where superseded_by is not null or invalid_at is not null or expired_at is not null),
risks as (select axis, src.node, ref, n, grounding, round(round(least(1.0, 0.5 * coalesce(percentile, 0.0) + 0.3 * least(n / 3.0, 1.0) + 0.2 * (1 - coalesce(grounding, 0.5))), 9), 3) as severity, coalesce(s.dst, '') as goals
from src left join blast on blast.node = src.node left join pct using (radius) left join (select src, dst from kg_edges where etype = 'SERVES' and dst like 'kr-%' and expired_at is null) s on s.src = src.node)"""


def _risks(c: Catalog) -> DataFrame:
    claims = C.normalise(c.kg_claims)
    radius = G.blast_radius(_members(c))
    reach = radius.join(G.midrank(radius, "radius"), "radius").select(F.col("node").alias("node_id"), "percentile")
    goals = c.kg_edges.where("etype = 'SERVES' and dst like 'kr-%' and expired_at is null").select(F.col("src").alias("node_id"), F.array("dst").alias("goals"))
    gap_nodes = c.kg_nodes.where("node_type = 'system-component' and n_sources = 0")
    return I.risks(gap_nodes, C.contradictions(claims), claims, reach, goals, "purchase|error")


@query("risk_synthesis", f"with {_RISKS} select axis, node, ref, n, severity, goals from risks", "kg_claims", "kg_nodes", "kg_edges")
def _(c):
    return _risks(c).select("axis", "node", "ref", "n", "severity", F.array_join("goals", ",").alias("goals"))


@query("risk_gate", f"with {_RISKS} select axis, case when goals <> '' then 'verified' when severity >= 0.5 then 'review' else 'unlinkable' end as bucket, count(*) as n from risks group by 1, 2", "kg_claims", "kg_nodes", "kg_edges")
def _(c):
    return I.route(_risks(c)).groupBy("axis", "bucket").agg(F.count("*").alias("n"))


@query("edge_writeback", f"""with f as (select case when etype = 'DELIVERS' then dst else src end as node_id, case etype when 'SERVES' then 'serves' when 'OWNS' then 'owns_node' when 'DELIVERS' then 'delivered_by' else lower(etype) end as field, etype, case when etype = 'DELIVERS' then src else dst end as value from kg_edges)
select node_id, field, case when field in ('serves', 'owns_node') then max(value) else string_agg(distinct value, ',' order by value) end as "values" from f where node_id in (select node_id from kg_nodes) group by 1, 2""", "kg_nodes", "kg_edges")  # fmt: skip
def _(c):
    return Q.write_back(c.kg_edges, c.kg_nodes)


@query("okr_table_parse", "select concat(n_regionkey + 1, '.', n_nationkey) as goal, n_name as title, case when n_nationkey % 3 > 0 then concat('EPIC-', n_nationkey) end as epic, cast(n_regionkey + 1 as varchar) as objective from nation")
def _(c):
    k = F.col("n_nationkey")
    line = F.concat(F.lit("| "), F.col("n_regionkey") + 1, F.lit("."), k, F.lit(" | "), "n_name", F.lit(" | see "), F.when(k % 3 > 0, F.concat(F.lit("EPIC-"), k)).otherwise("none"), F.lit(" |"))
    head = c.spark.createDataFrame([("| KR | title | epic |",), ("|-|-|-|",), ("prose",)], "line string")
    return N.goal_table(c.nation.select(line.alias("line")).unionByName(head))


def _notes(c: Catalog) -> DataFrame:
    """Notes written out of customers."""
    text = F.format_string("---\nnode_id: cust-%s\nnexus: %s\nconfidence: 0.5\nupdated: 2001-01-0%s\nserves: kr-%s\nmentions: [PRJ-%s, a-%s]\nsources: [x]\n---\nSee [[kr-%s]] and [[cust-%s|me]], OPS-%s.\n", *[F.col(k) for k in ("c_custkey", "c_mktsegment")], F.col("c_custkey") % 9 + 1, *[F.col(k) for k in ("c_nationkey", "c_custkey", "c_custkey", "c_nationkey", "c_custkey", "c_custkey")])
    return c.customer.select(F.col("c_custkey").alias("scan_ord"), F.concat(F.lit("NEXUS/c-"), "c_custkey", F.lit(".md")).alias("rel_path"), text.alias("text"))


@query("frontmatter_parse", "select concat('cust-', c_custkey) as node_id, c_mktsegment as nexus, cast(0.5 as double) as confidence, cast(concat('2001-01-0', c_custkey % 9 + 1) as date) as updated, concat('kr-', c_nationkey) as serves, concat('PRJ-', c_custkey, ',a-', c_custkey) as mentions from customer")
def _(c):
    return N.nodes(N.parse(_notes(c))).select("node_id", "nexus", "confidence", "updated", F.array_join("serves", ",").alias("serves"), F.array_join("mentions", ",").alias("mentions"))


@query("semantic_edges", "select concat('cust-', c_custkey) as src, 'SERVES' as etype, concat('kr-', c_nationkey) as dst from customer union all select concat('cust-', c_custkey), 'MENTIONS', concat('PRJ-', c_custkey) from customer union all select concat('cust-', c_custkey), 'MENTIONS', concat('a-', c_custkey) from customer")
def _(c):
    return N.semantic_edges(N.nodes(N.parse(_notes(c))))


@query("wikilink_extract", "select c_custkey, concat('kr-', c_nationkey, ',cust-', c_custkey) as links from customer")
def _(c):
    return _notes(c).select(F.col("scan_ord").alias("c_custkey"), F.array_join(N.wikilinks(N.body(F.col("text"))), ",").alias("links"))


@query("jira_extract", "select c_custkey, concat('PRJ-', c_custkey, ',OPS-', c_custkey) as tickets from customer")
def _(c):
    return _notes(c).select(F.col("scan_ord").alias("c_custkey"), F.array_join(N.tickets(F.col("text")), ",").alias("tickets"))


def _episodes(orders: DataFrame) -> DataFrame:
    """Episodes written out of orders and parsed."""
    text = F.format_string("---\ndate: %s\nparticipants: Ann Bee, Cy Dee %s,\nlinks: [cust-%s]\n---\n[[feat-1]] JJ-%s [[cust-%s]]\n", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderkey", "o_custkey", "o_orderkey", "o_custkey")
    rows = orders.select(F.concat(F.lit("s/s-"), "o_orderkey", F.lit(".md")).alias("rel_path"), text.alias("text"))
    out = N.episodes(N.parse(rows), {"date": "date", "participants": "participants", "links": "links"})
    return out.select("episode_id", "date", *[F.array_join(k, ",").alias(k) for k in ("participants", "nexus_refs", "jira_refs")])


@query("episode_parse", "select concat('pulse-s-', o_orderkey) as episode_id, strftime(o_orderdate, '%Y-%m-%d') as date, concat('Ann Bee,Cy Dee ', o_orderkey) as participants, concat('cust-', o_custkey, ',feat-1') as nexus_refs, concat('JJ-', o_orderkey) as jira_refs from orders")
def _(c):
    return _episodes(c.orders)


def _claim_notes(c: Catalog) -> DataFrame:
    """Episode notes written out of events, a claim each."""
    claim = "---\nnode_id: pulse-%s-e%s\nclaims:\n- subject: user-%s\n  aspect: %s\n  value: '%s'\n  aspect_kind: %s\n  grounded_node: cust-%s\n- no mapping\n- subject: nobody\n---\n"
    text = F.format_string(claim, F.date_format("ts", "yyyy-MM-dd"), "event_id", "user_id", "event_type", F.round("value").cast("int"), F.when(F.col("event_type") == "purchase", "commitment").otherwise("bogus"), "user_id")
    return c.events.select(F.col("event_id").alias("scan_ord"), F.concat(F.lit("NEXUS/pulse/e-"), "event_id", F.lit(".md")).alias("rel_path"), text.alias("text"))


@query("claims_from_notes", """with x as (select event_id, concat('pulse-', strftime(ts, '%Y-%m-%d'), '-e', event_id) as episode, concat('user-', user_id) as subject, event_type as aspect, cast(cast(round(value) as int) as varchar) as value, user_id, cast(ts as date) as d from events)
select event_id * 1000000 as ord, concat('claim-', episode, '-', substring(sha1(concat_ws('|', subject, aspect, value, episode)), 1, 8)) as id, subject, aspect, value, 'neutral' as polarity, case when aspect = 'purchase' then 'commitment' else 'state' end as aspect_kind, 'text' as value_type, concat('cust-', user_id) as grounded_node, episode, d as valid_at from x""")
def _(c):
    claims = C.normalise(N.claims(N.parse(_claim_notes(c))))
    return claims.select("ord", "id", "subject", "aspect", "value", "polarity", "aspect_kind", "value_type", "grounded_node", "episode", "valid_at")


@query("lint_notes", """with n as (select c_custkey as k, concat('NEXUS/c-', c_custkey, '.md') as rel_path, lower(c_mktsegment) as nexus from customer)
select 'ERROR' as severity, rel_path, 'missing-key' as rule, x as detail from n, unnest(['node_type', 'kind', 'owner', 'ttl_days', 'ripeness']) u(x)
union all select 'ERROR', rel_path, 'unknown-nexus', upper(nexus) from n where nexus <> 'building'
union all select 'ERROR', rel_path, 'dangling-edge', concat('serves kr-', c_nationkey) from n join customer on c_custkey = k
union all select 'ERROR', rel_path, 'dangling-edge', concat('mentions ', x, k) from n, unnest(['PRJ-', 'a-']) u(x)""")
def _(c):
    return Q.lint_notes(N.parse(_notes(c)), c.spark.createDataFrame([("BUILDING",)], "slug string"), TODAY)


@query("promote_edges", f"with {_QUEUE} select src, 'SERVES' as etype, dst, '0.5' as confidence from queue where status = 'approved' and src in (select node_id from kg_nodes) and dst in (select node_id from kg_nodes where node_type = 'key-result')", "kg_nodes")
def _(c):
    return Q.promoted_edges(_queue(c).withColumn("confidence", F.lit(None).cast("double")), c.kg_nodes)


@query("minted_goals", "select concat('kr-', n_regionkey + 1, '-', n_nationkey) as node_id, 'key-result' as node_type, n_name as title from nation union all select distinct concat('obj-q-', n_regionkey + 1), 'objective', concat('Objective ', n_regionkey + 1) from nation")
def _(c):
    k = F.col("n_nationkey")
    number = F.concat((F.col("n_regionkey") + 1).cast("string"), F.lit("."), k)
    goals = c.nation.select(number.alias("goal"), F.col("n_name").alias("title"), (F.col("n_regionkey") + 1).cast("string").alias("objective"))
    return D.minted_goals(goals, TODAY).select("node_id", "node_type", "title")


@query("tumbling_claims", "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def _(c):
    return E.tumbling(c.events).withColumn("start", F.col("start").cast("timestamp_ntz"))
