"""Reports over graph and claims: rollups, coverage, snapshots, comprehension, risks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork import vocab
from knotwork.functions import scalars as S
from knotwork.operators import claims as C


def rollup(nodes: DataFrame, edges: DataFrame, claims: DataFrame) -> DataFrame:
    """One row of counts."""
    node_ids = nodes.select("node_id").distinct()
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    c = claims.join(node_ids.withColumnRenamed("node_id", "grounded_node").withColumn("there", F.lit(True)), "grounded_node", "left")
    counted = c.agg(
        F.count("*").alias("claims"),
        F.count_if("there").alias("grounded"),
        F.count_if(F.col("there").isNull()).alias("ungrounded"),
        F.count_if(S.present("superseded_by").isNotNull()).alias("superseded"),
    )
    isolated = node_ids.join(edges.select(F.col("src").alias("node_id")).unionAll(edges.select("dst")), "node_id", "left_anti")
    number = lambda df, name: df.agg(F.count("*").alias(name)).scalar().alias(name)
    return counted.select(number(node_ids, "nodes"), number(edges, "edges"), number(pairs, "pairs"), number(isolated, "isolated"), "*")


def goal_coverage(edges: DataFrame, goals: DataFrame) -> DataFrame:
    """Goals with the number of episodes two hops away over mention and serve edges."""
    serve = edges.where("etype = 'SERVES'").select(F.col("src").alias("item"), F.col("dst").alias("goal"))
    mention = edges.where("etype = 'MENTIONS'").select(F.col("src").alias("episode"), F.col("dst").alias("item"))
    n = serve.join(mention, "item").groupBy("goal").agg(F.countDistinct("episode").alias("episodes"))
    return goals.select(F.col("node_id").alias("goal")).join(n, "goal", "left").select("goal", F.coalesce("episodes", F.lit(0)).alias("episodes"))


def about_goals(claims: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Claims about an entity that delivers or serves a goal."""
    kinds = edges.where("etype in ('SERVES', 'DELIVERS')").select(F.col("src").alias("node_id"), F.col("dst").alias("goal"), "etype")
    goals = nodes.where("node_type = 'key-result'").select(F.col("node_id").alias("goal"))
    return C.about(claims, nodes).join(kinds, "node_id").join(goals, "goal", "left_semi").select("ord", "node_id", "etype", "goal")


def diff_nodes(base: DataFrame, new: DataFrame) -> DataFrame:
    """New and lost ids (change, node_id)."""
    a, b = base.select("node_id").distinct(), new.select("node_id").distinct()
    return b.join(a, "node_id", "left_anti").select(F.lit("new").alias("change"), "node_id").unionAll(a.join(b, "node_id", "left_anti").select(F.lit("lost"), "node_id"))


def diff_edges(base_nodes: DataFrame, base: DataFrame, new: DataFrame) -> DataFrame:
    """New edges as connecting (one end is old), internal (no end is) or existing (both are)."""
    key = ["src", "etype", "dst"]
    added = new.select(*key).distinct().join(base.select(*key).distinct(), key, "left_anti")
    old = base_nodes.select("node_id").distinct().withColumn("old", F.lit(1))
    src = old.select(F.col("node_id").alias("src"), F.col("old").alias("old_src"))
    dst = old.select(F.col("node_id").alias("dst"), F.col("old").alias("old_dst"))
    n = F.coalesce("old_src", F.lit(0)) + F.coalesce("old_dst", F.lit(0))
    return added.join(src, "src", "left").join(dst, "dst", "left").select(*key, F.when(n == 1, "connecting").when(n == 0, "internal").otherwise("existing").alias("kind"))


def goal_delta(base: DataFrame, new: DataFrame) -> DataFrame:
    """Episodes gained and lost by each goal (goal, episode tables)."""
    marked = base.select("goal", "episode", F.lit(1).alias("was"), F.lit(0).alias("now")).unionAll(new.select("goal", "episode", F.lit(0), F.lit(1)))
    each = marked.groupBy("goal", "episode").agg(F.max("was").alias("was"), F.max("now").alias("now"))
    return each.groupBy("goal").agg(F.count_if(F.expr("now > was")).alias("gained"), F.count_if(F.expr("was > now")).alias("lost"))


def contexts(nodes: DataFrame, edges: DataFrame, contradicted: DataFrame) -> DataFrame:
    """Nodes with their sorted typed neighbours and flags. contradicted: node_id."""
    both = edges.select("src", "etype", "dst").unionAll(edges.select(F.col("dst").alias("src"), "etype", F.col("src").alias("dst")))
    near = both.groupBy(F.col("src").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "etype", "dst"))), ",").alias("neighbours"))
    bad = contradicted.select("node_id").distinct().withColumn("in_contradiction", F.lit(True))
    out = nodes.join(near, "node_id", "left").join(bad, "node_id", "left")
    return out.select("node_id", F.coalesce("neighbours", F.lit("")).alias("neighbours"), F.col("neighbours").isNull().alias("isolated"), (F.col("n_sources") == 0).alias("unsourced"), F.coalesce("in_contradiction", F.lit(False)).alias("in_contradiction"))


def reflexion(context_count: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Share of understood verdicts over contexts (0 without any)."""
    total = context_count.agg(F.count("*").alias("n")).scalar()
    counted = verdicts.agg(F.count_if("understood").alias("understood"), F.count_if(~F.col("understood")).alias("not_understood"))
    return counted.select(total.alias("contexts"), "understood", "not_understood", F.round(F.coalesce(F.try_divide(F.col("understood"), total), F.lit(0.0)), 6).alias("share"))


def risks(gap_nodes: DataFrame, pairs: DataFrame, claims: DataFrame, reach: DataFrame, goals: DataFrame, schedule: str) -> DataFrame:
    """Risks of three sources on four axes: (axis, node, n, grounding, reach, severity, goals).

    gap_nodes: node_id. pairs: a, b of contradictory claims. claims: normalised. reach: node_id,
    percentile. goals: node_id, goals. schedule: a pattern of aspects that are about dates.
    """
    gap = gap_nodes.select(F.lit(vocab.RISK_AXES[0]).alias("axis"), F.col("node_id").alias("node"), F.lit(1).alias("n"), F.lit(None).cast("double").alias("grounding"), F.lit("").alias("ref"))
    conf = claims.select("ord", "grounded_node", "confidence")
    a = pairs.join(conf.select(F.col("ord").alias("a"), F.col("grounded_node").alias("node"), F.col("confidence").alias("ca")), "a")
    both = a.join(conf.select(F.col("ord").alias("b"), F.col("confidence").alias("cb")), "b")
    mean = F.try_divide(F.coalesce("ca", F.lit(0.0)) + F.coalesce("cb", F.lit(0.0)), F.col("ca").isNotNull().cast("int") + F.col("cb").isNotNull().cast("int"))
    split = both.select(F.lit(vocab.RISK_AXES[1]), "node", F.lit(2), mean, F.concat_ws("-", "a", "b"))
    ended = claims.where(S.resolved("superseded_by", "invalid_at", "expired_at") & S.present("grounded_node").isNotNull())
    axis = F.when(F.lower(F.concat_ws(" ", "aspect", "value")).rlike(schedule), vocab.RISK_AXES[2]).otherwise(vocab.RISK_AXES[3])
    done = ended.select(axis, F.col("grounded_node"), F.lit(1), F.col("confidence"), F.col("ord").cast("string"))
    every = gap.unionAll(split).unionAll(done)
    placed = every.join(reach.withColumnRenamed("node_id", "node"), "node", "left").join(goals.withColumnRenamed("node_id", "node"), "node", "left")
    share = F.coalesce("percentile", F.lit(0.0))
    return placed.select("axis", "node", "ref", "n", "grounding", S.severity(share, F.col("n"), F.col("grounding")).alias("severity"), F.coalesce("goals", F.array().cast("array<string>")).alias("goals"))


def route(risk_rows: DataFrame, review_from: float = vocab.REVIEW_FROM) -> DataFrame:
    """Adds bucket: verified with a goal, else review from a severity on, else unlinkable."""
    return risk_rows.withColumn("bucket", F.when(F.size("goals") > 0, "verified").when(F.col("severity") >= review_from, "review").otherwise("unlinkable"))


def affects(risk_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """AFFECTS edges (src: risk id, etype, dst) to the goals of a risk that exist. risk_rows: id, goals."""
    ends = risk_rows.select(F.col("id").alias("src"), F.lit("AFFECTS").alias("etype"), F.explode("goals").alias("dst"))
    return ends.join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src", "etype", "dst").distinct()


def built_risks(calls: DataFrame, reach: DataFrame, goals: DataFrame) -> DataFrame:
    """Risks that were classified elsewhere (axis, node, evidence, participants, confidence), completed and checked.

    An unknown axis or no evidence stops the query. Without a node the confidence is the severity.
    reach: node_id, percentile. goals: node_id, goals.
    """
    axis = F.when(F.col("axis").isin(*vocab.RISK_AXES), F.col("axis")).otherwise(F.raise_error(F.concat(F.lit("unknown axis: "), F.coalesce("axis", F.lit("null")))))
    evidence = F.when(F.coalesce(F.size("evidence"), F.lit(0)) > 0, F.col("evidence")).otherwise(F.raise_error(F.lit("a risk needs evidence")))
    rows = calls.withColumn("node", S.present("node")).join(reach.withColumnRenamed("node_id", "node"), "node", "left").join(goals.withColumnRenamed("node_id", "node"), "node", "left")
    grounded = S.severity(F.coalesce("percentile", F.lit(0.0)), F.lit(1), F.col("confidence"))
    alone = F.round(F.least(F.lit(1.0), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))), 3)
    empty = F.array().cast("array<string>")
    out = rows.select(axis.alias("axis"), "node", evidence.alias("evidence"), F.coalesce("participants", empty).alias("participants"), "confidence", F.when(F.col("node").isNull(), alone).otherwise(grounded).alias("severity"), F.coalesce("goals", empty).alias("goals"))
    return out.withColumn("id", S.risk_id("axis", "evidence", "goals"))


def snapshot(nodes: DataFrame, edges: DataFrame, claims: DataFrame, communities: DataFrame, folder: str) -> None:
    """Write what `diff` compares: nodes, semantic edges, claims and communities, below a folder."""
    parts = {"nodes": nodes.select("node_id").distinct(), "edges": edges.where(F.col("etype").isin(*vocab.SEMANTIC.values())).select("src", "etype", "dst").distinct(), "claims": claims, "communities": communities}
    for name, part in parts.items():
        part.write.mode("overwrite").parquet(f"{folder}/{name}")


def diff_claims(base: DataFrame, new: DataFrame) -> DataFrame:
    """(change, id): claims that are new, and those ended since. Claims as `claims.normalise` gives them."""
    ended = S.resolved("superseded_by", "invalid_at", "expired_at")
    old = base.groupBy("id").agg(F.bool_or(ended).alias("was_ended"))
    rows = new.groupBy("id").agg(F.bool_or(ended).alias("ended")).join(old, "id", "left")
    kinds = F.array_compact(F.array(F.when(F.col("was_ended").isNull(), F.lit("new")), F.when(F.col("ended") & ~F.coalesce("was_ended", F.lit(False)), F.lit("superseded"))))
    return rows.select(F.explode(kinds).alias("change"), "id")


def new_contradictions(base: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs (a, b) of contradictory claims of which one is new."""
    fresh = new.join(base.select("id"), "id", "left_anti").select("ord")
    pairs = C.contradictions(new).select("a", "b")
    return pairs.join(fresh, pairs.a == fresh.ord, "left_semi").unionByName(pairs.join(fresh, pairs.b == fresh.ord, "left_semi")).distinct()


def touched_communities(new_nodes: DataFrame, connecting: DataFrame, communities: DataFrame) -> DataFrame:
    """Communities (node, community) that a new node (node_id) or an end of a connecting edge (src, dst) is in."""
    ends = new_nodes.select(F.col("node_id").alias("node")).unionAll(connecting.select("src")).unionAll(connecting.select("dst"))
    return communities.join(ends.distinct(), "node", "left_semi").select("community").distinct()
