"""Edges derived from the fields of nodes: owners, goal spine, value axis, episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork import vocab
from knotwork.functions import scalars as S


def person_index(nodes: DataFrame) -> DataFrame:
    """(key, person) for name keys that one person has; the id stands in for names of one word.

    The name is full_name; tables that have none give the title as such.
    """
    persons = nodes.where("node_type = 'person'")
    fallback = F.replace(F.regexp_replace("node_id", f"^{vocab.TEAM}", ""), F.lit("-"), F.lit(" "))
    name = "full_name" if "full_name" in nodes.columns else "title"
    keyed = persons.select(F.coalesce(S.name_key(name), S.name_key(fallback)).alias("key"), "node_id").where("key is not null")
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node_id").alias("person")).where("n = 1").select("key", "person")


def resolve_owners(nodes: DataFrame) -> DataFrame:
    """node_id, owner, person (null: unresolved) of every node with an owner."""
    owned = nodes.where(S.present("owner").isNotNull()).select("node_id", "owner", S.name_key("owner").alias("key"))
    return owned.join(person_index(nodes), "key", "left").select("node_id", "owner", "person")


def resolve_people(names: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """Adds person: by the first two words of a name, else by them swapped."""
    index = person_index(nodes)
    keyed = names.withColumn("__key", S.name_key(S.without_remark(name))).withColumn("__back", S.swapped("__key"))
    direct = index.select(F.col("key").alias("__key"), F.col("person").alias("__direct"))
    back = index.select(F.col("key").alias("__back"), F.col("person").alias("__swapped"))
    out = keyed.join(direct, "__key", "left").join(back, "__back", "left")
    return out.withColumn("person", F.coalesce("__direct", "__swapped")).drop("__key", "__back", "__direct", "__swapped")


def edge_rows(df: DataFrame, etype, src, dst, confidence) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(lit(etype).alias("etype"), lit(src).alias("src"), lit(dst).alias("dst"), lit(confidence).alias("confidence"))


def derive_spine(nodes: DataFrame, goals: DataFrame) -> DataFrame:
    """OWNS of resolved owners, SERVES of each goal once, DELIVERS of each row with an epic.

    goals: goal, objective, epic (null: none).
    """
    owns = edge_rows(resolve_owners(nodes).where("person is not null"), "OWNS", F.col("node_id"), F.col("person"), "high")
    serves = edge_rows(goals.groupBy("goal").agg(F.min("objective").alias("objective")), "SERVES", F.col("goal"), F.col("objective"), "high")
    delivers = edge_rows(goals.where(S.present("epic").isNotNull()), "DELIVERS", F.col("epic"), F.col("goal"), "high")
    return owns.unionByName(serves).unionByName(delivers)


def check_refs(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References (src, field, ref) with their edge type and whether the target is a node."""
    types = F.create_map(*[F.lit(x) for pair in vocab.VALUE_AXIS.items() for x in pair])
    ids = nodes.select(F.col("node_id").alias("ref"), F.lit(True).alias("found")).distinct()
    return refs.select("src", "field", "ref", types[F.col("field")].alias("etype")).join(ids, "ref", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def value_edges(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    return check_refs(refs, nodes).where("found").select("etype", "src", F.col("ref").alias("dst"))


def dangling(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    return check_refs(refs, nodes).where("not found").select("src", "field", "ref")


def ground_refs(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Grounds references (episode_id, plane, ref): target, trust and resolved are added.

    A reference that is a node is trusted highly on either plane; another ticket becomes a task of
    medium trust; another note is not resolved.
    """
    ids = nodes.select(F.col("node_id").alias("ref"), F.lit(True).alias("hit")).distinct()
    out = refs.join(ids, "ref", "left")
    hit = F.coalesce("hit", F.lit(False))
    ticket = F.col("plane") == "jira"
    return out.select(
        "episode_id",
        "ref",
        F.when(hit, "nexus").otherwise(F.col("plane")).alias("plane"),
        F.when(hit, F.col("ref")).when(ticket, F.concat(F.lit(vocab.TASK), "ref")).alias("target"),
        F.when(hit, "high").when(ticket, "medium").alias("trust"),
        (hit | ticket).alias("resolved"),
    )


def second_chance(refs: DataFrame, nodes: DataFrame, episodes: DataFrame) -> DataFrame:
    """References that were not grounded (episode_id, ref), with the episode that their text is the stem of as target, or null: dangling."""
    left = ground_refs(refs, nodes).where("not resolved").select("episode_id", "ref")
    stems = episodes.select(F.substring("episode_id", len(vocab.EPISODE) + 1, 1 << 20).alias("ref"), F.col("episode_id").alias("target")).distinct()
    return left.join(stems, "ref", "left").select("episode_id", "ref", "target")


def template(node_id, node_type: str, nexus: str, title, source, updated, confidence: float, owner: str = "") -> Column:
    """The projected fields of a node that is made here, as a struct."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        lit(node_id).alias("node_id"), lit(node_type).alias("node_type"), lit(nexus).alias("nexus"), lit(title).alias("title"), lit(owner).alias("owner"),
        F.lit("empirical").alias("kind"), F.lit(confidence).alias("confidence"), F.array(lit(source)).alias("sources"), lit(updated).cast("date").alias("updated"),
        F.lit(90).alias("ttl_days"), F.lit("fresh").alias("ripeness"),
    )


def minted_goals(goals: DataFrame, today: str, quarter: str = "q", source: str = "okr:kr-epic-map", owner: str = "") -> DataFrame:
    """Nodes of the goals and objectives of a goal table (goal, title, objective, and ord where the order counts): first title wins."""
    first = F.min(F.struct(*(["ord"] if "ord" in goals.columns else []), "title")).alias("f")
    kr = goals.groupBy("goal").agg(first).select(template(S.goal_id("goal"), "key-result", "okr", F.col("f.title"), source, today, 0.4, owner).alias("n")).select("n.*")
    top = goals.select("objective").distinct().select(template(S.objective_id("objective", quarter), "objective", "okr", F.concat(F.lit("Objective "), "objective"), source, today, 0.4, owner).alias("n")).select("n.*")
    return kr.unionByName(top)


def minted_episodes(episodes: DataFrame, refs: DataFrame, nodes: DataFrame, today: str, owner: str = "") -> DataFrame:
    """Nodes of episodes (episode_id, date, source) and of the tickets that they mention and no node is (episode_id, plane, ref)."""
    own = episodes.select(template(F.col("episode_id"), "episode", "pulse", F.col("episode_id"), F.col("source"), F.col("date"), 0.5, owner).alias("n")).select("n.*")
    tasks = ground_refs(refs, nodes).where("plane = 'jira'").select("ref").distinct()
    made = tasks.select(template(F.concat(F.lit(vocab.TASK), "ref"), "task", "jira", F.col("ref"), F.concat(F.lit("JIRA:"), "ref"), today, 0.5, owner).alias("n")).select("n.*")
    return own.unionByName(made)


def unresolved_owners(nodes: DataFrame) -> DataFrame:
    """(node_id, owner) of owners that are no one person."""
    return resolve_owners(nodes).where("person is null").select("node_id", "owner")


def pipeline(nodes: DataFrame, goals: DataFrame, episodes: DataFrame, refs: DataFrame, participants: DataFrame, value_refs: DataFrame, today: str, quarter: str = "q", owner: str = "") -> dict[str, DataFrame]:
    """All that is derived from a vault: new nodes, edges and the queues of what could not be resolved.

    goals: goal, title, objective, epic of the goal table. episodes: episode_id, date, source. refs:
    episode_id, plane, ref. participants: episode_id, participant. value_refs: src, field, ref.
    """
    new = minted_goals(goals, today, quarter, owner=owner).unionByName(minted_episodes(episodes, refs, nodes, today, owner))
    new = new.join(nodes.select("node_id").distinct(), "node_id", "left_anti").select(*new.columns)
    owned = nodes.select("node_id", "node_type", "title", "owner").unionByName(new.select("node_id", "node_type", "title", "owner"))
    by_id = goals.select(S.goal_id("goal").alias("goal"), S.objective_id("objective", quarter).alias("objective"), "epic")
    people = resolve_people(participants, nodes, "participant")
    chance = second_chance(refs, nodes, episodes)
    grounded = ground_refs(refs, nodes).where("resolved")
    edges = derive_spine(owned, by_id).unionByName(edge_rows(value_edges(value_refs, nodes), F.col("etype"), F.col("src"), F.col("dst"), "high"))
    edges = edges.unionByName(edge_rows(grounded, "MENTIONS", F.col("episode_id"), F.col("target"), F.col("trust")))
    edges = edges.unionByName(edge_rows(chance.where("target is not null"), "MENTIONS", F.col("episode_id"), F.col("target"), "high"))
    edges = edges.unionByName(edge_rows(people.where("person is not null"), "involves", F.col("episode_id"), F.col("person"), "high"))
    missing = chance.where("target is null").select(F.col("episode_id").alias("src"), "ref").unionByName(dangling(value_refs, nodes).select("src", "ref"))
    return {
        "new_nodes": new,
        "edges": edges.distinct(),
        "unresolved_owners": unresolved_owners(owned),
        "unresolved_participants": people.where("person is null").select("episode_id", "participant"),
        "dangling": missing,
    }


def episode_edges(episodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """MENTIONS of grounded references and involves of resolved participants."""
    planes = F.explode(F.array(F.struct(F.lit("nexus").alias("plane"), F.col("nexus_ref").alias("ref")), F.struct(F.lit("jira").alias("plane"), F.col("jira_ref").alias("ref")))).alias("x")
    grounded = ground_refs(episodes.select("episode_id", planes).select("episode_id", "x.*"), nodes).where("resolved")
    mentions = edge_rows(grounded, "MENTIONS", F.col("episode_id"), F.col("target"), F.col("trust"))
    people = resolve_people(episodes.select("episode_id", "participant"), nodes, "participant").where("person is not null")
    second = edge_rows(second_chance(episodes.select("episode_id", planes).select("episode_id", "x.*"), nodes, episodes).where("target is not null"), "MENTIONS", F.col("episode_id"), F.col("target"), "high")
    return mentions.unionByName(second).unionByName(edge_rows(people, "involves", F.col("episode_id"), F.col("person"), "high")).distinct()
