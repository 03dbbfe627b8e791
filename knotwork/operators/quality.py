"""Gates on nodes and edges: freshness, integrity, ownership, gaps, linting, review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork import vocab
from knotwork.functions import scalars as S
from knotwork.operators import graph


def context_ripeness(nodes: DataFrame, today: str) -> DataFrame:
    """Per nexus: share of nodes with all required fields times the mean freshness weighted by confidence."""
    there = {"sources": F.col("n_sources") > 0}
    complete = F.lit(True)
    for key in vocab.REQUIRED:
        complete = complete & there.get(key, S.present(F.col("n_sources" if key == "sources" else key).cast("string")).isNotNull())
    fresh = S.freshness("updated", "ttl_days", today)
    w = F.when(fresh.isNotNull(), F.coalesce("confidence", F.lit(0.5)))
    grouped = nodes.groupBy(F.coalesce("nexus", F.lit("?")).alias("nexus"))
    ripe = F.avg(complete.cast("double")) * F.coalesce(F.try_divide(F.sum(w * fresh), F.sum(w)), F.lit(0.0))
    return grouped.agg(F.count("*").alias("n_nodes"), F.round(ripe, 3).alias("ripeness"))


def degrees(edges: DataFrame) -> DataFrame:
    """Incidences of each endpoint; a loop counts twice."""
    ends = edges.select(F.col("src").alias("node_id")).unionAll(edges.select("dst"))
    return ends.groupBy("node_id").agg(F.count("*").alias("degree"))


def _reports(nodes: DataFrame):
    """Whether a node has reporting lines, as far as its table tells."""
    out = F.lit(False)
    if "manages" in nodes.columns:
        out = out | F.coalesce(F.size("manages") > 0, F.lit(False))
    if "reports_to" in nodes.columns:
        out = out | S.present("reports_to").isNotNull()
    return out


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches and that have no reporting lines (columns manages, a list, and reports_to, where there are any)."""
    ends = edges.select(F.col("src").alias("node_id")).unionAll(edges.select("dst"))
    return nodes.where(~_reports(nodes)).join(ends, "node_id", "left_anti").select("node_id", "node_type")


def unsourced(nodes: DataFrame) -> DataFrame:
    return nodes.where("n_sources = 0").select("node_id", "nexus")


def broken_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose target, or whose source (but for DELIVERS), is no node; one row for each end."""
    ids = nodes.select("node_id")
    dst = edges.join(ids, edges.dst == ids.node_id, "left_anti").select("src", "dst", "etype", F.lit("dst").alias("missing"))
    src = edges.where("etype <> 'DELIVERS'").join(ids, edges.src == ids.node_id, "left_anti").select("src", "dst", "etype", F.lit("src").alias("missing"))
    return dst.unionAll(src)


def spine_invariants(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, node_id, detail): goals without an owner, spine orphans, goals with several owners."""
    goals = nodes.where("node_type = 'key-result'").select("node_id")
    tops = nodes.where("node_type = 'objective'").select("node_id")
    owns, serves = edges.where("etype = 'OWNS'"), edges.where("etype = 'SERVES'")
    none = F.lit("").alias("detail")
    unowned = goals.join(owns.select(F.col("src").alias("node_id")), "node_id", "left_anti").select(F.lit("no-owner").alias("rule"), "node_id", none)
    orphans = goals.join(serves.select(F.col("src").alias("node_id")), "node_id", "left_anti").unionAll(tops.join(serves.select(F.col("dst").alias("node_id")), "node_id", "left_anti"))
    owners = owns.groupBy(F.col("src").alias("node_id")).agg(F.array_sort(F.collect_set("dst")).alias("o")).where(F.size("o") > 1)
    many = goals.join(owners, "node_id").select(F.lit("many-owners"), "node_id", F.array_join("o", ","))
    return unowned.unionAll(orphans.select(F.lit("spine-orphan"), "node_id", none)).unionAll(many)


def gate(ripeness: DataFrame, broken: DataFrame, invariants: DataFrame, threshold: float = vocab.GATE_FROM) -> DataFrame:
    """One row: whether all conditions hold, the least ripeness, and the reasons that do not."""
    low = ripeness.agg(F.round(F.coalesce(F.min("ripeness"), F.lit(0.0)), 3).alias("ripeness_min"))
    counts = [broken.agg(F.count("*").alias("n_broken"))] + [invariants.agg(F.count_if(F.col("rule") == r).alias(c)) for r, c in (("no-owner", "n_unowned"), ("spine-orphan", "n_orphans"), ("many-owners", "n_contradictions"))]
    row = low.select("ripeness_min", *[c.scalar().alias(c.columns[0]) for c in counts])
    named = [F.when(F.col("ripeness_min") < threshold, "ripeness")] + [F.when(F.col(c) > 0, c) for c in ("n_broken", "n_unowned", "n_orphans", "n_contradictions")]
    reasons = F.filter(F.array(*named), lambda x: x.isNotNull())
    return row.withColumn("reasons", F.array_join(reasons, ",")).withColumn("passed", F.size(reasons) == 0)


def lint(nodes: DataFrame, edges: DataFrame, registry: DataFrame, today: str) -> DataFrame:
    """(severity, rule, node_id) of every issue. registry: slug."""
    err = lambda rule, df: df.select(F.lit("ERROR").alias("severity"), F.lit(rule).alias("rule"), "node_id")
    warn = lambda rule, df: df.select(F.lit("WARN").alias("severity"), F.lit(rule).alias("rule"), "node_id")
    slugs = registry.select(F.col("slug").alias("nexus"))
    ripe = S.ripeness("updated", "ttl_days", today)
    parts = [
        err("duplicate-id", nodes.groupBy("node_id").count().where("count > 1")),
        err("missing-confidence", nodes.where("confidence is null")),
        err("missing-owner", nodes.where(S.present("owner").isNull())),
        err("confidence-range", nodes.where("confidence < 0 or confidence > 1")),
        # Without a registry any nexus will do; none at all is a missing key.
        err("unknown-nexus", nodes.where("nexus is not null").join(slugs, "nexus", "left_anti").join(registry.limit(1).select(F.lit(1).alias("__any")), F.lit(True)).drop("__any")),
        err("bad-node-type", nodes.where(~F.col("node_type").isin(*vocab.NODE_TYPES))),
        err("no-sources", nodes.where("n_sources = 0")),
        warn("wilting", nodes.where(ripe == "wilting")),
        err("dangling-edge", edges.where("etype <> 'DELIVERS'").join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_anti").select(F.col("src").alias("node_id"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def ripeness_classes(nodes: DataFrame, today: str) -> DataFrame:
    return nodes.select("node_id", S.age_days("updated", today).alias("age"), S.ripeness("updated", "ttl_days", today).alias("ripeness"))


def ripeness_drift(nodes: DataFrame, declared: str, today: str) -> DataFrame:
    """Nodes whose declared class is not the computed one."""
    ripe = S.ripeness("updated", "ttl_days", today)
    return nodes.where(ripe.isNotNull() & (F.col(declared) != ripe)).select("node_id", F.col(declared).alias("declared"), ripe.alias("computed"))


def gaps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Isolated nodes, else nodes of the system nexus that serve nothing."""
    # One row for each end: whether it is one and whether it serves.
    ends = edges.select(F.col("src").alias("node_id"), (F.col("etype") == "SERVES").alias("serves")).unionAll(edges.select("dst", F.lit(False)))
    ends = ends.groupBy("node_id").agg(F.bool_or("serves").alias("serves"))
    out = nodes.withColumn("reports", _reports(nodes)).join(ends, "node_id", "left")
    idle = ~F.coalesce("serves", F.lit(False))
    reason = F.when(F.col("serves").isNull() & ~F.col("reports"), "isolated").when((F.col("nexus") == vocab.SYSTEM_NEXUS) & idle, "no-serves")
    return out.select("node_id", F.coalesce(S.present("title"), "node_id").alias("title"), reason.alias("reason")).where("reason is not null")


def value_axis_gaps(nodes: DataFrame, edges: DataFrame, content=None) -> DataFrame:
    """Nodes (those of a predicate, if given) that no value-axis edge touches."""
    axis = edges.where(F.col("etype").isin(*vocab.VALUE_AXIS.values()))
    ends = axis.select(F.col("src").alias("node_id")).unionAll(axis.select("dst"))
    return (nodes if content is None else nodes.where(content)).join(ends, "node_id", "left_anti").select("node_id", "nexus")


def value_axis_eligible(content=None):
    """A predicate: nodes of the value nexuses, and of a further predicate."""
    own = F.col("nexus").isin(*vocab.VALUE_NEXUSES)
    return own if content is None else own & content


def goal_choices(nodes: DataFrame) -> DataFrame:
    return nodes.where("node_type = 'key-result'").select("node_id", F.coalesce(S.present("title"), "node_id").alias("title")).distinct()


def queue_transition(queue: DataFrame, found: DataFrame) -> DataFrame:
    """Next state of a review queue (src, status): new gaps open, open ones without a gap resolve, others stay."""
    both = queue.select("src", "status").join(found.select("src", F.lit(True).alias("gap")), "src", "full_outer")
    status = F.when(F.col("status").isNull(), "open").when((F.col("status") == "open") & F.col("gap").isNull(), "resolved").otherwise(F.col("status"))
    return both.select("src", status.alias("status"))


def promote(queue: DataFrame, nodes: DataFrame) -> DataFrame:
    """Approved rows (src, dst): promoted as SERVES edges if both ends exist and dst is a goal, else skipped."""
    src = nodes.select(F.col("node_id").alias("src"), F.lit(True).alias("has_src"))
    dst = nodes.where("node_type = 'key-result'").select(F.col("node_id").alias("dst"), F.lit(True).alias("has_dst"))
    out = queue.where("status = 'approved'").join(src, "src", "left").join(dst, "dst", "left")
    return out.select("src", "dst", F.when(F.col("has_src") & F.col("has_dst"), "promoted").otherwise("skipped").alias("outcome"))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("etype").agg(F.count("*").alias("n"))


def write_back(edges: DataFrame, nodes: DataFrame, existing: DataFrame | None = None, order: str = "dst") -> DataFrame:
    """Field values that edges give to notes: (node_id, field, values), one row a note and field.

    DELIVERS goes to its target, all others to their source. A field of one value takes the last edge
    in the order of a column of edges. Lists keep what the note has: existing is (node_id, field, value).
    """
    field = F.create_map(*[F.lit(x) for t, (f, _) in vocab.WRITE_BACK.items() for x in (t, f)])[F.col("etype")]
    delivers = F.col("etype") == "DELIVERS"
    rows = edges.select(F.when(delivers, F.col("dst")).otherwise(F.col("src")).alias("node_id"), field.alias("field"), "etype", F.when(delivers, F.col("src")).otherwise(F.col("dst")).alias("value"), F.col(order).alias("ord"))
    single = F.col("etype").isin(*[t for t, (_, s) in vocab.WRITE_BACK.items() if s])
    known = rows.where("field is not null").join(nodes.select("node_id"), "node_id", "left_semi")
    lists = known.where(~single).select("node_id", "field", "value")
    if existing is not None:
        lists = lists.unionByName(existing.select("node_id", "field", "value").join(lists.select("node_id", "field").distinct(), ["node_id", "field"], "left_semi"))
    many = lists.groupBy("node_id", "field").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("values"))
    return many.unionByName(known.where(single).groupBy("node_id", "field").agg(F.max_by("value", "ord").alias("values")))


def lint_notes(parsed: DataFrame, registry: DataFrame, today: str) -> DataFrame:
    """(severity, rel_path, rule, detail) of every issue of parsed notes (rel_path, fields, status).

    registry: slug; without rows any nexus will do. Notes without a block are no nodes; of notes that
    share an id the first by path has it. Lists come as JSON. Notes are parsed once: they are kept.
    """
    parsed = graph.kept(parsed.select("rel_path", "fields", "status"))
    f = lambda k: F.try_element_at("fields", F.lit(k))
    as_list = lambda k: F.when(f(k).startswith("["), F.from_json(f(k), "array<string>")).when(f(k).isNotNull(), F.array(f(k)))
    stem = F.regexp_replace(F.element_at(F.split("rel_path", "/"), -1), r"\.md$", "")
    rows = parsed.where("status = 'ok'")
    ids = rows.select("rel_path", f("node_id").alias("node_id")).where(S.present("node_id").isNotNull())
    firsts = ids.groupBy("node_id").agg(F.min("rel_path").alias("first"))
    known = registry.agg(F.collect_set("slug")).scalar()
    number = f("confidence").try_cast("double")
    ripe = S.ripeness(S.as_date(F.substring(f("updated"), 1, 10)), f("ttl_days").try_cast("int"), today)
    declared = F.col("declared")
    issue = lambda when, severity, rule, detail: F.when(when, F.struct(F.lit(severity).alias("severity") if isinstance(severity, str) else severity.alias("severity"), F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))
    held = rows.select("rel_path", "fields", f("ripeness").alias("declared"), ripe.alias("computed"), known.alias("known"), stem.isin(*vocab.INDEX_STEMS).alias("index"))
    sources = F.coalesce(F.size(as_list("sources")), F.lit(0)) == 0
    checks = [issue(~F.array_contains(F.map_keys("fields"), k), "ERROR", "missing-key", F.lit(k)) for k in vocab.REQUIRED] + [
        issue((F.size("known") > 0) & ~F.array_contains("known", f("nexus")), "ERROR", "unknown-nexus", f("nexus")),
        issue(~f("node_type").isin(*vocab.NODE_TYPES), "ERROR", "bad-node-type", f("node_type")),
        issue(~f("kind").isin(*vocab.KINDS), "ERROR", "bad-kind", f("kind")),
        issue(f("confidence").isNotNull() & (number.isNull() | (number < 0) | (number > 1)), "ERROR", "bad-confidence", f("confidence")),
        issue(declared.isNotNull() & ~declared.isin(*vocab.RIPENESS), "ERROR", "bad-ripeness", declared),
        issue(sources, F.when(F.col("index"), "WARN").otherwise("ERROR"), "no-sources", F.lit("")),
        issue(F.col("computed") != declared, "WARN", "ripeness-drift", F.col("computed")),
        issue(F.col("computed") == "wilting", "WARN", "wilting", F.lit("")),
    ]
    own = held.select("rel_path", F.explode(F.array_compact(F.array(*checks))).alias("i")).select("i.severity", "rel_path", "i.rule", "i.detail")
    broken = parsed.where("status = 'error'").select(F.lit("ERROR").alias("severity"), "rel_path", F.lit("unreadable").alias("rule"), F.lit("").alias("detail"))
    twice = ids.join(firsts, "node_id").where("rel_path <> first").select(F.lit("ERROR"), "rel_path", F.lit("duplicate-id"), "node_id")
    fields = [k for k in (*vocab.SINGLE_FIELDS, *vocab.LIST_FIELDS) if k != "delivered_by"]
    targets = rows.select("rel_path", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.coalesce(as_list(k), F.array().cast("array<string>")).alias("to")) for k in fields])).alias("x"))
    targets = targets.select("rel_path", "x.field", F.explode("x.to").alias("node_id")).where(S.present("node_id").isNotNull())
    loose = targets.join(firsts, "node_id", "left_anti").select(F.lit("ERROR"), "rel_path", F.lit("dangling-edge"), F.concat_ws(" ", "field", "node_id"))
    return own.unionAll(broken).unionAll(twice).unionAll(loose)


def lint_failed(issues: DataFrame) -> DataFrame:
    """One row: errors, warnings and the exit code."""
    return issues.agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARN").alias("warnings")).withColumn("exit_code", F.when(F.col("errors") > 0, 1).otherwise(0))


def promoted_edges(queue: DataFrame, nodes: DataFrame) -> DataFrame:
    """SERVES edges of approved rows (src, dst, confidence) that `promote` accepts; without a confidence one half."""
    ok = promote(queue, nodes).where("outcome = 'promoted'").select("src", "dst").distinct()
    own = queue.where("status = 'approved'").join(ok, ["src", "dst"], "left_semi")
    return own.select("src", F.lit("SERVES").alias("etype"), "dst", F.coalesce(F.col("confidence").cast("string"), F.lit("0.5")).alias("confidence"))
