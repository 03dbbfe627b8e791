"""A thin command line over a vault of notes: report, gaps, gate, lint, promote, build, graph."""

from __future__ import annotations

import argparse
import datetime as dt
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork import sinks
from knotwork.operators import graph, quality
from knotwork.session import session
from knotwork.sources import config, notes


def load(spark, root: str) -> tuple[DataFrame, DataFrame]:
    rows = notes.nodes(notes.parse(notes.scan(spark, root)))
    return rows, notes.semantic_edges(rows)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="knotwork")
    parser.add_argument("command", choices=["report", "gaps", "gate", "build", "graph", "lint", "promote"])
    parser.add_argument("--vault", default=os.environ.get("KNOTWORK_VAULT", "."))
    parser.add_argument("--warehouse", default="warehouse")
    parser.add_argument("--today", default=dt.date.today().isoformat())
    parser.add_argument("--ground", default="GROUND")
    parser.add_argument("--queue", default="queue.yaml")
    args = parser.parse_args(argv)
    spark = session()
    nodes, edges = load(spark, args.vault)
    ripe = quality.context_ripeness(nodes, args.today)
    if args.command == "report":
        counts = {r["etype"]: r["n"] for r in quality.edge_counts(edges).collect()}
        queue = [r["node_id"] for r in quality.isolated(nodes, edges).orderBy("node_id").limit(50).collect()]
        print(sinks.report(counts, [(r["nexus"], r["ripeness"]) for r in ripe.collect()], queue))
    elif args.command == "gaps":
        quality.gaps(nodes, edges).orderBy("node_id").show(50, truncate=False)
    elif args.command == "lint":
        issues = quality.lint_notes(notes.parse(notes.scan(spark, args.vault, ("_template.md",))), config.registry(spark, args.ground), args.today)
        for r in issues.orderBy("severity", "rel_path", "rule", "detail").toLocalIterator():
            print(f"{r['severity']}: {r['rel_path']}: {r['rule']} {r['detail'] or ''}".rstrip())
        wrong = config.problems(args.ground)
        print("\n".join(wrong))
        return 1 if wrong else quality.lint_failed(issues).first()["exit_code"]
    elif args.command == "promote":
        queue = config.queue(spark, args.queue)
        sinks.write_table(quality.promoted_edges(queue, nodes), f"{args.warehouse}/promoted")
        done = quality.promote(queue, nodes).where("outcome = 'promoted'").select("src", "dst").distinct().withColumn("ok", F.lit(True))
        state = queue.join(done, ["src", "dst"], "left").withColumn("status", F.when(F.col("ok") & (F.col("status") == "approved"), "promoted").otherwise(F.col("status")))
        sinks.write_queue(state.select(*queue.columns), args.queue)
    elif args.command == "gate":
        broken = quality.broken_ends(nodes, edges)
        row = quality.gate(ripe, broken, quality.spine_invariants(nodes, edges)).first()
        print({k: row[k] for k in row.asDict()})
        return 0 if row["passed"] else 1
    else:
        sinks.write_table(nodes, f"{args.warehouse}/nodes", "nexus")
        sinks.write_table(edges, f"{args.warehouse}/edges", "etype")
        if args.command == "graph":
            labels = graph.label_propagation(edges)
            sinks.write_table(labels, f"{args.warehouse}/communities")
            print({"nodes": nodes.count(), "edges": edges.count(), "communities": labels.agg(F.countDistinct("community")).first()[0]})
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
