"""Sinks: tables, note files, review queues and reports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions import scalars as S

# The order of the keys of a note.
KEY_ORDER = ("nexus", "node_id", "node_type", "title", "kind", "owner", "confidence", "sources", "updated", "ttl_days", "ripeness")


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    out = df.write.mode("overwrite")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)


def write_risks(risks: DataFrame, path: str, drop_first: bool = True, sources: tuple[str, ...] = ()) -> None:
    """Risks by source: a source's rows are replaced (those of the sources named, by default of the rows), or only missing ids are added."""
    spark = risks.sparkSession
    out = risks
    if "id" not in out.columns:
        evidence = F.col("evidence") if "evidence" in out.columns else F.array("ref")
        out = out.withColumn("id", S.risk_id("axis", evidence, "goals"))
    out = out.withColumn("goals", F.array_join("goals", " | ")).dropDuplicates(["source", "id"])
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
    if drop_first:
        # An empty set replaces the rows of its source too: the sources are named by the caller.
        gone = sources or [r["source"] for r in out.select("source").distinct().toLocalIterator()]
        for name in gone:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/source={name}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        out.write.mode("append").partitionBy("source").parquet(path)
        return
    if there:
        out = out.join(spark.read.schema(out.schema).parquet(path).select("id", "source"), ["id", "source"], "left_anti")
    out.write.mode("append").partitionBy("source").parquet(path)


def render_note(fields: dict, footer: str = "") -> str:
    """A note with its frontmatter in canonical key order."""
    import yaml

    ordered = {k: fields[k] for k in (*KEY_ORDER, *sorted(set(fields) - set(KEY_ORDER))) if k in fields}
    return "---\n" + yaml.safe_dump(ordered, allow_unicode=True, sort_keys=False) + "---\n" + footer


def upsert_field(text: str, key: str, value) -> str:
    """The note with a field set; the whole block is written anew. Without a block it is unchanged."""
    import re

    import yaml

    m = re.match(r"\A---\r?\n(.*?)\r?\n---\s*(?:\r?\n|\Z)(.*)", text, re.S)
    if not m:
        return text
    fields = yaml.safe_load(m[1]) or {}
    if not isinstance(fields, dict):
        return text
    fields[key] = value
    return "---\n" + yaml.safe_dump(fields, allow_unicode=True, sort_keys=False) + "---\n" + m[2]


def write_notes(notes: DataFrame, folder: str) -> int:
    """Writes (node_id, text) as files where there is none; the folder is shared by all tasks. Returns how many.

    A file is written under a name of the attempt and then linked to its own, which fails if that is
    there: no reader sees half a file, and a task that runs again changes nothing.
    """

    def run(batches):
        import uuid

        import pyarrow as pa

        for batch in batches:
            done = 0
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = os.path.join(folder, f"{node}.md")
                own = os.path.join(folder, f".{uuid.uuid4().hex}")
                with open(own, "w", encoding="utf-8") as f:
                    f.write(text)
                try:
                    os.link(own, path)
                    done += 1
                except FileExistsError:
                    pass
                os.unlink(own)
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

    os.makedirs(folder, exist_ok=True)
    return notes.select("node_id", "text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def _write_yaml(data, path: str) -> None:
    import yaml

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(data, f, allow_unicode=True, sort_keys=False)


def write_queue(queue: DataFrame, path: str) -> None:
    """A review queue, for people to read, by src."""
    _write_yaml([r.asDict() for r in queue.orderBy("src").toLocalIterator()], path)


def write_risk_queue(routed: DataFrame, path: str) -> None:
    """Risks that people have to look at, by bucket; verified ones are left out."""
    buckets = {k: [r.asDict(recursive=True) for r in routed.where(F.col("bucket") == k).drop("bucket").toLocalIterator()] for k in ("review", "unlinkable")}
    _write_yaml(buckets, path)


def write_gate(gate: DataFrame, path: str, today: str) -> dict:
    """The state of the gate as YAML; returns it."""
    row = gate.first()
    state = {"ready": row["passed"], "ripeness_min": row["ripeness_min"], "reasons": [x for x in row["reasons"].split(",") if x], "checked": today}
    _write_yaml(state, path)
    return state


def register_nexus(path: str, slug: str, name: str, purpose: str, owner: str = "") -> bool:
    """Adds a nexus to a registry file that lacks it; returns whether it did."""
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    known = data.setdefault("nexus_types", [])
    if any(isinstance(x, dict) and x.get("slug") == slug for x in known):
        return False
    known.append({"slug": slug, "source": "custom", "owner": owner, "onboarded": "partial", "name": name, "purpose": purpose})
    _write_yaml(data, path)
    return True


def report(counts: dict[str, int], ripeness: list[tuple[str, float]], queue: list[str], threshold: float = 0.6, head: int = 50) -> str:
    """A Markdown report of counts, ripeness with a mark under the threshold, and the head of a queue."""
    lines = ["# Graph report", ""] + [f"- {k}: {v}" for k, v in counts.items()]
    lines += ["", "| nexus | ripeness |", "|-|-|"] + [f"| {n} | {r:.3f}{' !' if r < threshold else ''} |" for n, r in sorted(ripeness, key=lambda x: (x[1], x[0]))]
    lines += ["", f"## Queue ({len(queue)})"] + [f"- {q}" for q in queue[:head]]
    return "\n".join(lines) + "\n"
