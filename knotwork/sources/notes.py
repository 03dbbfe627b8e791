"""Markdown notes with YAML frontmatter, goal tables and episode summaries as DataFrames."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The keys of episode summaries (other vaults pass their own names), and the patterns of a block, of links and of tickets.
EPISODE_KEYS = {"date": "дата", "source": "источник", "participants": "участники", "links": "nexus_links"}
FRONT = r"(?s)\A---\r?\n(.*?)\r?\n---\s*(?:\r?\n|\z)(.*)"


def scan(spark: SparkSession, root: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """(path, rel_path, text) of all Markdown files below a folder, ordered by path parts.

    The folder is listed here and the files are read by the tasks: Spark's own file sources leave out
    names that begin with an underscore.
    """
    found = []
    for folder, _, names in os.walk(root):
        found += [os.path.join(folder, n) for n in names if n.endswith(".md") and n not in skip]
    found.sort(key=lambda p: os.path.relpath(p, root).split(os.sep))
    rows = [(k, p, os.path.relpath(p, root).replace(os.sep, "/")) for k, p in enumerate(found)]
    paths = spark.createDataFrame(rows, "scan_ord long, path string, rel_path string")

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            texts = []
            for p in batch.column(1).to_pylist():
                with open(p, encoding="utf-8", errors="replace") as f:
                    texts.append(f.read())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return paths.mapInArrow(read, "scan_ord long, path string, rel_path string, text string")


def front(text: Column) -> Column:
    return F.regexp_extract(text, FRONT, 1)


def body(text: Column) -> Column:
    return F.when(text.rlike(FRONT), F.regexp_extract(text, FRONT, 2)).otherwise(text)


def loader():
    """A function that reads a YAML block: by libyaml where it is there; what that refuses or may read otherwise is left to the loader in Python."""
    odd = re.compile("[?\\t\\x85\\u2028\\u2029\\ufeff]")

    # A function of its own here, as tasks may lack this package.
    def load(block: str):
        import yaml

        if yaml.__with_libyaml__ and not odd.search(block):
            try:
                return yaml.load(block, yaml.CSafeLoader)
            except (yaml.YAMLError, ValueError):
                pass
        return yaml.safe_load(block)

    return load


def parse(notes: DataFrame) -> DataFrame:
    """Adds fields (a map of strings, lists as JSON), body and status (ok, none, error) to (.., text).

    Notes are dealt over all cores first: a small file holds many of them, and each costs Python time.
    """
    columns, place, load = notes.columns, notes.columns.index("text"), loader()

    def run(batches):
        import json

        import pyarrow as pa
        import yaml

        for batch in batches:
            fields, bodies, status = [], [], []
            for text in batch.column(place).to_pylist():
                m = re.match(r"\A---\r?\n(.*?)\r?\n---\s*(?:\r?\n|\Z)(.*)", text or "", re.S)
                value, kind, rest = {}, "none", text or ""
                if m:
                    try:
                        loaded = load(m[1])
                        value, kind, rest = (loaded, "ok", m[2]) if isinstance(loaded, dict) else ({}, "error", text)
                    except yaml.YAMLError:
                        kind = "error"
                fields.append([(str(k), json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, (list, dict)) else str(v)) for k, v in value.items() if v is not None])
                bodies.append(rest)
                status.append(kind)
            made = [pa.array(fields, pa.map_(pa.string(), pa.string())), pa.array(bodies, pa.string()), pa.array(status, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "fields", "body", "status"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in notes.dtypes)
    dealt = notes.repartition(4 * notes.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, f"{kinds}, fields map<string,string>, body string, status string").select(*columns, "fields", "body", "status")


def nodes(parsed: DataFrame) -> DataFrame:
    """Projected node columns of notes with an id; of equal ids the last in scan order stays."""
    from pyspark.sql import Window

    f = lambda k: F.try_element_at("fields", F.lit(k))
    as_list = lambda k: F.when(f(k).isNull(), F.array().cast("array<string>")).when(f(k).startswith("["), F.from_json(f(k), "array<string>")).otherwise(F.array(f(k)))
    rows = parsed.where(F.nullif(f("node_id"), F.lit("")).isNotNull())
    out = rows.select(
        "scan_ord", "rel_path",
        f("node_id").alias("node_id"), f("node_type").alias("node_type"), f("nexus").alias("nexus"), f("title").alias("title"), f("full_name").alias("full_name"), f("kind").alias("kind"), f("owner").alias("owner"), f("reports_to").alias("reports_to"),
        f("confidence").try_cast("double").alias("confidence"), F.try_to_date(F.substring(f("updated"), 1, 10), "yyyy-MM-dd").alias("updated"),
        f("ttl_days").try_cast("int").alias("ttl_days"), F.size(as_list("sources")).alias("n_sources"), f("ripeness").alias("ripeness"),
        *[as_list(k).alias(k) for k in ("serves", "delivered_by", "mentions", "involves", "realizes", "based_on", "depends_on", "addresses", "satisfies", "has_need", "manages")],
    )
    w = Window.partitionBy("node_id").orderBy(F.col("scan_ord").desc())
    return out.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def semantic_edges(node_rows: DataFrame) -> DataFrame:
    """Edges (src, etype, dst) of the semantic fields; deliveries run from epic to goal."""
    from knotwork import vocab

    fields = F.array(*[F.struct(F.lit(t).alias("etype"), F.col(f).alias("dst")) for f, t in vocab.SEMANTIC.items()])
    flat = node_rows.select("node_id", F.explode(fields).alias("x")).select(F.col("node_id").alias("src"), "x.etype", F.explode("x.dst").alias("dst"))
    turned = F.col("etype") == "DELIVERS"
    return flat.select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"), "etype", F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst")).distinct()


def goal_table(lines: DataFrame) -> DataFrame:
    """(goal, title, epic, objective) of pipe-table rows `| number | title | .. EPIC-1 .. |`."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    number, epic = F.get("c", F.lit(0)), F.regexp_extract(F.get("c", F.lit(2)), r"[A-Z]{2,}-\d+", 0)
    rows = lines.where(F.trim("line").startswith("|")).select(cells.alias("c")).where((F.size("c") >= 3) & number.rlike(r"^\d+(\.\d+)*"))
    return rows.select(number.alias("goal"), F.get("c", F.lit(1)).alias("title"), F.nullif(epic, F.lit("")).alias("epic"), F.split_part(number, F.lit("."), F.lit(1)).alias("objective"))


CLAIM = "struct<subject:string,aspect:string,value:string,polarity:string,speaker:string,speaker_role:string,aspect_kind:string,value_type:string,value_norm:string,grounded_node:string,confidence:double,invalid_at:string,expired_at:string,superseded_by:string>"


def claims(parsed: DataFrame, folder: str = "pulse/") -> DataFrame:
    """Claims of notes below a folder, one row each, as `operators.claims.normalise` takes them.

    ord follows the notes' order and the place in the note; valid_at is the date in the episode's id.
    Entries that are no mapping are left out.
    """
    from knotwork.functions import scalars as S

    f = lambda k: F.try_element_at("fields", F.lit(k))
    rows = parsed.where((F.col("rel_path").startswith(folder) | F.col("rel_path").contains("/" + folder)) & F.nullif(f("node_id"), F.lit("")).isNotNull() & f("claims").startswith("["))
    flat = rows.select("scan_ord", f("node_id").alias("episode"), F.posexplode(F.from_json(f("claims"), "array<string>")).alias("place", "raw")).where(F.col("raw").startswith("{"))
    flat = flat.select("scan_ord", "episode", "place", F.from_json("raw", CLAIM).alias("c")).where("c is not null")
    day = lambda c: S.as_date(F.substring(F.col(c), 1, 10))
    kept = ["subject", "aspect", "value", "polarity", "speaker", "speaker_role", "aspect_kind", "value_type", "value_norm", "grounded_node", "confidence", "superseded_by"]
    return flat.select((F.col("scan_ord") * 1_000_000 + F.col("place")).alias("ord"), "episode", *[F.col(f"c.{k}").alias(k) for k in kept], S.as_date(S.episode_date("episode")).alias("valid_at"), day("c.invalid_at").alias("invalid_at"), day("c.expired_at").alias("expired_at"))


def claims_of(parsed: DataFrame) -> DataFrame:
    """Claims of a vault, wherever its notes lie."""
    return claims(parsed, "")


def wikilinks(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)"), F.lit(1)), lambda x: F.trim(x)))


def tickets(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2,}-\d+)\b"), F.lit(1)))


def episodes(parsed: DataFrame, keys: dict[str, str] | None = None) -> DataFrame:
    """episode_id, date, participants, nexus_refs, jira_refs of summaries that have a date."""
    keys = keys or EPISODE_KEYS
    f = lambda k: F.try_element_at("fields", F.lit(keys[k]))
    as_list = lambda c: F.when(c.isNull(), F.array().cast("array<string>")).when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""))
    stem = F.regexp_replace(F.element_at(F.split("rel_path", "/"), -1), r"\.md$", "")
    everything = F.concat_ws(" ", F.array_join(F.map_values("fields"), " "), "body")
    return parsed.where(f("date").isNotNull()).select(
        F.concat(F.lit("pulse-"), stem).alias("episode_id"),
        F.substring(f("date"), 1, 10).alias("date"),
        as_list(f("participants")).alias("participants"),
        F.array_distinct(F.concat(as_list(f("links")), wikilinks(F.col("body")))).alias("nexus_refs"),
        tickets(everything).alias("jira_refs"),
    )
