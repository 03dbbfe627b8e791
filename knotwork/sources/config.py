"""Small files that steer a vault: registry, vocabulary, policy, review queue and configuration.

Each is one YAML file of a few kilobytes by its nature, read here and turned into a DataFrame.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession


def _yaml(path: str):
    import yaml

    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def _rows(data, key: str) -> list[dict]:
    """The mappings of a list under a key; whatever else is there is left out."""
    found = (data or {}).get(key) if isinstance(data, dict) else None
    return [x for x in found or [] if isinstance(x, dict)]


def registry(spark: SparkSession, ground: str) -> DataFrame:
    """(slug, source, name, owner, purpose) of the registered nexuses."""
    rows = _rows(_yaml(os.path.join(ground, "NEXUS", "_registry.yaml")), "nexus_types")
    keys = ("slug", "source", "name", "owner", "purpose")
    return spark.createDataFrame([tuple(None if r.get(k) is None else str(r[k]) for k in keys) for r in rows if r.get("slug")], ", ".join(f"{k} string" for k in keys))


def vocabulary_path(root: str) -> str:
    """The vocabulary's place by the vault: below the nearest folder GROUND at or above the root, else below the root."""
    root = os.path.abspath(root)
    parts = root.split(os.sep)
    for k in range(len(parts), 0, -1):
        if parts[k - 1] == "GROUND":
            return os.path.join(os.sep.join(parts[:k]), "_index", "aspect-vocab.yaml")
    return os.path.join(root, "GROUND", "_index", "aspect-vocab.yaml")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(canonical, synonyms)."""
    rows = [(str(r["canonical"]), sorted({str(s) for s in r.get("synonyms") or []})) for r in _rows(_yaml(path), "aspects") if r.get("canonical")]
    return spark.createDataFrame(list(dict(rows).items()), "canonical string, synonyms array<string>")


def policy(spark: SparkSession, path: str) -> DataFrame:
    """(role, aspect_kind): what a role may assert; a role without kinds has a row with null."""
    roles = {str(r["role"]).strip().lower(): [str(a) for a in r.get("may_assert") or []] for r in _rows(_yaml(path), "authority") if r.get("role")}
    return spark.createDataFrame([(role, kind) for role, kinds in roles.items() for kind in kinds or [None]], "role string, aspect_kind string")


QUEUE = "src string, reason string, title string, dst string, confidence double, rationale string, status string"


def queue(spark: SparkSession, path: str) -> DataFrame:
    """The review queue, with defaults for what a row lacks."""
    text = lambda r, k, other="": str(r.get(k, other))
    rows = [x for x in _yaml(path) or [] if isinstance(x, dict)]
    made = [(str(r["src"]), text(r, "reason"), text(r, "title"), str(r["dst"]) if r.get("dst") else None, float(r["confidence"]) if r.get("confidence") is not None else None, text(r, "rationale"), text(r, "status", "open")) for r in rows]
    return spark.createDataFrame(made, QUEUE)


def problems(ground: str) -> list[str]:
    """What is wrong with configuration and registry; nothing for a sound vault."""
    path = os.path.join(ground, "config.yaml")
    config = _yaml(path)
    if config is None and not os.path.exists(path):
        return [f"missing {path}"]
    config = config or {}
    out = []
    product = str((config.get("product") or {}).get("slug", ""))
    if not re.fullmatch(r"[a-z0-9][a-z0-9-]*", product):
        out.append(f"product slug {product!r} is no slug")
    if not ((config.get("team") or {}).get("roster") or {}).get("product_engineer"):
        out.append("the roster lacks a product engineer")
    for r in _rows(_yaml(os.path.join(ground, "NEXUS", "_registry.yaml")), "nexus_types"):
        slug = str(r.get("slug", ""))
        if not re.fullmatch(r"[a-z][a-z0-9-]*", slug):
            out.append(f"nexus slug {slug!r} is no slug")
        if r.get("source") not in ("default", "custom"):
            out.append(f"the source of nexus {slug!r} is neither default nor custom")
    return out
