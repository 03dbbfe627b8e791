"""Bitemporal edges: as-of filters and mechanical supersession."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork import vocab
from knotwork.functions import scalars as S


def as_of(edges: DataFrame, t: str | None, types: tuple[str, ...] | None = None) -> DataFrame:
    """Edges of the semantic types that are active at t (null: now)."""
    kinds = types or tuple(vocab.SEMANTIC.values())
    return edges.where(F.col("etype").isin(*kinds) & S.active_at("valid_at", "invalid_at", "expired_at", t))


def supersede(stored: DataFrame, asserted: DataFrame, at: str) -> DataFrame:
    """The next state of stored edges (src, etype, dst, valid_at, invalid_at).

    Active semantic edges that are not asserted any more end at `at`; asserted ones that had ended are
    active again; new ones begin; edges of other types stay.
    """
    key = ["src", "etype", "dst"]
    now = asserted.where(F.col("etype").isin(*vocab.SEMANTIC.values())).select(*key, F.col("valid_at").alias("new_valid")).groupBy(*key).agg(F.min("new_valid").alias("new_valid")).withColumn("asserted", F.lit(True))
    both = stored.select(*key, "valid_at", "invalid_at", F.lit(True).alias("known")).join(now, key, "full_outer")
    semantic = F.col("etype").isin(*vocab.SEMANTIC.values())
    ended = F.when(F.col("asserted"), F.lit(None)).when(semantic & F.col("invalid_at").isNull(), F.lit(at).cast("date")).otherwise(F.col("invalid_at"))
    began = F.when(F.col("known"), F.col("valid_at")).otherwise(F.coalesce("new_valid", F.lit(at).cast("date")))
    return both.select(*key, began.alias("valid_at"), ended.alias("invalid_at"))
