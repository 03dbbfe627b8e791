"""Claims: normalisation, contradictions, shifts of plans, authority, grounding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork import vocab
from knotwork.functions import scalars as S


def normalise(claims: DataFrame) -> DataFrame:
    """Drops claims without subject, aspect or value; fills enumerations; two contradictory end marks cancel out."""
    ok = S.present("subject").isNotNull() & S.present("aspect").isNotNull() & S.present("value").isNotNull()
    both = F.col("invalid_at").isNotNull() & F.col("expired_at").isNotNull()
    return claims.where(ok).select(
        "ord",
        S.claim_id("subject", "aspect", "value", "episode").alias("id"),
        "subject",
        "aspect",
        "value",
        F.coalesce(S.present("polarity"), F.lit("neutral")).alias("polarity"),
        "speaker",
        "speaker_role",
        S.one_of("aspect_kind", vocab.ASPECT_KINDS, "state").alias("aspect_kind"),
        S.one_of("value_type", vocab.VALUE_TYPES, "text").alias("value_type"),
        "value_norm",
        "grounded_node",
        "confidence",
        "episode",
        "valid_at",
        F.when(~both, F.col("invalid_at")).alias("invalid_at"),
        F.when(~both, F.col("expired_at")).alias("expired_at"),
        "superseded_by",
    )


def unresolved(claims: DataFrame) -> DataFrame:
    return claims.where(~S.resolved("superseded_by", "invalid_at", "expired_at"))


def contradictions(claims: DataFrame) -> DataFrame:
    """(a, b) of unresolved grounded claims on one aspect of one subject that differ in polarity or value, in input order.

    Only distinct (polarity, value) classes can differ, so a key on which all agree makes no pairs.
    """
    key = ["grounded_node", "subject", "aspect"]
    open_ = unresolved(claims).where(S.present("grounded_node").isNotNull()).select(*key, "ord", "polarity", "value")
    mixed = open_.groupBy(*key).agg(F.min(F.struct("polarity", "value")).alias("lo"), F.max(F.struct("polarity", "value")).alias("hi")).where("lo <> hi").select(*key)
    some = open_.join(mixed, key, "left_semi")
    a = some.select(*key, *[F.col(c).alias(f"a_{c}") for c in ("ord", "polarity", "value")])
    b = some.select(*key, *[F.col(c).alias(f"b_{c}") for c in ("ord", "polarity", "value")])
    pairs = a.join(b, key).where("a_ord < b_ord and (a_polarity <> b_polarity or a_value <> b_value)")
    return pairs.select(*key, F.col("a_ord").alias("a"), F.col("b_ord").alias("b"))


def plan_shifts(claims: DataFrame) -> DataFrame:
    """Commitments whose normalised value differs from the one before it on the same subject and aspect."""
    w = Window.partitionBy("subject", "aspect").orderBy(F.col("valid_at").asc_nulls_last(), "ord")
    own = claims.where("aspect_kind = 'commitment' and value_norm is not null")
    prev = F.lag(F.struct("value_norm", "valid_at", "speaker", "speaker_role")).over(w)
    out = own.withColumn("prev", prev).where("prev.value_norm <> value_norm")
    return out.select(
        "subject", "aspect",
        F.col("prev.value_norm").alias("from_value"), F.col("value_norm").alias("to_value"),
        F.col("prev.valid_at").alias("from_at"), F.col("valid_at").alias("to_at"),
        F.col("prev.speaker").alias("from_speaker"), F.col("speaker").alias("to_speaker"),
        F.col("prev.speaker_role").alias("from_role"), F.col("speaker_role").alias("to_role"), "ord",
    )


def authority(claims: DataFrame, policy: DataFrame) -> DataFrame:
    """Adds authoritative: null for roles the policy (role, aspect_kind) does not know. The policy is small by nature; Spark sizes the join."""
    roles = policy.select(F.lower(F.trim("role")).alias("speaker_role")).distinct().withColumn("known", F.lit(True))
    may = policy.select(F.lower(F.trim("role")).alias("speaker_role"), "aspect_kind").distinct().withColumn("may", F.lit(True))
    rows = claims.withColumn("speaker_role", F.lower(F.trim("speaker_role")))
    out = rows.join(roles, "speaker_role", "left").join(may, ["speaker_role", "aspect_kind"], "left")
    return out.withColumn("authoritative", F.when(F.col("known"), F.coalesce("may", F.lit(False)))).drop("known", "may")


def off_vocabulary(claims: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Aspects that are no canonical name; synonyms are off too."""
    return claims.select("aspect").distinct().join(vocabulary.select(F.col("canonical").alias("aspect")), "aspect", "left_anti")


def about(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """ABOUT edges (claim ord, node) of claims whose node exists."""
    return claims.select("ord", "episode", F.col("grounded_node").alias("node_id")).join(nodes.select("node_id").distinct(), "node_id", "left_semi")


def superseded_by(claims: DataFrame) -> DataFrame:
    """(src, dst, exists): whether the claim named as successor is there."""
    ids = claims.select(F.col("id").alias("dst"), F.lit(True).alias("there")).distinct()
    rows = claims.where(S.present("superseded_by").isNotNull()).select(F.col("id").alias("src"), F.col("superseded_by").alias("dst"))
    return rows.join(ids, "dst", "left").select("src", "dst", F.coalesce("there", F.lit(False)).alias("exists"))
