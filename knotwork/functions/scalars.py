"""Scalar functions and predicates of the model, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from knotwork import vocab


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def present(x) -> Column:
    """The string, or null where it is empty: missing either way."""
    return F.nullif(_c(x), F.lit(""))


def active_at(valid_at, invalid_at, expired_at, t) -> Column:
    """Bitemporal as-of test: not expired, begun by t and not yet ended at t; without t: not ended."""
    at = F.lit(t).cast("date") if t is not None else None
    now = _c(invalid_at).isNull() if at is None else F.coalesce(_c(valid_at) <= at, F.lit(True)) & F.coalesce(_c(invalid_at) > at, F.lit(True))
    return _c(expired_at).isNull() & now


def resolved(*marks) -> Column:
    """Whether any mark of an ended claim is set."""
    out = F.lit(False)
    for m in marks:
        out = out | present(_c(m).cast("string")).isNotNull()
    return out


def claim_id(subject, aspect, value, episode) -> Column:
    body = F.concat_ws("|", _c(subject), _c(aspect), _c(value), _c(episode))
    return F.concat(F.lit("claim-"), _c(episode), F.lit("-"), F.substring(F.sha1(body), 1, 8))


def risk_id(axis, evidence, affected) -> Column:
    body = F.concat_ws("|", _c(axis), F.array_join(_c(evidence), " "), F.array_join(_c(affected), ","))
    return F.concat(F.lit("risk-"), _c(axis), F.lit("-"), F.substring(F.sha1(body), 1, 8))


def goal_id(number) -> Column:
    return F.concat(F.lit(vocab.GOAL), F.replace(_c(number), F.lit("."), F.lit("-")))


def objective_id(number, quarter: str) -> Column:
    return F.concat(F.lit(f"{vocab.OBJECTIVE}{quarter}-"), _c(number))


def name_key(name) -> Column:
    """The first two words of a name, lower case, joined by a space; null for fewer."""
    words = F.split(F.trim(F.replace(_c(name), F.lit('"'), F.lit(""))), r"(?U)\s+")
    return F.when(F.size(words) >= 2, F.lower(F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1)))))


def swapped(key) -> Column:
    return F.concat_ws(" ", F.split_part(_c(key), F.lit(" "), F.lit(2)), F.split_part(_c(key), F.lit(" "), F.lit(1)))


def without_remark(name) -> Column:
    """A name without a remark in round brackets at its end."""
    return F.trim(F.regexp_replace(_c(name), r"(?U)\s*\([^)]*\)\s*$", ""))


def as_date(x) -> Column:
    """A strict ISO date or null."""
    return F.to_date(F.when(F.trim(_c(x)).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.trim(_c(x)), "yyyy-MM-dd")))


def age_days(updated, today: str) -> Column:
    return F.datediff(F.lit(today).cast("date"), _c(updated))


def clamp(x) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def freshness(updated, ttl, today: str) -> Column:
    """1 at the update, 0 at the end of its time to live; null where that is not set."""
    return F.when(_c(ttl) > 0, clamp(1 - age_days(updated, today) / _c(ttl)))


def ripeness(updated, ttl, today: str) -> Column:
    share = F.when(_c(ttl) > 0, age_days(updated, today) / _c(ttl))
    return F.when(share < 0.5, "fresh").when(share < 1, "ripening").when(share.isNotNull(), "wilting")


def episode_date(node_id) -> Column:
    return present(F.regexp_extract(_c(node_id), r"^pulse-(.{4}-.{5})", 1))


def severity(reach, conflicting, grounding) -> Column:
    """Weighted sum of reach (0 to 1), conflicting claims and missing grounding (null: one half)."""
    raw = F.least(F.lit(1.0), 0.5 * reach + 0.3 * F.least(conflicting / 3, F.lit(1.0)) + 0.2 * (1 - F.coalesce(grounding, F.lit(0.5))))
    # Nine places first: binary noise must not decide a tie at the third.
    return F.round(F.round(raw, 9), 3)


def similarity(distance) -> Column:
    """Cosine similarity of unit vectors from their squared distance."""
    return F.greatest(F.lit(0.0), 1 - distance / 2)


def one_of(x, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(_c(x).isin(*allowed), _c(x)).otherwise(F.lit(default))


def is_content(node_type, stem) -> Column:
    return ~F.coalesce(_c(node_type) == vocab.CONTENT_OVERVIEW, F.lit(False)) & ~_c(stem).startswith("_")
