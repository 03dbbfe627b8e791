"""Line deduplication within one edit, by a deletion-neighbourhood join in DataFrame operations.

A line goes if an earlier line of the corpus is equal to it or one edit (a code point inserted,
deleted or replaced) away, the edit being no more than a share 1 - `SIMILARITY` of the longer line:
so it takes five code points, as one edit leaves four less alike than that. Earlier is by document id, then place of the row, then place in the text. Lines of white space
alone always stay.

Texts are written once, in buckets of a row number, and all but those buckets moves hashes: equal
lines meet by hash, so that only distinct lines are compared. Two lines of lengths L and L or L + 1
that are one edit apart agree in one half: before the middle of L or after it. So a line takes part
only where another distinct line shares that half (a loss-free filter), and its variants need cover
the other half only:

- a replaced code point: the half without it, keyed by its place. All lines that share this key are
  one edit apart from each other.
- a deleted one: the longer line's half without it, against the shorter line's half as it is.

So each key needs no more than the earliest line of each kind: no pairs are listed. What shares a key
is confirmed by the edit distance of the two texts. The distinct lines that share a key are at most
as many as there are code points (times places), whatever the size of the corpus. Halves are counted
by a partial aggregation and then joined, which Spark can split, so a half that a third of all lines
share is no task's burden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm import store

SIMILARITY = 0.8


def _one_edit(longer: Column) -> Column:
    """Whether one edit is small enough for a line of so many code points."""
    return 1 - 1 / longer >= SIMILARITY - 1e-9


def _halves(line: Column) -> Column:
    """Four structs of a line, for each class L (its length or one less) and side: half (a hash of what may agree), rest (the other half) and longer."""
    n = F.length(line)
    out = []
    for longer in (0, 1):
        size = n - longer  # the class
        half = F.floor(size / 2).cast("int")
        keep = size - half
        before = (F.lit(0), F.substring(line, F.lit(1), half), F.substring(line, half + 1, n))
        after = (F.lit(1), F.substring(line, n - keep + 1, keep), F.substring(line, F.lit(1), n - keep))
        for side, same, rest in (before, after):
            out.append(F.struct(F.xxhash64(size, side, same).alias("half"), rest.alias("rest"), F.lit(bool(longer)).alias("longer")))
    return F.array(*out)


def _distinct(texts: DataFrame) -> DataFrame:
    """Distinct lines with content: hashes, first place and the hashes of their halves."""
    lines = texts.where("text is not null").select("ord", "no", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.where(F.col("line").rlike(r"\S")).select("ord", "no", "line_no", F.explode(F.array(F.struct("line", _halves(F.col("line")).alias("x")))).alias("y"))
    line = F.col("y.line")
    halves = F.when(_one_edit(F.length(line) + 1), F.col("y.x.half")).alias("halves")
    hashed = lines.select(F.struct("ord", "no", "line_no").alias("at"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), halves)
    return hashed.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.first("halves").alias("halves"))


def _candidates(distinct: DataFrame, texts: DataFrame) -> DataFrame:
    """(h1, h2, at, line, halves) of lines that share a half with another: the halves that they share."""
    entries = distinct.where("halves is not null").select("h1", F.posexplode("halves").alias("k", "half"))
    # A shared half needs a line that is not the longer one in it: two longer ones meet in their own class.
    shared = entries.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.min("k").alias("k")).where("lo <> hi and k < 2").select("half")
    chosen = entries.join(shared, "half", "left_semi").groupBy("h1").agg(F.collect_set("half").alias("chosen"))
    found = distinct.select("h1", "h2", "at").join(chosen, "h1")
    # The texts of these lines, by document.
    by_row = found.groupBy(F.col("at.no").alias("no")).agg(F.collect_list(F.struct("h1", "h2", "at", "chosen")).alias("own"))
    lines = texts.select("no", "text").join(by_row, "no").select(F.explode(F.arrays_zip(F.transform("own", lambda x: x), F.expr("transform(own, x -> get(split(text, '\n'), x.at.line_no))").alias("line"))).alias("z"))
    return lines.select("z.0.h1", "z.0.h2", "z.0.at", "z.line", "z.0.chosen")


def _near(candidates: DataFrame) -> DataFrame:
    """(h1, h2) of lines with the earliest line, of another text, found one edit away: (e1, e2)."""
    edits = _one_edit(F.length("line")).alias("edits")
    some = candidates.select("h1", "h2", "at", "chosen", edits, F.explode(_halves(F.col("line"))).alias("x")).where(F.array_contains("chosen", F.col("x.half")))
    some = some.select("h1", "h2", "at", "edits", "x.*").where("edits or not longer")
    n = F.length("rest")
    # Places of the edit: each code point for a replacement or a deletion; -1 for the line as it is, which may be a longer one's.
    last = F.when(F.col("edits"), n - 1).otherwise(F.lit(-1))
    some = some.withColumn("place", F.explode(F.when(F.col("longer"), F.sequence(F.lit(0), n - 1)).otherwise(F.sequence(F.lit(-1), last))))
    left = F.substring("rest", F.lit(1), F.col("place"))
    right = F.substring("rest", F.col("place") + 2, n)
    replaced = F.xxhash64("half", F.lit("r"), "place", left, right)
    deleted = F.xxhash64("half", F.lit("d"), F.concat(left, right))
    whole = F.xxhash64("half", F.lit("d"), "rest")
    key = F.when(F.col("longer"), deleted).when(F.col("place") < 0, whole).otherwise(replaced)
    kind = F.when(F.col("longer"), 1).when(F.col("place") < 0, 2).otherwise(0)
    variants = some.select(key.alias("key"), kind.cast("byte").alias("kind"), "h1", "h2", "at")
    who = F.struct("at", "h1", "h2")
    w = Window.partitionBy("key")
    least = {k: F.min(F.when(F.col("kind") == k, who)).over(w) for k in (0, 1, 2)}
    met = F.when(F.col("kind") == 0, least[0]).when(F.col("kind") == 1, least[2]).otherwise(least[1])
    pairs = variants.withColumn("met", met).where(F.col("met.at") < F.col("at"))
    return pairs.groupBy("h1", "h2").agg(F.min("met").alias("met")).select("h1", "h2", F.col("met.h1").alias("e1"), F.col("met.h2").alias("e2"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: str = "") -> DataFrame:
    """All rows with their text without duplicate lines, and n_lines, n_kept (lines with content).

    Null texts stay null, empty and blank ones stay as they are (n_lines 0). A row that loses all its
    content has n_kept 0. Rows that repeat an id, or id and text, are rows of their own in the order of
    the table: a repeated text loses all its lines with content. Null ids come last in order. Very long
    texts and lines are read whole. n_lines and n_kept replace columns of those names; all other names
    are free. An empty table gives no rows.
    """
    names = [c for c in df.columns if c not in ("n_lines", "n_kept")]
    columns = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(names) if c != text_col], F.lit(True).alias("row")).alias("columns")
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("ord")
    texts = store.bucketed(df.select(order, F.monotonically_increasing_id().alias("no"), F.col(text_col).alias("text"), columns), "no", "line-texts", scope)
    distinct = store.written(_distinct(texts), "distinct-lines", scope)
    candidates = store.written(_candidates(distinct, texts), "line-candidates", scope, compression="zstd")
    near = _near(candidates)
    own = candidates.select("h1", "h2", F.col("line").alias("own"))
    other = candidates.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("line").alias("other"))
    # Only lines in which a partner was found are brought together with their texts.
    longer = F.greatest(F.length("own"), F.length("other"))
    close = (F.levenshtein("own", "other", 1) >= 0) & _one_edit(longer)
    confirmed = near.join(own, ["h1", "h2"]).join(other, ["e1", "e2"]).where(close).select("h1", "h2")
    kept = distinct.select("h1", "h2", "at").join(confirmed, ["h1", "h2"], "left_anti")
    kept = kept.groupBy(F.col("at.no").alias("no")).agg(F.collect_set("at.line_no").alias("kept"))
    cut = texts.join(kept, "no", "left").withColumn("lines", F.explode_outer(F.array(F.split("text", "\n"))))
    content = lambda x: x.rlike(r"\S")
    stays = F.filter("lines", lambda x, k: ~content(x) | F.coalesce(F.array_contains("kept", k), F.lit(False)))
    text = F.when(F.col("text").isNotNull(), F.array_join(stays, "\n")).alias(text_col)
    place = {c: f"columns.c{k}" for k, c in enumerate(names)}
    return cut.select(
        *[text if c == text_col else F.col(place[c]).alias(c) for c in names],
        F.coalesce(F.size(F.filter("lines", content)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("kept"), F.lit(0)).cast("long").alias("n_kept"),
    )
