"""Classes of texts by the exact Jaccard similarity of their word shingles.

Candidates come from elsewhere (`simhash.similar_classes`), as groups of sets of which any two may be
similar; the module still has the name of the MinHash that found them once. Every pair of a group is
verified on its whole sets, so nothing below the similarity links.

Only sets that have a candidate are read again. A group is dealt into parts by hash and each pair of
parts is one cell, a task's unit of bounded size; every pair of the group meets in a cell. A cell gives
a star for each of its components rather than pairs.

A group of more than `PAIRED` parts is compared within parts first; then one set of each component with
those of other parts; then all that is outside the largest component with the whole group, as pairs of
parts. So every pair that is not joined yet meets in a cell, and a group of near copies that get joined
costs in proportion to its size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm import store
from knotwork.llm.components import components

SIMILARITY = 0.8
#: Sets and shingles of one part of a group, about.
PART_SETS, PART_SHINGLES = 512, 1 << 20
#: Parts of a group of which all pairs are compared at once.
PAIRED = 16
#: Shingles hashed at a time of one text.
STEP = 1 << 15


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 of a text's word shingles (ASCII lower case, ASCII white space); one of all words if they are fewer."""
    from xxhash import xxh64_intdigest

    w = text.encode().lower().split() if text else []
    if len(w) < words:
        return np.array([xxh64_intdigest(b" ".join(w))] if w else [], dtype=np.uint64)
    n, parts = len(w) - words + 1, []
    for k in range(0, n, STEP):
        some = w[k : min(n, k + STEP) + words - 1]
        parts.append(np.array([xxh64_intdigest(s) for s in map(b" ".join, zip(*(some[j:] for j in range(words))))], dtype=np.uint64))
    return np.unique(np.concatenate(parts))


def name_of(shingles: np.ndarray) -> int:
    """A hash of the whole set; zero for an empty one."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(shingles.tobytes()) if len(shingles) else 0


def as_longs(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def stars(flat: np.ndarray, edges: np.ndarray, similarity: float):
    """(member, hub) numbers of the components of sets, given end to end with their edges."""
    sizes = np.diff(edges)
    n = len(sizes)
    if n == 2:
        common = len(np.intersect1d(flat[: edges[1]], flat[edges[1] :], assume_unique=True))
        return [(1, 0)] if common * (1 + similarity) >= similarity * len(flat) - 1e-9 else []
    order = np.argsort(flat, kind="stable")
    owner, ranked = np.repeat(np.arange(n), sizes)[order], flat[order]
    first, last = np.searchsorted(ranked, flat, "left"), np.searchsorted(ranked, flat, "right")
    waiting, out = np.ones(n, dtype=bool), []
    for hub in range(n):
        frontier = [hub] if waiting[hub] else []
        waiting[hub] = False
        while frontier:
            x = frontier.pop()
            s, e = first[edges[x] : edges[x + 1]], last[edges[x] : edges[x + 1]]
            runs = e - s
            places = np.arange(runs.sum()) + np.repeat(s - np.cumsum(runs) + runs, runs)
            common = np.bincount(owner[places], minlength=n)
            near = np.flatnonzero(waiting & (common * (1 + similarity) >= similarity * (sizes + sizes[x]) - 1e-9))
            waiting[near] = False
            frontier += near.tolist()
            out += [(k, hub) for k in near.tolist()]
    return out


def _cell_links(similarity: float):
    """Reads cells sorted by (key, i, j) and gives links a, b."""

    def links_of(table, starts):
        import pyarrow as pa

        sets = table.column("sh").combine_chunks()
        fps, flat, edges = table.column("fp").to_numpy(), sets.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
        found = [(s + a, s + b) for s, e in zip(starts[:-1], starts[1:]) if e - s > 1 for a, b in stars(flat[edges[s] : edges[e]], edges[s : e + 1] - edges[s], similarity)]
        at = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(fps[at[:, 0]]), pa.array(fps[at[:, 1]])], ["a", "b"])

    def run(batches):
        import pyarrow as pa

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not len(table):
                continue
            columns = [table.column(c).to_numpy() for c in ("key", "i", "j")]
            new = np.logical_or.reduce([np.diff(c) != 0 for c in columns])
            starts = [0, *(np.flatnonzero(new) + 1).tolist()]
            held = table.slice(starts[-1])
            if len(starts) > 1:
                yield links_of(table.slice(0, starts[-1]), starts)
        if held is not None:
            yield links_of(held, [0, len(held)])

    return run


def rows_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row_hash"), F.col(text_col).alias("text"))


def verified_links(df: DataFrame, sets: DataFrame, words: int, similarity: float, id_col: str, text_col: str, scope: str = "") -> DataFrame:
    """Links (a, b) whose components are those of "shingles agree by `similarity` or more" within groups.

    `sets`: fp, the name of a set; size, its shingles; row, the id and row_hash of a text that has it;
    group, the candidates that it is one of. A set is in one group.
    """

    def sets_of(batches):
        import pyarrow as pa

        for batch in batches:
            for text in batch.column(0):
                s = shingle_set(text.as_py(), words)
                yield pa.RecordBatch.from_arrays([pa.array(as_longs([name_of(s)])), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], ["fp", "sh"])

    groups = sets.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("total")).where("n > 1")
    parts_of = lambda n, total: F.greatest(F.ceil(F.col(n) / PART_SETS), F.ceil(F.col(total) / PART_SHINGLES)).cast("int")
    members = sets.join(groups.select("group", parts_of("n", "total").alias("parts")), "group").select("group", "fp", "size", "row", "parts")
    members = store.written(members, "similar-members", scope)

    # The sets of those that have a candidate, from one of their texts.
    wanted = members.select(F.col("row.id").alias("i"), F.col("row.row_hash").alias("r"))
    texts = rows_of(df, id_col, text_col).join(wanted, F.expr("id <=> i and row_hash = r"), "left_semi").dropDuplicates(["id", "row_hash"])
    whole = store.written(texts.select("text").mapInArrow(sets_of, "fp long, sh array<long>"), "similar-sets", scope)

    def linked(cells):
        cells = cells.join(whole, "fp").select("key", "i", "j", "fp", "sh").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
        return store.written(cells.mapInArrow(_cell_links(similarity), "a long, b long"), "similar-links", scope)

    key, hashed = F.col("group").alias("key"), F.xxhash64("fp")
    within = F.pmod(hashed, F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: (j != F.col("part")) | (F.col("parts") == 1))
    cells = members.withColumn("part", within).withColumn("other", F.explode(F.when(F.col("parts") > PAIRED, F.array("part")).otherwise(others)))
    found = linked(cells.select(key, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "fp"))
    large = members.where(F.col("parts") > PAIRED)
    if large.isEmpty():
        return found

    def rooted():
        roots = components(found, scope).withColumnRenamed("node", "fp")
        placed = large.select("group", "fp", "size").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        return store.written(placed, "similar-placed", scope)

    # One set of each component with those of other parts, as long as that joins them.
    before, last = None, False
    while True:
        placed = rooted()
        hubs = placed.where("root = fp")
        n = hubs.count()
        if last or before is not None and 2 * n > before:
            break
        dealt = hubs.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("total")).select("group", parts_of("n", "total").alias("parts"))
        found = found.unionByName(linked(hubs.join(dealt, "group").select(key, within.alias("i"), within.alias("j"), "fp")))
        before, last = n, dealt.where("parts > 1").isEmpty()

    # What is outside the largest component with the whole group: parts of that component come first.
    sizes = placed.groupBy("group", "root").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    most = sizes.groupBy("group").agg(F.max(F.struct("n", "total", "root")).alias("most"), F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > most.n")
    most = most.select("group", F.col("most.root").alias("largest"), parts_of("most.n", "most.total").alias("own"), (F.col("n") - F.col("most.n")).alias("n"), (F.col("total") - F.col("most.total")).alias("total"))
    parts = most.withColumn("rest", parts_of("n", "total")).select("group", "largest", "own", "rest")
    part = F.when(F.col("root") == F.col("largest"), F.pmod(hashed, F.col("own"))).otherwise(F.col("own") + F.pmod(hashed, F.col("rest"))).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("own") + F.col("rest") - 1), lambda j: (j != F.col("part")) & ((j >= F.col("own")) | (F.col("part") >= F.col("own"))))
    cells = placed.join(parts, "group").withColumn("part", part).withColumn("other", F.explode(others))
    return found.unionByName(linked(cells.select(key, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "fp")))
