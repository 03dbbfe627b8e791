"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations.

Texts are lower-cased words (runs of letters and digits) and their five-word shingles; a text of
fewer words is one shingle. A window of a document holds as many shingles as a benchmark item (or the
whole document, if that has fewer). A document is contaminated by an item if a window and the item
have a weighted Jaccard similarity (shingles with their counts) of `SIMILARITY` or more.

Shingles that repeat count as many elements (a shingle and how many times it has come), so that the
weighted similarity is that of sets and SimHash sees each element once, whatever repeats.

A window at the similarity holds at least `needed` shingles of some item of its size. Moving it right
to the first of these never lowers the similarity, so windows that begin at one (or are the last of the
document) and hold enough of them are all that need be looked at; which items they are of is not asked.
Windows are fingerprinted by SimHash, as items are. A multi-index of `BLOCKS` blocks of eight bits finds
the items of a window's size: within `RADIUS` bits some block differs by no more than RADIUS // BLOCKS,
and an item lists all such values of each block. Two sets at 0.8 differ in a bit with probability
acos(8/9) / pi = 0.15, so in 19.4 of 128 bits with a deviation of 4.1: the radius of 47 lies 6.8 above,
and a pair at the similarity is lost with probability below 1e-9. What is found is verified exactly.

Documents that share no shingle with the benchmark leave at the scan, by a bit map of the benchmark's
shingles with at most `MAP_LONGS` numbers; it may let others pass but none be missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm import store

WORDS, SIMILARITY = 5, 0.8
BITS, BLOCKS, RADIUS = 128, 16, 47
MAP_LONGS = 1 << 20


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; none for null."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def shingles(w: Column) -> Column:
    """Hashes of the five-word shingles of an array of words; one of all words if they are fewer."""
    many = F.transform(F.sequence(F.lit(1), F.size(w) - WORDS + 1), lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(WORDS)]))
    few = F.array(F.xxhash64(F.array_join(w, " ")))
    return F.when(F.size(w) >= WORDS, many).when(F.size(w) > 0, few).otherwise(F.array().cast("array<bigint>"))


def needed(n: Column, m: Column) -> Column:
    """Shingles that a window of m and an item of n must share for the similarity."""
    return F.ceil(SIMILARITY * (n + m) / (1 + SIMILARITY) - 1e-9).cast("int")


def _unsigned_shift(x: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, by.cast("int"))


def _bit_map(hashes: DataFrame) -> tuple[Column, int]:
    """A bit map of the hashes as an array of longs in a scalar subquery, and its length.

    It has 512 bits for each hash as far as the bound allows, of which each hash sets two; a length
    is a power of two.
    """
    count, longs = hashes.count(), 64
    while longs < min(MAP_LONGS, count * 8):
        longs *= 2
    bits = F.explode(F.array(F.col("sh"), _unsigned_shift(F.col("sh"), F.lit(32)))).alias("x")
    word = _unsigned_shift(F.col("x"), F.lit(6)).bitwiseAND(F.lit(longs - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x").bitwiseAND(F.lit(63)).cast("int"))
    filled = hashes.sparkSession.range(longs).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b")).unionByName(hashes.select(bits).select(word.alias("w"), bit.alias("b")))
    filled = filled.groupBy("w").agg(F.bit_or("b").alias("b"))
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"])).scalar(), longs


def _elements(sh: Column) -> Column:
    """The shingles of a sorted array as a set: each with the number of times that it has come before."""
    # Equal ones are neighbours; the number is the distance from the first.
    return F.transform(sh, lambda x, i: F.xxhash64(x, i + 1 - F.array_position(sh, x)))


def _print_of(rows: DataFrame, by: list[str]) -> DataFrame:
    """SimHash of the elements e of each group, in two longs lo and hi."""
    second = F.xxhash64("e", F.lit(1))
    ones = [F.sum(F.shiftright(x, b).bitwiseAND(F.lit(1))).alias(f"{name}{b}") for name, x in (("lo", F.col("e")), ("hi", F.col("second"))) for b in range(64)]
    counted = rows.withColumn("second", second).groupBy(*by).agg(F.count("*").alias("n_elements"), *ones)

    def word(name: str) -> Column:
        bits = [F.when(2 * F.col(f"{name}{b}") > F.col("n_elements"), F.lit((1 << b) - (1 << 64 if b == 63 else 0))).otherwise(0) for b in range(64)]
        fp = bits[0]
        for x in bits[1:]:
            fp = fp.bitwiseOR(x)
        return fp.cast("long").alias(name)

    return counted.select(*by, word("lo"), word("hi"))


def _blocks() -> Column:
    """The blocks of a fingerprint in lo and hi."""
    width = BITS // BLOCKS
    return F.array(*[_unsigned_shift(F.col(x), F.lit(k)).bitwiseAND(F.lit((1 << width) - 1)) for x in ("lo", "hi") for k in range(0, 64, width)])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", scope: str = "") -> DataFrame:
    """id, item, similarity, start (in words) of the best window of each document and item at or over the similarity.

    Null and empty texts and items match nothing, and empty tables give no rows. Repeated items are
    reported each; rows that repeat an id are searched as separate texts and reported once for an item.
    Ties go to the earliest window. Very long texts are searched whole; windows are no longer than an
    item. Other columns are left behind, so their names can't clash.
    """
    spark = docs.sparkSession
    named = benchmark.select(F.col(item_col).alias("item"), F.monotonically_increasing_id().alias("no"), F.explode_outer(F.array(words(F.col(item_text)))).alias("w"))
    items = named.select("item", "no", F.explode_outer(F.array(shingles(F.col("w")))).alias("sh")).withColumn("sh", F.explode_outer(F.array(F.array_sort("sh"))))
    items = store.written(items.where(F.size("sh") > 0).withColumn("e", _elements(F.col("sh"))), "benchmark-items", scope)
    item_rows = items.select("item", "no", F.size("sh").alias("n"), F.explode("sh").alias("sh"))
    element_rows = items.select("no", F.size("e").alias("n"), F.explode("e").alias("e"))
    table, longs = _bit_map(item_rows.select("sh").distinct())

    def bit_of(x: Column) -> Column:
        word = F.get("map", _unsigned_shift(x, F.lit(6)).bitwiseAND(F.lit(longs - 1)).cast("int"))
        return _unsigned_shift(word, x.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1

    def marked(x: Column) -> Column:
        return bit_of(x) & bit_of(_unsigned_shift(x, F.lit(32)))

    # Each explode holds one value: it keeps the optimizer from repeating the expression in what follows.
    cut = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row_hash"), F.explode_outer(F.array(words(F.col(text_col)))).alias("w"))
    hashed = cut.select("id", "row_hash", F.explode_outer(F.array(shingles(F.col("w")))).alias("all"))
    suspects = hashed.withColumn("map", table).where(F.exists("all", marked)).drop("map")
    suspects = store.written(suspects.withColumn("size", F.size("all")), "decontaminate-suspects", scope)

    # Places of shingles that items of a size hold, and the windows of that size that begin there and hold enough of them.
    hits = suspects.select("id", "row_hash", "size", F.posexplode("all").alias("pos", "sh")).join(item_rows.select("n", "sh").distinct(), "sh")
    by_size = hits.groupBy("id", "row_hash", "size", "n").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    by_size = by_size.withColumn("m", F.least("n", "size")).withColumn("need", needed(F.col("n"), F.col("m"))).where(F.size("at") >= F.col("need"))
    begins = F.transform(
        F.sequence(F.lit(0), F.size("at") - F.col("need")),
        lambda i: F.when(F.get("at", i + F.col("need") - 1) < F.least(F.get("at", i), F.col("size") - F.col("m")) + F.col("m"), F.least(F.get("at", i), F.col("size") - F.col("m"))),
    )
    starts = by_size.select("id", "row_hash", "n", "m", F.explode(F.array_distinct(F.filter(begins, lambda s: s.isNotNull()))).alias("start"))
    windows = starts.join(suspects.select(F.col("id").alias("i"), F.col("row_hash").alias("r"), "all"), F.expr("id <=> i and row_hash = r"))
    windows = windows.select("id", "row_hash", "n", "m", "start", F.explode(F.array(F.array_sort(F.slice("all", F.col("start") + 1, F.col("m"))))).alias("sh"))
    # Windows of a text that hold the same are one, the earliest: what repeats a phrase has few.
    windows = windows.withColumn("sh", F.explode(F.array(_elements(F.col("sh"))))).withColumn("what", F.xxhash64("sh"))
    windows = windows.groupBy("id", "row_hash", "n", "m", "what").agg(F.min(F.struct("start", "sh")).alias("w")).select("id", "row_hash", "n", "m", "w.start", "w.sh")
    windows = store.written(windows, "decontaminate-windows", scope)

    # SimHash and the multi-index over blocks: a window finds items of its size by a block alone.
    at = ["id", "row_hash", "n", "start"]
    prints = _print_of(windows.select(*at, F.explode("sh").alias("e")), at)
    of_items = _print_of(element_rows, ["no", "n"])
    small = [m for m in range(1 << (BITS // BLOCKS)) if m.bit_count() <= RADIUS // BLOCKS]
    flips = F.array(*[F.lit(m).cast("long") for m in small])
    probes = of_items.select("no", "n", F.col("lo").alias("item_lo"), F.col("hi").alias("item_hi"), F.posexplode(_blocks()).alias("block", "v"))
    probes = probes.select("no", "n", "item_lo", "item_hi", "block", F.explode(flips).alias("flip"), "v").withColumn("v", F.col("v").bitwiseXOR(F.col("flip"))).drop("flip")
    placed = prints.select(*at, "lo", "hi", F.posexplode(_blocks()).alias("block", "v"))
    apart = F.bit_count(F.col("lo").bitwiseXOR(F.col("item_lo"))) + F.bit_count(F.col("hi").bitwiseXOR(F.col("item_hi")))
    # Both sides may be large: no side is broadcast on an estimate.
    close = placed.join(probes.hint("merge"), ["n", "block", "v"]).where(apart <= RADIUS)
    close = close.select(*at, "no").distinct()

    # Exact weighted similarity, over the elements of both.
    held = close.join(windows.withColumnsRenamed({"id": "i", "row_hash": "r", "n": "k", "start": "s"}), F.expr("id <=> i and row_hash = r and n = k and start = s")).select("id", "no", "n", "m", "start", "sh")
    both = held.join(items.select("no", F.col("e").alias("of_item")), "no").withColumn("both", F.size(F.array_intersect("sh", "of_item")))
    scored = both.withColumn("similarity", F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).where(F.col("similarity") >= SIMILARITY - 1e-12)
    best = scored.groupBy("id", "no").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("b"))
    named = best.join(items.select("no", "item"), "no")
    return named.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("b.similarity").alias("similarity"), (-F.col("b.back")).cast("long").alias("start"))
