"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit place i has a code m(i), a non-zero vector of `radius + 1` bits. For each non-zero vector v
there is a table that keeps the bits with m(i) . v = 1 (mod 2). If two fingerprints differ in no more
than `radius` places, then some non-zero v is orthogonal to the codes of all of them, and in that
table the two collide: no pair within the radius is missed. A table keeps about half of the bits.

Fingerprints are made distinct first, so copies cost nothing. A bucket of more than `BUCKET` distinct
fingerprints is dealt out further by the same guarantee on its free bits: of `radius + 1` blocks of
them one is free of differences. As the fingerprints of a bucket are distinct, few free bits are few
members. Buckets give a star for each of their components rather than pairs.

Texts whose shingle sets have a Jaccard similarity of 0.8 differ in about a seventh of the bits, too
many for such a code. `similar_classes` finds them by banding: a longer SimHash, whose bits are signs of
sums of weights that a shingle's hash gives (so that small sets have their angle too), is cut into bands
of bits, and texts that share a band are compared by a print of `PRINT` further bits. Two sets of
similarity s have a cosine of 2 s / (1 + s) or more and differ in a bit with probability acos(cosine) /
pi or less (sets of a few shingles a little more: 0.158 instead of 0.151 for four of five); the number
of bands follows from that and from the share `LOSS` that may be missed, the radius of the prints from
a tenth of that share. What is found is verified on whole sets.
"""

from __future__ import annotations

from math import acos, ceil, comb, log, log1p, pi

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm import minhash, store
from knotwork.llm.components import components
from knotwork.llm.minhash import SIMILARITY

BITS = 64
#: Distinct fingerprints that one task compares at once.
BUCKET = 4096
#: Shingles hashed at a time of one text.
STEP = 1 << 15
#: Bits that candidates are compared by; the least bits of a band; the share of pairs just at the similarity that bands may miss.
PRINT, BAND, LOSS = 192, 16, 1e-5
#: Texts that share a band by chance, at most, before bands get another bit.
BY_CHANCE = 128
#: Shingles weighed at a time, and the weights that one hash gives.
BLOCK, WEIGHTS = 64, 16
#: Members of a bucket that are compared in step with other buckets'; rows read at a time; rows of a bucket that a task holds.
SMALL, ROWS, HELD = 64, 1 << 16, 1 << 18
#: Bands whose links come first: what they join is not linked again by the others.
FIRST = 8


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of a text's word shingles (ASCII lower case, ASCII white space)."""
    from xxhash import xxh64_intdigest

    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, STEP):
        some = w[k : min(n, k + STEP) + words - 1]
        shingles = map(b" ".join, zip(*(some[j:] for j in range(words)))) if len(w) >= words else [b" ".join(w)]
        h = np.array([xxh64_intdigest(s, seed) for s in shingles], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row_hash, fp) of every row; fp is the fingerprint as a signed long. Null and empty texts have zero."""
    store.bounded_batches(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = [fingerprint(t, words, seed) for t in batch.column(2).to_pylist()]
            made = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], ["id", "row_hash", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, row_hash long, fp long")


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def covering_masks(radius: int) -> list[int]:
    """The bit masks of all tables for a radius."""
    size = 1 << (radius + 1)
    codes = [1 + i % (size - 1) for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(codes) if (m & v).bit_count() % 2) for v in range(1, size)]


def finer_masks(mask: int, radius: int) -> list[int]:
    """The mask with one of radius + 1 blocks of its free bits added, for each block."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[k :: radius + 1]) for k in range(radius + 1)]


def _stars(fps: np.ndarray, radius: int):
    """(member, hub) of the components of distinct fingerprints of one bucket."""
    left = np.sort(fps)
    while len(left) > 1:
        hub, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for k in range(0, len(frontier), 256):
                near |= (np.bitwise_count(frontier[k : k + 256, None] ^ left[None, :]) <= radius).any(axis=0)
            frontier, left = left[near], left[~near]
            for x in frontier:
                yield x, hub


def _bucket_links(radius: int):
    """Reads buckets sorted by (mask, key) and gives links a, b."""

    def run(batches):
        import pandas as pd

        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            new = (pdf["mask"].diff().ne(0) | pdf["key"].diff().ne(0)).to_numpy()
            starts = np.flatnonzero(new)
            last = starts[-1] if len(starts) else 0
            held = pdf.iloc[last:]
            yield _links_of(pdf["fp"].to_numpy()[:last], starts[:-1], radius)
        if held is not None:
            yield _links_of(held["fp"].to_numpy(), np.zeros(1, dtype=np.int64), radius)

    return run


def _links_of(fps: np.ndarray, starts: np.ndarray, radius: int):
    import pandas as pd

    out_a, out_b = [], []
    sizes = np.diff([*starts, len(fps)]) if len(starts) else np.empty(0, dtype=np.int64)
    raw = np.ascontiguousarray(fps).view(np.uint64)
    two = starts[sizes == 2]
    near = two[np.bitwise_count(raw[two] ^ raw[two + 1]) <= radius] if len(two) else two
    out_a += raw[near].tolist()
    out_b += raw[near + 1].tolist() if len(near) else []
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        for a, b in _stars(raw[s : s + n], radius):
            out_a.append(a)
            out_b.append(b)
    a, b = (np.array(x, dtype=np.uint64).view(np.int64) for x in (out_a, out_b))
    return pd.DataFrame({"a": a, "b": b})


def links(distinct: DataFrame, radius: int = 3, scope: str = "") -> DataFrame:
    """Links (a, b) whose components are those of the relation "no more than `radius` bits apart".

    `distinct`: one column fp without repeats. Every pair within the radius is joined by a path of
    links, and no link joins what is not.
    """
    tables = F.explode(F.array(*[F.lit(signed(m)) for m in covering_masks(radius)])).alias("mask")
    entries = distinct.select("fp", tables).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    masks = covering_masks(radius)
    found = None
    while True:
        entries = store.written(entries, "simhash-entries", scope)
        sizes = entries.groupBy("mask", "key").count().where("count > 1")
        sizes = store.written(sizes.select("mask", "key", (F.col("count") > BUCKET).alias("large")), "simhash-buckets", scope)
        members = entries.join(sizes, ["mask", "key"])
        small = members.where("not large").select("mask", "key", "fp")
        some = small.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInPandas(_bucket_links(radius), "a long, b long")
        some = store.written(some.distinct(), "simhash-links", scope)
        found = some if found is None else found.unionByName(some)
        if sizes.where("large").isEmpty():
            return found
        # Rows of the large buckets go to finer buckets, which differ from mask to mask.
        finer = {m: finer_masks(m, radius) for m in masks}
        masks = sorted({x for v in finer.values() for x in v})
        onward = F.create_map(*[y for m, v in finer.items() for y in (F.lit(signed(m)), F.array(*[F.lit(signed(x)) for x in v]))])
        large = members.where("large").select("fp", F.explode(onward[F.col("mask")]).alias("mask"))
        entries = large.distinct().withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def near_duplicates(df: DataFrame, radius: int = 3, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", scope: str = "") -> DataFrame:
    """id, row_hash, fp (signed long) and component_id of every row.

    component_id is the least id that is reached by links, the row's own included. Null ids never
    become a component_id unless a component has no other. Repeated ids keep their rows. Null and
    empty texts have fingerprint zero and link like others. An empty table gives no rows.
    """
    prints = store.written(fingerprints(df, words, seed, id_col, text_col), "simhash-prints", scope)
    own = store.written(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct", scope)
    roots = components(links(own.select("fp"), radius, scope), scope)
    placed = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = store.written(placed.join(classes, "root").select("fp", "component_id"), "simhash-classes", scope)
    return prints.join(by_print, "fp").select(F.col("id").alias(id_col), "row_hash", "fp", "component_id")


def radius_of(differ: float, bits: int, loss: float) -> int:
    """The least radius that a pair exceeds with probability `loss` at most, if its bits differ with probability `differ`."""
    beyond, radius = 1.0, -1
    while beyond > loss and radius < bits:
        radius += 1
        beyond = sum(comb(bits, k) * differ**k * (1 - differ) ** (bits - k) for k in range(radius + 1, bits + 1))
    return radius


def banding(similarity: float, n: int) -> tuple[int, int, int]:
    """Bits of a band, bands, and the radius of prints, for n sets: see above."""
    differ = acos(2 * similarity / (1 + similarity)) / pi
    bits = max(BAND, (n // BY_CHANCE).bit_length())
    agree = (1 - differ) ** bits
    bands = ceil(log(LOSS) / log1p(-agree)) if agree < 1 else 1
    return bits, bands, radius_of(differ, PRINT, LOSS / 10)


def _hashing(words: int):
    """Factors and terms that make `words` hashes of one."""
    random = np.random.default_rng(42)
    factors, terms = random.integers(0, 1 << 63, (2, words), dtype=np.uint64) * np.uint64(2)
    return factors + np.uint64(1), terms


def set_bits(shingles: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """SimHash bits of a set of hashed shingles: is the sum of weights -15, -13 to 15 positive? `WEIGHTS` of them by each factor."""
    nibbles = np.uint64(0x000F000F000F000F)
    sums = np.zeros((4, len(factors) * 4), dtype=np.int64)
    for k in range(0, len(shingles), BLOCK):
        z = shingles[k : k + BLOCK, None] * factors
        z += terms
        z ^= z >> np.uint64(32)
        z *= np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(29)
        for i in range(4):
            sums[i] += ((z >> np.uint64(4 * i)) & nibbles).sum(axis=0, dtype=np.uint64).view(np.uint16)
    return 2 * sums.T.ravel() > 15 * len(shingles)


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Whether prints (their words along the first axis) are within the radius."""
    apart = np.bitwise_count(x[0] ^ y[0])
    for k in range(1, len(x)):
        apart = apart + np.bitwise_count(x[k] ^ y[k])
    return apart <= radius


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members and their hubs, the least they reach, that join the same nodes as links (a, b): fewer than there are nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, x, y = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while len(x):
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        apart = low < high
        np.minimum.at(label, high[apart], low[apart])
        x, y = x[apart], y[apart]
        while (label[label] != label).any():
            label = label[label]
    joined = label != np.arange(len(nodes))
    return nodes[joined], nodes[label[joined]]


def _print_stars(nodes: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Members and hubs of the components of nodes, which may have several prints each."""
    order = np.argsort(nodes, kind="stable")
    nodes, prints = nodes[order], prints[:, order]
    members, hubs = [], []
    while len(nodes) and nodes[0] != nodes[-1]:
        hub, n = nodes[0], int(np.searchsorted(nodes, nodes[0], "right"))
        frontier, nodes, prints = prints[:, :n], nodes[n:], prints[:, n:]
        while len(nodes):
            near, step = np.zeros(len(nodes), dtype=bool), max(1, SMALL * BUCKET // len(nodes))
            for k in range(0, frontier.shape[1], step):
                near |= _near(frontier[:, k : k + step, None], prints[:, None, :], radius).any(axis=0)
            reached = np.unique(nodes[near])
            if not len(reached):
                break
            members.append(reached)
            hubs.append(np.full(len(reached), hub))
            near = np.isin(nodes, reached)
            frontier, nodes, prints = prints[:, near], nodes[~near], prints[:, ~near]
    empty = np.empty(0, dtype=np.uint64)
    return np.concatenate([empty, *members]), np.concatenate([empty, *hubs])


def _buckets_of(keys: np.ndarray, members: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of whole buckets: rows sorted by key, of a node and its print."""
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    sizes = np.diff(np.append(starts, len(keys)))
    nodes, prints = members[0], members[1:]
    found = [_print_stars(nodes[s : s + n], prints[:, s : s + n], radius) for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist())]
    # Small ones in step: each member with the next, the one after it and so on.
    first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    after = first + size - 1 - np.arange(len(keys))
    at = np.flatnonzero((size <= SMALL) & (after > 0))
    for step in range(1, SMALL):
        at = at[after[at] >= step]
        if not len(at):
            break
        x, y = nodes[at], nodes[at + step]
        near = _near(prints[:, at], prints[:, at + step], radius) & (x != y)
        found.append((x[near], y[near]))
    return found


def _too_many(nodes: np.ndarray, most: float) -> bool:
    """Whether a bucket holds more pairs of different nodes than one of `most` nodes, a print each."""
    if len(nodes) <= most:
        return False
    own = np.unique(nodes, return_counts=True)[1]
    return len(nodes) ** 2 - int((own**2).sum()) > most * (most - 1)


def _print_links(radius: int, most: float):
    """Reads buckets sorted by key and cell and gives links a, b; members of buckets with more to compare than `most` nodes are given back with key and node, as they come.

    A node is the seventh column or, where that is null or not there, the first word of the print. The
    links of a read, of `ROWS` rows or a bucket, are a forest: fewer than its rows.
    """
    none = (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64))

    def made(found, keys=None, members=None):
        import pyarrow as pa

        a, b = _forest(*(np.concatenate([f[k] for f in found]).view(np.int64) for k in (0, 1)))
        links = pa.table({"a": a, "b": b, **{c: pa.nulls(len(a), pa.int64()) for c in ("key", "node", "p0", "p1", "p2")}})
        if keys is not None and len(keys):
            back = {"key": keys[:, 0], **{c: x.view(np.int64) for c, x in zip(("node", "p0", "p1", "p2"), members)}}
            links = pa.concat_tables([links, pa.table({"a": pa.nulls(len(keys), pa.int64()), "b": pa.nulls(len(keys), pa.int64()), **back})])
        yield from links.to_batches(max_chunksize=ROWS)

    def work(keys, members, begun):
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        sizes = np.diff(np.append(starts, len(keys)))
        large = (keys[starts] == begun).all(axis=1)
        for k in np.flatnonzero((sizes > most) & ~large).tolist():
            large[k] = _too_many(members[0, starts[k] : starts[k] + sizes[k]], most)
        large = np.repeat(large, sizes)
        found = _buckets_of(keys[~large], members[:, ~large], radius) if not large.all() else []
        return made([none, *found], keys[large], members[:, large])

    def run(batches):
        import pyarrow.compute as pc

        keys, members, waiting, rows = np.empty((0, 3), dtype=np.int64), np.empty((4, 0), dtype=np.uint64), [], 0
        # The large bucket whose first members are given back already.
        begun = np.full(3, -1, dtype=np.int64)

        def joined():
            columns = [np.concatenate([b.column(k).to_numpy() for b in waiting]) for k in range(6)]
            nodes = np.concatenate([(pc.coalesce(b.column(6), b.column(3)) if b.num_columns > 6 else b.column(3)).to_numpy() for b in waiting])
            more = np.array([c.view(np.uint64) for c in (nodes, *columns[3:])])
            return np.concatenate([keys, np.stack(columns[:3], axis=1)]), np.concatenate([members, more], axis=1)

        for batch in batches:
            waiting.append(batch)
            rows += len(batch)
            if rows >= ROWS:
                keys, members = joined()
                last = int(np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))[-1])
                if last:
                    yield from work(keys[:last], members[:, :last], begun)
                keys, members, waiting, rows = keys[last:], members[:, last:], [], 0
                if len(keys) > most and (len(keys) > HELD or (keys[-1] == begun).all() or _too_many(members[0], most)):
                    yield from made([none], keys, members)
                    begun, keys, members = keys[-1], keys[:0], members[:, :0]
        if waiting:
            keys, members = joined()
        if len(keys):
            yield from work(keys, members, begun)

    return run


def _linked_buckets(entries: DataFrame, radius: int, scope: str) -> DataFrame:
    """Links (a, b) whose components are those of "within the radius" in any bucket.

    `entries`: the key of a bucket, a print's words p0, p1, p2, and the node that it is part of (null:
    p0). A bucket with more to compare than `BUCKET` nodes is linked within parts first; then all that
    is not in its largest component is compared with the whole bucket, as pairs of parts.
    """
    given, by, words = "a long, b long, key long, node long, p0 long, p1 long, p2 long", ["key", "i", "j"], ["p0", "p1", "p2"]
    zero = F.lit(0).cast("long")
    first = entries.select("key", zero.alias("i"), zero.alias("j"), *words, "node")
    first = first.repartition("key").sortWithinPartitions("key").mapInArrow(_print_links(radius, BUCKET), given)
    first = store.written(first, "simhash-candidates", scope)
    found, large = first.where("a is not null").select("a", "b"), first.where("a is null").select("key", "node", *words)
    if large.isEmpty():
        return found

    def linked(cells):
        links = cells.repartition(*by).sortWithinPartitions(*by).mapInArrow(_print_links(radius, float("inf")), given).select("a", "b")
        return store.written(links, "simhash-candidates", scope)

    some = F.pmod(F.xxhash64(*words), F.ceil(F.col("n") / BUCKET))
    dealt = large.join(large.groupBy("key").agg(F.count("*").alias("n")), "key").withColumn("i", some)
    found = found.unionByName(linked(dealt.select("key", "i", F.col("i").alias("j"), *words, "node")))

    roots = components(found, scope)
    placed = store.written(large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "simhash-placed", scope)
    most = placed.groupBy("key", "root").count().groupBy("key").agg(F.max(F.struct("count", "root")).alias("most"), F.sum("count").alias("n"))
    # Parts of the largest component come first, then those of the rest.
    own, rest = F.ceil(2 * F.col("most.count") / BUCKET).alias("own"), F.ceil(2 * (F.col("n") - F.col("most.count")) / BUCKET).alias("rest")
    parts = most.where("n > most.count").select("key", F.col("most.root").alias("largest"), own, rest)
    hashed = F.xxhash64(*words)
    part = F.when(F.col("root") == F.col("largest"), F.pmod(hashed, F.col("own"))).otherwise(F.col("own") + F.pmod(hashed, F.col("rest")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("own") + F.col("rest") - 1), lambda j: (j != F.col("part")) & ((j >= F.col("own")) | (F.col("part") >= F.col("own"))))
    cells = placed.join(parts, "key").withColumn("part", part).withColumn("other", F.explode(others))
    return found.unionByName(linked(cells.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), *words, F.col("root").alias("node"))))


def candidates(prints: DataFrame, bits: int, radius: int, scope: str = "") -> DataFrame:
    """Links (a, b) between first words of prints that share a band and are within the radius.

    `prints`: p0, p1, p2, the words of a print, and bands, its bands of so many bits. Only the
    components of the links count. The first bands join what is much alike, each print to the least
    one that it is linked with, and on from there; the others compare only what is not joined yet, and
    their links are between what it is joined to. So a print of a group of near copies gives links
    for about `FIRST` bands, not for all of them.
    """

    def entries(of, start, count, node):
        keyed = of.select("p0", "p1", "p2", node.alias("node"), F.posexplode(F.slice("bands", F.lit(start + 1), count)).alias("band", "v"))
        return keyed.withColumn("key", (F.col("band").cast("long") + start) * (1 << bits) + F.col("v"))

    found = _linked_buckets(entries(prints, 0, F.lit(FIRST), F.lit(None).cast("long")), radius, scope)
    least = store.written(found.groupBy("a").agg(F.min("b").alias("b")), "simhash-least", scope)
    for _ in range(2):
        onward = least.select(F.col("a").alias("b"), F.col("b").alias("next"))
        least = least.join(onward, "b", "left").select("a", F.coalesce("next", "b").alias("b"))
    placed = prints.join(least.select(F.col("a").alias("p0"), F.col("b").alias("node")), "p0", "left")
    return found.unionByName(_linked_buckets(entries(placed, FIRST, F.size("bands"), F.col("node")), radius, scope))


def similar_classes(df: DataFrame, words: int = 5, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", scope: str = "") -> DataFrame:
    """id, row_hash and class of every row: the components of "word shingles agree by `similarity` or more".

    The similarity is the Jaccard one of the sets of shingles; candidates come from SimHash and are
    verified. Texts of no words link with each other. The rows are counted first: bands get a bit more
    each time they double, from eight million on.
    """
    store.bounded_batches(df.sparkSession)
    bits, bands, radius = banding(similarity, df.count())
    hashing = _hashing(-(-(PRINT + bits * bands) // WEIGHTS))
    powers = 1 << np.arange(bits, dtype=np.int64)

    def prints_of(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [minhash.shingle_set(t, words) for t in batch.column(2).to_pylist()]
            made = np.array([set_bits(s, *hashing)[: PRINT + bits * bands] for s in sets], dtype=bool).reshape(len(sets), -1)
            own = [pa.array(minhash.as_longs([minhash.name_of(s) for s in sets])), pa.array([len(s) for s in sets], pa.int64())]
            own += [pa.array(p) for p in np.packbits(made[:, :PRINT], axis=1, bitorder="little").view(np.int64).T]
            own.append(pa.FixedSizeListArray.from_arrays(pa.array((made[:, PRINT:].reshape(-1, bits) @ powers).astype(np.int32)), bands).cast(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own], ["id", "row_hash", "fp", "size", "p0", "p1", "p2", "bands"])

    kind = df.schema[id_col].dataType.simpleString()
    prints = minhash.rows_of(df, id_col, text_col).mapInArrow(prints_of, f"id {kind}, row_hash long, fp long, size long, p0 long, p1 long, p2 long, bands array<int>")
    prints = store.written(prints, "simhash-prints", scope)
    one = [F.first(c).alias(c) for c in ("size", "p0", "p1", "p2", "bands")]
    distinct = prints.groupBy("fp").agg(F.min(F.struct("id", "row_hash")).alias("row"), *one).where("size > 0")
    distinct = store.written(distinct, "simhash-distinct", scope)
    near = components(candidates(distinct, bits, radius, scope), scope)
    grouped = distinct.join(near.withColumnRenamed("node", "p0"), "p0", "left").select("fp", "size", "row", F.coalesce("root", "p0").alias("group"))
    links = minhash.verified_links(df, grouped, words, similarity, id_col, text_col, scope)
    roots = components(links, scope).withColumnsRenamed({"node": "fp", "root": "class"})
    return prints.select("id", "row_hash", "fp").join(roots, "fp", "left").select(F.col("id").alias(id_col), "row_hash", F.coalesce("class", "fp").alias("class"))


def keep_one(df: DataFrame, words: int = 5, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", scope: str = "") -> DataFrame:
    """One row of each class of similar texts, with all its columns: the least by id (null ids last), then by hash of the text."""
    rank = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), "row_hash")
    found = store.written(similar_classes(df, words, similarity, id_col, text_col, scope), "part-classes", scope)
    best = found.groupBy("class").agg(F.min(rank).alias("rank"))
    keys = best.select(F.col("rank.i").alias("__i"), F.col("rank.row_hash").alias("__h")).distinct()
    kept = df.withColumn("__row", F.xxhash64(text_col)).join(keys, F.col(id_col).eqNullSafe(F.col("__i")) & (F.col("__row") == F.col("__h")), "left_semi").drop("__row")
    repeated = found.groupBy(id_col, "row_hash").count().where("count > 1")
    return kept.dropDuplicates([id_col, text_col]) if not repeated.isEmpty() else kept


def hex_print(fp) -> Column:
    """The fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
