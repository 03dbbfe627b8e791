"""Near-duplicate embeddings by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions, shifted and quantised; `PROJECTIONS` such
numbers together are a table's key, and vectors that share a key in one of `TABLES` tables are
compared exactly. At cosine 0.93 (distance 0.374, cell 2.0) one projection agrees with probability
0.85 and a pair is missed in all tables with probability below 0.002; at cosine 0.97 below 1e-9.

Equal vectors of a label are one representative with a count, known by two hashes of the vector. A
pair is counted in the first table whose keys agree, so that counts add up over tables without listing
pairs. Buckets that hold the same vectors are one, that of the first of their tables: close vectors
share most tables. Numbers alone move until the buckets are known; then each vector goes once to every
block of its buckets, as its bytes and its tables' keys of 32 bits. A large bucket is dealt over pairs
of blocks: every task compares two blocks of about `BLOCK` vectors and gives a count and a link to the
hub of its component for each vector.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm import store
from knotwork.llm.components import components

TABLES, PROJECTIONS, CELL, SEED = 80, 16, 2.0, 7
BLOCK = 2048


def keys(unit: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """(n, tables) keys of 32 bits of unit vectors of one dimension."""
    rng = np.random.default_rng([SEED, unit.shape[1]])
    directions = rng.standard_normal((unit.shape[1], tables * PROJECTIONS))
    shifts = rng.uniform(0, CELL, tables * PROJECTIONS)
    odd = rng.integers(1, 2**63, (tables, PROJECTIONS), dtype=np.int64) | 1
    out = np.empty((len(unit), tables), dtype=np.int32)
    for k in range(0, len(unit), 1024):
        cells = np.floor((unit[k : k + 1024] @ directions + shifts) / CELL).astype(np.int64).reshape(-1, tables, PROJECTIONS)
        with np.errstate(over="ignore"):
            mixed = (cells * odd).sum(axis=2)
            out[k : k + 1024] = ((mixed ^ (mixed >> 29)) * np.int64(0x9E3779B97F4A7C1)) >> 32
    return out


def _units(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hash(kind: str):
    """Adds keys to representatives; their vectors become bytes of numbers of the input's kind."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for _, same in pdf.groupby(pdf["embedding"].map(len)):
                got = keys(_units(same["embedding"]))
                raw = [np.asarray(v, dtype=kind).tobytes() for v in same["embedding"]]
                yield pd.DataFrame({"rep": same["rep"].to_numpy(), "label": same["label"].to_numpy(), "h1": same["h1"].to_numpy(), "h2": same["h2"].to_numpy(), "copies": same["copies"].to_numpy(), "vector": raw, "keys": list(got)})

    return run


def _group_links(x: np.ndarray, k: np.ndarray, copies: np.ndarray, block: np.ndarray, table: int, lone: bool, low: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted link counts and hubs (row numbers) of the rows of one pair of blocks, sorted by id."""
    left = np.arange(len(x)) if lone else np.flatnonzero(block == low)
    right = left if lone else np.flatnonzero(block != low)
    ones, others = [], []
    for s in range(0, len(left), 256):
        own = left[s : s + 256]
        i, j = np.nonzero(x[own] @ x[right].T >= threshold)
        i, j = own[i], right[j]
        if lone:
            i, j = i[i < j], j[i < j]
        if len(i) and table:  # a pair belongs to the first table in which it meets
            for c in range(0, len(i), 50_000):
                a, b = i[c : c + 50_000], j[c : c + 50_000]
                first = ~(k[a, :table] == k[b, :table]).any(axis=1)
                ones.append(a[first])
                others.append(b[first])
        else:
            ones.append(i)
            others.append(j)
    i, j = np.concatenate(ones or [[]]).astype(int), np.concatenate(others or [[]]).astype(int)
    hub, before = np.arange(len(x)), None
    if not len(i):
        return np.zeros(len(x)), hub
    links = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
    while before is None or (hub != before).any():
        before = hub.copy()
        np.minimum.at(hub, i, before[j])
        np.minimum.at(hub, j, before[i])
        hub = hub[hub]
    return links, hub


def _compare(threshold: float, kind: str):
    """Reads groups sorted by label, table, key and blocks; gives links and hub of each vector that has any.

    Many groups are small, so they are cut out of whole batches; a group that a batch breaks off waits
    for the next one. A group holds two blocks at most.
    """

    def run(batches):
        import pyarrow as pa

        def links_of(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            own = lambda n: table.column(n).to_numpy()
            rep, copies, pos, key, low, high, block, label = (own(n) for n in ("rep", "copies", "pos", "key", "low", "high", "block", "label"))
            vectors = [np.frombuffer(v, dtype=kind) for v in table.column("vector").to_pylist()]
            codes = table.column("keys").chunk(0).flatten().to_numpy().reshape(len(rep), -1)
            new = np.ones(len(rep), dtype=bool)
            new[1:] = (pos[1:] != pos[:-1]) | (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (label[1:] != label[:-1])
            edges = [*np.flatnonzero(new).tolist(), len(rep)]
            out = [[], [], []]
            for s, e in zip(edges, edges[1:]):
                for size in {len(v) for v in vectors[s:e]}:
                    rows = np.array([i for i in range(s, e) if len(vectors[i]) == size])
                    rows = rows[np.argsort(rep[rows], kind="stable")]
                    if len(rows) < 2:
                        continue
                    links, hub = _group_links(_units([vectors[i] for i in rows]), codes[rows], copies[rows], block[rows], int(pos[s]), low[s] == high[s], int(low[s]), threshold)
                    some = np.flatnonzero(links)
                    out[0] += rep[rows[some]].tolist()
                    out[1] += rep[rows[hub[some]]].tolist()
                    out[2] += links[some].astype(np.int64).tolist()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["rep", "hub", "links"])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            names = ("label", "pos", "key", "low", "high")
            last = [table.column(n)[-1] for n in names]
            same = np.ones(len(table), dtype=bool)
            for n, v in zip(names, last):
                same &= table.column(n).to_numpy() == v.as_py()
            begin = len(table) - int(same[::-1].argmin()) if not same.all() else 0
            held = table.slice(begin)
            if begin:
                yield links_of(table.slice(0, begin))
        if held is not None and len(held):
            yield links_of(held)

    return run


def near_duplicates(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links, component_id and kept of every row.

    Rows are compared only where labels are equal and not null. Vectors that are null, empty, zero or
    hold null or non-finite numbers link with nothing, nor do vectors of different dimension or null
    ids. Repeated ids keep their rows; the links of different vectors under one id add up. Vectors of any
    length are read whole; other columns are left behind, so their names can't clash. An empty table gives
    no rows. Within a dense cluster all pairs are compared, in blocks: n vectors near each other take
    n * n / 2 products, and each vector goes to n / BLOCK tasks.
    """
    spark = df.sparkSession
    store.bounded_batches(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).alias("label"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    scale = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", finite) & F.coalesce((scale > 0) & (scale < float("inf")), F.lit(False))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    sound_rows = rows.where("sound")
    sound_rows = sound_rows.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    # What the input holds is what moves: floats stay floats.
    kind = "<f4" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    label = df.schema[label_col].dataType.simpleString()
    reps = sound_rows.groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    schema = f"rep long, label {label}, h1 long, h2 long, copies long, vector binary, keys array<int>"
    hashed = store.written(reps.select("rep", "label", "h1", "h2", "copies", "embedding").mapInPandas(_hash(kind), schema), "embedding-keys")
    entries = hashed.select("h1", "h2", "label", F.posexplode("keys").alias("pos", "key"))
    held = [F.count("*").alias("n"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.sum(F.shiftright("h1", 20)).alias("s1")]
    buckets = entries.groupBy("label", "pos", "key").agg(*held).where("n > 1")
    buckets = buckets.groupBy("label", "n", "x1", "x2", "s1").agg(F.min(F.struct("pos", "key")).alias("t")).select("label", "t.pos", "t.key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    buckets = store.written(buckets, "embedding-buckets")
    members = entries.join(buckets, ["label", "pos", "key"])
    members = members.withColumn("block", F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")).cast("int"))
    pairs = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("h1", "h2", "label", "pos", "key", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    full = pairs.join(hashed.select("rep", "h1", "h2", "label", "copies", "vector", "keys"), ["h1", "h2", "label"])
    order = ["label", "pos", "key", "low", "high"]
    full = full.withColumn("label", F.col("label").cast("string")).repartition(*order).sortWithinPartitions(*order)
    found = full.select(*order, "block", "rep", "copies", "vector", "keys").mapInArrow(_compare(threshold, kind), "rep long, hub long, links long")
    found = store.written(found, "embedding-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    own = hashed.select("label", "h1", "h2", "copies", "rep").join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    placed = own.select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "rep").alias("component"))
    out = rows.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = out.unionByName(sound_rows.select("id", "label", "h1", "h2").join(placed, ["label", "h1", "h2"]).select("id", F.col("links").alias("n_links"), F.col("component").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
