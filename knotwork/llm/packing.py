"""Best-fit packing of token runs into sequences, by rounds of residual packing.

Documents are cut into pieces; whole ones are sequences. The others are dealt by hash over as many tasks
as their number needs, so that every task sees a like mix of lengths whatever the order of the corpus,
and packed there best-fit, longest first. Bins that are nearly full are emitted. All others become
items of their load for the next round and are dealt anew, until one task can take them or a round
doesn't lower their number. Best-fit leaves at most one bin under half full in a task, and of two that
meet in one sequence one is under half full, so rounds are few. No task holds many more than `MEET`
bins, whatever the size of the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm import store

#: Bins that a task packs, about.
MEET = 20_000
#: A bin with no more free room than this share of its capacity is nearly full.
NEARLY = 1 / 64

ITEM = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>"
BIN = f"bin long, done boolean, grp int, items array<{ITEM}>"


def best_fit(loads: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: the longest first, each into the fullest bin that has room.

    Bins are kept by free room; the set of rooms that occur is one integer's bits, so that the
    least room that fits is found at once.
    """
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        fits = rooms >> loads[i]
        if fits:
            room = (fits & -fits).bit_length() - 1 + loads[i]
            own = by_room[room]
            b = own.pop()
            if not own:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - loads[i]
        by_room.setdefault(left, []).append(b)
        rooms |= 1 << left
    return bins


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter, where it is cut."""
    first = n_tokens % capacity or capacity
    return [(0, first), *((k, capacity) for k in range(first, n_tokens, capacity))] if n_tokens else []


def _emit(items, edges: np.ndarray, level: int, group: int, first: int, capacity: int, top: bool):
    """Arrow rows of bins, given as items end to end with the bins' edges, and which of them are done."""
    import pyarrow as pa

    n = len(edges) - 1
    ends = np.concatenate([[0], np.cumsum(items.field("length").to_numpy())])
    done = top | (capacity - np.diff(ends[edges]) <= capacity * NEARLY)
    ids = ((level << 56) | (group << 32) | first) + np.arange(n, dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(done), pa.array(np.full(n, group, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), items)],
        ["bin", "done", "grp", "items"],
    )


def _merger(level: int, top: bool, capacity: int):
    """Packs the bins of a group as items."""

    def merge(table):
        import pyarrow as pa

        table = table.sort_by("bin")
        runs = table.column("items").combine_chunks()
        sizes = runs.value_lengths().to_numpy()
        edges = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.concatenate([[0], np.cumsum(runs.flatten().field("length").to_numpy())])
        bins = best_fit(np.diff(ends[edges]).tolist(), capacity)
        order = np.array([i for b in bins for i in b], dtype=np.int64)
        firsts = np.cumsum([0, *map(len, bins)])
        items = runs.take(pa.array(order)).flatten()
        made = _emit(items, np.concatenate([[0], np.cumsum(sizes[order])])[firsts], level, table.column("grp")[0].as_py(), 0, capacity, top)
        return pa.Table.from_batches([made])

    return merge


def pack(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", scope: str = "") -> DataFrame:
    """Pieces of all documents with their places in sequences of at most `capacity` tokens.

    Returns id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are one
    piece with the end id alone. Ids need not be distinct or set: each row is packed as a document.
    An empty table gives no rows. Further columns of the input are left behind.
    """
    spark = df.sparkSession
    store.bounded_batches(spark)

    def first(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from knotwork.llm.chunk_bpe import encoder

        encode, group = encoder(tokenizer).encode, TaskContext.get().partitionId()
        tail = np.array([end_id], dtype="<u4").tobytes()
        made = 0
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(0, len(ids), 1000):
                pieces = []
                for doc, run in zip(ids[k : k + 1000], encode(texts[k : k + 1000])):
                    run += tail
                    for piece, (start, length) in enumerate(cut(len(run) // 4, capacity)):
                        crc = zlib.crc32(memoryview(run)[4 * start : 4 * (start + length)])
                        pieces.append((doc, piece, start, length, crc))
                items = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*pieces), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])
                yield _emit(items, np.arange(len(pieces) + 1), 0, group, made, capacity, False)
                made += len(pieces)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    level = store.written(rows.mapInArrow(first, BIN), "packed-0", scope)
    parts, k = [level.where("done")], 0
    left = level.where("not done").count()
    while left:
        k, tasks = k + 1, -(-left // MEET)
        dealt = level.where("not done").withColumn("grp", F.pmod(F.xxhash64("bin", F.lit(k)), F.lit(tasks)).cast("int"))
        level = store.written(dealt.groupBy("grp").applyInArrow(_merger(k, tasks == 1, capacity), BIN), f"packed-{k}", scope)
        counts = level.agg(F.count("*").alias("n"), F.count_if(~F.col("done")).alias("open")).first()
        if counts["n"] == left:
            parts.append(level)
            break
        parts.append(level.where("done"))
        left = counts["open"]

    def places(batches):
        import pyarrow as pa

        for batch in batches:
            items = batch.column(1)
            sizes = np.diff(items.offsets.to_numpy())
            flat = items.flatten()
            fields = {flat.type[i].name: flat.field(i) for i in range(flat.type.num_fields)}
            length = fields["length"].to_numpy()
            ends = np.cumsum(length)
            firsts = np.cumsum(sizes) - sizes
            base = np.repeat((ends - length)[firsts] if len(flat) else np.empty(0, dtype=np.int64), sizes)
            fields["sequence_id"] = pa.array(np.repeat(batch.column(0).to_numpy(), sizes))
            fields["offset"] = pa.array(ends - length - base)
            yield pa.RecordBatch.from_arrays(list(fields.values()), list(fields))

    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return every.select("bin", "items").mapInArrow(places, schema).withColumnRenamed("doc_id", id_col)
