"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of successive documents, cut into blocks of 128 ids without regard to document
ends. Of each block the minimum is subtracted; what is left is packed at the width that a given
share of the block's ids fits in, and the ids that do not fit go to the block's exception list with
their places. An index of block starts lets a reader decode any span alone.

Layout, little-endian: magic, then n_docs, n_tokens, n_blocks (int64 each); doc_ids (int64, n_docs);
doc_starts within the file (int64, n_docs + 1); block starts in the payload (int64, n_blocks + 1);
the payload. A block: minimum (uint32), width (uint8), exceptions (uint8), 16 * width bytes of
packed offsets, exception places (uint8 each), exception offsets (uint32 each). The last block is
filled up with its minimum.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm import store

MAGIC = b"KWPFOR1\0"
BLOCK = 128
#: Ids after which a file is closed at the next document's end.
FILE_TOKENS = 1 << 21
#: Files that a task reads back, about.
FILES_A_TASK = 8
#: Share of a block's ids that the packed width has to hold.
SHARE = 0.95


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(m, 128) values below 2**width to (m, 16 * width) bytes."""
    words = np.zeros((len(values), 2 * width), dtype=np.uint64)
    columns = np.ascontiguousarray(values.T).astype(np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        words[:, word] |= columns[i] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= columns[i] >> np.uint64(64 - shift)
    return words.view(np.uint8).reshape(len(values), 16 * width)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(packed).view("<u8").reshape(len(packed), 2 * width)
    out = np.empty((BLOCK, len(packed)), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        v = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (words[:, word + 1] << np.uint64(64 - shift))
        out[i] = (v & mask).astype(np.uint32)
    return out.T


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ranges starts[i] .. starts[i] + sizes[i]."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def encode_blocks(ids: np.ndarray, share: float = SHARE) -> tuple[bytes, np.ndarray]:
    """Payload and block starts of a run of ids."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", np.zeros(1, dtype="<i8")
    full = np.empty(n * BLOCK, dtype=np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[(n - 1) * BLOCK :].min()
    full = full.reshape(n, BLOCK)
    low = full.min(axis=1)
    offset = full - low[:, None]
    bits = np.zeros((n, BLOCK), dtype=np.uint8)
    for w in range(int(offset.max()).bit_length()):
        bits += offset >> np.uint32(w) > 0
    width = np.partition(bits, max(0, int(np.ceil(share * BLOCK)) - 1), axis=1)[:, max(0, int(np.ceil(share * BLOCK)) - 1)]
    width = width.astype(np.int64)
    odd = bits > width[:, None]
    exceptions = odd.sum(axis=1)
    sizes = 6 + 16 * width + 5 * exceptions
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
    payload = np.zeros(starts[-1], dtype=np.uint8)
    at = starts[:-1]
    payload[at[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    payload[at + 4] = width
    payload[at + 5] = exceptions
    for w in np.unique(width).tolist():
        if w:
            own = np.flatnonzero(width == w)
            payload[at[own][:, None] + 6 + np.arange(16 * w)] = _pack(offset[own] & np.uint32((1 << w) - 1), w)
    rows, places = np.nonzero(odd)
    if len(rows):
        begin = at + 6 + 16 * width
        payload[_spans(begin, exceptions)] = places
        payload[_spans(begin + exceptions, 4 * exceptions)] = offset[rows, places].astype("<u4").view(np.uint8)
    return payload.tobytes(), starts


def decode_blocks(payload: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All ids of the blocks that begin at the starts (relative to the payload given)."""
    at = np.asarray(starts[:-1], dtype=np.int64)
    if not len(at):
        return np.empty(0, dtype=np.uint32)
    low = np.ascontiguousarray(payload[at[:, None] + np.arange(4)]).view("<u4").ravel()
    width = payload[at + 4].astype(np.int64)
    exceptions = payload[at + 5].astype(np.int64)
    out = np.zeros((len(at), BLOCK), dtype=np.uint32)
    for w in np.unique(width).tolist():
        if w:
            own = np.flatnonzero(width == w)
            out[own] = _unpack(payload[at[own][:, None] + 6 + np.arange(16 * w)], w)
    if exceptions.any():
        begin = at + 6 + 16 * width
        rows = np.repeat(np.arange(len(at)), exceptions)
        values = np.ascontiguousarray(payload[_spans(begin + exceptions, 4 * exceptions)]).view("<u4")
        out[rows, payload[_spans(begin, exceptions)]] = values
    return (out + low[:, None]).ravel()


def file_bytes(doc_ids: list[int], ids: list[bytes], share: float = SHARE) -> bytes:
    """A whole file of documents given by their little-endian uint32 ids."""
    sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
    payload, starts = encode_blocks(np.frombuffer(b"".join(ids), dtype="<u4"), share)
    head = struct.pack("<qqq", len(doc_ids), int(sizes.sum()), len(starts) - 1)
    doc_starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
    return MAGIC + head + np.array(doc_ids, dtype="<i8").tobytes() + doc_starts.tobytes() + starts.tobytes() + payload


class TokenFile:
    """Reads a file's index at once and its blocks as they are asked for."""

    def __init__(self, stream) -> None:
        self.stream = stream
        if stream.read(8) != MAGIC:
            raise ValueError("not a token file")
        docs, self.n_tokens, blocks = struct.unpack("<qqq", stream.read(24))
        self.doc_ids = np.frombuffer(stream.read(8 * docs), dtype="<i8")
        self.doc_starts = np.frombuffer(stream.read(8 * (docs + 1)), dtype="<i8")
        self.starts = np.frombuffer(stream.read(8 * (blocks + 1)), dtype="<i8")
        self.base = 32 + 8 * (2 * docs + 1 + blocks + 1)

    def span(self, begin: int, end: int) -> np.ndarray:
        """Ids begin .. end of the file, from the blocks that hold them."""
        if begin >= end:
            return np.empty(0, dtype=np.uint32)
        first, last = begin // BLOCK, -(-end // BLOCK)
        self.stream.seek(self.base + int(self.starts[first]))
        raw = self.stream.read(int(self.starts[last] - self.starts[first]))
        ids = decode_blocks(np.frombuffer(raw, dtype=np.uint8), self.starts[first : last + 1] - self.starts[first])
        return ids[begin - first * BLOCK : end - first * BLOCK]

    def documents(self, step: int = 1 << 19):
        """(doc_id, start in the file, ids) of each document, in order."""
        ids, at, k = np.empty(0, dtype=np.uint32), 0, 0
        for doc, a, b in zip(self.doc_ids.tolist(), self.doc_starts.tolist(), self.doc_starts[1:].tolist()):
            if b > at + len(ids):
                rest = ids[a - at :]
                upto = min(self.n_tokens, max(b, at + len(ids) + step))
                ids, at, k = np.concatenate([rest, self.span(at + len(ids), upto)]), a, 0
            yield doc, a, ids[a - at : b - at]


def open_uri(uri: str, mode: str):
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri)
    if mode == "rb":
        return fs.open_input_file(path)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path)


def write_token_files(df: DataFrame, tokenizer: str, folder: str, end_id: int, parts: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all texts in ascending id order; returns the manifest, one row a file.

    Null and empty texts hold the end id alone. Equal ids keep all their rows, in order of text.
    Null ids are refused: the order would not be defined. Each attempt of a task writes under a name
    of its own and the manifest names those of the attempt that succeeded, so a lost executor leaves
    at worst files that no manifest names. Manifest: part, file, uri, n_docs, n_tokens, start.
    """
    store.bounded_batches(df.sparkSession)

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        from knotwork.llm.chunk_bpe import encoder

        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        tail = np.array([end_id], dtype="<u4").tobytes()
        docs, ids, held, file = [], [], 0, 0

        def flush():
            uri = f"{folder}/part-{part:06d}-{file:06d}-{uuid.uuid4().hex[:8]}.kwp"
            with open_uri(uri, "wb") as out:
                out.write(file_bytes(docs, ids))
            return pd.DataFrame({"part": [part], "file": [file], "uri": [uri], "n_docs": [len(docs)], "n_tokens": [held]})

        for pdf in batches:
            for k in range(0, len(pdf), 1000):
                part_rows = pdf.iloc[k : k + 1000]
                if part_rows["id"].isna().any():
                    raise ValueError("token files need document ids that are not null")
                docs += part_rows["id"].astype("int64").tolist()
                new = [x + tail for x in encode([t if isinstance(t, str) else None for t in part_rows["text"]])]
                ids += new
                held += sum(map(len, new)) // 4
                if held >= FILE_TOKENS:
                    yield flush()
                    docs, ids, held, file = [], [], 0, file + 1
        if docs:
            yield flush()

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    made = store.written(rows.mapInPandas(run, "part int, file int, uri string, n_docs long, n_tokens long"), "token-manifest")
    order = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("start", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).cast("long"))


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, start (ids of all documents before it), n_tokens, ids_crc32 of its ids.

    A task holds the rows of one file and the blocks of one document at a time, however long the text.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for uri, start in zip(pdf["uri"], pdf["start"]):
                with open_uri(uri, "rb") as stream:
                    rows = [(d, start + a, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, a, x in TokenFile(stream).documents()]
                yield pd.DataFrame(rows, columns=["id", "start", "n_tokens", "ids_crc32"])

    # The manifest is small, but what its rows stand for is not: a task for every few files.
    files = manifest.count()
    tasks = max(min(files, 4 * manifest.sparkSession.sparkContext.defaultParallelism), -(-files // FILES_A_TASK), 1)
    spread = manifest.select("uri", "start").repartition(tasks, "uri")
    out = spread.mapInPandas(run, "id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)
