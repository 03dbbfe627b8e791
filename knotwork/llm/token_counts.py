"""Exact token counts at every prefix, kept as a table that answers budget questions.

`prefix_table` runs the dynamic programme of `chunk_bpe.PrefixCounter` over whole texts and stores,
for each code point, by how much the token count of the prefix changes (one signed byte). What a
truncation costs, or how much text a budget buys, is then read off without encoding anything again.

Nulls and empty texts count no tokens. Very long texts are counted whole, in time and memory that grow
with their length. A vocabulary with tokens of more than 128 bytes is refused: a completed token may
then lower a prefix's count by more than a signed byte holds. Rows are independent: repeated ids give repeated rows, and
any further columns of the input are left behind, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from knotwork.llm import store


def prefix_table(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and prefix_deltas of each row, from one pass over its text."""
    store.bounded_batches(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        from knotwork.llm.chunk_bpe import counter

        count = counter(tokenizer).count
        for batch in batches:
            texts = batch.column(1).to_pylist()
            deltas = count(texts)
            columns = [
                batch.column(0),
                pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                pa.array([int(np.frombuffer(d, np.int8).sum(dtype=np.int64)) for d in deltas], pa.int64()),
                pa.array(deltas, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_tokens", "prefix_deltas"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, prefix_deltas binary")
    return out.withColumnRenamed("id", id_col)


@pandas_udf(LongType())
def _tokens_at(deltas: pd.Series, chars: pd.Series) -> pd.Series:
    return pd.Series([None if d is None or n is None else int(np.frombuffer(d, np.int8)[: max(0, int(n))].sum(dtype=np.int64)) for d, n in zip(deltas, chars)], dtype="Int64")


@pandas_udf(LongType())
def _chars_within(deltas: pd.Series, budget: pd.Series) -> pd.Series:
    out = []
    for d, n in zip(deltas, budget):
        if d is None or n is None or n < 0:
            out.append(None)
            continue
        counts = np.concatenate([[0], np.cumsum(np.frombuffer(d, np.int8), dtype=np.int64)])
        out.append(int(np.flatnonzero(counts <= n)[-1]))
    return pd.Series(out, dtype="Int64")


def tokens_at(deltas: Column, chars: Column | int) -> Column:
    """Tokens of the prefix of so many code points (all of them, if the text is shorter)."""
    return _tokens_at(deltas, chars if isinstance(chars, Column) else F.lit(chars))


def chars_within(deltas: Column, budget: Column | int) -> Column:
    """Code points of the longest prefix that takes no more tokens than the budget; null below zero."""
    return _chars_within(deltas, budget if isinstance(budget, Column) else F.lit(budget))


def over_limit(df: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and whether the tokens exceed the limit, off the prefix table."""
    return prefix_table(df, tokenizer, id_col, text_col).select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
