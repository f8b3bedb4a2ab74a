"""Encoding of a corpus by a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.llm.tokenizing import TOKENIZER_DIR, UnitTable, engine, numbered

#: Characters encoded at a time by a worker.
SLICE_CHARS = 4_000_000


def text_slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` characters; a longer text is a range of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t)
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def token_offsets(table: UnitTable, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the tokens of each text start among those of all texts, and where the last ends."""
    per = np.concatenate(([0], np.cumsum(table.count[flat])))
    return per[np.concatenate(([0], np.cumsum(sizes)))]


def encode_texts(df: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(id, ids): the token ids of each text, without special tokens.

    Whole texts are encoded in one pass without a shuffle. Null and empty texts give
    an empty list, strings that look like special tokens are ordinary text, repeated
    rows are encoded again, a null id stays null. Other columns, whatever their names,
    are not read. An empty table gives an empty table.
    """
    folder = folder or TOKENIZER_DIR
    id_type = df.schema[id_col].dataType
    slim = df.select(F.col(id_col).alias("_k"), F.col(text_col).cast("string").alias("_t"))

    def run(batches):
        eng = engine(tokenizer, folder)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in text_slices(texts):
                for which, _, flat, sizes in numbered(texts[a:b], [eng]):
                    table = eng.table()
                    offsets = token_offsets(table, flat, sizes).astype(np.int32)
                    rows = batch.column(0).take(pa.array(np.asarray(which) + a))
                    yield pa.RecordBatch.from_arrays([rows, pa.ListArray.from_arrays(pa.array(offsets), pa.array(table.ids[table.gather(flat)]))], names=["_k", "ids"])

    out = slim.mapInArrow(run, f"_k {id_type.simpleString()}, ids array<int>")
    return out.withColumnRenamed("_k", id_col)


def count_tokens(df: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k", folder: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, n_tokens): the number of tokens of each text, 0 for null and empty texts."""
    folder = folder or TOKENIZER_DIR
    kept = [F.col(c) for c in (id_col, *keep)]
    slim = df.select(*kept, F.col(text_col).cast("string").alias("_t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]) + ", n_tokens bigint"

    def run(batches):
        eng = engine(tokenizer, folder)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            counts = np.zeros(len(texts), dtype=np.int64)
            for a, b in text_slices(texts):
                for which, _, flat, sizes in numbered(texts[a:b], [eng]):
                    counts[np.asarray(which) + a] = np.diff(token_offsets(eng.table(), flat, sizes))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts)], names=[*batch.schema.names[:-1], "n_tokens"])

    return slim.mapInArrow(run, schema)
