"""Token ids and token counts of a text column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.bpe import VOCABULARY, decoder, encoder, vocabulary
from cartulary.session import spread

#: Rows and bytes of text handled at a time.
ROWS, BYTES = 2000, 1 << 24


def texts(column: pa.Array) -> list[str | None]:
    """Python strings; bytes that are no UTF-8 become replacement characters."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ROWS rows and about BYTES of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        n = max(1, min(ROWS, int(np.searchsorted(ends, done + BYTES, "right")) - at))
        yield batch.slice(at, n)
        at += n


def token_ids(docs: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """key, ids: the whole text's ids without special tokens, in order; an empty list for
    null and for empty texts. Repeated keys stay repeated, an empty table gives no row. The
    vocabulary is read on the driver and sent along (its size is that of one file)."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(sent.value).encode
        for batch in batches:
            for part in _parts(batch):
                parts = [encode(t) for t in texts(part.column(1))]
                ends = np.cumsum([0, *map(len, parts)]) // 4
                ids = pa.array(np.frombuffer(b"".join(parts), "<i4"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(F.col(key), F.col(text))).mapInArrow(run, f"{key} {kind}, ids array<int>")


def token_counts(docs: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """key, n: the number of ids of the whole text; 0 for null and for empty texts."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(sent.value).encode
        for batch in batches:
            for part in _parts(batch):
                n = [len(encode(t)) >> 2 for t in texts(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], names=[key, "n"])

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(F.col(key), F.col(text))).mapInArrow(run, f"{key} {kind}, n bigint")


def token_texts(rows: DataFrame, key: str, ids: str, path: str = VOCABULARY) -> DataFrame:
    """key, text: the text that the ids stand for; empty for an empty list and for null. An id
    that the vocabulary lacks is an error."""
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = decoder(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = [b"".join(tokens[i] for i in own or ()).decode("utf-8", "replace") for own in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=[key, "text"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key), F.col(ids)).mapInArrow(run, f"{key} {kind}, text string")
