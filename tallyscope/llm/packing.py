"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two of the binary form of n,
longest first; what exceeds the context is first cut into whole contexts. Pieces of one length form a
bucket. A sequence is one piece, so no sequence crosses documents and, as every length is a power of
two, none is padded. A training batch is drawn from a single bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyscope.llm import encoding
from tallyscope.llm.common import rows_of

CONTEXT = 2048

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, bucket int"
IDS = ", ids binary"


def lengths(n: int, context: int = CONTEXT) -> list[int]:
    """Piece lengths of a document of n tokens, longest first; they sum to n."""
    whole, rest = divmod(n, context)
    return [context] * whole + [1 << k for k in range(context.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, vocabulary: str | None = None, context: int = CONTEXT, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, one row each, in one narrow pass without a shuffle.

    `docs` has `doc_id` and `text`; other columns are ignored. Null and empty texts give the end id alone,
    so one piece of length 1. A null `doc_id` stays null; repeated rows are packed once each. Very long
    texts give many pieces. An empty table gives no rows. `context` is a power of two. With `with_ids`
    the pieces carry their ids (unsigned 32-bit, little endian) for a writer.
    """
    if context < 1 or context & (context - 1):
        raise ValueError("context must be a power of two")
    path = vocabulary or encoding.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoding.encoder(path)
        end = encoding.END_ID.to_bytes(4, "little")
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 38
        for batch, texts in rows_of(batches, "text"):
            doc_ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            out: list[list] = [[] for _ in range(9)]
            for doc_id, text in zip(doc_ids, texts, strict=True):
                ids = enc.ids(text) + end
                total, start = len(ids) // 4, 0
                for length in lengths(total, context):
                    part = ids[4 * start : 4 * (start + length)]
                    row = (doc_id, start, length, encoding.crc32(part), total, number, 0, length.bit_length() - 1, part)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    start += length
                    number += 1
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "ids"]
            keep = 9 if with_ids else 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out[:keep], kinds, strict=False)], names[:keep])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA + (IDS if with_ids else ""))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write packed pieces (with ids) as one folder for each length, from which batches of equal length are drawn."""
    pieces.write.partitionBy("bucket").parquet(path)
