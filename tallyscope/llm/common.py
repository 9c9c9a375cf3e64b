"""Helpers shared by the training-data operators: tables, scratch storage, bounded joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.sources.shipping import ship_code

#: Bytes that a side may have to be broadcast.
BROADCAST_BYTES = 16_000_000

#: Rows that a Python map takes up at once. The bytes of an Arrow batch are bounded by Spark itself
#: (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set otherwise).
ARROW_ROWS = 1_000

_own_scratch: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, a Parquet file or folder."""
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster. Only where the session names none and runs on one machine, a temporary one."""
    global _own_scratch
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if _own_scratch is None:
        _own_scratch = "file://" + tempfile.mkdtemp(prefix="tallyscope-")
    return _own_scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    It cuts the lineage and survives lost executors, and later reads prune columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame) -> DataFrame:
    """Mark a narrow table for broadcasting if its bytes, counted, are few; else Spark shuffles both sides."""
    kinds = [(F.col(f"`{f.name}`"), f.dataType.typeName()) for f in df.schema.fields]
    varying = [F.length(c) + 32 if k in ("string", "binary") else F.size(c) * 8 + 32 for c, k in kinds if k in ("string", "binary", "array")]
    width = sum((F.coalesce(c, F.lit(0)) for c in varying), F.lit(24 + 8 * (len(kinds) - len(varying))))
    size = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def whole(df: DataFrame, name: str = "_row") -> Column:
    """All columns of a table as one struct, so that an operator's own names never clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """A table with its rows numbered: `_rid` and `_row`, all its columns, written once to the shared folder.

    A second scan may be split otherwise (splits follow the cores that the cluster has at that time), so every later read
    of a number and of what belongs to it has to come from this table.
    """
    return staged(with_row_id(df.select(whole(df))), name)


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of a `numbered` table whose number isn't in `dropped` (`_rid`), with all their columns."""
    return rows.join(sized(dropped), "_rid", "left_anti").select("_row.*")


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """Number the rows within one plan; another plan over the same files may number them otherwise."""
    return df.withColumn(name, F.monotonically_increasing_id())


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of the identifier as text."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))


def rows_of(batches: Iterator, column: str, rows: int = ARROW_ROWS) -> Iterator:
    """Pairs of an Arrow batch, of `rows` rows at most, and the Python list of one of its columns.

    At the end the worker, which Spark keeps for later tasks, gives what it no longer needs back to the system.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, part.column(part.schema.get_field_index(column)).to_pylist()
    release_memory()


def release_memory() -> None:
    """Return freed memory of this Python worker to the system, where the C library can."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
