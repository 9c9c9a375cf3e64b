"""Exact deduplication by a stateful stream.

Documents are reduced to a compact landing table (digest of the normalised text, stable identifier, length
and row locator). A Structured Streaming query reads that table and keeps, for each digest, the best row and
the number of rows in disk-backed (RocksDB) keyed state that never expires. A folder named by `checkpoint` keeps rows, landing table
and state of all runs, so that the documents of a later run meet those of earlier ones. Rows are combined before they are shuffled, so
a hot group costs one row for each task. Digests seen more than once are hits: for these the locators lead back
to the texts, whose full bytes are compared; should they differ under one digest, the rows are grouped by text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import numbered, scratch_path, sized, staged, with_row_id, without

#: The characters that don't count.
SPACE = " \t\n\x0b\x0c\r"

#: State on disk; without preallocated files, which would outweigh the state where there are many partitions, and with
#: one bound on the native memory of all stores of an executor.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
}
NO_ID = 9223372036854775807


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def sha256(text: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of a string's UTF-8 form."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def landing_rows(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One compact row for each document: `_rid`, `doc_id`, `digest`, `n_chars` (code points of the original)."""
    return _landing_rows(with_row_id(docs.select("doc_id", "text")), digest)


def _landing_rows(texts: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """`landing_rows` of texts that have their `_rid`."""
    return texts.select(
        "_rid", F.col("doc_id").cast("bigint").alias("doc_id"), digest(normalised(F.col("text"))).alias("digest"), F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars")
    )


def _best() -> list[Column]:
    """Of a group: its size and the row that stays (most code points, then smallest identifier, then first row)."""
    best = F.max(F.struct(F.col("n_chars"), (-F.coalesce("doc_id", F.lit(NO_ID))).alias("i"), (-F.col("_rid")).alias("r")))
    return [F.count(F.lit(1)).alias("group_size"), best.alias("best")]


def stream_state(landing: DataFrame, path: str, checkpoint: str, out: str, files_per_batch: int = 256) -> DataFrame:
    """Run the landing folder through keyed state; returns the newest state row of each digest this run touched.

    Each micro-batch appends the groups that it changed; the largest `group_size` of a digest is its newest row.
    """
    spark = landing.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(landing.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
        state = rows.groupBy("digest").agg(*_best())

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    changed = spark.read.schema(state.schema).parquet(f"{out}/batch=*")
    newest = changed.groupBy("digest").agg(F.max(F.struct("group_size", "best")).alias("s"))
    return newest.select("digest", "s.group_size", "s.best")


def decide(docs: DataFrame, digest: Callable[[Column], Column] = sha256, checkpoint: str | None = None) -> DataFrame:
    """One row for each document: `_rid`, `doc_id`, `keep_id`, `group_size`, `kept`, `digest`.

    `docs` is a table scan with `doc_id` and `text`; other columns are ignored. Null texts equal empty ones and
    texts of white space alone. Of equal texts the row with the most code points stays, then the smallest
    `doc_id` (null last), then the first row, so of fully repeated rows one stays. An empty table gives no rows.
    With a `checkpoint` folder the groups include the documents of all earlier runs that named it; each call adds its documents once.
    """
    if checkpoint is None:
        return _decide(numbered(docs.select("doc_id", "text"), "numbered"), digest)
    spark, folder = docs.sparkSession, checkpoint.rstrip("/")
    jvm = spark.sparkContext._jvm
    landing = jvm.org.apache.hadoop.fs.Path(f"{folder}/landing")
    first = 0
    if landing.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(landing):
        first = (spark.read.parquet(f"{folder}/landing").agg(F.max("_rid")).first()[0] or -1) + 1
    rows = with_row_id(docs.select("doc_id", "text")).select((F.col("_rid") + first).alias("_rid"), F.struct("doc_id", "text").alias("_row"))
    path = f"{folder}/rows/from={first}"
    rows.write.option("compression", "zstd").parquet(path)
    new, every = (spark.read.schema(rows.schema).parquet(x) for x in (path, f"{folder}/rows/from=*"))
    return _decide(new, digest, folder, first, every)


def _decide(rows: DataFrame, digest: Callable[[Column], Column] = sha256, folder: str | None = None, first: int = 0, every: DataFrame | None = None) -> DataFrame:
    """`decide` of a `numbered` table, the rows from `first` on among `every`, whose landing table and state are in the folder."""
    spark = rows.sparkSession
    folder, every = folder or scratch_path(spark, "dedup"), rows if every is None else every
    path = f"{folder}/landing"
    compact = _landing_rows(rows.select("_rid", "_row.doc_id", "_row.text"), digest)
    compact.write.mode("append").option("compression", "zstd").parquet(path)
    landing = spark.read.schema(compact.schema).parquet(path).filter(F.col("_rid") >= first)
    if landing.isEmpty():
        return landing.select("_rid", "doc_id", F.lit(None).cast("bigint").alias("keep_id"), F.lit(0).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "digest")
    state = staged(stream_state(landing, path, f"{folder}/state", scratch_path(spark, "batches")), "groups")

    read = every.select("_rid", "_row.doc_id", "_row.text")
    hits = state.filter("group_size > 1").select("digest")
    texts = read.select("_rid", "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"), normalised(F.col("text")).alias("t")).withColumn("digest", digest(F.col("t")))
    met = texts.join(sized(hits), "digest", "left_semi")
    differ = staged(met.groupBy("digest").agg(F.min("t").alias("a"), F.max("t").alias("b")).filter("a != b").select("digest"), "collisions")

    if differ.isEmpty():
        joined = landing.join(state, "digest")
    else:
        apart = texts.join(differ, "digest", "left_semi")
        groups = apart.groupBy("digest", "t").agg(*_best())
        joined = landing.join(differ, "digest", "left_anti").join(state, "digest").unionByName(apart.filter(F.col("_rid") >= first).join(groups, ["digest", "t"]).drop("t"))
    keep = -F.col("best.i")
    return joined.select(
        "_rid",
        "doc_id",
        F.when(keep != NO_ID, keep).alias("keep_id"),
        "group_size",
        (F.col("_rid") == -F.col("best.r")).alias("kept"),
        "digest",
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of a table scan that stay, with all its columns."""
    rows = numbered(docs, "numbered")
    dropped = staged(_decide(rows).filter("not kept").select("_rid"), "dropped")
    return without(rows, dropped)
