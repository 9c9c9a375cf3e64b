"""Exact top-k search by inner product with a pivot-distance index.

Integer vectors are lifted by one coordinate so that all have the same norm; then the largest inner product is the
smallest Euclidean distance. Every vector is keyed by its nearest pivot and its distance to it; sorted by that key,
the index is cut into blocks, each an annulus around a pivot. By the triangle inequality an annulus [lo, hi] around
a pivot at distance d of a query holds nothing nearer than max(d - hi, lo - d); a block also keeps the least and largest
distance of its vectors to some other pivots, and the largest of these bounds counts. A query expands its annuli in the order of
their bounds, in rounds: after each its k-th best score so far rules out annuli, and it stops when none is left within reach.
On data without structure the bounds exclude little; what remains then is a blocked matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.llm.common import staged, with_row_id

#: Vectors from which the pivots are fitted, at most; every vector is indexed.
FIT_ROWS = 4096
#: Pivots, at most (about the root of the number of vectors), and those among them to which blocks keep their distances.
PIVOTS = 512
BOX_PIVOTS = 32
#: Vectors in one block of the index (more where the index would have over MOST_BLOCKS blocks), queries scored
#: together, and queries sent to a block in one row.
BLOCK_ROWS = 1024
MOST_BLOCKS = 20_000
QUERY_ROWS = 256
SLICE_ROWS = 4096
SCALE = 256
#: Annuli that a query expands in each round; in the last one all that are left within reach.
ROUNDS = (1, 6, 36)
#: Squared norm up to which sums of products are exact in double precision; vectors beyond are never ruled out and multiplied as
#: whole numbers of any size.
EXACT = 2.0**52
LONG = 2**63


def _quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """`_rid`, `vec_id`, `v` (little-endian doubles, whole numbers), `sq` (squared norm) of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, ids, vs, sq = [], [], [], []
            for rid, vec_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if vec_id is None or x is None or any(c is None for c in x):
                    continue
                v = np.array(x, np.float64)
                if not np.isfinite(v).all():
                    continue
                # beyond the range of doubles the product is infinite; those of 2^53 and more are whole numbers already
                v = np.where(np.abs(v) < 2.0**53, np.floor(scale * v), np.clip(v, -(2.0**1000), 2.0**1000) * scale)
                rids.append(rid)
                ids.append(vec_id)
                vs.append(v.astype("<f8").tobytes())
                with np.errstate(over="ignore"):
                    sq.append(float(v @ v))
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(ids, pa.int64()), pa.array(vs, pa.binary()), pa.array(sq, pa.float64())], ["_rid", "vec_id", "v", "sq"])

    return with_row_id(vectors.select(F.col("vec_id").cast("bigint"), "embedding")).select("_rid", "vec_id", "embedding").mapInArrow(run, "_rid bigint, vec_id bigint, v binary, sq double")


def _matrix(blobs: list[bytes], dim: int, kind: str = "<f8") -> np.ndarray:
    """Rows of vectors; those of fewer than `dim` components end in zeros."""
    width = np.dtype(kind).itemsize
    if all(len(b) == width * dim for b in blobs):
        return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), dim).astype(np.float64)
    out = np.zeros((len(blobs), dim))
    for row, b in zip(out, blobs, strict=True):
        row[: len(b) // width] = np.frombuffer(b, kind)
    return out


def _fit(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Pivots by a few rounds of k-means over a bounded sample."""
    rng = np.random.default_rng(7)
    centres = sample[rng.choice(len(sample), min(pivots, len(sample)), replace=False)].copy()
    for _ in range(6):
        near = np.argmin((centres**2).sum(1) - 2 * sample @ centres.T, axis=1)
        for k in range(len(centres)):
            if (own := near == k).any():
                centres[k] = sample[own].mean(0)
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * x @ centres.T, 0))


def _whole_products(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Inner products of rows with a query, as whole numbers of any size."""
    own = [int(c) for c in q]
    return [sum(int(a) * b for a, b in zip(row, own, strict=True)) for row in x]


def search(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE, shares: list[float] | None = None) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: for each query its k best candidates by integer inner product.

    `vectors` has `vec_id` and `embedding` (array of numbers); each component x becomes floor(scale * x). Every row
    whose id is divisible by `every` is a query, also where rows share an id; its candidates are all other rows. Ties go to the
    smaller id. Vectors that are null or hold null or non-finite components, and those without an id, take no part. Missing
    trailing components count as zeros. With fewer candidates than k all are returned; an empty table gives
    no rows. Scores are exact; one outside the range of a long is returned as the nearest long and ranked as that.
    The pivots are fitted on at most FIT_ROWS vectors, every vector is indexed. The share of all pairs of a query and a vector
    that lie in visited blocks is appended to `shares`, if given.
    """
    spark = vectors.sparkSession
    rows = staged(_quantised(vectors, scale), "vectors")
    usual = F.col("sq") < EXACT
    is_query = F.col("vec_id") % every == 0
    top = rows.agg(F.max(F.when(usual, F.col("sq"))), F.max(F.length("v")), F.count(F.lit(1)), F.count_if(is_query)).first()
    if not top[3]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    norm, dim = top[0] or 0.0, top[1] // 8
    slack = 1e-3 + 1e-6 * norm**0.5  # rounding of float distances must never rule out an answer
    block_rows, deals = max(BLOCK_ROWS, -(-top[2] // MOST_BLOCKS)), -(-top[3] // SLICE_ROWS)
    fit = rows.filter(usual).orderBy(F.xxhash64("vec_id", "v")).limit(FIT_ROWS).select("v").collect()

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(norm - (x**2).sum(1), 0))[:, None]])

    sample = lifted(_matrix([r.v for r in fit], dim)) if fit else np.zeros((1, dim + 1))
    centres = _fit(sample, int(min(PIVOTS, max(16, top[2] ** 0.5))))
    box = min(BOX_PIVOTS, len(centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                plain = batch.column(3).to_numpy() < EXACT
                near, dist = np.full(len(plain), -1), np.zeros(len(plain))
                if plain.any():
                    d = _distances(lifted(_matrix(batch.column(2).filter(pa.array(plain)).to_pylist(), dim)), centres)
                    near[plain] = d.argmin(1)
                    dist[plain] = d.min(1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(near, pa.int32()), pa.array(dist, pa.float64())], ["_rid", "vec_id", "v", "pivot", "dist"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by pivot and distance become blocks of one pivot each."""
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            nonlocal number
            rid, ids, v, pivot, dist = (pa.concat_arrays([b.column(c) for b in held]) for c in range(5))
            own, x = pivot[0].as_py(), _matrix(v.to_pylist(), dim)
            dist = dist.to_numpy()
            d = _distances(lifted(x), centres[:box]) if own >= 0 else np.zeros((1, box))
            # vectors of any size are kept as they are
            values = ((number, pa.int64()), (own, pa.int32()), (len(ids), pa.int64()), (dist[0], pa.float64()), (dist[-1], pa.float64()), (d.min(0).tolist(), pa.list_(pa.float64())), (d.max(0).tolist(), pa.list_(pa.float64())),
                      (rid.to_numpy().tobytes(), pa.binary()), (ids.to_numpy().tobytes(), pa.binary()), (x.astype("<i4" if own >= 0 else "<f8").tobytes(), pa.binary()))
            number += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in values], ["block", "pivot", "n", "lo", "hi", "least", "most", "rids", "ids", "x"])

        for batch in batches:
            pivot, start = batch.column(3).to_numpy(), 0
            while start < len(pivot):
                if held and held[0].column(3)[0].as_py() != pivot[start]:
                    yield block()
                have = sum(b.num_rows for b in held)
                end = min(int(np.searchsorted(pivot, pivot[start], "right")), start + block_rows - have)
                held.append(batch.slice(start, end - start))
                if have + end - start >= block_rows:
                    yield block()
                start = end
        if held:
            yield block()

    keyed = rows.mapInArrow(assign, "_rid bigint, vec_id bigint, v binary, pivot int, dist double")
    ranged = keyed.repartitionByRange("pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
    index = staged(ranged.mapInArrow(cut, "block bigint, pivot int, n bigint, lo double, hi double, least array<double>, most array<double>, rids binary, ids binary, x binary"), "index")
    shapes = index.select("block", "pivot", "n", "lo", "hi", "least", "most").collect()  # MOST_BLOCKS narrow rows, and some at the ends of partitions and pivots
    shape = spark.sparkContext.broadcast(tuple(np.array(c) for c in zip(*shapes, strict=True)))

    def bounds(q: np.ndarray) -> np.ndarray:
        """Distance below which a block holds nothing, for each query and block; 0 for blocks of vectors of any size."""
        _, pivot, _, lo, hi, least, most = shape.value
        d = _distances(np.hstack([q, np.zeros((len(q), 1))]), centres)
        low = np.maximum(d[:, pivot] - hi, lo - d[:, pivot])
        for p in range(box):
            own = d[:, p : p + 1]
            np.maximum(low, np.maximum(own - most[:, p], least[:, p] - own), out=low)
        return np.where(pivot >= 0, np.maximum(low, 0), 0)

    def route(most_blocks: int | None):
        """For each query the unvisited annuli within reach, nearest first, so many at most."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shape.value[0]
            for whole_batch in batches:
                for at in range(0, whole_batch.num_rows, 64):
                    batch = whole_batch.slice(at, 64)
                    q, sq = _matrix(batch.column(1).to_pylist(), dim), batch.column(2).to_numpy()
                    plain = sq < EXACT
                    low = bounds(np.where(plain[:, None], q, 0))
                    low[~plain] = 0
                    chosen = []
                    for row, x, least, visited in zip(low, sq, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                        reach = np.inf if least is None or not x < EXACT else np.sqrt(max(x + norm - 2 * float(least), 0)) + slack
                        left = np.flatnonzero(row <= reach)
                        left = left[~np.isin(block[left], visited)] if visited else left
                        chosen.append(block[left[np.argsort(row[left], kind="stable")[:most_blocks]]])
                    yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(chosen, pa.list_(pa.int64()))], ["query", "v", "sq", "least", "blocks"])

        return run

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row: an annulus and the queries that visit it."""
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for row in batch.to_pylist():
                rids, ids = np.frombuffer(row["rids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                plain = row["pivot"] >= 0
                x = np.frombuffer(row["x"], "<i4" if plain else "<f8").reshape(len(ids), dim).astype(np.float64)
                for s in range(0, len(row["qs"]), QUERY_ROWS):
                    part = row["qs"][s : s + QUERY_ROWS]
                    q = _matrix([p["v"] for p in part], dim)
                    with np.errstate(all="ignore"):
                        product = q @ x.T
                    for p, own, got in zip(part, q, product, strict=True):
                        if not plain or not p["sq"] < EXACT:
                            got = np.array([max(min(y, LONG - 1), -LONG) for y in _whole_products(x, own)], np.int64)
                        else:
                            got = got.astype(np.int64)
                        ok = np.flatnonzero(rids != p["query"])
                        if p["least"] is not None:
                            ok = ok[got[ok] >= p["least"]]
                        if len(ok) > k:
                            edge = np.partition(got[ok], len(ok) - k)[len(ok) - k]
                            ok = ok[got[ok] >= edge]
                        for b in ok[np.lexsort((ids[ok], ~got[ok]))[:k]]:
                            found.append((p["query"], int(ids[b]), int(got[b])))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*found, strict=True)) or [[], [], []]], ["query", "vec_id", "score"])

    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    queries = rows.filter(is_query).select(F.col("_rid").alias("query"), F.col("vec_id").alias("query_id"), "v", "sq")
    found, visited, seen = None, None, 0
    for most_blocks in (*ROUNDS, None):
        state = queries.drop("query_id")
        if found is None:
            state = state.withColumn("least", F.lit(None).cast("bigint")).withColumn("visited", F.lit(None).cast("array<bigint>"))
        else:
            known = found.filter(F.col("rank") == k).select("query", F.col("score").alias("least"))
            state = state.join(known, "query", "left").join(visited.groupBy("query").agg(F.flatten(F.collect_list("blocks")).alias("visited")), "query", "left")
        routed = staged(state.select("query", "v", "sq", "least", "visited").mapInArrow(route(most_blocks), "query bigint, v binary, sq double, least bigint, blocks array<bigint>").filter("size(blocks) > 0"), "routed")
        sent = routed.select(F.explode("blocks").alias("block")).groupBy("block").count().join(index.select("block", "n"), "block").agg(F.sum(F.col("count") * F.col("n"))).first()[0]
        if not sent:
            break
        seen += sent
        slices = routed.select("query", "v", "sq", "least", F.explode("blocks").alias("block")).groupBy("block", F.pmod(F.xxhash64("query"), F.lit(deals)).alias("s")).agg(F.collect_list(F.struct("query", "v", "sq", "least")).alias("qs"))
        now = index.join(slices, "block").select("pivot", "rids", "ids", "x", "qs").mapInArrow(score, "query bigint, vec_id bigint, score bigint")
        both = now if found is None else found.drop("rank").unionByName(now)
        found = staged(both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "found")
        visited = routed.select("query", "blocks") if visited is None else visited.union(routed.select("query", "blocks"))
    if shares is not None:
        shares.append(seen / (top[2] * top[3]))
    return found.join(queries.select("query", "query_id"), "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
