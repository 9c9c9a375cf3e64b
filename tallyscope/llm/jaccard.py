"""N-gram Jaccard join by vertical partitioning.

The distinct word n-grams of a text are hashed to 64 bits; the order of the hashes is the global order, and it is
cut into fragments. Two sets with a Jaccard similarity of t or more differ in at most (1 - t) / t of the smaller
size, d elements, so a set of which more than d fragments hold something agrees with every partner in one of these. Pairs
of different texts are sought only among sets that have a whole non-empty fragment in common; a set with too few such
fragments is also cut by other bits, up to CUTS times, and only what then still has too few compares its empty ones. Overlaps of such pairs are counted in vertical fragments of the global order, one after the other, and summed per pair.

Equal sets are one class from the start, and classes stand for their copies. Within a bucket of classes that share
a fragment, each class is first compared with one of them (of the most central ones of its buckets, the one that it shares
most with), which joins most of a group of near copies. Only then are classes of different components in one bucket compared
with each other, in blocks, by parity sketches whose distance never exceeds the true one. Of the pairs that these allow a task keeps a
spanning forest; its components are groups outside of which no further link can lie, and within a group all pairs of different
components are counted exactly, block by block, of whose links again a spanning forest is kept. So no link is lost, and no group is spelled out as pairs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import numbered, release_memory, rows_of, sized, staged, without
from tallyscope.llm.components import components

#: Ratio of the sizes that share a number of fragments.
SIZE_STEP = 1.5
#: Ways to cut a set into fragments, tried until enough of them hold something.
CUTS = 6
#: Bits of the smallest parity sketch; others have the power of two from the size of their set on.
SKETCH_BITS = 256
#: Elements of a set in one vertical fragment, about; longer sets are cut into more fragments.
FRAGMENT = 512
#: Fragment keys aimed at in one bucket task (16 bytes each).
TASK_KEYS = 1_000_000
#: Classes in one block of a bucket or of a group.
BLOCK = 512

_U = np.uint64


def gram_hashes(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; with fewer words, of the whole sequence; empty without words."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh3_64_intdigest
    a = np.array([h(w) for w in words], dtype=np.uint64)
    size = min(n, len(a))
    with np.errstate(over="ignore"):
        s = np.full(len(a) - size + 1, size, np.uint64)
        for k in range(size):
            s = (s ^ (s >> _U(31))) * _U(0x9E3779B97F4A7C15) + a[k : len(a) - size + 1 + k]
        s ^= s >> _U(30)
        s *= _U(0xBF58476D1CE4E5B9)
        s ^= s >> _U(27)
        s *= _U(0x94D049BB133111EB)
        s ^= s >> _U(31)
    return np.unique(s)


def size_class(size: int) -> int:
    """Number of the range, from a power of SIZE_STEP to the next, in which a size lies."""
    return int(math.log(max(size, 1)) / math.log(SIZE_STEP) + 1e-9)


@functools.cache
def fragments_of(k: int, num: int, den: int) -> tuple[int, int, int]:
    """Largest size of a class, the number of fragments in which its sets are cut, and the number of ways to cut them.

    There are at least two fragments more than differences, and if possible so many that even in the largest sets more
    fragments than differences are rarely empty; only then further cuts help a set in which they are.
    """
    top = math.ceil(SIZE_STEP ** (k + 1))
    d = top * (den - num) // num
    for m in range(d + 2, 2 * d + 3):
        empty = m * math.exp(-top / m)
        if m - empty - 2 * math.sqrt(empty) > d:
            return top, m, CUTS
    return top, d + 2, 1


def fragment_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the fragments of a set, for its own size class and those in which a smaller partner may lie.

    A set with more non-empty fragments than differences agrees in one of them with every partner. One with fewer has also the
    keys of the next cut, by other bits; if even the last cut leaves it too few, those of the empty fragments of that cut. So at
    the first cut that suffices for one of two partners, or at the last, both have all the keys that are needed.
    """
    least = max(1, -(-len(s) * num // den))
    out = []
    for k in range(size_class(least), size_class(len(s)) + 1):
        top, m, cuts = fragments_of(k, num, den)
        d = min(len(s), top) * (den - num) // num
        for cut in range(cuts):
            h = s
            if cut:
                h = (s ^ _U(cut * 0x9FB21C651E98DF25 & (1 << 64) - 1)) * _U(0xFF51AFD7ED558CCD)
                h = np.sort((h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53))
            mixed = (h ^ (h >> _U(29))) * _U(0xD6E8FEB86659FD93)
            f = ((h >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
            start = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
            keys, own = np.add.reduceat(mixed, start), f[start]
            enough = len(own) > d
            if not enough and cut == cuts - 1:
                empty = np.setdiff1d(np.arange(m), own, assume_unique=True)
                keys, own = np.concatenate((keys, np.zeros(len(empty), np.uint64))), np.concatenate((own, empty))
            place = own.astype(np.uint64) * _U(0xA0761D6478BD642F) + _U(k + 1) * _U(0xE7037ED1A0B428DB) + _U(cut) * _U(0x589965CC75374CC3)
            keys = (keys ^ place) * _U(0x8EBC6AF09C88C6E3)
            out.append(keys ^ (keys >> _U(32)))
            if enough:
                break
    return np.concatenate(out)


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the hashes that fall on each bit, as longs; the bits in which two sketches differ never outnumber the differences.

    The number of bits follows the size of the set, so that long texts don't fill theirs. A sketch folds to half its length
    by exclusive or of its halves, so those of different lengths compare at the shorter one.
    """
    bits = max(SKETCH_BITS, 1 << (len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def folded(sketch: np.ndarray, longs: int) -> np.ndarray:
    """A sketch at a shorter length."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, longs), axis=0)


def _sets(rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Of a `numbered` table: `_rid`, `doc_id`, `n` (set size), `d1`, `d2` (digest of the set), `sketch`, `keys` (its fragments' keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch, texts in rows_of(batches, "text"):
            size, d1, d2, sketch, keys = [], [], [], [], []
            with np.errstate(over="ignore"):
                for text in texts:
                    s = gram_hashes(text, n)
                    size.append(len(s))
                    if len(s):
                        digest = xxhash.xxh3_128_intdigest(s.tobytes())
                        d1.append((digest >> 64) - (1 << 63))
                        d2.append((digest & ((1 << 64) - 1)) - (1 << 63))
                        sketch.append(parity_sketch(s))
                        keys.append(fragment_keys(s, num, den).tobytes())
                    else:
                        for column in (d1, d2, sketch, keys):
                            column.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sketch, pa.list_(pa.int64())), pa.array(keys, pa.binary())],
                ["_rid", "doc_id", "n", "d1", "d2", "sketch", "keys"],
            )

    texts = rows.select("_rid", F.col("_row.doc_id").cast("bigint").alias("doc_id"), "_row.text")
    return texts.mapInArrow(run, "_rid bigint, doc_id bigint, n bigint, d1 bigint, d2 bigint, sketch array<bigint>, keys binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """`key`, `rep` of the buckets with more than one class, from `rep`, `keys`; `g` classes meet there, in `times` fragments.

    Map tasks send the keys of their classes as packed arrays to a number of parts that follows their volume; a part
    sorts its keys and returns those that occur more than once. Within a part 32 bits tell keys apart: a part has about
    TASK_KEYS, and two keys that are wrongly taken for one only cost a comparison. Near copies meet in most of their
    fragments, so buckets of the same classes become one: its key is a digest of these, and two digests that are
    wrongly equal again only cost comparisons.
    """
    volume = classes.agg(F.sum(F.length("keys"))).first()[0] or 0
    parts = max(48, math.ceil(volume / 8 / TASK_KEYS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(keys: list[np.ndarray], reps: list[np.ndarray]) -> pa.RecordBatch:
            k, r = np.concatenate(keys), np.concatenate(reps)
            part = ((k >> _U(32)) % _U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            k, r, part = k[order].astype(np.uint32), r[order], part[order]
            cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            ends = np.append(cut[1:], len(k))
            blobs = [k[i:j].tobytes() + r[i:j].tobytes() for i, j in zip(cut, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(part[cut], pa.int64()), pa.array(blobs, pa.binary())], ["part", "blob"])

        keys, reps, held = [], [], 0
        for batch, blobs in rows_of(batches, "keys"):
            for rep, blob in zip(batch.column(0).to_pylist(), blobs, strict=True):
                own = np.frombuffer(blob, np.uint64)
                keys.append(own)
                reps.append(np.full(len(own), rep, np.int64))
                held += len(own)
                if held >= 1_000_000:
                    yield flush(keys, reps)
                    keys, reps, held = [], [], 0
        if held:
            yield flush(keys, reps)

    def meet(table: pa.Table) -> pa.Table:
        blobs, part = table.column("blob").to_pylist(), table.column("part")[0].as_py()
        k = np.concatenate([np.frombuffer(b, np.uint32, len(b) // 12) for b in blobs])
        r = np.concatenate([np.frombuffer(b, np.int64, len(b) // 12, len(b) // 3) for b in blobs])
        order = np.argsort(k, kind="stable")
        k, r = k[order], r[order]
        same = k[1:] == k[:-1]
        many = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        k, r = k[many], r[many]
        if not len(k):
            return pa.table({c: pa.array([], pa.int64()) for c in ("key", "rep", "g", "times")})
        start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        g = np.diff(np.append(start, len(k)))
        with np.errstate(over="ignore"):
            h = (r.view(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)
            h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
            members = np.add.reduceat(h ^ (h >> _U(32)), start)
        members, first, times = np.unique(members, return_index=True, return_counts=True)
        g = g[first]
        at = np.repeat(start[first] - np.cumsum(g) + g, g) + np.arange(g.sum())
        return pa.table({"key": np.repeat(members.view(np.int64), g), "rep": r[at], "g": np.repeat(g, g), "times": np.repeat(times, g)})

    packed = classes.select("rep", "keys").mapInArrow(pack, "part bigint, blob binary")
    met = packed.groupBy("part").applyInArrow(meet, "key bigint, rep bigint, g bigint, times bigint")
    return met.groupBy("key", "rep").agg(F.max("g").alias("g"), F.sum("times").alias("times"))


def _fragment_bits(size):
    """Bits of a column of set sizes: sets are cut into two to this power fragments of about FRAGMENT elements."""
    return F.greatest(F.lit(0), F.ceil(F.log2(size / FRAGMENT))).cast("int")


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Consecutive rows that agree in their first columns, with the values of these."""
    now, held = None, []
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(width)), strict=True))
        start = 0
        for end in range(1, len(keys) + 1):
            if end == len(keys) or keys[end] != keys[start]:
                if keys[start] != now:
                    if held:
                        yield now, held
                    now, held = keys[start], []
                held.append(batch.slice(start, end - start))
                start = end
    if held:
        yield now, held


class _Forest:
    """Edges that join what earlier ones haven't joined yet, for one task."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def _root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    def add(self, near: np.ndarray, left: np.ndarray, right: np.ndarray, own_left: np.ndarray, own_right: np.ndarray) -> None:
        """A spanning forest of the pairs marked in `near` (rows `left`, columns `right`), reduced to one of the nodes `own_*` that they stand for."""
        seen_left, seen_right = ~near.any(1), np.zeros(near.shape[1], bool)
        for s in np.flatnonzero(~seen_left).tolist():
            if seen_left[s]:
                continue
            seen_left[s] = True
            front = [s]
            while front:
                x = front.pop()
                met = np.flatnonzero(near[x] & ~seen_right)
                seen_right[met] = True
                for y in met.tolist():
                    others = np.flatnonzero(near[:, y] & ~seen_left)
                    seen_left[others] = True
                    front += others.tolist()
                    for z in (x, *others.tolist()):
                        u, v = self._root(int(own_left[z])), self._root(int(own_right[y]))
                        if u != v:
                            self.parent[max(u, v)] = min(u, v)
                            self.edges.append((int(left[z]), int(right[y])))

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.edges, strict=True)) or [[], []]
        self.edges = []
        if len(self.parent) > 500_000:
            self.parent = {}
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])


def _links(dealt: DataFrame, rows: DataFrame, n: int, num: int, den: int, name: str) -> DataFrame:
    """Links (`a`, `b`) that span what all links within the comparisons `dealt` join.

    A comparison (`task`) holds classes (`rep`) on its left (`side` 1), its right (2) or both (3), about BLOCK on each; all left ones
    are compared with all right ones of another component (`comp`). Their sets are cut into two to the power `bits` fragments;
    the overlaps of all pairs are counted in one fragment after the other and summed.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches, "text"):
            rep, bits, part, grams, held = [], [], [], [], 0
            for own, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                s = gram_hashes(text, n)
                cuts = np.searchsorted(s >> _U(64 - b), np.arange((1 << b) + 1, dtype=np.uint64)) if b else [0, len(s)]
                for k in range(1 << b):
                    if cuts[k] < cuts[k + 1]:
                        rep.append(own)
                        bits.append(b)
                        part.append(k)
                        grams.append(s[cuts[k] : cuts[k + 1]].view(np.int64))
                        held += len(grams[-1])
                if held > 1_000_000:
                    yield fragments(rep, bits, part, grams)
                    rep, bits, part, grams, held = [], [], [], [], 0
            yield fragments(rep, bits, part, grams)

    def fragments(rep: list, bits: list, part: list, grams: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(bits, pa.int32()), pa.array(part, pa.int32()), pa.array(grams, pa.list_(pa.int64()))], ["rep", "bits", "part", "grams"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        now, place, comp, size, sides, overlap = None, {}, [], None, None, None

        def ended() -> None:
            m = len(place)
            rep, own = np.array(list(place)), np.array(comp)
            left, right = np.flatnonzero(sides[:m] & 1), np.flatnonzero(sides[:m] & 2)
            o = np.rint(overlap[:m, :m][np.ix_(left, right)]).astype(np.int64)
            both = size[:m][left][:, None] + size[:m][right][None, :]
            forest.add((o * (den + num) >= both * num) & (own[left][:, None] != own[right][None, :]), rep[left], rep[right], own[left], own[right])

        for (task, _), held in _runs(batches, 2):
            if task != now:
                if now is not None:
                    ended()
                    if len(forest.edges) > 50_000:
                        yield forest.batch()
                now, place, comp = task, {}, []
                size, sides, overlap = np.zeros(64, np.int64), np.zeros(64, np.int8), np.zeros((64, 64), np.float32)
            owners, side, grams, lengths = [], [], [], []
            for part in held:
                for r, c, s in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    if r not in place:
                        place[r] = len(place)
                        comp.append(c)
                    owners.append(place[r])
                    side.append(s)
                lengths.append(part.column(5).value_lengths().to_numpy())
                grams.append(part.column(5).flatten().to_numpy())
            if len(place) > len(size):
                more = 2 * len(place)
                size, sides = np.pad(size, (0, more - len(size))), np.pad(sides, (0, more - len(sides)))
                overlap = np.pad(overlap, (0, more - len(overlap)))
            owners, lengths, grams = np.array(owners), np.concatenate(lengths), np.concatenate(grams)
            sides[owners] = side
            size[owners] += lengths
            _, column, times = np.unique(grams, return_inverse=True, return_counts=True)
            common = np.flatnonzero(times > 1)
            slot = np.full(len(times), -1)
            slot[common] = np.arange(len(common))
            at, col = np.repeat(np.arange(len(owners)), lengths), slot[column]
            at, col = at[col >= 0], col[col >= 0]
            order = np.argsort(col, kind="stable")
            at, col = at[order], col[order]
            l, r = (np.flatnonzero(sides[owners] & k) for k in (1, 2))  # noqa: E741
            for s in range(0, len(common), 4096):
                i, j = np.searchsorted(col, (s, s + 4096))
                has = np.zeros((len(owners), min(4096, len(common) - s)), np.float32)
                has[at[i:j], col[i:j] - s] = 1
                overlap[np.ix_(owners[l], owners[r])] += has[l] @ has[r].T
        if now is not None:
            ended()
        yield forest.batch()
        release_memory()

    dealt = staged(dealt, name + "_dealt")
    wanted = sized(dealt.select(F.col("rep").alias("_rid"), "bits").distinct())
    texts = rows.select("_rid", "_row.text").join(wanted, "_rid").select("_rid", "bits", "text")
    parts = texts.mapInArrow(cut, "rep bigint, bits int, part int, grams array<bigint>")
    met = parts.join(sized(dealt), ["rep", "bits"]).select("task", "part", "rep", "comp", "side", "grams")
    sorted_ = met.repartition("task").sortWithinPartitions("task", "part")
    return staged(sorted_.mapInArrow(count, "a bigint, b bigint"), name)


def _star_tasks(first: DataFrame) -> DataFrame:
    """Comparisons of each class `b` with its one centre `a`, from `a`, `b`, `na`, `nb`."""
    about = first.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.greatest(F.max("na"), F.max("nb")).alias("n"))
    about = about.select("a", "blocks", _fragment_bits(F.col("n")).alias("bits"))
    task = lambda k: F.concat_ws(":", "a", k).alias("task")
    left = about.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(task("k"), F.col("a").alias("rep"), F.col("a").alias("comp"), F.lit(1).alias("side"), "bits")
    right = first.select("a", "b").join(about, "a").select(task(F.pmod(F.xxhash64("b"), "blocks")), F.col("b").alias("rep"), F.col("b").alias("comp"), F.lit(2).alias("side"), "bits")
    return left.unionByName(right)


def _group_tasks(members: DataFrame) -> DataFrame:
    """Comparisons of all pairs of different components within each group, in blocks, from `grp`, `rep`, `comp`, `n`.

    A component of more than BLOCK members has blocks of its own, which are never compared with each other.
    """
    counts = members.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n"))
    own = F.when(F.col("m") > BLOCK, F.col("comp")).otherwise(F.lit(-1))
    parts = staged(counts.select("grp", own.alias("c"), "m", "n").groupBy("grp", "c").agg(F.ceil(F.sum("m") / BLOCK).alias("blocks"), F.max("n").alias("n")), "parts")
    bits = parts.groupBy("grp").agg(_fragment_bits(F.max("n")).alias("bits"))
    large = counts.filter(F.col("m") > BLOCK).select("grp", "comp", F.col("comp").alias("c"))
    placed = members.join(large, ["grp", "comp"], "left").withColumn("c", F.coalesce("c", F.lit(-1))).join(parts.drop("n"), ["grp", "c"]).join(bits, "grp")
    placed = placed.select("grp", "c", F.pmod(F.xxhash64("rep"), "blocks").alias("k"), "rep", "comp", "bits")
    blocks = parts.select("grp", "c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    x, y = (blocks.select("grp", F.struct("c", "k").alias(name)) for name in "xy")
    pairs = x.join(y, "grp").filter("x <= y and (x.c <> y.c or x.c = -1)")
    task = F.concat_ws(":", "grp", "x.c", "x.k", "y.c", "y.k")
    same = F.col("x") == F.col("y")
    left = pairs.select("grp", task.alias("task"), "x.c", "x.k", F.when(same, 3).otherwise(1).alias("side"))
    right = pairs.filter(~same).select("grp", task.alias("task"), "y.c", "y.k", F.lit(2).alias("side"))
    return placed.join(left.unionByName(right), ["grp", "c", "k"]).select("task", "rep", "comp", "side", "bits")


def _possible(num: int, den: int):
    """Whether sizes and sketches allow a pair (`na`, `nb`, `sa`, `sb`) to reach the threshold; never wrongly false."""
    # |A n B| >= t/(1+t) (na+nb), so the sets differ in at most (1-t)/(1+t) (na+nb) elements
    return (F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & (_distance() * (den + num) <= (F.col("na") + F.col("nb")) * (den - num))


def _distance():
    """Bits in which the sketches `sa` and `sb` differ; sizes that may link differ by one doubling at most."""
    short = F.least(F.size("sa"), F.size("sb"))
    xor = lambda x, y: x.bitwiseXOR(y)
    at = lambda c: F.when(F.size(c) > short, F.zip_with(F.slice(c, F.lit(1), short), F.slice(c, short + 1, short), xor)).otherwise(F.col(c))
    return F.aggregate(F.zip_with(at("sa"), at("sb"), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda acc, x: acc + x)


def _candidates(buckets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (`a`, `b`) that span what all pairs of different components in one bucket join that sizes and sketches allow, from rows
    (`key`, `blocks`, `rep`, `comp`, `n`, `sketch`) of the buckets that hold several components. A task returns fewer of them than it has classes."""
    rows = buckets.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").cast("bigint").alias("i"), F.greatest("own", "other").cast("bigint").alias("j"), F.col("own").cast("bigint").alias("own"), "rep", "comp", "n", "sketch"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for (_, i, j), held in _runs(batches, 3):
            own, rep, comp, n = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3, 7))
            longs = min(int(b.column(7).value_lengths().to_numpy().min()) for b in held)
            sketch = []
            for b in held:
                values, cuts = b.column(7).flatten().to_numpy(), np.concatenate(([0], np.cumsum(b.column(7).value_lengths().to_numpy())))
                sketch += [folded(values[s:e], longs) for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            sketch = np.array(sketch).view(np.uint64)
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            if not len(left) or not len(right):
                continue
            near = np.zeros((len(left), len(right)), bool)
            step = max(1, (1 << 18) // (len(right) * longs))
            for s in range(0, len(left), step):
                x, y = (v.ravel() for v in np.meshgrid(np.arange(s, min(s + step, len(left))), np.arange(len(right)), indexing="ij"))
                p, q = left[x], right[y]
                ok = (comp[p] != comp[q]) & (np.minimum(n[p], n[q]) * den >= np.maximum(n[p], n[q]) * num)
                if i == j:
                    ok &= p < q
                x, y, p, q = x[ok], y[ok], p[ok], q[ok]
                far = np.bitwise_count(sketch[p] ^ sketch[q]).sum(axis=1, dtype=np.int64)
                hit = far * (den + num) <= (n[p] + n[q]) * (den - num)
                near[x[hit], y[hit]] = True
            forest.add(near, rep[left], rep[right], rep[left], rep[right])
            if len(forest.edges) > 50_000:
                yield forest.batch()
        yield forest.batch()
        release_memory()

    parts = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return parts.mapInArrow(compare, "a bigint, b bigint")


def near_groups(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row for each document: `_rid`, `doc_id`, `n` (distinct n-grams), `component` (smallest `_rid` reachable by
    links) and `component_id` (smallest `doc_id` so reachable).

    `docs` is a table scan with `doc_id` and `text`; other columns are ignored. A-Z are lower-cased; words are runs
    without ASCII white space. Two texts link when their n-gram sets reach num / den in Jaccard similarity. Null and
    empty texts have no n-grams and link with nothing; texts of fewer than n words are one n-gram. Repeated rows are
    equal sets and so linked. Null identifiers are skipped in `component_id` unless a component has no other.
    """
    return _near_groups(numbered(docs.select("doc_id", "text"), "numbered"), n, num, den)


def _near_groups(rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """`near_groups` of a `numbered` table."""
    sets = staged(_sets(rows, n, num, den), "sets")
    members = sets.filter("n > 0")
    classes = staged(members.groupBy("n", "d1", "d2").agg(F.min("_rid").alias("rep"), F.min("doc_id").alias("first_id")), "classes")
    copies = staged(members.select("_rid", "n", "d1", "d2").join(classes, ["n", "d1", "d2"]).filter("_rid <> rep").select("_rid"), "copies")
    own = members.join(sized(copies), "_rid", "left_anti").select(F.col("_rid").alias("rep"), "n", "sketch", "keys")
    buckets = staged(_buckets(own), "buckets")
    about = own.select("rep", "n", "sketch")

    # each class against the most central one of each of its buckets, that which meets most others over all its buckets
    central = buckets.groupBy("rep").agg(F.sum((F.col("g") - 1) * F.col("times")).alias("w"))
    star = staged(buckets.select("key", "rep").join(central, "rep").groupBy("key").agg(F.max_by("rep", F.struct("w", -F.col("rep"))).alias("a"), F.count(F.lit(1)).alias("g")), "stars")
    pairs = buckets.select("key", "rep", "times").join(star.select("key", "a"), "key").filter("rep != a").groupBy("a", F.col("rep").alias("b")).agg(F.sum("times").alias("shared"))
    left, right = (about.select(F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")
    possible = staged(pairs.join(left, "a").join(right, "b").filter(_possible(num, den)).select("a", "b", "na", "nb", "shared"), "pairs")
    # first the one with which it shares most; most other pairs are then of one component
    first = possible.groupBy("b").agg(F.max_by(F.struct("a", "na", "nb"), F.struct("shared", "a")).alias("f")).select("f.a", "b", "f.na", "f.nb")
    first = staged(first, "first")
    links = _links(_star_tasks(first), rows, n, num, den, "links")
    comps = staged(components(links), "components")

    node = comps.select(F.col("node").alias("rep"), F.col("component").alias("c"))
    mixed = buckets.select("key", "rep").join(node, "rep", "left").withColumn("comp", F.coalesce("c", "rep"))
    # a bucket whose classes are of one component needs no further comparison, nor do pairs with its central class
    several = mixed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("g")).filter("lo != hi and g > 2").select("key")
    rest = mixed.join(several, "key", "left_semi").join(star.select("key", "a", F.ceil(F.col("g") / BLOCK).alias("blocks")), "key").filter("rep != a").join(about, "rep").select("key", "blocks", "rep", "comp", "n", "sketch")
    across = possible.join(first.select("a", "b"), ["a", "b"], "left_anti").join(node.select(F.col("rep").alias("a"), F.col("c").alias("ca")), "a", "left").join(node.select(F.col("rep").alias("b"), F.col("c").alias("cb")), "b", "left")
    across = across.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    # candidates chain classes to groups; every link still missing lies within one of these
    candidates = staged(_candidates(rest, num, den).unionByName(across).distinct(), "candidates")
    if not candidates.isEmpty():
        grouped = staged(components(candidates), "candidate_groups").select(F.col("node").alias("rep"), F.col("component").alias("grp"))
        members = grouped.join(node, "rep", "left").join(about.select("rep", "n"), "rep").select("grp", "rep", F.coalesce("c", "rep").alias("comp"), "n")
        links = links.union(_links(_group_tasks(staged(members, "members")), rows, n, num, den, "more_links"))
        comps = staged(components(links), "components")

    named = classes.select("rep", "n", "d1", "d2", "first_id").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.withColumn("component", F.coalesce("component", "rep"))
    smallest = named.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = staged(named.join(smallest, "component").select("n", "d1", "d2", "component", "component_id"), "named")
    out = sets.select("_rid", "doc_id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
    return out.select("_rid", "doc_id", "n", F.coalesce("component", "_rid").alias("component"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of a table scan without near duplicates: of each group the first row stays; texts without words all stay."""
    rows = numbered(docs, "numbered")
    dropped = staged(_near_groups(rows, n, num, den).filter("_rid != component").select("_rid"), "dropped")
    return without(rows, dropped)
