"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

The kernel of two words counts their common subsequences of three and four characters, each weighted by a decay for
every position that it spans; so words in which an insult is stretched, interrupted or embedded stay near it. Spans
are bounded, which makes the features of a word few; a word bears marks at its ends. The machine also learns from virtual examples:
sure witnesses with characters inserted, doubled or left out. Kernel values are divided by
the roots of the words' feature masses. Landmark words give the Nystroem map, in which a linear support vector
machine (squared hinge) is trained. Because the machine is linear in kernel values with the landmarks, its weights fold
into one table of subsequences, and scoring a word is a sum over its own subsequences.

Labels are of whole texts, so training is multiple-instance, with the distinct words of a whole text as one bag; sentences are
not told apart. Every word that a clean text holds is a negative instance, and never a positive one; of a toxic text, the other words
that rank highest, first by log-odds of their stems and then by the current machine, are its witnesses, and count by the texts that they
are witnesses of. Hard negatives join in each round and stay. A text's
margin is that of its worst word, turned into a probability by a logistic fit.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import crc32_of_id, release_memory, rows_of, staged, whole

#: Labelled texts of each class on which the machine is fitted, at most (those first by a digest of their id).
FIT_TEXTS = 2500
LANDMARKS = 480
#: Words in a round, at most: witnesses of toxic texts, random words of clean texts, those of clean texts with the largest margins, and sure witnesses;
#: and how many virtual examples with one character inserted a sure witness has (of other kinds in proportion).
POSITIVES, NEGATIVES, HARD, SURE = 4000, 12000, 4000, 160
VIRTUAL = 16
DECAY = 0.85
THRESHOLD = 0.7
#: Longest piece of a word that is scored at once, and the step between pieces of longer words: whatever has PIECE - STEP characters
#: or fewer lies in one of them whole.
PIECE, STEP = 24, 6
_CACHE_WORDS = 150_000
#: Words handled together.
CHUNK = 8192
#: Size of the table in which weights are looked up.
TABLE_BITS = 20

#: Offsets of the bounded subsequences: three characters within five, four within six.
PATTERNS = [(0, *c) for c in combinations(range(1, 5), 2)] + [(0, *c) for c in combinations(range(1, 6), 3)]
_EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”„’‘…–—¿¡"


def instances(text: str) -> set[str]:
    """The distinct words of a text as scored: lower case, without punctuation at the ends.

    Words with punctuation inside are also taken without it, and runs of three or more single characters are also
    joined; words of more than PIECE characters are cut into overlapping pieces.
    """
    words = text.lower().split()
    out = set()
    run = ""
    for raw in words:
        if len(raw) == 1 and raw.isalnum():
            run += raw
            continue
        if len(run) >= 3:
            out.add(run)
        run = ""
    if len(run) >= 3:
        out.add(run)
    for raw in set(words):
        word = raw.strip(_EDGE)
        if word:
            out.add(word)
            if not word.isalnum():
                out.add("".join(filter(str.isalnum, word)))
    long = [w for w in out if len(w) > PIECE]
    for w in long:
        out.discard(w)
        out.update(w[i : i + PIECE] for i in range(0, len(w) - PIECE + STEP, STEP))
    out.discard("")
    return out


def _chars(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words with end marks, the number of the word of each, and the place behind its word."""
    joined = "".join(f"\x02{w}\x03" for w in words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    return np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64), np.repeat(np.arange(len(words)), lengths), np.repeat(ends, lengths)


def features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pattern: the codes of its subsequences, the words they are of, and their weight."""
    chars, owner, ends = _chars(words)
    for pattern in PATTERNS:
        at = np.flatnonzero(np.arange(len(chars)) + pattern[-1] < ends)
        code = np.full(len(at), len(pattern), np.uint64)
        for offset in pattern:
            code = code * np.uint64(2097143) + chars[at + offset]
        yield code, owner[at], DECAY ** (pattern[-1] + 1)


def mass(words: list[str]) -> np.ndarray:
    """Root of each word's feature mass, a function of its length."""
    n = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return np.sqrt(sum(np.maximum(n - p[-1], 0) * DECAY ** (2 * (p[-1] + 1)) for p in PATTERNS) + 1e-12)


@dataclass
class Model:
    """Sorted subsequence codes with their weights, and the constants of the margin and of the logistic fit."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def __post_init__(self) -> None:
        slot = self._slot(self.codes)
        self.keys = np.zeros(1 << TABLE_BITS, np.uint64)
        self.values = np.zeros(1 << TABLE_BITS, np.float32)
        taken, first = np.unique(slot, return_index=True)
        self.keys[taken], self.values[taken] = self.codes[first], self.weights[first]
        rest = np.setdiff1d(np.arange(len(self.codes)), first)
        self.crowded = np.zeros(1 << TABLE_BITS, bool)
        self.crowded[slot[rest]] = True
        self.rest = dict(zip(self.codes[rest].tolist(), self.weights[rest].tolist(), strict=True))

    def __reduce__(self):
        return Model, (self.codes, self.weights, self.bias, self.slope, self.shift)

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _weight(self, code: np.ndarray) -> np.ndarray:
        slot = self._slot(code)
        value = np.where(self.keys[slot] == code, self.values[slot], np.float32(0))
        if self.rest:
            for i in np.flatnonzero(self.crowded[slot]).tolist():
                value[i] = self.rest.get(int(code[i]), value[i])
        return value

    def margins(self, words: list[str]) -> np.ndarray:
        """Margin of each word; words without a known subsequence have the bias."""
        out = np.full(len(words), self.bias)
        for s in range(0, len(words), CHUNK):
            part = words[s : s + CHUNK]
            total = np.zeros(len(part))
            for code, owner, weight in features(part):
                value = self._weight(code)
                hit = np.flatnonzero(value)
                total += weight * np.bincount(owner[hit], value[hit], len(part))
            out[s : s + len(part)] += total / mass(part)
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def constant(probability: float) -> Model:
    """The model where labels of one class or none are known."""
    return Model(np.empty(0, np.uint64), np.empty(0, np.float32), 0.0, 1.0, float(np.log(probability / (1 - probability))))


def _kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values of words with landmarks, of which some are held at a time."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    tables = []
    for left in range(0, len(landmarks), 96):
        own = landmarks[left : left + 96]
        codes, columns = np.unique(np.concatenate([c for c, _, _ in features(own)]), return_inverse=True)
        z, start = np.zeros((len(codes), len(own)), np.float32), 0
        for code, owner, weight in features(own):
            np.add.at(z, (columns[start : start + len(code)], owner), np.float32(weight))
            start += len(code)
        tables.append((left, codes, z / mass(own).astype(np.float32)))
    for s in range(0, len(words), 512):
        part = words[s : s + 512]
        for code, owner, weight in features(part):
            for left, codes, z in tables:
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                hit = np.flatnonzero(codes[at] == code)
                if len(hit):  # owners ascend
                    first = np.flatnonzero(np.diff(owner[hit], prepend=-1))
                    out[s + owner[hit][first], left : left + z.shape[1]] += np.float32(weight) * np.add.reduceat(z[at[hit]], first, axis=0)
        out[s : s + len(part)] /= mass(part)[:, None]
    return out.astype(np.float64)


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Linear squared-hinge machine by Newton steps; the last column of x is the bias."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    margins = lambda v: np.concatenate([x[s : s + 4096].astype(np.float64) @ v for s in range(0, len(x), 4096)])
    value = lambda v, f: 0.5 * v @ v + (cost * np.maximum(1 - y * f, 0) ** 2).sum()
    f = margins(w)
    for _ in range(30):
        gap = 1 - y * f
        on = np.flatnonzero(gap > 0)
        grad, curve = w.copy(), ridge.copy()
        for s in range(0, len(on), 2048):
            at = on[s : s + 2048]
            part = x[at].astype(np.float64)
            grad -= 2 * part.T @ (cost[at] * y[at] * gap[at])
            curve += 2 * (part * cost[at, None]).T @ part
        if np.abs(grad).max() < 1e-6:
            break
        step = np.linalg.solve(curve, grad)
        t, now = 1.0, value(w, f)
        while value(w - t * step, g := margins(w - t * step)) > now and t > 1e-4:
            t /= 2
        w, f = w - t * step, g
    return w


def _spread(words: list[str], count: int) -> list[str]:
    """A varied choice from the first words: one after the other those that none of the chosen is much like, then the least like ones."""
    pool = words[: 4 * count]
    if len(pool) <= count:
        return pool
    k = _kernel(pool, pool)
    own = np.sqrt(np.maximum(np.diag(k), 1e-9))
    k = k / own[:, None] / own
    chosen, near = [], np.zeros(len(pool))
    for i in range(len(pool)):
        if len(chosen) < count and near[i] < 0.7:
            chosen.append(i)
            near = np.maximum(near, k[:, i])
    near[chosen] = 9
    while len(chosen) < count:
        nxt = int(near.argmin())
        chosen.append(nxt)
        near = np.maximum(near, k[:, nxt])
        near[nxt] = 9
    return [pool[i] for i in chosen]


def _disguised(words: list[str], rng: np.random.Generator) -> tuple[list[str], np.ndarray]:
    """Virtual examples of words of four letters or more, and the number of the word of each: one or two characters inserted inside,
    one doubled or trebled, every one doubled, and of longer words one inner one left out."""
    letters = "".join(sorted({c for w in words for c in w if c.isalpha()})) or "x"
    out, of = [], []

    def inserted(word: str) -> str:
        at = int(rng.integers(1, len(word)))
        return word[:at] + letters[int(rng.integers(len(letters)))] + word[at:]

    for k, word in enumerate(words):
        if len(word) < 4 or not word.isalpha():
            continue
        new = [inserted(word) for _ in range(VIRTUAL)] + [inserted(inserted(word)) for _ in range(2 * VIRTUAL)] + ["".join(c + c for c in word)]
        for at in rng.permutation(len(word))[: VIRTUAL // 4].tolist():
            new.append(word[:at] + word[at] * int(rng.integers(2, 4)) + word[at + 1 :])
        if len(word) > 4:
            new += [word[: at + 1] + word[at + 2 :] for at in rng.permutation(len(word) - 2)[: VIRTUAL // 2].tolist()]
        out += new
        of += [k] * len(new)
    return out, np.array(of, np.int64)


def _stems(words: list[str]) -> np.ndarray:
    """Digests of each word's leading stems and of the whole word; short words repeat the last."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.array([[h(w[:k] if len(w) > k else w + "\x03") for k in (4, 5, 6, 7)] + [h(w + "\x03")] for w in words], np.uint64).reshape(len(words), 5)


def _seeds(stems: np.ndarray, toxic: list[np.ndarray], clean: list[np.ndarray]) -> np.ndarray:
    """Association of each word with toxic texts: the best of its stems' log-odds, by the texts that hold them; 0 if none."""

    def texts_with(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([np.unique(stems[b]) for b in bags]), return_counts=True)

    (codes, bad), (others, good) = texts_with(toxic), texts_with(clean)
    at = np.minimum(np.searchsorted(others, codes), len(others) - 1)
    share = len(toxic) / len(clean)
    scaled = np.where(others[at] == codes, good[at], 0) * share
    odds = np.where((bad >= 2) & (bad > 8 * scaled), bad * np.log((bad + 0.5) / (scaled + 0.5)), 0.0)
    place = np.minimum(np.searchsorted(codes, stems), len(codes) - 1)
    return np.where(codes[place] == stems, odds[place], 0.0).max(axis=1)


def fit(texts: list[str], labels: list[int], rounds: int = 3) -> Model:
    """`fit_bags` of whole texts."""
    return fit_bags(zip(map(instances, texts), labels, strict=True), rounds)


def fit_bags(labelled: Iterable[tuple[Iterable[str], int]], rounds: int = 3) -> Model:
    """Train on the words of labelled texts, taken one text after the other. With one class alone the model is constant.

    Texts become arrays of word numbers, so that memory follows the distinct words of the bounded sample. The logistic fit
    uses margins of texts that a first machine, trained on three quarters, hasn't seen; with few texts, those of all.
    """
    number: dict[str, int] = {}
    bags, labels = [], []
    for words, label in labelled:
        bags.append(np.fromiter((number.setdefault(w, len(number)) for w in sorted(words)), np.int32))
        labels.append(label)
    vocabulary = list(number)
    del number
    toxic = [b for b, y in zip(bags, labels, strict=True) if y and len(b)]
    clean = [b for b, y in zip(bags, labels, strict=True) if not y and len(b)]
    if not toxic or not clean:
        return constant(0.9 if toxic else 0.05)
    stems = _stems(vocabulary)
    worst = lambda margin, own: np.array([margin[b].max() for b in own])
    held = toxic[::4], clean[::4]
    model, margin, virtual = None, None, None
    if len(held[0]) >= 5 and len(held[1]) >= 5:
        parts = [[b for i, b in enumerate(own) if i % 4] for own in (toxic, clean)]
        _, margin, virtual = _train(vocabulary, stems, *parts, rounds)
        seen = np.concatenate([worst(margin, own) for own in held])
        model = _train(vocabulary, stems, toxic, clean, rounds)[0]
    else:
        held = toxic, clean
        model, margin, virtual = _train(vocabulary, stems, toxic, clean, rounds)
        seen = np.concatenate([worst(margin, own) for own in held])
    model.slope, model.shift = _logistic(seen, np.array([1.0] * len(held[0]) + [0.0] * len(held[1])), virtual)
    del bags, vocabulary, stems, toxic, clean, margin, virtual
    release_memory()
    return model


def _train(vocabulary: list[str], stems: np.ndarray, toxic: list[np.ndarray], clean: list[np.ndarray], rounds: int) -> tuple[Model, np.ndarray, np.ndarray]:
    """The machine, not yet calibrated, and the margins of all words and of the last virtual examples."""
    rng = np.random.default_rng(11)
    held = np.bincount(np.concatenate(clean), minlength=len(vocabulary))
    clean_at = np.flatnonzero(held)
    pick = lambda at: [vocabulary[i] for i in at.tolist()]
    sample = lambda at, n: np.sort(at[rng.permutation(len(at))[:n]])

    def witnesses(rank: np.ndarray, near: float, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each toxic text, the words that no clean text holds and that rank near its best one; those of most texts first, with their texts."""
        out = []
        for bag in toxic:
            new = bag[held[bag] == 0]
            if len(new) and (best := rank[new].max()) > 0:
                out.append(new[rank[new] >= max(near * best, floor)] if floor <= best else new[[rank[new].argmax()]])
        words, texts = np.unique(np.concatenate(out), return_counts=True) if out else (np.empty(0, np.int64),) * 2
        order = np.argsort(-texts, kind="stable")[:POSITIVES]
        return words[order], texts[order]

    positive, texts = witnesses(_seeds(stems, toxic, clean), 0.5, 0.0)
    if not len(positive):
        positive = np.unique(np.concatenate(toxic))[:POSITIVES]
        texts = np.ones(len(positive), np.int64)
    negative = sample(clean_at, NEGATIVES)
    hard = np.empty(0, np.int64)
    model = None
    for turn in range(rounds):
        sure = positive[: min(int((texts >= 3).sum()), SURE)]
        virtual, of = _disguised(pick(sure), rng)
        landmarks = _spread(pick(positive), LANDMARKS // 3) + _spread([virtual[i] for i in rng.permutation(len(virtual))], LANDMARKS // 3)
        landmarks += _spread(pick(hard if len(hard) else rng.permutation(negative)), LANDMARKS - len(landmarks))
        k = _kernel(landmarks, landmarks)
        value, vector = np.linalg.eigh((k + k.T) / 2)
        keep = value > 1e-6 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])
        at = np.concatenate((negative, hard))
        words = pick(positive) + virtual + pick(at)
        n = len(positive) + len(virtual)
        x = np.ones((len(words), root.shape[1] + 1), np.float32)
        for s in range(0, len(words), 2048):
            x[s : s + 2048, :-1] = _kernel(words[s : s + 2048], landmarks) @ root
        y = np.where(np.arange(len(words)) < n, 1.0, -1.0)
        # a word counts as often as the texts that hold it, and hard ones in full
        toxic_texts = np.minimum(texts, 20).astype(float)
        virtual_texts = toxic_texts[of]
        clean_texts = np.minimum(held[at], 20).astype(float)
        clean_texts[len(negative) :] *= 20
        cost = [6000 * toxic_texts / toxic_texts.sum(), 18000 * virtual_texts / max(virtual_texts.sum(), 1), 150000 * clean_texts / clean_texts.sum()]
        w = _svm(x, y, np.concatenate(cost))
        del x
        codes, place = np.unique(np.concatenate([c for c, _, _ in features(landmarks)]), return_inverse=True)
        table, start, scale = np.zeros(len(codes)), 0, root @ w[:-1] / mass(landmarks)
        for code, owner, weight in features(landmarks):
            np.add.at(table, place[start : start + len(code)], weight * scale[owner])
            start += len(code)
        model = Model(codes, table.astype(np.float32), float(w[-1]), 1.0, 0.0)
        margin = model.margins(vocabulary)
        order = clean_at[np.argsort(-margin[clean_at], kind="stable")[:HARD]]
        now = order[margin[order] > -0.7]
        hard = np.concatenate((now, hard[~np.isin(hard, now)]))[:HARD]
        if turn + 1 < rounds:
            again = witnesses(margin, 0.0, 0.5)
            positive, texts = again if len(again[0]) else (positive, texts)
    return model, margin, model.margins(virtual)


def _logistic(margin: np.ndarray, truth: np.ndarray, virtual: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels to margins, its crossing of THRESHOLD where errors are fewest: texts on the wrong side, and the share
    of virtual examples missed, as much as a twentieth of the toxic texts; of equal places the lower middle."""
    cuts = np.unique(np.clip(margin, -1.5, 1.5))
    cuts = np.concatenate(([cuts[0] - 0.1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 0.1]))
    order = np.sort(margin[truth == 1]), np.sort(margin[truth == 0])
    missed, false = np.searchsorted(order[0], cuts), len(order[1]) - np.searchsorted(order[1], cuts)
    cost = missed + false
    if len(virtual):
        cost = cost + len(order[0]) / 20 * np.searchsorted(np.sort(virtual), cuts) / len(virtual)
    best = cuts[cost <= cost.min() + 0.05]
    cut = float(np.clip(best.min() + (best.max() - best.min()) / 4, 0.2, 0.85))
    slope = 6.0
    return slope, float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * cut)


def _bags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`digest`, `toxic`, `words`: the distinct words and the label of each text of a bounded sample of labelled rows: those whose crc32 of
    the id modulo 3 isn't 1, FIT_TEXTS of each class at most. Texts are reduced to words by the executors."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(crc32_of_id(F.col("doc_id")) % 3 != 1)
    chosen = None
    for value in (0, 1):
        part = known.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id")).limit(FIT_TEXTS)
        chosen = part if chosen is None else chosen.union(part)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches, "text", 100):
            words = [sorted(instances(t)) if t else [] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string()))], ["digest", "toxic", "words"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.xxhash64("text").alias("digest"), F.col("toxic").cast("int").alias("toxic"), "text")
    return staged(rows.mapInArrow(reduce, "digest bigint, toxic int, words array<string>"), "bags")


def training_bags(docs: DataFrame, labels: DataFrame) -> Iterator[tuple[list[str], int]]:
    """The words and labels of the training texts, in the driver, which takes one partition after the other."""
    for row in islice(_bags(docs, labels).orderBy("digest", "toxic").toLocalIterator(), 4 * FIT_TEXTS):
        yield row.words, row.toxic


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """`fit_bags` of `training_bags` in one task: kernels, words and tables of the fit take memory of an executor, and the driver gets
    the model alone."""

    def fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def labelled() -> Iterator[tuple[list[str], int]]:
            for batch in batches:
                for at in range(0, batch.num_rows, 100):
                    part = batch.slice(at, 100)
                    yield from zip(part.column(1).to_pylist(), part.column(0).to_pylist(), strict=True)

        model = fit_bags(islice(labelled(), 4 * FIT_TEXTS))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    ordered = _bags(docs, labels).coalesce(1).sortWithinPartitions("digest", "toxic").select("toxic", "words")
    rows = ordered.mapInArrow(fit_task, "model binary").collect()  # one row
    return pickle.loads(rows[0].model) if rows else fit_bags(())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` with `score` (double, 0 to 1) and `predicted` (1 from THRESHOLD on), in one narrow pass.

    All columns are kept. Null, empty and wordless texts get the score of a text without a suspicious word; texts
    are scored whole, however long; equal texts score alike; an empty table gives no rows. Columns named `score` or
    `predicted` are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = shared.value, {}
        least = own.bias - 1.0
        for batch, texts in rows_of(batches, "text", 250):
            bags, new = [], set()
            for text in texts:
                bag = instances(text) if text else set()
                bags.append(bag)
                new.update(w for w in bag if w not in cache)
            if len(cache) + len(new) > _CACHE_WORDS:
                cache = {}
                new = set().union(*bags)
            words = list(new)
            cache.update(zip(words, own.margins(words).tolist(), strict=True))
            worst = np.array([max((cache[w] for w in bag), default=least) for bag in bags])
            p = own.probability(worst)
            columns = [*batch.columns, pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "score", "predicted"])

    from pyspark.sql import types as T

    schema = T.StructType([*rest.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rest.mapInArrow(run, schema)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the machine, trained on labelled rows among them, doesn't call toxic."""
    model = fitted(docs, labels)
    return score(docs.select(whole(docs), "text"), model).filter("predicted = 0").select("_row.*")


def held_out_crc(doc_id: int | None) -> bool:
    """Whether a row is held out of training (for tests)."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1
