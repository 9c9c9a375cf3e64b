"""Secret scans with fixed patterns and two character Markov models, in DataFrame functions alone.

Patterns find declared secrets, access keys and long hexadecimal runs. For other runs of key-like characters two first
order Markov models, of random strings and of ordinary identifiers, are trained on labelled samples; their
log-likelihood ratio is a sum of one weight for each pair of neighbouring characters, so the models reduce to an array
of 128 x 128 integers (thousandths of a nat), a constant of the plan. Runs whose ratio reaches a threshold and that no
pattern has found are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.common import whole

#: Fixed patterns, with the least length of the match (of group 2 for the first).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "markov")

#: Runs that the models judge; they need a letter and a digit.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
#: Least log-likelihood ratio, in thousandths of a nat, of a random string.
RATIO = 8000
#: Matches in one block of the sums of lengths.
STEP = 256


def samples(spark: SparkSession, texts: DataFrame, count: int = 4096) -> DataFrame:
    """Labelled samples (`token`, `random`): digests in several alphabets, and identifiers built from the words of `texts`.

    `texts` (column `text`) is a small table of ordinary prose.
    """
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    secret = spark.range(count).select(
        F.explode(
            F.array(
                F.hex(digest),
                F.lower(F.hex(digest)),
                F.base64(digest),
                F.translate(F.base64(digest), "+/=", "xyz"),
                F.translate(F.base64(digest), "+/=", "-_"),
                F.upper(F.translate(F.base64(digest), "+/=", "234")),
            )
        ).alias("token"),
        F.lit(True).alias("random"),
    )
    words = texts.select(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)).alias("w"))
    small = F.transform("w", lambda x: F.lower(x))
    names = words.select(
        F.explode(
            F.array(
                F.array_join(small, "_"),
                F.array_join(small, "-"),
                F.array_join(small, "/"),
                F.array_join(small, ""),
                F.array_join(F.transform(small, lambda x: F.initcap(x)), ""),
                F.upper(F.array_join(small, "_")),
                F.array_join(F.transform("w", lambda x, i: F.concat(F.lower(x), (i % 100).cast("string"))), "_"),
                F.array_join(F.transform("w", lambda x, i: F.concat(F.lit("20"), F.lpad((i % 30).cast("string"), 2, "0"), F.lit("-"), F.lpad((i % 12 + 1).cast("string"), 2, "0"))), "/"),
            )
        ).alias("token"),
        F.lit(False).alias("random"),
    )
    return secret.unionByName(names)


def train(labelled: DataFrame) -> list[int]:
    """Weights of the pairs of ASCII characters (index 128 * first + second), in thousandths of a nat.

    Rows with a null token or label are left out; characters beyond ASCII have no weight. Add-one smoothing over the
    65 characters of a run; pairs outside these weigh nothing. The counts, at most 2 x 128 x 128, come to the driver.
    """
    import math

    place = F.sequence(F.lit(1), F.length("token") - 1)
    pairs = labelled.filter(F.col("random").isNotNull() & (F.length("token") > 1)).select("random", F.explode(F.transform(place, lambda i: F.substring(F.col("token"), i, F.lit(2)))).alias("p"))
    coded = pairs.select("random", F.ascii(F.substring("p", 1, 1)).alias("a"), F.ascii(F.substring("p", 2, 1)).alias("b")).filter("a < 128 and b < 128")
    counts = {(r.random, r.a, r.b): r.n for r in coded.groupBy("random", "a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}
    known = [c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_=-"]
    rows: dict[tuple[bool, int], int] = {}
    for (kind, a, b), n in counts.items():
        if a in known and b in known:
            rows[kind, a] = rows.get((kind, a), 0) + n
    out = [0] * (128 * 128)
    for a in known:
        for b in known:
            p, q = ((counts.get((kind, a, b), 0) + 1) / (rows.get((kind, a), 0) + len(known)) for kind in (True, False))
            out[128 * a + b] = round(1000 * (math.log(p) - math.log(q)))
    return out


def _placed(rows: DataFrame, text: Column, patterns: dict[str, str]) -> DataFrame:
    """For each column of matches of a pattern: adds an array of their first code points, named `<column>_at`.

    A match starts after the texts between matches and the matches before it. These lengths are summed in blocks of STEP, so
    the work grows with the matches' number, not its square; each step is a projection of its own, so nothing is computed twice.
    """
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)
    lengths = lambda parts: F.transform(parts, lambda x: F.length(x).cast("long"))
    none = F.expr("cast(array() as array<bigint>)")
    some = lambda c, x: F.when(F.size(c) > 0, x).otherwise(none)
    blocks = lambda c: F.sequence(F.lit(0), F.floor((F.size(c) - 1) / STEP).cast("int"))
    out = rows.withColumns({f"{c}_gap": some(c, lengths(F.split(text, p, -1))) for c, p in patterns.items()})
    out = out.withColumns({f"{c}_both": some(c, F.zip_with(F.slice(f"{c}_gap", F.lit(1), F.size(c)), lengths(F.col(c)), lambda x, y: x + y)) for c in patterns})
    sums = lambda c: F.transform(blocks(c), lambda k: total(F.slice(c, k * STEP + 1, F.lit(STEP))))
    before = lambda c: F.transform(c, lambda _, k: total(F.slice(c, F.lit(1), k)))
    out = out.withColumns({f"{c}_sum": some(f"{c}_both", sums(f"{c}_both")) for c in patterns})
    out = out.withColumns({f"{c}_before": some(f"{c}_sum", before(f"{c}_sum")) for c in patterns})
    block = lambda i: F.floor(i / STEP).cast("int")
    at = lambda c: F.transform(f"{c}_both", lambda _, i: F.get(f"{c}_before", block(i)) + total(F.slice(f"{c}_both", block(i) * STEP + 1, i % STEP)) + F.get(f"{c}_gap", i))
    out = out.withColumns({f"{c}_at": some(f"{c}_both", at(c)) for c in patterns})
    return out.drop(*[f"{c}_{part}" for c in patterns for part in ("gap", "both", "sum", "before")])


def _spans(column: str, kind: int, keep) -> Column:
    """Spans of those matches that `keep(match, index)` accepts."""
    spans = F.transform(F.arrays_zip(F.col(column).alias("m"), F.col(f"{column}_at").alias("s")), lambda x, i: F.struct(x["s"].alias("start"), F.lit(kind).alias("kind"), (x["s"] + F.length(x["m"])).alias("end"), keep(x["m"], i).alias("ok")))
    return F.transform(F.filter(spans, lambda x: x["ok"]), lambda x: F.struct(x["start"], x["kind"], x["end"]))


def _joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined, by start, then kind."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def ratio(token: Column, weights: Column) -> Column:
    """Log-likelihood ratio of a token, in thousandths of a nat; tokens of one character have 0."""
    code = lambda i: F.least(F.ascii(F.substring(token, i, F.lit(1))), F.lit(127))
    steps = F.when(F.length(token) > 1, F.sequence(F.lit(1), F.length(token) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(steps, F.lit(0), lambda acc, i: acc + F.element_at(weights, code(i) * 128 + code(i + 1) + 1))


def find(docs: DataFrame, weights: list[int], least: int = RATIO) -> DataFrame:
    """Spans of every row: the columns of `docs` with `base` and `added`, arrays of (start, kind, end) in code points.

    `docs` has `text`; null and empty texts have no spans; texts are searched whole. Base spans of different kinds may
    overlap; added ones overlap no base span. One narrow pass; repeated rows are searched each; columns named like
    the new ones are replaced.
    """
    table = F.expr("cast(split('" + ",".join(map(str, weights)) + "', ',') as array<int>)")
    text = F.coalesce(F.col("text"), F.lit(""))
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = docs.select("text", whole(docs)).withColumns({"_assign": every(ASSIGN), "_access": every(ACCESS), "_hex": every(HEX), "_run": every(RUN)})
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    mixed = lambda x: x.rlike("[0-9]") & x.rlike("[A-Za-z]")
    found = found.withColumn("_value", F.when(F.size("_assign") > 0, values))
    found = found.withColumn("_run", F.when(F.exists("_run", mixed), F.col("_run")).otherwise(F.expr("cast(array() as array<string>)")))
    found = _placed(found, text, {"_assign": ASSIGN, "_access": ACCESS, "_hex": HEX, "_run": RUN})
    always = lambda m, i: F.lit(True)
    base = F.concat(_spans("_assign", 0, lambda m, i: F.length(F.get(F.col("_value"), i)) >= ASSIGN_LEAST), _spans("_access", 1, always), _spans("_hex", 2, always))
    runs = _spans("_run", 3, lambda m, i: mixed(m) & (ratio(m, table) >= least))
    spans = found.withColumns({"base": base, "_runs": runs})
    apart = F.when(F.size("_runs") > 0, F.filter("_runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))).otherwise(F.col("_runs"))
    own = [F.col(f"_row.`{c}`") for c in docs.columns if c not in ("base", "added")]
    return spans.withColumn("added", apart).select(*own, "base", "added")


def report(docs: DataFrame, weights: list[int], least: int = RATIO) -> DataFrame:
    """One row for each document: `doc_id`, counts of the base kinds, digest of the base spans, all spans."""
    found = find(docs.select("doc_id", "text"), weights, least).select("doc_id", "base", "added")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.encode(_joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
    )
