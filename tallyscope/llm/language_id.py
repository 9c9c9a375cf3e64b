"""Language identification of pages by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior for each page: the likelihood of its text under character trigram models
(trained on labelled documents), the language its markup declares, the language that its address names (a path segment,
a leading host label or a country suffix), and a prior of its host. How far declarations and addresses are to be trusted is
estimated from all other pages by grouped aggregation against what the texts alone say; host priors are smoothed towards the
registered domain's, and these towards the corpus, so that a host with few pages borrows from its domain.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.llm.common import rows_of, sized, staged

#: Labelled documents of each language on which the text models are fitted, at most.
FIT_DOCS = 400
#: Languages that have a text model, at most (those of most documents).
MOST_LANGUAGES = 100
BUCKETS = 1 << 16
#: Trigrams of a text beyond which its likelihood counts as that of so many; neighbouring trigrams aren't independent.
WORTH = 60.0
#: Pages by which a domain outweighs its host's own, and the corpus its domains.
PULL = 8.0

_OPAQUE = re.compile(r"<(script|style|title|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>", re.S | re.I)
DECLARED = r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z]{2,3})"""


def page_text(page: str | None) -> str:
    """Visible text of a page, roughly; null has none."""
    return html.unescape(_OPAQUE.sub(" ", page)) if page else ""


def trigrams(text: str) -> np.ndarray:
    """Buckets of the character trigrams of a text's words, lower-cased, each word between marks."""
    joined = " " + " ".join(text.lower().split()) + " "
    c = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    if len(c) < 3:
        return np.empty(0, np.int64)
    code = (c[:-2] * np.uint64(1 << 42)) ^ (c[1:-1] * np.uint64(1 << 21)) ^ c[2:]
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


@dataclass
class TextModel:
    """Languages in order, and the log-probability of each trigram bucket in each."""

    languages: list[str]
    table: np.ndarray

    def loglik(self, text: str) -> list[float]:
        """Log-likelihood of a text in each language, tempered to WORTH trigrams."""
        at = trigrams(text)
        if not len(at):
            return [0.0] * len(self.languages)
        return (self.table[at].sum(0) * min(1.0, WORTH / len(at))).tolist()


def train_text(docs: DataFrame) -> TextModel:
    """Fit the trigram models on at most FIT_DOCS whole documents of each language (`text`, `lang`); rows with nulls are left out."""
    rows = docs.filter("text is not null and lang is not null").select("doc_id", "lang", "text")
    most = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MOST_LANGUAGES)
    languages = sorted(r.lang for r in most.collect())
    ids = None
    if languages:
        order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
        known = rows.select("doc_id", "lang").join(F.broadcast(most.select("lang")), "lang", "left_semi")
        ids = known.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= FIT_DOCS).select("doc_id", "lang")
    table = np.full((BUCKETS, max(len(languages), 1)), 0.5)
    if ids is not None:
        chosen = rows.join(F.broadcast(ids.distinct()), ["doc_id", "lang"], "left_semi").select("lang", "text")  # FIT_DOCS * MOST_LANGUAGES at most

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for batch, texts in rows_of(batches, "text"):
                for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                    got = np.bincount(trigrams(text), minlength=BUCKETS)
                    sums[lang] = sums[lang] + got if lang in sums else got
            for lang, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

        sums = chosen.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        got = sums.toPandas()  # at most BUCKETS rows a language
        for k, lang in enumerate(languages):
            own = got[got["lang"] == lang]
            table[own["bucket"].to_numpy(np.int64), k] += own["n"].to_numpy(np.float64)
    return TextModel(languages, np.log(table / table.sum(0)))


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def _domain(host: Column) -> Column:
    """The registered part of a host: its last two labels, or three where the second last is a common one below a country."""
    return F.when(host.rlike(r"\.(co|com|org|net|ac|edu|gov|or|ne|go|gob|gouv)\.[a-z]{2}$"), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _address(url: Column, host: Column, languages: list[str]) -> Column:
    """The language that an address names: first path segment, first host label, last host label; else empty."""
    known = F.array(*map(F.lit, languages)) if languages else F.expr("cast(array() as array<string>)")
    path = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*?://[^/?#]+/([A-Za-z]{2,3})(?:[-_][A-Za-z]{2,4})?(?:[/?#]|$)", 1))
    first, last = F.substring_index(host, ".", 1), F.substring_index(host, ".", -1)
    pick = lambda x: F.when(F.array_contains(known, x), x)
    return F.coalesce(pick(path), pick(first), pick(last), F.lit(""))


def _normal(weights: Column) -> Column:
    """Scale an array of positive weights to sum 1."""
    total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(weights, lambda x: x / total)


def identify(pages: DataFrame, model: TextModel) -> DataFrame:
    """One row for each page: `page_id`, `url`, `host`, `declared`, `address`, `text_lang`, `lang`, `posterior`, `probabilities`.

    `pages` has `page_id`, `url` and `html`; other columns are ignored. Languages are those of the text models, in
    order; ties go to the first. A page without text, declaration and address gets its host's prior, one without a host
    the corpus's. Declarations in other languages are evidence as any. Repeated rows are identified each. Without any
    language `lang` is null. Very long pages are read whole.
    """
    spark = pages.sparkSession
    shared, names = spark.sparkContext.broadcast(model), model.languages
    size = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch, sources in rows_of(batches, "html", 500):
            scores = [own.loglik(page_text(s))[:size] for s in sources]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(2), pa.array(scores, pa.list_(pa.float64()))], ["page_id", "url", "declared", "loglik"])

    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), DECLARED, 1)).alias("declared")
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), declared, "html").mapInArrow(run, "page_id bigint, url string, declared string, loglik array<double>")
    rows = rows.withColumn("host", _host(F.col("url"))).withColumn("domain", _domain(F.col("host"))).withColumn("address", _address(F.col("url"), F.col("host"), names))
    top = F.array_max("loglik")
    rows = rows.withColumn("text_p", _normal(F.transform("loglik", lambda x: F.exp(x - top))))
    rows = staged(rows.withColumn("best", F.array_position("text_p", F.array_max("text_p")).cast("int")).drop("loglik"), "evidence")

    def tally(*keys: str) -> DataFrame:
        """Expected pages of each language by group: sums of what the texts alone say."""
        return rows.groupBy(*keys).agg(F.array(*[F.sum(F.get("text_p", F.lit(k))) for k in range(size)]).alias("n"), F.count(F.lit(1)).alias("pages"))

    if not size:
        return rows.select("page_id", "url", "host", "declared", "address", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), "text_p")
    # a page's own text never counts as evidence of its host, domain, declaration or address: sums are taken without it
    whole = tally().select("n", "pages").first()
    totals, pages_all = [float(x or 0) for x in (whole.n or [0] * size)], float(whole.pages or 0)
    own = lambda i: F.get("text_p", i)
    less = lambda n, i: F.greatest(n - own(i), F.lit(0.0))
    base = F.transform(F.array(*map(F.lit, totals)), lambda x, i: (less(x, i) + 1) / F.lit(max(pages_all - 1, 0) + size))
    hosts = staged(tally("host", "domain"), "hosts")
    domains = hosts.groupBy("domain").agg(F.array(*[F.sum(F.get("n", F.lit(k))) for k in range(size)]).alias("domain_n"), F.sum("pages").alias("domain_pages"))
    about = hosts.join(domains, "domain").select(F.col("host").alias("_host"), F.col("n").alias("host_n"), F.col("pages").alias("host_pages"), "domain_n", "domain_pages")
    towards = lambda n, pages, prior: F.transform(n, lambda x, i: (less(x, i) + F.get(prior, i) * PULL) / (F.col(pages) - 1 + PULL))

    out, given = rows, {}
    for key in ("declared", "address"):
        counts = staged(tally(key).select(F.col(key).alias(f"_{key}"), F.col("n").alias(f"{key}_n")), key)
        kinds = max(counts.count(), 1)
        out = out.join(sized(counts), F.col(key) == F.col(f"_{key}")).drop(f"_{key}")
        # P(value | language) with add-one smoothing
        given[key] = lambda i, n=f"{key}_n", kinds=kinds: (less(F.get(n, i), i) + 1) / (less(F.get(F.array(*map(F.lit, totals)), i), i) + kinds)
    out = out.join(sized(staged(about, "priors")), F.col("host") == F.col("_host")).drop("_host")
    out = out.withColumn("base_p", base).withColumn("domain_p", towards(F.col("domain_n"), "domain_pages", F.col("base_p"))).withColumn("prior", towards(F.col("host_n"), "host_pages", F.col("domain_p")))
    product = F.transform("text_p", lambda x, i: (x + 1e-12) * given["declared"](i) * given["address"](i) * F.get("prior", i))
    out = out.withColumn("probabilities", _normal(product))
    label = lambda i: F.element_at(F.array(*map(F.lit, names)), i)
    return out.select(
        "page_id", "url", "host", "declared", "address", label(F.col("best")).alias("text_lang"),
        label(F.array_position("probabilities", F.array_max("probabilities")).cast("int")).alias("lang"),
        F.array_max("probabilities").alias("posterior"), "probabilities",
    )
