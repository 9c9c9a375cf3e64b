"""Provenance verdicts, incident reports and batching."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def verdict(rows: DataFrame, rejections: dict[str, Column], warnings: dict[str, Column]) -> DataFrame:
    """All reasons against each artifact at once, and warnings; accepted if there is no reason against it (O1)."""
    collect = lambda rules: F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for m, c in rules.items()]), lambda x: x.isNotNull())
    out = rows.withColumns({"rejections": collect(rejections) if rejections else F.expr("cast(array() as array<string>)"), "warnings": collect(warnings) if warnings else F.expr("cast(array() as array<string>)")})
    return out.withColumn("accepted", F.size("rejections") == 0)


def trained_only(scores: DataFrame, column: str = "provenance") -> DataFrame:
    """Scores of a trained checkpoint; any other provenance fails the query."""
    return scores.filter(F.when(F.col(column).startswith("checkpoint"), True).otherwise(F.raise_error(F.lit("scores of an untrained model"))))


def incident(summary: DataFrame, records: DataFrame, peaks: DataFrame, risk: DataFrame) -> DataFrame:
    """One nested report for each clip as JSON: events, peak window, overall risk, what isn't available."""
    events = records.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("seq", "frame", "event_type", "risk_level", "confidence"))).alias("events"))
    rows = summary.join(events, "clip", "left").join(peaks.select("clip", F.struct("window_index", "first_frame", "last_frame", "score").alias("peak")), "clip", "left").join(risk, "clip", "left")
    body = F.struct("clip", "overall_risk", "peak", F.coalesce("events", F.expr("cast(array() as array<struct<seq:bigint,frame:bigint,event_type:string,risk_level:string,confidence:double>>)")).alias("events"), F.lit("not_requested").alias("saliency"), F.array(F.lit("risk levels are configured, not validated")).alias("limitations"))
    return rows.select("clip", F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


def closure(edges: dict[str, set[str]], roots: list[str]) -> list[str]:
    """Everything that the roots need, dependencies first (O6): a driver-side walk over a package's modules."""
    done: list[str] = []

    def visit(node: str, above: tuple[str, ...]) -> None:
        if node in done or node in above:
            return
        for other in sorted(edges.get(node, ())):
            visit(other, (*above, node))
        done.append(node)

    for root in roots:
        visit(root, ())
    return done


def or_missing(wanted: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """A report row for each wanted key; absent values say so rather than being made up."""
    return wanted.join(found, key, "left").withColumn(value, F.coalesce(F.col(value).cast("string"), F.lit("missing")))


def batches(entries: DataFrame, limit: int, archive: str = "archive", order: str = "seq", size: str = "size") -> DataFrame:
    """Number of the batch of each entry: a batch is closed before it would exceed the limit; a larger entry is alone.

    The reset makes the order sequential within one archive, and archives run in parallel.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        now, held, out = 0, 0, []
        for n in pdf[size].tolist():
            if held and held + n > limit:
                now, held = now + 1, 0
            held += n
            out.append(now)
        return pdf.assign(batch=out)

    return entries.groupBy(archive).applyInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema) + ", batch int")


def pieces(stream: DataFrame, entries: DataFrame, archive: str = "archive") -> DataFrame:
    """Contents of an archive's stream cut at known lengths, and whether each has its recorded CRC (O9). `stream` has the bytes of
    one batch of entries, which its limit bounds."""
    start = F.coalesce(F.sum("size").over(Window.partitionBy(archive).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = entries.withColumn("start", start).join(stream, archive)
    rows = rows.withColumn("content", F.substring("content", F.col("start").cast("int") + 1, F.col("size").cast("int")))
    return rows.withColumn("intact", F.lpad(F.hex(F.crc32("content")), 8, "0") == F.upper("crc"))


def scored(frames: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.Series]]) -> DataFrame:
    """Scores of a model that each Python worker loads once (N7, N8): `load` returns a function from a batch to its scores."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in parts:
            yield part.assign(score=model(part))

    return frames.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.schema) + ", score double")
