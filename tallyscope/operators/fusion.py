"""Fusion of temporal and spatial evidence."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.operators.ordered import running


@dataclass(frozen=True)
class Protocol:
    """Frozen thresholds, the weight of the temporal rank, and the two sorted reference samples (some hundred values)."""

    temporal: float
    spatial: float
    fused: float
    weight: float
    temporal_reference: tuple[float, ...] = ()
    spatial_reference: tuple[float, ...] = ()


def reference(rows: DataFrame, column: str) -> tuple[float, ...]:
    """The sorted non-null values of a development sample (L6); meant for samples of some hundred clips."""
    return tuple(rows.agg(F.sort_array(F.collect_list(column)).alias("v")).first().v)


def percentile(value: Column, sample: tuple[float, ...]) -> Column:
    """Share of a stored sample strictly below a value (D19); null for null, and with an empty sample."""
    if not sample:
        return F.lit(None).cast("double")
    array = F.array(*[F.lit(float(x)) for x in sample])
    return F.when(value.isNotNull(), F.size(F.filter(array, lambda r: r < value)) / F.lit(float(len(sample))))


def percentile_by_join(rows: DataFrame, column: str, sample: DataFrame, sample_column: str) -> DataFrame:
    """The same against a large sample in a table: values and sample are counted by distinct value and ordered together, so
    the work is one sort rather than a comparison of all with all."""
    points = sample.filter(F.col(sample_column).isNotNull()).groupBy(F.col(sample_column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    asked = rows.filter(F.col(column).isNotNull()).select(F.col(column).alias("v")).distinct().withColumn("c", F.lit(0))
    both = points.unionByName(asked).groupBy("v").agg(F.sum("c").alias("c"))
    total = points.agg(F.sum("c").alias("total"))
    shares = running(both, ["v"], {"below": "c"}, unique=True).crossJoin(total).select(F.col("v").alias(column), (F.col("below") / F.col("total")).alias("percentile"))  # one row of totals
    return rows.join(shares, column, "left")


def evaluate(rows: DataFrame, p: Protocol, temporal: str = "temporal_max", spatial: str = "spatial") -> DataFrame:
    """Adds the decisions of the four candidates and the parts of the rank sum.

    B0 temporal alone, B1 spatial alone, F1 either, F2 the weighted sum of percentiles, in which a null spatial score counts
    as 0 while it stays null in the output. Without temporal evidence there is no decision.
    """
    t, s = F.col(temporal), F.col(spatial)
    pt, ps = percentile(t, p.temporal_reference), percentile(s, p.spatial_reference)
    score = p.weight * pt + (1 - p.weight) * F.coalesce(ps, F.lit(0.0))
    out = rows.withColumns({"temporal_pct": pt, "spatial_pct": ps, "fused_score": score})
    known = t.isNotNull()
    b0, b1 = t >= p.temporal, F.coalesce(s >= p.spatial, F.lit(False))
    return out.withColumns({
        "b0": F.when(known, b0), "b1": F.when(known, b1), "f1": F.when(known, b0 | b1), "f2": F.when(known, F.col("fused_score") >= p.fused),
        "available": known, "system_decision": F.when(known, b0),
    })


def canonical_digest(body: dict) -> str:
    """SHA-256 of the canonical JSON of an artifact."""
    return hashlib.sha256(json.dumps(body, indent=2, sort_keys=True).encode()).hexdigest()


def load_protocol(text: str) -> Protocol:
    """A frozen protocol from its JSON, refused if the recorded digest isn't that of its body."""
    body = json.loads(text)
    recorded = body.pop("sha256", None)
    if recorded != canonical_digest(body):
        raise ValueError("the protocol's digest doesn't match its body")
    return Protocol(body["temporal"], body["spatial"], body["fused"], body["weight"], tuple(body["temporal_reference"]), tuple(body["spatial_reference"]))


def changed_clips(rows: DataFrame, a: str, b: str, stratum: str) -> DataFrame:
    """Of each stratum the clips that only one of two candidates decides for, sorted: `only_a`, `only_b`, `clips` (L7). The lists hold
    an evaluation set's few changes."""
    only = lambda yes, no: F.sort_array(F.collect_list(F.when(F.col(yes) & ~F.col(no), F.col("clip"))))
    return rows.groupBy(stratum).agg(only(a, b).alias("only_a"), only(b, a).alias("only_b"), F.count(F.lit(1)).alias("clips"))
