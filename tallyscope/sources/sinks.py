"""Sinks: record files, resumable outputs, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_records(rows: DataFrame, path: str) -> None:
    """One JSON record a line (B1, B2); confidences are rounded to six places."""
    if "conf" in rows.columns:
        rows = rows.withColumn("conf", F.round("conf", 6))
    rows.write.json(path, ignoreNullFields=False)


def window_csv(rows: DataFrame, path: str) -> None:
    """Window scores with probabilities to six decimals in fixed columns."""
    fixed = ["split", "clip", "window_index", "first_frame", "last_frame", "true_label", "fight_probability"]
    rows.withColumn("fight_probability", F.format_string("%.6f", "fight_probability")).select(*fixed).write.csv(path, header=True)


def table_csv(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A report table, range-sorted if an order is given."""
    (rows.orderBy(*order) if order else rows).write.csv(path, header=True)


def document(parts: dict[str, DataFrame], path: str) -> None:
    """A small document of one-row tables as nested JSON."""
    out = None
    for name, df in parts.items():
        row = df.limit(1).select(F.struct(*df.columns).alias(name))
        out = row if out is None else out.crossJoin(row)  # one row each
    out.write.json(path)


def markdown(rows: DataFrame, limit: int = 500) -> str:
    """A report table as text; null shows as n/a (B7, C30). Reports have few rows; a longer one is refused."""
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    show = lambda v: "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in got)])


def resume(rows: DataFrame, done: DataFrame, key: str, protocol: str) -> DataFrame:
    """The rows not yet written; output of another protocol fails the query."""
    same = done.select(F.col(key), F.when(F.col("protocol") == protocol, 1).otherwise(F.raise_error(F.lit("written under another protocol"))).alias("_ok"))
    return rows.withColumn("protocol", F.lit(protocol)).join(same.filter("_ok = 1").select(key), key, "left_anti")


def manifest(rows: DataFrame, key: str, environment: dict[str, str]) -> DataFrame:
    """One row that describes an output: rows, distinct keys, an order-free digest, and the environment."""
    digest = F.hex(F.bit_xor(F.xxhash64(*rows.columns)))
    env = F.create_map(*[F.lit(x) for kv in environment.items() for x in kv]) if environment else F.lit(None)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys"), digest.alias("digest")).withColumn("environment", env)
