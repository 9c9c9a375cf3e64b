"""Labels, sources and names from clip paths, digests and formatted text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Label numbers, container formats.
LABELS = {"NonFight": 0, "Fight": 1}
VIDEO_SUFFIXES = ("avi", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg")
NAME_BYTES = 255


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot starts none."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def is_video(path: Column) -> Column:
    """Whether a path has an allowed extension."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1)).isin(*VIDEO_SUFFIXES)


def class_name(names: dict[int, str], class_id: Column) -> Column:
    """Name of a class; its number as text if it has none."""
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.expr("cast(map() as map<int,string>)")
    return F.coalesce(F.element_at(known, class_id.cast("int")), class_id.cast("string"))


def normal_label(directory: Column, split: Column) -> Column:
    """Class directory without a leading `split_` of any case, if something remains."""
    lead = F.concat(F.lower(split), F.lit("_"))
    cut = F.substring(directory, F.length(lead) + 1, F.length(directory))
    return F.when(F.lower(directory).startswith(lead) & (F.length(directory) > F.length(lead)), cut).otherwise(directory)


def path_label(path: Column) -> Column:
    """Parent directory's text behind its first underscore, else all of it (C14)."""
    parent = F.element_at(F.split(path, "/"), -2)
    return F.when(F.instr(parent, "_") > 0, F.regexp_extract(parent, r"^[^_]*_(.*)$", 1)).otherwise(parent)


def label_index(path: Column) -> Column:
    """Number of a path's label; a path of fewer than three parts or another label fails the query."""
    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    got = F.when(F.size(F.split(path, "/")) >= 3, F.element_at(known, path_label(path)))
    return F.coalesce(got, F.raise_error(F.concat(F.lit("no label in "), path)).cast("int"))


def source_id(path: Column) -> Column:
    """The video that a clip was cut from: its stem without a last `_number`; directories don't matter."""
    s = stem(path)
    return F.when(s.rlike(r"^.+_\d+$"), F.regexp_extract(s, r"^(.+)_(\d+)$", 1)).otherwise(s)


def safe_name(original: Column, keep: int = 60) -> Column:
    """An ASCII name of bounded length, unique by digest: cleaned stem, two underscores, 12 digits of SHA-1, extension (C17)."""
    clean = F.substring(F.regexp_replace(stem(original), r"[^A-Za-z0-9_-]", ""), 1, keep)
    ext = F.regexp_extract(base_name(original), r"(?<=.)(\.[^.]*)$", 1)
    digest = F.substring(F.sha1(F.encode(original, "UTF-8")), 1, 12)
    return F.concat(F.when(clean == "", "clip").otherwise(clean), F.lit("__"), digest, ext)


def name_too_long(path: Column, limit: int = NAME_BYTES) -> Column:
    """Whether a base name exceeds a file system's byte limit."""
    return F.octet_length(base_name(path)) > limit


@pandas_udf(T.StringType())
def reencoded(names: pd.Series) -> pd.Series:
    """UTF-8 bytes read as code page 1252, as a wrongly unpacked name shows; null where they have no such form."""

    def one(name):
        try:
            return None if name is None else name.encode("utf-8").decode("cp1252")
        except UnicodeDecodeError:
            return None

    return names.map(one)


def crc32_hex(content: Column) -> Column:
    """Eight upper-case hexadecimal digits (C20)."""
    return F.lpad(F.hex(F.crc32(content)), 8, "0")


def fingerprint(size: Column, content: Column, head: int = 1 << 20) -> Column:
    """Size and MD5 of the first bytes: cheap evidence of equality."""
    return F.concat_ws(":", size.cast("string"), F.md5(F.substring(content, 1, head)))


def parsed_evidence(evidence: Column) -> Column:
    """Map of `key=value` items, cut at the first sign; others are left out, the last of a key wins."""
    pairs = F.transform(F.filter(evidence, lambda x: F.contains(x, F.lit("="))), lambda x: F.split(x, "=", 2))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q[0] == p[0]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p[0].alias("key"), p[1].alias("value"))))


def contained(path: Column) -> Column:
    """Whether a relative path stays within its root."""
    parts = F.split(path, r"[/\\]")
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, p: F.struct((a["d"] + F.when(p == "..", -1).when(p.isin(".", ""), 0).otherwise(1)).alias("d"), F.least(a["low"], a["d"] + F.when(p == "..", -1).when(p.isin(".", ""), 0).otherwise(1)).alias("low")))
    return ~path.rlike(r"^(/|\\|[A-Za-z]:)") & (depth["low"] >= 0) & (F.length(path) > 0)


def softmax(logits: Column) -> Column:
    """Class probabilities of an array of logits."""
    raised = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


def shown(value: Column, places: int = 4) -> Column:
    """A number to some places, or n/a."""
    return F.when(value.isNull(), "n/a").otherwise(F.format_string(f"%.{places}f", value))


def checked(value: Column, ok: Column, message: str) -> Column:
    """The value, or an error at run time."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast("double"))
