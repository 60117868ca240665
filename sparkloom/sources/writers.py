"""Sinks: tables by format, and nested reports as JSON."""

from __future__ import annotations

import os
import posixpath
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolved(path: str) -> str:
    """One name for all ways to write a path: dot segments, doubled slashes, ``file:`` and, on this machine, links."""
    scheme, rest = re.fullmatch(r"(?s)(?:([A-Za-z][A-Za-z0-9+.-]*):)?(.*)", path).groups()
    if scheme in (None, "file"):
        return os.path.realpath(re.sub("^/+", "/", rest))
    host, _, rest = rest.removeprefix("//").partition("/")
    return f"{scheme}://{host}{posixpath.normpath(re.sub('/+', '/', '/' + rest))}"


def write_table(df: DataFrame, path: str, format: str = "parquet", source: str | None = None, partition_by: list[str] | None = None, **options) -> None:
    """Write to ``path``; ``source`` is what ``df`` was read from and may not be overwritten by it."""
    if source is not None and resolved(source) == resolved(path):
        raise ValueError("Choose an output path other than the source.")
    out = df.write.format(format).options(**options)
    (out.partitionBy(*partition_by) if partition_by else out).save(path)


def report(checks: DataFrame, key: str, value: str, totals: list[str]) -> DataFrame:
    """One JSON text a ``key``: its rows by ``value`` and the sum of each of ``totals``. Keys are documents, their rows pages."""
    rows = checks.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(value, *[c for c in checks.columns if c not in (key, value)]))).alias("checks"), F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in totals]
    )
    return rows.select(key, F.to_json(F.struct(F.col(key), "pages", *totals, "checks")).alias("report"))
