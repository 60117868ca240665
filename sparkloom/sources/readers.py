"""Readers of the study's files: declared schemas, pointer rejection and provenance."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.plans.schemas import PROVENANCE, SCHEMAS
from sparkloom.sources import xz
from sparkloom.sources.connectors import byte_ranges
from sparkloom.sources.files import SEEKABLE, open_file, scheme_of

#: First line of a large-file pointer that stands in place of data (fixed by its public format).
POINTER = "version https://git-lfs.github.com/spec/"


def pointers(spark: SparkSession, path: str) -> DataFrame:
    """path, oid and size of every file that is a pointer. Only files of up to 1 kB are opened."""
    small = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length <= 1024")
    text = F.decode("content", "utf-8")
    return small.where(F.substring("content", 1, len(POINTER)) == F.lit(POINTER.encode())).select(
        "path", F.regexp_extract(text, r"oid (\S+)", 1).alias("oid"), F.regexp_extract(text, r"size (\d+)", 1).try_cast("long").alias("size")
    )


def reject_pointers(spark: SparkSession, path: str) -> None:
    found = pointers(spark, path).limit(1).collect()
    if found:
        raise ValueError(f"{found[0].path} is a pointer, not data; fetch the file first")


def with_provenance(df: DataFrame, provenance: str) -> DataFrame:
    if provenance not in PROVENANCE:
        raise ValueError(f"provenance must be one of {PROVENANCE}")
    return df.withColumn("provenance", F.lit(provenance))


def read_table(spark: SparkSession, path: str, kind: str, provenance: str = "unknown") -> DataFrame:
    """CSV by a declared schema: quotes may hold newlines and doubled quotes, and names are trimmed of white space."""
    reject_pointers(spark, path)
    df = spark.read.schema(SCHEMAS[kind]).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            df = df.withColumn(f.name, F.trim(F.regexp_replace(F.col(f"`{f.name}`"), r"\s+", " ")))
    return with_provenance(df, provenance)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of file records; source and note may be absent."""
    return spark.read.schema(SCHEMAS["manifest"]).option("multiLine", True).json(path)


def read_json_folder(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", "true").json(path)


def read_parquet_folder(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """path and length of files, without reading them."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def xz_lines(spark: SparkSession, path: str, split: int = 32 << 20) -> DataFrame:
    """path and line of all lines of xz files that are not blank.

    Files are cut every ``split`` bytes, and a task reads the blocks that begin in
    its part: it finds them by the file's indexes, and goes on into later blocks
    only to end its last line. Files of one block are one task. Several streams are
    read one after another; files that are cut off or damaged are errors. Files of
    no bytes don't come up in Spark's listing and have no lines. Where tasks can't seek (``SEEKABLE``) Spark hands them whole files of up to 2 GB.
    """

    def batch(name, lines):
        import pyarrow as pa

        lines = pa.array([x for x in lines if x.strip()], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([name] * len(lines), pa.string()), lines], ["path", "line"])

    def of_parts(batches):
        for b in batches:
            for name, length, low in zip(*(b.column(c).to_pylist() for c in ("path", "length", "low")), strict=True):
                with open_file(name) as f:
                    for lines in xz.lines_between(f, length, low, low + split):
                        yield batch(name, lines)

    def of_files(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                data = content.as_py()
                for lines in xz.lines_between(io.BytesIO(data), len(data), 0, len(data)):
                    yield batch(name, lines)

    reject_pointers(spark, path)
    kind = "path string, line string"
    if scheme_of(path) not in SEEKABLE:
        return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(of_files, kind)
    files = files_of(spark, path)
    parts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("low"))
    return parts.repartition(max(1, parts.count())).mapInArrow(of_parts, kind)


def read_xz_lines(spark: SparkSession, path: str, schema: T.StructType | str, split: int = 32 << 20) -> DataFrame:
    """JSON lines compressed with xz, by a declared schema; lines that don't fit it are an error."""
    rows = xz_lines(spark, path, split).select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r"))
    return rows.select("r.*")


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """model, task, metric, value (double, null for "N/A") of evaluation cards: Markdown with fenced JSON results."""
    text = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    body = F.regexp_extract("value", r"(?s)## Latest results.*?```(?:python|json)?\s*(\{.*?\})\s*```", 1)
    tasks = F.from_json(F.get_json_object(body, "$.all"), T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())))
    folder = F.url_decode(F.replace(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.lit("+"), F.lit("%2B")))  # the path comes encoded
    rows = text.select(folder.alias("model"), F.explode(tasks).alias("task", "metrics"))
    return rows.select("model", "task", F.explode("metrics").alias("metric", "text")).select("model", "task", "metric", F.expr("try_cast(text AS double)").alias("value"))


def read_byte_range(spark: SparkSession, path: str, start: int, length: int, every: int = 0) -> DataFrame:
    """path, start and bytes of a range of each file, without decoding (a range sample, not a row sample); with ``every`` of
    further ranges so many bytes apart. Tasks seek to the ranges; where they can't, Spark reads whole files."""
    if scheme_of(path) in SEEKABLE:
        return byte_ranges(spark, [tuple(r) for r in files_of(spark, path).collect()], start, length, every)
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > start)
    starts = F.sequence(F.lit(start).cast("long"), F.col("length") - 1, F.lit(every).cast("long")) if every else F.array(F.lit(start).cast("long"))
    rows = files.select("path", F.explode(starts).alias("start"), "content")
    return rows.select("path", "start", F.expr(f"substring(content, start + 1, {length})").alias("bytes"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of each file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
