"""Data sources of our own: byte ranges of files as partitions, and a sink of xz lines that verifies before it publishes."""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sparkloom.sources import xz
from sparkloom.sources.files import found_files, open_file, read_exactly, system_of
from sparkloom.sources.writers import resolved


class Ranges(InputPartition):
    """Ranges (start, length) of one file."""

    def __init__(self, path: str, ranges: list[tuple[int, int]]):
        self.path, self.ranges = path, ranges


class RangeReader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options["files"]) if "files" in options else found_files(options["path"])
        self.start, self.length, self.every = (int(options.get(k, 0)) for k in ("start", "length", "every"))
        self.most = int(options.get("partitionbytes", 32 << 20))
        if self.start < 0 or self.length < 1 or self.every < 0 or 0 < self.every < self.length:
            raise ValueError("start is from 0 on, length from 1 on, and every is 0 (one range) or at least the length")

    def partitions(self) -> list[Ranges]:
        out = []
        for path, size in self.files:
            starts = range(self.start, size, self.every) if self.every else range(self.start, min(size, self.start + 1))
            few = max(1, self.most // self.length)
            out += [Ranges(path, [(at, min(self.length, size - at)) for at in starts[k : k + few]]) for k in range(0, len(starts), few)]
        return out or [Ranges("", [])]

    def read(self, part: Ranges):
        if part.ranges:
            with open_file(part.path) as f:
                for start, length in part.ranges:
                    yield part.path, start, read_exactly(f, start, length)


class ByteRanges(DataSource):
    """``byte_ranges``: path, start and bytes of the range from ``start`` on, ``length`` long, of each file; with ``every``
    of further ranges that begin so many bytes apart. Files end the last range early; a file shorter than ``start`` has none.

    ``path`` is a file or folder, or ``files`` a JSON list of (path, size). Tasks seek to their ranges and read nothing else."""

    @classmethod
    def name(cls):
        return "byte_ranges"

    def schema(self):
        return "path string, start long, bytes binary"

    def reader(self, schema):
        return RangeReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    """A staged file, its lines, and the sum of their check sums, as read again from it."""

    path: str
    lines: int
    total: int


def line_totals(batches) -> tuple[int, int]:
    """Number of lines and sum of their check sums, for lists of lines."""
    lines = total = 0
    for batch in batches:
        lines += len(batch)
        total += sum(map(zlib.crc32, batch))
    return lines, total


class XzSink(DataSourceArrowWriter):
    """Each task writes a staged file of its own name and reads it again; the commit compares all totals and moves the files that
    it was told of. So a retried task counts once, and a failing check leaves nothing behind."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.expected = tuple(int(options[k]) if k in options else None for k in ("lines", "total"))
        self.block, self.preset = int(options.get("block", 8 << 20)), int(options.get("preset", 6))
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator):
        system, folder = system_of(self.staging)
        system.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.jsonl.xz"
        wrote = [0, 0]
        with system.open_output_stream(f"{folder}/{name}", compression=None) as out:
            packer = xz.Writer(out, self.block, self.preset)
            for b in iterator:
                lines = [(x.as_py() or "").encode() for x in b.column(0)]
                if any(b"\n" in x or not x for x in lines):
                    raise ValueError("a line is empty or holds a newline")
                n, total = line_totals([lines])
                wrote = [wrote[0] + n, wrote[1] + total]
                for at in range(0, len(lines), 1024):
                    packer.write(b"".join(x + b"\n" for x in lines[at : at + 1024]))
            packer.close()
        size = system.get_file_info(f"{folder}/{name}").size
        with open_file(f"{self.staging}/{name}") as f:
            again = line_totals(xz.lines_between(f, size, 0, size))
        if list(again) != wrote:
            raise ValueError(f"{name} reads back as {again}, {tuple(wrote)} was written")
        return Written(name, *again)

    def commit(self, messages):
        told = [m for m in messages if m is not None]
        totals = sum(m.lines for m in told), sum(m.total for m in told)
        if any(e is not None and e != t for e, t in zip(self.expected, totals, strict=True)):
            raise ValueError(f"lines and their sum are {totals}, not {self.expected} as expected: nothing is published")
        system, folder = system_of(self.path)
        _, staged = system_of(self.staging)
        system.create_dir(folder, recursive=True)
        old = found_files(self.path)
        if old and not self.overwrite:
            raise ValueError(f"{self.path} holds files already")
        for m in sorted(told, key=lambda m: m.path):
            system.move(f"{staged}/{m.path}", f"{folder}/{m.path}")
        for path, _ in old:  # last, so that no moment is without rows
            system.delete_file(system_of(path)[1])
        with system.open_output_stream(f"{folder}/_SUCCESS") as out:
            out.write(json.dumps({"lines": totals[0], "total": totals[1], "files": len(told)}).encode())
        self.clear()

    def abort(self, messages):
        self.clear()

    def clear(self):
        """Staged files go, and the folder if nothing was ever published there."""
        from pyarrow import fs

        system, folder = system_of(self.staging)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)
        system, folder = system_of(self.path)
        if system.get_file_info(folder).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(folder)):
            system.delete_dir(folder)


class XzLines(DataSource):
    """``xz_lines``: a sink for one column of lines, and files of several blocks that ``read_xz_lines`` reads in parallel."""

    @classmethod
    def name(cls):
        return "xz_lines"

    def schema(self):
        return "line string"

    def writer(self, schema, overwrite):
        return XzSink(self.options, overwrite)


def write_xz_lines(df: DataFrame, path: str, overwrite: bool = False, source: str | None = None, block: int = 8 << 20, totals: tuple[int, int] | None = None) -> None:
    """Rows as JSON lines in xz files, one a task, in blocks of ``block`` bytes.

    The lines that tasks read back must have the number and sum of check sums
    that ``df`` has (or ``totals``); only then do files appear at ``path``, with
    ``_SUCCESS`` as the last. Empty tables give a file without lines. ``source`` is as for ``write_table``.
    """
    if source is not None and resolved(source) == resolved(path):
        raise ValueError("the output path is the source's own")
    df.sparkSession.dataSource.register(XzLines)
    lines = df.select(F.to_json(F.struct("*")).alias("line"))
    if totals is None:
        totals = tuple(lines.agg(F.count("*"), F.coalesce(F.sum(F.crc32(F.col("line").cast("binary")).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")).first())
    out = lines.write.format("xz_lines").option("lines", str(totals[0])).option("total", str(totals[1])).option("block", str(block))
    out.mode("overwrite" if overwrite else "append").save(path)


def byte_ranges(spark: SparkSession, files: list[tuple[str, int]], start: int, length: int, every: int = 0) -> DataFrame:
    """path, start, bytes; as ``ByteRanges`` says."""
    spark.dataSource.register(ByteRanges)
    return spark.read.format("byte_ranges").option("files", json.dumps(files)).option("start", str(start)).option("length", str(length)).option("every", str(every)).load()
