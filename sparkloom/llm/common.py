"""Shared plumbing of the training-data operators: scratch tables in the
cluster's shared folder, byte-level word hashing and graph components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import wraps

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent and the master is local (tests on one machine) a temporary folder is
    set; on a cluster its absence is an error, as a folder of one machine would lose data.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir()
    if named is None:
        conf = sc.getConf().get("spark.checkpoint.dir")
        if not conf and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="sparkloom-"))
        named = sc.getCheckpointDir()
    return named


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` frees them early, the end of the session frees the rest."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.made: dict[int, str] = {}
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def table(self, df: DataFrame, tasks: int | None = None) -> DataFrame:
        """``df``, written and read again; by at most so many tasks in the last stage if ``tasks`` is given."""
        df = df.coalesce(tasks) if tasks else df
        path = f"{self.root}/{len(self.made)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return freed memory of a worker to the machine: Arrow's pool, long tables of powers, the C heap."""
    import pyarrow as pa

    for base in [b for b, x in _powers.items() if len(x) > 1 << 16]:
        del _powers[base]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library, without such a call
        pass


def lean(run):
    """``run``, a function of Arrow batches, whose worker gives memory back after each partition.

    Workers are kept for the stages that follow, so what one of them holds on to stands beside all later ones.
    """

    @wraps(run)
    def out(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return out


def lean_group(run):
    """The same for a function of one group's table."""

    def out(table):
        try:
            return run(table)
        finally:
            give_back()

    return out


def lean_cogroup(run):
    """The same for a function of two tables of a group."""

    def out(left, right):
        try:
            return run(left, right)
        finally:
            give_back()

    return out


def fold(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra input columns can't clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def row_key() -> Column:
    """The doc_id as text; for rows without one a hash of their text, so that equal texts are judged alike and no key is hot."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce("text", F.lit("")), 256)))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit mixer, on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, base, np.uint64))))
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string column; null rows are empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the runs of bytes other than ASCII space.

    With ``lower`` A-Z count as a-z. The hash is polynomial over randomised
    bytes, read off prefix sums, then mixed.
    """
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_TABLE[_LOWER[data]] if lower else _TABLE[data]) * powers(_BASE, len(data)), out=total[1:])
        hashes = mix64((total[ends] - total[starts]) * powers(_INV, len(data) + 1)[starts])
    return starts, ends, hashes


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; fewer words count as one run."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        h = words[:n].copy()
        for k in range(1, size):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return np.unique(mix64(h + np.uint64(size)))


def text_shingles(column, size: int, chars: int = 1 << 21):
    """For each row of an Arrow string column its sorted distinct shingle hashes.

    Rows are hashed in blocks of about ``chars`` bytes, which bounds memory.
    """
    data, offsets = column_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chars, "right")) - 1)
        base = offsets[row]
        piece = data[base : offsets[stop]]
        starts, ends, hashes = words_of(piece)
        cuts = np.searchsorted(starts, offsets[row : stop + 1] - base)
        # A word can't cross rows unless two rows touch: then it is hashed again row by row.
        crossing = len(starts) and np.any((ends[np.maximum(cuts[1:-1] - 1, 0)] > offsets[row + 1 : stop] - base) & (cuts[1:-1] > 0))
        for k in range(stop - row):
            if crossing:
                yield shingle_hashes(words_of(piece[offsets[row + k] - base : offsets[row + k + 1] - base])[2], size)
            else:
                yield shingle_hashes(hashes[cuts[k] : cuts[k + 1]], size)
        row = stop


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): the smallest id that links (a, b) reach; only ids with links.

    Alternates large-star and small-star steps until the links are stars. A hub's
    minimum is aggregated before the shuffle and its rows meet it in a join that
    adaptive execution can split; each step is a written table, by a task for
    each half million links.
    """
    spread = lambda n: max(8, -(-n // 500_000))
    state = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    tasks, mark = spread(state.count()), None
    while True:
        both = state.union(state.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = scratch.table(large, tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.table(small, tasks)
        scratch.drop(state, large)
        n, now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        state, tasks = after, spread(n)
        if (n, now) == mark:
            break
        mark = n, now
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")).union(state.select("v", "v").distinct())


def cells(lists: DataFrame, block: int, by: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join of each list (key) with itself: on key, i and j each pair of rows meets once for each order.

    A list of one row is left out; one of more than ``block`` rows is dealt by ``by`` into blocks, so that no task takes a whole hot list.
    """
    size = lists.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    rows = lists.join(size, "key").withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).drop("size")
    own, every = F.pmod(by, F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return rows.withColumn("i", own).withColumn("j", every), rows.withColumn("j", own).withColumn("i", every)


def meet(rows: DataFrame, few: DataFrame, by: Column, how: str = "inner", salts: int = 32) -> DataFrame:
    """``rows`` joined on key with ``few``, which has a row for each key; a hot key's rows are dealt by ``by`` to ``salts`` places."""
    few = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(by, F.lit(salts)).cast("int")).join(few, ["key", "salt"], how).drop("salt")


def runs(batches, keys: list):
    """(batch, cuts): batches of whole runs of rows with equal ``keys`` (whole numbers), and where each run begins and ends.

    The rows come sorted by ``keys``; a run may span the batches that come in.
    """
    import pyarrow as pa

    left = None
    for b in batches:
        if left is not None:
            b = pa.Table.from_batches([left, b]).combine_chunks().to_batches()[0]
        left = b
        if not len(b):
            continue
        columns = [b.column(k).to_numpy() for k in keys]
        edges = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in columns])) + 1
        if len(edges):
            yield b.slice(0, int(edges[-1])), np.append(0, edges)
            left = b.slice(int(edges[-1]))
    if left is not None and len(left):
        yield left, np.array([0, len(left)])


def text_blocks(column, chars: int = 1 << 21):
    """Texts of an Arrow string column in blocks of about ``chars`` bytes.

    Yields first row, last row + 1, the block's bytes with one space after each
    text, word starts, ends and hashes in it, and where each row's words begin.
    """
    data, offsets = column_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chars, "right")) - 1)
        base = offsets[row]
        count = stop - row
        piece = np.full(int(offsets[stop] - base) + count, 32, np.uint8)
        inner = np.ones(len(piece), bool)
        inner[offsets[row + 1 : stop + 1] - base + np.arange(count)] = False
        piece[inner] = data[base : offsets[stop]]
        starts, ends, hashes = words_of(piece)
        yield row, stop, piece, starts, ends, hashes, np.searchsorted(starts, offsets[row : stop + 1] - base + np.arange(count + 1))
        row = stop
